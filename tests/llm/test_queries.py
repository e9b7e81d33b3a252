import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from starloom.llm import licenses
from starloom.llm.oracles import ORACLES
from starloom.llm.queries import QUERIES
from tests.parity import assert_parity, connect


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert_parity(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() >= spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_license_sql_judges_every_block(spark, tmp_path):
    """Each template with one word left out, so that no word is one that the SQL may take for granted."""
    bodies = ["redistribution and use in source forms with or without modification are permitted provided"]
    for _, words in licenses.TEMPLATES:
        w = words.split()
        bodies += [" ".join(["on", *w[:i], *w[i + 1 :], "more"]) for i in range(len(w))]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(bodies)), pa.int64()), "text": bodies}), tmp_path / "documents.parquet")
    con = connect(tmp_path)
    assert con.sql(f"SELECT labels FROM ({ORACLES['op8_license_blocks']}) WHERE doc_id = 0").fetchall() == [("bsd",)]
    assert_parity(QUERIES["op8_license_blocks"](spark, str(tmp_path)), con, ORACLES["op8_license_blocks"])
