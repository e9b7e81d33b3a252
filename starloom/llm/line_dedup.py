"""Line dedup with levelled sorted runs of line hashes. DataFrame functions only.

A line's key is the line stripped of ASCII white space, A-Z lower-cased, as a 128-bit hash. Documents come in batches of
descending id. Each batch merge-anti-joins the runs so far (keys already found often enough need no more counting: their
keeper has a larger id) and adds a sorted run of its own: key, number of documents, largest id. When a level holds FAN_IN
runs they are compacted into one sorted run of the next level. In the end a key found in enough documents loses its lines
everywhere but in the document of the largest id. Runs are sorted in buckets by key, so that a batch is merged with them
without an exchange or a sort of the runs.

Null text is one empty line, as is empty text. Rows are told apart by id and text: a row repeated as a whole counts once
and both copies are treated alike; one id with two texts counts twice. A null id is smaller than any other; if only null
ids hold a key, none of them loses it. Extra columns stay; the columns that the operator adds (n_lines, n_dropped)
replace input columns of the same name. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import Scratch, ascii_lower, delete_path, shared_dir, shielding, text_of

MIN_CHARS, MIN_DOCS = 40, 5
FAN_IN, BATCHES, BUCKET_ROWS = 3, 4, 1_000_000
_KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")))


class LineRuns:
    """Sorted runs of (h1, h2, n_docs, last_id) in levels.

    A run is a table in the shared folder, cut into the same number of buckets by key and sorted in each. A batch is dealt
    and sorted once by the same buckets; it then meets every run by merging, without an exchange of the run.
    """

    def __init__(self, spark: SparkSession, enough: int = MIN_DOCS, fan_in: int = FAN_IN, buckets: int = 8):
        self.spark, self.enough, self.fan_in, self.buckets = spark, enough, fan_in, buckets
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.root = f"{shared_dir(spark)}/{self.name}"
        self.made, self.schema = 0, None
        self.levels: list[list[str]] = []

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(run) for run in self._names()]

    def _names(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def state(self) -> DataFrame | None:
        """One row a key over all runs."""
        return self._merged(self._names()) if self.levels else None

    def _merged(self, runs: list[str]) -> DataFrame:
        """One row a key over these runs, read as plain files: Spark 4.1 takes a union of bucketed tables for bucketed, but reads it one after the other."""
        files = self.spark.read.schema(self.schema).parquet(*(f"{self.root}/{run}" for run in runs))
        return files.groupBy(*_KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("last_id").alias("last_id"))

    def _write(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.made, self.schema = self.made + 1, run.schema
        table = f"{self.name}_{self.made}"
        run.write.bucketBy(self.buckets, *_KEY).sortBy(*_KEY).option("path", f"{self.root}/{table}").saveAsTable(table)
        self.levels[level].append(table)

    def _remove(self, tables: list[str]) -> None:
        for table in tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            delete_path(self.spark, f"{self.root}/{table}")

    def unseen(self, keys: DataFrame) -> DataFrame:
        """Rows of keys (h1, h2, ...) that are not yet in the runs often enough: the merge anti-join.

        A key's count is the sum over the runs, so each run is merged in turn and the sum decides.
        """
        names, counts = keys.columns, F.lit(0).cast("long")
        for i, run in enumerate(self.runs()):
            keys = keys.join(run.select(*_KEY, F.col("n_docs").alias(f"__seen{i}")), _KEY, "left")
            counts = counts + F.coalesce(f"__seen{i}", F.lit(0))
        return keys.where(counts < self.enough).select(names)

    def add(self, lines: DataFrame) -> None:
        """A batch of (h1, h2, doc_id), one row a key and document; later batches hold smaller ids."""
        with _sorted_buckets(self.spark):
            # summed up before it is dealt, so that a line that very many documents hold is a few rows; with as many buckets
            # as shuffle partitions Spark does both in one exchange
            own = lines.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_id"))
            self._write(self.unseen(own.repartition(self.buckets, *_KEY)), 0)
            level = 0
            while len(self.levels[level]) >= self.fan_in:
                full, self.levels[level] = self.levels[level], []
                self._write(self._merged(full).repartition(self.buckets, *_KEY), level + 1)
                self._remove(full)
                level += 1

    def drop(self) -> None:
        """Removes all runs."""
        self._remove(self._names())
        self.levels = []


@contextmanager
def _sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """Lets scans of one file a bucket count as sorted, so that merges need no sort of the run."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def line_table(docs: DataFrame, text: str, key: str, min_chars: int) -> DataFrame:
    """(doc_id, row_hash, h1, h2, places): each key of each document with the positions of its lines."""
    lines = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text_of(text)).alias("row_hash"), F.posexplode(F.split(text_of(text), "\n", -1)).alias("place", "line"))
    keyed = lines.withColumn("k", line_key("line")).where(F.length("k") >= min_chars)
    keyed = keyed.select("doc_id", "row_hash", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(7), F.col("k")).alias("h2"), "place")
    return keyed.groupBy("doc_id", "row_hash", *_KEY).agg(F.collect_list("place").alias("places"))


@shielding("__line_hash", "__line_drop", "__line_id", "__line_row")
def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """docs with the text without its dropped lines, n_lines (before) and n_dropped."""
    docs = docs.drop(*({"n_lines", "n_dropped"} - {text, key}))
    scratch = Scratch(docs.sparkSession, "lines")
    table = scratch.write(line_table(docs, text, key, min_chars), "lines")
    cuts = table.select(F.percentile_approx("doc_id", [i / batches for i in range(batches - 1, 0, -1)], 1000)).first()[0] or []
    runs = LineRuns(docs.sparkSession, min_docs, buckets=max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-table.count() // BUCKET_ROWS)))
    bounds = [None, *dict.fromkeys(cuts), None]
    for above, upto in zip(bounds[1:], bounds[:-1], strict=True):
        part = table
        if upto is not None:
            part = part.where((F.col("doc_id") <= upto) | F.col("doc_id").isNull() if above is None else F.col("doc_id") <= upto)
        if above is not None:
            part = part.where(F.col("doc_id") > above)
        runs.add(part.select(*_KEY, "doc_id"))
    # written tables, not aggregates, so that the joins below can split a line that very many documents hold, and so that
    # Spark knows their sizes: texts are shuffled only if the places to drop are too large to be broadcast
    often = scratch.write(runs.state().where(F.col("n_docs") >= min_docs).select(*_KEY, "last_id"), "often")
    runs.drop()
    loses = F.col("doc_id").isNull() & F.col("last_id").isNotNull() | (F.col("doc_id") < F.col("last_id"))
    drop = table.join(often, _KEY).where(loses).groupBy(F.col("doc_id").alias("__line_id"), F.col("row_hash").alias("__line_row")).agg(F.flatten(F.collect_list("places")).alias("__line_drop"))
    drop = scratch.write(drop, "places-to-drop")
    scratch.keep_only(drop)
    own = docs.withColumn("__line_hash", F.xxhash64(text_of(text)))
    out = own.join(drop, (F.col("__line_hash") == F.col("__line_row")) & F.col(key).eqNullSafe(F.col("__line_id")), "left").drop("__line_id", "__line_row", "__line_hash")
    lines = F.split(text_of(text), "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__line_drop"))
    dropped = F.when(F.col("__line_drop").isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(stay))
    kept = F.when(F.col("__line_drop").isNull(), text_of(text)).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    return out.withColumns({"n_lines": F.size(lines).cast("long"), "n_dropped": dropped.cast("long"), text: kept}).drop("__line_drop")
