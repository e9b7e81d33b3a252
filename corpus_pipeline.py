"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. The
stages may be run one by one, each result written and read again, or by run().

In every stage: null text counts as empty; rows that repeat are documents of their own; any column may be null; very long
texts are taken whole; an empty table gives an empty result. Extra columns stay as they are, also those that are named like
a column that an operator adds. n_chars, where there is one, follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm import line_dedup, mixing, near_dedup, packing, quality
from starloom.llm.common import read_table, shielded, written
from starloom.llm.queries import TOKENIZER


def _with_own_columns(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], added: set[str]) -> DataFrame:
    """operator(docs) with the columns of docs alone, those that are named like an added one included."""
    inside, back = shielded(docs, added)
    return operator(inside).drop(*added).withColumnsRenamed(back).select(docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, fail another badly, or fail one on a bad host go.

    Null or empty text has no words and goes. A null host is a host of its own.
    """
    return quality.quality_filter(docs)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many documents stay in the one of the largest id; n_chars follows the text. No document goes."""

    def lines_dropped(inside: DataFrame) -> DataFrame:
        kept = line_dedup.dedup_lines(inside)
        return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept

    return _with_own_columns(docs, lines_dropped, {"n_lines", "n_dropped"})


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that of the smallest id. Documents without a word are one class."""
    return near_dedup.drop_near_duplicates(docs).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. A null source is a source of its own."""

    def taken(inside: DataFrame) -> DataFrame:
        mixed = mixing.mix_sources(inside).where("copies > 0")
        return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))

    return _with_own_columns(docs, taken, mixing.ADDED | {"__copy"})


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece, with its sequence and place. A document without text is its end token."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_common_lines),
    ("near-duplicates", drop_near_duplicates),
    ("source mix", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Packing by sums of squares is a sequence of choices, which SQL can't express; the tests hold it against brute force.
ORACLE_SQL = None
