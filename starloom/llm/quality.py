"""Quality rules with host-level rates.

Each document is measured in one pass over its whole text. Base rules and severe failures decide by themselves, on any
host. Milder rules are evidence that a document alone can't carry: its host decides. Rule failures are summed by host and
shrunk towards an empirical beta prior, whose mean is the common rate and whose strength comes from the variance of the
rates over hosts, by moments. Where that is no larger than chance makes it, hosts are alike and none is bad. Otherwise a
host's error is the probability, by the normal approximation of its posterior, that its rate is under LIFT times the common
one; hosts are called bad from the smallest error on as long as the mean error of all that are called stays within
FALSE_SHARE, which bounds the expected share of hosts called bad by chance. A document that fails a milder rule goes where
its host is bad; one that fails no rule stays, whatever its host.

Null or empty text has no words and fails the base rules. A null host is a host of its own. Repeated rows are judged alike
and count each. Extra columns stay; result columns replace input columns of the same name, except in quality_filter(),
which keeps all columns of its input. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.llm.common import WHITE, grams, hashed_words, pieces, shielded, shielding, written

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Milder rules: symbols a word, share of repeated lines, share of words in repeated runs, mean word length.
MAX_SYMBOLS_PER_WORD, MAX_DUP_LINES, MAX_REPEAT_SHARE, WORD_LENGTH = 0.05, 0.1, 0.1, (2.5, 10.0)
SEVERE_SYMBOLS_PER_WORD, SEVERE_DUP_LINES = 0.2, 0.6
LIFT, FALSE_SHARE = 1.5, 0.05
PIECE_BYTES = 1 << 18  # of text measured at once: its arrays take some forty times as much
STEPS = 2000  # errors are ordered by so many steps
#: The normal distribution's tail, to 0.0002: 1 / (1 + exp(a z + b z ** 3)).
TAIL = (1.5976, 0.07056)
METRICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
ADDED = {*METRICS, "base_failed", "n_failed", "severe", "host_rate", "bad_host", "kept"}
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def measures(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The METRICS of each text."""
    words, first, _, _ = hashed_words(texts)
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum([len(x) + 1 for x in texts])
    begins = ends - [len(x) + 1 for x in texts]

    def count(flags: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return upto[ends] - upto[begins]

    out = {k: np.zeros(len(texts), np.int64) for k in METRICS}
    out["n_words"] = np.diff(first)
    out["word_chars"] = count(~WHITE[buf] & ((buf & 0xC0) != 0x80))
    out["n_symbols"] = count(_SYMBOL[buf])
    for i, text in enumerate(texts):
        lines = [x for x in text.split(b"\n") if x.strip()]
        out["n_lines"][i], out["n_dup_lines"][i] = len(lines), len(lines) - len(set(lines))
        windows = grams(words[first[i] : first[i + 1]], 3)
        _, inverse, times = np.unique(windows, return_inverse=True, return_counts=True)
        again = np.flatnonzero(times[inverse] > 1)
        if len(again):
            covered = np.zeros(len(windows) + 2, bool)
            covered[again] = covered[again + 1] = covered[again + 2] = True
            out["n_repeat_words"][i] = covered.sum()
    return out


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the METRICS as long columns."""
    docs = docs.drop(*(set(METRICS) - {text}))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(k, T.LongType()) for k in METRICS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, text, PIECE_BYTES):
                got = measures(texts)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(got[k]) for k in METRICS)], [*part.schema.names, *METRICS])

    return docs.mapInArrow(run, schema)


def judged(measures: DataFrame) -> DataFrame:
    """Adds base_failed, n_failed (rules failed) and severe."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    symbols = F.col("n_symbols") / words
    lines = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    fails = (symbols > MAX_SYMBOLS_PER_WORD, lines > MAX_DUP_LINES, F.col("n_repeat_words") / words > MAX_REPEAT_SHARE, ~(F.col("word_chars") / words).between(*WORD_LENGTH))
    severe = (symbols > SEVERE_SYMBOLS_PER_WORD) | (lines > SEVERE_DUP_LINES)
    return measures.withColumns({"base_failed": base, "n_failed": sum((f.cast("int") for f in (base, *fails)), F.lit(0)), "severe": severe})


def tail(z: Column) -> Column:
    """The probability that a normal deviate is over z."""
    return 1 / (1 + F.exp(z * TAIL[0] + z * z * z * TAIL[1]))


def host_rates(judged_docs: DataFrame, host: str = "source") -> DataFrame:
    """(host, n_docs, n_bad, rate, error, bad_host): rate is the posterior mean of the share of documents that fail a rule.

    Moments are weighted by documents. Only sums over hosts, and over hosts by step of error, reach the driver.
    """
    hosts = written(judged_docs.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("n_failed") > 0).alias("n_bad")), "hosts")
    sums = hosts.agg(F.coalesce(F.sum("n_bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"), F.count(F.lit(1)).alias("hosts")).first()
    docs = max(sums.docs, 1)
    mean = sums.bad / docs
    squares = hosts.agg(F.coalesce(F.sum(F.col("n_docs") * F.pow(F.col("n_bad") / F.col("n_docs") - mean, 2)), F.lit(0.0))).first()[0]
    noise = mean * (1 - mean)
    between = (squares - noise * sums.hosts) / docs
    if between <= 0:
        return hosts.select("host", "n_docs", "n_bad", F.lit(mean).alias("rate"), F.lit(1.0).alias("error"), F.lit(False).alias("bad_host"))
    strength = max(1.0, noise / between - 1)
    rate = (F.col("n_bad") + F.lit(strength * mean)) / (F.col("n_docs") + F.lit(strength))
    spread = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n_docs") + F.lit(strength + 1)))
    error = F.when(spread > 0, tail((F.col("rate") - LIFT * mean) / spread)).otherwise(1.0)
    scored = hosts.withColumn("rate", rate).withColumn("error", error)
    steps = scored.groupBy(F.floor(F.col("error") * STEPS).alias("step")).agg(F.sum("error").alias("errors"), F.count(F.lit(1)).alias("hosts")).orderBy("step").collect()  # STEPS + 1 rows
    upto, errors, called = -1, 0.0, 0
    for s in steps:
        errors, called = errors + s.errors, called + s.hosts
        upto = s.step if errors <= FALSE_SHARE * called else upto
    return scored.select("host", "n_docs", "n_bad", "rate", "error", (F.floor(F.col("error") * STEPS) <= upto).alias("bad_host"))


@shielding("__host")
def with_verdicts(judged_docs: DataFrame, rates: DataFrame, host: str = "source") -> DataFrame:
    """judged_docs with host_rate, bad_host and kept."""
    rates = rates.select(F.col("host").alias("__host"), F.col("rate").alias("host_rate"), "bad_host")
    out = judged_docs.drop("host_rate", "bad_host", "kept").join(rates, F.col(host).eqNullSafe(F.col("__host")), "left").drop("__host")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("severe") & ~((F.col("n_failed") > 0) & F.col("bad_host")))


def quality_filter(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents kept, with all their own columns. Texts are measured twice, for the rates and for the verdicts, so that
    they are neither written nor shuffled on the way."""
    inside, back = shielded(docs, ADDED - {text, host})
    rates = host_rates(judged(measured(inside.select(text, host), text)), host)
    return with_verdicts(judged(measured(inside, text)), rates, host).where("kept").drop(*(ADDED - {text, host})).withColumnsRenamed(back).select(docs.columns)
