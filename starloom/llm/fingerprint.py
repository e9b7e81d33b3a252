"""Document fingerprints from closed syncmers.

A k-mer of characters is a closed syncmer if the smallest hash among its inner s-mers stands at its first or its last
place. That depends on the k-mer alone, so equal passages yield equal anchors wherever they stand. A fingerprint is every
closed syncmer of the text with its place, in the order of places, as hex: about 1.9 digits for each character. Likeness
is exact on those: the longest run of anchors that both documents have in the same order, as a share of the anchors of
both (repeats count as often as the document has them that has more). Hashes are cut to 32 bits, so two unlike texts of
14,000 anchors each are expected to share 0.05 by chance.

Null text is empty; an empty text has the empty fingerprint, which is like itself (1) and unlike any other (0). A text
with no closed syncmer (shorter than k, say) has one anchor, itself. Equal texts have equal fingerprints. Rows that repeat
are fingerprinted alike. Extra columns stay; result columns replace input columns of the same name. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.llm.common import U, mix

K, S = 24, 8
RANGE_BYTES, MOST_RANGES = 4 << 20, 16_384
OUT_BYTES = 8 << 20  # of fingerprints in a result batch, or one row
_M = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0x27D4EB2F165667C5), U(0xD6E8FEB86659FD93)]


def hashes_of_s_mers(chars: np.ndarray) -> np.ndarray:
    """Hashes of all runs of S = 8 code points."""
    h1 = mix(chars.astype(np.uint64) + _M[0])
    h2 = h1[:-1] * _M[1] + h1[1:]
    h4 = h2[:-2] * _M[2] + h2[2:]
    return mix(h4[:-4] * _M[3] + h4[4:])


def closed_syncmers(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the closed syncmers (K, S) of a text given as code points."""
    n = len(chars) - K + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h8 = hashes_of_s_mers(chars)
    h16 = h8[:-8] * _M[4] + h8[8:]
    low = h8
    for step in (1, 2, 4, 8):
        low = np.minimum(low[:-step], low[step:])
    low = np.minimum(low[:-1], low[1:])[:n]  # over the K - S + 1 = 17 inner s-mers
    places = np.flatnonzero((h8[:n] == low) | (h8[K - S : K - S + n] == low))
    return mix(h16[places] * _M[1] + h8[places + 16]), places


def fingerprint(text: str) -> str:
    """All anchors as 8 hex digits of hash and 8 of place each, by place."""
    if not text:
        return ""
    hashes, places = closed_syncmers(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    if not len(hashes):
        return hashlib.sha256(text.encode()).hexdigest()[:8] + "00000000"
    pairs = np.empty((len(hashes), 2), ">u4")
    pairs[:, 0], pairs[:, 1] = hashes >> U(32), places
    return pairs.tobytes().hex()


def likeness(a: str, b: str) -> float:
    """0 to 1: the longest run of anchors that both have in the same order, as a share of the anchors of both."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(m), ">u4")[::2].astype(np.uint32) for m in (a, b))
    total, alike = len(x) + len(y), 0
    for way in (1, -1):  # equal ends belong to a longest run
        n = min(len(x), len(y))
        differ = x[::way][:n] != y[::way][:n]
        same = int(differ.argmax()) if differ.any() else n
        alike += same
        x, y = (x[same:], y[same:]) if way == 1 else (x[: len(x) - same], y[: len(y) - same])
    x, y = x[np.isin(x, y)], y[np.isin(y, x)]
    if not len(x):
        return alike / (total - alike)
    known, numbers = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y = numbers[: len(x)], numbers[len(x) :]
    each_x, each_y = np.bincount(x, minlength=len(known)), np.bincount(y, minlength=len(known))
    both = alike + int(np.minimum(each_x, each_y).sum())
    if len(x) < len(y):
        x, y, each_x, each_y = y, x, each_y, each_x
    meetings = int((each_x.astype(np.int64) * each_y).sum())
    alike += _by_meetings(x, y, each_x) if meetings <= len(y) * (2 + len(x) // 4096) else _by_bits(x, y)
    return alike / (total - both)


def _by_meetings(x: np.ndarray, y: np.ndarray, each_x: np.ndarray) -> int:
    """Longest common subsequence, in time by the number of equal pairs: fast where anchors hardly repeat."""
    by_number = np.argsort(x, kind="stable")[::-1].tolist()  # places of each anchor, last first
    stop = (len(x) - np.cumsum(each_x) + each_x).tolist()
    many = each_x.tolist()
    ends: list[int] = []
    for c in y.tolist():
        for place in by_number[stop[c] - many[c] : stop[c]]:
            at = bisect_left(ends, place)
            ends[at : at + 1] = [place]
    return len(ends)


def _by_bits(x: np.ndarray, y: np.ndarray) -> int:
    """Longest common subsequence with a bit for each anchor of x: as exact where anchors repeat often."""
    full = (1 << len(x)) - 1

    @lru_cache(1 + (1 << 28) // len(x))
    def places(c: int) -> int:
        return int.from_bytes(np.packbits(x == c, bitorder="little").tobytes(), "little")

    row = full
    for c in y.tolist():
        met = row & places(c)
        row = ((row + met) | (row ^ met)) & full
    return len(x) - row.bit_count()


def edited(text: str, following: str) -> str:
    """text with its last third replaced by as many first characters of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def with_fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the column fingerprint."""
    docs = docs.drop(*({"fingerprint"} - {text}))
    schema = T.StructType([*docs.schema.fields, T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = size = 0
            marks: list[str] = []
            for i, t in enumerate(batch.column(text), 1):
                marks.append(fingerprint(t.as_py() or ""))
                size += len(marks[-1])
                if size >= OUT_BYTES or i == batch.num_rows:
                    part = batch.slice(start, len(marks))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(marks, pa.string())], [*batch.schema.names, "fingerprint"])
                    start, size, marks = i, 0, []

    return docs.mapInArrow(run, schema)


def range_cuts(docs: DataFrame, text: str, key: str, range_bytes: int, most: int = MOST_RANGES) -> list[int]:
    """Ids that cut the documents into ranges of about range_bytes of text, most ranges at most."""
    grid = docs.agg(F.percentile_approx(F.col(key).cast("long"), [i / most for i in range(1, most)], 10 * most).alias("ids"), F.coalesce(F.sum(F.octet_length(F.col(text)).cast("long")), F.lit(0)).alias("bytes")).first()
    ranges = max(1, min(most, -(-grid.bytes // range_bytes)))
    return sorted({grid.ids[i * most // ranges - 1] for i in range(1, ranges)}) if grid.ids else []


def _range_of(key: Column, cuts: list[int]) -> Column:
    """How many cuts are larger than the key, by bisection."""
    if not cuts:
        return F.lit(0)
    table, start = F.array(*map(F.lit, cuts)).cast("array<bigint>"), F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        larger = F.get(table, middle) > key
        return F.when(at["low"] >= at["high"], at).otherwise(F.struct(F.when(larger, at["low"]).otherwise(middle + 1).alias("low"), F.when(larger, middle).otherwise(at["high"]).alias("high")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length())), start, halve, lambda at: F.lit(len(cuts)) - at["low"])


def _prefix(text: Column) -> Column:
    """The first seven bytes of a text as a number, in the order of texts."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(text, "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long")


def crowded_ids(slim: DataFrame, cuts: list[int], range_bytes: int, most: int = MOST_RANGES) -> dict[int | None, list[int]]:
    """Ids that hold more than one range of text (null is one that may), each with the prefixes that cut its texts.

    Such an id is a cut itself, so only cuts and null are looked at.
    """
    own = slim.where(F.col("doc_id").isin(cuts) | F.col("doc_id").isNull()) if cuts else slim.where(F.col("doc_id").isNull())
    sizes = own.groupBy("doc_id").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes")).where(F.col("bytes") > range_bytes).collect()
    out: dict[int | None, list[int]] = {}
    for r in sizes:  # fewer than there are ranges
        n = min(most, -(-r.bytes // range_bytes))
        grid = own.where(F.col("doc_id").eqNullSafe(F.lit(r.doc_id))).agg(F.percentile_approx(_prefix(F.col("text")), [i / n for i in range(1, n)], 10 * n)).first()[0]
        out[r.doc_id] = sorted(set(grid or []))
    return {k: v for k, v in out.items() if v}


def next_to_each_other(docs: DataFrame, text: str, key: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, text, bucket, extra), sorted in each partition so that a document is followed by the one of next smaller id.

    Ids are cut into ranges of about range_bytes of text, each a partition of its own, so texts are shuffled once and never
    sorted as a whole. An id that holds more than a range is cut further, by how its texts begin. The first document of a
    range is also sent, as extra, to the range above it, where it follows the last; the largest id follows the smallest.
    """
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cuts = range_cuts(slim, "text", "doc_id", range_bytes)
    crowded = crowded_ids(slim, cuts, range_bytes)
    # ranges of ids, each followed by the further ranges of the crowded id that is its smallest
    more = {len(cuts) + 1 if i is None else sum(c > i for c in cuts): len(prefixes) for i, prefixes in crowded.items()}
    starts, upto = [], 0
    for bucket in range(len(cuts) + 2):
        starts.append(upto)
        upto += 1 + more.get(bucket, 0)
    within = F.lit(0)
    for i, prefixes in crowded.items():
        begins = F.size(F.filter(F.array(*map(F.lit, prefixes)), lambda p: p <= _prefix(F.col("text"))))
        within = F.when(F.col("doc_id").eqNullSafe(F.lit(i)), begins).otherwise(within)
    bucket = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(_range_of(F.col("doc_id"), cuts)).cast("int")
    placed = slim.withColumn("bucket", (F.get(F.array(*map(F.lit, starts)), bucket) + within).cast("int"))
    first = F.max(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", (-_prefix(F.col("text"))).alias("prefix"))).alias("head")
    heads = sorted((r.bucket, r.head.doc_id, -r.head.prefix) for r in placed.groupBy("bucket").agg(first).collect())  # a row a range
    before = [(head, prefix, heads[i - 1][0]) for i, (_, head, prefix) in enumerate(heads)]
    known = slim.sparkSession.createDataFrame(before, "head long, prefix long, bucket int")
    own = slim.where(F.col("doc_id").isin([h for h, *_ in before if h is not None]) | (F.col("doc_id").isNull() if None in {h for h, *_ in before} else F.lit(False)))
    same = F.col("doc_id").eqNullSafe(F.col("head")) & (_prefix(F.col("text")) == F.col("prefix"))
    extra = own.join(F.broadcast(known), same).select("doc_id", "text", "bucket", F.lit(1).alias("extra"))  # a row a range
    both = placed.withColumn("extra", F.lit(0)).unionByName(extra)
    return both.repartitionById(upto, "bucket").sortWithinPartitions("bucket", "extra", F.col("doc_id").desc_nulls_last(), "text")


def compared_to_next(docs: DataFrame, text: str = "text", key: str = "doc_id", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each document.

    The next document has the next smaller id (after the smallest comes the largest; a null id is smaller than any; among
    equal ids the order is that of the texts).
    """
    rows = next_to_each_other(docs, text, key, range_bytes)

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        columns = list(zip(*out, strict=True)) or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # document waiting for the next: bucket, id, text, fingerprint
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for doc_id, one, bucket, extra in zip(*(batch.column(i) for i in range(4)), strict=True):
                bucket, body = bucket.as_py(), one.as_py()
                follows = held is not None and held[0] == bucket
                if extra.as_py() and not follows:
                    continue  # only the first of the next range's documents is needed
                mark = fingerprint(body)
                if follows:
                    _, its_id, its_text, its_mark = held
                    changed = edited(its_text, body)
                    new = fingerprint(changed)
                    out.append((its_id, len(its_text), hashlib.sha256(changed.encode()).hexdigest(), its_mark, new, likeness(its_mark, new), likeness(its_mark, mark)))
                    size += len(its_mark) + len(new)
                    if size >= OUT_BYTES:
                        yield rows_of(out)
                        out, size = [], 0
                held = None if extra.as_py() else (bucket, doc_id.as_py(), body, mark)
            yield rows_of(out)

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
