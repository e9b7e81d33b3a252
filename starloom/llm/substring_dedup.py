"""Removal of repeated passages: matching statistics over compressed FM-indexes, one per shard.

A window is WINDOW consecutive words. Every window picks an anchor, the run of GRAM words in it with the smallest hash
(leftmost if equal); equal windows pick equal anchors, so all that could match meets under one anchor. Neighbouring
windows with the same anchor form a segment. Anchors seen once in the corpus can't repeat and end here. Of the others,
equal segments are counted and shipped once, with their count, to the shard of their anchor. A shard builds the compressed
FM-index of its segments, streams the documents' segments through backward search, and reports the stretches that stand at
least twice for WINDOW words or more; these are mapped back to all places of the segment, and every word covered is removed.

An anchor with more than HOT distinct segments (the edge of a passage that very many documents share) is not sent to one
shard: its segments are cut into single windows, equal windows are counted, and each distinct window goes to a shard of
its own hash. That is the same search on finer pieces, exact as well, and no shard grows with the passage.

Null or empty texts have no words; texts shorter than a window lose nothing. Windows are judged on the input. Rows are told
apart by id and text: rows repeated as a whole count as often as they stand, and are treated alike; the work grows in
proportion to their number. Very long texts are read whole. Extra columns stay; result columns (n_words, n_removed) replace input columns of the same name. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.llm.common import Scratch, U, _powers, grams, hashed_words, mix, pieces, shielding, text_of
from starloom.llm.fm_index import FmIndex

WINDOW, GRAM = 35, 8
HOT = 20_000
SHARD_WORDS = 400_000
_HIGH, _LOW = U(0xFFFFFFFF00000000), U(0xFFFFFFFF)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: -(width - done)], x[width - done :]) if width > done else x


def segments(words: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchor hash, hash of the segment's words, first word, and number of words of each segment of a text."""
    if len(words) < window:
        return (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    hashes = grams(words, gram)
    place = (sliding_min((hashes & _HIGH) | np.arange(len(hashes), dtype=np.uint64), window - gram + 1) & _LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    size = np.diff(np.append(first, len(place))) + window - 1
    up, down = _powers(len(words))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)])])
    content = mix((sums[first + size] - sums[first]) * down[first] + size.astype(np.uint64))
    return hashes[place[first]], content, first, size


def segment_table(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(row1, row2, text) to one row a segment: anchor, content, row1, row2, first, size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                words, first, _, _ = hashed_words(texts)
                got = [segments(words[a:b], window, gram) for a, b in zip(first[:-1], first[1:], strict=True)]
                counts = [len(g[0]) for g in got]
                anchor, content, start, size = (np.concatenate([g[i] for g in got]) for i in range(4))
                rows = [np.repeat(part.column(c).to_numpy(), counts) for c in ("row1", "row2")]
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), *map(pa.array, rows), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))], ["anchor", "content", "row1", "row2", "first", "size"])

    return docs.select("row1", "row2", "text").mapInArrow(run, "anchor long, content long, row1 long, row2 long, first int, size int")


def extracted(docs: DataFrame, window: int) -> DataFrame:
    """(text, parts: array of (anchor, content, first, size, n, hot)) to one row a segment, or a window of a hot one.

    k1, k2: key of the piece. n: times it stands. words: its text. anchor, content, offset: the segment it is cut from.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                out: list[tuple] = []
                for text, wanted in zip(texts, part.column("parts").to_pylist(), strict=True):
                    words = text.split()
                    hashes = hashed_words([text])[0] if any(p["hot"] for p in wanted) else None
                    for p in wanted:
                        a, b = p["first"], p["first"] + p["size"]
                        if not p["hot"]:
                            out.append((p["anchor"], p["content"], p["n"], b" ".join(words[a:b]), p["anchor"], p["content"], 0, False))
                            continue
                        runs = grams(hashes[a:b], window)
                        other = mix(grams(hashes[a:b] ^ U(0x9E3779B97F4A7C15), window))
                        for j, (x, y) in enumerate(zip(runs.view(np.int64).tolist(), other.view(np.int64).tolist(), strict=True)):
                            out.append((x, y, p["n"], b" ".join(words[a + j : a + j + window]), p["anchor"], p["content"], j, True))
                if out:
                    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["k1", "k2", "n", "words", "anchor", "content", "offset", "hot"])

    return docs.select("text", "parts").mapInArrow(run, "k1 long, k2 long, n long, words binary, anchor long, content long, offset int, hot boolean")


def repeated_stretches(shard: pa.Table, window: int) -> pa.Table:
    """k1, k2, first, size: the stretches of each piece that stand at least twice, window words or more."""
    rows = shard.column("words").to_pylist()
    split = [r.split(b" ") for r in rows]
    sizes = np.array([len(x) for x in split])
    codes, _ = pd.factorize(np.array([w for x in split for w in x], dtype=object))
    ends = np.cumsum(sizes + 1) - 1
    text = np.zeros(ends[-1] + 1, np.int64)
    inside = np.ones(len(text), bool)
    inside[ends] = False
    text[inside] = codes + 1
    matched = FmIndex(text, shard.column("n").to_numpy()).matching_statistics(text)
    long = np.flatnonzero(matched >= window)
    segment = np.searchsorted(ends, long)
    first = long - (ends[segment] - sizes[segment])
    size = matched[long]
    # a stretch that ends no later than the one before it in the same segment lies inside it
    inner = np.zeros(len(long), bool)
    inner[1:] = (segment[1:] == segment[:-1]) & (long[1:] + size[1:] <= long[:-1] + size[:-1])
    picked = ~inner
    k1, k2 = (shard.column(c).to_numpy()[segment[picked]] for c in ("k1", "k2"))
    return pa.table({"k1": k1, "k2": k2, "first": first[picked].astype(np.int32), "size": size[picked].astype(np.int32)})


@shielding("__r1", "__r2", "__row1", "__row2", "__spots")
def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, gram: int = GRAM, hot: int = HOT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs with the words that stay, joined by one space, as text; n_words before and n_removed."""
    docs = docs.drop(*({"n_words", "n_removed"} - {text, key}))
    scratch = Scratch(docs.sparkSession, "repeats")
    row1, row2 = F.xxhash64(F.col(key), text_of(text), F.lit(1)), F.xxhash64(F.lit(2), text_of(text))
    slim = docs.select(row1.alias("row1"), row2.alias("row2"), text_of(text).alias("text"))
    table = segment_table(slim, window, gram)
    # tables that meet a skewed side are written first: Spark splits hot keys of a join with a table, not with an aggregate
    again = scratch.write(table.groupBy("anchor").agg(F.count(F.lit(1)).alias("seen")).where("seen > 1").select("anchor"), "anchors")
    places = scratch.write(table.join(again, "anchor"), "segments")

    distinct = places.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row1", "row2", "first", "size")).alias("one"))
    distinct = scratch.write(distinct.select("anchor", "content", "n", "one.*"), "distinct-segments")
    crowded = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > hot).select("anchor", F.lit(True).alias("hot"))
    wanted = distinct.join(scratch.write(crowded, "crowded"), "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    parts = scratch.write(wanted.groupBy("row1", "row2").agg(F.collect_list(F.struct("anchor", "content", "first", "size", "n", "hot")).alias("parts")), "parts")
    # rows repeated as a whole are all cut; what they give is alike, and counts once below
    cut = scratch.write(extracted(slim.join(parts, ["row1", "row2"]), window), "pieces")

    total = distinct.agg(F.coalesce(F.sum(F.col("size").cast("long")), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_words))
    place = F.struct("anchor", "content", "offset")
    # the search only asks whether a run stands twice, so 2 stands for any larger number
    twice = (F.max("n") > 1) | (F.min(place) != F.max(place))
    pieces_ = cut.groupBy("k1", "k2").agg(F.when(twice, 2).otherwise(1).cast("long").alias("n"), F.first("words").alias("words"))
    pieces_ = pieces_.withColumn("shard", F.pmod(F.xxhash64("k1"), F.lit(shards)))
    found = pieces_.groupBy("shard").applyInArrow(lambda t: repeated_stretches(t, window), "k1 long, k2 long, first int, size int")
    found = scratch.write(found, "stretches")
    of_segment = cut.select("k1", "k2", "anchor", "content", "offset").distinct().join(found, ["k1", "k2"])
    of_segment = scratch.write(of_segment.select("anchor", "content", (F.col("first") + F.col("offset")).alias("from"), F.col("size").alias("length")), "stretches-of-segments")
    spots = places.join(of_segment, ["anchor", "content"]).select("row1", "row2", (F.col("first") + F.col("from")).alias("from"), "length")
    spots = spots.groupBy(F.col("row1").alias("__row1"), F.col("row2").alias("__row2")).agg(F.collect_set(F.struct("from", "length")).alias("__spots"))
    spots = scratch.write(spots, "spots")
    scratch.keep_only(spots)
    own = docs.withColumns({"__r1": row1, "__r2": row2})
    marked = own.join(spots, (F.col("__r1") == F.col("__row1")) & (F.col("__r2") == F.col("__row2")), "left").drop("__r1", "__r2", "__row1", "__row2")
    return without_spots(marked, text)


def without_spots(docs: DataFrame, text: str) -> DataFrame:
    names = [c for c in docs.columns if c != "__spots"]
    schema = T.StructType([*(T.StructField(f.name, T.StringType()) if f.name == text else f for f in docs.schema.fields if f.name != "__spots"), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, text):
                kept, total, removed = [], [], []
                for body, spots in zip(texts, part.column("__spots").to_pylist(), strict=True):
                    words = body.split()
                    total.append(len(words))
                    if spots:
                        edge = np.zeros(len(words) + 1, np.int64)
                        first = np.array([s["from"] for s in spots])
                        np.add.at(edge, first, 1)
                        np.add.at(edge, first + np.array([s["length"] for s in spots]), -1)
                        stay = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
                        words = [words[i] for i in stay.tolist()]
                    removed.append(total[-1] - len(words))
                    kept.append(b" ".join(words).decode())
                columns = [pa.array(kept, pa.string()) if c == text else part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], [*names, "n_words", "n_removed"])

    return docs.mapInArrow(run, schema)
