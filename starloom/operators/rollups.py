"""Aggregates over frames: statistics of objects and contributors, summaries, ordered lists and inventory hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from starloom.functions.maths import half_up


def eligible() -> Column:
    """Frames that may enter a stack."""
    return F.col("status").isin("approved", "published", "stacked") & ~F.col("rejected")


def eligible_source(band: str) -> Column:
    """Archive lights fit for a public survey of a band: published, solved, alive, of an open licence, with path, checksum, credit and terms."""
    c = F.col
    flags = (c("source_kind") == "public_archive") & (c("kind") == "light") & (c("status") == "published") & ~c("rejected") & c("solved") & c("deleted_at").isNull()
    named = (c("licence") == "PUBLIC-ARCHIVE") & (F.lower(F.coalesce("band", F.lit(""))) == band.lower())
    there = c("storage_path").isNotNull() & c("content_sha256").rlike("^[0-9a-f]{64}$") & c("attribution").isNotNull() & c("rights").isNotNull() & (c("size_bytes") > 0)
    return flags & named & there


def object_stats(frames: DataFrame) -> DataFrame:
    """Counts by kind, contributors and exposure hours of each object's eligible frames."""
    kinds = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("light", "dark", "flat", "bias")]
    hours = F.coalesce(F.sum(F.when(F.col("kind") == "light", F.col("exposure_s"))), F.lit(0.0)) / 3600
    return frames.where(eligible()).groupBy("object_id").agg(*kinds, F.count_distinct("user_id").alias("contributors"), hours.alias("exposure_hours"))


def contributions(frames: DataFrame) -> DataFrame:
    """A row for each contributor and object."""
    return frames.where(eligible() & F.col("user_id").isNotNull()).groupBy("user_id", "object_id").agg(
        F.count(F.lit(1)).alias("n_frames"),
        F.sum("exposure_s").alias("exposure_s"),
        F.avg("quality").alias("quality"),
        F.min("uploaded_at").alias("first_at"),
        F.max("uploaded_at").alias("last_at"),
    )


def top_contributors(frames: DataFrame, per_object: int) -> DataFrame:
    """The contributors of the longest exposure of each object."""
    order = W.partitionBy("object_id").orderBy(F.col("exposure_s").desc(), "user_id")
    ranked = contributions(frames).withColumn("place", F.row_number().over(order))
    return ranked.where(F.col("place") <= per_object).select("object_id", "place", "user_id", "exposure_s", "n_frames")


def recommendations(frames: DataFrame, objects: DataFrame, user_id: int, limit: int) -> DataFrame:
    """Objects that a user hasn't contributed to, by need: lights for each contributor, and missing darks and flats."""
    stats = object_stats(frames)
    mine = frames.where(F.col("user_id") == user_id).select("object_id")
    need = F.col("n_light") / F.greatest(F.col("contributors"), F.lit(1)) + F.when(F.col("n_dark") < 50, 50).otherwise(0) + F.when(F.col("n_flat") < 50, 30).otherwise(0)
    open_ = stats.join(mine, "object_id", "left_anti").join(objects.select("object_id", "name"), "object_id")
    return open_.select("object_id", "name", need.alias("need")).orderBy(F.col("need").desc(), "object_id").limit(limit)


def qualification(frames: DataFrame) -> DataFrame:
    """Progress of each run in one pass."""
    return frames.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(eligible()).alias("accepted"),
        F.count_if(F.col("rejected")).alias("rejected_frames"),
        F.count_if((F.col("status") == "approved") & ~F.col("rejected")).alias("active"),
        F.max("uploaded_at").alias("last_at"),
    )


def ordered_frames(frames: DataFrame) -> DataFrame:
    """Ids of each object's lights and darks, best first."""
    def ids(kind: str) -> Column:
        rows = F.collect_list(F.when(F.col("kind") == kind, F.struct((-F.col("quality")).alias("q"), "uploaded_at", "frame_id")))
        return F.array_join(F.transform(F.array_sort(rows), lambda r: r["frame_id"]), ",")

    return frames.where(eligible()).groupBy("object_id").agg(ids("light").alias("lights"), ids("dark").alias("darks"))


def streamed_sha256(rows: DataFrame, keys: list[str], item: str, order: list[str], head: str = "", between: str = "", tail: str = "") -> DataFrame:
    """keys, n and the SHA-256 over each key's items in order, joined as head + items between + tail.

    Rows are dealt by key and sorted; each task feeds its items to the hash one after the other as they stream by, so a key
    of any size takes no memory and is never gathered in one value.
    """
    slim = rows.select(*keys, *(F.col(c).alias(f"__o{i}") for i, c in enumerate(order)), F.col(item).cast("string").alias("__item"))
    dealt = slim.repartition(*keys).sortWithinPartitions(*keys, *(f"__o{i}" for i in range(len(order)))).select(*keys, "__item")
    schema = T.StructType([*dealt.schema.fields[:-1], T.StructField("n", T.LongType()), T.StructField("sha256", T.StringType())])
    types = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, hasher = None, 0, None
        done: list[tuple] = []

        def close() -> None:
            if now is not None:
                hasher.update(tail.encode())
                done.append((*now, n, hasher.hexdigest()))

        for batch in batches:
            own = list(zip(*(c.to_pylist() for c in batch.columns[:-1]), strict=True))
            for key, group in groupby(zip(own, batch.column(batch.num_columns - 1).to_pylist(), strict=True), key=itemgetter(0)):
                items = [x for _, x in group]
                if key != now:
                    close()
                    now, n, hasher = key, 0, hashlib.sha256(head.encode())
                hasher.update(((between if n else "") + between.join(items)).encode())
                n += len(items)
            if len(done) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types.types, strict=True)], schema=types)
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types.types, strict=True)], schema=types)

    return dealt.mapInArrow(run, schema)


def inventory_hashes(frames: DataFrame) -> DataFrame:
    """SHA-256 over each object's sorted frame ids, one a line; the order of rows doesn't matter."""
    return streamed_sha256(frames.where(eligible()), ["object_id"], "frame_id", ["frame_id"], between="\n").withColumnRenamed("n", "n_frames")


def status_map(frames: DataFrame) -> DataFrame:
    """Frames by status as one text for each run: status=count, by status."""
    counts = frames.groupBy("run_id", "status").agg(F.count(F.lit(1)).alias("n"))
    entry = F.concat_ws("=", "status", F.col("n").cast("string"))
    return counts.groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("statuses"), F.sum("n").alias("total"))


def distinct_kinds(frames: DataFrame) -> DataFrame:
    return frames.groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.count_distinct("object_id", "user_id").alias("pairs"))


def totals(stats: DataFrame) -> DataFrame:
    return stats.agg(F.sum("n_light").alias("lights"), F.sum("contributors").alias("contributors"), half_up(F.sum("exposure_hours"), 6).alias("hours"), F.count_if(F.col("n_light") >= 3).alias("stackable"))


def calibration_completeness(stats: DataFrame) -> DataFrame:
    """Mean of four threshold flags: lights, darks, flats and bias frames."""
    flags = [(F.col(f"n_{k}") >= n).cast("double") for k, n in (("light", 5), ("dark", 3), ("flat", 2), ("bias", 1))]
    return stats.select("object_id", (sum(flags[1:], flags[0]) / 4).alias("completeness"))


def first_of_each(frames: DataFrame, key: str) -> DataFrame:
    """The earliest frame of each key."""
    one = frames.groupBy(key).agg(F.min(F.struct("uploaded_at", "frame_id", "user_id")).alias("r"))
    return one.select(key, "r.frame_id", "r.uploaded_at", "r.user_id")


def within_budget(frames: DataFrame, seconds: float) -> DataFrame:
    """Frames of each run, best first, until the exposure budget is spent."""
    before = W.partitionBy("run_id").orderBy(F.col("quality").desc(), "frame_id").rowsBetween(W.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("exposure_s").over(before), F.lit(0.0))
    return frames.withColumn("spent_s", spent).where(F.col("spent_s") + F.col("exposure_s") <= seconds).select("run_id", "frame_id", "exposure_s", "spent_s")


def duplicates(frames: DataFrame) -> DataFrame:
    """Frames with the same object, contributor and exposure as an earlier one, with that one's id."""
    order = W.partitionBy("object_id", "user_id", "exposure_s").orderBy("uploaded_at", "frame_id")
    marked = frames.withColumn("original", F.first("frame_id").over(order))
    return marked.where(F.col("original") != F.col("frame_id")).select("frame_id", "original")
