"""Structured Streaming over the observation log: sliding counts, correlation on arrival, counters, idempotence, leases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.functions.geo import cells_around, place_cell, place_vector, within_km
from starloom.sources.storage import scratch

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event files as a stream; event time as a timestamp, which watermarks need."""
    files = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    return files.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Runs an append-mode stream over all that is there, into Parquet, and reads it back."""
    spark = stream.sparkSession
    out = scratch(spark, name)
    stream.writeStream.format("parquet").option("checkpointLocation", scratch(spark, f"{name}-state")).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def latest(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Runs an update-mode aggregate; of each key the row of the last batch. A batch that is tried again replaces itself."""
    spark = stream.sparkSession
    out = scratch(spark, name)

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/n={batch_id}")

    stream.writeStream.foreachBatch(save).option("checkpointLocation", scratch(spark, f"{name}-state")).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])
    rows = spark.read.schema(schema).parquet(f"{out}/n=*")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(*keys, *(f"r.{c}" for c in rest))


def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type in windows of two hours, one every half hour."""
    rows = event_stream(spark, sf_dir).withWatermark("ts", "3 hours").groupBy(F.window("ts", "2 hours", "30 minutes"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    flat = rows.select(F.col("window.start").alias("from_at"), F.col("window.end").alias("to_at"), "event_type", "n", "total")
    out = latest(flat, "sliding", ["from_at", "to_at", "event_type"])
    return out.select(F.col("from_at").cast("timestamp_ntz").alias("from_at"), F.col("to_at").cast("timestamp_ntz").alias("to_at"), "event_type", "n", F.expr("floor(total * 100 + 0.5) / 100").alias("total"))


def observation_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream as located observations."""
    e, u = F.col("event_id"), F.col("user_id")
    places = {"latitude": (u * 37) % 100 / 10.0 + 42.0 + (e % 7) / 100.0, "longitude": (u * 53) % 120 / 10.0 + (e % 11) / 100.0}
    return event_stream(spark, sf_dir).withColumns(places)


WINDOW_S, RADIUS_KM = 900, 500.0


def correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of errors and purchases of different users within 15 minutes and 500 km: an interval join, batch by batch.

    Each batch is joined with itself and with what the batches before left: the rows at most two windows older than the newest,
    one for rows that come late and one for the interval. That table is all the state, and is written anew for each batch.
    Batches meet as tables and not in a state store, which looks up each pair that meets by itself. The join's key is time
    bucket and place cell: an error stands in its own bucket and in all cells that the radius reaches, a purchase in its own
    cell and in three buckets, so each pair meets once and a key holds a quarter of an hour of one cell.
    """
    out, kept = scratch(spark, "correlated"), scratch(spark, "correlated-last")
    bucket, lat, lon = F.floor(F.col("at") / (WINDOW_S * 1_000_000)), F.col("latitude"), F.col("longitude")
    names = ["event_id", "user_id", "at", "fresh", "latitude", "longitude"]
    batches: list[int] = []

    def side(rows: DataFrame, kind: str, name: str, keys: dict[str, Column]) -> DataFrame:
        own = rows.where(F.col("event_type") == kind).select(*names).withColumns(place_vector(lat, lon))
        for key, values in keys.items():
            own = own.withColumn(key, values)
        return own.withColumnsRenamed({c: f"{name}_{c}" for c in own.columns})

    def meet(batch: DataFrame, batch_id: int) -> None:
        rows = batch.where(F.col("event_type").isin("error", "purchase")).select("event_type", *names)
        if batch_id:
            before = batch.sparkSession.read.schema(rows.schema).parquet(f"{kept}/n={batch_id - 1}")
            rows = rows.unionByName(before.withColumn("fresh", F.lit(False)))
        a = side(rows, "error", "a", {"bucket": bucket, "cell": F.explode(cells_around(lat, lon, RADIUS_KM))})
        b = side(rows, "purchase", "b", {"bucket": F.explode(F.array(bucket - 1, bucket, bucket + 1)), "cell": place_cell(lat, lon)})
        keys = (F.col("a_bucket") == F.col("b_bucket")) & (F.col("a_cell") == F.col("b_cell"))
        near = (F.abs(F.col("a_at") - F.col("b_at")) <= WINDOW_S * 1_000_000) & (F.col("a_user_id") != F.col("b_user_id")) & (F.col("a_fresh") | F.col("b_fresh"))
        # the larger part of a batch is what its pairs are, not its rows: always dealt by the key, however small the rows are
        met = a.join(b.hint("merge"), keys & near & within_km(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"), RADIUS_KM))
        met.select(F.col("a_event_id").alias("a_id"), F.col("b_event_id").alias("b_id")).write.mode("overwrite").parquet(f"{out}/n={batch_id}")
        newest = rows.agg(F.max("at")).first()[0]
        rows.where(F.col("at") >= F.lit(newest).cast("long") - 2 * WINDOW_S * 1_000_000).write.mode("overwrite").parquet(f"{kept}/n={batch_id}")
        batches.append(batch_id)

    stream = observation_stream(spark, sf_dir).withColumns({"at": F.unix_micros("ts"), "fresh": F.lit(True)})
    stream.writeStream.foreachBatch(meet).option("checkpointLocation", scratch(spark, "correlated-state")).trigger(availableNow=True).start().awaitTermination()
    pairs = "a_id long, b_id long"
    return spark.read.schema(pairs).parquet(f"{out}/n=*") if batches else spark.createDataFrame([], pairs)


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of each user, kept up as events arrive."""
    rows = event_stream(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("event_type") == "click").alias("n_clicks"), F.max("event_id").alias("last_id"))
    return latest(rows, "counters", ["user_id"])


def once_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events sent twice, taken once by their key."""
    twice = event_stream(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("key", F.concat_ws(":", "event_type", F.col("event_id").cast("string")))
    return drained(twice.withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["key"]).select("key", "event_id"), "once")


LEASE_S = 6 * 3600
LEVEL = 50.0


def all_sessions(sessions_: DataFrame, name: str) -> DataFrame:
    """Sessions that have ended and those still open at the end: complete mode, a folder for each batch, of which the last counts."""
    spark = sessions_.sparkSession
    out = scratch(spark, name)
    batches: list[int] = []

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/n={batch_id}")
        batches.append(batch_id)

    sessions_.writeStream.foreachBatch(save).option("checkpointLocation", scratch(spark, f"{name}-state")).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(sessions_.schema).parquet(f"{out}/n={max(batches)}") if batches else spark.createDataFrame([], sessions_.schema)


def leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as heartbeats of users: how often each user's lease was renewed in time or had expired.

    A lease is a session with the lease's time as its gap: beats inside it renew it, and every session but a user's first
    began after an expiry. (Spark also merges a beat that comes just as the gap ends, so the gap ends between whole seconds.) State is what Spark keeps of open sessions; no Python runs.
    """
    held = event_stream(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.unix_seconds("ts"))).groupBy("user_id", F.session_window("ts", f"{LEASE_S} seconds 500 milliseconds")).agg(F.count(F.lit(1)).alias("beats"))
    each = all_sessions(held.select("user_id", F.col("session_window.start").alias("from_at"), "beats"), "leases")
    return each.groupBy("user_id").agg((F.sum("beats") - F.count(F.lit(1))).alias("renewed"), (F.count(F.lit(1)) - 1).alias("expired"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user with gaps below four hours, closed ones and those still open at the end."""
    rows = event_stream(spark, sf_dir).groupBy("user_id", F.session_window("ts", "3 hours 59 minutes 59 seconds 999 milliseconds 999 microseconds")).agg(F.count(F.lit(1)).alias("n"))
    flat = rows.select("user_id", F.col("session_window.start").alias("from_at"), "n")
    return all_sessions(flat, "sessions").withColumn("from_at", F.col("from_at").cast("timestamp_ntz"))


def crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each user's value rises over a level: the event with the one before it.

    Batches come in the order of time. Each is compared row by row with a window, together with the last row of each user
    that the batches before left: that table, one row a user, is all the state, and is written anew for each batch.
    """
    out, kept = scratch(spark, "crossings"), scratch(spark, "crossings-last")

    def pair(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("user_id", "ts", "event_id", "value")
        before = f"{kept}/n={batch_id - 1}"
        if batch_id:
            rows = rows.unionByName(batch.sparkSession.read.schema(rows.schema).parquet(before))
        own = W.partitionBy("user_id").orderBy("ts", "event_id")
        pairs = rows.withColumns({"before": F.lag("value").over(own), "before_id": F.lag("event_id").over(own)})
        pairs.where((F.col("before") < LEVEL) & (F.col("value") >= LEVEL)).select("user_id", "before_id", "event_id").write.mode("overwrite").parquet(f"{out}/n={batch_id}")
        rows.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "value")).alias("r")).select("user_id", "r.ts", "r.event_id", "r.value").write.mode("overwrite").parquet(f"{kept}/n={batch_id}")

    event_stream(spark, sf_dir).writeStream.foreachBatch(pair).option("checkpointLocation", scratch(spark, "crossings-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id long, before_id long, event_id long").parquet(f"{out}/n=*")


def polled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each kind as a poll sees it: each batch replaces what it renews."""
    rows = event_stream(spark, sf_dir).groupBy("event_type").agg(F.max(F.struct("ts", "event_id")).alias("r"), F.count(F.lit(1)).alias("n"))
    flat = rows.select("event_type", F.col("r.ts").alias("last_at"), F.col("r.event_id").alias("last_id"), "n")
    return latest(flat, "polled", ["event_type"]).withColumn("last_at", F.col("last_at").cast("timestamp_ntz"))


def backfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts of which some days were lost: those that are missing are counted again from the log."""
    log = spark.read.schema(SCHEMA).parquet(f"{sf_dir}/events.parquet").withColumn("day", F.to_date("ts"))
    there = log.where(F.dayofmonth("day") % 3 != 0).groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    again = log.join(there.select("day"), "day", "left_anti").groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    both = there.withColumn("origin", F.lit("kept")).unionByName(again.withColumn("origin", F.lit("replayed")))
    return both.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n", "origin")
