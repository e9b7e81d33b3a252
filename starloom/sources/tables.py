"""The engine's entities, derived from the relational tables at hand; the SQL texts derive the same rows.

frames: exposures with their object, contributor, kind, exposure, quality and review state. objects: targets with
coordinates. observations: geolocated sightings. posts, follows, likes: the social feed. jobs: the work queue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    kind = (
        F.when(c("l_returnflag") == "N", "light")
        .when((c("l_returnflag") == "R") & (c("l_linestatus") == "F"), "dark")
        .when((c("l_returnflag") == "A") & (c("l_linestatus") == "F"), "flat")
        .otherwise("bias")
    )
    parts = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    frame_id = F.concat_ws(":", *(c(p).cast("string") for p in parts), c("l_quantity").cast("bigint").cast("string"), F.floor(c("l_extendedprice") * 100 + 0.5).cast("string"), F.date_format("l_shipdate", "yyyyMMdd"))
    return table(spark, sf_dir, "lineitem").select(
        frame_id.alias("frame_id"),
        c("l_orderkey").alias("run_id"),
        c("l_partkey").alias("object_id"),
        c("l_suppkey").alias("user_id"),
        kind.alias("kind"),
        c("l_quantity").alias("exposure_s"),
        F.floor(c("l_discount") * 1000 + 0.5).cast("int").alias("quality"),
        (F.floor(c("l_tax") * 100 + 0.5) > 6).alias("rejected"),
        F.when(c("l_linestatus") == "F", "published").otherwise("approved").alias("status"),
        c("l_shipdate").alias("uploaded_at"),
        c("l_linenumber").alias("line"),
        c("l_extendedprice").alias("price"),
    )


FRAMES = """frames AS (SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT), CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT), strftime(l_shipdate, '%Y%m%d')) AS frame_id,
 l_orderkey AS run_id, l_partkey AS object_id, l_suppkey AS user_id,
 CASE WHEN l_returnflag = 'N' THEN 'light' WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'dark' WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'flat' ELSE 'bias' END AS kind,
 l_quantity AS exposure_s, CAST(floor(l_discount * 1000 + 0.5) AS INT) AS quality, floor(l_tax * 100 + 0.5) > 6 AS rejected,
 CASE WHEN l_linestatus = 'F' THEN 'published' ELSE 'approved' END AS status, l_shipdate AS uploaded_at, l_linenumber AS line, l_extendedprice AS price FROM lineitem)"""


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    golden = key * 0.6180339887498949
    return table(spark, sf_dir, "part").select(
        key.alias("object_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("kind_of_object"),
        F.col("p_brand").alias("family"),
        F.col("p_size").cast("double").alias("mag"),
        F.pmod(key * 137.50776405, F.lit(360.0)).alias("ra"),
        F.degrees(F.asin(2 * (golden - F.floor(golden)) - 1)).alias("dec"),
    )


OBJECTS = """objects AS (SELECT p_partkey AS object_id, p_name AS name, p_type AS kind_of_object, p_brand AS family, CAST(p_size AS DOUBLE) AS mag,
 fmod(p_partkey * 137.50776405::DOUBLE, 360::DOUBLE) AS ra,
 degrees(asin(2 * (p_partkey * 0.6180339887498949::DOUBLE - floor(p_partkey * 0.6180339887498949::DOUBLE)) - 1)) AS "dec" FROM part)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports over an area of ten by twelve degrees; reporters stay where they are."""
    u, e = F.col("user_id"), F.col("event_id")
    return table(spark, sf_dir, "events").select(
        e.alias("observation_id"),
        F.when(e % 10 == 0, None).otherwise(u).alias("user_id"),
        F.col("event_type").alias("phenomenon"),
        F.col("ts").alias("observed_at"),
        ((u * 37) % 100 / 10.0 + 42.0 + (e % 7) / 100.0).alias("latitude"),
        ((u * 53) % 120 / 10.0 + (e % 11) / 100.0).alias("longitude"),
        ((e * 31) % 900).cast("double").alias("altitude_m"),
        ((e * 29) % 360).cast("double").alias("azimuth"),
        (10 + (e * 7) % 70).cast("double").alias("elevation"),
        F.when(e % 17 == 0, "rejected").otherwise("pending").alias("status"),
        F.col("value"),
        F.col("props"),
    )


OBSERVATIONS = """observations AS (SELECT event_id AS observation_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE user_id END AS user_id, event_type AS phenomenon, ts AS observed_at,
 ((user_id * 37) % 100) / 10.0::DOUBLE + 42.0::DOUBLE + (event_id % 7) / 100.0::DOUBLE AS latitude, ((user_id * 53) % 120) / 10.0::DOUBLE + (event_id % 11) / 100.0::DOUBLE AS longitude,
 CAST((event_id * 31) % 900 AS DOUBLE) AS altitude_m, CAST((event_id * 29) % 360 AS DOUBLE) AS azimuth, CAST(10 + (event_id * 7) % 70 AS DOUBLE) AS elevation,
 CASE WHEN event_id % 17 = 0 THEN 'rejected' ELSE 'pending' END AS status, value, props FROM events)"""


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    seen_by = F.when(p.isin("1-URGENT", "2-HIGH"), "public").when(p == "3-MEDIUM", "followers").otherwise("private")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("post_id"), F.col("o_custkey").alias("author_id"), F.col("o_orderdate").alias("created_at"), seen_by.alias("visibility"))


POSTS = """posts AS (SELECT o_orderkey AS post_id, o_custkey AS author_id, o_orderdate AS created_at,
 CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'public' WHEN o_orderpriority = '3-MEDIUM' THEN 'followers' ELSE 'private' END AS visibility FROM orders)"""


def follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select((F.col("c_custkey") % 50).alias("follower_id"), F.col("c_custkey").alias("following_id"))


FOLLOWS = "follows AS (SELECT c_custkey % 50 AS follower_id, c_custkey AS following_id FROM customer)"


def likes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("user_id"), F.col("l_orderkey").alias("post_id")).distinct()


LIKES = "likes AS (SELECT DISTINCT l_suppkey % 50 AS user_id, l_orderkey AS post_id FROM lineitem)"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    state = F.when(F.col("o_orderstatus") == "F", "published").when(k % 4 == 0, "failed").when(k % 4 == 1, "uploaded").when(k % 4 == 2, "solving").otherwise("approved")
    return table(spark, sf_dir, "orders").select(
        k.alias("job_id"),
        (F.col("o_custkey") % 200).alias("object_id"),
        F.col("o_custkey").alias("user_id"),
        F.when(k % 5 == 0, "stack").when(k % 5 == 1, "publish").otherwise("qualify").alias("job_type"),
        state.alias("status"),
        F.col("o_orderdate").alias("available_at"),
        F.when(k % 3 == 0, F.timestamp_add("HOUR", F.lit(1), F.col("o_orderdate"))).alias("lease_until"),
        (k % 6).cast("int").alias("attempts"),
        F.lit(5).alias("max_attempts"),
        (k % 9).cast("int").alias("version"),
    )


JOBS = """jobs AS (SELECT o_orderkey AS job_id, o_custkey % 200 AS object_id, o_custkey AS user_id,
 CASE WHEN o_orderkey % 5 = 0 THEN 'stack' WHEN o_orderkey % 5 = 1 THEN 'publish' ELSE 'qualify' END AS job_type,
 CASE WHEN o_orderstatus = 'F' THEN 'published' WHEN o_orderkey % 4 = 0 THEN 'failed' WHEN o_orderkey % 4 = 1 THEN 'uploaded' WHEN o_orderkey % 4 = 2 THEN 'solving' ELSE 'approved' END AS status,
 o_orderdate AS available_at, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 1 HOUR END AS lease_until,
 CAST(o_orderkey % 6 AS INT) AS attempts, 5 AS max_attempts, CAST(o_orderkey % 9 AS INT) AS version FROM orders)"""


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads with their metadata, among them ones that break every rule."""
    k, u = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda n, *xs: F.get(F.array(*(F.lit(x) for x in xs)), (k % n).cast("int"))
    return table(spark, sf_dir, "orders").select(
        k.alias("upload_id"),
        F.when(k % 9 != 0, u).alias("user_id"),
        F.when((k % 9 == 0) | (k % 31 == 0), "public_archive").otherwise("community").alias("source_kind"),
        F.when(k % 9 == 0, k * 7).alias("archive_item_id"),
        F.concat(F.lit("frame é"), k.cast("string"), pick(6, ".fits", ".FITS", ".cr2", ".jpg", ".txt", "")).alias("filename"),
        F.when(k % 13 == 0, 0).when(k % 17 == 0, 6000000000).otherwise(k * 1000).alias("size_bytes"),
        F.concat(F.lit("M"), (u % 110).cast("string")).alias("object_id"),
        pick(5, "light", "light", "dark", "flat", "video").alias("kind"),
        pick(4, "CC-BY-4.0", "CC0-1.0", "CC-BY-SA-4.0", None).alias("licence"),
        F.when(k % 7 != 0, (k % 1200).cast("double")).alias("focal_length_mm"),
        (k % 120).cast("double").alias("pixel_size_um"),
        (k % 1000).cast("double").alias("exposure_s"),
        (k % 2000 - 10).cast("int").alias("gain"),
        (k % 600 - 300).cast("double").alias("temperature_c"),
        (k % 11).cast("int").alias("binning"),
        (k % 200 - 100).cast("double").alias("latitude"),
        F.when(k % 6 != 0, (k % 400 - 200).cast("double")).alias("longitude"),
        F.col("o_orderdate").alias("captured_at"),
        F.when(k % 10 == 3, F.col("o_orderdate")).alias("deleted_at"),
        F.sha2(F.floor(k / 3).cast("string"), 256).alias("content_sha256"),
        F.concat(F.lit("group "), (k % 3).cast("string")).alias("instrument_group"),
        (k % 101).cast("int").alias("quality"),
        pick(5, "approved", "published", "stacked", "failed", "uploaded").alias("status"),
        (k % 8 == 0).alias("rejected"),
        F.concat(F.lit("v"), (k % 2).cast("string")).alias("pipeline_version"),
    )


UPLOADS = """uploads AS (SELECT o_orderkey AS upload_id, CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey END AS user_id, CASE WHEN o_orderkey % 9 = 0 OR o_orderkey % 31 = 0 THEN 'public_archive' ELSE 'community' END AS source_kind,
 CASE WHEN o_orderkey % 9 = 0 THEN o_orderkey * 7 END AS archive_item_id, 'frame é' || o_orderkey || (['.fits', '.FITS', '.cr2', '.jpg', '.txt', ''])[o_orderkey % 6 + 1] AS filename,
 CASE WHEN o_orderkey % 13 = 0 THEN 0 WHEN o_orderkey % 17 = 0 THEN 6000000000 ELSE o_orderkey * 1000 END AS size_bytes, 'M' || o_custkey % 110 AS object_id, (['light', 'light', 'dark', 'flat', 'video'])[o_orderkey % 5 + 1] AS kind,
 (['CC-BY-4.0', 'CC0-1.0', 'CC-BY-SA-4.0', NULL])[o_orderkey % 4 + 1] AS licence, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 1200 AS DOUBLE) END AS focal_length_mm, CAST(o_orderkey % 120 AS DOUBLE) AS pixel_size_um,
 CAST(o_orderkey % 1000 AS DOUBLE) AS exposure_s, CAST(o_orderkey % 2000 - 10 AS INT) AS gain, CAST(o_orderkey % 600 - 300 AS DOUBLE) AS temperature_c, CAST(o_orderkey % 11 AS INT) AS binning, CAST(o_orderkey % 200 - 100 AS DOUBLE) AS latitude,
 CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderkey % 400 - 200 AS DOUBLE) END AS longitude, o_orderdate AS captured_at, CASE WHEN o_orderkey % 10 = 3 THEN o_orderdate END AS deleted_at, sha256(CAST(o_orderkey // 3 AS VARCHAR)) AS content_sha256,
 'group ' || o_orderkey % 3 AS instrument_group, CAST(o_orderkey % 101 AS INT) AS quality, (['approved', 'published', 'stacked', 'failed', 'uploaded'])[o_orderkey % 5 + 1] AS status, o_orderkey % 8 = 0 AS rejected, 'v' || o_orderkey % 2 AS pipeline_version FROM orders)"""
