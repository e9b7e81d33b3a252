"""The work queue as dataflow: each operator maps the job table to decisions or to its next version, with an explicit as_of."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Allowed status changes, by status left.
TRANSITIONS = {
    "uploaded": ("extracting", "duplicate", "cancelled", "failed"),
    "extracting": ("solving", "qualifying", "rejected", "failed"),
    "solving": ("qualifying", "rejected", "failed"),
    "qualifying": ("awaiting_review", "approved", "rejected", "duplicate", "failed"),
    "awaiting_review": ("approved", "rejected", "cancelled"),
    "approved": ("calibrating", "tiling", "published", "failed"),
    "calibrating": ("aligning", "failed"),
    "aligning": ("stacking", "failed"),
    "stacking": ("tiling", "published", "failed"),
    "tiling": ("published", "failed"),
    "rejected": ("awaiting_review",),
    "cancelled": ("uploaded",),
    "failed": ("uploaded", "extracting", "solving", "qualifying", "awaiting_review", "approved", "calibrating", "aligning", "stacking", "tiling"),
}
TERMINAL = ("published", "rejected", "duplicate", "cancelled")
COOLDOWN_MINUTES = 15


def transition_table(spark) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, to in TRANSITIONS.items() for b in to], "from_status string, to_status string")


def _at(moment: dt.datetime) -> Column:
    return F.lit(moment).cast("timestamp_ntz")


def lease(jobs: DataFrame, as_of: dt.datetime, per_type: int = 1) -> DataFrame:
    """The next jobs of each type: open, due, not leased, attempts left; the oldest first."""
    free = F.col("lease_until").isNull() | (F.col("lease_until") <= _at(as_of))
    due = jobs.where(~F.col("status").isin(*TERMINAL) & (F.col("available_at") <= _at(as_of)) & free & (F.col("attempts") < F.col("max_attempts")))
    order = W.partitionBy("job_type").orderBy("available_at", "job_id")
    picked = due.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_type)
    return picked.select("job_type", "job_id", "status", "available_at", (F.col("attempts") + 1).alias("attempts"), (F.col("version") + 1).alias("version"))


def heartbeat(jobs: DataFrame, requests: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Extends leases that still run and whose version agrees; seconds are held to 30 to 1800."""
    rows = jobs.join(requests, "job_id").where((F.col("lease_until") > _at(as_of)) & (F.col("version") == F.col("expected_version")))
    seconds = F.least(F.greatest("seconds", F.lit(30)), F.lit(1800)).cast("long")
    return rows.select("job_id", F.timestamp_add("SECOND", seconds.cast("int"), _at(as_of)).alias("lease_until"))


def transition(jobs: DataFrame, requests: DataFrame, allowed: DataFrame) -> DataFrame:
    """Outcome of each request (job_id, to_status, expected_version): applied, stale or forbidden."""
    pairs = allowed.select(F.col("from_status").alias("status"), "to_status", F.lit(True).alias("allowed"))
    rows = jobs.join(requests, "job_id").join(pairs, ["status", "to_status"], "left")
    outcome = F.when(F.col("version") != F.col("expected_version"), "stale").when(F.col("allowed").isNull(), "forbidden").otherwise("applied")
    new = F.when(F.col("outcome") == "applied", F.col("to_status")).otherwise(F.col("status"))
    return rows.withColumn("outcome", outcome).select("job_id", "status", "to_status", "outcome", new.alias("new_status"), (F.col("version") + (F.col("outcome") == "applied").cast("int")).alias("new_version"))


def fail(jobs: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Failed jobs: retried after 2**attempts seconds (15 minutes at most), or dead when no attempts are left."""
    dead = F.col("attempts") >= F.col("max_attempts")
    delay = F.least(F.lit(900), F.pow(F.lit(2), F.least("attempts", F.lit(8)))).cast("int")
    return jobs.where(F.col("status") == "failed").select("job_id", F.when(dead, "dead").otherwise("retry").alias("outcome"), F.when(~dead, F.timestamp_add("SECOND", delay, _at(as_of))).alias("available_at"))


def cancellable(jobs: DataFrame, user_id: int) -> DataFrame:
    """A user's jobs, newest first, with whether they can still be cancelled."""
    can = F.col("status").isin(*(a for a, to in TRANSITIONS.items() if "cancelled" in to))
    return jobs.where(F.col("user_id") == user_id).select("job_id", "job_type", "status", "available_at", can.alias("cancellable")).orderBy(F.col("available_at").desc(), "job_id").limit(100)


def stack_requests(jobs: DataFrame, lights: DataFrame, as_of: dt.datetime) -> DataFrame:
    """What a stack request for each object would get: active, cooldown, too-few-lights or queued, in that order."""
    stacks = jobs.where(F.col("job_type") == "stack")
    by_object = stacks.groupBy("object_id").agg(F.max(~F.col("status").isin(*TERMINAL, "failed")).alias("open"), F.max(F.when(F.col("status").isin(*TERMINAL), F.col("available_at"))).alias("ended_at"))
    rows = lights.join(by_object, "object_id", "left")
    recent = F.col("ended_at") > F.timestamp_add("MINUTE", F.lit(-COOLDOWN_MINUTES), _at(as_of))
    answer = F.when(F.coalesce("open", F.lit(False)), "active").when(F.coalesce(recent, F.lit(False)), "cooldown").when(F.col("n_light") < 3, "too-few-lights").otherwise("queued")
    return rows.select("object_id", "n_light", "ended_at", answer.alias("answer"))


def latest_of_each(jobs: DataFrame) -> DataFrame:
    """The newest job of each object."""
    newest = jobs.groupBy("object_id").agg(F.max(F.struct("available_at", "job_id", "status")).alias("j"), F.count(F.lit(1)).alias("n_jobs"))
    return newest.select("object_id", "j.job_id", "j.status", "j.available_at", "n_jobs")


def upserted(current: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of both tables, of each key the highest version; changes win ties."""
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    order = W.partitionBy(key).orderBy(F.col(version).desc(), F.col("_new").desc())
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_new")


def appended(current: DataFrame, arrivals: DataFrame, key: list[str]) -> DataFrame:
    """Arrivals whose key is not there yet: what an insert that ignores conflicts returns."""
    return arrivals.join(current.select(key), key, "left_anti")


def differences(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, fields): names of the fields that differ, null-safe, for rows that do."""
    joined = old.alias("o").join(new.alias("n"), key)
    names = F.array_compact(F.array(*(F.when(~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")), F.lit(f)) for f in fields)))
    return joined.select(key, F.array_join(names, ",").alias("fields")).where("fields <> ''")
