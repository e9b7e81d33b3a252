"""Queue queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from starloom.operators import jobs as J
from starloom.operators import rollups as R
from starloom.plans.rollups import STATS
from starloom.sources import tables as S

AS_OF = dt.datetime(1998, 6, 1)
_TO = ("approved", "published", "extracting", "failed", "qualifying")


def _requests(s, d):
    to = F.element_at(F.array(*map(F.lit, _TO)), (F.col("job_id") % 5 + 1).cast("int"))
    return S.jobs(s, d).select("job_id", to.alias("to_status"), (F.col("version") + F.when(F.col("job_id") % 11 == 0, 1).otherwise(0)).alias("expected_version"), (F.col("job_id") % 4000).cast("int").alias("seconds"))


def u2_upsert(s, d):
    jobs = S.jobs(s, d).select("job_id", "status", "version")
    changes = jobs.where("status = 'failed'").select("job_id", F.lit("changed").alias("status"), (F.col("version") + F.when(F.col("job_id") % 2 == 0, 1).otherwise(-1)).alias("version"))
    return J.upserted(jobs, changes, "job_id", "version")


def u1_append(s, d):
    jobs = S.jobs(s, d)
    arrivals = jobs.select(F.when(F.col("job_id") % 4 == 0, F.col("job_id") + 10_000_000).otherwise(F.col("job_id")).alias("job_id"), "status")
    return J.appended(jobs, arrivals, ["job_id"])


def o06_differences(s, d):
    old = S.jobs(s, d).select("job_id", "status", "attempts", "lease_until")
    k = F.col("job_id")
    new = old.select("job_id", F.when(k % 6 == 0, "other").otherwise(F.col("status")).alias("status"), F.when(k % 10 == 0, F.col("attempts") + 1).otherwise(F.col("attempts")).alias("attempts"), F.when(k % 15 != 0, F.col("lease_until")).alias("lease_until"))
    return J.differences(old, new, "job_id", ["attempts", "lease_until", "status"])


QUERIES = {
    "q15_stack_requests": lambda s, d: J.stack_requests(S.jobs(s, d), R.object_stats(S.frames(s, d)).select("object_id", "n_light"), AS_OF),
    "q16_lease": lambda s, d: J.lease(S.jobs(s, d), AS_OF, 25),
    "q17_heartbeat": lambda s, d: J.heartbeat(S.jobs(s, d), _requests(s, d), dt.datetime(1996, 1, 1)),
    "q18_transition": lambda s, d: J.transition(S.jobs(s, d), _requests(s, d), J.transition_table(s)),
    "q19_fail": lambda s, d: J.fail(S.jobs(s, d), AS_OF),
    "q20_user_jobs": lambda s, d: J.cancellable(S.jobs(s, d), 7),
    "j08_latest_job": lambda s, d: J.latest_of_each(S.jobs(s, d)),
    "u2_upsert": u2_upsert,
    "u1_append": u1_append,
    "o06_differences": o06_differences,
}

_ALLOWED = "allowed(f, t) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, to in J.TRANSITIONS.items() for b in to) + ")"
_REQUESTS = """requests AS (SELECT job_id, ['approved', 'published', 'extracting', 'failed', 'qualifying'][job_id % 5 + 1] AS to_status, version + CASE WHEN job_id % 11 = 0 THEN 1 ELSE 0 END AS expected_version, CAST(job_id % 4000 AS INT) AS seconds FROM jobs)"""
_END = "('published', 'rejected', 'duplicate', 'cancelled')"

ORACLES = {
    "q15_stack_requests": f"""WITH {S.FRAMES}, {S.JOBS}, {STATS}, b AS (SELECT object_id, bool_or(status NOT IN ('published', 'rejected', 'duplicate', 'cancelled', 'failed')) AS open, max(available_at) FILTER (WHERE status IN {_END}) AS ended_at
        FROM jobs WHERE job_type = 'stack' GROUP BY object_id) SELECT s.object_id, n_light, ended_at, CASE WHEN coalesce(open, false) THEN 'active' WHEN coalesce(ended_at > TIMESTAMP '1998-06-01' - INTERVAL 15 MINUTE, false) THEN 'cooldown'
        WHEN n_light < 3 THEN 'too-few-lights' ELSE 'queued' END AS answer FROM stats s LEFT JOIN b USING (object_id)""",
    "q16_lease": f"""WITH {S.JOBS}, r AS (SELECT *, row_number() OVER (PARTITION BY job_type ORDER BY available_at, job_id) AS n FROM jobs WHERE status NOT IN {_END} AND available_at <= TIMESTAMP '1998-06-01'
        AND (lease_until IS NULL OR lease_until <= TIMESTAMP '1998-06-01') AND attempts < max_attempts) SELECT job_type, job_id, status, available_at, attempts + 1 AS attempts, version + 1 AS version FROM r WHERE n <= 25""",
    "q17_heartbeat": f"""WITH {S.JOBS}, {_REQUESTS} SELECT j.job_id, TIMESTAMP '1996-01-01' + to_seconds(least(greatest(seconds, 30), 1800)) AS lease_until FROM jobs j JOIN requests r USING (job_id)
        WHERE lease_until > TIMESTAMP '1996-01-01' AND version = expected_version""",
    "q18_transition": f"""WITH {S.JOBS}, {_REQUESTS}, {_ALLOWED}, o AS (SELECT j.job_id, status, to_status, version, CASE WHEN version <> expected_version THEN 'stale' WHEN (status, to_status) NOT IN (SELECT (f, t) FROM allowed) THEN 'forbidden' ELSE 'applied' END AS outcome
        FROM jobs j JOIN requests r USING (job_id)) SELECT job_id, status, to_status, outcome, CASE WHEN outcome = 'applied' THEN to_status ELSE status END AS new_status, version + CASE WHEN outcome = 'applied' THEN 1 ELSE 0 END AS new_version FROM o""",
    "q19_fail": f"""WITH {S.JOBS} SELECT job_id, CASE WHEN attempts >= max_attempts THEN 'dead' ELSE 'retry' END AS outcome,
        CASE WHEN attempts < max_attempts THEN TIMESTAMP '1998-06-01' + to_seconds(least(900, pow(2, least(attempts, 8)))) END AS available_at FROM jobs WHERE status = 'failed'""",
    "q20_user_jobs": f"WITH {S.JOBS} SELECT job_id, job_type, status, available_at, status IN ('uploaded', 'awaiting_review') AS cancellable FROM jobs WHERE user_id = 7 ORDER BY available_at DESC, job_id LIMIT 100",
    "j08_latest_job": f"WITH {S.JOBS} SELECT object_id, arg_max(job_id, (available_at, job_id)) AS job_id, arg_max(status, (available_at, job_id)) AS status, max(available_at) AS available_at, count(*) AS n_jobs FROM jobs GROUP BY object_id",
    "u2_upsert": f"WITH {S.JOBS} SELECT job_id, CASE WHEN status = 'failed' AND job_id % 2 = 0 THEN 'changed' ELSE status END AS status, version + CASE WHEN status = 'failed' AND job_id % 2 = 0 THEN 1 ELSE 0 END AS version FROM jobs",
    "u1_append": f"WITH {S.JOBS}, a AS (SELECT CASE WHEN job_id % 4 = 0 THEN job_id + 10000000 ELSE job_id END AS job_id, status FROM jobs) SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.job_id = a.job_id)",
    "o06_differences": f"""WITH {S.JOBS}, x AS (SELECT job_id, concat_ws(',', CASE WHEN job_id % 10 = 0 THEN 'attempts' END, CASE WHEN job_id % 15 = 0 AND lease_until IS NOT NULL THEN 'lease_until' END, CASE WHEN job_id % 6 = 0 THEN 'status' END) AS fields FROM jobs)
        SELECT job_id, fields FROM x WHERE fields <> ''""",
}
