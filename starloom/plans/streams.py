"""Streaming queries, each drained over all events and returned as a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.sources import tables as S
from starloom.streaming import observations as Z
from starloom.streaming import stateful as T

DELAY_S = 3600


def z06_expiries(s, d):
    """Leases of users that have expired by the time that the stream has reached: events are beats, six hours each."""
    rows = T.in_order(Z.event_stream(s, d), T.Leases(Z.LEASE_S * 1000), "user_id", "event_id", "value", "ts", DELAY_S)
    out = T.run_to_end(rows, "expiries").where("kind = 'expired'")
    return out.select(F.col("key").alias("user_id"), "started_at", "last_at", "beats")


def z07_released(s, d):
    """Crossings of a level, of the rows that the stream has passed, in order of event time whatever their batches."""
    rows = T.in_order(Z.event_stream(s, d), T.Crossings(Z.LEVEL), "user_id", "event_id", "value", "ts", DELAY_S)
    out = T.run_to_end(rows, "released").where("kind = 'crossing'")
    return out.select(F.col("key").alias("user_id"), "before_id", F.col("id").alias("event_id"))


QUERIES = {
    "z06_expiries": z06_expiries,
    "z07_released": z07_released,
    "z02_sliding_counts": Z.sliding_counts,
    "z03_correlated": Z.correlated,
    "z04_counters": Z.counters,
    "z05_once_each": Z.once_each,
    "z06_leases": Z.leases,
    "z05_sessions": Z.sessions,
    "z01_polled": Z.polled,
    "z07_crossings": Z.crossings,
    "z08_backfilled": Z.backfilled,
}

_PASSED = f"e AS (SELECT user_id, event_id, value, epoch_us(ts) // 1000 AS t, max(epoch_us(ts) // 1000) OVER () - {DELAY_S * 1000} AS mark FROM events), p AS (SELECT * FROM e WHERE t < mark)"

ORACLES = {
    "z06_expiries": f"""WITH {_PASSED}, g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) <= {Z.LEASE_S * 1000} THEN 0 ELSE 1 END AS fresh FROM p), n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM g)
        SELECT user_id, min(t) AS started_at, max(t) AS last_at, count(*) AS beats FROM n GROUP BY user_id, k HAVING any_value(mark) - max(t) > {Z.LEASE_S * 1000}""",
    "z07_released": f"""WITH {_PASSED}, l AS (SELECT user_id, event_id, value, lag(value) OVER o AS before, lag(event_id) OVER o AS before_id FROM p WINDOW o AS (PARTITION BY user_id ORDER BY t, event_id)) SELECT user_id, before_id, event_id FROM l WHERE before < {Z.LEVEL} AND value >= {Z.LEVEL}""",
    "z02_sliding_counts": """WITH w AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01') - to_minutes(30 * k) AS from_at, event_type, value FROM events, range(0, 4) r(k))
        SELECT from_at, from_at + INTERVAL 2 HOUR AS to_at, event_type, count(*) AS n, floor(sum(value) * 100 + 0.5) / 100 AS total FROM w GROUP BY ALL""",
    "z03_correlated": f"""WITH {S.OBSERVATIONS}, a AS (SELECT event_id, user_id, ts, latitude, longitude FROM events JOIN observations ON observation_id = event_id WHERE event_type = 'error'), b AS (SELECT event_id, user_id, ts, latitude, longitude FROM events JOIN observations ON observation_id = event_id WHERE event_type = 'purchase'),
        m AS (SELECT a.event_id AS a_id, b.event_id AS b_id, pow(sin(radians((b.latitude - a.latitude) / 2)), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians((b.longitude - a.longitude) / 2)), 2) AS h FROM a JOIN b ON b.ts BETWEEN a.ts - INTERVAL 15 MINUTE AND a.ts + INTERVAL 15 MINUTE AND a.user_id <> b.user_id)
        SELECT a_id, b_id FROM m WHERE 2 * 6371.0088::DOUBLE * asin(least(1, sqrt(h))) <= 500""".replace("SELECT event_id, user_id, ts", "SELECT event_id, events.user_id AS user_id, ts"),
    "z04_counters": "SELECT user_id, count(*) AS n_events, count(*) FILTER (WHERE event_type = 'click') AS n_clicks, max(event_id) AS last_id FROM events GROUP BY user_id",
    "z05_once_each": "SELECT concat_ws(':', event_type, event_id) AS key, event_id FROM events",
    "z06_leases": """WITH g AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) - lag(CAST(floor(epoch(ts)) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events)
        SELECT user_id, count(*) FILTER (WHERE gap <= 21600) AS renewed, count(*) FILTER (WHERE gap > 21600) AS expired FROM g GROUP BY user_id""",
    "z05_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER u < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g) SELECT user_id, min(ts) AS from_at, count(*) AS n FROM s GROUP BY user_id, s.n""",
    "z01_polled": "SELECT event_type, max(ts) AS last_at, arg_max(event_id, (ts, event_id)) AS last_id, count(*) AS n FROM events GROUP BY event_type",
    "z07_crossings": "WITH l AS (SELECT user_id, event_id, value, lag(value) OVER o AS before, lag(event_id) OVER o AS before_id FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, before_id, event_id FROM l WHERE before < 50 AND value >= 50",
    "z08_backfilled": "SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) AS n, CASE WHEN day(CAST(ts AS DATE)) % 3 <> 0 THEN 'kept' ELSE 'replayed' END AS origin FROM events GROUP BY CAST(ts AS DATE)",
}
