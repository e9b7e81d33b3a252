"""Streams with timers, on files that come out of order over several batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from starloom.sources.storage import scratch
from starloom.streaming import stateful

START = dt.datetime(2024, 1, 1)
SCHEMA = "user long, id long, ts timestamp, value double"


def stream(spark, batches):
    """A stream of a file a batch, in this order."""
    folder = scratch(spark, "stateful-in")
    for n, rows in enumerate(batches):
        df = spark.createDataFrame([(u, i, START + dt.timedelta(minutes=m), v) for u, i, m, v in rows], SCHEMA).coalesce(1)
        df.write.mode("append").parquet(folder)
        import time

        time.sleep(1.1)  # files are taken by age
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def ms(minute):
    return int((START + dt.timedelta(minutes=minute) - dt.datetime(1970, 1, 1)).total_seconds() * 1000)


def test_leases_end_when_time_has_passed(spark):
    batches = [
        [(1, 1, 0, 0.0), (2, 2, 5, 0.0), (1, 3, 20, 0.0)],
        [(1, 4, 10, 0.0), (3, 5, 60, 0.0)],  # the beat at 10 comes after that at 20
        [(3, 6, 80, 0.0), (3, 7, 200, 0.0)],
        [(4, 8, 400, 0.0), (2, 9, 30, 0.0)],  # far too late
        [(4, 10, 800, 0.0)],
    ]
    out = stateful.run_to_end(stateful.in_order(stream(spark, batches), stateful.Leases(30 * 60_000), "user", "id", "value", "ts", 900), "leases").collect()
    got = sorted((r.key, r.started_at, r.last_at, r.beats) for r in out if r.kind == "expired")
    assert got == [(1, ms(0), ms(20), 3), (2, ms(5), ms(5), 1), (3, ms(60), ms(80), 2), (3, ms(200), ms(200), 1), (4, ms(400), ms(400), 1)]
    assert [(r.key, r.started_at) for r in out if r.kind == "late"] == [(2, ms(30))]


def test_crossings_out_of_order(spark):
    rows = [(u, 100 * u + k, 7 * k + u, float((k * 37 + u * 11) % 100)) for u in (1, 2, 3) for k in range(30)]
    shuffled = sorted(rows, key=lambda r: (r[2] // 45, -r[1]))  # within three quarters of an hour the other way round
    batches = [shuffled[i : i + 18] for i in range(0, len(shuffled), 18)] + [[(9, 1, 5000, 0.0)]]
    out = stateful.run_to_end(stateful.in_order(stream(spark, batches), stateful.Crossings(50.0), "user", "id", "value", "ts", 7200), "crossings")
    got = {(r.key, r.before_id, r.id) for r in out.where("kind = 'crossing'").collect()}
    want = set()
    for u in (1, 2, 3):
        mine = sorted((r for r in rows if r[0] == u), key=lambda r: r[2])
        want |= {(u, a[1], b[1]) for a, b in zip(mine, mine[1:]) if a[3] < 50 <= b[3]}
    assert got == want and out.where("kind = 'late'").count() == 0
