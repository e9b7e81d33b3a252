"""Steps whose cost must grow no faster than their input, on inputs that the larger way got wrong or took too long for."""

import datetime as dt
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from starloom.functions import geo, healpix
from starloom.operators import feeds, lookups, mosaic, tiling
from starloom.plans.registry import ORACLES, QUERIES
from starloom.sources import fits, tables
from starloom.sources.readers import fits_bytes
from starloom.streaming import observations, stateful
from tests.parity import assert_parity


def test_clusters_without_pairs_are_those_of_pairs(spark):
    rng = random.Random(3)
    kinds = ["a", "b", None]
    rows = [(i, rng.choice([None, 1, 2, 3]), rng.choice(kinds), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(9000)), rng.uniform(-90, 90), rng.uniform(-180, 180), 10.0 * (i % 9), i * 29.0 % 360, 10.0 + i % 70, rng.choice(["pending", "rejected"])) for i in range(500)]
    rows += [(1000 + i, i % 3, "a", dt.datetime(2024, 1, 1, 1, 15 * (i % 3)), 47.0, 6.0 + i, 100.0, 40.0 * i, 30.0 + i, "pending") for i in range(12)]
    df = spark.createDataFrame(rows, "observation_id long, user_id long, phenomenon string, observed_at timestamp_ntz, latitude double, longitude double, altitude_m double, azimuth double, elevation double, status string")
    for radius in (500.0, 3000.0):
        pairs = feeds.near_pairs(df, radius_km=radius)
        want = feeds.clusters(pairs).join(feeds.triangulated(pairs).drop("lines"), "observation_id", "left")
        got = feeds.near_clusters(df, radius_km=radius)
        assert sorted(map(tuple, want.select(got.columns).collect()), key=repr) == sorted(map(tuple, got.collect()), key=repr)
        assert got.count() > 10


def test_corners_keep_a_small_plan(spark, sf_dir):
    for name in ("h03_corners", "e15_polygons"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert len(plan) < 300_000, name


def test_places_meet_once(spark):
    points = spark.createDataFrame([(i, float(i % 3), 0.0) for i in range(9)], "point long, px double, py double")
    hits = spark.createDataFrame([(5, 1.0, 0.0), (4, 1.0, 0.0), (9, 40.0, 0.0), (3, -1.0, 0.0)], "hit long, x double, y double")
    out = lookups.nearest(points, hits, 2.0)
    assert {tuple(r) for r in out.collect()} == {(i, 3 if i % 3 == 0 else 4, (1.0, 0.0, 1.0)[i % 3]) for i in range(9)}
    assert "[px" in out._jdf.queryExecution().optimizedPlan().toString().split("min(struct")[0].rpartition("Aggregate ")[2]


def test_many_ranges_are_few_tasks(tmp_path):
    (tmp_path / "a.fits").write_bytes(fits_bytes(np.zeros((4, 4), np.float32), {}))
    parts = fits.FitsReader(str(tmp_path), [], 1).partitions()
    assert len(parts) <= fits.TASKS
    spans = [r[2:] for p in parts for r in p.ranges]
    assert spans == [(i, i + 1) for i in range((tmp_path / "a.fits").stat().st_size)]


def test_leases_and_sessions_at_the_edge(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    gaps = (21599, 21600, 21601, 21602, 14399, 14400, 14401)
    rows = [(2 * u + k, start + dt.timedelta(seconds=k * gap), u, "view", 1.0, "") for u, gap in enumerate(gaps) for k in (0, 1)]
    spark.createDataFrame(rows, observations.SCHEMA).coalesce(1).write.parquet(str(tmp_path / "x"))
    next((tmp_path / "x").glob("*.parquet")).rename(tmp_path / "events.parquet")
    for name in ("z06_leases", "z05_sessions"):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
        assert_parity(QUERIES[name](spark, str(tmp_path)), con, ORACLES[name])


def test_rows_step_without_the_store():
    leases, crossings = stateful.Leases(10), stateful.Crossings(50.0)
    leases.lease = crossings.row = None
    assert [leases.step(t, t, 0.0) for t in (0, 5, 30)] == [[], [], [("expired", 0, 5, 2)]]
    assert [crossings.step(t, t, v) for t, v in ((0, 1.0), (1, 60.0), (2, 70.0))] == [[], [("crossing", 0, 1)], []]


def test_extremes_aggregate_without_a_sort(spark, sf_dir):
    for name in ("m13_rise_and_set", "h07_viewport_cells"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan, name


def test_first_frames_claim_as_all_do(spark, sf_dir):
    frames, objects = tables.frames(spark, sf_dir), tables.objects(spark, sf_dir)
    few = mosaic.first_frames(frames)
    assert few.count() < frames.count() / 2
    want, got = (mosaic.claims(mosaic.frame_cells(f, objects)).collect() for f in (frames, few))
    assert sorted(want) == sorted(got)


def test_lists_and_nulls_stay_out_of_the_shuffle(spark, sf_dir):
    assert "collect_set" not in QUERIES["x08_missing_weights"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    plan = QUERIES["q28_run_inventory"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "isnotnull(CASE WHEN" in plan or "NOT (l_linenumber" in plan


def test_cones_list_the_cells_that_all_cells_give(spark):
    rng, nan, inf = random.Random(5), float("nan"), float("inf")
    odd = [(0.0, 90.0, 2.0), (10.0, -90.0, 0.5), (359.9, 0.0, 3.0), (0.0, 89.5, 1.0), (-20.0, 41.8, 0.0), (200.0, -41.8, 30.0), (90.0, 10.0, 120.0), (5.0, 5.0, inf), (5.0, 5.0, -9.0)]
    cones = [(i, *x) for i, x in enumerate(odd + [(rng.uniform(0, 360), rng.uniform(-90, 90), rng.uniform(0, 8)) for _ in range(200)])]
    wrong = [(900, None, 1.0, 1.0), (901, 1.0, None, 1.0), (902, 1.0, 1.0, None), (903, nan, 1.0, 1.0), (904, inf, 1.0, 1.0), (905, 1.0, nan, 1.0), (906, 1.0, 1.0, nan)]
    out = tiling.cones_cells(spark.createDataFrame(cones + wrong, "k long, ra double, dec double, radius double"), "k", 4)
    centres = healpix.with_centre(spark.range(healpix.n_cells(4)).withColumnRenamed("id", "index"), "index", 4).toPandas()
    a, d = np.radians(centres["centre_ra"].to_numpy()), np.radians(centres["centre_dec"].to_numpy())
    want = set()
    for k, ra, dec, radius in cones:
        b, e = np.radians(ra), np.radians(dec)
        far = np.degrees(np.arccos(np.clip(np.sin(d) * np.sin(e) + np.cos(d) * np.cos(e) * np.cos(a - b), -1, 1)))
        want |= {(k, 4, int(i)) for i in centres["index"][far <= radius + healpix.widest_radius(4)]}
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()


def test_chords_decide_as_distances_do(spark):
    rng = random.Random(9)
    rows = [(rng.uniform(-90, 90), rng.uniform(-180, 540), rng.uniform(-90, 90), rng.uniform(-180, 540)) for _ in range(1500)]
    step = float(np.degrees(500.0 / geo.EARTH_KM))
    rows += [(lat, 7.0, lat + step * (1 + k * 1e-15), 7.0) for lat in (-40.0, 0.0, 43.3) for k in range(-40, 41, 4)]
    rows += [(90.0, 0.0, 90.0, 50.0), (0.0, 0.0, 0.0, 180.0), (1.0, 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0), (float("nan"), 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "alat double, alon double, blat double, blon double")
    for side in "ab":
        df = df.withColumns({side + c: v for c, v in geo.place_vector(F.col(f"{side}lat"), F.col(f"{side}lon")).items()})
    named = lambda side: lambda c: F.col(side + {"latitude": "lat", "longitude": "lon"}.get(c, c))
    far = geo.great_circle_km(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon"))
    for km in (0.001, 500.0, 9000.0, 20000.0):
        assert df.where(~geo.within_km(named("a"), named("b"), km).eqNullSafe(far <= km)).count() == 0
    assert 0 < df.where(far <= 500).count() < df.count()


def test_pairs_meet_by_vectors(spark, sf_dir):
    join = QUERIES["j16_near_pairs"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[1].split("\n")[0]
    assert "CASE WHEN" in join and "ux" in join


def _shuffled(node):
    """Rows that a plan's exchanges have written."""
    kind = node.getClass().getSimpleName()
    if kind.startswith("ShuffleExchange"):
        own = node.metrics().apply("shuffleRecordsWritten").value()
    else:
        own = 0
    if kind == "AdaptiveSparkPlanExec":
        below = [node.executedPlan()]
    elif kind.endswith("QueryStageExec"):
        below = [node.plan()]
    else:
        below = [node.children().apply(i) for i in range(node.children().size())]
    return own + sum(map(_shuffled, below))


def _scattered(n, seconds):
    rng = random.Random(16)
    places = [(90.0, 3.0), (89.9, 183.0), (-90.0, 0.0), (60.0, 359.9), (60.0, -0.1), (30.0, 30.0), (29.9, 29.9), (0.0, 540.0), (2.0, 181.0), (float("nan"), 1.0), (None, 1.0), (float("inf"), 1.0)]
    rows = [(i, i % 5, rng.choice(["a", "a", "b", None]), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(seconds)), *rng.choice(places), 1.0, 2.0, 3.0, rng.choice(["pending", "pending", "rejected", None])) for i in range(n)]
    rows += [(n + i, 1, "a", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=900 * (i % 9)), rng.uniform(-90, 90), rng.uniform(-180, 540), 1.0, 2.0, 3.0, "pending") for i in range(n)]
    return rows + [(2 * n, 1, "a", None, 1.0, 1.0, 1.0, 2.0, 3.0, "pending")]


def _near(rows, km):
    ok = [r for r in rows if r[9] == "pending" and r[2] and r[3] and r[4] is not None and abs(r[4]) < 1e9]
    lat, lon = np.radians([r[4] for r in ok]), np.radians([r[5] for r in ok])
    h = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat)[:, None] * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
    met = 2 * geo.EARTH_KM * np.arcsin(np.minimum(1, np.sqrt(h))) <= km
    return sorted((ok[i][0], ok[j][0]) for i, j in zip(*np.nonzero(met), strict=True) if ok[i][2] == ok[j][2] and abs((ok[i][3] - ok[j][3]).total_seconds()) <= 900)


OBSERVED = "observation_id long, user_id long, phenomenon string, observed_at timestamp_ntz, latitude double, longitude double, altitude_m double, azimuth double, elevation double, status string"


def test_pairs_are_all_that_is_near(spark, monkeypatch):
    rows = _scattered(150, 4000)
    df = spark.createDataFrame(rows, OBSERVED)
    for deal, km in ((feeds.DEAL, 4000.0), (8, 500.0)):  # crowded groups are cut into chunks
        monkeypatch.setattr(feeds, "DEAL", deal)
        pairs = feeds.near_pairs(df, radius_km=km)
        assert sorted((r.observation_id, r.other_id) for r in pairs.select("observation_id", "other_id").collect()) == _near(rows, km)
    assert "other_chunk" in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_shuffle_few_copies_and_no_vectors(spark, sf_dir):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = QUERIES["j16_near_pairs"](spark, sf_dir)
        rows = out._jdf.queryExecution().executedPlan()
        out._jdf.collectToPython()
        usable = tables.observations(spark, sf_dir).where("status <> 'rejected'").count()
        assert usable <= _shuffled(rows) <= 4 * usable
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
