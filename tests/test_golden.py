import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from starloom.functions import astro, geo, healpix, maths, policy, text
from starloom.operators import activation, feeds, jobs, mosaic, raster, rollups, sky, tiling

CELLS = [
    ((10.6847, 41.2692), (0, 42, 2709, 10836, 43345, 173380)),
    ((83.8221, -5.3911), (5, 334, 21439, 85758, 343034, 1372138)),
    ((56.8750, 24.1167), (0, 7, 474, 1896, 7584, 30338)),
    ((148.8882, 69.0653), (1, 118, 7606, 30424, 121698, 486793)),
    ((189.9976, -11.6231), (6, 391, 25083, 100332, 401329, 1605319)),
    ((202.4696, 47.1952), (2, 172, 11027, 44110, 176440, 705762)),
]


def test_cells(spark):
    df = spark.createDataFrame([(*p, i) for i, (p, _) in enumerate(CELLS)], "ra double, dec double, i int")
    for k, order in enumerate((0, 3, 6, 7, 8, 9)):
        got = {r.i: r.cell for r in healpix.with_cell(df, "ra", "dec", order, "cell").collect()}
        assert got == {i: want[k] for i, (_, want) in enumerate(CELLS)}


def test_centre_lies_in_its_cell(spark):
    df = spark.range(12 * 4**3).withColumnRenamed("id", "cell")
    back = healpix.with_cell(healpix.with_centre(df, "cell", 3), "centre_ra", "centre_dec", 3, "again")
    assert back.where("cell <> again").count() == 0


def test_distances(spark):
    row = spark.range(1).select(geo.great_circle_km(F.lit(46.2), F.lit(6.1), F.lit(46.3), F.lit(6.1)).alias("a"), geo.great_circle_km(F.lit(46.0), F.lit(6.0), F.lit(46.0), F.lit(7.0)).alias("b")).first()
    assert row.a == pytest.approx(11.119508023352598, abs=1e-9) and row.b == pytest.approx(77.24208592735414, abs=1e-9)


def test_days(spark):
    row = spark.range(1).select(astro.day_number(F.lit(dt.datetime(2000, 1, 1)).cast("timestamp_ntz")).alias("d"), astro.julian_day(F.lit(dt.datetime(1970, 1, 1)).cast("timestamp_ntz")).alias("j")).first()
    assert (row.d, row.j) == (1.0, 2440587.5)
    assert sky.day_of(dt.datetime(2000, 1, 1)) == 1.0


METRICS = dict(matched_stars=80, wcs_rms_px=0.5, usable_coverage=0.9, fwhm_arcsec=2.1, pixel_scale_arcsec=1.5, native_pixel_scale_arcsec=1.5, eccentricity=0.35, saturated_fraction=0.002, clipped_black_fraction=0.001, signal_to_noise=30.0, metadata_complete=True, licence_accepted=True, trusted_astrometry=False, calibrated_science_product=False, has_major_tracking_error=False, has_dense_clouds=False, duplicate_detected=False)


def qualified(spark, **changes):
    row = METRICS | changes
    return policy.qualified(spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'int' if isinstance(v, int) else 'double'}" for k, v in METRICS.items()))).first()


def test_quality(spark):
    good = qualified(spark)
    assert (good.score, good.eligible, good.resolution_class, good.blockers) == (80, True, "high-definition", "")
    upscaled = qualified(spark, native_pixel_scale_arcsec=6.0)
    assert upscaled.resolution_class == "wide-field" and "artificial-upscale" in upscaled.blockers
    assert qualified(spark, matched_stars=0, trusted_astrometry=True).eligible
    assert qualified(spark, matched_stars=0).blockers == "insufficient-reference-stars"


def test_relevance(spark):
    def relevant(title, terms):
        return spark.range(1).select(text.is_relevant(F.lit(title), F.lit(""), terms).alias("r")).first().r

    assert relevant("NGC6960 in Cygnus", ["NGC 6960"]) and not relevant("NGC 6960 finder chart", ["NGC 6960"]) and not relevant("Andromeda", ["Androm"])
    assert not relevant("Andromède", []) and relevant("La galaxie d'Andromède", ["andromede"])


def test_tile_paths(spark):
    paths = ["Norder9/Dir210000/Npix211675.webp", "Norder9/Dir200000/Npix211675.webp", "Norder10/Dir0/Npix1.webp", "Norder1/Dir0/Npix48.webp"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select("path", healpix.parsed_path(F.col("path")).alias("p")).collect()
    assert {r.path: tuple(r.p) if r.p else None for r in rows} == {paths[0]: (9, 211675)} | dict.fromkeys(paths[1:])


def test_pyramid_is_closed(spark):
    top = spark.createDataFrame([(9, i) for i in (173380, 173381, 173400, 180000)], "order int, index bigint")
    whole = mosaic.pyramid(top, 6)
    assert mosaic.orphans(whole, 6, 9).count() == 0
    assert {r.problem: r.n for r in mosaic.violations(whole, whole.where("order <> 7"), 6, 9).collect()} == {"tile-missing": whole.where("order = 7").count(), "no-parent": whole.where("order = 8").count(), "no-child": whole.where("order = 6").count()}


def test_triangulation(spark):
    obs = [(1, 11, "meteor", dt.datetime(2024, 1, 1), 46.0, 6.0, 400.0, 90.0, 45.0, "pending"), (2, 12, "meteor", dt.datetime(2024, 1, 1, 0, 5), 46.0, 7.0, 400.0, 270.0, 45.0, "pending"), (3, 12, "aurora", dt.datetime(2024, 1, 1), 46.0, 6.0, 0.0, 0.0, 45.0, "pending")]
    df = spark.createDataFrame(obs, "observation_id long, user_id long, phenomenon string, observed_at timestamp_ntz, latitude double, longitude double, altitude_m double, azimuth double, elevation double, status string")
    pairs = feeds.near_pairs(df)
    assert {(r.observation_id, r.other_id) for r in pairs.collect()} == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)}
    assert {r.observation_id for r in feeds.clusters(pairs).collect()} == {1, 2}
    point = feeds.triangulated(pairs).where("observation_id = 1").first()
    assert 30 < point.altitude_km < 50 and point.error_km < 1 and point.longitude == pytest.approx(6.5, abs=0.01)


def test_transitions():
    assert sum(map(len, jobs.TRANSITIONS.values())) == 44
    assert "duplicate" in jobs.TRANSITIONS["uploaded"] and "uploaded" in jobs.TRANSITIONS["failed"]


def test_stacking(spark):
    rows = [(f, y, x, 10.0 if f < 6 else 10000.0, 1.0) for f in range(1, 7) for y in range(8) for x in range(8)]
    df = spark.createDataFrame(rows, "frame int, y int, x int, value double, weight double")
    assert {r.value for r in raster.sigma_clipped(df).collect()} == {10.0}
    level = lambda v: spark.createDataFrame([(y, x, v) for y in range(4) for x in range(4)], "y int, x int, value double")
    light = level(110.0).withColumn("frame", F.lit(1))
    assert {r.value for r in raster.calibrated(light, level(10.0), level(5.0), level(2.0)).collect()} == {95.0}
    masked = df.withColumn("value", F.when(F.col("frame") == 1, float("nan")).otherwise(F.col("value")))
    assert raster.coadded(masked.where("frame <= 3")).agg(F.max("depth")).first()[0] == 2


def test_upsert_and_append(spark):
    now = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, version int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 1), (1, "old", 0)], "id int, v string, version int")
    assert {r.id: r.v for r in jobs.upserted(now, new, "id", "version").collect()} == {1: "a", 2: "c", 3: "d"}
    assert [r.id for r in jobs.appended(now, new, ["id"]).collect()] == [3]


def test_unset_flags_and_unmeasured_values(spark):
    assert qualified(spark, licence_accepted=None).blockers == "missing-licence"
    unknown = qualified(spark, licence_accepted=None, trusted_astrometry=None, matched_stars=0)
    assert unknown.blockers == "insufficient-reference-stars,missing-licence" and not unknown.eligible
    assert qualified(spark, duplicate_detected=None).eligible and qualified(spark, fwhm_arcsec=None).score < 80
    halves = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,), (2.675,)], "x double").select("x", maths.half_even(F.col("x")).alias("e"), maths.half_up(F.col("x")).alias("u")).collect()
    assert [(r.e, r.u) for r in halves] == [(0.0, 1.0), (2.0, 2.0), (2.0, 3.0), (0.0, 0.0), (3.0, 3.0)]


def test_letters_with_marks(spark):
    row = spark.range(1).select(text.normalise(F.lit("  Ångström — Ño été Żółw ")).alias("n"), text.safe_name(F.lit("Ｍ31² né́e/x")).alias("f"), text.is_relevant(F.lit("Star chart of NGC 6960"), F.lit(""), ["NGC 6960"]).alias("r")).first()
    assert (row.n, row.f, row.r) == ("angstrom no ete zo w", "M312-n-e-x", False)


def test_cells_around_a_place_hold_all_that_is_near(spark):
    places = [(0.0, 0.0), (46.0, 6.0), (46.0, 359.9), (89.0, 10.0), (-88.5, 200.0), (10.0, -179.9), (60.0, 4.999)]
    near = [(lat + i, lon + j) for lat, lon in places for i in (-4, -2, 0, 1.5, 4) for j in (-170, -9, -3, 0, 0.2, 5, 100) if -90 <= lat + i <= 90]
    a = spark.createDataFrame(places, "a double, o double").withColumn("cells", geo.cells_around(F.col("a"), F.col("o"), 500.0))
    b = spark.createDataFrame(near, "a2 double, o2 double").withColumn("cell", geo.place_cell(F.col("a2"), F.col("o2")))
    met = a.join(b, F.lit(True)).where(geo.great_circle_km(F.col("a"), F.col("o"), F.col("a2"), F.col("o2")) <= 500)
    assert met.count() > 50 and met.where(~F.array_contains("cells", F.col("cell"))).count() == 0
    assert a.where(F.size(F.array_distinct("cells")) != F.size("cells")).count() == 0


def test_views_go_there_and_back(spark):
    x, y, _ = geo.stereographic(F.col("alt"), F.col("az"), 35.0, 120.0)
    rows = spark.createDataFrame([(10.0, 100.0), (35.0, 120.0), (70.0, 300.0), (-5.0, 60.0)], "alt double, az double").withColumns({"x": x, "y": y})
    back = rows.select("alt", "az", *(c.alias(n) for c, n in zip(geo.view_direction(F.col("x"), F.col("y"), 35.0, 120.0), ("alt2", "az2"), strict=True)))
    assert all(r.alt == pytest.approx(r.alt2, abs=1e-9) and r.az == pytest.approx(r.az2, abs=1e-9) for r in back.collect())


def test_corners_surround_their_centre(spark):
    cells = healpix.with_corners(healpix.with_centre(spark.range(12 * 4**3).withColumnRenamed("id", "cell"), "cell", 3), "cell", 3)
    corner = cells.select("cell", "centre_ra", "centre_dec", F.posexplode("corners").alias("k", "c")).withColumn("far", geo.separation_deg(F.col("c.ra"), F.col("c.dec"), F.col("centre_ra"), F.col("centre_dec")))
    assert corner.agg(F.max("far")).first()[0] <= healpix.widest_radius(3) + 1e-9
    order = corner.groupBy("cell").agg(F.max_by("k", "c.dec").alias("north"), F.min_by("k", "c.dec").alias("south")).select("north", "south").distinct().collect()
    assert [tuple(r) for r in order] == [(0, 2)]


def test_detections_find_the_spots(spark):
    rows = [(1, y, x, 5.0 + (x * 7 + y * 3) % 4) for y in range(60) for x in range(60)]
    spots = [(10, 10), (10, 40), (30, 25), (45, 12), (50, 50), (20, 55)]
    rows = [(f, y, x, v + sum(400.0 * 2.0 ** -((y - sy) ** 2 + (x - sx) ** 2) for sy, sx in spots)) for f, y, x, v in rows]
    stars = tiling.detected(spark.createDataFrame(rows, "frame int, y int, x int, value double"))
    assert {(r.y, r.x) for r in stars.collect()} == set(spots)
    quality = tiling.frame_quality(stars, 2.0).first()
    assert quality.stars == 6 and 3 < quality.fwhm_arcsec < 6 and quality.eccentricity < 0.4 and quality.signal_to_noise > 50


def test_activation_and_its_problems(spark):
    sha = "a" * 64
    plan = spark.createDataFrame([(1, 8, 4), (1, 9, 16), (1, 9, 17)], "generation int, order int, index bigint")
    hashes = activation.plan_sha256(plan).first().sha256
    inventory = spark.createDataFrame([(1, 11, 3600.0, 2, "v9"), (1, 12, 0.0, 2, "v9")], "generation int, source int, exposure_s double, eligible_cells int, solution_version string")
    frozen = activation.inventory_sha256(inventory).first().sha256
    generation = (1, "M31", "v9", "verifying", True, "m.json", sha, 0, True, hashes, 3, 3, 3, 2, 2, frozen)
    fields = "generation int, object_id string, version string, status string, locked boolean, manifest_path string, manifest_sha256 string, failed_tiles int, validated boolean, plan_sha256 string, planned_tiles int, expected_tiles int, published_tiles int, expected_sources int, contributing_sources int, inventory_sha256 string"
    tiles = spark.createDataFrame([(1, o, i, sha, f"t{i}", [11, 12], {11: 0.5, 12: 0.5}) for o, i in ((8, 4), (9, 16), (9, 17))], "generation int, order int, index bigint, sha256 string, path string, sources array<int>, weights map<int,double>")
    stored = spark.createDataFrame([("m.json",), ("f",), ("p",), ("t4",), ("t16",), ("t17",)], "path string")
    masters = spark.createDataFrame([(1, "M31", False, 2, 1.0, "f", sha, "p", sha, 1.0, False, 0.25, 10, 10)], "generation int, object_id string, is_current boolean, lights int, hours double, fits_path string, fits_sha256 string, preview_path string, preview_sha256 string, covered double, partial boolean, scale double, width int, height int")

    def problems(generation=generation, plan=plan, tiles=tiles, inventory=inventory, stored=stored, masters=masters):
        return {r.problem for r in activation.activation_problems(spark.createDataFrame([generation], fields), plan, tiles, inventory, stored, masters).collect()}

    assert problems() == set()
    assert problems(generation=(*generation[:3], "building", *generation[4:])) == {"not-ready"}
    assert problems(tiles=tiles.where("index <> 17")) == {"tile-counts", "tile-missing"}
    assert problems(tiles=tiles.withColumn("weights", F.expr("map(11, 1.0D)"))) == {"no-weight"}
    assert problems(tiles=tiles.withColumns({"sources": F.expr("array(11)")})) == {"source-counts", "source-sets"}
    assert problems(stored=stored.where("path <> 'p'")) == {"master-not-stored"}
    assert problems(masters=masters.withColumn("is_current", F.lit(True))) == {"master"}
    assert problems(inventory=inventory.withColumn("solution_version", F.lit("v8"))) == {"solution-version"}
    assert problems(plan=plan.where("order = 9")) == {"plan-hash", "planned-counts", "tile-unexpected"}
    now = spark.createDataFrame([("a", 1, 5, "complete"), ("a", 2, 6, "verifying"), ("a", 3, 7, "verifying"), ("b", 1, 8, "complete"), ("b", 2, 9, "verifying")], "layer string, number int, generation int, status string")
    broken = spark.createDataFrame([(7, "inventory"), (9, "master")], "generation int, problem string")
    assert {r.generation: (r.status, r.is_current) for r in activation.activated(now, broken).collect()} == {5: ("retired", False), 6: ("complete", True), 7: ("failed", False), 8: ("complete", True), 9: ("failed", False)}


def test_streamed_digests(spark):
    rows = spark.range(30_000).select((F.col("id") % 3).alias("k"), F.col("id").cast("string").alias("item"), "id").repartition(5)
    got = {r.k: (r.n, r.sha256) for r in rollups.streamed_sha256(rows, ["k"], "item", ["id"], "[", ",", "]").collect()}
    assert got == {k: (10_000, hashlib.sha256(("[" + ",".join(str(i) for i in range(k, 30_000, 3)) + "]").encode()).hexdigest()) for k in range(3)}


def test_reprojection_onto_itself(spark):
    wcs = {"ra": 10.0, "dec": 20.0, "x0": 4.0, "y0": 3.0, "sx": -0.01, "sy": 0.01}
    image = spark.createDataFrame([(y, x, float(x * 10 + y)) for y in range(7) for x in range(9)], "y int, x int, value double")
    got = {(r.y, r.x): r.value for r in tiling.aligned(image, wcs, wcs, 9, 7, 0.0).collect()}
    assert len(got) == 63 and all(v == pytest.approx(x * 10 + y, abs=1e-6) for (y, x), v in got.items())
    half = tiling.aligned(image, wcs, {**wcs, "x0": 3.5}, 9, 7).collect()
    assert {(r.y, r.x) for r in half} >= {(y, x) for y in range(1, 6) for x in range(0, 8)} and all(r.value == pytest.approx(r.x * 10 + 5 + r.y, abs=0.01) for r in half)
