"""Files written and read back, inventories, seeds, eligible sources, low-order aggregates and sorted catalogues."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starloom.functions import healpix as H
from starloom.functions.geo import EARTH_KM, cells_around, place_cell, separation_deg
from starloom.functions.maths import half_up, steady
from starloom.operators import archives as V
from starloom.operators import mosaic as M
from starloom.operators import rollups as R
from starloom.operators import sky as K
from starloom.operators import status as P
from starloom.plans.astro import LAT, LON, NOW
from starloom.sources import fits, readers
from starloom.sources import tables as S
from starloom.sources.publication import Published
from starloom.sources.storage import scratch, written


def _pick(key, *values):
    return F.get(F.array(*(F.lit(v) for v in values)), (key % len(values)).cast("int"))


def s01_with_parameters(s, d):
    """A SQL text with parameters over a table."""
    return s.sql("SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most FROM {orders} WHERE o_orderstatus = :state AND o_totalprice > :least GROUP BY o_custkey", args={"state": "O", "least": 1000.0}, orders=S.table(s, d, "orders"))


def fits_files(images: DataFrame, folder: str) -> None:
    """Writes images (name, width, height, values) as FITS files in a folder, each by the task that has it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [readers.fits_bytes(np.array(v, np.float32).reshape(h, w), {"OBJECT": n}) for n, w, h, v in zip(*(batch.column(c).to_pylist() for c in ("name", "width", "height", "values")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(bodies, pa.binary())], ["name", "content"])

    readers.write_objects(images.select("name", "width", "height", "values").mapInArrow(run, "name string, content binary"), folder)


def s04_fits_images(s, d):
    """Images written as FITS files and read back, pixel by pixel."""
    k = F.col("s_suppkey")
    values = F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: ((k * 7 + i * i) % 1000).cast("float"))
    folder = scratch(s, "fits")
    fits_files(S.table(s, d, "supplier").select(F.concat(F.lit("s"), k.cast("string")).alias("name"), F.lit(10).alias("width"), F.lit(6).alias("height"), values.alias("values")), folder)
    rows = readers.read_fits(s, folder)
    return rows.select(F.col("header")["OBJECT"].alias("name"), "y", F.posexplode("values").alias("x", "value")).withColumn("value", F.col("value").cast("double"))


def s04_fits_source(s, d):
    """The same images through the data source, in ranges of a few rows each."""
    k = F.col("s_suppkey")
    values = F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: ((k * 7 + i * i) % 1000).cast("float"))
    folder = scratch(s, "fits")
    fits_files(S.table(s, d, "supplier").select(F.concat(F.lit("s"), k.cast("string")).alias("name"), F.lit(10).alias("width"), F.lit(6).alias("height"), values.alias("values")), folder)
    fits.register(s)
    rows = s.read.format("fits").option("cards", "OBJECT").option("rangeBytes", 3000).load(folder)
    return rows.select(F.col("OBJECT").alias("name"), "y", F.posexplode("values").alias("x", "value")).withColumn("value", F.col("value").cast("double"))


def s07_votables(s, d):
    """A VOTable written and read back; masked cells are null."""
    cell = lambda c: F.concat(F.lit("<TD>"), F.coalesce(c.cast("string"), F.lit("")), F.lit("</TD>"))
    rows = S.table(s, d, "part").select(F.concat(F.lit("<TR>"), cell(F.col("p_partkey")), cell(F.col("p_name")), cell(F.when(F.col("p_size") % 3 > 0, F.col("p_size"))), F.lit("</TR>")).alias("value"))
    folder = scratch(s, "votable")
    readers.write_objects(rows.groupBy((F.crc32(F.encode("value", "utf-8")) % 8).alias("part")).agg(F.concat(F.lit("<TABLEDATA>"), F.array_join(F.collect_list("value"), ""), F.lit("</TABLEDATA>")).alias("t")).select(F.concat(F.lit("part"), F.col("part").cast("string"), F.lit(".xml")).alias("name"), F.encode("t", "utf-8").alias("content")), folder)
    return readers.read_votable(s, folder, ["key", "name", "size"])


def s08_spaced_tables(s, d):
    """A table of fields apart by spaces written and read back; rows with a field missing are left out."""
    k = F.col("s_suppkey")
    line = F.concat_ws(" ", k.cast("string"), F.concat(F.lit("f"), (k % 9).cast("string")), F.when(k % 4 > 0, (k % 5).cast("string")))
    folder = scratch(s, "spaced")
    S.table(s, d, "supplier").select(line.alias("value")).write.text(folder)
    rows = s.read.csv(folder, sep=" ", schema="key string, name string, band string", ignoreLeadingWhiteSpace=True)
    return rows.dropna("any")


def s14_science_files(s, d):
    """Files of a budget that begin as FITS does and are a block long at least."""
    k = F.col("p_partkey")
    rows = S.table(s, d, "part").select("p_partkey", (k % 8).alias("run"), (k * 131 % 9000).alias("size"), _pick(k, "SIMPLE  =  T", "XTENSION= 'IMAGE'", "<html>", None).alias("head"))
    good = rows.where(readers.is_fits(F.col("head"), F.col("size")))
    return readers.within_bytes(good, "run", "p_partkey", "size", 60_000).select("run", "p_partkey", "upto")


def s15_cache_paths(s, d):
    return S.uploads(s, d).select("upload_id", readers.cache_path(F.col("content_sha256")).alias("path"))


def s13_first_files(s, d):
    """Of each position the first file within reach, each file once, known ones left out, the first few by a hash."""
    grid = written(V.target_grid(s, 180.0, 0.0, 900.0, 600.0, 7200), "grid")
    objects = S.objects(s, d).select(F.col("object_id").alias("file"), "ra", "dec")
    near = grid.select("n", F.col("ra").alias("pra"), F.col("dec").alias("pdec"), F.explode(cells_around(F.col("dec"), F.col("ra"), math.radians(10.0) * EARTH_KM)).alias("cell"))
    met = near.join(objects.withColumn("cell", place_cell(F.col("dec"), F.col("ra"))), "cell").where(separation_deg(F.col("ra"), F.col("dec"), F.col("pra"), F.col("pdec")) <= 10)
    first = met.groupBy("n").agg(F.min("file").alias("file")).select("file").distinct()
    known = objects.where("file % 4 = 0").select("file")
    return V.unseen_first(first, known, "file", "files", 20).select("file")


def s18_master_files(s, d):
    """Masters as FITS bytes with checksum cards: the same pixels always give the same bytes."""
    k = F.col("s_suppkey")
    values = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: ((k + i) % 50).cast("float"))
    rows = S.table(s, d, "supplier").select(k.alias("name"), values.alias("values"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [readers.with_checksums(np.array(v, np.float32).reshape(4, 5), {}) for v in batch.column("values").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(bodies, pa.binary())], ["name", "content"])

    return rows.mapInArrow(run, "name long, content binary").select("name", F.length("content").cast("bigint").alias("bytes"), F.substring("content", 1, 9).cast("string").alias("head"), F.sha2("content", 256).alias("sha256"))


def s21_tree_inventory(s, d):
    """Path, checksum and size of every object of a published tree."""
    tiles = M.object_cells(S.objects(s, d), (8,)).select(F.col("cell8").alias("index")).distinct()
    body = F.repeat(F.col("index").cast("string"), F.lit(3))
    return tiles.select(H.tile_path("sky-r", 2, F.lit(8), F.col("index")).alias("path"), F.sha2(body, 256).alias("sha256"), F.octet_length(body).cast("bigint").alias("byte_size"))


def s22_pointer(s, d):
    """A pointer that moves with each generation, in one step: readers see the last one, and find one at any time."""
    place = Published(s, scratch(s, "pointer"))
    newest = None
    for part in range(3):
        newest = S.table(s, d, "orders").where(F.col("o_orderkey") % 3 <= part).agg(F.max("o_orderkey").alias("generation"), F.count(F.lit(1)).alias("sources"))
        place.publish(newest)
    return place.read(newest.schema)


def s25_federated(s, d):
    """Rows of all sources that answered; a source that failed is left out, and only if all fail is that an error."""
    broken = scratch(s, "broken-source")
    s.createDataFrame([("not a Parquet file",)], "value string").write.text(broken)

    def source(n: int) -> DataFrame:
        if n == 2:  # breaks while it is read
            return s.read.schema("p_partkey long, source int").parquet(broken)
        return S.table(s, d, "part").where(F.col("p_partkey") % 4 == n).select("p_partkey", F.lit(n).alias("source"))

    return readers.answered([lambda n=n: source(n) for n in range(4)])


def s26_batched_lookup(s, d):
    """Tiles of many requested cells in one join, whatever their number."""
    asked = M.object_cells(S.objects(s, d), (8,)).select(F.col("cell8").alias("index")).unionByName(s.range(5000).select((F.col("id") * 37).alias("index"))).distinct()
    tiles = M.tiles(S.frames(s, d), S.objects(s, d)).where("order = 8").groupBy("index").agg(F.count(F.lit(1)).alias("n_tiles"))
    return tiles.join(asked, "index", "left_semi")


def p37_eligible_sources(s, d):
    """Published archive lights that may enter a public survey: all twelve conditions."""
    k = F.col("upload_id")
    u = S.uploads(s, d).withColumns({"solved": k % 4 > 0, "band": _pick(F.floor(k / 4), "R", "r", "g", None), "storage_path": F.when(k % 13 > 0, F.concat(F.lit("raw/"), k.cast("string"))), "attribution": F.when(k % 7 > 0, "survey"), "rights": F.when(k % 5 > 0, "https://example.org/terms"), "licence": F.when(k % 2 == 0, "PUBLIC-ARCHIVE").otherwise(F.col("licence"))})
    return u.where(R.eligible_source("r")).select("upload_id", "storage_path", "content_sha256", "size_bytes")


def p34_seed_targets(s, d):
    """Seed cells between two declinations that hold no object yet, spread by a hash."""
    held = M.object_cells(S.objects(s, d), (4,)).select(F.col("cell4").alias("index")).distinct()
    cells = H.with_centre(s.range(H.n_cells(4)).select(F.col("id").alias("index")), "index", 4)
    seeds = written(cells.where(F.col("centre_dec").between(-29.0, 85.0)).select("index"), "seeds")  # the optimiser can't reason about a join over so long a filter
    return seeds.join(held, "index", "left_anti").select("index", F.sha2(F.concat(F.lit("sky-seed-v1:4:"), F.col("index").cast("string")), 256).alias("spread"))


def q29_component_tiles(s, d):
    """Low-order tiles with the share of each contributor, summed over their parts and normalised."""
    shares = M.attribution(M.frame_cells(S.frames(s, d), S.objects(s, d), (9,)))
    return reduce(DataFrame.unionByName, (M.to_ancestors(shares, o) for o in (3, 4))).withColumn("share", steady(F.col("share"), 7))


def a09_plan_json(s, d):
    """Each generation's normalised plan: distinct cells as JSON in order, with bounds, count and hash."""
    cells = M.object_cells(S.objects(s, d), (9,)).select((F.col("object_id") % 25).alias("generation"), F.lit(9).alias("order"), F.col("cell9").alias("index")).distinct()
    rows = cells.withColumn("row", F.concat(F.lit('{"index": '), F.col("index").cast("string"), F.lit(', "order": 9}')))
    hashed = R.streamed_sha256(rows, ["generation"], "row", ["order", "index"], "[", ", ", "]")
    return hashed.join(cells.groupBy("generation").agg(F.min("index").alias("low"), F.max("index").alias("high")), "generation")


def a27_cell_weights(s, d):
    """Coverage of each source in each cell, and its normalised weight."""
    cells = M.frame_cells(S.frames(s, d), S.objects(s, d), (8,)).groupBy("index", "user_id").agg(F.max("coverage").alias("coverage"))
    total = F.sum("coverage").over(W.partitionBy("index"))
    weight = F.when(total > 0, F.col("coverage") / total).otherwise(1 / F.count(F.lit(1)).over(W.partitionBy("index")))
    return cells.select("index", "user_id", "coverage", steady(weight, 9).alias("weight"))


def t07_by_name(s, d):
    """Objects by name as French sorts it, accents and case apart last."""
    k = F.col("object_id")
    named = S.objects(s, d).select("object_id", F.concat(_pick(k, "Étoile ", "eta ", "Zeta ", "alpha ", "Écu ", "Étoile "), (k % 40).cast("string")).alias("name"))
    return named.orderBy(F.collate("name", "fr"), "object_id").limit(60).select("object_id", "name")


def q35_tool_answers(s, d):
    """The five highest objects of each family at a moment."""
    up = K.positions_at(S.objects(s, d), NOW, LAT, LON).where("alt > 10")
    best = up.withColumn("place", F.row_number().over(W.partitionBy("family").orderBy(half_up(F.col("alt"), 6).desc(), "object_id")))
    return best.where("place <= 5").select("family", "place", "object_id")


def q39_run_statuses(s, d):
    """Archive runs with their items by status, newest first."""
    runs = S.table(s, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_at"))
    return runs.join(R.status_map(S.frames(s, d)), "run_id", "left").select("run_id", "started_at", "statuses", F.coalesce("total", F.lit(0)).alias("total")).orderBy(F.col("started_at").desc(), "run_id").limit(200)


def q31_incremental_run(s, d):
    """Known records of other runs, and of each the earliest sound upload to use again, for a new run."""
    items = S.table(s, d, "lineitem").select((F.col("l_suppkey") % 40).alias("run"), F.col("l_partkey").alias("record"), F.col("l_orderkey").alias("upload_id"), F.col("l_shipdate").alias("created_at"))
    others = items.where("run <> 7")
    sound = S.uploads(s, d).where("status in ('approved', 'published', 'stacked') and not rejected and deleted_at is null").select("upload_id")
    reuse = others.join(sound, "upload_id").groupBy("record").agg(F.min(F.struct("created_at", "upload_id")).alias("e")).select("record", F.col("e.upload_id").alias("reused"))
    return others.select("record").distinct().join(reuse, "record", "left").join(items.where("run = 7").select("record").distinct().withColumn("there", F.lit(True)), "record", "left").select("record", "reused", F.coalesce("there", F.lit(False)).alias("already_there"))


def j11_exists(s, d):
    """Contributors with an open job of their own, and no failed one."""
    jobs = S.jobs(s, d)
    users = S.table(s, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return users.join(jobs.where("status = 'solving'"), "user_id", "left_semi").join(jobs.where("status = 'failed'"), "user_id", "left_anti")


def j21_updated(s, d):
    """Uploads updated from their jobs: the newest job's status wins."""
    newest = P.latest(S.jobs(s, d).select(F.col("user_id").alias("owner"), "available_at", "job_id", F.col("status").alias("new_status")), "owner", ["available_at", "job_id"])
    u = S.uploads(s, d).select("upload_id", "user_id", "status")
    return u.join(newest, u["user_id"] == newest["owner"], "left").select("upload_id", F.when(F.col("status") == "uploaded", F.coalesce("new_status", "status")).otherwise(F.col("status")).alias("status"))


def u5_compare_and_set(s, d):
    """Changes that name the version they saw and hold the lease: applied, or the reason why not."""
    jobs = S.jobs(s, d).withColumn("leased_by", _pick(F.col("job_id"), "w1", "w2", None))
    changes = S.table(s, d, "orders").select(F.col("o_orderkey").alias("job_id"), (F.col("o_orderkey") % 7).cast("int").alias("seen"), _pick(F.floor(F.col("o_orderkey") / 3), "w1", "w2").alias("worker"))
    outcome = F.when(~F.col("leased_by").eqNullSafe(F.col("worker")), "not-leased").when(F.col("version") != F.col("seen"), "stale").otherwise("applied")
    return jobs.join(changes, "job_id").select("job_id", outcome.alias("outcome"), (F.col("version") + (outcome == "applied").cast("int")).alias("version"))


def e27_retried_runs(s, d):
    """The newest failed run of each object, to be tried again."""
    failed = S.jobs(s, d).where("status = 'failed'").select("object_id", "available_at", "job_id", "attempts")
    return P.latest(failed, "object_id", ["available_at", "job_id"]).select("object_id", "job_id", F.lit("uploaded").alias("status"), F.lit(0).alias("attempts"))


def e35_eligible_tiles(s, d):
    """Tiles only of cells that are covered well enough."""
    return M.frame_cells(S.frames(s, d), S.objects(s, d), (8,)).where("coverage >= 0.07").select("order", "index").distinct()


def e52_plan_hashes(s, d):
    """Hash and bounds of the cells of each order."""
    cells = M.pyramid(M.object_cells(S.objects(s, d), (9,)).select(F.lit(9).alias("order"), F.col("cell9").alias("index")), 6)
    rows = cells.withColumn("row", F.to_json(F.struct("index", "order")))
    return R.streamed_sha256(rows, ["order"], "row", ["index"], "[", ",", "]").join(M.counts_by_order(cells), "order").select("order", "n", "sha256", "first_index", "last_index")


def e51_allsky_tiles(s, d):
    """Places of an aggregate layer's tiles in the all-sky picture of its order, uncovered ones included."""
    cells = M.object_cells(S.objects(s, d), (3,)).select(F.col("cell3").alias("index")).distinct().withColumn("covered", F.lit(True))
    columns = int((12 * 4**3) ** 0.5)
    return s.range(H.n_cells(3)).select(F.col("id").alias("index")).join(cells, "index", "left").select("index", (F.col("index") % columns).alias("column"), F.floor(F.col("index") / columns).alias("row"), F.coalesce("covered", F.lit(False)).alias("covered"))


def r19_wcs_agreement(s, d):
    """How far a stored and a header's geometry lie apart on three by three points, and whether within half an arc second."""
    k = F.col("p_partkey")
    spots = F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (0.0, 500.0, 1000.0) for y in (0.0, 400.0, 800.0))))
    rows = S.table(s, d, "part").select("p_partkey", (k % 10 / 36000.0).alias("off"), spots.alias("p")).select("p_partkey", "off", "p.x", "p.y")
    wcs = {"ra": 120.0, "dec": 30.0, "x0": 500.0, "y0": 400.0, "sx": -0.0005, "sy": 0.0005}
    ra, dec = V.pixel_to_sky(F.col("x"), F.col("y"), wcs)
    moved = V.pixel_to_sky(F.col("x") + F.col("off") / 0.0005, F.col("y"), wcs)
    h = F.pow(F.sin(F.radians((moved[1] - dec) / 2)), 2) + F.cos(F.radians(dec)) * F.cos(F.radians(moved[1])) * F.pow(F.sin(F.radians((moved[0] - ra) / 2)), 2)
    arcsec = F.degrees(2 * F.asin(F.sqrt(h))) * 3600
    worst = rows.select("p_partkey", arcsec.alias("a")).groupBy("p_partkey").agg(F.max("a").alias("worst"))
    return worst.select("p_partkey", steady(F.col("worst"), 5).alias("worst"), (F.col("worst") <= 0.55).alias("agrees"))


QUERIES = {
    f.__name__: f
    for f in (
        s01_with_parameters, s04_fits_images, s04_fits_source, s07_votables, s08_spaced_tables, s13_first_files, s14_science_files, s15_cache_paths, s18_master_files, s21_tree_inventory, s22_pointer, s25_federated, s26_batched_lookup, p34_seed_targets, p37_eligible_sources, q29_component_tiles, q31_incremental_run, q35_tool_answers, q39_run_statuses,
        a09_plan_json, a27_cell_weights, t07_by_name, j11_exists, j21_updated, u5_compare_and_set, e27_retried_runs, e35_eligible_tiles, e51_allsky_tiles, e52_plan_hashes, r19_wcs_agreement,
    )
}

from starloom.plans.archives import _sky_sql  # noqa: E402
from starloom.plans.astro import _ALTAZ  # noqa: E402
from starloom.plans.mosaic import _BASE, _COVER, _PYRAMID, _SHARES, _cell_sql  # noqa: E402

_ELIGIBLE = "status IN ('approved', 'published', 'stacked') AND NOT rejected"
_WCS = {"ra": 120.0, "dec": 30.0, "x0": 500.0, "y0": 400.0, "sx": -0.0005, "sy": 0.0005}
_A, _B = _sky_sql(_WCS, "x", "y"), _sky_sql(_WCS, "(x + off / 0.0005::DOUBLE)", "y")
_R = lambda x, n: f"floor(({x}) * 1e{n} + 0.3137) / 1e{n}"
_UP = lambda o: f"""SELECT CAST({o} AS INT) AS "order", "index" >> {2 * (9 - o)} AS "index", user_id, sum(share) AS t FROM shares GROUP BY ALL"""
_GRID = f"""g AS (SELECT i, j, (i - (nx - 1) / 2.0::DOUBLE) * 25.5::DOUBLE AS x, (j - (ny - 1) / 2.0::DOUBLE) * 25.5::DOUBLE AS y FROM (SELECT 36 AS nx, 24 AS ny), range(0, 36) a(i), range(0, 24) b(j)), grid AS (SELECT row_number() OVER () AS object_id, fmod(180 + x / 60 + 360, 360) AS ra, y / 60 AS "dec" FROM g)"""

ORACLES = {
    "s01_with_parameters": "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 1000 GROUP BY o_custkey",
    "s04_fits_source": "SELECT 's' || s_suppkey AS name, i // 10 AS y, i % 10 AS x, CAST((s_suppkey * 7 + i * i) % 1000 AS DOUBLE) AS value FROM supplier, range(0, 60) r(i)",
    "s04_fits_images": "SELECT 's' || s_suppkey AS name, i // 10 AS y, i % 10 AS x, CAST((s_suppkey * 7 + i * i) % 1000 AS DOUBLE) AS value FROM supplier, range(0, 60) r(i)",
    "s07_votables": "SELECT CAST(p_partkey AS VARCHAR) AS key, p_name AS name, CASE WHEN p_size % 3 > 0 THEN CAST(p_size AS VARCHAR) END AS size FROM part",
    "s08_spaced_tables": "SELECT CAST(s_suppkey AS VARCHAR) AS key, 'f' || s_suppkey % 9 AS name, CAST(s_suppkey % 5 AS VARCHAR) AS band FROM supplier WHERE s_suppkey % 4 > 0",
    "s13_first_files": f"""WITH {S.OBJECTS}, {_GRID}, m AS (SELECT g.object_id AS n, min(o.object_id) AS file FROM grid g JOIN objects o ON degrees(acos(least(greatest(sin(radians(o."dec")) * sin(radians(g."dec")) + cos(radians(o."dec")) * cos(radians(g."dec")) * cos(radians(o.ra - g.ra)), -1), 1))) <= 10 GROUP BY g.object_id)
        SELECT file FROM (SELECT DISTINCT file FROM m WHERE file % 4 <> 0) ORDER BY sha256('files:' || file) LIMIT 20""",
    "s14_science_files": "WITH f AS (SELECT p_partkey % 8 AS run, p_partkey, sum(p_partkey * 131 % 9000) OVER (PARTITION BY p_partkey % 8 ORDER BY p_partkey) AS upto FROM part WHERE p_partkey % 4 < 2 AND p_partkey * 131 % 9000 >= 2880) SELECT run, p_partkey, CAST(upto AS BIGINT) AS upto FROM f WHERE upto <= 60000",
    "s15_cache_paths": f"WITH {S.UPLOADS} SELECT upload_id, left(content_sha256, 2) || '/' || content_sha256 AS path FROM uploads",
    "s21_tree_inventory": f"""WITH {_BASE}, t AS (SELECT DISTINCT "index" >> 2 AS i FROM cell) SELECT format('hips/sky-r/2/Norder8/Dir{{}}/Npix{{}}.webp', i // 10000 * 10000, i) AS path, sha256(repeat(CAST(i AS VARCHAR), 3)) AS sha256, CAST(length(CAST(i AS VARCHAR)) * 3 AS BIGINT) AS byte_size FROM t""",
    "s22_pointer": "SELECT max(o_orderkey) AS generation, count(*) AS sources FROM orders",
    "s25_federated": "SELECT p_partkey, CAST(p_partkey % 4 AS INT) AS source FROM part WHERE p_partkey % 4 <> 2",
    "s26_batched_lookup": f"""WITH {_BASE}, {S.FRAMES}, {_COVER} SELECT "index", count(DISTINCT object_id) AS n_tiles FROM frame_cells WHERE "order" = 8 GROUP BY "index" """,
    "p37_eligible_sources": f"""WITH {S.UPLOADS} SELECT upload_id, 'raw/' || upload_id AS storage_path, content_sha256, size_bytes FROM uploads WHERE source_kind = 'public_archive' AND kind = 'light' AND status = 'published' AND NOT rejected AND upload_id % 4 > 0 AND deleted_at IS NULL AND upload_id % 2 = 0 AND upload_id // 4 % 4 < 2
        AND upload_id % 13 > 0 AND upload_id % 7 > 0 AND upload_id % 5 > 0 AND size_bytes > 0""",
    "q29_component_tiles": f"""WITH {_BASE}, {S.FRAMES}, {_COVER}, {_SHARES}, u AS ({_UP(3)} UNION ALL {_UP(4)}) SELECT "order", "index", user_id, {_R('t / sum(t) OVER (PARTITION BY "order", "index")', 7)} AS share FROM u""",
    "q31_incremental_run": f"""WITH {S.UPLOADS}, i AS (SELECT l_suppkey % 40 AS run, l_partkey AS record, l_orderkey AS upload_id, l_shipdate AS created_at FROM lineitem), r AS (SELECT record, arg_min(i.upload_id, (created_at, i.upload_id)) AS reused FROM i JOIN uploads u ON u.upload_id = i.upload_id AND {_ELIGIBLE} AND deleted_at IS NULL WHERE run <> 7 GROUP BY record)
        SELECT o.record, reused, o.record IN (SELECT record FROM i WHERE run = 7) AS already_there FROM (SELECT DISTINCT record FROM i WHERE run <> 7) o LEFT JOIN r USING (record)""",
    "q35_tool_answers": f"WITH {S.OBJECTS}, {_ALTAZ} SELECT family, CAST(row_number() OVER (PARTITION BY family ORDER BY floor(alt * 1e6 + 0.5) DESC, object_id) AS INT) AS place, object_id FROM sky WHERE alt > 10 QUALIFY place <= 5",
    "q39_run_statuses": f"""WITH {S.FRAMES}, c AS (SELECT run_id, status || '=' || count(*) AS e, count(*) AS n FROM frames GROUP BY run_id, status), m AS (SELECT run_id, string_agg(e, ',' ORDER BY e) AS statuses, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY run_id)
        SELECT o_orderkey AS run_id, o_orderdate AS started_at, statuses, coalesce(total, 0) AS total FROM orders LEFT JOIN m ON run_id = o_orderkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 200""",
    "a09_plan_json": f"""WITH {_BASE}, c AS (SELECT DISTINCT object_id % 25 AS generation, "index" AS i FROM cell) SELECT generation, count(*) AS n, sha256('[' || string_agg('{{"index": ' || i || ', "order": 9}}', ', ' ORDER BY i) || ']') AS sha256, min(i) AS low, max(i) AS high FROM c GROUP BY generation""",
    "a27_cell_weights": f"""WITH {_BASE}, {S.FRAMES}, {_COVER}, c AS (SELECT "index", user_id, max(coverage) AS coverage FROM frame_cells WHERE "order" = 8 GROUP BY ALL), w AS (SELECT *, sum(coverage) OVER p AS t, count(*) OVER p AS n FROM c WINDOW p AS (PARTITION BY "index"))
        SELECT "index", user_id, coverage, {_R("CASE WHEN t > 0 THEN coverage / t ELSE 1 / n END", 9)} AS weight FROM w""",
    "t07_by_name": """WITH n AS (SELECT p_partkey AS object_id, (['Étoile ', 'eta ', 'Zeta ', 'alpha ', 'Écu ', 'Étoile '])[p_partkey % 6 + 1] || p_partkey % 40 AS name FROM part) SELECT object_id, name FROM n ORDER BY name COLLATE fr, object_id LIMIT 60""",
    "j11_exists": f"WITH {S.JOBS} SELECT c_custkey AS user_id FROM customer WHERE c_custkey IN (SELECT user_id FROM jobs WHERE status = 'solving') AND c_custkey NOT IN (SELECT user_id FROM jobs WHERE status = 'failed')",
    "j21_updated": f"WITH {S.UPLOADS}, {S.JOBS}, n AS (SELECT user_id, arg_max(status, (available_at, job_id)) AS s FROM jobs GROUP BY user_id) SELECT upload_id, CASE WHEN status = 'uploaded' THEN coalesce(s, status) ELSE status END AS status FROM uploads LEFT JOIN n USING (user_id)",
    "u5_compare_and_set": f"""WITH {S.JOBS}, o AS (SELECT job_id, version, CASE WHEN (['w1', 'w2', NULL])[job_id % 3 + 1] IS DISTINCT FROM (['w1', 'w2'])[job_id // 3 % 2 + 1] THEN 'not-leased' WHEN version <> job_id % 7 THEN 'stale' ELSE 'applied' END AS outcome FROM jobs) SELECT job_id, outcome, version + CASE WHEN outcome = 'applied' THEN 1 ELSE 0 END AS version FROM o""",
    "e27_retried_runs": f"WITH {S.JOBS} SELECT object_id, job_id, 'uploaded' AS status, 0 AS attempts FROM jobs WHERE status = 'failed' QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY available_at DESC, job_id DESC) = 1",
    "e35_eligible_tiles": f"""WITH {_BASE}, {S.FRAMES}, {_COVER} SELECT DISTINCT "order", "index" FROM frame_cells WHERE "order" = 8 AND coverage >= 0.07::DOUBLE""",
    "e51_allsky_tiles": f"""WITH {_BASE} SELECT i AS index, i % 27 AS "column", i // 27 AS "row", i IN (SELECT "index" >> 12 FROM cell) AS covered FROM range(0, 768) r(i)""",
    "e52_plan_hashes": f"""WITH {_BASE}, {_PYRAMID(6)} SELECT "order", count(*) AS n, sha256('[' || string_agg('{{"index":' || "index" || ',"order":' || "order" || '}}', ',' ORDER BY "index") || ']') AS sha256, min("index") AS first_index, max("index") AS last_index FROM pyramid GROUP BY "order" """,
    "r19_wcs_agreement": f"""WITH p AS (SELECT p_partkey, p_partkey % 10 / 36000.0::DOUBLE AS off, x::DOUBLE AS x, y::DOUBLE AS y FROM part, (VALUES (0), (500), (1000)) a(x), (VALUES (0), (400), (800)) b(y)), q AS (SELECT p_partkey, {_A[0]} AS ra, {_A[1]} AS "dec", {_B[0]} AS mra, {_B[1]} AS mdec FROM p),
        s AS (SELECT p_partkey, max(degrees(2 * asin(sqrt(pow(sin(radians((mdec - "dec") / 2)), 2) + cos(radians("dec")) * cos(radians(mdec)) * pow(sin(radians((mra - ra) / 2)), 2)))) * 3600) AS worst FROM q GROUP BY p_partkey) SELECT p_partkey, {_R("worst", 5)} AS worst, worst <= 0.55::DOUBLE AS agrees FROM s""",
}
def _seed_sql() -> str:
    from starloom.plans.mosaic import _cell_sql
    from starloom.plans.tiling import _centre_sql

    return f"""WITH {S.OBJECTS}, {_cell_sql(4)}, src AS (SELECT i FROM range(0, 3072) r(i)), {_centre_sql(4, "src", "i")} SELECT i AS index, sha256('sky-seed-v1:4:' || i) AS spread FROM centres WHERE "dec" BETWEEN -29 AND 85 AND i NOT IN (SELECT "index" FROM cell)"""


ORACLES["p34_seed_targets"] = _seed_sql()
