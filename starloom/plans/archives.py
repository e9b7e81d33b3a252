"""Archive, source and account queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from starloom.functions.maths import steady
from starloom.operators import archives as V
from starloom.operators import mosaic as M
from starloom.operators import rollups as R
from starloom.plans.rollups import ELIGIBLE
from starloom.sources import readers
from starloom.sources import tables as S

WCS = {"ra": 359.9, "dec": 41.3, "x0": 500.0, "y0": 400.0, "sx": -0.0005, "sy": 0.0005}


def _records(s, d):
    """Supplier rows as records of two providers that name their fields differently."""
    t = S.table(s, d, "customer")
    a = F.create_map(F.lit("obs_id"), F.concat(F.lit("o"), (F.col("c_custkey") % 700).cast("string")), F.lit("target_name"), F.col("c_name"), F.lit("rights"), F.when(F.col("c_custkey") % 4 == 0, "Public").when(F.col("c_custkey") % 4 == 1, "(c) copyright holder").otherwise(" "))
    b = F.create_map(F.lit("dataset"), F.concat(F.lit("o"), (F.col("c_custkey") % 700).cast("string")), F.lit("object"), F.col("c_mktsegment"), F.lit("data_rights"), F.when(F.col("c_custkey") % 5 == 0, "proprietary").otherwise("open"))
    return t.select("c_custkey", (F.col("c_nationkey") % 2 == 0).alias("by_default"), F.when(F.col("c_custkey") % 2 == 0, a).otherwise(b).alias("record"))


def q37_provider_records(s, d):
    rows = V.normalised(_records(s, d), {"record_id": ["obs_id", "dataset"], "target": ["target_name", "object"], "rights": ["rights", "data_rights"]}, "record_id", "c_custkey")
    return rows.select("record_id", "c_custkey", "target", "rights", V.may_redistribute(F.col("rights"), F.col("by_default")).alias("may_redistribute"))


def q09_user_stats(s, d):
    """Points and first cells of each contributor; none is zero."""
    cells = M.frame_cells(M.first_frames(S.frames(s, d)), S.objects(s, d))
    paid = M.claims(cells).groupBy("user_id").agg(F.sum("points").alias("points"), F.count(F.lit(1)).alias("cells"))
    users = S.table(s, d, "supplier").select(F.col("s_suppkey").alias("user_id"))
    return users.join(paid, "user_id", "left").select("user_id", F.coalesce("points", F.lit(0)).alias("points"), F.coalesce("cells", F.lit(0)).alias("cells"))


def q12_status_json(s, d):
    """One JSON status for each run: qualification, newest frame and eligible objects."""
    frames = S.frames(s, d)
    counts = R.qualification(frames)
    newest = frames.groupBy("run_id").agg(F.max(F.struct("uploaded_at", "frame_id")).alias("n"))
    objects = frames.where(R.eligible()).groupBy("run_id").agg(F.array_sort(F.collect_set("object_id")).alias("objects"))
    rows = counts.join(newest, "run_id").join(objects, "run_id", "left")
    body = F.to_json(F.struct(F.struct("total", "accepted", F.col("rejected_frames").alias("rejected"), F.floor(F.col("accepted") * 100 / F.col("total") + 0.5).alias("percent")).alias("qualification"), F.struct(F.col("n.frame_id").alias("frame"), F.date_format("n.uploaded_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("at")).alias("newest"), F.coalesce("objects", F.array().cast("array<bigint>")).alias("objects")))
    return rows.select("run_id", body.alias("status"))


def q31_reuse(s, d):
    """Of each object the first eligible frame that a new run can reuse: none that contributor 7 has sent."""
    frames = S.frames(s, d)
    taken = frames.where("user_id = 7").select("frame_id")
    return R.first_of_each(frames.where(R.eligible()).join(taken, "frame_id", "left_anti"), "object_id")


def t11_next_seeds(s, d):
    cells = M.object_cells(S.objects(s, d), (6,)).join(S.objects(s, d).select("object_id", "mag"), "object_id").select(F.col("cell6").alias("cell"), "mag")
    return V.unseen_first(cells.select("cell").distinct(), cells.where("mag <= 10"), "cell", "seed-v1", 100)


def s16_immutable_writes(s, d):
    frames = S.frames(s, d).select("frame_id", F.sha2("frame_id", 256).alias("sha"), "line")
    arrivals = frames.withColumn("sha", F.when(F.col("line") == 3, F.sha2(F.concat("frame_id", F.lit("x")), 256)).otherwise(F.col("sha")))
    return readers.immutable_writes(frames.where("line > 1").select("frame_id", "sha"), arrivals, "frame_id", "sha")


def u03_catalogue(s, d):
    objects = S.objects(s, d).select(F.concat(F.lit("obj-"), F.col("object_id").cast("string")).alias("id"), "name", F.lit("deep-sky").alias("kind"), F.col("mag"))
    people = S.table(s, d, "supplier").select(F.concat(F.lit("star-"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), F.lit("star").alias("kind"), F.lit(None).cast("double").alias("mag"))
    places = S.table(s, d, "region").select(F.concat(F.lit("sun-"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name"), F.lit("solar").alias("kind"), F.lit(-1.0).alias("mag"))
    return objects.unionByName(people).unionByName(places)


def _lists(s, d):
    part = S.table(s, d, "part")
    return [part.where(F.col("p_size") % 3 == k).select("p_name", F.col("p_partkey")).groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey")) for k in range(3)]


def s24_interleaved(s, d):
    return readers.interleaved(_lists(s, d), "p_name", "p_partkey", 12)


def s14_byte_budget(s, d):
    f = S.frames(s, d).select("run_id", "frame_id", F.floor(F.col("price")).cast("bigint").alias("bytes"))
    return readers.within_bytes(f, "run_id", "frame_id", "bytes", 100_000).select("run_id", "frame_id", "upto")


def _sky(s, d):
    return S.table(s, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 1000).cast("double").alias("x"), (F.col("l_suppkey") % 800).cast("double").alias("y")).distinct()


def m30_pixel_sky(s, d):
    ra, dec = V.pixel_to_sky(F.col("x"), F.col("y"), WCS)
    rows = _sky(s, d).withColumns({"ra": ra, "dec": dec})
    bx, by = V.sky_to_pixel(F.col("ra"), F.col("dec"), WCS)
    r = lambda c, n: F.floor(c * 10.0**n + 0.5) / 10.0**n
    return rows.select("l_orderkey", "x", "y", r(F.col("ra"), 8).alias("ra"), r(F.col("dec"), 8).alias("dec"), r(bx, 4).alias("back_x"), r(by, 4).alias("back_y"))


def views(s, d):
    """A view of two to six by one to three degrees for each supplier."""
    k = F.col("s_suppkey")
    return S.table(s, d, "supplier").select(k.alias("view"), (k * 37 % 360 + 0.5).alias("ra"), (k * 17 % 120 - 60.0).alias("dec"), (k % 5 + 2.0).alias("width"), (k % 3 + 1.0).alias("height"))


QUERIES = {
    "q09_user_stats": q09_user_stats,
    "q12_status_json": q12_status_json,
    "q31_reuse": q31_reuse,
    "q37_provider_records": q37_provider_records,
    "t11_next_seeds": t11_next_seeds,
    "s14_byte_budget": s14_byte_budget,
    "s16_immutable_writes": s16_immutable_writes,
    "s20_manifest": lambda s, d: readers.manifest(M.pyramid(M.object_cells(S.objects(s, d), (9,)).select(F.lit(9).alias("order"), F.col("cell9").alias("index")), 7), "order"),
    "s24_interleaved": s24_interleaved,
    "u03_catalogue": u03_catalogue,
    "m28_target_grid": lambda s, d: V.target_grid(s, 359.99, 41.27, 60.0, 30.0, 1200).withColumns({c: steady(F.col(c), 9) for c in ("ra", "dec")}),
    "m30_pixel_sky": m30_pixel_sky,
    "h07_viewport_cells": lambda s, d: V.views_cells(views(s, d), 8),
}

_CUSTOMER = """c AS (SELECT *, 'o' || (c_custkey % 700) AS record_id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS target,
 CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 4 = 0 THEN 'Public' END WHEN c_custkey % 5 = 0 THEN 'proprietary' ELSE 'open' END AS rights FROM customer)"""
_STEP = 1200 * 0.25 / 60 * 0.85

from starloom.plans.mosaic import _BASE, _COVER, _PYRAMID, _cell_sql  # noqa: E402

def _sky_sql(w: dict[str, float], x: str, y: str) -> tuple[str, str]:
    d0 = math.radians(w["dec"])
    u, v = f"radians(({x} - {w['x0']}::DOUBLE) * {w['sx']}::DOUBLE)", f"radians(({y} - {w['y0']}::DOUBLE) * {w['sy']}::DOUBLE)"
    down = f"({math.cos(d0)!r}::DOUBLE - {v} * {math.sin(d0)!r}::DOUBLE)"
    ra = f"fmod(fmod({w['ra']}::DOUBLE + degrees(atan2({u}, {down})), 360) + 360, 360)"
    return ra, f"degrees(atan2({math.sin(d0)!r}::DOUBLE + {v} * {math.cos(d0)!r}::DOUBLE, sqrt({u} * {u} + {down} * {down})))"


_VIEW_STEP = "(0.229::DOUBLE * 0.8::DOUBLE)"
#: CTEs up to viewed(view, idx).
VIEWED = f"""v AS (SELECT s_suppkey AS view, s_suppkey * 37 % 360 + 0.5::DOUBLE AS mid, (s_suppkey * 17 % 120 - 60)::DOUBLE AS de, (s_suppkey % 5 + 2)::DOUBLE AS w, (s_suppkey % 3 + 1)::DOUBLE AS h FROM supplier), r AS (SELECT *, greatest(-90, de - h / 2 - {_VIEW_STEP}) AS low, least(90, de + h / 2 + {_VIEW_STEP}) AS high FROM v),
 y AS (SELECT view, mid, w, low + k * {_VIEW_STEP} AS de FROM r, range(0, 200) t(k) WHERE k <= floor((high - low) / {_VIEW_STEP})), z AS (SELECT *, {_VIEW_STEP} / greatest(0.15::DOUBLE, cos(radians(de))) AS st FROM y),
 c AS (SELECT view, de AS "dec", fmod(fmod(mid - w / 2 - st + k * st, 360) + 360, 360) AS ra FROM z, range(0, 400) t(k) WHERE k <= floor((w + 2 * st) / st)), objects AS (SELECT row_number() OVER () AS object_id, view, ra, "dec" FROM c), {_cell_sql(8)}, viewed AS (SELECT DISTINCT view, "index" AS idx FROM cell JOIN objects USING (object_id))"""

ORACLES = {
    "q09_user_stats": f"""WITH {S.FRAMES}, {_BASE}, {_COVER}, won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "order", "index" ORDER BY "at", frame_id) AS n FROM frame_cells WHERE coverage * 100 >= 5) WHERE n = 1),
        pts AS (SELECT *, CASE "order" WHEN 6 THEN 2 WHEN 7 THEN 5 WHEN 8 THEN 10 ELSE 20 END AS points FROM won), run AS (SELECT *, sum(points) OVER (PARTITION BY frame_id ORDER BY "order" DESC, "index") AS running FROM pts),
        paid AS (SELECT user_id, sum(points) AS points, count(*) AS cells FROM run WHERE running <= 500 GROUP BY user_id) SELECT s_suppkey AS user_id, CAST(coalesce(points, 0) AS BIGINT) AS points, coalesce(cells, 0) AS cells FROM supplier LEFT JOIN paid ON user_id = s_suppkey""",
    "q12_status_json": f"""WITH {S.FRAMES}, q AS (SELECT run_id, count(*) AS total, count(*) FILTER (WHERE {ELIGIBLE}) AS accepted, count(*) FILTER (WHERE rejected) AS rejected, max((uploaded_at, frame_id)) AS n, list_sort(list_distinct(list(object_id) FILTER (WHERE {ELIGIBLE}))) AS objects FROM frames GROUP BY run_id)
        SELECT run_id, '{{"qualification":{{"total":' || total || ',"accepted":' || accepted || ',"rejected":' || rejected || ',"percent":' || CAST(floor(accepted * 100 / total + 0.5) AS BIGINT) || '}},"newest":{{"frame":"' || n[2] || '","at":"' || strftime(n[1], '%Y-%m-%dT%H:%M:%S.%f') || 'Z"}},"objects":[' || coalesce(array_to_string(objects, ','), '') || ']}}' AS status FROM q""",
    "q31_reuse": f"""WITH {S.FRAMES} SELECT DISTINCT ON (object_id) object_id, frame_id, uploaded_at, user_id FROM frames f WHERE {ELIGIBLE} AND NOT EXISTS (SELECT 1 FROM frames t WHERE t.user_id = 7 AND t.frame_id = f.frame_id) ORDER BY object_id, uploaded_at, frame_id""",
    "q37_provider_records": f"""WITH {_CUSTOMER}, f AS (SELECT DISTINCT ON (record_id) * FROM c ORDER BY record_id, c_custkey) SELECT record_id, c_custkey, target, rights,
        CASE WHEN rights IS NULL THEN c_nationkey % 2 = 0 WHEN rights = 'proprietary' THEN false WHEN upper(rights) IN ('PUBLIC', 'OPEN') THEN true END AS may_redistribute FROM f""",
    "t11_next_seeds": f"""WITH {_BASE}, k AS (SELECT "index" >> 6 AS cell, mag FROM cell JOIN objects USING (object_id)) SELECT DISTINCT cell, sha256('seed-v1:' || cell) AS spread FROM k WHERE cell NOT IN (SELECT cell FROM k WHERE mag <= 10) ORDER BY spread LIMIT 100""",
    "s14_byte_budget": f"""WITH {S.FRAMES}, u AS (SELECT run_id, frame_id, CAST(sum(CAST(floor(price) AS BIGINT)) OVER (PARTITION BY run_id ORDER BY frame_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM frames) SELECT * FROM u WHERE upto <= 100000""",
    "s16_immutable_writes": f"WITH {S.FRAMES} SELECT frame_id, CASE WHEN line = 1 THEN 'written' WHEN line = 3 THEN 'conflict' ELSE 'replayed' END AS outcome FROM frames",
    "s20_manifest": f"""WITH {_BASE}, {_PYRAMID(7)}, b AS (SELECT "order", '[' || string_agg('{{"index":' || "index" || ',"order":' || "order" || '}}', ',' ORDER BY "index") || ']' AS body FROM pyramid GROUP BY "order") SELECT b."order", n, sha256(body) AS sha256 FROM b JOIN (SELECT "order", count(*) AS n FROM pyramid GROUP BY ALL) c ON b."order" = c."order" """,
    "s24_interleaved": """WITH m AS (SELECT p_name, p_size % 3 AS k, min(p_partkey) AS p FROM part GROUP BY ALL), r AS (SELECT p_name, CAST(k AS INT) AS list, CAST(row_number() OVER (PARTITION BY k ORDER BY p) AS INT) AS turn FROM m),
        f AS (SELECT p_name, min((turn, list)) AS a FROM r WHERE turn <= 12 GROUP BY p_name) SELECT p_name, a[1] AS turn, a[2] AS list FROM f ORDER BY a LIMIT 12""",
    "u03_catalogue": f"""WITH {S.OBJECTS} SELECT 'obj-' || object_id AS id, name, 'deep-sky' AS kind, mag FROM objects UNION ALL SELECT 'star-' || s_suppkey, s_name, 'star', NULL FROM supplier UNION ALL SELECT 'sun-' || r_regionkey, r_name, 'solar', -1.0::DOUBLE FROM region""",
    "m30_pixel_sky": """WITH p AS (SELECT DISTINCT l_orderkey, CAST(l_partkey % 1000 AS DOUBLE) AS x, CAST(l_suppkey % 800 AS DOUBLE) AS y FROM lineitem),
        t AS (SELECT *, radians((x - 500) * -0.0005::DOUBLE) AS u, radians((y - 400) * 0.0005::DOUBLE) AS v, radians(41.3::DOUBLE) AS d0 FROM p), w AS (SELECT *, cos(d0) - v * sin(d0) AS dn FROM t)
        SELECT l_orderkey, x, y, floor(fmod(359.9::DOUBLE + degrees(atan2(u, dn)) + 360, 360::DOUBLE) * 1e8 + 0.5) / 1e8 AS ra, floor(degrees(atan2(sin(d0) + v * cos(d0), sqrt(u * u + dn * dn))) * 1e8 + 0.5) / 1e8 AS "dec", x AS back_x, y AS back_y FROM w""",
    "m28_target_grid": f"""WITH g AS (SELECT i, j, (i - 7) * 4.25::DOUBLE AS x, (j - 3.5::DOUBLE) * 4.25::DOUBLE AS y FROM range(0, 15) a(i), range(0, 8) b(j)), r AS (SELECT fmod(359.99::DOUBLE + x / (60 * {max(0.1, math.cos(math.radians(41.27)))!r}::DOUBLE) + 360, 360) AS ra, 41.27::DOUBLE + y / 60 AS "dec", x * x + y * y AS d2 FROM g)
        SELECT floor(ra * 1e9 + 0.3137) / 1e9 AS ra, floor("dec" * 1e9 + 0.3137) / 1e9 AS "dec", CAST(row_number() OVER (ORDER BY d2, "dec", ra) AS INT) AS n FROM r""",
    "h07_viewport_cells": f"""WITH {VIEWED} SELECT DISTINCT view, 8 AS "order", idx AS index FROM viewed""",
}
