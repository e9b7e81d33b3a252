"""Cell corners and cones, masks, reprojection, canvases, views, and stars found in frames."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from starloom.functions import geo as G
from starloom.functions import healpix as H
from starloom.functions.maths import half_up, steady
from starloom.operators import extraction as E
from starloom.operators import mosaic as M
from starloom.operators import tiling as T
from starloom.sources import tables as S
from starloom.sources.storage import written

WCS = {"ra": 210.0, "dec": 21.0, "x0": 200.0, "y0": 150.0, "sx": -0.02, "sy": 0.02}
OTHER = {"ra": 210.1, "dec": 21.05, "x0": 90.3, "y0": 70.6, "sx": -0.021, "sy": 0.021}


def _round(df, digits, *columns):
    return df.withColumns({c: steady(F.col(c), digits) for c in columns})


def h03_corners(s, d):
    # of a plain posexplode Spark infers a filter on the array, which it pushes below all steps that make it, each written out in full
    cells = H.with_corners(M.object_cells(S.objects(s, d), (8,)), "cell8", 8)
    rows = cells.select("object_id", F.posexplode_outer("corners").alias("k", "c")).select("object_id", "k", "c.ra", "c.dec")
    return _round(rows, 7, "ra", "dec")


def e15_polygons(s, d):
    """Outlines of cells on a view, as paths."""
    cells = H.with_corners(M.object_cells(S.objects(s, d), (6,)), "cell6", 6)
    rows = cells.select("object_id", F.posexplode_outer("corners").alias("k", "c")).select("object_id", "k", "c.ra", "c.dec")
    x, y = G.on_view(F.col("ra"), F.col("dec"), (180.0, 0.0), (360.0, 180.0), (1440, 720))
    point = F.concat(F.when(F.col("k") == 0, "M").otherwise("L"), F.format_string("%.2f,%.2f", half_up(steady(x, 6), 2), half_up(steady(y, 6), 2)))
    paths = rows.withColumn("p", point).groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("k", "p"))).alias("ps"))
    return paths.select("object_id", F.concat(F.array_join(F.transform("ps", lambda p: p["p"]), " "), F.lit(" Z")).alias("path"))


def _mask(s, d):
    line = S.table(s, d, "lineitem")
    pix = line.groupBy((F.col("l_orderkey") % 400).alias("x"), ((F.col("l_partkey") * 7 + F.col("l_linenumber") * 31) % 300).alias("y")).agg(F.max("l_tax").alias("t"))
    return pix.select("y", "x", (F.col("t") > 0.02).alias("usable"))


def h09_mask_cells(s, d):
    return _round(T.mask_cells(_mask(s, d), WCS, (6, 7)), 8, "coverage")


def r13_tile_plan(s, d):
    return T.tile_plan(_mask(s, d), WCS, 8, 6)


def _image(s, d):
    line = S.table(s, d, "lineitem")
    cents = F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("bigint") % 1000
    pix = line.groupBy((F.col("l_partkey") % 160).alias("x"), (F.col("l_orderkey") % 120).alias("y")).agg(F.min(cents).alias("v"))
    return pix.select("y", "x", F.col("v").cast("double").alias("value"))


def r09_aligned(s, d):
    source = {**WCS, "x0": 80.0, "y0": 60.0}
    return _round(T.aligned(_image(s, d), source, OTHER, 170, 130, 0.5), 5, "value")


def m31_reprojected(s, d):
    """Onto pixels of half the size; only where all four neighbours are there."""
    source = {**WCS, "x0": 80.0, "y0": 60.0}
    target = {**source, "x0": 160.25, "y0": 120.25, "sx": -0.01, "sy": 0.01}
    return _round(T.aligned(_image(s, d), source, target, 320, 240), 5, "value")


def r11_canvases(s, d):
    k = F.col("p_partkey")
    rows = S.table(s, d, "part").select("p_partkey", (k * 37 % 4000 + 100).cast("double").alias("w"), (k * 53 % 3000 + 100).cast("double").alias("h"), (k % 7 / 4.0 + 0.25).alias("native"), (k % 9 * 2_000_000 + 400_000).alias("most"))
    plan = T.canvas_scale(F.col("w"), F.col("h"), F.col("native"), F.col("most"))
    return _round(rows.select("p_partkey", plan.alias("c")).select("p_partkey", "c.scale", "c.width", "c.height", "c.bytes", "c.ok"), 9, "scale")


def r15_render_problems(s, d):
    shares = M.attribution(M.frame_cells(S.frames(s, d), S.objects(s, d), (9,)))
    weights = shares.select("order", "index", F.col("user_id").alias("source"), F.when(F.col("index") % 29 == 0, F.col("share") * 2).otherwise(F.col("share")).alias("weight"))
    inventory = S.table(s, d, "supplier").select((F.col("s_suppkey") + F.when(F.col("s_suppkey") % 9 == 0, 5000).otherwise(0)).alias("source"))
    return T.render_problems(weights, inventory)


def _frames(s, d):
    """Frames of 60 by 50 pixels with a few bright spots; the more rows, the more frames."""
    line = S.table(s, d, "lineitem")
    x, y = F.col("l_partkey") * 13 % 60, F.col("l_suppkey") * 17 % 50
    base = line.groupBy(F.floor(F.col("l_orderkey") / 1500).alias("frame"), y.alias("y"), x.alias("x")).agg((F.sum(F.floor(F.col("l_quantity")).cast("bigint")) % 40).alias("v"))
    spot = F.greatest(F.lit(0), 900 - 260 * ((F.col("x") % 12 - 5) * (F.col("x") % 12 - 5) + (F.col("y") % 10 - 4) * (F.col("y") % 10 - 4)))
    return base.select("frame", "y", "x", (F.col("v") + spot).cast("double").alias("value"))


MESH = 16


def r04_detections(s, d):
    """Sources of frames: regions over a meshed background."""
    return _round(E.detected(_frames(s, d), MESH, strip=8), 6, "noise", "flux", "peak", "cy", "cx", "a", "b")


def a34_frame_quality(s, d):
    sources = written(E.detected(_frames(s, d), MESH, strip=8), "sources")
    return _round(E.frame_quality(sources, 1.5), 6, "fwhm_arcsec", "eccentricity", "signal_to_noise")


def m26_view_places(s, d):
    o = S.objects(s, d)
    x, y = G.on_view(F.col("ra"), F.col("dec"), (350.0, 10.0), (90.0, 60.0), (900, 600))
    return _round(o.select("object_id", x.alias("x"), y.alias("y")), 6, "x", "y")


def m25_unprojected(s, d):
    """Directions from points of a view, as far from its centre as it reaches."""
    e = F.col("event_id")
    alt, az = G.view_direction((e % 41 - 20) / 12.0, (e * 7 % 37 - 18) / 12.0, 35.0, 120.0)
    return _round(S.table(s, d, "events").select("event_id", alt.alias("alt"), az.alias("az")), 7, "alt", "az")


def m27_star_marks(s, d):
    """Radius, opacity and colour of stars as drawn at a field of view."""
    k, m, fov = F.col("p_partkey"), F.col("p_size") / 8.0, 50.0
    size = max(0.8, min(2.6, 70 / fov))
    v = F.when(k % 13 > 0, (k % 23 - 4) / 10.0)
    colour = F.when(v.isNull(), "#f4f7ff").when(v < -0.1, "#a7c3ff").when(v < 0.2, "#cbdcff").when(v < 0.5, "#f2f4ff").when(v < 0.9, "#fff4de").when(v < 1.4, "#ffd9a8").otherwise("#ffb37a")
    rows = S.table(s, d, "part").where(m <= (5.0 if fov > 80 else 5.4 if fov > 40 else 5.6)).select("p_partkey", F.greatest(F.lit(0.5), (6.2 - m) * 0.42 * size).alias("radius"), F.least(F.lit(1.0), (6.4 - m) / 2.2).alias("opacity"), colour.alias("colour"))
    return _round(rows, 7, "radius", "opacity")


def p36_on_screen(s, d):
    """Directions that a view of 900 by 600 pixels shows, not far below the horizon and not behind it."""
    o = S.observations(s, d).select("observation_id", (F.col("elevation") - 20).alias("alt"), "azimuth")
    x, y, z = G.stereographic(F.col("alt"), F.col("azimuth"), 35.0, 120.0)
    scale = 300 / (2 * math.tan(math.radians(70.0) / 4))
    rows = o.select("observation_id", "alt", z.alias("z"), (450 + x * scale).alias("px"), (300 - y * scale).alias("py"))
    return rows.where((F.col("z") >= -0.6) & (F.col("alt") >= -2) & F.col("px").between(-20, 920) & F.col("py").between(-20, 620)).select("observation_id")


def m38_frame_positions(s, d):
    """Frames whose measured centre lies farther from the expected one than their search allows."""
    o = S.objects(s, d).select("object_id", "ra", "dec", (F.col("object_id") % 5 / 4.0).alias("radius"))
    rows = o.withColumns({"mra": F.col("ra") + (F.col("object_id") % 17) / 4.0, "mdec": F.greatest(F.lit(-90.0), F.least(F.lit(90.0), F.col("dec") + (F.col("object_id") % 11) / 4.0))})
    off = G.separation_deg(F.col("mra"), F.col("mdec"), F.col("ra"), F.col("dec"))
    return rows.where(off > F.greatest(F.lit(1.0), F.col("radius") * 4) + 1e-9).select("object_id")


def e53_sampled(s, d):
    """Every so many rows and columns of each frame, so that neither side is over a limit."""
    f = _frames(s, d)
    step = F.greatest(F.lit(1), F.ceil(F.greatest(F.max("y").alias("y"), F.max("x")).cast("double") / 20)).cast("int")
    steps = f.groupBy("frame").agg(step.alias("step"))
    return f.join(steps, "frame").where((F.col("y") % F.col("step") == 0) & (F.col("x") % F.col("step") == 0)).select("frame", "y", "x", "value")


QUERIES = {f.__name__: f for f in (h03_corners, e15_polygons, h09_mask_cells, r13_tile_plan, r09_aligned, m31_reprojected, r11_canvases, r15_render_problems, r04_detections, a34_frame_quality, m26_view_places, m25_unprojected, m27_star_marks, p36_on_screen, m38_frame_positions, e53_sampled)}

from starloom.plans.archives import _sky_sql  # noqa: E402
from starloom.plans.mosaic import _BASE, _COVER, _SHARES, _cell_sql  # noqa: E402

_R = lambda x, n: f"floor(({x}) * 1e{n} + 0.3137) / 1e{n}"


def _parts(order: int, source: str, keys: str) -> str:
    """CTE parts(keys, face, ix, iy) of an index at an order."""
    ix = " + ".join(f"(((i >> {2 * b}) & 1) << {b})" for b in range(order)) or "0"
    iy = " + ".join(f"(((i >> {2 * b + 1}) & 1) << {b})" for b in range(order)) or "0"
    return f"parts AS (SELECT {keys}, i >> {2 * order} AS face, {ix} AS ix, {iy} AS iy FROM {source})"


def _corner_sql(order: int) -> str:
    ns = float(1 << order)
    return f"""{S.OBJECTS}, {_cell_sql(9)}, src AS (SELECT object_id, "index" >> {2 * (9 - order)} AS i FROM cell), {_parts(order, "src", "object_id")},
 spots AS (SELECT object_id, k, (ix + ([1, 0, 0, 1])[k + 1]) / {ns}::DOUBLE AS x, (iy + ([1, 1, 0, 0])[k + 1]) / {ns}::DOUBLE AS y, ({list(H.RING_OF_FACE)})[face + 1] AS ring, ({list(H.LONGITUDE_OF_FACE)})[face + 1] AS turn FROM parts, range(0, 4) r(k)),
 r AS (SELECT *, ring - x - y AS r FROM spots), n AS (SELECT *, CASE WHEN r < 1 THEN r WHEN r > 3 THEN 4 - r ELSE 1 END AS nr FROM r), t AS (SELECT *, turn * nr + x - y AS t0 FROM n), u AS (SELECT *, CASE WHEN t0 < 0 THEN t0 + 8 WHEN t0 >= 8 THEN t0 - 8 ELSE t0 END AS t FROM t),
 corners AS (SELECT object_id, CAST(k AS INT) AS k, CASE WHEN nr < 1e-15 THEN 0 ELSE t * 45 / nr END AS ra, degrees(asin(CASE WHEN r < 1 THEN 1 - nr * nr / 3 WHEN r > 3 THEN nr * nr / 3 - 1 ELSE (2 - r) * 2 / 3 END)) AS "dec" FROM u)"""


def _centre_sql(order: int, source: str, keys: str) -> str:
    """CTEs up to centres(keys, ra, dec) of indices i."""
    ns = 1 << order
    return f"""{_parts(order, source, keys)}, cr AS (SELECT *, ({list(H.RING_OF_FACE)})[face + 1] * {ns} - ix - iy - 1 AS r FROM parts), cn AS (SELECT *, CASE WHEN r < {ns} THEN r WHEN r > {3 * ns} THEN {4 * ns} - r ELSE {ns} END AS nr, CASE WHEN r < {ns} OR r > {3 * ns} THEN 0 ELSE (r - {ns}) & 1 END AS sh FROM cr),
 cj AS (SELECT *, CAST(floor((({list(H.LONGITUDE_OF_FACE)})[face + 1] * nr + ix - iy + 1 + sh) / 2) AS BIGINT) AS j0 FROM cn), cp AS (SELECT *, CASE WHEN j0 > {4 * ns} THEN j0 - {4 * ns} WHEN j0 < 1 THEN j0 + {4 * ns} ELSE j0 END AS jp FROM cj),
 centres AS (SELECT {keys}, degrees((jp - (sh + 1) * 0.5::DOUBLE) * (pi() / 2 / nr)) AS ra, degrees(asin(CASE WHEN r < {ns} THEN 1 - nr * nr / {3.0 * ns * ns}::DOUBLE WHEN r > {3 * ns} THEN nr * nr / {3.0 * ns * ns}::DOUBLE - 1 ELSE ({2 * ns} - r) * 2 / {3.0 * ns}::DOUBLE END)) AS "dec" FROM cp)"""


def _pixel_sql(w: dict[str, float], ra: str, dec: str) -> tuple[str, str]:
    d0 = math.radians(w["dec"])
    s, c = f"{math.sin(d0)!r}::DOUBLE", f"{math.cos(d0)!r}::DOUBLE"
    a = f"radians({ra} - {w['ra']}::DOUBLE)"
    deep = f"(sin(radians({dec})) * {s} + cos(radians({dec})) * {c} * cos({a}))"
    return f"degrees(cos(radians({dec})) * sin({a}) / {deep}) / {w['sx']}::DOUBLE + {w['x0']}::DOUBLE", f"degrees((sin(radians({dec})) * {c} - cos(radians({dec})) * {s} * cos({a})) / {deep}) / {w['sy']}::DOUBLE + {w['y0']}::DOUBLE"


_MASK = "mask AS (SELECT l_orderkey % 400 AS x, (l_partkey * 7 + l_linenumber * 31) % 300 AS y, max(l_tax) > 0.02::DOUBLE AS usable FROM lineitem GROUP BY ALL)"
_MASK_RA, _MASK_DEC = _sky_sql(WCS, "x", "y")
_MASKED = lambda order: f"""{_MASK}, objects AS (SELECT row_number() OVER () AS object_id, {_MASK_RA} AS ra, {_MASK_DEC} AS "dec", usable FROM mask), {_cell_sql(order)}, pix AS (SELECT "index" AS i, usable FROM cell JOIN objects USING (object_id))"""
_IMAGE = "image AS (SELECT l_partkey % 160 AS x, l_orderkey % 120 AS y, CAST(min(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) % 1000) AS DOUBLE) AS value FROM lineitem GROUP BY ALL)"


def _aligned_sql(source: dict[str, float], target: dict[str, float], width: int, height: int, least: float) -> str:
    ra, dec = _sky_sql(target, "tx", "ty")
    sx, sy = _pixel_sql(source, "ra", '"dec"')
    return f"""WITH {_IMAGE}, g AS (SELECT tx, ty, {ra} AS ra, {dec} AS "dec" FROM range(0, {width}) a(tx), range(0, {height}) b(ty)), p AS (SELECT tx, ty, {sx} AS sx, {sy} AS sy FROM g), q AS (SELECT *, CAST(floor(sx) AS BIGINT) AS bx, CAST(floor(sy) AS BIGINT) AS "by" FROM p),
        n AS (SELECT tx, ty, bx + i AS x, "by" + j AS y, CASE WHEN i = 1 THEN sx - bx ELSE 1 - (sx - bx) END * CASE WHEN j = 1 THEN sy - "by" ELSE 1 - (sy - "by") END AS w FROM q, range(0, 2) r(i), range(0, 2) t(j)),
        s AS (SELECT tx, ty, sum(w * value) AS v, sum(w) AS f FROM n JOIN image USING (x, y) WHERE w > 0 GROUP BY ALL) SELECT ty AS y, tx AS x, {_R("v / f", 5)} AS value FROM s WHERE f > {least}::DOUBLE"""


def _clip_sql() -> str:
    """CTEs c0, c1, ...: each box's values with their mean m and deviation s, clipped once more by each."""
    moments = "SELECT *, sqrt(greatest(list_sum(list_transform(l, lambda v: v * v)) / len(l) - m * m, 0)) AS s FROM (SELECT *, list_sum(l) / len(l) AS m FROM ({}))"
    out = [f"c0 AS ({moments.format('SELECT * FROM box')})"]
    out += [f"c{k} AS ({moments.format(f'SELECT frame, \"by\", bx, list_filter(l, lambda v: abs(v - m) <= {E.CLIP} * s) AS l FROM c{k - 1}')})" for k in range(1, E.CLIPS + 1)]
    return ", ".join(out)


_CLIPS = _clip_sql()
_NEAR = ", ".join(f'max(CASE WHEN b."by" - a."by" = {i - 1} AND b.bx - a.bx = {j - 1} THEN b.level END) AS n{i}{j}' for i in range(3) for j in range(3))
_DETECTED = f"""base AS (SELECT l_orderkey // 1500 AS frame, l_suppkey * 17 % 50 AS y, l_partkey * 13 % 60 AS x, sum(CAST(floor(l_quantity) AS BIGINT)) % 40 AS v FROM lineitem GROUP BY ALL),
 pixels AS (SELECT frame, y, x, CAST(v + greatest(0, 900 - 260 * ((x % 12 - 5) * (x % 12 - 5) + (y % 10 - 4) * (y % 10 - 4))) AS DOUBLE) AS value FROM base), box AS (SELECT frame, y // {MESH} AS "by", x // {MESH} AS bx, list_sort(list(value)) AS l FROM pixels GROUP BY ALL), {_CLIPS},
 md AS (SELECT *, (l[(len(l) + 1) // 2] + l[len(l) // 2 + 1]) / 2 AS med FROM c{E.CLIPS}), mesh AS (SELECT frame, "by", bx, CASE WHEN abs(m - med) <= 0.3::DOUBLE * s THEN 2.5::DOUBLE * med - 1.5::DOUBLE * m ELSE med END AS level, s AS sigma FROM md),
 smooth AS (SELECT a.frame, a."by", a.bx, median(b.level) AS level, median(b.sigma) AS sigma FROM mesh a JOIN mesh b ON a.frame = b.frame AND abs(a."by" - b."by") <= 1 AND abs(a.bx - b.bx) <= 1 GROUP BY ALL), noisy AS (SELECT frame, median(sigma) AS noise FROM smooth GROUP BY frame HAVING median(sigma) > 0),
 near AS (SELECT a.frame, a."by", a.bx, {_NEAR} FROM smooth a JOIN smooth b ON a.frame = b.frame AND abs(a."by" - b."by") <= 1 AND abs(a.bx - b.bx) <= 1 GROUP BY ALL),
 placed AS (SELECT pixels.frame, y, x, value, (y + 0.5::DOUBLE) / {MESH} - 0.5::DOUBLE - "by" AS v, (x + 0.5::DOUBLE) / {MESH} - 0.5::DOUBLE - bx AS u, {", ".join(f"coalesce(n{i}{j}, n11) AS n{i}{j}" for i in range(3) for j in range(3))} FROM pixels JOIN near ON near.frame = pixels.frame AND "by" = y // {MESH} AND bx = x // {MESH}),
 rows3 AS (SELECT *, {", ".join(f"n{i}1 + CASE WHEN u < 0 THEN (n{i}1 - n{i}0) * u ELSE (n{i}2 - n{i}1) * u END AS r{i}" for i in range(3))} FROM placed), o AS (SELECT frame, y, x, value - (r1 + CASE WHEN v < 0 THEN (r1 - r0) * v ELSE (r2 - r1) * v END) AS v FROM rows3),
 bright AS (SELECT o.frame, y, x, v, noise FROM o JOIN noisy ON noisy.frame = o.frame WHERE v > 5 * noise), reach AS (SELECT frame, y, x, y AS ly, x AS lx FROM bright UNION SELECT r.frame, r.y, r.x, b.y, b.x FROM reach r JOIN bright b ON b.frame = r.frame AND abs(b.y - r.ly) <= 1 AND abs(b.x - r.lx) <= 1),
 lab AS (SELECT frame, y, x, min(ly * 100000 + lx) AS label FROM reach GROUP BY ALL), rel AS (SELECT frame, label // 100000 AS y0, label % 100000 AS x0, noise, v, y - label // 100000 AS dy, x - label % 100000 AS dx FROM lab JOIN bright USING (frame, y, x)),
 m AS (SELECT frame, y0, x0, noise, count(*) AS area, sum(v) AS flux, max(v) AS peak, sum(v * dx) / sum(v) AS mx, sum(v * dy) / sum(v) AS my, sum(v * dx * dx) / sum(v) AS xx, sum(v * dy * dy) / sum(v) AS yy, sum(v * dx * dy) / sum(v) AS xy FROM rel GROUP BY ALL HAVING count(*) >= 5),
 w0 AS (SELECT *, xx - mx * mx AS vx0, yy - my * my AS vy0, xy - mx * my AS vxy FROM m), w AS (SELECT *, vx0 + t AS vx, vy0 + t AS vy FROM (SELECT *, CASE WHEN vx0 * vy0 - vxy * vxy < 0.00694::DOUBLE THEN 1 / 12 ELSE 0 END AS t FROM w0)),
 e AS (SELECT *, (vx + vy) / 2 AS half, sqrt(pow((vx - vy) / 2, 2) + vxy * vxy) AS root FROM w), stars AS (SELECT frame, y0 AS y, x0 AS x, noise, area, flux, peak, y0 + my AS cy, x0 + mx AS cx, sqrt(greatest(half + root, 0)) AS a, sqrt(greatest(half - root, 0)) AS b FROM e)"""

_STEREO = lambda alt, az: (f"(sin(radians({alt})) * sin(radians(35.0::DOUBLE)) + cos(radians({alt})) * cos(radians(35.0::DOUBLE)) * cos(radians({az} - 120)))", f"cos(radians({alt})) * sin(radians({az} - 120))", f"(sin(radians({alt})) * cos(radians(35.0::DOUBLE)) - cos(radians({alt})) * sin(radians(35.0::DOUBLE)) * cos(radians({az} - 120)))")
_Z, _X, _Y = _STEREO("alt", "azimuth")
_SCALE = repr(300 / (2 * math.tan(math.radians(70.0) / 4)))

ORACLES = {
    "h02_cell_centres": f"""WITH {S.OBJECTS}, {_cell_sql(9)}, src AS (SELECT object_id, "index" >> 2 AS i FROM cell), {_centre_sql(8, "src", "object_id, i")} SELECT object_id, i AS cell8, {_R("ra", 8)} AS centre_ra, {_R('"dec"', 8)} AS centre_dec FROM centres""",
    "h03_corners": f"WITH {_corner_sql(8)} SELECT object_id, k, {_R('ra', 7)} AS ra, {_R('\"dec\"', 7)} AS \"dec\" FROM corners",
    "e15_polygons": f"""WITH {_corner_sql(6)}, v AS (SELECT object_id, k, CASE WHEN ra - 180 > 180 THEN ra - 540 WHEN ra - 180 < -180 THEN ra + 180 ELSE ra - 180 END AS turn, "dec" FROM corners), p AS (SELECT object_id, k, floor({_R("1440 / 2 + turn / 360 * 1440", 6)} * 100 + 0.5) / 100 AS x, floor({_R('720 / 2 - "dec" / 180 * 720', 6)} * 100 + 0.5) / 100 AS y FROM v)
        SELECT object_id, string_agg(CASE WHEN k = 0 THEN 'M' ELSE 'L' END || printf('%.2f,%.2f', x, y), ' ' ORDER BY k) || ' Z' AS path FROM p GROUP BY object_id""",
    "h09_mask_cells": f"""WITH {_MASKED(7)}, c AS (SELECT 7 AS o, i, usable FROM pix UNION ALL SELECT 6, i >> 2, usable FROM pix), g AS (SELECT o, i, avg(usable::INT) AS c FROM c GROUP BY ALL) SELECT o AS "order", i AS index, {_R("c", 8)} AS coverage, c >= 0.7::DOUBLE AS eligible FROM g WHERE c > 0.01::DOUBLE""",
    "r13_tile_plan": f"""WITH {_MASKED(8)}, g AS (SELECT i FROM pix GROUP BY i HAVING avg(usable::INT) >= 0.005::DOUBLE) SELECT DISTINCT CAST(o AS INT) AS "order", i >> CAST(2 * (8 - o) AS BIGINT) AS index FROM g, range(6, 9) r(o)""",
    "r09_aligned": _aligned_sql({**WCS, "x0": 80.0, "y0": 60.0}, OTHER, 170, 130, 0.5),
    "m31_reprojected": _aligned_sql({**WCS, "x0": 80.0, "y0": 60.0}, {**WCS, "x0": 160.25, "y0": 120.25, "sx": -0.01, "sy": 0.01}, 320, 240, 0.99),
    "r11_canvases": f"""WITH RECURSIVE p AS (SELECT p_partkey, (p_partkey * 37 % 4000 + 100)::DOUBLE AS w, (p_partkey * 53 % 3000 + 100)::DOUBLE AS h, p_partkey % 7 / 4.0::DOUBLE + 0.25::DOUBLE AS native, p_partkey % 9 * 2000000 + 400000 AS most FROM part),
        c AS (SELECT p_partkey, w, h, native, most, native AS scale, 0 AS n FROM p UNION ALL SELECT p_partkey, w, h, native, most, scale * greatest(1.01::DOUBLE, sqrt((ceil(w / scale) + 16) * (ceil(h / scale) + 16) / ((most - 65536) / 4.0::DOUBLE)) * 1.01::DOUBLE), n + 1 FROM c WHERE n < 7 AND (ceil(w / scale) + 16) * (ceil(h / scale) + 16) * 4 + 65536 > most),
        l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY n DESC) = 1), z AS (SELECT *, CAST(ceil(w / scale) AS BIGINT) + 16 AS width, CAST(ceil(h / scale) AS BIGINT) + 16 AS height FROM l)
        SELECT p_partkey, {_R("scale", 9)} AS scale, width, height, width * height * 4 + 65536 AS bytes, width * height * 4 + 65536 <= most AND scale <= native * 2.5::DOUBLE AS ok FROM z""",
    "r15_render_problems": f"""WITH {_BASE}, {S.FRAMES}, {_COVER}, {_SHARES}, q AS (SELECT "order", "index", user_id AS source, CASE WHEN "index" % 29 = 0 THEN share * 2 ELSE share END AS weight FROM shares), i AS (SELECT s_suppkey + CASE WHEN s_suppkey % 9 = 0 THEN 5000 ELSE 0 END AS source FROM supplier),
        p AS (SELECT 'weights' AS problem FROM q GROUP BY "order", "index" HAVING abs(sum(weight) - 1) > 1e-9 OR min(weight) <= 0 UNION ALL SELECT 'unused-source' FROM (SELECT source FROM i EXCEPT SELECT source FROM q) UNION ALL SELECT 'unknown-source' FROM (SELECT source FROM q EXCEPT SELECT source FROM i)) SELECT problem, count(*) AS n FROM p GROUP BY problem""",
    "r04_detections": f"WITH RECURSIVE {_DETECTED} SELECT frame, y, x, {_R('noise', 6)} AS noise, area, {_R('flux', 6)} AS flux, {_R('peak', 6)} AS peak, {_R('cy', 6)} AS cy, {_R('cx', 6)} AS cx, {_R('a', 6)} AS a, {_R('b', 6)} AS b FROM stars",
    "a34_frame_quality": f"""WITH RECURSIVE {_DETECTED}, q AS (SELECT frame, median(sqrt(a * b) * 2.354820045::DOUBLE) * 1.5::DOUBLE AS fwhm, median(sqrt(least(greatest(1 - b * b / (a * a), 0), 1))) AS ecc, greatest(0, median(flux / (noise * sqrt(greatest(1, pi() * a * b))))) AS snr, count(*) AS stars FROM stars WHERE a > 0 AND b > 0 AND flux > 0 GROUP BY frame)
        SELECT frame, {_R("fwhm", 6)} AS fwhm_arcsec, {_R("ecc", 6)} AS eccentricity, {_R("snr", 6)} AS signal_to_noise, stars, ecc >= 0.8::DOUBLE AS tracking_error FROM q WHERE stars >= 5""",
    "m26_view_places": f"""WITH {S.OBJECTS}, t AS (SELECT object_id, CASE WHEN ra - 350 > 180 THEN ra - 710 WHEN ra - 350 < -180 THEN ra + 10 ELSE ra - 350 END AS turn, "dec" FROM objects) SELECT object_id, {_R("450 + turn / 90 * 900", 6)} AS x, {_R('300 - ("dec" - 10) / 60 * 600', 6)} AS y FROM t""",
    "m25_unprojected": f"""WITH p AS (SELECT event_id, (event_id % 41 - 20) / 12.0::DOUBLE AS x, (event_id * 7 % 37 - 18) / 12.0::DOUBLE AS y FROM events), r AS (SELECT *, sqrt(x * x + y * y) AS r FROM p), t AS (SELECT *, 2 * atan(r / 2) AS th FROM r), s AS (SELECT *, CASE WHEN r > 0 THEN sin(th) / r ELSE 1 END AS s FROM t),
        d AS (SELECT event_id, s * x AS e, cos(th) * cos(radians(35.0::DOUBLE)) - s * y * sin(radians(35.0::DOUBLE)) AS n, cos(th) * sin(radians(35.0::DOUBLE)) + s * y * cos(radians(35.0::DOUBLE)) AS h FROM s)
        SELECT event_id, {_R("degrees(asin(least(greatest(h, -1), 1)))", 7)} AS alt, {_R("fmod(fmod(degrees(atan2(e, n)) + 120, 360) + 360, 360)", 7)} AS az FROM d""",
    "m27_star_marks": f"""WITH p AS (SELECT p_partkey, p_size / 8.0::DOUBLE AS m, CASE WHEN p_partkey % 13 > 0 THEN (p_partkey % 23 - 4) / 10.0::DOUBLE END AS v FROM part) SELECT p_partkey, {_R("greatest(0.5::DOUBLE, (6.2::DOUBLE - m) * 0.42::DOUBLE * 1.4::DOUBLE)", 7)} AS radius, {_R("least(1.0::DOUBLE, (6.4::DOUBLE - m) / 2.2::DOUBLE)", 7)} AS opacity,
        CASE WHEN v IS NULL THEN '#f4f7ff' WHEN v < -0.1 THEN '#a7c3ff' WHEN v < 0.2 THEN '#cbdcff' WHEN v < 0.5 THEN '#f2f4ff' WHEN v < 0.9 THEN '#fff4de' WHEN v < 1.4 THEN '#ffd9a8' ELSE '#ffb37a' END AS colour FROM p WHERE m <= 5.4::DOUBLE""",
    "p36_on_screen": f"""WITH {S.OBSERVATIONS}, o AS (SELECT observation_id, elevation - 20 AS alt, azimuth FROM observations), v AS (SELECT observation_id, alt, {_Z} AS z, 450 + 2 / (1 + {_Z}) * {_X} * {_SCALE}::DOUBLE AS px, 300 - 2 / (1 + {_Z}) * {_Y} * {_SCALE}::DOUBLE AS py FROM o)
        SELECT observation_id FROM v WHERE z >= -0.6::DOUBLE AND alt >= -2 AND px BETWEEN -20 AND 920 AND py BETWEEN -20 AND 620""",
    "m38_frame_positions": f"""WITH {S.OBJECTS}, r AS (SELECT object_id, ra, "dec", object_id % 5 / 4.0::DOUBLE AS radius, ra + object_id % 17 / 4.0::DOUBLE AS mra, greatest(-90, least(90, "dec" + object_id % 11 / 4.0::DOUBLE)) AS mdec FROM objects)
        SELECT object_id FROM r WHERE degrees(acos(least(greatest(sin(radians(mdec)) * sin(radians("dec")) + cos(radians(mdec)) * cos(radians("dec")) * cos(radians(mra - ra)), -1), 1))) > greatest(1.0::DOUBLE, radius * 4) + 1e-9""",
    "e53_sampled": f"""WITH {_DETECTED.split(" box AS (")[0].rstrip().rstrip(",")}, st AS (SELECT frame, greatest(1, CAST(ceil(greatest(max(y), max(x)) / 20.0::DOUBLE) AS INT)) AS step FROM pixels GROUP BY frame) SELECT frame, y, x, value FROM pixels JOIN st USING (frame) WHERE y % step = 0 AND x % step = 0""",
}
