"""Frames on cells: footprints against cells, values on a cell's own pixels, and each frame's share in a cell.

Frames are images of 16 by 12 pixels made of the line items of some orders, each pointed near an object; the cells are those
of the objects. Both grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.functions import healpix as H
from starloom.functions.maths import steady
from starloom.operators import mosaic as M
from starloom.operators import projection as P
from starloom.operators import tiling as T
from starloom.plans.mosaic import _cell_sql
from starloom.plans.tiling import _centre_sql
from starloom.sources import tables as S
from starloom.sources.storage import written

ORDER, DEPTH, BLOCK = 7, 4, 8
WIDTH, HEIGHT, SCALE = 16, 12, 0.05


def pixels(s, d):
    """Pixels of frames; a few are masked."""
    line = S.table(s, d, "lineitem")
    x, y = F.col("l_partkey") * 13 % WIDTH, F.col("l_suppkey") * 17 % HEIGHT
    base = line.groupBy(F.floor(F.col("l_orderkey") / 1500).alias("frame"), y.alias("y"), x.alias("x")).agg(F.sum(F.floor("l_quantity").cast("bigint")).alias("v"))
    return base.where((F.col("frame") * 31 + F.col("y") * 7 + F.col("x")) % 101 != 0).select("frame", "y", "x", F.col("v").cast("double").alias("value"))


def geometry(s, d):
    frames = S.table(s, d, "lineitem").select(F.floor(F.col("l_orderkey") / 1500).alias("frame")).distinct()
    o = S.objects(s, d).select("object_id", F.col("ra").alias("ora"), F.col("dec").alias("odec"))
    rows = frames.withColumn("object_id", F.col("frame") * 7 % 150 + 1).join(o, "object_id")
    weight = F.when(F.col("frame") % 13 == 12, 0.0).otherwise(F.col("frame") % 5 + 1.0)
    return rows.select("frame", (F.col("ora") + 0.1).alias("ra"), (F.col("odec") * 0.9).alias("dec"), F.lit(7.5).alias("x0"), F.lit(5.5).alias("y0"), F.lit(-SCALE).alias("sx"), F.lit(SCALE).alias("sy"), F.lit(HEIGHT).alias("height"), F.lit(WIDTH).alias("width"), weight.alias("weight"))


def cells(s, d):
    o = S.objects(s, d).withColumn("dec", F.col("dec") * 0.9)
    return M.object_cells(o, (ORDER,)).select(F.lit(ORDER).alias("order"), F.col(f"cell{ORDER}").alias("index")).distinct()


def _touched(s, d, frames):
    return P.cells_touched(P.polygon_cover(P.footprints(frames), ORDER + 2), cells(s, d))


def _values(s, d):
    frames = geometry(s, d)
    return frames, P.projected(pixels(s, d), frames, _touched(s, d, frames), ORDER, DEPTH, BLOCK)


def m31_projected(s, d):
    """Frames on the pixels of the cells that they touch, bicubic."""
    return _values(s, d)[1].withColumn("value", steady(F.col("value"), 5))


def e40_tile_sources(s, d):
    frames, values = _values(s, d)
    shares = P.source_shares(written(values, "projected"), frames, ORDER, DEPTH)
    return shares.withColumns({c: steady(F.col(c), 9) for c in ("coverage", "weighted_pixels", "share")})


def e40_problems(s, d):
    frames, values = _values(s, d)
    shares = written(P.source_shares(written(values, "projected"), frames, ORDER, DEPTH), "shares")
    return P.share_problems(shares, frames, cells(s, d))


def r03_footprint(s, d):
    """Rings of frames of 1000 by 800 pixels, one at each object."""
    o = S.objects(s, d)
    frames = o.select(F.col("object_id").alias("frame"), "ra", (F.col("dec") * 0.9).alias("dec"), F.lit(500.0).alias("x0"), F.lit(400.0).alias("y0"), F.lit(-0.0005).alias("sx"), F.lit(0.0005).alias("sy"), F.lit(800).alias("height"), F.lit(1000).alias("width"), F.lit(1.0).alias("weight"))
    ring = P.footprint_rings(frames)
    return ring.withColumns({c: steady(F.col(c), 8) for c in ("ra", "dec", "continuous_ra")})


def h06_cone_cells(s, d):
    """Cells of cones of two to six degrees, one around each object."""
    cones = S.objects(s, d).select("object_id", "ra", "dec", (F.col("object_id") % 5 + 2.0).alias("radius"))
    return T.cones_cells(cones, "object_id", 5)


QUERIES = {f.__name__: f for f in (m31_projected, e40_tile_sources, e40_problems, r03_footprint, h06_cone_cells)}

_R = lambda x, n: f"floor(({x}) * 1e{n} + 0.3137) / 1e{n}"
_OBJECTS = S.OBJECTS.replace("objects AS", "stars AS", 1) + ', objects AS (SELECT object_id, ra, "dec" * 0.9::DOUBLE AS "dec" FROM stars)'
_PIXELS = f"""pixels AS (SELECT frame, y, x, v::DOUBLE AS value FROM (SELECT l_orderkey // 1500 AS frame, l_suppkey * 17 % {HEIGHT} AS y, l_partkey * 13 % {WIDTH} AS x, sum(CAST(floor(l_quantity) AS BIGINT)) AS v FROM lineitem GROUP BY ALL) WHERE (frame * 31 + y * 7 + x) % 101 <> 0),
 frames AS (SELECT frame, ra + 0.1::DOUBLE AS fra, "dec" AS fdec, CASE WHEN frame % 13 = 12 THEN 0.0::DOUBLE ELSE frame % 5 + 1.0::DOUBLE END AS weight FROM (SELECT DISTINCT l_orderkey // 1500 AS frame FROM lineitem) JOIN objects ON object_id = frame * 7 % 150 + 1)"""
_CELLS = f'{_cell_sql(ORDER)}, cells AS (SELECT DISTINCT "index" AS idx FROM cell)'
_DEEP = '(sin(radians("dec")) * sin(radians(fdec)) + cos(radians("dec")) * cos(radians(fdec)) * cos(radians(ra - fra)))'
_KERNEL = lambda d: f"CASE WHEN {d} <= 1 THEN (1.5::DOUBLE * {d} - 2.5::DOUBLE) * {d} * {d} + 1 ELSE ((-0.5::DOUBLE * {d} + 2.5::DOUBLE) * {d} - 4) * {d} + 2 END"
#: Every frame against every cell whose centre is near, and the sixteen neighbours of each of its pixels one by one.
_PROJECTED = f"""{_OBJECTS}, {_PIXELS}, {_CELLS}, src0 AS (SELECT idx, z, idx * {4**DEPTH} + z AS i FROM cells, range(0, {4**DEPTH}) r(z)), {_centre_sql(ORDER + DEPTH, "src0", "idx, z")},
 asked AS (SELECT frame, idx, z, degrees(cos(radians("dec")) * sin(radians(ra - fra)) / {_DEEP}) / {-SCALE}::DOUBLE + 7.5::DOUBLE AS u, degrees((sin(radians("dec")) * cos(radians(fdec)) - cos(radians("dec")) * sin(radians(fdec)) * cos(radians(ra - fra))) / {_DEEP}) / {SCALE}::DOUBLE + 5.5::DOUBLE AS v FROM centres JOIN frames ON abs("dec" - fdec) < 1 AND {_DEEP} > 0.99::DOUBLE),
 near AS (SELECT *, CAST(floor(u) AS BIGINT) AS bx, CAST(floor(v) AS BIGINT) AS b_y FROM asked WHERE u >= 1 AND v >= 1 AND u < {WIDTH - 2} AND v < {HEIGHT - 2}),
 n AS (SELECT frame, idx, z, bx + i AS x, b_y + j AS y, abs(u - bx - i) AS du, abs(v - b_y - j) AS dv FROM near, range(-1, 3) r(i), range(-1, 3) t(j)),
 projected AS (SELECT frame, idx, z, sum(value * {_KERNEL("du")} * {_KERNEL("dv")}) AS value FROM n JOIN pixels USING (frame, x, y) GROUP BY ALL HAVING count(*) = 16)"""
_SHARES = f"""counts AS (SELECT idx, frame, count(*) AS finite_pixels, count(*) * any_value(weight) AS weighted_pixels FROM projected JOIN frames USING (frame) WHERE weight > 0 GROUP BY idx, frame), shares AS (SELECT *, weighted_pixels / sum(weighted_pixels) OVER (PARTITION BY idx) AS share FROM counts)"""

_DOWN = "(cos(radians(fdec)) - v * sin(radians(fdec)))"
ORACLES = {
    "r03_footprint": f"""WITH {_OBJECTS}, e AS (SELECT object_id AS frame, ra AS fra, "dec" AS fdec, n, n // 16 % 4 AS edge, n % 16 / 16.0::DOUBLE AS t FROM objects, range(0, 65) r(n)), p AS (SELECT *, CASE edge WHEN 0 THEN t WHEN 1 THEN 1 WHEN 2 THEN 1 - t ELSE 0 END * 999 AS x, CASE edge WHEN 0 THEN 0 WHEN 1 THEN t WHEN 2 THEN 1 ELSE 1 - t END * 799 AS y FROM e),
        a AS (SELECT *, radians((x - 500) * -0.0005::DOUBLE) AS u, radians((y - 400) * 0.0005::DOUBLE) AS v FROM p), q AS (SELECT frame, n, fmod(fmod(fra + degrees(atan2(u, {_DOWN})), 360) + 360, 360) AS ra, degrees(atan2(sin(radians(fdec)) + v * cos(radians(fdec)), sqrt(u * u + {_DOWN} * {_DOWN}))) AS "dec" FROM a),
        w AS (SELECT *, CASE WHEN ra - lag(ra) OVER o > 180 THEN -360 WHEN ra - lag(ra) OVER o < -180 THEN 360 ELSE 0 END AS w FROM q WINDOW o AS (PARTITION BY frame ORDER BY n))
        SELECT frame, CAST(n AS INT) AS n, {_R("ra", 8)} AS ra, {_R('"dec"', 8)} AS "dec", {_R("ra + sum(w) OVER (PARTITION BY frame ORDER BY n)", 8)} AS continuous_ra FROM w""",
    "h06_cone_cells": f"""WITH {S.OBJECTS}, cones AS (SELECT object_id, ra AS cra, "dec" AS cdec, object_id % 5 + 2 AS radius FROM objects), src AS (SELECT i FROM range(0, {12 * 4**5}) r(i)), {_centre_sql(5, "src", "i")}
        SELECT object_id, 5 AS "order", i AS index FROM cones JOIN centres ON abs("dec" - cdec) < 9 AND degrees(acos(least(greatest(sin(radians("dec")) * sin(radians(cdec)) + cos(radians("dec")) * cos(radians(cdec)) * cos(radians(ra - cra)), -1), 1))) <= radius + {H.widest_radius(5)!r}::DOUBLE""",
    "m31_projected": f"WITH {_PROJECTED} SELECT frame, idx AS index, z, {_R('value', 5)} AS value FROM projected",
    "e40_tile_sources": f"""WITH {_PROJECTED}, {_SHARES} SELECT {ORDER} AS "order", idx AS index, frame, finite_pixels, {4**DEPTH} AS cell_pixels, {_R(f"finite_pixels / {4**DEPTH}", 9)} AS coverage, {_R("weighted_pixels", 9)} AS weighted_pixels, {_R("share", 9)} AS share FROM shares""",
    "e40_problems": f"""WITH {_PROJECTED}, {_SHARES} SELECT 'weight' AS problem, frame, NULL::BIGINT AS index FROM frames WHERE weight <= 0 UNION ALL SELECT 'idle-source', frame, NULL FROM frames WHERE weight > 0 AND frame NOT IN (SELECT frame FROM shares)
        UNION ALL SELECT 'cell-without-source', NULL, idx FROM cells WHERE idx NOT IN (SELECT idx FROM shares)""",
}
