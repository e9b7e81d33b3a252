"""Raster queries, on pixels made of the frame table: seven frames of up to 4000 by 250 pixels, as many as the table has parts and suppliers for, some values far off."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.functions.maths import steady
from starloom.operators import coadd as C
from starloom.operators import raster as P
from starloom.sources import tables as S
from starloom.sources.publication import Published
from starloom.sources.storage import scratch


def pixels(s, d):
    line = S.table(s, d, "lineitem")
    cents = F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("bigint") % 100000
    rows = line.groupBy(F.col("l_linenumber").alias("frame"), (F.col("l_partkey") % 4000).alias("y"), (F.col("l_suppkey") % 250).alias("x")).agg(F.sum(cents).alias("c"), F.count(F.lit(1)).alias("n"))
    spike = F.when((F.col("y") * 25 + F.col("x") + F.col("frame") * 13) % 97 == 0, 100000.0).otherwise(0.0)
    return rows.select("frame", "y", "x", (F.col("c") / F.col("n") / 100 + spike).alias("value"), (F.col("frame") % 3 + 1).cast("double").alias("weight"))


def _frame(s, d, n):
    return pixels(s, d).where(F.col("frame") == n).select("y", "x", "value")


def m39_calibrated(s, d):
    light = pixels(s, d).where("frame <= 3")
    out = P.calibrated(light, _frame(s, d, 5), _frame(s, d, 6), _frame(s, d, 7), 0.5)
    return _round(out, 6, "value")


def _round(df, digits, *columns):
    return df.withColumns({c: steady(F.col(c), digits) for c in columns})


def r16_composite(s, d):
    return _round(P.composite(pixels(s, d).select(F.col("frame").alias("layer"), "y", "x", "value", (F.col("frame") % 4 / 4.0).alias("alpha"))), 6, "value")


def r12_coadd(s, d):
    """Frames added in three batches, one of them sent twice and one frame in two batches; the rows are those of one pass."""
    place = Published(s, scratch(s, "coadd"))
    frames = pixels(s, d)
    for some in ("frame IN (7, 2, 5)", "frame IN (3, 7)", "frame IN (3, 7)", "frame IN (1, 4, 6)"):
        C.added(place, frames.where(some))
    return _round(C.result(place), 6, "value")


QUERIES = {
    "r12_coadd": r12_coadd,
    "a28_master_frame": lambda s, d: _round(P.master_frame(pixels(s, d)), 6, "value"),
    "a29_sigma_clipped": lambda s, d: _round(P.sigma_clipped(pixels(s, d)), 6, "value"),
    "a30_coadded": lambda s, d: _round(P.coadded(pixels(s, d)), 6, "value"),
    "a31_coverage": lambda s, d: _round(P.coverage(P.coadded(pixels(s, d)), 4000, 250), 9, "covered", "mean_depth"),
    "a32_display_limits": lambda s, d: _round(P.display_limits(pixels(s, d)), 6, "low", "high"),
    "a33_downsampled": lambda s, d: _round(P.downsampled(pixels(s, d), 4), 6, "value"),
    "a35_fractions": lambda s, d: _round(P.fractions(pixels(s, d), 100000.0, 300.0), 9, "saturated", "clipped_black", "usable"),
    "m29_stretched": lambda s, d: P.stretched(pixels(s, d), P.display_limits(pixels(s, d))),
    "m39_calibrated": m39_calibrated,
    "r16_composite": r16_composite,
}

_PIXELS = """means AS (SELECT l_linenumber AS frame, l_partkey % 4000 AS y, l_suppkey % 250 AS x, sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) % 100000)::DOUBLE / count(*) / 100 AS v FROM lineitem GROUP BY ALL),
 pixels AS (SELECT frame, y, x, v + CASE WHEN (y * 25 + x + frame * 13) % 97 = 0 THEN 100000 ELSE 0 END AS value, CAST(frame % 3 + 1 AS DOUBLE) AS weight FROM means)"""
_R = lambda x, n=6: f"floor(({x}) * 1e{n} + 0.3137) / 1e{n}"
_COADD = "coadd AS (SELECT y, x, sum(weight * value) / sum(weight) AS value, sum(weight) AS weight, count(*) AS depth FROM pixels GROUP BY ALL)"
_LIMITS = "limits AS (SELECT frame, quantile_cont(value, 0.005::DOUBLE) AS low, quantile_cont(value, 0.997::DOUBLE) AS high FROM pixels GROUP BY frame)"

ORACLES = {
    "a28_master_frame": f"WITH {_PIXELS} SELECT y, x, {_R('median(value)')} AS value, count(*) AS frames FROM pixels GROUP BY ALL",
    "a29_sigma_clipped": f"""WITH {_PIXELS}, m AS (SELECT *, median(value) OVER (PARTITION BY y, x) AS med FROM pixels), o AS (SELECT *, abs(value - med) AS dev FROM m), s AS (SELECT *, 1.4826::DOUBLE * median(dev) OVER (PARTITION BY y, x) AS sigma FROM o),
        k AS (SELECT *, 1.1920928955078125e-07::DOUBLE * greatest(1, abs(med)) AS tol FROM s) SELECT y, x, {_R("sum(weight * value) / sum(weight)")} AS value, count(*) AS kept FROM k WHERE CASE WHEN sigma > tol THEN dev <= 3 * sigma ELSE dev <= tol END GROUP BY ALL""",
    "a30_coadded": f"WITH {_PIXELS}, {_COADD} SELECT y, x, {_R('value')} AS value, weight, depth FROM coadd",
    "r12_coadd": f"WITH {_PIXELS}, {_COADD} SELECT y, x, {_R('value')} AS value, weight, depth FROM coadd",
    "a31_coverage": f"WITH {_PIXELS}, {_COADD} SELECT {_R('count(*) / 1000000', 9)} AS covered, {_R('avg(depth)', 9)} AS mean_depth, max(depth) AS max_depth FROM coadd",
    "a32_display_limits": f"WITH {_PIXELS}, {_LIMITS} SELECT frame, {_R('low')} AS low, {_R('high')} AS high FROM limits",
    "a33_downsampled": f"WITH {_PIXELS} SELECT frame, y // 4 AS y, x // 4 AS x, {_R('avg(value)')} AS value, count(*) AS n FROM pixels GROUP BY ALL",
    "a35_fractions": f"WITH {_PIXELS} SELECT frame, {_R('avg((value >= 100000)::INT)', 9)} AS saturated, {_R('avg((value <= 300)::INT)', 9)} AS clipped_black, 1.0::DOUBLE AS usable FROM pixels GROUP BY frame",
    "m29_stretched": f"""WITH {_PIXELS}, {_LIMITS} SELECT frame, y, x, CAST(floor(asinh(10 * least(greatest((value - low) / greatest(high - low, 1e-12::DOUBLE), 0), 1)) / asinh(10::DOUBLE) * 255 + 0.5) AS INT) AS level FROM pixels JOIN limits USING (frame)""",
    "m39_calibrated": f"""WITH {_PIXELS}, lv AS (SELECT median(value) AS level FROM pixels WHERE frame = 7), j AS (SELECT l.frame, l.y, l.x, l.value - coalesce(b.value, 0) - coalesce(k.value, 0) * 0.5::DOUBLE AS v, f.value / level AS norm, f.value AS f
        FROM lv, pixels l LEFT JOIN pixels b ON b.frame = 5 AND b.y = l.y AND b.x = l.x LEFT JOIN pixels k ON k.frame = 6 AND k.y = l.y AND k.x = l.x LEFT JOIN pixels f ON f.frame = 7 AND f.y = l.y AND f.x = l.x WHERE l.frame <= 3)
        SELECT frame, y, x, {_R("CASE WHEN f IS NULL THEN v WHEN norm > 0.05 THEN v / norm END")} AS value FROM j""",
    "r16_composite": f"""WITH {_PIXELS}, l AS (SELECT y, x, max(CASE WHEN frame = 1 THEN value END) v1, max(CASE WHEN frame = 2 THEN value END) v2, max(CASE WHEN frame = 3 THEN value END) v3, max(CASE WHEN frame = 5 THEN value END) v5,
        max(CASE WHEN frame = 6 THEN value END) v6, max(CASE WHEN frame = 7 THEN value END) v7 FROM pixels GROUP BY ALL), s AS (SELECT *, coalesce(0.25 * v1, 0)::DOUBLE AS s1 FROM l), s2 AS (SELECT *, CASE WHEN v2 IS NULL THEN s1 ELSE 0.5::DOUBLE * v2 + 0.5::DOUBLE * s1 END AS a2 FROM s),
        s3 AS (SELECT *, CASE WHEN v3 IS NULL THEN a2 ELSE 0.75::DOUBLE * v3 + 0.25::DOUBLE * a2 END AS a3 FROM s2), s5 AS (SELECT *, CASE WHEN v5 IS NULL THEN a3 ELSE 0.25::DOUBLE * v5 + 0.75::DOUBLE * a3 END AS a5 FROM s3),
        s6 AS (SELECT *, CASE WHEN v6 IS NULL THEN a5 ELSE 0.5::DOUBLE * v6 + 0.5::DOUBLE * a5 END AS a6 FROM s5), s7 AS (SELECT *, CASE WHEN v7 IS NULL THEN a6 ELSE 0.75::DOUBLE * v7 + 0.25::DOUBLE * a6 END AS a7 FROM s6) SELECT y, x, {_R("a7")} AS value FROM s7""",
}
