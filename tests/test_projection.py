"""Footprints against cells, and bicubic values on a cell's own pixels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.functions import healpix as H
from starloom.operators import projection as P

GEOMETRY = "frame long, ra double, dec double, x0 double, y0 double, sx double, sy double, height int, width int, weight double"
ORDER, DEPTH = 6, 4


def frames(spark, rows):
    return spark.createDataFrame([(f, ra, dec, 15.5, 11.5, -0.05, 0.05, 24, 32, w) for f, ra, dec, w in rows], GEOMETRY)


def inside(ra, dec, corners):
    """Whether positions lie on the inner side of every edge."""
    unit = lambda a, d: np.stack([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)], -1)
    v = unit(*np.radians(np.array([[c.ra, c.dec] for c in corners]).T))
    p = unit(np.radians(ra), np.radians(dec))
    side = np.stack([p @ np.cross(v[i], v[(i + 1) % len(v)]) for i in range(len(v))], -1)
    return (side > 0).all(-1) | (side < 0).all(-1)


@pytest.mark.parametrize(("ra", "dec"), [(10.0, 0.0), (200.0, 88.9), (359.7, -41.8)])
def test_cover_holds_what_lies_in_the_polygon(spark, ra, dec):
    feet = P.footprints(frames(spark, [(1, ra, dec, 1.0)]))
    corners = feet.first().corners
    cover = P.polygon_cover(feet, 8).collect()
    taken = [(r["index"] << 2 * (8 - r.order), (r["index"] + 1) << 2 * (8 - r.order), r.inside) for r in cover]
    taken.sort()
    assert all(a[1] <= b[0] for a, b in zip(taken, taken[1:]))  # no cell twice
    near = [c for low, high, _ in taken for c in range(low, high)]
    parents = sorted({c >> 6 for c in near})
    every = spark.createDataFrame([(p * 64 + k,) for p in parents for k in range(64)], "cell long")
    for r in H.with_centre(every, "cell", 8).collect():
        hit = [t for t in taken if t[0] <= r.cell < t[1]]
        within = bool(inside(np.array(r.centre_ra), np.array(r.centre_dec), corners))
        assert hit or not within
        assert within or not (hit and hit[0][2])


def test_cells_touched_above_and_below_the_cover(spark):
    cover = spark.createDataFrame([(1, 4, 700, True), (2, 6, 700 * 16 + 3, False)], "frame int, order int, index long, inside boolean")
    cells = spark.createDataFrame([(3, 175), (4, 700), (6, 700 * 16 + 3), (6, 700 * 16 + 4), (7, 3), (8, 700 * 256 + 3 * 16 + 1)], "order int, index long")
    got = {(r.frame, r.order, r["index"]) for r in P.cells_touched(cover, cells).collect()}
    assert got == {(1, 3, 175), (1, 4, 700), (1, 6, 11203), (1, 6, 11204), (1, 8, 179249), (2, 3, 175), (2, 4, 700), (2, 6, 11203), (2, 8, 179249)}
    plan = P.cells_touched(cover, cells)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_bicubic_values_and_masks(spark):
    """A plane comes out as it is; a masked pixel takes the sixteen-neighbour squares around it away, and shares add up."""
    geometry = frames(spark, [(1, 40.0, 10.0, 1.0), (2, 40.2, 10.1, 3.0), (3, 40.0, 10.0, 0.0), (4, 300.0, -80.0, 1.0)])
    rows = [(f, y, x, 3.0 * x - 2.0 * y + f) for f in (1, 2, 3) for y in range(24) for x in range(32) if (f, y, x) != (1, 12, 16)]
    pixels = spark.createDataFrame(rows, "frame long, y int, x int, value double").repartition(3)
    cells = P.polygon_cover(P.footprints(geometry.where("frame < 3")), ORDER).select("order", "index").distinct()
    touched = P.cells_touched(P.polygon_cover(P.footprints(geometry), ORDER + 2), cells)
    values = P.projected(pixels, geometry, touched, ORDER, DEPTH, 8).collect()
    at = H.with_centre(spark.createDataFrame([(r.frame, r["index"] * 4**DEPTH + r.z, r.value) for r in values], "frame long, fine long, value double"), "fine", ORDER + DEPTH).toPandas()
    wcs = {r.frame: r.asDict() for r in geometry.collect()}
    for f, part in at.groupby("frame"):
        u, v = P.pixel_of(part.centre_ra.to_numpy(), part.centre_dec.to_numpy(), wcs[f])
        assert np.allclose(part.value, 3 * u - 2 * v + f, atol=1e-9)
        if f == 1:
            assert not ((np.floor(u) >= 14) & (np.floor(u) <= 17) & (np.floor(v) >= 10) & (np.floor(v) <= 13)).any()
    df = spark.createDataFrame(values, "frame long, index long, z long, value double")
    shares = P.source_shares(df, geometry, ORDER, DEPTH)
    got = shares.groupBy("index").agg(F.sum("share").alias("s"), F.max("coverage").alias("c")).collect()
    assert all(abs(r.s - 1) < 1e-12 and 0 < r.c <= 1 for r in got)
    problems = {(r.problem, r.frame) for r in P.share_problems(shares, geometry, cells.unionByName(spark.createDataFrame([(ORDER, 1)], "order int, index long"))).collect()}
    assert {("weight", 3), ("idle-source", 4), ("cell-without-source", None)} <= problems
