"""Source extraction against a flood fill, and on frames with known sources."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from starloom.operators import extraction as E
from starloom.operators.graph import components

PIXELS = "frame long, y long, x long, value double"


def flood(pixels):
    """Regions of touching pixels, one pixel at a time."""
    left, out = set(pixels), {}
    while left:
        first = min(left)
        todo, region = [first], {first}
        left.discard(first)
        while todo:
            y, x = todo.pop()
            for n in [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]:
                if n in left:
                    left.discard(n)
                    region.add(n)
                    todo.append(n)
        out |= {p: min(region) for p in region}
    return out


@pytest.mark.parametrize(("share", "strip"), [(0.2, 4), (0.45, 3), (0.6, 64), (0.45, 1)])
def test_labels_equal_a_flood_fill(spark, share, strip):
    r = random.Random(int(share * 100) + strip)
    frames = {f: {(y, x) for y in range(23) for x in range(31) if r.random() < share} for f in (1, 2)}
    frames[3] = {(y, 5 if y % 4 else x) for y in range(21) for x in range(5, 9)}  # a snake over all strips
    rows = [(f, y, x, 1.0) for f, ps in frames.items() for y, x in ps]
    got = defaultdict(dict)
    for p in E.labelled(spark.createDataFrame(rows, PIXELS).repartition(3), strip).collect():
        got[p.frame][p.y, p.x] = (p.label // E._ROW, p.label % E._ROW)
    assert {f: dict(v) for f, v in got.items()} == {f: flood(ps) for f, ps in frames.items()}


def test_components_of_chains(spark):
    links = [(1, i, i + 1) for i in range(200)] + [(1, 500, 501), (2, 7, 3), (2, 3, 3)]
    got = {(r.g, r.node): r.root for r in components(spark.createDataFrame(links, "g int, a long, b long"), "g").collect()}
    assert got == {(1, i): 0 for i in range(201)} | {(1, 500): 500, (1, 501): 500, (2, 7): 3, (2, 3): 3}
    assert components(spark.createDataFrame([], "g int, a long, b long"), "g").count() == 0


def star_frame(frame, stars, tilt, seed=1, size=96):
    """A tilted sky with noise and gaussian stars (y, x, height, width in pixels)."""
    r = random.Random(seed)
    out = []
    for y in range(size):
        for x in range(size):
            v = 1000 + tilt * x + r.gauss(0, 4)
            for cy, cx, height, sy, sx in stars:
                v += height * math.exp(-((y - cy) ** 2) / (2 * sy * sy) - (x - cx) ** 2 / (2 * sx * sx))
            out.append((frame, y, x, v))
    return out


def test_stars_are_found_over_a_tilted_sky(spark):
    stars = [(20.0, 20.0, 900.0, 1.5, 1.5), (60.3, 30.7, 400.0, 1.2, 2.4), (63.6, 70.2, 700.0, 1.5, 1.5), (32.0, 64.0, 500.0, 1.5, 1.5)]
    rows = star_frame(1, stars, 0.0) + star_frame(2, stars, 1.0, 2) + star_frame(3, [], 1.0, 3)
    rows = [(f, y, x, None if (y, x) == (5, 5) else float("nan") if (y, x) == (6, 6) else v) for f, y, x, v in rows]
    df = spark.createDataFrame(rows, PIXELS).repartition(4)
    got = defaultdict(list)
    for s in E.detected(df, box=32, strip=16).collect():
        got[s.frame].append(s)
    assert set(got) == {1, 2}
    for f in (1, 2):
        assert len(got[f]) == len(stars)
        for cy, cx, height, sy, sx in stars:
            [s] = [s for s in got[f] if abs(s.cy - cy) < 0.3 and abs(s.cx - cx) < 0.3]
            assert abs(s.flux / (2 * math.pi * height * sy * sx) - 1) < 0.2 and 0.8 * height < s.peak < 1.1 * height
            assert (s.a / s.b > 1.4) == (sx > 2) and s.area >= 5
    quality = {q.frame: q for q in E.frame_quality(E.detected(df, box=32), 2.0, least=4).collect()}
    assert quality[1].stars == 4 and abs(quality[1].fwhm_arcsec - 2.3548 * 1.5 * 2.0) < 1 and not quality[1].tracking_error


def test_background_follows_a_plane(spark):
    df = spark.createDataFrame([(0, y, x, 5.0 * x + 3.0 * y) for y in range(64) for x in range(64)], PIXELS)
    mesh = E.box_statistics(df, 16)
    assert mesh.count() == 16
    inner = E.without_background(df, mesh, 16).where(F.col("y").between(8, 55) & F.col("x").between(8, 55))
    assert inner.agg(F.max(F.abs("value"))).first()[0] < 1e-6


def test_frames_without_pixels_or_noise(spark):
    assert E.detected(spark.createDataFrame([], PIXELS)).count() == 0
    flat = [(1, y, x, 7.0) for y in range(20) for x in range(20)]
    assert E.detected(spark.createDataFrame(flat, PIXELS)).count() == 0
