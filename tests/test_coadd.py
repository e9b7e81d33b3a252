"""The growing coadd: order, batches, repeats and odd pixels."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from starloom.operators import coadd, raster
from starloom.sources.publication import Published
from starloom.sources.storage import scratch

PIXELS = "frame string, y int, x int, value double, weight double"


def frames(seed=3):
    r = random.Random(seed)
    out = [(f, y, x, r.choice([r.gauss(10, 3), r.gauss(10, 3), None, float("nan")]), float(1 + i % 3)) for i, f in enumerate("abcde") for y in range(4) for x in range(5)]
    return out + [("e", 0, 0, 7.0, 0.0), ("odd", 1, 1, 5.0, -1.0)]


def test_any_order_and_number_of_batches_gives_the_same_rows(spark):
    rows = [r for r in frames() if r[:3] != ("e", 0, 0)]
    want = {(r.y, r.x): r for r in raster.coadded(spark.createDataFrame(rows, PIXELS)).collect()}
    for batches in (["abcde", "odd"], ["c", "ea", "odd", "bd"], ["abcde", "abcde", "odd"], ["ab", "bc", "cd", "dea", "odd"]):
        place = Published(spark, scratch(spark, "coadd"))
        for names in batches:
            some = [r for r in rows if r[0] in (["odd"] if names == "odd" else names)]
            coadd.added(place, spark.createDataFrame(some + some[:3], PIXELS))
        got = {(r.y, r.x): r for r in coadd.result(place).collect()}
        assert got.keys() == want.keys()
        for k, r in want.items():
            assert got[k].value == pytest.approx(r.value, abs=1e-12) and (got[k].weight, got[k].depth) == (r.weight, r.depth)
        left = coadd.missing(place, spark.createDataFrame([("a",), ("odd",), ("z",)], "frame string")).collect()
        assert [r.frame for r in left] == ["z"]


def test_a_batch_sent_again_changes_nothing(spark):
    place = Published(spark, scratch(spark, "coadd"))
    df = spark.createDataFrame([r for r in frames() if r[0] in "ab"], PIXELS)
    first = coadd.added(place, df)
    again = coadd.added(place, df)
    assert (first.rows, first.digest) == (again.rows, again.digest) and again.number == 2


def test_an_empty_coadd(spark):
    place = Published(spark, scratch(spark, "coadd"))
    assert coadd.result(place).count() == 0
    coadd.added(place, spark.createDataFrame([], PIXELS))
    assert coadd.result(place).count() == 0
