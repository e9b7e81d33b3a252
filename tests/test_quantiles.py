import random

import numpy as np
import pytest

from starloom.operators.quantiles import exact_quantiles
from starloom.operators.raster import sigma_clipped


@pytest.mark.parametrize("buckets", [2, 7, 1024])
def test_quantiles_equal_numpy(spark, buckets):
    r = random.Random(buckets)
    groups = {
        "even": [r.uniform(-5, 5) for _ in range(500)],
        "ties": [r.choice([1.0, 2.0, 2.5]) for _ in range(301)],
        "one": [7.0],
        "two": [1.0, 4.0],
        "far": [r.gauss(0, 1) for _ in range(200)] + [1e300, -1e300],
        None: [r.expovariate(1) for _ in range(77)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("even", None), ("one", float("nan")), ("none", None)]
    shares = [0.0, 0.005, 0.5, 0.997, 1.0]
    got = {(x.g, x.share): x.value for x in exact_quantiles(spark.createDataFrame(rows, "g string, value double").repartition(3), "g", shares, buckets=buckets).collect()}
    assert set(got) == {(g, q) for g in groups for q in shares}
    for (g, q), v in got.items():
        assert np.isclose(v, np.quantile(groups[g], q), rtol=1e-12, atol=1e-12), (g, q)


def test_no_values(spark):
    assert exact_quantiles(spark.createDataFrame([], "g string, value double"), "g", [0.5]).count() == 0


def test_clipping_needs_one_shuffle(spark):
    rows = spark.createDataFrame([(f, 0, x, float(f if f < 6 else 1000), 1.0) for f in range(7) for x in range(3)], "frame int, y int, x int, value double, weight double")
    out = sigma_clipped(rows)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {(r.x, r.value, r.kept) for r in out.collect()} == {(x, 2.5, 6) for x in range(3)}
