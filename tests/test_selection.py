"""Percentiles by selection against numpy, for values of all kinds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterbrook.operators.selection import exact_percentiles

POINTS = {"a": 0, "b": 0.5, "c": 33.3, "d": 50, "e": 99.5, "f": 100}


@pytest.mark.parametrize("ranges", [2, 1024])
def test_percentiles(spark, ranges):
    rng = np.random.default_rng(1)
    groups = {
        1: rng.normal(size=700), 2: np.full(50, 0.25), 3: rng.integers(0, 3, 400).astype(float), 4: np.array([7.0]), 5: np.array([-1e308, 1e308, 0.0, 5e-324, 1e-300]),
        6: np.concatenate([np.zeros(300), rng.random(300) * 1e-12, [1e12]]),
    }
    rows = [(k, float(v)) for k, g in groups.items() for v in g] + [(1, None), (1, float("nan")), (2, float("inf")), (8, None)]
    df = spark.createDataFrame(rows, "image_id long, v double").repartition(6)
    got = {r.image_id: r for r in exact_percentiles(df, F.col("v"), POINTS, ranges=ranges).collect()}
    assert set(got) == set(groups)
    for k, g in groups.items():
        with np.errstate(over="ignore"):
            for n, p in POINTS.items():
                s, at = np.sort(g), p / 100 * (len(g) - 1)
                lo, hi = s[int(np.floor(at))], s[int(np.ceil(at))]
                assert np.isclose(got[k][n], lo + (hi - lo) * (at - np.floor(at)), rtol=1e-12, atol=0, equal_nan=True)
    assert exact_percentiles(df.limit(0), F.col("v"), POINTS).collect() == []


def test_the_plan_counts_before_it_shuffles(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("image_id"), (F.col("id") * 0.37 % 1).alias("v"))
    got = exact_percentiles(df, F.col("v"), {"m": 50})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate(keys" in plan and "percentile" not in plan and got.count() == 2
