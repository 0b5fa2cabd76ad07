"""Very frequent values take a path of their own: the same results when every sampled value counts as one."""

import pytest

from rasterbrook.llm import common, jaccard, suffix_dedup

from .test_sets import DOCS, brute_components
from .test_suffix_dedup import SCHEMA, brute, made


@pytest.fixture
def all_hot(monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", common.SAMPLE)


def test_repeated(spark, all_hot):
    from pyspark.sql import functions as F

    rows = spark.range(4000).selectExpr("id", "id % 700 + (id % 3) * (id % 1000) as v")
    one_of = F.pmod(F.hash("id"), F.lit(common.SAMPLE)) == 0
    got = {(r.id, r.v): r.df for r in common.repeated(rows, "v", one_of, "t").collect()}
    hot = {r.v for r in rows.where(one_of).collect()}
    counts = {r.v: r["count"] for r in rows.groupBy("v").count().collect()}
    assert got == {(r.id, r.v): 1 << 40 if r.v in hot else counts[r.v] for r in rows.collect() if counts[r.v] > 1 or r.v in hot}


def test_suffixes(spark, all_hot):
    rows = made(7)
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, SCHEMA), span=40, k=12).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows, 40)


def test_sets(spark, all_hot):
    line = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{line} {i % 7}") for i in range(300)] + [(None, f"{line} x{i}") for i in range(200)] + [(400 + i, f"other text {i} of its own") for i in range(90)]
    df = spark.createDataFrame([(i, t, "x", "y", 0) for i, t in rows], DOCS)
    got = sorted(map(tuple, jaccard.jaccard_join(df).collect()), key=str)
    assert got == sorted(brute_components(rows), key=str)
