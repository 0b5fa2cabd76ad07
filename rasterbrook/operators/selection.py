"""Exact percentiles by selection: counts of value ranges tell which range holds a rank, and only that is looked at again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scratch import discard, settled


def exact_percentiles(df: DataFrame, value: Column, points: dict[str, float], key: str = "image_id", ranges: int = 1024) -> DataFrame:
    """(key, one column per point) with linear interpolation, points in 0..100; nulls and values that aren't finite don't count.

    Each pass counts the values of every open rank's range in equal parts of it, combined before the shuffle, so a
    group of any size is a few counts a task; the part that holds the rank is the next pass's range, from its least
    to its largest value. After the first pass only values within those parts are kept. A rank is found when its range is
    one value; ranges shrink a thousandfold a pass, so a few passes do. No task holds a group's values.
    """
    v = value.cast("double")
    rows = df.select(F.col(key).alias("k"), v.alias("v")).where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    ends = settled(rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    at = {name: F.lit(p / 100.0) * (F.col("n") - 1) for name, p in points.items()}
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(c), F.ceil(c)) for c in at.values()])))
    targets = settled(ends.select("k", F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("below"), "lo", "hi"))
    kept = None
    while True:
        open_ = targets.where("lo < hi")
        if open_.isEmpty():
            break
        asked = open_.select(F.col("k").alias("t"), "rank", "below", "lo", "hi")
        hit = rows.join(asked, (F.col("k") == F.col("t")) & F.col("v").between(F.col("lo"), F.col("hi")))
        half = F.when(F.greatest(F.abs("lo"), F.abs("hi")) > 1e300, 0.5).otherwise(1.0)  # so that no difference overflows
        part = F.floor((F.col("v") * half - F.col("lo") * half) / (F.col("hi") * half - F.col("lo") * half) * ranges)
        parts = hit.groupBy("k", "rank", "below", F.least(part, F.lit(ranges - 1)).alias("part")).agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        parts = parts.withColumn("upto", F.col("below") + F.sum("c").over(W.partitionBy("k", "rank").orderBy("part")))
        found = parts.where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("c") <= F.col("rank")))
        now = settled(targets.where("lo = hi").unionByName(found.select("k", "rank", (F.col("upto") - F.col("c")).alias("below"), "lo", "hi")))
        if kept is None:
            spans = now.where("lo < hi").select(F.col("k").alias("t"), "lo", "hi").distinct()
            rows = kept = settled(rows.join(spans, (F.col("k") == F.col("t")) & F.col("v").between(F.col("lo"), F.col("hi")), "left_semi"))
        discard(targets)
        targets = now
    if kept is not None:
        discard(kept)
    values = targets.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("rank", "lo"))).alias("_at")).withColumnRenamed("k", "_k")
    both = ends.join(values, F.col("k") == F.col("_k"))
    low = {n: F.element_at("_at", F.floor(c)) for n, c in at.items()}
    return both.select(F.col("k").alias(key), *[(low[n] + (F.element_at("_at", F.ceil(c)) - low[n]) * (c - F.floor(c))).alias(n) for n, c in at.items()])


def interpolated(a: Column, b: Column, d: Column) -> Column:
    """a * (1 - d) + b * d, the first product not rounded by itself: as a fused multiply-add, the SQL's way, gives it.

    The product's error is told by halves of its factors' digits, the sum's by what is missing from it.
    """
    halves = lambda c: (c * 134217729.0 - (c * 134217729.0 - c), c - (c * 134217729.0 - (c * 134217729.0 - c)))
    rest = 1.0 - d
    (a1, a2), (r1, r2) = halves(a), halves(rest)
    p, q = a * rest, b * d
    lost = ((a1 * r1 - p) + a1 * r2 + a2 * r1) + a2 * r2
    s = p + q
    missing = (p - (s - (s - p))) + (q - (s - p))
    return s + (missing + lost)


def ranked_percentiles(df: DataFrame, value: Column, points: dict[str, float], key: str = "image_id") -> DataFrame:
    """(key, one column per point) with linear interpolation to the last bit as the SQL's, points in 0..100; nulls don't count.

    Values are counted, and sums of the counts in order tell each rank: Spark sorts on disk where a group is large. For
    percentiles that values are compared with, where the last bit decides.
    """
    rows = df.select(F.col(key), value.alias("_v")).where("_v is not null").groupBy(key, "_v").agg(F.count("*").alias("_c"))
    w = W.partitionBy(key)
    rows = rows.withColumns({"_upto": F.sum("_c").over(w.orderBy("_v").rowsBetween(W.unboundedPreceding, 0)), "_all": F.sum("_c").over(w)})
    at = {n: F.lit(p / 100) * (F.col("_all") - 1) for n, p in points.items()}
    found = []
    for n, c in at.items():
        found += [F.min(F.when(F.col("_upto") > i, F.col("_v"))).alias(f"_{k}_{n}") for k, i in (("a", F.floor(c)), ("b", F.ceil(c)))] + [F.max(c - F.floor(c)).alias(f"_d_{n}")]
    return rows.groupBy(key).agg(*found).select(key, *[interpolated(F.col(f"_a_{n}"), F.col(f"_b_{n}"), F.col(f"_d_{n}")).alias(n) for n in points])
