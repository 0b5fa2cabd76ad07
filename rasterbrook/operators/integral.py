"""Sums over rectangles and boxes by prefix sums, so that their size costs nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .neighbourhood import KEYS, sizes
from .stats import join_back

#: Corners of a rectangle in the table of sums: sign, and whether the first or the last row and column count.
_CORNERS = ((1, "y1", "x1"), (-1, "y0", "x1"), (-1, "y1", "x0"), (1, "y0", "x0"))


def summed_area(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(image_id, y, x, values): each value summed over all pixels above and to the left, the own one included.

    Two running sums, along lines and along columns of an image: no task needs more of an image than that.
    Null counts as nothing; every pixel of the image has to be there.
    """
    df = df.select(*KEYS, *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in values.items()])
    for across, along in (("y", "x"), ("x", "y")):
        w = W.partitionBy("image_id", across).orderBy(along).rowsBetween(W.unboundedPreceding, 0)
        df = df.withColumns({n: F.sum(n).over(w) for n in values})
    return df


def rectangle_sums(table: DataFrame, rects: DataFrame, values: Sequence[str]) -> DataFrame:
    """(image_id, region, values): sums over rectangles (image_id, region, y0, x0, y1, x1; ends excluded) by four look-ups each.

    A rectangle has to lie within its image. Look-ups are one equi-join; a rectangle's sum is combined before its shuffle.
    """
    corners = F.array(*[F.struct(F.lit(s).alias("s"), (F.col(y) - 1).alias("y"), (F.col(x) - 1).alias("x")) for s, y, x in _CORNERS])
    asked = rects.select(F.col("image_id").alias("_i"), "region", F.explode(corners).alias("_c")).where("_c.y >= 0 and _c.x >= 0")
    met = asked.join(table, (F.col("_i") == F.col("image_id")) & (F.col("_c.y") == F.col("y")) & (F.col("_c.x") == F.col("x")))
    return met.groupBy("image_id", "region").agg(*[F.sum(F.col("_c.s") * F.col(v)).alias(v) for v in values])


def grid_rectangles(sizes: DataFrame, grids: Sequence[int]) -> DataFrame:
    """The cells of grids of several sizes as rectangles of each image (image_id, h, w): region is grid_<cells>_<row>_<column>."""
    cells = F.array(*[F.struct(F.lit(g).alias("g"), F.lit(i).alias("i"), F.lit(j).alias("j")) for g in grids for i in range(g) for j in range(g)])
    rows = sizes.select("image_id", "h", "w", F.explode(cells).alias("c"))
    cut = lambda i, n: F.floor(i * F.col(n) / F.col("c.g")).cast("long")
    i, j = F.col("c.i"), F.col("c.j")
    rows = rows.select(
        "image_id", F.format_string("grid_%d_%d_%d", "c.g", "c.i", "c.j").alias("region"),
        cut(i, "h").alias("y0"), cut(j, "w").alias("x0"), cut(i + 1, "h").alias("y1"), cut(j + 1, "w").alias("x1"),
    )
    return rows.where("y1 > y0 and x1 > x0")


def rectangle_stats(df: DataFrame, rects: DataFrame, value: str) -> DataFrame:
    """(image_id, region, n, mean, std) of a value in each rectangle."""
    table = summed_area(df, {"n": F.lit(1.0), "s": F.col(value), "q": F.col(value) * F.col(value)})
    got = rectangle_sums(table, rects, ("n", "s", "q"))
    mean = F.col("s") / F.col("n")
    # Differences of sums leave noise where there is no variance.
    std = F.sqrt(F.greatest(F.round(F.col("q") / F.col("n") - mean * mean, 12), F.lit(0.0)))
    return got.select("image_id", "region", F.col("n").cast("long").alias("n"), mean.alias("mean"), std.alias("std"))


def grid_stats(df: DataFrame, grids: Sequence[int], value: str) -> DataFrame:
    """rectangle_stats of grid_rectangles: a pixel lies in one cell of each grid, so one aggregate does without look-ups."""
    df = join_back(df.select(*KEYS, value), sizes(df))
    cell = lambda i, n, g: F.floor((F.col(i) * g + g - 1) / F.col(n)).cast("int")  # noqa: E731  # of borders at floor(k * n / g)
    cells = F.array(*[F.struct(F.lit(g).alias("g"), cell("y", "h", g).alias("i"), cell("x", "w", g).alias("j")) for g in grids])
    dealt = df.select("image_id", value, F.explode(cells).alias("_c")).select("image_id", value, "_c.g", "_c.i", "_c.j")
    got = dealt.groupBy("image_id", "g", "i", "j").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return got.select("image_id", F.format_string("grid_%d_%d_%d", "g", "i", "j").alias("region"), "n", "mean", "std")


def box_means(df: DataFrame, values: Sequence[str], half: Column) -> DataFrame:
    """df with each value replaced by its mean over 2 * half + 1 pixels both ways, mirrored at the borders (edge not repeated).

    half is a column, the same for an image, and at most a line's length less one counts. Prefix sums of a line make
    a mean three look-ups whatever its size; a line of one image is gathered, never an image. Other columns travel along.
    """
    kept = [c for c in df.columns if c not in (*KEYS, *values, "_k")]
    df = df.withColumn("_k", half.cast("int"))
    for across, along in (("y", "x"), ("x", "y")):
        w = W.partitionBy("image_id", across).orderBy(along).rowsBetween(W.unboundedPreceding, 0)
        df = df.withColumns({f"_c_{v}": F.sum(v).over(w) for v in values})
        cums = [f"_c_{v}" for v in values]
        lines = df.groupBy("image_id", across).agg(F.array_sort(F.collect_list(F.struct(along, *cums, *kept))).alias("_l"), F.first("_k").alias("_k"))
        n = F.size("_l")
        k = F.least(F.col("_k"), n - 1)

        def upto(i: Column, c: str) -> Column:
            return F.coalesce(F.get("_l", i)[c], F.lit(0.0))

        def at(i: Column) -> Column:
            means = []
            for v, c in zip(values, cums, strict=True):
                middle = upto(F.least(i + k, n - 1), c) - upto(i - k - 1, c)
                left = upto(F.greatest(k - i, F.lit(0)), c) - upto(F.lit(0), c)
                right = upto(n - 2, c) - upto(n - 2 - F.greatest(i + k - n + 1, F.lit(0)), c)
                means.append(((middle + left + right) / (2 * k + 1)).alias(v))
            own = F.get("_l", i)
            return F.struct(own[along].alias(along), *means, *[own[c].alias(c) for c in kept])

        made = lines.select("image_id", across, "_k", F.explode(F.transform(F.sequence(F.lit(0), n - 1), at)).alias("_p"))
        df = made.select("image_id", across, "_k", *[f"_p.{c}" for c in (along, *values, *kept)])
    return df.select(*KEYS, *values, *kept)
