"""Aggregates per image: statistics, base and reference estimates, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import color as C
from .neighbourhood import laplacian, local_variance, sizes
from .scratch import settled
from .stats import RGB, join_back, percentiles


def pct(c: Column, p: float) -> Column:
    return F.percentile(c, F.lit(p / 100))


def share(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def cv(c: Column, eps: float = 1e-9) -> Column:
    return F.stddev_pop(c) / F.greatest(F.avg(c), F.lit(eps))


def image_metrics(df: DataFrame) -> DataFrame:
    """Nine metrics of an 8-bit image (image_id, y, x, r, g, b)."""
    r, g, b = (F.col(c) for c in RGB)
    df = laplacian(df.withColumn("gray", F.floor(C.gray(r, g, b)).cast("double")), "gray")
    means = [F.avg(c) for c in RGB]
    return df.groupBy("image_id").agg(
        F.avg("gray").alias("gray_mean"), F.stddev_pop("gray").alias("gray_std"),
        share(F.col("gray") <= 2).alias("clipped_black"), share(F.col("gray") >= 253).alias("clipped_white"),
        ((F.avg("b") - F.avg("r")) / 255.0).alias("blue_red"), ((2.0 * F.avg("g") - F.avg("b") - F.avg("r")) / 255.0).alias("green_magenta"),
        ((F.greatest(*means) - F.least(*means)) / 255.0).alias("spread"), F.avg(C.saturation(r, g, b)).alias("saturation"),
        F.var_pop("laplacian").alias("sharpness"),
    )


def border_strips(df: DataFrame, part: float | Column, settle: bool = False) -> DataFrame:
    """UNION ALL of the four strips along the edges: a corner pixel comes once for each of its sides.

    part: a strip's share of the side, or its pixels as a column of h and w.
    """
    df = join_back(df, sizes(df), settle=settle)
    dy, dx = (part, part) if isinstance(part, Column) else (F.greatest(F.lit(1), F.floor(F.col(n) * part)) for n in ("h", "w"))
    sides = F.array(
        F.when(F.col("y") < dy, "top"), F.when(F.col("y") >= F.col("h") - dy, "bottom"),
        F.when(F.col("x") < dx, "left"), F.when(F.col("x") >= F.col("w") - dx, "right"),
    )
    return df.withColumn("side", F.explode(F.filter(sides, lambda s: s.isNotNull()))).drop("h", "w")


def film_base(df: DataFrame, enough: int = 1024, least: int = 8) -> DataFrame:
    """Film base of an 8-bit negative: 95th percentile, 32..255, of the brightest pixels and the brightest fifth of the border.

    Brightness is the mean of the channels; the border is a twentieth of the shorter side wide, `least` at least.
    """
    df = df.withColumn("gray", F.round((F.col("r") + F.col("g") + F.col("b")) / 3.0, 9))
    tops = percentiles(F.col("gray"), 99.5, 99)
    whole = join_back(df, df.groupBy("image_id").agg(tops[0].alias("_p995"), tops[1].alias("_p99")), settle=True)
    n = whole.groupBy("image_id").agg(F.count_if(F.col("gray") >= F.round("_p995", 9)).alias("_n"))
    whole = join_back(whole, n, settle=True)
    bright = whole.where(F.col("gray") >= F.round(F.when(F.col("_n") >= enough, F.col("_p995")).otherwise(F.col("_p99")), 9))
    wide = F.greatest(F.lit(least), F.floor(F.least("h", "w") / 20))
    ring = border_strips(df, wide, settle=True)
    ring = join_back(ring, ring.groupBy("image_id").agg(pct(F.col("gray"), 80).alias("_p80")), settle=True).where(F.col("gray") >= F.round("_p80", 9))
    both = bright.select("image_id", *RGB).unionByName(ring.select("image_id", *RGB))
    return both.groupBy("image_id").agg(*[C.clamp(pct(F.col(c), 95), 32, 255).alias(c) for c in RGB])


def side_fusion(df: DataFrame, part: float = 0.2) -> DataFrame:
    """Base colour from the medians of the four border sides, sides far from the others left out."""
    sides = border_strips(df, part).groupBy("image_id", "side").agg(*[F.median(c).alias(c) for c in RGB])
    image = W.partitionBy("image_id")  # of four rows at most
    sides = sides.withColumns({f"m_{c}": F.median(c).over(image) for c in RGB})
    norm = lambda cs: F.sqrt(sum(c * c for c in cs))
    sides = sides.withColumn("error", norm([F.col(c) - F.col(f"m_{c}") for c in RGB]) / F.greatest(norm([F.col(f"m_{c}") for c in RGB]), F.lit(1e-6)))
    kept = sides.withColumn("_p60", pct(F.col("error"), 60).over(image)).where(F.col("error") <= F.greatest("_p60", F.lit(0.08)))
    consistency = F.when(F.count("*") == 1, 0.35).otherwise(C.clamp(1.0 - 4.0 * F.avg("error")))
    return kept.groupBy("image_id").agg(*[F.median(c).alias(c) for c in RGB], F.count("*").alias("sides"), consistency.alias("consistency"))


def leader_range(df: DataFrame) -> DataFrame:
    """Dmin and Dmax of a density image from its clearest and densest pixels; implausible: confidence 0."""
    df = df.withColumn("luma", C.luma(*[F.col(c) for c in RGB]))
    limits = percentiles(F.col("luma"), 1, 99)
    df = join_back(df, df.groupBy("image_id").agg(limits[0].alias("_lo"), limits[1].alias("_hi")))
    clear, dense = F.col("luma") <= F.col("_lo"), F.col("luma") >= F.col("_hi")
    got = df.groupBy("image_id").agg(
        *[pct(F.when(clear, F.col(c)), 10).alias(f"dmin_{c}") for c in RGB], *[pct(F.when(dense, F.col(c)), 90).alias(f"dmax_{c}") for c in RGB]
    )
    return got.withColumn("confidence", F.when(F.greatest(*[f"dmax_{c}" for c in RGB]) > 4, 0.0).otherwise(1.0))


def relaxed(df: DataFrame, conditions: list[Column], least: list[int]) -> DataFrame:
    """Rows of each image that meet all conditions; where those are too few, ever fewer conditions count.

    conditions[: k] hold for step k; least[0] is the fewest rows for all of them, least[1] for one less, and so on.
    """
    names = [f"_c{i}" for i in range(len(conditions))]
    df = df.withColumns({n: c for n, c in zip(names, _running(conditions), strict=True)})
    counts = df.groupBy("image_id").agg(*[F.count_if(F.col(n)).alias(f"{n}_n") for n in names])
    df = join_back(df, counts, settle=True)
    choice = F.lit(True)
    for n, k in zip(names, least[::-1], strict=True):  # the weakest first, so that the strictest wins
        choice = F.when(F.col(f"{n}_n") >= k, F.col(n)).otherwise(choice)
    return df.where(choice).drop(*names, *[f"{n}_n" for n in names])


def _running(conditions: list[Column]) -> list[Column]:
    out = []
    for c in conditions:
        out.append(out[-1] & c if out else c)
    return out


def base_ratio(df: DataFrame, enough: int = 200, some: int = 50) -> DataFrame:
    """90th percentile of base over flat on calm, normally exposed pixels. df: (image_id, y, x, base, flat)."""
    df = settled(local_variance(df, "base", 3, "_var"))
    low, high = percentiles(F.col("base"), 5, 92)
    df = join_back(df, df.groupBy("image_id").agg(pct(F.col("_var"), 40).alias("_v40"), low.alias("_l5"), high.alias("_l92")), settle=True)
    exposed, calm = F.col("base").between(F.col("_l5"), F.col("_l92")), F.round("_var", 9) <= F.round("_v40", 9)
    kept = relaxed(df, [exposed, calm], [enough, some])
    ratio = F.col("base") / F.greatest("flat", F.lit(1e-6))
    p10, p50, p90 = percentiles(ratio, 10, 50, 90)
    spread = (p90 - p10) / F.greatest(p50, F.lit(1e-6))
    return kept.groupBy("image_id").agg(p90.alias("ratio"), F.count("*").alias("n"), C.clamp(1.0 - 2.0 * spread).alias("confidence"))


def mid_neutral_gains(df: DataFrame, enough: int = 1024, some: int = 256) -> DataFrame:
    r, g, b = (F.col(c) for c in RGB)
    df = df.withColumns({"_l": C.luma(r, g, b), "_s": C.chroma_spread(r, g, b)})
    low, high = percentiles(F.col("_l"), 20, 80)
    df = join_back(df, df.groupBy("image_id").agg(low.alias("_l20"), high.alias("_l80"), pct(F.col("_s"), 70).alias("_s70")), settle=True)
    kept = relaxed(df, [F.col("_l").between(F.col("_l20"), F.col("_l80")), F.col("_s") <= F.col("_s70")], [enough, some])
    mid = kept.groupBy("image_id").agg(*[F.median(c).alias(f"m{c}") for c in RGB])
    grey = (F.col("mr") + F.col("mg") + F.col("mb")) / 3.0
    return mid.select("image_id", *[C.clamp(grey / F.greatest(f"m{c}", F.lit(1e-6)), 0.78, 1.28).alias(f"gain_{c}") for c in RGB])


def middle_gray(df: DataFrame, target: float = 0.18, enough: int = 1024) -> DataFrame:
    df = df.withColumn("_l", C.luma(*[F.col(c) for c in RGB]))
    low, high = percentiles(F.col("_l"), 20, 80)
    df = join_back(df, df.groupBy("image_id").agg(low.alias("_l20"), high.alias("_l80")), settle=True)
    kept = relaxed(df, [F.col("_l").between(F.col("_l20"), F.col("_l80"))], [enough])
    gain = C.clamp(F.lit(target) / F.greatest(F.median("_l"), F.lit(1e-6)), 0.25, 4)
    return kept.groupBy("image_id").agg(gain.alias("gain")).withColumn("ev", F.log2("gain"))


def cfa_stats(df: DataFrame) -> DataFrame:
    """Statistics of each phase of a 2 x 2 mosaic."""
    v = F.col("v")
    return df.groupBy("image_id", (F.col("y") % 2).alias("py"), (F.col("x") % 2).alias("px")).agg(
        F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("std"),
        share(v >= 0.995).alias("saturated"), share(v <= 0.001).alias("dark"),
    )


def uniformity(df: DataFrame) -> DataFrame:
    df = join_back(df, sizes(df))
    inside = lambda i, n: (F.col(i) >= 0.3 * F.col(n)) & (F.col(i) < 0.7 * F.col(n))
    centre, v = inside("y", "h") & inside("x", "w"), F.col("v")
    p5, p50, p95 = percentiles(v, 5, 50, 95)
    mid = F.greatest(p50, F.lit(1e-6))
    return df.groupBy("image_id").agg(
        cv(v).alias("cv"), ((p95 - p5) / mid).alias("span"), (F.max(v) / mid - 1.0).alias("hotspot"),
        (F.avg(F.when(centre, v)) / F.greatest(F.avg(F.when(~centre, v)), F.lit(1e-6))).alias("centre_edge"),
        share(v >= 0.995).alias("clipped_high"), share(v <= 0.001).alias("clipped_low"),
    )


def stage_diagnostics(df: DataFrame) -> DataFrame:
    chroma = C.chroma_spread(*[F.col(c) for c in RGB])
    each = [f(F.col(c)).alias(f"{c}_{n}") for c in RGB for n, f in (("mean", F.avg), ("p95", lambda x: pct(x, 95)), ("min", F.min), ("max", F.max))]
    return df.groupBy("image_id").agg(*each, F.avg(chroma).alias("chroma_mean"), pct(chroma, 95).alias("chroma_p95"))


def grid_estimates(df: DataFrame, cells: int = 3, fewest: int = 4) -> DataFrame:
    """Median, deviation and count of the whole image (cell nulls) and of each cell, in one pass over GROUPING SETS."""
    df = join_back(df, sizes(df))
    df = df.withColumns({"gy": F.floor(F.col("y") * cells / F.col("h")), "gx": F.floor(F.col("x") * cells / F.col("w"))})
    got = df.groupingSets([["image_id"], ["image_id", "gy", "gx"]], "image_id", "gy", "gx").agg(
        F.median("v").alias("median"), F.stddev_pop("v").alias("std"), F.count("*").alias("n")
    )
    return got.where(F.col("n") >= fewest)


def weighted_score(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    terms = [weights[k] * c for k, c in parts.items()]
    # Half up with a little slack, so that sums in another order round alike.
    return F.floor(C.clamp(sum(terms[1:], terms[0])) * 10_000 + (0.5 + 1e-6)) / 10_000.0


def content_box(df: DataFrame, content: Column) -> DataFrame:
    """First and last row and column with content, nulls where there is none."""
    return df.groupBy("image_id").agg(*[f(F.when(content, F.col(c))).alias(n) for n, f, c in (("y0", F.min, "y"), ("y1", F.max, "y"), ("x0", F.min, "x"), ("x1", F.max, "x"))])


def top_depth(df: DataFrame, mask: Column, part: float = 0.5, coverage: float = 0.6) -> DataFrame:
    """Rows from the top of which every prefix is covered by the mask to the given share."""
    df = join_back(df, sizes(df))
    rows = df.groupBy("image_id", "y").agg(F.count_if(mask).alias("n"), F.first("h").alias("h"), F.first("w").alias("w"))
    rows = rows.where(F.col("y") < F.greatest(F.lit(1), F.floor(F.col("h") * part)))
    w = W.partitionBy("image_id").orderBy("y")
    rows = rows.withColumn("ok", F.sum("n").over(w) >= coverage * (F.col("y") + 1) * F.col("w"))
    return rows.groupBy("image_id").agg(F.coalesce(F.min(F.when(~F.col("ok"), F.col("y"))), F.max("y") + 1).alias("depth"))
