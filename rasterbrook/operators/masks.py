"""Filters and masks: percentile bands, border candidates, regions of interest, classification rules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import color as C
from .neighbourhood import edge_distance, gaussian, line_filter, local_variance, regions, sizes
from .reductions import border_strips, pct
from .scratch import settled
from .selection import ranked_percentiles
from .stats import RGB, join_back, percentiles


#: Regions and cells of theirs that are broadcast at most; more are shuffled.
REGIONS = 100_000


def band_gains(df: DataFrame, low: float = 10, high: float = 90, lo: float = 0.5, hi: float = 1.8, settle: bool = False, places: int | None = 9) -> DataFrame:
    """Grey-world gains from the pixels of middling brightness; all pixels where none are.

    Brightness and its limits are rounded to some places; None: neither is, and the last bit decides which pixels count.
    """
    df = df.withColumn("_g", C.gray(*[F.col(c) for c in RGB]))
    if places is None:
        limits = ranked_percentiles(df, F.col("_g"), {"_lo": low, "_hi": high})
    else:
        df = df.withColumn("_g", F.round("_g", places))
        limits = df.groupBy("image_id").agg(*[F.round(p, places).alias(n) for n, p in zip(("_lo", "_hi"), percentiles(F.col("_g"), low, high), strict=True)])
    df = join_back(df, limits, settle=settle)
    inside = F.col("_g").between(F.col("_lo"), F.col("_hi"))
    got = df.groupBy("image_id").agg(*[F.coalesce(F.avg(F.when(inside, F.col(c))), F.avg(c)).alias(f"m{c}") for c in RGB])
    grey = (F.col("mr") + F.col("mg") + F.col("mb")) / 3.0
    return got.select("image_id", *[C.clamp(grey / F.greatest(f"m{c}", F.lit(1e-6)), lo, hi).alias(f"gain_{c}") for c in RGB])


def stable_base(df: DataFrame, fewest: int = 64) -> DataFrame:
    """Three percentile filters in turn; each counts only if it leaves enough pixels, and the next looks at what is left."""
    df = df.withColumns({"luma": C.luma(*[F.col(c) for c in RGB]), "spread": C.chroma_spread(*[F.col(c) for c in RGB])})
    steps = [
        (("luma", 75),), (("spread", 50),), (("luma", 60), ("luma", 95)),
    ]
    tests = [
        lambda a: F.col("luma") >= a[0], lambda a: F.col("spread") <= a[0], lambda a: F.col("luma").between(a[0], a[1]),
    ]
    for points, test in zip(steps, tests, strict=True):
        limits = df.groupBy("image_id").agg(*[pct(F.col(c), p).alias(f"_a{i}") for i, (c, p) in enumerate(points)])
        df = join_back(df, limits, settle=True).withColumn("_ok", test([F.col(f"_a{i}") for i in range(len(points))]))
        df = join_back(df, df.groupBy("image_id").agg(F.count_if("_ok").alias("_n")), settle=True)
        df = df.where(F.col("_ok") | (F.col("_n") < fewest)).drop("_ok", "_n", *[f"_a{i}" for i in range(len(points))])
    return df


def side_counts(df: DataFrame, mask: Column, part: float = 0.2) -> DataFrame:
    return border_strips(df, part).where(mask).groupBy("image_id", "side").agg(F.count("*").alias("n"))


def projection_border(df: DataFrame, bright: float = 0.85, ring: float = 0.1) -> DataFrame:
    """Pixels of the outer ring that lie in a row or a column of nearly the largest mean."""
    df = edge_distance(df)
    rows = df.groupBy("image_id", "y").agg(F.avg("v").alias("row_mean"))
    cols = df.groupBy("image_id", "x").agg(F.avg("v").alias("col_mean"))
    tops = rows.groupBy("image_id").agg(F.max("row_mean").alias("row_top")).join(cols.groupBy("image_id").agg(F.max("col_mean").alias("col_top")), "image_id")
    df = df.join(rows, ["image_id", "y"]).join(cols, ["image_id", "x"]).join(tops, "image_id")
    hit = (F.col("row_mean") >= bright * F.col("row_top")) | (F.col("col_mean") >= bright * F.col("col_top"))
    return df.withColumn("candidate", hit & (F.col("distance") < F.greatest(F.lit(1), F.floor(ring * F.least("h", "w")))))


def calm_border(df: DataFrame, size: int = 15, part: float = 0.02) -> DataFrame:
    """Pixels whose local variance is a small part of the largest one."""
    df = local_variance(df, "v", size)
    df = join_back(df, df.groupBy("image_id").agg(F.max("variance").alias("_top")))
    return df.withColumn("candidate", F.round("variance", 9) <= F.round(F.greatest(part * F.col("_top"), F.lit(1e-8)), 9)).drop("_top")


def _around(value: Column, first: Column | None) -> tuple[Column, Column, Column, Column]:
    """Left, right, upper and lower neighbour; first: what stands for those beyond the edge (none: the value itself)."""
    rows, cols = W.partitionBy("image_id", "y").orderBy("x"), W.partitionBy("image_id", "x").orderBy("y")
    edge = value if first is None else first
    return tuple(F.coalesce(f(value).over(w), edge) for w in (rows, cols) for f in (F.lag, F.lead))


def edges(df: DataFrame, value: str = "v", low: float = 30, high: float = 100) -> DataFrame:
    """(image_id, y, x, edge) of a plane 0..1: smoothed 8-bit gradients, thinned across their direction, joined by hysteresis."""
    smooth = gaussian(1.5)
    middle = smooth[len(smooth) // 2 - 2 : len(smooth) // 2 + 3]
    weights = [w / sum(middle) for w in middle]
    grey = df.select("image_id", "y", "x", F.floor(F.round(C.clamp(F.col(value)) * 255.0, 6)).cast("double").alias("g"))
    for axis in ("x", "y"):
        grey = line_filter(grey, "g", weights, axis)
    grey = grey.withColumn("g", F.floor(F.round(F.col("g") + 0.5, 6)))
    left, right, _, _ = _around(F.col("g"), None)
    grey = grey.withColumns({"_s": left + 2 * F.col("g") + right, "_d": right - left})
    up, down = _around(F.col("_s"), None)[2:]
    d_up, d_down = _around(F.col("_d"), None)[2:]
    grey = grey.withColumns({"gx": d_up + 2 * F.col("_d") + d_down, "gy": down - up})
    grey = grey.withColumn("m", F.abs("gx") + F.abs("gy"))
    none = F.lit(0).cast("long")
    left, right, up, down = _around(F.col("m"), none)
    grey = grey.withColumns({"_l": left, "_r": right, "_u": up, "_o": down})
    corners = [_around(F.col(c), none)[k] for c in ("_l", "_r") for k in (2, 3)]  # of the left and right neighbours, those above and below
    flat, steep = F.abs("gy") < math.tan(math.pi / 8) * F.abs("gx"), F.abs("gy") > math.tan(3 * math.pi / 8) * F.abs("gx")
    falling = F.col("gx") * F.col("gy") >= 0
    m = F.col("m")
    top = (
        F.when(flat, (m > F.col("_l")) & (m >= F.col("_r")))
        .when(steep, (m > F.col("_u")) & (m >= F.col("_o")))
        .when(falling, (m > corners[0]) & (m > corners[3]))
        .otherwise((m > corners[2]) & (m > corners[1]))
    )
    grey = settled(grey.select("image_id", "y", "x", (top & (m > low)).alias("weak"), (top & (m > high)).alias("strong")))
    found = regions(grey, "weak")
    whole = found.join(grey.where("strong"), ["image_id", "y", "x"]).select("image_id", "region").distinct()
    lines = found.join(whole, ["image_id", "region"]).select("image_id", "y", "x", F.lit(True).alias("edge"))
    return grey.select("image_id", "y", "x").join(lines, ["image_id", "y", "x"], "left").withColumn("edge", F.coalesce("edge", F.lit(False)))


def edge_border(df: DataFrame, value: str = "v", reach: int = 4, least_content: float = 0.1) -> DataFrame:
    """Border candidate: everything outside the box of the largest region of thickened edges; a thin ring where there are no edges.

    The confidence is that of a centred, large box.
    """
    lines = edges(df, value)
    near = lambda by, order: W.partitionBy("image_id", by).orderBy(order).rowsBetween(-reach, reach)
    lines = lines.withColumn("edge", F.max("edge").over(near("y", "x")))
    lines = settled(lines.withColumn("edge", F.max("edge").over(near("x", "y"))))
    box = regions(lines, "edge").groupBy("image_id", "region").agg(F.count("*").alias("n"), *[f(c).alias(f"{c}{i}") for c in ("y", "x") for i, f in enumerate((F.min, F.max))])
    w = W.partitionBy("image_id").orderBy(F.desc("n"), "region")
    box = box.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(F.col("image_id").alias("_k"), "y0", "y1", "x0", "x1")
    df = join_back(df, sizes(df), settle=True).join(settled(box), F.col("image_id") == F.col("_k"), "left").drop("_k")
    share = (F.col("y1") - F.col("y0") + 1) * (F.col("x1") - F.col("x0") + 1) / (F.col("h") * F.col("w"))
    skew = F.abs((F.col("x0") - (F.col("w") - 1 - F.col("x1"))) / F.col("w")) + F.abs((F.col("y0") - (F.col("h") - 1 - F.col("y1"))) / F.col("h"))
    sure = F.when(F.col("y0").isNull(), 0.1).when(share < least_content, 0.15).otherwise(C.clamp((1.0 - skew) * share * 2.0, 0.1, 0.9))
    inside = F.col("y").between(F.col("y0"), F.col("y1")) & F.col("x").between(F.col("x0"), F.col("x1"))
    dy, dx = (F.greatest(F.lit(1), F.floor(F.col(n) / 20)) for n in ("h", "w"))
    ring = (F.col("y") < dy) | (F.col("y") >= F.col("h") - dy) | (F.col("x") < dx) | (F.col("x") >= F.col("w") - dx)
    return df.withColumn("candidate", F.when(F.col("y0").isNull(), ring).otherwise(~inside)).withColumn("confidence", sure)


def roi_base(df: DataFrame, rois: DataFrame, name: str, fewest: int = 256) -> DataFrame:
    """Median colour in the first region of that name (any case), without its darkest and brightest tenth if enough remains."""
    roi = rois.where(F.lower("name") == name.lower()).orderBy("ordinal").limit(1)
    df = join_back(df, sizes(df), settle=True)
    # One rectangle: broadcasting it is safe.
    df = df.join(F.broadcast(roi), (F.col("y") >= F.greatest("y0", F.lit(0))) & (F.col("y") < F.least("y1", "h")) & (F.col("x") >= F.greatest("x0", F.lit(0))) & (F.col("x") < F.least("x1", "w")))
    df = df.withColumn("_l", C.luma(*[F.col(c) for c in RGB]))
    df = join_back(df, df.groupBy("image_id").agg(pct(F.col("_l"), 10).alias("_lo"), pct(F.col("_l"), 90).alias("_hi")), settle=True)
    inner = F.col("_l").between(F.col("_lo"), F.col("_hi"))
    df = join_back(df, df.groupBy("image_id").agg(F.count_if(inner).alias("_n")), settle=True)
    return df.where(inner | (F.col("_n") < fewest)).groupBy("image_id").agg(*[F.median(c).alias(c) for c in RGB], F.count("*").alias("n"))


def roi_metrics(df: DataFrame, rois: DataFrame, fewest: int = 16, cell: int = 256) -> DataFrame:
    """Mean and variation of each image in each region.

    A range join of pixels and rectangles by the cells of a grid: any number of regions is an equi-join.
    """
    most = df.agg(F.max("y"), F.max("x")).first()
    if most[0] is None:
        most = (0, 0)
    cells = lambda lo, hi, top: F.sequence(F.floor(F.greatest(lo, F.lit(0)) / cell), F.floor((F.least(hi, F.lit(top + 1)) - 1) / cell))
    some = (F.greatest("y0", F.lit(0)) < F.least("y1", F.lit(most[0] + 1))) & (F.greatest("x0", F.lit(0)) < F.least("x1", F.lit(most[1] + 1)))
    binned = rois.where(some).withColumn("_cy", F.explode(cells(F.col("y0"), F.col("y1"), most[0]))).withColumn("_cx", F.explode(cells(F.col("x0"), F.col("x1"), most[1])))
    inside = (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1"))
    same = (F.floor(F.col("y") / cell) == F.col("_cy")) & (F.floor(F.col("x") / cell) == F.col("_cx"))
    slug = F.lower(F.regexp_replace("name", "[^a-zA-Z0-9_]+", "_"))
    # Images share their cells: with few regions pixels stay where they are, instead of all of a cell going to one task.
    if binned.limit(REGIONS + 1).count() <= REGIONS:
        binned = F.broadcast(binned)
    got = df.join(binned, same & inside).groupBy("image_id", slug.alias("roi")).agg(F.avg("v").alias("mean"), (F.stddev_pop("v") / F.greatest(F.avg("v"), F.lit(1e-9))).alias("cv"), F.count("*").alias("n"))
    return got.where(F.col("n") >= fewest)


def messages(*rules: tuple[Column, str]) -> Column:
    """The texts of the rules that hold, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(m)) for c, m in rules]), lambda m: m.isNotNull())


def film_type(df: DataFrame, part: float = 0.1) -> DataFrame:
    """Rules on an 8-bit image: shape, an orange cast, a dark border; else positive."""
    size = sizes(df)
    strips = border_strips(df, part).groupBy("image_id").agg(F.avg(C.gray(*[F.col(c) for c in RGB])).alias("border"))
    d = edge_distance(df)
    inner = d.where(F.col("distance") >= F.greatest(F.lit(1), F.floor(part * F.least("h", "w")))).groupBy("image_id").agg(F.avg(C.gray(*[F.col(c) for c in RGB])).alias("inner"))
    mean = df.groupBy("image_id").agg(*[F.avg(c).alias(f"m{c}") for c in RGB])
    all_ = mean.join(size, "image_id").join(strips, "image_id").join(inner, "image_id")
    wide = F.greatest("h", "w") / F.least("h", "w") >= 1.25
    orange = (F.col("mr") > F.col("mg") + 12) & (F.col("mg") > F.col("mb") + 10)
    dark = (F.col("border") < 55) & (F.col("border") + 18 < F.col("inner"))
    kind = F.when(orange & wide, "negative_35mm").when(orange, "negative_120").when(dark & wide, "positive_35mm").when(dark, "positive_120").otherwise("positive_35mm")
    return all_.select("image_id", kind.alias("film_type"), "border", "inner")
