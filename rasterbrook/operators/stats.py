"""Operators that need a statistic of the whole image: one grouped aggregate, joined back to the pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color as C
from ..functions import tone as T
from .scratch import settled
from .selection import interpolated

RGB = ("r", "g", "b")


def percentiles(c: Column, *points: float) -> list[Column]:
    """Exact percentiles with linear interpolation (points in 0..100), of one map of the values."""
    got = F.percentile(c, F.array(*[F.lit(p / 100) for p in points]))
    return [got[i] for i in range(len(points))]


def join_back(df: DataFrame, stats: DataFrame, key: str = "image_id", settle: bool = False) -> DataFrame:
    """Statistics joined to the rows of their image. There is a row per image, so Spark broadcasts it if small.

    settle: the statistics are written first. For chains, where df itself has others joined to it.
    """
    if settle:
        stats = settled(stats)
    return df.join(stats.withColumnRenamed(key, "_k"), F.col(key) == F.col("_k")).drop("_k")


def with_percentile(df: DataFrame, value: Column, point: float, name: str) -> DataFrame:
    return join_back(df, df.groupBy("image_id").agg(F.percentile(value, F.lit(point / 100)).alias(name)))


def percentile_stretch(df: DataFrame, low: float, high: float) -> DataFrame:
    """Per image and channel, the low and high percentiles of 8-bit values become 0 and 255.

    Values that are cut off may lie on a whole step, so percentiles are interpolated to the last bit as the SQL's are: the
    channel's values (256 at most) tell which two a percentile lies between.
    """
    aggs = [a for c in RGB for a in (F.percentile(c, F.array(F.lit(low / 100), F.lit(high / 100))).alias(f"_p_{c}"), F.collect_set(c).alias(f"_s_{c}"), F.count(c).alias(f"_n_{c}"))]
    ends = df.groupBy("image_id").agg(*aggs)
    parts = {}
    for c in RGB:
        for i, (n, p) in enumerate((("lo", low), ("hi", high))):
            at = F.lit(p / 100) * (F.col(f"_n_{c}") - 1)
            parts[f"_a_{c}_{n}"] = F.array_max(F.filter(f"_s_{c}", lambda v: v <= F.col(f"_p_{c}")[i]))
            parts[f"_b_{c}_{n}"] = F.array_min(F.filter(f"_s_{c}", lambda v: v >= F.col(f"_p_{c}")[i]))
            parts[f"_d_{c}_{n}"] = at - F.floor(at)
    ends = ends.withColumns(parts)
    names = [f"{c}_{n}" for c in RGB for n in ("lo", "hi")]
    df = join_back(df, ends.select("image_id", *[interpolated(*[F.col(f"_{k}_{n}") for k in "abd"]).alias(n) for n in names]))
    return df.withColumns({c: T.stretch(F.col(c), F.col(f"{c}_lo"), F.col(f"{c}_hi")) for c in RGB}).drop(*[f"{c}_{n}" for c in RGB for n in ("lo", "hi")])


def cast_mask(r: Column, g: Column, b: Column) -> Column:
    """How much a bright, saturated 8-bit pixel looks like a colour cast, 0..1."""
    s, v = C.saturation(r, g, b), F.greatest(r, g, b) / 255.0
    return C.clamp((s - 0.22) / 0.78) * C.clamp((v - 0.55) / 0.45)


def density_demask(df: DataFrame, base_percentile: float = 95, scale_percentile: float = 99) -> DataFrame:
    """8-bit negative to positive: density over the film base, scaled so that its upper percentile is white."""
    base = [F.greatest(F.percentile(F.col(c), F.lit(base_percentile / 100)), F.lit(32.0)).alias(f"{c}_base") for c in RGB]
    df = join_back(df, df.groupBy("image_id").agg(*base), settle=True)
    df = df.withColumns({c: T.density(C.clamp((F.col(c) + 1.0) / (F.col(f"{c}_base") + 1.0), 1e-4, 1.0)) for c in RGB})
    scale = [F.greatest(F.percentile(F.col(c), F.lit(scale_percentile / 100)), F.lit(1e-4)).alias(f"{c}_scale") for c in RGB]
    df = join_back(df, df.groupBy("image_id").agg(*scale), settle=True)
    return df.withColumns({c: T.u8(F.round(F.lit(255.0) * F.col(c) / F.col(f"{c}_scale"), 6)) for c in RGB})


def with_upper_density(df: DataFrame, point: float = 99, floor: float = 0.05) -> DataFrame:
    """Adds the upper reference of each channel's density."""
    upper = [F.greatest(F.percentile(F.col(c), F.lit(point / 100)), F.lit(floor)).alias(f"{c}_upper") for c in RGB]
    return join_back(df, df.groupBy("image_id").agg(*upper))


def expm1_inversion(df: DataFrame, gains=(1.35, 1.20, 1.10), point: float = 99.5) -> DataFrame:
    df = df.withColumns({c: T.expm1_positive(F.col(c), k) for c, k in zip(RGB, gains, strict=True)})
    top = [F.percentile(F.col(c), F.lit(min(max(point, 90), 100) / 100)).alias(f"{c}_top") for c in RGB]
    df = join_back(df, df.groupBy("image_id").agg(*top))
    return df.withColumns({c: C.clamp(F.col(c) / F.greatest(F.col(f"{c}_top"), F.lit(1e-6))) for c in RGB})


def neutral_means(df: DataFrame, point: float) -> DataFrame:
    """Per image, the mean colour of the pixels with the least spread between channels."""
    spread = C.chroma_spread(*[F.col(c) for c in RGB])
    near = with_percentile(df, spread, point, "_limit").where(spread <= F.col("_limit"))
    return near.groupBy("image_id").agg(*[F.avg(c).alias(f"{c}_mean") for c in RGB])


def gray_anchor(df: DataFrame, point: float, strength: float, eps: float = 1e-6) -> DataFrame:
    df = join_back(df, neutral_means(df, point))
    return df.withColumns({c: F.col(c) / (1.0 - strength + strength * F.col(f"{c}_mean") + eps) for c in RGB})


def display_mapping(df: DataFrame, point: float, eps: float = 1e-6) -> DataFrame:
    """All channels over one upper percentile, then the sRGB curve."""
    values = df.select("image_id", F.explode(F.array(*RGB)).alias("v"))
    df = join_back(df, values.groupBy("image_id").agg(F.percentile("v", F.lit(point / 100)).alias("_top")))
    return df.withColumns({c: C.srgb_encode(F.col(c) / (F.col("_top") + eps)) for c in RGB})


def gray_world(df: DataFrame, lo: float = 0.5, hi: float = 2.0) -> DataFrame:
    df = join_back(df, df.groupBy("image_id").agg(*[F.avg(c).alias(f"{c}_mean") for c in RGB]))
    grey = (F.col("r_mean") + F.col("g_mean") + F.col("b_mean")) / 3.0
    gain = {c: F.when(F.col(f"{c}_mean") < 1e-6, 1.0).otherwise(C.clamp(grey / F.greatest(F.col(f"{c}_mean"), F.lit(1e-6)), lo, hi)) for c in RGB}
    return df.withColumns({c: F.col(c) * gain[c] for c in RGB})


def master_output(mode: Column, linear: Column, display: Column) -> Column:
    return F.when(mode == "linear_float", linear).when(mode == "display_mapped_float", display).otherwise(
        F.raise_error(F.concat(F.lit("unknown master output mode: "), mode)).cast("double")
    )


def scrub(c: Column) -> Column:
    """Not a number, infinite or negative: 0."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(F.greatest(c, F.lit(0.0)))
