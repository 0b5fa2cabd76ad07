"""Whole developments of 8-bit images (image_id, y, x, r, g, b): negatives and positives, all stages in order.

Row-local stages fuse into one projection. Each statistic of an image is one settled aggregate, and
pixels are settled where a neighbourhood stage has shuffled them, so a chain reads its input once a stage.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color as C
from ..functions import tone as T
from ..functions.text import PARAMS
from . import neighbourhood as N
from .masks import band_gains
from .reductions import film_base
from .scratch import settled
from .stats import RGB, cast_mask, join_back, percentiles


def settings(given: Mapping[str, float] | None = None) -> dict[str, float]:
    """The given parameters over the defaults; a name that isn't a parameter is an error."""
    given = dict(given or {})
    if unknown := set(given) - set(PARAMS):
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    return {n: given.get(n, default) for n, (default, _, _) in PARAMS.items()}


def tiles(grid: float) -> int:
    """The tile grid for a parameter: 4, 8 or 16."""
    return 4 if grid <= 5 else 8 if grid <= 10 else 16


def level(c: Column) -> Column:
    """An 8-bit level, cut off; six places are rounded first, so that sums in another order give the same."""
    return F.floor(F.round(C.clamp(c, 0, 255), 6)).cast("double")


def nearest_level(c: Column) -> Column:
    return level(c + 0.5)


def _each(df: DataFrame, step) -> DataFrame:
    return df.withColumns({c: step(F.col(c)) for c in RGB})


def _three(df: DataFrame, channels) -> DataFrame:
    return df.withColumns({n: level(c) for n, c in zip(RGB, channels, strict=True)})


def _cols() -> list[Column]:
    return [F.col(c) for c in RGB]


def demask(df: DataFrame, least: int = 8) -> DataFrame:
    """Orange mask away, inverted in density space: white is each channel's 99th density percentile."""
    base = film_base(df, least=least).select("image_id", *[F.col(c).alias(f"{c}_base") for c in RGB])
    df = join_back(df, base, settle=True)
    dense = {c: T.density(C.clamp((F.col(c) + 1.0) / (F.col(f"{c}_base") + 1.0), 1e-4, 1.0)) for c in RGB}
    df = df.withColumns(dense)
    top = [F.greatest(percentiles(F.col(c), 99)[0], F.lit(1e-4)).alias(f"{c}_top") for c in RGB]
    df = join_back(df, df.groupBy("image_id").agg(*top), settle=True)
    return df.withColumns({c: level(255.0 * F.col(c) / F.col(f"{c}_top")) for c in RGB}).select("image_id", "y", "x", *RGB)


def stretch(df: DataFrame, low: float, high: float) -> DataFrame:
    """Per channel, the low and high percentiles become 0 and 255; a channel without spread keeps its values."""
    limits = {c: [F.round(x, 9) for x in percentiles(F.col(c), low, high)] for c in RGB}
    aggs = [x.alias(f"{c}_{n}") for c in RGB for n, x in zip(("lo", "hi"), limits[c], strict=True)]
    df = join_back(df, df.groupBy("image_id").agg(*aggs), settle=True)

    def one(c: str) -> Column:
        lo, hi = F.col(f"{c}_lo"), F.col(f"{c}_hi")
        return F.when(hi - lo < 1, F.col(c)).otherwise(level((F.col(c) - lo) * 255.0 / F.greatest(hi - lo, F.lit(1.0))))

    return df.withColumns({c: one(c) for c in RGB}).select("image_id", "y", "x", *RGB)


def apply_gains(df: DataFrame, gains: DataFrame) -> DataFrame:
    df = join_back(df, gains, settle=True)
    return df.withColumns({c: level(F.col(c) * F.col(f"gain_{c}")) for c in RGB}).drop(*[f"gain_{c}" for c in RGB])


def lab8() -> list[Column]:
    """Lab in 8-bit steps, rounded."""
    lightness, a, b = C.lab(*[C.srgb_decode(c / 255.0) for c in _cols()])
    return [nearest_level(lightness * 255.0), nearest_level(a * 100.0 + 128.0), nearest_level(b * 100.0 + 128.0)]


def from_lab8(lightness: Column, a: Column, b: Column) -> list[Column]:
    linear = C.from_lab(lightness / 255.0, (a - 128.0) / 100.0, (b - 128.0) / 100.0)
    return [nearest_level(C.srgb_encode(c) * 255.0) for c in linear]


LAB = ("lab_l", "lab_a", "lab_b")


def _in_lab(df: DataFrame) -> DataFrame:
    return df.withColumns(dict(zip(LAB, lab8(), strict=True)))


def _out_of_lab(df: DataFrame) -> DataFrame:
    return df.withColumns(dict(zip(RGB, from_lab8(*[F.col(c) for c in LAB]), strict=True))).drop(*LAB)


def neutralise_lab(df: DataFrame, strength: float) -> DataFrame:
    """The mean a and b of the pixels of middling lightness move towards grey."""
    df = _in_lab(df)
    low, high = percentiles(F.col("lab_l"), 10, 90)
    df = join_back(df, df.groupBy("image_id").agg(F.round(low, 9).alias("_lo"), F.round(high, 9).alias("_hi")), settle=True)
    mid = F.col("lab_l").between(F.col("_lo"), F.col("_hi"))
    shift = [(F.coalesce(F.avg(F.when(mid, F.col(c))), F.lit(128.0)) - 128.0).alias(f"_{c}") for c in LAB[1:]]
    df = join_back(df, df.groupBy("image_id").agg(*shift), settle=True)
    df = df.withColumns({c: level(F.col(c) - float(strength) * F.col(f"_{c}")) for c in LAB[1:]})
    return _out_of_lab(df).select("image_id", "y", "x", *RGB)


def equalise_lightness(df: DataFrame, clip: float, grid: int) -> DataFrame:
    """CLAHE of the lightness alone."""
    df = N.clahe(_in_lab(settled(df)), "lab_l", grid, max(float(clip), 0.01), settle=True).withColumn("lab_l", level(F.col("lab_l")))
    return settled(_out_of_lab(df).select("image_id", "y", "x", *RGB))


def suppress_casts(df: DataFrame, sigma: float, strength: float) -> DataFrame:
    """Desaturates where bright, saturated pixels cluster: the blurred mask over its upper percentile."""
    df = settled(N.blur(df.withColumn("mask", cast_mask(*_cols())), "mask", max(float(sigma), 0.01), RGB))
    df = join_back(df, df.groupBy("image_id").agg(percentiles(F.col("mask"), 99.5)[0].alias("_top")), settle=True)
    mask = F.when(F.col("_top") > 1e-6, C.clamp(F.col("mask") / F.greatest("_top", F.lit(1e-6)))).otherwise(F.col("mask"))
    return _three(df, T.desaturate(*_cols(), mask, strength)).select("image_id", "y", "x", *RGB)


def sharpen(df: DataFrame, amount: float, sigma: float) -> DataFrame:
    return settled(_each(N.unsharp(df, RGB, amount, max(sigma, 0.1)), level))


def neutral_gains(df: DataFrame) -> DataFrame:
    """Grey-world gains of the unsaturated pixels of middling brightness; all pixels where none are."""
    df = df.withColumn("_g", F.round(C.gray(*_cols()), 9))
    low, high = percentiles(F.col("_g"), 15, 85)
    df = join_back(df, df.groupBy("image_id").agg(F.round(low, 9).alias("_lo"), F.round(high, 9).alias("_hi")), settle=True)
    mid = F.col("_g").between(F.col("_lo"), F.col("_hi")) & (F.round(C.saturation(*_cols()), 9) < 0.35)
    got = df.groupBy("image_id").agg(*[F.coalesce(F.avg(F.when(mid, F.col(c))), F.avg(c)).alias(f"m{c}") for c in RGB])
    grey = (F.col("mr") + F.col("mg") + F.col("mb")) / 3.0
    return got.select("image_id", *[C.clamp(grey / F.greatest(f"m{c}", F.lit(1e-6)), 0.75, 1.35).alias(f"gain_{c}") for c in RGB])


def _curves(df: DataFrame, p: Mapping[str, float], *names: str) -> DataFrame:
    """The row-local tone stages of these names, in this order; each cuts to 8-bit levels."""
    steps = {
        "gamma": lambda c: c if abs(p["gamma"] - 1) < 0.01 else level(F.pow(c / 255.0, F.lit(max(float(p["gamma"]), 0.01))) * 255.0),
        "highlight_compression": lambda c: c if p["highlight_compression"] <= 0.001 else level(c / 255.0 * (1.0 - float(p["highlight_compression"]) * c / 255.0) * 255.0),
        "shadow_lift": lambda c: c if p["shadow_lift"] == 0 else level(c + float(p["shadow_lift"])),
    }
    for n in names:
        df = _each(df, steps[n])
    return df


def vibrant(df: DataFrame, amount: float) -> DataFrame:
    return df if abs(amount) < 0.01 else _three(df, T.vibrance(*_cols(), amount))


def negative(df: DataFrame, params: Mapping[str, float] | None = None, border: int = 8) -> DataFrame:
    """An 8-bit negative to a positive, in 13 stages; border is the least width of the film's border in pixels."""
    p = settings(params)
    df = demask(df, border)
    df = stretch(df, p["wb_clip_percent"], 100 - p["wb_clip_percent"])
    df = apply_gains(df, band_gains(df, settle=True))
    df = neutralise_lab(df, p["lab_strength"])
    df = stretch(df, p["black_point"], p["white_point"])
    df = _curves(df, p, "gamma", "highlight_compression", "shadow_lift")
    df = equalise_lightness(df, p["clahe_clip"], tiles(p["clahe_grid"]))
    df = suppress_casts(df, p["desat_sigma"], p["desat_strength"])
    df = vibrant(df, p["vibrance"])
    df = sharpen(df, p["unsharp_amount"], p["unsharp_sigma"])
    return apply_gains(df, neutral_gains(df))


def positive(df: DataFrame, params: Mapping[str, float] | None = None) -> DataFrame:
    """An 8-bit positive, in 7 stages."""
    p = settings(params)
    df = stretch(df, p["wb_clip_percent"], 100 - p["wb_clip_percent"])
    df = _curves(df, p, "shadow_lift", "gamma", "highlight_compression")
    df = equalise_lightness(df, p["clahe_clip"], tiles(p["clahe_grid"]))
    return sharpen(vibrant(df, p["vibrance"]), p["unsharp_amount"], p["unsharp_sigma"])


def dispatched(df: DataFrame, types: DataFrame, params: Mapping[str, float] | None = None, border: int = 8) -> DataFrame:
    """Each image through the development of its type (image_id, film_type): negatives as negative(), all others as positive().

    Images without a type are taken for positives.
    """
    kinds = settled(types.select(F.col("image_id").alias("_k"), F.coalesce(F.col("film_type").startswith("negative"), F.lit(False)).alias("_negative")))
    df = df.join(kinds, F.col("image_id") == F.col("_k"), "left")
    of = lambda condition: settled(df.where(condition).select("image_id", "y", "x", *RGB))
    developed = [negative(of("_negative"), params, border), positive(of("_negative is null or not _negative"), params)]
    return developed[0].select("image_id", "y", "x", *RGB).unionByName(developed[1].select("image_id", "y", "x", *RGB))


def tile_demo(canvas: DataFrame, params: Mapping[str, float] | None = None) -> DataFrame:
    """A stitched 8-bit negative (image_id, y, x, r, g, b) to a positive: inverted, white-balanced by percentiles,
    stretched, its lightness equalised, casts suppressed, sharpened."""
    p = settings(params)
    df = settled(_each(canvas, lambda c: 255.0 - level(c)))
    df = stretch(df, p["wb_clip_percent"], 100 - p["wb_clip_percent"])
    df = stretch(df, p["black_point"], p["white_point"])
    df = equalise_lightness(df, p["clahe_clip"], tiles(p["clahe_grid"]))
    df = suppress_casts(df, p["desat_sigma"], p["desat_strength"])
    return sharpen(df, p["unsharp_amount"], p["unsharp_sigma"])
