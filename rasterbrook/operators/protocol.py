"""The multi-frame protocol: base colour from a frame of clear film, then every frame inverted, neutralised and judged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color as C
from ..functions import tone as T
from .integral import box_means, grid_rectangles, rectangle_sums, summed_area
from .neighbourhood import laplacian, sizes, unsharp
from .reductions import pct, relaxed, share
from .scratch import settled
from .stats import RGB, join_back, percentiles

EPS = 1e-6
#: Percentile of calm pixels, percentiles of luma that bound the base, and those of the ratio's own base zone.
CALM, DARKEST, BRIGHTEST = 35.0, 5.0, 90.0
RATIO_CALM, RATIO_BRIGHTEST, RATIO_POINT = 40.0, 92.0, 90.0


def proxy(df: DataFrame, most: int = 512, values: tuple[str, ...] = RGB) -> DataFrame:
    """Images with a side longer than `most` pixels made smaller by area means; others as they are.

    A pixel lies in up to two rows and two columns of the smaller image, each with its share.
    """
    df = join_back(df, sizes(df), settle=True)
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest("h", "w"))
    df = df.withColumns({f"_n{a}": F.greatest(F.lit(1.0), F.rint(F.col(s) * scale)) for a, s in (("y", "h"), ("x", "w"))})
    for axis, size in (("y", "h"), ("x", "w")):
        lo, hi = F.col(axis) * F.col(f"_n{axis}") / F.col(size), (F.col(axis) + 1) * F.col(f"_n{axis}") / F.col(size)
        first, split = F.floor(lo), F.floor(lo) + 1
        parts = F.array(
            F.struct(first.cast("long").alias("i"), (F.least(hi, split.cast("double")) - lo).alias("k")),
            F.struct(split.cast("long").alias("i"), F.greatest(hi - split, F.lit(0.0)).alias("k")),
        )
        df = df.withColumn(f"_{axis}", F.explode(F.filter(parts, lambda p: p["k"] > 1e-9)))
    k = F.col("_y.k") * F.col("_x.k")
    df = df.groupBy("image_id", F.col("_y.i").alias("y"), F.col("_x.i").alias("x"))
    return df.agg(*[(F.sum(F.col(v) * k) / F.sum(k)).alias(v) for v in values])


def with_local_variance(df: DataFrame, value: str, name: str, part: float = 0.04, least: int = 5) -> DataFrame:
    """Local variance over a box of a part of the image's shorter side, odd and at least `least` pixels wide."""
    df = join_back(df, sizes(df), settle=True)
    wide = F.rint(F.least("h", "w") * part).cast("int")
    size = F.greatest(F.lit(least), wide + (1 - wide % 2))
    df = df.withColumns({"_m": F.col(value), "_q": F.col(value) * F.col(value), "_half": F.floor(size / 2)})
    df = box_means(df, ("_m", "_q"), F.col("_half"))
    return df.withColumn(name, F.greatest(F.round(F.col("_q") - F.col("_m") * F.col("_m"), 9), F.lit(0.0))).drop("_m", "_q", "_half", "h", "w")


def base_candidates(df: DataFrame, fewest: int = 64, cell_fewest: int = 32, cells: int = 3, most: int = 512) -> DataFrame:
    """Colour candidates of the film base: the calm, normally bright pixels of a frame, and of each cell of a grid.

    (image_id, region, r, g, b, std_r, std_g, std_b, n, luma_mean). Medians are one aggregate over grouping sets;
    deviations, counts and mean luma come from sums over rectangles. Cells with too few such pixels are left out.
    """
    df = proxy(df, most).withColumn("luma", F.round(C.luma(*[F.col(c) for c in RGB]), 9))
    df = settled(with_local_variance(df, "luma", "_var"))
    low, high = percentiles(F.col("luma"), DARKEST, BRIGHTEST)
    limits = df.groupBy("image_id").agg(pct(F.col("_var"), CALM).alias("_calm"), low.alias("_low"), high.alias("_high"), (F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    df = join_back(df, limits, settle=True)
    calm = F.col("_var") <= F.greatest(F.round("_calm", 9), F.lit(1e-8))
    exposed = F.col("luma").between(F.round("_low", 9), F.round("_high", 9))
    counts = df.groupBy("image_id").agg(F.count_if(calm & exposed).alias("_n"))
    df = join_back(df, counts, settle=True).withColumn("_base", calm & (exposed | (F.col("_n") < fewest)))
    df = settled(df.select("image_id", "y", "x", *RGB, "luma", "_base", "h", "w"))

    on = lambda c: F.when(F.col("_base"), c)
    sums = {"n": on(F.lit(1.0)), "l": on(F.col("luma"))} | {f"s_{c}": on(F.col(c)) for c in RGB} | {f"q_{c}": on(F.col(c) * F.col(c)) for c in RGB}
    size = df.groupBy("image_id").agg(F.first("h").alias("h"), F.first("w").alias("w"))
    rects = settled(grid_rectangles(size, (1, cells)))
    table = summed_area(df, sums)
    stats = rectangle_sums(table, rects, list(sums)).where(F.col("n") > 0)
    std = {f"std_{c}": F.sqrt(F.greatest(F.round(F.col(f"q_{c}") / F.col("n") - F.pow(F.col(f"s_{c}") / F.col("n"), 2), 12), F.lit(0.0))) for c in RGB}
    stats = stats.select(F.col("image_id").alias("_i"), F.col("region").alias("_r"), *[e.alias(n) for n, e in std.items()], F.rint("n").cast("long").alias("n"), (F.col("l") / F.col("n")).alias("luma_mean"))

    cell = lambda i, n: F.floor((F.col(i) * cells + cells - 1) / F.col(n))  # noqa: E731  # of borders at floor(k * n / cells)
    named = df.where("_base").withColumns({"_gy": cell("y", "h"), "_gx": cell("x", "w")})
    named = named.withColumn("cell", F.format_string(f"grid_{cells}_%d_%d", "_gy", "_gx"))
    medians = named.groupingSets([["image_id"], ["image_id", "cell"]], "image_id", "cell").agg(*[F.median(c).alias(c) for c in RGB])
    medians = medians.withColumn("cell", F.coalesce("cell", F.lit("grid_1_0_0")))
    both = medians.join(stats, (F.col("image_id") == F.col("_i")) & (F.col("cell") == F.col("_r")))
    region = F.when(F.col("cell") == "grid_1_0_0", "low_variance_base").otherwise(F.col("cell"))
    return both.where((F.col("cell") == "grid_1_0_0") | (F.col("n") >= cell_fewest)).select("image_id", region.alias("region"), *RGB, *std, "n", "luma_mean")


def _norm(cols: list[Column]) -> Column:
    return F.sqrt(cols[0] * cols[0] + cols[1] * cols[1] + cols[2] * cols[2])


def score_candidates(candidates: DataFrame) -> DataFrame:
    """Adds score (0..1) and consistent: how near a candidate is to the median of its frame's candidates."""
    mid = candidates.groupBy("image_id").agg(*[F.median(c).alias(f"_m{c}") for c in RGB])
    df = join_back(candidates, mid, settle=True)
    df = df.withColumn("_rel", F.round(_norm([F.col(c) - F.col(f"_m{c}") for c in RGB]) / (_norm([F.col(f"_m{c}") for c in RGB]) + EPS), 9))
    df = join_back(df, df.groupBy("image_id").agg(F.greatest(F.round(pct(F.col("_rel"), 70), 9), F.lit(0.05)).alias("_top")), settle=True)
    df = df.withColumns({"score": C.clamp(1.0 - F.col("_rel") / (2.0 * F.col("_top"))), "consistent": F.col("_rel") <= F.col("_top")})
    return df.drop("_rel", "_top", *[f"_m{c}" for c in RGB])


def base_model(scored: DataFrame) -> DataFrame:
    """(image_id, r, g, b, rel_spread, confidence, n_candidates, n_consistent): the median of the consistent candidates, all where none is."""
    counts = scored.groupBy("image_id").agg(F.count("*").alias("n_candidates"), F.count_if("consistent").alias("_n"))
    good = join_back(scored, counts, settle=True).where(F.col("consistent") | (F.col("_n") == 0))
    fused = good.groupBy("image_id").agg(*[C.clamp(F.median(c), EPS, 1.0).alias(c) for c in RGB], *[F.stddev_pop(c).alias(f"_s{c}") for c in RGB], F.count("*").alias("n_consistent"), F.first("n_candidates").alias("n_candidates"))
    mean = lambda names: sum((F.col(n) for n in names[1:]), F.col(names[0])) / 3.0
    fused = fused.withColumn("rel_spread", mean([f"_s{c}" for c in RGB]) / (mean(list(RGB)) + EPS))
    sure = C.clamp(F.col("n_consistent") / F.col("n_candidates") * (1.0 - 4.0 * F.col("rel_spread")))
    return fused.select("image_id", *RGB, "rel_spread", sure.alias("confidence"), "n_candidates", "n_consistent")


def flat_field(flat: DataFrame) -> DataFrame:
    """(y, x, f_r, f_g, f_b, i_r, i_g, i_b, m_r, m_g, m_b): a flat frame's values, its illumination (over its mean) and means."""
    means = settled(flat.agg(*[F.avg(c).alias(f"m_{c}") for c in RGB]))
    both = flat.select("y", "x", *[F.col(c).alias(f"f_{c}") for c in RGB]).join(F.broadcast(means), F.lit(True))  # one row
    return both.withColumns({f"i_{c}": F.greatest(F.col(f"f_{c}") / F.greatest(f"m_{c}", F.lit(EPS)), F.lit(EPS)) for c in RGB})


def base_ratio(base: DataFrame, flat: DataFrame, enough: int = 200, some: int = 50, most: int = 512) -> DataFrame:
    """(r, g, b, confidence, n): base colour as the upper ratio of base over flat in calm, normally exposed pixels, times the flat's means.

    base: pixels of one frame of clear film; flat: as flat_field() gives them. Too few such pixels: calm ones only, then all.
    """
    px = base.join(flat, ["y", "x"]).withColumn("image_id", F.lit(0).cast("long"))
    means = px.agg(*[F.first(f"m_{c}").alias(f"m_{c}") for c in RGB])
    px = proxy(px, most, (*RGB, *[f"f_{c}" for c in RGB])).withColumn("luma", F.round(C.luma(*[F.col(c) for c in RGB]), 9))
    px = settled(with_local_variance(px, "luma", "_var"))
    low, high = percentiles(F.col("luma"), DARKEST, RATIO_BRIGHTEST)
    px = join_back(px, px.groupBy("image_id").agg(F.greatest(F.round(pct(F.col("_var"), RATIO_CALM), 9), F.lit(1e-9)).alias("_calm"), F.round(low, 9).alias("_low"), F.round(high, 9).alias("_high")), settle=True)
    zone = relaxed(px, [F.col("_var") <= F.col("_calm"), F.col("luma").between(F.col("_low"), F.col("_high"))], [enough, some])
    ratio = {c: F.col(c) / F.greatest(f"f_{c}", F.lit(EPS)) for c in RGB}
    got = zone.agg(*[pct(ratio[c], RATIO_POINT).alias(f"p_{c}") for c in RGB], *[F.stddev_pop(ratio[c]).alias(f"s_{c}") for c in RGB], F.count("*").alias("n"))
    mean = lambda k: (F.col(f"{k}_r") + F.col(f"{k}_g") + F.col(f"{k}_b")) / 3.0
    sure = C.clamp(1.0 - 2.0 * mean("s") / (mean("p") + EPS))
    both = got.join(F.broadcast(means), F.lit(True))  # one row each
    return both.select(*[C.clamp(F.col(f"p_{c}") * F.col(f"m_{c}"), EPS, 1.0).alias(c) for c in RGB], sure.alias("confidence"), "n")


def frame_errors(frames: DataFrame, flat: DataFrame) -> DataFrame:
    """(image_id, error) of all frames: what keeps a frame from being processed, null where nothing does.

    Told per frame, so one broken frame leaves the others alone.
    """
    known = flat.select(F.col("y").alias("_y"), F.col("x").alias("_x"))
    px = frames.join(known, (F.col("y") == F.col("_y")) & (F.col("x") == F.col("_x")), "left")
    finite = F.lit(True)
    for c in RGB:
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    got = px.groupBy("image_id").agg(F.count_if(~finite).alias("bad"), F.count_if(F.col("_y").isNull()).alias("outside"))
    said = F.when(F.col("outside") > 0, F.format_string("flat field: %d pixels outside of it", "outside"))
    said = said.when(F.col("bad") > 0, F.format_string("load: %d pixels without a finite value", "bad"))
    return got.select("image_id", said.alias("error"))


def invert_frames(frames: DataFrame, flat: DataFrame, base: DataFrame, negative: bool = True, point: float = 99.0) -> DataFrame:
    """Technical positives (image_id, y, x, r, g, b): flat-corrected, density over the base, over its upper reference, inverted."""
    px = frames.join(flat.select("y", "x", *[f"i_{c}" for c in RGB]), ["y", "x"])
    px = px.select("image_id", "y", "x", *[C.clamp(F.col(c) / F.col(f"i_{c}")).alias(c) for c in RGB])
    if not negative:
        return px
    px = px.join(F.broadcast(base.select(*[F.col(c).alias(f"b_{c}") for c in RGB])), F.lit(True))  # one row
    px = px.select("image_id", "y", "x", *[T.density(C.clamp(F.col(c) / F.col(f"b_{c}"), EPS, 1.0)).alias(c) for c in RGB])
    upper = px.groupBy("image_id").agg(*[F.greatest(pct(F.col(c), point), F.lit(0.05)).alias(f"u_{c}") for c in RGB])
    px = join_back(settled(px), upper, settle=True)
    return px.select("image_id", "y", "x", *[C.clamp(1.0 - F.col(c) / F.col(f"u_{c}")).alias(c) for c in RGB])


def _means(df: DataFrame, prefix: str) -> DataFrame:
    clipped = sum((share((F.col(c) <= 0) | (F.col(c) >= 1)) for c in RGB[1:]), share((F.col("r") <= 0) | (F.col("r") >= 1))) / 3.0
    return df.groupBy("image_id").agg(*[F.avg(c).alias(f"{prefix}{c}") for c in RGB], clipped.alias(f"{prefix}clipped"))


def neutralised(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Grey-world gains, 0.5 to 2, on every channel, clipped; and each image's means before them (image_id, p_r, p_g, p_b, p_clipped)."""
    means = settled(_means(df, "p_"))
    grey = (F.col("p_r") + F.col("p_g") + F.col("p_b")) / 3.0
    gains = means.select("image_id", *[F.when(grey < EPS, 1.0).otherwise(C.clamp(grey / F.greatest(f"p_{c}", F.lit(EPS)), 0.5, 2.0)).alias(f"gain_{c}") for c in RGB])
    out = join_back(df, gains)
    return out.select("image_id", "y", "x", *[C.clamp(F.col(c) * F.col(f"gain_{c}")).alias(c) for c in RGB]), means


def output_metrics(df: DataFrame) -> DataFrame:
    """Nine metrics of finished positives 0..1."""
    r, g, b = (F.col(c) for c in RGB)
    gray = C.luma(r, g, b)
    df = df.withColumns({"gray": gray, "_g8": F.floor(F.round(gray * 255.0, 6)).cast("double"), "_sat": C.saturation(*[F.floor(F.round(c * 255.0, 6)) for c in (r, g, b)])})
    df = laplacian(df, "_g8")
    three = lambda f: (f(r) + f(g) + f(b)) / 3.0
    m = [F.avg(c) for c in RGB]
    return df.groupBy("image_id").agg(
        F.avg("gray").alias("gray_mean"), F.stddev_pop("gray").alias("gray_std"), three(lambda c: share(c <= 0)).alias("clipped_black"), three(lambda c: share(c >= 1)).alias("clipped_white"),
        (F.greatest(*m) - F.least(*m)).alias("channel_spread"), F.avg("_sat").alias("saturation"), F.var_pop("laplacian").alias("sharpness"),
        (m[2] - m[0]).alias("blue_red"), (m[1] - (m[0] + m[2]) / 2.0).alias("green_magenta"),
    )


def evaluated(df: DataFrame) -> DataFrame:
    """Scores of inversion and rendering, the cast and the confidence from a frame's metrics and its clipped share before (p_clipped)."""
    spread, clipped, grey = F.col("channel_spread"), F.col("p_clipped"), F.round("gray_mean", 9)
    inversion = C.clamp((1.0 - F.least(spread * 5.0, F.lit(1.0))) * 0.5 + (1.0 - F.least(clipped * 4.0, F.lit(1.0))) * 0.5)
    exposure = F.when(grey.between(0.25, 0.75), 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.abs(grey - 0.5) * 3.0))
    rendering = C.clamp(exposure * 0.5 + C.clamp((F.col("sharpness") - 50.0) / 300.0) * 0.5)
    br, gm = F.round("blue_red", 9), F.round("green_magenta", 9)
    cast = F.when(br > 0.05, "blue").when(br < -0.05, "red").when(gm > 0.05, "green").when(gm < -0.05, "magenta")
    return df.withColumns({"score": inversion * 0.6 + rendering * 0.4, "inversion": inversion, "rendering": rendering, "cast": cast, "confidence": C.clamp(1.0 - 2.0 * clipped)})


def rendered(df: DataFrame, gains=(1.0, 1.0, 1.0), gamma: float = 1.0, contrast: float = 0.0, amount: float = 0.3, sigma: float = 1.2) -> DataFrame:
    """Residual gains, gamma, contrast around the middle, and an unsharp mask where they change anything."""
    df = df.withColumns({c: C.clamp(F.col(c) * k) for c, k in zip(RGB, gains, strict=True)})
    if abs(gamma - 1.0) > 0.001:
        df = df.withColumns({c: F.pow(C.clamp(F.col(c), EPS, 1.0), F.lit(gamma)) for c in RGB})
    if abs(contrast) > 0.001:
        df = df.withColumns({c: C.clamp(0.5 + (F.col(c) - 0.5) * (1.0 + contrast)) for c in RGB})
    if amount > 0.001:
        df = unsharp(df, RGB, amount, sigma)
    return df.withColumns({c: C.clamp(F.col(c)) for c in RGB})


def run_protocol(flat: DataFrame, base: DataFrame, frames: DataFrame, negative: bool = True, enough: int = 200, some: int = 50, **render) -> tuple[DataFrame, DataFrame]:
    """The whole protocol: (report, rendered pixels). flat, base: pixels (y, x, r, g, b); frames: with an image_id.

    The report has a row per frame: status ok or error, the error, and for good frames the means, metrics and scores.
    """
    flat = settled(flat_field(flat))
    colour = settled(base_ratio(base, flat, enough, some))
    errors = settled(frame_errors(frames, flat))
    good = join_back(frames, errors.where("error is null").select("image_id"))
    neutral, before = neutralised(settled(invert_frames(good, flat, colour, negative)))
    neutral = settled(neutral)
    metrics = evaluated(join_back(output_metrics(neutral), before))
    report = errors.withColumnRenamed("image_id", "_e").join(metrics, F.col("_e") == F.col("image_id"), "left")
    report = report.withColumns({"status": F.when(F.col("error").isNull(), "ok").otherwise("error"), "image_id": F.col("_e")}).drop("_e")
    return report, rendered(neutral, **render)
