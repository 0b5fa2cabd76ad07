"""Refinement by delta iteration: only images that haven't passed are processed again, with new parameters."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import color as C
from ..functions import text as X
from .develop import level
from .ranking import best_run
from .reductions import image_metrics
from .scratch import settled

Process = Callable[[DataFrame, Sequence[str]], DataFrame]
Evaluate = Callable[[DataFrame, int], DataFrame]


def refine_images(pixels: DataFrame, params: DataFrame, process: Process, evaluate: Evaluate, most: int = 3) -> tuple[DataFrame, DataFrame, list[tuple[int, int, int]]]:
    """(report, pixels of each image's best round, rounds) of images that are processed, judged and processed again.

    params: (image_id, parameters) of the first round. process(pixels with the parameters, their names) gives the
    processed pixels (image_id, y, x, ...); evaluate(processed, round) a row per image: image_id, score, passed,
    feedback and the parameters of the next round. Always the original pixels are processed.

    Only images that haven't passed go into the next round: their pixels are told by a join with the few rows of the
    active set, and each round's table is written, so nothing is processed twice. Best is the highest score, of equal
    ones the earliest. rounds: (round, images, pixels processed), as counted; it ends early when all have passed.
    """
    names = [c for c in params.columns if c != "image_id"]
    active = settled(params)
    made, judged, rounds = [], [], []
    for k in range(1, most + 1):
        images = active.count()
        if not images:
            break
        mine = pixels.join(active.withColumnRenamed("image_id", "_k"), F.col("image_id") == F.col("_k")).drop("_k")
        out = settled(process(mine, names).withColumn("iteration", F.lit(k)))
        seen = evaluate(out.drop("iteration"), k).join(active.select(F.col("image_id").alias("_k"), *[F.col(n).alias(f"used_{n}") for n in names]), F.col("image_id") == F.col("_k")).drop("_k")
        seen = settled(seen.withColumn("iteration", F.lit(k)))
        made.append(out)
        judged.append(seen)
        rounds.append((k, images, out.count()))
        active = settled(seen.where("not passed").select("image_id", *names))
    if not judged:
        return _nothing(params, names), pixels.limit(0), rounds
    history = reduce(DataFrame.unionByName, judged)
    tries = history.groupBy("image_id").agg(F.max("iteration").alias("tries")).withColumnRenamed("image_id", "_k")
    best = best_run(history.select("image_id", "iteration", "score", "passed", "feedback", *[F.col(f"used_{n}").alias(n) for n in names]), "image_id")
    report = settled(best.join(tries, F.col("image_id") == F.col("_k")).drop("_k"))
    chosen = report.select(F.col("image_id").alias("_k"), F.col("iteration").alias("_i"))
    shown = reduce(DataFrame.unionByName, made).join(chosen, (F.col("image_id") == F.col("_k")) & (F.col("iteration") == F.col("_i"))).drop("_k", "_i")
    return report, shown, rounds


def _nothing(params: DataFrame, names: list[str]) -> DataFrame:
    more = {"iteration": T.IntegerType(), "score": T.DoubleType(), "passed": T.BooleanType(), "feedback": T.StringType()}
    return params.limit(0).select("image_id", *[F.lit(None).cast(t).alias(n) for n, t in more.items()], *names, F.lit(None).cast("int").alias("tries"))


def curves(df: DataFrame, names: Sequence[str] = ()) -> DataFrame:
    """8-bit pixels through the row-local tone stages with each image's own parameters, as columns of df: gamma,
    highlight_compression, shadow_lift and vibrance; a stage without effect leaves its values as they are."""
    v, rgb = lambda c: F.col(c), ("r", "g", "b")
    steps = [
        lambda c: F.when(F.abs(v("gamma") - 1.0) < 0.01, c).otherwise(level(F.pow(c / 255.0, v("gamma")) * 255.0)),
        lambda c: F.when(v("highlight_compression") <= 0.001, c).otherwise(level(c / 255.0 * (1.0 - v("highlight_compression") * c / 255.0) * 255.0)),
        lambda c: F.when(v("shadow_lift") == 0, c).otherwise(level(c + v("shadow_lift"))),
    ]
    for step in steps:
        df = df.withColumns({c: step(v(c)) for c in rgb})
    sat = C.saturation(*map(v, rgb))
    vivid = C.with_saturation(*map(v, rgb), C.clamp(sat + v("vibrance") * (1.0 - sat)))
    vivid = {c: F.when(F.abs(v("vibrance")) < 0.01, v(c)).otherwise(level(x)) for c, x in zip(rgb, vivid, strict=True)}
    return df.withColumns(vivid).select("image_id", "y", "x", *rgb)


#: Weights of the penalties, and what a good image keeps to.
_EXPOSED, _SHARP, _MUTED, _GREY = (100.0, 165.0), 200.0, 0.08, 0.04
_CAST, _SPREAD, _SOFT = 0.08, 0.18, 0.40


def judged(df: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Score, feedback and next parameters of 8-bit images (image_id, y, x, r, g, b) by rules over nine metrics.

    (image_id, score, passed, feedback, the parameters): exposure, clipping, cast, softness and lack of colour
    take from 1; each names itself and sets the parameters that mend it.
    """
    m = image_metrics(df)
    m = m.select("image_id", *[F.round(c, 9).alias(c) for c in m.columns if c != "image_id"])
    mean, br, gm = F.col("gray_mean"), F.col("blue_red"), F.col("green_magenta")
    spread, sat, white = F.col("spread"), F.col("saturation"), F.col("clipped_white")
    sharp = F.least(F.col("sharpness") / _SHARP, F.lit(1.0))
    exposure = F.when(mean < _EXPOSED[0], F.least((_EXPOSED[0] - mean) / 100.0, F.lit(1.0))).when(mean > _EXPOSED[1], F.least((mean - _EXPOSED[1]) / 90.0, F.lit(1.0))).otherwise(0.0)
    cast = F.least(spread * 1.2 + F.abs(br) * 1.8 + F.abs(gm) * 0.8, F.lit(1.0))
    grey = F.when(sat < _GREY, 1.0).when(sat < _MUTED, (_MUTED - sat) / 0.04).otherwise(0.0)
    score = 1.0 - 0.22 * exposure - 0.12 * F.least(F.col("clipped_black") + white, F.lit(1.0)) - 0.28 * cast - 0.20 * (1.0 - sharp) - 0.18 * grey
    said = F.array(
        F.when(mean < _EXPOSED[0], "image is too dark").when(mean > _EXPOSED[1], "image is too bright"),
        F.when(br > _CAST, "blue/cyan cast remains").when(br < -_CAST, "red/yellow cast remains").when(spread > _SPREAD, "visible channel imbalance"),
        F.when(sharp < _SOFT, "output appears soft"), F.when(sat < _GREY, "output is desaturated").when(sat < _MUTED, "colours are muted"),
    )
    said = F.filter(said, lambda t: t.isNotNull())
    said = F.when(F.size(said) == 0, F.array(F.lit("good exposure, colour balance, and detail"))).otherwise(said)
    base = {n: F.lit(v[0]) for n, v in X.PARAMS.items()}
    dark, bright = mean < _EXPOSED[0], mean > _EXPOSED[1]
    blue, red, uneven = br > _CAST, br < -_CAST, (F.abs(br) <= _CAST) & (spread > _SPREAD)
    soft, muted = sharp < _SOFT, sat < _MUTED
    rules = {
        "gamma": ((dark, 0.75), (bright, 1.3)), "shadow_lift": ((dark, 8.0),), "clahe_clip": ((dark, 1.8),), "black_point": ((bright, 1.2),), "white_point": ((bright, 98.7),),
        "wb_clip_percent": ((blue | red, 0.9), (uneven, 0.7)), "lab_strength": ((muted, 1.0), (blue | red, 1.2), (uneven, 1.1)), "desat_strength": ((blue, 0.35), (uneven, 0.30)), "desat_sigma": ((blue, 5.0),),
        "unsharp_amount": ((soft, 0.50),), "unsharp_sigma": ((soft, 1.0),), "vibrance": ((muted, 0.25),), "highlight_compression": ((white > 0.01, 0.25),),
    }
    for name, cases in rules.items():
        value = base[name]
        for condition, v in reversed(cases):
            value = F.when(condition, v).otherwise(value)
        base[name] = value
    score = F.round(C.clamp(score), 9)
    return m.select("image_id", score.alias("score"), (score >= threshold).alias("passed"), X.sentence(said).alias("feedback"), *[v.cast("double").alias(n) for n, v in base.items()])
