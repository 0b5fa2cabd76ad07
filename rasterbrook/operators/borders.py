"""Borders of a frame: a weighted vote of candidates, of which what hangs together with the edge becomes side strips."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import color as C
from .masks import calm_border, edge_border, projection_border
from .neighbourhood import KEYS, edge_connected, edge_distance, sizes
from .reductions import share
from .scratch import settled
from .stats import join_back

#: Least share of an image that counts as a find, votes for border and for clear base, coverage of a strip and its greatest depth.
LEAST, BORDER, CLEAR, COVERED, DEEPEST = 0.005, 0.33, 0.66, 0.60, 0.20
SIDES = ("top", "bottom", "left", "right")


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def side_depths(df: DataFrame, mask: str, coverage: float = COVERED, part: float = DEEPEST) -> DataFrame:
    """(image_id, top, bottom, left, right): lines from each side of which every first so many are covered by the mask. df has h and w.

    Lines are counted in one aggregate for all sides; at most a part of an image's lines is looked at.
    """
    at = {"top": ("y", "h"), "bottom": ("y", "h"), "left": ("x", "w"), "right": ("x", "w")}
    lines = []
    for side, (axis, n) in at.items():
        i = F.col(axis) if side in ("top", "left") else F.col(n) - 1 - F.col(axis)
        most = F.greatest(F.lit(1), F.floor(F.round(F.col(n) * part, 9)))
        lines.append(F.when(i < most, F.struct(F.lit(side).alias("side"), i.cast("long").alias("i"), most.cast("long").alias("most"))))
    rows = df.withColumn("_s", F.explode(F.filter(F.array(*lines), lambda s: s.isNotNull())))
    rows = rows.groupBy("image_id", "_s.side", "_s.i").agg(F.count_if(_true(F.col(mask))).alias("on"), F.count("*").alias("n"), F.first("_s.most").alias("most"))
    w = W.partitionBy("image_id", "side").orderBy("i")
    rows = rows.withColumn("ok", F.sum("on").over(w) >= F.round(coverage * F.sum("n").over(w), 9))
    depth = rows.groupBy("image_id", "side").agg(F.coalesce(F.min(F.when(~F.col("ok"), F.col("i"))), F.first("most")).alias("depth"))
    return depth.groupBy("image_id").agg(*[F.max(F.when(F.col("side") == s, F.col("depth"))).alias(s) for s in SIDES])


def side_strips(df: DataFrame, mask: str, name: str) -> DataFrame:
    """The mask as strips along the four sides, the mask itself where these come to too little. df has h and w."""
    df = join_back(df, side_depths(df, mask), settle=True)
    strip = (F.col("y") < F.col("top")) | (F.col("y") >= F.col("h") - F.col("bottom")) | (F.col("x") < F.col("left")) | (F.col("x") >= F.col("w") - F.col("right"))
    found = df.groupBy("image_id").agg(share(strip).alias("_found"))
    df = join_back(df.withColumn("_strip", strip), found, settle=True)
    return df.withColumn(name, F.when(F.col("_found") < LEAST, _true(F.col(mask))).otherwise(F.col("_strip"))).drop("_strip", "_found", *SIDES)


def refined(df: DataFrame, mask: str, name: str, block: int = 256) -> DataFrame:
    """The mask's regions that touch the image's edge as side strips; where those are too little, of the whole mask. df has h and w."""
    on = edge_connected(df.select(*KEYS, mask), mask, block).where("connected").select(*[F.col(c).alias(f"_e_{c}") for c in KEYS])
    same = (F.col("image_id") == F.col("_e_image_id")) & (F.col("y") == F.col("_e_y")) & (F.col("x") == F.col("_e_x"))
    df = df.join(on, same, "left").withColumn("_on", F.col("_e_y").isNotNull()).drop("_e_image_id", "_e_y", "_e_x")
    df = settled(df)
    df = join_back(df, df.groupBy("image_id").agg(share(F.col("_on")).alias("_part")), settle=True)
    df = df.withColumn("_kept", F.when(F.col("_part") < LEAST, _true(F.col(mask))).otherwise(F.col("_on"))).drop("_on", "_part")
    return settled(side_strips(df, "_kept", name).drop("_kept"))


def merge_borders(df: DataFrame, candidates: dict[str, Column], block: int = 256) -> tuple[DataFrame, DataFrame]:
    """(pixels, report) of candidates: columns of df with 0/1 masks and, by their name, each image's confidence in them (0..1).

    pixels: (image_id, y, x, border, clear). report: (image_id, x0, y0, x1, y1 of the content, confidence, border_share).
    An image's confidence is 0.4 of the votes within the border, 0.4 of its nearness to the edge and 0.2 of the depth of its strips.
    """
    votes = [F.when(_true(F.col(m)), c).otherwise(0.0) for m, c in candidates.items()]
    total = reduce(Column.__add__, candidates.values())
    vote = F.round(reduce(Column.__add__, votes) / F.when(total < 1e-8, 1.0).otherwise(total), 9)
    df = settled(edge_distance(settled(df.select(*KEYS, vote.alias("vote")))))
    df = df.withColumns({"_border": F.col("vote") >= BORDER, "_clear": F.col("vote") >= CLEAR})
    df = refined(refined(df, "_border", "border", block), "_clear", "_strips", block)
    df = join_back(df, df.groupBy("image_id").agg(share(F.col("_strips")).alias("_part")), settle=True)
    df = df.withColumn("clear", F.when(F.col("_part") < LEAST, F.col("border")).otherwise(F.col("_strips")))
    on, off = F.col("border"), ~F.col("border")
    seen = df.groupBy("image_id").agg(
        *[f(F.when(off, F.col(c))).alias(n) for n, f, c in (("x0", F.min, "x"), ("y0", F.min, "y"), ("x1", F.max, "x"), ("y1", F.max, "y"))],
        F.avg(F.when(on, F.col("vote"))).alias("_votes"), F.avg(F.when(on, F.col("distance"))).alias("_far"), F.first("h").alias("h"), F.first("w").alias("w"), share(on).alias("border_share"),
    )
    seen = join_back(seen, side_depths(df, "border"))
    deep = [F.col(s) / F.greatest(F.col(n) * 0.05, F.lit(1.0)) for s, n in zip(SIDES, "hhww", strict=True)]
    near = F.coalesce(C.clamp(1.0 - F.col("_far") / (F.least("h", "w") / 4.0)), F.lit(0.0))
    sure = C.clamp(0.4 * F.coalesce("_votes", F.lit(0.0)) + 0.4 * near + 0.2 * C.clamp(reduce(Column.__add__, deep) / 4.0))
    return df.select(*KEYS, "border", "clear"), seen.select("image_id", "x0", "y0", "x1", "y1", sure.alias("confidence"), "border_share")


def with_projection(df: DataFrame) -> DataFrame:
    """df (v) with the projection candidate (projection) and its confidence (c_projection), that of four times the share of bright rows and columns."""
    df = settled(projection_border(df).withColumnRenamed("candidate", "projection"))
    bright = {"r": F.col("row_mean") >= 0.85 * F.col("row_top"), "c": F.col("col_mean") >= 0.85 * F.col("col_top")}
    rows = F.avg(F.when(F.col("x") == 0, F.when(bright["r"], 1.0).otherwise(0.0)))
    cols = F.avg(F.when(F.col("y") == 0, F.when(bright["c"], 1.0).otherwise(0.0)))
    sure = F.when(share(F.col("projection")) < LEAST, 0.1).otherwise(C.clamp((rows + cols) * 2.0))
    return join_back(df, df.groupBy("image_id").agg(sure.alias("c_projection"))).select("image_id", "y", "x", "v", "projection", "c_projection")


def with_calm(df: DataFrame, size: int = 15, part: float = 0.02) -> DataFrame:
    """df with the low-variance candidate (calm) and its confidence (c_calm), the higher the nearer it lies to the edge."""
    df = settled(edge_distance(settled(calm_border(df, size, part).withColumnRenamed("candidate", "calm"))))
    far = F.avg(F.when(F.col("calm"), F.col("distance"))) / (F.least(F.first("h"), F.first("w")) / 2.0 + 1e-6)
    sure = F.when(share(F.col("calm")) < LEAST, 0.1).otherwise(C.clamp(1.0 - 2.0 * far, 0.1, 0.9))
    return join_back(df, df.groupBy("image_id").agg(sure.alias("c_calm"))).drop("variance", "distance", "h", "w")


def detect_border(df: DataFrame, block: int = 256) -> tuple[DataFrame, DataFrame]:
    """Border of planes (image_id, y, x, v): the vote of the projection, the edge and the low-variance candidate."""
    df = settled(df.select(*KEYS, "v"))
    parts = [settled(with_projection(df).drop("v")), settled(with_calm(df).drop("v"))]
    edge = settled(edge_border(df).select(*KEYS, F.col("candidate").alias("edge"), F.col("confidence").alias("c_edge")))
    both = parts[0].join(parts[1], list(KEYS)).join(edge, list(KEYS))
    return merge_borders(both, {"projection": F.col("c_projection"), "edge": F.col("c_edge"), "calm": F.col("c_calm")}, block)
