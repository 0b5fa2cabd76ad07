"""Mosaicking: tiles overlap and are feathered into one canvas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Files of a manifest that is broadcast at most; a longer one is shuffled.
FILES = 100_000


def stitch(manifest: DataFrame, tiles: DataFrame, overlap: int, value: str | Sequence[str] = "v") -> DataFrame:
    """(image_id, y, x, values): weighted means of the tiles' pixels at each canvas place, of one or several columns.

    manifest: (filename, row, col, left, top, width, height), tiles: (image_id, filename, y, x, values).
    A manifest row without pixels is an error. Each tile pixel is read once and combined before
    the shuffle; nothing holds a canvas.
    """
    values = [value] if isinstance(value, str) else list(value)
    # Files of the manifest that no tile has; the manifest is small next to its pixels.
    missing = manifest.join(tiles.select("filename").distinct(), "filename", "left_anti").select("filename").limit(1).collect()
    if missing:
        raise FileNotFoundError(missing[0][0])
    last = manifest.agg(F.max("row").alias("last_row"), F.max("col").alias("last_col"))
    m = manifest.join(F.broadcast(last), F.lit(True))  # one row
    # Images may share their files' names: with few files pixels stay where they are, instead of all of a file going to one task.
    if manifest.limit(FILES + 1).count() <= FILES:
        m = F.broadcast(m)
    px = tiles.join(m, "filename")

    def ramp(i: Column, n: Column, inner_start: Column, inner_end: Column) -> Column:
        k = float(max(overlap - 1, 1))
        up = F.when(inner_start & (i < overlap), 1e-3 + (1 - 1e-3) * i / k).otherwise(1.0)
        down = F.when(inner_end & (i >= n - overlap), 1e-3 + (1 - 1e-3) * (n - 1 - i) / k).otherwise(1.0)
        return up * down

    w = ramp(F.col("y"), F.col("height"), F.col("row") > 0, F.col("row") < F.col("last_row")) * ramp(F.col("x"), F.col("width"), F.col("col") > 0, F.col("col") < F.col("last_col"))
    px = px.select("image_id", (F.col("y") + F.col("top")).alias("y"), (F.col("x") + F.col("left")).alias("x"), *values, w.alias("_w"))
    return px.groupBy("image_id", "y", "x").agg(*[(F.sum(F.col(v) * F.col("_w")) / F.greatest(F.sum("_w"), F.lit(1e-6))).alias(v) for v in values])


def tile_listing(manifest: DataFrame, prefix: str, *by: str) -> DataFrame:
    """Largest row and column, and the tiles' addresses in reading order: of the manifest, or of each scan in it."""
    return manifest.groupBy(*by).agg(
        F.max("row").alias("rows"), F.max("col").alias("cols"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "filename"))), lambda t: F.concat(F.lit(prefix), t["filename"])), ",").alias("tiles"),
    )
