"""Neighbourhood operators: lines as arrays or window frames, so that work splits by image line."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .graph import components
from .scratch import settled
from .stats import join_back


def reflect(i: Column, n: Column) -> Column:
    """Index at a mirrored border, the edge itself not repeated."""
    p = F.greatest(2 * (n - 1), F.lit(1))
    m = F.pmod(i, p)
    return F.when(n <= 1, F.lit(0)).when(m < n, m).otherwise(p - m).cast("int")


KEYS = ("image_id", "y", "x")


def _lines(df: DataFrame, along: str, values: Sequence[str]) -> DataFrame:
    """A row per line of an image: its pixels in order, as _l."""
    across = "x" if along == "y" else "y"
    return df.groupBy("image_id", across).agg(F.array_sort(F.collect_list(F.struct(along, *values))).alias("_l"))


def line_filter(df: DataFrame, value: str | Sequence[str], weights: list[float], along: str, keep: Sequence[str] = ()) -> DataFrame:
    """Weighted sums of one or several columns over 2k + 1 neighbours along y or x, next to the columns in keep as they are.

    A line of one image is gathered, never an image, and all columns travel in one shuffle.
    """
    values = [value] if isinstance(value, str) else list(value)
    across = "x" if along == "y" else "y"
    k, n = len(weights) // 2, F.size("_l")

    def at(i: Column) -> Column:
        near = [F.col("_q")[i + d] for d in range(len(weights))]
        sums = []
        for v in values:
            terms = [w * p[v] for w, p in zip(weights, near, strict=True)]
            sums.append(sum(terms[1:], terms[0]).alias(v))
        own = near[k]
        return F.struct(own[along].alias(along), *sums, *[own[c].alias(c) for c in keep])

    lines = _lines(df, along, [*values, *keep])
    # The line with its mirrored ends, so that each neighbour is looked up by its place and reflected once, not for every pixel.
    lines = lines.select("image_id", across, n.alias("_n"), F.transform(F.sequence(F.lit(-k), n + (k - 1)), lambda i: F.col("_l")[reflect(i, n)]).alias("_q"))
    made = lines.select("image_id", across, F.explode(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), at)).alias("_p"))
    return made.select("image_id", across, *[f"_p.{c}" for c in (along, *values, *keep)])


def gaussian(sigma: float) -> list[float]:
    k = math.ceil(4 * sigma)
    w = [math.exp(-d * d / (2 * sigma * sigma)) for d in range(-k, k + 1)]
    return [x / sum(w) for x in w]


def blur(df: DataFrame, value: str | Sequence[str], sigma: float, keep: Sequence[str] = ()) -> DataFrame:
    """(image_id, y, x, values, kept columns): values blurred along rows, then columns."""
    return line_filter(line_filter(df, value, gaussian(sigma), "x", keep), value, gaussian(sigma), "y", keep)


def with_blur(df: DataFrame, value: str, sigma: float, name: str) -> DataFrame:
    """df with the blurred column: the others travel along, so df is read once."""
    kept = [c for c in df.columns if c not in (*KEYS, name)]
    return blur(df.withColumn(name, F.col(value)), name, sigma, kept).select(*KEYS, *kept, name)


def unsharp(df: DataFrame, value: str | Sequence[str], amount: float, sigma: float) -> DataFrame:
    """Values plus a part of their difference from the blurred ones; several columns in the same two shuffles."""
    values = [value] if isinstance(value, str) else list(value)
    soft = {f"_b_{v}": F.col(v) for v in values}
    kept = [c for c in df.columns if c not in KEYS]
    df = blur(df.withColumns(soft), list(soft), sigma, kept).select(*KEYS, *kept, *soft)
    return df.withColumns({v: F.col(v) + amount * (F.col(v) - F.col(f"_b_{v}")) for v in values}).drop(*soft)


def local_variance(df: DataFrame, value: str, size: int, name: str = "variance") -> DataFrame:
    """E[x^2] - E[x]^2 over size x size neighbours, not below 0."""
    box = [1 / size] * size
    kept = [c for c in df.columns if c not in KEYS]
    df = df.withColumns({"_m": F.col(value), "_s": F.col(value) * F.col(value)})
    for axis in ("x", "y"):
        df = line_filter(df, ["_m", "_s"], box, axis, kept)
    return df.select(*KEYS, *kept, F.greatest(F.col("_s") - F.col("_m") * F.col("_m"), F.lit(0.0)).alias(name))


def _sides(value: Column, by: str, order: str) -> tuple[Column, Column]:
    w = W.partitionBy("image_id", by).orderBy(order)
    return F.lag(value).over(w), F.lead(value).over(w)


def laplacian(df: DataFrame, value: str, name: str = "laplacian") -> DataFrame:
    """Sum of the four neighbours less four times the value, mirrored borders."""
    v = F.col(value)
    left, right = _sides(v, "y", "x")
    df = df.withColumn("_h", F.coalesce(left, right, v) + F.coalesce(right, left, v))
    up, down = _sides(v, "x", "y")
    return df.withColumn(name, F.col("_h") + F.coalesce(up, down, v) + F.coalesce(down, up, v) - 4.0 * v).drop("_h")


def median3(df: DataFrame, value: str, name: str = "median") -> DataFrame:
    """Median of 3 x 3, the border repeated."""
    v = F.col(value)
    left, right = _sides(v, "y", "x")
    df = df.withColumn("_row", F.array(F.coalesce(left, v), v, F.coalesce(right, v)))
    up, down = _sides(F.col("_row"), "x", "y")
    nine = F.concat(F.coalesce(up, F.col("_row")), F.col("_row"), F.coalesce(down, F.col("_row")))
    return df.withColumn(name, F.sort_array(nine)[4]).drop("_row")


def replace_bad_pixels(df: DataFrame, value: str, sigmas: float = 4.0) -> DataFrame:
    """Values further from their 3 x 3 median than some standard deviations of that difference take the median."""
    df = median3(df, value, "_med")
    diff = F.col(value) - F.col("_med")
    df = join_back(df, df.groupBy("image_id").agg(F.stddev_pop(diff).alias("_sd")))
    bad = (F.col("_sd") >= 1e-8) & (F.abs(diff) > sigmas * F.col("_sd"))
    return df.withColumn("replaced", bad).withColumn(value, F.when(bad, F.col("_med")).otherwise(F.col(value))).drop("_med", "_sd")


def sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))


def edge_distance(df: DataFrame) -> DataFrame:
    df = join_back(df, sizes(df))
    return df.withColumn("distance", F.least("y", F.col("h") - 1 - F.col("y"), "x", F.col("w") - 1 - F.col("x")))


def _stretched(df: DataFrame, value: str, along: str, factor: int, full: str) -> DataFrame:
    """Lines of block values, bilinear to `full` pixels (half-pixel centres, clamped)."""
    across, other = ("x", "w") if along == "y" else ("y", "h")
    lines = df.groupBy("image_id", across).agg(
        F.array_sort(F.collect_list(F.struct(along, value))).alias("_l"), F.first(full).alias(full), F.first(other).alias(other)
    )
    top = F.size("_l") - 1

    def at(i: Column) -> Column:
        f = (i + 0.5) / factor - 0.5
        low = F.floor(f)
        near = lambda k: F.col("_l")[F.least(F.greatest(k, F.lit(0)), top).cast("int")][value]
        return F.struct(i.cast("long").alias(along), (near(low) * (1.0 - (f - low)) + near(low + 1) * (f - low)).alias(value))

    made = lines.select("image_id", across, full, other, F.explode(F.transform(F.sequence(F.lit(0), F.col(full).cast("int") - 1), at)).alias("_p"))
    return made.select("image_id", across, full, other, f"_p.{along}", f"_p.{value}")


def low_frequency(df: DataFrame, value: str, factor: int, sigma: float) -> DataFrame:
    """Block means, blurred, then bilinear back to full size, first along x, then along y."""
    of = lambda c: F.floor(F.col(c) / factor).alias(c)
    small = df.groupBy("image_id", of("y"), of("x")).agg(F.avg(value).alias("low"))
    small = join_back(blur(small, "low", sigma), sizes(df))
    return _stretched(_stretched(small, "low", "x", factor, "w"), "low", "y", factor, "h").select(*KEYS, "low")


def clahe(df: DataFrame, value: str, grid: int, clip: float, settle: bool = False) -> DataFrame:
    """Contrast-limited equalisation of 8-bit values: tile histograms, clipped, their sums as look-up tables, bilinear.

    A tile's table holds its levels as 256 bits and their sums, so it is no longer than the tile has levels; an image's tables are one
    row joined to its pixels; other columns stay. settle: the tables are written first, so that their own size tells how to join
    them, not that of a compressed table of pixels.
    """
    df = join_back(df, sizes(df))
    df = df.withColumns({"_th": F.ceil(F.col("h") / grid), "_tw": F.ceil(F.col("w") / grid), "_bin": F.floor(value).cast("int")})
    hist = df.groupBy("image_id", F.floor(F.col("y") / F.col("_th")).alias("ty"), F.floor(F.col("x") / F.col("_tw")).alias("tx"), "_bin").agg(F.count("*").alias("n"))
    bit = F.expr("shiftleft(1L, _bin & 63)")
    words = [F.bit_or(F.when(F.floor(F.col("_bin") / 64) == j, bit).otherwise(F.lit(0).cast("long"))).alias(f"_w{j}") for j in range(4)]
    tiles = hist.groupBy("image_id", "ty", "tx").agg(F.array_sort(F.collect_list(F.struct("_bin", "n"))).alias("n"), F.sum("n").alias("area"), *words)
    tiles = tiles.withColumn("_limit", F.greatest(F.lit(1), F.floor(clip * F.col("area") / 256)))
    clipped = F.transform("n", lambda e: F.least(e["n"], F.col("_limit")))
    total = F.aggregate(clipped, F.lit(0).cast("long"), lambda a, c: a + c)
    words = [F.col(f"_w{j}") for j in range(4)]
    tiles = tiles.select("image_id", "ty", "tx", "area", ((F.col("area") - total) / 256.0).alias("excess"), clipped.alias("_n"), F.array(*words).alias("bits"), F.array(*[sum(map(F.bit_count, words[:j]), F.lit(0)) for j in range(4)]).alias("before"))
    # Clipped sums grow at levels that occur only: a level's is that of the last such level up to it; the spread excess adds the same to every level.
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("to"))
    sums = F.aggregate("_n", start, lambda a, c: F.struct((a["sum"] + c).alias("sum"), F.concat(a["to"], F.array(a["sum"] + c)).alias("to")), lambda a: a["to"])
    tables = tiles.select("image_id", "ty", "tx", F.struct("bits", "before", sums.alias("sums"), "excess", "area").alias("table"))
    tables = tables.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct((F.col("ty") * grid + F.col("tx")).cast("int"), "table"))).alias("_tables"))
    df = join_back(df, tables, settle=settle)
    up_to = F.expr("shiftrightunsigned(-1L, 63 - (_bin & 63))")  # bits of the levels of a word up to the pixel's

    def looked_up(t: Column) -> Column:
        word = F.expr("shiftright(_bin, 6)")
        rank = t["before"][word] + F.bit_count(t["bits"][word].bitwiseAND(up_to))
        below = F.when(rank == 0, F.lit(0).cast("long")).otherwise(t["sums"][rank - 1])
        return (below + t["excess"] * (F.col("_bin") + 1)) * 255.0 / t["area"]

    def taps(axis: str, size: str, full: str) -> list[tuple[Column, Column]]:
        f = (F.col(axis) + 0.5) / F.col(size) - 0.5
        i, last = F.floor(f), F.ceil(F.col(full) / F.col(size)) - 1
        near = lambda k: F.least(F.greatest(k, F.lit(0)), last)
        return [(near(i), 1.0 - (f - i)), (near(i + 1), f - i)]

    corners = [(a * b, ty * grid + tx) for ty, a in taps("y", "_th", "h") for tx, b in taps("x", "_tw", "w")]
    # One expression for all four: written out four times, the generated method is longer than what the JVM compiles.
    four = F.array(*[F.struct(share.alias("share"), F.element_at(F.col("_tables"), at.cast("int")).alias("table")) for share, at in corners])
    mixed = F.aggregate(four, F.lit(0.0), lambda a, c: a + c["share"] * looked_up(c["table"]))
    return df.withColumn(value, mixed).drop("h", "w", "_th", "_tw", "_bin", "_tables")


#: Colours of a mosaic's four phases (y % 2, x % 2) by the pattern's name.
PATTERNS = ("RGGB", "BGGR", "GRBG", "GBRG")


def demosaic(df: DataFrame, value: str = "v", pattern: str = "RGGB", edge_aware: bool = False) -> DataFrame:
    """(image_id, y, x, r, g, b): a pixel's missing colours are the mean of those within 3 x 3.

    edge_aware: green at a red or blue place is the mean along the direction in which its two green
    neighbours differ less, of all four where both differ alike.
    """
    if pattern.upper() not in PATTERNS:
        raise ValueError(f"unknown mosaic pattern: {pattern}")
    names = [c.lower() for c in pattern.upper()]
    phase = (F.col("y") % 2 * 2 + F.col("x") % 2).cast("int")
    colour = F.array(*map(F.lit, names))[phase]
    own = F.struct(colour.alias("c"), F.col(value).alias("v"))
    left, right = _sides(F.col("_own"), "y", "x")
    df = df.select(*KEYS, own.alias("_own")).withColumn("_row", F.array(left, F.col("_own"), right))
    up, down = _sides(F.col("_row"), "x", "y")
    df, none = df.withColumns({"_up": up, "_down": down}), F.slice("_row", 1, 0)
    nine = F.filter(F.concat(F.coalesce("_up", none), F.col("_row"), F.coalesce("_down", none)), lambda p: p.isNotNull())

    def mean(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, p: a + p["v"]) / F.size(values)

    def pick(c: str) -> Column:
        around = mean(F.filter(nine, lambda p: p["c"] == c))
        if c == "g" and edge_aware:
            sides = (F.col("_row")[0]["v"], F.col("_row")[2]["v"], F.col("_up")[1]["v"], F.col("_down")[1]["v"])
            across, along = F.round(F.abs(sides[0] - sides[1]), 9), F.round(F.abs(sides[2] - sides[3]), 9)
            around = F.when(across < along, (sides[0] + sides[1]) / 2).when(along < across, (sides[2] + sides[3]) / 2).otherwise(around)
        return F.when(F.col("_own.c") == c, F.col("_own.v")).otherwise(around).alias(c)

    return df.select(*KEYS, pick("r"), pick("g"), pick("b"))


def regions(df: DataFrame, mask: str, block: int = 256) -> DataFrame:
    """(image_id, y, x, region): the mask's pixels with a number that is the same for all that touch (8 neighbours).

    Each line's runs are found with window frames. Runs are linked within blocks of lines, a block with the first
    line of the next one, where both blocks' numbers of a run meet; components of those meetings join the blocks.
    A task holds the runs of one block, an image is spread over as many tasks as it has blocks.
    """
    line = W.partitionBy("image_id", "y").orderBy("x")
    on = df.where(F.col(mask)).select(*KEYS)
    on = on.withColumn("_new", (F.col("x") - F.lag("x", 1, -2).over(line) > 1).cast("int"))
    on = on.withColumn("run", F.sum("_new").over(line))
    runs = on.groupBy("image_id", "y", "run").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    own = F.floor(F.col("y") / block)
    runs = runs.withColumn("block", F.explode(F.when((F.col("y") % block == 0) & (F.col("y") > 0), F.array(own, own - 1)).otherwise(F.array(own))))
    kinds = ", ".join(f"{n} {on.schema[n].dataType.simpleString()}" for n in ("image_id", "y", "run"))
    dealt = runs.repartition("image_id", "block").sortWithinPartitions("image_id", "block", "y", "x0")
    found = settled(dealt.select("image_id", "y", "run", "block", "x0", "x1").mapInArrow(_linked, f"{kinds}, block long, part long"))
    node = F.struct("image_id", "part")
    inside = found.where(own == F.col("block")).select(*[F.col(c).alias(f"f_{c}") for c in ("image_id", "y", "run")], "part", node.alias("b"))
    lent = found.where(own > F.col("block")).select("image_id", "y", "run", node.alias("a"))
    met = (F.col("image_id") == F.col("f_image_id")) & (F.col("y") == F.col("f_y")) & (F.col("run") == F.col("f_run"))
    whole = components(lent.join(inside, met).select("a", "b"))
    both = on.join(inside, met).join(whole, F.col("b") == F.col("node"), "left")
    return both.select(*KEYS, F.coalesce(F.col("component.part"), F.col("part")).alias("region"))


def _linked(batches: Iterator) -> Iterator:
    """Numbers of each block's runs, equal for runs that touch over any number of others; no other block has the same."""
    import pyarrow as pa

    def numbers(runs: list[tuple]) -> list[int]:
        above = list(range(len(runs)))

        def root(i: int) -> int:
            while above[i] != i:
                above[i] = above[above[i]]
                i = above[i]
            return i

        j = 0
        for i, (y, _, x0, x1) in enumerate(runs):
            while runs[j][0] < y - 1 or runs[j][0] == y - 1 and runs[j][3] < x0 - 1:
                j += 1  # ends left of all later runs of this line too
            k = j
            while runs[k][0] == y - 1 and runs[k][2] <= x1 + 1:
                a, b = sorted((root(i), root(k)))
                above[b] = a
                k += 1
        return [(runs[r][0] << 32) | runs[r][1] for r in map(root, range(len(runs)))]

    kinds, at, held = None, None, []

    def made() -> pa.RecordBatch:
        ys, names = [r[0] for r in held], [r[1] for r in held]
        n = len(held)
        cols = [[at[0]] * n, ys, names, [at[1]] * n, numbers(held)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["image_id", "y", "run", "block", "part"])

    for b in batches:
        kinds = kinds or [*(b.schema.field(n).type for n in ("image_id", "y", "run", "block")), pa.int64()]
        for image, y, run, block, x0, x1 in zip(*(b.column(c).to_pylist() for c in ("image_id", "y", "run", "block", "x0", "x1")), strict=True):
            if (image, block) != at:
                if held:
                    yield made()
                at, held = (image, block), []
            held.append((y, run, x0, x1))
    if held:
        yield made()


def edge_connected(df: DataFrame, mask: str, block: int = 256) -> DataFrame:
    """Pixels of the mask that reach the image's edge over the 8 neighbours."""
    df = settled(join_back(regions(df, mask, block), sizes(df), settle=True))
    edge = F.col("y").isin(0) | F.col("x").isin(0) | (F.col("y") == F.col("h") - 1) | (F.col("x") == F.col("w") - 1)
    reach = df.groupBy(F.col("image_id").alias("_k"), F.col("region").alias("_r")).agg(F.max(edge).alias("connected"))
    return df.join(reach, (F.col("image_id") == F.col("_k")) & (F.col("region") == F.col("_r"))).drop("h", "w", "region", "_k", "_r")
