"""Mixing sources to target weights: Pfair windows per block, earliest deadline first. No Python on the executors."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import count
from math import isfinite, lcm

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bounded, written


def schedule(weights: Mapping[str, float], blocks: Mapping[str, int]) -> Iterator[tuple[str, int, int, int, int, int]]:
    """(source, block, release, deadline, slot, phase): each source's blocks in the slots of a Pfair schedule.

    With w a source's share of all weights, as an exact fraction, its block i (from 0) may run in slots
    floor(i / w) to ceil((i + 1) / w) - 1. Of the released blocks, the earliest deadline runs. The shares
    add up to one, so a slot is never empty, no deadline is missed, and each source's count stays
    within one block of w times the slots, however many there are. When the next block would be that
    of a source that has none left, a phase ends: sources without blocks leave, and the others go
    on by their shares of what weight is left, from that slot on.
    """
    if any(not isfinite(w) or w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive numbers")
    exact = {s: Fraction(w) for s, w in weights.items()}
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    start = phase = 0
    while left:
        scale = lcm(*(exact[s].denominator for s in left))
        part = {s: int(exact[s] * scale) for s in left}
        total = sum(part.values())
        coming = [(0, s, 0) for s in sorted(left)]
        ready: list[tuple[int, str, int, int]] = []
        for slot in count():
            while coming and coming[0][0] <= slot:
                release, s, i = heapq.heappop(coming)
                heapq.heappush(ready, (-(-(i + 1) * total // part[s]), s, i, release))
            deadline, s, i, release = heapq.heappop(ready)
            if not left[s]:
                break
            yield s, done[s], start + release, start + deadline, start + slot, phase
            done[s] += 1
            left[s] -= 1
            heapq.heappush(coming, ((i + 1) * total // part[s], s, i + 1))
        left = {s: n for s, n in left.items() if n}
        start, phase = start + slot, phase + 1


def _key(source: str | None) -> str:
    """A source as a key: a null one and an empty one are two."""
    return "" if source is None else f"={source}"


def mix(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    power: float = 0.5,
    block: int = 16,
    most_blocks: int = 100_000,
    bucket_rows: int = 2_000,
) -> DataFrame:
    """Adds block_no, release, deadline, slot, position and in_mix to every row of docs (doc_id, source).

    A source's rows are put in the order of a hash of the row and cut into blocks; blocks get the slots
    of the Pfair schedule. position = slot * rows of a block + place in the block: sorted by it, the
    rows are the mixture. in_mix marks the slots before the first source runs dry, in which each
    source's count of blocks is less than one from its target; the rows behind them stay, mixed by
    the weights of the sources that are left.
    weights: by source (None: the null source); without any, each source's row count to the given
    power. Sources without a given weight aren't in the mixture: no slot, in_mix false. Null and empty
    sources are two sources, null and repeated ids and repeated rows are rows like others. Columns of docs named like
    the added ones are replaced. A block has `block` rows, or more where there would be over most_blocks (and a
    block for each source): the driver holds the sources' counts and the schedule, a few MB at any size of docs.
    """
    names = ["block_no", "release", "deadline", "slot", "position", "in_mix"]
    spark, cols = docs.sparkSession, [c for c in docs.columns if c not in names]
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    order = F.md5(F.concat_ws(" ", F.col("doc_id").cast("string"), F.xxhash64(*cols).cast("string")))
    rows = docs.select(*cols, key.alias("_mix_s"), order.alias("_mix_o"))
    per = written(rows.groupBy(F.col("_mix_s").alias("c_s")).count(), "mix-counts")
    if weights is not None:
        weights = {_key(s): w for s, w in weights.items()}
        wanted = per.join(bounded(spark.createDataFrame([(s,) for s in weights], "c_s string")), "c_s", "left_semi")
        counts = {r[0]: r[1] for r in wanted.collect()}
    else:
        counts = {r[0]: r[1] for r in per.collect()}
        weights = {s: n**power for s, n in counts.items()}
    block = max(block, -(-sum(counts.values()) // most_blocks))
    plan = list(schedule(weights, {s: -(-n // block) for s, n in counts.items()}))
    # The mixture ends at a source's first block that isn't full, or with the first phase.
    dry = min([t for s, i, _, _, t, phase in plan if phase or (i + 1) * block > counts[s]], default=len(plan))
    plan = spark.createDataFrame([x[:5] for x in plan], "p_s string, p_no long, release long, deadline long, slot long")

    # Ranks without a window over a whole source: the hash order is cut into buckets of bounded size.
    cuts = per.select("c_s", F.ceil(F.col("count") / bucket_rows).alias("_mix_cuts"))
    rows = rows.join(bounded(cuts), F.col("_mix_s") == F.col("c_s")).drop("c_s")
    head = F.conv(F.substring("_mix_o", 1, 7), 16, 10).cast("long")
    rows = rows.withColumn("_mix_b", F.floor(head * F.col("_mix_cuts") / F.lit(1 << 28)))
    sizes = rows.groupBy("_mix_s", "_mix_b").count()
    before = F.sum("count").over(W.partitionBy("_mix_s").orderBy("_mix_b").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select(F.col("_mix_s").alias("z_s"), F.col("_mix_b").alias("z_b"), F.coalesce(before, F.lit(0)).alias("z_before"))
    place = F.row_number().over(W.partitionBy("_mix_s", "_mix_b").orderBy("_mix_o"))
    ranked = rows.withColumn("_mix_n", place).join(sizes, (F.col("_mix_s") == F.col("z_s")) & (F.col("_mix_b") == F.col("z_b")))
    ranked = ranked.withColumn("_mix_r", F.col("z_before") + F.col("_mix_n") - 1)
    ranked = ranked.withColumn("block_no", F.floor(F.col("_mix_r") / block))
    out = ranked.join(bounded(plan), (F.col("_mix_s") == F.col("p_s")) & (F.col("block_no") == F.col("p_no")), "left")
    return out.select(
        *cols, "block_no", "release", "deadline", "slot",
        (F.col("slot") * block + F.col("_mix_r") % block).alias("position"),
        F.coalesce(F.col("slot") < dry, F.lit(False)).alias("in_mix"),
    )
