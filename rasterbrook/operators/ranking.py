"""Best rows, nearest choices, refinement loops, folds over ordered events."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def best_run(df: DataFrame, key: str = "job_id") -> DataFrame:
    """The iteration with the best score; of equal ones the earliest."""
    w = W.partitionBy(key).orderBy(F.col("score").desc_nulls_last(), "iteration")
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def first_by(df: DataFrame, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(1)


def nearest(value: Column, choices: list[int]) -> Column:
    """The nearest choice; of two as near the first."""
    return F.array_min(F.array(*[F.struct(F.abs(value - c).alias("d"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(choices)]))["c"]


def weakest(scores: dict[str, Column], below: float = 0.4) -> Column:
    """Name of the smallest score if it's below the limit; of equal ones the first."""
    low = F.array_min(F.array(*[F.struct(c.alias("s"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (n, c) in enumerate(scores.items())]))
    return F.when(low["s"] < below, low["n"])


def cast_of(devs: dict[str, Column], least: float = 0.05) -> Column:
    """Channel that deviates most, with its sign, if it deviates enough."""
    top = F.array_max(F.array(*[F.struct(F.abs(c).alias("d"), F.lit(-i).alias("i"), F.lit(n).alias("n"), c.alias("v")) for i, (n, c) in enumerate(devs.items())]))
    return F.when(top["d"] > least, F.concat(top["n"], F.when(top["v"] > 0, "+").otherwise("-"))).otherwise("none")


def refine(runs: DataFrame, most: int = 3, threshold: float = 0.75, key: str = "job_id") -> DataFrame:
    """Runs that a loop of at most `most` tries with an early exit would do, and which of them it selects."""
    w = W.partitionBy(key).orderBy("iteration")
    before = F.coalesce(F.max(F.when(F.col("score") >= threshold, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    done = runs.withColumn("_before", before).where((F.col("iteration") <= most) & (F.col("_before") == 0))
    top = done.groupBy(key).agg(F.count("*").alias("tries"))
    return best_run(done.drop("_before"), key).join(top, key).withColumn("passed", F.col("score") >= threshold)


def strength_search(df: DataFrame, candidates: list[float], score: Column, key: str = "image_id") -> DataFrame:
    """All candidate strengths in one pass (column `strength`), scored, the best kept; of equal ones the first."""
    tried = df.withColumn("_c", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(s)).alias("s")) for i, s in enumerate(candidates)])))
    tried = tried.select(*df.columns, F.col("_c.i").alias("iteration"), F.col("_c.s").alias("strength"))
    scored = tried.groupBy(key, "iteration", "strength").agg(score.alias("score"))
    return best_run(scored, key)


def next_strength(tried: Column, best: Column, suggested: Column, lo: float, hi: float, steps=(0.1, -0.1, 0.2, -0.2, 0.05, -0.05)) -> Column:
    """The suggestion, or else the nearest rung around the best strength, that hasn't been tried (to four places)."""
    clip = lambda c: F.round(F.least(F.greatest(c, F.lit(lo)), F.lit(hi)), 4)
    options = F.array(clip(suggested), *[clip(best + s) for s in steps])
    known = F.transform(tried, lambda t: F.round(t, 4))
    return F.coalesce(F.try_element_at(F.filter(options, lambda o: o.isNotNull() & ~F.array_contains(known, o)), F.lit(1)), clip(best))


def debounce(df: DataFrame, key: str, ts: str, gap_ms: int) -> DataFrame:
    """Events that come more than gap_ms after the last accepted one of their key (a greedy fold, not a difference of rows).

    An event more than the gap after its predecessor is accepted whatever came before, so keys are cut
    there and the stretches folded side by side, each in order with the last accepted time as its only
    state. Predecessors are found within spans of time, so that one key's events are spread. Null times are dropped.
    """
    gap = gap_ms * 1000
    span = 4096 * max(gap, 1)
    rows = df.select(F.col(key).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t")).where("t is not null")
    rows = rows.withColumn("b", F.floor(F.col("t") / span))

    def before(values: DataFrame, what: Column) -> DataFrame:
        """Per key and span, the last value of the spans before it."""
        ends = values.groupBy("k", "b").agg(F.max(what).alias("m"))
        earlier = F.last("m", ignorenulls=True).over(W.partitionBy("k").orderBy("b").rowsBetween(W.unboundedPreceding, -1))
        return ends.select(F.col("k").alias("e_k"), F.col("b").alias("e_b"), earlier.alias("earlier"))

    def joined(values: DataFrame, ends: DataFrame) -> DataFrame:
        return values.join(ends, F.col("k").eqNullSafe(F.col("e_k")) & (F.col("b") == F.col("e_b"))).drop("e_k", "e_b")

    order = W.partitionBy("k", "b").orderBy("t")
    rows = joined(rows, before(rows, F.col("t")))
    last = F.coalesce(F.lag("t").over(order), F.col("earlier"))
    rows = rows.withColumn("first", F.when(last.isNull() | (F.col("t") - last > gap), F.col("t"))).drop("earlier")
    rows = joined(rows, before(rows, F.col("first")))
    rows = rows.select("k", F.coalesce(F.max("first").over(order), F.col("earlier")).alias("stretch"), "t")
    ordered = rows.repartition("k", "stretch").sortWithinPartitions("k", "stretch", "t")

    def accept(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        at, accepted = None, 0
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i, (k, stretch, t) in enumerate(zip(*(b.column(c).to_pylist() for c in ("k", "stretch", "t")), strict=True)):
                if (k, stretch) != at or t - accepted > gap:
                    at, accepted, keep[i] = (k, stretch), t, True
            yield b.filter(pa.array(keep))

    kept = ordered.mapInArrow(accept, ordered.schema)
    return kept.select(F.col("k").alias(key), F.timestamp_micros("t").cast("timestamp_ntz").alias(ts))


#: What each event makes of the states ready, working and error (0, 1, 2); other events change nothing.
MOVES = {"start": (1, 1, 2), "done": (0, 0, 2), "fail": (0, 2, 2), "reset": (0, 0, 0)}
STATES = ("ready", "working", "error")


def fold_state(df: DataFrame, key: str, ordinal: str, event: str, moves: dict[str, tuple[int, ...]] = MOVES, states: tuple[str, ...] = STATES) -> DataFrame:
    """States after all events, from the first one on: with the defaults, start works only when ready, done and fail only
    while working, reset always. moves tells what each event makes of each state; other events change nothing.

    An event maps states to states, and such maps compose: ranges of (key, ordinal) are folded side by
    side in order, then a key's few ranges. A key with very many events is spread over ranges.
    """
    rows = df.select(F.col(key).alias("k"), F.col(ordinal).alias("o"), F.col(event).alias("e"))
    ordered = rows.repartitionByRange("k", "o").sortWithinPartitions("k", "o")
    kind = rows.schema["k"].dataType.simpleString()

    def fold(batches: Iterator) -> Iterator:
        import pyarrow as pa

        same = tuple(range(len(states)))
        at, made, n, part, out = None, same, 0, 0, []
        schema = None
        for b in batches:
            schema = schema or pa.schema([b.schema.field("k"), ("part", pa.int64()), ("n", pa.int64()), ("made", pa.list_(pa.int64()))])
            for k, e in zip(b.column("k").to_pylist(), b.column("e").to_pylist(), strict=True):
                if n and k != at:
                    out.append({"k": at, "part": part, "n": n, "made": list(made)})
                    made, n, part = same, 0, part + 1
                at, n = k, n + 1
                move = moves.get(e, same)
                made = tuple(move[s] for s in made)
            if len(out) > 5000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if n:
            out.append({"k": at, "part": part, "n": n, "made": list(made)})
            yield pa.RecordBatch.from_pylist(out, schema)

    folded = ordered.mapInArrow(fold, f"k {kind}, part long, n long, made array<long>")
    # Ranges are numbered in order, so a key's maps come in order of their partition.
    folded = folded.withColumn("p", F.spark_partition_id())
    maps = folded.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("p", "part", "made"))).alias("maps"), F.sum("n").alias("n"))
    state = F.aggregate("maps", F.lit(0).cast("long"), lambda s, m: m["made"][s.cast("int")])
    names = F.array(*map(F.lit, states))
    return maps.select(F.col("k").alias(key), names[state.cast("int")].alias("state"), F.col("n").cast("int").alias("n"))
