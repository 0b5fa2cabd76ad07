"""Job progress and states: as tables over batches, and as Structured Streaming queries with state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = "PROGRESS:"


def progress(line: Column) -> Column:
    """The JSON of a progress line, null for other lines."""
    return F.when(line.startswith(PREFIX), F.substring(line, len(PREFIX) + 1, (1 << 31) - 1))


def progress_log(lines: DataFrame, key: str, ordinal: str, line: str) -> DataFrame:
    """(job_id, ordinal, k): a row per progress line, the value null where it isn't a number; other lines are skipped."""
    k = F.get_json_object(progress(F.col(line)), "$.k").try_cast("long")
    return lines.where(progress(F.col(line)).isNotNull()).select(F.col(key).alias("job_id"), F.col(ordinal).alias("ordinal"), k.alias("k"))


def progress_table(lines: DataFrame, key: str, ordinal: str, line: str) -> DataFrame:
    """Per job the last value and the number of updates, combined before the shuffle; the log stays rows."""
    return progress_log(lines, key, ordinal, line).groupBy("job_id").agg(F.max_by("k", "ordinal").alias("last_k"), F.count("*").alias("updates"))


def status(states: DataFrame, asked: DataFrame) -> DataFrame:
    """State of each asked job, not_found where there is none."""
    return asked.join(states, "job_id", "left").select("job_id", F.coalesce("state", F.lit("not_found")).alias("state"))


def latest(frames: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """The latest value of each key; on a stream, with the update or complete output mode."""
    return frames.groupBy(key).agg(F.max_by(value, ts).alias(value), F.max(ts).alias(ts))


def accepted_edges(events: DataFrame, key: str, gap_ms: int) -> DataFrame:
    """Streaming debounce of (key, ts): keeps each key's last accepted time as state."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def keep(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for ms in sorted(t for b in batches for t in b["ms"].tolist()):
            if last is None or ms - last > gap_ms:
                out.append(ms)
                last = ms
        state.update((last,))
        yield pd.DataFrame({key: [k[0]] * len(out), "ms": out})

    timed = events.select(key, F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    kind = timed.schema[key].dataType.simpleString()
    return timed.groupBy(key).applyInPandasWithState(keep, f"{key} {kind}, ms long", "last long", "append", GroupStateTimeout.NoTimeout)


def job_states(events: DataFrame) -> DataFrame:
    """Streaming job state machine over (job_id, event): emits the state after every batch with events of the job."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    moves = {("ready", "start"): "working", ("working", "done"): "ready", ("working", "fail"): "error"}

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else "ready"
        rows = sorted((r for b in batches for r in b[["ordinal", "event"]].itertuples(index=False)), key=lambda r: r[0])
        for _, event in rows:
            now = "ready" if event == "reset" else moves.get((now, event), now)
        state.update((now,))
        yield pd.DataFrame({"job_id": [k[0]], "state": [now]})

    return events.groupBy("job_id").applyInPandasWithState(step, "job_id long, state string", "state string", "update", GroupStateTimeout.NoTimeout)
