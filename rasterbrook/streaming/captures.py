"""Captures processed as they arrive: each batch once, only where its calibration is complete, and not for ever."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: What a session's calibration consists of, and the seconds that a batch may take.
CALIBRATION, SECONDS = ("flat", "base", "layout"), 300.0


def ready(captures: DataFrame, calibration: DataFrame, needed: tuple[str, ...] = CALIBRATION) -> DataFrame:
    """captures (session, ...) with status: ready where the session has every kind of calibration file, else skipped.

    calibration: (session, kind), a row per file; a join of the stream's rows with a listing as it is now.
    """
    kinds = calibration.where(F.col("kind").isin(*needed)).groupBy(F.col("session").alias("_s")).agg(F.count_distinct("kind").alias("_n"))
    whole = kinds.where(F.col("_n") == len(needed)).select("_s")
    joined = captures.join(whole, F.col("session") == F.col("_s"), "left")
    return joined.withColumn("status", F.when(F.col("_s").isNotNull(), "ready").otherwise("skipped")).drop("_s")


def run_batch(batch: DataFrame, batch_id: int, calibration: DataFrame, process: Callable[[DataFrame], DataFrame], folder: str, seconds: float = SECONDS) -> str:
    """Writes what becomes of a batch to folder/batch=<id>: done, skipped or timed out; gives the status of its ready captures.

    process(ready captures) gives rows (capture, ...) of results, written to folder/results/batch=<id>. Both are
    overwritten, so a batch that is run again after a failure leaves its rows once. What takes longer than `seconds`
    is cancelled on the cluster, leaves no results, and its captures are told as timed out.
    """
    spark = batch.sparkSession
    told = ready(batch, calibration)
    group, late = f"captures-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    outcome = "done"
    try:
        spark.sparkContext.setJobGroup(group, f"captures of batch {batch_id}", interruptOnCancel=True)
        timer.start()
        process(told.where("status = 'ready'").drop("status")).write.mode("overwrite").parquet(f"{folder}/results/batch={batch_id}")
    except Exception:
        if not late.is_set():
            raise
        outcome = "timed out"
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    if outcome == "timed out":
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/results/batch={batch_id}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    status = F.when(F.col("status") == "ready", outcome).otherwise(F.col("status"))
    told.select("capture", "session", status.alias("status")).write.mode("overwrite").parquet(f"{folder}/status/batch={batch_id}")
    return outcome


def process_captures(captures: DataFrame, calibration: Callable[[], DataFrame], process: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, seconds: float = SECONDS, **trigger) -> StreamingQuery:
    """Starts the stream captures (capture, session, ...) through run_batch(); calibration() is listed anew for each batch."""
    writer = captures.writeStream.foreachBatch(lambda df, i: run_batch(df, i, calibration(), process, folder, seconds) and None)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "0 seconds"})).start()
