"""Small tables that several steps of one pipeline read: written once to the shared folder, read again."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="rasterbrook-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; only a local master may go without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.conf.get("spark.master", "").split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own_folder()
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The same rows as a written table.

    A statistic that a chain of steps joins back would be planned again for each later step, its
    own inputs too: n steps read the pixels 2**n times. Settled, each statistic is one pass.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "settled")
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables of settled() that nothing reads any more, in whatever store they lie."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
