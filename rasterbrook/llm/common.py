"""What the corpus operators share: reading tables, shared scratch tables, links to components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="rasterbrook-")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. A local master, as in tests, may go without: it gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.conf.get("spark.master", "")
    if master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder()


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: cuts lineage, survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more, in whatever store they lie."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a side that may be broadcast; a larger side is shuffled instead.
BROADCAST_ROWS = 500_000


def bounded(side: DataFrame) -> DataFrame:
    """The side with a broadcast hint where it has few enough rows; else as it is, for a shuffled join.

    For sides of short rows: row by row they stay within a few hundred bytes.
    """
    return F.broadcast(side) if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else side


def bounded_bytes(side: DataFrame, size: Column, most: int = 64 << 20) -> DataFrame:
    """Like bounded(), for rows of any length: size is a row's bytes, and both rows and bytes are counted."""
    n, total = side.agg(F.count("*"), F.sum(size.cast("long"))).first()
    return F.broadcast(side) if n <= BROADCAST_ROWS and (total or 0) <= most else side


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a piece has few bytes of text or one row: bounds what Python holds at a time."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and held + n > most:
                yield b.slice(start, i - start)
                start, held = i, 0
            held += n
        yield b.slice(start)


def text_key(text: str = "text") -> Column:
    """Tells texts of one doc_id apart; null and empty are told apart too."""
    return F.when(F.col(text).isNull(), F.lit(-1)).otherwise(F.xxhash64(text))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of docs whose (doc_id, text_key) isn't in gone; null ids are ids. Other rows of one doc_id stay."""
    gone = gone.select(F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_key")).distinct()
    gone = bounded(written(gone, "gone"))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone_id"]) & (text_key() == gone["_gone_key"]), "left_anti")


#: Rows of one value beyond which they are spread over more tasks than one; found in one of so many rows, which only deals out the work.
HOT_ROWS, SAMPLE = 2048, 64


def hot_values(sample: DataFrame, value: str, name: str) -> DataFrame:
    """The values (hot_<value>) that a sample of one in SAMPLE rows shows to be very frequent; few, and counted before a broadcast.

    One value more, the smallest long, is always there, so that plans are alike at every size.
    """
    hot = sample.groupBy(value).count().where(F.col("count") >= HOT_ROWS // SAMPLE).select(F.col(value).alias(f"hot_{value}"))
    one = sample.sparkSession.range(1).select(F.lit(-(1 << 63)).cast("long").alias(f"hot_{value}"))
    return bounded(written(hot.unionByName(one).distinct(), f"{name}-hot"))


def repeated(rows: DataFrame, value: str, one_of: Column, name: str) -> DataFrame:
    """Rows whose value two rows or more have, with their number as df (a very large one for very frequent values).

    One shuffle by the value instead of a count that is joined back. one_of marks the sample that tells
    very frequent values; their rows need no count and are spread.
    """
    hot = F.col(f"hot_{value}").isNotNull()
    split = rows.join(hot_values(rows.where(one_of), value, name), F.col(value) == F.col(f"hot_{value}"), "left")
    split = split.withColumn("salt", F.when(hot, F.pmod(F.hash(*rows.columns), F.lit(256))).otherwise(-1))
    same = F.count("*").over(W.partitionBy(value, "salt"))
    return split.withColumn("df", F.when(hot, F.lit(1 << 40)).otherwise(same)).where("df > 1").drop("salt", f"hot_{value}")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component): component is the smallest node reachable over edges (a, b).

    Large-star and small-star steps alternate until nothing changes; each step is a grouped
    minimum (combined before the shuffle) joined back to the edges, so a node with very many
    neighbours isn't gathered anywhere. Every round is written to the shared folder, the one before it deleted.
    Nodes without an edge to another node aren't returned.
    """
    pairs = edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).where("a > b").distinct()
    pairs = written(pairs, f"{name}-edges")
    seen = None
    while not pairs.isEmpty():
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select("a", F.col("m").alias("b"))).where("a > b").distinct()
        before, pairs = pairs, written(small, f"{name}-round")
        discard(before)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
