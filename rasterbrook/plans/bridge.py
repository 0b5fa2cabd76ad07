"""Views that make rasters of the driver's tables, in Spark and as SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and, where SQL can tell it, the SQL with the same rows."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Vectors whose pixels one task makes: with the table grow the tasks' number, not their size.
VECTORS = 4096


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Vectors dealt out by their image before they become pixels: a tenth of the bytes, and what goes by image later needs no further shuffle."""
    parts = df.count() // VECTORS + 1
    if parts < 16:
        return df.repartition(key)
    return df.repartition(max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)


def unit(e: Column) -> Column:
    """A vector's entry as a value 0..1."""
    return F.least(F.greatest(F.lit(0.5) + F.lit(2.0) * e.cast("double"), F.lit(0.0)), F.lit(1.0))


def patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each 64-value vector as an 8x8 plane (image_id, y, x, v), values 0..1."""
    e = dealt(table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("image_id"), "embedding"), "image_id")
    e = e.select("image_id", F.posexplode("embedding").alias("pos", "e"))
    return e.select("image_id", F.floor(F.col("pos") / 8).alias("y"), (F.col("pos") % 8).cast("long").alias("x"), unit(F.col("e")).alias("v"))


def plane8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in 8-bit steps, 0..255."""
    return patch(spark, sf_dir).withColumn("v", F.floor(F.col("v") * 255.0).cast("double"))


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three vectors as the channels of an image (image_id, y, x, r, g, b), values 0..1."""
    e = table(spark, sf_dir, "embeddings").where("embedding is not null")
    e = dealt(e.select(F.floor(F.col("vec_id").cast("long") / 3).alias("image_id"), (F.col("vec_id") % 3).alias("k"), "embedding"), "image_id")
    three = e.groupBy("image_id").agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("size"), *[F.collect_list(F.when(F.col("k") == k, F.col("embedding"))).alias(f"_{c}") for k, c in enumerate("rgb")])
    pixels = three.where("n = 3 and size > 0").withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))

    def channel(c: str) -> Column:
        """The vector's value; the largest one where an id comes twice."""
        return F.when(F.size(c) == 1, unit(F.get(F.get(c, F.lit(0)), "pos"))).otherwise(F.array_max(F.transform(c, lambda e: unit(F.get(e, F.col("pos"))))))

    return pixels.select("image_id", F.floor(F.col("pos") / 8).alias("y"), (F.col("pos") % 8).cast("long").alias("x"), *[channel(f"_{c}").alias(c) for c in "rgb"])


def rgb8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rgb(spark, sf_dir).withColumns({c: F.floor(F.col(c) * 255.0).cast("double") for c in "rgb"})


PATCH = """patch AS (SELECT vec_id::BIGINT AS image_id, ((i - 1) // 8)::BIGINT AS y, ((i - 1) % 8)::BIGINT AS x,
    least(greatest(0.5::DOUBLE + 2.0::DOUBLE * embedding[i]::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) AS v
    FROM embeddings, range(1, 65) t(i))"""
PLANE8 = PATCH + ", plane AS (SELECT image_id, y, x, floor(v * 255.0::DOUBLE) AS v FROM patch)"
RGB = PATCH + """, rgb AS (SELECT image_id // 3 AS image_id, y, x, max(v) FILTER (image_id % 3 = 0) AS r,
    max(v) FILTER (image_id % 3 = 1) AS g, max(v) FILTER (image_id % 3 = 2) AS b FROM patch GROUP BY 1, 2, 3 HAVING count(*) = 3)"""
RGB8 = RGB + """, rgb8 AS (SELECT image_id, y, x, floor(r * 255.0::DOUBLE) AS r, floor(g * 255.0::DOUBLE) AS g,
    floor(b * 255.0::DOUBLE) AS b FROM rgb)"""


def rounded(c: Column, places: int | None = None) -> Column:
    """Six places, and no negative zero: the same in both engines.

    With places, halves are told as the SQL does, on the scaled double (72.5 / 500 to two places is 0.14): where a later step compares the value.
    """
    if places is not None:
        return F.round(c * 10.0**places, 0) / 10.0**places
    return F.round(c.cast("double"), 6) + F.lit(0.0)


def out(df: DataFrame, keys: str = "image_id y x", **cols: Column) -> DataFrame:
    return df.select(*keys.split(), *[rounded(c).alias(n) for n, c in cols.items()])


def sql_out(frm: str, ctes: str, keys: str = "image_id y x", tail: str = "", **cols: str) -> str:
    """SELECT of rounded expressions. {c} in a value given as `each` stands for r, g and b in turn."""
    each = cols.pop("each", None)
    if each:
        cols = {c: each.replace("{c}", c) for c in "rgb"} | cols
    said = ", ".join(f"round(({e})::DOUBLE, 6) + 0.0 AS {n}" for n, e in cols.items())
    return f"WITH {ctes} SELECT {', '.join(keys.split())}, {said} FROM {frm} {tail}"
