"""The corpus pipeline: quality rules, near-copies, repeated strings, benchmark passages, mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's result as
Parquet and hands the reread table to the next. All but the last return the columns of documents.
Columns beyond those of documents are dropped at the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterbrook.llm.common import bounded, table, text_key, without, written
from rasterbrook.llm.decontaminate import leaking_texts
from rasterbrook.llm.jaccard import jaccard_groups, superfluous
from rasterbrook.llm.mixing import mix
from rasterbrook.llm.quality import quality_rules
from rasterbrook.llm.suffix_dedup import suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep, whatever other rows of their doc_id get. The verdict travels with the row."""
    judged = quality_rules(docs, carry=COLUMNS).where("kept")
    return judged.select([F.col(f"carried_{c}").alias(c) for c in COLUMNS])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each linked group: that with the smallest doc_id, rows without an id only where none has one.

    Different texts of one id are rows of their own. Rows without words are linked with nothing and stay.
    """
    docs = docs.select(COLUMNS)
    groups = written(jaccard_groups(docs), "pipeline-groups")
    out = without(docs, superfluous(groups))
    # Rows that repeat a representative, text and all: one of them stays. Only these are shuffled.
    again = groups.where("group is not null").groupBy("doc_id", "text_key").count().where("count > 1")
    again = written(again.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")), "pipeline-again")
    if again.isEmpty():
        return out
    is_again = out["doc_id"].eqNullSafe(again["_id"]) & (text_key() == again["_key"])
    once = out.join(bounded(again), is_again, "left_semi").withColumn("_key", text_key()).dropDuplicates(["doc_id", "_key"])
    return out.join(bounded(again), is_again, "left_anti").unionByName(once.drop("_key"))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of long strings that occur elsewhere; a character cut apart goes whole. Every row stays.

    A null text comes back empty.
    """
    out = suffix_dedup(docs.select(COLUMNS), carry=["lang", "source"])
    return out.withColumns({"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}).select(COLUMNS)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark, whatever other rows of their doc_id hold."""
    docs = docs.select(COLUMNS)
    return without(docs, leaking_texts(docs, table(spark, sf_dir, "benchmark")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its place in the mixture of sources."""
    return mix(docs.select(COLUMNS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeated_strings),
    ("benchmark decontamination", benchmark_passages),
    ("mixing sources", mixture),
]

#: Stages 1, 2, 3 and 5 can't be told in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "pipeline")
    return docs
