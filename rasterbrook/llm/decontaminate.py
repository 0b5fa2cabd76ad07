"""Benchmark decontamination: spaced seeds join texts and items, overlaps around hits are verified. No Python on the executors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, bounded_bytes, discard, text_key, written

#: One of these lies intact in 13 tokens of which any two were substituted.
WIDE = ("1110100101", "1001110011")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def hashed(text: Column) -> Column:
    return F.transform(tokens(text), lambda w: F.xxhash64(w))


def masks(compared: int, share: float) -> tuple[str, ...]:
    """Masks of which one lies intact in so many neighbouring tokens, wherever those stand that the share lets differ."""
    changed = max(c for c in range(compared + 1) if c == 0 or compared - c >= share * compared)
    if compared >= 13 and changed <= 2:
        return WIDE
    return ("1" * max(1, -(-(compared - changed) // (changed + 1))),)  # the longest run between changed tokens


def seeds(rows: DataFrame, keys: list[str], used: list[str]) -> DataFrame:
    """keys, pos, seed: each used mask's hash at each token position. rows has a column h of token hashes."""
    parts = []
    for span in sorted({len(m) for m in used}):
        n = F.size("h") - (span - 1)
        shifted = [F.slice("h", i + 1, n).alias(f"t{i}") for i in range(span)]
        each = rows.where(F.size("h") >= span).select(*keys, F.posexplode(F.arrays_zip(*shifted)))
        looked = [
            F.xxhash64(F.lit(m), *[F.col(f"col.t{i}") for i, c in enumerate(m) if c == "1"]) for m in used if len(m) == span
        ]
        parts.append(each.select(*keys, "pos", F.explode(F.array(*looked)).alias("seed")))
    return reduce(DataFrame.unionByName, parts)


def leaking_texts(docs: DataFrame, items: DataFrame, window: int = 13, share: float = 0.8) -> DataFrame:
    """Like leaks(), a row for each text (text_key) of an id."""
    return _leaks(docs, items, window, share, ["doc_id", "text_key"])


def leaks(docs: DataFrame, items: DataFrame, window: int = 13, share: float = 0.8) -> DataFrame:
    """(doc_id, item_id, matched, compared, position): which texts hold a passage of which item.

    docs: (doc_id, text), items: (item_id, text). Tokens are lower-cased runs of letters and digits.
    A seed that both sides have puts the item against the text without shifts; there, `compared`
    neighbouring tokens (window, or the whole of a shorter item) must agree in at least the given
    share, so single words may be substituted; every such stretch has a seed. The best stretch of each
    pair is returned; position is the text token that the item's first token would lie on. Shorter
    items have shorter seeds; those without tokens aren't searched. Null or empty texts hold nothing; null ids are ids of their own;
    repeated rows give one row.
    """
    return _leaks(docs, items, window, share, ["doc_id"])


def _leaks(docs: DataFrame, items: DataFrame, window: int, share: float, by: list[str]) -> DataFrame:
    own = docs.select("doc_id", text_key().alias("text_key"), "text").where("text is not null")
    bench = items.select("item_id", hashed(F.col("text")).alias("h")).where(F.size("h") > 0).distinct()
    keyed = bench.withColumn("item_key", F.xxhash64("item_id", "h")).withColumn("item_n", F.size("h"))
    lengths = [r[0] for r in keyed.select(F.least(F.lit(window), "item_n")).distinct().collect()]  # window at most
    by_mask: dict[tuple[str, ...], list[int]] = {}
    for n in sorted(lengths) or [window]:
        by_mask.setdefault(masks(n, share), []).append(n)
    each = [seeds(keyed.where(F.least(F.lit(window), "item_n").isin(ns)), ["item_key", "item_n"], list(m)) for m, ns in by_mask.items()]
    item_seeds = written(reduce(DataFrame.unionByName, each), "leak-seeds")
    wanted = item_seeds.select("item_key", "item_n", F.col("pos").alias("item_pos"), F.col("seed").alias("item_seed"))
    used = sorted({m for ms in by_mask for m in ms})
    made = seeds(own.select("doc_id", "text_key", hashed(F.col("text")).alias("h")), ["doc_id", "text_key"], used)
    hits = made.join(bounded(wanted), F.col("seed") == F.col("item_seed"))
    hits = hits.select("doc_id", "text_key", "item_key", "item_n", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct()
    hits = written(hits, "leak-hits")
    discard(item_seeds)

    bench = bench.withColumn("b_key", F.xxhash64("item_id", "h")).select("b_key", "item_id", F.col("h").alias("item_h"))
    per_text = hits.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("item_key", "item_n", "shift")).alias("hits"))
    per_text = written(per_text.select(F.col("doc_id").alias("h_id"), F.col("text_key").alias("h_key"), "hits"), "leak-texts")
    found = own.join(bounded_bytes(per_text, 24 * F.size("hits")), F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("text_key") == F.col("h_key")))
    found = found.select("doc_id", "text_key", hashed(F.col("text")).alias("h"), F.explode("hits").alias("hit"))
    # What the text has where the item's tokens would lie; null beyond its ends.
    from_ = F.greatest(F.col("hit.shift"), F.lit(0))
    found = found.select("doc_id", "text_key", "hit.*", from_.alias("start"), F.slice("h", from_ + 1, F.col("hit.item_n")).alias("there"))
    both = found.join(bounded_bytes(bench, 8 * F.size("item_h")), F.col("item_key") == F.col("b_key"))
    both = both.withColumn("here", F.slice("item_h", F.col("start") - F.col("shift") + 1, F.size("item_h")))
    same = F.zip_with("here", "there", lambda a, b: F.when(a == b, 1).otherwise(0))
    both = both.withColumn("same", F.slice(same, 1, F.least(F.size("here"), F.size("there"))))
    both = both.withColumn("compared", F.least(F.lit(window), F.size("item_h"))).where("size(same) >= compared")
    sums = F.expr("transform(sequence(1, size(same) - compared + 1), i -> aggregate(slice(same, i, compared), 0, (a, x) -> a + x))")
    both = both.withColumn("matched", F.array_max(sums)).where(F.col("matched") >= F.lit(share) * F.col("compared"))
    best = F.max(F.struct("matched", "compared", (-F.col("shift")).alias("back"))).alias("best")
    return both.groupBy(*by, "item_id").agg(best).select(
        *by, "item_id", F.col("best.matched").cast("long").alias("matched"),
        F.col("best.compared").cast("long").alias("compared"), (-F.col("best.back")).cast("long").alias("position"),
    )
