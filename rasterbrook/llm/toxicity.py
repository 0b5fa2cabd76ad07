"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces

#: Letters keep their case-folded byte, other ASCII becomes a word border, bytes of other letters stay.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 256)
_FOLD[ord("0") : ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)
_FOLD[ord("a") : ord("z") + 1] = _FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)

GRAMS = (3, 4, 5, 6)


def subwords(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of the words, word borders included: bucket and start of each."""
    data = np.concatenate(([32], _FOLD[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)], [32])).astype(np.uint64)
    space = np.concatenate(([0], np.cumsum(data == 32)))
    ids, at = [], []
    for n in GRAMS:
        m = len(data) - n + 1
        if m < 1:
            break
        ok = np.flatnonzero(space[n - 1 : n - 1 + m] == space[1 : 1 + m])  # no border inside
        h = np.full(len(ok), n, np.uint64)
        for j in range(n):
            h = (h ^ data[ok + j]) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(29)
        ids.append((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits))
        at.append(ok)
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(ids).astype(np.int64), np.concatenate(at)


def train(rows: list[tuple[str, int]], bits: int = 17, dims: int = 8, epochs: int = 10, rate: float = 1.0, seed: int = 7) -> tuple[np.ndarray, float]:
    """Fits embeddings and softmax together (adaptive gradient steps, one text at a time).

    Returns the logit of label 1 against 0 that each bucket gives, and the bias: both layers are
    linear, so a text's logit is the mean over its subwords plus the bias.
    """
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / dims, 1 / dims, (1 << bits, dims)).astype(np.float32)
    out, bias = np.zeros((dims, 2), np.float32), np.zeros(2, np.float32)
    out[:, 1] = rng.uniform(-1, 1, dims)
    out[:, 0] = -out[:, 1]
    sum_emb, sum_out, sum_bias = np.full(1 << bits, 1e-8, np.float32), np.full_like(out, 1e-2), 1.0
    bags = []
    for text, label in rows:
        ids, _ = subwords(text, bits)
        ids, n = np.unique(ids, return_counts=True)
        bags.append((ids.astype(np.int32), (n / max(1, n.sum())).astype(np.float32), label))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in rng.permutation(len(bags)):
            ids, share, label = bags[k]
            hidden = share @ emb[ids]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            err = p / p.sum()
            err[label] -= 1
            back = out @ err
            grad = np.outer(hidden, err)
            sum_out += grad**2
            sum_bias += float(err @ err)
            sum_emb[ids] += share**2 * float(back @ back) / dims
            emb[ids] -= step * np.outer(share / np.sqrt(sum_emb[ids]), back)
            out -= step * grad / np.sqrt(sum_out)
            bias -= step * err / np.sqrt(sum_bias)
    return emb @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 4000, bits: int = 17, most_chars: int = 20_000) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of docs (doc_id, text).

    labels: (doc_id, toxic). The model is fitted on at most per_class labelled texts of each class,
    the first by a hash of doc_id (the bias is then set to the classes' shares among all labels), none of them held out (crc32 of the id's text divisible by 5;
    a null id is held out), one text of an id, none of more than most_chars characters: that sample, so
    bounded in rows and bytes, goes to the driver, its ids are broadcast. Every whole text, of any
    length, is then scored from the text alone. Null or empty text: the bias alone. Without
    labelled texts of both classes every score is 0. Other columns are ignored.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    pick = lambda k: known.where(F.col("toxic") == k).groupBy("doc_id").agg(F.max("toxic").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    chosen = pick(0).unionByName(pick(1)).select(F.col("doc_id").alias("label_id"), "label")
    texts = docs.select("doc_id", "text").where(F.length("text") <= most_chars)
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    rows = rows.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # of texts that share an id, one
    got = sorted(rows.select("doc_id", "text", "label").collect())
    model = None
    if len({r.label for r in got}) == 2:
        weight, bias = train([(r.text, int(r.label)) for r in got], bits)
        share = {r[0]: r[1] for r in known.groupBy(F.col("toxic").cast("int")).count().collect()}
        fitted = sum(int(r.label) for r in got)
        prior = np.log(share[1] / share[0]) - np.log(fitted / (len(got) - fitted))
        model = spark.sparkContext.broadcast((weight, bias + float(prior)))
    del got

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = model.value if model else (None, 0.0)
        for b in pieces(batches, "text"):
            z = np.full(b.num_rows, bias)
            for i, x in enumerate(b.column("text")):
                if weight is not None and len(ids := subwords(x.as_py(), bits)[0]):
                    z[i] += weight[ids].mean(dtype=np.float64)
            p = 1 / (1 + np.exp(-np.clip(z, -60, 60))) if weight is not None else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    whole = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(held_out(F.col("doc_id")), F.lit(True)).alias("held_out"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    return whole.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
