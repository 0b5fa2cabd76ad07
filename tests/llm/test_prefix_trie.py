"""The conversation trie against one that is built node by node."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rasterbrook.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def sequences(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            m = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs[c].append(((turn is not None, turn or 0), role, m, text))
    convs = {c: [(role, text) for _, role, _, text in sorted(t)] for c, t in convs.items()}
    out = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = convs.get(base, [])[:h] + convs[c][h:]
    return out


def brute(rows):
    convs = sequences(rows)
    members, kids, ends = defaultdict(list), defaultdict(set), defaultdict(list)
    for c, s in convs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
            if d:
                kids[tuple(s[: d - 1])].add(tuple(s[:d]))
        ends[tuple(s)].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    return sorted(
        (min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest())
        for k, m in members.items()
    )


def made(df, **more):
    got = prefix_trie.prefix_trie(*prefix_trie.rebuilt(df), **more).collect()
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in got)


def table(seed, n, alphabet, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        c = rng.choice([c, c + 100, 100 * c, c - 40])
        shared = rng.choice([["same"] * 3, [f"t{i}" for i in range(rng.randint(0, 5))], []])
        texts = shared + [f"x{rng.randrange(alphabet)}" * rng.randint(1, 2) for _ in range(rng.randint(0, longest))]
        rows += [(c, rng.choice([None, i, i]) if c % 7 == 0 else i, rng.choice(["user", None]) if c % 5 == 0 else "user", t) for i, t in enumerate(texts)]
    rows += [(None, 1, "user", "nobody")] * 3 + [(7, 3, "user", "again")] * 9 + [(11, None, None, None)] * 2 + [(5000 + i, 0, "user", "one turn") for i in range(30)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, n, alphabet, longest, block", [(1, 60, 2, 6, 64), (2, 150, 3, 4, 64), (3, 60, 2, 40, 4), (4, 90, 1, 12, 5)])
def test_trie(spark, seed, n, alphabet, longest, block):
    rows = table(seed, n, alphabet, longest)
    df = spark.createDataFrame([(*r, "clash", i) for i, r in enumerate(rows)], SCHEMA + ", p string, n int").repartition(7)
    assert made(df, block=block) == brute(rows)


def test_many_ranges_and_a_very_common_beginning(spark):
    rows = [(i, t, "user", f"the same beginning {t}") for i in range(200, 500) for t in range(6)] + [(i, t, "user", f"{i % 40} {t}") for i in range(200, 500) for t in range(6, 9)]
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert made(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_ranges_cut_from_few_samples(spark):
    """Ranges are cut differently whenever Spark samples them again; nodes where they meet have to be there all the same."""
    rng = random.Random(8)
    rows = [(i, t, "user", f"{i % 9} {t}" if t < 7 else f"end {rng.randrange(60)}") for i in range(200, 800) for t in range(rng.randint(6, 9))]
    more = {"spark.sql.shuffle.partitions": 13, "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.rangeExchange.sampleSizePerPartition": 2}
    before = {k: spark.conf.get(k) for k in more}
    for k, v in more.items():
        spark.conf.set(k, v)
    try:
        assert made(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_one_conversation_with_most_rows(spark, monkeypatch):
    """It lies in several ranges; a repeated row takes its places in runs."""
    monkeypatch.setattr(prefix_trie, "_RUN", 64)
    rows = [(100, i, "user", f"t{i}") for i in range(130)] + [(100, 5000, "user", "again")] * 150 + [(i, i, "user", "other") for i in range(101, 120)]
    rows += [(3, 1, "user", "x" * 200_000), (4, 1, "user", "")]
    assert made(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_repeats_and_nulls(spark):
    rows = [(1, 1, "a", "x")] * 2 + [(2, None, None, None), (2, 1, "", "")] + [(3, 1, "ab", "c"), (4, 1, "a", "bc")]
    assert made(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([(1, 1, "a", "b")], SCHEMA)
    assert prefix_trie.conversation_trie(df.where(F.lit(False))).collect() == []
    assert prefix_trie.conversation_trie(df.withColumn("conv_id", F.lit(None).cast("long"))).collect() == []
