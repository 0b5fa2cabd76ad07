"""Suffix-array dedup against all pairs of window starts."""

import hashlib
import random
from collections import Counter

import pytest

from rasterbrook.llm.suffix_dedup import suffix_dedup

SCHEMA = "doc_id long, text string, n_removed string"


def brute(rows, span):
    texts = [(d, (t or "").encode()) for d, t, _ in rows]
    seen = Counter(t[i : i + span] for _, t in texts for i in range(len(t) - span + 1))
    out = []
    for d, t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - span + 1):
            if seen[t[i : i + span]] > 1:
                gone[i : i + span] = [True] * span
        kept = bytes(b for b, g in zip(t, gone) if not g)
        n = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), len(t) - len(kept), n, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made(seed, n=60, alphabet="abcé \n"):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    shared = [word(rng.randint(30, 160)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [rng.choice([word(rng.randint(0, 90)), rng.choice(shared), rng.choice(shared)[rng.randint(0, 20) :]]) for _ in range(rng.randint(0, 6))]
        rows.append((i, "".join(parts), "x"))
    rows += [(100, None, None), (None, shared[0] * 2, "x"), (101, "", "x"), (5, rows[5][1], "x"), (102, "a" * 300, "x"), (103, "ab" * 150, "x")]
    return rows


@pytest.mark.parametrize("seed,shard", [(1, 4096), (2, 4096), (3, 4), (4, 2)])
def test_same_as_brute_force(spark, monkeypatch, seed, shard):
    from rasterbrook.llm import suffix_dedup as module

    whole = module.repeated_spans
    monkeypatch.setattr(module, "repeated_spans", lambda docs, span, k: whole(docs, span, k, shard))
    rows = made(seed)
    got = suffix_dedup(spark.createDataFrame(rows, SCHEMA), span=40, k=12).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows, 40)
    texts = Counter((d, t or "") for d, t, _ in rows)
    for r in got:  # what is left is the text without the spans
        left = [t.encode() for d, t in texts if d == r.doc_id and len(t.encode()) == r.n_bytes]
        for x in reversed(r.spans):
            left = [t[: x.first] + t[x.last :] for t in left]
        assert r.kept_text in [t.decode("utf-8", "ignore") for t in left]


def test_empty_table(spark):
    assert suffix_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_segments_of_a_huge_text(monkeypatch):
    from rasterbrook.llm import suffix_dedup as module

    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000)).encode()
    whole = module.anchors(text, 40, 12)
    monkeypatch.setattr(module, "_SEGMENT", 500)
    cut = module.anchors(text, 40, 12)
    windows = lambda rows: sorted((i, p, name) for name, _, p, a, z in rows for i in range(a, z + 1))
    assert windows(whole) == windows(cut)
