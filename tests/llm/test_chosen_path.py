"""Near copies by chosen paths against all pairs."""

import random
from collections import defaultdict

import pytest

from rasterbrook.llm import chosen_path

DOCS = "doc_id long, text string, lang string"


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if x]
    return {tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = min((x for x in least[root(i)] if x is not None), default=None) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        i = rng.randrange(len(w))
        w[i : i + rng.randint(0, 1)] = [f"e{rng.randrange(10**6)}"]
    return " ".join(w)


def got(df):
    return sorted(map(tuple, chosen_path.near_copies(df).collect()), key=str)


def families(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    line = [rng.choice(vocab) for _ in range(25)]
    rows = []
    for size in (25, 25, 25, 120):  # near copies around the threshold
        base = [rng.choice(vocab) for _ in range(rng.choice([12, 60, 150]))]
        rows += [edited(rng, base, rng.randint(0, max(1, len(base) // 14))) for _ in range(size)]
    rows += [" ".join(line + [rng.choice(vocab) for _ in range(40)]) for _ in range(30)]  # one passage, else unlike
    rows += ["one two", "One TWO", "one two three", "", " \n", None, None, "one", "ONE", "ä b", "Ä b", "a b a b a b"] + ["exact copy of this"] * 40
    rng.shuffle(rows)
    return [(i if i % 17 else None, t) for i, t in enumerate(rows)] + [(7, "seven alone here"), (8, "long " * 300_000), (9, " ".join(f"x{i % 50_000}" for i in range(200_000)))]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies(spark, seed):
    rows = families(seed)
    assert got(spark.createDataFrame([(*r, "clash") for r in rows], DOCS.replace("lang", "kept")).repartition(5)) == brute(rows)


def test_branching_and_what_it_does_not_part(spark, monkeypatch):
    """Nodes of few pairs only are compared, so everything else branches to the last level or meets in the exact join."""
    monkeypatch.setattr(chosen_path, "WORK", 3)
    rows = families(3)
    assert got(spark.createDataFrame([(*r, "x") for r in rows], DOCS)) == brute(rows)


def test_recall_of_single_pairs(spark):
    """300 pairs at similarity 0.80 to 0.83, each a component of its own."""
    rng = random.Random(5)
    rows, linked = [], 0
    while linked < 300:
        base = [f"v{rng.randrange(10**5)}" for _ in range(rng.randint(40, 90))]
        other = edited(rng, base, rng.randint(2, 9))
        a, b = shingles(" ".join(base)), shingles(other)
        if 0.8 <= len(a & b) / len(a | b) < 0.83:
            rows += [(2 * linked, " ".join(base)), (2 * linked + 1, other)]
            linked += 1
    found = sum(r[2] != r[0] for r in got(spark.createDataFrame([(*r, "x") for r in rows], DOCS)))
    assert found >= 297


def test_empty(spark):
    df = spark.createDataFrame([(1, "", "x"), (2, None, "x")], DOCS)
    assert got(df) == [(1, 0, 1, True), (2, 0, 2, True)] and got(df.limit(0)) == []
