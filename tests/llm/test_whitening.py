"""Whitening against a version with exact integers in one place."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from rasterbrook.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, top=16):
    """{vec_id: (n, deviation, {component: whitened}, explained)} in exact sums and 80-bit floats."""
    sound = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    dims = [len(x) for _, x in sound]
    dim = max(set(dims), key=lambda d: (dims.count(d), d))
    sound = [(i, x) for i, x in sound if len(x) == dim]
    fit = sorted({tuple(x) for _, x in sound})
    n, sums = len(fit), [sum(x[d] for x in fit) for d in range(dim)]
    centred = [[Fraction(n * x[d] - sums[d], n) for d in range(dim)] for x in fit]
    cov = np.array([[float(sum(c[i] * c[j] for c in centred) / n) for j in range(dim)] for i in range(dim)])
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1], q[:, ::-1]
    e, q = e[e > 1e-9 * e.sum()][:top], q[:, : int((e > 1e-9 * e.sum()).sum())][:, :top]
    out = []
    for i, x in sound:
        y = [n * x[d] - sums[d] for d in range(dim)]
        w = np.array([a / n for a in y]) @ q / np.sqrt(e)
        out.append((i, n, sum(a * a for a in y), w, e / np.trace(cov)))
    return out


def held(df, rows, top=16):
    got = {}
    for r in whitening.whitened(df, top).collect():
        got.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    want = brute(rows, top)
    assert sum(len(v) for g in got.values() for v in g.values()) == sum(len(w[3]) for w in want)
    signs = {}
    for i, n, deviation, w, explained in want:
        mine = got[i, deviation]
        assert sorted(mine) == list(range(1, len(w) + 1))
        for k, same in mine.items():
            for r in same[:1]:
                if abs(w[k - 1]) > 1e-3 and k not in signs:
                    signs[k] = math.copysign(1, r.whitened * w[k - 1])
                assert r.n == n and abs(r.whitened - signs.get(k, 1) * w[k - 1]) < 1e-7
                assert abs(r.explained / explained[k - 1] - 1) < 1e-7 and r.identity_error < 1e-8
    return got


def vectors(seed, n, dim):
    rng = np.random.default_rng(seed)
    scale = np.linspace(1, 3, dim)
    rows = [(i, [float(c) for c in rng.normal(size=dim) * scale]) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)] + [(0, rows[1][1]), (None, rows[2][1])]  # a very common vector
    return rows


@pytest.mark.parametrize("seed, n, dim", [(1, 300, 20), (2, 100, 5), (3, 12, 24)])
def test_whitening(spark, seed, n, dim):
    rows = vectors(seed, n, dim)
    rows += [(5000, None), (5001, [None] * dim), (5002, [float("nan")] * dim), (5003, [float("inf")] + [0.0] * (dim - 1)), (5004, []), (5005, [1.0]), (5006, [1.0] * (dim - 1) + [None])]
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA + ", n string").repartition(5)
    got = held(df, rows)
    assert not any(i is not None and i >= 5000 for i, _ in got)


def test_partitions_and_order_change_nothing(spark):
    rows = vectors(4, 200, 9)[:-2]
    one = {(r.vec_id, r.component): r for r in whitening.whitened(spark.createDataFrame(rows, SCHEMA).repartition(1)).collect()}
    for r in whitening.whitened(spark.createDataFrame(rows[::-1], SCHEMA).repartition(9)).collect():
        assert one[r.vec_id, r.component][2:-1] == r[2:-1]


def test_large_entries_and_few_vectors(spark):
    rows = [(i, [float(2**22 * ((i * 7) % 5 - 2)), float(i % 3), float(i)]) for i in range(40)]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 120 and all(r.deviation is None for r in got if (r.vec_id * 7) % 5 != 2) and max(r.identity_error for r in got) < 1e-6
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)
    assert whitening.whitened(one).collect() == [] and whitening.whitened(one.limit(0)).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, None), (2, [None])], SCHEMA)).collect() == []
    two = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], SCHEMA)).collect()
    assert [r.component for r in two] == [1, 1] and {round(r.whitened, 9) for r in two} == {-1.0, 1.0}


def test_remainders():
    rng = random.Random(1)
    for _ in range(50):
        x = rng.randrange(-(10**30), 10**30)
        p = whitening.primes(2 * 10**30)
        assert whitening.remaindered([x % m for m in p], p) == x
