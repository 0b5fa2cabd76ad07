"""Embedding whitening: exact scatter in residue numbers, then principal components.

Vectors become integers. Each partition multiplies them modulo several primes with ordinary matrix
products, small enough that doubles are exact; the residues are summed by Spark and put together by
Chinese remaindering. So the covariance is exact whatever the partitions and their order, and only the
eigenvectors are rounded: one decomposition gives a basis, a second one, of the covariance in that
basis, mends what the first has rounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written

_ROWS = 4096  # rows of one matrix product: with residues of 20 bits its sums stay below 2**51
_LARGEST = float(1 << 50)  # entries beyond it don't become longs


def primes(product: int) -> list[int]:
    """The largest primes below 2**20, as many as give a product above the one asked for."""
    out, total, p = [], 1, 1 << 20
    while total <= product:
        p -= 1
        if all(p % q for q in range(2, int(p**0.5) + 1)):
            out.append(p)
            total *= p
    return out


def remaindered(residues: list[int], moduli: list[int]) -> int:
    """The integer of least size with these residues."""
    whole = 1
    for m in moduli:
        whole *= m
    x = sum(r * (whole // m) * pow(whole // m, -1, m) for r, m in zip(residues, moduli, strict=True)) % whole
    return x - whole if 2 * x > whole else x


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _scatter(moduli: list[int], dim: int):
    """Sums of products of all pairs of columns modulo each prime; a column of ones stands last, for sums and the count."""
    schema = pa.schema([("k", pa.int64()), ("i", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(moduli), dim + 1, dim + 1), np.int64)
        some = False
        for b in batches:
            x = _matrix(b.column("x"), dim)
            for start in range(0, len(x), _ROWS):
                part = x[start : start + _ROWS]
                part = np.concatenate([part, np.ones((len(part), 1), np.int64)], axis=1)
                for k, p in enumerate(moduli):
                    r = part % p
                    r = np.where(2 * r > p, r - p, r).astype(np.float64)
                    total[k] = (total[k] + (r.T @ r).astype(np.int64)) % p
                some = True
        if some:
            for k in range(len(moduli)):
                rows = [total[k, i, i:].tolist() for i in range(dim + 1)]
                yield pa.RecordBatch.from_arrays([pa.array([k] * (dim + 1), pa.int64()), pa.array(range(dim + 1), pa.int64()), pa.array(rows, schema.field("sums").type)], schema=schema)

    return run


def exact_scatter(fit: DataFrame, dim: int, n: int, most: int) -> list[list[int]]:
    """Of rows (x): sums of products of all pairs of columns, with a column of ones last. most bounds the entries' size.

    The driver gets a number for each prime and pair of dimensions, however many rows there are.
    """
    moduli = primes(2 * n * max(most, 1) ** 2)
    made = fit.mapInArrow(_scatter(moduli, dim), "k long, i long, sums array<long>")
    made = made.select("k", "i", F.posexplode("sums").alias("j", "s")).groupBy("i", "j", "k").agg(F.sum("s").alias("s"))
    residues: dict[tuple[int, int], list[int]] = {}
    for r in made.collect():
        residues.setdefault((r.i, r.i + r.j), [0] * len(moduli))[r.k] = r.s % moduli[r.k]
    out = [[0] * (dim + 1) for _ in range(dim + 1)]
    for (i, j), rs in residues.items():
        out[i][j] = out[j][i] = remaindered(rs, moduli)
    return out


def components(scatter: list[list[int]], top: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(unit eigenvectors as columns, eigenvalues, trace) of the covariance, the largest `top` that aren't zero."""
    n, dim = scatter[-1][-1], len(scatter) - 1
    sums = scatter[-1][:-1]
    high, low = np.zeros((dim, dim)), np.zeros((dim, dim))
    for i in range(dim):
        for j in range(i, dim):
            v = Fraction(n * scatter[i][j] - sums[i] * sums[j], n * n)
            high[i, j] = high[j, i] = float(v)
            low[i, j] = low[j, i] = float(v - Fraction(high[i, j]))
    exact = high.astype(np.longdouble) + low.astype(np.longdouble)
    first = np.linalg.eigh(high)[1].astype(np.longdouble)
    turned = first.T @ exact @ first
    basis = first @ np.linalg.eigh(((turned + turned.T) / 2).astype(np.float64))[1].astype(np.longdouble)
    basis /= np.sqrt((basis * basis).sum(axis=0))
    values = ((exact @ basis) * basis).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    trace = np.trace(exact)
    order = [k for k in order if values[k] > dim * np.finfo(np.float64).eps * trace][:top]
    return basis[:, order].astype(np.float64), values[order].astype(np.float64), float(trace)


def _whitened(n: int, sums: list[int], map_: np.ndarray, most: int):
    """Deviations of a matrix of rows as n * x - S and as whitened values."""
    dim = len(sums)
    safe = 2 * n * max(most, 1) < 1 << 62

    def run(x: np.ndarray) -> tuple[list, np.ndarray]:
        y = x * n - np.array(sums, np.int64) if safe else x.astype(object) * n - np.array(sums, object)
        fits = dim * int(np.abs(y).max(initial=0)) ** 2 < 1 << 62
        squares = (y * y).sum(axis=1).tolist() if fits else [sum(v * v for v in row) for row in y.tolist()]
        return [s if s < 1 << 63 else None for s in squares], (y.astype(np.float64) / n) @ map_

    return run


def _covariance(n: int, sums: list[int], map_: np.ndarray, most: int):
    whitened = _whitened(n, sums, map_, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = map_.shape[1]
        total = np.zeros((top, top))
        for b in batches:
            x = _matrix(b.column("x"), len(sums))
            for start in range(0, len(x), _ROWS):
                w = whitened(x[start : start + _ROWS])[1]
                total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(top), pa.int64()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "sums"])

    return run


def _scored(n: int, sums: list[int], map_: np.ndarray, most: int):
    whitened = _whitened(n, sums, map_, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, _ROWS):
                part = b.slice(start, _ROWS)
                deviation, w = whitened(_matrix(part.column("x"), len(sums)))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(deviation, pa.int64()), pa.array(w.tolist(), pa.list_(pa.float64()))], ["id", "deviation", "w"])

    return run


def _integers(vector: Column, scale: int, shift: int) -> Column:
    return F.transform(vector, lambda c: (F.floor(scale * c.cast("double")) + shift).cast("long"))


def whitened(vectors: DataFrame, top: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of vectors (vec_id, embedding).

    Left out: null vectors, those with null or non-finite entries or entries beyond 2**50, and those of
    another length than most have (of lengths equally frequent, the longest counts). An entry c becomes
    x = floor(scale * c) + shift; each distinct x vector is fitted on once, all rows are scored, repeated
    ones and those without an id too. n: vectors fitted on. deviation: sum of (n * x - S) ** 2, null where
    64 bits don't hold it. Components are numbered from 1 by falling eigenvalue; those of no variance (to doubles' precision of it all) have
    no whitened value and no rows, so a single distinct vector or an empty table gives none.
    """
    entries = F.col("embedding")
    sound = F.forall(entries, lambda c: F.coalesce(F.abs(c.cast("double")) <= _LARGEST, F.lit(False)) & ~F.isnan(c))
    rows = vectors.select(F.col("vec_id").alias("id"), "embedding").where(entries.isNotNull() & sound & (F.size(entries) > 0))
    lengths = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim"))
    kind = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}["vec_id"]
    empty = vectors.limit(0).select(
        "vec_id", *[F.lit(0).cast(t).alias(c) for c, t in (("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))]
    )
    common = lengths.first()
    if common is None:
        return empty
    dim = common.dim
    rows = rows.where(F.size("embedding") == dim).select("id", _integers(entries, scale, shift).alias("x"))
    fit = written(rows.select("x").distinct(), "whitening-fit")
    n, most = fit.agg(F.count("*"), F.max(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x"))))).first()
    scatter = exact_scatter(fit, dim, n, most)
    basis, values, trace = components(scatter, top)
    if not len(values):
        discard(fit)
        return empty
    sums, map_ = scatter[-1][:-1], basis / np.sqrt(values)
    found = np.zeros((len(values), len(values)))
    part = fit.mapInArrow(_covariance(n, sums, map_, most), "i long, sums array<double>").select("i", F.posexplode("sums").alias("j", "s"))
    for r in part.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # top x top numbers
        found[r.i, r.j] = r.s
    error = float(np.abs(found / n - np.eye(len(values))).max())
    discard(fit)
    out = rows.mapInArrow(_scored(n, sums, map_, most), f"id {kind}, deviation long, w array<double>")
    out = out.select("id", "deviation", F.posexplode("w").alias("k", "whitened"))
    explained = F.array(*[F.lit(float(v / trace)) for v in values])[F.col("k")]
    return out.select(
        F.col("id").alias("vec_id"), (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        explained.alias("explained"), F.lit(error).alias("identity_error"),
    )
