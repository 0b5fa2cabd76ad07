"""Suffix-array dedup: bytes under any long string that also starts elsewhere, by sampled induced sorting.

Only a content-chosen sample of the suffixes is sorted outright: the position of the smallest
k-gram hash in each window of `span` bytes (equal windows choose equal positions, as equal
substrings have equal left-most-smaller suffixes in plain induced sorting). Samples whose k-gram
occurs once are settled at once. The others' right contexts are sorted by Spark's sorter (sorted
runs on disk, merged by a priority queue), and all other window starts are induced from them in
rounds, one byte to the left a round, carrying the common-prefix values of neighbours. Samples of
one very frequent k-gram are spread over several shards, whose window classes are merged after.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import SAMPLE, bounded, discard, pieces, repeated, text_key, written

_SEGMENT = 1 << 18  # places within one lie in the low 20 bits of what is compared
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = min(_SEGMENT, max(1 << 15, 2 * n))
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.full(size, b, np.uint64) for b in (_BASE, inverse)]
        for x in _powers:
            x[0] = 1
            np.cumprod(x, out=x)
    return _powers


def anchors(data: bytes, span: int, k: int) -> list[tuple[int, int, int, int, int]]:
    """(name, context, p, first, last) of each chosen position p: the windows that start in first..last choose p.

    name is the hash of the k bytes at p, context that of all bytes of those windows.
    """
    out = []
    view = memoryview(data)
    for s in range(0, max(1, len(data) - span + 1), _SEGMENT - span + 1):
        part = np.frombuffer(data, np.uint8, min(_SEGMENT, len(data) - s), s)
        n = len(part)
        if n < span:
            break
        up, down = _power_tables(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[part] * up[:n], out=sums[1:])
        h = (sums[k:] - sums[:-k]) * down[: n - k + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        w = span - k + 1
        packed = (h & np.uint64(0xFFFFFFFFFFF00000)) | np.arange(len(h), dtype=np.uint64)
        rows = -(-len(h) // w)
        grid = np.full(rows * w, np.uint64(0xFFFFFFFFFFFFFFFF))
        grid[: len(h)] = packed
        grid = grid.reshape(rows, w)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        m = n - span + 1
        p = (np.minimum(back[:m], ahead[w - 1 : w - 1 + m]) & np.uint64(0xFFFFF)).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(p[1:] != p[:-1]) + 1))
        last = np.concatenate((first[1:] - 1, [m - 1]))
        at = p[first]
        names = h[at].view(np.int64).tolist()
        for name, q, a, b in zip(names, at.tolist(), first.tolist(), last.tolist(), strict=True):
            out.append((name, xxhash.xxh3_64_intdigest(view[s + a : s + b + span]) - (1 << 63), s + q, s + a, s + b))
    return out


_KEY = ["doc_id", "text_key"]
_SAMPLE = "doc_id long, text_key long, name long, context long, at long"
_SEEDS = _SAMPLE + ", shard int, shards int, single boolean, lhs binary, rhs binary"
_FOUND = "doc_id long, text_key long, first long, last long, name long, level int, window long, single boolean"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(cols, fields, strict=True)], [n for n, _ in fields])


def induce(groups: np.ndarray, left: list[bytes], right: list[bytes], span: int) -> list[np.ndarray]:
    """For each sample, the levels a whose window (a bytes to the left of the sample on) has an equal in its group.

    Samples come sorted by group and right bytes; left and right hold the bytes on each side. A
    sample has the levels span - len(right) to len(left).
    """
    n = len(left)
    low = span - np.fromiter(map(len, right), np.int64, n)
    high = np.fromiter(map(len, left), np.int64, n)
    # Common prefixes of neighbours' right bytes; then minima over 2**j neighbours, for any pair's.
    text = np.frombuffer(b"".join(x.ljust(span, b"\0") for x in right), np.uint8).reshape(n, span)
    differ = text[1:] != text[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), span)
    common = np.minimum(common, span - np.maximum(low[1:], low[:-1]))
    common[groups[1:] != groups[:-1]] = -1
    minima = [common]
    while 2 ** len(minima) < n:
        m, d = minima[-1], 2 ** (len(minima) - 1)
        minima.append(np.minimum(m[:-d], m[d:]) if len(m) > d else m)
    width = max(1, int(high.max(initial=0)))
    lhs = np.frombuffer(b"".join(x.rjust(width, b"\0") for x in left), np.uint8).reshape(n, width)

    out: list[list[tuple[np.ndarray, int]]] = []
    order, cls = np.arange(n), groups  # samples in the order of their suffixes at this level
    level = 0
    while True:
        same = cls[1:] == cls[:-1]
        if len(order) > 1 and same.any():
            x, y = order[:-1][same], order[1:][same]
            j = np.int64(np.log2(np.maximum(1, y - x) + 0.5))
            lcp = np.empty(len(x), np.int64)
            for b in np.unique(j):
                q = j == b
                m = minima[b]
                lcp[q] = np.minimum(m[x[q]], m[y[q] - 2**b])
            hit = np.zeros(len(order), bool)
            pair = np.zeros(len(order) - 1, bool)
            pair[same] = lcp + level >= span
            hit[1:] |= pair
            hit[:-1] |= pair
            # Neighbours that this level doesn't have (too short on the right) share less than span.
            out.append((order[hit], level))
        # A sample alone in its class has no equal further left either.
        alone = np.ones(len(order), bool)
        alone[1:] &= ~same
        alone[:-1] &= ~same
        level += 1
        stay = ~alone & (high[order] >= level)
        order, cls = order[stay], cls[stay]
        if len(order) < 2:
            break
        byte = lhs[order, width - level]
        by = np.argsort(byte, kind="stable")
        order, old, byte = order[by], cls[by], byte[by]
        cls = np.concatenate(([0], np.cumsum((old[1:] != old[:-1]) | (byte[1:] != byte[:-1]))))
    levels: list[list[int]] = [[] for _ in range(n)]
    for who, a in out:
        for i in who.tolist():
            levels[i].append(a)
    return [np.array(x, np.int64) for x in levels]


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    if not len(values):
        return []
    cut = np.flatnonzero(np.diff(values) != 1)
    return list(zip(values[np.r_[0, cut + 1]].tolist(), values[np.r_[cut, len(values) - 1]].tolist(), strict=True))


def _induced(span: int, batch_rows: int):
    def settle(rows: list[tuple]) -> Iterator[tuple]:
        key = [(r[2], r[5]) for r in rows]  # name, shard
        groups = np.concatenate(([0], np.cumsum([a != b for a, b in zip(key, key[1:])]))).astype(np.int64)
        left, right = [r[8] for r in rows], [r[9] for r in rows]
        found = induce(groups, left, right, span)
        sent = set()
        for r, levels, l, g in zip(rows, found, left, right, strict=True):
            p = r[4] >> 32
            if r[7]:
                for a, b in _runs(levels):
                    yield (r[0], r[1], p - b, p - a + span, None, None, None, True)
            if r[6] > 1:  # other shards have samples of this name: a row per window class of this shard
                whole, met = l + g, set(levels.tolist())
                for a in range(span - len(g), len(l) + 1):
                    w = xxhash.xxh3_64_intdigest(whole[len(l) - a : len(l) - a + span]) - (1 << 63)
                    if a in met:
                        if (r[2], a, w) in sent:
                            continue
                        sent.add((r[2], a, w))
                    yield (r[0], r[1], p - a, p - a + span, r[2], a, w, r[7])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        last = None
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if len(rows) >= batch_rows and (r[2], r[5]) != last:
                    yield from emit(rows)
                    rows = []
                rows.append(r)
                last = (r[2], r[5])
        if rows:
            yield from emit(rows)

    def emit(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        out = []
        for x in settle(rows):
            out.append(x)
            if len(out) == 20_000:
                yield _batch(out, _FOUND)
                out = []
        yield _batch(out, _FOUND)

    return run


def repeated_spans(docs: DataFrame, span: int = 400, k: int = 150, shard_rows: int = 4096) -> DataFrame:
    """(doc_id, text_key, spans): byte ranges first to last - 1 that repeat; ranges may overlap and touch.

    docs has doc_id, text_key (a hash of the text; rows that share both are copies) and text. The
    result is a table in the shared folder; what led to it is deleted.
    """

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 2 << 20):
            rows: list[tuple] = []
            for doc, key, text in zip(b.column("doc_id").to_pylist(), b.column("text_key").to_pylist(), b.column("text"), strict=True):
                got = anchors(text.as_py().encode(), span, k)
                rows += [(doc, key, name, ctx, p << 32 | (p - a) << 16 | (p - z)) for name, ctx, p, a, z in got]
            yield _batch(rows, _SAMPLE)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 2 << 20):
            out: list[tuple] = []
            for r in b.to_pylist():
                data = r["text"].encode()
                for s in r["seeds"]:
                    p, l, low = s["at"] >> 32, s["at"] >> 16 & 0xFFFF, s["at"] & 0xFFFF
                    out.append((r["doc_id"], r["text_key"], s["name"], s["context"], s["at"], s["shard"], s["shards"], s["single"], data[p - l : p], data[p : p + span - low]))
                if len(out) > 5000:
                    yield _batch(out, _SEEDS)
                    out = []
            yield _batch(out, _SEEDS)

    long = docs.where(F.octet_length("text") >= span)
    samples = written(long.mapInArrow(sample, _SAMPLE), "suffix-samples")
    again = repeated(samples, "name", F.pmod(F.hash("doc_id", "text_key", "at"), F.lit(SAMPLE)) == 0, "suffix-names")
    again = written(again.drop("df"), "suffix-repeated")
    discard(samples)
    classes = written(
        again.groupBy("name", "context").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_key", "at")).alias("one")),
        "suffix-classes",
    )
    # Equal contexts: everything in them repeats.
    equal = classes.where("n > 1").select(F.col("name").alias("c_name"), F.col("context").alias("c_context"))
    whole = again.join(equal, (F.col("name") == F.col("c_name")) & (F.col("context") == F.col("c_context"))).select(
        *_KEY,
        F.expr("shiftright(at, 32) - (shiftright(at, 16) & 65535)").alias("first"),
        F.expr(f"shiftright(at, 32) - (at & 65535) + {span}").alias("last"),
    )
    # Different contexts around one k-gram: one of each goes to the sorter.
    many = classes.groupBy("name").agg(F.count("*").alias("m")).where("m > 1")
    many = written(many.select(F.col("name").alias("m_name"), F.ceil(F.col("m") / shard_rows).cast("int").alias("shards")), "suffix-many")
    seeds = classes.join(bounded(many), F.col("name") == F.col("m_name")).select(
        "one.*", "name", "context", "shards", (F.col("n") == 1).alias("single"),
        F.pmod(F.hash("context"), "shards").alias("shard"),
    )
    seeds = seeds.groupBy(*_KEY).agg(F.collect_list(F.struct("name", "context", "at", "shard", "shards", "single")).alias("seeds"))
    seeds = seeds.select(*[F.col(c).alias(f"s_{c}") for c in _KEY], "seeds")
    cuts = long.join(seeds, F.col("doc_id").eqNullSafe(F.col("s_doc_id")) & (F.col("text_key") == F.col("s_text_key")))
    cuts = cuts.select(*_KEY, "text", "seeds").mapInArrow(cut, _SEEDS)
    ordered = cuts.repartition("name", "shard").sortWithinPartitions("name", "shard", "rhs")
    found = written(ordered.mapInArrow(_induced(span, shard_rows), _FOUND), "suffix-found")
    near = found.where("window is null").select(*_KEY, "first", "last")
    window = found.where("window is not null")
    shared = window.groupBy("name", "level", "window").agg(F.count("*").alias("n")).where("n > 1")
    shared = shared.select(*[F.col(c).alias(f"w_{c}") for c in ("name", "level", "window")])
    across = window.where("single").join(
        shared, (F.col("name") == F.col("w_name")) & (F.col("level") == F.col("w_level")) & (F.col("window") == F.col("w_window"))
    ).select(*_KEY, "first", "last")
    spans = whole.unionByName(near).unionByName(across)
    spans = written(spans.groupBy(*_KEY).agg(F.collect_set(F.struct("first", "last")).alias("spans")), "suffix-spans")
    discard(again, classes, many, found)
    return spans


def suffix_dedup(docs: DataFrame, span: int = 400, k: int = 150, with_text: bool = True, carry: Sequence[str] = ()) -> DataFrame:
    """Removes every byte covered by a span-byte string that also starts anywhere else.

    docs: (doc_id, text). One row per row of docs: doc_id, n_bytes, n_removed, n_spans (maximal
    removed runs), kept_sha256 of the bytes left, spans (those runs: first byte, byte behind the last),
    the columns named in carry and, with_text, kept_text: what is whole UTF-8 of the bytes left.
    Strings are compared on the input; other copies in the same text count, also overlapping ones; they
    never cross texts. Null text: empty. Repeated rows are copies of each other. k-grams and contexts are
    told apart by 64-bit hashes (within one k-gram's group for the contexts).
    """
    carry = list(carry)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *carry)
    rows = rows.withColumn("text_key", text_key())
    spans = repeated_spans(rows.drop(*carry), span, k)
    spans = spans.select(*[F.col(c).alias(f"s_{c}") for c in _KEY], "spans")
    both = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("s_doc_id")) & (F.col("text_key") == F.col("s_text_key")), "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    texts = ", kept_text string" * with_text
    runs_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    full = StructType([
        *StructType.fromDDL(f"{schema}, spans array<struct<first: long, last: long>>{texts}").fields, *(rows.schema[c] for c in carry),
    ])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 2 << 20):
            out, gone, left = [], [], []
            for doc, text, found in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("spans").to_pylist(), strict=True):
                data = text.as_py().encode()
                runs: list[list[int]] = []
                for s, e in sorted((x["first"], x["last"]) for x in found or ()):
                    if runs and s <= runs[-1][1]:
                        runs[-1][1] = max(e, runs[-1][1])
                    else:
                        runs.append([s, e])
                edges = [0, *(x for r in runs for x in r), len(data)]
                kept = b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
                out.append((doc, len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
                gone.append([{"first": a, "last": z} for a, z in runs])
                if with_text:
                    left.append(kept.decode("utf-8", "ignore"))
            made = _batch(out, schema)
            cols = [*made.columns, pa.array(gone, runs_type), *([pa.array(left, pa.string())] if with_text else []), *(b.column(c) for c in carry)]
            yield pa.RecordBatch.from_arrays(cols, full.names)

    return both.select("doc_id", "text", "spans", *carry).mapInArrow(remove, full)
