"""Chosen-path similarity join: near copies by recursive branching on min-hashes.

Equal sets are one set. Every set has COORDS min-hashes. A node of a tree holds the sets that share the
min-hashes chosen on the way to it; which ones a node chooses next depends on the node alone, so similar
sets take the same ways. Four trees branch on two min-hashes each at the root, then on two, then on 1.25
in the mean (1 / similarity), so a linked pair's chance of staying together doesn't fall with the depth.
Small nodes are compared exhaustively: by a bitmap that bounds the difference of two sets, then by all
min-hashes, what is left by the full sets.

Nodes full of copies don't shrink. There each set is held against a few sets of its node first; sets
that such links put into one component are never compared again, and a node with a single component ends.
Sets that are together in a large node at the last level go through the exact join of this package.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import SAMPLE, bounded, components, discard, pieces, repeated, text_key, written
from .jaccard import _signature, _verified, jaccard_sets
from .shingles import shingle_set

COORDS = 64  # min-hashes a set
WIDTH, LEVELS = 8, 8  # min-hashes from which a level chooses; levels
ALIKE = 38  # of COORDS that a pair shares at least to be verified: one in 20,000 pairs of similarity 0.8 shares fewer
WORK, ROWS = 2_000_000, 20_000  # pairs of different components, and sets, up to which a node is compared exhaustively
_PIVOTS, _TRIED = 4, 3  # sets of a node that all its sets are held against; of those, verified for a set

_rng = np.random.default_rng(13)
_XOR = _rng.integers(0, 1 << 63, COORDS, dtype=np.uint64)[:, None]
_ODD = _rng.integers(0, 1 << 62, COORDS, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)


#: What a set is compared by: the first level's min-hashes in 32 bits, the others in 16, and a bitmap of parities.
SKETCH = np.dtype([("head", "<u4", WIDTH), ("tail", "<u2", COORDS - WIDTH), ("bits", "<u8", 8)])
_PLACE = np.uint64(0x9E3779B97F4A7C15)


def sketch(items: np.ndarray) -> bytes:
    """The SKETCH of a set of 64-bit hashes; nothing for the empty set."""
    if not len(items):
        return b""
    u = items.view(np.uint64)[None, :]
    least = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, u.shape[1], 4096):
        np.minimum(least, ((u[:, start : start + 4096] ^ _XOR) * _ODD).min(axis=1), out=least)
    odd = np.bincount(((u[0] * _PLACE) >> np.uint64(55)).astype(np.int64), minlength=512) % 2
    least >>= np.uint64(32)
    return least[:WIDTH].astype("<u4").tobytes() + least[WIDTH:].astype("<u2").tobytes() + np.packbits(odd.astype(bool)).tobytes()


def _alike(a: np.ndarray, b: np.ndarray, a_n: np.ndarray, b_n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of sketches may link, and how many min-hashes they share.

    Each item that only one of two sets has flips one bit of the bitmap, so pairs with more different bits than
    a link allows don't link; those with fewer than ALIKE equal min-hashes hardly ever do.
    """
    most = a_n + b_n - 2 * -(-percent * (a_n + b_n) // (100 + percent))
    may = np.bitwise_count(a["bits"] ^ b["bits"]).sum(axis=-1) <= most
    same = (a["head"] == b["head"]).sum(axis=-1) + (a["tail"] == b["tail"]).sum(axis=-1)
    return may & (same >= ALIKE), same


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            found = [shingle_set(x.as_py(), k) for x in b.column("text")]
            cols = [pa.array([_signature(s) for s in found], pa.int64()), pa.array([len(s) for s in found], pa.int64()), pa.array([sketch(s) for s in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), *cols], ["doc_id", "text_key", "sig", "n", "mins"])

    return run


def _items(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            found = [(w, shingle_set(x.as_py(), k)) for x, w in zip(b.column("text"), b.column("wanted").to_pylist(), strict=True)]
            found = [(w, s) for w, s in found if _signature(s) == w]  # else another text with the same key
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.int64()), pa.array([len(s) for _, s in found], pa.int64()), pa.array([s for _, s in found], pa.list_(pa.int64()))], ["sig", "n", "items"])

    return run


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), SKETCH)


def _tried(percent: int):
    """Of pairs (a, b) with their sizes and sketches those that may link, with the number of equal min-hashes; of is the set for which a pair is tried."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = (b.column(c).to_numpy() for c in ("a_n", "b_n"))
            may, same = _alike(_sketches(b.column("a_mins")), _sketches(b.column("b_mins")), *sizes, percent)
            some = pa.array(may)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(some), b.column("b").filter(some), pa.array(same.astype(np.int64)).filter(some), b.column("of").filter(some)], ["a", "b", "same", "of"])

    return run


def _within(percent: int, few: bool):
    """Pairs of each node's sets (rows in order of nodes) that are of different components, near in size and may link.

    A pair that has met in an earlier node of the first level, one that was compared, isn't met again. few: of a set's
    partners only those with most equal min-hashes; where others are left, the node comes out as open.
    """

    def pairs(rows: list[tuple]) -> tuple[set, bool]:
        sig, n, comp, at, mask = (np.array([r[i] for r in rows], np.int64) for i in range(5))
        made, found, open_ = np.frombuffer(b"".join(r[5] for r in rows), SKETCH), set(), False
        # Only sets outside the largest component look for partners.
        names, sizes = np.unique(comp, return_counts=True)
        main = names[sizes.argmax()]
        for i in np.flatnonzero(comp != main):
            near = np.flatnonzero((comp != comp[i]) & ((comp == main) | (sig > sig[i])) & (100 * n >= percent * n[i]) & (100 * n[i] >= percent * n))
            may, same = _alike(made[near], made[i], n[near], n[i], percent)
            before = ((mask[i] & ((1 << at[i]) - 1)) >> np.arange(WIDTH)) & 1 == 1
            may &= ~((made["head"][near] == made["head"][i]) & before).any(axis=1)
            near, same = near[may], same[may]
            if few and len(near) > _TRIED:
                order = np.argsort(-same, kind="stable")
                inside = comp[near[order]] == main
                kept = np.concatenate([order[inside][:_TRIED], order[~inside][:_TRIED]])
                open_ |= len(kept) < len(near)
                near = near[kept]
            found.update((min(sig[i], s), max(sig[i], s)) for s in sig[near].tolist())
        return found, open_

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held, found, left = None, [], set(), []

        def end() -> None:
            if len(held) > 1:
                new, open_ = pairs(held)
                found.update(new)
                left.extend([node] * open_)

        for b in batches:
            for this, *row in zip(*(b.column(c).to_pylist() for c in ("node", "sig", "n", "comp", "at", "mask", "mins")), strict=True):
                if this != node:
                    end()
                    node, held = this, []
                    if len(found) > 10_000:
                        yield _pairs(found, left)
                        found, left = set(), []
                held.append(row)
        end()
        yield _pairs(found, left)

    return run


def _pairs(found: set, left: list) -> pa.RecordBatch:
    a, b = zip(*found, strict=True) if found else ((), ())
    none = [None] * len(left)
    cols = ([*a, *none], [*b, *none], [*[None] * len(a), *left])
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "open"])


def _child(node: Column | None, at: Column) -> Column:
    """The node reached by the min-hash at a place."""
    if node is None:
        return F.xxhash64(at, F.substring(F.col("mins"), 4 * at + 1, F.lit(4)))
    return F.xxhash64(node, at, F.substring(F.col("mins"), 4 * WIDTH + 2 * (at - WIDTH) + 1, F.lit(2)))


def _branches(level: int) -> Column:
    """Nodes of the next level: at the root by all of the first level's min-hashes, below it by one or two that the node chooses."""
    if level == 0:
        return F.array(*[_child(None, F.lit(j)) for j in range(WIDTH)])
    chosen = F.pmod(F.col("node"), F.lit(WIDTH)).cast("int")
    other = (chosen + 1 + F.pmod(F.shiftright("node", 8), F.lit(WIDTH - 1)).cast("int")) % WIDTH
    one, two = (_child(F.col("node"), c + WIDTH * level) for c in (chosen, other))
    return F.array(one, two) if level == 1 else F.when(F.pmod(F.shiftright("node", 16), F.lit(4)) == 0, F.array(one, two)).otherwise(F.array(one))


def chosen_path_links(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Sets (doc_id, text_key, sig, n) of all rows, and links (a, b) of sets, enough to connect what is similar."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_key", text_key())
    key = F.xxhash64("doc_id", "text_key")
    made = written(rows.mapInArrow(_sets(k), "doc_id long, text_key long, sig long, n long, mins binary"), "paths-sets")
    sets = written(made.drop("mins"), "paths-rows")
    one = written(made.where("n > 0").groupBy("sig").agg(F.min(key).alias("key"), F.first("n").alias("n"), F.first("mins").alias("mins")), "paths-distinct")
    discard(made)

    def verified(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "wanted")
        wanted = written(wanted.join(one, F.col("wanted") == F.col("sig")).select(F.col("key").alias("w_key"), "wanted"), "paths-wanted")
        texts = rows.where("text is not null").withColumn("key", key).join(bounded(wanted), F.col("key") == F.col("w_key")).select("text", "wanted")
        full = written(texts.mapInArrow(_items(k), "sig long, n long, items array<long>").dropDuplicates(["sig"]), "paths-items")
        out = written(_verified(pairs, full, percent), "paths-links")
        discard(full, wanted)
        return out

    # The roots' children. Most sets are alone in theirs.
    posted = one.select("sig", F.posexplode(_branches(0)).alias("at", "node"))
    first = written(repeated(posted, "node", F.pmod("sig", F.lit(SAMPLE)) == 0, "paths-first").select("sig", "at", "node"), "paths-first")

    # Links to a few sets of the same node, the same few for all of it.
    few = F.array_distinct(F.array(*[F.min_by("sig", F.xxhash64(F.lit(r), "sig")) for r in range(_PIVOTS)]))
    pivots = first.groupBy("node").agg(few.alias("few")).select(F.col("node").alias("p_node"), F.explode("few").alias("b"))
    near = first.join(pivots, F.col("node") == F.col("p_node")).where("sig <> b").select(F.greatest("sig", "b").alias("a"), F.least("sig", "b").alias("b"), F.col("sig").alias("of")).dropDuplicates(["a", "b", "of"])
    side = lambda c: one.select(F.col("sig").alias(f"{c}_sig"), F.col("n").alias(f"{c}_n"), F.col("mins").alias(f"{c}_mins"))
    fits = lambda df: df.where((100 * F.col("a_n") >= percent * F.col("b_n")) & (100 * F.col("b_n") >= percent * F.col("a_n")))
    near = fits(near.join(side("a"), F.col("a") == F.col("a_sig")).join(side("b"), F.col("b") == F.col("b_sig")))
    tried = near.select("a", "b", "a_n", "b_n", "a_mins", "b_mins", "of").mapInArrow(_tried(percent), "a long, b long, same long, of long")
    best = F.slice(F.sort_array(F.collect_list(F.struct("same", "a", "b")), asc=False), 1, _TRIED)  # of at most _PIVOTS * WIDTH
    stars = tried.groupBy("of").agg(best.alias("best")).select(F.explode("best").alias("p")).select("p.a", "p.b").distinct()
    stars = verified(written(stars, "paths-stars"))
    label = components(stars, "paths-stars")

    # Branching: nodes with one component end, small ones are compared, the others go on.
    known = label.select(F.col("node").alias("l_sig"), "component")
    now = first.join(known, F.col("sig") == F.col("l_sig"), "left").select("sig", "at", "node", F.coalesce("component", "sig").alias("comp"))
    whole = one.select(F.col("sig").alias("o_sig"), "n", "mins")
    parts, nexts = [], []
    for level in range(1, LEVELS + 1):
        size = now.groupBy("node", "comp").agg(F.count("*").cast("double").alias("size"))
        size = size.groupBy("node").agg(F.sum("size").alias("size"), F.sum(F.col("size") * F.col("size")).alias("same"), F.count("*").alias("comps")).where("comps > 1")
        size = size.select(F.col("node").alias("s_node"), (((F.col("size") * F.col("size") - F.col("same")) / 2 <= WORK) & (F.col("size") <= ROWS)).alias("small"))
        mixed = now.join(size, F.col("node") == F.col("s_node")).join(whole, F.col("sig") == F.col("o_sig"))
        # Which of a set's first nodes are compared: of at most WIDTH rows.
        compared = F.bit_or(F.when(F.col("small"), F.expr("shiftleft(1, at)")).otherwise(0)).over(W.partitionBy("sig")) if level == 1 else F.lit(0)
        mixed = written(mixed.select("sig", "node", "comp", "n", "mins", "small", "at", compared.cast("long").alias("mask")), "paths-level")
        parts.append(mixed)
        left = mixed.where("not small")
        if level == LEVELS or left.isEmpty():
            break
        now = written(left.select("sig", "comp", F.explode(_branches(level)).alias("node")).distinct().withColumn("at", F.lit(0)), "paths-next")
        nexts.append(now)

    def met(rows: DataFrame, few: bool) -> DataFrame:
        return rows.repartition("node").sortWithinPartitions("node").mapInArrow(_within(percent, few), "a long, b long, open long")

    def links_of(pairs: DataFrame) -> DataFrame:
        return verified(written(pairs.where("a is not null").select("a", "b").distinct(), "paths-pairs"))

    # The likeliest partners first; the others only where their components are still apart.
    small = reduce(DataFrame.unionByName, [p.where("small").drop("small") for p in parts])
    likely = written(met(small, True), "paths-likely")
    rest = links_of(likely)
    known = components(stars.unionByName(rest), "paths-known").select(F.col("node").alias("l_sig"), "component")
    open_ = bounded(written(likely.where("open is not null").select(F.col("open").alias("o_node")).distinct(), "paths-open"))
    again = small.join(open_, F.col("node") == F.col("o_node"), "left_semi").join(known, F.col("sig") == F.col("l_sig"), "left")
    again = again.withColumn("comp", F.coalesce("component", "sig")).drop("l_sig", "component")
    others = links_of(met(again, False).join(likely.select("a", "b"), ["a", "b"], "left_anti"))
    rest = rest.unionByName(others)
    links = stars.unionByName(rest)
    if not left.isEmpty():  # the exact join for what branching doesn't part
        still = left.select("sig").distinct().join(one.select(F.col("sig").alias("o_sig"), "key"), F.col("sig") == F.col("o_sig")).select(F.col("key").alias("w_key"))
        still = rows.withColumn("key", key).join(bounded(written(still, "paths-still")), F.col("key") == F.col("w_key"), "left_semi")
        _, joined, beyond = jaccard_sets(still.select("doc_id", "text"), k, percent)
        links = links.unionByName(joined.select(F.col("node").alias("a"), F.col("component").alias("b"))).unionByName(beyond.select("a", "b"))
    links = written(links, "paths-all")
    discard(first, one, stars, others, likely, *parts, *nexts)
    return sets, links


def near_copies(docs: DataFrame, k: int = 2, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per row of docs (doc_id, text).

    Two texts link when 100 * intersection >= percent * union of their sets of k-word shingles (words
    lower-cased in A-Z; fewer than k words: one shingle of all). All links are confirmed on full sets;
    candidates come from the trees, which find nearly all links (tests demand 0.99 at the threshold).
    component_id is the smallest doc_id reachable, kept tells that it is the row's own. Texts without
    words have no set, link with nothing and are kept. Equal sets link, repeated rows too; a null doc_id
    is a component_id only where no other is reachable. Shingles and sets are told apart by 64-bit hashes.
    """
    sets, links = chosen_path_links(docs, k, percent)
    label = components(links, "paths-components")
    least = sets.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("least"))
    group = least.join(label, F.col("sig") == F.col("node"), "left").select("sig", "least", F.coalesce("component", "sig").alias("component"))
    ids = group.groupBy("component").agg(F.min("least").alias("component_id")).withColumnRenamed("component", "i_component")
    ids = group.join(ids, F.col("component") == F.col("i_component")).select(F.col("sig").alias("g_sig"), "component_id")
    out = sets.join(ids, (F.col("sig") == F.col("g_sig")) & (F.col("n") > 0), "left")
    out = out.withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
