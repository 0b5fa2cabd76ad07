"""N-gram Jaccard join: exact links of shingle sets, with set relations used to skip work.

Equal sets are one set. A set can have a partner only where enough of it occurs elsewhere, so
counts of shared prefix shingles, then of all shingles, leave few sets in the index. Index lists
are cut into blocks by set length, so a probe skips the blocks that can't hold partners, and a
posting's position bounds what may still follow. Sets much like a pivot take over the pivot's
answer: they are linked to it first, and pairs within one component are never compared again;
only a posting outside its list's main component probes the list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SAMPLE, bounded, components, discard, pieces, repeated, text_key, written
from .shingles import mixed, shingle_set

_BITMAP = 8  # longs of a set's parity bitmap
_PIVOT_KEYS = 3  # min-hashes a set
_PIVOTS = 8  # pivots a min-hash
_TRIED = 3  # of a set's pivots, those compared item by item


def prefix_size(n: int, percent: int) -> int:
    """Smallest hashes of a set of which any partner shares n // 16 + 1 (or its own such number, if less)."""
    return min(n, n - -(-n * percent // 100) + n // 16 + 1)


def _signature(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _sets(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            sigs, sizes, starts = [], [], []
            for x in b.column("text"):
                s = shingle_set(x.as_py(), k)
                sigs.append(_signature(s))
                sizes.append(len(s))
                starts.append(s[: prefix_size(len(s), percent)])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array(sigs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(starts, pa.list_(pa.int64()))],
                ["doc_id", "text_key", "sig", "n", "prefix"],
            )

    return run


def _whole(k: int):
    schema = pa.schema([("sig", pa.int64()), ("n", pa.int64()), ("items", pa.list_(pa.int64())), ("mins", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            rows = []
            for x, wanted in zip(b.column("text"), b.column("wanted").to_pylist(), strict=True):
                s = shingle_set(x.as_py(), k)
                if (sig := _signature(s)) != wanted:
                    continue  # another text with the same hash
                u = s.view(np.uint64)
                mins = [int(mixed(u + np.uint64(j * 0x51ED270B + 1)).min()) - (1 << 63) for j in range(_PIVOT_KEYS)]
                bits = np.zeros(_BITMAP, np.uint64)
                m = mixed(u ^ np.uint64(0xA5A5A5A5))
                at = (m % np.uint64(64 * _BITMAP)).astype(np.int64)
                odd = np.bincount(at, minlength=64 * _BITMAP) % 2
                for i in range(_BITMAP):
                    w = odd[64 * i : 64 * i + 64].astype(np.uint64)
                    bits[i] = (w << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64)
                rows.append((sig, len(s), s, mins, bits.view(np.int64)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def _need(a: str, b: str, percent: int) -> Column:
    """Least overlap of sets of sizes a and b that link: 100 o >= p (a + b - o)."""
    return F.ceil(F.lit(percent) * (F.col(a) + F.col(b)) / F.lit(100 + percent))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of sets (sig, n, items), those that link."""
    left = sets.select(F.col("sig").alias("a"), F.col("n").alias("a_n"), F.col("items").alias("a_items"))
    right = sets.select(F.col("sig").alias("b"), F.col("n").alias("b_n"), F.col("items").alias("b_items"))
    both = pairs.join(left, "a").join(right, "b")
    both = both.withColumn("o", F.size(F.array_intersect("a_items", "b_items")))
    return both.where(100 * F.col("o") >= percent * (F.col("a_n") + F.col("b_n") - F.col("o"))).select("a", "b")


def _unlike(a: str, b: str) -> Column:
    """At least so many items are in only one of both sets: each can flip one bit of the parity bitmap."""
    total = F.lit(0)
    for i in range(_BITMAP):
        total = total + F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i]))
    return total


def jaccard_sets(docs: DataFrame, k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sets (doc_id, text_key, sig, n) of all rows; components (node, component) that pivots give; links (a, b) beyond those."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_key", text_key())
    prefixes = written(rows.mapInArrow(_sets(k, percent), "doc_id long, text_key long, sig long, n long, prefix array<long>"), "jaccard-prefixes")
    sets = written(prefixes.drop("prefix"), "jaccard-rows")
    key = F.xxhash64("doc_id", "text_key")  # rows without an id, or with one that others have, have keys of their own

    # Sets with enough shingles of their prefix elsewhere.
    posted = prefixes.select(key.alias("key"), F.explode("prefix").alias("h"))
    counted = repeated(posted, "h", F.pmod("key", F.lit(SAMPLE)) == 0, "jaccard-prefix").groupBy("key").agg(F.count("*").alias("c"))
    likely = sets.select(key.alias("key"), "sig", "n").join(counted, "key").where(F.expr(f"n > 0 and c >= n * {percent} div 1600 + 1"))
    likely = written(likely.groupBy("sig").agg(F.min("key").alias("key")), "jaccard-likely")
    discard(prefixes)
    wanted = likely.select(F.col("key").alias("w_key"), F.col("sig").alias("wanted"))
    texts = rows.where("text is not null").withColumn("key", key)
    texts = texts.join(bounded(wanted), F.col("key") == F.col("w_key")).select("text", "wanted")
    full = texts.mapInArrow(_whole(k), "sig long, n long, items array<long>, mins array<long>, bits array<long>")
    full = written(full.dropDuplicates(["sig"]), "jaccard-sets")
    discard(likely)

    # Of those, sets of which enough shingles occur in others; their shared shingles, rarest first.
    item = full.select("sig", F.explode("items").alias("h"))
    often = repeated(item, "h", F.pmod("sig", F.lit(SAMPLE)) == 0, "jaccard-items")
    met = often.groupBy("sig").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("met"))
    index = full.join(met, "sig").where(100 * F.size("met") >= percent * F.col("n"))
    lead = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("met"))
    index = index.select("sig", "n", "items", "mins", "bits", (F.col("n") - F.size("met")).alias("own"), F.slice(F.col("met.h"), F.lit(1), lead.cast("int")).alias("lead"))
    index = written(index, "jaccard-index")
    discard(full)

    # Pivots: some sets of each min-hash's bucket, the same for all of it. A set is held against the
    # few that its bitmap says are most like it; verified links to them are answers taken over.
    buckets = index.select("sig", "n", "bits", F.posexplode("mins").alias("j", "m"))
    some = F.array_distinct(F.array(*[F.min_by("sig", F.xxhash64(F.lit(r), "sig")) for r in range(_PIVOTS)]))
    pivots = buckets.groupBy("j", "m").agg(some.alias("some"), F.count("*").alias("size")).where("size > 1")
    pivots = pivots.select(F.col("j").alias("p_j"), F.col("m").alias("p_m"), F.explode("some").alias("b"))
    near = buckets.join(pivots, (F.col("j") == F.col("p_j")) & (F.col("m") == F.col("p_m"))).where("sig <> b")
    near = near.select("sig", "n", "bits", "b").dropDuplicates(["sig", "b"])
    small = index.select(F.col("sig").alias("b_sig"), F.col("n").alias("b_n"), F.col("bits").alias("b_bits"))
    near = near.join(small, F.col("b") == F.col("b_sig")).withColumn("unlike", _unlike("bits", "b_bits"))
    near = near.where(F.col("unlike") <= F.col("n") + F.col("b_n") - 2 * _need("n", "b_n", percent))
    best = near.groupBy("sig").agg(F.slice(F.array_sort(F.collect_list(F.struct("unlike", "b"))), 1, _TRIED).alias("best"))
    stars = best.select(F.col("sig").alias("a"), F.explode("best.b").alias("b"))
    stars = written(_verified(stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), index, percent), "jaccard-stars")
    label = components(stars, "jaccard-stars")
    discard(stars)

    # What is left: lists with several components; postings outside a list's main one probe it.
    known = label.select(F.col("node").alias("l_sig"), F.col("component"))
    post = index.join(known, F.col("sig") == F.col("l_sig"), "left").select(
        "sig", "n", "own", "bits", F.coalesce("component", "sig").alias("comp"), F.posexplode("lead").alias("at", "h")
    )
    post = post.withColumn("at", F.col("at") + F.col("own") + 1).drop("own")
    post = post.withColumn("block", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int"))
    post = written(post, "jaccard-postings")
    sizes = post.groupBy("h", "comp").agg(F.count("*").alias("size"))
    main = sizes.groupBy("h").agg(F.max(F.struct("size", "comp")).alias("most"), F.count("*").alias("comps")).where("comps > 1")
    main = main.select(F.col("h").alias("m_h"), F.col("most.comp").alias("main"))
    several = written(post.join(main, F.col("h") == F.col("m_h")).drop("m_h"), "jaccard-several")
    discard(post)
    probe = several.where("comp <> main").select(
        F.col("sig").alias("p_sig"), F.col("n").alias("p_n"), F.col("bits").alias("p_bits"), F.col("comp").alias("p_comp"), F.col("at").alias("p_at"),
        F.col("h").alias("p_h"), F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("p_block"),
    )
    pair = probe.join(several, (F.col("h") == F.col("p_h")) & (F.col("block") == F.col("p_block")) & (
        (F.col("comp") != F.col("p_comp"))
        & ((F.col("comp") == F.col("main")) | (F.col("sig") > F.col("p_sig")))
        & (100 * F.col("n") >= percent * F.col("p_n")) & (100 * F.col("p_n") >= percent * F.col("n"))
        & (1 + F.least(F.col("n") - F.col("at"), F.col("p_n") - F.col("p_at")) >= _need("n", "p_n", percent))
        & (_unlike("bits", "p_bits") <= F.col("n") + F.col("p_n") - 2 * _need("n", "p_n", percent))
    ))
    rest = _verified(pair.select(F.greatest("sig", "p_sig").alias("a"), F.least("sig", "p_sig").alias("b")).distinct(), index, percent)
    rest = written(rest, "jaccard-rest")
    discard(several, index)
    return sets, label, rest


def jaccard_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, group): one row per row of docs (doc_id, text).

    group names the component, also one without any id (null for texts without words); rows that
    share doc_id and text_key are repeats of one row.
    """
    sets, label, rest = jaccard_sets(docs, k, percent)
    least = sets.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("least"))
    group = least.join(label, F.col("sig") == F.col("node"), "left").select("sig", "least", F.coalesce("component", "sig").alias("component"))
    if not rest.isEmpty():  # links between components join those
        of = lambda x: label.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
        between = rest.join(of("a"), "a", "left").join(of("b"), "b", "left")
        between = between.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
        joined = components(between, "jaccard").select("node", F.col("component").alias("final"))
        group = group.join(joined, F.col("component") == F.col("node"), "left").withColumn("component", F.coalesce("final", "component"))
    group = written(group.select("sig", "component", "least"), "jaccard-groups")
    discard(rest)
    ids = group.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = group.join(ids, "component").select(F.col("sig").alias("g_sig"), "component_id", F.col("component").alias("group"))
    out = sets.join(ids, (F.col("sig") == F.col("g_sig")) & (F.col("n") > 0), "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), own.alias("component_id"), "group")


def jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per row of docs (doc_id, text).

    Two texts link when 100 * intersection >= percent * union of their sets of k-word shingles
    (words lower-cased in A-Z; fewer than k words: one shingle of all). component_id is the smallest
    doc_id reachable over links. Texts without words have no set and link with nothing: component_id
    is their own doc_id. Equal sets link; repeated rows too. A null doc_id never is a component_id
    where another is reachable. Shingles and sets are told apart by 64-bit hashes.
    """
    return jaccard_groups(docs, k, percent).select("doc_id", "n_shingles", "component_id")


def superfluous(groups: DataFrame) -> DataFrame:
    """(doc_id, text_key) of the rows of jaccard_groups() that aren't their group's representative.

    That is the row with the smallest doc_id (an id before none), of several texts of it the one with the
    smallest text_key. Rows that repeat a representative aren't told apart from it.
    """
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    firsts = groups.where("group is not null").groupBy("group").agg(least.alias("one"))
    firsts = firsts.select(F.col("group").alias("f_group"), F.col("one.doc_id").alias("f_id"), F.col("one.text_key").alias("f_key"))
    met = groups.join(firsts, F.col("group") == F.col("f_group"))
    return met.where(~(F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("text_key") == F.col("f_key")))).select("doc_id", "text_key")
