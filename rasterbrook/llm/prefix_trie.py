"""Conversation prefix trie: the tree of all shared beginnings, built as a Patricia tree.

Equal conversations are one. Each is cut into blocks of BLOCK turns; a block knows the beginning it
follows by a 128-bit hash (an exclusive or of hashes of place and turn, so any stretch of a
conversation can be hashed apart). Blocks are sorted by beginning and content, and one pass over
each sorted range makes points only where beginnings branch or end (and along the first and last
row of a range, so that points which several ranges share are the same in all of them). Sums over a
point's conversations are sums over ranges, merged by the point's hash: no subtree is gathered.
Edges keep the lengths of their turns; the nodes between two points are made at the end, with suffix
sums over the edge.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bounded, discard, written

BLOCK = 64  # turns a row holds at most
_RUN = 1024  # places of one repeated turn that a row holds at most
_NOBODY = hashlib.sha256(b"").hexdigest()
_AT = ["depth", "x1", "x2"]
_SORTED = ["block", "p1", "p2", "keys"]


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, start, end, m, n): each different turn with the places it takes, from 1; m tells turns apart, n counts code points.

    Rows are dealt out by ranges, so that one conversation may be any part of them.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("m"), F.length(text).cast("long").alias("n"),
    )
    order = ["turn", "role", "m"]
    same = rows.groupBy("conv_id", *order).agg(F.first("n").alias("n"), F.count("*").alias("times"))
    dealt = written(same.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "trie-turns")
    counts = dealt.groupBy("conv_id", "part").agg(F.sum("times").alias("t"))
    earlier = F.sum("t").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    # A conversation that goes on from another range: at most one a range.
    before = counts.select(F.col("conv_id").alias("b_id"), F.col("part").alias("b_part"), earlier.alias("before")).where("before > 0")
    before = bounded(written(before, "trie-before"))
    end = F.sum("times").over(W.partitionBy("part", "conv_id").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    got = dealt.withColumn("end", end).join(before, (F.col("conv_id") == F.col("b_id")) & (F.col("part") == F.col("b_part")), "left")
    end = F.col("end") + F.coalesce("before", F.lit(0))
    out = written(got.select("conv_id", (end - F.col("times") + 1).alias("start"), end.alias("end"), "m", "n"), "trie-numbered")
    discard(dealt)
    return out


def _places(rows: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """A row for each place p from lo to hi, in runs of bounded length."""
    rows = rows.withColumns({"_lo": lo, "_hi": hi}).where("_lo <= _hi")
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_hi - _lo) div {_RUN}"))))
    first = F.col("_lo") + _RUN * F.col("_i")
    return rows.withColumn("p", F.explode(F.sequence(first, F.least("_hi", first + (_RUN - 1))))).drop("_lo", "_hi", "_i")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, p, m, n) of every conversation that starts as the first of its hundred does, and all ids (conv_id).

    The first h turns of conversation c - c % 100, all if it has fewer, then c's own after its first h; h = crc32(c) % 6.
    """
    turns = numbered(conversations)
    ids = turns.select("conv_id").distinct()
    h, base = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6, F.col("conv_id") - F.col("conv_id") % 100
    heads = _places(turns.where("conv_id % 100 = 0 and start <= 5"), F.col("start"), F.least("end", F.lit(5))).select(F.col("conv_id").alias("h_id"), "p", "m", "n")
    lent = ids.select("conv_id", base.alias("base"), h.alias("h")).join(heads, (F.col("base") == F.col("h_id")) & (F.col("p") <= F.col("h")))
    have = heads.groupBy("h_id").agg(F.max("p").alias("have"))
    own = turns.withColumns({"h": h, "base": base}).where("end > h").join(have, F.col("base") == F.col("h_id"), "left")
    own = _places(own, F.greatest("start", F.col("h") + 1), F.col("end"))
    own = own.select("conv_id", (F.col("p") - F.col("h") + F.least("h", F.coalesce("have", F.lit(0)))).alias("p"), "m", "n")
    return lent.select("conv_id", "p", "m", "n").unionByName(own), ids


def _patricia(block: int, keep_edges: bool):
    """Points of sorted ranges of blocks (part): (depth, hash, parent, code points up to the parent, edge, sums, least)."""
    longs = pa.list_(pa.int64())
    fields = [*_AT, "up", "u1", "u2", "before"]
    schema = pa.schema([*((f, pa.int64()) for f in fields), ("edge", longs), ("sums", longs), ("least", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        stack: list[list] = []  # depth in the block, hash, code points so far, the row it came from, sums, least
        part, group, keys, last = None, None, [], None

        def close(to: int, row, every: bool = False) -> None:
            """Ends the points deeper than `to`; row holds the beginning that goes on, where a point may be missing."""
            while stack[-1][0] > to:
                d, at, chars, (b, ats, cums, lens), sums, least = stack.pop()
                if stack[-1][0] < to:
                    stack.append([to, row[1][to], row[2][to], row, [0] * len(sums), least])
                top = stack[-1]
                for e in range(d, top[0], -1) if every else (d,):
                    up = e - 1 if every else top[0]
                    out.append((block * b + e, *ats[e], block * b + up, *ats[up], cums[up], lens[up:e] if keep_edges else None, sums, least))
                if top[0]:
                    top[4] = [x + y for x, y in zip(top[4], sums, strict=True)]
                    top[5] = min(top[5], least)

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[]] * len(schema)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        for rows in batches:
            for r in rows.to_pylist():
                now = [(k["h1"], k["h2"]) for k in r["keys"]]
                ats, cums = [(r["p1"], r["p2"])], [r["cum"]]
                for (a, b), n in zip(now, r["lens"], strict=True):
                    ats.append((ats[-1][0] ^ a, ats[-1][1] ^ b))
                    cums.append(cums[-1] + n)
                row, same = (r["block"], ats, cums, r["lens"]), (r["block"], r["p1"], r["p2"])
                if r["part"] != part:
                    if stack:
                        close(0, last, every=True)
                    part, group = r["part"], None
                shared = 0
                if same != group:
                    if group is not None:
                        close(0, last)
                    stack[:] = [[0, ats[0], cums[0], row, [], 0]]
                else:
                    while shared < min(len(keys), len(now)) and keys[shared] == now[shared]:
                        shared += 1
                    close(shared, row)
                if group is None:  # the range's first row: a point at each of its turns
                    stack += [[d, ats[d], cums[d], row, [0] * len(r["sums"]), r["least"]] for d in range(1, len(now))]
                stack.append([len(now), ats[-1], cums[-1], row, list(r["sums"]), r["least"]])
                group, keys, last = same, now, row
                if len(out) >= 4096:
                    yield batch()
        if stack:
            close(0, last, every=True)
        yield batch()

    return run


def _points(rows: DataFrame, block: int, keep_edges: bool) -> DataFrame:
    """Points of blocks (part, block, p1, p2, keys, lens, cum, sums, least), merged over the sorted ranges: which points there are depends on part."""
    kinds = ", ".join(f"{c} long" for c in (*_AT, "up", "u1", "u2", "before")) + ", edge array<long>, sums array<long>, least long"
    made = rows.repartition("part").sortWithinPartitions("part", *_SORTED).mapInArrow(_patricia(block, keep_edges), kinds)
    sums = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(3)]
    return made.groupBy(*_AT).agg(*[F.first(c).alias(c) for c in ("up", "u1", "u2", "before", "edge")], *sums, F.min("least").alias("least"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of each class, in order; a class is never held whole."""
    at, digest, found = None, None, []
    for b in batches:
        for *key, text in zip(*(b.column(c).to_pylist() for c in (*_AT, "ids")), strict=True):
            if key != at:
                if at:
                    found.append((*at, digest.hexdigest()))
                at, digest = key, hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
    if at:
        found.append((*at, digest.hexdigest()))
    cols = list(zip(*found, strict=True)) if found else [[]] * 4
    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], [*_AT, "ends"])


def _on(a: list[str], b: list[str]) -> Column:
    return (F.col(a[0]) == F.col(b[0])) & (F.col(a[1]) == F.col(b[1])) & (F.col(a[2]) == F.col(b[2]))


def prefix_trie(turns: DataFrame, ids: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per node of the trie of sequences (conv_id, p, m, n): places p from 1 without gaps, m tells turns apart, n is a turn's size.

    ids (conv_id) holds all conversations, those without turns too. Columns: conv_id (least member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 (of the members of
    depth turns). Beginnings are told apart by 128 bits. No conversation: no row, not even a root.
    """
    keys = F.struct(F.xxhash64(F.lit(17), "p", "m").alias("h1"), F.xxhash64(F.lit(29), "m", "p").alias("h2"))
    rows = turns.select("conv_id", "p", "n", keys.alias("key"), F.expr(f"(p - 1) div {block}").alias("block"))
    one = F.array_sort(F.collect_list(F.struct("p", "key", "n")))  # a block's turns
    blocks = rows.groupBy("conv_id", "block").agg(
        one.alias("t"), F.bit_xor("key.h1").alias("b1"), F.bit_xor("key.h2").alias("b2"), F.sum("n").alias("s"), F.count("*").alias("size")
    )
    w = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    blocks = blocks.select(
        "conv_id", "block", F.coalesce(F.bit_xor("b1").over(w), zero).alias("p1"), F.coalesce(F.bit_xor("b2").over(w), zero).alias("p2"),
        F.coalesce(F.sum("s").over(w), zero).alias("cum"), F.col("t.key").alias("keys"), F.col("t.n").alias("lens"), "b1", "b2", "s", "size",
    )
    blocks = written(blocks, "trie-blocks")

    # Equal conversations are one class, found again by its least member.
    whole = blocks.groupBy("conv_id").agg(F.sum("size").alias("depth"), F.bit_xor("b1").alias("x1"), F.bit_xor("b2").alias("x2"), F.sum("s").alias("total"))
    convs = ids.join(whole, "conv_id", "left").select("conv_id", *[F.coalesce(c, zero).alias(c) for c in (*_AT, "total")])
    convs = written(convs, "trie-conversations")
    classes = convs.groupBy(*_AT).agg(F.min("conv_id").alias("rep"), F.count("*").alias("w"), F.first("total").alias("total"))
    classes = written(classes.select("rep", "w", "total"), "trie-classes")
    some = convs.groupBy(*_AT, F.shiftright("conv_id", 12).alias("chunk")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    some = some.repartition(*_AT).sortWithinPartitions(*_AT, "chunk")
    ends = some.mapInArrow(_digests, "depth long, x1 long, x2 long, ends string").select(*[F.col(c).alias(f"e_{c}") for c in _AT], "ends")

    # Blocks of the classes, each different one once, dealt out by ranges for good: both sums over points need the same ranges.
    alike = ["block", "p1", "p2", "b1", "b2"]
    own = blocks.join(classes, F.col("conv_id") == F.col("rep")).groupBy(*alike)
    own = own.agg(*[F.first(c).alias(c) for c in ("keys", "lens", "cum")], F.array(F.sum("w"), zero, zero).alias("sums"), F.min("rep").alias("least"))
    dealt = written(own.repartitionByRange(*_SORTED).withColumn("part", F.spark_partition_id()), "trie-dealt")
    points = written(_points(dealt, block, True), "trie-points")
    kids = written(points.groupBy("up", "u1", "u2").agg(F.count("*").alias("n_children")), "trie-children")
    near = kids.select(*[F.col(c).alias(f"k_{c}") for c in ("up", "u1", "u2")], "n_children")
    edge = F.aggregate("edge", zero, lambda a, n: a + n)
    with_kids = points.join(near, _on(_AT, ["k_up", "k_u1", "k_u2"]), "left").withColumn("n_children", F.coalesce("n_children", zero))

    # Each node belongs to its least member. What a member owns is the end of its way: from `since` code points on.
    owned = with_kids.groupBy("least").agg(F.sum(edge).alias("own"), F.min("before").alias("since"), F.count_if(F.col("n_children") == 0).alias("leaf"))
    owned = written(owned, "trie-owned")
    ours = owned.select(F.col("least").alias("o_id"), "own", "since", "leaf")
    of = classes.join(ours, F.col("rep") == F.col("o_id"), "left").select("rep", "w", (F.col("w") * F.col("total")).alias("texts"), F.coalesce("own", zero).alias("own"), F.coalesce("leaf", zero).alias("leaf"))
    of = written(of, "trie-of")
    more = blocks.select("conv_id", *alike).join(of, F.col("conv_id") == F.col("rep")).groupBy(*alike).agg(F.array(*[F.sum(c) for c in ("texts", "own", "leaf")]).alias("sums"))
    below = _points(dealt.drop("sums").join(more, alike), block, False)
    below = below.select(*[F.col(c).alias(f"b_{c}") for c in _AT], F.col("s0").alias("texts"), F.col("s1").alias("distinct"), F.col("s2").alias("n_leaves"))

    full = with_kids.join(below, _on(_AT, [f"b_{c}" for c in _AT])).join(ours.select("o_id", "since"), F.col("least") == F.col("o_id"))
    prior = F.col("before") + edge - F.element_at("edge", -1)  # code points above the point's own turn
    saved = F.col("texts") - F.col("s0") * prior - (F.col("distinct") - (prior - F.col("since")))
    full = full.select(*_AT, "up", "u1", "u2", "edge", F.col("s0").alias("n_convs"), "least", "n_children", "n_leaves", saved.alias("saved"))
    # The root: one row, or none without conversations.
    top = of.agg(*[F.sum(c).alias(c) for c in ("texts", "own", "leaf")], F.sum("w").alias("n_convs"), F.min("rep").alias("least")).where("least is not null")
    top = top.withColumns({c: zero for c in _AT}).join(near, _on(_AT, ["k_up", "k_u1", "k_u2"]), "left").withColumn("n_children", F.coalesce("n_children", zero))
    top = top.select(
        *_AT, *[F.lit(None).cast("long").alias(c) for c in ("up", "u1", "u2")], F.lit(None).cast("array<long>").alias("edge"),
        "n_convs", "least", "n_children", F.greatest("leaf", F.lit(1)).alias("n_leaves"), (F.col("texts") - F.col("own")).alias("saved"),
    )
    full = written(full.unionByName(top), "trie-full")
    discard(blocks, dealt, points)

    above = full.select(*[F.col(c).alias(f"a_{c}") for c in _AT], F.col("least").alias("above"))
    full = full.join(ends, _on(_AT, ["e_depth", "e_x1", "e_x2"]), "left").join(above, _on(["up", "u1", "u2"], ["a_depth", "a_x1", "a_x2"]), "left")
    nodes = full.withColumn("d", F.explode(F.when(F.col("up").isNull(), F.array(zero)).otherwise(F.sequence(F.col("up") + 1, F.col("depth")))))
    last = F.col("d") == F.col("depth")
    after = F.when(last, zero).otherwise(F.aggregate(F.slice("edge", (F.col("d") - F.col("up")).cast("int"), (F.col("depth") - F.col("d")).cast("int")), zero, lambda a, n: a + n))
    return nodes.select(
        F.col("least").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("d") == F.col("up") + 1, F.col("above")).when(F.col("d") > 0, F.col("least")).alias("parent_conv_id"),
        "n_convs", F.when(last, F.col("n_children")).otherwise(1).cast("long").alias("n_children"), "n_leaves",
        (F.col("saved") + (F.col("n_convs") - 1) * after).alias("saved_tokens"), F.when(last, F.coalesce("ends", F.lit(_NOBODY))).otherwise(_NOBODY).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text), each rebuilt on the first turns of its hundred's first one.

    Turns are ordered by turn (null first), ties by role, then by the MD5 of length(role):role+text; a null
    role or text is empty; repeated rows are turns of their own. Rows without a conv_id are in no
    conversation. Other columns are ignored. An empty table gives no row.
    """
    return prefix_trie(*rebuilt(conversations))
