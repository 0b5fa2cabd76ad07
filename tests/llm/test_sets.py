"""Joins over sets, leaks and mixtures against brute-force versions, and the whole pipeline."""

import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from rasterbrook.llm import decontaminate, jaccard, mixing
from rasterbrook.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)].append(d)
    return [(d, len(sets[i]), min((x for x in least[root(i)] if x is not None), default=None) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        i = rng.randrange(len(w))
        w[i : i + rng.randint(0, 1)] = [f"e{rng.randrange(10**6)}"]
    return w


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_components(spark, seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    line = [rng.choice(vocab) for _ in range(25)]
    rows = []
    for _ in range(6):  # families of near copies around the threshold
        base = [rng.choice(vocab) for _ in range(rng.choice([12, 60, 150]))]
        rows += [" ".join(edited(rng, base, rng.randint(0, max(1, len(base) // 12)))) for _ in range(25)]
    rows += [" ".join(line + [rng.choice(vocab) for _ in range(40)]) for _ in range(30)]  # one passage, else unlike
    rows += ["one two", "One TWO", "one two three", "", " \n", None, None, "a b c d e", "A b c d e", "ä b c d e", "Ä b c d e"]
    rng.shuffle(rows)
    rows = list(enumerate(rows)) + [(3, None), (7, "seven alone here"), (None, "one two"), (None, "nobody else")]
    rows = [(i, t if i != 7 else "seven alone here") for i, t in rows if i != 3 or t is None]
    df = spark.createDataFrame([(i, t, "x", "y", 0) for i, t in rows], DOCS)
    got = sorted(map(tuple, jaccard.jaccard_join(df).collect()), key=str)
    assert got == sorted(brute_components(rows), key=str)


def test_jaccard_of_an_empty_table(spark):
    assert jaccard.jaccard_join(spark.createDataFrame([], DOCS)).collect() == []


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 440)] + [(500, i) for i in range(501, 560)]
    low = {}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    for n in sorted(near):
        todo = [n]
        while todo:
            if (m := todo.pop()) not in low:
                low[m] = n
                todo += near[m]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert all(got.get(n, n) == c for n, c in low.items())


def test_leaks(spark):
    rng = random.Random(2)
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    items = {i: words(n) for i, n in enumerate((30, 20, 11, 10, 40))}
    near = list(items[4])
    for j in (5, 14, 23, 32):
        near[j] = "zzz"
    texts = {
        1: words(50) + items[0] + words(9), 2: items[2], 3: words(80), 4: near + words(30), 5: words(5) + items[0][4:18] + words(40),
        6: words(10) + items[0][:9] + words(10), 7: [w.upper() + "," for w in items[1]], 8: items[3] + items[0],
    }
    rows = [(i, " ".join(t), "x", "y", 0) for i, t in texts.items()] + [(9, None, "x", "y", 0), (10, "", "x", "y", 0), (1, " ".join(texts[1]), "x", "y", 0), (None, " ".join(items[2]), "x", "y", 0)]
    bench = [(i, " ".join(w)) for i, w in items.items()] + [(20, None), (21, "too short"), (2, " ".join(items[2]))]
    d, b = spark.createDataFrame(rows, DOCS), spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(d, b).collect()}
    assert set(got) == {(1, 0), (2, 2), (4, 4), (5, 0), (7, 1), (8, 3), (8, 0), (None, 2)}
    assert got[1, 0].position == 50 and got[1, 0].matched == 13 and got[5, 0].position == 1
    assert decontaminate.leaks(d.limit(0), b).collect() == [] and decontaminate.leaks(d, b.limit(0)).collect() == []


def test_leaks_without_broadcasts(spark, monkeypatch):
    from rasterbrook.llm import common

    rows = [(1, " ".join(f"w{i}" for i in range(30)), "x", "y", 0)]
    d, b = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(5, rows[0][1])], "item_id long, text string")
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    assert [(r.doc_id, r.item_id) for r in decontaminate.leaks(d, b).collect()] == [(1, 5)]


@pytest.mark.parametrize("weights", [{"a": 0.5, "b": 0.3, "c": 0.2}, {"x": 9, "y": 1}, {str(i): (i + 1) ** 0.5 for i in range(40)}, {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3, "d": 0.0004}, {"a": 1.0}])
def test_pfair_schedule(weights):
    """Less than one block from the target weights themselves, at every slot."""
    total = sum(map(Fraction, weights.values()))
    share = {s: Fraction(w) / total for s, w in weights.items()}
    plan = list(mixing.schedule(weights, {s: int(w / total * 5000) + 3 for s, w in weights.items()}))
    assert [p[4] for p in plan] == list(range(len(plan))) and sum(p[5] == 0 for p in plan) > 4000
    done = Counter()
    for s, i, release, deadline, slot, phase in plan:
        assert i == done[s] and release <= slot < deadline
        done[s] += 1
        if not phase:
            assert all(abs(done[k] - share[k] * (slot + 1)) < 1 for k in weights)
    assert list(mixing.schedule({}, {})) == []
    with pytest.raises(ValueError):
        list(mixing.schedule({"a": 0.0}, {"a": 3}))


def test_phases_after_a_dry_source():
    plan = list(mixing.schedule({"a": 2.0, "b": 1.0, "c": 1.0}, {"a": 3, "b": 9, "c": 7}))
    assert Counter(p[0] for p in plan) == {"a": 3, "b": 9, "c": 7} and [p[4] for p in plan] == list(range(19))
    later = [p for p in plan if p[5] == 1]
    assert {p[0] for p in later} == {"b", "c"} and abs(sum(p[0] == "b" for p in later[:4]) - 2) < 1


def test_mixture(spark):
    rng = random.Random(6)
    rows = [(i, "t", "x", "hot" if i % 3 == 0 else rng.choice(["a", "b", None]), 0) for i in range(900)] + [(5, "t", "x", "a", 0), (None, "t", "x", "b", 0), (1001, "t", "x", "unwanted", 0), (1002, "t", "x", "", 0)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], DOCS + ", slot string")
    out = mixing.mix(df, {"hot": 2.0, "a": 1.0, "b": 1.0, None: 1.0, "absent": 3.0}, block=4, bucket_rows=20)
    got = out.collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((r[0], r[3]) for r in rows)
    placed = sorted((r for r in got if r.position is not None), key=lambda r: r.position)
    assert len({r.position for r in placed}) == len(placed) == len(rows) - 2
    assert all(r.release <= r.slot < r.deadline for r in placed) and [r.in_mix for r in got if r.source in ("unwanted", "")] == [False] * 2
    used, n = Counter(), 0
    for r in placed:
        if r.in_mix:
            used[r.source] += 1
            n += 1
            if n % 4 == 0:
                share = {"hot": 0.4, "a": 0.2, "b": 0.2, None: 0.2}
                assert all(abs(used[s] / 4 - share[s] * n / 4) < 1 for s in share)
    assert 0 < n < len(rows)
    assert mixing.mix(df.limit(0)).collect() == []
    assert mixing.mix(spark.createDataFrame(rows, DOCS), block=4).count() == len(rows)


def test_repeated_and_null_ids_in_a_mixture(spark):
    rows = [(None if i % 2 else 7, "same" if i % 5 else None, "x", "s", 0) for i in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS), block=4, bucket_rows=10).collect()
    assert sorted(r.position for r in got) == list(range(300))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    common = "the of and to in is that it for was".split()
    words = lambda n: [rng.choice(common) if rng.random() < 0.3 else "".join(rng.choice("aeinorst") for _ in range(7)) for _ in range(n)]
    item, passage = words(40), " ".join(words(90))
    docs = {i: " ".join(words(120)) for i in range(40)}
    docs[40] = docs[3] + " end"
    docs[41] = "#### $$$$ " * 100
    docs[42] = docs[42 - 40] + " " + passage
    docs[43] = passage + " " + " ".join(words(150))
    docs[44] = " ".join(words(50) + item + words(50))
    docs[45] = None
    docs[42] = " ".join(words(150)) + " " + passage
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in docs.items()] + [(7, docs[7], "en", "s1", len(docs[7]))]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(by) and set(by) == set(range(40)) | {42, 43}
    assert passage[:300] not in by[42].text and passage[:300] not in by[43].text and all(by[i].text == docs[i] for i in range(40))
    assert all(r.n_chars == len(r.text) for r in got) and len({r.position for r in got}) == len(got)


def test_pipeline_decides_by_row(spark, tmp_path):
    """Null and repeated ids: a bad or superfluous row takes no other row of its id with it."""
    import corpus_pipeline

    rng = random.Random(3)
    common = "the of and to in is that it for was".split()
    words = lambda n: [rng.choice(common) if rng.random() < 0.3 else "".join(rng.choice("aeinorst") for _ in range(7)) for _ in range(n)]
    item = words(30)
    good = [" ".join(words(100)) for _ in range(60)]
    leak = lambda: " ".join(words(40) + item + words(40))
    rows = [(None, t) for t in good[:10]] + [(None, "#### " * 90), (None, leak())]
    rows += [(1, t) for t in good[10:14]] + [(1, "$$$$ " * 90), (1, leak()), (1, None)]
    rows += [(i, t) for i, t in enumerate(good[14:], 100)]
    rows += [(None, good[20]), (None, good[0]), (None, good[0]), (1, good[10]), (1, good[11] + " end"), (300, good[12])]
    docs = spark.createDataFrame([(i, t, "en" if k % 2 else None, f"s{k % 3}", 0, "x") for k, (i, t) in enumerate(rows)], DOCS + ", kept string")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    bad = {"#### " * 90, "$$$$ " * 90, None}
    one = docs.withColumn("lang", F.lit("en"))
    kept = corpus_pipeline.quality(spark, one, str(tmp_path))
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((i, t) for i, t in rows if t not in bad)
    got = corpus_pipeline.near_copies(spark, one, str(tmp_path)).collect()
    texts = Counter(r.text for r in got)
    pair = {good[11], good[11] + " end"}
    assert {t for t in texts if t not in pair} == {t for _, t in rows if t not in pair} and max(texts.values()) == 1 and sum(texts[t] for t in pair) == 1
    ids = {r.text: r.doc_id for r in got}
    assert ids[good[0]] is None and ids[good[20]] == 106 and ids[good[12]] == 1 and ids[good[13]] == 1
    clean = corpus_pipeline.benchmark_passages(spark, one, str(tmp_path)).collect()
    want = Counter((i, t) for i, t in rows if t is None or " ".join(item) not in t)
    assert Counter((r.doc_id, r.text) for r in clean) == want


def test_pipeline_stages_take_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([], DOCS).withColumn("kept", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0 and docs.columns[:5] == corpus_pipeline.COLUMNS, name
