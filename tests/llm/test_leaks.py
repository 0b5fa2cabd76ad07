"""Decontamination: every pattern of substitutions that the share allows is found, in items of any length."""

from itertools import combinations

import pytest

from rasterbrook.llm.decontaminate import leaks


def test_every_pattern_of_substitutions(spark):
    items, docs, want = [], [], set()
    for n in (1, 2, 3, 4, 5, 7, 9, 10, 11, 12, 13):
        item = [f"i{n}w{j}" for j in range(n)]
        items.append((n, " ".join(item)))
        for c in range(4):
            for at in combinations(range(n), c):
                doc = 10000 * n + len(docs)
                text = ["x" if j in at else w for j, w in enumerate(item)]
                docs.append((doc, " ".join(["before", *text, "behind"])))
                if n - c >= 0.8 * n:
                    want.add((doc, n, n - c))
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.matched) for r in got} == want
    assert all(r.position == 1 for r in got)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_the_query_is_its_sql(spark, seed):
    """Items of 1 to 30 tokens, some of few different words, with substitutions in the texts; SQL tries all shifts."""
    import random

    import duckdb

    from rasterbrook.llm import queries

    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    items = [[rng.choice(vocab[: rng.choice([2, 60, 60])]) for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 10, 12, 13, 14, 20, 30]))] for _ in range(25)]
    texts = []
    for _ in range(60):
        t = [rng.choice(vocab) for _ in range(rng.randint(0, 40))]
        for it in rng.sample(items, 2):
            cut = it[rng.randint(0, max(0, len(it) - 13)) :]
            t += [x if rng.random() > 0.15 else "zz" for x in cut] + [rng.choice(vocab) for _ in range(rng.randint(0, 9))]
        texts.append(" ".join(t))
    documents = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)] + [(99, None), (98, "")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(i // 2, " ".join(it)) for i, it in enumerate(items)] + [(90, None), (91, "!")], "item_id long, text string")
    con = duckdb.connect()
    con.register("documents", documents.toPandas())
    con.register("benchmark", benchmark.toPandas())
    got = leaks(documents, benchmark).select("doc_id", "item_id", "matched", "compared", "position").collect()
    want = con.sql(f"SELECT doc_id, item_id, matched, compared, position FROM ({queries.ORACLE_SQL['op7_decontamination']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 50
