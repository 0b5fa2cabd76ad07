"""Mixing very many sources."""

from rasterbrook.llm.mixing import mix


def test_thousands_of_sources(spark):
    docs = spark.range(12_000).selectExpr("id as doc_id", "concat('s', id % 3000) as source")
    got = mix(docs, block=2).collect()
    assert len(got) == 12_000 and len({r.position for r in got}) == 12_000
    weights = {f"s{i}": 1.0 + i for i in range(10)}
    got = mix(docs, weights, block=2).collect()
    placed = [r for r in got if r.slot is not None]
    assert len(got) == 12_000 and len(placed) == 40 and {r.source for r in placed} == set(weights)


def test_blocks_grow_with_the_rows(spark):
    docs = spark.range(5_000).selectExpr("id as doc_id", "concat('s', id % 3) as source")
    got = mix(docs, block=2, most_blocks=100).collect()
    assert max(r.slot for r in got) < 103 and len({r.position for r in got}) == 5_000
