"""Row-wise operators against brute-force versions: URL filters, quality rules, token counts, toxicity, WARC."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterbrook.llm import quality, tokens, toxicity, urls, warc

PAGES = "page_id long, url string, html string, host string"
DOCS = "doc_id long, text string, lang string, n_words string"

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), (None, "/", "block")]
URLS = [
    None, "", "nothing", "http://", "http://A.Example.ORG/en/12?x", "x://example.org/en/2", "https://xexample.org/es/", "http://a.com/de/q#f", "http://com/fr/",
    "http://b.net/", "http://example.org", "http://example.org?/es/", "http://a.b.example.org/es/\nz", "://example.org/es/", "http://example.org/es/", "http://example.org/es/",
]


def verdict(url):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fit = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


def test_url_filter(spark):
    pages = spark.createDataFrame([(i, u, None, "x") for i, u in enumerate(URLS)] + [(None, URLS[4], None, "y")], PAGES)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = [tuple(r) for r in urls.url_filter(pages, rules).collect()]
    assert sorted(got, key=str) == sorted([(i, *verdict(u)) for i, u in enumerate(URLS)] + [(None, *verdict(URLS[4]))], key=str)
    assert urls.url_filter(pages, rules.limit(0)).select("verdict").distinct().collect()[0][0] == "allow"
    assert urls.url_filter(spark.createDataFrame([], PAGES), rules).collect() == []


def repeat_brute(words, k=8):
    hit = set()
    wins = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    for i, w in enumerate(wins):
        if wins.count(w) > 1:
            hit |= set(range(i, i + k))
    return len(hit)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60))
def test_repeated_words(words):
    assert quality.repeated_words(words) == repeat_brute(words)


def test_quality_rules(spark):
    rng = random.Random(1)
    common = "the of and to in is that it for was".split()
    clean = lambda: " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("aeinorst") for _ in range(6)) for _ in range(200))
    texts = [clean() for _ in range(60)] + ["#" * 30 + " $$ " * 400, "The same line here\n" * 40, None, "", "short text", "zwölf ü\x0bé\r x\u2003y"]
    rows = [(i, t, "en", "x") for i, t in enumerate(texts)] + [(0, texts[0], "en", "x"), (None, texts[1], None, None)]
    got = quality.quality_rules(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    for r in got:
        t = texts[r.doc_id if r.doc_id is not None else 1] or ""
        words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
        lines = [x for x in t.split("\n") if x.strip(" \t\x0b\x0c\r")]
        assert (r.n_words, r.word_chars) == (len(words), sum(map(len, words)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t) and r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == repeat_brute(words)
        assert r.base_failed == (len(words) < 20 or 100 * r.n_repeat_words > 30 * len(words))
    kept = {r.doc_id for r in got if r.kept}
    assert kept - {None} == set(range(60))
    junk = spark.createDataFrame([*rows, *[(900 + i, "#$ %& " * 300 + str(i), lang, "x") for i, lang in enumerate(("xx", "xx", None, ""))]], DOCS)
    far = {r.doc_id: r for r in quality.quality_rules(junk, carry=["lang", "n_words"]).collect() if r.doc_id is not None and r.doc_id >= 900}
    assert len(far) == 4 and not any(r.kept for r in far.values()) and all(r.char_distance > 0.25 for r in far.values())
    assert [far[900 + i].carried_lang for i in range(4)] == ["xx", "xx", None, ""] and far[900].carried_n_words == "x"
    assert quality.quality_rules(spark.createDataFrame([], DOCS)).collect() == []


def test_js_distance_of_histograms(spark):
    from pyspark.sql import functions as F

    p, q = [0.5, 0.5, 0.0], [0.0, 0.25, 0.75]
    m = (np.array(p) + q) / 2
    kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m) if x)
    got = spark.createDataFrame([(p, q)], "p array<double>, q array<double>").select(quality.js_distance(F.col("p"), F.col("q")), quality.js_distance(F.col("p"), F.col("p"))).first()
    assert got[0] == pytest.approx(np.sqrt((kl(p) + kl(q)) / 2)) and got[1] == 0


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda x: len(t.encode(x, add_special_tokens=False))


@settings(max_examples=150, deadline=None)
@given(text=st.lists(st.sampled_from([*"ab C.,'é\n 9\t€中\u2003", "<|endoftext|>", "'ll", "the "]), max_size=300).map("".join), chunk=st.integers(5, 60), overlap=st.integers(1, 9))
def test_splicing_equals_whole(reference, text, chunk, overlap):
    ids, lengths = tokens.encoder("byte_bpe_50k")
    assert len(ids(text)) == reference(text)
    assert tokens.spliced_count(ids, lengths, text, chunk, overlap) == reference(text)


def test_token_counts(spark, reference):
    texts = ["Hello world", None, "", "x" * 9000, " " * 5000, "Ünïcode <|endoftext|> é" * 50, "word " * 9000]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(0, texts[0], "x", "y"), (None, "a b", "x", "y")]
    got = tokens.token_counts(spark.createDataFrame(rows, DOCS), chunk=4000).collect()
    want = [(i, len((t or "").encode()), reference(t or ""), reference(t or "") > 512) for i, t, *_ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert tokens.token_counts(spark.createDataFrame([], DOCS)).collect() == []


def test_toxicity_generalises(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "ing"]) for _ in range(3))
    rows, labels = [], []
    for i in range(500):
        w, bad = [word() for _ in range(60)], i % 4 == 0
        if bad:
            for j in rng.sample(range(60), 3):
                w[j] = "grolb" + rng.choice(["x", "um", "ing", "ert", "osch", "ean"])
        rows.append((i, " ".join(w), "x", "y"))
        labels.append((i, int(bad)))
    rows += [(500, None, "x", "y"), (501, "", "x", "y"), (None, "th er", "x", "y"), (3, rows[3][1], "x", "y")]
    labels += [(None, 1), (2, None), (600, 1)]
    d, l = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(d, l, per_class=200, bits=14).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 500]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.95
    assert {r.score for r in toxicity.toxicity(d, l.where("toxic = 1")).collect()} == {0.0}
    assert toxicity.toxicity(d.limit(0), l).collect() == []


@pytest.mark.parametrize("least", [0, 4])
def test_warc_round_trip(spark, least):
    html = ["<p>a</p>", None, "", "<p>a</p>", "WARC/1.1\r\n\r\nfake\r\n\r\n", "ü" * 3000, "<p>a</p>", "x", "x"]
    rows = [(10 - i, f"http://Ex.org/{i % 3}\n?q" if i else None, h, "c") for i, h in enumerate(html)] + [(9, None, "new", "c"), (9, None, "new", "c"), (None, "http://n", "<p>a</p>", "c")]
    got = warc.archive(spark.createDataFrame(rows, PAGES), least).collect()
    first = {}
    for p, _, h, _ in rows:
        if p is not None and len((h or "").encode()) >= least:
            first[h or ""] = min(p, first.get(h or "", p))
    want = []
    for p, u, h, _ in rows:
        data = (h or "").encode()
        ref = first.get(h or "") if first.get(h or "") != p else None
        want.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if ref is not None else "response", ref))
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == sorted(want, key=str)
    keys = [(r.url_key, r.captured) for r in got]
    assert keys == sorted(keys)


def test_archives_are_cut_by_bytes(spark, tmp_path):
    """Pages far beyond a file's size, among small ones: files hold one record more at most, and all comes back."""
    import gzip

    rng = random.Random(3)
    html = ["".join(rng.choice("abcdef<>") for _ in range(rng.choice([10, 300, 90_000]))) for _ in range(120)]
    pages = spark.createDataFrame([(i, f"http://e.org/{i}", h, None) for i, h in enumerate(html)], PAGES)
    warc.write_warc(pages, str(tmp_path / "w"), file_bytes=100_000)
    sizes = [len(gzip.decompress(f.read_bytes())) for f in (tmp_path / "w").glob("part-*")]
    assert len(sizes) > 10 and max(sizes) < 200_000
    got = {r.page_id: r.payload_bytes for r in warc.capture_index(f"file://{tmp_path}/w", spark, range_rows=10).collect()}
    assert got == {i: len(h) for i, h in enumerate(html)}


def test_warc_of_an_empty_table(spark):
    assert warc.archive(spark.createDataFrame([], PAGES)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
def test_loser_tree(runs):
    rows = [[(v, None, "k", "t", *[None] * 4, str(i), j) for j, v in enumerate(sorted(r))] for i, r in enumerate(runs)]
    rows = [[(x[0], None, f"{x[0]:03d}", *x[3:]) for x in r] for r in rows]
    got = list(warc.LoserTree([iter(r) for r in rows]))
    assert [x[0] for x in got] == sorted(v for r in runs for v in r)
