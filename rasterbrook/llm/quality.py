"""Quality rules: distribution divergence against language references."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bounded_bytes, pieces, written

#: Frequent function words of four languages. Their shares, and the share of all
#: other words, make up the common-word histogram; the references are measured, not fixed.
COMMON_WORDS = {
    "en": "the of and to a in is that it for was on are as with by this be at or an he not from have",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden",
    "fr": "de la le et les des en un une du que est pour qui dans par plus pas sur ne se au avec ce il",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le",
}
WORDS = sorted({w for line in COMMON_WORDS.values() for w in line.split()})
#: Character classes: lower, upper, digit, white space, sentence punctuation, other ASCII, non-ASCII.
CLASSES = 7
SYMBOLS = "#*$%&|<>"

_CLASS = np.full(256, 5, np.uint8)
for _chars, _k in (
    (b"abcdefghijklmnopqrstuvwxyz", 0),
    (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1),
    (b"0123456789", 2),
    (b" \t\n\x0b\x0c\r", 3),
    (b".,;:!?'\"()-", 4),
):
    _CLASS[list(_chars)] = _k
_CLASS[0x80:0xC0] = 7  # continuation bytes belong to a counted lead byte
_CLASS[0xC0:] = 6

FEATURES = (
    "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, char_hist array<double>, word_hist array<double>"
)


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """Words that lie in a window of that many words found twice or more, the first included."""
    n = len(words)
    if n <= window:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    mult, h = np.uint64(0x9E3779B97F4A7C15), np.zeros(n - window + 1, np.uint64)
    for j in range(window):
        h = (h ^ (h >> np.uint64(29))) * mult + ids[j : n - window + 1 + j]
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(h, twice))
    edge = np.zeros(n + 1, np.int64)
    edge[at] += 1
    edge[at + window] -= 1
    return int((np.cumsum(edge)[:n] > 0).sum())


def measure(text: str) -> tuple:
    """The counts and both histograms of one whole text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # splits at \x20 and \x09-\x0D only
    chars = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=8)[:CLASSES]
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    counts = Counter(words)
    common = [counts.get(w, 0) + counts.get(c, 0) for w, c in _FORMS]
    hist = np.array([*common, len(words) - sum(common)], float)
    return (
        len(words),
        int(chars.sum() - chars[3]),
        sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        (chars / max(1, chars.sum())).tolist(),
        (hist / max(1, len(words))).tolist(),
    )


_FORMS = [(w.encode(), c if (c := w.capitalize().encode()) != w.encode() else b"") for w in WORDS]


def _features(text: str, carry: Sequence[str]):
    kinds = [pa.int64()] * 5 + [pa.list_(pa.float64())] * 2
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_hist", "word_hist"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text):
            got = [measure(t.as_py() or "") for t in b.column(text)]
            cols = [pa.array([r[i] for r in got], kind) for i, kind in enumerate(kinds)]
            kept = ["doc_id", "lang", *carry]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *cols], [*kept, *names])

    return run


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms, base 2: 0 (equal) to 1."""

    def part(x: Column, y: Column) -> Column:
        m = (x + y) / 2
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0) + F.when(y > 0, y * F.log2(y / m)).otherwise(0.0)

    total = F.aggregate(F.zip_with(p, q, part), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def quality_rules(
    docs: DataFrame,
    max_char_distance: float = 0.25,
    max_word_distance: float = 0.40,
    min_chars: int = 200,
    min_words: int = 60,
    min_reference: int = 30,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per row of docs (doc_id, text, lang): counts, both distances, base_failed and kept.

    A language's reference is the mean histogram of all its documents with words. A text is rejected
    by the base rules, or when its character classes (texts of min_chars word characters or more) or
    its common words (texts of min_words or more) lie further from the reference than allowed;
    shorter texts aren't judged by that histogram. A language of fewer than min_reference such
    documents has no reference of its own: its character classes are held against the mean of all
    documents, its words against none. Null or empty text: no words, so base_failed. A null lang is a
    language of its own, and so is an empty one. Repeated rows stay repeated. The columns named in
    carry are returned as they came, as carried_<name>; others are ignored.
    """
    carried = [f"carried_{c}" for c in carry]
    text = "carried_text" if "text" in carry else "text"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), *[F.col(c).alias(f"carried_{c}") for c in carry], *([] if "text" in carry else ["text"]))
    schema = StructType([*StructType.fromDDL(FEATURES).fields[:2], *(rows.schema[c] for c in carried), *StructType.fromDDL(FEATURES).fields[2:]])
    f = written(rows.mapInArrow(_features(text, carried), schema), "quality-features")
    mean = lambda c, n: F.array(*[F.avg(F.col(c)[i]) for i in range(n)])
    ref = f.where("n_words > 0").groupBy(F.col("lang").alias("ref_lang")).agg(
        F.count("*").alias("ref_n"), mean("char_hist", CLASSES).alias("char_ref"), mean("word_hist", len(WORDS) + 1).alias("word_ref")
    )
    ref = written(ref, "quality-references")
    n = F.sum("ref_n")
    of_all = ref.agg(F.array(*[F.sum(F.col("char_ref")[i] * F.col("ref_n")) / n for i in range(CLASSES)])).first()[0]
    of_all = F.array(*[F.lit(x).cast("double") for x in of_all])
    # A row per language: counted, then broadcast, so that no task gets all texts of one language.
    f = f.join(bounded_bytes(ref, F.lit(8 * (CLASSES + len(WORDS)))), f["lang"].eqNullSafe(ref["ref_lang"]), "left")
    own = F.col("ref_n") >= min_reference
    f = f.withColumns({
        "char_distance": F.when(F.col("word_chars") >= min_chars, js_distance(F.col("char_hist"), F.when(own, F.col("char_ref")).otherwise(of_all))),
        "word_distance": F.when((F.col("n_words") >= min_words) & own, js_distance(F.col("word_hist"), F.col("word_ref"))),
        "base_failed": F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"),
    })
    far = (F.coalesce("char_distance", F.lit(0.0)) > max_char_distance) | (
        F.coalesce("word_distance", F.lit(0.0)) > max_word_distance
    )
    return f.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~far).alias("kept"), "char_distance", "word_distance", *carried,
    )
