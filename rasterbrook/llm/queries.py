"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .chosen_path import near_copies
from .decontaminate import leaks
from .jaccard import jaccard_join
from .mixing import mix
from .passages import near_passages
from .prefix_trie import conversation_trie
from .quality import WORDS, quality_rules
from .suffix_dedup import suffix_dedup
from .tokens import token_counts
from .toxicity import toxicity
from .urls import url_filter
from .warc import archive
from .whitening import whitened

URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix_dedup(table(spark, sf_dir, "documents"))
    digest = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return got.select(*digest, (F.col("n_removed") > 0).alias("shortened"), F.col("kept_text").alias("text"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = archive(table(spark, sf_dir, "pages"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter(table(spark, sf_dir, "pages"), rules)


def op5_near_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_passages(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op13_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_warc": op2_warc,
    "op3_mixing": op3_mixing,
    "op4_url_filters": op4_url_filters,
    "op5_near_passages": op5_near_passages,
    "op6_token_counts": op6_token_counts,
    "op7_decontamination": op7_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_quality_rules": op9_quality_rules,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_whitening": op11_whitening,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_near_copies": op13_near_copies,
}


_CLASSES_SQL = ", ".join(
    f"length(regexp_replace(t, '[^{c}]', '', 'g'))::DOUBLE" for c in (
        "a-z", "A-Z", "0-9", r"\x20\x09-\x0D", r"""\x2E,;:!?''"()\x2D""", r"""\x00-\x08\x0E-\x1F#-&*+/<=>@\x5B-\x60\x7B-\x7F""", r"\x{80}-\x{10FFFF}",
    )
)
_WORDS_SQL = ", ".join(f"({i}, '{w}')" for i, word in enumerate(WORDS) for w in {word, word.capitalize()})
_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

ORACLE_SQL: dict[str, str] = {
    "op4_url_filters": rf"""
        WITH rules(rh, rp, rv) AS (VALUES {_RULES_SQL}),
        p AS (SELECT page_id, url,
                translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
              FROM pages),
        m AS (SELECT url, max_by({{'rule': rh || rp, 'rv': rv}}, 1000 * length(rh || rp) + length(rh)) AS best
              FROM (SELECT DISTINCT url, host, path FROM p) d
              JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
              GROUP BY url)
        SELECT page_id, host, path, best.rule AS rule, coalesce(best.rv, 'allow') AS verdict
        FROM p LEFT JOIN m ON p.url = m.url""",
    "op7_decontamination": r"""
        WITH d AS (SELECT row_number() OVER () AS k, doc_id, t FROM (SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM documents)),
        b AS (SELECT row_number() OVER () AS kb, item_id, t, least(13, len(t)) AS w FROM (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM benchmark) WHERE len(t) > 0),
        dt AS (SELECT k, unnest(t) AS tok, unnest(range(len(t))) AS p FROM d), bt AS (SELECT kb, unnest(t) AS tok, unnest(range(len(t))) AS p FROM b),
        m AS (SELECT k, kb, dt.p - bt.p AS shift, bt.p AS j FROM dt JOIN bt ON dt.tok = bt.tok),
        g AS (SELECT k, kb, shift, any_value(w) AS w, greatest(shift, 0) - shift AS lo, least(any_value(len(b.t)), any_value(len(d.t)) - shift) AS hi
              FROM m JOIN b USING (kb) JOIN d USING (k) GROUP BY k, kb, shift HAVING count(*) >= 0.8 * any_value(w)),
        s AS (SELECT k, kb, shift, w, unnest(range(lo, hi - w + 1)) AS i FROM g WHERE hi - lo >= w),
        c AS (SELECT k, kb, shift, w, i, count(*) AS n FROM s JOIN m USING (k, kb, shift) WHERE j >= i AND j < i + w GROUP BY ALL HAVING count(*) >= 0.8 * w)
        SELECT doc_id, item_id, max(n)::BIGINT AS matched, arg_max(c.w, n * 1000000000000 + c.w * 1000000000 - shift)::BIGINT AS compared,
               arg_max(shift, n * 1000000000000 + c.w * 1000000000 - shift)::BIGINT AS position
        FROM c JOIN d USING (k) JOIN b USING (kb) GROUP BY doc_id, item_id""",
    "op10_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
                lambda x: x <> '') AS t FROM documents),
        g AS (SELECT doc_id, array_to_string(t[i:i + 4], ' ') AS s
              FROM (SELECT doc_id, t, unnest(range(1, greatest(len(t) - 4, 1) + 1)) AS i FROM w WHERE len(t) > 0)),
        s AS (SELECT DISTINCT doc_id, s FROM g),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
        r AS (SELECT doc_id AS a, doc_id AS c FROM w UNION SELECT e.b, r.c FROM r JOIN e ON r.a = e.a)
        SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
        FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(c) AS c FROM r GROUP BY a) m ON m.a = w.doc_id""",
    "op9_quality_rules": rf"""
        WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
                list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
        win AS (SELECT k, i, array_to_string(ws[i:i + 7], ' ') AS s FROM (SELECT k, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
        twice AS (SELECT k, unnest(range(i, i + 8)) AS p FROM win JOIN (SELECT k, s FROM win GROUP BY k, s HAVING count(*) > 1) USING (k, s)),
        rep AS (SELECT k, count(DISTINCT p) AS n FROM twice GROUP BY k),
        base AS (SELECT k, doc_id, lang, t, ws, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
                length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
                coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep USING (k)),
        cls AS (SELECT k, lang, n_words, word_chars, 'c' AS kind, unnest(range(7)) AS i, unnest([{_CLASSES_SQL}]) / greatest(length(t), 1) AS p FROM base),
        lists AS (SELECT * FROM (VALUES {_WORDS_SQL}) v(i, word)),
        used AS (SELECT k, i, count(*) AS n FROM (SELECT k, unnest(ws) AS word FROM base) JOIN lists USING (word) GROUP BY k, i),
        hist AS (SELECT k, lang, n_words, word_chars, 'w' AS kind, i, coalesce(n, 0) / greatest(n_words, 1) AS p
                FROM base CROSS JOIN range({len(WORDS)}) r(i) LEFT JOIN used USING (k, i)),
        parts AS (SELECT * FROM cls UNION ALL SELECT * FROM hist UNION ALL
                SELECT k, lang, n_words, word_chars, 'w', {len(WORDS)}, (n_words - coalesce((SELECT sum(n) FROM used u WHERE u.k = b.k), 0)) / greatest(n_words, 1) FROM base b),
        langs AS (SELECT lang, count(*) AS n FROM base WHERE n_words > 0 GROUP BY lang),
        ref AS (SELECT p.lang, kind, i, avg(p) AS q FROM parts p JOIN langs l ON p.lang IS NOT DISTINCT FROM l.lang WHERE n_words > 0 AND n >= 30 GROUP BY ALL UNION ALL
                SELECT l.lang, 'c', i, q FROM langs l, (SELECT i, avg(p) AS q FROM parts WHERE n_words > 0 AND kind = 'c' GROUP BY i) WHERE n < 30),
        js AS (SELECT k, parts.kind, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS dist
                FROM parts JOIN ref ON parts.lang IS NOT DISTINCT FROM ref.lang AND parts.kind = ref.kind AND parts.i = ref.i GROUP BY k, parts.kind),
        far AS (SELECT k, max(CASE WHEN kind = 'c' AND word_chars >= 200 THEN dist ELSE 0 END) AS c, max(CASE WHEN kind = 'w' AND n_words >= 60 THEN dist ELSE 0 END) AS w
                FROM base LEFT JOIN js USING (k) GROUP BY k)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
               NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND coalesce(c, 0) <= 0.25 AND coalesce(w, 0) <= 0.40 AS kept
        FROM base JOIN far USING (k)""",
    "op12_prefix_trie": """
        WITH RECURSIVE t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
                ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
              FROM conversations WHERE conv_id IS NOT NULL),
        ids AS (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM t),
        crc AS (SELECT conv_id, s, 0 AS i, 4294967295::BIGINT AS c FROM ids UNION ALL
              SELECT conv_id, s, i + 1, CASE WHEN i % 9 = 0 THEN xor(c, ascii(s[i // 9 + 1])::BIGINT) ELSE xor(c >> 1, (c & 1) * 3988292384) END FROM crc WHERE i < 9 * length(s)),
        h AS (SELECT conv_id, xor(c, 4294967295) % 6 AS h FROM crc WHERE i = 9 * length(s)),
        r AS (SELECT conv_id, 1 AS part, p, role, text FROM t JOIN h USING (conv_id) WHERE p > h UNION ALL
              SELECT h.conv_id, 0, p, role, text FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 100 WHERE p <= h),
        l AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY part, p) AS s FROM r GROUP BY conv_id),
        c AS (SELECT ids.conv_id, coalesce(l.s, []) AS s FROM ids LEFT JOIN l ON l.conv_id = ids.conv_id),
        n AS (SELECT s[1:d] AS k, d, min(conv_id) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(s) = d), '')) AS ends
              FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM c) GROUP BY 1, 2),
        kids AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS kids FROM n WHERE d > 0 GROUP BY 1, 2),
        f AS (SELECT n.*, coalesce(kids, 0) AS kids, CASE WHEN n.d > 0 THEN (n.n - 1) * length(n.k[n.d].text) ELSE 0 END AS saved FROM n LEFT JOIN kids USING (k, d)),
        up AS (SELECT k[1:a] AS k, a AS d, sum((kids = 0)::INT) AS leaves, sum(saved) AS saved FROM (SELECT k, kids, saved, unnest(range(0, d + 1)) AS a FROM f) GROUP BY 1, 2)
        SELECT f.conv_id, f.d::BIGINT AS depth, above.conv_id AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, leaves::BIGINT AS n_leaves, up.saved::BIGINT AS saved_tokens, f.ends AS ends_sha256
        FROM f JOIN up USING (k, d) LEFT JOIN n above ON f.d > 0 AND above.d = f.d - 1 AND above.k = f.k[1:f.d - 1]""",
    "op13_near_copies": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
                lambda x: x <> '') AS t FROM documents),
        g AS (SELECT doc_id, array_to_string(t[i:i + 1], ' ') AS s
              FROM (SELECT doc_id, t, unnest(range(1, greatest(len(t) - 1, 1) + 1)) AS i FROM w WHERE len(t) > 0)),
        s AS (SELECT DISTINCT doc_id, s FROM g),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
        r AS (SELECT doc_id AS a, doc_id AS c FROM w UNION SELECT e.b, r.c FROM r JOIN e ON r.a = e.a)
        SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, m.c = w.doc_id AS kept
        FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(c) AS c FROM r GROUP BY a) m ON m.a = w.doc_id""",
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
        f AS (SELECT body, min(page_id) AS least FROM p GROUP BY body)
        SELECT page_id, strlen(body)::BIGINT AS payload_bytes, array_to_string(list_transform(range(32), lambda i:
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INT, 1)), '') AS payload_digest,
               CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to
        FROM p JOIN f USING (body)""",
}
