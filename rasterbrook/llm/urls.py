"""URL filters: host-suffix and path-prefix expressions against rules, by hash prefix, then digest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_parts(rows: DataFrame) -> DataFrame:
    """Adds host and path; both empty without "://"."""
    url = F.coalesce(F.col("url"), F.lit(""))
    return rows.withColumns({
        "host": ascii_lower(F.regexp_extract(url, URL, 1)),
        "path": F.regexp_extract(url, URL, 2),
    })


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow", prefix_digits: int = 8) -> DataFrame:
    """(page_id, host, path, rule, verdict): one row per row of pages (page_id, url).

    rules: (host, path, verdict). Each distinct url gives one expression for each of its host
    suffixes at a label border and each path prefix of a length that some rule has. Expressions
    meet rules by the first hex digits of a SHA-256; the full digest and the text confirm. The
    longest rule (host and path together) wins, then the longer host, then block before allow.
    Nothing fits, a null url, or one without "://": rule null, verdict default. Null rules are
    ignored. The path lengths of rules go to the driver: as many as the longest rule has characters.
    """
    rules = rules.where("host is not null and path is not null and verdict is not null").select(
        ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), "verdict"
    ).distinct()
    lengths = sorted(r[0] for r in rules.select(F.length("rule_path")).distinct().collect())
    digest = F.sha2(F.concat("rule_host", F.lit("\n"), "rule_path"), 256)
    rules = rules.withColumn("digest", digest).withColumn("prefix", F.substring("digest", 1, prefix_digits))
    rules = rules.select(*[F.col(c).alias(f"r_{c}") for c in rules.columns])

    rows = pages.select("page_id", "url")
    urls = url_parts(rows.select("url").where("url is not null").distinct())
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."),
    )
    fit = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    made = (
        urls.where("host <> ''")
        .select("url", "path", F.explode(suffixes).alias("e_host"))
        .select("url", "e_host", "path", F.explode(fit).alias("n"))
        .select("url", "e_host", F.expr("substring(path, 1, n)").alias("e_path"))
        .withColumn("digest", F.sha2(F.concat("e_host", F.lit("\n"), "e_path"), 256))
        .withColumn("prefix", F.substring("digest", 1, prefix_digits))
    )
    hits = made.join(rules, F.col("prefix") == F.col("r_prefix")).where(
        "digest = r_digest and e_host = r_rule_host and e_path = r_rule_path"
    )
    rank = F.struct(
        (F.length("e_host") + F.length("e_path")).alias("n"),
        F.length("e_host").alias("h"),
        (F.col("r_verdict") == "block").alias("b"),
        F.concat("e_host", "e_path").alias("rule"),
        F.col("r_verdict").alias("verdict"),
    )
    best = hits.groupBy("url").agg(F.max(rank).alias("best")).select(F.col("url").alias("b_url"), "best")
    out = url_parts(rows).join(best, F.col("url") == F.col("b_url"), "left")
    return out.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
