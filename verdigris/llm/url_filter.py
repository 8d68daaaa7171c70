"""URL filters by hashed host-suffix and path-prefix expressions (native DataFrame operations only).

Each URL expands into expressions: every host suffix at a label border whose number of labels some rule has, with every path prefix whose
length some rule has. Expressions and rules are equi-joined on the first 4 bytes of their SHA-256 digests; full digests
then confirm each meeting. Of the rules that fit a URL the longest (host and path together) wins; among equally long ones
that with the longer host, then a block rule. A URL without a rule is allowed.

Distinct (host, path) pairs are expanded, not rows, so a host with a third of all pages costs once; the rules are broadcast only
when they number at most ``BROADCAST_RULES``. Defined results: null URLs and URLs without ``://`` have empty host and path and are
allowed; repeated rows get one result each; empty tables of pages or rules work; other columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

BROADCAST_RULES = 200_000
DEFAULT_VERDICT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The contract's rules: host, path, verdict.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
PARTS = r"://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def _digest(c: Column) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def url_verdicts(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """One row per page: id, host, path, rule, verdict."""
    rules = rules.select(
        F.concat("host", "path").alias("rule"), F.col("verdict").alias("rule_verdict"), F.length("host").alias("host_length"),
        F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("path_length"), _digest(F.concat("host", "path")).alias("rule_digest"),
    ).where("rule IS NOT NULL AND rule_verdict IS NOT NULL")
    shape = rules.agg(F.collect_set("labels").alias("labels"), F.collect_set("path_length").alias("lengths"), F.count("*").alias("n")).first()
    urls = pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    if not shape["n"]:
        return urls.select("id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    hosts = F.expr("split(host, '[.]')")
    names = urls.select("host", "path").distinct().withColumn("_labels", hosts)
    names = names.withColumn("suffix_labels", F.explode(F.array(*[F.lit(n) for n in sorted(shape["labels"])]))).where("suffix_labels <= size(_labels)")
    names = names.withColumn("suffix", F.expr("array_join(slice(_labels, size(_labels) - suffix_labels + 1, suffix_labels), '.')"))
    names = names.withColumn("prefix_length", F.explode(F.array(*[F.lit(n) for n in sorted(shape["lengths"])]))).where("prefix_length <= length(path)")
    names = names.select("host", "path", _digest(F.expr("concat(suffix, substring(path, 1, prefix_length))")).alias("digest"))
    keyed = rules.withColumn("short", F.substring("rule_digest", 1, 8))
    if shape["n"] <= BROADCAST_RULES:
        keyed = F.broadcast(keyed)
    met = names.withColumn("short", F.substring("digest", 1, 8)).join(keyed, "short").where("digest = rule_digest")
    best = met.groupBy("host", "path").agg(
        F.max(F.struct(F.length("rule").alias("length"), "host_length", (F.col("rule_verdict") == "block").alias("block"), "rule", "rule_verdict")).alias("best"),
    ).select("host", "path", "best.rule", "best.rule_verdict")
    out = urls.join(best, ["host", "path"], "left")
    return out.select("id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(read_table(spark, sf_dir, "pages"), rules_frame(spark)).withColumnRenamed("id", "page_id")


OP1_SQL = """
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r(rh, rp, rv) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
f AS (SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv
      FROM (SELECT DISTINCT host, path FROM u) JOIN r ON (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp) GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM u LEFT JOIN f USING (host, path)
"""
