"""Line deduplication by site-relative frequency (native DataFrame operations only).

Pages are grouped by host. A line (text between newlines, spaces at its ends aside) counts once for each page that contains it;
its pages divided by the host's pages is its ratio, and lines above the boilerplate ratio are dropped from that host's pages.
Hosts of fewer than ``MIN_PAGES`` pages keep all lines, as a ratio says nothing there; blank lines are always kept.

Counting shuffles a host and a 128-bit hash for each distinct line of a page, combined before the shuffle, so neither a hot host nor a line on
every page gathers in one task. The sum of all ratios of a host is its mean number of distinct lines a page, so at most (mean lines) / (ratio)
lines can exceed the ratio: each host's list is small however many pages it has, and pages are then cleaned where they are, without shuffling any text.

Defined results: null text has no lines and stays null; a null host is a host of its own; rows that share an id are pages of their own;
an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table, unused

RATIO = 0.1
MIN_PAGES = 20
#: Host lists that are broadcast: lines in all lists together (16 bytes each); beyond, hosts are joined by a shuffle.
BROADCAST_LINES = 500_000


def _hash(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"))


def boilerplate(docs: DataFrame, host_col: str, text_col: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, lines): for each host the hashes of the lines on more than ratio of its pages."""
    pages = docs.select(F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"))
    totals = pages.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    lines = pages.select("host", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), F.trim))).alias("line")).where("line <> ''")
    counts = lines.select("host", _hash(F.col("line")).alias("h")).groupBy("host", "h").agg(F.count("*").alias("n"))
    most = counts.alias("c").join(totals.alias("t"), F.expr("c.host <=> t.host"))
    found = most.where(F.col("n") > F.lit(ratio) * F.col("pages")).select("c.host", "h")
    return found.groupBy("host").agg(F.collect_list("h").alias("lines"))


def line_dedup(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """docs with text cleaned, and n_lines and n_dropped added (replacing columns of those names)."""
    own_host, own_lines, kept, size_kept = unused(docs, "host", "lines", "kept", "n")
    lists = materialize(boilerplate(docs, host_col, text_col, ratio, min_pages), "boilerplate").select(F.col("host").alias(own_host), F.col("lines").alias(own_lines))
    size = lists.agg(F.sum(F.size(own_lines))).first()[0] or 0
    lists = F.broadcast(lists) if size <= BROADCAST_LINES else lists
    joined = docs.join(lists, F.col(host_col).cast("string").eqNullSafe(F.col(own_host)), "left")
    split = F.split(F.col(text_col), "\n")
    keep = lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(own_lines), _hash(F.trim(x)))
    joined = joined.withColumn(kept, F.when(F.col(own_lines).isNull(), split).otherwise(F.filter(split, keep)))
    joined = joined.withColumns({"n_lines": F.coalesce(F.size(split), F.lit(0)).cast("long"), size_kept: F.coalesce(F.size(kept), F.lit(0)).cast("long")})
    joined = joined.withColumn("n_lines", F.greatest("n_lines", F.lit(0))).withColumn("n_dropped", F.col("n_lines") - F.greatest(size_kept, F.lit(0)))
    return joined.withColumn(text_col, F.array_join(kept, "\n")).drop(own_host, own_lines, kept, size_kept)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(read_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


OP4_SQL = """
WITH t AS (SELECT source, count(*) AS pages FROM documents GROUP BY source HAVING count(*) >= 20),
l AS (SELECT source, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: trim(x)))) AS line FROM documents),
c AS (SELECT source, line, count(*) AS n FROM l WHERE line <> '' GROUP BY source, line),
b AS (SELECT c.source, list(line) AS lines FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source WHERE n > 0.1 * pages GROUP BY c.source),
k AS (SELECT doc_id, string_split(text, chr(10)) AS s, CASE WHEN b.lines IS NULL THEN string_split(text, chr(10))
        ELSE list_filter(string_split(text, chr(10)), lambda x: trim(x) = '' OR NOT list_contains(b.lines, trim(x))) END AS kept
      FROM documents d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CAST(coalesce(len(s), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(s), 0) - coalesce(len(kept), 0) AS BIGINT) AS n_dropped,
       array_to_string(kept, chr(10)) AS text FROM k
"""
