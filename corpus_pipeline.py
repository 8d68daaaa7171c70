"""The corpus pipeline: language ID, exact dedup, shingle near-dedup, suffix-array dedup and best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next stage's docs; all but the last return
the columns of docs. Rows are told apart by id and a hash of their text, so rows that share an id are judged each; of repeated rows (same id,
same text) exact dedup keeps one. Rows without an id follow their text: they stay unless the rule of a stage drops them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import exact_dedup, language, near_copies, packing, suffix_dedup
from verdigris.llm.common import collect_garbage, materialize, read_table, unused

#: Dropped rows whose keys (16 bytes) may be broadcast; beyond, a shuffle join drops them.
BROADCAST_ROWS = 200_000


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the rows keyed by (id, text_hash) in dropped."""
    key, text_hash = unused(docs, "id", "hash")
    dropped = materialize(dropped.select(F.col("id").alias(key), F.col("text_hash").alias(text_hash)).distinct(), "dropped")
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(F.col("text").cast("string")) == F.col(text_hash))
    return docs.join(dropped, same, "left_anti")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is accepted."""
    collect_garbage(spark)
    found = materialize(language.language_id(docs), "languages")
    return without(docs, found.where("NOT accepted"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each text."""
    collect_garbage(spark)
    found = materialize(exact_dedup.exact_dedup(docs), "copies")
    left = without(docs, found.where("NOT kept"))
    # Only rows whose id repeats with the same text are regrouped; all others pass without a shuffle.
    key, digest = unused(docs, "id", "digest")
    repeated = found.where("kept").groupBy("id", "text_digest").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias(key)).distinct()
    repeated = materialize(repeated, "repeated-ids")
    number = repeated.count()
    if not number:
        return left
    repeated = F.broadcast(repeated) if number <= BROADCAST_ROWS else repeated
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(key))
    again = left.join(repeated, same, "left_semi").withColumn(digest, exact_dedup.sha256(exact_dedup.normalized(F.col("text").cast("string"))))
    return left.join(repeated, same, "left_anti").unionByName(again.dropDuplicates(["doc_id", digest]).drop(digest))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (5-word shingles, similarity 0.8 or more), that of the smallest id."""
    collect_garbage(spark)
    found = materialize(near_copies.near_copies(docs), "near-copies")
    first = found.groupBy("component").agg(F.min(F.struct("id", "text_hash")).alias("first")).where("component IS NOT NULL")
    same = found.where("id <=> component").groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    if same.isEmpty():
        return without(docs, found.where("NOT (id <=> component)"))
    gone = found.join(first, "component").where(~F.struct("id", "text_hash").eqNullSafe(F.col("first")))
    return without(docs, gone)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that appeared before out of the texts."""
    collect_garbage(spark)
    (prefix,) = unused(docs, "cut")
    out = suffix_dedup.remove_repeats(docs, prefix=f"{prefix}_")
    if "n_chars" in docs.columns:
        changed = F.when(F.col(f"{prefix}_n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", changed)
    return out.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences: one row per piece."""
    collect_garbage(spark)
    return packing.best_fit_pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("best_fit_packing", pack),
]

#: Several stages (language ID, near-copy components, tokens) can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
