"""Exact deduplication with keyed, disk-backed streaming state (native DataFrame operations only).

Texts are equal when identical after every run of ASCII white space (space, \\t \\n \\v \\f \\r) becomes one space.
A stream of (digest, id, locator) rows runs through a stateful aggregation in a RocksDB state store without
watermark, so no key ever expires: the state keeps, for each digest, the smallest id seen, the locator of that row's
content (the file it was read from) and the number of rows. Only rows whose digest was hit more than once have their
text read again; their full bytes are compared with the keeper's, and rows that differ in spite of equal digests are
regrouped by their whole text.

Rows to compare are dealt in salted groups of about ``GROUP``, each with a copy of the keeper's text, so a digest of a third of all rows loads no task.

Defined results: null text counts as empty and all empty texts are equal; a null id never wins over
another id, and in a group of null ids keep_id is null; repeated rows (same id, same text) count each, and each of
them is marked kept if their id is the smallest; an empty table gives an empty result; further columns are ignored.
Skew: digests are combined before the shuffle, and the joins that spread a hot group's keeper are split by AQE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, materialize, read_table, scratch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows (id, hash, digest) that may be broadcast to pick the texts to reread; beyond, a shuffle join does it.
BROADCAST_IDS = 200_000
#: Rows of a digest that are compared with its keeper in one group.
GROUP = 1_000
#: MB that all state stores of an executor may hold in memory together.
STATE_MB = 128


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS, " ")


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def keyed_state(rows_path: str, schema, spark: SparkSession, files_per_batch: int | None = None) -> DataFrame:
    """Streams the (digest, id, locator, ...) files at rows_path through the keyed state and returns (digest, keep_id, locator, n).

    Each micro-batch emits the keys it changed; ids only fall and counts only rise, so the latest value of a key is its
    smallest id and largest count."""
    out, log = scratch(spark, "dedup-state"), scratch(spark, "dedup-log")
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    state = reader.parquet(rows_path).groupBy("digest").agg(
        F.min("id").alias("keep_id"), F.min_by("locator", "id").alias("locator"), F.count("*").alias("n"),
    )
    rocksdb = "spark.sql.streaming.stateStore.rocksdb"
    held = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false",
        f"{rocksdb}.boundedMemoryUsage": "true", f"{rocksdb}.maxMemoryUsageMB": str(STATE_MB),
        f"{rocksdb}.allowFAllocate": "false", f"{rocksdb}.changelogCheckpointing.enabled": "true",  # many small stores: no space set aside
    }
    old = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        query = (
            state.writeStream.outputMode("update").option("checkpointLocation", log).trigger(availableNow=True)
            .foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}"))
            .start()
        )
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    batches = query.lastProgress is not None and spark.read.schema("digest string, keep_id long, locator string, n long, batch int").parquet(out)
    if not batches:
        return spark.createDataFrame([], "digest string, keep_id long, locator string, n long")
    if batches.select("batch").distinct().limit(2).count() < 2:
        return batches.drop("batch")
    return batches.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.min_by("locator", "keep_id").alias("locator"), F.max("n").alias("n"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, digest=sha256, files_per_batch: int | None = None) -> DataFrame:
    """One row per input row: id, text_hash (of the text as it is), keep_id, group_size, kept, text_digest."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), digest(normalized(F.col(text_col))).alias("digest"), F.input_file_name().alias("locator"),
        F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"),
    )
    path = scratch(spark, "dedup-rows")
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    state = keyed_state(path, rows.schema, spark, files_per_batch)
    hits = materialize(state.where("n > 1"), "dedup-hits")
    members = rows.withColumnRenamed("locator", "file").join(hits, "digest").withColumn("is_keeper", F.col("id").eqNullSafe(F.col("keep_id")) & F.col("file").eqNullSafe(F.col("locator")))
    members = materialize(members.groupBy("id", "text_hash", "digest").agg(F.first("n").alias("n"), F.bool_or("is_keeper").alias("is_keeper")), "dedup-members")
    differ = _differing(docs, members, id_col, text_col, digest)
    if differ.isEmpty():
        found = hits.select("digest", "keep_id", "n")
        out = rows.join(found, "digest", "left")
        return out.select(
            "id", "text_hash", F.coalesce("keep_id", "id").alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
            F.col("id").eqNullSafe(F.coalesce("keep_id", "id")).alias("kept"), F.col("digest").alias("text_digest"),
        )
    # Different texts share a digest: those rows are grouped by their whole text, the keeper's group shrinks by them.
    regroup = differ.groupBy("digest", "text").agg(F.min("id").alias("keep_id"), F.count("*").alias("n"))
    moved = differ.join(regroup, ["digest", "text"]).select("id", "text_hash", "digest", "keep_id", F.col("n").alias("group_size"))
    moved = materialize(moved, "dedup-moved")
    gone = moved.groupBy("digest").agg(F.count("*").alias("gone"))
    stay = (
        rows.join(hits.select("digest", "keep_id", "n"), "digest", "left").join(gone, "digest", "left")
        .join(moved.select("digest", "text_hash").distinct(), ["digest", "text_hash"], "left_anti")
        .select("id", "text_hash", "digest", F.coalesce("keep_id", "id").alias("keep_id"), (F.coalesce("n", F.lit(1)) - F.coalesce("gone", F.lit(0))).cast("long").alias("group_size"))
    )
    both = stay.unionByName(moved.select("id", "text_hash", "digest", "keep_id", "group_size"))
    return both.select("id", "text_hash", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_digest"))


def _differing(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    """Rows of hit digests whose bytes aren't the keeper's: (id, text_hash, digest, text)."""
    key = lambda c: F.coalesce(F.col(c).cast("long"), F.lit((1 << 63) - 1))  # noqa: E731  rows without an id are compared too
    docs = docs.select(key(id_col).alias("_id"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.col(text_col).alias("text"))
    members = members.select(key("id").alias("_id"), "text_hash", "digest", F.ceil(F.col("n") / F.lit(GROUP)).cast("int").alias("groups"), "is_keeper")

    def texts(wanted: DataFrame) -> DataFrame:
        wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
        return docs.join(wanted, ["_id", "text_hash"]).withColumn("text", normalized(F.col("text")))

    keepers = texts(members.where("is_keeper")).groupBy("digest", "groups").agg(F.min("text").alias("kept_text"))
    keepers = keepers.select("digest", "kept_text", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"))
    dealt = texts(members.drop("is_keeper")).withColumn("group", F.pmod(F.xxhash64("_id", "text_hash"), F.col("groups")).cast("int"))
    compared = dealt.join(keepers.hint("shuffle_merge"), ["digest", "group"]).where("text <> kept_text").where(digest(F.col("text")) == F.col("digest"))
    return materialize(compared.select("id", "text_hash", "digest", "text"), "dedup-differ")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("text_digest").alias("text_sha256"))


OP2_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
