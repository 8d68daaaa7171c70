"""Structured Streaming forms: span windows, running quota counts, append-only verdicts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def span_windows(spans: DataFrame, *, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Spans of each name per tumbling window; windows close once the watermark has passed them."""
    return spans.withWatermark("ts", late).groupBy(F.window("ts", window), "name").agg(F.count("*").alias("n"), F.sum("dur_ms").alias("total_ms")).select(F.col("window.start").alias("window_start"), "name", "n", "total_ms")


def running_counts(rows: DataFrame) -> DataFrame:
    """Generated rows per cell so far, for update mode."""
    return rows.groupBy("class", "severity").agg(F.count("*").alias("have"))


def verdicts(rows: DataFrame, accept_margin: float) -> DataFrame:
    """Stateless: each row judged as it comes."""
    return rows.withColumn("scorer", F.when(F.col("reward_score") >= accept_margin, "accept").when(F.col("reward_score").isNotNull(), "reject"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the folder that all machines share (spark.checkpoint.dir); only a local session may go without, in a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="verdigris-stream-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drain(stream: DataFrame, out: str, log: str) -> None:
    """Runs an append stream over all that is there and stops."""
    query = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start()
    query.awaitTermination()


def span_stream(spark: SparkSession, spans: DataFrame) -> DataFrame:
    """Span windows of a stored table, taken as a stream of its files."""
    source, out, log = (shared_path(spark, n) for n in ("spans", "span-windows", "span-log"))
    spans.withColumn("ts", F.col("ts").cast("timestamp")).repartition(4).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 2).parquet(source)
    windows = span_windows(stream, late="3650 days")
    schema = windows.schema
    held: list[str] = []

    def keep(df: DataFrame, batch: int) -> None:
        df.write.parquet(f"{out}/batch={batch}")
        held.append(str(batch))

    query = windows.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", log).trigger(availableNow=True).start()
    query.awaitTermination()
    if not held:
        return spark.createDataFrame([], schema)
    rows = spark.read.parquet(out)
    return rows.groupBy("window_start", "name").agg(F.max_by("n", "batch").alias("n"), F.max_by("total_ms", "batch").alias("total_ms"))
