"""A store of runs as a folder: runs.parquet, metrics/<run>.parquet, predictions/<run>/scores.csv, spans as JSON lines."""

from __future__ import annotations

import os
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import clean_frame
from ..operators.pairing import build_paired_metrics
from .readers import SCORES_SCHEMA, _exists, flatten_params, missing_runs, read_run_metrics, read_runs, read_scores

#: Setting (of the session, else of the environment) that names the store.
ROOT, ROOT_ENV = "verdigris.store.root", "VERDIGRIS_STORE_ROOT"
SPAN_SCHEMA = "ts double, dur_ms double, name string, kind string, role string, gpu int, pid long, job string"
SAMPLER = "nvidia-smi.jsonl"


def store_root(spark: SparkSession, root: str | None = None) -> str:
    """Where the store is: as given, else the session's setting, else the environment's. None of them is an error."""
    found = root or spark.conf.get(ROOT, None) or os.environ.get(ROOT_ENV, "").strip()
    if not found:
        raise ValueError(f"no store: give a folder or set {ROOT} or {ROOT_ENV}")
    return found.rstrip("/")


def artefact(root: str, relative: str) -> str:
    """Path of an artefact; Spark's file systems read it where it lies."""
    return f"{root}/{relative.lstrip('/')}"


def _present(runs: DataFrame, found: DataFrame, what: str, on_missing: str) -> DataFrame:
    if on_missing not in ("skip", "raise"):
        raise ValueError(f"on_missing must be skip or raise, not {on_missing!r}")
    own = found.join(runs.select("run_id").distinct(), "run_id", "left_semi")
    lost = missing_runs(runs, own)
    n = lost.count()
    if n:
        head = ", ".join(r["run_id"] for r in lost.orderBy("run_id").limit(3).collect())
        message = f"no {what} for {n} of {runs.count()} runs (such as {head})"
        if on_missing == "raise":
            raise FileNotFoundError(message)
        warnings.warn(message, stacklevel=3)
    return own


def run_metrics(runs: DataFrame, root: str, *, on_missing: str = "skip") -> DataFrame:
    """Metrics of all runs in one scan. Runs without are left out with a warning that counts them, or are an error."""
    spark, pattern = runs.sparkSession, artefact(root, "metrics/*.parquet")
    found = read_run_metrics(spark, pattern) if _exists(spark, pattern) else spark.createDataFrame([], "run_id string, query string, image_auroc double")
    return _present(runs, found, "metrics", on_missing)


def run_scores(runs: DataFrame, root: str, *, on_missing: str = "skip") -> DataFrame:
    """Per-image scores of all runs in one scan, likewise."""
    spark, pattern = runs.sparkSession, artefact(root, "predictions/*/scores.csv")
    if _exists(spark, pattern):
        found = read_scores(spark, pattern)
    else:
        found = spark.createDataFrame([], SCORES_SCHEMA.replace("reward_score string", "reward_score double").replace("defect_area_frac string", "defect_area_frac double") + ", run_id string")
    return _present(runs, found, "predictions", on_missing)


def load_runs(spark: SparkSession, root: str, version: str, experiments: tuple[str, ...] = ()) -> DataFrame:
    """Finished runs of a version with tags and parameters as columns; none is an error."""
    runs = read_runs(spark, artefact(root, "runs.parquet"), version=version, experiments=experiments)
    if runs.isEmpty():
        raise ValueError(f"no finished runs of version {version!r} in {root}")
    return flatten_params(runs)


def load_paired_metrics(spark: SparkSession, version: str, root: str | None = None, *, experiments: tuple[str, ...] = (), on_missing: str = "skip", **pairing) -> DataFrame:
    """The paired table of a version, from the store."""
    root = store_root(spark, root)
    runs = load_runs(spark, root, version, experiments)
    return build_paired_metrics(runs, run_metrics(runs, root, on_missing=on_missing), **pairing)


def write_predictions(predictions: DataFrame, root: str, *, anomaly_maps: bool = False) -> None:
    """Scores of each run as CSV below predictions/<run>; flattened score maps (column anomaly_map) beside them as Parquet only if asked for."""
    scores = predictions.drop("anomaly_map")
    scores.write.mode("append").partitionBy("run_id").option("header", "true").csv(artefact(root, "predictions"))
    if anomaly_maps:
        predictions.select("run_id", "sample_id", "anomaly_map").write.mode("append").partitionBy("run_id").parquet(artefact(root, "anomaly_maps"))


def read_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Profiling spans of all workers' JSON lines by time; the sampler's file isn't one of them. No file gives no rows."""
    if not _exists(spark, f"{folder}/*.jsonl"):
        return spark.createDataFrame([], SPAN_SCHEMA)
    rows = spark.read.schema(SPAN_SCHEMA).option("pathGlobFilter", "*.jsonl").json(folder)
    return clean_frame(rows.where(~F.col("_metadata.file_name").isin(SAMPLER))).orderBy(F.coalesce("ts", F.lit(0.0)))


def read_gpu_ticks(spark: SparkSession, folder: str) -> DataFrame:
    """The sampler's ticks, each with an array of cards."""
    if not _exists(spark, f"{folder}/{SAMPLER}"):
        return spark.createDataFrame([], "ts double, gpus array<struct<index: int, util_gpu: double>>")
    return spark.read.schema("ts double, gpus array<struct<index: int, util_gpu: double, util_mem: double, mem_used_mb: double>>").json(f"{folder}/{SAMPLER}")
