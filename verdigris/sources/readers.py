"""Readers and writers of the analysis inputs: run logs, per-run metrics and scores, manifests, prompts, pools, image trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import clean_frame, numbered, parent_name, path_stem

#: The columns of per-image scores.
SCORES_SCHEMA = (
    "sample_id string, image_path string, class_name string, label int, mask_path string, score double, scorer string, severity string, mask_status string, "
    "reward_score string, defect_area_frac string"
)
MANIFEST_SCHEMA = (
    "image_id string, source_image_id string, roi_id string, generation_id string, category string, class string, severity string, prompt_id string, prompt string, seed long, "
    "attempt_index int, timestamp string, scorer string, vlm_decision string, reward_score double, mask_status string, mask_coverage double, defect_area_frac double, crop_box array<int>, "
    "negative boolean, region_mode string, region_stage string, region_shape string, image_path string, mask_path string"
)
PROMPT_SCHEMA = (
    "benchmark string, category string, grading_mode string, severity_scale array<string>, "
    "generation_prompts array<struct<mode: string, stage: string, region_of_interest: string, region_shape: string, negatives: array<string>, prompt: string>>"
)
LEGACY = ("vlm_decision", "vlm_reason", "vlm_score", "vlm_model", "vlm_raw")


def path_column() -> Column:
    return F.col("_metadata.file_path")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return bool(found)


def read_runs(spark: SparkSession, path: str, *, finished_only: bool = True, version: str | None = None, experiments: Sequence[str] = ()) -> DataFrame:
    """The run log; NaN and infinities become NULL. A missing store is an empty log."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "run_id string, status string, artifact_uri string, start_time timestamp, tags map<string,string>, params map<string,string>")
    runs = clean_frame(spark.read.parquet(path))
    if finished_only:
        runs = runs.where("status = 'FINISHED'")
    if version is not None:
        runs = runs.where((F.col("tags")["version"] if "tags" in runs.columns else F.col("version")) == version)
    return runs.where(F.col("experiment").isin(*experiments)) if experiments else runs


def flatten_params(runs: DataFrame, tags: Sequence[str] = ("set_name", "category", "version"), params: Sequence[str] | None = None) -> DataFrame:
    """Maps of tags and parameters to columns. Without a list the parameters' names are looked up (one aggregation)."""
    if params is None:
        params = sorted(r[0] for r in runs.select(F.explode(F.map_keys("params"))).distinct().collect())
    return runs.select("run_id", "status", "start_time", *[F.col("tags")[t].alias(t) for t in tags], *[F.col("params")[p].alias(f"param_{p.replace('.', '_')}") for p in params])


def read_run_metrics(spark: SparkSession, pattern: str) -> DataFrame:
    """Metrics of all runs in one scan; run_id from the file's name."""
    rows = spark.read.option("mergeSchema", "true").parquet(pattern)
    return clean_frame(rows.withColumn("run_id", F.regexp_extract(path_column(), r"([^/]+)\.parquet$", 1)))


def missing_runs(runs: DataFrame, found: DataFrame) -> DataFrame:
    return runs.join(found.select("run_id").distinct(), "run_id", "left_anti")


def read_scores(spark: SparkSession, pattern: str, *, run_from: str = r"/([^/]+)/[^/]+\.csv$") -> DataFrame:
    """Per-image scores of all runs; empty fields are missing."""
    rows = spark.read.schema(SCORES_SCHEMA).option("header", "true").option("enforceSchema", "false").csv(pattern)
    return clean_frame(rows.withColumns({
        "run_id": F.regexp_extract(path_column(), run_from, 1), "reward_score": F.expr("try_cast(reward_score AS double)"),
        "defect_area_frac": F.expr("try_cast(defect_area_frac AS double)"), "mask_path": F.nullif("mask_path", F.lit("")),
    }))


def read_manifests(spark: SparkSession, root: str, *, recursive: bool = False, pattern: str = "generation_manifest*") -> DataFrame:
    """All manifests of a folder; with recursive below it too, but for folders whose name ends in _backup. No file gives no rows.

    has_scorer says whether a row's own verdict is there, even if empty."""
    if not _exists(spark, root):
        return spark.createDataFrame([], f"{MANIFEST_SCHEMA}, has_scorer boolean, verdict string")
    text = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).text(root)
    inside = F.regexp_replace(path_column(), F.lit("^.*" + root.rstrip("/").split("/")[-1] + "/"), F.lit(""))
    text = text.where((F.trim("value") != "") & ~inside.rlike(r"_backup/"))
    keys = F.json_object_keys("value")
    rows = text.select(F.from_json("value", MANIFEST_SCHEMA).alias("r"), F.coalesce(F.array_contains(keys, "scorer"), F.lit(False)).alias("has_scorer"))
    rows = rows.select("r.*", "has_scorer")
    return clean_frame(rows).withColumn("verdict", F.lower(F.when(F.col("has_scorer"), F.col("scorer")).otherwise(F.col("vlm_decision"))))


def negative_rows(rows: DataFrame) -> DataFrame:
    """A negatives' manifest; a row that isn't a negative control is an error."""
    return rows.withColumn("negative", F.when(F.coalesce("negative", F.lit(False)), True).otherwise(F.raise_error(F.lit("a row isn't a negative control")).cast("boolean")))


def eval_samples(manifest: DataFrame, *, severity: Sequence[str] = (), verdicts: Sequence[str] = (), negatives: DataFrame | None = None, good: DataFrame | None = None) -> DataFrame:
    """Generated defects by verdict and severity, with negative controls and good frames beside them (label 0)."""
    columns = ["sample_id", "image_path", "label", "severity", "scorer", "mask_status", "reward_score", "defect_area_frac"]

    def shaped(df: DataFrame, label: int) -> DataFrame:
        null = lambda c, t: F.col(c) if c in df.columns else F.lit(None).cast(t)
        return df.select(
            null("image_id", "string").alias("sample_id"), null("image_path", "string").alias("image_path"), F.lit(label).alias("label"),
            (F.lit("none") if label == 0 else F.coalesce(F.lower("severity"), F.lit("none"))).alias("severity"), (F.lit("none") if label == 0 else null("verdict", "string")).alias("scorer"),
            F.coalesce(null("mask_status", "string"), F.lit("unknown")).alias("mask_status"), null("reward_score", "double").alias("reward_score"), null("defect_area_frac", "double").alias("defect_area_frac"))

    rows = manifest
    if severity:
        rows = rows.where(F.lower("severity").isin(*severity))
    if verdicts:
        rows = rows.where(F.col("verdict").isin(*verdicts))
    out = shaped(rows, 1)
    for extra in (negatives, good):
        if extra is not None:
            out = out.unionByName(shaped(extra, 0))
    return out.select(columns)


def read_prompts(spark: SparkSession, pattern: str, *, category: str | None = None, modes: Sequence[str] = (), stages: Sequence[str] = ()) -> DataFrame:
    """Prompts of JSON files, one row each; the category defaults to the file's name. A prompt without text, mode or stage is an error."""
    docs = spark.read.schema(PROMPT_SCHEMA).option("multiLine", "true").json(pattern).withColumn("category", F.coalesce("category", path_stem(path_column())))
    rows = docs.select("benchmark", "category", "grading_mode", F.posexplode("generation_prompts").alias("pos", "p")).select("benchmark", "category", "grading_mode", "pos", "p.*")
    whole = F.col("prompt").isNotNull() & F.col("mode").isNotNull() & F.col("stage").isNotNull()
    rows = rows.withColumn("prompt", F.when(whole, F.col("prompt")).otherwise(F.raise_error(F.concat(F.lit("incomplete prompt in "), F.col("category")))))
    for column, values in (("category", [category] if category else []), ("mode", modes), ("stage", stages)):
        if values:
            rows = rows.where(F.col(column).isin(*values))
    return rows


def read_pools(spark: SparkSession, path: str) -> DataFrame | None:
    """(seed, frame) of a pools file, None if there is none."""
    if not _exists(spark, path):
        return None
    rows = spark.read.schema("n_train int, pools map<string, array<string>>").option("multiLine", "true").json(path)
    return rows.select(F.explode("pools").alias("seed", "frames")).select(F.col("seed").cast("int").alias("seed"), F.explode("frames").alias("frame"))


def pool_for_seed(pools: DataFrame | None, seed: int) -> DataFrame | None:
    """The frames of a seed; an unknown seed is an error, no pools give none."""
    if pools is None:
        return None
    own = pools.where(F.col("seed") == seed)
    if own.isEmpty():
        raise KeyError(f"no pool for seed {seed}")
    return own.select("frame")


def list_images(spark: SparkSession, root: str, *, extensions: Sequence[str] = ("png", "jpg", "jpeg", "bmp"), recursive: bool = True) -> DataFrame:
    """Image paths below a folder with stem and parent; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root).select("path", "length")
    files = files.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*extensions))
    return files.withColumns({"stem": path_stem(F.col("path")), "parent": parent_name(F.col("path"))})


def image_records(files: DataFrame, split: str) -> DataFrame:
    """Records of an image tree category/split/kind/file: label by kind, mask path by naming rule."""
    parts = F.split("path", "/")
    at = lambda i: F.try_element_at(parts, F.lit(i))
    rows = files.withColumns({"class_name": at(-2), "split": at(-3), "category": at(-4)}).where(F.col("split") == split)
    mask = F.concat(F.array_join(F.slice(parts, 1, F.size(parts) - 3), "/"), F.lit("/ground_truth/"), F.col("class_name"), F.lit("/"), F.col("stem"), F.lit("_mask.png"))
    return rows.withColumns({"label": F.when(F.col("class_name") == "good", 0).otherwise(1), "mask_path": F.when(F.col("class_name") != "good", mask), "scorer": F.lit("real"), "severity": F.lit("real"), "mask_status": F.lit("real")})


def missing_categories(wanted: DataFrame, present: DataFrame) -> DataFrame:
    return wanted.select("category").distinct().join(present.select("category").distinct(), "category", "left_anti")


def write_metrics(metrics: DataFrame, path: str, partition: Sequence[str] = ("version",)) -> None:
    metrics.write.mode("append").partitionBy(*[c for c in partition if c in metrics.columns]).parquet(path)


def write_manifest(rows: DataFrame, path: str, *, append: bool = False) -> None:
    """JSON lines, legacy verdict columns dropped."""
    rows.drop(*LEGACY).write.mode("append" if append else "overwrite").json(path)


def write_pools(pools: DataFrame, path: str, n_train: int) -> None:
    """(seed, frame) as one small JSON document, seeds in order."""
    by_seed = pools.groupBy("seed").agg(F.sort_array(F.collect_list("frame")).alias("frames"))
    whole = by_seed.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("seed").cast("string").alias("key"), F.col("frames").alias("value"))))).alias("pools"))
    whole.select(F.lit(n_train).alias("n_train"), "pools").coalesce(1).write.mode("errorifexists").json(path)


def chrome_trace(spans: DataFrame) -> DataFrame:
    """Spans as trace events: microsecond start, duration, processes numbered densely."""
    pids = numbered(spans.select("pid").distinct(), ["pid"], "process")
    start = F.unix_micros(F.col("ts").cast("timestamp")) - (F.col("dur_ms") * 1000).cast("long")
    return spans.join(pids, "pid").select(F.to_json(F.struct("name", F.lit("X").alias("ph"), start.alias("ts"), (F.col("dur_ms") * 1000).cast("long").alias("dur"), F.col("process").alias("pid"), F.col("gpu").alias("tid"))).alias("event"))


def gpu_samples(samples: DataFrame) -> DataFrame:
    """One row per card and tick of sampler records with an array of cards."""
    return samples.select("ts", F.explode("gpus").alias("g")).select("ts", "g.*")
