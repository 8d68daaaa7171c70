"""From logged runs to the paired fact table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import latest_per_key, null_safe_join, numbered
from .correlation import PROXY_ONLY

#: Columns of the metrics table that can be compared between arms.
METRIC_COLUMNS = ("image_auroc", "pixel_auroc", "image_aupr", "pixel_aupr", "aupro", *PROXY_ONLY)
REAL_SET = "real"


def default_group_keys(runs: DataFrame) -> list[str]:
    return [*[c for c in ("category", "version") if c in runs.columns], *sorted(c for c in runs.columns if c.startswith("param_"))]


def latest_runs(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The latest run of each key, then the smallest run id."""
    return latest_per_key(runs, keys, "start_time", "run_id")


def pair_runs(runs: DataFrame, *, group_keys: Sequence[str] | None = None, duplicates: str = "latest", on_unpaired: str = "drop") -> DataFrame:
    """One row per (model config, synthetic set): its real run beside its synthetic run. NULL key values meet each other.

    model_id numbers the paired configs in key order. duplicates='error' and on_unpaired='error' raise when evaluated."""
    keys = list(group_keys or default_group_keys(runs))
    done = runs.where("status = 'FINISHED'") if "status" in runs.columns else runs
    if duplicates == "error":
        w = Window.partitionBy(*keys, "set_name")
        done = done.withColumn("__n", F.when(F.count("*").over(w) > 1, F.raise_error(F.lit("several runs of one config and set"))).otherwise(F.lit(1))).where("__n = 1").drop("__n")
    one = latest_runs(done, [*keys, "set_name"])
    real = one.where(F.col("set_name") == REAL_SET).select(*keys, F.col("run_id").alias("real_run_id"))
    synth = one.where(F.col("set_name") != REAL_SET).select(*keys, "set_name", F.col("run_id").alias("synth_run_id"))
    if on_unpaired == "error":
        found = null_safe_join(real, synth, keys, "full_outer")
        found = found.withColumn("real_run_id", F.when(F.col("real_run_id").isNull() | F.col("synth_run_id").isNull(), F.raise_error(F.lit("config without both arms"))).otherwise(F.col("real_run_id")))
    else:
        found = null_safe_join(synth, real, keys)
    configs = found.select(*keys).distinct()
    models = numbered(configs, [F.col(k).asc_nulls_last() for k in keys], "model_id")
    return null_safe_join(found, models, keys).select("model_id", "real_run_id", "synth_run_id", "set_name", *keys)


def unpaired_runs(runs: DataFrame, *, group_keys: Sequence[str] | None = None) -> DataFrame:
    """Configs that miss an arm, with which one."""
    keys = list(group_keys or default_group_keys(runs))
    done = runs.where("status = 'FINISHED'") if "status" in runs.columns else runs
    arms = done.groupBy(*keys).agg(F.count_if(F.col("set_name") == REAL_SET).alias("n_real"), F.count_if(F.col("set_name") != REAL_SET).alias("n_synth"))
    return arms.where("n_real = 0 OR n_synth = 0").withColumn("missing", F.when(F.col("n_real") == 0, "real").otherwise("synth"))


def melt_metrics(metrics: DataFrame, value_name: str, keep: Sequence[str], columns: Sequence[str] = METRIC_COLUMNS) -> DataFrame:
    """Wide to long over the metric columns present; rows without a value stay."""
    present = [c for c in columns if c in metrics.columns]
    wide = metrics.select(*keep, *[F.col(c).cast("double").alias(c) for c in present])
    return wide.unpivot(list(keep), present, "metric", value_name)


def with_proxy_targets(real_long: DataFrame, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Rows of proxy-only metrics replaced by the target metric's rows under the proxy's name."""
    mapping = dict(mapping) if mapping is not None else dict.fromkeys(PROXY_ONLY, "image_auroc")
    spark = real_long.sparkSession
    pairs = F.broadcast(spark.createDataFrame(list(mapping.items()), "proxy string, __target string"))
    rest = real_long.where(~F.col("metric").isin(*mapping))
    target = real_long.join(pairs, F.col("metric") == F.col("__target")).withColumn("metric", F.col("proxy")).drop("proxy", "__target")
    return rest.unionByName(target)


def build_paired_metrics(runs: DataFrame, metrics: DataFrame, *, group_keys: Sequence[str] | None = None, duplicates: str = "latest", on_unpaired: str = "drop", mapping: Mapping[str, str] | None = None) -> DataFrame:
    """The fact table from a run log and a (run, query) metrics table."""
    pairs = pair_runs(runs, group_keys=group_keys, duplicates=duplicates, on_unpaired=on_unpaired)
    counts = [c for c in ("n_samples", "n_defect_samples") if c in metrics.columns]
    synth = melt_metrics(metrics, "synth", ["run_id", "query", *counts]).withColumnRenamed("run_id", "synth_run_id")
    real = with_proxy_targets(melt_metrics(metrics.where("query = 'all'"), "real", ["run_id"]), mapping).withColumnRenamed("run_id", "real_run_id")
    out = pairs.join(synth, "synth_run_id").join(real, ["real_run_id", "metric"], "left")
    keys = [c for c in pairs.columns if c not in ("model_id", "real_run_id", "synth_run_id", "set_name")]
    return out.select("model_id", "set_name", *keys, "query", "metric", "real", "synth", *counts, "real_run_id", "synth_run_id")


def augment_metrics(stored: DataFrame, recomputed: DataFrame, *, prefer_recomputed: Sequence[str] = ()) -> DataFrame:
    """Stored rows with the recomputed statistics of (run, query) beside them; listed columns are replaced where recomputed."""
    on = ["run_id", "query"]
    new = [c for c in recomputed.columns if c not in on and (c not in stored.columns or c in prefer_recomputed)]
    right = recomputed.select(*on, *[F.col(c).alias(f"__new_{c}") for c in new])
    out = stored.join(right, on, "left")
    return out.select(*[F.coalesce(f"__new_{c}", c).alias(c) if c in new else F.col(c) for c in stored.columns], *[F.col(f"__new_{c}").alias(c) for c in new if c not in stored.columns])


def check_image_auroc(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Stored against recomputed image AUROC, largest difference first."""
    a = stored.select("run_id", "query", F.col("image_auroc").alias("stored"))
    b = recomputed.select("run_id", "query", F.col("image_auroc").alias("recomputed"))
    out = a.join(b, ["run_id", "query"]).withColumn("delta", F.abs(F.col("stored") - F.col("recomputed")))
    return out.orderBy(F.col("delta").desc_nulls_last(), "run_id", "query")


def artefact_path(uri, relative, root: str | None = None):
    """Column: a run's artefact folder URI to a path, without touching storage."""
    base = F.regexp_replace(F.regexp_replace(uri, r"^file://", ""), r"^[a-z-]+-artifacts:/*", f"{root or ''}/")
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), relative)
