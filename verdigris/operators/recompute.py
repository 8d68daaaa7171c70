"""Severity statistics rebuilt from stored scores: predictions, grade schemes, the check against stored metrics, the ordinal paired table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import SEVERITIES, numbered, parent_name, path_stem, severity_rank
from .correlation import bias_keys, worst_cells
from .detection import queries_for, query_metrics
from .pairing import augment_metrics, build_paired_metrics, check_image_auroc

#: Columns of a prediction, in the order they are stored in.
PREDICTION = ("sample_id", "image_path", "class_name", "label", "mask_path", "score", "scorer", "severity", "mask_status", "reward_score", "defect_area_frac")
IMAGE_METRICS = ("image_auroc", "image_aupr")


def sample_id(place: Column, path: Column) -> Column:
    """Five digits of the place, folder and stem of the image: folders tell equal stems apart."""
    return F.concat(F.lpad(place.cast("string"), 5, "0"), F.lit("_"), parent_name(path), F.lit("_"), path_stem(path))


def build_predictions(batches: DataFrame, order: Sequence[str]) -> DataFrame:
    """Per-image rows of scored batches, numbered in order; images without a mask have an empty path. A row without a score is an error."""
    scored = F.when(F.col("score").isNotNull(), F.col("score")).otherwise(F.raise_error(F.concat(F.lit("no score for "), F.col("image_path"))).cast("double"))
    rows = numbered(batches, order, "__place").withColumns({"score": scored, "mask_path": F.coalesce("mask_path", F.lit(""))})
    return rows.withColumn("sample_id", sample_id(F.col("__place"), F.col("image_path"))).select(*[c for c in PREDICTION if c in rows.columns or c == "sample_id"])


def flat_record(metrics: DataFrame, names: Sequence[str], extra: str = "extra") -> DataFrame:
    """Metric records with listed entries of their map of extra metrics as columns of their own, query first."""
    own = [c for c in metrics.columns if c not in (extra, "query")]
    return metrics.select(*[c for c in ("query",) if c in metrics.columns], *own, *[F.col(extra)[n].alias(n) for n in names if n not in own])


def add_record(records: DataFrame, metrics: DataFrame, name: str) -> DataFrame:
    """records and one more, under its query's name."""
    return records.unionByName(metrics.withColumn("query", F.lit(name)), allowMissingColumns=True)


def severity_scheme(rows: DataFrame, by: Sequence[str], column: str = "severity") -> DataFrame:
    """(by, graded): whether a group has any grade of the ladder beyond none, and so an order."""
    return rows.groupBy(*by).agg(F.coalesce(F.max(severity_rank(column)) > 0, F.lit(False)).alias("graded"))


def vocabulary(rows: DataFrame, by: Sequence[str], column: str = "severity") -> DataFrame:
    """(by, grades, others): names of a group that the ladder knows, in its order, and those it doesn't, alphabetically."""
    names = F.collect_set(F.lower(F.trim(F.col(column))))
    ladder = F.array(*[F.lit(s) for s in SEVERITIES])
    return rows.groupBy(*by).agg(names.alias("__names")).select(*by, F.array_intersect(ladder, "__names").alias("grades"), F.sort_array(F.array_except("__names", ladder)).alias("others"))


def scorer_order(values: DataFrame, column: str = "scorer") -> DataFrame:
    """Distinct verdict names, the pooled one first, then alphabetically."""
    return values.select(column).distinct().orderBy(F.col(column) != "all", column)


def recompute_severity(runs: DataFrame, scores: DataFrame, config: Mapping, *, min_level_n: int = 3, exclude: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(records, skipped) of all runs (run_id, set_name) from their scores (run_id, ...), each set with its own queries.

    skipped lists runs of sets without queries and runs without scores, with the reason. Excluded grades concern the ordinal statistics alone."""
    known = sorted(config.get("queries") or {})
    has_scores = scores.select("run_id").distinct().withColumn("__scored", F.lit(True))
    seen = runs.select("run_id", "set_name").join(has_scores, "run_id", "left")
    skipped = seen.select("run_id", "set_name", F.when(~F.coalesce(F.col("set_name").isin(*known), F.lit(False)), "no queries").when(F.col("__scored").isNull(), "no scores").alias("reason")).where("reason IS NOT NULL")
    found = None
    for name in known:
        own = scores.join(runs.where(F.col("set_name") == name).select("run_id"), "run_id", "left_semi")
        records = query_metrics(own, queries_for(dict(config), name, scores), min_level_n=min_level_n, exclude=exclude)
        found = records if found is None else found.unionByName(records)
    if found is None:
        raise ValueError("the configuration has no queries")
    return found, skipped


def build_ordinal_paired(
    runs: DataFrame, stored: DataFrame, scores: DataFrame, config: Mapping, *, min_level_n: int = 3, exclude: Sequence[str] = (), check_tolerance: float = 1e-9, image_metrics: str = "recomputed", **pairing,
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The paired table over stored metrics with the severity statistics beside them, and the tables that say how it came about.

    Stored image metrics are replaced by those of the same rows the statistics come from, or, with image_metrics='stored', must agree with them."""
    if image_metrics not in ("recomputed", "stored"):
        raise ValueError(f"image_metrics must be recomputed or stored, not {image_metrics!r}")
    records, skipped = recompute_severity(runs, scores, config, min_level_n=min_level_n, exclude=exclude)
    records = records.persist()
    if records.where("n_samples > 0").isEmpty():
        raise ValueError("no run has scores that a query selects")
    check = check_image_auroc(stored, records)
    if image_metrics == "stored":
        apart = check.where(F.col("delta") > check_tolerance).count()
        if apart:
            raise ValueError(f"stored image AUROC differs from the recomputed one on {apart} rows by more than {check_tolerance:g}: they come from other rows than the severity statistics")
    recomputed = records.drop("n_samples", "n_good_samples", "n_defect_samples")
    augmented = augment_metrics(stored, recomputed, prefer_recomputed=IMAGE_METRICS if image_metrics == "recomputed" else ())
    if augmented.where("n_severity_levels >= 2").isEmpty():
        raise ValueError(f"no run has two severity grades to order (sets with queries: {sorted(config.get('queries') or {})})")
    return build_paired_metrics(runs, augmented, **pairing), {"metrics_augmented": augmented, "severity_check": check, "skipped_runs": skipped}


def report_bias(calibration: DataFrame, *, n: int = 10) -> str:
    """How many populations the synthetic arm over- or underestimates, and the largest decided gaps."""
    total, over, under = calibration.agg(F.count("*"), F.count_if(F.col("overestimates")), F.count_if(~F.col("overestimates"))).first()
    if not total:
        return "no populations with both arms"
    keys = [c for c in bias_keys(calibration.columns) if c in ("set_name", "severity", "scorer", "category") or c.startswith("param_")]
    lines = [f"{over + under} of {total} populations have a decided gap: {over} overestimated, {under} underestimated"]
    for r in worst_cells(calibration, n=n).collect():
        where = ", ".join(f"{k}={r[k]}" for k in keys if k in calibration.columns)
        lines.append(f"  {r['bias']:+.3f} {r['metric'] if 'metric' in calibration.columns else ''} ({where}; sd {r['bias_sd']:.3f} of {r['n']})")
    return "\n".join(lines)
