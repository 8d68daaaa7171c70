"""Runs the analysis tables over a paired table, or over a store of runs: analyze.py --paired FILE | --version V [--store DIR] [--out DIR] ..."""

from __future__ import annotations

import argparse
import json
import os
import sys

LABELS = "one of the grades none, minimal, slight, moderate, severe"


def options(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__)
    source = p.add_mutually_exclusive_group(required=True)
    source.add_argument("--version", help="version tag of the runs to analyse")
    source.add_argument("--paired", help="a paired table instead (.parquet or .csv)")
    p.add_argument("--store", help="folder of the store")
    p.add_argument("--experiment", nargs="+", default=[])
    p.add_argument("--out", default="outputs/analysis")
    p.add_argument("--ordinal", action=argparse.BooleanOptionalAction, help="rebuild severity statistics from stored scores (with --version, on unless switched off)")
    p.add_argument("--config", help="JSON file with the queries and gates of each set")
    p.add_argument("--min-level-n", type=int, default=3)
    p.add_argument("--exclude-severity", nargs="+", default=[], metavar="GRADE", help=LABELS)
    p.add_argument("--check-tolerance", type=float, default=1e-9)
    p.add_argument("--image-metrics", choices=["recomputed", "stored"], default="recomputed")
    p.add_argument("--by", nargs="+", default=["metric", "set_name", "query", "category"])
    p.add_argument("--pool-training-sets", action="store_true")
    p.add_argument("--keep-replicates", action="store_true")
    p.add_argument("--k", type=int, default=2)
    p.add_argument("--n-boot", type=int, default=-1, help="resamples for intervals of regret and skill; needs --seed")
    p.add_argument("--seed", type=int, default=-1)
    p.add_argument("--alpha", type=float, default=0.05)
    p.add_argument("--min-n", type=int, default=3)
    p.add_argument("--min-defect-samples", type=int)
    p.add_argument("--replicate-key", default="param_seed")
    p.add_argument("--held-out", default="category")
    p.add_argument("--choose-by", default="skill")
    p.add_argument("--select-by", nargs="+", default=["fixed", "image_auroc@all", "oracle"])
    p.add_argument("--report-metric", nargs="+", default=["image_auroc", "aupro", "pixel_auroc"])
    p.add_argument("--fixed-rank-metric", default="image_auroc")
    p.add_argument("--latex-caption", default="Real score of the model each selection rule picked, per category.")
    p.add_argument("--latex-label", default="tab:selected")
    a = p.parse_args(argv)
    if a.paired and a.ordinal:
        p.error("--ordinal rebuilds from stored scores, which a paired table doesn't have: use --version")
    if a.n_boot > 0 and a.seed < 0:
        p.error("--n-boot needs --seed, 0 or more")
    a.ordinal = not a.paired if a.ordinal is None else a.ordinal
    if a.ordinal and not a.config:
        p.error("--ordinal needs --config, or switch it off with --no-ordinal")
    from verdigris.functions.exprs import SEVERITIES

    a.exclude_severity = sorted({e.strip().lower() for e in a.exclude_severity})
    if unknown := [e for e in a.exclude_severity if e not in SEVERITIES]:
        p.error(f"--exclude-severity: {unknown} is not {LABELS}")
    return a


def load(spark, a: argparse.Namespace):
    """(paired table, tables that say how it came about)."""
    from verdigris.functions.exprs import clean_frame
    from verdigris.operators.recompute import build_ordinal_paired
    from verdigris.sources import store

    if a.paired:
        read = spark.read.option("header", "true").option("inferSchema", "true").csv if a.paired.endswith(".csv") else spark.read.parquet
        return clean_frame(read(a.paired)), {}
    root = store.store_root(spark, a.store)
    if not a.ordinal:
        return store.load_paired_metrics(spark, a.version, root, experiments=tuple(a.experiment)), {}
    runs = store.load_runs(spark, root, a.version, tuple(a.experiment))
    with open(a.config, encoding="utf-8") as f:
        config = json.load(f)
    return build_ordinal_paired(
        runs, store.run_metrics(runs, root), store.run_scores(runs, root), config,
        min_level_n=a.min_level_n, exclude=a.exclude_severity, check_tolerance=a.check_tolerance, image_metrics=a.image_metrics)


def main(argv: list[str] | None = None) -> None:
    a = options(argv)
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from verdigris.functions import report
    from verdigris.operators.planning import run_analyses
    from verdigris.operators.recompute import report_bias

    spark = SparkSession.builder.getOrCreate()
    paired, extra = load(spark, a)
    paired = paired.persist()
    if paired.isEmpty():
        raise SystemExit("the paired table is empty")
    tables = run_analyses(
        paired, by=a.by, pooled=a.pool_training_sets, keep_replicates=a.keep_replicates, k=a.k, min_n=a.min_n, alpha=a.alpha, min_defect_samples=a.min_defect_samples, n_boot=a.n_boot,
        seed=a.seed if a.seed >= 0 else None, held_out=a.held_out, choose_by=a.choose_by, replicate_key=a.replicate_key, selectors=a.select_by, metrics=a.report_metric, rank_metric=a.fixed_rank_metric)
    out = os.path.join(a.out, a.version or os.path.splitext(os.path.basename(a.paired.rstrip("/")))[0])
    for name, df in {**extra, **tables}.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")
    if "combined" in tables:
        combined = spark.read.parquet(f"{out}/combined")
        decided = combined.agg(F.count("*").alias("n"), F.count_if("decidable").alias("d") if "decidable" in combined.columns else F.lit(None).alias("d"), F.count("beats_fixed").alias("told"), F.count_if("beats_fixed").alias("beats")).first()
        print("no replicates: the noise floor is unknown" if decided["d"] is None else f"{decided['d']} of {decided['n']} populations are decidable", file=sys.stderr)
        print(f"{decided['beats']} of {decided['told']} beat the fixed config", file=sys.stderr)
    print(report_bias(spark.read.parquet(f"{out}/calibration")), file=sys.stderr)
    spark.createDataFrame([(json.dumps(vars(a), indent=1),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/run_config")
    if "selected_summary" in tables:
        rows = [r.asDict() for r in spark.read.parquet(f"{out}/selected_summary").collect()]
        text = report.latex_table(rows, metrics=a.report_metric, caption=a.latex_caption, label=a.latex_label)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/selected_summary_tex")
        print(report.format_table(rows))


if __name__ == "__main__":
    main()
