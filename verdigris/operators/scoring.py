"""The verdict pass over manifests: which rows need a verdict, verdicts from judged scores, thresholds anew, reports, rewriting a manifest."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import severity_sort_key
from .corpus import accept_ladder, apply_threshold, margin_quantiles, threshold_change
from .vectors import score_margin


def parse_names(spec: str | Sequence | None) -> set[str] | None:
    """A filter from a list or comma-separated text; nothing in it is no filter."""
    parts = spec.split(",") if isinstance(spec, str) else [] if spec is None else spec
    return {name for part in parts if (name := str(part).strip())} or None


def resolve_scoring(defaults: Mapping, config: Mapping | None = None, flags: Mapping | None = None) -> dict:
    """Settings: defaults, then those of the config's scoring block, then flags that were given. Only known names count."""
    layers = (defaults, (config or {}).get("scoring") or {}, flags or {})
    out = {k: next(v for layer in reversed(layers) if (v := layer.get(k)) is not None or layer is defaults) for k in defaults}
    return {**out, "accept_margin": float(out["accept_margin"])}


def pending(rows: DataFrame, *, categories: set[str] | None = None, rescore: bool = False) -> DataFrame:
    """Rows for the judge: those without a verdict, or all on a rescore, in the categories asked for."""
    own = rows if categories is None else rows.where(F.col("category").isin(*sorted(categories)))
    return own if rescore else own.where("verdict IS NULL")


def judged(rows: DataFrame, scores: DataFrame, noops: DataFrame, *, accept_margin: float, categories: set[str] | None = None, rescore: bool = False, limit: int | None = None, model: str = "") -> DataFrame:
    """rows with verdicts of the judge's scores: edits' (image_id, score) less those of the unedited crop (crop, prompt, score).

    Only pending rows that have a crop, a prompt and a score change, at most limit of them in order of image_id; columns say which judge and threshold decided."""
    wanted = pending(rows, categories=categories, rescore=rescore).where("crop IS NOT NULL AND prompt IS NOT NULL").select("image_id", "crop", "prompt")
    edits = wanted.join(scores.select("image_id", "score"), "image_id")
    if limit is not None:
        edits = edits.orderBy("image_id").limit(limit)
    told = score_margin(edits, noops, accept_margin=accept_margin).where("decision IS NOT NULL")
    told = told.select("image_id", F.col("decision").alias("__decision"), F.col("margin").alias("__margin"), F.col("score").alias("__edit"), F.col("noop_score").alias("__noop"))
    out = rows.join(told, "image_id", "left")
    new = F.col("__decision").isNotNull()
    old = lambda c, kind: F.col(c) if c in rows.columns else F.lit(None).cast(kind)
    filled = {
        "scorer": ("__decision", "string"), "verdict": ("__decision", "string"), "reward_score": ("__margin", "double"), "reward_edit_score": ("__edit", "double"), "reward_noop_score": ("__noop", "double"),
    }
    out = out.withColumns({c: F.when(new, F.col(v)).otherwise(old(c, kind)) for c, (v, kind) in filled.items()})
    out = out.withColumns({"reward_model": F.when(new, F.lit(model)).otherwise(old("reward_model", "string")), "reward_accept_margin": F.when(new, F.lit(float(accept_margin))).otherwise(old("reward_accept_margin", "double"))})
    return out.drop("__decision", "__margin", "__edit", "__noop")


def rethreshold(rows: DataFrame, accept_margin: float, *, categories: set[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with verdicts from stored margins, counts of changed and unscored rows). Rows without a margin, and of other categories, stay as they are."""
    here = F.lit(True) if categories is None else F.col("category").isin(*sorted(categories))
    takes = here & F.col("reward_score").isNotNull()
    new = apply_threshold(rows, accept_margin, column="__new")
    keep = lambda c, value: F.when(takes, value).otherwise(F.col(c) if c in rows.columns else F.lit(None))
    out = new.withColumns({"scorer": keep("scorer", F.col("__new")), "verdict": keep("verdict", F.col("__new")), "reward_accept_margin": keep("reward_accept_margin", F.lit(float(accept_margin)))}).drop("__new")
    return out, threshold_change(rows.where(here), accept_margin, column="verdict")


def margin_report(rows: DataFrame, accept_margin: float, *, steps: int = 7) -> str:
    """Quantiles of the margins, what share each threshold of a ladder accepts, and medians by severity and category."""
    scored = rows.where("reward_score IS NOT NULL")
    rate = F.avg((F.col("reward_score") >= accept_margin).cast("double")).alias("rate")
    whole = scored.agg(F.count("*").alias("n"), rate).first()
    if not whole["n"]:
        return "  no row has a margin yet"
    q = margin_quantiles(scored).first().asDict()
    ladder = accept_ladder(scored, steps=steps).orderBy("step").collect()
    lines = [f"  {whole['n']} rows, {whole['rate']:.1%} accepted at {accept_margin:g}", "  quantiles  " + "  ".join(f"{k} {v:+.3f}" for k, v in q.items() if k != "n")]
    if ladder and ladder[0]["threshold"] < ladder[-1]["threshold"]:
        lines.append("  accepted   " + "  ".join(f"{r['threshold']:+.2f}:{r['accept_rate']:.0%}" for r in ladder))
    for by, order in (("severity", severity_sort_key("severity")), ("category", F.col("category"))):
        groups = scored.groupBy(by).agg(F.count("*").alias("n"), F.median("reward_score").alias("mid"), rate).orderBy(order).collect()
        if by == "severity" or len(groups) > 1:
            lines += [f"  by {by}", *[f"    {r[by]}  n={r['n']} median {r['mid']:+.3f} accepted {r['rate']:.1%}" for r in groups]]
    return "\n".join(lines)


def replace_manifest(rows: DataFrame, path: str) -> None:
    """Rewrites a manifest folder as a whole: JSON lines go to a folder beside it, which takes its place when all of it is written."""
    from ..sources.readers import write_manifest

    spark: SparkSession = rows.sparkSession
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    write_manifest(rows, beside)
    jvm = spark.sparkContext._jvm
    new, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (beside, path))
    fs = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"could not rename {beside} to {path}")


def score_manifest(rows: DataFrame, settings: Mapping, *, mode: str = "score", scores: DataFrame | None = None, noops: DataFrame | None = None, categories: set[str] | None = None, rescore: bool = False, limit: int | None = None) -> tuple[DataFrame, dict]:
    """The whole pass: (rows as they are to be written, what happened). mode: score, rethreshold or dry-run (which changes nothing).

    Running it again takes only rows that still have no verdict, so an interrupted or limited pass goes on where it stopped."""
    margin = settings["accept_margin"]
    if mode == "rethreshold":
        if rescore:
            raise ValueError("rethreshold keeps stored margins, rescore makes new ones: choose one")
        out, change = rethreshold(rows, margin, categories=categories)
        return out, {**change.first().asDict(), "report": margin_report(out, margin)}
    todo = pending(rows, categories=categories, rescore=rescore).count()
    if mode == "dry-run" or not todo:
        return rows, {"pending": todo, "scored": 0, "report": margin_report(rows, margin)}
    if mode != "score" or scores is None or noops is None:
        raise ValueError("a scoring pass needs the judge's scores of edits and of unedited crops")
    out = judged(rows, scores, noops, accept_margin=margin, categories=categories, rescore=rescore, limit=limit, model=str(settings.get("checkpoint", "")))
    left = pending(out, categories=categories).count()
    return out, {"pending": todo, "left": left, "report": margin_report(out, margin)}
