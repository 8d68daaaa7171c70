"""Planning helpers: overlays of settings, prompt compilation, category plans, size calibration, region settings."""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import SEVERITIES, null_safe_join

#: Settings that a category may override, short forms first.
SHORTHAND = {"crop": "cropping", "masks": "masks", "cropping": "cropping", "blending": "blending", "generation": "generation", "regions": "regions"}
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "bmp", "tif", "tiff")


def flatten_overlay(node: Mapping, prefix: str = "") -> list[tuple[str, object]]:
    """Nested settings as dotted names and leaves."""
    out = []
    for k, v in node.items():
        out += flatten_overlay(v, f"{prefix}{k}.") if isinstance(v, Mapping) else [(f"{prefix}{k}", v)]
    return out


def normalize_override(block: Mapping, *, category: str) -> dict:
    """Short forms of a category's overrides written out; an unknown block is an error."""
    unknown = sorted(k for k in block if k.split(".")[0] not in SHORTHAND)
    if unknown:
        raise KeyError(f"{category}: unknown overrides {unknown}")
    out: dict = {}
    for k, v in block.items():
        head, *rest = k.split(".")
        node = out.setdefault(SHORTHAND[head], {})
        for part in rest[:-1]:
            node = node.setdefault(part, {})
        if rest:
            node[rest[-1]] = v
        elif isinstance(v, Mapping):
            node.update(v)
        else:
            raise TypeError(f"{category}: {k} must be a mapping")
    return out


def apply_overlay(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """(category, path, value) settings with each category's overlay on top; base settings hold for every category of the overlay."""
    everywhere = overlay.select("category").distinct().crossJoin(F.broadcast(base.select("path", "value")))  # as many as there are settings
    out = null_safe_join(everywhere, overlay.select("category", "path", F.col("value").alias("own")), ["category", "path"], "full_outer")
    return out.select("category", "path", F.coalesce("own", "value").alias("value"))


def compile_prompts(stages: DataFrame, *, suffix: str = "", required: Sequence[str] = SEVERITIES[1:]) -> DataFrame:
    """Prompt rows of (category, mode, stage, description, region, negatives); modes that miss a required grade are left out.

    The text is the description, its place, the constraints and a fixed suffix; white space is collapsed."""
    from .corpus import normalize_negatives, render_negatives

    whole = Window.partitionBy("category", "mode")
    complete = F.size(F.array_except(F.array(*[F.lit(s) for s in required]), F.collect_set("stage").over(whole))) == 0
    rows = stages.withColumn("__complete", complete).where("__complete").drop("__complete").withColumn("negatives", normalize_negatives(F.coalesce("negatives", F.array().cast("array<string>"))))
    place = F.when(F.coalesce("region", F.lit("")) != "", F.concat(F.lit(" Only on "), F.col("region"), F.lit("."))).otherwise("")
    text = F.concat(F.col("description"), place, F.lit(" "), render_negatives(F.col("negatives")), F.lit(suffix))
    return rows.withColumn("prompt", F.trim(F.regexp_replace(text, r"\s+", " ")))


def skipped_modes(stages: DataFrame, required: Sequence[str] = SEVERITIES[1:]) -> DataFrame:
    found = stages.groupBy("category", "mode").agg(F.collect_set("stage").alias("stages"))
    missing = F.array_except(F.array(*[F.lit(s) for s in required]), F.col("stages"))
    return found.where(F.size(missing) > 0).select("category", "mode", F.sort_array(missing).alias("missing"))


def check_names(compiled: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Categories that only one of the two documents names."""
    a, b = compiled.select("category").distinct().withColumn("compiled", F.lit(True)), taxonomy.select("category").distinct().withColumn("taxonomy", F.lit(True))
    return a.join(b, "category", "full_outer").where("compiled IS NULL OR taxonomy IS NULL").select("category", F.coalesce("compiled", F.lit(False)).alias("compiled"), F.coalesce("taxonomy", F.lit(False)).alias("taxonomy"))


def description_failures(text: Column, forbidden: Sequence[str], *, most_chars: int = 300, least_words: int = 3) -> Column:
    tokens = F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda x: x != "")
    named = F.array_intersect(tokens, F.array(*[F.lit(f) for f in forbidden])) if forbidden else F.array().cast("array<string>")
    checks = F.array_compact(F.array(F.when(F.trim(text) == "", "empty"), F.when(F.length(text) > most_chars, "too long"), F.when(F.size(tokens) < least_words, "too few words")))
    return F.concat(checks, F.transform(named, lambda x: F.concat(F.lit("names "), x)))


def apply_descriptions(plan: DataFrame, given: DataFrame, forbidden: Sequence[str] = ()) -> DataFrame:
    """Descriptions set by category where they pass; failures are listed beside the old text."""
    out = plan.join(given.select("category", F.col("description").alias("__new")), "category", "left")
    failures = F.when(F.col("__new").isNotNull(), description_failures(F.col("__new"), forbidden)).otherwise(F.array().cast("array<string>"))
    out = out.withColumn("failures", failures)
    return out.withColumn("description", F.when(F.col("__new").isNotNull() & (F.size("failures") == 0), F.col("__new")).otherwise(F.col("description"))).drop("__new")


def path_tokens(path: Column) -> Column:
    return F.filter(F.split(F.lower(path), "/"), lambda x: x != "")


def is_image(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, r"\."), -1)).isin(*IMAGE_EXTENSIONS)


def scan_categories(files: DataFrame, *, good: Sequence[str] = ("good", "normal"), skip: Sequence[str] = ("ground_truth", "mask", "masks"), samples: int = 4) -> DataFrame:
    """One plan row per category of (path relative to the root): image counts, folders by kind, first sample images."""
    rows = files.where(is_image(F.col("path"))).withColumn("t", path_tokens(F.col("path"))).where(F.size("t") >= 2)
    words = lambda names: F.array(*[F.lit(n) for n in names])
    rows = rows.where(~F.arrays_overlap("t", words(skip))).withColumns({"category": F.col("t")[0], "is_good": F.arrays_overlap("t", words(good)), "folder": F.array_join(F.slice("t", 1, F.size("t") - 1), "/")})
    place = F.row_number().over(Window.partitionBy("category", "is_good").orderBy("path"))
    rows = rows.withColumn("place", place)
    return rows.groupBy("category").agg(
        F.count_if(~F.col("is_good")).alias("n_defect"), F.count_if("is_good").alias("n_good"), F.count_distinct("folder").alias("n_folders"),
        F.sort_array(F.collect_list(F.when((F.col("place") <= samples) & ~F.col("is_good"), F.col("path")))).alias("samples"))


def with_prior(plan: DataFrame, prior: DataFrame, columns: Sequence[str] = ("description",)) -> DataFrame:
    """Annotations of an earlier plan carried over by category."""
    return plan.join(prior.select("category", *columns), "category", "left")


def usable_rows(rows: DataFrame, statuses: Sequence[str] = ("ok",)) -> DataFrame:
    """Generated defects whose mask was accepted and isn't blank."""
    return rows.where(~F.coalesce("negative", F.lit(False)) & F.col("mask_status").isin(*statuses) & (F.col("mask_coverage") > 0))


def cell_measures(rows: DataFrame, edge: int) -> DataFrame:
    """Median mask area in pixels of each cell."""
    return usable_rows(rows).groupBy("class", "severity").agg(F.median(F.col("mask_coverage") * edge * edge).alias("area"), F.count("*").alias("n"))


def sizes_for(shape: Column, area: Column, edge: int, *, most: float = 0.45) -> Column:
    """Region size from an area: a blob's radius, a line's length, a cluster's spread, as shares of the edge and capped."""
    radius = F.sqrt(area / math.pi)
    size = F.when(shape == "line", F.sqrt(area) * 2).when(shape == "cluster", radius * 1.5).otherwise(radius)
    return F.least(F.lit(most), size / edge)


def region_spec(cells: DataFrame, by_cell: DataFrame, by_shape: DataFrame, default: float) -> DataFrame:
    """Region size of each (mode, stage, shape): its own, else its shape's, else the default."""
    out = cells.join(by_cell.select("mode", "stage", F.col("size").alias("own")), ["mode", "stage"], "left").join(by_shape.select("shape", F.col("size").alias("shared")), "shape", "left")
    return out.withColumn("size", F.coalesce("own", "shared", F.lit(default))).drop("own", "shared")


def resolve_shape(prompt_shape: Column, mode_shape: Column, default: str = "blob") -> Column:
    return F.coalesce(F.nullif(prompt_shape, F.lit("")), F.nullif(mode_shape, F.lit("")), F.lit(default))


def pipeline_checks(tables: Mapping[str, DataFrame | None], finite: Sequence[tuple[str, str]] = ()) -> list[tuple[str, bool]]:
    """(check, passed): tables there and not empty, listed columns with at least one finite value."""
    out = [(f"{name} has rows", df is not None and not df.isEmpty()) for name, df in tables.items()]
    for name, column in finite:
        df = tables.get(name)
        out.append((f"{name}.{column} is finite", df is not None and column in df.columns and df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).limit(1).count() == 1))
    return out


def collapse_replicates(paired: DataFrame, by: Sequence[str], *, replicate_key: str = "param_seed", keep: bool = False) -> DataFrame:
    """Replicates averaged, unless they are asked for, are populations of their own (a grouping key), or there are none."""
    from . import selection as S

    if keep or replicate_key in by or replicate_key not in paired.columns:
        return paired
    return S.aggregate_replicates(paired, replicate_key=replicate_key)


def run_selected(paired: DataFrame, by: Sequence[str], *, selectors: Sequence[str], metrics: Sequence[str], held_out: str = "category", rank_metric: str = "image_auroc", replicate_key: str = "param_seed", min_n: int = 3) -> dict[str, DataFrame]:
    """What each rule picked and its summary; nothing where no parameter tells configs apart or no population has min_n of them."""
    from . import selected as W

    try:
        picked = W.selected_metrics(paired, by=by, selectors=selectors, metrics=metrics, held_out=held_out, rank_metric=rank_metric, replicate_key=replicate_key, min_n=min_n)
    except (KeyError, ValueError) as error:
        warnings.warn(f"no table of achieved metrics: {error}", stacklevel=2)
        return {}
    if picked.isEmpty():
        warnings.warn(f"no table of achieved metrics: no population has {min_n} configs", stacklevel=2)
        return {}
    return {"selected": picked, "selected_summary": W.summarise_selected(picked)}


def run_analyses(
    paired: DataFrame, *, by: Sequence[str] = ("metric", "set_name", "query", "category"), pooled: bool = False, keep_replicates: bool = False, k: int = 2, min_n: int = 3, alpha: float = 0.05,
    min_defect_samples: int | None = None, n_boot: int = 0, seed: int | None = None, held_out: str = "category", choose_by: str = "skill", replicate_key: str = "param_seed",
    selectors: Sequence[str] = ("fixed", "image_auroc@all", "oracle"), metrics: Sequence[str] = ("image_auroc", "aupro", "pixel_auroc"), rank_metric: str = "image_auroc",
) -> dict[str, DataFrame]:
    """All analysis tables over one definition of populations, as lazy frames over the paired table (persist it: each reads it).

    Populations are conditioned on the training set unless pooled. The noise floor comes from the replicates before they are averaged; the baseline is conditioned like the
    selection; tables whose columns are missing are left out."""
    from . import correlation as C
    from . import selection as S

    keys = list(by) if pooled else S.conditioned_by(paired, by)
    screen = {"min_n": min_n, "alpha": alpha, "min_defect_samples": min_defect_samples}
    noise = S.replicate_noise(paired, keys, replicate_key=replicate_key) if replicate_key in paired.columns else None
    paired = collapse_replicates(paired, keys, replicate_key=replicate_key, keep=keep_replicates)
    selection = S.evaluate_selection(paired, keys, k=k, n_boot=max(0, n_boot), rng=seed, **screen)
    if noise is not None:
        selection = S.with_noise_floor(selection, noise)
    correlation = C.correlate(paired, keys, **screen)
    tables = {"paired": paired, "selection": selection, "correlation": correlation, "calibration": C.evaluate_bias(paired, keys, **screen)}
    if noise is not None:
        tables["noise"] = noise
    held = held_out in paired.columns
    fixed_by = [x for x in ("metric", *S.training_set_keys(paired)) if x in keys]
    if held and S.config_dimensions(paired, fixed_by, held_out=held_out, replicate_key=replicate_key):
        tables["baseline"] = S.fixed_config_baseline(paired, fixed_by, held_out=held_out, replicate_key=replicate_key)
        tables["combined"] = S.build_combined(correlation, selection, tables["baseline"], keys)
    if held:
        tables["leave_one_out"] = S.leave_one_out_query(paired, keys, held_out=held_out, choose_by=choose_by, k=k, **screen)
    return {**tables, **run_selected(paired, keys, selectors=selectors, metrics=metrics, held_out=held_out, rank_metric=rank_metric, replicate_key=replicate_key, min_n=min_n)}
