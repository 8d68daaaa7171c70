"""Checks and plans around prompts: compiled prompts, benchmarks' names, staged samples, the calls of a derivation, quotas left, negatives' prompts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import SEVERITIES

#: Words that make an edit depend on an earlier one, and what benchmarks' folders are called.
INCREMENTAL = ("deepen", "extend", "further", "existing", "previous", "more than", "already", "continue")
BENCHMARKS = {
    "mvtec_ad": ("mvtec_ad", "mvtecad", "mvtec-ad", "mvtec"), "mvtec_loco": ("mvtec_loco", "loco"), "visa": ("visa", "vis_a"), "mpdd": ("mpdd",), "btad": ("btad",), "real_iad": ("real_iad", "realiad"),
}
TARGET = "defect_free_source"


def check_prompts(prompts: DataFrame, taxonomies: DataFrame, *, markers: Sequence[str] = INCREMENTAL, grades: int = len(SEVERITIES) - 1) -> DataFrame:
    """(category, failures) of compiled prompts (category, mode, stage, prompt, applies_to) against their taxonomy (category, n_modes, fixed).

    Each mode has a prompt for each grade, applied to a clean source; no prompt names an incremental marker outside the taxonomy's fixed block."""
    rows = prompts.join(taxonomies.select("category", F.lower(F.trim("fixed")).alias("__fixed")), "category", "left")
    text = F.lower(F.coalesce("prompt", F.lit("")))
    text = F.when(F.coalesce("__fixed", F.lit("")) != "", F.replace(text, F.col("__fixed"), F.lit(" "))).otherwise(text)
    cell = F.concat(F.col("mode"), F.lit("/"), F.col("stage"))
    target = F.when(~F.coalesce(F.col("applies_to"), F.lit("")).eqNullSafe(TARGET), F.concat(cell, F.lit(" applies to "), F.coalesce("applies_to", F.lit("nothing"))))
    named = [F.when(F.contains(text, F.lit(m)), F.concat(cell, F.lit(f" names {m}"))) for m in markers]
    own = rows.select("category", F.explode_outer(F.array_compact(F.array(target, *named))).alias("failure")).groupBy("category").agg(F.sort_array(F.collect_list("failure")).alias("own"))
    sizes = prompts.groupBy("category").agg(F.count("*").alias("n"))
    out = taxonomies.select("category", "n_modes").join(sizes, "category", "left").join(own, "category", "left")
    n, wanted = F.coalesce("n", F.lit(0)), F.col("n_modes") * grades
    count = F.when(n != wanted, F.array(F.concat(n.cast("string"), F.lit(" prompts, expected "), wanted.cast("string")))).otherwise(F.array().cast("array<string>"))
    return out.select("category", F.concat(count, F.coalesce("own", F.array().cast("array<string>"))).alias("failures"))


def validation_report(checks: DataFrame, *, title: str) -> str:
    """Markdown of (category, n_modes, n_prompts, failures), a row for each category and the failures below."""
    rows = checks.orderBy("category").collect()  # one for each category
    bad = [r for r in rows if r["failures"]]
    lines = [f"# {title}", "", f"{len(rows)} categories, {sum(r['n_prompts'] for r in rows)} prompts, {len(bad)} failing", "", "| category | modes | prompts | result |", "| --- | --- | --- | --- |"]
    lines += [f"| {r['category']} | {r['n_modes']} | {r['n_prompts']} | {'fail (' + str(len(r['failures'])) + ')' if r['failures'] else 'pass'} |" for r in rows]
    for r in bad:
        lines += ["", f"## {r['category']}", "", *[f"- {f}" for f in r["failures"]]]
    return "\n".join(lines) + "\n"


def infer_benchmark(path: Column, hints: Mapping[str, Sequence[str]] = BENCHMARKS) -> Column:
    """The first benchmark that a folder's last two parts name, else unknown."""
    parts = F.split(F.lower(F.regexp_replace(path, "/+$", "")), "/")
    tail = F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), 2), "/")
    named = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(tail, w))
    return F.coalesce(*[F.when(named(words), F.lit(name)) for name, words in hints.items()], F.lit("unknown"))


def stage_samples(picked: DataFrame, staged: DataFrame, *, restage: bool = False) -> DataFrame:
    """(category, path, target, action) of picked (category, place, path, length): names that keep the order of choice.

    What is staged (category, target, length) already stays if it has the source's size, or if it has diverged, which is told; restage copies all."""
    name = F.concat(F.lpad(F.col("place").cast("string"), 2, "0"), F.lit("_"), F.element_at(F.split("path", "/"), -1))
    rows = picked.withColumn("target", name).join(staged.select("category", "target", F.col("length").alias("__there")), ["category", "target"], "left")
    action = F.lit("copy") if restage else F.when(F.col("__there").isNull(), "copy").when(F.col("__there") == F.col("length"), "keep").otherwise("diverged")
    return rows.select("category", "path", "target", action.alias("action"))


def image_stats(images: DataFrame, by: Sequence[str] = ("category",)) -> DataFrame:
    """Size and mode of each group's first image by path, and whether all images share them. Images that couldn't be read (NULL width) take no part."""
    first = F.min_by(F.struct("width", "height", "mode"), "path").alias("f")
    size = F.count_distinct(F.struct("width", "height")) == 1
    seen = images.where("width IS NOT NULL").groupBy(*by).agg(first, size.alias("uniform_size"), (F.count_distinct("mode") == 1).alias("uniform_mode"))
    every = images.groupBy(*by).agg(F.count("*").alias("n"))
    return every.join(seen, list(by), "left").select(*by, F.when(F.col("f").isNull(), "failed").otherwise("ok").alias("probe"), "f.width", "f.height", "f.mode", "uniform_size", "uniform_mode")


def build_calls(plan: DataFrame, *, benchmark: str) -> DataFrame:
    """(category, calls): the derivation and the compilation of each category (description, samples, taxonomy, prompts) as JSON; an absent description isn't named."""
    scale = F.array(*[F.lit(s) for s in SEVERITIES[1:]])
    derive = F.struct(F.lit(benchmark).alias("benchmark"), "category", F.nullif(F.trim("description"), F.lit("")).alias("category_description"), F.col("samples").alias("defect_free_samples"), F.lit("standalone").alias("grading_mode"), scale.alias("severity_scale"), F.col("taxonomy").alias("output"))
    compiled = F.struct(F.col("taxonomy").alias("taxonomy"), F.col("prompts").alias("output"))
    step = lambda n, skill, args, *more: F.to_json(F.struct(F.lit(n).alias("step"), F.lit(skill).alias("skill"), args.alias("args"), *more))
    return plan.select("category", F.array(step(1, "taxonomy-derivation", derive), step(2, "prompt-compiler", compiled, F.lit(1).alias("depends_on"))).alias("calls"))


def negative_prompts(prompts: DataFrame, text: str) -> DataFrame:
    """The same cells with one prompt for all, white space collapsed; a blank one is an error."""
    tidy = " ".join((text or "").split())
    if not tidy:
        raise ValueError("the negatives' prompt is blank")
    return prompts.withColumn("prompt", F.lit(tidy))


def pending_rows(shortfall: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows that all cells still need together."""
    return shortfall.groupBy(*by).agg(F.coalesce(F.sum(F.greatest(F.lit(0), F.col("target") - F.col("have"))), F.lit(0)).cast("long").alias("pending"))


def count_sources(files: DataFrame, limit: int | None = None, by: str = "category") -> DataFrame:
    """Source frames of each category after the limit."""
    n = F.count("*")
    return files.groupBy(by).agg((n if limit is None else F.least(n, F.lit(limit))).alias("n_sources"))


def source_frames(frames: DataFrame, n: int, by: str = "category", frame: str = "frame") -> DataFrame:
    """A split by names: the first n frames of each category are sources, the others train."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(frame))
    return frames.withColumn("role", F.when(place <= n, "source").otherwise("train"))
