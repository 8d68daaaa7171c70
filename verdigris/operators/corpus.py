"""Corpus bookkeeping: manifests, verdicts, quotas, jobs, resumption, contamination, pools, seeded samples."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import SEVERITIES, null_safe_join, numbered, passes_gate, severity_rank

#: Parts of a job's seed.
CROP_STEP, PROMPT_STEP = 1_000_000, 1_000


def verdict(entry_verdict: Column, has_verdict: Column, legacy: Column) -> Column:
    """The verdict if its key is there (even when NULL), else the legacy one; lower case."""
    return F.lower(F.when(has_verdict, entry_verdict).otherwise(legacy))


def mask_status_value(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("unknown"))


def apply_threshold(rows: DataFrame, accept_margin: float, *, margin: str = "reward_score", column: str = "scorer") -> DataFrame:
    """Verdicts anew from stored margins; unscored rows keep NULL."""
    return rows.withColumn(column, F.when(F.col(margin).isNotNull(), F.when(F.col(margin) >= accept_margin, "accept").otherwise("reject")))


def threshold_change(rows: DataFrame, accept_margin: float, *, margin: str = "reward_score", column: str = "scorer") -> DataFrame:
    new = F.when(F.col(margin) >= accept_margin, "accept").otherwise("reject")
    return rows.agg(F.count_if(F.col(margin).isNull()).alias("unscored"), F.count_if(F.col(margin).isNotNull() & ~F.col(column).eqNullSafe(new)).alias("changed"), F.count("*").alias("rows"))


def margin_quantiles(rows: DataFrame, by: Sequence[str] = (), *, margin: str = "reward_score", at: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Linear quantiles of the margin per group, one column each (p05, ...)."""
    scored = rows.where(F.col(margin).isNotNull())
    return scored.groupBy(*by).agg(F.count("*").alias("n"), *[F.percentile(margin, q).alias(f"p{round(q * 100):02d}") for q in at])


def accept_ladder(rows: DataFrame, *, margin: str = "reward_score", steps: int = 7, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows accepted at evenly spaced thresholds between the margin's 5th and 95th percentile."""
    scored = rows.where(F.col(margin).isNotNull()).select(*by, F.col(margin).alias("m"))
    ends = scored.agg(F.percentile("m", 0.05).alias("lo"), F.percentile("m", 0.95).alias("hi"))
    at = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.struct(i.alias("step"), (F.col("lo") + (F.col("hi") - F.col("lo")) * i / max(1, steps - 1)).alias("threshold")))
    ladder = ends.select(F.explode(at).alias("s")).select("s.*")
    out = scored.crossJoin(F.broadcast(ladder))  # a fixed number of thresholds
    return out.groupBy(*by, "step", "threshold").agg(F.avg((F.col("m") >= F.col("threshold")).cast("double")).alias("accept_rate"), F.count("*").alias("n"))


def generated_counts(rows: DataFrame) -> DataFrame:
    """Rows per (class, severity); negatives count under the cell they mirror. An empty string is no value."""
    has = lambda c: F.nullif(F.col(c), F.lit("")) if c in rows.columns else F.lit(None).cast("string")
    return rows.select(F.coalesce(has("region_mode"), F.col("class")).alias("class"), F.coalesce(has("region_stage"), F.col("severity")).alias("severity")).groupBy("class", "severity").agg(F.count("*").alias("have"))


def shortfall_table(cells: DataFrame, counts: DataFrame, target: int, overrides: DataFrame | None = None) -> DataFrame:
    """have and need of each cell, cells without rows included; overrides (class, target) win over the target."""
    out = cells.join(counts, ["class", "severity"], "left")
    out = out.join(overrides, "class", "left") if overrides is not None else out.withColumn("target", F.lit(None).cast("long"))
    out = out.withColumns({"have": F.coalesce("have", F.lit(0)).cast("long"), "target": F.coalesce(F.col("target").cast("long"), F.lit(target).cast("long"))})
    return out.withColumn("need", F.greatest(F.lit(0), F.col("target") - F.col("have")).cast("long")).select("class", "severity", "have", "target", "need")


def is_satisfied(shortfall: DataFrame, by: Sequence[str] = ("class",)) -> DataFrame:
    return shortfall.groupBy(*by).agg(F.bool_and(F.col("need") == 0).alias("satisfied"), F.sum("need").alias("pending"))


def prompt_index(prompts: DataFrame) -> DataFrame:
    """Prompts numbered densely by (category, mode, ladder place, stage) within a category."""
    order = Window.partitionBy("category").orderBy("mode", F.coalesce(severity_rank("stage"), F.lit(99)), "stage")
    return prompts.withColumn("prompt_index", (F.row_number().over(order) - 1).cast("long"))


def build_jobs(sources: DataFrame, prompts: DataFrame, *, base_seed: int, num_per_source: int, crops: int = 1) -> DataFrame:
    """Sources x crops x prompts x attempts of each category, with a seed that depends only on a job's place."""
    indexed = prompt_index(prompts)
    jobs = sources.withColumn("crop", F.explode(F.sequence(F.lit(0), F.lit(crops - 1)))).join(indexed, "category").withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(num_per_source - 1))))
    roi = F.concat(F.col("source"), F.lit("__crop"), F.col("crop"))
    jobs = jobs.withColumns({"roi_id": roi, "seed": (F.lit(base_seed) + F.col("crop") * CROP_STEP + F.col("prompt_index") * PROMPT_STEP + F.col("attempt")).cast("long")})
    return jobs.withColumn("stem", F.concat_ws("__", "roi_id", "mode", "stage", F.col("attempt").cast("string")))


def candidate_id(run_id: str) -> Column:
    return F.concat_ws("__", F.lit(run_id), "stem")


JOB_KEY = ("roi_id", "mode", "stage", "attempt")


def row_key(rows: DataFrame) -> DataFrame:
    """The logical key of manifest rows; negatives go by their region's mode and stage."""
    has = lambda c: F.nullif(F.col(c), F.lit("")) if c in rows.columns else F.lit(None).cast("string")
    return rows.withColumns({"mode": F.coalesce(has("region_mode"), F.col("class")), "stage": F.coalesce(has("region_stage"), F.col("severity")), "attempt": F.col("attempt_index").cast("int")})


def filter_completed(jobs: DataFrame, rows: DataFrame, run_id: str) -> DataFrame:
    """Jobs of this run without a manifest row of their id."""
    return jobs.withColumn("image_id", candidate_id(run_id)).join(rows.select("image_id").distinct(), "image_id", "left_anti")


def filter_completed_continue(jobs: DataFrame, rows: DataFrame) -> DataFrame:
    """Jobs without a row of the same logical key in any manifest."""
    return jobs.join(row_key(rows).select(*JOB_KEY).distinct(), list(JOB_KEY), "left_anti")


def partition_pending(jobs: DataFrame, present: DataFrame) -> DataFrame:
    """Jobs with is_present: whether the raw edit (by stem) is there already."""
    there = present.select("stem").distinct().withColumn("is_present", F.lit(True))
    return jobs.join(there, "stem", "left").withColumn("is_present", F.coalesce("is_present", F.lit(False)))


def shard_jobs(jobs: DataFrame, order: Sequence[str], index: int, n: int) -> DataFrame:
    """Every n-th job from index, in the given order."""
    return numbered(jobs, order, "__i").where(F.pmod("__i", F.lit(n)) == index).drop("__i")


def expand_grid(spark: SparkSession, grid: dict[str, Sequence]) -> DataFrame:
    """Cartesian product of a sweep's value lists, last key fastest, with its position."""
    out = spark.range(1).select(F.lit(0).cast("long").alias("grid_pos"))
    for name, values in grid.items():
        out = out.select("*", F.posexplode(F.array(*[F.lit(str(v)) for v in values])).alias("__p", name))
        out = out.withColumn("grid_pos", F.col("grid_pos") * len(values) + F.col("__p")).drop("__p")
    return out


def resume_partition(configs: DataFrame, runs: DataFrame, keys: Sequence[str], expected: Sequence[str]) -> DataFrame:
    """Each config of the grid with what is finished: complete if every expected set is, and the runs a rerun makes stale."""
    stored = runs.groupBy(*keys).agg(
        F.collect_set(F.when(F.col("status") == "FINISHED", F.col("set_name"))).alias("finished"), F.sort_array(F.collect_list("run_id")).alias("run_ids"),
        F.sort_array(F.collect_list(F.when(F.col("status") != "FINISHED", F.col("run_id")))).alias("unfinished"))
    out = null_safe_join(configs.select(*keys).distinct(), stored, list(keys), "left")
    want = F.array(*[F.lit(e) for e in expected])
    nothing = F.array().cast("array<string>")
    done = F.size(F.array_except(want, F.coalesce("finished", nothing))) == 0
    stale = F.when(done, F.coalesce("unfinished", nothing)).otherwise(F.coalesce("run_ids", nothing))
    return out.select(*keys, done.alias("complete"), F.size(F.coalesce("finished", nothing)).alias("n_finished"), stale.alias("stale_runs"))


def frame_id(c: Column) -> Column:
    return F.regexp_replace(c, r"__crop\d+$", "")


def leak_key(c: Column, group_pattern: str | None = None) -> Column:
    """A frame, or its group by a pattern; a frame the pattern doesn't fit is an error."""
    frame = frame_id(c)
    if group_pattern is None:
        return frame
    found = F.regexp_extract(frame, group_pattern, 1)
    return F.when(F.regexp_like(frame, F.lit(group_pattern)), found).otherwise(F.raise_error(F.concat(F.lit("no group in "), frame)))


def contamination(sources: DataFrame, training: DataFrame, *, source_col: str, train_col: str, group_pattern: str | None = None) -> DataFrame:
    """Sources that share a leak key with training frames: must be empty."""
    train = training.select(leak_key(F.col(train_col), group_pattern).alias("leak_key")).distinct()
    return sources.withColumn("leak_key", leak_key(F.col(source_col), group_pattern)).join(train, "leak_key", "left_semi")


def train_pools(frames: DataFrame, *, seeds: Sequence[int], n_frames: int, reserved: int = 0, frame: str = "frame", by: Sequence[str] = ("category",), rank: Sequence[str] = ("kept", "total")) -> DataFrame:
    """Frames dealt to one pool per seed: the reserved head by name is skipped, the rest ranked by (kept, total, name) and dealt round robin."""
    n = len(seeds)
    head = F.row_number().over(Window.partitionBy(*by).orderBy(frame))
    left = frames.withColumn("__head", head).where(F.col("__head") > reserved)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*rank, frame)) - 1
    dealt = left.withColumn("__place", place).where(F.col("__place") < n * n_frames)
    seed = F.element_at(F.array(*[F.lit(s) for s in seeds]), (F.pmod("__place", F.lit(n)) + 1).cast("int"))
    return dealt.withColumn("seed", seed).groupBy(*by, "seed").agg(F.sort_array(F.collect_list(frame)).alias("pool"))


def islands(rows: DataFrame, order: str, key: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Numbers runs of consecutive equal keys."""
    w = Window.partitionBy(*by).orderBy(order)
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.lag(k).over(w))
    start = F.when((F.row_number().over(w) > 1) & same, 0).otherwise(1)
    return rows.withColumn("__start", start).withColumn("island", F.sum("__start").over(w) - 1).drop("__start")


def round_robin(groups: DataFrame, order: str, workers: int) -> DataFrame:
    """Groups dealt to workers in turn."""
    return numbered(groups, [order], "__i").withColumn("worker", F.pmod("__i", F.lit(workers)).cast("int")).drop("__i")


def spread_slots(cards: DataFrame, n_slots: int) -> DataFrame:
    """Slots over distinct cards, one for each card a round: (slot, card)."""
    turn = cards.withColumn("round", F.row_number().over(Window.partitionBy("card").orderBy("pos")))
    first = turn.withColumn("first", F.min("pos").over(Window.partitionBy("card")))
    return first.withColumn("slot", F.row_number().over(Window.orderBy("round", "first")) - 1).where(F.col("slot") < n_slots).select("slot", "card")


def sample_defects(samples: DataFrame, max_defects: int, *, seed: int, id_col: str = "sample_id", area: str = "defect_area_frac") -> DataFrame:
    """A seeded sample without replacement of the rows that pass the area gate, in any engine the same: the least hashes of seed and id.
    With no more rows than the cap all rows stay, those that fail the gate too."""
    if samples.where(passes_gate(area)).limit(max_defects + 1).count() <= max_defects:
        return samples
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))
    return samples.where(passes_gate(area)).orderBy(key, id_col).limit(max_defects)


def sample_defects_numpy(samples: DataFrame, max_defects: int, *, seed: int, category: str, order: str = "sample_id", area: str = "defect_area_frac") -> DataFrame:
    """The same with NumPy's draw for (seed, crc32(category)) over the gated rows in order; the positions drawn are max_defects numbers."""
    rows = samples.where(passes_gate(area))
    n = rows.count()
    if n <= max_defects:
        return samples
    drawn = np.random.default_rng([seed, zlib.crc32(category.encode())]).choice(n, size=max_defects, replace=False)
    at = samples.sparkSession.createDataFrame([(int(i),) for i in sorted(drawn)], "__at long")
    return numbered(rows, [order], "__at").join(F.broadcast(at), "__at").drop("__at")


def pick_samples(rows: DataFrame, k: int, strategy: str, order: str, by: Sequence[str] = ()) -> DataFrame:
    """The first k of each group, or k evenly spaced ones."""
    w = Window.partitionBy(*by)
    rows = rows.withColumns({"__i": F.row_number().over(w.orderBy(order)) - 1, "__n": F.count(F.lit(1)).over(w)})
    if strategy == "first":
        keep = F.col("__i") < k
    elif strategy == "spread":
        keep = (F.col("__n") <= k) | F.exists(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.floor(j * F.col("__n") / k) == F.col("__i"))
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return rows.where(keep).drop("__i", "__n")


def num_per_source(target: Column, rois: Column) -> Column:
    return F.when((target < 1) | (rois < 1), F.raise_error(F.lit("target and regions must be positive")).cast("long")).otherwise(F.greatest(F.lit(1), F.ceil(target / rois)).cast("long"))


def category_run_plan(categories: DataFrame, *, per_cell: int, waves: int, run_tag: str) -> DataFrame:
    """One plan row for each (category, n_rois)."""
    target = F.lit(per_cell * waves)
    return categories.select("category", target.alias("target"), num_per_source(F.lit(per_cell), F.col("n_rois")).alias("num_per_source"), F.concat_ws("_", F.lit(run_tag), "category").alias("run_id"))


def cells_from_prompts(prompts: DataFrame) -> DataFrame:
    """Modes in order of appearance with their stages in ladder order."""
    modes = prompts.groupBy("mode").agg(F.min("pos").alias("first"), F.collect_set("stage").alias("stages"))
    rank = lambda s: F.coalesce(*[F.when(s == x, F.lit(i)) for i, x in enumerate(SEVERITIES)], F.lit(99))
    ordered = F.transform(F.array_sort(F.transform("stages", lambda s: F.struct(rank(s).alias("r"), s.alias("s")))), lambda x: x["s"])
    return modes.select("mode", "first", ordered.alias("stages"))


def unique_in_order(rows: DataFrame, column: str, pos: str) -> DataFrame:
    return rows.groupBy(column).agg(F.min(pos).alias("first")).orderBy("first")


# Text checks


def normalize_negatives(items: Column) -> Column:
    """Blank space collapsed, prefixed with 'no ', repeats without regard to case dropped (the first stays)."""
    tidy = F.filter(F.transform(items, lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")
    named = F.transform(tidy, lambda s: F.when(F.lower(s).startswith("no "), s).otherwise(F.concat(F.lit("no "), s)))
    lowered = F.transform(named, F.lower)
    return F.filter(named, lambda s, i: F.array_position(lowered, F.lower(s)) == i + 1)


def render_negatives(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit("Constraints: "), F.array_join(items, "; "), F.lit(". "))).otherwise("")


def prompt_lint(rows: DataFrame, text: str, markers: Sequence[str], *, min_words: int = 3, max_chars: int = 2000) -> DataFrame:
    """Failures of each text: too short, too long, and whole-word markers it holds."""
    low = F.lower(F.col(text))
    word = lambda m: F.contains(low, F.lit(m)) & F.regexp_like(low, F.lit(rf"\b{m}\b"))
    n_words = F.regexp_count(F.col(text), F.lit(r"\S+"))
    checks = [F.when(n_words < min_words, F.lit("too few words")), F.when(F.length(text) > max_chars, F.lit("too long")), *[F.when(word(m), F.lit(f"names {m}")) for m in markers]]
    return rows.withColumn("failures", F.array_compact(F.array(*checks)))


def taxonomy_checks(modes: DataFrame, required: Sequence[str] = SEVERITIES[1:]) -> DataFrame:
    """(category, mode, stage) rows to one row per mode with its failures: missing and repeated grades."""
    out = modes.groupBy("category", "mode").agg(F.collect_set("stage").alias("stages"), F.count("*").alias("n"))
    missing = F.array_except(F.array(*[F.lit(s) for s in required]), F.col("stages"))
    failures = F.concat(F.transform(missing, lambda s: F.concat(F.lit("missing "), s)), F.when(F.col("n") > F.size("stages"), F.array(F.lit("repeated stage"))).otherwise(F.array().cast("array<string>")))
    return out.select("category", "mode", "n", F.array_join(failures, "; ").alias("failures"))


# Spans


def span_summary(spans: DataFrame) -> DataFrame:
    return spans.groupBy("name").agg(F.count("*").alias("n"), F.sum("dur_ms").alias("total_ms"), F.avg("dur_ms").alias("mean_ms"), F.max("dur_ms").alias("max_ms"))


def blocking_spans(spans: DataFrame, n: int = 20) -> DataFrame:
    return spans.where("kind = 'block'").orderBy(F.col("dur_ms").desc(), "event_id").limit(n)


def overlap_efficiency(spans: DataFrame, by: Sequence[str] = ("gpu",)) -> DataFrame:
    """Busy time over wall time of each worker: spans start dur_ms before they are logged."""
    end = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = spans.withColumns({"__end": end, "__start": end - F.col("dur_ms") / 1e3})
    wall = F.max("__end") - F.min("__start")
    return rows.groupBy(*by).agg((F.sum("dur_ms") / 1e3).alias("busy_s"), wall.alias("wall_s"), F.when(wall > 0, F.try_divide(F.sum("dur_ms") / 1e3, wall)).alias("efficiency"))
