"""Corpus bookkeeping, text check, span and vector queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import rounded
from ..operators import corpus as K
from ..operators import vectors as V
from ..sources import driver_tables as D


def verdict_threshold(spark, sf_dir):
    return K.apply_threshold(D.manifest(spark, sf_dir), 0.5).select("image_id", "reward_score", "scorer")


def threshold_change(spark, sf_dir):
    rows = K.apply_threshold(D.manifest(spark, sf_dir), 0.2)
    return K.threshold_change(rows, 0.6)


def margin_quantiles(spark, sf_dir):
    return rounded(K.margin_quantiles(D.manifest(spark, sf_dir), ["severity"]))


def accept_ladder(spark, sf_dir):
    return rounded(K.accept_ladder(D.manifest(spark, sf_dir), by=["severity"]))


def generated_counts(spark, sf_dir):
    return K.generated_counts(D.manifest(spark, sf_dir))


def _cells(spark):
    rows = [(c, s) for c in ("en", "fr", "de", "es", "it") for s in ("minimal", "slight", "moderate", "severe")]
    return spark.createDataFrame(rows, "class string, severity string")


def quota_shortfall(spark, sf_dir):
    over = spark.createDataFrame([("en", 200)], "class string, target long")
    return K.shortfall_table(_cells(spark), K.generated_counts(D.manifest(spark, sf_dir)), 50, over)


def quota_satisfied(spark, sf_dir):
    return K.is_satisfied(K.shortfall_table(_cells(spark), K.generated_counts(D.manifest(spark, sf_dir)), 25))


def _jobs(spark, sf_dir):
    m = D.manifest(spark, sf_dir)
    sources = m.select("category", F.format_string("img%06d", "image_id").alias("source"))
    prompts = m.select("category", F.col("class").alias("mode"), F.col("severity").alias("stage")).distinct()
    return K.build_jobs(sources, prompts, base_seed=7, num_per_source=2, crops=2)


def job_expand(spark, sf_dir):
    return _jobs(spark, sf_dir).groupBy("category", "mode", "stage", "prompt_index").agg(F.count("*").alias("n"), F.min("seed").alias("first_seed"), F.max("seed").alias("last_seed"), F.min("stem").alias("first_stem"))


def _done(spark, sf_dir):
    m = D.manifest(spark, sf_dir)
    return m.where("image_id % 3 = 0").select(F.concat(F.format_string("img%06d", "image_id"), F.lit("__crop0")).alias("roi_id"), "class", "severity", (F.col("image_id") % 2).alias("attempt_index"))


def job_resume(spark, sf_dir):
    left = K.filter_completed_continue(_jobs(spark, sf_dir), _done(spark, sf_dir))
    return left.groupBy("category", "mode").agg(F.count("*").alias("n"), F.sum("seed").alias("seeds"))


def job_shards(spark, sf_dir):
    m = D.manifest(spark, sf_dir).select("image_id", "category")
    return K.shard_jobs(m, ["category", "image_id"], 2, 7)


def grid_expand(spark, sf_dir):
    return K.expand_grid(spark, {"category": ["bottle", "tile"], "seed": [0, 1, 2], "shots": [1, 2, 4, 8]})


RUN_KEYS = ["category", "param_model_backbone", "param_seed"]


def resume_partition(spark, sf_dir):
    runs = D.runs(spark, sf_dir)
    out = K.resume_partition(runs, runs, RUN_KEYS, ["real", "all"])
    return out.withColumn("stale_runs", F.array_join("stale_runs", ","))


def contamination(spark, sf_dir):
    m = D.manifest(spark, sf_dir)
    sources = m.where("image_id % 2 = 0").select(F.concat(F.lit("f"), (F.col("image_id") % 100).cast("string"), F.lit("__crop1")).alias("stem"), "image_id")
    train = m.where("image_id % 7 = 0").select(F.concat(F.lit("f"), (F.col("image_id") % 100).cast("string")).alias("frame"))
    return K.contamination(sources, train, source_col="stem", train_col="frame")


def _frames(spark, sf_dir):
    return D.scores(spark, sf_dir).groupBy("run_id", (F.col("sample_id") % 60).alias("f")).agg(F.count_if(F.col("scorer") == "accept").alias("kept"), F.count("*").alias("total")).select(F.col("run_id").alias("category"), F.format_string("f%02d", "f").alias("frame"), "kept", "total")


def train_pools(spark, sf_dir):
    out = K.train_pools(_frames(spark, sf_dir), seeds=[0, 1, 2], n_frames=4, reserved=10)
    return out.withColumn("pool", F.array_join("pool", ","))


def feature_islands(spark, sf_dir):
    rows = K.islands(D.scores(spark, sf_dir), "sample_id", ["severity"], by=["run_id"])
    return rows.groupBy("run_id", "island", "severity").agg(F.count("*").alias("n"), F.min("sample_id").alias("first"))


def round_robin(spark, sf_dir):
    return K.round_robin(D.scores(spark, sf_dir).select("sample_id"), "sample_id", 5)


def spread_slots(spark, sf_dir):
    cards = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (3, "c"), (4, "b"), (5, "a")], "pos int, card string")
    return K.spread_slots(cards, 5)


def sample_defects(spark, sf_dir):
    return K.sample_defects(D.scores(spark, sf_dir), 100, seed=3).select("sample_id", "severity")


def sample_defects_numpy(spark, sf_dir):
    return K.sample_defects_numpy(D.scores(spark, sf_dir), 100, seed=3, category="bottle").select("sample_id", "severity")


def pick_samples(spark, sf_dir):
    return K.pick_samples(D.scores(spark, sf_dir), 6, "spread", "sample_id", by=["run_id"]).select("run_id", "sample_id")


def category_plan(spark, sf_dir):
    rois = D.manifest(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n_rois"))
    return K.category_run_plan(rois, per_cell=120, waves=3, run_tag="t")


def prompt_lint(spark, sf_dir):
    out = K.prompt_lint(D.manifest(spark, sf_dir).select("image_id", "prompt"), "prompt", ["idiot", "clown", "worthless"], min_words=20, max_chars=3000)
    return out.select("image_id", F.array_join("failures", "; ").alias("failures"))


def taxonomy_checks(spark, sf_dir):
    m = D.manifest(spark, sf_dir).where("image_id % 3 <> 1 OR category <> 'src1'")
    return K.taxonomy_checks(m.select("category", F.col("class").alias("mode"), F.col("severity").alias("stage")))


def negatives(spark, sf_dir):
    m = D.manifest(spark, sf_dir)
    items = F.array("category", F.concat(F.lit("No "), F.col("category")), F.concat(F.lit("  "), F.col("class"), F.lit("  x ")), F.upper("category"), F.lit(" "))
    return m.select("image_id", F.array_join(K.normalize_negatives(items), "|").alias("negatives"), K.render_negatives(K.normalize_negatives(items)).alias("rendered"))


def span_summary(spark, sf_dir):
    return rounded(K.span_summary(D.spans(spark, sf_dir)), 6)


def blocking_top20(spark, sf_dir):
    return rounded(K.blocking_spans(D.spans(spark, sf_dir)).select("event_id", "dur_ms", "gpu", "pid"))


def overlap_efficiency(spark, sf_dir):
    return rounded(K.overlap_efficiency(D.spans(spark, sf_dir)), 6)


def _vectors(spark, sf_dir):
    e = D.table(spark, sf_dir, "embeddings")
    return e.where("label <> 0"), e.where("label = 0")


def knn_score(spark, sf_dir):
    queries, bank = _vectors(spark, sf_dir)
    return rounded(V.knn_score(queries, bank), 7)


def feature_distance(spark, sf_dir):
    e = D.table(spark, sf_dir, "embeddings")
    pairs = e.alias("a").join(e.alias("b"), F.expr("b.vec_id = a.vec_id + 1")).select(F.col("a.vec_id").alias("vec_id"), F.col("a.label").alias("label"), F.col("a.embedding").alias("clean"), F.col("b.embedding").alias("edit"))
    return rounded(V.feature_distance(pairs, "clean", "edit", group="label", l2_weight=0.5).select("vec_id", "distance"), 7)


def coreset(spark, sf_dir):
    return V.greedy_coreset(D.table(spark, sf_dir, "embeddings"), 0.1, by="label")


QUERIES = {f.__name__: f for f in (
    verdict_threshold, threshold_change, margin_quantiles, accept_ladder, generated_counts, quota_shortfall, quota_satisfied, job_expand, job_resume, job_shards, grid_expand, resume_partition, contamination,
    train_pools, feature_islands, round_robin, spread_slots, sample_defects, sample_defects_numpy, pick_samples, category_plan, prompt_lint, taxonomy_checks, negatives, span_summary, blocking_top20, overlap_efficiency,
    knn_score, feature_distance, coreset)}

CELLS = "ce AS (SELECT c AS class, s AS severity FROM (VALUES ('en'), ('fr'), ('de'), ('es'), ('it')) a(c) CROSS JOIN (VALUES ('minimal'), ('slight'), ('moderate'), ('severe')) b(s)), gc AS (SELECT class, severity, count(*) AS have FROM fx_manifest GROUP BY ALL)"
JOBS = """pq AS (SELECT category, mode, stage, row_number() OVER (PARTITION BY category ORDER BY mode, list_position(['none', 'minimal', 'slight', 'moderate', 'severe'], stage), stage) - 1 AS prompt_index FROM (SELECT DISTINCT category, class AS mode, severity AS stage FROM fx_manifest)),
jb AS (SELECT m.category, 'img' || lpad(CAST(image_id AS VARCHAR), 6, '0') || '__crop' || crop AS roi_id, mode, stage, prompt_index, attempt, CAST(7 + crop * 1000000 + prompt_index * 1000 + attempt AS BIGINT) AS seed FROM fx_manifest m CROSS JOIN (VALUES (0), (1)) c(crop) JOIN pq ON m.category = pq.category CROSS JOIN (VALUES (0), (1)) a(attempt)),
jc AS (SELECT *, roi_id || '__' || mode || '__' || stage || '__' || attempt AS stem FROM jb)"""
FRAMES = "fr AS (SELECT run_id AS category, 'f' || lpad(CAST(sample_id % 60 AS VARCHAR), 2, '0') AS frame, count(*) FILTER (scorer = 'accept') AS kept, count(*) AS total FROM fx_scores GROUP BY ALL)"


ORACLE_SQL = {k: D.with_views(v) for k, v in {
    "verdict_threshold": "SELECT image_id, reward_score, CASE WHEN reward_score IS NULL THEN NULL WHEN reward_score >= 0.5 THEN 'accept' ELSE 'reject' END AS scorer FROM fx_manifest",
    "threshold_change": "SELECT count(*) FILTER (reward_score IS NULL) AS unscored, count(*) FILTER ((reward_score >= 0.2) <> (reward_score >= 0.6)) AS changed, count(*) AS rows FROM fx_manifest",
    "margin_quantiles": "SELECT severity, count(*) AS n, round(quantile_cont(reward_score, 0.05), 10) + 0.0 AS p05, round(quantile_cont(reward_score, 0.25), 10) + 0.0 AS p25, round(quantile_cont(reward_score, 0.5), 10) + 0.0 AS p50, round(quantile_cont(reward_score, 0.75), 10) + 0.0 AS p75, round(quantile_cont(reward_score, 0.95), 10) + 0.0 AS p95 FROM fx_manifest WHERE reward_score IS NOT NULL GROUP BY severity",
    "accept_ladder": """en AS (SELECT quantile_cont(reward_score, 0.05) AS lo, quantile_cont(reward_score, 0.95) AS hi FROM fx_manifest WHERE reward_score IS NOT NULL), ls AS (SELECT step, lo + (hi - lo) * step / 6 AS threshold FROM en CROSS JOIN (SELECT CAST(unnest(range(7)) AS INT) AS step))
      SELECT severity, step, round(threshold, 10) + 0.0 AS threshold, round(avg(CASE WHEN reward_score >= threshold THEN 1.0 ELSE 0.0 END), 10) AS accept_rate, count(*) AS n FROM fx_manifest CROSS JOIN ls WHERE reward_score IS NOT NULL GROUP BY severity, step, threshold""",
    "generated_counts": "SELECT class, severity, count(*) AS have FROM fx_manifest GROUP BY ALL",
    "quota_shortfall": f"{CELLS} SELECT class, severity, CAST(coalesce(have, 0) AS BIGINT) AS have, CAST(CASE class WHEN 'en' THEN 200 ELSE 50 END AS BIGINT) AS target, CAST(greatest(0, CASE class WHEN 'en' THEN 200 ELSE 50 END - coalesce(have, 0)) AS BIGINT) AS need FROM ce LEFT JOIN gc USING (class, severity)",
    "quota_satisfied": f"{CELLS} SELECT class, bool_and(coalesce(have, 0) >= 25) AS satisfied, CAST(sum(greatest(0, 25 - coalesce(have, 0))) AS BIGINT) AS pending FROM ce LEFT JOIN gc USING (class, severity) GROUP BY class",
    "job_expand": f"{JOBS} SELECT category, mode, stage, prompt_index, count(*) AS n, min(seed) AS first_seed, max(seed) AS last_seed, min(stem) AS first_stem FROM jc GROUP BY ALL",
    "job_resume": f"""{JOBS}, dn AS (SELECT DISTINCT 'img' || lpad(CAST(image_id AS VARCHAR), 6, '0') || '__crop0' AS roi_id, class AS mode, severity AS stage, image_id % 2 AS attempt FROM fx_manifest WHERE image_id % 3 = 0)
      SELECT category, mode, count(*) AS n, CAST(sum(seed) AS BIGINT) AS seeds FROM jc ANTI JOIN dn USING (roi_id, mode, stage, attempt) GROUP BY category, mode""",
    "job_shards": "SELECT image_id, category FROM (SELECT image_id, category, row_number() OVER (ORDER BY category, image_id) - 1 AS i FROM fx_manifest) WHERE i % 7 = 2",
    "grid_expand": "SELECT CAST((a.i * 3 + b.i) * 4 + c.i AS BIGINT) AS grid_pos, a.v AS category, b.v AS seed, c.v AS shots FROM (VALUES (0, 'bottle'), (1, 'tile')) a(i, v) CROSS JOIN (VALUES (0, '0'), (1, '1'), (2, '2')) b(i, v) CROSS JOIN (VALUES (0, '1'), (1, '2'), (2, '4'), (3, '8')) c(i, v)",
    "resume_partition": """rs AS (SELECT category, param_model_backbone, param_seed, count(DISTINCT set_name) FILTER (status = 'FINISHED') AS n_finished, count(DISTINCT set_name) FILTER (status = 'FINISHED' AND set_name IN ('real', 'all')) = 2 AS complete,
      coalesce(string_agg(run_id, ',' ORDER BY run_id), '') AS everything, coalesce(string_agg(run_id, ',' ORDER BY run_id) FILTER (status <> 'FINISHED'), '') AS unfinished FROM fx_runs GROUP BY ALL)
      SELECT category, param_model_backbone, param_seed, complete, CAST(n_finished AS INT) AS n_finished, CASE WHEN complete THEN unfinished ELSE everything END AS stale_runs FROM rs""",
    "contamination": "SELECT 'f' || (image_id % 100) AS leak_key, 'f' || (image_id % 100) || '__crop1' AS stem, image_id FROM fx_manifest WHERE image_id % 2 = 0 AND image_id % 100 IN (SELECT image_id % 100 FROM fx_manifest WHERE image_id % 7 = 0)",
    "train_pools": f"""{FRAMES}, f1 AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY frame) AS h FROM fr), f2 AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY kept, total, frame) - 1 AS p FROM f1 WHERE h > 10)
      SELECT category, CAST(p % 3 AS INT) AS seed, string_agg(frame, ',' ORDER BY frame) AS pool FROM f2 WHERE p < 12 GROUP BY ALL""",
    "feature_islands": """i1 AS (SELECT *, CASE WHEN lag(severity) OVER (PARTITION BY run_id ORDER BY sample_id) = severity THEN 0 ELSE 1 END AS s FROM fx_scores), i2 AS (SELECT *, sum(s) OVER (PARTITION BY run_id ORDER BY sample_id) - 1 AS island FROM i1)
      SELECT run_id, CAST(island AS BIGINT) AS island, severity, count(*) AS n, min(sample_id) AS first FROM i2 GROUP BY ALL""",
    "round_robin": "SELECT sample_id, CAST((row_number() OVER (ORDER BY sample_id) - 1) % 5 AS INT) AS worker FROM fx_scores",
    "spread_slots": "SELECT CAST(slot AS INT) AS slot, card FROM (VALUES (0, 'a'), (1, 'b'), (2, 'c'), (3, 'a'), (4, 'b')) t(slot, card)",
    "sample_defects": "SELECT sample_id, severity FROM (SELECT * FROM fx_scores WHERE defect_area_frac IS DISTINCT FROM 0) ORDER BY md5('3:' || sample_id), sample_id LIMIT 100",
    "pick_samples": "pk AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY sample_id) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM fx_scores) SELECT run_id, sample_id FROM pk WHERE i IN (0, n // 6, 2 * n // 6, 3 * n // 6, 4 * n // 6, 5 * n // 6)",
    "category_plan": "SELECT category, 360 AS target, CAST(greatest(1, ceil(120.0 / count(*))) AS BIGINT) AS num_per_source, 't_' || category AS run_id FROM fx_manifest GROUP BY category",
    "prompt_lint": """SELECT image_id, array_to_string(list_filter([CASE WHEN len(list_filter(string_split_regex(trim(prompt), '\\s+'), lambda x: x <> '')) < 20 THEN 'too few words' END, CASE WHEN length(prompt) > 3000 THEN 'too long' END,
      CASE WHEN regexp_matches(lower(prompt), '\\bidiot\\b') THEN 'names idiot' END, CASE WHEN regexp_matches(lower(prompt), '\\bclown\\b') THEN 'names clown' END, CASE WHEN regexp_matches(lower(prompt), '\\bworthless\\b') THEN 'names worthless' END], lambda x: x IS NOT NULL), '; ') AS failures FROM fx_manifest""",
    "taxonomy_checks": """tx AS (SELECT category, class AS mode, list_distinct(list(severity)) AS st, count(*) AS n FROM fx_manifest WHERE image_id % 3 <> 1 OR category <> 'src1' GROUP BY ALL)
      SELECT category, mode, n, array_to_string(list_concat(list_transform(list_filter(['minimal', 'slight', 'moderate', 'severe'], lambda x: NOT list_contains(st, x)), lambda x: 'missing ' || x), CASE WHEN n > len(st) THEN ['repeated stage'] ELSE [] END), '; ') AS failures FROM tx""",
    "negatives": """SELECT image_id, 'no ' || category || '|no ' || class || ' x' AS negatives, 'Constraints: no ' || category || '; no ' || class || ' x. ' AS rendered FROM fx_manifest""",
    "span_summary": "SELECT name, count(*) AS n, round(sum(dur_ms), 6) AS total_ms, round(avg(dur_ms), 6) AS mean_ms, round(max(dur_ms), 6) AS max_ms FROM fx_spans GROUP BY name",
    "blocking_top20": "SELECT event_id, round(dur_ms, 10) AS dur_ms, gpu, pid FROM fx_spans WHERE kind = 'block' ORDER BY dur_ms DESC, event_id LIMIT 20",
    "overlap_efficiency": """ov AS (SELECT gpu, sum(dur_ms) / 1e3 AS busy, max(epoch_us(CAST(ts AS TIMESTAMP)) / 1e6) - min(epoch_us(CAST(ts AS TIMESTAMP)) / 1e6 - dur_ms / 1e3) AS wall FROM fx_spans GROUP BY gpu)
      SELECT gpu, round(busy, 6) AS busy_s, round(wall, 6) AS wall_s, round(busy / wall, 6) AS efficiency FROM ov""",
    "knn_score": """SELECT id, round(avg(d), 7) AS score FROM (SELECT q.vec_id AS id, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS rn
      FROM embeddings q CROSS JOIN embeddings b WHERE q.label <> 0 AND b.label = 0) WHERE rn <= 3 GROUP BY id""",
    "feature_distance": """pr AS (SELECT a.vec_id, a.label, CAST(a.embedding AS DOUBLE[]) AS c, CAST(b.embedding AS DOUBLE[]) AS e FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
      dm AS (SELECT label, i, median(e[i] - c[i]) AS m FROM (SELECT *, unnest(range(1, len(c) + 1)) AS i FROM pr) GROUP BY ALL), sh AS (SELECT label, list(m ORDER BY i) AS s FROM dm GROUP BY label),
      ad AS (SELECT vec_id, c, list_transform(list_zip(e, s), lambda x: x[1] - x[2]) AS e FROM pr JOIN sh USING (label))
      SELECT vec_id, round(1 - list_cosine_similarity(c, e) + 0.5 * list_distance(c, e), 7) AS distance FROM ad""",
}.items()}
