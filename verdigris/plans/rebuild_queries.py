"""Queries of the recompute path, resumption, scoring, splits and settings, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import rounded
from ..operators import blending as B
from ..operators import corpus as K
from ..operators import protocol as P
from ..operators import recompute as R
from ..operators import resume as G
from ..operators import scoring as J
from ..operators import splits as S
from ..sources import driver_tables as D

CONFIG = {"queries": {"all": {"all": None, "defects": "label != 0"}, "alt": {"accepted": {"expr": "scorer == 'accept'", "keep_good": True}}}, "gate": {"all": "defect_area_frac != 0"}}


def prediction_ids(spark, sf_dir):
    """Scores as batches with an image path each."""
    rows = D.scores(spark, sf_dir).withColumns({"image_path": F.concat(F.lit("data/"), F.col("severity"), F.lit("/img."), F.col("sample_id").cast("string"), F.lit(".png")), "mask_path": F.when(F.col("label") == 1, F.lit("m.png"))})
    return R.build_predictions(rows.drop("sample_id").withColumn("place", F.col("image_path")), ["place"]).select("sample_id", "image_path", "label", "mask_path", "score", "scorer", "severity")


def severity_scheme(spark, sf_dir):
    rows = D.scores(spark, sf_dir).withColumn("cell", F.concat_ws("-", "run_id", F.when(F.col("label") == 0, "good").otherwise("bad")))
    return R.severity_scheme(rows, ["cell"])


def severity_vocabulary(spark, sf_dir):
    rows = D.scores(spark, sf_dir).select("run_id", F.explode(F.array("severity", "mask_status")).alias("severity"))
    out = R.vocabulary(rows, ["run_id"])
    return out.select("run_id", F.array_join("grades", ",").alias("grades"), F.array_join("others", ",").alias("others"))


def scorer_order(spark, sf_dir):
    names = D.scores(spark, sf_dir).select("scorer").unionByName(D.scores(spark, sf_dir).select(F.lit("all").alias("scorer")))
    return R.scorer_order(names)


def _set_runs(spark, sf_dir):
    runs = D.scores(spark, sf_dir).select("run_id").distinct()
    return runs.withColumn("set_name", F.when(F.col("run_id") < "4", "all").when(F.col("run_id") < "8", "alt").otherwise("old")).unionByName(spark.createDataFrame([("x1", "all"), ("x2", None)], "run_id string, set_name string"))


def recomputed(spark, sf_dir):
    found, _ = R.recompute_severity(_set_runs(spark, sf_dir), D.scores(spark, sf_dir), CONFIG)
    return rounded(found.select("run_id", "query", "n_samples", "image_auroc"))


def recompute_skipped(spark, sf_dir):
    return R.recompute_severity(_set_runs(spark, sf_dir), D.scores(spark, sf_dir), CONFIG)[1]


def _logged(spark, sf_dir):
    """The run log with maps of tags and parameters."""
    runs = D.runs(spark, sf_dir)
    tags = F.create_map(F.lit("category"), "category", F.lit("set_name"), "set_name")
    return runs.select("run_id", "status", "start_time", tags.alias("tags"), F.create_map(F.lit("backbone"), "param_model_backbone", F.lit("seed"), "param_seed").alias("params"))


def _grid(spark, sf_dir):
    points = D.runs(spark, sf_dir).select("category", "param_model_backbone", "param_seed").distinct()
    rows = points.withColumns({"tags": F.create_map(F.lit("category"), "category", F.lit("set_name"), F.lit("real")), "params": F.create_map(F.lit("backbone"), "param_model_backbone", F.lit("seed"), "param_seed")})
    wanted = G.expected_sets(F.array(F.lit("all")), F.col("category") != "CHINA")
    return rows.select(F.xxhash64("category", "param_model_backbone", "param_seed").alias("grid_pos"), "category", "param_model_backbone", "param_seed", "tags", "params", wanted.alias("expected"))


def grid_resume(spark, sf_dir):
    told, _ = G.partition_grid(_grid(spark, sf_dir), _logged(spark, sf_dir))
    return told.select("category", "param_model_backbone", "param_seed", F.size("expected").alias("n_expected"), "complete")


def grid_stale(spark, sf_dir):
    _, stale = G.partition_grid(_grid(spark, sf_dir), _logged(spark, sf_dir))
    return stale.select("run_id", "status", "set_name")


def layer_aliases(spark, sf_dir):
    names = D.runs(spark, sf_dir).select(F.when(F.col("category") > "J", F.lit("resnet18")).otherwise(F.lit("dinov2_vitb14")).alias("b"), F.when(F.col("param_seed") == "1-URGENT", "default").when(F.col("param_seed") == "2-HIGH", "one_additional").when(F.col("param_seed") == "3-MEDIUM", "two_additional").otherwise("['layer1']").alias("l"))
    configs = names.distinct().select("b", "l", F.create_map(F.lit("backbone"), "b", F.lit("layers"), "l").alias("params"))
    return G.as_logged(configs).select("b", "l", F.col("params")["layers"].alias("layers"))


def _judge(spark, sf_dir):
    rows = D.manifest(spark, sf_dir).withColumns({"crop": F.when(F.col("image_id") % 9 != 0, F.col("category")), "scorer": F.when(F.col("reward_score") > 0, "accept")}).withColumn("verdict", F.col("scorer"))
    scores = rows.select("image_id", (F.col("n_chars") % 100 / 64.0).alias("score"))
    noops = rows.where("crop IS NOT NULL").groupBy("crop", "prompt").agg(F.max(F.col("image_id") % 50 / 64.0).alias("score"))
    return rows, scores, noops


def judged_rows(spark, sf_dir):
    rows, scores, noops = _judge(spark, sf_dir)
    out = J.judged(rows, scores, noops, accept_margin=0.25, categories={"src0", "src1", "src2"}, model="m1")
    return rounded(out.select("image_id", "scorer", "reward_score", "reward_model", "reward_accept_margin"))


def rethresholded(spark, sf_dir):
    rows = _judge(spark, sf_dir)[0]
    out, _ = J.rethreshold(rows, 0.5, categories={"src0", "src3"})
    return out.select("image_id", "scorer", "reward_accept_margin")


def _pool_frames(spark, sf_dir):
    frames = D.scores(spark, sf_dir).select(F.col("run_id").alias("category"), F.concat(F.lit("f"), F.lpad((F.col("sample_id") % 60).cast("string"), 2, "0")).alias("frame"), "scorer")
    return frames, frames.groupBy("category", "frame").agg(F.count_if(F.col("scorer") == "accept").alias("kept"), F.count("*").alias("total"))


def split_table(spark, sf_dir):
    frames, counts = _pool_frames(spark, sf_dir)
    return S.build_split(frames, n_frames=4, seeds=[0, 1, 2], reserved=10, counts=counts)


def split_summary(spark, sf_dir):
    return S.split_summary(split_table(spark, sf_dir))


def overlay_jobs(spark, sf_dir):
    sources = D.manifest(spark, sf_dir).select("category", F.concat(F.lit("a/b/img"), F.col("image_id").cast("string"), F.lit(".png")).alias("path"))
    return S.overlay_jobs(sources, 2, seed=7).select("image_id", "source_image_id", "overlay_index", F.col("rng_seed").cast("string").alias("rng_seed"))


def extent_bounds(spark, sf_dir):
    ranges = [(None, k, *v) for k, v in B.EXTENT_RANGES.items()] + [("src1", "regional", 0.05, 0.5)]
    rows = D.manifest(spark, sf_dir).select("image_id", "category", "severity")
    return B.with_extent(rows, spark.createDataFrame(ranges, "category string, extent string, lo double, hi double"))


def stretched_boxes(spark, sf_dir):
    part = D.table(spark, sf_dir, "part")
    w, h = (100 + F.col("p_partkey") % 400).cast("int"), (100 + F.col("p_partkey") % 173).cast("int")
    return part.select("p_partkey", B.stretched(w, h, 512, 480).alias("stretched"))


def crop_plans(spark, sf_dir):
    frames = D.table(spark, sf_dir, "part").select("p_partkey", (100 + F.col("p_partkey") % 400).cast("int").alias("width"), (100 + F.col("p_partkey") % 173).cast("int").alias("height"))
    named = lambda name, block: B.crop_plan(block).boxes(frames).select("p_partkey", F.lit(name).alias("layout"), "x0", "y0", "x1", "y1")
    return named("full", None).unionByName(named("center", {"layout": "center", "crop_size": 64}))


QUERIES = {f.__name__: f for f in (
    prediction_ids, severity_scheme, severity_vocabulary, scorer_order, recomputed, recompute_skipped, grid_resume, grid_stale, layer_aliases, judged_rows, rethresholded, split_table, split_summary, overlay_jobs,
    extent_bounds, stretched_boxes, crop_plans)}

_RUNS = "sr AS (SELECT run_id, CASE WHEN run_id < '4' THEN 'all' WHEN run_id < '8' THEN 'alt' ELSE 'old' END AS set_name FROM (SELECT DISTINCT run_id FROM fx_scores))"
_POINTS = """pt AS (SELECT DISTINCT category, param_model_backbone AS b, param_seed AS s FROM fx_runs), gp AS (SELECT *, CASE WHEN category = 'CHINA' THEN ['all'] ELSE ['real', 'all'] END AS expected FROM pt),
gf AS (SELECT gp.category, gp.b, gp.s, any_value(gp.expected) AS expected, list(DISTINCT r.set_name) FILTER (r.status = 'FINISHED') AS finished FROM gp JOIN fx_runs r ON r.category = gp.category AND r.param_model_backbone = gp.b AND r.param_seed IS NOT DISTINCT FROM gp.s GROUP BY gp.category, gp.b, gp.s),
gc AS (SELECT *, len(list_filter(expected, lambda x: NOT list_contains(coalesce(finished, []), x))) = 0 AS complete FROM gf)"""
_POOLS = """fr AS (SELECT run_id AS category, 'f' || lpad(CAST(sample_id % 60 AS VARCHAR), 2, '0') AS frame, count(*) FILTER (scorer = 'accept') AS kept, count(*) AS total FROM fx_scores GROUP BY ALL),
f1 AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY frame) AS h FROM fr), f2 AS (SELECT category, frame, row_number() OVER (PARTITION BY category ORDER BY kept, total, frame) - 1 AS p FROM f1 WHERE h > 10),
st AS (SELECT fr.category, fr.frame, CASE WHEN p < 12 THEN 'train' ELSE 'source' END AS role, CASE WHEN p < 12 THEN CAST(p % 3 AS INT) END AS seed, kept FROM fr LEFT JOIN f2 ON fr.category = f2.category AND fr.frame = f2.frame)"""
_JUDGE = "jr AS (SELECT *, CASE WHEN image_id % 9 <> 0 THEN category END AS crop, CASE WHEN reward_score > 0 THEN 'accept' END AS scorer FROM fx_manifest), jn AS (SELECT crop, prompt, max(image_id % 50 / 64.0) AS noop FROM jr WHERE crop IS NOT NULL GROUP BY crop, prompt)"

ORACLE_SQL = {k: D.with_views(v) for k, v in {
    "prediction_ids": """pp AS (SELECT *, 'data/' || severity || '/img.' || sample_id || '.png' AS image_path FROM fx_scores)
      SELECT lpad(CAST(row_number() OVER (ORDER BY image_path) - 1 AS VARCHAR), 5, '0') || '_' || severity || '_img.' || sample_id AS sample_id, image_path, label, CASE WHEN label = 1 THEN 'm.png' ELSE '' END AS mask_path, score, scorer, severity FROM pp""",
    "severity_scheme": "SELECT run_id || CASE WHEN label = 0 THEN '-good' ELSE '-bad' END AS cell, bool_or(severity IN ('minimal', 'slight', 'moderate', 'severe')) AS graded FROM fx_scores GROUP BY ALL",
    "severity_vocabulary": """vv AS (SELECT run_id, severity AS v FROM fx_scores UNION SELECT run_id, mask_status FROM fx_scores)
      SELECT run_id, array_to_string(list_filter(['none', 'minimal', 'slight', 'moderate', 'severe'], lambda x: list_contains(list(v), x)), ',') AS grades, string_agg(v, ',' ORDER BY v) FILTER (v NOT IN ('none', 'minimal', 'slight', 'moderate', 'severe')) AS others FROM vv GROUP BY run_id""",
    "scorer_order": "SELECT 'all' AS scorer UNION SELECT scorer FROM fx_scores",
    "recomputed": f"""{_RUNS}, ss AS (SELECT s.*, set_name FROM fx_scores s JOIN sr ON s.run_id = sr.run_id),
      qq AS (SELECT run_id, 'all' AS query, label, score FROM ss WHERE set_name = 'all' AND defect_area_frac IS DISTINCT FROM 0 UNION ALL SELECT run_id, 'defects', label, score FROM ss WHERE set_name = 'all' AND label <> 0 AND defect_area_frac IS DISTINCT FROM 0
        UNION ALL SELECT run_id, 'accepted', label, score FROM ss WHERE set_name = 'alt' AND (scorer = 'accept' OR label = 0)),
      au AS (SELECT run_id, query, count(*) AS n, (sum(ar) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / nullif(CAST(count(*) FILTER (label = 1) AS DOUBLE) * count(*) FILTER (label <> 1), 0) AS auc
        FROM (SELECT *, rank() OVER (PARTITION BY run_id, query ORDER BY score) + (count(*) OVER (PARTITION BY run_id, query, score) - 1) / 2.0 AS ar FROM qq) GROUP BY run_id, query)
      SELECT run_id, query, n AS n_samples, round(auc, 10) AS image_auroc FROM au""",
    "recompute_skipped": f"{_RUNS} SELECT run_id, set_name, 'no queries' AS reason FROM sr WHERE set_name = 'old' UNION ALL SELECT 'x1', 'all', 'no scores' UNION ALL SELECT 'x2', NULL, 'no queries'",
    "grid_resume": f"{_POINTS} SELECT category, b AS param_model_backbone, s AS param_seed, CAST(len(expected) AS INT) AS n_expected, complete FROM gc",
    "grid_stale": f"{_POINTS} SELECT r.run_id, r.status, r.set_name FROM gc JOIN fx_runs r ON r.category = gc.category AND r.param_model_backbone = gc.b AND r.param_seed IS NOT DISTINCT FROM gc.s WHERE r.status <> 'RUNNING' AND NOT (complete AND r.status = 'FINISHED')",
    "layer_aliases": """la AS (SELECT DISTINCT CASE WHEN category > 'J' THEN 'resnet18' ELSE 'dinov2_vitb14' END AS b, CASE param_seed WHEN '1-URGENT' THEN 'default' WHEN '2-HIGH' THEN 'one_additional' WHEN '3-MEDIUM' THEN 'two_additional' ELSE '[''layer1'']' END AS l FROM fx_runs)
      SELECT b, l, CASE WHEN l LIKE '[%' THEN l WHEN b = 'resnet18' THEN CASE l WHEN 'default' THEN '[''layer2'', ''layer3'']' WHEN 'one_additional' THEN '[''layer2'', ''layer3'', ''layer4'']' ELSE '[''layer1'', ''layer2'', ''layer3'', ''layer4'']' END
        ELSE CASE l WHEN 'default' THEN '[-1]' WHEN 'one_additional' THEN '[-2, -1]' ELSE '[-3, -2, -1]' END END AS layers FROM la""",
    "judged_rows": f"""{_JUDGE}, jm AS (SELECT jr.*, n_chars % 100 / 64.0 - noop AS margin, scorer IS NULL AND jr.crop IS NOT NULL AND category IN ('src0', 'src1', 'src2') AS takes FROM jr LEFT JOIN jn ON jr.crop = jn.crop AND jr.prompt = jn.prompt)
      SELECT image_id, CASE WHEN takes THEN CASE WHEN margin >= 0.25 THEN 'accept' ELSE 'reject' END ELSE scorer END AS scorer, round(CASE WHEN takes THEN margin ELSE reward_score END, 10) + 0.0 AS reward_score, CASE WHEN takes THEN 'm1' END AS reward_model, CASE WHEN takes THEN CAST(0.25 AS DOUBLE) END AS reward_accept_margin FROM jm""",
    "rethresholded": f"{_JUDGE} SELECT image_id, CASE WHEN category IN ('src0', 'src3') AND reward_score IS NOT NULL THEN CASE WHEN reward_score >= 0.5 THEN 'accept' ELSE 'reject' END ELSE scorer END AS scorer, CASE WHEN category IN ('src0', 'src3') AND reward_score IS NOT NULL THEN CAST(0.5 AS DOUBLE) END AS reward_accept_margin FROM jr",
    "split_table": f"{_POOLS} SELECT category, frame, role, seed, kept FROM st",
    "split_summary": f"{_POOLS} SELECT category, count(*) FILTER (role = 'source') AS n_source, count(*) FILTER (role = 'train') AS n_train, count(DISTINCT seed) AS n_pools, CAST(sum(CASE WHEN role = 'train' THEN kept ELSE 0 END) AS BIGINT) AS spent_edits FROM st GROUP BY category",
    "overlay_jobs": """oj AS (SELECT category, 'img' || image_id AS source_image_id, CAST(i AS INT) AS overlay_index FROM fx_manifest CROSS JOIN (SELECT unnest(range(2)) AS i)), od AS (SELECT *, sha256('7' || chr(0) || category || chr(0) || source_image_id || chr(0) || overlay_index) AS h FROM oj)
      SELECT source_image_id || '__overlay0' || overlay_index AS image_id, source_image_id, overlay_index, CAST(CAST('0x' || h[15:16] || h[13:14] || h[11:12] || h[9:10] || h[7:8] || h[5:6] || h[3:4] || h[1:2] AS UBIGINT) AS VARCHAR) AS rng_seed FROM od""",
    "extent_bounds": """xe AS (SELECT image_id, category, severity, CASE severity WHEN 'moderate' THEN 'regional' WHEN 'severe' THEN 'object_scale' ELSE 'localized' END AS extent FROM fx_manifest)
      SELECT image_id, category, severity, extent, CAST(CASE WHEN extent = 'regional' AND category = 'src1' THEN 0.05 WHEN extent = 'regional' THEN 0.02 WHEN extent = 'object_scale' THEN 0.1 ELSE 0.0002 END AS DOUBLE) AS extent_lo,
        CAST(CASE WHEN extent = 'regional' AND category = 'src1' THEN 0.5 WHEN extent = 'regional' THEN 0.25 WHEN extent = 'object_scale' THEN 0.8 ELSE 0.05 END AS DOUBLE) AS extent_hi FROM xe""",
    "stretched_boxes": "SELECT p_partkey, abs((100 + p_partkey % 400) / CAST(100 + p_partkey % 173 AS DOUBLE) - 512 / 480.0) > 0.02 * greatest((100 + p_partkey % 400) / CAST(100 + p_partkey % 173 AS DOUBLE), 512 / 480.0) AS stretched FROM part",
    "crop_plans": """cf AS (SELECT p_partkey, CAST(100 + p_partkey % 400 AS INT) AS w, CAST(100 + p_partkey % 173 AS INT) AS h FROM part)
      SELECT p_partkey, 'full' AS layout, 0 AS x0, 0 AS y0, w AS x1, h AS y1 FROM cf UNION ALL
      SELECT p_partkey, 'center', CAST(least(greatest(0, w // 2 - 32), w - 64) AS INT), CAST(least(greatest(0, h // 2 - 32), h - 64) AS INT), CAST(least(greatest(0, w // 2 - 32), w - 64) + 64 AS INT), CAST(least(greatest(0, h // 2 - 32), h - 64) + 64 AS INT) FROM cf""",
}.items()}


# Prompts and staging


def _prompts(spark, sf_dir):
    rows = D.manifest(spark, sf_dir)
    target = F.when(F.col("image_id") % 17 != 0, "defect_free_source")
    first = F.substring("prompt", 1, 400)
    return rows.select("category", F.col("class").alias("mode"), F.col("severity").alias("stage"), F.concat(first, F.lit(" Keep the existing light."), F.when(F.col("image_id") % 13 == 0, " Deepen it.").otherwise("")).alias("prompt"), target.alias("applies_to"))


def prompt_checks(spark, sf_dir):
    modes = D.manifest(spark, sf_dir).groupBy("category").agg(F.count_distinct("class").alias("n_modes")).withColumn("fixed", F.lit("Keep the EXISTING light. "))
    out = P.check_prompts(_prompts(spark, sf_dir), modes, markers=("existing", "deepen"))
    return out.select("category", F.size("failures").alias("n"), F.array_join("failures", "; ").alias("failures"))


def negative_cells(spark, sf_dir):
    return P.negative_prompts(_prompts(spark, sf_dir), "  a clean \n surface ").groupBy("category", "mode", "stage", "prompt").agg(F.count("*").alias("n"))


def benchmark_names(spark, sf_dir):
    paths = D.manifest(spark, sf_dir).select("image_id", F.concat(F.lit("/data/"), F.when(F.col("image_id") % 3 == 0, "MVTec_LOCO").when(F.col("image_id") % 3 == 1, "VisA").otherwise("own"), F.lit("/"), F.col("category"), F.when(F.col("image_id") % 5 == 0, "/x/y").otherwise("/")).alias("path"))
    return paths.select("image_id", P.infer_benchmark(F.col("path")).alias("benchmark"))


def sample_staging(spark, sf_dir):
    rows = D.manifest(spark, sf_dir).select("category", F.col("image_id").alias("place"), F.concat(F.lit("a/"), F.col("image_id").cast("string"), F.lit(".png")).alias("path"), F.col("n_chars").alias("length"))
    staged = rows.where("length % 2 = 0").select("category", F.concat(F.lpad(F.col("place").cast("string"), 2, "0"), F.lit("_"), F.col("place").cast("string"), F.lit(".png")).alias("target"), (F.col("length") - F.col("length") % 4).alias("length"))
    return P.stage_samples(rows, staged)


def sample_stats(spark, sf_dir):
    rows = D.manifest(spark, sf_dir).select("category", F.lpad(F.col("image_id").cast("string"), 8, "0").alias("path"), F.when(F.col("class") != "es", F.when(F.col("category") > "src2", F.col("image_id") % 2 + 5).otherwise(9)).cast("int").alias("width"), F.lit(7).alias("height"), F.col("class").alias("mode"))
    return P.image_stats(rows)


def pending_total(spark, sf_dir):
    rows = D.manifest(spark, sf_dir)
    cells = rows.select("class", "severity").distinct()
    return P.pending_rows(K.shortfall_table(cells, K.generated_counts(rows), 200), ["class"])


def source_frames(spark, sf_dir):
    return P.source_frames(_pool_frames(spark, sf_dir)[1].select("category", "frame"), 10)


QUERIES |= {f.__name__: f for f in (prompt_checks, negative_cells, benchmark_names, sample_staging, sample_stats, pending_total, source_frames)}

_PROMPTS = "pm AS (SELECT category, class AS mode, severity AS stage, lower(substr(prompt, 1, 400) || ' Keep the existing light.' || CASE WHEN image_id % 13 = 0 THEN ' Deepen it.' ELSE '' END) AS t, image_id % 17 <> 0 AS fine FROM fx_manifest)"
ORACLE_SQL |= {k: D.with_views(v) for k, v in {
    "prompt_checks": f"""{_PROMPTS}, pf AS (SELECT category, unnest(list_filter([CASE WHEN NOT fine THEN mode || '/' || stage || ' applies to nothing' END, CASE WHEN contains(replace(t, 'keep the existing light.', ' '), 'existing') THEN mode || '/' || stage || ' names existing' END,
        CASE WHEN contains(replace(t, 'keep the existing light.', ' '), 'deepen') THEN mode || '/' || stage || ' names deepen' END], lambda x: x IS NOT NULL)) AS f FROM pm),
      pc AS (SELECT category, count(*) AS n, count(DISTINCT mode) AS m FROM pm GROUP BY category), pl AS (SELECT category, list(f ORDER BY f) AS fs FROM pf GROUP BY category),
      pr AS (SELECT pc.category, list_concat(CASE WHEN n <> 4 * m THEN [n || ' prompts, expected ' || 4 * m] ELSE [] END, coalesce(fs, [])) AS fs FROM pc LEFT JOIN pl ON pc.category = pl.category)
      SELECT category, CAST(len(fs) AS INT) AS n, array_to_string(fs, '; ') AS failures FROM pr""",
    "negative_cells": "SELECT category, class AS mode, severity AS stage, 'a clean surface' AS prompt, count(*) AS n FROM fx_manifest GROUP BY ALL",
    "benchmark_names": "SELECT image_id, CASE WHEN image_id % 5 = 0 OR image_id % 3 = 2 THEN 'unknown' WHEN image_id % 3 = 0 THEN 'mvtec_ad' ELSE 'visa' END AS benchmark FROM fx_manifest",
    "sample_staging": """SELECT category, 'a/' || image_id || '.png' AS path, CASE WHEN image_id < 10 THEN '0' || image_id ELSE left(CAST(image_id AS VARCHAR), 2) END || '_' || image_id || '.png' AS target,
      CASE WHEN n_chars % 2 = 1 THEN 'copy' WHEN n_chars % 4 = 0 THEN 'keep' ELSE 'diverged' END AS action FROM fx_manifest""",
    "sample_stats": """iw AS (SELECT category, lpad(CAST(image_id AS VARCHAR), 8, '0') AS path, CASE WHEN class <> 'es' THEN CASE WHEN category > 'src2' THEN image_id % 2 + 5 ELSE 9 END END AS width, class AS mode FROM fx_manifest),
      is2 AS (SELECT category, CAST(arg_min(width, path) AS INT) AS width, arg_min(mode, path) AS mode, count(DISTINCT width) = 1 AS us, count(DISTINCT mode) = 1 AS um FROM iw WHERE width IS NOT NULL GROUP BY category), ic AS (SELECT DISTINCT category FROM iw)
      SELECT ic.category, CASE WHEN us IS NULL THEN 'failed' ELSE 'ok' END AS probe, width, CASE WHEN us IS NOT NULL THEN 7 END AS height, mode, us AS uniform_size, um AS uniform_mode FROM ic LEFT JOIN is2 ON ic.category = is2.category""",
    "pending_total": "SELECT class, CAST(sum(greatest(0, 200 - n)) AS BIGINT) AS pending FROM (SELECT class, severity, count(*) AS n FROM fx_manifest GROUP BY ALL) GROUP BY class",
    "source_frames": f"{_POOLS} SELECT category, frame, CASE WHEN row_number() OVER (PARTITION BY category ORDER BY frame) <= 10 THEN 'source' ELSE 'train' END AS role FROM fr",
}.items()}
