"""Correlation, calibration, selected-metric and pairing queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import rounded
from ..operators import correlation as C
from ..operators import pairing as P
from ..operators import selected as W
from ..operators import selection as S
from ..sources import driver_tables as D
from .selection_queries import BY_FIXED, FIXED_CTES, POP, rnd, selection_sql


def proxy_moments(spark, sf_dir):
    out = C.correlate(D.paired(spark, sf_dir), D.POPULATION, p_values=False)
    return rounded(out.drop("spearman_rho", "kendall_tau"))


def spearman(spark, sf_dir):
    return rounded(C.correlate(D.paired(spark, sf_dir), D.POPULATION, p_values=False).select(*D.POPULATION, "n", "spearman_rho"))


def kendall_tau(spark, sf_dir):
    return rounded(C.correlate(D.paired(spark, sf_dir), D.POPULATION, p_values=False).select(*D.POPULATION, "n", "kendall_tau"))


def proxy_pvalues(spark, sf_dir):
    return C.correlate(D.paired(spark, sf_dir), D.POPULATION).select(*D.POPULATION, "n", "pearson_p", "spearman_p", "kendall_p")


BIAS = "metric, set_name, severity, scorer, category, param_seed, param_data_num_train_samples"


def bias(spark, sf_dir):
    return rounded(C.evaluate_bias(D.paired(spark, sf_dir), D.POPULATION, intervals=False))


def bias_intervals(spark, sf_dir):
    return C.evaluate_bias(D.paired(spark, sf_dir), D.POPULATION)


def bias_worst(spark, sf_dir):
    return C.worst_cells(C.evaluate_bias(D.paired(spark, sf_dir), D.POPULATION), n=20)


def split_queries(spark, sf_dir):
    q = D.paired(spark, sf_dir).select("query").distinct().select(F.explode(F.array("query", F.concat("query", F.lit("_accept")), F.concat("query", F.lit("_severe")), F.concat(F.lit("odd_"), "query"))).alias("query"))
    return C.with_severity(q)


BY_SELECTED = ["metric", "set_name", "query", "category", "param_seed", "param_data_num_train_samples"]
RULES = ("fixed", "image_auroc@all", "aupro@severe", "nothing@all", "oracle")
METRICS = ("image_auroc", "aupro", "pixel_auroc")


def _selected(spark, sf_dir):
    return W.selected_metrics(D.paired(spark, sf_dir), by=BY_SELECTED, selectors=RULES, metrics=METRICS)


def selected_metrics(spark, sf_dir):
    return rounded(_selected(spark, sf_dir))


def selected_summary(spark, sf_dir):
    return rounded(W.summarise_selected(_selected(spark, sf_dir)))


def selected_wide(spark, sf_dir):
    wide = W.wide_table(W.summarise_selected(_selected(spark, sf_dir)), metrics=METRICS, selectors=("fixed", "image_auroc@all", "oracle"))
    return rounded(W.with_mean_row(wide))


def selected_marks(spark, sf_dir):
    marks = W.rank_marks(W.summarise_selected(_selected(spark, sf_dir)).select("category", "selector", "metric", F.round("value", 10).alias("value")))
    return rounded(marks)


def combined(spark, sf_dir):
    p = D.paired(spark, sf_dir)
    out = S.build_combined(C.correlate(p, D.POPULATION, p_values=False).select(*D.POPULATION, "pearson_r"), S.evaluate_selection(p, D.POPULATION).select(*D.POPULATION, "regret", "skill"), S.fixed_config_baseline(p, BY_FIXED), D.POPULATION)
    return rounded(out.select(*D.POPULATION, "pearson_r", "regret", "skill", "regret_fixed", "beats_fixed"))


RUN_KEYS = ["category", "param_model_backbone", "param_seed"]


def latest_runs(spark, sf_dir):
    done = D.runs(spark, sf_dir).where("status = 'FINISHED'")
    return P.latest_runs(done, [*RUN_KEYS, "set_name"]).select(*RUN_KEYS, "set_name", "run_id")


def pair_runs(spark, sf_dir):
    return P.pair_runs(D.runs(spark, sf_dir), group_keys=RUN_KEYS)


def unpaired_runs(spark, sf_dir):
    return P.unpaired_runs(D.runs(spark, sf_dir), group_keys=RUN_KEYS)


def paired_metrics(spark, sf_dir):
    return rounded(D.paired(spark, sf_dir))


def _run_metrics(spark, sf_dir):
    r = D.runs(spark, sf_dir).where("status = 'FINISHED'")
    n = F.col("run_id").cast("long")
    return r.select("run_id", F.explode(F.array(F.lit("all"), F.lit("severe"))).alias("query"), ((n % 97) / 97.0).alias("image_auroc"), ((n % 89) / 89.0).alias("aupro"), F.when(n % 5 != 0, (n % 13) / 13.0).alias("severity_tau_b"), (n % 50).alias("n_samples"), (n % 20).alias("n_defect_samples"))


def melt_metrics(spark, sf_dir):
    return rounded(P.melt_metrics(_run_metrics(spark, sf_dir), "value", ["run_id", "query"]))


def proxy_targets(spark, sf_dir):
    real = P.melt_metrics(_run_metrics(spark, sf_dir).where("query = 'all'"), "real", ["run_id"])
    return rounded(P.with_proxy_targets(real))


def built_pairs(spark, sf_dir):
    out = P.build_paired_metrics(D.runs(spark, sf_dir), _run_metrics(spark, sf_dir), group_keys=RUN_KEYS)
    return rounded(out)


QUERIES = {f.__name__: f for f in (
    proxy_moments, spearman, kendall_tau, proxy_pvalues, bias, bias_intervals, bias_worst, split_queries, selected_metrics, selected_summary, selected_wide, selected_marks, combined,
    latest_runs, pair_runs, unpaired_runs, paired_metrics, melt_metrics, proxy_targets, built_pairs)}

RANKED = f"""bo AS (SELECT * FROM fx_paired WHERE real IS NOT NULL AND synth IS NOT NULL),
ra AS (SELECT *, rank() OVER (PARTITION BY {POP} ORDER BY real) + (count(*) OVER (PARTITION BY {POP}, real) - 1) / 2.0 AS rr, rank() OVER (PARTITION BY {POP} ORDER BY synth) + (count(*) OVER (PARTITION BY {POP}, synth) - 1) / 2.0 AS sr FROM bo)"""


def pearson(x: str, y: str) -> str:
    return f"greatest(-1.0, least(1.0, covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y}))))"


def varies(n: int = 4) -> str:
    return f"count(*) >= {n} AND min(real) < max(real) AND min(synth) < max(synth)"


_Z = "1.959963984540054"
MOMENTS = f"""{RANKED}, pm AS (SELECT {POP}, count(*) AS n, CASE WHEN {varies()} THEN {pearson('real', 'synth')} END AS r, min(real) AS real_min, max(real) AS real_max, stddev_samp(real) AS real_sd,
  min(synth) AS synth_min, max(synth) AS synth_max, stddev_samp(synth) AS synth_sd FROM ra GROUP BY {POP})
SELECT {POP}, n, round(r, 10) + 0.0 AS pearson_r, round(r * r, 10) AS pearson_r2,
  CASE WHEN n > 3 AND abs(r) < 1 THEN round(tanh(atanh(r) - {_Z} / sqrt(n - 3)), 10) + 0.0 END AS pearson_ci_lo, CASE WHEN n > 3 AND abs(r) < 1 THEN round(tanh(atanh(r) + {_Z} / sqrt(n - 3)), 10) + 0.0 END AS pearson_ci_hi,
  {rnd(('real_min', 'real_max', 'real_sd', 'synth_min', 'synth_max', 'synth_sd'))}, round(real_max - real_min, 10) + 0.0 AS real_range, round(synth_max - synth_min, 10) + 0.0 AS synth_range FROM pm"""
TAU = f"""bo AS (SELECT *, row_number() OVER () AS rid FROM fx_paired WHERE real IS NOT NULL AND synth IS NOT NULL),
pr AS (SELECT {', '.join('a.' + k.strip() for k in POP.split(','))}, sign(a.real - b.real) AS dr, sign(a.synth - b.synth) AS ds FROM bo a JOIN bo b ON {' AND '.join(f'a.{k.strip()} = b.{k.strip()}' for k in POP.split(','))} AND a.rid < b.rid),
tb AS (SELECT {POP}, sum(dr * ds) / nullif(sqrt(CAST(count(*) FILTER (dr <> 0) AS DOUBLE) * count(*) FILTER (ds <> 0)), 0) AS tau FROM pr GROUP BY {POP}),
nn AS (SELECT {POP}, count(*) AS n FROM bo GROUP BY {POP})
SELECT {', '.join('nn.' + k.strip() for k in POP.split(','))}, n, CASE WHEN n >= 4 THEN round(tau, 10) + 0.0 END AS kendall_tau FROM nn LEFT JOIN tb USING ({POP})"""
SPLIT = """CASE WHEN query IN ('all', 'minimal', 'slight', 'moderate', 'severe') THEN query ELSE query END"""
BIAS_SQL = f"""bb AS (SELECT metric, set_name, query AS severity, 'all' AS scorer, category, param_seed, param_data_num_train_samples, CASE WHEN real IS NOT NULL AND synth IS NOT NULL THEN real END AS r, CASE WHEN real IS NOT NULL AND synth IS NOT NULL THEN synth END AS s, synth - real AS d FROM fx_paired)
SELECT {BIAS}, count(d) AS n, count(*) - count(d) AS n_dropped, round(avg(r), 10) + 0.0 AS real_mean, round(avg(s), 10) + 0.0 AS synth_mean, round(avg(d), 10) + 0.0 AS bias, round(median(d), 10) + 0.0 AS bias_median, round(avg(abs(d)), 10) AS bias_abs,
  round(avg(CASE WHEN d > 0 THEN 1.0 WHEN d <= 0 THEN 0.0 END), 10) AS share_over, round(min(d), 10) + 0.0 AS bias_min, round(max(d), 10) + 0.0 AS bias_max,
  CASE WHEN count(d) >= 3 THEN round(CASE WHEN stddev_samp(d) <= 1e-9 * greatest(max(abs(d)), 1) THEN 0 ELSE stddev_samp(d) END, 10) END AS bias_sd,
  CASE WHEN count(d) >= 3 THEN round(CASE WHEN stddev_samp(d) <= 1e-9 * greatest(max(abs(d)), 1) THEN 0 ELSE stddev_samp(d) END / sqrt(count(d)), 10) END AS bias_se FROM bb GROUP BY {BIAS}"""
SPOP = "set_name, category, param_seed, param_data_num_train_samples"
SEL = f"""tb0 AS (SELECT {SPOP}, param_model_backbone AS b, param_model_coreset_sampling_ratio AS c, avg(real) FILTER (metric = 'image_auroc') AS r0, avg(real) FILTER (metric = 'aupro') AS r1, avg(real) FILTER (metric = 'pixel_auroc') AS r2,
  avg(synth) FILTER (metric = 'image_auroc' AND query = 'all') AS s1, avg(synth) FILTER (metric = 'aupro' AND query = 'severe') AS s2 FROM fx_paired GROUP BY ALL),
tb1 AS (SELECT *, count(*) OVER (PARTITION BY {SPOP}) AS n_models, 'param_model_backbone=' || b || ', param_model_coreset_sampling_ratio=' || c AS label FROM tb0 QUALIFY count(*) OVER (PARTITION BY {SPOP}) >= 3),
{FIXED_CTES},
tb2 AS (SELECT tb1.*, fc.b IS NOT NULL AS is_fixed FROM tb1 LEFT JOIN fc ON fc.metric = 'image_auroc' AND fc.param_seed = tb1.param_seed AND fc.param_data_num_train_samples = tb1.param_data_num_train_samples AND fc.category = tb1.category AND fc.b = tb1.b AND fc.c = tb1.c),
tb3 AS (SELECT {SPOP}, n_models, label, sel.s AS selector, m.m AS metric, CASE m.m WHEN 'image_auroc' THEN r0 WHEN 'aupro' THEN r1 ELSE r2 END AS real,
  CASE sel.s WHEN 'fixed' THEN is_fixed WHEN 'image_auroc@all' THEN s1 = max(s1) OVER p WHEN 'aupro@severe' THEN s2 = max(s2) OVER p WHEN 'oracle' THEN
    CASE m.m WHEN 'image_auroc' THEN r0 = max(r0) OVER p WHEN 'aupro' THEN r1 = max(r1) OVER p ELSE r2 = max(r2) OVER p END ELSE false END AS picked
  FROM tb2 CROSS JOIN (VALUES ('fixed'), ('image_auroc@all'), ('aupro@severe'), ('nothing@all'), ('oracle')) sel(s) CROSS JOIN (VALUES ('image_auroc'), ('aupro'), ('pixel_auroc')) m(m) WINDOW p AS (PARTITION BY {SPOP}, sel.s, m.m)),
tb4 AS (SELECT {SPOP}, selector, metric, avg(real) FILTER (picked) AS value, max(real) AS best, avg(real) AS chance, min(real) AS worst, any_value(n_models) AS n_models, count(*) FILTER (picked) AS n_tied, min(label) FILTER (picked) AS label FROM tb3 GROUP BY {SPOP}, selector, metric),
sm AS (SELECT {SPOP}, selector, metric, value, best, chance, best - value AS regret, CASE WHEN best > worst AND best > chance THEN 1 - (best - value) / (best - chance) END AS skill, n_models, n_tied, CASE WHEN n_tied > 1 THEN n_tied || ' tied' ELSE label END AS config FROM tb4)"""
SUM = f"""{SEL}, ss AS (SELECT category, selector, metric, avg(value) AS value, stddev_samp(value) AS value_sd, avg(regret) AS regret, stddev_samp(regret) AS regret_sd, avg(skill) AS skill, stddev_samp(skill) AS skill_sd, avg(best) AS best, avg(chance) AS chance, count(*) AS n, count(value) AS n_value FROM sm GROUP BY ALL)"""
_WIDE = [(m, s) for m in METRICS for s in ("fixed", "image_auroc@all", "oracle")]
PIVOT = ", ".join(f"avg(value) FILTER (metric = '{m}' AND selector = '{s}') AS \"{m}@@{s}\"" for m, s in _WIDE)
MEANS = ", ".join(f"avg(\"{m}@@{s}\") AS \"{m}@@{s}\"" for m, s in _WIDE)
ROUNDED = ", ".join(f"round(\"{m}@@{s}\", 10) + 0.0 AS \"{m}@@{s}\"" for m, s in _WIDE)
RM = """rm AS (SELECT run_id, q.query, (CAST(run_id AS BIGINT) % 97) / 97.0 AS image_auroc, (CAST(run_id AS BIGINT) % 89) / 89.0 AS aupro, CASE WHEN CAST(run_id AS BIGINT) % 5 <> 0 THEN (CAST(run_id AS BIGINT) % 13) / 13.0 END AS severity_tau_b,
  CAST(run_id AS BIGINT) % 50 AS n_samples, CAST(run_id AS BIGINT) % 20 AS n_defect_samples FROM fx_runs CROSS JOIN (VALUES ('all'), ('severe')) q(query) WHERE status = 'FINISHED'),
ml AS (SELECT run_id, query, n_samples, n_defect_samples, m.m AS metric, CAST(CASE m.m WHEN 'image_auroc' THEN image_auroc WHEN 'aupro' THEN aupro ELSE severity_tau_b END AS DOUBLE) AS value FROM rm CROSS JOIN (VALUES ('image_auroc'), ('aupro'), ('severity_tau_b')) m(m)),
rl AS (SELECT run_id, metric, value AS real FROM ml WHERE query = 'all' AND metric <> 'severity_tau_b' UNION ALL SELECT run_id, p.p, value FROM ml CROSS JOIN (VALUES ('severity_cindex'), ('severity_cindex_defects'), ('severity_tau_b'), ('severity_spearman'), ('severity_adjacent_auc')) p(p) WHERE query = 'all' AND metric = 'image_auroc')"""
LATEST = """lr AS (SELECT * FROM fx_runs WHERE status = 'FINISHED' QUALIFY row_number() OVER (PARTITION BY category, param_model_backbone, param_seed, set_name ORDER BY start_time DESC, run_id) = 1)"""
PAIRS = f"""{LATEST}, pq AS (SELECT s.category, s.param_model_backbone, s.param_seed, s.set_name, s.run_id AS synth_run_id, r.run_id AS real_run_id FROM lr s JOIN lr r ON s.category = r.category AND s.param_model_backbone = r.param_model_backbone
  AND s.param_seed IS NOT DISTINCT FROM r.param_seed WHERE s.set_name <> 'real' AND r.set_name = 'real'),
pp AS (SELECT *, dense_rank() OVER (ORDER BY category, param_model_backbone, param_seed NULLS LAST) - 1 AS model_id FROM pq)"""

ORACLE_SQL = {k: D.with_views(v) for k, v in {
    "proxy_moments": MOMENTS,
    "spearman": f"{RANKED} SELECT {POP}, count(*) AS n, CASE WHEN {varies()} THEN round({pearson('rr', 'sr')}, 10) + 0.0 END AS spearman_rho FROM ra GROUP BY {POP}",
    "kendall_tau": TAU.replace("CASE WHEN n >= 4 THEN", "CASE WHEN n >= 4 AND tau IS NOT NULL THEN"),
    "bias": BIAS_SQL,
    "split_queries": """qs AS (SELECT DISTINCT query AS q FROM fx_paired) SELECT query, CASE WHEN kind = 0 THEN q WHEN kind = 1 THEN q WHEN kind = 2 AND q = 'all' THEN 'severe' WHEN kind = 2 THEN query ELSE query END AS severity,
      CASE WHEN kind = 1 THEN 'accept' ELSE 'all' END AS scorer FROM (SELECT q, q AS query, 0 AS kind FROM qs UNION ALL SELECT q, q || '_accept', 1 FROM qs UNION ALL SELECT q, q || '_severe', 2 FROM qs UNION ALL SELECT q, 'odd_' || q, 3 FROM qs)""",
    "selected_metrics": f"{SEL} SELECT * REPLACE ({rnd(('value', 'best', 'chance', 'regret', 'skill'))}) FROM sm",
    "selected_summary": f"{SUM} SELECT * REPLACE ({rnd(('value', 'value_sd', 'regret', 'regret_sd', 'skill', 'skill_sd', 'best', 'chance'))}) FROM ss",
    "selected_wide": f"{SUM}, wd AS (SELECT category, {PIVOT} FROM ss GROUP BY category), wm AS (SELECT * FROM wd UNION ALL SELECT 'mean' AS category, {MEANS} FROM wd) SELECT category, {ROUNDED} FROM wm",
    "selected_marks": f"""{SUM}, mk AS (SELECT category, selector, metric, round(round(value, 10), 3) + 0.0 AS value, CASE WHEN selector <> 'oracle' THEN round(round(value, 10), 3) END AS cell FROM ss)
      SELECT category, selector, metric, value, CASE WHEN cell IS NULL OR count(cell) OVER (PARTITION BY category, metric) < 2 THEN '' ELSE CASE dense_rank() OVER (PARTITION BY category, metric ORDER BY cell DESC NULLS LAST) WHEN 1 THEN 'best' WHEN 2 THEN 'second' ELSE '' END END AS mark FROM mk""",
    "combined": f"""{selection_sql(POP)}, {RANKED}, pm AS (SELECT {POP}, CASE WHEN {varies()} THEN {pearson('real', 'synth')} END AS r FROM ra GROUP BY {POP}), {FIXED_CTES}
      SELECT {POP}, round(r, 10) + 0.0 AS pearson_r, {rnd(('regret', 'skill'))}, round(best - real, 10) + 0.0 AS regret_fixed, regret < best - real AS beats_fixed FROM sel LEFT JOIN pm USING ({POP}) LEFT JOIN fc USING (metric, param_seed, param_data_num_train_samples, category)""",
    "latest_runs": f"{LATEST} SELECT category, param_model_backbone, param_seed, set_name, run_id FROM lr",
    "pair_runs": f"{PAIRS} SELECT model_id, real_run_id, synth_run_id, set_name, category, param_model_backbone, param_seed FROM pp",
    "unpaired_runs": """up AS (SELECT category, param_model_backbone, param_seed, count(*) FILTER (set_name = 'real') AS n_real, count(*) FILTER (set_name <> 'real') AS n_synth FROM fx_runs WHERE status = 'FINISHED' GROUP BY ALL)
      SELECT *, CASE WHEN n_real = 0 THEN 'real' ELSE 'synth' END AS missing FROM up WHERE n_real = 0 OR n_synth = 0""",
    "paired_metrics": f"SELECT * REPLACE ({rnd(('real', 'synth'))}) FROM fx_paired",
    "melt_metrics": f"{RM} SELECT run_id, query, metric, round(value, 10) AS value FROM ml",
    "proxy_targets": f"{RM} SELECT run_id, metric, round(real, 10) AS real FROM rl",
    "built_pairs": f"""{RM}, {PAIRS} SELECT model_id, set_name, category, param_model_backbone, param_seed, ml.query, ml.metric, round(rl.real, 10) AS real, round(ml.value, 10) AS synth, n_samples, n_defect_samples, real_run_id, synth_run_id
      FROM pp JOIN ml ON ml.run_id = synth_run_id LEFT JOIN rl ON rl.run_id = real_run_id AND rl.metric = ml.metric""",
}.items()}
