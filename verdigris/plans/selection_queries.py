"""Selection queries over the canonical paired view, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import rounded
from ..operators import selection as S
from ..sources import driver_tables as D

POP = ", ".join(D.POPULATION)
WIDE = "metric, set_name, query, category, param_data_num_train_samples"


def selection_sql(keys: str, src: str = "fx_paired", k: int = 1, min_n: int = 4, name: str = "sel") -> str:
    """CTEs up to `name`, the population statistics."""
    return f"""x AS (SELECT *, real IS NOT NULL AND synth IS NOT NULL AS ok FROM {src}),
o AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY synth DESC) + count(*) OVER (PARTITION BY {keys}, synth) - 1 AS worst,
  row_number() OVER (PARTITION BY {keys} ORDER BY synth DESC, real) AS place, max(real) OVER (PARTITION BY {keys}) AS best, max(synth) OVER (PARTITION BY {keys}) AS top FROM x WHERE ok),
g AS (SELECT {keys}, count(*) AS n, max(real) AS real_best, avg(real) AS real_mean, min(real) AS real_worst, avg(real) FILTER (synth = top) AS real_chosen, count(*) FILTER (synth = top) AS n_tied,
  avg(CASE WHEN real = best THEN 1.0 ELSE 0.0 END) FILTER (synth = top) AS hit, max(real) FILTER (place <= {k}) AS at_k, min(worst) FILTER (real = best) AS rank_of_best FROM o GROUP BY {keys}),
a AS (SELECT {keys}, count(*) AS total FROM x GROUP BY {keys}),
{name} AS (SELECT {', '.join('a.' + c.strip() for c in keys.split(','))}, coalesce(n, 0) AS n, total - coalesce(n, 0) AS n_dropped, {k} AS k, CAST(0.05 AS DOUBLE) AS alpha,
  CASE WHEN n >= {min_n} THEN real_best - real_chosen END AS regret, CASE WHEN n >= {min_n} THEN real_best - at_k END AS regret_at_k, CASE WHEN n >= {min_n} THEN hit END AS hit,
  CASE WHEN n >= {min_n} THEN CASE WHEN at_k = real_best THEN 1.0 ELSE 0.0 END END AS hit_at_k,
  CASE WHEN n >= {min_n} AND real_best > real_worst THEN 1 - (real_best - real_chosen) / nullif(real_best - real_mean, 0) END AS skill,
  CASE WHEN n >= {min_n} AND real_best > real_worst THEN 1 - (real_best - at_k) / nullif(real_best - real_mean, 0) END AS skill_at_k,
  CASE WHEN n >= {min_n} THEN real_best END AS real_best, CASE WHEN n >= {min_n} THEN real_chosen END AS real_chosen, CASE WHEN n >= {min_n} THEN real_mean END AS real_mean,
  CASE WHEN n >= {min_n} THEN real_worst END AS real_worst, CASE WHEN n >= {min_n} THEN real_best - real_mean END AS regret_random, CASE WHEN n >= {min_n} THEN real_best - real_worst END AS regret_worst,
  CASE WHEN n >= {min_n} THEN rank_of_best END AS synth_rank_of_best, CASE WHEN n >= {min_n} THEN n_tied END AS n_tied_at_top
  FROM a LEFT JOIN g ON {' AND '.join(f'a.{c.strip()} IS NOT DISTINCT FROM g.{c.strip()}' for c in keys.split(','))})"""


DOUBLES = ("regret", "regret_at_k", "hit", "hit_at_k", "skill", "skill_at_k", "real_best", "real_chosen", "real_mean", "real_worst", "regret_random", "regret_worst")


def rnd(columns, prefix: str = "") -> str:
    return ", ".join(f"round(CAST({prefix}{c} AS DOUBLE), 10) + 0.0 AS {c}" for c in columns)


SELECTED = f"n, n_dropped, k, round(alpha, 10) AS alpha, {rnd(DOUBLES)}, synth_rank_of_best, n_tied_at_top"


def selection_regret(spark, sf_dir):
    return rounded(S.evaluate_selection(D.paired(spark, sf_dir), D.POPULATION))


def selection_at_k(spark, sf_dir):
    return rounded(S.evaluate_selection(D.paired(spark, sf_dir), D.POPULATION, k=3))


def selection_missing(spark, sf_dir):
    return rounded(S.evaluate_selection(D.paired_gaps(spark, sf_dir), D.POPULATION, min_n=12))


def selection_rank_of_best(spark, sf_dir):
    return S.evaluate_selection(D.paired(spark, sf_dir), D.POPULATION).select(*D.POPULATION, "n", "synth_rank_of_best", "n_tied_at_top")


def selection_thin_queries(spark, sf_dir):
    return rounded(S.evaluate_selection(D.paired(spark, sf_dir), D.POPULATION, min_defect_samples=20))


def aggregate_replicates(spark, sf_dir):
    return rounded(S.aggregate_replicates(D.paired(spark, sf_dir)).drop("model_id"))


def selection_pooled(spark, sf_dir):
    return rounded(S.evaluate_selection(S.aggregate_replicates(D.paired(spark, sf_dir)), S.DEFAULT_BY))


def replicate_noise(spark, sf_dir):
    return rounded(S.replicate_noise(D.paired(spark, sf_dir), S.conditioned_by(D.paired(spark, sf_dir))))


def selection_with_noise(spark, sf_dir):
    out = S.evaluate_per_training_set(D.paired(spark, sf_dir))
    return rounded(out.select(*D.POPULATION, "regret", "regret_random", "real_noise_sd", "regret_in_noise_sd", "decidable"))


def selection_bootstrap(spark, sf_dir):
    return S.evaluate_selection(D.paired(spark, sf_dir), D.POPULATION, n_boot=100, rng=0)


BY_FIXED = ["metric", "param_seed", "param_data_num_train_samples"]


def fixed_config_choice(spark, sf_dir):
    return rounded(S.fixed_config_choice(D.paired(spark, sf_dir), BY_FIXED))


def fixed_config_baseline(spark, sf_dir):
    return rounded(S.fixed_config_baseline(D.paired(spark, sf_dir), BY_FIXED))


def leave_one_out_query(spark, sf_dir):
    out = S.leave_one_out_query(D.paired(spark, sf_dir), D.POPULATION)
    return rounded(out.select(*D.POPULATION, "chosen_on", "regret", "skill"))


def config_dimensions(spark, sf_dir):
    names = S.config_dimensions(D.paired(spark, sf_dir), D.POPULATION)
    return spark.createDataFrame([(n,) for n in names], "config string")


FIXED_CTES = """sc AS (SELECT metric, param_seed, param_data_num_train_samples, category, param_model_backbone AS b, param_model_coreset_sampling_ratio AS c, avg(real) AS real FROM fx_paired GROUP BY ALL),
rk AS (SELECT *, rank() OVER f + (count(*) OVER (PARTITION BY metric, param_seed, param_data_num_train_samples, category, real) - 1) / 2.0 AS rank FROM sc
  WINDOW f AS (PARTITION BY metric, param_seed, param_data_num_train_samples, category ORDER BY real DESC)),
mr AS (SELECT h.metric, h.param_seed, h.param_data_num_train_samples, h.category, h.b, h.c, avg(o.rank) AS mean_rank, any_value(h.real) AS real
  FROM rk h JOIN rk o ON h.metric = o.metric AND h.param_seed = o.param_seed AND h.param_data_num_train_samples = o.param_data_num_train_samples AND h.b = o.b AND h.c = o.c AND h.category <> o.category GROUP BY 1, 2, 3, 4, 5, 6),
pk AS (SELECT *, row_number() OVER (PARTITION BY metric, param_seed, param_data_num_train_samples, category ORDER BY round(mean_rank, 10), b, c) AS rn FROM mr),
fc AS (SELECT t.*, pk.b, pk.c, pk.real FROM (SELECT metric, param_seed, param_data_num_train_samples, category, max(real) AS best FROM sc GROUP BY ALL) t LEFT JOIN pk
  ON rn = 1 AND t.metric = pk.metric AND t.param_seed = pk.param_seed AND t.param_data_num_train_samples = pk.param_data_num_train_samples AND t.category = pk.category)"""

QUERIES = {f.__name__: f for f in (
    selection_regret, selection_at_k, selection_missing, selection_rank_of_best, selection_thin_queries, aggregate_replicates, selection_pooled, replicate_noise,
    selection_with_noise, selection_bootstrap, fixed_config_choice, fixed_config_baseline, leave_one_out_query, config_dimensions)}

NOISE = f"""ni AS (SELECT {WIDE}, param_model_backbone, param_model_coreset_sampling_ratio, var_samp(real) AS v, count(real) AS m FROM fx_paired GROUP BY ALL),
nz AS (SELECT {WIDE}, sqrt(avg(v)) AS real_noise_sd, count(*) FILTER (m > 1) AS n_configs_replicated, max(m) AS max_replicates FROM ni GROUP BY {WIDE})"""
AGG = """SELECT metric, set_name, query, category, param_data_num_train_samples, param_model_backbone, param_model_coreset_sampling_ratio, avg(real) AS real, avg(synth) AS synth, count(*) AS n_replicates,
  min(n_samples) AS n_samples, min(n_defect_samples) AS n_defect_samples FROM fx_paired GROUP BY ALL"""

ORACLE_SQL = {k: D.with_views(v) for k, v in {
    "selection_regret": f"{selection_sql(POP)} SELECT {POP}, {SELECTED} FROM sel",
    "selection_at_k": f"{selection_sql(POP, k=3)} SELECT {POP}, {SELECTED} FROM sel",
    "selection_missing": f"{selection_sql(POP, 'fx_gaps', min_n=12)} SELECT {POP}, {SELECTED} FROM sel",
    "selection_rank_of_best": f"{selection_sql(POP)} SELECT {POP}, n, synth_rank_of_best, n_tied_at_top FROM sel",
    "selection_thin_queries": f"th AS (SELECT * FROM fx_paired WHERE n_defect_samples >= 20), {selection_sql(POP, 'th')} SELECT {POP}, {SELECTED} FROM sel",
    "aggregate_replicates": f"ag AS ({AGG}) SELECT * REPLACE ({rnd(('real', 'synth'))}) FROM ag",
    "selection_pooled": f"ag AS ({AGG}), {selection_sql('metric, set_name, query, category', 'ag')} SELECT metric, set_name, query, category, {SELECTED} FROM sel",
    "replicate_noise": f"{NOISE} SELECT * REPLACE ({rnd(('real_noise_sd',))}) FROM nz",
    "selection_with_noise": f"""{selection_sql(POP)}, {NOISE} SELECT {POP}, {rnd(('regret', 'regret_random', 'real_noise_sd'))},
      round(CASE WHEN real_noise_sd > 0 THEN regret / real_noise_sd END, 10) + 0.0 AS regret_in_noise_sd, coalesce(regret_random > real_noise_sd, false) AS decidable FROM sel LEFT JOIN nz USING ({WIDE})""",
    "fixed_config_choice": f"""{FIXED_CTES} SELECT metric, param_seed, param_data_num_train_samples, category, b AS param_model_backbone, c AS param_model_coreset_sampling_ratio,
      'param_model_backbone=' || b || ', param_model_coreset_sampling_ratio=' || c AS fixed_config, round(real, 10) AS real_fixed, round(best, 10) AS real_best FROM fc""",
    "fixed_config_baseline": f"""{FIXED_CTES} SELECT metric, param_seed, param_data_num_train_samples, category, 'param_model_backbone=' || b || ', param_model_coreset_sampling_ratio=' || c AS fixed_config,
      round(real, 10) AS real_fixed, round(best, 10) AS real_best, round(best - real, 10) + 0.0 AS regret_fixed FROM fc""",
    "leave_one_out_query": f"""{selection_sql(POP)}, lo AS (SELECT h.*, o.m AS chosen_on FROM sel h JOIN (SELECT a.category AS held, a.metric, a.set_name, a.query, a.param_seed, a.param_data_num_train_samples, avg(b.skill) AS m
      FROM sel a JOIN sel b ON a.metric = b.metric AND a.set_name = b.set_name AND a.query = b.query AND a.param_seed = b.param_seed AND a.param_data_num_train_samples = b.param_data_num_train_samples AND a.category <> b.category GROUP BY ALL) o
      ON h.category = o.held AND h.metric = o.metric AND h.set_name = o.set_name AND h.query = o.query AND h.param_seed = o.param_seed AND h.param_data_num_train_samples = o.param_data_num_train_samples WHERE o.m IS NOT NULL)
      SELECT {POP}, {rnd(('chosen_on', 'regret', 'skill'))} FROM lo QUALIFY row_number() OVER (PARTITION BY metric, set_name, param_seed, param_data_num_train_samples, category ORDER BY round(chosen_on, 10) DESC, query) = 1""",
    "config_dimensions": "SELECT * FROM (VALUES ('param_model_backbone'), ('param_model_coreset_sampling_ratio')) t(config)",
}.items()}
