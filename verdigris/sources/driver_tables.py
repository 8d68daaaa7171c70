"""Canonical inputs of the analytics operators as views over the driver's star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONFIGS = ["param_model_backbone", "param_model_coreset_sampling_ratio"]
TRAINING = ["param_seed", "param_data_num_train_samples"]
KEYS = ["category", *TRAINING, *CONFIGS]
POPULATION = ["metric", "set_name", "query", "category", *TRAINING]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored items behind each metric."""
    t = lambda n: table(spark, sf_dir, n)
    grade = F.when(F.col("l_discount") <= 0.025, "minimal").when(F.col("l_discount") <= 0.055, "slight").when(F.col("l_discount") <= 0.085, "moderate").otherwise("severe")
    joined = (
        t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.select(
        F.col("r_name").alias("category"), (F.year("l_shipdate") % 3).cast("string").alias("param_seed"), F.col("l_linestatus").alias("param_data_num_train_samples"),
        F.col("l_returnflag").alias("param_model_backbone"), F.col("l_linenumber").cast("string").alias("param_model_coreset_sampling_ratio"), grade.alias("grade"),
        "l_extendedprice", "l_quantity", "l_tax", "l_discount",
    )


def real_and_synth(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Long-form real arm (keys, metric, real) and synthetic arm (keys, query, metric, synth, counts), from one pre-aggregation of the cells.

    Sums of hundredths are rounded to hundredths and scores cut to multiples of 2^-20: sums of scores are then exact, and neither ties
    nor means hang on the order in which an engine adds."""
    step = lambda v: F.floor(v * 1048576.0) / 1048576.0
    per_grade = cells(spark, sf_dir).groupBy(*KEYS, "grade").agg(
        F.sum("l_extendedprice").alias("price"), F.sum("l_tax").alias("tax"), F.sum("l_discount").alias("discount"), F.sum("l_quantity").alias("quantity"),
        F.sum(F.col("l_quantity") * F.col("l_tax")).alias("taxed"), F.count("*").alias("n"), F.count_if(F.col("l_tax") > 0).alias("n_defect"),
    )
    whole = per_grade.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("price", "tax", "discount", "n")])
    metrics = lambda *pairs: F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in pairs]))
    real = whole.select(*KEYS, metrics(
        ("image_auroc", F.round("price", 2) / F.col("n") / 100000.0), ("aupro", F.round("tax", 2) / F.col("n")), ("pixel_auroc", F.round("discount", 2) / F.col("n")),
    ).alias("m")).select(*KEYS, "m.metric", step(F.col("m.value")).alias("real"))
    by_query = per_grade.withColumn("query", F.explode(F.array(F.lit("all"), F.col("grade")))).groupBy(*KEYS, "query").agg(
        *[F.sum(c).alias(c) for c in ("quantity", "taxed", "n", "n_defect")])
    mean = F.col("quantity") / F.col("n")
    synth = by_query.select(*KEYS, "query", metrics(
        ("image_auroc", mean / 50.0), ("aupro", F.round("taxed", 2) / F.col("n")), ("pixel_auroc", F.floor(mean).cast("double")),
    ).alias("m"), F.col("n").alias("n_samples"), F.col("n_defect").alias("n_defect_samples"))
    return real, synth.select(*KEYS, "query", "m.metric", step(F.col("m.value")).alias("synth"), "n_samples", "n_defect_samples")


_PAIRED: dict[tuple[str, str], DataFrame] = {}


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table: one row per (population, config). Every analysis reads it, so a session keeps it persisted for each
    folder; its size is that of the populations, not of the scored items."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PAIRED:
        real, synth = real_and_synth(spark, sf_dir)
        out = synth.join(real, [*KEYS, "metric"], "left").withColumn("set_name", F.lit("all"))
        _PAIRED[key] = out.select("category", "set_name", "query", "metric", *TRAINING, *CONFIGS, "real", "synth", "n_samples", "n_defect_samples").persist()
    return _PAIRED[key]


def paired_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paired with missing scores and a NULL key."""
    p = paired(spark, sf_dir)
    gap = (F.col("param_model_coreset_sampling_ratio") == "7") & (F.col("metric") == "aupro")
    return p.withColumn("synth", F.when(~gap, F.col("synth"))).withColumn("param_seed", F.nullif("param_seed", F.lit("2")))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run log with duplicates, unfinished runs, NULL seeds and unpaired configs."""
    t = lambda n: table(spark, sf_dir, n)
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    status = F.when(F.col("o_orderstatus") == "F", "FINISHED").when(F.col("o_orderstatus") == "O", "FAILED").otherwise("RUNNING")
    sets = F.when(F.col("o_orderkey") % 3 == 0, "real").when(F.col("o_orderkey") % 3 == 1, "all").otherwise("alt")
    return joined.select(
        F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderdate").alias("start_time"), status.alias("status"), F.col("n_name").alias("category"),
        F.col("c_mktsegment").alias("param_model_backbone"), sets.alias("set_name"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("param_seed"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-image scores with five grades, NULL and zero areas."""
    kind = F.col("event_type")
    severity = F.when(kind == "view", "none").when(kind == "click", "minimal").when(kind == "signup", "slight").when(kind == "purchase", "moderate").otherwise("severe")
    area = F.when((kind == "view") | (F.col("event_id") % 11 == 0), None).when(F.col("event_id") % 13 == 0, 0.0).otherwise(F.col("value") / 500.0)
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).cast("string").alias("run_id"), F.col("event_id").alias("sample_id"), F.when(kind == "view", 0).otherwise(1).alias("label"),
        F.col("value").alias("score"), severity.alias("severity"),
        F.when(F.col("event_id") % 5 == 0, "no_defect").when(F.col("event_id") % 7 == 0, "over_coverage").otherwise("ok").alias("mask_status"),
        area.alias("defect_area_frac"), F.when(kind == "view", "none").when(F.col("value") > 40, "accept").otherwise("reject").alias("scorer"),
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated candidates; reward_score is NULL where unjudged."""
    d, l = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text", "n_chars"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("__id"), "quality", "toxic")
    severity = F.when(F.col("doc_id") % 4 == 0, "minimal").when(F.col("doc_id") % 4 == 1, "slight").when(F.col("doc_id") % 4 == 2, "moderate").otherwise("severe")
    reward = F.when(F.col("quality").isNotNull(), (F.col("quality") - F.col("toxic") + (F.col("doc_id") % 10) / 10.0 - 0.5).cast("double"))
    return d.join(l, F.col("doc_id") == F.col("__id"), "left").select(
        F.col("doc_id").alias("image_id"), F.col("source").alias("category"), F.col("lang").alias("class"), severity.alias("severity"), reward.alias("reward_score"),
        (F.col("doc_id") % 10).alias("attempt_index"), F.col("text").alias("prompt"), "n_chars",
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of one-row images: regions are runs of label 1 by px within (run_id, image_id)."""
    return scores(spark, sf_dir).select("run_id", F.floor(F.col("sample_id") / 100).cast("long").alias("image_id"), F.col("sample_id").alias("px"), "label", "score")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiling spans."""
    kind = F.when(F.col("event_type") == "error", "block").otherwise("span")
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("value").alias("dur_ms"), F.col("event_type").alias("name"), kind.alias("kind"), (F.col("user_id") % 4).alias("gpu"), F.col("user_id").alias("pid"))


#: The same views as common table expressions for the SQL oracle.
_KEYS = ", ".join(KEYS)
SQL = {
    "fx_cells": """SELECT r_name AS category, CAST(year(l_shipdate) % 3 AS VARCHAR) AS param_seed, l_linestatus AS param_data_num_train_samples,
  l_returnflag AS param_model_backbone, CAST(l_linenumber AS VARCHAR) AS param_model_coreset_sampling_ratio,
  CASE WHEN l_discount <= 0.025 THEN 'minimal' WHEN l_discount <= 0.055 THEN 'slight' WHEN l_discount <= 0.085 THEN 'moderate' ELSE 'severe' END AS grade,
  CAST(l_extendedprice AS DOUBLE) AS l_extendedprice, CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_tax AS DOUBLE) AS l_tax, CAST(l_discount AS DOUBLE) AS l_discount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "fx_real": " UNION ALL ".join(f"SELECT {_KEYS}, '{m}' AS metric, floor({e} * 1048576.0) / 1048576.0 AS real FROM fx_cells GROUP BY {_KEYS}" for m, e in (
        ("image_auroc", "round(sum(l_extendedprice), 2) / count(*) / 100000.0"), ("aupro", "round(sum(l_tax), 2) / count(*)"), ("pixel_auroc", "round(sum(l_discount), 2) / count(*)"))),
    "fx_synth": f"""SELECT {_KEYS}, q.query, m.metric, floor(CASE m.metric WHEN 'image_auroc' THEN sum(l_quantity) / count(*) / 50.0 WHEN 'aupro' THEN round(sum(l_quantity * l_tax), 2) / count(*) ELSE floor(sum(l_quantity) / count(*)) END * 1048576.0) / 1048576.0 AS synth,
  count(*) AS n_samples, count(CASE WHEN l_tax > 0 THEN 1 END) AS n_defect_samples FROM fx_cells JOIN (VALUES ('all'), ('minimal'), ('slight'), ('moderate'), ('severe')) q(query) ON q.query = 'all' OR q.query = grade
  CROSS JOIN (VALUES ('image_auroc'), ('aupro'), ('pixel_auroc')) m(metric) GROUP BY {_KEYS}, q.query, m.metric""",
    "fx_paired": f"""SELECT s.category, 'all' AS set_name, s.query, s.metric, s.param_seed, s.param_data_num_train_samples, s.param_model_backbone, s.param_model_coreset_sampling_ratio, r.real, s.synth, s.n_samples, s.n_defect_samples
  FROM fx_synth s LEFT JOIN fx_real r USING ({_KEYS}, metric)""",
    "fx_gaps": """SELECT * REPLACE (CASE WHEN param_model_coreset_sampling_ratio = '7' AND metric = 'aupro' THEN NULL ELSE synth END AS synth, nullif(param_seed, '2') AS param_seed) FROM fx_paired""",
    "fx_runs": """SELECT CAST(o_orderkey AS VARCHAR) AS run_id, o_orderdate AS start_time, CASE o_orderstatus WHEN 'F' THEN 'FINISHED' WHEN 'O' THEN 'FAILED' ELSE 'RUNNING' END AS status, n_name AS category,
  c_mktsegment AS param_model_backbone, CASE WHEN o_orderkey % 3 = 0 THEN 'real' WHEN o_orderkey % 3 = 1 THEN 'all' ELSE 'alt' END AS set_name, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS param_seed
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "fx_scores": """SELECT CAST(user_id % 10 AS VARCHAR) AS run_id, event_id AS sample_id, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS label, value AS score,
  CASE event_type WHEN 'view' THEN 'none' WHEN 'click' THEN 'minimal' WHEN 'signup' THEN 'slight' WHEN 'purchase' THEN 'moderate' ELSE 'severe' END AS severity,
  CASE WHEN event_id % 5 = 0 THEN 'no_defect' WHEN event_id % 7 = 0 THEN 'over_coverage' ELSE 'ok' END AS mask_status,
  CASE WHEN event_type = 'view' OR event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 0.0 ELSE value / 500.0 END AS defect_area_frac,
  CASE WHEN event_type = 'view' THEN 'none' WHEN value > 40 THEN 'accept' ELSE 'reject' END AS scorer FROM events""",
    "fx_manifest": """SELECT d.doc_id AS image_id, d.source AS category, d.lang AS class, CASE d.doc_id % 4 WHEN 0 THEN 'minimal' WHEN 1 THEN 'slight' WHEN 2 THEN 'moderate' ELSE 'severe' END AS severity,
  CASE WHEN l.quality IS NULL THEN NULL ELSE CAST(l.quality - l.toxic + (d.doc_id % 10) / 10.0 - 0.5 AS DOUBLE) END AS reward_score, d.doc_id % 10 AS attempt_index, d.text AS prompt, d.n_chars AS n_chars
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "fx_pixels": "SELECT run_id, CAST(floor(sample_id / 100) AS BIGINT) AS image_id, sample_id AS px, label, score FROM fx_scores",
    "fx_spans": "SELECT event_id, ts, value AS dur_ms, event_type AS name, CASE WHEN event_type IN ('error') THEN 'block' ELSE 'span' END AS kind, user_id % 4 AS gpu, user_id AS pid FROM events",
}
_NEEDS = {"fx_real": ["fx_cells"], "fx_synth": ["fx_cells"], "fx_paired": ["fx_real", "fx_synth"], "fx_gaps": ["fx_paired"], "fx_pixels": ["fx_scores"]}


def with_views(sql: str) -> str:
    """sql (a WITH list without the keyword, or a SELECT) with the views it names put before it."""
    found: list[str] = []

    def need(name: str) -> None:
        for n in _NEEDS.get(name, []):
            need(n)
        if name not in found:
            found.append(name)

    for name in SQL:
        if name in sql:
            need(name)
    head = ",\n".join(f"{n} AS MATERIALIZED ({SQL[n]})" for n in found)
    body = sql.strip()
    if not head:
        return ("WITH " + body) if not body.upper().startswith("SELECT") else body
    return f"WITH {head}" + (f"\n{body}" if body.upper().startswith("SELECT") else f",\n{body}")
