"""Array kernel and streaming queries, with SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import rounded
from ..operators import kernels as I
from ..sources import driver_tables as D
from ..streaming import spans as ST


def noise_level(spark, sf_dir):
    return rounded(I.noise_levels(D.scores(spark, sf_dir), ["run_id"]), 6)


def span_stream(spark, sf_dir):
    return rounded(ST.span_stream(spark, D.spans(spark, sf_dir)), 6)


def _frames(spark, sf_dir):
    return D.table(spark, sf_dir, "part").select("p_partkey", (100 + F.col("p_partkey") % 400).cast("int").alias("width"), (100 + F.col("p_partkey") % 173).cast("int").alias("height"))


def crop_grid(spark, sf_dir):
    return I.grid_boxes(_frames(spark, sf_dir), 96, 0.25).select("p_partkey", "x0", "y0", "x1", "y1")


def crop_centers(spark, sf_dir):
    rows = _frames(spark, sf_dir).withColumns({"cx": (F.col("p_partkey") * 7 % 500).cast("int"), "cy": (F.col("p_partkey") * 11 % 300).cast("int")})
    return I.boxes_from_centers(rows, 128).select("p_partkey", "x0", "y0", "x1", "y1")


def mask_iou(spark, sf_dir):
    rows = D.scores(spark, sf_dir).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("sample_id", "label", (F.col("score") > 20).cast("int").alias("hit")))).alias("s"))
    return rounded(rows.select("run_id", I.binary_iou(F.transform("s", lambda x: x["label"]), F.transform("s", lambda x: x["hit"])).alias("iou")))


QUERIES = {f.__name__: f for f in (noise_level, span_stream, crop_grid, crop_centers, mask_iou)}

_STEP = """m{i} AS (SELECT run_id, median(score) AS med, count(*) AS n FROM fx_scores JOIN s{p} USING (run_id) WHERE score <= s{p}.med + 3.0 * s{p}.sigma GROUP BY run_id),
d{i} AS (SELECT run_id, 1.4826 * median(m{i}.med - score) AS sigma FROM fx_scores JOIN s{p} USING (run_id) JOIN m{i} USING (run_id) WHERE score <= s{p}.med + 3.0 * s{p}.sigma AND score <= m{i}.med GROUP BY run_id),
s{i} AS (SELECT run_id, s{p}.total, CASE WHEN s{p}.sigma > 0 AND m{i}.n >= greatest(1, floor(0.15 * s{p}.total)) AND d{i}.sigma > 0 THEN m{i}.med ELSE s{p}.med END AS med,
  CASE WHEN s{p}.sigma > 0 AND m{i}.n >= greatest(1, floor(0.15 * s{p}.total)) AND d{i}.sigma > 0 THEN d{i}.sigma ELSE s{p}.sigma END AS sigma FROM s{p} LEFT JOIN m{i} USING (run_id) LEFT JOIN d{i} USING (run_id))"""
_NOISE = "q0 AS (SELECT run_id, quantile_cont(score, 0.2) AS med, count(*) AS total FROM fx_scores GROUP BY run_id), s0 AS (SELECT run_id, any_value(total) AS total, any_value(med) AS med, 1.4826 * median(med - score) AS sigma FROM fx_scores JOIN q0 USING (run_id) WHERE score <= med GROUP BY run_id), "


def _axis(n: str) -> str:
    return f"CASE WHEN {n} - s <= 0 THEN [0] WHEN {n} - s <= greatest(1, round_even(s * 0.05, 0)) THEN [({n} - s) // 2] ELSE list_transform(range(0, CAST(ceil(({n} - s) / greatest(1, t)) AS BIGINT) + 1), lambda i: CAST(round_even(i * ({n} - s) / ceil(({n} - s) / greatest(1, t)), 0) AS INT)) END"


_PARTS = "pf AS (SELECT p_partkey, CAST(100 + p_partkey % 400 AS INT) AS width, CAST(100 + p_partkey % 173 AS INT) AS height FROM part)"
ORACLE_SQL = {k: D.with_views(v) for k, v in {
    "noise_level": _NOISE + ", ".join(_STEP.format(i=i, p=i - 1) for i in range(1, 6)) + " SELECT run_id, round(med, 6) + 0.0 AS level, round(sigma, 6) AS scale FROM s5",
    "span_stream": "SELECT time_bucket(INTERVAL '1 hour', CAST(ts AS TIMESTAMP)) AS window_start, name, count(*) AS n, round(sum(dur_ms), 6) AS total_ms FROM fx_spans GROUP BY ALL",
    "crop_grid": f"""{_PARTS}, ps AS (SELECT *, least(96, width, height) AS s, greatest(1, CAST(round_even(least(96, width, height) * 0.75, 0) AS INT)) AS t FROM pf), py AS (SELECT *, CAST(unnest({_axis('height')}) AS INT) AS y0 FROM ps), px AS (SELECT *, CAST(unnest({_axis('width')}) AS INT) AS x0 FROM py)
      SELECT p_partkey, x0, y0, CAST(x0 + s AS INT) AS x1, CAST(y0 + s AS INT) AS y1 FROM px""",
    "crop_centers": f"""{_PARTS}, pc AS (SELECT *, CAST(p_partkey * 7 % 500 AS INT) AS cx, CAST(p_partkey * 11 % 300 AS INT) AS cy FROM pf), pb AS (SELECT *, CAST(CASE WHEN width <= 128 THEN 0 ELSE least(greatest(0, cx - 64), width - 128) END AS INT) AS x0, CAST(CASE WHEN height <= 128 THEN 0 ELSE least(greatest(0, cy - 64), height - 128) END AS INT) AS y0 FROM pc)
      SELECT p_partkey, x0, y0, CAST(CASE WHEN width <= 128 THEN width ELSE x0 + 128 END AS INT) AS x1, CAST(CASE WHEN height <= 128 THEN height ELSE y0 + 128 END AS INT) AS y1 FROM pb""",
    "mask_iou": "SELECT run_id, round(count(*) FILTER (label > 0 AND score > 20) / nullif(CAST(count(*) FILTER (label > 0 OR score > 20) AS DOUBLE), 0), 10) AS iou FROM fx_scores GROUP BY run_id",
}.items()}
