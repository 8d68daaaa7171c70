"""Detection, ordinal and pixel metric queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import passes_gate, rounded
from ..operators import detection as T
from ..operators import pairing as P
from ..operators import pixel as X
from ..sources import driver_tables as D

CONFIG = {
    "queries": {"all": {"all": None, "minimal": {"expr": "severity == 'minimal'", "keep_good": True}, "accepted": {"expr": "scorer == 'accept' and score > 10", "keep_good": True}, "defects": "label != 0", "odd": "no_such_column == 1"}},
    "gate": {"all": "defect_area_frac != 0"},
}


def _queries(spark, sf_dir):
    scores = D.scores(spark, sf_dir)
    return scores, T.queries_for(CONFIG, "all", scores)


def image_auroc(spark, sf_dir):
    return rounded(T.auroc(D.scores(spark, sf_dir), ["run_id"]))


def image_aupr(spark, sf_dir):
    return rounded(T.average_precision(D.scores(spark, sf_dir), ["run_id"]))


def query_metrics(spark, sf_dir):
    scores, queries = _queries(spark, sf_dir)
    out = T.query_metrics(scores, queries)
    return rounded(out.select("run_id", "query", "n_samples", "n_good_samples", "n_defect_samples", "image_auroc", "image_aupr"))


def gated_queries(spark, sf_dir):
    scores, queries = _queries(spark, sf_dir)
    return T.by_query(scores, queries).groupBy("query", "mask_status").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 0).alias("n_good"))


def eval_gate(spark, sf_dir):
    return D.scores(spark, sf_dir).where(passes_gate("defect_area_frac")).select("sample_id", "severity", "defect_area_frac")


def _levels(out):
    return rounded(out)


def severity_cindex(spark, sf_dir):
    return rounded(T.severity_concordance(D.scores(spark, sf_dir), ["run_id"]).select("run_id", "severity_cindex", "severity_cindex_defects", "n_severity_levels", "n_severity_pairs"))


def severity_tau_b(spark, sf_dir):
    return rounded(T.severity_concordance(D.scores(spark, sf_dir), ["run_id"]).select("run_id", "severity_tau_b"))


def severity_spearman(spark, sf_dir):
    return rounded(T.severity_concordance(D.scores(spark, sf_dir), ["run_id"]).select("run_id", "severity_spearman"))


def severity_adjacent(spark, sf_dir):
    return rounded(T.severity_concordance(D.scores(spark, sf_dir), ["run_id"], exclude=["slight"]).select("run_id", "severity_adjacent_auc", "severity_cindex", "n_severity_levels"))


def level_pair_auc(spark, sf_dir):
    return rounded(T.level_pair_auc(D.scores(spark, sf_dir), ["run_id"]))


def severity_report(spark, sf_dir):
    out = T.severity_report(D.scores(spark, sf_dir), by=["run_id", "scorer"], min_level_n=3)
    return rounded(out.select("run_id", "scorer", "n", "severity_cindex", "n_severity_levels"))


def _record(spark, sf_dir):
    scores, queries = _queries(spark, sf_dir)
    return T.query_metrics(scores, queries)


def run_summary(spark, sf_dir):
    return rounded(T.summarize_metrics(_record(spark, sf_dir), min_defects=50))


def augment_metrics(spark, sf_dir):
    new = _record(spark, sf_dir).select("run_id", "query", "image_auroc", "severity_cindex")
    stored = new.where("query <> 'accepted'").select("run_id", "query", (F.col("image_auroc") + 0.25).alias("image_auroc"))
    return rounded(P.augment_metrics(stored, new.where("query <> 'defects'"), prefer_recomputed=["image_auroc"]).drop("severity_cindex"))


def check_image_auroc(spark, sf_dir):
    new = _record(spark, sf_dir).select("run_id", "query", "image_auroc")
    stored = new.select("run_id", "query", (F.col("image_auroc") + F.col("run_id").cast("int") / 100.0).alias("image_auroc"))
    return rounded(P.check_image_auroc(stored, new))


def _hist(spark, sf_dir):
    pixels = D.pixels(spark, sf_dir)
    return X.pixel_histograms(pixels, X.score_edges(pixels, ["run_id"], 16))


def pixel_hist(spark, sf_dir):
    return rounded(_hist(spark, sf_dir).drop("n_regions"))


def _pixel(name):
    def f(spark, sf_dir):
        return rounded(X.pixel_metrics(_hist(spark, sf_dir)).select("run_id", name))

    f.__name__ = name
    return f


pixel_auroc, pixel_aupr, aupro, positive_pixel_rate = (_pixel(n) for n in ("pixel_auroc", "pixel_aupr", "aupro", "positive_pixel_rate"))


def _rasters(spark, sf_dir):
    """Events as 20-pixel-wide rasters, one for each run; the last row is filled up with blank pixels."""
    rows = D.scores(spark, sf_dir).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("sample_id", "label", "score"))).alias("s"))
    rows = rows.withColumns({"height": F.ceil(F.size("s") / 20).cast("int"), "width": F.lit(20)})
    fill = lambda name, zero: F.concat(F.transform("s", lambda x: x[name]), F.array_repeat(zero, F.col("height") * 20 - F.size("s")))
    return rows.select("run_id", fill("label", F.lit(0)).alias("mask"), fill("score", F.lit(0.0)).alias("score"), "height", "width")


def region_labels_2d(spark, sf_dir):
    return X.region_labels_2d(_rasters(spark, sf_dir), ["run_id"])


def _hist_2d(spark, sf_dir):
    images = _rasters(spark, sf_dir).withColumn("image_id", F.lit(0).cast("long"))
    return X.image_histograms(images, X.image_edges(images, ["run_id"], 16, accuracy=None))


def pixel_hist_2d(spark, sf_dir):
    return rounded(_hist_2d(spark, sf_dir))


def pixel_metrics_2d(spark, sf_dir):
    return rounded(X.pixel_metrics(_hist_2d(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (
    image_auroc, image_aupr, query_metrics, gated_queries, eval_gate, severity_cindex, severity_tau_b, severity_spearman, severity_adjacent, level_pair_auc, severity_report, run_summary,
    augment_metrics, check_image_auroc, pixel_hist, pixel_auroc, pixel_aupr, aupro, positive_pixel_rate, region_labels_2d, pixel_hist_2d, pixel_metrics_2d)}


def auroc_sql(src: str, keys: str, pos: str = "label = 1") -> str:
    """SELECT of keys and auc by average ranks."""
    return f"""SELECT {keys}, (sum(ar) FILTER ({pos}) - count(*) FILTER ({pos}) * (count(*) FILTER ({pos}) + 1) / 2.0) / nullif(CAST(count(*) FILTER ({pos}) AS DOUBLE) * count(*) FILTER (NOT ({pos})), 0) AS auc
  FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY score) + (count(*) OVER (PARTITION BY {keys}, score) - 1) / 2.0 AS ar FROM {src}) GROUP BY {keys}"""


def ap_sql(src: str, keys: str) -> str:
    return f"""SELECT {keys}, sum(p * tp / alln) / nullif(sum(p), 0) AS ap FROM (SELECT *, sum(p) OVER w AS tp, sum(m) OVER w AS alln FROM (SELECT {keys}, score, CAST(count(*) FILTER (label = 1) AS DOUBLE) AS p, CAST(count(*) AS DOUBLE) AS m FROM {src} GROUP BY {keys}, score)
  WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) GROUP BY {keys}"""


GATE = "defect_area_frac IS DISTINCT FROM 0"
BYQ = f"""bq AS (SELECT *, 'all' AS query FROM fx_scores WHERE {GATE} UNION ALL SELECT *, 'minimal' FROM fx_scores WHERE (severity = 'minimal' AND {GATE}) OR label = 0
  UNION ALL SELECT *, 'accepted' FROM fx_scores WHERE (scorer = 'accept' AND score > 10 AND {GATE}) OR label = 0 UNION ALL SELECT *, 'defects' FROM fx_scores WHERE label IS DISTINCT FROM 0 AND {GATE})"""
QM = f"""{BYQ}, qc AS (SELECT run_id, query, count(*) AS n_samples, count(*) FILTER (label = 0) AS n_good_samples, count(*) FILTER (label <> 0) AS n_defect_samples FROM bq GROUP BY ALL),
qa AS ({auroc_sql('bq', 'run_id, query')}), qp AS ({ap_sql('bq', 'run_id, query')}),
qm AS (SELECT qc.*, qa.auc AS image_auroc, CASE WHEN n_good_samples > 0 AND n_defect_samples > 0 THEN qp.ap END AS image_aupr FROM qc LEFT JOIN qa USING (run_id, query) LEFT JOIN qp USING (run_id, query))"""
LV = "lv AS (SELECT run_id, scorer, label, score, list_position(['none', 'minimal', 'slight', 'moderate', 'severe'], severity) - 1 AS lev FROM fx_scores)"


def pairs_sql(keys: str, where: str = "true") -> str:
    """CTEs pa: wins and pairs of each pair of levels, by counting pairs of images."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    return f"""lk AS (SELECT * FROM lv WHERE {where}), pa AS (SELECT {', '.join('a.' + k.strip() for k in keys.split(','))}, a.lev AS low, b.lev AS high, sum(CASE WHEN b.score > a.score THEN 1.0 WHEN b.score = a.score THEN 0.5 ELSE 0.0 END) AS won, count(*) AS pairs
  FROM lk a JOIN lk b ON {on} AND a.lev < b.lev GROUP BY ALL), nl AS (SELECT {keys}, count(DISTINCT lev) AS levels, count(*) AS n FROM lk GROUP BY ALL)"""


HIST = """ed AS (SELECT run_id, list_distinct([quantile_cont(score, 1 / 16.0), quantile_cont(score, 2 / 16.0), quantile_cont(score, 3 / 16.0), quantile_cont(score, 4 / 16.0), quantile_cont(score, 5 / 16.0), quantile_cont(score, 6 / 16.0), quantile_cont(score, 7 / 16.0), quantile_cont(score, 8 / 16.0),
  quantile_cont(score, 9 / 16.0), quantile_cont(score, 10 / 16.0), quantile_cont(score, 11 / 16.0), quantile_cont(score, 12 / 16.0), quantile_cont(score, 13 / 16.0), quantile_cont(score, 14 / 16.0), quantile_cont(score, 15 / 16.0)]) AS edges FROM fx_pixels GROUP BY run_id),
st AS (SELECT *, CASE WHEN label = 1 AND coalesce(lag(label) OVER (PARTITION BY run_id, image_id ORDER BY px), 0) <> 1 THEN 1 ELSE 0 END AS s FROM fx_pixels),
rg AS (SELECT *, CASE WHEN label = 1 THEN sum(s) OVER (PARTITION BY run_id, image_id ORDER BY px) END AS region FROM st),
wt AS (SELECT *, CASE WHEN region IS NULL THEN 0.0 ELSE 1.0 / count(*) OVER (PARTITION BY run_id, image_id, region) END AS weight FROM rg),
bn AS (SELECT wt.*, len(list_filter(edges, lambda e: e <= score)) AS bin FROM wt JOIN ed USING (run_id)),
hg AS (SELECT run_id, image_id, bin, count(*) FILTER (label = 1) AS positive, count(*) FILTER (label <> 1) AS negative, sum(weight) AS region_weight, sum(s) AS n_regions FROM bn GROUP BY ALL)"""
CURVE = f"""{HIST}, hb AS (SELECT run_id, bin, CAST(sum(positive) AS DOUBLE) AS p, CAST(sum(negative) AS DOUBLE) AS q, sum(region_weight) AS w FROM hg GROUP BY ALL), ht AS (SELECT run_id, CAST(sum(positive) AS DOUBLE) AS pt, CAST(sum(negative) AS DOUBLE) AS nt, CAST(sum(n_regions) AS DOUBLE) AS rt FROM hg GROUP BY ALL),
cv AS (SELECT run_id, bin, sum(p) OVER u / nullif(pt, 0) AS tpr, sum(q) OVER u / nullif(nt, 0) AS fpr, sum(w) OVER u / nullif(rt, 0) AS pro, sum(p) OVER u AS tp, sum(p + q) OVER u AS pred FROM hb JOIN ht USING (run_id) WINDOW u AS (PARTITION BY run_id ORDER BY bin DESC ROWS UNBOUNDED PRECEDING)),
cp AS (SELECT *, coalesce(lag(tpr) OVER v, 0) AS tpr0, coalesce(lag(fpr) OVER v, 0) AS fpr0, coalesce(lag(pro) OVER v, 0) AS pro0 FROM cv WINDOW v AS (PARTITION BY run_id ORDER BY bin DESC))"""

ORACLE_SQL = {k: D.with_views(v) for k, v in {
    "image_auroc": f"au AS ({auroc_sql('fx_scores', 'run_id')}) SELECT run_id, round(auc, 10) AS image_auroc FROM au",
    "image_aupr": f"ap AS ({ap_sql('fx_scores', 'run_id')}) SELECT run_id, round(ap, 10) AS image_aupr FROM ap",
    "query_metrics": f"{QM} SELECT run_id, query, n_samples, n_good_samples, n_defect_samples, round(image_auroc, 10) AS image_auroc, round(image_aupr, 10) AS image_aupr FROM qm",
    "gated_queries": f"{BYQ} SELECT query, mask_status, count(*) AS n, count(*) FILTER (label = 0) AS n_good FROM bq GROUP BY ALL",
    "eval_gate": f"SELECT sample_id, severity, defect_area_frac FROM fx_scores WHERE {GATE}",
    "severity_cindex": f"{LV}, {pairs_sql('run_id')} SELECT run_id, round(sum(won) / sum(pairs), 10) AS severity_cindex, round(sum(won) FILTER (low > 0) / sum(pairs) FILTER (low > 0), 10) AS severity_cindex_defects, CAST(any_value(levels) AS DOUBLE) AS n_severity_levels, CAST(sum(pairs) AS DOUBLE) AS n_severity_pairs FROM pa JOIN nl USING (run_id) GROUP BY run_id",
    "severity_tau_b": f"""{LV}, {pairs_sql('run_id')}, tl AS (SELECT run_id, sum(c * (c - 1)) / 2.0 AS t FROM (SELECT run_id, lev, count(*) AS c FROM lk GROUP BY ALL) GROUP BY run_id), ts AS (SELECT run_id, sum(c * (c - 1)) / 2.0 AS t FROM (SELECT run_id, score, count(*) AS c FROM lk GROUP BY ALL) GROUP BY run_id)
      SELECT run_id, round((2 * sum(won) - sum(pairs)) / sqrt((any_value(n) * (any_value(n) - 1) / 2.0 - any_value(tl.t)) * (any_value(n) * (any_value(n) - 1) / 2.0 - any_value(ts.t))), 10) + 0.0 AS severity_tau_b FROM pa JOIN nl USING (run_id) JOIN tl USING (run_id) JOIN ts USING (run_id) GROUP BY run_id""",
    "severity_spearman": f"""{LV}, dr AS (SELECT run_id, rank() OVER (PARTITION BY run_id ORDER BY lev) + (count(*) OVER (PARTITION BY run_id, lev) - 1) / 2.0 AS a, rank() OVER (PARTITION BY run_id ORDER BY score) + (count(*) OVER (PARTITION BY run_id, score) - 1) / 2.0 AS b FROM lv WHERE lev > 0 AND label <> 0)
      SELECT run_id, round(covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)), 10) + 0.0 AS severity_spearman FROM dr GROUP BY run_id""",
    "severity_adjacent": f"""{LV}, {pairs_sql('run_id', 'lev <> 2')} SELECT run_id, round(avg(won / pairs) FILTER (high = low + 1 OR (low = 1 AND high = 3)), 10) AS severity_adjacent_auc, round(sum(won) / sum(pairs), 10) AS severity_cindex, CAST(any_value(levels) AS DOUBLE) AS n_severity_levels FROM pa JOIN nl USING (run_id) GROUP BY run_id""",
    "level_pair_auc": f"{LV}, {pairs_sql('run_id')} SELECT run_id, low, high, round(won / pairs, 10) AS auc, pairs FROM pa",
    "severity_report": f"""{LV}, th AS (SELECT run_id, scorer, lev FROM lv GROUP BY ALL HAVING count(*) >= 3), l2 AS (SELECT lv.* FROM lv JOIN th USING (run_id, scorer, lev)), pa AS (SELECT a.run_id, a.scorer, sum(CASE WHEN b.score > a.score THEN 1.0 WHEN b.score = a.score THEN 0.5 ELSE 0.0 END) / count(*) AS c FROM l2 a JOIN l2 b ON a.run_id = b.run_id AND a.scorer = b.scorer AND a.lev < b.lev GROUP BY ALL)
      SELECT t.run_id, t.scorer, t.n, round(pa.c, 10) AS severity_cindex, CAST(lc.c AS DOUBLE) AS n_severity_levels FROM (SELECT run_id, scorer, count(*) AS n FROM lv GROUP BY ALL) t LEFT JOIN pa USING (run_id, scorer) LEFT JOIN (SELECT run_id, scorer, count(*) AS c FROM th GROUP BY ALL) lc USING (run_id, scorer)""",
    "run_summary": f"""{QM} SELECT run_id, round(max(image_auroc) FILTER (query = 'all'), 10) AS image_auroc, round(max(image_aupr) FILTER (query = 'all'), 10) AS image_aupr, max(n_samples) FILTER (query = 'all') AS n_samples, count(*) AS n_queries,
      count(*) FILTER (image_auroc IS NULL OR image_aupr IS NULL OR n_defect_samples < 50) AS num_invalid, max(CASE WHEN image_auroc IS NULL THEN 1 ELSE 0 END) + max(CASE WHEN image_aupr IS NULL THEN 1 ELSE 0 END) AS num_invalid_compat,
      CASE WHEN count(*) FILTER (image_auroc IS NULL OR image_aupr IS NULL OR n_defect_samples < 50) = 0 THEN 'valid' ELSE 'invalid' END AS validity FROM qm GROUP BY run_id""",
    "augment_metrics": f"{QM} SELECT run_id, query, round(CASE WHEN query = 'defects' THEN image_auroc + 0.25 ELSE image_auroc END, 10) AS image_auroc FROM qm WHERE query <> 'accepted'",
    "check_image_auroc": f"{QM} SELECT run_id, query, round(image_auroc + CAST(run_id AS INT) / 100.0, 10) AS stored, round(image_auroc, 10) AS recomputed, round(abs(image_auroc + CAST(run_id AS INT) / 100.0 - image_auroc), 10) AS delta FROM qm",
    "pixel_hist": f"{HIST} SELECT run_id, image_id, bin, positive, negative, round(region_weight, 10) AS region_weight FROM hg",
    "pixel_auroc": f"{CURVE} SELECT run_id, round(sum((fpr - fpr0) * (tpr + tpr0) / 2), 10) AS pixel_auroc FROM cp GROUP BY run_id",
    "pixel_aupr": f"{CURVE} SELECT run_id, round(sum((tpr - tpr0) * CASE WHEN pred > 0 THEN tp / pred ELSE 1 END), 10) AS pixel_aupr FROM cp GROUP BY run_id",
    "aupro": f"""{CURVE} SELECT run_id, round(sum(CASE WHEN fpr0 < 0.3 AND fpr > fpr0 THEN (least(fpr, 0.3) - fpr0) * (pro0 + CASE WHEN fpr <= 0.3 THEN pro ELSE pro0 + (0.3 - fpr0) / (fpr - fpr0) * (pro - pro0) END) / 2 ELSE 0 END) / 0.3, 10) AS aupro FROM cp GROUP BY run_id""",
    "positive_pixel_rate": "SELECT run_id, round(avg(label), 10) AS positive_pixel_rate FROM fx_pixels GROUP BY run_id",
}.items()}

#: 2-D regions: the smallest pixel number that a lit pixel reaches over lit neighbours names its region.
RASTER = """rs AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY sample_id) - 1 AS p, label, score FROM fx_scores), sz AS (SELECT run_id, count(*) AS n, CAST(ceil(count(*) / 20.0) AS BIGINT) * 20 AS m FROM rs GROUP BY run_id),
px AS (SELECT run_id, p, label, score FROM rs UNION ALL SELECT run_id, n + i, 0, 0.0 FROM sz CROSS JOIN (SELECT unnest(range(20)) AS i) WHERE n + i < m), lt AS (SELECT run_id, p FROM px WHERE label = 1),
ad AS (SELECT a.run_id, a.p, b.p AS q FROM lt a JOIN lt b ON a.run_id = b.run_id AND (b.p = a.p + 20 OR b.p = a.p - 20 OR (b.p = a.p + 1 AND a.p % 20 <> 19) OR (b.p = a.p - 1 AND a.p % 20 <> 0))),
rc AS (SELECT run_id, p, p AS root FROM lt UNION SELECT rc.run_id, ad.q, rc.root FROM rc JOIN ad ON rc.run_id = ad.run_id AND rc.p = ad.p WHERE ad.q > rc.root),
rl AS (SELECT run_id, p, min(root) AS root FROM rc GROUP BY run_id, p), rz AS (SELECT run_id, root, count(*) AS size FROM rl GROUP BY run_id, root)"""
HIST_2D = f"""{RASTER}, ed AS (SELECT run_id, list_distinct([{', '.join(f'quantile_cont(score, {i} / 16.0)' for i in range(1, 16))}]) AS edges FROM px GROUP BY run_id),
bn AS (SELECT px.run_id, 0 AS image_id, px.p, px.label, len(list_filter(edges, lambda e: e <= px.score)) AS bin, coalesce(1.0 / rz.size, 0.0) AS weight, CASE WHEN rl.root = px.p THEN 1 ELSE 0 END AS s
  FROM px JOIN ed ON px.run_id = ed.run_id LEFT JOIN rl ON px.run_id = rl.run_id AND px.p = rl.p LEFT JOIN rz ON rl.run_id = rz.run_id AND rl.root = rz.root),
hg AS (SELECT run_id, image_id, bin, count(*) FILTER (label = 1) AS positive, count(*) FILTER (label <> 1) AS negative, sum(weight) AS region_weight, sum(s) AS n_regions FROM bn GROUP BY ALL)"""
_RECURSIVE = {
    "region_labels_2d": f"{RASTER} SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY root) AS INT) AS region, size FROM rz",
    "pixel_hist_2d": f"{HIST_2D} SELECT run_id, CAST(image_id AS BIGINT) AS image_id, bin, positive, negative, round(region_weight, 10) AS region_weight, CAST(n_regions AS BIGINT) AS n_regions FROM hg",
    "pixel_metrics_2d": f"""{HIST_2D}{CURVE[len(HIST):]} SELECT run_id, round(sum((fpr - fpr0) * (tpr + tpr0) / 2), 10) AS pixel_auroc, round(sum((tpr - tpr0) * CASE WHEN pred > 0 THEN tp / pred ELSE 1 END), 10) AS pixel_aupr,
      round(sum(CASE WHEN fpr0 < 0.3 AND fpr > fpr0 THEN (least(fpr, 0.3) - fpr0) * (pro0 + CASE WHEN fpr <= 0.3 THEN pro ELSE pro0 + (0.3 - fpr0) / (fpr - fpr0) * (pro - pro0) END) / 2 ELSE 0 END) / 0.3, 10) AS aupro,
      round(any_value(ht.pt / (ht.pt + ht.nt)), 10) AS positive_pixel_rate FROM cp JOIN ht USING (run_id) GROUP BY run_id""",
}
ORACLE_SQL |= {k: D.with_views(v).replace("WITH ", "WITH RECURSIVE ", 1) for k, v in _RECURSIVE.items()}
