"""How far the synthetic and the real arm move together, and how far apart they lie."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats
from ..functions.exprs import SEVERITIES, clean, null_safe_join, severity_sort_key

DEFAULT_BY = ("metric", "set_name", "query", "category")
#: Statistics of the synthetic arm alone, which have no real counterpart.
PROXY_ONLY = ("severity_cindex", "severity_cindex_defects", "severity_tau_b", "severity_spearman", "severity_adjacent_auc")


def _both(paired: DataFrame, by: Sequence[str], min_defect_samples: int | None) -> DataFrame:
    rows = paired if min_defect_samples is None else paired.where(F.col("n_defect_samples") >= min_defect_samples)
    rows = rows.select(*by, clean("real").alias("r"), clean("synth").alias("s"))
    return rows.where("r IS NOT NULL AND s IS NOT NULL")


def _pearson(x: str, y: str) -> Column:
    """From centred values; NULL where one side is constant. (corr() raises there.)"""
    return F.when((F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def inversions(x: np.ndarray) -> int:
    """Pairs of places whose values fall, by comparing one bit of the values' ranks at a time among those that agree in all higher bits."""
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
    total = 0
    for bit in range(int(rank.max(initial=0)).bit_length() - 1, -1, -1):
        rank = rank[np.argsort(rank >> (bit + 1), kind="stable")]
        group, one = rank >> (bit + 1), (rank >> bit) & 1
        ones = np.cumsum(one)
        start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        before = np.repeat(ones[start] - one[start], np.diff(np.append(start, len(rank))))
        total += int((ones - before)[one == 0].sum())
    return total


def discordant(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, crossed): pairs of (r, s) whose arms are in opposite order, ties not counted."""
    kinds = dict(rows.dtypes)

    def count(pdf):
        order = np.lexsort((pdf["s"].to_numpy(), pdf["r"].to_numpy()))
        return pdf[list(by)].head(1).assign(crossed=float(inversions(pdf["s"].to_numpy()[order])))

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "crossed double"])
    return rows.select(*by, "r", "s").groupBy(*by).applyInPandas(count, schema)


def correlate(paired: DataFrame, by: Sequence[str] = DEFAULT_BY, *, alpha: float = 0.05, min_n: int = 4, min_defect_samples: int | None = None, p_values: bool = True) -> DataFrame:
    """Pearson (with p, r2 and a Fisher interval), Spearman, Kendall's tau-b and spreads per population.

    Spearman is Pearson of average ranks. tau-b's discordant pairs are the inversions of one arm in order of the other, counted in n log n
    over a population's two columns; ties come from counts of equal values. No pair of rows is formed."""
    by = list(by)
    rows = _both(paired, by, min_defect_samples)
    pop = Window.partitionBy(*by)
    ranks = lambda c: F.rank().over(pop.orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2.0
    crossed = discordant(rows, by)
    tie = lambda *c: F.count("*").over(Window.partitionBy(*by, *c))
    rows = rows.withColumns({"rr": ranks("r"), "sr": ranks("s"), "tr": tie("r"), "ts": tie("s"), "tb": tie("r", "s")})
    found = rows.groupBy(*by).agg(
        F.count("*").alias("n"), _pearson("r", "s").alias("pearson_r"), _pearson("rr", "sr").alias("spearman_rho"), (F.sum(F.col("tb") - 1) / 2).alias("bt"),
        (F.sum(F.col("tr") - 1) / 2).alias("xt"), (F.sum(F.col("ts") - 1) / 2).alias("yt"),
        F.sum((F.col("tr") - 1) * (2 * F.col("tr") + 5)).alias("x3"), F.sum((F.col("ts") - 1) * (2 * F.col("ts") + 5)).alias("y3"),
        F.sum((F.col("tr") - 1) * (F.col("tr") - 2)).alias("x2"), F.sum((F.col("ts") - 1) * (F.col("ts") - 2)).alias("y2"),
        *[f(c).alias(f"{name}_{a}") for c, name in (("r", "real"), ("s", "synth")) for f, a in ((F.min, "min"), (F.max, "max"), (F.stddev_samp, "sd"))],
    )
    found = null_safe_join(found, crossed, by) if by else found.crossJoin(crossed)  # one row each without keys
    n = F.col("n").cast("double")
    pairs = n * (n - 1) / 2
    found = found.withColumn("agree", pairs - F.col("xt") - F.col("yt") + F.col("bt") - 2 * F.col("crossed"))
    capped = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(c))))
    found = found.withColumns({c: capped(c) for c in ("pearson_r", "spearman_rho")})
    degenerate = (F.col("n") < min_n) | F.col("pearson_r").isNull()
    r = F.col("pearson_r")
    half = F.try_divide(F.lit(stats.normal_quantile(1 - alpha / 2)), F.sqrt(F.greatest(n - 3, F.lit(0.0))))
    inside = (F.col("n") > 3) & (F.abs(r) < 1)
    fields = {
        "pearson_r": r, "pearson_r2": r * r, "pearson_ci_lo": F.when(inside, F.tanh(F.atanh(r) - half)), "pearson_ci_hi": F.when(inside, F.tanh(F.atanh(r) + half)),
        "spearman_rho": F.col("spearman_rho"), "kendall_tau": F.try_divide(F.col("agree"), F.sqrt((pairs - F.col("xt")) * (pairs - F.col("yt")))),
    }
    if p_values:
        t = lambda c: F.when(F.abs(c) < 1, c * F.sqrt(F.try_divide(n - 2, 1 - c * c)))
        p = lambda c: F.when(F.abs(c) >= 1, 0.0).otherwise(stats.t_p_value(t(c), n - 2))
        fields |= {"pearson_p": p(r), "spearman_p": p(F.col("spearman_rho")), "kendall_p": stats.kendall_p_value(F.col("agree"), n, pairs, *[F.col(c).cast("double") for c in ("xt", "yt", "x3", "y3", "x2", "y2")])}
    out = found.withColumns({k: F.when(~degenerate, v) for k, v in fields.items()})
    shown = F.col("n") >= 1
    ranges = {f"{a}_range": F.when(shown, F.col(f"{a}_max") - F.col(f"{a}_min")) for a in ("real", "synth")}
    out = out.withColumns(ranges)
    return out.select(*by, "n", *fields, *[f"{a}_{b}" for a in ("real", "synth") for b in ("min", "max", "range", "sd")])


def split_query(c: Column | str) -> tuple[Column, Column]:
    """(severity, scorer) that a query's name says: tokens of one grade at most and one verdict; else the whole name and 'all'."""
    c = F.col(c) if isinstance(c, str) else c
    tokens = F.split(F.lower(F.trim(c)), "_")
    grades = F.filter(tokens, lambda x: x.isin(*SEVERITIES))
    verdicts = F.filter(tokens, lambda x: x.isin("accept", "reject"))
    known = F.size(grades) + F.size(verdicts) + F.size(F.filter(tokens, lambda x: x == "all"))
    fine = (known == F.size(tokens)) & (F.size(grades) <= 1) & (F.size(verdicts) <= 1)
    severity = F.when(~fine, c).otherwise(F.coalesce(F.try_element_at(grades, F.lit(1)), F.lit("all")))
    return severity, F.when(~fine, F.lit("all")).otherwise(F.coalesce(F.try_element_at(verdicts, F.lit(1)), F.lit("all")))


def with_severity(paired: DataFrame, *, query_column: str = "query") -> DataFrame:
    severity, scorer = split_query(query_column)
    return paired.withColumns({k: v for k, v in (("severity", severity), ("scorer", scorer)) if k not in paired.columns})


def bias_keys(by: Sequence[str]) -> list[str]:
    out: list[str] = []
    for k in by:
        out += [x for x in (("severity", "scorer") if k == "query" else (k,)) if x not in out]
    return out


def evaluate_bias(
    paired: DataFrame, by: Sequence[str] = DEFAULT_BY, *, alpha: float = 0.05, min_n: int = 3, min_defect_samples: int | None = None, drop_proxy_only: bool = True, intervals: bool = True,
) -> DataFrame:
    """Synthetic minus real per population: level, spread, t interval, and whether the synthetic arm overestimates (three-valued)."""
    by = bias_keys(by)
    rows = with_severity(paired)
    if drop_proxy_only and "metric" in rows.columns:
        rows = rows.where(~F.col("metric").isin(*PROXY_ONLY))
    total = rows if min_defect_samples is None else rows.where(F.col("n_defect_samples") >= min_defect_samples)
    total = total.select(*by, clean("real").alias("r"), clean("synth").alias("s")).withColumn("d", F.col("s") - F.col("r"))
    found = total.groupBy(*by).agg(
        F.count("d").alias("n"), F.count_if(F.col("d").isNull()).alias("n_dropped"), F.avg(F.when(F.col("d").isNotNull(), F.col("r"))).alias("real_mean"), F.avg(F.when(F.col("d").isNotNull(), F.col("s"))).alias("synth_mean"),
        F.avg("d").alias("bias"), F.median("d").alias("bias_median"), F.avg(F.abs("d")).alias("bias_abs"), F.stddev_samp("d").alias("sd"), F.max(F.abs("d")).alias("most"),
        F.avg((F.col("d") > 0).cast("double")).alias("share_over"), F.min("d").alias("bias_min"), F.max("d").alias("bias_max"),
    )
    n = F.col("n").cast("double")
    sd = F.when(F.col("sd") <= 1e-9 * F.greatest("most", F.lit(1.0)), 0.0).otherwise(F.col("sd"))
    enough = F.col("n") >= max(min_n, 2)
    found = found.withColumn("bias_sd", F.when(enough, sd)).drop("sd", "most").withColumn("bias_se", F.try_divide(F.col("bias_sd"), F.sqrt(n)))
    if intervals:
        half = stats.t_critical(1 - alpha / 2, F.when(enough, n - 1)) * F.col("bias_se")
        t = F.when(F.col("bias_sd") > 0, F.try_divide(F.col("bias"), F.col("bias_se")))
        found = found.withColumn("__half", half).withColumns({"bias_ci_lo": F.col("bias") - F.col("__half"), "bias_ci_hi": F.col("bias") + F.col("__half"), "bias_t": t})
        found = found.withColumns({"bias_p": stats.t_p_value(F.col("bias_t"), n - 1), "overestimates": F.when(F.col("bias_ci_lo") > 0, True).when(F.col("bias_ci_hi") < 0, False)}).drop("__half")
    return found


def worst_cells(bias: DataFrame, *, n: int = 10) -> DataFrame:
    """Decided populations of largest bias."""
    return bias.where("overestimates IS NOT NULL").orderBy(F.abs("bias").desc(), *[c for c in bias_keys(DEFAULT_BY) if c in bias.columns]).limit(n)


def severity_order(values: DataFrame, column: str = "severity") -> DataFrame:
    return values.select(column).distinct().orderBy(severity_sort_key(column))
