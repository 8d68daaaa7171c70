"""Detection metrics of scored sets: image AUROC and average precision, severity concordance, per (run, query).

All of them rest on ranks, never on pairs of images: scores are first counted per distinct value, so a set's cost is that of one sort."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import SEVERITIES, clean, severity_rank


@dataclass(frozen=True)
class Query:
    """A named filter. keep_good also keeps rows of label 0."""

    name: str
    expr: str | None = None
    keep_good: bool = False


def to_sql(expr: str) -> str:
    """A comparison expression in Python syntax as Spark SQL: != keeps rows without a value, == never holds for them."""
    if re.search(r"\.\s*str\b|\(\s*\)|@", expr):
        raise ValueError(f"only comparisons, and, or, not, in and parentheses are understood: {expr!r}")
    out = []
    for token in re.findall(r"'[^']*'|\"[^\"]*\"|==|!=|<=|>=|[<>()\[\],]|[^\s<>=!()\[\],'\"]+", expr):
        if token[:1] == '"':
            token = "'" + token[1:-1].replace("'", "''") + "'"
        out.append({"==": "=", "!=": "IS DISTINCT FROM", "[": "(", "]": ")", "True": "true", "False": "false", "None": "NULL", "&": "AND", "|": "OR", "~": "NOT"}.get(token, token))
    return " ".join(out)


def make_queries(config) -> list[Query]:
    """From {name: None | expression | {expr, keep_good}}."""
    found = []
    for name, entry in (config or {"all": None}).items():
        if entry is None:
            found.append(Query(name))
        elif isinstance(entry, str):
            found.append(Query(name, entry))
        elif isinstance(entry, dict):
            found.append(Query(name, entry.get("expr"), bool(entry.get("keep_good", False))))
        else:
            raise TypeError(f"query {name!r} must be null, a string or a mapping, not {type(entry).__name__}")
    return found


def _holds(expr: str | None, keep_good: bool = False) -> Column:
    if not expr:
        return F.lit(True)
    held = F.coalesce(F.expr(to_sql(expr)), F.lit(False))
    return (held | (F.col("label") == 0)) if keep_good else held


def select_rows(frame: DataFrame, expr: str | None, keep_good: bool = False) -> DataFrame:
    return frame.where(_holds(expr, keep_good))


_WORDS = {"and", "or", "not", "in", "is", "distinct", "from", "true", "false", "null"}


def resolves(frame: DataFrame, expr: str | None) -> bool:
    """Whether every name in the expression is a column of frame."""
    names = re.findall(r"[A-Za-z_]\w*", re.sub(r"'[^']*'", "", to_sql(expr))) if expr else []
    return all(n in frame.columns or n.lower() in _WORDS for n in names)


def resolvable_queries(queries: Sequence[Query], frame: DataFrame) -> list[Query]:
    """Those that name only columns of frame."""
    return [q for q in queries if resolves(frame, q.expr)]


def gate_queries(queries: Sequence[Query], gate: str | None, frame: DataFrame | None = None) -> list[Query]:
    """The gate and-ed into each query; good rows that a query keeps pass the gate too. A gate the frame can't answer is left out."""
    if not gate or (frame is not None and not resolves(frame, gate)):
        return list(queries)
    return [Query(q.name, f"( {q.expr} ) and ( {gate} )" if q.expr else gate, q.keep_good) for q in queries]


def queries_for(config: dict, set_name: str, frame: DataFrame | None = None) -> list[Query]:
    queries = make_queries((config.get("queries") or {}).get(set_name))
    if frame is not None:
        queries = resolvable_queries(queries, frame)
    return gate_queries(queries, (config.get("gate") or {}).get(set_name), frame)


def by_query(scores: DataFrame, queries: Sequence[Query]) -> DataFrame:
    """Rows once for each query that holds for them, with the query's name: all queries in one pass."""
    names = F.array(*[F.when(_holds(q.expr, q.keep_good), F.lit(q.name)) for q in queries])
    return scores.withColumn("query", F.explode(F.array_compact(names)))


def _score_counts(rows: DataFrame, by: Sequence[str], positive: Column, score: str = "score") -> DataFrame:
    rows = rows.select(*by, clean(score).alias("v"), positive.alias("pos")).where("v IS NOT NULL")
    return rows.groupBy(*by, "v").agg(F.count_if(F.col("pos")).cast("double").alias("p"), F.count_if(~F.col("pos")).cast("double").alias("q"))


def auroc(rows: DataFrame, by: Sequence[str], positive: Column | None = None, score: str = "score", name: str = "image_auroc") -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties half. NULL with one class."""
    counts = _score_counts(rows, by, F.col("label") == 1 if positive is None else positive, score)
    below = F.sum("q").over(Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("won", F.col("p") * (F.coalesce(below, F.lit(0.0)) + F.col("q") / 2))
    total = F.sum("p") * F.sum("q")
    return counts.groupBy(*by).agg(F.try_divide(F.sum("won"), total).alias(name))


def average_precision(rows: DataFrame, by: Sequence[str], positive: Column | None = None, score: str = "score", name: str = "image_aupr") -> DataFrame:
    """Precision at each distinct threshold, weighted by the recall it adds. NULL without positives."""
    counts = _score_counts(rows, by, F.col("label") == 1 if positive is None else positive, score)
    down = Window.partitionBy(*by).orderBy(F.col("v").desc()).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumns({"tp": F.sum("p").over(down), "all": F.sum(F.col("p") + F.col("q")).over(down)})
    return counts.groupBy(*by).agg(F.when(F.sum("p") > 0, F.try_divide(F.sum(F.col("p") * F.col("tp") / F.col("all")), F.sum("p"))).alias(name))


def severity_concordance(rows: DataFrame, by: Sequence[str], *, min_level_n: int = 1, exclude: Sequence[str] = ()) -> DataFrame:
    """Ordinal agreement of score and severity grade per group.

    Grades keep their place on the ladder when others are excluded or dropped as thin. For each pair of levels the wins of the higher one are
    counted from cumulative counts over distinct scores (five levels at most), so no pair of images is formed."""
    by = list(by)
    unknown = [e for e in exclude if e.strip().lower() not in SEVERITIES]
    if unknown:
        raise ValueError(f"unknown severity grades: {unknown}")
    rank = severity_rank("severity")
    for e in exclude:
        rank = F.when(F.lower(F.trim("severity")) != e.strip().lower(), rank)
    kept = rows.select(*by, rank.alias("level"), clean("score").alias("v"), "label").where("level IS NOT NULL AND v IS NOT NULL")
    sizes = kept.groupBy(*by, "level").agg(F.count("*").cast("double").alias("n")).where(F.col("n") >= min_level_n)
    levels = range(len(SEVERITIES))
    present = sizes.groupBy(*by).agg(*[F.coalesce(F.max(F.when(F.col("level") == k, F.col("n"))), F.lit(0.0)).alias(f"n{k}") for k in levels])
    grouped = kept.groupBy(*by, "v").agg(*[F.count_if(F.col("level") == k).cast("double").alias(f"c{k}") for k in levels], *[F.count_if((F.col("level") == k) & (F.col("label") != 0)).cast("double").alias(f"d{k}") for k in levels])
    cond = [grouped[k].eqNullSafe(present[k]) for k in by]
    table = grouped.join(present, cond).select(*[grouped[k] for k in by], "v", *[F.when(F.col(f"n{k}") > 0, F.col(f"c{k}")).otherwise(0.0).alias(f"c{k}") for k in levels], *[F.when(F.col(f"n{k}") > 0, F.col(f"d{k}")).otherwise(0.0).alias(f"d{k}") for k in levels], *[f"n{k}" for k in levels])
    before = Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumns({f"b{k}": F.coalesce(F.sum(f"c{k}").over(before), F.lit(0.0)) for k in levels})
    pairs = [(a, b) for a in levels for b in levels if a < b]
    total = lambda cols: sum(cols[1:], cols[0])
    table = table.withColumns({"c": total([F.col(f"c{k}") for k in levels]), "d": total([F.col(f"d{k}") for k in levels if k])})
    d_rank = F.coalesce(F.sum("d").over(before), F.lit(0.0)) + (F.col("d") + 1) / 2
    table = table.withColumn("d_rank", d_rank)
    found = table.groupBy(*by).agg(
        *[F.sum(F.col(f"c{b}") * (F.col(f"b{a}") + F.col(f"c{a}") / 2)).alias(f"w{a}{b}") for a, b in pairs], *[F.first(f"n{k}").alias(f"n{k}") for k in levels],
        F.count_if(F.col("c") > 0).alias("n_scores"), (F.sum(F.col("c") * (F.col("c") - 1)) / 2).alias("tied_scores"), F.count_if(F.col("d") > 0).alias("n_defect_scores"),
        *[F.sum(f"d{k}").alias(f"d{k}") for k in levels if k], *[F.sum(F.col(f"d{k}") * F.col("d_rank")).alias(f"r{k}") for k in levels if k],
        F.sum(F.col("d") * F.col("d_rank") * F.col("d_rank")).alias("rr"),
    )
    n = {k: F.col(f"n{k}") for k in levels}
    count = total([F.when(n[k] > 0, 1).otherwise(0) for k in levels])
    ratio = lambda use: F.try_divide(total([F.col(f"w{a}{b}") for a, b in use]), total([n[a] * n[b] for a, b in use]))
    everything, defects = pairs, [(a, b) for a, b in pairs if a > 0]
    adjacent = []
    for a, b in pairs:
        gap = total([n[k] for k in range(a + 1, b)]) == 0 if b > a + 1 else F.lit(True)
        adjacent.append(F.when((n[a] > 0) & (n[b] > 0) & gap, F.try_divide(F.col(f"w{a}{b}"), n[a] * n[b])))
    size = total([n[k] for k in levels])
    all_pairs = size * (size - 1) / 2
    tied_levels = total([n[k] * (n[k] - 1) / 2 for k in levels])
    won, compared = total([F.col(f"w{a}{b}") for a, b in pairs]), total([n[a] * n[b] for a, b in pairs])
    two = count >= 2
    # Spearman over labelled defects from rank sums per level: levels' own average ranks are constants of a group.
    dn = {k: F.col(f"d{k}") for k in levels if k}
    m = total(list(dn.values()))
    own, at = {}, F.lit(0.0)
    for k in dn:
        own[k], at = at + (dn[k] + 1) / 2, at + dn[k]
    mean = (m + 1) / 2
    cov = total([own[k] * F.col(f"r{k}") for k in dn]) - m * mean * mean
    var_l, var_s = total([dn[k] * own[k] * own[k] for k in dn]) - m * mean * mean, F.col("rr") - m * mean * mean
    defect_levels = total([F.when(n[k] > 0, 1).otherwise(0) for k in levels if k])
    spearman_ok = two & (defect_levels >= 2) & (m >= 3) & (total([F.when(dn[k] > 0, 1).otherwise(0) for k in dn]) >= 2) & (F.col("n_defect_scores") >= 2)
    out = found.select(
        *by, F.when(two, ratio(everything)).alias("severity_cindex"), F.when(two & (defect_levels >= 2), ratio(defects)).alias("severity_cindex_defects"),
        F.when(two & (F.col("n_scores") > 1), F.try_divide(2 * won - compared, F.sqrt((all_pairs - tied_levels) * (all_pairs - F.col("tied_scores"))))).alias("severity_tau_b"),
        F.when(spearman_ok, F.try_divide(cov, F.sqrt(var_l * var_s))).alias("severity_spearman"),
        F.when(two, F.aggregate(F.array_compact(F.array(*adjacent)), F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(F.array_compact(F.array(*adjacent))), F.lit(0))).alias("severity_adjacent_auc"),
        count.cast("double").alias("n_severity_levels"), F.when(two, compared).otherwise(0.0).alias("n_severity_pairs"),
    )
    return out


def level_pair_auc(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """AUROC of each pair of severity levels, higher against lower: (by, low, high, auc, pairs)."""
    ranked = rows.select(*by, severity_rank("severity").alias("level"), clean("score").alias("score")).where("level IS NOT NULL AND score IS NOT NULL")
    both = [F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")) for a in range(5) for b in range(5) if a < b]
    pairs = ranked.withColumn("pair", F.explode(F.filter(F.array(*both), lambda p: (p["low"] == F.col("level")) | (p["high"] == F.col("level")))))
    pairs = pairs.select(*by, "pair.low", "pair.high", "level", "score")
    keys = [*by, "low", "high"]
    won = auroc(pairs, keys, F.col("level") == F.col("high"), "score", "auc").where("auc IS NOT NULL")
    sizes = pairs.groupBy(*keys).agg((F.count_if(F.col("level") == F.col("low")) * F.count_if(F.col("level") == F.col("high"))).alias("pairs"))
    return won.join(sizes, keys)


def query_metrics(scores: DataFrame, queries: Sequence[Query], by: Sequence[str] = ("run_id",), *, min_level_n: int = 3, exclude: Sequence[str] = ()) -> DataFrame:
    """The full record of each (run, query) from scores alone. Single-class sets have NULL AUROC and average precision."""
    keys = [*by, "query"]
    rows = by_query(scores, queries)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n_samples"), F.count_if(F.col("label") == 0).alias("n_good_samples"), F.count_if(F.col("label") != 0).alias("n_defect_samples"))
    spark = scores.sparkSession
    frame = scores.select(*by).distinct().crossJoin(F.broadcast(spark.createDataFrame([(q.name,) for q in queries], "query string"))) if by else spark.createDataFrame([(q.name,) for q in queries], "query string")
    one_class = (F.col("n_good_samples") == 0) | (F.col("n_defect_samples") == 0)
    out = frame.join(counts, keys, "left").join(auroc(rows, keys), keys, "left").join(average_precision(rows, keys), keys, "left").join(severity_concordance(rows, keys, min_level_n=min_level_n, exclude=exclude), keys, "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_samples", "n_good_samples", "n_defect_samples")}
    out = out.withColumns(zero).withColumns({c: F.when(~one_class, F.col(c)) for c in ("image_auroc", "image_aupr")})
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("n_severity_levels", "n_severity_pairs")})


def summarize_metrics(metrics: DataFrame, *, by: Sequence[str] = ("run_id",), min_defects: int = 10, columns: Sequence[str] = ("image_auroc", "image_aupr")) -> DataFrame:
    """Run-level summary: the values of query all, how many queries are unusable (num_invalid), and how many metric
    columns hold any missing value (num_invalid_compat)."""
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    thin = F.coalesce(F.col("n_defect_samples") < min_defects, F.lit(True))
    holes = [F.max(F.col(c).isNull().cast("int")) for c in columns]
    out = metrics.groupBy(*by).agg(
        *[F.max(F.when(F.col("query") == "all", F.col(c))).alias(c) for c in columns], F.max(F.when(F.col("query") == "all", F.col("n_samples"))).alias("n_samples"),
        F.count("*").alias("n_queries"), F.count_if(missing | thin).alias("num_invalid"), sum(holes[1:], holes[0]).alias("num_invalid_compat"))
    return out.withColumn("validity", F.when(F.col("num_invalid") == 0, "valid").otherwise("invalid"))


def severity_report(frame: DataFrame, *, by: Sequence[str] = (), min_level_n: int = 1, exclude: Sequence[str] = ()) -> DataFrame:
    keys = list(by)
    if not keys:
        frame, keys = frame.withColumn("__all", F.lit(1)), ["__all"]
    counts = frame.groupBy(*keys).agg(F.count("*").alias("n"))
    out = counts.join(severity_concordance(frame, keys, min_level_n=min_level_n, exclude=exclude), keys, "left")
    return out.drop("__all")
