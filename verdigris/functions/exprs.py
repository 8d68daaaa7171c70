"""Column expressions shared by the operators. Missing values are NULL throughout; see clean()."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The severity ladder, in order.
SEVERITIES = ("none", "minimal", "slight", "moderate", "severe")


def clean(c: Column | str) -> Column:
    """NULL for NaN and both infinities."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def clean_frame(df: DataFrame) -> DataFrame:
    """Every floating-point column without NaN and infinities."""
    return df.withColumns({c: clean(c) for c, t in df.dtypes if t in ("double", "float")})


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join where NULL keys meet, with the key columns once. Without keys there is nothing to join on: an error, not every pair of rows."""
    if not on:
        raise ValueError("a join needs at least one key")
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in on})
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in on], F.lit(True))
    out = left.join(renamed, cond, how)
    if how in ("outer", "full", "full_outer", "right"):
        for k in on:
            out = out.withColumn(k, F.coalesce(F.col(k), F.col(f"__r_{k}")))
    return out.drop(*[f"__r_{k}" for k in on])


def avg_rank(value: str, by: Sequence[str], descending: bool = False) -> Column:
    """Average rank of a value among its partition; NULL for NULL. Nulls sort last, so they don't shift others."""
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return F.when(F.col(value).isNotNull(), F.rank().over(Window.partitionBy(*by).orderBy(order)) + (ties - 1) / 2.0)


def latest_per_key(df: DataFrame, keys: Sequence[str], time: str, tie: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(time).desc_nulls_last(), F.col(tie))
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def numbered(df: DataFrame, order: Sequence[Column | str], name: str, *, first: int = 0) -> DataFrame:
    """df with the place of each row in the order (a total one), without gathering rows in one partition.

    Rows are dealt by ranges of the order and numbered in their partition, after the rows of all partitions before, whose sizes (one for each partition) the
    driver adds up. The dealt rows are persisted, so that sizes and numbers come from the same ranges."""
    ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).persist()
    sizes = sorted((r["__part"], r["count"]) for r in ranged.groupBy("__part").count().collect())
    starts, at = [], first
    for part, n in sizes:
        starts += [F.lit(part), F.lit(at).cast("long")]
        at += n
    if not starts:
        return df.withColumn(name, F.lit(None).cast("long"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.withColumn(name, (F.create_map(*starts)[F.col("__part")] + place - 1).cast("long")).drop("__part")


def severity_rank(c: Column | str) -> Column:
    """0 to 4 on the ladder, NULL off it."""
    c = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    return F.coalesce(*[F.when(c == s, F.lit(i)) for i, s in enumerate(SEVERITIES)])


def severity_sort_key(c: Column | str) -> Column:
    """Pooled first, then the ladder, then other names alphabetically."""
    c = F.col(c) if isinstance(c, str) else c
    return F.struct(F.when(c == "all", -1).otherwise(F.coalesce(severity_rank(c), F.lit(99))).alias("rank"), c.alias("name"))


def passes_gate(c: Column | str) -> Column:
    """True unless the measured area is zero; unmeasured rows (NULL, NaN) pass."""
    c = F.col(c) if isinstance(c, str) else c
    return ~c.eqNullSafe(F.lit(0.0))


def config_label(configs: Sequence[str]) -> Column:
    return F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("nan"))) for c in configs])


def path_stem(c: Column) -> Column:
    name = F.element_at(F.split(c, "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def parent_name(c: Column) -> Column:
    parts = F.split(c, "/")
    return F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))


def rounded(df: DataFrame, digits: int = 10) -> DataFrame:
    """Doubles rounded, -0.0 written as 0.0: for comparing results of engines that add in other orders."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c, t in df.dtypes if t == "double"})
