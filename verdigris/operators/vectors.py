"""Vector operators: nearest neighbours in a memory bank, greedy coreset, token feature distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of vectors that one task or broadcast holds.
BANK_BYTES = 64 << 20


def _nearest(q: np.ndarray, x: np.ndarray, k: int, batch: int) -> np.ndarray:
    """Distances of the rows of q to their k nearest rows of x, in order; fewer where x has fewer."""
    norm, out = (x * x).sum(axis=1), []
    for at in range(0, len(q), batch):
        rows = q[at : at + batch]
        near = np.argpartition(norm - 2 * rows @ x.T, min(k, len(x)) - 1, axis=1)[:, :k]
        out.append(np.sort(np.sqrt(((x[near] - rows[:, None]) ** 2).sum(axis=2)), axis=1))
    return np.concatenate(out)


def knn_score(queries: DataFrame, bank: DataFrame, *, k: int = 3, id_col: str = "vec_id", vector: str = "embedding", batch: int = 1024) -> DataFrame:
    """(id, score): mean Euclidean distance to the k nearest bank vectors, NULL without any.

    A bank of at most BANK_BYTES is sent to every worker. A larger one never reaches the driver: bank and queries are cut into blocks of that size, each pair of
    blocks is a task, and of what the blocks find for a query the k best are kept."""
    spark = queries.sparkSession
    own = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    points = bank.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    size = lambda df: (df.agg(F.sum(8 * F.size("v"))).first()[0] or 0)
    total = size(points)
    if not total:
        return own.select("id", F.lit(None).cast("double").alias("score"))
    if total <= BANK_BYTES:
        sent = spark.sparkContext.broadcast(np.array([r["v"] for r in points.select("v").collect()], dtype=np.float64))

        def run(batches):
            for b in filter(len, batches):
                near = _nearest(np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(np.float64), sent.value, k, batch)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(near), pa.list_(pa.float64()))], names=["id", "near"])

        found = own.mapInArrow(run, "id long, near array<double>")
    else:
        blocks, parts = -(-total // BANK_BYTES), -(-size(own) // BANK_BYTES) or 1
        dealt = lambda df, mine, n, other, m: df.withColumn(mine, F.pmod(F.xxhash64("id", "v"), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))

        def meet(left, right):
            if not len(left) or not len(right):
                return pd.DataFrame({"id": np.zeros(0, np.int64), "near": pd.Series([], dtype=object)})
            near = _nearest(np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy()), k, batch)
            return pd.DataFrame({"id": left["id"], "near": list(near)})

        keys = ["part", "block"]
        met = dealt(own, "part", parts, "block", blocks).groupBy(*keys).cogroup(dealt(points, "block", blocks, "part", parts).groupBy(*keys))
        found = met.applyInPandas(meet, "id long, near array<double>")
        found = found.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))  # at most k of each block
    return found.select("id", (F.aggregate("near", F.lit(0.0), lambda a, x: a + x) / F.size("near")).alias("score"))


def greedy_coreset(vectors: DataFrame, ratio: float, *, by: str, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Greedy k-centres of each group: start at the vector nearest the mean, then always the farthest from those taken. A group is one
    detector's training patches."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col)
        x = np.stack(pdf[vector].to_numpy()).astype(np.float64)
        n = max(1, int(len(x) * ratio))
        taken = [int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())]
        gap = ((x - x[taken[0]]) ** 2).sum(axis=1)
        while len(taken) < n:
            taken.append(int(gap.argmax()))
            gap = np.minimum(gap, ((x - x[taken[-1]]) ** 2).sum(axis=1))
        return pd.DataFrame({by: pdf[by].iloc[0], id_col: pdf[id_col].to_numpy()[taken], "place": range(n)})

    kind = dict(vectors.dtypes)
    return vectors.select(by, id_col, vector).groupBy(by).applyInPandas(one, f"`{by}` {kind[by]}, `{id_col}` {kind[id_col]}, place int")


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a) * dot(b, b))
    return 1 - F.coalesce(F.try_divide(dot(a, b), size), F.lit(0.0))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double"))), F.lit(0.0), lambda s, v: s + v))


def feature_distance(pairs: DataFrame, clean: str, edit: str, *, group: str, cosine_weight: float = 1.0, l2_weight: float = 0.0) -> DataFrame:
    """Distance of edited tokens from clean ones after the group's median shift is taken off, dimension by dimension."""
    shift = pairs.select(group, F.posexplode(F.zip_with(edit, clean, lambda e, c: e.cast("double") - c.cast("double"))).alias("dim", "d")).groupBy(group, "dim").agg(F.median("d").alias("m"))
    shift = shift.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda x: x["m"]).alias("shift"))
    out = pairs.join(shift, group).withColumn("__e", F.zip_with(F.col(edit), F.col("shift"), lambda e, s: e.cast("double") - s))
    return out.withColumn("distance", cosine_weight * cosine_distance(F.col(clean), F.col("__e")) + l2_weight * l2_distance(F.col(clean), F.col("__e"))).drop("__e", "shift")


def combine_maps(maps: list[Column], weights: list[float] | None = None) -> Column:
    """Weighted mean of flattened maps."""
    weights = weights or [1.0] * len(maps)
    total = F.transform(maps[0], lambda x: x * weights[0])
    for m, w in zip(maps[1:], weights[1:], strict=True):
        total = F.zip_with(total, m, lambda a, b, w=w: a + b * w)
    return F.transform(total, lambda x: x / sum(weights))


def embed_dimension(base: Column, factor: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(base * factor)).cast("int")


def score_margin(edits: DataFrame, noops: DataFrame, *, accept_margin: float = 0.0) -> DataFrame:
    """Margin of an edit's score over the unedited crop's, once per (crop, prompt)."""
    base = noops.groupBy("crop", "prompt").agg(F.max("score").alias("noop_score"))
    out = edits.join(base, ["crop", "prompt"], "left").withColumn("margin", F.col("score") - F.col("noop_score"))
    return out.withColumn("decision", F.when(F.col("margin") >= accept_margin, "accept").when(F.col("margin") < accept_margin, "reject"))
