"""Embedding near-duplicates with a pivot-permutation index.

A deterministic, bounded sample of vectors, without those near another of them, serves as pivots (reference points). Every vector is described by its ordered nearest pivots;
inverted lists hold, for each pivot, the vectors near it. Two vectors that share at least ``SHARED`` pivots are candidates, and
their cosine in double precision decides. Linked vectors lie so near each other that they see nearly the same pivots.

A list of more than ``BLOCK`` vectors is split by a second pivot: as candidates share two, they meet in the list of their two smallest shared pivots, and lists
stay short though the number of pivots is bounded. A list that is still longer (a dense group) is cut into blocks that are compared in pairs, each pair of blocks a task of its own,
so a pivot that a third of all vectors surround is neither capped nor gathered. A pair that meets in several lists counts only in the list of its
smallest shared pivots. A block pair gives each vector's number of links there and links enough to connect its groups, never all pairs.

The number of pivots grows with the number of vectors up to ``MAX_PIVOTS`` and ``PIVOT_BYTES``. Vectors of different length have no cosine: each length has pivots of its own, and one of at most
``BLOCK`` vectors is a single list, compared in full; the lengths that occur are counted on the driver. Equal vectors are compared once: copies
are counted and joined to their first. Defined results: vectors that are null, empty, zero, or hold null or non-finite parts
link with nothing and are kept; repeated rows (same id) count as vectors of their own with the same id;
an empty table gives an empty result; other columns, labels too, are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, materialize, read_table, small_batches

THRESHOLD = 0.9
NEAREST, SHARED, BLOCK = 8, 2, 512
#: Cosine above which a pivot would stand beside another and isn't taken: vectors of one dense group then share their pivots.
APART = 0.6
VECTORS_PER_PIVOT, MIN_PIVOTS, MAX_PIVOTS, PIVOT_BYTES = 32, 32, 8192, 32 << 20
#: Rows of list sizes (some 40 bytes) that may be broadcast; beyond, a shuffle join adds them.
BROADCAST_LISTS = 500_000


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spread(x: np.ndarray) -> np.ndarray:
    """The rows of x that aren't near an earlier one."""
    taken = np.empty_like(x)
    n = 0
    for row in x:
        if not n or (taken[:n] @ row).max() <= APART:
            taken[n] = row
            n += 1
    return taken[:n]


def block_links(xa, near_a, xb, near_b, pivot: int, second: int, shared: int, threshold: float, same: bool) -> np.ndarray:
    """Which pairs (of a, of b) link and have these (second: -1 for any) as their smallest shared pivots."""
    known = np.unique(np.concatenate((near_a.ravel(), near_b.ravel())))
    sees = []
    for near in (near_a, near_b):
        sees.append(np.zeros((len(near), len(known)), np.float32))
        np.put_along_axis(sees[-1], np.searchsorted(known, near), 1, axis=1)
    common = lambda columns: sees[0][:, columns] @ sees[1][:, columns].T
    found = (common(slice(None)) >= shared) & (common(known < pivot) == 0)
    if second >= 0:
        found &= common((known > pivot) & (known < second)) == 0
    if same:
        found &= np.tri(len(xa), k=-1, dtype=bool)
    if found.any():
        found &= xa @ xb.T >= threshold - 1e-9
        a, b = np.nonzero(found)
        for at in range(0, len(a), 65536):
            i, j = a[at : at + 65536], b[at : at + 65536]
            found[i, j] = np.einsum("ij,ij->i", xa[i], xb[j]) >= threshold
    return found


def tied(links: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (smallest id, id) that connect what the matrix of links (of a, of b) connects."""
    a, b = ids_a.copy(), ids_b.copy()
    most = np.iinfo(np.int64).max
    while True:
        least = np.minimum(a, np.where(links, b[None, :], most).min(axis=1, initial=most))
        both = np.minimum(b, np.where(links, least[:, None], most).min(axis=0, initial=most))
        if np.array_equal(least, a) and np.array_equal(both, b):
            break
        a, b = least, both
    top, ids = np.concatenate((a, b)), np.concatenate((ids_a, ids_b))
    return top[top != ids], ids[top != ids]


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links (smallest id, id) that connect what the pairs connect."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(r, x) for x in parent if (r := root(x)) != x]


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD,
    nearest: int = NEAREST, shared: int = SHARED, block: int = BLOCK,
) -> DataFrame:
    """One row per input row: id, n_links, component, kept."""
    spark = vectors.sparkSession
    small_batches(spark, 5000)
    kind = getattr(vectors.schema[vector_col].dataType, "elementType", None)
    part = "float" if isinstance(kind, T.FloatType) else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{part}>").alias("v"))
    sound = F.expr("size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)")
    rows = rows.withColumn("ok", F.coalesce(F.when(F.col("id").isNotNull() & F.col("v").isNotNull(), sound), F.lit(False)))
    rows = rows.withColumn("key", F.when(F.col("ok"), F.sha2(F.expr("array_join(transform(v, x -> string(x + 0.0D)), ',')"), 256)))
    rows = materialize(rows, "vectors")
    distinct = rows.where("ok").groupBy("key").agg(F.min("id").alias("id"), F.min_by("v", "id").alias("v"), F.count("*").alias("copies"))
    distinct = materialize(distinct.withColumn("dim", F.size("v")), "distinct-vectors")
    counts = {r["dim"]: r["n"] for r in distinct.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"), F.lit(True).alias("kept"))
    wanted = {dim: min(MAX_PIVOTS, max(MIN_PIVOTS, n // VECTORS_PER_PIVOT), n) for dim, n in counts.items() if n > block}
    shrink = min(1.0, PIVOT_BYTES / max(1, sum(8 * dim * n for dim, n in wanted.items())))
    wanted = {dim: max(2, int(n * shrink)) for dim, n in wanted.items()}
    points, first = {}, 0
    for dim, n in sorted(wanted.items()):
        sample = distinct.where(F.col("dim") == dim).select("key", "v").orderBy(F.xxhash64("key"), "key").limit(n).collect()
        points[dim] = (first, spread(unit(np.array([r["v"] for r in sample]))))
        first += len(points[dim][1])
    pivots = spark.sparkContext.broadcast(points)

    def describe(batches):
        """Adds the nearest pivots, or one of its own (minus the length) to vectors of a length without pivots."""
        for batch in batches:
            dims = batch.column(3).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                near = np.full((own.num_rows, 1), -dim, np.int32)
                if dim in pivots.value:
                    start, points = pivots.value[dim]
                    width = min(nearest, len(points))
                    near = np.empty((own.num_rows, width), np.int32)
                    x = unit(_matrix(own.column(1)))
                    for at in range(0, len(x), 1024):
                        score = -(x[at : at + 1024] @ points.T)
                        best = np.argpartition(score, width - 1, axis=1)[:, :width]
                        order = np.argsort(np.take_along_axis(score, best, axis=1), axis=1, kind="stable")
                        near[at : at + 1024] = start + np.take_along_axis(best, order, axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32)), pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([*own.columns[:3], lists], names=["id", "v", "copies", "near"])

    described = materialize(distinct.select("id", "v", "copies", "dim").mapInArrow(describe, f"id long, v array<{part}>, copies long, near array<int>"), "described")

    def sized(postings: DataFrame, *by: str) -> DataFrame:
        sizes = materialize(postings.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1"), "list-sizes")
        return postings.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_LISTS else sizes, list(by))

    postings = sized(described.select("id", "near", F.explode("near").alias("pivot")), "pivot")
    split = (F.col("n") > block) & (F.size("near") > 1) & F.lit(shared > 1)
    seconds = F.when(split, F.expr("filter(near, x -> x > pivot)")).otherwise(F.array(F.lit(-1)))
    postings = sized(postings.select("id", "pivot", F.explode(seconds).alias("second")), "pivot", "second")
    # A vector goes to every pair of blocks that its own block is part of; the salt depends on nothing but its id.
    postings = postings.withColumn("blocks", F.ceil(F.col("n") / F.lit(block)).cast("int")).withColumn("own", F.pmod(F.xxhash64("id", "pivot", "second"), F.col("blocks")).cast("int"))
    postings = postings.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    postings = postings.select("pivot", "second", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id")
    tasks = postings.join(described, "id")

    def compare(key, table):
        pivot, second, i, j = (k.as_py() for k in key)
        ids, copies, own = (table.column(c).to_numpy() for c in ("id", "copies", "own"))
        x, near = unit(_matrix(table.column("v"))), _matrix(table.column("near"))
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        links = block_links(x[left], near[left], x[right], near[right], pivot, second, min(shared, near.shape[1]), threshold, i == j)
        n = np.zeros(len(ids), np.int64)
        n[left] += links @ copies[right]
        n[right] += copies[left] @ links
        some = n > 0
        top, below = tied(links | links.T if i == j else links, ids[left], ids[right])
        return pa.table({
            "id": np.concatenate((ids[some], below)), "n": np.concatenate((n[some], np.zeros(len(below), np.int64))),
            "to": np.concatenate((np.full(int(some.sum()), -1, np.int64), top)), "is_link": np.concatenate((np.zeros(int(some.sum()), bool), np.ones(len(below), bool))),
        })

    found = materialize(tasks.groupBy("pivot", "second", "i", "j").applyInArrow(compare, "id long, n long, to long, is_link boolean"), "vector-links")
    grouped = components(found.where("is_link").select(F.col("id").alias("a"), F.col("to").alias("b")))
    links = found.where("NOT is_link").groupBy("id").agg(F.sum("n").alias("n"))
    firsts = distinct.select("key", "id", "copies").join(links, "id", "left").join(grouped, "id", "left")
    firsts = firsts.select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    out = rows.select("id", "key", "ok").join(firsts, "key", "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component")))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_vectors(read_table(spark, sf_dir, "embeddings"))
    return out.withColumnsRenamed({"id": "vec_id", "component": "component_id"})
