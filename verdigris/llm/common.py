"""Helpers shared by the training-data operators: shared-folder tables, ids, connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid
import weakref
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separator bytes of the word and line contracts: space and \t \n \v \f \r.
SPACE_CLASS = r"[\x20\x09-\x0D]+"

_SHIPPED: dict[str, str] = {}
_HELD: dict = {}
_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Only where the setting is empty and the session is local (tests on one machine) a folder of this process is used."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        where = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = where.get() if where.isDefined() else None
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="verdigris-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when this Python process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, so a lost
    executor costs a reread and not a recomputation, and only needed columns are read later."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def collect_garbage(spark: SparkSession) -> None:
    """Lets the executors' JVMs collect garbage. What earlier steps made them take, heap and buffers outside it, otherwise stays with them for good, beside what
    Python workers need. Each free core gets a task; executors that get none keep their garbage."""
    tasks = spark.range(0, cores(spark), 1, cores(spark)).select(F.expr("java_method('java.lang.System', 'gc')"))
    tasks.write.format("noop").mode("overwrite").save()


def release(*tables: DataFrame) -> None:
    """Removes materialised tables that nothing reads any more, lets the driver's cleaner drop the shuffle files of steps that are done, and executors their garbage."""
    for df in tables:
        path = _PATHS.pop(df, None)
        if path:
            remove(df.sparkSession, path)
    tables[0].sparkSession.sparkContext._jvm.System.gc()
    collect_garbage(tables[0].sparkSession)


@atexit.register
def _remove_written() -> None:
    for spark, path in _WRITTEN:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # the context may be gone already; the folder is the cluster's to clean then
            return


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> tuple[str, ...]:
    """Column names like these that no column of df has or starts with."""
    mark = "vg"
    while any(c.lower().startswith(mark) for c in df.columns):
        mark += "_"
    return tuple(f"{mark}{name}" for name in names)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers once a session, so executors needn't have it installed."""
    sc = spark.sparkContext
    if _SHIPPED.get("app") == sc.applicationId:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="verdigris-zip-"), "verdigris.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("verdigris", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _SHIPPED["app"] = sc.applicationId


def small_batches(spark: SparkSession, rows: int = 500, mb: int = 8) -> None:
    """Bounds what an Arrow batch of whole texts holds in a Python worker."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{mb}m")


def held(kind: str, model: bytes, make):
    """The model that this Python worker works with. A worker keeps one model between tasks, not one of each kind that it ever met."""
    if (kind, model) not in _HELD:
        let_go()
        _HELD[kind, model] = make(model)
    return _HELD[kind, model]


def let_go() -> None:
    """Frees the model that this worker kept from another operator's tasks."""
    if _HELD:
        _HELD.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # freed pages go back only where the C library can do that
            ctypes.CDLL(None).malloc_trim(0)


def cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected link table: (id, component), component the smallest id.

    Alternating large-star and small-star steps (Kiveris et al., 2014), each a min aggregation and a join on
    the node, so a hub's links are never gathered in one task: the aggregation combines before its
    shuffle and AQE splits the hub's side of the join. Every round is written to the shared folder; the number
    of rounds grows with the logarithm of the longest chain. Nodes without links are absent. Self links and nulls
    are ignored."""
    spark = edges.sparkSession
    cur = materialize(
        edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
        .where("u <> v").distinct(), "links",
    )
    before = None
    while True:
        if before is None and cur.isEmpty():
            return spark.createDataFrame([], "id long, component long")
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        nxt = (
            small.select(F.col("u"), F.col("m").alias("v"))
            .unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        nxt = materialize(nxt, "links")
        seen = nxt.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == seen:
            break
        before, cur = seen, nxt
    stars = nxt.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    roots = stars.select(F.col("component").alias("id"), F.col("component")).distinct()
    return stars.unionByName(roots)
