"""Splits with a training pool for each seed, and the rows of overlay generation."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import path_stem
from .corpus import train_pools

#: Frames for each seed, the seeds, and the head of frames that other corpora are edited from.
TRAIN_FRAMES, SEEDS, RESERVED = 8, (42, 6800, 9999), 10
MARKER = "_POOLED_SPLIT"


@dataclass(frozen=True)
class SplitInfo:
    """What a category's split holds; spent_edits are kept edits on frames that went to a pool."""

    category: str
    n_source: int
    n_train: int
    pools: dict[int, tuple[str, ...]]
    spent_edits: int


def pool_plan(*, train_frames: int | None = None, seeds: Sequence[int] | str | None = None, sweep: Mapping | None = None) -> tuple[int, tuple[int, ...]]:
    """(frames for each seed, seeds): given ones, else the sweep's most shots and its seeds, else the defaults."""
    sweep = sweep or {}
    given = [s for s in seeds.split(",") if s.strip()] if isinstance(seeds, str) else list(seeds or ())
    shots = max((int(s) for s in sweep.get("data.num_train_samples") or ()), default=0)
    return int(train_frames or shots or TRAIN_FRAMES), tuple(int(s) for s in given or sweep.get("seed") or SEEDS)


def categories_with(files: DataFrame, folder: str, wanted: Sequence[str] | None = None) -> list[str]:
    """Categories (first part of path) that have files below category/folder/; a wanted one without is an error."""
    found = files.where(F.col("path").rlike(rf"^[^/]+/{folder}/")).select(F.split("path", "/")[0].alias("category")).distinct()
    names = sorted(r["category"] for r in found.collect())  # one for each category
    missing = sorted(set(wanted or ()) - set(names))
    if missing:
        raise ValueError(f"no {folder} for {', '.join(missing)}")
    return [n for n in names if wanted is None or n in wanted]


def write_split(frames: DataFrame, pools: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(category, frame, role, seed, kept): frames (category, frame) of a pool (category, seed, pool) train, all others are sources.

    A frame in two pools, and a pool's frame that isn't there, are errors when evaluated. counts (category, frame, kept) gives the edits that a frame carries."""
    dealt = pools.select("category", "seed", F.explode("pool").alias("frame"))
    each = dealt.groupBy("category", "frame").agg(F.collect_set("seed").alias("__seeds"))
    one = F.when(F.size("__seeds") == 1, F.col("__seeds")[0]).otherwise(F.raise_error(F.concat(F.lit("pools overlap: "), F.col("category"), F.lit("/"), F.col("frame"))).cast("int"))
    there = frames.select("category", "frame").distinct().withColumn("__there", F.lit(True))
    rows = there.join(each.withColumn("seed", one), ["category", "frame"], "full_outer")
    name = F.when(F.col("__there"), F.col("frame")).otherwise(F.raise_error(F.concat(F.lit("pool frame is missing: "), F.col("category"), F.lit("/"), F.col("frame"))))
    rows = rows.select("category", name.alias("frame"), F.when(F.col("seed").isNotNull(), "train").otherwise("source").alias("role"), "seed")
    if counts is None:
        return rows.withColumn("kept", F.lit(0).cast("long"))
    return rows.join(counts.select("category", "frame", F.col("kept").cast("long").alias("kept")), ["category", "frame"], "left").withColumn("kept", F.coalesce("kept", F.lit(0).cast("long")))


def split_summary(split: DataFrame) -> DataFrame:
    """(category, n_source, n_train, n_pools, spent_edits) of a split table."""
    trains = F.col("role") == "train"
    return split.groupBy("category").agg(F.count_if(~trains).alias("n_source"), F.count_if(trains).alias("n_train"), F.count_distinct("seed").alias("n_pools"), F.sum(F.when(trains, F.col("kept")).otherwise(0)).alias("spent_edits"))


def build_split(frames: DataFrame, *, n_frames: int = TRAIN_FRAMES, seeds: Sequence[int] = SEEDS, reserved: int = RESERVED, recorded: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """The split of each category: by its recorded pools if there are any, else by new ones. Too few frames for the pools are an error."""
    kept = counts.select("category", "frame", "kept", "total") if counts is not None else None
    own = frames.select("category", "frame").distinct()
    own = own.join(kept, ["category", "frame"], "left").fillna(0, ["kept", "total"]) if kept is not None else own.withColumns({"kept": F.lit(0), "total": F.lit(0)})
    needed = n_frames * len(set(seeds))
    short = own.groupBy("category").agg(F.greatest(F.count("*") - reserved, F.lit(0)).alias("n")).where(F.col("n") < needed)
    if recorded is not None:
        short = short.join(recorded.select("category").distinct(), "category", "left_anti")
    if lacking := [f"{r['category']} ({r['n']})" for r in short.orderBy("category").limit(10).collect()]:
        raise ValueError(f"fewer than {needed} frames after the first {reserved}: {', '.join(lacking)}")
    new = train_pools(own, seeds=list(dict.fromkeys(seeds)), n_frames=n_frames, reserved=reserved)
    pools = new if recorded is None else new.join(recorded.select("category").distinct(), "category", "left_anti").unionByName(recorded.select(*new.columns))
    return write_split(frames, pools, counts)


def split_info(split: DataFrame, category: str) -> SplitInfo:
    """One category's counts and pools (at most frames x seeds names)."""
    own = split.where(F.col("category") == category)
    r = split_summary(own).first()
    names: dict[int, list[str]] = {}
    for x in own.where("role = 'train'").select("seed", "frame").orderBy("seed", "frame").collect():
        names.setdefault(x["seed"], []).append(x["frame"])
    return SplitInfo(category, r["n_source"], r["n_train"], {k: tuple(v) for k, v in names.items()}, r["spent_edits"])


def claim_root(spark: SparkSession, path: str) -> str:
    """Marks an output folder as ours; one that holds something else without the mark is an error, not something to rebuild."""
    jvm = spark.sparkContext._jvm
    root, mark = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{MARKER}")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(mark):
        if fs.exists(root) and len(fs.listStatus(root)):
            raise ValueError(f"{path} holds something else (no {MARKER})")
        fs.mkdirs(root)
        fs.create(mark).close()
    return str(mark)


def legacy_sample(records: DataFrame, n: int, *, seed: int, order: str = "path") -> DataFrame:
    """n records without replacement, as NumPy's global generator draws places of the ordered records under a seed; 0 takes all, too few are an error."""
    from ..functions.exprs import numbered

    total = records.count()
    if n > total:
        raise ValueError(f"{n} asked for, only {total} there")
    if n <= 0:
        return records
    drawn = np.random.RandomState(seed).choice(total, size=n, replace=False)
    at = records.sparkSession.createDataFrame([(int(i),) for i in drawn], "__at long")
    return numbered(records, [order], "__at").join(F.broadcast(at), "__at").drop("__at")


# Overlays


def overlay_seed(*parts) -> int:
    """A generator's seed for one overlay: the first eight bytes, least first, of the SHA-256 of the parts with zero bytes between."""
    return int.from_bytes(hashlib.sha256("\0".join(map(str, parts)).encode()).digest()[:8], "little")


def overlay_jobs(sources: DataFrame, n_per_source: int, *, seed: int) -> DataFrame:
    """sources (category, path) x overlays, with ids and the seed of each: the rows a dry run lists."""
    stem = path_stem(F.col("path"))
    jobs = sources.withColumn("overlay_index", F.explode(F.sequence(F.lit(0), F.lit(n_per_source - 1)))).withColumn("source_image_id", stem)
    digest = F.sha2(F.concat_ws("\0", F.lit(str(seed)), "category", "source_image_id", F.col("overlay_index").cast("string")), 256)
    least_first = F.concat(*[F.substring(digest, 15 - 2 * i, 2) for i in range(8)])
    number = F.conv(least_first, 16, 10).cast("decimal(20,0)")
    return jobs.withColumns({"image_id": F.concat("source_image_id", F.lit("__overlay"), F.lpad(F.col("overlay_index").cast("string"), 2, "0")), "rng_seed": number, "seed": F.lit(seed).cast("long")})


def generate_overlays(images: DataFrame, textures: np.ndarray, n_per_source: int, *, seed: int) -> DataFrame:
    """Manifest rows and masks of overlays on images (category, path, image as bytes of height x width x channels): an overlay whose mask stays blank has status no_defect."""
    from .kernels import overlay_nonzero, per_image

    jobs = overlay_jobs(images, n_per_source, seed=seed).drop("seed")
    sent = images.sparkSession.sparkContext.broadcast(np.asarray(textures))

    def kernel(row: dict) -> dict:
        rng = np.random.default_rng(int(row["rng_seed"]))
        image = np.asarray(row["image"], np.uint8).reshape(int(row["height"]), int(row["width"]), int(row["channels"]))
        texture = sent.value[int(rng.integers(len(sent.value)))]
        rows, columns = (np.arange(n) % m for n, m in zip(image.shape[:2], texture.shape[:2], strict=True))
        got = overlay_nonzero(image, texture[rows][:, columns], rng)
        share = float(got["mask"].mean())
        return {
            "mask": got["mask"].ravel().astype(int).tolist(), "pixels": got["image"].ravel().astype(int).tolist(), "mask_status": got["mask_status"], "mask_coverage": share,
            "defect_area_frac": round(share, 6), "attempt_index": got["attempts"], "scale_x": got["scalex"], "scale_y": got["scaley"], "beta": round(got["beta"], 6),
        }

    schema = "mask array<int>, pixels array<int>, mask_status string, mask_coverage double, defect_area_frac double, attempt_index int, scale_x int, scale_y int, beta double"
    return per_image(jobs, kernel, ["category", "image_id", "source_image_id", "overlay_index"], schema)
