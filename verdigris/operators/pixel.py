"""Pixel metrics from additive histograms: AUROC, average precision and per-region overlap.

A pixel in a region of r pixels carries weight 1 / r, so region overlap is a weighted count and a query over images is a sum of their histograms."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FPR_LIMIT = 0.3


def score_edges(pixels: DataFrame, by: Sequence[str], n_bins: int, strategy: str = "quantile", accuracy: int | None = None) -> DataFrame:
    """(by, edges): interior edges, linear quantiles (or even steps) without repeats; a constant map has one edge.

    Quantiles are exact, or with an accuracy off by a rank of at most 1 / accuracy of the pixels, from sketches that combine before their shuffle."""
    steps = [i / n_bins for i in range(1, n_bins)]
    if strategy == "uniform":
        low, high = F.min("score"), F.max("score")
        edges = F.array(*[low + s * (high - low) for s in steps])
    elif strategy == "quantile":
        quantiles = F.percentile if accuracy is None else lambda c, at: F.percentile_approx(c, at, accuracy)
        edges = quantiles("score", [*steps]) if len(steps) > 1 else F.array(quantiles("score", steps[0]))
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return pixels.groupBy(*by).agg(F.array_distinct(edges).alias("edges"))


def bin_index(score: Column, edges: Column) -> Column:
    """Number of edges at or below a score, for grids of some dozens of edges."""
    return F.size(F.filter(edges, lambda e: e <= score)).cast("long")


def region_weights(pixels: DataFrame, image: Sequence[str] = ("run_id", "image_id")) -> DataFrame:
    """Regions of one-row images: runs of label 1 by px. Adds region (NULL off regions) and weight 1 / size."""
    w = Window.partitionBy(*image).orderBy("px")
    starts = F.when((F.col("label") == 1) & (F.coalesce(F.lag("label").over(w), F.lit(0)) != 1), 1).otherwise(0)
    rows = pixels.withColumn("__start", starts).withColumn("__region", F.sum("__start").over(w))
    rows = rows.withColumn("region", F.when(F.col("label") == 1, F.col("__region")))
    size = F.count("*").over(Window.partitionBy(*image, "region"))
    return rows.withColumn("weight", F.when(F.col("region").isNotNull(), 1.0 / size).otherwise(0.0)).drop("__start", "__region")


def pixel_histograms(pixels: DataFrame, edges: DataFrame, by: Sequence[str] = ("run_id",), image: Sequence[str] = ("run_id", "image_id")) -> DataFrame:
    """Sparse histograms (image, bin, positive, negative, region_weight, regions starting in the bin)."""
    rows = region_weights(pixels, image).join(edges, list(by))
    first = F.row_number().over(Window.partitionBy(*image, "region").orderBy("px")) == 1
    rows = rows.withColumn("__first", F.col("region").isNotNull() & first).withColumn("bin", bin_index(F.col("score"), F.col("edges")))
    return rows.groupBy(*image, "bin").agg(
        F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("label") != 1).alias("negative"), F.sum("weight").alias("region_weight"), F.count_if("__first").alias("n_regions"))


def pixel_metrics(histograms: DataFrame, by: Sequence[str] = ("run_id",), fpr_limit: float = FPR_LIMIT) -> DataFrame:
    """AUROC, AP, AUPRO up to fpr_limit and positive rate of the summed histograms; NULL where a class or regions are missing."""
    by = list(by)
    bins = histograms.groupBy(*by, "bin").agg(F.sum("positive").cast("double").alias("p"), F.sum("negative").cast("double").alias("q"), F.sum("region_weight").alias("w"), F.sum("n_regions").cast("double").alias("r"))
    down = Window.partitionBy(*by).orderBy(F.col("bin").desc())
    upto, whole = down.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    bins = bins.withColumns({"tp": F.sum("p").over(upto), "fp": F.sum("q").over(upto), "cw": F.sum("w").over(upto), "P": F.sum("p").over(whole), "N": F.sum("q").over(whole), "R": F.sum("r").over(whole)})
    ratio = lambda a, b: F.when(F.col(b) > 0, F.try_divide(F.col(a), F.col(b)))
    bins = bins.withColumns({"tpr": ratio("tp", "P"), "fpr": ratio("fp", "N"), "pro": ratio("cw", "R")})
    prior = lambda c: F.coalesce(F.lag(c).over(down), F.lit(0.0))
    bins = bins.withColumns({"tpr0": prior("tpr"), "fpr0": prior("fpr"), "pro0": prior("pro")})
    step = F.col("fpr") - F.col("fpr0")
    cut = F.least(F.col("fpr"), F.lit(fpr_limit)) - F.col("fpr0")
    at_cut = F.when(F.col("fpr") <= fpr_limit, F.col("pro")).otherwise(F.col("pro0") + F.try_divide(cut, step) * (F.col("pro") - F.col("pro0")))
    area = F.when((F.col("fpr0") < fpr_limit) & (step > 0), cut * (F.col("pro0") + at_cut) / 2).otherwise(0.0)
    both = (F.max("P") > 0) & (F.max("N") > 0)
    return bins.groupBy(*by).agg(
        F.when(both, F.sum(step * (F.col("tpr") + F.col("tpr0")) / 2)).alias("pixel_auroc"),
        F.when(both, F.sum((F.col("tpr") - F.col("tpr0")) * F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(1.0)))).alias("pixel_aupr"),
        F.when(both & (F.max("R") > 0), F.sum(area) / fpr_limit).alias("aupro"), (F.max("P") / F.nullif(F.max("P") + F.max("N"), F.lit(0.0))).alias("positive_pixel_rate"))


def label_regions(mask: np.ndarray) -> np.ndarray:
    """4-connected components of a 2-D mask, numbered from 1 in reading order of their first pixels.

    Runs of each row are joined with overlapping runs of the row above by union-find."""
    mask = np.asarray(mask, bool)
    h, width = mask.shape
    padded = np.zeros((h, width + 2), np.int8)
    padded[:, 1:-1] = mask
    edge = np.diff(padded, axis=1)
    row, start = np.nonzero(edge == 1)
    _, stop = np.nonzero(edge == -1)
    parent = np.arange(len(row))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(row, np.arange(h + 1))
    for y in range(1, h):
        above, here, last = first[y - 1], first[y], first[y + 1]
        while above < first[y] and here < last:
            if start[above] < stop[here] and start[here] < stop[above]:
                a, b = root(above), root(here)
                parent[max(a, b)] = min(a, b)
            if stop[above] <= stop[here]:
                above += 1
            else:
                here += 1
    roots = np.array([root(i) for i in range(len(row))], dtype=np.int64)
    number = np.unique(roots, return_inverse=True)[1] + 1 if len(roots) else roots
    out = np.zeros(mask.shape, np.int32)
    for y, a, b, k in zip(row, start, stop, number, strict=True):
        out[y, a:b] = k
    return out


def region_labels_2d(images: DataFrame, id_cols: Sequence[str], mask: str = "mask", height: str = "height", width: str = "width") -> DataFrame:
    """(ids, region, size) of flattened 2-D masks, image by image."""
    ids = list(id_cols)
    schema = ", ".join(f"`{c}` {t}" for c, t in images.select(*ids).dtypes) + ", region int, size long"

    def run(frames):
        for pdf in frames:
            rows = []
            for rec in pdf.to_dict("records"):
                labels = label_regions(np.asarray(rec[mask]).reshape(int(rec[height]), int(rec[width])) > 0)
                sizes = np.bincount(labels.ravel())[1:]
                rows += [(*[rec[c] for c in ids], k + 1, int(n)) for k, n in enumerate(sizes)]
            yield pd.DataFrame(rows, columns=[*ids, "region", "size"])

    return images.select(*ids, mask, height, width).mapInPandas(run, schema)


def image_edges(images: DataFrame, by: Sequence[str], n_bins: int, strategy: str = "quantile", accuracy: int | None = 100_000) -> DataFrame:
    """score_edges over the flattened score maps of images."""
    return score_edges(images.select(*by, F.explode("score").alias("score")), by, n_bins, strategy, accuracy)


def image_histograms(images: DataFrame, edges: DataFrame, by: Sequence[str] = ("run_id",), image: Sequence[str] = ("run_id", "image_id")) -> DataFrame:
    """Sparse histograms (image, bin, positive, negative, region_weight, n_regions) of 2-D masks and score maps (flattened, height, width).

    A region is a 4-connected part of the mask and counts in the bin of its first pixel; each of its pixels weighs 1 / its size. An image is read once and a
    pixel finds its bin by binary search, so any number of bins will do. Maps that don't fit their shape are an error."""
    ids = list(image)
    kinds = dict(images.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ids) + ", bin long, positive long, negative long, region_weight double, n_regions long"

    def run(frames):
        for pdf in frames:
            out = []
            for rec in pdf.to_dict("records"):
                mask = np.asarray(rec["mask"]).reshape(int(rec["height"]), int(rec["width"])) > 0
                score = np.asarray(rec["score"], float)
                if len(score) != mask.size:
                    raise ValueError(f"a map of {len(score)} pixels for a mask of {mask.size}")
                labels = label_regions(mask).ravel()
                sizes = np.bincount(labels)
                weight = np.where(labels > 0, 1 / np.maximum(sizes[labels], 1), 0.0)
                first = np.zeros(len(labels), bool)
                first[np.unique(labels, return_index=True)[1]] = True
                bins, at = np.unique(np.searchsorted(np.asarray(rec["edges"], float), score, side="right"), return_inverse=True)
                count = lambda w, at=at: np.bincount(at, w)
                columns = (bins, count(labels > 0), count(labels == 0), count(weight), count(first & (labels > 0)))
                out.append(pd.DataFrame({**{c: [rec[c]] * len(bins) for c in ids}, **dict(zip(("bin", "positive", "negative", "region_weight", "n_regions"), columns, strict=True))}))
            whole = pd.concat(out) if out else pd.DataFrame(columns=[*ids, "bin", "positive", "negative", "region_weight", "n_regions"])
            yield whole.astype({"bin": "int64", "positive": "int64", "negative": "int64", "n_regions": "int64"})

    rows = images.select(*dict.fromkeys([*by, *ids]), "mask", "score", "height", "width").join(edges, list(by))
    return rows.mapInPandas(run, schema)


def defect_area_fraction(mask: Column) -> Column:
    """Share of a flattened mask above half of its largest value, to six places; NULL for an empty mask, 0 for a blank one."""
    top = F.array_max(mask).cast("double")
    on = F.size(F.filter(mask, lambda x: x.cast("double") > top / 2))
    return F.round(F.when(F.size(mask) > 0, F.when(top > 0, F.try_divide(on.cast("double"), F.size(mask).cast("double"))).otherwise(0.0)), 6)
