"""Toxicity scores from FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its distinct words, their stems (first four letters, which inflected words share), pairs of neighbouring words and pairs with one word between them (skip-grams), hashed
into 2^20 slots. Each coordinate learns at a rate of its own (McMahan et al., 2013), and L1 keeps most weights at exactly zero, so what is
broadcast is at most the number of slots (12 bytes each) and in practice some thousands.

The classifier is fitted on a bounded sample: the ``TRAIN_ROWS`` labelled rows allowed for training whose hashed id is smallest. Everything
else reads whole texts of all rows. Scoring touches rows one by one and shuffles nothing but labels.

Defined results: null and empty texts have no features and get the score of the bias alone; labels that are null are not used; an id with
several labels or several texts trains once with each pair; without labels of both kinds all scores are the share of label 1
(0.5 without any); repeated rows are scored each; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table, small_batches

TRAIN_ROWS, SLOTS, EPOCHS = 12_000, 1 << 20, 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 4.0, 0.01
THRESHOLD, STEM = 0.7, 4
#: Weight vectors and words are bounded; more distinct words than this are hashed anew.
KEPT_WORDS = 400_000
WORD = re.compile(r"[^\W\d_]+")

_HASHES: dict[str, tuple[int, int]] = {}


def word_hashes(text: str) -> np.ndarray:
    """Hashes of a text's words and, in a second row, of their stems."""
    from xxhash import xxh64_intdigest

    words = WORD.findall(text.lower())
    if len(_HASHES) > KEPT_WORDS:
        _HASHES.clear()
    for w in set(words).difference(_HASHES):
        _HASHES[w] = (xxh64_intdigest(w), xxh64_intdigest(w[:STEM], STEM))
    return np.array([_HASHES[w] for w in words], np.uint64).reshape(-1, 2).T


def features(text: str | None, slots: int = SLOTS) -> np.ndarray:
    """Distinct slots of a text's words, stems, neighbouring pairs and pairs around one word."""
    h, stems = word_hashes(text or "")
    a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    with np.errstate(over="ignore"):
        pairs, skips = (h[:-1] * a) ^ h[1:], (h[:-2] * b) ^ h[2:]
        every = np.concatenate((h, stems, pairs * a, skips * b))
    return np.unique((every >> np.uint64(44)).astype(np.int64) & (slots - 1))


def ftrl(rows: list[tuple[np.ndarray, int]], slots: int = SLOTS, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> tuple[np.ndarray, np.ndarray, float]:
    """(slots with weight, weights, bias) after passes over rows of (features, label). The bias isn't regularised."""
    z, n = np.zeros(slots + 1), np.zeros(slots + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        w[np.abs(z[at]) <= l1] = 0.0
        if len(at) and at[-1] == slots:
            w[-1] = -z[slots] / ((beta + np.sqrt(n[slots])) / alpha)
        return w

    for _ in range(epochs):
        for found, label in rows:
            at = np.append(found, slots)
            w = weights(at)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / alpha * w
    w = weights(np.arange(slots + 1))
    held = np.nonzero(w[:-1])[0]
    return held, w[held], float(w[-1])


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train, bound: int) -> DataFrame:
    """(id, label, text) of the bounded training sample. Ids are picked first, so only the sample's texts move."""
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    picked = marks.where(train(F.col("id"))).distinct().orderBy(F.xxhash64("id"), "id", "label").limit(bound)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(picked), "id")


def fit(sample: DataFrame, **options) -> tuple[np.ndarray, np.ndarray, float]:
    """Fits on (id, label, text); the sample is bounded, so one task learns from it. Weights that aren't zero come back."""
    small_batches(sample.sparkSession)

    def featured(batches):
        for batch in batches:
            ids = batch.column(0)
            found = [features(t).astype(np.int32) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["id", "label", "at"])

    def learn(batches):
        rows = [(at, y) for b in batches for at, y in zip([np.array(a, np.int32) for a in b.column(2).to_pylist()], b.column(1).to_pylist(), strict=True)]
        kinds = {y for _, y in rows}
        if len(kinds) < 2:
            share = (sum(y for _, y in rows) / len(rows)) if rows else 0.5
            share = min(max(share, 1e-6), 1 - 1e-6)
            at, w, bias = np.array([], np.int64), np.array([]), float(np.log(share / (1 - share)))
        else:
            at, w, bias = ftrl(rows, **options)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(w, bias), pa.float64())], names=["at", "weight"])

    ready = materialize(sample.select("id", "label", "text").mapInArrow(featured, "id long, label int, at array<int>"), "toxicity-sample")
    learned = ready.repartition(1).sortWithinPartitions(F.xxhash64("id", "label"), "id", "label", "at").mapInArrow(learn, "at long, weight double").collect()
    if not learned:
        return np.array([], np.int64), np.array([]), 0.0
    bias = next(r["weight"] for r in learned if r["at"] < 0)
    kept = [(r["at"], r["weight"]) for r in learned if r["at"] >= 0]
    return np.array([k for k, _ in kept], np.int64), np.array([w for _, w in kept]), bias


def toxicity_scores(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, score, predicted."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        at, w, bias = sent.value
        table = np.zeros(SLOTS, np.float32)
        table[at] = w
        for batch in batches:
            score = np.array([float(table[features(t)].sum(dtype=np.float64)) + bias for t in batch.column(1).to_pylist()], dtype=np.float64)
            score = 1.0 / (1.0 + np.exp(-np.clip(score, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["id", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, score double, predicted int")


def held_out(doc_id):
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(3)) == 1


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    sample = labelled(docs, read_table(spark, sf_dir, "labels"), "doc_id", "text", "toxic", lambda i: ~held_out(i), TRAIN_ROWS)
    out = toxicity_scores(docs, fit(sample))
    return out.select(F.col("id").alias("doc_id"), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score", "predicted")
