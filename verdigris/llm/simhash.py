"""SimHash near-duplicates by Golay-code fuzzy hashing.

A text's words (runs of other than ASCII white space, A-Z lower-cased) give 3-word shingles, repeats included; each is hashed
with XXH64 (seed 42), and a bit of the 64-bit fingerprint is set where more than half of the hashes set it. Fingerprints
link at 2 or fewer differing bits. Candidates come from the perfect binary Golay code [23,12,7]: the fingerprint is cut into segments
of 23, 23 and 18 bits (the last padded with zeros). Each 23-bit segment lies within 3 errors of one codeword; it gets
that codeword's 12-bit index and, at 3 errors, also the indices of the five codewords at 4 errors. Two segments that
differ in 2 or fewer bits then always share an index. Of three segments two differing bits leave at least one untouched
(pigeonhole), so a key is an untouched segment with the index of the next: three kinds of key, about 16 keys for each distinct
fingerprint, 30 or 35 bits each. Keys are joined and every candidate is verified on all 64 bits.

Copies fall together before: only distinct fingerprints get keys. A bucket of more than ``bucket`` fingerprints (a parameter) isn't joined pair by
pair: each of its fingerprints names the 65 points within one bit, and fingerprints that meet in a point are within two bits
of each other; no point holds more than 65 of them, so this exact way for full buckets is linear. Nothing is capped.

Defined results: null or blank text has fingerprint zero and links like any other; fewer than three words give
the whole sequence as one shingle; rows with a null id link like any other, and a component is its smallest id (null if no row there has an
id); repeated rows get equal results, one each; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, let_go, materialize, read_table, small_batches

#: The generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1, and its lengths.
GOLAY, LENGTH, CHECK = 0b110001110101, 23, 11
SEGMENT = (1 << LENGTH) - 1
#: Fingerprints in a bucket that are joined pair by pair; larger buckets are resolved through shared points.
BUCKET = 16
LINKED = 2


def shingle_hashes(text: bytes | None, shingle: int = 3) -> np.ndarray:
    """Hashes of the word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -shingle] + 1)).tolist()
    return np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits that more than half of the hashes set."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def text_fingerprint(text: bytes | None, shingle: int = 3) -> int:
    return fingerprint(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, text_hash, fp): fp is the fingerprint's 64 bits as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches):
        let_go()
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            found = np.array([text_fingerprint(t.as_py(), shingle) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found)], names=["id", "text_hash", "fp"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(run, "id long, text_hash long, fp long")


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit vectors modulo the generator polynomial."""
    rest = words.astype(np.int64)
    for bit in range(LENGTH - 1, CHECK - 1, -1):
        rest = np.where((rest >> bit) & 1, rest ^ (GOLAY << (bit - CHECK)), rest)
    return rest


@lru_cache(1)
def error_patterns() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the errors to the codewords that share an index with it: the nearest, and at 3 errors the five at 4."""
    near = defaultdict(list)
    for weight in range(5):
        masks = np.array([sum(1 << b for b in c) for c in combinations(range(LENGTH), weight)], dtype=np.int64)
        for s, mask in zip(syndromes(masks).tolist(), masks.tolist(), strict=True):
            if weight < 4 or bin(near[s][0]).count("1") == 3:
                near[s].append(mask)
    table, count = np.zeros((1 << CHECK, 6), np.int64), np.zeros(1 << CHECK, np.int64)
    for s, masks in near.items():
        table[s, : len(masks)], count[s] = masks, len(masks)
    return table, count


def golay_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and 12-bit codeword indices: several for each 23-bit vector."""
    table, count = error_patterns()
    s = syndromes(words)
    n = count[s]
    rows = np.repeat(np.arange(len(words)), n)
    slot = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
    return rows, (words[rows] ^ table[s[rows], slot]) >> CHECK


def fingerprint_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and keys of 64-bit fingerprints: (kind, untouched segment, index of the next segment)."""
    fps = fps.view(np.uint64)
    parts = [(fps >> np.uint64(at)).astype(np.int64) & SEGMENT for at in (0, 23, 46)]
    rows, keys = [], []
    for kind in range(3):
        r, index = golay_indices(parts[(kind + 1) % 3])
        rows.append(r)
        keys.append((np.int64(kind) << 40) | (parts[kind][r] << 12) | index)
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(batches):
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        rows, keys = fingerprint_keys(fp)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows]), batch.column(1).take(pa.array(rows))], names=["key", "fp", "rep"])


def _points(batches):
    flips = np.concatenate(([0], np.uint64(1) << np.arange(64, dtype=np.uint64))).astype(np.uint64)
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        rows = np.repeat(np.arange(len(fp)), 65)
        yield pa.RecordBatch.from_arrays([pa.array((fp[:, None] ^ flips).ravel().view(np.int64)), batch.column(1).take(pa.array(rows))], names=["point", "rep"])


def links(reps: DataFrame, bucket: int | None = None) -> DataFrame:
    """(a, b): links enough to connect all of (fp, rep), distinct fingerprints with a row that stands for each.

    bucket: fingerprints in a Golay bucket that are joined pair by pair (by default ``BUCKET``); fuller ones are resolved through shared points."""
    bucket = bucket or BUCKET
    keys = materialize(reps.select("fp", "rep").mapInArrow(_keyed, "key long, fp long, rep long"), "golay-keys")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(keys.join(sizes, "key"), "golay-shared")
    few = shared.where(F.col("n") <= bucket)
    pairs = few.alias("x").join(few.alias("y"), F.expr("x.key = y.key AND x.fp < y.fp"))
    pairs = pairs.where(F.expr(f"bit_count(x.fp ^ y.fp) <= {LINKED}")).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    full = shared.where(F.col("n") > bucket).select("fp", "rep").distinct()
    points = full.mapInArrow(_points, "point long, rep long")
    firsts = points.groupBy("point").agg(F.min("rep").alias("a"), F.collect_set("rep").alias("others")).where(F.size("others") > 1)
    met = firsts.select("a", F.explode("others").alias("b")).where("a <> b")
    return pairs.unionByName(met)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bucket: int | None = None) -> DataFrame:
    """One row per input row: id, text_hash, fp, component (the smallest id reachable over links)."""
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash")
    reps = materialize(fps.groupBy("fp").agg(F.min("id").alias("first")), "simhash-reps")
    found = components(links(reps.select("fp", F.col("fp").alias("rep")), bucket)).withColumnsRenamed({"id": "node", "component": "top"})
    tops = materialize(reps.join(found, reps["fp"] == found["node"], "left").select("fp", "first", F.coalesce("top", "fp").alias("top")), "simhash-groups")
    named = tops.join(tops.groupBy("top").agg(F.min("first").alias("component")), "top").select("fp", "component")
    return fps.join(named, "fp").select("id", "text_hash", "fp", "component")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
