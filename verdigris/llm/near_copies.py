"""Near copies by word shingles: all pairs of Jaccard similarity at or above a threshold, by SimHash and, for what its fingerprints miss, prefix filtering.

SimHash by Golay-code fuzzy hashing (simhash.py, here over 5-word shingles) comes first: fingerprints within 2 bits name pairs, and those that hold on whole sets link.
Pairs at the similarity may differ in more bits than Golay keys reach, so a second step looks for links between the groups that these pairs form, and only there.

A text's words (as in simhash.py) give the set of hashes (XXH64, seed 42) of its 5-word shingles; texts link where the Jaccard similarity of their sets is 0.8
or more. Sets of n shingles that link share at least one of their first n - ceil(0.8 n) + 1 shingles in any order common to all (the prefix
filter), so no linked pair is missed. The order puts shingles that are frequent in a sample last, which only keeps lists short: the result doesn't depend on it.

Texts of equal sets count as one. Each set has a bitmap of one to two bits a shingle, a bit for the parity of the shingles in its slot; bits that differ between two bitmaps
are at most as many as the shingles that only one of the sets has, which bounds what they share. Lists whose sets are all in one group are done. Of the others those of at most ``LIST`` sets are joined pair by pair, and pairs of two groups whose sizes and
bitmaps allow it are verified on whole sets. Longer lists are cut into blocks of at most about ``SETS`` sets, and pairs of blocks compare bitmaps first; only sets with a possible partner in the list
are compared whole, again in pairs of blocks of about ``BLOCK`` shingles, tasks that count common shingles by matrix products
and give links enough to connect their groups, never all pairs. So sets travel only for pairs that are (nearly) similar. Nothing is capped; the comparisons of a long list grow with the square of its length.

Defined results: null and blank texts have the empty set and are one group; fewer than five words give the whole sequence as one shingle; a component is its
smallest id (null if no row there has an id), and rows without an id link like any other; an empty table gives an empty result."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import components, let_go, materialize, release, small_batches
from .embeddings import forest

SHINGLE, SIMILARITY = 5, 0.8
LIST, BLOCK, SETS, COLUMNS = 64, 1 << 20, 2048, 2048
#: Keys (about) that meet in one task; the least bits of a bitmap.
PART, BITS = 1_000_000, 64
#: Documents (about) whose shingles are counted for the order, and in how many of them a shingle counts as frequent.
SAMPLE, FREQUENT = 8_000, 3
#: Texts whose keys may be broadcast; beyond, a shuffle join picks them.
BROADCAST_TEXTS = 1_000_000


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    return np.unique(simhash.shingle_hashes(text, shingle).view(np.int64))


def node_of(own: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(own.tobytes(), 7)).astype(np.int64))


def prefix(own: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles, one of which every set that links must share; common: frequent hashes (sorted) with counts."""
    if not len(own):
        return own
    weight = np.zeros(len(own), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        weight = np.where(common[at] == own, counts[at], 0)
    return own[np.lexsort((own, weight))[: len(own) - math.ceil(similarity * len(own) - 1e-9) + 1]]


def bitmap(own: np.ndarray) -> bytes:
    """Parities of the shingles by slot, about one to two bits a shingle."""
    width = max(BITS, 1 << (len(own) - 1).bit_length())
    odd = np.bincount(own & (width - 1), minlength=width) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def folded(bits: list[bytes], width: int) -> np.ndarray:
    """Bitmaps of one length as rows of width bytes: halves of wider ones fall together, as their slots do."""
    out = np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1)
    while out.shape[1] > width:
        out = out[:, : out.shape[1] // 2] ^ out[:, out.shape[1] // 2 :]
    return out


ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def may_link(differ: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of a and b shingles whose bitmaps differ in so many bits can reach the similarity."""
    most = (a + b - differ) / 2
    return (most >= similarity * (a + b - most) - 1e-6) & (np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-6)


def classes(bits_a: np.ndarray, bits_b: np.ndarray):
    """(rows of a, rows of b, bytes) for each two lengths of bitmaps whose sets can be similar: a length is at most twice the other."""
    wide_a, wide_b = (np.array([len(x) for x in bits]) for bits in (bits_a, bits_b))
    for x in np.unique(wide_a).tolist():
        for y in np.unique(wide_b).tolist():
            if x <= 2 * y and y <= 2 * x:
                yield np.flatnonzero(wide_a == x), np.flatnonzero(wide_b == y), min(x, y)


def possible(sizes: np.ndarray, bits: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float, tops: np.ndarray | None = None) -> np.ndarray:
    """Which sets (numbers in left and right) may link with one of another group (tops; by default each is its own) on the other side."""
    tops = np.arange(len(sizes)) if tops is None else tops
    found = np.zeros(len(sizes), bool)
    step = max(1, COLUMNS // 8)
    for a, b, width in classes(bits[left], bits[right]):
        a, b = left[a], right[b]
        x, y = folded(bits[a].tolist(), width), folded(bits[b].tolist(), width)
        both = np.zeros((len(a), len(b)), np.float32)
        for at in range(0, width, step):
            both += np.unpackbits(x[:, at : at + step], axis=1).astype(np.float32) @ np.unpackbits(y[:, at : at + step], axis=1).astype(np.float32).T
        differ = ONES[x].sum(axis=1)[:, None] + ONES[y].sum(axis=1)[None, :] - 2 * both
        ok = may_link(differ, sizes[a][:, None], sizes[b][None, :], similarity) & (tops[a][:, None] != tops[b][None, :])
        found[a[ok.any(axis=1)]] = True
        found[b[ok.any(axis=0)]] = True
    return found


def alike(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of left, of right: numbers of sets) at or above the similarity, left unequal to right."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, n = np.unique(flat, return_inverse=True, return_counts=True)
    shared = n[column] > 1
    number = np.cumsum(n > 1) - 1
    column, owner = number[column[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(number[-1]) + 1, COLUMNS):
        lo, hi = np.searchsorted(column, (first, first + COLUMNS))
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[owner[lo:hi], column[lo:hi] - first] = 1
        both += held[left] @ held[right].T
    a, b = np.nonzero(both >= similarity * (sizes[left][:, None] + sizes[right][None, :] - both) - 1e-6)
    a, b = left[a], right[b]
    return a[a != b], b[a != b]


def shingle_links(rows: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(id, text_hash, node) of rows (id, text_hash, text), and links (a, b) enough to connect all nodes that link."""
    spark = rows.sparkSession
    small_batches(spark)

    def sampled(batches):
        let_go()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py(), shingle))], names=["h"])

    every = max(1, rows.count() // SAMPLE)
    sample = rows.where(F.pmod(F.xxhash64("text_hash"), F.lit(every)) == 0).select("text")
    often = sample.mapInArrow(sampled, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    often = often.toPandas().sort_values("h")  # at most the sample's shingles / FREQUENT
    sent = spark.sparkContext.broadcast((often["h"].to_numpy(np.int64), often["n"].to_numpy(np.int64)))

    def first(batches):
        let_go()
        for batch in batches:
            hashes = [simhash.shingle_hashes(t.as_py(), shingle) for t in batch.column(2).cast(pa.binary())]
            own = [np.unique(h.view(np.int64)) for h in hashes]
            fps = pa.array(np.array([simhash.fingerprint(h) for h in hashes], np.uint64).view(np.int64))
            columns = [
                pa.array([node_of(s) for s in own], pa.int64()), pa.array([len(s) for s in own], pa.int64()),
                pa.array([prefix(s, similarity, *sent.value) for s in own], pa.list_(pa.int64())), pa.array([bitmap(s) for s in own], pa.binary()), fps,
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["id", "text_hash", "node", "n", "prefix", "bits", "fp"])

    read = materialize(rows.mapInArrow(first, "id long, text_hash long, node long, n long, prefix array<long>, bits binary, fp long"), "shingle-prefixes")
    nodes = materialize(read.select("id", "text_hash", "node"), "shingle-nodes")
    marks = materialize(read.groupBy("node").agg(F.min("text_hash").alias("text_hash"), F.first("n").alias("n"), F.first("bits").alias("bits")), "shingle-bitmaps")

    def allowed(batches):
        for batch in batches:
            bits_a, bits_b = (np.array(batch.column(i).to_pylist() + [None], object)[:-1] for i in (4, 5))
            differ = np.zeros(batch.num_rows, np.int64)
            wide = [(len(x), len(y)) for x, y in zip(bits_a, bits_b, strict=True)]
            for x, y in set(wide):
                at = np.array([w == (x, y) for w in wide])
                differ[at] = ONES[folded(bits_a[at].tolist(), min(x, y)) ^ folded(bits_b[at].tolist(), min(x, y))].sum(axis=1)
            n_a, n_b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array(may_link(differ, n_a, n_b, similarity)))

    of = lambda table, side: table.withColumnsRenamed({c: f"{c}_{side}" for c in table.columns if c != "node"} | {"node": side})

    def may_be(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs (a, b) whose bitmaps allow a link."""
        known = marks.select("node", "n", "bits")
        marked = pairs.join(of(known, "a"), "a").join(of(known, "b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
        return materialize(marked.mapInArrow(allowed, "a long, b long"), name)

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))

    def whole(batches):
        let_go()
        for batch in batches:
            own = [shingles(t.as_py(), shingle) for t in batch.column(0).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in own], pa.int64()), pa.array(own, pa.list_(pa.int64()))], names=["node", "own"])

    def sets_of(wanted: DataFrame, name: str) -> DataFrame:
        """(node, own): whole sets of the nodes wanted."""
        wanted = materialize(marks.join(wanted.distinct(), "node", "left_semi").select("text_hash"), "wanted-texts")
        wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_TEXTS else wanted
        sets = rows.join(wanted, "text_hash", "left_semi").select("text").mapInArrow(whole, "node long, own array<long>")
        return materialize(sets.groupBy("node").agg(F.first("own").alias("own")), name)

    def alike_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Pairs (a, b) at or above the similarity."""
        common = F.size(F.array_intersect("own_a", "own_b"))
        held = pairs.join(of(sets, "a"), "a").join(of(sets, "b"), "b")
        return held.where(common >= F.lit(similarity) * (F.size("own_a") + F.size("own_b") - common) - 1e-9).select("a", "b")

    # The method first: fingerprints within two bits, found by their Golay keys, and checked on whole sets.
    reps = materialize(read.where("n > 0").groupBy("fp").agg(F.min("node").alias("rep")), "fingerprints")
    equal = read.where("n > 0").select("fp", "node").distinct().join(reps, "fp").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    named = simhash.links(reps).unionByName(equal).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    named = may_be(named, "fingerprint-pairs")
    sets = sets_of(ends(named), "fingerprint-sets")
    near = materialize(alike_pairs(named, sets), "fingerprint-links")
    release(sets)
    groups = components(near).select(F.col("id").alias("node"), F.col("component").alias("top"))

    total = read.agg(F.sum(F.size("prefix"))).first()[0] or 0
    parts = -(-total // PART) or 1

    def deal(batches):
        """Keys of a part packed in one row, which takes a third of the bytes that rows of their own would."""
        for batch in batches:
            own = batch.column(2)
            size = own.value_lengths().to_numpy(zero_copy_only=False)
            key = own.flatten().to_numpy(zero_copy_only=False)
            part = (key.view(np.uint64) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            ends = np.flatnonzero(np.diff(part[order], append=-1)) + 1
            cuts = pa.array(np.concatenate(([0], ends)), pa.int32())
            node, n = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False), size)[order] for i in (0, 1))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (key[order], node, n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(part[order][ends - 1]), *lists], names=["part", "keys", "nodes", "ns"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        key, node, n = (np.concatenate(pdf[c].to_numpy()) for c in ("keys", "nodes", "ns"))
        order = np.lexsort((node, key))
        key, node, n = key[order], node[order], n[order].astype(np.int64)
        new = np.concatenate(([True], (np.diff(key) != 0) | (np.diff(node) != 0)))
        key, node, n = key[new], node[new], n[new]
        starts = np.flatnonzero(np.concatenate(([True], np.diff(key) != 0)))
        size = np.diff(np.append(starts, len(key)))
        several = np.repeat(size > 1, size)
        columns = {"key": key, "node": node, "n": n, "size": np.repeat(size, size), "total": np.repeat(np.add.reduceat(n, starts), size)}
        return pd.DataFrame({c: x[several] for c, x in columns.items()})

    dealt = read.select("node", "n", "prefix").where("n > 0").mapInArrow(deal, "part long, keys array<long>, nodes array<long>, ns array<int>")
    shared = dealt.groupBy("part").applyInPandas(meet, "key long, node long, n long, size long, total long").join(groups, "node", "left")
    shared = materialize(shared.withColumn("top", F.coalesce("top", "node")), "shingle-lists")
    few = shared.where(F.col("size") <= LIST).select("key", "node", "n", "top")
    apart = F.expr(f"x.key = y.key AND x.node < y.node AND x.top <> y.top AND least(x.n, y.n) >= {similarity} * greatest(x.n, y.n) - 1e-9")
    pairs = few.alias("x").join(few.alias("y"), apart).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    pairs = may_be(pairs, "possible-pairs")

    def blocked(rows: DataFrame, blocks) -> DataFrame:
        """rows (key, node, ...) with the pairs of blocks that a node's own block is part of."""
        sizes = rows.groupBy("key").agg(F.ceil(blocks).cast("int").alias("blocks"))
        dealt = rows.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks")

    def sides(key, pdf) -> tuple[np.ndarray, np.ndarray]:
        block = pdf["block"].to_numpy()
        return np.flatnonzero(block == int(key[1])), np.flatnonzero(block == int(key[2]))

    def partners(key, pdf):
        found = possible(pdf["n"].to_numpy(), pdf["bits"].to_numpy(), *sides(key, pdf), similarity, pdf["top"].to_numpy())
        return pdf.loc[found, ["key", "node", "n"]]

    several = shared.where(F.col("size") > LIST).groupBy("key").agg(F.min("top").alias("low"), F.max("top").alias("high")).where("low <> high").select("key")
    many = shared.where(F.col("size") > LIST).join(several, "key", "left_semi").select("key", "node", "top").join(marks.select("node", "n", "bits"), "node")
    many = blocked(many, F.count("*") / F.lit(SETS)).groupBy("key", "i", "j").applyInPandas(partners, "key long, node long, n long").distinct()
    many = materialize(many, "long-lists")
    release(shared, read)
    sets = sets_of(ends(pairs).unionByName(many.select("node")), "shingle-sets")
    found = alike_pairs(pairs, sets)
    tasks = blocked(many, F.greatest(F.sum("n") / F.lit(BLOCK), F.count("*") / F.lit(SETS))).join(sets, "node")

    def compare(key, pdf):
        left, right = sides(key, pdf)
        ids = pdf["node"].to_numpy()
        a, b = alike([np.asarray(s, np.int64) for s in pdf["own"]], left, right, similarity)
        tied = forest(ids[a], ids[b])
        return pd.DataFrame({"a": np.array([t[0] for t in tied], np.int64), "b": np.array([t[1] for t in tied], np.int64)})

    return nodes, near.unionByName(found).unionByName(tasks.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: id, text_hash, component (the smallest id reachable over links)."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    nodes, links = shingle_links(rows, shingle, similarity)
    groups = components(links).withColumnRenamed("id", "node").withColumnRenamed("component", "top")
    named = materialize(nodes.join(groups, "node", "left").select("id", "text_hash", F.coalesce("top", "node").alias("top")), "shingle-groups")
    return named.join(named.groupBy("top").agg(F.min("id").alias("component")), "top").select("id", "text_hash", "component")
