"""Removal of repeated byte strings by merging shard Burrows-Wheeler transforms.

A byte goes if some string of ``LENGTH`` bytes covers it that also starts earlier (in a document of smaller id, or earlier in the same
one). Strings never cross documents and are judged on the input.

1. Windows of LENGTH bytes pick an anchor, the least hashed gram of ``GRAM`` bytes in them, so equal windows pick equal anchors at the same
   place. The windows of one anchor occurrence are neighbours; together they are a context (about 130 bytes). Contexts equal in all bytes
   (64-bit digests under the same anchor) fall together: all but the earliest are repeated as a whole.
2. What is left are anchors with several different contexts, edges of repeated passages. Only for these are bytes gathered. A window holds ``SIDE`` bytes or more
   on one side of its anchor, so contexts that agree with no other of their anchor in the ``SIDE`` bytes before it or after it share no window and are done. The others, whole
   anchors of them, form a collection of up to ``COLLECTION`` bytes, cut into shards. Each shard's suffixes are sorted once, giving its Burrows-Wheeler
   transform. The transforms are merged by iterative interleave refinement (Holt and McMillan, 2014): the interleave, which shard each merged row comes from, is
   stably sorted by the rows' preceding symbols; after round h it is right for the first h symbols, and a border that appears between two neighbours in
   round h is a common prefix of h - 1. After LENGTH rounds rows without a border between them are the repeated intervals; suffixes are not sorted again.
3. In each interval all but the earliest window are repeated. Spans go back to their documents and are cut out.

Copies within a batch of documents are found where they are read and don't travel by anchor, so a passage in a third of all documents
loads no task with its occurrences. An anchor whose different contexts outgrow a collection is resolved by digests of its windows, an aggregation that
combines before its shuffle. Texts move only if they hold contexts to compare or spans to cut. Documents' bytes are cut into segments for hashing, so memory stays
bounded for long texts.

Defined results: null text is empty; texts shorter than LENGTH lose nothing; a null id comes after all others; rows that share an id are ordered by
a hash of their text, and rows that share both are one document, each with the same result; in text a character that was cut in part is left out,
digests and counts are of bytes; an empty table gives an empty result; other columns are kept as they are."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let_go, materialize, read_table, small_batches, unused

LENGTH, GRAM = 100, 32
SIDE = (LENGTH - GRAM) // 2
SEGMENT = 1 << 18
COLLECTION, SHARD, HOT = 1 << 16, 1 << 14, 1 << 22
#: Documents whose ids (16 bytes) may be broadcast; beyond, a shuffle join picks them.
BROADCAST_IDS = 500_000
LAST = (1 << 63) - 1

_BASE = 0x9E3779B97F4A7C15
_TABLES: dict[str, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    m = 1
    with np.errstate(over="ignore"):
        while m < n:
            k = min(m, n - m)
            out[m : m + k] = out[:k] * np.uint64(pow(base, m, 1 << 64))
            m *= 2
    return out


def _table(name: str) -> np.ndarray:
    if not _TABLES:
        size = SEGMENT + 2 * LENGTH + 2
        _TABLES["byte"] = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        _TABLES["up"], _TABLES["down"] = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
    return _TABLES[name]


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        for _ in range(2):
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _segment_contexts(b: np.ndarray) -> tuple[np.ndarray, ...]:
    wide = LENGTH - GRAM + 1
    low = np.uint64((1 << 20) - 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_table("byte")[b] * _table("down")[: len(b)], out=sums[1:])
        gram = _mix((sums[GRAM:] - sums[:-GRAM]) * _table("up")[: len(b) - GRAM + 1])
        least = value = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
        size = 1
        while size * 2 <= wide:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        windows = len(gram) - wide + 1
        least = np.minimum(least[:windows], least[wide - size : wide - size + windows])
        anchor = (least & low).astype(np.int64)
        cut = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
        lo, hi = np.concatenate(([0], cut)), np.concatenate((cut - 1, [len(anchor) - 1]))
        at = anchor[lo]
        body = (sums[hi + LENGTH] - sums[lo]) * _table("up")[lo]
        context = _mix(body + (at - lo).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + (hi - lo).astype(np.uint64) * np.uint64(0x165667B19E3779F9))
    del value
    return gram[at], context, lo, (hi - lo + 1) | (at - lo) << 8


def contexts(text: bytes) -> tuple[np.ndarray, ...]:
    """Anchor hashes, context digests, first windows, and numbers of windows (low byte) with the anchor's place after the first window's start. A segment's border splits a context, which costs only a
    comparison more: contexts of one anchor needn't hold all of its windows."""
    b = np.frombuffer(text, np.uint8)
    windows = len(b) - LENGTH + 1
    if windows < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts = []
    for at in range(0, windows, SEGMENT):
        a, c, lo, n = _segment_contexts(b[at : min(at + SEGMENT, windows) + LENGTH - 1])
        parts.append((a, c, lo + at, n))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _find_contexts(batches):
    """(a, c, id, sub, lo, n, whole): whole marks contexts with an earlier copy in the batch; they get a random anchor."""
    let_go()
    for batch in batches:
        ids, subs = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        texts = batch.column(2).cast(pa.binary())
        found, rows = [], []
        for i in np.lexsort((subs, ids)).tolist():
            got = contexts(texts[i].as_py() or b"")
            if len(got[0]):
                found.append(got)
                rows.append(np.full(len(got[0]), i))
        if not found:
            continue
        a, c, lo, n = (np.concatenate(x) for x in zip(*found, strict=True))
        row = np.concatenate(rows)
        with np.errstate(over="ignore"):
            both = a ^ (c * np.uint64(_BASE))
        order = np.argsort(both, kind="stable")
        again = np.zeros(len(a), bool)
        again[order[1:]] = (a[order[1:]] == a[order[:-1]]) & (c[order[1:]] == c[order[:-1]])
        a = np.where(again, _mix(a + row.astype(np.uint64) * np.uint64(_BASE) + lo.astype(np.uint64)), a)
        columns = [pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), pa.array(ids[row]), pa.array(subs[row]), pa.array(lo), pa.array(n.astype(np.int32)), pa.array(again)]
        for at in range(0, len(a), 1 << 16):
            yield pa.RecordBatch.from_arrays([x[at : at + (1 << 16)] for x in columns], names=["a", "c", "id", "sub", "lo", "n", "whole"])


def _sort_contexts(batches):
    """From rows in order of (a, c, id, sub, lo): whole repeats, and the first of each context where an anchor has several.

    An anchor's first context is held back until a second one comes; nothing else is kept between batches."""
    held, last, several = None, None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows])
        rows = rows.combine_chunks()
        a, c, known = (rows.column(i).to_numpy() for i in (0, 1, 6))
        going = held is None and last is not None and last[0] == a[0]
        apart = np.concatenate(([not going], a[1:] != a[:-1]))
        new = apart | np.concatenate(([going and last[1] != c[0]], c[1:] != c[:-1]))
        group = np.cumsum(apart) - apart[0]
        first = new & ~known
        count = np.bincount(group[first], minlength=group[-1] + 1)
        if going and several:
            count[0] += 2
        several = bool(count[group[-1]] >= 2)
        last = (a[-1], c[-1])
        fresh = np.flatnonzero(first & (group == group[-1]))
        held = rows.slice(int(fresh[0]), 1) if not several and len(fresh) else None
        whole = known | ~new
        out = pa.array(np.flatnonzero(whole | (first & (count[group] >= 2))))
        if len(out):
            columns = [rows.column(i).take(out).combine_chunks() for i in (0, 2, 3, 4, 5)]
            columns = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in columns]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(whole[out.to_numpy()])], names=["a", "id", "sub", "lo", "n", "whole"])


def shard_transform(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(preceding symbols, text numbers, places) of a shard's suffixes in order of their first LENGTH symbols.

    Symbols are bytes plus one; 0 ends each text. Prefix doubling, from seven symbols packed in one key."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    ends = np.cumsum(sizes)
    symbol = np.zeros(int(ends[-1]), np.uint16)
    body = np.ones(len(symbol), bool)
    body[ends - 1] = False
    symbol[body] = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint16) + 1
    number = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(symbol)) - np.repeat(ends - sizes, sizes)
    left = np.repeat(ends, sizes) - np.arange(len(symbol))  # symbols to the text's end, its end included
    key = np.zeros(len(symbol), np.uint64)
    for k in range(7):
        part = np.zeros(len(symbol), np.uint64)
        part[: len(symbol) - k] = symbol[k:]
        part[left <= k] = 0
        key = (key << np.uint64(9)) | part
    known = 7
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(len(key), np.uint64)
        rank[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1]))).astype(np.uint64)
        if known >= LENGTH or int(rank.max()) == len(key) - 1:
            break
        after = np.zeros(len(key), np.uint64)
        if known < len(key):
            after[: len(key) - known] = rank[known:] + np.uint64(1)
        after[left <= known] = 0
        key = (rank << np.uint64(32)) | after
        known *= 2
    order[: len(texts)] = ends - 1  # empty suffixes come first, in order of the texts
    before = np.zeros(len(symbol), np.uint16)
    before[1:] = symbol[:-1]
    before[place == 0] = 0
    return before[order], number[order], place[order]


def merge_transforms(shards: list[np.ndarray], rounds: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Merges transforms: (order, interval). order lists rows, numbered shard after shard, as merged; rows with equal
    interval agree in their first ``rounds`` symbols. The interleave is refined until nothing changes.

    The interleave is held as the rows themselves (a shard's rows keep their order in it): a round sorts them stably by preceding symbol and
    steps each to the row of the suffix that is longer by that symbol, which a shard's own transform tells once and for all."""
    symbols = np.concatenate(shards)
    if symbols.max(initial=0) < 256:
        symbols = symbols.astype(np.uint8)
    longer = np.empty(len(symbols), np.int32)
    empty, at = [], 0
    for s in shards:
        step = np.argsort(symbols[at : at + len(s)], kind="stable")
        longer[at + step] = np.arange(at, at + len(s), dtype=np.int32)
        empty.append(np.arange(at, at + int((s == 0).sum()), dtype=np.int32))
        at += len(s)
    ended = np.concatenate(empty)  # empty suffixes, by shard
    order = np.arange(len(symbols), dtype=np.int32)
    interval = np.zeros(len(symbols), np.int32)
    refined = np.zeros(len(symbols), np.int32)
    border = np.zeros(len(symbols), bool)
    for _ in range(rounds):
        preceding = symbols[order]
        step = np.argsort(preceding, kind="stable")
        held, before = preceding[step], interval[step]
        np.not_equal(held[1:], held[:-1], out=border[1:])
        border[1:] |= before[1:] != before[:-1]
        border[1 : len(ended)] = False  # empty suffixes are equal
        np.cumsum(border, dtype=np.int32, out=refined)
        order = longer[order[step]]
        order[: len(ended)] = ended
        if refined[-1] == interval[-1] and np.array_equal(refined, interval):
            break
        interval, refined = refined, interval
    return order, interval


def repeated_windows(texts: list[bytes], earlier: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text numbers, places) of the windows that an earlier one equals. earlier ranks the texts by id; the first counts[i] suffixes
    of text i are its windows. Equal ids mean equal documents, where the smaller place (added by the caller) counts."""
    cut, at, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= SHARD or i == len(texts) - 1:
            cut.append((at, i + 1))
            at, size = i + 1, 0
    shards = [shard_transform(texts[x:y]) for x, y in cut]
    order, interval = merge_transforms([s[0] for s in shards])
    number = np.concatenate([s[1] + x for s, (x, _) in zip(shards, cut, strict=True)])
    place = np.concatenate([s[2] for s in shards])
    number, place = number[order], place[order]
    window = place < counts[number]
    number, place, interval = number[window], place[window], interval[window]
    rank = earlier[number] + place
    first = np.full(int(interval.max(initial=0)) + 1, LAST)
    np.minimum.at(first, interval, rank)
    again = rank > first[interval]
    return number[again], place[again]


def likely(rows: list[tuple]) -> list[tuple]:
    """Contexts of one anchor that agree with another one in the bytes before or after it, without which they share no window."""
    sides = []
    for r in rows:
        n, at, text = r[4] & 255, r[4] >> 8, r[5]
        before = text[at - SIDE : at] if at >= SIDE else None
        after = text[at + GRAM : at + GRAM + SIDE] if n + LENGTH - 1 >= at + GRAM + SIDE else None
        sides.append((before, after))
    left, right = (Counter(side[k] for side in sides if side[k] is not None) for k in (0, 1))
    return [r for r, (before, after) in zip(rows, sides, strict=True) if left[before] > 1 or right[after] > 1]


def spans_of(number: np.ndarray, place: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows as (text number, from, to) in bytes; none where a collection holds no repeated window."""
    if not len(number):
        return (np.zeros(0, np.int64),) * 3
    order = np.lexsort((place, number))
    number, place = number[order], place[order]
    start = np.concatenate(([True], (number[1:] != number[:-1]) | (place[1:] != place[:-1] + 1)))
    stop = np.concatenate((start[1:], [True]))
    return number[start], lo[number[start]] + place[start], lo[number[stop]] + place[stop] + LENGTH


def _compare(batches, collection: int = COLLECTION, hot_bytes: int = HOT):
    """From context bytes in order of anchors: repeated spans (kind 0), and window digests of anchors too common for a collection (kind 1)."""
    names = ["kind", "id", "sub", "lo", "hi", "d1", "d2"]

    def table(kind, ids, subs, lo, hi, d1=None, d2=None):
        zero = np.zeros(len(lo), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(lo), kind, np.int32)), *(pa.array(np.asarray(x, np.int64)) for x in (ids, subs, lo, hi, zero if d1 is None else d1, zero if d2 is None else d2))], names=names)

    def solve(rows):
        rows.sort(key=lambda r: r[1:4])
        ids, subs, lo, counts = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3, 4))
        counts &= 255
        document = np.cumsum(np.concatenate(([0], (ids[1:] != ids[:-1]) | (subs[1:] != subs[:-1]))))
        # Ranks: documents in order, then starts. A document's starts take less than 2^40.
        number, place = repeated_windows([r[5] for r in rows], (document << 40) + lo, counts)
        n, start, stop = spans_of(number, place, lo)
        return table(0, ids[n], subs[n], start, stop)

    def digests(rows):
        from xxhash import xxh3_128_digest

        for r in rows:
            text, n = r[5], r[4] & 255
            d = np.frombuffer(b"".join([xxh3_128_digest(text[k : k + LENGTH]) for k in range(n)]), "<i8").reshape(-1, 2)
            lo = r[3] + np.arange(n)
            yield table(1, np.full(n, r[1]), np.full(n, r[2]), lo, lo + LENGTH, d[:, 0], d[:, 1])

    ready, size = [], 0  # whole anchors
    group, group_size, hot = [], 0, False
    anchor = None
    for batch in batches:
        for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if row[0] != anchor:
                group = likely(group)
                ready += group
                size += sum(len(r[5]) + 1 for r in group)
                if size >= collection:
                    yield solve(ready)
                    ready, size = [], 0
                anchor, group, group_size, hot = row[0], [], 0, False
            if hot:
                yield from digests([row])
                continue
            group.append(row)
            group_size += len(row[5]) + 1
            if group_size > hot_bytes:
                yield from digests(group)
                group, group_size, hot = [], 0, True
    ready += likely(group)
    if ready:
        yield solve(ready)


def _cut_contexts(batches):
    """Context bytes from (id, sub, text, wanted), wanted the document's (a, lo, n)."""
    names = ["a", "id", "sub", "lo", "n", "bytes"]
    for batch in batches:
        out, size = [], 0
        for i, s, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True):
            text = text or b""
            for w in wanted:
                part = text[w["lo"] : w["lo"] + (w["n"] & 255) - 1 + LENGTH]
                out.append((w["a"], i, s, w["lo"], w["n"], part))
                size += len(part)
            if size > 4 << 20:
                yield _records(out, names)
                out, size = [], 0
        if out:
            yield _records(out, names)


def _records(rows, names):
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column, bool]:
    """The id (null last) and, only where some id isn't unique, a hash of the text beside it."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    unique = docs.groupBy(key.alias("k")).agg(F.count("*").alias("n")).where((F.col("n") > 1) | (F.col("k") == LAST)).isEmpty()
    return key, (F.lit(0).cast("long") if unique else F.xxhash64(F.col(text_col).cast("string"))), unique


def _with_ids(docs: DataFrame, ids: DataFrame, how: str, key: str = "vg_id", sub: str = "vg_sub") -> DataFrame:
    """Rows whose (key, sub) are (or aren't) among ids (vg_id, vg_sub), which are broadcast up to a checked number."""
    ids = ids.select(F.col("vg_id").alias(key), F.col("vg_sub").alias(sub))
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, [key, sub], how)


def repeated_spans(docs: DataFrame, collection: int = COLLECTION, hot_bytes: int = HOT) -> DataFrame:
    """(vg_id, vg_sub, vg_spans) of documents (vg_id, vg_sub, vg_text) that hold repeated strings: array of (lo, hi), in no order, overlaps possible."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("vg_id", "vg_sub", "vg_text")
    found = docs.mapInArrow(_find_contexts, "a long, c long, id long, sub long, lo long, n int, whole boolean")
    found = found.repartition("a").sortWithinPartitions("a", "c", "id", "sub", "lo")
    kinds = materialize(found.mapInArrow(_sort_contexts, "a long, id long, sub long, lo long, n int, whole boolean"), "contexts")
    whole = kinds.where("whole").select("id", "sub", "lo", (F.col("lo") + F.col("n").bitwiseAND(255) - 1 + LENGTH).alias("hi"))
    wanted = kinds.where("NOT whole").groupBy(F.col("id").alias("vg_id"), F.col("sub").alias("vg_sub")).agg(F.collect_list(F.struct("a", "lo", "n")).alias("vg_wanted"))
    wanted = materialize(wanted, "wanted-contexts")
    texts = _with_ids(docs, wanted.select("vg_id", "vg_sub"), "left_semi").join(wanted.hint("shuffle_merge"), ["vg_id", "vg_sub"])
    cut = texts.select("vg_id", "vg_sub", "vg_text", "vg_wanted").mapInArrow(_cut_contexts, "a long, id long, sub long, lo long, n int, bytes binary")
    compared = cut.repartition("a").sortWithinPartitions("a").mapInArrow(lambda batches: _compare(batches, collection, hot_bytes), "kind int, id long, sub long, lo long, hi long, d1 long, d2 long")
    compared = materialize(compared, "compared-contexts")
    digests = compared.where("kind = 1")
    spans = whole.unionByName(compared.where("kind = 0").select("id", "sub", "lo", "hi"))
    if not digests.isEmpty():
        place = F.struct("id", "sub", "lo")
        firsts = digests.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        spans = spans.unionByName(digests.join(firsts, ["d1", "d2"]).where(place > F.col("first")).select("id", "sub", "lo", "hi"))
    spans = spans.groupBy(F.col("id").alias("vg_id"), F.col("sub").alias("vg_sub")).agg(F.collect_set(F.struct("lo", "hi")).alias("vg_spans"))
    return materialize(spans, "repeated-spans")


def cut_out(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(bytes left, bytes removed, maximal runs removed)."""
    left, at, runs, removed = [], 0, 0, 0
    stop = -1
    for lo, hi in sorted(spans):
        if lo > stop:
            left.append(text[max(at, 0) : lo])
            runs += 1
            stop = at = hi
            removed += hi - lo
        elif hi > stop:
            removed += hi - stop
            stop = at = hi
    left.append(text[at:])
    return b"".join(left), removed, runs


def _cut_texts(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    rows = []
    for text, own in zip(texts, spans, strict=True):
        kept, removed, runs = cut_out(bytes(text or b""), [(x["lo"], x["hi"]) for x in own])
        rows.append((kept.decode("utf-8", "ignore"), removed, runs, hashlib.sha256(kept).hexdigest()))
    return pd.DataFrame(rows, columns=["text", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: str = "vg_", **limits) -> DataFrame:
    """docs with repeated strings cut out of text_col, and prefix + n_bytes, n_removed, n_spans and kept_sha256 added (replacing columns of those names)."""
    key, sub, unique = _keyed(docs, id_col, text_col)
    own_id, own_sub, own_text, own_spans, own_cut = unused(docs, "id", "sub", "text", "spans", "cut")
    own = docs.withColumns({own_id: key, own_sub: sub, own_text: F.col(text_col).cast("string")})
    narrow = own.select(F.col(own_id).alias("vg_id"), F.col(own_sub).alias("vg_sub"), F.col(own_text).alias("vg_text"))
    spans = repeated_spans(narrow if unique else narrow.dropDuplicates(["vg_id", "vg_sub"]), **limits)
    added = [f"{prefix}{c}" for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")]
    size = F.coalesce(F.octet_length(own_text), F.lit(0)).cast("long")
    none = F.lit(0).cast("long")
    plain = _with_ids(own, spans, "left_anti", own_id, own_sub)
    plain = plain.withColumns(dict(zip(added, (size, none, none, F.sha2(F.encode(F.coalesce(own_text, F.lit("")), "UTF-8"), 256)), strict=True)))
    found = spans.select(F.col("vg_id").alias(own_id), F.col("vg_sub").alias(own_sub), F.col("vg_spans").alias(own_spans))
    changed = _with_ids(own, spans, "left_semi", own_id, own_sub).join(found.hint("shuffle_merge"), [own_id, own_sub])
    cut = F.pandas_udf(_cut_texts, "text string, n_removed long, n_spans long, kept_sha256 string")
    changed = changed.withColumn(own_cut, cut(F.encode(own_text, "UTF-8"), F.col(own_spans)))
    results = (size, *(F.col(f"{own_cut}.{c}") for c in ("n_removed", "n_spans", "kept_sha256")))
    changed = changed.withColumns({**dict(zip(added, results, strict=True)), text_col: F.col(f"{own_cut}.text")})
    columns = [*(c for c in docs.columns if c not in added), *added]
    return plain.select(columns).unionByName(changed.select(columns))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("vg_n_bytes").alias("n_bytes"), F.col("vg_n_removed").alias("n_removed"), F.col("vg_n_spans").alias("n_spans"), F.col("vg_kept_sha256").alias("kept_sha256"))
