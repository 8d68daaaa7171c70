"""Best-fit packing of tokenised documents by bin completion.

Documents are tokenised, an end id is added, and those longer than a sequence are cut into full pieces and a rest. Only the number of pieces of
each length (at most one count per length up to the sequence's) reaches the driver. There a depth-first branch and
bound completes one bin at a time around the largest length left: it enumerates undominated fillings (none whose parts fit inside a larger length that
is still there), of equal waste too, goes back over any step and prunes where the waste so far exceeds what the best packing known allows.
That incumbent starts as the better of a greedy completion and best-fit decreasing; the search ends at ceil(total / capacity) or after ``BRANCHES`` steps, however long the plan. A filling is used as often as the counts allow, which leaves some length with
fewer than the filling needs, so the number of different fillings follows that of lengths, not of pieces, and so does the plan (length, range of its
pieces -> sequence, offset).

Pieces of a length are numbered in salted groups with offsets, never in one task, and find their place by binary search in the
broadcast plan. Defined results: null or empty text has the end id alone; rows are packed whatever their id, a null id included; repeated
rows are packed each; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import Codec, default_path, model_bytes
from .common import held, materialize, read_table, small_batches

CAPACITY, END = 4096, 1
#: Steps of the short search for a bin's first filling, and of all searches that branch off while the bound isn't met.
FILLINGS, BRANCHES = 400, 400_000
#: Rows that are numbered in one group.
GROUP = 20_000


#: The pattern that this kind of tokenizer splits normalised text with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for plain chunks, whose letters are Latin ones and whose numbers are digits.
LATIN = "a-z" + "".join(chr(c) for c in range(0xC0, 0x180) if chr(c).isalpha() and chr(c) == chr(c).lower())
PLAIN_PATTERN = PATTERN.replace(r"\p{L}", LATIN).replace(r"\p{N}", "0-9")


class Words:
    """Ids of white-space separated chunks, which this kind of vocabulary encodes one by one; remembered like bpe's.

    New chunks of plain Latin letters (whose normal form is themselves) are merged by bpe's segment trees; all others, and texts
    with control characters that count as white space here but not there, go through the library."""

    def __init__(self, model: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.codec = Codec(model)
        self.split = re.compile(PLAIN_PATTERN).findall
        self.plain = re.compile("[!-;=-~\u00c0-\u012f\u0131-\u017f]+").fullmatch  # without <, which starts special tokens
        self.unplain = re.compile("[^\n!-;=-~\u00c0-\u012f\u0131-\u017f]").search
        self.odd = re.compile("[\x1c-\x1f]").search
        self.kept = self.codec.kept

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def remember(self, chunks: set[str]) -> None:
        """Sees that the ids of chunks are in kept.young."""
        new = self.kept.missing(chunks)
        slow = [c for c in new if not self.plain(c)] if self.unplain("\n".join(new)) else []
        self.kept.add(dict(zip(slow, self.whole(slow), strict=True)))
        low = {c: c.lower() for c in new.difference(slow)}
        cut = {c: self.split(w) for c, w in low.items() if not w.isalpha()}
        wanted = {p for ps in cut.values() for p in ps}
        wanted.update(low.values() if not cut else [w for c, w in low.items() if c not in cut])
        fresh = list(self.kept.missing(wanted))
        self.kept.add(dict(zip(fresh, self.codec.merge([p.encode() for p in fresh]), strict=True)))
        get = self.kept.young.__getitem__
        self.kept.add({c: b"".join(map(get, cut[c])) if c in cut else get(w) for c, w in low.items() if w != c or c in cut})

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [None if self.odd(t) else t.split() for t in texts]
        self.remember(set().union(*[x for x in cut if x]))
        get = self.kept.young.__getitem__
        out = [self.whole([t])[0] if c is None else b"".join(map(get, c)) for t, c in zip(texts, cut, strict=True)]
        self.kept.trim()
        return out


def words(model: bytes) -> Words:
    return held("words", model, Words)


def pieces(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every piece, with its ids where asked for."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(model_bytes(path or default_path("word_bpe_49k.json")))
    names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def run(batches):
        own, last = words(model.value), np.uint32(end).tobytes()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, ids in enumerate(own.encode(texts)):
                ids += last
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(i), piece.append(k), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
                    if keep_ids:
                        kept.append(np.frombuffer(part, "<u4").astype(np.int32))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.list_(pa.int32()))] * keep_ids, names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> int:
    """Bins that best-fit decreasing takes, from counts alone: bins are kept by their room, equal ones together."""
    room = np.zeros(capacity + 1, np.int64)
    bins = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fits = np.nonzero(room[length:])[0]
            if len(fits):
                at = int(fits[0]) + length
                moved = min(left, int(room[at]))
                room[at] -= moved
                room[at - length] += moved
            else:
                each = capacity // length
                moved = left if left < each else left // each * each
                if moved < each:
                    room[capacity - moved * length] += 1
                    bins += 1
                else:
                    room[capacity - each * length] += moved // each
                    bins += moved // each
            left -= moved
        room[0] = 0
    return bins


def dominated(filling: tuple[int, ...], lost: int, spare: list[int]) -> bool:
    """Whether some of the filling's lengths fit inside a larger one that is still there and fits in their place.

    lost: the filling's waste; spare: lengths left when the filling is taken. The packing loses nothing by the exchange, as the smaller ones fit where
    the larger one was."""
    one = several = 0  # bit s: a single length, or several, with sum s
    for size in filling:
        several |= (one | several) << size
        one |= 1 << size
    any_sum = one | several
    for x in spare:
        low = max(1, x - lost)
        if several >> x & 1 or (low < x and any_sum >> low & ((1 << (x - low)) - 1)):
            return True
    return False


def fillings(lengths: list[int], counts: dict[int, int], room: int, allowed: list[int], looked: list[int], most: int):
    """Yields undominated fillings of room with at most allowed[0] waste, which may shrink meanwhile: (waste, lengths from large to small).

    Lengths are descending. Parts are tried from the largest, as many as fit first. looked[0] counts the steps of the search, which ends early, short of
    fillings, only where that reaches most."""

    def search(at: int, left: int, chosen: tuple[tuple[int, int], ...]):
        """Goes as deep as a filling has different lengths, at most the square root of twice the room."""
        looked[0] += 1
        lo, hi = at, len(lengths)
        while lo < hi:  # the first length that fits
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if lengths[mid] > left else (lo, mid)
        for k in range(lo, len(lengths)):
            size = lengths[k]
            for n in range(min(counts[size], left // size), 0, -1):
                if looked[0] >= most:
                    return
                yield from search(k + 1, left - n * size, (*chosen, (size, n)))
        if left <= allowed[0]:
            used = dict(chosen)
            spare = [size for size in lengths if counts[size] > used.get(size, 0)]
            if not spare or spare[-1] > left:  # else one more fits
                filling = tuple(s for s, n in chosen for _ in range(n))
                if not dominated(filling, left, [x for x in spare if x <= room]):
                    yield left, filling

    yield from search(0, room, ())


class Packing:
    """A partial packing: counts left, fillings taken with their times, waste so far, steps of all searches."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.counts, self.capacity = counts, capacity
        self.total = sum(k * v for k, v in counts.items())
        self.looked = [0]
        self.clear()

    def clear(self) -> None:
        self.left, self.plan, self.waste = dict(self.counts), [], 0
        self.lengths = sorted(self.left, reverse=True)

    def take(self, filling: tuple[int, ...], times: int) -> None:
        for size in filling:
            self.left[size] -= times
        self.waste += (self.capacity - sum(filling)) * times
        self.plan.append((filling, times))
        self.lengths = [size for size in self.lengths if self.left[size]]

    def undo(self) -> None:
        filling, times = self.plan.pop()
        back = [size for size in set(filling) if not self.left[size]]
        for size in filling:
            self.left[size] += times
        self.waste -= (self.capacity - sum(filling)) * times
        if back:
            self.lengths = sorted(self.lengths + back, reverse=True)

    def first(self) -> tuple[int, ...]:
        """A filling of little waste around the largest length left, from a short search."""
        big, best, allowed, looked = self.lengths[0], None, [self.capacity], [0]
        self.left[big] -= 1
        others = self.lengths if self.left[big] else self.lengths[1:]
        for lost, rest in fillings(others, self.left, self.capacity - big, allowed, looked, FILLINGS):
            best, allowed[0] = (lost, rest), lost - 1
            if not lost:
                break
        self.left[big] += 1
        self.looked[0] += looked[0]
        if best:
            return (big, *best[1])
        filling, room = [big], self.capacity - big  # the short search found none: largest first
        for size in others:
            n = min(self.left[size] - (size == big), room // size)
            filling += [size] * n
            room -= n * size
        return tuple(filling)

    def times(self, filling: tuple[int, ...]) -> int:
        return min(self.left[size] // filling.count(size) for size in set(filling))

    def options(self, limit: int, most: int):
        """Yields every (filling, times) that may lead to at most limit sequences: the first one, all others, then all with fewer times."""
        big = self.lengths[0]
        slack = limit * self.capacity - self.total - self.waste
        after = self.plan[-1][0] if self.plan else None  # taken fewer times than it could be, so not again
        bounded = lambda f: min(self.times(f), slack // (self.capacity - sum(f)) if sum(f) < self.capacity else 1 << 60)
        start = self.first()
        tried = {}
        if start != after and (n := bounded(start)):
            tried[start] = n
            yield start, n
        self.left[big] -= 1
        others, counts = (self.lengths if self.left[big] else self.lengths[1:]), dict(self.left)
        self.left[big] += 1
        for _, rest in fillings(others, counts, self.capacity - big, [slack], self.looked, most):
            filling = (big, *rest)
            if filling not in tried and filling != after and (n := bounded(filling)):
                tried[filling] = n
                yield filling, n
        for fewer in range(1, max(tried.values(), default=0)):
            for filling, n in tried.items():
                if n > fewer:
                    yield filling, n - fewer

    def search(self, limit: int, most: int) -> bool:
        """Depth first from here, back over any step, until at most limit sequences suffice (then plan holds them) or looked reaches most."""
        floor = len(self.plan)
        stack = []
        while self.lengths:
            if len(stack) == len(self.plan) - floor:
                stack.append(self.options(limit, most))
            taken = next(stack[-1], None) if self.looked[0] < most else None
            if taken:
                self.take(*taken)
            else:
                stack.pop()
                if not stack or self.looked[0] >= most:
                    return False
                self.undo()
        return True


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Fillings and how many sequences have each, as few sequences in all as the search finds.

    Half of the search's ``BRANCHES`` steps go depth first through the whole tree, the others through what follows another choice at each of
    the best plan's steps in turn; both end at the bound ceil(total / capacity)."""
    counts = {k: v for k, v in counts.items() if v}
    state = Packing(counts, capacity)
    while state.lengths:
        filling = state.first()
        state.take(filling, state.times(filling))
    best, size = state.plan, sum(n for _, n in state.plan)
    if size > best_fit_decreasing(counts, capacity):
        best = _best_fit_plan(counts, capacity)
        size = sum(n for _, n in best)
    least = -(-state.total // capacity)
    state.looked[0] = 0
    while size > least:
        state.clear()
        if not state.search(size - 1, state.looked[0] + (BRANCHES - state.looked[0]) // 2):
            break
        best, size = state.plan, sum(n for _, n in state.plan)
    at = 0
    while size > least and at < len(best) and state.looked[0] < BRANCHES:
        state.clear()
        for filling, times in best[:at]:
            state.take(filling, times)
        most = state.looked[0] + max(2 * FILLINGS, (BRANCHES - state.looked[0]) // (len(best) - at))
        at += 1
        if state.waste > (size - 1) * capacity - state.total:
            break
        choices = (c for c in state.options(size - 1, most) if c != best[at - 1])
        if (other := next(choices, None)) is None:
            continue
        state.take(*other)
        if state.search(size - 1, most):
            best, size, at = state.plan, sum(n for _, n in state.plan), 0
    return best


def _best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The incumbent's bins, for the case that no completion beats it."""
    bins: dict[tuple[int, ...], int] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fits = [b for b in bins if capacity - sum(b) >= length]
            if fits:
                old = max(fits, key=lambda b: (sum(b), b))
                moved = min(left, bins[old])
                bins[old] -= moved
                if not bins[old]:
                    del bins[old]
                new = (*old, length)
            elif left >= capacity // length:
                each = capacity // length
                bins[(length,) * each] = bins.get((length,) * each, 0) + left // each
                left %= each
                continue
            else:
                bins[(length,) * left] = bins.get((length,) * left, 0) + 1
                break
            bins[new] = bins.get(new, 0) + moved
            left -= moved
    return list(bins.items())


def plan_runs(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first piece number, pieces in each sequence, first sequence, first offset), by length and first."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for filling, times in plan:
        at, k = 0, 0
        while k < len(filling):
            size, n = filling[k], 1
            while k + n < len(filling) and filling[k + n] == size:
                n += 1
            rows.append((size, taken.get(size, 0), n, sequence, at))
            taken[size] = taken.get(size, 0) + n * times
            at += n * size
            k += n
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def best_fit_pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, path, id_col, text_col, capacity, end), "pieces")
    groups = max(1, -(-cut.count() // GROUP))
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = spark.sparkContext.broadcast(plan_runs(pack_counts(counts, capacity)))
    firsts = sizes.withColumn("_first", F.sum("n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("n")).drop("n")
    order = Window.partitionBy("length", "_salt").orderBy("id", "piece", "start", "ids_crc32")
    numbered = salted.withColumn("_number", F.row_number().over(order)).join(firsts, ["length", "_salt"])
    numbered = numbered.select("id", "piece", "start", "length", "ids_crc32", (F.col("_first") + F.col("_number") - 1).alias("number"))

    def place(batches):
        table = runs.value
        keys = table[:, 0] << 48 | table[:, 1]
        for batch in batches:
            length, number = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            run = table[np.searchsorted(keys, length << 48 | number, side="right") - 1]
            past = number - run[:, 1]
            sequence, offset = run[:, 3] + past // run[:, 2], run[:, 4] + past % run[:, 2] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.mapInArrow(place, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
