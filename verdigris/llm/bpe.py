"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

A pre-token's symbols are the leaves' left ends: leaf i holds the rank of the pair of symbol i and its successor, joined
with i, so the root is the lowest-ranked pair and of equals the leftmost. A merge changes three leaves (the pair itself, its left
neighbour's and the swallowed symbol's) and the nodes above them, a logarithmic number of points, until the root is empty. The trees of
many pre-tokens stand side by side in NumPy arrays (node by pre-token), so one step merges a pair in each of them. A pre-token of more
than ``WIDE`` bytes has a tree of its own, where a step merges all pairs of the root's rank at once, from left to right: pairs that a merge makes rank
behind it in any trained file (else they go one by one), so the order of merges stays the same.

Encoded pre-tokens are remembered per Python worker in two generations of about ``KEPT_BYTES`` and at most ``KEPT`` entries each, which bounds memory; texts
are otherwise independent rows, so nothing is shuffled. The vocabulary file is read once on the driver and broadcast: its size is that of the
file (at most ``MODEL_BYTES``).

Defined results: null text encodes as the empty text (no ids); the file's added tokens are recognised in the text, as the file says;
repeated rows are encoded each; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, read_table, small_batches

KEPT, MODEL_BYTES, NONE = 500_000, 64 << 20, np.int64(1) << 60
#: Bytes (about) of a generation of remembered pre-tokens, what an entry takes beside its text and ids, and the size of one step's trees.
KEPT_BYTES, ENTRY_BYTES, TREES = 64 << 20, 180, 1 << 19
#: Bytes from which a pre-token gets a tree of its own.
WIDE = 256
WHITE = r"\t-\r \x85\xa0  -     　"
#: The pattern that byte-level tokenizers of this family split text with.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def model_bytes(path: str) -> bytes:
    if os.path.getsize(path) > MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MODEL_BYTES} bytes, the bound of what is broadcast")
    with open(path, "rb") as f:
        return f.read()


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    shift = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shift)) for b in range(256)]


class Remembered:
    """Ids by text in two generations: what is asked for moves to the young one; when that is full, the old one goes."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def missing(self, wanted: set[str]) -> set[str]:
        """Those of wanted that aren't remembered; all others are young afterwards."""
        rest = wanted.difference(self.young)
        if again := self.old.keys() & rest:
            self.add({t: self.old[t] for t in again})
            rest -= again
        return rest

    def add(self, found: dict[str, bytes]) -> None:
        self.young.update(found)
        self.size += sum(map(len, found)) + sum(map(len, found.values())) + ENTRY_BYTES * len(found)

    def trim(self) -> None:
        if self.size > KEPT_BYTES or len(self.young) > KEPT:
            self.old, self.young, self.size = self.young, {}, 0


class Codec:
    def __init__(self, model: bytes):
        import regex

        spec = json.loads(model)
        vocab = spec["model"]["vocab"]
        letters = byte_characters()
        raw = {c: bytes([b]) for b, c in enumerate(letters)}
        self.tokens: list[bytes] = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for text, i in vocab.items():
            self.tokens[i] = b"".join(raw[c] for c in text)
        for t in spec["added_tokens"]:
            self.tokens[t["id"]] = t["content"].encode()
        self.base = len(self.tokens)
        self.symbols = np.array([vocab[c] for c in letters], dtype=np.int64)
        ending = spec["model"].get("end_of_word_suffix") or ""
        self.last_symbols = np.array([vocab[c + ending] for c in letters], dtype=np.int64)
        self.ending = len(ending)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in merges], dtype=np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)  # a word's end is part of b
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        made = np.full(self.base, -1, np.int64)
        made[self.merged] = np.arange(len(merges))
        parts = keys // self.base, keys % self.base
        self.rising = all(bool((made[p] < np.arange(len(merges))).all()) for p in parts)
        self.added = {t["content"]: np.uint32(t["id"]).tobytes() for t in spec["added_tokens"]}
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.split = regex.compile(PATTERN)
        self.odd = regex.compile(rf"[\t\x0b-\r\x1c-\x1f\x85\xa0  -     　]|[ \n][ \n]|^[ \n]|[ \n]\Z")
        self.kept = Remembered()

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it doesn't merge."""
        keys = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], NONE)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each pre-token as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        widths = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
        for width in np.unique(widths).tolist():
            rows = np.nonzero(widths == width)[0]
            if width > WIDE and self.rising:
                for i in rows.tolist():
                    out[i] = self._merge_wide(words[i], width)
                continue
            step = max(1, TREES // width)
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                for i, ids in zip(part.tolist(), self._merge(words, part, sizes[part], width), strict=True):
                    out[i] = ids
        return out

    def _merge(self, words: list[bytes], rows: np.ndarray, sizes: np.ndarray, width: int) -> list[bytes]:
        count, depth = len(rows), width.bit_length() - 1
        col = np.arange(count)
        place = np.arange(width)[:, None]
        flat = np.frombuffer(b"".join(words[i] for i in rows.tolist()), np.uint8)
        symbol = np.full((count, width), -1, np.int64)
        symbol[np.arange(width) < sizes[:, None]] = self.symbols[flat]
        if self.ending:
            symbol[col, sizes - 1] = self.last_symbols[flat[np.cumsum(sizes) - 1]]
        symbol = np.ascontiguousarray(symbol.T)
        after = np.where(place + 1 < sizes, place + 1, width)
        before = np.broadcast_to(place - 1, (width, count)).copy()
        tree = np.full((2 * width, count), NONE)
        pairs = place[:-1] + 1 < sizes
        rank = np.full((width - 1, count), NONE)
        rank[pairs] = self.ranks(symbol[:-1][pairs], symbol[1:][pairs])
        tree[width : 2 * width - 1] = np.where(rank == NONE, NONE, (rank << depth) | place[:-1])
        for node in range(width - 1, 0, -1):
            tree[node] = np.minimum(tree[2 * node], tree[2 * node + 1])

        def put(at: np.ndarray, c: np.ndarray, value: np.ndarray) -> None:
            node = at + width
            tree[node, c] = value
            for _ in range(depth):
                node >>= 1
                tree[node, c] = np.minimum(tree[2 * node, c], tree[2 * node + 1, c])

        while True:
            col = col[tree[1, col] < NONE]
            if not len(col):
                break
            root = tree[1, col]
            here = root & (width - 1)
            new = self.merged[root >> depth]
            gone = after[here, col]
            then = after[gone, col]
            symbol[here, col], symbol[gone, col], after[here, col] = new, -1, then
            put(gone, col, np.full(len(col), NONE))
            more = then < width
            before[then[more], col[more]] = here[more]
            found = np.full(len(col), NONE)
            found[more] = self.ranks(new[more], symbol[then[more], col[more]])
            put(here, col, np.where(found == NONE, NONE, (found << depth) | here))
            prior = before[here, col]
            some = prior >= 0
            left, c = prior[some], col[some]
            found = self.ranks(symbol[left, c], new[some])
            put(left, c, np.where(found == NONE, NONE, (found << depth) | left))
        symbol = symbol.T
        alive = symbol >= 0
        ids = symbol[alive].astype("<u4").tobytes()
        ends = np.cumsum(alive.sum(axis=1)) * 4
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _merge_wide(self, word: bytes, width: int) -> bytes:
        """The same for one long pre-token, whose pairs of the lowest rank are all merged in one step."""
        size, depth = len(word), width.bit_length() - 1
        symbol = self.symbols[np.frombuffer(word, np.uint8)]
        if self.ending:
            symbol[-1] = self.last_symbols[word[-1]]
        after, before = np.arange(1, size + 1), np.arange(-1, size - 1)
        tree = np.full(2 * width, NONE)
        tree[width : width + size - 1] = self.ranks(symbol[:-1], symbol[1:])
        for level in range(depth - 1, -1, -1):
            at = slice(1 << level, 2 << level)
            tree[at] = np.minimum(tree[2 << level : 4 << level : 2], tree[(2 << level) + 1 : 4 << level : 2])
        while (low := tree[1]) < NONE:
            here = np.ones(1, np.int64)
            for _ in range(depth):
                here = np.stack((2 * here, 2 * here + 1), axis=1).ravel()
                here = here[tree[here] == low]
            here -= width
            place = np.arange(len(here))
            follows = np.concatenate(([False], after[here[:-1]] == here[1:]))
            here = here[(place - np.maximum.accumulate(np.where(follows, 0, place))) % 2 == 0]  # of overlapping pairs every other one
            gone = after[here]
            then = after[gone]
            new = self.merged[low]
            symbol[here], symbol[gone], after[here] = new, -1, then
            some = then < size
            before[then[some]] = here[some]
            changed = [gone]
            tree[gone + width] = NONE
            for left in (here, before[here][before[here] >= 0]):
                right = after[left]
                last = right >= size
                found = self.ranks(symbol[left], symbol[np.where(last, 0, right)])
                tree[left + width] = np.where(last, NONE, found)
                changed.append(left)
            node = np.unique(np.concatenate(changed)) + width
            for _ in range(depth):
                node >>= 1
                node = node[np.concatenate(([True], node[1:] != node[:-1]))]
                tree[node] = np.minimum(tree[2 * node], tree[2 * node + 1])
        return symbol[symbol >= 0].astype("<u4").tobytes()

    def remember(self, chunks: set[str]) -> None:
        """Sees that the ids of chunks (texts that no pre-token leaves) are in kept.young."""
        missing = list(self.kept.missing(chunks))
        if not missing:
            return
        split = self.split.findall
        parts = [(c,) if c[1:].isalpha() and c[0] == " " else split(c) for c in missing]
        fresh = list(self.kept.missing({p for ps in parts for p in ps}))
        self.kept.add(dict(zip(fresh, self.merge([p.encode() for p in fresh]), strict=True)))
        get = self.kept.young.__getitem__
        self.kept.add({c: b"".join(map(get, ps)) for c, ps in zip(missing, parts, strict=True) if len(ps) != 1 or ps[0] != c})

    def chunks(self, text: str) -> list[str]:
        """Text cut where no pre-token crosses, or into pre-tokens and added tokens where its white space isn't plain."""
        if self.odd.search(text) is None:
            words = text.replace("\n", " \n").split(" ")
            first = words[0]
            words = [w if w[:1] == "\n" else " " + w for w in words]
            words[0] = first
            return words if first else words[1:]
        return self.split.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        cut, mixed = [], []
        for text in texts:
            mixed.append(self.special is not None and self.special.search(text) is not None)
            if mixed[-1]:
                cut.append([x for i, part in enumerate(self.special.split(text)) for x in ([self.added[part]] if i % 2 else self.chunks(part))])
            else:
                cut.append(self.chunks(text))
        self.remember(set().union(*[cs for cs, odd in zip(cut, mixed, strict=True) if not odd]) | {c for cs, odd in zip(cut, mixed, strict=True) if odd for c in cs if c.__class__ is str})
        get = self.kept.young.__getitem__
        out = [b"".join([c if c.__class__ is bytes else get(c) for c in cs] if odd else map(get, cs)) for cs, odd in zip(cut, mixed, strict=True)]
        self.kept.trim()
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def codec(model: bytes) -> Codec:
    return held("bpe", model, Codec)


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def bpe_encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the ids of each row's whole text."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(model_bytes(path or default_path()))

    def run(batches):
        own = codec(model.value)
        for batch in batches:
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in own.encode(_texts(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str | None = None, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the text of each row's ids, special tokens included; null ids give the empty text."""
    spark = encoded.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(model_bytes(path or default_path()))

    def run(batches):
        own = codec(model.value)
        for batch in batches:
            texts = [own.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "id long, text string")


def bpe_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): both ways in one pass, without carrying ids between processes."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(model_bytes(path or default_path()))

    def run(batches):
        own, sha = codec(model.value), hashlib.sha256
        for batch in batches:
            ids = own.encode(_texts(batch.column(1)))
            columns = [
                batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha(x).hexdigest() for x in ids], pa.string()),
                pa.array([sha(own.decode(x).encode()).hexdigest() for x in ids], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
