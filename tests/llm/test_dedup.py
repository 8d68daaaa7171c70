import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import docs, empty, texts
from verdigris.llm import exact_dedup, line_dedup, simhash, suffix_dedup
from verdigris.llm.common import components

SPACES = re.compile(r"[\x20\x09-\x0d]+")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_components(spark):
    import random

    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(200, 260)] + [(rng.randint(300, 380), rng.randint(300, 380)) for _ in range(60)] + [(5, 5), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = dict(rows(components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.substring(exact_dedup.sha256(c), 1, 1)])
def test_exact_dedup(spark, tmp_path, digest):
    frame = docs(spark)
    path = str(tmp_path / "d")
    frame.write.parquet(path)
    frame = spark.read.parquet(path)
    group = defaultdict(list)
    for r in frame.collect():
        group[SPACES.sub(" ", r["text"] or "")].append(r["doc_id"])
    got = exact_dedup.exact_dedup(frame, digest=digest, files_per_batch=1).collect()
    want = sorted(((i, min((x for x in g if x is not None), default=None), len(g)) for g in group.values() for i in g), key=str)
    assert sorted(((r["id"], r["keep_id"], r["group_size"]) for r in got), key=str) == want
    assert all(r["kept"] == (r["id"] == r["keep_id"]) for r in got)


def test_exact_dedup_empty(spark):
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def brute_fingerprint(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for t in texts():
        assert simhash.text_fingerprint(None if t is None else t.encode()) == brute_fingerprint(t)


def test_golay_indices_meet_within_two_errors():
    rng = np.random.default_rng(0)
    table, count = simhash.error_patterns()
    assert sorted(set(count.tolist())) == [1, 6]
    for _ in range(300):
        x = int(rng.integers(1 << 23))
        y = x
        for b in rng.choice(23, size=int(rng.integers(0, 3)), replace=False):
            y ^= 1 << int(b)
        keys = [set(simhash.golay_indices(np.array([v]))[1].tolist()) for v in (x, y)]
        assert keys[0] & keys[1]


def brute_components(fps):
    """fps: id -> fingerprint. Smallest id reachable by links of at most two bits."""
    left, out = dict(fps), {}
    for i in sorted(fps):
        if i in out:
            continue
        todo, seen = [i], {i}
        while todo:
            a = todo.pop()
            for b in left:
                if b not in seen and bin(fps[a] ^ fps[b]).count("1") <= 2:
                    seen.add(b)
                    todo.append(b)
        out |= {b: i for b in seen}
    return out


@pytest.mark.parametrize("bucket", [16, 1])
def test_simhash_links(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(bucket)
    fps = {}
    for c in range(30):
        base = int(rng.integers(1 << 63))
        for k in range(int(rng.integers(1, 40))):
            flip = sum(1 << int(b) for b in rng.choice(64, size=int(rng.integers(0, 4)), replace=False))
            fps[c * 100 + k] = base ^ flip
    signed = [(i, int(np.uint64(v).astype(np.int64))) for i, v in fps.items()]
    reps = spark.createDataFrame(signed, "id long, fp long").groupBy("fp").agg(F.min("id").alias("rep"))
    found = dict(rows(components(simhash.links(reps))))
    rep_of = dict(rows(reps))
    got = {i: found.get(rep_of[v], rep_of[v]) for i, v in signed}
    assert got == brute_components(fps)


def test_near_duplicates(spark):
    frame = docs(spark)
    got = simhash.near_duplicates(frame).collect()
    assert len(got) == frame.count()
    fps = {}
    for r in frame.collect():
        fps.setdefault(brute_fingerprint(r["text"]), []).append(r["doc_id"])
    for r in got:
        assert np.int64(r["fp"]).view(np.uint64) in fps
    zero = [r["component"] for r in got if r["fp"] == 0]
    assert len(set(zero)) == 1 and len(zero) >= 4
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_rows_without_an_id_link(spark, monkeypatch):
    fps = {"a": 0b0, "b": 0b11, "c": 0b1111, "d": 0xFFFF << 40}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *_: docs)
    frame = spark.createDataFrame([(7, 1, fps["a"]), (None, 2, fps["b"]), (9, 3, fps["c"]), (None, 4, fps["d"])], "id long, text_hash long, fp long")
    assert {r["text_hash"]: r["component"] for r in simhash.near_duplicates(frame).collect()} == {1: 7, 2: 7, 3: 7, 4: None}


def test_line_dedup(spark):
    data = [(i, f"menu\nbody {i}\n\n  menu  \nlast {i % 2}", "a", None) for i in range(30)] + [(100, None, "a", None), (101, "", "a", None), (102, "menu\nx", "b", None), (103, "menu\ny", None, None)]
    frame = spark.createDataFrame(data, "doc_id long, text string, source string, lines string")
    out = {r["doc_id"]: r for r in line_dedup.line_dedup(frame).collect()}
    assert len(out) == len(data) and set(out[0].asDict()) == {"doc_id", "text", "source", "lines", "n_lines", "n_dropped"}
    assert out[0]["text"] == "body 0\n" and out[0]["n_dropped"] == 3 and out[0]["n_lines"] == 5
    assert out[100]["text"] is None and out[100]["n_lines"] == 0 and out[101]["text"] == "" and out[102]["text"] == "menu\nx" and out[103]["text"] == "menu\ny"
    assert line_dedup.line_dedup(frame.limit(0)).count() == 0


def brute_removed(found):
    """found: (order key, bytes) in order. Removed positions by the contract."""
    seen, out = set(), {}
    for key, b in found:
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        out[key] = gone
    return out


@pytest.mark.parametrize("limits", [{}, {"collection": 500, "hot_bytes": 400}])
def test_suffix_dedup(spark, limits):
    frame = docs(spark).where("doc_id IS NOT NULL").where("NOT (doc_id = 3 AND text LIKE 'same id%')").distinct()
    want = brute_removed([(r["doc_id"], (r["text"] or "").encode()) for r in sorted(frame.collect(), key=lambda r: r["doc_id"])])
    assert sum(map(sum, want.values())) > 1000
    text = {r["doc_id"]: (r["text"] or "").encode() for r in frame.collect()}
    for r in suffix_dedup.remove_repeats(frame, **limits).collect():
        gone, b = want[r["doc_id"]], text[r["doc_id"]]
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        assert (r["vg_n_bytes"], r["vg_n_removed"], r["vg_n_spans"], r["vg_kept_sha256"]) == (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())


def test_suffix_dedup_hard_rows(spark):
    frame = docs(spark)
    got = suffix_dedup.remove_repeats(frame).collect()
    assert len(got) == frame.count()
    first = [r for r in got if r["doc_id"] == 0]
    assert len(first) == 2 and {r["vg_n_removed"] for r in first} == {0}  # a repeated row is the same document
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_suffix_dedup_collections_without_repeats(spark):
    """Contexts that agree beside their anchor and yet share no 100 bytes make a collection without a repeated window."""
    import random

    rng = random.Random(11)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    rows = []
    for i in range(40):
        shared = letters(95)
        rows += [(10 * i + k, letters(150) + "01"[k] + shared + "23"[k] + letters(150)) for k in range(2)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 80 and {r["vg_n_removed"] for r in got} == {0}
    none = np.zeros(0, np.int64)
    assert [len(x) for x in suffix_dedup.spans_of(none, none, np.zeros(2, np.int64))] == [0, 0, 0]


def test_merged_transforms_sort_suffixes(monkeypatch):
    import random

    rng = random.Random(5)
    parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(9)]
    shards = [suffix_dedup.shard_transform(parts[i : i + 3]) for i in (0, 3, 6)]
    order, interval = suffix_dedup.merge_transforms([s[0] for s in shards])
    number = np.concatenate([s[1] + 3 * i for i, s in enumerate(shards)])[order]
    place = np.concatenate([s[2] for s in shards])[order]
    suffixes = [parts[n][p:] for n, p in zip(number, place, strict=True)]
    assert suffixes == sorted(suffixes)
    for a, b, x, y in zip(suffixes, suffixes[1:], interval, interval[1:], strict=False):
        assert (x == y) == (a == b)
