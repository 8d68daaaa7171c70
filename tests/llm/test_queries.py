"""Each opN_ query on small tables: columns and types of its contract, and rows against a plain count."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from tests.llm.helpers import docs, words
from verdigris.llm import bpe, embeddings, language, line_dedup, near_copies, simhash, suffix_dedup, toxicity
from verdigris.llm.registry import QUERIES

COLUMNS = {
    "op1_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op2_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op3_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op4_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "text": "string"},
    "op5_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op6_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op7_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op9_language_id": {"doc_id": "bigint", "lang": "string", "kept": "boolean"},
    "op10_embedding_dedup": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    frame = docs(spark)
    frame.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0), int(i % 3 == 0)) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, "http://a.com/en/x", "<p>"), (2, None, None)], "page_id long, url string, html string").write.parquet(f"{root}/pages.parquet")
    spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [1.0, 0.01], 1), (3, [0.0, 1.0], 0), (4, None, 0)], "vec_id long, embedding array<float>, label int").write.parquet(f"{root}/embeddings.parquet")
    return str(root), frame


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns(spark, tables, name):
    root, frame = tables
    out = QUERIES[name](spark, root)
    kinds = dict(out.dtypes)
    assert {c: kinds[c] for c in COLUMNS[name]} == COLUMNS[name]
    rows = out.collect()
    n = {"op1_url_filter": 2, "op10_embedding_dedup": 4}.get(name, frame.count())
    assert len(rows) >= n if name == "op8_best_fit_packing" else len(rows) == n


def test_simhash_components_of_each_row(spark):
    frame = docs(spark).where("doc_id IS NOT NULL")
    text = {}
    for r in frame.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        text.setdefault(r["doc_id"], []).append(simhash.text_fingerprint(" ".join(w).encode()))
    fps = sorted({f for v in text.values() for f in v})
    group = {f: f for f in fps}
    for a in fps:
        for b in fps:
            if bin(a ^ b).count("1") <= 2 and group[a] != group[b]:
                old, new = group[b], group[a]
                group = {f: new if g == old else g for f, g in group.items()}
    least = {}
    for i, found in text.items():
        for f in found:
            least[group[f]] = min(least.get(group[f], i), i)
    for r in simhash.near_duplicates(frame).collect():
        assert r["component"] == least[group[int(np.int64(r["fp"]).view(np.uint64))]]


def test_ftrl_against_a_plain_loop():
    rng = random.Random(7)
    slots, epochs, alpha, beta, l1, l2 = 50, 3, 0.5, 1.0, 0.3, 0.1
    rows = [(np.array(sorted(rng.sample(range(slots), rng.randint(0, 8))), np.int64), rng.randint(0, 1)) for _ in range(120)]
    z, n = [0.0] * (slots + 1), [0.0] * (slots + 1)

    def weight(i):
        if i == slots:
            return -z[i] / ((beta + math.sqrt(n[i])) / alpha)
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for at, label in rows:
            own = [*at.tolist(), slots]
            w = {i: weight(i) for i in own}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i in own:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    at, w, bias = toxicity.ftrl(rows, slots, epochs, alpha, beta, l1, l2)
    want = {i: weight(i) for i in range(slots) if weight(i)}
    assert at.tolist() == sorted(want) and np.allclose(w, [want[i] for i in at.tolist()]) and bias == pytest.approx(weight(slots))
    assert 0 < len(want) < slots


def test_language_posterior_by_hand(spark):
    rng = random.Random(9)
    stock = {"en": "the of and to in that is was".split(), "xx": "zug quor blim vasp torf nek".split()}
    rows = []
    for i in range(40):
        lang = "en" if i % 3 else "xx"
        rows.append((i, " ".join(rng.choice(stock[lang] + stock["en"][:2]) for _ in range(rng.randint(2, 6))), lang if i % 5 else None, f"h{i % 4}.{'com' if i % 4 < 2 else 'net'}"))
    rows.append((99, "", "en", "h0.com"))
    got = {r["id"]: r for r in language.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    langs = ["en", "xx"]
    counts = {lang: np.zeros(language.SLOTS) for lang in langs}
    for _, text, declared, _ in rows:
        if declared:
            np.add.at(counts[declared], language.trigrams(text), 1)
    table = {lang: np.log((c + language.SMOOTH) / (c.sum() + language.SMOOTH * language.SLOTS)) for lang, c in counts.items()}
    seen = []
    for i, text, declared, host in rows:
        at = language.trigrams(text)
        score = {lang: table[lang][at].sum() * (min(len(at), language.EVIDENCE) / max(1, len(at))) for lang in langs}
        seen.append((i, len(at), score, max(langs, key=lambda x: score[x]) if len(at) else None, declared, host, host.split(".")[-1]))
    for i, letters, score, own, declared, host, suffix in seen:
        rest = [s for s in seen if s[0] != i and s[3]]
        total = {x: sum(s[3] == x for s in rest) for x in langs}
        base = {x: (total[x] + 1) / (len(rest) + len(langs)) for x in langs}
        share = lambda k, v, x: sum(s[3] == x and s[k] == v for s in rest)
        parent = {x: (share(6, suffix, x) + language.SUFFIX_WEIGHT * base[x]) / (sum(share(6, suffix, y) for y in langs) + language.SUFFIX_WEIGHT) for x in langs}
        prior = {x: (share(5, host, x) + language.HOST_WEIGHT * parent[x]) / (sum(share(5, host, y) for y in langs) + language.HOST_WEIGHT) for x in langs}
        likely = lambda k, v, x: 1.0 if v is None else (share(k, v, x) + 1) / (total[x] + len({s[k] for s in seen if s[k]}) + 1)
        evidence = {x: likely(4, declared, x) * likely(6, suffix, x) for x in langs}
        mass = {x: math.exp(score[x]) * evidence[x] * prior[x] for x in langs}
        among = math.prod(sum(likely(k, v, x) * base[x] for x in langs) for k, v in ((4, declared), (6, suffix)))
        other = math.exp(-min(letters, language.EVIDENCE) * math.log(language.SLOTS)) * language.OTHER * among
        best = max(langs, key=lambda x: mass[x])
        assert got[i]["lang"] == best and got[i]["text_lang"] == own
        assert got[i]["posterior"] == pytest.approx(mass[best] / (sum(mass.values()) + other), abs=1e-4)


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for dim, n in ((8, 400), (3, 60), (2, 2), (5, 1)):
        x = rng.normal(size=(max(1, n // 4), dim)).repeat(4, axis=0)[:n] + 0.05 * rng.normal(size=(n, dim))
        ids = np.arange(len(rows), len(rows) + n)
        rows += [(int(i), v.astype(np.float32).tolist()) for i, v in zip(ids, x, strict=True)]
        u = x.astype(np.float32).astype(float)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        link = u @ u.T >= 0.9
        np.fill_diagonal(link, False)
        want |= {int(i): int(k) for i, k in zip(ids, link.sum(axis=1), strict=True)}
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    for block in (512, 64):
        got = {r["id"]: r["n_links"] for r in embeddings.near_vectors(frame, block=block).collect()}
        small = [i for i in got if len(rows[i][1]) < 8]
        assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.9 * sum(want.values())
        assert block < 100 or all(got[i] == want[i] for i in small)
    assert want[460] == 1 or want[461] == want[460]


def test_tied_links_connect_what_is_linked():
    rng = np.random.default_rng(5)
    for _ in range(50):
        links = rng.random((12, 9)) < 0.12
        a, b = np.arange(12) * 2, np.arange(9) * 2 + 1
        top, below = embeddings.tied(links, a, b)
        parent = {int(x): int(x) for x in [*a, *b]}
        for i, j in zip(*np.nonzero(links), strict=True):
            old, new = sorted((parent[int(a[i])], parent[int(b[j])]), reverse=True)
            parent = {k: new if v == old else v for k, v in parent.items()}
        assert {int(x): int(t) for t, x in zip(top, below, strict=True)} == {k: v for k, v in parent.items() if k != v}


def test_bitmaps_never_drop_a_link():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.sort(rng.integers(-(1 << 62), 1 << 62, n))
        b = a.copy()
        change = rng.random(n) < rng.random() * 0.3
        b[change] = rng.integers(-(1 << 62), 1 << 62, int(change.sum()))
        b = np.unique(np.concatenate((b, rng.integers(-(1 << 62), 1 << 62, int(rng.integers(0, 40))))))
        a = np.unique(a)
        bits = np.array([near_copies.bitmap(a), near_copies.bitmap(b), None], object)[:2]
        both = len(np.intersect1d(a, b))
        if both >= 0.8 * (len(a) + len(b) - both):
            assert near_copies.possible(np.array([len(a), len(b)]), bits, np.array([0]), np.array([1]), 0.8).all()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_long_pre_tokens_match_the_library(name):
    from tokenizers import Tokenizer

    from verdigris.llm import packing

    path = bpe.default_path(name)
    own = (bpe.Codec if name.startswith("byte") else packing.Words)(bpe.model_bytes(path))
    library = Tokenizer.from_file(path)
    rng = random.Random(2)
    for stock in ("etaoinshrdlu", "ab", "a", "abcdefghijklmnopqrstuvwxyz"):
        for n in (255, 256, 257, 700, 6000):
            text = "".join(rng.choice(stock) for _ in range(n))
            assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_remembered_texts_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_BYTES", 2000)
    kept = bpe.Remembered()
    for at in range(0, 400, 20):
        wanted = {f"w{i}" for i in range(at, at + 20)} | {"w0"}
        kept.add({t: t.encode() for t in kept.missing(wanted)})
        assert all(kept.young[t] == t.encode() for t in wanted)
        kept.trim()
        assert len(kept.young) + len(kept.old) <= 2 * (2000 // bpe.ENTRY_BYTES + 22)


CLASHES = ("vg_id", "vg_hash", "vgid", "vghash", "_host", "_lines", "_kept", "_n", "vg_text", "vg_spans")


def clashing(spark, n=30):
    from pyspark.sql import functions as F

    rng = random.Random(11)
    passage = words(rng, 60)
    rows = [(i, words(rng, 50) + (" " + passage if i % 2 else "") + "\nmenu", "en", "src0") for i in range(n)] + [(3, "again", "en", "src0")] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(f"own {c}") for c in CLASHES})


def test_clashing_names(spark):
    frame = clashing(spark)
    out = line_dedup.line_dedup(frame).collect()
    assert len(out) == frame.count() and all(r[c] == f"own {c}" for r in out for c in CLASHES) and sum(r["n_dropped"] for r in out) == 30
    cut = suffix_dedup.remove_repeats(frame, prefix="cut_").collect()
    assert len(cut) == frame.count() and all(r[c] == f"own {c}" for r in cut for c in CLASHES) and sum(r["cut_n_removed"] > 0 for r in cut) == 14
    got = suffix_dedup.remove_repeats(frame).collect()
    assert sorted(r["vg_n_removed"] for r in got) == sorted(r["cut_n_removed"] for r in cut)


def test_pipeline_with_clashing_names(spark):
    import corpus_pipeline

    seen = clashing(spark)
    columns = seen.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, "").persist()
        assert seen.columns == columns, name
        assert all(r[c] == f"own {c}" for r in seen.collect() for c in CLASHES)
    left = seen.collect()
    assert len([r for r in left if r["doc_id"] == 3 and r["text"] == "again"]) == 1
    assert corpus_pipeline.STAGES[-1][1](spark, seen, "").count() == len(left)


def test_exact_dedup_digest_is_of_the_text(spark, tables):
    root, frame = tables
    got = {(r["doc_id"], r["text_sha256"]) for r in QUERIES["op2_exact_dedup"](spark, root).collect()}
    squeeze = re.compile(r"[\x20\x09-\x0d]+")
    assert got == {(r["doc_id"], hashlib.sha256(squeeze.sub(" ", r["text"] or "").encode()).hexdigest()) for r in frame.collect()}
