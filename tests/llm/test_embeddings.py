import numpy as np
import pytest

from verdigris.llm import embeddings


def brute(x, ids, threshold=0.9):
    ok = np.array([v is not None and len(v) == 16 and all(c is not None and np.isfinite(c) for c in v) and any(v) for v in x])
    n, comp = {}, {}
    good = [(i, np.array(v, float) / np.linalg.norm(v)) for i, v, k in zip(ids, x, ok, strict=True) if k]
    m = np.stack([g[1] for g in good])
    link = m @ m.T >= threshold
    np.fill_diagonal(link, False)
    gid = [g[0] for g in good]
    for a in np.argsort(gid):
        if gid[a] in comp:
            continue
        seen, todo = {a}, [a]
        while todo:
            for b in np.nonzero(link[todo.pop()])[0]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        comp |= {gid[b]: gid[a] for b in seen}
    n = {i: int(c) for i, c in zip(gid, link.sum(axis=1), strict=True)}
    return {i: (n.get(i, 0), comp.get(i, i)) for i in ids}


@pytest.mark.parametrize("block", [8, 512])
def test_near_vectors(spark, block):
    rng = np.random.default_rng(0)
    x, ids = [], []
    for c in range(40):
        centre = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 30))):
            x.append((centre + rng.normal(size=16) * rng.choice([0.02, 0.3])).astype(np.float32).tolist())
            ids.append(len(ids))
    x += [x[0], x[0], None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0], [], [1e30] * 16, [1e-30] * 16]
    ids += list(range(len(ids), len(x)))
    frame = spark.createDataFrame([(i, v, "l", "k") for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, label string, key string").repartition(3)
    got = {r["id"]: (r["n_links"], r["component"]) for r in embeddings.near_vectors(frame, block=block).collect()}
    want = brute(x, ids)
    assert set(got) == set(want)
    links, found = sum(w[0] for w in want.values()), sum(g[0] for g in got.values())
    assert 0.9 * links <= found <= links
    assert sum(got[i][1] == want[i][1] for i in ids) >= 0.95 * len(ids)
    assert all(got[i] == (0, i) for i in ids[-9:-2])
    assert got[ids[-1]] == got[ids[-2]][:1] + (got[ids[-1]][1],) and got[ids[-1]][1] == got[ids[-2]][1]


def test_no_vectors(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.near_vectors(frame).count() == 0
    only_bad = spark.createDataFrame([(1, None), (2, [0.0]), (None, [1.0])], "vec_id long, embedding array<float>")
    assert {(r["id"], r["n_links"], r["component"]) for r in embeddings.near_vectors(only_bad).collect()} == {(1, 0, 1), (2, 0, 2), (None, 0, None)}


def test_repeated_rows(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0])]
    got = sorted((r["id"], r["n_links"], r["component"], r["kept"]) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]
