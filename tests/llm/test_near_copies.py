import random

import corpus_pipeline
import pytest

from tests.llm.helpers import DOCS, docs, empty, words
from verdigris.llm import near_copies


def edited(rng, text, n):
    w = text.split()
    for k in rng.sample(range(len(w)), n):
        w[k] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def brute(rows):
    """(id, text) -> set of the ids reachable over pairs of similarity 0.8 or more."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
    return sorted(((i, least[g]) for (i, _), g in zip(rows, group, strict=True)), key=str)


@pytest.mark.parametrize("limits", [{}, {"LIST": 3}, {"LIST": 1, "BLOCK": 700, "COLUMNS": 7, "PART": 100, "FREQUENT": 10**9}])
def test_near_copies_against_all_pairs(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(near_copies, k, v)
    rng = random.Random(3)
    rows = [(r["doc_id"], r["text"]) for r in docs(spark).collect()]
    for c in range(8):
        base = words(rng, rng.choice([6, 40, 100, 200]))
        rows += [(1000 + 100 * c + k if k != 2 else None, edited(rng, base, rng.randint(0, max(1, len(base.split()) // 22)))) for k in range(9)]
    got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = brute(rows)
    assert sorted(((r["id"], r["component"]) for r in got), key=str) == want
    assert sum(a != b for a, b in want) > 30
    assert near_copies.near_copies(empty(spark)).count() == 0


def test_pipeline_drops_near_copies(spark):
    rng = random.Random(4)
    rows = []
    for c in range(20):
        base = words(rng, 250)
        rows += [(10 * c + k, t, "en", "s", 1, "x", 1, "y", 0.5, "z") for k, t in enumerate((base, edited(rng, base, 4)))]
    left = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, DOCS), "")
    assert sorted(r["doc_id"] for r in left.collect()) == [10 * c for c in range(20)]


def test_near_copies_come_from_fingerprints_first(spark, monkeypatch):
    """SimHash names pairs, whole sets decide on them, and the prefix filter adds only links between their groups."""
    rng = random.Random(5)
    rows = []
    for c in range(15):
        base = words(rng, 400)
        rows += [(10 * c + k, t) for k, t in enumerate((base, base + " tail", edited(rng, base, 12)))]
    named, linked = [], []
    links, components = near_copies.simhash.links, near_copies.components
    monkeypatch.setattr(near_copies.simhash, "links", lambda reps, *a: named.append(reps.count()) or links(reps, *a))
    monkeypatch.setattr(near_copies, "components", lambda edges: linked.append(edges.count()) or components(edges))
    got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["id"], r["component"]) for r in got), key=str) == brute(rows)
    assert len(named) == 1 and named[0] > 15
    assert len(linked) == 2 and 10 <= linked[0] < linked[1]
