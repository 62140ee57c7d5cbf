import random
import re

import numpy as np
import pytest

from chronotile.llm import jaccard_join
from chronotile.operators import graph


def shingles(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = list(range(len(sets)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, (da, a) in enumerate(sets):
        for j in range(i):
            db, b = sets[j]
            if da is not None and db is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for k, (d, _) in enumerate(sets):
        if d is not None:
            least[find(k)] = min(least.get(find(k), d), d)
    return sorted(((d, len(s), least.get(find(k)) if d is not None else None) for k, (d, s) in enumerate(sets)), key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = [rng.choice(words) for _ in range(70)]
    rows, n = [], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randrange(5, 160))]
        for _ in range(rng.randrange(1, 12)):
            doc = list(base)
            for _ in range(rng.randrange(0, 1 + len(doc) // 25)):
                doc[rng.randrange(len(doc))] = rng.choice(words)
            if rng.random() < 0.3:
                doc = doc + passage
            if rng.random() < 0.3:
                doc = doc[: rng.randrange(1, len(doc) + 1)]
            rows.append((n, (" " if rng.random() < 0.5 else "\n").join(doc).upper() if rng.random() < 0.2 else " ".join(doc)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "one two"), (n + 4, "One\x0btwo"), (n + 5, "a b c d e"), (n + 6, "a b c d e f"), (n + 7, "a b"), (None, "one two"), (0, rows[0][1])]
    return rows


@pytest.mark.parametrize("members", [512, 3])
def test_matches_brute_force(make_docs, monkeypatch, members):
    monkeypatch.setattr(jaccard_join, "TREE_MEMBERS", members)
    rows = corpus()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(make_docs(*rows)).collect()), key=str)
    assert got == brute(rows)


def test_tree_finds_every_link(monkeypatch):
    rng = np.random.default_rng(4)
    base = [rng.integers(0, 1 << 40, 60) for _ in range(6)]
    sets = [np.unique(np.where(rng.random(60) < 0.06, rng.integers(0, 1 << 40, 60), base[k % 6])[: rng.integers(40, 61)]) for k in range(80)]
    links = jaccard_join.tree_links(np.arange(80), np.arange(80), np.array([len(x) for x in sets]), sets)
    pairs = [(a, b) for a in range(80) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))]

    def groups(edges):
        label = list(range(80))
        for _ in range(80):
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        return label

    assert groups(links) == groups(pairs) and len(links) <= 79 and all((max(x), min(x)) in set(pairs) for x in links)


def test_components(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, 100), (200, 201), (201, 200), (300, 200)] + [(1000, 2000 + k) for k in range(300)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {k: 0 for k in range(51)} | {200: 200, 201: 200, 300: 200, 1000: 1000} | {2000 + k: 1000 for k in range(300)}
    assert got == want


def test_empty(make_docs):
    assert jaccard_join.jaccard_components(make_docs().limit(0)).count() == 0


def test_one_of_each_with_repeated_ids(make_docs):
    base = " ".join(f"w{k}" for k in range(60))
    near, other, far = base + " more", " ".join(f"v{k}" for k in range(40)), " ".join(f"u{k}" for k in range(30))
    rows = [(5, base), (5, near), (5, near), (7, near), (7, far), (9, far + " x"), (4, other), (4, far), (None, base), (None, None), (8, ""), (8, None), (8, " ")]
    docs = make_docs(*rows)
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    left = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(map(str, left)) == sorted(map(str, [x for x in left if x in rows])) and len(left) == 8
    assert sum(x in ((5, base), (5, near)) for x in left) == 1 and (4, other) in left and (4, far) in left
    assert sum(d in (7, 9) for d, _ in left) == 0 and sum(d == 8 for d, _ in left) == 3 and sum(d is None for d, _ in left) == 2
    assert jaccard_join.one_of_each(make_docs((None, None), (None, None), (1, None))).count() == 3


def test_one_of_each_matches_brute_force(make_docs):
    rows = [(d, t) for k, (d, t) in enumerate(corpus(3)) if d is not None][:-1]
    best = {}
    for (d, _, c), (e, t) in zip(sorted(brute(rows)), sorted(rows), strict=True):
        assert d == e
        if not shingles(t) or c == d:
            best[d] = t
    assert sorted((r.doc_id, str(r.text)) for r in jaccard_join.one_of_each(make_docs(*rows)).collect()) == sorted((d, str(t)) for d, t in best.items())


def test_very_long_texts_link(make_docs):
    long = " ".join(f"w{k * k % 9973}" for k in range(60_000))
    rows = [(3, long), (1, long + " and more"), (2, "short text of no more than a few words"), (4, long[: len(long) // 2])]
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(make_docs(*rows)).collect()}
    assert got == {d: c for d, _, c in brute(rows)} and got[3] == 1
