import re

import pytest

from chronotile.llm import mixing


def brute_targets(sizes):
    """Water filling by repeated resharing; sizes: source -> words."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, target, active = 1.5 * sum(sizes.values()), {}, set(order)
    while active:
        share = left / sum(weight[s] for s in active)
        over = {s for s in active if share * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: share * weight[s] for s in active}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        active -= over
    return target


def check(rows, texts):
    sizes, largest = {}, {}
    for _, t, s in texts:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes[s] = sizes.get(s, 0) + n
        largest[s] = max(largest.get(s, 0), n)
    want = brute_targets(sizes)
    taken = {}
    assert len(rows) == len(texts)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], abs=1e-6)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6


def test_small(make_docs):
    texts = [(k, "w " * (k * 7 % 23), f"s{k % 4}" if k % 9 else None) for k in range(700)] + [(9000, None, "s1"), (9001, "", "zzz"), (None, "one two", "s2"), (3, "w w", "s2")]
    docs = make_docs(*texts)
    rows = mixing.mix(docs).collect()
    check(rows, texts)
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_expectation_is_kept(make_docs):
    docs = make_docs(*[(k, "w " * (1 + k % 5), "abc"[k % 3]) for k in range(40)])
    total = {}
    for seed in range(4):
        for r in mixing.mix(docs, seed).collect():
            total.setdefault(r.doc_id, []).append(r.copies)
            rate = r.target / r.source_size
            assert int(rate) <= r.copies <= int(rate) + 1
    assert any(len(set(v)) > 1 for v in total.values())


def test_driver_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(mixing.mix(docs).collect(), [(r.doc_id, r.text, r.source) for r in docs.collect()])


def test_mixed_docs_and_empty(make_docs):
    texts = [(k, "w w w", f"s{k % 3}") for k in range(60)]
    docs = make_docs(*texts)
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    mixed = mixing.mixed_docs(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(copies.values())
    assert mixing.mix(make_docs().limit(0)).count() == 0
    assert {r.taken for r in mixing.mix(make_docs((1, ""), (2, None))).collect()} == {0}


def test_mixed_docs_of_repeated_and_null_ids(make_docs):
    texts = [(None if k % 3 == 0 else k % 4, "w " * (1 + k % 5), f"s{k % 3}") for k in range(90)]
    docs = make_docs(*texts)
    taken, want = {}, {}
    for r in mixing.mixed_docs(docs).collect():
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    for r in mixing.mix(docs).collect():
        want[r.source] = want.get(r.source, 0) + r.taken
    assert taken == want


def test_hot_rows_without_an_id_are_split(make_docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 8)
    texts = [(None, "w w w", "s0") for _ in range(400)] + [(k, "w " * (k % 6), f"s{k % 3}") for k in range(60)] + [(900, "long " * 20000, "s1")]
    docs = make_docs(*texts)
    check(mixing.mix(docs).collect(), texts)
    clash = docs.withColumns({c: mixing.F.lit("x") for c in ("copies", "_copy", "row", "doc", "at", "taken")})
    assert mixing.mixed_docs(clash).columns == clash.columns
