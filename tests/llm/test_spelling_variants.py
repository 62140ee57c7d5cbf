import random
import re
import zlib
from collections import Counter

import pytest

from chronotile.llm import spelling_variants as sv

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def distance_is_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, longer = sorted((a, b), key=len)
    return any(longer[:k] + longer[k + 1 :] == short for k in range(len(longer)))


def counts(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 2}


def brute(rows):
    """Every word against every other."""
    n, form, near = counts(rows), {}, {}
    for w in n:
        near[w] = [x for x in n if distance_is_one(w, x)]
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def grouped(docs):
    found = sv.variant_groups(docs)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, found.collect()))


def corpus():
    rng, rows = random.Random(9), []
    base = ["".join(rng.choices("aeinrstéÿ", k=rng.randrange(7, 12))) for _ in range(30)]
    pool = []
    for w in base:
        pool += [w] * 150
        for _ in range(6):
            k = rng.randrange(len(w))
            pool += [rng.choice([w[:k] + w[k + 1 :], w[:k] + "x" + w[k:], w[:k] + "é" + w[k + 1 :]])] * rng.choice([2, 3, 14])
        pool += [w[:-1] + "zz"] * 2
    pool += ["chained"] * 400 + ["chaineda"] * 36 + ["chainedab"] * 3
    rng.shuffle(pool)
    for k in range(0, len(pool), 15):
        rows.append((k // 15, " ".join(x.upper() if rng.random() < 0.1 else x for x in pool[k : k + 15]) + rng.choice([".", "日本語", "1st", ""])))
    return rows + [(None, rows[0][1]), (None, None), (3, None), (4, ""), *rows[:5]]


@pytest.mark.parametrize("most", [1000, 4])
def test_matches_brute_force(make_docs, monkeypatch, most):
    monkeypatch.setattr(sv, "BLOCK", most)
    monkeypatch.setattr(sv.near_pairs, "__defaults__", (most,))
    rows = corpus()
    want = brute(rows)
    assert sum(r[1] is not None for r in want) > 20 and any(r[2] not in (r[0], r[1]) for r in want)
    assert grouped(make_docs(*rows)) == want


def test_blocks_are_dealt_again(spark):
    """Words that share one half by the hundred: blocks end up small, and no pair is lost."""
    rng = random.Random(5)
    words = sorted({"common" + "".join(rng.choices("abc", k=rng.choice([6, 7]))) for _ in range(700)} | {"aaaaaaa", "aaaaaaaa", "aaaaaaaaa"})
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    sizes = [r["count"] for r in sv.blocks(df.selectExpr("*", "char_length(word) AS size"), 20).where("high - low > 1").groupBy("key").count().collect()]
    assert max(sizes) <= 20
    want = sorted((a, b) for i, a in enumerate(words) for b in words[i + 1 :] if distance_is_one(a, b))
    for most in (20, 10_000):
        assert sorted((r.a, r.b) for r in sv.near_pairs(df, most).collect()) == want


@pytest.mark.parametrize("window", [(0, 3), (3, 7), (3, 4), (0, 7)])
def test_index_of_a_block(window):
    low, high = window
    rng = random.Random(6)
    inside = {"".join(rng.choices("ab", k=high - low + extra)) for extra in (0, 1) for _ in range(60)}
    words = ["xyzxyzx"[:low] + w + "xyzxyzx"[high:] for w in sorted(inside)]
    found = sorted(tuple(sorted((words[j], words[k]))) for j, k in sv.near_in_block(words, 7, low, high))
    want = sorted(tuple(sorted((a, b))) for i, a in enumerate(words) for b in words[i + 1 :] if distance_is_one(a, b) and min(len(a), len(b)) == 7)
    assert found == want


def test_ties_long_words_and_empty_table(make_docs):
    rows = [(k, "striped strides stripes " * 30 + "stripez") for k in range(2, 6)] + [(k, "é" * 5000 + " " + "é" * 5001) for k in range(7, 60)]
    assert grouped(make_docs(*rows)) == brute(rows)
    assert grouped(make_docs().limit(0)) == []


def test_long_texts_are_split_in_blocks(monkeypatch):
    text = "Größere Maße, größere Straßen; naïveté " * 300
    whole = sv._runs(text)
    monkeypatch.setattr(sv, "PASS_BYTES", 50)
    assert sv._runs(text) == whole and whole["größere".encode("latin-1")] == 600
