import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from chronotile.llm import source_divergence as sd

SCHEMA = "doc_id long, text string, lang string, source string, term string, n string, value string, rank string, item string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    """All pairs of sources and all terms one by one, in Python's whole numbers."""
    docs = [(text or "", lang or "", source or "") for _, text, lang, source in rows]
    seen, count = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER))
        seen[lang].update(set(terms))
        count[lang, source].update(terms)
    out = []
    for lang in {d[1] for d in docs}:
        kept = [t for t, n in seen[lang].items() if n >= sd.LEAST_DOCS]
        sources = sorted({d[2] for d in docs if d[1] == lang})

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + (10**9 * (c[t] + 2)) // (total + 2 * len(kept)) for t in kept}

        p = {s: shares(count[lang, s]) for s in sources}
        q = shares(sum((count[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 10)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


def audited(spark, rows):
    frame = spark.createDataFrame([(*r, *["clash"] * 5) for r in rows], SCHEMA)
    found = sd.audit_sources(frame)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, found.collect()))


def corpus():
    rng, rows = random.Random(4), []
    words = [f"{a}{b}" for a in ("ab", "Cd", "é", "ÉX", "zz") for b in ("q", "Qr", "日", "x", "yy", "o", "p", "k")]
    for k in range(240):
        lang, source = rng.choice(["en", "fr", None]), rng.choice(["a", "b", "b", "b", "Ä", None])
        rows.append((k, " 1".join(rng.choices(words, [1 / (j + 1) for j in range(len(words))], k=rng.randrange(0, 30))), lang, source))
    rows += [(1, None, "en", "silent"), (1, "", "xx", "a"), (2, "only here", "xx", "b"), (None, None, None, None)]
    return rows + rows[:20]


@pytest.mark.parametrize("rows_at_once", [200_000, 7])
def test_matches_brute_force(spark, monkeypatch, rows_at_once):
    monkeypatch.setattr(sd, "TALLY_ROWS", rows_at_once)
    monkeypatch.setattr(sd, "HELD", 50 if rows_at_once == 7 else 300_000)
    rows = corpus()
    assert audited(spark, rows) == brute(rows)


def test_ties_silent_groups_and_empty_table(spark):
    rows = [(k, "b a", "en", s) for k in range(10) for s in "xyz"]
    assert audited(spark, rows) == brute(rows)
    assert audited(spark, [(1, "too rare", "en", "a"), (2, None, "en", None)]) == [("en", "", "pair", "a", 0, 1), ("en", "a", "pair", "", 0, 1)]
    assert audited(spark, []) == []


def test_long_texts_are_counted_in_blocks(monkeypatch):
    text = "Straße und\x00Weg, B2B " * 500
    whole = sd.term_counts(text)
    monkeypatch.setattr(sd, "PASS_BYTES", 64)
    assert sd.term_counts(text) == whole == Counter({"straße".encode(): 500, b"und": 500, b"weg": 500, b"b": 1000})
    assert sd.term_counts("x" * 500) == Counter({b"x" * 500: 1})


def test_joint_counts_hold_every_term_once(spark):
    rows = corpus()
    kept, groups = sd.kept_counts(spark.createDataFrame([(*r, *["clash"] * 5) for r in rows], SCHEMA))
    terms = {r.gid: r.n_terms for r in groups.collect()}
    joint = sd.joint_counts(kept, groups)
    assert joint.where("terms <= 0").count() == 0
    assert all(r.t == terms[r.a] == terms[r.b] for r in joint.groupBy("a", "b").agg(F.sum("terms").alias("t")).collect())


def test_shares_of_huge_counts(spark):
    df = spark.createDataFrame([(9 * 10**18, 9 * 10**18, 5), (0, 10**15, 10**6)], "c long, n long, v long")
    got = [r[0] for r in df.select(sd.share("c", "n", "v")).collect()]
    assert got == [1 + (10**9 * (c + 2)) // (n + 2 * v) for c, n, v in ((9 * 10**18, 9 * 10**18, 5), (0, 10**15, 10**6))]
