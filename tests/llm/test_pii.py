import collections
import hashlib
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from chronotile.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if k % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end(), m[0]) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


def random_texts():
    rng = random.Random(5)
    bits = ["a@b.c", "_d@e.f", "x.y%z@h-1.co.uk", "@", ".", "1.2.3.4", "255.256.1.1", "000.1.2.003", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "5", " ", "-", "+", "+49 (30) 1234-567", "+1.", "é", "🙂", "99", "Ab", "\n", "12 34", "..", "+4", "1234567890123456789"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(600)]


LONG = ["7 " * 30000, "8" * 60000, "a" * 5000, "a." * 3000, "1." * 20000, "+1" + "2-" * 30000, "x@" + "y." * 30000 + "z"]


def test_base_spans_match_the_plain_patterns(spark):
    texts = [*random_texts(), *LONG, "", "call +49 30 1234567 or mail me@x.org, 10.0.0.1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for r in df.select("doc_id", pii.base_spans(F.col("text")).alias("s")).collect():
        assert [tuple(x) for x in r.s] == brute(texts[r.doc_id]), texts[r.doc_id][:200]


def test_disclosing_terms(make_docs):
    filler = [(100 + k, f"nothing personal here about harbour lights number{k} and common words") for k in range(60)]
    rows = [(k, f"Please write the common words to Zebulonia who answers at zeb@x{0}.org on common days, page {k}") for k in range(4)]
    docs = make_docs(*rows, *filler, (500, None), (500, None), (501, ""), (None, "mail q@r.st now"))
    out = {r.doc_id: r for r in pii.find_spans(docs).collect()}
    for k, text in rows:
        assert {text[t.start : t.end].lower() for t in out[k].terms} >= {"zebulonia"}
        assert "common" not in {t.value for t in out[k].terms}
    assert all(not out[k].terms and not out[k].base for k, _ in filler)
    assert len(pii.find_spans(docs).collect()) == 68
    clean = {r.doc_id: r.text for r in pii.sanitise(make_docs(*rows, *filler)).collect()}
    assert "[EMAIL]" in clean[0] and "Zebulonia" not in clean[0] and "zeb@" not in clean[0] and clean[100] == filler[0][1]


def test_digests(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = pii.span_digests(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        line = ",".join(f"{k}:{a}:{b}" for k, a, b, _ in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest() and r.spans.startswith(line)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in want) for k in PLAIN]


def test_empty(make_docs):
    assert pii.span_digests(make_docs().limit(0)).count() == 0


def test_terms_of_whole_documents(make_docs):
    filler = [(100 + k, f"common words of a harbour number{k}") for k in range(60)]
    far = "common words " * 40
    rows = [(k, f"Bo Zebulonia {far} mail zeb@x.org and common Zebulonia é Bo") for k in range(4)]
    docs = make_docs(*rows, *filler, (None, "Ask zebulonia or Bo, 🙂 zebulonia"), (None, "common words"))
    for r in pii.find_spans(docs).collect():
        text = dict(rows).get(r.doc_id, "")
        if text:
            want = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]+", text) if m[0].lower() in ("bo", "zebulonia")]
            assert [(t.start, t.end, t.value) for t in r.terms if t.value in ("bo", "zebulonia")] == want
            assert not {t.value for t in r.terms} & {"common", "words", "zeb", "org"}
    clean = [r.text for r in pii.sanitise(docs).collect()]
    assert len(clean) == 66 and "Ask [TERM] or [TERM], 🙂 [TERM]" in clean
    assert all("Bo" not in x and "ebulonia" not in x for x in clean)


def plain_terms(rows):
    """All term spans by plain counting over whole documents."""
    total, words, values = len(rows), [], []
    for _, text in rows:
        base = brute(text)
        bare = text or ""
        for _, a, b, _ in (x for x in base if x[0] == "email"):
            bare = bare[:a] + " " * (b - a) + bare[b:]
        words.append([(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", bare)])
        values.append({f"{k}:{v.lower()}" for k, _, _, v in base})
    df_term = collections.Counter(t for w in words for t in {x[0] for x in w})
    df_value = collections.Counter(v for x in values for v in x)
    both = collections.Counter((t, v) for w, x in zip(words, values, strict=True) for t in {y[0] for y in w} for v in x)
    telling = set()
    for (t, v), n in both.items():
        if n >= 3 and df_value[v] < total and math.log2(total * n / (df_term[t] * df_value[v])) >= 0.9 * math.log2(total / df_value[v]):
            telling.add(t)
    return sorted((str(d), [(a, b) for t, a, b in w if t in telling]) for (d, _), w in zip(rows, words, strict=True))


@pytest.mark.parametrize("broadcast", [True, False])
def test_terms_match_plain_counting(make_docs, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(pii, "BROADCAST_TERMS", 0)
    rng = random.Random(11)
    people = [(f"name{chr(97 + k)}{chr(97 + k)}", f"p{k}@mail{k}.org" if k % 2 else f"10.0.{k}.7") for k in range(12)]
    common = ["alpha", "Beta", "gamma", "delta", "Épsilon"]
    rows = []
    for k in range(240):
        name, value = people[rng.randrange(12)]
        text = " ".join(rng.choice(common) for _ in range(rng.randrange(1, 30)))
        if rng.random() < 0.7:
            text += f" {name.title() if rng.random() < 0.3 else name}" * (rng.random() < 0.8) + f" {value}"
        rows.append((k, text))
    rows += [rows[3], rows[3], (None, rows[4][1]), (900, None), (901, "")]
    got = sorted((str(r.doc_id), [(t.start, t.end) for t in r.terms]) for r in pii.find_spans(make_docs(*rows)).collect())
    want = plain_terms(rows)
    assert got == want and sum(len(x) for _, x in want) > 20


def test_clashing_columns_and_repeated_rows_stay(make_docs):
    docs = make_docs((1, "a@b.cd"), (1, "a@b.cd"), (None, "x"), (None, None)).withColumns({c: F.lit(c) for c in ("key", "base", "terms", "spans", "doc", "some")})
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns and sorted(str(r.text) for r in clean.collect()) == ["None", "[EMAIL]", "[EMAIL]", "x"]
    assert pii.find_spans(docs).count() == 4


def test_many_matches_in_one_text(spark):
    text = "1.2.3.4 " * 60000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = df.select(pii.base_spans(F.col("text")).alias("s")).select(F.size("s").alias("n"), F.element_at("s", -1).alias("z")).first()
    assert spans.n == 60000 and (spans.z.start, spans.z.end) == (8 * 59999, 8 * 59999 + 7)


def test_lists_that_documents_share_do_not_meet_word_by_value(spark):
    """Three like documents of many words and many addresses: by pairs this would be 9 million rows for each of them."""
    word = lambda n: "".join(chr(97 + n // 26**k % 26) for k in range(4))
    shared = " ".join(f"w{word(k)}" for k in range(3000)) + " " + " ".join(f"u{k}@mail{k}.org" for k in range(3000))
    rows = [(k, f"{shared} tail{word(k)}") for k in range(3)] + [(10 + k, "plain words of others") for k in range(20)]
    start = time.perf_counter()
    out = {r.doc_id: r for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.perf_counter() - start < 90
    assert all(len({t.value for t in out[k].terms}) == 3000 and len(out[k].base) == 3000 for k in range(3)) and not out[10].terms
