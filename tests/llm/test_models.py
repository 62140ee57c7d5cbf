import itertools
import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from chronotile.llm import language_id, toxicity


def fold(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and all(r.held_out == fold(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def test_language_never_reads_held_out_labels(make_docs):
    docs = make_docs(*[(k, "the quick brown fox" if k % 2 else "der schnelle braune fuchs über") for k in range(80)], (None, "fox"), (900, None), (901, "12 34"), (901, "12 34"))
    docs = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, "xx").when(F.col("doc_id") % 2 == 1, "en").otherwise("de"))
    rows = language_id.identify_languages(docs).collect()
    assert len(rows) == 84 and "xx" not in {r.lang_pred for r in rows}
    assert {(r.lang_pred, r.score) for r in rows if r.doc_id in (900, 901)} == {("und", 0.0)}
    assert all(r.lang_pred == ("en" if r.doc_id % 2 else "de") for r in rows if r.doc_id is not None and r.doc_id < 80)
    assert language_id.identify_languages(make_docs().limit(0)).count() == 0


def test_training_follows_the_plain_leader():
    """Weights against follow-the-regularised-leader written out with dictionaries, one weight at a time."""
    texts = ["the cat sat", "der Hund lief", "a dog ran", "die Katze saß", "the end", "das Ende"] * 4
    langs = ["en", "de", "en", "de", "en", "de"] * 4
    grams = list(language_id.ngrams(texts))
    idf = 1 + np.arange(language_id.FEATURES) % 5 / 10
    model = language_id.fit(grams, langs, idf)
    z, n = {}, {}

    def weight(j, c):
        zj, nj = z.get((j, c), 0.0), n.get((j, c), 0.0)
        if abs(zj) <= language_id.L1:
            return 0.0
        return -(zj - math.copysign(language_id.L1, zj)) / ((language_id.BETA + math.sqrt(nj)) / language_id.ALPHA + language_id.L2)

    for _ in range(language_id.EPOCHS):
        for k in np.random.default_rng(7).permutation(len(grams)).tolist():
            found, counts = grams[k]
            x = {j: (1 + math.log(m)) * idf[j] for j, m in zip(found.tolist(), counts.tolist(), strict=True)}
            size = math.sqrt(sum(v * v for v in x.values()))
            x = {j: v / size for j, v in x.items()} | {language_id.FEATURES: 1.0}
            score = [sum(v * weight(j, c) for j, v in x.items()) for c in (0, 1)]
            top = sum(math.exp(s) for s in score)
            for c in (0, 1):
                error = math.exp(score[c]) / top - (("de", "en")[c] == langs[k])
                for j, v in x.items():
                    g, old = v * error, n.get((j, c), 0.0)
                    w = weight(j, c)
                    z[j, c] = z.get((j, c), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / language_id.ALPHA * w
                    n[j, c] = old + g * g
    want = np.array([[weight(j, c) for c in (0, 1)] for j in range(language_id.FEATURES + 1)])
    assert np.allclose(np.vstack([model.weights, model.bias]), want) and (model.weights == 0).mean() > 0.5


def test_toxicity_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    rows = toxicity.score_documents(docs, labels).join(labels, "doc_id").filter("held_out").select("doc_id", "toxic", "predicted", "score").collect()
    toxic = [r for r in rows if r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.75 * len(toxic)
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.01 * (len(rows) - len(toxic))


def test_toxicity_edges(spark, make_docs):
    words = [f"plain{k}" for k in range(30)]
    rows = [(k, " ".join(words[(k * j) % 30] for j in range(1, 20)) + (" Zorgle, you" if k % 3 == 0 else " hello, you")) for k in range(300)]
    docs = make_docs(*rows, (1000, None), (1001, ""), (1001, ""), (None, "a zorgle"), (1002, "é! " * 30000 + "ZORGLE"))
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(300)] + [(5, 1, 7), (None, 1, 1), (6, 1, None)], "doc_id long, quality int, toxic int")
    out = toxicity.score_documents(docs, labels).collect()
    assert len(out) == 305
    by = {r.doc_id: r for r in out}
    texts = dict(rows)
    assert all(by[k].predicted == (k % 3 == 0) for k in range(300))
    assert [texts[3][s.start : s.end] for s in by[3].spans] == ["Zorgle"]
    assert by[1002].predicted == 1 and by[1002].spans[0].start == 90000
    assert by[1000].score < 0.3 and by[1001].score < 0.3 and by[None].predicted == 1
    assert {r.predicted for r in toxicity.score_documents(docs, labels.limit(0)).collect()} == {0}
    assert toxicity.score_documents(make_docs().limit(0), labels).count() == 0


def test_toxic_rows_go_one_by_one(spark, make_docs):
    rows = [(k, f"plain words number{k} here" + (" zorgle" if k % 3 == 0 else "")) for k in range(200)]
    docs = make_docs(*rows, (0, "plain words with an id that was used"), (None, "a zorgle"), (None, "a word"), (7, None), (7, ""))
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(1, 200)], "doc_id long, toxic int")
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    texts = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect())
    clean = [(k, t) for k, t in rows if k % 3] + [(0, "plain words with an id that was used"), (None, "a word"), (7, ""), (7, "")]
    assert texts == sorted((d is None, d or 0, t) for d, t in clean)


def test_marginals_match_all_paths():
    rng = np.random.default_rng(3)
    move = rng.normal(size=(2, 2))
    lengths = np.array([1, 5, 0, 3])
    e = rng.normal(size=9)
    got, pairs = toxicity.marginals(e, lengths, move, pairs=True)
    want, seen, at = [], np.zeros((2, 2)), 0
    for n in lengths.tolist():
        weights = {}
        for path in itertools.product((0, 1), repeat=n):
            steps = sum(move[a, b] for a, b in itertools.pairwise(path))
            weights[path] = np.exp(sum(e[at + k] for k in range(n) if path[k]) + steps)
        total = sum(weights.values())
        want += [sum(w for path, w in weights.items() if path[k]) / total for k in range(n)]
        for path, w in weights.items():
            for a, b in itertools.pairwise(path):
                seen[a, b] += w / total
        at += n
    assert np.allclose(got, want) and np.allclose(pairs, seen)


def test_very_long_texts_have_a_language(make_docs):
    rows = [(k, ("the quick brown fox" if k % 2 else "der schnelle braune fuchs über")) for k in range(60)] + [(1001, "the fox " * 100_000)]
    docs = make_docs(*rows).withColumn("lang", F.when(F.col("text").startswith("the"), "en").otherwise("de"))
    assert {r.doc_id: r.lang_pred for r in language_id.identify_languages(docs).collect()}[1001] == "en"
