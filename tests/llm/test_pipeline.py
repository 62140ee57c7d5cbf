import collections
import hashlib
import re

import corpus_pipeline
from chronotile.llm import bpe, mixing, queries, toxicity
from tests.llm.test_jaccard_join import brute


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_every_stage_against_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet")

    def after(k, df):
        df.write.parquet(path := str(tmp_path / str(k)))
        return spark.read.parquet(path)

    toxic = {r.doc_id for r in toxicity.score_documents(docs, labels).collect() if r.predicted}
    one = after(0, corpus_pipeline.STAGES[0][1](spark, docs, sf))
    kept = {r.doc_id for r in one.collect()}
    assert one.columns == columns and kept == set(texts) - toxic

    best = {}
    for d in kept:
        best[low(texts[d])] = max(best.get(low(texts[d]), d), d)
    two = after(1, corpus_pipeline.STAGES[1][1](spark, one, sf))
    kept = {r.doc_id for r in two.collect()}
    assert two.columns == columns and kept == set(best.values())

    three = after(2, corpus_pipeline.STAGES[2][1](spark, two, sf))
    kept = {r.doc_id for r in three.collect()}
    assert three.columns == columns and kept == {c for _, _, c in brute([(r.doc_id, r.text) for r in two.collect()])}

    copies = {r.doc_id: r.copies for r in mixing.mix(three).collect()}
    four = after(3, corpus_pipeline.STAGES[3][1](spark, three, sf))
    assert four.columns == columns and collections.Counter(r.doc_id for r in four.collect()) == {d: n for d, n in copies.items() if n}

    own = bpe.tokenizer("byte_bpe_50k.tiktoken")
    rows = corpus_pipeline.STAGES[4][1](spark, four, sf).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in rows) == sorted((r.doc_id, hashlib.sha256(own.encode([r.text])[0]).hexdigest()) for r in four.collect())


def test_run_and_names(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100
    names = list(queries.queries())
    assert [re.match(r"op(\d+)_", x)[1] for x in names if x != "pipeline"] == [str(k) for k in range(1, 11)] and "pipeline" in names
