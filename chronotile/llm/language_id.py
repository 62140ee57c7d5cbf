"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 3-grams of the lower-cased letters are hashed into FEATURES columns. Document frequencies come from every document that may
be learned from, in one pass. The weights are trained by follow-the-regularised-leader (proximal, one coordinate at a time)
with elastic-net penalties on a bounded sample; a temperature fitted on a part of the sample that
was kept from training turns the logits into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronotile.llm.common import in_batches, in_fold
from chronotile.llm.shingles import passes

BITS, LONGEST = 14, 3
FEATURES = 1 << BITS
#: Most documents of one language, and of all, that the fit takes, and the longest of them in characters; the smallest hashes of doc_id are
#: chosen, each document as a whole. Parts of a language that are ranked on their own before they meet.
SAMPLE_PER_LANGUAGE, SAMPLE, SAMPLE_LONGEST, PARTS = 1000, 8000, 200_000, 64
EPOCHS, ALPHA, BETA, L1, L2 = 3, 1.0, 1.0, 0.05, 0.5
_LETTER = np.array([chr(k).isalpha() for k in range(0x10000)])


def ngrams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the hashed n-grams that it has, ascending, and their counts; none for a text without a letter."""
    for first, last in passes(texts):
        low = [(x or "").lower() for x in texts[first:last]]
        codes = np.frombuffer((" ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(x) for x in low])
        letter = (codes >= 0x10000) | _LETTER[np.minimum(codes, 0xFFFF)]
        if (codes >= 0x10000).any():
            far = np.flatnonzero(codes >= 0x10000)
            letter[far] = [chr(c).isalpha() for c in codes[far]]
        plain = np.where(letter, codes, np.uint32(32))
        hashed, gram = [], np.zeros(len(plain), np.uint32)
        for n in range(1, LONGEST + 1):
            gram = gram[: len(plain) - n + 1] * np.uint32(0x01000193) + plain[n - 1 :] + np.uint32(n)
            h = gram * np.uint32(0x9E3779B1)
            hashed.append(((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS))
        at = 0
        for n in lengths.tolist():
            if n and letter[at : at + n].any():
                counts = np.bincount(np.concatenate([x[at : at + n - k] for k, x in enumerate(hashed) if n > k]), minlength=FEATURES)
                found = np.flatnonzero(counts)
                yield found, counts[found]
            else:
                yield np.empty(0, np.int64), np.empty(0, np.int64)
            at += n + 1


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[found]
        return x / max(1e-12, float(np.sqrt(x @ x)))

    def logits(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(found, counts) @ self.weights[found] + self.bias

    def predict(self, found: np.ndarray, counts: np.ndarray) -> tuple[str, float]:
        if not len(found) or not self.languages:
            return "und", 0.0
        p = _softmax(self.logits(found, counts) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(found: list[tuple[np.ndarray, np.ndarray]], languages: list[str], idf: np.ndarray) -> Model:
    """Train on the n-grams (features, counts) of documents and their languages; every fifth of them is kept for the temperature."""
    names = sorted(set(languages))
    model = Model(names, idf, np.zeros((FEATURES, len(names))), np.zeros(len(names)))
    label = np.array([names.index(x) for x in languages])
    grams = [(k, *g) for k, g in enumerate(found) if len(g[0])]
    shuffled = [grams[k] for k in np.random.default_rng(7).permutation(len(grams))]
    held, train = (shuffled[::5], [x for k, x in enumerate(shuffled) if k % 5]) if len(shuffled) >= 50 else (shuffled, shuffled)
    z, n = np.zeros((FEATURES + 1, len(names))), np.zeros((FEATURES + 1, len(names)))
    for _ in range(EPOCHS):
        for k, found, counts in train:
            rows, x = np.append(found, FEATURES), np.append(model.vector(found, counts), 1.0)
            zr, nr = z[rows], n[rows]
            w = np.where(np.abs(zr) > L1, -(zr - np.sign(zr) * L1) / ((BETA + np.sqrt(nr)) / ALPHA + L2), 0.0)
            error = _softmax(x @ w)
            error[label[k]] -= 1
            g = x[:, None] * error
            sigma = (np.sqrt(nr + g * g) - np.sqrt(nr)) / ALPHA
            z[rows] = zr + g - sigma * w
            n[rows] = nr + g * g
    w = np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)
    model.weights, model.bias = w[:-1], w[-1]
    if held:
        logits = np.array([model.logits(found, counts) for _, found, counts in held])
        truth = label[[k for k, _, _ in held]]
        grid = np.exp(np.linspace(np.log(0.02), np.log(20), 120))
        loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-300)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row of counts for each task: the documents with a letter, and of each feature the documents that have it."""
    df, n = np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        for found, _ in ngrams(batch["text"].tolist()):
            df[found] += 1
            n += len(found) > 0
    if n:
        yield pd.DataFrame({"feature": np.append(-1, np.flatnonzero(df)), "df": np.append(n, df[df > 0])})


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        grams = list(ngrams(batch["text"].tolist()))
        packed = {"features": [x.astype("<i4").tobytes() for x, _ in grams], "counts": [n.astype("<i4").tobytes() for _, n in grams]}
        yield pd.DataFrame({"doc_id": batch["doc_id"], "lang": batch["lang"]} | packed)


def train(docs: DataFrame) -> Model:
    """A model learned from text and lang of the documents in the learning fold; without any, one that knows no language.

    Executors count the n-grams; the driver gets no text, only the counts of at most SAMPLE documents.
    """
    learn = in_batches(docs).filter(in_fold(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = learn.select("text").mapInPandas(_frequencies, "feature int, df long").groupBy("feature").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(FEATURES + 1)
    for row in counts:
        df[row.feature] = row.df
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    order = (F.xxhash64("doc_id"), "doc_id")
    first = Window.partitionBy("lang", "part").orderBy(*order)
    ids = learn.filter(F.length("text") <= SAMPLE_LONGEST).select("doc_id", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).alias("part"))
    ids = ids.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= SAMPLE_PER_LANGUAGE).drop("rank", "part")
    ids = ids.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= SAMPLE_PER_LANGUAGE)
    ids = ids.orderBy("rank", "lang").limit(SAMPLE).select("doc_id").distinct()
    sample = learn.filter(F.length("text") <= SAMPLE_LONGEST).join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"])
    sample = sample.mapInPandas(_counted, "doc_id long, lang string, features binary, counts binary").toPandas().sort_values("doc_id")
    found = [(np.frombuffer(x, "<i4"), np.frombuffer(n, "<i4")) for x, n in zip(sample["features"], sample["counts"], strict=True)]
    return fit(found, sample["lang"].tolist(), idf)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every whole text of ``docs`` (doc_id, text); ``und`` and 0 for a text that is null or has no letter."""

    def predicted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [model.predict(*g) for g in ngrams(batch["text"].tolist())]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": [x for x, _ in out], "score": [x for _, x in out]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(predicted, "doc_id long, lang_pred string, score double")


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text, lang).

    Rows are predicted alone, so repeated rows and null doc_ids are rows like others (a null doc_id is never learned from nor held out);
    a very long text is predicted whole, in one task; extra columns are ignored; without learnable rows everything is ``und``; an empty
    table gives an empty result. Of languages with equal probabilities the first by name is given.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out")
    return identify(docs, train(docs)).select("doc_id", held_out, "lang_pred", "score")
