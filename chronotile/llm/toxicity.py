"""Toxicity: a linear-chain conditional random field tags toxic tokens; its marginals make document scores and offsets.

Labels mark documents, so the token labels come from them first: in documents labelled toxic, the words, and beginnings of words,
whose presence goes with the label by a likelihood-ratio test mark toxic tokens, all others are not. The field has two states,
weights for the word, its beginnings and its neighbours, and transitions; it is trained on those tokens by forward-backward gradients.
A logistic model over the greatest marginal and the expected number of toxic tokens scores the document.

The fit takes a bounded sample of labelled rows. Executors hash their words and count the features; the driver gets no text, only
the vocabulary and, for each token of the sample, small numbers in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronotile.llm.common import in_batches, in_fold, saved
from chronotile.llm.shingles import passes, word_hashes

#: Most labelled documents of either label that the fit takes, the longest of them in characters, and most characters of them all. Those
#: with the smallest hashes of doc_id are chosen, each as a whole.
SAMPLE, SAMPLE_LONGEST, SAMPLE_CHARS = 1500, 200_000, 4_000_000
VOCABULARY, PREFIXES = 8000, (3, 4, 5, 6, 7)
#: At least so many passes over the sample and so many steps of so many segments of so many tokens.
EPOCHS, STEPS, STEP_SEGMENTS, SEGMENT, RATE, L2 = 5, 200, 256, 128, 0.5, 1e-5
THRESHOLD, SPAN = 0.7, 0.5
_CELLS, _FILTER_BITS = 250_000, 18


@dataclass
class Field:
    """Weights of the two-state chain. ``keys`` are hashes of words and word beginnings; index len(keys) stands for any other."""

    keys: np.ndarray
    emit: np.ndarray  # (3, keys + 1): of the word and its beginnings, of the word before, of the word after
    bias: float = -4.0
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    document: np.ndarray = field(default_factory=lambda: np.array([-10.0, 0.0, 0.0]))

    def __post_init__(self) -> None:
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[self.keys >> np.uint64(64 - _FILTER_BITS)] = True

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), len(self.keys))
        some = np.flatnonzero(self.maybe[hashes >> np.uint64(64 - _FILTER_BITS)])
        if len(some):
            at = np.minimum(np.searchsorted(self.keys, hashes[some]), len(self.keys) - 1)
            out[some] = np.where(self.keys[at] == hashes[some], at, len(self.keys))
        return out

    def potentials(self, ids: list[np.ndarray], text: np.ndarray) -> np.ndarray:
        """Log-odds that each token emits, from its word and beginnings (``ids``) and its neighbours in the same text."""
        e = self.bias + sum(self.emit[0, x] for x in ids)
        if len(text) > 1:
            same = text[1:] == text[:-1]
            e[1:] += np.where(same, self.emit[1, ids[0][:-1]], 0)
            e[:-1] += np.where(same, self.emit[2, ids[0][1:]], 0)
        return np.clip(e, -30, 30)


def _lengths_to_blocks(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Indexes of texts with tokens, longest first, in blocks of at most _CELLS cells or one text."""
    order = np.argsort(-lengths, kind="stable")
    order, at = order[lengths[order] > 0], 0
    while at < len(order):
        n = max(1, _CELLS // int(lengths[order[at]]))
        yield order[at : at + n]
        at += n


def marginals(e: np.ndarray, lengths: np.ndarray, move: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Probability of the toxic state at each token, by forward-backward over texts side by side; expected transitions if asked for."""
    out, expected = np.empty(len(e)), np.zeros((2, 2))
    starts = np.cumsum(np.append(0, lengths[:-1])) if len(lengths) else lengths
    m = np.exp(move)
    for block in _lengths_to_blocks(lengths):
        n, longest = lengths[block], int(lengths[block[0]])
        cell = starts[block][:, None] + np.arange(longest)
        live = np.arange(longest) < n[:, None]
        psi = np.ones((longest, len(block)))
        psi.T[live] = np.exp(e[cell[live]])
        active = live.sum(0)
        a, b = np.full_like(psi, 0.5), np.full_like(psi, 0.5)
        a[0] = psi[0] / (1 + psi[0])
        for t in range(1, longest):
            k = active[t]
            x = a[t - 1, :k]
            one = ((1 - x) * m[0, 1] + x * m[1, 1]) * psi[t, :k]
            a[t, :k] = one / (one + (1 - x) * m[0, 0] + x * m[1, 0])
        for t in range(longest - 2, -1, -1):
            k = active[t + 1]
            y = b[t + 1, :k] * psi[t + 1, :k]
            zero = 1 - b[t + 1, :k]
            one = m[1, 1] * y + m[1, 0] * zero
            b[t, :k] = one / (one + m[0, 1] * y + m[0, 0] * zero)
        p = a * b
        p /= p + (1 - a) * (1 - b)
        out[cell[live]] = p.T[live]
        if pairs and longest > 1:
            inner = live[:, 1:].T
            left = (1 - a[:-1], a[:-1])
            right = (1 - b[1:], b[1:] * psi[1:])
            joint = np.array([[left[i] * m[i, j] * right[j] for j in (0, 1)] for i in (0, 1)])
            joint /= joint.sum((0, 1))
            expected += (joint * inner).sum((2, 3))
    return out, expected


def _summary(p: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """For each text: 1, log-odds of its greatest marginal, log of 1 + its expected toxic tokens."""
    top, total = np.full(n, 1e-4), np.zeros(n)
    np.maximum.at(top, text, p)
    np.add.at(total, text, np.where(p > 0.2, p, 0.0))
    top = np.clip(top, 1e-4, 1 - 1e-4)
    return np.stack([np.ones(n), np.log(top / (1 - top)), np.log1p(total)], 1)


def _feature_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """feature, held and has: of some documents those that have it, and the toxic ones among them."""
    for batch in batches:
        texts, toxic = batch["text"].tolist(), batch["toxic"].to_numpy(np.int64)
        for first, last in passes(texts):
            doc, words, _, _, *heads = word_hashes_of(texts[first:last])
            feature, doc = np.concatenate([words, *heads]), np.tile(doc, 1 + len(heads))
            order = np.lexsort((doc, feature))
            feature, doc = feature[order], doc[order]
            new = (feature > 0) & np.append(True, (feature[1:] != feature[:-1]) | (doc[1:] != doc[:-1]))[: len(doc)]
            found, at = np.unique(feature[new].view(np.int64), return_inverse=True)
            has = np.bincount(at, weights=toxic[first:last][doc[new]], minlength=len(found)).astype(np.int64)
            yield pd.DataFrame({"feature": found, "held": np.bincount(at, minlength=len(found)), "has": has})


def vocabulary(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent and all telling features of (text, toxic) rows, ascending, and which of them tell.

    A feature tells if documents that have it are nearly all toxic and a likelihood-ratio test, at a level that allows for the number
    of features, agrees. At most VOCABULARY features reach the driver.
    """
    every, yes = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    counted = sample.select("text", "toxic").mapInPandas(_feature_counts, "feature long, held long, has long")
    counted = saved(counted.groupBy("feature").agg(F.sum("held").alias("held"), F.sum("has").alias("has")))
    number = counted.count()
    if not number or not 0 < yes < every:
        return np.empty(0, np.uint64), np.empty(0, bool)

    def term(x, y):
        return F.when(x > 0, x * F.log(x / y)).otherwise(0.0)

    held, has = F.col("held").cast("double"), F.col("has").cast("double")
    parts = [(has, held * yes / every), (held - has, held - held * yes / every)]
    parts += [(yes - has, yes - held * yes / every), (every - yes - held + has, every - yes - held + held * yes / every)]
    ratio = 2 * sum(term(x, y) for x, y in parts)
    tells = (has >= 0.95 * held) & (ratio > 2 * float(np.log(number)) + 6)
    best = counted.withColumn("tells", tells).orderBy((held + F.col("tells").cast("int") * 10 * every).desc(), "feature").limit(VOCABULARY)
    rows = best.select("feature", "tells").toPandas()
    keys = rows["feature"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], rows["tells"].to_numpy(bool)[order]


def _encoded(model: Field):
    """(toxic, ids): for each text the vocabulary numbers of its words and their beginnings, row by row, as 16-bit numbers."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text, words, _, _, *heads = word_hashes_of(batch["text"].tolist())
            ids = np.array([model.ids(x) for x in (words, *heads)], "<u2")
            cut = np.searchsorted(text, np.arange(len(batch) + 1))
            rows = [ids[:, a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "ids": rows})

    return encode


def fit(model: Field, tells: np.ndarray, docs: list[np.ndarray], toxic: np.ndarray) -> Field:
    """Train ``model`` in place on documents, each a (1 + prefixes, tokens) matrix of vocabulary numbers, and their labels, 0 or 1."""
    ids = np.concatenate(docs, 1)
    length = np.array([x.shape[1] for x in docs])
    first, width = np.cumsum(length) - length, len(model.keys) + 1
    marked = np.append(tells, False)
    y = np.repeat(toxic == 1, length)
    hit = np.zeros(ids.shape[1], bool)
    for x in ids:
        hit |= marked[x]
    y &= hit
    cuts = np.concatenate([np.arange(a, a + n, SEGMENT) for a, n in zip(first.tolist(), length.tolist(), strict=True)])
    size = np.minimum(SEGMENT, np.repeat(first + length, -(-length // SEGMENT)) - cuts)
    g_emit, g_bias, g_move = np.full_like(model.emit, 1e-8), 1e-8, np.full((2, 2), 1e-8)
    random, steps = np.random.default_rng(7), max(1, len(cuts) // STEP_SEGMENTS)

    def count(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.bincount(x, w, width)

    for _ in range(max(EPOCHS, -(-STEPS // steps))):
        for some in np.array_split(random.permutation(len(cuts)), steps):
            n = size[some]
            at = np.repeat(cuts[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            own, segment = list(ids[:, at].astype(np.int64)), np.repeat(np.arange(len(some)), n)
            p, expected = marginals(model.potentials(own, segment), n, model.move, pairs=True)
            error, same = y[at] - p, segment[1:] == segment[:-1]
            step = [sum(count(x, error) for x in own)]
            step = np.stack([*step, count(own[0][:-1][same], error[1:][same]), count(own[0][1:][same], error[:-1][same])]) / len(some)
            step[:, -1] = 0
            step -= L2 * model.emit
            g_emit += step**2
            model.emit += RATE * step / np.sqrt(g_emit)
            d = error.sum() / len(some)
            g_bias += d * d
            model.bias += RATE * d / np.sqrt(g_bias)
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[at][:-1][same].astype(int), y[at][1:][same].astype(int)), 1)
            d = (seen - expected) / len(some) - L2 * model.move
            g_move += d * d
            model.move += RATE * d / np.sqrt(g_move)
    summaries = []
    for k in range(0, len(docs), 100):
        text, n = np.repeat(np.arange(len(docs[k : k + 100])), length[k : k + 100]), length[k : k + 100]
        own = list(np.concatenate(docs[k : k + 100], 1).astype(np.int64))
        summaries.append(_summary(marginals(model.potentials(own, text), n, model.move)[0], text, len(n)))
    x, w = np.concatenate(summaries), np.zeros(3)
    for _ in range(30):  # Newton steps of a ridge logistic regression
        s = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (s * (1 - s))[:, None]).T @ x + 0.05 * np.eye(3), x.T @ (toxic - s) - 0.05 * w)
    model.document = w
    return model


def word_hashes_of(texts: list[str | None]):
    """Words for the field: runs of letters and digits (any character beyond ASCII counts as one), A-Z lower-cased."""
    return word_hashes([None if x is None else x.translate(_SEPARATORS) for x in texts], PREFIXES)


_SEPARATORS = {k: " " for k in range(128) if not chr(k).isalnum()}


def train(docs: DataFrame, labels: DataFrame) -> Field:
    """A field learned from documents of the learning fold that ``labels`` (doc_id, toxic) marks."""
    docs = in_batches(docs)
    usable = labels.filter(in_fold(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = (F.xxhash64("doc_id"), "doc_id")
    chosen = [usable.filter(F.col("toxic") == k).orderBy(*order).limit(SAMPLE) for k in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))
    short = docs.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_LONGEST))
    sample = short.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text"))
    sample = sample.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.min_by("toxic", "doc_id").cast("long").alias("toxic"))
    so_far = Window.partitionBy("toxic").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sample = saved(sample.withColumn("chars", F.sum(F.length("text")).over(so_far)).filter(F.col("chars") <= SAMPLE_CHARS).drop("chars"))
    keys, tells = vocabulary(sample)
    if not tells.any():
        return Field(np.empty(0, np.uint64), np.zeros((3, 1)))
    model = Field(keys, np.zeros((3, len(keys) + 1)))
    encoded = sample.mapInPandas(_encoded(model), "doc_id long, toxic long, ids binary").toPandas().sort_values("doc_id")
    matrices = [np.frombuffer(x, "<u2").reshape(1 + len(PREFIXES), -1) for x in encoded["ids"]]
    return fit(model, tells, matrices, encoded["toxic"].to_numpy(np.int64))


def _scores(model: Field, texts: list[str | None]) -> Iterator[tuple]:
    """For runs of whole texts: first and last index, scores, and of each token its text, first byte, end byte and marginal."""
    for first, last in passes(texts):
        text, hashes, start, end, *heads = word_hashes_of(texts[first:last])
        lengths = np.bincount(text, minlength=last - first)
        p, _ = marginals(model.potentials([model.ids(x) for x in (hashes, *heads)], text), lengths, model.move)
        z = _summary(p, text, last - first) @ model.document
        yield first, last, 1 / (1 + np.exp(-np.clip(z, -30, 30))), text, start, end, p


def score(docs: DataFrame, model: Field) -> DataFrame:
    """doc_id, score and spans (start and end in characters, and marginal, of each toxic token) of every whole text of ``docs``."""

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            scores, spans = [], []
            for first, last, own, text, start, end, p in _scores(model, texts):
                scores += own.tolist()
                found: list[list[dict]] = [[] for _ in range(last - first)]
                hits = np.flatnonzero(p >= SPAN)
                for k in np.unique(text[hits]).tolist():
                    at = hits[np.searchsorted(text[hits], k) : np.searchsorted(text[hits], k, "right")]
                    chars = np.append(0, np.cumsum((np.frombuffer(texts[first + k].encode(), np.uint8) & 0xC0) != 0x80))
                    places = zip(chars[start[at]].tolist(), chars[end[at]].tolist(), p[at].tolist(), strict=True)
                    found[k] = [{"start": a, "end": b, "p": x} for a, b, x in places]
                spans += found
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": scores, "spans": spans})

    shape = "doc_id long, score double, spans array<struct<start:int,end:int,p:double>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(scored, shape)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, spans for every row of ``docs`` (doc_id, text).

    Rows are scored alone, so repeated rows and null doc_ids are rows like others; null and empty texts have no token and a low score. Labels
    that are not 0 or 1 and repeats are ignored (1 wins); without labels of both kinds every score is near 0. A very long text is scored
    whole, in one task. Extra columns are ignored; an empty table gives an empty result.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out")
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return score(docs, train(docs, labels)).select("doc_id", held_out, "score", predicted, "spans")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text is predicted toxic.

    Each row is decided by its own text, so rows with a repeated or null doc_id stay or go one by one; all columns come through as they are.
    """
    model = train(docs, labels)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [x[2] for x in _scores(model, batch.column("text").to_pylist())]
            yield batch.filter(pa.array(np.concatenate(scores) < THRESHOLD)) if scores else batch

    return docs.mapInArrow(kept, docs.schema)
