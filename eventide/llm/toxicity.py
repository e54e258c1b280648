"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learnt from labels of whole documents.

A document is a bag of sentences, and toxic if at least one of them is, or by a leak of its own. A sentence's score is
1 - (1 - s(bias + weights of its words)) / (1 - s(bias)) with the logistic s: 0 without a sign of offence, so that sentences
without any are no instances, however many they are. The more sentences with words a document has, the less likely is each
of them, by 1 / (1 + n / LONG); and its leak is s(leak + length * n / (n + SHORT)), which is bounded. A document's score is
1 - (1 - leak) * product(1 - score of a sentence). Weights, bias, leak and length minimise the log loss of that very score against the document labels, so no sentence was ever
labelled; afterwards the sentence scores tell where the offence is.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_batches, fold

STOP = b"\x01"
#: Sentences by which a sentence's bias and a document's leak change; the greatest logit that a leak can reach by length.
LONG, SHORT, MOST = 150, 300, -2.0
#: Letters (A-Z lowered), digits and all beyond ASCII are words; . ! ? and line ends end a sentence; the rest parts words.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 1 if b in b".!?\n" else 32 for b in range(256))


def marked_words(text: bytes) -> list[bytes]:
    """Words in order, and ``STOP`` after each sentence."""
    return text.translate(TABLE).replace(STOP, b" \x01 ").split()


def features(word: bytes) -> list[bytes]:
    """The word and its beginnings of four to eight bytes: offensive stems take many endings."""
    return [b"=" + word, *(word[:n] for n in range(4, min(len(word), 8) + 1))]


class Words(dict):
    """Summed weights of words by their features, worked out once for each word; emptied when it gets long."""

    def __init__(self, weights: dict[bytes, float], limit: int = 300_000):
        super().__init__({STOP: np.nan})
        self.weights, self.limit = weights, limit

    def __missing__(self, word: bytes) -> float:
        get = self.weights.get
        value = sum([get(f, 0.0) for f in features(word)])
        if len(self) < self.limit:
            self[word] = value
        return value


def _softplus(x):
    return np.logaddexp(0.0, x)


class Toxicity(NamedTuple):
    """Weights of features, what a sentence has without any, and the logit of the leak, without and by length."""

    weights: dict[bytes, float]
    bias: float
    leak: float
    length: float

    def sentences(self, text: bytes, words: Words | None = None) -> tuple[np.ndarray, int]:
        """-log(1 - score) of each sentence, 0 of one between two stops without a word; how many have words."""
        found = marked_words(text)
        sums = np.fromiter(map((Words(self.weights) if words is None else words).__getitem__, found), np.float64, len(found))
        sums = np.append(sums, np.nan)
        ends = np.flatnonzero(np.isnan(sums))
        sums[ends] = 0.0
        # a sentence's own words are added up one by one: what others add up to leaves no rounding in it
        own = np.add.reduceat(sums, np.concatenate([[0], ends[:-1] + 1]))
        n = int((np.diff(ends, prepend=-1) > 1).sum())
        bias = self.bias - np.log1p(n / LONG)
        return np.where(own > 0, _softplus(bias + own) - _softplus(bias), 0.0), n

    def noisy_or(self, hazards: np.ndarray, n: int) -> float:
        """The score of a document from what :meth:`sentences` returns."""
        return float(-np.expm1(-_softplus(self.leak + self.length * n / (n + SHORT)) - hazards.sum()))


class Bags(NamedTuple):
    """Training documents as word numbers by sentence, sentences by document; how many sentences of a document have words."""

    words: np.ndarray
    sentence: np.ndarray
    document: np.ndarray
    labels: np.ndarray
    spoken: np.ndarray


def fit(texts: list[bytes], labels: np.ndarray, min_documents: int = 4, max_features: int = 3000, rounds: int = 80, rate: float = 0.2, decay: float = 3e-4) -> Toxicity:
    """Weights by Adam on the full sample, for the ``max_features`` that tell most about the document labels."""
    if not len(texts) or not labels.any():
        return Toxicity({}, -8.0, -8.0, 0.0)
    ids: dict[bytes, int] = {STOP: 0}
    numbered = []  # words as numbers: a few bytes each
    for t in texts:
        found = marked_words(t)
        numbered.append(np.fromiter((ids.setdefault(w, len(ids)) for w in found), np.int32, len(found)))
    known = [[] if w == STOP else features(w) for w in ids]
    toxic, all_ = Counter(), Counter()
    for found, label in zip(numbered, labels.tolist()):
        own = {f for w in np.unique(found).tolist() for f in known[w]}
        all_.update(own)
        if label:
            toxic.update(own)
    share = labels.mean()
    surprise = {f: (toxic[f] - n * share) ** 2 / (n * share * (1 - share) + 1) for f, n in all_.items() if n >= min_documents and toxic[f] > n * share}
    number = {f: i for i, f in enumerate(sorted(surprise, key=lambda f: (-surprise[f], f))[:max_features])}
    of_word = [[number[f] for f in own if f in number] for own in known]
    sizes = np.array([len(x) for x in of_word])
    flat, starts = np.array([x for own in of_word for x in own], np.int64), np.cumsum(sizes) - sizes
    words, sentence, document, spoken, n_sentences = [], [], [], [], 0
    for d, found in enumerate(numbered):
        n = sizes[found]
        at = np.repeat(starts[found] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        stops = np.cumsum(found == 0)
        words.append(flat[at])
        sentence.append(np.repeat(n_sentences + stops, n))
        own = int(stops[-1]) + 1 if len(stops) else 1
        document.append(np.full(own, d))
        spoken.append(float((np.diff(np.append(np.flatnonzero(found == 0), len(found)), prepend=-1) > 1).sum()))
        n_sentences += own
    bags = Bags(*map(np.concatenate, (words, sentence, document)), labels.astype(np.float64), np.array(spoken))
    theta = np.zeros(len(number) + 3)
    theta[-3:-1] = -6.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        slope = gradient(theta, bags) / len(labels) + decay * np.append(np.ones(len(number)), [0.0] * 3)
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        theta = theta - rate * (1 - 0.9 * (step - 1) / rounds) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        theta[:-3] = np.maximum(theta[:-3], 0.0)  # no number of harmless words makes up for an offence
        theta[-1] = np.clip(theta[-1], 0.0, max(MOST - theta[-2], 0.0))
    return Toxicity({f: float(theta[i]) for f, i in number.items() if theta[i] > 0}, *map(float, theta[-3:]))


def loss(theta: np.ndarray, bags: Bags) -> float:
    """Log loss of the documents' scores, summed up."""
    kept = _kept(theta, bags)
    return float(-(bags.labels * np.log(np.maximum(-np.expm1(kept), 1e-12)) + (1 - bags.labels) * kept).sum())


def gradient(theta: np.ndarray, bags: Bags) -> np.ndarray:
    """Slope of :func:`loss`: a toxic document's blame is shared among its sentences by their scores."""
    toxic = np.maximum(-np.expm1(_kept(theta, bags)), 1e-12)
    blame = bags.labels * (toxic - 1) / toxic + (1 - bags.labels)
    bias = _bias(theta, bags)
    each, alone, leak = (np.exp(-_softplus(-x)) for x in (_logits(theta, bags), bias, _leak(theta, bags)))
    of_sum = blame[bags.document] * each
    of_bias = (blame[bags.document] * (each - alone)).sum()
    return np.append(np.bincount(bags.words, weights=of_sum[bags.sentence], minlength=len(theta) - 3), [of_bias, (blame * leak).sum(), (blame * leak * bags.spoken / (bags.spoken + SHORT)).sum()])


def _bias(theta: np.ndarray, bags: Bags) -> np.ndarray:
    return (theta[-3] - np.log1p(bags.spoken / LONG))[bags.document]


def _leak(theta: np.ndarray, bags: Bags) -> np.ndarray:
    return theta[-2] + theta[-1] * bags.spoken / (bags.spoken + SHORT)


def _logits(theta: np.ndarray, bags: Bags) -> np.ndarray:
    return _bias(theta, bags) + np.bincount(bags.sentence, weights=theta[bags.words], minlength=len(bags.document))


def _kept(theta: np.ndarray, bags: Bags) -> np.ndarray:
    """log P(a document isn't toxic)."""
    return -_softplus(_leak(theta, bags)) - np.bincount(bags.document, weights=_softplus(_logits(theta, bags)) - _softplus(_bias(theta, bags)), minlength=len(bags.labels))


def train(docs: DataFrame, labels: DataFrame, max_documents: int = 6000, max_bytes: int = 32 << 10) -> Toxicity:
    """Fit on labelled documents outside the held-out fold, at most ``max_documents`` of at most ``max_bytes`` each.

    Taken in the order of a hash of doc_id, so the sample doesn't depend on the rows' order or on repeated rows. A document
    with labels that differ, or with several texts, counts once, by its greatest label and text.
    """
    own = labels.where(F.col("toxic").isNotNull() & (fold("doc_id", 4) != 2)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * max_documents)
    texts = docs.where(F.octet_length("text") <= max_bytes).select("doc_id", "text").join(F.broadcast(own), "doc_id")  # max_documents bounds its size
    sample = texts.groupBy("doc_id", "toxic").agg(F.max("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_documents)
    rows = sample.select(F.col("text").cast("binary").alias("text"), "toxic").toArrow()
    return fit(rows.column("text").to_pylist(), np.array([int(x > 0) for x in rows.column("toxic").to_pylist()]))


SCORES = "doc_id long, score double, n_sentences long, offending array<struct<start:long,end:long,score:double>>"


def score(docs: DataFrame, model: Toxicity, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, n_sentences, offending) for every row: the sentences that reach ``threshold`` by byte place and score.

    A null or empty text is one empty sentence. Repeated rows and null ids are kept.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # words of the bounded sample

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        words = Words(model.weights)
        bar = -np.log1p(-threshold)
        for b in batches:
            scores, counts, places = [], [], []
            for text in as_bytes(b.column(1)):
                hazards, n = model.sentences(text, words)
                scores.append(model.noisy_or(hazards, n))
                counts.append(len(hazards))
                hit = np.flatnonzero(hazards >= bar)
                places.append(_spans(text, hit, hazards) if len(hit) else [])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.array(places, kind)], names=["doc_id", "score", "n_sentences", "offending"])

    return docs.select("doc_id", "text").mapInArrow(run, SCORES)


def _spans(text: bytes, hit: np.ndarray, hazards: np.ndarray) -> list[dict]:
    stops = np.flatnonzero(np.frombuffer(text.translate(TABLE), np.uint8) == 1)
    starts, ends = np.concatenate([[0], stops + 1]), np.concatenate([stops, [len(text)]])
    return [{"start": int(starts[i]), "end": int(ends[i]), "score": float(-np.expm1(-hazards[i]))} for i in hit]


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_sentences, offending) for every row of ``docs``; see :func:`train`, :func:`score`.

    held_out: crc32(doc_id as text) mod 4 is 2 (a null doc_id isn't). Without labels every score is near 0. An empty table
    gives an empty result. Other columns are ignored.
    """
    found = score(docs, train(docs, labels), threshold)
    return found.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_sentences", "offending")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score stays below ``threshold``, unchanged, with all their columns; no shuffle.

    A null or empty text has the leak's score alone; repeated rows and null ids stay or go as others do; columns may have
    any names besides doc_id and text. Without labels all rows stay.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))  # words of the bounded sample
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        words = Words(model.weights)
        for b in batches:
            clean = [model.noisy_or(*model.sentences(t, words)) < threshold for t in as_bytes(b.column(at))]
            yield b.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
