"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in its words, a word's
weight is the sum over its hashed prefixes and itself, and the document's probability is
the noisy-or of its sentences: ``1 - prod(1 - p)``. Faint sentences, of a probability up to ``FAINT`` or
without a telling word, weigh together as at most ``TYPICAL`` ones, so that they say nothing of a document by their
number: all of them leave a score below 0.23 for any length while a sentence without a
telling word has at most ``FAINT``. Only document labels are known; the gradient of
the document's likelihood tells which sentences explain it. Scoring then names those sentences.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crowdtide.llm import frames
from crowdtide.llm.labelled import Adam, Sample, sample, sigmoid

BUCKETS = 1 << 18
SAMPLE = 8000
CHARACTERS = 40_000_000
FAINT = 0.002
TYPICAL = 128
OFFENDING = 0.5
LEAST_DOCUMENTS = 6
BIAS = -9.0
LEAST_EXCESS = 4.0
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"\w+")


def word_features(word: str) -> list[int]:
    """Buckets of the whole word and of its first 3 to 10 characters, so that forms share a stem."""
    marked = f"<{word}>"
    return [crc32(g.encode()) & (BUCKETS - 1) for g in {marked, *(marked[:n] for n in range(4, 12))}]


def sentences(text: str) -> list[tuple[int, int, set[str]]]:
    """Start, end and set of lower-case words of every sentence that has words."""
    found = []
    for m in _SENTENCE.finditer(text):
        words = set(_WORD.findall(m.group().lower()))
        if words:
            found.append((m.start(), m.end(), words))
    return found


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def word(self, word: str) -> float:
        return float(self.weights[word_features(word)].sum())


def _telling(feature, feature_word, words, entry_word, entry_doc, y) -> np.ndarray:
    """Features met clearly more often in positive documents than chance has it.

    A feature's documents are those of its words, summed. Others would only let the fit explain
    a document by words that happen to stand in it.
    """
    pairs = np.unique(entry_word.astype(np.int64) << 32 | entry_doc)
    word, toxic = pairs >> 32, y[pairs & 0xFFFFFFFF]
    all_docs = np.bincount(feature, np.bincount(word, minlength=words)[feature_word], BUCKETS)
    hits = np.bincount(feature, np.bincount(word, toxic, words)[feature_word], BUCKETS)
    share = y.mean()
    excess = (hits - share * all_docs) / np.sqrt(np.maximum(all_docs * share * (1 - share), 1e-9))
    return (all_docs >= LEAST_DOCUMENTS) & (excess >= LEAST_EXCESS)


def _shares(p: np.ndarray, least: float, doc: np.ndarray, docs: int) -> np.ndarray:
    """Weight of every sentence in its document's noisy-or; ``least`` is that of one without telling words."""
    faint = p <= max(FAINT, least * (1 + 1e-9))
    many = np.bincount(doc[faint], minlength=docs)
    return np.where(faint, np.minimum(1.0, TYPICAL / np.maximum(many, 1))[doc], 1.0)


def fit(data: Sample, epochs: int = 100, rate: float = 0.1, decay: float = 1e-4) -> Model:
    """Maximise the likelihood of document labels under noisy-or.

    Without rows of both classes, the model knows no word and scores zero everywhere.
    """
    y = data.labels
    if len(data) == 0 or y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), -40.0)
    numbers: dict[str, int] = {}
    entry_word, entry_sentence, sentence_doc = array("i"), array("i"), array("i")
    for doc, (text,) in enumerate(data.rows):
        for _, _, words in sentences(text or ""):
            entry_word.extend(numbers.setdefault(w, len(numbers)) for w in words)
            entry_sentence.extend([len(sentence_doc)] * len(words))
            sentence_doc.append(doc)
    feature, per_word = array("i"), array("i")
    for word in numbers:
        found = word_features(word)
        feature.extend(found)
        per_word.append(len(found))
    entry_word, entry_sentence, sentence_doc, feature, per_word = (
        np.frombuffer(x, np.int32) for x in (entry_word, entry_sentence, sentence_doc, feature, per_word)
    )
    words, feature_word = len(numbers), np.repeat(np.arange(len(numbers), dtype=np.int32), per_word)
    del numbers
    frames.give_back()
    telling = _telling(feature, feature_word, words, entry_word, sentence_doc[entry_sentence], y)[feature]
    feature, feature_word = feature[telling], feature_word[telling]
    weights, bias = np.zeros(BUCKETS), BIAS
    steps, bias_steps = Adam(BUCKETS, rate), Adam((), rate)
    share = data.weights / data.weights.sum()
    for _ in range(epochs):
        per_word = np.bincount(feature_word, weights[feature], words)
        z = bias + np.bincount(entry_sentence, per_word[entry_word], len(sentence_doc))
        p = sigmoid(z)
        weight = _shares(p, sigmoid(bias), sentence_doc, len(y))
        missed = np.exp(np.bincount(sentence_doc, weight * np.log1p(-np.minimum(p, 1 - 1e-12)), len(y)))
        pull = share * np.where(y == 1, -missed / np.maximum(1 - missed, 1e-9), 1.0)
        dz = pull[sentence_doc] * p * weight
        d_word = np.bincount(entry_word, dz[entry_sentence], words)
        gradient = np.bincount(feature, d_word[feature_word], BUCKETS) + decay * weights
        weights -= steps.step(gradient)
        bias -= bias_steps.step(np.asarray(dz.sum()))
    return Model(weights.astype(np.float32), float(bias))


def train(docs: DataFrame, labels: DataFrame, trained: Column | None = None, most: int = SAMPLE) -> Model:
    """Fit on at most ``most`` labelled documents of any length, ``CHARACTERS`` characters in all."""
    model = fit(sample(docs, labels, "toxic", trained, most, None, characters=CHARACTERS))
    frames.give_back()
    return model


def _score(text: str, word: frames.Memo, bias: float) -> tuple[float, list[tuple[int, int, float]], int]:
    spans = sentences(text)
    if not spans:
        return 0.0, [], 0
    z = np.fromiter((sum(map(word.__getitem__, s[2])) for s in spans), np.float64, len(spans)) + bias
    p = sigmoid(z)
    weight = _shares(p, sigmoid(bias), np.zeros(len(p), np.int64), 1)
    score = -np.expm1((weight * np.log1p(-np.minimum(p, 1 - 1e-12))).sum())
    return float(score), [(spans[i][0], spans[i][1], float(p[i])) for i in np.flatnonzero(p >= OFFENDING)], len(spans)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...]) -> DataFrame:
    """The kept columns with ``score``, ``n_sentences`` and the ``offending`` sentences.

    Offending sentences have a probability of at least one half; start and end are code points.
    Whole texts are read; null, empty and wordless texts score zero. Repeated rows are scored each, and
    an empty table gives no rows.
    """

    class Work:
        def __init__(self):
            self.word = frames.Memo(model.word, 200_000)

        def __call__(self, batch: pa.RecordBatch) -> dict:
            found = [_score(t or "", self.word, model.bias) for t in batch.column("text").to_pylist()]
            spans = [[{"start": a, "end": b, "score": p} for a, b, p in f[1]] for f in found]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            return {
                "score": pa.array([f[0] for f in found], pa.float64()),
                "n_sentences": pa.array([f[2] for f in found], pa.int64()),
                "offending": pa.array(spans, kind),
            }

    made = "score double, n_sentences long, offending array<struct<start:int,end:int,score:double>>"
    return frames.map_columns(docs.select(*dict.fromkeys([*keep, "text"])), Work, made, keep)


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Score of every document, learned from the labels outside the held-out third."""
    docs, labels = frames.table(spark, folder, "documents"), frames.table(spark, folder, "labels")
    model = train(docs, labels, ~frames.in_part(F.col("doc_id"), 3, 1))
    return score(docs, model, ("doc_id",)).select(
        "doc_id",
        frames.in_part(F.col("doc_id"), 3, 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        "n_sentences",
        F.size("offending").cast("long").alias("n_offending"),
        F.get("offending", 0)["start"].cast("long").alias("first_start"),
        F.get("offending", 0)["end"].cast("long").alias("first_end"),
    )


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: documents scoring at least 0.7 go; the columns stay as they are."""
    labels = frames.table(spark, folder, "labels")
    model = train(docs, labels, ~frames.in_part(F.col("doc_id"), 3, 1))
    rows, names = frames.numbered(docs, "text")
    return score(rows, model, tuple(rows.columns)).filter("score < 0.7").select(*names)
