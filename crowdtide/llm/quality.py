"""Quality by a factorisation machine.

Features are hashed words (weighted by the square root of their counts, scaled to length one),
statistics of the text's structure and its recorded length, each cut into bins. All pairs of
features interact through low-rank factors, and the sum over pairs is linear in the features:
``sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2) / 2``.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crowdtide.llm import frames
from crowdtide.llm.labelled import Adam, Sample, sample, sigmoid

WORDS = 1 << 16
BINS = 16
RANK = 8
SAMPLE = 8000
LONGEST = 20_000
_CLASS = np.zeros(256, np.int64)
for _group, _members in enumerate(
    (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\n\r", b".,;:", b"!?",
     b"#$%&*", b"|_=-+~^", b"<>()[]{}/\\@'\""), 1
):
    _CLASS[list(_members)] = _group
_CLASS[128:] = 11
STATISTICS = 12 + 7
SIZE = WORDS + (STATISTICS + 1) * BINS


def _bin(share: float) -> int:
    """Bins that are fine near zero: 0, then powers of two up to one."""
    return 0 if share <= 0 else int(np.clip(BINS - 1 + np.ceil(2 * np.log2(min(share, 1.0))), 1, BINS - 1))


def _long_bin(n: int) -> int:
    return min(int(n).bit_length(), BINS - 1)


def structure(text: bytes, words: list[bytes]) -> list[int]:
    """The bin of every statistic: character classes, lines, words and their repetition."""
    n, lines = max(len(text), 1), [x for x in text.split(b"\n") if x]
    classes = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=12) / n
    starts = len({x[:12] for x in lines})
    count = max(len(words), 1)
    return [
        *(_bin(c) for c in classes),
        _bin(1 - len(set(lines)) / max(len(lines), 1)),
        _bin(1 - starts / max(len(lines), 1)),
        _bin(1 - len(set(words)) / count),
        _bin(1 - len(set(zip(words, words[1:]))) / max(len(words) - 1, 1)),
        _long_bin(sum(map(len, words)) // count * 4),
        _long_bin(n // max(len(lines), 1)),
        _long_bin(len(words)),
    ]


def _bucket(word: bytes) -> int:
    return crc32(word.lower()) & (WORDS - 1)


def features(text: bytes, length: int | None, bucket) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the non-zero features."""
    words = text.split()
    found, counts = np.unique(np.fromiter(map(bucket, words), np.int64, len(words)), return_counts=True)
    values = np.sqrt(counts)
    values /= max(np.sqrt(counts.sum()), 1.0)
    bins = structure(text, words) + [0 if length is None else _long_bin(max(length, 0)) or 1]
    places = WORDS + np.arange(STATISTICS + 1) * BINS + bins
    return np.concatenate([found, places]), np.concatenate([values, np.full(len(places), 0.5)])


@dataclass
class Model:
    offset: float
    linear: np.ndarray
    factors: np.ndarray

    def __call__(self, index: np.ndarray, values: np.ndarray) -> float:
        scaled = self.factors[index] * values[:, None]
        total = scaled.sum(0)
        pairs = 0.5 * (total @ total - (scaled * scaled).sum())
        return float(self.offset + self.linear[index] @ values + pairs)


def fit(data: Sample, epochs: int = 40, rate: float = 0.03, decay: float = 1e-3, seed: int = 11) -> Model:
    """Logistic likelihood by Adam; without rows of both classes, the model is a constant."""
    rng = np.random.default_rng(seed)
    factors = rng.normal(0, 0.02, (SIZE, RANK))
    linear, y = np.zeros(SIZE), data.labels
    if len(data) == 0 or y.min() == y.max():
        return Model(0.0 if len(data) == 0 else 40.0 * (2 * y[0] - 1), linear, factors * 0)
    rows = [features((t or "").encode(), None if n is None or n != n else int(n), _bucket) for t, n in data.rows]
    index, x = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    share = data.weights / data.weights.sum()
    mean = (share * y).sum()
    offset = np.log(mean / (1 - mean))
    steps = Adam(SIZE, rate), Adam((SIZE, RANK), rate), Adam((), rate)
    for _ in range(epochs):
        totals = np.empty((len(rows), RANK))
        squares = np.zeros(len(rows))
        for f in range(RANK):
            scaled = factors[index, f] * x
            totals[:, f] = np.bincount(row, scaled, len(rows))
            squares += np.bincount(row, scaled * scaled, len(rows))
        z = offset + np.bincount(row, linear[index] * x, len(rows)) + 0.5 * ((totals**2).sum(1) - squares)
        dz = share * (sigmoid(z) - y)
        pull = dz[row] * x
        d_factors = np.empty_like(factors)
        for f in range(RANK):
            d_factors[:, f] = np.bincount(index, pull * (totals[row, f] - factors[index, f] * x), SIZE)
        linear -= steps[0].step(np.bincount(index, pull, SIZE) + decay * linear)
        factors -= steps[1].step(d_factors + decay * factors)
        offset -= steps[2].step(np.asarray(dz.sum()))
    return Model(float(offset), linear, factors.astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, trained: Column | None = None, most: int = SAMPLE) -> Model:
    """Fit on at most ``most`` labelled documents of at most ``LONGEST`` characters."""
    model = fit(sample(docs, labels, "quality", trained, most, LONGEST, ("text", "n_chars")))
    frames.give_back()
    return model


def score(docs: DataFrame, model: Model, keep: tuple[str, ...]) -> DataFrame:
    """The kept columns with ``score``, the probability of label 1.

    Whole texts are read; a null text counts as empty and a null length has a bin of its own.
    Repeated rows are scored each, and an empty table gives no rows.
    """

    class Work:
        def __init__(self):
            self.bucket = frames.Memo(_bucket, 200_000).__getitem__

        def __call__(self, batch: pa.RecordBatch) -> dict:
            lengths = batch.column("n_chars").to_pylist()
            texts = frames.byte_texts(batch.column("text"))
            z = [model(*features(t, n, self.bucket)) for t, n in zip(texts, lengths)]
            return {"score": pa.array(sigmoid(np.asarray(z, np.float64)))}

    return frames.map_columns(docs.select(*dict.fromkeys([*keep, "text", "n_chars"])), Work, "score double", keep)


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Score of every document, learned from the labels outside the held-out third."""
    docs, labels = frames.table(spark, folder, "documents"), frames.table(spark, folder, "labels")
    model = train(docs, labels, ~frames.in_part(F.col("doc_id"), 3, 1))
    return score(docs, model, ("doc_id",)).select(
        "doc_id",
        frames.in_part(F.col("doc_id"), 3, 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def drop_poor(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: documents scoring under 0.5 go; the columns stay as they are."""
    labels = frames.table(spark, folder, "labels")
    model = train(docs, labels, ~frames.in_part(F.col("doc_id"), 3, 1))
    rows, names = frames.numbered(docs, "text", "n_chars")
    return score(rows, model, tuple(rows.columns)).filter("score >= 0.5").select(*names)
