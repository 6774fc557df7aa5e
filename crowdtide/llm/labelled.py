"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from crowdtide.llm import frames


@dataclass
class Sample:
    """Texts with labels 0 or 1 and the weights that restore the classes' shares."""

    rows: list
    labels: np.ndarray
    weights: np.ndarray

    def __len__(self) -> int:
        return len(self.rows)


def sample(
    docs: DataFrame, labels: DataFrame, column: str, trained: Column | None, most: int, longest: int | None,
    columns: tuple[str, ...] = ("text",), characters: int | None = None,
) -> Sample:
    """At most ``most`` labelled documents, half of each class where there are enough.

    ``trained`` tells which labels may be learned from; without it, all may. Documents above ``longest`` characters are not sampled, if it is given. With
    ``characters``, a class has at most half as many in all; in the order of the choice, a document that does
    not fit in what is left is passed over, whatever its length. The choice is by hash of the id, so
    it is the same on every run. Null ids and labels are ignored; a document labelled twice
    has its larger label, and of rows that repeat an id the smallest text is taken. An empty table gives an
    empty sample.
    """
    known = (
        labels.filter(F.lit(True) if trained is None else trained)
        .filter(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max(column).cast("int").alias("label"))
    )
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    order = F.xxhash64("doc_id", F.lit(7))
    chosen = [known.filter(F.col("label") == c).orderBy(order).limit(most // 2) for c in (0, 1)]
    ids = chosen[0].union(chosen[1])
    if characters is not None:
        ids = _fitting(docs, ids, order, characters // 2)
    texts = docs.select("doc_id", *columns)
    if longest is not None:
        texts = texts.filter(F.length(F.coalesce("text", F.lit(""))) <= longest)
    # the ids are at most ``most`` by construction, and an id that repeats becomes one row before it travels
    own = F.min(F.struct(*columns)).alias("own")
    found = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(own).select("doc_id", "label", "own.*")
    found = found.toPandas().sort_values("doc_id", kind="stable")
    y = found["label"].to_numpy(np.float64)
    weights = np.ones(len(y))
    for c in (0, 1):
        if (y == c).any():
            weights[y == c] = totals[c] / (y == c).sum()
    weights /= weights.mean() if len(weights) else 1.0
    rows = list(found[list(columns)].itertuples(index=False, name=None))
    del found
    frames.give_back()
    return Sample(rows, y, weights)


def _fitting(docs: DataFrame, ids: DataFrame, order: Column, characters: int) -> DataFrame:
    """The ids, class by class in order, whose texts fit into so many characters."""
    length = F.max(F.length(F.coalesce("text", F.lit("")))).alias("n")
    # the ids are at most ``most`` rows by construction
    sizes = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(length)
    left, kept = {0: characters, 1: characters}, []
    for r in sizes.orderBy(order, "doc_id").collect():
        if r["n"] <= left[r["label"]]:
            left[r["label"]] -= r["n"]
            kept.append((r["doc_id"], r["label"]))
    return ids.sparkSession.createDataFrame(kept, ids.schema)


class Adam:
    """Adam steps for one array."""

    def __init__(self, shape, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(shape), np.zeros(shape), 0, rate

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.01 * (gradient * gradient - self.v)
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
