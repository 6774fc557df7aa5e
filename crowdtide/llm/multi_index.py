"""Approximate nearest neighbours by an inverted multi-index.

Unit vectors are cut into two halves, each quantised by its own codebook; a row's cell is its pair
of centroids. A query sorts the centroids of either half by distance and takes the pairs in order
of the summed distance from a heap until the cells hold enough candidates. The candidates are
reranked by the exact cosine of the original vectors.

Different vectors are indexed, each with its members: the smallest ``k + 1`` ids that have it, as no
other copy can be among a query's k best. Copies therefore never fill the cells that a query visits.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from crowdtide.llm import frames, vectors
from crowdtide.scratch import materialize

MOST_CENTROIDS = 64
SAMPLE = 8192
SHARE = 0.45
ROWS_PER_TASK = 4096


@dataclass
class Codebooks:
    """Centroids of the first and second half of unit vectors."""

    first: np.ndarray
    second: np.ndarray

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = unit.shape[1] // 2
        return _squared(unit[:, :half], self.first), _squared(unit[:, half:], self.second)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(1))[:, None]


def k_means(rows: np.ndarray, k: int, rounds: int = 15, seed: int = 17) -> np.ndarray:
    """At most ``k`` centroids of distinct starting rows."""
    rng = np.random.default_rng(seed)
    start = np.unique(rows, axis=0)
    centres = start[rng.permutation(len(start))[:k]].copy()
    for _ in range(rounds):
        nearest = _squared(rows, centres).argmin(1)
        counts = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def train(rows: DataFrame, count: int, sample: int = SAMPLE) -> Codebooks:
    """Codebooks from at most ``sample`` rows chosen by hash of the id."""
    points = unit(np.array(frames.hashed_sample(rows, F.col("vec_id"), "v", sample), np.float64))
    half = points.shape[1] // 2
    k = int(np.clip(round(count**0.5 / 2), 2, MOST_CENTROIDS))
    return Codebooks(k_means(points[:, :half], k), k_means(points[:, half:], k))


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """(vec_id, v, members): every different vector, with at most ``most`` of its ids in order; ``vec_id`` is the first."""
    hashes = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")]
    place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    first = rows.select("vec_id", "v", *hashes).withColumn("place", place).filter(F.col("place") <= most)
    return first.groupBy("h1", "h2").agg(
        F.min("vec_id").alias("vec_id"), F.min("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("members")
    ).drop("h1", "h2")


def assign(rows: DataFrame, books: Codebooks) -> DataFrame:
    """Adds ``c1`` and ``c2``, the nearest centroids of either half, to (vec_id, v, members)."""

    def work(batch: pa.RecordBatch) -> dict:
        v = batch.column("v")
        points = unit(frames.float_rows(v, len(v[0]) if len(v) else 1))
        first, second = books.distances(points)
        return {"c1": pa.array(first.argmin(1)), "c2": pa.array(second.argmin(1))}

    return frames.map_columns(rows, work, "c1 int, c2 int", ("vec_id", "v", "members"))


def traverse(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: int) -> list[tuple[int, int]]:
    """Centroid pairs by summed distance until their cells hold ``wanted`` rows.

    A pair enters the heap when both its predecessors, with one nearer centroid each, are done.
    """
    one, two = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b = first[one].tolist(), second[two].tolist()
    done = np.zeros(len(a), np.int64)  # pairs taken in a row: its next column
    heap, found, total = [(a[0] + b[0], 0, 0)], [], 0
    while heap and total < wanted:
        _, i, j = heapq.heappop(heap)
        found.append((int(one[i]), int(two[j])))
        total += int(counts[one[i], two[j]])
        done[i] = j + 1
        if i + 1 < len(a) and done[i + 1] == j:
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
        if j + 1 < len(b) and (i == 0 or done[i - 1] > j + 1):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
    return found


def _visits(queries: DataFrame, books: Codebooks, counts: np.ndarray, salts: np.ndarray, wanted: int) -> DataFrame:
    """(query_id, v, chunk, c1, salt, cells): the second centroids to visit under each first one."""

    def run(batches):
        for batch in batches:
            v = batch.column("v")
            if not len(v):
                continue
            rows = frames.float_rows(v, len(v[0]))
            first, second = books.distances(unit(rows))
            ids, chunks, made = batch.column("query_id").to_pylist(), batch.column("chunk").to_pylist(), []
            for n, (q, chunk) in enumerate(zip(ids, chunks)):
                by_first: dict[int, list[int]] = {}
                for i, j in traverse(first[n], second[n], counts, wanted):
                    if counts[i, j]:
                        by_first.setdefault(i, []).append(j)
                made += [
                    (q, rows[n].tolist(), chunk, i, s, cells)
                    for i, cells in by_first.items() for s in range(salts[i])
                ]
            columns = ["query_id", "v", "chunk", "c1", "salt", "cells"]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(made, columns=columns), schema=arrow, preserve_index=False)

    arrow = pa.schema([
        ("query_id", pa.int64()), ("v", pa.list_(pa.float64())), ("chunk", pa.int32()), ("c1", pa.int32()),
        ("salt", pa.int32()), ("cells", pa.list_(pa.int32())),
    ])
    return queries.mapInArrow(run, "query_id long, v array<double>, chunk int, c1 int, salt int, cells array<int>")


def _rerank(k: int, most: int = 256):
    """Per group, each query's k best rows of its cells by exact cosine."""

    def run(key, asked, rows):
        made = []
        if len(asked) and len(rows):
            v, cells, members = vectors.matrix(rows["v"]), rows["c2"].to_numpy(), rows["members"].to_numpy()
            norms = np.sqrt((v * v).sum(1))
            for begin in range(0, len(asked), most):
                part = asked.iloc[begin : begin + most]
                near = unit(vectors.matrix(part["v"])) @ (v / norms[:, None]).T
                for n, (q, qv, visit) in enumerate(zip(part["query_id"], part["v"], part["cells"])):
                    places = np.flatnonzero(np.isin(cells, visit))
                    if len(places) > k + 1:  # all that could be among the best beside the query's own, rounding considered
                        close = near[n, places]
                        places = places[close >= np.partition(close, -k - 1)[-k - 1] - 1e-9]
                    w = np.asarray(qv, np.float64)
                    score = (v[places] * w).sum(1) / (norms[places] * np.sqrt((w * w).sum()))
                    ids = np.concatenate([np.zeros(0, np.int64), *members[places]])
                    score = np.repeat(score, [len(members[p]) for p in places])[ids != q]
                    ids = ids[ids != q]
                    for p in vectors.top_of(score, ids, k):
                        made.append((q, ids[p], score[p]))
        return pd.DataFrame(made, columns=["query_id", "vec_id", "score"])

    return run


def search(rows: DataFrame, queries: DataFrame, k: int = 5, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest candidates by cosine, ties to smaller ids.

    ``rows`` has (vec_id, v) and ``queries`` has (query_id, v), non-zero finite vectors of one
    length; a row is no candidate of the query with its own id. A query visits cells until they
    hold ``share`` of all different vectors, and ``k + 1`` at least; a share of 1 makes the search
    exact. Every row is indexed, at every size in the same way; of an id that repeats with one vector, up
    to ``k + 1`` rows are. Rows under a crowded first centroid are salted over several tasks
    and queries are dealt in chunks, so no task grows with the table. An empty table gives no rows.
    """
    rows = materialize(distinct_vectors(rows, k + 1), "vectors")
    count = rows.count()
    if count == 0:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    books = train(rows, count)
    index = materialize(assign(rows, books), "multi-index")
    counts = np.zeros((len(books.first), len(books.second)), np.int64)
    for r in index.groupBy("c1", "c2").count().collect():  # at most MOST_CENTROIDS squared rows
        counts[r["c1"], r["c2"]] = r["count"]
    salts = np.maximum(1, -(-counts.sum(1) // ROWS_PER_TASK))
    asked = queries.count()
    chunked = queries.withColumn("chunk", vectors.query_chunks(queries, asked))
    wanted = max(k + 1, int(np.ceil(share * count)))
    visits = materialize(_visits(chunked, books, counts, salts, wanted), "visits")
    many = F.element_at(F.lit(salts), F.col("c1") + 1)
    keys = ("c1", "salt", "chunk")
    asked_for = materialize(visits.select(*keys).distinct(), "wanted")
    dealt = index.withColumn("salt", F.pmod(F.xxhash64("vec_id"), many).cast("int")).join(asked_for, ["c1", "salt"])
    hits = visits.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(
        _rerank(k), "query_id long, vec_id long, score double"
    )
    return vectors.best(hits, k)


def op1_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    """Five nearest rows of every fiftieth vector; vectors of another length than most have take no part."""
    rows = vectors.usable(frames.table(spark, folder, "embeddings"))
    rows = rows.filter(F.exists("v", lambda x: x != 0))
    return search(rows, vectors.asked(rows, 50))
