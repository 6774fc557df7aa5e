"""Exact search for the largest inner products with M-trees.

Inner products become distances by one more coordinate: with ``M`` the largest norm of all rows, a
row ``x`` is stored as ``(x, sqrt(M^2 - |x|^2))`` and a query as ``(q, 0)``; then
``d^2 = |q|^2 + M^2 - 2 <q, x>``, so the nearest rows are those of the largest products.

Rows are dealt to their nearest of some pivots, and each block is stored as the pages of an M-tree:
every page has a routing object, a covering radius and its distance to the parent's routing object,
and leaves hold their rows with the distances to the routing object. A search takes pages from a
heap by the smallest possible distance of any query that may still find something there, and works
on a page for all these queries at once. The stored distances bound others by the triangle
inequality, ``|d(q, parent) - d(parent, x)| <= d(q, x)``, so that pages and rows beyond the
k-th best are dismissed without computing a distance.

Scores are integers. Where products can pass the 53 bits of a double, doubles only choose the rows
that could be among the best, rounding considered, and these are multiplied as 64-bit integers.

A query first searches the block of its nearest pivot; the k-th best score found there then rules
out whole blocks. Blocks travel only to the chunks of queries that want them.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from crowdtide.llm import frames, vectors
from crowdtide.scratch import materialize

PAGE = 128
FAN = 16
BLOCK = 4096
MOST_PIVOTS = 1024
EXACT, LONGEST = float(1 << 52), float(1 << 63)
PAGES = (
    "block int, salt int, page int, parent int, radius double, apart double, centre binary, "
    "ids binary, points binary, distances binary"
)


def _distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    gap = points - centre
    return np.sqrt((gap * gap).sum(1))


@dataclass
class Page:
    """A node: routing object, covering radius, distance to the parent; leaves also have rows."""

    parent: int
    centre: np.ndarray
    radius: float
    apart: float
    rows: np.ndarray | None
    distances: np.ndarray | None


def build(points: np.ndarray, page: int = PAGE, fan: int = FAN) -> list[Page]:
    """Pages of an M-tree over the rows, parents before children."""
    pages: list[Page] = []
    todo = [(np.arange(len(points)), -1, 0)]
    while todo:
        rows, parent, centre = todo.pop()
        routing = points[centre]
        distances = _distances(points[rows], routing)
        apart = 0.0 if parent < 0 else float(_distances(routing[None], pages[parent].centre)[0])
        number = len(pages)
        leaf = len(rows) <= page or distances.max() == 0
        pages.append(
            Page(parent, routing, float(distances.max()), apart, rows if leaf else None, distances if leaf else None)
        )
        if leaf:
            continue
        # routing objects far from each other, then every row to its nearest
        chosen, nearest, owner = [], np.full(len(rows), np.inf), np.zeros(len(rows), np.int64)
        candidate = int(distances.argmax())
        while len(chosen) < fan and nearest[candidate] > 0:
            away = _distances(points[rows], points[rows[candidate]])
            closer = away < nearest
            owner[closer], nearest = len(chosen), np.minimum(nearest, away)
            chosen.append(int(rows[candidate]))
            candidate = int(nearest.argmax())
        todo += [(rows[owner == i], number, c) for i, c in enumerate(chosen)]
    return pages


def _between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``a`` to all of ``b``."""
    squares = (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)
    return np.sqrt(np.maximum(squares, 0.0))


class Best:
    """The k rows of largest score found so far of every query, ties to smaller ids."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.full(queries, -np.inf)
        self.query, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        query, score, ids = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, ~score, query))  # ~ turns the order round without overflow
        query, score, ids = query[order], score[order], ids[order]
        begins = np.flatnonzero(np.diff(query, prepend=-1))
        place = np.arange(len(query)) - np.repeat(begins, np.diff(np.append(begins, len(query))))
        kept = place < self.k
        self.query, self.score, self.id = query[kept], score[kept], ids[kept]
        last = place == self.k - 1
        self.least[query[last]] = score[last]


class Tree:
    """Pages of a block ready for search; ``opened`` counts the pages that a search looked into."""

    opened = 0

    def __init__(self, pages: pd.DataFrame, dim: int):
        pages = pages.sort_values("page")
        self.parent, self.radius = pages["parent"].to_numpy(), pages["radius"].to_numpy()
        self.apart = pages["apart"].to_numpy()
        self.centres = np.frombuffer(b"".join(pages["centre"]), np.float64).reshape(-1, dim)
        self.ids = [np.frombuffer(x, np.int64) for x in pages["ids"]]
        self.points = [np.frombuffer(x, np.float64).reshape(-1, dim) for x in pages["points"]]
        self.distances = [np.frombuffer(x, np.float64) for x in pages["distances"]]
        children: list[list[int]] = [[] for _ in self.parent]
        for n, p in enumerate(self.parent):
            if p >= 0:
                children[p].append(n)
        self.children = [np.array(c, np.int64) for c in children]

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, limits: np.ndarray, top: float) -> Best:
        """The k best rows of every query within its distance limit.

        ``queries`` have zero as last coordinate and ``own`` are their ids. A page or row is dismissed only
        when it is surely farther than the k-th best, whatever the distances' rounding.
        """
        lengths = (queries * queries).sum(1) + top
        slack = 1e-6 * (1 + np.sqrt(lengths))
        limits = limits + slack
        best = Best(len(queries), k)
        # above 53 bits, scores of doubles are near the true ones only
        doubt = np.where((lengths - top) * top < EXACT * EXACT, 0.0, 1e-12 * np.sqrt(lengths - top) * top**0.5)
        everyone = np.arange(len(queries))
        away = _between(queries, self.centres[:1])[:, 0]
        heap = [(0.0, 0, everyone, np.maximum(away - self.radius[0], 0.0), away)]
        while heap:
            _, page, asked, low, away = heapq.heappop(heap)
            still = low <= limits[asked]
            asked, away = asked[still], away[still]
            if not len(asked):
                continue
            self.opened += 1
            inner = self.children[page]
            if len(inner):
                possible = np.abs(away[:, None] - self.apart[inner]) - self.radius[inner] <= limits[asked][:, None]
                some = np.flatnonzero(possible.any(1))
                to_child = _between(queries[asked[some]], self.centres[inner])
                lows = np.maximum(to_child - self.radius[inner], 0.0)
                fits = possible[some] & (lows <= limits[asked[some]][:, None])
                for n in np.flatnonzero(fits.any(0)):
                    who = fits[:, n]
                    heapq.heappush(heap, (float(lows[who, n].min()), int(inner[n]), asked[some][who], lows[who, n], to_child[who, n]))
                continue
            near = np.abs(away[:, None] - self.distances[page]) <= limits[asked][:, None]
            rows = np.flatnonzero(near.any(0))
            if not len(rows):
                continue
            ids, points = self.ids[page][rows], self.points[page][rows]
            scores = queries[asked] @ points.T  # the queries' last coordinate is zero
            scores[~near[:, rows] | (ids == own[asked][:, None])] = -np.inf
            least = np.maximum(best.least[asked], np.partition(scores, -k, 1)[:, -k] if len(rows) > k else -np.inf)
            which, row = np.nonzero((scores >= (least - 2 * doubt[asked])[:, None]) & (scores > -np.inf))
            if not len(which):
                continue
            if doubt.any():
                if np.abs(scores[which, row]).max() >= LONGEST:
                    raise OverflowError("a score does not fit 64 bits")
                whole = (queries[asked[which], :-1].astype(np.int64) * points[row, :-1].astype(np.int64)).sum(1)
            else:
                whole = scores[which, row].astype(np.int64)
            best.add(asked[which], whole, ids[row])
            full = best.least[asked] > -np.inf
            reached = np.sqrt(np.maximum(lengths[asked] - 2 * np.where(full, best.least[asked], 0.0), 0.0)) + slack[asked]
            limits[asked] = np.where(full, np.minimum(limits[asked], reached), limits[asked])
        return best


def _store(page: int, fan: int):
    def run(key, rows):
        points, ids = vectors.matrix(rows["x"]), rows["vec_id"].to_numpy(np.int64)
        none = b""
        made = [
            (
                key[0], key[1], n, p.parent, p.radius, p.apart, p.centre.tobytes(),
                *((none,) * 3 if p.rows is None else (ids[p.rows].tobytes(), points[p.rows].tobytes(), p.distances.tobytes())),
            )
            for n, p in enumerate(build(points, page, fan))
        ]
        names = [c.split()[0] for c in PAGES.split(", ")]
        return pd.DataFrame(made, columns=names)

    return run


def _searched(k: int, top: float, dim: int):
    def run(key, asked, pages):
        made = Best(0, k)
        ids = asked["query_id"].to_numpy(np.int64)
        if len(asked) and len(pages):
            queries = np.hstack([vectors.matrix(asked["x"]), np.zeros((len(asked), 1))])
            lengths, floors = (queries * queries).sum(1) + top, asked["floor"].to_numpy(np.float64)
            limits = np.where(np.isnan(floors), np.inf, np.sqrt(np.maximum(lengths - 2 * np.nan_to_num(floors), 0.0)))
            made = Tree(pages, dim).search(queries, ids, k, limits, top)
        return pd.DataFrame({"query_id": ids[made.query], "vec_id": made.id, "score": made.score})

    return run


def _nearest(pivots: np.ndarray):
    """Adds the number and distance of the nearest pivot to rows with ``x``."""

    def work(batch: pa.RecordBatch) -> dict:
        x = batch.column("x")
        points = frames.float_rows(x, pivots.shape[1])
        blocks, away = np.empty(len(points), np.int32), np.empty(len(points))
        for begin in range(0, len(points), 256):
            part = points[begin : begin + 256]
            squares = (part * part).sum(1)[:, None] - 2 * part @ pivots.T + (pivots * pivots).sum(1)
            blocks[begin : begin + 256] = squares.argmin(1)
        for b in np.unique(blocks):
            away[blocks == b] = _distances(points[blocks == b], pivots[b])
        return {"block": pa.array(blocks), "away": pa.array(away)}

    return work


def search(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query, ties to smaller ids.

    ``rows`` has (vec_id, x) and ``queries`` has (query_id, x), vectors of whole numbers of one
    length, given as doubles; scores that do not fit 64 bits are an error. A row is no candidate of the query with its own
    id; repeated rows are candidates each. Crowded blocks are salted into several trees, and queries
    are dealt in chunks; the only things on the driver are at most ``MOST_PIVOTS`` pivots and their
    radii. An empty table gives no rows.
    """
    spark = rows.sparkSession
    norm = F.aggregate("x", F.lit(0.0), lambda a, x: a + x * x)
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("top"), F.max(F.size("x")).alias("dim")).first()
    count, top = facts["n"], facts["top"]
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    raised = rows.select("vec_id", F.concat("x", F.array(F.sqrt(F.greatest(F.lit(top) - norm, F.lit(0.0))))).alias("x"))
    pivot_count = min(MOST_PIVOTS, -(-count // BLOCK))
    chosen = frames.hashed_sample(raised, F.col("vec_id"), "x", pivot_count)
    pivots = np.unique(np.array(chosen, np.float64), axis=0)
    placed = materialize(frames.map_columns(raised, _nearest(pivots), "block int, away double", ("vec_id", "x")), "blocks")
    blocks = {r["block"]: r for r in placed.groupBy("block").agg(F.count("x").alias("n"), F.max("away").alias("r")).collect()}
    salts = np.array([max(1, -(-blocks[b]["n"] // BLOCK)) if b in blocks else 1 for b in range(len(pivots))])
    radii = np.array([blocks[b]["r"] if b in blocks else -np.inf for b in range(len(pivots))])
    salt = F.pmod(F.xxhash64("vec_id", F.col("x")[0]), F.element_at(F.lit(salts), F.col("block") + 1)).cast("int")
    pages = materialize(
        placed.withColumn("salt", salt).groupBy("block", "salt").applyInPandas(_store(PAGE, FAN), PAGES), "pages"
    )
    asked = queries.count()
    queries = queries.withColumn("chunk", vectors.query_chunks(queries, asked))
    keys = ("block", "salt", "chunk")

    def hits(routed: DataFrame) -> DataFrame:
        salted = routed.withColumn(
            "salt", F.explode(F.sequence(F.lit(0), F.element_at(F.lit(salts), F.col("block") + 1).cast("int") - 1))
        )
        wanted = materialize(salted.select(*keys).distinct(), "wanted")
        dealt = pages.join(wanted, ["block", "salt"])
        found = salted.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(
            _searched(k, top, pivots.shape[1]), "query_id long, vec_id long, score long"
        )
        return materialize(found, "hits")

    known = [(b, pivots[b]) for b in range(len(pivots)) if b in blocks]
    numbers, centres, reach = np.array([b for b, _ in known]), np.array([c for _, c in known]), radii[[b for b, _ in known]]

    def distances_to(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        points = np.hstack([frames.float_rows(batch.column("x"), pivots.shape[1] - 1), np.zeros((len(batch), 1))])
        squares = (points * points).sum(1)[:, None] - 2 * points @ centres.T + (centres * centres).sum(1)
        return np.sqrt(np.maximum(squares, 0)), (points * points).sum(1)

    def home(batch: pa.RecordBatch) -> dict:
        away, _ = distances_to(batch)
        return {"block": pa.array(numbers[away.argmin(1)].astype(np.int32))}

    homes = materialize(frames.map_columns(queries, home, "block int", ("query_id", "x", "chunk")), "homes")
    first = hits(homes.withColumn("floor", F.lit(None).cast("double")))
    floors = vectors.best(first, k).filter(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("floor"))

    def others(batch: pa.RecordBatch) -> dict:
        away, length = distances_to(batch)
        floor = np.array([-np.inf if f is None else f for f in batch.column("floor").to_pylist()])
        limit = np.sqrt(np.maximum(length + top - 2 * floor, 0))
        slack = 1e-6 * (1 + np.sqrt(length + top))
        open_ = away - reach <= (limit + slack)[:, None]
        at_home = np.array(batch.column("home").to_pylist())
        return {"blocks": pa.array([[int(b) for b in numbers[o] if b != h] for o, h in zip(open_, at_home)])}

    bounded = homes.withColumnRenamed("block", "home").join(floors, "query_id", "left")
    routed = frames.map_columns(bounded, others, "blocks array<int>", ("query_id", "x", "chunk", "floor"))
    second = hits(routed.withColumn("block", F.explode("blocks")).drop("blocks"))
    return vectors.best(first.union(second), k)


def op8_mtree(spark: SparkSession, folder: str) -> DataFrame:
    """Five largest inner products of every fiftieth vector, components as floor(256 x).

    Vectors of another length than most have take no part.
    """
    rows = vectors.usable(frames.table(spark, folder, "embeddings"))
    rows = rows.select("vec_id", F.transform("v", lambda x: F.floor(x * 256).cast("double")).alias("v"))
    queries = vectors.asked(rows, 50).withColumnRenamed("v", "x")
    return search(rows.withColumnRenamed("v", "x"), queries)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
