"""Vectors that take part in a search, and the best hits of a query."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

QUERIES_PER_TASK = 4096


def usable(df: DataFrame, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors of doubles without null or non-finite components, of one length.

    Null ids and vectors take no part, nor do vectors of another length than most have (on
    ties, the longer one). Other columns are dropped.
    """
    v = F.transform(F.col(column), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & fine
    )
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.filter(F.size("v") == (sizes["n"] if sizes else 0))


def asked(rows: DataFrame, every: int) -> DataFrame:
    """(query_id, v) of the rows whose id is divisible; a repeated id asks with its smallest vector."""
    chosen = rows.filter(F.col("vec_id") % every == 0)
    return chosen.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))


def query_chunks(queries: DataFrame, count: int) -> Column:
    """Chunk of a query, so that no task holds more than some thousand of them."""
    return F.pmod(F.xxhash64("query_id", F.lit(3)), F.lit(max(1, -(-count // QUERIES_PER_TASK)))).cast("int")


def best(hits: DataFrame, k: int) -> DataFrame:
    """The k rows of largest score per query; ties go to the smaller id. Adds ``rank`` from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def matrix(column) -> np.ndarray:
    """Rows of a pandas column of lists as a matrix of doubles."""
    return np.array(column.tolist(), dtype=np.float64)


def top_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]
