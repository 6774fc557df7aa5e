"""Incremental graph: a stream of posts adds edge weights, and stops and resumes by itself.

The graph is a folder of weight tables, ``first=a/last=b`` for the sums of batches a to b. A batch
adds a table of its own, and compaction replaces all tables by one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from crowdtide.operators.graph_build import accumulate_weights
from crowdtide.operators.scale import in_tasks
from crowdtide.sources.schemas import EDGES

ROWS_PER_SUM = 1_000_000  # rows that a task sums up


def update_graph(
    posts: DataFrame,
    edges_of: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
) -> StreamingQuery:
    """Start a query that folds all landed posts of the stream into the graph under ``out``.

    ``edges_of`` maps a batch of posts to edges; files of posts are taken in the order they landed.
    Each batch writes its weights to the folder of its number, replacing what a broken attempt left there, and the stream's checkpoint records
    the finished batches; a restart continues with posts that were not processed yet and no
    edge is counted twice.
    """

    def write_batch(batch: DataFrame, number: int) -> None:
        weights = _summed(edges_of(batch))
        weights.write.mode("overwrite").parquet(f"{out}/first={number}/last={number}")

    return (
        posts.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _summed(edges: DataFrame) -> DataFrame:
    """Weights per edge, in tasks that grow in number with the rows and not in memory."""
    return accumulate_weights(in_tasks(edges, "source", "target", rows=ROWS_PER_SUM))


def _tables(spark: SparkSession, out: str) -> tuple[DataFrame, int]:
    """Rows of the tables that count, and the last batch: a sum from 0 on replaces what it covers."""
    rows = spark.read.schema(f"{EDGES}, first long, last long").parquet(out)
    seen = rows.agg(F.max(F.when(F.col("first") == 0, F.col("last"))), F.max("last")).first()
    summed, last = (-1 if n is None else n for n in seen)
    counted = ((F.col("first") == 0) & (F.col("last") == summed)) | (F.col("first") > summed)
    return rows.filter(counted), last


def read_graph(spark: SparkSession, out: str) -> DataFrame:
    """Edge weights summed over all batches."""
    return _summed(_tables(spark, out)[0].select("source", "target", "weight"))


def compact_graph(spark: SparkSession, out: str) -> None:
    """Replace the tables of all finished batches by their sum.

    The sum is written aside and renamed, and only then are the old tables removed; a reader
    never counts a batch twice, and a broken attempt leaves the graph as it was. Not to be run
    while a batch is written.
    """
    rows, last = _tables(spark, out)
    if last < 1:
        return
    old = [r["first"] for r in rows.select("first").distinct().collect()]  # one number per batch since the last sum
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(out).getFileSystem(spark._jsc.hadoopConfiguration())
    aside = f"{out}/_sum-{uuid.uuid4().hex}"
    _summed(rows.select("source", "target", "weight")).write.parquet(aside)
    before = [s.getPath() for s in files.listStatus(path(f"{out}/first=0"))]
    files.rename(path(aside), path(f"{out}/first=0/last={last}"))
    for table in [*before, *(path(f"{out}/first={n}") for n in old if n > 0)]:
        files.delete(table, True)
