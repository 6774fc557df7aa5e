"""SimHash near-duplicates through segment popcounts.

A fingerprint's 64 bits are cut into 32 segments of two bits, and the count of ones per segment
is its embedding. One changed bit changes one count by one, so the Manhattan distance of two
embeddings never exceeds the Hamming distance of the fingerprints. The grid cells are the
embeddings' coordinates on some of ``bits + shared`` blocks: points within Manhattan distance ``bits``
differ in at most that many blocks and therefore share the cell of ``shared`` equal blocks. Pairs that
share a cell are filtered by the Manhattan bound and then verified on the fingerprints.

Only different fingerprints enter the join. Cells with more than ``cell`` of them make no pairs;
their members are linked through the points within half the distance, which exactly the close
ones share: ``distance(x, y) <= 2 r`` if and only if some point lies within ``r`` of both. At most
65 fingerprints share such a point at ``r = 1``, so the work stays linear in a group of copies.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from crowdtide.llm import frames
from crowdtide.llm.components import components, with_least
from crowdtide.scratch import materialize

SEED = 42
CELL = 32
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_PLACE = np.uint64(1) << np.arange(64, dtype=np.uint64)


def shingles(text: bytes, words: int) -> list[bytes]:
    """Word shingles with A-Z lowered; the whole sequence if it has fewer words."""
    found = text.lower().split()
    if len(found) <= words:
        return [b" ".join(found)] if found else []
    return list(map(b" ".join, zip(*(found[i:] for i in range(words)))))


def fingerprint(text: bytes, words: int = 3) -> int:
    """64 bits, each set if over half of the shingles' hashes have it."""
    found = shingles(text, words)
    ones = np.zeros(2048, np.int64)
    for begin in range(0, len(found), 1 << 16):
        part = found[begin : begin + (1 << 16)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(SEED)), np.uint64, len(part))
        places = hashes.view(np.uint8).reshape(-1, 8) + (np.arange(8, dtype=np.int64) << 8)
        ones += np.bincount(places.ravel(), minlength=2048)
    counts = (ones.reshape(8, 256) @ _BITS).ravel()
    return int(_PLACE[counts * 2 > len(found)].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, words: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``fp`` (long with the fingerprint's bits)."""

    def work(batch: pa.RecordBatch) -> dict:
        texts = frames.byte_texts(batch.column("text"))
        found = np.array([fingerprint(t, words) for t in texts], np.uint64)
        return {"fp": pa.array(found.view(np.int64))}

    return frames.map_columns(docs.select(*keep, "text"), work, "fp long", keep)


def embedding(fp: Column) -> Column:
    """Ones per two-bit segment, written in unary in the segment: 00, 01 or 11."""
    low = F.lit(0x5555555555555555)
    first, second = fp.bitwiseAND(low), F.shiftrightunsigned(fp, 1).bitwiseAND(low)
    return first.bitwiseOR(second).bitwiseOR(F.shiftleft(first.bitwiseAND(second), 1))


def manhattan(a: Column, b: Column) -> Column:
    """Sum of absolute differences of two embeddings: unary counts differ in that many bits."""
    return F.bit_count(a.bitwiseXOR(b))


def _masks(blocks: int, shared: int) -> list[int]:
    """Masks of every choice of ``shared`` blocks of whole segments, as signed longs."""
    edges = [round(32 * i / blocks) * 2 for i in range(blocks + 1)]
    block = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    masks = [sum(chosen) for chosen in combinations(block, shared)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _ball(fp: Column, radius: int) -> Column:
    """All fingerprints within ``radius`` bits."""
    flips = [sum(1 << i for i in chosen) for r in range(radius + 1) for chosen in combinations(range(64), r)]
    signed = [m - (1 << 64) if m >> 63 else m for m in flips]
    return F.transform(F.lit(np.array(signed, np.int64)), lambda m: fp.bitwiseXOR(m))


def links(distinct: DataFrame, bits: int = 2, cell: int = CELL, shared: int = 2) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints within ``bits``, through chains.

    ``distinct`` has one row per fingerprint in ``fp``; ``bits`` is even. Links to the smallest
    member around a shared point stand for the links within large cells. More ``shared`` blocks
    make smaller cells and more of them per fingerprint. A cell's key is the hash of its blocks and
    counts; cells that share a hash would only be searched together.
    """
    if bits % 2 or not 0 <= bits <= 8:
        raise ValueError("bits must be 0, 2, 4, 6 or 8")
    masks = F.lit(np.array(_masks(bits + shared, shared), np.int64))
    keys = F.transform(masks, lambda m: F.xxhash64(m, embedding(F.col("fp")).bitwiseAND(m)))
    cells = distinct.select("fp", F.explode(keys).alias("key"))
    sizes = cells.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = materialize(cells.join(sizes, "key"), "cells")
    small = members.filter(F.col("n") <= cell).select("key", "fp")
    left, right = small.withColumnRenamed("fp", "a"), small.withColumnRenamed("fp", "b")
    pairs = (
        left.join(right, "key")
        .filter("a < b")
        .filter(manhattan(embedding(F.col("a")), embedding(F.col("b"))) <= bits)
        .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
        .select("a", "b")
    )
    crowded = members.filter(F.col("n") > cell).select("fp").distinct()
    points = crowded.select("fp", F.explode(_ball(F.col("fp"), bits // 2)).alias("point"))
    least = F.min("fp").over(Window.partitionBy("point"))
    stars = points.select(F.col("fp").alias("a"), least.alias("b")).filter("a <> b")
    return pairs.union(stars).distinct()


def groups(
    fps: DataFrame, key: str = "doc_id", bits: int = 2, cell: int = CELL, shared: int = 2
) -> DataFrame:
    """``fps`` with ``component_id``: the smallest key reachable through links, itself included.

    A null key belongs to its group but is never its id; a group of null keys has a null id.
    """
    distinct = materialize(fps.groupBy("fp").agg(F.min(key).alias("least")), "fingerprints")
    found = components(links(distinct.select("fp"), bits, cell, shared))
    labelled = distinct.join(found, distinct["fp"] == found["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root")
    )
    known = with_least(labelled, "root", F.col("least"), "component_id", F.col("fp"))
    named = materialize(known.select("fp", "component_id"), "classes")
    return fps.join(named, "fp")


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """doc_id, fp and component_id of every document.

    Null texts count as empty; documents without words have fingerprint zero and are linked like
    any other. Repeated rows stay rows of one group; other columns are not read. An empty table
    gives no rows.
    """
    fps = materialize(fingerprints(docs.select("doc_id", "text"), words), "fp")
    return groups(fps, "doc_id", bits)


def one_of_each_group(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: of each group of near duplicates, one document stays.

    Groups are those of ``near_duplicates``. The smallest doc_id stays, null ids last; of rows that
    repeat an id, the first in the table stays. Copies meet only as partial sums of their fingerprint.
    """
    rows, names = frames.numbered(docs, "doc_id", "text")
    placed = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    own = fingerprints(placed, keep=("doc_id", "row"))
    distinct = materialize(own.groupBy("fp").agg(F.min(rank).alias("best")), "fingerprints")
    found = components(links(distinct.select("fp")))
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left")
    kept = rooted.groupBy(F.coalesce("component", "fp").alias("root")).agg(F.min("best").alias("best"))
    return placed.join(kept.select(F.col("best.row").alias("row")), "row", "left_semi").select(*names)


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and group of every document."""
    found = near_duplicates(frames.table(spark, folder, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
