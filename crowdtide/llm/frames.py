"""Helpers shared by the operators: columns, splits and Arrow plumbing."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


BATCH_ROWS = 2000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_column() -> Column:
    """The text; a null one counts as empty."""
    return F.coalesce(F.col("text"), F.lit(""))


def in_part(key: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the key as text leaves this remainder; false for a null key."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(parts)) == part, F.lit(False))


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def map_columns(
    df: DataFrame, function: Callable[[pa.RecordBatch], dict], schema: str, keep: tuple[str, ...] = (),
    rows: int = 2000,
) -> DataFrame:
    """Columns made by ``function`` from slices of at most ``rows`` rows, beside those kept.

    ``function`` may be a class: it is then built once per task, so that models load once. Arrow
    batches are held to some thousand rows for the session, as texts can be long.
    """
    spark = df.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keep]
    wanted = spark.createDataFrame([], ", ".join([*kept, schema])).schema
    names = wanted.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = function() if isinstance(function, type) else function
        types = None
        for whole in batches:
            for begin in range(0, whole.num_rows, rows):
                batch = whole.slice(begin, rows)
                made = work(batch)
                arrays = [batch.column(batch.schema.get_field_index(n)) if n in keep else made[n] for n in names]
                if types is None:
                    from pyspark.sql.pandas.types import to_arrow_type

                    types = [to_arrow_type(wanted[n].dataType) for n in names]
                arrays = [a.cast(t) if isinstance(a, pa.Array) else pa.array(a, t) for a, t in zip(arrays, types)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)
        del work
        give_back()

    return df.mapInArrow(run, wanted)


def hashed_sample(rows: DataFrame, key: Column, value: str, most: int) -> list:
    """Values of at most ``most`` different keys, those of the smallest hashes.

    A key that repeats gives its smallest value. Only hashes are compared over all rows, so what
    reaches the driver is bounded however many rows and partitions there are.
    """
    hashed = rows.select(F.xxhash64(key, F.lit(5)).alias("h"), F.col(value).alias("v"))
    last = hashed.select("h").distinct().orderBy("h").limit(most).agg(F.max("h").alias("last")).first()["last"]
    if last is None:
        return []
    chosen = hashed.filter(F.col("h") <= last).groupBy("h").agg(F.min("v").alias("v")).orderBy("h")
    return [r["v"] for r in chosen.collect()]


def numbered(docs: DataFrame, *own: str) -> tuple[DataFrame, list[Column]]:
    """The rows with all columns but ``own`` named c0, c1 and so on, and how to name them back.

    Columns of any name can then stand beside those that an operator makes.
    """
    names = {c: c if c in own else f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), [F.col(n).alias(c) for c, n in names.items()]


def give_back() -> None:
    """Return a worker's freed memory to the system, as workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


class Memo(dict):
    """A bounded table of computed values; it starts anew when full."""

    def __init__(self, function: Callable, most: int = 400_000):
        super().__init__()
        self._function, self._most = function, most

    def __missing__(self, key):
        if len(self) >= self._most:
            self.clear()
        value = self[key] = self._function(key)
        return value


def float_rows(column: pa.Array, dim: int) -> np.ndarray:
    """A matrix of doubles of a list column whose lists all have ``dim`` values."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), dim)
