"""Tables written to the shared checkpoint folder to cut lineage between rounds.

A written table survives the loss of executors, is computed once, and gives Catalyst the
file sizes it needs to choose joins.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """Shared folder named by the session; a local folder only for a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="crowdtide-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _job_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/crowdtide/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, label: str) -> str:
    """Path of a folder that does not exist yet."""
    return f"{_job_folder(spark)}/{label}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Remove everything this application wrote; frames built on it can no longer be read."""
    _remove(spark, _job_folder(spark))


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` as parquet in the scratch folder and read it back."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Rounds:
    """Written tables of an iteration; a table is removed once ``kept`` newer ones exist."""

    def __init__(self, spark: SparkSession, label: str, kept: int = 2):
        self._spark = spark
        self._kept = kept
        self._base = new_folder(spark, label)
        self._paths: list[str] = []

    def write(self, df: DataFrame, **totals: Column) -> tuple[DataFrame, Row | None]:
        """Write ``df``; also return one row of aggregates over the written table."""
        path = f"{self._base}/{len(self._paths)}"
        schema = df.schema
        df.write.parquet(path)
        self._paths.append(path)
        if len(self._paths) > self._kept:
            _remove(self._spark, self._paths[-self._kept - 1])
        table = self._spark.read.schema(schema).parquet(path)
        found = table.agg(*[c.alias(n) for n, c in totals.items()]).first() if totals else None
        return table, found
