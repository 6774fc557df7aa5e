"""Mail messages: files and header fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crowdtide.functions.text import strip_controls


def read_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Every file under ``folder`` as (path, raw); small files are packed into tasks."""
    return (
        spark.read.option("recursiveFileLookup", "true")
        .text(folder, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    )


def header_lines(raw: Column) -> Column:
    """Header fields of a message; a folded field is one entry with its line ends inside."""
    unix = F.regexp_replace(raw, "\r\n?", "\n")
    return F.split(F.substring_index(unix, "\n\n", 1), r"\n(?![ \t])")


def header_field(lines: Column, name: str) -> Column:
    """First field of that name (case ignored) from ``header_lines``, or null."""
    prefix = name.lower() + ":"
    entry = F.get(F.filter(lines, lambda h: F.startswith(F.lower(h), F.lit(prefix))), 0)
    return F.rtrim(
        F.ltrim(F.substr(entry, F.lit(len(prefix) + 1)), F.lit(" \t")), F.lit("\r\n")
    )


def split_recipients(value: Column) -> Column:
    """Addresses between ``', '``, without line ends and tabs."""
    return F.transform(F.split(value, ", "), strip_controls)
