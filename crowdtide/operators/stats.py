"""Descriptive statistics and time series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from crowdtide.operators.scale import quantile_name, quantiles


def day_of(time_col: str) -> Column:
    return F.to_date(F.col(time_col))


def month_of(time_col: str) -> Column:
    return F.trunc(F.col(time_col), "MM")


def _volume_and_means(cols: Sequence[str]) -> list[Column]:
    return [F.count(F.lit(1)).alias("vol"), *[F.avg(c).alias(f"{c}_mean") for c in cols]]


def daily_stats(df: DataFrame, time_col: str, cols: Sequence[str], fill: bool = False) -> DataFrame:
    """Rows and column means per calendar day, optionally with all days in between as zeros.

    Rows without a time belong to no day.
    """
    stats = df.filter(F.col(time_col).isNotNull()).groupBy(day_of(time_col).alias("day")).agg(*_volume_and_means(cols))
    return fill_calendar(stats, "day") if fill else stats


def monthly_stats(df: DataFrame, time_col: str, cols: Sequence[str]) -> DataFrame:
    """Rows with a time, and column means, per month, named by its first day."""
    return df.filter(F.col(time_col).isNotNull()).groupBy(month_of(time_col).alias("month")).agg(*_volume_and_means(cols))


def daily_quantiles(
    df: DataFrame, time_col: str, cols: Sequence[str], probs: Sequence[float] = (0.25, 0.75), **sizes: int
) -> DataFrame:
    """Exact quantiles per day; see ``scale.quantiles`` for large days."""
    days = df.select(day_of(time_col).alias("day"), *cols)
    return quantiles(days, ["day"], cols, probs, **sizes)


def join_stats(
    df: DataFrame, time_col: str, cols: Sequence[str], probs: Sequence[float] = (0.25, 0.75), **sizes: int
) -> DataFrame:
    """Volume, means and quantiles per day; rows without a time belong to no day."""
    days = df.filter(F.col(time_col).isNotNull()).select(day_of(time_col).alias("day"), *cols)
    means = {"vol": F.count(F.lit(1)), **{f"{c}_mean": F.avg(c) for c in cols}}
    return quantiles(days, ["day"], cols, probs, also=means, **sizes)


def calendar_days(stats: DataFrame, day_col: str = "day") -> DataFrame:
    """Every day from the first to the last one in ``stats``."""
    span = stats.agg(F.min(day_col).alias("lo"), F.max(day_col).alias("hi"))
    return span.filter("lo IS NOT NULL").select(
        F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias(day_col)
    )


def fill_calendar(stats: DataFrame, day_col: str = "day") -> DataFrame:
    """One row per day from the first to the last, numbers of missing days as 0."""
    present = stats.withColumn("_present", F.lit(True))
    joined = calendar_days(stats, day_col).join(present, day_col, "left")
    numbers = [c for c in stats.columns if c != day_col]
    return joined.select(
        day_col, *[F.when(F.col("_present"), F.col(c)).otherwise(0).alias(c) for c in numbers]
    )


def column_stats(df: DataFrame, cols: Sequence[str], **sizes: int) -> DataFrame:
    """One row per column: mean, sample standard deviation, quartiles and maximum."""
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    basic = {}
    for c in cols:
        basic |= {f"{c}_mean": F.avg(c), f"{c}_std": F.stddev_samp(c), f"{c}_max": F.max(c)}
    quarters = (0.25, 0.5, 0.75)
    found = quantiles(numbers, [], cols, quarters, also=basic, **sizes)
    parts = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"{c}_mean").alias("mean"),
            F.col(f"{c}_std").alias("std"),
            *[F.col(quantile_name(c, p)).alias(f"q{round(p * 100)}") for p in quarters],
            F.col(f"{c}_max").alias("max"),
        )
        for c in cols
    ]
    return found.select(F.inline(F.array(*parts)))


def stack_metrics(*tables: DataFrame) -> DataFrame:
    stacked = tables[0]
    for table in tables[1:]:
        stacked = stacked.unionByName(table)
    return stacked


def count_by(df: DataFrame, key: str, id_col: str = "id") -> DataFrame:
    """Non-null ids per group."""
    return df.groupBy(key).agg(F.count(id_col).alias("n"))


def share_pct(counts: DataFrame, col: str = "n", digits: int = 1) -> DataFrame:
    """Percent of the total; the total is a one-row subquery."""
    total = counts.agg(F.sum(col)).scalar()
    return counts.withColumn("pct", F.round(100 * F.col(col) / total, digits))


def log_color_norm(df: DataFrame, col: str, out: str = "norm", **sizes: int) -> DataFrame:
    """Logarithmic position between max(1, first quartile) and the maximum.

    Values that are not positive have no logarithm and get null.
    """
    quarter = quantiles(df.select(col), [], [col], [0.25], **sizes)
    low = quarter.select(F.greatest(F.lit(1.0), F.col(quantile_name(col, 0.25)))).scalar()
    high = df.agg(F.max(col).cast("double")).scalar()
    value = F.col(col).cast("double")
    span = F.ln(high) - F.ln(low)
    return df.withColumn(out, F.when(value > 0, F.try_divide(F.ln(value) - F.ln(low), span)))


def linear_color_norm(df: DataFrame, col: str, out: str = "norm") -> DataFrame:
    """Position between the minimum and the maximum."""
    low = df.agg(F.min(col).cast("double")).scalar()
    high = df.agg(F.max(col).cast("double")).scalar()
    return df.withColumn(out, F.try_divide(F.col(col) - low, high - low))


def graph_size(edges: DataFrame) -> DataFrame:
    """Numbers of nodes and of edges."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"))
    nodes = ends.distinct().agg(F.count(F.lit(1)).alias("nodes"))
    count = edges.agg(F.count(F.lit(1)).alias("edges")).scalar()
    return nodes.withColumn("edges", count)
