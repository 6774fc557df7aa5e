"""Folds, splits, resampling and classification metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from crowdtide.operators.scale import hash_rank, ordered_index, uniform
from crowdtide.scratch import materialize

# --- folds and splits ---------------------------------------------------------------------


def _class_sizes(df: DataFrame, target: str) -> DataFrame:
    """(target, _n, _before): size of each class and number of rows in smaller classes' labels."""
    before = W.orderBy("_t").rowsBetween(W.unboundedPreceding, -1)  # one row per class
    sizes = materialize(df.groupBy(F.col(target).alias("_t")).agg(F.count(F.lit(1)).alias("_n")), "classes")
    return sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def stratified_kfold(
    df: DataFrame, target: str, id_col: str = "id", k: int = 5, seed: int = 42, shuffle: bool = True
) -> DataFrame:
    """Add ``fold`` (0 … k−1) so that every fold has each class's share.

    Rows are thought of as sorted by class; place p of that order belongs to fold p mod k.
    Shuffled, a row's place in its class is random; otherwise the rows of a class fill its
    folds in order of id.
    """
    sizes = _class_sizes(df, target)
    if shuffle:
        placed = hash_rank(df, [target], id_col, seed, "_r")
        joined = placed.join(sizes, F.col(target).eqNullSafe(F.col("_t")))
        fold = F.pmod(F.col("_before") + F.col("_r"), F.lit(k)).cast("int")
        return joined.withColumn("fold", fold).drop("_r", "_t", "_n", "_before")
    numbered = ordered_index(df, [F.col(target), F.col(id_col)], "_p")
    joined = numbered.join(sizes, F.col(target).eqNullSafe(F.col("_t")))
    # Rows of the class in fold i: the places ≡ i (mod k) from _before to _before + _n − 1.
    share = lambda i: (
        F.floor((F.col("_before") + F.col("_n") - 1 - i + k) / k) - F.floor((F.col("_before") - 1 - i + k) / k)
    )
    place = F.col("_p") - F.col("_before")
    passed, fold = F.lit(0), F.lit(0)
    for i in range(k - 1):
        passed = passed + share(i)
        fold = fold + F.when(place >= passed, 1).otherwise(0)
    return joined.withColumn("fold", fold.cast("int")).drop("_p", "_t", "_n", "_before")


def train_val_split(
    df: DataFrame, target: str, id_col: str = "id", test_size: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``split``: "val" for the rounded share ``test_size`` of each class, else "train"."""
    placed = hash_rank(df, [target], id_col, seed, "_r")
    joined = placed.join(_class_sizes(df, target), F.col(target).eqNullSafe(F.col("_t")))
    is_val = F.col("_r") < F.round(F.col("_n") * test_size)
    return joined.withColumn("split", F.when(is_val, "val").otherwise("train")).drop(
        "_r", "_t", "_n", "_before"
    )


def bootstrap_resample(
    df: DataFrame, target: str, id_col: str = "id", frac: float = 1.0, seed: int = 42, member: int = 0
) -> DataFrame:
    """Draw each class's rounded share ``frac`` with replacement; seed and member set the draw.

    Draw number j of a class takes a uniform place in the class. Draws are made per row of the
    class (each row makes its share of them), counted per place, and joined to the places.
    """
    sizes = _class_sizes(df, target).select("_t", "_n")
    placed = hash_rank(df, [target], id_col, seed, "_r")
    joined = placed.join(sizes, F.col(target).eqNullSafe(F.col("_t"))).drop("_t")
    wanted = F.round(F.col("_n") * frac).cast("long")
    # Row r makes the draws j with j ≡ r (mod n).
    mine = F.floor((wanted - 1 - F.col("_r")) / F.col("_n")) + 1
    draws = joined.select(
        F.col(target).alias("_dt"), "_r", "_n",
        F.explode(F.when(mine > 0, F.sequence(F.lit(0).cast("long"), mine.cast("long") - 1))).alias("_j"),
    ).select(
        "_dt",
        F.floor(
            uniform(seed, F.lit(member), F.col("_dt"), F.col("_r"), F.col("_j")) * F.col("_n")
        ).alias("_place"),
    )
    times = draws.groupBy("_dt", "_place").agg(F.count(F.lit(1)).alias("_times"))
    matched = joined.join(
        times, F.col(target).eqNullSafe(F.col("_dt")) & (F.col("_r") == F.col("_place"))
    )
    return matched.withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select(
        *df.columns, "draw"
    )


# --- targets and probabilities ------------------------------------------------------------


def one_hot(target: Column, classes: int) -> Column:
    return F.array(*[(target == c).cast("double") for c in range(classes)])


def label_smoothing(target: Column, classes: int, epsilon: float) -> Column:
    """One-hot target with ``epsilon`` of its mass spread evenly over the classes."""
    return F.transform(one_hot(target, classes), lambda y: y * (1 - epsilon) + epsilon / classes)


def average_probabilities(rows: DataFrame, id_col: str = "id", col: str = "probability") -> DataFrame:
    """Mean of the members' probability arrays per id, as an array."""
    means = (
        rows.select(id_col, F.posexplode(col).alias("class", "p"))
        .groupBy(id_col, "class")
        .agg(F.avg("p").alias("p"))
    )
    return means.groupBy(id_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("class", "p"))), lambda x: x["p"]).alias(col)
    )


# --- metrics ------------------------------------------------------------------------------


def confusion(df: DataFrame, true: str = "target", pred: str = "prediction", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, class, tp, fp, fn): every row counts for its true and for its predicted class."""
    t, p = F.col(true).cast("string"), F.col(pred).cast("string")
    counted = df.groupBy(*keys, t.alias("_t"), p.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    hit = F.col("_t") == F.col("_p")
    roles = F.when(hit, F.array(_role("_t", "tp"))).otherwise(F.array(_role("_t", "fn"), _role("_p", "fp")))
    rows = counted.select(*keys, "_n", F.explode(roles).alias("_e")).select(*keys, "_n", "_e.*")
    return rows.groupBy(*keys, "class").agg(
        *[
            F.sum(F.when(F.col("role") == r, F.col("_n")).otherwise(0)).alias(r)
            for r in ("tp", "fp", "fn")
        ]
    )


def _role(col: str, role: str) -> Column:
    return F.struct(F.col(col).alias("class"), F.lit(role).alias("role"))


def fbeta(beta: float = 1.0) -> Column:
    """F-beta of a class from tp, fp, fn; 0 when there is nothing to measure."""
    b = beta * beta
    top = (1 + b) * F.col("tp")
    return F.coalesce(F.try_divide(top, top + b * F.col("fn") + F.col("fp")), F.lit(0.0))


METRICS: dict[str, Callable[[], Column]] = {
    # Aggregates over the per-class counts.
    "Accuracy": lambda: F.sum("tp") / F.sum(F.col("tp") + F.col("fn")),
    "F1_macro": lambda: F.avg(fbeta()),
    "F1_weighted": lambda: F.sum(fbeta() * (F.col("tp") + F.col("fn"))) / F.sum(F.col("tp") + F.col("fn")),
    "F_0.5 macro": lambda: F.avg(fbeta(0.5)),
}


def metric_table(
    df: DataFrame,
    true: str = "target",
    pred: str = "prediction",
    keys: tuple[str, ...] = (),
    metrics: dict[str, Callable[[], Column]] | None = None,
) -> DataFrame:
    """One column per metric and one row per key; more metrics can be passed in."""
    chosen = METRICS if metrics is None else metrics
    return confusion(df, true, pred, keys).groupBy(*keys).agg(
        *[build().alias(name) for name, build in chosen.items()]
    )


def accuracy(df: DataFrame, true: str = "target", pred: str = "prediction") -> DataFrame:
    return df.agg(F.avg((F.col(true) == F.col(pred)).cast("double")).alias("Accuracy"))


def fold_summary(folds: DataFrame, names: tuple[str, ...] = tuple(METRICS)) -> DataFrame:
    """Mean and population standard deviation of every metric over the folds."""
    quoted = [(n, F.col(f"`{n}`")) for n in names]
    return folds.agg(
        *[a for n, c in quoted for a in (F.avg(c).alias(n), F.stddev_pop(c).alias(f"{n}_stddev"))]
    )


def append_results(summary: DataFrame, path: str, name: str, description: str) -> None:
    """Add the summary as a row of the result log; the log is created when absent."""
    row = summary.select(F.lit(name).alias("Name"), F.lit(description).alias("Decsription"), "*")
    row.write.mode("append").parquet(path)


def read_results(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)
