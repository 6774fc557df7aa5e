"""Naive Bayes as aggregations over long-form features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from crowdtide.scratch import materialize

# --- multinomial and complement, on (id, term, w) with labels(id, target) -----------------


def term_class_weights(features: DataFrame, labels: DataFrame) -> DataFrame:
    """(target, term, w): summed weights of every term in every class."""
    return (
        features.join(labels.select("id", "target"), "id")
        .groupBy("target", "term")
        .agg(F.sum("w").alias("w"))
    )


def _grid(sums: DataFrame, labels: DataFrame) -> DataFrame:
    """All (term, target) pairs with their weight, 0 where the class lacks the term.

    The classes are few, so every term row carries their list and is exploded once.
    """
    classes = labels.agg(F.array_sort(F.collect_set("target"))).scalar()
    by_term = sums.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("target", "w"))).alias("_m"))
    return by_term.select("term", F.explode(classes).alias("target"), "_m").select(
        "term", "target", F.coalesce(F.try_element_at("_m", F.col("target")), F.lit(0.0)).alias("w")
    )


def multinomial_fit(features: DataFrame, labels: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(target, term, logp): smoothed log probability of every term in every class."""
    sums = materialize(term_class_weights(features, labels), "weights")
    terms = sums.agg(F.count_distinct("term")).scalar()
    totals = sums.groupBy("target").agg(F.sum("w").alias("_all"))
    share = (F.col("w") + alpha) / (F.col("_all") + alpha * terms)
    return _grid(sums, labels).join(totals, "target").select("target", "term", F.ln(share).alias("logp"))


def complement_fit(features: DataFrame, labels: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(target, term, logp): minus the smoothed log probability outside the class."""
    sums = materialize(term_class_weights(features, labels), "weights")
    terms = sums.agg(F.count_distinct("term")).scalar()
    everything = sums.agg(F.sum("w")).scalar()
    of_term = sums.groupBy("term").agg(F.sum("w").alias("_term"))
    of_class = sums.groupBy("target").agg(F.sum("w").alias("_class"))
    share = (F.col("_term") - F.col("w") + alpha) / (everything - F.col("_class") + alpha * terms)
    return (
        _grid(sums, labels)
        .join(of_term, "term")
        .join(of_class, "target")
        .select("target", "term", (-F.ln(share)).alias("logp"))
    )


def class_priors(labels: DataFrame) -> DataFrame:
    n = labels.agg(F.count(F.lit(1))).scalar()
    return labels.groupBy("target").agg(F.count(F.lit(1)).alias("_n")).select(
        "target", F.ln(F.col("_n") / n).alias("prior")
    )


def term_predict(
    features: DataFrame, fitted: DataFrame, priors: DataFrame | None = None, ids: DataFrame | None = None
) -> DataFrame:
    """(id, prediction) for all of ``ids``; equal scores go to the smaller class.

    Without ``ids``, those with a feature are meant. A text without a known term gets the class
    with the largest prior, or the smallest class without priors.
    """
    if priors is None:
        priors = fitted.select("target").distinct().withColumn("prior", F.lit(0.0))
    priors = materialize(priors, "priors")
    classes = priors.filter("target IS NOT NULL").groupBy("target").agg(F.max("prior").alias("prior")).orderBy("target").collect()
    # A term is one row with a number per class, so its uses meet it once and are summed as they come.
    logp = [F.max(F.when(F.col("target") == F.lit(c["target"]), F.col("logp"))).alias(f"_l{n}") for n, c in enumerate(classes)]
    of_term = materialize(fitted.groupBy("term").agg(F.count(F.lit(1)).alias("_rows"), *logp), "term-scores")
    sums = [F.sum(F.col("w") * F.col(f"_l{n}")).alias(f"_s{n}") for n in range(len(classes))]
    scores = features.join(of_term, "term").groupBy("id").agg(F.count(F.lit(1)).alias("_rows"), *sums)
    kind = priors.schema["target"].dataType
    ways = [F.lit(None).cast(f"struct<s:double,target:{kind.simpleString()}>")] + [
        F.when(
            F.col(f"_s{n}").isNotNull(),
            F.struct((-(F.col(f"_s{n}") + F.lit(c["prior"]))).alias("s"), F.lit(c["target"]).cast(kind).alias("target")),
        )
        for n, c in enumerate(classes)
    ]
    chosen = scores.select("id", F.array_min(F.array(*ways))["target"].alias("prediction"))
    usual = priors.agg(F.min(F.struct((-F.col("prior")).alias("s"), "target"))["target"]).scalar()
    everyone = (features if ids is None else ids).select("id").distinct()
    return everyone.join(chosen, "id", "left").select("id", F.coalesce("prediction", usual).alias("prediction"))


# --- Gaussian, on array columns -----------------------------------------------------------


def gaussian_moments(df: DataFrame, target: str, col: str) -> DataFrame:
    """(target, dim, n, mean, var) with population variances."""
    cells = df.select(F.col(target).alias("target"), F.posexplode(col).alias("dim", "x"))
    x = F.col("x").cast("double")
    return cells.groupBy("target", "dim").agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("var")
    )


def gaussian_fit(df: DataFrame, target: str, col: str, var_smoothing: float = 4e-4) -> DataFrame:
    """One row ``params``: array of (target, prior, means, vars) over the classes.

    Every variance gets ``var_smoothing`` times the largest variance of any dimension over all
    rows. The row holds classes × dimensions numbers, whatever the number of rows.
    """
    moments = gaussian_moments(df, target, col)
    n = df.agg(F.count(F.lit(1))).scalar()
    spread = (
        df.select(F.posexplode(col).alias("dim", "x"))
        .groupBy("dim")
        .agg(F.var_pop(F.col("x").cast("double")).alias("v"))
        .agg(F.max("v"))
        .scalar()
    )
    per_class = (
        moments.groupBy("target")
        .agg(
            F.max("n").alias("n"),
            F.array_sort(F.collect_list(F.struct("dim", "mean", "var"))).alias("m"),
        )
        .withColumn("_spread", spread)
        .select(
            "target",
            F.ln(F.col("n") / n).alias("prior"),
            F.transform("m", lambda d: d["mean"]).alias("means"),
            F.transform("m", lambda d: d["var"] + F.lit(var_smoothing) * F.col("_spread")).alias("vars"),
        )
    )
    return per_class.agg(
        F.array_sort(F.collect_list(F.struct("target", "prior", "means", "vars"))).alias("params")
    )


def _log_density(x: Column, c: Column) -> Column:
    pairs = F.arrays_zip(x.alias("x"), c["means"].alias("m"), c["vars"].alias("v"))
    half = F.lit(0.5)
    return c["prior"] - half * F.aggregate(
        pairs,
        F.lit(0.0),
        lambda total, p: total
        + F.ln(F.lit(6.283185307179586) * p["v"])
        + (p["x"].cast("double") - p["m"]) * (p["x"].cast("double") - p["m"]) / p["v"],
    )


def gaussian_predict(df: DataFrame, fitted: DataFrame, col: str, out: str = "prediction") -> DataFrame:
    """Add the likeliest class; scored row by row, without join or shuffle."""
    scored = df.withColumn("_p", fitted.scalar()).withColumn(
        "_s",
        F.transform("_p", lambda c: F.struct((-_log_density(F.col(col), c)).alias("s"), c["target"].alias("t"))),
    )
    return scored.withColumn(out, F.array_min("_s")["t"]).drop("_p", "_s")
