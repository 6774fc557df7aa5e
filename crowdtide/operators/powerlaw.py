"""Discrete power laws: fits, bootstraps and samples.

A fit needs only the histogram of degrees, which has at most about √(2·edges) rows, so the
histogram travels as one row of arrays. The replicates of a bootstrap, and the candidate
starts of one fit, are the rows that Spark spreads; numpy works inside the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from crowdtide.functions.zeta import best_gamma, draw, ks_distances, scaled_hurwitz, tail_sizes
from crowdtide.operators.graph_metrics import degree_histogram, degrees
from crowdtide.operators.scale import digest_uniform
from crowdtide.scratch import materialize

CANDIDATES_PER_ROW = 64  # of one histogram, whose rows are spread over tasks
CANDIDATES_PER_REPLICATE = 4_096  # of a replicate, which lies in one task: numpy is slow on short arrays
FIT = "xmin long, gamma double, ks double, ntail long"


def histogram_row(histogram: DataFrame) -> DataFrame:
    """(values, counts): the histogram(k, n) as two arrays in order of k."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col("k").cast("long").alias("k"), F.col("n").cast("long").alias("n"))))
    return histogram.agg(pairs.alias("p")).select(
        F.transform("p", lambda x: x["k"]).alias("values"),
        F.transform("p", lambda x: x["n"]).alias("counts"),
    )


def _fit_candidates(values: np.ndarray, counts: np.ndarray, first: int, last: int):
    """Fits for the candidate starts ``values[first:last]``: (xmin, gamma, ks, ntail)."""
    sizes, log_sums = tail_sizes(values, counts)
    picked = slice(first, last)
    gammas = best_gamma(values[picked], sizes[picked], log_sums[picked])
    fine = ~np.isnan(gammas)  # where no exponent fits the tail there is no fit
    starts, gammas = np.arange(first, last)[fine], gammas[fine]
    for i, gamma, ks in zip(starts, gammas, ks_distances(values, counts, starts, gammas)):
        yield int(values[i]), float(gamma), float(ks), int(sizes[i])


def _candidate_count(values: np.ndarray, xmax: int | None) -> int:
    """Candidate starts: all values but the last, whose tail has a single value."""
    usable = max(len(values) - 1, 1)
    if xmax is not None:
        usable = min(usable, max(int(np.searchsorted(values, xmax, side="right")), 1))
    return usable


def candidate_fits(histograms: DataFrame, xmax: int | None = None) -> DataFrame:
    """Fits of every candidate start of every row (…, values, counts).

    The candidates of a row are cut into chunks. A single histogram is written, and its chunk
    numbers are spread over tasks that each get a copy; the rows of a bootstrap are spread already.
    """
    keys = [c for c in histograms.columns if c not in ("values", "counts")]
    most = CANDIDATES_PER_REPLICATE if keys else CANDIDATES_PER_ROW
    chunks = F.floor((F.size("values") - 1) / most).cast("int")
    if keys:
        rows = histograms.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks)))
    else:
        spark = histograms.sparkSession
        histograms = materialize(histograms, "histogram")
        count = (histograms.select(chunks.alias("last")).first()["last"] or 0) + 1
        whole = histograms.select(F.struct("values", "counts").alias("h")).scalar()
        rows = spark.range(0, count, 1, count).select(F.col("id").cast("int").alias("chunk"), whole.alias("h"))
        rows = rows.select("chunk", "h.values", "h.counts")
    key_types = {n: t for n, t in histograms.dtypes}
    schema = ", ".join([*[f"`{k}` {key_types[k]}" for k in keys], FIT])

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                values = np.asarray(row.values_, float)
                counts = np.asarray(row.counts_, float)
                first = row.chunk * most
                last = min(first + most, _candidate_count(values, xmax))
                if first < last:
                    head = [getattr(row, k) for k in keys]
                    out += [[*head, *f] for f in _fit_candidates(values, counts, first, last)]
            yield pd.DataFrame(out, columns=[*keys, "xmin", "gamma", "ks", "ntail"])

    named = rows.select(
        *keys, "chunk", F.col("values").alias("values_"), F.col("counts").alias("counts_")
    )
    return named.mapInPandas(fit, schema)


def _closest(fits: DataFrame, keys: list[str]) -> DataFrame:
    """The fit with the least distance per key, the smallest start on ties."""
    best = F.min(F.struct("ks", "xmin", "gamma", "ntail")).alias("b")
    return fits.groupBy(*keys).agg(best).select(*keys, "b.xmin", "b.gamma", "b.ks", "b.ntail")


def fit_power_law(degree_rows: DataFrame, xmax: int | None = None) -> DataFrame:
    """One row (xmin, gamma, ks, ntail): exponents by likelihood, the start by KS distance."""
    row = histogram_row(degree_histogram(degree_rows))
    return _closest(candidate_fits(row, xmax), [])


def _replicates(histogram: DataFrame, n_sims: int) -> DataFrame:
    """(sim, values, counts): the histogram beside every replicate number, spread over tasks."""
    spark = histogram.sparkSession
    row = materialize(histogram_row(histogram), "histogram")
    whole = row.select(F.struct("values", "counts").alias("h")).scalar()
    parts = min(n_sims, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    return (
        spark.range(0, n_sims, 1, parts)
        .select(F.col("id").alias("sim"), whole.alias("h"))
        .select("sim", "h.values", "h.counts")
    )


REPLICATE = "sim long, values array<long>, counts array<long>"


def _redraw(replicates: DataFrame, make) -> DataFrame:
    """Replace each replicate's histogram by ``make(sim, values, counts)``."""

    def redraw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for sim, values, counts in zip(batch["sim"], batch["values"], batch["counts"]):
                new_values, new_counts = make(int(sim), np.asarray(values), np.asarray(counts))
                kept = new_counts > 0
                out.append([sim, new_values[kept].astype("int64"), new_counts[kept].astype("int64")])
            yield pd.DataFrame(out, columns=["sim", "values", "counts"])

    return replicates.mapInPandas(redraw, REPLICATE)


def bootstrap_fit(
    degree_rows: DataFrame, n_sims: int = 1000, seed: int = 42, xmax: int | None = None
) -> DataFrame:
    """(sim, xmin, gamma, ks, ntail) of refits on degrees drawn with replacement.

    Drawing n values with replacement is one multinomial draw over the histogram.
    """

    def resample(sim: int, values: np.ndarray, counts: np.ndarray):
        rng = np.random.default_rng([seed, sim])
        total = counts.sum()
        return values, rng.multinomial(total, counts / total)

    sims = _redraw(_replicates(degree_histogram(degree_rows), n_sims), resample)
    return _closest(candidate_fits(sims, xmax), ["sim"])


def bootstrap_spread(fits: DataFrame) -> DataFrame:
    """Sample standard deviations of xmin and gamma over the replicates."""
    return fits.agg(
        F.stddev_samp("xmin").alias("xmin_sd"),
        F.stddev_samp("gamma").alias("gamma_sd"),
        F.count(F.lit(1)).alias("sims"),
    )


def bootstrap_pvalue(
    degree_rows: DataFrame, n_sims: int = 1000, seed: int = 42, xmax: int | None = 500
) -> DataFrame:
    """(ks, p): share of synthetic data sets that fit no better than the data.

    A synthetic set draws each value from the data below xmin or from the fitted law, in the
    proportion of the data, and is refitted; both fits take starts up to ``xmax``.
    """
    fitted = materialize(fit_power_law(degree_rows, xmax), "fit")
    xmin, gamma, observed = fitted.select("xmin", "gamma", "ks").first()  # one row of three numbers

    def synthesize(sim: int, values: np.ndarray, counts: np.ndarray):
        rng = np.random.default_rng([seed, sim])
        below = values < xmin
        total = counts.sum()
        in_body = rng.binomial(total, counts[below].sum() / total)
        body = np.zeros(0, int)
        if in_body:
            body = rng.multinomial(in_body, counts[below] / counts[below].sum())
        tail_values, tail_counts = _draw_tail(rng, int(total - in_body), gamma, xmin)
        return (
            np.concatenate([values[below] if in_body else values[:0], tail_values]),
            np.concatenate([body, tail_counts]),
        )

    sims = _redraw(_replicates(degree_histogram(degree_rows), n_sims), synthesize)
    refits = _closest(candidate_fits(sims, xmax), ["sim"])
    return refits.agg(
        F.lit(float(observed)).alias("ks"),
        F.avg((F.col("ks") >= observed).cast("double")).alias("p"),
        F.count(F.lit(1)).alias("sims"),
    )


def _draw_tail(rng, size: int, gamma: float, xmin: int, table: int = 65_536):
    """Histogram of ``size`` power-law draws.

    The counts of the first ``table`` integers are drawn at once, whatever the size; values
    beyond them are drawn one by one, a share of about ``table ** (1 - gamma)`` of the sample.
    """
    head = np.arange(xmin, xmin + table)
    chances = (head / xmin) ** -float(gamma) / scaled_hurwitz(gamma, float(xmin))
    beyond = max(0.0, 1.0 - chances.sum())
    drawn = rng.multinomial(size, np.append(chances, beyond) / (chances.sum() + beyond))
    values, counts = np.unique(draw(rng.random(drawn[-1]), gamma, xmin + table), return_counts=True)
    return np.concatenate([head, values]), np.concatenate([drawn[:-1], counts])


def sample_power_law(spark: SparkSession, n: int, gamma: float, kmin: int, seed: int = 42) -> DataFrame:
    """(id, k): n draws; the draw of a row depends on its id and the seed only."""
    return draw_power_law(spark.range(n), "id", gamma, kmin, seed)


def draw_power_law(rows: DataFrame, id_col: str, gamma: float, kmin: int, seed: int = 42) -> DataFrame:
    """Add a power-law draw ``k`` to every row."""

    @F.pandas_udf("long")
    def inverse(u: pd.Series) -> pd.Series:
        return pd.Series(draw(u.to_numpy(), gamma, kmin))

    return rows.withColumn("k", inverse(digest_uniform(seed, F.col(id_col))))


def bootstrap_histogram(fits: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """(bin, lo, hi, n): equal bins from the least to the largest value; the last is closed."""
    span = fits.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    spot = F.when(
        width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))
    ).otherwise(0)
    counted = (
        fits.select(F.col(col).cast("double").alias("v"))
        .filter("v IS NOT NULL")
        .withColumn("s", span.select(F.struct("lo", "hi")).scalar())
        .select("v", "s.lo", "s.hi")
        .groupBy(spot.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    frame = (
        span.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
        .select(
            "bin",
            (F.col("lo") + F.col("bin") * width).alias("_lo"),
            (F.col("lo") + (F.col("bin") + 1) * width).alias("_hi"),
        )
    )
    return frame.join(counted, "bin", "left").select(
        "bin", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.coalesce("n", F.lit(0)).alias("n")
    )


def fit_report(
    edges: DataFrame, n_sims: int = 1000, seed: int = 42, modes: tuple[str, ...] = ("in", "out", "all")
) -> DataFrame:
    """One row per kind of degree: xmin ± sd, gamma ± sd, p value."""
    report = None
    for mode in modes:
        rows = materialize(degrees(edges, mode), "degrees")
        spread = bootstrap_spread(bootstrap_fit(rows, n_sims, seed))
        chance = bootstrap_pvalue(rows, n_sims, seed)
        one = (
            fit_power_law(rows)
            .withColumn("_s", spread.select(F.struct("xmin_sd", "gamma_sd")).scalar())
            .select(
                F.lit(mode).alias("degree"),
                "xmin",
                F.col("_s.xmin_sd").alias("xmin_sd"),
                "gamma",
                F.col("_s.gamma_sd").alias("gamma_sd"),
                "ks",
                chance.select("p").scalar().alias("p"),
            )
        )
        report = one if report is None else report.unionByName(one)
    return report
