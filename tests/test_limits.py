"""What once was cut off silently: rounds, exponents, draws, texts without known terms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from crowdtide.functions import zeta
from crowdtide.operators import bayes, datasets, graph_build, graph_metrics, powerlaw, stats

EDGES = [("a", "b", 1), ("b", "c", 2), ("c", "a", 1), ("c", "d", 3), ("d", "a", 1), ("e", "a", 5)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "source string, target string, weight long")


def test_ranks_that_do_not_settle_are_an_error(edges):
    with pytest.raises(graph_metrics.NotConvergedError):
        graph_metrics.pagerank(edges, max_rounds=2, tol=1e-14)
    with pytest.raises(graph_metrics.NotConvergedError):
        graph_metrics.hits(edges, max_rounds=1, tol=1e-14)


def test_exponents_are_not_cut_at_the_bracket():
    assert np.isnan(zeta.best_gamma(np.array([7.0]), np.array([50.0]), np.array([50 * np.log(7.0)]))[0])
    # nearly all of the tail at its start: an exponent far above 20
    values, counts = np.array([100.0, 101.0]), np.array([900.0, 100.0])
    sizes, logs = zeta.tail_sizes(values, counts)
    gamma = zeta.best_gamma(values[:1], sizes[:1], logs[:1])[0]
    assert 150 < gamma < 400
    loss = lambda g: np.log(zeta.scaled_hurwitz(g, 100.0)) + g * (logs[0] / sizes[0] - np.log(100.0))
    assert loss(gamma) < min(loss(gamma - 0.01), loss(gamma + 0.01))


def test_draws_go_on_beyond_exact_doubles():
    u = np.array([0.5, 0.99999])
    gamma = 1.3
    got = zeta.draw(u, gamma, 1).astype(float)
    assert got[0] < 2**52 < got[1] < 2**63
    assert np.isclose(zeta.hurwitz(gamma, got[1]) / zeta.hurwitz(gamma, 1.0), 1 - u[1], rtol=1e-3)
    with pytest.raises(OverflowError):
        zeta.draw(np.array([0.9999999]), 1.05, 1)


def test_draws_with_large_exponents():
    u = np.random.default_rng(3).random(1000)
    got = zeta.draw(u, 300.0, 500)
    tail = lambda k: (k / 500.0) ** -300.0 * zeta.scaled_hurwitz(300.0, k) / zeta.scaled_hurwitz(300.0, 500.0)
    assert ((tail(got + 1.0) < 1 - u) & (1 - u <= tail(got.astype(float)) + 1e-12)).all()
    values, counts = powerlaw._draw_tail(np.random.default_rng(4), 5000, 300.0, 500)
    assert counts.sum() == 5000 and values.min() == 500


def test_candidates_of_one_fit_run_in_several_tasks(spark):
    rows = spark.range(400).select(F.col("id").cast("string").alias("id"), (F.col("id") + 1).alias("degree"))
    fits = powerlaw.candidate_fits(powerlaw.histogram_row(graph_metrics.degree_histogram(rows)))
    tasks = fits.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 3 and fits.count() > 390


def test_chance_of_a_fit_bounds_both_sides(spark):
    """With a bound below the best start, the observed distance is that of the bounded fit."""
    degrees = [1] * 40 + [2] * 15 + [3] * 9 + [50] * 40 + [70] * 12 + [100] * 8 + [300] * 2
    rows = spark.createDataFrame([(str(i), d) for i, d in enumerate(degrees)], "id string, degree long")
    bounded = powerlaw.fit_power_law(rows, 3).first()
    chance = powerlaw.bootstrap_pvalue(rows, 5, xmax=3).first()
    assert bounded["xmin"] <= 3 and chance["ks"] == bounded["ks"]


def test_texts_without_known_terms_get_the_usual_class(spark):
    features = spark.createDataFrame([("1", "x", 1.0), ("2", "y", 1.0), ("3", "y", 2.0)], "id string, term string, w double")
    labels = spark.createDataFrame([("1", 0), ("2", 1), ("3", 1)], "id string, target int")
    fitted = bayes.multinomial_fit(features, labels)
    new = spark.createDataFrame([("4", "x", 1.0), ("5", "unseen", 1.0)], "id string, term string, w double")
    ids = spark.createDataFrame([("4",), ("5",), ("6",)], "id string")
    got = {r["id"]: r["prediction"] for r in bayes.term_predict(new, fitted, bayes.class_priors(labels), ids).collect()}
    assert got == {"4": 0, "5": 1, "6": 1}


def test_rows_without_a_time_belong_to_no_day(spark):
    rows = spark.createDataFrame([("2024-01-01", 1.0), ("2024-01-01", 3.0), (None, 9.0)], "d string, v double")
    rows = rows.select(F.col("d").cast("timestamp_ntz").alias("t"), "v")
    assert stats.daily_stats(rows, "t", ["v"]).count() == stats.join_stats(rows, "t", ["v"]).count() == 1


def test_running_progress_keeps_every_answer(spark):
    answers = spark.createDataFrame([("a", "0", 1), ("b", "4", 2), ("c", "1", 3), ("d", "3", 4)], "id string, answer string, answered_at long")
    got = [(r["annotated"], r["negatives"]) for r in datasets.annotation_progress_running(answers).orderBy("answered_at").collect()]
    assert got == [(1, 1), (1, 1), (2, 1), (2, 1)]


def test_long_names_skip_the_lookup(spark):
    long_name = "n" * 60
    tweets = spark.createDataFrame([("1", f"@bob and @{long_name} and @nobody")], "UserID string, Content string")
    users = spark.createDataFrame([("9", "Bob")], "id string, Username string")
    got = {(r["source"], r["target"], r["weight"]) for r in graph_build.mention_edges(tweets, users).collect()}
    assert got == {("1", "9", 1), ("1", long_name, 1)}
