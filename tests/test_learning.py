import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from crowdtide.operators import bayes as B
from crowdtide.operators import evaluate as E
from crowdtide.operators import models as M
from crowdtide.operators import sentiment as N
from crowdtide.operators import stats as A


def test_metrics_hand_case(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 0)], "target int, prediction int")
    row = E.metric_table(rows).first()
    assert row["Accuracy"] == pytest.approx(0.6)
    assert row["F1_macro"] == pytest.approx(0.433333, abs=1e-6)
    assert row["F1_weighted"] == pytest.approx(0.52)
    assert row["F_0.5 macro"] == pytest.approx(0.404762, abs=1e-6)
    extra = E.metric_table(rows, metrics={"classes": lambda: F.count(F.lit(1))})
    assert extra.first()["classes"] == 3


def _labels(spark, n=203):
    target = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 7 == 0, 2).otherwise(1)
    return spark.range(n).select(F.col("id").cast("string").alias("id"), target.alias("target"))


@pytest.mark.parametrize("shuffle", [True, False])
def test_folds_keep_class_shares(spark, shuffle):
    rows = _labels(spark)
    folds = E.stratified_kfold(rows, "target", k=5, shuffle=shuffle).groupBy("target", "fold").count().collect()
    sizes = {r["target"]: r["count"] for r in rows.groupBy("target").count().collect()}
    assert len(folds) == 15
    for row in folds:
        assert abs(row["count"] - sizes[row["target"]] / 5) < 1
    totals = [sum(r["count"] for r in folds if r["fold"] == f) for f in range(5)]
    assert max(totals) - min(totals) <= 1


def test_split_and_resample(spark):
    rows = _labels(spark)
    split = {(r["target"], r["split"]): r["count"] for r in E.train_val_split(rows, "target").groupBy("target", "split").count().collect()}
    for target in range(3):
        n = split[target, "val"] + split[target, "train"]
        assert abs(split[target, "val"] - 0.2 * n) <= 0.5
    for frac in (0.5, 1.0, 2.3):
        drawn = E.bootstrap_resample(rows, "target", frac=frac)
        got = {r["target"]: r["count"] for r in drawn.groupBy("target").count().collect()}
        for target in range(3):
            n = split[target, "val"] + split[target, "train"]
            assert abs(got[target] - frac * n) <= 0.5
    assert drawn.select("id").distinct().count() < drawn.count()
    ids = lambda member: sorted(r["id"] for r in E.bootstrap_resample(rows, "target", member=member).collect())
    assert ids(0) == ids(0) and ids(0) != ids(1)


def test_sentiment_hand_cases(spark):
    posts = spark.createDataFrame(
        [("2021-01-01", "positive", 6.0), ("2021-01-01", "negative", 2.0), ("2021-01-01", "neutral", 2.0),
         ("2021-01-03", "positive", 0.0), ("2021-01-04", "negative", 5.0)],
        "d string, sentiment string, score double",
    ).withColumn("datetime", F.col("d").cast("timestamp_ntz"))
    got = [r["score"] for r in N.daily_sentiment(posts).orderBy("day").collect()]
    assert got == [pytest.approx(0.4), 0.0, None, -1.0]
    with pytest.raises(Exception, match="no sentiment for label 3"):
        spark.range(3, 4).select(N.label_name(F.col("id"))).collect()


def test_column_stats_hand_case(spark):
    row = A.column_stats(spark.range(4).select(F.col("id").alias("x")), ["x"]).first()
    assert tuple(row) == ("x", 1.5, pytest.approx(1.290994, abs=1e-6), 0.75, 1.5, 2.25, 3.0)


def _blobs(spark, n=240):
    """Three separated groups of points."""
    noise = lambda seed: F.randn(seed) * 0.3
    rows = spark.range(0, n, 1, 2).select(
        F.col("id").cast("string").alias("id"), F.pmod("id", F.lit(3)).cast("int").alias("target"),
        noise(1).alias("a"), noise(2).alias("b"),
    )
    point = F.array(F.col("target") * 2.0 + F.col("a"), F.pmod(F.col("target"), F.lit(2)) * 3.0 + F.col("b"))
    return rows.select("id", "target", point.alias("point")).cache()


def test_gaussian_bayes(spark):
    rows = _blobs(spark)
    scored = B.gaussian_predict(rows, B.gaussian_fit(rows, "target", "point"), "point")
    assert E.accuracy(scored).first()[0] > 0.95


@pytest.mark.parametrize(
    "learner, options",
    [
        (M.svm, {"components": 60, "max_iter": 20}),
        (M.random_forest, {"n_estimators": 5}),
        (M.gradient_boosting, {"n_estimators": 3}),
        (M.adaboost, {"n_estimators": 4, "learning_rate": 1.0, "max_features": 1.0, "max_depth": 1}),
        (M.mlp_ensemble, {"n_models": 2, "layers": (6,), "epochs": 60}),
    ],
)
def test_learners_separate_blobs_and_are_stored(spark, tmp_path, learner, options):
    rows = _blobs(spark).withColumn("features", array_to_vector("point"))
    model = learner(rows, **options)
    scored = model.transform(rows)
    assert E.accuracy(scored).first()[0] > 0.9
    M.save_pipeline(spark, None, model, str(tmp_path / "m"))
    stored = M.load_pipeline(spark, str(tmp_path / "m")).transform(rows)
    answers = lambda df: sorted((r["id"], r["prediction"]) for r in df.select("id", "prediction").collect())
    assert answers(stored) == answers(scored)
    if learner is M.adaboost:
        assert len(model.votes) > 1 and all(v > 0 for v in model.votes)


def test_naive_bayes_agrees_with_library(spark):
    from crowdtide.operators import features as Fe

    docs = spark.createDataFrame(
        [("1", "good good fine", 1), ("2", "bad awful", 0), ("3", "good fine", 1), ("4", "awful bad bad", 0)],
        "id string, text string, target int",
    )
    counts = Fe.term_counts(docs).withColumn("w", F.col("tf").cast("double"))
    for fit, priors in ((B.multinomial_fit, B.class_priors(docs)), (B.complement_fit, None)):
        got = {r["id"]: r["prediction"] for r in B.term_predict(counts, fit(counts, docs), priors).collect()}
        assert got == {"1": 1, "2": 0, "3": 1, "4": 0}


def test_cross_validation_and_storage(spark, tmp_path):
    words = F.when(F.col("target") == 0, "bad awful loss").when(F.col("target") == 1, "good gain moon").otherwise("news report today")
    docs = _labels(spark, 120).withColumn("text", F.concat_ws(" ", words, F.concat(F.lit("w"), F.pmod(F.col("id").cast("int"), F.lit(5)).cast("string"))))
    folds, models = M.cross_validate(
        docs, M.naive_bayes_multinomial, feature_options={"min_df": 2, "ngram_range": (1, 1)}, k=3, keep_models=True
    )
    rows = folds.collect()
    assert [r["fold"] for r in sorted(rows)] == [0, 1, 2] and all(r["Accuracy"] == 1.0 for r in rows)
    features, model = M.best_fold_model(folds, models)
    M.save_pipeline(spark, features, model, str(tmp_path / "m"))
    loaded = M.load_pipeline(spark, str(tmp_path / "m"))
    new = spark.createDataFrame([("good moon",), ("awful loss",)], "text string")
    assert [r["sentiment"] for r in N.predict_all(loaded, new).collect()] == ["positive", "negative"]


def test_best_fold_is_the_best(spark):
    folds = spark.createDataFrame([(0, 0.2), (1, 0.9), (2, 0.9)], "fold int, F1_macro double")
    assert M.best_fold_model(folds, ["a", "b", "c"]) == "b"
