"""Classifiers on Spark ML, cross-validation, grids and storage.

Learners take a frame with a vector column ``features`` and a numeric ``target`` and return a
model whose ``transform`` adds ``prediction``.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from crowdtide.operators.evaluate import bootstrap_resample, metric_table, stratified_kfold, train_val_split
from crowdtide.operators import terms
from crowdtide.operators.kernels import Landmarks, cell_spread, choose
from crowdtide.operators.sentiment import argmax_class
from crowdtide.operators.terms import TermModel, TextFeatures
from crowdtide.operators.network import NetworkEnsemble, train_networks
from crowdtide.operators.pruning import prune_forest
from crowdtide.scratch import Rounds, materialize

FEATURES, TARGET = "features", "target"
TREES_PER_PLAN = 25  # voting trees in one plan
DRAWS_PER_TASK = 10_000_000  # draws (rows times trees) of a forest that a task holds
DEEPEST = 30  # the depth that Spark's trees can have
LEARNED_PER_TASK = 50_000  # rows that a task of an iterative learner holds


# --- library learners ---------------------------------------------------------------------


def naive_bayes_multinomial(train: DataFrame, alpha: float = 1.0) -> TermModel:
    return terms.multinomial(train, alpha, TARGET)


def naive_bayes_complement(train: DataFrame, alpha: float = 0.1) -> TermModel:
    return terms.complement(train, alpha, TARGET)


def naive_bayes_gaussian(train: DataFrame, var_smoothing: float = 4e-4) -> TermModel:
    return terms.gaussian(train, var_smoothing, TARGET)


def random_forest(
    train: DataFrame,
    n_estimators: int = 500,
    min_samples_leaf: int = 2,
    criterion: str = "gini",
    max_features: float = 0.3,
    ccp_alpha: float = 0.0,
    max_depth: int = DEEPEST,
    bootstrap: bool = True,
    seed: int = 42,
):
    """Forest of trees, as deep as Spark grows them (30), cut back by cost and complexity if wanted.

    Spark keeps a row's draws for all trees beside it, so large tables are dealt to more tasks.
    """
    tasks = -(-train.count() * n_estimators // DRAWS_PER_TASK)
    if tasks > train.rdd.getNumPartitions():
        train = train.repartition(tasks)
    forest = RandomForestClassifier(
        numTrees=n_estimators, minInstancesPerNode=min_samples_leaf, impurity=criterion,
        featureSubsetStrategy=str(float(max_features)), maxDepth=max_depth, bootstrap=bootstrap, seed=seed,
        featuresCol=FEATURES, labelCol=TARGET,
    ).fit(train)
    return prune_forest(forest, ccp_alpha) if ccp_alpha > 0 else forest


def gradient_boosting(
    train: DataFrame,
    n_estimators: int = 200,
    min_samples_leaf: int = 2,
    learning_rate: float = 0.5,
    max_features: float = 0.3,
    max_depth: int = 3,
    seed: int = 42,
):
    """Boosted trees, one model per class (Spark's boosted trees know two classes).

    Every tree passes over all rows some times, so a small file of many rows is dealt to more tasks.
    """
    tasks = -(-train.count() // LEARNED_PER_TASK)
    if tasks > train.rdd.getNumPartitions():
        train = train.repartition(tasks)
    boosted = GBTClassifier(
        maxIter=n_estimators, minInstancesPerNode=min_samples_leaf, stepSize=learning_rate,
        featureSubsetStrategy=str(max_features), maxDepth=max_depth, seed=seed,
        featuresCol=FEATURES, labelCol=TARGET,
    )
    return OneVsRest(classifier=boosted, parallelism=4, featuresCol=FEATURES, labelCol=TARGET).fit(train)


# --- support vectors with a radial kernel -------------------------------------------------


@dataclass
class KernelSvmModel:
    """Linear model per class on a radial kernel's features by landmarks."""

    inner: Any
    landmarks: Landmarks

    def transform(self, df: DataFrame) -> DataFrame:
        return self.inner.transform(self.landmarks.features(df, FEATURES, "_kernel")).drop("_kernel")


def svm(
    train: DataFrame, C: float = 10 / 3, components: int = 500, max_iter: int = 100, seed: int = 42
) -> KernelSvmModel:
    """Support vector machine with a radial kernel, as an approximation.

    The kernel is that of at most ``components`` landmark rows and the solver is linear machines, one
    per class; the kernel width is 1 / (features · variance of all cells). The features are written
    once for all classes.
    """
    n, width, variance = cell_spread(train, FEATURES)
    landmarks = choose(train, FEATURES, components, n, 1.0 / (width * max(variance, 1e-12)), seed)
    machine = LinearSVC(
        regParam=1.0 / (C * n), maxIter=max_iter, featuresCol="_kernel", labelCol=TARGET,
        standardization=False,
    )
    rows = materialize(landmarks.features(train.select(FEATURES, TARGET), FEATURES, "_kernel").drop(FEATURES), "kernel")
    fitted = OneVsRest(classifier=machine, parallelism=4, featuresCol="_kernel", labelCol=TARGET).fit(rows)
    return KernelSvmModel(fitted, landmarks)


# --- boosting by reweighting --------------------------------------------------------------


@dataclass
class BoostedTrees:
    """Weighted vote of trees."""

    trees: list = field(default_factory=list)
    votes: list[float] = field(default_factory=list)
    errors: list[float] = field(default_factory=list)
    classes: int = 2

    def transform(self, df: DataFrame) -> DataFrame:
        totals = F.array(*[F.lit(0.0)] * self.classes)
        scored = df.withColumn("_votes", totals)
        for number, (tree, vote) in enumerate(zip(self.trees, self.votes), start=1):
            voted = tree.transform(scored)
            scored = voted.withColumn(
                "_votes",
                F.transform("_votes", lambda v, i: v + F.when(i == F.col("prediction"), vote).otherwise(0.0)),
            ).drop("prediction", "rawPrediction", "probability")
            if number % TREES_PER_PLAN == 0:
                scored = materialize(scored, "votes")
        return scored.withColumn("prediction", argmax_class(F.col("_votes")).cast("double")).drop("_votes")


def adaboost(
    train: DataFrame,
    n_estimators: int = 500,
    min_samples_leaf: int = 2,
    learning_rate: float = 0.1,
    criterion: str = "gini",
    max_features: float = 0.3,
    max_depth: int = DEEPEST,
    id_col: str = "id",
    seed: int = 42,
) -> BoostedTrees:
    """Multi-class boosting: each tree fits weights raised where the last ones erred.

    A tree is a forest of one without resampling, so that every node draws its share of the features.
    Weights sum to 1. A round joins them to the features once, by a shuffle, and writes the rows that the
    tree reads several times; a table of weights is small on disk, but a broadcast would send it through the driver.
    """
    classes = int(train.agg(F.max(TARGET)).first()[0]) + 1
    rows = materialize(train.select(id_col, FEATURES, TARGET), "boost")
    n, spark = rows.count(), train.sparkSession
    tasks = max(1, -(-n // LEARNED_PER_TASK))
    dealt = rows.repartition(tasks, id_col)
    tables, rounds = Rounds(spark, "weighted"), Rounds(spark, "weights")
    weights, model = None, BoostedTrees(classes=classes)
    for number in range(n_estimators):
        if weights is None:
            weighted = dealt.withColumn("weight", F.lit(1.0 / n))
        else:
            weighted = dealt.join(weights.repartition(tasks, id_col).hint("merge"), id_col).coalesce(tasks)
        weighted, _ = tables.write(weighted)
        # Spark compares minInstancesPerNode with the row count, so weights keep their scale.
        tree = RandomForestClassifier(
            numTrees=1, bootstrap=False, impurity=criterion, minInstancesPerNode=min_samples_leaf, maxDepth=max_depth,
            featureSubsetStrategy=str(float(max_features)), weightCol="weight", featuresCol=FEATURES, labelCol=TARGET,
            seed=seed + number,
        ).fit(weighted)
        wrong = F.col("prediction") != F.col(TARGET)
        marked, total = rounds.write(
            tree.transform(weighted).select(id_col, "weight", wrong.alias("wrong")),
            error=F.sum(F.when(F.col("wrong"), F.col("weight")).otherwise(0.0)) / F.sum("weight"),
        )
        error = total["error"]
        if error >= 1 - 1 / classes:
            if not model.trees:
                raise ValueError("the first tree is no better than chance")
            break
        vote = learning_rate * (math.log((1 - max(error, 1e-10)) / max(error, 1e-10)) + math.log(classes - 1))
        model.trees.append(tree)
        model.votes.append(vote)
        model.errors.append(error)
        if error <= 0:
            break
        grown = error * math.exp(vote) + (1 - error)
        factor = F.when(F.col("wrong"), math.exp(vote)).otherwise(1.0) / grown
        weights = marked.select(id_col, (F.col("weight") * factor).alias("weight"))
    return model


# --- networks -----------------------------------------------------------------------------


def mlp_ensemble(
    train: DataFrame,
    n_models: int = 10,
    layers: Sequence[int] = (64,),
    epochs: int = 100,
    frac: float = 1.0,
    activation: str = "relu",
    dropout: float | None = None,
    label_smoothing: float = 0.0,
    learning_rate: float = 0.02,
    patience: int | None = None,
    val_size: float = 0.2,
    id_col: str = "id",
    seed: int = 42,
) -> NetworkEnsemble:
    """Networks trained on resampled rows, with Adam and a cosine-shaped learning rate.

    Each member has its own sample with replacement, which the rows carry as weights. With ``patience`` the share
    ``val_size`` of each class is held out from all samples, and a member stops when its loss there
    no longer falls. A step is on all rows.
    """
    rows = materialize(train.select(F.col(id_col).alias("id"), vector_to_array(FEATURES).alias("x"), F.col(TARGET).cast("int").alias(TARGET)), "rows")
    held = rows.withColumn("held", F.lit(False))
    if patience is not None:
        held = train_val_split(rows, TARGET, "id", val_size, seed).withColumn("held", F.col("split") == "val").drop("split")
        held = materialize(held, "held")
    width, classes = rows.agg(F.max(F.size("x")), F.max(TARGET)).first()
    drawn = None
    for member in range(n_models):
        one = bootstrap_resample(held.filter(~F.col("held")).select("id", TARGET), TARGET, "id", frac, seed, member)
        one = one.select(F.col("id").alias("_id"), F.lit(member).alias("member"))
        drawn = one if drawn is None else drawn.unionByName(one)
    times = drawn.groupBy("_id").agg(
        F.array(*[F.count_if(F.col("member") == m).cast("double") for m in range(n_models)]).alias("weights")
    )
    none = F.array_repeat(F.lit(0.0), n_models)
    weighted = held.join(times, F.col("id") == F.col("_id"), "left").withColumn("weights", F.coalesce("weights", none))
    return train_networks(
        weighted, [width, *layers, classes + 1], n_models, epochs, activation, dropout, label_smoothing, learning_rate,
        patience=patience, seed=seed,
    )


LEARNERS: dict[str, Callable[..., Any]] = {
    "naive_bayes_multinomial": naive_bayes_multinomial,
    "naive_bayes_complement": naive_bayes_complement,
    "naive_bayes_gaussian": naive_bayes_gaussian,
    "svm": svm,
    "random_forest": random_forest,
    "adaboost": adaboost,
    "gradient_boosting": gradient_boosting,
    "mlp_ensemble": mlp_ensemble,
}
#: Learners that read sparse entries and need no vectors.
OVER_TERMS = (naive_bayes_multinomial, naive_bayes_complement, naive_bayes_gaussian)
#: Feature options that tell how texts are cut.
CUTTING = ("ngram_range", "analyzer", "replace_links")
FITTING = {"min_df", "n_components", "tolerance", *CUTTING}
#: Their fits for all folds at once.
FITS: dict[Callable[..., Any], Callable[..., Any]] = {
    naive_bayes_multinomial: terms.fit_multinomial,
    naive_bayes_complement: terms.fit_complement,
    naive_bayes_gaussian: terms.fit_gaussian,
}


# --- cross-validation ---------------------------------------------------------------------


def _prepared_folds(
    df: DataFrame, vectors: bool, feature_options: Mapping[str, Any] | None, k: int, seed: int, id_col: str,
    text_col: str | None, counts: DataFrame | None,
) -> Iterator[tuple[int, TextFeatures | None, DataFrame, DataFrame]]:
    """(fold, features, train, test) of every fold, written; features are learned on the other folds only."""
    folded = materialize(stratified_kfold(df, TARGET, id_col, k, seed), "folds")
    options = dict(feature_options or {})
    if text_col is not None:
        folded = terms.numbered_rows(folded)
        if counts is None:
            counts = term_counts_of(folded, text_col, options)
        else:
            counts = counts.join(folded.select(id_col, terms.ROW), id_col).select(terms.ROW, "term", "tf")
        counts = materialize(counts.join(folded.select(terms.ROW, "fold"), terms.ROW), "fold-terms")
        folded = folded.select(id_col, terms.ROW, TARGET, "fold")
    for fold in range(k):
        parts = [folded.filter(F.col("fold") != fold), folded.filter(F.col("fold") == fold)]
        featurizer = None
        if text_col is not None:
            cut = [counts.filter(F.col("fold") != fold).drop("fold"), counts.filter(F.col("fold") == fold).drop("fold")]
            featurizer = terms.text_features(parts[0], text_col, counts=cut[0], **options)
            parts = [featurizer.joined(part.drop("fold"), own) for part, own in zip(parts, cut)]
            if vectors:
                parts = [featurizer.with_vectors(part, FEATURES).drop(terms.ENTRIES) for part in parts]
        train, test = (materialize(part, "part") for part in parts)
        yield fold, featurizer, train, test


def _at_once(learner: Callable[..., Any], feature_options: Mapping[str, Any] | None, text_col: str | None) -> bool:
    options = feature_options or {}
    return learner in FITS and text_col is not None and not options.get("n_components") and set(options) <= FITTING


def _folded_rows(df: DataFrame, k: int, seed: int, id_col: str) -> DataFrame:
    """The rows with their folds, numbered and written."""
    return terms.numbered_rows(stratified_kfold(df.drop(terms.ROW), TARGET, id_col, k, seed))


def _folded_counts(folded: DataFrame, text_col: str, feature_options: Mapping[str, Any]) -> DataFrame:
    return term_counts_of(folded, text_col, feature_options, ("fold", TARGET))


def _as_often(folded: DataFrame, counts: DataFrame, id_col: str) -> DataFrame:
    """Terms found by id: every text gets those of all texts that share its id, and none without an id."""
    many = folded.groupBy(F.col(id_col).alias("_id")).agg(F.count(F.lit(1)).cast("int").alias("_n")).filter("_n > 1 OR _id IS NULL")
    many = materialize(many, "repeated")
    if many.isEmpty():
        return counts
    times = folded.join(many, F.col(id_col).eqNullSafe(F.col("_id"))).select(
        terms.ROW, F.when(F.col("_id").isNull(), 0).otherwise(F.col("_n")).alias("_n")
    )
    copies = F.explode(F.array_repeat(F.lit(0), F.coalesce("_n", F.lit(1))))
    return materialize(counts.join(times, terms.ROW, "left").withColumn("_copy", copies).drop("_n", "_copy"), "fold-terms")


def _metrics_at_once(
    folded: DataFrame, counts: DataFrame, learner: Callable[..., Any], choices: Sequence[Mapping[str, Any]],
    feature_options: Mapping[str, Any], k: int,
) -> list[DataFrame]:
    """Metrics per fold for every choice of learner options; terms, folds and sums are made once for all."""
    texts = terms.FoldedTexts.fit(folded.select(terms.ROW, "fold", TARGET), counts, TARGET, k, feature_options.get("min_df", 5))
    sums, parts = texts.sums(learner is naive_bayes_gaussian)
    found = []
    for options in choices:
        scored = texts.predict(sums, FITS[learner](sums, parts, **options)).withColumn(TARGET, F.col(TARGET).cast("int"))
        every = folded.sparkSession.range(k).select(F.col("id").cast("int").alias("fold"))  # one without texts has nulls
        found.append(materialize(every.join(metric_table(scored, keys=("fold",)), "fold", "left"), "fold"))
    return found


def _fold_metrics(fold: int, model: Any, test: DataFrame) -> DataFrame:
    scored = model.transform(test).select(
        F.col(TARGET).cast("int").alias(TARGET), F.col("prediction").cast("int").alias("prediction")
    )
    return materialize(metric_table(scored).select(F.lit(fold).alias("fold"), "*"), "fold")


def cross_validate(
    df: DataFrame,
    learner: Callable[..., Any],
    learner_options: Mapping[str, Any] | None = None,
    feature_options: Mapping[str, Any] | None = None,
    k: int = 5,
    seed: int = 42,
    id_col: str = "id",
    text_col: str | None = "text",
    keep_models: bool = False,
):
    """One row of metrics per fold; features and model are learned on the other folds only.

    Texts are cut into terms once. Without ``text_col`` the frame already has a ``features`` column. With
    ``keep_models`` the fitted (features, model) pair of every fold is returned as well.
    """
    if _at_once(learner, feature_options, text_col) and not keep_models:
        folded, options = _folded_rows(df, k, seed, id_col), dict(feature_options or {})
        counts = _folded_counts(folded, text_col, options)
        return _metrics_at_once(folded, counts, learner, [learner_options or {}], options, k)[0]
    rows, models = None, []
    for fold, featurizer, train, test in _prepared_folds(
        df, learner not in OVER_TERMS, feature_options, k, seed, id_col, text_col, None
    ):
        model = learner(train, **(learner_options or {}))
        one = _fold_metrics(fold, model, test)
        rows = one if rows is None else rows.unionByName(one)
        models.append((featurizer, model))
    return (rows, models) if keep_models else rows


def term_counts_of(
    df: DataFrame, text_col: str, feature_options: Mapping[str, Any], also: tuple[str, ...] = ()
) -> DataFrame:
    """Terms of numbered rows as some feature options cut them; the other options do not matter."""
    cut = {n: v for n, v in feature_options.items() if n in CUTTING}
    return terms.counted_terms(df, text_col, **cut, also=also)


def experiment_grid(
    df: DataFrame,
    learner: str,
    learner_grid: Mapping[str, Sequence[Any]] | None = None,
    feature_grid: Mapping[str, Sequence[Any]] | None = None,
    k: int = 5,
    seed: int = 42,
    id_col: str = "id",
    text_col: str | None = "text",
) -> DataFrame:
    """Cross-validate every combination of learner and feature parameters.

    Texts are cut into terms once for all combinations that cut them alike, and a fold's features are
    learned once for all learners.
    """

    def combinations(grid: Mapping[str, Sequence[Any]] | None):
        names = list(grid or {})
        for values in itertools.product(*[(grid or {})[n] for n in names]):
            yield dict(zip(names, values))

    rows, fit, table, cut, folded = df, LEARNERS[learner], None, {}, None
    for feature_options in combinations(feature_grid):
        if _at_once(fit, feature_options, text_col):
            folded = _folded_rows(df, k, seed, id_col) if folded is None else folded
            way = str(["folds", *[feature_options.get(n) for n in CUTTING]])
            if way not in cut:
                cut[way] = _as_often(folded, _folded_counts(folded, text_col, feature_options), id_col)
            choices = list(combinations(learner_grid))
            for options, one in zip(choices, _metrics_at_once(folded, cut[way], fit, choices, feature_options, k)):
                name = f"{learner} {options} {feature_options}"
                one = one.select(F.lit(name).alias("Name"), "*")
                table = one if table is None else table.unionByName(one)
            continue
        counts = None
        if text_col is not None:
            rows = terms.numbered_rows(rows)
            way = str([feature_options.get(n) for n in CUTTING])
            if way not in cut:
                found = term_counts_of(rows, text_col, feature_options)
                cut[way] = materialize(found.join(rows.select(terms.ROW, id_col), terms.ROW).drop(terms.ROW), "terms")
            counts = cut[way]
        for fold, _, train, test in _prepared_folds(
            rows.drop(terms.ROW), fit not in OVER_TERMS, feature_options, k, seed, id_col, text_col, counts
        ):
            for learner_options in combinations(learner_grid):
                name = f"{learner} {learner_options} {feature_options}"
                one = _fold_metrics(fold, fit(train, **learner_options), test).select(F.lit(name).alias("Name"), "*")
                table = one if table is None else table.unionByName(one)
    return table


def best_fold_model(fold_metrics: DataFrame, models: Sequence[Any], metric: str = "F1_macro"):
    """The model of the fold with the highest metric, the first one on ties."""
    best = fold_metrics.agg(F.min_by("fold", F.struct(-F.col(f"`{metric}`"), "fold"))).first()[0]
    return models[best]


@dataclass
class FittedClassifier:
    """Fitted features and a model of any kind, applied together."""

    features: TextFeatures | None
    model: Any

    def transform(self, df: DataFrame) -> DataFrame:
        if self.features is None:
            return self.model.transform(df)
        if isinstance(self.model, TermModel) and self.features.projection is None:
            return self.model.transform_texts(self.features, df).select(*df.columns, "prediction")
        rows = self.features.transform(df)
        if not isinstance(self.model, TermModel):
            rows = self.features.with_vectors(rows, FEATURES)
        return self.model.transform(rows).select(*df.columns, "prediction")


def save_pipeline(spark: SparkSession, features: TextFeatures | None, model: Any, path: str) -> None:
    """Store fitted features and model together.

    Every Spark model and table goes to a folder of its own; what holds them together is one JSON row.
    """
    parts, about = [model], {}
    if isinstance(model, TermModel):
        model.save(f"{path}/terms")
        parts = []
    elif isinstance(model, KernelSvmModel):
        parts, about = [model.inner], {"gamma": model.landmarks.gamma}
        model.landmarks.save(spark, f"{path}/landmarks")
    elif isinstance(model, BoostedTrees):
        parts, about = model.trees, {"votes": model.votes, "errors": model.errors, "classes": model.classes}
    elif isinstance(model, NetworkEnsemble):
        model.save(f"{path}/networks")
        parts = []
    about |= {"kind": type(model).__name__, "parts": len(parts), "features": features is not None}
    if features is not None:
        features.save(f"{path}/features")
    for i, part in enumerate(parts):
        PipelineModel([part]).write().overwrite().save(f"{path}/part{i}")
    row = spark.createDataFrame([(json.dumps(about),)], "value string")
    row.write.mode("overwrite").text(f"{path}/about")


def load_pipeline(spark: SparkSession, path: str) -> FittedClassifier:
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    parts = [PipelineModel.load(f"{path}/part{i}").stages[0] for i in range(about["parts"])]
    if about["kind"] == "TermModel":
        model: Any = TermModel.load(spark, f"{path}/terms")
    elif about["kind"] == "KernelSvmModel":
        model = KernelSvmModel(parts[0], Landmarks.load(spark, f"{path}/landmarks", about["gamma"]))
    elif about["kind"] == "BoostedTrees":
        model = BoostedTrees(parts, about["votes"], about["errors"], about["classes"])
    elif about["kind"] == "NetworkEnsemble":
        model = NetworkEnsemble.load(spark, f"{path}/networks")
    else:
        model = parts[0]
    features = TextFeatures.load(spark, f"{path}/features") if about["features"] else None
    return FittedClassifier(features, model)
