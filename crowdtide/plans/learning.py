"""Queries over folds, metrics, naive Bayes, classifiers and cross-validation."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from crowdtide.operators import bayes as B
from crowdtide.operators import evaluate as E
from crowdtide.operators import features as X
from crowdtide.operators import kernels
from crowdtide.operators import models as M
from crowdtide.operators import terms
from crowdtide.operators.network import cosine_rate, train_networks
from crowdtide.operators.sentiment import predict_all
from crowdtide.plans import tables as T
from crowdtide.scratch import materialize, new_folder

CLASSES = 3


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    """(id, target) of three classes."""
    labels = T.table(spark, folder, "labels")
    return labels.select(
        F.col("doc_id").cast("string").alias("id"),
        F.when(F.col("toxic") == 1, 2).otherwise(F.col("quality")).alias("target"),
    )


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    """Labels with a stand-in prediction that depends on the document's length."""
    docs = T.table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.pmod("n_chars", F.lit(CLASSES)).cast("int").alias("prediction"),
        F.pmod("n_chars", F.lit(5)).cast("int").alias("fold"),
    )
    return _labels(spark, folder).join(docs, "id")


def stratified_kfold(spark: SparkSession, folder: str) -> DataFrame:
    return E.stratified_kfold(_labels(spark, folder), "target")


def stratified_kfold_ordered(spark: SparkSession, folder: str) -> DataFrame:
    return E.stratified_kfold(_labels(spark, folder), "target", shuffle=False)


def train_val_split(spark: SparkSession, folder: str) -> DataFrame:
    return E.train_val_split(_labels(spark, folder), "target")


def bootstrap_resample(spark: SparkSession, folder: str) -> DataFrame:
    """Draws per class; they sum to the share of each class."""
    drawn = E.bootstrap_resample(_labels(spark, folder), "target", frac=0.8)
    return drawn.groupBy("target").agg(F.count(F.lit(1)).alias("n"))


def one_hot(spark: SparkSession, folder: str) -> DataFrame:
    smooth = E.label_smoothing(F.col("target"), CLASSES, 0.1)
    return _labels(spark, folder).select(
        "id", *[T.r6(smooth[c]).alias(f"y{c}") for c in range(CLASSES)],
        *[E.one_hot(F.col("target"), CLASSES)[c].alias(f"h{c}") for c in range(CLASSES)],
    )


def average_probabilities(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors with the same label as members of one ensemble."""
    vectors = T.table(spark, folder, "embeddings").select(
        F.col("label").alias("id"), F.col("embedding").cast("array<double>").alias("probability")
    )
    means = E.average_probabilities(vectors)
    return means.select("id", F.posexplode("probability").alias("class", "p")).withColumn("p", T.r6("p"))


def accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return E.accuracy(_scored(spark, folder)).select(T.r6("Accuracy").alias("accuracy"))


def metric_table(spark: SparkSession, folder: str) -> DataFrame:
    return _plain_names(E.metric_table(_scored(spark, folder)))


def fold_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _plain_names(E.metric_table(_scored(spark, folder), keys=("fold",)))


def fold_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _plain_names(E.fold_summary(E.metric_table(_scored(spark, folder), keys=("fold",))))


def _plain_names(df: DataFrame) -> DataFrame:
    """Rounded metrics under names that need no quotes."""
    return df.select(
        *[
            (T.r6(F.col(f"`{c}`")) if t == "double" else F.col(f"`{c}`")).alias(
                c.replace("F_0.5 macro", "F_half_macro")
            )
            for c, t in df.dtypes
        ]
    )


def append_results(spark: SparkSession, folder: str) -> DataFrame:
    """Two entries in a new log."""
    path = new_folder(spark, "results")
    folds = E.metric_table(_scored(spark, folder), keys=("fold",))
    for name in ("MultinomialNB", "SVC"):
        E.append_results(E.fold_summary(folds), path, name, "stand-in")
    log = E.read_results(spark, path)
    return _plain_names(log)


# --- naive Bayes --------------------------------------------------------------------------


def _counts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = T.labelled_documents(spark, folder)
    counts = X.term_counts(docs.select("id", "text")).withColumn("w", F.col("tf").cast("double"))
    return materialize(counts, "counts"), docs.select("id", "target")


def naive_bayes_multinomial(spark: SparkSession, folder: str) -> DataFrame:
    counts, labels = _counts(spark, folder)
    fitted = B.multinomial_fit(counts, labels)
    return fitted.select("target", "term", T.r6("logp").alias("logp"))


def naive_bayes_predict(spark: SparkSession, folder: str) -> DataFrame:
    counts, labels = _counts(spark, folder)
    fitted = B.multinomial_fit(counts, labels)
    everyone = T.documents(spark, folder)
    unseen = X.term_counts(everyone).withColumn("w", F.col("tf").cast("double"))
    return B.term_predict(unseen, fitted, B.class_priors(labels), everyone.select("id"))


def naive_bayes_complement(spark: SparkSession, folder: str) -> DataFrame:
    counts, labels = _counts(spark, folder)
    fitted = B.complement_fit(counts, labels, 0.1)
    return fitted.select("target", "term", T.r6("logp").alias("logp"))


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return T.table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), F.col("label").alias("target"), "embedding"
    )


def gaussian_moments(spark: SparkSession, folder: str) -> DataFrame:
    moments = B.gaussian_moments(_vectors(spark, folder), "target", "embedding")
    return moments.select("target", "dim", "n", T.r6("mean").alias("mean"), T.r6("var").alias("var"))


def naive_bayes_gaussian(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _vectors(spark, folder)
    fitted = B.gaussian_fit(vectors, "target", "embedding")
    return B.gaussian_predict(vectors, fitted, "embedding").select("id", "prediction")


# --- classifiers --------------------------------------------------------------------------


def _features(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _vectors(spark, folder)
    return vectors.select(
        "id", "target", array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    )


def _steps(spark: SparkSession, folder: str) -> DataFrame:
    """Customers whose class is a step of their nation, with a margin, beside a balance that tells nothing."""
    nation = F.col("c_nationkey")
    late = nation >= 12
    place = (nation + F.when(late, 12).otherwise(0)) / 36.0
    return T.table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        late.cast("int").alias("target"),
        F.pmod("c_custkey", F.lit(2)).alias("half"),
        array_to_vector(F.array(place, F.col("c_acctbal").cast("double") / 10000)).alias("features"),
    )


def _fitted(learner, **options):
    """Predictions for odd customers by a model learned from the even ones."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        rows = materialize(_steps(spark, folder), "rows")
        scored = learner(rows.filter("half = 0").drop("half"), **options).transform(rows.filter("half = 1"))
        return scored.select("id", F.col("prediction").cast("int").alias("prediction"))

    return query


#: Twentieths of the customers of each remainder of 4 that are of class 1.
SHARES, ALPHA = (18, 9, 1, 11), 0.05
BOOSTED_ROUNDS = 6


def pruned_forest(spark: SparkSession, folder: str) -> DataFrame:
    """One whole tree over four values, where the weaker split falls to its cost."""
    x, turn = F.pmod("c_custkey", F.lit(4)), F.pmod(F.floor(F.col("c_custkey") / 4), F.lit(20))
    rows = T.table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        (turn < F.lit(list(SHARES))[x.cast("int")]).cast("int").alias("target"),
        array_to_vector(F.array(x.cast("double"))).alias("features"),
    )
    rows = materialize(rows, "rows")
    options = {"n_estimators": 1, "max_features": 1.0, "bootstrap": False}
    whole, cut = (M.random_forest(rows, ccp_alpha=a, **options).transform(rows) for a in (0.0, ALPHA))
    share = T.r6(vector_to_array("probability")[1])
    return cut.select("id", F.col("prediction").cast("int").alias("pruned"), share.alias("share")).join(
        whole.select("id", F.col("prediction").cast("int").alias("whole")), "id"
    )


def adaboost_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """Errors and votes of trees of one split where no single split fits."""
    nation = F.col("c_nationkey")
    rows = T.table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), (F.pmod(nation * 7, F.lit(25)) < 11).cast("int").alias("target"),
        array_to_vector(F.array(nation.cast("double"))).alias("features"),
    )
    model = M.adaboost(rows, BOOSTED_ROUNDS, learning_rate=1.0, max_features=1.0, max_depth=1)
    found = [(n, e, v) for n, (e, v) in enumerate(zip(model.errors, model.votes))]
    table = spark.createDataFrame(found, "round int, error double, vote double")
    return table.select("round", T.r6("error").alias("error"), T.r6("vote").alias("vote"))


NETWORK_EPOCHS, SMOOTHING, RATE = 5, 0.1, 0.8


def network_losses(spark: SparkSession, folder: str) -> DataFrame:
    """Loss of a network without hidden layers in every epoch of plain descent, from zero weights."""
    nation = F.col("c_nationkey")
    rows = T.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.array(nation / 25.0, F.pmod(nation, F.lit(5)) / 5.0).alias("x"),
        F.pmod(F.floor(nation / 3), F.lit(3)).cast("int").alias("target"), F.array(F.lit(1.0)).alias("weights"), F.lit(False).alias("held"),
    )
    model = train_networks(rows, [2, 3], 1, NETWORK_EPOCHS, label_smoothing=SMOOTHING, learning_rate=RATE, optimizer="sgd", start=0.0)
    table = spark.createDataFrame(list(enumerate(model.losses[0])), "epoch int, loss double")
    return table.select("epoch", T.r6("loss").alias("loss"))


def text_model(spark: SparkSession, folder: str) -> DataFrame:
    """Features and model learned on the labelled documents, stored, loaded, and applied to all."""
    docs = terms.numbered_rows(T.labelled_documents(spark, folder))
    counts = terms.counted_terms(docs, ngram_range=(1, 2))  # cut once, for the features and for the model
    features = terms.text_features(docs, min_df=5, ngram_range=(1, 2), counts=counts)
    model = M.naive_bayes_multinomial(materialize(features.joined(docs.select(terms.ROW, M.TARGET), counts), "train"))
    path = new_folder(spark, "model")
    M.save_pipeline(spark, features, model, path)
    return predict_all(M.load_pipeline(spark, path), T.documents(spark, folder)).select("id", "sentiment")


def cross_validate(spark: SparkSession, folder: str) -> DataFrame:
    docs = materialize(T.labelled_documents(spark, folder), "docs")
    options = {"min_df": 5, "ngram_range": (1, 2)}
    return _plain_names(M.cross_validate(docs, M.naive_bayes_complement, feature_options=options))


def cross_validate_gaussian(spark: SparkSession, folder: str) -> DataFrame:
    """Densities over sparse words."""
    docs = materialize(T.labelled_documents(spark, folder), "docs")
    options = {"min_df": 10, "ngram_range": (1, 1)}
    return _plain_names(M.cross_validate(docs, M.naive_bayes_gaussian, feature_options=options))


def best_fold(spark: SparkSession, folder: str) -> DataFrame:
    """The best fold's model, applied to all vectors."""
    rows = materialize(_features(spark, folder), "rows")
    folds, models = M.cross_validate(rows, M.naive_bayes_gaussian, text_col=None, keep_models=True)
    _, model = M.best_fold_model(folds, models)
    return model.transform(rows).select("id", F.col("prediction").cast("int").alias("prediction"))


GRID = {"alpha": [0.1, 1.0]}, {"min_df": [5, 10], "ngram_range": [(1, 2)]}


def experiment_grid(spark: SparkSession, folder: str) -> DataFrame:
    docs = materialize(T.labelled_documents(spark, folder), "docs")
    return _plain_names(M.experiment_grid(docs, "naive_bayes_multinomial", *GRID))


def svm_features(spark: SparkSession, folder: str) -> DataFrame:
    """Kernel values of all rows with five of 60 landmarks, as products of the features."""
    rows = _features(spark, folder)
    chosen = materialize(rows.orderBy(F.md5("id"), "id").limit(60).select("id", "features"), "chosen")
    landmarks = kernels.Landmarks.of(chosen.orderBy(F.md5("id"), "id").select(*kernels.entries("features")), 0.5)
    few = landmarks.features(chosen.orderBy(F.md5("id"), "id").limit(5), "features", "_k")
    few = few.select(F.struct(F.col("id").alias("landmark"), vector_to_array("_k").alias("z")).alias("l"))
    five = few.agg(F.collect_list("l")).scalar()
    wide = landmarks.features(rows, "features", "_k").select("id", vector_to_array("_k").alias("x"))
    both = wide.select("id", "x", F.inline(five))
    product = F.aggregate(F.zip_with("x", "z", lambda x, z: x * z), F.lit(0.0), lambda total, x: total + x)
    return both.select("id", "landmark", T.r6(product).alias("kernel"))


QUERIES = {
    "stratified_kfold": stratified_kfold,
    "stratified_kfold_ordered": stratified_kfold_ordered,
    "train_val_split": train_val_split,
    "bootstrap_resample": bootstrap_resample,
    "one_hot": one_hot,
    "average_probabilities": average_probabilities,
    "accuracy": accuracy,
    "metric_table": metric_table,
    "fold_metrics": fold_metrics,
    "fold_summary": fold_summary,
    "append_results": append_results,
    "naive_bayes_multinomial": naive_bayes_multinomial,
    "naive_bayes_predict": naive_bayes_predict,
    "naive_bayes_complement": naive_bayes_complement,
    "gaussian_moments": gaussian_moments,
    "naive_bayes_gaussian": naive_bayes_gaussian,
    "svm": _fitted(M.svm),
    "svm_features": svm_features,
    "random_forest": _fitted(M.random_forest),
    "adaboost": _fitted(M.adaboost, max_features=1.0),
    "adaboost_rounds": adaboost_rounds,
    "network_losses": network_losses,
    "pruned_forest": pruned_forest,
    "gradient_boosting": _fitted(M.gradient_boosting),
    "mlp_ensemble": _fitted(M.mlp_ensemble),
    "text_model": text_model,
    "cross_validate": cross_validate,
    "cross_validate_gaussian": cross_validate_gaussian,
    "best_fold_model": best_fold,
    "experiment_grid": experiment_grid,
}

_LABELS = """labelled AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN toxic = 1 THEN 2 ELSE quality END AS target FROM labels)"""

_PLACED = f"""{_LABELS},
sizes AS (SELECT target, count(*) AS n FROM labelled GROUP BY 1),
before AS (SELECT target, n, coalesce(sum(n) OVER (ORDER BY target ROWS BETWEEN UNBOUNDED PRECEDING
             AND 1 PRECEDING), 0) AS b FROM sizes),
placed AS (
  SELECT l.id, l.target, n, b, row_number() OVER (PARTITION BY l.target ORDER BY md5(l.id || '|42'), l.id) - 1 AS r
  FROM labelled l JOIN before USING (target))"""

_ROLES = """roles AS (
  SELECT fold, t AS c, CASE WHEN t = p THEN 1 ELSE 0 END AS tp, CASE WHEN t <> p THEN 1 ELSE 0 END AS fn, 0 AS fp
  FROM scored
  UNION ALL SELECT fold, p, 0, 0, 1 FROM scored WHERE t <> p)"""

_CONFUSION = f"""{_LABELS},
scored AS (
  SELECT CAST(target AS VARCHAR) AS t, CAST(n_chars % 3 AS VARCHAR) AS p, CAST(n_chars % 5 AS INTEGER) AS fold
  FROM labelled JOIN documents d ON id = CAST(d.doc_id AS VARCHAR)),
{_ROLES}"""


def _cells_sql(key: str) -> str:
    """Metrics ``m`` of the roles, per key if there is one."""
    select = f"{key}, " if key else ""
    group = f"GROUP BY {key}" if key else ""
    return f"""cells AS (SELECT {select}c, sum(tp) AS tp, sum(fn) AS fn, sum(fp) AS fp FROM roles GROUP BY {select}c),
f AS (SELECT *, coalesce(2 * tp / nullif(2 * tp + fn + fp, 0), 0) AS f1,
        coalesce(1.25 * tp / nullif(1.25 * tp + 0.25 * fn + fp, 0), 0) AS fh FROM cells),
m AS (SELECT {select}sum(tp) / sum(tp + fn) AS "Accuracy", avg(f1) AS "F1_macro",
        sum(f1 * (tp + fn)) / sum(tp + fn) AS "F1_weighted", avg(fh) AS "F_half_macro" FROM f {group})"""


def _metrics_sql(key: str) -> str:
    return f"{_CONFUSION},\n{_cells_sql(key)}"


_METRIC_NAMES = ("Accuracy", "F1_macro", "F1_weighted", "F_half_macro")
_ROUNDED = ", ".join(f'round("{n}", 6) AS "{n}"' for n in _METRIC_NAMES)
_SUMMARY = ", ".join(
    f'round(avg("{n}"), 6) AS "{n}", round(stddev_pop("{n}"), 6) AS "{n}_stddev"' for n in _METRIC_NAMES
)

_TERMS = f"""{T.THREE_CLASS_SQL},
t AS (SELECT id, target, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM labelled),
sums AS (SELECT target, term, count(*) AS w FROM t GROUP BY 1, 2),
classes AS (SELECT target, sum(w) AS total FROM sums GROUP BY 1),
terms AS (SELECT term, sum(w) AS term_total FROM sums GROUP BY 1),
grid AS (SELECT c.target, m.term, coalesce(s.w, 0) AS w, total, term_total
  FROM terms m JOIN classes c ON true LEFT JOIN sums s ON s.term = m.term AND s.target = c.target),
v AS (SELECT count(*) AS v, sum(term_total) AS everything FROM terms)"""

_STEPS = """SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_nationkey >= 12 THEN 1 ELSE 0 END AS prediction
FROM customer WHERE c_custkey % 2 = 1"""

_GAUSS = """cells AS (
  SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS dim, CAST(unnest(embedding) AS DOUBLE) AS x
  FROM embeddings),
moments AS (SELECT label AS target, dim, count(*) AS n, avg(x) AS mean, var_pop(x) AS var FROM cells GROUP BY 1, 2)"""

_WORD_TERMS = """units AS (SELECT id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS u FROM texts),
spots AS (SELECT id, u, unnest(range(1, len(u) + 1)) AS i FROM units),
uses AS (SELECT id, u[i] AS term FROM spots UNION ALL SELECT id, u[i] || ' ' || u[i + 1] FROM spots WHERE i < len(u))"""

_SINGLE_WORDS = """uses AS (SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM texts)"""


def _folded_sql(uses: str, min_df: int, texts: str) -> str:
    """Weights ``w`` (fold, id, kept, target, i, w): fitted without a fold, for its texts and the others."""
    return f"""known AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS id, text, CASE WHEN toxic = 1 THEN 2 ELSE quality END AS target
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
sizes AS (SELECT target, count(*) AS n FROM known GROUP BY 1),
before AS (SELECT target, coalesce(sum(n) OVER (ORDER BY target ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM sizes),
placed AS (
  SELECT id, k.target, (b + row_number() OVER (PARTITION BY k.target ORDER BY md5(id || '|42'), id) - 1) % 5 AS own
  FROM known k JOIN before USING (target)),
texts AS ({texts}),
{uses},
tf AS (SELECT id, term, count(*) AS tf FROM uses GROUP BY 1, 2),
folds AS (SELECT unnest(range(0, 5)) AS fold),
n AS (SELECT fold, count(*) AS n FROM folds, placed WHERE own <> fold GROUP BY 1),
df AS (SELECT fold, term, count(*) AS df FROM tf JOIN placed USING (id), folds WHERE own <> fold GROUP BY 1, 2 HAVING count(*) >= {min_df}),
raw AS (SELECT fold, id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS x FROM tf JOIN df USING (term) JOIN n USING (fold)),
norms AS (SELECT fold, id, sqrt(sum(x * x)) AS norm FROM raw GROUP BY 1, 2),
w AS (
  SELECT fold, id, own <> fold AS kept, target, term, x / norm AS w
  FROM raw JOIN norms USING (fold, id) LEFT JOIN placed USING (id)),
sums AS (SELECT fold, target, term, sum(w) AS s, sum(w * w) AS q FROM w WHERE kept GROUP BY 1, 2, 3),
vocabulary AS (SELECT fold, term, sum(s) AS all_s, sum(q) AS all_q FROM sums GROUP BY 1, 2),
classes AS (SELECT fold, target, count(*) AS rows FROM folds, placed WHERE own <> fold GROUP BY 1, 2),
grid AS (
  SELECT fold, c.target, v.term, coalesce(s, 0) AS s, coalesce(q, 0) AS q, all_s, all_q, rows
  FROM vocabulary v JOIN classes c USING (fold) LEFT JOIN sums USING (fold, target, term)),
totals AS (SELECT fold, target, sum(s) AS total, sum(all_s) AS everything, count(*) AS terms FROM grid GROUP BY 1, 2)"""


_MULTINOMIAL = "SELECT fold, target, term, ln((s + {alpha}) / (total + {alpha} * terms)) AS a, 0.0 AS b FROM grid JOIN totals USING (fold, target)"
_COMPLEMENT = """SELECT fold, target, term, -ln((all_s - s + {alpha}) / (everything - total + {alpha} * terms)) AS a, 0.0 AS b
  FROM grid JOIN totals USING (fold, target)"""
_PRIOR = "SELECT fold, target, ln(rows / n) AS base FROM classes JOIN n USING (fold)"

#: Best class of every text and fold from coefficients ``fit`` and ``base``; ties go to the smaller class.
_CHOSEN = """fit AS ({fit}),
base AS ({base}),
reached AS (
  SELECT w.fold, w.id, f.target, sum(w.w * a + w.w * w.w * b) AS x FROM w JOIN fit f ON w.fold = f.fold AND w.term = f.term
  GROUP BY 1, 2, 3),
chosen AS (
  SELECT base.fold, texts.id, base.target AS p FROM base CROSS JOIN texts
  LEFT JOIN reached r ON r.fold = base.fold AND r.id = texts.id AND r.target = base.target
  QUALIFY row_number() OVER (PARTITION BY base.fold, texts.id ORDER BY base + coalesce(x, 0) DESC, base.target) = 1)"""

_OF_FOLDS = f"""scored AS (
  SELECT CAST(target AS VARCHAR) AS t, CAST(p AS VARCHAR) AS p, CAST(fold AS INTEGER) AS fold
  FROM chosen JOIN placed USING (id) WHERE own = fold),
{_ROLES},
{_cells_sql('fold')}"""


def _cross_sql(fit: str, base: str, min_df: int, uses: str = _WORD_TERMS, extra: str = "") -> str:
    return f"""WITH {_folded_sql(uses, min_df, "SELECT id, text FROM known")}{extra},
{_CHOSEN.format(fit=fit, base=base)},
{_OF_FOLDS}"""


def _grid_sql() -> str:
    parts = []
    for min_df in GRID[1]["min_df"]:
        for alpha in GRID[0]["alpha"]:
            name = f"naive_bayes_multinomial {{'alpha': {alpha}}} {{'min_df': {min_df}, 'ngram_range': (1, 2)}}".replace("'", "''")
            one = _cross_sql(_MULTINOMIAL.format(alpha=alpha), _PRIOR, min_df)
            parts.append(f"""SELECT '{name}' AS "Name", * FROM ({one} SELECT fold, {_ROUNDED} FROM m)""")
    return "\nUNION ALL\n".join(parts)


#: Means and variances with implied zeros, and the densities of a text without any term.
_DENSITIES = """,
spread AS (SELECT v.fold, 4e-4 * max(all_q / n - pow(all_s / n, 2)) AS e FROM vocabulary v JOIN n USING (fold) GROUP BY 1),
normal AS (SELECT g.fold, target, term, s / rows AS mean, q / rows - pow(s / rows, 2) + e AS var FROM grid g JOIN spread USING (fold))"""

def _adaboost_sql() -> str:
    """Rounds of the best split by weighted Gini impurity, over the weights of every nation and class."""
    parts = ["""w0 AS MATERIALIZED (
  SELECT c_nationkey AS x, CASE WHEN c_nationkey * 7 % 25 < 11 THEN 1 ELSE 0 END AS y, count(*) / (SELECT count(*) FROM customer) AS w
  FROM customer GROUP BY 1, 2)"""]
    side = "coalesce(sum(w) FILTER (x {} t AND y = {}), 0)"
    for n in range(BOOSTED_ROUNDS):
        parts.append(f"""s{n} AS MATERIALIZED (
  SELECT t, {side.format('<=', 0)} AS l0, {side.format('<=', 1)} AS l1, {side.format('>', 0)} AS r0, {side.format('>', 1)} AS r1
  FROM w{n}, (SELECT DISTINCT x AS t FROM w{n} WHERE x < (SELECT max(x) FROM w{n})) GROUP BY t),
b{n} AS MATERIALIZED (
  SELECT t, l1 > l0 AS l, r1 > r0 AS r FROM s{n}
  ORDER BY 2 * l0 * l1 / (l0 + l1) + 2 * r0 * r1 / (r0 + r1), t LIMIT 1),
m{n} AS MATERIALIZED (SELECT x, y, w, (CASE WHEN x <= t THEN l ELSE r END) <> (y = 1) AS wrong FROM w{n}, b{n}),
e{n} AS MATERIALIZED (SELECT sum(w) FILTER (wrong) / sum(w) AS error, ln((1 - error) / error) AS vote FROM m{n}),
w{n + 1} AS MATERIALIZED (
  SELECT x, y, w * CASE WHEN wrong THEN exp(vote) ELSE 1 END / (error * exp(vote) + 1 - error) AS w FROM m{n}, e{n})""")
    rows = " UNION ALL ".join(
        f"SELECT {n} AS round, round(error, 6) AS error, round(vote, 6) AS vote FROM e{n}" for n in range(BOOSTED_ROUNDS)
    )
    return "WITH " + ",\n".join(parts) + "\n" + rows


def _descent_sql() -> str:
    """Epochs of gradient descent over the customers of every nation; feature 2 is the constant."""
    parts = ["""g AS MATERIALIZED (
  SELECT c_nationkey AS nation, [c_nationkey / 25.0::DOUBLE, c_nationkey % 5 / 5.0::DOUBLE, 1.0::DOUBLE] AS x, c_nationkey // 3 % 3 AS target,
    count(*) / (SELECT count(*) FROM customer) AS part FROM customer GROUP BY 1),
w0 AS MATERIALIZED (SELECT f, c, 0.0::DOUBLE AS w FROM range(0, 3) a(f), range(0, 3) b(c))"""]
    for n in range(NETWORK_EPOCHS):
        rate = cosine_rate(RATE, n, NETWORK_EPOCHS)
        parts.append(f"""z{n} AS MATERIALIZED (
  SELECT nation, x, target, part, c, exp(sum(x[f + 1] * w)) AS e FROM g, w{n} GROUP BY 1, 2, 3, 4, 5),
p{n} AS MATERIALIZED (
  SELECT x, part, c, e / sum(e) OVER (PARTITION BY nation) AS p,
    CASE WHEN c = target THEN {1 - SMOOTHING} ELSE 0 END + {SMOOTHING} / 3 AS y FROM z{n}),
w{n + 1} AS MATERIALIZED (
  SELECT w.f, w.c, w.w - {rate!r} * sum(part * (p - y) * x[w.f + 1]) AS w FROM w{n} w JOIN p{n} p ON w.c = p.c GROUP BY w.f, w.c, w.w)""")
    rows = " UNION ALL ".join(f"SELECT {n} AS epoch, round(-sum(part * y * ln(p)), 6) AS loss FROM p{n}" for n in range(NETWORK_EPOCHS))
    return "WITH " + ",\n".join(parts) + "\n" + rows


SQL = {
    **dict.fromkeys(("svm", "random_forest", "adaboost", "gradient_boosting", "mlp_ensemble"), _STEPS),
    "svm_features": """WITH v AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
z AS (SELECT id AS landmark, e AS l FROM v ORDER BY md5(id), id LIMIT 5)
SELECT id, landmark, round(exp(-0.5 * (list_dot_product(e, e) + list_dot_product(l, l) - 2 * list_dot_product(e, l))), 6)
       AS kernel
FROM v, z""",
    "stratified_kfold": f"""WITH {_PLACED}
SELECT id, target, CAST((b + r) % 5 AS INTEGER) AS fold FROM placed""",
    "stratified_kfold_ordered": f"""WITH {_LABELS},
p AS (SELECT id, target, row_number() OVER (ORDER BY target, id) - 1 AS p FROM labelled),
a AS (SELECT target, p % 5 AS fold, count(*) AS n FROM p GROUP BY 1, 2),
ends AS (SELECT target, fold, sum(n) OVER (PARTITION BY target ORDER BY fold) AS hi,
           sum(n) OVER (PARTITION BY target ORDER BY fold) - n AS lo FROM a),
r AS (SELECT id, target, row_number() OVER (PARTITION BY target ORDER BY id) - 1 AS r FROM labelled)
SELECT id, r.target, CAST(fold AS INTEGER) AS fold FROM r JOIN ends e
ON r.target = e.target AND r >= lo AND r < hi""",
    "train_val_split": f"""WITH {_PLACED}
SELECT id, target, CASE WHEN r < round(n * 0.2) THEN 'val' ELSE 'train' END AS split FROM placed""",
    "bootstrap_resample": f"""WITH {_LABELS}
SELECT target, CAST(round(count(*) * 0.8) AS BIGINT) AS n FROM labelled GROUP BY 1""",
    "one_hot": f"""WITH {_LABELS} SELECT id,
{", ".join(f"round((target = {c})::INT * 0.9 + 0.1 / 3, 6) AS y{c}, (target = {c})::INT::DOUBLE AS h{c}" for c in range(CLASSES))}
FROM labelled""",
    "average_probabilities": """WITH c AS (
  SELECT label AS id, generate_subscripts(embedding, 1) - 1 AS class, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
SELECT id, CAST(class AS INTEGER) AS class, round(avg(x), 6) AS p FROM c GROUP BY 1, 2""",
    "accuracy": f"WITH {_CONFUSION} SELECT round(avg((t = p)::INT), 6) AS accuracy FROM scored",
    "metric_table": f"WITH {_metrics_sql('')} SELECT {_ROUNDED} FROM m",
    "fold_metrics": f"WITH {_metrics_sql('fold')} SELECT fold, {_ROUNDED} FROM m",
    "fold_summary": f"WITH {_metrics_sql('fold')} SELECT {_SUMMARY} FROM m",
    "append_results": f"""WITH {_metrics_sql('fold')}
SELECT unnest(['MultinomialNB', 'SVC']) AS "Name", 'stand-in' AS "Decsription", * FROM (SELECT {_SUMMARY} FROM m)""",
    "naive_bayes_multinomial": f"""WITH {_TERMS}
SELECT target, term, round(ln((w + 1.0) / (total + v)), 6) AS logp FROM grid, v""",
    "naive_bayes_predict": f"""WITH {_TERMS}, fit AS (SELECT target, term, ln((w + 1.0) / (total + v)) AS logp FROM grid, v),
prior AS (SELECT target, ln(count(*) / (SELECT count(*) FROM labelled)) AS prior FROM labelled GROUP BY 1),
words AS (SELECT CAST(doc_id AS VARCHAR) AS id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term
  FROM documents),
s AS (SELECT w.id, f.target, sum(logp) + max(prior) AS score
  FROM words w JOIN fit f ON w.term = f.term JOIN prior p ON p.target = f.target GROUP BY 1, 2),
best AS (SELECT id, arg_max(target, score) AS prediction FROM s GROUP BY id)
SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(prediction, (SELECT arg_max(target, prior) FROM prior)) AS prediction
FROM documents LEFT JOIN best ON best.id = CAST(doc_id AS VARCHAR)""",
    "naive_bayes_complement": f"""WITH {_TERMS}
SELECT target, term, round(-ln((term_total - w + 0.1) / (everything - total + 0.1 * v)), 6) AS logp FROM grid, v""",
    "gaussian_moments": f"""WITH {_GAUSS}
SELECT target, CAST(dim AS INTEGER) AS dim, n, round(mean, 6) AS mean, round(var, 6) AS var FROM moments""",
    "naive_bayes_gaussian": f"""WITH {_GAUSS},
eps AS (SELECT 4e-4 * max(v) AS e FROM (SELECT var_pop(x) AS v FROM cells GROUP BY dim)),
s AS (SELECT vec_id, target,
        ln(max(n) / (SELECT count(*) FROM embeddings))
        - 0.5 * sum(ln(2 * pi() * (var + e)) + (x - mean) * (x - mean) / (var + e)) AS score
  FROM cells JOIN moments USING (dim), eps GROUP BY 1, 2)
SELECT CAST(vec_id AS VARCHAR) AS id, arg_max(target, score) AS prediction FROM s GROUP BY vec_id""",
    "adaboost_rounds": _adaboost_sql(),
    "network_losses": _descent_sql(),
    "pruned_forest": f"""WITH c AS (
  SELECT c_custkey, c_custkey % 4 AS x, CASE WHEN c_custkey // 4 % 20 < {list(SHARES)}[c_custkey % 4 + 1] THEN 1.0 ELSE 0.0 END AS y FROM customer),
leaves AS (SELECT x = 0 AS first, x = 3 AS last, avg(y) AS p, count(*) / (SELECT count(*) FROM c) AS part FROM c GROUP BY 1, 2),
risks AS (SELECT first, last, p, 2 * p * (1 - p) * part AS risk FROM leaves),
rest AS (SELECT avg(y) AS p, 2 * avg(y) * (1 - avg(y)) * count(*) / (SELECT count(*) FROM c) AS risk FROM c WHERE x > 0),
weak AS (SELECT rest.risk - (SELECT sum(risk) FROM risks WHERE NOT first) <= {ALPHA} AS falls, rest.p AS p FROM rest)
SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(r.p > 0.5 AS INTEGER) AS whole,
  CAST((CASE WHEN falls AND x > 0 THEN weak.p ELSE r.p END) > 0.5 AS INTEGER) AS pruned,
  round(CASE WHEN falls AND x > 0 THEN weak.p ELSE r.p END, 6) AS share
FROM c JOIN risks r ON r.first = (x = 0) AND r.last = (x = 3), weak""",
    "text_model": f"""WITH {_folded_sql(_WORD_TERMS, 5, "SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents").replace("(SELECT unnest(range(0, 5)) AS fold)", "(SELECT -1 AS fold)").replace("own <> fold AS kept", "own IS NOT NULL AS kept")},
{_CHOSEN.format(fit=_MULTINOMIAL.format(alpha=1.0), base=_PRIOR)}
SELECT id, ['negative', 'positive', 'neutral'][p + 1] AS sentiment FROM chosen""",
    "cross_validate": f"{_cross_sql(_COMPLEMENT.format(alpha=0.1), 'SELECT fold, target, 0.0 AS base FROM classes', 5)} SELECT fold, {_ROUNDED} FROM m",
    "cross_validate_gaussian": _cross_sql(
        "SELECT fold, target, term, mean / var AS a, -0.5 / var AS b FROM normal",
        "SELECT fold, target, ln(max(rows) / max(n)) - 0.5 * sum(ln(2 * pi() * var) + mean * mean / var) AS base "
        "FROM normal JOIN classes USING (fold, target) JOIN n USING (fold) GROUP BY 1, 2",
        10, _SINGLE_WORDS, _DENSITIES,
    ) + f" SELECT fold, {_ROUNDED} FROM m",
    "experiment_grid": _grid_sql(),
    "best_fold_model": f"""WITH sizes AS (SELECT label AS target, count(*) AS n FROM embeddings GROUP BY 1),
before AS (SELECT target, coalesce(sum(n) OVER (ORDER BY target ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM sizes),
placed AS (
  SELECT vec_id AS id, label AS target, embedding,
    (b + row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR) || '|42'), CAST(vec_id AS VARCHAR)) - 1) % 5 AS own
  FROM embeddings JOIN before ON target = label),
points AS (SELECT id, target, own, generate_subscripts(embedding, 1) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM placed),
folds AS (SELECT unnest(range(0, 5)) AS fold),
spread AS (SELECT fold, 4e-4 * max(v) AS e FROM (
  SELECT fold, dim, var_pop(x) AS v FROM points, folds WHERE own <> fold GROUP BY 1, 2) GROUP BY 1),
normal AS (
  SELECT fold, target, dim, avg(x) AS mean, var_pop(x) + max(e) AS var, count(*) AS rows
  FROM points JOIN folds ON own <> fold JOIN spread USING (fold) GROUP BY 1, 2, 3),
prior AS (SELECT fold, target, ln(rows / sum(rows) OVER (PARTITION BY fold)) AS prior
  FROM (SELECT fold, target, max(rows) AS rows FROM normal GROUP BY 1, 2)),
reached AS (
  SELECT n.fold, c.id, n.target, sum(-0.5 * (ln(2 * pi() * var) + (x - mean) * (x - mean) / var)) AS x
  FROM points c JOIN normal n USING (dim) GROUP BY 1, 2, 3),
chosen AS (
  SELECT r.fold, id, r.target AS p FROM reached r JOIN prior USING (fold, target)
  QUALIFY row_number() OVER (PARTITION BY r.fold, id ORDER BY x + prior DESC, r.target) = 1),
{_OF_FOLDS},
best AS (SELECT fold FROM m ORDER BY round("F1_macro", 12) DESC, fold LIMIT 1)
SELECT CAST(id AS VARCHAR) AS id, CAST(p AS INTEGER) AS prediction FROM chosen JOIN best USING (fold)""",
}
