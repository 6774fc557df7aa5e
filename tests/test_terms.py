"""Term tables, models over terms and randomised components, against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from crowdtide.operators import components, scale
from crowdtide.operators import models as M
from crowdtide.operators import terms as Te
from crowdtide.scratch import materialize


def test_lookup_splits_hot_keys(spark, monkeypatch):
    """A key with most of the uses is broadcast, the others are joined by shuffles; unknown keys go."""
    monkeypatch.setattr(scale, "HOT_KEYS", 20)
    keys = F.when(F.col("id") % 3 > 0, "the").otherwise(F.concat(F.lit("k"), F.pmod("id", F.lit(200))))
    rows = materialize(spark.range(3000).select("id", keys.alias("term")))
    table = materialize(rows.groupBy("term").agg(F.count(F.lit(1)).alias("uses"), F.md5("term").alias("x")).filter("term <> 'k3'"))
    found = scale.lookup(rows, table, "term", "uses", ["x"], "id")
    got = sorted(tuple(r) for r in found.collect())
    assert got == sorted(tuple(r) for r in rows.join(table.drop("uses"), "term").select("id", "term", "x").collect())
    assert len(got) < 3000 and scale.lookup(rows, table.limit(0), "term", "uses", ["x"], "id").count() == 0


def _entries(spark, rows):
    """rows: (target, {i: w})."""
    kind = "_row long, target int, entries array<struct<i:int,w:double>>"
    return spark.createDataFrame([(n, t, sorted(e.items())) for n, (t, e) in enumerate(rows)], kind)


def _random_entries(seed, n=60, features=15):
    rng = np.random.default_rng(seed)
    rows = [(int(rng.integers(3)), {int(i): float(rng.random()) for i in rng.choice(features, int(rng.integers(1, 8)), replace=False)}) for _ in range(n)]
    return rows + [(1, {})]


def _dense(rows, features=15):
    x = np.zeros((len(rows), features))
    for n, (_, e) in enumerate(rows):
        for i, w in e.items():
            x[n, i] = w
    return x, np.array([t for t, _ in rows])


def _plain_scores(x, y, kind, option):
    used = x.any(0)
    x = x[:, used]
    out = []
    for c in range(3):
        own, prior = x[y == c], math.log((y == c).mean())
        if kind == "multinomial":
            out.append(prior + x @ np.log((own.sum(0) + option) / (own.sum() + option * x.shape[1])))
        elif kind == "complement":
            rest = x[y != c].sum(0) + option
            out.append(-x @ np.log(rest / rest.sum()))
        else:
            var = own.var(0) + option * x.var(0).max()
            out.append(prior - 0.5 * (np.log(2 * math.pi * var) + (x - own.mean(0)) ** 2 / var).sum(1))
    return np.stack(out, 1)


@pytest.mark.parametrize("kind,option", [("multinomial", 0.5), ("complement", 0.1), ("gaussian", 1e-2)])
def test_models_over_terms_equal_dense_formulas(spark, tmp_path, kind, option):
    rows = _random_entries(3)
    frame = _entries(spark, rows)
    model = getattr(Te, kind)(frame, option)
    want = _plain_scores(*_dense(rows), kind, option).argmax(1)
    got = [int(r["prediction"]) for r in model.transform(frame).orderBy("_row").collect()]
    assert got == want.tolist()
    M.save_pipeline(spark, None, model, str(tmp_path / "m"))
    again = M.load_pipeline(spark, str(tmp_path / "m")).transform(frame).orderBy("_row").collect()
    assert [int(r["prediction"]) for r in again] == got


def test_gaussian_is_a_learner(spark):
    rows = _random_entries(4, 90)
    folds = M.cross_validate(_vectors(spark, rows), M.LEARNERS["naive_bayes_gaussian"], text_col=None, k=3)
    assert folds.count() == 3


def _vectors(spark, rows):
    frame = _entries(spark, rows).withColumn("features", Te.sparse_vector(15, F.col("entries")))
    return frame.select(F.col("_row").cast("string").alias("id"), "target", "features")


def test_sparse_vectors_keep_every_bit(spark):
    rows = _random_entries(5)
    x, _ = _dense(rows)
    got = [r["features"].toArray() for r in _vectors(spark, rows).orderBy(F.col("id").cast("int")).collect()]
    assert (np.stack(got) == x).all()


def test_grid_equals_single_runs(spark):
    words = F.when(F.col("id") % 3 == 0, "bad awful loss").when(F.col("id") % 3 == 1, "good gain moon").otherwise("news report good")
    docs = materialize(spark.range(90).select(
        F.col("id").cast("string").alias("id"), F.pmod("id", F.lit(3)).cast("int").alias("target"),
        F.concat_ws(" ", words, F.concat(F.lit("w"), F.pmod(F.xxhash64("id"), F.lit(7)))).alias("text"),
    ))
    grid = M.experiment_grid(docs, "naive_bayes_complement", {"alpha": [0.1, 2.0]}, {"min_df": [1, 4], "ngram_range": [(1, 1)]}, k=3)
    assert grid.count() == 12
    for alpha in (0.1, 2.0):
        one = M.cross_validate(docs, M.naive_bayes_complement, {"alpha": alpha}, {"min_df": 4, "ngram_range": (1, 1)}, k=3)
        name = f"naive_bayes_complement {{'alpha': {alpha}}} {{'min_df': 4, 'ngram_range': (1, 1)}}"
        mine = grid.filter(F.col("Name") == name).drop("Name")
        assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, one.collect()))


@pytest.mark.parametrize("name", ["naive_bayes_multinomial", "naive_bayes_complement", "naive_bayes_gaussian"])
def test_folds_at_once_equal_single_folds(spark, monkeypatch, name):
    """All folds share one table of terms and one of cells; a class of one text is unknown to its own fold."""
    monkeypatch.setattr(scale, "HOT_IN_PLACE", 12)
    kind = F.when(F.col("id") == 7, 3).otherwise(F.pmod("id", F.lit(3))).cast("int")
    words = [F.concat(F.lit(f"w{n}"), F.floor(F.pmod(F.xxhash64("id", F.lit(n)), F.lit(9)) / (kind + 1))) for n in range(6)]
    docs = materialize(spark.range(80).select(
        F.col("id").cast("string").alias("id"), kind.alias("target"),
        F.when(F.col("id") == 11, "").otherwise(F.concat_ws(" ", F.lit("all"), *words)).alias("text"),
    ))
    options = {"min_df": 3, "ngram_range": (1, 2)}
    single, _ = M.cross_validate(docs, M.LEARNERS[name], None, options, k=3, keep_models=True)
    plain = lambda df: sorted(tuple(round(x, 9) for x in r) for r in df.collect())
    want = plain(single)
    written = []
    monkeypatch.setattr(Te, "materialize", lambda df, label="step": written.append(label) or materialize(df, label))
    got = M.cross_validate(docs, M.LEARNERS[name], None, options, k=3)
    assert got.columns == single.columns and plain(got) == want
    assert written.count("terms") == written.count("cells") == 1


def test_texts_are_scored_without_gathered_entries(spark, monkeypatch):
    monkeypatch.setattr(scale, "HOT_IN_PLACE", 12)
    words = [F.concat(F.lit(f"w{n}"), F.pmod(F.xxhash64("id", F.lit(n)), F.lit(9))) for n in range(6)]
    docs = materialize(spark.range(60).select(
        "id", F.pmod("id", F.lit(3)).cast("int").alias("target"),
        F.when(F.col("id") > 4, F.concat_ws(" ", F.lit("all"), *words)).alias("text"),
    ))
    features = Te.text_features(docs.filter("id % 4 > 0"), min_df=3)
    train = materialize(features.transform(docs.filter("id % 4 > 0")))
    for learner in (M.naive_bayes_complement, M.naive_bayes_gaussian):
        model = learner(train)
        got = M.FittedClassifier(features, model).transform(docs)
        assert "collect_list" not in got._jdf.queryExecution().toString()
        plain = model.transform(materialize(features.transform(docs)))
        assert sorted(r[::3] for r in got.collect()) == sorted(tuple(r) for r in plain.select("id", "prediction").collect())


def _wide(seed, rows=300, features=120, rank=4):
    """Sparse rows of a few strong directions and noise."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, rank)) @ (rng.normal(size=(rank, features)) * np.array([9, 6, 4, 2.5])[:, None])
    x += rng.normal(0, 0.3, x.shape) + 1
    x[rng.random(x.shape) < 0.4] = 0
    return x


def test_components_of_wide_rows(spark, tmp_path, monkeypatch):
    """Fewer test columns than features, and triangles that need a tree."""
    monkeypatch.setattr(components, "EXTRA", 6)
    monkeypatch.setattr(components, "FAN", 2)
    x = _wide(6)
    cells = [(n, 0, {int(i): float(x[n, i]) for i in np.flatnonzero(x[n])}) for n in range(len(x))]
    frame = materialize(_entries(spark, [(t, e) for _, t, e in cells]).repartition(7))
    found = components.Projection.fit(frame, "_row", 3, tolerance=1e-10)
    centred = x - x.mean(0)
    u, s, vt = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(found.variances, s[:3] ** 2 / (len(x) - 1), rtol=1e-7)
    v = np.zeros((x.shape[1], 3))
    for r in found.table.collect():
        v[r["i"]] = r["v"]
    assert np.allclose(v.T @ v, np.eye(3), atol=1e-9)
    assert np.allclose(np.abs((v * vt[:3].T).sum(0)), 1, atol=1e-6) and (v[np.abs(v).argmax(0), range(3)] > 0).all()
    found.save(str(tmp_path / "p"))
    for one in (found, components.Projection.load(spark, str(tmp_path / "p"))):
        placed = {r["_row"]: [e["w"] for e in r["entries"]] for r in one.apply(frame).collect()}
        assert np.allclose([placed[n] for n in range(len(x))], centred @ v, atol=1e-8)


def test_projected_text_features_are_stored(spark, tmp_path):
    docs = spark.createDataFrame(
        [(str(i), t, i % 2) for i, t in enumerate(["good gain up", "bad loss down", "good up", "bad down", "gain gain up", "loss"] * 4)],
        "id string, text string, target int",
    )
    features = Te.text_features(docs, min_df=1, ngram_range=(1, 1), n_components=2)
    model = M.naive_bayes_gaussian(features.transform(docs))
    M.save_pipeline(spark, features, model, str(tmp_path / "m"))
    loaded = M.load_pipeline(spark, str(tmp_path / "m"))
    scored = loaded.transform(docs)
    assert scored.columns == [*docs.columns, "prediction"]
    assert scored.filter("prediction = target").count() == docs.count()
