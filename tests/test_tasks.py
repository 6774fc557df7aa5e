"""Work is dealt to tasks by its size: more input makes more tasks and not larger ones."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from crowdtide.operators import bayes, features, graph_build, models
from crowdtide.operators.scale import dealt_texts, in_tasks
from crowdtide.plans import posts
from crowdtide.streaming import incremental


def test_texts_are_dealt_by_their_length(spark):
    texts = spark.range(60).select(F.col("id").cast("string").alias("id"), F.repeat(F.lit("ab "), 100).alias("text"))
    dealt = dealt_texts(texts, "id", "text", characters=300)
    assert dealt.rdd.getNumPartitions() == max(60, spark.sparkContext.defaultParallelism)
    assert dealt.count() == 60
    none = spark.createDataFrame([("1", None)], "id string, text string")
    assert dealt_texts(none, "id", "text").collect() == none.collect()


def test_terms_are_counted_in_tasks_of_bounded_text(spark, monkeypatch):
    monkeypatch.setattr(features, "dealt_texts", lambda df, key, text: dealt_texts(df, key, text, characters=30))
    texts = spark.range(50).select(F.col("id").cast("string").alias("id"), F.lit("one two two three four five").alias("text"))
    counts = features.term_counts(texts)
    assert counts.rdd.getNumPartitions() == 45
    assert {(r["term"], r["tf"]) for r in counts.filter("id = '7'").collect()} == {("one", 1), ("two", 2), ("three", 1), ("four", 1), ("five", 1)}


def test_a_term_meets_its_uses_once(spark):
    """Classes without a known term are no candidates, equal scores go to the smaller class, null classes never win."""
    fitted = spark.createDataFrame(
        [(0, "a", -1.0), (1, "a", -1.0), (2, "b", -9.0), (1, "c", -2.0), (0, "c", -3.0)], "target int, term string, logp double"
    )
    priors = spark.createDataFrame([(0, -1.0), (1, -1.0), (2, -0.5), (None, 0.0)], "target int, prior double")
    rows = spark.createDataFrame([("x", "a", 1.0), ("y", "b", 2.0), ("z", "c", 1.0), ("w", "?", 1.0)], "id string, term string, w double")
    found = bayes.term_predict(rows, fitted, priors.filter("target IS NOT NULL"))
    assert dict(found.collect()) == {"x": 0, "y": 2, "z": 1, "w": 2}
    assert dict(bayes.term_predict(rows, fitted, priors).collect()) == {"x": 0, "y": 2, "z": 1, "w": None}
    joined = bayes.term_predict(rows, fitted, priors)._jdf.queryExecution().optimizedPlan().toString()
    assert "logp" not in joined  # scores come as one row per term


def test_character_ngrams_come_from_the_longest_of_each_place(spark):
    rows = spark.createDataFrame([("1", "abcdeab"), ("2", "ab"), ("3", "a😀bc"), ("4", None), ("5", "abc")], "id string, text string")
    plain = features.term_rows(rows, ngram_range=(3, 5), analyzer="char").groupBy("term").agg(F.count(F.lit(1)).alias("tf"))
    found = features.char_term_totals(rows, ngram_range=(3, 5))
    assert sorted(found.collect()) == sorted(plain.collect())
    assert features.term_rows(rows, ngram_range=(3, 5), analyzer="char", longest=True).count() == 5 + 2 + 1


def test_known_tokens_are_found_where_the_texts_are(spark):
    rows = spark.createDataFrame([("1", "b a c"), ("2", ""), ("3", "a a")], "id string, text string")
    vocab = features.index_vocab(features.build_vocab(rows, max_tokens=2))
    found = features.vectorize_text(rows, vocab)
    assert {r["id"]: r["tokens"] for r in found.collect()} == {"1": [3, 2, 1], "2": [], "3": [2, 2]}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "token-ids" in plan or "RepartitionByExpression" in plan


def test_rows_are_dealt_by_their_number(spark, monkeypatch):
    table = spark.range(1000)
    assert in_tasks(table, "id", rows=100).rdd.getNumPartitions() == 10
    assert in_tasks(table.limit(0), "id").count() == 0
    edges = spark.createDataFrame([("1", "2", 5), ("3", "2", 7), ("3", "4", 1)], "source string, target string, weight long")
    info = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", "x"), ("4", "z")], "id string, Username string")
    monkeypatch.setattr(graph_build, "in_tasks", lambda df, *keys: in_tasks(df, *keys, rows=1))
    renamed = graph_build.rename_nodes(edges, info, merge="last")
    assert sorted(map(tuple, renamed.collect())) == [("x", "y", 7), ("x", "z", 1)]
    monkeypatch.setattr(incremental, "ROWS_PER_SUM", 2)
    summed = incremental._summed(edges.unionByName(edges))
    assert sorted(map(tuple, summed.collect())) == [("1", "2", 10), ("3", "2", 14), ("3", "4", 2)]
    assert incremental._summed(edges.unionByName(edges)).rdd.getNumPartitions() == 3


def test_a_forest_deals_rows_by_their_draws(spark, monkeypatch):
    rows = spark.range(200).select(array_to_vector(F.array(F.col("id").cast("double"))).alias("features"), (F.col("id") >= 100).cast("int").alias("target"))
    seen = []
    fit = models.RandomForestClassifier.fit
    monkeypatch.setattr(models.RandomForestClassifier, "fit", lambda self, df: seen.append(df.rdd.getNumPartitions()) or fit(self, df))
    monkeypatch.setattr(models, "DRAWS_PER_TASK", 100)
    model = models.random_forest(rows.coalesce(1), n_estimators=5)
    assert seen == [10]
    assert model.transform(rows).filter("prediction <> target").count() <= 4


def test_mail_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    suppliers = spark.range(40).select(F.col("id").alias("s_suppkey"), F.lit(3).alias("s_nationkey"), F.concat(F.lit("n"), "id").alias("s_name"))
    suppliers.coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    monkeypatch.setattr(posts, "FILES_PER_TASK", 1)
    asked, repartition = [], type(suppliers).repartition
    monkeypatch.setattr(type(suppliers), "repartition", lambda self, n, *cols: asked.append((n, cols)) or repartition(self, n, *cols))
    found = posts.read_messages_query(spark, str(tmp_path))
    assert asked == [(40, ("box",))]
    assert sorted(r["subject"] for r in found.collect()) == sorted(f"n{i}" for i in range(40))
