import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crowdtide.operators import scale as S


def _skewed(spark):
    """Half of the rows in one group, half of that on one value; one null key, null values."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        key = "hot" if i % 2 else rng.choice(["a", "b", None])
        value = 5.0 if key == "hot" and i % 4 == 1 else rng.gauss(0, 100)
        rows.append((key, value if i % 97 else None, float(rng.randrange(5))))
    return spark.createDataFrame(rows, "key string, x double, y double"), rows


@pytest.mark.parametrize("limit", [10, 60, 1_000_000])
def test_quantiles_match_brute_force(spark, limit):
    df, rows = _skewed(spark)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = S.quantiles(df, ["key"], ["x", "y"], probs, in_memory_values=limit, splits=8).collect()
    assert len(got) == 4
    for row in got:
        for i, col in enumerate(["x", "y"], start=1):
            values = [r[i] for r in rows if r[0] == row["key"] and r[i] is not None]
            for p in probs:
                assert row[S.quantile_name(col, p)] == pytest.approx(np.quantile(values, p), abs=1e-9)


@pytest.mark.parametrize("limit", [2, 1_000_000])
def test_groups_without_values_keep_their_row(spark, limit):
    rows = [("a", float(i)) for i in range(9)] + [("b", None)] * 3
    df = spark.createDataFrame(rows, "key string, x double")
    got = {r["key"]: r["x_q50"] for r in S.quantiles(df, ["key"], ["x"], [0.5], limit, splits=3).collect()}
    assert got == {"a": 4.0, "b": None}


@pytest.mark.parametrize("limit", [20, 1_000_000])
def test_global_quantiles(spark, limit):
    df, rows = _skewed(spark)
    got = S.quantiles(df, [], ["x"], [0.6], in_memory_values=limit, splits=4).first()
    assert got["x_q60"] == pytest.approx(np.quantile([r[1] for r in rows if r[1] is not None], 0.6))


def test_hash_rank_is_a_permutation_per_key(spark):
    df = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, "rare").when(F.col("id") % 5 == 0, F.lit(None)).otherwise("hot").alias("k"),
        "id",
    )
    ranked = S.hash_rank(df, ["k"], "id", 42, "place").collect()
    assert len(ranked) == 2000
    for key in ("rare", "hot", None):
        places = sorted(r["place"] for r in ranked if r["k"] == key)
        assert places == list(range(len(places)))
    again = {r["id"]: r["place"] for r in S.hash_rank(df.repartition(3), ["k"], "id", 42, "place").collect()}
    assert again == {r["id"]: r["place"] for r in ranked}
    other = {r["id"]: r["place"] for r in S.hash_rank(df, ["k"], "id", 43, "place").collect()}
    assert other != again


def test_running_totals_and_index(spark):
    df = spark.range(500).select(((F.col("id") * 7919) % 500).alias("t"), (F.col("id") % 3).alias("v"))
    got = S.running_totals(df, ["t"], {"s": F.col("v"), "n": F.lit(1)}, partitions=7).orderBy("t").collect()
    assert [r["n"] for r in got] == list(range(1, 501))
    assert [r["s"] for r in got] == list(np.cumsum([r["v"] for r in got]))
    numbered = S.ordered_index(df, [-F.col("t")], "i", start=10).orderBy("i").collect()
    assert [r["i"] for r in numbered] == list(range(10, 510))
    assert [r["t"] for r in numbered] == list(range(499, -1, -1))


def test_uniform_does_not_depend_on_partitions(spark):
    rows = spark.range(4000)
    one = {r[0]: r[1] for r in rows.select("id", S.uniform(1, F.col("id"))).collect()}
    two = {r[0]: r[1] for r in rows.repartition(5).select("id", S.uniform(1, F.col("id"))).collect()}
    assert one == two
    values = np.array(list(one.values()))
    assert values.min() >= 0 and values.max() < 1 and abs(values.mean() - 0.5) < 0.02


def test_a_sketch_beyond_its_bound_is_made_good(spark):
    """With a made-up accuracy the cuts lie beside the ranks; the exact counts tell."""
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_000).cast("double").alias("x"))
    worse = df.withColumn("x", F.when(F.col("x") < 15_000, F.lit(1.0)).otherwise(F.col("x")))
    for table, want in ((df, 9999.5), (worse, 1.0)):
        got = S.quantiles(table, [], ["x"], [0.5, 0.9], accuracy=50, in_memory_values=100, splits=7).first()
        assert got["x_q50"] == want and got["x_q90"] == pytest.approx(17_999.1)


def test_quantiles_of_nothing_and_aggregates_beside_them(spark):
    empty = spark.createDataFrame([], "k string, x double")
    got = S.quantiles(empty, [], ["x"], [0.5], also={"n": F.count(F.lit(1))}).collect()
    assert [tuple(r) for r in got] == [(0, None)]
    assert S.quantiles(empty, ["k"], ["x"], [0.5]).count() == 0
    some = spark.createDataFrame([(None, 1.0), (None, 4.0), ("a", None)], "k string, x double")
    got = S.quantiles(some, ["k"], ["x"], [0.5], also={"n": F.count(F.lit(1))}).collect()
    assert {tuple(r) for r in got} == {(None, 2, 2.5), ("a", 1, None)}


def test_running_sums_shuffle_the_rows_once(spark, monkeypatch):
    """Falling sums, nulls and extra columns; the written ranges come from one exchange."""
    plans = []
    whole = S.materialize

    def noted(df, label="step"):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return whole(df, label)

    monkeypatch.setattr(S, "materialize", noted)
    df = spark.range(300).select(
        F.concat(F.lit("k"), F.lpad(F.col("id"), 4, "0")).alias("t"),
        F.when(F.col("id") % 7 != 0, F.col("id") % 5 - 3).alias("_p"),
        (F.col("id") / 8).alias("half"),
    )
    got = S.running_totals(df, ["t"], {"s": F.col("_p"), "h": F.col("half")}, partitions=9).orderBy("t").collect()
    rows = df.orderBy("t").collect()
    assert [r["s"] for r in got] == list(np.cumsum([r["_p"] or 0 for r in rows]))
    assert [r["h"] for r in got] == pytest.approx(list(np.cumsum([r["half"] for r in rows])))
    assert [r["i"] for r in S.ordered_index(df, ["t"], "i").orderBy("t").collect()] == list(range(300))
    ranges = [p for label, p in plans if label == "ranges"]
    assert len(ranges) == 2 and all(p.count("Exchange rangepartitioning") == 1 and "hashpartitioning" not in p for p in ranges)
    assert S.running_totals(df.limit(0), ["t"], {"s": F.col("_p")}).count() == 0
