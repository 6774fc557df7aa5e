"""Iterative learners: what a round sends to the driver, and tasks that grow in number with the rows."""

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from crowdtide.operators import models as M, network
from crowdtide.scratch import Rounds


def _rows(spark, n: int) -> DataFrame:
    x = F.pmod("id", F.lit(25)).cast("double")
    return spark.range(n).select(
        F.col("id").cast("string").alias("id"), (F.pmod(x * 7, F.lit(25)) < 11).cast("int").alias("target"),
        array_to_vector(F.array(x)).alias("features"),
    )


def test_boosting_joins_weights_once_a_round_and_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(M, "LEARNED_PER_TASK", 200)
    plans, write = [], Rounds.write

    def watched(self, df, **totals):
        plans.append((df._jdf.queryExecution().executedPlan().toString(), df.rdd.getNumPartitions()))
        return write(self, df, **totals)

    monkeypatch.setattr(Rounds, "write", watched)
    model = M.adaboost(_rows(spark, 1000), 3, learning_rate=1.0, max_features=1.0, max_depth=1)
    assert len(model.trees) == 3 and len(plans) == 6
    assert not any("Broadcast" in p for p, _ in plans)
    assert ["Join" in p for p, _ in plans] == [False, False, True, False, True, False]
    assert [n for _, n in plans[::2]] == [5, 5, 5]


def test_boosting_deals_many_rows_of_a_small_file(spark, monkeypatch):
    monkeypatch.setattr(M, "LEARNED_PER_TASK", 100)
    seen, whole = [], M.OneVsRest

    class Watched(whole):
        def fit(self, dataset, params=None):
            seen.append((dataset.rdd.getNumPartitions(), dataset.count()))
            return super().fit(dataset, params)

    monkeypatch.setattr(M, "OneVsRest", Watched)
    rows = _rows(spark, 1000).coalesce(1)
    scored = M.gradient_boosting(rows, 3, max_features=1.0).transform(rows)
    assert seen == [(10, 1000)] and scored.count() == 1000


def _network(spark, **options):
    x = (F.col("id") / 300).cast("double")
    rows = spark.range(300).coalesce(1).select(
        "id", F.array(x, 1 - x).alias("x"), (x > 0.4).cast("int").alias("target"),
        F.array(F.lit(1.0), F.pmod("id", F.lit(3)).cast("double")).alias("weights"), F.lit(False).alias("held"),
    )
    return network.train_networks(rows, [2, 4, 2], 2, 3, **options)


def test_network_rows_are_dealt_to_tasks_and_pieces(spark, monkeypatch):
    one, sums, seen = _network(spark), network._sums, []

    def watched(rows, work, width):
        def counted(batch):
            assert batch.num_rows <= 7
            return work(batch)

        seen.append(rows.inputFiles())
        return sums(rows, counted, width)

    monkeypatch.setattr(network, "_sums", watched)
    monkeypatch.setattr(network, "ROWS_PER_TASK", 60)
    monkeypatch.setattr(network, "ROWS_PER_PIECE", 7)
    cut = _network(spark)
    assert [len(files) for files in seen] == [5, 5, 5]
    assert np.allclose(one.losses, cut.losses) and np.allclose(one.members, cut.members)
