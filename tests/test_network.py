"""Networks by summed gradients: gradients, dropout, schedule, early stop, storage."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from crowdtide.operators import models as M
from crowdtide.operators import network
from crowdtide.scratch import materialize


@pytest.mark.parametrize("activation", ["relu", "tanh", "sigmoid"])
def test_gradient_equals_differences(activation):
    rng = np.random.default_rng(2)
    sizes = [4, 6, 5, 3]
    flat = rng.normal(0, 0.5, sum(n * m + m for n, m in zip(sizes, sizes[1:])))
    x, weight = rng.normal(size=(7, 4)), rng.integers(0, 3, 7).astype(float)
    wanted = np.eye(3)[rng.integers(0, 3, 7)] * 0.9 + 0.1 / 3
    masks = [(rng.random((7, 6)) > 0.3) / 0.7, None]

    def loss(f):
        return network.loss_and_gradient(network._shaped(f, sizes), x, wanted, weight, activation, masks)

    gradient = network._flat(loss(flat)[1])
    for i in rng.choice(len(flat), 25, replace=False):
        step = np.zeros(len(flat))
        step[i] = 1e-6
        assert gradient[i] == pytest.approx((loss(flat + step)[0] - loss(flat - step)[0]) / 2e-6, rel=1e-4, abs=1e-6)


def test_dropout_depends_on_the_row_only():
    keys = np.array([5, -7, 1 << 60])
    u = network.uniform_of(keys, 1000, 3)
    assert (network.uniform_of(keys[::-1], 1000, 3)[::-1] == u).all() and (network.uniform_of(keys, 1000, 4) != u).any()
    assert abs(u.mean() - 0.5) < 0.03 and 0 <= u.min() and u.max() < 1


@pytest.fixture(scope="module")
def rings(spark):
    """A class inside a ring of the other: no line parts them."""
    angle, noise = F.rand(1) * 6.2832, F.rand(2) * 0.4
    rows = spark.range(0, 600, 1, 5).select(F.col("id"), F.pmod("id", F.lit(2)).cast("int").alias("target"), angle.alias("a"), noise.alias("n"))
    radius = F.col("target") * 1.2 + F.col("n")
    point = array_to_vector(F.array(radius * F.cos("a"), radius * F.sin("a")))
    return materialize(rows.select(F.col("id").cast("string").alias("id"), "target", point.alias("features")))


def test_training_is_the_same_on_other_partitions(spark, rings, monkeypatch):
    monkeypatch.setattr(network, "FAN", 2)
    options = {"n_models": 2, "layers": (8, 6), "epochs": 4, "dropout": 0.3, "label_smoothing": 0.1}
    one, two = (M.mlp_ensemble(r, **options) for r in (rings, rings.repartition(3)))
    assert np.allclose(one.losses, two.losses) and all(np.allclose(a, b) for a, b in zip(one.members, two.members))
    assert not np.allclose(one.members[0], one.members[1])


def test_early_stop_keeps_the_best_weights(spark, rings, tmp_path):
    model = M.mlp_ensemble(rings, n_models=2, layers=(16,), epochs=60, learning_rate=0.3, patience=2, val_size=0.3)
    for checks in model.checks:
        best = int(np.argmin(checks))
        assert len(checks) == 60 or len(checks) == best + 4
    scored = model.transform(rings)
    assert scored.filter("prediction = target").count() / 600 > 0.9
    M.save_pipeline(spark, None, model, str(tmp_path / "m"))
    again = M.load_pipeline(spark, str(tmp_path / "m"))
    assert again.model.checks == model.checks
    assert again.transform(rings).exceptAll(scored).count() == 0
