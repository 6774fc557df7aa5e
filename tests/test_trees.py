"""Cost-complexity pruning and boosting with shares of the features."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from crowdtide.operators import models as M
from crowdtide.operators.pruning import weakest_links
from crowdtide.scratch import materialize


def _best(left, right, risk, alpha, t=0):
    """(cost, leaves) of the smallest cheapest branch, by trying both choices everywhere."""
    own = (risk[t] + alpha, 1)
    if left[t] < 0:
        return own
    parts = [_best(left, right, risk, alpha, c[t]) for c in (left, right)]
    kept = (sum(p[0] for p in parts), sum(p[1] for p in parts))
    return own if own[0] <= kept[0] + 1e-12 else kept


def _random_tree(rng):
    left, right, risk = [-1], [-1], [1.0]
    for _ in range(int(rng.integers(0, 25))):
        t = int(rng.choice([i for i in range(len(left)) if left[i] < 0]))
        left[t], right[t] = len(left), len(left) + 1
        share = rng.random(2)
        risk += (risk[t] * rng.random() * share / share.sum()).tolist()
        left += [-1, -1]
        right += [-1, -1]
    return np.array(left), np.array(right), np.array(risk)


def test_weakest_links_leave_the_cheapest_tree():
    rng = np.random.default_rng(1)
    for _ in range(300):
        left, right, risk = _random_tree(rng)
        for alpha in (0.0, 0.01, 0.1, 2.0):
            cut = weakest_links(left, right, risk, alpha)
            leaves, todo = [], [0]
            while todo:
                t = todo.pop()
                if left[t] < 0 or cut[t]:
                    leaves.append(t)
                else:
                    todo += [left[t], right[t]]
            cost, size = _best(left, right, risk, alpha)
            assert sum(risk[leaves]) + alpha * len(leaves) == pytest.approx(cost) and len(leaves) == size


@pytest.fixture(scope="module")
def noisy(spark):
    """One feature tells the class, with noise; three do not."""
    x = [F.rand(s) for s in range(4)]
    rows = spark.range(0, 400, 1, 2).select(F.col("id").cast("string").alias("id"), F.array(*x).alias("x"), F.rand(9).alias("noise"))
    target = ((F.col("x")[0] > 0.5) != (F.col("noise") < 0.15)).cast("int")
    return materialize(rows.select("id", target.alias("target"), array_to_vector("x").alias("features")))


def test_pruned_forests_are_smaller_and_stored(spark, noisy, tmp_path):
    whole, cut = (M.random_forest(noisy, n_estimators=4, ccp_alpha=a) for a in (0.0, 0.02))
    sizes = [[t.numNodes for t in m.trees] for m in (whole, cut)]
    assert len(sizes[1]) == 4 and all(0 < b < a / 4 for a, b in zip(*sizes))
    M.save_pipeline(spark, None, cut, str(tmp_path / "m"))
    again = M.load_pipeline(spark, str(tmp_path / "m"))
    assert [t.numNodes for t in again.model.trees] == sizes[1]
    assert [t.numNodes for t in M.random_forest(noisy, n_estimators=2, ccp_alpha=1.0).trees] == [1, 1]


def test_boosted_trees_draw_their_features(noisy):
    model = M.adaboost(noisy, n_estimators=8, learning_rate=0.5, max_features=0.25, max_depth=1)
    used = {int(i) for tree in model.trees for i in tree.featureImportances.indices}
    assert len(model.trees) > 3 and len(used) > 1
    assert all(0 < e < 0.5 for e in model.errors)
