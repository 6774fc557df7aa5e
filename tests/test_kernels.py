"""Kernels by landmarks: exact at the landmarks, close elsewhere, the same for sparse and dense rows."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from crowdtide.operators import kernels as K
from crowdtide.operators import models as M
from crowdtide.scratch import new_folder


def rows_of(sparse):
    """Points around four centres; every third row is a copy of the first one, one row is empty."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 12)) * (rng.random((4, 12)) < 0.5)
    x = [centres[i % 4] + (centres[i % 4] != 0) * rng.normal(0, 0.2, 12) for i in range(240)]
    x = [x[0] if i % 3 == 0 else np.zeros(12) if i == 7 else v for i, v in enumerate(x)]
    if not sparse:
        return x, [Vectors.dense(v) for v in x]
    return x, [Vectors.sparse(12, [(int(j), float(v[j])) for j in np.flatnonzero(v)]) for v in x]


@pytest.mark.parametrize("sparse", [False, True])
def test_kernel_values(spark, monkeypatch, sparse):
    monkeypatch.setattr(K, "CELLS", 100)
    x, vectors = rows_of(sparse)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], ["i", "features"])
    n, width, variance = K.cell_spread(df, "features")
    assert (n, width) == (240, 12) and variance == pytest.approx(np.var(np.stack(x)))
    landmarks = K.choose(df, "features", 40, n, 0.3, 1)
    dense = np.zeros((40, 12))
    for place, (columns, numbers) in enumerate(landmarks.rows):
        dense[place, columns] = numbers
    assert len(np.unique(dense, axis=0)) == len(landmarks.rows) == 40
    got = landmarks.features(df, "features", "k").orderBy("i").select(vector_to_array("k")).collect()
    phi = np.stack([r[0] for r in got])
    exact = np.exp(-0.3 * ((np.stack(x)[:, None] - np.stack(x)) ** 2).sum(2))
    at = [i for i, v in enumerate(x) if (dense == v).all(1).any()]
    assert len(at) >= 40 and np.abs(phi[at] @ phi.T - exact[at]).max() < 1e-6
    assert np.abs(phi @ phi.T - exact).max() < 0.35 and np.abs(phi @ phi.T - exact).mean() < 0.02


def test_fewer_different_rows_than_landmarks(spark):
    df = spark.createDataFrame([(Vectors.dense([float(i % 3), 1.0]),) for i in range(30)], ["features"])
    assert len(K.choose(df, "features", 50, 30, 1.0, 1).rows) == 3
    with pytest.raises(ValueError):
        K.cell_spread(df.limit(0), "features")


def test_svm_learns_a_ring_and_is_stored(spark):
    """No line parts a disc from a ring around it."""
    rng = np.random.default_rng(3)
    angles, far = rng.uniform(0, 2 * np.pi, 300), np.arange(300) % 2
    points = (np.stack([np.cos(angles), np.sin(angles)], 1) * np.where(far, 3.0, 1.0)[:, None]).tolist()
    df = spark.createDataFrame([(Vectors.dense(p), float(f)) for p, f in zip(points, far)], ["features", "target"])
    model = M.svm(df, components=60, max_iter=30)
    predicted = model.transform(df)
    assert "_kernel" not in predicted.columns
    right = predicted.filter(F.col("prediction") == F.col("target")).count()
    assert right >= 295
    path = new_folder(spark, "svm")
    M.save_pipeline(spark, None, model, path)
    again = M.load_pipeline(spark, path).transform(df)
    assert again.filter(F.col("prediction") == F.col("target")).count() == right
