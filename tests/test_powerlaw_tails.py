"""Fits of all tails of a replicate at once, against one tail at a time."""

import numpy as np
import pytest

from crowdtide.functions import zeta
from crowdtide.operators import powerlaw as P


def _distance(values, counts, start, gamma):
    x = values[start:]
    data = np.cumsum(counts[start:]) / counts[start:].sum()
    beyond = ((x + 1) / x[0]) ** -gamma * zeta.scaled_hurwitz(gamma, x + 1) / zeta.scaled_hurwitz(gamma, x[0])
    return np.abs(data - (1 - beyond)).max()


@pytest.mark.parametrize("cells", [1, 70, 1_000_000])
def test_distances_of_tails_laid_end_to_end(cells):
    rng = np.random.default_rng(3)
    values, counts = np.unique(rng.zipf(2.1, 3000), return_counts=True)
    values, counts, starts = values.astype(float), counts.astype(float), np.arange(40)
    gammas = rng.uniform(1.2, 6.0, 40)
    found = zeta.ks_distances(values, counts, starts, gammas, cells)
    assert np.allclose(found, [_distance(values, counts, s, g) for s, g in zip(starts, gammas)], rtol=1e-12, atol=1e-15)
    assert len(zeta.ks_distances(values, counts, starts[:0], gammas[:0], cells)) == 0


def test_candidates_of_a_replicate_are_fitted_together(spark, monkeypatch):
    """The chunks of a replicate lie in one task, so cutting them small only makes its arrays short."""
    rows = spark.createDataFrame([(0, list(range(1, 201)), [400 // k + 1 for k in range(1, 201)])], P.REPLICATE)
    whole = P.candidate_fits(rows).orderBy("xmin").collect()
    assert P.candidate_fits(rows).count() == len(whole) > 100
    assert P.CANDIDATES_PER_REPLICATE > 200 > P.CANDIDATES_PER_ROW
    monkeypatch.setattr(P, "CANDIDATES_PER_REPLICATE", 7)
    cut = P.candidate_fits(rows).orderBy("xmin").collect()
    assert [r["xmin"] for r in cut] == [r["xmin"] for r in whole]
    assert np.allclose([r["ks"] for r in cut], [r["ks"] for r in whole])
