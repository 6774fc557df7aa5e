import numpy as np
import pytest
from pyspark.sql import functions as F

from crowdtide.functions import zeta as Z
from crowdtide.operators import powerlaw as P


def test_zeta_against_direct_sums():
    for s, a in ((2.0, 1.0), (3.5, 7.0), (1.8, 2.0)):
        terms = np.arange(2_000_000) + a
        rest = (2_000_000 + a) ** (1 - s) / (s - 1) + 0.5 * (2_000_000 + a) ** -s
        assert Z.hurwitz(s, a) == pytest.approx((terms**-s).sum() + rest, rel=1e-9)


def test_draws_invert_the_cdf():
    u = np.array([0.0, 0.2, 0.5, 0.9, 0.999, 1 - 1e-9])
    k = Z.draw(u, 2.5, 3)
    top = Z.hurwitz(2.5, 3.0)
    assert (Z.hurwitz(2.5, k.astype(float)) / top >= 1 - u).all()
    assert (Z.hurwitz(2.5, k + 1.0) / top < 1 - u + 1e-15).all()


def _histogram(spark, sample):
    values, counts = np.unique(sample, return_counts=True)
    rows = [(int(v),) for v, c in zip(values, counts) for _ in range(c)]
    return spark.createDataFrame(rows, "degree long")


def test_fit_finds_the_law_and_matches_a_grid(spark):
    rng = np.random.default_rng(4)
    sample = np.concatenate([Z.draw(rng.random(4000), 2.4, 6), rng.integers(1, 6, 1500)])
    fit = P.fit_power_law(_histogram(spark, sample)).first()
    assert fit["gamma"] == pytest.approx(2.4, abs=0.15) and 4 <= fit["xmin"] <= 12
    tail = sample[sample >= fit["xmin"]]
    grid = np.arange(1.01, 6, 0.001)
    likelihood = -len(tail) * np.log(Z.hurwitz(grid, float(fit["xmin"]))) - grid * np.log(tail).sum()
    assert fit["gamma"] == pytest.approx(grid[likelihood.argmax()], abs=0.002)
    assert fit["ntail"] == len(tail)


def test_chunks_of_candidates_give_the_same_fit(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = _histogram(spark, Z.draw(rng.random(1000), 2.0, 2))
    whole = P.fit_power_law(rows).first()
    monkeypatch.setattr(P, "CANDIDATES_PER_ROW", 3)
    assert P.fit_power_law(rows).first() == whole


def test_bootstrap_is_repeatable_and_spreads(spark):
    rng = np.random.default_rng(2)
    rows = _histogram(spark, Z.draw(rng.random(800), 2.5, 2))
    fits = sorted(map(tuple, P.bootstrap_fit(rows, 12).collect()))
    assert len(fits) == 12 and len({f[2] for f in fits}) > 3
    assert fits == sorted(map(tuple, P.bootstrap_fit(rows, 12).collect()))
    p = P.bootstrap_pvalue(rows, 20).first()
    assert 0 <= p["p"] <= 1 and p["sims"] == 20 and p["p"] > 0.05


def test_large_tails_are_drawn_by_table():
    rng = np.random.default_rng(0)
    values, counts = P._draw_tail(rng, 500_000, 2.5, 3, table=1000)
    assert counts.sum() == 500_000
    share = counts[values == 3][0] / 500_000
    assert share == pytest.approx(3**-2.5 / Z.hurwitz(2.5, 3.0), abs=0.005)
    assert values.max() > 1003


def test_sample_follows_the_law(spark):
    rows = P.sample_power_law(spark, 20_000, 2.5, 5).cache()
    k = np.array([r["k"] for r in rows.collect()])
    for start in (5, 8, 20, 60):
        assert (k >= start).mean() == pytest.approx(Z.hurwitz(2.5, float(start)) / Z.hurwitz(2.5, 5.0), abs=0.02)
    assert k.min() == 5
    again = P.draw_power_law(spark.range(20_000).repartition(3), "id", 2.5, 5).agg(F.sum("k")).first()[0]
    assert again == k.sum()
