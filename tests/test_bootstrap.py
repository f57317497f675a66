"""The bootstrap by counts against exact distributions and plain resampling."""

import math

import numpy as np
import pytest

from colloquy.operators import bootstrap


def cdf(n, p):
    return np.cumsum([math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)])


@pytest.mark.parametrize("n,p", [(1, 0.5), (7, 0.3), (40, 0.02), (300, 0.97), (900, 0.5)])
def test_binomial_quantiles_are_exact(n, p):
    u = np.random.default_rng(n).random(500)
    want = np.searchsorted(cdf(n, p), u, side="left")
    assert bootstrap.binomial_quantile(np.full(500, n), p, u).tolist() == want.tolist()
    assert bootstrap.binomial_quantile(np.array([0, n]), 1.0, u[:2]).tolist() == [0, n]


def test_counts_are_multinomial():
    masses = np.array([5, 1, 30, 14, 50])
    k = bootstrap.halved(np.full(4000, 100), masses, "s", np.arange(4000))
    assert (k.sum(axis=1) == 100).all()
    assert np.abs(k.mean(axis=0) - masses).max() < 0.4
    want = 100 * (np.diag(masses / 100) - np.outer(masses, masses) / 1e4)
    assert np.abs(np.cov(k.T) - want).max() < 1.5
    # replicates don't follow one another
    x = k[:, 4] - k[:, 4].mean()
    assert all(abs((x[lag:] * x[:-lag]).mean() / (x * x).mean()) < 0.06 for lag in (1, 2, 3157 % 97))


def test_many_levels_and_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "BLOCK", 50)
    monkeypatch.setattr(bootstrap, "CHUNK", 150)
    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(size=400), "b": rng.exponential(size=300), "c": np.array([0.0, 1.0] * 50)}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("a", None), (None, 1.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in bootstrap.bootstrap_by(df, "g", "v", ["a", "b", "c", "none"], replicates=2000).collect()}
    assert (got["none"].n, got["none"].low) == (0, None) and set(got) == {"a", "b", "c", "none"}
    for g, x in groups.items():
        plain = np.percentile(rng.choice(x, (4000, len(x))).mean(axis=1), [2.5, 97.5])
        error = 5 * x.std() / math.sqrt(len(x)) * math.sqrt(0.025 * 0.975 / 2000) / 0.0584
        assert got[g].n == len(x) and got[g].mean == pytest.approx(x.mean())
        assert abs(got[g].low - plain[0]) < error and abs(got[g].high - plain[1]) < error


def test_no_row_per_draw(spark):
    """Ten million values of two levels take no longer than a hundred."""
    df = spark.range(10_000_000).selectExpr("cast(id % 4 = 0 AS double) AS v")
    r = bootstrap.bootstrap_mean(df, "v", replicates=1000).first()
    half = 1.96 * math.sqrt(0.25 * 0.75 / 1e7)
    assert r.n == 10_000_000 and abs((r.high - r.low) / (2 * half) - 1) < 0.15
