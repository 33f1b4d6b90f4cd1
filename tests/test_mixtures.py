"""The variational mixture: what it finds, what it drops, and its odd inputs."""

import math

import numpy as np
import pytest

from tracekit.operators import mixtures as G


def test_digamma():
    for x in (1e-3, 0.5, 1.0, 3.3, 40.0, 1e6):
        step = 1e-5 * max(x, 1e-2)
        slope = (math.lgamma(x + step) - math.lgamma(x - step)) / (2 * step)
        assert G._digamma(np.array([x]))[0] == pytest.approx(slope, rel=1e-4)


def test_all_columns_in_one_loop_and_components_not_needed_go(spark):
    rng = np.random.default_rng(1)
    two = np.where(rng.random(6000) < 0.3, rng.normal(-50, 2, 6000), rng.normal(100, 5, 6000))
    rows = [(float(a), float(b), 7.0, None) for a, b in zip(two, rng.normal(3, 1, 6000))]
    df = spark.createDataFrame(rows, "two double, one double, same double, none double")
    got = G.fit_mixtures(df, ["two", "one", "same", "none"])
    low, high = ([i for i, m in enumerate(got["two"].means) if (m < 25) == side] for side in (True, False))
    share = lambda at: sum(got["two"].weights[i] for i in at)
    assert share(low) == pytest.approx(0.3, abs=0.03) and share(high) == pytest.approx(0.7, abs=0.03)
    heavy = max(range(got["two"].size), key=lambda i: got["two"].weights[i])
    assert got["two"].means[heavy] == pytest.approx(100, abs=3)
    assert got["same"].means == (7.0,) and got["none"].size == 0
    assert got["two"].size < 10 and 1 <= got["one"].size <= 10
    alone = G.fit_mixture(df, "one")
    assert alone.means == pytest.approx(got["one"].means)


def test_counts_weigh_like_rows(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=500), 1)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    counts = G.value_counts(df, ["x"])
    poly = np.stack([[0.0, -1.0], [0.5, -0.5], [-1.0, -0.3]])
    sums, fit = G.component_sums(counts, [(0.0, 1.0)], [poly])[0]
    logs = poly[0] + x[:, None] * (poly[1] + x[:, None] * poly[2])
    share = np.exp(logs) / np.exp(logs).sum(1, keepdims=True)
    assert np.allclose(sums, np.stack([share.sum(0), x @ share, (x * x) @ share]))
    assert fit == pytest.approx(np.log(np.exp(logs).sum(1)).sum())


def test_no_rows_and_nan(spark):
    empty = spark.createDataFrame([], "x double, y double")
    assert {c: m.size for c, m in G.fit_mixtures(empty, ["x", "y"]).items()} == {"x": 0, "y": 0}
    df = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,), (None,)] * 20, "x double")
    m = G.fit_mixture(df, "x", 3)
    assert m.size >= 1 and all(math.isfinite(v) for v in m.means + m.stds)
