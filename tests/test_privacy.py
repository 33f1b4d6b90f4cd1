"""Rounds of a bootstrap from one set of neighbour lists, and reduction before distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracekit.operators import embedding as W
from tracekit.operators import privacy as V
from tracekit.operators import sampling as R


def table(spark, mat):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(mat)], "id bigint, vec array<double>")


def roles_of(spark, n, rounds, shares, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, r, str(rng.choice(["original", "synthetic", "test", ""], p=shares))) for i in range(n) for r in range(rounds)]
    return spark.createDataFrame([x for x in rows if x[2]], "id bigint, round int, role string")


def by_copies(vectors, roles):
    """The same minima with a copy of the table per round in one search."""
    split = vectors.join(roles, "id")
    part = lambda role: split.where(split.role == role).select("id", "vec", split["round"].cast("string").alias("round"))
    return V.minima(part("original"), part("synthetic"), part("test"), by="round")


def rows_of(df):
    return sorted((int(r["round"]), r["kind"], round(r["distance"], 9)) for r in df.collect() if r["distance"] is not None)


@pytest.mark.parametrize("deepest", [4, 1024])
def test_rounds_from_lists_equal_a_search_per_round(spark, monkeypatch, deepest):
    monkeypatch.setattr(V, "DEEPEST", deepest)  # 4: the rest is searched for among the rows of the role
    rng = np.random.default_rng(1)
    mat = rng.integers(0, 9, size=(150, 3)).astype(float)
    mat[60:90] = mat[0]
    vectors, roles = table(spark, mat), roles_of(spark, 150, 3, [0.55, 0.2, 0.05, 0.2], 2)
    assert rows_of(V.round_minima(vectors, roles, 3, depth=2)) == rows_of(by_copies(vectors, roles))


def test_searches_do_not_grow_with_rounds(spark, monkeypatch):
    searches, search = [], V.nearest
    monkeypatch.setattr(V, "nearest", lambda *a, **k: searches.append(1) or search(*a, **k))
    vectors = table(spark, np.random.default_rng(3).normal(size=(120, 3)))
    counts = []
    for rounds in (2, 9):
        searches.clear()
        got = V.bootstrap_statistics(vectors, rounds, 0.2, 1, qt_max=0.3, qt_interval=20).collect()
        assert sorted(r["round"] for r in got) == list(range(rounds))
        counts.append(len(searches))
    assert max(counts) <= 2


@pytest.mark.parametrize("k", [5, 12, 40])
def test_directions_keep_the_energy_of_the_exact_ones(spark, k):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(400, 40)) * np.linspace(3, 0.2, 40) ** 2 @ np.linalg.qr(rng.normal(size=(40, 40)))[0] + 0.3
    v = W.fit_svd(table(spark, a).repartition(5), "vec", k)
    assert v.shape == (40, k)
    np.testing.assert_allclose(v.T @ v, np.eye(k), atol=1e-9)
    best = (np.linalg.svd(a, compute_uv=False)[:k] ** 2).sum()
    assert ((a @ v) ** 2).sum() >= 0.999 * best


def test_reduction_is_fitted_on_the_first_table_and_only_when_wide(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(80, 60)), rng.normal(size=(30, 60))
    ta, tb = table(spark, a), table(spark, b)
    v = W.fit_svd(ta, "vec")
    ra, rb = W.reduce_widths(ta, [tb])
    assert v.shape == (60, 8)
    np.testing.assert_allclose(np.array([r.vec for r in rb.orderBy("id").collect()]), b @ v, atol=1e-9)
    assert W.reduce_widths(ta, [tb], max_col_nums=61) == [ta, tb] and W.reduce_widths(ta, [tb], max_col_nums=None) == [ta, tb]
    assert W.fit_svd(ta.limit(0), "vec").shape == (0, 0)
    assert W.reduce_widths(ta.limit(0), [tb])[1].count() == 30


def test_sweep_makes_and_measures_each_batch_once(spark):
    real = spark.createDataFrame([(i, float(i)) for i in range(20)], "id long, x double")
    made, asked = [], []

    def generator(seed, n):
        made.append(seed)
        return spark.range(n).select((F.col("id") + 1000 * seed).alias("id"), (F.col("id") * (seed + 1) * 0.37).alias("x"))

    def distance(real, rows):
        asked.append(sorted(rows.columns))
        return rows.select("id", (F.col("x") % 1.0).alias("distance"))

    n, cuts = 60, (0.2, 0.3, 0.4)
    got = V.privacy_sweep(real, generator, distance, lambda rows: rows.agg(F.sum("x")).first()[0], n, "id", cuts).collect()
    assert sorted(made) == list(range(len(made)))  # before, every quantile made and measured its own
    assert len(asked) == len(made) + len(cuts)
    assert [r.q for r in got] == [0.0, *cuts]
    for r in got[1:]:
        kept = R.privacy_refill(real, generator, distance, r.q, n, "id")[0]
        assert kept.count() == n
        assert r.score == pytest.approx(kept.agg(F.sum("x")).first()[0])
        assert r.median == pytest.approx(V.median_closest(distance(real, kept)).first()[0])
