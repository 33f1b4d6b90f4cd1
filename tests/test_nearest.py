"""Nearest neighbours against brute force, with duplicates, groups and many blocks."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracekit.operators import nearest as N


def frame(spark, mat, start=0, group=None):
    rows = [(start + i, [float(x) for x in r]) + ((group[i],) if group is not None else ()) for i, r in enumerate(mat)]
    return spark.createDataFrame(rows, "id bigint, vec array<double>" + (", g string" if group is not None else ""))


def brute(a, b, k, metric, exclude_self=False, ga=None, gb=None):
    diff = a[:, None, :] - b[None, :, :]
    d = np.abs(diff).sum(-1) if metric == "l1" else np.sqrt((diff**2).sum(-1))
    if exclude_self:
        d[np.eye(len(a), dtype=bool)] = np.inf
    if ga is not None:
        d[np.asarray(ga)[:, None] != np.asarray(gb)[None, :]] = np.inf
    return np.sort(d, axis=1)[:, :k]


def collected(df, n, k):
    pdf = df.toPandas()
    out = np.full((n, k), np.inf)
    for r in pdf.itertuples():
        out[r.id % 100_000, r.rank - 1] = r.distance
    return out


@pytest.mark.parametrize("metric", ["l1", "l2"])
@pytest.mark.parametrize("supers", [256, 4])
def test_two_tables(spark, monkeypatch, metric, supers):
    monkeypatch.setattr(N, "SUPERS", supers)
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(150, 3)), rng.normal(size=(400, 3))
    b[100:240] = b[7]  # a third of the rows are one vector
    a[3] = b[7]
    got = N.nearest(frame(spark, a), frame(spark, b, 100_000), k=3, metric=metric, block_rows=16)
    np.testing.assert_allclose(collected(got, 150, 3), brute(a, b, 3, metric), atol=1e-9)


def test_one_table_without_self(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 6, size=(200, 2)).astype(float)  # many copies
    rows = frame(spark, a)
    got = N.nearest(rows, rows, k=2, exclude_self=True, block_rows=16)
    np.testing.assert_allclose(collected(got, 200, 2), brute(a, a, 2, "l2", True), atol=1e-9)


def test_groups(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(90, 4)), rng.normal(size=(120, 4))
    ga = ["x" if i % 10 else "y" for i in range(90)]
    gb = ["x" if i % 3 else "y" for i in range(120)]
    got = N.nearest(frame(spark, a, group=ga), frame(spark, b, 100_000, gb), k=2, group="g", block_rows=8)
    assert set(got.columns) == {"g", "id", "rank", "ref_id", "distance"}
    np.testing.assert_allclose(collected(got, 90, 2), brute(a, b, 2, "l2", ga=ga, gb=gb), atol=1e-9)


def test_custom_metric(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(30, 2)), rng.normal(size=(50, 2))
    chebyshev = lambda x, y: np.abs(x[:, None, :] - y[None, :, :]).max(-1)
    got = N.nearest(frame(spark, a), frame(spark, b, 100_000), metric=chebyshev, block_rows=10)
    np.testing.assert_allclose(collected(got, 30, 1), np.sort(chebyshev(a, b), 1)[:, :1], atol=1e-12)


def test_far_blocks_are_not_compared(spark):
    line = [[float(i), 0.0] for i in range(600)]
    rows = [(side, "", i // 20, i, 1, line[i], i) for side in (0, 1) for i in range(600)]
    df = spark.createDataFrame(rows, "side int, grp string, block bigint, vid bigint, n bigint, vec array<double>, id1 bigint")
    packed = df.groupBy("side", "grp", "block").applyInPandas(N._packer("l2"), N.PACKED.format("bigint"))
    assert N._prune(packed, "l2", 1).count() <= 30 * 5  # of 900 possible pairs


def test_true_distances_stop_a_query_block_early():
    rng = np.random.default_rng(8)
    points = rng.random((900, 2))
    points = points[np.lexsort((points[:, 1], np.floor(points[:, 0] * 15)))]
    blocks = [points[i : i + 60] for i in range(0, 900, 60)]
    row = lambda b, low: SimpleNamespace(vids=np.arange(60), first=np.arange(60), width=2, mat=b.tobytes(), low=low)
    met = 0
    for b in blocks:
        now = N._Running("l2", 2, row(b, -1.0))
        bounds = [float(N._gap("l2", b.min(0), b.max(0), c.min(0), c.max(0))[0]) for c in blocks]
        for low, c in sorted(zip(bounds, blocks), key=lambda x: x[0]):
            now.meet(row(c, low))
        met += now.blocks
    assert met <= 80  # of 225


def pairs_brute(a, ids, k, exclude_self):
    d = np.sqrt(((a[:, None, :] - a[None, :, :]) ** 2).sum(-1))
    out = {}
    for i, own in enumerate(ids):
        near = sorted((float(round(d[i, j], 9)), ids[j]) for j in range(len(ids)) if not (exclude_self and ids[j] == own))
        out[own] = [x for _, x in near[:k]]
    return out


@pytest.mark.parametrize("width", [2, 6])
@pytest.mark.parametrize("exclude_self", [False, True])
@pytest.mark.parametrize("text", [False, True])
def test_ids_of_duplicates_and_ties(spark, width, exclude_self, text):
    rng = np.random.default_rng(9)
    a = rng.integers(0, 3, size=(120, width)).astype(float)
    a[40:80] = a[0]
    ids = [f"n{i:03}" for i in rng.permutation(120)] if text else [int(i) for i in rng.permutation(120)]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in zip(ids, a)], f"id {'string' if text else 'bigint'}, vec array<double>")
    got = {}
    for r in N.nearest(df, df, k=3, exclude_self=exclude_self, block_rows=16).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.ref_id)
    assert got == pairs_brute(a, ids, 3, exclude_self)


def test_approximate_recall(spark):
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(40, 32)) * 4
    a = centres[rng.integers(0, 40, 800)] + rng.normal(size=(800, 32)) * 0.3
    df = frame(spark, a)
    exact = {(r.id, r.ref_id) for r in N.nearest(df, df, k=5, exclude_self=True).collect()}
    near = {(r.id, r.ref_id) for r in N.approximate(df, df, 6.0, k=5, exclude_self=True).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_wide_vectors_stay_exact(offset):
    rng = np.random.default_rng(6)
    q, b = rng.normal(size=(40, 16)) + offset, rng.normal(size=(300, 16)) + offset
    b[:5] = q[:5]
    _, d = N._closest("l2", q, b, 4)
    np.testing.assert_allclose(np.sort(d, axis=1), brute(q, b, 4, "l2"), rtol=1e-12, atol=0)


def clustered(rng, n, width, clusters, spread=4.0, noise=0.3):
    return (rng.normal(size=(clusters, width)) * spread)[rng.integers(0, clusters, n)] + rng.normal(size=(n, width)) * noise


def formed(spark, monkeypatch, mat, metric, pivots, block_rows):
    """Block pairs of a table with itself, with and without the pivot index, and all there are with it."""
    if not pivots:
        monkeypatch.setattr(N, "_pivots", lambda rows, metric: None)
    df = frame(spark, mat).select("id", "vec", *N._vector_key())
    both = df.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("side"), F.lit("").alias("grp"), "key1", "key2", "vec",
                     F.col("id").alias("id0"), F.col("id").alias("id1"), F.lit(1).alias("n"))
    placed, held = N._blocks(both, metric, block_rows)
    monkeypatch.undo()
    packed = N.cut(placed.groupBy("side", "grp", "block").applyInPandas(N._packer(metric, held), N.PACKED.format("bigint")), "blocks")
    return N._prune(packed, metric, 4, len(held) if pivots else 0).count(), packed.where("side = 0").count() ** 2


def test_pivots_form_under_a_third_of_the_pairs_that_boxes_form(spark, monkeypatch):
    mat = clustered(np.random.default_rng(21), 6000, 64, 40)
    boxes, every = formed(spark, monkeypatch, mat, "l2", False, 32)
    pivots, _ = formed(spark, monkeypatch, mat, "l2", True, 32)
    assert 3 * pivots < boxes < every


@pytest.mark.parametrize("metric", ["l1", "l2"])
@pytest.mark.parametrize("supers", [256, 3])
@pytest.mark.parametrize("self_join", [False, True])
def test_wide_clusters_with_duplicates_and_ties(spark, monkeypatch, metric, supers, self_join):
    monkeypatch.setattr(N, "SUPERS", supers)
    rng = np.random.default_rng(22)
    b = np.round(clustered(rng, 500, 12, 9, 3.0, 0.4), 1)
    b[100:260] = b[3]  # a third of the rows are one vector
    a = b if self_join else np.concatenate([np.round(clustered(rng, 110, 12, 9, 3.0, 0.4), 1), b[:40]])
    rows = frame(spark, a), frame(spark, b, 0 if self_join else 100_000)
    got = N.nearest(*rows, k=3, metric=metric, exclude_self=self_join, block_rows=16)
    np.testing.assert_allclose(collected(got, len(a), 3), brute(a, b, 3, metric, self_join), atol=1e-9)


@pytest.mark.parametrize("width", [2, 16])
def test_declared_metric_is_exact_and_pruned(spark, monkeypatch, width):
    chebyshev = lambda x, y: np.abs(x[:, None, :] - y[None, :, :]).max(-1)
    rng = np.random.default_rng(23)
    a = np.round(clustered(rng, 700, width, 25, 6.0, 0.3), 1)
    a[50:90] = a[0]
    ids = list(range(len(a)))
    df = frame(spark, a)
    got = {}
    for r in N.nearest(df, df, k=3, metric=N.Metric(chebyshev), exclude_self=True, block_rows=16).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.ref_id)
    d = chebyshev(a, a)
    for i in ids:
        assert got[i] == sorted((j for j in ids if j != i), key=lambda j: (d[i, j], j))[:3]
    pairs, every = formed(spark, monkeypatch, a, N.Metric(chebyshev), True, 16)
    assert pairs < every / 3


def test_groups_of_wide_vectors_and_few_rows(spark):
    rng = np.random.default_rng(24)
    a, b = rng.normal(size=(60, 10)), rng.normal(size=(90, 10))
    ga, gb = ["x" if i % 10 else "y" for i in range(60)], ["x" if i % 30 else "y" for i in range(90)]
    got = N.nearest(frame(spark, a, group=ga), frame(spark, b, 100_000, gb), k=5, group="g", block_rows=8)
    want = brute(a, b, 5, "l2", ga=ga, gb=gb)  # group y has three references only
    np.testing.assert_allclose(collected(got, 60, 5), want, atol=1e-9)
    assert N.nearest(frame(spark, a).limit(0), frame(spark, b), k=2).count() == 0
    assert N.nearest(frame(spark, a), frame(spark, b).limit(0), k=2).count() == 0


def test_far_apart_rows():
    rows = np.array([[0.0], [1.0], [10.0], [10.0], [4.0]])
    assert N.far_apart("l2", rows, 9).ravel().tolist() == [10.0, 0.0, 4.0, 1.0]
    assert len(N.far_apart("l2", rows[:0], 3)) == 0


def test_a_reference_block_is_sent_once_to_a_set_of_query_blocks(spark, monkeypatch):
    rng = np.random.default_rng(21)
    blocks = [("", side, b, [int(v) for v in np.arange(20) + 20 * b], [int(v) for v in np.arange(20) + 20 * b], 2, rng.random((20, 2)).tobytes())
              for side in (0, 1) for b in range(12)]
    packed = spark.createDataFrame([(s, g, b, v, f, w, bytearray(m)) for g, s, b, v, f, w, m in blocks],
                                   "side int, grp string, block bigint, vids array<bigint>, first array<bigint>, width int, mat binary")
    pairs = spark.createDataFrame([("", q, r, 0.0) for q in range(12) for r in range(12)], "grp string, qblock bigint, rblock bigint, low double")
    monkeypatch.setattr(N, "BLOCK_ROWS", 120)
    laid = N._laid(packed, pairs, 1).collect()
    sent = [r for r in laid if r.low >= 0]
    assert len(sent) == 2 * 12 and all(len(r.wanted_by) == 6 for r in sent)  # of 144 pairs
    assert {(q, r.qset) for r in sent for q in r.wanted_by} == {(r.qblock, r.qset) for r in laid if r.low < 0}


@pytest.mark.parametrize("metric", ["l1", "l2"])
@pytest.mark.parametrize("kind", ["plain", "far", "clusters", "even", "huge", "nan"])
def test_bounds_by_a_product_change_no_bit(metric, kind, monkeypatch):
    rng = np.random.default_rng(11)
    q, b = rng.normal(size=(150, 20)), rng.normal(size=(260, 20))
    if kind == "far":
        q, b = q * 1e-3 + 1e4, b * 1e-3 + 1e4
    if kind == "clusters":
        q, b = (np.round(rng.normal(size=(n, 20)) * 1e-4 + rng.integers(0, 2, (n, 1)) * 50.0, 4) for n in (150, 260))
    if kind == "even":
        q[:, 3:], b[:, 3:] = 7.0, 7.0
    if kind == "huge":
        q, b = q * 1e20, b * 1e20
    if kind == "nan":
        b[5, 2] = np.nan
    exact = N._distances(metric, q, b)
    for limit in (np.quantile(np.nan_to_num(exact), 0.02, axis=1), np.nan_to_num(exact).min(axis=1), exact.max(axis=1)):
        for loose in (0.0, 0.2, 1.0):
            monkeypatch.setattr(N, "LOOSE", loose)
            rows, cols, dist = N._within(metric, q, b, limit)
            got = {(r, c): d for r, c, d in zip(rows.tolist(), cols.tolist(), dist.tolist())}
            assert len(got) == len(rows)
            if kind != "nan" or metric == "l1":
                assert got == {(r, c): exact[r, c] for r, c in zip(*(x.tolist() for x in np.nonzero(exact <= limit[:, None])))}
    if kind != "nan":
        cols, dist = N._closest(metric, q, b, 4)
        assert cols.tolist() == np.argsort(exact, axis=1, kind="stable")[:, :4].tolist()
        assert dist.tolist() == np.take_along_axis(exact, cols, axis=1).tolist()


def test_waves_stay_below_the_difference():
    u = np.linspace(0, N.WAVE_LEVEL + sum(abs(a) for a, _ in N.WAVES), 300_001)
    below = N.WAVE_LEVEL - sum(a * np.cos(w * u) for a, w in N.WAVES)
    slope = 1 + sum(abs(a) * w for a, w in N.WAVES)
    assert (below - u).max() < -slope * u[1] / 2  # holds between the points as well; behind the last one the sum is too small


def test_most_pairs_of_wide_vectors_are_ruled_out_by_products(monkeypatch):
    rng = np.random.default_rng(12)
    q, b = rng.normal(size=(300, 64)), rng.normal(size=(2048, 64))
    limit = np.sort(N._distances("l1", q, b), axis=1)[:, 1]
    summed = []
    monkeypatch.setattr(N, "_estimates", lambda *_: pytest.fail("distances of all pairs were summed"))
    real = N._sifted
    monkeypatch.setattr(N, "_sifted", lambda *a: lambda rows, cols: summed.append(len(rows)) or real(*a)(rows, cols))
    assert len(N._within("l1", q, b, limit)[0]) == 600
    assert 0 < sum(summed) < 0.1 * 300 * 2048
