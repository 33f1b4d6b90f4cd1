"""Bounds of the metrics, refill invariants and learners on a separable table."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracekit.operators import fidelity as M
from tracekit.operators import privacy as V
from tracekit.operators import sampling as R
from tracekit.operators import utility as U


@pytest.fixture(scope="module")
def pair(spark):
    rng = np.random.default_rng(0)
    make = lambda shift, n: spark.createDataFrame(
        [(float(x), "abc"[i % 3] if shift == 0 else "bcd"[i % 3]) for i, x in enumerate(rng.normal(shift, 1, n))], "x double, s string")
    return make(0, 300), make(1, 200)


def one(df):
    return df.first()["value"]


def test_divergence_bounds(pair):
    a, b = pair
    assert one(M.js_discrete(a, a, ["s"])) == pytest.approx(0, abs=1e-12)
    assert 0 < one(M.js_discrete(a, b, ["s"])) < math.log(2)
    assert 0 < one(M.js_distance_base2(a, b, ["s"])) < 1
    assert 0 < one(M.js_continuous(a, b, ["x"])) <= math.log(2)


def test_earth_mover_is_symmetric(pair):
    a, b = pair
    ab, ba = one(M.earth_mover(a, b, ["x"])), one(M.earth_mover(b, a, ["x"]))
    assert ab == pytest.approx(ba) and ab == pytest.approx(1, abs=0.3)
    assert one(M.earth_mover(a, a, ["x"])) == pytest.approx(0, abs=1e-12)


def test_bins_follow_numpy(pair):
    a, _ = pair
    xs = np.array([r.x for r in a.collect()])
    counts, edges = np.histogram(xs, bins="auto")
    lo, hi, k = M.auto_bins(a, ["x"])["x"]
    assert k == len(counts) and (lo, hi) == (edges[0], edges[-1])
    got = {r["b"]: r["n"] for r in a.groupBy(M.histogram_bin(F.col("x"), lo, hi, k).alias("b")).agg(F.count("*").alias("n")).collect()}
    assert [got.get(i, 0) for i in range(k)] == list(counts)


def test_average_ranks_of_ties(spark):
    rows = [("m", "a", 1.0), ("m", "b", 1.0), ("m", "c", 2.0), ("n", "a", 3.0), ("n", "b", 1.0), ("n", "c", 2.0)]
    df = spark.createDataFrame(rows, "metric string, candidate string, value double")
    best = M.choose_best(df).first()
    assert (best.candidate, best.rank_sum) == ("b", 2.5)


def test_refill_keeps_only_far_rows(spark):
    rng = np.random.default_rng(1)
    real = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(60, 2)))], "id bigint, vec array<double>")

    def generator(seed, n):
        pts = np.random.default_rng(seed + 5).normal(size=(n, 2))
        return spark.createDataFrame([(seed * 1000 + i, [float(v) for v in r]) for i, r in enumerate(pts)], "id bigint, vec array<double>")

    dist = lambda r, s: V.distance_to_closest(r, s, "l2")
    kept, report = R.privacy_refill(real, generator, dist, 0.3, 40, "id")
    assert report["missing"] == 40 - kept.count()
    rows = {r.id: np.array(r.vec) for r in kept.collect()}
    assert len(rows) == 40
    ref = np.array([r.vec for r in real.collect()])
    near = lambda p: np.sqrt(((ref - p) ** 2).sum(1)).min()
    limit = np.quantile([near(np.array(r.vec)) for r in generator(0, 40).collect()], 0.3)
    assert min(near(p) for p in rows.values()) >= limit - 1e-9


def test_learners_on_a_separable_table(spark):
    rows = [(i, [float(i % 2) * 4 + (i % 7) / 10, float(i % 5)], i % 2) for i in range(200)]
    df = U.as_training(spark.createDataFrame(rows, "key int, features array<double>, y int"), "y")
    train, test = df.where("key < 150"), df.where("key >= 150")
    out = U.train_on_both(U.learners(2, 2)["tree"], train, train, test, "key")
    assert out.where("actual <> from_real or actual <> from_synthetic").count() == 0 and out.count() == 50
    scores = U.evaluate(U.boosted("binclass", rounds=3).fit(train).transform(test), 2)
    assert scores == {"acc": 1.0, "f1": 1.0, "roc_auc": 1.0}
    told = U.discriminate(U.learners(2, 2)["tree"], df.where("y = 1").drop("label"), df.where("y = 0").drop("label"), "key", 0)
    assert told.where("label <> prediction").count() == 0
