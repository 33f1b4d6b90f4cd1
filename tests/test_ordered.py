"""Ordered primitives over several sorted buckets, against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracekit.operators.ordered import (
    arrange, carry_forward, exact_quantiles, exact_top, ordered_position, prefix_sum, running,
)


@pytest.fixture(scope="module")
def hot(spark):
    """A table where one key holds two thirds of the rows."""
    rng = np.random.default_rng(0)
    n = 900
    key = np.where(rng.random(n) < 0.66, "hot", rng.choice(["a", "b", "c"], n))
    value = np.where(rng.random(n) < 0.6, np.nan, rng.integers(0, 50, n).astype(float))
    pdf = pd.DataFrame({"id": rng.permutation(n), "key": key, "v": value})
    rows = [(int(i), k, None if np.isnan(v) else float(v)) for i, k, v in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, "id bigint, key string, v double"), pdf


@pytest.mark.parametrize("buckets", [1, 7])
def test_running_columns_match_pandas(hot, buckets):
    df, pdf = hot
    out = running(
        arrange(df, ["id"], ["key"], buckets), ["key"], position="pos", sums={"total": "v"}, fills={"filled": "v"},
        lags={"prev": "id"}, firsts={"first": "id"},
    ).toPandas().set_index("id").sort_index()
    want = pdf.sort_values(["key", "id"])
    g = want.groupby("key")
    want = want.assign(pos=g.cumcount(), total=g["v"].transform(lambda s: s.fillna(0).cumsum()), filled=g["v"].ffill(),
                       prev=g["id"].shift(), first=g["id"].transform("min")).set_index("id").sort_index()
    for c in ("pos", "total", "filled", "prev", "first"):
        np.testing.assert_allclose(out[c].astype(float), want[c].astype(float), err_msg=c)


@pytest.mark.parametrize("buckets", [1, 5])
def test_global_forms(hot, buckets):
    df, pdf = hot
    pos = ordered_position(df, ["id"], buckets=buckets).toPandas()
    assert (pos["pos"] == pos["id"]).all()
    filled = carry_forward(df, ["id"], ["v"], buckets=buckets).toPandas().sort_values("id")
    np.testing.assert_allclose(filled["v"], pdf.sort_values("id")["v"].ffill())
    sums = prefix_sum(df, ["id"], "id", buckets=buckets).toPandas()
    assert (sums["running"] == sums["id"] * (sums["id"] + 1) // 2).all()


def test_position_after_a_filter(hot):
    df, _ = hot
    kept = arrange(df, ["id"], buckets=6).where("id % 3 = 0")
    out = running(kept, (), position="pos", filtered=True).toPandas()
    assert (out["pos"] == out["id"] // 3).all()


def test_quantiles_match_numpy(hot):
    df, pdf = hot
    qs = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = exact_quantiles(df, "v", qs, ["key"]).toPandas()
    for r in got.itertuples():
        want = np.nanquantile(pdf[pdf["key"] == r.key]["v"], r.q)
        assert r.v == pytest.approx(want)


def test_exact_top_beyond_the_heap(spark):
    big = spark.range(30_000)
    assert exact_top(big, 12_000, [F.desc("id")]).agg(F.min("id")).first()[0] == 18_000


def test_order_is_required(hot):
    with pytest.raises(ValueError):
        arrange(hot[0], [])


def test_marks_of_another_order_are_an_error(spark):
    from pyspark.sql import functions as F

    from tracekit.operators.ordered import arrange, running, same_order

    df = spark.createDataFrame([(i % 7, i) for i in range(40)], "k int, t int")
    placed = arrange(df, ["t"])
    with pytest.raises(ValueError, match="sorted by"):
        arrange(placed, [F.desc("t")])
    with pytest.raises(ValueError, match="sorted by"):
        running(arrange(placed, ["t"], ["k"]), ["k"], position="p")
    tens = same_order(placed.withColumn("ten", F.floor(F.col("t") / 10)), ["t"], ["ten"])
    rows = running(arrange(tens, ["t"], ["ten"]), ["ten"], position="p").collect()
    assert all(r.p == r.t % 10 for r in rows)


def test_one_exchange_serves_several_passes(spark):
    from pyspark.sql import functions as F

    from tracekit.operators.sessions import sessionize_count

    df = spark.range(2000).select((F.col("id") % 5).alias("k"), F.col("id").alias("t"))
    plan = sessionize_count(df, ["k"], ["t"], 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Exchange hashpartitioning" not in plan  # by bucket number, in one task if there is one bucket
