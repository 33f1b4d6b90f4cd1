"""Distinct counts without row copies, and quantiles from sketches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracekit.operators import clean
from tracekit.operators.ordered import quantiles, sketch_quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(11)
    rows = [("hot" if i % 3 else f"k{i % 5}", float(x)) for i, x in enumerate(rng.exponential(size=20_000))]
    return spark.createDataFrame(rows + [("hot", None), ("none", None)], "key string, v double").repartition(6).cache()


def test_ranks_of_sketched_quantiles(skewed):
    qs = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    values = {}
    for key, v in skewed.where("v is not null").collect():
        values.setdefault(key, []).append(v)
        values.setdefault(None, []).append(v)
    got = [(r.key, r.q, r.v) for r in sketch_quantiles(skewed, "v", qs, ["key"]).collect()] + [(None, r.q, r.v) for r in quantiles(skewed, "v", qs, approx=True).collect()]
    assert len(got) == len(qs) * 7
    for key, q, v in got:
        data = np.sort(values[key])
        assert v in data  # a value of the table
        low, high = np.searchsorted(data, v, "left") / len(data), np.searchsorted(data, v, "right") / len(data)
        assert low - 0.005 <= q <= high + 0.005


def test_sketches_of_nothing(skewed):
    none = skewed.where("v is null")
    assert sketch_quantiles(none, "v", [0.5]).count() == 0 and sketch_quantiles(none, "v", [0.5], ["key"]).count() == 0


def test_distinct_counts_have_no_expand(spark):
    rows = [(i % 7, i, float(i % 40), None if i % 2 else i % 3, None) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b bigint, c double, d smallint, e double")
    df = df.withColumn("f", (F.col("b") / 4).cast("decimal(12,2)")).withColumn("t", F.lit("x"))
    report = clean.discrete_numeric_report(df)
    assert "Expand" not in report._jdf.queryExecution().executedPlan().toString()
    got = {r.column: (r.n_distinct, r.whole) for r in report.collect()}
    assert got == {"a": (7, 1), "b": (500, 1), "c": (40, 1), "d": (3, 1), "e": (0, None), "f": (500, 0)}
    assert clean.discrete_numeric_columns(df) == ["a", "d"]
    assert clean.discrete_numeric_columns(df, 40) == ["a", "c", "d"]
    assert clean.discrete_numeric_columns(df.limit(0)) == [] and clean.discrete_numeric_columns(df.select("t")) == []
