"""Rows for draws by their place in the sorted table."""

from collections import Counter

from pyspark.sql import functions as F

from tracekit.operators import sampling as R
from tracekit.session import cut


def test_draws_ask_for_places_and_rows_move_without_a_window(spark):
    rows = [(f"k{i:03}", "a" if i % 3 else None, i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, x string, y int").repartition(3)
    categories = cut(R.category_table(df, ["x", "y"]), "categories")
    draws = cut(R.conditional_draws(spark, categories, 400, 1), "draws")
    got = R.rows_for_draws(df, ["x", "y"], draws, categories, "key", 2)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    held = {}
    for k, x, y in rows:
        held.setdefault(("x", x), []).append(k)
        held.setdefault(("y", str(y)), []).append(k)
    sizes = {(r.column, r.value): r.n for r in categories.collect()}
    wanted = draws.withColumn("u", R.fraction("2-row", "draw")).collect()
    expected = {(d.draw, d.column, d.value, sorted(held[d.column, d.value])[int(d.u * sizes[d.column, d.value])]) for d in wanted}
    assert {tuple(r) for r in got.select("draw", "column", "value", "key").collect()} == expected and len(expected) == 400


def test_a_draw_beyond_the_rows_held_gets_none(spark):
    df = spark.createDataFrame([(f"k{i}", "a" if i < 2 else "b") for i in range(40)], "key string, x string")
    categories = R.category_table(df, ["x"])
    more = categories.withColumn("n", F.when(F.col("value") == "a", 1000).otherwise(F.col("n")))
    draws = spark.range(200).select(F.col("id").alias("draw"), F.lit(0).alias("column_id"), F.lit("x").alias("column"), F.lit(0).cast("bigint").alias("category_id"), F.lit("a").alias("value"))
    got = Counter(r.key for r in R.rows_for_draws(df, ["x"], draws, more, "key", 3).collect())
    assert set(got) <= {"k0", "k1"} and sum(got.values()) < 200
