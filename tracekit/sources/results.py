"""Result documents and the tables made of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MISSING = "--"
NESTED = "map<string, map<string, map<string, double>>>"


def explode_documents(docs: DataFrame, keys: Sequence[str], text: str = "value") -> DataFrame:
    """``source -> split -> metric-stat`` documents to (keys, source, split, metric, stat, value)."""
    parsed = docs.select(*keys, F.from_json(F.col(text), NESTED).alias("d"))
    by_source = parsed.select(*keys, F.explode("d").alias("source", "s"))
    by_split = by_source.select(*keys, "source", F.explode("s").alias("split", "m"))
    rows = by_split.select(*keys, "source", "split", F.explode("m").alias("name", "value"))
    return rows.select(
        *keys, "source", "split",
        F.regexp_extract("name", "^(.*)-([^-]+)$", 1).alias("metric"),
        F.regexp_extract("name", "^(.*)-([^-]+)$", 2).alias("stat"), "value")


def read_eval_tree(spark: SparkSession, pattern: str) -> DataFrame:
    """All documents ``<dataset>/<experiment>/<file>.json`` under a glob."""
    docs = spark.read.text(pattern, wholetext=True).select("value", F.split(F.input_file_name(), "/").alias("p"))
    docs = docs.select("value", F.element_at("p", -3).alias("dataset"), F.element_at("p", -2).alias("experiment"))
    return explode_documents(docs, ["dataset", "experiment"])


def result_table(
    scores: DataFrame, methods: Mapping[str, tuple[str, str]], datasets: Sequence[str], regression: Sequence[str]
) -> DataFrame:
    """One row per method, one column per dataset: mean test r2 (regression) or f1 with four decimals, ``--`` if absent.

    ``methods`` maps a row name to (experiment, source).
    """
    spark = scores.sparkSession
    wanted = spark.createDataFrame([(m, e, s) for m, (e, s) in methods.items()], "method string, experiment string, source string")
    metric = F.when(F.col("dataset").isin(*regression), "r2").otherwise("f1") if regression else F.lit("f1")
    picked = scores.where((F.col("split") == "test") & (F.col("stat") == "mean") & (F.col("metric") == metric))
    rows = wanted.join(picked, ["experiment", "source"], "left")
    wide = rows.groupBy("method").pivot("dataset", list(datasets)).agg(F.first(F.format_string("%.4f", "value")))
    return wide.select("method", *[F.coalesce(F.col(f"`{d}`"), F.lit(MISSING)).alias(d) for d in datasets])
