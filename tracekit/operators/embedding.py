"""Word embeddings of co-occurring column values, and reduced feature vectors."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracekit.operators.nearest import nearest
from tracekit.operators.ordered import arrange, running


def fit_embedding(df: DataFrame, cols: Sequence[str], size: int, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """(word, vector) with unit length; each row is one sentence of its column values."""
    sentences = df.select(F.array(*[F.col(c).cast("string") for c in cols]).alias("words"))
    n = partitions or df.sparkSession.sparkContext.defaultParallelism
    model = Word2Vec(vectorSize=size, windowSize=5, minCount=1, seed=seed, numPartitions=n,
                     inputCol="words", outputCol="v").fit(sentences)
    vectors = model.getVectors().select("word", vector_to_array("vector").alias("vector"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    return vectors.withColumn("_n", norm).select(
        "word", F.transform("vector", lambda x: x / F.greatest(F.col("_n"), F.lit(1e-12))).alias("vector"))


def embed(df: DataFrame, c: str, vectors: DataFrame, name: str) -> DataFrame:
    table = vectors.select(F.col("word").alias("_w"), F.col("vector").alias(name))
    return df.join(table, F.col(c).cast("string") == F.col("_w"), "left").drop("_w")


def unit(c: str):
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(F.col(c), lambda x: x / F.col("_norm")), norm


def nearest_word(df: DataFrame, row_id: str, vec: str, vectors: DataFrame) -> DataFrame:
    """(row_id, word): the closest embedded value by angle.

    On unit vectors the order of angles is the order of Euclidean distances, so
    the blocked nearest-neighbour join serves any vocabulary size.
    """
    scaled, norm = unit("vec")
    both = []
    for d, i, v in ((df, row_id, vec), (vectors, "word", "vector")):
        rows = d.select(F.col(i).alias("id"), F.col(v).alias("vec")).withColumn("_norm", norm)
        both.append(rows.select("id", scaled.alias("vec")))
    found = nearest(both[0], both[1], k=1, metric="l2")
    return found.select(F.col("id").alias(row_id), F.col("ref_id").alias("word"))


def nearest_number(df: DataFrame, value: str, known: DataFrame, known_value: str, row_id: str) -> DataFrame:
    """(row_id, value, nearest): the closest known number; the smaller one wins a tie.

    Both sides are sorted together; the neighbour below is the last known number
    so far, the one above is the same on the reversed order.
    """
    rows = df.select(F.col(row_id).alias("_id"), F.col(value).cast("double").alias("_v"), F.lit(1).alias("_ask"))
    marks = known.select(F.col(known_value).cast("double").alias("_v")).where("_v is not null").distinct()
    both = rows.where("_v is not null").unionByName(
        marks.select(F.lit(None).cast(rows.schema["_id"].dataType).alias("_id"), "_v", F.lit(0).alias("_ask")))
    mark = F.when(F.col("_ask") == 0, F.col("_v"))
    below = running(arrange(both, ["_v", "_ask", "_id"]), (), fills={"_lo": mark}).drop("_at", "_bucket")
    above = running(arrange(below, [F.desc("_v"), "_ask", "_id"]), (), fills={"_hi": mark}).where("_ask = 1")
    low_wins = F.col("_hi").isNull() | (F.col("_v") - F.col("_lo") <= F.col("_hi") - F.col("_v"))
    return above.select(
        F.col("_id").alias(row_id), F.col("_v").alias(value),
        F.when(F.col("_lo").isNotNull() & low_wins, F.col("_lo")).otherwise(F.col("_hi")).alias("nearest"))


def n_components(columns: int) -> int:
    return max(5, math.ceil(math.sqrt(columns)))


OVERSAMPLED = 10  # directions beyond those wanted
POWER_PASSES = (2, 12)  # least and most
GROWTH = 1e-3  # further passes add less than this share of the squared length kept


def _gram_times(rows: DataFrame, block: np.ndarray) -> np.ndarray:
    """A'A times a block of directions in one scan: partitions send columns x directions sums, never columns x columns."""
    shape = block.shape

    def part(batches):
        total = np.zeros(shape)
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_list())
                total += x.T @ (x @ block)
        yield pd.DataFrame({"at": range(total.size), "x": total.ravel()})

    summed = rows.mapInPandas(part, "at int, x double").groupBy("at").agg(F.sum("x").alias("x"))
    out = np.zeros(block.size)
    for r in summed.collect():  # columns x directions values
        out[r["at"]] = r["x"]
    return out.reshape(shape)


def fit_svd(df: DataFrame, vec: str, k: int | None = None, seed: int = 0) -> np.ndarray:
    """Right singular vectors [columns, k] of the uncentred feature matrix, largest first, by a randomised range finder.

    A random block of k + 10 directions goes through A'A again and again, each time followed by a small QR: two
    power passes at least, more while the squared length that the best k directions of the span keep still grows. What A'A
    does within the span is solved exactly. A pass is one scan that adds up columns x (k + 10) numbers. With as many
    directions as columns the result is exact after one. An empty table has no directions: shape (0, 0).
    """
    rows = df.select(F.col(vec).cast("array<double>").alias("v"))
    first = rows.first()
    if first is None:
        return np.zeros((0, 0))
    width = len(first[0])
    k = min(k or n_components(width), width)
    span = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, min(k + OVERSAMPLED, width))))[0]
    least, most = POWER_PASSES if span.shape[1] < width else (0, 0)
    kept = 0.0
    for done in range(most + 1):
        image = _gram_times(rows, span)
        inner = span.T @ image
        values, turned = np.linalg.eigh((inner + inner.T) / 2)
        before, kept = kept, values[-k:].sum()
        if done == most or done >= least and kept <= before * (1 + GROWTH):
            break
        span = np.linalg.qr(image)[0]
    return span @ turned[:, ::-1][:, :k]


def reduce_widths(fitted: DataFrame, others: Sequence[DataFrame], vec: str = "vec", max_col_nums: int | None = 50,
                  directions: np.ndarray | None = None) -> list[DataFrame]:
    """All tables with ``vec`` projected, if it has ``max_col_nums`` dimensions or directions are given; else as they are.

    Directions are fitted on the first table alone: max(5, root of the dimensions) of them.
    """
    tables = [fitted, *others]
    if directions is None:
        first = fitted.select(vec).first() if max_col_nums is not None else None
        if first is None or len(first[0]) < max_col_nums:
            return tables
        directions = fit_svd(fitted, vec)
    return [project(d, vec, directions, vec) for d in tables]


def project(df: DataFrame, vec: str, v: np.ndarray, name: str) -> DataFrame:
    @F.pandas_udf("array<double>")
    def apply(rows: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(rows.to_list()) @ v)) if len(rows) else pd.Series([], dtype=object)

    return df.withColumn(name, apply(F.col(vec).cast("array<double>")))
