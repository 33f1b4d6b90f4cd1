"""Approximate nearest neighbours: a forest of random-projection trees and one priority queue per query.

Trees split a bounded sample at medians of random projections; every row is then put into one leaf of each tree.
A query pops tree nodes of the whole forest from one queue, by the margin to the nearest split passed on the wrong
side, until it has a share of all leaves; the rows of those leaves are ranked by their exact inner products. Leaves
and the queries that want them meet in blocks of bounded size; nothing but the trees is broadcast.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracekit.session import cut

#: Trees, most levels, and the sample (distinct vectors) that the splits are fitted on.
TREES, LEVELS, SAMPLE = 4, 8, 16_384
#: Sampled vectors per leaf, below which a tree gets fewer levels.
LEAF_SAMPLE = 48
#: Share of all leaves that a query looks at: vectors without any structure need this much for a recall of 0.98.
SHARE = 0.4
#: Rows of an index block and queries held against it at once; running results that a task keeps before it passes them on.
INDEX_BLOCK, QUERY_BLOCK, RUNNING = 4096, 1024, 1 << 16
SEED = 5


@dataclass
class Forest:
    """Per tree the normals and thresholds of its nodes, heap order; ``levels`` splits from root to leaf."""

    levels: int
    normals: np.ndarray
    thresholds: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, trees: int = TREES, seed: int = SEED) -> Forest:
        levels = int(np.clip(np.log2(max(1, len(x) // LEAF_SAMPLE)), 0, LEVELS))
        rng, n = np.random.default_rng(seed), (1 << levels) - 1
        dim = x.shape[1] if x.ndim == 2 else 0
        normals, thresholds = rng.normal(size=(trees, n, dim)), np.zeros((trees, n))
        normals /= np.maximum(np.linalg.norm(normals, axis=2, keepdims=True), 1e-12)
        for t in range(trees):
            node = np.zeros(len(x), dtype=np.int64)
            for level in range(levels):
                p = np.einsum("ij,ij->i", x, normals[t][node])
                for k in range((1 << level) - 1, (1 << level + 1) - 1):
                    mine = p[node == k]
                    thresholds[t, k] = np.median(mine) if len(mine) else 0.0
                node = 2 * node + 1 + (p > thresholds[t][node])
        return cls(levels, normals, thresholds)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row in every tree."""
        out = np.zeros((len(x), len(self.normals)), dtype=np.int64)
        for t, (v, h) in enumerate(zip(self.normals, self.thresholds)):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.levels):
                node = 2 * node + 1 + (np.einsum("ij,ij->i", x, v[node]) > h[node])
            out[:, t] = node - ((1 << self.levels) - 1)
        return out

    def search(self, x: np.ndarray, share: float = SHARE) -> Iterator[list[tuple[int, int]]]:
        """For each query the (tree, leaf) pairs it looks at, best first."""
        inner = (1 << self.levels) - 1
        wanted = max(1, int(np.ceil(share * len(self.normals) * (inner + 1))))
        margins = np.einsum("ij,tkj->itk", x, self.normals) - self.thresholds
        for margin in margins.tolist():
            queue = [(-np.inf, t, 0) for t in range(len(self.normals))]
            found = []
            while queue and len(found) < wanted:
                worst, t, node = heapq.heappop(queue)
                if node >= inner:
                    found.append((t, node - inner))
                    continue
                m = margin[t][node]
                # the child on the query's side keeps the margin so far, the other one is as far as its split
                heapq.heappush(queue, (max(worst, m), t, 2 * node + 1))
                heapq.heappush(queue, (max(worst, -m), t, 2 * node + 2))
            yield found


def usable_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key, v (doubles) of the rows that take part: no null, zero, non-finite or partly null vectors, one length.

    Where lengths differ the most frequent one counts (the smaller of equally frequent ones). Rows equal in key and
    vector count once, rows without a key not at all.
    """
    v = F.col(vector).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # adding zero turns -0.0 into 0.0
    clean = rows.select(F.col(key).cast("long").alias("key"), F.transform(v, lambda x: x + F.lit(0.0)).alias("v"))
    clean = clean.where(F.col("key").isNotNull() & F.col("v").isNotNull() & ~bad).where(F.exists("v", lambda x: x != 0))
    sizes = clean.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return clean.where(F.size("v") == (sizes.n if sizes else 0))


def _distinct(rows: DataFrame, k: int) -> DataFrame:
    """One row per vector: name, v and its ``k`` smallest keys; Spark cuts each task's rows per vector before the shuffle."""
    named = rows.withColumn("name", F.md5(F.to_json(F.struct("v"))))
    ranked = named.withColumn("n", F.dense_rank().over(Window.partitionBy("name").orderBy("key"))).where(F.col("n") <= k)
    return ranked.groupBy("name").agg(F.first("v").alias("v"), F.sort_array(F.collect_set("key")).alias("keys"))


def _matrix(v: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=np.float64) for x in v]) if len(v) else np.zeros((0, 0))


class _Best:
    """Running best candidates per query, at most ``k`` distinct ones each."""

    def __init__(self, k: int):
        self.k, self.at, self.scores, self.names, self.keys = k, {}, [], [], []

    def add(self, queries: list[str], scores: np.ndarray, names: np.ndarray, keys: np.ndarray) -> None:
        for q, s, n, f in zip(queries, scores, names, keys):
            i = self.at.get(q)
            if i is None:
                self.at[q] = len(self.scores)
                self.scores.append(s)
                self.names.append(n)
                self.keys.append(f)
                continue
            s, n, f = (np.concatenate(x) for x in ((self.scores[i], s), (self.names[i], n), (self.keys[i], f)))
            _, one = np.unique(n, return_index=True)
            one = one[np.lexsort((f[one], -s[one]))[: self.k]]
            self.scores[i], self.names[i], self.keys[i] = s[one], n[one], f[one]

    def frame(self) -> pd.DataFrame:
        lengths = [len(s) for s in self.scores]
        if not lengths:
            return pd.DataFrame({"query": [], "name": [], "least": [], "score": []})
        # plain lists: arrays of objects that numpy repeats and joins may reach Arrow in chunks
        queries = [q for q, n in zip(self.at, lengths) for _ in range(n)]
        return pd.DataFrame({"query": queries, "name": [x for n in self.names for x in n],
                             "least": np.concatenate(self.keys).astype(np.int64), "score": np.concatenate(self.scores).astype(np.float64)})


def _meet(k: int):
    """Streams rows sorted by block, index rows before queries, through matrix products."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, block, index, names, keys, waiting = _Best(k), None, [], [], [], []
        x = None

        def rank() -> None:
            nonlocal x
            if waiting and index:
                x = _matrix(index) if x is None else x
                q = _matrix([w[1] for w in waiting])
                rough = q @ x.T
                m = min(k, rough.shape[1])
                top = np.argpartition(-rough, m - 1, axis=1)[:, :m]
                # summed the same way in every block, so a pair has one score wherever it was met
                exact = np.stack([(x[t] * row).sum(axis=1) for row, t in zip(q, top)])
                best.add([w[0] for w in waiting], exact, np.array(names, dtype=object)[top], np.array(keys, dtype=np.int64)[top])
            waiting.clear()

        for batch in batches:
            for tree, leaf, c, q, is_query, name, least, v in zip(*(batch[n] for n in ("tree", "leaf", "c", "q", "is_query", "name", "least", "v"))):
                if (tree, leaf, c, q) != block:
                    rank()
                    block, index, names, keys, x = (tree, leaf, c, q), [], [], [], None
                    if len(best.at) >= RUNNING:
                        yield best.frame()
                        best = _Best(k)
                if is_query:
                    waiting.append((name, v))
                    if len(waiting) >= QUERY_BLOCK:
                        rank()
                else:
                    index.append(v)
                    names.append(name)
                    keys.append(least)
        rank()
        if best.at:
            yield best.frame()

    return run


def neighbours(rows: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", share: float = SHARE) -> DataFrame:
    """query_id, rank (from 1), ``key`` and score: the ``k`` found rows of largest inner product per query.

    ``queries`` are rows of the same form; a row is never its own neighbour. Equal vectors are indexed once with their
    k + 1 smallest keys, which is all that any answer can hold, so a vector that a third of the rows have is one row
    here. Ties go to the smaller key. Tables that fit a leaf are searched whole; no usable rows give no result.
    """
    usable = usable_vectors(rows, key, vector)
    index = cut(_distinct(usable, k + 1), "vectors")
    wanted = usable_vectors(queries, key, vector).withColumn("name", F.md5(F.to_json(F.struct("v")))).select("key", "name", "v").dropDuplicates(["key", "name"])
    wanted = cut(wanted, "queries")
    sample = index.orderBy(F.xxhash64("name"), "name").limit(SAMPLE).select("v").toPandas()["v"]
    forest = rows.sparkSession.sparkContext.broadcast(Forest.fit(_matrix(sample)))  # its size follows from the constants
    count, asked = index.count(), wanted.select("name").distinct().count()
    leaves = 1 << forest.value.levels
    blocks, groups = -(-count // (leaves * INDEX_BLOCK)) or 1, -(-asked // (16 * QUERY_BLOCK)) or 1

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                at = forest.value.leaves(_matrix(batch["v"]))
                yield pd.DataFrame({"name": np.repeat(batch["name"].to_numpy(), at.shape[1]), "least": np.repeat(batch["least"].to_numpy(), at.shape[1]), "v": [v for v in batch["v"] for _ in range(at.shape[1])],
                                    "tree": np.tile(np.arange(at.shape[1]), len(at)), "leaf": at.ravel()})

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.iloc[low : low + 256]
                found = list(forest.value.search(_matrix(part["v"]), share))
                sizes = [len(f) for f in found]
                pairs = np.array([p for f in found for p in f])
                yield pd.DataFrame({"name": np.repeat(part["name"].to_numpy(), sizes), "least": 0, "v": [v for v, n in zip(part["v"], sizes) for _ in range(n)],
                                    "tree": pairs[:, 0], "leaf": pairs[:, 1]})

    schema = "name string, least long, v array<double>, tree int, leaf int"
    draw = F.xxhash64("name")
    put = index.select("name", F.col("keys")[0].alias("least"), "v").mapInPandas(place, schema).withColumn("c", F.pmod(draw, F.lit(blocks)).cast("int"))
    put = put.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("is_query", F.lit(False))
    put_asked = wanted.select("name", "v").dropDuplicates(["name"]).repartition("name").mapInPandas(ask, schema).withColumn("q", F.pmod(draw, F.lit(groups)).cast("int"))
    put_asked = put_asked.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("is_query", F.lit(True))
    columns = ["tree", "leaf", "c", "q", "is_query", "name", "least", "v"]
    met = put.select(columns).union(put_asked.select(columns)).repartition("tree", "leaf", "c", "q").sortWithinPartitions("tree", "leaf", "c", "q", "is_query")
    # one more than k, and some to spare for sums that differ in their last digit
    found = met.mapInPandas(_meet(k + 4), "query string, name string, least long, score double")
    # every task has its own best; a query's k + 1 best vectors are picked by their smallest keys before these are looked up.
    # A vector met in several trees has one score, so its repeats share a rank
    ordered = Window.partitionBy("query").orderBy(F.desc("score"), "least", "name")
    few = found.withColumn("n", F.dense_rank().over(ordered)).where(F.col("n") <= k + 1).dropDuplicates(["query", "name"])
    near = few.join(index.select("name", "keys"), "name")
    near = near.select(F.col("query").alias("name"), "score", F.explode("keys").alias("found"))
    answers = wanted.select(F.col("key").alias("query_id"), "name").join(near, "name").where("found <> query_id").dropDuplicates(["query_id", "found"])
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "found")
    ranked = answers.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("found").alias(key), "score")
