"""Near duplicates: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

A text is the weighted set of its runs of five words (lower case): weight = occurrences x inverse document
frequency. Consistent weighted sampling gives two texts the same sample with a probability equal to their
weighted Jaccard similarity; bands of samples bring candidates together, and the similarity itself decides.
Equal texts are one class, named by a digest; only classes are compared.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracekit.llm.common import free_name, mix, runs, words
from tracekit.llm.components import components
from tracekit.session import cut

#: Words in a shingle, least similarity, bands and samples per band.
SHINGLE, LEAST, BANDS, ROWS = 5, 0.8, 10, 3
#: Document frequencies are counted per hash slot: a table of fixed size whatever the corpus.
SLOTS = 1 << 20
#: How much more a shingle of a single document weighs than one in all documents. Kept small on purpose:
#: the text of a large group of near copies is common because of the copies themselves, and a steep weight would
#: make the few differing words outweigh all they share.
STRENGTH = 0.25
#: Classes per block where the rest of a bucket is compared in blocks.
BLOCK = 256
SEED = 77

_CHUNKS = 64
_DRAWS = 1 << 16
_ELEMENTS = 1 << 18


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order, and how often each occurs; a text of fewer words is one shingle."""
    _, _, w = words(text.lower().encode("utf-8", "surrogatepass"))
    if not len(w):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.unique(runs(w, min(SHINGLE, len(w))), return_counts=True)


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64)


def _column(df: DataFrame, text: str):
    return F.coalesce(F.col(text), F.lit(""))


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """Documents per hash slot, and documents in all, over the whole table.

    Each task adds up a table of ``SLOTS`` counters and sends it in packed pieces; pieces are added per
    range of slots. What reaches the driver is one table of that fixed size. Slots of shingles that share one
    hold the sum, a share of the corpus that does not change with its size.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(SLOTS, dtype=np.int64), 0
        for batch in batches:
            n += len(batch)
            for x in batch["text"]:
                total += np.bincount(np.unique(_slots(shingles(x)[0])), minlength=SLOTS) if len(x) > 1 << 20 else 0
            found = [np.unique(_slots(shingles(x)[0])) for x in batch["text"] if len(x) <= 1 << 20]
            if found:
                total += np.bincount(np.concatenate(found), minlength=SLOTS)
        if n:
            parts = [zlib.compress(p.tobytes(), 1) for p in np.split(total, _CHUNKS)]
            yield pd.DataFrame({"piece": range(_CHUNKS), "data": parts, "n": [n] + [0] * (_CHUNKS - 1)})

    def add(pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        n = 0
        for batch in pieces:
            for piece, data, k in zip(batch["piece"], batch["data"], batch["n"]):
                sums[piece] = sums.get(piece, 0) + np.frombuffer(zlib.decompress(data), dtype=np.int64)
                n += k
        if sums:
            yield pd.DataFrame({"piece": list(sums), "data": [zlib.compress(x.tobytes(), 1) for x in sums.values()], "n": [n] + [0] * (len(sums) - 1)})

    schema = "piece int, data binary, n long"
    rows = docs.select(_column(docs, text).alias("text")).mapInPandas(count, schema).repartition("piece").mapInPandas(add, schema).collect()
    total = np.zeros(SLOTS, dtype=np.int64)
    for r in rows:
        total[r.piece * (SLOTS // _CHUNKS) : (r.piece + 1) * (SLOTS // _CHUNKS)] += np.frombuffer(zlib.decompress(bytes(r.data)), dtype=np.int64)
    return total, sum(r.n for r in rows)


@dataclass
class Weights:
    """Inverse document frequency per slot, between 1 and 1 + ``STRENGTH``."""

    idf: np.ndarray

    @classmethod
    def of(cls, frequencies: np.ndarray, n: int) -> Weights:
        if n < 2:
            return cls(np.ones(SLOTS, dtype=np.float32))
        rare = np.log(n / np.clip(frequencies, 1, n)) / np.log(n)
        return cls((1 + STRENGTH * rare).astype(np.float32))

    def weighted(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        h, n = shingles(text)
        return h, n * self.idf[_slots(h)]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two weighted sets with ordered members; two empty sets are alike."""
    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return float(len(ha) == len(hb))
    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    shared = float(np.minimum(wa[i], wb[j]).sum())
    return shared / (float(wa.sum()) + float(wb.sum()) - shared)


class _Draws:
    """The random numbers of consistent weighted sampling, looked up by 16 bits of a shingle's hash per sample."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        self.r = rng.gamma(2.0, 1.0, _DRAWS).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, _DRAWS)).astype(np.float32)
        self.beta = rng.random(_DRAWS).astype(np.float32)
        self.turn = rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


_TABLES: _Draws | None = None


def band_keys(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """One 64-bit key per set and band, from the samples of improved consistent weighted sampling.

    For each sample the member with the smallest ln a = ln c - r (floor(ln w / r + beta) - beta + 1) is taken, with
    its level; equal values go to the smaller hash. Sets must not be empty.
    """
    global _TABLES
    d = _TABLES = _TABLES or _Draws()
    h, w = np.concatenate([s[0] for s in sets]), np.log(np.concatenate([s[1] for s in sets]).astype(np.float32))
    starts = np.concatenate([[0], np.cumsum([len(s[0]) for s in sets])[:-1]])
    owner = np.repeat(np.arange(len(sets)), [len(s[0]) for s in sets])
    keys = np.zeros((len(sets), BANDS), dtype=np.uint64)
    for k in range(BANDS * ROWS):
        at = ((h * d.turn[k]) >> np.uint64(48)).astype(np.int64)
        r, beta = d.r[at], d.beta[at]
        level = np.floor(w / r + beta)
        a = d.log_c[at] - r * (level - beta + np.float32(1))
        least = np.minimum.reduceat(a, starts)
        hits = np.flatnonzero(a == least[owner])
        first = hits[np.searchsorted(hits, starts)]
        sample = mix(h[first] + level[first].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), k + 1)
        keys[:, k // ROWS] = mix(keys[:, k // ROWS] ^ sample, k // ROWS)
    return keys


def _signatures(docs: DataFrame, key: str, text: str, shared) -> DataFrame:
    """key, name (digest of the text) and band keys of every row; texts without words have no keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            keys: list = [None] * len(texts)
            part: list[int] = []
            sets, size = [], 0
            for i, x in enumerate(texts):
                s = shared.value.weighted(x)
                if len(s[0]):
                    part.append(i)
                    sets.append(s)
                    size += len(s[0])
                if sets and (size >= _ELEMENTS or i + 1 == len(texts)):
                    for j, row in zip(part, band_keys(sets).view(np.int64)):
                        keys[j] = row
                    part, sets, size = [], [], 0
            if sets:
                for j, row in zip(part, band_keys(sets).view(np.int64)):
                    keys[j] = row
            names = [hashlib.md5(x.encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest() for x in texts]
            yield pd.DataFrame({"key": batch["key"], "name": names, "keys": keys})

    rows = docs.select(F.col(key).cast("long").alias("key"), _column(docs, text).alias("text"))
    return rows.mapInPandas(run, "key long, name string, keys array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, shared, least: float) -> DataFrame:
    """Those pairs a, b whose texts are at least ``least`` similar."""
    one, two = texts.toDF("a", "text_a"), texts.toDF("b", "text_b")
    joined = pairs.join(one, "a").join(two, "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            last, known, keep = None, None, []
            for b, x, y in zip(batch["b"], batch["text_a"], batch["text_b"]):
                if b != last:  # pairs of one leader come in a row
                    last, known = b, shared.value.weighted(y)
                keep.append(similarity(shared.value.weighted(x), known) >= least)
            yield batch.loc[keep, ["a", "b"]]

    return joined.select("a", "b", "text_a", "text_b").mapInPandas(run, "a string, b string")


def _rest(buckets: DataFrame, roots: DataFrame, texts: DataFrame, shared, least: float) -> DataFrame:
    """Links within buckets between classes that their leaders left in different components.

    Per bucket the largest component needs no comparison within itself; every other class ("stray") is held
    against all classes of other components, in blocks of about ``BLOCK`` classes that are dealt to tasks. A
    block pair returns one link per pair of components it joins.
    """
    rooted = buckets.join(roots, "name", "left").withColumn("root", F.coalesce("root", "name"))
    sizes = rooted.groupBy("band", "key", "root").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("band", "key").agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"))
    main = main.where("parts > 1").select("band", "key", F.col("m.root").alias("main"),
                                          F.ceil((F.col("n") - F.col("m.n")) / BLOCK).cast("int").alias("strays"), F.ceil(F.col("m.n") / BLOCK).cast("int").alias("mains"))
    rows = rooted.join(main, ["band", "key"])
    draw = F.xxhash64("name", "band")
    stray = F.col("root") != F.col("main")
    block = F.when(stray, F.pmod(draw, F.col("strays"))).otherwise(F.pmod(draw, F.col("mains"))).cast("int")
    rows = rows.withColumn("stray", stray).withColumn("block", block)
    # a stray meets all blocks of strays and all of the main component, a main class the blocks of strays
    others = F.when(F.col("stray"), F.concat(
        F.transform(F.sequence(F.lit(0), F.col("strays") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j"), F.lit(False).alias("mixed"))),
        F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda j: F.struct(F.col("block").alias("i"), j.alias("j"), F.lit(True).alias("mixed")))))
    others = others.otherwise(F.transform(F.sequence(F.lit(0), F.col("strays") - 1), lambda j: F.struct(j.alias("i"), F.col("block").alias("j"), F.lit(True).alias("mixed"))))
    dealt = rows.join(texts, "name").select("band", "key", "name", "root", "stray", "text", F.explode(others).alias("to"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        sets = [shared.value.weighted(x) for x in group["text"]]
        names, roots_, stray_ = group["name"].tolist(), group["root"].tolist(), group["stray"].tolist()
        mixed = bool(group["mixed"].iloc[0])
        # members and their occurrences become columns, so shared weight is a product of matrices
        out, joined = [], set()
        columns, at = np.unique(np.concatenate([s[0] for s in sets]), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), [len(s[0]) for s in sets])
        weight = np.concatenate([s[1] for s in sets])
        totals = np.array([s[1].sum() for s in sets])
        for i in range(len(sets)):
            mine = np.zeros(len(columns))
            mine[at[owner == i]] = weight[owner == i]
            shared_weight = np.bincount(owner, np.minimum(weight, mine[at]), minlength=len(sets))
            alike = shared_weight >= least * (totals + totals[i] - shared_weight)
            for j in np.flatnonzero(alike):
                if roots_[i] < roots_[j] and (roots_[i], roots_[j]) not in joined and not (mixed and stray_[i] == stray_[j]):
                    joined.add((roots_[i], roots_[j]))
                    out.append((names[i], names[j]))
        return pd.DataFrame(out, columns=["a", "b"])

    flat = dealt.select("band", "key", "name", "root", "stray", "text", "to.*")
    return flat.groupBy("band", "key", "i", "j", "mixed").applyInPandas(compare, "a string, b string").distinct()


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """``key``, ``name``, ``class_id``, ``kept`` of every row: texts linked by similarity are one class.

    ``class_id`` is the smallest key of the class and ``kept`` marks the rows that have it and, among those,
    the smallest digest ``name``; rows equal in key and text are alike in all columns. Null texts count as empty; texts without words
    are alike only if equal. A null key is used only if the class has no other.

    In each bucket of a band every class is first held against one leader, which differs between bands;
    components of those links are found, and classes of a bucket still in different components are then compared in
    blocks, so no candidate is left out and a bucket of near copies costs as many comparisons as it has members.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Weights.of(*document_frequencies(docs, text)))  # SLOTS floats
    rows = cut(_signatures(docs, key, text, shared), "signatures")
    classes = cut(rows.groupBy("name").agg(F.min("key").alias("key"), F.first("keys").alias("keys")), "classes")
    keyed = classes.where("keys is not null").select("name", F.posexplode("keys").alias("band", "key"))
    leaders = keyed.groupBy("band", "key").agg(F.min(F.struct(F.xxhash64("name", "band").alias("draw"), "name")).alias("l"), F.count(F.lit(1)).alias("n"))
    leaders = leaders.where("n > 1").select("band", "key", F.col("l.name").alias("leader"))
    buckets = cut(keyed.join(leaders, ["band", "key"]).where("name <> leader"), "buckets")
    pairs = cut(buckets.select(F.col("name").alias("a"), F.col("leader").alias("b")).distinct(), "pairs")
    needed = pairs.select(F.col("a").alias("name")).union(pairs.select(F.col("b").alias("name"))).distinct().join(classes.select("name", "key"), "name")
    digest = F.md5(_column(docs, text).cast("binary"))
    texts = docs.select(F.col(key).cast("long").alias("key_"), digest.alias("name_"), _column(docs, text).alias("text"))
    texts = texts.join(needed, (texts["name_"] == needed["name"]) & texts["key_"].eqNullSafe(needed["key"]))
    texts = cut(texts.select("key_", "name", "text").dropDuplicates(["key_", "name"]).select("name", "text"), "texts")
    links = cut(_verified(pairs, texts, shared, least), "verified")
    roots = cut(components(links), "roots")
    more = cut(_rest(buckets.drop("leader"), roots, texts, shared, least), "more")
    if more.limit(1).count():
        roots = cut(components(links.union(more)), "roots")
    rooted = classes.select("name", "key").join(roots, "name", "left").withColumn("root", F.coalesce("root", "name"))
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "name")).alias("best"))
    named = cut(rooted.join(best, "root").select("name", F.col("best.key").alias("class_id"), (F.col("name") == F.col("best.name")).alias("first")), "named")
    out = rows.select("key", "name").join(named, "name")
    return out.select(F.col("key").alias(key), "name", "class_id", (F.col("first") & F.col("key").eqNullSafe(F.col("class_id"))).alias("kept"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """One row of each class, the one with the smallest key, with all its columns; see ``near_classes``."""
    k, n = free_name(docs, "class_key"), free_name(docs, "class_name")
    kept = near_classes(docs, key, text, least).where("kept").select(F.col(key).alias(k), F.col("name").alias(n)).distinct()
    named = docs.withColumn(n + "_", F.md5(_column(docs, text).cast("binary")))
    joined = named.join(kept, (named[n + "_"] == F.col(n)) & F.col(key).cast("long").eqNullSafe(F.col(k)))
    return joined.dropDuplicates([k, n]).select(*docs.columns)
