"""Document fingerprints by a randomised edit embedding.

A random walk over the characters, shared by all texts, writes each character as often as the walk stays on
it: at step j on character c a random bit r(j, c) says whether the walk moves on. After a difference two walks
fall into step again soon, so edit distance becomes Hamming distance between the written sequences. A
fingerprint samples places of that sequence; likeness is the share of equal samples, and groups of samples are
the bands that candidates share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracekit.llm.components import components
from tracekit.session import cut, scratch_path

#: Samples per scale, samples per band, and the seed of walks and places.
SAMPLES, BAND, SEED = 256, 8, 20240
#: Bands per scale, and the part of a scale that they sample.
BANDS, REACH = 32, 0.4
#: Likeness from which texts are near, and classes in a block of comparisons.
LEAST, BLOCK = 0.8, 1024
#: The random bits repeat after so many steps; characters fall into so many classes of bits.
PERIOD, CLASSES = 4096, 256
_CHUNK = 1 << 16
#: Characters of the texts that are walked side by side, and texts from which that is quicker than one by one.
_SIDE_BY_SIDE, _FEW = 1 << 20, 24
_PAD = "."


class _Walk(dict):
    """Character to its row: for each step, the step after the walk has left the character."""

    def __init__(self):
        super().__init__()
        rng = np.random.default_rng(SEED)
        self.table = np.empty((CLASSES, PERIOD), dtype=np.int16)
        for row in self.table:
            leave = np.flatnonzero(rng.integers(0, 2, PERIOD) == 1)
            leave = np.concatenate([leave, [leave[0] + PERIOD]])
            row[:] = (leave[np.searchsorted(leave, np.arange(PERIOD))] + 1) % PERIOD
        steps = list(range(PERIOD))  # shared by all rows: a number of its own for each entry would not fit the caches
        self.rows = [[steps[a] for a in row] for row in self.table.tolist()]

    def __missing__(self, c: str) -> list[int]:
        row = self[c] = self.rows[ord(c) * 0x9E3779B1 >> 13 & CLASSES - 1]
        return row


_WALK: _Walk | None = None
_PLACES = np.sort(np.random.default_rng(SEED + 1).random(SAMPLES))
_REACHED = int(np.searchsorted(_PLACES, REACH)) - 1
_DIGITS = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)


def _walk() -> _Walk:
    global _WALK
    _WALK = _WALK or _Walk()
    return _WALK


def _left(states: np.ndarray, start: int) -> np.ndarray:
    """The absolute steps of states that follow each other, the first one come to from ``start``."""
    stay = np.diff(states, prepend=start % PERIOD) % PERIOD
    stay[stay == 0] = PERIOD
    return start + np.cumsum(stay)


def walk(text: str, start: int = 0) -> np.ndarray:
    """Step (absolute) at which the walk leaves each character, having come to the first at ``start``."""
    rows = _walk()
    parts, a = [np.zeros(0, dtype=np.int64)], start % PERIOD
    for low in range(0, len(text), _CHUNK):
        states = [a := row[a] for row in map(rows.__getitem__, text[low : low + _CHUNK])]
        parts.append(np.array(states, dtype=np.int64))
    return _left(np.concatenate(parts), start)


def _abreast(texts: list[str], codes: list[np.ndarray], starts: np.ndarray) -> list[np.ndarray]:
    """States of walks side by side, texts by falling length: step k takes character k of all that have one.

    Where few texts are left, each of them goes on by itself.
    """
    table, lengths = _walk().table.ravel(), np.array([len(x) for x in codes])
    steps = int(lengths[_FEW - 1]) if len(lengths) >= _FEW else 0
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")
    offset = np.concatenate([[0], np.cumsum(active)])
    row_of = np.empty(offset[-1], dtype=np.int32)
    for r, x in enumerate(codes):
        row_of[offset[: min(len(x), steps)] + r] = (x[:steps].astype(np.uint64) * np.uint64(0x9E3779B1) >> np.uint64(13) & np.uint64(CLASSES - 1)) * np.uint64(PERIOD)
    came, at = np.empty(offset[-1], dtype=np.int16), (starts % PERIOD).astype(np.int16)
    for low, high in zip(offset[:-1].tolist(), offset[1:].tolist()):
        at = came[low:high] = table[row_of[low:high] + at[: high - low]]
    out = []
    for r, (text, n) in enumerate(zip(texts, lengths.tolist())):
        states = came[offset[: min(n, steps)] + r].astype(np.int64)
        if n > steps:
            rows, a = _walk(), int(states[-1]) if steps else int(starts[r]) % PERIOD
            parts = [states]
            for low in range(steps, n, _CHUNK):
                parts.append(np.array([a := row[a] for row in map(rows.__getitem__, text[low : low + _CHUNK])], dtype=np.int64))
            states = np.concatenate(parts)
        out.append(_left(states, int(starts[r])))
    return out


def walks(texts: list[str], codes: list[np.ndarray], starts: list[int]) -> list[np.ndarray]:
    """``walk`` of each text from its start."""
    starts_, out = np.array(starts, dtype=np.int64), [None] * len(texts)
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    for i, found in zip(order, _abreast([texts[i] for i in order], [codes[i] for i in order], starts_[order])):
        out[i] = found
    return out


def _sampled(leave: np.ndarray, codes: np.ndarray, scale: int) -> str:
    places = (_PLACES * (1 << scale)).astype(np.int64)
    at = np.searchsorted(leave, places, side="right")
    inside = at < len(leave)
    digit = (codes[at[inside]] * np.uint32(0x85EBCA6B)) >> np.uint32(28)
    return _DIGITS[digit].tobytes().decode() + _PAD * int((~inside).sum())


def fingerprint(leave: np.ndarray, codes: np.ndarray) -> str:
    """``scale:samples:samples`` at the least power of two that holds the sequence, and at the next one."""
    scale = max(4, int(leave[-1]).bit_length()) if len(leave) else 4
    return f"{scale}:{_sampled(leave, codes, scale)}:{_sampled(leave, codes, scale + 1)}"


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def text_fingerprint(text: str) -> str:
    return fingerprint(walk(text), _codes(text))


def likeness(a: str, b: str) -> float:
    """Share of equal samples among those inside at least one text, at a scale that both have.

    Texts of which one is over twice as long share no scale: 0. Equal fingerprints: 1.
    """
    if a == b:
        return 1.0
    (m, *x), (n, *y) = a.split(":"), b.split(":")
    m, n = int(m), int(n)
    if abs(m - n) > 1:
        return 0.0
    scale = max(m, n)
    p, q = (np.frombuffer(v[scale - k].encode(), dtype=np.uint8) for v, k in ((x, m), (y, n)))
    some = (p != ord(_PAD)) | (q != ord(_PAD))
    return float((p == q)[some].mean()) if some.any() else 0.0


def _band_places() -> list[list[int]]:
    """Per band, its samples: drawn at random from the part of a scale that any text as long as the scale asks for fills.

    A band of neighbouring samples would be one stretch of the text, and every common opening one bucket of all that open so.
    """
    reach = int(np.searchsorted(_PLACES, REACH))
    return np.random.default_rng(SEED + 2).integers(0, reach, (BANDS, BAND)).tolist()


_BANDS = [itemgetter(*places) for places in _band_places()]


def bands(a: str) -> list[str]:
    """Band keys at both scales; at the larger one only bands without a sample behind the end.

    A text fills over half of its own scale. One that fills less of the next scale than bands reach is at most 0.8 times
    as long as any text of that scale, so it cannot be near one.
    """
    scale, own, larger = a.split(":")
    keys = [f"{scale}:{i}:{''.join(pick(own))}" for i, pick in enumerate(_BANDS)] if own[0] != _PAD else [a]
    if larger[_REACHED] != _PAD:
        keys += [f"{int(scale) + 1}:{i}:{''.join(pick(larger))}" for i, pick in enumerate(_BANDS)]
    return keys


@F.pandas_udf(T.StringType())
def fingerprint_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: text_fingerprint(x or ""), na_action=None)


@F.pandas_udf(T.DoubleType())
def likeness_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([likeness(x, y) for x, y in zip(a, b)])


#: Fingerprints whose bands a worker holds at once.
_BANDED = 512


def _banded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per name and band of its fingerprint."""
    for batch in batches:
        for low in range(0, len(batch), _BANDED):
            part = batch.iloc[low : low + _BANDED]
            found = part["print"].map(bands)
            yield pd.DataFrame({"name": np.repeat(part["name"].to_numpy(), found.map(len)), "band": [x for keys in found for x in keys]})


class _Packed(NamedTuple):
    """Samples of fingerprints at their own scale and the next one, 16 a number; the last ones may lie behind the text's end."""

    digits: np.ndarray  # fingerprint, scale, number
    inside: np.ndarray  # the low bit of each sample inside the text
    sizes: np.ndarray  # how many are inside
    equal: np.ndarray  # the same for equal fingerprints
    groups: dict  # per scale: places, and the first three with the fingerprints last


def _parts(prints: pd.Series) -> tuple[np.ndarray, _Packed]:
    """Scales, and for each fingerprint its samples at that scale and the next one."""
    cut_up = [x.split(":") for x in prints]
    letters = np.frombuffer("".join(x + y for _, x, y in cut_up).encode(), dtype=np.uint8).reshape(len(cut_up), 2, SAMPLES // 2, 2)
    within = letters != ord(_PAD)
    hexes = np.where(within, np.where(letters >= ord("a"), letters - (ord("a") - 10), letters - ord("0")), 0).astype(np.uint8)
    packed = lambda x: np.ascontiguousarray(x[..., 0] | x[..., 1] << np.uint8(4)).view(np.uint64)
    digits, inside, sizes = packed(hexes), packed(within.astype(np.uint8)), within.sum(axis=(2, 3))
    scales, groups = np.array([int(x[0]) for x in cut_up]), {}
    for scale in np.unique(scales).tolist():
        at = np.flatnonzero(scales == scale)
        groups[scale] = (at, *(np.ascontiguousarray(np.moveaxis(x[at], 0, -1)) for x in (digits, inside, sizes)))
    return scales, _Packed(digits, inside, sizes, pd.factorize(np.asarray(prints, dtype=object))[0], groups)


def _same(digits: np.ndarray, inside: np.ndarray, one: np.ndarray) -> np.ndarray:
    """How many samples inside both are equal."""
    x = digits ^ one[:, None]
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return np.bitwise_count(~x & inside).sum(axis=0, dtype=np.int64)


def _likeness_to(i: int, scales: np.ndarray, rows: _Packed) -> np.ndarray:
    """``likeness`` of fingerprint ``i`` and all of them."""
    out = np.zeros(len(scales))
    for other, mine, theirs in ((0, 0, 0), (1, 1, 0), (-1, 0, 1)):
        if int(scales[i]) + other not in rows.groups:
            continue
        at, digits, inside, sizes = rows.groups[int(scales[i]) + other]
        digits, inside, one, size = digits[theirs], inside[theirs], rows.digits[i, mine], rows.sizes[i, mine]
        n = np.maximum(sizes[theirs], size)
        same = _same(digits, inside & rows.inside[i, mine][:, None], one)
        out[at] = np.where(n > 0, same / np.maximum(n, 1), 0.0)
    out[rows.equal == rows.equal[i]] = 1.0
    return out


def _likeness_of(i: np.ndarray, j: np.ndarray, scales: np.ndarray, rows: _Packed) -> np.ndarray:
    """``likeness`` of each pair of fingerprints ``i``, ``j``."""
    out, apart = np.zeros(len(i)), scales[i] - scales[j]
    for other, mine, theirs in ((0, 0, 0), (-1, 1, 0), (1, 0, 1)):
        at = np.flatnonzero(apart == other)
        one, two = i[at], j[at]
        both = rows.inside[one, mine] & rows.inside[two, theirs]
        n = np.maximum(rows.sizes[one, mine], rows.sizes[two, theirs])
        same = _same((rows.digits[one, mine] ^ rows.digits[two, theirs]).T, both.T, np.zeros(both.shape[1], dtype=np.uint64))
        out[at] = np.where(n > 0, same / np.maximum(n, 1), 0.0)
    out[rows.equal[i] == rows.equal[j]] = 1.0
    return out


def _rest(buckets: DataFrame, roots: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Links within buckets between classes that their leaders left in different components.

    As in ``neardup``: all but a bucket's largest component ("strays") are held against all classes of other
    components, in blocks of about ``BLOCK`` classes that are dealt to tasks. A block pair returns one link per
    pair of components it joins.
    """
    rooted = buckets.join(roots, "name", "left").withColumn("root", F.coalesce("root", "name"))
    sizes = rooted.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("band").agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    main = main.select("band", F.col("m.root").alias("main"), F.ceil((F.col("n") - F.col("m.n")) / BLOCK).cast("int").alias("strays"), F.ceil(F.col("m.n") / BLOCK).cast("int").alias("mains"))
    rows = rooted.join(cut(main, "main"), "band").withColumn("stray", F.col("root") != F.col("main"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("name", "band"), F.when(F.col("stray"), F.col("strays")).otherwise(F.col("mains"))).cast("int"))
    with_strays = F.transform(F.sequence(F.lit(0), F.col("strays") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j"), F.lit(False).alias("mixed")))
    with_mains = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda j: F.struct(F.col("block").alias("i"), j.alias("j"), F.lit(True).alias("mixed")))
    of_main = F.transform(F.sequence(F.lit(0), F.col("strays") - 1), lambda j: F.struct(j.alias("i"), F.col("block").alias("j"), F.lit(True).alias("mixed")))
    to = F.when(F.col("stray"), F.concat(with_strays, with_mains)).otherwise(of_main)
    dealt = rows.join(classes.select("name", "print"), "name").select("band", "name", "root", "stray", "print", F.explode(to).alias("to"))

    flat = dealt.select("band", "name", "root", "stray", "print", "to.*")
    together = ["band", "i", "j", "mixed"]
    laid = flat.withColumn("meet", F.xxhash64(*together)).repartition("meet").sortWithinPartitions("meet", *together)
    return laid.drop("meet").mapInPandas(_compare(least), "a binary, b binary, likeness double").distinct()


#: Pairs that are held against each other at once.
_PAIRS = 1 << 16


def _compare(least: float):
    """Compares the rows of each block pair, which follow each other: one link per pair of components it joins.

    Most block pairs hold a few rows, so many of them are compared by the same array operations.
    """

    def links(rows: pd.DataFrame, of: np.ndarray) -> pd.DataFrame:
        _, samples = parts = _parts(rows["print"])
        names, stray, mixed = rows["name"].tolist(), rows["stray"].to_numpy(bool), rows["mixed"].to_numpy(bool)
        root = pd.factorize(rows["root"])[0]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(rows)]])
        last = np.repeat(edges[1:], np.diff(edges))
        out, joined = [], set()
        # row i meets the rows behind it in its block pair
        meets = last - np.arange(len(rows)) - 1
        cuts = np.concatenate([[0], np.cumsum(meets)])
        low = 0
        while low < len(rows):
            high = max(low + 1, int(np.searchsorted(cuts, cuts[low] + _PAIRS, side="right")) - 1)
            i = np.repeat(np.arange(low, high), meets[low:high])
            j = np.arange(len(i)) - np.repeat(cuts[low:high] - cuts[low], meets[low:high]) + i + 1
            some = (root[i] != root[j]) & (~mixed[i] | (stray[i] != stray[j]))
            i, j = i[some], j[some]
            alike = _likeness_of(i, j, *parts)
            for k in np.flatnonzero(alike >= least):
                x, y = int(i[k]), int(j[k])
                pair = (of[x], min(root[x], root[y]), max(root[x], root[y]))
                if pair not in joined:
                    joined.add(pair)
                    out.append((max(names[x], names[y]), min(names[x], names[y]), float(alike[k])))
            low = high
        return pd.DataFrame(out, columns=["a", "b", "likeness"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            of = rows.groupby(["band", "i", "j", "mixed"], sort=False).ngroup().to_numpy()
            # the last block pair may go on in the next batch
            done = int(np.searchsorted(of, of[-1])) if len(of) else 0
            held = rows.iloc[done:]
            if done:
                yield links(rows.iloc[:done], of[:done])
        if held is not None and len(held):
            yield links(held, np.zeros(len(held), dtype=np.int64))

    return run


def prints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``name`` (digest of the text; null: empty) and ``print`` of every row."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("key"), F.unhex(F.md5(whole.cast("binary"))).alias("name"), fingerprint_udf(whole).alias("print"))


def _classes_and_links(rows: DataFrame, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts (``name``, smallest ``key``, ``rows``, ``print``), links ``a``, ``b``, ``likeness`` of names, and roots."""
    classes = cut(rows.groupBy("name").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("rows"), F.first("print").alias("print")), "classes")
    keyed = classes.select("name", "print").mapInPandas(_banded, "name binary, band string").select("name", F.xxhash64("band").alias("band"))
    # nearly all bands are met once: only their hashes are shuffled, names only of those that are shared
    shared = cut(keyed.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band"), "shared")
    kept = cut(keyed.join(shared, "band", "left_semi"), "shared-bands")
    leaders = kept.groupBy("band").agg(F.min("name").alias("leader"))
    # a leader stays in its bucket: it may be left in another component than the others
    buckets = cut(kept.join(leaders, "band"), "buckets")
    pairs = buckets.where("name <> leader").select(F.col("name").alias("a"), F.col("leader").alias("b")).distinct()
    one, two = (classes.select(F.col("name").alias(c), F.col("print").alias(f"print_{c}")) for c in ("a", "b"))
    alike = pairs.join(one, "a").join(two, "b").select("a", "b", likeness_udf("print_a", "print_b").alias("likeness"))
    links = cut(alike.where(F.col("likeness") >= least), "links")
    roots = cut(components(links.select("a", "b")), "roots")
    more = cut(_rest(buckets.drop("leader"), roots, classes, least), "more")
    if more.limit(1).count():
        links = links.union(more)
        roots = cut(components(links.select("a", "b")), "roots")
    return classes, links, roots


def near_links(docs: DataFrame, least: float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Links ``key``, ``leader``, ``likeness`` between texts that share a band and are alike.

    Equal texts are one class, named by its smallest key, and are not linked among themselves. In each band bucket every
    class is first held against one leader; classes of a bucket that the leaders' links leave in different components are
    then compared in blocks. So any two classes that share a band and have a likeness of at least ``least`` are
    connected, if not always directly. Null texts are empty texts; ``near_members`` tells the class of every row.
    """
    classes, links, _ = _classes_and_links(prints(docs, key, text), least)
    one, two = classes.select(F.col("name").alias("a"), F.col("key").alias("key_a")), classes.select(F.col("name").alias("b"), F.col("key").alias("key_b"))
    named = links.join(one, "a").join(two, "b")
    return named.select(F.greatest("key_a", "key_b").alias(key), F.least("key_a", "key_b").alias("leader"), "likeness")


def near_members(rows: DataFrame, least: float) -> DataFrame:
    """``name``, ``near_class`` and ``near_rows`` of every text of ``prints``: texts connected by links are one class.

    ``near_class`` is the smallest key of the class, ``near_rows`` the number of its rows, copies counted.
    """
    classes, _, roots = _classes_and_links(rows, least)
    rooted = classes.select("name", "key", "rows").join(roots, "name", "left").withColumn("root", F.coalesce("root", "name"))
    sums = rooted.groupBy("root").agg(F.min("key").alias("near_class"), F.sum("rows").alias("near_rows"))
    return rooted.select("name", "root").join(cut(sums, "sums"), "root").select("name", "near_class", "near_rows")


def with_classes(docs: DataFrame, least: float, slots: int | None = None) -> DataFrame:
    """``compare_edited`` of all documents with ``near_class`` and ``near_rows``, see ``near_members``."""
    edited = compare_edited(docs, slots)
    path = scratch_path(docs.sparkSession, "edited")
    edited.write.option("compression", "zstd").parquet(path)
    edited = docs.sparkSession.read.schema(edited.schema).parquet(path)
    members = cut(near_members(edited.select(F.col("doc_id").alias("key"), F.col("text_md5").alias("name"), F.col("fingerprint").alias("print")), least), "members")
    joined = edited.join(members, edited["text_md5"] == members["name"])
    return joined.select(*[c for c in edited.columns if c != "text_md5"], "near_class", "near_rows")


def _bucket(order_key: Column, bounds: list[float], df: DataFrame) -> DataFrame:
    if not bounds:
        return df.withColumn("slot", F.when(order_key.isNotNull(), F.lit(0)))
    splits = [-float("inf"), *bounds, float("inf")]
    keyed = df.withColumn("order_value", order_key.cast("double"))
    cut_up = Bucketizer(splits=splits, inputCol="order_value", outputCol="slot", handleInvalid="keep").transform(keyed)
    return cut_up.withColumn("slot", F.col("slot").cast("int")).drop("order_value")


def with_next(docs: DataFrame, slots: int) -> DataFrame:
    """Rows laid out so that each one's successor by descending doc_id follows it in its partition.

    Slots are ranges of doc_id; the first row of each slot is also sent, as a guest, to the end of the slot
    before it, and that of the first slot to the last one, which closes the circle. Texts are shuffled once. Equal
    doc_ids are ordered by a hash of their text, null ones come last.
    """
    rows = docs.withColumn("draw", F.xxhash64("text"))
    bounds = sorted(set(docs.approxQuantile("doc_id", [k / slots for k in range(1, slots)], 0.2 / slots))) if slots > 1 else []
    rows = _bucket(-F.col("doc_id"), sorted(-b for b in bounds), rows)
    # a null doc_id lands in the slot after the last one
    rows = rows.withColumn("slot", F.coalesce("slot", F.lit(len(bounds) + 2)))
    top = rows.groupBy("slot").agg(F.min(F.struct(-F.col("doc_id"), F.col("draw"))).alias("top"))
    firsts = sorted((r.slot, r.top[0], r.top[1]) for r in top.collect())  # at most a row per slot
    guests = [(firsts[i - 1][0], s, None if d is None else -d, w) for i, (s, d, w) in enumerate(firsts)]
    table = docs.sparkSession.createDataFrame(guests or [(0, -1, None, 0)], "target int, slot int, doc_id long, draw long")
    same = (rows["slot"] == table["slot"]) & rows["doc_id"].eqNullSafe(table["doc_id"]) & (rows["draw"] == table["draw"])
    joined = rows.join(F.broadcast(table), same, "left").select(
        rows["doc_id"], rows["text"], rows["draw"],
        F.explode(F.when(F.col("target").isNotNull(), F.array(F.struct(rows["slot"], F.lit(0).alias("guest")), F.struct(F.col("target").alias("slot"), F.lit(1).alias("guest"))))
                  .otherwise(F.array(F.struct(rows["slot"], F.lit(0).alias("guest"))))).alias("at"))
    laid = joined.select("doc_id", "text", "draw", "at.slot", "at.guest").repartition("slot")
    return laid.sortWithinPartitions("slot", "guest", F.desc_nulls_last("doc_id"), "draw")


def _pieces(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows of about ``_SIDE_BY_SIDE`` characters each."""
    of = np.cumsum(batch["text"].str.len().to_numpy(dtype=np.int64)) // _SIDE_BY_SIDE
    for low, high in zip(*(lambda e: (e[:-1], e[1:]))([0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(batch)])):
        yield batch.iloc[low:high]


EDITED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, shared_bands int, text_md5 binary")


def compare_edited(docs: DataFrame, slots: int | None = None) -> DataFrame:
    """Fingerprints of every whole text and of its edited form, and how alike they are.

    ``docs`` has doc_id and text (null: empty). Edited: the last third of the code points, rounded down, replaced by
    as many from the start of the next text in descending doc_id. The walk of the kept part is not repeated. Repeated
    rows each get a row; a single document is its own successor; an empty table gives no rows. ``shared_bands``
    counts the bands that both fingerprints have; ``text_md5`` is the digest of the whole text.
    """
    spark = docs.sparkSession
    slots = slots or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def finish(doc_id, text, codes, leave, own, tail, tail_codes, tail_leave, next_print):
        n = len(text)
        kept = n - n // 3
        edited = fingerprint(np.concatenate([leave[:kept], tail_leave]), np.concatenate([codes[:kept], tail_codes]))
        digest = hashlib.sha256((text[:kept] + tail).encode("utf-8", "surrogatepass")).hexdigest()
        return (doc_id, n, digest, own, edited, likeness(own, edited), likeness(own, next_print), len(set(bands(own)) & set(bands(edited))),
                hashlib.md5(text.encode("utf-8", "surrogatepass")).digest())

    def finished(pairs: list[tuple]) -> list[tuple]:
        """Rows of (a document, the one after it); the edited tails are walked side by side."""
        tails, starts = [], []
        for (_, text, _, leave, _), (_, following, _, _, _) in pairs:
            kept = len(text) - len(text) // 3
            tails.append(following[: len(text) // 3])
            starts.append(int(leave[kept - 1]) if kept else 0)
        codes = [_codes(x) for x in tails]
        return [finish(*one, tail, c, left, after[-1]) for (one, after), tail, c, left in zip(pairs, tails, codes, walks(tails, codes, starts))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, held_slot = None, None
        for batch in batches:
            for part in _pieces(batch):
                texts = part["text"].tolist()
                codes = [_codes(x) for x in texts]
                pairs = []
                for doc_id, text, code, leave, slot, guest in zip(part["doc_id"], texts, codes, walks(texts, codes, [0] * len(texts)), part["slot"], part["guest"]):
                    if guest and (held is None or slot != held_slot):
                        continue  # a repeated first row sends more than one guest
                    row = (None if guest or pd.isna(doc_id) else int(doc_id), text, code, leave, fingerprint(leave, code))
                    if held is not None:
                        pairs.append((held, row))
                    held, held_slot = None if guest else row, slot
                frame = pd.DataFrame(finished(pairs), columns=[x.split(" ")[0] for x in EDITED.split(", ")])
                yield frame.astype({"doc_id": "Int64"})
        if held is not None:
            raise ValueError("a slot ended without its guest")

    return with_next(docs, slots).select("doc_id", "text", "slot", "guest").mapInPandas(run, EDITED)
