"""Language-model scores from a hierarchical Pitman-Yor model of word pairs.

Each preceding word is a restaurant whose customers are the words that follow it; a new table there is a customer
of the one parent that all contexts share, whose tables order from a uniform choice among the known words and one
unknown. Seating is sampled by Gibbs sweeps: the customers of a dish in a restaurant are seated anew given the other
tables of the sweep before, in all restaurants at once; only numbers of tables are kept, as predictions need no
more. Texts are scored with the predictive probabilities averaged over the kept sweeps.

The corpus is read once into blocks of word numbers, written to a table that is bucketed by block, so no later pass
shuffles it. What travels are packed arrays: the distinct word pairs of a block to be counted once, and per sweep the
tables that a block's pairs add to each of its words, and back what they come to. A pair is dealt by a hash of both
words and a word by its own hash, and blocks have summed them up before: a word or pair that makes up a third of all
tokens is one entry per block. Draws are keyed by the pair, so all blocks that hold a pair seat it alike.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracekit.llm.common import mix
from tracekit.session import cut, scratch_path

#: Sweeps before and while predictions are averaged; strengths of context restaurants and of their parent.
BURN, KEEP, STRENGTH, ROOT_STRENGTH = 1, 2, 1.0, 1.0
#: Tokens of a block; entries of pairs and of words that one counting task gets.
BLOCK_TOKENS, PAIR_SHARE, WORD_SHARE = 2_000_000, 1_500_000, 1_000_000
#: Counts up to which the number of tables is drawn from its exact conditional. Larger dishes get their expected number.
EXACT = 32
#: Bits of a pair's key within its share: of 1.5 million pairs about one in a million meets another one's key.
PAIR_BITS = 40
#: Larger dishes that are seated at a time, in cache.
SEATED = 8192
FOLDS, FOLD = 7, 2

_PRIME = np.uint64(0x9E3779B97F4A7C15)


# ---- seating

_STIRLING: dict[float, np.ndarray] = {}


def log_stirling(d: float) -> np.ndarray:
    """log of the generalised Stirling numbers: ways to seat c customers at t tables under discount d."""
    if d not in _STIRLING:
        s = np.full((EXACT + 1, EXACT + 1), -np.inf)
        s[0, 0] = 0.0
        t = np.arange(EXACT + 1)
        for c in range(EXACT):
            stay = np.full(EXACT + 1, -np.inf)
            some = (t > 0) & (t <= c)
            stay[some] = s[c][some] + np.log(c - t[some] * d)
            s[c + 1] = np.logaddexp(stay, np.concatenate([[-np.inf], s[c][:-1]]))
        _STIRLING[d] = s
    return _STIRLING[d]


def uniform(keys: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in (0, 1) that follow from key and seed."""
    return ((mix(keys, seed) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def _expected_tables(goal: np.ndarray, mass: np.ndarray, others: np.ndarray, d: float, strength: float) -> np.ndarray:
    """Tables of dishes, those of most customers first, by the expected rate of seating one after the other.

    All dishes have as many seated at a time, so those that are full are the last ones and are left alone.
    """
    tables, seated, less = np.ones(len(goal)), 1.0, -goal
    while n := int(np.searchsorted(less, -seated)):
        step = max(1.0, seated // 32)
        x, new = tables[:n], (strength + d * (others[:n] + tables[:n])) * mass[:n]
        rate = seated - d * x
        rate += new
        new *= np.minimum(step, goal[:n] - seated)
        new /= rate
        x += new
        seated += step
    return tables


def seat(c: np.ndarray, base: np.ndarray, others: np.ndarray, d: float, strength: float, keys: np.ndarray, seed: int) -> np.ndarray:
    """Tables of each dish after its ``c`` customers are seated anew.

    ``base`` is the parent's probability of the dish, ``others`` the tables of its restaurant's other dishes. One
    customer has one table. The number of tables has weight Stirling(c, t) x base^t x product of (strength + d x tables
    open before); dishes of over ``EXACT`` customers open tables at the expected rate of seating one after the other, rounded at random.
    """
    t = np.minimum(c, 1).astype(np.int64)
    few = np.flatnonzero((c > 1) & (c <= EXACT))
    few = few[np.argsort(c[few], kind="stable")]
    for rows in np.split(few, np.flatnonzero(np.diff(c[few])) + 1) if len(few) else []:
        n = int(c[rows[0]])
        # each weight by its ratio to the one before; the range of doubles holds them for over 10^9 other tables
        ways = np.exp(np.diff(log_stirling(d)[n, 1 : n + 1]))
        for part in np.array_split(rows, -(-len(rows) * n // (1 << 17))):
            weight, chance, before = np.ones((n, len(part))), base[part], others[part]
            for k in range(1, n):
                np.multiply(weight[k - 1], ways[k - 1] * chance * (strength + d * (before + k)), out=weight[k])
            share = np.cumsum(weight, axis=0, out=weight)
            t[part] = 1 + (share < share[-1] * uniform(keys[part], seed)).sum(axis=0)
    many = np.flatnonzero(c > EXACT)
    many = many[np.argsort(-c[many], kind="stable")]
    for at in range(0, len(many), SEATED):
        part = many[at : at + SEATED]
        tables = _expected_tables(c[part].astype(np.float64), base[part], others[part], d, strength)
        t[part] = np.floor(np.minimum(tables, c[part] - 1.0) + uniform(keys[part], seed)).astype(np.int64)
    return t


# ---- packed arrays


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, four bytes each where they fit."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    small = not len(gaps) or int(gaps.max()) < 1 << 32
    return bytes([small]) + zlib.compress((gaps.astype(np.uint32) if small else gaps).tobytes(), 1)


def unpack_keys(data: bytes) -> np.ndarray:
    gaps = np.frombuffer(zlib.decompress(data[1:]), dtype=np.uint32 if data[0] else np.uint64)
    return np.cumsum(gaps.astype(np.uint64), dtype=np.uint64)


def pack(x: np.ndarray) -> bytes:
    """Counts in the least of 1, 4 or 8 bytes each."""
    top = int(x.max()) if len(x) else 0
    kind = 0 if top < 1 << 8 else 1 if top < 1 << 32 else 2
    return bytes([kind]) + zlib.compress(x.astype((np.uint8, np.uint32, np.uint64)[kind]).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), dtype=(np.uint8, np.uint32, np.uint64)[data[0]]).astype(np.int64)


def _slices(keys: np.ndarray, bits: int, shares: int) -> np.ndarray:
    """Where sorted keys of so many bits cross from one share to the next."""
    edges = np.array([(s << bits) // shares for s in range(1, shares)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of sorted values, and the place of each value among them."""
    new = np.ones(len(x), dtype=bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new], np.cumsum(new) - 1


def _order(x: np.ndarray, below: int) -> np.ndarray:
    """Places of values under ``below`` in sorted order, sorted as one number with the value where both fit."""
    bits = max(len(x) - 1, 0).bit_length()
    if (below - 1).bit_length() + bits > 64:
        return np.argsort(x, kind="stable")
    both = (x << np.uint64(bits)) | np.arange(len(x), dtype=np.uint64)
    both.sort()
    return (both & np.uint64((1 << bits) - 1)).astype(np.int64)


# ---- blocks


def held_out(key: int | None, folds: int = FOLDS, fold: int = FOLD) -> bool:
    """Whether a document is held out: crc32 of its key as text; a null key is."""
    return key is None or zlib.crc32(str(key).encode()) % folds == fold


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


BLOCKS = "block string, doc_ids array<long>, sizes array<int>, numbers binary, words binary, tokens long, n_words long"


def read_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The corpus in blocks of about ``BLOCK_TOKENS`` tokens: documents, token numbers and hashes of the words numbered.

    A token is a run of bytes other than the six ASCII white-space characters, A-Z in lower case; each document ends in the empty
    word, which has number 0 in every block.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, ids, doc_ids, sizes, size = _Numbers({b"": 0}), [], [], [], 0

        def block() -> pd.DataFrame:
            words = np.array([xxhash.xxh3_64_intdigest(w) for w in numbers], dtype=np.uint64)
            return pd.DataFrame({"block": [uuid.uuid4().hex], "doc_ids": [doc_ids], "sizes": [sizes], "numbers": [zlib.compress(np.concatenate(ids).tobytes(), 1)],
                                 "words": [words.tobytes()], "tokens": [size], "n_words": [len(words)]})

        for batch in batches:
            for doc_id, x in zip(batch["key"], batch["text"]):
                found = x.encode("utf-8", "surrogatepass").lower().split()
                found.append(b"")
                ids.append(np.fromiter(map(numbers.__getitem__, found), dtype=np.uint32, count=len(found)))
                doc_ids.append(None if pd.isna(doc_id) else int(doc_id))
                sizes.append(len(found))
                size += len(found)
                if size >= BLOCK_TOKENS:
                    yield block()
                    numbers, ids, doc_ids, sizes, size = _Numbers({b"": 0}), [], [], [], 0
        if ids:
            yield block()

    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInPandas(run, BLOCKS)


class _Block:
    """One block opened: its tokens, its words in key order, its distinct pairs in key order."""

    def __init__(self, row, shares: tuple[int, int], fold: tuple[int, int], pairs: bool = True):
        self.row, self.shares = row, shares
        self.numbers = np.frombuffer(zlib.decompress(row["numbers"]), dtype=np.uint32)
        self.sizes = np.asarray(row["sizes"], dtype=np.int64)
        self.ids = [None if x is None or pd.isna(x) else int(x) for x in row["doc_ids"]]
        self.held = np.array([held_out(x, *fold) for x in self.ids])
        self.learnt = np.repeat(~self.held, self.sizes)
        words = np.frombuffer(row["words"], dtype=np.uint64)
        self.order = np.argsort(words)
        self.words = words[self.order]
        self.word_slices = _slices(self.words, 64, shares[0])
        if pairs:
            n = np.uint64(len(words))
            self.pairs = self.numbers.astype(np.uint64)
            self.pairs[1:] += self.numbers[:-1] * n  # a text follows the end of another, which is number 0
            self.distinct = _distinct(np.sort(self.pairs))[0]
            u, w = self.distinct // n, self.distinct % n
            bits = PAIR_BITS + max(0, (shares[1] - 1).bit_length())
            keys = mix(words[u] * _PRIME + words[w]) >> np.uint64(64 - bits)
            self.by_key = np.argsort(keys)
            self.keys, self.u, self.w = keys[self.by_key], u[self.by_key].astype(np.int64), w[self.by_key].astype(np.int64)
            self.pair_slices = _slices(self.keys, bits, shares[1])

    def learnt_counts(self) -> np.ndarray:
        """How often each pair occurs in the documents that are learnt from, in key order."""
        return np.bincount(self.places()[self.learnt], minlength=len(self.distinct))[self.by_key]

    def places(self) -> np.ndarray:
        """Place of each token's pair among the distinct ones. Searching them for each token would take many times as long."""
        order = _order(self.pairs, len(self.words) ** 2)
        at = np.empty(len(order), dtype=np.int64)
        at[order] = _distinct(self.pairs[order])[1]
        return at

    def of_tokens(self, x: np.ndarray) -> np.ndarray:
        """Values of pairs in key order, spread to the tokens."""
        plain = np.empty_like(x)
        plain[self.by_key] = x
        return plain[self.places()]

    def by_number(self, rows: pd.DataFrame, column: str) -> np.ndarray:
        """Values that came back per share of words, in the order of the block's numbers."""
        values = np.concatenate([unpack(x) for x in rows.sort_values("share")[column]])
        out = np.zeros(len(self.words), dtype=np.int64)
        out[self.order] = values
        return out


PAIRS = "share int, block string, keys binary, counts binary"
WORDS = "share int, block string, keys binary, counts binary"
TYPES = "block string, share int, c binary, own binary, once long, twice long"
SUMS = "share int, block string, t binary, c0 binary"
STATE = "block string, share int, sweep int, c binary, t binary, c0 binary, t0 binary, n long, v long, sum_c0 long, sum_t0 long, once long, twice long"


def _rows(group: pd.DataFrame) -> list[dict]:
    return group.to_dict("records")


def _pairs_of(shares, fold):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in _rows(batch):
                b = _Block(row, shares, fold)
                counts = b.learnt_counts()
                cuts = list(zip(b.pair_slices[:-1], b.pair_slices[1:]))
                yield pd.DataFrame([(s, row["block"], pack_keys(b.keys[i:j]), pack(counts[i:j])) for s, (i, j) in enumerate(cuts) if j > i], columns=["share", "block", "keys", "counts"])

    return run


def _words_of(shares, fold):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in _rows(batch):
                b = _Block(row, shares, fold, pairs=False)
                counts = np.bincount(b.numbers[b.learnt], minlength=len(b.words))[b.order]
                cuts = list(zip(b.word_slices[:-1], b.word_slices[1:]))
                yield pd.DataFrame([(s, row["block"], pack_keys(b.words[i:j]), pack(counts[i:j])) for s, (i, j) in enumerate(cuts) if j > i], columns=["share", "block", "keys", "counts"])

    return run


def _merge(group: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a share in block order, their bounds, the distinct keys, the first place of each, and the key at each place."""
    group = group.sort_values("block", ignore_index=True)
    keys = [unpack_keys(x) for x in group["keys"]]
    bounds = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    distinct, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    return group, bounds, distinct, first, at


def _count_pairs(group: pd.DataFrame) -> pd.DataFrame:
    group, bounds, distinct, first, at = _merge(group)
    c = np.bincount(at, np.concatenate([unpack(x) for x in group["counts"]]), minlength=len(distinct)).astype(np.int64)
    own = np.zeros(len(at), dtype=np.uint8)
    own[first] = 1
    cuts = list(zip(bounds[:-1], bounds[1:]))
    out = pd.DataFrame({"block": group["block"], "share": group["share"], "c": [pack(c[at[i:j]]) for i, j in cuts],
                        "own": [pack(own[i:j]) for i, j in cuts], "once": 0, "twice": 0})
    out.loc[0, ["once", "twice"]] = [int((c == 1).sum()), int((c == 2).sum())]
    return out


def _root(row: pd.Series, scalars: dict) -> np.ndarray:
    """Probability of each word in the parent of all contexts."""
    d, back = scalars["d0"], (ROOT_STRENGTH + scalars["d0"] * scalars["sum_t0"]) / (scalars["v"] + 1)
    return (np.maximum(row["c0"] - d * row["t0"], 0) + back) / (ROOT_STRENGTH + scalars["sum_c0"])


def _tables(b: _Block, c: np.ndarray, state: dict | None, scalars: dict | None, sweep: int, at: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Tables of the block's pairs (those ``at``): one each at first, then drawn from the state of the sweep before."""
    if state is None:
        return np.minimum(c[at], 1)
    base = _root(state, scalars)
    return seat(c[at], base[b.w[at]], np.maximum(state["t"][b.u[at]] - 1, 0), scalars["d"], STRENGTH, b.keys[at], sweep)


def _add_up(shares, fold, sweep: int, scalars: dict | None):
    """Per block and share of words: tables in each word's restaurant, customers that they send to the parent."""

    def run(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in _rows(block):
            b = _Block(row, shares, fold)
            c, own, states = _answers(b, answers)
            # of the blocks that hold a pair, one adds it up, and only that one seats it
            at = np.flatnonzero(own)
            t = _tables(b, c, states.get(sweep - 1), scalars, sweep, at)
            tables = np.bincount(b.u[at], t, minlength=len(b.words))[b.order]
            customers = np.bincount(b.w[at], t, minlength=len(b.words))[b.order]
            cuts = list(zip(b.word_slices[:-1], b.word_slices[1:]))
            out += [(s, row["block"], pack(tables[i:j]), pack(customers[i:j])) for s, (i, j) in enumerate(cuts) if j > i]
        return pd.DataFrame(out, columns=["share", "block", "t", "c0"])

    return run


def _answers(b: _Block, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, dict[int, dict]]:
    """Counts and ownership of the block's pairs, and the states of its words by sweep."""
    types = rows[rows["sweep"] < 0].sort_values("share")
    c, own = (np.concatenate([unpack(x) for x in types[k]]) for k in ("c", "t"))
    states = {}
    for sweep, part in rows[rows["sweep"] >= 0].groupby("sweep"):
        states[int(sweep)] = {k: b.by_number(part, k) for k in ("c", "t", "c0", "t0")}
    return c, own, states


def _settle(sweep: int, scalars: dict | None):
    """Per share of words: sums over all blocks, the parent's seating, and both sent back to every block."""

    def run(words: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        if not len(words):
            return pd.DataFrame(columns=[x.split(" ")[0] for x in STATE.split(", ")])
        group, bounds, distinct, _, at = _merge(words)
        sums = sums.sort_values("block", ignore_index=True)
        add = lambda x: np.bincount(at, np.concatenate([unpack(y) for y in x]), minlength=len(distinct)).astype(np.int64)
        c, t, c0 = add(group["counts"]), add(sums["t"]), add(sums["c0"])
        if scalars is None:
            t0 = np.minimum(c0, 1)
        else:
            base = np.full(len(c0), 1.0 / (scalars["v"] + 1))
            t0 = seat(c0, base, np.full(len(c0), max(scalars["sum_t0"] - 1, 0)), scalars["d0"], ROOT_STRENGTH, distinct, 1000 + sweep)
        cuts = list(zip(bounds[:-1], bounds[1:]))
        out = pd.DataFrame({"block": group["block"], "share": group["share"], "sweep": sweep})
        for name, x in (("c", c), ("t", t), ("c0", c0), ("t0", t0)):
            out[name] = [pack(x[at[i:j]]) for i, j in cuts]
        stats = {"n": c.sum(), "v": (c > 0).sum(), "sum_c0": c0.sum(), "sum_t0": t0.sum(), "once": (c0 == 1).sum(), "twice": (c0 == 2).sum()}
        for name, x in stats.items():
            out[name] = 0
            out.loc[0, name] = int(x)
        return out

    return run


SCORES = "key long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(shares, fold, scalars: dict[int, dict]):
    def run(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in _rows(block):
            b = _Block(row, shares, fold)
            c, _, states = _answers(b, answers)
            p = np.zeros(len(c))
            for sweep in range(BURN + 1, BURN + KEEP + 1):
                state, s = states[sweep], scalars[sweep]
                t = _tables(b, c, states[sweep - 1], scalars[sweep - 1], sweep)
                back = (STRENGTH + s["d"] * state["t"][b.u]) * _root(state, s)[b.w]
                p += (np.maximum(c - s["d"] * t, 0) + back) / (STRENGTH + state["c"][b.u]) / KEEP
            n, v, counts = scalars[BURN]["n"], scalars[BURN]["v"], states[BURN]["c"]
            starts = np.cumsum(b.sizes) - b.sizes
            out.append(pd.DataFrame({
                "key": pd.array(b.ids, dtype="Int64"), "held_out": b.held, "n_tokens": b.sizes, "train_tokens": n,
                "n_known": np.add.reduceat((counts > 0).astype(np.int64)[b.numbers], starts),
                "base_score": np.add.reduceat(np.log10((counts + 1) / (n + v + 1))[b.numbers], starts),
                "score": np.add.reduceat(b.of_tokens(np.log10(p)), starts)}))
        columns = [x.split(" ")[0] for x in SCORES.split(", ")]
        return pd.concat(out)[columns] if out else pd.DataFrame(columns=columns)

    return run


def _bucketed(df: DataFrame, column: str, buckets: int, name: str) -> tuple[DataFrame, str]:
    """The table written to the shared folder, bucketed by a column: later groupings by it read it without a shuffle."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, column).option("path", scratch_path(spark, name)).saveAsTable(table)
    return spark.table(table), table


def score_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = FOLDS, fold: int = FOLD) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    Learns from the documents that are not held out. ``score`` is the log10 probability of all tokens, the end included, under
    the averaged model, ``base_score`` that of add-one unigrams. Null and empty texts are their end alone; repeated rows each
    get a row; an empty table gives no rows. If nothing is held in, every word is as likely as the unknown one.
    """
    tables: list[str] = []
    try:
        return _score_corpus(docs, key, text, (folds, fold), tables)
    finally:  # the result is written; only the names of the bucketed tables are left
        for name in tables:
            docs.sparkSession.sql(f"drop table if exists {name}")


def _score_corpus(docs: DataFrame, key: str, text: str, fold_: tuple[int, int], tables: list[str]) -> DataFrame:
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a block is one row, so each task writes few files
    written, name = _bucketed(read_blocks(docs, key, text), "block", buckets, "blocks")
    tables.append(name)
    size = written.agg(F.sum("tokens").alias("tokens"), F.sum("n_words").alias("words")).first()
    shares = (-(-(size.words or 1) // WORD_SHARE), -(-(size.tokens or 1) // PAIR_SHARE))
    blocks = written.drop("tokens", "n_words")
    word_buckets = min(buckets, shares[0])
    words, name = _bucketed(blocks.mapInPandas(_words_of(shares, fold_), WORDS).repartition(word_buckets, "share"), "share", word_buckets, "words")
    tables.append(name)
    types = cut(blocks.mapInPandas(_pairs_of(shares, fold_), PAIRS).groupBy("share").applyInPandas(_count_pairs, TYPES), "types")
    seen = types.agg(F.sum("once").alias("once"), F.sum("twice").alias("twice")).first()
    none = F.lit(None).cast("binary")
    answers = types.select(F.col("block").alias("of"), "share", F.lit(-1).alias("sweep"), "c", F.col("own").alias("t"), none.alias("c0"), none.alias("t0"))
    states: dict[int, DataFrame] = {}
    scalars: dict[int, dict] = {}
    for sweep in range(BURN + KEEP + 1):
        known = answers
        if sweep:
            known = known.union(states[sweep - 1])
        sums = blocks.groupBy("block").cogroup(known.groupBy("of")).applyInPandas(_add_up(shares, fold_, sweep, scalars.get(sweep - 1)), SUMS)
        state = cut(words.groupBy("share").cogroup(sums.withColumnRenamed("share", "of_share").groupBy("of_share")).applyInPandas(_settle(sweep, scalars.get(sweep - 1)), STATE), "state")
        total = state.agg(*[F.sum(c).alias(c) for c in ("n", "v", "sum_c0", "sum_t0", "once", "twice")]).first()
        sums_ = {k: int(v or 0) for k, v in total.asDict().items()}
        discount = lambda one, two: float(np.clip(one / (one + 2 * two), 0.05, 0.95)) if one else 0.5
        # discounts are estimated from the words and pairs met once and twice
        first = scalars.get(0, {"d": discount(seen.once or 0, seen.twice or 0), "d0": discount(sums_["once"], sums_["twice"])})
        scalars[sweep] = {**sums_, "d": first["d"], "d0": first["d0"]}
        states[sweep] = state.select(F.col("block").alias("of"), "share", "sweep", "c", "t", "c0", "t0")
    for sweep in range(BURN, BURN + KEEP + 1):
        answers = answers.union(states[sweep])
    scored = cut(blocks.groupBy("block").cogroup(answers.groupBy("of")).applyInPandas(_score(shares, fold_, scalars), SCORES), "scores")
    return scored.withColumnRenamed("key", key)
