"""Language identification: averaged embeddings of hashed subwords and a linear softmax.

The model is trained by stochastic gradient descent in numpy on a bounded sample of labelled windows and
applied to whole texts. As average and linear layer commute, applying it needs one row of class scores per
bucket: a table of fixed size, whatever the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracekit.llm.common import free_name

#: Hash buckets of subwords, size of an embedding, subword lengths in characters.
BUCKETS, SIZE, LENGTHS = 1 << 16, 16, (2, 3, 4)
#: The bounded training sample: windows per language, their characters, and the most languages.
WINDOWS, WINDOW_CHARS, MOST_LANGS = 1500, 400, 500
UNKNOWN = "und"
#: Least steps of gradient descent: small samples are passed over more often.
LEAST_STEPS = 1000
#: Share of calibration windows that the rejection threshold may turn away.
REJECT_SHARE = 0.001

_SLICE = 1 << 20
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Which code points are letters."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTER


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of all texts, other than letters as 0, and where each text starts.

    Every text is between two zeros, so a subword never spans two texts.
    """
    data = [np.frombuffer(f" {x.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for x in texts]
    codes = np.concatenate(data) if data else np.zeros(0, dtype=np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
    return np.where(_letters()[codes], codes, 0).astype(np.uint32), starts


def _subwords(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and buckets of the runs of ``n`` codes that lie in one word, its two edges counted in."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    inside = codes != 0
    good = inside[:m] | inside[n - 1 : n - 1 + m]
    for k in range(1, n - 1):
        good &= inside[k : k + m]
    h = codes[:m] + np.uint32(n)
    for k in range(1, n):
        h = h * np.uint32(0x01000193) + codes[k : k + m]
    at = np.flatnonzero(good)
    h = h[at]
    h ^= h >> np.uint32(15)
    return at, ((h * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)


def average_rows(texts: list[str], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the bucket rows over all subwords of each text, and how many there are.

    Texts are concatenated up to a slice of characters; a longer text is walked slice by slice, whole.
    """
    sums, counts = np.zeros((len(texts), rows.shape[1])), np.zeros(len(texts), dtype=np.int64)
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) <= _SLICE):
            size += len(texts[last])
            last += 1
        codes, starts = _codes(texts[first:last])
        for low in range(0, len(codes), _SLICE):
            for n in LENGTHS:
                at, bucket = _subwords(codes[low : low + _SLICE + n - 1], n)
                if not len(at):
                    continue
                cuts = np.searchsorted(at, starts[:-1] - low)
                ends = np.searchsorted(at, starts[1:] - low)
                some = np.flatnonzero(ends > cuts)
                sums[first + some] += np.add.reduceat(rows[bucket], cuts[some], axis=0)
                counts[first + some] += (ends - cuts)[some]
        first = last
    return sums / np.maximum(counts, 1)[:, None], counts


@dataclass
class LanguageModel:
    """Class scores per bucket, divided by the calibrated temperature; ``threshold`` is the rejection level."""

    langs: list[str]
    rows: np.ndarray
    bias: np.ndarray
    threshold: float

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        mean, counts = average_rows(texts, self.rows)
        p = _softmax(mean + self.bias)
        best = p.argmax(axis=1)
        known = counts > 0
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, p[np.arange(len(p)), best], 0.0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_windows(texts: list[str], labels: list[str], epochs: int = 6, rate: float = 0.5, seed: int = 7) -> LanguageModel:
    """Train on windows of text; every fifth one is held back to calibrate temperature and rejection."""
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    if not langs:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 0.0)
    y = np.array([langs.index(x) for x in labels])
    bags = []
    for text in texts:
        codes, _ = _codes([text])
        bags.append(np.concatenate([_subwords(codes, n)[1] for n in LENGTHS]))
    usable = np.array([i for i in rng.permutation(len(bags)) if len(bags[i])], dtype=np.int64)
    held, train = usable[::5], np.array([i for k, i in enumerate(usable) if k % 5], dtype=np.int64)
    table = rng.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32)
    weight = rng.normal(0, 0.1, (SIZE, len(langs))).astype(np.float32)
    bias = np.zeros(len(langs), dtype=np.float32)
    batches = (len(train) + 31) // 32
    epochs = max(epochs, -(-LEAST_STEPS // max(1, batches)))
    step, steps = 0, max(1, epochs * batches)
    for _ in range(epochs):
        rng.shuffle(train)
        for low in range(0, len(train), 32):
            part = train[low : low + 32]
            bag = np.concatenate([bags[i] for i in part])
            sizes = np.array([len(bags[i]) for i in part])
            mean = np.add.reduceat(table[bag], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0) / sizes[:, None]
            error = _softmax(mean @ weight + bias)
            error[np.arange(len(part)), y[part]] -= 1
            speed = rate * (1 - step / steps)
            back = error @ weight.T
            weight -= speed * (mean.T @ error) / len(part)
            bias -= speed * error.mean(axis=0)
            # a subword's step is its share of the window; scaled by the window so that rare subwords move too
            np.subtract.at(table, bag, (speed * np.repeat(back * (32.0 / sizes[:, None]), sizes, axis=0)).astype(np.float32))
            step += 1
    rows = table @ weight
    if len(held):
        z = np.stack([rows[bags[i]].mean(axis=0) for i in held]) + bias
        grid = np.geomspace(0.1, 10, 41)
        loss = [-np.log(_softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in grid]
        best = grid[int(np.argmin(loss))]
        top = _softmax(z / best).max(axis=1)
        # short windows are less sure than whole texts: only a text near the level of guessing is turned away
        threshold = min(1.5 / max(3, len(langs)), float(np.quantile(top, REJECT_SHARE)))
    else:
        best, threshold = 1.0, 0.0
    return LanguageModel(langs, (rows / best).astype(np.float32), bias / best, threshold)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key: str = "doc_id") -> LanguageModel:
    """Train on at most ``WINDOWS`` windows of ``WINDOW_CHARS`` characters per language.

    Which documents give a window, and where in the text it starts, follow from a hash of key and text,
    so the sample is the same on every run. Rows without text or language teach nothing; more than
    ``MOST_LANGS`` languages are an error, as the column then holds something else.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"),
                       F.xxhash64(F.col(key).cast("string"), text_col).alias("draw"))
    rows = rows.where("text is not null and lang is not null and text rlike '\\\\p{L}'")
    counts = rows.groupBy("lang").count().limit(MOST_LANGS + 1).collect()
    if len(counts) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} values in {lang_col}")
    if not counts:
        return fit_windows([], [])
    # only rows whose draw can be among the smallest are ranked: three times the wanted number is expected to
    # pass, and far fewer rows of a language than that pass only where it has few
    cut_off = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 3.0 * WINDOWS / r["count"]))])
    rows = rows.where(F.col("draw") / F.lit(2.0**64) + 0.5 <= cut_off[F.col("lang")])
    start = F.expr(f"cast(pmod(draw, greatest(char_length(text) - {WINDOW_CHARS}, 0) + 1) as int) + 1")
    windows = rows.select("lang", "draw", F.col("text").substr(start, F.lit(WINDOW_CHARS)).alias("part"))
    order = Window.partitionBy("lang").orderBy("draw", "part")
    picked = windows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= WINDOWS)
    sample = sorted((r.lang, r.draw, r.part) for r in picked.select("lang", "draw", "part").collect())
    return fit_windows([x[2] for x in sample], [x[0] for x in sample])


def training_rows(docs: DataFrame, key: str = "doc_id", folds: int = 5) -> DataFrame:
    """All rows but those whose crc32 of the key as text is 0 modulo ``folds``."""
    return docs.where(~held_out(key, folds))


def held_out(key: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    """Whether a row is in the held-out fold; a null key is held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(True))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Every row with ``lang_pred``, ``lang_score`` (0 to 1) and ``lang_rejected``; one pass, no shuffle.

    Reads the whole text and nothing else. Null, empty and letterless texts are ``und`` with score 0 and
    rejected, as is any score below the calibrated threshold. Columns with those names stay and the new
    ones get underscores.
    """
    pred, score, rejected = (free_name(docs, c) for c in ("lang_pred", "lang_score", "lang_rejected"))
    shared, threshold = docs.sparkSession.sparkContext.broadcast(model), float(model.threshold)

    @F.pandas_udf(T.StructType([T.StructField("pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def apply(texts: pd.Series) -> pd.DataFrame:
        names, p = shared.value.predict([x or "" for x in texts])
        return pd.DataFrame({"pred": names, "score": p})

    found = free_name(docs, "found")
    out = docs.withColumn(found, apply(text_col))
    out = out.withColumn(pred, F.col(f"{found}.pred")).withColumn(score, F.col(f"{found}.score")).drop(found)
    return out.withColumn(rejected, (F.col(pred) == UNKNOWN) | (F.col(score) < threshold))
