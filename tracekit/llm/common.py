"""Shared pieces of the text operators: free column names, whole-text columns, word and shingle hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_M64 = (1 << 64) - 1


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added until the table has no such column (in any case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def whole_text(c: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(c), F.lit(""))


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns: whatever else a table carries cannot clash with an operator's own."""
    return df.select(*[F.col(f"`{c}`").alias(c) for c in columns])


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser over uint64 values: every input bit reaches every output bit."""
    x = (x ^ np.uint64(seed * 0x632BE59BD9B4E019 & _M64)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


_POWERS = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(max(n, 1 << 16), np.uint64(_BASE))
        grown[0] = 1
        np.multiply.accumulate(grown, out=grown)
        _POWERS = grown
    return _POWERS[:n]


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of every run of bytes that are not ASCII white space.

    The hash of a word is its polynomial value, so it does not depend on where the word stands;
    lengths up to the longest word are covered by one pass per byte position over all words.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    ink = (raw != 32) & ((raw < 9) | (raw > 13))
    edge = np.flatnonzero(np.diff(ink, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return start, end, np.zeros(0, dtype=np.uint64)
    # sum of byte * base**position over blocks; the difference of two prefix sums, put back to position 0
    power = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=total[1:])
    value = (total[end] - total[start]) * _inverse_powers(len(raw))[start]
    return start, end, mix(value + (end - start).astype(np.uint64) * _WORD)


_INVERSES = np.ones(1, dtype=np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    global _INVERSES
    if len(_INVERSES) < n:
        grown = np.full(max(n, 1 << 16), np.uint64(pow(_BASE, -1, 1 << 64)))
        grown[0] = 1
        np.multiply.accumulate(grown, out=grown)
        _INVERSES = grown
    return _INVERSES[:n]


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive values; empty when there are fewer."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + len(out)]
    return mix(out, n)
