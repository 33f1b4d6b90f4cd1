"""Byte-pair encoding and decoding with a published word vocabulary.

Each distinct word is merged once: its parts stand in a contiguous array beside the ranks of
neighbouring parts; the smallest rank is found by a scan, that boundary is deleted and the two
neighbouring ranks are looked up anew. Words of more than ``SCAN`` parts go through a heap of the same
ranks, which gives the same merges without the quadratic scan.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tracekit.llm.common import free_name

#: Parts up to which a word is merged by scanning.
SCAN = 128
#: Words that a worker remembers at once in each of two generations; it only saves time.
REMEMBERED = 150_000
#: Bytes of texts or ids that a worker converts at once.
PART_BYTES = 1 << 20

_NONE = 1 << 60


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable letter of each byte: itself where it is visible, else the next code point from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class _Memory(dict):
    """Word to ids; on a miss asks the older generation, then merges the word."""

    def __init__(self, merge):
        super().__init__()
        self.merge, self.older = merge, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(word) or self.merge(word)
        if len(word) <= 64:
            self[word] = ids
        return ids


class WordBpe:
    """Reads a tokenizer file of the kind: NFC, lower case, split by a pattern, bytes, merges with word ends."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.end = model["end_of_word_suffix"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(split).findall
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = token_strings(spec)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        letters = byte_letters()
        self.inner = [vocab[x] for x in letters]
        self.last = [vocab[x + self.end] for x in letters]
        self.memory = _Memory(self.merge)

    def merge(self, word: str) -> tuple[int, ...]:
        raw = word.encode("utf-8", "surrogatepass")
        inner = self.inner
        parts = [inner[b] for b in raw]
        parts[-1] = self.last[raw[-1]]
        return tuple(self._heap(parts) if len(parts) > SCAN else self._scan(parts))

    def _scan(self, parts: list[int]) -> list[int]:
        rank_of, made = self.ranks.get, self.made
        ranks = [rank_of(pair, _NONE) for pair in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == _NONE:
                break
            i = ranks.index(best)
            parts[i] = made[best]
            del parts[i + 1]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of((parts[i], parts[i + 1]), _NONE)
            if i:
                ranks[i - 1] = rank_of((parts[i - 1], parts[i]), _NONE)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        rank_of, made, n = self.ranks.get, self.made, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank_of((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = made[rank], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n and (r := rank_of((parts[left], parts[after[left]]))) is not None:
                    heapq.heappush(heap, (r, left, parts[left], parts[after[left]]))
        return [p for p in parts if p >= 0]

    def _plain(self, text: str) -> Iterator[int]:
        # lower case goes by single characters, so a capital sigma never takes its word-final form
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return chain.from_iterable(map(self.memory.__getitem__, self.find(text)))

    def encode(self, text: str) -> array:
        """Ids of the whole text; the strings of special tokens stand for themselves."""
        if self.cut is None or not any(s in text for s in self.special):
            return array("i", self._plain(text))
        ids = array("i")
        for piece in self.cut(text):
            ids.extend([self.special[piece]] if piece in self.special else self._plain(piece))
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        """Token strings joined by one space: the file names no decoder that would do more."""
        return join_tokens(self.tokens, ids)


def token_strings(spec: dict) -> list[str]:
    """The string of each id, the empty one where the file has no token."""
    vocab, special = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = [""] * (max([*vocab.values(), *special.values()]) + 1)
    for token, i in chain(vocab.items(), special.items()):
        tokens[i] = token
    return tokens


def join_tokens(tokens: list[str], ids: Iterable[int]) -> str:
    return " ".join(map(tokens.__getitem__, ids))


_LOADED: dict[str, tuple[int, object]] = {}


def _loaded(spec, make):
    """What ``make`` reads from the file, one per worker process, so words stay remembered between tasks."""
    text = spec.value
    if _LOADED.get(make.__name__, (None,))[0] != (key := hash(text)):
        _LOADED[make.__name__] = key, make(text)
    return _LOADED[make.__name__][1]


def _strings(text: str) -> list[str]:
    """All that decoding needs; the merges of a whole tokenizer take ten times as much memory."""
    return token_strings(json.loads(text))


def _shared(df: DataFrame, path: str | None):
    with open(path or default_path(), encoding="utf-8") as f:  # the vocabulary file: fixed size, on the driver
        return df.sparkSession.sparkContext.broadcast(f.read())


def _parts(batch: pa.RecordBatch, sizes: pa.Array) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at least a row and, beyond that, about ``PART_BYTES``."""
    before = np.concatenate([[0], np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(before, before[low] + PART_BYTES, side="right")) - 1)
        yield batch.slice(low, high - low)
        low = high


def _with_column(df: DataFrame, name: str, kind: T.DataType, sizes, convert) -> DataFrame:
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])

    def run(batches):
        for batch in batches:
            for part in _parts(batch, sizes(batch)):
                yield pa.RecordBatch.from_arrays([*part.columns, convert(part)], [*part.schema.names, name])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, text_col: str = "text", out_col: str = "ids", path: str | None = None) -> DataFrame:
    """Every row with the ids of its whole text; one pass, no shuffle.

    Null and empty texts give an empty list. Columns that are there already stay; if ``out_col`` is
    taken, underscores are added to it. Repeated rows stay repeated.
    """
    out_col, spec, at = free_name(df, out_col), _shared(df, path), df.columns.index(text_col)

    def convert(batch):
        bpe = _loaded(spec, WordBpe)
        lists = [bpe.encode(x) if x else array("i") for x in batch.column(at).to_pylist()]
        offsets = np.zeros(len(lists) + 1, dtype=np.int32)
        np.cumsum([len(x) for x in lists], out=offsets[1:])
        flat = np.concatenate([np.frombuffer(x, dtype=np.int32) if x else np.zeros(0, np.int32) for x in lists]) if lists else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    return _with_column(df, out_col, T.ArrayType(T.IntegerType()), lambda batch: pc.binary_length(batch.column(at)), convert)


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", path: str | None = None) -> DataFrame:
    """Every row with the text of its ids; null and empty lists give an empty text. An unknown id is an error."""
    out_col, spec, at = free_name(df, out_col), _shared(df, path), df.columns.index(ids_col)

    def convert(batch):
        tokens = _loaded(spec, _strings)
        column = batch.column(at)
        flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        texts = [join_tokens(tokens, flat[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:])]
        return pa.array(texts, pa.string())

    return _with_column(df, out_col, T.StringType(), lambda batch: pc.multiply(pc.list_value_length(batch.column(at)), 4), convert)
