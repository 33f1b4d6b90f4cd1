"""Documents packed into sequences of a fixed number of tokens by best-fit decreasing.

Best-fit decreasing looks at lengths only, and bins with the same room left are interchangeable. So the plan is made
for numbers of pieces per length, not for pieces: a segment tree over the remaining capacities holds how many bins
are open at each and finds the tightest that fits in logarithmic time. The plan is a list of moves of a size that
depends on the capacity alone; every piece then looks its place up by its rank among the pieces of its length.
"""

from __future__ import annotations

import base64
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracekit.llm.common import free_name, plain
from tracekit.session import cut

CAPACITY = 2048
#: The token behind every document.
END = 0
#: The vocabulary's one special string and its id (fixed values of the public file).
SPECIAL = {"<|endoftext|>": 50256}


def default_path() -> str:
    """The byte-level vocabulary as ranks; the same ids as its ``tokenizers`` form, found several times faster."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_LOADED: dict = {}


def _encoding(spec):
    """One encoder per worker process."""
    import public_tokenizers
    import tiktoken

    data = spec.value
    if (key := hash(data)) not in _LOADED:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}
        _LOADED.clear()
        _LOADED[key] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return _LOADED[key]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: all but the first are full."""
    first = n - (n - 1) // capacity * capacity
    return [(0, first), *[(s, capacity) for s in range(first, n, capacity)]]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """``<id_col>, piece, start, length, ids, ids_crc32`` of every piece of every row; one pass, no shuffle.

    A row's tokens are those of its whole text and the end token. Null and empty texts are one piece that holds the
    end token. Rows with a null or repeated id stay rows of their own. ``ids_crc32`` is the checksum of the
    ids as unsigned little-endian 32-bit numbers. Other columns are not carried.
    """
    docs = plain(docs, id_col, text_col)
    with open(path or default_path(), "rb") as f:  # the vocabulary file: fixed size, on the driver
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = T.StructType([T.StructField("_id", docs.schema[0].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
                           T.StructField("length", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("ids_crc32", T.LongType())])

    def run(batches):
        bpe = _encoding(spec)
        end = np.array([END], dtype=np.uint32)
        for batch in batches:
            at, numbers, starts, lengths, checks, flat = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.concatenate([bpe.encode_to_numpy(text, allowed_special="all"), end]) if text else end
                flat.append(ids)
                for k, (start, length) in enumerate(cuts(len(ids), capacity)):
                    at.append(i)
                    numbers.append(k)
                    starts.append(start)
                    lengths.append(length)
                    checks.append(zlib.crc32(ids[start : start + length].astype("<u4").tobytes()))
            if at:
                offsets = np.zeros(len(at) + 1, dtype=np.int32)
                np.cumsum(lengths, out=offsets[1:])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), ids,
                     pa.array(checks, pa.int64())], schema.names)

    return docs.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


class OpenBins:
    """Numbers of open bins by remaining capacity, in a segment tree of sums."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.sums = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        at = room + self.leaves
        while at:
            self.sums[at] += n
            at >>= 1

    def tightest(self, wanted: int) -> int | None:
        """The smallest room of at least ``wanted`` that an open bin has."""
        at = wanted + self.leaves
        if self.sums[at]:
            return wanted
        while at > 1 and (at & 1 or not self.sums[at + 1]):  # up, until a right neighbour holds bins
            at >>= 1
        if at <= 1:
            return None
        at += 1
        while at < self.leaves:
            at = 2 * at if self.sums[2 * at] else 2 * at + 1
        return at - self.leaves


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing for ``counts`` pieces per length: rows (length, first rank, pieces per bin, first bin, offset).

    A piece of rank r among those of its length is in the last row of that length with first rank <= r; it is piece
    r - first rank of the row's run of bins. After a piece the tightest bin is the one it went into, as long as
    another of its length fits, so a bin takes all it can before the next is looked for. A length splits at
    most two runs of bins, so there are under 3 * capacity + 1 runs, and a run meets at most sqrt(2 * capacity)
    different lengths: the plan does not grow with the number of pieces.
    """
    tree, runs, moves, bins = OpenBins(capacity), [deque() for _ in range(capacity + 1)], [], 0

    def put(room: int, first: int, n: int) -> None:
        if n:
            runs[room].append((first, n))
            tree.add(room, n)

    for length in sorted(counts, reverse=True):
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit {capacity}")
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = runs[room].popleft()
                tree.add(room, -n)
            each = room // length
            full = min(n, left // each)
            if full:
                moves.append((length, rank, each, first, capacity - room))
                put(room - each * length, first, full)
            rank, left, first, n = rank + full * each, left - full * each, first + full, n - full
            if n and left:  # fewer are left than a bin would take
                moves.append((length, rank, left, first, capacity - room))
                put(room - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            put(room, first, n)
    return np.array(moves, dtype=np.int64).reshape(-1, 5)


def _numbered(table: DataFrame, slot: str, nth: str) -> DataFrame:
    """Every row with its task and its rank among the task's rows of its length."""
    at = table.columns.index("length")
    schema = T.StructType([*table.schema.fields, T.StructField(slot, T.IntegerType()), T.StructField(nth, T.LongType())])

    def run(batches):
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            lengths = batch.column(at).to_numpy(zero_copy_only=False)
            order = np.argsort(lengths, kind="stable")
            values, first, n = np.unique(lengths[order], return_index=True, return_counts=True)
            before = np.array([seen.get(v, 0) for v in values.tolist()], dtype=np.int64)
            ranks = np.empty(len(lengths), dtype=np.int64)
            ranks[order] = np.arange(len(lengths)) + np.repeat(before - first, n)
            seen.update(zip(values.tolist(), (before + n).tolist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(ranks), task, dtype=np.int32)), pa.array(ranks)], schema.names)

    return table.mapInArrow(run, schema)


def pack(table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows with a ``length`` from 1 to ``capacity``, each with the ``sequence_id`` (long) and ``offset`` (long) it gets.

    Sequences are as few as best-fit decreasing over all rows needs; rows in one lie one behind the other from 0
    without gaps. The rows are written once with their rank among their task's rows of one length; only counts
    per task and length are added up, and the driver sees one number per length. Rows of equal length are
    interchangeable, so a length that very many rows have is no hot key: ranks are counted per task. An empty
    table gives an empty one; names that are taken get underscores.
    """
    slot = free_name(table, "pack_slot")
    nth = free_name(table, "pack_nth")
    base = free_name(table, "pack_base")
    out = [free_name(table, "sequence_id"), free_name(table, "offset")]
    rows = cut(_numbered(table, slot, nth), "numbered")
    counts = cut(rows.groupBy(slot, "length").agg(F.count(F.lit(1)).alias("_n")), "lengths")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most ``capacity`` rows
    moves = plan(totals, capacity)
    before = Window.partitionBy("length").orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(slot, "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(base))
    ranked = rows.join(bases, [slot, "length"]).select(*table.columns, (F.col(base) + F.col(nth)).alias(nth))
    shared = table.sparkSession.sparkContext.broadcast(moves)
    at = table.columns.index("length")
    schema = T.StructType([*table.schema.fields, *[T.StructField(c, T.LongType()) for c in out]])

    def place(batches):
        moves = shared.value
        order = np.lexsort((moves[:, 1], moves[:, 0]))
        moves = moves[order]
        # rows of the plan by (length, first rank): one sorted key, a length's ranks are below the number of all its rows
        span = int(moves[:, 1].max(initial=0)) + 1
        keys = moves[:, 0] * span + moves[:, 1]
        for batch in batches:
            lengths = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            ranks = batch.column(len(batch.columns) - 1).to_numpy()
            move = moves[np.searchsorted(keys, lengths * span + np.minimum(ranks, span - 1), side="right") - 1]
            within = ranks - move[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(move[:, 3] + within // move[:, 2]), pa.array(move[:, 4] + within % move[:, 2] * lengths)], schema.names)

    return ranked.mapInArrow(place, schema)


def sequences(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per sequence of a packed table that carries ``ids``: the ids in order, and which piece of which document lies where.

    A group is one sequence, so it holds at most ``capacity`` rows and tokens.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", F.col(id_col), "piece", "ids")))
    joined = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return joined.select("sequence_id", F.flatten("parts.ids").alias("ids"),
                         F.transform("parts", lambda p: F.struct(p[id_col].alias(id_col), p["piece"].alias("piece"), p["offset"].alias("offset"), p["length"].alias("length"))).alias("parts"))
