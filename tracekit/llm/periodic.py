"""Periodic stretches of words, found on the grammar that Re-Pair compresses a text to.

A text's word ids are replaced pair by pair, the most frequent pair first, until none occurs twice; what is left is
halved into a balanced tree, so that every stretch of two words or more crosses the boundary of one smallest node.
Per distinct node, the runs across its boundary are found once, on its first place in the text; they are then
moved to all places where the node is derived, and what a longer run of the same period holds is dropped.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tracekit.llm.common import free_name

#: Least number of words of a run.
LEAST = 12
#: Candidate periods that are extended at once.
BLOCK = 1 << 17


def repair(seq: list[int], symbols: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Re-Pair: rules (left, right) for the symbols from ``symbols`` on, and the sequence that remains.

    Of equally frequent pairs the one that stands for fewer words goes first, which keeps the rules flat.
    """
    n, sym, rules = len(seq), list(seq), []
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    weight: dict[int, int] = {}
    places: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i, pair in enumerate(zip(seq, seq[1:])):
        places[pair].append(i)
    heap = [(-len(at), 2, pair) for pair, at in places.items() if len(at) > 1]
    heapq.heapify(heap)
    while heap:
        _, size, pair = heapq.heappop(heap)
        a, b = pair
        valid = at = sorted({i for i in places.pop(pair) if sym[i] == a and after[i] < n and sym[after[i]] == b})
        if a == b:  # overlapping places: every other one of a chain
            alone, last = [], -1
            for i in at:
                if i != last:
                    alone.append(i)
                    last = after[i]
                else:
                    last = -1
            at = alone
        if len(at) < 2:
            continue
        if heap and (-len(at), size) > heap[0][:2]:  # some places have gone since it was queued
            places[pair] = valid
            heapq.heappush(heap, (-len(at), size, pair))
            continue
        new = symbols + len(rules)
        rules.append(pair)
        weight[new] = size
        fresh: dict[tuple[int, int], list[int]] = defaultdict(list)
        for i in at:
            j = after[i]
            k, p = after[j], before[i]
            sym[i], sym[j], after[i] = new, -1, k
            if k < n:
                before[k] = i
                fresh[new, sym[k]].append(i)
            if p >= 0:
                fresh[sym[p], new].append(p)
        for pair, at in fresh.items():
            if len(at) > 1:
                places[pair] = at
                heapq.heappush(heap, (-len(at), weight.get(pair[0], 1) + weight.get(pair[1], 1), pair))
    left, i = [], 0
    while i < n:
        left.append(sym[i])
        i = after[i]
    return rules, left


def _names(seq: np.ndarray, longest: int) -> list[np.ndarray]:
    """Per power of two up to ``longest``, a number for every stretch of that many words: equal if the stretches are."""
    names, width = [seq], 1
    while 2 * width <= longest:
        last = names[-1]
        pairs = last[:-width] * np.int64(len(seq) + 1) + last[width:]
        names.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))
        width *= 2
    return names


def _ahead(names: list[np.ndarray], x: np.ndarray, y: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many words from x and from y (x < y) on are equal, up to ``limit``."""
    got = np.zeros(len(x), dtype=np.int64)
    for k in range(len(names) - 1, -1, -1):
        name = names[k]
        ok = got + (1 << k) <= limit
        top = len(name) - 1
        ok &= name[np.minimum(x + got, top)] == name[np.minimum(y + got, top)]
        got += ok.astype(np.int64) << k
    return got


def _behind(names: list[np.ndarray], x: np.ndarray, y: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many words up to and with x and y are equal, up to ``limit``."""
    got = np.zeros(len(x), dtype=np.int64)
    for k in range(len(names) - 1, -1, -1):
        name, width = names[k], 1 << k
        ok = got + width <= limit
        ok &= name[np.maximum(x - got - width + 1, 0)] == name[np.clip(y - got - width + 1, 0, len(name) - 1)]
        got += ok.astype(np.int64) << k
    return got


def _shortest_period(start: np.ndarray, end: np.ndarray, period: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Indices of one row per (keys, start, end), that of the smallest period."""
    order = np.lexsort((period, end, start, *keys))
    same = np.ones(len(order), dtype=bool)
    for c in (start, end, *keys):
        same[1:] &= c[order][1:] == c[order][:-1]
    if len(same):
        same[0] = False
    return order[~same]


def grammar_runs(seq: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, end, period) of all runs of ``seq``, whose values are numbers below its length."""
    n = len(seq)
    rules, top = repair(seq.tolist(), n)
    lefts, rights = [a for a, _ in rules], [b for _, b in rules]
    sizes = [1] * n
    for a, b in rules:
        sizes.append(sizes[a] + sizes[b])
    while len(top) > 1:  # a balanced tree over what Re-Pair leaves
        paired = []
        for a, b in zip(top[::2], top[1::2]):
            paired.append(len(sizes))
            lefts.append(a)
            rights.append(b)
            sizes.append(sizes[a] + sizes[b])
        top = paired + top[len(top) // 2 * 2 :]
    places: dict[int, list[np.ndarray]] = {top[0]: [np.zeros(1, dtype=np.int64)]}
    names = _names(seq.astype(np.int64), n)
    found, waiting, held = [], [], 0
    derived: dict[int, np.ndarray] = {}

    def extend() -> None:
        nonlocal held
        if not waiting:
            return
        x, y, node, begin, bound, end = (np.concatenate(c) for c in zip(*waiting))
        waiting.clear()
        held = 0
        # x and y = x + period are equal words: x before the boundary and y behind it in either case
        period = y - x
        s = x + 1 - _behind(names, x, y, x + 1 - begin)
        e = y + _ahead(names, x, y, end - y)
        ok = (e - s >= np.maximum(least, 2 * period)) & (s < bound) & (e > bound)
        if ok.any():
            node, begin, s, e, period = node[ok], begin[ok], s[ok], e[ok], period[ok]
            one = _shortest_period(s, e, period, node)
            found.append((node[one], s[one] - begin[one], e[one] - begin[one], period[one]))

    for node in range(len(sizes) - 1, n - 1, -1):
        if sizes[node] < least or node not in places:
            continue
        at = np.concatenate(places.pop(node))
        derived[node] = at
        a, b = lefts[node - n], rights[node - n]
        for child, shift in ((a, 0), (b, sizes[a])):
            if sizes[child] >= least:
                places.setdefault(child, []).append(at + shift if shift else at)
        begin, half = int(at[0]), sizes[node] // 2
        bound, end = begin + sizes[a], begin + sizes[node]
        # a run across the boundary holds a whole period behind it or before it: the boundary's word comes again one period on or back
        ys = bound + np.flatnonzero(seq[bound : min(end, bound + half)] == seq[bound - 1])
        back = max(begin, bound - half)
        xs = back + np.flatnonzero(seq[back:bound] == seq[bound])
        x = np.concatenate([np.full(len(ys), bound - 1, dtype=np.int64), xs])
        if len(x):
            y = np.concatenate([ys, np.full(len(xs), bound, dtype=np.int64)])
            waiting.append((x, y, *(np.full(len(x), v, dtype=np.int64) for v in (node, begin, bound, end))))
            held += len(x)
            if held > BLOCK:
                extend()
    extend()
    if not found:
        return np.zeros((0, 3), dtype=np.int64)
    node, s, e, q = (np.concatenate(c) for c in zip(*found))
    # every run to every place of its node
    many = np.array([len(derived[v]) for v in node.tolist()], dtype=np.int64)
    shift = np.concatenate([derived[v] for v in node.tolist()])
    start, end, period = (np.repeat(c, many) for c in (s, e, q))
    start, end = start + shift, end + shift
    # the longest of each period: sorted by period and start, one that ends no later than an earlier one lies in it
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    reach = np.maximum.accumulate(period * np.int64(n + 1) + end)
    new = np.ones(len(start), dtype=bool)
    new[1:] = period[1:] * np.int64(n + 1) + end[1:] > reach[:-1]
    start, end, period = start[new], end[new], period[new]
    one = _shortest_period(start, end, period)
    return np.stack([start[one], end[one], period[one]], axis=1)


def suspects(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Disjoint stretches outside which no run can lie; empty for most texts.

    A run of period q has at least max(q, least - q) places where the word q further on is the same, so all but its
    end are sequences of least / 2 words that come again, no further on than the whole of such places is long.
    """
    w = -(-least // 2)
    if len(ids) < least:
        return []
    h = np.zeros(len(ids) - w + 1, dtype=np.uint64)
    for k in range(w):
        h = h * np.uint64(0xD6E8FEB86659FD93) + ids[k : k + len(h)].astype(np.uint64)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    again = h[order[1:]] == h[order[:-1]]
    if not again.any():
        return []
    gap = np.zeros(len(h), dtype=np.int64)
    gap[order[:-1][again]] = (order[1:] - order[:-1])[again]
    for _ in range(8):
        edge = np.flatnonzero(np.diff(gap > 0, prepend=False, append=False))
        first, size = edge[::2], edge[1::2] - edge[::2]
        far = gap > 0
        far[far] = gap[far] > np.repeat(size, size) + w - 1
        if not far.any():
            break
        gap[far] = 0
    edge = np.flatnonzero(np.diff(gap > 0, prepend=False, append=False))
    out: list[tuple[int, int]] = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        b = min(len(ids), 2 * b - a + 2 * w)
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def word_runs(words: list, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all runs of a list of words, by start, then period.

    A run is a stretch of at least ``least`` words and two periods that has this smallest period and cannot grow by a neighbouring word.
    """
    number: dict = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))
    found = []
    for a, b in suspects(ids, least):
        local = np.unique(ids[a:b], return_inverse=True)[1]
        runs = grammar_runs(local, least)
        runs[:, :2] += a
        found.append(runs)
    rows = np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    rows[:, 1] -= rows[:, 0]
    return rows


def collapse(words: list, runs: np.ndarray) -> list:
    """The words that no run contains behind its first period."""
    if not len(runs):
        return words
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def find_runs(df: DataFrame, text_col: str = "text", runs_col: str = "runs", out_col: str = "collapsed", least: int = LEAST) -> DataFrame:
    """Every row with its text's runs (array of start, length, period, by start, then period) and the text they collapse to.

    Words are what stands between ASCII white space, numbered from 0; the collapsed text is the kept words joined by one
    space. Null, empty and blank texts have no runs and an empty collapsed text. One pass, no shuffle; rows are independent, so
    repeated rows give repeated results. A text is worked on in memory: a very long one needs about
    100 bytes for each word of its repeating part, times the logarithm of that part's length. Other columns stay; names
    that are taken get underscores.
    """
    runs_col = free_name(df, runs_col)
    out_col = free_name(df, out_col)
    at = df.columns.index(text_col)
    fields = ("start", "length", "period")
    run_type = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in fields]))
    schema = T.StructType([*df.schema.fields, T.StructField(runs_col, run_type), T.StructField(out_col, T.StringType())])

    def run(batches):
        for batch in batches:
            rows, texts = [], []
            for text in batch.column(at).to_pylist():
                words = text.encode("utf-8").split() if text else []  # of bytes: ASCII white space only
                runs = word_runs(words, least)
                rows.append(runs)
                texts.append(b" ".join(collapse(words, runs)).decode("utf-8"))
            offsets = np.zeros(len(rows) + 1, dtype=np.int32)
            np.cumsum([len(r) for r in rows], out=offsets[1:])
            flat = np.concatenate([*rows, np.zeros((0, 3), dtype=np.int64)])
            values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], list(fields))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(texts, pa.string())], schema.names)

    return df.mapInArrow(run, schema)
