"""Exact nearest neighbours without a cross join.

Identical vectors are first collapsed to one row that keeps as many of their
smallest ids as an answer can hold, so a vector held by a third of the table
costs one comparison. The distinct vectors are sorted along a space-filling
curve and cut into blocks of fixed size, each with a bounding box. Block pairs
that cannot hold a neighbour are never formed. A query block reads the others
in order of their lower bound and stops at its true k-th distances.

Wide vectors and declared metrics use a pivot index. Rows are dealt by the nearest
of some far-apart centres instead of the curve, and a block also knows its least and
largest distance to each pivot: by the triangle inequality, two blocks whose rings
around a pivot are far apart are far apart themselves. Each query block first meets
its two most promising blocks, and its true k-th distances there decide which other
pairs are formed.
``approximate`` trades exactness for buckets of random projections.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracekit.operators.ordered import arrange
from tracekit.session import cut

BLOCK_ROWS = 2048
SUPERS = 256  # least number of outer boxes per side and group
CURVE_DIMS = 8
CURVE_BITS = 7
NEAR_QUERIES = 64  # query blocks that share one copy of their group's outer boxes
PIVOTS = 32  # rings that a block keeps
CENTRES = 256  # most cells by which wide vectors are dealt
CELL_BLOCKS = 2  # least number of full blocks to a cell, on average
SAMPLE_VALUES = 1 << 20  # values of the vectors among which centres are looked for
MET_FIRST = 2  # blocks that give a query block its first true distances
TILE_ROWS = 32  # query rows whose distances to a full block are summed at once, in cache
SETS = 64  # query sets, until each holds SET_VALUES
SET_VALUES = 1 << 21  # values of the query blocks that share one copy of a reference block
PRODUCT_TILES = 16  # tiles of query rows that one matrix product bounds
LOOSE = 0.2  # share of pairs that bounds leave, above which estimates are cheaper
EXACT_PAIRS = 1 << 12  # pairs whose distances are summed at once, in cache
# |u| >= WAVE_LEVEL - sum of a cos(w u) for every u, by 0.08 less on average where u is normal
WAVE_LEVEL, WAVES = 1.0848, ((0.954671, 1.388849), (0.130246, 4.015395))
SLACK = 1e-12  # rounding of distances to pivots, relative to them


class Metric:
    """A function of two numpy matrices (all rows to all rows) that is declared to be a metric.

    It must be symmetric and obey the triangle inequality, which is what pivots prune by; a plain function
    may be anything, so all block pairs are compared then.
    """

    def __init__(self, distances):
        self.distances = distances

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.distances(a, b)


def _gap(metric, qlo, qhi, rlo, rhi, rings: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) distance between one box and many boxes, whose last ``rings`` sides are distances to pivots."""
    cut_at = qlo.shape[-1] - rings
    if cut_at:
        (a, b), (c, d) = ([x[..., :cut_at] for x in side] for side in ((qlo, qhi), (rlo, rhi)))
        low = np.maximum(0.0, np.maximum(a - d, c - b))
        high = np.maximum(np.abs(b - c), np.abs(d - a))
        if metric == "l1":
            low, high = low.sum(axis=-1), high.sum(axis=-1)
        else:
            low, high = np.sqrt((low * low).sum(axis=-1)), np.sqrt((high * high).sum(axis=-1))
    else:
        low, high = 0.0, np.inf
    if rings:
        (a, b), (c, d) = ([x[..., cut_at:] for x in side] for side in ((qlo, qhi), (rlo, rhi)))
        apart = (np.maximum(a - d, c - b) - SLACK * (b + d)).max(axis=-1)
        low = np.maximum(low, apart)
        high = np.minimum(high, ((b + d) * (1 + SLACK)).min(axis=-1))
    return low, high


def far_apart(metric, rows: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` different rows, each the farthest from those before it; the first is the farthest from the first row."""
    if not len(rows):
        return rows
    chosen = [int(_distances(metric, rows[:1], rows)[0].argmax())]
    near = _distances(metric, rows[chosen[:1]], rows)[0]
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(metric, rows[chosen[-1:]], rows)[0])
    return rows[chosen]


def _tile(columns: int) -> int:
    return TILE_ROWS * max(1, BLOCK_ROWS // max(columns, 1))


def _distances(metric, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a to all rows of b, summed dimension by dimension, a few rows of a at a time."""
    out = np.zeros((len(a), len(b)))
    b = np.asfortranarray(b)
    step = _tile(len(b))
    held = np.empty((min(step, len(a)), len(b)))
    for at in range(0, len(a), step):
        rows, sums = a[at : at + step], out[at : at + step]
        if callable(metric):
            sums[:] = metric(rows, b)
            continue
        d = held[: len(rows)]
        for j in range(a.shape[1]):
            np.subtract(rows[:, j, None], b[None, :, j], out=d)
            np.abs(d, out=d) if metric == "l1" else np.multiply(d, d, out=d)
            sums += d
        if metric != "l1":
            np.sqrt(sums, out=sums)
    return out


def _smallest(dist: np.ndarray, take: int) -> np.ndarray:
    """Columns of the ``take`` smallest values per row in order; of equal ones those further left."""
    part = np.sort(np.argpartition(dist, take - 1, axis=1)[:, :take], axis=1)
    kth = np.take_along_axis(dist, part, axis=1).max(axis=1)
    tied = np.flatnonzero((dist <= kth[:, None]).sum(axis=1) > take)
    if len(tied):
        part[tied] = np.sort(np.argsort(dist[tied], axis=1, kind="stable")[:, :take], axis=1)
    order = np.argsort(np.take_along_axis(dist, part, axis=1), axis=1, kind="stable")
    return np.take_along_axis(part, order, axis=1)


def _closest(metric, q: np.ndarray, b: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray]:
    """(columns, distances) of the ``take`` closest rows of b for each row of q, equal ones by column.

    Distances of wide vectors are first estimated, Euclidean ones by one matrix product; every row
    that the rounding error could hide among the closest is then computed exactly. The
    exact sums run in one order wherever they are made, so ties stay ties.
    """
    if metric == "l2" and q.shape[1] > 4:
        centre = b.mean(axis=0)
        qc, bc = q - centre, b - centre
        qn, bn = (qc * qc).sum(axis=1), (bc * bc).sum(axis=1)
        guess = qn[:, None] + bn[None, :] - 2.0 * (qc @ bc.T)
        error = 1e-14 * q.shape[1] * (qn.max() + bn.max())
        dist = _first_exact(metric, q, b, take, guess, error)
    elif metric == "l1" and q.shape[1] > CURVE_DIMS and np.isfinite((sums := _sums(q, b))[1]):
        estimate, error = sums
        guess = np.concatenate([estimate(slice(at, at + _tile(len(b)))) for at in range(0, len(q), _tile(len(b)))])
        dist = _first_exact(metric, q, b, take, guess, error)
    else:
        dist = _distances(metric, q, b)
    best = _smallest(dist, take)
    return best, np.take_along_axis(dist, best, axis=1)


def _first_exact(metric, q: np.ndarray, b: np.ndarray, take: int, guess: np.ndarray, error: float) -> np.ndarray:
    """Distances of the pairs that may be among the ``take`` closest of a row by estimates off by ``error`` at most, else infinite."""
    limit = np.partition(guess, take - 1, axis=1)[:, take - 1] + 2 * error
    rows, cols = np.nonzero(guess <= limit[:, None])
    dist = np.full(guess.shape, np.inf)
    dist[rows, cols] = _exact(metric, q, b, rows, cols)
    return dist


def _exact(metric, q: np.ndarray, b: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Distances of pairs of rows, summed in the order of ``_distances``."""
    out = np.empty(len(rows))
    for at in range(0, len(rows), EXACT_PAIRS):
        part = slice(at, at + EXACT_PAIRS)
        d = q[rows[part]] - b[cols[part]]
        # sums along the first axis are made one after the other
        d = np.ascontiguousarray(d.T)
        np.add.reduce(np.abs(d, out=d) if metric == "l1" else np.multiply(d, d, out=d), axis=0, out=out[part])
    return out if metric == "l1" else np.sqrt(out, out=out)


def _rounding(q: np.ndarray, b: np.ndarray) -> tuple[type, float]:
    """The precision in which L1 distances are estimated, and what an estimate may be off by."""
    at_most = max(np.abs(q).max(initial=0.0), np.abs(b).max(initial=0.0))
    # single precision holds it if no sum can overflow; each of the terms and sums rounds
    kind = np.float32 if at_most * q.shape[1] < 1e37 else np.float64
    return kind, 4.0 * float(np.finfo(kind).eps) * (q.shape[1] + 2) ** 2 * at_most + 1e-30


def _sifted(q: np.ndarray, b: np.ndarray, limit: np.ndarray):
    """Of pairs of rows those that may be within the limit in L1, by estimates off by rounding only."""
    kind, error = _rounding(q, b)
    near, far, one, reach = q.astype(kind), b.astype(kind), np.ones(q.shape[1], dtype=kind), limit * (1 + 1e-12) + error

    def sift(rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = np.empty(len(rows), dtype=bool)
        for at in range(0, len(rows), EXACT_PAIRS):
            part = slice(at, at + EXACT_PAIRS)
            d = near[rows[part]]
            d -= far[cols[part]]
            keep[part] = np.abs(d, out=d) @ one <= reach[rows[part]]
        return rows[keep], cols[keep]

    return sift


def _sums(q: np.ndarray, b: np.ndarray):
    """Estimates of L1 distances of some rows of q to all rows of b, dimension by dimension, and what they may be off by."""
    kind, error = _rounding(q, b)
    near, far = q.astype(kind), np.asfortranarray(b, dtype=kind)

    def estimate(part: slice) -> np.ndarray:
        rows = near[part]
        sums, held = np.zeros((len(rows), len(far)), dtype=kind), np.empty((len(rows), len(far)), dtype=kind)
        for j in range(q.shape[1]):
            np.subtract(rows[:, j, None], far[None, :, j], out=held)
            np.abs(held, out=held)
            np.add(sums, held, out=sums)
        return sums

    return estimate, error


def _features(metric, q: np.ndarray, b: np.ndarray, limit: np.ndarray):
    """Single-precision matrices f, g and a number per row of q: where f @ g.T is below it, the pair is farther apart than the limit.

    Euclidean distances follow from such a product. For L1, |d| is at least ``WAVE_LEVEL`` less some cosine waves of d, and a
    cosine of a difference is a product of sines and cosines. Waves are scaled to the differences of each dimension: what
    is far from usual is bounded loosely, never wrongly. None where numbers are too large or missing.
    """
    width, eps = q.shape[1], float(np.finfo(np.float32).eps)
    centre = b.mean(axis=0)
    with np.errstate(all="ignore"):
        qc, bc = q - centre, b - centre
        if not max(np.abs(qc).max(initial=0.0), np.abs(bc).max(initial=0.0)) < 1e15:
            return None
        if metric != "l1":
            qn, bn = (qc * qc).sum(axis=1), (bc * bc).sum(axis=1)
            error = 4.0 * eps * (width + 4) * (qn.max() + bn.max()) + 1e-30
            one = np.ones((len(q), 1))
            return (np.concatenate([qc, one], axis=1).astype(np.float32), np.concatenate([bc, -bn[:, None] / 2], axis=1).astype(np.float32),
                    (qn - limit**2 * (1 + 1e-12)) / 2 - error)
        usual = np.sqrt(qc.var(axis=0) + bc.var(axis=0) + qc.mean(axis=0) ** 2)
        by = np.where(usual > 0, usual, 1.0)
        sides, steep = [], 0.0
        for x in (qc, bc):
            phase = x / by
            steep = max(steep, np.abs(phase).max(initial=0.0) * max(w for _, w in WAVES))
            phase = phase.astype(np.float32)
            out = np.empty((len(x), 2 * len(WAVES) * width), dtype=np.float32)
            for k, (a, w) in enumerate(WAVES):
                turned, height = phase * np.float32(w), np.sqrt(a * usual).astype(np.float32)
                for i, f in enumerate((np.cos, np.sin)):
                    np.multiply(f(turned), height, out=out[:, (2 * k + i) * width : (2 * k + i + 1) * width])
            sides.append(out)
        # phases, waves, products and sums round
        error = sum(a for a, _ in WAVES) * usual.sum() * eps * (8 * steep + 2 * out.shape[1] + 64) + 1e-30
        return *sides, WAVE_LEVEL * usual.sum() - limit * (1 + 1e-12) - error


def _within(metric, q: np.ndarray, b: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of q, rows of b, distances) of all pairs that are no farther apart than the limit of the row of q.

    Bounds by one matrix product rule out most pairs of wide vectors; where they leave more than a share of
    ``LOOSE`` of a run of rows, estimates rule out what is farther by more than their rounding error. The rest is
    summed exactly, in the order of ``_distances``.
    """
    found, step = [], _tile(len(b))
    if callable(metric):
        b = np.asfortranarray(b)
        for at in range(0, len(q), step):
            part = slice(at, at + step)
            dist = np.asarray(metric(q[part], b))
            rows, cols = np.nonzero(dist <= limit[part, None])
            found.append((rows + at, cols, dist[rows, cols]))
        return tuple(np.concatenate(x) for x in zip(*found))
    product = _features(metric, q, b, limit) if q.shape[1] > CURVE_DIMS else None
    sift = _sifted(q, b, limit) if product is not None and metric == "l1" else None
    guess = None
    for at in range(0, len(q), PRODUCT_TILES * step):
        run = slice(at, min(at + PRODUCT_TILES * step, len(q)))
        if product is not None:
            f, g, least = product
            near = f[run] @ g.T >= least[run, None].astype(np.float32)
            rows, cols = np.divmod(np.flatnonzero(near.ravel()), len(b))  # a matrix's nonzero takes several times as long
        if product is None or len(rows) > LOOSE * (run.stop - at) * len(b):
            guess = guess or _estimates(metric, q, b, limit)
            parts = [(x, *np.nonzero(guess(slice(x, min(x + step, run.stop))))) for x in range(at, run.stop, step)]
            rows, cols = np.concatenate([r + x for x, r, _ in parts]), np.concatenate([c for _, _, c in parts])
        else:
            rows, cols = (sift or (lambda *x: x))(rows + at, cols)
        exact = _exact(metric, q, b, rows, cols)
        keep = exact <= limit[rows]
        found.append((rows[keep], cols[keep], exact[keep]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _estimates(metric, q: np.ndarray, b: np.ndarray, limit: np.ndarray):
    """Which rows of b may be within the limits of some rows of q, by estimates off by rounding only."""
    if metric == "l1":
        estimate, error = _sums(q, b)
        return lambda part: estimate(part) <= (limit[part] * (1 + 1e-12) + error)[:, None]
    centre = b.mean(axis=0)
    qc, bc = q - centre, b - centre
    qn, bn = (qc * qc).sum(axis=1), (bc * bc).sum(axis=1)
    error = 1e-14 * q.shape[1] * (qn.max() + bn.max())
    return lambda part: qn[part, None] + bn[None, :] - 2.0 * (qc[part] @ bc.T) <= (limit[part] ** 2 * (1 + 1e-12) + 2 * error)[:, None]


def _curve(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Add ``_z``: bits of the widest dimensions interleaved."""
    stats = rows.select(F.posexplode("vec").alias("d", "x")).groupBy("d").agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.var_pop("x").alias("v"))
    top = stats.orderBy(F.desc("v"), "d").limit(CURVE_DIMS).collect()
    dims = [r["d"] for r in top]
    lo = np.array([r["lo"] for r in top])
    span = np.array([max(r["hi"] - r["lo"], 1e-300) for r in top])

    @F.pandas_udf("bigint")
    def morton(vecs: pd.Series) -> pd.Series:
        if not len(vecs):
            return pd.Series([], dtype="int64")
        x = np.stack(vecs.to_list())[:, dims]
        cell = np.clip(((x - lo) / span * (1 << CURVE_BITS)).astype(np.int64), 0, (1 << CURVE_BITS) - 1)
        code = np.zeros(len(x), dtype=np.int64)
        for bit in range(CURVE_BITS - 1, -1, -1):
            for j in range(len(dims)):
                code = (code << 1) | ((cell[:, j] >> bit) & 1)
        return pd.Series(code)

    return df.withColumn("_z", morton("vec"))


def _pivots(rows: DataFrame, metric) -> np.ndarray | None:
    """Far-apart vectors of a bounded sample of the table; none for narrow vectors, whose boxes prune better."""
    width = (rows.select(F.size("vec").alias("w")).first() or [0])[0]
    if width <= CURVE_DIMS and not isinstance(metric, Metric):
        return None
    sample = rows.select("vec").orderBy("key1", "key2").limit(max(CENTRES, SAMPLE_VALUES // max(width, 1))).collect()
    return far_apart(metric, np.array([r["vec"] for r in sample], dtype=np.float64).reshape(len(sample), -1), CENTRES)


def _cells(df: DataFrame, metric, centres: np.ndarray) -> DataFrame:
    """Add ``_z``: the cell of the nearest centre, cells of one pivot side by side, and in a cell the distance to its centre."""
    place = np.zeros(len(centres), dtype=np.int64)
    if len(centres):
        home = _distances(metric, centres, centres[:PIVOTS]).argmin(axis=1)
        place[np.argsort(home, kind="stable")] = np.arange(len(centres))

    @F.pandas_udf("bigint")
    def cell(vecs: pd.Series) -> pd.Series:
        if not len(vecs):
            return pd.Series([], dtype="int64")
        x = np.stack(vecs.to_list())
        if metric == "l2":  # the order may be off by rounding: it only decides who shares a block
            away = np.sqrt(np.maximum(0.0, (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :] - 2.0 * (x @ centres.T)))
        else:
            away = _distances(metric, x, centres)
        near = away.argmin(axis=1)
        ring = away[np.arange(len(x)), near].astype(np.float32).view(np.int32).astype(np.int64)  # orders like the float
        return pd.Series((place[near] << 32) | ring)

    return df.withColumn("_z", cell("vec"))


def _blocks(both: DataFrame, metric, block_rows: int) -> tuple[DataFrame, np.ndarray | None]:
    """The vectors in sorted order with ``vid``, their place, and ``block``, a run of places; and the pivots, if any.

    With pivots a block ends where a cell ends as well: a block across two clusters would have to look far.
    """
    pivots = _pivots(both, metric)
    if pivots is None:
        keyed, cell = _curve(both, both), F.lit(0)
    else:
        keyed = _cells(both, metric, pivots[: max(1, both.count() // (CELL_BLOCKS * block_rows))])
        cell = F.shiftright("_z", 32)
    placed = arrange(keyed, ["_z", "id0", "id1"], ["side", "grp"])
    # the sort position is a compact key for the distinct vectors; places and cells both grow along the order
    local = F.floor(F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) / block_rows) + cell
    placed = placed.withColumn("block", F.shiftleft(F.col("_bucket").cast("bigint"), 32).bitwiseOR(local)).withColumnRenamed("_at", "vid")
    return placed, None if pivots is None or not len(pivots) else pivots[:PIVOTS]


def _packer(metric, pivots: np.ndarray | None = None):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        """One row per block: its matrix, its keys in order of the reference ids, its bounding box and its rings."""
        pdf = pdf.sort_values("id1", kind="stable")
        mat = np.stack(pdf["vec"].to_list()).astype(np.float64)
        sides = mat[:, :0] if callable(metric) else mat
        if pivots is not None:
            sides = np.concatenate([sides, _distances(metric, mat, pivots)], axis=1)
        return pd.DataFrame({
            "side": [pdf["side"].iloc[0]], "grp": [pdf["grp"].iloc[0]], "block": [pdf["block"].iloc[0]],
            "vids": [pdf["vid"].to_numpy()], "first": [pdf["id1"].to_list()], "width": [mat.shape[1]],
            "mat": [mat.tobytes()], "lo": [sides.min(axis=0)], "hi": [sides.max(axis=0)], "weight": [int(pdf["n"].sum())],
        })

    return pack


PACKED = ("side int, grp string, block bigint, vids array<bigint>, first array<{}>, width int, mat binary, "
          "lo array<double>, hi array<double>, weight bigint")


def _candidates(metric, need: int, rings: int):
    """Per query block: outer reference boxes that may hold a neighbour, and the bound that says so."""

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                d = len(r.qlo)
                lo = np.frombuffer(r.slo, dtype=np.float64).reshape(-1, d)
                hi = np.frombuffer(r.shi, dtype=np.float64).reshape(-1, d)
                low, high = _gap(metric, np.asarray(r.qlo), np.asarray(r.qhi), lo, hi, rings)
                weight = np.asarray(r.sweight)
                order = np.argsort(high, kind="stable")
                enough = np.cumsum(weight[order]) >= need
                tau = high[order][np.argmax(enough)] if enough.any() else np.inf
                for i in np.nonzero(low <= tau)[0]:
                    out.append((r.grp, r.qblock, r.qlo, r.qhi, int(r.sids[i]), float(tau)))
            if out:
                yield pd.DataFrame(out, columns=["grp", "qblock", "qlo", "qhi", "sup", "tau"])

    return run


def _pair_bounds(metric, rings: int):
    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            low, high = _gap(metric, np.stack(pdf["qlo"]), np.stack(pdf["qhi"]), np.stack(pdf["lo"]), np.stack(pdf["hi"]), rings)
            keep = pdf.assign(low=low, high=high)[["grp", "qblock", "rblock", "weight", "tau", "low", "high"]]
            yield keep[keep["low"] <= keep["tau"]]

    return run


FOUND = "qvid bigint, rvid bigint, distance double"


def _unpacked(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The matrix, the reference ids and the vector ids of a packed block."""
    first = np.asarray(r.first)
    return np.frombuffer(r.mat, dtype=np.float64).reshape(-1, r.width), first.astype(str) if first.dtype == object else first, np.asarray(r.vids)


class _Running:
    """A query block and the closest distinct vectors that it has met."""

    def __init__(self, metric, take: int, r):
        self.metric, self.take, self.vids = metric, take, np.asarray(r.vids)
        self.grp, self.qblock = getattr(r, "grp", None), getattr(r, "qblock", None)
        self.q = np.frombuffer(r.mat, dtype=np.float64).reshape(-1, r.width)
        self.dist = self.first = self.rvids = None
        self.blocks = 0

    def meet(self, r) -> None:
        self.compare(*_unpacked(r), r.low)

    def compare(self, b: np.ndarray, first: np.ndarray, rvids: np.ndarray, low: float) -> None:
        """Meet a block that is at least ``low`` away: a matrix with its reference ids, in their order, and vector ids."""
        if self.dist is not None and self.dist.shape[1] == self.take:
            # a lower bound and a distance are rounded differently: a hair of slack keeps ties in
            open_rows = np.flatnonzero(low * (1 - 1e-9) <= self.dist[:, -1])
            if len(open_rows):
                self.blocks += 1
                self._improve(open_rows, b, first, rvids)
            return
        self.blocks += 1
        part, near = _closest(self.metric, self.q, b, min(self.take, len(b)))
        first, rvids = first[part], rvids[part]
        if self.dist is not None:
            near, first, rvids = (np.concatenate(x, axis=1) for x in ((self.dist, near), (self.first, first), (self.rvids, rvids)))
            order = np.lexsort((first, near), axis=1)[:, : self.take]
            near, first, rvids = (np.take_along_axis(x, order, axis=1) for x in (near, first, rvids))
        self.dist, self.first, self.rvids = near, first, rvids

    def _improve(self, open_rows: np.ndarray, b: np.ndarray, first: np.ndarray, rvids: np.ndarray) -> None:
        """Only pairs within a row's distances so far can change its answer."""
        rows, cols, near = _within(self.metric, self.q[open_rows], b, self.dist[open_rows, -1])
        if not len(rows):
            return
        rows = open_rows[rows]
        touched = np.unique(rows)
        owner = np.concatenate([np.repeat(touched, self.take), rows])
        near = np.concatenate([self.dist[touched].ravel(), near])
        first = np.concatenate([self.first[touched].ravel(), first[cols]])
        rvids = np.concatenate([self.rvids[touched].ravel(), rvids[cols]])
        order = np.lexsort((first, near, owner))
        starts = np.searchsorted(owner[order], touched)
        best = order[starts[:, None] + np.arange(self.take)[None, :]]
        if first.dtype.kind == "U" and first.dtype.itemsize > self.first.dtype.itemsize:
            self.first = self.first.astype(first.dtype)
        self.dist[touched], self.first[touched], self.rvids[touched] = near[best], first[best], rvids[best]

    def rows(self) -> pd.DataFrame:
        return pd.DataFrame({"qvid": np.repeat(self.vids, self.dist.shape[1]), "rvid": self.rvids.ravel(), "distance": self.dist.ravel()})

    def reach(self) -> pd.DataFrame:
        """How far the block has to look, if the blocks it met hold enough rows."""
        return pd.DataFrame({"grp": [self.grp], "qblock": [self.qblock], "reach": [float(self.dist[:, -1].max())]})


def _stream(metric, take: int, result=_Running.rows):
    """Rows of a set of query blocks: first those blocks, then the reference blocks that any of them wants, by lower bound."""

    def run(batches):
        now, asking = None, {}
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.low < 0:
                    if (r.grp, r.qset) != now:
                        yield from (result(x) for x in asking.values() if x.blocks)
                        now, asking = (r.grp, r.qset), {}
                    asking[r.qblock] = _Running(metric, take, r)
                else:
                    block = _unpacked(r)
                    for qblock, low in zip(r.wanted_by, r.lows):
                        asking[qblock].compare(*block, low)
        yield from (result(x) for x in asking.values() if x.blocks)

    return run


def _laid(blocks: DataFrame, pairs: DataFrame, need: int) -> DataFrame:
    """Sets of query blocks, each set followed by the reference blocks that any of them is paired with, by lower bound.

    A set is a run of blocks with up to ``SET_VALUES`` values, which one task holds: a reference block is sent once to each
    set. There are about ``SETS`` sets until they are full, so what is sent grows with the references, not with the pairs.
    """
    asked = blocks.where("side = 0")
    n, width = asked.agg(F.sum(F.size("vids")), F.max("width")).first()
    most = max(BLOCK_ROWS, SET_VALUES // max(width or 1, 4 * need))
    rows = min(most, max(BLOCK_ROWS, math.ceil((n or 0) / SETS)))
    # the place of a block's first row: sets are runs of the sorted order, so that their blocks want the same ones
    place = F.array_min("vids")
    qset = F.shiftleft(F.shiftright(place, 33), 33).bitwiseOR(F.floor(place.bitwiseAND(F.lit((1 << 33) - 1)) / F.lit(rows)))
    asked = asked.withColumnRenamed("block", "qblock").withColumn("qset", qset)
    wanted = pairs.join(asked.select("grp", "qblock", "qset"), ["grp", "qblock"]).groupBy("grp", "qset", "rblock").agg(
        F.min("low").alias("low"), F.array_sort(F.collect_list(F.struct("low", "qblock"))).alias("by"))
    wanted = wanted.select("grp", "qset", "rblock", "low", F.col("by.qblock").alias("wanted_by"), F.col("by.low").alias("lows"))
    wanted = wanted.join(blocks.where("side = 1").withColumnRenamed("block", "rblock"), ["grp", "rblock"])
    wanted = wanted.withColumn("qblock", F.lit(None).cast("bigint"))
    none = {c: F.lit(None).cast(t) for c, t in (("wanted_by", "array<bigint>"), ("lows", "array<double>"))}
    asked = asked.withColumns({"low": F.lit(-1.0), **none})
    columns = ["grp", "qset", "qblock", "low", "wanted_by", "lows", "vids", "first", "width", "mat"]
    # a number of tasks: adaptive execution goes by bytes, but work goes by pairs
    tasks = min(4 * SETS, 2 * math.ceil((n or 0) / rows) + 1)
    return asked.select(columns).unionByName(wanted.select(columns)).repartition(tasks, "grp", "qset").sortWithinPartitions("grp", "qset", "low")


def _vector_key(vec: str = "vec") -> list[Column]:
    """Two hashes of a vector, 96 bits: joins and groups by them never carry the vector."""
    return [F.xxhash64(vec).alias("key1"), F.hash(vec).alias("key2")]


def _distinct_sides(queries: DataFrame, refs: DataFrame, need: int, group: str | None):
    """Both tables with vector keys, and one row per distinct vector: references with their smallest ids."""
    grp = F.col(group).cast("string") if group else F.lit("")
    # adding zero turns -0.0 into 0.0, which is the same place
    vec = F.transform(F.col("vec").cast("array<double>"), lambda x: x + F.lit(0.0)).alias("vec")
    sides = [d.select("id", vec, grp.alias("grp")).select("*", *_vector_key()) for d in (queries, refs)]
    keys = ["grp", "key1", "key2"]
    q = sides[0].groupBy(*keys).agg(F.first("vec").alias("vec"), F.min("id").alias("id0"))
    # the limit is applied before the shuffle as well
    top = sides[1].withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).where(F.col("_n") <= need)
    r = top.groupBy(*keys).agg(F.first("vec").alias("vec"), F.sort_array(F.collect_list("id")).alias("ids"))
    return sides, q, r


def _answers(found: DataFrame, ids: DataFrame, need: int) -> DataFrame:
    """(qvid, near): up to ``need`` structs (distance, ref_id) of each query vector in order."""
    rows = found.join(ids, "rvid").select("qvid", "distance", F.explode("ids").alias("ref_id"))
    best = Window.partitionBy("qvid").orderBy("distance", "ref_id")
    top = rows.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= need)
    return top.groupBy("qvid").agg(F.array_sort(F.collect_list(F.struct("distance", "ref_id"))).alias("near"))


def _ranked(side: DataFrame, per_vector: DataFrame, k: int, exclude_self: bool, group: str | None) -> DataFrame:
    """Every query row with the first ``k`` answers of its vector, its own id left out if asked."""
    out = side.select("id", "grp", "key1", "key2").join(per_vector, ["grp", "key1", "key2"])
    near = F.filter("near", lambda x: x["ref_id"] != F.col("id")) if exclude_self else F.col("near")
    out = out.select("id", "grp", F.posexplode(F.slice(near, 1, k)).alias("_p", "_x"))
    return out.select(*([F.col("grp").alias(group)] if group else []), "id", (F.col("_p") + 1).alias("rank"),
                      F.col("_x.ref_id").alias("ref_id"), F.col("_x.distance").alias("distance"))


def nearest(
    queries: DataFrame,
    refs: DataFrame,
    k: int = 1,
    metric="l2",
    exclude_self: bool = False,
    group: str | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """([group,] id, rank, ref_id, distance) for rows (id, vec[, group]); ranks 1..k by distance, ties by ref_id.

    ``metric`` is "l1", "l2", a ``Metric`` (pruned by pivots) or any function of two numpy matrices (then nothing
    is pruned). With ``exclude_self`` both sides are the same table and a row is not
    its own neighbour, but an identical other row is. ``group`` restricts
    neighbours to the same group.
    """
    need = k + int(exclude_self)
    sides, q, r = _distinct_sides(queries, refs, need, group)
    types = {f"id{i}": d.schema["id"].dataType for i, d in enumerate((queries, refs))}
    none = lambda t: F.lit(None).cast(t)
    columns = ["side", "grp", "key1", "key2", "vec", "id0", "id1", "ids", "n"]
    both = q.select(F.lit(0).alias("side"), "grp", "key1", "key2", "vec", "id0", none(types["id1"]).alias("id1"),
                    none(r.schema["ids"].dataType).alias("ids"), F.lit(1).alias("n")).select(columns)
    both = both.unionByName(r.select(F.lit(1).alias("side"), "grp", "key1", "key2", "vec", none(types["id0"]).alias("id0"),
                                     F.col("ids")[0].alias("id1"), "ids", F.size("ids").alias("n")))
    placed, pivots = _blocks(cut(both, "vectors"), metric, block_rows)

    # dates and decimals are compared as the text that sorts like them
    plain = types["id1"].simpleString() in ("tinyint", "smallint", "int", "bigint", "double", "float", "string")
    ordered = placed.select("side", "grp", "block", "vid", "vec", "n", F.col("id1") if plain else F.col("id1").cast("string").alias("id1"))
    schema = PACKED.format(ordered.schema["id1"].dataType.simpleString())
    packed = cut(ordered.groupBy("side", "grp", "block").applyInPandas(_packer(metric, pivots), schema), "blocks")
    pairs = _prune(packed, None if callable(metric) and not isinstance(metric, Metric) else metric, need, 0 if pivots is None else len(pivots))
    blocks = packed.select("side", "grp", "block", "vids", "first", "width", "mat")
    found = _laid(blocks, pairs, need).mapInPandas(_stream(metric, need), FOUND)
    per_vector = _answers(found, placed.where("side = 1").select(F.col("vid").alias("rvid"), "ids"), need)
    keys = placed.where("side = 0").select(F.col("vid").alias("qvid"), "grp", "key1", "key2")
    return _ranked(sides[0], keys.join(per_vector, "qvid").drop("qvid"), k, exclude_self, group)


def _prune(packed: DataFrame, metric, need: int, rings: int = 0) -> DataFrame:
    """(grp, qblock, rblock, low): block pairs that can contribute to the ``need`` nearest rows, with their lower bound."""
    boxes = packed.select("side", "grp", "block", "lo", "hi", "weight")
    qs = boxes.where("side = 0").select("grp", F.col("block").alias("qblock"), F.col("lo").alias("qlo"), F.col("hi").alias("qhi"))
    rs = boxes.where("side = 1").drop("side")
    bucket, local = F.shiftright("block", 32), F.col("block").bitwiseAND(F.lit((1 << 32) - 1))
    n_blocks, buckets, longest = rs.agg(F.count(F.lit(1)), F.max(bucket) + 1, F.max(local) + 1).first()
    if metric is None:
        # a distance that may be anything has no bounds: every block pair of the group is needed
        return qs.select("grp", "qblock").join(rs.select("grp", F.col("block").alias("rblock")), "grp").withColumn("low", F.lit(0.0))
    # outer boxes are runs of blocks, as many as each then holds; with few blocks every block is its own
    few = (n_blocks or 0) <= SUPERS
    supers = max(SUPERS, math.isqrt(n_blocks or 0))
    rs = rs.withColumn("sup", F.col("block") if few else F.floor(
        (bucket + local / F.lit(longest)) / F.lit(buckets) * supers).cast("bigint"))

    def outer(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sup")
        groups = [(s, np.stack(g["lo"]).min(axis=0), np.stack(g["hi"]).max(axis=0), int(g["weight"].sum()))
                  for s, g in pdf.groupby("sup")]
        return pd.DataFrame({
            "grp": [pdf["grp"].iloc[0]], "sids": [np.array([g[0] for g in groups], dtype=np.int64)],
            "slo": [np.stack([g[1] for g in groups]).tobytes()], "shi": [np.stack([g[2] for g in groups]).tobytes()],
            "sweight": [np.array([g[3] for g in groups], dtype=np.int64)],
        })

    # boxes of one outer box first (spread over tasks), then the outer boxes of a group
    inner = rs.groupBy("grp", "sup").applyInPandas(
        lambda p: pd.DataFrame({
            "grp": [p["grp"].iloc[0]], "sup": [p["sup"].iloc[0]], "lo": [np.stack(p["lo"]).min(axis=0)],
            "hi": [np.stack(p["hi"]).max(axis=0)], "weight": [int(p["weight"].sum())]}),
        "grp string, sup bigint, lo array<double>, hi array<double>, weight bigint")
    tops = inner.groupBy("grp").applyInPandas(
        outer, "grp string, sids array<bigint>, slo binary, shi binary, sweight array<bigint>")
    # the only key of an ungrouped table is the empty one, so query blocks carry the number of their run
    qs = qs.withColumn("run", F.floor(F.col("qblock") / NEAR_QUERIES))
    tops = qs.select("grp", "run").distinct().join(tops, "grp")
    near = qs.join(tops, ["grp", "run"]).mapInPandas(
        _candidates(metric, need, rings),
        "grp string, qblock bigint, qlo array<double>, qhi array<double>, sup bigint, tau double")
    inside = rs.select("grp", "sup", F.col("block").alias("rblock"), "lo", "hi", "weight")
    bounded = near.join(inside, ["grp", "sup"]).mapInPandas(
        _pair_bounds(metric, rings), "grp string, qblock bigint, rblock bigint, weight bigint, tau double, low double, high double")
    bounded = cut(bounded, "pairs")
    enough = bounded.where(F.col("weight") >= need)
    tight = enough.groupBy("grp", "qblock").agg(F.min("high").alias("best"))
    limit = F.least(F.col("tau"), F.coalesce("best", F.col("tau")))
    if rings:
        order = Window.partitionBy("grp", "qblock").orderBy("high", "rblock")
        first = enough.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= MET_FIRST).select("grp", "rblock", "qblock", "low")
        first = _laid(packed.select("side", "grp", "block", "vids", "first", "width", "mat"), first, need)
        reach = first.mapInPandas(_stream(metric, need, _Running.reach), "grp string, qblock bigint, reach double")
        tight = tight.join(cut(reach, "reach"), ["grp", "qblock"], "left")
        # bounds and distances are rounded differently: a hair of slack keeps ties in
        limit = F.least(limit, F.coalesce(F.col("reach") * (1 + 1e-9), limit))
    return bounded.join(tight, ["grp", "qblock"], "left").where(F.col("low") <= limit).select("grp", "qblock", "rblock", "low")


def approximate(
    queries: DataFrame, refs: DataFrame, width: float, k: int = 1, tables: int = 8, exclude_self: bool = False, seed: int = 1,
) -> DataFrame:
    """Like ``nearest`` with "l2", but only among rows that share a bucket of random projections: some neighbours are missed.

    ``width`` is the bucket length, a few times the distances sought; more ``tables`` find more. For wide vectors, where exact
    search compares all blocks. Rows that share no bucket with any reference get no answer.
    """
    need = k + int(exclude_self)
    sides, q, r = _distinct_sides(queries, refs, need, None)
    q, r = (d.withColumn("features", array_to_vector("vec")) for d in (q, r))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=width, numHashTables=tables, seed=seed).fit(r)
    slot = F.posexplode(F.transform("hashes", lambda h: F.hash(h)))
    asked, held = (model.transform(d).select("*", slot.alias("table", "slot")) for d in (q, r))
    asked = asked.select(F.struct("key1", "key2").alias("qvid"), F.col("vec").alias("qvec"), "table", "slot")
    held = held.select(F.struct("key1", "key2").alias("rvid"), "vec", "table", "slot")
    square = F.aggregate(F.zip_with("qvec", "vec", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    met = asked.join(held, ["table", "slot"]).select("qvid", "rvid", F.sqrt(square).alias("distance")).dropDuplicates(["qvid", "rvid"])
    per_vector = _answers(met, r.select(F.struct("key1", "key2").alias("rvid"), "ids"), need)
    per_vector = per_vector.select(F.lit("").alias("grp"), "qvid.key1", "qvid.key2", "near")
    return _ranked(sides[0], per_vector, k, exclude_self, None)
