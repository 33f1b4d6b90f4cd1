"""Mode-specific normalisation: a Bayesian Gaussian mixture per numeric column.

The mixture is a truncated stick-breaking one, fitted by variational updates: components that the data do not need
lose their weight and are dropped. All columns are fitted in one loop. It starts on quantiles of each column, which one scan
finds; the passes that follow run over all rows as a written table of (column, value, count) and add up three
numbers per component. Only those, and the quantiles, reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracekit.session import col, cut

MAX_COMPONENTS = 10
MIN_WEIGHT = 0.005
CLIP = 0.99
SPREAD = 4.0
CONCENTRATION = 1e-3  # prior of the stick-breaking weights: the smaller, the fewer components
QUANTILES = 1000
START_ROUNDS, ROUNDS = 3000, 30  # most updates on quantiles, and most passes over all rows
START_TOLERANCE, TOLERANCE = 1e-8, 1e-4  # change of the mean log density that ends either loop


@dataclass(frozen=True)
class Mixture:
    column: str
    weights: tuple[float, ...]
    means: tuple[float, ...]
    stds: tuple[float, ...]
    modal: tuple[float, ...] = field(default=())  # listed values with one-hot slots of their own

    @property
    def size(self) -> int:
        return len(self.weights)

    def pick(self, order: Sequence[int]) -> Mixture:
        at = lambda xs: tuple(xs[i] for i in order)
        return Mixture(self.column, at(self.weights), at(self.means), at(self.stds), self.modal)


def _digamma(x: np.ndarray) -> np.ndarray:
    shift = np.zeros_like(x)
    while (x < 8).any():
        shift = shift - np.where(x < 8, 1 / x, 0.0)
        x = np.where(x < 8, x + 1, x)
    i = 1 / (x * x)
    return shift + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i / 252))


def update(sums: np.ndarray) -> dict[str, np.ndarray]:
    """One variational update of a column in standard units: ``sums`` are the responsibilities' [3, k] weight, z and z*z.

    Priors: weights by stick breaking, means around 0 with the weight of one row, variances around 1 with one degree of freedom.
    """
    n, s1, s2 = sums
    taken, left = 1 + n, CONCENTRATION + np.append(np.cumsum(n[::-1])[::-1][1:], 0.0)
    mean = s1 / (1 + n)
    spread = 1 + s2 - (1 + n) * mean * mean  # scatter around the own mean, and of that around the prior's
    stick = taken / (taken + left)
    weight = stick * np.append(1.0, np.cumprod(1 - stick)[:-1])
    return {"taken": taken, "left": left, "n": 1 + n, "mean": mean, "spread": np.maximum(spread, 1e-12), "weight": weight / weight.sum()}


def _by_weight(sums: np.ndarray) -> np.ndarray:
    """Heavy components first, where stick breaking expects them: what is not needed fades sooner."""
    return sums[:, np.argsort(-sums[0], kind="stable")]


def coefficients(p: dict[str, np.ndarray]) -> np.ndarray:
    """[3, k]: expected log density of z in each component as a polynomial of z."""
    both = _digamma(p["taken"] + p["left"])
    rest = np.append(0.0, np.cumsum(_digamma(p["left"]) - both)[:-1])
    precision = p["n"] / p["spread"]
    level = _digamma(p["taken"]) - both + rest + 0.5 * (
        _digamma(p["n"] / 2) + math.log(2) - np.log(p["spread"]) - math.log(2 * math.pi) - 1 / p["n"])
    return np.stack([level - 0.5 * precision * p["mean"] ** 2, precision * p["mean"], -0.5 * precision])


def value_counts(df: DataFrame, columns: Sequence[str], modal: Mapping[str, Sequence[float]] | None = None) -> DataFrame:
    """(c, x, w): how often column number c holds x; nulls, NaN and listed modal values are left out."""
    cells = F.posexplode(F.array(*[_numbers(c, (modal or {}).get(c, ())) for c in columns])).alias("c", "x")
    return df.select(cells).where("x is not null").groupBy("c", "x").agg(F.count(F.lit(1)).alias("w"))


def _numbers(c: str, modal: Sequence[float] = ()) -> Column:
    x = F.col(c).cast("double")
    fit = ~F.isnan(x)
    return F.when(fit & ~x.isin([float(m) for m in modal]) if modal else fit, x)


def component_sums(counts: DataFrame, scales: Sequence[tuple[float, float]], polynomials: Sequence[np.ndarray]) -> dict[int, tuple[np.ndarray, float]]:
    """One pass over (c, x, w) for all columns: c to the [3, k] sums of responsibilities and the sum of log densities.

    ``scales`` holds mean and deviation per column number, ``polynomials`` the [3, k] coefficients; k is the same for all.
    """
    k = polynomials[0].shape[1]
    of = lambda xs: F.get(F.array(*[F.lit(float(x)) for x in xs]), F.col("c"))
    z = ((F.col("x") - of([m for m, _ in scales])) / of([s for _, s in scales])).alias("z")
    rows = counts.select("c", "w", z)
    log = [of([p[0, i] for p in polynomials]) + F.col("z") * (of([p[1, i] for p in polynomials]) + F.col("z") * of([p[2, i] for p in polynomials]))
           for i in range(k)]
    rows = rows.select("c", "w", "z", *[x.alias(f"l{i}") for i, x in enumerate(log)])
    top = F.greatest(*[F.col(f"l{i}") for i in range(k)]) if k > 1 else F.col("l0")
    rows = rows.withColumn("top", top)
    rows = rows.select("c", "w", "z", "top", *[F.exp(F.col(f"l{i}") - F.col("top")).alias(f"e{i}") for i in range(k)])
    total = sum((F.col(f"e{i}") for i in range(1, k)), F.col("e0"))
    rows = rows.withColumn("total", total).withColumn("share", F.col("w") / F.col("total"))
    weighed = [F.col("share") * F.col(f"e{i}") for i in range(k)]
    sums = [F.sum(r * m) for m in (F.lit(1.0), F.col("z"), F.col("z") * F.col("z")) for r in weighed]
    found = rows.groupBy("c").agg(F.sum(F.col("w") * (F.col("top") + F.log("total"))), *sums).collect()  # a row per column
    return {r[0]: (np.array(r[2:], dtype=float).reshape(3, k), r[1]) for r in found}


def _start(points: np.ndarray, n: float, k: int, seed: int) -> np.ndarray:
    """Coefficients after updates on equally heavy quantiles that stand for n rows; ``seed`` shifts where components begin."""
    at = (np.arange(k) + np.random.default_rng(seed).uniform(0.25, 0.75)) / k
    centres = points[(at * len(points)).astype(int)]
    share = np.zeros((len(points), k))
    share[np.arange(len(points)), np.abs(points[:, None] - centres).argmin(1)] = 1.0
    before, each = -math.inf, n / len(points)
    for _ in range(START_ROUNDS):
        heavy = share * each
        poly = coefficients(update(_by_weight(np.stack([heavy.sum(0), points @ heavy, (points**2) @ heavy]))))
        logs = poly[0] + points[:, None] * (poly[1] + points[:, None] * poly[2])
        top = logs.max(1, keepdims=True)
        share = np.exp(logs - top)
        total = share.sum(1, keepdims=True)
        share /= total
        fit = float((top + np.log(total)).mean())
        if abs(fit - before) < START_TOLERANCE:
            break
        before = fit
    return poly


def fit_mixtures(df: DataFrame, columns: Sequence[str], k: int = MAX_COMPONENTS, seed: int = 0,
                 modal: Mapping[str, Sequence[float]] | None = None) -> dict[str, Mixture]:
    """A mixture per column on all rows, in one loop; listed modal values are left out of a mixed column's fit.

    A column without numbers gets an empty mixture, one with a single value one component.
    """
    modal = modal or {}
    listed = {c: tuple(modal.get(c, ())) for c in columns}
    at = [(i + 0.5) / QUANTILES for i in range(QUANTILES)]
    per = [(F.count(x), F.avg(x), F.stddev_pop(x), F.min(x), F.max(x), F.percentile_approx(x, at, 10 * QUANTILES))
           for x in (_numbers(c, listed[c]) for c in columns)]
    row = df.agg(*[F.struct(*[e.alias(f"e{j}") for j, e in enumerate(p)]).alias(f"c{i}") for i, p in enumerate(per)]).first()
    out, open_ = {}, []
    for c, (n, mean, std, low, high, points) in zip(columns, row):
        if not n:
            out[c] = Mixture(c, (), (), (), listed[c])
        elif low == high or not std:
            out[c] = Mixture(c, (1.0,), (low,), (max(abs(low), 1.0) * 1e-3,), listed[c])
        else:
            open_.append((c, n, mean, std, np.array(points)))
    if not open_:
        return out
    names, scales = [o[0] for o in open_], [(o[2], o[3]) for o in open_]
    counts = cut(value_counts(df, names, listed), "values")
    polynomials = [_start((points - mean) / std, n, k, seed) for _, n, mean, std, points in open_]
    before = [-math.inf] * len(open_)
    for _ in range(ROUNDS):
        found = component_sums(counts, scales, polynomials)
        fitted = [update(_by_weight(found[i][0])) for i in range(len(open_))]
        polynomials = [coefficients(p) for p in fitted]
        now = [found[i][1] / o[1] for i, o in enumerate(open_)]
        if all(abs(x - y) < TOLERANCE for x, y in zip(now, before)):
            break
        before = now
    for (c, _, mean, std, _), p in zip(open_, fitted):
        parts = list(zip(p["weight"], p["mean"] * std + mean, np.sqrt(p["spread"] / p["n"]) * std))
        kept = [t for t in parts if t[0] > MIN_WEIGHT] or [max(parts)]
        out[c] = Mixture(c, *(tuple(float(v) for v in x) for x in zip(*kept)), listed[c])
    return out


def fit_mixture(df: DataFrame, c: str, k: int = MAX_COMPONENTS, seed: int = 0, modal: Sequence[float] = ()) -> Mixture:
    """``fit_mixtures`` of one column."""
    return fit_mixtures(df, [c], k, seed, {c: modal})[c]


def _scores(c: Column | str, m: Mixture) -> list[Column]:
    x = col(c).cast("double")
    return [
        F.lit(math.log(w) - math.log(s)) - (x - mu) * (x - mu) / (2 * s * s)
        for w, mu, s in zip(m.weights, m.means, m.stds)
    ]


def modal_component(c: Column | str, m: Mixture) -> Column:
    """Index of the most probable component."""
    scores = F.array(*_scores(c, m))
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def posterior(c: Column | str, m: Mixture, floor: float = 1e-6) -> Column:
    """Component probabilities, lifted by ``floor`` and renormalised."""
    scores = _scores(c, m)
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    raw = [F.exp(s - top) for s in scores]
    total = sum(raw[1:], raw[0])
    lifted = [r / total + floor for r in raw]
    return F.array(*[x / (1 + floor * len(scores)) for x in lifted])


def drawn_component(df: DataFrame, c: str, m: Mixture, u: Column, name: str) -> DataFrame:
    """Component by cumulative posterior against a uniform number."""
    p = df.withColumn("_p", posterior(c, m)).withColumn("_u", u)
    steps = F.aggregate(
        "_p",
        F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")),
        lambda a, x: F.struct((a["s"] + x).alias("s"), (a["n"] + F.when(a["s"] + x <= F.col("_u"), 1).otherwise(0)).alias("n")),
    )
    return p.withColumn(name, F.least(steps["n"], F.lit(m.size - 1))).drop("_p", "_u")


def component_counts(df: DataFrame, c: str, m: Mixture) -> DataFrame:
    return df.where(F.col(c).isNotNull()).groupBy(modal_component(c, m).alias("component")).agg(F.count(F.lit(1)).alias("n"))


def keep_modal(df: DataFrame, m: Mixture) -> Mixture:
    """Keep components that are the most probable one of at least one row."""
    used = {r["component"] for r in component_counts(df, m.column, m).collect()}
    return m.pick([i for i in range(m.size) if i in used])


def order_by_frequency(df: DataFrame, m: Mixture) -> Mixture:
    """Components from the most to the least frequent."""
    counts = {r["component"]: r["n"] for r in component_counts(df, m.column, m).collect()}
    return m.pick(sorted(range(m.size), key=lambda i: (-counts.get(i, 0), i)))


def encode(df: DataFrame, m: Mixture, component: str | None = None, prefix: str | None = None) -> DataFrame:
    """Add ``<c>_u`` (scaled offset, clipped) and ``<c>_k`` (slot; modal values come first)."""
    c = m.column
    u, k = (f"{prefix or c}_u", f"{prefix or c}_k")
    n_modal = len(m.modal)
    comp = F.col(component) if component else modal_component(c, m)
    out = df.withColumn("_k", comp)
    mean = F.get(F.array(*[F.lit(x) for x in m.means]), F.col("_k"))
    std = F.get(F.array(*[F.lit(x) for x in m.stds]), F.col("_k"))
    offset = F.least(F.greatest((F.col(c) - mean) / (SPREAD * std), F.lit(-CLIP)), F.lit(CLIP))
    if not n_modal:
        return out.withColumns({u: offset, k: F.col("_k")}).drop("_k")
    listed = F.array_position(F.array(*[F.lit(float(v)) for v in m.modal]), F.col(c).cast("double")).cast("int")
    return out.withColumns({
        u: F.when(listed > 0, F.lit(0.0)).otherwise(offset),
        k: F.when(listed > 0, listed - 1).otherwise(F.col("_k") + n_modal),
    }).drop("_k")


def slots(k: Column | str, m: Mixture) -> Column:
    """One-hot array over modal values and components."""
    return F.array(*[F.when(col(k) == i, F.lit(1.0)).otherwise(0.0) for i in range(len(m.modal) + m.size)])


def decode(u: Column | str, k: Column | str, m: Mixture) -> Column:
    """Offset and slot back to a value."""
    n_modal = len(m.modal)
    values = F.array(*[F.lit(float(v)) for v in m.modal]) if n_modal else None
    mean = F.get(F.array(*[F.lit(x) for x in m.means]), col(k) - n_modal)
    std = F.get(F.array(*[F.lit(x) for x in m.stds]), col(k) - n_modal)
    inner = F.least(F.greatest(col(u), F.lit(-1.0)), F.lit(1.0)) * SPREAD * std + mean
    return F.when(col(k) < n_modal, F.get(values, col(k))).otherwise(inner) if n_modal else inner
