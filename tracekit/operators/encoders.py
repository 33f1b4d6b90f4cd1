"""Column encoders: fitted parameters are a few numbers or checked choice lists, transforms are expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracekit.session import col

EPS = 1e-8
MAX_CHOICES = 10_000


# ---- min-max fields ---------------------------------------------------------------------

@dataclass(frozen=True)
class Range:
    low: float
    high: float
    log: bool = False
    minus_one: bool = False


def fit_ranges(
    df: DataFrame,
    cols: Sequence[str],
    log: Sequence[str] = (),
    minus_one: Sequence[str] = (),
    eps: float = EPS,
    overrides: Mapping[str, tuple[float, float]] | None = None,
) -> dict[str, Range]:
    """Minimum and maximum of all columns in one aggregation, widened by ``eps``."""
    overrides = overrides or {}
    x = {c: F.log1p(F.col(c).cast("double")) if c in log else F.col(c).cast("double") for c in cols}
    row = df.agg(*[F.min(x[c]).alias(f"lo_{c}") for c in cols], *[F.max(x[c]).alias(f"hi_{c}") for c in cols]).first()
    out = {}
    for c in cols:
        lo, hi = overrides.get(c, (row[f"lo_{c}"] - eps, row[f"hi_{c}"] + eps))
        out[c] = Range(lo, hi, c in log, c in minus_one)
    return out


def normalize(c: Column | str, r: Range) -> Column:
    x = col(c).cast("double")
    x = F.log1p(x) if r.log else x
    span = r.high - r.low
    unit = (x - r.low) / span if span else F.when(x.isNotNull(), F.lit(0.0))
    return unit * 2 - 1 if r.minus_one else unit


def denormalize(c: Column | str, r: Range, clip: bool = False) -> Column:
    x = (col(c) + 1) / 2 if r.minus_one else col(c)
    x = x * (r.high - r.low) + r.low
    x = F.least(F.greatest(x, F.lit(r.low)), F.lit(r.high)) if clip else x
    return F.expm1(x) if r.log else x


# ---- categories -------------------------------------------------------------------------

def fit_choices(df: DataFrame, cols: Sequence[str], by_frequency: bool = False) -> dict[str, list]:
    """Sorted (or most frequent first) choices per column; one-hot arrays need few of them."""
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])))
    counts = long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.limit(MAX_CHOICES * len(cols) + 1).collect()
    out: dict[str, list] = {c: [] for c in cols}
    for r in sorted(rows, key=lambda r: (-r.n if by_frequency else 0, r.value)):
        out[r.column].append(r.value)
    for c, values in out.items():
        if len(values) > MAX_CHOICES:
            raise ValueError(f"{c} has more than {MAX_CHOICES} categories: index it by a join (label_encode) instead")
    return out


def one_hot(c: Column | str, choices: Sequence, scale: float = 1.0) -> Column:
    """Unknown and missing values give all zeros."""
    x = col(c).cast("string")
    hit = lambda v: F.when(x == F.lit(str(v)), F.lit(float(scale))).otherwise(0.0)
    return F.array(*[hit(v) for v in choices])


def from_one_hot(arr: Column | str, choices: Sequence) -> Column:
    a = col(arr)
    at = F.array_position(a, F.array_max(a))
    return F.get(F.array(*[F.lit(v) for v in choices]), (at - 1).cast("int"))


def label_table(df: DataFrame, c: str, by_frequency: bool = False) -> DataFrame:
    """(value, code) with dense codes in value order, or most frequent first; no choice list on the driver."""
    from tracekit.operators.ordered import ordered_position

    values = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    order = [F.desc("n"), "value"] if by_frequency else ["value"]
    return ordered_position(values, order, name="code")


def label_encode(df: DataFrame, c: str, labels: DataFrame, name: str) -> DataFrame:
    codes = labels.select(F.col("value").alias("_v"), F.col("code").alias(name))
    return df.join(codes, F.col(c).cast("string") == F.col("_v"), "left").drop("_v")


def label_decode(df: DataFrame, code: str, labels: DataFrame, name: str) -> DataFrame:
    values = labels.select(F.col("code").alias("_c"), F.col("value").alias(name))
    return df.join(values, F.col(code) == F.col("_c"), "left").drop("_c")


# ---- log transform ----------------------------------------------------------------------

def log_shift(lower: float) -> float | None:
    """What is added before the logarithm: nothing, 1, or 1 - lower by the sign of the minimum."""
    if lower > 0:
        return 0.0
    return 1.0 if lower == 0 else 1.0 - lower


def log_encode(c: Column | str, lower: float) -> Column:
    return F.log(col(c) + log_shift(lower))


def log_decode(c: Column | str, lower: float) -> Column:
    return F.exp(col(c)) - log_shift(lower)


def round_integers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Half to even, as numpy rounds."""
    return df.withColumns({c: F.rint(F.col(c)).cast("bigint") for c in cols})


# ---- standard scaling -------------------------------------------------------------------

@dataclass(frozen=True)
class Moments:
    mean: float
    std: float


def fit_moments(df: DataFrame, cols: Sequence[str]) -> dict[str, Moments]:
    row = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]
    ).first()
    return {c: Moments(row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in cols}


def standardize(c: Column | str, m: Moments, fill: float | None = None) -> Column:
    x = col(c).cast("double")
    x = F.coalesce(x, F.lit(fill)) if fill is not None else x
    return (x - m.mean) / m.std


def bench_features(
    real: DataFrame, others: Sequence[DataFrame], numeric: Sequence[str], categorical: Sequence[str]
) -> list[DataFrame]:
    """Scale on the real table, fill each table with its own means, one-hot with unknowns all zero.

    Adds ``features``: numeric columns first, then the one-hot slots.
    """
    moments = fit_moments(real, numeric) if numeric else {}
    choices = fit_choices(real, categorical) if categorical else {}
    out = []
    for df in [real, *others]:
        means = fit_moments(df, numeric) if numeric else {}
        nums = F.array(*[standardize(c, moments[c], means[c].mean) for c in numeric]).cast("array<double>")
        cats = [one_hot(c, choices[c]) for c in categorical]
        out.append(df.withColumn("features", F.concat(nums, *cats)))
    return out


# ---- per-session min-max ----------------------------------------------------------------

def normalize_per_session(
    df: DataFrame, continuous: Sequence[int], width: int, feat: str = "feat", attr: str = "attr",
    minus_one: bool = False, eps: float = 1e-4,
) -> DataFrame:
    """Scale each continuous feature inside its session; centre and half-range become attributes."""
    parts, extra = [], []
    for j in range(width):
        series = F.transform(F.col(feat), lambda x: F.get(x, j))
        if j not in continuous:
            parts.append(series.alias(f"_x{j}"))
            continue
        hi, lo = F.array_max(series) + eps, F.array_min(series) - eps
        extra += [((hi + lo) / 2).alias(f"_mid{j}"), ((hi - lo) / 2).alias(f"_half{j}")]
        parts.append(series.alias(f"_x{j}"))
    wide = df.select("*", *parts, *extra)

    def scaled(j):
        if j not in continuous:
            return F.col(f"_x{j}")
        lo = F.col(f"_mid{j}") - F.col(f"_half{j}")
        unit = lambda v: (v - lo) / (2 * F.col(f"_half{j}"))
        return F.transform(F.col(f"_x{j}"), lambda v: unit(v) * 2 - 1 if minus_one else unit(v))

    cols = F.arrays_zip(*[scaled(j).alias(f"f{j}") for j in range(width)])
    rows = F.transform(cols, lambda s: F.array(*[s[f"f{j}"] for j in range(width)]))
    bounds = [F.col(n) for j in continuous for n in (f"_mid{j}", f"_half{j}")]
    return wide.select(
        *[c for c in df.columns if c not in (feat, attr)],
        rows.alias(feat),
        F.concat(F.col(attr), F.array(*bounds)).alias(attr),
    )


def denormalize_per_session(
    df: DataFrame, continuous: Sequence[int], width: int, feat: str = "feat", attr: str = "attr",
    flag: str = "gen_flag", minus_one: bool = False,
) -> DataFrame:
    """Undo the scaling from the last 2 * len(continuous) attributes; steps past the end become zero."""
    base = F.size(attr) - 2 * len(continuous)
    bounds = []
    for i, j in enumerate(continuous):
        mid, half = F.get(F.col(attr), base + 2 * i), F.get(F.col(attr), base + 2 * i + 1)
        bounds += [(mid - half).alias(f"_lo{j}"), (2 * half).alias(f"_span{j}")]
    wide = df.select("*", *bounds)

    def back(x, j):
        v = F.get(x, j)
        if j not in continuous:
            return v
        v = (v + 1) / 2 if minus_one else v
        return v * F.col(f"_span{j}") + F.col(f"_lo{j}")

    rows = F.zip_with(feat, flag, lambda x, g: F.array(*[back(x, j) * g for j in range(width)]))
    return wide.select(
        *[c for c in df.columns if c not in (feat, attr)],
        rows.alias(feat),
        F.slice(F.col(attr), F.lit(1), base).alias(attr),
    )


def field_table(spark, ranges: Mapping[str, Range], choices: Mapping[str, Sequence]) -> DataFrame:
    """Fitted parameters as a small table, written next to session tensors."""
    rows = [(c, "log" if r.log else "continuous", r.low, r.high, None) for c, r in ranges.items()]
    rows += [(c, "discrete", None, None, [str(v) for v in vs]) for c, vs in choices.items()]
    return spark.createDataFrame(rows, "column string, kind string, low double, high double, choices array<string>")
