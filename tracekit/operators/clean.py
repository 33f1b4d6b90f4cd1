"""Projection, filters, missing values and validators."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracekit.operators.ordered import arrange, running
from tracekit.session import col

# What stands for a missing cell while a table is encoded.
MISSING_NUMBER = -9999999
MISSING_TEXT = "empty"


def long_stats(df: DataFrame, per_column: Mapping[str, Sequence[tuple[str, Column]]]) -> DataFrame:
    """One aggregation over the table, returned as one row per column."""
    aggs, rows = [], []
    for i, (c, stats) in enumerate(per_column.items()):
        aggs += [e.alias(f"_{i}_{n}") for n, e in stats]
        rows.append(F.struct(F.lit(c).alias("column"), *[F.col(f"_{i}_{n}").alias(n) for n, _ in stats]))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def select_signals(df: DataFrame, cols: Sequence[str], ts: str = "timestamp") -> DataFrame:
    return df.select(ts, *cols)


def drop_all_null_columns(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Drop columns without a single value; one aggregation finds them."""
    seen = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    gone = [c for c in df.columns if seen[c] == 0]
    return df.drop(*gone), gone


def impute_ffill(
    df: DataFrame, order, cols: Sequence[str], by: Sequence[str] = (), buckets: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Fill forward in time order; returns (complete rows with ``was_missing`` flags, removed count).

    The flags are taken before the fill and travel with the row, so they stay
    aligned when incomplete leading rows are dropped.
    """
    if isinstance(order, str):
        order = [order]
    flagged = df.withColumn("was_missing", F.array(*[F.col(c).isNull().cast("int") for c in cols]))
    filled = running(arrange(flagged, order, by, buckets), by, fills={"_f_" + c: c for c in cols})
    filled = filled.select(
        *[F.col("_f_" + c).alias(c) if c in cols else F.col(c) for c in flagged.columns]
    )
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    removed = filled.agg(F.sum((~whole).cast("bigint")).alias("removed"), F.count(F.lit(1)).alias("total"))
    return filled.where(whole), removed


def missing_table(filled: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """The indicator table of the surviving rows."""
    return filled.select(*keys, *[F.get("was_missing", i).alias(c) for i, c in enumerate(cols)])


def add_missing_flags(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``<c>_Missing`` flags, then every missing cell becomes 0."""
    return df.select("*", *[F.col(c).isNull().cast("int").alias(f"{c}_Missing") for c in cols]).fillna(0)


def restore_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    flags = {f"{c}_Missing" for c in cols}
    return df.select(
        *[
            F.when(F.col(f"{c}_Missing") == 1, F.lit(None)).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
            for c in df.columns
            if c not in flags
        ]
    )


def fill_zero(df: DataFrame) -> DataFrame:
    return df.fillna(0)


def drop_incomplete(df: DataFrame) -> DataFrame:
    return df.dropna()


def remove_constant_columns(df: DataFrame) -> tuple[DataFrame, dict]:
    """Drop columns with one value (missing counts as a value); returns what to add back."""
    row = df.agg(
        *[F.min(c).alias(f"lo_{c}") for c in df.columns],
        *[F.max(c).alias(f"hi_{c}") for c in df.columns],
        *[F.count(F.col(c)).alias(f"n_{c}") for c in df.columns],
        F.count(F.lit(1)).alias("_rows"),
    ).first()
    constant = {
        c: row[f"lo_{c}"]
        for c in df.columns
        if row[f"n_{c}"] == 0 or (row[f"n_{c}"] == row["_rows"] and row[f"lo_{c}"] == row[f"hi_{c}"])
    }
    return df.drop(*constant), constant


def restore_constant_columns(df: DataFrame, constant: Mapping) -> DataFrame:
    return df.select("*", *[F.lit(v).alias(c) for c, v in constant.items()])


def profile_columns(df: DataFrame) -> DataFrame:
    """Per column: share of non-missing cells and whether it holds one value only."""
    rows = F.count(F.lit(1))
    return long_stats(
        df,
        {
            c: [
                ("density", F.count(F.col(c)) / rows),
                (
                    "is_constant",
                    ((F.count(F.col(c)) == 0) | ((F.count(F.col(c)) == rows) & (F.min(c) == F.max(c)))).cast("int"),
                ),
            ]
            for c in df.columns
        },
    )


def label_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))


def missing_counts(df: DataFrame) -> DataFrame:
    """Missing cells per column and overall (row ``*``)."""
    per = long_stats(df, {c: [("missing", F.sum(F.col(c).isNull().cast("bigint")))] for c in df.columns})
    return per.unionByName(per.agg(F.lit("*").alias("column"), F.sum("missing").alias("missing")))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def discrete_numeric_columns(df: DataFrame, limit: int = 32) -> list[str]:
    """Numeric columns with whole values only and at most ``limit`` distinct ones.

    One scan sketches the distinct counts of all columns; only those that the sketch puts below twice the limit (its error
    there is far smaller) are counted exactly, so wide or continuous columns are never shuffled.
    """
    cols = numeric_columns(df)
    if not cols:
        return []
    row = df.agg(*[x for c in cols for x in (
        F.hll_sketch_estimate(F.hll_sketch_agg(F.when(F.col(c).isNotNull(), F.xxhash64(c)), F.lit(12))).alias("n_" + c), _whole(c).alias("w_" + c))]).first()
    likely = [c for c in cols if (row["n_" + c] or 0) <= 2 * limit and row["w_" + c] == 1]
    if not likely:
        return []
    counts = {r["column"]: r["n_distinct"] for r in distinct_counts(df, likely).collect()}
    return [c for c in likely if counts[c] <= limit]


def _whole(c: str) -> Column:
    return F.min((F.col(c) == F.round(F.col(c).cast("double"))).cast("int"))


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, n_distinct) of any numeric columns, nulls not counted: values are set apart once per task, then shuffled by value.

    Columns are laid out as narrow (column, value) rows by kind of number, so no row is copied as a whole.
    """
    kinds: dict[str, list[tuple[int, str]]] = {}
    for i, c in enumerate(cols):
        name = df.schema[c].dataType
        kind = "double" if isinstance(name, T.FractionalType) and not isinstance(name, T.DecimalType) else "string" if isinstance(name, T.DecimalType) else "bigint"
        kinds.setdefault(kind, []).append((i, c))
    counted = None
    for kind, members in kinds.items():
        long = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("_i"), F.col(c).cast(kind).alias("_v")) for i, c in members])))
        part = long.where("_v is not null").distinct().groupBy("_i").agg(F.count(F.lit(1)).alias("n"))
        counted = part if counted is None else counted.unionByName(part)
    # one row: columns without a value are 0
    wide = counted.agg(*[F.coalesce(F.max(F.when(F.col("_i") == i, F.col("n"))), F.lit(0)).alias(f"_{i}") for i in range(len(cols))])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("n_distinct")) for i, c in enumerate(cols)])))


def discrete_numeric_report(df: DataFrame) -> DataFrame:
    """(column, n_distinct, whole) per numeric column: exact number of values, and 1 if all are whole."""
    cols = numeric_columns(df)
    return distinct_counts(df, cols).join(long_stats(df, {c: [("whole", _whole(c))] for c in cols}), "column")


def observed_values(df: DataFrame, cols: Sequence[str], limit: int = 32) -> dict[str, list]:
    """Distinct values of low-cardinality columns (checked against ``limit``)."""
    out = {}
    for c in cols:
        values = [r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().limit(limit + 1).collect()]
        if len(values) > limit:
            raise ValueError(f"{c} has more than {limit} distinct values")
        out[c] = sorted(values)
    return out


def round_to_observed(df: DataFrame, observed: Mapping[str, Sequence]) -> DataFrame:
    """Snap to the nearest observed value; the smaller one wins a tie."""

    def snap(c, values):
        near = F.transform(
            F.array(*[F.lit(float(v)) for v in values]),
            lambda v: F.struct(F.abs(F.col(c) - v).alias("d"), v.alias("v")),
        )
        return F.when(F.col(c).isNotNull(), F.array_min(near)["v"]).alias(c)

    return df.select(*[snap(c, observed[c]) if c in observed else F.col(c) for c in df.columns])


def sentinel_missing(df: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """Blank text counts as missing; categorical cells become 'empty', the rest the number."""

    def one(c):
        is_text = isinstance(df.schema[c].dataType, T.StringType)
        value = F.when(F.trim(F.col(c)) != "", F.col(c)) if is_text else F.col(c)
        return F.coalesce(value, F.lit(MISSING_TEXT if c in categorical else MISSING_NUMBER)).alias(c)

    return df.select(*[one(c) for c in df.columns])


def unsentinel(df: DataFrame) -> DataFrame:
    def one(c):
        is_text = isinstance(df.schema[c].dataType, T.StringType)
        return F.nullif(F.col(c), F.lit(MISSING_TEXT if is_text else MISSING_NUMBER)).alias(c)

    return df.select(*[one(c) for c in df.columns])


def in_range(c: Column | str, lo, hi) -> Column:
    return col(c).between(lo, hi)


def in_polygon(lon: Column | str, lat: Column | str, rings: Sequence[Sequence[tuple[float, float]]]) -> Column:
    """Strictly inside a polygon or multipolygon: an odd number of edges to the right.

    Rings are closed automatically; holes are further rings. Points on an edge are outside.
    """
    x, y = col(lon), col(lat)
    edges = [
        (float(a[0]), float(a[1]), float(b[0]), float(b[1]))
        for ring in rings
        for a, b in zip(ring, [*ring[1:], ring[0]])
        if tuple(a) != tuple(b)
    ]
    lit_edges = F.array(
        *[F.struct(*[F.lit(v).alias(n) for v, n in zip(e, ("ax", "ay", "bx", "by"))]) for e in edges]
    )
    cross = lambda e: (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"])
    crossings = F.size(
        F.filter(
            lit_edges,
            lambda e: ((e["ay"] > y) != (e["by"] > y))
            & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"]),
        )
    )
    on_edge = F.exists(
        lit_edges,
        lambda e: (cross(e) == 0)
        & x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"]))
        & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"])),
    )
    return (crossings % 2 == 1) & ~on_edge


class RowValidator:
    """Named checks over column tuples; a row stays when all of them hold."""

    def __init__(self):
        self.rules: dict[str, tuple[Callable[..., Column], tuple[str, ...]]] = {}

    def add(self, name: str, check: Callable[..., Column], cols: Sequence[str]) -> RowValidator:
        """``check`` takes one Column per name and returns a boolean Column (a pandas UDF also does)."""
        if name in self.rules:
            raise ValueError(f"rule {name} already present")
        self.rules[name] = (check, tuple(cols))
        return self

    def remove(self, name: str) -> RowValidator:
        del self.rules[name]
        return self

    def _holds(self, name: str) -> Column:
        check, cols = self.rules[name]
        return F.coalesce(check(*[F.col(c) for c in cols]), F.lit(False))

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(reduce(lambda a, b: a & b, [self._holds(n) for n in self.rules], F.lit(True)))

    def report(self, df: DataFrame) -> DataFrame:
        """Rows failing each rule, and rows failing any."""
        fails = {n: ~self._holds(n) for n in self.rules}
        any_fail = reduce(lambda a, b: a | b, fails.values(), F.lit(False))
        stats = {n: [("rejected", F.sum(f.cast("bigint")))] for n, f in {**fails, "*": any_fail}.items()}
        return long_stats(df, stats).withColumnRenamed("column", "rule")


def has_missing(df: DataFrame) -> dict[str, bool]:
    row = df.agg(*[F.max(F.col(c).isNull()).alias(c) for c in df.columns]).first()
    return {c: bool(row[c]) for c in df.columns}


def validate_not_null(df: DataFrame, training: Mapping[str, bool]) -> DataFrame:
    """Drop rows that are null where the training table never was."""
    return df.dropna(subset=[c for c, missing in training.items() if not missing])


def bounds(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple]:
    row = df.agg(*[F.min(c).alias(f"lo_{c}") for c in cols], *[F.max(c).alias(f"hi_{c}") for c in cols]).first()
    return {c: (row[f"lo_{c}"], row[f"hi_{c}"]) for c in cols}


def within_bounds(limits: Mapping[str, tuple]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).between(lo, hi) for c, (lo, hi) in limits.items()])


def reject_out_of_bounds(df: DataFrame, limits: Mapping[str, tuple]) -> tuple[DataFrame, DataFrame]:
    ok = F.coalesce(within_bounds(limits), F.lit(False))
    return df.where(ok), df.agg(F.sum((~ok).cast("bigint")).alias("rejected"))


def truncate_to_range(df: DataFrame, ref: DataFrame, ts: str) -> tuple[DataFrame, DataFrame]:
    """Rows inside the time range of another table, and the kept share."""
    lo, hi = bounds(ref, [ts])[ts]
    tagged = df.withColumn("_in", F.col(ts).between(F.lit(lo), F.lit(hi)))
    share = tagged.agg(F.avg(F.col("_in").cast("double")).alias("kept_ratio"))
    return tagged.where("_in").select(*df.columns), share


def drop_all_duplicates(df: DataFrame) -> DataFrame:
    """Rows that occur exactly once."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select(*df.columns)


def align(df: DataFrame, ref: DataFrame) -> DataFrame:
    return df.select(*ref.columns)


def duplicate_rate(df: DataFrame) -> DataFrame:
    """Share of rows that repeat an earlier row."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg((1 - F.count(F.lit(1)) / F.sum("_n")).alias("duplicate_rate"))
