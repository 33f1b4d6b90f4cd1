"""Order-dependent work without a window over the whole table or over one hot key.

``arrange`` range-sorts once on (group, order) and writes the result, so the
bucket of a row (its sorted partition) is fixed. Windows then run inside
(bucket, group), and what crosses a bucket border is carried by a table with at
most one row per bucket. A key holding a third of all rows is therefore spread
over a third of the buckets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracekit.session import col, cut

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits
_LOCAL_MASK = (1 << _LOCAL_BITS) - 1


def arrange(
    df: DataFrame,
    order: Sequence[Column | str],
    by: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """Sort by (by, order), which must end in a unique key, and tag rows with ``_bucket``, ``_at``.

    A table that already carries the marks of this order is returned as it is, so
    operators over the same order can share one sort. Marks of another order are an
    error; ``same_order`` states that a table sorted one way is sorted another way too.
    """
    if not order:
        raise ValueError("an explicit order is needed: rows of a DataFrame have none")
    keys = [F.col(b) for b in by] + [col(o) for o in order]
    wanted = _names(keys)
    if "_at" in df.columns:
        present = df.schema["_bucket"].metadata.get("order")
        if present != wanted:
            raise ValueError(f"the table is sorted by {present}, not by {wanted}")
        return df
    if buckets:
        placed = df.repartitionByRange(buckets, *keys).sortWithinPartitions(*keys)
    else:
        placed = df.orderBy(*keys)
    placed = placed.withColumn("_at", F.monotonically_increasing_id())
    done = cut(placed.withColumn("_bucket", F.shiftright("_at", _LOCAL_BITS).cast("int")), "arranged")
    return done.withMetadata("_bucket", {"buckets": len(done.inputFiles()), "order": wanted})


def _names(keys: Sequence[Column]) -> list[str]:
    return [k._jc.toString() for k in keys]


def same_order(df: DataFrame, order: Sequence[Column | str], by: Sequence[str] = ()) -> DataFrame:
    """State that a table from ``arrange`` is sorted by (by, order) as well, as when a day follows from a timestamp."""
    marks = df.schema["_bucket"].metadata
    return df.withMetadata("_bucket", {**marks, "order": _names([F.col(b) for b in by] + [col(o) for o in order])})


def running(
    arranged: DataFrame,
    by: Sequence[str] = (),
    position: str | None = None,
    sums: Mapping[str, Column | str] | None = None,
    fills: Mapping[str, Column | str] | None = None,
    lags: Mapping[str, Column | str] | None = None,
    firsts: Mapping[str, Column | str] | None = None,
    filtered: bool = False,
) -> DataFrame:
    """Add running columns per group over a table from ``arrange``.

    position: 0-based row number; sums: inclusive running sums; fills: last
    non-null value so far; lags: value of the previous row; firsts: value of
    the first row of the group. ``filtered`` says that rows were dropped since
    the sort, so positions have to be counted again.
    """
    sums, fills, lags, firsts = dict(sums or {}), dict(fills or {}), dict(lags or {}), dict(firsts or {})
    by = list(by)
    part = Window.partitionBy("_bucket", *by).orderBy("_at")
    upto = part.rowsBetween(Window.unboundedPreceding, 0)

    local, totals, carried = {}, [], {}
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_bucket")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    if position:
        local[position] = (
            F.row_number().over(part).cast("bigint") - 1
            if by or filtered
            else F.col("_at").bitwiseAND(F.lit(_LOCAL_MASK))
        )
        totals.append(F.count(F.lit(1)).alias("_n"))
        carried["_c_" + position] = F.sum("_n").over(before)
    for name, c in sums.items():
        local[name] = F.sum(col(c)).over(upto)
        totals.append(F.sum(col(c)).alias("_s_" + name))
        carried["_c_" + name] = F.sum("_s_" + name).over(before)
    for name, c in fills.items():
        local[name] = F.last(col(c), ignorenulls=True).over(upto)
        totals.append(F.max_by(col(c), F.when(col(c).isNotNull(), F.col("_at"))).alias("_s_" + name))
        carried["_c_" + name] = F.last("_s_" + name, ignorenulls=True).over(before)
    for name, c in lags.items():
        local[name] = F.lag(F.struct(col(c).alias("v"))).over(part)
        totals.append(F.max_by(F.struct(col(c).alias("v")), F.col("_at")).alias("_s_" + name))
        carried["_c_" + name] = F.last("_s_" + name).over(before)
    for name, c in firsts.items():
        local[name] = F.first(F.struct(col(c).alias("v"))).over(upto)
        totals.append(F.min_by(F.struct(col(c).alias("v")), F.col("_at")).alias("_s_" + name))
        carried["_c_" + name] = F.first("_s_" + name).over(before)

    seen = F.count(F.lit(1)).over(before)
    carry = (
        arranged.groupBy("_bucket", *by)
        .agg(*totals)
        .select("_bucket", *by, seen.alias("_seen"), *[e.alias(n) for n, e in carried.items()])
        .where(F.col("_seen") > 0)  # only the first group of a bucket can continue an earlier one
        .drop("_seen")
    )
    carry = carry.select(
        F.col("_bucket").alias("_cb"), *[F.col(b).alias("_k_" + b) for b in by], *carried
    )
    # At most one row per bucket, so what is collected and broadcast is bounded by the number of
    # sorted partitions. As a local table it also keeps a chain of passes from nesting plans.
    single = arranged.schema["_bucket"].metadata.get("buckets") == 1
    rows = [] if single else carry.collect()
    # rows are dealt by bucket once, bucket i to task i: that serves the windows of every group and of every later pass
    marks = arranged.schema["_bucket"].metadata
    dealt = arranged if marks.get("dealt") else arranged.repartitionById(max(1, marks.get("buckets", 1)), "_bucket").withMetadata("_bucket", {**marks, "dealt": True})
    out = dealt.select("*", *[e.alias("_l_" + n) for n, e in local.items()])
    if rows:
        cond = F.col("_bucket") == F.col("_cb")
        for b in by:
            cond = cond & F.col(b).eqNullSafe(F.col("_k_" + b))
        held = arranged.sparkSession.createDataFrame(rows, carry.schema)
        out = out.join(F.broadcast(held), cond, "left")
    else:
        types = {f.name: f.dataType for f in carry.schema.fields}
        out = out.select("*", *[F.lit(None).cast(types[c]).alias(c) for c in carried])
    final = []
    for name in local:
        here, there = F.col("_l_" + name), F.col("_c_" + name)
        if name == position:
            final.append((here + F.coalesce(there, F.lit(0))).cast("bigint").alias(name))
        elif name in sums:
            final.append((F.coalesce(here, F.lit(0)) + F.coalesce(there, F.lit(0))).alias(name))
        elif name in fills:
            final.append(F.coalesce(here, there).alias(name))
        elif name in firsts:
            final.append(F.coalesce(there, here)["v"].alias(name))
        else:
            final.append(F.coalesce(here, there)["v"].alias(name))
    keep = [c for c in arranged.columns if c not in local]
    return out.select(*keep, *final)


def drop_marks(df: DataFrame) -> DataFrame:
    return df.drop("_at", "_bucket")


def ordered_position(df, order, by=(), name="pos", buckets=None) -> DataFrame:
    """Global (or per-group) 0-based position."""
    return drop_marks(running(arrange(df, order, by, buckets), by, position=name))


def carry_forward(df, order, cols, by=(), buckets=None) -> DataFrame:
    """Replace nulls of ``cols`` by the last non-null value before them."""
    done = running(arrange(df, order, by, buckets), by, fills={"_f_" + c: c for c in cols})
    return done.select(*[F.col("_f_" + c).alias(c) if c in cols else F.col(c) for c in df.columns])


def prefix_sum(df, order, value, by=(), name="running", buckets=None) -> DataFrame:
    return drop_marks(running(arrange(df, order, by, buckets), by, sums={name: value}))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolation quantiles as rows (by, q, value).

    Values are counted first, so a value held by a third of the rows is one row
    of the sort. A second sort puts the wanted positions between the positions
    at which the values start; no task holds the values of a whole group.
    """
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"))
    run = running(arrange(counts, ["_v"], by), by, sums={"_c": "_n"})
    starts = run.select(*by, (F.col("_c") - F.col("_n")).alias("_p"), F.lit(0).alias("_k"), "_v", F.lit(0.0).alias("q"), F.lit(0.0).alias("_w"))

    sizes = run.groupBy(*by).agg(F.max("_c").alias("_n"))
    want = sizes.select(*by, "_n", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("q"))
    at = (F.col("_n") - 1) * F.col("q")
    # 1e-9 keeps float noise in (n-1)*q from pushing an exact hit to the row below
    want = want.select(*by, "q", at.alias("_h"), F.floor(at + 1e-9).cast("bigint").alias("_lo"))
    part = F.col("_h") - F.col("_lo")
    ends = F.array(F.struct(F.col("_lo").alias("_p"), (1 - part).alias("_w")), F.struct((F.col("_lo") + 1).alias("_p"), part.alias("_w")))
    want = want.select(*by, "q", F.inline(ends)).where("_w <> 0")
    want = want.select(*by, "_p", F.lit(1).alias("_k"), F.lit(None).cast("double").alias("_v"), "q", "_w")

    found = running(arrange(starts.unionByName(want), ["_p", "_k", "q"], by), by, fills={"_x": "_v"}).where("_k = 1")
    return found.groupBy(*by, "q").agg((F.sum(F.col("_x") * F.col("_w")) / F.sum("_w")).alias(value))


def sketch_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), k: int = 800) -> DataFrame:
    """``exact_quantiles`` without a sort: rows (by, q, value) from one mergeable sketch per group.

    The values are values of the table whose ranks are off by about 1.7 / k of the group (0.2 % by default), not
    interpolated ones. Tasks send sketches of a fixed size, so a group of any size is a few kilobytes.
    """
    sketch = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("_s"))
    sketch = sketch.where(F.kll_sketch_get_n_double("_s") > 0)  # without groups there is a sketch of nothing as well
    rows = [F.struct(F.lit(float(p)).alias("q"), F.kll_sketch_get_quantile_double("_s", F.lit(float(p))).alias(value)) for p in probs]
    return sketch.select(*by, F.inline(F.array(*rows)))


def quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), approx: bool = False) -> DataFrame:
    """Rows (by, q, value): exact and interpolated, or from sketches if ``approx``."""
    return (sketch_quantiles if approx else exact_quantiles)(df, value, probs, by)


def exact_top(df: DataFrame, n: int, order: Sequence[Column | str]) -> DataFrame:
    """First n rows in an order: a top-k heap while n is small, a sorted position beyond that."""
    if n <= 10_000:
        return df.orderBy(*[col(o) for o in order]).limit(n)
    return ordered_position(df, order, name="_pos").where(F.col("_pos") < n).drop("_pos")
