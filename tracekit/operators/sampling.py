"""Samples, splits, conditional draws, over-sampling and refill loops.

Every draw is the md5 of a seed and a row key, so results do not depend on
partitioning and can be repeated.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracekit.operators.clean import RowValidator
from tracekit.operators.nearest import nearest
from tracekit.operators.ordered import arrange, exact_quantiles, exact_top, ordered_position, running
from tracekit.session import cut, digest, fraction

MAX_CLASSES = 10_000
INTERVAL_CELLS = 1024
HEAP_ROWS = 10_000


# ---- samples ----------------------------------------------------------------------------

def exact_sample(df: DataFrame, n: int, seed, *key: str) -> DataFrame:
    """Exactly n rows without replacement.

    A large sample sorts only rows whose digest is small enough to be chosen;
    when that guess keeps too few rows the whole table is sorted.
    """
    if n > HEAP_ROWS:
        likely = df.where(fraction(seed, *key) < _guess(n, df.count()))
        df = likely if likely.count() >= n else df
    return exact_top(df, n, [digest(seed, *key), *key])


def _guess(n: int, total: int) -> float:
    """A digest fraction below which n of ``total`` rows lie almost surely."""
    return min(1.0, (n + 6 * math.sqrt(n) + 50) / max(total, 1))


def row_cap(df: DataFrame, cap: int, seed, *key: str) -> DataFrame:
    """The table itself, or a sample of ``cap`` rows when it is larger."""
    return exact_sample(df, cap, seed, *key) if df.count() > cap else df


def percent_sample(df: DataFrame, percent: float, seed, *key: str) -> DataFrame:
    return exact_sample(df, int(df.count() * 0.01 * percent), seed, *key)


def head_rows(df: DataFrame, order, last: int) -> DataFrame:
    """Rows up to and including position ``last``."""
    return ordered_position(df, order, name="_p").where(F.col("_p") <= last).drop("_p")


# ---- splits -----------------------------------------------------------------------------

def two_way_split(df: DataFrame, ratio: float, seed, *key: str, exact: bool = False) -> DataFrame:
    """``split`` is train with probability ``ratio`` (or for exactly that share of the rows)."""
    if not exact:
        return df.withColumn("split", F.when(fraction(seed, *key) < ratio, "train").otherwise("test"))
    placed = arrange(df, [digest(seed, *key), *key])
    n = math.floor(placed.count() * ratio)
    return running(placed, (), position="_p").select(
        *df.columns, F.when(F.col("_p") < n, "train").otherwise("test").alias("split"))


def three_way_split(df: DataFrame, ratios: tuple[float, float, float], seed, *key: str) -> DataFrame:
    """Test first, then validation with its share of what is left, from one fraction."""
    if abs(sum(ratios) - 1.0) > 1e-9:
        raise ValueError("ratios must sum to 1")
    _, val, test = ratios
    u = fraction(seed, *key)
    return df.withColumn("split", F.when(u < test, "test").when(u < test + val, "val").otherwise("train"))


def resplit(df: DataFrame, val: float, seed, *key: str) -> DataFrame:
    """Draw train and validation again, leave the test rows alone."""
    again = F.when(fraction(seed, *key) < val, "val").otherwise("train")
    return df.withColumn("split", F.when(F.col("split") == "test", "test").otherwise(again))


def head_split(df: DataFrame, order, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """Train, validation and test by position."""
    placed = arrange(df, order)
    n = placed.count()
    a, b = int(n * train), int(n * train) + int(n * val)
    p = F.col("_p")
    return running(placed, (), position="_p").select(
        *df.columns, F.when(p < a, "train").when(p < b, "val").otherwise("test").alias("split"))


def stratified_split(df: DataFrame, y: str, test: float, seed, *key: str) -> DataFrame:
    """The same test share in every class; classes are counted, not grouped."""
    placed = running(arrange(df, [digest(seed, *key), *key], [y]), [y], position="_p")
    sizes = df.groupBy(y).agg(F.floor(F.count(F.lit(1)) * test + 0.5).alias("_t"))
    if sizes.count() > MAX_CLASSES:
        raise ValueError("too many classes for a stratified split")
    out = placed.join(F.broadcast(sizes), placed[y].eqNullSafe(sizes[y])).drop(sizes[y])
    return out.select(*df.columns, F.when(F.col("_p") < F.col("_t"), "test").otherwise("train").alias("split"))


def bench_split(real: DataFrame, syn: DataFrame, test: float, seed, *key: str) -> tuple[DataFrame, DataFrame]:
    """Real rows into train and test; as many synthetic rows for each, disjoint."""
    placed = arrange(real, [digest(seed, *key), *key])
    n = placed.count()
    n_test = round(n * test)
    n_train = n - n_test
    p = F.col("_p")
    r = running(placed, (), position="_p").select(*real.columns, F.when(p < n_test, "test").otherwise("train").alias("split"))
    made = arrange(syn, [digest(seed, *key), *key])
    if made.count() < n:
        raise ValueError(f"the synthetic table needs at least {n} rows")
    s = running(made, (), position="_p").where(p < n).select(
        *syn.columns, F.when(p < n_train, "train").otherwise("test").alias("split"))
    return r, s


def bootstrap_rounds(df: DataFrame, rounds: int, frac: float, seed, *key: str, full: bool = True,
                     multiple: int = 3) -> DataFrame:
    """One copy of the table per round, each row with the role it plays there.

    full: the test share 2*frac is halved into stand-in and test, the rest is
    the original. Otherwise a round is a sample: original : stand-in : test are
    multiple : 1 : 1 parts of 2*frac each, and no other row is drawn.
    """
    n = df.count()
    copies = df.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    if not full:
        # a round uses few rows: sort those that can be among them, unless a round would come short
        needed = (multiple + 2) * int(n * 2 * frac)
        likely = copies.where(fraction(seed, "round", *key) < _guess(needed, n))
        sizes = likely.groupBy("round").agg(F.count(F.lit(1)).alias("c")).agg(F.count(F.lit(1)), F.min("c")).first()
        copies = likely if sizes[0] == rounds and sizes[1] >= needed else copies
    placed = running(arrange(copies, [digest(seed, "round", *key), *key], ["round"]), ["round"], position="_p")
    p = F.col("_p")
    if full:
        if 2 * frac >= 1:
            raise ValueError("no training rows would remain")
        held = math.ceil(n * 2 * frac)
        role = F.when(p < held // 2, "synthetic").when(p < held, "test").otherwise("original")
    else:
        size = int(n * 2 * frac)
        if (multiple + 2) * 2 * frac > 1:
            raise ValueError("the sample would be larger than the table")
        role = F.when(p < multiple * size, "original").when(p < (multiple + 1) * size, "synthetic").when(
            p < (multiple + 2) * size, "test")
    return placed.select(*df.columns, "round", role.alias("role")).where("role is not null")


# ---- conditional draws ------------------------------------------------------------------

def category_table(df: DataFrame, cols: Sequence[str], log: bool = False) -> DataFrame:
    """(column_id, column, category_id, value, n, prob, lo, hi): probabilities per column and their interval.

    Categories are in value order; ``category_id`` counts through all columns.
    """
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("column_id"), F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
        for i, c in enumerate(cols)])))
    counts = cut(long.where("value is not null").groupBy("column_id", "column", "value").agg(F.count(F.lit(1)).alias("n")), "categories")
    weight = F.log(F.col("n") + 1.0) if log else F.col("n").cast("double")
    counts = counts.withColumn("_w", weight)
    totals = counts.groupBy("column_id").agg(F.sum("_w").alias("_t"), F.count(F.lit(1)).alias("_k"))
    placed = arrange(counts, ["value"], ["column_id"])
    run = running(placed, ["column_id"], position="_p", sums={"_c": "_w"})
    run = running(run, ["column_id"], lags={"_before": "_c"})
    run = running(run, (), position="category_id").join(F.broadcast(totals), "column_id")  # one row per column
    last = F.col("_p") == F.col("_k") - 1
    return run.select(
        "column_id", "column", "category_id", "value", "n", (F.col("_w") / F.col("_t")).alias("prob"),
        # the lower end is the very quotient that ends the category before, so no draw falls between two
        F.when(F.col("_p") == 0, F.lit(0.0)).otherwise(F.col("_before") / F.col("_t")).alias("lo"),
        F.when(last, F.lit(1.0)).otherwise(F.col("_c") / F.col("_t")).alias("hi"),
    )


def pick_interval(draws: DataFrame, intervals: DataFrame, keys: Sequence[str], u: str) -> DataFrame:
    """Join each draw to the interval lo <= u < hi of its key.

    Both sides carry the cell of [0, 1) they touch, so it is an equi-join; a
    category that fills most of the interval is spread over most cells.
    """
    first = F.floor(F.col("lo") * INTERVAL_CELLS)
    last = F.least(F.floor(F.col("hi") * INTERVAL_CELLS), F.lit(INTERVAL_CELLS - 1))
    cells = intervals.withColumn("_cell", F.explode(F.sequence(first, last)))
    asked = draws.withColumn("_cell", F.floor(F.col(u) * INTERVAL_CELLS))
    return asked.join(cells, [*keys, "_cell"]).where((F.col("lo") <= F.col(u)) & (F.col(u) < F.col("hi"))).drop("_cell")


def conditional_draws(spark: SparkSession, categories: DataFrame, n: int, seed) -> DataFrame:
    """n draws: a column uniformly, then a category by its probability."""
    n_cols = categories.agg(F.max("column_id")).first()[0] + 1
    draws = spark.range(n).select(
        F.col("id").alias("draw"),
        F.floor(fraction(f"{seed}-column", "id") * n_cols).cast("int").alias("column_id"),
        fraction(f"{seed}-category", "id").alias("u"))
    picked = pick_interval(draws, categories, ["column_id"], "u")
    return picked.select("draw", "column_id", "column", "category_id", "value")


def condition_vectors(draws: DataFrame, n_categories: int, n_columns: int) -> DataFrame:
    """One-hot condition and column mask per draw."""
    hot = lambda size, at: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == F.col(at)).cast("double"))
    return draws.select("draw", hot(n_categories, "category_id").alias("condition"), hot(n_columns, "column_id").alias("mask"))


def fixed_condition(categories: DataFrame, column: str, value) -> DataFrame:
    """The category table cut to one (column, value); unknown values are an error."""
    one = categories.where((F.col("column") == column) & (F.col("value") == str(value)))
    if not one.limit(1).count():
        raise ValueError(f"{value!r} does not occur in column {column!r}")
    return one


def fixed_draws(spark: SparkSession, categories: DataFrame, column: str, value, n: int) -> DataFrame:
    row = fixed_condition(categories, column, value).first()
    return spark.range(n).select(
        F.col("id").alias("draw"), F.lit(row["column_id"]).alias("column_id"), F.lit(column).alias("column"),
        F.lit(row["category_id"]).alias("category_id"), F.lit(row["value"]).alias("value"))


def rows_for_draws(df: DataFrame, cols: Sequence[str], draws: DataFrame, categories: DataFrame, key: str, seed) -> DataFrame:
    """(draw, key): a uniform row among those of the drawn category.

    Rows are sorted by (column, value, key), so a category is a run of places: a draw asks for the place of its row, and
    rows move once more with nothing but their place. A category with a third of the rows is not one join group.
    """
    long = df.select(F.col(key).alias("_k"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])))
    placed = arrange(long.where("value is not null"), ["_k"], ["column", "value"])
    runs = placed.groupBy("_bucket", "column", "value").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    runs = cut(runs, "runs")
    # at most one row per sorted partition, so what is collected and broadcast is bounded by their number
    sizes = sorted((r["_bucket"], r["_n"]) for r in runs.groupBy("_bucket").agg(F.sum("_n").alias("_n")).collect())
    before = {b: sum(n for _, n in sizes[:i]) for i, (b, _) in enumerate(sizes)}
    shift = [(b, off - (b << 33)) for b, off in before.items()]  # _at counts from 0 within each partition
    shift = F.broadcast(df.sparkSession.createDataFrame(shift, "_bucket int, _shift bigint"))
    at = lambda d, c: d.join(shift, "_bucket").withColumn("_place", F.col(c) + F.col("_shift"))
    starts = at(runs, "_first").groupBy("column", "value").agg(F.min("_place").alias("_start"), F.sum("_n").alias("_held"))
    asked = draws.join(categories.select("category_id", "n"), "category_id").withColumn("rank", F.floor(fraction(f"{seed}-row", "draw") * F.col("n")))
    asked = asked.join(starts, ["column", "value"]).where(F.col("rank") < F.col("_held"))
    asked = asked.select("draw", "column", "value", (F.col("_start") + F.col("rank")).alias("_place"))
    return asked.join(at(placed, "_at").select("_place", "_k"), "_place").select("draw", "column", "value", F.col("_k").alias(key))


def uniform_rows(df: DataFrame, n: int, key: str, seed) -> DataFrame:
    """(draw, key): n uniform rows with replacement."""
    ranked = ordered_position(df.select(key), [key], name="rank")
    total = df.count()
    draws = df.sparkSession.range(n).select(
        F.col("id").alias("draw"), F.floor(fraction(f"{seed}-row", "id") * total).alias("rank"))
    return draws.join(ranked, "rank").select("draw", key)


# ---- class balance and over-sampling ----------------------------------------------------

def class_sizes(df: DataFrame, y: str) -> list[tuple]:
    rows = df.groupBy(y).agg(F.count(F.lit(1)).alias("n")).limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError("too many classes")
    return sorted((r[0], r["n"]) for r in rows)


def class_deficit(df: DataFrame, y: str, mode: str = "fill") -> DataFrame:
    """fill: rows each class lacks to the largest one; fix: sizes with the first two classes swapped."""
    sizes = df.groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    if mode == "fill":
        top = sizes.agg(F.max("n")).first()[0]
        return sizes.select(y, (F.lit(top) - F.col("n")).alias("n"))
    known = class_sizes(df, y)
    counts = [n for _, n in known]
    if len(counts) > 1:
        counts[0], counts[1] = counts[1], counts[0]
    return df.sparkSession.createDataFrame([(c, n) for (c, _), n in zip(known, counts)], sizes.schema)


def oversample(
    df: DataFrame,
    numeric: Sequence[str],
    y: str,
    key: str,
    categorical: Sequence[str] = (),
    k: int = 5,
    frac: float = 1.0,
    delta: float = 0.0,
    seed=0,
) -> DataFrame:
    """New rows between a row and one of its k nearest neighbours of the same class.

    Distances use columns scaled to [0, 1] (and one-hot categories); the
    interpolation weight is uniform in [delta/2, 1 - delta/2]. Every class c gets
    int((1 + frac) * n_c) - n_c rows. Categories of a new row are the most
    frequent ones among the neighbours, the smallest value on a tie.
    """
    from tracekit.operators.encoders import fit_choices, fit_ranges, normalize, one_hot

    ranges = fit_ranges(df, numeric, eps=0.0)
    parts = [F.array(*[normalize(c, ranges[c]) for c in numeric])]
    if categorical:
        # a category mismatch costs as much as the median spread of the numeric columns
        spread = df.agg(*[F.stddev_pop(normalize(c, ranges[c])).alias(c) for c in numeric]).first()
        mid = sorted(spread)[len(numeric) // 2] if len(numeric) % 2 else sum(sorted(spread)[len(numeric) // 2 - 1: len(numeric) // 2 + 1]) / 2
        choices = fit_choices(df, categorical)
        parts += [one_hot(c, choices[c], mid / 2) for c in categorical]
    rows = df.select(F.col(key).alias("id"), F.col(y).cast("string").alias("cls"), F.concat(*parts).alias("vec"))
    near = cut(nearest(rows, rows, k=k, exclude_self=True, group="cls"), "neighbours")

    sizes = class_sizes(df, y)
    new = [int((1 + frac) * n) - n for _, n in sizes]
    ends = [sum(new[: i + 1]) for i in range(len(new))]
    at = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col("draw")))
    pick = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), F.col("_c"))
    lam = fraction(f"{seed}-step", "draw") * (1 - delta) + delta / 2
    draws = df.sparkSession.range(sum(new)).select(F.col("id").alias("draw")).withColumn("_c", at)
    draws = draws.select(
        "draw", "_c",
        F.floor(fraction(f"{seed}-row", "draw") * pick([n for _, n in sizes])).alias("_row"),
        (F.floor(fraction(f"{seed}-neighbour", "draw") * pick([min(k, n - 1) for _, n in sizes])) + 1).cast("int").alias("rank"),
        lam.alias("_lam"))
    codes = F.array_position(F.array(*[F.lit(str(c)) for c, _ in sizes]), F.col(y).cast("string")).cast("int") - 1
    base = df.withColumn("_c", codes)
    base = running(arrange(base, [key], ["_c"]), ["_c"], position="_row").select("_c", "_row", key, y, *numeric)
    other = df.select(F.col(key).alias("ref_id"), *[F.col(c).alias(f"_n_{c}") for c in numeric])
    made = draws.join(base, ["_c", "_row"]).join(
        near.select(F.col("id").alias(key), "rank", "ref_id"), [key, "rank"]).join(other, "ref_id")
    mixed = [(F.col(c) + F.col("_lam") * (F.col(f"_n_{c}") - F.col(c))).alias(c) for c in numeric]
    out = made.select("draw", key, y, *mixed)
    if categorical:
        cats = df.select(F.col(key).alias("ref_id"), *categorical)
        modes = near.join(cats, "ref_id").groupBy(F.col("id").alias(key)).agg(  # k rows per group
            *[F.mode(F.col(c), deterministic=True).alias(c) for c in categorical])
        out = out.join(modes, key)
    return out.drop(key)


def oversample_regression(df: DataFrame, numeric: Sequence[str], target: str, key: str, **options) -> DataFrame:
    """Classes are above and below the median of the target, which is interpolated like a feature."""
    median = exact_quantiles(df, target, [0.5]).first()[target]
    halves = df.withColumn("_half", (F.col(target) > median).cast("int"))
    return oversample(halves, [*numeric, target], "_half", key, **options).drop("_half")


# ---- refill loops -----------------------------------------------------------------------

Generator = Callable[[int, int], DataFrame]


def measured_batch(
    real: DataFrame, generator: Generator, distance: Callable[[DataFrame, DataFrame], DataFrame], r: int, n: int, measured: dict,
) -> tuple[DataFrame, DataFrame]:
    """Batch r and its distances, both written once and kept in ``measured``."""
    if r not in measured:
        batch = cut(generator(r, n), "batch")
        measured[r] = batch, cut(distance(real, batch), "distances")
    return measured[r]


def privacy_refill(
    real: DataFrame, generator: Generator, distance: Callable[[DataFrame, DataFrame], DataFrame], q: float, n: int,
    key: str, rounds: int = 10, measured: dict | None = None,
) -> tuple[DataFrame, dict]:
    """Drop rows closer to the real table than the q-quantile of the first batch, refill up to n rows.

    ``generator(seed, n)`` returns rows with a unique ``key``;
    ``distance(real, rows)`` returns (key, distance). One bounded set of jobs per
    round, each result written so that no lineage builds up. The report has the
    limit, the rows kept and how many are missing after the last round. Calls that
    differ in ``q`` only can share their batches and distances in one ``measured``.
    """
    measured = {} if measured is None else measured
    first, dist = measured_batch(real, generator, distance, 0, n, measured)
    limit = exact_quantiles(dist, "distance", [q]).first()["distance"]

    def far_enough(batch, d, r):
        return batch.join(d.where(F.col("distance") >= limit), key).withColumn("round", F.lit(r)).drop("distance")

    kept = cut(far_enough(first, dist, 0), "kept")
    have = kept.count()
    for r in range(1, rounds + 1):
        if have >= n:
            break
        fresh = cut(far_enough(*measured_batch(real, generator, distance, r, n, measured), r), "fresh")
        fresh = exact_top(fresh, n - have, [key])
        kept = cut(kept.unionByName(fresh), "kept")
        have = kept.count()
    return kept, {"limit": limit, "kept": have, "missing": max(0, n - have)}


class EmptySampleLimit(RuntimeError):
    """Too many consecutive batches without one valid row."""


def validated_refill(
    generator: Generator, validator: RowValidator, n: int, batch: int, seed, key: str, empty_limit: int = 10,
) -> tuple[DataFrame, dict]:
    """Generate batches, keep valid rows, stop with n of them; returns the sample and its efficiency."""
    kept, have, total, r, empty = None, 0, 0, 0, 0
    while have < n:
        made = cut(generator(r, batch), "batch")
        good = cut(validator.apply(made).withColumn("round", F.lit(r)), "valid")
        found, size = good.count(), made.count()
        total += size
        r += 1
        if not found:
            empty += 1
            if empty >= empty_limit:
                raise EmptySampleLimit(f"{empty_limit} consecutive batches without a valid row")
            continue
        empty = 0
        have += found
        kept = good if kept is None else kept.unionByName(good)
    report = {"generated": total, "valid": have, "efficiency": have / total}
    return exact_sample(kept, n, seed, "round", key), report
