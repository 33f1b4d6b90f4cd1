"""Narrow to wide, rows to sessions, sessions to rows, parents and children."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracekit.operators.ordered import arrange, running
from tracekit.operators.tokens import TARGET_PREFIX
from tracekit.session import col

ZERO = 0.0


def pivot_signals(
    log: DataFrame,
    names: Sequence[str],
    seq: Column | str,
    ts: str = "timestamp",
    name: str = "name",
    value: str = "value",
    keep_all_ts: bool = True,
) -> DataFrame:
    """One row per timestamp, one column per signal; the last occurrence in ``seq`` order wins.

    One hash aggregation with a max-by per signal: partial aggregation absorbs a
    timestamp that holds most rows. A timestamp that only reports other signals
    stays as an all-null row unless ``keep_all_ts`` is off, in which case those
    rows are filtered before the shuffle.
    """
    source = log if keep_all_ts else log.where(F.col(name).isin(*names))
    order = col(seq)
    return source.groupBy(ts).agg(
        *[F.max_by(F.col(value), F.when(F.col(name) == n, order)).alias(n) for n in names]
    )


def columns_to_series(df: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Wide series columns to one array per row and series."""
    used = {c for cols in groups.values() for c in cols}
    return df.select(
        *[c for c in df.columns if c not in used],
        *[F.array(*cols).alias(name) for name, cols in groups.items()],
    )


def series_to_columns(df: DataFrame, groups: Mapping[str, Sequence[str]], flag: str | None = None) -> DataFrame:
    """Arrays back to wide columns; positions past the flagged length are null."""
    used = set(groups) | ({flag} if flag else set())
    length = array_sum(flag) if flag else None

    def cell(name, i):
        value = F.get(F.col(name), i)
        return F.when(i < length, value) if flag else value

    return df.select(
        *[c for c in df.columns if c not in used],
        *[cell(n, i).alias(c) for n, cols in groups.items() for i, c in enumerate(cols)],
    )


def array_sum(c: Column | str) -> Column:
    return F.aggregate(col(c), F.lit(0.0), lambda a, x: a + x)


def padded(arr: Column, length: Column | int, filler: Column) -> Column:
    want = length if isinstance(length, Column) else F.lit(length)
    return F.concat(arr, F.array_repeat(filler, F.greatest(want - F.size(arr), F.lit(0)).cast("int")))


def pack_sessions(df: DataFrame, keys: Sequence[str], feats: Sequence[str], order, max_len: int) -> DataFrame:
    """One row per session: ``feat`` [max_len][features] padded with zeros, ``gen_flag`` [max_len].

    Rows past ``max_len`` are cut as in ``truncate_sessions``: the position is
    found without grouping, so the collected list never exceeds ``max_len``.
    """
    from tracekit.operators.sessions import truncate_sessions

    head = truncate_sessions(df, keys, order, max_len, position="_pos")
    item = F.struct("_pos", F.array(*[F.col(f).cast("double") for f in feats]).alias("x"))
    lists = head.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    zero = F.array(*[F.lit(ZERO) for _ in feats])
    n = F.size("_items")
    return lists.select(
        *keys,
        padded(F.transform("_items", lambda s: s["x"]), max_len, zero).alias("feat"),
        padded(F.array_repeat(F.lit(1.0), n), max_len, F.lit(ZERO)).alias("gen_flag"),
    )


def unpack_sessions(df: DataFrame, feats: Sequence[str], feat: str = "feat", flag: str = "gen_flag") -> DataFrame:
    """One row per flagged step, with its position."""
    keep = [c for c in df.columns if c not in (feat, flag)]
    steps = F.arrays_zip(F.col(feat).alias("x"), F.col(flag).alias("g"))
    rows = df.select(*keep, F.posexplode(steps).alias("pos", "_s")).where(F.col("_s.g") == 1)
    return rows.select(*keep, "pos", *[F.get(F.col("_s.x"), i).alias(f) for i, f in enumerate(feats)])


def pad_to_multiple(df: DataFrame, n: int, feat: str = "feat", flag: str = "gen_flag") -> DataFrame:
    """Lengthen sessions with zeros to the next multiple of n."""
    want = (F.ceil(F.size(flag) / n) * n).cast("int")
    zero = F.transform(F.get(F.col(feat), 0), lambda x: F.lit(ZERO))
    return df.withColumns({feat: padded(F.col(feat), want, zero), flag: padded(F.col(flag), want, F.lit(ZERO))})


def add_gen_flag(df: DataFrame, n: int, feat: str = "feat", flag: str = "gen_flag") -> DataFrame:
    """Append (next flag, its complement inside active blocks of n) to every step."""
    flags = F.col(flag)
    nxt = F.concat(F.slice(flags, 2, F.size(flags) - 1), F.array(F.lit(ZERO)))
    blocks = F.transform(
        F.sequence(F.lit(0), (F.size(flags) / n).cast("int") - 1),
        lambda b: (array_sum(F.slice(flags, b * n + 1, F.lit(n))) > 0.5).cast("double"),
    )
    active = F.flatten(F.transform(blocks, lambda a: F.array_repeat(a, n)))
    pairs = F.zip_with(nxt, active, lambda f, a: F.array(f, (1 - f) * a))
    return df.withColumn(feat, F.zip_with(F.col(feat), pairs, lambda x, p: F.concat(x, p)))


def reverse_gen_flag(flag: Column | str) -> Column:
    """Undo the shift: the first step always exists."""
    f = col(flag)
    return F.concat(F.array(F.lit(1.0)), F.slice(f, 1, F.size(f) - 1))


def trim_flags(flag: Column | str) -> Column:
    """Round, then clear everything from the first 0 on."""
    rounded = F.transform(col(flag), lambda x: F.rint(x))
    first = F.array_position(rounded, F.lit(0.0))
    kept = F.when(first > 0, first - 1).otherwise(F.size(rounded)).cast("int")
    return F.concat(F.slice(rounded, F.lit(1), kept), F.array_repeat(F.lit(ZERO), F.size(rounded) - kept))


def check_sessions_shape(df: DataFrame, widths: Sequence[int], flag_widths: Sequence[int], feat: str = "feat",
                         flag: str = "gen_flag") -> DataFrame:
    """One row of shape facts and a verdict: feature width, equal lengths, one flag pair of width 2."""
    width = F.transform(F.col(feat), lambda x: F.size(x))
    return df.agg(
        F.min(F.array_min(width)).alias("min_width"),
        F.max(F.array_max(width)).alias("max_width"),
        F.min(F.size(flag)).alias("min_len"),
        F.max(F.size(flag)).alias("max_len"),
        F.max((F.size(feat) != F.size(flag)).cast("int")).alias("unequal"),
    ).withColumn(
        "ok",
        (
            (F.col("min_width") == sum(widths)) & (F.col("max_width") == sum(widths))
            & (F.col("min_len") == F.col("max_len")) & (F.col("unequal") == 0)
            & F.lit(list(flag_widths) == [2])
        ).cast("int"),
    )


def split_parent_child(df: DataFrame, keys: Sequence[str], join_on: str) -> tuple[DataFrame, DataFrame]:
    return df.select(*keys, join_on).distinct(), df.drop(*keys)


def collect_children(
    parent: DataFrame, child: DataFrame, join_on: str, order, cols: Sequence[str], max_rows: int = 10_000
) -> DataFrame:
    """Child rows of every parent as arrays; one row per (``join_on``, ``segment``), segment 0 empty when there are none.

    Segments hold ``max_rows`` children each: nothing is lost and no list is unbounded.
    """
    placed = running(arrange(child, order, [join_on]), [join_on], position="_pos")
    placed = placed.withColumn("segment", F.floor(F.col("_pos") / max_rows).cast("int"))
    item = F.struct("_pos", *cols)
    lists = placed.groupBy(join_on, "segment").agg(F.array_sort(F.collect_list(item)).alias("_i"))
    lists = lists.select(
        join_on, "segment", F.transform("_i", lambda s: F.struct(*[s[c].alias(c) for c in cols])).alias("children")
    )
    joined = parent.join(lists, join_on, "left")
    return joined.withColumns(
        {
            "segment": F.coalesce("segment", F.lit(0)),
            "children": F.coalesce("children", F.array().cast(lists.schema["children"].dataType)),
        }
    )


def assemble(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Join column groups of the same rows on their row key."""
    return reduce(lambda a, b: a.join(b, key), parts)


def concat_chunks(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def place_target(df: DataFrame, target: str, where: str = "last", copy_as: str | None = None) -> DataFrame:
    """Move the target last, or put a copy of it first."""
    if where == "last":
        return df.select(*[c for c in df.columns if c != target], target)
    return df.select(F.col(target).alias(copy_as or f"{TARGET_PREFIX}_{target}"), *df.columns)
