"""Sessions, time chunks, inter-arrival times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracekit.operators.ordered import arrange, drop_marks, ordered_position, running
from tracekit.session import col, fraction


def sessionize_count(
    df: DataFrame, keys: Sequence[str], order, n: int, name: str = "session_id", buckets: int | None = None
) -> DataFrame:
    """Every n consecutive rows of a key are a session; ids are dense, by key then position.

    One sort by (keys, order) gives the row number inside each key; every n-th
    row opens a session, and the running count of openings is the session id.
    """
    placed = running(arrange(df, order, keys, buckets), keys, position="_rn", filtered=True)
    opened = placed.withColumn("_open", (F.col("_rn") % n == 0).cast("bigint"))
    ids = running(opened, (), sums={name: "_open"}).withColumn(name, F.col(name) - 1)
    return ids.select(*df.columns, name)


def _spaced(lo: float, hi: float, k: int) -> list[float]:
    """k + 1 evenly spaced edges; multiples of one step, so that values on a decimal grid fall as expected."""
    step = (hi - lo) / k
    return [lo + i * step for i in range(k)] + [hi]


def bin_edges(lo: float, hi: float, k: int) -> list[float]:
    """Edges of k equal bins; the first is lowered by 0.1% of the range. A constant column gets a small range."""
    if lo == hi:
        pad = 0.001 * abs(lo) if lo != 0 else 0.001
        lo, hi = lo - pad, hi + pad
        return _spaced(lo, hi, k)
    edges = _spaced(lo, hi, k)
    edges[0] = lo - (hi - lo) * 0.001
    return edges


def bin_of(c: Column | str, edges: Sequence[float]) -> Column:
    """Right-closed bin index by comparing with the explicit edges (bins are few)."""
    x = col(c).cast("double")
    below = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < x))
    return F.when(x.isNotNull(), F.greatest(below - 1, F.lit(0)))


def equal_width_bin(df: DataFrame, c: str, k: int, name: str) -> tuple[DataFrame, list[float]]:
    lo, hi = df.agg(F.min(c).cast("double"), F.max(c).cast("double")).first()
    edges = bin_edges(lo, hi, k)
    return df.withColumn(name, bin_of(c, edges)), edges


def sessionize_binned(df: DataFrame, c: str, n_bins: int, keys: Sequence[str], order, n: int) -> DataFrame:
    binned, _ = equal_width_bin(df, c, n_bins, f"{c}_binned")
    return sessionize_count(binned, [f"{c}_binned", *keys], order, n)


def sample_from_bin(c: Column | str, edges: Sequence[float], u: Column) -> Column:
    """A value inside the bin for u in [0, 1); null for a bin that does not exist."""
    arr = F.array(*[F.lit(float(e)) for e in edges])
    i = col(c).cast("int")
    lo, hi = F.get(arr, i), F.get(arr, i + 1)
    return F.when(i.between(0, len(edges) - 2), lo + u * (hi - lo))


def check_sessions(df: DataFrame, keys: Sequence[str], session: str = "session_id") -> DataFrame:
    """Distinct sessions, highest id plus one, and (session, key) groups: all equal when sound."""
    groups = df.groupBy(session, *keys).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.count_distinct(session).alias("n_sessions"),
        (F.max(session) + 1).alias("total"),
        F.count(F.lit(1)).alias("n_groups"),
    ).withColumn("ok", ((F.col("n_sessions") == F.col("total")) & (F.col("total") == F.col("n_groups"))).cast("int"))


def group_sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))


def group_summary(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(number of groups and largest size, the ten largest groups)."""
    sizes = group_sizes(df, keys)
    facts = sizes.agg(F.count(F.lit(1)).alias("n_groups"), F.max("size").alias("max_size"))
    return facts, sizes.orderBy(F.desc("size"), *keys).limit(10)


def chunk_fixed_size(df: DataFrame, order, n: int, name: str = "chunk") -> DataFrame:
    """n chunks of equal row count in time order."""
    placed = arrange(df, order)
    rows = placed.count()
    out = running(placed, (), position="_pos")
    per_chunk = max(-(-rows // n), 1)
    return out.select(*df.columns, F.floor(F.col("_pos") / per_chunk).cast("int").alias(name))


def time_edges(lo: float, hi: float, n: int) -> list[float]:
    edges = _spaced(lo, hi, n)
    edges[-1] *= 1 + 1e-5
    return edges


def chunk_fixed_time(df: DataFrame, ts: str, n: int, name: str = "chunk", dense_ids: bool = False) -> DataFrame:
    """n chunks of equal time span (left-closed); ``dense_ids`` renumbers past empty chunks."""
    lo, hi = df.agg(F.min(ts).cast("double"), F.max(ts).cast("double")).first()
    edges = F.array(*[F.lit(e) for e in time_edges(lo, hi, n)])
    x = F.col(ts).cast("double")
    out = df.withColumn(name, F.size(F.filter(edges, lambda e: e <= x)) - 1)
    if dense_ids:
        used = sorted(r[0] for r in out.select(name).distinct().collect())  # at most n values
        out = out.withColumn(name, F.array_position(F.array(*[F.lit(u) for u in used]), F.col(name)).cast("int") - 1)
    return out


def chunk_index(df: DataFrame, keys: Sequence[str], chunk: str = "chunk") -> DataFrame:
    """Per session the sorted chunks it appears in (at most one entry per chunk)."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set(chunk)).alias("chunks"))


def _evenly_spaced(chunks: Column) -> Column:
    steps = F.zip_with(F.slice(chunks, 2, F.size(chunks)), F.slice(chunks, 1, F.size(chunks) - 1), lambda b, a: b - a)
    return F.size(F.array_distinct(steps)) <= 1


def chunk_stats(index: DataFrame) -> DataFrame:
    c = F.col("chunks")
    return index.agg(
        F.count(F.lit(1)).alias("n_sessions"),
        F.sum((F.size(c) > 1).cast("bigint")).alias("n_cross"),
        F.sum((~_evenly_spaced(c)).cast("bigint")).alias("n_gapped"),
    )


def max_session_len(df: DataFrame, keys: Sequence[str], chunk: str = "chunk", configured: int | None = None) -> DataFrame:
    longest = F.max("size")
    if configured is not None:
        longest = F.least(longest, F.lit(configured))
    return group_sizes(df, [chunk, *keys]).agg(longest.cast("bigint").alias("max_len"))


def truncate_sessions(df: DataFrame, keys: Sequence[str], order, length: int, position: str | None = None) -> DataFrame:
    """The first ``length`` rows of each session."""
    placed = ordered_position(df, order, keys, name="_tp").where(F.col("_tp") < length)
    return placed.withColumnRenamed("_tp", position) if position else placed.drop("_tp")


def encode_interarrival(
    df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], buckets: int | None = None
) -> DataFrame:
    """Add ``flow_start`` and ``interarrival`` (0 for the first row of a session)."""
    order = [ts, *tie]
    moved = running(arrange(df, order, keys, buckets), keys, lags={"_prev": ts}, firsts={"flow_start": ts})
    gap = F.col(ts) - F.coalesce("_prev", ts)
    return moved.withColumn("interarrival", gap).select(*df.columns, "flow_start", "interarrival")


def encode_raw_time(df: DataFrame, ts: str, chunk: str, name: str) -> DataFrame:
    """Timestamp scaled to [0, 1] inside its time chunk; the few chunk ranges are joined back."""
    ranges = df.groupBy(chunk).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    unit = F.when(span == 0, F.lit(0.0)).otherwise((F.col(ts) - F.col("_lo")) / F.when(span != 0, span))
    return df.join(ranges, chunk).select(*df.columns, unit.alias(name))


def decode_interarrival(df: DataFrame, keys: Sequence[str], pos: str, start: str, gap: str, name: str = "ts") -> DataFrame:
    """start + cumulative gaps; the first row is the start itself."""
    summed = drop_marks(running(arrange(df, [pos], keys), keys, position="_p", sums={"_sum": gap}))
    offset = F.when(F.col("_p") == 0, F.lit(0.0)).otherwise(F.col("_sum"))
    return summed.select(*df.columns, (F.col(start) + offset).alias(name))


def session_duration(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.max(ts) - F.min(ts)).alias("duration"))


def tag_sessions(index: DataFrame, n: int, variant: str = "v1") -> DataFrame:
    """One row per (session, chunk it appears in): does it start here, and presence per chunk.

    v1 clears the presence flags of sessions that started earlier, v2 keeps them.
    """
    if variant not in ("v1", "v2"):
        raise ValueError(f"unknown variant {variant}")
    here = index.select("*", F.explode("chunks").alias("chunk"))
    starts = F.col("chunk") == F.get("chunks", 0)
    shown = starts if variant == "v1" else F.lit(True)
    presence = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (F.array_contains(F.col("chunks"), i) & shown).cast("int")
    )
    return here.select(*index.columns, "chunk", starts.cast("int").alias("starts_here"), presence.alias("present"))


def propagate_sessions(tagged: DataFrame, n: int) -> DataFrame:
    """Sessions starting in their chunk stay, and a copy goes to each later chunk they are present in."""
    own = tagged.where((F.col("starts_here") == 1) & (F.get("present", F.col("chunk")) == 1))
    later = F.filter(
        F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i > F.col("chunk")) & (F.get(F.col("present"), i) == 1)
    )
    copies = own.withColumn("_to", later).withColumn("chunk", F.explode("_to")).drop("_to")
    return own.unionByName(copies.withColumn("starts_here", F.lit(0)))


def dedupe_sessions(df: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    """Keep the first session row of each repeated key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(row_id)).alias("_r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def relative_time(df: DataFrame, ts: str) -> DataFrame:
    start = df.agg(F.min(ts)).first()[0]
    return df.withColumn(ts, F.col(ts) - F.lit(start))


def order_output(df: DataFrame, ts: str, *tie: str) -> DataFrame:
    return df.orderBy(ts, *tie)


def restore_binned(df: DataFrame, binned: str, edges: Sequence[float], name: str, seed, *keys: str) -> DataFrame:
    return df.withColumn(name, sample_from_bin(binned, edges, fraction(seed, *keys)))
