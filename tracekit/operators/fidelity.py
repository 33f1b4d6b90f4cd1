"""How close a synthetic table is to the real one.

All metrics work on long count tables (metric, value, real count, synthetic
count), so a whole suite is one aggregation followed by sums over distinct
values.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracekit.functions.codecs import proto_to_int
from tracekit.operators.ordered import arrange, quantiles, running
from tracekit.roles import RoleSpec
from tracekit.session import cut


# ---- long tables ------------------------------------------------------------------------

def stack(df: DataFrame, exprs: Mapping[str, Column | str], dtype: str, keys: Sequence[str] = ()) -> DataFrame:
    """One row per (row, metric): columns ``metric`` and ``value``."""
    cells = [
        F.struct(F.lit(m).alias("metric"), (F.col(e) if isinstance(e, str) else e).cast(dtype).alias("value"))
        for m, e in exprs.items()
    ]
    return df.select(*keys, F.inline(F.array(*cells)))


def paired_counts(real: DataFrame, syn: DataFrame, exprs: Mapping[str, Column | str], dtype: str = "string") -> DataFrame:
    """(metric, value, n_real, n_syn); missing values are left out."""
    both = stack(real, exprs, dtype).withColumn("side", F.lit(0)).unionByName(
        stack(syn, exprs, dtype).withColumn("side", F.lit(1)))
    return both.where(F.col("value").isNotNull()).groupBy("metric", "value").agg(
        F.sum((F.col("side") == 0).cast("bigint")).alias("n_real"),
        F.sum((F.col("side") == 1).cast("bigint")).alias("n_syn"),
    )


def _shares(counts: DataFrame) -> DataFrame:
    totals = counts.groupBy("metric").agg(F.sum("n_real").alias("_tr"), F.sum("n_syn").alias("_ts"))
    return counts.join(F.broadcast(totals), "metric").select(  # one row per metric
        "metric", "value", (F.col("n_real") / F.col("_tr")).alias("p"), (F.col("n_syn") / F.col("_ts")).alias("q"))


def js_from_counts(counts: DataFrame, base: float | None = None, distance: bool = False) -> DataFrame:
    """Jensen-Shannon divergence per metric; a value of one side only has share 0 on the other."""
    m = (F.col("p") + F.col("q")) / 2
    term = lambda x: F.when(x > 0, x * F.log(x / m)).otherwise(0.0)
    js = F.sum(term(F.col("p")) + term(F.col("q"))) / 2 / (math.log(base) if base else 1.0)
    js = F.greatest(js, F.lit(0.0))
    return _shares(counts).groupBy("metric").agg((F.sqrt(js) if distance else js).alias("value"))


def tv_from_counts(counts: DataFrame) -> DataFrame:
    return _shares(counts).groupBy("metric").agg((F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("value"))


def emd_from_counts(counts: DataFrame) -> DataFrame:
    """Earth-mover distance per metric: the area between the two step functions.

    A distinct-value table of a continuous column can be as long as the data, so
    the running counts go through the ordered primitives.
    """
    totals = counts.groupBy("metric").agg(F.sum("n_real").alias("_tr"), F.sum("n_syn").alias("_ts"))
    numeric = counts.withColumn("value", F.col("value").cast("double"))
    run = running(
        arrange(numeric, ["value"], ["metric"]), ["metric"],
        sums={"_cr": "n_real", "_cs": "n_syn"}, lags={"_prev": "value"},
    ).join(F.broadcast(totals), "metric")
    before_real = (F.col("_cr") - F.col("n_real")) / F.col("_tr")
    before_syn = (F.col("_cs") - F.col("n_syn")) / F.col("_ts")
    area = F.abs(before_real - before_syn) * (F.col("value") - F.col("_prev"))
    return run.groupBy("metric").agg(F.sum(F.coalesce(area, F.lit(0.0))).alias("value"))


def rank_counts(real: DataFrame, syn: DataFrame, exprs: Mapping[str, Column | str]) -> DataFrame:
    """Counts by popularity rank instead of by item: the n-th most frequent item of either side is value n."""
    counts = cut(paired_counts(real, syn, exprs), "counts")
    sides = []
    for i, side in enumerate(("n_real", "n_syn")):
        sides.append(counts.where(F.col(side) > 0).select(F.lit(i).alias("side"), "metric", F.col("value").alias("item"), F.col(side).alias("n")))
    both = sides[0].unionByName(sides[1])
    ranked = running(arrange(both, [F.desc("n"), "item"], ["side", "metric"]), ["side", "metric"], position="rank")
    return ranked.groupBy("metric", (F.col("rank") + 1).alias("value")).agg(
        F.coalesce(F.sum(F.when(F.col("side") == 0, F.col("n"))), F.lit(0)).alias("n_real"),
        F.coalesce(F.sum(F.when(F.col("side") == 1, F.col("n"))), F.lit(0)).alias("n_syn"),
    )


# ---- single metrics ---------------------------------------------------------------------

def empirical_cdf(df: DataFrame, c: str) -> DataFrame:
    """(value, cdf) over the distinct values."""
    counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    placed = arrange(counts, ["value"])
    total = placed.agg(F.sum("n")).first()[0]
    return running(placed, (), sums={"_c": "n"}).select("value", (F.col("_c") / F.lit(total)).alias("cdf"))


def js_discrete(real: DataFrame, syn: DataFrame, cols: Sequence[str]) -> DataFrame:
    return js_from_counts(paired_counts(real, syn, {c: c for c in cols}))


def js_distance_base2(real: DataFrame, syn: DataFrame, cols: Sequence[str]) -> DataFrame:
    return js_from_counts(paired_counts(real, syn, {c: c for c in cols}), base=2.0, distance=True)


def auto_bins(real: DataFrame, cols: Sequence[str], approx: bool = False) -> dict[str, tuple[float, float, int]]:
    """(min, max, bins) per column: the smaller width of the Freedman-Diaconis and Sturges rules; ``approx`` takes quartiles from sketches."""
    long = stack(real, {c: c for c in cols}, "double").where(F.col("value").isNotNull())
    facts = {r["metric"]: r for r in long.groupBy("metric").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n")).collect()}
    quartiles: dict[tuple, float] = {
        (r["metric"], r["q"]): r["value"] for r in quantiles(long, "value", [0.25, 0.75], ["metric"], approx).collect()}
    out = {}
    for c in cols:
        f = facts[c]
        span, n = f["hi"] - f["lo"], f["n"]
        if span == 0:
            out[c] = (f["lo"] - 0.5, f["hi"] + 0.5, 1)
            continue
        sturges = span / (math.log2(n) + 1.0)
        fd = 2.0 * (quartiles[c, 0.75] - quartiles[c, 0.25]) / n ** (1.0 / 3.0)
        width = min(fd, sturges) if fd else sturges
        out[c] = (f["lo"], f["hi"], max(math.ceil(span / width), 1))
    return out


def histogram_bin(x: Column, lo: float, hi: float, bins: int) -> Column:
    """Left-closed bin index, last bin closed; -1 below and ``bins`` above the range.

    The quotient only guesses the bin; the comparison with the edges decides.
    """
    edge = lambda i: F.when(i == bins, F.lit(hi)).otherwise(F.lit(lo) + i * ((hi - lo) / bins))
    guess = F.least(F.greatest(F.floor((x - lo) / (hi - lo) * bins), F.lit(0)), F.lit(bins - 1))
    index = F.when(x < edge(guess), guess - 1).when((x >= edge(guess + 1)) & (guess < bins - 1), guess + 1).otherwise(guess)
    return F.when(x < lo, -1).when(x > hi, bins).otherwise(index)


def js_continuous(real: DataFrame, syn: DataFrame, cols: Sequence[str], compat: bool = False, approx: bool = False) -> DataFrame:
    """Divergence of binned columns; synthetic values out of the real range count in two extra bins.

    ``compat`` leaves those values out instead; ``approx`` chooses the bins without sorting values.
    """
    bins = auto_bins(real, cols, approx)
    exprs = {}
    for c in cols:
        lo, hi, k = bins[c]
        b = histogram_bin(F.col(c).cast("double"), lo, hi, k)
        exprs[c] = F.when(b.between(0, k - 1), b) if compat else b
    return js_from_counts(paired_counts(real, syn, exprs, "bigint"))


def earth_mover(real: DataFrame, syn: DataFrame, cols: Mapping[str, Column | str] | Sequence[str]) -> DataFrame:
    exprs = dict(cols) if isinstance(cols, Mapping) else {c: c for c in cols}
    return emd_from_counts(paired_counts(real, syn, exprs, "double"))


def rank_distance(real: DataFrame, syn: DataFrame, cols: Sequence[str], kind: str = "JSD") -> DataFrame:
    counts = rank_counts(real, syn, {c: c for c in cols})
    return js_from_counts(counts) if kind == "JSD" else emd_from_counts(counts)


def _domain_expr(df: DataFrame, c: str, protocol: bool) -> Column:
    if protocol:
        is_text = isinstance(df.schema[c].dataType, T.StringType)
        return proto_to_int(c) if is_text else F.col(c).cast("int")
    return F.least(F.greatest(F.col(c).cast("int"), F.lit(0)), F.lit(65535))


def domain_counts(real: DataFrame, syn: DataFrame, ports: Sequence[str] = (), protos: Sequence[str] = ()) -> DataFrame:
    """Counts over ports (clamped to 0..65535) and protocol numbers; unused values need no rows."""
    sides = []
    for i, df in enumerate((real, syn)):
        exprs = {c: _domain_expr(df, c, c in protos) for c in [*ports, *protos]}
        sides.append(stack(df, exprs, "int").withColumn("side", F.lit(i)))
    both = sides[0].unionByName(sides[1]).where(F.col("value").isNotNull())
    return both.groupBy("metric", "value").agg(
        F.sum((F.col("side") == 0).cast("bigint")).alias("n_real"), F.sum((F.col("side") == 1).cast("bigint")).alias("n_syn"))


def domain_distance(real, syn, ports=(), protos=(), kind: str = "TV") -> DataFrame:
    counts = domain_counts(real, syn, ports, protos)
    if kind == "freq":
        return _shares(counts).select("metric", "value", F.col("p").alias("real"), F.col("q").alias("synthetic"))
    return tv_from_counts(counts) if kind == "TV" else js_from_counts(counts)


# ---- suites -----------------------------------------------------------------------------

def _suite(real: DataFrame, syn: DataFrame, time: str, numeric: Sequence[str], sessions: Sequence[str] = ()) -> DataFrame:
    ranks = rank_distance(real, syn, ["srcip", "dstip"]).withColumn("kind", F.lit("rank_jsd"))
    domains = domain_distance(real, syn, ["srcport", "dstport"], ["proto"], "JSD").withColumn("kind", F.lit("jsd"))
    starts = {}
    for name, df in (("real", real), ("syn", syn)):
        starts[name] = df.agg(F.min(time)).first()[0]
    counts = paired_counts(
        real.withColumn(time, F.col(time) - F.lit(starts["real"])),
        syn.withColumn(time, F.col(time) - F.lit(starts["syn"])),
        {c: c for c in [time, *numeric]}, "double")
    if sessions:
        sizes = [d.groupBy(*sessions).agg(F.count(F.lit(1)).cast("double").alias("flow_size")) for d in (real, syn)]
        counts = counts.unionByName(paired_counts(sizes[0], sizes[1], {"flow_size": "flow_size"}, "double"))
    moved = emd_from_counts(counts).withColumn("kind", F.lit("emd"))
    return ranks.unionByName(domains).unionByName(moved)


def flow_suite(real: DataFrame, syn: DataFrame) -> DataFrame:
    return _suite(real, syn, "ts", ["td", "pkt", "byt"])


def connection_log_suite(real: DataFrame, syn: DataFrame) -> DataFrame:
    return _suite(real, syn, "ts", ["duration", "orig_bytes", "resp_bytes", "missed_bytes", "orig_pkts",
                                    "orig_ip_bytes", "resp_pkts", "resp_ip_bytes"])


def packet_suite(real: DataFrame, syn: DataFrame) -> DataFrame:
    return _suite(real, syn, "time", ["pkt_len"], ["srcip", "dstip", "srcport", "dstport", "proto"])


# ---- associations -----------------------------------------------------------------------

def associations(df: DataFrame, numeric: Sequence[str], nominal: Sequence[str]) -> DataFrame:
    """(a, b, value) for every pair: Pearson, Cramer's V without bias correction, correlation ratio."""
    spark = df.sparkSession
    cols = [*numeric, *nominal]
    same = spark.createDataFrame([(c, c, 1.0) for c in cols], "a string, b string, value double")
    parts = [same]
    pairs = [(a, b) for i, a in enumerate(numeric) for b in numeric[i + 1:]]
    if pairs:
        row = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
        parts.append(row.select(F.inline(F.array(*[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.coalesce(F.col(f"c{i}"), F.lit(0.0)).alias("value"))
            for i, (a, b) in enumerate(pairs)]))))
    pairs = [(a, b) for i, a in enumerate(nominal) for b in nominal[i + 1:]]
    if pairs:
        parts.append(_cramers_v(df, pairs))
    mixed = [(a, b) for a in nominal for b in numeric]
    if mixed:
        parts.append(_correlation_ratio(df, mixed))
    upper = parts[0]
    for p in parts[1:]:
        upper = upper.unionByName(p)
    mirror = upper.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "value")
    return upper.unionByName(mirror)


def _cramers_v(df: DataFrame, pairs) -> DataFrame:
    cell = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y"))
            for a, b in pairs]
    n = df.select(F.inline(F.array(*cell))).where("x is not null and y is not null").groupBy("a", "b", "x", "y").agg(
        F.count(F.lit(1)).alias("n"))
    rows = n.groupBy("a", "b", "x").agg(F.sum("n").alias("nx"))
    cols = n.groupBy("a", "b", "y").agg(F.sum("n").alias("ny"))
    total = n.groupBy("a", "b").agg(F.sum("n").alias("t"), F.count_distinct("x").alias("r"), F.count_distinct("y").alias("c"))
    full = n.join(rows, ["a", "b", "x"]).join(cols, ["a", "b", "y"]).join(F.broadcast(total), ["a", "b"])  # one row per pair
    # chi-square over t equals sum(n^2 / (nx ny)) - 1, so empty cells need no rows
    phi2 = F.sum(F.col("n") * F.col("n") / (F.col("nx") * F.col("ny"))) - 1
    least = F.least(F.first("r"), F.first("c")) - 1
    return full.groupBy("a", "b").agg(
        F.when(least > 0, F.sqrt(F.greatest(phi2, F.lit(0.0)) / least)).otherwise(0.0).alias("value"))


def _correlation_ratio(df: DataFrame, pairs) -> DataFrame:
    cell = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("string").alias("x"), F.col(b).cast("double").alias("y"))
            for a, b in pairs]
    groups = df.select(F.inline(F.array(*cell))).where("x is not null and y is not null").groupBy("a", "b", "x").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("m"), F.var_pop("y").alias("v"))
    t = F.sum("n")
    facts = groups.groupBy("a", "b").agg(
        (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.sum(F.col("n") * F.col("m")) * F.sum(F.col("n") * F.col("m")) / t).alias("between"),
        F.sum(F.col("n") * F.col("v")).alias("within"))
    ratio = F.col("between") / (F.col("between") + F.col("within"))
    return facts.select("a", "b", F.when(F.col("between") + F.col("within") > 0, F.sqrt(F.greatest(ratio, F.lit(0.0)))).otherwise(0.0).alias("value"))


def association_distance(real: DataFrame, syn: DataFrame, numeric: Sequence[str], nominal: Sequence[str]) -> DataFrame:
    """Frobenius norm of the difference of the two association matrices."""
    a = associations(real, numeric, nominal).withColumnRenamed("value", "_r")
    b = associations(syn, numeric, nominal).withColumnRenamed("value", "_s")
    diff = F.col("_r") - F.col("_s")
    return a.join(b, ["a", "b"]).agg(F.sqrt(F.sum(diff * diff)).alias("value"))


def column_summary(real: DataFrame, syn: DataFrame, numeric: Sequence[str], nominal: Sequence[str]) -> DataFrame:
    """Mean earth-mover distance (scaled by the real range), mean base-2 JS distance, association distance."""
    from tracekit.operators.encoders import fit_ranges, normalize

    ranges = fit_ranges(real, numeric, eps=0.0)
    moved = earth_mover(real, syn, {c: normalize(c, ranges[c]) for c in numeric}).agg(F.avg("value").alias("value"))
    js = js_distance_base2(real, syn, nominal).agg(F.avg("value").alias("value"))
    parts = (("mean_emd", moved), ("mean_js", js), ("association", association_distance(real, syn, numeric, nominal)))
    out = None
    for name, part in parts:
        row = part.select(F.lit(name).alias("metric"), "value")
        out = row if out is None else out.unionByName(row)
    return out


# ---- reports and choice -----------------------------------------------------------------

def fidelity_report(real: DataFrame, syn: DataFrame, roles: RoleSpec, with_sessions: bool = False) -> DataFrame:
    """(metric_type, field, value): JS for discrete fields, earth-mover distance for the others."""
    kind = {**{c: "attribute" for c in roles.metadata}, **{c: "feature" for c in roles.timeseries}}
    if roles.timestamp:
        kind[roles.timestamp] = "timestamp"
    discrete = [c for c in kind if c in roles.discrete]
    continuous = [c for c in kind if c not in roles.discrete]
    counts = paired_counts(real, syn, {c: c for c in continuous}, "double") if continuous else None
    if with_sessions:
        sizes = [d.groupBy(*roles.metadata).agg(F.count(F.lit(1)).cast("double").alias("session_length")) for d in (real, syn)]
        lengths = paired_counts(sizes[0], sizes[1], {"session_length": "session_length"}, "double")
        counts = lengths if counts is None else counts.unionByName(lengths)
        kind["session_length"] = "session length"
    parts = [js_discrete(real, syn, discrete)] if discrete else []
    if counts is not None:
        parts.append(emd_from_counts(counts))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    types = F.create_map(*[F.lit(x) for kv in kind.items() for x in kv])
    return out.select(types[F.col("metric")].alias("metric_type"), F.col("metric").alias("field"), "value")


def average_ranks(scores: DataFrame, within: Sequence[str], value: str, candidate: str, name: str = "rank") -> DataFrame:
    """Average-tie ranks: candidates are few, so a window per metric is small."""
    from pyspark.sql import Window

    ordered = Window.partitionBy(*within).orderBy(value)
    ties = Window.partitionBy(*within, value)
    return scores.withColumn(name, F.rank().over(ordered) + (F.count(F.lit(1)).over(ties) - 1) / 2)


def choose_best(scores: DataFrame, within: Sequence[str] = (), candidate: str = "candidate", metric: str = "metric",
                value: str = "value") -> DataFrame:
    """The candidate with the smallest sum of ranks per (group, chunk); the first name wins a tie."""
    ranked = average_ranks(scores, [*within, metric], value, candidate)
    sums = ranked.groupBy(*within, candidate).agg(F.sum("rank").alias("rank_sum"))
    best = F.min_by(F.struct(candidate, "rank_sum"), F.struct("rank_sum", candidate)).alias("b")
    return sums.groupBy(*within).agg(best).select(*within, f"b.{candidate}", "b.rank_sum")


def collect_best(candidates: DataFrame, best: DataFrame, within: Sequence[str], candidate: str = "candidate") -> DataFrame:
    """The rows of the chosen candidates of all chunks as one table."""
    return candidates.join(best.select(*within, candidate), [*within, candidate], "left_semi")
