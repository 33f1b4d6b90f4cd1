"""Distances from synthetic rows to real ones, and what they say about copying."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracekit.operators.clean import duplicate_rate
from tracekit.operators.embedding import reduce_widths
from tracekit.operators.encoders import fit_choices, fit_moments, fit_ranges, normalize, one_hot, standardize
from tracekit.operators.nearest import nearest
from tracekit.operators.ordered import arrange, exact_quantiles, quantiles, running
from tracekit.operators.sampling import bootstrap_rounds, measured_batch, percent_sample, privacy_refill
from tracekit.session import cut


def vector_rows(df: DataFrame, key: str, vec: str = "vec", *more: str) -> DataFrame:
    return df.select(F.col(key).alias("id"), F.col(vec).alias("vec"), *more)


def distance_to_closest(original: DataFrame, synthetic: DataFrame, metric="l1") -> DataFrame:
    """(id, distance) per synthetic row; both tables are (id, vec)."""
    return nearest(synthetic, original, k=1, metric=metric).select("id", "distance")


def scaled_vectors(
    real: DataFrame, others: Sequence[DataFrame], numeric: Sequence[str], categorical: Sequence[str], key: str
) -> list[DataFrame]:
    """(id, vec): numeric columns scaled by the real range, one-hot categories worth 1 per mismatch."""
    ranges = fit_ranges(real, numeric, eps=0.0)
    choices = {}
    if categorical:
        choices = fit_choices(real, categorical)
    half = 1 / math.sqrt(2)
    parts = [F.array(*[normalize(c, ranges[c]) for c in numeric])]
    parts += [one_hot(c, choices[c], half) for c in categorical]
    vec = F.concat(*parts)
    return [d.select(F.col(key).alias("id"), vec.alias("vec")) for d in (real, *others)]


def closest_two(real_vec: DataFrame, syn_vec: DataFrame) -> DataFrame:
    """(id, d1, d2): nearest and second nearest real row of each synthetic row."""
    near = nearest(syn_vec, real_vec, k=2, metric="l2")
    return near.groupBy("id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("distance"))).alias("d1"),
        F.max(F.when(F.col("rank") == 2, F.col("distance"))).alias("d2"))


def median_closest(distances: DataFrame, approx: bool = False) -> DataFrame:
    """The median distance: exact, or from a sketch without a sort."""
    return quantiles(distances, "distance", [0.5], approx=approx).select(F.col("distance").alias("median"))


def six_numbers(
    real: DataFrame, syn: DataFrame, numeric: Sequence[str], key: str, percent: float | None = None, seed=42
) -> DataFrame:
    """5th percentiles of the closest distance and of the nearest/second-nearest ratio.

    For real rows against synthetic ones and inside each table. Rows with a
    duplicate are left out, and each side is scaled by its own mean and spread.
    ``percent`` asks for a sample of that share of either table.
    """
    vecs = {}
    for name, df in (("r", real), ("f", syn)):
        values = df.groupBy(*numeric).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
        if percent is not None:
            values = percent_sample(values, percent, seed, key)
        values = cut(values, "sample")
        m = fit_moments(values, numeric)
        vecs[name] = values.select(F.col(key).alias("id"), F.array(*[standardize(c, m[c]) for c in numeric]).alias("vec"))
    long = None
    for kind, a, b in (("rf", "r", "f"), ("rr", "r", "r"), ("ff", "f", "f")):
        near = nearest(vecs[a], vecs[b], k=2, metric="l2", exclude_self=a == b)
        two = near.groupBy("id").agg(
            F.max(F.when(F.col("rank") == 1, F.col("distance"))).alias("d1"),
            F.max(F.when(F.col("rank") == 2, F.col("distance"))).alias("d2"))
        both = two.select(F.inline(F.array(
            F.struct(F.lit(f"dcr_{kind}").alias("metric"), F.col("d1").alias("value")),
            F.struct(F.lit(f"nndr_{kind}").alias("metric"), F.when(F.col("d2") != 0, F.col("d1") / F.col("d2")).alias("value")))))
        long = both if long is None else long.unionByName(both)
    return exact_quantiles(long, "value", [0.05], ["metric"]).select("metric", "value")


# ---- sensitivity ------------------------------------------------------------------------

def minima(
    original: DataFrame, synthetic: DataFrame, test: DataFrame, metric="l1", by: str | None = None, max_col_nums: int | None = 50,
    directions: np.ndarray | None = None,
) -> DataFrame:
    """(by, kind, distance): closest distances of originals to test and synthetic rows, and back.

    Originals that have an exact copy in both other tables are left out. Vectors of ``max_col_nums`` dimensions or more
    are first projected on the leading directions of the originals (None: never), or on ``directions`` if given.
    """
    keys = [by] if by else []
    original, synthetic, test = reduce_widths(original, [synthetic, test], "vec", max_col_nums, directions)
    # the four directions are four groups of one nearest-neighbour join
    queries, refs = None, None
    for way, a, b in (("to test", original, test), ("to synthetic", original, synthetic),
                      ("from test", test, original), ("from synthetic", synthetic, original)):
        tag = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(way)).alias("way")
        q, r = a.select("id", "vec", tag), b.select("id", "vec", tag)
        queries = q if queries is None else queries.unionByName(q)
        refs = r if refs is None else refs.unionByName(r)
    found = cut(nearest(queries, refs, k=1, metric=metric, group="way").select("way", "id", "distance"), "ways")
    found = found.withColumn("_dir", F.element_at(F.split("way", r"\|"), -1))
    if by:
        found = found.withColumn(by, F.get(F.split("way", r"\|"), 0))
    back = found.where(F.col("_dir").startswith("from")).select(
        *keys, F.element_at(F.split("_dir", " "), -1).alias("kind"), "distance")
    there = found.where(F.col("_dir").startswith("to")).select(*keys, "id", F.element_at(F.split("_dir", " "), -1).alias("kind"), "distance")
    return _both_ways(there, back, keys)


def _both_ways(there: DataFrame, back: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distances from originals (keys, id, kind, distance), but for those that are 0 both ways, and back to them."""
    rows = there.groupBy(*keys, "id").agg(*[F.max(F.when(F.col("kind") == k, F.col("distance"))).alias(k[0]) for k in ("test", "synthetic")])
    there = rows.where((F.col("t") != 0) | (F.col("s") != 0)).select(*keys, F.inline(F.array(
        F.struct(F.lit("test").alias("kind"), F.col("t").alias("distance")),
        F.struct(F.lit("synthetic").alias("kind"), F.col("s").alias("distance")))))
    return there.unionByName(back.select(*keys, "kind", "distance"))


def _share_below(values: DataFrame, limits: DataFrame, by: Sequence[str]) -> DataFrame:
    """For each (by, q, limit): the share of values <= limit, by one sort of both tables together."""
    counts = values.groupBy(*by, F.col("distance").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    both = counts.select(*by, "x", F.lit(0).alias("k"), F.lit(0.0).alias("q"), "n").unionByName(
        limits.select(*by, F.col("limit").alias("x"), F.lit(1).alias("k"), "q", F.lit(0).cast("bigint").alias("n")))
    run = running(arrange(both, ["x", "k", "q"], by), by, sums={"_c": "n"}).where("k = 1")
    if not by:
        total = values.count()
        return run.select("q", (F.col("_c") / F.lit(total)).alias("share"))
    totals = values.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    return run.join(totals, by).select(*by, "q", (F.col("_c") / F.col("_n")).alias("share"))


def sensitivity(mins: DataFrame, qt_max: float = 0.05, qt_interval: int = 1000, by: str | None = None) -> DataFrame:
    """Mean over a quantile grid of (share of synthetic minima <= test quantile) - quantile."""
    keys = [by] if by else []
    grid = [qt_max] if qt_interval <= 1 else [qt_max * i / (qt_interval - 1) for i in range(qt_interval)]
    limits = exact_quantiles(mins.where("kind = 'test'"), "distance", grid, keys).withColumnRenamed("distance", "limit")
    share = _share_below(mins.where("kind = 'synthetic'").select(*keys, "distance"), limits, keys)
    score = F.avg(F.col("share") - F.col("q")) if qt_interval > 1 else F.avg("share")
    return share.groupBy(*keys).agg(score.alias("statistic"))


def tail_ks(mins: DataFrame, qt_max: float = 0.05) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic of the lower tails."""
    limits = exact_quantiles(mins, "distance", [qt_max], ["kind"]).select("kind", F.col("distance").alias("_l"))
    tail = mins.join(F.broadcast(limits), "kind").where(F.col("distance") <= F.col("_l"))  # two rows
    counts = tail.groupBy("distance").agg(
        F.sum((F.col("kind") == "test").cast("bigint")).alias("a"), F.sum((F.col("kind") == "synthetic").cast("bigint")).alias("b"))
    run = running(arrange(counts, ["distance"]), (), sums={"ca": "a", "cb": "b"})
    ta, tb = run.agg(F.max("ca"), F.max("cb")).first()
    return run.agg(F.max(F.abs(F.col("ca") / F.lit(ta) - F.col("cb") / F.lit(tb))).alias("statistic"))


def sensitivity_settings(
    df: DataFrame, columns: Sequence[str], frac: float = 0.165, max_rows: int | None = None, qt_max: float | str = 0.05,
    qt_default: float = 0.05, qt_interval: int = 1000, qt_interval_unique: int = 100, full: bool = True,
) -> dict:
    """Sample share, quantile cap and grid size adapted to the table; ``max_rows`` asks for a smaller sample."""
    rows = df.count()
    rate = duplicate_rate(df.select(*columns)).first()[0]
    if max_rows:
        frac = min(frac, max_rows / rows)
    if qt_max == "compute":
        qt_max = rate / 2 if rate > 0 else qt_default
    if rate == 0:
        qt_interval = qt_interval_unique
    if not full:
        qt_interval = int(max(min(qt_interval, (2 * frac * rows * qt_max) // 2), 2))
    return {"frac": frac, "duplicate_rate": rate, "qt_max": qt_max, "qt_interval": qt_interval}


#: Which roles a row looks for the nearest row of, by its own.
SOUGHT = {"original": ("test", "synthetic"), "test": ("original",), "synthetic": ("original",)}
DEEPEST = 1024  # entries of a neighbour list; rarer roles are searched for among their own rows


def _first_of_role(rounds: int):
    """Per row and round the first list entry of each role it looks for; a null distance if the list has none."""
    letters = {role[0]: [want[0] for want in wants] for role, wants in SOUGHT.items()}

    def run(batches):
        for pdf in batches:
            parts = []
            for row, own, distances, held in zip(pdf["id"], pdf["flags"], pdf["distances"], pdf["held"]):
                mine = np.frombuffer(own.encode(), dtype="S1")
                theirs = np.frombuffer("".join(held).encode(), dtype="S1").reshape(-1, rounds) if held is not None else np.zeros((0, rounds), dtype="S1")
                for role, wants in letters.items():
                    at = np.flatnonzero(mine == role.encode())
                    for want in wants if len(at) else ():
                        hit = theirs[:, at] == want.encode()
                        near = np.full(len(at), np.nan)
                        if len(theirs):
                            some = hit.any(axis=0)
                            near[some] = np.asarray(distances, dtype=np.float64)[hit.argmax(axis=0)[some]]
                        parts.append(pd.DataFrame({"id": [row] * len(at), "round": at.astype(np.int32), "role": role, "want": want, "distance": near}))
            if parts:
                yield pd.concat(parts, ignore_index=True)

    return run


def round_minima(vectors: DataFrame, roles: DataFrame, rounds: int, metric="l1", depth: int = 32) -> DataFrame:
    """(round, kind, distance) as ``minima`` gives it per round, for rows (id, vec) that play a role (id, round, role) in it.

    Every row gets one list of its ``depth`` nearest rows, whatever their role. A round only looks up who plays
    which role: the first entry of the wanted role is the closest. Rows whose list holds none for some round get one that is
    eight times as long, and roles so rare that ``DEEPEST`` entries hold none are searched for among their own rows. So
    the number of searches does not depend on the number of rounds. A role that nobody plays in a round gives no distances.
    """
    letter = F.map_from_entries(F.collect_list(F.struct("round", F.substring("role", 1, 1))))
    flags = roles.groupBy("id").agg(letter.alias("by_round"))
    flags = cut(flags.select("id", F.array_join(F.transform(
        F.sequence(F.lit(0), F.lit(rounds - 1)), lambda r: F.coalesce(F.element_at("by_round", r), F.lit("-"))), "").alias("flags")), "flags")
    pool = cut(vectors.select("id", "vec").join(flags, "id"), "pool")
    kind = pool.schema["id"].dataType.simpleString()
    held = pool.select(F.col("id").alias("ref_id"), F.col("flags").alias("held"))
    asking, left, done = pool, None, None
    while True:
        near = nearest(asking.select("id", "vec"), pool.select("id", "vec"), k=depth, metric=metric, exclude_self=True)
        lists = near.join(held, "ref_id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "distance", "held"))).alias("near"))
        lists = asking.select("id", "flags").join(lists, "id", "left").select("id", "flags", F.col("near.distance").alias("distances"), F.col("near.held").alias("held"))
        found = lists.mapInPandas(_first_of_role(rounds), f"id {kind}, round int, role string, want string, distance double")
        found = found.withColumn("distance", F.when(~F.isnan("distance"), F.col("distance")))
        if left is not None:
            found = found.join(left.select("id", "round", "want"), ["id", "round", "want"], "left_semi").select(*found.columns)
        found = cut(found, "lists")
        left = found.where("distance is null")
        known = found.where("distance is not null")
        done = known if done is None else done.unionByName(known)
        if left.isEmpty():
            break
        if depth >= DEEPEST:
            way = F.concat_ws("|", "round", "want").alias("way")
            queries = left.join(pool.select("id", "vec"), "id").select("id", "vec", way)
            plays = roles.select("id", "round", F.substring("role", 1, 1).alias("want")).select("id", way)
            refs = plays.join(queries.select("way").distinct(), "way", "left_semi").join(pool.select("id", "vec"), "id").select("id", "vec", "way")
            rare = nearest(queries, refs, k=1, metric=metric, group="way").select("id", "way", "distance")
            done = done.unionByName(left.drop("distance").withColumn("way", way).join(cut(rare, "rare"), ["id", "way"]).drop("way"))
            break
        depth = min(8 * depth, DEEPEST)
        asking = pool.join(left.select("id").distinct(), "id", "left_semi").select(*pool.columns)
    names = F.create_map(*[F.lit(x) for role in SOUGHT for x in (role[0], role)])
    there = done.where("role = 'o'").select("round", "id", names[F.col("want")].alias("kind"), "distance")
    back = done.where("role <> 'o'").select("round", names[F.col("role")].alias("kind"), "distance")
    return _both_ways(there, back, ["round"])


def bootstrap_statistics(
    vectors: DataFrame, rounds: int, frac: float, seed, qt_max: float = 0.05, qt_interval: int = 1000, metric="l1",
    full: bool = True, max_col_nums: int | None = 50,
) -> DataFrame:
    """(round, statistic): the sensitivity of random splits of the real table (id, vec), all rounds from one set of neighbour lists.

    Vectors of ``max_col_nums`` dimensions or more are projected once, on directions fitted on the whole table.
    """
    vectors = cut(reduce_widths(vectors.select("id", "vec"), [], "vec", max_col_nums)[0], "vectors")
    roles = cut(bootstrap_rounds(vectors.select("id"), rounds, frac, seed, "id", full=full).select("id", "round", "role"), "rounds")
    # lists of this length hold all roles of a row's rounds for 19 rows in 20
    share = frac if full else 2 * frac
    depth = math.ceil(math.log(40 * rounds) / -math.log1p(-share)) if 0 < share < 1 else 32
    mins = round_minima(vectors, roles, rounds, metric, min(max(depth, 8), DEEPEST))
    return sensitivity(mins, qt_max, qt_interval, by="round").withColumn("round", F.col("round").cast("int"))


def sensitivity_threshold(statistics: DataFrame, quantile: float = 0.95) -> DataFrame:
    return exact_quantiles(statistics, "statistic", [quantile]).select(F.col("statistic").alias("threshold"))


def privacy_sweep(
    real: DataFrame, generator: Callable[[int, int], DataFrame], distance: Callable, score: Callable[[DataFrame], float],
    n: int, key: str, quantiles: Sequence[float] = (0.1, 0.2, 0.3, 0.4),
) -> DataFrame:
    """(q, median closest distance, utility score): all rows as generated (q 0), then refills at several cut quantiles.

    All quantiles draw from the same batches, each made and measured once.
    """
    rows, measured = [], {}
    for q in (0.0, *quantiles):
        if q == 0:
            kept, distances = measured_batch(real, generator, distance, 0, n, measured)
        else:
            kept = privacy_refill(real, generator, distance, q, n, key, measured=measured)[0].drop("round")
            distances = distance(real, kept)
        median = median_closest(distances).first()[0]
        rows.append((float(q), float(median), float(score(kept))))
    return real.sparkSession.createDataFrame(rows, "q double, median double, score double")

