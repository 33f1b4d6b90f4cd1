"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

Documents are counted once into cells of their categories. Fitting keeps one factor per value of each
dimension and works on the cells only: each half step sums the weighted cells by one dimension (partial sums
before the shuffle) and sets that dimension's factors to target over sum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracekit.llm.common import free_name
from tracekit.session import cut, fraction

#: Full rounds over all dimensions, and the power that flattens natural shares to the default targets.
ROUNDS, POWER = 6, 0.8
#: Steps that ``scale_for`` takes at most; each but the last saturates a cell, and a few do in practice.
STEPS = 60
#: Stands for a null category.
NONE = "(none)"


def n_tokens(text: Column) -> Column:
    """Runs of characters other than white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    """A stand-in for a topic where a table has none: the form of the text, by its first property that holds."""
    marks = F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s.,]"))
    length = F.char_length(text)
    return (F.when(text.isNull() | (length == 0), "empty").when(text.contains(" | "), "table")
            .when(marks * 20 > length, "marked").when(length < 600, "short").when(length >= 4000, "long").otherwise("prose"))


def count_cells(docs: DataFrame, dims: Sequence[str], tokens: str) -> DataFrame:
    """Tokens per cell, one column per dimension (null: ``NONE``) and ``cell_tokens``; cells without tokens are left out."""
    keys = [F.coalesce(F.col(d).cast("string"), F.lit(NONE)).alias(d) for d in dims]
    return docs.groupBy(*keys).agg(F.sum(tokens).cast("double").alias("cell_tokens")).where("cell_tokens > 0")


def flattened(cells: DataFrame, dim: str, power: float = POWER) -> DataFrame:
    """Default targets: value and ``share``, natural shares to a power, scaled to sum to one."""
    sums = cells.groupBy(dim).agg(F.pow(F.sum("cell_tokens"), power).alias("part"))
    total = sums.agg(F.sum("part").alias("total"))
    return sums.crossJoin(F.broadcast(total)).select(dim, (F.col("part") / F.col("total")).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """Cells with ``ratio``: wanted over present share of tokens.

    ``targets`` has, per dimension, a table of value and ``share``. Values without a target get ratio 0; a target
    value without tokens cannot be reached and is left out. After the last round the marginals of the last
    dimension hold exactly and the others as nearly as the rounds bring them. No cells give no rows.
    """
    dims = list(targets)
    total = cells.agg(F.sum("cell_tokens").alias("total"))
    base = cut(cells.crossJoin(F.broadcast(total)).withColumn("present", F.col("cell_tokens") / F.col("total")).drop("total"), "cells")
    factors = {d: targets[d].select(d, F.lit(1.0).alias(f"factor_{d}")) for d in dims}

    def weighted() -> DataFrame:
        out = base
        for d in dims:
            out = out.join(factors[d], d, "left").fillna(0.0, [f"factor_{d}"])
        product = F.col("present")
        for d in dims:
            product = product * F.col(f"factor_{d}")
        return out.withColumn("wanted", product)

    for _ in range(rounds):
        for d in dims:
            sums = weighted().groupBy(d, f"factor_{d}").agg(F.sum("wanted").alias("got"))
            raised = sums.join(targets[d].select(d, "share"), d)
            factors[d] = cut(raised.select(d, F.when(F.col("got") > 0, F.col(f"factor_{d}") * F.col("share") / F.col("got")).otherwise(F.lit(0.0)).alias(f"factor_{d}")), "factors")
    return weighted().withColumn("ratio", F.when(F.col("present") > 0, F.col("wanted") / F.col("present")).otherwise(F.lit(0.0))).select(*dims, "cell_tokens", "ratio")


def scale_for(fitted: DataFrame, share: float) -> float:
    """The scale at which min(1, scale * ratio) keeps ``share`` of the tokens of the cells in expectation.

    Newton's steps on a sum that is concave and piecewise linear in the scale: from below they never overshoot, and
    they end when no further cell saturates. Never below 1 over the largest ratio, which needs no saturation. If cells
    with ratio 0 leave less than the share, all others saturate.
    """
    tokens, ratio = F.col("cell_tokens"), F.col("ratio")
    first = fitted.agg(F.sum("cell_tokens").alias("tokens"), F.max("ratio").alias("top")).first()
    if not first.top:
        return 1.0
    scale = 1 / first.top
    for _ in range(STEPS):
        full = ratio * F.lit(scale) >= 1
        row = fitted.agg(F.sum(F.when(full, tokens)).alias("full"), F.sum(F.when(~full, tokens * ratio)).alias("rest"),
                         F.min(F.when(ratio > 0, ratio)).alias("least")).first()
        if not row.rest:
            break
        # beyond 1 over the least ratio nothing changes any more
        following = min((share * first.tokens - (row.full or 0.0)) / row.rest, 1 / row.least)
        if following <= scale * (1 + 1e-12):
            break
        scale = following
    return scale


def sample_mix(docs: DataFrame, dims: Sequence[str], tokens: str, key: str, seed: str = "mix",
               targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, share: float | None = None) -> DataFrame:
    """Every row with ``mix_probability`` and ``mix_kept``.

    Without ``share`` the probability of a document is its cell's ratio over the largest one, so the kept tokens follow
    the targets in expectation and as many are kept as that allows: the rarest cell decides how many. With ``share``, at
    least that share of all tokens is kept in expectation: cells whose ratio is too large for it are kept whole, and
    the others keep their proportions. Whether a row is kept follows from a digest of the key: repeated rows
    share their fate. Documents without tokens have probability 1, as they weigh nothing. Names that are taken get underscores.
    """
    probability, kept, chance = (free_name(docs, c) for c in ("mix_probability", "mix_kept", "mix_chance"))
    inner = [f"dim_{i}" for i in range(len(dims))]
    counted = docs.select(*[F.col(d).alias(n) for d, n in zip(dims, inner)], F.col(tokens).alias("tokens"))
    cells = cut(count_cells(counted, inner, "tokens"), "cells")
    wanted = {n: targets[d].select(F.col(d).alias(n), "share") if targets else flattened(cells, n) for d, n in zip(dims, inner)}
    fitted = rake(cells, wanted, rounds)
    names = [free_name(docs, n) for n in inner]
    if share is None:
        top = fitted.agg(F.max("ratio").alias("top"))
        scaled, p = fitted.crossJoin(F.broadcast(top)), F.col("ratio") / F.col("top")
    else:
        scaled = cut(fitted, "fitted")
        p = F.least(F.lit(1.0), F.col("ratio") * F.lit(scale_for(scaled, share)))
    chances = scaled.select(*[F.col(n).alias(m) for n, m in zip(inner, names)], p.alias(chance))
    on = [F.coalesce(docs[d].cast("string"), F.lit(NONE)) == F.col(m) for d, m in zip(dims, names)]
    # cells are few beside documents, but their number is the data's: the planner decides how to join them
    joined = docs.join(cut(chances, "chances"), on, "left")
    p = F.when(F.col(tokens) > 0, F.coalesce(chance, F.lit(0.0))).otherwise(F.lit(1.0))
    out = joined.withColumn(probability, p).withColumn(kept, fraction(seed, key) < F.col(probability))
    return out.select(*docs.columns, probability, kept)
