"""Repeated passages: runs of consecutive sentences hashed over the whole table.

All steps are DataFrame operations. The only rows that are grouped globally are hashes of runs with a
smallest doc_id and a count; a passage that a third of the documents share is one such row after partial
aggregation, and the join that marks its other places is one that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracekit.llm.common import free_name
from tracekit.session import cut

#: Sentences in a run, words from which a sentence is a run of its own and a stretch is removed.
RUN, LEAST_WORDS = 2, 20
#: A sentence starts behind a line break, behind a full stop (or ! or ?) and one white space, and at a capital
#: behind white space: a passage pasted into the middle of a sentence starts like that.
BOUNDARY = r"(?<=\n)(?=\S)|(?<=[.!?]\s)(?=\S)|(?<=\s)(?=\p{Lu})"


def _runs(docs: DataFrame, run: int, least_words: int) -> DataFrame:
    """Rows at, draw, h, i, width, words, again: every run of every text; words of each of its sentences."""
    pieces = docs.select("at", "draw", F.split("text", BOUNDARY).alias("s"))
    normal = pieces.select("at", "draw", F.transform("s", lambda s: F.lower(F.trim(F.regexp_replace(s, r"\s+", " ")))).alias("s"))
    counted = normal.select("at", "draw", "s", F.transform("s", lambda s: F.when(s == "", 0).otherwise(
        F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) + 1)).alias("w"))

    def row(i, width):
        return F.struct(F.xxhash64(F.lit(width), *[F.get("s", i + k) for k in range(width)]).alias("h"), i.alias("i"),
                        F.lit(width).alias("width"), F.slice("w", i + 1, width).alias("words"))

    several = F.transform(F.slice("s", 1, F.greatest(F.size("s") - (run - 1), F.lit(0))), lambda _, i: row(i, run))
    alone = F.transform(F.filter(F.transform("w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"] >= least_words),
                        lambda x: row(x["i"], 1))
    ordered = counted.select("at", "draw", F.array_sort(F.concat(several, alone)).alias("r"))
    marked = F.transform("r", lambda x, j: F.struct(x["h"].alias("h"), x["i"].alias("i"), x["width"].alias("width"), x["words"].alias("words"),
                                                   F.coalesce(F.get("r", j - 1)["h"] == x["h"], F.lit(False)).alias("again")))
    return ordered.select("at", "draw", F.inline(marked))


def repeated_stretches(docs: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN, least_words: int = LEAST_WORDS) -> DataFrame:
    """Rows at, draw, stretches: for each document with any, the sentences ``first`` to ``last`` to remove.

    A run that occurs more than once is kept where the key is smallest, at its first place there; all its other
    places are covered. Covered sentences that touch form a stretch, and stretches of at least ``least_words``
    words are removed. ``at`` is the key (null: after all others) and ``draw`` a hash of the text: rows with one
    key are one place, and equal rows are treated alike.
    """
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)).alias("at"),
                       F.xxhash64(text).alias("draw"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = _runs(rows, run, least_words)
    # written, so that the join below reads two plain shuffles, whose large partitions Spark can split
    first = cut(found.groupBy("h").agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "repeated")
    later = found.join(first, "h").where("again or at > first_at")
    # `j` of a run's sentences and their words; one exchange by document serves all that follows
    covered = later.select("at", "draw", F.col("i").alias("start"), F.posexplode("words").alias("j", "w"))
    covered = covered.select("at", "draw", (F.col("start") + F.col("j")).alias("i"), "w").repartition("at", "draw").dropDuplicates(["at", "draw", "i"])
    one = Window.partitionBy("at", "draw").orderBy("i")
    islands = covered.withColumn("island", F.col("i") - F.row_number().over(one))
    stretches = islands.groupBy("at", "draw", "island").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.sum("w").alias("w"))
    return stretches.where(F.col("w") >= least_words).groupBy("at", "draw").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("stretches"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN, least_words: int = LEAST_WORDS) -> DataFrame:
    """Every row with its text less the repeated stretches, and ``sentences_removed``.

    What stays of a text stays byte for byte. A document all of whose sentences are repeated keeps an empty
    text, a null text stays null, other columns pass through; a name that is taken gets underscores.
    """
    removed, at, draw, cut = (free_name(docs, c) for c in ("sentences_removed", "at_", "draw_", "cut_"))
    marks = repeated_stretches(docs, key, text, run, least_words).select(F.col("at").alias(at), F.col("draw").alias(draw), F.col("stretches").alias(cut))
    rows = docs.withColumns({at: F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)), draw: F.xxhash64(text)})
    joined = rows.join(marks, [at, draw], "left")
    kept = F.array_join(F.filter(F.split(F.col(text), BOUNDARY), lambda _, i: ~F.exists(cut, lambda x: (x["first"] <= i) & (i <= x["last"]))), "")
    n = F.aggregate(cut, F.lit(0).cast("long"), lambda a, x: a + (x["last"] - x["first"] + 1))
    out = joined.withColumn(text, F.when(F.col(cut).isNull(), F.col(text)).otherwise(kept))
    out = out.withColumn(removed, F.coalesce(F.when(F.col(cut).isNotNull(), n), F.lit(0).cast("long")))
    return out.select(*docs.columns, removed)
