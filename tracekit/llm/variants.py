"""Spelling variants: words one edit apart, found on bit-sliced position indexes, and the form each belongs to.

Two words one edit apart share the first or the second half of the shorter one, so the vocabulary is dealt into
buckets of words that share a half; buckets that hold many words are halved again on what is left. In a bucket, one
bit set per (position, letter) says which words have that letter there. A word is read once against the sets:
one set of words is equal so far, three have had their one error (replaced, letter more, letter less) and go on at
positions shifted by 0, +1 and -1. All words of a bucket advance at once, a machine word at a time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracekit.llm.common import plain
from tracekit.session import cut

#: Words of a bucket from which it is halved again.
CROWDED = 2048
#: Distinct words that a task counts before it hands them on; it only bounds memory.
COUNTED = 300_000
#: Letters of a word: those of ASCII and of the Latin-1 block.
LETTERS = "[A-Za-zÀ-ÿ]"


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, change: Callable[[bytes, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """``word, n``: how often each maximal run of at least ``least`` letters occurs in all texts, with A-Z in lower case.

    ``change`` gets a row's id (decimal, as bytes) and its distinct words in UTF-8, and returns what each of them counts
    as; what comes out shorter than ``least`` letters is not counted. Null and empty texts hold no words. Each task
    adds up its own words before they are shuffled, so a word that is everywhere is one row per task. Other columns are not read.
    """
    docs = plain(docs, id_col, text_col)
    pattern = LETTERS + "{%d,}" % least

    def run(batches):
        find = re.compile(pattern).findall
        total: dict[bytes, int] = {}

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                counts = Counter(find(text.encode("utf-8").lower().decode("utf-8")))  # lower() of bytes: A-Z only
                words = [w.encode("utf-8") for w in counts]
                if change is not None:
                    words = change(str(key).encode(), words)
                for word, n in zip(words, counts.values()):
                    total[word] = total.get(word, 0) + n
                if len(total) > COUNTED:
                    yield rows()
                    total.clear()
        yield rows()

    counted = docs.mapInArrow(run, "word string, n bigint")
    return counted.where(F.char_length("word") >= least).groupBy("word").agg(F.sum("n").alias("n"))


def _keyed(df: DataFrame) -> DataFrame:
    """Rows of a word in a bucket (short, head, tail): words of ``short`` or one more letters that share ``head`` letters in front and ``tail`` at the end."""
    return df.select("word", "n", "short", "head", "tail", F.xxhash64("short", "head", "tail", F.expr("left(word, head)"), F.expr("right(word, tail)")).alias("bucket"))


def _halved(short: Column, head: Column, tail: Column) -> Column:
    """The two buckets a bucket is halved into: the edit is in the right half of its free middle, or in the left one."""
    middle = (head + F.floor((short - head - tail) / 2)).cast("int")
    left = F.struct(middle.alias("head"), tail.alias("tail"))
    right = F.struct(head.alias("head"), (short - middle).cast("int").alias("tail"))
    return F.array(left, right)


BUCKET = ["bucket", "short", "head", "tail"]


def buckets(words: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """``word, n, short, head, tail, bucket``: every word in all buckets in which it can meet a word one edit away.

    Two words one edit apart, whose common beginning ends at letter p of the shorter, meet in exactly one bucket
    that has p in its free middle. A bucket of more than ``crowded`` words is halved on the rest of its letters until
    it is small or only one letter is free, which an alphabet bounds; so a beginning that a third of all words share
    is spread over many buckets. Each halving is one count and one join with the list of crowded buckets.
    """
    size = F.char_length("word")
    shortest = words.agg(F.min(size)).first()[0]
    lone = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("short")).where(F.col("short") >= (shortest or 0))
    halves = _halved(F.col("short"), F.lit(0), F.lit(0))
    halves = F.when(F.col("short") == 0, F.slice(halves, 1, 1)).otherwise(halves)
    wide = cut(_keyed(lone.select("word", "n", "short", F.inline(halves))), "buckets")
    done = None
    while True:
        full = wide.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("size"))
        full = full.where((F.col("size") > crowded) & (F.col("short") - F.col("head") - F.col("tail") >= 2)).select(*BUCKET)
        full = cut(full, "crowded")
        small = wide.join(full, BUCKET, "left_anti").select(wide.columns)
        done = small if done is None else done.union(small)
        if full.isEmpty():
            return done
        again = wide.join(full, BUCKET, "left_semi")
        wide = cut(_keyed(again.select("word", "n", "short", F.inline(_halved(F.col("short"), F.col("head"), F.col("tail"))))), "buckets")


def near_in_bucket(words: list[str], short: int, head: int, tail: int) -> list[tuple[int, int, int]]:
    """(word, number of near words, first near word) as places in the list, for the words of a bucket that have any.

    Only pairs count whose common beginning ends in the free middle: others meet in another bucket.
    """
    longs = shorts = 0
    index: list[dict[str, int]] = [{} for _ in range(short + 2)]
    for i, word in enumerate(words):
        bit = 1 << i
        for sets, letter in zip(index, word):
            sets[letter] = sets.get(letter, 0) | bit
        if len(word) == short:
            shorts |= bit
        else:
            longs |= bit
    if not shorts:
        return []
    found = []
    for i, word in enumerate(words):
        equal, bit = shorts | longs, 1 << i
        for sets, letter in zip(index, word[:head]):
            equal &= sets[letter]
        n = len(word)
        last = short - tail if tail else n  # errors begin before this letter
        if n == short:
            replaced = more = 0
            for j in range(head, n):
                letter = word[j]
                same = index[j][letter]
                missed = equal & same ^ equal if j < last else 0
                replaced = replaced & same | missed
                more = (more | missed) & index[j + 1].get(letter, 0)
                equal &= same
                if not (replaced or more) and (equal == bit or j + 1 >= last and tail):
                    equal = 0
                    break
            near = replaced & shorts | more & longs
            if not tail:
                near |= equal & longs
        else:
            near = 0  # the other word has a letter less
            for j in range(head, n):
                letter = word[j]
                same = index[j][letter]
                near = near & index[j - 1].get(letter, 0) | (equal & same ^ equal if j < last else 0)
                equal &= same
                if not near and (equal == bit or j + 1 >= last):
                    break
            near &= shorts
        if near:
            found.append((i, near.bit_count(), (near & -near).bit_length() - 1))
    return found


def _search(rows: DataFrame) -> DataFrame:
    """``word, n_near, near_n, near``: partial results of every bucket, the most frequent near word first."""

    def run(batches):
        words: list[str] = []
        counts: list[int] = []
        now = None
        out: list[tuple] = []

        def close():
            if len(words) > 1:
                out.extend((words[i], k, counts[best], words[best]) for i, k, best in near_in_bucket(words, *now[1:]))
            words.clear()
            counts.clear()

        def batch_of():
            columns = list(zip(*out)) or [()] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))],
                                              ["word", "n_near", "near_n", "near"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(4)])
            edge = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            new_words, new_counts = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            bounds = [0, *edge.tolist(), batch.num_rows]
            for a, b in zip(bounds, bounds[1:]):
                key = tuple(keys[:, a].tolist())
                if key != now:
                    close()
                    now = key
                words += new_words[a:b]
                counts += new_counts[a:b]
            if len(out) > 20_000:
                yield batch_of()
        close()
        yield batch_of()

    ordered = rows.select(*BUCKET, "word", "n").repartition("bucket").sortWithinPartitions(*BUCKET, F.desc("n"), "word")
    return ordered.mapInArrow(run, "word string, n_near bigint, near_n bigint, near string")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for rows ``word, form`` without nulls: the end of the chain of forms, by doubling steps.

    Each round follows all chains twice as far and is one join; a chain's frequencies grow tenfold from step to step, so
    there are a handful of rounds at any size. Forms must not run in circles.
    """
    steps = forms.select("word", F.col("form").alias("root"))
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        both = cut(steps.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        steps = both.select("word", "root")
        if both.where("moved").isEmpty():
            return steps


def group_variants(words: DataFrame, ratio: int = 10, crowded: int = CROWDED) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` per distinct word of a table ``word, n``.

    Near words differ by exactly one inserted, deleted or replaced code point. ``form`` is the near word of largest n
    (ties: the first in code-point order) where that is at least ``ratio`` times the word's own n, else null; ``root`` is
    where the forms lead, the word itself without one; ``n_near`` counts near words. Rows of one word are added up; null
    words take no part, a null n counts 0; a word of n = 0 has no form. Other columns are not read. An empty table gives an empty one.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its variant")
    words = plain(words, "word", "n").where(F.col("word").isNotNull())
    words = cut(words.groupBy("word").agg(F.sum(F.coalesce("n", F.lit(0))).cast("long").alias("n")), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    near = _search(buckets(words, crowded)).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    fits = (F.col("n") > 0) & (-F.col("best.less") >= ratio * F.col("n"))
    found = words.join(near, "word", "left").select(
        "word", F.when(fits, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, -F.col("best.less")).alias("form_n"))
    found = cut(found, "near-words")
    ends = roots(found.where(F.col("form").isNotNull()).select("word", "form"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
