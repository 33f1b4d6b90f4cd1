"""From raw documents to a token corpus: language, near duplicates, repeated passages, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracekit.llm import bpe, langid, mixing, neardup, repeats
from tracekit.llm.common import free_name
from tracekit.plans.registry import query, table
from tracekit.session import cut


#: Least share of the tokens that the mixture keeps.
MIX_SHARE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without letters and texts below the calibrated level go."""
    model = langid.fit(langid.training_rows(docs))
    rejected = free_name(docs, "lang_rejected")
    return langid.identify(docs, model).where(~F.col(rejected)).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies, the one with the smallest doc_id."""
    return neardup.drop_near_duplicates(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All but the first place of a repeated passage goes; documents of which nothing is left go too."""
    removed = free_name(docs, "sentences_removed")
    left = repeats.remove_repeats(docs).where((F.col(removed) == 0) | (F.trim("text") != ""))
    return left.withColumn("n_chars", F.when(F.col(removed) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that tokens follow the raked targets of source, language and topic, ``MIX_SHARE`` of the tokens at least."""
    topic, tokens, kept = free_name(docs, "topic"), free_name(docs, "mix_tokens"), free_name(docs, "mix_kept")
    counted = docs.withColumns({topic: mixing.topic(F.col("text")), tokens: mixing.n_tokens(F.col("text"))})
    return mixing.sample_mix(counted, ["source", "lang", topic], tokens, "doc_id", share=MIX_SHARE).where(kept).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and a digest of what they decode to."""
    ids = free_name(docs, "ids")
    decoded = free_name(docs.withColumn(ids, F.lit(None)), "decoded")
    coded = bpe.decode(bpe.encode(docs).drop("text"), ids)
    return coded.select("doc_id", "lang", "source", F.size(ids).cast("long").alias("n_tokens"), F.col(ids).alias("ids"), F.sha2(decoded, 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", known_language),
    ("MinHash near-dedup", without_near_duplicates),
    ("substring dedup", without_repeats),
    ("mixing sources to target weights", mixed),
    ("BPE encoding and decoding", tokens),
]

#: Trained, iterative and hashed stages: tests hold them against brute force instead.
ORACLE_SQL = None


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
