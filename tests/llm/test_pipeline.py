"""Stages on their own input, against brute force, and the pipeline as a whole."""

import corpus_pipeline as P
from tests.llm.test_neardup import _brute

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in P.STAGES] == ["language ID", "MinHash near-dedup", "substring dedup", "mixing sources to target weights", "BPE encoding and decoding"]
    known = P.known_language(spark, docs, SF)
    assert known.columns == docs.columns and known.count() >= 0.98 * docs.count()
    rows = [(r.doc_id, r.text) for r in known.collect()]
    kept = P.without_near_duplicates(spark, known, SF)
    assert {r.doc_id for r in kept.collect()} == set(_brute(rows).values())
    cut = {r.doc_id: r for r in P.without_repeats(spark, kept, SF).collect()}
    texts = {r.doc_id: r for r in kept.collect()}
    same = sum(cut[i].text == texts[i].text for i in cut)
    assert 0.7 * len(texts) <= same < len(texts) and all(r.n_chars == len(r.text) for r in cut.values())
    mixed = P.mixed(spark, kept, SF)
    assert mixed.columns == docs.columns and 0 < mixed.count() < kept.count()
    out = P.run(spark, SF)
    assert 0 < out.count() <= len(cut) and {"doc_id", "n_tokens", "ids"} <= set(out.columns)


def test_odd_documents_pass_every_stage(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, topic string, ids string"
    rows = [(i, "some words of a text " * 20, "en", "s", 420, "t", "x") for i in range(4)] + [(None, "andere worte " * 30, "de", None, 390, None, None), (5, None, "en", "s", 0, "t", "x"), (6, "", None, None, 0, "t", "x")]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() <= len(rows)
    assert P.tokens(spark, docs, SF).count() == len(rows)
    assert P.mixed(spark, docs.limit(0), SF).count() == 0
