import zlib

import numpy as np

from tracekit.llm import langid

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(langid.training_rows(docs))
    rows = langid.identify(docs, model).select("doc_id", "lang", "lang_pred", "lang_score", "lang_rejected", langid.held_out().alias("held")).collect()
    assert {r.doc_id for r in rows if r.held} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    held = [r for r in rows if r.held]
    assert np.mean([r.lang == r.lang_pred for r in held]) >= 0.95
    assert all(0 <= r.lang_score <= 1 for r in rows)
    assert sum(r.lang_rejected for r in rows) <= 0.02 * len(rows)


def test_slices_add_up_to_the_whole_text(monkeypatch):
    rows = np.random.default_rng(0).normal(size=(langid.BUCKETS, 3))
    texts = ["the quick brown fox " * 50, "", "Ünïcode ßtraße " * 40, "a", "1234 .. !"]
    whole, n = langid.average_rows(texts, rows)
    monkeypatch.setattr(langid, "_SLICE", 64)
    parts, m = langid.average_rows(texts, rows)
    np.testing.assert_allclose(whole, parts)
    assert n.tolist() == m.tolist() and n[1] == n[4] == 0


def test_texts_without_letters_and_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, lang, "x") for i, (t, lang) in enumerate(
        [("aber und oder nicht " * 9, "de"), ("this and that other " * 9, "en")] * 12 + [(None, "en"), ("", None), ("12 34 !", "de"), ("und " * 40000, None)])],
        "doc_id long, text string, lang string, lang_pred string")
    model = langid.fit(langid.training_rows(docs))
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert len(got) == 28 and got[0].lang_pred == "x" and got[0].lang_pred_ == "de" and got[1].lang_pred_ == "en"
    assert [got[i].lang_pred_ for i in (24, 25, 26)] == ["und"] * 3 and all(got[i].lang_rejected and got[i].lang_score == 0 for i in (24, 25, 26))
    assert got[27].lang_pred_ == "de"


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert langid.identify(docs, model).first().lang_pred == "und"
    assert langid.identify(docs.limit(0), model).count() == 0
