import random

from tracekit.llm import repeats


def _sentence(rng, n):
    return "S" + " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n)) + "."


def _texts(rng):
    passage = " ".join(_sentence(rng, 9) for _ in range(7))
    own = lambda: " ".join(_sentence(rng, rng.randint(1, 12)) for _ in range(8))
    clean = own() + "\n" + own()
    rows = [(1, own() + "\n" + passage + "\n" + own()), (2, own() + " and then " + passage + " " + own()), (3, clean), (4, passage), (5, own() + " " + passage + " " + passage)]
    return passage, clean, rows


def test_passages_stay_at_their_first_place_only(spark):
    passage, clean, rows = _texts(random.Random(1))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, cut_ string")
    got = {r.doc_id: r for r in repeats.remove_repeats(docs).collect()}
    text = dict(rows)
    assert got[1].text == text[1] and got[3].text == clean and got[1].sentences_removed == 0
    assert got[4].text == "" and got[4].sentences_removed == 7
    for i in (2, 5):
        assert passage not in got[i].text and not any(s in got[i].text for s in passage.split(". ")[1:])
    assert got[2].text == text[2].replace(passage + " ", "") and got[2].cut_ == "x"


def test_short_repeats_stay(spark):
    rows = [(i, f"A common line here. Another. Own words {i} of text number {i}.") for i in range(5)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == dict(rows)


def test_odd_rows(spark):
    rng = random.Random(2)
    passage = " ".join(_sentence(rng, 10) for _ in range(5))
    rows = [(1, None), (2, ""), (3, " \n "), (4, passage), (4, passage), (None, passage), (5, "w " * 50000), (6, (passage + "\n") * 300)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].text is None and by[2].text == "" and by[3].text == " \n " and by[5].text == "w " * 50000
    assert all(r.text == passage for r in got if r.doc_id == 4) and by[None].text == "" and by[6].text.strip() == ""
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
