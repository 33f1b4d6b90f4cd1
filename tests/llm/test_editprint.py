import hashlib
import random

import numpy as np
import pandas as pd
import pytest

from tracekit.llm import editprint as E


def _prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(n))


def _edited(text, following):
    kept = len(text) - len(text) // 3
    return text[:kept] + following[: len(text) // 3]


def test_against_one_by_one(spark):
    rows = [(5, "the first text, with some words " * 20), (9, "another one " * 30), (2, None), (7, ""), (11, "Ünïcode 漢字 😀 " * 25), (3, "x" * 20000), (4, "ab")]
    docs = spark.createDataFrame([(i, t, "extra", 1) for i, t in rows], "doc_id long, text string, slot string, guest int")
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    for slots in (1, 3, 40):
        got = {r.doc_id: r for r in E.compare_edited(docs, slots).collect()}
        assert len(got) == len(rows)
        for k, (i, text) in enumerate(order):
            following = order[(k + 1) % len(order)][1]
            edited = _edited(text, following)
            r = got[i]
            assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert r.fingerprint == E.text_fingerprint(text) and r.edited_fingerprint == E.text_fingerprint(edited)
            assert r.near_next == pytest.approx(E.likeness(r.fingerprint, E.text_fingerprint(following)))


def test_repeated_null_and_few_rows(spark):
    schema = "doc_id long, text string"
    assert E.compare_edited(spark.createDataFrame([], schema)).count() == 0
    one = E.compare_edited(spark.createDataFrame([(1, "only text here")], schema)).first()
    assert one.near_next == 1.0
    same = E.compare_edited(spark.createDataFrame([(1, "a text")] * 3 + [(None, "null"), (None, "null"), (2, "other")], schema), 4).collect()
    assert len(same) == 6 and len({r.fingerprint for r in same if r.doc_id == 1}) == 1


def test_edits_cost_little_and_other_texts_much():
    text, other = _prose(1, 600), _prose(2, 600)
    slightly = text[:500] + "X" + text[500:1500] + "y" + text[1501:]
    a = E.text_fingerprint(text)
    assert E.likeness(a, E.text_fingerprint(slightly)) > 0.85
    assert E.likeness(a, E.text_fingerprint(other)) < 0.4
    assert E.likeness(a, E.text_fingerprint(text[: len(text) // 4])) == 0.0
    assert E.likeness(E.text_fingerprint(""), E.text_fingerprint("")) == 1.0


def test_walk_of_a_prefix_is_a_prefix(monkeypatch):
    text = "some text to walk over, with more than one chunk"
    whole = E.walk(text)
    monkeypatch.setattr(E, "_CHUNK", 7)
    assert E.walk(text).tolist() == whole.tolist()
    assert [*E.walk(text[:20]), *E.walk(text[20:], int(whole[19]))] == whole.tolist()


def test_links_of_near_texts(spark):
    base = _prose(3, 300)
    docs = spark.createDataFrame([(3, base), (1, base), (2, base[:700] + "xx" + base[700:]), (4, "quite another text " * 30), (5, None)], "doc_id long, text string")
    links = {(r.doc_id, r.leader) for r in E.near_links(docs, 0.8).collect()}
    assert links == {(2, 1)}


def _hot_rows():
    """Texts of one opening that is a band of its own, in pairs alike to each other but not to the other pairs, and copies."""
    opening = _prose(50, 60)
    rows = []
    for i in range(12):
        text = opening + _prose(100 + i, 240)
        rows += [(10 * i, text), (10 * i + 1, text[:-100] + "q" + text[-99:]), (10 * i + 2, text)]
    long = _prose(7, 4000)
    at = next(k for k in range(len(long) // 2, len(long)) if E.text_fingerprint(long[:k] + "#" + long[k + 1 :]) == E.text_fingerprint(long))
    return [*rows, (500, long), (501, long[:at] + "#" + long[at + 1 :]), (502, None), (503, "")]


def _brute(rows, least):
    prints = {i: E.text_fingerprint(t or "") for i, t in rows}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, p in prints.items():
        for j, q in prints.items():
            if i < j and set(E.bands(p)) & set(E.bands(q)) and E.likeness(p, q) >= least:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in prints}


@pytest.mark.parametrize("block", [1024, 3])
def test_classes_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    rows = _hot_rows()
    want = _brute(rows, E.LEAST)
    assert len(set(want.values())) == 14
    got = E.with_classes(spark.createDataFrame(rows, "doc_id long, text string"), E.LEAST, 3).collect()
    assert {r.doc_id: r.near_class for r in got} == want and len(got) == len(rows)
    sizes = list(want.values())
    assert all(r.near_rows == sizes.count(r.near_class) for r in got)


def test_links_beside_the_leader(spark, monkeypatch):
    """All share the first band only; each pair differs in one sample of every other band."""
    monkeypatch.setattr(E, "BLOCK", 3)
    rng, rows = random.Random(3), []
    for i in range(10):
        own = "0" * E.BAND + "".join(rng.choices("0123456789abcde", k=E.SAMPLES - E.BAND))
        other = own[: E.BAND] + "".join("f" if k % E.BAND == 0 else c for k, c in enumerate(own[E.BAND :]))
        rows += [(2 * i, bytes([7 * i % 10, 0]), f"11:{own}:{'.' * E.SAMPLES}"), (2 * i + 1, bytes([7 * i % 10, 1]), f"11:{other}:{'.' * E.SAMPLES}")]
    got = E.near_members(spark.createDataFrame(rows, "key long, name binary, print string"), E.LEAST).collect()
    names = {bytes(name): key for key, name, _ in rows}
    assert {names[bytes(r.name)]: (r.near_class, r.near_rows) for r in got} == {k: (k - k % 2, 2) for k in range(20)}


def test_links_of_equal_fingerprints(spark):
    links = {(r.doc_id, r.leader) for r in E.near_links(spark.createDataFrame(_hot_rows(), "doc_id long, text string"), E.LEAST).collect()}
    assert links == {(10 * i + 1, 10 * i) for i in range(12)} | {(501, 500)}


def test_likeness_to_all_is_likeness():
    prints = [E.text_fingerprint(_prose(k % 5, 40 + 30 * (k % 7))) for k in range(25)] + [E.text_fingerprint(""), E.text_fingerprint("a")]
    scales, rows = E._parts(prints)
    for i, p in enumerate(prints):
        assert E._likeness_to(i, scales, rows).tolist() == pytest.approx([E.likeness(p, q) for q in prints])


def test_walks_side_by_side_are_single_walks():
    rng = np.random.default_rng(5)
    texts = ["", "a", "é漢😀" * 9, "x" * 9000] + ["".join(rng.choice(list("abcdef  é"), n)) for n in [*rng.integers(0, 300, 60), 9000, 700]]
    starts = [0, 0, *rng.integers(0, 99_999, len(texts) - 2).tolist()]
    for some in (slice(None), slice(0, 4), slice(0, 0)):
        got = E.walks(texts[some], [E._codes(x) for x in texts[some]], starts[some])
        assert [x.tolist() for x in got] == [E.walk(x, a).tolist() for x, a in zip(texts[some], starts[some])]


def test_packed_likeness_is_the_likeness_of_pairs():
    rng = np.random.default_rng(6)
    base = "".join(rng.choice(list("abcdefgh "), 3000))
    texts = ["", "a", *[base[:2000] + "".join(rng.choice(list("abcdefgh "), n)) for n in (0, 30, 300, 1000, 3000)], *[base[:n] for n in (1500, 2100, 2900, 3000, 3000)]]
    prints = pd.Series([E.text_fingerprint(x) for x in texts])
    scales, rows = E._parts(prints)
    for i, p in enumerate(prints):
        assert E._likeness_to(i, scales, rows).tolist() == [E.likeness(p, q) for q in prints]
        assert rows.digits.dtype == np.uint64 and rows.digits.shape == (len(prints), 2, E.SAMPLES // 16)
    i, j = np.divmod(np.arange(len(prints) ** 2), len(prints))
    assert E._likeness_of(i, j, scales, rows).tolist() == [E.likeness(prints[a], prints[b]) for a, b in zip(i, j)]


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_block_pairs_cut_by_batches_give_the_links_of_all_pairs(size, monkeypatch):
    monkeypatch.setattr(E, "_PAIRS", 5)
    rng = np.random.default_rng(7)
    base = ["".join(rng.choice(list("abcdefgh "), 900)) for _ in range(4)]
    rows = []
    for band, n in enumerate([1, 2, 9, 30, 2, 5]):
        for k in range(n):
            text = base[int(rng.integers(4))][: -int(rng.integers(1, 40))]
            rows.append((band, bytes([band, k]), bytes([int(rng.integers(6))]), bool(rng.integers(2)), E.text_fingerprint(text), 0, 0, band % 2 == 1))
    table = pd.DataFrame(rows, columns=["band", "name", "root", "stray", "print", "i", "j", "mixed"])
    batches = (table.iloc[a : a + size] for a in range(0, len(table), size))
    got = pd.concat(list(E._compare(E.LEAST)(batches)))
    root = dict(zip(table["name"], table["root"]))
    joins = sorted((a[0], *sorted([root[a], root[b]])) for a, b in zip(got["a"], got["b"]))
    expected = {(x[0], *sorted([x[2], y[2]])) for x in rows for y in rows if x[0] == y[0] and x[2] != y[2]
                and (not x[7] or x[3] != y[3]) and E.likeness(x[4], y[4]) >= E.LEAST}
    assert joins == sorted(expected) and len(joins) > 10


def test_bands_come_in_bounded_slices(monkeypatch):
    monkeypatch.setattr(E, "_BANDED", 3)
    table = pd.DataFrame([(bytes([k]), E.text_fingerprint(_prose(k, 20 * k))) for k in range(8)], columns=["name", "print"])
    got = list(E._banded(iter([table, table.iloc[:0]])))
    assert len(got) == 3 and all(x["name"].nunique() <= 3 for x in got)
    assert [tuple(x) for x in pd.concat(got).itertuples(index=False)] == [(n, b) for n, p in zip(table["name"], table["print"]) for b in E.bands(p)]
