import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tracekit.llm import restaurants as R

SF = "/root/testdata/sf0.001"


def _tokens(text):
    return (text or "").encode().lower().split() + [b""]


def test_base_scores_and_perplexity(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in R.score_corpus(docs).collect()}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    counts = Counter(w for i, t in texts.items() if i not in held for w in _tokens(t))
    n, v = sum(counts.values()), len(counts)
    for i, t in texts.items():
        r, words = got[i], _tokens(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in held, len(words), sum(counts[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), abs=1e-6)
    rows = [got[i] for i in held]
    tokens = sum(r.n_tokens for r in rows)
    assert sum(r.score for r in rows) / tokens > sum(r.base_score for r in rows) / tokens


def test_blocks_and_shares_do_not_change_the_counts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"the a{i % 5} the b{i % 3} of the") for i in range(60)], "doc_id long, text string").coalesce(1)
    whole = {r.doc_id: r for r in R.score_corpus(docs).collect()}
    real = R._bucketed
    for name, value in (("BLOCK_TOKENS", 40), ("PAIR_SHARE", 60), ("WORD_SHARE", 10)):
        monkeypatch.setattr(R, name, value)
    monkeypatch.setattr(R, "_bucketed", real)
    parts = {r.doc_id: r for r in R.score_corpus(docs).collect()}
    for i, a in whole.items():
        b = parts[i]
        assert (a.n_tokens, a.n_known, a.train_tokens) == (b.n_tokens, b.n_known, b.train_tokens)
        assert a.base_score == pytest.approx(b.base_score) and a.score == pytest.approx(b.score, rel=0.05)


def test_odd_rows_and_empty_tables(spark):
    schema = "doc_id long, text string, block string, share int"
    rows = [(1, None, "x", 1), (2, "", "x", 1), (2, "", "x", 1), (None, "A word", "x", 1), (3, "a WORD " * 30000, "x", 1), (4, "é É \x0b x", "x", 1)]
    got = R.score_corpus(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows) and all(math.isfinite(r.score) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[1].n_tokens == by[2].n_tokens == 1 and by[None].held_out and by[3].n_tokens == 60001 and by[4].n_tokens == 3
    assert R.score_corpus(spark.createDataFrame([], schema)).count() == 0


def test_predictions_sum_to_one():
    rng = np.random.default_rng(0)
    c0 = rng.integers(0, 5, 50)
    t0 = np.minimum(c0, 1)
    scalars = {"d0": 0.6, "sum_t0": int(t0.sum()), "sum_c0": int(c0.sum()), "v": 49, "d": 0.7}
    known = R._root({"c0": c0, "t0": t0}, scalars)
    assert known.sum() == pytest.approx(1.0)  # 49 known words and the unknown one
    c = rng.integers(0, 4, 50)
    t = np.minimum(c, 1)
    p = (c - 0.7 * t + (R.STRENGTH + 0.7 * t.sum()) * known) / (R.STRENGTH + c.sum())
    assert p.sum() == pytest.approx(1.0)


def test_tables_follow_their_exact_distribution():
    c, base, d, strength = 4, 0.3, 0.5, 1.0
    n = 40000
    drawn = R.seat(np.full(n, c), np.full(n, base), np.zeros(n), d, strength, np.arange(n, dtype=np.uint64), 3)
    ways = {}

    def go(sizes, weight):  # all seatings of four customers, one after the other
        if sum(sizes) == c:
            ways[len(sizes)] = ways.get(len(sizes), 0.0) + weight
            return
        for k, s in enumerate(sizes):
            go(sizes[:k] + [s + 1] + sizes[k + 1 :], weight * (s - d))
        go([*sizes, 1], weight * (strength + d * len(sizes)) * base)

    go([], 1.0)
    for t, w in ways.items():
        assert (drawn == t).mean() == pytest.approx(w / sum(ways.values()), abs=0.01)
    many = R.seat(np.full(2000, 5000), np.full(2000, 0.01), np.zeros(2000), d, strength, np.arange(2000, dtype=np.uint64), 1)
    assert 1 <= many.min() and many.max() < 5000


def test_packing():
    for keys in (np.array([], dtype=np.uint64), np.array([0, 5, 5, 1 << 63], dtype=np.uint64), np.arange(1000, dtype=np.uint64) * np.uint64(1 << 30)):
        assert R.unpack_keys(R.pack_keys(keys)).tolist() == keys.tolist()
    for x in ([], [0, 255], [256, 1], [1 << 40]):
        assert R.unpack(R.pack(np.array(x, dtype=np.int64))).tolist() == x


def test_only_pairs_asked_for_are_seated():
    rng = np.random.default_rng(8)
    n, words = 500, 40
    block = type("Block", (), {"u": rng.integers(0, words, n), "w": rng.integers(0, words, n), "keys": rng.integers(0, 1 << 40, n).astype(np.uint64)})
    c, at = rng.integers(0, 60, n), np.flatnonzero(rng.random(n) < 0.3)
    state = {k: rng.integers(1, 50, words) for k in ("c", "t", "c0", "t0")}
    scalars = {"d": 0.6, "d0": 0.4, "v": words, "sum_c0": int(state["c0"].sum()), "sum_t0": int(state["t0"].sum())}
    for s in (None, state):
        whole = R._tables(block, c, s, scalars, 2)
        assert R._tables(block, c, s, scalars, 2, at).tolist() == whole[at].tolist()
        assert R._tables(block, c, s, scalars, 2, at[:0]).tolist() == []


def test_tables_follow_the_weights_in_logarithms():
    rng = np.random.default_rng(9)
    n, d, strength = 20_000, 0.7, 1.0
    c, others = rng.integers(2, R.EXACT + 1, n), rng.choice([0, 1, 7, 1000, 10**6, 10**9], n)
    base, keys = 10.0 ** -rng.uniform(0, 9, n), rng.integers(0, 1 << 60, n).astype(np.uint64)
    got, u = R.seat(c, base, others, d, strength, keys, 3), R.uniform(keys, 3)
    assert np.isfinite(got).all() and (got >= 1).all() and (got <= c).all()
    wrong = 0
    for i in range(n):
        j = np.arange(c[i])
        weight = R.log_stirling(d)[c[i], 1 : c[i] + 1] + (j + 1) * math.log(base[i]) + np.cumsum(np.log(strength + d * (others[i] + j)))
        share = np.cumsum(np.exp(weight - weight.max()))
        wrong += got[i] != 1 + (share < share[-1] * u[i]).sum()
    assert wrong == 0


def test_pairs_of_a_block_are_sorted_not_searched(monkeypatch):
    rng = np.random.default_rng(4)
    n, words = 3000, 50
    numbers = rng.integers(1, words, n).astype(np.uint32)
    numbers[[9, 10, n - 1]] = 0  # ends of texts, one of them empty
    row = {"numbers": zlib.compress(numbers.tobytes()), "doc_ids": [1, None, 5], "sizes": [10, 1, n - 11], "words": rng.integers(0, 1 << 63, words).astype(np.uint64).tobytes()}
    called = []
    real = np.unique
    monkeypatch.setattr(np, "unique", lambda *a, **k: called.append("unique") or real(*a, **k))
    b = R._Block(row, (3, 4), (7, 2))
    counts, spread = b.learnt_counts(), b.of_tokens(b.u * 1000 + b.w)
    assert not called  # numpy's unique and a search for each token took most of a sweep's time
    met = list(zip([0, *numbers[:-1].tolist()], numbers.tolist()))
    learnt = Counter(p for p, keep in zip(met, np.repeat([not R.held_out(i) for i in row["doc_ids"]], row["sizes"])) if keep)
    assert spread.tolist() == [u * 1000 + w for u, w in met]
    assert sorted(zip(b.u.tolist(), b.w.tolist())) == sorted(set(met))
    assert counts.tolist() == [learnt[p] for p in zip(b.u.tolist(), b.w.tolist())]
    assert (b.keys[1:] >= b.keys[:-1]).all()


def test_order_with_and_without_packing():
    x = np.random.default_rng(5).integers(0, 40, 500).astype(np.uint64)
    for below in (40, 1 << 64):
        assert R._order(x, below).tolist() == np.argsort(x, kind="stable").tolist()
    assert R._order(x[:1], 40).tolist() == [0] and R._order(x[:0], 40).tolist() == []


def test_large_dishes_are_seated_together_and_leave_when_full(monkeypatch):
    rng = np.random.default_rng(6)
    n, d, strength = 3000, 0.6, 1.0
    goal, mass, others = np.sort(rng.integers(R.EXACT + 1, 4000, n))[::-1].astype(np.float64), rng.random(n), rng.integers(0, 500, n)
    worked = []
    real = np.minimum
    monkeypatch.setattr(np, "minimum", lambda *a, **k: worked.append(len(a[1])) or real(*a, **k))
    got = R._expected_tables(goal, mass, others, d, strength)
    monkeypatch.undo()
    assert sum(worked) < 0.9 * n * len(worked)  # before, full dishes were carried along to the last round
    for i in range(0, n, 37):
        tables, seated = 1.0, 1.0
        while seated < goal[i]:
            step = min(max(1.0, seated // 32), goal[i] - seated)
            new = (strength + d * (others[i] + tables)) * mass[i]
            tables += step * new / (seated - d * tables + new)
            seated += step
        assert got[i] == pytest.approx(tables, rel=1e-12)
    c, keys = rng.permutation(goal).astype(np.int64), rng.integers(0, 1 << 60, n).astype(np.uint64)
    whole = R.seat(c, mass, others, d, strength, keys, 1)
    monkeypatch.setattr(R, "SEATED", 100)
    assert R.seat(c, mass, others, d, strength, keys, 1).tolist() == whole.tolist()
