import hashlib
import zlib

import numpy as np
import pytest

from tracekit.llm import periodic, queries


def brute(words, least=12):
    """All runs by trying every period at every place."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def check(words, least=12):
    runs = periodic.word_runs(words, least)
    want = brute(words, least)
    assert [tuple(r) for r in runs.tolist()] == want
    assert periodic.collapse(words, runs) == brute_collapse(words, want)
    return want


def test_random_texts_against_brute_force():
    rng, runs = np.random.default_rng(3), 0
    for k in range(1200):
        letters = int(rng.integers(1, 5))
        words = rng.integers(0, letters, int(rng.integers(0, 70))).tolist()
        runs += len(check(words, int(rng.choice([2, 3, 4, 7, 12]))))
    assert runs > 2000


@pytest.mark.parametrize("seed", range(6))
def test_planted_periods_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    for _ in range(40):
        words = rng.integers(0, 300, int(rng.integers(0, 80))).tolist()
        for _ in range(int(rng.integers(1, 5))):
            unit = rng.integers(0, int(rng.choice([2, 9, 300])), int(rng.integers(1, 40))).tolist()
            words += (unit * 12)[: int(rng.integers(1, 4 * len(unit) + 14))]
            words += rng.integers(0, 300, int(rng.integers(0, 12))).tolist()
            if rng.random() < 0.3:
                words += words[-len(words) // 2 :]
        assert check(words) is not None


def test_nested_and_special_texts():
    fib = ["a"], ["a", "b"]
    while len(fib[1]) < 400:
        fib = fib[1], fib[1] + fib[0]
    check(fib[1])
    thue = [0]
    for _ in range(8):
        thue += [1 - x for x in thue]
    check(thue, 2)
    check((["x"] * 12 + ["y"]) * 4)
    check((list(range(30)) * 2 + [99]) * 3)
    check(list(range(500)) * 2)
    check(list(range(11)))
    check(["w"] * 11)
    assert check(["w"] * 12) == [(0, 12, 1)]


def test_repair_is_reversible_and_leaves_no_pair_twice():
    rng = np.random.default_rng(5)
    for k in range(60):
        seq = rng.integers(0, 3, int(rng.integers(1, 120))).tolist()
        rules, left = periodic.repair(seq, 1000)
        spread = {1000 + i: pair for i, pair in enumerate(rules)}

        def words(x):
            return words(spread[x][0]) + words(spread[x][1]) if x in spread else [x]

        assert [w for x in left for w in words(x)] == seq
        pairs, last = {}, None
        for i, pair in enumerate(zip(left, left[1:])):
            assert pairs.setdefault(pair, i) >= i - 1  # only overlapping places of a chain are left
    # equal counts are replaced level by level
    rules, _ = periodic.repair(list(range(64)) * 4, 1000)
    depth = {}
    for i, (a, b) in enumerate(rules):
        depth[1000 + i] = 1 + max(depth.get(a, 0), depth.get(b, 0))
    assert max(depth.values()) <= 10


def test_long_texts_take_linear_time():
    import time

    rng = np.random.default_rng(7)
    unit = rng.integers(0, 5000, 7000).tolist()
    began = time.process_time()
    assert [tuple(r) for r in periodic.word_runs(unit * 9).tolist()] == [(0, 63000, 7000)]
    assert [tuple(r) for r in periodic.word_runs(["w"] * 100_000).tolist()] == [(0, 100_000, 1)]
    assert time.process_time() - began < 30


def test_table(spark):
    texts = [None, "", " \n\t ", "a b " * 10, "x y z", "no break " * 12, "a b " * 10]
    df = spark.createDataFrame([(i if i else None, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, runs string")
    rows = sorted(periodic.find_runs(df).collect(), key=lambda r: r.doc_id or 0)
    assert [[tuple(x) for x in r.runs_] for r in rows] == [[], [], [], [(0, 20, 2)], [], [(0, 12, 1)], [(0, 20, 2)]]
    assert [r.collapsed for r in rows] == ["", "", "", "a b", "x y z", "no break", "a b"]
    assert {r.runs for r in rows} == {"mine"}
    assert periodic.find_runs(df.limit(0)).count() == 0


def test_query_against_brute_force(spark, tmp_path):
    base = [f"w{i * i % 97} and more" for i in range(40)]
    docs = [(i, " ".join(base[i % 40 :] + base[: i % 7]) + " \t\x85 end") for i in range(120)] + [(1000, None), (1001, ""), (None, "a " * 30)]
    docs += [(2000 + i, " ".join(f"u{j}" for j in range(i))) for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in queries.op12(spark, str(tmp_path)).collect()}
    assert len(rows) == len(docs)
    edited = 0
    for i, text in docs:
        words = (text or "").encode().split()
        n = len(words)
        if i is not None:
            h = zlib.crc32(str(i).encode())
            g = h // 10
            if h % 10 == 0 and n:
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
                edited += 1
        runs = brute(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        r = rows[i]
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == (best or (None, None, None))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(brute_collapse(words, runs))).hexdigest()
    assert edited > 5
