import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tracekit.llm import queries, variants


def one_edit(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(v) - len(u) > 1 or u == v:
        return False
    i = 0
    while i < len(u) and u[i] == v[i]:
        i += 1
    return u[i + 1 :] == v[i + 1 :] if len(u) == len(v) else u[i:] == v[i + 1 :]


def brute(counts, ratio=10):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form, out = {}, {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and n > 0 and counts[best] >= ratio * n else None
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), counts.get(form[w]))
    return out


def results(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def random_words(rng, n, letters="abc", low=1, high=9):
    return {"".join(rng.choice(list(letters), int(rng.integers(low, high)))) for _ in range(n)}


@pytest.mark.parametrize("crowded", [2, 5, 2048])
def test_against_brute_force(spark, crowded):
    rng = np.random.default_rng(crowded)
    words = sorted(random_words(rng, 250) | random_words(rng, 60, "aéÿ", 5, 12) | {"", "a", "aa"})
    counts = {w: int(10 ** rng.integers(0, 5) * rng.integers(1, 4)) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    assert results(variants.group_variants(df, crowded=crowded)) == brute(counts)


def test_each_pair_meets_in_one_bucket(spark):
    rng = np.random.default_rng(9)
    words = sorted(random_words(rng, 150, "ab", 4, 10))
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    for crowded in (1, 8):
        groups = {}
        for r in variants.buckets(df, crowded).collect():
            groups.setdefault((r.bucket, r.short, r.head, r.tail), []).append(r.word)
        seen = Counter()
        for (_, short, head, tail), members in groups.items():
            for i, k, best in variants.near_in_bucket(members, short, head, tail):
                seen[members[i]] += k
        assert seen == Counter({w: k for w in words if (k := sum(one_edit(w, v) for v in words))})


def test_crowded_beginning_is_spread(spark):
    letters = "abcdefgh"
    words = ["common" + a + b + c + d for a in letters for b in letters for c in letters for d in letters[:2]]
    df = spark.createDataFrame([(w, 1 + (w == "commonaaaa") * 50) for w in words], "word string, n long")
    sizes = [r["count"] for r in variants.buckets(df, 200).groupBy(*variants.BUCKET).count().collect()]
    assert max(sizes) <= 200
    got = results(variants.group_variants(df, crowded=200))
    assert {v[3] for v in got.values()} == {7 * 3 + 1}
    assert got["commonbaaa"][:2] == ("commonaaaa", "commonaaaa")


def test_chains_ties_nulls_and_repeated_rows(spark):
    rows = [("abcdefgh", 1), ("abcdefg", 30), ("abcdef", 200), ("abcdef", 200), (None, 5), ("zbcdef", 10), ("ybcdef", None), ("xyzxyz", 3), ("xyzxyy", 30), ("xyzxya", 30)]
    df = spark.createDataFrame([(w, n, "x") for w, n in rows], "word string, n long, root string")
    got = results(variants.group_variants(df))
    counts = {"abcdefgh": 1, "abcdefg": 30, "abcdef": 400, "zbcdef": 10, "ybcdef": 0, "xyzxyz": 3, "xyzxyy": 30, "xyzxya": 30}
    assert got == brute(counts)
    assert got["abcdefgh"][:2] == ("abcdefg", "abcdef") and got["xyzxyz"][0] == "xyzxya" and got["ybcdef"][0] is None
    assert variants.group_variants(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        variants.group_variants(df, 1)


def test_query_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(4)
    stems = ["spelling", "variant", "grouping", "Éclairage", "éclairage", "ÿellowish", "abcdefgh×", "short", "internationalisation", "LETTERS"]
    docs = [(i, " ".join(rng.choice(stems, 12)) + ("-" + "x" * int(i % 9) + "1") * 2) for i in range(400)]
    docs += [(1000, None), (1001, ""), (1002, "漢字 1234567"), (None, "variant variant")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    counts = Counter()
    lower = {c: c + 32 for c in range(65, 91)}
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 2 and len(w) >= 7}
    want = brute(counts)
    assert sum(v[0] is not None for v in want.values()) > 5
    assert results(queries.op13(spark, str(tmp_path))) == want
