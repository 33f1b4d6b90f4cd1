import numpy as np

from tracekit.llm import forest as N

SCHEMA = "vec_id long, embedding array<float>, name string, v int, keys int"


def _table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "n", 1, 2) for i, v in rows], SCHEMA)


def _exact(rows, q, k):
    own = dict(rows)[q]
    scored = sorted((-float(np.dot(np.float64(np.float32(own)), np.float64(np.float32(v)))), i) for i, v in rows if i != q)
    return [(i, -s) for s, i in scored[:k]]


def test_small_tables_are_searched_whole_with_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-2, 3, 4).tolist()) for i in range(60)]
    rows = [(i, v if any(v) else [1, 0, 0, 0]) for i, v in rows]
    df = _table(spark, rows)
    got = N.neighbours(df, df.where("vec_id % 20 = 0"), 5).collect()
    for q in (0, 20, 40):
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [(i, s) for _, i, s in mine] == _exact(rows, q, 5) and [r for r, _, _ in mine] == [1, 2, 3, 4, 5]


def test_hot_vector_and_unusable_rows(spark):
    rows = [(i, [1, 2]) for i in range(100)] + [(200, [2, 1]), (201, [-1, -1])]
    odd = [(300, None), (301, [0, 0]), (302, [float("nan"), 1]), (303, [None, 1]), (304, [float("inf"), 1]), (305, [1, 2, 3]), (None, [5, 5])]
    df = _table(spark, rows + odd + rows[:3])
    got = N.neighbours(df, df.where("vec_id % 20 = 0"), 20).collect()
    assert {r.query_id for r in got} == {0, 20, 40, 60, 80, 200}
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 0), key=lambda r: r["rank"])] == list(range(1, 21))
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 20), key=lambda r: r["rank"])] == list(range(20))
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 200), key=lambda r: r["rank"])] == list(range(20))


def test_few_and_no_candidates(spark):
    df = _table(spark, [(0, [1, 0]), (1, [0, 1]), (2, [1, 1])])
    got = N.neighbours(df, df.where("vec_id = 0"), 20).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, 1.0), (1, 0.0)]
    assert N.neighbours(df.limit(0), df.limit(0), 20).count() == 0
    assert N.neighbours(df.where("vec_id = 0"), df.where("vec_id = 0"), 20).count() == 0


def test_recall_with_small_blocks(spark, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    data = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in rows.collect()}
    ids, x = np.array(list(data)), np.stack(list(data.values()))
    monkeypatch.setattr(N, "INDEX_BLOCK", 64)
    got = N.neighbours(rows, rows.where("vec_id % 20 = 0"), 20).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
        assert abs(r.score - data[r.query_id] @ data[r.vec_id]) < 1e-12
    hits = 0
    for q in found:
        s = x @ data[q]
        s[ids == q] = -np.inf
        hits += len(found[q] & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
    assert len(found) == 100 and hits >= 0.95 * 20 * len(found)


def test_queue_gives_leaves_by_smallest_margin():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 8))
    f = N.Forest.fit(x)
    assert f.levels >= 3
    home = f.leaves(x[:20])
    for q, found in zip(home, f.search(x[:20], 1.0)):
        assert len(found) == len(set(found)) == N.TREES << f.levels
        assert set(enumerate(q.tolist())) == set(found[: N.TREES]) or set(enumerate(q.tolist())) <= set(found)
