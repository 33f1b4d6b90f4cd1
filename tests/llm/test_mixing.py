import itertools

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tracekit.llm import mixing as M


def _cells(spark):
    rows = [(s, lang, float(1 + (7 * i) % 11) * (20 if s == "hot" else 1)) for i, (s, lang) in enumerate(itertools.product(["hot", "b", "c"], ["x", "y"]))]
    return spark.createDataFrame(rows, "source string, lang string, cell_tokens double"), rows


def test_rake_against_a_loop(spark):
    cells, rows = _cells(spark)
    shares = {"source": {"hot": 0.3, "b": 0.3, "c": 0.4}, "lang": {"x": 0.5, "y": 0.5}}
    targets = {d: spark.createDataFrame(list(t.items()), f"{d} string, share double") for d, t in shares.items()}
    got = {(r.source, r.lang): r.ratio for r in M.rake(cells, targets, 5).collect()}
    total = sum(n for _, _, n in rows)
    w = {(s, lang): n / total for s, lang, n in rows}
    for _ in range(5):
        for k, d in enumerate(("source", "lang")):
            sums = {v: sum(x for key, x in w.items() if key[k] == v) for v in shares[d]}
            w = {key: x * shares[d][key[k]] / sums[key[k]] for key, x in w.items()}
    for s, lang, n in rows:
        assert got[s, lang] == pytest.approx(w[s, lang] / (n / total))


def test_sample_follows_the_targets_and_takes_odd_rows(spark):
    docs = spark.range(6000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, F.lit(None)).otherwise("s").alias("source"),
        F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"), (F.col("id") % 50).alias("n"), F.lit(1).alias("share"), F.lit("x").alias("mix_kept"))
    out = M.sample_mix(docs, ["source", "lang"], "n", "id").cache()
    rows = out.collect()
    assert len(rows) == 6000 and all(r.mix_probability == 1.0 and r.mix_kept_ for r in rows if r.n == 0) and rows[0].mix_kept == "x"
    natural, kept = {}, {}
    for r in rows:
        natural[r.source] = natural.get(r.source, 0) + r.n
        kept[r.source] = kept.get(r.source, 0) + r.n * r.mix_kept_
    want = {s: n**M.POWER for s, n in natural.items()}
    for s in natural:
        assert kept[s] / sum(kept.values()) == pytest.approx(want[s] / sum(want.values()), abs=0.03)
    assert 0 < max(r.mix_probability for r in rows) <= 1
    assert M.sample_mix(docs.limit(0), ["source"], "n", "id").count() == 0
    same = M.sample_mix(docs.limit(3).union(docs.limit(3)), ["lang"], "n", "id").collect()
    assert len(same) == 6 and len({(r.id, r.mix_kept_) for r in same}) == 3


def test_counts_and_topics(spark):
    texts = [None, "", " \n", "a b  c", "x | y", "!!! ??? a", "w " * 400, "w " * 4000]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(M.n_tokens(F.col("t")).alias("n"), M.topic(F.col("t")).alias("topic")).collect()
    assert [r.n for r in got] == [0, 0, 0, 3, 3, 3, 400, 4000]
    assert [r.topic for r in got] == ["empty", "empty", "short", "short", "table", "marked", "prose", "long"]


@pytest.mark.parametrize("share", [0.3, 0.5, 0.9, 1.0])
def test_scale_keeps_the_share(spark, share):
    cells = [(1000.0, 0.4), (300.0, 1.0), (100.0, 1.7), (5.0, 9.0), (1.0, 80.0), (2.0, 0.0)]
    scale = M.scale_for(spark.createDataFrame(cells, "cell_tokens double, ratio double"), share)
    kept = sum(n * min(1.0, scale * r) for n, r in cells)
    assert kept == pytest.approx(min(share * 1408, 1406))


def test_scale_keeps_more_where_the_targets_allow(spark):
    fitted = spark.createDataFrame([(10.0, 1.0), (10.0, 0.8)], "cell_tokens double, ratio double")
    assert M.scale_for(fitted, 0.5) == 1.0
    assert M.scale_for(fitted.limit(0), 0.5) == 1.0


def test_one_rare_document_does_not_thin_out_the_rest(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = docs.limit(1).select(*[F.lit(v).cast(docs.schema[c].dataType).alias(c) for c, v in
                                 (("doc_id", 10**9), ("text", "a few rare words"), ("lang", "xx"), ("source", "rare"), ("n_chars", 16))])
    one = docs.unionByName(odd)
    total = one.agg(F.sum(M.n_tokens(F.col("text")))).first()[0]
    kept = {r.doc_id: r.n for r in P.mixed(spark, one, "").select("doc_id", M.n_tokens(F.col("text")).alias("n")).collect()}
    assert 10**9 in kept and sum(kept.values()) >= 0.4 * total
