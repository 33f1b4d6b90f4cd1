import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracekit.operators import encoders as E
from tracekit.operators import mixtures as G
from tracekit.operators import reshape as T
from tracekit.operators import sampling as R
from tracekit.operators import sessions as W
from tracekit.operators import tokens as K


@pytest.fixture(scope="module")
def four(spark):
    rows = [
        (0, 1.0, 1, dt.datetime(2021, 3, 1), "what"), (1, 0.123, 23, dt.datetime(2022, 4, 2, 5), "is"),
        (2, 32.2334, 4, dt.datetime(2020, 1, 1), "deep"), (3, 100.32, 1232, dt.datetime(2021, 1, 5), "learning"),
    ]
    return spark.createDataFrame(rows, "key int, f double, i int, d timestamp, s string")


def texts(df, codec):
    return [r[0] for r in df.orderBy("key").select(K.digits(codec)).collect()]


def test_digit_strings(four):
    assert texts(four, K.fit_digits(four, ["i"])["i"]) == ["0001", "0023", "0004", "1232"]
    assert texts(four, K.fit_digits(four, ["f"], max_len=5)["f"]) == ["001.0", "000.1", "032.2", "100.3"]
    with pytest.raises(ValueError):
        K.fit_digits(four, ["f"], max_len=4)


def test_fitted_widths_are_reused(spark, four):
    codec = K.fit_digits(four, ["i"])["i"]
    other = spark.createDataFrame([(0, 7)], "key int, i int")
    assert texts(other, codec) == ["0007"]


def test_column_counts(four):
    codec = K.fit_table(four, ["f", "i", "d", "s"], nparts=2)
    kinds = [p.split("___")[1] for p in codec.processed]
    assert (kinds.count("NUMERIC"), kinds.count("DATETIME"), kinds.count("CATEGORICAL")) == (4 + 2, 5, 1)


def test_vocabulary_order(four):
    plain = four.select("key", F.array(F.format_string("%s", F.col("f")), F.col("i").cast("string"), "s").alias("tokens"))
    v = {r.token: r.id for r in K.build_vocab(plain, ["0___NUMERIC___f"] * 3, special=[], add_columns=False).collect()}
    assert (v["0.123"], v["100.32"], v["1232"], v["learning"]) == (0, 2, 5, 10)
    full = K.build_vocab(plain, ["0___NUMERIC___f", "1___NUMERIC___i", "2___CATEGORICAL___s"])
    assert full.count() == 11 + 12 + 3


def test_table_round_trip_with_missing(spark):
    rows = [(i, None if i % 5 == 0 else i / 8 - 3, i * 7 - 40, dt.datetime(2020, 1, 1) + dt.timedelta(hours=i), "ab"[i % 2])
            for i in range(40)]
    df = spark.createDataFrame(rows, "key int, x double, n bigint, d timestamp, s string")
    codec = K.fit_table(df, ["x", "n", "d", "s"])
    tokens = K.tokenize(df, codec, "key")
    vocab = K.build_vocab(tokens, codec.processed)
    ids = K.encode_ids(tokens, vocab, "key", len(codec.processed))
    back = K.decode_rows(K.ids_to_tokens(ids, vocab, "key"), codec, ["key"])
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_members_of_wrong_width_are_left_out(spark):
    seq = ["[BOS]", "[BMEM]", "a", "b", "[EMEM]", "[BMEM]", "a", "[EMEM]", "[BMEM]", "c", "d", "[EMEM]", "[EOS]", "x", "y"]
    df = spark.createDataFrame([(1, seq), (2, ["[BOS]", "[EOS]"])], "key int, tokens array<string>")
    got = K.split_members(df, "key", 2).collect()
    assert [(r.key, r.member, r.tokens) for r in got] == [(1, 0, ["a", "b"]), (1, 1, ["c", "d"])]


def test_surplus_decimal_points(spark):
    codec = K.ColumnCodec("x", K.NUMERIC, integral=False)
    df = spark.createDataFrame([("001.2.3",), ("000",), ("-05.5",), ("1." + "0" * 99 + ".5",)], "t string")
    assert [r[0] for r in df.select(K.join_digits(F.col("t"), codec)).collect()] == ["1.23", "0", "-05.5", "1." + "0" * 99 + "5"]


def test_min_max_and_log_inverse(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 5, 100)], "x double")
    r = E.fit_ranges(df, ["x"], log=["x"], minus_one=["x"])["x"]
    for row in df.select("x", E.normalize("x", r).alias("u")).select("x", "u", E.denormalize("u", r).alias("b")).collect():
        assert -1 <= row.u <= 1 and row.b == pytest.approx(row.x, abs=1e-6)
    for lower in (2.0, 0.0, -7.5):
        v = spark.range(1).select(E.log_decode(E.log_encode(F.lit(lower), lower), lower)).first()[0]
        assert v == pytest.approx(lower)


def test_category_with_missing(spark):
    df = spark.createDataFrame([(None,), ("b",), ("c",)] * 10, "s string")
    ch = E.fit_choices(df, ["s"])["s"]
    assert ch == ["b", "c"]
    hot = df.select("s", E.one_hot("s", ch).alias("h")).distinct().collect()
    assert {r.s: r.h for r in hot} == {None: [0, 0], "b": [1, 0], "c": [0, 1]}


def test_mixture_bounds(spark):
    rng = np.random.default_rng(5)
    normal = spark.createDataFrame([(float(x),) for x in rng.normal(size=1000)], "x double")
    m = G.fit_mixture(normal, "x", seed=1)
    assert 1 <= m.size <= 10
    enc = G.encode(normal, m).withColumn("back", G.decode("x_u", "x_k", m))
    lo, hi, mean, worst = enc.agg(F.min("x_u"), F.max("x_u"), F.avg("x_u"), F.max(F.abs(F.col("back") - F.col("x")))).first()
    assert -1 < lo and hi < 1 and abs(mean) < 0.1 and worst < 1e-6
    constant = spark.createDataFrame([(123.0,)] * 100, "x double")
    m = G.fit_mixture(constant, "x")
    u = G.encode(constant, m).agg(F.avg("x_u"), F.max(F.abs("x_u"))).first()
    assert m.size == 1 and abs(u[0]) < 1e-9 and u[1] < 1


def test_modal_values_have_their_own_slots(spark):
    df = spark.createDataFrame([(0.0,)] * 50 + [(float(i),) for i in range(10, 60)], "x double")
    m = G.fit_mixture(df, "x", 3, modal=[0.0])
    enc = G.encode(df, m).withColumn("back", G.decode("x_u", "x_k", m))
    assert enc.where("x = 0 and (x_k <> 0 or back <> 0)").count() == 0
    assert enc.where("x > 0 and x_k = 0").count() == 0


def test_log_frequency_lowers_the_common_category(spark):
    df = spark.createDataFrame([("a",)] * 950 + [("b",)] * 25 + [("c",)] * 25, "s string")
    share = {}
    for log in (False, True):
        cats = R.category_table(df, ["s"], log)
        draws = R.conditional_draws(spark, cats, 4000, 1)
        assert draws.count() == 4000
        share[log] = draws.where("value = 'a'").count() / 4000
    assert share[False] == pytest.approx(0.95, abs=0.02)
    assert share[True] == pytest.approx(math.log(951) / (math.log(951) + 2 * math.log(26)), abs=0.03)


def test_unknown_condition_is_an_error(spark):
    cats = R.category_table(spark.createDataFrame([("a",)], "s string"), ["s"])
    with pytest.raises(ValueError):
        R.fixed_condition(cats, "s", "z")


def test_validated_refill_gives_up(spark):
    from tracekit.operators.clean import RowValidator

    never = RowValidator().add("no", lambda c: c < 0, ["id"])
    with pytest.raises(R.EmptySampleLimit):
        R.validated_refill(lambda s, n: spark.range(n), never, 5, 3, 0, "id", empty_limit=2)


def test_ratios_must_sum_to_one(spark):
    with pytest.raises(ValueError):
        R.three_way_split(spark.range(3), (0.5, 0.2, 0.2), 0, "id")


def test_interarrival_round_trip_over_buckets(spark):
    rows = [(k, float(t * t), t) for k in "ab" for t in range(50)]
    df = spark.createDataFrame(rows, "k string, ts double, n int")
    enc = W.encode_interarrival(df, ["k"], "ts", ["n"], buckets=6)
    dec = W.decode_interarrival(enc.drop("ts"), ["k"], "n", "flow_start", "interarrival").select("k", "ts", "n")
    assert sorted(map(tuple, dec.collect())) == sorted(rows)


def test_sessions_are_dense_over_buckets(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 700, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 5).cast("string"))).alias("k"))
    s = W.sessionize_count(df, ["k"], ["id"], 30, buckets=8)
    assert W.check_sessions(s, ["k"]).first()["ok"] == 1
    assert s.groupBy("session_id").count().agg(F.max("count")).first()[0] == 30


def test_flags_round_trip(spark):
    df = spark.createDataFrame([(1, [[1.0], [2.0], [0.0], [0.0]], [1.0, 1.0, 0.0, 0.0])],
                               "k int, feat array<array<double>>, gen_flag array<double>")
    out = T.add_gen_flag(df, 2).first()
    assert [x[1:] for x in out.feat] == [[1, 0], [0, 1], [0, 0], [0, 0]]
    trimmed = spark.createDataFrame([([0.9, 0.6, 0.2, 0.8],)], "f array<double>").select(T.trim_flags("f")).first()[0]
    assert trimmed == [1, 1, 0, 0]


def test_bins_match_the_edges(spark):
    xs = [round(i * 0.1, 1) for i in range(31)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r.b for r in W.equal_width_bin(df, "x", 20, "b")[0].orderBy("x").collect()]
    edges = np.linspace(0.0, 3.0, 21)
    want = [max(int(np.searchsorted(edges, x, side="left")) - 1, 0) for x in xs]
    assert got == want
