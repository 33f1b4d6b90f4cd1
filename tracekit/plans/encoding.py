"""Queries for column encoders and embeddings."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tracekit.operators import embedding as W
from tracekit.operators import encoders as E
from tracekit.operators import mixtures as G
from tracekit.plans import fixtures as X
from tracekit.plans.cleaning import PACK_SQL, _packed
from tracekit.plans.registry import query, table
from tracekit.session import cut, fraction, scratch_path, tidy
from tracekit.sources import tables
from tracekit.functions.codecs import hard_one_hot

FL = f"with {X.FLOWS_SQL}"


def _round(df, *cols):
    return df.select(*[tidy(c).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("e1_min_max", f"""{FL}, r as (select min(byt) - 1e-8 as bl, max(byt) + 1e-8 as bh, min(ln(1 + td)) - 1e-8 as tl, max(ln(1 + td)) + 1e-8 as th from flows)
select rid, round((byt - bl) / (bh - bl), 6) as byt, round((ln(1 + td) - tl) / (th - tl) * 2 - 1, 6) as td, round(byt, 6) as byt_back, round(td, 6) as td_back from flows, r""")
def e1(spark, sf):
    f = X.flows(spark, sf).select("rid", "byt", "td")
    r = E.fit_ranges(f, ["byt", "td"], log=["td"], minus_one=["td"])
    n = f.select("rid", *[E.normalize(c, r[c]).alias(c) for c in ("byt", "td")])
    n = n.select("*", *[E.denormalize(c, r[c]).alias(f"{c}_back") for c in ("byt", "td")])
    return _round(n, "byt", "td", "byt_back", "td_back")


@query("e2_one_hot", f"""{FL}, c as (select list_sort(list(distinct proto)) as ch from flows)
select rid, cast(ch[1] = proto as double) as a, cast(ch[2] = proto as double) as b, cast(ch[3] = proto as double) as c, proto as back from flows, c""")
def e2(spark, sf):
    f = X.flows(spark, sf).select("rid", "proto")
    ch = E.fit_choices(f, ["proto"])["proto"]
    f = f.select("rid", E.one_hot("proto", ch).alias("h"))
    return f.select("rid", *[F.get("h", i).alias(n) for i, n in enumerate("abc")], E.from_one_hot("h", ch).alias("back"))


@query("e3_bit_pairs", f"{FL} select rid, srcport as port, {' + '.join(f'((srcport >> {15 - i}) & 1) * {i + 1}' for i in range(16))} as weighted from flows")
def e3(spark, sf):
    from tracekit.functions.codecs import decode_bits, encode_bits

    f = X.flows(spark, sf).select("rid", encode_bits("srcport", 16).alias("b"))
    weighted = sum((F.get("b", 2 * i + 1) * (i + 1) for i in range(1, 16)), F.get("b", 1))
    return f.select("rid", decode_bits("b", 16).alias("port"), weighted.cast("bigint").alias("weighted"))


@query("e4_word_embedding", f"{FL} select distinct word, word as back from (select 'p' || srcip as word from flows union all select proto from flows union all select type from flows)")
def e4(spark, sf):
    f = X.flows(spark, sf).select("rid", F.concat(F.lit("p"), F.col("srcip").cast("string")).alias("srcip"), "proto", "type")
    v = cut(W.fit_embedding(f, ["srcip", "proto", "type"], 8), "words")
    words = f.select(F.explode(F.array("srcip", "proto", "type")).alias("word")).distinct()
    back = W.nearest_word(W.embed(words, "word", v, "vec").withColumnRenamed("word", "asked"), "asked", "vec", v)
    return back.select(F.col("asked").alias("word"), F.col("word").alias("back"))


def _mix(spark, sf, c="l_extendedprice", k=5):
    li = table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("rid"), c)
    return li, G.fit_mixture(li, c, k)


@query("e5_mode_normalise")
def e5(spark, sf):
    li, m = _mix(spark, sf)
    enc = G.encode(li, m)
    return enc.withColumn("back", G.decode("l_extendedprice_u", "l_extendedprice_k", m))


@query("e5_round_trip", "select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as rid, round(l_extendedprice, 2) as price from lineitem")
def e5_back(spark, sf):
    back = e5(spark, sf)
    return back.select("rid", tidy("back", 2).alias("price"))


# the encoders themselves, on a mixture that is given: what they compute can then be said in SQL
GIVEN = G.Mixture("l_extendedprice", (0.5, 0.3, 0.2), (20000.0, 40000.0, 70000.0), (8100.0, 9100.0, 15700.0))
GIVEN_SQL = ("li as (select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as rid, l_extendedprice as x, l_discount from lineitem), "
             "sc as (select *, [" + ", ".join(f"ln({w}e0) - ln({s}e0) - pow(x - {m}e0, 2) / (2 * pow({s}e0, 2))"
                                               for w, m, s in zip(GIVEN.weights, GIVEN.means, GIVEN.stds)) + "] as s from li), "
             "co as (select *, list_position(s, list_max(s)) - 1 as k from sc)")
OFFSET_SQL = f"round(least(greatest((x - {list(GIVEN.means)}[k + 1]) / (4 * {list(GIVEN.stds)}[k + 1]), -0.99), 0.99), 6)"


def _given(spark, sf, *more):
    return table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("rid"), "l_extendedprice", *more)


@query("e5_given_mixture", f"with {GIVEN_SQL} select rid, {OFFSET_SQL} as u, cast(k as int) as k from co")
def e5_given(spark, sf):
    return G.encode(_given(spark, sf), GIVEN).select("rid", tidy("l_extendedprice_u").alias("u"), F.col("l_extendedprice_k").alias("k"))


STEP_COLS = ("l_extendedprice", "l_quantity")
STEP = ((0.5, 0.3, 0.2), (-0.8, 0.1, 1.4), (0.5, 0.4, 0.7))  # weights, means and deviations in standard units
STEP_LOG_SQL = ", ".join(f"ln({w}e0) - ln({s}e0) - pow(z - ({m}e0), 2) / (2 * pow({s}e0, 2))" for w, m, s in zip(*STEP))


@query("e5_one_update", f"""with v as ({" union all ".join(f"select '{c}' as name, cast({c} as double) as x from lineitem" for c in STEP_COLS)}),
a as (select name, avg(x) as m, stddev_pop(x) as s from v group by name),
z as (select name, (x - m) / s as z from v join a using (name)),
l as (select name, z, [{STEP_LOG_SQL}] as l from z),
e as (select name, z, [exp(x - list_max(l)) for x in l] as e from l),
n as (select name, i as component, sum(e[i + 1] / list_sum(e)) as n, sum(z * e[i + 1] / list_sum(e)) as s1,
  sum(z * z * e[i + 1] / list_sum(e)) as s2 from e, range(3) t(i) group by name, i),
g as (select *, 1 + n as taken, {G.CONCENTRATION} + coalesce(sum(n) over (partition by name order by component rows between 1 following and unbounded following), 0) as rest from n),
w as (select *, taken / (taken + rest) * coalesce(exp(sum(ln(rest / (taken + rest))) over (partition by name order by component rows between unbounded preceding and 1 preceding)), 1) as w from g)
select name, cast(component as int) as component, round(w / sum(w) over (partition by name), 6) as weight, round(s1 / (1 + n), 6) as mean,
round(sqrt((1 + s2 - s1 * s1 / (1 + n)) / (1 + n)), 6) as std from w""")
def e5_update(spark, sf):
    """One pass from given parameters over both columns, and the variational update that follows."""
    li = table(spark, sf, "lineitem")
    r = li.agg(*[f(c) for c in STEP_COLS for f in (F.avg, F.stddev_pop)]).first()
    w, m, s = (np.array(x) for x in STEP)
    given = np.stack([np.log(w) - np.log(s) - m * m / (2 * s * s), m / (s * s), -1 / (2 * s * s)])
    found = G.component_sums(G.value_counts(li, STEP_COLS), [(r[0], r[1]), (r[2], r[3])], [given] * 2)
    rows = []
    for i, c in enumerate(STEP_COLS):
        p = G.update(found[i][0])
        rows += [(c, j, *map(float, (p["weight"][j], p["mean"][j], math.sqrt(p["spread"][j] / p["n"][j])))) for j in range(3)]
    out = spark.createDataFrame(rows, "name string, component int, weight double, mean double, std double")
    return _round(out, "weight", "mean", "std")


@query("e6_given_draw", f"""with {GIVEN_SQL}, p as (select rid, x, [exp(s[i] - list_max(s)) for i in range(1, 4)] as r from co),
q as (select rid, x, [(r[i] / list_sum(r) + 1e-6) / (1 + 3e-6) for i in range(1, 4)] as p, {X.fraction_sql('e6', 'rid')} as u from p),
d as (select rid, x, least(cast(p[1] <= u as int) + cast(p[1] + p[2] <= u as int) + cast(p[1] + p[2] + p[3] <= u as int), 2) as k from q)
select rid, {OFFSET_SQL} as u, cast(k as int) as k from d""")
def e6_given(spark, sf):
    drawn = G.drawn_component(_given(spark, sf), "l_extendedprice", GIVEN, fraction("e6", "rid"), "comp")
    return G.encode(drawn, GIVEN, "comp").select("rid", tidy("l_extendedprice_u").alias("u"), F.col("l_extendedprice_k").alias("k"))


@query("e7_given_counts", f"with {GIVEN_SQL} select cast(k as int) as component, count(*) as n from co group by k")
def e7_given(spark, sf):
    """A fourth component far from all rows is never the most probable one and goes."""
    far = G.Mixture(GIVEN.column, (*GIVEN.weights, 0.1), (*GIVEN.means, 1e9), (*GIVEN.stds, 10.0))
    rows = _given(spark, sf)
    return G.component_counts(rows, "l_extendedprice", G.keep_modal(rows, far))


@query("e8_given_order", f"""with {GIVEN_SQL}, f as (select k, row_number() over (order by count(*) desc, k) - 1 as slot from co group by k)
select rid, cast(slot as int) as slot from co join f using (k)""")
def e8_given(spark, sf):
    rows = _given(spark, sf)
    m = G.order_by_frequency(rows, GIVEN)
    hot = G.slots(G.modal_component("l_extendedprice", m), m)
    return rows.select("rid", (F.array_position(hot, F.lit(1.0)) - 1).cast("int").alias("slot"))


@query("e10_given_mixed", f"""with {GIVEN_SQL} select rid, case when l_discount = 0 then 0e0 else {OFFSET_SQL} end as u,
cast(case when l_discount = 0 then 0 else k + 1 end as int) as k from co""")
def e10_given(spark, sf):
    rows = _given(spark, sf, "l_discount").withColumn("l_extendedprice", F.when(F.col("l_discount") == 0, 0.0).otherwise(F.col("l_extendedprice")))
    m = G.Mixture(GIVEN.column, GIVEN.weights, GIVEN.means, GIVEN.stds, (0.0,))
    return G.encode(rows, m).select("rid", tidy("l_extendedprice_u").alias("u"), F.col("l_extendedprice_k").alias("k"))


@query("e6_drawn_component")
def e6(spark, sf):
    li, m = _mix(spark, sf)
    return G.encode(G.drawn_component(li, "l_extendedprice", m, fraction("e6", "rid"), "comp"), m, "comp")


@query("e7_modal_components")
def e7(spark, sf):
    li, m = _mix(spark, sf, k=10)
    return G.component_counts(li, "l_extendedprice", G.keep_modal(li, m))


@query("e8_components_by_frequency")
def e8(spark, sf):
    li, m = _mix(spark, sf)
    m = G.order_by_frequency(li, m)
    return li.select("rid", G.slots(G.modal_component("l_extendedprice", m), m).alias("slots"))


@query("e9_general_column", """with r as (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders where o_orderstatus = 'F')
select o_orderkey, round((o_totalprice - lo) / (hi - lo) * 2 - 1, 6) as u, round(least(greatest(o_totalprice, lo), hi), 6) as back from orders, r""")
def e9(spark, sf):
    o = table(spark, sf, "orders")
    r = E.fit_ranges(o.where("o_orderstatus = 'F'"), ["o_totalprice"], minus_one=["o_totalprice"], eps=0.0)["o_totalprice"]
    n = o.select("o_orderkey", E.normalize("o_totalprice", r).alias("u"))
    return _round(n.withColumn("back", E.denormalize("u", r, clip=True)), "u", "back")


@query("e10_mixed_column")
def e10(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("rid"),
        F.when(F.col("l_discount") == 0, 0.0).otherwise(F.col("l_extendedprice")).alias("x"))
    m = G.fit_mixture(li, "x", 4, modal=[0.0])
    enc = G.encode(li, m)
    return enc.withColumn("back", G.decode("x_u", "x_k", m))


@query("e10_round_trip", """select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as rid,
case when l_discount = 0 then 0 else round(l_extendedprice, 2) end as x, cast(l_discount = 0 as int) as modal from lineitem""")
def e10_back(spark, sf):
    return e10(spark, sf).select("rid", tidy("back", 2).alias("x"), (F.col("x_k") == 0).cast("int").alias("modal"))


@query("e11_frequency_order", f"""{FL}, c as (select list(proto order by n desc, proto) as ch from (select proto, count(*) as n from flows group by 1))
select rid, cast(list_position(ch, proto) as int) as slot, array_to_string(ch, ',') as layout from flows, c""")
def e11(spark, sf):
    f = X.flows(spark, sf).select("rid", "proto")
    ch = E.fit_choices(f, ["proto"], by_frequency=True)["proto"]
    hot = E.one_hot("proto", ch)
    return f.select("rid", F.array_position(hot, F.lit(1.0)).cast("int").alias("slot"), F.lit(",".join(ch)).alias("layout"))


@query("e12_log_transform", """with r as (select min(c_acctbal) as lo, min(c_custkey) as kl from customer)
select c_custkey, round(ln(c_acctbal + case when lo > 0 then 0 when lo = 0 then 1 else 1 - lo end), 6) as bal,
round(ln(c_custkey + case when kl > 0 then 0 when kl = 0 then 1 else 1 - kl end), 6) as k, round(c_acctbal, 6) as back from customer, r""")
def e12(spark, sf):
    c = table(spark, sf, "customer")
    lo, kl = c.agg(F.min("c_acctbal"), F.min("c_custkey")).first()
    e = c.select("c_custkey", E.log_encode("c_acctbal", lo).alias("bal"), E.log_encode("c_custkey", kl).alias("k"))
    return _round(e.withColumn("back", E.log_decode("bal", lo)), "bal", "k", "back")


@query("e13_label_encode", """select p_partkey, dense_rank() over (order by p_name) - 1 as code, p_name as back from part""")
def e13(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    labels = cut(E.label_table(p, "p_name"), "labels")
    coded = E.label_encode(p, "p_name", labels, "code").select("p_partkey", "code")
    return E.label_decode(coded, "code", labels, "back")


@query("e14_round_integers", "select event_id, cast(round_even(value * 2, 0) as bigint) as v from (select event_id, round(value) / 4 as value from events)")
def e14(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.round("value") / 4 * 2).alias("v"))
    return E.round_integers(e, ["v"])


@query("e15_bench_features", """with t as (select c_custkey, cast(c_custkey % 2 as int) as half, case when c_custkey % 7 <> 0 then c_acctbal end as bal, c_mktsegment as seg from customer),
m as (select avg(bal) filter (where half = 1) as mean, stddev_pop(bal) filter (where half = 1) as sd, avg(bal) filter (where half = 0) as syn_mean from t),
ch as (select list_sort(list(distinct seg)) as ch from t where half = 1)
select c_custkey, half, round((coalesce(bal, case when half = 1 then mean else syn_mean end) - mean) / sd, 6) as x, cast(list_position(ch, seg) as int) as slot from t, m, ch""")
def e15(spark, sf):
    t = table(spark, sf, "customer").select(
        "c_custkey", (F.col("c_custkey") % 2).cast("int").alias("half"),
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("bal"), F.col("c_mktsegment").alias("seg"))
    a, b = E.bench_features(t.where("half = 1"), [t.where("half = 0")], ["bal"], ["seg"])
    both = a.unionByName(b)
    return both.select("c_custkey", "half", tidy(F.get("features", 0)).alias("x"),
                       F.array_position(F.slice("features", 2, F.size("features")), F.lit(1.0)).cast("int").alias("slot"))


@query("e16_scale_both", f"""{FL}, r as (select min(byt) as lo, max(byt) as hi from flows where half = 1)
select rid, half, round((byt - lo) / (hi - lo), 6) as byt from flows, r""")
def e16(spark, sf):
    f = X.flows(spark, sf).select("rid", "half", "byt")
    r = E.fit_ranges(f.where("half = 1"), ["byt"], eps=0.0)["byt"]
    return _round(f.withColumn("byt", E.normalize("byt", r)), "byt")


@query("e17_scaled_one_hot", f"""{FL}, c as (select list_sort(list(distinct proto)) as ch from flows)
select rid, cast(list_position(ch, proto) as int) as slot, round(1 / sqrt(2), 6) as height from flows, c""")
def e17(spark, sf):
    f = X.flows(spark, sf).select("rid", "proto")
    h = f.select("rid", E.one_hot("proto", E.fit_choices(f, ["proto"])["proto"], 2 ** -0.5).alias("h"))
    return h.select("rid", F.array_position("h", F.array_max("h")).cast("int").alias("slot"), tidy(F.array_max("h")).alias("height"))


def _with_attr(spark, sf):
    return _packed(spark, sf).withColumn("attr", F.array(F.lit(1.0)))


@query("e18_normalise_per_session", f"""{PACK_SQL},
b as (select *, min(value) over w - 1e-4 as lo, max(value) over w + 1e-4 as hi from packed window w as (partition by user_id, event_type))
select user_id, event_type, pos, round((value - lo) / (hi - lo) * 2 - 1, 6) as x, k, round((hi + lo) / 2, 6) as mid, round((hi - lo) / 2, 6) as half, round(value * flag, 6) as back from b""")
def e18(spark, sf):
    n = E.normalize_per_session(_with_attr(spark, sf), [0], 2, minus_one=True)
    back = E.denormalize_per_session(n, [0], 2, minus_one=True).select("user_id", "event_type", F.col("feat").alias("b"))
    j = n.join(back, ["user_id", "event_type"])
    rows = j.select("user_id", "event_type", "attr", F.posexplode(F.arrays_zip(F.col("feat").alias("x"), F.col("b").alias("b"))).alias("pos", "s"))
    return rows.select("user_id", "event_type", "pos", tidy(F.get("s.x", 0)).alias("x"), F.get("s.x", 1).alias("k"),
                       tidy(F.get("attr", 1)).alias("mid"), tidy(F.get("attr", 2)).alias("half"), tidy(F.get("s.b", 0)).alias("back"))


SPANS = [(0, 3), (3, 5), (8, 24), (32, 32)]


@query("e19_hard_one_hot", "select vec_id, " + ", ".join(
    f"cast(embedding[{i + 1}] >= list_max(embedding[{g[0] + 1}:{g[0] + g[1]}]) as double) as h{i}" for g in SPANS for i in range(g[0], g[0] + g[1]))
    + " from embeddings")
def e19(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", hard_one_hot("embedding", SPANS).alias("h"))
    return e.select("vec_id", *[F.get("h", i).alias(f"h{i}") for i in range(64)])


@query("e21_truncated_svd")
def e21(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return W.project(e, "v", W.fit_svd(e, "v"), "reduced").select("vec_id", "reduced")


@query("e21_gram_energy", """select round(sum(list_sum([x::double * x::double for x in embedding])), 3) as energy, 64 as rank from embeddings""")
def e21_energy(spark, sf):
    """Projected on all 64 directions, the total squared length of the rows is unchanged."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    v = W.fit_svd(e, "v", 64)
    p = W.project(e, "v", v, "r")
    energy = F.sum(F.aggregate("r", F.lit(0.0), lambda a, x: a + x * x))
    return p.agg(tidy(energy, 3).alias("energy"), F.lit(v.shape[1]).alias("rank"))


@query("j8_nearest_embedded", """with l as (select label, i, avg(embedding[i]::double) as m from embeddings, range(1, 65) r(i) group by label, i),
c as (select label, list(m order by i) as c from l group by label)
select vec_id, cast(label as varchar) as word from (
  select vec_id, c.label, row_number() over (partition by vec_id order by list_cosine_similarity(embedding::double[], c.c) desc) as k from embeddings, c) where k = 1""")
def j8(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    means = e.groupBy("label").agg(F.array(*[F.avg(F.get("v", i)) for i in range(64)]).alias("vector"))
    words = means.select(F.col("label").cast("string").alias("word"), "vector")
    return W.nearest_word(e.select("vec_id", "v"), "vec_id", "v", words)


@query("j9_nearest_number", """with k as (select distinct p_retailprice as v from part),
q as (select o_orderkey, o_totalprice / 200 as v from orders),
lo as (select o_orderkey, q.v, k.v as below from q asof left join k on q.v >= k.v),
hi as (select o_orderkey, k.v as above from q asof left join k on q.v <= k.v)
select o_orderkey, round(v, 6) as v, case when above is null or v - below <= above - v then coalesce(below, above) else above end as nearest
from lo join hi using (o_orderkey)""")
def j9(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 200).alias("v"))
    out = W.nearest_number(o, "v", table(spark, sf, "part"), "p_retailprice", "o_orderkey")
    return _round(out, "v")


@query("s15_session_tables", f"""{PACK_SQL} select user_id, event_type, round(sum(value), 6) as total, sum(flag) as length, 2 as n_fields from packed group by all""")
def s15(spark, sf):
    path = scratch_path(spark, "s15")
    packed = _packed(spark, sf)
    e = table(spark, sf, "events")
    fields = E.field_table(spark, E.fit_ranges(e, ["value"]), E.fit_choices(e, ["event_type"]))
    tables.write_sessions(packed, fields, path)
    s, f = tables.read_sessions(spark, path)
    total = F.aggregate(F.transform("feat", lambda x: F.get(x, 0)), F.lit(0.0), lambda a, x: a + x)
    length = F.aggregate("gen_flag", F.lit(0.0), lambda a, x: a + x)
    return s.select("user_id", "event_type", tidy(total).alias("total"), length.alias("length"), F.lit(f.count()).alias("n_fields"))


SPLIT_SQL = f"case when {X.fraction_sql(3, 'o_orderkey')} < 0.15 then 'test' when {X.fraction_sql(3, 'o_orderkey')} < 0.3 then 'val' else 'train' end"


def _split_orders(spark, sf):
    from tracekit.operators.sampling import three_way_split

    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    return three_way_split(o, (0.7, 0.15, 0.15), 3, "o_orderkey")


@query("s16_split_tables", f"select o_orderkey, o_custkey, o_totalprice, o_orderpriority, o_orderstatus as y, {SPLIT_SQL} as split from orders")
def s16(spark, sf):
    path = scratch_path(spark, "s16")
    o = _split_orders(spark, sf)
    tables.write_splits(o, tables.roles_from_types(o.drop("split"), "o_orderstatus"), path)
    return tables.read_splits(spark, path)


@query("s16_split_info", f"select {SPLIT_SQL} as split, count(*) as size, 3 as n_num_features, 1 as n_cat_features from orders group by 1")
def s16_info(spark, sf):
    o = _split_orders(spark, sf)
    return tables.write_splits(o, tables.roles_from_types(o.drop("split"), "o_orderstatus"), scratch_path(spark, "s16i"))

