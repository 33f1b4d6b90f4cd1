"""Queries for samples, splits, conditional draws and over-sampling."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tracekit.operators import privacy as V
from tracekit.operators import sampling as R
from tracekit.operators import utility as U
from tracekit.operators.clean import RowValidator, in_range
from tracekit.plans import fixtures as X
from tracekit.plans.registry import query, table
from tracekit.session import cut, fraction, tidy

LI = "li as (select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as rid, * from lineitem)"


def _li(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("rid"), "*")


def _round(df, *cols):
    return df.select(*[tidy(c).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("r1_exact_sample", f"with {LI} select rid, l_quantity from li order by {X.digest_sql('s', 'rid')}, rid limit 1000")
def r1(spark, sf):
    return R.exact_sample(_li(spark, sf).select("rid", "l_quantity"), 1000, "s", "rid")


@query("r1_large_sample", f"with {LI} select rid from li order by {X.digest_sql('s', 'rid')}, rid limit 20000")
def r1_large(spark, sf):
    return R.exact_sample(_li(spark, sf).select("rid"), 20000, "s", "rid")


@query("r2_two_way_split", f"with {LI} select rid, case when {X.fraction_sql(1, 'rid')} < 0.7 then 'train' else 'test' end as split from li")
def r2(spark, sf):
    return R.two_way_split(_li(spark, sf).select("rid"), 0.7, 1, "rid")


@query("r2_exact_split", f"""select o_orderkey, case when row_number() over (order by {X.digest_sql(1, 'o_orderkey')}, o_orderkey)
<= floor((select count(*) from orders) * 0.7) then 'train' else 'test' end as split from orders""")
def r2_exact(spark, sf):
    return R.two_way_split(table(spark, sf, "orders").select("o_orderkey"), 0.7, 1, "o_orderkey", exact=True)


U3 = X.fraction_sql(3, "o_orderkey")
THREE = f"case when {U3} < 0.15 then 'test' when {U3} < 0.3 then 'val' else 'train' end"


@query("r3_three_way_split", f"select o_orderkey, {THREE} as split from orders")
def r3(spark, sf):
    return R.three_way_split(table(spark, sf, "orders").select("o_orderkey"), (0.7, 0.15, 0.15), 3, "o_orderkey")


@query("r3_resplit", f"select o_orderkey, case when {U3} < 0.15 then 'test' when {X.fraction_sql(4, 'o_orderkey')} < 0.2 then 'val' else 'train' end as split from orders")
def r3_resplit(spark, sf):
    return R.resplit(r3(spark, sf), 0.2, 4, "o_orderkey")


@query("r4_head_split", """with n as (select cast(floor(count(*) * 0.7) as int) as a, cast(floor(count(*) * 0.15) as int) as b from events)
select event_id, case when p < a then 'train' when p < a + b then 'val' else 'test' end as split
from (select event_id, row_number() over (order by ts, event_id) - 1 as p from events), n""")
def r4(spark, sf):
    return R.head_split(table(spark, sf, "events").select("ts", "event_id"), ["ts", "event_id"]).select("event_id", "split")


@query("r5_stratified_split", f"""select doc_id, quality, case when row_number() over (partition by quality order by {X.digest_sql(5, 'doc_id')}, doc_id)
<= floor(count(*) over (partition by quality) * 0.3 + 0.5) then 'test' else 'train' end as split from labels""")
def r5(spark, sf):
    return R.stratified_split(table(spark, sf, "labels").select("doc_id", "quality"), "quality", 0.3, 5, "doc_id")


@query("r6_bench_split", f"""with n as (select count(*) as n, cast(round(count(*) * 0.2) as int) as t from embeddings where vec_id % 5 < 2),
r as (select vec_id, row_number() over (order by {X.digest_sql(6, 'vec_id')}, vec_id) as p from embeddings where vec_id % 5 < 2),
s as (select vec_id, row_number() over (order by {X.digest_sql(6, 'vec_id')}, vec_id) as p from embeddings where vec_id % 5 >= 2)
select vec_id, 'real' as side, case when p <= t then 'test' else 'train' end as split from r, n
union all select vec_id, 'synthetic', case when p <= n - t then 'train' else 'test' end from s, n where p <= n""")
def r6(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id")
    real, syn = R.bench_split(e.where("vec_id % 5 < 2"), e.where("vec_id % 5 >= 2"), 0.2, 6, "vec_id")
    return real.withColumn("side", F.lit("real")).unionByName(syn.withColumn("side", F.lit("synthetic")))


@query("r7_permutation_head", f"select event_id from events order by {X.digest_sql('perm', 'event_id')}, event_id limit 500")
def r7(spark, sf):
    return R.exact_sample(table(spark, sf, "events").select("event_id"), 500, "perm", "event_id")


@query("r8_row_cap", f"select o_orderkey from orders order by {X.digest_sql('cap', 'o_orderkey')}, o_orderkey limit 5000")
def r8(spark, sf):
    return R.row_cap(table(spark, sf, "orders").select("o_orderkey"), 5000, "cap", "o_orderkey")


@query("r8_percent_sample", f"""select o_orderkey from (select o_orderkey, row_number() over (order by {X.digest_sql('pc', 'o_orderkey')}, o_orderkey) as p from orders)
where p <= (select cast(floor(count(*) * 0.01 * 15) as int) from orders)""")
def r8_percent(spark, sf):
    return R.percent_sample(table(spark, sf, "orders").select("o_orderkey"), 15, "pc", "o_orderkey")


CATS = ["l_returnflag", "l_linestatus", "l_linenumber"]


def cats_sql(log):
    w = "ln(n + 1.0::double)" if log else "n::double"
    return f"""cl as ({" union all ".join(f"select {i} as column_id, '{c}' as col, cast({c} as varchar) as value from lineitem" for i, c in enumerate(CATS))}),
cn as (select column_id, col, value, count(*) as n from cl group by all),
cw as (select *, {w} as w from cn),
cats as (select column_id, col, row_number() over (order by column_id, value) - 1 as category_id, value, n,
  w / sum(w) over (partition by column_id) as prob,
  (sum(w) over (partition by column_id order by value) - w) / sum(w) over (partition by column_id) as lo,
  case when row_number() over (partition by column_id order by value desc) = 1 then 1.0::double
    else sum(w) over (partition by column_id order by value) / sum(w) over (partition by column_id) end as hi from cw)"""


def _cats(spark, sf, log):
    return R.category_table(table(spark, sf, "lineitem").select(*CATS), CATS, log)


for _log in (False, True):
    def _r9(spark, sf, log=_log):
        c = _cats(spark, sf, log)
        return _round(c, "prob", "lo", "hi").withColumnRenamed("column", "col")

    query("r9_log_frequency" if _log else "r9_frequency",
          f"with {cats_sql(_log)} select column_id, col, category_id, value, n, round(prob, 6) as prob, round(lo, 6) as lo, round(hi, 6) as hi from cats")(_r9)


def draws_sql(seed, log, n="(select count(*) from lineitem)"):
    return f"""{cats_sql(log)},
asked as (select id as draw, cast(floor({X.fraction_sql(f'{seed}-column', 'id')} * 3) as int) as column_id,
  {X.fraction_sql(f'{seed}-category', 'id')} as u from range(0, {n}) t(id)),
draws as (select draw, a.column_id, col, category_id, value, n from asked a join cats c on a.column_id = c.column_id and lo <= u and u < hi)"""


def _draws(spark, sf, seed, log):
    return R.conditional_draws(spark, _cats(spark, sf, log), table(spark, sf, "lineitem").count(), seed)


@query("r10_conditional_draws", f"with {draws_sql(10, True)} select draw, column_id, category_id, value from draws")
def r10(spark, sf):
    return _draws(spark, sf, 10, True).drop("column")


@query("r10_condition_vectors", f"""with {draws_sql(10, True)}, k as (select count(*)::int as k from cats)
select draw, k as width, category_id + 1 as hot, column_id + 1 as col, 1 as ones from draws, k""")
def r10_vectors(spark, sf):
    cats = _cats(spark, sf, True)
    v = R.condition_vectors(_draws(spark, sf, 10, True), cats.count(), len(CATS))
    return v.select("draw", F.size("condition").alias("width"), F.array_position("condition", F.lit(1.0)).alias("hot"),
                    F.array_position("mask", F.lit(1.0)).alias("col"),
                    F.aggregate("condition", F.lit(0.0), lambda a, x: a + x).cast("int").alias("ones"))


@query("r11_frequency_draws", f"with {draws_sql(11, False)} select draw, column_id, category_id, value from draws")
def r11(spark, sf):
    return _draws(spark, sf, 11, False).drop("column")


@query("j5_interval_lookup", f"with {cats_sql(False)} select rid, value from (select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as rid, "
       f"{X.fraction_sql('iv', 'l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey')} as u from lineitem) d join cats on column_id = 2 and lo <= u and u < hi")
def j5(spark, sf):
    d = _li(spark, sf).select("rid", fraction("iv", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("u"), F.lit(2).alias("column_id"))
    return R.pick_interval(d, _cats(spark, sf, False), ["column_id"], "u").select("rid", "value")


RANKED = f"""ranked as (select col, value, rid, row_number() over (partition by col, value order by rid) - 1 as rank from (
  {" union all ".join(f"select '{c}' as col, cast({c} as varchar) as value, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as rid from lineitem" for c in CATS)}))"""


@query("r12_rows_for_draws", f"with {draws_sql(10, True)}, {RANKED} select draw, d.col, d.value, rid from draws d join ranked r on d.col = r.col and d.value = r.value "
       f"and r.rank = cast(floor({X.fraction_sql('12-row', 'draw')} * n) as bigint)")
def r12(spark, sf):
    li = _li(spark, sf).select("rid", *CATS)
    rows = R.rows_for_draws(li, CATS, _draws(spark, sf, 10, True), _cats(spark, sf, True), "rid", 12)
    return rows.withColumnRenamed("column", "col")


@query("j4_row_selection", f"with {draws_sql(11, False)}, {RANKED} select d.col, d.value, count(distinct rid) as n_rows, count(*) as n_draws from draws d "
       f"join ranked r on d.col = r.col and d.value = r.value and r.rank = cast(floor({X.fraction_sql('4-row', 'draw')} * n) as bigint) group by all")
def j4(spark, sf):
    li = _li(spark, sf).select("rid", *CATS)
    rows = R.rows_for_draws(li, CATS, _draws(spark, sf, 11, False), _cats(spark, sf, False), "rid", 4)
    return rows.groupBy(F.col("column").alias("col"), "value").agg(
        F.count_distinct("rid").alias("n_rows"), F.count(F.lit(1)).alias("n_draws"))


@query("r12_uniform_rows", f"""with r as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as rank, count(*) over () as n from orders)
select id as draw, o_orderkey from range(0, (select count(*) from orders)) t(id) join r on r.rank = cast(floor({X.fraction_sql('u-row', 'id')} * n) as bigint)""")
def r12_uniform(spark, sf):
    o = table(spark, sf, "orders")
    return R.uniform_rows(o, o.count(), "o_orderkey", "u")


@query("r13_fixed_condition", f"""with {cats_sql(False)}, {RANKED},
c as (select * from cats where col = 'l_returnflag' and value = 'R')
select id as draw, rid from range(0, (select n from c)) t(id), c join ranked r on r.col = c.col and r.value = c.value
and r.rank = cast(floor({X.fraction_sql('13-row', 'id')} * n) as bigint)""")
def r13(spark, sf):
    cats = _cats(spark, sf, False)
    n = R.fixed_condition(cats, "l_returnflag", "R").first()["n"]
    draws = R.fixed_draws(spark, cats, "l_returnflag", "R", n)
    return R.rows_for_draws(_li(spark, sf).select("rid", *CATS), CATS, draws, cats, "rid", 13).select("draw", "rid")


@query("r14_class_deficit", "with c as (select label, count(*) as n from embeddings group by 1) select label, (select max(n) from c) - n as n from c")
def r14(spark, sf):
    return R.class_deficit(table(spark, sf, "embeddings"), "label")


@query("r14_class_swap", """with c as (select label, count(*) as n from embeddings group by 1)
select a.label, b.n from c a join c b on b.label = case a.label when 0 then 1 when 1 then 0 else a.label end""")
def r14_swap(spark, sf):
    return R.class_deficit(table(spark, sf, "embeddings"), "label", "fix")


# ---- over-sampling ----------------------------------------------------------------------

DIMS = [f"x{i}" for i in range(64)]


def _wide(spark, sf):
    return table(spark, sf, "embeddings").select(
        "vec_id", "label", *[F.get("embedding", i).cast("double").alias(d) for i, d in enumerate(DIMS)])


def oversample_sql(src, key, cls, numeric, frac, delta, seed, k, mismatch="", prefix=""):
    """Neighbours, draws and interpolation over ``src``."""
    scaled = ", ".join(f"({c} - min({c}) over ()) / (max({c}) over () - min({c}) over ()) as s_{c}" for c in numeric)
    d2 = " + ".join(f"pow(a.s_{c} - b.s_{c}, 2)" for c in numeric) + mismatch
    mixed = ", ".join(f"b.{c} + lam * (o.{c} - b.{c}) as {c}" for c in numeric)
    return f"""z as (select *, {scaled} from {src}),
nb as (select * from (select a.{key} as id, b.{key} as ref, row_number() over (partition by a.{key} order by {d2}, b.{key}) as rank
  from z a join z b on a.{cls} = b.{cls} and a.{key} <> b.{key}) where rank <= {k}),
cs as (select {cls}, count(*) as n, cast(floor((1 + {frac}) * count(*)) as bigint) - count(*) as m from {src} group by 1),
ce as (select *, sum(m) over (order by {cls}) as hi, sum(m) over (order by {cls}) - m as lo from cs),
dr as (select id as draw, {cls} as cls, cast(floor({X.fraction_sql(f'{seed}-row', 'id')} * n) as bigint) as pos,
  cast(floor({X.fraction_sql(f'{seed}-neighbour', 'id')} * least({k}, n - 1)) as int) + 1 as rank,
  {X.fraction_sql(f'{seed}-step', 'id')} * (1 - {delta}) + {delta} / 2 as lam
  from range(0, (select sum(m)::bigint from cs)) t(id) join ce on id >= lo and id < hi),
ps as (select *, row_number() over (partition by {cls} order by {key}) - 1 as pos from {src}),
made as (select draw, b.{key} as {key}, b.{cls}, {mixed} from dr join ps b on b.{cls} = dr.cls and b.pos = dr.pos
  join nb on nb.id = b.{key} and nb.rank = dr.rank join {src} o on o.{key} = nb.ref)"""


WIDE_SQL = "w as (select vec_id, label, " + ", ".join(f"embedding[{i + 1}]::double as {d}" for i, d in enumerate(DIMS)) + " from embeddings)"


@query("r15_oversample", f"with {WIDE_SQL}, {oversample_sql('w', 'vec_id', 'label', DIMS, 1.0, 0.2, 15, 5)} select draw, label, "
       + ", ".join(f"round({d}, 6) as {d}" for d in DIMS) + " from made")
def r15(spark, sf):
    return _round(R.oversample(_wide(spark, sf), DIMS, "label", "vec_id", delta=0.2, seed=15), *DIMS)


CUST = """w as (select c_custkey as key, c_mktsegment as seg, cast(c_nationkey as varchar) as nation, c_acctbal as bal,
  sqrt(c_custkey::double) as k from customer)"""
MID = ("mid as (select (stddev_pop(s_bal) + stddev_pop(s_k)) / 2 as m from (select (bal - min(bal) over ()) / (max(bal) over () - min(bal) over ()) as s_bal, "
       "(k - min(k) over ()) / (max(k) over () - min(k) over ()) as s_k from w)), wm as (select w.*, m from w, mid)")


@query("r16_oversample_mixed", f"""with {CUST}, {MID}, {oversample_sql('wm', 'key', 'seg', ['bal', 'k'], 0.5, 0.0, 16, 5,
    mismatch=" + case when a.nation <> b.nation then 2 * pow(a.m / 2, 2) else 0 end")},
md as (select id, arg_min(nation, struct_pack(c := -c, v := nation)) as nation from (
  select id, w.nation, count(*) as c from nb join w on w.key = nb.ref group by all) group by id)
select draw, seg, round(bal, 6) as bal, round(k, 6) as k, md.nation from made join md on md.id = made.key""")
def r16(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").cast("string").alias("nation"),
        F.col("c_acctbal").alias("bal"), F.sqrt(F.col("c_custkey").cast("double")).alias("k"))
    return _round(R.oversample(c, ["bal", "k"], "seg", "key", ["nation"], frac=0.5, seed=16), "bal", "k")


@query("r17_oversample_regression", f"""with {WIDE_SQL}, h as (select vec_id, cast(x63 > (select quantile_cont(x63, 0.5) from w) as int) as half, {', '.join(DIMS)} from w),
{oversample_sql('h', 'vec_id', 'half', DIMS, 1.0, 0.0, 17, 5)} select draw, {', '.join(f'round({d}, 6) as {d}' for d in DIMS)} from made""")
def r17(spark, sf):
    return _round(R.oversample_regression(_wide(spark, sf).drop("label"), DIMS[:-1], DIMS[-1], "vec_id", seed=17), *DIMS)


def _near_copies(rows):
    """Generator: rows moved by up to a tenth, a different draw for every seed."""

    def make(seed, n):
        made = R.exact_sample(rows, n, seed, "id").withColumn("scale", 0.9 + 0.2 * fraction(seed, "id"))
        return made.select((F.col("id") * 1000 + seed).alias("id"),
                           F.transform("vec", lambda x: x * F.col("scale")).alias("vec"))

    return make


def _vectors(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return e.where("id % 2 = 1"), e.where("id % 2 = 0")


def _distance(real, rows):
    return V.distance_to_closest(real, rows, "l2")


@query("r18_privacy_refill")
def r18(spark, sf):
    real, other = _vectors(spark, sf)
    kept, _ = R.privacy_refill(real, _near_copies(other), _distance, 0.2, other.count(), "id")
    return kept.select("id", "round")


def _orders_batch(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")

    def make(seed, n):
        return R.exact_sample(o, n, f"batch-{seed}", "o_orderkey")

    return make


@query("r19_validated_refill", f"""with n as (select count(*) // 3 as n, (count(*) // 3) // 2 as b from orders),
batches as (select r.i as round, o_orderkey, o_totalprice, row_number() over (partition by r.i order by md5(concat_ws('|', 'batch-' || r.i, o_orderkey)), o_orderkey) as p
  from orders, range(0, 12) r(i)),
valid as (select round, o_orderkey, o_totalprice from batches, n where p <= b and o_totalprice between 1000 and 250000),
found as (select round, sum(count(*)) over (order by round) - count(*) as earlier from valid group by round),
pool as (select v.* from valid v join found f using (round), n where f.earlier < n),
pick as (select *, row_number() over (order by {X.digest_sql('r19', 'round', 'o_orderkey')}, round, o_orderkey) as k from pool)
select cast(round as int) as round, o_orderkey, o_totalprice from pick, n where k <= n""")
def r19(spark, sf):
    o = table(spark, sf, "orders")
    n = o.count() // 3
    valid = RowValidator().add("price", lambda p: in_range(p, 1000, 250000), ["o_totalprice"])
    sample, _ = R.validated_refill(_orders_batch(spark, sf), valid, n, n // 2, "r19", "o_orderkey")
    return sample


@query("r20_bootstrap_rounds", f"""with n as (select cast(ceil(count(*) * 0.33) as int) as held from embeddings),
p as (select vec_id, cast(r.i as int) as round, row_number() over (partition by r.i order by {X.digest_sql(20, 'r.i', 'vec_id')}, vec_id) - 1 as p from embeddings, range(5) r(i))
select vec_id, round, case when p < held // 2 then 'synthetic' when p < held then 'test' else 'original' end as role from p, n""")
def r20(spark, sf):
    return R.bootstrap_rounds(table(spark, sf, "embeddings").select("vec_id"), 5, 0.165, 20, "vec_id")


@query("r20_bootstrap_sample", f"""with n as (select cast(floor(count(*) * 2 * 0.05) as int) as size from embeddings),
p as (select vec_id, cast(r.i as int) as round, row_number() over (partition by r.i order by {X.digest_sql(21, 'r.i', 'vec_id')}, vec_id) - 1 as p from embeddings, range(5) r(i))
select vec_id, round, case when p < 3 * size then 'original' when p < 4 * size then 'synthetic' else 'test' end as role from p, n where p < 5 * size""")
def r20_sample(spark, sf):
    return R.bootstrap_rounds(table(spark, sf, "embeddings").select("vec_id"), 5, 0.05, 21, "vec_id", full=False)


@query("r21_head_rows", "select event_id from events order by ts, event_id limit 2001")
def r21(spark, sf):
    return R.head_rows(table(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"], 2000).select("event_id")


@query("v8_privacy_sweep")
def v8(spark, sf):
    real, other = _vectors(spark, sf)
    real, other = cut(real, "real"), cut(other, "other")
    # utility: how well a learner trained on the kept rows predicts the first coordinate of real ones
    labelled = lambda rows: rows.select(array_to_vector(F.slice("vec", 2, F.size("vec") - 1)).alias("features_vec"), F.get("vec", 0).alias("label"))
    score = lambda rows: U.regression_scores(U.regressors()["ridge"].fit(labelled(rows)).transform(labelled(real)))["rmse"]
    return V.privacy_sweep(real, _near_copies(other), _distance, score, other.count(), "id", (0.1, 0.2, 0.3, 0.4))
