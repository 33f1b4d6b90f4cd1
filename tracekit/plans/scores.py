"""Queries for fidelity and privacy metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tracekit.operators import embedding as W
from tracekit.operators import fidelity as M
from tracekit.operators import privacy as V
from tracekit.operators.nearest import Metric, nearest
from tracekit.plans import fixtures as X
from tracekit.plans.registry import query, table
from tracekit.roles import RoleSpec
from tracekit.session import cut, fraction, tidy

FL = f"with {X.FLOWS_SQL}"


def _halves(spark, sf):
    return X.real_and_synthetic(X.flows(spark, sf))


def _round(df, *cols):
    return df.select(*[tidy(c).alias(c) if c in cols else F.col(c) for c in df.columns])


# SQL blocks: c(metric, value, n_real, n_syn) -> metric values
def counts_sql(exprs, extra=""):
    rows = " union all ".join(f"select '{m}' as metric, {e} as value, half from flows" for m, e in exprs.items())
    return (f"long as ({rows}{extra}), c as (select metric, value, count(*) filter (where half = 1) as n_real, "
            "count(*) filter (where half = 0) as n_syn from long where value is not null group by all)")


SHARES = ("s as (select metric, value, n_real / sum(n_real) over (partition by metric) as p, "
          "n_syn / sum(n_syn) over (partition by metric) as q from {c})")
JS = ("greatest(sum(case when p > 0 then p * ln(p / ((p + q) / 2)) else 0 end + "
      "case when q > 0 then q * ln(q / ((p + q) / 2)) else 0 end) / 2, 0)")


def js_sql(c="c", expr=JS, s="s", out="js"):
    return SHARES.format(c=c).replace("s as (", f"{s} as (", 1) + f", {out} as (select metric, round({expr}, 6) as value from {s} group by metric)"


def emd_sql(c="c", out="emd"):
    return f"""{out}_r as (select metric, value,
  sum(n_real) over w - n_real as cr, sum(n_syn) over w - n_syn as cs,
  sum(n_real) over (partition by metric) as tr, sum(n_syn) over (partition by metric) as ts,
  value - lag(value) over w as gap from {c}
  window w as (partition by metric order by value)),
{out} as (select metric, round(sum(coalesce(abs(cr / tr - cs / ts) * gap, 0)), 6) as value from {out}_r group by metric)"""


@query("m1_empirical_cdf", """select l_quantity as value, round(sum(count(*)) over (order by l_quantity) / (select count(*) from lineitem), 6) as cdf
from lineitem group by l_quantity""")
def m1(spark, sf):
    return _round(M.empirical_cdf(table(spark, sf, "lineitem"), "l_quantity"), "cdf")


DISC = {"proto": "proto", "type": "type", "pkt": "pkt::varchar", "srcip": "srcip::varchar"}


@query("m2_js_discrete", f"{FL}, {counts_sql(DISC)}, {js_sql()} select metric, value from js")
def m2(spark, sf):
    return _round(M.js_discrete(*_halves(spark, sf), list(DISC)), "value")


def _hist_sql(col, compat):
    inside = f"case when {col} < lo then -1 when {col} > hi then nb else greatest(len(list_filter(edges, lambda e: e <= {col})) - 1, 0) end"
    inside = f"case when {col} = hi then nb - 1 else {inside} end"
    return f"case when {col} between lo and hi then {inside} end" if compat else inside


def _bins_sql(col):
    return f"""b_{col} as (select lo, hi, nb, [lo + i * ((hi - lo) / nb) for i in range(0, nb)] as edges from (
  select lo, hi, cast(greatest(ceil((hi - lo) / least(2 * iqr / pow(n, 1.0 / 3.0), (hi - lo) / (log2(n) + 1))), 1) as int) as nb from (
    select min({col})::double as lo, max({col})::double as hi, count(*)::double as n,
           quantile_cont({col}, 0.75) - quantile_cont({col}, 0.25) as iqr from flows where half = 1)))"""


CONT = ["byt", "td"]
for _compat in (False, True):
    # synthetic values are moved, so that some fall outside the real range
    _sql = (f"with {X.FLOWS_SQL.replace('flows as', 'all_flows as')}, flows as (select * replace (case when half = 0 then byt * 1.25 - 2000 else byt end as byt, "
            + "case when half = 0 then td + 5 else td end as td) from all_flows), "
            + ", ".join(_bins_sql(c) for c in CONT) + ", long as ("
            + " union all ".join(f"select '{c}' as metric, {_hist_sql(c, _compat)} as value, half from flows, b_{c}" for c in CONT)
            + "), c as (select metric, value, count(*) filter (where half = 1) as n_real, count(*) filter (where half = 0) as n_syn "
            + f"from long where value is not null group by all), {js_sql()} select metric, value from js")

    def _m3(spark, sf, compat=_compat):
        real, syn = _halves(spark, sf)
        return _round(M.js_continuous(real, syn.withColumns({"byt": F.col("byt") * 1.25 - 2000, "td": F.col("td") + 5}), CONT, compat), "value")

    query("m3_js_continuous_compat" if _compat else "m3_js_continuous", _sql)(_m3)


@query("m4_js_distance_base2", f"{FL}, {counts_sql(DISC)}, {js_sql(expr=f'sqrt({JS} / ln(2))')} select metric, value from js")
def m4(spark, sf):
    return _round(M.js_distance_base2(*_halves(spark, sf), list(DISC)), "value")


NUM = {"td": "td", "pkt": "pkt", "byt": "byt"}


@query("m5_earth_mover", f"{FL}, {counts_sql(NUM)}, {emd_sql()} select metric, value from emd")
def m5(spark, sf):
    return _round(M.earth_mover(*_halves(spark, sf), list(NUM)), "value")


RANK_SQL = """rk as (
  select metric, rank as value, coalesce(sum(n) filter (where half = 1), 0) as n_real, coalesce(sum(n) filter (where half = 0), 0) as n_syn from (
    select metric, half, n, row_number() over (partition by metric, half order by n desc, value) as rank from (
      select metric, half, value, count(*) as n from rlong group by all)) group by metric, rank)"""
RLONG = "rlong as (select 'srcip' as metric, srcip as value, half from flows union all select 'dstip', dstip, half from flows)"


@query("m6_rank_js", f"{FL}, {RLONG}, {RANK_SQL}, {js_sql('rk')} select metric, value from js")
def m6(spark, sf):
    return _round(M.rank_distance(*_halves(spark, sf), ["srcip", "dstip"]), "value")


@query("m6_rank_emd", f"{FL}, {RLONG}, {RANK_SQL}, {emd_sql('rk')} select metric, value from emd")
def m6_emd(spark, sf):
    return _round(M.rank_distance(*_halves(spark, sf), ["srcip", "dstip"], "EMD"), "value")


DOMAIN = {"srcport": "least(greatest(srcport, 0), 65535)", "dstport": "least(greatest(dstport, 0), 65535)",
          "proto": "case proto when 'TCP' then 6 when 'UDP' then 17 else 1 end"}


@query("m7_domain_tv", f"{FL}, {counts_sql(DOMAIN)}, {SHARES.format(c='c')} select metric, round(sum(abs(p - q)) / 2, 6) as value from s group by metric")
def m7(spark, sf):
    return _round(M.domain_distance(*_halves(spark, sf), ["srcport", "dstport"], ["proto"]), "value")


@query("m7_domain_js", f"{FL}, {counts_sql(DOMAIN)}, {js_sql()} select metric, value from js")
def m7_js(spark, sf):
    return _round(M.domain_distance(*_halves(spark, sf), ["srcport", "dstport"], ["proto"], "JSD"), "value")


@query("m7_domain_freq", f"{FL}, {counts_sql(DOMAIN)}, {SHARES.format(c='c')} select metric, value, round(p, 6) as real, round(q, 6) as synthetic from s")
def m7_freq(spark, sf):
    return _round(M.domain_distance(*_halves(spark, sf), ["srcport", "dstport"], ["proto"], "freq"), "real", "synthetic")


def suite_sql(numeric, sessions=False):
    """All parts of a suite over ``flows``; numeric maps metric names to expressions."""
    extra = ""
    if sessions:
        extra = (" union all select 'flow_size', count(*)::double, half from flows group by half, srcip, dstip, srcport, dstport, proto")
    return f"""{RLONG}, {RANK_SQL}, {js_sql('rk', s='rs', out='rjs')},
{counts_sql(DOMAIN).replace('long as', 'dlong as').replace('from long', 'from dlong').replace('c as (', 'dc as (')},
{js_sql('dc')},
{counts_sql(numeric, extra).replace('long as', 'nlong as').replace('from long', 'from nlong').replace('c as (', 'nc as (')},
{emd_sql('nc')}
select metric, 'rank_jsd' as kind, value from rjs union all select metric, 'jsd', value from js union all select metric, 'emd', value from emd"""


REL = "{c} - min({c}) over (partition by half)"


@query("m8_flow_suite", f"{FL}, {suite_sql({'ts': REL.format(c='ts'), **NUM})}")
def m8(spark, sf):
    return _round(M.flow_suite(*_halves(spark, sf)), "value")


LOG_COLS = {"duration": "td", "orig_bytes": "byt", "resp_bytes": "byt / 2", "missed_bytes": "td * pkt", "orig_pkts": "pkt",
            "orig_ip_bytes": "byt + td", "resp_pkts": "pkt * 2", "resp_ip_bytes": "byt - td"}


@query("m9_connection_log_suite", f"{FL}, {suite_sql({'ts': REL.format(c='ts'), **LOG_COLS})}")
def m9(spark, sf):
    real, syn = _halves(spark, sf)
    add = lambda d: d.select("*", *[F.expr(e).alias(c) for c, e in LOG_COLS.items()])
    return _round(M.connection_log_suite(add(real), add(syn)), "value")


@query("m10_packet_suite", f"{FL.replace('half', 'half')}, {suite_sql({'time': REL.format(c='ts'), 'pkt_len': 'td + 40'}, True)}")
def m10(spark, sf):
    parts = [d.select("srcip", "dstip", "srcport", "dstport", "proto", F.col("ts").alias("time"), (F.col("td") + 40).alias("pkt_len"))
             for d in _halves(spark, sf)]
    return _round(M.packet_suite(*parts), "value")


ASSOC_NUM, ASSOC_NOM = ["td", "byt", "pkt"], ["proto", "type"]


def _assoc_sql(where, name):
    parts = [f"select '{c}' as a, '{c}' as b, 1e0 as value" for c in ASSOC_NUM + ASSOC_NOM]
    f = f"(select * from flows where {where})"
    pairs = []
    for i, a in enumerate(ASSOC_NUM):
        pairs += [(a, b, f"select corr({a}, {b}) from {f}") for b in ASSOC_NUM[i + 1:]]
    n = f"(select {ASSOC_NOM[0]} as x, {ASSOC_NOM[1]} as y, count(*) as n from {f} group by all)"
    phi = (f"select sqrt((sum(n * n / (nx * ny)) - 1) / (least(count(distinct x), count(distinct y)) - 1)) from "
           f"(select *, sum(n) over (partition by x) as nx, sum(n) over (partition by y) as ny from {n})")
    pairs.append((ASSOC_NOM[0], ASSOC_NOM[1], phi))
    for a in ASSOC_NOM:
        for b in ASSOC_NUM:
            pairs.append((a, b, f"select sqrt(sum(n * pow(m - (select avg({b}) from {f}), 2)) / (select count(*) * var_pop({b}) from {f})) "
                                f"from (select {a}, count(*) as n, avg({b}) as m from {f} group by {a})"))
    for a, b, sql in pairs:
        parts += [f"select '{a}', '{b}', ({sql})", f"select '{b}', '{a}', ({sql})"]
    return f"{name} as ({' union all '.join(parts)})"


@query("m11_associations", f"{FL}, {_assoc_sql('half = 1', 'ar')} select a, b, round(value, 6) as value from ar")
def m11(spark, sf):
    return _round(M.associations(_halves(spark, sf)[0], ASSOC_NUM, ASSOC_NOM), "value")


ASSOC_DIST = (f"{_assoc_sql('half = 1', 'ar')}, {_assoc_sql('half = 0', 'asy')}, "
              "ad as (select sqrt(sum(pow(ar.value - asy.value, 2))) as value from ar join asy using (a, b))")


@query("m11_association_distance", f"{FL}, {ASSOC_DIST} select round(value, 6) as value from ad")
def m11_distance(spark, sf):
    return _round(M.association_distance(*_halves(spark, sf), ASSOC_NUM, ASSOC_NOM), "value")


SCALED = {c: f"({c} - (select min({c}) from flows where half = 1)) / (select max({c}) - min({c}) from flows where half = 1)" for c in ASSOC_NUM}


@query("m12_column_summary", f"""{FL}, {counts_sql(SCALED)}, {emd_sql().replace(', 6) as value from emd_r', ', 15) as value from emd_r')},
{counts_sql({c: c for c in ASSOC_NOM}).replace('long as', 'dlong as').replace('from long', 'from dlong').replace('c as (', 'dc as (')},
{js_sql('dc', f'sqrt({JS} / ln(2))').replace(', 6) as value', ', 15) as value')}, {ASSOC_DIST}
select 'mean_emd' as metric, round(avg(value), 6) as value from emd union all select 'mean_js', round(avg(value), 6) from js
union all select 'association', round(value, 6) from ad""")
def m12(spark, sf):
    return _round(M.column_summary(*_halves(spark, sf), ASSOC_NUM, ASSOC_NOM), "value")


ROLES = RoleSpec(metadata=("srcip", "proto"), timeseries=("type", "byt", "td"), timestamp="ts", discrete=("srcip", "proto", "type"))


@query("m13_fidelity_report", f"""{FL},
{counts_sql({"srcip": "srcip::varchar", "proto": "proto", "type": "type"}).replace('long as', 'dlong as').replace('from long', 'from dlong').replace('c as (', 'dc as (')},
{js_sql('dc')},
{counts_sql({"byt": "byt", "td": "td", "ts": "ts"}, " union all select 'session_length', count(*)::double, half from flows group by half, srcip, proto")},
{emd_sql()}
select case when metric in ('srcip', 'proto') then 'attribute' else 'feature' end as metric_type, metric as field, value from js
union all select case metric when 'ts' then 'timestamp' when 'session_length' then 'session length' else 'feature' end, metric, value from emd""")
def m13(spark, sf):
    return _round(M.fidelity_report(*_halves(spark, sf), ROLES, with_sessions=True), "value")


CAND_SQL = """cand as (select 'k' || (l_suppkey % 4) as candidate, cast(l_linenumber % 3 as int) as chunk, l_quantity as td, l_extendedprice as byt,
  l_discount as disc, l_returnflag as flag from lineitem),
agg as (select chunk, candidate, round(avg(td), 6) as td, round(avg(byt), 6) as byt, round(avg(disc), 6) as disc,
  round(avg(case when flag = 'A' then 1e0 else 0e0 end), 6) as flag from cand group by chunk, candidate),
scores as (""" + " union all ".join(f"select chunk, candidate, '{m}' as metric, {m} as value from agg" for m in ("td", "byt", "disc", "flag")) + ")"


def _scores(spark, sf):
    li = table(spark, sf, "lineitem")
    cand = li.select(F.concat(F.lit("k"), (F.col("l_suppkey") % 4).cast("string")).alias("candidate"),
                     (F.col("l_linenumber") % 3).alias("chunk"), "l_quantity", "l_extendedprice", "l_discount",
                     F.when(F.col("l_returnflag") == "A", 1.0).otherwise(0.0).alias("flag"))
    agg = cand.groupBy("chunk", "candidate").agg(*[tidy(F.avg(c)).alias(n) for c, n in (
        ("l_quantity", "td"), ("l_extendedprice", "byt"), ("l_discount", "disc"), ("flag", "flag"))])
    return cand, M.stack(agg, {m: m for m in ("td", "byt", "disc", "flag")}, "double", ["chunk", "candidate"])


BEST = """ranked as (select {k}candidate, metric, rank() over (partition by {k}metric order by value) +
  (count(*) over (partition by {k}metric, value) - 1) / 2.0 as r from {s}),
sums as (select {k}candidate, sum(r)::double as rank_sum from ranked group by all),
best as (select * from sums qualify row_number() over ({p}order by rank_sum, candidate) = 1)"""


@query("m14_choose_best", f"with {CAND_SQL}, m as (select candidate, metric, avg(value) as value from scores group by all), "
       + BEST.format(k="", s="m", p="") + " select candidate, rank_sum from best")
def m14(spark, sf):
    _, scores = _scores(spark, sf)
    return M.choose_best(scores.groupBy("candidate", "metric").agg(F.avg("value").alias("value")))


@query("m15_best_per_chunk", f"with {CAND_SQL}, " + BEST.format(k="chunk, ", s="scores", p="partition by chunk ")
       + " select chunk, candidate, count(*) as rows, round(sum(byt), 2) as byt from cand join best using (chunk, candidate) group by all")
def m15(spark, sf):
    cand, scores = _scores(spark, sf)
    best = M.choose_best(scores, ["chunk"])
    rows = M.collect_best(cand, best, ["chunk"])
    return rows.groupBy("chunk", "candidate").agg(F.count(F.lit(1)).alias("rows"), tidy(F.sum("l_extendedprice"), 2).alias("byt"))


# ---- privacy ----------------------------------------------------------------------------

EMB = """e as (select vec_id as id, embedding::double[64] as v, label, vec_id % 2 as half from embeddings),
rl as (select * from e where half = 1), sy as (select * from e where half = 0)"""
L1 = "list_sum([abs(a.v[i] - b.v[i]) for i in range(1, 65)])"
L2 = "array_distance(a.v, b.v)"


def _emb(spark, sf):
    e = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")
    return e.where("id % 2 = 1"), e.where("id % 2 = 0")


@query("j6_nearest_rows", f"""with {EMB} select id, rank, ref_id, round(d, 6) as distance from (
  select a.id, b.id as ref_id, {L2} as d, row_number() over (partition by a.id order by {L2}, b.id) as rank from sy a, rl b) where rank <= 3""")
def j6(spark, sf):
    real, syn = _emb(spark, sf)
    return _round(nearest(syn, real, k=3), "distance")


@query("j6_nearest_duplicates", """with s as (select p_partkey as id, p_size // 5 as x, p_partkey % 4 as y from part)
select id, rank, ref_id, round(d, 6) as distance from (select a.id, b.id as ref_id, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) as d,
  row_number() over (partition by a.id order by pow(a.x - b.x, 2) + pow(a.y - b.y, 2), b.id) as rank from s a join s b on a.id <> b.id) where rank <= 3""")
def j6_duplicates(spark, sf):
    """Two coarse columns of part: nearly every vector is there many times, and every neighbourhood has ties."""
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array(
        F.floor(F.col("p_size") / 5).cast("double"), (F.col("p_partkey") % 4).cast("double")).alias("vec"))
    return _round(nearest(rows, rows, k=3, exclude_self=True), "distance")


def _chebyshev(a, b):
    """Largest difference in any dimension, of all rows of one matrix to all rows of another."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        np.maximum(out, np.abs(a[:, j, None] - b[None, :, j]), out=out)
    return out


CHEB = "list_max([abs(a.v[i] - b.v[i]) for i in range(1, 65)])"


@query("x2_custom_metric", f"""with {EMB}, twice as (select id, v, half from e union all select id + 1000000, v, half from e where id % 5 = 0),
d as (select a.id, b.id as ref_id, {CHEB} as d from twice a, twice b where a.half = 0 and b.half = 1)
select id, rank, ref_id, round(d, 6) as distance from (select *, row_number() over (partition by id order by d, ref_id) as rank from d) where rank <= 3""")
def x2(spark, sf):
    """Every fifth vector is there twice, so nearest rows are tied; the distance is declared a metric and pruned by pivots."""
    sides = [d.select("id", "vec").unionByName(d.where("id % 5 = 0").select((F.col("id") + 1_000_000).alias("id"), "vec")) for d in _emb(spark, sf)]
    return _round(nearest(sides[1], sides[0], k=3, metric=Metric(_chebyshev)), "distance")


V1_SQL = f"select a.id, round(min({L1}), 6) as distance from sy a, rl b group by a.id"


@query("v1_distance_to_closest", f"with {EMB} {V1_SQL}")
def v1(spark, sf):
    real, syn = _emb(spark, sf)
    return _round(V.distance_to_closest(real, syn), "distance")


P_SQL = """p as (select p_partkey as id, cast(p_partkey % 2 as int) as half, p_size::double as size, p_retailprice as price, p_type as kind from part),
r as (select min(size) filter (where half = 1) as s0, max(size) filter (where half = 1) as s1,
  min(price) filter (where half = 1) as p0, max(price) filter (where half = 1) as p1 from p),
n as (select id, half, (size - s0) / (s1 - s0) as s, (price - p0) / (p1 - p0) as q, kind from p, r)"""
P_DIST = "sqrt(pow(a.s - b.s, 2) + pow(a.q - b.q, 2) + cast(a.kind <> b.kind as int))"


def _parts(spark, sf):
    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias("key"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"),
        F.col("p_type").alias("kind"))
    real, syn = V.scaled_vectors(p.where("key % 2 = 1"), [p.where("key % 2 = 0")], ["size", "price"], ["kind"], "key")
    return real, syn


@query("v2_closest_two", f"""with {P_SQL} select id, round(min(d) filter (where k = 1), 6) as d1, round(min(d) filter (where k = 2), 6) as d2 from (
  select a.id, {P_DIST} as d, row_number() over (partition by a.id order by {P_DIST}) as k from n a, n b where a.half = 0 and b.half = 1)
where k <= 2 group by id""")
def v2(spark, sf):
    return _round(V.closest_two(*_parts(spark, sf)), "d1", "d2")


@query("v2_median_closest", f"""with {P_SQL} select round(quantile_cont(d, 0.5), 6) as median from (
  select a.id, min({P_DIST}) as d from n a, n b where a.half = 0 and b.half = 1 group by a.id)""")
def v2_median(spark, sf):
    real, syn = _parts(spark, sf)
    return _round(V.median_closest(V.distance_to_closest(real, syn, "l2")), "median")


@query("v2_sketched_median", f"""with {P_SQL}, d as (select a.id, min({P_DIST}) as d from n a, n b where a.half = 0 and b.half = 1 group by a.id)
select count(*) as rows, true as close from d""")
def v2_sketched(spark, sf):
    """The rank of the sketched median among all distances is at most half a percent off the middle."""
    real, syn = _parts(spark, sf)
    distances = cut(V.distance_to_closest(real, syn, "l2"), "distances")
    median = V.median_closest(distances, approx=True).first()[0]
    below, upto = (F.sum((c(F.col("distance"), F.lit(median))).cast("long")) for c in (lambda a, b: a < b, lambda a, b: a <= b))
    n = F.count(F.lit(1))
    return distances.agg(n.alias("rows"), ((below <= n * 0.505) & (upto >= n * 0.495)).alias("close"))


SIX = """src as (select p_partkey as id, cast(p_partkey % 2 as int) as half, p_size::double as x, p_retailprice as y from part),
u as (select half, x, y, min(id) as id from src group by half, x, y having count(*) = 1),
z as (select s.id, s.half, (x - mx) / sx as x, (y - my) / sy as y from u s join
  (select half, avg(x) as mx, avg(y) as my, stddev_pop(x) as sx, stddev_pop(y) as sy from u group by half) m on s.half = m.half),
d as (select case when a.half = 1 and b.half = 0 then 'rf' when a.half = 1 then 'rr' else 'ff' end as kind, a.id,
  sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) as d from z a, z b where a.id <> b.id and not (a.half = 0 and b.half = 1)),
t as (select kind, id, d as d1, lead(d) over (partition by kind, id order by d) as d2, row_number() over (partition by kind, id order by d) as k from d),
l as (select 'dcr_' || kind as metric, d1 as value from t where k = 1 union all select 'nndr_' || kind, d1 / d2 from t where k = 1)
select metric, round(quantile_cont(value, 0.05), 6) as value from l group by metric"""


@query("v3_six_numbers", "with " + SIX)
def v3(spark, sf):
    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias("key"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return _round(V.six_numbers(p.where("key % 2 = 1"), p.where("key % 2 = 0"), ["x", "y"], "key"), "value")



# vectors with many exact copies: two coarse columns of part
SENS = f"""src as (select p_partkey as id, p_size::double as x, cast(p_partkey % 20 as double) as y, {X.fraction_sql('role', 'p_partkey')} as u from part),
o as (select * from src where u >= 0.4), sy as (select * from src where u < 0.2), te as (select * from src where u >= 0.2 and u < 0.4),
ot as (select a.id, min(abs(a.x - b.x) + abs(a.y - b.y)) as d from o a, te b group by a.id),
os as (select a.id, min(abs(a.x - b.x) + abs(a.y - b.y)) as d from o a, sy b group by a.id),
kept as (select ot.d as t, os.d as s from ot join os using (id) where ot.d <> 0 or os.d <> 0),
mins as (select 'test' as kind, t as d from kept union all select 'synthetic', s from kept
  union all select 'test', min(abs(a.x - b.x) + abs(a.y - b.y)) from te a, o b group by a.id
  union all select 'synthetic', min(abs(a.x - b.x) + abs(a.y - b.y)) from sy a, o b group by a.id)"""


def _sens(spark, sf):
    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.array(F.col("p_size").cast("double"), (F.col("p_partkey") % 20).cast("double")).alias("vec"),
        fraction("role", "p_partkey").alias("u"))
    return V.minima(p.where("u >= 0.4"), p.where("u < 0.2"), p.where("u >= 0.2 and u < 0.4"))


GRID = "[" + ", ".join(f"{0.3 * i / 99!r}::double" for i in range(100)) + "]"


@query("v4_sensitivity", f"""with {SENS},
grid as (select unnest({GRID}) as q, unnest(lims) as lim from (select quantile_cont(d, {GRID}) as lims from mins where kind = 'test'))
select round(avg(share - q), 6) as statistic from (
  select q, (select count(*) filter (where d <= lim) / count(*) from mins where kind = 'synthetic') as share from grid)""")
def v4(spark, sf):
    return _round(V.sensitivity(_sens(spark, sf), qt_max=0.3, qt_interval=100), "statistic")


# 64 dimensions on 8 given directions
REDUCED = "[list_sum([v[i] * (((i * (j + 2)) % 7 - 3) / 8e0) for i in range(1, 65)]) for j in range(1, 9)]"
LR = "list_sum([abs(a.v[i] - b.v[i]) for i in range(1, 9)])"
SENS_R = f"""src as (select vec_id as id, embedding::double[64] as v, {X.fraction_sql('role', 'vec_id')} as u from embeddings),
red as (select id, u, {REDUCED} as v from src),
o as (select * from red where u >= 0.4), sy as (select * from red where u < 0.2), te as (select * from red where u >= 0.2 and u < 0.4),
ot as (select a.id, min({LR}) as d from o a, te b group by a.id), os as (select a.id, min({LR}) as d from o a, sy b group by a.id),
kept as (select ot.d as t, os.d as s from ot join os using (id) where ot.d <> 0 or os.d <> 0),
mins as (select 'test' as kind, t as d from kept union all select 'synthetic', s from kept
  union all select 'test', min({LR}) from te a, o b group by a.id union all select 'synthetic', min({LR}) from sy a, o b group by a.id)"""


@query("v4_reduced", f"""with {SENS_R},
grid as (select unnest({GRID}) as q, unnest(lims) as lim from (select quantile_cont(d, {GRID}) as lims from mins where kind = 'test'))
select round(avg(share - q), 6) as statistic from (
  select q, (select count(*) filter (where d <= lim + 1e-9) / count(*) from mins where kind = 'synthetic') as share from grid)""")
def v4_reduced(spark, sf):
    """Wide vectors are projected before distances are taken; here on given directions, so that SQL can do the same."""
    i, j = np.arange(1, 65)[:, None], np.arange(1, 9)[None, :]
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), fraction("role", "vec_id").alias("u"))
    mins = V.minima(e.where("u >= 0.4"), e.where("u < 0.2"), e.where("u >= 0.2 and u < 0.4"), directions=((i * (j + 2)) % 7 - 3) / 8.0)
    return _round(V.sensitivity(mins, qt_max=0.3, qt_interval=100), "statistic")


@query("v4_fitted_reduction", """select count(*) filter (where half = 1) as originals, 8 as dimensions, true as within from (select vec_id % 2 as half from embeddings)""")
def v4_fitted(spark, sf):
    """Originals keep at least 98 % of the squared length that the best 8 directions keep, though no direction stands out here."""
    real, syn = _emb(spark, sf)
    reduced = W.reduce_widths(real.select("id", "vec"), [syn.select("id", "vec")])[0]
    length = lambda c: F.sum(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
    got = reduced.agg(F.count(F.lit(1)).alias("originals"), F.max(F.size("vec")).alias("dimensions"), length("vec").alias("kept")).first()
    best = np.linalg.eigvalsh(W._gram_times(real.select(F.col("vec").alias("v")), np.eye(64)))[-8:].sum()
    return spark.createDataFrame([(got["originals"], got["dimensions"], bool(got["kept"] >= 0.98 * best))], "originals long, dimensions int, within boolean")


@query("v5_tail_ks", f"""with {SENS},
lim as (select kind, quantile_cont(d, 0.4) as l from mins group by kind),
tail as (select mins.kind, d from mins join lim on mins.kind = lim.kind and d <= l),
c as (select d, count(*) filter (where kind = 'test') as a, count(*) filter (where kind = 'synthetic') as b from tail group by d)
select round(max(abs(ca / ta - cb / tb)), 6) as statistic from (
  select sum(a) over (order by d) as ca, sum(b) over (order by d) as cb, sum(a) over () as ta, sum(b) over () as tb from c)""")
def v5(spark, sf):
    return _round(V.tail_ks(_sens(spark, sf), 0.4), "statistic")


@query("v6_single_quantile", f"""with {SENS} select round(avg(case when d <= (select quantile_cont(d, 0.3) from mins where kind = 'test') then 1e0 else 0e0 end), 6)
as statistic from mins where kind = 'synthetic'""")
def v6(spark, sf):
    return _round(V.sensitivity(_sens(spark, sf), qt_max=0.3, qt_interval=1), "statistic")




BOOT_GRID = "[" + ", ".join(f"{0.3 * i / 49!r}::double" for i in range(50)) + "]"
BOOT = f"""src as (select vec_id as id, embedding::double[64] as v from embeddings), held as (select cast(ceil(count(*) * 0.33) as int) as h from src),
rr as (select *, case when p < h // 2 then 'synthetic' when p < h then 'test' else 'original' end as role from (
  select id, v, cast(r.i as int) as round, row_number() over (partition by r.i order by {X.digest_sql(7, 'r.i', 'id')}, id) - 1 as p from src, range(4) r(i)), held),
pairs as (select a.round, a.id as o, b.id as x, b.role as kind, {L1} as d from rr a join rr b on a.round = b.round where a.role = 'original' and b.role <> 'original'),
t as (select round, o, min(d) filter (where kind = 'test') as t, min(d) filter (where kind = 'synthetic') as s from pairs group by all),
mins as (select round, 'test' as kind, t as d from t where t <> 0 or s <> 0 union all select round, 'synthetic', s from t where t <> 0 or s <> 0
  union all select round, kind, min(d) from pairs group by round, kind, x),
lims as (select round, unnest({BOOT_GRID}) as q, unnest(lims) as lim from (select round, quantile_cont(d, {BOOT_GRID}) as lims from mins where kind = 'test' group by round)),
shares as (select l.round, q, avg(case when m.d <= lim then 1e0 else 0e0 end) as share from lims l join mins m on l.round = m.round and m.kind = 'synthetic' group by all),
stats as (select round, avg(share - q) as statistic from shares group by round)"""


@query("v7_bootstrap_statistics", f"with {BOOT} select round, round(statistic, 6) as statistic from stats")
def v7(spark, sf):
    real, syn = _emb(spark, sf)
    both = real.unionByName(syn).select("id", "vec")
    return _round(V.bootstrap_statistics(both, 4, 0.165, 7, qt_max=0.3, qt_interval=50, max_col_nums=None), "statistic")


@query("v7_threshold", f"with {BOOT} select round(quantile_cont(statistic, 0.95), 6) as threshold from stats")
def v7_threshold(spark, sf):
    real, syn = _emb(spark, sf)
    both = real.unionByName(syn).select("id", "vec")
    return _round(V.sensitivity_threshold(V.bootstrap_statistics(both, 4, 0.165, 7, qt_max=0.3, qt_interval=50, max_col_nums=None)), "threshold")


@query("v7_settings", """select 0.165::double as frac, round(1 - count(distinct (l_suppkey, l_linenumber, l_quantity)) / count(*), 6) as duplicate_rate,
round((1 - count(distinct (l_suppkey, l_linenumber, l_quantity)) / count(*)) / 2, 6) as qt_max, 1000 as qt_interval from lineitem""")
def v7_settings(spark, sf):
    s = V.sensitivity_settings(table(spark, sf, "lineitem"), ["l_suppkey", "l_linenumber", "l_quantity"], qt_max="compute")
    return _round(spark.createDataFrame([tuple(s.values())], "frac double, duplicate_rate double, qt_max double, qt_interval int"),
                  "frac", "duplicate_rate", "qt_max")


