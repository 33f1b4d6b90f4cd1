"""Queries for cleaning, reshaping and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracekit.operators import clean, joins, polygons, reshape
from tracekit.plans import fixtures as X
from tracekit.plans.registry import query, table
from tracekit.session import tidy

SIG = X.SIGNALS
SQ = ", ".join(SIG)
WIDE = f"with {X.SIGNALS_SQL}"
RID_SQL = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as rid"


def rid():
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("rid")


def rounded(df, cols):
    return df.select(*[tidy(c).alias(c) if c in cols else F.col(c) for c in df.columns])


# ---- projection, filter, missing values -------------------------------------------------

@query("p1_select_signals", f"{WIDE} select timestamp, click, view from wide")
def p1(spark, sf):
    return clean.select_signals(X.wide_signals(spark, sf), ["click", "view"])


@query("p2_drop_all_null_columns", f"{WIDE} select timestamp, {SQ}, 'absent' as dropped from wide")
def p2(spark, sf):
    wide = X.wide_signals(spark, sf).withColumn("absent", F.lit(None).cast("double"))
    kept, gone = clean.drop_all_null_columns(wide)
    return kept.withColumn("dropped", F.lit(",".join(gone)))


FILLED = f"""{WIDE}, filled as (select timestamp, {", ".join(
    f"last_value({n} ignore nulls) over (order by timestamp rows between unbounded preceding and current row) as {n}, "
    f"cast({n} is null as int) as {n}_m" for n in SIG)} from wide)"""
ALL_SET = " and ".join(f"{n} is not null" for n in SIG)


@query("p3_impute_ffill", f"{FILLED} select timestamp, {SQ} from filled where {ALL_SET}")
def p3(spark, sf):
    filled, _ = clean.impute_ffill(X.wide_signals(spark, sf), ["timestamp"], SIG)
    return filled.drop("was_missing")


@query("p3_removed_rows", f"{FILLED} select sum(case when {ALL_SET} then 0 else 1 end)::bigint as removed, count(*) as total from filled")
def p3_removed(spark, sf):
    return clean.impute_ffill(X.wide_signals(spark, sf), ["timestamp"], SIG)[1]


@query("p3_impute_ffill_per_trace", """with t as (select event_id, user_id, ts,
  case when event_type = 'click' then value end as click, case when event_type = 'view' then value end as view from events),
f as (select event_id, user_id,
  last_value(click ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as click,
  last_value(view ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as view from t)
select * from f where click is not null and view is not null""")
def p3_trace(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", "user_id", "ts", *[F.when(F.col("event_type") == n, F.col("value")).alias(n) for n in ("click", "view")])
    filled, _ = clean.impute_ffill(e, ["ts", "event_id"], ["click", "view"], by=["user_id"])
    return filled.select("event_id", "user_id", "click", "view")


@query("p4_missing_table", f"{FILLED} select timestamp, {', '.join(f'{n}_m as {n}' for n in SIG)} from filled where {ALL_SET}")
def p4(spark, sf):
    filled, _ = clean.impute_ffill(X.wide_signals(spark, sf), ["timestamp"], SIG)
    return clean.missing_table(filled, SIG, ["timestamp"])


FLAGGED = ", ".join(f"coalesce({n}, 0) as {n}, cast({n} is null as int) as \"{n}_Missing\"" for n in SIG)


@query("p5_missing_flags", f"{WIDE} select timestamp, {FLAGGED} from wide")
def p5(spark, sf):
    return clean.add_missing_flags(X.wide_signals(spark, sf), SIG)


@query("p6_restore_missing", f"{WIDE} select timestamp, {SQ} from wide")
def p6(spark, sf):
    return clean.restore_missing(clean.add_missing_flags(X.wide_signals(spark, sf), SIG), SIG)


@query("p7_fill_zero", f"{WIDE} select timestamp, {', '.join(f'coalesce({n}, 0) as {n}' for n in SIG)} from wide")
def p7(spark, sf):
    return clean.fill_zero(X.wide_signals(spark, sf))


@query("p8_drop_incomplete", f"{WIDE} select timestamp, {SQ} from wide where {ALL_SET}")
def p8(spark, sf):
    return clean.drop_incomplete(X.wide_signals(spark, sf))


def _with_constants(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", "o_totalprice", F.lit("R").alias("flag"), F.lit(3).alias("version"),
        F.when(F.col("o_orderstatus") == "F", 1).alias("half_null"))


@query("p9_remove_constants", """select o_orderkey, o_totalprice, case when o_orderstatus = 'F' then 1 end as half_null,
'R' as flag, 3 as version, 'flag,version' as removed from orders""")
def p9(spark, sf):
    kept, constant = clean.remove_constant_columns(_with_constants(spark, sf))
    return clean.restore_constant_columns(kept, constant).withColumn("removed", F.lit(",".join(sorted(constant))))


@query("p10_profile", "select * from (" + " union all ".join(
    f"select '{c}' as \"column\", round(count({c}) / count(*), 6) as density, "
    f"cast(count(distinct {c}) + max(cast({c} is null as int)) = 1 as int) as is_constant from "
    "(select o_orderkey, o_totalprice, 'R' as flag, 3 as version, case when o_orderstatus = 'F' then 1 end as half_null from orders)"
    for c in ("o_orderkey", "o_totalprice", "flag", "version", "half_null")) + ")")
def p10(spark, sf):
    return rounded(clean.profile_columns(_with_constants(spark, sf)), ["density"])


@query("p11_label_counts", "select o_orderpriority, count(*) as rows from orders group by 1")
def p11(spark, sf):
    return clean.label_counts(table(spark, sf, "orders"), "o_orderpriority")


@query("p12_missing_counts", f"{WIDE} " + " union all ".join(
    f"select '{n}' as \"column\", sum(cast({n} is null as bigint))::bigint as missing from wide" for n in ["timestamp", *SIG])
    + " union all select '*', sum(" + " + ".join(f"cast({n} is null as bigint)" for n in SIG) + ")::bigint from wide")
def p12(spark, sf):
    return clean.missing_counts(X.wide_signals(spark, sf))


LI_NUM = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("p13_discrete_numeric", "select * from (" + " union all ".join(
    f"select '{c}' as \"column\", count(distinct {c}) as n_distinct, min(cast({c} = round({c}) as int)) as whole, "
    f"cast(count(distinct {c}) <= 32 and min(cast({c} = round({c}) as int)) = 1 as int) as is_discrete from lineitem"
    for c in LI_NUM) + ")")
def p13(spark, sf):
    li = table(spark, sf, "lineitem").select(*LI_NUM)
    report = clean.discrete_numeric_report(li)
    return report.withColumn("is_discrete", ((F.col("n_distinct") <= 32) & (F.col("whole") == 1)).cast("int"))


@query("p13_discrete_columns", "select c as \"column\" from (" + " union all ".join(
    f"select '{c}' as c from lineitem having count(distinct {c}) <= 32 and min(cast({c} = round({c}) as int)) = 1" for c in ["l_orderkey", *LI_NUM]) + ")")
def p13_columns(spark, sf):
    """Chosen by sketches first; only columns with few values are counted."""
    li = table(spark, sf, "lineitem").select("l_orderkey", *LI_NUM)
    return spark.createDataFrame([(c,) for c in clean.discrete_numeric_columns(li)], "column string")


@query("p14_round_to_observed", f"""with v as (select distinct l_linenumber as v from lineitem)
select {RID_SQL}, l_discount, cast((select arg_min(v, struct_pack(d := abs(l_quantity / 6.0 - v), v := v)) from v) as double) as line
from lineitem""")
def p14(spark, sf):
    li = table(spark, sf, "lineitem")
    observed = clean.observed_values(li, ["l_linenumber"])
    noisy = li.select(rid(), "l_discount", (F.col("l_quantity") / 6.0).alias("line"))
    return clean.round_to_observed(noisy, {"line": observed["l_linenumber"]})


def _blanked(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_custkey") % 5 == 0, " ").otherwise(F.col("c_mktsegment")).alias("segment"),
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("balance"))


@query("p15_sentinel_missing", """select c_custkey, case when c_custkey % 5 = 0 then 'empty' else c_mktsegment end as segment,
case when c_custkey % 7 = 0 then -9999999 else c_acctbal end as balance from customer""")
def p15(spark, sf):
    return clean.sentinel_missing(_blanked(spark, sf), ["segment"])


@query("p16_unsentinel", """select c_custkey, case when c_custkey % 5 <> 0 then c_mktsegment end as segment,
case when c_custkey % 7 <> 0 then c_acctbal end as balance from customer""")
def p16(spark, sf):
    return clean.unsentinel(clean.sentinel_missing(_blanked(spark, sf), ["segment"]))


@query("p17_in_range", "select c_custkey, cast(c_acctbal between 0 and 5000 as int) as ok from customer")
def p17(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", clean.in_range("c_acctbal", 0, 5000).cast("int").alias("ok"))


# a square of side 30 with a square hole, and a triangle
RINGS = [[(5, 0.01), (35, 0.01), (35, 0.06), (5, 0.06)], [(15.5, 0.025), (25.5, 0.025), (25.5, 0.045), (15.5, 0.045)],
         [(40.2, -0.001), (49.7, -0.001), (45.1, 0.095)]]


def _polygon_sql(x, y):
    edges = [(a, b) for ring in RINGS for a, b in zip(ring, ring[1:] + ring[:1])]
    hits = " + ".join(
        f"cast((({a[1]}::double > {y}) <> ({b[1]}::double > {y})) and {x} < ({b[0]}::double - {a[0]}::double) * ({y} - {a[1]}::double) "
        f"/ ({b[1]}::double - {a[1]}::double) + {a[0]}::double as int)" for a, b in edges if a[1] != b[1])
    on = " or ".join(
        f"(({b[0]}::double - {a[0]}::double) * ({y} - {a[1]}::double) - ({b[1]}::double - {a[1]}::double) * ({x} - {a[0]}::double) = 0 "
        f"and {x} between {min(a[0], b[0])} and {max(a[0], b[0])} and {y} between {min(a[1], b[1])} and {max(a[1], b[1])})"
        for a, b in edges)
    return f"(({hits}) % 2 = 1 and not ({on}))"


@query("p18_in_polygon", f"select {RID_SQL}, cast({_polygon_sql('l_quantity', 'l_discount')} as int) as inside from lineitem")
def p18(spark, sf):
    return table(spark, sf, "lineitem").select(
        rid(), clean.in_polygon("l_quantity", "l_discount", RINGS).cast("int").alias("inside"))


# one shape per supplier: a diamond whose size and place follow from the key, with a triangle cut out
SHAPES_SQL = """k as (select s_suppkey as poly, (s_suppkey * 7) % 50 as cx, (s_suppkey * 13) % 50 as cy, 3 + s_suppkey % 5 as r from supplier),
e as (select poly, cx - r as ax, cy as ay, cx as bx, cy + r as b_y from k union all select poly, cx, cy + r, cx + r, cy from k
  union all select poly, cx + r, cy, cx, cy - r from k union all select poly, cx, cy - r, cx - r, cy from k
  union all select poly, cx - 1, cy - 1, cx + 1, cy - 1 from k union all select poly, cx + 1, cy - 1, cx, cy + 1 from k union all select poly, cx, cy + 1, cx - 1, cy - 1 from k)"""


@query("p18_many_polygons", f"""with {SHAPES_SQL},
p as (select distinct l_quantity as x, round(l_discount * 500) as y from lineitem),
t as (select x, y, poly, sum(cast((ay > y) <> (b_y > y) and x < (bx - ax) * (y - ay) / (b_y - ay)::double + ax as int)) % 2 = 1 as odd,
  bool_or((bx - ax) * (y - ay) - (b_y - ay) * (x - ax) = 0 and x between least(ax, bx) and greatest(ax, bx) and y between least(ay, b_y) and greatest(ay, b_y)) as on_edge
  from p, e group by x, y, poly)
select {RID_SQL}, poly from lineitem join t on t.x = l_quantity and t.y = round(l_discount * 500) where odd and not on_edge""")
def p18_many(spark, sf):
    """All lines at (quantity, discount) in a lattice, so that many lie on edges and corners, against one shape per supplier."""
    at = lambda dx, dy: F.struct((F.col("cx") + dx).cast("double").alias("x"), (F.col("cy") + dy).cast("double").alias("y"))
    key, r, zero = F.col("s_suppkey"), F.col("r"), F.lit(0)
    shapes = table(spark, sf, "supplier").select(key.alias("poly"), (key * 7 % 50).alias("cx"), (key * 13 % 50).alias("cy"), (3 + key % 5).alias("r"))
    rings = F.array(F.array(at(-r, zero), at(zero, r), at(r, zero), at(zero, -r)), F.array(at(F.lit(-1), F.lit(-1)), at(F.lit(1), F.lit(-1)), at(zero, F.lit(1))))
    points = table(spark, sf, "lineitem").select(rid().alias("rid"), F.col("l_quantity").alias("x"), F.round(F.col("l_discount") * 500).alias("y"))
    return polygons.points_in_polygons(points, shapes.select("poly", rings.alias("rings")), "rid")


def _validator():
    return (
        clean.RowValidator()
        .add("price", lambda p: clean.in_range(p, 5000, 80000), ["l_extendedprice"])
        .add("ship", lambda q, d: q * d < 3.0, ["l_quantity", "l_discount"])
        .add("gone", lambda q: q < 0, ["l_quantity"])
        .remove("gone")
    )


RULES = {"price": "l_extendedprice between 5000 and 80000", "ship": "l_quantity * l_discount < 3.0"}


@query("p19_row_validator", f"select {RID_SQL} from lineitem where " + " and ".join(RULES.values()))
def p19(spark, sf):
    return _validator().apply(table(spark, sf, "lineitem")).select(rid())


@query("p19_reject_counts", " union all ".join(
    f"select '{n}' as rule, count(*) filter (where not ({r})) as rejected from lineitem"
    for n, r in {**RULES, "*": " and ".join(RULES.values())}.items()))
def p19_report(spark, sf):
    return _validator().report(table(spark, sf, "lineitem"))


@query("p20_validate_not_null", "select c_custkey, c_mktsegment as segment, c_acctbal as balance from customer where c_custkey % 7 <> 0 and c_custkey % 5 <> 0")
def p20(spark, sf):
    training = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    made = _blanked(spark, sf).withColumn("segment", F.when(F.trim("segment") != "", F.col("segment")))
    return clean.validate_not_null(made, clean.has_missing(training))


@query("p21_reject_out_of_bounds", """with b as (select min(l_extendedprice) lo, max(l_extendedprice) hi, min(l_quantity) ql, max(l_quantity) qh
from lineitem where l_returnflag = 'A'),
t as (select l.*, l_extendedprice between lo and hi and l_quantity between ql and qh as ok from lineitem l, b where l_returnflag <> 'A')
select count(*) filter (where ok) as kept, round(sum(case when ok then l_extendedprice end), 2) as total,
count(*) filter (where not ok) as rejected from t""")
def p21(spark, sf):
    li = table(spark, sf, "lineitem")
    limits = clean.bounds(li.where("l_returnflag = 'A'"), ["l_extendedprice", "l_quantity"])
    kept, rejected = clean.reject_out_of_bounds(li.where("l_returnflag <> 'A'"), limits)
    facts = kept.agg(F.count(F.lit(1)).alias("kept"), tidy(F.sum("l_extendedprice"), 2).alias("total"))
    return facts.withColumn("rejected", F.lit(rejected.first()[0]))


@query("p22_truncate_to_range", """with r as (select min(l_shipdate) lo, max(l_shipdate) hi from lineitem where l_shipdate < timestamp '1998-01-01'),
t as (select o.*, o_orderdate between lo and hi as ok from orders o, r)
select o_orderkey, (select round(avg(cast(ok as int)), 6) from t) as kept_ratio from t where ok""")
def p22(spark, sf):
    ref = table(spark, sf, "lineitem").where("l_shipdate < '1998-01-01'").withColumnRenamed("l_shipdate", "o_orderdate")
    kept, share = clean.truncate_to_range(table(spark, sf, "orders"), ref, "o_orderdate")
    ratio = share.select(tidy("kept_ratio")).first()[0]
    return kept.select("o_orderkey", F.lit(ratio).alias("kept_ratio"))


@query("p23_drop_all_duplicates", """select l_suppkey, l_linenumber, l_returnflag, l_quantity from lineitem
group by all having count(*) = 1""")
def p23(spark, sf):
    return clean.drop_all_duplicates(table(spark, sf, "lineitem").select("l_suppkey", "l_linenumber", "l_returnflag", "l_quantity"))


@query("p24_duplicate_rate", """select round(1 - (select count(*) from (select distinct l_suppkey, l_linenumber, l_returnflag, l_quantity from lineitem))
/ (select count(*) from lineitem), 6) as duplicate_rate""")
def p24(spark, sf):
    return rounded(clean.duplicate_rate(
        table(spark, sf, "lineitem").select("l_suppkey", "l_linenumber", "l_returnflag", "l_quantity")), ["duplicate_rate"])


@query("p25_align", "select s_suppkey as key, s_acctbal as balance from supplier union all select c_custkey, c_acctbal from customer")
def p25(spark, sf):
    ref = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    other = table(spark, sf, "customer").select(F.col("c_acctbal").alias("balance"), "c_name", F.col("c_custkey").alias("key"))
    return ref.union(clean.align(other, ref))


# ---- reshape ----------------------------------------------------------------------------

@query("t1_pivot_signals", f"{WIDE} select timestamp, {SQ} from wide")
def t1(spark, sf):
    return X.wide_signals(spark, sf)


@query("t1_pivot_selected", f"{WIDE} select timestamp, error, view from wide where error is not null or view is not null")
def t1_selected(spark, sf):
    w = reshape.pivot_signals(X.signal_log(spark, sf), ["error", "view"], "seq", keep_all_ts=False)
    return w.select("timestamp", F.col("error").cast("double").alias("error"), F.col("view").cast("double").alias("view"))


VALID = "1 + vec_id % 32"


def _series(spark, sf):
    """Embeddings as 32 steps of two series, valid for 1 to 32 steps."""
    e = table(spark, sf, "embeddings")
    wide = e.select(
        "vec_id", "label", *[F.get("embedding", i).cast("double").alias(f"a{i}") for i in range(32)],
        *[F.get("embedding", 32 + i).cast("double").alias(f"b{i}") for i in range(32)])
    return wide


GROUPS = {"a": [f"a{i}" for i in range(32)], "b": [f"b{i}" for i in range(32)]}


@query("t2_columns_to_series", """select vec_id, label, i as step, round(embedding[i + 1]::double, 6) as a,
round(embedding[i + 33]::double, 6) as b from embeddings, range(32) r(i)""")
def t2(spark, sf):
    s = reshape.columns_to_series(_series(spark, sf), GROUPS)
    rows = s.select("vec_id", "label", F.posexplode(F.arrays_zip("a", "b")).alias("step", "x"))
    return rows.select("vec_id", "label", "step", tidy("x.a").alias("a"), tidy("x.b").alias("b"))


@query("t3_series_to_columns", "select vec_id, label, " + ", ".join(
    f"case when {i} < {VALID} then round(embedding[{i + 1 + o}]::double, 6) end as {n}{i}" for n, o in (("a", 0), ("b", 32)) for i in range(32))
    + " from embeddings")
def t3(spark, sf):
    s = reshape.columns_to_series(_series(spark, sf), GROUPS)
    n = (F.col("vec_id") % 32 + 1).cast("int")
    s = s.withColumn("flag", F.concat(F.array_repeat(F.lit(1.0), n), F.array_repeat(F.lit(0.0), 32 - n)))
    return rounded(reshape.series_to_columns(s, GROUPS, "flag"), GROUPS["a"] + GROUPS["b"])


MAX_LEN = 6


def _packed(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", X.micros("ts").alias("us"), "value",
                                         (F.col("event_id") % 10).cast("double").alias("k"))
    return reshape.pack_sessions(e, ["user_id", "event_type"], ["value", "k"], ["us", "event_id"], MAX_LEN)


PACK_SQL = f"""with e as (select *, row_number() over (partition by user_id, event_type order by ts, event_id) - 1 as p from events),
keys as (select distinct user_id, event_type from events),
packed as (select k.user_id, k.event_type, r.i as pos, coalesce(value, 0e0) as value, coalesce(cast(event_id % 10 as double), 0e0) as k,
  case when event_id is null then 0e0 else 1e0 end as flag
  from keys k cross join range({MAX_LEN}) r(i) left join e on e.user_id = k.user_id and e.event_type = k.event_type and e.p = r.i)"""


def _steps(packed, *more):
    s = packed.select("user_id", "event_type", F.posexplode(F.arrays_zip(F.col("feat").alias("x"), F.col("gen_flag").alias("g"))).alias("pos", "s"))
    return s.select("user_id", "event_type", "pos", F.get("s.x", 0).alias("value"), F.get("s.x", 1).alias("k"),
                    *[F.get("s.x", i).alias(n) for i, n in more], F.col("s.g").alias("flag"))


@query("t4_pack_sessions", f"{PACK_SQL} select * from packed")
def t4(spark, sf):
    return _steps(_packed(spark, sf))


@query("t5_unpack_sessions", f"{PACK_SQL} select user_id, event_type, pos, value, k from packed where flag = 1")
def t5(spark, sf):
    return reshape.unpack_sessions(_packed(spark, sf), ["value", "k"])


@query("t6_pad_to_multiple", f"{PACK_SQL} select user_id, event_type, pos, value, k, flag from packed union all "
       "select user_id, event_type, i, 0e0, 0e0, 0e0 from keys, range(6, 8) r(i)")
def t6(spark, sf):
    return _steps(reshape.pad_to_multiple(_packed(spark, sf), 4))


NEXT = "lead(flag, 1, 0e0) over (partition by user_id, event_type order by pos)"


@query("t7_add_gen_flag", f"""{PACK_SQL},
f as (select *, {NEXT} as nxt, case when sum(flag) over (partition by user_id, event_type, pos // 3) > 0.5 then 1e0 else 0e0 end as act from packed)
select user_id, event_type, pos, value, k, flag, nxt as more, (1 - nxt) * act as done from f""")
def t7(spark, sf):
    return _steps(reshape.add_gen_flag(_packed(spark, sf), 3), (2, "more"), (3, "done"))


@query("t8_reverse_gen_flag", f"{PACK_SQL} select user_id, event_type, pos, flag as flag from packed")
def t8(spark, sf):
    shifted = reshape.add_gen_flag(_packed(spark, sf), 3).withColumn("more", F.transform("feat", lambda x: F.get(x, 2)))
    back = shifted.select("user_id", "event_type", reshape.reverse_gen_flag("more").alias("f"))
    return back.select("user_id", "event_type", F.posexplode("f").alias("pos", "flag"))


@query("t9_parent", "select distinct l_suppkey, l_returnflag, l_suppkey * 10 + ascii(l_returnflag) as session_id from lineitem")
def t9(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("session_id", F.col("l_suppkey") * 10 + F.ascii("l_returnflag"))
    return reshape.split_parent_child(li, ["l_suppkey", "l_returnflag"], "session_id")[0]


@query("t9_child", f"select {RID_SQL}, l_suppkey * 10 + ascii(l_returnflag) as session_id, l_quantity from lineitem")
def t9_child(spark, sf):
    li = table(spark, sf, "lineitem").select(
        rid(), "l_suppkey", "l_returnflag", "l_quantity", (F.col("l_suppkey") * 10 + F.ascii("l_returnflag")).alias("session_id"))
    return reshape.split_parent_child(li, ["l_suppkey", "l_returnflag"], "session_id")[1]


@query("t10_collect_children", """with o as (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as p from orders)
select c_custkey as o_custkey, coalesce(p // 5, 0) as segment, count(o_orderkey) as n,
coalesce(string_agg(o_orderkey::varchar, ',' order by p), '') as children
from customer left join o on c_custkey = o_custkey group by c_custkey, p // 5""")
def t10(spark, sf):
    parent = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"))
    out = reshape.collect_children(parent, table(spark, sf, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"],
                                   ["o_orderkey"], max_rows=5)
    return out.select("o_custkey", "segment", F.size("children").alias("n"),
                      F.array_join(F.transform("children", lambda c: c["o_orderkey"].cast("string")), ",").alias("children"))


@query("t11_assemble", "select p_partkey, p_retailprice, p_size, p_brand, p_type from part")
def t11(spark, sf):
    p = table(spark, sf, "part")
    return reshape.assemble([p.select("p_partkey", "p_retailprice", "p_size"), p.select("p_partkey", "p_brand"),
                             p.select("p_partkey", "p_type")], "p_partkey")


@query("t12_concat_chunks", "select o_orderkey, o_totalprice from orders")
def t12(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return reshape.concat_chunks([o.where(F.col("o_orderkey") % 3 == i) for i in range(3)])


@query("t13_place_target", """select p_partkey, p_size, p_size as "_TEACHER_FORCING_p_size", p_brand,
'_TEACHER_FORCING_p_size,p_partkey,p_brand,p_size' as layout from part""")
def t13(spark, sf):
    p = reshape.place_target(table(spark, sf, "part").select("p_partkey", "p_size", "p_brand"), "p_size")
    p = reshape.place_target(p, "p_size", "first")
    return p.withColumn("layout", F.lit(",".join(p.columns)))


def _noisy_flags(spark, sf):
    """Generated flags around 1: step i of a vector is on while its rounded value is not 0."""
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.transform("embedding", lambda x: F.lit(0.7) + x.cast("double")).alias("flag"))


@query("t14_trim_flags", """with f as (select vec_id, i, round(0.7e0 + embedding[i + 1]::double) as f from embeddings, range(64) r(i)),
z as (select vec_id, i, f, min(f) over (partition by vec_id order by i) as low from f)
select vec_id, i as pos, case when low = 0 then 0e0 else f end as flag,
sum(case when low = 0 then 0e0 else f end) over (partition by vec_id) as length from z""")
def t14(spark, sf):
    t = _noisy_flags(spark, sf).select("vec_id", reshape.trim_flags("flag").alias("flag"))
    t = t.withColumn("length", reshape.array_sum("flag"))
    return t.select("vec_id", "length", F.posexplode("flag").alias("pos", "flag"))


@query("t15_check_shape", f"{PACK_SQL} select 2 as min_width, 2 as max_width, min(n) as min_len, max(n) as max_len, 0 as unequal, "
       f"cast(min(n) = max(n) as int) as ok from (select count(*) as n from packed group by user_id, event_type)")
def t15(spark, sf):
    return reshape.check_sessions_shape(_packed(spark, sf), [1, 1], [2])


# ---- joins ------------------------------------------------------------------------------

@query("j1_join_parent", "select o_orderkey, o_custkey, c_mktsegment from orders join customer on o_custkey = c_custkey")
def j1(spark, sf):
    parent = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return joins.join_parent(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), parent, "o_custkey")


@query("j2_orphans", "select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_nationkey < 20)")
def j2(spark, sf):
    parent = table(spark, sf, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("o_custkey"))
    return joins.orphans(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), parent, "o_custkey")


@query("j3_lookup", """with u as (select user_id, min(event_id) as first_id, count(*) as n from events group by user_id)
select event_id, first_id, n from events e join u using (user_id)""")
def j3(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id")
    u = e.groupBy("user_id").agg(F.min("event_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    return joins.lookup(e, u, ["user_id"]).drop("user_id")


@query("j7_complement", "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_quantity > 40)")
def j7(spark, sf):
    picked = table(spark, sf, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return joins.complement(table(spark, sf, "orders").select("o_orderkey"), picked, "o_orderkey")
