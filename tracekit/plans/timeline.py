"""Queries for sessions, chunks and inter-arrival times."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracekit.operators import sessions
from tracekit.operators.processor import SessionProcessor
from tracekit.plans import fixtures as X
from tracekit.plans.registry import query, table
from tracekit.roles import RoleSpec
from tracekit.session import tidy

FL = f"with {X.FLOWS_SQL}"
KEYS = ["srcip", "proto"]
N_CHUNKS = 7


def sessions_sql(source, keys, order, n):
    k = ", ".join(keys)
    return f"""numbered as (select *, row_number() over (partition by {k} order by {order}) - 1 as rn from {source}),
bases as (select {k}, sum(ceil(c / {n}::double)) over (order by {k}) - ceil(c / {n}::double) as base
  from (select {k}, count(*) as c from {source} group by {k})),
sess as (select n.*, cast(base + floor(rn / {n}) as bigint) as session_id from numbered n join bases b using ({k}))"""


def _trace(spark, sf):
    """The columns a session needs: what goes into a sort is written, so it is pruned first."""
    return X.flows(spark, sf).select("rid", *KEYS, "ts")


def _flow_sessions(spark, sf):
    return sessions.sessionize_count(_trace(spark, sf), KEYS, ["ts", "rid"], 50)


@query("w1_sessionize_count", f"{FL}, {sessions_sql('flows', KEYS, 'ts, rid', 50)} select rid, session_id from sess")
def w1(spark, sf):
    return _flow_sessions(spark, sf).select("rid", "session_id")


@query("w1_sessionize_events", f"with {sessions_sql('events', ['user_id'], 'ts, event_id', 20)} select event_id, session_id from sess")
def w1_events(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return sessions.sessionize_count(e, ["user_id"], ["ts", "event_id"], 20).select("event_id", "session_id")


def edges_sql(c, k):
    """List of bin edges as in the operator: k + 1 values, the first one lowered."""
    return (f"(select [lo - (hi - lo) * 0.001] || [lo + i * ((hi - lo) / {k}) for i in range(1, {k})] || [hi] "
            f"from (select min({c}) as lo, max({c}) as hi from lineitem))")


def bin_sql(c, edges):
    return f"greatest(len(list_filter({edges}, lambda e: e < {c})) - 1, 0)"


BINNED = f"""with e as (select {edges_sql('l_quantity', 20)} as edges),
b as (select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as rid, l_quantity, l_returnflag, l_shipdate,
  {bin_sql('l_quantity', 'edges')} as l_quantity_binned, edges from lineitem, e)"""


def _li(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("rid"),
        "l_quantity", "l_returnflag", "l_shipdate")


@query("w2_sessionize_binned", f"""{BINNED}, {sessions_sql('b', ['l_quantity_binned', 'l_returnflag'], 'l_shipdate, rid', 100)}
select rid, l_quantity_binned, session_id from sess""")
def w2(spark, sf):
    return sessions.sessionize_binned(_li(spark, sf), "l_quantity", 20, ["l_returnflag"], ["l_shipdate", "rid"], 100).select(
        "rid", "l_quantity_binned", "session_id")


@query("w3_equal_width_bin", f"{BINNED} select rid, l_quantity_binned from b")
def w3(spark, sf):
    return sessions.equal_width_bin(_li(spark, sf), "l_quantity", 20, "l_quantity_binned")[0].select("rid", "l_quantity_binned")


@query("w4_sample_from_bin", f"""{BINNED} select rid, round(edges[l_quantity_binned + 1] +
{X.fraction_sql('bin', 'rid')} * (edges[l_quantity_binned + 2] - edges[l_quantity_binned + 1]), 6) as value from b""")
def w4(spark, sf):
    binned, edges = sessions.equal_width_bin(_li(spark, sf), "l_quantity", 20, "l_quantity_binned")
    back = sessions.restore_binned(binned, "l_quantity_binned", edges, "value", "bin", "rid")
    return back.select("rid", tidy("value").alias("value"))


@query("w5_check_sessions", f"""{FL}, {sessions_sql('flows', KEYS, 'ts, rid', 50)},
f as (select count(distinct session_id) as n_sessions, max(session_id) + 1 as total, count(distinct (session_id, srcip, proto)) as n_groups from sess)
select *, cast(n_sessions = total and total = n_groups as int) as ok from f""")
def w5(spark, sf):
    return sessions.check_sessions(_flow_sessions(spark, sf), KEYS)


@query("w6_group_facts", f"{FL} select count(*) as n_groups, max(size) as max_size from (select srcip, proto, count(*) as size from flows group by all)")
def w6(spark, sf):
    return sessions.group_summary(X.flows(spark, sf), KEYS)[0]


@query("w6_largest_groups", f"{FL} select srcip, proto, count(*) as size from flows group by all order by size desc, srcip, proto limit 10")
def w6_top(spark, sf):
    return sessions.group_summary(X.flows(spark, sf), KEYS)[1]


@query("w7_chunk_fixed_size", f"""{FL} select rid, cast((row_number() over (order by ts, rid) - 1) //
cast(ceil((select count(*) from flows) / {N_CHUNKS}::double) as bigint) as int) as chunk from flows""")
def w7(spark, sf):
    return sessions.chunk_fixed_size(X.flows(spark, sf).select("rid", "ts"), ["ts", "rid"], N_CHUNKS).select("rid", "chunk")


CHUNK_SQL = f"""{FL},
te as (select [lo + i * ((hi - lo) / {N_CHUNKS}) for i in range(0, {N_CHUNKS})] || [hi * (1 + 1e-5)] as edges
  from (select min(ts) as lo, max(ts) as hi from flows)),
chunked as (select f.*, cast(len(list_filter(edges, lambda e: e <= ts)) - 1 as int) as chunk from flows f, te)"""


def _chunked(spark, sf):
    return sessions.chunk_fixed_time(X.flows(spark, sf), "ts", N_CHUNKS)


@query("w8_chunk_fixed_time", f"{CHUNK_SQL} select rid, chunk from chunked")
def w8(spark, sf):
    return _chunked(spark, sf).select("rid", "chunk")


@query("w8_dense_ids", """with f as (select event_id, epoch(ts) + floor(epoch(ts) / 2592000) * 9000000 as t from events),
te as (select [lo + i * ((hi - lo) / 30) for i in range(0, 30)] || [hi * (1 + 1e-5)] as edges from (select min(t) as lo, max(t) as hi from f)),
c as (select event_id, len(list_filter(edges, lambda e: e <= t)) - 1 as c from f, te)
select event_id, cast(dense_rank() over (order by c) - 1 as int) as chunk from c""")
def w8_dense(spark, sf):
    e = table(spark, sf, "events").select("event_id", (X.micros("ts") / 1_000_000).alias("t"))
    # months moved apart leave empty chunks between them
    e = e.withColumn("t", F.col("t") + F.floor(F.col("t") / 2592000) * 9000000)
    return sessions.chunk_fixed_time(e, "t", 30, dense_ids=True).select("event_id", "chunk")


SESSION_KEYS = ["srcip", "dstip", "proto"]
INDEX_SQL = f"{CHUNK_SQL}, idx as (select srcip, dstip, proto, list_sort(list(distinct chunk)) as chunks from chunked group by all)"


def _index(spark, sf):
    return sessions.chunk_index(_chunked(spark, sf), SESSION_KEYS)


@query("w9_chunk_index", f"{INDEX_SQL} select srcip, dstip, proto, array_to_string(chunks, ',') as chunks from idx")
def w9(spark, sf):
    return _index(spark, sf).withColumn("chunks", F.array_join(F.col("chunks").cast("array<string>"), ","))


@query("w10_chunk_stats", f"""{INDEX_SQL}, s as (select *, list_distinct([chunks[i + 1] - chunks[i] for i in range(1, len(chunks))]) as steps from idx)
select count(*) as n_sessions, count(*) filter (where len(chunks) > 1) as n_cross, count(*) filter (where len(steps) > 1) as n_gapped from s""")
def w10(spark, sf):
    return sessions.chunk_stats(_index(spark, sf))


@query("w11_max_session_len", f"{CHUNK_SQL} select least(max(n), 40) as max_len from (select chunk, srcip, proto, count(*) as n from chunked group by all)")
def w11(spark, sf):
    return sessions.max_session_len(_chunked(spark, sf), KEYS, configured=40)


@query("w12_truncate_sessions", f"""{FL} select rid from (select rid, row_number() over (partition by srcip, proto order by ts, rid) as p from flows) where p <= 25""")
def w12(spark, sf):
    return sessions.truncate_sessions(_trace(spark, sf), KEYS, ["ts", "rid"], 25).select("rid")


@query("w13_interarrival", f"""{FL} select rid, coalesce(ts - lag(ts) over (partition by srcip, proto order by ts, rid), 0e0) as interarrival,
min(ts) over (partition by srcip, proto) as flow_start from flows""")
def w13(spark, sf):
    return sessions.encode_interarrival(_trace(spark, sf), KEYS, "ts", ["rid"]).select("rid", "interarrival", "flow_start")


@query("w14_decode_interarrival", f"{FL} select rid, ts from flows")
def w14(spark, sf):
    enc = sessions.encode_interarrival(_trace(spark, sf), KEYS, "ts", ["rid"]).withColumnRenamed("ts", "pos_ts")
    enc = enc.withColumn("pos", F.struct("pos_ts", "rid"))
    return sessions.decode_interarrival(enc, KEYS, "pos", "flow_start", "interarrival").select("rid", "ts")


@query("w15_raw_time", f"""{CHUNK_SQL} select rid, chunk, round((ts - min(ts) over (partition by chunk)) /
(max(ts) over (partition by chunk) - min(ts) over (partition by chunk)), 6) as t from chunked""")
def w15(spark, sf):
    return sessions.encode_raw_time(_chunked(spark, sf), "ts", "chunk", "t").select("rid", "chunk", tidy("t").alias("t"))


@query("w16_session_duration", f"{FL} select srcip, proto, max(ts) - min(ts) as duration from flows group by all")
def w16(spark, sf):
    return sessions.session_duration(X.flows(spark, sf), KEYS, "ts")


def _tag_sql(variant):
    shown = "and chunks[1] = c" if variant == "v1" else ""
    return f"""tags_{variant} as (select srcip, dstip, proto, c as chunk, cast(chunks[1] = c as int) as starts_here,
[cast(list_contains(chunks, i) {shown} as int) for i in range(0, {N_CHUNKS})] as present
from (select *, unnest(chunks) as c from idx))"""


def _tag_out(df):
    return df.select("srcip", "dstip", "proto", "chunk", "starts_here", F.array_join(F.col("present").cast("array<string>"), "").alias("present"))


for _variant in ("v1", "v2"):
    def _run(spark, sf, variant=_variant):
        return _tag_out(sessions.tag_sessions(_index(spark, sf), N_CHUNKS, variant))

    query(f"w17_tag_sessions_{_variant}",
          f"{INDEX_SQL}, {_tag_sql(_variant)} select srcip, dstip, proto, chunk, starts_here, array_to_string(present, '') as present from tags_{_variant}")(_run)


@query("w18_propagate_sessions", f"""{INDEX_SQL}, {_tag_sql('v2')},
own as (select * from tags_v2 where starts_here = 1 and present[chunk + 1] = 1)
select srcip, dstip, proto, chunk, starts_here, array_to_string(present, '') as present from own
union all select srcip, dstip, proto, cast(i as int), 0, array_to_string(present, '') from own, range({N_CHUNKS}) r(i)
where i > chunk and present[i + 1] = 1""")
def w18(spark, sf):
    return _tag_out(sessions.propagate_sessions(sessions.tag_sessions(_index(spark, sf), N_CHUNKS, "v2"), N_CHUNKS))


@query("w19_dedupe_sessions", f"""{FL} select srcip, proto, dstip, byt, rid from
(select *, row_number() over (partition by srcip, proto order by rid) as p from flows) where p = 1""")
def w19(spark, sf):
    return sessions.dedupe_sessions(X.flows(spark, sf).select("srcip", "proto", "dstip", "byt", "rid"), KEYS, "rid")


@query("w20_relative_time", f"{FL} select rid, ts - (select min(ts) from flows) as ts from flows")
def w20(spark, sf):
    return sessions.relative_time(X.flows(spark, sf), "ts").select("rid", "ts")


@query("w21_order_output", f"{FL} select rid, ts from flows order by ts, rid")
def w21(spark, sf):
    return sessions.order_output(X.flows(spark, sf).select("rid", "ts"), "ts", "rid")


@query("x5_session_processor", f"""{FL}, p as (select *, row_number() over (partition by srcip, proto order by ts, rid) - 1 as pos from flows)
select srcip, proto, cast(pos as int) as pos, round(ts, 0) as ts, type, round(byt, 3) as byt from p where pos < 30""")
def x5(spark, sf):
    f = X.flows(spark, sf).select("rid", "srcip", "proto", "ts", "type", "byt")
    roles = RoleSpec(metadata=("srcip", "proto"), timeseries=("type", "byt"), timestamp="ts", discrete=("srcip", "proto", "type"))
    p = SessionProcessor(roles, ("rid",), 30).fit(f)
    back = p.inverse(p.transform(f))
    return back.select("srcip", "proto", "pos", tidy("ts", 0).alias("ts"), "type", tidy("byt", 3).alias("byt"))
