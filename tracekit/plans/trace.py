"""Queries for readers, codecs, cleaning and reshaping of traces."""

from __future__ import annotations

import json

from pyarrow import fs
from pyspark.sql import functions as F

from tracekit.functions import codecs as C
from tracekit.operators import clean, sessions
from tracekit.operators.ordered import arrange, same_order
from tracekit.plans import fixtures as X
from tracekit.plans.registry import query, table
from tracekit.session import scratch_path, tidy
from tracekit.sources import captures, tables, traces

SIG = X.SIGNALS
SIG_COLS = ", ".join(SIG)


def _frame_cells(df):
    return df.select(
        "key", "ts", "can_id", "dlc", F.array_join("data", "-").alias("data"),
        *[c for c in ("label", "vehicle", "rejected") if c in df.columns],
    )


FRAME_OUT = "select key, cast(ts_text as double) as ts, can_id, dlc, array_to_string(data, '-') as data"

# ---- the flagship -----------------------------------------------------------------------

FLAG_SQL = f"""
with {X.SIGNALS_SQL},
filled as (
  select timestamp, floor(timestamp / 86400) as day, {", ".join(
    f"last_value({n} ignore nulls) over (order by timestamp rows between unbounded preceding and current row) as {n}"
    for n in SIG)}
  from wide),
kept as (select * from filled where {" and ".join(f"{n} is not null" for n in SIG)}),
numbered as (select *, row_number() over (partition by day order by timestamp) - 1 as rn from kept),
bases as (
  select day, sum(ceil(n / 8.0)) over (order by day) - ceil(n / 8.0) as base
  from (select day, count(*) as n from kept group by day)),
sess as (
  select n.*, cast(base + floor(rn / 8) as bigint) as session_id from numbered n join bases b on n.day = b.day),
gaps as (
  select *, coalesce(timestamp - lag(timestamp) over (partition by session_id order by timestamp), 0) as gap from sess)
select session_id, count(*) as n_rows, min(timestamp) as start_ts, max(timestamp) - min(timestamp) as duration,
       round(sum(gap) / count(*), 6) as mean_gap, round(avg(view), 6) as mean_view
from gaps group by session_id
"""


@query("flagship_trace_sessions", FLAG_SQL)
def flagship(spark, sf):
    # day grows with the timestamp, so one sort serves the fill, the sessions and the gaps
    wide = arrange(X.wide_signals(spark, sf), ["timestamp"])
    filled, _ = clean.impute_ffill(wide, ["timestamp"], SIG)
    filled = same_order(filled.withColumn("day", F.floor(F.col("timestamp") / 86400)), ["timestamp"], ["day"])
    cut_up = same_order(sessions.sessionize_count(filled, ["day"], ["timestamp"], 8), ["timestamp"], ["session_id"])
    gaps = sessions.encode_interarrival(cut_up, ["session_id"], "timestamp", [])
    return gaps.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("timestamp").alias("start_ts"),
        (F.max("timestamp") - F.min("timestamp")).alias("duration"),
        tidy(F.sum("interarrival") / F.count(F.lit(1))).alias("mean_gap"),
        tidy(F.avg("view")).alias("mean_view"),
    )


# ---- sources ----------------------------------------------------------------------------

@query("s1_signal_log", "select event_type as name, value, epoch(ts) as timestamp, event_id as key from events")
def s1(spark, sf):
    e = table(spark, sf, "events")
    line = F.to_json(F.struct(
        F.col("event_type").alias("name"), F.col("value").alias("value"),
        (X.micros("ts") / 1_000_000).alias("timestamp"),
    ))
    parsed = traces.parse_signal_log(e.select(F.col("event_id").alias("key"), line.alias("value")))
    return parsed.withColumn("value", F.col("value").cast("double"))


@query("s2_frame_log", f"with {X.FRAMES_SQL} {FRAME_OUT} from frames")
def s2(spark, sf):
    f = X.frames(spark, sf)
    line = F.concat(
        F.lit("Timestamp: "), "ts_text", F.lit("        ID: "), "can_id", F.lit("    000    DLC: "),
        F.col("dlc").cast("string"), F.lit("    "), F.array_join("data", " "),
    )
    return _frame_cells(traces.parse_frame_log(f.select("key", line.alias("value"))))


def _ragged_lines(spark, sf):
    """Odd keys carry a label; every 10th line claims one byte too many."""
    f = X.frames(spark, sf)
    wrong = F.when(F.col("key") % 10 == 3, F.col("dlc") + 2).otherwise(F.col("dlc"))
    cells = F.concat(
        F.array("ts_text", "can_id", wrong.cast("string")), "data",
        F.when(F.col("key") % 2 == 1, F.array("label")).otherwise(F.array().cast("array<string>")),
    )
    return f.select("key", F.array_join(cells, ",").alias("value"))


@query("s3_ragged_frames", f"""with {X.FRAMES_SQL} {FRAME_OUT},
case when key % 2 = 1 then label end as label, 0 as rejected from frames where key % 10 <> 3
union all select key, null, null, null, null, null, 1 from frames where key % 10 = 3""")
def s3(spark, sf):
    good, bad = traces.parse_ragged_frames(_ragged_lines(spark, sf))
    return _frame_cells(good).withColumn("rejected", F.lit(0)).unionByName(
        bad.select("key", F.lit(1).alias("rejected")), allowMissingColumns=True
    )


@query("s4_candump", f"with {X.FRAMES_SQL} {FRAME_OUT} from frames")
def s4(spark, sf):
    f = X.frames(spark, sf)
    line = F.concat(F.lit("("), "ts_text", F.lit(") slcan0 "), "can_id", F.lit("#"), F.array_join("data", ""))
    return _frame_cells(traces.parse_candump(f.select("key", line.alias("value"))))


@query("s5_classed_frames", f"with {X.FRAMES_SQL} {FRAME_OUT}, class as label from frames")
def s5(spark, sf):
    rows = X.frames(spark, sf).select(
        "key", F.col("ts_text").alias("Timestamp"), F.col("can_id").alias("Arbitration_ID"),
        F.col("dlc").alias("DLC"), F.array_join("data", " ").alias("Data"), F.col("class").alias("Class"),
    )
    return _frame_cells(traces.parse_classed_frames(rows))


def _tree(spark, sf, name):
    """Ragged lines written as <root>/<vehicle>/<file>, three vehicles."""
    root = scratch_path(spark, name)
    lines = _ragged_lines(spark, sf)  # with every tenth line of a wrong length, which the reader turns away
    lines.select(F.concat(F.lit("v"), (F.col("key") % 3).cast("string")).alias("vehicle"), "value").write.partitionBy(
        "vehicle").text(root)
    return root


TREE_SQL = f"""with {X.FRAMES_SQL}
select 'vehicle=v' || key % 3 as vehicle, can_id, count(*) as n, sum(dlc)::bigint as bytes,
       count(case when key % 2 = 1 then label end) as labelled
from frames where key % 10 <> 3 group by all"""


def _tree_summary(df, vehicle):
    return df.groupBy(F.col(vehicle).alias("vehicle"), "can_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("dlc").alias("bytes"), F.count("label").alias("labelled")
    )


@query("s6_frames_dir", TREE_SQL)
def s6(spark, sf):
    return _tree_summary(traces.read_frames_dir(spark, _tree(spark, sf, "s6"), traces.read_ragged_frames), "vehicle")


@query("s7_signal_csv", "select cast(user_id as int) as \"ID\", event_id as key, value as \"Signal1\" from events")
def s7(spark, sf):
    e = table(spark, sf, "events").select(
        F.concat(F.lit("id"), F.col("user_id").cast("string")).alias("ID"), F.col("event_id").alias("key"),
        F.col("value").alias("Signal1"),
    )
    return traces.parse_signal_rows(e)


@query("s8_convert_tree", TREE_SQL)
def s8(spark, sf):
    out = scratch_path(spark, "s8-out")
    traces.convert_tree(spark, _tree(spark, sf, "s8"), out, traces.read_ragged_frames)
    return _tree_summary(spark.read.parquet(out), "dataset")


@query("s9_read_many", "select o_orderkey, o_orderstatus, o_totalprice from orders")
def s9(spark, sf):
    schema = "o_orderkey bigint, o_orderstatus string, o_totalprice double"
    paths = []
    for i in range(3):
        paths.append(scratch_path(spark, f"s9-{i}"))
        table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").where(
            F.col("o_orderkey") % 3 == i).write.csv(paths[-1], header=True)
    return traces.read_many(spark, paths, schema)


META_LINES = ["C 0 100", "D {R A N}", "C 0.0 1.0", "D F O"]


def _typed_lines(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("rid"),
        F.concat_ws("  ", F.col("l_quantity").cast("string"), "l_returnflag", F.col("l_discount").cast("string"),
                    "l_linestatus").alias("value"),
    )


RID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as rid"


@query("s10_typed_tsv", f"""select {RID}, l_quantity as c0, cast(list_position(['R','A','N'], l_returnflag) - 1 as int) as c1,
l_discount as c2, cast(list_position(['F','O'], l_linestatus) - 1 as int) as c3 from lineitem""")
def s10(spark, sf):
    return tables.parse_typed_rows(_typed_lines(spark, sf), tables.parse_meta(META_LINES))


@query("s11_write_typed_tsv", f"""select {RID}, l_quantity as q, l_discount as d, l_returnflag as f, l_linestatus as s
from lineitem""")
def s11(spark, sf):
    meta = tables.parse_meta(META_LINES)
    text = tables.format_typed_rows(tables.parse_typed_rows(_typed_lines(spark, sf), meta), meta)
    cells = F.split("value", " ")
    return text.select(
        "rid", F.get(cells, 0).cast("double").alias("q"), F.get(cells, 2).cast("double").alias("d"),
        F.get(cells, 1).alias("f"), F.get(cells, 3).alias("s"),
    )


CUSTOMER_META = json.dumps({"columns": [
    {"name": "c_custkey", "type": "continuous"}, {"name": "c_mktsegment", "type": "categorical"},
    {"name": "c_nationkey", "type": "ordinal"}, {"name": "c_acctbal", "type": "continuous"}]})


@query("s12_csv_with_roles", """select cast(c_custkey as double) as c_custkey, c_mktsegment,
cast(c_nationkey as varchar) as c_nationkey, c_acctbal, 'c_mktsegment,c_nationkey' as discrete from customer""")
def s12(spark, sf):
    path, meta = scratch_path(spark, "s12"), scratch_path(spark, "s12-meta")
    cols = ["c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal"]
    table(spark, sf, "customer").select(*cols).write.csv(path, header=True)
    spark.createDataFrame([(CUSTOMER_META,)], "value string").coalesce(1).write.text(meta)
    df, discrete = tables.read_csv_with_roles(spark, path, meta)
    return df.withColumn("discrete", F.lit(",".join(discrete)))


def _hex(c, digits):
    return F.lpad(F.hex(c), digits, "0")


def _capture_files(spark, sf, per_file=2000):
    """One little-endian capture per group of packets built from line items; VLAN tag on every third packet."""
    li = table(spark, sf, "lineitem")
    n_files = max(li.count() // per_file, 1)
    swap = lambda h: F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])
    proto = F.when(F.col("l_returnflag") == "A", 6).when(F.col("l_returnflag") == "N", 17).otherwise(1)
    ether = F.concat(
        F.lit("00" * 12), F.when(F.col("l_orderkey") % 3 == 0, F.lit("810000050800")).otherwise(F.lit("0800"))
    )
    ip = F.concat(
        F.lit("45"), _hex(F.col("l_linenumber"), 2), _hex(F.col("l_quantity").cast("int") + 40, 4),
        _hex(F.col("l_orderkey") % 65536, 4), _hex(F.lit(2 << 13) + F.col("l_linenumber"), 4),
        F.lit("40"), _hex(proto, 2), _hex(F.col("l_suppkey") % 65536, 4),
        _hex(F.col("l_suppkey") + 167772160, 8), _hex(F.col("l_partkey") + 3232235520, 8),
        _hex(F.col("l_orderkey") % 65536, 4), _hex(F.col("l_partkey") % 65536, 4), F.lit("00000000"),
    )
    packet = F.concat(ether, ip)
    size = swap(_hex((F.length(packet) / 2).cast("int"), 8))
    record = F.concat(swap(_hex(X.seconds("l_shipdate"), 8)), swap(_hex(F.col("l_linenumber"), 8)), size, size, packet)
    rid = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    spread = F.conv(F.substring(F.md5(rid), 1, 8), 16, 10).cast("bigint") % n_files
    header = "d4c3b2a1" + "02000400" + "00" * 8 + "ffff0000" + "01000000"
    return li.select(spread.cast("string").alias("path"), record.alias("r")).groupBy("path").agg(
        F.unhex(F.concat(F.lit(header), F.array_join(F.collect_list("r"), ""))).alias("content")
    )


S13_SQL = """select l_suppkey + 167772160 as srcip, l_partkey + 3232235520 as dstip,
cast(case when l_returnflag in ('A','N') then l_orderkey % 65536 else 0 end as int) as srcport,
cast(case when l_returnflag in ('A','N') then l_partkey % 65536 else 0 end as int) as dstport,
case l_returnflag when 'A' then 'TCP' when 'N' then 'UDP' else 'ICMP' end as proto,
cast(epoch(l_shipdate) as bigint) * 1000000 + l_linenumber as time, cast(l_quantity + 40 as int) as pkt_len,
4 as version, 5 as ihl, l_linenumber as tos, cast(l_orderkey % 65536 as int) as id, 2 as flag, l_linenumber as "off",
64 as ttl, cast(l_suppkey % 65536 as int) as chksum from lineitem"""


@query("s13_captures", S13_SQL)
def s13(spark, sf):
    return captures.parse_captures(_capture_files(spark, sf)).drop("path", "seq")


def _write_files(files, folder):
    """Each content as a file of its own, by the tasks that hold them; a repeated task writes the same files."""
    def write(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                store, inner = fs.FileSystem.from_uri(f"{folder}/{path}.pcap")
                store.create_dir(inner.rpartition("/")[0], recursive=True)
                with store.open_output_stream(inner) as out:
                    out.write(content)
            yield pdf[["path"]]

    files.mapInPandas(write, "path string").count()


@query("s13_capture_ranges", S13_SQL)
def s13_ranges(spark, sf):
    """The same captures as files, each read in ranges that cut records anywhere."""
    folder = scratch_path(spark, "s13")
    folder = folder if "://" in folder else f"file://{folder}"
    _write_files(_capture_files(spark, sf, 50_000), folder)
    return captures.read_captures(spark, folder, 1 << 20).drop("path", "seq")


BITS_SQL = f"""with {X.FRAMES_SQL}
select key, cast(ts_text as double) as "Timestamp", {", ".join(
    f'cast(substr(idb, {i + 1}, 1) as int) as "CAN_ID_{i}"' for i in range(11))}, dlc as "DLC", {", ".join(
    f'cast(case when {i} < 8 * dlc then substr(datab, {i + 1}, 1) end as int) as "DATA_{i}"' for i in range(64))},
label as "Label" from fbits"""


@query("s14_write_bits", BITS_SQL)
def s14(spark, sf):
    path = scratch_path(spark, "s14")
    f = X.frames(spark, sf).select("key", F.col("ts_text").cast("double").alias("ts"), "can_id", "dlc", "data", "label")
    bits = traces.to_bits(f)
    traces.write_bits(bits, path)
    ids = ", ".join(f"CAN_ID_{i} int" for i in range(11))
    data = ", ".join(f"DATA_{i} int" for i in range(64))
    return spark.read.schema(f"key bigint, Timestamp double, {ids}, DLC int, {data}, Label string").csv(path, header=True)


# ---- codecs -----------------------------------------------------------------------------

@query("c1_hex_to_bits", """select o_orderkey as key,
lpad(bin(('0x' || substr(md5(o_orderkey::varchar), 1, 16))::ubigint), 64, '0') as bits,
case when length(bin(o_orderkey)) > 8 then bin(o_orderkey) else lpad(bin(o_orderkey), 8, '0') end as small from orders""")
def c1(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("key"),
        C.hex_to_bits(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 16), 64).alias("bits"),
        C.hex_to_bits(F.hex("o_orderkey"), 8).alias("small"),
    )


@query("c2_can_id_bits", f"""with {X.FRAMES_SQL} select key, {", ".join(
    f"cast(substr(idb, {i + 1}, 1) as int) as b{i}" for i in range(11))} from fbits""")
def c2(spark, sf):
    f = X.frames(spark, sf).select("key", C.can_id_bits("can_id").alias("b"))
    return f.select("key", *[F.get("b", i).alias(f"b{i}") for i in range(11)])


@query("c3_payload_bits", f"""with {X.FRAMES_SQL} select key, length(datab) as n_bits,
datab as bits, 64 - length(datab) as n_null from fbits""")
def c3(spark, sf):
    f = X.frames(spark, sf).select("key", C.payload_bits("data").alias("b"))
    return f.select(
        "key", F.size(F.filter("b", lambda x: x.isNotNull())).alias("n_bits"),
        F.array_join(F.transform("b", lambda x: x.cast("string")), "").alias("bits"),
        F.size(F.filter("b", lambda x: x.isNull())).alias("n_null"),
    )


def _bits(spark, sf):
    f = X.frames(spark, sf)
    return f.select("key", "can_id", "dlc", "data", C.can_id_bits("can_id").alias("ib"), C.payload_bits("data").alias("db"))


@query("c4_bits_to_can_id", f"with {X.FRAMES_SQL} select key, can_id from frames")
def c4(spark, sf):
    return _bits(spark, sf).select("key", C.bits_to_can_id("ib").alias("can_id"))


@query("c5_bits_to_payload", f"""with {X.FRAMES_SQL} select key, {", ".join(
    f"case when {i} < dlc then data[{i + 1}] else '' end as d{i}" for i in range(8))} from frames""")
def c5(spark, sf):
    p = _bits(spark, sf).select("key", C.bits_to_payload("db", "dlc").alias("p"))
    return p.select("key", *[F.get("p", i).alias(f"d{i}") for i in range(8)])


@query("c6_coerce_bits", f"with {X.FRAMES_SQL} select key, cast(substr(idb, 1, 1) as int) as b0, dlc from fbits")
def c6(spark, sf):
    text = _bits(spark, sf).select("key", F.format_string("%.1f", F.get("ib", 0).cast("double")).alias("b"),
                                   F.col("dlc").cast("double").cast("string").alias("d"))
    return text.select("key", C.coerce_bits("b").alias("b0"), C.coerce_bits("d").alias("dlc"))


@query("c7_map_labels", """select o_orderkey as key, case o_orderstatus when 'F' then 0 when 'O' then 1 end as code,
case o_orderstatus when 'F' then 'F' when 'O' then 'O' end as back from orders""")
def c7(spark, sf):
    m = {"F": 0, "O": 1}
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), C.map_labels("o_orderstatus", m).alias("code"))
    return o.withColumn("back", C.map_labels("code", {v: k for k, v in m.items()}))


@query("c8_ip_codec", """select p_partkey as key, 3232235520 + p_partkey as ip,
'192.168.' || cast(p_partkey // 256 as varchar) || '.' || cast(p_partkey % 256 as varchar) as text from part""")
def c8(spark, sf):
    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias("key"), C.long_to_ip(F.lit(3232235520) + F.col("p_partkey")).alias("text"))
    return p.withColumn("ip", C.ip_to_long("text"))


@query("c9_proto_codec", f"""with {X.FLOWS_SQL} select rid, case proto when 'TCP' then 6 when 'UDP' then 17 else 1 end as num,
proto as name from flows""")
def c9(spark, sf):
    f = X.flows(spark, sf).select("rid", C.proto_to_int(F.lower("proto")).alias("num"))
    return f.withColumn("name", C.proto_to_str("num"))


@query("c10_encode_bits", f"""select p_partkey as key, {", ".join(
    f"cast(1 - ((p_size >> {5 - i}) & 1) as double) as z{i}, cast((p_size >> {5 - i}) & 1 as double) as o{i}" for i in range(6))} from part""")
def c10(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), C.encode_bits("p_size", 6).alias("e"))
    return p.select("key", *[F.get("e", 2 * i + k).alias(f"{n}{i}") for i in range(6) for k, n in ((0, "z"), (1, "o"))])


@query("c11_decode_bits", "select p_partkey as key, cast(p_size as bigint) as size from part")
def c11(spark, sf):
    p = table(spark, sf, "part")
    noisy = p.withColumn("e", F.transform(C.encode_bits("p_size", 6), lambda x: x * 0.6 + 0.2))
    return noisy.select(F.col("p_partkey").alias("key"), C.decode_bits("e", 6).alias("size"))


@query("c12_extract_typed", r"""select event_id as key, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k from events""")
def c12(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("key"), C.extract_typed("props", r"([0-9]+)", "bigint").alias("k"))


