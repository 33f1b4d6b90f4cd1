"""Inputs that Spark derives from the given tables, and the same inputs as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracekit.plans.registry import table

SIGNALS = ["click", "error", "purchase", "signup", "view"]

EPOCH = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {})"


def micros(c: str) -> Column:
    return F.expr(EPOCH.format(c))


def seconds(c: str) -> Column:
    """Whole seconds since 1970 as bigint."""
    return F.floor(micros(c) / 1_000_000).cast("bigint")


def hour(c: str) -> Column:
    return (F.floor(micros(c) / 3_600_000_000) * 3600).cast("double")


# ---- narrow signal log ------------------------------------------------------------------

def signal_log(spark: SparkSession, sf: str) -> DataFrame:
    """Timestamps are cut to the hour, so several signals meet on one timestamp."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_type").alias("name"),
        F.col("value").cast("string").alias("value"),
        hour("ts").alias("timestamp"),
        F.col("event_id").alias("seq"),
    )


SIGNALS_SQL = """
signals as (
  select event_type as name, value, cast(epoch(date_trunc('hour', ts)) as double) as timestamp, event_id as seq
  from events),
wide as (
  select timestamp, """ + ", ".join(
    f"arg_max(value, seq) filter (where name = '{n}') as {n}" for n in SIGNALS
) + """ from signals group by timestamp)
"""


def wide_signals(spark: SparkSession, sf: str) -> DataFrame:
    from tracekit.operators.reshape import pivot_signals

    wide = pivot_signals(signal_log(spark, sf), SIGNALS, "seq")
    return wide.select("timestamp", *[F.col(n).cast("double").alias(n) for n in SIGNALS])


# ---- frames -----------------------------------------------------------------------------

def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of a frame log as text: key, ts_text, can_id, dlc, data."""
    o = table(spark, sf, "orders")
    dlc = (F.col("o_orderkey") % 9).cast("int")
    body = F.md5(F.col("o_orderkey").cast("string"))
    return o.select(
        F.col("o_orderkey").alias("key"),
        F.concat_ws(
            ".", seconds("o_orderdate").cast("string"),
            F.lpad((F.col("o_orderkey") % 1_000_000).cast("string"), 6, "0"),
        ).alias("ts_text"),
        F.lpad(F.lower(F.hex(F.col("o_custkey") % 2048)), 4, "0").alias("can_id"),
        dlc.alias("dlc"),
        F.slice(F.array(*[F.substring(body, 2 * i + 1, 2) for i in range(8)]), 1, dlc).alias("data"),
        F.when(F.col("o_orderstatus") == "F", "T").otherwise("R").alias("label"),
        F.col("o_orderpriority").alias("class"),
    )


FRAMES_SQL = """
frames as (
  select o_orderkey as key,
         cast(cast(epoch(o_orderdate) as bigint) as varchar) || '.' || lpad(cast(o_orderkey % 1000000 as varchar), 6, '0') as ts_text,
         lpad(lower(to_hex(o_custkey % 2048)), 4, '0') as can_id,
         cast(o_orderkey % 9 as int) as dlc,
         [substr(md5(cast(o_orderkey as varchar)), 1 + 2 * i, 2) for i in range(0, o_orderkey % 9)] as data,
         md5(cast(o_orderkey as varchar)) as body,
         case when o_orderstatus = 'F' then 'T' else 'R' end as label,
         o_orderpriority as class
  from orders),
fbits as (
  select *,
         lpad(bin(('0x' || can_id)::bigint), 11, '0') as idb,
         coalesce(list_aggregate([lpad(bin(('0x' || b)::bigint), 8, '0') for b in data], 'string_agg', ''), '') as datab
  from frames)
"""


# ---- flows ------------------------------------------------------------------------------

FLOW_KEYS = ["srcip", "proto"]


def flows(spark: SparkSession, sf: str) -> DataFrame:
    """Flow records: one row per line item, ``rid`` is unique text."""
    li = table(spark, sf, "lineitem")
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("rid"),
        seconds("l_shipdate").cast("double").alias("ts"),
        F.col("l_quantity").alias("td"),
        F.col("l_suppkey").alias("srcip"),
        F.col("l_partkey").alias("dstip"),
        (F.col("l_orderkey") % 65536).cast("int").alias("srcport"),
        (F.col("l_partkey") * 7 % 65536).cast("int").alias("dstport"),
        F.when(F.col("l_returnflag") == "A", "TCP").when(F.col("l_returnflag") == "N", "UDP")
        .otherwise("ICMP").alias("proto"),
        F.col("l_linenumber").cast("double").alias("pkt"),
        F.col("l_extendedprice").alias("byt"),
        F.col("l_linestatus").alias("type"),
        (F.col("l_orderkey") % 2).cast("int").alias("half"),
    )


FLOWS_SQL = """
flows as (
  select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as rid,
         cast(epoch(l_shipdate) as double) as ts, l_quantity as td, l_suppkey as srcip, l_partkey as dstip,
         cast(l_orderkey % 65536 as int) as srcport, cast(l_partkey * 7 % 65536 as int) as dstport,
         case l_returnflag when 'A' then 'TCP' when 'N' then 'UDP' else 'ICMP' end as proto,
         cast(l_linenumber as double) as pkt, l_extendedprice as byt, l_linestatus as type,
         cast(l_orderkey % 2 as int) as half
  from lineitem)
"""


def real_and_synthetic(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Odd order keys stand for the real table, even ones for the synthetic."""
    return df.where("half = 1").drop("half"), df.where("half = 0").drop("half")


def fraction_sql(seed: object, *keys: str) -> str:
    return f"(('0x' || substr({digest_sql(seed, *keys)}, 1, 8))::bigint / 4294967296.0)"


def digest_sql(seed: object, *keys: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(keys)}))"
