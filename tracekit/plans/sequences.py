"""Queries for token sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracekit.operators import tokens as K
from tracekit.plans import fixtures as X
from tracekit.plans.registry import query, table
from tracekit.session import cut, tidy

COLS = ["o_custkey", "price", "o_orderdate", "o_orderpriority"]

SRC = """src as (select o_orderkey as key, o_custkey, case when o_orderkey % 7 <> 0 then o_totalprice end as price, o_orderdate, o_orderpriority from orders)"""
FLOAT = """ft as (select key, rtrim(format('{:.4f}', price), '0') as t from src),
fs as (select max(instr(t, '.') - 1) as sig, greatest(max(length(t) - instr(t, '.') + 1), 4) as tail from ft),
fd as (select key, sig, least(10, sig + tail) as fw,
  rpad(substr(repeat('0', cast(sig - instr(t, '.') + 1 as int)) || t, 1, 10), cast(least(10, sig + tail) as int), '0') as d from ft, fs)"""
INT = """iw as (select max(length(o_custkey::varchar)) as w from src),
id as (select key, w as iw, lpad(o_custkey::varchar, cast(w as int), '0') as d from src, iw)"""
DATE = """mean as (select cast(trunc(avg(cast(epoch(o_orderdate) as bigint))) as bigint) as m from src),
dv as (select key, m, cast(epoch(o_orderdate) as bigint) - m as v from src, mean),
dw as (select max(length(v::varchar)) as w from dv),
dd as (select key, w as dw, case when v < 0 then '-' || lpad(abs(v)::varchar, cast(w - 1 as int), '0') else lpad(v::varchar, cast(w as int), '0') end as d from dv, dw)"""


def parts_sql(d, w, name=None):
    prefix = f"'{name}_' || lpad(i::varchar, 2, '0') || '___' || " if name else ""
    return (f"[{prefix}case when {d} is null then '@@' else substr({d}, cast(1 + 2 * i as int), 2) end "
            f"for i in range(0, cast(ceil({w} / 2.0) as bigint))]")


TOK = f"""{SRC}, {FLOAT}, {INT}, {DATE},
tok as (select src.key, o_custkey, {parts_sql('id.d', 'iw', '0___NUMERIC___o_custkey')} || {parts_sql('fd.d', 'fw', '1___NUMERIC___price')} ||
  {parts_sql('dd.d', 'dw', '2___DATETIME___o_orderdate')} || ['3___CATEGORICAL___o_orderpriority___' || o_orderpriority] as tokens
  from src join id using (key) join fd using (key) join dd using (key))"""
VOCAB = f"""{TOK},
flat as (select key, unnest(tokens) as token, generate_subscripts(tokens, 1) - 1 as pos from tok),
seen as (select distinct pos, token from flat),
body as (select row_number() over (order by pos, token) + 10 as id, token, cast(pos as int) as pos from seen)"""


def _src(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("key"), "o_custkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"),
        "o_orderdate", "o_orderpriority")


def _codec(spark, sf, **options):
    return K.fit_table(_src(spark, sf), COLS, **options)


def _tokens(spark, sf):
    src = _src(spark, sf)
    codec = K.fit_table(src, COLS)
    return src, codec, K.tokenize(src, codec, "key")


def _vocab(tokens, codec, **options):
    return cut(K.build_vocab(tokens, codec.processed, **options), "vocabulary")


@query("k1_digits_float", f"with {SRC}, {FLOAT} select key, d as digits from fd")
def k1(spark, sf):
    src = _src(spark, sf)
    return src.select("key", K.digits(K.fit_digits(src, ["price"])["price"]).alias("digits"))


@query("k1_digits_integer", f"with {SRC}, {INT} select key, d as digits from id")
def k1_int(spark, sf):
    src = _src(spark, sf)
    return src.select("key", K.digits(K.fit_digits(src, ["o_custkey"])["o_custkey"]).alias("digits"))


@query("k1_digits_signed", """with v as (select c_custkey as key, round(c_acctbal - 5000, 2) as x from customer),
t as (select key, rtrim(format('{:.4f}', x), '0') as t from v), s as (select max(instr(t, '.') - 1) as sig, max(length(t) - instr(t, '.') + 1) as tail from t),
p as (select key, rpad(substr(repeat('0', cast(sig - instr(t, '.') + 1 as int)) || t, 1, 8), cast(least(8, sig + tail) as int), '0') as d from t, s)
select key, case when contains(d, '-') then '-' || replace(d, '-', '') else d end as digits from p""")
def k1_signed(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.round(F.col("c_acctbal") - 5000, 2).alias("x"))
    return c.select("key", K.digits(K.fit_digits(c, ["x"], max_len=8)["x"]).alias("digits"))


@query("k2_digits_datetime", f"with {SRC}, {DATE} select key, d as digits from dd")
def k2(spark, sf):
    src = _src(spark, sf)
    return src.select("key", K.digits(K.fit_digits(src, ["o_orderdate"])["o_orderdate"]).alias("digits"))


@query("k3_digit_parts", f"with {SRC}, {FLOAT} select key, array_to_string({parts_sql('d', 'fw')}, ' ') as parts from fd")
def k3(spark, sf):
    src = _src(spark, sf)
    c = K.fit_digits(src, ["price"])["price"]
    return src.select("key", F.array_join(F.array(*K.digit_parts(K.digits(c), c.width, 2)), " ").alias("parts"))


@query("k5_named_values", "select o_orderkey as key, '3___CATEGORICAL___o_orderpriority___' || o_orderpriority as token, o_orderpriority as back from orders")
def k5(spark, sf):
    o = _src(spark, sf).select("key", K.named(F.col("o_orderpriority"), "3___CATEGORICAL___o_orderpriority").alias("token"))
    return o.withColumn("back", K.unnamed(F.col("token")))


@query("k6_table_tokens", f"with {TOK} select key, array_to_string(tokens, ' ') as tokens from tok")
def k6(spark, sf):
    return _tokens(spark, sf)[2].select("key", F.array_join("tokens", " ").alias("tokens"))


@query("k6_categorical_first", f"""with {TOK} select key, array_to_string([tokens[-1]] || tokens[:-2], ' ') as tokens from tok""")
def k6_first(spark, sf):
    codec = _codec(spark, sf, first=K.CATEGORICAL)
    return K.tokenize(_src(spark, sf), codec, "key").select("key", F.array_join("tokens", " ").alias("tokens"))


SPECIAL_SQL = "sp as (select unnest([" + ", ".join(f"'{t}'" for t in K.SPECIAL_TOKENS) + "]) as token, unnest(range(11)) as id)"


@query("k7_vocabulary", f"""with {VOCAB}, {SPECIAL_SQL},
cols as (select pos, min(regexp_extract(token, '^[0-9]+___[A-Z]+')) as token from body group by pos)
select id, token, pos from body union all select id, token, -1 from sp
union all select 11 + (select count(*) from body) + pos, token, -1 from cols""")
def k7(spark, sf):
    _, codec, tokens = _tokens(spark, sf)
    return _vocab(tokens, codec)


def _ids(spark, sf, **options):
    _, codec, tokens = _tokens(spark, sf)
    return codec, tokens, K.encode_ids(tokens, _vocab(tokens, codec), "key", len(codec.processed), **options)


def _text(df, c):
    return df.withColumn(c, F.array_join(F.col(c).cast("array<string>"), ","))


@query("k8_input_ids", f"""with {VOCAB} select key, '5,' || string_agg(b.id::varchar, ',' order by f.pos) || ',6' as input_ids
from flat f join body b on f.pos = b.pos and f.token = b.token group by key""")
def k8(spark, sf):
    return _text(_ids(spark, sf)[2], "input_ids")


MASK = "('0x' || substr(md5(concat_ws('|', '8-mask-' || f.pos, key)), 1, 8))::bigint / 4294967296.0 < 0.15"


@query("k8_masked_ids", f"""with {VOCAB}, known as (select * from body where token not like '%3___CATEGORICAL%1-URGENT')
select key, '5,' || string_agg((case when {MASK} then 9 else coalesce(b.id, 0) end)::varchar, ',' order by f.pos) as input_ids
from flat f left join known b on f.pos = b.pos and f.token = b.token group by key""")
def k8_masked(spark, sf):
    _, codec, tokens = _tokens(spark, sf)
    vocab = _vocab(tokens, codec).where(~F.col("token").endswith("1-URGENT"))
    return _text(K.encode_ids(tokens, vocab, "key", len(codec.processed), mask_rate=0.15, seed=8, eos=False), "input_ids")


@query("k16_seed_prefix", f"""with {VOCAB} select key, '5,' || string_agg(b.id::varchar, ',' order by f.pos) as input_ids
from flat f join body b on f.pos = b.pos and f.token = b.token where f.token not like '2___%' and f.token not like '3___%' group by key""")
def k16(spark, sf):
    src, codec, tokens = _tokens(spark, sf)
    vocab = _vocab(tokens, codec)
    given = K.seed_columns(codec, ["price", "o_custkey", "o_orderpriority"])
    seeds = K.tokenize(src.select("key", *given), codec, "key", prefix=given)
    n = sum(len(c.parts(codec.nparts)) for c in codec.columns if c.column in given)
    return _text(K.encode_ids(seeds, vocab, "key", n, eos=False), "input_ids")


MAX_LABELS = 140


def _conversations(spark, sf):
    """Parents are the conversations' first turns, children all turns as (role, length) rows."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.length("text").cast("bigint").alias("size"))
    parent = c.groupBy("conv_id").agg(F.min_by("role", "turn").alias("role"), F.max_by("size", "turn").alias("size"))
    pc, cc = K.fit_table(parent, ["role", "size"]), K.fit_table(c, ["role", "size"])
    c = c.withColumn("row", F.concat_ws("-", "conv_id", "turn"))
    pt = K.tokenize(parent, pc, "conv_id")
    ct = K.tokenize(c, cc, "row")
    pv, cv = _vocab(pt, pc), _vocab(ct, cc)
    pid = K.encode_ids(pt, pv, "conv_id", len(pc.processed))
    cid = K.encode_ids(ct, cv, "row", len(cc.processed), bos=False, eos=False).join(c.select("row", "conv_id", "turn"), "row")
    rel, dropped = K.relational_ids(pid, cid, "conv_id", "turn", len(cc.processed), MAX_LABELS)
    return cc, cv, rel, dropped


CONV = f"""c as (select conv_id, turn, role, length(text)::varchar as t from conversations),
w as (select max(length(t)) as w from c),
tk as (select conv_id, turn, ['0___CATEGORICAL___role___' || role] ||
  ['1___NUMERIC___size_' || lpad(i::varchar, 2, '0') || '___' || substr(lpad(t, cast(w as int), '0'), cast(1 + 2 * i as int), 2) for i in range(0, cast(ceil(w / 2.0) as bigint))] as tokens from c, w),
fl as (select conv_id, turn, unnest(tokens) as token, generate_subscripts(tokens, 1) - 1 as pos from tk),
vo as (select row_number() over (order by pos, token) + 10 as id, pos, token from (select distinct pos, token from fl)),
rows as (select conv_id, turn, '7,' || string_agg(id::varchar, ',' order by fl.pos) || ',8' as ids, count(*) as n from fl join vo using (pos, token) group by conv_id, turn),
rel as (select conv_id, '5,' || string_agg(ids, ',' order by turn) || ',6' as labels, 2 + sum(n + 2) as len from rows group by conv_id)"""


@query("k9_relational_ids", f"with {CONV} select conv_id, labels from rel where len <= {MAX_LABELS}")
def k9(spark, sf):
    return _text(_conversations(spark, sf)[2].select("conv_id", "labels"), "labels")


@query("k9_dropped_parents", f"with {CONV} select count(*) filter (where len > {MAX_LABELS}) as dropped, count(*) as total from rel")
def k9_dropped(spark, sf):
    return _conversations(spark, sf)[3]


@query("k10_fill_unknown", f"""with {VOCAB}, known as (select * from body where token not like '%3___CATEGORICAL%1-URGENT' and token not like '0___NUMERIC___o_custkey_00___0%'),
ids as (select key, f.pos, coalesce(b.id, 0) as id from flat f left join known b on f.pos = b.pos and f.token = b.token),
modes as (select pos, arg_min(id, struct_pack(c := -c, i := id)) as m from (select pos, id, count(*) as c from ids group by all) group by pos)
select key, '5,' || string_agg((case when id = 0 then m else id end)::varchar, ',' order by pos) as input_ids from ids join modes using (pos) group by key""")
def k10(spark, sf):
    _, codec, tokens = _tokens(spark, sf)
    vocab = _vocab(tokens, codec).where(~F.col("token").endswith("1-URGENT") & ~F.col("token").startswith("0___NUMERIC___o_custkey_00___0"))
    ids = K.encode_ids(tokens, vocab, "key", len(codec.processed), eos=False)
    return _text(K.fill_unknown(ids, "key"), "input_ids")


@query("k11_split_members", f"""with {CONV}, b as (select conv_id, turn, min(token) filter (where pos = 0) as first_token, count(*) as width from fl group by all)
select b.conv_id, cast(row_number() over (partition by b.conv_id order by turn) - 1 as int) as member, first_token, width
from b join rel using (conv_id) where len <= {MAX_LABELS}""")
def k11(spark, sf):
    cc, cv, rel, _ = _conversations(spark, sf)
    tokens = K.ids_to_tokens(rel.select("conv_id", "labels"), cv, "conv_id", "labels")
    m = K.split_members(tokens, "conv_id", len(cc.processed))
    return m.select("conv_id", "member", F.get("tokens", 0).alias("first_token"), F.size("tokens").alias("width"))


@query("k12_join_digits", f"with {SRC} select key, o_custkey::varchar as id_text, round(price, 4) as price from src where price is not null")
def k12(spark, sf):
    src = _src(spark, sf)
    fit = K.fit_digits(src, ["price", "o_custkey"])
    parts = {c: K.digit_parts(K.digits(f), f.width, 2) for c, f in fit.items()}
    out = src.where("price is not null").select(
        "key", K.join_digits(F.concat(*parts["o_custkey"]), fit["o_custkey"]).alias("id_text"),
        K.join_digits(F.concat(*parts["price"]), fit["price"]).cast("double").alias("price"))
    return out.withColumn("price", tidy("price", 4))


@query("k13_decode_rows", f"with {SRC} select key, o_custkey, price, cast(epoch(o_orderdate) as bigint) as ordered, o_orderpriority from src")
def k13(spark, sf):
    codec, tokens, ids = _ids(spark, sf)
    back = K.decode_rows(K.ids_to_tokens(ids, _vocab(tokens, codec), "key"), codec, ["key"])
    return back.select("key", "o_custkey", "price", X.seconds("o_orderdate").alias("ordered"), "o_orderpriority")


@query("k13_unknown_ids", f"""with {VOCAB} select key, count(*) + 2 as n, case when key % 4 = 0 then '[UNK]' else max(token) filter (where pos = 1) end as second,
max(token) filter (where pos = 2) as third from flat group by key""")
def k13_unknown(spark, sf):
    """Every fourth row gets an id that the vocabulary lacks: its place stays, and so do all others."""
    codec, tokens, ids = _ids(spark, sf)
    spoiled = ids.withColumn("input_ids", F.transform("input_ids", lambda x, i: F.when((i == 2) & (F.col("key") % 4 == 0), F.lit(10**9).cast("bigint")).otherwise(x)))
    t = K.ids_to_tokens(cut(spoiled, "spoiled"), _vocab(tokens, codec), "key")
    return t.select("key", F.size("tokens").cast("bigint").alias("n"), F.get("tokens", 2).alias("second"), F.get("tokens", 3).alias("third"))


@query("k13_invalid_rows", f"with {SRC} select key, o_custkey, price from src where key % 5 <> 0")
def k13_invalid(spark, sf):
    """Every fifth row gets a letter inside the customer number and must disappear."""
    _, codec, tokens = _tokens(spark, sf)
    spoiled = tokens.withColumn("tokens", F.transform("tokens", lambda t, i: F.when(
        (i == 1) & (F.col("key") % 5 == 0), F.concat(F.lit("0___NUMERIC___o_custkey_01___"), F.lit("x1"))).otherwise(t)))
    return K.decode_rows(cut(spoiled, "spoiled"), codec, ["key"], offset=0).select("key", "o_custkey", "price")


@query("k14_pad_labels", f"""with {CONV}, k as (select conv_id, labels, len, max(len) over () as longest from rel where len <= {MAX_LABELS})
select conv_id, longest::bigint as width, (longest - len)::bigint as padded from k""")
def k14(spark, sf):
    p = K.pad_labels(_conversations(spark, sf)[2].select("conv_id", "labels"))
    return p.select("conv_id", F.size("labels").cast("bigint").alias("width"),
                    F.size(F.filter("labels", lambda x: x == K.LABEL_PAD)).cast("bigint").alias("padded"))


@query("k15_mean_predictions", """select user_id, round(avg(value), 6) as mean_value, round(avg(case when event_type = 'view' then 1e0 else 0e0 end), 6) as share
from events group by user_id""")
def k15(spark, sf):
    e = table(spark, sf, "events")
    a = K.mean_predictions(e, "user_id", "value").withColumnRenamed("prediction", "mean_value")
    b = K.mean_predictions(e, "user_id", "event_type", "view").withColumnRenamed("prediction", "share")
    j = a.join(b, "user_id")
    return j.select("user_id", tidy("mean_value").alias("mean_value"), tidy("share").alias("share"))
