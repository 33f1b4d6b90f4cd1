"""Rows to token sequences and back.

A numeric column becomes a fixed-width digit string cut into parts, every part a
token that carries its column name. The fitted widths are a few integers per
column; the vocabulary is a DataFrame with dense ids.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracekit.operators.clean import numeric_columns
from tracekit.operators.ordered import ordered_position
from tracekit.session import cut, fraction

# The marker tokens in id order.
SPECIAL_TOKENS = [
    "[UNK]", "[SEP]", "[PAD]", "[CLS]", "[MASK]", "[BOS]", "[EOS]", "[BMEM]", "[EMEM]", "[RMASK]", "[SPTYPE]",
]
# Column kinds and separators inside token names.
NUMERIC, DATETIME, CATEGORICAL = "NUMERIC", "DATETIME", "CATEGORICAL"
SEP = "___"
NA_TEXT, NA_PART = "<NA>", "@"
TARGET_PREFIX = "_TEACHER_FORCING"
LABEL_PAD = -100
DATE_LEN = 10
NOT_NUMERIC = r"[^\-.0-9]"


def special_id(token: str) -> int:
    return SPECIAL_TOKENS.index(token)


@dataclass(frozen=True)
class ColumnCodec:
    column: str
    kind: str
    name: str = ""  # "<idx>___<KIND>___<column>"
    integral: bool = True
    max_len: int = 10
    precision: int = 4
    mx_sig: int = -1
    width: int = 0
    mean_date: int = 0
    has_missing: bool = False

    def parts(self, nparts: int) -> list[str]:
        if self.kind == CATEGORICAL:
            return [self.name]
        return [f"{self.name}_{i:02d}" for i in range(-(-self.width // nparts))]


@dataclass(frozen=True)
class TableCodec:
    columns: tuple[ColumnCodec, ...]
    nparts: int
    processed: tuple[str, ...]  # token columns in sequence order
    dtypes: tuple[tuple[str, str], ...]

    def by_name(self) -> dict[str, tuple[ColumnCodec, int]]:
        return {p: (c, i) for c in self.columns for i, p in enumerate(c.parts(self.nparts))}


# ---- digit strings ----------------------------------------------------------------------

def _whole_seconds(c: Column) -> Column:
    """Microseconds to seconds, cut toward zero; works for both timestamp types."""
    return (F.unix_micros(c.cast("timestamp")) / 1_000_000).cast("bigint")


def _float_text(x: Column, precision: int) -> Column:
    text = F.when(x.isNotNull(), F.format_string(f"%.{precision}f", x.cast("double")))
    return F.rtrim(text, F.lit("0"))


def fit_digits(
    df: DataFrame, cols: Sequence[str], max_len: int = 10, precision: int = 4
) -> dict[str, ColumnCodec]:
    """Widths of all numeric and datetime columns from one aggregation (two when there are dates)."""
    dates = [c for c in cols if isinstance(df.schema[c].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]
    means = {}
    if dates:
        row = df.agg(*[F.avg(_whole_seconds(F.col(c))).alias(c) for c in dates]).first()
        means = {c: int(row[c]) for c in dates}
    aggs = []
    for c in cols:
        x = _whole_seconds(F.col(c)) - means[c] if c in means else F.col(c)
        text = _float_text(x, precision)
        aggs += [
            F.min((x.cast("double") == F.rint(x.cast("double"))).cast("int")).alias(f"whole_{c}"),
            F.max(F.length(x.try_cast("decimal(38,0)").cast("string"))).alias(f"int_{c}"),
            F.max(F.instr(text, ".") - 1).alias(f"sig_{c}"),
            F.max(F.length(text) - F.instr(text, ".") + 1).alias(f"tail_{c}"),
            F.max(F.col(c).isNull().cast("int")).alias(f"na_{c}"),
        ]
    row = df.agg(*aggs).first()
    out = {}
    for c in cols:
        missing = bool(row[f"na_{c}"])
        kind = DATETIME if c in means else NUMERIC
        size, digits = (DATE_LEN, 0) if kind == DATETIME else (max_len, precision)
        base = ColumnCodec(c, kind, max_len=size, precision=digits, mean_date=means.get(c, 0), has_missing=missing)
        if row[f"whole_{c}"] != 0:
            # a missing cell reads "<NA>" and counts with its length
            width = max(row[f"int_{c}"] or 0, len(NA_TEXT) if missing else 0)
            out[c] = replace(base, width=width)
            continue
        sig = row[f"sig_{c}"]
        if size <= sig + 1:
            raise ValueError(f"length {size} leaves no decimal for {c}: use at least {sig + 2}")
        tail = max(row[f"tail_{c}"], len("nan") + 1 if missing else 0)
        out[c] = replace(base, integral=False, mx_sig=sig, width=min(size, sig + tail))
    return out


def digits(codec: ColumnCodec, c: Column | str | None = None) -> Column:
    """The fixed-width digit string; missing stays null."""
    x = F.col(codec.column) if c is None else (F.col(c) if isinstance(c, str) else c)
    if codec.kind == DATETIME:
        x = _whole_seconds(x) - codec.mean_date
    if codec.integral:
        text = x.cast("decimal(38,0)").cast("string")
        body = F.regexp_replace(text, "^-", "")
        sign = F.when(text.startswith("-"), "-").otherwise("")
        room = F.greatest(F.lit(codec.width) - F.length(sign), F.length(body))
        return F.concat(sign, F.lpad(body, room, F.lit("0")))
    text = _float_text(x, codec.precision)
    lead = F.greatest(F.lit(codec.mx_sig) - (F.instr(text, ".") - 1), F.lit(0))
    text = F.substring(F.concat(F.repeat(F.lit("0"), lead), text), 1, codec.max_len)
    text = F.rpad(text, F.greatest(F.lit(codec.width), F.length(text)), F.lit("0"))
    return F.when(text.contains("-"), F.concat(F.lit("-"), F.regexp_replace(text, "-", ""))).otherwise(text)


def digit_parts(text: Column, width: int, nparts: int) -> list[Column]:
    """Parts of ``nparts`` characters; a null text (missing or not numeric) becomes placeholders."""
    if nparts > width > 2:
        raise ValueError(f"parts of {nparts} characters are longer than the value length {width}")
    filler = F.lit(NA_PART * nparts)
    return [F.coalesce(F.substring(text, i + 1, nparts), filler) for i in range(0, width, nparts)]


def numeric_text(text: Column) -> Column:
    """Null unless the text has digits, signs and points only."""
    return F.when(~text.rlike(NOT_NUMERIC), text)


def named(c: Column, name: str) -> Column:
    return F.concat(F.lit(name + SEP), c)


def unnamed(c: Column) -> Column:
    return F.substring_index(c, SEP, -1)


# ---- tables -----------------------------------------------------------------------------

def fit_table(
    df: DataFrame, cols: Sequence[str], max_len: int = 10, precision: int = 4, nparts: int = 2,
    first: str | None = None, target: str | None = None,
) -> TableCodec:
    if first not in (None, CATEGORICAL, NUMERIC):
        raise ValueError(f"unknown leading column kind {first}")
    if target is not None and first is not None:
        raise ValueError("a copied target decides the order; leave the leading kind out")
    numbers = set(numeric_columns(df))
    dates = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))}
    fitted = fit_digits(df, [c for c in cols if c in numbers | dates], max_len, precision)
    order = [target, *cols] if target else list(cols)
    pad = len(str(len(order)))
    codecs = []
    for i, c in enumerate(order):
        codec = fitted.get(c, ColumnCodec(c, CATEGORICAL))
        label = f"{TARGET_PREFIX}_{c}" if target and i == 0 else c
        codecs.append(replace(codec, name=f"{i:0{pad}d}{SEP}{codec.kind}{SEP}{label}"))
    missing = {}
    text = [c.column for c in codecs if c.kind == CATEGORICAL]
    if text:
        row = df.agg(*[F.max(F.col(c).isNull().cast("int")).alias(c) for c in set(text)]).first()
        missing = {c: bool(row[c]) for c in text}
    codecs = [replace(c, has_missing=missing[c.column]) if c.kind == CATEGORICAL else c for c in codecs]
    parts = [(p, c.kind) for c in codecs for p in c.parts(nparts)]
    if first is None:
        processed = sorted(p for p, _ in parts)
    else:
        lead = {NUMERIC: 0, DATETIME: 1, CATEGORICAL: 2 if first == NUMERIC else -1}
        key = {p: (lead[k], p.split(SEP, 2)[2] if k == CATEGORICAL else "") for p, k in parts}
        processed = sorted((p for p, _ in parts), key=lambda p: (*key[p], p))
    types = tuple((f.name, f.dataType.simpleString()) for f in df.schema.fields if f.name in cols)
    return TableCodec(tuple(codecs), nparts, tuple(processed), types)


def tokenize(df: DataFrame, codec: TableCodec, key: str, prefix: Sequence[str] | None = None) -> DataFrame:
    """(key, tokens): one named token per processed column; ``prefix`` keeps the columns of a seed."""
    used = [c for c in codec.columns if prefix is None or c.column in prefix]
    # the text of a column is a column of its own, so its parts do not repeat the formatting
    texts = df.select(key, *[
        (F.coalesce(F.col(c.column).cast("string"), F.lit(NA_TEXT)) if c.kind == CATEGORICAL else numeric_text(digits(c))).alias(f"_{i}")
        for i, c in enumerate(used)
    ])
    cells = {}
    for i, c in enumerate(used):
        if c.kind == CATEGORICAL:
            cells[c.name] = F.col(f"_{i}")
        else:
            cells.update(zip(c.parts(codec.nparts), digit_parts(F.col(f"_{i}"), c.width, codec.nparts)))
    return texts.select(key, F.array(*[named(cells[p], p) for p in codec.processed if p in cells]).alias("tokens"))


def seed_columns(codec: TableCodec, given: Sequence[str]) -> list[str]:
    """The leading columns that are all supplied."""
    out = []
    for c in codec.columns:
        if c.column not in given:
            break
        out.append(c.column)
    return out


# ---- vocabulary and ids -----------------------------------------------------------------

def kind_token(name: str) -> str:
    return SEP.join(name.split(SEP)[:2])


def build_vocab(tokens: DataFrame, processed: Sequence[str], special: Sequence[str] = SPECIAL_TOKENS,
                add_columns: bool = True) -> DataFrame:
    """(id, token, pos): special tokens, then per column its sorted distinct tokens, then column tokens."""
    spark = tokens.sparkSession
    # the outer form: the plain one adds a filter on the array, which repeats all its expressions
    seen = tokens.select(F.posexplode_outer("tokens").alias("pos", "token")).distinct()
    body = ordered_position(seen, ["pos", "token"], name="id").select(
        (F.col("id") + len(special)).alias("id"), "token", "pos")
    body = cut(body, "vocab")
    out = body
    if special:
        head = spark.createDataFrame([(i, t, -1) for i, t in enumerate(special)], "id bigint, token string, pos int")
        out = head.unionByName(out)
    if add_columns:
        base = len(special) + body.count()
        tail = [(base + i, kind_token(p), -1) for i, p in enumerate(processed)]
        out = out.unionByName(spark.createDataFrame(tail, "id bigint, token string, pos int"))
    return out


def encode_ids(
    tokens: DataFrame, vocab: DataFrame, key: str, n_columns: int, mask_rate: float = 0.0, seed=0,
    bos: bool = True, eos: bool = True,
) -> DataFrame:
    """(key, input_ids): one lookup join per position, so rows are not shuffled when the vocabulary is small."""
    out = tokens
    ids = []
    for i in range(n_columns):
        slot = vocab.where(F.col("pos") == i).select(F.col("token").alias(f"_t{i}"), F.col("id").alias(f"_i{i}"))
        out = out.join(slot, F.get("tokens", i) == F.col(f"_t{i}"), "left").drop(f"_t{i}")
        token_id = F.coalesce(F.col(f"_i{i}"), F.lit(special_id("[UNK]")))
        if mask_rate > 0:
            token_id = F.when(fraction(f"{seed}-mask-{i}", key) < mask_rate, special_id("[RMASK]")).otherwise(token_id)
        ids.append(token_id.cast("bigint"))
    ends = ([F.lit(special_id("[BOS]")).cast("bigint")] if bos else [], [F.lit(special_id("[EOS]")).cast("bigint")] if eos else [])
    return out.select(key, F.array(*ends[0], *ids, *ends[1]).alias("input_ids"))


def relational_ids(
    parents: DataFrame, children: DataFrame, key: str, child_order: str, row_len: int, max_len: int
) -> tuple[DataFrame, DataFrame]:
    """(key, input_ids, labels) and the number of parents dropped as too long.

    Child rows are wrapped in member marks, the whole in begin and end marks.
    Children are counted before any list is built, so a list never exceeds ``max_len``.
    """
    size = F.coalesce("_n", F.lit(0)) * (row_len + 2) + 2
    counts = children.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    sized = parents.join(counts, key, "left").withColumn("_fits", size <= max_len)
    dropped = sized.agg(F.sum((~F.col("_fits")).cast("bigint")).alias("dropped"), F.count(F.lit(1)).alias("total"))
    kept = sized.where("_fits").select(key, F.col("input_ids").alias("_in"))
    lists = children.join(kept.select(key), key, "left_semi").groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(child_order, "input_ids"))).alias("_rows"))
    mark = lambda t: F.array(F.lit(special_id(t)).cast("bigint"))
    body = F.flatten(F.transform("_rows", lambda r: F.concat(mark("[BMEM]"), r["input_ids"], mark("[EMEM]"))))
    out = kept.join(lists, key, "left").select(
        key, F.col("_in").alias("input_ids"),
        F.concat(mark("[BOS]"), F.coalesce(body, F.array().cast("array<bigint>")), mark("[EOS]")).alias("labels"))
    return out, dropped


def fill_unknown(ids: DataFrame, key: str, batch: str | None = None) -> DataFrame:
    """Replace unknown ids by the most frequent id at their position (of the batch); the smallest id on a tie."""
    by = [batch] if batch else []
    long = ids.select(*by, F.posexplode("input_ids").alias("pos", "id"))
    counts = long.groupBy(*by, "pos", "id").agg(F.count(F.lit(1)).alias("n"))
    modes = counts.groupBy(*by, "pos").agg(F.min_by("id", F.struct(-F.col("n"), F.col("id"))).alias("m"))
    lists = modes.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("_modes"))  # one entry per position
    lists = lists.select(*by, F.transform("_modes", lambda s: s["m"]).alias("_modes"))
    joined = ids.join(lists, by) if by else ids.withColumn(
        "_modes", F.array(*[F.lit(v).cast("bigint") for v in lists.first()["_modes"]]))
    unk = special_id("[UNK]")
    filled = F.zip_with("input_ids", F.slice("_modes", F.lit(1), F.size("input_ids")), lambda i, m: F.when(i == unk, m).otherwise(i))
    return joined.select(*[c for c in ids.columns if c != "input_ids"], filled.alias("input_ids"))


# ---- decoding ---------------------------------------------------------------------------

def ids_to_tokens(ids: DataFrame, vocab: DataFrame, key: str, col: str = "input_ids") -> DataFrame:
    """(key, tokens): the token of every id; an id that the vocabulary lacks is an unknown token, so no position shifts."""
    long = ids.select(key, F.posexplode(col).alias("_p", "id"))
    rows = long.join(vocab.select("id", "token"), "id", "left").withColumn("token", F.coalesce("token", F.lit("[UNK]")))
    # the list of a row is as long as its sequence
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_p", "token"))).alias("_t"))
    return lists.select(key, F.transform("_t", lambda s: s["token"]).alias("tokens"))


def split_members(tokens: DataFrame, key: str, col_size: int) -> DataFrame:
    """(key, member, tokens): rows of a multi-row sequence; members of a wrong width are left out."""
    state = F.struct(
        F.array().cast("array<string>").alias("cur"),
        F.array().cast("array<array<string>>").alias("done"),
        F.lit(0).alias("at"),
        F.lit(False).alias("stop"),
    )

    def step(s, t):
        closing = t.isin("[BMEM]", "[EOS]")
        full = closing & (F.size(s["cur"]) == col_size)
        plain = ~t.isin("[BMEM]", "[EOS]", "[BOS]", "[EMEM]", "[PAD]")
        nxt = F.struct(
            F.when(closing, F.array().cast("array<string>")).when(plain, F.concat(s["cur"], F.array(t))).otherwise(s["cur"]).alias("cur"),
            F.when(full, F.concat(s["done"], F.array(s["cur"]))).otherwise(s["done"]).alias("done"),
            (s["at"] + 1).alias("at"),
            ((t == "[PAD]") | ((t == "[EOS]") & (s["at"] > 0))).alias("stop"),
        )
        return F.when(s["stop"], s).otherwise(nxt)

    done = F.aggregate("tokens", state, step)["done"]
    return tokens.select(key, F.posexplode(done).alias("member", "tokens"))


def join_digits(raw: Column, codec: ColumnCodec) -> Column:
    """Joined parts to a number text: leading zeros gone, surplus decimal points removed."""
    text = F.regexp_replace(raw, "^0+", "")
    text = F.when(text == "", "0").otherwise(text)
    if codec.kind == DATETIME:
        # only a leading sign may stay: offsets before the mean date are negative
        return F.nullif(F.regexp_replace(text, r"[^0-9\-]|(?<=.)-", ""), F.lit(""))
    point = F.lit(".")
    later = lambda t: F.concat(F.substring_index(t, ".", 1), point, F.replace(F.substr(t, F.instr(t, point) + 1), point, F.lit("")))
    # one element of an array, so that the text is not written out again at each use
    return F.get(F.transform(F.array(text), lambda t: F.when(F.instr(t, point) == 0, t).otherwise(later(t))), 0)


def decode_rows(tokens: DataFrame, codec: TableCodec, keys: Sequence[str], offset: int = 1) -> DataFrame:
    """Token rows back to typed columns in their original order; rows with invalid numbers are dropped.

    A leading placeholder is a missing value where the column had missing values
    in training; a later one, or any other non-numeric character, makes the row
    invalid.
    """
    at = {p: F.get("tokens", i + offset) for i, p in enumerate(codec.processed)}
    types = dict(codec.dtypes)
    # the copied target is not a column of the table
    used = [c for c in codec.columns if c.name.split(SEP, 2)[2] == c.column]
    raws = tokens.select(*keys, *[
        F.concat(*[unnamed(at[p]) for p in c.parts(codec.nparts)]).alias(f"_raw_{c.column}") for c in used])
    texts, valid = [], F.lit(True)
    for c in used:
        raw = F.col(f"_raw_{c.column}")
        if c.kind == CATEGORICAL:
            texts.append((F.nullif(raw, F.lit(NA_TEXT)) if c.has_missing else raw).alias(c.column))
            continue
        absent = raw.startswith(NA_PART) if c.has_missing else F.lit(False)
        texts.append(F.when(~absent, join_digits(raw, c)).alias(c.column))
        if c.kind == NUMERIC:
            valid = valid & (absent | ~F.coalesce(raw.rlike(NOT_NUMERIC), F.lit(True)))
    texts = raws.select(*keys, *texts, valid.alias("_ok"))
    cols = []
    for c in used:
        text = F.col(c.column)
        if c.kind == DATETIME:
            cols.append(F.timestamp_seconds(text.try_cast("bigint") + c.mean_date).cast(types[c.column]).alias(c.column))
        else:
            cols.append(text.try_cast(types[c.column]).alias(c.column))
    ok = F.col("_ok")
    for c in used:
        if c.kind == NUMERIC:  # a text such as "1-2" does not read as a number
            ok = ok & (F.col(c.column).isNull() | F.col(c.column).try_cast("double").isNotNull())
    # one struct per valid row: a filter here would repeat all expressions below it
    return texts.select(F.inline(F.when(ok, F.array(F.struct(*keys, *cols)))))


def pad_labels(df: DataFrame, col: str = "labels", multiple: int | None = None) -> DataFrame:
    """Labels lengthened to the longest of the table (or its next multiple) with the ignore value."""
    longest = df.agg(F.max(F.size(col))).first()[0] or 0
    if multiple:
        longest = -(-longest // multiple) * multiple
    filler = F.array_repeat(F.lit(LABEL_PAD).cast("bigint"), (F.lit(longest) - F.size(col)).cast("int"))
    return df.withColumn(col, F.concat(col, filler))


def mean_predictions(df: DataFrame, input_id: str, value: str, positive=None) -> DataFrame:
    """Mean of repeated predictions, or the share of the positive value."""
    score = (F.col(value) == F.lit(positive)).cast("double") if positive is not None else F.col(value)
    return df.groupBy(input_id).agg(F.avg(score).alias("prediction"))
