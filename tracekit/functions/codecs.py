"""Row-local codecs for frames, addresses and labels; all native expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracekit.session import col

# Protocol numbers by name.
PROTOCOL_NUMBERS = {
    "ESP": 50,
    "GRE": 47,
    "ICMP": 1,
    "IPIP": 4,
    "IPv6": 41,
    "TCP": 6,
    "UDP": 17,
    "RSVP": 46,
    "Other": 255,
}


def hex_to_bits(c: Column | str, n: int) -> Column:
    """Zero-padded binary text; longer values keep all their bits."""
    bits = F.conv(col(c), 16, 2)
    return F.lpad(bits, F.greatest(F.lit(n), F.length(bits)), F.lit("0"))


def can_id_bits(c: Column | str, id_bits: int = 11) -> Column:
    """Identifier hex to an array of 0/1."""
    return F.split(hex_to_bits(c, id_bits), "").cast("array<int>")


def payload_bits(data: Column | str, width: int = 64) -> Column:
    """Up to eight hex bytes to ``width`` bits, null past the payload.

    The whole payload is converted at once: 16 hex digits fit the 64 bits of ``conv``.
    """
    data = col(data)
    text = F.array_join(F.transform(data, lambda b: F.lpad(b, 2, "0")), "")
    bits = F.lpad(F.conv(text, 16, 2), F.size(data) * 8, F.lit("0"))
    cells = F.when(F.size(data) > 0, F.split(bits, "").cast("array<int>")).otherwise(F.array().cast("array<int>"))
    missing = F.greatest(F.lit(width) - F.size(data) * 8, F.lit(0))
    return F.concat(cells, F.array_repeat(F.lit(None).cast("int"), missing))


def bits_to_can_id(bits: Column | str) -> Column:
    """Bits back to at least four lower-case hex digits."""
    text = F.lower(F.conv(F.array_join(col(bits), ""), 2, 16))
    return F.lpad(text, F.greatest(F.lit(4), F.length(text)), F.lit("0"))


def bits_to_payload(bits: Column | str, dlc: Column | str, n_bytes: int = 8) -> Column:
    """Bits back to hex bytes; the empty string past ``dlc``."""
    text = F.array_join(col(bits), "")

    def byte(i):
        digits = F.lower(F.lpad(F.conv(F.substring(text, i * 8 + 1, 8), 2, 16), 2, "0"))
        return F.when(F.lit(i) < col(dlc).cast("int"), digits).otherwise("")

    return F.array(*[byte(i) for i in range(n_bytes)])


def coerce_bits(c: Column | str) -> Column:
    """Generated bits come back as text or floats."""
    return col(c).cast("double").cast("int")


def map_labels(c: Column | str, mapping: Mapping) -> Column:
    """Lookup in a small fixed mapping; unmapped values become null."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), col(c))


def ip_to_long(c: Column | str) -> Column:
    parts = F.split(col(c), r"\.")
    return sum((F.get(parts, i).cast("bigint") * (1 << (24 - 8 * i)) for i in range(1, 4)),
               F.get(parts, 0).cast("bigint") * (1 << 24))


def long_to_ip(c: Column | str) -> Column:
    value = col(c).cast("bigint")
    return F.concat_ws(
        ".", *[F.shiftright(value, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    )


def proto_to_int(c: Column | str) -> Column:
    """Protocol name to number, case-insensitive; numeric text passes through."""
    upper = F.upper(F.trim(col(c)))
    named = map_labels(upper, {k.upper(): v for k, v in PROTOCOL_NUMBERS.items()})
    return F.coalesce(named, upper.try_cast("int"))


def proto_to_str(c: Column | str) -> Column:
    return map_labels(col(c).cast("int"), {v: k for k, v in PROTOCOL_NUMBERS.items()})


def encode_bits(c: Column | str, n: int) -> Column:
    """Integer to n one-hot pairs, most significant first: 0 -> [1,0], 1 -> [0,1]."""
    value = col(c).cast("bigint")
    bit = lambda i: F.shiftright(value, n - 1 - i).bitwiseAND(F.lit(1)).cast("double")
    return F.array(*[x for i in range(n) for x in (1.0 - bit(i), bit(i))])


def decode_bits(pairs: Column | str, n: int) -> Column:
    """A bit is 1 where the second of its pair is the larger."""
    arr = col(pairs)
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(n - 1)),
        F.lit(0).cast("bigint"),
        lambda acc, i: acc * 2 + F.when(F.get(arr, 2 * i + 1) > F.get(arr, 2 * i), 1).otherwise(0),
    )


def extract_typed(c: Column | str, regex: str, dtype: str) -> Column:
    """First capture group cast to a type; no match is null."""
    text = col(c).cast("string")
    return F.when(text.rlike(regex), F.regexp_extract(text, regex, 1)).try_cast(dtype)


def bit_columns(
    id_bits: Column | str, data_bits: Column | str, n_id: int = 11, n_data: int = 64
) -> tuple[list[Column], list[Column]]:
    """The wide columns of a bit table, expanded only where a sink needs them."""
    return (
        [F.get(col(id_bits), i).alias(f"CAN_ID_{i}") for i in range(n_id)],
        [F.get(col(data_bits), i).alias(f"DATA_{i}") for i in range(n_data)],
    )


def collect_bits(df: DataFrame, prefix: str, n: int, name: str) -> DataFrame:
    """Wide bit columns back to one array column."""
    names = [f"{prefix}_{i}" for i in range(n)]
    return df.withColumn(name, F.array(*[coerce_bits(c) for c in names])).drop(*names)


def hard_one_hot(c: Column | str, groups: Sequence[tuple[int, int]]) -> Column:
    """Per (start, width) group of an array: 1 where the maximum is, ties keep all."""
    arr = col(c)

    def one(start, width):
        part = F.slice(arr, start + 1, width)
        return F.transform(part, lambda v: (v >= F.array_max(part)).cast("double"))

    return F.concat(*[one(s, w) for s, w in groups])
