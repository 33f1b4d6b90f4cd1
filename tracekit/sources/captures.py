"""Packet captures to a packet table.

A capture is a chain of length-prefixed records without marks between them. Files are read in byte ranges by many
tasks all the same: each range looks for a place from which a chain of plausible record headers starts and walks the
headers from there to its end. The first range of a file starts for certain, and each walk ends where the next range
must start, so wrong guesses show and are walked again from the right place: the packets are those of one walk through
the file, whatever the ranges. The packet bytes are then decoded by native expressions.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracekit.functions.codecs import proto_to_str
from tracekit.session import cut

# The four magic numbers of a capture file as (byte order, fraction to microseconds).
MAGIC = {
    b"\xd4\xc3\xb2\xa1": ("<", 1),
    b"\xa1\xb2\xc3\xd4": (">", 1),
    b"\x4d\x3c\xb2\xa1": ("<", 1000),
    b"\xa1\xb2\x3c\x4d": (">", 1000),
}
ETHERNET = 1  # link type with a 14-byte header; other link types start with the IP header
FRAMED = "path string, seq bigint, link int, time bigint, packet binary"
RANGED = "path string, size bigint, lo bigint, hi bigint, start bigint, end bigint, records bigint"
SETTLED = RANGED + ", seq bigint"
RANGE_BYTES = 64 << 20
MAX_RANGES = 100_000  # tasks; more ranges share them
_CHUNK, _CHUNK_BYTES = 20_000, 8 << 20
_FILE_HEADER, _RECORD_HEADER = 24, 16
_CHAIN = 8  # plausible headers in a row that make a start
_MOST_BYTES = 262_144  # longest packet a guess believes in; a walk takes any length
_BLOCK = 1 << 20


def _columns(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["path", "seq", "link", "time", "packet"])


class _Capture:
    """Random access to one capture, a block at a time."""

    def __init__(self, path: str, size: int, content: bytes | None = None):
        self.path, self.size, self.at, self.block, self.stream = path, size, 0, content or b"", None
        if content is None:
            store, inner = fs.FileSystem.from_uri(path if "://" in path else path.replace(":/", ":///", 1))
            self.stream = store.open_input_file(inner)
        head = self.take(0, _FILE_HEADER)
        if len(head) < _FILE_HEADER or head[:4] not in MAGIC:
            self.close()
            raise ValueError(f"{path} is not a capture file")
        self.order, self.divisor = MAGIC[head[:4]]
        self.link = struct.unpack_from(self.order + "I", head, 20)[0]
        self.header = struct.Struct(self.order + "IIII")

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()

    def take(self, at: int, n: int) -> bytes:
        """Bytes [at, at + n), fewer at the end of the file."""
        if self.stream is not None and not self.at <= at <= at + n <= self.at + len(self.block):
            self.stream.seek(at)
            self.at, self.block = at, self.stream.read(max(n, _BLOCK))
        return self.block[at - self.at : at - self.at + n]

    def plausible(self, fields) -> bool:
        _, frac, length, wire = fields
        return (frac < 1_000_000 * self.divisor) & (length > 0) & (length <= wire) & (length <= _MOST_BYTES)

    def chained(self, at: int) -> bool:
        for _ in range(_CHAIN):
            if at == self.size:
                return True
            if at + _RECORD_HEADER > self.size:
                return False
            fields = self.header.unpack(self.take(at, _RECORD_HEADER))
            if not self.plausible(fields):
                return False
            at += _RECORD_HEADER + fields[2]
        return True

    def guess(self, lo: int, hi: int) -> int | None:
        """The first place in [lo, hi) from which a chain starts."""
        for base in range(lo, hi, _BLOCK):
            data = self.take(base, min(_BLOCK, hi - base) + _RECORD_HEADER - 1)
            places = len(data) - _RECORD_HEADER + 1
            if places <= 0:
                return None
            data = np.frombuffer(data, np.uint8).astype(np.int64)
            shifts = (0, 8, 16, 24) if self.order == "<" else (24, 16, 8, 0)
            word = lambda k: sum(data[k + i : k + i + places] << s for i, s in enumerate(shifts))
            for at in np.flatnonzero(self.plausible([word(k) for k in (0, 4, 8, 12)])).tolist():
                if self.chained(base + at):
                    return base + at
        return None

    def walk(self, start: int, hi: int) -> tuple[int, int]:
        """(where the first record at or behind ``hi`` starts, records before it)."""
        at, n = start, 0
        while at < hi and at + _RECORD_HEADER <= self.size:
            at += _RECORD_HEADER + self.header.unpack(self.take(at, _RECORD_HEADER))[2]
            n += 1
        return at, n

    def frames(self, start: int, hi: int, seq: int) -> Iterator[pd.DataFrame]:
        rows, held, at = [], 0, start
        while at < hi and at + _RECORD_HEADER <= self.size:
            sec, frac, length, _ = self.header.unpack(self.take(at, _RECORD_HEADER))
            packet = self.take(at + _RECORD_HEADER, min(length, self.size - at - _RECORD_HEADER))
            rows.append((self.path, seq, self.link, sec * 1_000_000 + frac // self.divisor, packet))
            at, seq, held = at + _RECORD_HEADER + length, seq + 1, held + len(packet)
            if len(rows) == _CHUNK or held >= _CHUNK_BYTES:
                yield _columns(rows)
                rows, held = [], 0
        yield _columns(rows)


def _frame(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            yield from _Capture(path, len(content), content).frames(_FILE_HEADER, len(content), 0)


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First record, its guess where the range is not the first, and records of each range by itself."""
    for batch in batches:
        out = []
        for r in batch.itertuples():
            capture = _Capture(r.path, r.size)
            try:
                start = capture.guess(r.lo, r.hi) if r.lo else _FILE_HEADER
                end, n = (None, 0) if start is None else capture.walk(start, r.hi)
            finally:
                capture.close()
            out.append((r.path, r.size, r.lo, r.hi, start, end, n))
        table = pd.DataFrame(out, columns=["path", "size", "lo", "hi", "start", "end", "records"])
        yield table.astype({"start": "Int64", "end": "Int64"})


def _settle(ranges: pd.DataFrame) -> pd.DataFrame:
    """One file's ranges in order: those that do not start where the walk before them ended are walked again."""
    ranges = ranges.sort_values("lo").reset_index(drop=True)
    capture, due, seq, out = None, _FILE_HEADER, 0, []
    try:
        for r in ranges.itertuples():
            end, n = r.end, r.records
            if pd.isna(r.start) or r.start != due:
                capture = capture or _Capture(r.path, r.size)
                end, n = capture.walk(due, r.hi)
            out.append((due, int(end), n, seq))
            due, seq = int(end), seq + n
    finally:
        if capture is not None:
            capture.close()
    ranges[["start", "end", "records", "seq"]] = np.array(out, dtype=np.int64)
    return ranges


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for r in batch.itertuples():
            capture = _Capture(r.path, r.size)
            try:
                yield from capture.frames(r.start, r.hi, r.seq)
            finally:
                capture.close()


def index_captures(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Ranges of the files (path, size): where their first record starts, its number, and how many there are.

    A record belongs to the range that holds its first byte. What meets in one task to be settled is a row per range of
    one file; it reads only those ranges whose guess was wrong.
    """
    listed = files.select("path", F.col("size").cast("bigint").alias("size"))
    ranges = cut(listed.select("path", "size", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0).cast("bigint")), F.lit(range_bytes).cast("bigint"),
    )).alias("lo")), "ranges")
    ranges = ranges.withColumn("hi", F.least(F.col("lo") + range_bytes, "size"))
    walked = _spread(ranges).mapInPandas(_walk, RANGED)
    return walked.groupBy("path").applyInPandas(_settle, SETTLED)


def _spread(ranges: DataFrame) -> DataFrame:
    """A task per range; adaptive execution would put these small rows into one."""
    return ranges.repartition(min(max(ranges.count(), 1), MAX_RANGES))


def parse_captures(files: DataFrame) -> DataFrame:
    """(path, content) rows to one row per IPv4 packet; ports are 0 unless TCP or UDP. One task frames one content."""
    return _packets(files.select("path", "content").mapInPandas(_frame, FRAMED))


def _packets(framed: DataFrame) -> DataFrame:

    def number(start: Column, size: int) -> Column:
        return F.conv(F.hex(F.substring(F.col("packet"), start + 1, F.lit(size))), 16, 10).cast("bigint")

    ether = number(F.lit(12), 2)
    is_vlan = ether == 0x8100
    start = (
        F.when(F.col("link") != ETHERNET, 0)
        .when(ether == 0x0800, 14)
        .when(is_vlan & (number(F.lit(16), 2) == 0x0800), 18)
    )
    ip = framed.withColumn("_s", start).where(F.col("_s").isNotNull() & (F.length("packet") >= F.col("_s") + 20))
    s = F.col("_s")
    at = lambda offset, size: number(s + offset, size)
    first = at(0, 1)
    ip = ip.withColumns({"_p": at(9, 1), "ihl": first.bitwiseAND(F.lit(15)).cast("int")})
    has_ports = F.col("_p").isin(6, 17)
    port = lambda offset: F.coalesce(
        F.when(has_ports, number(s + F.col("ihl") * 4 + offset, 2)), F.lit(0)
    ).cast("int")
    off = at(6, 2)
    return ip.select(
        "path",
        "seq",
        at(12, 4).alias("srcip"),
        at(16, 4).alias("dstip"),
        port(0).alias("srcport"),
        port(2).alias("dstport"),
        F.coalesce(proto_to_str("_p"), F.col("_p").cast("string")).alias("proto"),
        "time",
        at(2, 2).cast("int").alias("pkt_len"),
        F.shiftright(first, 4).cast("int").alias("version"),
        "ihl",
        at(1, 1).cast("int").alias("tos"),
        at(4, 2).cast("int").alias("id"),
        F.shiftright(off, 13).cast("int").alias("flag"),
        off.bitwiseAND(F.lit(0x1FFF)).cast("int").alias("off"),
        at(8, 1).cast("int").alias("ttl"),
        at(10, 2).cast("int").alias("chksum"),
    )


def read_captures(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All captures of a folder, of any size, one task per byte range.

    Headers are walked once for the index, which is written, and once for the packets. Files are opened through
    ``pyarrow.fs`` by the URI that Spark lists, so every executor must reach them. A folder without captures gives no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pcap").load(folder)
    index = cut(index_captures(files.select("path", F.col("length").alias("size")), range_bytes), "capture_ranges")
    held = index.where("records > 0").select("path", "size", "hi", "start", "seq")
    return _packets(_spread(held).mapInPandas(_read, FRAMED))
