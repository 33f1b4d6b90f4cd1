"""Captures read in byte ranges give what one walk through the file gives."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracekit.sources import captures


def packet(i, payload):
    ip = bytes([0x45, 0]) + struct.pack(">HHH", 20 + len(payload), i % 65536, 0) + bytes([64, 1, 0, 0, 10, 0, 0, 1, 10, 0, 0, 2])
    return b"\0" * 12 + b"\x08\x00" + ip + payload


def capture(payloads, order="<", magic=0xA1B2C3D4, cut_off=0):
    body = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    for i, p in enumerate(payloads):
        p = packet(i, p)
        body += struct.pack(order + "IIII", 100 + i, i % 1000, len(p), len(p)) + p
    return body[: len(body) - cut_off]


def payloads(kind, n=60):
    rng = np.random.default_rng(3)
    if kind == "nested":  # packets that carry chains of records: every guess inside one is wrong
        inner = b"".join(struct.pack("<IIII", 7, 7, 4, 4) + b"abcd" for _ in range(30))
        return [inner if i % 3 else b"" for i in range(n)]
    if kind == "zeros":
        return [b"\0" * int(k) for k in rng.integers(0, 90, n)]
    if kind == "long":  # records longer than several ranges
        return [bytes(rng.integers(0, 256, 3000 if i % 7 == 3 else 9, dtype=np.uint8)) for i in range(n)]
    return [bytes(rng.integers(0, 256, int(k), dtype=np.uint8)) for k in rng.integers(0, 90, n)]


def rows(df):
    return sorted(tuple(r) for r in df.withColumn("path", F.element_at(F.split("path", "/"), -1)).collect())


@pytest.mark.parametrize("size", [700, 1 << 20])
def test_ranges_of_any_size_give_the_packets_of_one_walk(spark, tmp_path, size):
    for kind in ("plain", "nested", "zeros", "long"):
        (tmp_path / f"{kind}.pcap").write_bytes(capture(payloads(kind)))
    (tmp_path / "big.pcap").write_bytes(capture(payloads("plain"), ">"))
    (tmp_path / "nano.pcap").write_bytes(capture(payloads("plain"), "<", 0xA1B23C4D))
    (tmp_path / "short.pcap").write_bytes(capture(payloads("plain"), cut_off=5))
    (tmp_path / "empty.pcap").write_bytes(capture([]))
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    assert rows(captures.read_captures(spark, str(tmp_path), size)) == rows(captures.parse_captures(files))


def test_every_cut_point_gives_the_same_walk():
    """Both halves of a cut at any byte: the second half's start, guessed or due, is where the first half ends."""
    for kind in ("plain", "zeros", "long"):
        body = capture(payloads(kind, 20))
        c = captures._Capture("x", len(body), body)
        whole = c.walk(24, len(body))
        for at in range(25, len(body)):
            end, n = c.walk(24, at)
            assert c.walk(end, len(body)) == (whole[0], whole[1] - n)


def test_guesses_are_mostly_right():
    body = capture(payloads("plain", 200))
    c = captures._Capture("x", len(body), body)
    places = range(25, len(body) - 1500, 11)
    assert sum(c.guess(at, len(body)) == c.walk(24, at)[0] for at in places) > 0.95 * len(places)  # 98 % here; the rest is walked again


def test_no_files_no_rows_and_wrong_files_are_named(spark, tmp_path):
    (tmp_path / "note.txt").write_text("x")
    assert captures.read_captures(spark, str(tmp_path)).count() == 0
    (tmp_path / "bad.pcap").write_bytes(b"not a capture, but long enough")
    with pytest.raises(Exception, match="bad.pcap is not a capture file"):
        captures.read_captures(spark, str(tmp_path)).count()
