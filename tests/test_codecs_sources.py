import struct

import pytest
from pyspark.sql import functions as F

from tracekit.functions import codecs as C
from tracekit.operators.clean import RowValidator, impute_ffill, in_polygon, in_range
from tracekit.operators.reshape import pivot_signals
from tracekit.sources import captures, results, tables, traces


def test_signal_log_last_line_wins(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '{"name":"speed","value":1.5,"timestamp":10.0}\n{"name":"brake","value":true,"timestamp":10.0}\n'
        '{"name":"speed","value":2.5,"timestamp":10.0}\n{"name":"gear","value":"first","timestamp":11.0}\n')
    wide = pivot_signals(traces.read_signal_log(spark, str(tmp_path)), ["speed", "brake"], "seq")
    rows = {r["timestamp"]: (r["speed"], r["brake"]) for r in wide.collect()}
    assert rows == {10.0: ("2.5", "true"), 11.0: (None, None)}


def test_frame_readers_agree(spark, tmp_path):
    (tmp_path / "log.txt").write_text("Timestamp:          0.690329        ID: 0153    000    DLC: 3    b6 40 0f\n\n"
                                      "Timestamp:          0.7        ID: 07ff    000    DLC: 0\n")
    (tmp_path / "log.csv").write_text("0.690329,0153,3,b6,40,0f,R\n0.7,07ff,0\nbroken,line,9,1\n")
    (tmp_path / "log.dump").write_text("(0.690329) slcan0 153#b6400f\n(0.7) slcan0 7ff#\n")
    (tmp_path / "log2.csv").write_text("Timestamp,Arbitration_ID,DLC,Data,Class\n0.690329,0153,3,b6 40 0f,Normal\n0.7,07ff,0,,Attack\n")
    want = [(0.690329, 3, ["b6", "40", "0f"]), (0.7, 0, [])]
    cells = lambda d: [(r.ts, r.dlc, r.data) for r in d.orderBy("ts").collect()]
    assert cells(traces.read_frame_log(spark, str(tmp_path / "log.txt"))) == want
    good, bad = traces.read_ragged_frames(spark, str(tmp_path / "log.csv"))
    assert cells(good) == want
    assert [r.label for r in good.orderBy("ts").collect()] == ["R", None]
    assert [r.value for r in bad.collect()] == ["broken,line,9,1"]
    with pytest.raises(ValueError):
        traces.read_ragged_frames(spark, str(tmp_path / "log.csv"), strict=True)
    assert cells(traces.read_candump(spark, str(tmp_path / "log.dump"))) == want
    assert cells(traces.read_classed_frames(spark, str(tmp_path / "log2.csv"))) == want
    aligned = traces.align_frames(good).orderBy("Timestamp").collect()
    assert (aligned[0]["DATA_2"], aligned[0]["DATA_3"]) == ("0f", None)


def test_bits_round_trip(spark):
    rows = [("0545", ["d8", "00", "ff"]), ("07ff", []), ("0001", ["00"] * 8)]
    df = spark.createDataFrame(rows, "can_id string, data array<string>")
    out = df.select(
        "can_id", "data", C.can_id_bits("can_id").alias("i"), C.payload_bits("data").alias("b"), F.size("data").alias("n"))
    out = out.select("*", C.bits_to_can_id("i").alias("id2"), C.bits_to_payload("b", "n").alias("d2"))
    for r in out.collect():
        assert r.id2 == r.can_id and len(r.i) == 11 and len(r.b) == 64
        assert [x for x in r.d2 if x != ""] == r.data
        assert sum(x is None for x in r.b) == 64 - 8 * len(r.data)


def test_hex_wider_than_asked_keeps_its_bits(spark):
    r = spark.range(1).select(C.hex_to_bits(F.lit("3ff"), 4).alias("a"), C.hex_to_bits(F.lit("f" * 16), 64).alias("b")).first()
    assert r.a == "1" * 10 and r.b == "1" * 64


def test_small_codecs(spark):
    r = spark.range(1).select(
        C.ip_to_long(F.lit("10.0.0.255")).alias("ip"), C.long_to_ip(F.lit(3232235777)).alias("text"),
        C.proto_to_int(F.lit(" tcp ")).alias("p"), C.proto_to_str(F.lit(41)).alias("s"),
        C.encode_bits(F.lit(5), 4).alias("e"), C.map_labels(F.lit("X"), {"R": 0}).alias("m"),
        C.extract_typed(F.lit("id=42;"), r"id=(\d+)", "int").alias("x"),
        C.hard_one_hot(F.array(*[F.lit(v) for v in (0.1, 0.7, 0.7, 3.0)]), [(0, 3), (3, 1)]).alias("h")).first()
    assert (r.ip, r.text, r.p, r.s, r.m, r.x) == (167772415, "192.168.1.1", 6, "IPv6", None, 42)
    assert r.e == [1, 0, 0, 1, 1, 0, 0, 1]
    assert r.h == [0, 1, 1, 1]


def test_capture_file(spark, tmp_path):
    ip = bytes([0x45, 7]) + struct.pack(">HHH", 60, 99, (2 << 13) | 5) + bytes([64, 6]) + struct.pack(">H", 4321)
    ip += bytes([10, 0, 0, 1, 10, 0, 0, 2])
    tcp = struct.pack(">HH", 1234, 80) + b"\0" * 16
    plain = b"\0" * 12 + b"\x08\x00" + ip + tcp
    vlan = b"\0" * 12 + b"\x81\x00\x00\x05\x08\x00" + ip + tcp
    arp = b"\0" * 12 + b"\x08\x06" + b"\0" * 28
    body = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for i, p in enumerate((plain, vlan, arp)):
        body += struct.pack("<IIII", 100 + i, 7, len(p), len(p)) + p
    (tmp_path / "x.pcap").write_bytes(body)
    rows = captures.read_captures(spark, str(tmp_path)).orderBy("seq").collect()
    assert len(rows) == 2
    for i, r in enumerate(rows):
        assert (r.srcip, r.dstip, r.srcport, r.dstport, r.proto) == (167772161, 167772162, 1234, 80, "TCP")
        assert (r.time, r.pkt_len, r.version, r.ihl, r.tos, r.id, r.flag, r.off, r.ttl, r.chksum) == (
            (100 + i) * 1_000_000 + 7, 60, 4, 5, 7, 99, 2, 5, 64, 4321)


def test_typed_table_round_trip(spark, tmp_path):
    (tmp_path / "t.txt").write_text("39 Private 1.5\n50 Self 2.0\n")
    (tmp_path / "t.meta").write_text("C 17.0 90.0\nD {Private Self}\nC 0 3\n")
    df, meta = tables.read_typed_tsv(spark, str(tmp_path / "t.txt"), str(tmp_path / "t.meta"))
    assert [tuple(r) for r in df.orderBy("c0").collect()] == [(39.0, 0, 1.5), (50.0, 1, 2.0)]
    tables.write_typed_tsv(df, meta, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["39.0 Private 1.5", "50.0 Self 2.0"]


def test_fill_drops_leading_rows_and_keeps_flags_aligned(spark):
    rows = [(1, None, 1.0), (2, 5.0, None), (3, None, None), (4, 7.0, 2.0)]
    df = spark.createDataFrame(rows, "t int, a double, b double")
    filled, removed = impute_ffill(df, ["t"], ["a", "b"], buckets=3)
    got = [(r.t, r.a, r.b, r.was_missing) for r in filled.orderBy("t").collect()]
    assert got == [(2, 5.0, 1.0, [0, 1]), (3, 5.0, 1.0, [1, 1]), (4, 7.0, 2.0, [0, 0])]
    assert tuple(removed.first()) == (1, 4)


def test_polygon_boundary_is_outside(spark):
    pts = spark.createDataFrame([(1.0, 1.0), (0.0, 1.0), (2.0, 2.0), (3.0, 1.0)], "x double, y double")
    ring = [[(0, 0), (2, 0), (2, 2), (0, 2)]]
    assert [r[0] for r in pts.select(in_polygon("x", "y", ring)).collect()] == [True, False, False, False]


def test_validator_accepts_a_pandas_udf(spark):
    @F.pandas_udf("boolean")
    def even(s):
        return s % 2 == 0

    v = RowValidator().add("even", even, ["id"]).add("range", lambda c: in_range(c, 2, 6), ["id"])
    df = spark.range(10)
    assert sorted(r.id for r in v.apply(df).collect()) == [2, 4, 6]
    assert {r.rule: r.rejected for r in v.report(df).collect()} == {"even": 5, "range": 5, "*": 7}
    assert v.remove("even").apply(df).count() == 5


def test_codecs_accept_a_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("(1.5) slcan0 12A#00F0\n")
    stream = traces.to_bits(traces.parse_candump(spark.readStream.text(str(src))))
    q = stream.writeStream.format("memory").queryName("frames_out").trigger(availableNow=True).start()
    q.awaitTermination(60)
    r = spark.sql("select * from frames_out").first()
    assert r.dlc == 2 and r.data_bits[8:16] == [1, 1, 1, 1, 0, 0, 0, 0]


def test_missing_results_are_dashes(spark):
    doc = '{"synthetic":{"test":{"f1-mean":0.5,"r2-mean":0.25}}}'
    df = spark.createDataFrame([("shells", "over", doc)], "dataset string, experiment string, value string")
    t = results.result_table(results.explode_documents(df, ["dataset", "experiment"]),
                             {"smooth": ("over", "synthetic"), "real": ("over", "real")}, ["shells", "census"], ["shells"])
    assert {r.method: (r.shells, r.census) for r in t.collect()} == {"smooth": ("0.2500", "--"), "real": ("--", "--")}
