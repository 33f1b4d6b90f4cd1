import hashlib
import io
import zipfile

import pytest

from tracekit.llm import zipwarc
from tracekit.session import cut, scratch_path


def _read_back(spark, pages):
    plan = zipwarc.plan_records(pages)
    manifest = cut(zipwarc.write_archives(plan, scratch_path(spark, "archives")), "manifest")
    return zipwarc.read_records(zipwarc.locate_records(manifest)), manifest


def test_round_trip_with_odd_rows(spark):
    long = "ß" * 60
    pages = spark.createDataFrame(
        [(5, "http://a/", long, 1), (3, "http://b/\r\nX: y", long, 2), (3, "http://b/2", long, 3), (9, None, long, 4), (None, "http://n/", long, 5),
         (7, "u", None, 6), (8, "u", "", 7), (10, "u", "short", 8), (11, "u", "short", 9), (12, "u", "x" * 300_000, 10), (None, "u", "lonely" * 40, 11)],
        "page_id long, url string, html string, payload long")
    rows, _ = _read_back(spark, pages)
    got = sorted((r.page_id or -1, r.record_type, r.refers_to or -1, r.payload_bytes, r.payload_digest) for r in rows.collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted([(5, "revisit", 3, 120, sha(long)), (3, "response", -1, 120, sha(long)), (3, "response", -1, 120, sha(long)), (9, "revisit", 3, 120, sha(long)),
                   (-1, "revisit", 3, 120, sha(long)), (7, "response", -1, 0, sha("")), (8, "response", -1, 0, sha("")), (10, "response", -1, 5, sha("short")),
                   (11, "response", -1, 5, sha("short")), (12, "response", -1, 300_000, sha("x" * 300_000)), (-1, "response", -1, 240, sha("lonely" * 40))])
    assert got == want
    assert {r.page_id: r.payload for r in rows.where("record_type = 'response'").collect()}[12] == b"x" * 300_000


def test_empty_table(spark):
    rows, manifest = _read_back(spark, spark.createDataFrame([], "page_id long, url string, html string"))
    assert manifest.count() == 0 and rows.count() == 0


class _File:
    def __init__(self, data):
        self.data, self.at = data, 0

    def size(self):
        return len(self.data)

    def seek(self, n):
        self.at = n

    def read(self, n):
        self.at += n
        return self.data[self.at - n : self.at]


@pytest.mark.parametrize("limit", [zipfile.ZIP64_LIMIT, 3])
def test_directories_of_plain_and_zip64_archives(monkeypatch, limit):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1 if limit == 3 else 65535)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        z.writestr(zipwarc.DATA, b"first member")
        z.writestr("größe.txt", b"PK\5\6 looks like an end")
        z.comment = b"PK\5\6" + b"c" * 30
    file = _File(b"leading bytes are not allowed here"[:0] + out.getvalue())
    assert (b"PK\6\6" in file.data) == (limit == 3)
    reader = zipwarc.ZipReader(file)
    members = reader.members()
    assert list(members) == [zipwarc.DATA, "größe.txt"]
    assert reader.at(reader.start(members[zipwarc.DATA]), members[zipwarc.DATA].size) == b"first member"
    assert reader.at(reader.start(members["größe.txt"]), members["größe.txt"].size) == b"PK\5\6 looks like an end"


def test_broken_and_compressed_archives_are_errors():
    with pytest.raises(ValueError):
        zipwarc.ZipReader(_File(b"no archive")).members()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"x" * 1000)
    reader = zipwarc.ZipReader(_File(out.getvalue()))
    with pytest.raises(ValueError):
        reader.start(reader.members()["a"])
