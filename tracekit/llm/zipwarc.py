"""WARC records in ZIP archives: written per partition, found through the archive's directories, read by range.

An archive holds stored (uncompressed) members: ``archive/data.warc.gz`` with one gzip stream per record,
``indexes/index.cdxj`` with one line per record, and ``datapackage.json``. Reading never extracts a member:
the end-of-directory records (ZIP64 ones too) lead to the central directory, that to the members, the index
to the byte range of every record. All files go through ``pyarrow.fs`` by URI, so the folder can be in any
store that all executors reach; a repeated task writes a new file and only finished tasks are listed.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Compressed bytes after which a writing task starts its next archive, and most bytes read at once.
ARCHIVE_BYTES, READ_BYTES = 256 << 20, 4 << 20
#: Payloads shorter than this are always written in full.
LEAST_REPEAT = 100
DATE = "2024-01-01T00:00:00Z"

MANIFEST = "archive string, records long, bytes long"
LOCATIONS = "archive string, offset long, length long, page_id long, start long"
RECORDS = ("page_id long, url string, record_type string, refers_to long, payload binary, "
           "payload_bytes long, payload_digest string, archive string, offset long")


def plan_records(pages: DataFrame, least: int = LEAST_REPEAT) -> DataFrame:
    """page_id, url, payload, payload_digest, payload_bytes, refers_to of every page.

    Among equal payloads of at least ``least`` bytes the row with the smallest page_id is written in full and
    the others refer to it. Rows that share that page_id are all written in full; a null page_id is
    never the smallest, and payloads under null page_ids only are all written in full. Null html is empty.
    Only digests are grouped; a payload that a third of the pages hold is one digest, and the join that
    follows is one that Spark can split.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    long_enough = F.col("payload_bytes") >= least
    firsts = (rows.where(long_enough).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
              .where("n > 1 and first is not null").drop("n"))
    refers = F.when(long_enough & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(firsts, "payload_digest", "left").withColumn("refers_to", refers).drop("first")


def _line(s: object) -> str:
    return "" if s is None else str(s).replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head and leaves the payload out."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{_line(page_id)}>",
             f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_line(url)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Sink:
    """What zipfile needs of a stream that cannot seek."""

    def __init__(self, stream):
        self.write, self.flush = stream.write, lambda: None


class _Archive:
    """One archive being written: the data member stays open until the archive is closed."""

    def __init__(self, folder: str):
        self.uri = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.zip"
        store, path = fs.FileSystem.from_uri(self.uri)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.stream = store.open_output_stream(path)
        self.zip = zipfile.ZipFile(_Sink(self.stream), "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(DATA, "w", force_zip64=True)
        self.lines, self.at = [], 0

    def add(self, page_id, url, record: bytes) -> None:
        pack = zlib.compressobj(4, zlib.DEFLATED, 31)
        packed = pack.compress(record) + pack.flush()
        self.data.write(packed)
        self.lines.append(json.dumps({"offset": self.at, "length": len(packed), "page_id": page_id, "url": url}))
        self.at += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        self.zip.writestr(INDEX, "".join(f"{DATE} {x}\n" for x in self.lines))
        self.zip.writestr("datapackage.json", json.dumps({"profile": "data-package", "resources": [{"path": DATA}, {"path": INDEX}]}))
        self.zip.close()
        self.stream.close()
        return self.uri, len(self.lines), self.at


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write planned records; one row per archive. Write the result before it is used twice.

    Empty partitions write nothing, so an empty table gives an empty manifest.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archive, done = None, []
        for batch in batches:
            columns = [batch[c].astype(object).where(batch[c].notna(), None) for c in ("page_id", "url", "payload", "payload_digest", "refers_to")]
            for page_id, url, payload, digest, refers_to in zip(*columns):
                archive = archive or _Archive(folder)
                page_id, refers_to = (None if x is None else int(x) for x in (page_id, refers_to))
                archive.add(page_id, url, record_bytes(page_id, url, bytes(payload), digest, refers_to))
                if archive.at >= ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        yield pd.DataFrame(done, columns=["archive", "records", "bytes"])

    return records.select("page_id", "url", "payload", "payload_digest", "refers_to").mapInPandas(run, MANIFEST)


@dataclass
class Member:
    name: str
    method: int
    size: int
    packed: int
    header: int


class ZipReader:
    """Directories of one archive, read by range from a random-access file."""

    def __init__(self, file):
        self.file, self.length = file, file.size()

    def at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        data = self.file.read(n)
        if len(data) != n:
            raise ValueError(f"archive ends within {n} bytes at {offset}")
        return data

    def directory(self) -> tuple[int, int, int]:
        """Entries, size and place of the central directory, by the last end record and its ZIP64 form."""
        n = min(self.length, 22 + 65535 + 20)
        tail, base = self.at(self.length - n, n), self.length - n
        k = tail.rfind(b"PK\5\6")
        while k >= 0 and (len(tail) - k < 22 or k + 22 + struct.unpack_from("<H", tail, k + 20)[0] != len(tail)):
            k = tail.rfind(b"PK\5\6", 0, k)
        if k < 0:
            raise ValueError("no end of a central directory")
        entries, size, place = struct.unpack_from("<HII", tail, k + 10)
        if k >= 20 and tail[k - 20 : k - 16] == b"PK\6\7":
            end64 = struct.unpack_from("<Q", tail, k - 12)[0]
            record = self.at(end64, 56)
            if record[:4] != b"PK\6\6":
                raise ValueError("the ZIP64 locator points elsewhere")
            entries, size, place = struct.unpack_from("<QQQ", record, 32)
        elif place + size > base + k:
            raise ValueError("the central directory does not fit")
        return entries, size, place

    def members(self) -> dict[str, Member]:
        entries, size, place = self.directory()
        data, k, out = self.at(place, size), 0, {}
        for _ in range(entries):
            if data[k : k + 4] != b"PK\1\2":
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", data, k + 8)
            packed, full, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", data, k + 20)
            header = struct.unpack_from("<I", data, k + 42)[0]
            name = data[k + 46 : k + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra, e = data[k + 46 + n_name : k + 46 + n_name + n_extra], 0
            while e + 4 <= len(extra):
                tag, n = struct.unpack_from("<HH", extra, e)
                if tag == 1:  # holds, in this order, those of the three that did not fit
                    values = iter(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                    full = next(values) if full == 0xFFFFFFFF else full
                    packed = next(values) if packed == 0xFFFFFFFF else packed
                    header = next(values) if header == 0xFFFFFFFF else header
                e += 4 + n
            out[name] = Member(name, method, full, packed, header)
            k += 46 + n_name + n_extra + n_note
        return out

    def start(self, member: Member) -> int:
        """First byte of a stored member: its local header has its own lengths of name and extra field."""
        if member.method != 0:
            raise ValueError(f"{member.name} is not stored; its records cannot be read by range")
        head = self.at(member.header, 30)
        if head[:4] != b"PK\3\4":
            raise ValueError("broken local header")
        n_name, n_extra = struct.unpack_from("<HH", head, 26)
        return member.header + 30 + n_name + n_extra


def _open(uri: str):
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def locate_records(manifest: DataFrame) -> DataFrame:
    """Byte range of every record of the listed archives (a column ``archive`` with URIs)."""

    def run(batches):
        for batch in batches:
            for uri in batch["archive"]:
                with _open(uri) as file:
                    reader = ZipReader(file)
                    members = reader.members()
                    start, index = reader.start(members[DATA]), members[INDEX]
                    lines = reader.at(reader.start(index), index.size).decode("utf-8", "surrogatepass").splitlines()
                found = [json.loads(line.split(" ", 1)[1]) for line in lines]
                if found:
                    frame = pd.DataFrame(found, columns=["offset", "length", "page_id"])
                    frame["page_id"] = frame["page_id"].astype("Int64")
                    yield frame.assign(archive=uri, start=start)[["archive", "offset", "length", "page_id", "start"]]

    return manifest.select("archive").repartition("archive").mapInPandas(run, LOCATIONS)


def _headers(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    pairs = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {k.decode().lower(): v.strip().decode("utf-8", "surrogatepass") for k, _, v in pairs}, rest


def _page(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def parse_record(packed: bytes) -> tuple:
    """page_id, url, type, refers_to, payload, bytes and digest of one gzip stream; digests are checked."""
    headers, rest = _headers(zlib.decompress(packed, 31))
    block = rest[: int(headers["content-length"])]
    http, payload = _headers(block)
    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha256:")
    size = int(http["content-length"])
    if kind == "response":
        real = hashlib.sha256(payload).hexdigest()
        if (real, len(payload)) != (digest, size):
            raise ValueError(f"record {headers['warc-record-id']} does not hold what its header says")
    return (_page(headers["warc-record-id"]), headers.get("warc-target-uri"), kind, _page(headers.get("warc-refers-to")),
            payload if kind == "response" else None, size, digest)


def read_records(locations: DataFrame) -> DataFrame:
    """Every located record; neighbouring ranges of an archive are fetched in one read.

    Revisits have no payload; bytes and digest are those of the payload they stand for.
    """
    # a location is few bytes here and many to read: the number of tasks must not follow from the size of the rows
    tasks = int(locations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = locations.repartition(tasks, "archive", F.floor(F.col("offset") / F.lit(READ_BYTES)))

    def run(batches):
        for batch in batches:
            for uri, rows in batch.sort_values(["archive", "offset"]).groupby("archive", sort=False):
                found, group, low = [], [], 0
                with _open(uri) as file:
                    reader = ZipReader(file)

                    def flush():
                        data = reader.at(low, group[-1][0] + group[-1][1] - low)
                        for at, n, offset in group:
                            found.append((*parse_record(data[at - low : at - low + n]), uri, offset))

                    for start, offset, n in zip(rows["start"], rows["offset"], rows["length"]):
                        at = int(start + offset)
                        if group and (at != group[-1][0] + group[-1][1] or at + n - low > READ_BYTES):
                            flush()
                            group = []
                        low = low if group else at
                        group.append((at, int(n), int(offset)))
                    flush()
                frame = pd.DataFrame(found, columns=[x.split(" ")[0] for x in RECORDS.split(", ")])
                for c in ("page_id", "refers_to"):
                    frame[c] = frame[c].astype("Int64")
                yield frame

    return spread.mapInPandas(run, RECORDS)
