"""WARC records in ZIP packages: written by tasks, read back by ranges without extraction."""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import urllib.parse
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwright.llm.common import discard, scratch, slices, written

#: A package is closed beyond this many bytes of records.
PACKAGE_BYTES = 256 << 20
#: Neighbouring records are fetched in one range of about this size.
RANGE_BYTES = 1 << 20
#: Fixed value: the date that records carry, so that equal input gives equal records.
DATE = "2000-01-01T00:00:00Z"


# --- ZIP directories -------------------------------------------------------


@dataclass
class Member:
    name: str
    method: int
    size: int
    stored: int
    header: int


class RangeFile:
    """Random access by (place, length) over a pyarrow file; counts what it reads."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size, self.fetched = file, file.size(), 0

    def read(self, at: int, length: int) -> bytes:
        if at < 0 or length < 0 or at + length > self.size:
            raise ValueError(f"range {at}+{length} leaves the file of {self.size} bytes")
        self.fetched += length
        self.file.seek(at)
        return self.file.read(length)


def members(file: RangeFile) -> dict[str, Member]:
    """The central directory, by way of the ZIP64 one where there is one."""
    tail_at = max(0, file.size - 65_557)
    tail = file.read(tail_at, file.size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP file")
    count, size, at = struct.unpack("<H2I", tail[end + 10 : end + 20])
    locator = tail_at + end - 20
    if locator >= 0 and (mark := file.read(locator, 20))[:4] == b"PK\x06\x07":
        record = file.read(struct.unpack("<Q", mark[8:16])[0], 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 locator points to no ZIP64 directory end")
        count, size, at = struct.unpack("<3Q", record[32:56])
    directory, found, p = file.read(at, size), {}, 0
    for _ in range(count):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is broken")
        method, stored, full = (struct.unpack("<H", directory[p + 10 : p + 12])[0], *struct.unpack("<2I", directory[p + 20 : p + 28]))
        name_n, extra_n, comment_n = struct.unpack("<3H", directory[p + 28 : p + 34])
        header = struct.unpack("<I", directory[p + 42 : p + 46])[0]
        name = directory[p + 46 : p + 46 + name_n].decode()
        extra = directory[p + 46 + name_n : p + 46 + name_n + extra_n]
        while len(extra) >= 4:
            kind, n = struct.unpack("<2H", extra[:4])
            if kind == 1:  # the values that did not fit, in this order
                rest = extra[4 : 4 + n]
                for which in ("full", "stored", "header"):
                    if {"full": full, "stored": stored, "header": header}[which] == 0xFFFFFFFF:
                        value, rest = struct.unpack("<Q", rest[:8])[0], rest[8:]
                        full, stored, header = (value if which == "full" else full, value if which == "stored" else stored, value if which == "header" else header)
            extra = extra[4 + n :]
        found[name] = Member(name, method, full, stored, header)
        p += 46 + name_n + extra_n + comment_n
    return found


def data_range(file: RangeFile, member: Member) -> tuple[int, int]:
    """Where the bytes of a stored member lie."""
    if member.method != zipfile.ZIP_STORED:
        raise ValueError(f"{member.name} is compressed as a whole; its records cannot be read by range")
    head = file.read(member.header, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"{member.name} has no local header")
    name_n, extra_n = struct.unpack("<2H", head[26:30])
    return member.header + 30 + name_n + extra_n, member.size


# --- records ----------------------------------------------------------------


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: object) -> str:
    """An id as a record's name; no id and an empty one have different names."""
    return "<urn:no-page>" if page_id is None else f"<urn:page:{urllib.parse.quote(str(page_id), safe='')}>"


def _page(urn: str | None) -> str | None:
    return urllib.parse.unquote(urn[len("<urn:page:") : -1]) if urn and urn.startswith("<urn:page:") else None


def record(page_id: object, url: str | None, payload: bytes, sha: str, refers_to: object = None, revisit: bool = False) -> bytes:
    """One record as a gzip member.  A revisit has the response's head, which
    tells the payload's length, but no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {urllib.parse.quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{sha}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    text = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode()
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress(text + block + b"\r\n\r\n") + squeeze.flush()


def parse(data: bytes) -> dict[str, object]:
    """Headers (lower-case names) and block of a record; checks its length."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    out: dict[str, object] = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = int(out["content-length"])
    if len(rest) != length + 4:
        raise ValueError("the record's block has another length than its header says")
    out["block"] = rest[:length]
    return out


class PackageWriter:
    """A ZIP package: one stored archive member of gzip records, a stored index, a description."""

    def __init__(self, out: BinaryIO, name: str):
        self.name, self.index, self.bytes = name, [], 0
        self.zip = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(f"archive/{name}.warc.gz", "w", force_zip64=True)

    def add(self, page_id: object, url: str | None, data: bytes, sha: str, kind: str) -> None:
        self.member.write(data)
        said = {"url": url, "mime": "text/html" if kind == "response" else "warc/revisit", "digest": sha, "offset": self.bytes, "length": len(data), "filename": f"{self.name}.warc.gz"}
        self.index.append(f"{urllib.parse.quote(url or '-', safe=':/')} 20000101000000 {json.dumps(said)}\n")
        self.bytes += len(data)

    def close(self) -> None:
        self.member.close()
        with self.zip.open("indexes/index.cdxj", "w", force_zip64=True) as f:
            for line in self.index:
                f.write(line.encode())
        self.zip.writestr("datapackage.json", json.dumps({"profile": "data-package", "resources": [{"path": f"archive/{self.name}.warc.gz"}, {"path": "indexes/index.cdxj"}]}))
        self.zip.close()


def records(file: RangeFile) -> Iterator[dict[str, object]]:
    """All indexed records of a package, fetched in ranges."""
    found = members(file)
    archives = {name.rpartition("/")[2]: data_range(file, m) for name, m in found.items() if name.startswith("archive/") and m.size}
    for name, m in found.items():
        if not name.startswith("indexes/"):
            continue
        at, size = data_range(file, m)
        entries = [json.loads(line.split(" ", 2)[2]) for line in file.read(at, size).decode().splitlines()]
        i = 0
        while i < len(entries):
            first, stop = entries[i], i + 1
            end = first["offset"] + first["length"]
            while stop < len(entries) and entries[stop]["filename"] == first["filename"] and entries[stop]["offset"] == end and end - first["offset"] < RANGE_BYTES:
                end += entries[stop]["length"]
                stop += 1
            base, length = archives[first["filename"]]
            if end > length:
                raise ValueError("the index points beyond its archive")
            data = memoryview(file.read(base + first["offset"], end - first["offset"]))
            for entry in entries[i:stop]:
                begin = entry["offset"] - first["offset"]
                yield parse(bytes(data[begin : begin + entry["length"]]))
            i = stop


# --- over tables ------------------------------------------------------------


def write_packages(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes a record per row of (page_id, url, html) and returns (package, records, bytes).

    Payload is the html in UTF-8, empty for null.  Of rows with equal payloads
    of at least ``least`` bytes, that with the smallest id is the response and
    the others revisit it; of several rows with that same id each is a response
    (they are the same record).  Null ids count as largest.  Which rows revisit
    is found from ids and digests alone, so that however many pages share a
    payload, payloads travel by id, once, to their package.  Tasks write
    under names of their own attempt and only finished ones are listed, so a
    lost executor leaves at most an unlisted file.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    heads = written(rows.select("page_id", "sha", F.octet_length("html").alias("size")), "page_heads")
    # sums are written before they are joined on their own key: Spark can then split a payload of very many pages
    firsts = written(heads.where(F.col("size") >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("first is not null and n > 1"), "first_pages")
    later = heads.join(firsts, "sha").where("size >= %d and not (page_id <=> first)" % least).select("page_id", "sha", "first").distinct()
    later = written(later, "revisits")
    discard(heads, firsts)
    later = later.select(F.col("page_id").alias("later_id"), F.col("sha").alias("later_sha"), "first")
    dealt = rows.join(later, F.col("page_id").eqNullSafe(F.col("later_id")) & (F.col("sha") == F.col("later_sha")), "left").select("page_id", "url", "html", "sha", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        task, number = TaskContext.get(), 0
        writer, out, done = None, None, []

        def close() -> None:
            writer.close()
            out.close()
            done.append((f"{folder}/{writer.name}.wacz", len(writer.index), writer.bytes))

        for part in slices(batches, "html"):
            for page, url, html, sha, first in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "sha", "first")), strict=True):
                if writer is None:
                    name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{number}"
                    out = system.open_output_stream(f"{path}/{name}.wacz")
                    writer, number = PackageWriter(_Stream(out), name), number + 1
                payload = html.encode("utf-8", "surrogatepass")
                code = base64.b32encode(bytes.fromhex(sha)).decode()
                revisit = first is not None
                writer.add(page, url, record(page, url, payload, code, first, revisit), code, "revisit" if revisit else "response")
                if writer.bytes >= PACKAGE_BYTES:
                    close()
                    writer = None
        if writer is not None:
            close()
        if done:
            names, counts, sizes = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["package", "records", "bytes"])

    return dealt.mapInArrow(run, "package string, records bigint, bytes bigint")


class _Stream(io.RawIOBase):
    """A pyarrow output stream that zipfile takes for one without seeking."""

    def __init__(self, out: pa.NativeFile):
        self.out = out

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(data)
        return len(data)

    def flush(self) -> None:
        pass


def read_packages(packages: DataFrame, kind: str = "bigint") -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of every record.

    ``packages`` has a column package; each is read by ranges, by one task.  A
    response's payload is checked against its digest.  Missing or broken
    packages raise an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            for package in batch.column("package").to_pylist():
                system, path = fs.FileSystem.from_uri(package)
                out: list[list] = [[] for _ in names]
                with system.open_input_file(path) as f:
                    for r in records(RangeFile(f)):
                        head, _, payload = r["block"].partition(b"\r\n\r\n")
                        said = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        sha = r["warc-payload-digest"].removeprefix("sha1:")
                        if r["warc-type"] == "response" and (len(payload) != said or digest(payload) != sha):
                            raise ValueError(f"the payload of {r['warc-record-id']} is not what its header says")
                        row = (_page(r["warc-record-id"]), r["warc-target-uri"] or None, said, sha, r["warc-type"], _page(r.get("warc-refers-to")))
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                        if len(out[0]) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)
                            out = [[] for _ in names]
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    found = packages.select("package").mapInArrow(run, "page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string")
    return found.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes ``pages`` as packages in the shared folder, then reads them back.

    An empty table gives no package and no row.  Columns other than page_id,
    url and html are not looked at.
    """
    spark = pages.sparkSession
    listed = written(write_packages(pages, scratch(spark, "wacz"), least), "wacz_list")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return read_packages(listed.repartition(tasks), pages.schema["page_id"].dataType.simpleString())
