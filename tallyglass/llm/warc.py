"""WARC records in ZIP packages: written by tasks, read back by byte ranges.

A package is a ZIP of stored members: `archive/data.warc.gz` (each record a gzip member of its own), `indexes/index.cdx`
(a line a record: key, time, JSON with offset and length) and `datapackage.json`. Reading never extracts one: a task reads
the archive's directory (zipdirs.py), finds where the stored WARC members and the indexes lie, and cuts each WARC member
at indexed records into slices of a few MB; the slices are dealt to tasks, and each reads its own range. Packages without
an index are one slice a member.

Of equal payloads one record holds the bytes and the others are revisits that name it. Payloads meet by their digests alone;
the digests that occur more than once are sent to the pages, which stay where they are.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.llm import zipdirs
from tallyglass.llm.common import PARQUET, lean, located, materialize, scratch, shuffle_partitions
from tallyglass.llm.token_files import filesystem

#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 100
#: Bytes of compressed records after which a task begins another package, and of a slice.
PACKAGE_BYTES, SLICE_BYTES = 256 << 20, 8 << 20
#: Repeated payloads that are broadcast at most (a digest and two numbers each); more are shuffled, and the pages with them.
BROADCAST_REPEATS = 200_000

#: The profile of a revisit to an identical payload, and the forms of a package's description.
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PACKAGE = {"profile": "data-package", "wacz_version": "1.1.1"}
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
RECORD = "archive string, record_id string, record_type string, date string, target_uri string, refers_to string, payload_bytes long, payload_digest string, intact boolean, payload binary"


def surt(url: str) -> str:
    """The key by which indexes sort: host parts from the last to the first, then the path."""
    try:
        parts = urlsplit(url.lower())
        host = parts.hostname or ""
    except ValueError:
        return url.lower()
    query = f"?{parts.query}" if parts.query else ""
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + query if host else url.lower()


def one_line(url: str) -> str:
    """A URL for a header: control characters and spaces are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(kind: str, record_id: str, date: str, url: str | None, digest: str, payload: bytes, refers_to: str | None) -> bytes:
    """A response with its payload, or a revisit with the payload's headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", url is not None and f"WARC-Target-URI: {one_line(url)}",
        f"WARC-Payload-Digest: sha256:{digest}", kind == "revisit" and f"WARC-Refers-To: <{refers_to}>", kind == "revisit" and f"WARC-Profile: {IDENTICAL}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(x for x in lines if x).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzipped(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Package:
    """One package while it is written: records are streamed into the stored member, the index follows."""

    def __init__(self, uri: str, date: str):
        self.uri, self.date = uri, date
        system, path = filesystem(uri)
        self.out = system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.bytes, self.hash, self.lines = 0, hashlib.sha256(), []
        info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: 20\r\n\r\n"
        self._put(info.encode() + b"format: WARC/1.1\r\n\r\n" + b"\r\n\r\n")

    def _put(self, data: bytes) -> tuple[int, int]:
        packed = gzipped(data)
        at, self.bytes = self.bytes, self.bytes + len(packed)
        self.data.write(packed)
        self.hash.update(packed)
        return at, len(packed)

    def add(self, kind: str, record_id: str, url: str | None, digest: str, payload: bytes, refers_to: str | None) -> None:
        at, size = self._put(record(kind, record_id, self.date, url, digest, payload, refers_to))
        about = {"url": url, "mime": "text/html" if kind == "response" else "warc/revisit", "digest": f"sha256:{digest}", "offset": at, "length": size, "filename": DATA.rpartition("/")[2]}
        self.lines.append(f"{one_line(surt(url or ''))} {re.sub(r'[^0-9]', '', self.date)[:14]} {json.dumps(about)}")

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        index = "".join(f"{line}\n" for line in sorted(self.lines)).encode()
        about = [(DATA, self.bytes, self.hash), (INDEX, len(index), hashlib.sha256(index))]
        resources = [{"name": name.rpartition("/")[2], "path": name, "bytes": n, "hash": f"sha256:{h.hexdigest()}"} for name, n, h in about]
        self.zip.writestr(zipfile.ZipInfo(INDEX), index)
        self.zip.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps(PACKAGE | {"created": self.date, "resources": resources}))
        self.zip.close()
        self.out.close()
        return self.uri, len(self.lines), self.bytes


def record_id(page_id: int | None, row: int) -> str:
    return f"urn:x-page:{'' if page_id is None else page_id}:{row}"


def write_packages(pages: DataFrame, path: str | None = None, package_bytes: int = PACKAGE_BYTES, date: str | None = None) -> str:
    """Write a record for each row of `pages` (page_id, url, html); returns the folder, whose `manifest` names the packages.

    The payload is html in UTF-8, null as empty. Of equal payloads of LEAST_REVISIT bytes or more the row with the smallest page_id
    (null last, one of repeated rows) is the response; shorter payloads are responses all. A null url has no target. Other
    columns are ignored. An empty table writes no package. A package is written under a name of its attempt, and the manifest
    names those of attempts that succeeded, so retried tasks leave nothing that is read.
    """
    spark = pages.sparkSession
    folder = path or scratch(spark, "warc")
    made = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    system, where = filesystem(folder)
    system.create_dir(where)
    rows = located(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), "at", "page_id")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    known = rows.select("at", "page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    rank = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "at")
    repeats = known.where(F.length("payload") >= LEAST_REVISIT).groupBy("digest").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeats = materialize(repeats.select(F.col("digest").alias("repeated"), F.col("first.page_id").alias("first_id"), F.col("first.at").alias("first_at")), "warc-repeats")
    hint = "broadcast" if repeats.count() <= BROADCAST_REPEATS else "merge"  # a hot payload's rows are split by AQE
    typed = known.join(repeats.hint(hint), F.col("digest") == F.col("repeated"), "left")
    typed = typed.select("page_id", "at", "url", "digest", "payload", "first_id", F.when(F.col("first_at") != F.col("at"), F.col("first_at")).alias("first_at"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for batch in batches:
            columns = [batch.column(k) for k in range(7)]
            for i in range(len(batch)):
                page_id, at, url, digest, data, first_id, first_at = (c[i].as_py() for c in columns)
                if package is None or package.bytes >= package_bytes:
                    if package:
                        done.append(package.close())
                    package = Package(f"{folder}/{uuid.uuid4().hex}.wacz", made)
                revisit = first_at is not None
                package.add("revisit" if revisit else "response", record_id(page_id, at), url, digest, data, record_id(first_id, first_at) if revisit else None)
        if package:
            done.append(package.close())
        names = ["path", "records", "bytes"]
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names)

    typed.mapInArrow(lean(write), "path string, records long, bytes long").write.options(**PARQUET).parquet(f"{folder}/manifest")
    return folder


def packages(spark: SparkSession, folder: str) -> DataFrame:
    """path of each package that write_packages() wrote."""
    return spark.read.schema("path string").parquet(f"{folder}/manifest")


def found_packages(spark: SparkSession, folder: str, pattern: str = "*.wacz") -> DataFrame:
    """path of each package in a folder of any origin; their content is not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path")


def indexed(lines: Iterator[bytes]) -> Iterator[tuple[str, int]]:
    """(file name, offset) of each line of an index that has them; header and other lines are passed over."""
    for line in lines:
        at = line.find(b"{")
        try:
            about = json.loads(line[at:]) if at >= 0 else {}
            yield str(about["filename"]).rpartition("/")[2], int(about["offset"])
        except (ValueError, KeyError, TypeError):
            continue


def slices(uri: str, slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[str, str, int, int]]:
    """(archive, member, start, end) of ranges of whole records of each WARC member, cut at indexed records."""
    system, path = filesystem(uri)
    with system.open_input_file(path) as f:
        data, index = [], []
        for m in zipdirs.members(f, f.size()):
            if re.search(r"\.warc(\.gz)?$", m.name):
                data.append(m)
            elif re.match(r"indexes/.*\.(cdxj?|idx)(\.gz)?$", m.name):
                index.append(m)
        at: dict[str, list[int]] = {}
        for m in index:
            stream = zipdirs.content(f, m)
            for name, offset in indexed(gzip.GzipFile(fileobj=stream) if m.name.endswith(".gz") else stream):
                at.setdefault(name, []).append(offset)
        for m in data:
            start, end = zipdirs.stored(f, m)
            begun = 0
            for offset in sorted(at.get(m.name.rpartition("/")[2], ())):
                if offset - begun >= slice_bytes:
                    yield uri, m.name, start + begun, start + offset
                    begun = offset
            if start + begun < end:
                yield uri, m.name, start + begun, end


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each WARC record of a plain stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise zipdirs.BadArchive(f"no WARC record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers.get("content-length", 0))
        block = stream.read(size)
        if len(block) < size:
            raise zipdirs.BadArchive("a record is cut off")
        yield headers, block


def is_intact(digest: str | None, payload: bytes) -> bool | None:
    """Whether a payload has the digest that its record states, in hexadecimal or base 32; null where it states none that is known."""
    name, _, stated = (digest or "").partition(":")
    if name.lower().replace("-", "") not in ("md5", "sha1", "sha256", "sha512"):
        return None
    h = hashlib.new(name.lower().replace("-", ""), payload)
    return stated.lower() == h.hexdigest() or stated.rstrip("=").upper() == base64.b32encode(h.digest()).decode().rstrip("=")


def parsed(archive: str, headers: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    """A row of RECORD. A revisit's digest and length are those of the full payload, which it only names."""
    kind, stated = headers.get("warc-type", ""), headers.get("warc-payload-digest")
    payload, length = block, len(block)
    if headers.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        length = len(payload)
        if kind == "revisit":
            known = re.search(rb"(?im)^content-length:\s*(\d+)", head)
            length = int(known[1]) if known else None
    if kind == "revisit":
        name, _, value = (stated or "").partition(":")
        digest, intact, payload = value.lower() if name.lower() == "sha256" else None, None, None
    else:
        digest, intact = hashlib.sha256(payload).hexdigest(), is_intact(stated, payload)
    bare = lambda name: headers[name].strip("<>") if name in headers else None
    return archive, bare("warc-record-id"), kind, headers.get("warc-date"), bare("warc-target-uri"), bare("warc-refers-to"), length, digest, intact, payload if with_payload else None


def read_packages(archives: DataFrame, payload: bool = True, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The records of packages (column path): archive, record_id, record_type, date, target_uri, refers_to, payload_bytes, payload_digest, intact, payload.

    payload_digest is the SHA-256 of the payload in hexadecimal, recomputed for all but revisits; intact says whether it agrees with what the
    record states. `payload` false leaves the bytes out. A null path is passed over; a table of no packages has no
    records. A package that is cut off, or whose WARC members are compressed in the ZIP, is an error that names it.
    """
    schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in filter(None, batch.column(0).to_pylist()):
                try:
                    rows = list(slices(uri, slice_bytes))
                except ValueError as e:
                    raise zipdirs.BadArchive(f"{uri}: {e}") from e
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 4, schema.types, strict=True)], schema=schema)

    kinds = (*[pa.string()] * 6, pa.int64(), pa.string(), pa.bool_(), pa.binary())
    names = [c.strip().split()[0] for c in RECORD.split(",")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, member, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, path = filesystem(archive)
                held, size = [], 0
                with system.open_input_file(path) as f:
                    stream = io.BufferedReader(zipdirs.Range(f, start, end), 1 << 20)
                    try:
                        for headers, block in records(io.BufferedReader(gzip.GzipFile(fileobj=stream)) if member.endswith(".gz") else stream):
                            held.append(parsed(archive, headers, block, payload))
                            size += len(block)
                            if size > SLICE_BYTES or len(held) == 4096:
                                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)
                                held, size = [], 0
                    except (ValueError, EOFError, OSError, zlib.error) as e:
                        raise zipdirs.BadArchive(f"{archive}: {member}: {e}") from e
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)

    n = shuffle_partitions(archives.sparkSession)
    ranges = archives.select("path").mapInArrow(lean(locate), "archive string, member string, start long, end long").repartition(n)
    return ranges.mapInArrow(lean(read), RECORD)


def page_records(read: DataFrame) -> DataFrame:
    """Records that write_packages() wrote: page_id, payload_bytes, payload_digest, record_type, refers_to (the response's page_id)."""
    page = lambda c: F.regexp_extract(c, r"^urn:x-page:(-?\d*):-?\d+$", 1).try_cast("long")
    kept = read.where(F.col("record_type").isin("response", "revisit"))
    return kept.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
