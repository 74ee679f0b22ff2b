"""WARC packages: round trips against plain Python, and ZIP archives of other makers and forms."""

import base64
import gzip
import hashlib
import io
import json
import random
import zipfile

import pytest

from tallyglass.llm import warc, zipdirs

SCHEMA = "page_id long, url string, html string"


def expected(rows):
    """Sorted results of op11 for (page_id, url, html) rows."""
    payloads = [(p, (h or "").encode()) for p, _, h in rows]
    out, taken = [], set()
    for i, (p, data) in sorted(enumerate(payloads), key=lambda x: (x[1][0] is None, x[1][0] or 0, x[0])):
        digest = hashlib.sha256(data).hexdigest()
        revisit = len(data) >= 100 and digest in taken
        first = next((q for q, d in sorted(payloads, key=lambda x: (x[0] is None, x[0] or 0)) if d == data), None)
        out.append((p, len(data), digest, "revisit" if revisit else "response", first if revisit else None))
        taken.add(digest)
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


def round_trip(spark, table, **options):
    folder = warc.write_packages(table, **options)
    return warc.page_records(warc.read_packages(warc.packages(spark, folder), slice_bytes=5_000))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("ab \r\nWARC/1.1é漢") for _ in range(n))
    copies = [word(rng.randint(90, 140)) for _ in range(6)]
    out = [(i, f"https://h{i % 7}.example/p {i}\n?q=é", rng.choice([*copies, word(rng.randint(0, 400))])) for i in range(150)]
    out += [(200, None, None), (201, "", ""), (None, "x", copies[0]), (None, None, copies[0]), (202, "http://[bad", word(300_000)), (203, "u", "y" * 99), (204, "u", "y" * 99), (205, "u", "y" * 100), (206, "u", "y" * 100)]
    return out + [(-5, "u", copies[1]), (-5, "u", copies[1]), out[3], out[3]]


def test_pages_come_back(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert result(round_trip(spark, table)) == expected(rows)
    assert result(round_trip(spark, table, package_bytes=3_000)) == expected(rows)


def test_unique_ids_and_clashing_columns(spark, rows):
    some = [r for r in {r[0]: r for r in rows}.values() if r[0] is not None]
    table = spark.createDataFrame(some, SCHEMA).selectExpr("*", "1 AS at", "2 AS digest", "3 AS payload", "4 AS first", "5 AS path")
    assert result(round_trip(spark, table)) == expected(some)


def test_repeats_meet_in_a_shuffle_too(spark, rows, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_REPEATS", 0)
    assert result(round_trip(spark, spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_an_empty_table(spark):
    assert round_trip(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_payloads_urls_and_descriptions(spark, tmp_path):
    folder = warc.write_packages(spark.createDataFrame([(1, "http://a.b/c d", "é" * 60), (2, "http://a.b/", "é" * 60)], SCHEMA).coalesce(1), path=f"file://{tmp_path}/w", date="2024-05-06T07:08:09Z")
    read = {r.record_id: r for r in warc.read_packages(warc.packages(spark, folder)).collect() if r.record_type != "warcinfo"}
    assert read["urn:x-page:1:1"].payload == ("é" * 60).encode() and read["urn:x-page:1:1"].intact and read["urn:x-page:1:1"].target_uri == "http://a.b/c%20d"
    assert read["urn:x-page:2:2"].refers_to == "urn:x-page:1:1" and read["urn:x-page:2:2"].payload is None and read["urn:x-page:2:2"].payload_bytes == 120
    (path,) = [r.path for r in warc.found_packages(spark, f"{folder}").collect()]
    with zipfile.ZipFile(path.removeprefix("file:")) as z:
        assert z.testzip() is None and all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
        about = json.loads(z.read("datapackage.json"))
        assert all(hashlib.sha256(z.read(r["path"])).hexdigest() == r["hash"].removeprefix("sha256:") for r in about["resources"])
        lines = z.read("indexes/index.cdx").decode().splitlines()
        assert [line.split()[0] for line in lines] == ["b,a)/", "b,a)/c%20d"] and all(line.split()[1] == "20240506070809" for line in lines)
        data = z.read("archive/data.warc.gz")
        for line in lines:  # every record is a gzip member that its index line finds
            at = json.loads(line.split(" ", 2)[2])
            assert gzip.decompress(data[at["offset"] : at["offset"] + at["length"]]).startswith(b"WARC/1.1\r\nWARC-Type: re")


def plain_record(k, payload, digest=None):
    head = f"WARC/1.0\r\nwarc-type: resource\r\nWARC-Record-ID: <r{k}>\r\nContent-Type: text/plain\r\n" + (f"WARC-Payload-Digest: {digest}\r\n" if digest else "")
    return head.encode() + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"


def foreign(path, before=b"", comment=b"", gz=True, index="deflated", method=zipfile.ZIP_STORED, n=60):
    """A package as others make them; returns its payloads."""
    payloads = [bytes([65 + k % 26]) * (k * 7) for k in range(n)]
    parts = [plain_record(k, p, "sha1:" + base64.b32encode(hashlib.sha1(p).digest()).decode()) for k, p in enumerate(payloads)]
    parts = [gzip.compress(p) for p in parts] if gz else parts
    name = "rec.warc.gz" if gz else "rec.warc"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.comment = comment
        z.writestr("pages/pages.jsonl", "{}\n" * 50)
        z.writestr(f"archive/{name}", b"".join(parts), method)
        at, lines = 0, [b"!meta 0 {}", b"not an index line", b'x 1 {"offset": "many"}']
        for p in parts:
            lines.append(f'key 2024 {{"offset": "{at}", "length": {len(p)}, "filename": "{name}"}}'.encode())
            at += len(p)
        text = b"\n".join(lines)
        if index == "gz":
            z.writestr("indexes/index.cdx.gz", gzip.compress(text), zipfile.ZIP_STORED)
        elif index:
            z.writestr("indexes/index.cdxj", text)
    path.write_bytes(before + out.getvalue())
    return payloads


@pytest.mark.parametrize("form", [{}, {"index": "gz"}, {"index": None}, {"gz": False}, {"comment": b"PK\x05\x06" * 9}, {"before": b"#!/bin/sh\n" * 20}, {"n": 0}])
@pytest.mark.parametrize("wide", [False, True])
def test_packages_of_other_makers(spark, tmp_path, monkeypatch, form, wide):
    if wide:  # every size and place in ZIP64 fields
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    want = foreign(tmp_path / "a.wacz", **form)
    if wide:
        assert zipdirs.END64 in (tmp_path / "a.wacz").read_bytes()
    with open(tmp_path / "a.wacz", "rb") as f:
        data = f.read()
        at, size, n, _ = zipdirs.directory(f, len(data))
        assert data[at : at + 4] == zipdirs.ENTRY and n == len(list(zipdirs.members(f, len(data))))
    cut = list(warc.slices(str(tmp_path / "a.wacz"), 500))
    assert (len(cut) > 3) == (form.get("index", "") is not None and want != [])
    read = warc.read_packages(spark.createDataFrame([(str(tmp_path / "a.wacz"),), (None,)], "path string"), slice_bytes=500).collect()
    assert sorted((r.record_id, bytes(r.payload), r.intact) for r in read) == sorted((f"r{k}", p, True) for k, p in enumerate(want))


def test_damaged_packages_are_named(spark, tmp_path):
    foreign(tmp_path / "a.wacz")
    whole = (tmp_path / "a.wacz").read_bytes()
    (tmp_path / "cut.wacz").write_bytes(whole[:-30])
    foreign(tmp_path / "packed.wacz", gz=False, method=zipfile.ZIP_DEFLATED)
    (tmp_path / "empty.wacz").write_bytes(b"")
    for name in ("cut", "packed", "empty"):
        with pytest.raises(Exception, match=f"{name}.wacz"):
            warc.read_packages(spark.createDataFrame([(str(tmp_path / f"{name}.wacz"),)], "path string")).count()


def test_digests():
    data = b"abc"
    assert warc.is_intact("sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode(), data)
    assert warc.is_intact("SHA-256:" + hashlib.sha256(data).hexdigest(), data) and warc.is_intact("md5:00", data) is False
    assert warc.is_intact(None, data) is None and warc.is_intact("crc9:1", data) is None
