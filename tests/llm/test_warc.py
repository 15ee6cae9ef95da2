"""Archives against the standard library's ZIP code and a byte-for-byte round trip."""

import gzip
import hashlib
import io
import json
import struct
import zipfile
import zlib

import pytest

from roleweave.llm import warc
from roleweave.llm.storage import share_package


def pages(spark, rows):
    share_package(spark)
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)


def expected(rows):
    out = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first = min(same, default=None)
        again = len(raw) >= 100 and page_id is not None and page_id != first
        out.append((str(page_id), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


ROWS = [
    (1, "http://a/", "é" * 60), (2, "http://b/ c", "é" * 60), (3, None, "é" * 60), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""),
    (None, "u", "é" * 60), (9, "u", "x" * 2_000_000), (9, "u", "x" * 2_000_000), (10, "u", "x" * 2_000_000), (11, "u\r\nv: w", "\r\n\r\nWARC/1.1\r\n" * 20),
    (12, "u", "y" * 99), (13, "u", "y" * 99), (14, "u", "z" * 100), (15, "u", "z" * 100),
]


def test_round_trip(spark):
    got = warc.round_trip(pages(spark, ROWS)).collect()
    mine = [(str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got]
    assert sorted(mine, key=str) == expected(ROWS)


def test_payloads_come_back(spark):
    got = warc.read_records(warc.locate(warc.archive(pages(spark, ROWS)), block=1000)).collect()
    for r in got:
        if r["record_type"] == "response":
            assert bytes(r["payload"]).decode() in [h or "" for p, _, h in ROWS if p == r["page_id"]]
        else:
            assert r["payload"] is None


def test_several_packages_per_task(spark, tmp_path):
    folder = f"file://{tmp_path}/packages"
    made = warc.write_packages(warc.decide(pages(spark, ROWS)).repartition(1), folder, most=500)
    paths = [r["path"] for r in made.collect()]
    assert len(paths) > 1
    for p in paths:
        with zipfile.ZipFile(p.removeprefix("file://")) as z:
            assert z.testzip() is None
            assert {i.filename: i.compress_type for i in z.infolist()} == {warc.DATA: 0, warc.INDEX: 0}
    assert warc.read_records(warc.locate(made)).count() == len(ROWS)


def test_no_pages(spark):
    assert warc.round_trip(pages(spark, ROWS).filter("false")).collect() == []


def zipped(comment=b"", wide=False):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(5):
            with z.open(zipfile.ZipInfo(f"ä/{i}.txt"), "w", force_zip64=wide) as f:
                f.write(bytes([i]) * (i + 1))
        z.comment = comment
    return out.getvalue()


@pytest.mark.parametrize("data", [zipped(), zipped(b"a comment"), zipped(wide=True)])
def test_directory_matches_zipfile(data):
    members = warc.directory(io.BytesIO(data), len(data))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert [(m.name, m.size, m.crc) for m in members] == [(i.filename, i.file_size, i.CRC) for i in z.infolist()]
        assert [data[m.start : m.start + m.size] for m in members] == [z.read(i) for i in z.infolist()]


def test_comment_that_looks_like_an_end_record():
    data = zipped(b"PK\x05\x06 in a comment")
    assert [m.name for m in warc.directory(io.BytesIO(data), len(data))] == [f"ä/{i}.txt" for i in range(5)]


def test_zip64_end_and_entries():
    """A package whose sizes and offsets stand in 64-bit fields only."""
    body = b"payload"
    local = struct.pack("<4sHHHHHIIIHH", warc.LOCAL_HEADER, 45, 0, 0, 0, 0, zlib.crc32(body), warc.FULL32, warc.FULL32, 1, 20)
    local += b"m" + struct.pack("<HHQQ", 1, 16, len(body), len(body))
    extra = struct.pack("<HH", 9, 2) + b"zz" + struct.pack("<HHQQQ", 1, 24, len(body), len(body), 0)
    entry = struct.pack("<4sHHHHHHIIIHHHHHII", warc.DIRECTORY_ENTRY, 45, 45, 0, 0, 0, 0, zlib.crc32(body), warc.FULL32, warc.FULL32, 1, len(extra), 0, 0, 0, 0, warc.FULL32)
    entry += b"m" + extra
    start = len(local) + len(body)
    end64 = struct.pack("<4sQHHIIQQQQ", warc.END64_RECORD, 44, 45, 45, 0, 0, 1, 1, len(entry), start)
    locator = struct.pack("<4sIQI", warc.END64_LOCATOR, 0, start + len(entry), 1)
    end = struct.pack("<4sHHHHIIH", warc.END_RECORD, 0, 0, warc.FULL16, warc.FULL16, warc.FULL32, warc.FULL32, 0)
    data = local + body + entry + end64 + locator + end
    (member,) = warc.directory(io.BytesIO(data), len(data))
    assert (member.name, member.size, data[member.start : member.start + member.size]) == ("m", len(body), body)


@pytest.mark.parametrize("data", [b"", b"PK\x05\x06", zipped()[:-30], b"x" * 100])
def test_broken_packages_are_refused(data):
    with pytest.raises(ValueError):
        warc.directory(io.BytesIO(data), len(data))


def test_broken_records_are_refused():
    record = warc._record(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None)
    assert warc.parse_record(record)["payload"] == b"abc"
    with pytest.raises((ValueError, zlib.error)):
        warc.parse_record(record[:-9])
    with pytest.raises(ValueError):
        warc.parse_record(zlib.compress(b"nothing", wbits=31))


def package(path, archives, indexes, method=zipfile.ZIP_STORED):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("datapackage.json", "{}", zipfile.ZIP_DEFLATED)
        for name, data in archives.items():
            z.writestr(zipfile.ZipInfo(f"archive/{name}"), data, method)
        for name, (data, packing) in indexes.items():
            z.writestr(zipfile.ZipInfo(f"indexes/{name}"), data, packing)


def several(n=6):
    """Records in two archives, with index lines that name them; a gap between the records of each."""
    archives, lines = {"rec-0.warc.gz": b"", "rec-1.warc.gz": b""}, []
    for i in range(n):
        name, body = f"rec-{i % 2}.warc.gz", f"payload {i}".encode() * 20
        record = warc._record(i, f"http://{i}/", body, hashlib.sha256(body).hexdigest(), None)
        place = {"filename": name, "offset": str(len(archives[name])), "length": str(len(record))}
        lines.append(f"key{i} 20240101 {json.dumps(place)}\n".encode())
        archives[name] += record + (b"gap" if i == 2 else b"")
    return archives, [b'!meta {"format": "cdxj"}\n', *lines]


def read(spark, path, **options):
    share_package(spark)
    return warc.read_records(warc.locate(spark.createDataFrame([(f"file://{path}",)], "path string"), **options)).collect()


def test_members_and_indexes_are_found_by_the_directory(spark, tmp_path):
    archives, lines = several()
    text = b"".join(lines)
    for number, indexes in enumerate([
        {"index.cdxj": (text, zipfile.ZIP_STORED)},
        {"index.cdx.gz": (gzip.compress(text), zipfile.ZIP_STORED)},
        {"a.cdx": (b"".join(lines[:4]), zipfile.ZIP_DEFLATED), "b.cdx.gz": (gzip.compress(b"".join(lines[3:])), zipfile.ZIP_DEFLATED)},
    ]):
        package(tmp_path / f"{number}.wacz", archives, indexes)
        got = read(spark, tmp_path / f"{number}.wacz", block=[1, 4 << 20][number % 2])
        assert sorted((r["page_id"], r["payload_bytes"]) for r in got) == [(i, 180) for i in range(6)]


def test_records_of_others_and_of_other_kinds(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nServer:x\r\n\r\nbody"
    head = "WARC/1.0\r\nWARC-Type: {}\r\nWARC-Target-URI: u\r\nWARC-Payload-Digest: sha1:ABC\r\nContent-Length: {}\r\n\r\n"
    records = [head.format(kind, len(block)).encode() + block + b"\r\n\r\n" for kind in ("warcinfo", "response", "revisit")]
    at = [sum(map(len, records[:i])) for i in range(3)]
    index = "".join(f"{a} {len(r)}\n" for a, r in zip(at, records)).encode()
    package(tmp_path / "p.wacz", {"plain.warc": b"".join(records)}, {"i.cdx": (index, zipfile.ZIP_STORED)})
    got = sorted(read(spark, tmp_path / "p.wacz"), key=lambda r: r["record_type"])
    assert [(r["page_id"], r["record_type"], r["payload"] and bytes(r["payload"]), r["refers_to"]) for r in got] == [
        (None, "response", b"body", None), (None, "revisit", None, None)
    ]


@pytest.mark.parametrize("case, message", [
    ("deflated archive", "has to be stored"), ("no index", "no index in"), ("no archive", "no archive in"), ("unnamed", "does not name"),
    ("unknown", "not in the package"), ("outside", "points outside"), ("forgotten", "no index names"),
])
def test_packages_that_cannot_be_read_say_why(tmp_path, case, message):
    archives, lines = several()
    method, text = zipfile.ZIP_STORED, b"".join(lines)
    if case == "deflated archive":
        method = zipfile.ZIP_DEFLATED
    if case == "no archive":
        archives = {}
    if case == "unnamed":
        text = b"0 10\n"
    if case == "unknown":
        text = text.replace(b"rec-1", b"rec-9")
    if case == "outside":
        text = b'k {"filename": "rec-0.warc.gz", "offset": 0, "length": 99999}\n'
    if case == "forgotten":
        text = lines[1]
    indexes = {} if case == "no index" else {"index.cdx": (text, zipfile.ZIP_STORED)}
    package(tmp_path / "p.wacz", archives, indexes, method)
    data = (tmp_path / "p.wacz").read_bytes()
    with pytest.raises(ValueError, match=message):
        warc.contents("p", io.BytesIO(data), len(data))
