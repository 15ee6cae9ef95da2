"""Web archives in ZIP packages: WARC records in stored members, read back by ranges without extraction.

A package holds ``archive/data.warc.gz`` (one gzip member per record) and ``indexes/index.cdx`` (one
line per record: offset, length, URI).  Both are stored, not compressed again, so a record is a byte
range of the package.  The reader parses the end record, the ZIP64 records and the central
directory, finds archives and indexes among its members by their folders (a package of others may
hold several, under any names), and from then on reads ranges only.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roleweave.llm.skew import salted_join
from roleweave.llm.storage import new_path, stage

#: Fixed values of the formats.
END_RECORD, END_SIZE = b"PK\x05\x06", 22
END64_LOCATOR, LOCATOR_SIZE = b"PK\x06\x07", 20
END64_RECORD, END64_SIZE = b"PK\x06\x06", 56
DIRECTORY_ENTRY, ENTRY_SIZE = b"PK\x01\x02", 46
LOCAL_HEADER, LOCAL_SIZE = b"PK\x03\x04", 30
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads below this many bytes are always written out.
LEAST_REVISIT = 100


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


@dataclass(frozen=True)
class Member:
    """A directory entry; ``start`` is where its bytes begin."""

    name: str
    method: int
    crc: int
    packed: int
    size: int
    start: int


def _range(file: BinaryIO, start: int, length: int) -> bytes:
    file.seek(start)
    data = file.read(length)
    if len(data) != length:
        raise ValueError(f"archive ends inside a range of {length} bytes at {start}")
    return data


def directory(file: BinaryIO, size: int) -> list[Member]:
    """All members of a ZIP file, by its central directory; ZIP64 sizes and offsets included."""
    tail_at = max(0, size - END_SIZE - FULL16)
    tail = _range(file, tail_at, size - tail_at)
    at = len(tail) - END_SIZE + 4  # a comment may follow the record, and look like one
    while (at := tail.rfind(END_RECORD, 0, at)) >= 0:
        if at + END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if FULL16 == count or FULL32 in (length, start):
        locator_at = tail_at + at - LOCATOR_SIZE
        locator = _range(file, locator_at, LOCATOR_SIZE) if locator_at >= 0 else b""
        if locator[:4] == END64_LOCATOR:
            record = _range(file, struct.unpack_from("<Q", locator, 8)[0], END64_SIZE)
            if record[:4] != END64_RECORD:
                raise ValueError("no ZIP64 end of central directory")
            count, length, start = struct.unpack_from("<QQQ", record, 32)
    entries, out, at = _range(file, start, length), [], 0
    for _ in range(count):
        if entries[at : at + 4] != DIRECTORY_ENTRY:
            raise ValueError("broken central directory")
        method, crc, packed, full = struct.unpack_from("<H4xIII", entries, at + 10)
        n_name, n_extra, n_comment = struct.unpack_from("<HHH", entries, at + 28)
        header = struct.unpack_from("<I", entries, at + 42)[0]
        name = entries[at + ENTRY_SIZE : at + ENTRY_SIZE + n_name].decode("utf-8")
        extra = entries[at + ENTRY_SIZE + n_name : at + ENTRY_SIZE + n_name + n_extra]
        full, packed, header = _wide(extra, full, packed, header)
        local = _range(file, header, LOCAL_SIZE)
        if local[:4] != LOCAL_HEADER:
            raise ValueError(f"no local header for {name}")
        skip = sum(struct.unpack_from("<HH", local, 26))
        out.append(Member(name, method, crc, packed, full, header + LOCAL_SIZE + skip))
        at += ENTRY_SIZE + n_name + n_extra + n_comment
    return out


def _wide(extra: bytes, *values: int) -> list[int]:
    """Put the 64-bit values of the ZIP64 extra field where the 32-bit ones are full."""
    at, out = 0, list(values)
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            place = at + 4
            for i, v in enumerate(out):
                if v == FULL32:
                    out[i] = struct.unpack_from("<Q", extra, place)[0]
                    place += 8
        at += 4 + length
    return out


def _record(page_id: int, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record in a gzip member of its own; a revisit has the HTTP head without the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Page-ID: {page_id}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        fields += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    raw = "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse_record(packed: bytes) -> dict:
    """Fields of a gzip-packed WARC record, with its block; raises if it is broken."""
    raw = zlib.decompress(packed, 31) if packed[:2] == b"\x1f\x8b" else packed
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    length = int(fields["Content-Length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("WARC record of another length")
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    pairs = (x.partition(":") for x in http.decode("utf-8", "replace").split("\r\n")[1:])
    fields["http"] = {name: value.strip() for name, _, value in pairs}
    fields["payload"] = payload
    return fields


def _number(text: str | None) -> int | None:
    return None if text in (None, "None") else int(text)


def decide(pages: DataFrame) -> DataFrame:
    """``pages`` with payload, digest and refers_to: the smallest page_id among equal large payloads, null if none."""
    page = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    page = page.withColumn("digest", F.sha2("payload", 256))
    narrow = stage(page.filter(F.octet_length("payload") >= LEAST_REVISIT).select("page_id", "digest"), "digests")
    firsts = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter("first < last")
    firsts = stage(firsts.drop("last"), "payloads")
    revisits = salted_join(narrow, firsts, ["digest"], F.col("page_id")).filter("page_id <> first")
    revisits = revisits.groupBy("page_id", "digest").agg(F.min("first").alias("refers_to"))
    return page.join(revisits, ["page_id", "digest"], "left")


def write_packages(records: DataFrame, folder: str, most: int = 1 << 30) -> DataFrame:
    """Write ``records`` (page_id, url, payload, digest, refers_to) to ZIP packages; their paths and record counts.

    Each task streams into a package of its own and starts another beyond ``most`` bytes.  A task that
    is run again writes under new names; only paths in the returned table belong to the archive.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = _open(folder)
        filesystem.create_dir(root, recursive=True)
        held = None

        def close(held: tuple) -> pa.RecordBatch:
            name, out, pack, member, lines, offset = held
            member.close()
            with pack.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as index:
                for line in lines:
                    index.write(line)
            pack.close()
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(lines)], pa.int64())], ["path", "records"])

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                page_id, url, payload, digest, refers_to = (x.as_py() for x in row)
                if held is None:
                    name = f"{uuid.uuid4().hex}.wacz"
                    out = filesystem.open_output_stream(f"{root}/{name}")
                    pack = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
                    held = (name, out, pack, pack.open(zipfile.ZipInfo(DATA), "w", force_zip64=True), [], 0)
                name, out, pack, member, lines, offset = held
                record = _record(page_id, url, payload, digest, refers_to)
                member.write(record)
                lines.append(f"{offset} {len(record)}\n".encode())
                held = (name, out, pack, member, lines, offset + len(record))
                if held[-1] >= most:
                    yield close(held)
                    held = None
        if held is not None:
            yield close(held)

    order = records.select("page_id", "url", "payload", "digest", F.col("refers_to").cast("long").alias("refers_to"))
    return stage(order.mapInArrow(rows, "path string, records long"), "packages")


def _index_text(path: str, file: BinaryIO, index: Member) -> bytes:
    """Lines of an index member: stored or deflated in the package, plain or gzip by its name."""
    raw = _range(file, index.start, index.packed)
    if index.method == zipfile.ZIP_DEFLATED:
        raw = zlib.decompress(raw, -15)
    elif index.method != zipfile.ZIP_STORED:
        raise ValueError(f"{path}: {index.name} is packed by method {index.method}, only stored and deflated indexes can be read")
    if zlib.crc32(raw) != index.crc:
        raise ValueError(f"{path}: broken index {index.name}")
    return gzip.decompress(raw) if index.name.endswith(".gz") else raw


def _places(path: str, index: str, text: bytes, archives: dict[str, Member]) -> Iterator[tuple[str, int, int]]:
    """(archive, offset, length) of each index line: ``offset length``, or a line that ends with a JSON object of them."""
    for line in text.splitlines():
        if not line.strip():
            continue
        brace = line.find(b"{")
        if brace >= 0:
            entry = json.loads(line[brace:])
            if not {"offset", "length"} <= set(entry):
                continue  # a header line
            named, offset, length = entry.get("filename"), int(entry["offset"]), int(entry["length"])
        else:
            named, (offset, length) = None, map(int, line.split())
        if named is None and len(archives) > 1:
            raise ValueError(f"{path}: {index} does not name the archive of a record, and there are {len(archives)}")
        name = next(iter(archives)) if named is None else named
        if name not in archives:
            raise ValueError(f"{path}: {index} names {name}, which is not in the package")
        yield name, offset, length


def contents(path: str, file: BinaryIO, size: int) -> dict[int, list[tuple[int, int]]]:
    """(offset, length) of all records by where their archive member begins, in order and once each.

    Archives are the members ``archive/*.warc.gz`` or ``archive/*.warc``, indexes the members
    ``indexes/*.cdx`` or ``.cdxj``, also with ``.gz``.  An archive has to be stored, as a record is
    read by its range, and has to be named by an index if it is not empty.
    """
    members = directory(file, size)
    archives = {
        m.name.removeprefix("archive/"): m for m in members if m.name.startswith("archive/") and m.name.endswith((".warc", ".warc.gz"))
    }
    indexes = [m for m in members if m.name.startswith("indexes/") and m.name.removesuffix(".gz").endswith((".cdx", ".cdxj"))]
    if not archives or not indexes:
        raise ValueError(f"{path}: no {'archive' if not archives else 'index'} in the package")
    for m in archives.values():
        if m.method:
            raise ValueError(f"{path}: {m.name} has to be stored, records are read by their ranges")
    found: dict[str, set[tuple[int, int]]] = {}
    for index in indexes:
        for name, offset, length in _places(path, index.name, _index_text(path, file, index), archives):
            if offset < 0 or length <= 0 or offset + length > archives[name].size:
                raise ValueError(f"{path}: {index.name} points outside {name}")
            found.setdefault(name, set()).add((offset, length))
    for name, m in archives.items():
        if m.size and name not in found:
            raise ValueError(f"{path}: no index names {name}")
    return {archives[name].start: sorted(places) for name, places in found.items()}


def locate(packages: DataFrame, block: int = 4 << 20) -> DataFrame:
    """Runs of adjoining records of about ``block`` bytes: path, start (in the package), and the records' lengths."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                filesystem, inner = _open(path)
                with filesystem.open_input_file(inner) as file:
                    found = contents(path, file, filesystem.get_file_info(inner).size)
                for member, places in found.items():
                    start, end, lengths = member, member, []
                    for offset, length in places:
                        if lengths and (member + offset != end or end + length - start > block):
                            yield out(path, start, lengths)
                            lengths = []
                        if not lengths:
                            start = member + offset
                        lengths.append(length)
                        end = member + offset + length
                    if lengths:
                        yield out(path, start, lengths)

    def out(path: str, start: int, lengths: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([path]), pa.array([start], pa.int64()), pa.array([lengths], pa.list_(pa.int64()))], ["path", "start", "lengths"]
        )

    return packages.select("path").mapInArrow(rows, "path string, start long, lengths array<long>")


def read_records(runs: DataFrame) -> DataFrame:
    """Records of the runs: page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest.

    Responses are measured on the payload read; a digest that differs from the record's own is an error.
    Revisits carry no payload (null) and tell length and digest of the one they refer to.  Records
    of other kinds give no rows.  Archives of others have no page ids (null); their digests are
    checked where they are hexadecimal SHA-256.
    """
    schema = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, lengths in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "lengths"))):
                filesystem, inner = _open(path)
                got = []
                with filesystem.open_input_file(inner) as file:
                    file.seek(start)
                    for length in lengths:
                        record = _read(file.read(length))
                        if record is not None:
                            got.append(record)
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*got), types)], names)

    def _read(packed: bytes) -> tuple | None:
        r = parse_record(packed)
        kind, page, url = r.get("WARC-Type"), _number(r.get("WARC-Page-ID")), r.get("WARC-Target-URI")
        if kind not in ("response", "revisit"):
            return None
        told = r.get("WARC-Payload-Digest", "")
        digest = told.removeprefix("sha256:") if told.startswith("sha256:") and len(told) == 71 else None
        if kind == "revisit":
            return page, url, kind, _number(r.get("WARC-Refers-To-Page-ID")), None, _number(r["http"].get("Content-Length")), digest
        own = hashlib.sha256(r["payload"]).hexdigest()
        if digest not in (None, own):
            raise ValueError(f"page {page}: payload and digest differ")
        return page, url, kind, None, r["payload"], len(r["payload"]), own

    # Runs are dealt anew, so that a large package is read by many tasks.
    return runs.repartition(F.xxhash64("path", "start")).mapInArrow(rows, schema)


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archive ``pages`` and give the packages' paths; ``folder`` defaults to a new one in the shared folder."""
    return write_packages(decide(pages), folder or new_path(pages.sparkSession, "archive"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload.  Of equal payloads of at least 100 bytes the smallest page_id is
    the response, others revisit it; a null page_id is always a response, and so are all rows that
    share the smallest one.  Further columns are ignored; no pages give no packages and no rows.
    """
    back = read_records(locate(archive(pages)))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: What the round trip has to give back.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
