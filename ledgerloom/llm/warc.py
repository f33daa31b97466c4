"""WARC archives packed in ZIP files: written by Spark tasks, read back by range.

Writing: tasks write ZIP files (through Spark's text writer, so with its commit protocol and on any
file system it reaches). A ZIP holds up to ZIP_MEMBERS pairs of stored members:
`archive/data-N.warc.gz`, WARC/1.1 records each in a gzip member of its own, of about MEMBER_BYTES
together, and `indexes/data-N.cdxj`, one JSON line per record with its offset and length inside the
archive member. A full ZIP is always the same number of pieces, by which the writer begins the next
file, so files stay near 64 MB. ZIP64 records are written where 32-bit fields are too small, or
always if asked. The writer's line ends fall between members; the last one is the ZIP's comment.

Reading: the end-of-directory record, the ZIP64 record if there is one, and the central directory
give each member's place; the index gives each record's; records are then read by range and checked
against their digests. Nothing is extracted. Only the ranges are read, on local and shared paths and on
stores that pyarrow opens by their URI; on stores that only Spark reaches, each file's bytes come once
through Spark's binaryFile source, which takes files up to 2 GB, and the ranges are taken from them.

Archives of other writers are read too. An archive member without an index of its own uses a common
one (`indexes/*.cdxj` or `.cdx`, plain or gzipped; JSON lines, with or without key and time before the JSON); without
any, its gzip members are walked from its start. A deflated archive member is inflated in its task. Records other than
response, resource and revisit are left out. Without a digest header the payload's SHA-1 is given, without a
length header a revisit's length is null; page_id and refers_to are null where the ids are not this writer's.

Payloads are UTF-8 html (null: empty); a record is built whole in its task, so a very long page
takes its own size there, and makes its member and file as long. Of equal payloads of at least min_bytes, the smallest
page_id is a response and the others revisit it. Repeated rows of that page_id are responses too;
null page_ids come after all others. Other columns are left out, whatever their names. An empty table writes no
archive and reads back no rows.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import salted_lookup, ship

ship(__name__)

MEMBER_BYTES = 8 << 20
ZIP_MEMBERS = 8
DATE = "2020-01-01T00:00:00Z"
LIMIT32, LIMIT16 = 0xFFFFFFFF, 0xFFFF
KEPT_TYPES = ("response", "resource", "revisit")
#: Bytes read at a time where a member is walked.
WALK_BYTES = 1 << 20
RECORD = "page_id long, record_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, path string, offset long, length long"


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with digest (hex SHA-1) and refers_to (null: a response)."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("html"), F.sha1(payload).alias("digest"))
    alike = rows.where(F.octet_length("html") >= min_bytes).select("page_id", "digest")
    firsts = alike.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    rows = salted_lookup(rows, firsts, "digest", F.col("page_id"))
    return rows.select("page_id", "url", "html", "digest", F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("refers_to"))


def _b32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    urn = lambda i: f"<urn:page:{'' if i is None else i}>"
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{_b32(digest)}",
        f"Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Zip:
    """Pieces of one ZIP file; after each piece the text writer adds a line end, which offsets count."""

    def __init__(self, always64: bool):
        self.at, self.entries, self.always64 = 0, [], always64

    def member(self, name: str, data: bytes) -> bytes:
        crc, big, raw = binascii.crc32(data), self.always64 or len(data) >= LIMIT32, name.encode()
        sizes = struct.pack("<II", *[LIMIT32 if big else len(data)] * 2)
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if big else b""
        head = struct.pack("<IHHHHHI", 0x04034B50, 45 if big else 20, 0, 0, 0, 33, crc) + sizes + struct.pack("<HH", len(raw), len(extra)) + raw + extra
        self.entries.append((raw, crc, len(data), self.at))
        piece = head + data
        self.at += len(piece) + 1
        return piece

    def directory(self) -> bytes:
        out, start = [], self.at
        for raw, crc, n, at in self.entries:
            wide = [v for v in (n, n, at) if self.always64 or v >= LIMIT32]
            extra = struct.pack(f"<HH{len(wide)}Q", 1, 8 * len(wide), *wide) if wide else b""
            low = lambda v: LIMIT32 if self.always64 or v >= LIMIT32 else v
            out.append(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45 if wide else 20, 0, 0, 0, 33, crc, low(n), low(n), len(raw), len(extra), 0, 0, 0, 0, low(at)) + raw + extra)
        body = b"".join(out)
        count, end64 = len(self.entries), b""
        if self.always64 or count >= LIMIT16 or start + len(body) >= LIMIT32:
            end64 = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, count, count, len(body), start)
            end64 += struct.pack("<IIQI", 0x07064B50, 0, start + len(body), 1)
            tail = (LIMIT16, LIMIT16, LIMIT32, LIMIT32)
        else:
            tail = (count, count, len(body), start)
        return body + end64 + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, *tail, 1)


def _write_zips(member_bytes: int, zip_members: int, always64: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of one ZIP after the other; full ones are 2 * zip_members + 1 pieces."""
        packed, rows, size, number = [], [], 0, 0
        out = _Zip(always64)
        piece = lambda data: pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["piece"])

        def close():
            name = f"data-{number:05d}"
            yield piece(out.member(f"archive/{name}.warc.gz", b"".join(packed)))
            yield piece(out.member(f"indexes/{name}.cdxj", "".join(json.dumps(r) + "\n" for r in rows).encode()))

        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                record = _gzip(_record(page_id, url, html, digest, refers_to))
                rows.append({"id": page_id, "offset": size, "length": len(record)})
                packed.append(record)
                size += len(record)
                if size >= member_bytes:
                    yield from close()
                    packed, rows, size, number = [], [], 0, number + 1
                    if len(out.entries) == 2 * zip_members:
                        yield piece(out.directory())
                        out = _Zip(always64)
        if rows:
            yield from close()
        if out.entries:
            yield piece(out.directory())

    return write


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, member_bytes: int = MEMBER_BYTES, zip_members: int = ZIP_MEMBERS, always64: bool = False) -> None:
    """Write pages (page_id, url, html) as WARC records in ZIP files under path."""
    rows = plan_records(pages, min_bytes).withColumn("html", F.col("html").cast("binary"))
    pieces = rows.mapInArrow(_write_zips(member_bytes, zip_members, always64), "piece binary")
    pieces.select(F.col("piece").cast("string")).write.option("compression", "none").option("maxRecordsPerFile", 2 * zip_members + 1).text(path)


def _local(path: str) -> str | None:
    url = urlparse(path)
    return url.path if url.scheme in ("", "file") else None


def _opened(path: str):
    """(file system, path in it) of a URI, by pyarrow."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _by_range(path: str) -> bool:
    """Whether ranges of the files under path can be read without Spark."""
    if _local(path) is not None:
        return True
    try:
        from pyarrow import fs

        store, root = _opened(path)
        return store.get_file_info(root).type != fs.FileType.NotFound
    except (OSError, ValueError, ImportError, NotImplementedError):
        return False


def _ranges(path: str, content: bytes | None) -> tuple[int, Callable[[int, int], bytes]]:
    """Size of a file and a function that reads (offset, length) of it."""
    if content is not None:
        return len(content), lambda at, n: content[at : at + n]
    if _local(path) is None:
        store, name = _opened(path)
        file = store.open_input_file(name)
        ranged = lambda at, n: bytes(file.read_at(n, at)) if n > 0 else b""
        ranged.close = file.close
        return file.size(), ranged
    fd = os.open(_local(path), os.O_RDONLY)

    def read(at: int, n: int) -> bytes:
        parts = []
        while n > 0 and (part := os.pread(fd, n, at)):
            parts.append(part)
            at, n = at + len(part), n - len(part)
        return b"".join(parts)

    read.close = lambda: os.close(fd)
    return os.fstat(fd).st_size, read


def zip_members(size: int, read: Callable[[int, int], bytes]) -> list[tuple[str, int, int, bool]]:
    """(name, offset of the data, size there, whether deflated) of a ZIP's stored and deflated members, from its central directory."""
    tail_at = max(0, size - 22 - LIMIT16)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if LIMIT16 == count or LIMIT32 in (length, start):
        magic, _, at, _ = struct.unpack("<IIQI", read(tail_at + end - 20, 20))
        if magic != 0x07064B50:
            raise ValueError("no ZIP64 locator")
        count, length, start = struct.unpack("<QQQ", read(at, 56)[32:56])
    directory, at, out = read(start, length), 0, []
    for _ in range(count):
        method, packed, full, n_name, n_extra, n_comment = struct.unpack_from("<10xH8xIIHHH", directory, at)
        local = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + n_name].decode()
        extra, at = directory[at + 46 + n_name : at + 46 + n_name + n_extra], at + 46 + n_name + n_extra + n_comment
        if LIMIT32 in (packed, full, local):
            e = 0
            while e + 4 <= len(extra):
                kind, n = struct.unpack_from("<HH", extra, e)
                if kind == 1:
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                    full = next(wide) if full == LIMIT32 else full
                    packed = next(wide) if packed == LIMIT32 else packed
                    local = next(wide) if local == LIMIT32 else local
                e += 4 + n
        if method in (0, 8):
            n_name, n_extra = struct.unpack("<HH", read(local + 26, 4))
            out.append((name, local + 30 + n_name + n_extra, packed, method == 8))
    return out


def parse_record(data: bytes) -> dict:
    """Headers and payload of one WARC record; the digest of a response is checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode(errors="replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(headers["content-length"])]
    kind, record_id = headers["warc-type"], headers.get("warc-record-id", "")
    payload = block if kind == "resource" else block.partition(b"\r\n\r\n")[2]
    named = headers.get("warc-payload-digest", "")
    digest = named.removeprefix("sha1:") if named.startswith("sha1:") or kind == "revisit" else None
    size = int(headers["payload-length"]) if headers.get("payload-length", "").isdigit() else None
    if kind != "revisit":
        size, own = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if digest is not None and own != digest.upper():
            raise ValueError(f"{record_id}: the payload differs from its digest")
        digest = own
    ours = lambda urn: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")) else None
    return {"page_id": ours(record_id), "record_id": record_id, "url": headers.get("warc-target-uri", ""), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": ours(headers.get("warc-refers-to")), "payload": payload}


FIELDS = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
PLACES = pa.schema([("path", pa.string()), ("name", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("deflated", pa.bool_()), ("index_name", pa.string()), ("index_at", pa.int64()), ("index_size", pa.int64()), ("index_deflated", pa.bool_())])


def _member_places(size: int, read: Callable[[int, int], bytes]) -> list[dict]:
    """Where a ZIP's archive members and the indexes that may name their records stand."""
    members = {name: (at, n, deflated) for name, at, n, deflated in zip_members(size, read)}
    common = next((name for name in sorted(members) if re.fullmatch(r"indexes/.*\.cdxj?(\.gz)?", name)), None)
    out = []
    for name, (at, n, deflated) in members.items():
        if name.startswith("archive/") and name.endswith(".warc.gz"):
            own = "indexes/" + name[8:].removesuffix(".warc.gz") + ".cdxj"
            index = own if own in members else common
            place = members[index] if index else (None, None, None)
            out.append({"name": name, "at": at, "size": n, "deflated": deflated, "index_name": index, "index_at": place[0], "index_size": place[1], "index_deflated": place[2]})
    return out


def _index_entries(data: bytes, name: str, archive: str) -> list[tuple[int, int]]:
    """(offset, length) of the archive member's records, in order; lines that name another file are left out."""
    if name.endswith(".gz"):
        packed, data = data, b""
        while packed:
            data += (d := zlib.decompressobj(31)).decompress(packed)
            packed = d.unused_data
    out = []
    for line in data.splitlines():
        if (cut := line.find(b"{")) >= 0:
            entry = json.loads(line[cut:])
            if "offset" in entry and "length" in entry and entry.get("filename", archive) in (archive, archive.rpartition("/")[2]):
                out.append((int(entry["offset"]), int(entry["length"])))
    return sorted(out)


def _walked(size: int, read: Callable[[int, int], bytes]) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, data) of the gzip members that follow each other in so many bytes."""
    at = start = 0
    held = b""
    while start < size:
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not held:
                held = read(at, min(WALK_BYTES, size - at))
                at += len(held)
                if not held:
                    raise ValueError("a record is cut off")
            parts.append(unpacker.decompress(held))
            held = unpacker.unused_data
        length = at - len(held) - start
        yield start, length, b"".join(parts)
        start += length


def _member_records(path: str, member: dict, read: Callable[[int, int], bytes]) -> pa.RecordBatch:
    base, n, within = member["at"], member["size"], read
    if member["deflated"]:
        inflated = zlib.decompress(read(base, n), -15)
        base, n, within = 0, len(inflated), lambda at, k: inflated[at : at + k]
    entries = []
    if member["index_name"]:
        index = read(member["index_at"], member["index_size"])
        entries = _index_entries(zlib.decompress(index, -15) if member["index_deflated"] else index, member["index_name"], member["name"])
    if entries:
        found = ((at, length, zlib.decompress(within(base + at, length), 31)) for at, length in entries)
    else:
        found = _walked(n, lambda at, k: within(base + at, k))
    rows = []
    for at, length, data in found:
        head = data[: data.find(b"\r\n\r\n")].lower()
        if re.search(rb"warc-type:\s*(%s)" % "|".join(KEPT_TYPES).encode(), head):
            record = parse_record(data)
            record.pop("payload")
            rows.append(record | {"path": path, "offset": base + at, "length": length})
    return pa.RecordBatch.from_pylist(rows, FIELDS)


def _list_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            if row["length"]:
                size, read = _ranges(row["path"], None)
                yield pa.RecordBatch.from_pylist([m | {"path": row["path"]} for m in _member_places(size, read)], PLACES)
                read.close()


def _read_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            _, read = _ranges(row["path"], None)
            yield _member_records(row["path"], row, read)
            read.close()


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of whole files, one member after the other."""
    for batch in batches:
        for path, content in zip(*batch.columns):
            if len(content.as_py()):
                size, read = _ranges(path.as_py(), content.as_py())
                for member in _member_places(size, read):
                    yield _member_records(path.as_py(), member, read)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the ZIP files under path: its headers and where it stands (path, offset, length; in the inflated member if that is deflated)."""
    files = spark.read.format("binaryFile").load(path)
    if not _by_range(path):
        return files.select("path", "content").mapInArrow(_read_files, RECORD)
    members = files.select("path", "length").mapInArrow(_list_members, "path string, name string, at long, size long, deflated boolean, index_name string, index_at long, index_size long, index_deflated boolean")
    return members.mapInArrow(_read_members, RECORD)
