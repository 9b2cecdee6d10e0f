"""Legacy archive converter: ARC files of versions 1 and 2 become WARC records.

An ARC file begins with a version block whose lines name the version and the fields of the records' header lines;
each record is its header line, as many bytes as that declares, and a line feed. The converter reads records by their
declared lengths, takes the HTTP header off, and makes up what WARC has beyond ARC: a record identifier (a version-5
UUID of address, date and payload), an ISO date, the type, and SHA-1 digests of payload and block in base32. The version
block becomes a warcinfo record. Records whose payload occurred before point to that one (revisit) and hold no payload
of their own.

Archives are of bounded size, and each record in them is a gzip member of its own. They are written by Spark's text sink
as they are, one file each; its line separator is an empty gzip member. They are read back whole.

Cases: null html is an empty payload; a payload may hold anything, separators and header lines too; of rows with equal
payloads those with the smallest page_id are responses (several, where rows repeat) and a null page_id counts as the
largest; a payload larger than an archive has one for itself; archives may be plain, gzip as a whole or in members; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wheelmark.llm.shared import field, join_rare, picked, shared_dir, written

#: Bytes after which an archive is closed.
ARCHIVE_BYTES = 16 << 20
#: The header lines' fields by version, as version blocks state them.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:wheelmark:arc-record")
END = b"\r\n\r\n"
LEVEL = 3


#: Bytes that are unpacked at a time: what is left of them behind a member is copied.
STEP = 1 << 13


def member(data: bytes) -> bytes:
    """A gzip member, the same for the same data."""
    return zlib.compress(data, LEVEL, 31)


NOTHING = member(b"")


def unpacked(data: bytes) -> bytes:
    """All gzip members of the data, one after the other (zeros between them are padding); data that is not gzip as it is."""
    if data[:2] != b"\x1f\x8b":
        return data
    parts, at, view = [], 0, memoryview(data)
    while at < len(data):
        if data[at] == 0:
            at += 1
            continue
        one = zlib.decompressobj(31)
        while not one.eof:
            if at >= len(data):
                raise ValueError("a gzip member is cut off")
            parts.append(one.decompress(view[at : at + STEP]))
            at = min(at + STEP, len(data)) - len(one.unused_data)
    return b"".join(parts)


def write_archives(archives: DataFrame, path: str) -> None:
    """One file for each row's ``archive`` (gzip members), byte for byte, and an empty member behind it."""
    values = archives.select(F.col("archive").cast("string").alias("value"))
    values.write.option("encoding", "ISO-8859-1").option("lineSep", NOTHING.decode("latin-1")).option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``archive``: the files in the folder, as they are."""
    return spark.read.format("binaryFile").load(path).select(F.col("content").alias("archive"))


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- ARC --------------------------------------------------------------------------------------------------------


def version_block(version: int, name: str, date: str) -> bytes:
    first = f"{version} 0 converter\n{' '.join(FIELDS[version])}\n".encode()
    values = [f"filedesc://{name}", "0.0.0.0", date, "text/plain"]
    if version == 2:
        values += ["200", "-", "-", "0", name]
    return " ".join([*values, str(len(first))]).encode() + b"\n" + first + b"\n"


def arc_record(version: int, url: str, ip: str, date: str, status: int, block: bytes, name: str, offset: int) -> bytes:
    values = [re.sub(r"\s", "%20", url) or "-", ip, date, "text/html"]
    if version == 2:
        values += [str(status), hashlib.md5(block).hexdigest(), "-", str(offset), name]
    return " ".join([*values, str(len(block))]).encode() + b"\n" + block + b"\n"


def read_arc(data: bytes) -> Iterator[dict]:
    """The version block (with "Version") and the records of an ARC file, by declared length; the block states which
    fields a header line has."""
    at, fields = 0, None
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        values = data[at:end].decode("utf-8", "replace").split(" ")
        size = int(values[-1])
        block = data[end + 1 : end + 1 + size]
        if len(block) < size:
            raise ValueError(f"a record at {at} declares {size} bytes; {len(block)} are there")
        at = end + 1 + size
        if fields is None:
            # The version block: what the file says of itself.
            if not values[0].startswith("filedesc:"):
                raise ValueError("an ARC file begins with its version block")
            lines = block.decode("utf-8", "replace").split("\n")
            version = int(lines[0].split(" ")[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version}")
            fields = tuple(lines[1].split(" ")) if len(lines) > 1 and lines[1] else FIELDS[version]
            yield {"URL": values[0], "IP-address": values[1], "Archive-date": values[2], "Content-type": values[3], "Version": str(version), "block": block}
            continue
        # An address may hold blanks in old files: what is too much belongs to it.
        extra = len(values) - len(fields)
        if extra < 0:
            raise ValueError(f"{len(values)} fields instead of {len(fields)}")
        yield dict(zip(fields, [" ".join(values[: extra + 1]), *values[extra + 1 :]], strict=True)) | {"block": block}


def pages_to_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "20240101000000", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """``archive``: ARC files of the pages (gzip members), in turn of either version. The page's id is a field of the HTTP header."""
    rows = picked(pages, id=id_col, url=url_col, html=html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, parts, size = 0, [], 0
        for batch in batches:
            for key, url, html in zip(batch["id"].to_pylist(), batch["url"].to_pylist(), batch["html"].to_pylist(), strict=True):
                version = made % 2 + 1
                if not parts:
                    name = f"part-{uuid.uuid4().hex}.arc"
                    parts, size = [member(version_block(version, name, date))], 0
                body = (html or "").encode()
                head = f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n" + (f"X-Page-Id: {key}\r\n" if key is not None else "") + "\r\n"
                record = arc_record(version, url or "-", "0.0.0.0", date, 200, head.encode() + body, name, size)
                parts.append(member(record))
                size += len(record)
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["archive"])
                    made, parts = made + 1, []
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["archive"])

    return rows.mapInArrow(run, "archive binary")


# --- conversion -------------------------------------------------------------------------------------------------

RECORDS = "record_type string, record_id string, url string, date string, ip string, media_type string, page_id string, http_head binary, payload binary, payload_bytes bigint, payload_digest string"


def convert(archives: DataFrame, archive_col: str = "archive") -> DataFrame:
    """What WARC records need, one row for each ARC record (response) and version block (warcinfo)."""
    rows = picked(archives, archive=archive_col)

    def converted(record: dict) -> tuple:
        d = record["Archive-date"].ljust(14, "0")
        date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
        block, head, page = record["block"], b"", None
        if "Version" in record:
            body, kind = b"".join(f"{k}: {v}\r\n".encode() for k, v in (("software", "wheelmark"), ("format", "WARC File Format 1.1"), ("arc-version", record["Version"]), ("arc-fields", " ".join(FIELDS[int(record["Version"])])))), "warcinfo"
        else:
            kind = "response"
            head, mark, body = block.partition(END) if block.startswith(b"HTTP/") else (b"", b"", block)
            own = re.search(rb"(?im)^X-Page-Id: ([^\r\n]+)", head)
            head, page = head + mark, own[1].decode() if own else None
        digest = base32_sha1(body)
        name = uuid.uuid5(NAMESPACE, f"{record['URL']} {d} {digest} {page or ''}")
        return kind, f"<urn:uuid:{name}>", record["URL"], date, record["IP-address"], record["Content-type"], page, head, body, len(body), digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch["archive"]:
                held, size = [], 0
                for record in read_arc(unpacked(data.as_py() or b"")):
                    held.append(converted(record))
                    size += held[-1][9]
                    if size >= 4 << 20:
                        yield _records(held)
                        held, size = [], 0
                if held:
                    yield _records(held)

    return rows.mapInArrow(run, RECORDS)


def _records(held: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 7 + [pa.binary(), pa.binary(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names=[x.split()[0] for x in RECORDS.split(", ")])


def with_revisits(records: DataFrame, id_type: str = "bigint", least_bytes: int = 0) -> DataFrame:
    """Makes later records of a payload revisits, and adds refers_to (the id of the response) and refers_record.

    Only records whose digest may occur twice or more travel; a digest that very many share goes to them by broadcast.
    """
    own = F.col("page_id").cast(id_type)
    plain = (F.col("record_type") == "response") & (F.col("payload_bytes") >= least_bytes)
    repeated = (
        records.where(plain)
        .groupBy("payload_digest")
        .agg(F.min(own).alias("first_id"), F.min_by(F.struct("record_id", "url", "date"), own).alias("first"), F.count("*").alias("many"))
        .where("many > 1")
    )
    revisit = plain & F.col("first_id").isNotNull() & ~own.eqNullSafe(F.col("first_id"))
    joined = join_rare(records, written(repeated, "repeated"), "payload_digest", "many", 400)
    return joined.withColumns(
        {
            "refers_to": F.when(revisit, F.col("first_id")),
            "refers_record": F.when(revisit, F.col("first")),
            "record_type": F.when(revisit, F.lit("revisit")).otherwise(F.col("record_type")),
        }
    ).drop("first", "first_id", "many")


# --- WARC -------------------------------------------------------------------------------------------------------


def warc_record(row: dict) -> bytes:
    """One record."""
    revisit, about = row["record_type"] == "revisit", row["record_type"] == "warcinfo"
    block = row["http_head"] if revisit else row["http_head"] + row["payload"]
    head = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: {row['record_id']}",
        f"WARC-Date: {row['date']}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
    ]
    if about:
        head.append(f"WARC-Filename: {row['url'].removeprefix('filedesc://')}")
    else:
        head += [f"WARC-Target-URI: {row['url']}", f"WARC-IP-Address: {row['ip']}", f"WARC-Payload-Digest: sha1:{row['payload_digest']}", f"X-Payload-Length: {row['payload_bytes']}"]
    if row["page_id"] is not None:
        head.append(f"X-Page-Id: {row['page_id']}")
    if revisit:
        first = row["refers_record"]
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {first['record_id']}", f"WARC-Refers-To-Target-URI: {first['url']}", f"WARC-Refers-To-Date: {first['date']}", f"X-Refers-To-Page: {row['refers_to']}"]
    kind = "application/warc-fields" if about else "application/http; msgtype=response" if row["http_head"] else row["media_type"]
    head += [f"Content-Type: {kind}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block + END


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, by declared length."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.index(END, at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        size = int(head["Content-Length"])
        at = end + 4 + size
        if at > len(data):
            raise ValueError("a record is cut off")
        yield head, data[end + 4 : at]


def write_warc(records: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """WARC files of about ``archive_bytes`` (before gzip) in the folder ``path``, a gzip member for each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                record = warc_record(row)
                parts.append(member(record))
                size += len(record)
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["archive"])
                    parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["archive"])

    write_archives(records.mapInArrow(run, "archive binary"), path)


WARC_FIELDS = "page_id string, record_id string, url string, date string, record_type string, refers_to string, payload_bytes bigint, payload_digest string, payload binary, intact boolean"


def read_warcs(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the WARC files in ``path``. intact: lengths and digests agree with what is there."""

    def one(head: dict[str, str], block: bytes) -> tuple:
        kind = head["WARC-Type"]
        http, mark, body = block.partition(END) if block.startswith(b"HTTP/") else (b"", b"", block)
        stated = head.get("WARC-Payload-Digest", head["WARC-Block-Digest"]).removeprefix("sha1:")
        size = int(head.get("X-Payload-Length", head["Content-Length"]))
        intact = head["WARC-Block-Digest"] == f"sha1:{base32_sha1(block)}" and (kind == "revisit" or base32_sha1(body) == stated and len(body) == size)
        return head.get("X-Page-Id"), head["WARC-Record-ID"], head.get("WARC-Target-URI", head.get("WARC-Filename")), head["WARC-Date"], kind, head.get("X-Refers-To-Page"), size, stated, body if payloads and kind != "revisit" else None, intact

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.binary(), pa.bool_()]
        for batch in batches:
            for data in batch["archive"]:
                held = [one(*x) for x in read_warc(unpacked(data.as_py()))]
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names=[x.split()[0] for x in WARC_FIELDS.split(", ")])

    return read_archives(spark, path).mapInArrow(run, WARC_FIELDS)


def pages_as_warc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Pages to ARC files, these to WARC files (both in the shared folder), and what the latter hold: id, payload_bytes,

    payload_digest, record_type, refers_to, and record_id, url, date, intact. Payloads stay in the files (``read_warcs``)."""
    spark, kind = pages.sparkSession, field(pages, id_col)
    legacy, path = shared_dir(spark, "arc"), shared_dir(spark, "warc")
    write_archives(pages_to_arc(pages, id_col, url_col, html_col, archive_bytes=archive_bytes), legacy)
    # Written once: digests are counted and records are made from it.
    records = written(convert(read_archives(spark, legacy)), "records", "zstd")
    write_warc(with_revisits(records, kind, least_bytes), path, archive_bytes)
    back = read_warcs(spark, path, payloads=False).where("record_type <> 'warcinfo'")
    return back.select(F.col("page_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "record_id", "url", "date", "intact")
