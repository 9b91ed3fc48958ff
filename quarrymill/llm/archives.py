"""Legacy web archives: ARC files, their conversion to WARC, and reading WARC back.

Pages are written as ARC files of both versions (the version of a file is in its
first record). The converter reads the version, takes the header lines' fields in
that version's order, cuts contents by the declared lengths, and synthesises WARC
identifiers, timestamps, types and digests. Every record is a gzip member of its
own. A file is one value of Spark's text sink; the line separator behind it is an
empty gzip member, so that the file is a sequence of whole members.

Which records are revisits is decided on ``(page_id, digest, size, place)`` alone.
Contents meet these decisions by file, never by digest: copies of one page, however
many, stay in the files that hold them.

Defined cases: null html is an empty payload; a null or blank url becomes
``urn:x-page:<id>``, blanks and control characters in urls are escaped; a null id
stays null, and its record is a response; rows that repeat the largest id of a
payload are all responses, and revisits refer to the last of them by place. An
empty table gives no archives and an empty result. Files may be compressed or
plain; one that is cut off or declares a length that is none raises an error that
names it. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.shared import named
from quarrymill.storage import Scratch, new_path

# The field names of both ARC versions, in order.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: A gzip member of nothing.
EMPTY = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
WARC_INFO = b"software: quarrymill\r\nformat: WARC File Format 1.0\r\n"


def plain_url(url: str | None, page_id: int | None) -> str:
    if url is None or not url.strip():
        return f"urn:x-page:{'none' if page_id is None else page_id}"
    return re.sub(r"[\x00-\x20\x7f-\x9f\s]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def http_header(page_id: int | None, length: int) -> bytes:
    mark = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{mark}Content-Length: {length}\r\n\r\n".encode()


def member(data: bytes, level: int = 4) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def inflated(raw: bytes, path: str) -> bytes:
    """The members of a file, one behind the other; plain files as they are."""
    if raw[:2] != b"\x1f\x8b":
        return raw
    out = []
    try:
        while raw:
            unpack = zlib.decompressobj(31)
            out.append(unpack.decompress(raw) + unpack.flush())
            if not unpack.eof:
                raise ValueError(f"{path} is cut off within a compressed record")
            raw = unpack.unused_data
    except zlib.error as e:
        raise ValueError(f"{path} holds broken compressed data: {e}") from e
    return b"".join(out)


def declared(value: str | None, path: str, at: int) -> int:
    if value is None or not value.isascii() or not value.isdigit():
        raise ValueError(f"{path}: the record at byte {at} declares {value!r} for its length")
    return int(value)


def write_files(rows: DataFrame, path: str) -> None:
    """Each row's ``value`` as a file."""
    rows.select(F.col("value").cast("string")).write.option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``path`` and ``content`` of all files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def arc_file_header(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 quarrymill\n{ARC_FIELDS[version]}\n".encode()
    tail = f" 200 - - 0 {name}" if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{tail} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, date: str, content: bytes, name: str) -> bytes:
    tail = f" 200 {hashlib.md5(content).hexdigest()} - 0 {name}" if version == 2 else ""
    return f"{url} 0.0.0.0 {date} text/html{tail} {len(content)}\n".encode() + content + b"\n"


def write_arc(pages: DataFrame, path: str, file_bytes: int = 4 << 20, date: str = "20240101000000", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """ARC files of about ``file_bytes`` of content, versions 1 and 2 by turns, straight from the pages' partitions."""
    rows = pages.select(named(id_col).cast("long").alias("id"), named(url_col).cast("string").alias("url"), F.coalesce(named(html_col).cast("string"), F.lit("")).cast("binary").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, held, size = 0, [], 0
        for b in batches:
            for at in range(0, b.num_rows, 100):
                for page, url, html in zip(*(b.column(i).slice(at, 100).to_pylist() for i in range(3)), strict=True):
                    version, name = 1 + count % 2, f"pages-{count:06d}.arc"
                    if not held:
                        held.append(member(arc_file_header(version, name, date)))
                    held.append(member(arc_record(version, plain_url(url, page), date, http_header(page, len(html)) + html, name)))
                    size += len(html) + 300
                    if size >= file_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])
                        count, held, size = count + 1, [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])

    write_files(rows.mapInArrow(run, "value binary"), path)


def parse_arc(data: bytes, path: str = "the file") -> Iterator[tuple[dict, bytes]]:
    """Header fields and content of every record but the file's own."""
    at, fields = 0, ARC_FIELDS[1].split()
    while at < len(data):
        line_end = data.find(b"\n", at)
        line = data[at : line_end if line_end >= 0 else len(data)].decode("utf-8", "replace").strip()
        begin, at = at, (line_end + 1 if line_end >= 0 else len(data))
        if not line:
            continue
        values = line.split(" ")
        length = declared(values[-1], path, begin)
        content, at = data[at : at + length], at + length
        if len(content) < length:
            raise ValueError(f"{path}: the record at byte {begin} is cut off")
        if values[0].startswith("filedesc:"):  # tells the version and the order of fields
            head = content.decode("utf-8", "replace").split("\n")
            version = head[0].split(" ")[0]
            fields = head[1].split() if len(head) > 1 and head[1].strip() else ARC_FIELDS.get(int(version) if version.isdigit() else 1, ARC_FIELDS[1]).split()
            continue
        if len(values) > len(fields):  # an old url with blanks in it
            values = ["%20".join(values[: len(values) - len(fields) + 1]), *values[len(values) - len(fields) + 1 :]]
        yield dict(zip(fields, values, strict=False)), content


def split_http(content: bytes) -> tuple[bytes, bytes]:
    end = content.find(b"\r\n\r\n")
    return (content[: end + 4], content[end + 4 :]) if content.startswith(b"HTTP/") and end >= 0 else (b"", content)


def header_value(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*(.*?)\r?$", head)
    return found[1].decode("utf-8", "replace") if found else None


def page_of(http: bytes) -> int | None:
    found = header_value(http, "X-Page-Id")
    return int(found) if found and found.lstrip("-").isdigit() else None


def arc_rows(raw: bytes, path: str) -> Iterator[tuple[int, int | None, str, str, str, bytes, bytes, str]]:
    """Number, page, url, date, ip, HTTP header, payload and its digest of a file's records."""
    for n, (fields, content) in enumerate(parse_arc(inflated(raw, path), path)):
        http, payload = split_http(content)
        d = fields.get("Archive-date", "").ljust(14, "0")
        yield n, page_of(http), fields["URL"], f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z", fields.get("IP-address", "0.0.0.0"), http, payload, hashlib.sha1(payload).hexdigest()


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """``path, n, page_id, url, date, payload_bytes, payload_digest`` of ARC records."""
    names = ["path", "n", "page_id", "url", "date", "payload_bytes", "payload_digest"]
    schema = pa.schema(list(zip(names, [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()], strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                out = [(at, n, page, url, date, len(payload), digest) for n, page, url, date, _, _, payload, digest in arc_rows(raw.as_py(), at)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, schema.types, strict=True)], schema=schema)

    return read_files(spark, path).mapInArrow(run, "path string, n int, page_id long, url string, date string, payload_bytes long, payload_digest string")


def record_id(page_id: int | None, digest: str, place: str, n: int) -> str:
    """Unique in a conversion: the file's name and the record's number are part of it."""
    return f"<urn:x-page:{'none' if page_id is None else page_id}:{hashlib.sha1(f'{digest} {place} {n}'.encode()).hexdigest()}>"


def place_of(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def warc_record(lines: list[str], block: bytes) -> bytes:
    return "\r\n".join(["WARC/1.0", *lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def convert_to_warc(spark: SparkSession, arc: str, path: str, least: int = 1000, task_bytes: int = 32 << 20) -> None:
    """A WARC file for each ARC file; equal payloads of ``least`` bytes and more are kept once."""
    tables = Scratch(spark)
    records = tables.keep(read_arc(spark, arc), "arc-records")
    original = F.max(F.struct("page_id", "path", "n", "url", "date")).alias("original")
    groups = records.filter((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()).groupBy("payload_digest", "payload_bytes").agg(original, F.min("page_id").alias("first")).filter(F.col("first") != F.col("original.page_id")).drop("first")
    again = records.join(groups, ["payload_digest", "payload_bytes"]).filter(F.col("page_id") != F.col("original.page_id"))
    # A file's decisions are as many as its records at most, and files are of bounded size.
    decided = again.groupBy("path").agg(F.collect_list(F.struct("n", "original")).alias("revisits"))
    # Partitions of about ``task_bytes`` of payloads, so that tasks don't grow with the archives. A
    # file meets its decisions in one shuffle: a join would shuffle once more wherever the session
    # asks for more partitions than these.
    parts = int((records.agg(F.sum("payload_bytes")).first()[0] or 0) // task_bytes) + 1
    both = read_files(spark, arc).unionByName(decided, allowMissingColumns=True).repartition(parts, "path")
    files = both.groupBy("path").agg(F.first("content", ignorenulls=True).alias("content"), F.first("revisits", ignorenulls=True).alias("revisits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                at, raw, revisits = (b.column(c)[i].as_py() for c in range(3))
                first = {r["n"]: r["original"] for r in revisits or []}
                info = ["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:x-file:{place_of(at)}>", "Content-Type: application/warc-fields"]
                out = [member(warc_record(info, WARC_INFO))]
                for n, page, url, date, ip, http, payload, digest in arc_rows(raw, at):
                    code, to = base64.b32encode(bytes.fromhex(digest)).decode(), first.get(n)
                    block = http + payload if to is None else http
                    lines = [f"WARC-Type: {'response' if to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page, digest, place_of(at), n)}", f"WARC-Date: {date}", f"WARC-Target-URI: {url}", f"WARC-IP-Address: {ip}"]
                    if to is not None:
                        lines += [f"WARC-Refers-To: {record_id(to['page_id'], digest, place_of(to['path']), to['n'])}", f"WARC-Refers-To-Target-URI: {to['url']}", f"WARC-Refers-To-Date: {to['date']}", f"WARC-Profile: {REVISIT_PROFILE}"]
                    lines += [f"WARC-Payload-Digest: sha1:{code}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}", "Content-Type: application/http; msgtype=response"]
                    out.append(member(warc_record(lines, block)))
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], ["value"])

    write_files(files.mapInArrow(run, "value binary"), path)
    tables.drop("arc-records")


def parse_warc(data: bytes, path: str = "the file") -> Iterator[tuple[bytes, bytes]]:
    """Header and block of every record."""
    at = 0
    while (begin := data.find(b"WARC/1.", at)) >= 0:
        end = data.find(b"\r\n\r\n", begin)
        head = data[begin : end + 4]
        length = declared(header_value(head, "Content-Length") if end >= 0 else None, path, begin)
        block = data[end + 4 : end + 4 + length]
        if len(block) < length:
            raise ValueError(f"{path}: the record at byte {begin} is cut off")
        yield head, block
        at = end + 4 + length


def sha1_of(value: str | None) -> str | None:
    """The hex digest of a header's SHA-1, in base 32 or hex; null for what is absent or another kind."""
    kind, _, code = (value or "").partition(":")
    try:
        found = bytes.fromhex(code) if len(code) == 40 else base64.b32decode(code.upper())
    except ValueError:
        return None
    return found.hex() if kind.lower() == "sha1" and len(found) == 20 else None


def referred_page(name: str | None) -> int | None:
    """The page number in a name that this module gave."""
    found = re.match(r"<urn:x-page:(-?\d+):", name or "")
    return int(found[1]) if found else None


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per page record: sizes and digests of full payloads, types and what revisits refer to.

    Of other writers' files: a response without a SHA-1 digest gets that of its payload, a revisit without one or without
    a length has null there, and ``refers_to`` is null where a record's name has no page number.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()], strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                out = []
                for head, block in parse_warc(inflated(raw.as_py(), at), at):
                    kind = header_value(head, "WARC-Type")
                    if kind not in ("response", "revisit"):
                        continue
                    http, payload = split_http(block)
                    digest, real = sha1_of(header_value(head, "WARC-Payload-Digest")), hashlib.sha1(payload).hexdigest()
                    if kind == "response" and (digest or real) != real:
                        raise ValueError(f"{at}: the payload of {header_value(head, 'WARC-Record-ID')} doesn't have its digest")
                    told = header_value(http, "Content-Length")
                    size = len(payload) if kind == "response" else declared(told, at, 0) if told else None
                    out.append((page_of(http), size, real if kind == "response" else digest, kind, referred_page(header_value(head, "WARC-Refers-To")), header_value(head, "WARC-Target-URI")))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, schema.types, strict=True)], schema=schema)

    return read_files(spark, path).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def archive_pages(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Pages through ARC and WARC files in the shared folder, and back."""
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc)
    convert_to_warc(spark, arc, warc, least)
    return read_warc(spark, warc).drop("url")
