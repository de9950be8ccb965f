"""Web archives: legacy ARC files are parsed by their version's header lines and declared lengths and become WARC files, which are read back."""

from __future__ import annotations

import base64
import contextlib
import hashlib
import io
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bounded_batches, released, work_folder, written
from .exact_dedup import beside_groups

#: Bytes before compression and records of an archive file: what one task converts.
FILE_BYTES, FILE_RECORDS = 64 << 20, 1 << 16
#: The fields of a record's header line by the version of the file, and the profile of a revisit.
ARC_FIELDS = {1: ("url", "ip", "date", "mime", "length"), 2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length")}
ARC_NAMES = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADER = "X-Page-Id"
SCANNED = "path string, nth long, page_id long, record_id string, url string, date string, payload_bytes long, digest binary, error string"
READ = "page_id long, record_id string, record_type string, refers string, url string, date string, payload_bytes long, payload_digest string, error string"


def opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a URI; Hadoop's file:/x is file:///x."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


@contextlib.contextmanager
def reading(path: str) -> Iterator[io.BufferedReader]:
    """A file as a stream, unpacked if it is compressed."""
    import gzip

    fs, name = opened(path)
    with fs.open_input_file(name) as f:
        packed = f.read(2) == b"\x1f\x8b"
        f.seek(0)
        yield io.BufferedReader(gzip.GzipFile(fileobj=f) if packed else f, 1 << 20)


def member(data: bytes) -> bytes:
    """A record as a gzip member of its own, so that a reader can begin at any record."""
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def plain_url(url: str | None) -> str:
    """A URL that fits in a header line: blanks, control characters and those above ASCII are escaped; null or empty is unknown:"""
    return urllib.parse.quote(url or "unknown:", safe="".join(chr(c) for c in range(33, 127)))


def http_response(page_id: int | None, payload: bytes) -> bytes:
    own = "" if page_id is None else f"{HEADER}: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def http_parts(content: bytes) -> tuple[bytes, bytes]:
    """Head, with its empty line, and payload of an HTTP message; what is none is all payload."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    found = re.search(rb"\r?\n\r?\n", content)
    return (content[: found.end()], content[found.end() :]) if found else (content, b"")


def http_header(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace") if found else None


def page_of(head: bytes) -> int | None:
    text = http_header(head, HEADER)
    return int(text) if text and re.fullmatch(r"-?\d+", text) else None


# ARC


def arc_head(name: str, version: int, date: str) -> bytes:
    """The first record of an ARC file: its name, its version and the fields of its header lines."""
    block = f"{version} 0 dupspark\n{ARC_NAMES[version]}\n".encode()
    tail = "" if version == 1 else f"200 - - 0 {name} "
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {tail}{len(block)}\n".encode() + block + b"\n"


def arc_record(version: int, name: str, offset: int, url: str, date: str, content: bytes) -> bytes:
    extra = "" if version == 1 else f"200 {base32(hashlib.sha1(content).digest())} - {offset} {name} "
    return f"{url} 0.0.0.0 {date} text/html {extra}{len(content)}\n".encode() + content + b"\n"


@dataclass
class Arc:
    """A record of an ARC file: the file's own name, the record's number in it, its header's fields, and as many bytes as it declares."""

    name: str
    nth: int
    fields: dict[str, str]
    content: bytes

    @property
    def date(self) -> str:
        """The header's digits as a WARC date: a short one begins its month, day or hour, one that is none is 1970."""
        digits = re.match(r"\d*", self.fields["date"])[0]
        full = (digits + "19700101000000"[len(digits) :])[:14] if len(digits) >= 4 else "19700101000000"
        return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"

    def record_id(self, sha1: bytes) -> str:
        """The same for the same file name, place and content, whenever it is converted."""
        return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{self.name} {self.nth} {self.fields["url"]} {self.date} {base32(sha1)}')}"


def arc_records(stream: io.BufferedReader) -> Iterator[Arc]:
    """The records after the file's own. Raises ValueError where a line has too few fields or bytes are missing."""

    def header(line: bytes, version: int) -> dict[str, str]:
        names = ARC_FIELDS[version]
        parts = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(names) - 1)  # older files have blanks in URLs
        if len(parts) < len(names) or not parts[-1].isdigit():
            raise ValueError(f"no header line of version {version}: {line[:80]!r}")
        return dict(zip(names, parts, strict=True))

    first = stream.readline()
    if not first.startswith(b"filedesc://") or not first.rstrip().rsplit(b" ", 1)[-1].isdigit():
        raise ValueError("not an ARC file")
    block = stream.read(int(first.rstrip().rsplit(b" ", 1)[-1]))
    number = block.split(b" ", 1)[0]
    if not number.isdigit() or int(number) not in ARC_FIELDS:
        raise ValueError(f"unknown version {number[:20]!r}")
    version, name = int(number), first[len(b"filedesc://") :].split(b" ", 1)[0].decode("utf-8", "replace")
    nth = 0
    while line := stream.readline():
        if not line.strip():
            continue
        fields = header(line, version)
        content = stream.read(int(fields["length"]))
        if len(content) < int(fields["length"]):
            raise ValueError(f"record {nth} ends after {len(content)} of {fields['length']} bytes")
        yield Arc(name, nth, fields, content)
        nth += 1


def write_arcs(pages: DataFrame, folder: str, date: str = "19700101000000", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes pages(page_id, url, html) as ARC files, one or more a task, of version 1 and 2 by turns; returns (path, records), written too.

    A file's path carries the attempt that wrote it and only files of attempts that succeeded are returned; what a lost
    attempt left is named nowhere. Its own name, inside, is the same in every attempt.
    """
    bounded_batches(pages.sparkSession)

    def run(batches):
        task = TaskContext.get()
        fs, top = opened(folder)
        fs.create_dir(top, recursive=True)
        seq, out, size, records = 0, None, 0, 0
        for batch in batches:
            for page_id, url, html in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if out is None:
                    name, version = f"pages-{task.partitionId():06d}-{seq:04d}.arc", 1 + (task.partitionId() + seq) % 2
                    path, size, records = f"{name[:-4]}-{task.taskAttemptId()}.arc.gz", 0, 0
                    out = fs.open_output_stream(f"{top}/{path}", compression=None)
                    out.write(member(arc_head(name, version, date)))
                record = arc_record(version, name, out.tell(), plain_url(url), date, http_response(page_id, (html or "").encode()))
                out.write(member(record))
                size, records = size + len(record), records + 1
                if size >= file_bytes or records >= FILE_RECORDS:
                    out.close()
                    yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path}"]), pa.array([records])], ["path", "records"])
                    seq, out = seq + 1, None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path}"]), pa.array([records])], ["path", "records"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return written(rows.mapInArrow(released(run), "path string, records long"))


def one_a_task(files: DataFrame) -> DataFrame:
    return files.repartition(max(1, files.count()))


def scan_arcs(files: DataFrame) -> DataFrame:
    """A row for every record of files(path), written: what its WARC record will be named, its payload's size and SHA-256. A file that breaks off has a last row with the error."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, nth = [], -1
                try:
                    with reading(path) as stream:
                        for arc in arc_records(stream):
                            nth = arc.nth
                            head, payload = http_parts(arc.content)
                            rows.append((path, nth, page_of(head), arc.record_id(hashlib.sha1(payload).digest()), arc.fields["url"], arc.date, len(payload), hashlib.sha256(payload).digest(), None))
                except (ValueError, EOFError, OSError, zlib.error) as e:
                    rows.append((path, nth + 1, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
                if rows:
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in SCANNED.split(", ")])

    return written(one_a_task(files.select("path")).mapInArrow(released(run), SCANNED))


# WARC


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).digest())}"), ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def converted(arc: Arc, refers: tuple[str, str, str] | None) -> bytes:
    """The WARC record of an ARC record. refers: id, URL and date of the record whose payload this one repeats; such a record keeps its HTTP head alone."""
    head, payload = http_parts(arc.content)
    sha1 = hashlib.sha1(payload).digest()
    kind = "revisit" if refers else "response" if head else "resource"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{arc.record_id(sha1)}>"), ("WARC-Date", arc.date), ("WARC-Target-URI", arc.fields["url"]), ("WARC-IP-Address", arc.fields["ip"]), ("WARC-Payload-Digest", f"sha1:{base32(sha1)}")]
    fields.append(("Content-Type", "application/http; msgtype=response" if head else arc.fields["mime"]))
    if refers:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers[0]}>"), ("WARC-Refers-To-Target-URI", refers[1]), ("WARC-Refers-To-Date", refers[2]), ("WARC-Truncated", "length")]
    return warc_record(fields, head if refers else arc.content)


def warc_records(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header (names in lower case) and block of each record. Raises ValueError where a header or bytes are missing."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        header = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            header[name.strip().lower()] = value.strip()
        size = header.get("content-length", "")
        if not line or not size.isdigit():
            raise ValueError("a header ends early or has no length")
        block = stream.read(int(size))
        if len(block) < int(size):
            raise ValueError(f"a block ends after {len(block)} of {size} bytes")
        yield header, block


def convert(scanned: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Converts the scanned ARC files to WARC files, one each, below folder; returns (path, records), written too.

    Of records whose payloads have one SHA-256 and at least `least` bytes, the one with the largest page_id is the
    response, null being smaller than any id and the last in file and place winning a tie; the others revisit it. Groups
    are counted before they are shuffled, and large ones are sent to their records. A file that broke off is
    converted up to there.
    """
    good = scanned.where("error is null")
    last = F.max(F.struct("page_id", "path", "nth", "record_id", "url", "date"))
    groups = good.where(F.col("payload_bytes") >= least).groupBy("digest").agg(last.alias("keep"), F.count("*").alias("group_size")).where("group_size > 1")
    repeats = beside_groups(good.select("digest", "path", "nth", "record_id"), written(groups), good.count()).where(F.col("record_id") != F.col("keep.record_id"))
    decided = good.select("path", "nth", F.lit(None).cast("struct<record_id:string,url:string,date:string>").alias("refers"))
    decided = decided.unionByName(repeats.select("path", "nth", F.struct("keep.record_id", "keep.url", "keep.date").alias("refers")))

    def run(part: pa.Table) -> pa.Table:
        path = part["path"][0].as_py()
        refers = {nth: tuple(r.values()) for nth, r in zip(part["nth"].to_pylist(), part["refers"].to_pylist(), strict=True) if r}
        fs, top = opened(folder)
        fs.create_dir(top, recursive=True)
        name = re.sub(r"-\d+\.arc(\.gz)?$|\.arc(\.gz)?$", "", path.rsplit("/", 1)[-1]) + f"-{TaskContext.get().taskAttemptId()}.warc.gz"
        records = 0
        with reading(path) as stream, fs.open_output_stream(f"{top}/{name}", compression=None) as out:
            with contextlib.suppress(ValueError, EOFError, OSError, zlib.error):  # the scan has told
                for arc in arc_records(stream):
                    if not arc.nth:
                        about = f"software: dupspark\r\nformat: WARC File Format 1.1\r\nconverted-from: {arc.name}\r\n".encode()
                        out.write(member(warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, arc.name)}>"), ("WARC-Date", arc.date), ("Content-Type", "application/warc-fields")], about)))
                    out.write(member(converted(arc, refers.get(arc.nth))))
                    records += 1
        return pa.table([pa.array([f"{folder}/{name}"]), pa.array([records])], ["path", "records"])

    files = good.select("path").distinct().count()
    return written(decided.repartition(max(1, files), "path").groupBy("path").applyInArrow(run, "path string, records long"))


def read_warcs(files: DataFrame) -> DataFrame:
    """A row for every response, resource and revisit of files(path): payload size and digest of the full payload, told by the HTTP head of a revisit.

    The digest of a payload that is there is taken again; one that differs from its header gives an error, as does a
    record that breaks off.
    """

    def row(header: dict[str, str], block: bytes):
        kind = header["warc-type"]
        head, payload = http_parts(block)
        told, error, size = header.get("warc-payload-digest", "").removeprefix("sha1:"), None, len(payload)
        if kind == "revisit":
            length = http_header(head, "Content-Length")
            size = int(length) if length and length.isdigit() else None
        elif (own := base32(hashlib.sha1(payload).digest())) != told:
            error, told = "the payload is not what its digest says", own
        bare = lambda name: header[name].strip("<>") if name in header else None
        return page_of(head), bare("warc-record-id"), kind, bare("warc-refers-to"), header.get("warc-target-uri"), header.get("warc-date"), size, told, error

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                try:
                    with reading(path) as stream:
                        rows += [row(h, b) for h, b in warc_records(stream) if h.get("warc-type") in ("response", "resource", "revisit")]
                except (ValueError, EOFError, OSError, zlib.error) as e:
                    rows.append((None, None, None, None, path, None, None, None, f"{type(e).__name__}: {e}"))
                if rows:
                    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in READ.split(", ")])

    return written(one_a_task(files.select("path")).mapInArrow(released(run), READ))


def archived(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every row of pages(page_id, url, html), through ARC and WARC files below folder.

    A payload is the html in UTF-8, null being empty; ids, repeated rows and nulls as in convert(); a null URL is
    unknown:. Long pages are held one at a time. Other columns aren't read; an empty table gives no rows.
    """
    spark: SparkSession = pages.sparkSession
    folder = folder or work_folder(spark)
    arcs = write_arcs(pages, f"{folder}/arc")
    records = read_warcs(convert(scan_arcs(arcs), f"{folder}/warc", least))
    revisits, rest = records.where("record_type = 'revisit'"), records.where("record_type <> 'revisit'")
    shown = lambda df, refers: df.select("page_id", "payload_bytes", "payload_digest", "record_type", refers.alias("refers_to"))
    asked = revisits.groupBy("refers").agg(F.count("*").alias("group_size"))
    found = asked.join(rest.select(F.col("record_id").alias("refers"), F.col("page_id").alias("target")), "refers").select(F.col("refers").alias("digest"), "target", "group_size")
    pointed = beside_groups(revisits.withColumn("digest", F.col("refers")), written(found), records.count())
    return shown(rest, F.lit(None).cast("long")).unionByName(shown(pointed, F.col("target")))


ARCHIVED_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
     d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, max(page_id) OVER (PARTITION BY h) AS keep,
           list_reduce(list_transform(range(0, 40, 5), lambda i: list_reduce(list_transform([15, 10, 5, 0], lambda b:
             substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(s, CAST(i AS INTEGER) + 1, 5) AS INTEGER) >> b) & 31) + 1 AS INTEGER), 1)), lambda x, y: x || y)), lambda x, y: x || y) AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keep THEN keep END AS refers_to FROM d
"""
