"""Web archives: pages as legacy ARC files, converted to WARC, and both read back by declared lengths.

ARC 1 and 2 begin with a ``filedesc:`` record whose body names the version and its header fields; every record is one
header line, whose last field is the length of what follows, and that many bytes. The converter parses the header line
by the fields of its file's version and makes the WARC record: type from the scheme and content type, identifier from a
digest of the record, timestamp from the 14 digits, block and payload digests from the bytes.

Files are written by Spark's text writer (gzip), each record one value, so that lost tasks leave no trace; a file holds
what one task wrote, so the size of the input's splits bounds it, and it is unpacked and parsed whole.

Nulls and ties: null html and url are empty; a null page_id is written empty and read back as null. The smallest non-null
page_id of equal payloads is the response, and so is each repeated row of that page; if all are null, all are responses.
An empty table gives no records.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.session import ensure_checkpoint_dir

ARC_FIELDS = {
    "1": ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    "2": ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename",
          "Archive-length"),
}
ARCHIVE_DATE = "20240101000000"
IP = "0.0.0.0"
MIN_REVISIT_BYTES = 100
CRLF = "\r\n"
END = "\r\n\r\n"


def arc_header(version: str, values: dict[str, str]) -> str:
    return " ".join(values.get(f, "-") for f in ARC_FIELDS[version])


def arc_filedesc(version: str, date: str = ARCHIVE_DATE) -> str:
    """Version record of an ARC file, without the line feed that ends it."""
    body = f"{version} 0 pages\n" + " ".join(ARC_FIELDS[version]) + "\n"
    size = len(body.encode())
    return arc_header(version, {"URL": "filedesc://pages.arc", "IP-address": IP, "Archive-date": date, "Content-type": "text/plain",
                                "Result-code": "200", "Archive-length": str(size)}) + "\n" + body


def arc_record(version: str, page_id, url: str, html: str, date: str = ARCHIVE_DATE) -> str:
    payload = html.encode()
    head = CRLF.join(("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8",
                      f"X-Page-Id: {'' if page_id is None else page_id}", f"Content-Length: {len(payload)}")) + END
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url) or "about:blank"
    return arc_header(version, {"URL": target, "IP-address": IP, "Archive-date": date, "Content-type": "text/html", "Result-code": "200",
                                "Archive-length": str(len(head) + len(payload))}) + "\n" + head + html


def parse_arc(data: bytes):
    """(header fields, content) of every record of an ARC file, the version record included."""
    at, fields = 0, None
    while at < len(data):
        if data[at:at + 1] == b"\n":  # the line feed that ends a record
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].decode()
        if fields is None:
            if not line.startswith("filedesc:"):
                raise ValueError("an ARC file begins with its version record")
            size = int(line.rsplit(" ", 1)[1])
            version = data[end + 1:end + 1 + size].split(b" ", 1)[0].decode()
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version}")
            fields = ARC_FIELDS[version]
        values = dict(zip(fields, line.split(" ")))
        if len(values) != len(fields) or len(line.split(" ")) != len(fields):
            raise ValueError(f"header line with other than {len(fields)} fields: {line[:80]}")
        size = int(values["Archive-length"])
        content = data[end + 1:end + 1 + size]
        if len(content) != size:
            raise ValueError("a record is shorter than declared")
        yield values, content
        at = end + 1 + size


def http_parts(content: bytes) -> tuple[bytes, dict[str, str], bytes]:
    head, _, payload = content.partition(b"\r\n\r\n")
    lines = head.decode().split(CRLF)
    return head + b"\r\n\r\n", dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:]), payload


def warc_type(values: dict[str, str]) -> str:
    url = values["URL"]
    if url.startswith("filedesc:"):
        return "warcinfo"
    return "response" if values["Content-type"] != "text/dns" and not url.startswith("dns:") else "resource"


def warc_date(digits: str) -> str:
    d = digits.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(*parts: str | bytes) -> str:
    digest = hashlib.sha256(b"\0".join(p.encode() if isinstance(p, str) else p for p in parts)).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=digest[:16], version=5)}>"


def page_record_id(page_id, digest: str) -> str:
    """Identifier of a page's record, which its revisits can name without looking it up."""
    return record_id("page", str(page_id), digest)


def warc_record(kind: str, fields: list[tuple[str, str]], block: bytes) -> str:
    """One WARC record, without the two line ends that close it."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields),
             f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return CRLF.join(lines) + END + block.decode()


def parse_warc(data: bytes):
    """(header fields, block) of every record of a WARC file, by declared lengths; block digests are verified."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split(CRLF)
        if not first.startswith("WARC/1."):
            raise ValueError(f"no WARC record begins at {at}")
        fields = dict(x.split(": ", 1) for x in lines)
        start, size = end + 4, int(fields["Content-Length"])
        block = data[start:start + size]
        if len(block) != size or data[start + size:start + size + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where it is declared to")
        if fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
            raise ValueError("a block does not match its digest")
        yield fields, block
        at = start + size + 4


def _write(records: DataFrame, path: str, terminator: str) -> None:
    (records.write.option("lineSep", terminator).option("compression", "gzip").mode("overwrite").text(path))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def _unpacked(batch) -> list[bytes]:
    return (gzip.decompress(x.as_py()) for x in batch.column("content"))


def write_arc(pages: DataFrame, path: str) -> None:
    """ARC files of version 1 or 2 under ``path``, one for each split of the input."""

    def records(batches):
        version = None
        for batch in batches:
            out = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")))
            for i, (page_id, url, html) in enumerate(rows):
                if version is None:
                    version = "12"[(page_id or 0) % 2]
                    out.append((None, arc_filedesc(version)))
                out.append((None, arc_record(version, page_id, url or "", html or "")))
            yield pa.RecordBatch.from_arrays([pa.array([x for _, x in out], pa.string())], names=["value"])

    _write(pages.select("page_id", "url", "html").mapInArrow(records, "value string"), path, "\n")


def convert(spark: SparkSession, arc_path: str) -> DataFrame:
    """WARC material of every ARC record: page_id, url, date, kind, digest, payload_bytes, head, payload."""

    def records(batches):
        names = ("page_id", "url", "date", "kind", "record_id", "digest", "payload_bytes", "head", "payload")
        types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
        for batch in batches:
            for data in _unpacked(batch):
                out = []
                for values, content in parse_arc(data):
                    kind = warc_type(values)
                    if kind == "warcinfo":
                        continue
                    head, http, payload = http_parts(content)
                    page = http.get("X-Page-Id") or None
                    digest = hashlib.sha256(payload).hexdigest()
                    own = page_record_id(page, digest) if page else record_id(values["URL"], digest, str(len(out)))
                    out.append((None if page is None else int(page), values["URL"], warc_date(values["Archive-date"]), kind, own,
                                digest, len(payload), head.decode(), payload.decode()))
                columns = list(zip(*out)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return _files(spark, arc_path).mapInArrow(
        records, "page_id long, url string, date string, kind string, record_id string, digest string, payload_bytes long, "
                 "head string, payload string")


def with_revisits(records: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Records with ``refers_to``, the page of the response, where an equal payload has a smaller page_id.

    Only digests that occur under several pages are joined.
    """
    first = (records.where(F.col("payload_bytes") >= min_bytes).groupBy("digest")
             .agg(F.min("page_id").alias("_first"), F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_n"),
                  F.count("page_id").alias("_known"))
             .where("_first < _last or _n > _known").select("digest", "_first"))
    joined = records.join(first, "digest", "left")
    other = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return joined.select(*records.columns, F.when(other, F.col("_first")).alias("refers_to"))


def write_warc(records: DataFrame, path: str) -> None:
    """WARC files under ``path``; each begins with a warcinfo record. Revisits keep the HTTP head and leave the payload out."""

    def render(batches):
        first = True
        for batch in batches:
            out = []
            if first:
                info = b"format: WARC File Format 1.1\r\nconformsTo: ARC conversion\r\n"
                out.append(warc_record("warcinfo", [("WARC-Record-ID", record_id("warcinfo", info)), ("WARC-Date", warc_date(ARCHIVE_DATE)),
                                                    ("Content-Type", "application/warc-fields")], info))
                first = False
            for r in batch.to_pylist():
                fields = [("WARC-Record-ID", r["record_id"]), ("WARC-Date", r["date"]), ("WARC-Target-URI", r["url"]),
                          ("WARC-Payload-Digest", f"sha256:{r['digest']}"), ("Content-Type", "application/http; msgtype=response")]
                kind, block = r["kind"], r["head"] + r["payload"]
                if r["refers_to"] is not None:
                    kind, block = "revisit", r["head"]
                    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                               ("WARC-Refers-To", page_record_id(r["refers_to"], r["digest"])), ("WARC-Refers-To-Page", str(r["refers_to"]))]
                out.append(warc_record(kind, fields, block.encode()))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    _write(records.mapInArrow(render, "value string"), path, END)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page record under ``path``."""

    def records(batches):
        for batch in batches:
            for data in _unpacked(batch):
                out = []
                for fields, block in parse_warc(data):
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    _, http, payload = http_parts(block)
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    if fields["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError("a payload does not match its digest")
                    page, other = http.get("X-Page-Id") or None, fields.get("WARC-Refers-To-Page")
                    out.append((None if page is None else int(page), int(http["Content-Length"]), digest, fields["WARC-Type"],
                                None if other is None else int(other)))
                columns = list(zip(*out)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))],
                    names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return _files(spark, path).mapInArrow(
        records, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Pages through ARC files, the converter and WARC files under ``folder`` (default: the checkpoint folder), read back."""
    spark = pages.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark)}/archives-{uuid.uuid4().hex}"
    write_arc(pages, f"{folder}/arc")
    write_warc(with_revisits(convert(spark, f"{folder}/arc")), f"{folder}/warc")
    return read_warc(spark, f"{folder}/warc")
