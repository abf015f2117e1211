"""Legacy archives: pages to ARC files, ARC files to WARC files, and WARC files read again.

An ARC file starts with a version block; its second line gives the version and so the fields of
every header line. Records are cut out by their declared lengths. What WARC needs and ARC lacks is
synthesised: record ids from the archive's name and the record's offset, ISO timestamps, record
types and SHA-256 digests.

Records are bytes of any encoding. Tasks pack them into archives of about ARCHIVE_BYTES, or of one
record, and each archive is a row that Spark's text writer writes as it is to a file of its own, with
the separator that the format asks for after each record; so archives can go to any file system that
Spark writes to. An archive is parsed as a whole.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.llm import bloom
from quarrylane.llm.common import attach, portions, scratch, stash

#: Fields of a header line, by version.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
#: Payloads from this size on may be revisits.
LEAST_REVISIT = 100
#: Bytes of records from which on an archive is closed.
ARCHIVE_BYTES = 1 << 24
PAGE_HEADER = "X-Page-Id"
DATE = "20260101000000"


def version_block(version: int, name: str) -> str:
    lines = f"{version} 0 Quarrylane\n{' '.join(ARC_FIELDS[version])}\n"
    values = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": DATE, "Content-type": "text/plain", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(lines))}
    return f"{' '.join(values[f] for f in ARC_FIELDS[version])}\n{lines}"


def _archive(records: list[bytes], separator: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([separator.join(records)], pa.binary())], names=["value"])


def _write(archives: DataFrame, folder: str, separator: str, compression: str) -> None:
    """A file for each row of bytes."""
    rows = archives.select(F.col("value").cast("string"))
    rows.write.option("lineSep", separator).option("compression", compression).option("maxRecordsPerFile", 1).mode("append").text(folder)


def _to_arc(version: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[bytes] = []
        offset, name = 0, ""
        for batch in portions(batches, 2):
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not out:
                    name = f"{uuid.uuid4().hex}.arc"
                    out.append(version_block(version, name).encode())
                    offset = len(out[0]) + 1
                body = html or b""
                mark = "" if page is None else f"{PAGE_HEADER}: {page}\r\n"
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{mark}Content-Length: {len(body)}\r\n\r\n".encode() + body
                values = {"URL": (url or "-").replace("\r", "%0D").replace("\n", "%0A") or "-", "IP-address": "0.0.0.0", "Archive-date": DATE, "Content-type": "text/html", "Result-code": "200", "Checksum": hashlib.md5(block).hexdigest(), "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(len(block))}
                out.append(" ".join(values[f] for f in ARC_FIELDS[version]).encode() + b"\n" + block)
                offset += len(out[-1]) + 1
                if offset >= limit:
                    yield _archive(out, b"\n")
                    out = []
        if out:
            yield _archive(out, b"\n")

    return run


def write_arc(pages: DataFrame, folder: str, version: int = 1, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", compression: str = "gzip") -> None:
    """Write ARC files of one version with an HTTP response for each row (text or bytes; null html: empty)."""
    rows = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("binary"))
    _write(rows.mapInArrow(_to_arc(version, ARCHIVE_BYTES), "value binary"), folder, "\n", compression)


@dataclass
class ArcRecord:
    """A record; one without fields is what was skipped between records."""

    offset: int
    fields: dict[str, str]
    block: bytes
    is_version: bool = False
    is_cut: bool = False


#: What a header line has for an address, and the day or time that comes after it.
ADDRESS = re.compile(r"[0-9A-Fa-f]*[.:][0-9A-Fa-f.:]+")
STAMP = re.compile(r"\d{8,14}")


def header_fields(line: str, names: list[str]) -> dict[str, str] | None:
    """The fields of a header line; None if it is none.

    The length is last, the date is a number after an address; what is before them is the URL and what
    is between the date and the fields that end the line is the content type, both with spaces if
    need be. Of several such dates the last before a word with a slash, else the last, is taken.
    """
    words = line.split(" ")
    ends = len(names) - names.index("Content-type") - 1
    if not words[-1].isdigit() or not words[-1].isascii():
        return None
    places = [i for i in range(2, len(words) - ends - 1) if STAMP.fullmatch(words[i])]
    places = [i for i in places if ADDRESS.fullmatch(words[i - 1])] or places
    typed = [i for i in places if "/" in words[i + 1] or words[i + 1] in ("-", "no-type", "unknown")]
    if not places:
        return None
    at = (typed or places)[-1]
    values = [" ".join(words[: at - 1]), words[at - 1], words[at], " ".join(words[at + 1 : len(words) - ends]), *words[len(words) - ends :]]
    return dict(zip(names, values, strict=True))


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an archive, its version block first.

    A version block is at the start only; a later record is a page, whatever its URL. Lines that are
    no header are skipped to the next one that is, and given as a record without fields. A block that
    ends before its declared length is given as far as it is there, and marked.
    """
    names, at, lost = ARC_FIELDS[1], 0, 0
    while at < len(data):
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].rstrip(b"\r").decode("utf-8", "replace")
        is_version = at == 0 and line.startswith("filedesc://")
        if is_version and end >= 0:
            # the version is on the next line, and says how to read this one
            second = data[end + 1 : data.find(b"\n", end + 1)].split(b" ")
            names = ARC_FIELDS.get(int(second[0]) if second[0].isdigit() else 1, ARC_FIELDS[1])
        fields = header_fields(line, names) if end >= 0 else None
        if fields is None:
            at = end + 1 if end >= 0 else len(data)
            continue
        if data[lost:at].strip(b"\r\n"):
            yield ArcRecord(lost, {}, data[lost:at])
        block = data[end + 1 : end + 1 + int(fields["Archive-length"])]
        yield ArcRecord(at, fields, block, is_version, len(block) < int(fields["Archive-length"]))
        at = end + 1 + int(fields["Archive-length"])
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        lost = at
    if data[lost:].strip(b"\r\n"):
        yield ArcRecord(lost, {}, data[lost:])


def plain(data: bytes) -> bytes:
    """An archive's bytes, without gzip."""
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def iso_date(stamp: str) -> str:
    """14 digits (shorter ones are filled up) as an ISO time in UTC."""
    s = (stamp + "00000101000000"[len(stamp) :])[:14]
    return f"{s[:4]}-{s[4:6]}-{s[6:8]}T{s[8:10]}:{s[10:12]}:{s[12:14]}Z"


def http_parts(block: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """Head with its empty line, payload, and header fields; no head without an HTTP status line."""
    cut = block.find(b"\r\n\r\n") + 4
    if not block.startswith(b"HTTP/") or cut < 4:
        return b"", block, {}
    lines = block[: cut - 4].decode("utf-8", "replace").split("\r\n")[1:]
    return block[:cut], block[cut:], {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _number(x: str | None) -> int | None:
    return int(x) if x and x.lstrip("-").isdigit() else None


ARC_ROW = "record_id string, kind string, uri string, date string, ip string, page_id long, head binary, payload binary, payload_bytes long, payload_digest string, is_cut boolean"


def _from_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in ARC_ROW.split(", ")]
    types = [{"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}[x.split()[1]] for x in ARC_ROW.split(", ")]
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows: list[tuple] = []
            size = 0
            for r in parse_arc(plain(data.as_py())):
                bare = r.is_version or not r.fields
                head, payload, http = (b"", r.block, {}) if bare else http_parts(r.block)
                place = f"{path.rsplit('/', 1)[-1]}#{r.offset}"
                name = r.fields["URL"] if r.is_version else place
                kind = "warcinfo" if r.is_version else "skipped" if not r.fields else "response" if head else "resource"
                uri, date = r.fields.get("URL", place), r.fields.get("Archive-date")
                rows.append((str(uuid.uuid5(uuid.NAMESPACE_URL, name)), kind, uri, iso_date(date) if date else None, r.fields.get("IP-address"), _number(http.get(PAGE_HEADER.lower())), head, payload, len(payload), hashlib.sha256(payload).hexdigest(), r.is_cut))
                size += len(payload)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def read_arc(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all archives in a folder; heads and payloads are bytes.

    What is no record comes as kind ``skipped``, with its archive and offset as uri; a block that ends before
    its declared length has ``is_cut``.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    return files.mapInArrow(_from_arc, ARC_ROW)


def damage(spark: SparkSession, folder: str) -> DataFrame:
    """Counts over the archives of a folder: records, skipped stretches and their bytes, records that are cut."""
    skipped = F.col("kind") == "skipped"
    return read_arc(spark, folder).agg(F.count_if(~skipped).alias("records"), F.count_if(skipped).alias("skipped"), F.coalesce(F.sum(F.when(skipped, F.col("payload_bytes"))), F.lit(0)).alias("skipped_bytes"), F.count_if("is_cut").alias("cut"))


def _record(kind: str, fields: list[tuple[str, Column]], block: Column) -> Column:
    """A WARC record as bytes, without the two line ends after it."""
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\n"), *[F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")) for k, v in fields], F.when(F.col("is_cut"), "WARC-Truncated: unspecified\r\n").otherwise("")]
    head = F.concat(*lines, F.lit("WARC-Block-Digest: sha256:"), F.sha2(block, 256), F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head.cast("binary"), block)


def _to_warc(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[bytes] = []
        size = 0
        for batch in batches:
            for value in batch.column(0):
                out.append(value.as_py())
                size += len(out[-1])
                if size >= limit:
                    yield _archive(out, b"\r\n\r\n")
                    out, size = [], 0
        if out:
            yield _archive(out, b"\r\n\r\n")

    return run


def convert(spark: SparkSession, arc_folder: str, warc_folder: str, compression: str = "gzip") -> None:
    """Write WARC files from ARC files.

    Of records with equal payloads of LEAST_REVISIT bytes or more, the one with the smallest page id
    (null ids last, then by record id) is the response and the others are revisits of it. Payloads
    of records that can't be revisits don't shuffle. Records that are cut say so (WARC-Truncated); what
    is no record isn't carried over, ``damage`` counts it.
    """
    records = read_arc(spark, arc_folder).filter("kind <> 'skipped'")
    narrow = stash(records.filter("kind = 'response'").select("record_id", "page_id", "payload_digest", "payload_bytes"), "payloads")
    large = narrow.filter(F.col("payload_bytes") >= LEAST_REVISIT)
    first = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "record_id")).alias("first")
    groups = stash(large.groupBy("payload_digest").agg(first, F.count("*").alias("n")).filter("n > 1"), "equal")
    again = attach(large, groups, "payload_digest", "n", max(1, narrow.count())).filter("record_id <> first.record_id")
    again = stash(again.select("record_id", F.col("first.record_id").alias("refers_to")), "revisits")

    log2 = bloom.log_bits(again.count())
    bitmaps = bloom.build(again.select(F.xxhash64("record_id").alias("key")), "key", log2)
    flagged = bloom.flag(records, F.xxhash64("record_id"), bitmaps, log2, "maybe")
    alone = flagged.filter(~F.col("maybe")).withColumn("refers_to", F.lit(None).cast("string"))
    shared = flagged.filter("maybe").join(again, "record_id", "left")
    urn = lambda c: F.concat(F.lit("<urn:uuid:"), F.col(c), F.lit(">"))
    common = [("WARC-Record-ID", urn("record_id")), ("WARC-Date", F.col("date"))]
    target = [("WARC-Target-URI", F.col("uri")), ("WARC-IP-Address", F.col("ip")), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest")))]
    http = [("Content-Type", F.lit("application/http; msgtype=response"))]
    revisit = [("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To", urn("refers_to"))]
    text = F.concat("head", "payload")
    value = (
        F.when(F.col("kind") == "warcinfo", _record("warcinfo", [*common, ("Content-Type", F.lit("application/warc-fields"))], text))
        .when(F.col("kind") == "resource", _record("resource", [*common, *target, ("Content-Type", F.lit("application/octet-stream"))], text))
        .when(F.col("refers_to").isNull(), _record("response", [*common, *target, *http], text))
        .otherwise(_record("revisit", [*common, *target, *revisit, *http], F.col("head")))
    )
    out = alone.unionByName(shared).select(value.alias("value"))
    _write(out.mapInArrow(_to_warc(ARCHIVE_BYTES), "value binary"), warc_folder, "\r\n\r\n", compression)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record, by declared lengths."""
    at = data.find(b"WARC/")
    while at >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + size]
        at = data.find(b"WARC/", end + 4 + size)


WARC_ROW = "record_id string, record_type string, page_id long, payload_bytes long, payload_digest string, refers_id string"


def _from_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in WARC_ROW.split(", ")]
    types = [pa.int64() if x.endswith("long") else pa.string() for x in WARC_ROW.split(", ")]
    bare = lambda x: x.removeprefix("<urn:uuid:").removesuffix(">")
    for batch in batches:
        for data in batch.column(0):
            rows = []
            for fields, block in parse_warc(plain(data.as_py())):
                kind = fields["warc-type"]
                if kind not in ("response", "revisit"):
                    continue
                _, payload, http = http_parts(block)
                if kind == "revisit":
                    size, digest, refers = None, None, bare(fields["warc-refers-to"])
                else:
                    size, digest, refers = len(payload), hashlib.sha256(payload).hexdigest(), None
                    if fields["warc-payload-digest"] != f"sha256:{digest}":
                        raise ValueError(f"payload digest of {fields['warc-record-id']}")
                rows.append((bare(fields["warc-record-id"]), kind, _number(http.get(PAGE_HEADER.lower())), size, digest, refers))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """One row per response and revisit: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Payloads are measured and their digests checked; a revisit has those of the record it refers to.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    records = stash(files.mapInArrow(_from_warc, WARC_ROW), "records")
    responses, revisits = records.filter("refers_id is null"), records.filter("refers_id is not null").select("page_id", "record_type", "refers_id")
    counts = revisits.groupBy("refers_id").agg(F.count("*").alias("n"))
    targets = responses.select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    groups = stash(counts.join(targets, "refers_id"), "targets")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    back = attach(revisits, groups, "refers_id", "n", max(1, records.count())).select(columns)
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(columns).unionByName(back)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages to ARC (even hashes of the id as version 1, odd ones as 2), to WARC, and read back.

    One row per input row. html may be text or bytes of any encoding; null is an empty payload, a null id stays null and loses to others,
    a null url is written as ``-``. Of rows that repeat id and payload, one is the response. An
    empty table gives no rows.
    """
    spark = pages.sparkSession
    arc, out = scratch(spark, "arc"), scratch(spark, "warc")
    half = F.xxhash64(F.col(id_col)).bitwiseAND(F.lit(1))
    for version, side in ((1, half == 0), (2, half == 1)):
        write_arc(pages.filter(side), arc, version, id_col, url_col, html_col)
    convert(spark, arc, out)
    return read_warc(spark, out)
