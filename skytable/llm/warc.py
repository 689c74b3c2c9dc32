"""WARC archives: a writer of one gzip member per record, and a salvage reader that survives damage.

Writing goes through Spark's text sink, so any file system Spark knows will do: a member's bytes are
one row, and the sink's separator is the zero byte in which every member ends (the top byte of its
length field; a record of 16 MB or more gets an empty member behind it). The archives are thus plain
``.warc.gz`` content, about ARCHIVE_BYTES of payload each.

The reader takes each archive apart on its own. Where a member or a record fails a check (CRC,
header, length, digest, end of record), it looks for the next place at which a whole valid record
begins, goes on from there, and logs the bytes in between as a gap. The same is done within the
content of a member, also with what a member that is cut or broken gave before; of that, only records
count whose digest is right.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytable.functions.storage import checkpointed, fresh_path, written

ARCHIVE_BYTES = 32 << 20
# Payloads of fewer bytes are never written as revisits.
LEAST_SHARED = 100
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_END = b"\r\n\r\n"
_FEED = 1 << 16
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_BEGINS = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit of another page's response without."""
    kind = "response" if refers_to is None else "revisit"
    block = _HTTP + (payload if refers_to is None else b"")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE),
              ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}"),
              ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20]+", "%20", url)))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + _END


def member_bytes(record: bytes) -> bytes:
    """A gzip member that ends in a zero byte; where its length field does not, an empty member follows."""
    def packed(data: bytes) -> bytes:
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        return c.compress(data) + c.flush()
    out = packed(record)
    return out if out[-1] == 0 else out + packed(b"")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 200):
            rows = batch.slice(start, 200).to_pylist()
            out = [member_bytes(record_bytes(r["page_id"], r["url"], (r["html"] or "").encode(), r["digest"], r["refers_to"]))[:-1] for r in rows]
            yield pa.RecordBatch.from_pydict({"member": pa.array(out, pa.binary())})


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write one record per row of ``pages`` (page_id, url, html; null html: empty) into archives under ``path``.

    Of equal payloads of at least LEAST_SHARED bytes, the smallest page_id is written whole and the
    others as revisits of it. A row without a page_id is always written whole. Rows that repeat a
    page_id together with its payload are written alike.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"),
                        F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    slim = checkpointed(rows.select("page_id", "digest", "bytes"))
    total = slim.agg(F.sum(F.col("bytes") + 512)).first()[0] or 0
    shared = slim.filter(F.col("bytes") >= LEAST_SHARED).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    revisits = slim.join(shared, "digest").filter("page_id != refers_to").select("page_id", "digest", "refers_to").distinct()
    placed = rows.repartition(max(1, -(-total // archive_bytes)), "page_id", "digest").join(revisits, ["page_id", "digest"], "left")
    members = placed.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(_pack, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\u0000").text(path)


@dataclass
class Record:
    """A record, or a gap where ``reason`` is set, at [start, end) of an archive."""

    start: int
    end: int
    fields: dict[str, str]
    payload: bytes = b""
    reason: str | None = None


class Damaged(Exception):
    """A check that failed; ``content`` is what a member gave up to there."""

    def __init__(self, reason: str, content: bytes = b""):
        super().__init__(reason)
        self.content = content


def _member(data: bytes, at: int) -> tuple[bytes, int]:
    """Content and end of the gzip member at ``at``; its CRC and length are checked."""
    d, out, end = zlib.decompressobj(31), [], at
    while not d.eof:
        chunk, before = data[end:end + _FEED], d.copy()
        if not chunk:
            raise Damaged("cut member", b"".join(out))
        try:
            out.append(d.decompress(chunk))
        except zlib.error as e:
            # byte by byte, up to the one that fails
            try:
                for k in range(len(chunk)):
                    out.append(before.decompress(chunk[k:k + 1]))
            except zlib.error:
                pass
            raise Damaged("broken member", b"".join(out)) from e
        end += len(chunk)
    return b"".join(out), end - len(d.unused_data)


def _record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Fields, payload and end of the record at ``at``."""
    if not data.startswith(b"WARC/1.", at):
        raise Damaged("no version line")
    split = data.find(_END, at)
    if split < 0:
        raise Damaged("no end of header")
    fields: dict[str, str] = {}
    for line in data[at:split].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Damaged("broken header")
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = fields.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", length):
        raise Damaged("no length")
    begin, end = split + 4, split + 4 + int(length)
    if data[end:end + 4] != _END:
        raise Damaged("wrong length")
    block = data[begin:end]
    declared = fields.get("warc-block-digest", "")
    if declared.startswith("sha256:") and declared[7:].lower() != hashlib.sha256(block).hexdigest():
        raise Damaged("wrong block digest")
    payload = block
    if block.startswith(b"HTTP/"):
        payload = block.partition(_END)[2]
    declared = fields.get("warc-payload-digest", "")
    if fields.get("warc-type") != "revisit" and declared.startswith("sha256:") and declared[7:].lower() != hashlib.sha256(payload).hexdigest():
        raise Damaged("wrong payload digest")
    return fields, payload, end + 4


def _inside(content: bytes, start: int, end: int, vouched: bool) -> list[Record]:
    """Records of a member's content, and gaps within it; only those with a digest where ``vouched`` is set. Nothing if it has no record."""
    records, place, lost, reason, some = [], 0, None, "", False

    def gap(until: int) -> None:
        records.append(Record(start, end, {}, reason=f"{reason} (bytes {lost} to {until} of the member's content)"))

    while place < len(content):
        if lost is None and content[place] in b"\x00\r\n":
            place += 1
            continue
        try:
            fields, payload, after = _record(content, place)
            digests = ["warc-block-digest", *(["warc-payload-digest"] if fields.get("warc-type") != "revisit" else [])]
            if vouched and not any(fields.get(d, "").startswith("sha256:") for d in digests):
                raise Damaged("no digest in a broken member")
        except Damaged as e:
            if lost is None:
                lost, reason = place, str(e)
            begins = _VERSION.search(content, place + 1)
            place = begins.start() if begins else len(content)
            continue
        if lost is not None:
            gap(place)
            lost = None
        records.append(Record(start, end, fields, payload))
        place, some = after, True
    if lost is not None:
        gap(len(content))
    if lost is not None and not some:
        raise Damaged(reason)
    return records


def _at(data: bytes, at: int) -> tuple[list[Record], int]:
    """The records of the member or plain record at ``at``, with gaps inside the member, and where it ends."""
    if data.startswith(b"\x1f\x8b\x08", at):
        inside, end = _member(data, at)
        return _inside(inside, at, end, vouched=False), end
    fields, payload, end = _record(data, at)
    return [Record(at, end, fields, payload)], end


def _given(data: bytes, at: int, content: bytes) -> list[Record]:
    """Records in what a broken member at ``at`` gave; the gap that follows names what is lost behind them."""
    begins = _BEGINS.search(data, at + 1)
    try:
        return _inside(content, at, begins.start() if begins else len(data), vouched=True)
    except Damaged:
        return []


def salvage(data: bytes) -> Iterator[Record]:
    """All records of an archive in order, with a gap for every stretch of bytes that belongs to none.

    Zero bytes and line ends between records are padding. An empty archive yields nothing.
    """
    at, lost, reason = 0, None, ""
    while at < len(data):
        if lost is None and data[at] in b"\x00\r\n":
            at += 1
            continue
        try:
            records, end = _at(data, at)
        except Damaged as e:
            if given := _given(data, at, e.content) if e.content else []:
                if lost is not None:
                    yield Record(lost, at, {}, reason=reason)
                yield from given
                lost = None
            if lost is None:
                lost, reason = at, str(e)
            begins = _BEGINS.search(data, at + 1)
            at = begins.start() if begins else len(data)
            continue
        if lost is not None:
            yield Record(lost, at, {}, reason=reason)
            lost = None
        yield from records
        at = end
    if lost is not None:
        yield Record(lost, len(data), {}, reason=reason)


def _page(field: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?[0-9]{1,19})>", field or "")
    return int(found[1]) if found else None


_READ = ("file string, start long, end long, gap string, page_id long, record_type string, refers_to long, target_uri string, "
         "payload_bytes long, payload_digest string, payload binary")


def _reader(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("file", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("gap", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()),
                 ("refers_to", pa.int64()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
        schema = pa.schema(kinds)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)

        for batch in batches:
            for i in range(batch.num_rows):
                name, data, rows, held = batch.column("path")[i].as_py(), batch.column("content")[i].as_py(), [], 0
                for r in salvage(data):
                    if r.reason is not None:
                        rows.append((name, r.start, r.end, r.reason, *[None] * 7))
                    else:
                        revisit = r.fields.get("warc-type") == "revisit"
                        digest = r.fields.get("warc-payload-digest", "")[7:].lower() if revisit else hashlib.sha256(r.payload).hexdigest()
                        rows.append((name, r.start, r.end, None, _page(r.fields.get("warc-record-id")), r.fields.get("warc-type"), _page(r.fields.get("warc-refers-to")),
                                     r.fields.get("warc-target-uri"), None if revisit else len(r.payload), digest, None if revisit or not with_payload else r.payload))
                        held += len(r.payload) if with_payload else 0
                    if len(rows) >= 1000 or held > 8 << 20:
                        yield out(rows)
                        rows, held = [], 0
                if rows:
                    yield out(rows)
    return read


def read_archives(spark: SparkSession, path: str, *, payload: bool = True) -> DataFrame:
    """Rows of all archives under ``path``: records (gap null) and quarantined gaps (gap: why, with start and end).

    One archive is one task's work; a file of up to 2 GB can be read. Without ``payload`` that column is null.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_reader(payload), _READ)


def gaps(read: DataFrame) -> DataFrame:
    """The log of quarantined bytes: file, start, end, reason."""
    return read.filter("gap is not null").select("file", "start", "end", F.col("gap").alias("reason"))


def resolved(read: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; a revisit has the length of the payload it names.

    A revisit whose response was lost has a null length.
    """
    records = read.filter("gap is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    whole = records.filter("record_type = 'response'").drop("refers_to").withColumn("refers_to", F.lit(None).cast("long"))
    named = records.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("__bytes")).distinct()
    again = records.filter("record_type = 'revisit'").join(named, ["refers_to", "payload_digest"], "left")
    again = again.withColumn("payload_bytes", F.col("__bytes")).drop("__bytes")
    return whole.unionByName(again)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path)
    return resolved(written(read_archives(spark, path, payload=False), "warc-records"))
