"""WARC archives with revisit records: payloads of a digest are stored once, the others refer to them.

Headers (not payloads) are shuffled by digest to choose each original. Revisits then meet their pages by a broadcast up
to a checked size; only beyond it are pages shuffled, once. An archive is a row of gzip members, one a record, each part
of it behind a warcinfo record of its own, and is bounded in bytes, so any WARC reader can seek in it and no task holds
more than one. Spark's text writer writes the bytes, so archives can lie in any store that Spark can write to.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import common

_CRLF = "\r\n"
_END = _CRLF * 2
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = ("HTTP/1.1 200 OK" + _CRLF + "Content-Type: text/html; charset=utf-8" + _END).encode()
#: Fresh headers are dated by a parameter, so that a task that runs again writes the same bytes.
_DATE = "2024-01-01T00:00:00Z"
_PART = 2 << 20
_CONTROLS = re.compile(r"[\x00-\x20\x7F]")


def _member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _urn(space: uuid.UUID, name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(space, name)}>"


def _record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}{_CRLF}" for k, v in [*fields, ("Content-Length", str(len(block)))] if v is not None)
    return f"WARC/1.1{_CRLF}{head}{_CRLF}".encode() + block + _END.encode()


def originals(headers: DataFrame) -> DataFrame:
    """(payload_digest, original, same, rows) of each payload that several rows have: the largest page_id, how many rows
    have that one, and how many there are. Partial aggregates before the shuffle: a payload that a third of the pages
    have costs a row a task."""
    each = headers.groupBy("payload_digest", "page_id").agg(F.count("*").alias("n"))
    best = each.groupBy("payload_digest").agg(F.max(F.struct("page_id", "n")).alias("b"), F.sum("n").alias("rows")).where("rows > 1")
    return best.select("payload_digest", F.col("b.page_id").alias("original"), F.col("b.n").alias("same"), "rows")


def revisits(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """(page_id, payload_digest, original, repeated) for the pages whose record isn't the one that revisits refer to:
    revisits, with the page_id of their original, and rows of an original that has several (original is null, repeated
    is true)."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    headers = pages.select("page_id", F.sha1(F.encode(payload, "utf-8")).alias("payload_digest"), F.octet_length(payload).alias("b")).where((F.col("b") >= min_bytes) & F.col("page_id").isNotNull()).drop("b")
    headers = common.written(headers, "warc-headers")
    known = common.written(originals(headers), "warc-originals")
    met = common.heavy_join(headers, known, "payload_digest", "rows", headers.count())
    own, repeated = F.col("page_id") == F.col("original"), F.col("same") > 1
    again = common.written(met.where(~own | repeated).select("page_id", "payload_digest", F.when(~own, F.col("original")).alias("original"), repeated.alias("repeated")).distinct(), "warc-revisits")
    common.discard(headers, known)
    return again


def to_parts(pages: DataFrame, min_bytes: int = 1000, date: str = _DATE, gzip: bool = True, run: str | None = None, broadcast_rows: int = 400_000) -> DataFrame:
    """Rows (part binary): whole records of some 2 MB, or one larger record, behind a warcinfo record.

    Pages with equal payloads of min_bytes or more: the largest page_id is the response, the others are revisits of it.
    Rows that repeat that page_id with that payload are responses too. Null html is an empty payload, a null page_id is
    always a response, a null url is left out. Other columns are not read. Every record has an id of its own, also where
    rows are repeated; WARC-Refers-To is left out where the original is repeated, and the digest alone leads to it.
    """
    common.ship(pages.sparkSession)
    payload = F.coalesce(F.col("html"), F.lit(""))
    again = revisits(pages, min_bytes)
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(F.encode(payload, "utf-8")).alias("payload_digest"))
    if again.count() <= broadcast_rows:  # else pages are shuffled once, payloads too
        again = F.broadcast(again)
    joined = rows.join(again, ["page_id", "payload_digest"], "left").select("page_id", "url", F.encode("payload", "utf-8").alias("payload"), "payload_digest", "original", "repeated")
    space = uuid.uuid5(uuid.NAMESPACE_URL, run or uuid.uuid4().hex)

    def pack(batches):
        common.held("warc")
        task, made, n = TaskContext.get().partitionId(), 0, 0
        parts, size = [], 0
        close = _member if gzip else bytes
        for batch in batches:
            for page, url, body, digest, original, repeated in zip(*(c.to_pylist() for c in batch.columns)):
                if not parts:
                    info = _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _urn(space, f"info|{task}|{made}")), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    parts, made = [close(info)], made + 1
                n += 1
                revisit = original is not None
                plain = repeated is None and page is not None and len(body) >= min_bytes
                fields = [
                    ("WARC-Type", "revisit" if revisit else "response"),
                    ("WARC-Record-ID", _urn(space, f"{page}|{digest}" if plain else f"{page}|{digest}|{task}|{n}")),
                    ("WARC-Date", date),
                    ("WARC-Target-URI", None if url is None else _CONTROLS.sub("_", url)),
                    ("WARC-Payload-Digest", f"sha1:{digest}"),
                    ("WARC-Profile", _PROFILE if revisit else None),
                    ("WARC-Refers-To", _urn(space, f"{original}|{digest}") if revisit and not repeated else None),
                    ("X-Page-Id", None if page is None else str(page)),
                    ("Content-Type", "application/http; msgtype=response"),
                ]
                parts.append(close(_record(fields, _HTTP if revisit else _HTTP + body)))
                size += len(parts[-1])
                if size >= _PART:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["part"])
                    parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["part"])

    return joined.mapInArrow(pack, "part binary")


def write_archives(pages: DataFrame, path: str, min_bytes: int = 1000, archive_bytes: int = 32 << 20, gzip: bool = True, date: str = _DATE, run: str | None = None, broadcast_rows: int = 400_000) -> None:
    """Write archives of some archive_bytes at most (or one larger record) to a folder that all executors share."""
    parts = to_parts(pages, min_bytes, date, gzip, run, broadcast_rows).select(F.col("part").cast("string").alias("value"))
    # what the writer puts between rows must be part of the format: a gzip member of nothing, or an empty line
    between = (_member(b"") if gzip else _CRLF.encode()).decode("latin-1")
    parts.write.option("encoding", "ISO-8859-1").option("lineSep", between).option("compression", "none").option("maxRecordsPerFile", max(1, archive_bytes // _PART)).text(path)


_FIELDS = [("record_id", pa.string()), ("record_type", pa.string()), ("refers_to_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload", pa.binary())]
_DDL = "record_id string, record_type string, refers_to_id string, page_id long, url string, payload_digest string, payload binary"


def members(data: bytes):
    """The plain bytes of an archive: of each gzip member by itself, or all at once if it isn't gzip."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while at < len(data):
        d, out = zlib.decompressobj(31), []
        while not d.eof:
            if at >= len(data):
                raise ValueError("the last gzip member is cut short")
            out.append(d.decompress(view[at : at + (1 << 16)]))
            at = min(len(data), at + (1 << 16)) - len(d.unused_data)
        yield b"".join(out)


def parse(data: bytes):
    """Records of plain bytes: (header fields by lower-case name, block). Follows Content-Length, so payloads may hold
    anything; a record that is cut short raises ValueError."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record header at byte {at}")
        fields = {k.strip().lower().decode(): v.strip().decode() for k, v in (x.split(b":", 1) for x in data[at:end].split(b"\r\n")[1:])}
        start = end + 4
        at = start + int(fields["content-length"])
        if at > len(data):
            raise ValueError(f"record at byte {start} is cut short")
        yield fields, data[start:at]


def _parse_files(batches):
    for batch in batches:
        for content in batch.column("content"):
            rows: list[tuple] = []
            for f, block in (r for plain in members(content.as_py()) for r in parse(plain)):
                kind = f["warc-type"]
                if kind not in ("response", "revisit"):
                    continue
                digest = re.sub("^sha1:", "", f.get("warc-payload-digest", ""))
                body = block.partition(b"\r\n\r\n")[2]
                if kind == "response" and hashlib.sha1(body).hexdigest() != digest:
                    raise ValueError(f"{f['warc-record-id']}: the payload does not match its digest")
                page = f.get("x-page-id")
                rows.append((f["warc-record-id"], kind, f.get("warc-refers-to"), None if page is None else int(page), f.get("warc-target-uri"), digest, body if kind == "response" else None))
                if len(rows) >= 200:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, _FIELDS)], names=[n for n, _ in _FIELDS])


def read_archives(spark, path: str) -> DataFrame:
    """One row for each response and revisit record of archives, plain or gzip: record_id, record_type, refers_to_id,
    page_id, url, payload_digest, payload (null for revisits). A task holds one archive and one record of it at a time;
    an archive that Spark can't load as a value (2 GB) is an error."""
    common.ship(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parse_files, _DDL)


def resolve(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to (the response's page_id) for each record.

    Headers of revisits are joined to headers of responses by payload digest; payloads aren't shuffled, and digests that
    very many revisits have are broadcast. A revisit whose response is missing keeps nulls. Equal revisits are answered
    each; of several responses with a digest the largest page_id counts.
    """
    heads = common.written(records.select("record_type", "page_id", "payload_digest", F.octet_length("payload").cast("long").alias("payload_bytes")), "warc-heads")
    response, again = F.col("record_type") == "response", heads.where("record_type = 'revisit'")
    found = heads.groupBy("payload_digest").agg(F.max(F.when(response, F.col("page_id"))).alias("refers_to"), F.max(F.when(response, F.col("payload_bytes"))).alias("payload_bytes"), F.count_if(~response).alias("_n")).where("_n > 0")
    met = common.heavy_join(again.drop("payload_bytes"), found, "payload_digest", "_n", again.count(), "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return met.unionByName(heads.where(response).select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")))


def op9_warc(spark, sf_dir: str) -> DataFrame:
    """All pages as archives, read back and resolved: a row for each page, nulls and repeats as in to_parts."""
    path = f"{common.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(common.table(spark, sf_dir, "pages"), path)
    return resolve(read_archives(spark, path))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
h AS (SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
o AS (SELECT payload_digest AS d, payload_bytes AS b, max(page_id) AS original FROM h WHERE payload_bytes >= 1000 AND page_id IS NOT NULL GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to
FROM h LEFT JOIN o ON d = payload_digest AND b = payload_bytes
"""
