"""Substring deduplication by content-defined chunking with a gear rolling hash.

A chunk ends where the gear hash of the last bytes has its mask bits zero, so cuts move with the text and an insertion
changes the chunks around it only. Chunks are short, to follow a passage closely; what is compared is the digest of
three neighbouring chunks, long enough not to recur by chance in a large corpus. The first occurrence of a digest, by
document and place, stays, later ones are repeats. Stretches of repeats that are long enough are passages.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common
from .hashing import BYTES, Bitmap, mix

_U = np.uint64
#: Bytes that the gear hash looks back; 32-bit sums shift older ones out.
WINDOW = 32
_GEAR = (BYTES >> _U(32)).astype(np.uint32)
_PIECE = 1 << 20


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash h = (h << 1) + G[byte] after each byte, in 32 bits; log2(32) steps of doubling instead of a loop."""
    h = _GEAR[data]
    step = 1
    while step < WINDOW:
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] << np.uint32(step)
        h = h + shifted
        step *= 2
    return h


def cuts(data: bytes, smallest: int = 8, mask_bits: int = 4, largest: int = 96) -> list[int]:
    """Ends of chunks. A cut needs mask_bits zero bits at the top of the hash and at least `smallest` bytes since the
    last one. Where none comes for `largest` bytes, the chunk ends behind the smallest hash of those bytes (of equals the
    first), so that cuts follow the content there too, as in a word said over and over. Characters are never cut in two.
    Works through long texts piece by piece, with the same cuts as at once."""
    out, last, size = [], 0, len(data)

    def forced(until: int) -> None:
        nonlocal last
        while until - last > largest:
            base = max(0, last - WINDOW)
            h = gear(np.frombuffer(data, np.uint8, last + largest - base, base))
            last = _character(data, last + smallest + int(h[last + smallest - 1 - base :].argmin()))
            out.append(last)

    for start in range(0, size, _PIECE):
        base = max(0, start - WINDOW)
        a = np.frombuffer(data, np.uint8, min(size, start + _PIECE) - base, base)
        found = np.flatnonzero(gear(a)[start - base :] >> np.uint32(32 - mask_bits) == 0) + start + 1
        for end in found.tolist():
            if end - last > largest:
                forced(end)
            if end - last >= smallest:
                end = _character(data, end)
                out.append(end)
                last = end
    forced(size)
    if last < size:
        out.append(size)
    return out


def _character(data: bytes, end: int) -> int:
    while end < len(data) and data[end] & 0xC0 == 0x80:
        end += 1
    return end


def chunk_digests(data: bytes, ends: list[int], columns: int = 2) -> np.ndarray:
    """64 bits for each chunk and column, 128 in all: keyed sums over its bytes, mixed with its length."""
    e = np.array(ends, np.int64)
    s = np.concatenate(([0], e[:-1])) if len(e) else e
    out = np.empty((len(e), columns), _U)
    first = 0
    while first < len(e):  # chunks of some MB at a time
        last = max(first + 1, int(np.searchsorted(e, s[first] + 2 * _PIECE)))
        base, lengths = int(s[first]), e[first:last] - s[first:last]
        a = np.frombuffer(data, np.uint8, int(e[last - 1]) - base, base).astype(_U)
        place = np.arange(len(a), dtype=_U) - np.repeat((s[first:last] - base).astype(_U), lengths)
        said = (a + _U(1)) + (place << _U(9))
        for column, key in enumerate((_U(0), _U(0xA5A5A5A5A5A5A5A5))[:columns]):
            out[first:last, column] = mix(np.add.reduceat(mix(said ^ key), s[first:last] - base) + lengths.astype(_U) * _U(0x9E3779B97F4A7C15))
        first = last
    return out


def units_of(text: str | None, chunks: int = 3, columns: int = 2, **limits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digest (two columns), start and end of each run of `chunks` neighbouring chunks; a text of fewer is one unit."""
    data = (text or "").encode()
    ends = cuts(data, **limits)
    x, e = chunk_digests(data, ends, columns), np.array(ends, np.int64)
    s = np.concatenate(([0], e[:-1])) if len(e) else e
    k = min(chunks, len(e))
    if not k:
        return np.empty((0, columns), np.int64), s, e
    n = len(e) - k + 1
    out = np.zeros((n, columns), _U)
    for i in range(k):
        out = mix(out * _U(0x9E3779B97F4A7C15) + x[i : i + n] + _U(i))
    return out.view(np.int64), s[:n], e[k - 1 :]


def _digests(limits: dict):
    """Rows (digest) of all units: 64 bits, which choose what is looked at again."""

    def run(batches):
        common.held("chunks")
        for batch in batches:
            own = [units_of(t.as_py(), columns=1, **limits)[0][:, 0] for t in batch.column("_text")]
            whole = np.concatenate(own) if own else np.empty(0, np.int64)
            for i in range(0, len(whole), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(whole[i : i + 200_000])], names=["digest"])

    return run


def _places(known: Bitmap, limits: dict):
    """Rows (digest, check, id, key, at, end) of the units whose digest may be known. check: the digest's other 64 bits."""

    def run(batches):
        common.held("chunks")
        for batch in batches:
            columns: list[list] = [[] for _ in range(5)]
            ids, missing = [], []
            for own_id, key, text in zip(batch.column("_id").to_pylist(), batch.column("_key").to_pylist(), batch.column("_text")):
                digests, at, end = units_of(text.as_py(), **limits)
                own = np.flatnonzero(known.has(np.ascontiguousarray(digests[:, 0])))
                for column, x in zip(columns, (digests[own, 0], digests[own, 1], np.full(len(own), key, np.int64), at[own], end[own])):
                    column.append(x)
                ids.append(np.full(len(own), own_id or 0, np.int64))
                missing.append(np.full(len(own), own_id is None))
            digest, check, key, at, end = (np.concatenate(c) if c else np.empty(0, np.int64) for c in columns)
            own_ids, none = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (ids, missing))
            for i in range(0, len(digest), 100_000):
                z = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(digest[z]), pa.array(check[z]), pa.array(own_ids[z], mask=none[z].astype(bool)), pa.array(key[z]), pa.array(at[z]), pa.array(end[z])], names=["digest", "check", "id", "key", "at", "end"])

    return run


def stretches(spans):
    """Overlapping and touching spans of a sorted array<struct<at, end>> joined to array<struct<start, end>>. Both ends
    grow along the array, so a span begins a stretch if it lies beyond the one before."""
    begins = F.filter(spans, lambda x, i: (i == 0) | (x["at"] > F.get(spans, F.greatest(i - 1, F.lit(0)))["end"]))
    ends = F.filter(spans, lambda x, i: F.coalesce(F.get(spans, i + 1)["at"] > x["end"], F.lit(True)))
    return F.zip_with(begins, ends, lambda a, z: F.struct(a["at"].alias("start"), z["end"].alias("end")))


def repeated_passages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_bytes: int = 90, **limits) -> DataFrame:
    """(id, key, shared, repeats: array<struct<start, end>>) for each text with a passage that occurs elsewhere too.

    Spans are bytes of the UTF-8 text. shared: stretches of at least min_bytes that occur in another row or at another
    place of the same one. repeats: stretches of at least min_bytes of which an earlier occurrence exists, by (id, key,
    place), null ids last; may be empty. key is xxhash64 of id and text: rows that repeat both are the same row.

    Digests are 128-bit, so that chance makes no repeats at any size of corpus. Digests that very many texts hold are
    broadcast with their first place, so that their places needn't meet in one task.

    Null, empty and short texts have no passages; an empty table gives none; other columns of docs aren't read. Ids
    must be whole numbers.
    """
    spark = docs.sparkSession
    common.ship(spark)
    rows = keyed(docs, id_column, text_column)
    every = rows.select("_text").mapInArrow(_digests(limits), "digest long")
    shared = common.written(every.groupBy("digest").count().where("count > 1").select("digest"), "chunk-digests")
    places = rows.mapInArrow(_places(Bitmap.of(shared, "digest", 25), limits), "digest long, check long, id long, key long, at long, end long")
    places = common.written(places, "chunk-places")
    common.discard(shared)
    order = F.struct(F.col("id").isNull().alias("x"), F.col("id").alias("id"), "key", "at")
    # bitmaps let some digests pass that occur once; those have one place only
    first = places.groupBy("digest", "check").agg(F.min(order).alias("f"), F.min(F.struct("key", "at")).alias("a"), F.max(F.struct("key", "at")).alias("z"), F.count("*").alias("_n")).where("a <> z").select("digest", "check", F.col("f.key").alias("fk"), F.col("f.at").alias("fa"), "_n")
    marked = common.heavy_join(places, first, ["digest", "check"], "_n", places.count()).select("id", "key", "at", "end", ((F.col("key") != F.col("fk")) | (F.col("at") != F.col("fa"))).alias("later")).distinct()
    # grouped by text: a group holds no more than its text's own units
    spans = marked.groupBy("id", "key").agg(F.sort_array(F.collect_list(F.struct("at", "end"))).alias("u"), F.sort_array(F.collect_list(F.when(F.col("later"), F.struct("at", "end")))).alias("r"))
    long_enough = lambda x: F.filter(x, lambda p: p["end"] - p["start"] >= min_bytes)
    return spans.select("id", "key", long_enough(stretches(F.col("u"))).alias("shared"), long_enough(stretches(F.col("r"))).alias("repeats")).where(F.size("shared") > 0)


def keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(_id, _text, _key) for each row."""
    return docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"), F.xxhash64(id_column, text_column).alias("_key"))


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_bytes: int = 90, **limits) -> DataFrame:
    """The rows of docs, all columns (of any name), with the bytes of repeats cut out of the texts. Null texts stay null,
    rows that repeat id and text are cut alike, an empty table stays empty."""
    common.ship(docs.sparkSession)
    names, at = docs.columns, docs.columns.index(text_column)
    found = repeated_passages(docs, id_column, text_column, min_bytes, **limits).where(F.size("repeats") > 0).select(F.col("key").alias("_key"), F.col("repeats").alias("_cut"))
    rows = docs.select(F.struct(*names).alias("_row"), F.xxhash64(id_column, text_column).alias("_key")).join(found, "_key", "left").select("_row", "_cut")

    def run(batches):
        common.held("chunks")
        for batch in batches:
            own = batch.column("_row").flatten()
            new = [t if t is None or not c else _cut(t, c) for t, c in zip(own[at].to_pylist(), batch.column("_cut").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else own[i] for i in range(len(names))], names=names)

    return rows.mapInArrow(run, docs.schema)


def _cut(text: str, spans: list[dict]) -> str:
    data, out, at = text.encode(), [], 0
    for x in spans:
        out.append(data[at : x["start"]])
        at = x["end"]
    return b"".join([*out, data[at:]]).decode()


def op8_chunks(spark, sf_dir: str) -> DataFrame:
    """One row for each document that holds a passage found elsewhere too."""
    found = repeated_passages(common.spread(common.table(spark, sf_dir, "documents").select("doc_id", "text")))
    said = lambda x: F.array_join(F.transform(x, lambda p: F.concat_ws(":", p["start"].cast("string"), p["end"].cast("string"))), ",")
    n_bytes = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, p: a + p["end"] - p["start"])
    return found.select(F.col("id").alias("doc_id"), F.size("shared").cast("long").alias("n_passages"), n_bytes("shared").alias("shared_bytes"), n_bytes("repeats").alias("repeated_bytes"), said("shared").alias("passages"), said("repeats").alias("repeats"))
