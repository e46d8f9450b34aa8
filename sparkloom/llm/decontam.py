"""Benchmark decontamination by Wu-Manber search for windows of consecutive words.

Texts become b" word word ... " (A-Z lower-cased, one space between words), items become windows of the same form. The
search looks at the last block of bytes under a window of the shortest pattern's length: a block that no pattern
has there lets it skip ahead, a block that ends some patterns' first m bytes selects those, which are then compared.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

#: a-z, 0-9 and bytes of non-ASCII characters stay, A-Z become a-z, the rest becomes a space.
_WORDS = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


#: Matchers that a worker holds, and bytes of text that it reads ahead to give each of many blocks at once.
HELD_BLOCKS, AHEAD = 2, 48 << 20


class WuManber:
    """Finds all occurrences of byte patterns. Patterns of similar length share a table, so that short ones do not
    shorten the skips of the long ones."""

    #: Lengths from which a new table begins.
    CLASSES = (1, 8, 24, 40, 64)

    def __init__(self, patterns: list[bytes], block: int = 10):
        by_class: dict[int, list[bytes]] = {}
        for p in patterns:
            by_class.setdefault(max(c for c in self.CLASSES if c <= len(p)), []).append(p)
        self.tables = []
        for own in by_class.values():
            m = min(map(len, own))
            b = min(block, m)
            shift: dict[bytes, int] = {}
            bucket: dict[bytes, list[bytes]] = {}
            for p in own:
                for end in range(b, m + 1):
                    key, skip = p[end - b : end], m - end
                    if shift.get(key, m) > skip:
                        shift[key] = skip
                bucket.setdefault(p[m - b : m], []).append(p)
            self.tables.append((m, b, shift, bucket))

    def find(self, data: bytes):
        """(start, pattern) of every occurrence."""
        for m, b, shift, bucket in self.tables:
            end, size, far, get = m, len(data), m - b + 1, shift.get
            while end <= size:
                key = data[end - b : end]
                skip = get(key, far)
                if skip:
                    end += skip
                    continue
                for p in bucket[key]:
                    if data.startswith(p, end - m):
                        yield end - m, p
                end += 1


class Matcher:
    """Windows of a block of items: which items occur in a text and which of its words lie in an occurrence."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], width: int):
        self.owners: dict[bytes, set[str | None]] = {}
        for item, words in items:
            for i in range(max(1, len(words) - width + 1) if words else 0):
                self.owners.setdefault(b" " + b" ".join(words[i : i + width]) + b" ", set()).add(item)
        self.search = WuManber(list(self.owners))
        self.n_words = {p: p.count(b" ") - 1 for p in self.owners}

    def match(self, data: bytes) -> tuple[list[int], set]:
        """Word runs as [first, end, first, end, ...], unsorted, and the items."""
        runs, items, spaces = [], set(), None
        for start, p in self.search.find(data):
            if spaces is None:
                spaces = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
            first = int(np.searchsorted(spaces, start))
            runs += (first, first + self.n_words[p])
            items |= self.owners[p]
        return runs, items


def merged_runs(runs: list[int]) -> list[int]:
    out: list[int] = []
    for first, end in sorted(zip(runs[::2], runs[1::2])):
        if out and first <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += (first, end)
    return out


def _matcher(key: str, block, width: int) -> Matcher:
    """Kept by a worker from task to task: as many as a pass has blocks at once in memory."""
    kept = common.held("decontam")
    if key not in kept:
        while len(kept) >= HELD_BLOCKS:
            del kept[next(iter(kept))]
        kept[key] = Matcher(block.value, width)
        block.__dict__.pop("_value", None)  # the words themselves are not needed beside the tables
    return kept[key]


def item_blocks(benchmark: DataFrame, item_column: str, text_column: str, width: int, block_bytes: int):
    """Items as words, in blocks of about block_bytes at most. Long items are cut so that no window is lost; the driver
    holds one block at a time."""
    block, size, piece = [], 0, max(width, block_bytes // 64)
    for item, text in benchmark.select(F.col(item_column).cast("string"), text_column).toLocalIterator():
        words = words_of(text)
        for i in range(0, max(1, len(words) - width + 1), piece):
            part = words[i : i + piece + width - 1]
            n = sum(map(len, part)) + 40
            if block and size + n > block_bytes:
                yield block
                block, size = [], 0
            block.append((item, part))
            size += n
    yield block


def find_windows(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = 10,
    text_column: str = "text",
    item_text_column: str = "text",
    item_column: str = "item_id",
    keep: tuple[str, ...] = ("doc_id",),
    block_bytes: int = 2 << 20,
    pass_blocks: int = 64,
) -> DataFrame:
    """For each row of docs: keep's columns, n_words long, runs array<int> and items array<string>.

    runs holds first and end (exclusive) of each maximal run of words inside occurrences of windows; items the distinct
    ids, as strings and sorted as strings, of items of which a window occurs. A window is `width` consecutive words of
    an item; an item with fewer words, but not none, is one window.

    The benchmark is sent to executors in blocks of at most block_bytes (one block for all usual benchmarks). A pass
    over the rows, without a shuffle, takes pass_blocks of them at most, which bounds what is broadcast for it; its one
    worker holds the tables of two, reads texts ahead, and builds the tables anew for each load where there are more. A
    larger benchmark takes further passes in the same task.

    Null and empty texts have no words and no runs, null and empty items no windows. An item whose id is null marks
    words but is not listed. Repeated rows are each answered; repeated items count once. Either table may be empty.
    Columns of keep that are called n_words, runs or items are left out; others than keep and the text are not read.
    """
    spark = docs.sparkSession
    common.ship(spark)
    out = docs.select(*(c for c in keep if c not in ("n_words", "runs", "items")), F.col(text_column).alias("_text"), F.lit(None).cast("array<int>").alias("runs"), F.lit(None).cast("array<string>").alias("items"))
    between, done = out.schema, out.drop("_text").withColumn("n_words", F.lit(0).cast("long")).schema
    blocks = item_blocks(benchmark, item_column, item_text_column, width, block_bytes)
    block = next(blocks)
    while block is not None:  # the last pass drops the texts: usually it is the only one, and a task needs one worker
        sent = []
        while block is not None and len(sent) < pass_blocks:
            sent.append((uuid.uuid4().hex, spark.sparkContext.broadcast(block)))
            block = next(blocks, None)
        out = out.mapInArrow(_pass(sent, width, block is None), between if block is not None else done)
    return out


def _loads(batches, most: int):
    """Lists of batches whose texts have so many bytes, or one more batch."""
    load, size = [], 0
    for batch in batches:
        load.append(batch)
        size += batch.column("_text").nbytes
        if size >= most:
            yield load
            load, size = [], 0
    if load:
        yield load


def _pass(blocks: list, width: int, last: bool):
    def run(batches):
        common.held("decontam")
        for load in _loads(batches, AHEAD if len(blocks) > HELD_BLOCKS else 1):
            texts = [[b" ".join(words_of(t.as_py())) for t in batch.column("_text")] for batch in load]
            runs, items = ([x for batch in load for x in batch.column(c).to_pylist()] for c in ("runs", "items"))
            for key, block in blocks:
                m = _matcher(key, block, width)
                for i, text in enumerate(t for own in texts for t in own):
                    got, who = m.match(b" " + text + b" ")
                    if got:
                        runs[i] = merged_runs((runs[i] or []) + got)
                        items[i] = sorted({*(items[i] or []), *(w for w in who if w is not None)})
            at = 0
            for batch, own in zip(load, texts):
                r, k = ([x if x is not None or not last else [] for x in c[at : at + len(own)]] for c in (runs, items))
                at += len(own)
                batch = _replaced(batch, {"runs": pa.array(r, pa.list_(pa.int32())), "items": pa.array(k, pa.list_(pa.string()))})
                if last:
                    names = [c for c in batch.schema.names if c != "_text"]
                    n = pa.array([t.count(b" ") + 1 if t else 0 for t in own], pa.int64())
                    batch = pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), n], names=[*names, "n_words"])
                yield batch

    return run


def _replaced(batch: pa.RecordBatch, new: dict) -> pa.RecordBatch:
    names = batch.schema.names
    return pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], names=names)


def hit_words(runs) -> "F.Column":
    """Words inside runs."""
    return F.aggregate(F.transform(runs, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, **columns) -> DataFrame:
    """The rows of docs, all columns (of any name), without those in which a window of the benchmark occurs. Null and empty
    texts stay, repeated rows are each judged; either table may be empty."""
    names = docs.columns
    found = find_windows(docs.select(F.struct(*names).alias("_row"), F.col(columns.get("text_column", "text")).alias("_own")), benchmark, width, "_own", keep=("_row",), **{k: v for k, v in columns.items() if k != "text_column"})
    return found.where(F.size("runs") == 0).select("_row.*")


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    """find_windows of the whole benchmark in all documents; a row for each document, nulls as there."""
    found = find_windows(common.spread(common.table(spark, sf_dir, "documents").select("doc_id", "text")), common.table(spark, sf_dir, "benchmark"))
    n_hit = hit_words(F.col("runs"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LIST = f"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_GAPS}'), lambda x: x <> '')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_LIST} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, least(10, len(w)) AS k, w FROM (SELECT item_id, {_LIST} AS w FROM benchmark) WHERE len(w) > 0),
t AS (SELECT DISTINCT item, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
s AS (SELECT rid, i, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM t))),
h AS (SELECT rid, i, k, item FROM s JOIN t USING (k, g)),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM h) GROUP BY rid),
m AS (SELECT rid, list_sort(list(DISTINCT item)) AS items FROM h GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN m USING (rid)
"""
