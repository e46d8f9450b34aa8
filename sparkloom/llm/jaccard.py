"""Exact n-gram Jaccard join by vertical partitioning, and the components of its links.

A document is the set of its n-grams, as 64-bit hashes; the order of the hashes is the global order of n-grams. Sets are
cut into fragments, ranges of that order.

1. Candidates. Two sets whose Jaccard similarity is J or more differ in at most d n-grams, d a function of their sizes.
   Cut into d + 1 + w fragments, at least w + 1 are equal in both. So equal (fragment, content) keys find every link,
   and an n-gram that a third of all documents hold makes no key by itself. Sizes fall into classes such that linked
   sets are in the same class or in adjacent ones; each class has its own number of fragments, and a set emits keys
   in its own class and, as a guest, in the next. Keys that only guests share go: two guests of a class have the class
   below in common and meet there, and of two sets in adjacent classes one is at home in the class where they meet.
2. Groups. A set that shares fewer keys with others than w + 1, less its empty fragments, has no link: it goes, and
   the count is taken again. With more than w empty fragments it needs one shared key only. Sets left that share a key,
   or share one with a set that does, form a group. No pair is made for that: each key links its sets with the smallest
   of them.
3. Overlaps. Groups are split into blocks of bounded size, and pairs of blocks are tasks. There the overlap of every
   two sets is counted fragment by fragment and summed up. What leaves a task is a spanning forest of its links, at
   most one row a set: enough for components, and linear however many copies there are.
4. Large groups. First each block meets the group's first block only, which is linear in the group. Sets that are in
   one component by then need not meet each other; those outside the group's largest component meet all others. So a
   family of near copies costs a pass over its sets, and only texts that are similar without a link cost pairs of blocks.

The slack w has a second use: fragments that happen to be empty need not be keys, as a set with at most w empty ones
has an equal one that isn't empty.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common
from .graph import components
from .hashing import LOWER, Bitmap, mix, shingles, word_hashes

_U = np.uint64


class Classes:
    """Size classes and fragments for the threshold num / den."""

    def __init__(self, num: int, den: int, largest: int = 1 << 40):
        self.num, self.den, low, ends, parts, slack = num, den, 1, [], [], []
        while low <= largest:
            high = low * den // num
            d = 2 * high * (den - num) // (den + num)
            w = (d + 1) // 6
            ends.append(high)
            parts.append(d + 1 + w)
            slack.append(w)
            low = high + 1
        self.ends, self.parts, self.slack = np.array(ends), parts, slack

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.ends, n))


@lru_cache(8)
def classes(num: int, den: int) -> Classes:
    return Classes(num, den)


def fragment_keys(own: np.ndarray, c: Classes) -> list[tuple[int, np.ndarray, int]]:
    """(class, keys, need) for the set's own class and the next one; need is how many of the keys any set that links
    with this one must share. own: sorted distinct hashes, not empty."""
    home, mixed = c.of(len(own)), mix(own)
    total = np.zeros(len(own) + 1, _U)
    np.cumsum(mixed, out=total[1:])
    out = []
    for k in (home, home + 1):
        parts = c.parts[k]
        numbers = np.arange(parts, dtype=_U)
        # a hash whose high half times parts, divided by 2**32, is f lies in fragment f
        at = np.searchsorted(((own >> _U(32)) * _U(parts)) >> _U(32), np.arange(parts + 1, dtype=_U))
        keys = mix((total[at[1:]] - total[at[:-1]]) + mix(numbers + _U(k << 40)))
        empty = at[1:] == at[:-1]
        spare = int(empty.sum())
        if spare <= c.slack[k]:
            out.append((k, keys[~empty], c.slack[k] + 1 - spare))
        else:
            out.append((k, keys, 1))  # a partner may leave out up to slack empty keys
    return out


def unit_id(d1: np.ndarray | int, home: int, guest: int):
    """The vertex that stands for a set in its own class or, as a guest, in the next. As signed numbers guests are
    negative, so the largest of several tells whether one of them is at home."""
    return (mix(np.atleast_1d(np.asarray(d1, _U)) + mix(np.array([home + guest + 1], _U))) >> _U(1)) | _U(guest << 63)


def row_key(ids: pa.Array) -> np.ndarray:
    """A hash of an integer id; null is a value of its own."""
    return mix(np.array([0x5EED if x is None else x & (2**64 - 1) for x in ids.to_pylist()], _U))


def digest(own: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    with np.errstate(over="ignore"):
        n = np.array([len(own)], _U)
        return int(mix(mix(own).sum(dtype=_U) + n)[0]), int(mix(mix(own ^ _U(0xA5A5A5A5A5A5A5A5)).sum(dtype=_U) ^ n)[0])


def set_of(text: str | None, width: int) -> np.ndarray:
    return shingles(word_hashes((text or "").encode().translate(LOWER)), width)


def _signed(x) -> np.ndarray:
    return np.asarray(x, _U).view(np.int64)


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _heads(width: int, num: int, den: int):
    def run(batches):
        common.held("jaccard")
        c = classes(num, den)
        for batch in batches:
            n, d1, d2, home = [], [], [], []
            for text in batch.column("_text"):
                own = set_of(text.as_py(), width)
                n.append(len(own))
                a, b = digest(own) if len(own) else (None, None)
                d1.append(a if a is None else _long(a)), d2.append(b if b is None else _long(b)), home.append(c.of(len(own)) if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("th"), pa.array(_signed(row_key(batch.column("_id")))), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(home, pa.int32())],
                names=["_id", "th", "rk", "n", "d1", "d2", "home"],
            )

    return run


_HEADS = "_id long, th string, rk long, n long, d1 long, d2 long, home int"


def _units(width: int, num: int, den: int, known: Bitmap | None):
    """Rows (key, unit, need) of the texts, those only whose key may be known. Copies within a task emit once."""

    def run(batches):
        common.held("jaccard")
        c, seen = classes(num, den), set()
        for batch in batches:
            rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for text in batch.column("_text"):
                own = set_of(text.as_py(), width)
                if not len(own):
                    continue
                a, _ = digest(own)
                if a in seen:
                    continue
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add(a)
                for guest, (_, keys, need) in enumerate(fragment_keys(own, c)):
                    if known is not None:
                        keys = keys[known.has(_signed(keys))]
                    rows.append((_signed(keys), np.full(len(keys), _long(int(unit_id(a, c.of(len(own)), guest)[0])), np.int64), np.full(len(keys), need, np.int32)))
            if rows:
                key, unit, need = (np.concatenate(x) for x in zip(*rows))
                for i in range(0, len(key), 100_000):
                    z = slice(i, i + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(key[z]), pa.array(unit[z]), pa.array(need[z])], names=["key", "unit", "need"])

    return run


_UNITS = "key long, unit long, need int"


def _sets(width: int, num: int, den: int, known: Bitmap):
    """Rows (unit, home, d1, d2, n, own) of the documents whose row key is known."""

    def run(batches):
        common.held("jaccard")
        c = classes(num, den)
        for batch in batches:
            rows = []
            for i in np.flatnonzero(known.has(_signed(row_key(batch.column("_id"))))):
                own = set_of(batch.column("_text")[int(i)].as_py(), width)
                if not len(own):
                    continue
                a, b = digest(own)
                k = c.of(len(own))
                rows += [(_long(int(unit_id(a, k, guest)[0])), _long(a), _long(b), len(own), own.tobytes()) for guest in (0, 1)]
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=["unit", "d1", "d2", "n", "own"])

    return run


def overlaps(sets: list[np.ndarray], fragments: int = 8, width: int = 4096) -> np.ndarray:
    """The sizes of all intersections: partial counts for each fragment of the order, summed up."""
    m = len(sets)
    out = np.zeros((m, m), np.float32)
    if m < 2:
        return out
    everything, who = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    part = (everything >> _U(64 - fragments.bit_length() + 1)).astype(np.int64)
    for f in range(fragments):
        own = part == f
        values, place, count = np.unique(everything[own], return_inverse=True, return_counts=True)
        number = np.cumsum(count > 1) - 1
        shared = count[place] > 1
        row, column = who[own][shared], number[place[shared]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for start in range(0, int((count > 1).sum()), width):
            a, z = np.searchsorted(column, (start, start + width))
            x = np.zeros((m, width), np.float32)
            x[row[a:z], column[a:z] - start] = 1
            out += x @ x.T
    return out


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges from each member of a component to its first member."""
    left, out = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        if not left[root]:
            continue
        left[root] = False
        front = np.array([root])
        while len(front):
            new = np.flatnonzero(linked[front].any(0) & left)
            left[new] = False
            out += [(root, int(x)) for x in new]
            front = new
    return out


def _name(d1: int, d2: int) -> str:
    return f"{d1 & (2**64 - 1):016x}{d2 & (2**64 - 1):016x}"


def _links(num: int, den: int):
    """Batches sorted by (cluster, i, j): the links of each such group as a forest. Holds one group at a time."""

    def solve(group):
        own = list({(d1, d2): (n, s) for d1, d2, n, s in group}.items())
        if len(own) < 2:
            return []
        n = np.array([x[1][0] for x in own], np.float64)
        shared = overlaps([np.frombuffer(x[1][1], _U) for x in own]).astype(np.float64)
        linked = shared * den >= num * (n[:, None] + n[None] - shared)
        np.fill_diagonal(linked, False)
        return [(_name(*own[a][0]), _name(*own[b][0])) for a, b in forest(linked)]

    def run(batches):
        common.held("jaccard")
        at, group = None, []
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("cluster", "i", "j", "d1", "d2", "n", "own"))):
                if row[:3] != at:
                    out += solve(group)
                    at, group = row[:3], []
                group.append(row[3:])
            a, b = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["a", "b"])
        out = solve(group)
        a, b = zip(*out) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["a", "b"])

    return run


def _node(d1: str = "d1", d2: str = "d2"):
    return F.concat(F.lower(F.lpad(F.hex(d1), 16, "0")), F.lower(F.lpad(F.hex(d2), 16, "0")))


def _linked(rows: DataFrame, width: int, num: int, den: int, block_sets: int, block_bytes: int, broadcast_rows: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """From rows (_id, th, _text): heads, one row a row (_id, th, n, node; node is null for sets without n-grams), and
    nodes, one row a set (node, first: the smallest _id, component: a name of its component)."""
    heads = common.written(rows.mapInArrow(_heads(width, num, den), _HEADS), "jaccard-heads")
    n_rows = heads.count()
    texts = rows.select("_text")

    # keys that two different sets share, one of them at home: minima and maxima are taken before the shuffle
    several = lambda df: df.groupBy("key").agg(F.min("unit").alias("hub"), F.max("unit").alias("last"), F.count("*").alias("_n")).where("hub <> last AND last >= 0").select("key", "hub", "_n")
    shared = common.written(several(texts.mapInArrow(_units(width, num, den, None), _UNITS)).select("key"), "jaccard-keys")
    again = texts.mapInArrow(_units(width, num, den, Bitmap.of(shared, "key", Bitmap.bits_for(shared.count()), 2)), _UNITS).join(shared, "key").distinct()
    n_again, before = None, shared
    for _ in range(rounds):
        again = common.written(again, "jaccard-again", n_again)
        common.discard(before)
        before, n_again = again, again.count()
        enough = again.groupBy("unit").agg(F.count("*").alias("c"), F.max("need").alias("need")).where("c >= need").select("unit")
        again = again.join(enough, "unit")
        again = again.join(several(again).select("key"), "key").select("key", "unit", "need")
    again = common.written(again, "jaccard-again", n_again)
    common.discard(before)
    star = common.heavy_join(again, several(again), "key", "_n", again.count()).where("unit <> hub").select(F.col("unit").alias("a"), F.col("hub").alias("b")).distinct()
    groups = common.written(components(star).toDF("unit", "cluster"), "jaccard-groups", 2 * n_rows)

    # one row of each set stands for it
    small = heads.where("d1 IS NOT NULL").select("_id", "rk", "n", _node().alias("node"), "d1", "home")
    nodes = small.groupBy("node").agg(F.min("_id").alias("first"), F.min("rk").alias("rk"), F.first("d1").alias("d1"), F.first("home").alias("home"), F.first("n").alias("n"))
    nodes = common.written(nodes, "jaccard-nodes", n_rows)
    units = nodes.select("node", "rk", "n", F.col("d1"), F.col("home")).mapInArrow(_unit_rows, "node string, rk long, n long, unit long").join(groups, "unit")
    units = common.written(units, "jaccard-units", 2 * n_rows)
    n_blocks = F.greatest(F.ceil(F.count("*") / block_sets), F.ceil(F.sum("n") * 8 / block_bytes)).cast("int")

    def met(units: DataFrame, plan: DataFrame, block, others) -> DataFrame:
        """The links found where the sets of units meet: block is a set's own place in its cluster, others those it meets."""
        if plan.count() <= broadcast_rows:  # else the sets are shuffled once more, to meet their plan
            plan = F.broadcast(plan)
        sets = rows.mapInArrow(_sets(width, num, den, Bitmap.of(units, "rk")), "unit long, d1 long, d2 long, n long, own binary").join(plan, "unit")
        dealt = sets.withColumn("block", block).withColumn("other", F.explode(others)).select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "d1", "d2", "n", "own")
        links = dealt.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(_links(num, den), "a string, b string")
        return common.written(links, "jaccard-links")

    upto = lambda end: F.sequence(F.lit(0), end)
    count = units.groupBy("cluster").agg(n_blocks.alias("blocks"))
    plan = common.written(units.select("unit", "cluster").distinct().join(count, "cluster"), "jaccard-plan", 2 * n_rows)
    own = F.pmod(F.xxhash64("unit"), F.col("blocks")).cast("int")
    links = met(units, plan, own, F.when((F.col("blocks") == 1) | (own > 0), F.array(F.lit(0))).otherwise(F.filter(upto(F.col("blocks") - 1), lambda x: x > 0)))
    found = components(links).toDF("node", "component")

    # groups of several blocks of which not all sets are linked by now: those outside the largest component meet the rest
    large = units.join(plan.where("blocks > 1").select("unit", "cluster"), ["unit", "cluster"]).join(found, "node", "left").select("unit", "cluster", "rk", "n", F.coalesce("component", "node").alias("component"))
    sizes = large.groupBy("cluster", "component").agg(F.count("*").alias("c"), F.sum("n").alias("bytes"))
    top = sizes.groupBy("cluster").agg(F.max(F.struct("c", "component")).alias("top"), F.count("*").alias("parts")).where("parts > 1").select("cluster", F.col("top.component").alias("top"))
    open_units = common.written(large.join(top, "cluster").select("unit", "cluster", "rk", "n", (F.col("component") == F.col("top")).alias("inside")), "jaccard-open", 2 * n_rows)
    if not open_units.isEmpty():
        halves = open_units.groupBy("cluster", "inside").agg(n_blocks.alias("b")).groupBy("cluster").agg(F.max(F.when(~F.col("inside"), F.col("b"))).alias("outer"), F.max(F.when(F.col("inside"), F.col("b"))).alias("inner"))
        second = common.written(open_units.select("unit", "cluster", "inside").distinct().join(halves, "cluster"), "jaccard-second", 2 * n_rows)
        place = F.when(F.col("inside"), F.col("outer") + F.pmod(F.xxhash64("unit"), F.col("inner"))).otherwise(F.pmod(F.xxhash64("unit"), F.col("outer"))).cast("int")
        others = F.when(F.col("inside"), upto(F.col("outer") - 1)).otherwise(F.filter(upto(F.col("outer") + F.col("inner") - 1), lambda x: x != F.col("block")))
        more = met(open_units, second, place, others)
        found = components(links.unionByName(more)).toDF("node", "component")
        common.discard(second, more)
    named = nodes.select("node", "first").join(found, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    named = common.written(named, "jaccard-named", n_rows)
    common.discard(again, groups, units, plan, links, open_units, nodes)
    return heads.select("_id", "th", "n", F.when(F.col("d1").isNotNull(), _node()).alias("node")), named


def similarity_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_column: str = "doc_id", text_column: str = "text", block_sets: int = 256, block_bytes: int = 32 << 20, broadcast_rows: int = 400_000, rounds: int = 2) -> DataFrame:
    """(id, n_shingles long, component_id) for each row of docs.

    Words are runs of non-space characters with A-Z lower-cased; a document's set holds its distinct windows of `width`
    words, or, with fewer words, all of them as one window. Two documents link if den * intersection >= num * union;
    component_id is the smallest id reachable by links, the document's own included.

    Which groups sets are in is broadcast up to broadcast_rows rows of 20 bytes, and joined by a shuffle beyond that.

    Null and empty texts have no windows and link with nothing: component_id is their id. Null ids stay in their
    rows and are never a component's id, unless it has no other. Rows that repeat an id and text are each answered;
    other columns aren't read. Ids must be whole numbers. N-grams are compared by 64-bit hashes.
    """
    common.ship(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("_id"), F.lit(None).cast("string").alias("th"), F.col(text_column).alias("_text"))
    heads, nodes = _linked(rows, width, num, den, block_sets, block_bytes, broadcast_rows, rounds)
    least = nodes.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("_n"))
    answer = common.heavy_join(nodes.select("node", "component"), least, "component", "_n", nodes.count()).select("node", "component_id")
    out = heads.join(answer, "node", "left")
    return out.select(F.col("_id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component_id", "_id").alias("component_id"))


def _unit_rows(batches):
    for batch in batches:
        node = batch.column("node")
        rk, n, home = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rk", "n", "home"))
        d1 = batch.column("d1").to_numpy(zero_copy_only=False).view(_U)
        for guest in (0, 1):
            u = np.zeros(len(d1), np.int64)
            for k in np.unique(home):
                own = home == k
                u[own] = _signed(unit_id(d1[own], int(k), guest))
            yield pa.RecordBatch.from_arrays([node, pa.array(rk), pa.array(n), pa.array(u)], names=["node", "rk", "n", "unit"])


def _sifted(known: Bitmap, held: bool):
    """Rows whose last column, a key, the bitmap holds or doesn't hold, without that column."""

    def run(batches):
        common.held("jaccard")
        for batch in batches:
            has = known.has(batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False))
            yield batch.select(batch.schema.names[:-1]).filter(pa.array(has == held))

    return run


def keep_one(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_column: str = "doc_id", text_column: str = "text", block_sets: int = 256, block_bytes: int = 32 << 20, broadcast_rows: int = 400_000, rounds: int = 2) -> DataFrame:
    """The rows of docs, all columns, one of each component of similarity_components.

    The row with the smallest id stays, null ids come last; of several texts with that id the one with the smallest MD5.
    Rows that repeat its id and text go too: of those the one with the smallest hash of all columns stays. Rows are told
    apart by id and text, so another text with the id of a row that goes is judged on its own. Rows without words are
    linked with nothing and all stay, repeated ones too. An empty table stays empty. Ids must be whole numbers; other
    columns may have any name, but types that JSON can say.
    """
    common.ship(docs.sparkSession)
    names, th = docs.columns, F.md5(F.col(text_column).cast("binary"))
    rows = docs.select(F.col(id_column).cast("long").alias("_id"), th.alias("th"), F.col(text_column).alias("_text"))
    heads, nodes = _linked(rows, width, num, den, block_sets, block_bytes, broadcast_rows, rounds)
    # (id, text) with its rows counted, and its component
    told = heads.where(F.col("node").isNotNull()).groupBy("_id", "th", "node").agg(F.count("*").alias("rows"))
    told = common.written(told.join(nodes.select("node", "component"), "node").select("_id", "th", "rows", "component"), "jaccard-told")
    best = told.groupBy("component").agg(F.min(F.struct(F.col("_id").isNull().alias("x"), F.col("_id").alias("i"), F.col("th").alias("t"))).alias("best"), F.count("*").alias("_n"), F.sum("rows").alias("all")).where("all > 1").drop("all")
    stays = F.col("_id").eqNullSafe(F.col("best.i")) & (F.col("th") == F.col("best.t"))
    judged = common.heavy_join(told, best, "component", "_n", told.count()).select(F.col("_id").alias("_i"), F.col("th").alias("_t"), stays.alias("_stays"), "rows")
    judged = common.written(judged.where("NOT _stays OR rows > 1").select("_i", "_t", "_stays"), "jaccard-judged")
    common.discard(told)
    whole = docs.select(F.struct(*names).alias("_row"), F.col(id_column).cast("long").alias("_id"), th.alias("_th"))
    same = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_th") == F.col("_t"))
    # only rows that a bitmap of the judged ones holds meet them: the others would be shuffled for nothing
    known = Bitmap.of(judged.select(F.xxhash64("_i", "_t").alias("k")), "k", Bitmap.bits_for(judged.count()), 2)
    keyed = whole.withColumn("_k", F.xxhash64("_id", "_th"))
    listed, others = (keyed.mapInArrow(_sifted(known, x), whole.schema) for x in (True, False))
    out = others.unionByName(listed.join(judged, same, "left_anti")).select("_row.*")
    repeated = judged.where("_stays")
    if not repeated.isEmpty():
        one = listed.join(repeated, same).groupBy("_id", "_th").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row"))
        out = out.unionByName(one.select("_row.*"))
    return out


def op5_jaccard(spark, sf_dir: str) -> DataFrame:
    """similarity_components of all documents on three-word shingles at 90 of 100; rows as there."""
    return similarity_components(common.spread(common.table(spark, sf_dir, "documents").select("doc_id", "text")), 3, 90, 100)


SQL = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 90 * (x.n + y.n - m)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c(doc_id, other) AS (SELECT a, b FROM e UNION SELECT c.doc_id, e.b FROM c JOIN e ON e.a = c.other)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce((SELECT min(other) FROM c WHERE c.doc_id = d.doc_id), doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id)
"""
