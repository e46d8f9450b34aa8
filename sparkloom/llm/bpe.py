"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string its BPE encoding ends in one token, and that token is the only one, among the
tokens that are suffixes of the prefix, which forms a valid pair with the last token of the remaining prefix. A pair
(a, b) is valid if merging bytes(a) + bytes(b) gives just a, b. So one array, the last token of each prefix, holds the
encodings of all prefixes: bytes can be appended without starting again, and an edit keeps all entries before it.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common


def load_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by id. Ids must run from 0 without gaps."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class PrefixState:
    """A byte string with the last token of each of its prefixes; last[i] belongs to the first i bytes."""

    __slots__ = ("data", "last")

    def __init__(self) -> None:
        self.data = bytearray()
        self.last = array("i", [-1])


class PrefixBPE:
    """Encoder and decoder for one vocabulary.

    cache_bytes bounds the memory for known pieces, pair_limit that for known pairs; both only save time.
    """

    def __init__(self, tokens: list[bytes], pattern: str, cache_bytes: int = 160 << 20, pair_limit: int = 400_000):
        self.tokens, self.ids = tokens, {t: i for i, t in enumerate(tokens)}
        self.longest = max(map(len, tokens), default=0)
        self.split = regex.compile(pattern).findall
        self.pairs: dict[int, bool] = {}
        self.pair_limit = pair_limit
        self.cache_bytes = cache_bytes
        #: Lengths of the longer tokens by their last four bytes, the only long suffixes worth a look; then of all shorter ones.
        self.ends = self._lengths(tokens)
        #: The same without tokens that begin with a space: inside a piece that has spaces at its start only, these don't occur.
        self.inner_ends = self._lengths([t for t in tokens if t[:1] != b" "])
        self.spelled = [b"%d " % i for i in range(len(tokens))]

    @staticmethod
    def _lengths(tokens: list[bytes]) -> dict[bytes, tuple[int, ...]]:
        ends: dict[bytes, set[int]] = {}
        for t in tokens:
            if len(t) >= 4:
                ends.setdefault(t[-4:], set()).add(len(t))
        return {k: (*sorted(v, reverse=True), 3, 2, 1) for k, v in ends.items()}

    def merged(self, data: bytes) -> list[int]:
        """Plain BPE by ranks, for short strings: defines which pairs are valid."""
        ids, parts = self.ids, [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((ids.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if rank == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ids[p] for p in parts]

    def valid(self, a: int, b: int) -> bool:
        """Whether merges give the pair a, b; with a = -1, whether they give the token b at all."""
        key = a * len(self.tokens) + b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= self.pair_limit:
                self.pairs.clear()
            found = self.pairs[key] = self.merged(self.tokens[b]) == [b] if a < 0 else self.merged(self.tokens[a] + self.tokens[b]) == [a, b]
        return found

    def extend(self, state: PrefixState, more: bytes) -> PrefixState:
        """Append bytes to a state; the entries before them stay as they are."""
        start = len(state.data)
        state.data += more
        data, last, get, size, known, longest = bytes(state.data), state.last, self.ids.get, len(self.tokens), self.pairs.get, self.longest
        ends, add, short = (self.ends if b" " in data[1:] else self.inner_ends).get, last.append, (3, 2, 1)
        for end in range(start + 1, len(data) + 1):
            # the whole prefix is the longest candidate; before is -1 then: the token must only be reachable itself
            token = get(data[:end]) if end <= longest else None
            if token is not None and (known(token - size) or self.valid(-1, token)):
                add(token)
                continue
            for n in ends(data[end - 4 : end], short) if end > 3 else short:
                at = end - n
                if at <= 0:
                    continue
                token = get(data[at:end])
                if token is None:
                    continue
                before = last[at]
                found = known(before * size + token)
                if found or found is None and self.valid(before, token):
                    add(token)
                    break
            else:
                raise ValueError(f"byte {data[end - 1]} is not in the vocabulary")
        return state

    def edit(self, state: PrefixState, start: int, end: int, new: bytes) -> PrefixState:
        """Replace data[start:end] by new; only entries from the edit on are worked out again."""
        rest = bytes(state.data[end:])
        del state.data[start:], state.last[start + 1 :]
        return self.extend(state, new + rest)

    def tokens_of(self, state: PrefixState) -> list[int]:
        """The encoding of the whole state, read backwards along the last tokens."""
        out, end = [], len(state.data)
        while end:
            out.append(state.last[end])
            end -= len(self.tokens[state.last[end]])
        return out[::-1]

    def piece(self, data: bytes) -> list[int]:
        """One match of the pattern. A piece that is itself a token is that token, also where no merges lead to it."""
        whole = self.ids.get(data)
        return [whole] if whole is not None else self.tokens_of(self.extend(PrefixState(), data))

    def encode(self, text: str) -> list[int]:
        return [t for p in self.split(text) for t in self.piece(p.encode())]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class _Known(dict):
    """Pieces with their ids as decimal text, each id with a space after it.

    Bounded: when half of the bytes are used, this generation becomes the old one, and what is still asked for comes back.
    """

    def __init__(self, bpe: PrefixBPE):
        self.bpe, self.size, self.old = bpe, 0, {}

    def __missing__(self, piece: str) -> bytes:
        text = self.old.get(piece)
        if text is None:
            text = b"".join(map(self.bpe.spelled.__getitem__, self.bpe.piece(piece.encode())))
        if len(piece) <= 64:
            self.size += 230 + 2 * len(piece) + len(text)
            if self.size > self.bpe.cache_bytes // 2:
                self.old = dict(self)
                self.clear()
                self.size = 0
            self[piece] = text
        return text


class _Spoken(dict):
    """Bytes of runs of ids in decimal text, by the table of tokens: the decoder sees ids only. Bounded: emptied when full."""

    def __init__(self, bpe: PrefixBPE, limit: int):
        self.table, self.size, self.limit = {k[:-1]: t for k, t in zip(bpe.spelled, bpe.tokens)}, 0, limit

    def __missing__(self, ids: bytes) -> bytes:
        data = b"".join(map(self.table.__getitem__, ids.split()))
        if len(ids) <= 64:
            self.size += 200 + len(ids) + len(data)
            if self.size > self.limit:
                self.clear()
                self.size = 0
            self[ids] = data
        return data


def _engine(tokens_path: str, pattern: str, cache_bytes: int) -> tuple[PrefixBPE, _Known, _Spoken]:
    """Kept by a worker from task to task."""
    kept = common.held("bpe")
    key = (tokens_path, pattern, cache_bytes)
    if key not in kept:
        kept.clear()
        bpe = PrefixBPE(load_ranks(tokens_path), pattern, cache_bytes)
        kept[key] = bpe, _Known(bpe), _Spoken(bpe, cache_bytes // 3)
    return kept[key]


#: Characters that are split and encoded in one go; cuts fall only where a match of the pattern ends anyway.
_BLOCK = 1 << 18


def blocks(text: str, size: int = _BLOCK) -> Iterator[str]:
    """Cut a long text before a space that follows a non-space and precedes a non-space: a match starts there."""
    start = 0
    cut = regex.compile(r"(?<=\S) (?=\S)")
    while len(text) - start > size:
        m = cut.search(text, start + size)
        if m is None:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def encode_rows(tokens_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", cache_bytes: int = 160 << 20, with_tokens: bool = False):
    """For mapInArrow: ids and round trip of each text."""

    def run(batches):
        bpe, known, spoken = _engine(tokens_path, pattern, cache_bytes)
        split = bpe.split
        for batch in batches:
            n, ids, back, rows = [], [], [], []
            for text in batch.column(text_column).to_pylist():
                count, digest, decoded, first, own = 0, hashlib.sha256(), hashlib.sha256(), True, []
                for part in blocks(text or ""):
                    pieces = list(map(known.__getitem__, split(part)))
                    said = b"".join(pieces)
                    if said:
                        digest.update(said[:-1] if first else b" " + said[:-1])
                        first = False
                        count += said.count(b" ")
                        decoded.update(b"".join(map(spoken.__getitem__, pieces)))
                        if with_tokens:
                            own.append(np.array(said.split(), "S").astype(np.int32))
                ids.append(digest.hexdigest())
                n.append(count)
                back.append(decoded.hexdigest())
                if with_tokens:
                    rows.append(np.concatenate(own) if own else np.empty(0, np.int32))
            columns = {id_column: batch.column(id_column), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
            if with_tokens:
                columns["tokens"] = pa.array(rows, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def encode_documents(docs: DataFrame, tokens_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", with_tokens: bool = False) -> DataFrame:
    """Token count and digests of the ids and of the decoded bytes, one row for each row of docs; on request also
    tokens array<int>.

    Null and empty texts: 0 tokens, digests of the empty string. Null ids stay null, repeated rows stay repeated, an
    empty table gives no rows; other columns of docs are not read. tokens_path is a rank file that every executor has.
    """
    common.ship(docs.sparkSession)
    kept = docs.select(id_column, text_column)
    kind = kept.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", tokens array<int>" * with_tokens
    return kept.mapInArrow(encode_rows(tokens_path, pattern, id_column, text_column, with_tokens=with_tokens), schema)


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    """Token counts and digests of all documents; a row for each, null texts as empty ones."""
    import public_tokenizers

    return encode_documents(common.spread(common.table(spark, sf_dir, "documents").select("doc_id", "text")), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
