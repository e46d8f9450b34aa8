"""Digests: canonical JSON, project ids, digests of several entries."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def canonical_json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def digest(value: object) -> str:
    """SHA-256 of a value's canonical JSON: for artifacts on the driver."""
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


@F.pandas_udf(T.StringType())
def json_digest(text: pd.Series) -> pd.Series:
    """SHA-256 of the canonical form of JSON texts; null for what isn't JSON. to_json() keeps the order of fields, so a
    digest of its result would depend on a schema's order."""

    def one(x):
        try:
            return None if x is None else digest(json.loads(x))
        except ValueError:
            return None

    return text.map(one)


@F.pandas_udf(T.StringType())
def record_digest(text: pd.Series) -> pd.Series:
    """As json_digest, of a record without its field digest, with whole numbers written as such."""

    def plain(x):
        if isinstance(x, float) and x.is_integer() and abs(x) < 2**53:
            return int(x)
        return [plain(y) for y in x] if isinstance(x, list) else {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else x

    def one(x):
        try:
            v = json.loads(x) if x is not None else None
        except ValueError:
            return None
        return None if not isinstance(v, dict) else digest(plain({k: y for k, y in v.items() if k != "digest"}))

    return text.map(one)


def project_id(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 20)


def entries_digest(entries: Column) -> Column:
    """Digest of array<struct<path, content>>: paths in order, each followed by NUL, its content and NUL."""
    said = F.transform(F.array_sort(entries), lambda e: F.concat(e["path"], F.lit("\0"), e["content"], F.lit("\0")))
    return F.sha2(F.array_join(said, ""), 256)
