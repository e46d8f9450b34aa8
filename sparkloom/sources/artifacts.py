"""Artifacts: staged, checked, then published as what was reviewed; never overwritten in place.

An artifact is a folder per generation, `<root>/<name>/digest=<digest>/`, of Parquet by prefix, and a numbered pointer
file that names the current one. The digest is taken over the rows, whatever their order or files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def table_digest(rows: DataFrame) -> str:
    """SHA-256 over the multiset of rows: each row's digest, counted and summed by its first bytes, then hashed. Two
    passes of partial sums, never a sort of all rows."""
    text = F.to_json(F.struct(*sorted(rows.columns)))
    parts = F.sha2(text, 256)
    one = rows.select(parts.alias("h"))
    sums = [F.sum(F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(5)]
    got = one.agg(F.count("*").cast("string"), *sums).first()
    import hashlib

    return hashlib.sha256("|".join(str(x) for x in got).encode()).hexdigest()


class Store:
    """Artifacts below a root that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def folder(self, name: str, digest: str) -> str:
        return f"{self.root}/{name}/digest={digest}"

    def stage(self, name: str, rows: DataFrame, checks: list[DataFrame] | None = None, key: str = "id") -> str:
        """Write rows by the first two characters of key and return their digest. Findings of a check stop it. A
        generation that exists already is left as it is: content decides the address."""
        for found in checks or []:
            bad = found.limit(20).collect()
            if bad:
                raise ValueError(f"{name}: {len(bad)} or more findings, such as {bad[0]}")
        digest = table_digest(rows)
        if not self._exists(f"{self.folder(name, digest)}/_SUCCESS"):
            rows.withColumn("prefix", F.substring(F.col(key), 1, 2)).write.mode("overwrite").partitionBy("prefix").parquet(self.folder(name, digest))
        return digest

    def validate(self, name: str, digest: str) -> DataFrame:
        """Read a generation again and compare its digest."""
        rows = self.spark.read.parquet(self.folder(name, digest))
        if table_digest(rows.drop("prefix")) != digest:
            raise ValueError(f"{name}: rows don't match digest {digest}")
        return rows

    def publish(self, name: str, expected: str, checks: Callable[[DataFrame], list[DataFrame]] | None = None) -> None:
        """Make the generation that was reviewed the current one; checks run once more on what was written.

        Pointers are numbered files, and the one with the largest number counts. A new one is written under another name
        and gets its own by a rename onto a name that is free, so at any moment some whole pointer is there, and of two
        writers with the same number one fails. Older pointers go afterwards.
        """
        rows = self.validate(name, expected)
        for found in checks(rows.drop("prefix")) if checks else []:
            bad = found.limit(20).collect()
            if bad:
                raise ValueError(f"{name}: {len(bad)} or more findings, such as {bad[0]}")
        had = self._pointers(name)
        fs, new = self._fs(f"{self.root}/{name}/pointer.{uuid.uuid4().hex}")
        out = fs.create(new, False)
        out.write(bytearray(json.dumps({"digest": expected}).encode()))
        out.close()
        _, place = self._fs(f"{self.root}/{name}/current-{max(had, default=0) + 1:012d}.json")
        if fs.exists(place) or not fs.rename(new, place):
            fs.delete(new, False)
            raise OSError(f"{name}: another writer published meanwhile")
        for n in had:
            fs.delete(self._fs(f"{self.root}/{name}/current-{n:012d}.json")[1], False)

    def _pointers(self, name: str) -> list[int]:
        fs, p = self._fs(f"{self.root}/{name}")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(x[8:-5]) for x in names if x.startswith("current-") and x.endswith(".json"))

    def current(self, name: str) -> str | None:
        had = self._pointers(name)
        return json.loads(self.spark.read.text(f"{self.root}/{name}/current-{had[-1]:012d}.json", wholetext=True).first()[0])["digest"] if had else None

    def read(self, name: str) -> DataFrame | None:
        """Rows of the current generation; None where nothing is published."""
        digest = self.current(name)
        return None if digest is None else self.spark.read.parquet(self.folder(name, digest))

    def at(self, name: str, digest: str) -> DataFrame:
        """Rows of the generation with this digest, current or not, while it isn't pruned."""
        if not self._exists(f"{self.folder(name, digest)}/_SUCCESS"):
            raise ValueError(f"{name}: no generation {digest}")
        return self.spark.read.parquet(self.folder(name, digest))

    def unused(self, name: str) -> list[str]:
        """Digests of generations that are not current: what may be pruned."""
        fs, p = self._fs(f"{self.root}/{name}")
        now = self.current(name)
        return [] if not fs.exists(p) else sorted(d for s in fs.listStatus(p) if (d := s.getPath().getName().removeprefix("digest=")) != s.getPath().getName() and d != now)

    def prune(self, name: str, expected: str) -> list[str]:
        """Delete generations other than the current one, which must be the expected one."""
        if self.current(name) != expected:
            raise ValueError(f"{name}: the current generation is another one")
        gone = self.unused(name)
        for d in gone:
            fs, p = self._fs(self.folder(name, d))
            fs.delete(p, True)
        return gone


def shard_index(rows: DataFrame, key: str = "id") -> DataFrame:
    """prefix, records and an order-free digest for each shard."""
    one = rows.withColumn("prefix", F.substring(key, 1, 2)).withColumn("_h", F.xxhash64(F.to_json(F.struct(*sorted(rows.columns)))))
    return one.groupBy("prefix").agg(F.count("*").alias("records"), F.bit_xor("_h").alias("_x"), F.sum(F.pmod("_h", F.lit(1 << 31))).alias("_s")).select("prefix", "records", F.sha2(F.concat_ws("|", "records", "_x", "_s"), 256).alias("digest"))


def receipts(rows: DataFrame, key: str = "idempotency_key", seq: str = "seq") -> DataFrame:
    """The first receipt of each key; later ones with another content are conflicts and get a flag on it."""
    body = F.sha2(F.to_json(F.struct(*[c for c in sorted(rows.columns) if c not in (key, seq)])), 256)
    r = rows.withColumn("_b", body)
    return r.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), seq).alias("r"), (F.count_distinct("_b") > 1).alias("conflict")).select(key, "r.*", "conflict")
