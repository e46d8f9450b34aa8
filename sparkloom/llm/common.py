"""What the operators of this subpackage share: table access, shared storage, shipping code to executors."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import os
import re
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

_SHIPPED: "weakref.WeakSet" = weakref.WeakSet()
_ROOT = Path(__file__).resolve().parents[1]


#: What operators keep in a Python worker from task to task, by operator.
_HELD: dict[str, dict] = {}


def held(owner: str) -> dict:
    """The owner's part of what this worker keeps. What others kept goes: a worker outlives the stages of a job, and one
    operator's tables would count against the next one's memory."""
    others = [k for k in _HELD if k != owner]
    for other in others:
        del _HELD[other]
    if others:
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # freed memory goes back to the system, where the C library can do that
            ctypes.CDLL(None).malloc_trim(0)
    return _HELD.setdefault(owner, {})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out evenly if it has fewer partitions than there are cores: a table of a few row groups would else keep
    most cores idle. Such a table has a few hundred MB a core at most, so the shuffle is small; larger ones stay as is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per context, so that workers can import it wherever they run."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")  # texts are long: 10,000 may be a GB
    sc = spark.sparkContext
    if sc in _SHIPPED:
        return
    path = os.path.join(os.path.realpath(tempfile.mkdtemp()), f"{_ROOT.name}_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, p.relative_to(_ROOT.parent))
    sc.addPyFile(path)
    _SHIPPED.add(sc)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session gets a folder
    of its own; on a cluster that would be another disk on every machine, so it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is unset and {master or 'this session'} isn't local: name a folder that all executors share")
        found = "file:/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it again. Survives the loss of executors.

    rows: how many narrow rows df has at most, if that is known. So many tasks write it as a million rows each need:
    loops over small tables would else leave a file for each shuffle partition in every round.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, math.ceil(rows / 1_000_000)))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that written() made and that no DataFrame to come reads any more."""
    for df in tables:
        path = getattr(df, "written_path", None)
        if path:
            jvm = df.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def heavy_join(left: DataFrame, right: DataFrame, on: str | list[str], weight: str, n_left: int, how: str = "inner", at_least: int = 100_000) -> DataFrame:
    """left joined with right, which has one row a key, where some keys may hold a large part of left.

    weight: right's count of left's rows with the key. At most 10,000 keys can have a ten-thousandth of the n_left rows
    or more; those are broadcast, so left's rows stay where they are, and only the other keys are shuffled. left is read
    twice then and should be a written table. weight is dropped.
    """
    bar = max(at_least, -(-n_left // 10_000))
    hot = right.where(F.col(weight) >= bar)
    if n_left < bar or hot.isEmpty():
        return left.join(right.drop(weight), on, how)
    hot, cold = F.broadcast(hot.drop(weight)), right.where(F.col(weight) < bar).drop(weight)
    return left.join(hot, on).unionByName(left.join(hot, on, "left_anti").join(cold, on, how))


def numbered(df: DataFrame, group: str, order: list, name: str) -> DataFrame:
    """df with column `name`: the place (long, from 0) of each row in its group, in the order given.

    A group may be most of the table: rows are dealt by ranges of (group, order), each range counts its own, and what lies
    before in other ranges is added. A null group is a group. Rows that are equal in order have any of their places.
    """
    spark = df.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = written(df.repartitionByRange(ranges, F.col(group).asc_nulls_first(), *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range", group).agg(F.count("*").alias("_c"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    before = before.select(F.col("_range").alias("_r"), F.col(group).alias("_g"), "_before")
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy("_range", group).orderBy(*order)))
    met = own.join(before, (F.col("_range") == F.col("_r")) & F.col(group).eqNullSafe(F.col("_g")))
    return met.select(*df.columns, (F.col("_before") + F.col("_own") - 1).alias(name))
