"""Shared folder, table writes and text normalisation used by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that `[\x20\x09-\x0D]` names.
ASCII_SPACE = " \t\n\x0b\x0c\r"


#: Intermediate tables: row groups of 16 MB, so a task that writes long texts holds little of them.
PARQUET = {"parquet.block.size": str(1 << 24)}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`; where that is unset and all run on one machine, a local one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tallyglass-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it outlives the call because lazy results read from it."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system Spark reads; none where there is no such folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in system.listStatus(where)) if system.exists(where) else []


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names like `names` that none of `taken` clashes with."""
    have = {c.lower() for c in taken}
    return ["_" * next(n for n in range(len(have) + 1) if "_" * n + name.lower() not in have) + name for name in names]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors, is computed once."""
    path = scratch(df.sparkSession, name)
    df.write.options(**PARQUET).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Row numbers that are broadcast at most (16 bytes each as a hash table); more are shuffled, and the rows with them.
FEW_ROWS = 500_000


def located(docs: DataFrame, at: str, by: str = "doc_id") -> DataFrame:
    """`docs` with a number that names each row for good: its `by` where that is unique and never null, else one that is written down."""
    key = F.col(by).cast("long")
    if docs.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR k IS NULL").isEmpty():
        return docs.withColumn(at, key)
    return materialize(docs.withColumn(at, F.monotonically_increasing_id()), "located")


def without(rows: DataFrame, at: str, gone: DataFrame) -> DataFrame:
    """`rows` without those whose number is in the one column of `gone`. Few numbers go to the rows; many meet them in a shuffle."""
    (name,) = fresh(rows.columns, "gone")
    gone = materialize(gone.toDF(name), "gone")
    hint = "broadcast" if gone.count() <= FEW_ROWS else "shuffle_hash"
    return rows.join(gone.hint(hint), F.col(at) == F.col(name), "left_anti")


def bucketed(df: DataFrame, name: str, by: str, n: int) -> DataFrame:
    """Write to the shared folder in `n` buckets by a column and read back: joins on it leave these rows where they are."""
    spark = df.sparkSession
    path = scratch(spark, name)
    table = "tallyglass_" + path.rsplit("/", 1)[1].replace("-", "_")
    df.repartition(n, by).write.options(**PARQUET).format("parquet").bucketBy(n, by).option("path", path).saveAsTable(table)
    try:
        return spark.table(table).select("*")
    finally:
        spark.sql(f"DROP TABLE {table}")  # the catalog's entry only: the files are outside its folder and stay


def release(spark: SparkSession) -> None:
    """Let the driver's collector see finished shuffles: executors delete their files once no plan refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return freed memory to the system: allocators keep it, and a Python worker outlives many tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def lean(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that leaves its worker small when its task ends."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def text_of(column: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package where it is neither installed nor in their working folder."""
    root, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([*paths, root])
