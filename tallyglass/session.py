"""Session factory and table access shared by every query."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

#: Settings every session of this engine is built with; a cluster may override any of them at submit time.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def build_session(app: str = "tallyglass", master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS, then `conf` on top (keys with dots as plain dict entries)."""
    builder = SparkSession.builder.appName(app).config(map=DEFAULTS | conf)
    return (builder.master(master) if master else builder).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; columns are pruned and filters pushed by Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    """Temp views over the Parquet tables, for SQL text."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`; where that is unset and all run on one machine, a local one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tallyglass-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path as that takes it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    system, where = hadoop(spark, f"{path}/_SUCCESS")
    return bool(system.exists(where))


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write to a new folder of the shared one and read back: computed once, and whole after executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held(df: DataFrame) -> DataFrame:
    """Keep what several steps read, on executors' disks where memory is short; what is lost with one is made again."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package where it is neither installed nor in their working folder."""
    root, known = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([*paths, root])
