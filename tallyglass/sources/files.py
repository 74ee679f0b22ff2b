"""Files in and out: typed CSV, JSON lines of questions and triples, frozen packs, run folders."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.operators.retrieval import sealed, tampered
from tallyglass.sources import embedded
from tallyglass.sources.catalog import DECLARED

QUESTION = (
    T.StructType()
    .add("id", "string")
    .add("question", "string")
    .add("gold_sql", "string")
    .add("expected_rows", T.StructType().add("sha256", "string").add("n_rows", "long"))
    .add("date", "string")
    .add("difficulty", "string")
    .add("category", "string")
    .add("split", "string")
    .add("source", "string")
)
#: The legal values of a question's labels.
LEGAL = {
    "difficulty": ("easy", "medium", "hard"),
    "split": ("train_ok", "heldout"),
    "category": ("per_order_lookup", "aggregation", "multi_table_join", "review_text"),
    "source": ("human", "template+human-verified"),
}


class InvalidQuestion(ValueError):
    """A question lacks a required field or has an illegal label."""


def require(paths: Sequence[str]) -> None:
    """Fail before anything is loaded where a local file is missing."""
    for p in paths:
        if not urlparse(p).scheme and not os.path.exists(p):
            raise FileNotFoundError(p)


def typed(column: str, kind: T.DataType) -> F.Column:
    """A text cell as its declared type: an empty one is null but in text columns; one that does not parse is null."""
    c = F.regexp_replace(F.col(column), "^﻿", "")
    return c.alias(column) if isinstance(kind, T.StringType) else F.when(F.trim(c) != "", c).try_cast(kind).alias(column)


def read_csv(spark: SparkSession, paths: str | Sequence[str], columns: Mapping[str, str] | None = None) -> DataFrame:
    """One table from one or more CSV files: declared types, or all text by header. Columns a file lacks are empty text."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    require(paths)
    raw = spark.read.options(header=True, quote='"', escape='"', multiLine=True, emptyValue="", nullValue="\x00", encoding="UTF-8").csv(paths)
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    if not columns:
        return raw.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in raw.columns])
    for c in columns:
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(""))
    filled = raw.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns])
    return filled.select(*[typed(c, DECLARED.get(kind.upper().split("(")[0], T.StringType())) for c, kind in columns.items()])


def ingest(spark: SparkSession, sources: Mapping[str, str | Sequence[str]], columns: Mapping[str, Mapping[str, str]], out: str, partition_by: Mapping[str, str] | None = None) -> dict[str, int]:
    """Load every table to Parquet under `out`; returns row counts. A list of files is one table."""
    for paths in sources.values():
        require([paths] if isinstance(paths, str) else paths)
    counts = {}
    for name, paths in sources.items():
        writer = read_csv(spark, paths, columns.get(name)).write.mode("overwrite")
        if column := (partition_by or {}).get(name):
            writer = writer.partitionBy(column)
        writer.parquet(f"{out}/{name}.parquet")
        counts[name] = spark.read.parquet(f"{out}/{name}.parquet").count()
    return counts


def connect(spark: SparkSession, uri: str, table: str) -> DataFrame:
    """A table by URI: a folder of Parquet, CSV or JSON, a SQLite or DuckDB file, or a JDBC address where its driver is on the class path.

    `sqlite:///a.db` is a path from here, `sqlite:////a.db` one from the root; duckdb likewise.
    """
    scheme, _, rest = uri.partition("://")
    if scheme in ("sqlite", "duckdb"):
        return embedded.read(spark, scheme, rest.removeprefix("/"), table)
    if scheme in ("parquet", "csv", "json"):
        return spark.read.options(header=True).format(scheme).load(f"{rest}/{table}.{scheme}")
    if uri.startswith("jdbc:") or scheme in ("postgres", "postgresql"):
        address = uri if uri.startswith("jdbc:") else f"jdbc:postgresql://{rest}"
        return spark.read.format("jdbc").options(url=address, dbtable=table).load()
    raise ValueError(f"no connector for {uri}")


def put(df: DataFrame, uri: str, table: str, primary_key: Sequence[str] = (), indexes: Sequence[Sequence[str]] = ()) -> None:
    """Replace a table behind a URI that connect() reads: keys and indexes go where the store has them."""
    scheme, _, rest = uri.partition("://")
    if scheme in ("parquet", "csv", "json"):
        df.write.mode("overwrite").options(header=True).format(scheme).save(f"{rest}/{table}.{scheme}")
    elif scheme == "sqlite":
        embedded.write_sqlite(df, rest.removeprefix("/"), table, primary_key, indexes)
    elif uri.startswith("jdbc:") or scheme in ("postgres", "postgresql"):
        address = uri if uri.startswith("jdbc:") else f"jdbc:postgresql://{rest}"
        df.write.mode("overwrite").format("jdbc").options(url=address, dbtable=table).save()
    else:
        raise ValueError(f"no connector for {uri}")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON-lines file; blank lines are skipped, a missing field is an error that names file and line."""
    found = spark.read.schema(QUESTION).json(path)
    lacking = found.where(F.greatest(*[F.col(c).isNull() for c in QUESTION.names])).limit(1)
    if not lacking.isEmpty():
        raise InvalidQuestion(_first_lacking(spark, path))
    return found


def _first_lacking(spark: SparkSession, path: str) -> str:
    """file:line and field of the first line that lacks one, in the order of files and lines."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\n")).alias("at", "line"))
    parsed = lines.where(F.trim("line") != "").withColumn("q", F.from_json("line", QUESTION))
    missing = F.filter(F.array(*[F.when(F.col("q").isNull() | F.col(f"q.{c}").isNull(), F.lit(c)) for c in QUESTION.names]), lambda x: x.isNotNull())
    row = parsed.withColumn("missing", missing).where(F.size("missing") > 0).orderBy("file", "at").select("file", "at", "missing").first()
    return f"{row.file}:{row.at + 1}: lacks {row.missing[0]}"


def illegal_labels(questions: DataFrame) -> DataFrame:
    """id, field: the first illegal label of each question."""
    bad = None
    for name, values in LEGAL.items():
        wrong = ~F.coalesce(F.col(name).isin(*values), F.lit(False))
        bad = F.when(wrong, name) if bad is None else bad.when(wrong, name)
    return questions.select("id", bad.alias("field")).where("field IS NOT NULL")


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def freeze_packs(packs: DataFrame, path: str) -> None:
    """Gzipped JSON lines, each with the hash of its content."""
    sealed(packs).write.mode("overwrite").option("compression", "gzip").json(path)


def thaw_packs(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Frozen packs, or an error where one was changed. `schema` is that of the packs before freezing."""
    frozen = spark.read.schema(T.StructType([*schema.fields, T.StructField("sha256", T.StringType())])).json(path)
    if not tampered(frozen).isEmpty():
        raise ValueError(f"{path}: a pack does not match its hash")
    return frozen.drop("sha256")


def write_run(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").partitionBy("system").json(path)


def latest_summaries(spark: SparkSession, paths: Sequence[str], schema: T.StructType) -> DataFrame:
    """Summaries of many runs; of each (system, role) the one generated last stays, of those the one from the last path by name."""
    found = spark.read.schema(schema).json(list(paths)).withColumn("path", F.col("_metadata.file_path"))
    when = [F.desc_nulls_last("generated_at")] if "generated_at" in found.columns else []
    order = Window.partitionBy("system", "role").orderBy(*when, F.desc("path"))
    return found.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """set, idx, question, schema, gold_sql of an items dump: one JSON document, an object of lists by set or a list with `set`.

    idx is the place in the set's list. A flat item without a set is of `in_dist`.
    """
    item = "array<struct<set:string,question:string,schema:string,gold_sql:string>>"
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    by_set = text.where(F.col("value").startswith("{")).select(F.explode(F.from_json("value", f"map<string,{item}>")).alias("name", "list"))
    flat = text.where(F.col("value").startswith("[")).select(F.lit(None).cast("string").alias("name"), F.from_json("value", item).alias("list"))
    each = by_set.unionByName(flat).select("name", F.posexplode("list").alias("place", "item"))
    named = each.select(F.coalesce("name", "item.set", F.lit("in_dist")).alias("set"), "place", "item.question", "item.schema", "item.gold_sql")
    idx = F.row_number().over(Window.partitionBy("set").orderBy("place")) - 1
    return named.withColumn("idx", idx).select("set", "idx", "question", "schema", "gold_sql")


def write_benchmark_csv(results: DataFrame, path: str) -> None:
    """Item results of a benchmark as CSV with a header."""
    results.write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)


def replaced(rows: DataFrame, path: str) -> None:
    """Write a table in place of the one at `path`, whole or not at all: written beside it, then renamed.

    `rows` may read the table itself. Where the write fails the old table is as it was, and what was written is removed; where
    the second rename fails the old table is put back.
    """
    spark = rows.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    new, old, here = (hadoop(path.rstrip("/") + end) for end in (".new", ".old", ""))
    system = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        rows.write.mode("overwrite").parquet(new.toString())
    except BaseException:
        system.delete(new, True)
        raise
    system.delete(old, True)
    was = system.exists(here)
    if was and not system.rename(here, old):
        raise OSError(f"cannot move {path}")
    if not system.rename(new, here):
        if was:
            system.rename(old, here)
        raise OSError(f"cannot replace {path}")
    system.delete(old, True)
