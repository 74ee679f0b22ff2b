"""SQLite and DuckDB files as Spark sources and sinks, through Spark's Python data sources.

A table is read in ranges of its row number, a partition each, as Arrow batches; gaps in the numbers cost nothing, and a
table that has no row number is one partition. The file must be in a folder that the executors see. Writing goes through one connection in one transaction, batch by batch, and is rolled back on any failure.
"""

from __future__ import annotations

import contextlib
import sqlite3
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallyglass.session import importable

#: Rows of a batch, and rows of a partition at least.
BATCH = 10_000
PARTITION = 100_000
#: SQLite's rules for the affinity of a declared type, tried in order; and how Spark's types are declared.
AFFINITY = (("INT", T.LongType()), ("CHAR", T.StringType()), ("CLOB", T.StringType()), ("TEXT", T.StringType()), ("REAL", T.DoubleType()), ("FLOA", T.DoubleType()), ("DOUB", T.DoubleType()))
DECLARED = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL"}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def sqlite_connection(path: str, read_only: bool = True) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path)}?mode={'ro' if read_only else 'rwc'}", uri=True, isolation_level=None)


def _arrow(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    """Rows as the declared types; a cell that does not fit its column's type is null, as a typed column has it."""
    kinds = {"bigint": (pa.int64(), int), "double": (pa.float64(), float), "string": (pa.string(), str)}

    def cell(v, make):
        try:
            return None if v is None else make(v)
        except (TypeError, ValueError):
            return None

    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    arrays = [pa.array([cell(v, kinds[f.dataType.simpleString()][1]) for v in c], kinds[f.dataType.simpleString()][0]) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema.names)


class Range(InputPartition):
    """Row numbers from low to below high; None is no bound."""

    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: T.StructType):
        self.path, self.table, self.columns = path, table, schema

    def partitions(self) -> Sequence[Range]:
        """Cuts at every PARTITION-th row that there is, so rows with far-off numbers are no partitions of their own."""
        with contextlib.closing(sqlite_connection(self.path)) as c:
            if not has_rowid(c, self.table):
                return [Range(None, None)]
            numbered = f"SELECT rowid AS id, row_number() OVER (ORDER BY rowid) AS n FROM {quoted(self.table)}"
            cuts = [r[0] for r in c.execute(f"SELECT id FROM ({numbered}) WHERE n % {PARTITION} = 1 OR {PARTITION} = 1 ORDER BY id")]
        return [Range(a, b) for a, b in zip(cuts, [*cuts[1:], None], strict=True)] if cuts else [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        names = ", ".join(quoted(n) for n in self.columns.names)
        bounds = [(sign, x) for sign, x in ((">=", partition.low), ("<", partition.high)) if x is not None]
        where = " AND ".join(f"rowid {sign} ?" for sign, _ in bounds) or "1"
        with contextlib.closing(sqlite_connection(self.path)) as c:
            found = c.execute(f"SELECT {names} FROM {quoted(self.table)} WHERE {where}", [x for _, x in bounds])
            while rows := found.fetchmany(BATCH):
                yield _arrow(rows, self.columns)


def has_rowid(c: sqlite3.Connection, table: str) -> bool:
    """Whether the table has SQLite's own row number; those WITHOUT ROWID, views, and ones with a column of that name have not."""
    names = {r[1].lower() for r in c.execute(f"PRAGMA table_info({quoted(table)})")}
    plain = c.execute("SELECT type FROM sqlite_master WHERE lower(name) = lower(?)", (table,)).fetchone()
    if "rowid" in names or plain != ("table",):
        return False
    try:
        c.execute(f"SELECT rowid FROM {quoted(table)} LIMIT 0")
    except sqlite3.OperationalError:
        return False
    return True


class SqliteSource(DataSource):
    """Options: path, dbtable."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        return sqlite_schema(self.options["path"], self.options["dbtable"])

    def reader(self, schema: T.StructType) -> SqliteReader:
        return SqliteReader(self.options["path"], self.options["dbtable"], schema)


class DuckReader(DataSourceReader):
    def __init__(self, path: str, table: str, names: list[str]):
        self.path, self.table, self.names = path, table, names

    def partitions(self) -> Sequence[Range]:
        import duckdb

        with duckdb.connect(self.path, read_only=True) as c:
            (n,) = c.execute(f"SELECT coalesce(max(rowid) + 1, 0) FROM {quoted(self.table)}").fetchone()  # deleted rows leave gaps
        return [Range(a, min(a + PARTITION, n)) for a in range(0, n, PARTITION)] or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        import duckdb

        names = ", ".join(quoted(n) for n in self.names)
        with duckdb.connect(self.path, read_only=True) as c:
            found = c.execute(f"SELECT {names} FROM {quoted(self.table)} WHERE rowid >= ? AND rowid < ?", (partition.low, partition.high))
            yield from found.to_arrow_reader(BATCH)


class DuckSource(DataSource):
    """Options: path, dbtable."""

    @classmethod
    def name(cls) -> str:
        return "duckdb"

    def schema(self) -> T.StructType:
        import duckdb
        from pyspark.sql.pandas.types import from_arrow_schema

        with duckdb.connect(self.options["path"], read_only=True) as c:
            return from_arrow_schema(c.execute(f"SELECT * FROM {quoted(self.options['dbtable'])} LIMIT 0").to_arrow_reader(1).schema)

    def reader(self, schema: T.StructType) -> DuckReader:
        return DuckReader(self.options["path"], self.options["dbtable"], schema.names)


def sqlite_schema(path: str, table: str) -> T.StructType:
    """Columns by the affinity of their declared types; dates and everything else without one are text."""
    with contextlib.closing(sqlite_connection(path)) as c:
        found = c.execute(f"PRAGMA table_info({quoted(table)})").fetchall()
    if not found:
        raise ValueError(f"{path} has no table {table}")
    kind = lambda declared: next((t for part, t in AFFINITY if part in declared.upper()), T.DoubleType() if "NUM" in declared.upper() or "DEC" in declared.upper() else T.StringType())
    return T.StructType([T.StructField(name, kind(declared)) for _, name, declared, *_ in found])


def sqlite_tables(path: str) -> list[str]:
    """Tables of the file, internal ones left out."""
    with contextlib.closing(sqlite_connection(path)) as c:
        return [r[0] for r in c.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]


def sqlite_keys(path: str, table: str) -> list[str]:
    with contextlib.closing(sqlite_connection(path)) as c:
        return [r[1] for r in sorted(c.execute(f"PRAGMA table_info({quoted(table)})").fetchall(), key=lambda r: r[5]) if r[5]]


def read(spark: SparkSession, kind: str, path: str, table: str) -> DataFrame:
    """A table of a `sqlite` or `duckdb` file."""
    importable(spark)
    spark.dataSource.register({"sqlite": SqliteSource, "duckdb": DuckSource}[kind])
    return spark.read.format(kind).options(path=path, dbtable=table).load()


@contextlib.contextmanager
def transaction(path: str) -> Iterator[sqlite3.Connection]:
    """A connection whose statements all hold, or none where the body raises."""
    with contextlib.closing(sqlite_connection(path, read_only=False)) as c:
        c.execute("BEGIN IMMEDIATE")
        try:
            yield c
        except BaseException:
            c.execute("ROLLBACK")
            raise
        c.execute("COMMIT")


def write_sqlite(df: DataFrame, path: str, table: str, primary_key: Sequence[str] = (), indexes: Sequence[Sequence[str]] = ()) -> int:
    """Replace a table of a SQLite file with the rows of df, with key and indexes; rows pass through the driver a partition at a time."""
    kinds = {f.name: DECLARED.get(f.dataType.simpleString(), "NUMERIC" if isinstance(f.dataType, T.DecimalType) else "TEXT") for f in df.schema}
    key = f", PRIMARY KEY ({', '.join(map(quoted, primary_key))})" if primary_key else ""
    plain = [c if t in ("bigint", "int", "smallint", "tinyint", "double", "float", "boolean") else f"CAST(`{c}` AS STRING) AS `{c}`" for c, t in df.dtypes]
    n = 0
    with transaction(path) as c:
        c.execute(f"DROP TABLE IF EXISTS {quoted(table)}")
        c.execute(f"CREATE TABLE {quoted(table)} ({', '.join(f'{quoted(x)} {t}' for x, t in kinds.items())}{key})")
        marks, held = ", ".join("?" * len(kinds)), []
        for row in df.selectExpr(*[p if " AS " in p else f"`{p}`" for p in plain]).toLocalIterator():
            held.append(tuple(row))
            n += 1
            if len(held) == BATCH:
                c.executemany(f"INSERT INTO {quoted(table)} VALUES ({marks})", held)
                held = []
        c.executemany(f"INSERT INTO {quoted(table)} VALUES ({marks})", held)
        for columns in indexes:
            c.execute(f"CREATE INDEX IF NOT EXISTS {quoted('_'.join(('idx', table, *columns)))} ON {quoted(table)} ({', '.join(map(quoted, columns))})")
    return n
