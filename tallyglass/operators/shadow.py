"""The clamped shadow: the database as it stood before a cutoff, and what depends on the time after it.

The holdout table keeps its rows before the cutoff; a table with a foreign key to it keeps the children of those rows;
all others pass through. Rows with a null date or reference are not kept. Nothing is copied: the shadow is a set of
lazy views in a session of its own, and Catalyst pushes the cutoff into the scans.

Whether an answer depends on the time after the cutoff is read from its lineage where that says it: a query whose analysed plan
names no clamped table is independent. The others are digested on both databases, many queries to a job and some jobs at once.
A query that reads children without the holdout table reads them without the few keys that are gone (`without_gone`), so that
its rows stay where they are; one that reads both shuffles them by the key anyway, once for both databases.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.functions.canon import bag_digest
from tallyglass.operators.guard import nodes
from tallyglass.session import kept
from tallyglass.sources.catalog import ForeignKey

#: Keys that are broadcast at most (a dozen bytes or more each in a hash table); more meet the rows in a shuffle.
FEW_KEYS = 5_000_000


def clamp(tables: Mapping[str, DataFrame], table: str, column: str, cutoff: str, keys: Iterable[ForeignKey]) -> dict[str, DataFrame]:
    before = F.col(column) < F.to_timestamp_ntz(F.lit(cutoff), F.lit("yyyy-MM-dd"))
    shadow = dict(tables) | {table: tables[table].where(before)}
    for f in sorted(keys):
        if f.ref_table == table and f.table in tables and f.table != table:
            parent = shadow[table].select(F.col(f.ref_column).alias("__key"))
            shadow[f.table] = tables[f.table].join(parent, F.col(f.column) == F.col("__key"), "left_semi")
    return shadow


def without_gone(tables: Mapping[str, DataFrame], shadow: Mapping[str, DataFrame], table: str, keys: Iterable[ForeignKey]) -> dict[str, DataFrame]:
    """The same shadow, whose children are all rows but those of keys that have no parent in it.

    Only keys are shuffled to find what is gone; it is written once, and broadcast to the children.
    """
    out = dict(shadow)
    for f in sorted(keys):
        if f.ref_table == table and f.table in tables and f.table != table:
            child, key = tables[f.table].where(F.col(f.column).isNotNull()), F.col(f.column)
            parent = shadow[table].select(F.col(f.ref_column).alias("__key"))
            gone = kept(child.select(key.alias("__key")).join(parent, "__key", "left_anti").distinct(), "gone")
            hint = "broadcast" if gone.count() <= FEW_KEYS else "shuffle_hash"
            out[f.table] = child.join(gone.hint(hint), key == F.col("__key"), "left_anti")
    return out


def session_of(spark: SparkSession, tables: Mapping[str, DataFrame]) -> SparkSession:
    """A session whose temp views are these tables; the caller's own views are untouched."""
    own = spark.newSession()
    for name, df in tables.items():
        view(own, name, df)
    return own


def view(session: SparkSession, name: str, df: DataFrame) -> None:
    """Register a plan of another session as a temp view of this one."""
    plan = df._jdf.queryExecution().logical()
    dataset = session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, plan)
    dataset.createOrReplaceTempView(name)


#: Digests that are computed by one job, each a row of its result, and jobs at once.
BATCH, AT_ONCE = 12, 4


def lineage(df: DataFrame) -> set[str]:
    """Names of the views that a query reads, in subqueries and CTEs too."""
    return {str(n.desc().identifier().table()).lower() for n in nodes(df._jdf.queryExecution().analyzed()) if n.getClass().getSimpleName() == "View"}


def digests(spark: SparkSession, asked: Mapping[tuple[str, str], DataFrame]) -> dict[tuple[str, str], tuple[int, str]]:
    """(n_rows, digest) of each query, BATCH to a job; the queries may be of several sessions.

    In the order given; both digests of a query are in a job, where they share what they shuffle alike, and those without gone
    keys are in jobs of their own, where they share these.
    """
    batches: list[list[tuple[str, str]]] = []
    for own in (False, True):
        batches.append([])
        for k in (k for k in asked if (k[1] == "without") == own):
            if len(batches[-1]) >= BATCH and k[0] != batches[-1][-1][0]:
                batches.append([])
            batches[-1].append(k)
    batches = [b for b in batches if b]

    def batch(names: list[tuple[str, str]]) -> dict[tuple[str, str], tuple[int, str]]:
        part = []
        for k, name in enumerate(names):
            plan = bag_digest(asked[name])._jdf.queryExecution().analyzed()
            own = DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)
            part.append(own.select(F.lit(k).alias("k"), "n_rows", "digest"))
        return {names[r.k]: (r.n_rows, r.digest) for r in reduce(DataFrame.union, part).collect()}

    with ThreadPoolExecutor(AT_ONCE) as pool:  # batches are planned side by side
        return {k: v for found in pool.map(batch, batches) for k, v in found.items()}


def dependence(spark: SparkSession, full: SparkSession, clamped: SparkSession, gold: Mapping[str, str], changed: Iterable[str] | None = None, without: tuple[SparkSession, str] | None = None) -> DataFrame:
    """question_id, n_full, n_clamped, dependent, split: whether the answer changes with the time after the cutoff.

    `changed` names the tables that differ between the sessions; all may, where it is not given. `without` is a session of
    without_gone() and the holdout table; queries that do not read that table are asked there.
    """
    differ = None if changed is None else {t.lower() for t in changed}
    asked, of = {}, {}
    queries = {name: full.sql(text) for name, text in gold.items()}
    reads = {name: lineage(df) for name, df in queries.items()}
    for name in sorted(gold, key=lambda x: (sorted(reads[x], reverse=True), x)):  # queries of the same tables side by side
        read, text = reads[name], gold[name]
        asked[name, "full"] = queries[name]
        if differ is None or read & differ:
            of[name] = "without" if without and without[1].lower() not in read else "clamped"
            asked[name, of[name]] = (without[0] if of[name] == "without" else clamped).sql(text)
    found = digests(spark, asked)
    rows = []
    for name in sorted(gold):
        a = found[name, "full"]
        b = found[name, of[name]] if name in of else a
        rows.append((name, a[0], b[0], a != b, "heldout" if a != b else "train_ok"))
    return spark.createDataFrame(rows, "question_id string, n_full long, n_clamped long, dependent boolean, split string")


def leaks(tagged: DataFrame, dependent: DataFrame) -> DataFrame:
    """Questions tagged train_ok whose answer depends on the holdout, or that could not be answered."""
    joined = tagged.join(dependent.select("question_id", "dependent"), "question_id", "left")
    return joined.where((F.col("split") == "train_ok") & F.coalesce("dependent", F.lit(True))).select("question_id")
