"""Conversations and stored experience: turns, follow-ups, what a question recalls, merged exemplars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyglass.operators.retrieval import exemplars

#: Words that point back at an earlier turn.
ANAPHORA = r"\b(it|its|they|them|their|those|these|that|this|same|previous|above|again|also|instead)\b"
FOLLOW_UP = r"^(and|but|what about|how about|now|then|only|just)\b"


def follow_up(text: Column) -> Column:
    """Whether a question leans on the turn before: it opens as a follow-up, points back, or has four words at most."""
    plain = F.lower(F.trim(text))
    return plain.rlike(FOLLOW_UP) | plain.rlike(ANAPHORA) | (F.size(F.filter(F.split(plain, r"\s+"), lambda w: w != "")) <= 4)


def numbered(turns: DataFrame, session: str, order: str) -> DataFrame:
    """Turns with turn_index from 0 in each session."""
    return turns.withColumn("turn_index", F.row_number().over(Window.partitionBy(session).orderBy(order)) - 1)


def latest(turns: DataFrame, session: str, order: str) -> DataFrame:
    """The last turn of each session, as an aggregate that combines before the shuffle."""
    return turns.groupBy(session).agg(F.max_by(F.struct(*turns.columns), order).alias("t")).select("t.*")


def context(turns: DataFrame, session: str, order: str, k: int) -> DataFrame:
    """The last k turns of each session."""
    at = Window.partitionBy(session).orderBy(F.desc(order))
    return turns.withColumn("back", F.row_number().over(at)).where(F.col("back") <= k)


def recall(questions: DataFrame, turns: DataFrame, store: DataFrame, k: int = 2) -> DataFrame:
    """query_id, source, ref: the session's last turn for a follow-up, and the best exemplars for any question.

    questions: query_id, session, query. turns: session, turn, text. store: doc_id, text.
    """
    last = latest(turns, "session", "turn").select("session", F.col("turn").cast("string").alias("ref"))
    asked = questions.where(follow_up(F.col("query"))).join(last, "session").select("query_id", F.lit("turn").alias("source"), "ref")
    best = exemplars(questions.drop("session"), store, k).select("query_id", F.lit("exemplar").alias("source"), F.col("doc_id").cast("string").alias("ref"))
    return asked.unionByName(best)


def merged(stored: DataFrame, added: DataFrame) -> DataFrame:
    """Experience by (db, question): frequencies add up, the newest SQL stays.

    Both have db, question, sql, frequency, at.
    """
    return stored.unionByName(added).groupBy("db", "question").agg(F.max_by("sql", F.struct("at", "sql")).alias("sql"), F.sum("frequency").alias("frequency"), F.max("at").alias("at"))


def memory_stats(turns: DataFrame, session: str = "conv_id") -> DataFrame:
    """n_turns, n_sessions, longest."""
    per = turns.groupBy(session).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("n_turns"), F.count(F.lit(1)).alias("n_sessions"), F.max("n").alias("longest"))


def store_stats(turns: DataFrame, session: str = "session") -> DataFrame:
    """db, n_turns, n_sessions, n_repaired of each database, and of all (db null), from (session, db, repaired)."""
    repaired = F.count_if(F.coalesce("repaired", F.lit(False)))
    return turns.rollup("db").agg(F.count(F.lit(1)).alias("n_turns"), F.count_distinct(session).alias("n_sessions"), repaired.alias("n_repaired"))


#: A turn as it is stored, and an exemplar.
TURN = "session string, turn_index int, db string, question string, sql string, answer string, repaired boolean, latency_ms double, at timestamp_ntz"
EXPERIENCE = "db string, question string, sql string, frequency long, at timestamp_ntz"


def init_store(spark: SparkSession, path: str) -> None:
    """An empty store of turns and exemplars; a table that is there stays."""
    for name, schema in (("turns", TURN), ("experience", EXPERIENCE)):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/{name}")


def cleared(turns: DataFrame, session: str | None = None) -> tuple[DataFrame, int]:
    """The turns without those of one session, or of all, and how many went; the caller writes them back with files.replaced()."""
    gone = turns if session is None else turns.where(F.col("session") == session)
    return (turns.limit(0) if session is None else turns.where(~F.col("session").eqNullSafe(F.lit(session)))), gone.count()


def export_experience(store: DataFrame, path: str) -> None:
    """Exemplars as JSON lines."""
    store.select("db", "question", "sql", "frequency", "at").write.mode("overwrite").json(path)


def import_experience(store: DataFrame, path: str) -> DataFrame:
    """The store with the exemplars of a JSON-lines export merged in; lines without a question or SQL are left out."""
    added = store.sparkSession.read.schema(EXPERIENCE).json(path).where("question IS NOT NULL AND sql IS NOT NULL")
    return merged(store, added.withColumn("frequency", F.coalesce("frequency", F.lit(1))))


def entities(rows: DataFrame, columns: list[str], first: int = 3, most: int = 10) -> DataFrame:
    """entity: strings of 2 to 40 characters of the first rows of an answer, in order, at most `most`."""
    cells = rows.limit(first).select(F.posexplode(F.array(*[F.col(c).cast("string") for c in columns])).alias("at", "entity"))
    return cells.where(F.length("entity").between(2, 40)).groupBy("entity").agg(F.min("at").alias("at")).orderBy("at", "entity").limit(most).select("entity")


def tables_of(sql: Column) -> Column:
    """Names after FROM and JOIN, distinct and sorted."""
    return F.sort_array(F.array_distinct(F.transform(F.regexp_extract_all(sql, F.lit(r"(?i)\b(?:from|join)\s+([A-Za-z_]\w*)"), 1), F.lower)))
