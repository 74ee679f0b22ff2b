"""Profiling: date ranges, the mechanical holdout, categoricals, key reports, value index and grounding, schema linking."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.sources.catalog import Catalog, ForeignKey, canonical_type

DATE_KINDS = ("DATE", "TIMESTAMP")
NUMERIC_KINDS = ("REAL", "NUMERIC")


class NoDates(ValueError):
    """The holdout column has no date to count back from."""


def roles(df: DataFrame) -> dict[str, str]:
    """date, numeric or text of each column; integers are text: they are codes as often as amounts."""
    kinds = {f.name: canonical_type(f.dataType) for f in df.schema}
    return {c: "date" if k in DATE_KINDS else "numeric" if k in NUMERIC_KINDS else "text" for c, k in kinds.items()}


def date_ranges(tables: Mapping[str, DataFrame]) -> DataFrame:
    """table_name, column_name, first, last (as ISO days) of every date column; one aggregate a table."""
    found = []
    for name, df in sorted(tables.items()):
        dates = [c for c, role in roles(df).items() if role == "date"]
        if dates:
            one = df.agg(*[f(c).alias(f"{k}_{c}") for c in dates for k, f in (("lo", F.min), ("hi", F.max))])
            day = lambda c: F.date_format(c, "yyyy-MM-dd")
            rows = F.array(*[F.struct(F.lit(c).alias("column_name"), day(f"lo_{c}").alias("first"), day(f"hi_{c}").alias("last")) for c in dates])
            found.append(one.select(F.lit(name).alias("table_name"), F.inline(rows)))
    return reduce(DataFrame.unionByName, found)


def holdout(df: DataFrame, column: str, months: int) -> DataFrame:
    """max_date, cutoff (ISO days): the cutoff is the first day of the month `months` before the last date's month."""
    last = df.agg(F.max(F.col(column)).alias("m"))
    return last.select(
        F.date_format("m", "yyyy-MM-dd").alias("max_date"),
        F.date_format(F.add_months(F.trunc("m", "MM"), -months), "yyyy-MM-dd").alias("cutoff"),
    )


def cutoff(df: DataFrame, column: str, months: int) -> str:
    found = holdout(df, column, months).first()["cutoff"]
    if found is None:
        raise NoDates(f"{column} has no dates")
    return found


def distinct_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """table_name, column_name, n_distinct of every string column."""
    found = []
    for name, df in sorted(tables.items()):
        texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
        if texts:
            one = df.agg(*[F.count_distinct(c).alias(c) for c in texts])
            rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_distinct")) for c in texts])
            found.append(one.select(F.lit(name).alias("table_name"), F.inline(rows)))
    return reduce(DataFrame.unionByName, found)


def few_valued(tables: Mapping[str, DataFrame], most: int) -> dict[str, DataFrame]:
    """The tables with those string columns only whose approximate number of distinct values is not far beyond `most`.

    One map-side sketch a column decides, so long texts and names never go through an exact count; the sketch's error is 5 %
    (standard), and a column is left out only from twice `most` on.
    """
    out = {}
    for name, df in sorted(tables.items()):
        texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
        if texts:
            row = df.agg(*[F.approx_count_distinct(c).alias(c) for c in texts]).first()
            if kept := [c for c in texts if row[c] <= 2 * most]:
                out[name] = df.select(*kept)
    return out


def categoricals(tables: Mapping[str, DataFrame], most: int = 60) -> DataFrame:
    """The string columns with 2 to `most` distinct values: counted exactly where a sketch does not rule them out."""
    return distinct_counts(few_valued(tables, most)).where(F.col("n_distinct").between(2, most))


def value_sample(df: DataFrame, column: str, n: int = 25, seed: int = 1) -> DataFrame:
    """value: `n` distinct non-empty values of a column, the first in a seeded order."""
    values = df.select(F.col(column).cast("string").alias("value")).where(F.trim("value") != "").distinct()
    return values.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "value")), "value").limit(n)


def preview(df: DataFrame, n: int = 3) -> DataFrame:
    """The first `n` rows by all columns, as text."""
    shown = [c for c, t in df.dtypes if not t.startswith(("map",))]
    return df.select(*[F.col(c).cast("string").alias(c) for c in shown]).orderBy(*shown).limit(n)


def key_duplicates(tables: Mapping[str, DataFrame], catalog: Catalog) -> DataFrame:
    """table_name, n_rows, n_keys, is_unique for each table with a primary key."""
    found = []
    for name in catalog.names():
        if key := catalog.tables[name].primary_key:
            one = tables[name].groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"))
            found.append(one.select(F.lit(name).alias("table_name"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "n_keys", (F.coalesce("n_rows", F.lit(0)) == F.col("n_keys")).alias("is_unique")))
    return reduce(DataFrame.unionByName, found)


def orphans(tables: Mapping[str, DataFrame], keys: Iterable[ForeignKey]) -> DataFrame:
    """fk, n_orphans: rows whose non-null reference meets no key."""
    found = []
    for f in sorted(keys):
        # References are folded to counts before the join, so a hot key is one row a task.
        child = tables[f.table].select(F.col(f.column).cast("string").alias("k")).where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        parent = tables[f.ref_table].select(F.col(f.ref_column).cast("string").alias("k"))
        name = f"{f.table}.{f.column}->{f.ref_table}.{f.ref_column}"
        found.append(child.join(parent, "k", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_orphans")).select(F.lit(name).alias("fk"), "n_orphans"))
    return reduce(DataFrame.unionByName, found)


# ---- value index and grounding --------------------------------------------------------------------------------------


def value_index(tables: Mapping[str, DataFrame], most_distinct: int = 50, longest: int = 60) -> DataFrame:
    """key (lower case), table_name, column_name, value of the short values of low-cardinality string columns.

    The columns come from one aggregate a table; each table is then read once for its values.
    """
    wanted: dict[str, list[str]] = {}
    for r in distinct_counts(few_valued(tables, most_distinct)).where(F.col("n_distinct").between(1, most_distinct)).collect():
        wanted.setdefault(r.table_name, []).append(r.column_name)
    found = []
    for name, columns in sorted(wanted.items()):
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in columns])).alias("p")
        values = tables[name].select(pairs).select("p.*").where(F.length("value").between(1, longest)).distinct()
        found.append(values.select(F.lower("value").alias("key"), F.lit(name).alias("table_name"), "column_name", "value"))
    return reduce(DataFrame.unionByName, found)


def ngrams(text: F.Column, longest: int = 4) -> F.Column:
    """(n-gram, words in it, first word) of a question, longest first."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_'-]+"), 0)
    return F.flatten(
        F.transform(
            F.sequence(F.lit(longest), F.lit(1), F.lit(-1)),
            lambda n: F.transform(
                F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>")),
                lambda i: F.struct(F.array_join(F.slice(words, i, n), " ").alias("gram"), n.alias("words"), i.alias("at")),
            ),
        )
    )


def ground_values(questions: DataFrame, index: DataFrame, hints: int = 6) -> DataFrame:
    """question_id, table_name, column_name, value, words, confidence: exact n-gram matches, longest first, at most `hints` a question.

    Confidence is 1 for a match of several words, 0.85 for one word.
    """
    from pyspark.sql import Window

    grams = questions.select("question_id", F.explode(ngrams(F.col("question"))).alias("g")).select("question_id", "g.*")
    hit = grams.join(index, grams["gram"] == index["key"]).groupBy("question_id", "table_name", "column_name", "value").agg(F.max("words").alias("words"), F.min("at").alias("at"))
    order = Window.partitionBy("question_id").orderBy(F.desc("words"), "at", "table_name", "column_name", "value")
    ranked = hit.withColumn("r", F.row_number().over(order)).where(F.col("r") <= hints)
    return ranked.select("question_id", "table_name", "column_name", "value", "words", F.when(F.col("words") > 1, 1.0).otherwise(0.85).alias("confidence"))


# ---- schema linking -------------------------------------------------------------------------------------------------


def name_tokens(name: str) -> set[str]:
    """Lower-case words of an identifier or text, and each longer one without a plural s."""
    words = {w for w in "".join(c if c.isalnum() else " " for c in name.lower()).split()}
    return words | {w[:-1] for w in words if len(w) > 3 and w.endswith("s")}


def link_scores(catalog: Catalog, question: str, descriptions: Mapping[str, str] | None = None) -> dict[str, float]:
    """Tables by relevance: 5 for a word of the name, 1.5 for each column with a word, 4 for a word of the description."""
    asked, told = name_tokens(question), descriptions or {}
    return {
        t: 5.0 * bool(name_tokens(t) & asked)
        + 1.5 * sum(bool(name_tokens(c) & asked) for c, _, _ in catalog.tables[t].columns)
        + 4.0 * bool(name_tokens(told.get(t, "")) & asked)
        for t in catalog.names()
    }


def prune_schema(catalog: Catalog, question: str, most: int = 8) -> list[str]:
    """All tables if they are few; else the best-scored, with the tables that join them, up to `most`."""
    if len(catalog.names()) <= most:
        return catalog.names()
    scores = link_scores(catalog, question)
    best = sorted(catalog.names(), key=lambda t: (-scores[t], t))
    kept = [t for t in best if scores[t] > 0][:most] or best[:2]
    for i, a in enumerate(tuple(kept)):
        for b in tuple(kept)[i + 1 :]:
            kept += [t for t in catalog.path(a, b) if t not in kept and len(kept) < most]
    return sorted(kept)
