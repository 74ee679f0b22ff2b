"""Drafting questions: every shape a schema admits is laid out as Spark SQL, then drawn in a seeded order.

A shape is a function from the schema's facts to its candidates. Nothing is drawn at random: candidates are ordered by
a hash of seed and text, so a seed gives the same questions anywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.operators import guard, profile
from tallyglass.operators.corpus import draw
from tallyglass.sources.catalog import Catalog

KEYWORDS = ("broken", "late", "good", "never arrived")


@dataclass(frozen=True)
class Candidate:
    question: str
    sql: str
    category: str
    difficulty: str


@dataclass(frozen=True)
class Facts:
    """What a schema offers to ask about: columns by role, sampled keys, months and values."""

    catalog: Catalog
    numeric: dict[str, list[str]] = field(default_factory=dict)
    dates: dict[str, list[str]] = field(default_factory=dict)
    texts: dict[str, list[str]] = field(default_factory=dict)
    categories: dict[str, list[str]] = field(default_factory=dict)
    keys: dict[str, list[tuple]] = field(default_factory=dict)
    months: dict[tuple[str, str], list[str]] = field(default_factory=dict)


def discover(tables: Mapping[str, DataFrame], catalog: Catalog, most: int = 60, samples: int = 3, seed: int = 1) -> Facts:
    """Facts by one aggregate a table for cardinalities, one seeded top-k for keys, one distinct a date column for months."""
    roles = {t: profile.roles(tables[t]) for t in catalog.names() if t in tables}
    by = lambda role: {t: found for t, cs in roles.items() if (found := [c for c, r in cs.items() if r == role])}
    facts = Facts(catalog, by("numeric"), by("date"), by("text"))
    for r in profile.categoricals({t: tables[t] for t in roles}, most).orderBy("table_name", "column_name").collect():
        facts.categories.setdefault(r.table_name, []).append(r.column_name)
    for t in roles:
        if key := catalog.tables[t].primary_key:
            picked = tables[t].select(*key).orderBy(draw(*key, seed=seed), *key).limit(samples)
            facts.keys[t] = [tuple(r) for r in picked.collect()]
        for c in facts.dates.get(t, []):
            found = tables[t].where(F.col(c).isNotNull()).select(F.date_format(c, "yyyy-MM").alias("m")).distinct().orderBy("m")
            facts.months[t, c] = [r.m for r in found.collect()]
    return facts


def named(identifier: str) -> str:
    return identifier.replace("_", " ")


def q(identifier: str) -> str:
    return f"`{identifier}`"


def literal(value: object) -> str:
    return str(value) if isinstance(value, int | float) else "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def bare_keyword(word: str) -> str:
    """Without the characters that mean something inside a pattern or literal."""
    return str(word).translate({ord(c): None for c in "'%_\\"})


def lookups(facts: Facts) -> Iterator[Candidate]:
    for t, keys in facts.keys.items():
        key = facts.catalog.tables[t].primary_key
        if len(key) == 1:
            for column, _, _ in facts.catalog.tables[t].columns:
                for (value,) in keys if column != key[0] else ():
                    yield Candidate(f"What is the {named(column)} of {named(t)} {value}?", f"SELECT {q(column)} FROM {q(t)} WHERE {q(key[0])} = {literal(value)}", "per_order_lookup", "easy")


def aggregates(facts: Facts) -> Iterator[Candidate]:
    for t, columns in facts.categories.items():
        for c in columns:
            yield Candidate(f"Number of {named(t)} records by {named(c)}.", f"SELECT {q(c)}, COUNT(*) AS n FROM {q(t)} GROUP BY {q(c)} ORDER BY n DESC, {q(c)}", "aggregation", "medium")
            for m in facts.numeric.get(t, []):
                for f in ("SUM", "AVG"):
                    label = f"{f.lower()}_{m}"
                    yield Candidate(f"{f} of {named(m)} by {named(c)}.", f"SELECT {q(c)}, {f}({q(m)}) AS {label} FROM {q(t)} GROUP BY {q(c)} ORDER BY {label} DESC", "aggregation", "medium")
                yield Candidate(
                    f"By {named(c)}: groups with over 1000 records, with total {named(m)}.",
                    f"SELECT {q(c)}, COUNT(*) AS n, SUM({q(m)}) AS total_{m} FROM {q(t)} GROUP BY {q(c)} HAVING COUNT(*) > 1000 ORDER BY total_{m} DESC",
                    "aggregation", "hard",
                )
            for d in facts.dates.get(t, []):
                for month in facts.months[t, d]:
                    where = f"{q(d)} >= TIMESTAMP '{month}-01' AND {q(d)} < add_months(DATE '{month}-01', 1)"
                    for m in facts.numeric.get(t, [])[:2]:
                        yield Candidate(f"Total {named(m)} by {named(c)} in {month}.", f"SELECT {q(c)}, SUM({q(m)}) AS total_{m} FROM {q(t)} WHERE {where} GROUP BY {q(c)} ORDER BY total_{m} DESC", "aggregation", "medium")


def star_joins(facts: Facts) -> Iterator[Candidate]:
    for t in facts.catalog.names():
        keys = [f for f in facts.catalog.foreign_keys if f.table == t]
        for a, b in combinations(keys, 2):
            for g in facts.categories.get(a.ref_table, [a.ref_column]):
                for h in facts.categories.get(b.ref_table, [b.ref_column]):
                    if (g, a.ref_table) == (h, b.ref_table):
                        continue
                    for m in facts.numeric.get(t) or [None]:
                        value, label = (f"SUM(f.{q(m)})", f"total_{m}") if m else ("COUNT(*)", "n")
                        yield Candidate(
                            f"{'Total ' + named(m) if m else 'Records'} in {named(t)} by {named(g)} and {named(h)}.",
                            f"SELECT a.{q(g)} AS {q(g)}, b.{q(h)} AS {q(h + '_2' if g == h else h)}, {value} AS {label} FROM {q(t)} f JOIN {q(a.ref_table)} a ON f.{q(a.column)} = a.{q(a.ref_column)} "
                            f"JOIN {q(b.ref_table)} b ON f.{q(b.column)} = b.{q(b.ref_column)} GROUP BY a.{q(g)}, b.{q(h)} ORDER BY {label} DESC",
                            "multi_table_join", "hard",
                        )


def nested(facts: Facts) -> Iterator[Candidate]:
    """For flat tables: groups above the mean of groups, and the largest combinations."""
    for t, columns in facts.categories.items():
        for m in facts.numeric.get(t, []):
            for c in columns:
                inner = f"SELECT SUM({q(m)}) AS total FROM {q(t)} GROUP BY {q(c)}"
                yield Candidate(
                    f"Which {named(c)} have total {named(m)} above the average group?",
                    f"SELECT {q(c)}, SUM({q(m)}) AS total_{m} FROM {q(t)} GROUP BY {q(c)} HAVING SUM({q(m)}) > (SELECT AVG(total) FROM ({inner}) g) ORDER BY total_{m} DESC",
                    "multi_table_join", "hard",
                )
            for c, d in combinations(columns, 2):
                yield Candidate(
                    f"Top 20 {named(c)} and {named(d)} by total {named(m)}.",
                    f"SELECT {q(c)}, {q(d)}, SUM({q(m)}) AS total_{m} FROM {q(t)} GROUP BY {q(c)}, {q(d)} ORDER BY total_{m} DESC, {q(c)}, {q(d)} LIMIT 20",
                    "multi_table_join", "hard",
                )


def mentions(facts: Facts, keywords: Iterable[str] = KEYWORDS) -> Iterator[Candidate]:
    for t, columns in facts.texts.items():
        parents = [f for f in facts.catalog.foreign_keys if f.table == t]
        for column in columns:
            for word in map(bare_keyword, keywords):
                ask = f"Count of {named(t)} records whose {named(column)} mentions '{word}', by "
                for f in parents:
                    c = (facts.categories.get(f.ref_table) or [f.ref_column])[0]
                    yield Candidate(ask + f"{named(c)}.", f"SELECT d.{q(c)}, COUNT(*) AS n FROM {q(t)} r JOIN {q(f.ref_table)} d ON r.{q(f.column)} = d.{q(f.ref_column)} WHERE r.{q(column)} ILIKE '%{word}%' GROUP BY d.{q(c)} ORDER BY n DESC, d.{q(c)}", "review_text", "hard")
                for c in facts.categories.get(t, []) if not parents else ():
                    yield Candidate(ask + f"{named(c)}.", f"SELECT {q(c)}, COUNT(*) AS n FROM {q(t)} WHERE {q(column)} ILIKE '%{word}%' GROUP BY {q(c)} ORDER BY n DESC, {q(c)}", "review_text", "hard")


SHAPES: dict[str, tuple[Callable[[Facts], Iterator[Candidate]], ...]] = {
    "per_order_lookup": (lookups,),
    "aggregation": (aggregates,),
    "multi_table_join": (star_joins, nested),
    "review_text": (mentions,),
}


def drafted(spark: SparkSession, facts: Facts, n: int, seed: int = 1, categories: Iterable[str] | None = None, attempts: int = 50) -> list[Candidate]:
    """`n` candidates that run and return rows, the categories in turn; at most n * attempts are tried."""

    def ordered(category: str) -> Iterator[Candidate]:
        found = {c.sql: c for shape in SHAPES[category] for c in shape(facts)}
        yield from sorted(found.values(), key=lambda c: hashlib.md5(f"{seed}:{c.sql}".encode()).digest())

    queues = [ordered(c) for c in (categories or SHAPES)]
    out: list[Candidate] = []
    for _ in range(n * attempts):
        if len(out) >= n or not queues:
            break
        queue = queues.pop(0)
        if candidate := next(queue, None):
            queues.append(queue)
            if (found := guard.safe_execute(spark, candidate.sql)).success and found.rows:
                out.append(candidate)
    return out


#: Functions of the row store's dialect and what Spark has for them.
DIALECT = (
    (r"(?i)\bstrftime\(\s*'%Y-%m-%d'\s*,\s*([^()]+?)\)", r"date_format(\1, 'yyyy-MM-dd')"),
    (r"(?i)\bstrftime\(\s*'%Y-%m'\s*,\s*([^()]+?)\)", r"date_format(\1, 'yyyy-MM')"),
    (r"(?i)\bstrftime\(\s*'%Y'\s*,\s*([^()]+?)\)", r"date_format(\1, 'yyyy')"),
    (r"(?i)\bjulianday\(([^()]+)\)", r"(unix_micros(cast(\1 as timestamp)) / 86400e6 + 2440587.5)"),
    (r"(?i)\btotal\(([^()]+)\)", r"coalesce(sum(\1), 0.0)"),
    (r"(?i)\bgroup_concat\(([^(),]+)\)", r"listagg(cast(\1 as string), ',')"),
    (r"(?i)\bnot\s+like\b", "NOT ILIKE"),
    (r"(?i)(?<!not )\blike\b", "ILIKE"),
)


def to_spark(sql: str) -> str:
    """Gold SQL of the row store's dialect as Spark SQL; literals are left alone, double quotes name columns."""
    import re

    parts = re.split(r"('(?:[^']|'')*')", sql)
    held = [p for p in parts[1::2]]
    text = "".join(p if i % 2 == 0 else f"'\x00{i // 2}\x00'" for i, p in enumerate(parts))
    for k, lit in enumerate(held):  # formats are part of the patterns
        if lit in ("'%Y'", "'%Y-%m'", "'%Y-%m-%d'"):
            text = text.replace(f"'\x00{k}\x00'", lit)
    for pattern, new in DIALECT:
        text = re.sub(pattern, new, text)
    text = re.sub(r'"([^"]*)"', r"`\1`", text)
    return re.sub("'\x00(\\d+)\x00'", lambda m: held[int(m[1])].replace("''", "\\'") if len(held[int(m[1])]) > 2 else "''", text)
