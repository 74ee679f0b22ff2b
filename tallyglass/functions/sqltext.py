"""Measures of SQL text as columns: clauses, signature, complexity, lengths, similarity, references, cleaning."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What makes a clause present in a text whose literals are ''. Every pattern is one that both engines read alike.
CLAUSES = {
    "distinct": r"\bdistinct\b", "aggregate": r"\b(count|sum|avg|min|max|total|group_concat)\s*\(", "join": r"\bjoin\b|,\s*\w+\s+on\b", "where": r"\bwhere\b",
    "group_by": r"\bgroup\s+by\b", "having": r"\bhaving\b", "order_by": r"\border\s+by\b", "limit": r"\blimit\b|\bfetch\s+(first|next)\b",
    "subquery": r"(?s)\bselect\b.*\bselect\b|\bexists\s*\(", "set_op": r"\b(union|intersect|except)\b", "cte": r"^\s*with\b",
    "case_when": r"(?s)\bcase\b.*\bwhen\b|\bwhen\b.*\bcase\b", "star": r"\bselect\s+(distinct\s+)?\*", "offset": r"\boffset\b", "string_literal": r"''",
    "numeric_literal": r"(^|[^\w.])\d+(\.\d+)?",
}
#: Words after a table's name that are no alias.
KEYWORDS = ("where", "on", "using", "join", "inner", "left", "right", "full", "cross", "natural", "group", "order", "having", "limit", "offset", "union", "intersect", "except", "set", "values", "select", "as")
#: Fixed value: most words of each length bin.
LENGTH_BINS = (15, 30, 55)


def stripped(sql: Column) -> Column:
    """Lower case, string literals as '', comments gone."""
    text = F.regexp_replace(F.regexp_replace(sql, r"--[^\n]*", " "), r"(?s)/\*.*?\*/", " ")
    return F.lower(F.regexp_replace(text, r"'(?:[^']|'')*'", "''"))


def normalised(sql: Column) -> Column:
    """For exact match: one line, lower case, no final semicolon."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.trim(sql), r";\s*$", ""), r"\s+", " ")))


def cleaned(raw: Column) -> Column:
    """The first statement of a model's raw text, without thinking, fences or talk before it."""
    text = F.regexp_replace(raw, r"(?is)<think>.*?</think>", "")
    fenced = F.regexp_extract(text, r"(?is)```(?:sql)?\s*(.*?)```", 1)
    text = F.when(fenced != "", fenced).otherwise(text)
    return F.trim(F.regexp_extract(text, r"(?is)\b((?:select|with)\b[^;]*)", 1))


def tokens(sql: Column) -> Column:
    return F.regexp_extract_all(F.lower(sql), F.lit(r"[a-z_][a-z0-9_]*|\d+(?:\.\d+)?|'[^']*'|<>|<=|>=|!=|[^\s\w]"), 0)


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """`of` a value that is made once, however often it is used."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def has(sql: Column, clause: str) -> Column:
    return stripped(sql).rlike(CLAUSES[clause])


def flags(sql: Column) -> Column:
    return once(stripped(sql), lambda s: F.struct(*[s.rlike(p).alias(c) for c, p in CLAUSES.items()]))


def signature(sql: Column) -> Column:
    """The clauses present, in order, joined by +."""
    return once(stripped(sql), lambda s: F.concat_ws("+", *[F.when(s.rlike(p), c) for c, p in CLAUSES.items()]))


def joins(sql: Column) -> Column:
    return F.regexp_count(stripped(sql), F.lit(r"\bjoin\b"))


def tier(sql: Column) -> Column:
    """Four tiers: nested, joined, aggregated, simple."""
    return F.when(has(sql, "subquery") | has(sql, "cte") | has(sql, "set_op"), "nested").when(has(sql, "join"), "joined").when(has(sql, "aggregate") | has(sql, "group_by"), "aggregated").otherwise("simple")


#: The nine families of queries, in the order they are tried; anything else is a plain projection.
FAMILIES = (
    ("set operation", (("set_op",),)), ("subquery / CTE", (("cte",), ("subquery",))), ("aggregation + grouping", (("aggregate", "group_by"),)),
    ("simple aggregation", (("aggregate",),)), ("join", (("join",),)), ("distinct projection", (("distinct",),)), ("ordering / top-k", (("order_by",), ("limit",))),
    ("filter", (("where",),)),
)


def family(sql: Column) -> Column:
    """The first family of which one group of clauses is there in full."""
    out = None
    for name, groups in FAMILIES:
        holds = reduce(or_, [reduce(and_, [has(sql, c) for c in group]) for group in groups])
        out = F.when(holds, name) if out is None else out.when(holds, name)
    return out.otherwise("plain projection")


def words(sql: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(sql), r"\s+"), lambda w: w != ""))


def length_bin(sql: Column) -> Column:
    n, out = words(sql), F.lit(f">{LENGTH_BINS[-1]}")
    for most in reversed(LENGTH_BINS):
        out = F.when(n <= most, f"<={most}").otherwise(out)
    return out


def effort(sql: Column) -> Column:
    """Words, and 5 for each join, 3 for each select, 2 for each where."""
    text = stripped(sql)
    return words(sql) + 5 * F.regexp_count(text, F.lit(r"\bjoin\b")) + 3 * F.regexp_count(text, F.lit(r"\bselect\b")) + 2 * F.regexp_count(text, F.lit(r"\bwhere\b"))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def counted(items: Column) -> Column:
    """Each item with how many like it stand before it in order, so that equal lists as bags are equal as sets."""
    number = lambda s: F.transform(s, lambda t, i: F.concat_ws(" ", t, (i - F.array_position(s, t)).cast("string")))
    return F.get(F.transform(F.array(F.array_sort(items)), number), F.lit(0))  # the sorted list is made once


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two token multisets."""
    bags = F.struct(counted(tokens(a)).alias("x"), counted(tokens(b)).alias("y"))
    shared = lambda x, y: F.when(F.size(x) + F.size(y) == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))
    return F.when(a == b, 1.0).otherwise(once(bags, lambda s: shared(s["x"], s["y"])))


def flags_jaccard(a: Column, b: Column) -> Column:
    """Clauses in both of two flags() over clauses in either; 1 where neither has any."""
    both = sum(((a[c] & b[c]).cast("int") for c in CLAUSES), F.lit(0))
    either = sum(((a[c] | b[c]).cast("int") for c in CLAUSES), F.lit(0))
    return F.when(either == 0, 1.0).otherwise(both / either)


def clause_jaccard(a: Column, b: Column) -> Column:
    """flags_jaccard() of two texts."""
    return flags_jaccard(flags(a), flags(b))


def references(sql: Column, names: list[str]) -> Column:
    """Those of `names` (lower case) that the text uses, sorted."""
    return F.sort_array(F.array_intersect(F.array_distinct(tokens(stripped(sql))), F.array(*map(F.lit, names))))


def aliases(sql: Column, tables: list[str]) -> Column:
    """alias -> table of the text's FROM and JOIN items, for those of `tables` (lower case) that have an alias."""
    item = r"\b(?:from|join|into|update)\s+[`\"\[]?(\w{1,64})[`\"\]]?(?:\s+(?:as\s+)?[`\"\[]?(\w{1,64}))?"
    named = F.arrays_zip(F.regexp_extract_all(stripped(sql), F.lit(item), 2).alias("alias"), F.regexp_extract_all(stripped(sql), F.lit(item), 1).alias("table"))
    keyword = F.array(*map(F.lit, KEYWORDS))
    real = F.filter(named, lambda x: (x["alias"] != "") & ~F.array_contains(keyword, x["alias"]) & (x["alias"] != x["table"]) & F.array_contains(F.array(*map(F.lit, tables)), x["table"]))
    last = F.filter(real, lambda x, i: ~F.exists(F.slice(real, i + 2, F.size(real)), lambda y: y["alias"] == x["alias"]))
    return F.map_from_entries(last)


def used(sql: Column, schema: Mapping[str, Sequence[str]]) -> Column:
    """tables, columns of a schema (lower-case names) that the text uses, sorted; an alias counts as its table."""
    tables, columns = sorted(schema), sorted({c for cs in schema.values() for c in cs})
    by_alias = F.map_values(aliases(sql, tables))
    named = F.sort_array(F.array_distinct(F.concat(references(sql, tables), by_alias)))
    return F.struct(named.alias("tables"), references(sql, columns).alias("columns"))


def link_counts(pred: Column, gold: Column) -> Column:
    """tp, fp, fn over the tables and columns of two used()."""
    both = [(pred[k], gold[k]) for k in ("tables", "columns")]
    tp = sum((F.size(F.array_intersect(p, g)) for p, g in both), F.lit(0))
    fp = sum((F.size(F.array_except(p, g)) for p, g in both), F.lit(0))
    fn = sum((F.size(F.array_except(g, p)) for p, g in both), F.lit(0))
    return F.struct(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))


def link_rates(counts: Column) -> Column:
    """precision, recall, f1 of link_counts(), 0 where there is nothing to divide by."""
    part = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = part(counts["tp"], counts["tp"] + counts["fp"]), part(counts["tp"], counts["tp"] + counts["fn"])
    return F.struct(p.alias("precision"), r.alias("recall"), part(2.0 * counts["tp"], 2 * counts["tp"] + counts["fp"] + counts["fn"]).alias("f1"))


def link_f1(pred: Column, gold: Column) -> Column:
    """F1 of two sets of names."""
    f1 = lambda p, g: F.when(F.size(p) + F.size(g) == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(p, g)) / (F.size(p) + F.size(g)))
    return once(F.struct(pred.alias("p"), gold.alias("g")), lambda s: f1(s["p"], s["g"]))


def balanced(sql: Column) -> Column:
    """Whether parentheses close in order and quotes are paired, outside each other."""
    bare = F.regexp_replace(F.regexp_replace(sql, r"'(?:[^']|'')*'", ""), r'"[^"]*"', "")
    depth = F.aggregate(
        F.filter(F.split(bare, ""), lambda c: c.isin("(", ")")),
        F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")),
        lambda s, c: F.struct((s["d"] + F.when(c == "(", 1).otherwise(-1)).alias("d"), F.least(s["low"], s["d"] + F.when(c == "(", 1).otherwise(-1)).alias("low")),
        lambda s: (s["d"] == 0) & (s["low"] == 0),
    )
    return depth & ~bare.contains("'") & ~bare.contains('"')


CREATE = re.compile(r"create\s+(table|view)\s+(?:if\s+not\s+exists\s+)?[\"`\[]?([A-Za-z_]\w*)[\"`\]]?\s*(?:\((.*)\))?", re.I | re.S)


def split_top(text: str, at: str = ",") -> list[str]:
    """Parts between separators outside parentheses and quotes."""
    parts, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == at and not depth:
            parts.append(text[start:i].strip())
            start = i + 1
    return [p for p in [*parts, text[start:].strip()] if p]


def parse_ddl(text: str) -> dict[str, list[str]]:
    """Tables and views of DDL text with their column names; constraints are no columns."""
    found = {}
    for statement in split_top(text, ";"):
        if m := CREATE.match(statement):
            columns = [p.split()[0].strip('"`[]') for p in split_top(m[3] or "") if p.split()]
            found[m[2]] = [c for c in columns if c.lower() not in ("primary", "foreign", "unique", "check", "constraint", "key")]
    return found
