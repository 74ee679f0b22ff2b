"""The read-only SQL surface: one SELECT-like statement over registered tables, capped in rows and time.

A text is judged twice and then run as the very plan that was judged. The parsed plan may hold allowed kinds of nodes, plain
names, and calls of the engine's own functions only; names that are computed (`IDENTIFIER`) and parameters are refused before
anything is resolved. The analysed plan may hold allowed nodes and expressions of allowed classes only, whatever name led to
them: those of the functions of allowed groups, and those that make up a query. What stands behind a registered table is its
owner's and is not judged. Texts are parsed without substituting variables, so `${...}` is just text.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cache

from pyspark import InheritableThread
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.functions.canon import MAX_ROWS, bounded_rows

TIMEOUT_S = 30.0

#: Nodes a parsed query may consist of.
PARSED = {
    "Project", "Filter", "Join", "LateralJoin", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Union", "Intersect", "Except", "SubqueryAlias",
    "UnresolvedSubqueryColumnAliases", "UnresolvedWith", "UnresolvedHaving", "UnresolvedRelation", "UnresolvedInlineTable", "ResolvedInlineTable", "OneRowRelation",
    "LocalRelation", "WithWindowDefinition", "Generate", "UnresolvedHint", "Pivot", "UnresolvedPivot", "Unpivot", "UnresolvedUnpivot",
}
#: Expressions of the parsed plan that stand for something still to be found; calls are judged by name as well.
NAMES = {
    "UnresolvedAlias", "UnresolvedAttribute", "UnresolvedStar", "UnresolvedFunction", "UnresolvedGenerator", "UnresolvedExtractValue", "UnresolvedOrdinal", "UnresolvedSubqueryColumnAliases",
    "UnresolvedNamedLambdaVariable", "UnresolvedWindowExpression", "UnresolvedStarExceptOrReplace", "MultiAlias", "UnresolvedGroupByAll",
}
#: Nodes an analysed query may consist of; a View is a registered table, and what it reads is not judged.
ANALYSED = {
    "Project", "Filter", "Join", "LateralJoin", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Deduplicate", "Union", "Intersect", "Except",
    "SubqueryAlias", "View", "WithCTE", "CTERelationDef", "CTERelationRef", "OneRowRelation", "LocalRelation", "Window", "Generate", "Expand", "ResolvedHint",
}
#: Nodes that can only come from a table's name.
TABLES = {"View", "LogicalRelation", "DataSourceV2Relation", "HiveTableRelation", "LogicalRDD"}
#: Groups of the engine's own functions a query may call: all but those that reach outside the data, which are in `misc_funcs`.
GROUPS = {
    "agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs", "csv_funcs", "datetime_funcs", "generator_funcs", "hash_funcs",
    "json_funcs", "lambda_funcs", "map_funcs", "math_funcs", "predicate_funcs", "string_funcs", "struct_funcs", "url_funcs", "variant_funcs", "window_funcs",
}
#: Functions of the data alone that are in `misc_funcs`: readers of sketches and bitmaps.
READERS = r"(hll|kll|theta|bitmap|approx_top_k)_\w+|typeof"
#: Functions of these groups that still reach outside: a value of the session or machine.
DENIED = {"current_user", "user", "session_user", "current_database", "current_schema", "current_catalog", "version", "uuid"}
#: Resolved expressions that no function's entry names: what queries are made of, and what some functions and operators become.
PARTS = {
    "Alias", "AttributeReference", "OuterReference", "Literal", "Cast", "SortOrder", "AggregateExpression", "WindowExpression", "WindowSpecDefinition", "SpecifiedWindowFrame",
    "UnspecifiedFrame", "UnboundedPreceding", "UnboundedFollowing", "CurrentRow", "ScalarSubquery", "Exists", "ListQuery", "InSubquery", "LateralSubquery", "LambdaFunction",
    "NamedLambdaVariable", "GetStructField", "GetArrayItem", "GetMapValue", "GetArrayStructFields", "LikeAll", "LikeAny", "NotLikeAll", "NotLikeAny", "TryEval", "InSet", "NoOp",
    "DateAddInterval", "DateAddYMInterval", "TimestampAddInterval", "TimestampAddYMInterval", "TimeAdd", "SubtractDates", "SubtractTimestamps", "SubtractTimes", "MultiplyYMInterval", "MultiplyDTInterval",
    "DivideYMInterval", "DivideDTInterval", "StringLPad", "StringRPad", "BinaryPad", "RoundCeil", "RoundFloor", "ParseToTimestamp", "ParseToDate", "ToTime", "ToCharacter", "DateFormatClass", "SecondsOfTime",
    "HoursOfTime", "MinutesOfTime", "SecondWithFraction", "BetweenExpr", "CurrentDate", "Grouping", "GroupingID", "VirtualColumn",
    "PreciseTimestampConversion", "KnownNullable", "KnownNotNull", "ResolvedCollation", "With", "CommonExpressionDef", "CommonExpressionRef", "StringDecode", "Encode", "TypedNullLiteral",
}
#: How the engine runs what a function of an allowed class is replaced by; nowhere else.
REPLACED = {"StaticInvoke", "Invoke"}
#: Names of internal tables that a question is never about.
SYSTEM_TABLES = ("sqlite_master", "sqlite_temp_master", "sqlite_schema", "information_schema", "pg_catalog")


class UnsafeQuery(ValueError):
    """The text is not a single read-only query over registered tables."""


class QueryTimeout(RuntimeError):
    """The query ran longer than it may."""


@dataclass
class Outcome:
    """What a query came to; an error is recorded and not raised."""

    rows: list[tuple] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)
    latency_ms: float = 0.0
    error: str | None = None
    timed_out: bool = False

    @property
    def success(self) -> bool:
        return self.error is None


def bare(sql: str) -> str:
    """The text without string literals, quoted names and comments."""
    return re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", lambda m: "''" if m[0][0] in "'\"`" else " ", sql, flags=re.S)


def _each(seq) -> Iterable:
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def nodes(plan) -> Iterable:
    """The nodes of a plan with CTE bodies and the plans of subqueries; below a table's name there are none."""
    yield plan
    if _kind(plan) in TABLES:
        return
    for child in _each(plan.children()):
        yield from nodes(child)
    if _kind(plan) == "UnresolvedWith":
        for relation in _each(plan.cteRelations()):
            yield from nodes(relation._2())
    for e in _each(plan.expressions()):
        for inner in _expressions(e):
            if hasattr(inner, "plan") and _kind(inner) in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
                yield from nodes(inner.plan())


def _expressions(e) -> Iterable:
    yield e
    for child in _each(e.children()):
        yield from _expressions(child)


@cache
def _functions(jvm) -> tuple[frozenset[str], frozenset[str]]:
    """Names of the engine's own functions that may be called, and the classes that they become."""
    builtin = jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
    names, classes = set(), set(PARTS)
    for identifier in _each(builtin.listFunction()):
        info = builtin.lookupFunction(identifier).get()
        name = str(identifier.funcName())
        if (info.getGroup() in GROUPS or re.fullmatch(READERS, name)) and name not in DENIED:
            names.add(name)
            classes.add(re.sub(r"(Expression)?Builder$", "", str(info.getClassName()).rpartition(".")[2].rstrip("$")))
    return frozenset(names), frozenset(classes)


def _judge_parsed(spark: SparkSession, plan, tables: Iterable[str] | None) -> None:
    known, names = ({t.lower() for t in tables} if tables is not None else None), _functions(spark._jvm)[0]
    registry = spark._jsparkSession.sessionState().functionRegistry()
    found_nodes = list(nodes(plan))
    ctes = {str(r._1()).lower() for n in found_nodes if _kind(n) == "UnresolvedWith" for r in _each(n.cteRelations())}

    def call(parts: list[str]) -> None:
        name = parts[0].lower()
        if len(parts) > 1 or name not in names:
            raise UnsafeQuery(f"function not allowed: {'.'.join(parts)}")
        found = registry.lookupFunction(spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
        if found.isEmpty() or not str(found.get().getClassName()).startswith("org.apache.spark.sql.catalyst.expressions."):
            raise UnsafeQuery(f"function not allowed: {name} is not the engine's own here")

    for node in found_nodes:
        if _kind(node) not in PARSED:
            raise UnsafeQuery(f"not a read-only query: {_kind(node)}")
        if _kind(node) == "UnresolvedRelation":
            parts = [str(p).lower() for p in _each(node.multipartIdentifier())]
            if len(parts) > 1 or (known is not None and parts[0] not in known | ctes):
                raise UnsafeQuery(f"unknown relation: {'.'.join(parts)}")
        for e in [x for root in _each(node.expressions()) for x in _expressions(root)] + ([x for x in _expressions(node.generator())] if _kind(node) == "Generate" else []):
            kind = _kind(e)
            if ".analysis." in str(e.getClass().getName()) and kind not in NAMES:
                raise UnsafeQuery(f"not allowed: {kind}")
            if kind == "UnresolvedFunction":
                call([str(p) for p in _each(e.nameParts())])
            elif kind == "UnresolvedGenerator":
                call([str(e.name().funcName())] if e.name().database().isEmpty() else [str(e.name().database().get()), str(e.name().funcName())])


def _judge_analysed(spark: SparkSession, plan) -> None:
    classes = _functions(spark._jvm)[1]
    replaceable = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.RuntimeReplaceable")

    def judge(e, replaced: bool) -> None:
        kind, where = _kind(e), str(e.getClass().getName())
        own = where.startswith("org.apache.spark.sql.catalyst.expressions.")
        if not own or (kind not in classes and not (replaced and kind in REPLACED)):
            raise UnsafeQuery(f"expression not allowed: {kind}")
        inside = replaced or bool(replaceable.isInstance(e))
        for child in _each(e.children()):
            judge(child, inside)

    for node in nodes(plan):
        if _kind(node) not in ANALYSED | TABLES:
            raise UnsafeQuery(f"not a read-only query: {_kind(node)}")
        if _kind(node) not in TABLES:
            for e in _each(node.expressions()):
                judge(e, False)


def judged(spark: SparkSession, sql: str, tables: Iterable[str] | None = None) -> DataFrame:
    """The query of the text, analysed and not run, or UnsafeQuery."""
    plain = bare(sql).strip()
    if not plain:
        raise UnsafeQuery("empty query")
    if ";" in plain.rstrip(";").rstrip() or plain.count(";") > 1 or (";" in plain and not plain.endswith(";")):
        raise UnsafeQuery("more than one statement")
    if ";" in plain and not sql.rstrip().endswith(";"):
        raise UnsafeQuery("text after the statement")
    session, sql_package = spark._jsparkSession, spark._jvm.org.apache.spark.sql
    try:
        plan = sql_package.catalyst.parser.CatalystSqlParser().parsePlan(sql.rstrip().rstrip(";"))  # knows no commands and no variables
    except ParseException as e:
        raise UnsafeQuery(f"does not parse: {str(e)[:200]}") from e
    _judge_parsed(spark, plan, tables)
    found = sql_package.classic.Dataset.ofRows(session, plan)
    _judge_analysed(spark, found.queryExecution().analyzed())
    return DataFrame(found, spark)


def check(spark: SparkSession, sql: str, tables: Iterable[str] | None = None) -> str:
    """The text without its final semicolon, or UnsafeQuery. Whether its names exist is not judged."""
    try:
        judged(spark, sql, tables)
    except AnalysisException as e:
        if isinstance(e, ParseException):
            raise
    return sql.rstrip().rstrip(";")


def is_safe(spark: SparkSession, sql: str, tables: Iterable[str] | None = None) -> bool:
    try:
        check(spark, sql, tables)
    except UnsafeQuery:
        return False
    return True


def execute(spark: SparkSession, sql: str, timeout_s: float = TIMEOUT_S, max_rows: int = MAX_ROWS) -> tuple[list[tuple], list[str], float]:
    """(rows, columns, ms) of a guarded query; its jobs are cancelled past the timeout, and too many rows are an error."""
    query, began, done = judged(spark, sql), time.perf_counter(), {}
    group = f"guarded-{uuid.uuid4().hex}"

    def run() -> None:
        spark.sparkContext.setJobGroup(group, "guarded query", interruptOnCancel=True)
        try:
            done["result"] = (bounded_rows(query, max_rows), query.columns)
        except Exception as e:  # noqa: BLE001  (handed to the caller's thread)
            done["error"] = e

    thread = InheritableThread(target=run, daemon=True)
    thread.start()
    thread.join(timeout_s)
    if thread.is_alive():
        spark.sparkContext.cancelJobGroup(group)
        thread.join(5)
        raise QueryTimeout(f"query exceeded {timeout_s:g} s")
    if "error" in done:
        raise done["error"]
    return *done["result"], (time.perf_counter() - began) * 1000


def safe_execute(spark: SparkSession, sql: str, **limits) -> Outcome:
    began = time.perf_counter()
    try:
        rows, columns, ms = execute(spark, sql, **limits)
        return Outcome(rows, columns, ms)
    except Exception as e:  # noqa: BLE001  (the envelope's purpose)
        ms = (time.perf_counter() - began) * 1000
        return Outcome(latency_ms=ms, error=f"{type(e).__name__}: {str(e)[:200]}", timed_out=isinstance(e, QueryTimeout))




def truncated(spark: SparkSession, sql: str, rows: int = 100) -> tuple[list[tuple], list[str]]:
    """At most `rows` rows of a guarded query and its columns; a larger result is cut without an error."""
    df = judged(spark, sql)
    return [tuple(r) for r in df.limit(rows).collect()], df.columns


#: Words that change data or schema, and the openings of a reading statement, in the text-only check.
MUTATIONS = ("INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "REPLACE", "TRUNCATE", "ATTACH", "DETACH", "VACUUM", "REINDEX")
OPENINGS = ("SELECT", "WITH", "EXPLAIN")
#: What the text-only check reads: literals and quoted names, comments, words, ends of statements, assignments.
LEXEME = r"(?s)'[^']*'|\"[^\"]*\"|--[^\n]*|/\*.*?\*/|\w+|;|=|[^\s\w]"


def text_verdicts(sql: Column) -> Column:
    """The text-only check of a column of statements, for SQL of other engines: struct(allowed, reason).

    One pass makes a list of lexemes without comments, literals as one mark; the reasons are questions to the list, the first that holds is
    given. EXPLAIN may read; a PRAGMA may not set a value. Null is empty.
    """
    lexemes = F.filter(F.regexp_extract_all(F.coalesce(sql, F.lit("")), F.lit(LEXEME), 0), lambda x: ~x.rlike(r"^(--|/\*)"))
    words = F.transform(lexemes, lambda x: F.when(x.rlike("^['\"]"), "?").otherwise(F.upper(x)))
    reason = F.get(F.transform(F.array(words), _reason), F.lit(0))  # the list is made once and named in the lambda
    return F.struct(reason.isNull().alias("allowed"), reason.alias("reason"))


def _reason(words: Column) -> Column:
    bad = F.get(F.filter(words, lambda x: x.isin(*MUTATIONS)), F.lit(0))
    at = F.transform(words, lambda x, i: F.struct(x.alias("word"), F.get(words, i + 1).alias("next"), F.get(words, i + 2).alias("second")))
    sets = lambda p: (p["next"] == "=") | (p["next"].rlike(r"^\w+$") & (p["second"] == "="))
    setting = F.exists(at, lambda p: (p["word"] == "PRAGMA") & F.coalesce(sets(p), F.lit(False)))
    ends = F.array_position(words, ";").cast("int")
    more = (ends > 0) & F.exists(F.slice(words, F.greatest(ends, F.lit(1)), F.greatest(F.size(words), F.lit(1))), lambda x: x != ";")
    reason = F.when(~F.exists(words, lambda x: x != ";"), "empty query").when(bad.isNotNull(), F.concat(bad, F.lit(" changes data"))).when(setting, "PRAGMA sets a value")
    return reason.when(~F.coalesce(F.get(words, F.lit(0)).isin(*OPENINGS), F.lit(False)), "not SELECT, WITH or EXPLAIN").when(more, "more than one statement")


def names_system_table(sql: str) -> bool:
    """Whether the text mentions an internal table."""
    return any(name in sql.lower() for name in SYSTEM_TABLES)
