"""Per-item scores of predicted against gold SQL, and their summaries by set and system."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.functions import sqltext
from tallyglass.operators.stats import RESAMPLES, bootstrap_mean, ratio, wilson


SIMILARITIES = ("edit_similarity", "token_f1", "clause_jaccard", "link_f1")


def outcome() -> Column:
    """executed_exact, executed_match, valid_wrong or invalid."""
    executed = F.coalesce("executed", F.lit(False))
    return F.when(executed & F.col("exact"), "executed_exact").when(executed, "executed_match").when(F.col("valid"), "valid_wrong").otherwise("invalid")


#: Reasons why an item is wrong, in the order in which they are tried; the last is left over.
ERROR_LABELS = (
    "no sql produced", "did not answer with SQL", "hallucinated table", "hallucinated column", "syntax error", "invented aggregation", "missing aggregation", "missing join",
    "spurious join", "dropped filter", "semantic error (gold not executable here)", "semantic error",
)
#: Two openings of clauses with nothing between them, and names before a parenthesis or after a dot.
BARE_CLAUSE = r"\b(select|from|where)\s+(from|where|group\s+by|order\s+by|having)\b"
SOURCE, MEMBER = r"\b(?:from|join)\s+[`\"\[]?(\w+)", r"\b[a-z_]\w*\.([a-z_]\w*)\b"


def error_label(schema: Mapping[str, Sequence[str]]) -> Column:
    """The first of ERROR_LABELS that an item's prediction has, from its text, its flags and the gold's; null where it executed right.

    schema: tables (lower case) with their columns. `gold_ok` (boolean) says whether the gold itself ran here.
    """
    body, words = sqltext.stripped(F.col("pred_sql")), sqltext.words(F.col("pred_sql"))
    known = lambda names: F.array(*map(F.lit, sorted(names))).cast("array<string>")
    sources, members = (F.regexp_extract_all(body, F.lit(p), 1) for p in (SOURCE, MEMBER))
    gained = lambda clause: F.col(f"pred_flags.{clause}").cast("int") - F.col(f"gold_flags.{clause}").cast("int")
    broken = body.rlike(BARE_CLAUSE) | body.contains("syntax") | (~F.col("valid") & (body.contains("()") | ~sqltext.balanced(F.col("pred_sql"))))
    holds = (
        words == 0,
        ~body.rlike(r"^\s*(select|with)\b"),
        (F.size(sources) > 0) & (F.size(F.array_intersect(sources, known(schema))) == 0),
        F.size(F.array_except(members, known({c for cs in schema.values() for c in cs}))) > 0,
        broken,
        gained("aggregate") > 0, gained("aggregate") < 0, gained("join") < 0, gained("join") > 0, gained("where") < 0,
        ~F.coalesce("gold_ok", F.lit(True)),
        F.lit(True),
    )
    label = F.coalesce(*[F.when(h, name) for name, h in zip(ERROR_LABELS, holds, strict=True)])
    return F.when(~F.coalesce("executed", F.lit(False)), label)


def failure() -> Column:
    """Why an item is wrong, first reason that holds; null where it executed right."""
    lost = lambda c: F.col(f"gold_flags.{c}") != F.col(f"pred_flags.{c}")
    reasons = [
        ("empty", F.trim(F.col("pred_sql")) == ""), ("invalid", ~F.col("valid")), ("schema_link", F.col("link_f1") < 1), ("join", lost("join")),
        ("aggregation", lost("aggregate")), ("grouping", lost("group_by") | lost("having")), ("subquery", lost("subquery") | lost("cte") | lost("set_op")),
        ("ordering", lost("order_by") | lost("limit")), ("filter", lost("where")),
    ]
    found = F.when(F.coalesce("executed", F.lit(False)), None)
    for name, holds in reasons:
        found = found.when(holds, name)
    return found.otherwise("values")


def likeness(p: Column, g: Column, names: Sequence[str]) -> list[Column]:
    """SIMILARITIES of predicted and gold text beside their pred_flags and gold_flags."""
    measures = (sqltext.edit_similarity(p, g), sqltext.token_f1(p, g), sqltext.flags_jaccard(F.col("pred_flags"), F.col("gold_flags")), sqltext.link_f1(sqltext.references(p, names), sqltext.references(g, names)))
    return [F.round(m, 6).alias(name) for name, m in zip(SIMILARITIES, measures, strict=True)]


def mean_likeness(rows: DataFrame, names: Sequence[str], by: Sequence[str] = ("system",)) -> DataFrame:
    """by, n and the mean SIMILARITIES of rows (gold_sql, pred_sql); each distinct pair of texts is compared once a group."""
    g, p = F.col("gold_sql"), F.col("pred_sql")
    texts = rows.select(*by, *[F.coalesce(c, F.lit("")).alias(c) for c in ("gold_sql", "pred_sql")])
    pairs = texts.groupBy(*by, "gold_sql", "pred_sql").agg(F.count(F.lit(1)).alias("n")).withColumns({"gold_flags": sqltext.flags(g), "pred_flags": sqltext.flags(p)})
    found = pairs.select(*by, "n", *likeness(p, g, sorted(names)))
    return found.groupBy(*by).agg(F.sum("n").alias("n"), *[(F.sum(F.col(m) * F.col("n")) / F.sum("n")).alias(m) for m in SIMILARITIES])


def item_scores(rows: DataFrame, tables: Sequence[str] | Mapping[str, Sequence[str]]) -> DataFrame:
    """One wide row an item from set, system, idx, gold_sql, pred_sql, valid, executed; null SQL is empty.

    tables: the schema's tables (lower case), with their columns where links are to count columns as well.

    All measures are expressions of one projection, so items are scored in a single narrow pass.
    """
    gold, pred = (F.coalesce(F.col(c), F.lit("")) for c in ("gold_sql", "pred_sql"))
    base = rows.select("set", "system", "idx", gold.alias("gold_sql"), pred.alias("pred_sql"), F.coalesce("valid", F.lit(False)).alias("valid"), "executed")
    g, p = F.col("gold_sql"), F.col("pred_sql")
    base = base.withColumns({"gold_flags": sqltext.flags(g), "pred_flags": sqltext.flags(p)})  # what others are made of
    schema = tables if isinstance(tables, Mapping) else {t: () for t in tables}
    names = sorted(schema)
    found = base.select(
        "*",
        (sqltext.normalised(g) == sqltext.normalised(p)).alias("exact"),
        *likeness(p, g, names),
        sqltext.link_counts(sqltext.used(p, schema), sqltext.used(g, schema)).alias("links"),
        sqltext.signature(g).alias("gold_signature"), sqltext.signature(p).alias("pred_signature"),
        sqltext.tier(g).alias("tier"), sqltext.family(g).alias("family"), sqltext.length_bin(g).alias("length_bin"), sqltext.balanced(p).alias("balanced"),
    )
    return found.select("*", outcome().alias("outcome"), failure().alias("failure"))


def summary(items: DataFrame, by: Sequence[str] = ("set", "system")) -> DataFrame:
    """Counts, rates with Wilson bounds over scored items, and mean similarities of each group."""
    right = F.count_if(F.col("executed"))
    scored = F.count(F.col("executed"))
    agg = items.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), scored.alias("scored"), right.alias("right"), F.count_if("valid").alias("n_valid"), F.count_if("exact").alias("n_exact"),
        *[F.round(F.avg(c), 6).alias(c) for c in ("edit_similarity", "token_f1", "clause_jaccard", "link_f1")],
    )
    low, high = wilson(F.col("right").cast("double"), F.col("scored").cast("double"))
    rates = {"valid": ("n_valid", "n"), "exact": ("n_exact", "n"), "ex": ("right", "scored")}
    return agg.select("*", *[F.round(ratio(F.col(a), F.col(b)), 6).alias(f"{k}_rate") for k, (a, b) in rates.items()], F.round(low, 6).alias("ex_low"), F.round(high, 6).alias("ex_high"))


def summary_intervals(items: DataFrame, by: Sequence[str] = ("set", "system"), measures: Sequence[str] = SIMILARITIES, resamples: int = RESAMPLES) -> DataFrame:
    """by, measure, mean, low, high: bootstrap intervals of the mean similarities; one pass over the items for all measures."""
    long = items.select(*by, F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])))
    return bootstrap_mean(long.withColumnRenamed("value", "x"), "x", [*by, "measure"], resamples)


def micro_link(items: DataFrame, by: Sequence[str] = ("set", "system")) -> DataFrame:
    """by, tp, fp, fn, precision, recall, f1 of schema links over all items together, and items with all and with no spurious names.

    Needs `links`, the counts of sqltext.link_counts().
    """
    sums = items.groupBy(*by).agg(
        *[F.sum(f"links.{c}").alias(c) for c in ("tp", "fp", "fn")], F.count_if(F.col("links.fn") == 0).alias("all_found"), F.count_if(F.col("links.fp") == 0).alias("none_spurious")
    )
    rates = sqltext.link_rates(F.struct("tp", "fp", "fn"))
    return sums.withColumn("r", rates).select(*by, "tp", "fp", "fn", *[F.round(F.col(f"r.{c}"), 6).alias(c) for c in ("precision", "recall", "f1")], "all_found", "none_spurious")


def signature_matrix(items: DataFrame, by: Sequence[str] = ("set", "system")) -> DataFrame:
    """by, gold_signature, pred_signature, n: what clauses were asked for against what came."""
    return items.groupBy(*by, "gold_signature", "pred_signature").agg(F.count(F.lit(1)).alias("n"))


def signature_counts(rows: DataFrame, by: Sequence[str] = ("system",)) -> DataFrame:
    """by, signature, n of predicted texts; each distinct text is read once a group."""
    texts = rows.groupBy(*by, "pred_sql").agg(F.count(F.lit(1)).alias("n")).select(*by, "n", sqltext.signature(F.col("pred_sql")).alias("signature"))
    return texts.groupBy(*by, "signature").agg(F.sum("n").alias("n"))


def accuracy_by(items: DataFrame, column: str, by: Sequence[str] = ("system",)) -> DataFrame:
    """by, the column, n, ex (over scored items; 0 without any), valid_rate, exact_rate."""
    agg = items.groupBy(*by, column).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.avg(F.col("executed").cast("double")), F.lit(0.0)), 6).alias("ex"),
        F.round(F.avg(F.col("valid").cast("double")), 6).alias("valid_rate"), F.round(F.avg(F.col("exact").cast("double")), 6).alias("exact_rate"),
    )
    return agg


def clause_confusion(items: DataFrame, by: Sequence[str] = ("system",)) -> DataFrame:
    """Per clause: tp, fp, fn, tn of the prediction having what the gold has."""
    pairs = F.array(*[F.struct(F.lit(c).alias("clause"), F.col(f"gold_flags.{c}").alias("g"), F.col(f"pred_flags.{c}").alias("p")) for c in sqltext.CLAUSES])
    long = items.select(*by, F.inline(pairs))
    g, p = F.col("g"), F.col("p")
    return long.groupBy(*by, "clause").agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"))


def cooccurrence(items: DataFrame, flags: str) -> DataFrame:
    """a, b, r: correlation of clause presences, 0 where one is constant; one aggregate over all pairs of clauses."""
    names = list(sqltext.CLAUSES)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    bit = lambda c: F.col(f"{flags}.{c}").cast("double")
    one = [F.sum(bit(c)).alias(c) for c in names]
    both = [F.sum(bit(a) * bit(b)).alias(f"{a}|{b}") for a, b in pairs]
    row = items.agg(F.count(F.lit(1)).cast("double").alias("n"), *one, *both)

    def r(a: str, b: str) -> Column:
        n, x, y, xy = F.col("n"), F.col(a), F.col(b), F.col(f"`{a}|{b}`")
        den = F.sqrt((n * x - x * x) * (n * y - y * y))
        return F.round(F.when(den > 0, (n * xy - x * y) / den).otherwise(0.0), 6)

    return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r(a, b).alias("r")) for a, b in pairs])))


def frobenius(x: DataFrame, y: DataFrame) -> float:
    """Distance of two co-occurrence tables as symmetric matrices."""
    joined = x.join(y.withColumnRenamed("r", "r2"), ["a", "b"])
    return float(joined.agg(F.sqrt(2 * F.sum((F.col("r") - F.col("r2")) ** 2))).first()[0] or 0.0)


def migration(items: DataFrame, before: str, after: str) -> DataFrame:
    """before, after, n: how items' failures move between two systems; right is 'none'."""
    reason = F.coalesce("failure", F.lit("none"))
    a = items.where(F.col("system") == before).select("set", "idx", reason.alias("before"))
    b = items.where(F.col("system") == after).select("set", "idx", reason.alias("after"))
    return a.join(b, ["set", "idx"]).groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))
