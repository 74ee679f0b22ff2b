"""Evaluation queries over statements that the given tables make: each event asks one question and is answered once.

An event's numbers choose a question's statement and how its answer went wrong, so the statements grow with the events and both
engines make the same ones.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyglass.functions import sqltext
from tallyglass.operators import guard, items, scoring
from tallyglass.plans.evaluation import GOLD_SQL, NAMES, RUNS_SQL, STRIPPED, TEXTS, pattern, predictions, query
from tallyglass.session import table

# ---- verdicts on text -----------------------------------------------------------------------------------------------

#: How a turn's words are made into a statement: before, after.
WRAPS = (
    ("SELECT text FROM notes WHERE note = '", "'"), ("", ""), ("select 1; ", ""), ("DELETE FROM notes -- ", ""), ("explain select '", "' /* drop */;"),
    ("PRAGMA mode = 1 ", ""), ("WITH a AS (SELECT 1) INSERT INTO notes SELECT '", "'"), ("SELECT \"", "\" FROM notes;;"),
)
_WRAPPED = "CASE (conv_id * 31 + turn) % 8 " + " ".join(f"WHEN {i} THEN '{a.replace(chr(39), chr(39) * 2)}' || text || '{b.replace(chr(39), chr(39) * 2)}'" for i, (a, b) in enumerate(WRAPS)) + " END"
_MUTATIONS = ", ".join(repr(m) for m in guard.MUTATIONS)
_SETS = "list_filter(range(1, len(w) + 1), lambda i: w[i] = 'PRAGMA' AND coalesce(w[i + 1] = '=' OR (regexp_matches(w[i + 1], '^\\w+$') AND w[i + 2] = '='), false))"


@query(
    f"""WITH s AS (SELECT conv_id, turn, {_WRAPPED} AS t FROM conversations),
        l AS (SELECT conv_id, turn, list_transform(list_filter(regexp_extract_all(t, '{guard.LEXEME.replace("'", "''")}'), lambda x: NOT regexp_matches(x, '^(--|/\\*)')),
            lambda x: CASE WHEN regexp_matches(x, '^[''"]') THEN '?' ELSE upper(x) END) AS w FROM s),
        f AS (SELECT *, list_filter(w, lambda x: x IN ({_MUTATIONS})) AS bad, coalesce(list_position(w, ';'), 0) AS e FROM l),
        r AS (SELECT conv_id, turn, CASE WHEN len(list_filter(w, lambda x: x <> ';')) = 0 THEN 'empty query' WHEN len(bad) > 0 THEN bad[1] || ' changes data'
            WHEN len({_SETS}) > 0 THEN 'PRAGMA sets a value' WHEN w[1] NOT IN ('SELECT', 'WITH', 'EXPLAIN') THEN 'not SELECT, WITH or EXPLAIN'
            WHEN e > 0 AND len(list_filter(w[e:], lambda x: x <> ';')) > 0 THEN 'more than one statement' END AS reason FROM f)
        SELECT conv_id, turn, reason IS NULL AS allowed, reason FROM r"""
)
def guard_verdicts(spark, sf_dir):
    """Whether each turn, wrapped into a statement, would be let pass by the text-only check, and why not."""
    k = (F.col("conv_id") * 31 + F.col("turn")) % len(WRAPS)
    wrapped = F.coalesce(*[F.when(k == i, F.concat(F.lit(a), "text", F.lit(b))) for i, (a, b) in enumerate(WRAPS)])
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", guard.text_verdicts(wrapped).alias("v")).select("conv_id", "turn", "v.allowed", "v.reason")


# ---- answers: gold and predicted statements ---------------------------------------------------------------------------

#: How an answer differs from its question's gold text, by its draw: the gold, the next question's, shouted, without its filter word, prose, or cut.
_N = len(TEXTS)
_ANSWERS = f"""{RUNS_SQL}, g AS (SELECT sql, ROW_NUMBER() OVER (ORDER BY name) - 1 AS k FROM {GOLD_SQL} t),
    a AS (SELECT p.kind AS set, p.system, p.item AS idx, x.sql AS gold_sql, p.correct, p.d, CASE WHEN p.correct THEN x.sql ELSE CASE p.d // 16 % 6 WHEN 0 THEN y.sql WHEN 1 THEN upper(x.sql) || ' LIMIT ' || p.item
        WHEN 2 THEN replace(x.sql, 'WHERE', 'AND') WHEN 3 THEN 'item ' || p.item || ' is not in the data' WHEN 4 THEN substr(x.sql, 1, 7 + p.item % 40) ELSE '' END END AS pred_sql
        FROM preds p JOIN g x ON p.item % {_N} = x.k JOIN g y ON (p.item + 1) % {_N} = y.k)"""


def answers(spark, sf_dir):
    """set, system, idx, gold_sql, pred_sql, valid, executed: every event's question under each system, right or wrong by its draw."""
    texts = F.array(*[F.lit(sql) for _, sql in TEXTS])
    p = predictions(spark, sf_dir)
    at = lambda k: F.element_at(texts, ((F.col("item") + k) % _N + 1).cast("int"))
    rows = p.select(F.col("kind").alias("set"), "system", F.col("item").alias("idx"), at(0).alias("gold_sql"), at(1).alias("next_sql"), "correct", (F.floor(F.col("d") / 16) % 6).alias("k"))
    gold, idx = F.col("gold_sql"), F.col("idx")
    wrong = F.when(F.col("k") == 0, F.col("next_sql")).when(F.col("k") == 1, F.concat(F.upper(gold), F.lit(" LIMIT "), idx)).when(F.col("k") == 2, F.replace(gold, F.lit("WHERE"), F.lit("AND")))
    wrong = wrong.when(F.col("k") == 3, F.concat(F.lit("item "), idx, F.lit(" is not in the data"))).when(F.col("k") == 4, F.substring(gold, F.lit(1), (7 + idx % 40).cast("int"))).otherwise("")
    return rows.select("set", "system", "idx", "gold_sql", F.when(F.col("correct"), gold).otherwise(wrong).alias("pred_sql"), (F.col("correct") | (F.col("k") < 2)).alias("valid"), F.col("correct").alias("executed"))


def scored_items(spark, sf_dir):
    return items.item_scores(answers(spark, sf_dir), NAMES)


_FLAG = {side: {c: f"regexp_matches({STRIPPED.replace('sql', f'{side}_sql')}, '{pattern(c)}')" for c in sqltext.CLAUSES} for side in ("gold", "pred")}
_LONG = " UNION ALL ".join(f"SELECT system, '{c}' AS clause, {_FLAG['gold'][c]} AS g, {_FLAG['pred'][c]} AS p FROM a" for c in sqltext.CLAUSES)


@query(
    f"""WITH {_ANSWERS}, l AS ({_LONG}) SELECT system, clause, SUM((g AND p)::INT)::BIGINT AS tp, SUM((NOT g AND p)::INT)::BIGINT AS fp,
        SUM((g AND NOT p)::INT)::BIGINT AS fn, SUM((NOT g AND NOT p)::INT)::BIGINT AS tn FROM l GROUP BY ALL"""
)
def answer_clauses(spark, sf_dir):
    """Per system and clause: whether answers have the clauses that their gold has."""
    return items.clause_confusion(scored_items(spark, sf_dir))


_SIGNATURE = "concat_ws('+', " + ", ".join(f"CASE WHEN {_FLAG['pred'][c]} THEN '{c}' END" for c in sqltext.CLAUSES) + ")"


@query(f"WITH {_ANSWERS} SELECT system, {_SIGNATURE} AS signature, COUNT(*) AS n FROM a GROUP BY ALL")
def answer_signatures(spark, sf_dir):
    """The clauses that come together in answers, by system."""
    return items.signature_counts(answers(spark, sf_dir))


_TOKENS = "regexp_extract_all(lower({}), '[a-z_][a-z0-9_]*|\\d+(?:\\.\\d+)?|''[^'']*''|<>|<=|>=|!=|[^\\s\\w]')"
_SHARED = "list_sum(list_transform(list_distinct(x), lambda t: least(len(list_filter(x, lambda u: u = t)), len(list_filter(y, lambda u: u = t)))))"
_BOTH = {op: " + ".join(f"({_FLAG['pred'][c]} {op} {_FLAG['gold'][c]})::INT" for c in sqltext.CLAUSES) for op in ("AND", "OR")}
_REFS = {side: f"list_intersect(list_distinct({_TOKENS.format(STRIPPED.replace('sql', f'{side}_sql'))}), [{', '.join(map(repr, NAMES))}])" for side in ("gold", "pred")}
_PANEL = f"""m AS (SELECT *, {_TOKENS.format('pred_sql')} AS x, {_TOKENS.format('gold_sql')} AS y, {_REFS['pred']} AS p, {_REFS['gold']} AS q, {_BOTH['AND']} AS c_both, {_BOTH['OR']} AS c_any FROM a),
    v AS (SELECT *, ROUND(CASE WHEN greatest(length(pred_sql), length(gold_sql)) = 0 THEN 1.0 ELSE 1 - levenshtein(pred_sql, gold_sql)::DOUBLE / greatest(length(pred_sql), length(gold_sql)) END, 6) AS edit_similarity,
        ROUND(CASE WHEN len(x) + len(y) = 0 THEN 1.0 ELSE 2.0 * coalesce({_SHARED}, 0)::DOUBLE / (len(x) + len(y)) END, 6) AS token_f1,
        ROUND(CASE WHEN c_any = 0 THEN 1.0 ELSE c_both::DOUBLE / c_any END, 6) AS clause_jaccard,
        ROUND(CASE WHEN len(p) + len(q) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(p, q))::DOUBLE / (len(p) + len(q)) END, 6) AS link_f1 FROM m)"""


@query(
    f"""WITH {_ANSWERS}, {_PANEL} SELECT system, COUNT(*) AS n, ROUND(AVG(edit_similarity), 4) AS edit_similarity, ROUND(AVG(token_f1), 4) AS token_f1,
        ROUND(AVG(clause_jaccard), 4) AS clause_jaccard, ROUND(AVG(link_f1), 4) AS link_f1 FROM v GROUP BY system"""
)
def answer_similarity(spark, sf_dir):
    """Mean likeness of answers to their gold, by system and measure."""
    found = items.mean_likeness(answers(spark, sf_dir), NAMES)
    return found.select("system", "n", *[F.round(m, 4).alias(m) for m in items.SIMILARITIES])


_LOST = lambda *clauses: " OR ".join(f"{_FLAG['gold'][c]} <> {_FLAG['pred'][c]}" for c in clauses)
_FAILURE = f"""CASE WHEN correct THEN 'none' WHEN trim(pred_sql) = '' THEN 'empty' WHEN d // 16 % 6 >= 2 THEN 'invalid' WHEN link_f1 < 1 THEN 'schema_link' WHEN {_LOST('join')} THEN 'join'
    WHEN {_LOST('aggregate')} THEN 'aggregation' WHEN {_LOST('group_by', 'having')} THEN 'grouping' WHEN {_LOST('subquery', 'cte', 'set_op')} THEN 'subquery'
    WHEN {_LOST('order_by', 'limit')} THEN 'ordering' WHEN {_LOST('where')} THEN 'filter' ELSE 'values' END"""


@query(
    f"""WITH {_ANSWERS}, {_PANEL}, f AS (SELECT set, idx, system, {_FAILURE} AS failure FROM v)
        SELECT x.failure AS before, y.failure AS after, COUNT(*) AS n FROM f x JOIN f y USING (set, idx) WHERE x.system = 'base' AND y.system = 'tuned' GROUP BY ALL"""
)
def answer_migration(spark, sf_dir):
    """How the reasons of wrong answers move from one system to another."""
    return items.migration(scored_items(spark, sf_dir), "base", "tuned")


@query(
    f"""WITH {_ANSWERS}, s AS (SELECT system, COUNT(*) AS n, SUM(correct::INT)::BIGINT AS n_right, SUM((correct OR d // 16 % 6 < 2)::INT)::BIGINT AS n_valid FROM a GROUP BY system)
        SELECT system, n, n_valid, n_right, ROUND(n_right::DOUBLE / n, 6) AS ex_rate,
        ROUND((n_right / n::DOUBLE + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(n_right / n::DOUBLE * (1 - n_right / n::DOUBLE) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS ex_low,
        ROUND((n_right / n::DOUBLE + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(n_right / n::DOUBLE * (1 - n_right / n::DOUBLE) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS ex_high FROM s"""
)
def answer_summary(spark, sf_dir):
    """The block of rates that every report begins with, by system."""
    found = items.summary(scored_items(spark, sf_dir), ("system",))
    return found.select("system", "n", "n_valid", F.col("right").alias("n_right"), "ex_rate", "ex_low", "ex_high")


# ---- raw outputs under the contract ------------------------------------------------------------------------------------


@query(
    f"""WITH {RUNS_SQL}, o AS (SELECT system, item, d // 16 % 8 AS k, correct FROM preds)
        SELECT system, CASE k WHEN 0 THEN 'missing_citation' WHEN 1 THEN 'invalid_citation' WHEN 2 THEN 'unexpected_refusal' WHEN 3 THEN 'invalid_output' WHEN 4 THEN 'timeout' WHEN 5 THEN 'execution_error'
            ELSE CASE WHEN correct THEN 'none' WHEN item % 3 = 0 THEN 'wrong_result_missing_rows' WHEN item % 3 = 1 THEN 'wrong_result_extra_rows' ELSE 'wrong_result_mismatched_rows' END END AS error_class,
            COUNT(*) AS n FROM o GROUP BY ALL"""
)
def output_classes(spark, sf_dir):
    """Raw outputs that each event makes, in all the ways the contract knows, and what they are judged to be."""
    p = predictions(spark, sf_dir).withColumn("k", F.floor(F.col("d") / 16) % 8)
    k, item = F.col("k"), F.col("item").cast("string")
    cite = F.when(k == 0, "").when(k == 1, F.concat(F.lit(" [events:x"), item, F.lit("]"))).otherwise(F.concat(F.lit(" [events:"), item, F.lit("]")))
    raw = F.when(k == 2, F.concat(F.lit("REFUSAL: nothing about "), item)).when(k == 3, F.concat(F.lit("It may be "), item))
    raw = raw.otherwise(F.concat(F.lit("SQL:\nSELECT value FROM events WHERE event_id = "), item, F.lit("\nANSWER:\nit is so"), cite))
    rows = p.select(
        "system", raw.alias("raw"), F.array(F.concat(F.lit("events:"), item)).alias("valid_rows"), F.when(k == 4, "QueryTimeout").when(k == 5, "ParseException").alias("error"),
        F.when(F.col("correct"), "a").otherwise("b").alias("pred_hash"), F.lit("a").alias("gold_hash"), F.lit(5).alias("gold_rows"), (F.lit(5) + F.when(F.col("item") % 3 == 0, -1).when(F.col("item") % 3 == 1, 1).otherwise(0)).alias("pred_rows"),
    )
    return scoring.score(rows).groupBy("system", F.coalesce("error_class", F.lit("none")).alias("error_class")).agg(F.count(F.lit(1)).alias("n"))
