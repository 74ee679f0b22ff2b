"""Scoring model outputs: the output contract, citations, the outcome of each answer, rates and consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the classes of a wrong answer.
ERROR_CLASSES = (
    "timeout", "execution_error", "invalid_output", "unexpected_refusal", "missing_citation", "invalid_citation",
    "wrong_result_missing_rows", "wrong_result_extra_rows", "wrong_result_mismatched_rows",
)
#: Fixed value: a citation, `[table:row_id]`.
CITATION = r"\[([A-Za-z_][A-Za-z0-9_]*):([^\]\s]+)\]"


def contract(raw: Column) -> Column:
    """kind (answer, refusal, invalid_output), sql, answer, refusal of a raw output."""
    text = F.trim(F.regexp_replace(raw, r"^\s+|\s+$", ""))
    body = F.regexp_replace(F.substring(text, 5, 1 << 30), r"^[ \t]*\r?\n", "")
    at = F.regexp_instr(body, F.lit(r"(?m)^\s*ANSWER:"))
    sql = F.regexp_replace(F.substring(body, F.lit(1), at - 1), r"^\s+|\s+$", "")
    answer = F.regexp_replace(F.regexp_replace(F.substring(body, at, F.lit(1 << 30)), r"^\s*ANSWER:", ""), r"^\s+|\s+$", "")
    refused, answered = text.startswith("REFUSAL:"), text.startswith("SQL:") & (at > 0)
    return F.struct(
        F.when(refused, "refusal").when(answered, "answer").otherwise("invalid_output").alias("kind"),
        F.when(answered & ~refused, sql).alias("sql"),
        F.when(answered & ~refused, answer).alias("answer"),
        F.when(refused, F.trim(F.substring(text, 9, 1 << 30))).alias("refusal"),
    )


def citations(answer: Column) -> Column:
    """The cited `table:row_id`s, in order."""
    return F.zip_with(F.regexp_extract_all(answer, F.lit(CITATION), 1), F.regexp_extract_all(answer, F.lit(CITATION), 2), lambda t, r: F.concat_ws(":", t, r))


def score(outputs: DataFrame) -> DataFrame:
    """outputs with `error_class` (null where correct) and `correct`.

    Needs raw, valid_rows (the pack's `table:row_id`s), error (null, or the name of what execution raised), pred_hash,
    pred_rows, gold_hash, gold_rows. What an output claims is judged before what its SQL returns.
    """
    parsed = outputs.withColumn("__p", contract(F.col("raw")))
    cited = F.coalesce(citations(F.col("__p.answer")), F.array().cast("array<string>"))
    wrong = F.col("pred_hash").isNull() | (F.col("pred_hash") != F.col("gold_hash"))
    found = (
        F.when(F.col("__p.kind") == "invalid_output", "invalid_output")
        .when(F.col("__p.kind") == "refusal", "unexpected_refusal")
        .when(F.size(cited) == 0, "missing_citation")
        .when(F.size(F.array_except(cited, F.col("valid_rows"))) > 0, "invalid_citation")
        .when(F.col("error").contains("Timeout"), "timeout")
        .when(F.col("error").isNotNull(), "execution_error")
        .when(wrong & (F.col("pred_rows") < F.col("gold_rows")), "wrong_result_missing_rows")
        .when(wrong & (F.col("pred_rows") > F.col("gold_rows")), "wrong_result_extra_rows")
        .when(wrong, "wrong_result_mismatched_rows")
    )
    return parsed.withColumn("error_class", found).withColumn("correct", F.col("error_class").isNull()).drop("__p")


def accuracy(results: DataFrame) -> DataFrame:
    """system, n_questions, n_correct, ex, refusal_rate, p50_latency_ms."""
    refused = F.avg((F.coalesce(F.col("error_class"), F.lit("")) == "unexpected_refusal").cast("double"))
    return results.groupBy("system").agg(
        F.count(F.lit(1)).alias("n_questions"),
        F.sum(F.col("correct").cast("long")).alias("n_correct"),
        F.round(F.avg(F.col("correct").cast("double")), 6).alias("ex"),
        F.round(refused, 6).alias("refusal_rate"),
        F.round(F.median("latency_ms"), 4).alias("p50_latency_ms"),
    )


def consistency(runs: DataFrame) -> DataFrame:
    """system, question_id, agreement, flip from (system, question_id, run, correct).

    Agreement is the share of runs with the majority's outcome, the first run's on a tie; flip the share of adjacent
    runs that differ, 0 with one run.
    """
    by_run = Window.partitionBy("system", "question_id").orderBy("run")
    lagged = runs.withColumn("before", F.lag("correct").over(by_run))
    right = F.sum(F.col("correct").cast("int"))
    found = lagged.groupBy("system", "question_id").agg(
        F.count(F.lit(1)).alias("n"),
        right.alias("right"),
        F.min_by("correct", "run").alias("first"),
        F.sum((F.col("before") != F.col("correct")).cast("int")).alias("flips"),
    )
    most = (F.col("right") * 2 > F.col("n")) | ((F.col("right") * 2 == F.col("n")) & F.col("first"))
    return found.select(
        "system",
        "question_id",
        F.round(F.when(most, F.col("right")).otherwise(F.col("n") - F.col("right")) / F.col("n"), 6).alias("agreement"),
        F.round(F.when(F.col("n") < 2, 0.0).otherwise(F.coalesce("flips", F.lit(0)) / (F.col("n") - 1)), 6).alias("flip"),
    )


def seed_fold(summaries: DataFrame) -> DataFrame:
    """role, mean_ex, least_ex, most_ex, flip, n_failures, representative (the middle seed by accuracy) over candidate seeds."""
    order = Window.partitionBy("role").orderBy("ex", "system")
    ranked = summaries.withColumn("at", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("role")))
    return ranked.groupBy("role").agg(
        F.round(F.avg("ex"), 6).alias("mean_ex"),
        F.min("ex").alias("least_ex"),
        F.max("ex").alias("most_ex"),
        F.round(F.avg("flip"), 6).alias("flip"),
        F.sum("n_failures").alias("n_failures"),
        F.max(F.when(F.col("at") == F.floor(F.col("n") / 2) + 1, F.col("system"))).alias("representative"),
    )


def gate(ex: float, ex_baseline: float, flip: float, flip_baseline: float, margin: float = 0.05) -> bool:
    """Passes within five points of the baseline's accuracy and at no more flips."""
    return ex >= ex_baseline - margin - 1e-12 and flip <= flip_baseline + 1e-12


def consensus(candidates: DataFrame) -> DataFrame:
    """question_id, sql, votes, ratio: the answer most candidates agree on.

    candidates: question_id, sql, error, result_hash, n_rows, latency_ms. Failures are dropped; clusters of equal
    results are ranked non-empty first, then by size, then by the least latency; of the winner the shortest SQL, then
    the fastest is taken. ratio is its share of the valid candidates.
    """
    valid = candidates.where(F.col("error").isNull())
    one = F.struct(F.length("sql").alias("size"), F.col("latency_ms").alias("ms"), F.col("sql").alias("sql"))
    clusters = valid.groupBy("question_id", "result_hash").agg(
        F.count(F.lit(1)).alias("votes"), F.max(F.col("n_rows") > 0).alias("some"), F.min("latency_ms").alias("fastest"), F.min(one).alias("best")
    )
    order = Window.partitionBy("question_id").orderBy(F.desc("some"), F.desc("votes"), "fastest", "result_hash")
    total = F.sum("votes").over(Window.partitionBy("question_id"))
    return clusters.withColumn("total", total).withColumn("r", F.row_number().over(order)).where("r = 1").select("question_id", F.col("best.sql").alias("sql"), "votes", F.round(F.col("votes") / F.col("total"), 6).alias("ratio"))
