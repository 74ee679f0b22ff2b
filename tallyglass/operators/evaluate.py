"""Evaluating systems on a question set: the matrix of runs, model calls, guarded execution, scores and summaries.

A system is a callable of (prompt, seed), or the name of one as `module:function`. Calls run on the executors; what they
return is written before anything reads it, so a model is asked once for each run, whatever is recomputed later.

A run that was killed goes on where it stopped: each task's outputs are kept as it ends, and each piece of executed statements as it is done;
what is there is not asked or executed again. Statements run side by side, each under the guard with a job group and timeout of its own.
"""

from __future__ import annotations

import datetime
import importlib
import json
import threading
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyglass.functions.canon import canonical_hash
from tallyglass.operators import guard, retrieval, scoring
from tallyglass.operators.corpus import SYSTEM
from tallyglass.session import hadoop

#: Runs of a question beside the headline, and the seed of the first run of the first question.
CONSISTENCY_RUNS = 5
FIRST_SEED = 1000
ROLES = ("baseline", "candidate", "candidate_seed", "onprem", "reference")


@dataclass(frozen=True)
class System:
    name: str
    role: str
    call: Callable[[str, int], str] | str
    hardware: str = ""
    runs: int = CONSISTENCY_RUNS


def systems_of(text: str) -> list[System]:
    """Systems of a JSON list of {name, role, call, hardware, runs}."""
    found = [System(**x) for x in json.loads(text)]
    if wrong := [s.name for s in found if s.role not in ROLES]:
        raise ValueError(f"unknown role of {wrong[0]}")
    return found


def matrix(questions: DataFrame, runs: int = CONSISTENCY_RUNS) -> DataFrame:
    """question_id, kind, run, seed: a headline (run -1) and `runs` consistency runs of each question.

    Question q, counted from 0 in the order of question_id, has the seeds 1000 + 10 q + run; the headline is the one below.
    """
    number = (F.row_number().over(Window.orderBy("question_id")) - 1).alias("q")  # a question set is small by its nature
    each = questions.select("question_id", number).withColumn("run", F.explode(F.sequence(F.lit(-1), F.lit(runs - 1))))
    kind = F.when(F.col("run") < 0, "headline").otherwise("consistency")
    return each.select("question_id", kind.alias("kind"), "run", (FIRST_SEED + 10 * F.col("q") + F.col("run")).cast("int").alias("seed"))


def prompts(packs: DataFrame, ddl: str) -> DataFrame:
    """question_id, prompt of each evidence pack, worded as the training triples are."""
    shown = F.transform("rows", lambda r: F.concat(F.lit("["), r["table_name"], F.lit(":"), r["row_id"], F.lit("] "), retrieval.cells_text(r["columns"], r["values"])))
    head = F.lit(f"{SYSTEM}\n\nSCHEMA:\n{ddl}\n\nQUESTION: ")
    return packs.select("question_id", F.concat(head, "question", F.lit("\n\nRETRIEVED EVIDENCE:\n"), F.array_join(shown, "\n")).alias("prompt"))


def ask(asked: DataFrame, call: Callable[[str, int], str] | str) -> DataFrame:
    """asked (question_id, kind, run, seed, prompt) with raw, latency_ms; what a call raises is an empty output."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if isinstance(call, str):
            module, _, name = call.partition(":")
            model = getattr(importlib.import_module(module), name)
        else:
            model = call
        for frame in frames:
            raws, times = [], []
            for prompt, seed in zip(frame["prompt"], frame["seed"], strict=True):
                began = time.perf_counter()
                try:
                    raws.append(str(model(prompt, int(seed))))
                except Exception:  # noqa: BLE001  (a system that fails has given no output)
                    raws.append("")
                times.append((time.perf_counter() - began) * 1000)
            yield frame.drop(columns=["prompt"]).assign(raw=raws, latency_ms=times)

    return asked.mapInPandas(run, RAW)


#: Calls of a task, statements that are run at once, and statements whose results are written together.
ASKED_TOGETHER, AT_ONCE, PIECE = 16, 8, 64
RAW = "question_id string, kind string, run int, seed int, raw string, latency_ms double"
EXECUTED = "question_id string, sql string, error string, pred_hash string, pred_rows long, db_exec_ms double"


def outputs(asked: DataFrame, call: Callable[[str, int], str] | str, path: str, resume: bool = False) -> DataFrame:
    """ask() written under `path` as JSON and read back; with `resume`, only what is not there yet is asked.

    A task's file is put in place when the task ends, so a job that dies leaves the files of the tasks that did not.
    """
    spark = asked.sparkSession
    left = asked
    if resume and exists(spark, path):
        left = asked.join(spark.read.schema(RAW).json(path).select("question_id", "kind", "run"), ["question_id", "kind", "run"], "left_anti")
    n = -(-left.count() // ASKED_TOGETHER)
    if n or not resume:
        dealt = left.repartition(max(1, n), "question_id", "kind", "run")
        ask(dealt, call).write.mode("append" if resume else "overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", "2").json(path)
    return spark.read.schema(RAW).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    system, where = hadoop(spark, path)
    return bool(system.exists(where))


def executed(spark: SparkSession, answers: Sequence[tuple[str, str]], to_sql: Callable[[str], str], path: str | None = None, resume: bool = False, at_once: int = AT_ONCE, **limits) -> DataFrame:
    """question_id, sql, error, pred_hash, pred_rows, db_exec_ms of each (question, SQL), run once each under the guard, `at_once` at a time.

    Under `path` the results are written in pieces; with `resume` those that are there are not run again. Where the scheduler is
    fair, each statement is in a pool of its own.
    """

    def one(answer: tuple[str, str]) -> tuple:
        question, sql = answer
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"evaluation-{threading.get_ident()}")
        found = guard.safe_execute(spark, to_sql(sql), **limits)
        sha, n = canonical_hash(found.rows) if found.success else (None, None)
        return question, sql, found.error, sha, n, found.latency_ms

    left, out = list(answers), []
    if path and resume and exists(spark, path):
        out = [tuple(r) for r in spark.read.schema(EXECUTED).parquet(path).collect()]
        known = {r[:2] for r in out}
        left = [a for a in left if a not in known]
    elif path:
        spark.createDataFrame([], EXECUTED).write.mode("overwrite").parquet(path)
    with ThreadPoolExecutor(at_once) as pool:
        for at in range(0, len(left), PIECE):
            piece = list(pool.map(inheritable_thread_target(one), left[at : at + PIECE]))
            if path:
                spark.createDataFrame(piece, EXECUTED).coalesce(1).write.mode("append").parquet(path)
            out += piece
    return spark.createDataFrame(out, EXECUTED)


def run_system(spark: SparkSession, session: SparkSession, system: System, questions: DataFrame, packs: DataFrame, ddl: str, out: str, to_sql: Callable[[str], str] = str, resume: bool = False, **limits) -> DataFrame:
    """Ask, execute and score every run of a system; writes and returns the scored runs.

    questions: question_id, expected_rows (sha256, n_rows). packs: one a question. session: where the answers' SQL runs. The
    raw outputs are under `raw`, what was executed under `executed`, the scored runs under `scored`, a folder a system. One SQL text
    of a question runs once. With `resume` what an earlier run of this kind left under `out` is kept.
    """
    asked = matrix(questions, system.runs).join(prompts(packs, ddl), "question_id")
    made = outputs(asked, system.call, f"{out}/raw/system={system.name}", resume)
    answers = made.withColumn("sql", scoring.contract(F.col("raw"))["sql"])
    wanted = [(r.question_id, r.sql) for r in answers.where("sql IS NOT NULL").select("question_id", "sql").distinct().orderBy("question_id", "sql").collect()]
    results = spark.createDataFrame(executed(session, wanted, to_sql, f"{out}/executed/system={system.name}", resume, **limits).collect(), EXECUTED)
    gold = questions.select("question_id", F.col("expected_rows.sha256").alias("gold_hash"), F.col("expected_rows.n_rows").alias("gold_rows"))
    cited = packs.select("question_id", F.transform("rows", lambda r: F.concat_ws(":", r["table_name"], r["row_id"])).alias("valid_rows"))
    full = answers.join(results, ["question_id", "sql"], "left").join(gold, "question_id").join(cited, "question_id")
    scored = scoring.score(full).withColumn("reason", F.coalesce("error", "error_class")).withColumnRenamed("sql", "pred_sql")
    path = f"{out}/scored/system={system.name}"
    scored.select("question_id", "kind", "run", "seed", "correct", "error_class", "reason", "pred_sql", "pred_hash", "latency_ms", "db_exec_ms").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).withColumn("system", F.lit(system.name))


def summaries(scored: DataFrame, systems: Sequence[System]) -> DataFrame:
    """A row a system: system, role, hardware, n_questions, ex_heldout, refusal_rate, agreement, flip_rate, p50_latency_ms, n_failures, generated_at."""
    head = scoring.accuracy(scored.where("kind = 'headline'")).select(
        "system", "n_questions", F.col("ex").alias("ex_heldout"), "refusal_rate", "p50_latency_ms", (F.col("n_questions") - F.col("n_correct")).alias("n_failures")
    )
    held = scoring.consistency(scored.where("kind = 'consistency'")).groupBy("system").agg(F.round(F.avg("agreement"), 6).alias("agreement"), F.round(F.avg("flip"), 6).alias("flip_rate"))
    named = scored.sparkSession.createDataFrame([(s.name, s.role, s.hardware) for s in systems], "system string, role string, hardware string")
    now = F.lit(datetime.datetime.now().isoformat(timespec="seconds"))
    full = named.join(head, "system", "left").join(held, "system", "left").fillna(0).withColumn("generated_at", now)
    return full.select("system", "role", "hardware", "n_questions", "ex_heldout", "refusal_rate", "agreement", "flip_rate", "p50_latency_ms", "n_failures", "generated_at")


def evaluate(spark: SparkSession, session: SparkSession, systems: Sequence[System], questions: DataFrame, packs: DataFrame, ddl: str, out: str, to_sql: Callable[[str], str] = str, resume: bool = False, **limits) -> list[Mapping]:
    """Every system over every question; writes raw, scored and summary under `out` and returns the summaries."""
    scored = None
    for system in systems:
        one = run_system(spark, session, system, questions, packs, ddl, out, to_sql, resume, **limits)
        scored = one if scored is None else scored.unionByName(one)
    found = summaries(scored, systems)
    found.coalesce(1).write.mode("overwrite").json(f"{out}/summary")
    return [r.asDict() for r in spark.read.schema(found.schema).json(f"{out}/summary").collect()]
