"""Databases from text, prediction files, splits, and the driver-side session parts."""

import csv
import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tallyglass.operators import agent
from tallyglass.sources import predictions, synthetic


def test_database_from_text(spark):
    text = """CREATE TABLE t (a INTEGER, b TEXT, c DECIMAL(10,2), PRIMARY KEY (a)); CREATE TABLE e (x TEXT, d DATE, n REAL);
    INSERT INTO t VALUES (1, 'it''s; fine', 2.50), (2, NULL, 3); INSERT INTO t (a) VALUES (3); nonsense here; INSERT INTO t VALUES (1, 2)"""
    tables = synthetic.database(spark, text)
    assert sorted((r.a, r.b, None if r.c is None else float(r.c)) for r in tables["t"].collect()) == [(1, "it's; fine", 2.5), (2, None, 3.0), (3, None, None)]
    full = synthetic.filled(spark, tables, "SELECT 1 FROM e WHERE x = 'needle'")
    assert full["e"].count() == synthetic.ROWS and full["e"].where("x = 'needle'").count() > 0 and full["t"].count() == 3
    assert full["e"].collect() == synthetic.filled(spark, tables, "SELECT 1 FROM e WHERE x = 'needle'")["e"].collect()


def test_prediction_names_and_values(spark, tmp_path):
    (tmp_path / "sys__gretel.csv").write_text('Index,Gold,Prediction,"Exact Match",EX\n0,SELECT 1,SELECT 1,Yes,1\n1,SELECT 2,SELECT 3,no,\n')
    (tmp_path / "other.json").write_text(json.dumps([{"id": 0, "reference": "a", "output": "b", "is_valid": True}]))
    got = {(r.system, r["set"], r.idx): r for r in predictions.read_predictions(spark, [str(tmp_path / "sys__gretel.csv"), str(tmp_path / "other.json")]).collect()}
    assert got["sys", "gretel", "0"].exact is True and got["sys", "gretel", "1"].executed is None and got["other", "in_dist", "0"].pred_sql == "b"
    r = spark.range(1).select(*[predictions.ratio(F.lit(x)).alias(f"r{i}") for i, x in enumerate(("87.5 %", "87.5", "0.875", "x"))]).first()
    assert tuple(r) == (0.875, 0.875, 0.875, None)


def test_one_run_in_three_formats_gives_equal_rows(spark, tmp_path):
    rows = [("0", "SELECT a | b FROM t", "SELECT a\nFROM t", "yes", None), ("1", "SELECT 'x'", None, "no", "0"), ("2", "SELECT 2", "SELECT 3", "TRUE", "1")]
    head = ("Index", "gold sql", "Generated-SQL", "valid_sql", "exec match")
    (tmp_path / "sys__dev.json").write_text(json.dumps([{h: v for h, v in zip(head, r, strict=True) if v is not None} for r in rows]))
    with open(tmp_path / "sys__dev.csv", "w", newline="") as f:
        csv.writer(f).writerows([head, *[["" if v is None else v for v in r] for r in rows]])
    cell = lambda v: "" if v is None else v.replace("|", "\\|").replace("\n", "<br/>")
    table = "\n".join([f"| {' | '.join(head)} |", "|" + "---|" * 5, *[f"| {' | '.join(map(cell, r))} |" for r in rows]])
    (tmp_path / "sys__dev.md").write_text(f"# Run\n\n| metric | value |\n|-|-|\n| ex | 1 |\n\nPredictions:\n\n{table}\n\nEnd | of | it.\n")
    key = lambda r: r.idx
    found = [sorted(predictions.read_predictions(spark, [str(tmp_path / f"sys__dev.{e}")]).collect(), key=key) for e in ("json", "csv", "md")]
    assert found[0] == found[1] == found[2] and len(found[0]) == 3
    r = found[0][0]
    assert (r.system, r["set"], r.gold_sql, r.pred_sql, r.valid, r.executed) == ("sys", "dev", "SELECT a | b FROM t", "SELECT a\nFROM t", True, None)
    assert predictions.read_predictions(spark, [str(tmp_path / f"sys__dev.{e}") for e in ("json", "csv", "md")]).count() == 9


def test_resolution_split_and_mix(spark):
    items = spark.createDataFrame([("s", str(i)) for i in range(3)], "set string, idx string")
    assert predictions.resolved(items, items.limit(2).withColumn("p", F.lit(1))).count() == 2
    with pytest.raises(ValueError, match="without items"):
        predictions.resolved(items.limit(1), items.withColumn("p", F.lit(1)))
    rows = spark.createDataFrame([(f"Question {i % 30}",) for i in range(40)], "question string")
    test, train = predictions.carved(rows, 10)
    assert test.count() == 10 and predictions.overlap(train, test) == 0.0 and predictions.overlap(rows, test) == 100.0
    mix = predictions.mixed({"a": rows, "b": rows}, {"b": lambda d: d.where("question LIKE '%1%'")}, {"a": 5, "b": 3})
    assert {(r.source, r.n) for r in mix.groupBy("source").agg(F.count("*").alias("n")).collect()} == {("a", 5), ("b", 3)}


def test_intents_and_diagnosis(spark):
    asked = {
        ":help": "COMMAND", " Quit ": "COMMAND", "Hello!": "CONVERSATIONAL", "what can you do?": "CONVERSATIONAL", "What time is it": "REALTIME_SYS", "is it today's date": "REALTIME_SYS",
        "list tables please": "DB_META", "how many tables are there": "DB_META", "top five customers": "DB_QUERY", "how many of them": "DB_QUERY", "rows of lineitem": "DB_QUERY",
        "why is the sky blue": "CONVERSATIONAL", "": "CONVERSATIONAL", "gold?": "DB_QUERY", "q": "COMMAND", "who spent most": "DB_QUERY", "golden": "CONVERSATIONAL",
    }
    got = [r.i for r in spark.createDataFrame([(a,) for a in asked], "q string").select(agent.intent(F.col("q"), ["Lineitem"]).alias("i")).collect()]
    assert got == list(asked.values())
    found = agent.diagnose("[UNRESOLVED_COLUMN] A column with name `statu` cannot be resolved", ["status", "state", "price"])
    assert (found.kind, found.name, found.suggestions[0]) == ("unknown_column", "statu", "status")


def test_repair_and_state():
    answers = iter(["still bad", "good"])
    run = lambda sql: SimpleNamespace(success=sql == "good", error=f"syntax error near '{sql}'")
    repair = agent.Repair("q")
    assert repair.run("bad", run, lambda p: next(answers)).success and repair.repaired and len(repair.attempts) == 2
    assert not agent.Repair("q", most=1).run("bad", run, lambda p: "bad").success
    state = agent.Dialogue()
    state.record("q", "SELECT * FROM Orders JOIN items ON 1 = 1", [("shipped", 1), ("x", 2)])
    assert agent.Dialogue.load(state.dump()) == state and state.tables == {"orders", "items"} and state.entities == ["shipped"]
    events = agent.Events(listeners=[lambda e: 1 / 0])
    events.emit("sql", latency_ms=2.0)
    events.emit("sql", latency_ms=4.0)
    assert events.latency() == {"sql": 3.0}


def test_repair_stats(spark):
    r = agent.repair_stats(spark.createDataFrame([(0, False), (2, True), (3, False)], "attempts int, repaired boolean")).first()
    assert tuple(r) == (3, 2, 1, 0.5)
