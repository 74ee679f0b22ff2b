"""Systems asked, scored and reported; databases in files; guards on text."""

import json
import re
import sqlite3

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass import cli
from tallyglass.operators import evaluate, guard, memory, profile, report, retrieval, shadow, validation
from tallyglass.sources import catalog, embedded, files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def shop(spark):
    orders = spark.createDataFrame([("o01", "shipped"), ("o02", "delivered"), ("o03", "shipped")], "order_id string, status string")
    tables = {"orders": orders}
    return tables, catalog.load_catalog(tables, {"orders": ["order_id"]}), shadow.session_of(spark, tables)


def systems():
    """Callables that travel to the executors by value."""

    def perfect(prompt, seed):
        if "QUESTION: status of o01" in prompt:
            return "SQL:\nSELECT order_id, status FROM orders WHERE order_id = 'o01'\nANSWER:\nshipped [orders:o01]"
        return "SQL:\nSELECT COUNT(*) FROM orders WHERE status = 'shipped'\nANSWER:\ntwo [orders:o01] [orders:o03]"

    def moody(prompt, seed):
        return perfect(prompt, seed) if seed % 2 else "REFUSAL: not today"

    def failing(prompt, seed):
        raise RuntimeError("no answer")

    return [evaluate.System("perfect", "candidate", perfect), evaluate.System("moody", "reference", moody), evaluate.System("failing", "baseline", failing, "none", 2)]


def test_loop_from_prompts_to_report(spark, shop, tmp_path):
    tables, found, session = shop
    asked = [("a", "status of o01", "SELECT order_id, status FROM orders WHERE order_id = 'o01'"), ("b", "how many shipped", "SELECT COUNT(*) FROM orders WHERE status = 'shipped'")]
    rows = [(i, q, (e := validation.expected_rows(session, sql))["sha256"], e["n_rows"]) for i, q, sql in asked]
    questions = spark.createDataFrame(rows, "question_id string, question string, sha256 string, n_rows long").select("question_id", "question", F.struct("sha256", "n_rows").alias("expected_rows"))
    docs = retrieval.index_docs(tables, found)
    every = questions.select("question_id").join(docs.select("table_name", "row_id")).withColumn("rank", F.lit(1))
    packs = retrieval.packs(questions.select("question_id", "question"), every, docs, found.ddl_sha256())
    seeds = {(r.question_id, r.run): (r.seed, r.kind) for r in evaluate.matrix(questions).collect()}
    assert seeds["a", -1] == (999, "headline") and seeds["a", 4] == (1004, "consistency") and seeds["b", -1] == (1009, "headline") and len(seeds) == 12
    out = str(tmp_path / "run")
    by = {s["system"]: s for s in evaluate.evaluate(spark, session, systems(), questions, packs, found.ddl(), out)}
    good, mixed, bad = by["perfect"], by["moody"], by["failing"]
    assert (good["ex_heldout"], good["agreement"], good["flip_rate"], good["n_failures"], good["role"]) == (1.0, 1.0, 0.0, 0, "candidate")
    assert (mixed["ex_heldout"], mixed["refusal_rate"], mixed["flip_rate"], mixed["agreement"]) == (1.0, 0.0, 1.0, 0.6)
    assert (bad["ex_heldout"], bad["n_failures"], bad["hardware"]) == (0.0, 2, "none")
    raw = spark.read.json(f"{out}/raw/system=failing")
    assert raw.count() == 2 * 3 and set(raw.columns) >= {"question_id", "kind", "seed"}
    text, failures = report.report_run(spark, out, "shop")
    assert "Gate: perfect passes against moody." in text and "perfect against failing: 2 only perfect, 0 only failing, exact p = 0.5000" in text
    assert failures == {"perfect": 0, "moody": 0, "failing": 2}
    pages = spark.read.text(f"{out}/failures")
    assert pages.where("value LIKE '%# a%'").count() == 1 and "invalid_output" in {r.error_class for r in pages.select("error_class").distinct().collect()}
    with pytest.raises(FileNotFoundError):
        report.report_run(spark, str(tmp_path / "nothing"), "shop")


def test_seeds_fold_and_the_fallback_row(spark, tmp_path):
    def run(name, systems_):
        for s, role, right, flip in systems_:
            path = str(tmp_path / "series" / name)
            scored = [(f"q{i}", "headline", -1, i < right, None if i < right else "execution_error", "r", "s") for i in range(10)]
            spark.createDataFrame(scored, "question_id string, kind string, run int, correct boolean, error_class string, reason string, pred_sql string").write.parquet(f"{path}/scored/system={s}")
            row = (s, role, "", 10, right / 10, 0.0, 1.0, flip, 5.0, 10 - right, f"2026-01-0{name[-1]}T00:00:00")
            spark.createDataFrame([row], report.SUMMARY).write.mode("append").json(f"{path}/summary")

    run("s1", [("seed1", "candidate_seed", 4, 0.1), ("ref", "reference", 2, 0.5)])
    run("s2", [("seed2", "candidate_seed", 5, 0.1), ("ref", "reference", 7, 0.0), ("local", "onprem", 6, 0.2)])
    run("s3", [("seed3", "candidate_seed", 6, 0.1)])
    text, failures = report.report_run(spark, str(tmp_path / "series"), "toy")
    assert "candidate (mean of 3 seeds) | candidate | 10 | 0.500" in text and "Gate: candidate (mean of 3 seeds) does not pass against ref." in text
    assert "Fallback: local: EX 0.600, flips 0.200 against ref: EX 0.700, flips 0.000." in text
    assert text.count("exact p") == 3 and "seed2 against ref: 0 only seed2, 2 only ref" in text and failures["ref"] == 3


def test_command_line_from_questions_to_report(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "lazy_model.py").write_text("def call(prompt, seed):\n    return 'REFUSAL: no'\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "lazy_model.py"))
    (tmp_path / "systems.json").write_text(json.dumps([{"name": "lazy", "role": "baseline", "call": "lazy_model:call", "runs": 2}, {"name": "lazier", "role": "reference", "call": "lazy_model:call", "runs": 1}]))
    args = ["--data", SF, "--n", "8", "--out", str(tmp_path / "all"), "--systems", str(tmp_path / "systems.json"), "--tables", "nation,region", "--seed", "4"]
    assert cli.main(["all", *args, "--split", "train_ok"], spark) == 0
    said = capsys.readouterr().out
    assert "| lazy | baseline |" in said and (tmp_path / "all" / "run" / "report.md").read_text().startswith("# sf0.001")
    assert cli.main(["report", "--data", SF, "--run", str(tmp_path)], spark) == 2
    again = ["eval", "--data", SF, "--questions", str(tmp_path / "all" / "questions.jsonl"), "--packs", str(tmp_path / "all" / "packs"), "--out", str(tmp_path / "again"), "--systems", str(tmp_path / "systems.json")]
    assert cli.main([*again, "--split", "nothing"], spark) == 2 and cli.main([*again, "--split", "train_ok", "--roles", "onprem"], spark) == 2


def test_command_line_on_a_dataset_of_its_own(spark, tmp_path, capsys):
    (tmp_path / "orders.csv").write_text("order_id,customer,status,ts\n" + "".join(f"o{i},c{i % 2},{'late' if i % 3 else 'paid'},2020-{1 + i % 12:02d}-05 10:00:00\n" for i in range(24)))
    (tmp_path / "items.csv").write_text("order_id,n,price\no1,1,2.5\no1,2,3.5\nzz,1,1\n")
    config = {
        "tables": {"orders": str(tmp_path / "orders.csv"), "items": [str(tmp_path / "items.csv")]},
        "columns": {"orders": {"order_id": "TEXT", "customer": "TEXT", "status": "TEXT", "ts": "TIMESTAMP"}, "items": {"order_id": "TEXT", "n": "INTEGER", "price": "REAL"}},
        "primary_keys": {"orders": ["order_id"], "items": ["order_id"]}, "foreign_keys": ["items.order_id -> orders.order_id"], "indexes": {"items": [["price"]]}, "holdout": ["orders", "ts", 3],
    }
    (tmp_path / "config.json").write_text(json.dumps(config))
    data = str(tmp_path / "data")
    assert cli.main(["ingest", "--data", data, "--config", str(tmp_path / "config.json")], spark) == 0
    said = json.loads(capsys.readouterr().out)
    assert said["rows"] == {"orders": 24, "items": 3} and said["repeated_keys"] == {"orders": 0, "items": 1} and said["orphans"] == {"items.order_id->orders.order_id": 3 - 2} and said["cutoff"] == "2020-09-01"
    assert cli.main(["author", "--data", data, "--n", "4", "--out", str(tmp_path / "q.jsonl")], spark) == 0
    assert cli.main(["validate", "--data", data, "--questions", str(tmp_path / "q.jsonl")], spark) == 0
    assert cli.main(["retrieve", "--data", data, "--questions", str(tmp_path / "q.jsonl"), "--out", str(tmp_path / "packs")], spark) == 0
    assert cli._catalog(spark, data)[1].indexes == {"idx_items_price": ("items", ("price",))}
    files.put(spark.range(3), f"sqlite:////{str(tmp_path).lstrip('/')}/o.db", "t", ["id"])
    files.put(spark.range(3), f"csv://{tmp_path}", "t")
    assert files.connect(spark, f"sqlite:////{str(tmp_path).lstrip('/')}/o.db", "t").count() == files.connect(spark, f"csv://{tmp_path}", "t").count() == 3
    assert catalog.from_ddl("CREATE TABLE a (x INTEGER, y TEXT, PRIMARY KEY (x)); CREATE VIEW v AS SELECT 1").names() == ["a", "v"]


# ---- databases in files ---------------------------------------------------------------------------------------------


def test_sqlite_tables_go_in_and_out(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "a b.db")
    df = spark.createDataFrame([(i, f"n{i}" if i % 3 else None, i / 4) for i in range(1, 26)], "id long, name string, x double")
    assert embedded.write_sqlite(df, path, "t", ["id"], [["name"], ["name", "x"]]) == 25
    monkeypatch.setattr(embedded, "PARTITION", 10)
    found = files.connect(spark, f"sqlite:////{path.lstrip('/')}", "t")
    assert found.dtypes == [("id", "bigint"), ("name", "string"), ("x", "double")] and sorted(map(tuple, found.collect())) == sorted(map(tuple, df.collect()))
    assert embedded.sqlite_tables(path) == ["t"] and embedded.sqlite_keys(path, "t") == ["id"]
    with sqlite3.connect(path) as c:
        assert {r[0] for r in c.execute("SELECT name FROM sqlite_master WHERE type = 'index' AND name LIKE 'idx%'")} == {"idx_t_name", "idx_t_name_x"}
        c.execute("CREATE TABLE odd (a INTEGER, b TEXT, c NUMERIC, d)")
        c.execute("INSERT INTO odd VALUES ('words', 5, '1.5', NULL), (7, NULL, 'x', 'y')")
    assert sorted(map(tuple, embedded.read(spark, "sqlite", path, "odd").collect()), key=str) == sorted([(None, "5", 1.5, None), (7, None, None, "y")], key=str)
    with pytest.raises(Exception, match="no table"):
        embedded.read(spark, "sqlite", path, "nothing").collect()
    with pytest.raises(ValueError, match="no connector"):
        files.connect(spark, "oracle://x", "t")


def test_a_failed_transaction_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "t.db")
    embedded.write_sqlite(spark.range(3), path, "t")
    with pytest.raises(RuntimeError), embedded.transaction(path) as c:
        c.execute("DELETE FROM t")
        raise RuntimeError
    assert embedded.read(spark, "sqlite", path, "t").count() == 3
    with pytest.raises(Exception, match="UNIQUE"):
        embedded.write_sqlite(spark.createDataFrame([(1,), (1,)], "id long"), path, "t", ["id"])
    assert embedded.read(spark, "sqlite", path, "t").count() == 3


def test_duckdb_tables_are_read(spark, tmp_path):
    path = str(tmp_path / "d.duckdb")
    with duckdb.connect(path) as c:
        c.execute("CREATE TABLE t AS SELECT i AS id, 'n' || i AS name, i / 2.0::DOUBLE AS x, TIMESTAMP '2020-01-01' + INTERVAL 1 DAY * i AS at FROM range(30) r(i)")
    found = files.connect(spark, f"duckdb:////{path.lstrip('/')}", "t")
    assert found.count() == 30 and found.agg(F.sum("x").alias("s")).first().s == 217.5 and found.where("name = 'n7'").first().id == 7


def test_replaced_tables_are_whole_or_as_they_were(spark, tmp_path):
    path = str(tmp_path / "table")
    files.replaced(spark.range(5), path)
    files.replaced(spark.read.parquet(path).where("id > 1"), path)  # reads what it replaces
    assert spark.read.parquet(path).count() == 3
    boom = F.when(F.col("id") > 3, F.raise_error(F.lit("boom"))).otherwise(F.col("id"))
    with pytest.raises(Exception, match="boom"):
        files.replaced(spark.read.parquet(path).select(boom.alias("id")), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [2, 3, 4] and sorted(p.name for p in tmp_path.iterdir()) == ["table"]


def test_items_dumps_and_question_errors(spark, tmp_path):
    item = {"question": "q", "schema": "s", "gold_sql": "SELECT 1"}
    (tmp_path / "by_set.json").write_text(json.dumps({"a": [item, item], "b": [item]}))
    (tmp_path / "flat.json").write_text(json.dumps([item, item | {"set": "b"}, item]))
    got = lambda name: sorted((r["set"], r.idx) for r in files.read_items(spark, str(tmp_path / name)).collect())
    assert got("by_set.json") == [("a", 0), ("a", 1), ("b", 0)] and got("flat.json") == [("b", 0), ("in_dist", 0), ("in_dist", 1)]
    full = {"id": "1", "question": "q", "gold_sql": "SELECT 1", "expected_rows": {"sha256": "x", "n_rows": 1}, "date": "", "difficulty": "easy", "category": "aggregation", "split": "train_ok", "source": "human"}
    (tmp_path / "q.jsonl").write_text("\n".join(["", json.dumps(full), json.dumps({k: v for k, v in full.items() if k != "split"})]))
    with pytest.raises(files.InvalidQuestion, match=r"q\.jsonl:3: lacks split"):
        files.read_questions(spark, str(tmp_path / "q.jsonl"))
    files.write_benchmark_csv(spark.createDataFrame([(1, 'a "b", c')], "item int, sql string"), str(tmp_path / "csv"))
    assert spark.read.options(header=True, escape='"').csv(str(tmp_path / "csv")).first().sql == 'a "b", c'


def test_latest_summary_by_time(spark, tmp_path):
    for name, at, ex in (("z", "2026-01-01", 0.1), ("a", "2026-02-01", 0.9)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"system": "s", "role": "r", "ex": ex, "generated_at": at}))
    schema = T.StructType.fromDDL("system string, role string, ex double, generated_at string")
    assert [r.ex for r in files.latest_summaries(spark, [str(tmp_path / "z.json"), str(tmp_path / "a.json")], schema).collect()] == [0.9]


def test_gaps_sparse_ids_and_tables_without_row_numbers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "gaps.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE far (id INTEGER PRIMARY KEY, x TEXT)")
        c.executemany("INSERT INTO far VALUES (?, ?)", [(1, "a"), (-7, "b"), (10**12, "c"), (2**62, "d")])
        c.execute("CREATE TABLE keyed (k TEXT PRIMARY KEY, x INTEGER) WITHOUT ROWID")
        c.executemany("INSERT INTO keyed VALUES (?, ?)", [(f"k{i}", i) for i in range(50)])
        c.execute("CREATE TABLE named (rowid TEXT, x INTEGER)")
        c.execute("INSERT INTO named VALUES ('own', 1)")
        c.execute("CREATE VIEW seen AS SELECT * FROM keyed")
        c.execute("CREATE TABLE none (x INTEGER)")
    for table, n in (("far", 4), ("keyed", 50), ("named", 1), ("seen", 50), ("none", 0)):
        df = embedded.read(spark, "sqlite", path, table)
        assert df.count() == n and df.rdd.getNumPartitions() <= 1
    monkeypatch.setattr(embedded, "PARTITION", 1)
    reader = embedded.SqliteReader(path, "far", embedded.sqlite_schema(path, "far"))
    parts = reader.partitions()
    assert len(parts) == 4 and sorted(r["x"] for p in parts for b in reader.read(p) for r in b.to_pylist()) == ["a", "b", "c", "d"]
    monkeypatch.undo()
    path = str(tmp_path / "gaps.duckdb")
    with duckdb.connect(path) as c:
        c.execute("CREATE TABLE t AS SELECT range AS x FROM range(300000)")
        c.execute("DELETE FROM t WHERE x < 150000")
        c.execute("CREATE TABLE none (x INTEGER)")
    assert embedded.read(spark, "duckdb", path, "t").agg(F.count("x"), F.min("x")).first() == (150_000, 150_000)
    assert embedded.read(spark, "duckdb", path, "none").count() == 0


def test_a_killed_run_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    """A task that dies takes the job with it, but not what other tasks have asked; a statement is executed once."""
    monkeypatch.setattr(evaluate, "ASKED_TOGETHER", 4)
    asked = spark.range(64).select(F.col("id").cast("string").alias("question_id"), F.lit("headline").alias("kind"), F.lit(-1).alias("run"), F.lit(1).alias("seed"), F.concat(F.lit("p"), "id").alias("prompt"))
    log, broken, path = str(tmp_path / "asked"), str(tmp_path / "broken"), str(tmp_path / "raw")
    open(broken, "w").close()

    def model(prompt, seed):
        import os
        import time

        if prompt == "p7" and os.path.exists(broken):
            time.sleep(2)
            raise SystemExit("the worker is lost")
        with open(log, "a") as f:
            f.write(prompt + "\n")
        return "SQL:\nSELECT 1\nANSWER:\n" + prompt

    with pytest.raises(Exception):  # noqa: B017
        evaluate.outputs(asked, model, path, resume=True)
    first = open(log).read().split()
    kept = spark.read.schema(evaluate.RAW).json(path).count()
    assert 0 < kept <= len(first) < 64
    (tmp_path / "broken").unlink()
    made = evaluate.outputs(asked, model, path, resume=True)
    assert made.count() == made.select("question_id").distinct().count() == 64
    again = open(log).read().split()[len(first) :]
    assert len(again) == 64 - kept  # what was kept is not asked again
    assert evaluate.outputs(asked, model, path, resume=True).count() == 64 and len(open(log).read().split()) == len(first) + len(again)

    ran, real = [], guard.safe_execute
    monkeypatch.setattr(guard, "safe_execute", lambda s, sql, **k: ran.append(sql) or real(s, sql, **k))
    monkeypatch.setattr(evaluate, "PIECE", 3)
    answers = [("q", f"SELECT {i} AS x") for i in range(7)] + [("r", "SELEC")]
    where = str(tmp_path / "executed")
    evaluate.executed(spark, answers[:5], str, where, resume=True)
    found = {(r.question_id, r.sql): r for r in evaluate.executed(spark, answers, str, where, resume=True).collect()}
    assert sorted(ran) == sorted(sql for _, sql in answers) and len(found) == 8
    assert found["q", "SELECT 6 AS x"].pred_rows == 1 and found["r", "SELEC"].error and found["r", "SELEC"].pred_hash is None


# ---- memory, profile, guard -----------------------------------------------------------------------------------------


def test_store_of_turns_and_experience(spark, tmp_path):
    memory.init_store(spark, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m" / "turns")).count() == 0
    turns = spark.createDataFrame([("s1", "d", True), ("s1", "d", None), ("s2", "e", False)], "session string, db string, repaired boolean")
    assert {(r.db, r.n_turns, r.n_sessions, r.n_repaired) for r in memory.store_stats(turns).collect()} == {("d", 2, 1, 1), ("e", 1, 1, 0), (None, 3, 2, 1)}
    left, gone = memory.cleared(turns, "s1")
    assert gone == 2 and [r.session for r in left.collect()] == ["s2"] and memory.cleared(turns)[1] == 3 and memory.cleared(turns)[0].isEmpty()
    store = spark.sql("SELECT 'd' AS db, 'q' AS question, 'old' AS sql, 2L AS frequency, TIMESTAMP_NTZ '2020-01-01 00:00:00' AS at")
    memory.export_experience(store.withColumn("sql", F.lit("new")).withColumn("at", F.expr("at + INTERVAL 1 DAY")), str(tmp_path / "x"))
    r = memory.import_experience(store, str(tmp_path / "x")).first()
    assert (r.sql, r.frequency) == ("new", 4)


def test_few_valued_columns_survive_the_sketch(spark):
    df = spark.range(5000).select(F.concat(F.lit("v"), F.col("id") % 60).alias("few"), F.concat(F.lit("v"), F.col("id") % 61).alias("more"), F.col("id").cast("string").alias("many"))
    assert {r.column_name for r in profile.categoricals({"t": df}).collect()} == {"few"} and profile.few_valued({"t": df}, 60)["t"].columns == ["few", "more"]
    sample = [r.value for r in profile.value_sample(df, "many", 25).collect()]
    assert len(set(sample)) == 25 and sample == [r.value for r in profile.value_sample(df.repartition(5), "many", 25).collect()]
    assert profile.preview(df, 2).count() == 2


@pytest.mark.parametrize(
    "sql",
    ["SELECT `reflect`('java.lang.System', 'getProperty', 'java.version')", "SELECT max(`java_method`('a', 'b')) FROM orders", "SELECT (SELECT reflect('a', 'b'))", "SELECT input_file_name() FROM orders", "WITH x AS (SELECT current_user() u) SELECT * FROM x", "SELECT `system`.`builtin`.`reflect`('a', 'b')", "SELECT * FROM orders ORDER BY `uuid`()", "SELECT transform(array(1), x -> raise_error('a'))", "SELECT x FROM orders LATERAL VIEW java_method('a', 'b') t AS x"],
)
def test_functions_beyond_the_data_are_refused_however_written(spark, sql):
    assert not guard.is_safe(spark, sql, ["orders"])


@pytest.mark.parametrize(
    "sql",
    ["SELECT upper(status), count(*), coalesce(order_id, 'x') FROM orders GROUP BY ALL", "SELECT x FROM orders LATERAL VIEW explode(array(1, 2)) t AS x", "SELECT date_trunc('month', current_date()), row_number() OVER (ORDER BY order_id) FROM orders", "SELECT transform(array(1), x -> x + 1), CAST('1' AS INT), 'reflect(1)' FROM orders WHERE status LIKE 'a%' AND status IN ('a')"],
)
def test_functions_on_the_data_are_allowed(spark, sql):
    assert guard.is_safe(spark, sql, ["orders"])


@pytest.mark.parametrize(
    "sql",
    ["SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'java.version')", "SELECT IDENTIFIER('re' || 'flect')('a', 'b') FROM orders", "SELECT * FROM IDENTIFIER('orders')", "SELECT current_user", "SELECT `current_user`, status FROM orders", "SELECT user FROM orders", "SELECT :name", "SELECT ?", "SELECT my_udf(1)", "SELECT upper(status) FROM orders WHERE lower(status) = session_user", "SELECT * FROM range(5)", "SELECT * FROM VALUES (uuid()) t(x)", "WITH c AS (SELECT current_user AS u) SELECT u FROM c", "SELECT (SELECT current_user)", "SELECT xpath_string('<a/>', 'a')", "SELECT try_reflect('a', 'b')", "SELECT transform(array(1), x -> version()) FROM orders", "SELECT spark_partition_id() FROM orders"],
)
def test_names_that_lead_elsewhere_are_refused(spark, sql):
    spark.udf.register("my_udf", lambda x: x)
    spark.sql("SELECT 'o1' AS order_id, 'x' AS status").createOrReplaceTempView("orders")
    assert not guard.is_safe(spark, sql, ["orders"])
    assert not guard.safe_execute(spark, sql).success


def test_variables_are_text_and_own_functions_cannot_be_replaced(spark):
    assert guard.execute(spark, "SELECT '${env:PATH}', '${system:user.home}'")[0] == [("${env:PATH}", "${system:user.home}")]
    other = spark.newSession()
    other.udf.register("soundex", lambda x: "mine")
    assert not guard.is_safe(other, "SELECT soundex('a')")
    assert guard.execute(spark, "SELECT soundex('Robert')")[0] == [("R163",)]


def test_tables_behind_python_may_be_read(spark):
    spark.range(3).select(F.udf(lambda x: f"v{x}")("id").alias("v")).createOrReplaceTempView("made")
    assert guard.execute(spark, "WITH a AS (SELECT v FROM made) SELECT max(v), (SELECT min(v) FROM a) FROM a WHERE v IN (SELECT v FROM made)")[0] == [("v2", "v0")]
    spark.catalog.dropTempView("made")


def test_every_example_of_an_allowed_function_is_allowed(spark):
    registry, refused, seen = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin(), [], 0
    allowed = guard._functions(spark._jvm)[0]
    for name in sorted(allowed):
        info = registry.lookupFunction(spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name)).get()
        for sql in re.findall(r"> (SELECT.*?);", str(info.getExamples()), re.S)[:1]:
            seen += 1
            if not guard.is_safe(spark, sql):
                refused.append((name, sql))
    assert seen > 400 and not refused


def test_verdicts_on_text_alone(spark):
    def verdicts(*texts):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", guard.text_verdicts(F.col("t")).alias("v")).collect()
        return [tuple(r.v) for r in sorted(rows)]

    good = ("SELECT 1", "with a as (select 1) select * from a;", "EXPLAIN SELECT 'drop table'", "select 1 -- ; delete", "select 1;; -- x", 'select "drop" from t', "/* drop */ select 'a;b'")
    assert verdicts(*good) == [(True, None)] * len(good)
    bad = {"PRAGMA journal_mode = wal": "PRAGMA", "  -- nothing": "empty", ";": "empty", "SELECT 1 /* ; */; x": "more than one", "dropped": "not SELECT", "SELECT 'a' ; update t": "UPDATE", "": "empty", "DROP TABLE t": "DROP", "SELECT 1; SELECT 2": "more than one", "PRAGMA x = 1": "PRAGMA", "PRAGMA table_info(t)": "not SELECT", "WITH a AS (SELECT 1) DELETE FROM t": "DELETE"}
    found = verdicts(*bad, None)
    assert all(not ok and why in reason for (ok, reason), why in zip(found, [*bad.values(), "empty"], strict=True)), found
    assert guard.names_system_table("select * from SQLITE_master") and not guard.names_system_table("select 1 from orders")
    rows, columns = guard.truncated(spark, "SELECT * FROM VALUES (1), (2), (3) AS t(x)", 2)
    assert len(rows) == 2 and columns == ["x"]
    found = catalog.Catalog().with_index("t", ["a", "b"]).with_index("t", ["a", "b"])
    assert found.indexes == {"idx_t_a_b": ("t", ("a", "b"))} and found.without(["t"]).indexes == {}
