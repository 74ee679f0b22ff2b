"""Catalog, guard, canonical hash, shadow, retrieval, triples, scoring, statistics, authoring, CLI on a toy database."""

import datetime
import decimal
import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyglass import cli
from tallyglass.functions import canon, sqltext
from tallyglass.operators import corpus, guard, memory, profile, report, retrieval, scoring, shadow, stats, validation
from tallyglass.plans import authoring, evaluation, gold
from tallyglass.sources import catalog as cat
from tallyglass.sources import files
from tallyglass.streaming import commits

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def toy(spark):
    when = [f"2018-{m:02d}-{d:02d} 09:00:00" for m, d in ((1, 5), (1, 20), (2, 3), (2, 10), (2, 11), (2, 25), (2, 28), (3, 1), (4, 9), (6, 2), (8, 30), (9, 17))]
    status = ["delivered"] * 9 + ["shipped"] * 2 + ["canceled"]
    orders = spark.createDataFrame([(f"o{i:02d}", f"c{i % 5}", s, datetime.datetime.fromisoformat(w)) for i, (s, w) in enumerate(zip(status, when, strict=True), 1)], "order_id string, customer_id string, status string, ts timestamp_ntz")
    items = spark.createDataFrame([(f"o{min(i, 12):02d}", 1 + (i == 13), f"p{i % 3}", 10.0 * i) for i in range(1, 14)], "order_id string, item int, product_id string, price double")
    return {"orders": orders, "order_items": items}


KEYS = (cat.ForeignKey("order_items", "order_id", "orders", "order_id"),)


@pytest.fixture(scope="module")
def toy_catalog(toy):
    return cat.load_catalog(toy, {"orders": ["order_id"], "order_items": ["order_id", "item"]}, KEYS)


# ---- canonical form -------------------------------------------------------------------------------------------------


def test_hash_ignores_row_order_case_and_form():
    assert canon.canonical_hash([(1, "Ab  c"), (2, None)]) == canon.canonical_hash([(2, None), (1, "aB c")])
    assert canon.canonical_hash([("é",)]) == canon.canonical_hash([("é",)])
    assert canon.canonical_hash([(1.234,)]) == canon.canonical_hash([(1.2341,)])


def test_both_canonical_forms_agree(spark):
    """Two cells are one canonical cell on the driver where they are one on the executors."""
    groups = {
        "string": ["Straße", "STRASSE", "strasse ", "cafe\u0301", "CAF\u00c9", "caf\u00e9", "İx", "a\u00a0b", "a b", "A\tB", "", None, "-"],
        "decimal(10,3)": [decimal.Decimal("1.100"), decimal.Decimal("1.101"), decimal.Decimal("1.200"), None],
        "double": [1.1, 1.101, 1.2, -0.0, 0.0, None],
        "timestamp_ntz": [datetime.datetime(2020, 1, 1), datetime.datetime(2020, 1, 1, 0, 0, 0, 5), datetime.datetime(2020, 1, 1, 0, 0, 1)],
        "boolean": [True, False, None],
    }
    for kind, values in groups.items():
        rows = canon.row_text(spark.createDataFrame([(v,) for v in values], f"x {kind}").coalesce(1)).collect()
        driver = [canon.canonical_cell(v) for v in values]
        for i, a in enumerate(values):
            for j, b in enumerate(values):
                assert (driver[i] == driver[j]) == (rows[i].row == rows[j].row), (kind, a, b)
    assert canon.canonical_hash([(decimal.Decimal("1.10"),)]) == canon.canonical_hash([(1.1,)])
    assert canon.printed_rows([(1.23456, "a"), (None, "B")]) == ["(1.2346, 'a')", "(None, 'B')"] and canon.printed_counts([(1, None), (1, None)]) == {"('1', 'NULL')": 2}


def test_hash_sees_values_nulls_and_counts():
    assert canon.canonical_hash([(None,)]) != canon.canonical_hash([("",)])
    assert canon.canonical_hash([(1,)]) != canon.canonical_hash([(1,), (1,)])
    assert canon.canonical_hash([(1, 2)]) != canon.canonical_hash([(2, 1)])


def test_bag_digest_follows_the_bag(spark):
    df = spark.createDataFrame([(1, "a", 2.5), (2, None, None)], "x int, s string, d double")
    assert canon.bag_digest(df).first() == canon.bag_digest(df.orderBy(F.desc("x")).repartition(3)).first()
    assert canon.bag_digest(df).first() != canon.bag_digest(df.union(df.limit(1))).first()
    assert canon.bag_equal(df, df.repartition(2)) and not canon.bag_equal(df, df.limit(1))
    pair = lambda *cells: spark.createDataFrame([cells], [f"c{i}" for i in range(len(cells))])
    for a, b in ((("a|=b", "c"), ("a", "b|=c")), (("a", "1:b"), ("a1:b", "")), (("1:a", "b"), ("1", ":ab")), (("-", "x"), ("", "-x"))):
        assert not canon.bag_equal(pair(*a), pair(*b)) and canon.bag_digest(pair(*a)).first() != canon.bag_digest(pair(*b)).first()
    with pytest.raises(canon.ResultTooLarge):
        canon.bounded_rows(df, 1)


# ---- guard ----------------------------------------------------------------------------------------------------------

#: Statements that a guard lets pass, and that it refuses.
SAFE = [
    "SELECT 1", "SELECT * FROM orders", "WITH x AS (SELECT * FROM orders) SELECT * FROM x", "SELECT * FROM orders UNION SELECT * FROM orders",
    "select count(*) from orders where status = 'delivered'", "SELECT 'DROP TABLE' AS msg", "SELECT 1;",
    "SELECT * FROM orders o WHERE EXISTS (SELECT 1 FROM orders p WHERE p.order_id = o.order_id)",
    "SELECT status, ROW_NUMBER() OVER (PARTITION BY status ORDER BY ts) FROM orders", "SELECT ';' AS x FROM orders",
]
UNSAFE = [
    "DROP TABLE orders", "SELECT 1; DROP TABLE orders", "UPDATE orders SET status = 'x'", "DELETE FROM orders", "INSERT INTO orders VALUES (1)", "CREATE TABLE evil (x int)",
    "ALTER TABLE orders ADD COLUMN x int", "TRUNCATE TABLE orders", "SELECT * INTO evil FROM orders", "WITH x AS (DELETE FROM orders RETURNING *) SELECT * FROM x",
    "SELECT * FROM orders; -- DROP TABLE orders", "", "   ", "WITH x AS (SELECT 1) INSERT INTO orders SELECT * FROM x", "SELECT * FROM csv.`/etc/passwd`",
    "SELECT reflect('java.lang.System', 'exit', 1)", "SET spark.x = 1", "EXPLAIN SELECT 1", "SELECT * FROM unknown_table", "SELECT (SELECT max(x) FROM parquet.`/x`)",
]


@pytest.mark.parametrize("sql", SAFE)
def test_safe(spark, sql):
    assert guard.is_safe(spark, sql, ["orders"])


@pytest.mark.parametrize("sql", UNSAFE)
def test_unsafe(spark, sql):
    assert not guard.is_safe(spark, sql, ["orders"])


def test_execute_caps_rows_and_time(spark):
    assert guard.execute(spark, "SELECT * FROM VALUES (1), (2) AS t(x)")[0] == [(1,), (2,)]
    assert "exceeds 1 rows" in guard.safe_execute(spark, "SELECT * FROM VALUES (1), (2) AS t(x)", max_rows=1).error
    slow = "SELECT SUM(a.x * b.x) FROM (SELECT explode(sequence(1, 200000)) AS x) a, (SELECT explode(sequence(1, 200000)) AS x) b"
    found = guard.safe_execute(spark, slow, timeout_s=1.5)
    assert found.timed_out and not found.success and "Timeout" in found.error


# ---- catalog and profile --------------------------------------------------------------------------------------------


def test_ddl_is_deterministic_and_counts_matter(toy, toy_catalog):
    again = cat.load_catalog(dict(reversed(toy.items())), {"order_items": ["order_id", "item"], "orders": ["order_id"]}, KEYS)
    assert again.ddl() == toy_catalog.ddl() and again.fingerprint() == toy_catalog.fingerprint()
    fewer = cat.load_catalog(toy | {"orders": toy["orders"].limit(3)}, {"orders": ["order_id"], "order_items": ["order_id", "item"]}, KEYS)
    assert fewer.ddl_sha256() == toy_catalog.ddl_sha256() and fewer.fingerprint() != toy_catalog.fingerprint()
    assert toy_catalog.path("orders", "order_items") == ["orders", "order_items"] and toy_catalog.path("orders", "x") == []


def test_holdout(spark, toy):
    assert profile.cutoff(toy["orders"], "ts", 6) == "2018-03-01"
    assert profile.cutoff(toy["orders"].where("ts < '2018-02-01'"), "ts", 6) == "2017-07-01"
    with pytest.raises(profile.NoDates):
        profile.cutoff(toy["orders"].limit(0), "ts", 6)


def test_key_reports(toy, toy_catalog):
    assert {r.table_name: r.is_unique for r in profile.key_duplicates(toy, toy_catalog).collect()} == {"orders": True, "order_items": True}
    assert {r.column_name for r in profile.categoricals(toy, 5).collect()} == {"customer_id", "status", "product_id"}


def test_schema_pruning_keeps_joining_tables():
    edges = (cat.ForeignKey("a", "x", "b", "x"), cat.ForeignKey("b", "y", "c", "y"))
    many = {n: cat.Table(n, (("x", "TEXT", False),)) for n in ("a", "b", "c", "d", "e")}
    assert profile.prune_schema(cat.Catalog(many, edges), "rows of a and c", 4) == ["a", "b", "c"]


# ---- shadow ---------------------------------------------------------------------------------------------------------


def test_clamp_counts_and_isolation(spark, toy):
    clamped = shadow.clamp(toy, "orders", "ts", "2018-03-01", KEYS)
    assert (clamped["orders"].count(), clamped["order_items"].count()) == (7, 7)
    full, cut = shadow.session_of(spark, toy), shadow.session_of(spark, clamped)
    assert full.sql("SELECT COUNT(*) FROM orders").first()[0] == 12 and cut.sql("SELECT COUNT(*) FROM orders").first()[0] == 7
    assert not spark.catalog.tableExists("orders")


def test_validation_finds_each_failure(spark, toy):
    full, cut = shadow.session_of(spark, toy), shadow.session_of(spark, shadow.clamp(toy, "orders", "ts", "2018-03-01", KEYS))

    def q(i, sql, split="train_ok", text="How many?", **more):
        expected = validation.expected_rows(full, sql) if "FROM missing" not in sql else {"sha256": "", "n_rows": 0}
        return {"id": i, "question": text, "gold_sql": sql, "expected_rows": expected, "date": "", "difficulty": "easy", "category": "aggregation", "split": split, "source": "human"} | more

    early = "SELECT COUNT(*) AS n FROM orders WHERE ts < '2018-02-01'"
    found = validation.validate(
        full,
        [
            q("ok", early), q("held", "SELECT COUNT(*) AS n FROM orders", "heldout"), q("leak", "SELECT COUNT(*) AS n FROM orders"), q("bad", "SELECT * FROM missing"),
            q("enum", early, difficulty="odd"), q("drift", early, expected_rows={"sha256": "0", "n_rows": 1}), q("now", early, text="What happened recently?"),
            q("bypass", "SELECT COUNT(*) AS n FROM orders WHERE ts <= (SELECT MAX(ts) FROM orders)"),
        ],
        cut,
    )
    assert {(x.question_id, x.check) for x in found.excluded} == {("leak", "holdout_leak"), ("bad", "gold_sql"), ("enum", "difficulty"), ("drift", "expected_rows_drift"), ("bypass", "holdout_leak")}
    assert [x.question_id for x in found.warnings] == ["now"] and found.scorable == 3 and found.splits == {"train_ok": 2, "heldout": 1}


# ---- retrieval and triples ------------------------------------------------------------------------------------------


def test_bm25_against_plain_python(spark):
    texts = ["red apple pie", "green apple", "red red wine", "", "blue cheese and apple wine"]
    docs = spark.createDataFrame([("t", str(i), t) for i, t in enumerate(texts)], "table_name string, row_id string, text string")
    asked = spark.createDataFrame([("q", "red apple apple"), ("none", "zebra")], "question_id string, question string")
    toks = [t.split() for t in texts]
    n, avg = len(toks), sum(map(len, toks)) / len(toks)

    def score(d):
        total = 0.0
        for term in ("red", "apple", "apple"):
            tf, df = d.count(term), sum(term in x for x in toks)
            if tf:
                total += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / avg))
        return round(total, 6)

    want = sorted(((-score(d), str(i)) for i, d in enumerate(toks) if {"red", "apple"} & set(d)))
    got = [(-r.score, r.row_id) for r in retrieval.bm25(asked, docs, 3).orderBy("rank").collect()]
    assert got == want[:3]


def test_packs_freeze_and_show_tampering(spark, toy, toy_catalog, tmp_path):
    docs = retrieval.index_docs(toy, toy_catalog)
    asked = spark.createDataFrame([("q1", "canceled orders"), ("q2", "zzz")], "question_id string, question string")
    packed = retrieval.packs(asked, retrieval.bm25(asked, docs), docs, "x")
    path = str(tmp_path / "packs")
    files.freeze_packs(packed, path)
    assert {r.question_id: len(r.rows) for r in files.thaw_packs(spark, path, packed.schema).collect()}["q2"] == 0
    changed = retrieval.sealed(packed).withColumn("question", F.lit("other"))
    assert retrieval.tampered(changed).count() == 2
    text = retrieval.rendered(docs.where("row_id = 'o12'")).first().row_text
    assert text.startswith("[orders:o12] order_id: o12 | customer_id: c2 | status: canceled")


def test_triples_shares_and_disjointness(spark, toy, toy_catalog):
    asked = spark.createDataFrame([(f"q{i}", "delivered orders", "SELECT 1", "train_ok" if i else "heldout") for i in range(60)], "question_id string, question string, gold_sql string, split string")
    draws = corpus.kinds(asked, 10, 1)
    share = {r.kind: r.n / draws.count() for r in draws.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert draws.where("question_id = 'q0'").isEmpty() and abs(share["grounded"] - 0.7) < 0.06 and abs(share["refusal"] - 0.15) < 0.05
    docs = retrieval.index_docs(toy, toy_catalog)
    positives = retrieval.bm25(asked.select("question_id", "question"), docs, 3).select("question_id", "table_name", "row_id")
    negatives = corpus.distractors(draws, positives, docs.select("table_name", "row_id"), 1)
    assert negatives.join(positives, ["question_id", "table_name", "row_id"], "left_semi").isEmpty()
    sizes = {(r.question_id, r.draw_no): r.n for r in negatives.groupBy("question_id", "draw_no").agg(F.count("*").alias("n")).collect()}
    for d in draws.collect():
        n = sizes.get((d.question_id, d.draw_no), 0)
        assert {"grounded": 2 <= n <= 5, "refusal": n == 3, "schema_only": n == 0}[d.kind]
    made = corpus.triples(asked.drop("split"), draws, positives, negatives, retrieval.rendered(docs).select("table_name", "row_id", "row_text"), "DDL", 1)
    assert made.count() == draws.count() and corpus.invalid_triples(made).isEmpty()
    assert made.where("kind = 'refusal' AND NOT target LIKE 'REFUSAL:%'").isEmpty()


# ---- scoring and statistics -----------------------------------------------------------------------------------------


def test_each_error_class(spark):
    from tallyglass.plans.evaluation import scored_outputs

    want = [None, "missing_citation", "invalid_citation", "unexpected_refusal", "invalid_output", "timeout", "execution_error", "wrong_result_missing_rows", "wrong_result_extra_rows", "wrong_result_mismatched_rows"]
    got = {r.question_id: r.error_class for r in scored_outputs(spark, SF).collect()}
    assert [got[f"o{i}"] for i in range(1, 11)] == want


@pytest.mark.parametrize(("runs", "agreement", "flip"), [([1, 1, 1, 1, 1], 1, 0), ([1, 0, 1, 0, 1], 0.6, 1), ([1, 0], 0.5, 1), ([0, 1], 0.5, 1), ([1], 1, 0), ([0, 0, 1], 0.666667, 0.5)])
def test_consistency(spark, runs, agreement, flip):
    df = spark.createDataFrame([("s", "q", i, bool(x)) for i, x in enumerate(runs)], "system string, question_id string, run int, correct boolean")
    r = scoring.consistency(df).first()
    assert (r.agreement, r.flip) == (agreement, flip)


def test_mcnemar_matches_closed_form(spark):
    cases = [(0, 0), (13, 0), (43, 18), (4, 2), (8, 11), (10, 13), (5, 5), (100, 60)]
    got = spark.createDataFrame(cases, "b int, c int").select("b", "c", stats.mcnemar(F.col("b"), F.col("c")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(stats.mcnemar_full(r.b, r.c)["p_exact"], rel=1e-9)
    assert round(stats.mcnemar_full(43, 18)["p_exact"], 4) == 0.0019


def test_wilson_matches_published_interval():
    low, high = report.wilson_interval(41, 61)
    assert (round(100 * low, 1), round(100 * high, 1)) == (54.7, 77.7)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.booleans()), min_size=2, max_size=25))
def test_auc_against_pairs(spark, rows):
    pos, neg = [s for s, t in rows if t], [s for s, t in rows if not t]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else 0.0
    df = spark.createDataFrame([(float(s), t) for s, t in rows], "score double, truth boolean")
    assert stats.auc(df).first().auc == pytest.approx(want, abs=1e-6)


def test_kappa_of_equal_raters_is_one(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "b"), ("c", "c"), ("a", "a")], "x string, y string")
    r = stats.kappa(df).first()
    assert (r.agreement, r.kappa, r.kappa_linear, r.kappa_quadratic) == (1.0, 1.0, 1.0, 1.0)


def test_gate_and_seed_fold(spark):
    assert scoring.gate(0.45, 0.50, 0.1, 0.1) and not scoring.gate(0.44, 0.50, 0.1, 0.1) and not scoring.gate(0.6, 0.5, 0.2, 0.1)
    df = spark.createDataFrame([("seed", f"s{i}", e, 0.1, 1) for i, e in enumerate((0.4, 0.5, 0.6))], "role string, system string, ex double, flip double, n_failures int")
    r = scoring.seed_fold(df).first()
    assert (r.mean_ex, r.least_ex, r.most_ex, r.representative) == (0.5, 0.4, 0.6, "s1")


def test_consensus_prefers_rows_then_votes(spark):
    rows = [("q", "SELECT 1 ", None, "a", 0, 1.0), ("q", "SELECT 2", None, "a", 0, 1.0), ("q", "SELECT long", None, "b", 2, 9.0), ("q", "bad", "boom", None, None, 0.1)]
    r = scoring.consensus(spark.createDataFrame(rows, "question_id string, sql string, error string, result_hash string, n_rows long, latency_ms double")).first()
    assert (r.sql, r.votes, r.ratio) == ("SELECT long", 1, 0.333333)


def test_report_text():
    s = lambda n, ex, flip: {"system": n, "role": "candidate", "n": 100, "ex": ex, "refusal_rate": 0.0, "agreement": 1.0, "flip": flip, "p50_latency_ms": 1.0}
    text = report.render("toy", [s("a", 0.6, 0.0), s("b", 0.62, 0.1)], {("a", "b"): (43, 18)}, "a", "b")
    assert "Gate: a passes against b." in text and "p = 0.0019" in text


# ---- text, memory, files, streams, authoring, CLI -------------------------------------------------------------------


def test_sql_text_measures(spark):
    c = F.col("s")
    df = spark.createDataFrame([("SELECT a FROM t WHERE x = 'a join b' -- join",), ("WITH z AS (SELECT 1) SELECT (1",)], "s string")
    a, b = df.select(sqltext.signature(c).alias("g"), sqltext.balanced(c).alias("b"), sqltext.tier(c).alias("t")).collect()
    assert (a.g, a.b, a.t) == ("select+where", True, "simple") and (b.b, b.t) == (False, "nested")
    raw = "<think>x</think>Sure:\n```sql\nSELECT 1 FROM t;\n```"
    assert spark.range(1).select(sqltext.cleaned(F.lit(raw))).first()[0] == "SELECT 1 FROM t"
    assert sqltext.parse_ddl("CREATE TABLE t (a int, b decimal(10,2), PRIMARY KEY (a)); CREATE VIEW v") == {"t": ["a", "b"], "v": []}


def test_dialect():
    out = authoring.to_spark("""SELECT STRFTIME('%Y-%m', "d"), total(x) FROM t WHERE a LIKE '%b"c''d%' AND b NOT LIKE 'x'""")
    assert out == """SELECT date_format(`d`, 'yyyy-MM'), coalesce(sum(x), 0.0) FROM t WHERE a ILIKE '%b"c\\'d%' AND b NOT ILIKE 'x'"""


def test_memory(spark):
    turns = spark.createDataFrame([(1, 0, "list orders"), (1, 1, "and by month?"), (2, 0, "how many customers are there in total")], "session int, turn int, text string")
    assert {(r.session, r.turn) for r in memory.latest(turns, "session", "turn").collect()} == {(1, 1), (2, 0)}
    flags = {r.text: r.f for r in turns.select("text", memory.follow_up(F.col("text")).alias("f")).collect()}
    assert flags["and by month?"] and not flags["how many customers are there in total"]
    merged = memory.merged(*[spark.createDataFrame([("d", "q", s, 1, a)], "db string, question string, sql string, frequency long, at int") for s, a in (("old", 1), ("new", 2))]).first()
    assert (merged.sql, merged.frequency) == ("new", 2)


def test_csv_rules(spark, tmp_path):
    for name, rows in (("a", 'id,n,d\n"x, ""y""",3,2020-01-02\n,,\n'), ("b", "id,n,d\nz,bad,2020-02-30\n")):
        (tmp_path / f"{name}.csv").write_text("﻿" + rows)
    got = files.read_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], {"id": "TEXT", "n": "INTEGER", "d": "DATE", "extra": "TEXT"}).collect()
    assert sorted(tuple(r) for r in got if r.id) == [('x, "y"', 3, datetime.date(2020, 1, 2), ""), ("z", None, None, "")]
    assert [tuple(r) for r in got if not r.id] == [("", None, None, "")]
    with pytest.raises(FileNotFoundError):
        files.read_csv(spark, str(tmp_path / "none.csv"))


def test_questions_round_trip(spark, tmp_path):
    q = {"id": "1", "question": "?", "gold_sql": "SELECT 1", "expected_rows": {"sha256": "x", "n_rows": 1}, "date": "", "difficulty": "easy", "category": "aggregation", "split": "odd", "source": "human"}
    (tmp_path / "q.jsonl").write_text(json.dumps(q) + "\n\n")
    assert [tuple(r) for r in files.illegal_labels(files.read_questions(spark, str(tmp_path / "q.jsonl"))).collect()] == [("1", "split")]
    (tmp_path / "bad.jsonl").write_text(json.dumps({k: v for k, v in q.items() if k != "gold_sql"}))
    with pytest.raises(files.InvalidQuestion):
        files.read_questions(spark, str(tmp_path / "bad.jsonl"))


def test_streamed_commits_equal_a_batch_merge(spark, tmp_path):
    schema = "db string, question string, sql string, frequency long, at int"
    for k in range(2):
        spark.createDataFrame([("d", "q", f"s{k}", 1, k), ("d", f"only{k}", "x", 1, k)], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    store = str(tmp_path / "store")
    commits.commit_experience(stream, store, str(tmp_path / "ck")).awaitTermination()
    held = lambda path: {r.question: (r.frequency, r.sql) for r in commits.read_experience(spark, path).collect()}
    assert held(store) == {"q": (2, "s1"), "only0": (1, "x"), "only1": (1, "x")}
    commits.commit_experience(stream, store, str(tmp_path / "ck")).awaitTermination()
    assert held(store)["q"] == (2, "s1")  # the checkpoint has seen it all
    commits.commit_experience(stream, store, str(tmp_path / "another")).awaitTermination()
    assert held(store) == {"q": (4, "s1"), "only0": (2, "x"), "only1": (2, "x")}
    commits.compact_experience(spark, store, str(tmp_path / "compact"))
    assert held(str(tmp_path / "compact")) == held(store)


def test_authoring_is_seeded_and_every_draft_runs(spark, toy, toy_catalog):
    full = shadow.session_of(spark, toy)
    facts = authoring.discover(toy, toy_catalog)
    drafts = authoring.drafted(full, facts, 12, seed=3)
    assert drafts == authoring.drafted(full, authoring.discover(toy, toy_catalog), 12, seed=3)
    assert len({d.sql for d in drafts}) == 12 and {"per_order_lookup", "aggregation"} <= {d.category for d in drafts}


def test_command_line_loop(spark, tmp_path, capsys):
    out = tmp_path / "q.jsonl"
    assert cli.main(["author", "--data", SF, "--n", "6", "--out", str(out)], spark) == 0
    assert cli.main(["author", "--data", SF, "--n", "6", "--out", str(out)], spark) == 1
    assert cli.main(["validate", "--data", SF, "--questions", str(out)], spark) == 0
    assert '"n_questions": 6' in capsys.readouterr().out
    assert cli.main(["retrieve", "--data", SF, "--questions", str(out), "--out", str(tmp_path / "packs")], spark) == 0
    assert cli.main(["triples", "--data", SF, "--questions", str(out), "--out", str(tmp_path / "t")], spark) == 0
    assert cli.main(["sql", "--data", SF, "--text", "DROP TABLE orders"], spark) == 1
    assert cli.main(["profile", "--data", SF], spark) == 0


def test_bootstrap_interval_covers_the_mean(spark):
    rows = spark.range(2000).select("id", (F.pmod(F.col("id"), F.lit(10)) < 3).cast("double").alias("y"))
    r = stats.bootstrap_mean(rows, "y", resamples=400).first()
    half = 1.96 * math.sqrt(0.3 * 0.7 / 2000)
    assert r.mean == 0.3 and r.low < 0.3 < r.high and r.high - r.low == pytest.approx(2 * half, rel=0.25)


def test_every_user_turn_is_asked_and_recalls_the_turn_before_it(spark):
    turns = {(r.conv_id, r.turn): r for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").withColumn("f", memory.follow_up(F.col("text"))).collect()}
    asked = {k for k, r in turns.items() if r.role == "user"}
    before = {k: max((t for c, t in turns if c == k[0] and t < k[1]), default=None) for k in asked if turns[k].f}
    found = evaluation.queries()["session_recall"](spark, "/root/testdata/sf0.001").collect()
    assert {(r.query_id, r.ref) for r in found if r.source == "turn"} == {(f"{c}:{t}", str(b)) for (c, t), b in before.items() if b is not None}
    assert any(t > 0 for _, t in asked) and {r.query_id for r in found} <= {f"{c}:{t}" for c, t in asked}


def test_every_gold_question_is_judged(spark):
    found = {r.question_id: r for r in evaluation.queries()["window_dependence"](spark, SF).collect()}
    assert found.keys() == gold.SHARED.keys()
    assert all(r.split == ("heldout" if r.dependent else "train_ok") for r in found.values())
