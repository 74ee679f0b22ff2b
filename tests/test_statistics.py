"""Statistics, panels and the registered queries that SQL does not express, against plain Python."""

import collections
import itertools
import json
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyglass.functions import sqltext
from tallyglass.operators import analysis, corpus, items, retrieval, shadow, stats
from tallyglass.plans import evaluation, gold

SF = "/root/testdata/sf0.001"
QUERIES = evaluation.queries()


def rows(spark, name):
    return [r.asDict(recursive=True) for r in QUERIES[name](spark, SF).collect()]


# ---- tails, intervals, ranks ----------------------------------------------------------------------------------------


def exact_two_sided(b, c):
    n, k = b + c, min(b, c)
    return 1.0 if not n else min(1.0, float(2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n))


@pytest.mark.parametrize("counts", [(0, 0), (1000, 1000), (600, 700), (3, 2000), (1, 0), (0, 5), (899, 901), (5000, 5200)])
def test_exact_p_holds_for_any_counts(spark, counts):
    b, c = counts
    p = spark.createDataFrame([counts], "b long, c long").select(stats.mcnemar(F.col("b"), F.col("c")).alias("p")).first().p
    want = exact_two_sided(b, c) if b + c < 3000 else stats.two_sided(min(b, c), b + c)
    assert p == pytest.approx(want, rel=1e-8, abs=1e-300) and stats.two_sided(min(b, c), b + c) == pytest.approx(want, rel=1e-8)


def test_a_million_pairs_are_quick_and_sane(spark):
    cases = [(500_000, 500_000), (499_000, 501_000), (10, 999_990)]
    got = spark.createDataFrame(cases, "b long, c long").select(stats.mcnemar(F.col("b"), F.col("c")).alias("p")).collect()
    normal = math.erfc((2000 - 1) / math.sqrt(1_000_000) / math.sqrt(2))
    assert got[0].p == 1.0 and got[1].p == pytest.approx(normal, rel=0.01) and got[2].p == 0.0


def test_full_mcnemar_at_its_edges():
    assert stats.mcnemar_full(5, 5) == {"p_exact": 1.0, "chi2": 0.1, "p_chi2": pytest.approx(math.erfc(math.sqrt(0.05))), "odds_ratio": 1.0}
    assert stats.mcnemar_full(3, 0)["odds_ratio"] == math.inf and stats.mcnemar_full(0, 3)["odds_ratio"] == 0.0
    assert stats.mcnemar_full(0, 0) == {"p_exact": 1.0, "chi2": 0.0, "p_chi2": 1.0, "odds_ratio": 0.0}


def test_ranked_sums_with_ties_and_few_buckets(spark, monkeypatch):
    rng = random.Random(5)
    data = [(i, rng.choice([0.0, 0.2, 0.2, 0.5, 0.999, 1.0]), rng.random() < 0.4) for i in range(237)]
    df = spark.createDataFrame(data, "item int, score double, truth boolean")
    order = sorted(data, key=lambda r: (-r[1], r[0]))
    hits, want = 0, 0.0
    for at, (_, _, t) in enumerate(order, 1):
        hits += t
        want += t * hits / at
    n, step = len(order), max(1, len(order) // 50)
    running = list(itertools.accumulate(t for _, _, t in order))
    points = [(i, round(i / n, 6), round(running[i - 1] / i, 6)) for i in range(1, n + 1) if i % step == 0 or i == n]
    for buckets in (1, 7, 4096):
        monkeypatch.setattr(stats, "SCORE_BUCKETS", buckets)
        assert stats.average_precision(df, "item").first().ap == pytest.approx(want / hits, abs=1e-6)
        assert sorted(tuple(r) for r in stats.risk_coverage(df, "item").collect()) == points
        pos, neg = [r[1] for r in data if r[2]], [r[1] for r in data if not r[2]]
        auc = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))
        assert stats.auc(df).first().auc == pytest.approx(auc, abs=1e-6)
    s = stats.risk_summary(df, "item").first()
    assert s.n_points == len(points) and s.aurc == pytest.approx(np.mean([1 - p[2] for p in points]), abs=1e-6)
    assert s.at_half == min(points, key=lambda p: (abs(p[1] - 0.5), p[0]))[2]


def test_resampled_means_spread_as_a_bootstrap(spark):
    """Against numpy's resampling of the items, for binary, few and many values."""
    rng = np.random.default_rng(4)
    for values in ((rng.random(900) < 0.3).astype(float), rng.normal(size=60), np.array([2.0])):
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        draws = np.array([r.m for r in stats.resampled(df, "x", resamples=600).collect()])
        plain = np.array([rng.choice(values, len(values)).mean() for _ in range(600)])
        assert len(draws) == 600 and abs(draws.mean() - plain.mean()) < 4 * (plain.std() + 1e-9) / math.sqrt(600) + 1e-6
        assert draws.std() == pytest.approx(plain.std(), rel=0.25, abs=1e-9)


def test_paired_delta_follows_the_difference(spark):
    pairs = [(int(i % 10 < 6), int(i % 10 < 4)) for i in range(400)] + [(None, 1)]
    r = stats.paired_delta(spark.createDataFrame(pairs, "x int, y int"), resamples=500).first()
    assert r.delta == 0.2 and 0.14 < r.low < 0.2 < r.high < 0.26 and r.prob_better == 1.0 and r.p == 0.0
    same = stats.paired_delta(spark.createDataFrame([(i % 2, (i + 1) % 2) for i in range(400)], "x int, y int"), resamples=500).first()
    assert same.delta == 0.0 and same.low < 0 < same.high and same.p > 0.5


def test_significance_rows_and_their_correction(spark):
    rng = random.Random(8)
    made = [(m, s, i, None if rng.random() < 0.05 else rng.random() < 0.4 + 0.2 * (s == "b")) for m in ("valid", "exec") for s in "abc" for i in range(300)]
    got = {(r.measure, r.a, r.b): r for r in stats.significance(spark.createDataFrame(made, "measure string, system string, item int, verdict boolean"), resamples=200).collect()}
    known = {(m, s): {i: v for mm, ss, i, v in made if (mm, ss) == (m, s) and v is not None} for m in ("valid", "exec") for s in "abc"}
    ps = {}
    for m in ("valid", "exec"):
        for a, b in itertools.combinations("abc", 2):
            x, y = known[m, a], known[m, b]
            both = x.keys() & y.keys()
            only = sum(x[i] and not y[i] for i in both), sum(y[i] and not x[i] for i in both)
            r = got[m, a, b]
            assert (r.n, r.only_a, r.only_b) == (len(both), *only) and r.rate_a == pytest.approx(sum(x[i] for i in both) / len(both), abs=1e-6)
            assert r.delta == pytest.approx((only[0] - only[1]) / len(both), abs=1e-6) and r.low <= r.delta <= r.high
            ps["|".join((m, a, b))] = exact_two_sided(*only)
    running = 0.0
    for i, (name, p) in enumerate(sorted(ps.items(), key=lambda kv: (kv[1], kv[0]))):
        running = min(1.0, max(running, (len(ps) - i) * p))
        assert got[tuple(name.split("|"))].holm_p == pytest.approx(running, abs=1e-6)


# ---- retrieval and triples ------------------------------------------------------------------------------------------


def test_numbers_without_a_key_are_a_permutation(spark):
    df = spark.range(500).select((F.col("id") % 90).alias("a"), F.lit("x").alias("b"))
    docs = retrieval.table_docs("t", df)
    assert sorted(int(r.row_id.split(":")[1]) for r in docs.collect()) == list(range(500))
    assert {(r.row_id, r.text) for r in docs.collect()} == {(r.row_id, r.text) for r in retrieval.table_docs("t", df.repartition(7)).collect()}


def test_distractors_come_from_all_rows(spark):
    """Every row of the near tables can be drawn, none twice in a draw, never a positive; far rows only when the near ones run out."""
    listed = [("big", str(i)) for i in range(3000)] + [("small", str(i)) for i in range(4)] + [("far", str(i)) for i in range(50)]
    table = spark.createDataFrame(listed, "table_name string, row_id string")
    positives = [("q1", "big", str(i)) for i in range(5)] + [("q2", "small", "0"), ("q2", "small", "1")]
    draws = spark.createDataFrame([(q, d, k) for q in ("q1", "q2", "q3") for d in range(400) for k in ("grounded" if d % 2 else "refusal",)], "question_id string, draw_no int, kind string")
    got = corpus.distractors(draws, spark.createDataFrame(positives, "question_id string, table_name string, row_id string"), table, 9).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.question_id, r.draw_no].append((r.position, r.table_name, r.row_id))
    for (q, d), found in by.items():
        found.sort()
        assert [p for p, _, _ in found] == list(range(1, len(found) + 1)) and len({x[1:] for x in found}) == len(found)
        assert not {(q, t, i) for _, t, i in found} & set(positives)
        assert 2 <= len(found) <= 5 if d % 2 else len(found) == {"q1": 5, "q2": 3, "q3": 3}[q]
        if q == "q2":
            near = sorted(x[1] == "small" for x in found)
            assert near.count(True) == min(2, len(found)) and [x[1] for x in found][:2] == ["small"] * min(2, len(found))
    assert len({i for q, d in by for _, t, i in by[q, d] if q == "q1"}) > 900 and {t for _, t, _ in by["q1", 0]} == {"big"}
    assert len(by) == 1200


def test_registered_triples_are_whole(spark):
    made = rows(spark, "training_triples")
    drawn = rows(spark, "distractor_sample")
    assert sorted(r["draw_no"] for r in rows(spark, "invalid_triples")) == [2] * 4 + [5] * 4 and len(made) == 4 * 8
    negatives = collections.Counter((r["question_id"], r["draw_no"]) for r in drawn)
    positives = collections.Counter()
    for r in QUERIES["bm25_topk"](spark, SF).collect():
        positives[r.question_id] += r.rank <= 4
    for r in made:
        want = {"grounded": positives[r["question_id"]] + negatives[r["question_id"], r["draw_no"]], "refusal": negatives[r["question_id"], r["draw_no"]], "schema_only": 0}[r["kind"]]
        assert r["n_evidence"] == want and isinstance(r["over_context"], bool)
    ledger = {r["kind"]: r for r in rows(spark, "ledger_by_kind")}
    assert {k: v["n_triples"] for k, v in ledger.items()} == collections.Counter(r["kind"] for r in made)
    assert all(v["n_evidence"] <= sum(r["n_evidence"] for r in made if r["kind"] == k) for k, v in ledger.items())


def test_only_what_ran_is_kept(spark):
    made = spark.createDataFrame([(f"q{i}", "x" * (10 if i != 3 else 4000)) for i in range(6)], "question_id string, schema string")
    ran = spark.createDataFrame([("q0", None, 2), ("q1", "boom", 0), ("q2", None, 0), ("q3", None, 1), ("q4", None, 1)], "question_id string, error string, n_rows long")
    assert {r.question_id for r in corpus.executable_only(made, ran).collect()} == {"q0", "q4"} and corpus.executable_only(made, ran, 1).count() == 1


def test_packs_hold_the_best_rows(spark):
    packs = {r["question_id"]: r for r in rows(spark, "evidence_packs")}
    top = collections.Counter(r.question_id for r in QUERIES["bm25_topk"](spark, SF).collect())
    assert {q: p["n_rows"] for q, p in packs.items()} == {q: top[q] for q, _ in evaluation.QUESTIONS} and len({p["sha256"] for p in packs.values()}) == 4
    assert all(re.fullmatch("[0-9a-f]{64}", p["sha256"]) for p in packs.values()) and packs == {r["question_id"]: r for r in rows(spark, "evidence_packs")}


def brute_exemplars(queries, store, k=2):
    words = {d: collections.Counter(re.findall("[a-z0-9]+", t.lower())) for d, t in store}
    avgdl = sum(sum(c.values()) for c in words.values()) / len(words)
    out = {}
    for q, text in queries:
        prefixes = list(dict.fromkeys([t for t in re.findall("[a-z0-9]+", text.lower()) if len(t) >= 2][:8]))
        score = collections.Counter()
        for p in prefixes:
            tf = {d: n for d, c in words.items() if (n := sum(v for w, v in c.items() if w.startswith(p)))}
            for d, n in tf.items():
                idf = math.log(1 + (len(words) - len(tf) + 0.5) / (len(tf) + 0.5))
                score[d] += idf * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * sum(words[d].values()) / avgdl))
        ranked = sorted(((round(s, 6), d) for d, s in score.items()), key=lambda x: (-x[0], x[1]))[:k]
        out[q] = [d for _, d in ranked]
    return out


def test_exemplars_against_brute_force(spark):
    store = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = collections.defaultdict(list)
    for r in sorted(rows(spark, "exemplar_search"), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append(r["doc_id"])
    want = brute_exemplars([(i, t) for i, (_, t) in enumerate(evaluation.QUESTIONS)], store)
    assert dict(got) == {q: d for q, d in want.items() if d}
    own = spark.createDataFrame([(1, "x", "alpha beta"), (2, "y", "alpha")], "doc_id int, db string, text string")
    asked = spark.createDataFrame([(7, "y", "alph")], "query_id int, db string, query string")
    assert [(r.query_id, r.doc_id) for r in retrieval.exemplars(asked, own).collect()] == [(7, 2)]


# ---- shadow ---------------------------------------------------------------------------------------------------------


def test_lineage_spares_queries_and_jobs(spark, monkeypatch):
    """Queries that name no clamped table are digested once, and many digests are one job."""
    asked = []
    real = shadow.digests
    monkeypatch.setattr(shadow, "digests", lambda s, q: asked.append(set(q)) or real(s, q))
    small = {k: v for k, v in gold.SHARED.items() if k in ("lookup_pk", "cte_chain", "scalar_sub_filter", "corr_scalar_select", "semi_in", "top10_keys")}
    texts = small | {"free": "SELECT COUNT(*) FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region)", "hidden": "SELECT COUNT(*) FROM nation WHERE n_nationkey < (SELECT MAX(o_custkey) FROM orders)"}
    tables = evaluation.star(spark, SF)
    clamped = evaluation._clamped(spark, SF, tables)
    sessions = [shadow.session_of(spark, t) for t in (tables, clamped)]
    changed = [t for t in tables if clamped[t] is not tables[t]]
    assert sorted(changed) == ["lineitem", "orders"]
    spark.sparkContext.setJobGroup("lineage", "")
    got = shadow.dependence(spark, *sessions, texts, changed).collect()
    every = shadow.dependence(spark, *sessions, texts).collect()
    assert got == every
    assert ("free", "clamped") not in asked[0] and ("hidden", "clamped") in asked[0] and len(asked[0]) < len(asked[1]) == 2 * len(texts)


def test_a_million_values_are_resampled_in_vectors(spark):
    """Many distinct values, few of them often, in several groups: against a plain Poisson bootstrap of the items."""
    df = spark.range(1_000_000).select((F.col("id") % 2).cast("string").alias("g"), (F.col("id") * 0.001).alias("x"))
    r = {x.g: x for x in stats.bootstrap_mean(df, "x", ["g"], resamples=50).collect()}
    sd = 1000 / math.sqrt(12) / math.sqrt(500_000)
    for g, mean in (("0", 499.999), ("1", 500.0)):
        assert r[g].mean == pytest.approx(mean, abs=1e-3) and mean - 4 * sd < r[g].low < mean < r[g].high < mean + 4 * sd


def test_vectors_do_not_depend_on_partitions_or_groups(spark, monkeypatch):
    df = spark.range(3000).select((F.col("id") % 40).alias("g"), (F.col("id") % 70 / 7).alias("x"))
    means = lambda d: {(r.g, r.resample): r.m for r in stats.resampled(d, "x", ["g"], resamples=20).collect()}
    want = means(df)
    assert len(want) == 800
    for name, value in (("LEVELS_AT_ONCE", 7), ("GROUPS_AT_ONCE", 3)):
        monkeypatch.setattr(stats, name, value)
        assert means(df.repartition(9)) == pytest.approx(want, abs=1e-9)
    assert stats.resampled(df.where("x < 0"), "x", ["g"]).count() == 0


def test_dependence_against_both_databases(spark):
    """Every gold text on the whole and on the clamped tables, in another engine."""
    full, cut = duckdb.connect(), duckdb.connect()
    for name in evaluation._ALL:
        for c in (full, cut):
            c.sql(f"CREATE TABLE {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    cut.sql("DELETE FROM orders WHERE o_orderdate >= (SELECT date_trunc('month', MAX(o_orderdate)) - INTERVAL 6 MONTH FROM orders) OR o_orderdate IS NULL")
    cut.sql("DELETE FROM lineitem WHERE l_orderkey IS NULL OR l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
    cell = lambda v: round(v, 2) + 0.0 if isinstance(v, float) else str(v).strip().lower()
    bag = lambda c, text: sorted(tuple(map(str, map(cell, r))) for r in c.sql(text).fetchall())
    found = {r["question_id"]: r for r in rows(spark, "window_dependence")}
    for name, text in gold.SHARED.items():
        a, b = bag(full, text), bag(cut, text)
        assert (found[name]["n_full"], found[name]["n_clamped"], found[name]["dependent"]) == (len(a), len(b), a != b), name
    heldout = {k for k, r in found.items() if r["dependent"]}
    assert {r["split"]: r["n"] for r in rows(spark, "split_counts")} == {"heldout": len(heldout), "train_ok": len(found) - len(heldout)}
    assert {r["question_id"] for r in rows(spark, "leak_check")} == heldout | {"never_ran"}


# ---- values and schema ----------------------------------------------------------------------------------------------


def test_grounding_against_every_gram(spark):
    index = collections.defaultdict(set)
    for r in rows(spark, "value_index"):
        index[r["key"]].add((r["table_name"], r["column_name"], r["value"]))
    want = []
    for q, text in (("g1", "orders of the building segment in asia"), ("g2", "lines with return flag r by Automobile customers from FRANCE")):
        w, hits = re.findall(r"[a-z0-9_'-]+", text.lower()), {}
        for n in (4, 3, 2, 1):
            for i in range(len(w) - n + 1):
                for v in index.get(" ".join(w[i : i + n]), ()):
                    best = hits.get(v, (0, 99))
                    hits[v] = (max(best[0], n), min(best[1], i + 1))
        ranked = sorted(hits.items(), key=lambda kv: (-kv[1][0], kv[1][1], kv[0]))[:6]
        want += [(q, *v, n, 1.0 if n > 1 else 0.85) for v, (n, _) in ranked]
    assert sorted((r["question_id"], r["table_name"], r["column_name"], r["value"], r["words"], float(r["confidence"])) for r in rows(spark, "value_grounding")) == sorted(want)


def test_schema_links_by_words(spark):
    schema = {}
    for name in evaluation._ALL:
        schema[name] = spark.read.parquet(f"{SF}/{name}.parquet").columns
    plain = lambda s: {x for w in re.findall("[a-z0-9]+", s.lower()) for x in ({w, w[:-1]} if len(w) > 3 and w.endswith("s") else {w})}
    for r in rows(spark, "schema_link"):
        asked = plain(dict(evaluation.QUESTIONS)[r["question_id"]])
        want = 5.0 * bool(plain(r["table_name"]) & asked) + 1.5 * sum(bool(plain(c) & asked) for c in schema[r["table_name"]])
        assert r["score"] == want


# ---- SQL text and items ---------------------------------------------------------------------------------------------


def strip(sql):
    return re.sub(r"'(?:[^']|'')*'", "''", re.sub(r"/\*.*?\*/", " ", re.sub(r"--[^\n]*", " ", sql), flags=re.S)).lower()


def present(sql):
    return {c for c, p in sqltext.CLAUSES.items() if re.search(p, strip(sql))}


def test_signatures_and_panel(spark):
    texts = dict(gold.SHARED)
    for r in rows(spark, "sql_signatures"):
        own = present(texts[r["name"]])
        assert r["signature"] == "+".join(c for c in sqltext.CLAUSES if c in own) and r["balanced"]
        assert r["tier"] == ("nested" if own & {"subquery", "cte", "set_op"} else "joined" if "join" in own else "aggregated" if own & {"aggregate", "group_by"} else "simple")
        body = strip(texts[r["name"]])
        assert r["effort"] == len(texts[r["name"]].split()) + 5 * len(re.findall(r"\bjoin\b", body)) + 3 * len(re.findall(r"\bselect\b", body)) + 2 * len(re.findall(r"\bwhere\b", body))
    tok = lambda s: collections.Counter(re.findall(r"[a-z_][a-z0-9_]*|\d+(?:\.\d+)?|'[^']*'|<>|<=|>=|!=|[^\s\w]", s.lower()))
    pairs = {n: (a, b) for n, a, b in evaluation._PAIRS}
    for r in rows(spark, "sql_similarity_panel"):
        a, b = pairs[r["name"]]
        x, y = tok(a), tok(b)
        assert r["token_f1"] == pytest.approx(2 * (x & y).total() / (x.total() + y.total()), abs=1e-6)
        assert r["clause_jaccard"] == pytest.approx(len(present(a) & present(b)) / len(present(a) | present(b)), abs=1e-6)
        p, q = ({t for t in evaluation._ALL if t in tok(strip(s))} for s in (a, b))
        assert r["link_f1"] == pytest.approx(2 * len(p & q) / (len(p) + len(q)), abs=1e-6)


def test_item_queries_are_consistent(spark):
    scored, texts = rows(spark, "item_scores"), [t for _, t in sorted(gold.SHARED.items())]
    assert len(scored) == 2 * len(texts) - 1 and all(r["exact"] and r["failure"] is None and r["token_f1"] == 1 for r in scored if r["system"] == "same")
    summary = {r["system"]: r for r in rows(spark, "item_summary")}
    for s in ("same", "next"):
        own = [r for r in scored if r["system"] == s]
        assert (summary[s]["n"], summary[s]["right"]) == (len(own), sum(bool(r["executed"]) for r in own))
        for c in items.SIMILARITIES:
            assert summary[s][c] == pytest.approx(sum(r[c] for r in own) / len(own), abs=1e-5)
    for r in rows(spark, "clause_confusion"):
        pairs = [(texts[i], texts[i + (r["system"] == "next")]) for i in range(len(texts) - (r["system"] == "next"))]
        cells = collections.Counter((r["clause"] in present(a), r["clause"] in present(b)) for a, b in pairs)
        assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (cells[True, True], cells[False, True], cells[True, False], cells[False, False])
    moved = rows(spark, "failure_migration")
    assert {r["before"] for r in moved} == {"none"} and sum(r["n"] for r in moved) == len(texts) - 1
    assert {r["after"]: r["n"] for r in moved} == collections.Counter(r["failure"] for r in scored if r["system"] == "next")


def test_references_and_links(spark):
    schema = {"orders": ["id", "status"], "items": ["id", "price"]}
    texts = ["SELECT o.status FROM orders AS o JOIN items i ON i.id = o.id WHERE price > 1", "SELECT 'items' FROM Orders WHERE 1 = 1", "SELECT x FROM other o"]
    df = spark.createDataFrame([(t,) for t in texts], "sql string")
    got = [(r.a, r.u) for r in df.select(sqltext.aliases(F.col("sql"), sorted(schema)).alias("a"), sqltext.used(F.col("sql"), schema).alias("u")).collect()]
    assert [dict(a) for a, _ in got] == [{"o": "orders", "i": "items"}, {}, {}]
    assert [(u.tables, u.columns) for _, u in got] == [(["items", "orders"], ["id", "price", "status"]), (["orders"], []), ([], [])]
    c = df.select(sqltext.link_counts(sqltext.used(F.lit(texts[1]), schema), sqltext.used(F.lit(texts[0]), schema)).alias("c")).select("c", sqltext.link_rates(F.col("c")).alias("r")).first()
    assert tuple(c.c) == (1, 0, 4) and tuple(c.r) == (1.0, 0.2, pytest.approx(1 / 3))


@pytest.mark.parametrize(
    ("sql", "family"),
    [("SELECT a FROM t UNION SELECT b FROM u", "set operation"), ("WITH x AS (SELECT 1) SELECT * FROM x", "subquery / CTE"), ("SELECT a, COUNT(*) FROM t GROUP BY a", "aggregation + grouping"), ("SELECT COUNT(*) FROM t", "simple aggregation"), ("SELECT a FROM t JOIN u ON 1 = 1", "join"), ("SELECT DISTINCT a FROM t", "distinct projection"), ("SELECT a FROM t ORDER BY a", "ordering / top-k"), ("SELECT a FROM t WHERE a = 'limit'", "filter"), ("SELECT a FROM t", "plain projection")],
)
def test_families(spark, sql, family):
    assert spark.range(1).select(sqltext.family(F.lit(sql)).alias("f")).first().f == family


def test_error_labels(spark):
    schema = {"t": ["a", "b"], "u": ["c"]}
    cases = {
        "": "no sql produced", "I cannot": "did not answer with SQL", "SELECT a FROM zz": "hallucinated table", "SELECT t.zz FROM t": "hallucinated column", "SELECT FROM t": "syntax error",
        "SELECT COUNT(*) FROM t WHERE a = 1": "invented aggregation", "SELECT a FROM t JOIN u ON a = c WHERE a = 1": "spurious join", "SELECT a FROM t": "dropped filter", "SELECT b FROM t WHERE a = 1": "semantic error",
    }
    made = spark.createDataFrame([("s", "x", i, "SELECT a FROM t WHERE a = 1", sql, True, False) for i, sql in enumerate(cases)], "set string, system string, idx int, gold_sql string, pred_sql string, valid boolean, executed boolean")
    got = items.item_scores(made, schema).withColumn("gold_ok", F.lit(True)).select("idx", items.error_label(schema).alias("e")).orderBy("idx").collect()
    assert [r.e for r in got] == list(cases.values())


def test_analysis_holds_together(spark):
    scored = items.item_scores(evaluation._items(spark, SF).select("set", "system", "idx", "gold_sql", "pred_sql", "valid", "executed"), {t: [] for t in evaluation._ALL})
    found = analysis.assemble(scored, resamples=100)
    tables = {k: [r.asDict() for r in df.collect()] for k, df in found.items()}
    n = {r["system"]: r["n"] for r in tables["summary"]}
    assert sum(r["n"] for r in tables["outcomes"]) == sum(n.values()) and sum(r["n"] for r in tables["outcome_pairs"]) == min(n.values())
    assert tables["agreement"][0]["n"] == min(n.values()) and 0 <= tables["association"][0]["v2"] <= 1
    assert {(r["a"], r["b"], r["measure"]) for r in tables["significance"]} == {("next", "same", m) for m in analysis.MEASURES}
    for r in tables["intervals"]:
        assert r["low"] <= r["mean"] <= r["high"]
    assert sum(r["n"] for r in tables["signatures"]) == sum(n.values()) == sum(r["n"] for r in tables["by_family"]) == sum(r["n"] for r in tables["by_length"])
    micro = {r["system"]: r for r in tables["micro_link"]}
    assert micro["same"]["f1"] == 1.0 and micro["same"]["all_found"] == micro["same"]["none_spurious"] == n["same"] and 0 < micro["next"]["f1"] < 1
    spent = analysis.latency_benchmark({"nothing": lambda: None, "json": lambda: json.dumps(n)}, 5)
    assert all(v["least"] <= v["p50"] <= v["p95"] <= v["most"] for v in spent.values())
