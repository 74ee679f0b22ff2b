"""The persisted index against plain BM25, with blocks that are skipped, and draws by rank against full numbering."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyglass.operators import corpus, index, retrieval

DOC = "table_name string, row_id string, columns array<string>, values array<string>, text string"


def plain(questions, docs, top_k):
    words = {(t, r): re.findall("[a-z0-9]+", (x or "").lower()) for t, r, x in docs}
    n, avgdl = len(words), sum(map(len, words.values())) / len(words)
    df = collections.Counter(w for ws in words.values() for w in set(ws))
    out = []
    for q, text in questions:
        scores = {}
        for key, ws in words.items():
            tf = collections.Counter(ws)
            asked = re.findall("[a-z0-9]+", text.lower())
            if any(w in tf for w in asked):
                score = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / avgdl)) for w in asked if w in tf)
                scores[key] = round(score, 6)
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:top_k]
        out += [(q, k + 1, *key, s) for k, (key, s) in enumerate(best)]
    return sorted(out)


@pytest.fixture(scope="module")
def store(spark):
    rng = random.Random(5)
    vocabulary = ["the"] * 60 + ["of"] * 30 + [f"w{i}" for i in range(60)] + ["rare", "seldom"]
    docs = [(f"t{i % 3}", f"{i:04d}", " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))) or None) for i in range(1200)]
    docs += [("t9", f"same{i}", "equal rows of the store") for i in range(40)] + [("t9", "none", None), ("t9", "empty", "")]
    frame = spark.createDataFrame([(t, r, ["text"], [x], x) for t, r, x in docs], DOC)
    return docs, index.build(frame.repartition(5))


@pytest.mark.parametrize("top_k", [1, 4, 60, 3000])
@pytest.mark.parametrize("broadcast", [True, False])
def test_search_equals_plain_bm25(spark, store, monkeypatch, top_k, broadcast):
    monkeypatch.setattr(index, "BROADCAST_CANDIDATES", 10**6 if broadcast else 0)
    docs, built = store
    questions = [("a", "the rare w1"), ("b", "the of the"), ("c", "W3 w3 w4 seldom"), ("d", "nothing known"), ("e", ""), ("f", "equal rows"), ("g", "the of rare seldom w7 w8")]
    got = built.search(spark.createDataFrame(questions, "question_id string, question string"), top_k).collect()
    want = plain(questions, docs, top_k)
    assert sorted((r.question_id, r.rank, r.table_name, r.row_id) for r in got) == [w[:4] for w in want]
    assert all(abs(a.score - b[4]) < 2e-6 for a, b in zip(sorted(got), want, strict=True))


def test_blocks_are_whole_ordered_and_skipped(spark, store):
    docs, built = store
    words = collections.Counter(w for _, _, x in docs for w in set(re.findall("[a-z0-9]+", x or "")))
    assert {r.term: r.df for r in built.terms().collect()} == words
    blocks = built.table("postings").collect()
    by_term = collections.defaultdict(list)
    for b in sorted(blocks, key=lambda b: (b.term, b.block)):
        assert b.n == len(b.docs) <= index.BLOCK and b.most == b.docs[0].weight
        by_term[b.term] += [-d.weight for d in b.docs]
        assert b.block == sum(x.term == b.term and x.block < b.block for x in blocks)
    assert {t: len(w) for t, w in by_term.items()} == words and all(w == sorted(w) for w in by_term.values())
    asked = spark.createDataFrame([("q", t, g) for t, g in (("the", 0.01), ("rare", 5.0))], "question_id string, term string, gain double")
    reach = {r.term: r for r in index.Index._reach(built.table("postings").join(asked, "term"), 3).collect()}
    assert reach["rare"].essential and not reach["the"].essential and reach["the"].least == reach["rare"].least > 1


def test_only_asked_buckets_are_read(spark, store):
    _, built = store
    plan = built.table("postings").where(F.col("bucket").isin([3, 4]))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ IN \(3,4\)", plan)


def test_an_empty_store_and_stores_by_name(spark, tmp_path):
    empty = index.build(spark.createDataFrame([], DOC))
    assert empty.search(spark.createDataFrame([("q", "a b")], "question_id string, question string")).count() == 0 and empty.stats().first().n_docs == 0
    made = []

    def docs():
        made.append(1)
        return spark.createDataFrame([("t", "1", ["a"], ["x"], "t x")], DOC)

    name = f"test-{random.random()}"
    first = index.of_store(spark, name, docs)
    same = lambda a, b: a.path.rpartition("/")[2] == b.path.rpartition("/")[2]
    assert same(index.of_store(spark, name, docs), first) and len(made) == 1
    system, where = index.hadoop(spark, f"{first.path}/stats/_SUCCESS")
    system.delete(where, False)  # as a build that was lost before its end
    assert not same(index.of_store(spark, name, docs), first) and len(made) == 2


@pytest.mark.parametrize("rows", [7, 900, 20_000])
def test_rows_at_drawn_ranks(spark, rows, monkeypatch):
    monkeypatch.setattr(corpus, "BROADCAST_BUCKETS", 0 if rows == 900 else 10**6)
    table = spark.range(rows).select(F.when(F.col("id") % 10 == 0, "small").otherwise("large").alias("table_name"), F.col("id").cast("string").alias("row_id"))
    order = F.md5(F.concat_ws(":", F.lit("3"), "table_name", "row_id"))
    sizes = table.groupBy("table_name").agg(F.count(F.lit(1)).alias("size"))
    every = table.withColumn("number", F.row_number().over(Window.partitionBy("table_name").orderBy(order)) - 1)
    drawn = every.where(F.col("number") % 3 == 0).select("table_name", F.col("number").cast("long"), F.lit("q").alias("tag"))
    drawn = drawn.union(drawn)
    got = corpus.at_ranks(drawn, table, order, sizes).select("table_name", "number", "row_id").collect()
    want = [tuple(r) for r in every.where(F.col("number") % 3 == 0).select("table_name", "number", "row_id").collect()]
    assert sorted(map(tuple, got)) == sorted(want * 2)
