"""Means and counts over distinct texts against those over every row."""

import collections

from pyspark.sql import functions as F

from tallyglass.functions import sqltext
from tallyglass.operators import items

TEXTS = ["SELECT a FROM t WHERE b = 'x'", "select A from t where b = 'x' LIMIT 3", "", None, "SELECT COUNT(*) FROM u JOIN t ON u.k = t.k GROUP BY u.k", "item 5 is not in the data"]


def _rows(spark):
    made = [("s", f"y{i % 2}", i, TEXTS[i % 6], TEXTS[(i // 6) % 6], True, i % 6 == (i // 6) % 6) for i in range(36)] * 3
    return spark.createDataFrame(made, "set string, system string, idx int, gold_sql string, pred_sql string, valid boolean, executed boolean")


def test_mean_likeness_is_that_of_all_items(spark):
    rows = _rows(spark)
    want = items.item_scores(rows, ["t", "u"]).groupBy("system").agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in items.SIMILARITIES]).orderBy("system").collect()
    got = items.mean_likeness(rows, ["t", "u"]).orderBy("system").collect()
    assert [(a.system, a.n) for a in got] == [(b.system, b.n) for b in want] == [("y0", 54), ("y1", 54)]
    assert all(abs(a[m] - b[m]) < 1e-9 for a, b in zip(got, want, strict=True) for m in items.SIMILARITIES)


def test_signatures_are_counted_over_all_items(spark):
    rows = _rows(spark)
    want = collections.Counter(tuple(r) for r in rows.select("system", sqltext.signature(F.col("pred_sql"))).collect())
    assert {(r.system, r.signature): r.n for r in items.signature_counts(rows).collect()} == want


def test_each_distinct_pair_is_compared_once(spark):
    """The distance stands above the grouping of pairs."""
    plan = items.mean_likeness(_rows(spark), ["t", "u"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2 and plan.index("levenshtein") < plan.rindex("Aggregate [")
