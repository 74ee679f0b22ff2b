"""Item scores, their summaries and clause tables."""

import numpy as np
import pytest

from tallyglass.operators import items
from tallyglass.plans import evaluation

ROWS = [
    ("s", "a", 1, "SELECT x FROM t WHERE x = 1", "select x from t where x = 1;", True, True), ("s", "a", 2, "SELECT COUNT(*) FROM t GROUP BY y", "SELECT y FROM t", True, False),
    ("s", "a", 3, "SELECT x FROM t", None, None, None), ("s", "b", 1, "SELECT x FROM t WHERE x = 1", "SELECT x FROM u", False, False),
]


@pytest.fixture(scope="module")
def scored(spark):
    schema = "set string, system string, idx int, gold_sql string, pred_sql string, valid boolean, executed boolean"
    return items.item_scores(spark.createDataFrame(ROWS, schema), ["t", "u"])


def test_outcomes_and_failures(scored):
    got = {(r.system, r.idx): (r.outcome, r.failure, r.exact) for r in scored.collect()}
    assert got == {("a", 1): ("executed_exact", None, True), ("a", 2): ("valid_wrong", "aggregation", False), ("a", 3): ("invalid", "empty", False), ("b", 1): ("invalid", "invalid", False)}


def test_summary_counts_scored_items_only(scored):
    r = {x.system: x for x in items.summary(scored).collect()}["a"]
    assert (r.n, r.scored, r.right, r.ex_rate, r.valid_rate) == (3, 2, 1, 0.5, 0.666667) and r.ex_low < 0.5 < r.ex_high


def test_clause_table_and_migration(scored):
    r = {(x.system, x.clause): (x.tp, x.fp, x.fn, x.tn) for x in items.clause_confusion(scored).collect()}
    assert r["a", "where"] == (1, 0, 0, 2) and r["a", "aggregate"] == (0, 0, 1, 2)
    assert [(x.before, x.after, x.n) for x in items.migration(scored, "a", "b").collect()] == [("none", "invalid", 1)]


def test_cooccurrence_is_correlation(spark):
    found = evaluation._items(spark, "").where("system = 'same'")
    flags = [r.gold_flags for r in found.select("gold_flags").collect()]
    table = items.cooccurrence(found, "gold_flags")
    for r in table.where("a IN ('where', 'join') AND b IN ('group_by', 'aggregate')").collect():
        x, y = ([float(f[c]) for f in flags] for c in (r.a, r.b))
        assert r.r == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-6)
    assert items.frobenius(table, table) == 0.0
