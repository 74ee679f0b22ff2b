"""The shadow by the keys that are gone: the same rows as by semi join, and none of them shuffled (F14-F16)."""

import pytest
from pyspark.sql import functions as F

from tallyglass.operators import shadow
from tallyglass.sources import catalog as cat

KEYS = (cat.ForeignKey("items", "o", "orders", "o"),)
GOLD = {
    "alone": "SELECT part, SUM(price) AS s FROM items GROUP BY part",
    "both": "SELECT COUNT(*) AS n FROM items JOIN orders ON items.o = orders.o",
    "parents": "SELECT COUNT(*) AS n FROM orders WHERE day < TIMESTAMP_NTZ '2020-02-01'",
    "early": "SELECT COUNT(*) AS n FROM items WHERE items.o < 20",
    "other": "SELECT COUNT(*) AS n FROM parts",
}


@pytest.fixture
def star(spark):
    n = F.col("id")
    day = F.when(n % 17 != 16, F.to_timestamp_ntz(F.concat(F.lit("2020-0"), (1 + F.floor(n / 10)).cast("string"), F.lit("-03")), F.lit("yyyy-MM-dd")))
    orders = spark.range(60).select(n.alias("o"), day.alias("day"))
    # orphans from 60 on, and rows without a reference
    items = spark.range(300).select(F.when(n % 11 != 0, n * 7 % 80).alias("o"), (n % 5).alias("part"), (n * 1.5).alias("price"))
    return {"orders": orders, "items": items, "parts": spark.range(5)}


@pytest.mark.parametrize("few", [0, 10**6])
def test_the_same_shadow_either_way(spark, star, monkeypatch, few):
    monkeypatch.setattr(shadow, "FEW_KEYS", few)
    clamped = shadow.clamp(star, "orders", "day", "2020-05-01", KEYS)
    without = shadow.without_gone(star, clamped, "orders", KEYS)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(without["items"]) == rows(clamped["items"]) and 0 < len(rows(clamped["items"])) < 300
    assert without["orders"] is clamped["orders"] and without["parts"] is star["parts"]
    full, cut, own = (shadow.session_of(spark, t) for t in (star, clamped, without))
    want = rows(shadow.dependence(spark, full, cut, GOLD, ["orders", "items"]))
    assert rows(shadow.dependence(spark, full, cut, GOLD, ["orders", "items"], (own, "orders"))) == want
    assert {r.question_id for r in shadow.dependence(spark, full, cut, GOLD, None, (own, "orders")).where("dependent").collect()} == {"alone", "both", "early"}


def test_children_alone_stay_where_they_are(spark, star, monkeypatch, tmp_path):
    star["items"].write.parquet(str(tmp_path / "items"))
    star |= {"items": spark.read.parquet(str(tmp_path / "items"))}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        clamped = shadow.clamp(star, "orders", "day", "2020-05-01", KEYS)
        plans = [t["items"]._jdf.queryExecution().executedPlan().toString() for t in (clamped, shadow.without_gone(star, clamped, "orders", KEYS))]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "hashpartitioning" in plans[0] and "hashpartitioning" not in plans[1] and "BroadcastHashJoin" in plans[1]
