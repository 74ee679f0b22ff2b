"""Gold queries: the relational constructs of a question set, as Spark SQL beside the oracle's text.

Most texts are valid in both engines and are written once; a pair is given where the dialects differ. Means are moved by
1e-7 before they are rounded, so that ties do not hang on the order of a float sum.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyglass.session import TABLES, table

SHARED: dict[str, str] = {
    # lookups, predicates, projections
    "lookup_pk": "SELECT o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 4711",
    "lookup_flat": "SELECT event_id, event_type, value FROM events WHERE user_id = 17 AND event_type IS NOT NULL AND event_type <> ''",
    "date_range_half_open": "SELECT COUNT(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1996-04-01 00:00:00'",
    "conjunction_filter": "SELECT COUNT(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_totalprice > 100000",
    "numeric_compare": "SELECT COUNT(*) AS n, ROUND(AVG(l_extendedprice) + 1e-7, 2) AS mean_price FROM lineitem WHERE l_quantity > 40",
    "like_count": "SELECT COUNT(*) AS n FROM part WHERE p_name ILIKE '%ar%'",
    "like_folded": "SELECT COUNT(*) AS n FROM part WHERE LOWER(p_type) LIKE LOWER('%E%')",
    "late_rows": "SELECT COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate",
    "semi_in": "SELECT COUNT(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "anti_not_exists": "SELECT COUNT(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "left_join_is_null": "SELECT c_custkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_orderkey IS NULL",
    "scalar_sub_filter": "SELECT COUNT(*) AS n FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)",
    "corr_scalar_select": """
        SELECT c_custkey, (SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM customer""",
    "constant_alias": "SELECT 'all orders' AS label, COUNT(*) AS n FROM orders",
    "arithmetic_sum": "SELECT ROUND(SUM(l_extendedprice * (1 - l_discount) + l_tax) + 1e-7, 2) AS total FROM lineitem",
    "cte_chain": """
        WITH per AS (SELECT o_custkey, SUM(o_totalprice) AS spent FROM orders GROUP BY o_custkey),
        big AS (SELECT o_custkey, spent FROM per WHERE spent > 500000)
        SELECT c_mktsegment, COUNT(*) AS n, ROUND(SUM(spent), 2) AS spent FROM big JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment""",
    # joins
    "inner_join_dim": """
        SELECT c_mktsegment, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""",
    "revenue_by_segment": """
        SELECT c_mktsegment, COUNT(*) AS n_items, ROUND(SUM(l_extendedprice), 2) AS revenue
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        GROUP BY c_mktsegment""",
    "star_join_2dim": """
        SELECT p_type, s_nationkey, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS quantity
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY p_type, s_nationkey""",
    "snowflake_4way": """
        SELECT r_name, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        GROUP BY r_name""",
    "fanout_join": """
        SELECT e.event_type, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total
        FROM events e JOIN orders ON e.user_id = o_custkey GROUP BY e.event_type""",
    "text_like_join": """
        SELECT l.quality, COUNT(*) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.text ILIKE '%the%' GROUP BY l.quality""",
    # aggregates
    "global_aggregates": """
        SELECT COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total, ROUND(AVG(o_totalprice) + 1e-7, 4) AS mean,
            MIN(o_totalprice) AS least, MAX(o_totalprice) AS most FROM orders""",
    "count_by_status": "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus",
    "sum_by_type": "SELECT event_type, ROUND(SUM(value), 4) AS total, ROUND(AVG(value), 6) AS mean FROM events GROUP BY event_type",
    "avg_where_gt": "SELECT l_returnflag, ROUND(AVG(l_extendedprice) + 1e-7, 4) AS mean FROM lineitem WHERE l_extendedprice > 200 GROUP BY l_returnflag",
    "key_filtered_group": "SELECT l_returnflag, COUNT(*) AS n, ROUND(SUM(l_extendedprice), 2) AS total FROM lineitem WHERE l_orderkey = 101 GROUP BY l_returnflag",
    "count_two_predicates": "SELECT COUNT(*) AS n FROM lineitem WHERE l_quantity < 10 AND l_discount > 0.05",
    "having_count": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 15",
    "having_two_preds": """
        SELECT o_custkey, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders
        GROUP BY o_custkey HAVING COUNT(*) >= 12 AND SUM(o_totalprice) > 1000000""",
    "having_above_avg": """
        SELECT c_nationkey, ROUND(SUM(c_acctbal), 2) AS total FROM customer GROUP BY c_nationkey
        HAVING SUM(c_acctbal) > (SELECT AVG(t.s) FROM (SELECT SUM(c_acctbal) AS s FROM customer GROUP BY c_nationkey) t)""",
    "count_distinct_global": "SELECT COUNT(DISTINCT o_custkey) AS customers FROM orders",
    "count_distinct_group": "SELECT o_orderpriority, COUNT(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderpriority",
    "distinct_values": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "histogram_lang": "SELECT lang, COUNT(*) AS n FROM documents GROUP BY lang",
    "quarter_sum_3way": """
        SELECT n_name, ROUND(SUM(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-04-01 00:00:00' GROUP BY n_name""",
    "keyword_score_distribution": """
        SELECT l.quality, l.toxic, COUNT(*) AS n FROM labels l JOIN documents d ON l.doc_id = d.doc_id
        WHERE d.text ILIKE '%licen%' OR d.text ILIKE '%that%' GROUP BY l.quality, l.toxic""",
    "post_cutoff_count": """
        SELECT COUNT(*) AS n, ROUND(SUM(l_extendedprice), 2) AS total FROM lineitem
        WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-02-01 00:00:00')""",
    "total_or_zero": "SELECT COALESCE(SUM(o_totalprice), 0.0) AS total FROM orders WHERE o_orderstatus = 'no such status'",
    # order and limits
    "order_by_agg": "SELECT p_brand, COUNT(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand",
    "top10_keys": """
        SELECT o_custkey, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey ORDER BY SUM(o_totalprice) DESC, o_custkey LIMIT 10""",
    "top15_join": """
        SELECT p_partkey, p_name, COUNT(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey
        GROUP BY p_partkey, p_name ORDER BY n DESC, p_partkey LIMIT 15""",
    # set operations
    "union_all": "SELECT c_nationkey AS nation FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_nationkey FROM supplier WHERE s_acctbal < 0",
    "union_distinct": "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect": "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT user_id FROM events",
    "except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders",
    # windows
    "latest_event": """
        SELECT user_id, event_id, event_type FROM (SELECT user_id, event_id, event_type,
            ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) t WHERE r = 1""",
    "turn_index": """
        SELECT conv_id, turn, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_index FROM conversations""",
    "last_turn_window": """
        SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r
            FROM conversations) t WHERE r = 1""",
    "last_three_turns": """
        SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r
            FROM conversations) t WHERE r <= 3""",
    "dedup_keep_first": """
        SELECT text, item_id FROM (SELECT text, doc_id AS item_id, ROW_NUMBER() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) t WHERE r = 1""",
    "running_total": """
        SELECT o_custkey, o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running
        FROM orders""",
}

#: (Spark text, oracle text) where the dialects differ.
PAIRS: dict[str, tuple[str, str]] = {
    name: (template.replace("<month>", "date_format({}, 'yyyy-MM')".format(column)), template.replace("<month>", f"strftime({column}, '%Y-%m')"))
    for name, column, template in (
        ("count_by_month", "o_orderdate", "SELECT <month> AS month, COUNT(*) AS n FROM orders GROUP BY <month>"),
        ("avg_by_month", "o_orderdate", "SELECT <month> AS month, ROUND(AVG(o_totalprice) + 1e-7, 4) AS mean FROM orders WHERE o_orderstatus = 'O' GROUP BY <month>"),
        ("revenue_by_month", "o_orderdate", """SELECT <month> AS month, ROUND(SUM(l_extendedprice), 2) AS revenue, COUNT(*) AS n
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY <month>"""),
        ("events_by_month_type", "ts", "SELECT <month> AS month, event_type, COUNT(*) AS n FROM events GROUP BY <month>, event_type"),
    )
} | {
    "days_between": (
        """SELECT l_returnflag, ROUND(AVG((unix_micros(CAST(l_shipdate AS TIMESTAMP)) - unix_micros(CAST(o_orderdate AS TIMESTAMP))) / 86400e6) + 1e-7, 4) AS days
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_returnflag""",
        """SELECT l_returnflag, ROUND(AVG((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400e6) + 1e-7, 4) AS days
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_returnflag""",
    ),
    "minmax_dates": (
        "SELECT date_format(MIN(o_orderdate), 'yyyy-MM-dd') AS first, date_format(MAX(o_orderdate), 'yyyy-MM-dd') AS last FROM orders",
        "SELECT strftime(MIN(o_orderdate), '%Y-%m-%d') AS first, strftime(MAX(o_orderdate), '%Y-%m-%d') AS last FROM orders",
    ),
    "distinct_months": (
        "SELECT DISTINCT substr(CAST(o_orderdate AS STRING), 1, 7) AS month FROM orders",
        "SELECT DISTINCT substr(CAST(o_orderdate AS VARCHAR), 1, 7) AS month FROM orders",
    ),
    "median_latency": (
        "SELECT event_type, ROUND(percentile(value, 0.5), 6) AS p50 FROM events GROUP BY event_type",
        "SELECT event_type, ROUND(quantile_cont(value, 0.5), 6) AS p50 FROM events GROUP BY event_type",
    ),
    "p95_by_index": (
        """SELECT event_type, value AS p95 FROM (SELECT event_type, value, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY value) AS r,
               COUNT(*) OVER (PARTITION BY event_type) AS n FROM events) t WHERE r = LEAST(CAST(FLOOR(n * 0.95) AS BIGINT) + 1, n)""",
        """SELECT event_type, value AS p95 FROM (SELECT event_type, value, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY value) AS r,
               COUNT(*) OVER (PARTITION BY event_type) AS n FROM events) t WHERE r = LEAST(CAST(FLOOR(n * 0.95) AS BIGINT) + 1, n)""",
    ),
    "quoted_identifier": (
        "SELECT `Customer ID`, COUNT(*) AS n FROM (SELECT o_custkey AS `Customer ID` FROM orders) t GROUP BY `Customer ID`",
        'SELECT "Customer ID", COUNT(*) AS n FROM (SELECT o_custkey AS "Customer ID" FROM orders) t GROUP BY "Customer ID"',
    ),
    "listagg_roles": (
        "SELECT conv_id, listagg(role, ',') WITHIN GROUP (ORDER BY turn) AS roles FROM conversations GROUP BY conv_id",
        "SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id",
    ),
    "seeded_sample": (
        """SELECT o_orderkey FROM orders ORDER BY md5(concat('7:', CAST(o_orderkey AS STRING))), o_orderkey LIMIT 3""",
        """SELECT o_orderkey FROM orders ORDER BY md5(concat('7:', CAST(o_orderkey AS VARCHAR))), o_orderkey LIMIT 3""",
    ),
}


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run SQL text over the tables it names, without leaving views behind in the caller's catalog."""
    used = {t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"\b{t}\b", text)}
    for name, df in used.items():
        text = re.sub(rf"\b(FROM|JOIN|,)(\s+){name}\b", rf"\1\2{{{name}}}", text)
    return spark.sql(text, **{k: v for k, v in used.items() if f"{{{k}}}" in text})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    texts = SHARED | {k: spark_text for k, (spark_text, _) in PAIRS.items()}
    return {k: functools.partial(_run, text=v) for k, v in texts.items()}


def _run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return run_sql(spark, sf_dir, text)


def oracle_sql() -> dict[str, str]:
    return SHARED | {k: oracle for k, (_, oracle) in PAIRS.items()}
