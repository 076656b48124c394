"""The relational constructs of the recognised query grammar, run by Catalyst.

Every text is valid on both engines unless SPARK gives a form of its own.
"""

from __future__ import annotations

from .sqlplan import plan

TEXTS: dict[str, str] = {
    "scan_project_filter": "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45",
    "select_distinct": "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer",
    "pred_between_in_like_null": "SELECT p_partkey, p_brand, p_size FROM part WHERE p_size BETWEEN 5 AND 15 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#23', 'Brand#34') OR p_name LIKE '%a%' AND p_retailprice IS NOT NULL AND NOT p_type LIKE 'S%'",
    "pred_nested_bool": "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 100000) AND NOT (o_orderpriority = '1-URGENT' AND o_custkey % 2 = 0)",
    "case_when_cast": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS band, CAST(o_orderkey AS VARCHAR(20)) AS key_text, CAST(FLOOR(o_totalprice) AS BIGINT) AS whole FROM orders",
    "arith_null_safe": "SELECT l_orderkey, l_linenumber, l_suppkey, CAST(FLOOR(l_extendedprice / NULLIF(l_quantity, 0)) AS BIGINT) AS unit, CAST(FLOOR(l_extendedprice / NULLIF(l_quantity - l_quantity, 0)) AS BIGINT) AS gone, COALESCE(NULLIF(l_discount, 0), -1) AS disc FROM lineitem",
    "join_inner": "SELECT n.n_name, r.r_name, COUNT(*) AS n_customers, ROUND(SUM(c.c_acctbal), 2) AS bal FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY n.n_name, r.r_name",
    "join_left": "SELECT o.o_orderkey, COUNT(l.l_orderkey) AS n_lines FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND l.l_quantity > 40 GROUP BY o.o_orderkey",
    "join_right": "SELECT n.n_name, COUNT(s.s_suppkey) AS n_suppliers FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000 GROUP BY n.n_name",
    "join_full": "SELECT a.k AS ka, b.k AS kb FROM (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 8000) a FULL OUTER JOIN (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9900) b ON a.k = b.k",
    "join_natural": "SELECT r_name, COUNT(*) AS n FROM (SELECT r_regionkey AS k, r_name FROM region) a NATURAL JOIN (SELECT n_regionkey AS k, n_name FROM nation) b GROUP BY r_name",
    "join_using": "SELECT k, COUNT(*) AS n FROM (SELECT c_nationkey AS k FROM customer) a JOIN (SELECT s_nationkey AS k FROM supplier) b USING (k) GROUP BY k",
    "join_cross": "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n",
    "join_theta": "SELECT a.n_name AS low, b.n_name AS high FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_self": "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND a.s_acctbal > b.s_acctbal",
    "join_semi_exists": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)",
    "join_anti_not_exists": "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)",
    "join_not_in": "SELECT c_custkey AS k, 'plain' AS list FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000) UNION ALL SELECT c_custkey, 'with null' FROM customer WHERE c_custkey NOT IN (SELECT NULLIF(n_nationkey, 3) FROM nation)",
    "join_in_subquery": "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09)",
    "join_interval_bucket": "SELECT o.o_orderpriority, b.band, COUNT(*) AS n FROM orders o JOIN (SELECT 0 AS lo, 50000 AS hi, 'a' AS band UNION ALL SELECT 50000, 150000, 'b' UNION ALL SELECT 150000, 10000000, 'c') b ON o.o_totalprice >= b.lo AND o.o_totalprice < b.hi GROUP BY o.o_orderpriority, b.band",
    "subq_scalar": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.5 FROM orders)",
    "subq_correlated": "SELECT p_partkey FROM part p WHERE p_retailprice > (SELECT AVG(q.p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)",
    "derived_table": "SELECT c_nationkey, ROUND(AVG(total), 2) AS mean_total FROM (SELECT c.c_custkey, c.c_nationkey, SUM(o.o_totalprice) AS total FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey, c.c_nationkey) t GROUP BY c_nationkey",
    "cte": "WITH big AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey), top AS (SELECT MAX(n) AS m FROM big) SELECT b.o_custkey, b.n FROM big b JOIN top t ON b.n = t.m",
    "recursive_cte": "WITH RECURSIVE steps(k, n) AS (SELECT 1, 1 UNION ALL SELECT k + 1, n * 2 FROM steps WHERE k < 20) SELECT s.k, s.n, r.r_name FROM steps s JOIN region r ON s.k % 5 = r.r_regionkey",
    "agg_basic_distinct": "SELECT l_returnflag, COUNT(*) AS n, COUNT(DISTINCT l_suppkey) AS suppliers, CAST(SUM(DISTINCT l_linenumber) AS BIGINT) AS lines, ROUND(SUM(l_quantity), 2) AS qty, ROUND(AVG(l_discount), 6) AS disc, MIN(l_shipdate) AS first_ship, MAX(l_tax) AS tax FROM lineitem GROUP BY l_returnflag",
    "agg_global": "SELECT COUNT(*) AS n, COUNT(DISTINCT o_custkey) AS customers, MIN(o_totalprice) AS low, MAX(o_totalprice) AS high FROM orders",
    "agg_empty_input": "SELECT COUNT(*) AS n, MAX(o_totalprice) AS high FROM orders WHERE o_totalprice < 0",
    "group_having": "SELECT o_custkey, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND SUM(o_totalprice) > 100000",
    "group_multi_key": "SELECT l_returnflag, l_linestatus, CAST(EXTRACT(YEAR FROM l_shipdate) AS INT) AS y, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, EXTRACT(YEAR FROM l_shipdate)",
    "rollup_level_all": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS qty, CAST(GROUPING(l_returnflag) + GROUPING(l_linestatus) AS INT) AS lvl FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "cube_flags": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "grouping_sets": "SELECT c_mktsegment, c_nationkey, COUNT(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())",
    "agg_conditional": "SELECT l_suppkey, COUNT(*) FILTER (WHERE l_returnflag = 'R') AS returned, CAST(SUM(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS open_lines FROM lineitem GROUP BY l_suppkey",
    "agg_median_mode": "SELECT l_returnflag, MEDIAN(l_quantity) AS med, MAX_BY(l_orderkey, l_orderkey * 8 + l_linenumber) AS last_order FROM lineitem GROUP BY l_returnflag",
    "order_limit_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey ASC LIMIT 25 OFFSET 10",
    "order_mixed": "SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey ASC, c_acctbal DESC, c_custkey ASC LIMIT 40",
    "topk_per_group": "SELECT o_custkey, o_orderkey, rk FROM (SELECT o_custkey, o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS rk FROM orders) t WHERE rk <= 3",
    "set_union": "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier",
    "set_union_all": "SELECT k, COUNT(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) t GROUP BY k",
    "set_intersect": "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9500 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
    "set_except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 6000",
    "set_all_variants": "SELECT l_linenumber AS k FROM lineitem EXCEPT ALL SELECT p_size FROM part WHERE p_size < 8",
    "set_intersect_all": "SELECT l_linenumber AS k FROM lineitem INTERSECT ALL SELECT p_size FROM part WHERE p_size < 8",
    "set_except_all_counts": "SELECT k, COUNT(*) AS n FROM (SELECT l_linenumber AS k FROM lineitem EXCEPT ALL SELECT p_size FROM part WHERE p_size < 8) t GROUP BY k",
    "set_intersect_all_counts": "SELECT k, COUNT(*) AS n FROM (SELECT l_linenumber AS k FROM lineitem INTERSECT ALL SELECT p_size FROM part WHERE p_size < 8) t GROUP BY k",
    "win_rank_family": "SELECT o_orderkey, CAST(RANK() OVER w AS INT) AS r, CAST(DENSE_RANK() OVER w AS INT) AS dr, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS INT) AS rn FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)",
    "win_lag_lead": "SELECT event_id, user_id, LAG(event_type) OVER w AS prev_type, LEAD(event_id, 2) OVER w AS next2, ROUND(value - LAG(value) OVER w, 4) AS delta FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "win_frame_rows": "SELECT event_id, ROUND(SUM(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS s3, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM events",
    "win_frame_range": "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_orderstatus, o_custkey ORDER BY o_totalprice RANGE BETWEEN 10000 PRECEDING AND 10000 FOLLOWING) AS near FROM orders",
    "win_ntile_pct": "SELECT c_custkey, CAST(NTILE(4) OVER w AS INT) AS q, ROUND(PERCENT_RANK() OVER w, 6) AS pr, ROUND(CUME_DIST() OVER w, 6) AS cd FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)",
    "win_first_last": "SELECT event_id, FIRST_VALUE(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first_type, LAST_VALUE(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_id FROM events",
    "pivot_sources": "SELECT user_id, COUNT(*) FILTER (WHERE event_type = 'click') AS click, COUNT(*) FILTER (WHERE event_type = 'view') AS view_n, COUNT(*) FILTER (WHERE event_type = 'error') AS error_n, COUNT(*) FILTER (WHERE event_type = 'signup') AS signup, COUNT(*) FILTER (WHERE event_type = 'purchase') AS purchase FROM events GROUP BY user_id",
    "string_functions": "SELECT p_partkey, UPPER(p_brand) AS up, LOWER(p_type) AS low, CAST(LENGTH(p_name) AS INT) AS len, SUBSTR(p_name, 2, 4) AS sub, REPLACE(p_type, ' ', '_') AS rep, TRIM(CONCAT('  ', p_brand, ' ')) AS trimmed, CAST(INSTR(p_name, 'a') AS INT) AS at, p_brand || '-' || CAST(p_size AS VARCHAR(10)) AS joined FROM part",
    "math_functions": "SELECT l_orderkey, l_linenumber, l_partkey, ABS(l_tax - l_discount) AS gap, ROUND(l_extendedprice, 0) AS r0, ROUND(POWER(l_tax, 2), 6) AS sq, ROUND(EXP(l_discount), 6) AS ex, ROUND(LN(l_quantity), 6) AS lg, CAST(FLOOR(l_quantity / 7) AS BIGINT) AS fl, CAST(CEIL(l_quantity / 7) AS BIGINT) AS ce, l_linenumber % 3 AS m FROM lineitem",
    "null_functions": "SELECT event_id, NULLIF(event_type, 'view') AS t, COALESCE(NULLIF(event_type, 'view'), 'none') AS c, CASE WHEN NULLIF(event_type, 'view') IS NULL THEN 1 ELSE 0 END AS is_null FROM events",
}

SPARK: dict[str, str] = {}

QUERIES = {k: plan(SPARK.get(k, v)) for k, v in TEXTS.items()}
SQL = dict(TEXTS)
