"""Scans, projections, joins, aggregation, windows, sorting and set operations, each as one checked query."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import relational as ops
from quern.sources.tables import query, table

#: Queries whose text both engines run, or (Spark's text, the oracle's text) where the dialects differ.
SQL: dict[str, str | tuple[str, str]] = {
    # scans and sources
    "scan_pruned": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000 AND o_orderpriority = '1-URGENT'",
    "scan_or_predicates": "SELECT o_orderkey FROM orders WHERE o_custkey < 20 OR o_totalprice > 499000 OR (o_orderstatus = 'F' AND o_custkey BETWEEN 700 AND 720)",
    "scan_values": "SELECT a, b, a * 2 AS c FROM (VALUES (1, 'x'), (2, 'y'), (CAST(NULL AS INT), 'z')) AS v(a, b)",
    "scan_one_row": "SELECT 1 AS one, 'text' AS word, CAST(NULL AS INT) AS nothing, 1 + 1 AS two",
    "scan_subquery": "SELECT n_regionkey, cnt FROM (SELECT n_regionkey, count(*) AS cnt FROM nation GROUP BY n_regionkey) t WHERE cnt > 4",
    "scan_cte": "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE n >= 18) SELECT a.o_custkey, a.n, b.n AS m FROM top a JOIN big b ON a.o_custkey = b.o_custkey",
    "scan_recursive": "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t",
    "scan_append": "SELECT 'c' AS kind, c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT 's', s_suppkey, s_name FROM supplier",
    "scan_function": ("SELECT id AS n FROM range(3, 20, 4)", "SELECT range AS n FROM range(3, 20, 4)"),
    "scan_ordinality": ("SELECT pos + 1 AS ord, col AS v FROM (SELECT posexplode(array('a', 'b', 'c')))", "SELECT ord, v FROM (SELECT unnest(['a', 'b', 'c']) AS v, unnest([1, 2, 3]) AS ord)"),
    "series_descending": ("SELECT explode(sequence(10, 1, -3)) AS v", "SELECT unnest(generate_series(10, 1, -3)) AS v"),
    # projection and predicates
    "project_expressions": "SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge, upper(l_returnflag) AS flag FROM lineitem",
    "project_lockstep": ("SELECT a, b FROM (SELECT explode(arrays_zip(array(1, 2, 3), array('x', 'y'))) AS z) LATERAL VIEW OUTER inline(array(struct(z.`0` AS a, z.`1` AS b))) t AS a, b", "SELECT unnest([1, 2, 3]) AS a, unnest(['x', 'y', NULL]) AS b"),
    "predicate_three_valued": "SELECT a, b, a AND b AS conj, a OR b AS disj, NOT a AS neg FROM (VALUES (true, true), (true, false), (true, NULL), (false, false), (false, NULL), (NULL, NULL)) AS t(a, b)",
    "predicate_distinct_from": "SELECT a, b, a IS DISTINCT FROM b AS df, a IS NOT DISTINCT FROM b AS ndf FROM (VALUES (1, 1), (1, 2), (1, NULL), (NULL, NULL)) AS t(a, b)",
    "predicate_is_true": ("SELECT a, a IS NULL AS n, a <=> true AS t, NOT (a <=> true) AS nt, a IS NULL AS u FROM (VALUES (true), (false), (CAST(NULL AS BOOLEAN))) AS t(a)", "SELECT a, a IS NULL AS n, a IS NOT DISTINCT FROM true AS t, a IS DISTINCT FROM true AS nt, a IS NULL AS u FROM (VALUES (true), (false), (NULL::BOOLEAN)) AS t(a)"),
    "predicate_like": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'r_d%' AND p_name NOT LIKE '%gear' OR p_name ILIKE 'BLUE b%'",
    "predicate_like_escape": "SELECT s FROM (VALUES ('100%'), ('100 percent'), ('a_b'), ('axb')) AS t(s) WHERE s LIKE '%!%' ESCAPE '!' OR s LIKE 'a!_b' ESCAPE '!'",
    "predicate_regex": ("SELECT p_partkey, p_brand FROM part WHERE p_brand RLIKE '^Brand#1[0-5]$' AND NOT p_name RLIKE '(?i)RING'", "SELECT p_partkey, p_brand FROM part WHERE regexp_matches(p_brand, '^Brand#1[0-5]$') AND NOT regexp_matches(p_name, '(?i)RING')"),
    "predicate_in": "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3) AND c_acctbal BETWEEN 0 AND 1000",
    "predicate_not_in_null": "SELECT a FROM (VALUES (1), (2), (3)) AS t(a) WHERE a NOT IN (SELECT b FROM (VALUES (1), (CAST(NULL AS INT))) AS u(b))",
    "predicate_case": "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, coalesce(nullif(o_orderstatus, 'F'), 'none') AS st, greatest(o_custkey, 500) AS g, least(o_custkey, 500) AS l FROM orders",
    "predicate_casts": "SELECT CAST('12' AS INT) AS i, CAST(3.7 AS DOUBLE) AS d, CAST(7 AS VARCHAR(3)) AS s, CAST('2024-02-29' AS DATE) AS dt, CAST(CAST(5 AS DOUBLE) / 2 AS DOUBLE) AS h, CAST(true AS INT) AS b",
    "predicate_rows": ("SELECT o_orderkey FROM orders WHERE struct(o_custkey, o_orderkey) < struct(CAST(10 AS BIGINT), CAST(5000 AS BIGINT))", "SELECT o_orderkey FROM orders WHERE (o_custkey, o_orderkey) < (10, 5000)"),
    "subquery_scalar": "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) * 1.8 FROM customer)",
    "subquery_exists": "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49 AND l_discount > 0.09)",
    "subquery_correlated": "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS m FROM customer",
    "select_distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "having_without_group": "SELECT count(*) AS n FROM orders HAVING count(*) > 10",
    # joins
    "join_inner": "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "join_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 480000",
    "join_right": "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 490000",
    "join_full": "SELECT a.k AS ak, b.k AS bk FROM (SELECT c_custkey AS k FROM customer) a FULL OUTER JOIN (SELECT s_suppkey * 3 AS k FROM supplier) b ON a.k = b.k",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_natural": "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) AS x(k, v) NATURAL JOIN (VALUES (2, 'c'), (3, 'd')) AS y(k, w)",
    "join_using": "SELECT k, v, w FROM (VALUES (1, 'a'), (2, 'b')) AS x(k, v) JOIN (VALUES (2, 'c'), (2, 'd')) AS y(k, w) USING (k)",
    "join_lateral": "SELECT n_nationkey, t.c_custkey, t.c_acctbal FROM nation, LATERAL (SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) t",
    "join_theta": "SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal",
    "join_disjunctive": "SELECT count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE (p_size < 5 AND l_quantity > 40) OR (p_size > 45 AND l_quantity < 10)",
    "join_self": "SELECT a.n_name AS one, b.n_name AS two FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_null_keys": "SELECT x.k, y.v FROM (VALUES (1), (NULL)) AS x(k) LEFT JOIN (VALUES (1, 'a'), (NULL, 'b')) AS y(k, v) ON x.k = y.k",
    "join_range_overlap": "SELECT a.i AS ai, b.i AS bi FROM (VALUES (1, 1, 5), (2, 4, 8), (3, 9, 9)) AS a(i, lo, hi) JOIN (VALUES (1, 5, 6), (2, 8, 12), (3, 0, 0)) AS b(i, lo, hi) ON a.lo <= b.hi AND b.lo <= a.hi",
    # aggregation
    "agg_basic": "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS q, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, round(avg(l_discount), 6) AS d FROM lineitem GROUP BY l_returnflag",
    "agg_empty": "SELECT count(*) AS n, sum(o_totalprice) AS s, max(o_custkey) AS m FROM orders WHERE o_orderkey < 0",
    "agg_distinct": "SELECT count(DISTINCT l_suppkey) AS s, count(DISTINCT l_returnflag) AS f, round(sum(DISTINCT l_tax), 4) AS t FROM lineitem",
    "agg_filter": "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 250000) AS big, count(*) AS n FROM orders GROUP BY o_orderstatus",
    "agg_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) * 2 + grouping(l_linestatus) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "agg_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) * 2 + grouping(l_linestatus) AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "agg_grouping_sets": "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())",
    "agg_statistics": "SELECT c_mktsegment, round(stddev_samp(c_acctbal), 4) AS ss, round(stddev_pop(c_acctbal), 4) AS sp, round(var_samp(c_acctbal), 2) AS vs, round(var_pop(c_acctbal), 2) AS vp FROM customer GROUP BY c_mktsegment",
    "agg_regression": "SELECT round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_extendedprice), 2) AS cp, round(regr_slope(l_extendedprice, l_quantity), 4) AS sl FROM lineitem",
    "agg_boolean": "SELECT o_orderstatus, bool_and(o_totalprice > 1000) AS every_one, bool_or(o_totalprice > 499900) AS some FROM orders GROUP BY o_orderstatus",
    "agg_percentile_cont": "SELECT o_orderpriority, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY o_totalprice), 4) AS q1, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice), 4) AS med FROM orders GROUP BY o_orderpriority",
    "agg_percentile_disc": "SELECT o_orderpriority, percentile_disc(0.5) WITHIN GROUP (ORDER BY o_totalprice) AS med FROM orders GROUP BY o_orderpriority",
    "agg_mode": ("SELECT c_nationkey, mode() WITHIN GROUP (ORDER BY c_mktsegment) AS m FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, first(c_mktsegment ORDER BY n DESC, c_mktsegment) AS m FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) t GROUP BY c_nationkey"),
    "agg_hypothetical_rank": "SELECT c_mktsegment, count(*) FILTER (WHERE c_acctbal < 5000) + 1 AS rank_of_5000 FROM customer GROUP BY c_mktsegment",
    "agg_string": ("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey"),
    "agg_array": ("SELECT n_regionkey, array_join(sort_array(collect_list(n_nationkey)), ' ') AS keys FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list(n_nationkey ORDER BY n_nationkey), ' ') AS keys FROM nation GROUP BY n_regionkey"),
    "agg_array_with_nulls": ("SELECT array_join(transform(sort_array(collect_list(struct(i, a))), x -> coalesce(CAST(x.a AS STRING), 'NULL')), ',') AS s FROM (VALUES (1, 5), (2, NULL), (3, 7)) AS t(i, a)", "SELECT string_agg(coalesce(CAST(a AS VARCHAR), 'NULL'), ',' ORDER BY i) AS s FROM (VALUES (1, 5), (2, NULL), (3, 7)) AS t(i, a)"),
    "agg_null_groups": "SELECT k, count(*) AS n, count(v) AS nv, sum(v) AS s FROM (VALUES (1, 2.5), (NULL, 1.5), (NULL, NULL), (2, NULL)) AS t(k, v) GROUP BY k".replace("sum(v)", "CAST(sum(v) AS DOUBLE)"),
    # of equal balances DuckDB keeps the first row that it reads, and skips null keys; ~ turns the keys' order round without overflow
    "agg_min_max_by": ("SELECT c_nationkey, max_by(c_custkey, struct(c_acctbal, ~c_custkey)) FILTER (WHERE c_acctbal IS NOT NULL AND c_custkey IS NOT NULL) AS richest, min_by(c_custkey, struct(c_acctbal, c_custkey)) FILTER (WHERE c_acctbal IS NOT NULL AND c_custkey IS NOT NULL) AS poorest FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, max_by(c_custkey, c_acctbal) AS richest, min_by(c_custkey, c_acctbal) AS poorest FROM customer GROUP BY c_nationkey"),
    "agg_bits": "SELECT n_regionkey, bit_and(n_nationkey) AS ba, bit_or(n_nationkey) AS bo, bit_xor(n_nationkey) AS bx FROM nation GROUP BY n_regionkey",
    "agg_over_join": "SELECT r_name, count(DISTINCT s_suppkey) AS suppliers, round(avg(s_acctbal), 4) AS bal FROM region JOIN nation ON r_regionkey = n_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_name",
    "agg_functional_dependency": "SELECT c_custkey, max(c_name) AS c_name, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(o_orderkey) > 15",
    # windows
    "window_ranks": "SELECT c_custkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, round(percent_rank() OVER w, 8) AS pr, round(cume_dist() OVER w, 8) AS cd, ntile(4) OVER w AS nt FROM (SELECT c_custkey, c_nationkey, floor(c_acctbal / 500) AS b FROM customer) t WINDOW w AS (PARTITION BY c_nationkey ORDER BY b, c_custkey)",
    "window_ties": "SELECT c_custkey, rank() OVER w AS rk, dense_rank() OVER w AS dr, round(cume_dist() OVER w, 8) AS cd FROM (SELECT c_custkey, c_nationkey, floor(c_acctbal / 1000) AS b FROM customer) t WINDOW w AS (PARTITION BY c_nationkey ORDER BY b)",
    "window_lag_lead": "SELECT o_orderkey, lag(o_totalprice) OVER w AS p, lead(o_totalprice, 2) OVER w AS n, lag(o_totalprice, 1, CAST(0 AS DOUBLE)) OVER w AS d FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "window_values": "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS s FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "window_rows_frame": "SELECT l_orderkey, l_linenumber, l_partkey, round(sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS s FROM lineitem",
    "window_range_frame": "SELECT s_suppkey, count(*) OVER (ORDER BY s_acctbal RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) AS n FROM supplier",
    "window_range_interval": "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW) AS n FROM events",
    "window_running": "SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 2) AS total FROM events",
    "window_whole": "SELECT n_nationkey, count(*) OVER () AS n, CAST(sum(n_nationkey) OVER (PARTITION BY n_regionkey) AS BIGINT) AS s FROM nation",
    "window_groups_frame": ("SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey ORDER BY d RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM (SELECT c_custkey, c_nationkey, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY floor(c_acctbal / 1000)) AS d FROM customer) t", "SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey ORDER BY floor(c_acctbal / 1000) GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM customer"),
    "window_exclude_current": ("SELECT s_suppkey, round(sum(s_acctbal) OVER (PARTITION BY s_nationkey) - s_acctbal, 2) AS others FROM supplier", "SELECT s_suppkey, round(coalesce(sum(s_acctbal) OVER (PARTITION BY s_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW), 0), 2) AS others FROM supplier"),
    # sorting and limits
    "sort_nulls": "SELECT row_number() OVER (ORDER BY a DESC NULLS LAST, b ASC NULLS FIRST) AS pos, a, b FROM (VALUES (1, 'x'), (NULL, 'y'), (2, NULL), (2, 'z')) AS t(a, b)",
    "sort_top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "sort_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 10 OFFSET 100",
    "sort_knn": "SELECT s_suppkey FROM supplier ORDER BY abs(s_acctbal - 5000), s_suppkey LIMIT 7",
    # set operations
    "set_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "set_union_all": "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) t GROUP BY k",
    "set_intersect": "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9500 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
    "set_intersect_all": "SELECT a AS k FROM (VALUES (1), (1), (1), (2), (NULL)) AS x(a) INTERSECT ALL SELECT b FROM (VALUES (1), (1), (3), (NULL)) AS y(b)",
    "set_except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000",
    "set_except_all": "SELECT a AS k FROM (VALUES (1), (1), (1), (2)) AS x(a) EXCEPT ALL SELECT b FROM (VALUES (1), (3)) AS y(b)",
    "set_types_unified": "SELECT CAST(1 AS DOUBLE) AS v UNION ALL SELECT CAST(2 AS DOUBLE) UNION ALL SELECT 2.5",
}


def _sql(name: str, text: str):
    def run(spark, sf_dir):
        return query(spark, sf_dir, text)

    run.__name__ = name
    return run


def distinct_on(spark, sf_dir):
    """The newest order of each customer."""
    return ops.distinct_on(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


def fetch_with_ties(spark, sf_dir):
    return ops.fetch_with_ties(table(spark, sf_dir, "part"), 10, [F.desc("p_size")]).select("p_partkey", "p_size")


def semi_anti(spark, sf_dir):
    """Customers with orders and without, by semi and anti join."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_totalprice > 450000")
    on = c["c_custkey"] == o["o_custkey"]
    have = c.join(o, on, "left_semi").select("c_custkey", F.lit(True).alias("has"))
    return have.unionByName(c.join(o, on, "left_anti").select("c_custkey", F.lit(False).alias("has")))


def crosstab(spark, sf_dir):
    """Orders by status and priority, priorities as columns."""
    o = table(spark, sf_dir, "orders").withColumn("p", F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1)))
    return ops.crosstab(o, ["o_orderstatus"], "p", F.count(F.lit(1)), [f"p{i}" for i in range(1, 6)])


def upsert(spark, sf_dir):
    """INSERT ... ON CONFLICT DO UPDATE as an anti join and a union."""
    c = table(spark, sf_dir, "customer")
    base = c.where("c_mktsegment <> 'BUILDING'").select("c_custkey", "c_acctbal")
    new = c.where("c_acctbal > 5000").select("c_custkey", F.round(F.col("c_acctbal") + 100, 2).alias("c_acctbal"))
    return ops.upsert(base, new, ["c_custkey"])


def update_delete(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return ops.delete(ops.update(c, F.col("c_acctbal") < 0, {"c_acctbal": F.lit(0.0)}), F.col("c_mktsegment") == "BUILDING")


def asof(spark, sf_dir):
    """Each purchase with the latest click of the same user before it."""
    e = table(spark, sf_dir, "events")
    buys = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    clicks = e.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"))
    return ops.asof_join(buys, clicks, ["user_id"], "ts", ["click_id"]).select("event_id", "click_id")


def salted_aggregate(spark, sf_dir):
    """A count of distinct values by a hot key, in two stages."""
    return ops.salted_count_distinct(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_partkey", "parts", 16)


def salted_join(spark, sf_dir):
    l, p = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity"), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    return ops.salted_join(l, p, ["l_partkey"], 4).groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


def connect_by(spark, sf_dir):
    """A hierarchy walked from its root, with levels and branches."""
    tree = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") > 0, F.floor((F.col("n_nationkey") - 1) / 3)).cast("int").alias("parent"))
    return ops.connect_by(tree, "id", "parent", 0, max_depth=10)


def moving_average(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.sum("value").alias("v"))
    w = Window.orderBy("day").rowsBetween(-6, 0)  # one row a day
    return d.select("day", F.round(F.avg("v").over(w), 4).alias("avg7"))


FRAMES = (distinct_on, fetch_with_ties, semi_anti, crosstab, upsert, update_delete, asof, salted_aggregate, salted_join, connect_by, moving_average)
QUERIES = (*(_sql(n, s if isinstance(s, str) else s[0]) for n, s in SQL.items()), *FRAMES)
ORACLE = {n: s if isinstance(s, str) else s[1] for n, s in SQL.items()} | {
    "distinct_on": "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC",
    "fetch_with_ties": "SELECT p_partkey, p_size FROM part QUALIFY rank() OVER (ORDER BY p_size DESC) <= 10",
    "semi_anti": "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000) AS has FROM customer",
    "crosstab": "SELECT o_orderstatus, " + ", ".join(f"nullif(count(*) FILTER (o_orderpriority LIKE '{i}%'), 0) AS p{i}" for i in range(1, 6)) + " FROM orders GROUP BY o_orderstatus",
    "upsert": "SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN round(c_acctbal + 100, 2) ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_acctbal > 5000",
    "update_delete": "SELECT c_custkey, c_mktsegment, greatest(c_acctbal, 0) AS c_acctbal FROM customer WHERE c_mktsegment <> 'BUILDING'",
    "asof": "SELECT b.event_id, c.event_id AS click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') b ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON b.user_id = c.user_id AND b.ts >= c.ts",
    "salted_aggregate": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag",
    "salted_join": "SELECT p_type, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type",
    "connect_by": "WITH RECURSIVE t AS (SELECT 0 AS id, NULL::INT AS parent, 0 AS level, '0' AS branch UNION ALL SELECT n.n_nationkey, CAST(floor((n.n_nationkey - 1) / 3) AS INT), t.level + 1, t.branch || '~' || n.n_nationkey FROM nation n JOIN t ON n.n_nationkey > 0 AND floor((n.n_nationkey - 1) / 3) = t.id) SELECT id, parent, level, branch FROM t",
    "moving_average": "SELECT strftime(d, '%Y-%m-%d') AS day, round(avg(v) OVER (ORDER BY d ROWS 6 PRECEDING), 4) AS avg7 FROM (SELECT CAST(ts AS DATE) AS d, sum(value) AS v FROM events GROUP BY 1) t",
}
