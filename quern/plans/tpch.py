"""The decision-support queries of the reference, on the driver's tables.

Columns and the partsupp table that those tables lack are derived from keys by fixed arithmetic, as common table
expressions that Spark and the oracle both run.
"""

from __future__ import annotations

from quern.sources.tables import query

# Derived columns; every expression has the same meaning in both dialects.
LINES = """li AS (SELECT l.*, CAST(l_shipdate AS DATE) AS shipdate, CAST(l_shipdate AS DATE) + CAST((l_orderkey * 7 + l_linenumber) % 60 - 30 AS INT) AS l_commitdate,
    CAST(l_shipdate AS DATE) + CAST(1 + l_partkey % 30 AS INT) AS l_receiptdate,
    CASE (l_linenumber + l_orderkey) % 7 WHEN 0 THEN 'AIR' WHEN 1 THEN 'MAIL' WHEN 2 THEN 'SHIP' WHEN 3 THEN 'RAIL' WHEN 4 THEN 'TRUCK' WHEN 5 THEN 'FOB' ELSE 'AIR REG' END AS l_shipmode,
    CASE l_orderkey % 4 WHEN 0 THEN 'DELIVER IN PERSON' WHEN 1 THEN 'COLLECT COD' WHEN 2 THEN 'NONE' ELSE 'TAKE BACK RETURN' END AS l_shipinstruct FROM lineitem l)"""
PARTSUPP = """ps AS (SELECT DISTINCT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, (l_partkey * 31 + l_suppkey * 17) % 9999 + 1 AS ps_availqty,
    ((l_partkey * 13 + l_suppkey * 7) % 100000) / CAST(100 AS DOUBLE) + 1 AS ps_supplycost FROM lineitem)"""
PARTS = """pt AS (SELECT p.*, CASE p_partkey % 5 WHEN 0 THEN 'SM CASE' WHEN 1 THEN 'MED BOX' WHEN 2 THEN 'LG CASE' WHEN 3 THEN 'MED BAG' ELSE 'JUMBO JAR' END AS p_container,
    concat('Manufacturer#', CAST(1 + p_partkey % 5 AS VARCHAR(2))) AS p_mfgr FROM part p)"""
CUSTOMERS = "cu AS (SELECT c.*, concat(CAST(10 + c_custkey % 25 AS VARCHAR(2)), '-', CAST(100 + c_custkey % 900 AS VARCHAR(3))) AS c_phone FROM customer c)"
ORDERS = "od AS (SELECT o.*, CASE WHEN o_orderkey % 11 = 0 THEN 'special handling requests' ELSE 'quiet deposits' END AS o_comment FROM orders o)"
REVENUE = "l_extendedprice * (1 - l_discount)"

SQL = {
    "tpch_q1": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus",
    "tpch_q2": f"WITH {PARTSUPP} SELECT s_acctbal, s_name, n_name, p_partkey, p_brand FROM part JOIN ps ON p_partkey = ps_partkey JOIN supplier ON s_suppkey = ps_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE p_size < 25 AND p_type LIKE '%O' AND r_regionkey = 2 AND ps_supplycost = (SELECT min(x.ps_supplycost) FROM ps x JOIN supplier s2 ON s2.s_suppkey = x.ps_suppkey JOIN nation n2 ON s2.s_nationkey = n2.n_nationkey WHERE p_partkey = x.ps_partkey AND n2.n_regionkey = 2) ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100",
    "tpch_q3": f"SELECT l_orderkey, round(sum({REVENUE}), 4) AS revenue, CAST(o_orderdate AS DATE) AS o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10",
    "tpch_q4": f"WITH {LINES} SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= TIMESTAMP '1997-07-01' AND o_orderdate < TIMESTAMP '1997-10-01' AND EXISTS (SELECT * FROM li WHERE l_orderkey = o_orderkey AND l_commitdate < l_receiptdate) GROUP BY o_orderpriority ORDER BY o_orderpriority",
    "tpch_q5": f"SELECT n_name, round(sum({REVENUE}), 4) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 2 GROUP BY n_name ORDER BY revenue DESC",
    "tpch_q6": "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND l_discount BETWEEN 0.05 - 0.01001 AND 0.05 + 0.01001 AND l_quantity < 24",
    "tpch_q7": f"SELECT supp_nation, cust_nation, l_year, round(sum(volume), 4) AS revenue FROM (SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(extract(year FROM l_shipdate) AS INT) AS l_year, {REVENUE} AS volume FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey WHERE (n1.n_nationkey < 5 AND n2.n_nationkey > 19) OR (n1.n_nationkey > 19 AND n2.n_nationkey < 5)) shipping GROUP BY supp_nation, cust_nation, l_year",
    "tpch_q8": f"SELECT o_year, round(sum(CASE WHEN nation = 'NATION_3' THEN volume ELSE 0 END) / sum(volume), 8) AS mkt_share FROM (SELECT CAST(extract(year FROM o_orderdate) AS INT) AS o_year, {REVENUE} AS volume, n2.n_name AS nation FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN region ON n1.n_regionkey = r_regionkey JOIN nation n2 ON s_nationkey = n2.n_nationkey WHERE r_regionkey = 1 AND p_type = 'PROMO') all_nations GROUP BY o_year",
    "tpch_q9": f"WITH {PARTSUPP} SELECT nation, o_year, round(sum(amount), 4) AS sum_profit FROM (SELECT n_name AS nation, CAST(extract(year FROM o_orderdate) AS INT) AS o_year, {REVENUE} - ps_supplycost * l_quantity AS amount FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN ps ON ps_suppkey = l_suppkey AND ps_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey WHERE p_name LIKE '%red%') profit GROUP BY nation, o_year",
    "tpch_q10": f"SELECT c_custkey, c_name, round(sum({REVENUE}), 4) AS revenue, c_acctbal, n_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1997-10-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND l_returnflag = 'R' GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20",
    "tpch_q11": f"WITH {PARTSUPP} SELECT ps_partkey, round(sum(ps_supplycost * ps_availqty), 2) AS value FROM ps JOIN supplier ON ps_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey < 5 GROUP BY ps_partkey HAVING sum(ps_supplycost * ps_availqty) > (SELECT sum(ps_supplycost * ps_availqty) * 0.0001 FROM ps)",
    "tpch_q12": f"WITH {LINES} SELECT l_shipmode, sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN CAST(1 AS BIGINT) ELSE 0 END)  AS high_line_count, sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN CAST(1 AS BIGINT) ELSE 0 END) AS low_line_count FROM orders JOIN li ON o_orderkey = l_orderkey WHERE l_shipmode IN ('MAIL', 'SHIP') AND l_commitdate < l_receiptdate AND shipdate < l_commitdate AND l_receiptdate >= DATE '1997-01-01' AND l_receiptdate < DATE '1998-01-01' GROUP BY l_shipmode ORDER BY l_shipmode",
    "tpch_q13": f"WITH {ORDERS} SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT OUTER JOIN od ON c_custkey = o_custkey AND o_comment NOT LIKE '%special%requests%' GROUP BY c_custkey) c_orders GROUP BY c_count ORDER BY custdist DESC, c_count DESC",
    "tpch_q14": f"SELECT round(100.00 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {REVENUE} ELSE 0 END) / sum({REVENUE}), 6) AS promo_revenue FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1997-09-01' AND l_shipdate < TIMESTAMP '1997-10-01'",
    "tpch_q15": f"WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum({REVENUE}), 4) AS total_revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-04-01' GROUP BY l_suppkey) SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN revenue ON s_suppkey = supplier_no WHERE total_revenue = (SELECT max(total_revenue) FROM revenue) ORDER BY s_suppkey",
    "tpch_q16": f"WITH {PARTSUPP} SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM ps JOIN part ON p_partkey = ps_partkey WHERE p_brand <> 'Brand#45' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9) AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size",
    "tpch_q17": f"WITH {PARTS} SELECT round(sum(l_extendedprice) / 7.0, 4) AS avg_yearly FROM lineitem JOIN pt ON p_partkey = l_partkey WHERE p_container = 'MED BOX' AND l_quantity < (SELECT 0.5 * avg(l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)",
    "tpch_q18": "SELECT c_name, c_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice, round(sum(l_quantity), 2) AS sum_qty FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100",
    "tpch_q19": f"WITH {LINES}, {PARTS} SELECT round(sum({REVENUE}), 4) AS revenue FROM li JOIN pt ON p_partkey = l_partkey WHERE (p_container IN ('SM CASE', 'MED BAG') AND l_quantity >= 1 AND l_quantity <= 11 AND p_size BETWEEN 1 AND 15 AND l_shipmode IN ('AIR', 'AIR REG')) OR (p_container IN ('MED BOX', 'MED BAG') AND l_quantity >= 10 AND l_quantity <= 20 AND p_size BETWEEN 1 AND 30 AND l_shipinstruct = 'DELIVER IN PERSON') OR (p_container = 'LG CASE' AND l_quantity >= 20 AND l_quantity <= 30 AND l_shipmode IN ('AIR', 'AIR REG'))",
    "tpch_q20": f"WITH {PARTSUPP} SELECT s_name, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey IN (SELECT ps_suppkey FROM ps WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE '%red%') AND ps_availqty > (SELECT 0.5 * sum(l_quantity) FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1999-01-01')) AND n_nationkey < 10 ORDER BY s_name",
    "tpch_q21": f"WITH {LINES} SELECT s_name, count(*) AS numwait FROM supplier JOIN li l1 ON s_suppkey = l1.l_suppkey JOIN orders ON o_orderkey = l1.l_orderkey JOIN nation ON s_nationkey = n_nationkey WHERE o_orderstatus = 'F' AND l1.l_receiptdate > l1.l_commitdate AND EXISTS (SELECT * FROM li l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey) AND NOT EXISTS (SELECT * FROM li l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_receiptdate > l3.l_commitdate) AND n_nationkey < 12 GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100",
    "tpch_q22": f"WITH {CUSTOMERS} SELECT cntrycode, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM (SELECT substring(c_phone, 1, 2) AS cntrycode, c_acctbal FROM cu WHERE substring(c_phone, 1, 2) IN ('13', '31', '23', '29', '30', '18', '17') AND c_acctbal > (SELECT avg(c_acctbal) FROM cu WHERE c_acctbal > 0 AND substring(c_phone, 1, 2) IN ('13', '31', '23', '29', '30', '18', '17')) AND NOT EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 3 = 0)) custsale GROUP BY cntrycode ORDER BY cntrycode",
}
# Variants: the same questions with other constructs.
SQL["tpch_q8a"] = SQL["tpch_q8"].replace("CASE WHEN nation = 'NATION_3' THEN volume ELSE 0 END", "CASE nation WHEN 'NATION_3' THEN volume ELSE 0 END")
SQL["tpch_q12a"] = SQL["tpch_q12"].replace("CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN CAST(1 AS BIGINT) ELSE 0 END", "CASE o_orderpriority WHEN '1-URGENT' THEN CAST(1 AS BIGINT) WHEN '2-HIGH' THEN 1 ELSE 0 END")
SQL["tpch_q13a"] = f"WITH {ORDERS}, per AS (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT OUTER JOIN od ON c_custkey = o_custkey AND o_comment NOT LIKE '%special%requests%' GROUP BY c_custkey) SELECT c_count, count(*) AS custdist FROM per GROUP BY c_count"
SQL["tpch_q14a"] = f"SELECT round(100.00 * sum({REVENUE}) FILTER (WHERE p_type LIKE 'PROMO%') / sum({REVENUE}), 6) AS promo_revenue FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1997-09-01' AND l_shipdate < TIMESTAMP '1997-10-01'"
SQL["tpch_q15a"] = f"SELECT s_suppkey, s_name, total_revenue FROM (SELECT l_suppkey, round(sum({REVENUE}), 4) AS total_revenue, rank() OVER (ORDER BY round(sum({REVENUE}), 4) DESC) AS r FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-04-01' GROUP BY l_suppkey) x JOIN supplier ON s_suppkey = l_suppkey WHERE r = 1"


def _query(name: str, sql: str):
    def run(spark, sf_dir):
        return query(spark, sf_dir, sql)

    run.__name__ = name
    return run


QUERIES = tuple(_query(n, s) for n, s in SQL.items())


def _duck(sql: str) -> str:
    """Sums of integers are HUGEINT in the oracle's engine; the contract compares BIGINT."""
    import re

    return re.sub(r"(sum\(CASE .*?END\))\s+AS (\w+)", r"CAST(\1 AS BIGINT) AS \2", sql) if "_line_count" in sql else sql


ORACLE = {n: _duck(s) for n, s in SQL.items()}
