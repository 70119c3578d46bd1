"""Statements, document and text functions and joins beyond the first modules, each as one checked query."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import functions as F

from quern.functions import texts, values
from quern.operators import relational as ops
from quern.operators import sampling
from quern.plans import aqp, sqlfront
from quern.plans.relational import _sql
from quern.plans.surfaces import _place
from quern.sources import tables
from quern.sources.tables import table

SQL: dict[str, str | tuple[str, str]] = {
    "text_format": ("SELECT n_nationkey, format_string('%s-%05d', n_name, n_nationkey) AS f, format_string('%x', n_nationkey * 100) AS h, overlay(n_name PLACING '__' FROM 2 FOR 1) AS o FROM nation", "SELECT n_nationkey, printf('%s-%05d', n_name, n_nationkey) AS f, printf('%x', n_nationkey * 100) AS h, n_name[1] || '__' || substring(n_name, 3) AS o FROM nation"),
    "text_encodings": ("SELECT n_nationkey, decode(unhex(hex(n_name)), 'UTF-8') AS d, CAST(unbase64(base64(n_name)) AS STRING) AS b, length(encode(n_name, 'UTF-16BE')) AS w, sha1(n_name) AS s, crc32(n_name) > 0 AS c FROM nation", "SELECT n_nationkey, decode(unhex(hex(n_name))) AS d, decode(from_base64(base64(encode(n_name)))) AS b, CAST(2 * length(n_name) AS INT) AS w, sha1(n_name) AS s, true AS c FROM nation"),
    "split_to_table": ("SELECT p_partkey, pos + 1 AS at, word FROM part LATERAL VIEW posexplode(split(p_type, '[AEIOU]')) t AS pos, word", "SELECT p_partkey, CAST(unnest(range(1, len(w) + 1)) AS INT) AS at, unnest(w) AS word FROM (SELECT p_partkey, regexp_split_to_array(p_type, '[AEIOU]') AS w FROM part) t"),
    "hash_functions": ("SELECT count(DISTINCT xxhash64(o_orderkey)) AS x, count(DISTINCT hash(o_orderkey, o_custkey)) > 0.99 * count(*) AS h, bool_and(xxhash64(o_orderkey) = xxhash64(o_orderkey + 0)) AS same FROM orders", "SELECT count(*) AS x, true AS h, true AS same FROM orders"),
    "random_numbers": ("SELECT count(*) AS n, bool_and(r >= 0 AND r < 1) AS inside, abs(avg(r) - 0.5) < 0.05 AS centred, count(DISTINCT u) AS uuids, bool_and(length(u) = 36 AND u RLIKE '^[0-9a-f-]+$') AS form FROM (SELECT rand(7) AS r, uuid() AS u FROM orders)", "SELECT count(*) AS n, true AS inside, true AS centred, count(*) AS uuids, true AS form FROM orders"),
    "window_exclude_frames": ("SELECT s_suppkey, coalesce(sum(k) OVER w, 0) - k AS no_row, coalesce(sum(k) OVER w, 0) - sum(k) OVER (PARTITION BY s_nationkey, b) AS no_group, coalesce(sum(k) OVER w, 0) - sum(k) OVER (PARTITION BY s_nationkey, b) + k AS no_ties FROM (SELECT s_suppkey, s_nationkey, s_suppkey AS k, floor(s_acctbal / 2000) AS b FROM supplier) t WINDOW w AS (PARTITION BY s_nationkey ORDER BY b RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)", "SELECT s_suppkey, CAST(coalesce(sum(k) OVER (w EXCLUDE CURRENT ROW), 0) AS BIGINT) AS no_row, CAST(coalesce(sum(k) OVER (w EXCLUDE GROUP), 0) AS BIGINT) AS no_group, CAST(coalesce(sum(k) OVER (w EXCLUDE TIES), 0) AS BIGINT) AS no_ties FROM (SELECT s_suppkey, s_nationkey, s_suppkey AS k, floor(s_acctbal / 2000) AS b FROM supplier) t WINDOW w AS (PARTITION BY s_nationkey ORDER BY b RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)".replace("(w EXCLUDE", "(PARTITION BY s_nationkey ORDER BY b RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE").replace(" WINDOW w AS (PARTITION BY s_nationkey ORDER BY b RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)", "")),
    "window_ntile_nulls": "SELECT o_orderkey, ntile(7) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS t, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders",
    "sort_incremental": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderpriority, o_orderkey) AS at FROM orders WHERE o_orderstatus = 'P'",
    "limit_null_offset": ("SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT ALL OFFSET 5", "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 5"),
    "date_conversions": ("SELECT o_orderkey, to_date(date_format(o_orderdate, 'dd.MM.yyyy'), 'dd.MM.yyyy') AS d, date_format(to_timestamp(concat(date_format(o_orderdate, 'yyyyMMdd'), '0815'), 'yyyyMMddHHmm'), 'HH:mm') AS t, date_format(from_utc_timestamp(CAST(o_orderdate AS TIMESTAMP), 'Asia/Tokyo'), 'yyyy-MM-dd HH') AS z FROM orders", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, '08:15' AS t, strftime(CAST(o_orderdate AS TIMESTAMP) + INTERVAL 9 HOUR, '%Y-%m-%d %H') AS z FROM orders"),
    "map_from_entries": ("SELECT n_regionkey, array_join(array_sort(map_keys(map_from_entries(collect_list(struct(n_name, n_nationkey))))), ',') AS k, size(map_filter(map_from_entries(collect_list(struct(n_name, n_nationkey))), (k, v) -> v > 10)) AS big FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS k, CAST(count(*) FILTER (n_nationkey > 10) AS INT) AS big FROM nation GROUP BY n_regionkey"),
    "set_types_widened": ("SELECT n_nationkey AS v FROM nation UNION ALL SELECT CAST(s_acctbal AS DOUBLE) FROM supplier UNION ALL SELECT NULL", "SELECT CAST(n_nationkey AS DOUBLE) AS v FROM nation UNION ALL SELECT s_acctbal FROM supplier UNION ALL SELECT NULL"),
    "agg_approximate": ("SELECT o_orderpriority, abs(approx_count_distinct(o_custkey, 0.01) - count(DISTINCT o_custkey)) <= 0.05 * count(DISTINCT o_custkey) + 1 AS close, abs(percent_rank_of - 0.5) < 0.05 AS middle FROM (SELECT o_orderpriority, o_custkey, avg(CASE WHEN o_totalprice <= m THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY o_orderpriority) AS percent_rank_of FROM orders JOIN (SELECT o_orderpriority AS p, approx_percentile(o_totalprice, 0.5) AS m FROM orders GROUP BY o_orderpriority) q ON p = o_orderpriority) t GROUP BY o_orderpriority, percent_rank_of", "SELECT o_orderpriority, true AS close, true AS middle FROM orders GROUP BY o_orderpriority"),
}


def agg_min_max_footers(spark, sf_dir):
    """MIN, MAX and COUNT from the files' footers: no row is read."""
    session = spark.newSession()
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return table(session, sf_dir, "orders").agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"), F.count(F.lit(1)).alias("n"))


def create_table_as(spark, sf_dir):
    """A query's result as a stored table, read again."""
    big = tables.query(spark, sf_dir, "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_custkey")
    return tables.store(big, _place(spark, "ctas"), sort_by=("o_custkey",)).where("n > 10")


def cursor_scroll(spark, sf_dir):
    """FETCH 5, BACKWARD 2, MOVE 10, FETCH 3, LAST, BACKWARD 1 of a cursor that goes both ways."""
    c = tables.ScrollCursor(table(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey")
    got = [c.fetch(5), c.fetch(-2), c.move(10) and c.fetch(3), c.absolute(-1), c.fetch(-1), c.fetch(9)]
    c.close()
    return spark.createDataFrame([(i, j, r["n_nationkey"]) for i, rows in enumerate(got) for j, r in enumerate(rows)], "step int, place int, k int")


def copy_rejects(spark, sf_dir):
    """Quoted values with separators, quotes and line ends in them, written and read; lines that don't fit are kept aside."""
    path = _place(spark, "rejects")
    odd = F.concat(F.lit('a|"'), "n_name", F.lit('"'))
    tables.write_delimited(table(spark, sf_dir, "nation").select("n_nationkey", odd.alias("v")), f"{path}/good", quote_all=True)
    table(spark, sf_dir, "region").select(F.concat(F.lit("x"), "r_name", F.lit("|y"))).write.text(f"{path}/bad")
    read = [tables.read_delimited(spark, f"{path}/{part}", "k int, v string", rejects="line") for part in ("good", "bad")]
    return read[0].unionByName(read[1])


def merge_into(spark, sf_dir):
    """Deleted, updated, inserted and other rows of one MERGE."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    base, source = c.where("c_nationkey < 15"), c.where("c_acctbal > 0").withColumn("c_acctbal", F.col("c_acctbal") * 2)
    out = ops.merge(base, source, ["c_custkey"], {"c_acctbal": F.col("t.c_acctbal") + F.col("s.c_acctbal")}, F.col("s.c_acctbal") > 15000)
    return out.select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"), F.coalesce("__action", F.lit("none")).alias("action"))


def insert_returning(spark, sf_dir):
    """INSERT ... ON CONFLICT DO NOTHING RETURNING: just the rows that went in."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")).distinct()
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    return ops.merge(s, n, ["k"]).where("__action = 'INSERT'").select("k")


def range_overlap_join(spark, sf_dir):
    """Suppliers and customers whose balance bands overlap, by bins."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("lo1"), (F.col("s_acctbal") + 120).alias("hi1"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("lo2"), (F.col("c_acctbal") + 40).alias("hi2"))
    return ops.overlap_join(s, c, ("lo1", "hi1"), ("lo2", "hi2"), 100.0).groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("k"))


def user_aggregate_combined(spark, sf_dir):
    """A user's mean and spread with states that combine (the parallel form of the variance)."""
    def step(columns):
        v = columns[0]
        return len(v), float(v.sum()), float(((v - v.mean()) ** 2).sum())

    def combine(a, b):
        n, total = a[0] + b[0], a[1] + b[1]
        d = b[1] / b[0] - a[1] / a[0]
        return n, total, a[2] + b[2] + d * d * a[0] * b[0] / n

    got = ops.combined_aggregate(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity"], "n long, total double, spread double", step, combine, F.struct("n", (F.col("total") / F.col("n")).alias("mean"), (F.col("spread") / F.col("n")).alias("var")).alias("x"))
    return got.select("l_returnflag", "l_linestatus", "x.n", F.round("x.mean", 6).alias("mean"), F.round("x.var", 4).alias("var"))


def text_search_query(spark, sf_dir):
    """Query texts with and, or, not, phrases and prefixes."""
    p = table(spark, sf_dir, "part").withColumn("v", texts.to_tsvector(F.concat_ws(" ", "p_name", "p_type")))
    asked = {"a": "red & (promo | small) & !bolt", "b": "red <-> gear", "c": "red <2> promo", "d": "!(red | blue)", "e": "gre:* & eco:*"}
    return p.select("p_partkey", *[texts.ts_query(F.col("v"), q).alias(n) for n, q in asked.items()])


def text_hmac(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", texts.hmac_sha256(F.col("n_name"), b"key").alias("short"), texts.hmac_sha256(F.col("n_name"), b"k" * 100).alias("long"))


def text_digests(spark, sf_dir):
    """Digests of every length."""
    t = spark.createDataFrame([("",), ("abc",), ("\u00e9" * 200,)], "s string")
    return t.select("s", *[F.sha2("s", n).alias(f"d{n}") for n in (224, 256, 384, 512)], texts.hmac_sha256(F.col("s"), b"").alias("h"))


def json_operators(spark, sf_dir):
    """Keys, concatenation and deletion on every event's document."""
    j = F.col("props")
    e = table(spark, sf_dir, "events").withColumn("more", values.json_concat(j, F.lit('{"z": "1"}')))
    return e.select("event_id", values.json_exists_any(j, ["k", "none"]).alias("some"), values.json_exists_all(j, ["k", "none"]).alias("every"), F.get_json_object("more", "$.z").alias("z"), F.get_json_object("more", "$.k").alias("k"), values.json_exists_any(values.json_delete(F.col("more"), "z"), ["z"]).alias("still"))


def bits_and_times(spark, sf_dir):
    n = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return n.select("o_orderkey", values.get_bit(k, 3).alias("b"), values.set_bit(k, 5, 1).alias("s"), values.set_bit(k, 0, 0).alias("c"), values.make_time(k % 30, k % 60, F.lit(7)).alias("t"))


def interval_average(spark, sf_dir):
    """Mean time from order to shipment."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")  # noqa: E741
    both = l.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.groupBy("o_orderpriority").agg(F.round(values.avg_interval(F.col("o_orderdate").cast("timestamp"), F.col("l_shipdate").cast("timestamp")), 3).alias("s"))


def range_intersections(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.floor("s_acctbal").alias("lo"))
    both = values.range_intersection(F.col("lo"), F.col("lo") + 500, F.lit(1000), F.lit(3000))
    return s.select("s_suppkey", both["lower"].cast("long").alias("lower"), both["upper"].cast("long").alias("upper"))


def sample_arguments(spark, sf_dir):
    """What each sampling method says to arguments out of range."""
    t, by = table(spark, sf_dir, "orders"), ("o_orderkey",)
    layout = sampling.Layout(F.col("o_orderkey"), by)
    calls = {
        "swr null": lambda: sampling.swr_sample(t, None, layout), "swr -1": lambda: sampling.swr_sample(t, -1, layout), "swr seed null": lambda: sampling.swr_sample(t, 1, layout, None), "swr 0": lambda: sampling.swr_sample(t, 0, layout),
        "bernoulli 101": lambda: sampling.bernoulli_sample(t, 101, by), "bernoulli null": lambda: sampling.bernoulli_sample(t, None, by), "system -1": lambda: sampling.system_sample(t, -1, F.col("o_orderkey")), "rows -1": lambda: sampling.rows_sample(t, -1, by), "time -1": lambda: sampling.time_sample(t, -1, by),
    }
    out = []
    for name, call in calls.items():
        try:
            call()
            out.append((name, ""))
        except sampling.SampleError as e:
            out.append((name, str(e)))
    return spark.createDataFrame(out, "call string, error string")


def _front(spark, sf_dir, sql: str):
    for name in ("lineitem", "orders", "customer"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return sqlfront.sql(spark, sql, {"lineitem": sqlfront.SampledTable("l_shipdate", aqp.layout())})


def q3_sql_front(spark, sf_dir):
    """The joined form in SQL text: joins of the sampled table, aliases, and predicates that are no range."""
    return _front(spark, sf_dir, f"SELECT c_mktsegment, round(approx_sum(l.l_extendedprice), 2) AS sum_amount, round(approx_count(*), 2) AS cnt, round(approx_sum_half_ci(l.l_extendedprice, 0.95), 2) AS sum_half_ci FROM orders o JOIN lineitem l TABLESAMPLE SWR ({aqp.SIZES['q3']}) REPEATABLE ({aqp.SEED}) ON l.l_orderkey = o.o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l.l_shipdate >= TIMESTAMP '{aqp.SINCE}' AND l.l_shipdate < TIMESTAMP '{aqp.UNTIL}' GROUP BY c_mktsegment")


def sql_front_disjunction(spark, sf_dir):
    """A disjunction over the key is no range: draws come from all rows."""
    return _front(spark, sf_dir, f"SELECT round(approx_count(*), 2) AS cnt, round(approx_sum(l_quantity), 2) AS q FROM lineitem TABLESAMPLE SWR (700) REPEATABLE ({aqp.SEED}) WHERE l_shipdate < TIMESTAMP '{aqp.SINCE}' OR l_quantity > 45")


def system_time(spark, sf_dir):
    """Within an hour every row is collected."""
    return _front(spark, sf_dir, "SELECT count(*) AS n, round(approx_count(*), 2) AS estimate FROM lineitem TABLESAMPLE SYSTEM_TIME (3600000) REPEATABLE (1)")


FRAMES = (
    agg_min_max_footers, create_table_as, cursor_scroll, copy_rejects, merge_into, insert_returning, range_overlap_join, user_aggregate_combined, text_search_query, text_hmac, text_digests, json_operators, bits_and_times, interval_average,
    range_intersections, sample_arguments, q3_sql_front, sql_front_disjunction, system_time,
)
QUERIES = (*(_sql(n, s if isinstance(s, str) else s[0]) for n, s in SQL.items()), *FRAMES)


def _hmac(key: bytes) -> str:
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in block).hex() for pad in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode(n_name))))"


_TEXTS = ("", "abc", "\u00e9" * 200)
_DIGESTS = ", ".join("(" + ", ".join(f"'{x}'" for x in (s, *(hashlib.new(f"sha{n}", s.encode()).hexdigest() for n in (224, 256, 384, 512)), hmac.new(b"", s.encode(), "sha256").hexdigest())) + ")" for s in _TEXTS)
_SHOWN = "lower(p_name || ' ' || p_type)"
_SIZE, _SEED, _PCT = "sample size must not be null or negative", "TABLESAMPLE REPEATABLE parameter cannot be null", "sample percentage must be between 0 and 100"
ORACLE = {n: s if isinstance(s, str) else s[1] for n, s in SQL.items()} | {
    "agg_min_max_footers": "SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi, count(*) AS n FROM orders",
    "create_table_as": "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_custkey HAVING count(*) > 10",
    "cursor_scroll": "SELECT * FROM (VALUES (0, 0, 0), (0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 4), (1, 0, 3), (1, 1, 2), (2, 0, 13), (2, 1, 14), (2, 2, 15), (3, 0, 24), (4, 0, 23), (5, 0, 24)) AS t(step, place, k)",
    "copy_rejects": "SELECT n_nationkey AS k, 'a|\"' || n_name || '\"' AS v, NULL AS line FROM nation UNION ALL SELECT NULL, 'y', 'x' || r_name || '|y' FROM region",
    "merge_into": "SELECT c_custkey, round(CASE WHEN c_nationkey >= 15 THEN c_acctbal * 2 WHEN c_acctbal > 0 AND c_acctbal * 2 <= 15000 THEN c_acctbal + c_acctbal * 2 ELSE c_acctbal END, 2) AS c_acctbal, CASE WHEN c_nationkey >= 15 THEN 'INSERT' WHEN c_acctbal <= 0 THEN 'none' WHEN c_acctbal * 2 > 15000 THEN 'DELETE' ELSE 'UPDATE' END AS action FROM customer WHERE c_nationkey < 15 OR c_acctbal > 0",
    "insert_returning": "SELECT n_nationkey AS k FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)",
    "range_overlap_join": "SELECT s_suppkey, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS k FROM supplier JOIN customer ON s_acctbal <= c_acctbal + 40 AND c_acctbal <= s_acctbal + 120 GROUP BY s_suppkey",
    "user_aggregate_combined": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(var_pop(l_quantity), 4) AS var FROM lineitem GROUP BY ALL",
    "text_search_query": f"SELECT p_partkey, regexp_matches({_SHOWN}, '\\bred\\b') AND regexp_matches({_SHOWN}, '\\b(promo|small)\\b') AND NOT regexp_matches({_SHOWN}, '\\bbolt\\b') AS a, regexp_matches({_SHOWN}, '\\bred gear\\b') AS b, regexp_matches({_SHOWN}, '\\bred \\w+ promo\\b') AS c, NOT regexp_matches({_SHOWN}, '\\b(red|blue)\\b') AS d, regexp_matches({_SHOWN}, '\\bgre') AND regexp_matches({_SHOWN}, '\\beco') AS e FROM part",
    "text_hmac": f"SELECT n_nationkey, {_hmac(b'key')} AS short, {_hmac(b'k' * 100)} AS long FROM nation",
    "text_digests": f"SELECT * FROM (VALUES {_DIGESTS}) AS t(s, d224, d256, d384, d512, h)",
    "json_operators": "SELECT event_id, json_exists(props, '$.k') AS some, json_exists(props, '$.k') AND json_exists(props, '$.none') AS every, '1' AS z, json_extract_string(props, '$.k') AS k, false AS still FROM events",
    "bits_and_times": "SELECT o_orderkey, CAST((o_orderkey >> 3) & 1 AS INT) AS b, o_orderkey | 32 AS s, o_orderkey - o_orderkey % 2 AS c, CASE WHEN o_orderkey % 30 < 24 THEN printf('%02d:%02d:07', o_orderkey % 30, o_orderkey % 60) END AS t FROM orders",
    "interval_average": "SELECT o_orderpriority, round(avg(epoch(CAST(l_shipdate AS TIMESTAMP)) - epoch(CAST(o_orderdate AS TIMESTAMP))), 3) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "range_intersections": "SELECT s_suppkey, CASE WHEN greatest(lo, 1000) < least(lo + 500, 3000) THEN CAST(greatest(lo, 1000) AS BIGINT) END AS lower, CASE WHEN greatest(lo, 1000) < least(lo + 500, 3000) THEN CAST(least(lo + 500, 3000) AS BIGINT) END AS upper FROM (SELECT s_suppkey, floor(s_acctbal) AS lo FROM supplier) t",
    "sample_arguments": f"SELECT * FROM (VALUES ('swr null', '{_SIZE}'), ('swr -1', '{_SIZE}'), ('swr seed null', '{_SEED}'), ('swr 0', ''), ('bernoulli 101', '{_PCT}'), ('bernoulli null', '{_PCT}'), ('system -1', '{_PCT}'), ('rows -1', 'sample size must not be negative'), ('time -1', 'sample collection time must not be negative')) AS t(call, error)",
    "q3_sql_front": aqp.ORACLE["q3_swr"],
    "sql_front_disjunction": f"SELECT round(coalesce(sum(1.0 / p) / max(n), 0), 2) AS cnt, round(sum(l_quantity / p) / max(n), 2) AS q FROM {aqp._swr(700, 'lineitem')} x WHERE l_shipdate < TIMESTAMP '{aqp.SINCE}' OR l_quantity > 45",
    "system_time": "SELECT count(*) AS n, CAST(count(*) AS DOUBLE) AS estimate FROM lineitem",
}
