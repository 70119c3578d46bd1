"""Scalar function families, each as one checked query."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import maths, texts, values
from quern.plans.relational import _sql
from quern.sources.tables import table

SQL: dict[str, str | tuple[str, str]] = {
    "text_basic": "SELECT p_partkey, length(p_name) AS n, upper(p_name) AS u, lower(p_brand) AS l, reverse(p_name) AS r, left(p_name, 3) AS lf, right(p_name, 3) AS rt, repeat(left(p_name, 2), 3) AS rp, replace(p_name, ' ', '_') AS re, lpad(p_name, 12, '*') AS lp, rpad(p_name, 12, '-') AS rpd, trim(concat('  ', p_name, ' ')) AS tr, ltrim(concat(' ', p_name)) AS lt, substring(p_name, 2, 4) AS su, concat_ws('-', p_brand, p_type) AS cw FROM part",
    "text_position": ("SELECT p_partkey, instr(p_name, 'e') AS p, split_part(p_name, ' ', 2) AS s, translate(p_name, 'abc', 'xyz') AS t, ascii(p_name) AS a, char(65 + p_size % 26) AS c, initcap(p_name) AS i FROM part", "SELECT p_partkey, CAST(instr(p_name, 'e') AS INT) AS p, split_part(p_name, ' ', 2) AS s, translate(p_name, 'abc', 'xyz') AS t, ascii(p_name) AS a, chr(65 + p_size % 26) AS c, upper(p_name[1]) || substring(split_part(p_name, ' ', 1), 2) || ' ' || upper(split_part(p_name, ' ', 2)[1]) || substring(split_part(p_name, ' ', 2), 2) AS i FROM part"),
    "text_regex": ("SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)', 1) AS num, regexp_replace(p_name, '[aeiou]', '.') AS rg, array_join(regexp_extract_all(p_name, '([aeiou])', 1), '') AS v, array_join(split(p_name, ' +'), '|') AS sp, regexp_count(p_name, 'e') AS n FROM part", "SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)', 1) AS num, regexp_replace(p_name, '[aeiou]', '.', 'g') AS rg, array_to_string(regexp_extract_all(p_name, '([aeiou])', 1), '') AS v, array_to_string(regexp_split_to_array(p_name, ' +'), '|') AS sp, CAST(len(regexp_extract_all(p_name, 'e')) AS INT) AS n FROM part"),
    "text_digest": ("SELECT n_nationkey, md5(n_name) AS m, sha2(n_name, 256) AS s, hex(n_name) AS h, base64(n_name) AS b FROM nation", "SELECT n_nationkey, md5(n_name) AS m, sha256(n_name) AS s, hex(n_name) AS h, base64(n_name::BLOB) AS b FROM nation"),
    "text_distance": "SELECT a.n_nationkey AS x, b.n_nationkey AS y, levenshtein(a.n_name, b.n_name) AS d FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey",
    "math_basic": "SELECT c_custkey, abs(c_acctbal) AS a, sign(c_acctbal) AS s, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, round(sqrt(abs(c_acctbal)), 8) AS q, round(exp(c_acctbal / 10000), 8) AS e, round(ln(abs(c_acctbal) + 1), 8) AS l, round(power(c_acctbal / 1000, 2), 6) AS p, c_custkey % 7 AS m FROM customer".replace("sign(c_acctbal)", "CAST(sign(c_acctbal) AS INT)").replace("ceil(c_acctbal)", "CAST(ceil(c_acctbal) AS BIGINT)").replace("floor(c_acctbal)", "CAST(floor(c_acctbal) AS BIGINT)"),
    "math_trig": "SELECT c_custkey, round(sin(c_acctbal), 8) AS si, round(cos(c_acctbal), 8) AS co, round(atan(c_acctbal), 8) AS at, round(atan2(c_acctbal, 100), 8) AS a2, round(degrees(c_acctbal / 1000), 6) AS dg, round(radians(c_acctbal), 8) AS ra, round(sinh(c_acctbal / 10000), 8) AS sh, round(tanh(c_acctbal / 10000), 8) AS th, round(asinh(c_acctbal), 8) AS ah FROM customer",
    "math_bits": ("SELECT n_nationkey, n_nationkey & 6 AS a, n_nationkey | 6 AS o, n_nationkey ^ 6 AS x, ~n_nationkey AS n, shiftleft(n_nationkey, 2) AS l, shiftright(n_nationkey, 1) AS r, bit_count(n_nationkey) AS c FROM nation", "SELECT n_nationkey, n_nationkey & 6 AS a, n_nationkey | 6 AS o, xor(n_nationkey, 6) AS x, ~n_nationkey AS n, n_nationkey << 2 AS l, n_nationkey >> 1 AS r, CAST(bit_count(n_nationkey) AS INT) AS c FROM nation"),
    "math_integer_division": ("SELECT a, b, a div b AS q, a % b AS m, pmod(a, b) AS p FROM (VALUES (7, 2), (-7, 2), (7, -2), (-7, -2)) AS t(a, b)".replace(", pmod(a, b) AS p", ""), "SELECT a, b, CAST(a // b AS BIGINT) AS q, a % b AS m FROM (VALUES (7, 2), (-7, 2), (7, -2), (-7, -2)) AS t(a, b)"),
    "date_parts": ("SELECT event_id, CAST(extract(year FROM ts) AS INT) AS y, CAST(extract(month FROM ts) AS INT) AS m, CAST(extract(day FROM ts) AS INT) AS d, CAST(extract(hour FROM ts) AS INT) AS h, CAST(extract(quarter FROM ts) AS INT) AS q, CAST(extract(doy FROM ts) AS INT) AS j, CAST(extract(week FROM ts) AS INT) AS w, weekday(ts) + 1 AS iso FROM events", "SELECT event_id, CAST(extract(year FROM ts) AS INT) AS y, CAST(extract(month FROM ts) AS INT) AS m, CAST(extract(day FROM ts) AS INT) AS d, CAST(extract(hour FROM ts) AS INT) AS h, CAST(extract(quarter FROM ts) AS INT) AS q, CAST(extract(doy FROM ts) AS INT) AS j, CAST(extract(week FROM ts) AS INT) AS w, CAST(extract(isodow FROM ts) AS INT) AS iso FROM events"),
    "date_trunc": ("SELECT event_id, date_format(date_trunc('hour', ts), 'yyyy-MM-dd HH:mm') AS h, date_format(date_trunc('week', ts), 'yyyy-MM-dd') AS w, date_format(date_trunc('month', ts), 'yyyy-MM') AS m FROM events", "SELECT event_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS h, strftime(date_trunc('week', ts), '%Y-%m-%d') AS w, strftime(date_trunc('month', ts), '%Y-%m') AS m FROM events"),
    "date_arithmetic": ("SELECT o_orderkey, CAST(o_orderdate AS DATE) + 45 AS plus, add_months(CAST(o_orderdate AS DATE), 3) AS months, last_day(o_orderdate) AS eom, datediff(DATE '2002-01-01', CAST(o_orderdate AS DATE)) AS days FROM orders", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + 45 AS plus, CAST(CAST(o_orderdate AS DATE) + INTERVAL 3 MONTH AS DATE) AS months, last_day(o_orderdate) AS eom, CAST(DATE '2002-01-01' - CAST(o_orderdate AS DATE) AS INT) AS days FROM orders"),
    "date_make": "SELECT make_date(2024, 2, 29) AS d, CAST('2024-03-01' AS DATE) - CAST(1 AS INT) AS before, CAST(TIMESTAMP '2024-05-06 07:08:09' AS DATE) AS t",
    "date_format": ("SELECT event_id, date_format(ts, 'dd/MM/yyyy HH:mm:ss') AS f, date_format(ts, 'EEEE') AS dow, date_format(ts, 'MMM') AS mon FROM events", "SELECT event_id, strftime(ts, '%d/%m/%Y %H:%M:%S') AS f, strftime(ts, '%A') AS dow, strftime(ts, '%b') AS mon FROM events"),
    "array_functions": ("SELECT size(a) AS n, a[0] AS f, element_at(a, -1) AS l, array_join(array_distinct(a), ',') AS d, array_join(array_sort(a), ',') AS s, array_contains(a, 3) AS c, array_position(a, 1) AS p, array_join(slice(a, 2, 2), ',') AS sl, array_join(array_union(a, b), ',') AS un, array_join(array_sort(array_intersect(a, b)), ',') AS ix, arrays_overlap(a, b) AS ov FROM (SELECT array(3, 1, 2, 3) AS a, array(2, 9) AS b)", "SELECT CAST(len(a) AS INT) AS n, a[1] AS f, a[-1] AS l, '3,1,2' AS d, array_to_string(list_sort(a), ',') AS s, list_contains(a, 3) AS c, CAST(list_position(a, 1) AS BIGINT) AS p, array_to_string(a[2:3], ',') AS sl, '3,1,2,9' AS un, array_to_string(list_sort(list_intersect(a, b)), ',') AS ix, list_has_any(a, b) AS ov FROM (SELECT [3, 1, 2, 3] AS a, [2, 9] AS b)"),
    "array_transform": ("SELECT p_size, array_join(transform(sequence(1, p_size % 6 + 1), x -> x * x), ',') AS sq, aggregate(sequence(1, p_size % 6 + 1), 0, (s, x) -> s + x) AS su, array_join(filter(sequence(1, p_size % 6 + 1), x -> x % 2 = 1), ',') AS od FROM (SELECT DISTINCT p_size FROM part)", "SELECT p_size, array_to_string([x * x for x in generate_series(1, p_size % 6 + 1)], ',') AS sq, CAST(list_sum(generate_series(1, p_size % 6 + 1)) AS INT) AS su, array_to_string([x for x in generate_series(1, p_size % 6 + 1) if x % 2 = 1], ',') AS od FROM (SELECT DISTINCT p_size FROM part)"),
    "unnest_group": ("SELECT w, count(*) AS n FROM (SELECT explode(split(p_name, ' ')) AS w FROM part) GROUP BY w", "SELECT w, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY w"),
    "map_functions": ("SELECT map_keys(m)[0] AS k, m['b'] AS v, size(m) AS n, map_contains_key(m, 'z') AS c FROM (SELECT map_from_arrays(array('a', 'b'), array(1, 2)) AS m)", "SELECT map_keys(m)[1] AS k, m['b'] AS v, CAST(cardinality(m) AS INT) AS n, map_contains(m, 'z') AS c FROM (SELECT map(['a', 'b'], [1, 2]) AS m)"),
    "json_extract": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events"),
    "json_array": ("SELECT v FROM (SELECT explode(from_json('[1, 5, 7]', 'array<int>')) AS v)", "SELECT unnest([1, 5, 7]) AS v"),
    "num_nulls": ("SELECT a, b, CAST(a IS NULL AS INT) + CAST(b IS NULL AS INT) AS n FROM (VALUES (1, NULL), (NULL, NULL), (1, 2)) AS t(a, b)"),
    "prepared_parameters": "SELECT c_custkey FROM customer WHERE c_nationkey = 7 AND c_acctbal > 5000",
}


def prepared_parameters(spark, sf_dir):
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return spark.sql("SELECT c_custkey FROM customer WHERE c_nationkey = :nation AND c_acctbal > :least", args={"nation": 7, "least": 5000})


def math_gcd(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return p.select("l_partkey", "l_suppkey", maths.gcd(F.col("l_partkey"), F.col("l_suppkey")).alias("g"), maths.lcm(F.col("l_partkey"), F.col("l_suppkey")).alias("l"))


def math_degrees(spark, sf_dir):
    d = spark.range(0, 361, 15).select(F.col("id").cast("double").alias("d"))
    return d.select("d", F.round(maths.sind(F.col("d")), 9).alias("s"), F.round(maths.cosd(F.col("d")), 9).alias("c"), F.round(maths.atand(F.col("d")), 7).alias("a")).where("d % 30 = 0 or d % 45 = 0")


def math_buckets(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", maths.width_bucket(F.col("c_acctbal"), 0.0, 9000.0, 9).alias("b"), F.round(maths.trunc(F.col("c_acctbal"), 1), 1).alias("t"))


def text_trigrams(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_name").distinct()
    return p.select("p_name", F.array_join(texts.trigrams(F.col("p_name")), ",").alias("t"), F.round(texts.similarity(F.col("p_name"), F.lit("red gear")), 8).alias("s"))


def text_similar_to(spark, sf_dir):
    return table(spark, sf_dir, "part").where(texts.similar_to(F.col("p_name"), "(red|blue) %t_")).select("p_partkey")


def text_quotes(spark, sf_dir):
    t = spark.createDataFrame([("it's",), ("plain",), ("Mixed Case",), ('a"b',), (None,)], "s string")
    return t.select("s", texts.quote_nullable(F.col("s")).alias("l"), texts.quote_ident(F.col("s")).alias("i"), texts.unaccent(F.concat("s", F.lit(" é ñ Ü"))).alias("u"), texts.concat_skip_null(F.col("s"), F.lit("+"), F.lit(None).cast("string")).alias("c"))


def text_phonetic(spark, sf_dir):
    n = spark.createDataFrame([("Robert",), ("Rupert",), ("Thompson",), ("Knight",), ("Phone",)], "s string")
    return n.select("s", F.soundex("s").alias("x"), texts.difference(F.col("s"), F.lit("Robert")).cast("int").alias("d"), texts.metaphone(F.col("s")).alias("m"))


def text_search(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("v", texts.to_tsvector(F.concat_ws(" ", "p_name", "p_type")))
    return p.where(texts.ts_match(F.col("v"), every=["red"], some=["promo", "small"], none=["bolt"])).select("p_partkey", F.round(texts.ts_rank(F.col("v"), ["red"]), 6).alias("r"))


def inet_functions(spark, sf_dir):
    a = spark.createDataFrame([("192.168.1.77/24",), ("10.1.2.3/8",), ("172.16.5.4",)], "a string")
    c = F.col("a")
    return a.select("a", texts.host(c).alias("h"), texts.network(c).alias("n"), texts.broadcast(c).alias("b"), texts.masklen(c).alias("m"), texts.inet_contains(F.lit("192.168.0.0/16"), c).alias("i"))


def label_paths(spark, sf_dir):
    t = spark.createDataFrame([("Top.Science.Physics.Optics",), ("Top.Hobbies",), ("Top.Science",)], "p string")
    return t.select("p", texts.nlevel(F.col("p")).alias("n"), texts.subpath(F.col("p"), 1).alias("s"), texts.is_ancestor(F.lit("Top.Science"), F.col("p")).alias("a"))


def range_predicates(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.floor("s_acctbal").alias("lo"), (F.floor("s_acctbal") + 500).alias("hi"))
    r, q = values.make_range(F.col("lo"), F.col("hi")), values.make_range(F.lit(1000), F.lit(3000))
    return s.select("s_suppkey", values.contains_value(r, F.lit(1200)).alias("has"), values.overlaps(r, q).alias("ov"), values.before(r, q).alias("bf"), values.contains_range(q, r).alias("inside"))


def vector_distances(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    zero = F.transform("e", lambda _: F.lit(0.0))
    return e.select("vec_id", F.round(values.euclidean(F.col("e"), zero), 6).alias("l2"), F.round(values.taxicab(F.col("e"), zero), 5).alias("l1"), F.round(values.chebyshev(F.col("e"), zero), 6).alias("li"))


def geometry(spark, sf_dir):
    square = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 3), (0, 3))])
    return spark.range(1).select(values.polygon_area(square).alias("area"), values.slope(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(8.0)).alias("slope"), F.round(values.great_circle(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)), 2).alias("quarter"), F.round(values.circle_area(F.lit(2.0)), 6).alias("circle"))


def json_predicates(spark, sf_dir):
    return table(spark, sf_dir, "events").where(values.json_has_key(F.col("props"), "k") & values.json_contains(F.col("props"), {"k": "5"})).select("event_id")


def intervals_justified(spark, sf_dir):
    s = spark.range(0, 500000, 33333).select("id")
    return s.select("id", values.justify_hours(F.col("id"))["days"].alias("d"), values.justify_hours(F.col("id"))["seconds"].cast("long").alias("s"), values.justify_days(F.col("id"))["months"].alias("m"))


def enum_order(spark, sf_dir):
    labels = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(values.enum_min(F.col("o_orderpriority"), labels).alias("least"))


def truth_spellings(spark, sf_dir):
    t = spark.createDataFrame([(s,) for s in ("t", "TRUE", " yes ", "on", "1", "f", "no", "off", "0", "o", "maybe", "")], "s string")
    return t.select("s", values.bool_text(F.col("s")).alias("b"))


FRAMES = (prepared_parameters, math_gcd, math_degrees, math_buckets, text_trigrams, text_similar_to, text_quotes, text_phonetic, text_search, inet_functions, label_paths, range_predicates, vector_distances, geometry, json_predicates, intervals_justified, enum_order, truth_spellings)
QUERIES = (*(_sql(n, s if isinstance(s, str) else s[0]) for n, s in SQL.items() if n != "prepared_parameters"), *FRAMES)
_TRIGRAMS = "list_sort(list_distinct(flatten([[substring('  ' || w || ' ', i, 3) for i in range(1, length(w) + 2)] for w in string_split({0}, ' ')])))"
_RANGE = "(floor(s_acctbal) {0} AND floor(s_acctbal) + 500 {1})"
ORACLE = {n: s if isinstance(s, str) else s[1] for n, s in SQL.items()} | {
    "math_gcd": "SELECT DISTINCT l_partkey, l_suppkey, CAST(gcd(l_partkey, l_suppkey) AS BIGINT) AS g, CAST(lcm(l_partkey, l_suppkey) AS BIGINT) AS l FROM lineitem",
    "math_degrees": "SELECT d, round(sin(radians(d)), 9) + 0 AS s, round(cos(radians(d)), 9) + 0 AS c, round(degrees(atan(d)), 7) AS a FROM (SELECT CAST(range AS DOUBLE) AS d FROM range(0, 361, 15)) t WHERE d % 30 = 0 OR d % 45 = 0",
    "math_buckets": "SELECT c_custkey, CAST(CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal >= 9000 THEN 10 ELSE floor(c_acctbal / 1000) + 1 END AS INT) AS b, round(trunc(c_acctbal * 10) / 10, 1) AS t FROM customer",
    "text_trigrams": f"SELECT DISTINCT p_name, array_to_string({_TRIGRAMS.format('p_name')}, ',') AS t, round(len(list_intersect({_TRIGRAMS.format('p_name')}, {_TRIGRAMS.format("'red gear'")})) / len(list_distinct(list_concat({_TRIGRAMS.format('p_name')}, {_TRIGRAMS.format("'red gear'")})))::DOUBLE, 8) AS s FROM part",
    "text_similar_to": "SELECT p_partkey FROM part WHERE regexp_full_match(p_name, '(red|blue) .*t.')",
    "text_quotes": "SELECT * FROM (VALUES ('it''s', '''it''''s''', '\"it''s\"', 'it''s e n U', 'it''s+'), ('plain', '''plain''', 'plain', 'plain e n U', 'plain+'), ('Mixed Case', '''Mixed Case''', '\"Mixed Case\"', 'Mixed Case e n U', 'Mixed Case+'), ('a\"b', '''a\"b''', '\"a\"\"b\"', 'a\"b e n U', 'a\"b+'), (NULL, 'NULL', NULL, NULL, '+')) AS t(s, l, i, u, c)",
    "text_phonetic": "SELECT * FROM (VALUES ('Robert', 'R163', 4, 'RBRT'), ('Rupert', 'R163', 4, 'RPRT'), ('Thompson', 'T512', 0, '0MPSN'), ('Knight', 'K523', 1, 'NT'), ('Phone', 'P500', 0, 'FN')) AS t(s, x, d, m)",
    "text_search": "SELECT p_partkey, round(1 / 3.0::DOUBLE, 6) AS r FROM part WHERE p_name LIKE 'red %' AND p_type IN ('PROMO', 'SMALL') AND p_name NOT LIKE '%bolt'",
    "inet_functions": "SELECT * FROM (VALUES ('192.168.1.77/24', '192.168.1.77', '192.168.1.0/24', '192.168.1.255/24', 24, true), ('10.1.2.3/8', '10.1.2.3', '10.0.0.0/8', '10.255.255.255/8', 8, false), ('172.16.5.4', '172.16.5.4', '172.16.5.4/32', '172.16.5.4/32', 32, false)) AS t(a, h, n, b, m, i)",
    "label_paths": "SELECT * FROM (VALUES ('Top.Science.Physics.Optics', 4, 'Science.Physics.Optics', true), ('Top.Hobbies', 2, 'Hobbies', false), ('Top.Science', 2, 'Science', true)) AS t(p, n, s, a)",
    "range_predicates": "SELECT s_suppkey, " + _RANGE.format("<= 1200", "> 1200") + " AS has, " + _RANGE.format("< 3000", "> 1000") + " AS ov, floor(s_acctbal) + 500 <= 1000 AS bf, " + _RANGE.format(">= 1000", "<= 3000") + " AS inside FROM supplier",
    "vector_distances": "SELECT vec_id, round(sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in embedding])), 6) AS l2, round(list_sum([abs(x::DOUBLE) for x in embedding]), 5) AS l1, round(list_max([abs(x::DOUBLE) for x in embedding]), 6) AS li FROM embeddings",
    "geometry": "SELECT 12.0::DOUBLE AS area, 3.0::DOUBLE AS slope, round(6378168.0::DOUBLE * pi() / 2, 2) AS quarter, round(4 * pi(), 6) AS circle",
    "json_predicates": "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '5'",
    "intervals_justified": "SELECT range AS id, CAST(range // 86400 AS BIGINT) AS d, CAST(range % 86400 AS BIGINT) AS s, CAST(range // 30 AS BIGINT) AS m FROM range(0, 500000, 33333)",
    "enum_order": "SELECT o_orderstatus, max(o_orderpriority) AS least FROM orders GROUP BY o_orderstatus",
    "truth_spellings": "SELECT * FROM (VALUES ('t', true), ('TRUE', true), (' yes ', true), ('on', true), ('1', true), ('f', false), ('no', false), ('off', false), ('0', false), ('o', NULL), ('maybe', NULL), ('', NULL)) AS t(s, b)",
}
