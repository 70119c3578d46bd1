"""Sources, stored tables, user-defined functions, table functions and document values, each as one checked query."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf

from quern.sources import scratch, tables
from quern.sources.tables import table


def _place(spark, name: str) -> str:
    path = f"{scratch.folder(spark)}/quern-{name}-{uuid.uuid4().hex}"
    scratch.keep(path, spark)
    return path


def copy_round_trip(spark, sf_dir):
    """A table written as a delimited file with \\N for null and read back under its schema, with a filter on reading."""
    path = _place(spark, "copy")
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("c_acctbal"), "c_mktsegment")
    tables.write_delimited(df, path)
    return tables.read_delimited(spark, path, "c_custkey long, c_name string, c_acctbal double, c_mktsegment string", where="c_custkey is not null")


def partition_pruning(spark, sf_dir):
    """Stored by partition; only the folder of one value is read."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return tables.store(df, _place(spark, "parts"), partition_by=("o_orderstatus",), sort_by=("o_orderkey",)).where("o_orderstatus = 'F' and o_totalprice > 300000").select("o_orderkey", "o_totalprice")


def point_lookup(spark, sf_dir):
    """Sorted files with a Bloom filter on the key: other row groups are skipped."""
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return tables.store(df, _place(spark, "points"), sort_by=("l_partkey",), bloom=("l_partkey",)).where("l_partkey in (7, 77, 777)")


def partitionwise_join(spark, sf_dir):
    """Both sides dealt by the same hash of the key: the join and the grouping on it share that layout."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority").repartition(8, "k")
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_quantity").repartition(8, "k")  # noqa: E741
    return o.hint("shuffle_hash").join(l, "k").groupBy("k", "o_orderpriority").agg(F.sum("l_quantity").alias("q"))


def materialized_view(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    view = tables.MaterializedView(spark, _place(spark, "view"), "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderpriority")
    view.refresh(with_data=False)
    return view.refresh()


def row_positions(spark, sf_dir):
    """Rows by their place in the file, as a scan by physical row id."""
    return table(spark, sf_dir, "nation").select("n_nationkey", F.col("_metadata.row_index").alias("at")).where("at between 3 and 6").select("n_nationkey")


def generated_columns(spark, sf_dir):
    """Row numbers as an identity column, and a column computed from others."""
    r = table(spark, sf_dir, "region")
    return r.select((F.col("r_regionkey") * 10 + 1).cast("int").alias("id"), F.concat("r_name", F.lit("/"), F.length("r_name").cast("string")).alias("label"))


def cursor_fetch(spark, sf_dir):
    """FETCH 10, MOVE 10, FETCH 5 of an ordered cursor."""
    chunks = tables.cursor(table(spark, sf_dir, "nation").orderBy("n_nationkey"), 5)
    fetched = [c for i, c in enumerate(chunks) if i in (0, 1, 4)]
    return spark.createDataFrame([(r["n_nationkey"],) for c in fetched for r in c], "n_nationkey int")


def sql_function(spark, sf_dir):
    """A SQL function: inlined into the plan."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION net(price DOUBLE, discount DOUBLE) RETURNS DOUBLE RETURN price * (1 - discount)")
    return spark.sql("SELECT l_returnflag, round(sum(net(l_extendedprice, l_discount)), 4) AS s FROM lineitem GROUP BY l_returnflag")


def user_aggregate(spark, sf_dir):
    """An aggregate of a user's own, over Arrow batches: the mean without the least and the greatest value."""

    @pandas_udf("double")
    def trimmed(v: pd.Series) -> float:
        return float((v.sum() - v.min() - v.max()) / (len(v) - 2)) if len(v) > 2 else float("nan")

    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(trimmed("s_acctbal").alias("t")).where("t is not null").select("s_nationkey", F.round("t", 4).alias("t"))


def user_scalar(spark, sf_dir):
    """A strict scalar function over Arrow batches: null in, null out."""

    @pandas_udf("string")
    def initials(v: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in v:
            yield s.str.findall(r"(?:^| )([^ ])").str.join("")

    return table(spark, sf_dir, "part").select("p_partkey", initials("p_name").alias("i"))


def user_table_function(spark, sf_dir):
    @udtf(returnType="word string, at int")
    class Words:
        def eval(self, text: str):
            for i, w in enumerate(text.split(" ") if text is not None else []):
                yield w, i

    spark.udtf.register("words_of", Words)
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    return spark.sql("SELECT p_partkey, word, at FROM part, LATERAL words_of(p_name)")


def xml_paths(spark, sf_dir):
    x = spark.range(1).select(F.lit("<doc><a n='1'>x</a><a n='2'>y</a><b>3.5</b></doc>").alias("x"))
    return x.select(F.xpath_string("x", F.lit("doc/a[@n='2']")).alias("s"), F.xpath_double("x", F.lit("doc/b")).alias("d"), F.xpath_boolean("x", F.lit("doc/c")).alias("c"), F.array_join(F.xpath("x", F.lit("doc/a/text()")), ",").alias("l"))


def xml_table(spark, sf_dir):
    """Rows from a document."""
    x = spark.range(1).select(F.from_xml(F.lit("<r><row><id>1</id><v>a</v></row><row><id>2</id><v>b</v></row></r>"), F.lit("row array<struct<id:int,v:string>>")).alias("d"))
    return x.select(F.inline("d.row"))


def key_value_maps(spark, sf_dir):
    m = spark.range(1).select(F.str_to_map(F.lit("a=>1,b=>2,c=>"), F.lit(","), F.lit("=>")).alias("m"))
    return m.select(F.array_join(F.array_sort(F.map_keys("m")), ",").alias("k"), F.col("m")["b"].alias("b"), F.map_contains_key("m", "z").alias("z"), F.size(F.map_concat("m", F.create_map(F.lit("d"), F.lit("4")))).alias("n"))


def json_values(spark, sf_dir):
    v = spark.range(1).select(F.parse_json(F.lit('{"a": {"b": [1, 2, 30]}, "t": true}')).alias("v"))
    return v.select(F.variant_get("v", "$.a.b[2]", "int").alias("x"), F.variant_get("v", "$.t", "boolean").alias("t"), F.json_array_length(F.lit("[1,2,3]")).alias("n"), F.to_json(F.struct(F.lit(1).alias("i"), F.lit("s").alias("s"))).alias("j"))


def row_values(spark, sf_dir):
    r = table(spark, sf_dir, "region")
    s = r.select(F.struct(F.col("r_regionkey").alias("k"), F.col("r_name").alias("n")).alias("row"))
    return s.where(F.col("row") >= F.struct(F.lit(2).alias("k"), F.lit("").alias("n"))).select("row.k", "row.n")


def observed_metrics(spark, sf_dir):
    """Counts taken while a query runs, without a second pass."""
    from pyspark.sql import Observation

    seen = Observation()
    table(spark, sf_dir, "orders").observe(seen, F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("m")).where("o_orderkey < 0").count()
    return spark.createDataFrame([(seen.get["n"], seen.get["m"])], "n long, m double")


def inheritance(spark, sf_dir):
    """A parent with its children: rows of all, columns by name, absent ones null."""
    parent = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    child = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("extra"))
    return parent.unionByName(child, allowMissingColumns=True)


def case_insensitive(spark, sf_dir):
    """Text that compares without case, by a collation."""
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return spark.sql("SELECT c_custkey FROM customer WHERE c_mktsegment COLLATE UTF8_LCASE = 'building'")


def time_of_day(spark, sf_dir):
    t = spark.sql("SELECT make_interval(0, 1, 0, 3) AS i, timestamp'2024-01-31 10:00:00' AS t")
    return t.select(F.date_format(F.col("t") + F.col("i"), "yyyy-MM-dd HH:mm").alias("later"), F.date_format(F.from_utc_timestamp("t", "Asia/Tokyo"), "HH:mm").alias("tokyo"), F.unix_timestamp("t").alias("e"))


QUERIES = (
    copy_round_trip, partition_pruning, point_lookup, partitionwise_join, materialized_view, row_positions, generated_columns, cursor_fetch, sql_function, user_aggregate, user_scalar,
    user_table_function, xml_paths, xml_table, key_value_maps, json_values, row_values, observed_metrics, inheritance, case_insensitive, time_of_day,
)

ORACLE = {
    "copy_round_trip": "SELECT c_custkey, c_name, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS c_acctbal, c_mktsegment FROM customer",
    "partition_pruning": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000",
    "point_lookup": "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_partkey IN (7, 77, 777)",
    "partitionwise_join": "SELECT o_orderkey AS k, o_orderpriority, sum(l_quantity) AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL",
    "materialized_view": "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
    "row_positions": "SELECT n_nationkey FROM nation WHERE n_nationkey BETWEEN 3 AND 6",
    "generated_columns": "SELECT r_regionkey * 10 + 1 AS id, r_name || '/' || length(r_name) AS label FROM region",
    "cursor_fetch": "SELECT n_nationkey FROM nation WHERE n_nationkey < 10 OR n_nationkey >= 20",
    "sql_function": "SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 4) AS s FROM lineitem GROUP BY 1",
    "user_aggregate": "SELECT s_nationkey, round((sum(s_acctbal) - min(s_acctbal) - max(s_acctbal)) / (count(*) - 2), 4) AS t FROM supplier GROUP BY 1 HAVING count(*) > 2",
    "user_scalar": "SELECT p_partkey, array_to_string([w[1] for w in string_split(p_name, ' ')], '') AS i FROM part",
    "user_table_function": "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, unnest(range(0, len(string_split(p_name, ' '))))::INT AS at FROM part",
    "xml_paths": "SELECT 'y' AS s, 3.5::DOUBLE AS d, false AS c, 'x,y' AS l",
    "xml_table": "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) AS t(id, v)",
    "key_value_maps": "SELECT 'a,b,c' AS k, '2' AS b, false AS z, 4 AS n",
    "json_values": "SELECT CAST(json_extract('{\"a\": {\"b\": [1, 2, 30]}}', '$.a.b[2]') AS INT) AS x, true AS t, 3 AS n, '{\"i\":1,\"s\":\"s\"}' AS j",
    "row_values": "SELECT r_regionkey AS k, r_name AS n FROM region WHERE r_regionkey >= 2",
    "observed_metrics": "SELECT count(*) AS n, max(o_totalprice) AS m FROM orders",
    "inheritance": "SELECT r_regionkey AS id, r_name AS name, NULL::INT AS extra FROM region UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "case_insensitive": "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'",
    "time_of_day": "SELECT strftime(TIMESTAMP '2024-01-31 10:00:00' + INTERVAL 1 MONTH + INTERVAL 3 DAY, '%Y-%m-%d %H:%M') AS later, '19:00' AS tokyo, CAST(epoch(TIMESTAMP '2024-01-31 10:00:00') AS BIGINT) AS e",
}
