from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quern.functions import maths, texts, values
from quern.operators import relational as ops
from quern.sources import tables


def test_with_ties_and_limits(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "a int")
    assert sorted(r["a"] for r in ops.fetch_with_ties(df, 2, [F.col("a").asc_nulls_last()]).collect()) == [1, 2, 2]
    assert sorted(r["a"] for r in ops.fetch_with_ties(df, 1, [F.col("a").asc_nulls_last()], offset=1).collect()) == [2, 2]
    assert ops.limit(df, None).count() == 5
    assert ops.limit(df, 2, 4).count() == 1
    for bad in ((-1, None), (1, -1)):
        with pytest.raises(ValueError):
            ops.limit(df, *bad)


def test_dml_forms(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    assert {r["k"] for r in ops.delete(df, F.col("v") == "a").collect()} == {2, 3}
    assert {r["v"] for r in ops.update(df, F.col("v") == "a", {"v": F.lit("z")}).collect()} == {"z", None, "c"}
    new = spark.createDataFrame([(3, "n"), (4, "m")], "k int, v string")
    assert sorted((r["k"], r["v"]) for r in ops.upsert(df, new, ["k"]).collect()) == [(1, "a"), (2, None), (3, "n"), (4, "m")]


def test_asof(spark):
    l = spark.createDataFrame([("x", 5, 1), ("x", 1, 2), ("y", 9, 3)], "k string, t int, i int")  # noqa: E741
    r = spark.createDataFrame([("x", 2, "a"), ("x", 5, "b"), ("z", 1, "c")], "k string, t int, v string")
    got = {row["i"]: row["v"] for row in ops.asof_join(l, r, ["k"], "t", ["v"]).collect()}
    assert got == {1: "b", 2: None, 3: None}


def test_connect_by_meets_itself(spark):
    df = spark.createDataFrame([(1, 2), (2, 1)], "id int, parent int")
    with pytest.raises(Exception, match="recursion"):
        ops.connect_by(df, "id", "parent", 1, 5).collect()


def test_salted_forms(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), (F.col("id") % 37).alias("v"))
    assert ops.salted_count_distinct(df, ["k"], "v", "n", 8).first()["n"] == 37
    small = spark.createDataFrame([(1, "one")], "k int, w string")
    assert ops.salted_join(df, small, ["k"], 8).count() == 1000


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b", None), (2, None, 2.5)], "i int, s string, d double")
    tables.write_delimited(df, str(tmp_path / "t"))
    assert sorted(map(tuple, tables.read_delimited(spark, str(tmp_path / "t"), "i int, s string, d double").collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    stored = tables.store(df, str(tmp_path / "p"), sort_by=("i",), bloom=("i",))
    assert stored.where("i = 2").count() == 1
    (tmp_path / "bad").write_text("x|y|z\n")
    with pytest.raises(Exception):  # noqa: B017
        tables.read_delimited(spark, str(tmp_path / "bad"), "i int, s string, d double").collect()


def test_materialized_view(spark, tmp_path):
    spark.range(3).createOrReplaceTempView("base_of_view")
    view = tables.MaterializedView(spark, str(tmp_path / "v"), "SELECT count(*) AS n FROM base_of_view")
    with pytest.raises(ValueError):
        view.read()
    assert view.refresh().first()["n"] == 3
    spark.range(5).createOrReplaceTempView("base_of_view")
    assert view.read().first()["n"] == 3
    assert view.refresh().first()["n"] == 5


def test_cursor_and_series(spark):
    assert [len(c) for c in tables.cursor(spark.range(25), 10)] == [10, 10, 5]
    assert [r["value"] for r in tables.series(spark, 3, -3, -3).collect()] == [3, 0, -3]
    assert tables.series(spark, 3, 1).count() == 0
    with pytest.raises(ValueError):
        tables.series(spark, 1, 2, 0)


def test_scalar_edges(spark):
    one = spark.range(1)
    v = lambda c: one.select(c.alias("v")).first()["v"]
    assert v(maths.gcd(F.lit(0), F.lit(0))) == 0 and v(maths.gcd(F.lit(-12), F.lit(18))) == 6
    assert v(maths.lcm(F.lit(0), F.lit(4))) == 0
    assert v(maths.gcd(F.lit(None).cast("int"), F.lit(4))) is None
    assert v(maths.gcd(F.lit(7540113804746346429), F.lit(4660046610375530309))) == 1
    assert v(maths.sind(F.lit(-30.0))) == -0.5 and v(maths.cosd(F.lit(420.0))) == 0.5
    assert v(texts.similar_to(F.lit("abc"), "_b(c|d)")) and not v(texts.similar_to(F.lit("abcx"), "_b(c|d)"))
    assert v(texts.regexp_first(F.lit("aXbX"), "X", "-")) == "a-bX"
    assert v(texts.isbn13_valid(F.lit("978-0-306-40615-7"))) and not v(texts.isbn13_valid(F.lit("978-0-306-40615-8")))
    r, s = values.make_range(F.lit(1), F.lit(5)), values.make_range(F.lit(5), F.lit(9))
    assert v(values.adjacent(r, s)) and not v(values.overlaps(r, s)) and v(values.before(r, s))
    assert v(values.range_empty(values.make_range(F.lit(5), F.lit(5))))
    assert v(values.json_set(F.lit('{"a":"1"}'), "b", F.lit("2"))) == '{"a":"1","b":"2"}'


def test_merge(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    s = spark.createDataFrame([(2, "x"), (3, "y"), (None, "z")], "k int, v string")
    got = sorted(map(tuple, ops.merge(t, s, ["k"], {"v": F.concat("t.v", "s.v")}).collect()), key=repr)
    assert got == sorted([(1, "a", None), (2, "bx", "UPDATE"), (3, "y", "INSERT"), (None, "n", None), (None, "z", "INSERT")], key=repr)
    assert ops.merge(t, s, ["k"], delete=F.col("s.v") == "x", insert=False).where("__action = 'DELETE'").count() == 1
    with pytest.raises(Exception, match="more than once"):
        ops.merge(t, s.union(s.where("k = 2")), ["k"], {"v": F.col("s.v")}).collect()


def test_overlap_join_against_all_pairs(spark):
    rows = [(i, (i * 37) % 100, (i * 37) % 100 + i % 9) for i in range(60)] + [(99, 5, 4)]
    a, b = spark.createDataFrame(rows, "i int, lo int, hi int"), spark.createDataFrame([(i, x + 3, y + 3) for i, x, y in rows], "j int, lo2 int, hi2 int")
    for width in (1.0, 7.0, 1000.0):
        got = sorted((r["i"], r["j"]) for r in ops.overlap_join(a, b, ("lo", "hi"), ("lo2", "hi2"), width).collect())
        assert got == sorted((i, j) for i, lo, hi in rows for j, x, y in rows if lo <= hi and x <= y and lo <= y + 3 and x + 3 <= hi)


def test_text_queries(spark):
    df = spark.createDataFrame([("the quick brown fox",), (None,), ("",)], "s string").withColumn("v", texts.to_tsvector(F.col("s")))
    ask = lambda q: df.select(texts.ts_query(F.col("v"), q)).first()[0]
    assert ask("quick & fox") and ask("quick <-> brown") and ask("quick <2> fox") and ask("quick <-> brown <-> fox") and ask("bro:* & !cat") and ask("!(cat | dog)")
    assert not ask("quick <-> fox") and not ask("brown <-> quick") and not ask("cat | dog") and not ask("")
    for bad in ("quick &", "(quick", "quick fox", "& quick", "(a & b) <-> c"):
        with pytest.raises(ValueError):
            ask(bad)


def test_jdbc_pushes_filters_down(spark):
    """The embedded database of the Java side, in memory, as the remote end."""
    url, properties = "jdbc:derby:memory:remote;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.range(100).selectExpr("CAST(id AS INT) AS K", "CAST(id * 2 AS INT) AS V").write.jdbc(url, "T", mode="overwrite", properties=properties)
    df = tables.read_jdbc(spark, url, "T", properties, "K", (0, 100), 4)
    assert df.rdd.getNumPartitions() == 4
    few = df.where("K < 7").select("V")
    assert sorted(r["V"] for r in few.collect()) == list(range(0, 14, 2))
    assert "LessThan(K,7)" in few._jdf.queryExecution().toString()


def test_min_and_max_come_from_footers(spark, small):
    from quern.plans import extras

    assert "PushedAggregation: [MIN(o_orderkey), MAX(o_orderkey), COUNT(*)]" in extras.agg_min_max_footers(spark, small)._jdf.queryExecution().toString()


def test_scratch_needs_a_shared_folder_off_local_mode():
    from quern.sources import scratch

    assert scratch.LOCAL.fullmatch("local[8]") and scratch.LOCAL.fullmatch("local") and not scratch.LOCAL.fullmatch("local-cluster[3,1,1024]") and not scratch.LOCAL.fullmatch("spark://x:7077")
