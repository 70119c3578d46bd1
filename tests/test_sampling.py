from __future__ import annotations

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.operators import estimators as est
from quern.operators import range_index, ranked, sampling
from quern.plans import sqlfront


@pytest.fixture(scope="module")
def population(spark):
    return spark.range(400).select("id", (F.col("id") % 7).alias("k"), (F.col("id") * 1.5).alias("x"), F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id")).alias("y")).cache()


def layout(bucket="k", digits=1):
    return sampling.Layout(F.col(bucket), ("id",), digits)


def test_draws_are_with_replacement_and_repeatable(population):
    a = sampling.swr_sample(population, 900, layout(), 3).collect()
    assert len(a) == 900
    assert max(Counter(r["id"] for r in a).values()) > 1
    b = sampling.swr_sample(population.repartition(7), 900, layout(), 3).collect()
    assert sorted(r["id"] for r in a) == sorted(r["id"] for r in b)
    assert {r["__p"] for r in a} == {1 / 400} and {r["__n"] for r in a} == {900.0}


def test_stored_index_gives_the_same_sample(population, tmp_path):
    sampling.rank_index(population, layout()).write.parquet(str(tmp_path / "index"))
    index = population.sparkSession.read.parquet(str(tmp_path / "index"))
    part = population.where("k in (2, 3)")
    a = sampling.swr_sample(part, 100, layout(), 6)
    b = sampling.swr_sample(part, 100, layout(), 6, index=index.where("__b in (2, 3)"))
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_layout_digits_and_one_hot_bucket(spark, population):
    """A bucket with all rows is split by digest and still drawn uniformly."""
    hot = population.withColumn("k", F.lit(1))
    got = Counter(r["id"] for r in sampling.swr_sample(hot, 4000, layout(digits=2), 5).collect())
    assert len(got) > 395
    assert max(got.values()) < 40


@pytest.mark.parametrize("n", [0, 1])
def test_tiny_samples(population, n):
    s = sampling.swr_sample(population, n, layout(), 1)
    r = s.agg(est.approx_sum("x").alias("s"), est.approx_count().alias("c"), est.approx_sum_half_ci("x", 0.95).alias("h")).first()
    assert r["h"] is None
    assert r["c"] == (400 if n else 0)
    assert (r["s"] is None) == (n == 0)


def test_empty_population_and_null_buckets(population):
    assert sampling.swr_sample(population.where("id < 0"), 10, layout(), 1).count() == 0
    nulls = population.withColumn("k", F.when(F.col("id") % 2 == 0, F.col("k")))
    got = sampling.swr_sample(nulls, 3000, layout(), 1)
    assert got.where("k is null").count() > 1000


def test_arguments(population):
    for n in (None, -1):
        with pytest.raises(sampling.SampleError):
            sampling.swr_sample(population, n, layout())
    with pytest.raises(sampling.SampleError):
        sampling.swr_sample(population, 5, layout(), None)
    for pct in (-1, 101, float("nan"), None):
        with pytest.raises(sampling.SampleError):
            sampling.bernoulli_sample(population, pct, ("id",))
    with pytest.raises(ValueError, match="TABLESAMPLE"):
        est.require_sample(population)


def test_sample_sizes(population):
    assert sampling.bernoulli_sample(population, 100, ("id",)).count() == 400
    assert sampling.bernoulli_sample(population, 0, ("id",)).count() == 0
    assert 100 < sampling.bernoulli_sample(population, 50, ("id",)).count() < 300
    assert sampling.rows_sample(population, 17, ("id",)).count() == 17
    assert sampling.rows_sample(population, 9999, ("id",)).count() == 400
    blocks = sampling.system_sample(population, 50, F.floor(F.col("id") / 20)).groupBy(F.floor(F.col("id") / 20)).count().collect()
    assert {r["count"] for r in blocks} == {20}
    assert {r["count"] for r in sampling.stratified_sample(population, ["k"], 3, ("id",)).groupBy("k").count().collect()} == {3}
    assert sampling.time_sample(population, 0, ("id",)).count() < 100


def test_estimates_are_unbiased_and_intervals_cover(population):
    exact = sum(i * 1.5 for i in range(400) if i % 3 == 0)
    found = []
    for seed in range(60):
        s = sampling.swr_sample(population, 80, layout(), seed).where("id % 3 = 0")
        found.append(s.agg(est.approx_sum("x").alias("s"), est.approx_sum_half_ci("x", 0.95).alias("h")).first())
    mean = sum(r["s"] for r in found) / len(found)
    spread = math.sqrt(sum((r["s"] - mean) ** 2 for r in found) / (len(found) - 1) / len(found))
    assert abs(mean - exact) < 3 * spread
    assert 0.85 <= sum(abs(r["s"] - exact) <= r["h"] for r in found) / len(found) <= 1


def test_interval_formula(spark):
    """Rejected draws count as zeros."""
    xs, n = [3.0, 5.0, 10.0], 5
    full = xs + [0.0] * (n - len(xs))
    mean = sum(full) / n
    want = est.erf_inv_value(0.9) * math.sqrt(2 * sum((x - mean) ** 2 for x in full) / (n * (n - 1)))
    got = spark.createDataFrame([(x,) for x in xs], "x double").agg(est.clt_half_ci(est.accumulate("x"), 0.9, F.lit(float(n))).alias("h")).first()["h"]
    assert got == pytest.approx(want, rel=1e-12)


def test_erf_inv(spark):
    ys = [i / 100 for i in range(-99, 100)] + [1 - 10.0**-k for k in range(3, 15)] + [-(1 - 1e-8), 0.998, 0.999999887]
    got = spark.createDataFrame([(y,) for y in ys], "y double").select("y", est.erf_inv(F.col("y")).alias("x")).collect()
    for r in got:
        assert math.erf(r["x"]) == pytest.approx(r["y"], abs=1e-13)
        if abs(r["y"]) < 0.9999:
            assert est.erf_inv_value(r["y"]) == pytest.approx(r["x"], rel=1e-9)
    edge = spark.createDataFrame([(1.0,), (-1.0,), (2.0,), (None,)], "y double").select(est.erf_inv(F.col("y")).alias("x")).collect()
    assert [r["x"] for r in edge] == [math.inf, -math.inf, None, None]


def test_other_estimators(population):
    s = sampling.swr_sample(population, 400, layout(), 9)
    r = s.agg(est.approx_count("y").alias("c"), est.approx_count_half_ci("y", 0.99).alias("h"), est.approx_count_star_half_ci(0.99).alias("z"), est.approx_avg("x").alias("a")).first()
    assert abs(r["c"] - 320) <= r["h"]
    assert r["z"] == pytest.approx(0, abs=1e-6)
    assert 200 < r["a"] < 400


def test_relative_error_matches_groups_by_key(spark):
    e = spark.createDataFrame([("a", 10.0), ("b", 0.0), ("c", 4.0)], "k string, v double")
    a = spark.createDataFrame([("c", 5.0), ("b", 0.0), ("d", 1.0)], "k string, v double")
    got = {r["k"]: r["err_v"] for r in est.relative_error(e, a, ["k"], ["v"]).collect()}
    assert got == {"a": 100.0, "b": 0.0, "c": 25.0, "d": None}


def test_range_index(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(100)], "k long, v double")
    bucket, sums = F.floor(F.col("k") / 10), {"v": F.col("v")}
    s = range_index.build(df, bucket, sums)
    got = range_index.range_totals(df, s, F.col("k"), bucket, F.lit(13), F.lit(57), F.lit(1), F.lit(5), sums).first()
    assert (got["cnt"], got["v"]) == (44, sum(range(13, 57)))
    one = range_index.range_totals(df, s, F.col("k"), bucket, F.lit(12), F.lit(15), F.lit(1), F.lit(1), sums).first()
    assert (one["cnt"], one["v"]) == (3, 12 + 13 + 14)
    assert range_index.totals(s, 2, 4).first()["cnt"] == 20
    merged = range_index.merge(s, range_index.build(df.where("k < 10"), bucket, sums, sign=-1))
    assert merged.where("bucket = 0").count() == 0
    with pytest.raises(TypeError):
        range_index.validate_key(df.withColumn("a", F.array("k")), "a")


def test_sql_front(spark, population):
    population.createOrReplaceTempView("pop")
    how = {"pop": sqlfront.SampledTable("id", layout(), "id div 10")}
    q = "SELECT approx_sum(x) AS s, approx_count(*) AS c, max(inv_sample_prob()) AS m FROM pop TABLESAMPLE SWR(200) REPEATABLE(4) WHERE id >= 100 AND id < 300 AND k <> 2"
    r = sqlfront.sql(spark, q, how).first()
    want = sampling.swr_sample(population.where("id >= 100 and id < 300"), 200, layout(), 4).where("k <> 2").agg(est.approx_sum("x").alias("s"), est.approx_count().alias("c")).first()
    assert (r["s"], r["c"], r["m"]) == (pytest.approx(want["s"]), pytest.approx(want["c"]), pytest.approx(200))
    assert sqlfront.explain(q) == "Sampling: swr (200) REPEATABLE (4)"
    assert sqlfront.sql(spark, "SELECT count(*) AS n FROM pop TABLESAMPLE BERNOULLI(100)", how).first()["n"] == 400
    with pytest.raises(ValueError, match="TABLESAMPLE"):
        sqlfront.sql(spark, "SELECT approx_sum(x) FROM pop", how)
    with pytest.raises(sampling.SampleError):
        sqlfront.sql(spark, "SELECT 1 FROM pop TABLESAMPLE SWR(NULL)", how)
    assert sampling.explain_sampling("SWR", [5], as_json=True) == {"Sampling Method": "SWR", "Sampling Parameters": ["5"]}


def test_rejection_warning():
    with pytest.warns(UserWarning, match="rejected"):
        assert sampling.warn_if_rejecting(0, 5001, 5)
    assert not sampling.warn_if_rejecting(0, 5000, 5)


def test_rejection_report(population):
    s = sampling.swr_sample(population, 50, layout(), 1)
    r = sampling.rejection_report(s, F.col("k") == 3, 50)
    assert r["n_attempted"] == 50 and 0 < r["n_accepted"] < 50 and not r["warned"]


def test_ranked_table_draws_the_same_and_reads_little(spark, population, tmp_path):
    nulls = population.withColumn("k", F.when(F.col("id") % 9 > 0, F.col("k")))
    stored = ranked.RankedTable.write(nulls, f"file://{tmp_path}/ranked", layout(), partitions=8)
    for low, high in ((None, None), (2, 5), (0, None), (None, 3)):
        part = nulls if low is None else nulls.where(F.col("k") >= low)
        part = part if high is None else part.where((F.col("k") < high) | (F.col("k").isNull() & F.lit(low is None)))
        a, b = sampling.swr_sample(part, 60, layout(), 6), stored.sample(60, 6, low, high)
        assert a.columns == b.columns
        assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr), (low, high)
    few = stored.sample(2, 1, 3, 4)
    few.collect()
    scan = few._jdf.queryExecution().executedPlan()
    scan = (scan.finalPhysicalPlan() if "AdaptiveSparkPlan" in scan.nodeName() else scan).collectLeaves()
    files = [scan.apply(i).metrics().apply("numFiles").value() for i in range(scan.size()) if scan.apply(i).metrics().contains("numFiles")]
    assert len(spark.read.parquet(f"file://{tmp_path}/ranked/rows").inputFiles()) == 8 and 1 <= sum(files) <= 2
    plan = few._jdf.queryExecution().toString()
    assert "__at" in plan.partition("PushedFilters: [")[2].partition("ReadSchema")[0]
    again = ranked.RankedTable(spark, f"file://{tmp_path}/ranked").sample(5, 2)
    assert again.count() == 5 and stored.sample(0, 1).count() == 0
    with pytest.warns(UserWarning, match="empty"):
        assert stored.sample(5, 1, 50, 60).count() == 0
    for bad in ((None, 1), (-1, 1), (1, None)):
        with pytest.raises(sampling.SampleError):
            stored.sample(*bad)


@pytest.mark.parametrize(
    ("where", "want"),
    [
        ("k < 5 OR k > 10", None), ("k < 5 OR q > 3", None), ("NOT k < 5", None), ("NOT (k < 5 AND q > 1)", None), ("k < 5", "k < 5"), ("(k < 5)", "k < 5"), ("q > 1 AND (k >= 2 AND k < 9)", "k >= 2 AND k < 9"),
        ("k BETWEEN 2 AND 7 AND q BETWEEN 1 AND 3", "k BETWEEN 2 AND 7"), ("(k < 5 OR q = 1) AND k > 0", "k > 0"), ("k + 1 < 5 AND k < q AND k < 4", "k < 4"), ("q = 'k < 5 AND k > 2'", None),
        ("t.k = 3 AND u.k = 4", "k = 3"), ("k < 5 AND k > (SELECT min(k) FROM u WHERE k < 3)", "k < 5"), ("CASE WHEN k < 3 THEN q > 1 AND k > 1 ELSE true END AND k < 6", "k < 6"), ("k >= DATE '2020-01-01' and K < timestamp '2021-01-01'", "k >= DATE '2020-01-01' AND k < timestamp '2021-01-01'"),
    ],
)
def test_range_of_the_key(where, want):
    assert sqlfront.key_range(where, "k", ("t",)) == want


def test_sql_front_estimates_under_or_and_not(spark, population):
    """What is no conjunct bounds no draw: estimates stay near the truth."""
    population.createOrReplaceTempView("pop")
    spark.range(400).selectExpr("id as other", "id % 3 as g").createOrReplaceTempView("others")
    how = {"pop": sqlfront.SampledTable("id", layout(), "id div 10")}
    for where in ("id < 100 OR id >= 300", "NOT id < 200", "id < 200 OR k = 1", "NOT (id < 100 AND k = 1)", "id < 300 AND (id > 200 OR k < 3)"):
        got = sqlfront.sql(spark, f"SELECT approx_count(*) AS c FROM pop TABLESAMPLE SWR(4000) REPEATABLE(4) WHERE {where}", how).first()["c"]
        assert got == pytest.approx(population.where(where).count(), rel=0.15), where
    joined = sqlfront.sql(spark, "SELECT g, approx_count(*) AS c FROM others o JOIN pop AS p TABLESAMPLE SWR(3000) REPEATABLE(4) ON p.id = o.other WHERE p.id < 200 GROUP BY g ORDER BY g", how).collect()
    assert [r["c"] for r in joined] == pytest.approx([67, 67, 66], rel=0.15)
    assert sqlfront.sql(spark, "SELECT count(*) AS n FROM pop p TABLESAMPLE SYSTEM_TIME(600000)", how).first()["n"] == 400
    with pytest.raises(ValueError, match="one table"):
        sqlfront.sql(spark, "SELECT 1 FROM pop TABLESAMPLE SWR(1), pop TABLESAMPLE SWR(1)", how)
    assert sqlfront.explain_plan(spark, "SELECT count(*) FROM pop TABLESAMPLE SWR(9) REPEATABLE(4)", how).startswith("Sampling: swr (9) REPEATABLE (4)\n")
