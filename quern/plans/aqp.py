"""Approximate queries: exact, sampled with replacement, and Bernoulli forms of three analytic queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import estimators as est
from quern.operators import range_index, ranked, sampling
from quern.sources.tables import table

IDENTITY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
SINCE, UNTIL = "1997-01-01", "1998-01-01"
SEED = 42
SIZES = {"q1": 1000, "q1_ci": 500, "q2": 500, "q3": 2000, "background": 10000}
PERCENT = {"q1": 0.2, "q2": 0.5, "q3": 0.5}


def layout() -> sampling.Layout:
    return sampling.Layout(F.to_date("l_shipdate"), IDENTITY, digits=1)


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where((F.col("l_shipdate") >= F.lit(SINCE).cast("timestamp")) & (F.col("l_shipdate") < F.lit(UNTIL).cast("timestamp")))


def r2(c, alias: str):
    return F.round(c, 2).alias(alias)


def q1_exact(spark, sf_dir):
    return population(spark, sf_dir).agg(r2(F.sum("l_extendedprice"), "sum_amount"), F.count(F.lit(1)).alias("cnt"))


def q1_swr(spark, sf_dir):
    s = sampling.swr_sample(population(spark, sf_dir), SIZES["q1"], layout(), SEED)
    return s.agg(r2(est.approx_sum("l_extendedprice"), "sum_amount"), r2(est.approx_count(), "cnt"))


def q1_swr_with_ci(spark, sf_dir):
    """Estimates of two groups of draws with half widths relative to them; the filter on the flag comes after the draw."""
    s = sampling.swr_sample(population(spark, sf_dir), SIZES["q1_ci"], layout(), SEED).where("l_returnflag = 'R'")
    got = s.agg(est.approx_sum("l_extendedprice").alias("s"), est.approx_sum_half_ci("l_extendedprice", 0.95).alias("sh"), est.approx_count().alias("c"), est.approx_count_star_half_ci(0.95).alias("ch"))
    return got.select(r2(F.col("s"), "sum_amount"), r2(F.col("sh"), "sum_half_ci"), F.round(F.col("sh") / F.col("s"), 6).alias("sum_rel_ci"), r2(F.col("c"), "cnt"), r2(F.col("ch"), "cnt_half_ci"), F.round(F.col("ch") / F.col("c"), 6).alias("cnt_rel_ci"))


def q1_swr_count_column(spark, sf_dir):
    """Estimated counts of a column that is null in part, and the half width of their interval."""
    s = sampling.swr_sample(population(spark, sf_dir), SIZES["q1"], layout(), SEED)
    cheap = F.when(F.col("l_discount") < 0.05, F.col("l_discount"))
    return s.agg(r2(est.approx_count(cheap), "cnt"), r2(est.approx_count_half_ci(cheap, 0.95), "half"))


def q1_swr_stored(spark, sf_dir):
    """The same draws as q1_swr from rows stored in the order of their ranks: only files and pages with drawn rows are read."""
    from quern.sources import scratch

    path = f"{scratch.folder(spark)}/quern-ranked-{uuid.uuid4().hex}"
    scratch.keep(path, spark)
    stored = ranked.RankedTable.write(table(spark, sf_dir, "lineitem"), path, layout())
    return stored.sample(SIZES["q1"], SEED, SINCE, UNTIL).agg(r2(est.approx_sum("l_extendedprice"), "sum_amount"), r2(est.approx_count(), "cnt"))


def q1_bernoulli(spark, sf_dir):
    s = sampling.bernoulli_sample(table(spark, sf_dir, "lineitem"), PERCENT["q1"], IDENTITY, SEED)
    inside = s.where((F.col("l_shipdate") >= F.lit(SINCE).cast("timestamp")) & (F.col("l_shipdate") < F.lit(UNTIL).cast("timestamp")))
    return inside.agg(r2(est.approx_sum("l_extendedprice"), "sum_amount"), r2(est.approx_count(), "cnt"))


def _outliers(spark, sf_dir, average: DataFrame) -> DataFrame:
    rows = population(spark, sf_dir).join(F.broadcast(average), F.col("l_extendedprice") > 1.5 * F.col("a"))  # one row
    return rows.select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(10)


def q2_exact(spark, sf_dir):
    return _outliers(spark, sf_dir, population(spark, sf_dir).agg(F.avg("l_extendedprice").alias("a")))


def q2_swr(spark, sf_dir):
    s = sampling.swr_sample(population(spark, sf_dir), SIZES["q2"], layout(), SEED)
    return _outliers(spark, sf_dir, s.agg(F.avg("l_extendedprice").alias("a")))


def q2_bernoulli(spark, sf_dir):
    s = sampling.bernoulli_sample(population(spark, sf_dir), PERCENT["q2"], IDENTITY, SEED)
    return _outliers(spark, sf_dir, s.agg(F.avg("l_extendedprice").alias("a")))


def _segments(spark, sf_dir, lines: DataFrame) -> DataFrame:
    """N:1 joins of lines to orders and customers: each line meets one of each, so estimators stay unbiased."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment")


def q3_exact(spark, sf_dir):
    return _segments(spark, sf_dir, population(spark, sf_dir)).agg(r2(F.sum("l_extendedprice"), "sum_amount"), F.count(F.lit(1)).alias("cnt"))


def q3_swr(spark, sf_dir):
    s = sampling.swr_sample(population(spark, sf_dir), SIZES["q3"], layout(), SEED)
    return _segments(spark, sf_dir, s).agg(r2(est.approx_sum("l_extendedprice"), "sum_amount"), r2(est.approx_count(), "cnt"), r2(est.approx_sum_half_ci("l_extendedprice", 0.95), "sum_half_ci"))


def q3_bernoulli(spark, sf_dir):
    s = sampling.bernoulli_sample(population(spark, sf_dir), PERCENT["q3"], IDENTITY, SEED)
    return _segments(spark, sf_dir, s).agg(r2(est.approx_sum("l_extendedprice"), "sum_amount"), r2(est.approx_count(), "cnt"))


def background_sampler(spark, sf_dir):
    s = sampling.swr_sample(population(spark, sf_dir), SIZES["background"], layout(), SEED)
    return s.agg(F.count(F.lit(1)).alias("draws"), F.count_distinct(*IDENTITY).alias("distinct_rows"))


def relerr_q3(spark, sf_dir):
    """Relative errors of both sampled forms against the exact one, by group."""
    exact = q3_exact(spark, sf_dir)
    parts = [est.relative_error(exact, f(spark, sf_dir), ["c_mktsegment"], ["sum_amount", "cnt"]).withColumn("method", F.lit(n)) for n, f in (("swr", q3_swr), ("bernoulli", q3_bernoulli))]
    return parts[0].unionByName(parts[1]).select("method", "c_mktsegment", F.round("err_sum_amount", 6).alias("err_sum_amount"), F.round("err_cnt", 6).alias("err_cnt"))


#: Arguments on all three branches of the inverse error function: |y| up to 0.999, up to 1 - 1e-7, and above.
GRID = (*(i / 100 for i in range(-95, 96)), *(s * (1 - 10.0**-k) for s in (-1, 1) for k in (3, 4, 6, 7, 8, 9)))


def erf_inv_grid(spark, sf_dir):
    """Inverse of values of the error function on all three branches."""
    return spark.createDataFrame([(y,) for y in GRID], "y double").select("y", F.round(est.erf_inv(F.col("y")), 9).alias("x"))


def sample_probabilities(spark, sf_dir):
    s = sampling.swr_sample(population(spark, sf_dir), 50, layout(), SEED)
    return s.agg(F.round(F.max(est.sample_prob()), 9).alias("p"), F.round(F.max(est.inv_sample_prob()), 4).alias("inv_p"), F.count(F.lit(1)).alias("n"))


def rejection_metrics(spark, sf_dir):
    s = sampling.swr_sample(table(spark, sf_dir, "lineitem"), 1000, layout(), SEED)
    return sampling.rejections(s, F.col("l_returnflag") == "R")


def system_blocks(spark, sf_dir):
    s = sampling.system_sample(table(spark, sf_dir, "lineitem"), 25, F.floor(F.col("l_orderkey") / 64), SEED)
    return s.agg(F.count(F.lit(1)).alias("cnt"), F.count_distinct("l_orderkey").alias("orders"), r2(est.approx_count(), "estimate"))


def system_rows(spark, sf_dir):
    return sampling.rows_sample(table(spark, sf_dir, "orders"), 100, ("o_orderkey",), SEED).select("o_orderkey", "o_custkey")


def stratified_reservoir(spark, sf_dir):
    return sampling.stratified_sample(table(spark, sf_dir, "customer"), ["c_mktsegment"], 5, ("c_custkey",), SEED).select("c_mktsegment", "c_custkey")


def sample_limits(spark, sf_dir):
    """0 and 100 percent."""
    t = table(spark, sf_dir, "orders")
    none, every = sampling.bernoulli_sample(t, 0, ("o_orderkey",)), sampling.bernoulli_sample(t, 100, ("o_orderkey",))
    return none.agg(F.count(F.lit(1)).alias("none")).crossJoin(every.agg(F.count(F.lit(1)).alias("every")))


def sampling_throughput(spark, sf_dir):
    """Inserts and samples a second and rejections from counters of a feed, by differences to the second before."""
    from pyspark.sql import Window

    feed = table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").alias("t")).agg(F.count_if(F.col("event_type") == "purchase").alias("ins"), F.count_if(F.col("event_type") == "view").alias("att"), F.count_if((F.col("event_type") == "view") & (F.col("value") < 50)).alias("acc"))
    upto = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)  # one row a day
    counters = feed.select("t", *[F.sum(c).over(upto).alias(c) for c in ("ins", "att", "acc")])
    w = Window.orderBy("t")
    d = counters.select("t", *[(F.col(c) - F.lag(c).over(w)).alias(c) for c in ("ins", "att", "acc")], F.unix_timestamp("t").alias("s"), (F.unix_timestamp("t") - F.lag(F.unix_timestamp("t")).over(w)).alias("dt")).where("dt is not null")
    return d.select("s", F.round(F.col("ins") / F.col("dt"), 9).alias("inserts_per_s"), F.round(F.col("acc") / F.col("dt"), 9).alias("samples_per_s"), F.round((F.col("att") - F.col("acc")) * 100.0 / F.greatest("att", F.lit(1)), 6).alias("rejection_pct"))


def range_summary(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return range_index.build(lines, F.trunc("l_shipdate", "month"), {"amount": F.col("l_extendedprice")}).select(F.date_format("bucket", "yyyy-MM-dd").alias("bucket"), "cnt", r2(F.col("amount"), "amount"))


def range_summary_query(spark, sf_dir):
    """A range that cuts through two buckets: whole months from the summary, border months from rows."""
    lines = table(spark, sf_dir, "lineitem")
    sums = {"amount": F.col("l_extendedprice")}
    summary = range_index.build(lines, F.trunc("l_shipdate", "month"), sums)
    day = lambda s: F.lit(s).cast("timestamp")
    got = range_index.range_totals(lines, summary, F.col("l_shipdate"), F.trunc("l_shipdate", "month"), day("1996-02-11"), day("1998-07-23"), F.lit("1996-02-01").cast("date"), F.lit("1998-07-01").cast("date"), sums)
    return got.select("cnt", r2(F.col("amount"), "amount"))


def range_summary_upsert(spark, sf_dir):
    """Inserts of one year and deletes of one return flag, as deltas; the summary equals one built afresh."""
    lines, month = table(spark, sf_dir, "lineitem"), F.trunc("l_shipdate", "month")
    old = range_index.build(lines.where("year(l_shipdate) <> 1999"), month)
    plus = range_index.build(lines.where("year(l_shipdate) = 1999"), month)
    minus = range_index.build(lines.where("l_returnflag = 'A'"), month, sign=-1)
    return range_index.merge(old, plus, minus).select(F.date_format("bucket", "yyyy-MM-dd").alias("bucket"), "cnt")


QUERIES = (
    q1_exact, q1_swr, q1_swr_with_ci, q1_swr_count_column, q1_swr_stored, q1_bernoulli, q2_exact, q2_swr, q2_bernoulli, q3_exact, q3_swr, q3_bernoulli, background_sampler, relerr_q3, erf_inv_grid,
    sample_probabilities, rejection_metrics, system_blocks, system_rows, stratified_reservoir, sample_limits, sampling_throughput, range_summary, range_summary_query, range_summary_upsert,
)

# The same in SQL. Ranks follow (day, digest of the row's identity); draws are the first 32 bits of md5('i|seed').
_POP = f"(SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '{SINCE}' AND l_shipdate < TIMESTAMP '{UNTIL}')"
_DIGEST = "md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey))"


def _bits(expression: str) -> str:
    return f"CAST(('0x' || substring(md5({expression}), 1, 8)) AS BIGINT)"


def _swr(n: int, population: str = _POP) -> str:
    return f"""(WITH pop AS (SELECT *, row_number() OVER (ORDER BY CAST(l_shipdate AS DATE), {_DIGEST}) - 1 AS rk FROM {population} p),
        m AS (SELECT count(*) AS m FROM pop),
        d AS (SELECT CAST(floor({_bits(f"CAST(i AS VARCHAR) || '|{SEED}'")} * m / 4294967296) AS BIGINT) AS rk FROM range({n}) t(i), m WHERE m > 0)
        SELECT pop.*, 1.0::DOUBLE / m.m AS p, {n}::DOUBLE AS n FROM d JOIN pop USING (rk), m)"""


def _bernoulli(pct: float, source: str) -> str:
    return f"(SELECT *, {pct / 100}::DOUBLE AS p, 1.0::DOUBLE AS n FROM {source} b WHERE {_bits(f"concat_ws('|', '{SEED}', l_orderkey, l_linenumber, l_partkey, l_suppkey)")} < {int(pct / 100 * 4294967296)})"


def _half_ci(x: str) -> str:
    n, s, d = f"count({x})", f"sum({x})", f"(var_pop({x}) * count({x}))"
    z = est.erf_inv_value(0.95)
    return f"({z} * sqrt(2.0 * CASE WHEN max(n) - {n} <= 0 THEN {d} ELSE {d} + {n} * (max(n) - {n}) / max(n) * ({s} / {n}) * ({s} / {n}) END / (max(n) * (max(n) - 1))))"


_JOINED = "{0} l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"
_EST = "round(sum(l_extendedprice / p) / max(n), 2) AS sum_amount, round(coalesce(sum(1.0 / p) / max(n), 0), 2) AS cnt"
_OUTLIERS = f"SELECT l_orderkey, l_linenumber, l_extendedprice FROM {_POP} x WHERE l_extendedprice > 1.5 * (SELECT avg(l_extendedprice) FROM {{0}} y) ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10"
_Q3 = "SELECT c_mktsegment, {1} FROM " + _JOINED + " GROUP BY c_mktsegment"
_EXACT3 = _Q3.format(_POP, "round(sum(l_extendedprice), 2) AS sum_amount, count(*) AS cnt")
_SWR3 = _Q3.format(_swr(SIZES["q3"]), _EST + f", round({_half_ci('l_extendedprice / p')}, 2) AS sum_half_ci")
_BERNOULLI3 = _Q3.format(_bernoulli(PERCENT["q3"], _POP), _EST)

ORACLE = {
    "q1_exact": f"SELECT round(sum(l_extendedprice), 2) AS sum_amount, count(*) AS cnt FROM {_POP} x",
    "q1_swr": f"SELECT {_EST} FROM {_swr(SIZES['q1'])} x",
    "q1_swr_stored": f"SELECT {_EST} FROM {_swr(SIZES['q1'])} x",
    "q1_swr_count_column": f"SELECT round(coalesce(sum(CASE WHEN l_discount < 0.05 THEN 1.0 / p END) / max(n), 0), 2) AS cnt, round({_half_ci('(CASE WHEN l_discount < 0.05 THEN 1.0 / p END)')}, 2) AS half FROM {_swr(SIZES['q1'])} x",
    "q1_swr_with_ci": f"""SELECT round(s, 2) AS sum_amount, round(sh, 2) AS sum_half_ci, round(sh / s, 6) AS sum_rel_ci, round(c, 2) AS cnt, round(ch, 2) AS cnt_half_ci, round(ch / c, 6) AS cnt_rel_ci FROM
        (SELECT sum(l_extendedprice / p) / max(n) AS s, {_half_ci('l_extendedprice / p')} AS sh, sum(1.0 / p) / max(n) AS c, {_half_ci('(1.0 / p)')} AS ch FROM {_swr(SIZES['q1_ci'])} x WHERE l_returnflag = 'R') y""",
    "q1_bernoulli": f"SELECT {_EST} FROM {_bernoulli(PERCENT['q1'], 'lineitem')} x WHERE l_shipdate >= TIMESTAMP '{SINCE}' AND l_shipdate < TIMESTAMP '{UNTIL}'",
    "q2_exact": _OUTLIERS.format(_POP),
    "q2_swr": _OUTLIERS.format(_swr(SIZES["q2"])),
    "q2_bernoulli": _OUTLIERS.format(_bernoulli(PERCENT["q2"], _POP)),
    "q3_exact": _EXACT3,
    "q3_swr": _SWR3,
    "q3_bernoulli": _BERNOULLI3,
    "background_sampler": f"SELECT count(*) AS draws, count(DISTINCT (l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS distinct_rows FROM {_swr(SIZES['background'])} x",
    "relerr_q3": " UNION ALL ".join(
        f"SELECT '{n}' AS method, c_mktsegment, round(abs(coalesce(a.sum_amount, 0) - e.sum_amount) / abs(e.sum_amount) * 100, 6) AS err_sum_amount, round(abs(coalesce(a.cnt, 0) - e.cnt) / e.cnt * 100, 6) AS err_cnt FROM ({_EXACT3}) e LEFT JOIN ({q}) a USING (c_mktsegment)"
        for n, q in (("swr", _SWR3), ("bernoulli", _BERNOULLI3))
    ),
    "erf_inv_grid": "SELECT * FROM (VALUES " + ", ".join(f"({y!r}::DOUBLE, {round(est.erf_inv_value(y), 9)!r}::DOUBLE)" for y in GRID) + ") AS t(y, x)",
    "sample_probabilities": f"SELECT round(max(p), 9) AS p, round(max(1.0 / p), 4) AS inv_p, count(*) AS n FROM {_swr(50)} x",
    "rejection_metrics": f"SELECT count(*) AS n_attempted, count(*) FILTER (l_returnflag = 'R') AS n_accepted, round((count(*) - count(*) FILTER (l_returnflag = 'R')) * 100.0::DOUBLE / count(*), 4) AS rejection_pct FROM {_swr(1000, 'lineitem')} x",
    "system_blocks": f"SELECT count(*) AS cnt, count(DISTINCT l_orderkey) AS orders, round(count(*) / 0.25::DOUBLE, 2) AS estimate FROM lineitem WHERE {_bits(f"CAST(l_orderkey // 64 AS VARCHAR) || '|{SEED}'")} < {1 << 30}",
    "system_rows": f"SELECT o_orderkey, o_custkey FROM orders ORDER BY md5(concat_ws('|', '{SEED}', o_orderkey)), o_orderkey LIMIT 100",
    "stratified_reservoir": f"SELECT c_mktsegment, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(concat_ws('|', '{SEED}', c_custkey)), c_custkey) <= 5",
    "sample_limits": "SELECT 0::BIGINT AS none, count(*) AS every FROM orders",
    "sampling_throughput": """WITH d AS (SELECT date_trunc('day', ts) AS t, count(*) FILTER (event_type = 'purchase') AS ins, count(*) FILTER (event_type = 'view') AS att, count(*) FILTER (event_type = 'view' AND value < 50) AS acc FROM events GROUP BY 1)
        SELECT CAST(epoch(t) AS BIGINT) AS s, round(ins / 86400.0::DOUBLE, 9) AS inserts_per_s, round(acc / 86400.0::DOUBLE, 9) AS samples_per_s, round((att - acc) * 100.0::DOUBLE / greatest(att, 1), 6) AS rejection_pct FROM d WHERE t > (SELECT min(t) FROM d)""",
    "range_summary": "SELECT strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS bucket, count(*) AS cnt, round(sum(l_extendedprice), 2) AS amount FROM lineitem GROUP BY 1",
    "range_summary_query": "SELECT count(*) AS cnt, round(sum(l_extendedprice), 2) AS amount FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-02-11' AND l_shipdate < TIMESTAMP '1998-07-23'",
    "range_summary_upsert": "SELECT strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS bucket, count(*) AS cnt FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1",
}
