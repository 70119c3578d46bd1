"""Transactions and streams over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans import sqlfront
from quern.sources import scratch
from quern.sources.tables import table
from quern.streaming import updates


def _orders(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 10).alias("district"), F.col("o_orderkey").alias("order"), F.col("o_custkey").alias("customer"), F.lit(None).cast("int").alias("carrier"))


def _lines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 10).alias("district"), F.col("l_orderkey").alias("order"), F.col("l_partkey").alias("item"), F.col("l_quantity").cast("long").alias("quantity"), F.col("l_extendedprice").alias("amount"), F.lit(None).cast("date").alias("delivered"))


def txn_new_order(spark, sf_dir):
    """A batch of the open orders on top of all others: stock afterwards."""
    o, l = _orders(spark, sf_dir), _lines(spark, sf_dir)  # noqa: E741
    stock = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.lit(50).cast("long").alias("quantity"), F.lit(0).cast("long").alias("ytd"), F.lit(0).cast("long").alias("order_cnt"))
    opened = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("order"))
    old, new = (lambda df: df.join(opened, "order", "left_anti").select(df.columns)), (lambda df: df.join(opened, "order", "left_semi").select(df.columns))
    _, _, after = updates.new_orders(old(o), old(l), stock, new(o), new(l))
    return after


def txn_payment(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_acctbal").alias("balance"), F.lit(0).cast("long").alias("payments"))
    batch = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.round(F.col("o_totalprice") / 100).alias("amount"))
    after, _ = updates.payments(c, batch.limit(0), batch)
    return after.select("customer", F.round("balance", 2).alias("balance"), "payments")


def txn_delivery(spark, sf_dir):
    o, l = _orders(spark, sf_dir), _lines(spark, sf_dir)  # noqa: E741
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"), F.lit(0.0).alias("balance"), F.lit(0).cast("long").alias("deliveries"))
    rest, done, sent, billed = updates.deliver(o.select("district", "order"), o, l, c, F.lit("2002-01-01").cast("date"))
    part = lambda df, name, cond, value: df.where(cond).agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum(value), F.lit(0.0)), 2).alias("s")).select(F.lit(name).alias("what"), "n", "s")
    return part(rest, "open", F.lit(True), F.lit(0.0)).union(part(done, "carried", F.col("carrier").isNotNull(), F.lit(0.0))).union(part(sent, "sent", F.col("delivered").isNotNull(), F.col("amount"))).union(part(billed, "billed", F.col("deliveries") > 0, F.col("balance")))


def sql_front(spark, sf_dir):
    """The SQL form of a sampled query; equal to the DataFrame form of the same seed."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    from quern.plans.aqp import SEED, SINCE, UNTIL, layout

    how = {"lineitem": sqlfront.SampledTable("l_shipdate", layout())}
    return sqlfront.sql(spark, f"SELECT l_returnflag, round(approx_sum(l_extendedprice), 2) AS sum_amount, round(approx_count(*), 2) AS cnt, round(approx_sum_half_ci(l_extendedprice, 0.95), 2) AS half FROM lineitem TABLESAMPLE SWR (800) REPEATABLE ({SEED}) WHERE l_shipdate >= TIMESTAMP '{SINCE}' AND l_shipdate < TIMESTAMP '{UNTIL}' AND l_quantity > 5 GROUP BY l_returnflag", how)


def _streamed(spark, sf_dir, build, mode: str, keys: list[str]) -> DataFrame:
    """What a stream of the events table, read file by file, has put out when all of it is processed: the last state of each
    key. Batches are written as Parquet by the executors; a batch that is run again overwrites what it wrote."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    root, out = f"{scratch.folder(spark)}/quern-out-{uuid.uuid4().hex}", build(stream)
    scratch.keep(root, spark)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/data/batch={number}")

    out.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    written = spark.read.schema(out.schema.add("batch", "long")).parquet(f"{root}/data")
    if mode == "complete":
        return written.where(F.col("batch") == written.agg(F.max("batch")).first()[0]).select(out.columns)
    rest = [c for c in out.columns if c not in keys]
    last = written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
    return last.select(*keys, "last.*")


def stream_windows(spark, sf_dir):
    out = _streamed(spark, sf_dir, lambda s: updates.windowed_counts(s.withColumn("ts", F.col("ts").cast("timestamp"))), "update", ["start", "event_type"])
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


def stream_sessions(spark, sf_dir):
    out = _streamed(spark, sf_dir, lambda s: updates.sessions(s.withColumn("ts", F.col("ts").cast("timestamp"))), "complete", [])
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"))


def stream_summary(spark, sf_dir):
    """A summary kept up by a stream of inserts, read after the last batch."""
    schema, root = table(spark, sf_dir, "events").schema, f"{scratch.folder(spark)}/summary-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    summary = updates.SummaryStream(spark, f"{root}/data", F.to_date("ts"), {"total": F.col("value")})
    summary.start(stream, f"{root}/checkpoint").awaitTermination()
    return summary.read().select(F.date_format("bucket", "yyyy-MM-dd").alias("day"), "cnt", F.round("total", 2).alias("total"))


QUERIES = (txn_new_order, txn_payment, txn_delivery, sql_front, stream_windows, stream_sessions, stream_summary)


def _oracle() -> dict[str, str]:
    from quern.plans.aqp import _half_ci, _swr

    sample = _swr(800)
    return {
        "txn_new_order": "SELECT p_partkey AS item, CAST(CASE WHEN 50 - coalesce(q, 0) >= 10 THEN 50 - coalesce(q, 0) ELSE 50 - q + 91 * ceil((10 - (50 - q)) / 91.0) END AS BIGINT) AS quantity, CAST(coalesce(q, 0) AS BIGINT) AS ytd, coalesce(n, 0) AS order_cnt FROM part LEFT JOIN (SELECT l_partkey, sum(CAST(l_quantity AS BIGINT)) AS q, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') GROUP BY 1) t ON p_partkey = l_partkey",
        "txn_payment": "SELECT c_custkey AS customer, round(c_acctbal - coalesce(a, 0), 2) AS balance, coalesce(n, 0) AS payments FROM customer LEFT JOIN (SELECT o_custkey, sum(round(o_totalprice / 100)) AS a, count(*) AS n FROM orders GROUP BY 1) t ON c_custkey = o_custkey",
        "txn_delivery": "WITH t AS (SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderkey % 10 ORDER BY o_orderkey) <= 10), s AS (SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS s FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM t)) SELECT 'open' AS what, (SELECT count(*) FROM orders) - (SELECT count(*) FROM t) AS n, 0.0::DOUBLE AS s UNION ALL SELECT 'carried', count(*), 0.0 FROM t UNION ALL SELECT 'sent', n, s FROM s UNION ALL SELECT 'billed', (SELECT count(DISTINCT o_custkey) FROM t WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)), s FROM s",
        "sql_front": f"SELECT l_returnflag, round(sum(l_extendedprice / p) / max(n), 2) AS sum_amount, round(sum(1.0 / p) / max(n), 2) AS cnt, round({_half_ci('l_extendedprice / p')}, 2) AS half FROM {sample} x WHERE l_quantity > 5 GROUP BY l_returnflag",
        "stream_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
        "stream_sessions": "SELECT user_id, count(*) FILTER (fresh) AS sessions, count(*) AS events FROM (SELECT user_id, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE, true) AS fresh FROM events) t GROUP BY user_id",
        "stream_summary": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS cnt, round(sum(value), 2) AS total FROM events GROUP BY 1",
    }


ORACLE = _oracle()
