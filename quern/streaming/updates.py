"""Concurrent updates as micro-batches: inserts keep a range summary up to date while queries read its last snapshot.

The three transactions of the workload are functions from tables to tables, so that a batch of them is one plan:
new orders append, payments add sums by key, deliveries take the oldest open orders of each district.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import range_index


def new_orders(orders: DataFrame, lines: DataFrame, stock: DataFrame, batch_orders: DataFrame, batch_lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders and their lines appended; stock lowered by what was ordered, filled up by 91 where it would fall below 10."""
    taken = batch_lines.groupBy("item").agg(F.sum("quantity").alias("__q"), F.count(F.lit(1)).alias("__n"))
    left = F.col("quantity") - F.coalesce("__q", F.lit(0))
    filled = F.when(left >= 10, left).otherwise(left + 91 * F.ceil((10 - left) / 91))
    moved = stock.join(taken, "item", "left").select("item", filled.cast("long").alias("quantity"), (F.col("ytd") + F.coalesce("__q", F.lit(0))).alias("ytd"), (F.col("order_cnt") + F.coalesce("__n", F.lit(0))).alias("order_cnt"))
    return orders.unionByName(batch_orders), lines.unionByName(batch_lines), moved


def payments(customers: DataFrame, history: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Balances lowered and payment counts raised by the sums of a batch; each payment appended to the history."""
    sums = batch.groupBy("customer").agg(F.sum("amount").alias("__a"), F.count(F.lit(1)).alias("__n"))
    paid = customers.join(sums, "customer", "left").select("customer", (F.col("balance") - F.coalesce("__a", F.lit(0.0))).alias("balance"), (F.col("payments") + F.coalesce("__n", F.lit(0))).alias("payments"))
    return paid, history.unionByName(batch.select(history.columns))


def deliver(open_orders: DataFrame, orders: DataFrame, lines: DataFrame, customers: DataFrame, day: Column, per_district: int = 10) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(open orders, orders, lines, customers) after the oldest open orders of each district went out.

    Their lines get the delivery day, their customers the sum of the lines. The number of districts is small and
    a top-k for each is pushed below the exchange.
    """
    oldest = Window.partitionBy("district").orderBy("order")
    taken = open_orders.withColumn("__k", F.row_number().over(oldest)).where(F.col("__k") <= per_district).select("district", "order")
    rest = open_orders.join(taken, ["district", "order"], "left_anti")
    mark = taken.withColumn("__d", F.lit(True))
    sent = lines.join(mark, ["district", "order"], "left").withColumn("delivered", F.when(F.col("__d"), day).otherwise(F.col("delivered")))
    sums = sent.where("__d").groupBy("district", "order").agg(F.sum("amount").alias("__a"))
    per_customer = sums.join(orders, ["district", "order"]).groupBy("customer").agg(F.sum("__a").alias("__a"), F.count(F.lit(1)).alias("__n"))
    billed = customers.join(per_customer, "customer", "left").select("customer", (F.col("balance") + F.coalesce("__a", F.lit(0.0))).alias("balance"), (F.col("deliveries") + F.coalesce("__n", F.lit(0))).alias("deliveries"))
    done = orders.join(mark, ["district", "order"], "left").withColumn("carrier", F.when(F.col("__d"), F.lit(1)).otherwise(F.col("carrier"))).drop("__d")
    return rest, done, sent.drop("__d"), billed


class SummaryStream:
    """A range summary that a stream of inserts keeps up: each micro-batch writes its delta under its own number.

    A batch that comes again replaces its folder, so it counts once; readers add up the deltas.
    """

    def __init__(self, spark: SparkSession, path: str, bucket: Column, sums: Mapping[str, Column] | None = None):
        self.spark, self.path, self.bucket, self.sums = spark, path.rstrip("/"), bucket, sums

    def apply(self, batch: DataFrame, number: int) -> None:
        range_index.build(batch, self.bucket, self.sums).write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger: object):
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def read(self) -> DataFrame:
        return range_index.merge(self.spark.read.parquet(self.path).drop("batch"))


def windowed_counts(stream: DataFrame, length: str = "1 day", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Counts and sums by window and type; rows more than `late` behind the latest time are dropped by the watermark."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Events of a user with no pause longer than `gap`."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "user_id", "n")


def window_sample(stream: DataFrame, pct: float, length: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Estimated counts of each window from a Bernoulli sample of the stream."""
    from quern.operators import sampling

    return sampling.bernoulli_sample(stream.withWatermark("ts", late), pct, ("event_id",)).groupBy(F.window("ts", length).alias("w")).agg((F.sum(F.lit(1.0) / F.col(sampling.P))).alias("estimate")).select(F.col("w.start").alias("start"), "estimate")
