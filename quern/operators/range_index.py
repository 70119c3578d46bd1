"""An aggregate summary over key ranges: counts and sums of buckets, kept up by adding deltas.

It answers counts and sums of key ranges without reading rows when the range ends on bucket borders, and reads only the
two border buckets otherwise. Any aggregate with an inverse (count, sum) can be kept up under inserts and deletes.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDERED = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType, T.BinaryType)


def validate_key(df: DataFrame, key: str) -> None:
    """A summary needs a key with an order."""
    if not isinstance(df.schema[key].dataType, ORDERED):
        raise TypeError(f"{key}: {df.schema[key].dataType.simpleString()} has no order to index")


def build(df: DataFrame, bucket: Column, sums: Mapping[str, Column] | None = None, sign: int = 1) -> DataFrame:
    """(bucket, cnt, and a column for each sum); sign -1 makes the delta of a delete."""
    measures = [F.sum(c * sign).alias(n) for n, c in (sums or {}).items()]
    return df.groupBy(bucket.alias("bucket")).agg((F.count(F.lit(1)) * sign).alias("cnt"), *measures)


def merge(*parts: DataFrame) -> DataFrame:
    """The summary of all parts: additive, so the order and number of deltas don't matter. Empty buckets go."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    measures = [F.sum(c).alias(c) for c in both.columns if c != "bucket"]
    return both.groupBy("bucket").agg(*measures).where("cnt <> 0")


def totals(summary: DataFrame, low: object, high: object) -> DataFrame:
    """Count and sums of the buckets in [low, high), in one row."""
    inside = summary.where((F.col("bucket") >= F.lit(low)) & (F.col("bucket") < F.lit(high)))
    return inside.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in summary.columns if c != "bucket"])


def range_totals(df: DataFrame, summary: DataFrame, key: Column, bucket: Column, low: Column, high: Column, low_bucket: Column, high_bucket: Column, sums: Mapping[str, Column] | None = None) -> DataFrame:
    """Exact count and sums of low <= key < high for any borders: whole buckets from the summary, the border buckets from rows."""
    whole = summary.where((F.col("bucket") > low_bucket) & (F.col("bucket") < high_bucket)).drop("bucket")
    edge = df.where(((bucket == low_bucket) | (bucket == high_bucket)) & (key >= low) & (key < high))
    edges = edge.agg(F.count(F.lit(1)).alias("cnt"), *[F.sum(c).alias(n) for n, c in (sums or {}).items()])
    return whole.unionByName(edges).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in whole.columns])
