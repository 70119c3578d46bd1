"""Sampling operators: with replacement at a fixed size, Bernoulli, by block, by exact row count, reservoir.

A sample carries two hidden columns for the estimators: __p, the probability of a row in one draw (or of its inclusion),
and __n, the number of draws (1 for Bernoulli and block samples).
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

P, N = "__p", "__n"
#: Attempts for each requested draw beyond which a range is thought to be empty.
REJECTION_FACTOR = 1000
DEFAULT_SIZE = 1000
#: Blocks of the rank axis in which draws look for their bucket.
RANK_BLOCKS = 4096


class SampleError(ValueError):
    """An argument of TABLESAMPLE is null, negative or out of range."""


def draw(i: Column, seed: int) -> Column:
    """A 32-bit number for draw i of a seed, the same in every engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat(i.cast("string"), F.lit("|"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")


def row_digest(identity: Sequence[str]) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity]))


@dataclass(frozen=True)
class Layout:
    """How rows are ranked: by bucket, a monotone function of the key, then by a digest of identity columns.

    The first `digits` hex digits of the digest split each bucket further, so that a key with a third of all rows is as
    finely split as any other.
    """

    bucket: Column
    identity: tuple[str, ...]
    digits: int = 1


def _placed(population: DataFrame, layout: Layout) -> DataFrame:
    rows = population.withColumns({"__b": layout.bucket, "__h": row_digest(layout.identity)})
    return rows.withColumn("__s", F.substring("__h", 1, layout.digits))


def rank_index(population: DataFrame, layout: Layout) -> DataFrame:
    """Counts of buckets (__b, __s, __c): stored once, they spare each later sample its pass over the population.

    Counts of a part of the buckets are an index of the rows in them; counts of several tables add up.
    """
    return _placed(population, layout).groupBy("__b", "__s").agg(F.count(F.lit(1)).alias("__c"))


def swr_sample(population: DataFrame, n: int | None, layout: Layout, seed: int | None = 0, index: DataFrame | None = None) -> DataFrame:
    """n independent uniform draws, with replacement, from the rows of `population` (the table after its range predicate).

    Counts of buckets take the part of an index: they are aggregated before they move, their prefix sums turn the rank of
    a draw into a bucket and an offset, and only rows of drawn buckets are ranked. The draws, not the rows, are broadcast;
    there are n of them. `index` is rank_index() of exactly this population, if it is stored; the sample is the same with
    and without. A row drawn k times appears k times. Equal seeds give equal samples. An empty population
    gives an empty sample; ranked.RankedTable, which knows the
    size of a range before it draws, warns of it, and rejection_report() of ranges that nearly all draws miss.
    """
    if n is None or n < 0:
        raise SampleError("sample size must not be null or negative")
    if seed is None:
        raise SampleError("TABLESAMPLE REPEATABLE parameter cannot be null")
    spark = population.sparkSession
    rows = _placed(population, layout)
    counts = rank_index(population, layout) if index is None else index.select("__b", "__s", "__c")
    # One row for each bucket: small beside the table, and spread over buckets of the first level before it is one.
    upper = counts.groupBy("__b").agg(F.sum("__c").alias("__t"))
    upper = upper.withColumn("__before", F.sum("__t").over(Window.orderBy("__b")) - F.col("__t"))
    total = upper.agg(F.sum("__t").alias("__m"))
    upper = upper.withColumnRenamed("__b", "__ub")
    inner = Window.partitionBy("__b").orderBy("__s")
    ranges = counts.join(upper, F.col("__b").eqNullSafe(F.col("__ub"))).withColumn("__first", F.col("__before") + F.sum("__c").over(inner) - F.col("__c"))
    draws = spark.range(n).select(F.col("id").alias("__i"), draw(F.col("id"), seed).alias("__u")).crossJoin(F.broadcast(total.where("__m > 0")))
    draws = draws.select("__i", "__m", F.floor(F.col("__u") * F.col("__m") / F.lit(4294967296)).cast("long").alias("__rank"))
    # A range join made an equi-join: ranks and buckets meet on blocks of the rank axis.
    block = F.greatest(F.lit(1), F.ceil(F.col("__m") / RANK_BLOCKS)).cast("long")
    covered = F.sequence(F.expr("__first div __w"), F.expr("(__first + __c - 1) div __w"))
    ranges = ranges.join(F.broadcast(total.select(block.alias("__w")))).withColumn("__k", F.explode(covered)).drop("__w")
    draws = draws.withColumn("__w", block).withColumn("__k", F.expr("__rank div __w"))
    placed = draws.join(ranges, "__k").where((F.col("__rank") >= F.col("__first")) & (F.col("__rank") < F.col("__first") + F.col("__c")))
    placed = placed.select(F.col("__b").alias("__db"), F.col("__s").alias("__ds"), (F.col("__rank") - F.col("__first")).alias("__offset"), "__m")
    needed = placed.select("__db", "__ds").distinct()
    ranked = rows.join(F.broadcast(needed), F.col("__b").eqNullSafe(F.col("__db")) & (F.col("__s") == F.col("__ds")), "left_semi")
    ranked = ranked.withColumn("__r", F.row_number().over(Window.partitionBy("__b", "__s").orderBy("__h")) - 1)
    out = ranked.join(F.broadcast(placed), F.col("__b").eqNullSafe(F.col("__db")) & (F.col("__s") == F.col("__ds")) & (F.col("__r") == F.col("__offset")))
    return out.select(*population.columns, (F.lit(1.0) / F.col("__m")).alias(P), F.lit(float(n)).alias(N))


def warn_if_rejecting(accepted: int, attempted: int, n: int) -> bool:
    """One warning once attempts pass REJECTION_FACTOR for each requested draw."""
    high = attempted > max(REJECTION_FACTOR * n, 1)
    if high:
        warnings.warn(f"more than {100 * (1 - 1 / REJECTION_FACTOR):.1f} % of {attempted} draws were rejected; the range may be empty", stacklevel=2)
    return high


def rejections(sample: DataFrame, residual: Column) -> DataFrame:
    """(n_attempted, n_accepted, rejection_pct) of draws under a predicate that the ranks did not serve."""
    hit = F.sum(F.when(residual, 1).otherwise(0)).cast("long")
    return sample.agg(F.count(F.lit(1)).alias("n_attempted"), F.coalesce(hit, F.lit(0).cast("long")).alias("n_accepted")).withColumn("rejection_pct", F.round((F.col("n_attempted") - F.col("n_accepted")) * 100.0 / F.greatest("n_attempted", F.lit(1)), 4))


def rejection_report(sample: DataFrame, residual: Column, n: int) -> dict:
    """The figures of rejections(), as they are shown beside a sample's result, with the warning where they call for it."""
    r = rejections(sample, residual).first().asDict()
    return r | {"warned": warn_if_rejecting(r["n_accepted"], r["n_attempted"], n)}


def _percent(pct: float | None) -> float:
    if pct is None or not 0 <= pct <= 100:  # NaN fails the comparison too
        raise SampleError("sample percentage must be between 0 and 100")
    return pct / 100


def bernoulli_sample(df: DataFrame, pct: float, identity: Sequence[str], seed: int = 0) -> DataFrame:
    """Each row by itself with probability pct / 100, decided by a digest of its identity: repeatable, order-free."""
    p = _percent(pct)
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity])), 1, 8), 16, 10).cast("long")
    return df.where(u < F.lit(int(p * 4294967296))).withColumns({P: F.lit(p), N: F.lit(1.0)})


def system_sample(df: DataFrame, pct: float, block: Column, seed: int = 0) -> DataFrame:
    """Whole blocks with probability pct / 100 each."""
    p = _percent(pct)
    u = F.conv(F.substring(F.md5(F.concat(block.cast("string"), F.lit("|"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")
    return df.where(u < F.lit(int(p * 4294967296))).withColumns({P: F.lit(p), N: F.lit(1.0)})


def rows_sample(df: DataFrame, n: int, identity: Sequence[str], seed: int = 0) -> DataFrame:
    """Exactly n rows without replacement (all, if fewer): the n least digests, kept by a bounded top-k in each task."""
    if n is None or n < 0:
        raise SampleError("sample size must not be negative")
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity]))
    return df.withColumn("__h", digest).orderBy("__h", *identity).limit(n).drop("__h")


def time_sample(df: DataFrame, millis: float, identity: Sequence[str], seed: int = 0, first_pct: float = 0.1) -> DataFrame:
    """The largest Bernoulli sample, of first_pct, 4 * first_pct, ... percent, whose count came within the time budget."""
    import time

    if not millis >= 0:
        raise SampleError("sample collection time must not be negative")
    began, pct = time.monotonic(), first_pct
    while pct < 100:
        bernoulli_sample(df, pct, identity, seed).count()
        if (time.monotonic() - began) * 1000 > millis:
            break
        pct = min(100.0, 4 * pct)
    return bernoulli_sample(df, pct, identity, seed)


def stratified_sample(df: DataFrame, by: Sequence[str], n: int, identity: Sequence[str], seed: int = 0) -> DataFrame:
    """n rows of each group (all, if fewer): a reservoir for each group, of the least digests."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity]))
    order = Window.partitionBy(*by).orderBy("__h", *identity)
    return df.withColumn("__h", digest).withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= n).drop("__h", "__k")


def explain_sampling(method: str, parameters: Sequence[object], seed: object | None = None, as_json: bool = False) -> str | dict:
    """How a plan shows a sampled scan."""
    if as_json:
        out = {"Sampling Method": method, "Sampling Parameters": [str(p) for p in parameters]}
        return out | ({"Repeatable Seed": str(seed)} if seed is not None else {})
    return f"Sampling: {method} ({', '.join(map(str, parameters))})" + (f" REPEATABLE ({seed})" if seed is not None else "")
