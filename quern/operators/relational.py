"""Relational operators that Spark has no single call for, and forms of its own that hold on skewed keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def fetch_with_ties(df: DataFrame, n: int, order: Sequence[Column], offset: int = 0) -> DataFrame:
    """FETCH FIRST n ROWS WITH TIES. A rank limit is pushed below the exchange: each task sends its first n and ties."""
    if n < 0 or offset < 0:
        raise ValueError("LIMIT and OFFSET must not be negative")
    if offset:  # the first offset + n and ties are few; only these are numbered
        df = fetch_with_ties(df, offset + n, order)
        return df.withColumn("__k", F.row_number().over(Window.orderBy(*order))).where(F.col("__k") > offset).drop("__k")
    return df.withColumn("__r", F.rank().over(Window.orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def limit(df: DataFrame, n: int | None, offset: int | None = None) -> DataFrame:
    """LIMIT and OFFSET; null means all, or none skipped."""
    if (n is not None and n < 0) or (offset is not None and offset < 0):
        raise ValueError("LIMIT and OFFSET must not be negative")
    df = df.offset(offset) if offset else df
    return df if n is None else df.limit(n)


def crosstab(df: DataFrame, rows: Sequence[str], category: str, value: Column, categories: Sequence[str]) -> DataFrame:
    """Categories as columns; they are named, so that no pass is needed to find them."""
    return df.groupBy(*rows).pivot(category, list(categories)).agg(value)


def upsert(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `new`, and those of `base` that none of them replaces."""
    return base.join(new.select(*keys), list(keys), "left_anti").select(base.columns).unionByName(new.select(base.columns))


def update(df: DataFrame, where: Column, values: Mapping[str, Column]) -> DataFrame:
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def delete(df: DataFrame, where: Column) -> DataFrame:
    """Rows for which the condition is not true: unknown stays."""
    return df.where(~F.coalesce(where, F.lit(False)))


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str]) -> DataFrame:
    """Each left row with the latest right row of its key at or before its time: one union, one sort, no pairs."""
    l = left.select(*left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in columns], F.lit(1).alias("__side"))  # noqa: E741
    extra = [c for c in left.columns if c not in (*keys, time)]
    r = right.select(*keys, time, *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in extra], *columns, F.lit(0).alias("__side"))
    upto = Window.partitionBy(*keys).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("__side") == 0, F.struct(*columns)), ignorenulls=True).over(upto)
    both = l.select(*keys, time, *extra, *columns, "__side").unionByName(r).withColumn("__seen", seen)
    return both.where("__side = 1").select(*left.columns, *[F.col("__seen")[c].alias(c) for c in columns])


def salted_count_distinct(df: DataFrame, keys: Sequence[str], value: str, name: str, salts: int) -> DataFrame:
    """count(DISTINCT value): equal values share a salt, so the salted counts add up, and no key is one task."""
    salt = F.pmod(F.xxhash64(value), F.lit(salts))
    per_salt = df.where(F.col(value).isNotNull()).groupBy(*keys, salt.alias("__s")).agg(F.count_distinct(value).alias("__n"))
    groups = df.select(*keys).distinct()
    return groups.join(per_salt.groupBy(*keys).agg(F.sum("__n").alias(name)), list(keys), "left").fillna(0, [name])


def salted_join(large: DataFrame, small: DataFrame, keys: Sequence[str], salts: int) -> DataFrame:
    """An equi-join whose hot keys are split: the larger side is dealt over salts, the other side is copied to each."""
    dealt = large.withColumn("__s", F.pmod(F.xxhash64(*large.columns, F.monotonically_increasing_id()), F.lit(salts)))
    copied = small.withColumn("__s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return dealt.join(copied, [*keys, "__s"]).drop("__s")


def connect_by(df: DataFrame, id_col: str, parent_col: str, start: object, max_depth: int, separator: str = "~") -> DataFrame:
    """(id, parent, level, branch) from `start` down, a join for each level; a row met again on its own branch raises."""
    kids = df.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent"))
    level = kids.where(F.col("id") == F.lit(start)).select("id", F.lit(None).cast(kids.schema["parent"].dataType).alias("parent"), F.lit(0).alias("level"), F.col("id").cast("string").alias("branch"))
    out = level
    for depth in range(1, max_depth + 1):
        up = level.select(F.col("id").alias("parent"), F.col("branch").alias("__b"))
        found = kids.join(up, "parent")
        seen = F.array_contains(F.split("__b", separator, -1), F.col("id").cast("string"))
        branch = F.when(seen, F.raise_error(F.lit("infinite recursion detected"))).otherwise(F.concat("__b", F.lit(separator), F.col("id").cast("string")))
        level = found.select("id", "parent", F.lit(depth).alias("level"), branch.alias("branch"))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def merge(base: DataFrame, source: DataFrame, keys: Sequence[str], update: Mapping[str, Column] | None = None, delete: Column | None = None, insert: bool = True) -> DataFrame:
    """MERGE: rows of base that source matches by keys are deleted where `delete` holds, else updated; others stay; rows
    of source that match none are inserted. In `update` and `delete`, columns of base are t.x, of source s.x; columns of
    base that are not updated stay. Returns base's columns and __action: DELETE, UPDATE, INSERT, or null for rows that
    stay; rows deleted are in it, so that it can serve RETURNING. A base row that several source rows match raises.
    """
    t, s = base.withColumn("__t", F.lit(True)).alias("t"), source.withColumn("__s", F.lit(True)).alias("s")
    once = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    s = s.join(once.alias("o"), [F.col(f"s.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]).select("s.*", "__n").alias("s") if keys else s
    both = t.join(s, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys], "full")
    hit, new = F.col("__t").isNotNull() & F.col("__s").isNotNull(), F.col("__t").isNull()
    gone = F.coalesce(delete, F.lit(False)) if delete is not None else F.lit(False)
    action = F.when(hit & (F.col("__n") > 1), F.raise_error(F.lit("a row is matched more than once"))).when(hit & gone, "DELETE").when(hit & F.lit(bool(update)), "UPDATE").when(new, "INSERT")
    value = lambda c: F.when(new, F.col(f"s.{c}") if c in source.columns else F.lit(None)).when(hit & ~gone, (update or {}).get(c, F.col(f"t.{c}"))).otherwise(F.col(f"t.{c}"))
    out = both.select(*[value(c).alias(c) for c in base.columns], action.alias("__action"))
    return out if insert else out.where("__action is null or __action <> 'INSERT'")


def overlap_join(left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str], width: float) -> DataFrame:
    """Pairs of rows whose closed ranges overlap. A range join made an equi-join: ranges meet in the bins of `width` that
    they touch, and each pair is kept in the first bin that both have, so none comes twice. A row is copied once for each
    bin that its range touches; with a width about the length of a range that is twice, whatever the table's size."""
    (a, b), (c, d) = left_range, right_range
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))
    one, two = left.where(F.col(a) <= F.col(b)).withColumn("__bin", bins(a, b)), right.where(F.col(c) <= F.col(d)).withColumn("__bin", bins(c, d))
    first = F.col("__bin") == F.greatest(F.floor(F.col(a) / width), F.floor(F.col(c) / width))
    return one.join(two, "__bin").where((F.col(a) <= F.col(d)) & (F.col(c) <= F.col(b)) & first).drop("__bin")


def combined_aggregate(df: DataFrame, keys: Sequence[str], columns: Sequence[str], state: str, step, combine, final: Column) -> DataFrame:
    """A user's aggregate with a combine step: step(list of numpy columns) gives the state of a run of rows of one key as a
    tuple, combine(a, b) that of two runs; `state` is the DDL of the state's fields, `final` a column over them. States are
    made on the map side, one for each key and batch, so that a hot key moves as a few states."""
    import pandas as pd

    fields = T.StructType.fromDDL(state).names
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def partial(batches):
        for frame in batches:
            rows = [(*(k if isinstance(k, tuple) else (k,)), *step([g[c].to_numpy() for c in columns])) for k, g in frame.groupby(list(keys), dropna=False, sort=False)]
            yield pd.DataFrame(rows, columns=[*keys, *fields])

    def whole(frame):
        out = None
        for row in frame[fields].itertuples(index=False, name=None):
            out = row if out is None else combine(out, row)
        return pd.DataFrame([(*frame.iloc[0][list(keys)], *out)], columns=[*keys, *fields])

    parts = df.select(*keys, *columns).mapInPandas(partial, f"{kinds}, {state}")
    return parts.groupBy(*keys).applyInPandas(whole, f"{kinds}, {state}").select(*keys, final)
