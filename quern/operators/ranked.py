"""Rows stored in the order of their ranks, for draws that read only what they hit.

A table is written once, sorted by (bucket of the key, digest of the row), a folder for each partition, with the place of
each row in its file. Beside it lie two small indexes: rows of each bucket, and of each partition. A draw is a rank; the
indexes turn it into a folder and a place, and the scan gets both as literals: folders are pruned, row groups and pages
are skipped by the statistics of the place. The cost of a sample follows the number of draws, not the size of the range.
"""

from __future__ import annotations

import hashlib
import json
import warnings
from bisect import bisect_right
from collections import Counter
from datetime import date, datetime
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sampling import N, P, Layout, SampleError, row_digest

#: Rows of a page of the stored files, as far as places go: a drawn row costs about one page of each column read.
PAGE_ROWS = 4000
#: Places that go into the scan's own filter; beyond, folders alone are pruned, and the join finds the rows.
FILTERED = 20_000
#: Buckets up to which their index is on the driver; beyond, a job sums it for each sample.
BUCKETS = 65_536


def _day(x: object) -> date:
    return x.date() if isinstance(x, datetime) else x if isinstance(x, date) else date.fromisoformat(str(x)[:10])


#: How a bound becomes a value of the bucket's type, on the driver.
VALUES = {T.DateType: _day, T.IntegerType: int, T.LongType: int, T.ShortType: int, T.StringType: str}


class RankedTable:
    """A stored table. Appending is writing another one: their samples add up as strata."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.columns = json.loads(spark.read.text(f"{self.path}/columns").first()[0])
        # One row for each folder, as many as the table has files.
        parts = sorted(tuple(r) for r in spark.read.parquet(f"{self.path}/parts").collect())
        self.parts, self.ends = [p for p, _ in parts], list(accumulate(n for _, n in parts))
        self.buckets = spark.read.parquet(f"{self.path}/buckets")
        self.kind = self.buckets.schema["__b"].dataType
        first = self.buckets.orderBy(F.col("__b").asc_nulls_first()).limit(BUCKETS + 1).collect() if type(self.kind) in VALUES else []
        self.known = [tuple(r) for r in first] if 0 < len(first) <= BUCKETS else None
        self.session = self._reader()
        self.rows = self.session.read.parquet(f"{self.path}/rows")

    @classmethod
    def write(cls, df: DataFrame, path: str, layout: Layout, partitions: int | None = None) -> RankedTable:
        """Stores df. An equal key is split by the digests of its rows, so a hot one fills many files."""
        spark, path = df.sparkSession, path.rstrip("/")
        rows = df.withColumns({"__b": layout.bucket, "__h": row_digest(layout.identity)})
        rows = rows.repartitionByRange(*([partitions] if partitions else []), "__b", "__h").sortWithinPartitions("__b", "__h")
        rows = rows.withColumns({"__p": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})  # __at: (partition << 33) + place
        rows.drop("__h").write.partitionBy("__p").option("parquet.page.row.count.limit", str(PAGE_ROWS)).parquet(f"{path}/rows")
        stored = spark.read.parquet(f"{path}/rows")
        stored.groupBy("__b").agg(F.count(F.lit(1)).alias("c")).coalesce(1).write.parquet(f"{path}/buckets")
        stored.groupBy("__p").agg(F.count(F.lit(1)).alias("c")).coalesce(1).write.parquet(f"{path}/parts")
        spark.createDataFrame([(json.dumps(df.columns),)], "value string").coalesce(1).write.text(f"{path}/columns")
        return cls(spark, path)

    def sample(self, n: int | None, seed: int | None = 0, lower: object | None = None, upper: object | None = None) -> DataFrame:
        """n draws with replacement from the rows with lower <= bucket < upper (None: open), the same ones that
        swr_sample() of these rows makes. Warns if there is none. The n draws are on the driver and broadcast."""
        if n is None or n < 0:
            raise SampleError("sample size must not be null or negative")
        if seed is None:
            raise SampleError("TABLESAMPLE REPEATABLE parameter cannot be null")
        first, total = self._range(lower, upper)
        if not total and n:
            warnings.warn("the range of the sample is empty", stacklevel=2)
        ranks = [first + int(hashlib.md5(f"{i}|{seed}".encode()).hexdigest()[:8], 16) * total // (1 << 32) for i in range(n if total else 0)]
        places = [(self.parts[k] << 33) + r - (self.ends[k - 1] if k else 0) for r in ranks for k in (bisect_right(self.ends, r),)]
        rows, columns = self.rows.where(f"__p IN ({_list({a >> 33 for a in places})})"), (F.lit(1.0 / max(total, 1)).alias(P), F.lit(float(n)).alias(N))
        if len(places) > FILTERED:
            draws = self.session.createDataFrame([(a,) for a in places], "__at long")
            return rows.join(F.broadcast(draws), "__at").select(*self.columns, *columns)  # n rows
        # A row that is drawn several times comes as often: few are, and they are named.
        often: dict[int, list[int]] = {}
        for a, k in Counter(places).items():
            often.setdefault(k, []).append(a)
        found, repeated = rows.where(f"__at IN ({_list(places)})"), {k: v for k, v in often.items() if k > 1}
        if repeated:
            times = "CASE " + " ".join(f"WHEN __at IN ({_list(v)}) THEN {k}" for k, v in repeated.items()) + " ELSE 1 END"
            found = found.withColumn("__time", F.explode(F.expr(f"sequence(1, {times})")))
        return found.select(*self.columns, *columns)

    def _range(self, lower: object | None, upper: object | None) -> tuple[int, int]:
        """The rows before a range of buckets, and those in it; a null bucket comes first."""
        if self.known is not None:
            convert = VALUES[type(self.kind)]
            low, high = (None if x is None else convert(x) for x in (lower, upper))
            before = sum(c for b, c in self.known if low is not None and (b is None or b < low))
            return before, sum(c for b, c in self.known if (low is None or b is not None and b >= low) and (high is None or b is None or b < high))
        below = F.lit(False) if lower is None else F.coalesce(F.col("__b") < F.lit(lower).cast(self.kind), F.lit(True))
        above = F.lit(False) if upper is None else F.coalesce(F.col("__b") >= F.lit(upper).cast(self.kind), F.lit(False))
        first, total = self.buckets.agg(F.sum(F.when(below, F.col("c")).otherwise(0)), F.sum(F.when(~below & ~above, F.col("c")).otherwise(0))).first()
        return first or 0, total or 0

    def _reader(self) -> SparkSession:
        """A session whose scans take long lists as page filters, and whose plans don't copy these lists."""
        session = self.spark.newSession()
        for key, value in (("spark.sql.parquet.pushdown.inFilterThreshold", str(FILTERED)), ("spark.sql.constraintPropagation.enabled", "false")):
            session.conf.set(key, value)
        for key in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.session.timeZone"):
            session.conf.set(key, self.spark.conf.get(key))
        return session


def _list(numbers) -> str:
    return ", ".join(f"{x}L" for x in sorted(set(numbers))) or "NULL"
