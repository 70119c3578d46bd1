"""Reading and writing tables: Parquet, delimited text, JDBC, views and stored query results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources import scratch

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: Columns of the delimited load files, in file order; NULL is \N there.
TBL_SCHEMAS = {
    "customer": "c_id short, c_d_id short, c_w_id short, c_name string, c_address string, c_nationkey short, c_phone string, c_balance double, c_mktsegment string, c_credit string, c_credit_lim double, c_discount double, c_ytd_payment double, c_payment_cnt double, c_delivery_cnt long, c_data string, c_comment string",
    "orders": "o_id int, o_d_id short, o_w_id short, o_c_id short, o_carrier_id short, o_entry_d date, o_ol_cnt int, o_all_local long, o_orderpriority string, o_shippriority string",
    "orderline": "ol_o_id int, ol_d_id short, ol_w_id short, ol_number short, ol_i_id int, ol_supply_w_id short, ol_delivery_d date, ol_quantity long, ol_amount double, ol_dist_info string",
    "neworder": "no_o_id int, no_d_id short, no_w_id short",
    "item": "i_id int, i_name string, i_mfgr string, i_brand string, i_type string, i_size long, i_container string, i_price double, i_data string",
    "warehouse": "w_id short, w_name string, w_address string, w_tax double, w_ytd double",
    "stock": "st_i_id int, st_w_id short, st_quantity long, st_ytd double, st_order_cnt long, st_remote_cnt long, st_data string",
    "history": "h_c_id long, h_c_d_id short, h_c_w_id short, h_d_id short, h_w_id short, h_date date, h_amount double, h_data string",
    "district": "d_id short, d_w_id short, d_name string, d_address string, d_nationkey short, d_tax double, d_ytd double, d_next_o_id int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = NAMES) -> None:
    """Temporary views of the tables; a query resolves them when it is built, so a later call doesn't change it."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def query(spark: SparkSession, sf_dir: str, sql: str, names: tuple[str, ...] = NAMES, **args: object) -> DataFrame:
    register(spark, sf_dir, tuple(n for n in names if n in sql))
    return spark.sql(sql, args=args) if args else spark.sql(sql)


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = "|", null: str = "\\N", header: bool = False, where: str | None = None, quote: str = '"', escape: str = '"', rejects: str | None = None) -> DataFrame:
    """A delimited file of a declared schema. Rows that don't fit it raise; with `rejects`, a column of that name, they stay,
    with what fits and the line itself in it. `where` is applied while reading."""
    read = spark.read.option("columnNameOfCorruptRecord", rejects or "__rejected")
    full = f"{schema}, `{rejects}` string" if rejects else schema
    df = read.csv(path, schema=full, sep=sep, nullValue=null, header=header, mode="PERMISSIVE" if rejects else "FAILFAST", ignoreTrailingWhiteSpace=False, quote=quote, escape=escape)
    return df.where(where) if where else df


def write_delimited(df: DataFrame, path: str, sep: str = "|", null: str = "\\N", header: bool = False, mode: str = "errorifexists", quote: str = '"', escape: str = '"', quote_all: bool = False) -> None:
    """Any query's result as delimited files; a quote inside a value is doubled unless another escape is given."""
    df.write.mode(mode).csv(path, sep=sep, nullValue=null, header=header, quote=quote, escape=escape, quoteAll=quote_all)


def read_jdbc(spark: SparkSession, url: str, source: str, properties: dict[str, str], partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 1) -> DataFrame:
    """A remote table or query; filters and columns are pushed to it. With a partition column it is read in parallel."""
    if partition_column and bounds:
        return spark.read.jdbc(url, source, column=partition_column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions, properties=properties)
    return spark.read.jdbc(url, source, properties=properties)


def store(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), sort_by: tuple[str, ...] = (), bloom: tuple[str, ...] = (), mode: str = "errorifexists") -> DataFrame:
    """Parquet laid out for skipping: partition folders, rows sorted in each file, Bloom filters for point lookups."""
    laid = df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by) if sort_by and not partition_by else df.sortWithinPartitions(*partition_by, *sort_by) if sort_by else df
    writer = laid.write.mode(mode)
    for column in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)


def bucketed(df: DataFrame, name: str, columns: tuple[str, ...], buckets: int) -> DataFrame:
    """A stored table dealt by a hash of columns: joins and groupings on them need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *columns).sortBy(*columns).saveAsTable(name)
    return df.sparkSession.table(name)


class MaterializedView:
    """A query whose result is stored; refresh() writes it anew beside the old one and then switches over."""

    def __init__(self, spark: SparkSession, path: str, sql: str):
        self.spark, self.path, self.sql = spark, path.rstrip("/"), sql

    @property
    def version(self) -> int:
        """The last version that was written whole, as the folder has it; 0 if none was."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        files = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = files.globStatus(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v*/_SUCCESS"))
        return max((int(str(s.getPath().getParent().getName())[1:]) for s in found), default=0)

    def refresh(self, with_data: bool = True) -> DataFrame:
        df = self.spark.sql(self.sql)
        (df if with_data else df.limit(0)).write.mode("overwrite").parquet(f"{self.path}/v{self.version + 1}")
        return self.read()

    def read(self) -> DataFrame:
        version = self.version
        if not version:
            raise ValueError("the materialized view has not been populated")
        return self.spark.read.parquet(f"{self.path}/v{version}")


def cursor(df: DataFrame, fetch: int = 1000):
    """Rows of a result in lists of `fetch`, one partition at a time on the driver."""
    chunk = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        chunk.append(row)
        if len(chunk) == fetch:
            yield chunk
            chunk = []
    if chunk:
        yield chunk


class ScrollCursor:
    """A cursor that goes both ways over a stored result. It stands on a row, from 1, or before the first or after the last;
    each fetch reads the files that hold its rows."""

    def __init__(self, df: DataFrame, *order: Column | str):
        rows = df.orderBy(*order).withColumns({"__p": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
        self.rows, self.columns, self.at = scratch.save(rows, "cursor"), df.columns, 0
        counts = sorted(tuple(r) for r in self.rows.groupBy("__p").count().collect())  # one row for each partition
        self.parts, self.total = [], 0
        for p, n in counts:
            self.parts.append((p, self.total, n))
            self.total += n

    def move(self, n: int) -> int:
        """Moves by n rows, backwards if negative; how many rows were passed."""
        low, high = (self.at + 1, self.at + n) if n > 0 else (self.at + n, self.at - 1)
        self.at = min(max(self.at + n, 0), self.total + 1)
        return max(0, min(high, self.total) - max(low, 1) + 1)

    def absolute(self, n: int) -> list:
        """The row at n, counted from the end if negative, as a list of one or none."""
        self.at = min(max(n if n >= 0 else self.total + 1 + n, 0), self.total + 1)
        return self._rows(self.at, self.at)

    def fetch(self, n: int = 1) -> list:
        """The next n rows, or those before, nearest first, if n is negative; the row again if it is 0."""
        before = self.at
        self.at = min(max(self.at + n, 0), self.total + 1)
        if n == 0:
            return self._rows(before, before)
        return self._rows(before + 1, before + n) if n > 0 else self._rows(before + n, before - 1)[::-1]

    def _rows(self, low: int, high: int) -> list:
        low, high = max(low, 1), min(high, self.total)
        met = [(p, max(low - 1 - start, 0), min(high - 1 - start, n - 1)) for p, start, n in self.parts if start < high and start + n >= low]
        if low > high or not met:
            return []
        where = F.lit(False)
        for p, a, b in met:
            where = where | (F.col("__p") == p) & F.col("__at").between(a, b)
        return self.rows.where(where).orderBy("__p", "__at").select(self.columns).collect()

    def close(self) -> None:
        scratch.drop(self.rows)


def series(spark: SparkSession, start: int, stop: int, step: int = 1) -> DataFrame:
    """start, start + step, ... up to and including stop; empty if the step leads away from it."""
    if step == 0:
        raise ValueError("step size cannot equal zero")
    return spark.range(start, stop + (1 if step > 0 else -1), step).select(F.col("id").alias("value"))
