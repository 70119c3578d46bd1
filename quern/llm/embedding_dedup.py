"""Embedding near-dedup by an epsilon grid order join.

Unit vectors have cosine >= c just if their distance is at most e = sqrt(2 - 2 c). Vectors are rotated onto principal
axes (of all rows), and ordered by the grid cells of width e on the leading ones, cell by cell of the first axis, then of
the second, and so on. This epsilon grid order is cut into leaves, and runs of leaves into intervals; a cell that holds a
third of all rows is cut like any other. A leaf has a box: the range of each leading coordinate, and of the length of the
rest, which makes one coordinate more. Intervals are joined unless their boxes are more than e apart, and of two such
intervals just the leaves meet that are within e of one of the other's. The join of two intervals halves the longer one
again and again, skips what is provably distant, and at the end compares leading coordinates first (their distance never
exceeds the full one), then the full vectors in double precision.

A task holds two intervals. It returns, for each vector with links, their number and the least id connected within the
task: no pair is written anywhere, however many vectors are alike. A row is copied once for each interval that its own
one is near. Where vectors spread evenly over many axes, as random ones do, no box is distant from any other, and
all intervals meet: that is a limit of boxes, not of these. Intervals are then as large as a task can hold, so that copies
are few.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.sources import scratch

from . import vectors
from .columns import own
from .components import connected_components

#: Most and fewest rows of an interval, rows of a leaf, leading axes with boxes and compared first, leading axes with cells.
INTERVAL, SMALLEST, LEAF, LEADING, GRID = 32_768, 2048, 256, 16, 4
#: Rows on each side that are compared at once.
JOINED = 512
#: More than rounding can move a distance of unit vectors; boxes are kept in single precision.
SLACK, BOX_SLACK = 1e-9, 1e-5

log = logging.getLogger(__name__)


def embedding_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, interval: int | None = None, leaf: int = LEAF) -> DataFrame:
    """Links between vectors with cosine >= `cosine`, and the groups they form.

    Returns (id_col, n_links long, component_id long, kept boolean), one row for each vector: how many other vectors it
    links with, the smallest id reachable by links, itself included, and whether that is its own.

    Vectors that are null, zero, or that hold null or non-finite components link with nothing; others link with vectors
    of as many components (there is a pass for each number of components that occurs). Repeated rows (same id, same
    vector) are one vector. Two different vectors under one id share a row, with the links of both. Rows with a null id
    stay as they are, with no links, component_id null and kept false. Columns besides the two are not read. An empty
    table gives an empty table.

    interval: rows of an interval; by default as many as give each core two pairs of intervals, within bounds.
    """
    if not -1 < cosine < 1:
        raise ValueError("cosine must lie between -1 and 1")
    base = df.select(own(id_col).cast("long").alias("id"), own(vector_col).alias("vector"))
    found = df.sparkSession.createDataFrame([], "id long, n long, root long")
    for dim in vectors.dimensions(df, vector_col):
        links = _links(base.where((F.size("vector") == dim) & F.col("id").isNotNull()), dim, cosine, interval, leaf)
        found = found if links is None else found.union(links)
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    linked = connected_components(found.where("id <> root"), "id", "root").withColumnsRenamed({"node": "id"})
    ids = base.where("id is not null").select("id").distinct().union(base.where("id is null").select("id"))
    out = ids.join(counts, "id", "left").join(linked, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


def _links(base: DataFrame, dim: int, cosine: float, interval: int | None, leaf: int) -> DataFrame | None:
    """(id, n, root): links of each vector found by a task, and the least id connected with it there."""
    spark, limit, kind = base.sparkSession, math.sqrt(2 - 2 * cosine), vectors.stored(base, "vector")
    rows = scratch.save(base.dropDuplicates(["id", "vector"]).mapInArrow(lambda b: _usable(b, dim, kind), "id long, vector binary"), "vectors")
    total = rows.count()
    if total < 2:
        scratch.drop(rows)
        return None
    if interval is None:
        interval = min(INTERVAL, max(SMALLEST, math.ceil(total / math.ceil(2 * math.sqrt(spark.sparkContext.defaultParallelism)))))
    leaf, axes = min(leaf, interval), _axes(rows, dim, kind)
    grid, leading = min(GRID, dim), min(LEADING, dim)
    columns = [*(f"c{i}" for i in range(grid)), *(f"p{i}" for i in range(leading)), "id"]
    boxes = ", ".join(f"p{i} float" for i in range(leading + 1))
    placed = rows.mapInArrow(lambda b: _place(b, dim, kind, axes[:, :leading], limit, grid), ", ".join(["id long", "vector binary", *(f"c{i} long" for i in range(grid)), boxes]))
    ordered = placed.repartitionByRange(max(1, math.ceil(total / interval)), *columns).sortWithinPartitions(*columns)
    ordered = scratch.save(ordered.mapInArrow(lambda b: _number(b, leading), f"piece int, place long, id long, vector binary, c0 long, {boxes}"), "ordered")
    sizes, before = sorted(tuple(r) for r in ordered.groupBy("piece").count().collect()), 0  # one row for each of the partitions
    starts = []
    for piece, size in sizes:
        starts.append((piece, before))
        before += size
    place = F.col("start") + F.col("place")
    numbered = ordered.join(F.broadcast(spark.createDataFrame(starts, "piece int, start long")), "piece").select("*", place.alias("rank"), F.floor(place / leaf).alias("leaf"))
    part = F.floor(F.col("leaf") / max(1, interval // leaf)).alias("part")
    bounds = [f(f"{n}{i}" if again else f"p{i}").alias(f"{n}{i}") for again in (False, True) for i in range(leading + 1) for n, f in (("lo", F.min), ("hi", F.max))]
    leaves = numbered.groupBy("leaf").agg(F.min("c0").alias("first"), F.max("c0").alias("last"), *bounds[: len(bounds) // 2])
    leaves = scratch.save(leaves.select("*", part), "leaves")
    about = leaves.groupBy("part").agg(F.min("first").alias("first"), F.max("last").alias("last"), *bounds[len(bounds) // 2 :])
    pairs = scratch.save(_near(about, leading + 1, limit), "pairs")
    sides = scratch.save(_near_leaves(pairs, leaves, leading + 1, limit), "sides")
    met = sides.join(numbered.select("leaf", "rank", "id", "vector", part), "leaf").groupBy("a", "b")
    found = scratch.save(met.applyInArrow(lambda t: _join(t, dim, kind, axes[:, :leading], limit, cosine), "id long, n long, root long"), "links")
    if log.isEnabledFor(logging.INFO):
        n = about.count()
        copies = sides.join(numbered.groupBy("leaf").count(), "leaf").agg(F.sum("count")).first()[0] or 0
        log.info("vectors %d, intervals %d, pairs of them kept %d of %d, rows sent to pairs %d", total, n, pairs.count(), n * (n + 1) // 2, copies)
    scratch.drop(rows, ordered, leaves, pairs, sides)
    return found


def _usable(batches: Iterator[pa.RecordBatch], dim: int, kind: type) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, good = vectors.matrix(b["vector"], dim)
        yield pa.RecordBatch.from_arrays([b["id"].filter(pa.array(good)), vectors.binaries(x[good], kind)], names=["id", "vector"])


def _axes(rows: DataFrame, dim: int, kind: type) -> np.ndarray:
    """Principal axes of all unit vectors, as columns, by falling variance. The moments are summed on the executors."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim + 1))
        for b in batches:
            x = np.concatenate([vectors.units(vectors.rows_of(b["vector"], dim, kind)), np.ones((b.num_rows, 1))], 1)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(dim + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    sums = rows.mapInArrow(moments, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    total = np.zeros((dim + 1, dim + 1))
    for r in sums.collect():  # (dim + 1) ** 2 rows, whatever the number of vectors
        total[r["i"], r["j"]] = r["x"]
    n = max(total[dim, dim], 1)
    mean = total[:dim, dim] / n
    _, axes = np.linalg.eigh(total[:dim, :dim] / n - np.outer(mean, mean))
    return np.ascontiguousarray(axes[:, ::-1])


def _lead(unit: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Leading coordinates, and the length of the rest as one more: distances between these never exceed the full ones."""
    lead = unit @ axes
    return np.concatenate([lead, np.sqrt(np.maximum(0, 1 - (lead**2).sum(1, keepdims=True)))], 1)


def _place(batches: Iterator[pa.RecordBatch], dim: int, kind: type, axes: np.ndarray, limit: float, grid: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        p = _lead(vectors.units(vectors.rows_of(b["vector"], dim, kind)), axes)
        cell = np.floor(p[:, :grid] / limit).astype(np.int64)
        names = ["id", "vector", *(f"c{i}" for i in range(grid)), *(f"p{i}" for i in range(p.shape[1]))]
        yield pa.RecordBatch.from_arrays([b["id"], b["vector"], *(pa.array(cell[:, i]) for i in range(grid)), *(pa.array(p[:, i], pa.float32()) for i in range(p.shape[1]))], names=names)


def _number(batches: Iterator[pa.RecordBatch], leading: int) -> Iterator[pa.RecordBatch]:
    """Numbers the rows of a sorted partition."""
    from pyspark import TaskContext

    piece, seen = TaskContext.get().partitionId(), 0
    names = ["id", "vector", "c0", *(f"p{i}" for i in range(leading + 1))]
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([piece] * b.num_rows, pa.int32()), pa.array(seen + np.arange(b.num_rows)), *(b[n] for n in names)], names=["piece", "place", *names])
        seen += b.num_rows


def _apart(x: str, y: str, axes: int) -> Column:
    """Squared distance of two boxes."""
    gap = [F.greatest(F.lit(0.0), F.col(f"{x}.lo{i}") - F.col(f"{y}.hi{i}"), F.col(f"{y}.lo{i}") - F.col(f"{x}.hi{i}")).cast("double") for i in range(axes)]
    return sum((g * g for g in gap), F.lit(0.0))


def _near(about: DataFrame, axes: int, limit: float) -> DataFrame:
    """Pairs a <= b of intervals whose boxes are within `limit`: an equi-join on cells of the first axis, one cell wider."""
    cell = about.withColumn("cell", F.explode(F.sequence("first", "last")))
    wide = about.withColumn("cell", F.explode(F.sequence(F.col("first") - 1, F.col("last") + 1)))
    met = cell.alias("x").join(wide.alias("y"), F.col("x.cell") == F.col("y.cell")).where(_apart("x", "y", axes) <= (limit + BOX_SLACK) ** 2)
    return met.select(F.least("x.part", "y.part").alias("a"), F.greatest("x.part", "y.part").alias("b")).distinct()


def _near_leaves(pairs: DataFrame, leaves: DataFrame, axes: int, limit: float) -> DataFrame:
    """(a, b, leaf): the leaves of each pair of intervals that are within `limit` of one of the other interval's."""
    met = pairs.join(leaves.withColumnRenamed("part", "a").alias("x"), "a").join(leaves.withColumnRenamed("part", "b").alias("y"), "b").where(_apart("x", "y", axes) <= (limit + BOX_SLACK) ** 2)
    return met.select("a", "b", F.explode(F.array("x.leaf", "y.leaf")).alias("leaf")).distinct().select("a", "b", "leaf")


class _Sequence:
    """The rows of an interval, with the boxes of its leaves."""

    def __init__(self, first: int, unit: np.ndarray, axes: np.ndarray):
        self.first, self.unit, self.lead = first, unit, _lead(unit, axes)
        self.square = (self.lead**2).sum(1)

    def box(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        return self.lead[a:b].min(0), self.lead[a:b].max(0)


def _join(table: pa.Table, dim: int, kind: type, axes: np.ndarray, limit: float, cosine: float) -> pa.Table:
    """Joins two intervals, or one with itself: what of them was sent here. The first ranks of b follow the last of a."""
    table = table.sort_by("rank")
    same, ids = table["a"][0].as_py() == table["b"][0].as_py(), table["id"].to_numpy()
    unit, part = vectors.units(vectors.rows_of(table["vector"], dim, kind)), table["part"].to_numpy()
    n, label = np.zeros(len(ids), np.int64), np.unique(ids, return_inverse=True)[1]
    cut = len(ids) if same else int(np.searchsorted(part, part[-1]))
    one = _Sequence(0, unit[:cut], axes)
    two = one if same else _Sequence(cut, unit[cut:], axes)
    reach = (limit + SLACK) ** 2
    todo = [(0, len(one.unit), 0, len(two.unit))]
    while todo:
        i, j, k, m = todo.pop()
        if i >= j or k >= m or (one is two and i > k):
            continue  # of two halves of one interval, only the pair in order counts
        (lo, hi), (low, high) = one.box(i, j), two.box(k, m)
        if (np.maximum(0, np.maximum(lo - high, low - hi)) ** 2).sum() > reach:
            continue
        if max(j - i, m - k) > JOINED:
            if one is two and (i, j) == (k, m):
                h = (i + j) // 2
                todo += [(i, h, i, h), (i, h, h, j), (h, j, h, j)]
            elif j - i >= m - k:
                todo += [(i, (i + j) // 2, k, m), ((i + j) // 2, j, k, m)]
            else:
                todo += [(i, j, k, (k + m) // 2), (i, j, (k + m) // 2, m)]
            continue
        x, y = np.arange(i, j) + one.first, np.arange(k, m) + two.first
        near = one.square[i:j, None] + two.square[None, k:m] - 2 * (one.lead[i:j] @ two.lead[k:m].T) <= reach
        if one is two and i == k:
            near &= np.tri(j - i, m - k, -1, dtype=bool).T
        if not near.any():
            continue
        if near.mean() > 0.02:
            linked = near & (one.unit[i:j] @ two.unit[k:m].T >= cosine)
        else:
            r, c = np.nonzero(near)
            linked = np.zeros_like(near)
            linked[r, c] = np.einsum("ij,ij->i", one.unit[i:j][r], two.unit[k:m][c]) >= cosine
        linked &= ids[x][:, None] != ids[y][None, :]
        n[x] += linked.sum(1)
        n[y] += linked.sum(0)
        for r in np.flatnonzero(linked.any(1)):
            labels = label[np.append(y[linked[r]], x[r])]
            if (labels != labels[0]).any():
                found = np.unique(labels)
                label[np.isin(label, found)] = found[0]
    some = n > 0
    return pa.table({"id": ids[some], "n": n[some], "root": np.unique(ids)[label[some]]})
