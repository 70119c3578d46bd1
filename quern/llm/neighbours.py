"""Approximate nearest neighbours from low-dimensional stable projections (after Sun et al., "SRS", VLDB 2015).

Vectors are projected onto PROJECTED Gaussian directions. For a vector at distance d, the squared distance of the
projections divided by d squared follows a chi-square law with PROJECTED degrees of freedom. A kd-tree over the
projections yields candidates by growing projected distance, each is verified on the original vectors, and the search
stops as soon as the k-th best distance found passes the test: had there been a nearer vector, its projection would
have come up by now with probability CONFIDENCE.

Distribution. The upper levels of the kd-tree are fitted to a bounded sample and deal all vectors into cells; a cell
with too many rows gets further levels, fitted on the executors to a sample of its own, so that cells stay small as the
table grows; what no coordinate can part, as many equal vectors, is split by a hash. Each cell has the lower levels as a
tree of its own. A query is first answered in its own cell, which gives it a radius; then only in the cells whose box is
within the radius that the chi-square test allows. A query that is near nothing visits more cells, never fewer than the
test asks for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.sources import scratch

from . import vectors
from .columns import own

PROJECTED, CONFIDENCE, LEAF = 8, 0.99, 128
#: Rows of a cell, rows that fit the upper levels, and the most cells those levels make (their boxes are broadcast: 128
#: bytes each).
CELL, SAMPLE, CELLS = 8192, 20_000, 4096
#: Rows of a cell, on average, that fit its own levels, and the most of these levels: cuts of all cells have 16 MB at most.
FIT, DEEPER = 4096, 8

#: More than rounding can move a projection, as a share of its size: vectors as near as the test allows stay candidates.
SLACK = 1e-9

FOUND = "query_id long, vec_id long, score double"


def chi_square_quantile(p: float, k: int) -> float:
    """The p-quantile of the chi-square law with an even number k of degrees of freedom, by bisection on its exact tail."""
    if k % 2:
        raise ValueError("an even number of projections is needed")

    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, k // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, k + 10 * math.sqrt(2 * k) + 10 * abs(NormalDist().inv_cdf(p))
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


class Tree:
    """A balanced kd-tree over the rows of a matrix: split at the median of the widest axis, as far as `leaf` rows."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.points, self.leaves, self.lo, self.hi = points, [], [], []
        todo = [np.arange(len(points))] if len(points) else []
        while todo:
            rows = todo.pop()
            p = points[rows]
            lo, hi = p.min(0), p.max(0)
            axis = int((hi - lo).argmax())
            if len(rows) <= leaf or hi[axis] == lo[axis]:
                self.leaves.append(rows)
                self.lo.append(lo)
                self.hi.append(hi)
                continue
            order = rows[np.argpartition(p[:, axis], len(rows) // 2)]
            todo += [order[: len(rows) // 2], order[len(rows) // 2 :]]
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)

    def gaps(self, at: np.ndarray) -> np.ndarray:
        """Squared distance from a point to the box of each leaf."""
        return (np.maximum(0, np.maximum(self.lo - at, at - self.hi)) ** 2).sum(1)


class Cuts:
    """The upper levels: axis and value of each inner node, fitted to a sample; applied to any rows."""

    def __init__(self, sample: np.ndarray, levels: int):
        self.levels, self.axis, self.value = levels, np.zeros(1 << levels, np.int64), np.zeros(1 << levels)
        todo = [(1, np.arange(len(sample)), 0)]
        while todo:
            node, rows, level = todo.pop()
            if level == levels:
                continue
            if len(rows):
                p = sample[rows]
                self.axis[node] = (p.max(0) - p.min(0)).argmax()
                self.value[node] = np.median(p[:, self.axis[node]])
                right = p[:, self.axis[node]] > self.value[node]
            else:
                right = np.zeros(0, bool)
            todo += [(2 * node, rows[~right], level + 1), (2 * node + 1, rows[right], level + 1)]

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.levels):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] > self.value[node])
        return node - (1 << self.levels)


def nearest_neighbours(df: DataFrame, queries: DataFrame | None = None, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", confidence: float = CONFIDENCE, projected: int = PROJECTED, cell_rows: int = CELL, seed: int = 11) -> DataFrame:
    """The k nearest rows of df to each query by Euclidean distance, the query's own id left out.

    queries: rows of df to search for, by their id_col (all of df by default). Returns (query_id, rank int from 1, vec_id,
    score double), nearest first, ties to the smaller id; fewer rows a query if df has fewer.

    Vectors that are null, zero, or that hold null or non-finite components take no part, nor do rows with a null id;
    others are near vectors of as many components (there is a pass for each number of components that occurs). Repeated
    rows (same id, same vector) count once; ids are unique otherwise. An empty table gives an empty table. Columns
    besides the two are not read.
    """
    base = df.select(own(id_col).cast("long").alias("id"), own(vector_col).alias("vector")).where("id is not null")
    wanted = None if queries is None else queries.select(own(id_col).cast("long").alias("id")).distinct()
    out = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for dim in vectors.dimensions(df, vector_col):
        out = out.union(_search(base.where(F.size("vector") == dim), wanted, dim, k, confidence, projected, cell_rows, seed))
    return out


def _search(base: DataFrame, wanted: DataFrame | None, dim: int, k: int, confidence: float, projected: int, cell_rows: int, seed: int) -> DataFrame:
    """The answers among vectors of `dim` components."""
    directions, kind = np.random.default_rng(seed).standard_normal((dim, projected)), vectors.stored(base, "vector")
    points = base.dropDuplicates(["id", "vector"]).mapInArrow(lambda b: _project(b, dim, kind, directions), "id long, vector binary, point binary")
    points = scratch.save(points, "points")
    total = points.count()
    sample = points.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("point").toArrow()
    cuts = Cuts(vectors.rows_of(sample["point"], projected), min(int(math.log2(CELLS)), max(0, math.ceil(math.log2(max(1, total / cell_rows))))))
    asked = points.withColumn("asks", F.lit(True)) if wanted is None else points.join(wanted.withColumn("asks", F.lit(True)), "id", "left")
    coordinates = ", ".join(f"p{i} double" for i in range(projected))
    placed = asked.mapInArrow(lambda b: _place(b, cuts, projected), f"id long, vector binary, point binary, asks boolean, cell int, {coordinates}")
    placed = scratch.save(placed, "placed")
    scratch.drop(points)
    box = [f(f"p{i}").alias(f"{n}{i}") for i in range(projected) for n, f in (("lo", F.min), ("hi", F.max))]
    top = scratch.save(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *box), "cells")  # CELLS rows at most
    full = {r["cell"]: r["n"] for r in top.where(F.col("n") > cell_rows).select("cell", "n").collect()}
    deeper = _deeper(placed, top, full, projected, cell_rows) if full else {}
    parted = placed.mapInArrow(lambda b: _part(b, deeper, projected), f"id long, vector binary, point binary, asks boolean, cell int, {coordinates}, sub int") if deeper else placed.withColumn("sub", F.lit(0))
    parted = scratch.save(parted, "parted") if deeper else parted
    bounds = scratch.save(parted.groupBy("cell", "sub").agg(F.ceil(F.count(F.lit(1)) / cell_rows).cast("int").alias("splits"), *box), "bounds")
    hot = bounds.where("splits > 1").select("cell", "sub", "splits")
    splits = F.coalesce("splits", F.lit(1))
    dealt = parted.join(hot, ["cell", "sub"], "left").withColumn("split", F.pmod(F.xxhash64("id"), splits).cast("int"))
    at = ["cell", "sub", "split"]
    rows = dealt.select(*at, "id", "vector", "point", F.coalesce("asks", F.lit(False)).alias("asks"), F.lit(float("inf")).alias("radius"), F.lit(True).alias("member"))
    widen = chi_square_quantile(confidence, projected)
    answer = lambda t: _answer(t, dim, kind, projected, k, widen)
    first = scratch.save(rows.groupBy(*at).applyInArrow(answer, FOUND), "first")
    radius = first.groupBy("query_id").agg(F.when(F.count("vec_id") >= k, F.max("score")).otherwise(F.lit(float("inf"))).alias("found"))
    asking = dealt.where("asks").join(radius, F.col("id") == F.col("query_id"), "left").withColumn("radius", F.coalesce("found", F.lit(float("inf"))))
    located = asking.select("id", "vector", "point", "radius", F.struct(*at).alias("home"), *(f"p{i}" for i in range(projected)))
    gap = [F.greatest(F.lit(0.0), F.col(f"lo{i}") - F.col(f"p{i}"), F.col(f"p{i}") - F.col(f"hi{i}")) for i in range(projected)]
    size = sum((F.abs(f"p{i}") for i in range(projected)), F.lit(0.0))
    reached = F.sqrt(sum((g * g for g in gap), F.lit(0.0))) <= F.col("radius") * math.sqrt(widen) + size * SLACK
    # A stated query set against a bounded number of boxes; then only the parts of the cells that its test can't rule out.
    met = located.join(F.broadcast(top.drop("n")), reached).select(*located.columns, "cell")
    visits = met.join(bounds, "cell").where(reached).withColumn("split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1))).where(F.struct(*at) != F.col("home"))
    visits = scratch.save(visits.select(*at, "id", "vector", "point", F.lit(True).alias("asks"), "radius", F.lit(False).alias("member")), "visits")
    hosts = rows.withColumn("asks", F.lit(False)).join(visits.select(*at).distinct(), at, "left_semi").select(rows.columns)
    second = hosts.union(visits).groupBy(*at).applyInArrow(answer, FOUND)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = scratch.save(first.union(second).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")
    scratch.drop(placed, parted, top, bounds, first, visits)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _deeper(placed: DataFrame, top: DataFrame, full: dict[int, int], projected: int, cell_rows: int) -> dict[int, Cuts]:
    """Further levels of each cell with too many rows, fitted to a sample of about FIT rows of it."""
    levels = {cell: min(DEEPER, math.ceil(math.log2(n / cell_rows))) for cell, n in full.items()}

    def fit(key: tuple, t: pa.Table) -> pa.Table:
        cuts = Cuts(vectors.rows_of(t["point"], projected), levels[key[0].as_py()])
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int32()), "axis": pa.array([cuts.axis.tobytes()], pa.binary()), "value": pa.array([cuts.value.tobytes()], pa.binary())})

    every = F.ceil(F.col("n") / FIT)
    some = placed.select("cell", "id", "point").join(F.broadcast(top.where(F.col("n") > cell_rows).select("cell", "n")), "cell").where(F.pmod(F.xxhash64("id", F.lit(5)), every) == 0)
    out = {}
    for r in some.groupBy("cell").applyInArrow(fit, "cell int, axis binary, value binary").collect():  # 16 MB at most
        cuts = Cuts(np.empty((0, projected)), levels[r["cell"]])
        cuts.axis, cuts.value = np.frombuffer(r["axis"], np.int64), np.frombuffer(r["value"], np.float64)
        out[r["cell"]] = cuts
    return out


def _part(batches: Iterator[pa.RecordBatch], deeper: dict[int, Cuts], projected: int) -> Iterator[pa.RecordBatch]:
    """The number of each row's part of its cell."""
    for b in batches:
        points, cell = vectors.rows_of(b["point"], projected), b["cell"].to_numpy()
        sub = np.zeros(len(cell), np.int32)
        for c in np.unique(cell).tolist():
            if c in deeper:
                sub[cell == c] = deeper[c].cell(points[cell == c])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sub, pa.int32())], names=[*b.schema.names, "sub"])


def _project(batches: Iterator[pa.RecordBatch], dim: int, kind: type, directions: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, good = vectors.matrix(b["vector"], dim)
        yield pa.RecordBatch.from_arrays([b["id"].filter(pa.array(good)), vectors.binaries(x[good], kind), vectors.binaries(np.einsum("ij,jk->ik", x[good], directions))], names=["id", "vector", "point"])


def _place(batches: Iterator[pa.RecordBatch], cuts: Cuts, projected: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        p = vectors.rows_of(b["point"], projected)
        yield pa.RecordBatch.from_arrays([b["id"], b["vector"], b["point"], b["asks"], pa.array(cuts.cell(p), pa.int32()), *(pa.array(p[:, i]) for i in range(projected))], names=["id", "vector", "point", "asks", "cell", *(f"p{i}" for i in range(projected))])


def _answer(table: pa.Table, dim: int, kind: type, projected: int, k: int, widen: float) -> pa.Table:
    """The k nearest members of a cell for each row that asks, found by growing projected distance until the test holds."""
    member, asks = (table[c].to_numpy(zero_copy_only=False) for c in ("member", "asks"))
    ids, radius = table["id"].to_numpy(), table["radius"].to_numpy()
    x, p = vectors.rows_of(table["vector"], dim, kind), vectors.rows_of(table["point"], projected)
    own_ids, own_x, own_p = ids[member], x[member], p[member]
    tree, root = Tree(own_p, LEAF), math.sqrt(widen)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for q in np.flatnonzero(asks):
        limit, best_d, best_id = radius[q], np.empty(0), np.empty(0, np.int64)
        slack = SLACK * np.abs(p[q]).sum()
        reach = (limit * root + slack) ** 2
        gaps = tree.gaps(p[q]) if len(tree.leaves) else np.empty(0)
        order = np.argsort(gaps, kind="stable")
        step, i = 1, 0
        while i < len(order) and gaps[order[i]] <= reach:
            # Leaves come in growing groups; the test is made between groups, and for single rows within them.
            rows = np.concatenate([tree.leaves[j] for j in order[i : i + step]])
            i, step = i + step, min(2 * step, 16)
            rows = rows[(((own_p[rows] - p[q]) ** 2).sum(1) <= reach) & (own_ids[rows] != ids[q])]
            d = np.sqrt(((own_x[rows] - x[q]) ** 2).sum(1))
            d, i_all = np.concatenate([best_d, d]), np.concatenate([best_id, own_ids[rows]])
            keep = np.lexsort((i_all, d))[:k]
            best_d, best_id = d[keep], i_all[keep]
            if len(best_d) == k:
                limit = min(limit, best_d[-1])
                reach = (limit * root + slack) ** 2
        out.append((np.full(len(best_d), ids[q]), best_id, best_d))
    parts = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
    return pa.table({"query_id": pa.array(parts[0], pa.int64()), "vec_id": pa.array(parts[1], pa.int64()), "score": pa.array(parts[2], pa.float64())})
