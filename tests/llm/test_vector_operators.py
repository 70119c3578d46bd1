from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import neighbours, vectors
from quern.llm.components import connected_components
from quern.llm.embedding_dedup import embedding_duplicates
from tests.llm import fixtures as fx


def sample(n=260, dim=8):
    draw = np.random.default_rng(0)
    rows = [draw.standard_normal(dim).tolist() for _ in range(n)]
    rows += [(np.array(rows[i % 15]) * 2 + draw.standard_normal(dim) * 0.3).tolist() for i in range(150)]
    rows += [rows[5]] * 90
    return list(enumerate([*rows, None, [0.0] * dim, [1.0, None] + [0.0] * (dim - 2), [float("nan")] * dim, [1.0, 2.0], [float("inf")] + [1.0] * (dim - 1), [1e-200] * dim]))


@pytest.mark.parametrize("interval", [50, 8192])
def test_embedding_duplicates(spark, interval):
    rows = sample()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit(0)).withColumn("part", F.lit("x"))
    ids = [i for i, _ in rows]
    unit = [np.array(v) / np.linalg.norm(np.array(v) / np.abs(v).max()) / np.abs(v).max() if fx.usable(v, 8) else None for _, v in rows]
    link = lambda i, j: unit[i] is not None and unit[j] is not None and float(unit[i] @ unit[j]) >= 0.9
    found = fx.components(ids, link)
    want = sorted((i, sum(link(a, b) for b in range(len(ids)) if b != a), c, c == i) for a, (i, c) in enumerate(zip(ids, found, strict=True)))
    assert sorted(map(tuple, embedding_duplicates(df, interval=interval).collect())) == want


def test_embedding_duplicates_edges(spark):
    df = spark.createDataFrame([(None, [1.0]), (1, [2.0]), (1, [2.0]), (2, [3.0]), (3, [-1.0])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, embedding_duplicates(df).collect()), key=repr)
    assert got == sorted([(None, 0, None, False), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)], key=repr)
    assert embedding_duplicates(df.limit(0)).collect() == []
    floats = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1])], "vec_id long, embedding array<float>")
    assert {r["n_links"] for r in embedding_duplicates(floats).collect()} == {1}
    with pytest.raises(ValueError):
        embedding_duplicates(df, cosine=1.5)


@pytest.mark.parametrize("cells", [4096, 2])
def test_nearest_neighbours_recall(spark, small, monkeypatch, cells):
    """With few cells of the first levels these get levels of their own."""
    monkeypatch.setattr(neighbours, "CELLS", cells)
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    got: dict = {}
    for r in neighbours.nearest_neighbours(df, df.where("vec_id % 20 = 0"), cell_rows=100 if cells > 2 else 20).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    rows = sorted((i, v) for i, v in rows if fx.usable(v, 64))
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    hits = total = 0
    for k in np.flatnonzero(ids % 20 == 0):
        d = np.sqrt(((x - x[k]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if j != k][:10]
        mine = [got[ids[k]][r] for r in range(1, 11)]
        assert mine == sorted(mine, key=lambda t: (t[1], t[0]))
        for v, s in mine:
            assert s == d[np.searchsorted(ids, v)]
        hits, total = hits + len({v for v, _ in mine} & set(ids[order].tolist())), total + 10
    assert hits / total >= 0.9


def test_nearest_neighbours_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.5]), (1, [1.0, 0.5]), (2, None), (3, [0.0, 0.0]), (None, [1.0, 1.0]), (100, [1.0, 0.0]), (4, [float("inf"), 1.0]), (5, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit(1))
    got = sorted(map(tuple, neighbours.nearest_neighbours(df, df.where("vec_id % 100 = 0")).collect()))
    assert got == [(0, 1, 100, 0.0), (0, 2, 1, 0.5), (100, 1, 0, 0.0), (100, 2, 1, 0.5)]
    assert neighbours.nearest_neighbours(df.limit(0)).collect() == []


def test_ties_and_one_hot_cell(spark):
    """Equal vectors can't be split by coordinates; nearest come in order of ids."""
    rows = [(i, [1.0, 2.0]) for i in range(300)] + [(i, [float(i), 0.0]) for i in range(300, 330)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [r for r in neighbours.nearest_neighbours(df, df.where("vec_id = 200"), cell_rows=40).orderBy("rank").collect()]
    assert [r["vec_id"] for r in got] == list(range(10)) and {r["score"] for r in got} == {0.0}


def test_equal_vectors_in_batches_of_all_sizes(spark):
    """1,001 equal vectors, dealt so that projections are computed in batches of a thousand and of one."""
    row = np.random.default_rng(3).standard_normal(64).tolist()
    df = spark.createDataFrame([(i, row) for i in range(1001)], "vec_id long, embedding array<double>").coalesce(1)
    got: dict = {}
    for r in neighbours.nearest_neighbours(df, df.where("vec_id % 100 = 0"), cell_rows=300).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 1001, 100):
        assert [(v, s) for _, v, s in sorted(got[q])] == [(v, 0.0) for v in range(11) if v != q][:10], q


def test_vectors_of_several_lengths(spark):
    """Each among those of as many components, whichever length is the more frequent."""
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0]), (4, [2.0]), (5, [-1.0]), (6, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (None, None)]
    for given in (rows, rows[2:] + rows[:2] + [(7, [0.0, 1.0]), (8, [0.0, 1.1])]):
        df = spark.createDataFrame(given, "vec_id long, embedding array<double>")
        got = {r["vec_id"]: tuple(r)[1:] for r in embedding_duplicates(df).where("vec_id is not null").collect()}
        assert [got[i] for i in range(1, 7)] == [(1, 1, True), (1, 1, False), (1, 3, True), (1, 3, False), (0, 5, True), (0, 6, True)]
        assert embedding_duplicates(df).where("vec_id is null").count() == 2
        near = {(r["query_id"], r["rank"]): r["vec_id"] for r in neighbours.nearest_neighbours(df, df.where("vec_id in (1, 3, 6)")).collect()}
        assert near[1, 1] == 2 and near[3, 1] == 4 and near[3, 2] == 5 and (3, 3) not in near and (6, 1) not in near


def test_intervals_of_clustered_vectors_are_skipped(spark, caplog):
    """Vectors whose variance is on few axes: most pairs of intervals are skipped, and rows go to few of them."""
    draw = np.random.default_rng(9)
    centres = draw.standard_normal((40, 3)) * 4
    x = np.concatenate([centres[draw.integers(40, size=3000)], draw.standard_normal((3000, 13)) * 0.3], 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    with caplog.at_level("INFO", logger="quern.llm.embedding_dedup"):
        got = {r["vec_id"]: r["n_links"] for r in embedding_duplicates(df, cosine=0.98, interval=64, leaf=16).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.98).sum(1) - 1
    assert [got[i] for i in range(3000)] == links.tolist() and links.sum() > 1000
    total, intervals, kept, every, copies = caplog.records[-1].args
    assert kept < 0.4 * every and copies < 0.25 * total * intervals


def test_chi_square():
    assert neighbours.chi_square_quantile(0.95, 8) == pytest.approx(15.507313, abs=1e-5)
    assert neighbours.chi_square_quantile(0.5, 2) == pytest.approx(1.386294, abs=1e-5)
    with pytest.raises(ValueError):
        neighbours.chi_square_quantile(0.5, 3)


def test_units():
    x = vectors.units(np.array([[3e200, 4e200], [3e-200, 4e-200], [0.0, 0.0]]))
    assert x.tolist() == [[pytest.approx(0.6), pytest.approx(0.8)], [pytest.approx(0.6), pytest.approx(0.8)], [0.0, 0.0]]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 100), (7, 7), (60, 61), (62, 61), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 50: 50, 100: 50, 60: 60, 61: 60, 62: 60}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
