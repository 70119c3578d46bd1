from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import queries
from tests.conftest import rows as as_rows
from tests.llm import fixtures as fx


def test_stages(spark, small, tmp_path):
    """Each stage against a brute-force version of its decision on its own input."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    inputs = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, inputs[-1], small).write.parquet(str(tmp_path / name))
        inputs.append(spark.read.parquet(str(tmp_path / name)))
    raw, clean, single, cut, packed = ([r.asDict() for r in x.collect()] for x in inputs)
    assert all(x.columns == columns for x in inputs[:-1])
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{small}/labels.parquet").where("toxic = 1").collect()}
    gone = {r["doc_id"] for r in raw} - {r["doc_id"] for r in clean}
    assert len(gone - toxic) <= 0.2 * len(raw)  # few labels are known of this small table
    kept = {d for d, _, _, k in fx.near([(r["doc_id"], r["text"]) for r in clean], 80) if k}
    assert sorted(r["doc_id"] for r in single) == sorted(kept)
    want = {d: k for d, _, _, k in fx.cut([(r["doc_id"], r["text"]) for r in single], 35)}
    assert {r["doc_id"]: fx.tokens(r["text"]) for r in cut} == want
    assert all(r["n_chars"] == len(r["text"]) for r in cut)
    assert {d for r in packed for d in r["doc_ids"]} == kept
    assert sum(r["used"] for r in packed) == sum(map(len, want.values()))


def test_edges_of_the_stages(spark, small):
    """Repeated rows, null ids and null texts go through all stages; one row of each id stays."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, "en", "s", 1), (3, None, None, None, None), (3, None, None, None, None), (None, "own words", "xx", "s", 9), (4, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{small}/documents.parquet").schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, small).collect(), docs.schema)
        if name == "near_dedup":
            assert sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=repr) == sorted([(1, text), (3, None), (4, ""), (None, "own words")], key=repr)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert sorted((d for r in packed for d in r["doc_ids"]), key=repr) == sorted([1, 3, 4, None], key=repr)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), small).collect() == []


def test_near_dedup_of_rows_that_share_an_id(spark, small):
    """A copy takes only its own row away; another text of the same id stays, and a copy without an id goes."""
    a, b, c, d, e, f = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcdef")
    near = e.replace("e59", "other")
    rows = [(1, a), (2, b), (2, a), (3, c), (3, d), (3, d), (5, ""), (5, None), (6, e), (6, c), (7, near), (None, a), (None, f), (None, f), (None, f.replace("f0", "first")), (None, f.replace("f", "F"))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], spark.read.parquet(f"{small}/documents.parquet").schema)
    orders = [docs, docs.orderBy(F.desc("text")).repartition(3), *(docs.orderBy(F.rand(seed)).coalesce(1 + seed % 2) for seed in range(3))]
    first = None
    for given in orders:
        got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, given, small).collect()), key=repr)
        outside = [t for i, t in got if i is None]
        assert len(outside) == 1 and outside[0].lower().split()[1:] == f.split()[1:]
        assert [r for r in got if r[0] is not None] == sorted([(1, a), (2, b), (3, c), (3, d), (5, ""), (5, None), (6, e)], key=repr)
        first = first or got
        assert got == first


def test_run_equals_its_stages(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert out.select(F.sum("used")).first()[0] > 0
    assert corpus_pipeline.ORACLE_SQL is None
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "packing"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(name, spark, small, duck: duckdb.DuckDBPyConnection):
    df = queries.queries()[name](spark, small)
    found = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert as_rows(df.columns, df.collect()) == as_rows(names, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql()) - {"pipeline"}))
def test_other_queries_run(name, spark, small):
    assert queries.queries()[name](spark, small).count() > 0


def test_nearest_neighbours_query_against_all_distances(spark, small, duck):
    """Whole query and table: recall against every distance, exact scores, order and ties."""
    found = duck.execute("""SELECT q.vec_id, c.vec_id, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS d
        FROM embeddings q JOIN embeddings c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY d, c.vec_id) <= 10""").fetchall()
    want = {(q, c): d for q, c, d in found}
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in queries.op6_nearest_neighbours(spark, small).collect()}
    assert len(got) == len(want) and {q for q, _ in got} == {q for q, _ in want}
    assert len(got.keys() & want.keys()) >= 0.9 * len(want)
    assert all(s == pytest.approx(want[k], rel=1e-12) for k, s in got.items() if k in want)


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries() if n.startswith("op")) == list(range(1, 11))
