from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import minhash_dedup, packing, words
from quern.llm.substring_dedup import substring_dedup
from tests.llm import fixtures as fx

EDGES = [(1000, None), (1001, ""), (1002, " \n"), (1003, "A b"), (1004, "a B"), (1005, "x" * 5000)]


@pytest.mark.parametrize("size", [10, 100, 1 << 20])
def test_words(size):
    texts = ["a b  c", None, "", "  x\ty ", "éé z\x0bq r", "one", *[t for _, t in fx.passages(2, 40)]]
    got, seen = [], {}
    for c in words.chunks(pa.array(texts), size=size):
        h, at = c.hashes(), c.offsets()
        lists = [[bytes(c.data[a:b]).decode() for a, b in zip(c.starts[at[i] : at[i + 1]], c.ends[at[i] : at[i + 1]], strict=True)] for i in range(c.last - c.first)]
        got += lists
        for w, x in zip([w for l in lists for w in l], h.tolist(), strict=True):  # noqa: E741
            assert seen.setdefault(w, x) == x
        for k in (1, 2, 3, 5, 35):
            assert len(words.FIRST.windows(h, k)) == max(0, len(h) - k + 1)
    assert got == [fx.tokens(t) for t in texts]
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize(("shard_bytes", "split_bits"), [(500, 10), (1 << 20, 10), (2000, 0)])
def test_substring_dedup(spark, shard_bytes, split_bits):
    """Many shards, one, and lists that are merged on their way."""
    rows = [*fx.passages(), *EDGES, (1006, "a " * 200), (7, fx.passages()[7][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("q")).withColumn("n_words", F.lit("old")).withColumn("odd.name", F.lit(1))
    got = substring_dedup(df, shard_bytes=shard_bytes, bucket_hashes=50, split_bits=split_bits)
    assert got.columns == ["doc_id", "text", "shard", "odd.name", "n_words", "n_removed"]
    want = sorted((d, n, r, " ".join(k)) for d, n, r, k in fx.cut(rows, 35))
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got.collect()) == want
    assert sum(r for _, _, r, _ in want) > 500


def test_substring_dedup_keeps_layout(spark):
    rows = fx.passages(4, 30)
    got = {r["doc_id"]: r for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), keep_layout=True).collect()}
    for (d, text), (_, _, removed, kept) in zip(rows, fx.cut(rows, 35), strict=True):
        assert fx.tokens(got[d]["text"]) == kept
        if not removed:
            assert got[d]["text"] == text


def test_substring_dedup_null_ids_and_empty(spark):
    df = spark.createDataFrame([(None, "b " * 40), (None, "b " * 40), (1, "c")], "doc_id long, text string")
    assert sorted((r["n_removed"], r["text"]) for r in substring_dedup(df).collect()) == [(0, "c"), (40, ""), (40, "")]
    assert substring_dedup(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        substring_dedup(df, window=20)


@pytest.mark.parametrize("task_shingles", [3_000_000, 1500])
def test_near_duplicates(spark, task_shingles):
    """The smaller bound sends groups through blocks and hubs."""
    rows = [*fx.copies(), *EDGES]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit(1)).withColumn("key", F.lit(2))
    assert sorted(map(tuple, minhash_dedup.near_duplicates(df, percent=85, task_shingles=task_shingles).collect())) == fx.near(rows)


def test_near_duplicates_repeated_rows_and_nulls(spark):
    df = spark.createDataFrame([(None, "a b"), (3, "A b"), (3, "A b"), (9, "a B"), (4, None), (4, None)], "doc_id long, text string")
    got = sorted(map(tuple, minhash_dedup.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(None, 1, None, False), (3, 1, 3, True), (3, 1, 3, True), (9, 1, 3, False), (4, 0, 4, True), (4, 0, 4, True)], key=repr)
    assert minhash_dedup.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize(("words", "own", "percent"), [(89, 15, 85), (88, 16, 85), (84, 20, 80), (83, 21, 80)])
def test_boundary_similarity(spark, words, own, percent):
    """words - 4 shingles of the longer text's words + own - 4: at 85 or 80 of 100 in common a link, at one less none."""
    a = [f"a{i}" for i in range(words + own)]
    rows = [(1, " ".join(a)), (2, " ".join(a[:words]))]
    got = sorted(map(tuple, minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()))
    assert got == fx.near(rows, percent)
    assert (got[1][2] == 1) == (words - 4 == percent)


@pytest.mark.parametrize("letters", [16, 128, 2048])
def test_words_that_polynomials_confuse(spark, letters):
    one, two = fx.thue_morse(letters)
    same = " ".join(f"w{i}" for i in range(34))
    df = spark.createDataFrame([(1, f"{one} {same}"), (2, f"{two} {same}")], "doc_id long, text string")
    assert {r["n_removed"] for r in substring_dedup(df).collect()} == {0}
    df = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    assert sorted(map(tuple, minhash_dedup.near_duplicates(df).collect())) == [(1, 1, 1, True), (2, 1, 2, True)]


def test_runs_of_words_that_polynomials_confuse():
    """The same pattern made of two words: all windows of both orders differ."""
    one, two = ([{"a": 1, "b": 2}[x] for x in w] for w in fx.thue_morse(2048))
    h = words.mix(np.arange(3, dtype=np.uint64))
    for width in (2, 32, 35, 1024, 2048):
        a, b = (words.FIRST.windows(h[np.array(x)], width) for x in (one, two))
        want = {tuple(one[i : i + width]) for i in range(2048 - width + 1)} | {tuple(two[i : i + width]) for i in range(2048 - width + 1)}
        assert len(set(a.tolist()) | set(b.tolist())) == len(want)


def test_many_unlike_sets_in_one_group():
    """A hundred thousand short sets that a chain of keys joins to one group: a lookup for each, no comparison of all pairs.
    Texts share two fifths of their words, so that they meet often; each tenth has a copy with one word less."""
    shared, n = " ".join(f"s{i}" for i in range(14)), 100_000
    texts = [f"{shared} " + " ".join(f"u{i}x{j}" for j in range(20)) for i in range(n)]
    texts = [t if i % 10 else " ".join(texts[i + 1].split()[:-1]) for i, t in enumerate(texts)]
    table = pa.table({"node": np.arange(n), "text": pa.array(texts)})
    got = minhash_dedup._settle(table, 85, 5)["component"].to_numpy()
    want = np.arange(n)
    want[1::10] = want[::10]
    assert (got == want).all()


def test_groups_are_dealt_by_members_and_by_shingles(spark):
    """Groups over either bound go through blocks; rows that share an id or repeat are documents of their own."""
    draw = np.random.default_rng(5)
    rows = [(i, " ".join([f"t{j}" if draw.random() > 0.02 else f"o{draw.integers(99)}" for j in range(60)])) for i in range(150)]
    rows += [(3, "one more text of this id, " * 3), rows[5], rows[5]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for bounds in ({"task_sets": 20}, {"task_shingles": 800}, {}):
        assert sorted(map(tuple, minhash_dedup.near_duplicates(df, percent=80, **bounds).collect())) == sorted(fx.near(rows, 80))


def test_pack_against_the_optimum():
    costs = {4: 4.0, 6: 6.0, 8: 8.0}
    place, capacity, used = packing.pack([8, 4, 4, 3, 3, 2], costs)
    assert sorted(capacity.tolist()) == [8, 8, 8] and used.sum() == 24
    place, capacity, used = packing.pack([3], costs)
    assert capacity.tolist() == [4] and used.tolist() == [3]
    # Large bins are dear: small ones are opened.
    _, capacity, _ = packing.pack([4, 4, 4, 4], {4: 1.0, 8: 5.0})
    assert capacity.tolist() == [4, 4, 4, 4]
    assert [len(x) for x in packing.pack([], costs)] == [0, 0, 0]


def optimum(lengths, costs):
    """Least cost over all ways to part the pieces into bins of permitted sizes."""
    fits = [sum(x for i, x in enumerate(lengths) if s >> i & 1) for s in range(1 << len(lengths))]
    price = [min((c for size, c in costs.items() if size >= f), default=float("inf")) for f in fits]
    best = [0.0] * len(fits)
    for s in range(1, len(fits)):
        low, sub, least = s & -s, s, float("inf")
        while sub:
            if sub & low and price[sub] + best[s ^ sub] < least:
                least = price[sub] + best[s ^ sub]
            sub = (sub - 1) & s
        best[s] = least
    return best[-1]


@pytest.mark.parametrize("costs", [{4: 4.0, 6: 6.0, 8: 8.0}, {4: 3.0, 8: 8.0}, {3: 4.0, 7: 7.0, 10: 9.0}])
def test_pack_against_every_packing(costs):
    """Never far over the least cost of all packings of up to eight pieces, and mostly at it."""
    draw, equal, runs = np.random.default_rng(1), 0, 120
    for _ in range(runs):
        lengths = draw.integers(1, max(costs) + 1, draw.integers(1, 9)).tolist()
        _, capacity, _ = packing.pack(lengths, costs)
        got, least = sum(costs[int(c)] for c in capacity), optimum(lengths, costs)
        assert least <= got <= 1.5 * least
        equal += got == least
    assert equal >= 0.75 * runs


def test_packing_query_places_every_word(spark, small):
    """The registered query on the whole table: each document's words are placed once, in bins no larger than they must be."""
    from quern.llm import queries

    words_of = {r["doc_id"]: len(fx.tokens(r["text"])) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    placed: dict = {}
    bins: dict = {}
    for r in queries.op1_best_fit_packing(spark, small).collect():
        placed.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        bins.setdefault(r["bin_id"], []).append(r)
    for d, n in words_of.items():
        assert sorted(placed.pop(d)) == ([(a, min(4096, n - a)) for a in range(0, n, 4096)] or [(0, 0)])
    assert not placed
    for rows in bins.values():
        used = sum(r["length"] for r in rows)
        assert {(r["used"], r["capacity"]) for r in rows} == {(used, min(c for c in packing.CAPACITIES if c >= used))}
        assert len({r["offset"] for r in rows if r["length"]}) == sum(r["length"] > 0 for r in rows)


def test_pack_is_valid_and_tight():
    lengths = np.random.default_rng(0).integers(0, 513, 3000)
    place, capacity, used = packing.pack(lengths, {128: 128.0, 256: 256.0, 512: 512.0})
    assert (np.bincount(place, weights=lengths) == used).all() and (used <= capacity).all()
    assert used.sum() / capacity.sum() > 0.97  # uniform lengths waste about the root of their number of bins
    again = packing.pack(lengths, {128: 128.0, 256: 256.0, 512: 512.0})
    assert all((a == b).all() for a, b in zip((place, capacity, used), again, strict=True))


def test_best_fit_packing(spark):
    rows = [*fx.passages(5, 60), *EDGES, (None, "n n"), (3, "again"), (3, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bin_id", F.lit("mine"))
    got = packing.best_fit_packing(df, (16, 40, 100), shard_pieces=20).collect()
    per_doc: dict = {}
    for r in got:
        per_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    want: dict = {}
    for d, t in rows:
        n = len(fx.tokens(t))
        want.setdefault(d, []).extend([(a, min(100, n - a)) for a in range(0, n, 100)] or [(0, 0)])
    assert {k: sorted(v) for k, v in per_doc.items()} == {k: sorted(v) for k, v in want.items()}
    bins: dict = {}
    for r in got:
        bins.setdefault(r["bin_id"], []).append(r)
    for pieces in bins.values():
        pieces.sort(key=lambda r: r["position"])
        assert [r["position"] for r in pieces] == list(range(len(pieces)))
        assert [r["offset"] for r in pieces] == np.cumsum([0] + [r["length"] for r in pieces])[:-1].tolist()
        assert sum(r["length"] for r in pieces) == pieces[0]["used"] <= pieces[0]["capacity"]
        assert pieces[0]["capacity"] == min(c for c in (16, 40, 100) if c >= pieces[0]["used"])
    assert packing.best_fit_packing(df.limit(0)).collect() == []


def test_packed_sequences_hold_the_texts(spark):
    rows = fx.passages(6, 40)
    got = packing.packed_sequences(spark.createDataFrame(rows, "doc_id long, text string"), (50, 200)).collect()
    texts = dict(rows)
    seen = []
    for r in got:
        w = []
        for d, a, n in zip(r["doc_ids"], r["starts"], r["lengths"], strict=True):
            w += fx.tokens(texts[d])[a : a + n]
            seen.append((d, a, n))
        assert fx.tokens(r["text"]) == w and len(w) == r["used"]
    assert sum(n for _, _, n in seen) == sum(len(fx.tokens(t)) for t in texts.values())
    assert hashlib.sha256(repr(sorted({d for d, _, _ in seen})).encode()).digest() == hashlib.sha256(repr(sorted(texts)).encode()).digest()
