"""MinHash near-dedup by a multi-index Hamming join, every link confirmed on full shingle sets.

Each distinct shingle set gets a signature of SYMBOLS b-bit MinHash symbols. The signature is split into chunks of WIDTH
symbols. If two signatures differ in at most ERRORS * chunks + chunks - 1 symbols, some chunk has at most ERRORS of them
(pigeonhole), so the keys of a chunk enumerate the allowed errors: one key for each way to leave ERRORS of its symbols
out. All pairs under that signature distance share a key, without exception and without a cap on how many share it.

With 32 symbols in 8 chunks of 4 and one error a chunk, every pair with at most 15 differing symbols is found. A pair at
similarity 0.8 differs in 6.4 on average; it is missed only if all eight chunks have two errors or more,
0.181 ** 8 = 1e-6 (2e-8 at 0.85). Two unrelated texts share a key by chance with probability 2 ** -48 for each key.

From keys to links, without all pairs of a group:
 1. Equal sets are one class, and a node of the graph.
 2. Each key links its classes to one of them; the components of that graph are the candidate groups. Any two classes
    that share a key are in one group.
 3. A group whose members and shingles fit into a task is joined there exactly, by an index of rare shingles: of two
    sets as alike as asked, the shingles left when the most frequent ones of each are taken away must meet (prefix
    filter). A set is compared with those it meets there and is not yet connected with, so that copies cost one
    comparison each and unlike sets next to none.
 4. A larger group is dealt into blocks. Its most frequent hubs are sent to every block and settle most members; what is
    not in the group's largest component then, and only that, is compared with all blocks, in parts of a task's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.sources import scratch

from . import words
from .columns import own
from .components import connected_components

SHINGLE, SYMBOLS, WIDTH, ERRORS, SYMBOL_BITS = 5, 32, 4, 1, 16
#: Shingles and sets of a group that one task joins; a shingle takes some 60 bytes while it works, and a set that is like
#: no other takes a lookup.
TASK_SHINGLES, TASK_SETS = 1_000_000, 50_000
#: Hubs sent to each block of a larger group.
HUBS = 16

SIGNED = T.StructType([T.StructField("id", T.LongType()), T.StructField("found", T.StructType([T.StructField("x", T.LongType()), T.StructField("y", T.LongType())])), T.StructField("n_shingles", T.LongType()), T.StructField("print", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])
LABELS = T.StructType([T.StructField("node", T.LongType()), T.StructField("component", T.LongType())])


def shingle_sets(values: pa.ChunkedArray, width: int = SHINGLE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of a text column as (hashes, second hashes, bounds): all shingles of each text, repeats included.

    A-Z become lower case. A text with fewer than `width` words has one shingle, its whole word sequence; without words
    it has none.
    """
    for c in words.chunks(values, lower=True):
        inside, at, short = c.within(width), c.offsets(), np.flatnonzero((c.counts > 0) & (c.counts < width))
        counts = np.where(c.counts >= width, c.counts - width + 1, (c.counts > 0).astype(np.int64))
        bounds = np.concatenate(([0], np.cumsum(counts)))
        pair = []
        for kind in (words.FIRST, words.SECOND):
            h = c.hashes(kind)
            every = np.empty(bounds[-1], np.uint64)
            long = np.ones(len(every), bool)
            long[bounds[short]] = False
            every[long] = kind.windows(h, width)[inside]
            for n in range(1, width):
                few = short[c.counts[short] == n]
                run = h[at[few]]
                for j in range(1, n):
                    run = kind.join(run, h[at[few] + j])
                every[bounds[few]] = words.mix(run ^ np.uint64(n))
            pair.append(every)
        yield pair[0], pair[1], bounds


def _distinct(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Distinct shingles by both hashes, sorted, as (n, 2)."""
    order = np.argsort(first)
    one, two = first[order], second[order]
    same = one[1:] == one[:-1]
    if (two[1:][same] != two[:-1][same]).any():  # two shingles with one first hash
        order = np.lexsort((second, first))
        one, two = first[order], second[order]
        same = one[1:] == one[:-1]
    new = np.ones(len(one), bool)
    new[1:] = ~same | (two[1:] != two[:-1])
    return np.stack([one[new], two[new]], 1)


def _signatures(symbols: int, width: int, errors: int, shingle: int) -> Callable:
    """A function from batches of (id, text) to SIGNED."""
    draw = np.random.default_rng(20240501)
    factors = draw.integers(1, 1 << 63, symbols, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = draw.integers(0, 1 << 63, symbols, dtype=np.uint64)
    keep = [(c, left) for c in range(symbols // width) for left in combinations(range(width), width - errors)]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for first, second, bounds in shingle_sets(pa.chunked_array([batch["text"]]), shingle):
                n, sizes = len(bounds) - 1, np.diff(bounds)
                full = np.flatnonzero(sizes)
                least = np.zeros((symbols, n), np.uint64)
                for k in range(symbols):
                    if len(full):
                        least[k, full] = np.minimum.reduceat(first * factors[k] + shifts[k], bounds[full])
                symbol = words.mix(least) >> np.uint64(64 - SYMBOL_BITS)
                keys = np.zeros((n, len(keep)), np.uint64)
                for i, (chunk, left) in enumerate(keep):
                    key = np.full(n, 1 + i, np.uint64)
                    for j in left:
                        key = words.mix(key * np.uint64(1 << SYMBOL_BITS) + symbol[chunk * width + j])
                    keys[:, i] = key
                counts, prints = np.zeros(n, np.int64), []
                for i in range(n):
                    pairs = _distinct(first[bounds[i] : bounds[i + 1]], second[bounds[i] : bounds[i + 1]])
                    counts[i] = len(pairs)
                    prints.append(hashlib.blake2b(pairs.tobytes(), digest_size=16).digest() if len(pairs) else None)
                offsets = np.arange(0, n * len(keep) + 1, len(keep), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([batch["id"].slice(done, n), batch["found"].slice(done, n), pa.array(counts), pa.array(prints, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64).ravel()))], names=["id", "found", "n_shingles", "print", "keys"])
                done += n

    return sign


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, shingle: int = SHINGLE, symbols: int = SYMBOLS, width: int = WIDTH, errors: int = ERRORS, task_shingles: int = TASK_SHINGLES, task_sets: int = TASK_SETS) -> DataFrame:
    """Groups of documents whose shingle sets are alike: 100 * |intersection| >= percent * |union|.

    Returns (id_col, n_shingles long, component_id long, kept boolean), one row for each row of docs: the number of
    distinct shingles, the smallest id that links reach, and whether that is the row's own id. Every row is a document
    of its own, also where rows share an id or all of their values. Shingles are compared by 128 bits of hashes.

    Null and empty texts, and texts of white space, have no shingles and link with nothing. A null id keeps its row, with
    component_id null and kept false, and links nothing. Long texts count whole. An empty table gives an empty table.
    Columns besides the two named are not read.
    """
    found = F.struct(F.xxhash64("text").alias("x"), F.xxhash64(F.lit(7), "text").alias("y"))  # by which a text is found again
    texts = docs.select(own(id_col).cast("long").alias("id"), own(text_col).alias("text")).withColumn("found", found)
    signed = scratch.save(texts.mapInArrow(_signatures(symbols, width, errors, shingle), SIGNED), "signed")
    known = signed.where("id is not null and print is not null")
    classes = known.groupBy("print").agg(F.min(F.struct("id", "found")).alias("least"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys")).select("print", "least.*", "n", "keys")
    classes = scratch.save(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    keys = classes.select("node", F.explode("keys").alias("key"))
    hubs = keys.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    candidates = scratch.save(keys.join(hubs, "key").where("node <> hub").groupBy("node", "hub").count(), "candidates")
    groups = connected_components(candidates, "node", "hub").withColumnRenamed("component", "grp")
    groups = scratch.save(groups.join(classes.select("node", "n", "id", "found"), "node"), "groups")
    labels, used = _within_tasks(texts, groups, candidates, percent, shingle, task_shingles, task_sets)
    labels = scratch.save(labels, "labels")
    scratch.drop(groups, candidates, *used)
    placed = classes.select("print", "id", "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    out = signed.select("id", "n_shingles", "print").join(placed.join(least, "component").select("print", "component_id"), "print", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


def _within_tasks(texts: DataFrame, groups: DataFrame, candidates: DataFrame, percent: int, shingle: int, task_shingles: int, task_sets: int) -> tuple[DataFrame, list[DataFrame]]:
    """(node, component) of every class in a candidate group, from confirmed links only, and what was saved for it."""
    sizes = groups.groupBy("grp").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("members"))
    blocks = F.ceil(F.greatest(F.col("total") / (task_shingles / 2), F.col("members") / (task_sets / 2))).cast("int")
    large = sizes.where((F.col("total") > task_shingles) | (F.col("members") > task_sets)).select("grp", blocks.alias("blocks"))
    large = scratch.save(large, "large")
    rows = _fetch(texts, groups.join(large.select("grp"), "grp", "left_anti").select("node", "grp", "id", "found"))
    labels = rows.groupBy("grp").applyInArrow(lambda t: _settle(t, percent, shingle), LABELS)
    if large.isEmpty():
        return labels, [large]
    members = groups.join(large, "grp").select("node", "grp", "blocks", "n", "id", "found")
    rows = _fetch(texts, members).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = scratch.save(rows.select("node", "grp", "blocks", "block", "n", "text"), "members")
    rank = candidates.join(members.select(F.col("node").alias("hub"), "grp"), "hub").groupBy("grp", "hub").agg(F.sum("count").alias("n"))
    top = F.expr(f"slice(array_sort(collect_list(struct(-n as n, hub))), 1, {HUBS})")
    # Only hubs are collected, HUBS of each part of a group, then of the group.
    dealt = rank.withColumn("deal", F.pmod(F.xxhash64("hub"), F.lit(64)))
    few = dealt.withColumn("k", F.row_number().over(Window.partitionBy("grp", "deal").orderBy(F.desc("n"), "hub"))).where(F.col("k") <= HUBS)
    first = few.groupBy("grp").agg(top.alias("top")).select(F.explode("top.hub").alias("node"))
    columns = ["node", "text", "grp", "block", "asks", "part", "label"]
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    plain = rows.withColumn("part", F.lit(0)).withColumn("label", F.col("node"))
    star = scratch.save(_ask(plain.join(first, "node", "left_semi").withColumn("block", every), plain, columns, percent, shingle), "star")
    settled = connected_components(star, "a", "b")
    placed = rows.join(settled, "node", "left").withColumn("label", F.coalesce("component", "node"))
    main = placed.groupBy("grp", "label").count().groupBy("grp").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    # What is loose, in parts of a task's size, each part against each block of its own group.
    loose = placed.join(main, "grp").where("label <> main")
    parts = loose.groupBy("grp").agg(F.ceil(F.greatest(F.sum("n") / (task_shingles / 2), F.count(F.lit(1)) / (task_sets / 2))).cast("int").alias("parts"))
    loose = loose.join(parts, "grp").withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int"))
    against = placed.join(parts, "grp").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rest = _ask(loose.withColumn("block", every), against, columns, percent, shingle)
    linked = connected_components(star.union(rest), "a", "b")
    return labels.union(linked), [large, rows, star]


def _fetch(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The text of each row of wanted, which are distinct by node, found by its id and 128 bits of the text; of rows that
    are equal in both, one."""
    columns = [c for c in wanted.columns if c not in ("id", "found")]
    met = texts.select("id", "found.x", "found.y", "text").join(wanted.select("id", "found.x", "found.y", *columns).hint("merge"), ["id", "x", "y"])
    return met.groupBy(*columns).agg(F.first("text").alias("text"))


def _ask(ask: DataFrame, rows: DataFrame, columns: list[str], percent: int, shingle: int) -> DataFrame:
    """Links (a, b) between the sets that ask and the rows of the same group, block and part; a forest of them suffices."""
    both = ask.withColumn("asks", F.lit(True)).select(columns).union(rows.withColumn("asks", F.lit(False)).select(columns))
    return both.groupBy("grp", "block", "part").applyInArrow(lambda t: _stars(t, percent, shingle), "a long, b long")


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of runs of given starts and sizes, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


#: Shingles compared at once when one set meets many.
AT_ONCE = 1 << 20


class _Sets:
    """Shingle sets as numbers of a common vocabulary, rare ones first, with an index of their prefixes."""

    def __init__(self, values: pa.ChunkedArray, shingle: int, percent: int):
        parts, self.percent = [], percent
        for first, second, bounds in shingle_sets(values, shingle):
            parts += [_distinct(first[a:b], second[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.size = np.array([len(p) for p in parts], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.size)))
        every = np.concatenate([np.empty((0, 2), np.uint64), *parts])
        row = np.repeat(np.arange(len(parts)), self.size)
        order = np.lexsort((every[:, 1], every[:, 0]))
        new = np.ones(len(order), bool)
        new[1:] = (every[order][1:] != every[order][:-1]).any(1)
        item = np.empty(len(order), np.int64)
        item[order] = np.cumsum(new) - 1
        often = np.bincount(item)
        rank = np.empty(len(often), np.int64)
        rank[np.argsort(often, kind="stable")] = np.arange(len(often))
        self.item = rank[item]
        self.item = self.item[np.lexsort((self.item, row))]
        # Sets as alike as asked have at least this share of the larger one in common, so they meet in what is left.
        self.prefix = self.size - -(-percent * self.size // 100) + 1
        place = _ranges(self.start[:-1], np.where(self.size > 0, self.prefix, 0))
        place = place[np.sort(often)[self.item[place]] > 1]
        by = np.argsort(self.item[place], kind="stable")
        self.posted, self.rows = self.item[place][by], row[place][by]
        self.mark = np.zeros(len(often), bool)

    def linked(self, i: int, label: np.ndarray) -> np.ndarray:
        """Sets as alike to set i as asked, but for those of its own label; empty sets are alike to none."""
        own_items = self.item[self.start[i] : self.start[i + 1]]
        few = own_items[: self.prefix[i]]
        a = np.searchsorted(self.posted, few)
        met = self.rows[_ranges(a, np.searchsorted(self.posted, few, side="right") - a)]
        met = np.unique(met[label[met] != label[i]])
        met = met[(100 * self.size[met] >= self.percent * self.size[i]) & (100 * self.size[i] >= self.percent * self.size[met])]
        if not len(met):
            return met
        self.mark[own_items] = True
        both = np.empty(len(met), np.int64)
        edge = np.searchsorted(np.cumsum(self.size[met]), np.arange(0, self.size[met].sum(), AT_ONCE))
        for lo, hi in zip(edge, [*edge[1:], len(met)], strict=True):
            if lo < hi:
                some = met[lo:hi]
                hit = self.mark[self.item[_ranges(self.start[some], self.size[some])]]
                both[lo:hi] = np.add.reduceat(hit, np.cumsum(self.size[some]) - self.size[some], dtype=np.int64)
        self.mark[own_items] = False
        return met[100 * both >= self.percent * (self.size[met] + self.size[i] - both)]


class _Forest:
    """Components of the rows seen so far; rows of one label begin as one. The smaller one takes the larger one's label."""

    def __init__(self, labels: np.ndarray):
        self.label = np.unique(labels, return_inverse=True)[1]
        order = np.argsort(self.label, kind="stable")
        self.rows = dict(enumerate(np.split(order, np.cumsum(np.bincount(self.label))[:-1]))) if len(order) else {}

    def join(self, i: int, linked: np.ndarray) -> None:
        found = np.unique(np.append(self.label[linked], self.label[i]))
        if len(found) > 1:
            most = max(found.tolist(), key=lambda x: len(self.rows[x]))
            rest = np.concatenate([self.rows.pop(x) for x in found.tolist() if x != most])
            self.label[rest] = most
            self.rows[most] = np.concatenate([self.rows[most], rest])

    def least(self, ids: np.ndarray) -> np.ndarray:
        """The smallest id of each row's component."""
        least = np.full(int(self.label.max(initial=0)) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, self.label, ids)
        return least[self.label]


#: Sets that ask before the largest component so far is chosen.
TRIALS = 16


def _settle(table: pa.Table, percent: int, shingle: int) -> pa.Table:
    """All links within a group. Every set asks but those found in one chosen component before their turn: of two sets
    outside it each asks, and of one outside and one inside, the one outside does."""
    ids = table["node"].to_numpy()
    sets, forest, chosen = _Sets(table["text"], shingle, percent), _Forest(ids), None
    for turn, i in enumerate(np.argsort(ids)):
        if chosen is not None and forest.label[i] == forest.label[chosen]:
            continue
        forest.join(i, sets.linked(i, forest.label))
        if chosen is None:
            most = max(forest.rows.values(), key=len)
            if turn + 1 >= TRIALS or 2 * len(most) >= len(ids):
                chosen = int(most[0])
    return pa.table({"node": ids, "component": forest.least(ids)})


def _stars(table: pa.Table, percent: int, shingle: int) -> pa.Table:
    """Links of each asking set with the others, as edges to the smallest id of what is connected here."""
    ids, asks = table["node"].to_numpy(), np.flatnonzero(table["asks"].to_numpy(zero_copy_only=False))
    sets, forest = _Sets(table["text"], shingle, percent), _Forest(table["label"].to_numpy())
    for i in asks:
        forest.join(i, sets.linked(i, forest.label))
    least = forest.least(ids)
    return pa.table({"a": ids[least != ids], "b": least[least != ids]})
