"""Substring dedup with difference-cover anchors.

Two equal runs of `window` words, one at word i of its document and one at word j of another or the same, share an
aligned anchor: D is a difference cover modulo `period`, so some shift s < period puts both i + s and j + s on positions
that are in D modulo the period, and the `window - period + 1` words from there on lie inside both runs. So only the
short windows at cover positions (5 of 21) are hashed and compared between documents; around an anchor that repeats, the
match is extended: just the full windows that hold such an anchor are compared, by a 128-bit hash.

Distribution. Documents are dealt into shards by a hash of id and text. A shard sends each of its distinct anchor hashes
once, sorted, as one binary value for each range of hash values (bucket); a bucket answers each shard with one bit a
hash: does another shard have it too? What repeats inside a shard the shard knows itself. As a hash leaves a shard once
however often it occurs, no bucket gets more than one copy of it from each shard, whatever passage is hot. The second
round does the same with the extended windows. With many buckets a shard sends to ranges of buckets, and groups of shards
merge their lists there before they go on to the buckets, so that rows of lists grow with the power of 1.5 of the input
and each stays long; answers come back the same way. A list of sorted distinct hashes is a function of the shard's content
alone, not of row order, so a lost task recomputes the same list and the bits still fit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .columns import own, packed

#: A perfect difference set, every difference modulo 21 occurs.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
#: Text bytes of a shard, and hashes of a bucket, on average.
SHARD_BYTES, BUCKET_HASHES = 8 << 20, 400_000
#: Bits of the bucket number from which on lists are merged on their way.
SPLIT_BITS = 10

SENT = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("hashes", T.BinaryType())])
REPLY = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("round", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("bits", T.BinaryType())])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, keep_layout: bool = False, shard_bytes: int = SHARD_BYTES, bucket_hashes: int = BUCKET_HASHES, split_bits: int = SPLIT_BITS) -> DataFrame:
    """Removes every word that lies in a run of `window` words which also starts anywhere else.

    Words are runs of anything but 0x20 and 0x09-0x0D, unchanged. All occurrences go, the first too; runs are judged on
    the input. Returns the input's rows and columns with text_col replaced by what is left, and n_words, n_removed
    (these replace columns of the same names). keep_layout=False joins the kept words by one space; True cuts removed
    words with the white space after them and leaves all other characters alone.

    Null text counts as empty and comes back as "". A null id is a document like any other. Repeated rows are separate
    documents, so texts of `window` or more words that occur twice vanish; rows equal in id and text share a shard.
    Shorter texts are never touched. Long texts are worked on whole; memory is bounded by some 20 bytes for each byte of a
    shard or of the longest text. An empty table gives an empty table.
    """
    if window < PERIOD + 1:
        raise ValueError(f"window must be {PERIOD + 1} words at least")
    total = docs.select(F.sum(F.octet_length(own(text_col)).cast("long"))).first()[0] or 0
    shards = max(1, math.ceil(total / shard_bytes))
    bits = max(0, math.ceil(math.log2(max(1, total / 5.5 * len(COVER) / PERIOD / bucket_hashes))))
    coarse, groups = (bits, 1) if bits <= split_bits else ((bits + 1) // 2, 1 << math.ceil(math.log2(shards)) // 2)
    rest = [c for c in docs.columns if c not in (text_col, "n_words", "n_removed")]
    dealt = docs.select(
        # A text too short for a window sends no list, so its place may be any: null and empty ones are dealt by place.
        F.pmod(F.when(F.octet_length(own(text_col)) >= 2 * window - 1, F.xxhash64(own(id_col), own(text_col))).otherwise(F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard"),
        own(text_col).alias("text"),
        packed(rest).alias("rest"),
    )
    texts = dealt.groupBy("shard")
    anchors = texts.applyInArrow(lambda key, t: _send(key, _Shard(t, window).anchors()[0], coarse, t.num_rows), SENT)
    first = _elsewhere(anchors, 1, coarse, bits - coarse, groups)

    def extended(key: tuple, t: pa.Table, replies: pa.Table) -> pa.Table:
        shard = _Shard(t, window)
        return _send(key, shard.extended(_bits(replies, 1, coarse, shard.anchors()[0]))[0], coarse, t.num_rows)

    second = _elsewhere(texts.cogroup(first.groupBy("shard")).applyInArrow(extended, SENT), 2, coarse, bits - coarse, groups)
    out = T.StructType([T.StructField("text", T.StringType()), T.StructField("rest", dealt.schema["rest"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def finish(key: tuple, t: pa.Table, replies: pa.Table) -> pa.Table:
        shard = _Shard(t, window)
        known, runs = shard.extended(_bits(replies, 1, coarse, shard.anchors()[0]))
        again = _bits(replies, 2, coarse, known)
        text, n, removed = shard.cut(runs[again[shard.at] | shard.twice[shard.at]] if len(runs) else runs, keep_layout)
        return pa.table({"text": text, "rest": t["rest"], "n_words": n, "n_removed": removed})

    done = texts.cogroup(first.union(second).groupBy("shard")).applyInArrow(finish, out)
    order = [F.col("rest").getField(c).alias(c) if c in rest else F.col("text").alias(c) for c in docs.columns if c not in ("n_words", "n_removed")]
    return done.select(*order, "n_words", "n_removed")


class _Shard:
    """The documents of one shard: their words, and what is asked about them."""

    def __init__(self, table: pa.Table, window: int):
        self.column, self.window, self.short = table["text"], window, window - PERIOD + 1
        self._anchors: tuple | None = None

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchor hashes, sorted, as (n, 1); the number of each anchor's hash in them; whether it occurs twice."""
        if self._anchors is None:
            found = [c[1][self._places(c[0])] for c in self._chunks()]
            known, at, n = np.unique(np.concatenate(found) if found else np.empty(0, np.uint64), return_inverse=True, return_counts=True)
            self._anchors = known[:, None], at, n > 1
        return self._anchors

    def _chunks(self) -> Iterator[tuple[words.Chunk, np.ndarray]]:
        for c in words.chunks(self.column):
            yield c, words.FIRST.windows(c.hashes(), self.short)

    def _places(self, c: words.Chunk) -> np.ndarray:
        """Starts of the anchors of a chunk: at cover positions of their text."""
        place = np.arange(max(0, len(c.text) - self.short + 1))
        covered = np.zeros(PERIOD, bool)
        covered[list(COVER)] = True
        return place[c.within(self.short) & covered[(place - c.offsets()[c.text[: len(place)]]) % PERIOD]]

    def extended(self, elsewhere: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct 128-bit hashes of the full windows around repeated anchors, sorted, as (n, 2), and the windows' starts.

        elsewhere: for each distinct anchor hash, whether another shard has it.
        """
        _, at, twice = self.anchors()
        repeated, seen, words_before = (elsewhere | twice)[at], 0, 0
        starts, hashes = [], []
        for c in words.chunks(self.column):
            place = self._places(c)
            hit = place[repeated[seen : seen + len(place)]]
            seen += len(place)
            inside = c.within(self.window)
            if len(hit) and len(inside):
                before = np.concatenate(([0], np.cumsum(np.bincount(hit, minlength=len(c.text)))))
                start = np.arange(len(inside))
                kept = np.flatnonzero(inside & (before[np.minimum(start + PERIOD, len(c.text))] > before[start]))
                starts.append(kept + words_before)
                hashes.append(np.stack([kind.windows(c.hashes(kind), self.window)[kept] for kind in (words.FIRST, words.SECOND)], 1))
            words_before += len(c.text)
        runs = np.concatenate(starts) if starts else np.empty(0, np.int64)
        every = np.concatenate(hashes) if hashes else np.empty((0, 2), np.uint64)
        order = np.lexsort((every[:, 1], every[:, 0]))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (every[order][1:] != every[order][:-1]).any(1)
        self.at = np.empty(len(order), np.int64)
        self.at[order] = np.cumsum(fresh) - 1
        self.twice = np.bincount(self.at, minlength=int(fresh.sum())) > 1
        return every[order][fresh], runs

    def cut(self, runs: np.ndarray, keep_layout: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The texts without the words of the windows that begin at `runs`; words and removed words of each."""
        parts, n, removed, before = [], [], [], 0
        for c in words.chunks(self.column):
            size = len(c.text)
            own = runs[np.searchsorted(runs, before) : np.searchsorted(runs, before + size)] - before
            gone = words.cover(own, self.window, size)
            before += size
            edge = np.zeros(len(c.data) + 1, np.int8)
            if keep_layout:
                stop = c.bounds[c.text + 1]
                stop[:-1] = np.where(c.text[1:] == c.text[:-1], c.starts[1:], stop[:-1])
                edge[0] = 1
                np.add.at(edge, c.starts[gone], -1)
                np.add.at(edge, stop[gone], 1)
                data = c.data
            else:
                kept = np.flatnonzero(~gone)
                between = kept[:-1][c.text[kept[1:]] == c.text[kept[:-1]]]
                edge[c.starts[kept]] += 1
                edge[c.ends[kept]] -= 1
                data = c.data.copy()
                data[c.ends[between]] = 0x20
            stay = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
            if not keep_layout:
                stay[c.ends[between]] = True
            lengths = np.concatenate(([0], np.cumsum(stay)))[c.bounds].astype(np.int64)
            parts.append(pa.LargeStringArray.from_buffers(len(c.counts), pa.py_buffer(lengths.tobytes()), pa.py_buffer(data[stay].tobytes())))
            n.append(c.counts)
            removed.append(np.bincount(c.text[gone], minlength=len(c.counts)))
        text = pa.chunked_array(parts, pa.large_string()).combine_chunks().cast(pa.string()) if parts else pa.array([], pa.string())
        return text, np.concatenate([np.empty(0, np.int64), *n]).astype(np.int64), np.concatenate([np.empty(0, np.int64), *removed]).astype(np.int64)


def _edges(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket begins in sorted hashes, and the end."""
    tops = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.empty(0, np.uint64)
    return np.concatenate(([0], np.searchsorted(hashes[:, 0], tops), [len(hashes)]))


def _send(key: tuple, hashes: np.ndarray, bits: int, rows: int) -> pa.Table:
    edge = _edges(hashes, bits)
    own = np.flatnonzero(np.diff(edge))
    shard = key[0].as_py() if rows else None
    return pa.table({"bucket": pa.array(own, pa.int32()), "shard": pa.array([shard] * len(own), pa.int32()), "hashes": pa.array([hashes[edge[b] : edge[b + 1]].tobytes() for b in own], pa.binary())})


def _elsewhere(sent: DataFrame, number: int, coarse: int, fine: int, groups: int) -> DataFrame:
    """What the buckets answer each list of `number` values a hash: REPLY, by shard and the `coarse` bits of the bucket."""
    if not fine:
        return sent.groupBy("bucket").applyInArrow(lambda key, t: _answer(t, number), REPLY)
    dealt = sent.withColumn("grp", F.pmod("shard", F.lit(groups))).groupBy("bucket", "grp")
    merged = dealt.applyInArrow(lambda key, t: _merge(key, t, number, coarse, fine, groups), SENT)
    replies = merged.groupBy("bucket").applyInArrow(lambda key, t: _answer(t, number), REPLY)
    back = replies.select(F.expr(f"shard div {groups}").cast("int").alias("to"), F.pmod("shard", F.lit(groups)).alias("grp"), F.col("bucket").alias("fine"), "bits")
    return dealt.cogroup(back.withColumnRenamed("to", "bucket").groupBy("bucket", "grp")).applyInArrow(lambda key, t, r: _pass_on(key, t, r, number, coarse, fine), REPLY)


def _lists(sent: pa.Table, number: int) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64).reshape(-1, number) for x in sent["hashes"].combine_chunks()]


def _union(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of several lists, sorted; the number of each list's entries in them; in how many lists each is."""
    every = np.concatenate(lists)
    order = np.argsort(every[:, 0], kind="stable")
    if every.shape[1] == 2 and (np.diff(every[order, 0]) == 0).any():
        order = np.lexsort((every[:, 1], every[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (every[order][1:] != every[order][:-1]).any(1)
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(new) - 1
    return every[order][new], at, np.bincount(at)


def _within(known: np.ndarray, bucket: int, coarse: int, fine: int) -> np.ndarray:
    """Where each of the buckets that share their coarse bits begins in sorted hashes, and the end."""
    tops = [((bucket << fine) + f) << (64 - coarse - fine) for f in range(1, 1 << fine)]
    return np.concatenate(([0], np.searchsorted(known[:, 0], np.array(tops, np.uint64)), [len(known)]))


def _merge(key: tuple, sent: pa.Table, number: int, coarse: int, fine: int, groups: int) -> pa.Table:
    """The lists of a group of shards as one, sent on to the buckets."""
    bucket, group = (k.as_py() for k in key)
    known = _union(_lists(sent, number))[0]
    edge = _within(known, bucket, coarse, fine)
    own = np.flatnonzero(np.diff(edge))
    return pa.table({"bucket": pa.array((bucket << fine) + own, pa.int32()), "shard": pa.array([bucket * groups + group] * len(own), pa.int32()), "hashes": pa.array([known[edge[f] : edge[f + 1]].tobytes() for f in own], pa.binary())})


def _pass_on(key: tuple, sent: pa.Table, replies: pa.Table, number: int, coarse: int, fine: int) -> pa.Table:
    """Answers to the lists of a group: another group has a hash, or another list of this one."""
    if not sent.num_rows:
        return pa.schema([("shard", pa.int32()), ("round", pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary())]).empty_table()
    bucket, lists = key[0].as_py(), _lists(sent, number)
    known, at, n = _union(lists)
    edge, again = _within(known, bucket, coarse, fine), n > 1
    for place, packed in zip(replies["fine"].to_pylist(), replies["bits"].to_pylist(), strict=True):
        a, b = edge[place - (bucket << fine)], edge[place - (bucket << fine) + 1]
        again[a:b] |= np.unpackbits(np.frombuffer(packed, np.uint8), count=b - a).astype(bool)
    return _replies(sent, number, lists, again[at])


def _answer(sent: pa.Table, number: int) -> pa.Table:
    """For each list of hashes, a bit each: whether another list of the bucket has it. number: 1 or 2 values a hash."""
    lists = _lists(sent, number)
    _, at, n = _union(lists)
    return _replies(sent, number, lists, (n > 1)[at])


def _replies(sent: pa.Table, number: int, lists: list[np.ndarray], again: np.ndarray) -> pa.Table:
    edge = np.cumsum([0, *map(len, lists)])
    bits = pa.array([np.packbits(again[a:b]).tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())
    return pa.table({"shard": sent["shard"], "round": pa.array([number] * len(lists), pa.int32()), "bucket": sent["bucket"], "bits": bits})


def _bits(replies: pa.Table, number: int, bits: int, hashes: np.ndarray) -> np.ndarray:
    """What the buckets answered, as one flag for each of the shard's sorted hashes."""
    edge, out = _edges(hashes, bits), np.zeros(len(hashes), bool)
    for kind, bucket, packed in zip(replies["round"].to_pylist(), replies["bucket"].to_pylist(), replies["bits"].to_pylist(), strict=True):
        if kind == number:
            a, b = edge[bucket], edge[bucket + 1]
            out[a:b] = np.unpackbits(np.frombuffer(packed, np.uint8), count=b - a)
    return out
