"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths (capacities) are permitted at once. Pieces go by falling length, each into the open bin that it
fills best; if it fits into none, a bin is opened. Which size is opened is optimised jointly: every policy "open the size
of least cost for each unit, among those from c down that still hold the piece" is tried for each permitted c, at the end
every bin is downsized to the least permitted capacity that holds its contents, and the policy of least total cost wins.

Best fit needs one place that sees open bins, not one place that sees all rows. Pieces are dealt evenly, whatever their
ids, sources or lengths are, into shards of some ten thousand, and each shard is packed by itself: what a shard
wastes more than one packing of everything is a part of its last few bins. Only ids and lengths are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .columns import own

CAPACITIES = (512, 1024, 2048, 4096)
#: Pieces of a shard, on average: the packer's state is a few dozen bytes for each.
SHARD_PIECES = 16_000
#: Text bytes of a shard, on average, where the texts go along.
SHARD_BYTES = 16 << 20


class _Open:
    """Open bins by free space; the tightest that takes a piece is found with one bit operation."""

    def __init__(self) -> None:
        self.stacks: dict[int, list[int]] = {}
        self.mask = 0

    def push(self, free: int, number: int) -> None:
        self.stacks.setdefault(free, []).append(number)
        self.mask |= 1 << free

    def pop(self, length: int) -> tuple[int, int] | None:
        above = self.mask >> length
        if not above:
            return None
        free = length + (above & -above).bit_length() - 1
        stack = self.stacks[free]
        number = stack.pop()
        if not stack:
            self.mask &= ~(1 << free)
        return free, number


def pack(lengths: Sequence[int], costs: Mapping[int, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each piece, capacity of each bin, used units of each bin). No length may be over the largest capacity.

    costs: cost of a bin of each permitted capacity. Ties go to the larger size when opening and to the policy with the
    larger first size. Pieces of length 0 go into bins like any others. Equal inputs give equal outputs.
    """
    sizes = sorted(costs)
    lengths = np.asarray(lengths, np.int64)
    order = np.argsort(-lengths, kind="stable")
    best, least = None, math.inf
    for top in reversed(sizes):
        place, used = _best_fit(lengths, order, [c for c in sizes if c <= top], sizes, costs)
        fitted = np.array(sizes)[np.searchsorted(sizes, used)] if len(used) else np.empty(0, np.int64)
        total = float(sum(costs[int(c)] for c in fitted))
        if total < least:
            best, least = (place, fitted, used), total
    return best if best is not None else (np.empty(0, np.int64),) * 3


def _best_fit(lengths: np.ndarray, order: np.ndarray, offered: list[int], sizes: list[int], costs: Mapping[int, float]) -> tuple[np.ndarray, np.ndarray]:
    """One policy: open the offered size of least cost for each unit that holds the piece, else the least size that does."""
    ranked = sorted(offered, key=lambda c: (costs[c] / c, -c))
    place, capacity, used, free_bins = np.empty(len(lengths), np.int64), [], [], _Open()
    for i in order.tolist():
        length = int(lengths[i])
        found = free_bins.pop(length)
        if found is None:
            size = next((c for c in ranked if c >= length), None) or next(c for c in sizes if c >= length)
            found = size, len(capacity)
            capacity.append(size)
            used.append(0)
        free, number = found
        place[i] = number
        used[number] += length
        free_bins.push(free - length, number)
    return place, np.array(used, np.int64)


def pieces(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(id, piece, start, length[, text]): each document as one piece, or as several of the largest capacity and a rest.

    Units are words, runs of anything but 0x20 and 0x09-0x0D. A document without words (null, empty, white space) is one
    piece of length 0, so that it isn't lost. The text of a piece is the document's, from its first to its last word.
    """
    top = max(capacities)
    base = docs.select(own(id_col).alias("id"), own(text_col).alias("text"))
    fields = [T.StructField("id", base.schema["id"].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.IntegerType())]
    schema = T.StructType([*fields, T.StructField("text", T.StringType())] if with_text else fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in words.chunks(pa.chunked_array([batch["text"]])):
                n = np.maximum(1, -(-c.counts // top))
                doc = np.repeat(np.arange(len(n)), n)
                number = np.arange(len(doc)) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
                length = np.minimum(c.counts[doc] - number * top, top)
                columns = [batch["id"].slice(c.first, c.last - c.first).take(pa.array(doc)), pa.array(number, pa.int32()), pa.array(number * top, pa.int64()), pa.array(length, pa.int32())]
                if with_text:
                    first = c.offsets()[doc] + number * top
                    spans = [(c.starts[f], c.ends[f + k - 1]) if k else (0, 0) for f, k in zip(first, length, strict=True)]
                    columns.append(pa.array([c.data[a:b].tobytes().decode("utf-8", "replace") for a, b in spans], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return base.mapInArrow(cut, schema)


def best_fit_packing(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, costs: Mapping[int, float] | None = None, id_col: str = "doc_id", text_col: str = "text", shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row for each piece of each document: (id_col, piece int, start long, length int, bin_id string, capacity int,
    used int, position int, offset int). A bin's pieces have positions from 0 and begin at unit `offset` of the sequence.

    costs: what a sequence of each capacity costs; by default its capacity, so that padding is what is minimised.
    Every row of docs is packed: repeated rows twice, documents without words as pieces of length 0, documents over the
    largest capacity as several pieces. A null id stays null. An empty table gives an empty table; other columns of docs
    are not read.
    """
    costs = {int(c): float(costs[c]) if costs else float(c) for c in capacities}
    if not costs or min(costs) < 1 or min(costs.values()) <= 0:
        raise ValueError("capacities and costs must be positive")
    found = pieces(docs, sorted(costs), id_col, text_col)
    shards = max(1, math.ceil(docs.count() / shard_pieces))
    schema = T.StructType([*found.schema.fields, T.StructField("bin_id", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("capacity", "used", "position", "offset")]])
    packed = found.repartition(shards).mapInArrow(lambda batches: _pack_shard(batches, costs), schema)
    return packed.withColumnRenamed("id", id_col)


def packed_sequences(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, costs: Mapping[int, float] | None = None, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, separator: str = "\n\n") -> DataFrame:
    """The sequences themselves: (bin_id, capacity, used, doc_ids, pieces, starts, lengths, text), the texts of a bin's
    pieces joined by `separator`. One row a bin; arrays run in the order of the pieces. Otherwise as best_fit_packing.
    """
    costs = {int(c): float(costs[c]) if costs else float(c) for c in capacities}
    found = pieces(docs, sorted(costs), id_col, text_col, with_text=True)
    shards = max(1, math.ceil((docs.select(F.sum(F.octet_length(own(text_col)).cast("long"))).first()[0] or 0) / shard_bytes))
    kind = found.schema["id"].dataType
    schema = T.StructType([T.StructField("bin_id", T.StringType()), T.StructField("capacity", T.IntegerType()), T.StructField("used", T.IntegerType()), T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("pieces", T.ArrayType(T.IntegerType())), T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("lengths", T.ArrayType(T.IntegerType())), T.StructField("text", T.StringType())])

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pack_shard(batches, costs):
            t = pa.Table.from_batches([batch])
            edge = np.flatnonzero(np.append(t["position"].to_numpy() == 0, True))
            texts = t["text"].to_pylist()
            lists = [pa.ListArray.from_arrays(pa.array(edge, pa.int32()), t[c].combine_chunks()) for c in ("id", "piece", "start", "length")]
            joined = pa.array([separator.join(x for x in texts[a:b] if x) for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.string())
            heads = t.take(pa.array(edge[:-1]))
            yield pa.RecordBatch.from_arrays([*(heads[c].combine_chunks() for c in ("bin_id", "capacity", "used")), *lists, joined], names=schema.names)

    return found.repartition(shards).mapInArrow(bins, schema)


def _pack_shard(batches: Iterator[pa.RecordBatch], costs: Mapping[int, float]) -> Iterator[pa.RecordBatch]:
    """Packs all pieces of a partition; yields them bin by bin, some bins at a time, with the columns of the placement."""
    from pyspark import TaskContext

    got = list(batches)
    if not sum(b.num_rows for b in got):
        return
    table, shard = pa.Table.from_batches(got), TaskContext.get().partitionId()
    del got
    # The order in which rows arrive may differ when a task runs again; the packing may not.
    keys = [c for c in ("id", "piece", "length", "text") if c in table.column_names]
    table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in keys]))
    place, capacity, used = pack(table["length"].to_numpy(), costs)
    length = table["length"].to_numpy()
    order = np.lexsort([-length, place])
    bins, fresh = place[order], np.ones(len(place), bool)
    fresh[1:] = bins[1:] != bins[:-1]
    begin = np.flatnonzero(fresh)
    position = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    before = np.concatenate(([0], np.cumsum(length[order])[:-1]))
    offset = before - np.repeat(before[begin], np.diff(np.append(begin, len(order))))
    names = np.array([f"{shard}-{b}" for b in range(len(capacity))], object)
    for a in range(0, len(begin), 512):
        rows = slice(begin[a], begin[a + 512] if a + 512 < len(begin) else len(order))
        part, own_bins = table.take(pa.array(order[rows])), bins[rows]
        for name, values in (("bin_id", pa.array(names[own_bins], pa.string())), ("capacity", capacity[own_bins]), ("used", used[own_bins]), ("position", position[rows]), ("offset", offset[rows])):
            part = part.append_column(name, values if name == "bin_id" else pa.array(values, pa.int32()))
        yield from part.combine_chunks().to_batches()
