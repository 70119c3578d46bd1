"""SentencePiece encoding and decoding in batched numpy.

A text becomes units that no piece crosses: a run of word marks with what follows it, split at characters that stand in
no longer piece. The distinct units of a batch are encoded once, those of equal length together as one matrix of code
points: prefix sums give the hash of every substring of every unit, one search in the sorted hashes of the pieces turns
them into scores, and then all units advance together.

 - Unigram models: Viterbi. For each end, the maximum over the starts of the score so far plus the piece's; the maxima
   are stored as backpointers.
 - BPE models: merges. In each round the best pair of each unit, leftmost among equals, becomes one piece. The best path
   by score is another segmentation than the one BPE defines, so a BPE model is never encoded by Viterbi.

The model file is read on the driver; what goes to the executors grows with the vocabulary alone (about 2 MB).
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from . import words
from .columns import own, packed, unpacked

MARK = "▁"
#: Fixed values of the model format: kinds of pieces and of models, and what an unknown character costs.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0
#: Code points of a matrix of units, units remembered by a worker (200 bytes each), and the length from which a unit is
#: encoded by itself.
MATRIX, REMEMBERED, LONG = 100_000, 200_000, 256
#: Text bytes whose units exist as Python strings at once: some 20 bytes for each.
TEXT_BYTES = 2 << 20
FLAG_BITS = 20
#: Base of the polynomial over the code points of a piece: pieces are far shorter than what such a sum can't tell apart.
BASE, NONE = int(words.FIRST.seed) | 1, np.float32(-np.inf)


@dataclass
class Vocabulary:
    kind: int
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    dummy_prefix: bool
    keys: np.ndarray = field(init=False, repr=False)

    def __post_init__(self) -> None:
        usable = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER_DEFINED)]
        inner = [self.pieces[i] for i in usable if MARK in self.pieces[i].lstrip(MARK)]
        if inner:
            raise ValueError(f"pieces with a word mark inside are not supported: {inner[:3]}")
        self.longest = max((len(self.pieces[i]) for i in usable), default=1)
        self.numbers = {self.pieces[i]: i for i in usable}
        hashes = words.mix(np.array([_hash(self.pieces[i]) for i in usable], np.uint64))
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], np.array(usable, np.int32)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        # One flag for each value of a hash's first bits: most substrings of no piece need no search.
        self.begun = np.zeros(1 << FLAG_BITS, bool)
        self.begun[self.keys >> np.uint64(64 - FLAG_BITS)] = True
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        self.bytes = [-1] * 256
        for i, k in enumerate(self.kinds):
            if k == BYTE:
                self.bytes[int(self.pieces[i][3:5], 16)] = i
        self.fallback = min(self.bytes) >= 0
        joined = sorted({c for i in usable if len(self.pieces[i]) > 1 for c in self.pieces[i]} - {MARK})
        chars = "".join(map(re.escape, joined))
        self.unit = re.compile(f"{MARK}*[{chars}]+|{MARK}+|." if chars else f"{MARK}+|.", re.S)
        self.raw = [self._raw(i) for i in range(len(self.pieces))]
        self.by_id = np.append(np.array(self.scores, np.float32), NONE)  # the last is that of no piece
        self.floor = np.float32(min((self.scores[i] for i in usable), default=0.0) - UNKNOWN_PENALTY)

    def _raw(self, i: int) -> bytes:
        if self.kinds[i] == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        if self.kinds[i] == CONTROL:
            return b""
        if self.kinds[i] == UNKNOWN:
            return " ⁇ ".encode()  # the library's surface of an unknown piece
        return self.pieces[i].replace(MARK, " ").encode()

    def as_unigram(self) -> Vocabulary:
        """The same pieces as a unigram model: a piece's log probability falls with the logarithm of its rank by score. It is
        a multiple of 1/64, so that sums are exact, and a path's score doesn't depend on what comes before it."""
        normal = sorted((i for i, k in enumerate(self.kinds) if k == NORMAL), key=lambda i: -self.scores[i])
        scores = list(self.scores)
        for rank, i in enumerate(normal):
            scores[i] = -float(int(np.log(2.0 + rank) * 64)) / 64
        return Vocabulary(UNIGRAM, self.pieces, scores, self.kinds, self.dummy_prefix)

    def normal(self, text: str) -> str:
        return (MARK if self.dummy_prefix and text else "") + text.replace(" ", MARK)

    def single(self, char: str) -> list[int]:
        """A character by itself."""
        if char in self.numbers:
            return [self.numbers[char]]
        return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")] if self.fallback else [self.unknown]


def _hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * BASE + ord(c) + 1) % (1 << 64)
    return h


def load(path: str) -> Vocabulary:
    """Reads a model file on the driver. Only models that leave text as it is (identity normaliser) are supported."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    with open(path, "rb") as file:
        data = file.read()
    model = proto.ModelProto()
    model.ParseFromString(data)
    norm = model.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only models with an identity normaliser that keep all white space are supported")
    if model.trainer_spec.model_type not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are supported")
    return Vocabulary(model.trainer_spec.model_type, [p.piece for p in model.pieces], [p.score for p in model.pieces], [p.type for p in model.pieces], norm.add_dummy_prefix)


class Encoder:
    """Encodes texts; remembers units between batches, up to a bound, as numbers into one flat array of ids.

    Several vocabularies of the same pieces share units and the search for substrings.
    """

    def __init__(self, vocabulary: Vocabulary, *others: Vocabulary):
        if any(o.pieces != vocabulary.pieces or o.kinds != vocabulary.kinds for o in others):
            raise ValueError("vocabularies that are encoded together must have the same pieces")
        self.v, self.all = vocabulary, (vocabulary, *others)
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.start, self.size = ([np.empty(0, t) for _ in self.all] for t in (np.int32, np.int64, np.int64))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and the bounds of each text's."""
        return self.encode_all(texts)[0]

    def encode_all(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The same for each vocabulary."""
        cut, normal = self.v.unit.findall, self.v.normal
        lists = [cut(normal(t)) if t else [] for t in texts]
        every = list(chain.from_iterable(lists))
        if len(self.number) > REMEMBERED:
            self._forget()
        self._learn(list(set(every) - self.number.keys()))
        at = np.fromiter(map(self.number.__getitem__, every), np.int64, len(every))
        ends = np.concatenate(([0], np.cumsum([len(units) for units in lists], dtype=np.int64)))
        out = []
        for flat, start, size in zip(self.flat, self.start, self.size, strict=True):
            n = size[at]
            before = np.concatenate(([0], np.cumsum(n)))
            out.append((flat[np.repeat(start[at] - before[:-1], n) + np.arange(before[-1])], before[ends]))
        return out

    def _learn(self, units: list[str]) -> None:
        """Encodes new units, those of equal length together."""
        parts: list[list[np.ndarray]] = [[f] for f in self.flat]
        sizes: list[list[np.ndarray]] = [[] for _ in self.all]
        order: list[str] = []
        by_length: dict[int, list[str]] = {}
        for u in units:
            by_length.setdefault(len(u), []).append(u)
        for length, same in by_length.items():
            step = max(1, MATRIX // length)
            for a in range(0, len(same), step):
                some = same[a : a + step]
                order += some
                if length > LONG:
                    for k, v in enumerate(self.all):
                        one = self._viterbi_one if v.kind == UNIGRAM else self._merge_one
                        ids = [self._ids(u, one(u, v)) for u in some]
                        parts[k] += ids
                        sizes[k].append(np.array([len(x) for x in ids]))
                    continue
                points = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(some), length)
                ids = self._substrings(points)
                for k, v in enumerate(self.all):
                    got, size = self._advance(v, some, ids)
                    parts[k].append(got)
                    sizes[k].append(size)
        if not order:
            return
        self.number.update(zip(order, range(len(self.size[0]), len(self.size[0]) + len(order)), strict=True))
        for k in range(len(self.all)):
            size = np.concatenate(sizes[k]).astype(np.int64)
            self.start[k] = np.concatenate([self.start[k], len(self.flat[k]) + np.cumsum(size) - size])
            self.size[k] = np.concatenate([self.size[k], size])
            self.flat[k] = np.concatenate(parts[k])

    def _advance(self, v: Vocabulary, some: list[str], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units of equal length, one after the other, and how many each has."""
        spans = (self._viterbi if v.kind == UNIGRAM else self._merge)(v, v.by_id[ids])
        unit, start = np.nonzero(spans)
        got = ids[unit, start, np.minimum(spans[unit, start], ids.shape[2] - 1)]
        size = np.bincount(unit, minlength=len(some))
        odd = np.unique(unit[got < 0])  # units with a character that is no piece
        if len(odd):
            lists = np.split(got, np.cumsum(size)[:-1])
            for k in odd.tolist():
                lists[k] = self._ids(some[k], [(x, int(spans[k, x])) for x in np.flatnonzero(spans[k]).tolist()])
            got, size = np.concatenate(lists), np.array([len(x) for x in lists])
        return got, size

    def _substrings(self, points: np.ndarray) -> np.ndarray:
        """(units, starts, lengths): the id of each substring of up to the longest piece's length, -1 if it is no piece."""
        n, length = points.shape
        wide = min(length, self.v.longest)
        ids = np.full((n, length, wide + 1), -1, np.int32)
        h = np.zeros((n, length), np.uint64)
        values = points.astype(np.uint64) + np.uint64(1)
        for k in range(1, wide + 1):
            h = h[:, : length - k + 1] * np.uint64(BASE) + values[:, k - 1 :]
            mixed = words.mix(h)
            unit, start = np.nonzero(self.v.begun[mixed >> np.uint64(64 - FLAG_BITS)])
            wanted = mixed[unit, start]
            at = np.minimum(np.searchsorted(self.v.keys, wanted), len(self.v.keys) - 1)
            hit = self.v.keys[at] == wanted
            unit, start, at = unit[hit], start[hit], at[hit]
            ids[unit, start, k] = self.v.ids[at]
        return ids

    def _viterbi(self, v: Vocabulary, score: np.ndarray) -> np.ndarray:
        n, length = score.shape[:2]
        alone = score[:, :, 1]
        score[:, :, 1] = np.where(alone == NONE, v.floor, alone)
        wide = score.shape[2] - 1
        best = np.full((n, length + 1), NONE, np.float32)
        best[:, 0] = 0
        back = np.zeros((n, length + 1), np.int64)
        for end in range(1, length + 1):
            starts = np.arange(max(0, end - wide), end)
            total = best[:, starts] + score[:, starts, end - starts]
            top = total.argmax(1)  # the longest piece among equals
            best[:, end], back[:, end] = total[np.arange(n), top], starts[top]
        sizes, end = np.zeros((n, length), np.int64), np.full(n, length)
        live = np.arange(n)
        while len(live):
            start = back[live, end[live]]
            sizes[live, start] = end[live] - start
            end[live] = start
            live = live[start > 0]
        return sizes

    def _viterbi_one(self, unit: str, v: Vocabulary) -> list[tuple[int, int]]:
        """The same for a unit of any length, in linear memory: the last few scores and a backpointer for each end."""
        numbers, scores, n = v.numbers, v.by_id, len(unit)
        best, back = [np.float32(0)], [0]
        for end in range(1, n + 1):
            top, from_ = NONE, end - 1
            for start in range(max(0, end - v.longest), end):
                i = numbers.get(unit[start:end])
                score = scores[i] if i is not None else v.floor if end - start == 1 else NONE
                total = best[start - end] + score  # best holds the longest piece's length of scores, the newest last
                if total > top:
                    top, from_ = total, start
            best.append(top)
            back.append(end - from_)
            if len(best) > v.longest:
                del best[0]
        out, end = [], n
        while end:
            out.append((end - back[end], back[end]))
            end -= back[end]
        return out[::-1]

    def _merge(self, v: Vocabulary, score: np.ndarray) -> np.ndarray:
        n, length = score.shape[:2]
        wide = score.shape[2] - 1
        sizes = np.ones((n, length), np.int64)
        live, place = np.arange(n), np.arange(length)
        while len(live) and length > 1:
            own_sizes = sizes[live]
            follow = place + own_sizes
            total = own_sizes + np.where(follow < length, np.take_along_axis(own_sizes, np.minimum(follow, length - 1), 1), wide + 1)
            legal = (own_sizes > 0) & (total <= wide)
            value = np.where(legal, score[live[:, None], place, np.where(legal, total, 0)], NONE)
            left = value.argmax(1)  # the leftmost among equals
            row = np.arange(len(live))
            go = value[row, left] > NONE
            live, left, row = live[go], left[go], row[go]
            sizes[live, left + own_sizes[row, left]] = 0
            sizes[live, left] = total[row, left]
        return sizes

    def _ids(self, unit: str, spans: list[tuple[int, int]]) -> np.ndarray:
        ids: list[int] = []
        for s, n in spans:
            found = self.v.numbers.get(unit[s : s + n])
            ids += [found] if found is not None else self.v.single(unit[s])
        return np.array(ids, np.int32)

    def _merge_one(self, unit: str, v: Vocabulary) -> list[tuple[int, int]]:
        """Merges in a unit of any length with a heap: linear memory, about n log n time."""
        n = len(unit)
        size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(p: int) -> None:
            if p >= 0 and after[p] < n:
                total = size[p] + size[after[p]]
                found = v.numbers.get(unit[p : p + total]) if total <= v.longest else None
                if found is not None:
                    heapq.heappush(heap, (-v.scores[found], p, size[p], total))

        for p in range(n - 1):
            offer(p)
        while heap:
            _, p, was, total = heapq.heappop(heap)
            if size[p] != was or after[p] >= n or size[p] + size[after[p]] != total:
                continue
            q = after[p]
            size[p], after[p], size[q] = total, after[q], 0
            if after[p] < n:
                before[after[p]] = p
            offer(before[p])
            offer(p)
        return [(p, k) for p, k in enumerate(size) if k]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Texts of id lists: pieces joined, word marks as spaces, without the space of the dummy prefix."""
        raw, out = self.v.raw, []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            text = b"".join([raw[i] for i in ids[a:b].tolist()]).decode("utf-8", "replace")
            out.append(text[1:] if self.v.dummy_prefix and text.startswith(" ") else text)
        return out


def _slices(batch: pa.RecordBatch, values: pa.Array, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about `most` bytes of a text column, or one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy())
    first = 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, side="right")))
        yield batch.slice(first, last - first)
        first = last


_last: list[Encoder] = []


def _remembering(vocabularies: tuple[Vocabulary, ...]) -> Encoder:
    """The worker's encoder from its task before, if that had the same vocabularies."""
    known = [(v.kind, v.scores, v.pieces) for v in vocabularies]
    if not _last or [(v.kind, v.scores, v.pieces) for v in _last[0].all] != known:
        _last[:] = [Encoder(*vocabularies)]
    return _last[0]


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None, beside: dict[str, Vocabulary] | None = None) -> DataFrame:
    """docs with one column more: the piece ids of each whole text, an array of int (empty for null and empty texts).

    With decoded_col, a second one: the text that decoding these ids gives, in the same pass. beside: other vocabularies
    of the same pieces by name, with columns name_ids and, if there is a decoded_col, name_decoded of theirs. Columns of
    these names are replaced, all others pass through; repeated rows give equal ids; an empty table stays empty.
    """
    every = {"": vocabulary} | {f"{n}_": v for n, v in (beside or {}).items()}
    shared = docs.sparkSession.sparkContext.broadcast(tuple(every.values()))  # as large as the vocabularies
    made = [c for n in every for c in ((f"{n}{ids_col}", f"{n}{decoded_col}") if decoded_col else (f"{n}{ids_col}",))]
    names = [c for c in docs.columns if c not in made]
    inner = docs.select(own(text_col).alias("text"), packed(names).alias("row"))
    schema = inner.select("row").schema
    for k in range(len(made)):
        schema = schema.add(f"made{k}", "string" if decoded_col and k % 2 else ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _remembering(shared.value)
        for b in batches:
            for part in _slices(b, b["text"], TEXT_BYTES):
                columns = []
                for ids, bounds in encoder.encode_all(part["text"].to_pylist()):
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())))
                    if decoded_col:
                        columns.append(pa.array(encoder.decode(ids, bounds), pa.string()))
                yield pa.RecordBatch.from_arrays([part["row"], *columns], names=["row", *(f"made{k}" for k in range(len(made)))])

    out = inner.mapInArrow(run, schema)
    return out.select(*unpacked("row", names), *[out[f"made{k}"].alias(c) for k, c in enumerate(made)])


def decode(rows: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """rows with one column more: the text of the ids. Null ids give null, an empty list the empty text; null and unknown
    numbers inside a list raise. A column of that name is replaced, all others pass through."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    names = [c for c in rows.columns if c != text_col]
    inner = rows.select(own(ids_col).alias("ids"), packed(names).alias("row"))
    schema = inner.select("row").schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for b in batches:
            lists = b["ids"]
            sizes = lists.value_lengths().fill_null(0).to_numpy()
            texts = encoder.decode(lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(sizes))))
            yield pa.RecordBatch.from_arrays([b["row"], pa.array(texts, pa.string(), mask=lists.is_null().to_numpy(zero_copy_only=False))], names=["row", "text"])

    out = inner.mapInArrow(run, schema)
    return out.select(*unpacked("row", names), out["text"].alias(text_col))
