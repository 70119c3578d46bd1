"""Whole Arrow string columns as words: byte positions and 64-bit hashes, without a Python loop over words.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; UTF-8 never uses those bytes inside a character.
The hash of a word mixes its bytes in order, eight at a time; that of a run of words mixes theirs by doubling.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Text bytes worked on at once; temporaries take some 20 bytes for each.
CHUNK = 1 << 19
#: Bytes of a word from which on a digest is taken of it.
LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Hash:
    """64-bit hashes of byte spans and of runs of them; another seed gives an independent function.

    Eight bytes at a time go through `mix` together with what came before, so that no algebra of the bytes or of their
    places survives, as it would in a polynomial. Words of up to eight bytes and of one length never collide.
    """

    def __init__(self, seed: int):
        self.seed = mix(np.array([seed], U))[0]
        self.key = int(self.seed).to_bytes(8, "little")

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        eights = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
        size = ends - starts
        with np.errstate(over="ignore"):
            out = mix(size.astype(U) * U(0xD6E8FEB86659FD93) + self.seed)
        todo, done = slice(None), 0
        while True:
            left = size[todo] - done
            block = eights[starts[todo] + done]
            block &= U(0xFFFFFFFFFFFFFFFF) >> (U(8) * (U(8) - np.minimum(left, 8).astype(U)))
            out[todo] = mix(out[todo] ^ block)
            done += 8
            todo = np.flatnonzero((size > done) & (size <= LONG))
            if not len(todo):
                break
        for i in np.flatnonzero(size > LONG):
            out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, key=self.key).digest(), "little")
        return out

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of two runs each as that of both, one after the other."""
        x = a * U(0x9E3779B97F4A7C15)
        x ^= x >> U(32)
        x += b
        x *= U(0xD6E8FEB86659FD93)
        x ^= x >> U(29)
        return x

    def windows(self, h: np.ndarray, width: int) -> np.ndarray:
        """The hash of each run of `width` word hashes, by doubling; len(h) - width + 1 values."""
        n = len(h) - width + 1
        if n <= 0:
            return np.empty(0, U)
        out, have, step, size = None, 0, h, 1
        while True:
            if width & size:
                part = step[have : have + n]
                out = part if out is None else self.join(out, part)
                have += size
            if size * 2 > width:
                return mix(out ^ self.seed)
            step, size = self.join(step[: len(step) - size], step[size:]), size * 2


FIRST, SECOND = Hash(1), Hash(2)


@dataclass
class Chunk:
    """Some texts of a column: rows first..last of it, their bytes, and their words in order."""

    first: int
    last: int
    data: np.ndarray
    bounds: np.ndarray  # of each text in data
    starts: np.ndarray  # of each word in data
    ends: np.ndarray
    text: np.ndarray  # number of each word's text, from 0
    counts: np.ndarray  # words of each text

    def hashes(self, kind: Hash = FIRST) -> np.ndarray:
        return kind.spans(self.data, self.starts, self.ends)

    def within(self, width: int) -> np.ndarray:
        """For each start of `width` words of the chunk, whether they lie in one text."""
        n = len(self.text) - width + 1
        return self.text[:n] == self.text[width - 1 :] if n > 0 else np.zeros(0, bool)

    def offsets(self) -> np.ndarray:
        """Number of each text's first word, and the number of words."""
        return np.concatenate(([0], np.cumsum(self.counts)))


def column(values: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 bounds of a string column; null is an empty text."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks() if values.num_chunks != 1 else values.chunk(0)
        if isinstance(values, pa.ChunkedArray):
            values = pa.concat_arrays(values.chunks) if values.num_chunks else pa.array([], pa.large_string())
    values = pc.fill_null(values.cast(pa.large_string()), "")
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    raw = values.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def chunks(values: pa.Array | pa.ChunkedArray, lower: bool = False, size: int = CHUNK) -> Iterator[Chunk]:
    """All texts of a column in order; a chunk has about `size` bytes, or one longer text."""
    data, bounds = column(values)
    first, n = 0, len(bounds) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + size, side="right")) - 1)
        last = min(last, n)
        own, at = data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        own = LOWER[own] if lower else own
        solid = ~SPACE[own]
        begin, end = solid.copy(), solid.copy()
        if len(own):
            begin[1:] &= ~solid[:-1]
            end[:-1] &= ~solid[1:]
            edge = at[1:-1]
            edge = edge[edge < len(own)]
            begin[edge] = solid[edge]
            edge = edge[edge > 0]
            end[edge - 1] = solid[edge - 1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        text = np.searchsorted(at, starts, side="right") - 1
        yield Chunk(first, last, own, at, starts, ends, text, np.bincount(text, minlength=last - first))
        first = last


def cover(starts: np.ndarray, width: int, size: int) -> np.ndarray:
    """Which of `size` places lie in a run of `width` places that begins at one of `starts`."""
    begun = np.concatenate(([0], np.cumsum(np.bincount(starts, minlength=size)[:size])))
    place = np.arange(size)
    return begun[place + 1] > begun[np.maximum(place + 1 - width, 0)]
