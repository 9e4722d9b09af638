"""Vectorised text work inside tasks: chunks of whole texts, word and line bounds, hashes and equality of spans.

A span's hash takes in its bytes eight at a time through a mixing bijection, from ``SEED``; a span beyond ``LONG`` bytes goes through
keyed BLAKE2. No sum or polynomial is involved, so strings that collide for every base of a polynomial don't collide here.
Hashes have 64 bits; an operator that can see both strings compares their bytes as well (``same``), the others say so.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of text that are worked on together; a longer text is a chunk of its own.
CHUNK = 1 << 18

#: Bytes that part words: space and the controls \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def checkpoint_dir(spark: SparkSession) -> None:
    """Makes sure that DataFrame.checkpoint has a folder: the cluster's, or in local mode one of our own.

    Raises on a cluster that names none, since executors couldn't share a folder of the driver's machine.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(folder)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows and their n+1 offsets; null counts as empty."""
    binary = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = binary.buffers()
    offs = np.frombuffer(offsets, np.int64)[binary.offset : binary.offset + len(binary) + 1] if len(binary) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offs


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of consecutive rows of at most ``limit`` bytes, or one row."""
    data, offs = strings(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


#: Spans up to this many bytes are hashed together, longer ones one by one.
LONG = 64
SEED = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def sums(flags: np.ndarray, dtype=np.int64) -> np.ndarray:
    """Running sums with a leading 0."""
    out = np.zeros(len(flags) + 1, dtype)
    np.cumsum(flags, out=out[1:], dtype=dtype)
    return out


class Spans:
    """Hashes and equality of any spans of one buffer."""

    def __init__(self, buf: np.ndarray, seed: int = SEED):
        self.seed = seed
        self.bytes = np.concatenate([buf, np.zeros(8, np.uint8)])
        self.eight = np.ndarray((len(buf) + 1,), "<u8", self.bytes.data, 0, (1,))

    def _part(self, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The next eight bytes from each place, or the ``left`` that remain, as a number."""
        cut = (np.maximum(0, 8 - left) * 8).astype(np.uint64)
        return (self.eight[at] << cut) >> cut

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        out = mix(size.astype(np.uint64) + np.uint64(self.seed))
        rows = np.flatnonzero((size > 0) & (size <= LONG))
        for done in range(0, LONG, 8):
            rows = rows[size[rows] > done]
            if not len(rows):
                break
            out[rows] = mix(out[rows] ^ self._part(starts[rows] + done, size[rows] - done))
        key = self.seed.to_bytes(8, "little")
        raw = self.bytes.data
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = int.from_bytes(blake2b(raw[starts[i] : ends[i]], digest_size=8, key=key).digest(), "little")
        return out

    def same(self, starts: np.ndarray, other: np.ndarray, size: np.ndarray, among: Spans | None = None) -> np.ndarray:
        """Whether the ``size`` bytes from each of ``starts`` are those from ``other`` (of ``among``, by default this buffer)."""
        among = among or self
        out = np.ones(len(size), bool)
        raw, theirs = self.bytes.data, among.bytes.data
        rows = np.flatnonzero((size <= LONG) & ((starts != other) | (among is not self)))
        for done in range(0, LONG, 8):
            rows = rows[size[rows] > done]
            if not len(rows):
                break
            left = size[rows] - done
            out[rows] &= self._part(starts[rows] + done, left) == among._part(other[rows] + done, left)
        for i in np.flatnonzero((size > LONG) & ((starts != other) | (among is not self))).tolist():
            out[i] = raw[starts[i] : starts[i] + size[i]] == theirs[other[i] : other[i] + size[i]]
        return out

    def numbers(self, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, int]:
        """A number for each span, from 0: equal if and only if the owner and the bytes are; and how many there are."""
        if not len(starts):
            return np.zeros(0, np.int64), 0
        keys = mix(self.hash(starts, ends) + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        _, first, number = np.unique(keys, return_index=True, return_inverse=True)
        size, like = ends - starts, first[number]
        if (owner == owner[like]).all() and (size == size[like]).all() and self.same(starts, starts[like], size).all():
            return number, len(first)
        known: dict[tuple[int, bytes], int] = {}
        raw = self.bytes.tobytes()
        listed = [known.setdefault((o, raw[a:b]), len(known)) for o, a, b in zip(owner.tolist(), starts.tolist(), ends.tolist(), strict=True)]
        return np.array(listed, np.int64), len(known)


def word_bounds(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside`` that don't cross a text's end, and each text's first word (n+1)."""
    n = len(inside)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[offs[:-1][offs[:-1] < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[offs[1:][offs[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offs)


def line_bounds(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""Starts, ends and text numbers of the \n-split lines."""
    breaks = np.flatnonzero(buf == 10)
    starts = np.sort(np.concatenate([offs[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([breaks, offs[1:]]))
    return starts, ends, np.repeat(np.arange(len(offs) - 1), np.diff(np.searchsorted(breaks, offs)) + 1)


def owners(firsts: np.ndarray) -> np.ndarray:
    """The text number of each word, from each text's first word."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive word hashes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out *= np.uint64(0xA24BAED4963EE407)
        out += h[k : len(h) - n + 1 + k]
    return mix(out)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(twice, keys)
    return twice[np.minimum(at, len(twice) - 1)] == keys


def ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The integers of all half-open ranges, one after another."""
    bounds = sums(hi - lo)
    return np.repeat(lo - bounds[:-1], hi - lo) + np.arange(bounds[-1])


def gather(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenation of the slices ``offsets[r]:offsets[r+1]`` of ``values`` for each of ``rows``, and n+1 bounds."""
    starts = offsets[rows]
    bounds = sums(offsets[rows + 1] - starts)
    return values[np.repeat(starts - bounds[:-1], np.diff(bounds)) + np.arange(bounds[-1])], bounds


def binary_rows(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A large binary array of the slices of ``data`` (bytes)."""
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
