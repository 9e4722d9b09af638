r"""Benchmark decontamination by an FM-index per training shard.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the text with A-Z lower-cased. A test phrase is a window of ``WINDOW``
consecutive words of a benchmark item, or the whole item if it has fewer. A training shard is a run of whole documents
of about ``SHARD`` bytes. Its words are coded by the phrases' vocabulary; a word outside it cannot be in an occurrence,
so it parts the sequence, and stretches shorter than the shortest phrase are left out of the index. Over what remains stands a
suffix array, its Burrows-Wheeler transform as a wavelet matrix, and every ``SAMPLE``-th suffix position. All phrases
are searched backward at once, their occurrences are located by walking to a sampled position, and the covered words
are merged to spans.

Documents pass once, without a shuffle. The benchmark's vocabulary and its phrases go to the tasks as broadcast variables, the phrases
in blocks of about ``BLOCK`` bytes of text; a long item is cut into pieces that overlap by one word less than a window, so every block has
a bound. A task holds some ``HELD`` bytes of shards, builds each one's index once and takes the blocks through them in turn.

Words meet by 64-bit hashes under a seed that keeps the vocabulary's own apart, and equal hashes are compared by their bytes. Defined
cases: null or empty texts have no words and aren't contaminated; items without words have no phrase; rows that repeat an item id count
as one item; an item without an id marks words but isn't listed; repeated documents are judged each; empty tables give no rows or no
hits; an input column named as an output is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadtrace.llm import textkit as tk
from roadtrace.llm.suffixes import suffix_array

WINDOW = 13
SHARD = 2 << 20
BLOCK = 1 << 20
SAMPLE = 8
#: Bytes of text that a task searches together.
HELD = 8 << 20
#: Words of a piece of an item.
PIECE = 20_000
#: Blocks that a worker keeps.
KEPT = 16
_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def words_of(buf: np.ndarray, offs: np.ndarray, seed: int) -> tuple[tk.Spans, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased buffer, start and end of each word, and each text's first word."""
    starts, ends, firsts = tk.word_bounds(_WORD[buf], offs)
    return tk.Spans(_LOWER[buf], seed), starts, ends, firsts


class Vocabulary:
    """The words of all phrases in the order of their hashes, which the seed keeps apart."""

    def __init__(self, words: set[bytes]):
        listed = sorted(words)
        bounds = tk.sums(np.fromiter(map(len, listed), np.int64, len(listed)))
        data = np.frombuffer(b"".join(listed), np.uint8)
        self.seed = tk.SEED
        while True:
            hashes = tk.Spans(data, self.seed).hash(bounds[:-1], bounds[1:])
            order = np.argsort(hashes)
            self.hashes = hashes[order]
            if (self.hashes[1:] != self.hashes[:-1]).all():
                break
            self.seed += 1
        self.starts, self.size, self.data = bounds[:-1][order], np.diff(bounds)[order], data

    def find(self, spans: tk.Spans, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Each word's number, or -1."""
        if not len(self.hashes):
            return np.full(len(starts), -1)
        hashes = spans.hash(starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        met = np.flatnonzero((self.hashes[at] == hashes) & (self.size[at] == ends - starts))
        met = met[spans.same(starts[met], self.starts[at[met]], self.size[at[met]], tk.Spans(self.data, self.seed))]
        out = np.full(len(starts), -1)
        out[met] = at[met]
        return out


@dataclass(frozen=True)
class Phrases:
    """Distinct windows by length, in numbers of the vocabulary; for each, bounds and rows of its items; the rows' ids."""

    windows: list[np.ndarray]
    bounds: list[np.ndarray]
    rows: list[np.ndarray]
    ids: list[str | None]


def phrases(rows: list[tuple[str | None, str | None]], vocabulary: Vocabulary, window: int = WINDOW) -> Phrases:
    """Of (item id, text) rows, whose words are all in the vocabulary."""
    spans, starts, ends, firsts = words_of(*tk.strings(pa.array([t for _, t in rows], pa.string())), vocabulary.seed)
    codes = vocabulary.find(spans, starts, ends)
    counts = np.diff(firsts)
    sizes = np.minimum(counts, window)
    windows, bounds, owners = [], [], []
    for n in np.unique(sizes[sizes > 0]).tolist():
        own = np.flatnonzero(sizes == n)
        at = tk.ranges(firsts[own], firsts[own + 1] - n + 1)
        distinct, number = np.unique(codes[at[:, None] + np.arange(n)].astype(np.int32), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([number.reshape(-1), np.repeat(own, counts[own] - n + 1)]), axis=1)
        windows.append(distinct)
        bounds.append(tk.sums(np.bincount(pairs[0], minlength=len(distinct))))
        owners.append(pairs[1])
    return Phrases(windows, bounds, owners, [i for i, _ in rows])


class FMIndex:
    """Count and locate over a sequence of codes 1..sigma-1 that ends in a single 0."""

    def __init__(self, seq: np.ndarray, sample: int = SAMPLE):
        order, _ = suffix_array(seq)
        last = seq[order - 1]
        sigma = int(seq.max()) + 1
        self.first = tk.sums(np.bincount(seq, minlength=sigma))
        self.levels: list[tuple[int, int, np.ndarray]] = []
        for level in reversed(range(max(1, (sigma - 1).bit_length()))):
            bit = (last >> level) & 1 == 1
            self.levels.append((level, int((~bit).sum()), tk.sums(bit)))
            last = np.concatenate([last[~bit], last[bit]])
        marked = order % sample == 0
        self.marks, self.positions = tk.sums(marked), order[marked]
        self.is_marked = marked

    def step(self, code: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Rows of suffixes that begin with ``code``, counting those before ``row`` that it precedes."""
        low = np.zeros_like(row)
        for level, zeros, ones in self.levels:
            up = (code >> level) & 1 == 1
            row = np.where(up, zeros + ones[row], row - ones[row])
            low = np.where(up, zeros + ones[low], low - ones[low])
        return self.first[code] + row - low

    def code(self, row: np.ndarray) -> np.ndarray:
        """The code before the suffix at each row."""
        out = np.zeros_like(row)
        for level, zeros, ones in self.levels:
            up = ones[row + 1] > ones[row]
            out |= up.astype(np.int64) << level
            row = np.where(up, zeros + ones[row], row - ones[row])
        return out

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row, and row after the last, of each pattern (patterns of one length)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.first[-1])
        live = np.arange(len(patterns))
        for column in reversed(range(patterns.shape[1])):
            code = patterns[live, column]
            lo[live], hi[live] = self.step(code, lo[live]), self.step(code, hi[live])
            live = live[lo[live] < hi[live]]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Sequence positions of rows."""
        out, walked, where = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        while len(where):
            done = self.is_marked[rows]
            out[where[done]] = self.positions[self.marks[rows[done]]] + walked
            where, rows, walked = where[~done], rows[~done], walked + 1
            rows = self.step(self.code(rows), rows)
        return out


class Shard:
    """A run of whole documents with its index, and what the blocks searched so far have hit."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, vocabulary: Vocabulary, shortest: int):
        self.buf, self.offs = buf, offs
        spans, self.starts, self.ends, self.firsts = words_of(buf, offs, vocabulary.seed)
        number = vocabulary.find(spans, self.starts, self.ends)
        known = number >= 0
        self.change = np.zeros(len(known) + 1, np.int64)
        self.found: dict[int, set[str]] = {}
        self.index: FMIndex | None = None
        # Stretches of known words within one text, at least as long as the shortest phrase.
        edge = np.zeros(len(known) + 1, bool)
        edge[self.firsts] = True
        begins = np.flatnonzero(known & (edge[:-1] | ~np.concatenate([[False], known])[:-1]))
        ends = np.flatnonzero(known & (edge[1:] | ~np.concatenate([known, [False]])[1:])) + 1
        long = ends - begins >= shortest
        begins, ends = begins[long], ends[long]
        if not len(begins):
            return
        # Each stretch, a divider after it, and the end mark; words keep their place in the shard.
        where = tk.ranges(begins, ends)
        lengths = ends - begins
        places = np.arange(len(where)) + np.repeat(np.arange(len(lengths)), lengths)
        used, codes = np.unique(number[where], return_inverse=True)
        seq = np.ones(len(where) + len(lengths) + 1, np.int64)
        seq[places] = codes + 2
        seq[-1] = 0
        self.word_of = np.full(len(seq), -1)
        self.word_of[places] = where
        self.index = FMIndex(seq)
        self.coded = np.full(len(vocabulary.hashes), -1)
        self.coded[used] = np.arange(len(used)) + 2

    def search(self, tests: Phrases) -> None:
        """Marks the occurrences of a block's phrases."""
        if self.index is None:
            return
        for windows, bounds, rows in zip(tests.windows, tests.bounds, tests.rows, strict=True):
            patterns = self.coded[windows]
            some = np.flatnonzero((patterns >= 0).all(axis=1))
            lo, hi = self.index.search(patterns[some])
            word, phrase = self.word_of[self.index.locate(tk.ranges(lo, hi))], np.repeat(some, hi - lo)
            np.add.at(self.change, word, 1)
            np.add.at(self.change, word + windows.shape[1], -1)
            pairs = np.unique(np.stack([np.searchsorted(self.firsts, word, "right") - 1, phrase]), axis=1)
            for doc, p in pairs.T.tolist():
                self.found.setdefault(doc, set()).update(i for r in rows[bounds[p] : bounds[p + 1]].tolist() if (i := tests.ids[r]) is not None)

    def columns(self) -> list[pa.Array]:
        """n_words, n_hit, items and spans of each document."""
        texts = len(self.offs) - 1
        hit = np.cumsum(self.change)[:-1] > 0
        n_hit = np.diff(tk.sums(hit)[self.firsts])
        spans: list[list[dict[str, int]]] = [[] for _ in range(texts)]
        for doc in np.flatnonzero(n_hit).tolist():
            lo, hi, at = int(self.firsts[doc]), int(self.firsts[doc + 1]), self.offs[doc]
            turns = np.flatnonzero(np.diff(hit[lo:hi].astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
            points = tk.sums((self.buf[at : self.offs[doc + 1]] & 0xC0) != 0x80)
            spans[doc] = [{"start": int(points[self.starts[lo + a] - at]), "end": int(points[self.ends[lo + b - 1] - at])} for a, b in turns.tolist()]
        items = [sorted(self.found.get(doc, ())) for doc in range(texts)]
        return [pa.array(np.diff(self.firsts).astype(np.int64)), pa.array(n_hit), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(_PAIR))]


def _blocks(benchmark: DataFrame, item: str, text: str, window: int, limit: int, piece: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The benchmark's (id, text) rows in bounded lists; a long item comes in pieces whose windows are the item's."""
    low = F.translate(F.col(text).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = benchmark.select(F.col(item).cast("string").alias("item"), F.regexp_extract_all(low, F.lit(_PATTERN), F.lit(0)).alias("w")).filter("size(w) > 0")
    starts = F.expr(f"sequence(0, greatest(size(w) - {window}, 0), {piece})")
    rows = words.select("item", "w", F.explode(starts).alias("at")).select("item", F.array_join(F.slice("w", F.col("at") + 1, F.lit(piece + window - 1)), " ").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-total // limit)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(max(1, count))))
    for block in range(count):
        yield [(r["item"], r["text"]) for r in rows.filter(F.col("block") == block).select("item", "text").collect()]


_PAIR = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def mark(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """``docs`` with n_words, n_hit (long), items (sorted array of ids) and spans (array of code point bounds to remove)."""
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    added = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", spans)])
    docs = docs.drop(*added.names)
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, *added.fields])
    send = docs.sparkSession.sparkContext.broadcast
    known: set[bytes] = set()
    sent, shortest = [], window
    for rows in _blocks(benchmark, item, item_text, window, block, piece):
        split = [t.encode().split(b" ") for _, t in rows]
        known.update(w for words in split for w in words)
        shortest = min([shortest, *map(len, split)])
        sent.append(send(rows))
    vocabulary = send(Vocabulary(known))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary.value

        @lru_cache(maxsize=KEPT)
        def tests(number: int) -> Phrases:
            return phrases(sent[number].value, own, window)

        def searched(held: list[tuple[pa.RecordBatch, Shard]]) -> Iterator[pa.RecordBatch]:
            for number in range(len(sent)):
                for _, shard in held:
                    shard.search(tests(number))
            for some, shard in held:
                yield pa.RecordBatch.from_arrays([*some.columns, *shard.columns()], names=schema.names)

        held: list[tuple[pa.RecordBatch, Shard]] = []
        for batch in batches:
            for lo, hi, buf, offs in tk.chunks(batch.column(at), SHARD):
                held.append((batch.slice(lo, hi - lo), Shard(buf, offs, own, shortest)))
                if len(sent) < 2 or sum(len(s.buf) for _, s in held) >= HELD:
                    yield from searched(held)
                    held = []
        yield from searched(held)

    return docs.mapInArrow(judge, schema)


def contaminated() -> Column:
    """The contract's rule over ``mark``'s columns: at least one word in twenty is hit."""
    return (F.col("n_hit") > 0) & (F.lit(20) * F.col("n_hit") >= F.col("n_words"))
