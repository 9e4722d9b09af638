r"""Spelling variants: words one edit apart, found by an index of variable-length grams.

Words are the maximal runs of ``LETTERS``, A-Z lower-cased, counted over all texts. Two words are near if exactly one inserted, deleted or
replaced code point parts them; a word's form is its most frequent near word, if that is ``ratio`` times as frequent, and its root
is where the forms lead in the end.

The index follows VGRAM. A word stands between two marks. The gram at a place begins with ``LOW`` code points and grows, up to ``high``, as long
as it is in the dictionary: the grams with more than a floor of occurrences in the word list, at most ``MAX_NODES`` of each length, so the
dictionary is a bounded broadcast. Of the grams at all places, those that end within an earlier one are left out.

An edit at a place affects only grams that end in the ``high`` places after it: those that hold the place, and those behind it
that an earlier gram, grown, may now cover. All others come back in the near word, before the place as far from the start and behind it as far
from the end. So a near word is in the lists of all grams that the edit leaves. Lists are merged for every place of an edit: both
words stand under the digest of the grams that are left there, and one join finds them, where a count of shared grams would pair
each word with hundreds that share its few common ones. Each candidate is verified by its edit distance.

With grams of two and three, no edit affects all grams of a word of ``LONG_ENOUGH`` code points; shorter words get grams of two.

Defined cases: a null text has no words; a null id counts as an empty text in ``misspell``; ids may repeat; an empty table gives no rows; words of any
length are whole; ties of forms go to the smallest word in code-point order; other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadtrace.llm import textkit as tk

#: Class of the letters of a word; all lie in one byte of Latin-1.
LETTERS = r"A-Za-zÀ-ÿ"
LOW = 2
#: Length to which grams grow, and the words from which that leaves a gram at every edit; word lists with shorter ones have grams of LOW alone.
HIGH = 3
LONG_ENOUGH = 6
MAX_NODES = 4096
#: Occurrences up to which a gram never grows.
FLOOR = 16
#: Code points of a text, or of the grams of words, that are worked on together.
PIECE = 1 << 20
#: Distinct words, or their code points, that a task counts before it passes them on.
HELD_WORDS, HELD_POINTS = 100_000, 4_000_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BREAK = re.compile(f"[^{LETTERS}]")

#: A rule that turns (id as text, run) into the word that counts.
Rule = Callable[[str, str], str]


def misspell(doc: str, run: str, every: int = 199) -> str:
    """Deletes one code point of every ``every``-th run by the checksum of the document and the run."""
    h = crc32(f"{doc}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _runs(text: str, pattern: re.Pattern) -> Counter:
    """How often each run stands in a text; long texts go by pieces that end between runs."""
    found: Counter = Counter()
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        if end < len(text):
            stop = _BREAK.search(text, end)
            end = stop.start() if stop else len(text)
        found.update(pattern.findall(text, at, end))
        at = end
    return found


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", rule: Rule | None = None, least_points: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n): words of ``least_points`` or more code points that occur ``least_count`` times or more in all texts."""
    if least_points < LOW:
        raise ValueError(f"words have at least {LOW} code points")
    taken = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text).cast("string"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A rule only shortens or keeps; so runs below the limit never count.
        pattern = re.compile(f"[{LETTERS}]{{{least_points},}}")
        total: Counter = Counter()
        points = 0
        for batch in batches:
            ids = batch.column(0)
            for first, last, buf, offs in tk.chunks(batch.column(1)):
                data = buf.tobytes().translate(_LOWER)
                chunk = ids.slice(first, last - first).to_pylist()
                for doc, a, b in zip(chunk, offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                    for run, times in _runs(data[a:b].decode(), pattern).items():
                        word = rule(doc, run) if rule else run
                        if len(word) >= least_points:
                            if word not in total:
                                points += len(word)
                            total[word] += times
                    if len(total) >= HELD_WORDS or points >= HELD_POINTS:
                        yield _listed(total)
                        total, points = Counter(), 0
        yield _listed(total)

    return taken.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _listed(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])


@dataclass(frozen=True)
class Dictionary:
    """Frequent grams (their bytes as a number, sorted) with their counts."""

    grams: np.ndarray
    counts: np.ndarray

    def count(self, grams: np.ndarray) -> np.ndarray:
        """Count of each gram; 0 for one that isn't frequent."""
        if not len(self.grams):
            return np.zeros(len(grams), np.int64)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        return np.where(self.grams[at] == grams, self.counts[at], 0)


@dataclass(frozen=True)
class Grams:
    """The grams of marked words that follow each other in a buffer, in order: word, place in it, gram, and the first of each word (n+1).

    ``closed`` has, for each place of the buffer, how many grams end there or before.
    """

    word: np.ndarray
    place: np.ndarray
    gram: np.ndarray
    bounds: np.ndarray
    closed: np.ndarray


def marked(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Latin-1 bytes of the words, each between its marks, and n+1 bounds."""
    data = [b"\x01" + w.encode("latin-1") + b"\x02" for w in words]
    return np.frombuffer(b"".join(data), np.uint8), tk.sums(np.array([len(d) for d in data], np.int64))


def _at(buf: np.ndarray, until: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places with ``size`` bytes left in their word, and these bytes as numbers."""
    places = np.flatnonzero(np.arange(len(buf)) + size <= until)
    gram = np.zeros(len(places), np.int64)
    for k in range(size):
        gram = gram << 8 | buf[places + k]
    return places, gram


def decompose(buf: np.ndarray, bounds: np.ndarray, dictionary: Dictionary, high: int) -> Grams:
    size = np.diff(bounds)
    until = np.repeat(bounds[1:], size)
    places, gram = _at(buf, until, LOW)
    length = np.full(len(places), LOW)
    for q in range(LOW, high):
        grows = np.flatnonzero((length == q) & (places + q < until[places]))
        grows = grows[dictionary.count(gram[grows]) > 0]
        gram[grows] = gram[grows] << 8 | buf[places[grows] + q]
        length[grows] += 1
    end = places + length
    # Ends of earlier words lie before this word's, so one running maximum serves all words.
    kept = np.append(True, end[1:] > np.maximum.accumulate(end)[:-1]) if len(end) else np.zeros(0, bool)
    places, gram, end = places[kept], gram[kept], end[kept]
    closed = np.zeros(len(buf) + 1, np.int64)
    closed[end] = 1
    word = np.searchsorted(bounds, places, "right") - 1
    return Grams(word, places - bounds[word], gram, np.searchsorted(places, bounds), np.cumsum(closed))


def left_by_edits(found: Grams, bounds: np.ndarray, high: int) -> tuple[tuple[np.ndarray, ...], int]:
    """(word, key, first affected gram, first one behind) for an edit at each place, and how many of them come first.

    First come code points replaced or deleted, then those inserted, under the size of the word that they make. Two words one edit
    apart share a key, and at least for one of them it is of the first kind.
    """
    size = np.diff(bounds)
    word = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(word))
    offset = at - bounds[word]
    fore = tk.sums(tk.mix(found.gram.astype(np.uint64) * np.uint64(64) + found.place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), np.uint64)
    rear = tk.sums(tk.mix(found.gram.astype(np.uint64) * np.uint64(64) + (size[found.word] - found.place).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), np.uint64)
    out = []
    for reach, grown in ((high, 0), (high - 1, 1)):
        # Letters are replaced or deleted; insertions come before a letter or the last mark.
        edits = np.flatnonzero((offset > 0) & (offset < size[word] - 1 + grown))
        w = word[edits]
        first = found.closed[edits]
        behind = np.maximum(first, found.closed[np.minimum(edits + reach, bounds[w + 1])])
        before, after = fore[first] - fore[found.bounds[w]], rear[found.bounds[w + 1]] - rear[behind]
        key = tk.mix(tk.mix(before) + after * np.uint64(3) + (size[w] + grown).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        out.append((w, key.view(np.int64), first, behind))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)), len(out[0][0])


def _pieces(words: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, marked bytes, bounds) of consecutive words of at most ``PIECE`` bytes, or one."""
    for first, last, _, _ in tk.chunks(words, PIECE):
        yield (first, *marked(words.slice(first, last - first).to_pylist()))


def gram_dictionary(words: DataFrame, high: int, *, max_nodes: int = MAX_NODES) -> Dictionary:
    """The grams of LOW to ``high`` code points that occur more often in ``words`` than a floor that leaves at most ``max_nodes`` of each length."""
    points = words.agg(F.sum(F.length("word") + F.lit(2)).alias("n")).first()["n"] or 0
    floor = max(FLOOR, points // max_nodes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, buf, bounds in _pieces(batch.column(0)):
                until = np.repeat(bounds[1:], np.diff(bounds))
                grams, n = np.unique(np.concatenate([_at(buf, until, q)[1] for q in range(LOW, high + 1)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n)], names=["gram", "n"])

    rows = words.select("word").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") > floor).orderBy("gram").toPandas()
    return Dictionary(rows["gram"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))


def gram_index(words: DataFrame, dictionary: Dictionary, high: int) -> DataFrame:
    """(key, id, grows, text): a word under the digests of the grams that each edit leaves; ``grows`` for insertions, ``text`` of words up to SHORT."""
    # At most high - LOW + 1 times max_nodes grams: a bounded broadcast.
    sent = words.sparkSession.sparkContext.broadcast(dictionary)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, buf, bounds in _pieces(batch.column(1)):
                found = decompose(buf, bounds, sent.value, high)
                (word, key, _, _), plain = left_by_edits(found, bounds, high)
                grows = np.arange(len(word)) >= plain
                # Edits between the same two grams leave the same ones.
                order = np.lexsort((key, grows, word))
                word, key, grows = word[order], key[order], grows[order]
                new = np.append(True, (word[1:] != word[:-1]) | (key[1:] != key[:-1]) | (grows[1:] != grows[:-1]))
                word, key, grows = word[new], key[new], grows[new]
                own = batch.slice(first, len(bounds) - 1)
                texts = pc.if_else(pa.array(np.diff(bounds) - 2 <= SHORT), own.column(1), None)
                for lo in range(0, len(word), 1 << 16):
                    rows = pa.array(word[lo : lo + (1 << 16)])
                    yield pa.RecordBatch.from_arrays([pa.array(key[lo : lo + (1 << 16)]), own.column(0).take(rows), pa.array(grows[lo : lo + (1 << 16)]), texts.take(rows)], names=["key", "id", "grows", "text"])

    return words.select("id", "word").mapInArrow(index, "key long, id long, grows boolean, text string")


#: Words up to this size travel with their keys and are verified where they meet; longer ones are looked up for it.
SHORT = 64


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b): ids of near words, both ways, from (id, word)."""
    least = words.agg(F.min(F.length("word")).alias("n")).first()["n"] or 0
    high = HIGH if least >= LONG_ENOUGH else LOW
    index = gram_index(words, gram_dictionary(words, high), high).checkpoint()
    one = lambda c: index.select("key", F.col("id").alias(c), F.col("grows").alias(f"{c}_grows"), F.col("text").alias(f"{c}_text"))
    met = one("a").filter("NOT a_grows").join(one("b"), "key").filter((F.col("b_grows") & (F.col("a") != F.col("b"))) | (F.col("a") < F.col("b")))
    met = met.filter(F.col("a_text").isNull() | F.col("b_text").isNull() | (F.levenshtein("a_text", "b_text", 1) == 1))
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, right = (words.select(F.col("id").alias(c), F.col("word").alias(f"{c}_word")) for c in "ab")
    sure = pairs.join(left, "a").join(right, "b").filter(F.levenshtein("a_word", "b_word", 1) == 1).select("a", "b").checkpoint()
    return sure.union(sure.select("b", "a"))


def variants(counts: DataFrame, *, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for (word, n) of distinct words."""
    tk.checkpoint_dir(counts.sparkSession)
    words = counts.select(F.monotonically_increasing_id().alias("id"), "word", "n").checkpoint()
    other = words.select(F.col("id").alias("b"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = near_pairs(words).join(other, "b").groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    met = words.join(best, "id", "left").withColumn("form_n", -F.col("best.less"))
    taken = F.col("form_n") >= F.lit(ratio) * F.col("n")
    formed = met.select("word", F.when(taken, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("form_n")).alias("form_n")).checkpoint()
    # Counts grow by the ratio with each form, so chains are short and the doubling ends.
    chains = formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root")).checkpoint()
    while True:
        onward = chains.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = chains.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")).checkpoint()
        chains = longer.select("word", "root")
        if longer.filter("moved").isEmpty():
            break
    return formed.join(chains, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
