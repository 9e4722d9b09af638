"""Byte-level BPE encoding and decoding by a pair occurrence index.

The distinct words of a partition (pieces of the pre-tokenizer's pattern) stand in one symbol array with links to the
next and previous live symbol. An index maps each mergeable pair to all its positions. Active ranks are taken in
ascending order from a heap; a rank's merge is applied at all its positions at once, left to right where they overlap,
and only the pairs on either side of a merged position enter the index again. Word encodings are kept in a task, up to
``MAX_KNOWN`` words, and texts are gathered from them.

The vocabulary file (``path``) is a parameter and is read in the tasks from the installed package; special tokens in
a text become their id, as the tokenizers library does.

Defined cases: null and empty texts have no tokens and decode to the empty string; decoding bytes that are no UTF-8
gives replacement characters; repeated rows are encoded each; an empty table gives no rows; other columns stay, but a
column named as an output is replaced.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from roadtrace.llm import textkit as tk

#: Words of which a task keeps the encodings; then it starts anew.
MAX_KNOWN = 1 << 18
#: Bytes of texts encoded together.
CHUNK = 2 << 20
_NONE = np.int64(1 << 40)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in printable else next(free)) for b in range(256)]


class _Index(dict):
    """Numbers for words, given in order of first sight."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class Codec:
    """One vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        alphabet = byte_alphabet()
        back = {c: b for b, c in enumerate(alphabet)}
        self.byte_id = np.array([vocab.get(c, -1) for c in alphabet], np.int64)
        self.left, self.right, self.made = (np.array([vocab[f(p)] for p in pairs], np.int64) for f in (lambda p: p[0], lambda p: p[1], lambda p: p[0] + p[1]))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        keys = self.left << 32 | self.right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        size = max([*vocab.values(), *self.special.values()]) + 1
        pieces = [b""] * size
        for token, i in vocab.items():
            pieces[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            pieces[i] = token.encode()
        self.piece_bounds = tk.sums(np.fromiter(map(len, pieces), np.int64, size))
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.apart = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.forget()

    def forget(self) -> None:
        self.index, self.flat, self.bounds = _Index(), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words and their n+1 bounds."""
        bounds = tk.sums(np.fromiter(map(len, words), np.int64, len(words)))
        n = int(bounds[-1])
        symbol = np.append(self.byte_id[np.frombuffer(b"".join(words), np.uint8)], -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        some = np.diff(bounds) > 0
        after[bounds[1:][some] - 1], before[bounds[:-1][some]] = n, n
        occurs: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Puts the pairs that begin at ``at`` into the index."""
            ranks = self.rank(symbol[at], symbol[after[at]])
            at, ranks = at[ranks < _NONE], ranks[ranks < _NONE]
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            edges = np.flatnonzero(np.diff(ranks, prepend=-1, append=-1)) if len(ranks) else ()
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                rank = int(ranks[lo])
                if rank in occurs:
                    occurs[rank].append(at[lo:hi])
                else:
                    occurs[rank] = [at[lo:hi]]
                    heapq.heappush(heap, rank)

        enter(np.flatnonzero(after[:n] < n))
        while heap:
            rank = heapq.heappop(heap)
            found = occurs.pop(rank)
            at = np.unique(np.concatenate(found)) if len(found) > 1 else found[0]
            a, b = self.left[rank], self.right[rank]
            at = at[(symbol[at] == a) & (symbol[after[at]] == b)]
            gone = after[at]
            if a == b and len(at) > 1:  # in a run of overlapping pairs every other one merges, from the left
                order = np.arange(len(at))
                first = np.maximum.accumulate(np.where(np.concatenate([[False], at[1:] == gone[:-1]]), 0, order))
                at, gone = at[(order - first) % 2 == 0], gone[(order - first) % 2 == 0]
            if not len(at):
                continue
            symbol[at], symbol[gone] = self.made[rank], -2
            after[at] = after[gone]
            before[after[at]] = at
            symbol[n] = -1
            enter(np.unique(np.concatenate([before[at][before[at] < n], at[after[at] < n]])))
        live = symbol[:n] >= 0
        return symbol[:n][live], tk.sums(live)[bounds]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and their n+1 bounds."""
        if len(self.index) > MAX_KNOWN:
            self.forget()
        number, counts, numbers = self.index.__getitem__, [], []
        for text in texts:
            if self.apart and any(s in text for s in self.special):
                words = [w for part in self.apart(text) for w in ([part] if part in self.special else self.split(part))]
            else:
                words = self.split(text)
            counts.append(len(words))
            numbers.append(np.fromiter(map(number, words), np.int64, len(words)))
        new, self.index.new = self.index.new, []
        if new:
            ids, bounds = self.encode_words([b"" if w in self.special else w.encode() for w in new])
            for i, w in enumerate(new):
                if w in self.special:
                    ids, bounds = np.insert(ids, bounds[i], self.special[w]), bounds + (np.arange(len(bounds)) > i)
            self.flat, self.bounds = np.concatenate([self.flat, ids]), np.concatenate([self.bounds, bounds[1:] + self.bounds[-1]])
        rows = np.concatenate([np.zeros(0, np.int64), *numbers])
        ids, bounds = tk.gather(self.flat, self.bounds, rows)
        return ids, bounds[tk.sums(np.array(counts, np.int64))]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of id runs."""
        data, ends = tk.gather(self.piece_bytes, self.piece_bounds, ids)
        raw, ends = data.tobytes(), ends[bounds].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_texts(df: DataFrame, path: str, *, text: str = "text", ids: str = "ids", decoded: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with ``ids``: binary, unsigned 32-bit little-endian; with ``decoded``: the text of those ids."""
    kept = [c for c in (df.columns if keep is None else keep) if c not in (ids, decoded)]
    taken = df.select(*kept, *([] if text in kept else [text]))
    schema = T.StructType([*(taken.schema[c] for c in kept), T.StructField(ids, T.BinaryType()), *([T.StructField(decoded, T.StringType())] if decoded else [])])
    at = taken.columns.index(text)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for lo, hi, buf, offs in tk.chunks(batch.column(at), CHUNK):
                raw, ends = buf.tobytes(), offs.tolist()
                found, bounds = own.encode([raw[a:b].decode() for a, b in zip(ends[:-1], ends[1:], strict=True)])
                columns = [tk.binary_rows(found.astype("<u4").view(np.uint8), bounds * 4).cast(pa.binary())]
                if decoded:
                    columns.append(pa.array(own.decode(found, bounds), pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[: len(kept)], *columns], names=schema.names)
        own.forget()

    return taken.mapInArrow(encode, schema)


def decode_ids(df: DataFrame, path: str, *, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids`` as ``decoded``; null ids decode to the empty string."""
    df = df.drop(decoded) if decoded != ids else df
    schema = T.StructType([*df.schema.fields, T.StructField(decoded, T.StringType())])
    at = df.columns.index(ids)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            runs = [np.frombuffer(v or b"", "<u4").astype(np.int64) for v in batch.column(at).to_pylist()]
            texts = own.decode(np.concatenate([np.zeros(0, np.int64), *runs]), tk.sums(np.array([len(r) for r in runs], np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return df.mapInArrow(decode, schema)
