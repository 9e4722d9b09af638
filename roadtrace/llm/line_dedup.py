r"""Incremental line dedup: sharded cuckoo filters before exact reference counts; insertions and deletions are reversible.

A text is split at \n. A line's key is the line without ``[\x20\x09-\x0D]`` at both ends, A-Z lower-cased; keys of fewer than
``MIN_POINTS`` code points never count. Keys travel as 128-bit keyed BLAKE2 digests (``hi``, ``lo``). That stands for the key itself: no two
of 10**12 different keys share one but with a chance near 10**-15.

A ``State`` has three tables:

* ``refs`` (hi, lo, doc, n): the exact reference counts, one row for a key and the document that holds it.
* ``filters`` (shard, size, table): a cuckoo filter a shard of digests, with 16-bit fingerprints in buckets of four. A key has as many
  copies of its fingerprint as it has references, but at most ``least``. So a key with fewer copies in reach than ``least`` surely has
  fewer references, and most lines of a corpus never touch the reference table again.
* ``hot`` (hi, lo): keys whose filter had ``least`` copies in reach when they were last inserted: all keys that may repeat enough.

``insert`` counts a batch's references by key in its tasks, before any shuffle, and deals the distinct keys to the filters by digest. A key that
the filter clears gets its copies at once. Only the others are looked up in ``refs``, and get the copies that their exact count lacks.
``delete`` takes the documents' rows out of ``refs`` and, from the exact counts before and after, the copies out of the filters, so inserting and
deleting a batch leaves the same counts and the same fingerprints as never having seen it. A filter that gets too full is made
again from ``refs`` with more shards. ``apply`` drops lines from texts: for the hot keys alone it takes the number of documents
and the largest id from ``refs``.

Documents are told apart by ``doc_id``: rows of one id are one document with several references, and a null id is a document below
all others. Defined cases: a null text is one empty line; a text without \n is one line; an empty table gives no rows; of a key's lines
in its largest document all stay, repeats too; other columns go through unchanged, and one with the name of an output is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadtrace.llm import textkit as tk

MIN_POINTS = 20
LEAST = 3
#: References for which a shard is laid out; it holds some more than that.
SHARD_KEYS = 1 << 17
SLOTS = 4
#: Share of a filter's slots that may be taken.
FULL = 0.85
#: Tasks among which the references of one hot key are dealt.
SALTS = 16
KICKS = 500

_BLANK = b" \t\n\x0b\x0c\r"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_KEY = b"line"


@dataclass(frozen=True)
class State:
    """The three tables, the number of shards, and how many documents make a key repeat."""

    refs: DataFrame
    filters: DataFrame
    hot: DataFrame
    shards: int
    least: int = LEAST


def digest(line: bytes) -> bytes | None:
    """The digest of a line's key; None for a short key."""
    key = line.strip(_BLANK)
    if len(key) < MIN_POINTS or (len(key) < 4 * MIN_POINTS and sum((c & 0xC0) != 0x80 for c in key) < MIN_POINTS):
        return None
    return blake2b(key.translate(_LOWER), digest_size=16, key=_KEY).digest()


def _lines(buf: np.ndarray, offs: np.ndarray) -> Iterator[list[bytes]]:
    """The lines of each text of a chunk."""
    data = buf.tobytes()
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        yield data[a:b].split(b"\n")


def references(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(hi, lo, doc, n): each distinct key of each row, n = 1."""
    taken = docs.select(F.col(id_col).alias("doc"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType()), taken.schema["doc"], T.StructField("n", T.LongType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, buf, offs in tk.chunks(batch.column(1)):
                found, owner = [], []
                for row, lines in enumerate(_lines(buf, offs)):
                    keys = {d for line in lines if (d := digest(line)) is not None}
                    found += sorted(keys)
                    owner += [first + row] * len(keys)
                words = np.frombuffer(b"".join(found), "<i8")
                docs = batch.column(0).take(pa.array(owner, pa.int64()))
                for lo in range(0, len(owner), 1 << 16):
                    cut, part = slice(2 * lo, 2 * (lo + (1 << 16))), docs.slice(lo, 1 << 16)
                    yield pa.RecordBatch.from_arrays([pa.array(words[cut][::2]), pa.array(words[cut][1::2]), part, pa.array(np.ones(len(part), np.int64))], names=schema.names)

    return taken.mapInArrow(scan, schema)


def fingerprints(hi: np.ndarray, lo: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint (never 0) and the two buckets of each key; either bucket gives the other."""
    prints = ((lo.view(np.uint64) >> np.uint64(48)) % np.uint64(0xFFFF) + np.uint64(1)).astype(np.uint16)
    first = (lo.view(np.uint64) & np.uint64(buckets - 1)).astype(np.int64)
    return prints, first, first ^ _jump(prints, buckets)


def _jump(prints: np.ndarray, buckets: int) -> np.ndarray:
    return ((prints.astype(np.uint32) * np.uint32(0x5BD1E995)) >> np.uint32(7)).astype(np.int64) & (buckets - 1)


class Cuckoo:
    """A filter of 16-bit fingerprints, four slots a bucket; all calls take whole arrays of keys."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def empty(cls, keys: int) -> Cuckoo:
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, keys) / (SLOTS * FULL)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    def copies(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """How often each key's fingerprint stands in its buckets: its own copies or more."""
        prints, first, second = fingerprints(hi, lo, len(self.table))
        at_first = (self.table[first] == prints[:, None]).sum(axis=1)
        return np.where(first == second, at_first, at_first + (self.table[second] == prints[:, None]).sum(axis=1))

    def add(self, hi: np.ndarray, lo: np.ndarray, times: np.ndarray) -> bool:
        """Puts ``times`` copies of each key in; False if the filter is too full for them (it is then of no use)."""
        each = np.repeat(np.arange(len(hi)), times)
        if np.count_nonzero(self.table) + len(each) > FULL * self.table.size:
            return False
        prints, first, second = (v[each] for v in fingerprints(hi, lo, len(self.table)))
        prints, second = self._place(prints, first, second)
        prints, second = self._place(prints, second, second)
        for turn in range(KICKS):
            if not len(prints):
                return True
            # One key of a bucket takes a slot, whoever stood there moves to its other bucket.
            at, who = np.unique(second, return_index=True)
            wait = np.ones(len(prints), bool)
            wait[who] = False
            # Mixed by bucket and turn: a slot that follows from turn modulo SLOTS alone lets copies drive each other round for ever.
            slot = (tk.mix((at.astype(np.uint64) << np.uint64(16)) + np.uint64(turn)) >> np.uint64(62)).astype(np.int64) % SLOTS
            moved = self.table[at, slot].copy()
            self.table[at, slot] = prints[who]
            prints = np.concatenate([moved, prints[wait]])
            target = np.concatenate([at ^ _jump(moved, len(self.table)), second[wait]])
            prints, second = self._place(prints, target, target)
        return not len(prints)

    def _place(self, prints: np.ndarray, bucket: np.ndarray, then: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fills free slots of ``bucket``; what found none, with its bucket of ``then``."""
        order = np.argsort(bucket, kind="stable")
        prints, bucket, then = prints[order], bucket[order], then[order]
        opens = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
        rank = np.arange(len(bucket)) - np.repeat(opens, np.diff(np.append(opens, len(bucket))))
        free = self.table[bucket] == 0
        fits = rank < free.sum(axis=1)
        nth = (np.cumsum(free[fits], axis=1) == rank[fits][:, None] + 1) & free[fits]
        self.table[bucket[fits], nth.argmax(axis=1)] = prints[fits]
        return prints[~fits], then[~fits]

    def remove(self, hi: np.ndarray, lo: np.ndarray, times: np.ndarray) -> None:
        """Takes ``times`` copies of each key out; they must be there."""
        prints, first, second = fingerprints(hi, lo, len(self.table))
        for p, a, b, left in zip(prints.tolist(), first.tolist(), second.tolist(), times.tolist(), strict=True):
            for bucket in (a, b):
                for slot in np.flatnonzero(self.table[bucket] == p)[:left].tolist():
                    self.table[bucket, slot] = 0
                    left -= 1


def _shard(shards: int):
    return F.pmod(F.col("hi"), F.lit(shards)).cast("int")


_FILTERS = "shard int, size long, table binary"
_TOUCHED = "kind string, shard int, size long, table binary, hi long, lo long"


def _touch(filters: DataFrame, keys: DataFrame, shards: int, least: int) -> DataFrame:
    """Rows of kind ``filter`` (each shard after the change), ``ask`` (keys to look up) and ``full`` (a shard that must be made again).

    ``keys`` has (hi, lo, n, exact): with ``exact``, n copies come (or go, if negative); else n references came, which are copied if
    the filter clears the key and asked about otherwise.
    """

    def change(group: tuple, held: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(group[0])
        if len(held):
            filled = Cuckoo(np.frombuffer(held["table"].iloc[0], np.uint16).reshape(-1, SLOTS).copy())
        else:
            filled = Cuckoo.empty(max(2 * int(np.minimum(rows["n"].to_numpy(np.int64), least).clip(0).sum()), SHARD_KEYS // 8))
        rows = rows.sort_values(["hi", "lo"])
        hi, lo, n = (rows[c].to_numpy(np.int64) for c in ("hi", "lo", "n"))
        exact = rows["exact"].to_numpy(bool)
        gone, come = exact & (n < 0), exact & (n > 0)
        filled.remove(hi[gone], lo[gone], -n[gone])
        ask = ~exact & (filled.copies(hi, lo) + n >= least)
        clear = ~exact & ~ask
        sound = filled.add(hi[clear], lo[clear], n[clear]) and filled.add(hi[come], lo[come], n[come])
        head = pd.DataFrame({"kind": ["filter" if sound else "full"], "shard": shard, "size": np.count_nonzero(filled.table), "table": [filled.table.tobytes() if sound else b""], "hi": 0, "lo": 0})
        asked = pd.DataFrame({"kind": "ask", "shard": shard, "size": 0, "table": None, "hi": hi[ask], "lo": lo[ask]})
        return pd.concat([head, asked]) if len(asked) else head

    dealt = keys.withColumn("shard", _shard(shards))
    return filters.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInPandas(change, _TOUCHED).checkpoint()


def empty(spark: SparkSession, id_type: T.DataType | None = None, *, expected: int = 0, least: int = LEAST) -> State:
    """A state without documents, laid out for ``expected`` references; it grows beyond by itself."""
    refs = T.StructType([T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType()), T.StructField("doc", id_type or T.LongType()), T.StructField("n", T.LongType())])
    return State(spark.createDataFrame([], refs), spark.createDataFrame([], _FILTERS), spark.createDataFrame([], "hi long, lo long"), max(1, -(-expected // SHARD_KEYS)), least)


def _salted(rows: DataFrame, keys: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` of refs that meet ``keys``; the references of one key are dealt to SALTS tasks."""
    spread = keys.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).join(spread, ["hi", "lo", "__salt"], how).drop("__salt")


def _counts(refs: DataFrame, keys: DataFrame) -> DataFrame:
    """(hi, lo, total): the exact references of ``keys``."""
    return _salted(refs, keys, "left_semi").groupBy("hi", "lo").agg(F.sum("n").alias("total"))


def insert(state: State, docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> State:
    """The state with all rows of ``docs`` added."""
    tk.checkpoint_dir(docs.sparkSession)
    batch = references(docs, id_col=id_col, text=text).checkpoint()
    refs = state.refs.unionByName(batch)
    keys = batch.groupBy("hi", "lo").agg(F.sum("n").alias("n"))
    met = _touch(state.filters, keys.withColumn("exact", F.lit(False)), state.shards, state.least)
    if not met.filter("kind = 'full'").isEmpty():
        return _rebuilt(State(refs, state.filters, state.hot, state.shards, state.least))
    asked = met.filter("kind = 'ask'").select("hi", "lo").checkpoint()
    filters = met.filter("kind = 'filter'").select("shard", "size", "table")
    hot = state.hot.union(asked).distinct().checkpoint()
    most = F.lit(state.least)
    after = _counts(refs, asked)
    known = _salted(batch, asked, "left_semi").groupBy("hi", "lo").agg(F.sum("n").alias("came"))
    lacking = after.join(known, ["hi", "lo"]).select("hi", "lo", (F.least("total", most) - F.least(F.col("total") - F.col("came"), most)).alias("n"), F.lit(True).alias("exact"))
    met = _touch(filters, lacking.filter("n > 0"), state.shards, state.least)
    if not met.filter("kind = 'full'").isEmpty():
        return _rebuilt(State(refs, filters, hot, state.shards, state.least))
    return State(refs, met.select("shard", "size", "table"), hot, state.shards, state.least)


def delete(state: State, ids: DataFrame, *, id_col: str = "doc_id") -> State:
    """The state without the documents of ``ids``, with every row that had one of them."""
    tk.checkpoint_dir(ids.sparkSession)
    gone = ids.select(F.col(id_col).alias("gone")).distinct()
    same = F.col("doc").eqNullSafe(F.col("gone"))
    removed = state.refs.join(gone, same, "left_semi").checkpoint()
    left = state.refs.join(gone, same, "left_anti").checkpoint()
    went = removed.groupBy("hi", "lo").agg(F.sum("n").alias("went"))
    before = _counts(state.refs, went.select("hi", "lo"))
    most = F.lit(state.least)
    change = went.join(before, ["hi", "lo"]).select("hi", "lo", (F.least(F.col("total") - F.col("went"), most) - F.least("total", most)).alias("n"), F.lit(True).alias("exact"))
    met = _touch(state.filters, change.filter("n < 0"), state.shards, state.least)
    return State(left, met.select("shard", "size", "table"), state.hot, state.shards, state.least)


def _rebuilt(state: State) -> State:
    """Filters made again from the exact counts, with shards enough for all copies."""
    copies = state.refs.groupBy("hi", "lo").agg(F.sum("n").alias("n")).select("hi", "lo", F.least("n", F.lit(state.least)).alias("n"), F.lit(True).alias("exact"))
    shards = max(2 * state.shards, -(-(copies.agg(F.sum("n")).first()[0] or 0) // SHARD_KEYS))
    while True:
        met = _touch(state.filters.limit(0), copies, shards, state.least)
        if met.filter("kind = 'full'").isEmpty():
            break
        shards *= 2
    hot = copies.filter(F.col("n") >= state.least).select("hi", "lo").union(state.hot).distinct().checkpoint()
    return State(state.refs, met.select("shard", "size", "table"), hot, shards, state.least)


def dropped(state: State) -> DataFrame:
    """(doc, hi, lo): the keys that each document of the state loses."""
    held = _salted(state.refs, state.hot, "left_semi").groupBy("hi", "lo", "doc").agg(F.sum("n").alias("n")).checkpoint()
    enough = held.groupBy("hi", "lo").agg(F.count("*").alias("documents"), F.max("doc").alias("top")).filter(F.col("documents") >= state.least)
    return _salted(held, enough).filter(~F.col("doc").eqNullSafe(F.col("top"))).select("doc", "hi", "lo")


def apply(state: State, docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", kept: str = "kept") -> DataFrame:
    """``docs`` with ``kept`` (string), n_lines and n_dropped (long), by the counts of ``state``."""
    added = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField(kept, T.StringType())]
    docs = docs.select(*(F.col(c) for c in docs.columns if c not in {f.name for f in added} or c == text))
    inside = [c for c in docs.columns if c != kept]
    lists = dropped(state).groupBy("doc").agg(F.collect_list(F.struct("hi", "lo")).alias("__drop")).withColumnRenamed("doc", "__doc")
    plain = docs.select(*inside, F.col(text).alias("__text"))
    met = plain.join(lists, F.col(id_col).eqNullSafe(F.col("__doc")), "left").drop("__doc")
    schema = T.StructType([*(plain.schema[c] for c in inside), *added])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drops = batch.column(batch.num_columns - 1)
            for lo, hi, buf, offs in tk.chunks(batch.column(batch.num_columns - 2)):
                n_lines, n_dropped, texts = [], [], []
                for drop, lines in zip(drops.slice(lo, hi - lo), _lines(buf, offs), strict=True):
                    n_lines.append(len(lines))
                    if drop.is_valid:
                        words = np.stack([p.to_numpy() for p in drop.values.flatten()], axis=1)
                        away = {w.tobytes() for w in words}
                        lines = [line for line in lines if digest(line) not in away]
                    n_dropped.append(n_lines[-1] - len(lines))
                    texts.append(b"\n".join(lines))
                outside = [c.slice(lo, hi - lo) for c in batch.columns[: len(inside)]]
                yield pa.RecordBatch.from_arrays([*outside, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], names=schema.names)

    return met.mapInArrow(cut, schema)


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", kept: str = "kept", least: int = LEAST) -> DataFrame:
    """``docs`` without the lines that repeat among them: all inserted in an empty state, then applied."""
    spark = docs.sparkSession
    rows = docs.select(F.count("*").alias("n"), F.sum(F.length(F.col(text)) - F.length(F.translate(F.col(text), "\n", ""))).alias("breaks")).first()
    state = empty(spark, docs.schema[id_col].dataType, expected=(rows["n"] or 0) + (rows["breaks"] or 0), least=least)
    return apply(insert(state, docs, id_col=id_col, text=text), docs, id_col=id_col, text=text, kept=kept)
