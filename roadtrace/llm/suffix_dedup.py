"""Removal of repeated 50-byte strings by suffix arrays over shards.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller id. Two kinds of
shards take part. *Document shards* hold whole documents; *string shards* hold all strings with one anchor.

1. Anchors. In every ``LENGTH``-byte string the leftmost ``GRAM``-byte piece with the smallest hash is its anchor, so
   equal strings have equal anchors. A document shard sends the hashes of its anchors to string shards as packed arrays,
   which tells the anchors that several document shards have. Those, and those that two documents of one shard share, matter
   from here on.
2. Contexts. A shared anchor's context is the text of its strings, which follow one another (up to 2 * LENGTH - GRAM
   bytes). A document shard keeps each distinct context once, with the smallest id that holds it there, so the copies of a
   hot group cost a shard one context, and sends it to the anchor's string shard.
3. Suffix arrays. A string shard builds the suffix array of its distinct contexts (Larsson-Sadakane refinement), takes
   common prefixes (Kasai), and so has the smallest id of each of its strings. It works in blocks of ``BLOCK`` bytes;
   the sorted strings of the blocks are merged by binary search. Back go 31 bits a context: which of its strings also
   start in a smaller document.
4. Removal. A document shard turns the bits into spans and cuts them.

Texts are shuffled once, as whole documents; the three passes over the document shards read the same exchange.
Positions are recomputed, never stored, and every step is a Spark stage that can be run again.

Defined cases: null text counts as empty; a null id counts as larger than all others; rows that share an id don't
remove each other's strings; texts under ``LENGTH`` bytes stay; an empty table gives no rows; a kept column with the name of an output is
replaced, other names may clash with anything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from roadtrace.llm import textkit as tk
from roadtrace.llm.suffixes import common_prefixes, suffix_array, words8

LENGTH = 50
GRAM = 20
WINDOWS = LENGTH - GRAM + 1
CONTEXT = 2 * LENGTH - GRAM
#: Bytes of text per document shard, and of all text per string shard, roughly.
SHARD_BYTES = 4 << 20
PIECE_BYTES = 1 << 19
#: Bytes of text whose anchors are found together; their arrays fit a processor's cache.
STRETCH = 1 << 17
#: Bytes of contexts per suffix array.
BLOCK = 3 << 18
_LAST = np.int64((1 << 63) - 1)


def _slide(values: np.ndarray, width: int, better) -> np.ndarray:
    """``better`` (minimum or maximum) over each run of ``width`` values."""
    step = 1
    while 2 * step <= width:
        values = better(values[:-step], values[step:])
        step *= 2
    rest = width - step
    return better(values[:-rest], values[rest:]) if rest else values


def anchors(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Position and hash of each anchor, and how many bytes of its strings stand before and from it."""
    n = len(buf) - LENGTH + 1
    if n <= 0:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    word = np.ndarray((len(buf) - 7,), "<u8", np.ascontiguousarray(buf).data, 0, (1,)).astype(np.uint64)
    m = len(buf) - GRAM + 1
    h = word[:m] * np.uint64(0x9E3779B97F4A7C15)
    for k, factor in zip((*range(8, GRAM - 8, 8), GRAM - 8), (0xD6E8FEB86659FD93, 0xA24BAED4963EE407), strict=True):
        h ^= h >> np.uint64(32)
        h += word[k : m + k] * np.uint64(factor)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h |= np.uint64(1)
    least = _slide(h, WINDOWS, np.minimum)
    # Strings that cross a text's end choose no anchor.
    for end in offs[1:-1].tolist():
        least[max(0, end - LENGTH + 1) : end] = 0
    edge = np.zeros(WINDOWS - 1, np.uint64)
    chosen = _slide(np.concatenate([edge, least, edge]), WINDOWS, np.maximum) == h
    at = np.flatnonzero(chosen)
    hashes = h[at]
    # Each string's anchor: the first chosen place from its start that has its smallest hash.
    strings = np.flatnonzero(least)
    owner = (np.cumsum(chosen) - chosen)[strings]
    wanted = least[strings]
    wrong = np.flatnonzero(hashes[owner] != wanted)
    while len(wrong):
        owner[wrong] += 1
        wrong = wrong[hashes[owner[wrong]] != wanted[wrong]]
    if not len(strings):
        return at[:0], hashes[:0], at[:0], at[:0]
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    own = owner[first]
    last = np.append(first[1:], len(owner)) - 1
    return at[own], hashes[own], at[own] - strings[first], strings[last] + LENGTH - at[own]


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(int(_LAST)).to_numpy(zero_copy_only=False).astype(np.int64)


def _dealt(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)).astype(np.int64)


def _named(hashes: np.ndarray, shards: int) -> np.ndarray:
    """An anchor's name: its string shard and 40 more bits of its hash."""
    return (_dealt(hashes, shards).astype(np.uint64) << np.uint64(40)) | (hashes & _LOW)


_LOW = np.uint64((1 << 40) - 1)


def _anchors_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Position, hash, left and right of all anchors of a document shard, then its bytes and text offsets."""
    buf, offs = tk.strings(_one(table, "__text"))
    buf, offs = buf[offs[0] : offs[-1]], offs - offs[0]
    found, lo = [[np.zeros(0, t)] for t in (np.int64, np.uint64, np.int64, np.int64)], 0
    while lo < len(offs) - 1:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + STRETCH, "right")) - 1)
        for parts, values, shift in zip(found, anchors(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]), (offs[lo], 0, 0, 0), strict=True):
            parts.append(values + shift if shift else values)
        lo = hi
    return (*(np.concatenate(p) for p in found), buf, offs)


def _announced(shards: int):
    """(piece, home, anchors): the names of one document shard's anchors, five bytes each, for each string shard."""

    def announce(docs: pa.Table) -> pa.Table:
        names = np.unique(_named(_anchors_of(docs)[1], shards))
        home = docs.column("__home")[0].as_py()
        rows = []
        for piece, lo, hi in _runs((names >> np.uint64(40)).astype(np.int64)):
            part = np.ascontiguousarray(names[lo:hi]).view(np.uint8).reshape(-1, 8)[:, :5]
            rows.append((piece, home, part.tobytes()))
        columns = list(zip(*rows, strict=True)) or [()] * 3
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["piece", "home", "anchors"])

    return announce


def _shared(table: pa.Table) -> pa.Table:
    """(home, kind 0, names): the anchors of one string shard that several document shards have, for each of those."""
    piece = np.uint64(table.column("piece")[0].as_py())
    names, homes = [], []
    for home, raw in zip(table.column("home").to_pylist(), table.column("anchors").to_pylist(), strict=True):
        wide = np.zeros((len(raw) // 5, 8), np.uint8)
        wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
        names.append(wide.view(np.uint64).reshape(-1))
        homes.append(np.full(len(wide), home, np.int32))
    names, homes = np.concatenate(names), np.concatenate(homes)
    several = tk.repeated(names)
    names, homes = names[several] | (piece << np.uint64(40)), homes[several]
    order = np.lexsort((names, homes))
    names, homes = names[order], homes[order]
    rows = [(home, names[lo:hi].tobytes()) for home, lo, hi in _runs(homes)]
    return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([0] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["home", "kind", "payload"])


def _runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of each run of equal values."""
    edges = np.append(np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])), len(values)) if len(values) else np.zeros(1, np.int64)
    return zip(values[edges[:-1]].tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True)


def _contexts(docs: pa.Table, shared: np.ndarray, shards: int) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Distinct contexts of a document shard's shared anchors, then its bytes and text offsets.

    ``row`` is a context's bytes, ``left`` and ``right`` how many of them stand before and from the anchor, ``least``
    the smallest id with it. Each occurrence has a position ``at`` and a context ``number``.
    """
    at, hashes, left, right, buf, offs = _anchors_of(docs)
    ids = _ids(_one(docs, "__id"))
    owner = np.searchsorted(offs, at, "right") - 1
    names = _named(hashes, shards)
    # Besides the anchors that other shards have: those that documents of this shard share.
    _, first, number = np.unique(names, return_index=True, return_inverse=True)
    low, high = np.full(len(first), _LAST), np.full(len(first), -_LAST)
    np.minimum.at(low, number, ids[owner])
    np.maximum.at(high, number, ids[owner])
    some = (low < high)[number]
    if len(shared) and len(at):
        some |= shared[np.minimum(np.searchsorted(shared, names), len(shared) - 1)] == names
    at, hashes, left, right, owner = (x[some] for x in (at, hashes, left, right, owner))
    wide = np.concatenate([np.zeros(LENGTH, np.uint8), buf, np.zeros(LENGTH, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(wide, CONTEXT) if len(wide) >= CONTEXT else np.zeros((0, CONTEXT), np.uint8)
    row = view[at + LENGTH - (LENGTH - GRAM)].copy() if len(at) else np.zeros((0, CONTEXT), np.uint8)
    place = np.arange(CONTEXT)
    row[(place < (LENGTH - GRAM) - left[:, None]) | (place >= (LENGTH - GRAM) + right[:, None])] = 0
    # Contexts in the order of a hash of all their parts: the same numbers whatever the order of the rows.
    full = np.concatenate([row, left[:, None].astype(np.uint8), right[:, None].astype(np.uint8), np.zeros((len(row), 6), np.uint8)], axis=1).view(np.uint64) if len(row) else np.zeros((0, 11), np.uint64)
    key = np.zeros(len(full), np.uint64)
    for k in range(full.shape[1]):
        key = tk.mix(key ^ full[:, k])
    keys, first, number = np.unique(key, return_index=True, return_inverse=True)
    least = np.full(len(keys), _LAST)
    np.minimum.at(least, number, ids[owner])
    return {"at": at, "number": number, "owner": owner, "hash": hashes[first], "row": row[first], "left": left[first], "right": right[first], "least": least}, buf, offs


_ZSTD = pa.Codec("zstd", 1)


def _squeezed(rows: np.ndarray) -> bytes:
    """Contexts, compressed together: those of one passage overlap."""
    return _ZSTD.compress(np.ascontiguousarray(rows).tobytes(), asbytes=True)


def _sent(shards: int):
    """(piece, home, numbers, contexts, sides, least) of one document shard, to each string shard."""

    def send(docs: pa.Table, news: pa.Table) -> pa.Table:
        shared = _payload(news, 0)
        found, *_ = _contexts(docs, shared, shards)
        piece = _dealt(found["hash"], shards)
        order = np.argsort(piece, kind="stable")
        home = docs.column("__home")[0].as_py() if docs.num_rows else 0
        rows = [(p, home, order[lo:hi].astype(np.int32).tobytes(), _squeezed(found["row"][order[lo:hi]]), np.stack([found["left"], found["right"]], axis=1)[order[lo:hi]].astype(np.uint8).tobytes(), found["least"][order[lo:hi]].tobytes()) for p, lo, hi in _runs(piece[order])]
        columns = list(zip(*rows, strict=True)) or [()] * 6
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), *[pa.binary()] * 4), strict=True)], names=["piece", "home", "numbers", "contexts", "sides", "least"])

    return send


def _one(table: pa.Table, name: str) -> pa.Array:
    chunks = table.column(name).combine_chunks()
    return chunks if isinstance(chunks, pa.Array) else pa.concat_arrays(chunks.chunks)


def _payload(news: pa.Table, kind: int) -> np.ndarray:
    parts = [np.frombuffer(p, np.uint64) for k, p in zip(news.column("kind").to_pylist(), news.column("payload").to_pylist(), strict=True) if k == kind]
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *parts]))


def smallest_owners(rows: np.ndarray, left: np.ndarray, right: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct ``LENGTH``-byte strings of the contexts (fixed-width bytes), the smallest id of each, and for
    each context the number of the string that starts o bytes before its anchor (-1: none).

    The contexts' bytes stand one after another; strings are read off the suffix array, whose runs of common prefixes
    of ``LENGTH`` or more are equal strings.
    """
    starts, sizes = (LENGTH - GRAM) - left, left + right
    bounds = tk.sums(sizes)
    place = np.arange(CONTEXT)
    buf = rows[(place >= starts[:, None]) & (place < (starts + sizes)[:, None])]
    order, _ = suffix_array(words8(buf) >> np.uint64(24), 5)
    run = np.cumsum(common_prefixes(buf, order) < LENGTH, dtype=np.int32)
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    keep = (order + LENGTH <= bounds[1:][owner[order]]) & (order - bounds[:-1][owner[order]] <= left[owner[order]])
    order, run = order[keep], run[keep]
    number = np.full((len(rows), WINDOWS), -1, np.int32)
    if not len(order):
        return np.zeros(0, f"S{LENGTH}"), np.zeros(0, np.int64), number
    new = np.concatenate([[True], run[1:] != run[:-1]])
    first, of = np.flatnonzero(new), owner[order]
    number[of, left[of] - (order - bounds[:-1][of])] = np.cumsum(new) - 1
    strings = np.lib.stride_tricks.sliding_window_view(buf, LENGTH)[order[first]]
    return np.ascontiguousarray(strings).view(f"S{LENGTH}").reshape(-1), np.minimum.reduceat(least[of], first), number


def merged(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted string lists as one, each string with its smaller id; places by binary search."""
    (a, x), (b, y) = one, two
    at = np.searchsorted(a, b)
    same = np.zeros(len(b), bool)
    inside = at < len(a)
    same[inside] = a[at[inside]] == b[inside]
    x = x.copy()
    x[at[same]] = np.minimum(x[at[same]], y[same])
    return np.insert(a, at[~same], b[~same]), np.insert(x, at[~same], y[~same])


def _judged(table: pa.Table) -> pa.Table:
    """(home, kind 1, context number << 32 | bits): per context, the strings that also start in a smaller document."""
    homes, numbers, rows, sides, least = [], [], [], [], []
    for h, n, c, s, d in zip(*(table.column(k).to_pylist() for k in ("home", "numbers", "contexts", "sides", "least")), strict=True):
        numbers.append(np.frombuffer(n, np.int32))
        homes.append(np.full(len(numbers[-1]), h))
        rows.append(np.frombuffer(_ZSTD.decompress(c, len(numbers[-1]) * CONTEXT, asbytes=True), np.uint8).reshape(-1, CONTEXT))
        sides.append(np.frombuffer(s, np.uint8).reshape(-1, 2).astype(np.int64))
        least.append(np.frombuffer(d, np.int64))
    homes, numbers, rows, sides, least = (np.concatenate(x) for x in (homes, numbers, rows, sides, least))
    # The same context from several document shards is one here.
    _, first, number = np.unique(_rowkeys(rows, sides), return_index=True, return_inverse=True)
    rows, sides = rows[first], sides[first]
    smallest = np.full(len(first), _LAST)
    np.minimum.at(smallest, number, least)
    owners = string_owners(rows, sides[:, 0], sides[:, 1], smallest)
    # Each document shard compares with the smallest id that it has for the context itself.
    reached = np.zeros(len(number), np.uint64)
    for o in range(WINDOWS):
        reached |= (owners[number, o] < least).astype(np.uint64) << np.uint64(o)
    some = reached > 0
    packed = (numbers[some].astype(np.uint64) << np.uint64(32)) | reached[some]
    homes = homes[some]
    order = np.argsort(homes, kind="stable")
    out = [(home, packed[order[lo:hi]].tobytes()) for home, lo, hi in _runs(homes[order])]
    return pa.table([pa.array([r[0] for r in out], pa.int32()), pa.array([1] * len(out), pa.int32()), pa.array([r[1] for r in out], pa.binary())], names=["home", "kind", "payload"])


def _rowkeys(rows: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each context."""
    key = tk.mix(sides[:, 0].astype(np.uint64) * np.uint64(256) + sides[:, 1].astype(np.uint64))
    for k in range(0, CONTEXT, 8):
        key = tk.mix(key ^ np.ascontiguousarray(rows[:, k : k + 8]).view(np.uint64).reshape(-1))
    return key


def string_owners(rows: np.ndarray, left: np.ndarray, right: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Smallest id of the string that starts o bytes before each context's anchor, for o = 0 to 30 (else the largest)."""
    size = max(1, BLOCK // CONTEXT)
    blocks = [smallest_owners(rows[lo : lo + size], left[lo : lo + size], right[lo : lo + size], least[lo : lo + size]) for lo in range(0, len(rows), size)]
    strings, owners = blocks[0][:2]
    for block in blocks[1:]:
        strings, owners = merged((strings, owners), block[:2])
    out = []
    for own, own_least, number in blocks:
        best = np.append(owners[np.searchsorted(strings, own)] if len(blocks) > 1 else own_least, _LAST)
        out.append(best[number])
    return np.concatenate(out)


def _cut(keep: list[str], schema: pa.Schema, shards: int):
    """The rows of a document shard with their spans and what is left of their bytes."""

    def cut(docs: pa.Table, news: pa.Table) -> pa.Table:
        ids = _ids(_one(docs, "__id"))
        found, buf, offs = _contexts(docs, _payload(news, 0), shards)
        bits = np.zeros(len(found["least"]), np.uint64)
        packed = _payload(news, 1)
        bits[(packed >> np.uint64(32)).astype(np.int64)] = packed & np.uint64((1 << 32) - 1)
        at, number, owner = found["at"], found["number"], found["owner"]
        behind = ids[owner] > found["least"][number]  # a smaller document of this shard has the whole context
        change = np.zeros(len(buf) + 1, np.int64)
        for o in range(WINDOWS):
            fits = (o <= found["left"][number]) & (LENGTH - o <= found["right"][number])
            gone = at[fits & (behind | ((bits[number] >> np.uint64(o)) & np.uint64(1) == 1))] - o
            np.add.at(change, gone, 1)
            np.add.at(change, gone + LENGTH, -1)
        removed = np.cumsum(change)[:-1] > 0
        counts = np.diff(tk.sums(removed)[offs])
        edge = np.zeros(len(buf), bool)
        edge[1:] = removed[:-1]
        edge[offs[:-1][offs[:-1] < len(buf)]] = False
        begins = removed & ~edge
        kept = tk.binary_rows(buf[~removed], tk.sums(~removed)[offs]).cast(pa.binary())
        columns = [*(_one(docs, c) for c in keep), pa.array(np.diff(offs)), pa.array(counts), pa.array(np.diff(tk.sums(begins)[offs])), kept]
        return pa.table(columns, schema=schema)

    return cut


def remove_repeats(df: DataFrame, *, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (by default the id) with n_bytes, n_removed, n_spans (long) and kept (binary, what is left)."""
    spark = df.sparkSession
    kept = [c for c in ([id_col] if keep is None else keep) if c not in ("n_bytes", "n_removed", "n_spans", "kept")]
    total = df.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    shards = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_BYTES))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    pieces = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PIECE_BYTES))
    names = {c: f"__keep_{i}" for i, c in enumerate(kept)}
    docs = df.select(*(F.col(c).alias(n) for c, n in names.items()), F.col(id_col).cast("long").alias("__id"), F.pmod(F.xxhash64(id_col, text), F.lit(shards)).cast("int").alias("__home"), body.alias("__text"))
    announced = docs.groupBy("__home").applyInArrow(_announced(pieces), "piece int, home int, anchors binary")
    shared = announced.groupBy("piece").applyInArrow(_shared, "home int, kind int, payload binary")
    sent = docs.groupBy("__home").cogroup(shared.groupBy("home")).applyInArrow(_sent(pieces), "piece int, home int, numbers binary, contexts binary, sides binary, least binary")
    bits = sent.groupBy("piece").applyInArrow(_judged, "home int, kind int, payload binary")
    news = shared.unionByName(bits)
    out = T.StructType([*(docs.schema[n] for n in names.values()), *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType())])
    done = docs.groupBy("__home").cogroup(news.groupBy("home")).applyInArrow(_cut(list(names.values()), to_arrow_schema(out), pieces), out)
    return done.select(*(F.col(n).alias(c) for c, n in names.items()), "n_bytes", "n_removed", "n_spans", "kept")
