r"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its distinct five-word shingles (words ``[^\x20\x09-\x0D]+``, A-Z lower-cased; fewer words
make one shingle). Sets that link at similarity 0.75 and have sizes a <= b differ in k <= (a + b) / 7 shingles.

**Bands and instances.** Sizes fall in bands up to 2, 5, 8, 14, 24, 42, ... (each 16/9 of the one before). Instance j serves the sets of
band j (role *lower*) and those above it that a set of band j can link with (role *upper*: up to 4/3 of the band's end), so two linked
sets always meet in an instance. Sets of up to 2 shingles link with equal sets only, which are one node anyhow.

**Two levels.** An instance deals the shingle domain by hash to n1 partitions of n2 subpartitions each, and a set's signatures are, for
each partition, its projections on every subset of n2 - k2 subpartitions. Of k differences at most floor(k / (k2 + 1)) partitions have
more than k2, and in any other partition some subset shows no difference. Bands up to 5 and 8 have (n1, n2, k2) = (1, 6, 1) and
(1, 6, 2); a band up to u has (0.185 u + 2.5, 3, 1): some 0.6 signatures a shingle.

**Empty projections** tell nothing and make no signature, so a set counts what it surely keeps: with G partitions of two or more used
subpartitions and E of one, k differences leave ``least_shared(G, E, k)`` of its three (or two) signatures a partition at least. If that
is none, the set adds a further round under another hash, until it is some. Of two linked sets the one with fewer rounds is sure of its
signatures in its last round, in which both take part; so no link is lost to chance at any size.

**Meeting.** Signatures meet in buckets. A group of at most ``SMALL`` sets gives its pairs with the number of signatures they share, and
a pair stays if that number, plus those it may share in larger groups, reaches what it must share. Larger groups make no pairs: members
that have enough signatures in such groups are tied to one of them. A signature that is common within a task leaves it as
tie candidates and ``SMALL`` + 1 entries, so no bucket holds all sets of a hot signature. The ties' components hold all linked sets
together; within them, blocks of ``BLOCK`` sets or ``BLOCK_SHINGLES`` shingles are compared exactly, two at a time, and only a spanning
forest of the links leaves a task. The links' components are the classes.

Equal sets are one node from the start, once per task, so hot copies cost one row a task. Nodes are 64-bit hashes of sets, shingles
64-bit hashes of word hashes. Signatures travel as packed arrays of 12 bytes each, one row per task and bucket: sets meet under the lower
48 bits of their node, and a pair or member found stands for all nodes that have these bits, so nodes that share them only add candidates.

Defined cases: null text and text without words have the empty set, link with nothing and are their own class; a
null id takes the class's smallest id, if any has one; rows may repeat; an empty table gives no rows; an input column with the name of
an output is replaced, other names may clash with anything.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadtrace.llm import textkit as tk
from roadtrace.llm.components import SALTS, components

SHINGLE = 5
#: Signature groups up to this size give pairs.
SMALL = 16
#: Sets and shingles of a block; two blocks are compared at once.
BLOCK = 256
BLOCK_SHINGLES = 1 << 17
#: Signatures a task holds before it hands them on.
FLUSH = 1 << 19
#: Bytes of text per bucket of signatures.
BUCKET_BYTES = 8 << 20


def _instances(largest: int = 1 << 40) -> np.ndarray:
    """(end of the band, n1, n2, k2) of each instance; the first has no signatures."""
    rows = [(2, 0, 1, 0), (5, 1, 6, 1), (8, 1, 6, 2)]
    while rows[-1][0] < largest:
        end = rows[-1][0] * 16 // 9
        rows.append((end, int(0.185 * end + 2.5), 3, 1))
    return np.array(rows, np.int64)


INSTANCES = _instances()


def least_shared(full: np.ndarray, single: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Signatures that survive ``k`` differences: a first one in a partition costs two, a second one a third where there is one."""
    more = np.clip(k - full - single, 0, full)
    return 3 * full + 2 * single - 2 * np.minimum(k, full + single) - more


def shingles(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingles of each text, sorted, and their n+1 bounds; at most 65,536 texts."""
    low = buf.copy()
    low[(buf >= 65) & (buf <= 90)] += 32
    starts, ends, firsts = tk.word_bounds(~tk.SPACE[buf], offs)
    words = tk.Spans(low).hash(starts, ends)
    counts = np.diff(firsts)
    owner = tk.owners(firsts)
    parts, owners = [], []
    if len(words) >= SHINGLE:
        whole = owner[SHINGLE - 1 :] == owner[: len(words) - SHINGLE + 1]
        parts.append(tk.ngrams(words, SHINGLE)[whole])
        owners.append(owner[: len(words) - SHINGLE + 1][whole])
    for n in range(1, SHINGLE):
        short = np.flatnonzero(counts == n)
        if len(short):
            at = firsts[:-1][short]
            h = np.full(len(short), n, np.uint64)
            for k in range(n):
                h = tk.mix(h * np.uint64(31) + words[at + k])
            parts.append(h)
            owners.append(short)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    keys, of = np.concatenate(parts), np.concatenate(owners).astype(np.uint16)
    order = np.argsort(keys)
    order = order[np.argsort(of[order], kind="stable")]
    keys, of = keys[order], of[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])])
    return keys[new], np.searchsorted(of[new], np.arange(len(offs)))


def node_ids(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set; 0 for the empty set only."""
    one, two = (np.diff(tk.sums(tk.mix(sets * np.uint64(2) + np.uint64(k)), np.uint64)[bounds]) for k in (0, 1))
    size = np.diff(bounds)
    out = tk.mix(one ^ tk.mix(two + size.astype(np.uint64))) | np.uint64(1)
    return np.where(size > 0, out, np.uint64(0))


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Chunks of at most 50,000 texts."""
    for at in range(0, len(column), 50_000):
        for lo, hi, buf, offs in tk.chunks(column.slice(at, 50_000)):
            yield at + lo, at + hi, buf, offs


def _role(size: np.ndarray, role: int) -> tuple[np.ndarray, np.ndarray]:
    """The instance of sets in the role (-1: none), and the most differences that a partner there can have."""
    band = np.searchsorted(INSTANCES[:, 0], size)
    if role == 0:
        return np.where(size > 2, band, -1), (size + size * 4 // 3) // 7
    end = INSTANCES[np.maximum(band - 1, 0), 0]
    return np.where((band > 1) & (size <= end * 4 // 3), band - 1, -1), (end + size) // 7


def signatures(sets: np.ndarray, bounds: np.ndarray, emit: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, set number * 2 + role) of all sets, and by role each set's last round and its full and single partitions there."""
    size = np.diff(bounds)
    out, who = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    told = np.zeros((2, 3, len(size)), np.int64)
    for role in (0, 1):
        instance, most = _role(size, role)
        for n2, k2 in ((6, 1), (6, 2), (3, 1)):
            rows = np.flatnonzero((instance >= 0) & (INSTANCES[instance, 2] == n2) & (INSTANCES[instance, 3] == k2))
            turn = 0
            while len(rows):
                n1 = INSTANCES[instance[rows], 1]
                first = tk.sums(n1 * n2)
                owner = np.repeat(np.arange(len(rows)), size[rows])
                salt = (instance[rows] * 4096 + turn + 1).astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
                h = tk.mix(sets[tk.ranges(bounds[rows], bounds[rows + 1])] + salt[owner])
                cell = first[owner] + (((h >> np.uint64(32)) * (n1 * n2)[owner].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
                total = np.zeros(first[-1], np.uint64)
                if emit:
                    np.add.at(total, cell, tk.mix(h + np.uint64(0x2545F4914F6CDD1D)))
                total = total.reshape(-1, n2)
                used = (np.bincount(cell, minlength=first[-1]) > 0).reshape(-1, n2)
                of = np.repeat(np.arange(len(rows)), n1)
                count = used.sum(axis=1)
                if emit:
                    place = (np.arange(len(of)) - (first // n2)[of]).astype(np.uint64) * np.uint64(64) + salt[of]
                    for number, left in enumerate(combinations(range(n2), k2)):
                        some = np.flatnonzero(count > used[:, left].sum(axis=1))
                        kept = total[some].sum(axis=1) - total[some][:, left].sum(axis=1)
                        out.append(tk.mix(kept ^ tk.mix(place[some] + np.uint64(number))))
                        who.append(rows[of[some]] * 2 + role)
                full = np.bincount(of[count >= 2], minlength=len(rows)) if n2 == 3 else (count > k2).astype(np.int64)
                single = np.bincount(of[count == 1], minlength=len(rows)) if n2 == 3 else np.zeros(len(rows), np.int64)
                told[role, 0, rows], told[role, 1, rows], told[role, 2, rows] = turn, full, single
                sure = least_shared(full, single, most[rows]) > 0 if n2 == 3 else full > 0
                rows, turn = rows[~sure], turn + 1
    return np.concatenate(out), np.concatenate(who), told


def _fresh(ids: np.ndarray, seen: set[int]) -> np.ndarray:
    """Whether each non-empty set is the first of its kind in the task."""
    return np.array([i and i not in seen and not seen.add(i) for i in ids.tolist()], bool)


#: What a set tells of itself as lower and as upper: last round, full and single partitions.
_TOLD = ("turn_0", "full_0", "single_0", "turn_1", "full_1", "single_1")


def set_nodes(docs: DataFrame, *, text: str = "text", keep: list[str]) -> DataFrame:
    """``keep`` columns with node (long, 0 for the empty set), n_shingles and, once a task for each set, ``_TOLD``."""
    taken = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = taken.drop("__text").withColumns({c: F.lit(0).cast("long") for c in ("node", "n_shingles")} | {c: F.lit(None).cast("int") for c in _TOLD}).schema

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for lo, hi, buf, offs in _pieces(batch.column(len(keep))):
                sets, bounds = shingles(buf, offs)
                ids = node_ids(sets, bounds).view(np.int64)
                old = ~_fresh(ids, seen)
                told = signatures(sets, bounds, emit=False)[2].reshape(6, -1)
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[: len(keep)], pa.array(ids), pa.array(np.diff(bounds)), *(pa.array(t.astype(np.int32), mask=old) for t in told)], names=schema.names)

    return taken.mapInArrow(nodes, schema)


#: Rows with ``hot`` hold whole group names of eight bytes and the nodes tied to them.
_PACKED = "bucket int, hot boolean, signature binary, who binary, code binary"
#: Bits of a node that travel with its signatures; the lowest, set in every node, gives way to the role.
SHORT = (1 << 48) - 1
#: Sizes travel as one byte, their logarithm in steps modulo 256: the sets of an instance are at most log(64 / 27) apart, 173 steps, and
#: linked ones ``_NEAR``, so no linked pair looks far apart.
_STEP = 0.005
_NEAR = int(np.log(4 / 3) / _STEP) + 2


def _bytes_of(values: np.ndarray, width: int) -> np.ndarray:
    """The lower ``width`` bytes of unsigned 64-bit numbers, a row each."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :width]


def _numbers_of(packed: list[bytes], width: int) -> np.ndarray:
    few = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, width)
    wide = np.zeros((len(few), 8), np.uint8)
    wide[:, :width] = few
    return wide.view(np.uint64).reshape(-1)


def _crowded(sig: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries whose signature has more than ``SMALL`` of them, and those entries that need not go to the bucket: all but the first
    ``SMALL`` + 1, lower sets first."""
    order = np.lexsort((who & np.uint64(1), sig))
    edges = np.append(np.flatnonzero(np.concatenate([[True], sig[order][1:] != sig[order][:-1]])), len(sig))
    length = np.diff(edges)
    big = np.flatnonzero(length > SMALL)
    return order[tk.ranges(edges[big], edges[big + 1])], order[tk.ranges(edges[big] + SMALL + 1, edges[big + 1])]


def _packed(docs: DataFrame, text: str, buckets: int) -> DataFrame:
    """Rows (bucket, signatures, owners, size codes) of all distinct sets of each task.

    A signature takes 12 bytes at any size of the input: five of its hash, since the bucket tells the rest, six of its
    set (``SHORT``), whose lowest bit is its role, and one of the set's size.
    """

    def emit(sig: np.ndarray, who: np.ndarray, code: np.ndarray) -> pa.RecordBatch:
        bucket = ((sig >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
        tied, spare = _crowded(sig, who)
        rows = []
        if len(tied):
            group = (bucket[tied] << 40) | (sig[tied] & np.uint64((1 << 40) - 1)).view(np.int64)
            to = (tk.mix(who[tied].copy()) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            edges = np.searchsorted(to[order], np.arange(buckets + 1))
            rows += [(int(b), True, group[order[lo:hi]].tobytes(), who[tied][order[lo:hi]].tobytes(), b"") for b in np.flatnonzero(np.diff(edges)) for lo, hi in [(edges[b], edges[b + 1])]]
            stays = np.ones(len(sig), bool)
            stays[spare] = False
            sig, who, code, bucket = sig[stays], who[stays], code[stays], bucket[stays]
        order = np.argsort(bucket, kind="stable")
        sig, who, code = sig[order], who[order], code[order]
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        five, six = _bytes_of(sig, 5), _bytes_of(who, 6)
        rows += [(int(b), False, five[lo:hi].tobytes(), six[lo:hi].tobytes(), code[lo:hi].tobytes()) for b in np.flatnonzero(np.diff(edges)) for lo, hi in [(edges[b], edges[b + 1])]]
        types = (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["bucket", "hot", "signature", "who", "code"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, count = [], 0
        for batch in batches:
            for _, _, buf, offs in _pieces(batch.column(0)):
                sets, bounds = shingles(buf, offs)
                ids = node_ids(sets, bounds)
                # Only sets that are new to the task are worked on.
                new = np.flatnonzero(_fresh(ids, seen))
                sets, bounds = tk.gather(sets, bounds, new)
                sig, who, _ = signatures(sets, bounds)
                code = ((np.log(np.maximum(1, np.diff(bounds))) / _STEP).astype(np.int64) & 255).astype(np.uint8)
                held.append((sig, (ids[new][who >> 1] & np.uint64(SHORT - 1)) | (who & 1).astype(np.uint64), code[who >> 1]))
                count += len(sig)
                if count >= FLUSH:
                    yield emit(*(np.concatenate(c) for c in zip(*held, strict=True)))
                    held, count = [], 0
        if count:
            yield emit(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(pack, _PACKED)


#: kind 0: a pair with its shared signatures; 1: a member a of the large group b. Sets go by their ``SHORT`` bits.
_MET = "kind int, a long, b long, shared int, role int"


def _meet(table: pa.Table) -> pa.Table:
    """Pairs and large-group members of one bucket."""
    named = table.filter(table.column("hot"))
    table = table.filter(pc.invert(table.column("hot")))
    tied = np.frombuffer(b"".join(named.column("signature").to_pylist()), np.int64)
    ties = np.frombuffer(b"".join(named.column("who").to_pylist()), np.uint64)
    sig = _numbers_of(table.column("signature").to_pylist(), 5)
    who = _numbers_of(table.column("who").to_pylist(), 6)
    code = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8)
    bucket = np.int64(table.column("bucket")[0].as_py()) if len(table) else np.int64(0)
    # Only signatures that meet another matter; the same set may come from several tasks.
    some = np.flatnonzero(tk.repeated(sig))
    sig, who, code = sig[some], who[some], code[some]
    order = np.lexsort((who, sig))
    sig, who, code = sig[order], who[order], code[order].astype(np.int64)
    fresh = np.ones(len(sig), bool)
    fresh[1:] = (sig[1:] != sig[:-1]) | (who[1:] != who[:-1])
    sig, who, code = sig[fresh], who[fresh], code[fresh]
    node, role = (who | np.uint64(1)).view(np.int64), (who & np.uint64(1)).astype(np.int64)
    edges = np.append(np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])), len(sig)) if len(sig) else np.zeros(1, np.int64)
    length = np.diff(edges)
    lows = np.add.reduceat(role == 0, edges[:-1]) if len(sig) else length
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in range(2, SMALL + 1):
        at = edges[:-1][(length == n) & (lows > 0)]
        for i in range(n):
            for j in range(i + 1, n):
                # A pair of two uppers counts in its own instance; partners' sizes must be within the threshold.
                both = ((role[at + i] == 0) | (role[at + j] == 0)) & (np.abs((code[at + i] - code[at + j] + 128) % 256 - 128) <= _NEAR) & (node[at + i] != node[at + j])
                left.append((at + i)[both])
                right.append((at + j)[both])
    x, y = np.concatenate(left), np.concatenate(right)
    swap = node[x] > node[y]
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    pair = np.stack([node[x], node[y], role[x] * 2 + role[y]], axis=1)
    order = np.lexsort(pair.T[::-1])
    pair = pair[order]
    first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]).any(axis=1)])) if len(pair) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(pair)))
    big = np.flatnonzero((length > SMALL) & (lows > 0))
    at = tk.ranges(edges[:-1][big], edges[1:][big])
    group = np.repeat((bucket << 40) | sig[edges[:-1][big]].view(np.int64), length[big]) if len(big) else np.zeros(0, np.int64)
    columns = {
        "kind": np.concatenate([np.zeros(len(first)), np.ones(len(at) + len(ties))]), "a": np.concatenate([pair[first, 0], node[at], (ties | np.uint64(1)).view(np.int64)]), "b": np.concatenate([pair[first, 1], group, tied]),
        "shared": np.concatenate([count, np.ones(len(at) + len(ties))]), "role": np.concatenate([pair[first, 2], role[at], (ties & np.uint64(1)).astype(np.int64)]),
    }
    return pa.table({n: v.astype(np.int64 if n in "ab" else np.int32) for n, v in columns.items()})


def _surely(full: Column, single: Column, k: Column) -> Column:
    """``least_shared`` as a column; at least 1, which also holds for the bands of one partition."""
    both = full + single
    return F.greatest(3 * full + 2 * single - 2 * F.least(k, both) - F.least(F.greatest(k - both, F.lit(0)), full), F.lit(1))


def _candidates(docs: DataFrame, info: DataFrame, text: str) -> DataFrame:
    """(a, b): ties between sets; linked sets are always in one component of the ties."""
    spark = docs.sparkSession
    info = info.withColumn("short", F.col("node").bitwiseAND(F.lit(SHORT)))
    total = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    met = _packed(docs, text, buckets).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_meet, _MET).checkpoint()
    # A set that several tasks hold names a group once.
    hot = met.filter("kind = 1").select("a", "b", "role").distinct()
    hot_counts = hot.groupBy(F.col("a").alias("short"), "role").agg(F.count("*").alias("hot"))
    pairs = met.filter("kind = 0").groupBy("a", "b", "role").agg(F.sum("shared").alias("shared"))
    pairs = pairs.withColumn("ra", F.shiftright("role", 1)).withColumn("rb", F.col("role").bitwiseAND(F.lit(1)))
    for side in "ab":
        known = info.select(F.col("short").alias(side), F.col("node").alias(f"node_{side}"), F.col("size").alias(f"size_{side}"), *(F.col(c).alias(f"{c}_{side}") for c in _TOLD))
        counts = hot_counts.select(F.col("short").alias(side), F.col("role").alias(f"r{side}"), F.col("hot").alias(f"hot_{side}"))
        pairs = pairs.join(known, side).join(counts, [side, f"r{side}"], "left")
        for told in ("turn", "full", "single"):
            pairs = pairs.withColumn(f"{told}_{side}", F.when(F.col(f"r{side}") == 0, F.col(f"{told}_0_{side}")).otherwise(F.col(f"{told}_1_{side}")))
    pairs = pairs.filter("4 * least(size_a, size_b) >= 3 * greatest(size_a, size_b)")
    # The signatures that a pair shares here, and at most in larger groups, must reach what the set with fewer rounds surely keeps.
    k = F.floor((F.col("size_a") + F.col("size_b")) / 7)
    sure_a, sure_b = (_surely(F.col(f"full_{x}"), F.col(f"single_{x}"), k) for x in "ab")
    needed = F.when(F.col("turn_a") < F.col("turn_b"), sure_a).when(F.col("turn_a") > F.col("turn_b"), sure_b).otherwise(F.greatest(sure_a, sure_b))
    reach = F.col("shared") + F.least(F.coalesce("hot_a", F.lit(0)), F.coalesce("hot_b", F.lit(0)))
    pairs = pairs.filter(reach >= needed).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    # The most differences to any partner in the role; a set with further rounds may owe its links to a partner's first.
    told = hot_counts.join(info, "short")
    turn, full, single = (F.when(F.col("role") == 0, F.col(f"{c}_0")).otherwise(F.col(f"{c}_1")) for c in ("turn", "full", "single"))
    most = F.when(F.col("role") == 0, F.expr("(size + size * 4 DIV 3) DIV 7")).otherwise(F.expr("(2 * size) DIV 7"))
    ready = told.filter((turn > 0) | (F.col("hot") >= _surely(full, single, most))).select(F.col("short").alias("a"), "node", "role")
    members = hot.join(ready, ["a", "role"]).select("node", F.col("b").alias("group"), "role")
    # The leader of a large group is a lower member; without one there is nothing to tie.
    leaders = members.filter("role = 0").groupBy("group").agg(F.min("node").alias("leader"))
    # A hot group's members are dealt to several tasks, each of which learns the leader.
    spread = leaders.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    members = members.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    ties = members.join(spread, ["group", "salt"]).filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    return pairs.union(ties)


def _links(mine: list[np.ndarray], others: list[np.ndarray] | None) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``mine``, or between ``mine`` and ``others``, as positions in mine + others."""
    sets = mine + (others or [])
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    keys, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    lists, ends = owner[order], tk.sums(np.bincount(code, minlength=len(keys)))
    own = tk.sums(size)
    side = np.arange(len(sets)) >= len(mine)
    found, waiting = [], np.ones(len(sets), bool)
    # Breadth first: each set is compared with all sets not yet reached.
    for seed in range(len(sets)):
        if not waiting[seed]:
            continue
        waiting[seed] = False
        queue = [seed]
        while queue:
            at = queue.pop()
            c = code[own[at] : own[at + 1]]
            common = np.bincount(lists[tk.ranges(ends[c], ends[c + 1])], minlength=len(sets))
            linked = waiting & (100 * common >= 75 * (size + size[at] - common))
            if others is not None:
                linked &= side != side[at]
            new = np.flatnonzero(linked)
            waiting[new] = False
            found += [(at, n) for n in new.tolist()]
            queue += new.tolist()
    return found


def _compare(table: pa.Table) -> pa.Table:
    """Links within a block, or between the two blocks of a pair."""
    node = table.column("node").to_numpy()
    side = table.column("side").to_numpy()
    sets: list[np.ndarray] = []
    for chunk in table.column("text").chunks:
        for lo, hi, buf, offs in _pieces(chunk):
            found, bounds = shingles(buf, offs)
            sets += [found[bounds[i] : bounds[i + 1]] for i in range(hi - lo)]
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    at = np.concatenate([a, b])
    pairs = _links([sets[i] for i in a], [sets[i] for i in b] if len(b) else None) if len(a) else []
    x, y = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
    return pa.table({"a": node[at[x]] if len(x) else pa.array([], pa.int64()), "b": node[at[y]] if len(y) else pa.array([], pa.int64())})


def _texts(docs: DataFrame, text: str) -> DataFrame:
    """(node, text) of each distinct non-empty set, once a task: a hot class sends one text from each task."""

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for lo, hi, buf, offs in _pieces(batch.column(0)):
                ids = node_ids(*shingles(buf, offs)).view(np.int64)
                some = pa.array(_fresh(ids, seen))
                yield pa.RecordBatch.from_arrays([pa.array(ids).filter(some), batch.column(0).slice(lo, hi - lo).filter(some)], names=["node", "text"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(once, "node long, text string")


def _nodes(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(__id, __hash, node, n_shingles and ``_TOLD``) of each row, cut off from the texts; __hash tells a row's text."""
    tk.checkpoint_dir(docs.sparkSession)
    named = docs.select(F.col(id_col).alias("__id"), F.xxhash64(F.col(text).cast("string")).alias("__hash"), F.col(text).alias("__body"))
    return set_nodes(named, text="__body", keep=["__id", "__hash"]).checkpoint()


def set_links(docs: DataFrame, nodes: DataFrame, *, text: str = "text") -> DataFrame:
    """(a, b): a spanning forest of the links between distinct sets of ``docs``, as nodes."""
    info = nodes.filter("turn_0 IS NOT NULL").groupBy("node").agg(F.max("n_shingles").alias("size"), *(F.max(c).alias(c) for c in _TOLD))
    ties = components(_candidates(docs, info, text)).join(info.select("node", "size"), "node")
    sizes = ties.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = ties.join(sizes, "label").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("size")
    # One text for each tied set: rows with the same set are the same set whichever text stands for it.
    # Always a merge join: the tied sets grow with the input, and texts take the same way at every size.
    tied = _texts(docs, text).join(placed.hint("merge"), "node")
    sets = tied.groupBy("node").agg(F.min("text").alias("text"), *(F.first(c).alias(c) for c in ("label", "block", "blocks")))
    # Block i meets itself and every other block once: as side 0 of (i, j) for j >= i, as side 1 of (j, i) for j < i.
    meet = F.explode(F.expr("transform(sequence(0, blocks - 1), j -> struct(least(block, j) AS i, greatest(block, j) AS j, IF(j < block, 1, 0) AS side))"))
    spread = sets.withColumn("at", meet).select("label", "at.i", "at.j", "at.side", "node", "text")
    return spread.groupBy("label", "i", "j").applyInArrow(_compare, "a long, b long").checkpoint()


def classes(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of every row (by default the id) with n_shingles and component_id."""
    kept = [c for c in ([id_col] if keep is None else keep) if c not in ("n_shingles", "component_id")]
    nodes = _nodes(docs, id_col, text)
    labels = components(set_links(docs, nodes, text=text))
    ids = nodes.filter("node <> 0").groupBy("node").agg(F.min("__id").alias("__least"))
    named = ids.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "__least")
    smallest = named.groupBy("label").agg(F.min("__least").alias("component_id"))
    by_node = named.join(smallest, "label").select("node", "component_id")
    rows = nodes
    if kept != [id_col]:
        # The kept columns under names of their own, beside the row's node.
        own = docs.select(*(F.col(c).alias(f"__keep_{i}") for i, c in enumerate(kept)), F.col(id_col).alias("__id"), F.col(text).alias("__body"))
        rows = set_nodes(own, text="__body", keep=[*(f"__keep_{i}" for i in range(len(kept))), "__id"])
    # Rows of the empty set have no partner in the join; a hash of the id spreads them.
    spread = rows.withColumn("__key", F.when(F.col("node") == 0, F.xxhash64("__id")).otherwise(F.col("node")))
    joined = spread.join(by_node.withColumnRenamed("node", "__key"), "__key", "left")
    out = [F.col("__id" if kept == [id_col] else f"__keep_{i}").alias(c) for i, c in enumerate(kept)]
    return joined.select(*out, "n_shingles", F.when(F.col("node") == 0, F.col("__id")).otherwise(F.col("component_id")).alias("component_id"))


def representatives(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their class: one row with its smallest id; rows of the empty set all stay.

    The choice is made on narrow rows; the texts then meet it by id and text hash, so a hot class is spread over its ids. Rows that
    repeat an id with the same set: the one with the smallest text hash stays, once.
    """
    last = F.lit((1 << 63) - 1)
    nodes = _nodes(docs, id_col, text).select(F.coalesce("__id", last).alias("__own"), "__hash", "node", "n_shingles", *_TOLD)
    labels = components(set_links(docs, nodes, text=text))
    least = nodes.filter("node <> 0").groupBy("node").agg(F.min(F.struct("__own", "__hash")).alias("least"))
    named = least.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    chosen = named.groupBy("label").agg(F.min("least").alias("c")).select("c.__own", "c.__hash", F.lit(1).alias("__once"))
    empty = nodes.filter("node = 0").select("__own", "__hash", F.lit(0).alias("__once")).distinct()
    names = {c: f"__doc_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*names.values()).withColumn("__own", F.coalesce(F.col(names[id_col]), last)).withColumn("__hash", F.xxhash64(F.col(names[text]).cast("string")))
    met = rows.join(chosen.union(empty), ["__own", "__hash"])
    place = F.row_number().over(Window.partitionBy("__own", "__hash").orderBy(names[text]))
    return met.withColumn("__place", place).filter("__once = 0 OR __place = 1").select(*(F.col(n).alias(c) for c, n in names.items()))
