"""Line dedup against a plain version; filters, reversible insertions and deletions, defined cases."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadtrace.llm import line_dedup as ld
from roadtrace.llm.queries import op13_cuckoo_line_dedup


def _plain(rows, least=3):
    """[(doc_id, n_lines, n_dropped, kept)] by sets of ids a key; None is the smallest id."""
    rank = lambda i: -1 if i is None else i
    holders = {}
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line))
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(rank(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < least or rank(i) == max(holders[key(x)])]
        out.append((rank(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def _got(frame):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in frame.collect())


LINES = ["short", "", "A line that comes again and again", "  a LINE that comes again and again\t", "é" * 20, "é" * 19, "É" * 20, "x" * 20, "X" * 20, " " * 40, "one more line of some length", " not a blank of the list here", "z" * 5000, "tail \r"]


def _documents(n, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, "\n".join(rng.choice(LINES, size=rng.integers(0, 9)))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, "\n"), (None, "\n".join(LINES)), (3, rows[3][1]), (3, rows[3][1]), (3, LINES[2])]


SCHEMA = "doc_id long, text string"


def test_op13_equals_a_plain_version(spark):
    root = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect()]
    wanted = [(i, n, d, hashlib.sha256(k.encode()).hexdigest()) for i, n, d, k in _plain(rows)]
    assert sorted(tuple(r) for r in op13_cuckoo_line_dedup(spark, root).collect()) == wanted
    assert any(r[2] for r in wanted)


@pytest.mark.parametrize("least", [2, 3])
def test_defined_cases(spark, least):
    rows = _documents(40)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    extra = docs.withColumn("n_lines", F.lit("x")).withColumn("hi", F.lit(7)).withColumn("shard", F.lit(8))
    out = ld.dedup_lines(extra, least=least)
    assert _got(out) == _plain(rows, least) and out.select("hi", "shard").distinct().count() == 1
    assert ld.dedup_lines(docs.limit(0)).count() == 0
    replaced = ld.dedup_lines(docs, kept="text", least=least)
    assert sorted(r["text"] for r in replaced.collect()) == sorted(r[3] for r in _plain(rows, least))


def _prints(state):
    """The multiset of fingerprints of each shard, whatever their slots."""
    return {r["shard"]: Counter(v for v in np.frombuffer(r["table"], np.uint16).tolist() if v) for r in state.filters.collect()}


def _totals(state):
    return Counter({(r["hi"], r["lo"], r["doc"]): r["n"] for r in state.refs.groupBy("hi", "lo", "doc").agg(F.sum("n").alias("n")).collect()})


def test_insertions_and_deletions_are_reversible(spark):
    rows = _documents(60, seed=4)
    docs = spark.createDataFrame(rows, SCHEMA)
    first, second = docs.filter("coalesce(doc_id, 0) % 3 <> 1"), docs.filter("coalesce(doc_id, 0) % 3 = 1")
    start = ld.insert(ld.empty(spark, expected=200), first)
    both = ld.insert(start, second)
    assert _got(ld.apply(both, docs)) == _plain(rows)
    back = ld.delete(both, second.select("doc_id"))
    assert _prints(back) == _prints(start) and _totals(back) == _totals(start)
    assert _got(ld.apply(back, first)) == _plain([r for r in rows if (r[0] or 0) % 3 != 1])
    # The other order, and in again.
    swapped = ld.insert(ld.delete(both, first.select("doc_id")), first)
    assert _prints(swapped) == _prints(both) and _got(ld.apply(swapped, docs)) == _plain(rows)
    nothing = ld.delete(ld.delete(both, second.select("doc_id")), first.select("doc_id"))
    assert not any(c for c in _prints(nothing).values()) and not _totals(nothing)


def test_the_filter_clears_most_keys(spark):
    """Only keys that may have three references are looked up."""
    rows = [(i, f"a line of document number {i} alone\nand {'one' if i < 9 else i} that may be shared by some") for i in range(500)]
    state = ld.insert(ld.empty(spark, expected=1000), spark.createDataFrame(rows, SCHEMA))
    assert 1 <= state.hot.count() <= 5


def test_full_filters_are_made_again(spark, monkeypatch):
    monkeypatch.setattr(ld, "SHARD_KEYS", 64)
    rows = [(i, "\n".join(f"line {j} of some document or other" for j in range(i, i + 12))) for i in range(150)]
    docs = spark.createDataFrame(rows, SCHEMA)
    state = ld.empty(spark, expected=10)
    for lo, hi in ((0, 9), (9, 40), (40, 150)):
        state = ld.insert(state, docs.filter(F.col("doc_id").between(lo, hi - 1)))
    assert state.shards > 1 and _got(ld.apply(state, docs)) == _plain(rows)
    back = ld.delete(state, docs.select("doc_id"))
    assert not any(c for c in _prints(back).values())


def test_cuckoo_filter_counts_copies():
    rng = np.random.default_rng(7)
    hi, lo = rng.integers(-(1 << 62), 1 << 62, size=(2, 3000))
    times = rng.integers(1, 4, size=3000)
    held = ld.Cuckoo.empty(int(times.sum()))
    assert held.add(hi, lo, times)
    assert (held.copies(hi, lo) >= times).all() and (held.copies(hi, lo) > times).mean() < 0.01
    other = rng.integers(-(1 << 62), 1 << 62, size=(2, 3000))
    assert (held.copies(*other) > 0).mean() < 0.01
    held.remove(hi[:1500], lo[:1500], times[:1500])
    assert (held.copies(hi[1500:], lo[1500:]) >= times[1500:]).all() and np.count_nonzero(held.table) == times[1500:].sum()
    held.remove(hi[1500:], lo[1500:], times[1500:])
    assert not held.table.any()
    assert not held.add(hi, lo, times * 9)


def test_one_line_in_every_document_and_a_very_long_text(spark):
    long = "\n".join(f"row {i} of one very long text" for i in range(200_000))
    rows = [(i, "the same boilerplate line everywhere") for i in range(3000)] + [(5000, long), (5001, long), (5002, long[: len(long) // 2])]
    out = ld.dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(4)).select("doc_id", "n_lines", "n_dropped", F.length("kept").alias("size"))
    got = {r["doc_id"]: tuple(r)[1:] for r in out.collect()}
    assert got[2999] == (1, 0, 36) and all(got[i] == (1, 1, 0) for i in range(2999))
    half = long[: len(long) // 2]
    assert got[5002] == (half.count("\n") + 1, 0, len(half)) and got[5001][:2] == got[5000][:2] == (200_000, half.count("\n"))
