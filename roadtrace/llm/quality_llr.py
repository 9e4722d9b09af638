r"""Quality rules: surface counts, then a hashed n-gram log-likelihood ratio of trusted text against the raw corpus.

Words are ``[^\x20\x09-\x0D]+``. Byte n-grams (``GRAM``, within a text) are hashed to ``BUCKETS``; the raw multinomial counts every
document, the target multinomial every other trusted one (documents labelled good, in the order of their ids' hashes). A
document's score is the mean over its n-grams of log p_target - log p_raw, with one added to each count. The threshold
is the cut that best parts the other trusted documents from all that are labelled bad; it is a number, and each
document is on one side of it. No label is left out, however many there are.

Trusted texts meet their labels in a merge join, so texts are shuffled once; for the threshold only scores meet labels. Places among
the trusted and sums below a score are counted within bins of the hash and of the score; only the coarsest bins, some 1,300 at most, pass through one task.

Counts leave a task as sparse (bucket, raw, target) rows and are summed by bucket, so what reaches the driver is
``BUCKETS`` rows whatever the input. The model goes to the tasks as a broadcast variable of that size.

Log ratios are whole numbers of 1 / ``SCALE``, so a text's sum is exact and doesn't depend on the texts beside it: equal texts
have equal scores under any partitioning. Lines and windows are compared by their bytes, not by hashes alone.

Defined cases: null text has no words, so it fails the word floor; without good labels every document that passes the
base rules is kept; with good labels alone the cut is their lowest score; an id labelled
both good and bad counts as good; repeated rows are judged each by
itself; an empty table gives no rows; an input column with the name of an output is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadtrace.llm import textkit as tk

BUCKETS = 1 << 16
GRAM = 4
#: Steps of a log ratio; sums of 64-bit integers stay exact up to some 10**11 n-grams a text.
SCALE = 1 << 20
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Model:
    """Log ratio of each bucket in steps of 1 / ``SCALE``, and the score from which a document is kept."""

    ratio: np.ndarray
    threshold: float


def _grams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the byte n-gram at each position, and whether it lies within one text."""
    n = len(buf) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    key = buf[:n].astype(np.uint32)
    for k in range(1, GRAM):
        key |= buf[k : n + k].astype(np.uint32) << np.uint32(8 * k)
    whole = np.ones(n, bool)
    for k in range(1, GRAM):
        at = offs[1:-1] - k
        whole[at[(at >= 0) & (at < n)]] = False
    return ((key * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64), whole


def measure(buf: np.ndarray, offs: np.ndarray, ratio: np.ndarray | None = None) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The counts of each text of a chunk, and its score under ``ratio``."""
    spans = tk.Spans(buf)
    inside = ~tk.SPACE[buf]
    starts, ends, firsts = tk.word_bounds(inside, offs)
    texts, n_words = len(offs) - 1, np.diff(firsts)
    owner = tk.owners(firsts)

    l_starts, l_ends, l_owner = tk.line_bounds(buf, offs)
    worded = np.searchsorted(starts, l_ends) > np.searchsorted(ends, l_starts, "right")
    l_starts, l_ends, l_owner = l_starts[worded], l_ends[worded], l_owner[worded]
    line, n_lines = spans.numbers(l_starts, l_ends, l_owner)
    owner_of = np.zeros(n_lines, np.int64)
    owner_of[line] = l_owner
    distinct = np.bincount(owner_of, minlength=texts)

    again = np.zeros(len(starts) + 2, bool)
    if len(starts) > 2:
        whole = owner[2:] == owner[:-2]
        # Words are numbered within their text, so a window's numbers tell its text too.
        word, n = spans.numbers(starts, ends, owner)
        pair = word[:-2] * n + word[1:-1]
        if n >= 1 << 21:
            pair = np.unique(pair, return_inverse=True)[1]
        twice = np.flatnonzero(whole)[tk.repeated((pair * n + word[2:])[whole])]
        for k in range(3):
            again[twice + k] = True
    score = np.zeros(texts)
    if ratio is not None:
        bucket, whole = _grams(buf, offs)
        total = tk.sums(ratio[bucket] * whole)
        score = np.diff(total[np.minimum(offs, len(bucket))]) / (SCALE * np.maximum(1, np.diff(offs) - GRAM + 1))
    counts = {
        "n_words": n_words,
        "word_chars": np.diff(tk.sums(inside & ((buf & 0xC0) != 0x80))[offs]),
        "n_symbols": np.diff(tk.sums(_SYMBOL[buf])[offs]),
        "n_dup_lines": np.bincount(l_owner, minlength=texts) - distinct,
        "n_repeat_words": np.diff(tk.sums(again[: len(starts)])[firsts]),
    }
    return counts, score


def _sampled(labels: DataFrame, value: int, id_col: str, label: str, limit: int) -> list[int]:
    """The first ids of a class in the order that ``_roles`` deals them in; for a look at small tables, the fit doesn't use it."""
    rows = labels.filter(F.col(label) == value).filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id")).distinct()
    return [r["id"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(limit).collect()]


def _below(rows: DataFrame, order: list[str], levels: list[Column], values: list[str]) -> DataFrame:
    """``rows`` with ``<value>_below``, the sum of each of ``values`` over the rows before in ``order``, which must tell rows apart.

    ``levels`` are bins from coarse to fine, none of which falls along the order; only the coarsest bins, one row each, pass through one task.
    """
    keys = [f"__bin_{i}" for i in range(len(levels))]
    rows = rows.withColumns(dict(zip(keys, levels, strict=True)))

    def before(inside: list[str], along: list[str]) -> list[Column]:
        window = Window.partitionBy(*inside).orderBy(*along).rowsBetween(Window.unboundedPreceding, -1)
        return [F.coalesce(F.sum(v).over(window), F.lit(0)) for v in values]

    out = rows.withColumns({f"{v}_below": c for v, c in zip(values, before(keys, order), strict=True)})
    for n in range(len(keys), 0, -1):
        sums = rows.groupBy(*keys[:n]).agg(*(F.sum(v).alias(v) for v in values))
        sums = sums.select(*keys[:n], *(c.alias(f"__{v}") for v, c in zip(values, before(keys[: n - 1], keys[n - 1 : n]), strict=True)))
        out = out.join(sums, keys[:n]).withColumns({f"{v}_below": F.col(f"{v}_below") + F.col(f"__{v}") for v in values}).drop(*(f"__{v}" for v in values))
    return out.drop(*keys)


def _roles(labels: DataFrame, id_col: str, label: str) -> DataFrame:
    """(id, good, place) of all labelled ids; place counts the good from 0 by the hash of their id and is null for the bad."""
    rows = labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label).cast("int").alias("good")).checkpoint()
    good = rows.filter("good = 1").withColumn("hash", F.xxhash64("id"))
    placed = _below(good, ["hash", "id"], [F.shiftright("hash", 56), F.shiftright("hash", 44)], ["good"]).select("id", "good", F.col("good_below").alias("place"))
    return placed.union(rows.filter("good = 0").select("id", "good", F.lit(None).cast("long"))).checkpoint()


def _tally(texts: DataFrame) -> np.ndarray:
    """How often each bucket stands in the one column of ``texts``; ``BUCKETS`` rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, buf, offs in tk.chunks(batch.column(0)):
                bucket, whole = _grams(buf, offs)
                total += np.bincount(bucket[whole], minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    rows = texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS)
    out[rows["bucket"]] = rows["n"]
    return out


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Counts over all of ``docs``; the trusted and the bad are all ids of ``labels`` (1 and 0).

    Every other trusted document gives the target counts; the rest, unseen by them, place the threshold.
    """
    tk.checkpoint_dir(docs.sparkSession)
    taken = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    roles = _roles(labels, id_col, label)
    # Always a merge join: the labelled ids grow with the input, and texts take the same way at every size.
    trusted = roles.filter("place % 2 = 0").select("id").hint("merge")
    raw, target = _tally(taken.select("text")), _tally(taken.join(trusted, "id", "left_semi").select("text"))
    exact = np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))
    ratio = np.rint(exact * SCALE).astype(np.int64)
    if not target.sum():
        return Model(ratio, -np.inf)
    # A single trusted document takes both parts.
    unseen = "place % 2 = 1" if len(roles.filter("good = 1").head(2)) == 2 else "good = 1"
    scored = apply(taken.filter("id IS NOT NULL"), Model(ratio, -np.inf), keep=["id"]).filter("NOT base_failed").select("id", "score")
    held = scored.join(roles.filter(f"good = 0 OR {unseen}"), "id").groupBy("id").agg(F.min("score").alias("score"), F.min("good").alias("good"))
    return Model(ratio, cut(held))


def cut(held: DataFrame) -> float:
    """The lowest cut with the largest sum of kept share of the good and dropped share of the bad; ``held`` has score and good (1 or 0).

    All sums are of whole numbers, so ties are exact.
    """
    at = held.groupBy("score").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")).checkpoint()
    all_good, all_bad, least = at.agg(F.sum("good"), F.sum("bad"), F.min("score")).first()
    if not all_good:
        return -np.inf
    if not all_bad:
        return least
    # Scores are means of log ratios, within some 40 of 0.
    below = _below(at, ["score"], [F.floor(F.col("score") * steps) for steps in (16, 1 << 16)], ["good", "bad"])
    good, bad = (F.col(f"{c}_below").cast("decimal(18,0)") for c in ("good", "bad"))
    gain = bad * F.lit(all_good).cast("decimal(18,0)") - good * F.lit(all_bad).cast("decimal(18,0)")
    first = below.orderBy(gain.desc(), "score").first()["score"]
    last = at.filter(F.col("score") < first).agg(F.max("score")).first()[0]
    # Half way to the score below, unless no number lies between.
    return first if last is None or (first + last) / 2 <= last else (first + last) / 2


def apply(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the counts, score (double), base_failed and kept (boolean); all rows stay, and the columns of ``keep`` (by default all)."""
    added = T.StructType([*(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("score", T.DoubleType()), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])
    docs = docs.drop(*added.names)
    inside = docs.columns if keep is None else keep
    schema = T.StructType([*(docs.schema[c] for c in inside), *added.fields])
    at = len(inside) if keep is not None else docs.columns.index(text)
    if keep is not None:
        docs = docs.select(*keep, F.col(text).alias("__text"))
    # BUCKETS numbers: a bounded broadcast.
    sent, threshold = docs.sparkSession.sparkContext.broadcast(model.ratio), model.threshold

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in tk.chunks(batch.column(at)):
                counts, score = measure(buf, offs, sent.value)
                failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])
                columns = [*(pa.array(counts[c].astype(np.int64)) for c in COUNTS), pa.array(score), pa.array(failed), pa.array(~failed & (score >= threshold))]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[: len(inside)], *columns], names=schema.names)

    return docs.mapInArrow(judge, schema)
