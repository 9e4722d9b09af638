"""What a signature costs on its way, and that no link depends on it."""

import random

import numpy as np
import pyarrow as pa

from roadtrace.llm import partenum_join as pj
from roadtrace.llm import textkit as tk

rnd = random.Random(11)


def prose(n):
    return [f"w{rnd.randrange(5000)}" for _ in range(n)]


def near(words):
    out = list(words)
    out[len(out) // 2] = "other"
    return out


TEXTS = [" ".join(t) for n in range(20, 300, 4) for words in [prose(n)] for t in (words, near(words))]


def plain_classes(texts):
    sets = [frozenset(tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))) for t in texts]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    return {i: (len(s), x) for i, (s, x) in enumerate(zip(sets, label, strict=True))}


def frame(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)


def found(spark):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in pj.classes(frame(spark)).collect()}


def test_a_signature_takes_twelve_bytes(spark):
    sets, bounds = pj.shingles(*tk.strings(pa.array(TEXTS)))
    n = len(pj.signatures(sets, bounds)[0])
    rows = pj._packed(frame(spark), "text", 64).collect()
    assert sum(len(r["signature"]) for r in rows) == 5 * n and not any(r["hot"] for r in rows)
    assert sum(len(r[c]) for r in rows for c in ("signature", "who", "code")) <= 12 * n
    assert found(spark) == plain_classes(TEXTS)


def test_nodes_of_equal_short_bits(spark, monkeypatch):
    """Different sets under the same bits that travel only add candidates."""
    monkeypatch.setattr(pj, "SHORT", (1 << 10) - 1)
    want = plain_classes(TEXTS)
    short = pj.node_ids(*pj.shingles(*tk.strings(pa.array(TEXTS)))) & np.uint64(pj.SHORT)
    same = [(a, b) for b in range(len(TEXTS)) for a in range(b) if short[a] == short[b]]
    assert len(same) > 5 and not any(want[a][1] == want[b][1] for a, b in same)
    assert found(spark) == want


def test_linked_sizes_look_near():
    """The byte of the size never parts sizes that may link, and parts most that may not."""
    size = np.arange(1, 30_000)
    code = ((np.log(size) / pj._STEP).astype(np.int64) & 255).astype(np.int64)
    far = lambda a, b: np.abs((code[a - 1] - code[b - 1] + 128) % 256 - 128) > pj._NEAR
    for k in (1.0, 1.1, 1.3, 4 / 3):
        assert not far(size[: 20_000], np.minimum((size[:20_000] * k).astype(int), 29_999)).any()
    assert far(np.arange(300, 10_000), np.arange(300, 10_000) * 7 // 5).mean() > 0.9
