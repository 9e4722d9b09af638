"""Spelling variants against brute force over all pairs; the gram bound; defined cases."""

import itertools
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadtrace.llm import spelling as sp
from roadtrace.llm.queries import op11_spelling_variants


def _near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def _plain_counts(rows, least_points, least_count):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= least_points and n >= least_count}


def _plain(counts, ratio=5):
    near = {w: [] for w in counts}
    by_rest = {}
    for w in counts:
        for i in range(len(w)):
            by_rest.setdefault(w[:i] + w[i + 1 :], set()).add(w)
        by_rest.setdefault(w, set()).add(w)
    for group in by_rest.values():
        for a, b in itertools.combinations(group, 2):
            if _near(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(set(others), key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(set(near[w])), None if form[w] is None else counts[form[w]]))
    return out


def test_op11_equals_brute_force(spark):
    root = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect()]
    wanted = _plain(_plain_counts(rows, 6, 5))
    assert {tuple(r) for r in op11_spelling_variants(spark, root).collect()} == wanted
    assert any(r[1] for r in wanted)


def _words(seed, letters, most, least=2, longest=12):
    rng = np.random.default_rng(seed)
    words = {"".join(rng.choice(list(letters), size=rng.integers(least, longest))) for _ in range(most)}
    for w in list(words)[: most // 2]:
        i = int(rng.integers(0, len(w) + 1))
        words |= {w[:i] + str(rng.choice(list(letters))) + w[i:], w[:i] + "x" + w[i + 1 :], w[:i] + w[i + 1 :]}
    return sorted(w for w in words if len(w) >= least)


@pytest.mark.parametrize("letters, floor", [("ab", 1), ("abcdefgh", 2), ("abéÿ", 16)])
def test_near_pairs_of_dense_word_lists(spark, monkeypatch, letters, floor):
    monkeypatch.setattr(sp, "FLOOR", floor)
    rng = np.random.default_rng(1)
    counts = {w: int(rng.integers(1, 400)) for w in _words(2, letters, 400)}
    table = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert {tuple(r) for r in sp.variants(table).collect()} == _plain(counts)


def _dictionary(rng, letters):
    every = np.unique(rng.integers(97, 97 + letters, size=(40, 3)).astype(np.int64) @ np.array([65536, 256, 1]))
    pairs = np.unique(every & 0xFFFF)
    some = np.sort(np.concatenate([rng.permutation(pairs)[: rng.integers(0, 7)], rng.permutation(every)[: rng.integers(0, 11)]]))
    return sp.Dictionary(some, np.ones(len(some), np.int64))


@pytest.mark.parametrize("high", [4, 3, 2])
def test_words_one_edit_apart_share_a_key(high):
    """Whatever the dictionary: under one key of the first kind and one of any kind."""
    rng = np.random.default_rng(high)
    for _ in range(150):
        dictionary = _dictionary(rng, 4)
        word = "".join(rng.choice(list("abcd"), size=rng.integers(2, 11)))
        edits = {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in "abz"} | {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in ("", "b", "z")}
        listed = [word, *sorted(e for e in edits if e and e != word)]
        buf, bounds = sp.marked(listed)
        (owner, key, _, _), plain = sp.left_by_edits(sp.decompose(buf, bounds, dictionary, high), bounds, high)
        keys = [(set(key[:plain][owner[:plain] == i]), set(key[owner == i])) for i in range(len(listed))]
        for other, (first, every) in zip(listed[1:], keys[1:], strict=True):
            assert (keys[0][0] & every) or (first & keys[0][1]), (word, other)


def test_no_edit_affects_all_grams_of_a_word_of_six_points():
    rng = np.random.default_rng(9)
    for high, least in ((3, 6), (2, 2)):
        for _ in range(300):
            words = ["".join(rng.choice(list("ab"), size=rng.integers(least, least + 4))) for _ in range(20)]
            buf, bounds = sp.marked(words)
            found = sp.decompose(buf, bounds, _dictionary(rng, 2), high)
            (word, _, first, behind), _ = sp.left_by_edits(found, bounds, high)
            assert (behind - first < np.diff(found.bounds)[word]).all() and (behind - first <= high).all()


def test_defined_cases(spark):
    long = "longword" * 400
    rows = [(1, "Kitten kitten KITTEN"), (1, "kitten sittEn"), (None, "kitten kitten"), (2, None), (3, ""), (4, "kitten1sitten,sitten_sitten sitten"), (5, long), (6, long[:-1] + "t " + long + "İ"), (7, "Éclair éclair Éclair ×éclair÷")]
    rows += [(8, " ".join(["kitten"] * 30)), (9, " ".join(["mittens"] * 3)), (9, " ".join(["mitten"] * 6))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit(3)).repartition(4)
    got = {tuple(r) for r in sp.variants(sp.word_counts(docs, rule=sp.misspell, least_count=1)).collect()}
    assert got == _plain(_plain_counts(rows, 6, 1))
    assert {r[0]: r[1] for r in got}["mitten"] == "kitten"
    assert sp.variants(sp.word_counts(docs.limit(0))).count() == 0
    with pytest.raises(ValueError):
        sp.word_counts(docs, least_points=1)


def test_pieces_of_a_long_text_end_between_words(monkeypatch):
    monkeypatch.setattr(sp, "PIECE", 10)
    text = "abcdefghijklmnopqrstuvwxyz, kitten kitten of the" + " kitten" * 50 + " " + "z" * 100
    assert sp._runs(text, re.compile(f"[{sp.LETTERS}]{{2,}}")) == Counter(re.findall(f"[{sp.LETTERS}]{{2,}}", text))


def test_a_task_passes_on_what_it_counted(spark, monkeypatch):
    monkeypatch.setattr(sp, "HELD_WORDS", 3)
    rows = [(i, "alphabet lettering kindness weather formation") for i in range(20)]
    got = {r["word"]: r["n"] for r in sp.word_counts(spark.createDataFrame(rows, "doc_id long, text string"), least_count=1).collect()}
    assert got == dict.fromkeys("alphabet lettering kindness weather formation".split(), 20)
