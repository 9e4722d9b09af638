"""Dedup, joins, decontamination, tokens, rules and language against brute force, with awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from roadtrace.llm import bpe_codec, decontaminate, partenum_join, quality_llr, suffix_dedup, textkit
from roadtrace.llm import queries as q
from roadtrace.llm.components import components
from roadtrace.llm.suffixes import common_prefixes, suffix_array, words8

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rnd = random.Random(7)
WORDS = [f"{a}{b}" for a in ("ka", "to", "mi", "nure", "sol", "é") for b in ("ra", "n", "li", "st", "ov", "w2")]


def prose(n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def edited(text, share):
    return " ".join(w if rnd.random() > share else rnd.choice(WORDS) + "x" for w in text.split(" "))


BASE = [prose(n) for n in (3, 5, 8, 30, 60, 120, 200)]
TEXTS = [
    None, "", "  \n", "a", "b a", *BASE, BASE[4], BASE[4].upper(), edited(BASE[5], 0.02), edited(BASE[5], 0.02), edited(BASE[6], 0.04), edited(BASE[6], 0.1),
    BASE[3] + " " + BASE[6], "x" * 300, "x" * 170 + prose(20), prose(2000), BASE[4] + "\n" + BASE[4], "é" * 60, "日本語 " * 30,
]


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("docs"))
    rows = [(i * 3 % 97, t, "en" if i % 2 else "de", "s", 0) for i, t in enumerate(TEXTS)]
    rows += [(None, BASE[4], None, None, None), (5000, BASE[5], "en", "s", 1), (5000, BASE[5], "en", "s", 1), (5000, prose(70), "en", "s", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    items = [(1, BASE[5]), (2, "Mira to, n tora"), (2, BASE[6][:200]), (3, ""), (4, None), (None, prose(40)), (5, "x" * 300)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in rows[::2] if r[0] is not None], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("none"))
    spark.createDataFrame([], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", [n for n in q.queries() if n.split("_")[0] not in ("op2", "op3", "op7")])
def test_empty_tables(spark, empty, name):
    assert q.queries()[name](spark, empty).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=120))
def test_suffix_array(raw):
    buf = np.frombuffer(raw, np.uint8)
    order, _ = suffix_array(words8(buf), 8)
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    for a, b, n in zip(order[:-1], order[1:], common_prefixes(buf, order)[1:], strict=True):
        x, y = raw[a:], raw[b:]
        assert n == next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))


def removed(rows):
    last = 1 << 62
    coded = [(last if i is None else i, (t or "").encode()) for i, t, *_ in rows]
    first = {}
    for i, b in coded:
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], i), i)
    out = []
    for (i, b), row in zip(coded, rows, strict=True):
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = 1
        spans = int((np.diff(np.concatenate([[0], gone])) == 1).sum())
        out.append((row[0], len(b), int(gone.sum()), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone[:-1], strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def test_repeated_strings(spark, root, monkeypatch):
    folder, rows = root
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert rows_of(q.op1_suffix_array_dedup(spark, folder), *names) == removed(rows)


def test_string_shard_blocks_merge():
    """Several blocks of a string shard give what one block gives."""
    text = pa.array([*BASE, BASE[6][40:400], BASE[5] + BASE[4]])
    docs = pa.table({"__id": pa.array(range(len(text)), pa.int64()), "__home": pa.array([0] * len(text), pa.int32()), "__text": text})
    found, *_ = suffix_dedup._contexts(docs, np.zeros(0, np.uint64), 4)
    part = [found[k] for k in ("row", "left", "right", "least")]
    whole = suffix_dedup.string_owners(*part)
    size, suffix_dedup.BLOCK = suffix_dedup.BLOCK, 7 * suffix_dedup.CONTEXT
    try:
        assert (suffix_dedup.string_owners(*part) == whole).all()
    finally:
        suffix_dedup.BLOCK = size


def shingle_set(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def component_ids(rows):
    sets = [shingle_set(t) for _, t, *_ in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    ids = {}
    for (i, *_), x in zip(rows, label, strict=True):
        if i is not None:
            ids[x] = min(ids.get(x, i), i)
    return sorted(((i, len(s), ids.get(x)) for (i, *_), s, x in zip(rows, sets, label, strict=True)), key=repr)


def test_jaccard_classes(spark, root):
    folder, rows = root
    assert rows_of(q.op6_partenum_jaccard_join(spark, folder), "doc_id", "n_shingles", "component_id") == component_ids(rows)


def test_jaccard_large_groups_and_blocks(spark, monkeypatch):
    """Groups beyond the pair limit, near-copies on both sides of the threshold, several comparison blocks."""
    monkeypatch.setattr(partenum_join, "BLOCK", 20)
    base = prose(150)
    rows = [(i, edited(base, (i % 9) * 0.01)) for i in range(60)] + [(100 + i, prose(12) + " " + BASE[3]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(partenum_join.classes(df), "doc_id", "n_shingles", "component_id") == component_ids(rows)


def test_one_row_of_each_class_stays(spark, root):
    folder, rows = root
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = partenum_join.representatives(docs).collect()
    classes = component_ids(rows)
    assert len([r for r in kept if shingle_set(r["text"])]) == len({c for i, n, c in classes if n})
    assert len([r for r in kept if not shingle_set(r["text"])]) == len([1 for i, n, c in classes if not n])


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 50 + i) for i in range(30)] + [(200, 200)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[50 + i] for i in range(30)} | {got[100]} == {50} and 200 not in got


def contaminated(rows, items):
    def words(text):
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(len(w) - min(13, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + min(13, len(w))]), set()).add(item)
    out = []
    for i, text, *_ in rows:
        w, hit, found = words(text), set(), set()
        for window, of in windows.items():
            for p in range(len(w) - len(window) + 1):
                if tuple(w[p : p + len(window)]) == window:
                    hit.update(range(p, p + len(window)))
                    found |= of
        listed = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block,piece", [(1 << 20, 20_000), (300, 7)])
def test_decontamination(spark, root, block, piece):
    folder, rows = root
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("items", F.lit("clash")).select("doc_id", "text", "items")
    marked = decontaminate.mark(docs, bench, block=block, piece=piece)
    got = marked.select("doc_id", "n_words", "n_hit", F.size("items").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("h"), decontaminate.contaminated().alias("c"))
    assert rows_of(got, "doc_id", "n_words", "n_hit", "n_items", "h", "c") == contaminated(rows, [(r["item_id"], r["text"]) for r in bench.collect()])
    for r in marked.filter("n_hit > 0").select("text", "n_hit", "spans").collect():
        inside = " ".join(r["text"][s["start"] : s["end"]] for s in r["spans"])
        assert len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", inside)) == r["n_hit"]


PATH = q.vocabulary("byte_bpe_50k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("ab '\n\t sSt<|endoftext|>1 é", max_size=60)), max_size=5))
def test_bpe_equals_the_library(texts):
    from tokenizers import Tokenizer

    library = test_bpe_equals_the_library.__dict__.setdefault("library", Tokenizer.from_file(PATH))
    codec = bpe_codec.codec(PATH)
    ids, bounds = codec.encode(texts)
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == expected
    assert codec.decode(ids, bounds) == [library.decode(e, skip_special_tokens=False) for e in expected]


def test_bpe_query(spark, root):
    from tokenizers import Tokenizer

    folder, rows = root
    library = Tokenizer.from_file(PATH)
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert rows_of(q.op8_pair_index_bpe(spark, folder), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    again = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(again)


def test_quality_counts(spark, root):
    folder, rows = root
    got = q.op9_ngram_likelihood_ratio(spark, folder)
    want = []
    for i, t, *_ in rows:
        c = base_counts(t)
        want.append((i, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert rows_of(got, "doc_id", *quality_llr.COUNTS, "base_failed") == sorted(want, key=repr)
    assert got.filter("base_failed AND kept").isEmpty()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab #\n \té", max_size=30), min_size=1, max_size=6))
def test_quality_measures(texts):
    buf, offs = textkit.strings(pa.array(texts))
    counts, _ = quality_llr.measure(buf, offs, np.zeros(quality_llr.BUCKETS))
    assert list(zip(*(counts[c].tolist() for c in quality_llr.COUNTS), strict=True)) == [base_counts(t) for t in texts]


def test_quality_parts_good_from_bad(spark):
    good = [(i, prose(80)) for i in range(60)]
    bad = [(100 + i, " ".join(f"{rnd.choice(WORDS)}### ||" for _ in range(80))) for i in range(60)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1) for i in range(0, 60, 2)] + [(i, 0) for i in range(100, 160, 2)], "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality_llr.apply(docs, quality_llr.fit(docs, labels)).collect()}
    assert all(kept[i] for i in range(60)) and not any(kept[100 + i] for i in range(60))


def test_language(spark, tmp_path):
    kinds = {"aa": ("ka", "ro", "lim"), "bb": ("zu", "pex", "wy")}
    rows = [(i, " ".join("".join(rnd.choice(kinds[k]) for _ in range(rnd.randint(1, 4))) for _ in range(30)), k, "s", 0) for i, k in enumerate(["aa", "bb"] * 60)]
    rows += [(500, None, "aa", "s", 0), (501, "123 !!", "aa", "s", 0), (502, "karolim" * 100, None, "s", 0), (None, "zupexwy", "bb", None, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = q.op10_piece_language_id(spark, str(tmp_path)).collect()
    by = {r["doc_id"]: r for r in got}
    for i, _, lang, *_ in rows[:120]:
        assert by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert by[i]["lang_pred"] == lang
    assert by[500]["lang_pred"] == by[501]["lang_pred"] == "und" and by[500]["score"] == 0
    assert by[502]["lang_pred"] == "aa" and by[None]["lang_pred"] == "bb" and by[None]["held_out"] is False
    assert all(0 <= r["score"] <= 1 for r in got)


def test_licenses(spark):
    from roadtrace.llm import license_scan as ls

    rows = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c.py", "print(1)"), (3, "a/x/LICENSE.txt", "Licensed under the Apache License, Version 2.0."), (4, "a/x/y/z.py", None),
        (5, "top.py", ""), (6, "q/r.py", "# This work is licensed under the GNU General Public License, version 3.\ncode"), (7, None, "x"), (8, "a/b/d.py", "Copyright of nobody in particular"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("license", F.lit("clash"))
    got = {r["doc_id"]: (r["own_license"], r["license"], r["license_dir"]) for r in ls.scan_licenses(df, id_col="doc_id", path="path").collect()}
    assert got == {1: ("mit", "mit", None), 2: (None, "mit", "a"), 3: ("apache-2.0", "apache-2.0", None), 4: (None, "apache-2.0", "a/x"), 5: (None, None, None), 6: ("gpl-3.0", "gpl-3.0", None), 7: (None, None, None), 8: (None, "mit", "a")}


def test_pipeline_stages(spark, root):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    folder, rows = root
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("kept", F.lit("clash")).withColumn("node", F.lit(3))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, folder).checkpoint()
        assert docs.columns == columns, name
        assert docs.select("doc_id").join(before.select("doc_id"), "doc_id", "left_anti").filter("doc_id IS NOT NULL").isEmpty()
    left = rows_of(docs, "doc_id", "text")
    assert all(len(shingle_set(t)) >= 46 for _, t in left)
    assert not any(c for *_, c in contaminated(left, [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]))
    assert rows_of(corpus_pipeline.run(spark, folder), "doc_id") == sorted(((i,) for i, _ in left), key=repr)


def thue_morse(n):
    """Two different strings of 2**n letters that every polynomial hash modulo 2**64 takes for equal, from n = 10 on."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_thue_morse_words_and_lines(spark, tmp_path):
    """Strings made to collide are told apart by the rules, the join and the decontamination."""
    (w, v), fill = thue_morse(11), [prose(60) for _ in range(3)]
    texts = [w, v, f"{w}\n{v}\n{fill[0]}", f"{w}\n{w}\n{fill[0]}", f"{fill[1]} {w}", f"{fill[1]} {v}", " ".join([w, v, "x"] * 3), " ".join([w, w, "x", v, v, "x"]), f"q {v} {fill[2]}"]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, w), (2, f"x {w} x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    folder = str(tmp_path)
    want = [(i, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]) for i, t, *_ in rows for c in [base_counts(t)]]
    assert rows_of(q.op9_ngram_likelihood_ratio(spark, folder), "doc_id", *quality_llr.COUNTS, "base_failed") == sorted(want, key=repr)
    assert rows_of(q.op6_partenum_jaccard_join(spark, folder), "doc_id", "n_shingles", "component_id") == component_ids(rows)
    got = rows_of(q.op5_fm_index_decontamination(spark, folder), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == contaminated(rows, [(1, w), (2, f"x {w} x")])


def test_numbers_of_equal_hashes(monkeypatch):
    """Where hashes fail altogether the bytes decide."""
    monkeypatch.setattr(textkit.Spans, "hash", lambda self, starts, ends: np.zeros(len(starts), np.uint64))
    monkeypatch.setattr(textkit, "mix", lambda h: h * np.uint64(0))
    buf, offs = textkit.strings(pa.array(["a b a", "a cc b", None]))
    starts, ends, firsts = textkit.word_bounds(~textkit.SPACE[buf], offs)
    number, n = textkit.Spans(buf).numbers(starts, ends, textkit.owners(firsts))
    assert number.tolist() == [0, 1, 0, 2, 3, 4] and n == 5


def segmentations(word, known, longest):
    """Log of the sum over all ways to cut ``word``, one by one."""
    if not word:
        return [1.0]
    return [p * rest for k in range(1, min(longest, len(word)) + 1) for p in [known(word[:k])] if p for rest in segmentations(word[k:], known, longest)]


def test_all_segmentations_are_summed():
    from roadtrace.llm import langid_pieces as lp

    vocabulary = lp.pieces(q.vocabulary("piece_bpe_32k.model"))
    draw = np.random.default_rng(3)
    probability = draw.random((vocabulary.size, 2)) / vocabulary.size * 9
    codes = lambda piece: int(lp._matches(vocabulary, *lp._codes([piece]))[len(piece) - 1, len(piece) - 1, 0]) if len(piece) <= vocabulary.longest else vocabulary.size
    words = ["▁", "▁a", "▁the", "▁straße", "▁international", "▁日本語の", "▁йцук", "▁" + "ab" * 5]
    got = lp.forward(vocabulary, words, probability)
    for language in (0, 1):

        def known(piece, language=language):
            number = codes(piece)
            p = probability[number, language] if number < vocabulary.size else 0
            return max(p, lp.FLOOR) if len(piece) == 1 else p

        assert np.allclose(got[:, language], [np.log(sum(segmentations(w, known, vocabulary.longest))) for w in words], rtol=1e-9)
    # Long words: a plain logarithmic recurrence, and the same in any company.
    long = "▁" + "donaudampfschifffahrt日本" * 400
    logs = np.full(len(long) + 1, -np.inf)
    logs[0] = 0
    for end in range(1, len(long) + 1):
        for k in range(1, min(end, vocabulary.longest) + 1):
            number = codes(long[end - k : end])
            p = probability[number, 1] if number < vocabulary.size else 0
            p = max(p, lp.FLOOR) if k == 1 else p
            if p:
                logs[end] = np.logaddexp(logs[end], logs[end - k] + np.log(p))
        if end > 300:
            break
    assert np.isclose(lp.forward(vocabulary, [long[:301], "▁a"], probability)[0, 1], logs[301], rtol=1e-9)
    assert np.allclose(lp.forward(vocabulary, words + [long], probability)[: len(words)], got, rtol=0, atol=1e-9)


def test_results_do_not_depend_on_the_rows_beside(spark, root):
    """The same rows in other partitions give the same scores, verdicts and languages, bit by bit."""
    from roadtrace.llm import langid_pieces as lp

    folder, rows = root
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    path = q.vocabulary("piece_bpe_32k.model")
    ratios, langs, scored = set(), [], []
    for parts in (1, 5):
        some = docs.repartition(parts)
        model = quality_llr.fit(some, labels)
        ratios.add((model.ratio.tobytes(), model.threshold))
        scored.append(rows_of(quality_llr.apply(some, model), "doc_id", "text", "score", "kept"))
        langs.append(rows_of(lp.predict(some, lp.fit(some, path, order=F.col("doc_id"))), "doc_id", "text", "lang_pred", "score"))
    assert len(ratios) == 1 and scored[0] == scored[1] and langs[0] == langs[1]


def test_likelihood_ratio_against_plain_counts(spark, root):
    """Scores equal a plain count of hashed byte n-grams."""
    folder, rows = root
    labels = [r["doc_id"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    good = quality_llr._sampled(spark.read.parquet(f"{folder}/labels.parquet"), 1, "doc_id", "quality", 100)[::2]
    bucket = lambda g: (int.from_bytes(g, "little") * 0x9E3779B1 % (1 << 32)) >> 16
    grams = {i: [bucket(t[k : k + 4]) for k in range(len(t) - 3)] for i, (_, t, *_) in enumerate((r[0], (r[1] or "").encode()) for r in rows)}
    raw, target = np.zeros(1 << 16), np.zeros(1 << 16)
    for i, (doc_id, *_) in enumerate(rows):
        for g in grams[i]:
            raw[g] += 1
            target[g] += doc_id in good
    ratio = np.rint((np.log((target + 1) / (target.sum() + (1 << 16))) - np.log((raw + 1) / (raw.sum() + (1 << 16)))) * (1 << 20))
    want = sorted(((doc_id, text, float(ratio[grams[i]].sum() / ((1 << 20) * max(1, len(grams[i]))))) for i, (doc_id, text, *_) in enumerate(rows)), key=repr)
    assert labels and rows_of(q.op9_ngram_likelihood_ratio(spark, folder), "doc_id", "score") == sorted(((d, s) for d, _, s in want), key=repr)
