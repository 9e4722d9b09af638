"""The likelihood ratio learns from every label, beyond any bound that a sample had."""

import numpy as np
from pyspark.sql import functions as F

from roadtrace.llm import quality_llr as ql


def plain_cut(score, good):
    """Kept and dropped rows in whole numbers, each distinct score in turn."""
    best, at = None, np.unique(score)
    for k, s in enumerate(at):
        gain = int((score[good == 0] < s).sum()) * int((good == 1).sum()) - int((score[good == 1] < s).sum()) * int((good == 0).sum())
        if best is None or gain > best[0]:
            best = gain, k
    k = best[1]
    half = at[0] if k == 0 else (at[k - 1] + at[k]) / 2
    return at[k] if k and half == at[k - 1] else half


def test_every_label_counts(spark):
    """More labels a class than the 20,000 that were once read: each is in the target counts or places the threshold."""
    n = 20_600
    words = F.expr("concat_ws(' ', transform(sequence(1, 51), k -> concat(substr(md5(concat(id, '-', k)), 1, 2), IF(hash(id, k) % 5 < IF(id < 20600, 2, -2), 'o', 'x'))))")
    docs = spark.range(2 * n, numPartitions=4).select(F.col("id").alias("doc_id"), words.alias("text"))
    labels = spark.range(2 * n).select(F.col("id").alias("doc_id"), (F.col("id") < n).cast("int").alias("quality"))
    model = ql.fit(docs, labels)
    order = [r["id"] for r in spark.range(n).orderBy(F.xxhash64("id"), "id").collect()]
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect()}

    def counted(ids):
        buf = np.frombuffer(b"".join(texts[i] for i in ids), np.uint8)
        offs = np.concatenate([[0], np.cumsum([len(texts[i]) for i in ids])])
        bucket, whole = ql._grams(buf, offs)
        return np.bincount(bucket[whole], minlength=ql.BUCKETS)

    raw, target = counted(texts), counted(order[::2])
    exact = np.log((target + 1) / (target.sum() + ql.BUCKETS)) - np.log((raw + 1) / (raw.sum() + ql.BUCKETS))
    assert (model.ratio == np.rint(exact * ql.SCALE)).all()
    judged = {r["doc_id"]: r for r in ql.apply(docs, model, keep=["doc_id"]).collect()}
    held = [i for i in [*order[1::2], *range(n, 2 * n)] if not judged[i]["base_failed"]]
    assert len(held) > 30_000
    assert model.threshold == plain_cut(np.array([judged[i]["score"] for i in held]), np.array([int(i < n) for i in held]))


def test_cut_of_a_table(spark):
    """Ties between cuts, equal scores, scores close together and on both sides of 0; a class alone or none."""
    rng = np.random.default_rng(5)
    for scale in (0, 1, 4):
        score = np.concatenate([np.round(rng.normal(0, 1, 150), scale), np.round(rng.normal(0.7, 1, 150), scale), np.nextafter(0.5, [0, 1])])
        good = np.array([0] * 150 + [1] * 150 + [0, 1])
        held = spark.createDataFrame([(float(s), int(g)) for s, g in zip(score, good, strict=True)], "score double, good int")
        assert ql.cut(held) == plain_cut(score, good)
        assert ql.cut(held.filter("good = 1")) == score[good == 1].min() and ql.cut(held.filter("good = 0")) == -np.inf
    even = spark.createDataFrame([(0.1, 0), (0.2, 1), (0.3, 0), (0.4, 1)], "score double, good int")
    assert ql.cut(even) == (0.1 + 0.2) / 2
