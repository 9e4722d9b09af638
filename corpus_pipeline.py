"""The training-data pipeline: rules, near-duplicates, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of ``docs``, whatever those are: an operator's own columns never meet them by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadtrace.llm import bpe_codec, decontaminate, partenum_join, quality_llr, secret_links, textkit
from roadtrace.llm.queries import table, vocabulary


def _aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names that no operator uses, and the new name of each column."""
    names = {c: f"__doc_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _back(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return docs.select(*(F.col(n).alias(c) for c, n in names.items()))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the likelihood ratio reject go."""
    aside, names = _aside(docs)
    model = quality_llr.fit(aside, table(spark, sf_dir, "labels").withColumnRenamed("doc_id", names["doc_id"]), id_col=names["doc_id"], text=names["text"])
    return _back(quality_llr.apply(aside, model, text=names["text"]).filter("kept"), names)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest id stays; rows without words stay."""
    aside, names = _aside(docs)
    return _back(partenum_join.representatives(aside, id_col=names["doc_id"], text=names["text"]), names)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages cover a twentieth or more go."""
    aside, names = _aside(docs)
    marked = decontaminate.mark(aside, table(spark, sf_dir, "benchmark"), text=names["text"])
    return _back(marked.filter(~decontaminate.contaminated()), names)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts give way to their kind in brackets; n_chars follows."""
    aside, names = _aside(docs)
    return _back(secret_links.redact(aside, text=names["text"], length=names.get("n_chars")), names)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (unsigned 32-bit, little-endian), their count, and digests of the ids and of the text they decode to."""
    coded = bpe_codec.encode_texts(docs.select("doc_id", "text"), vocabulary("byte_bpe_50k.json"), ids="ids", decoded="decoded", keep=["doc_id"])
    return coded.select("doc_id", (F.octet_length("ids") / F.lit(4)).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard", ngram_jaccard),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("bpe_tokens", bpe_tokens),
]

#: The likelihood ratio and the byte-pair merges have no SQL form; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is cut off from its lineage in the shared folder."""
    textkit.checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = docs.checkpoint()
    return docs
