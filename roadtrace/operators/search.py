"""Place search over a postings table (word, entry, field, rank, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadtrace.functions.text import one_edit_prefix, prefix_of, words


def postings(entries: DataFrame, entry: str, fields: list[str]) -> DataFrame:
    """SRC06: (word, entry, field) of the named text columns."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("field"), words(F.col(f)).alias("words")) for i, f in enumerate(fields)))).alias("e")
    return entries.select(F.col(entry).alias("entry"), each).select("entry", "e.field", F.explode("e.words").alias("word"))


def hits(index: DataFrame, terms: list[str], fuzzy: bool) -> DataFrame:
    """(entry, term, field, typo): the entries' words that a term begins, or nearly begins."""
    listed = F.explode(F.array(*(F.struct(F.lit(i).alias("number"), F.lit(t).alias("term")) for i, t in enumerate(terms))))
    spread = index.withColumn("t", listed).select("entry", "field", "word", "t.*")
    exact = prefix_of(F.col("word"), F.col("term"))
    near = one_edit_prefix(F.col("word"), F.col("term")) if fuzzy else F.lit(False)
    return spread.filter(exact | near).select("entry", "number", "field", (~exact).cast("int").alias("typo"))


def terms_of(entries: DataFrame, text: str) -> list[str]:
    """The words of a query, folded as those of the index are."""
    return entries.sparkSession.range(1).select(words(F.lit(text))).first()[0]


def ranked(index: DataFrame, entries: DataFrame, text: str, limit: int, *, fuzzy: bool) -> DataFrame:
    """JOI22, TOP03: entries that meet every term, at least one of them by name (field 0), best first.

    Score: ten times the rank, fifteen for each term met with a typo only, five less if the name's first word begins with the
    first term, and a twentieth for each kilometre up to 300. A name hit counts before a context hit, even with a typo.
    ``entries`` has (entry, rank, km, name). Ties go by name, then entry.
    """
    terms = terms_of(entries, text)
    best = hits(index, terms, fuzzy).groupBy("entry", "number").agg(F.min(F.struct("field", "typo")).alias("b"))
    met = best.groupBy("entry").agg(F.count("*").alias("n"), F.min("b.field").alias("field"), F.sum("b.typo").alias("typos"))
    found = met.filter((F.col("n") == len(terms)) & (F.col("field") == 0)).join(entries, "entry")
    opens = F.coalesce(F.get(words(F.col("name")), F.lit(0)).startswith(F.lit(terms[0] if terms else "")), F.lit(False))
    score = 10 * F.col("rank") + 15 * F.col("typos") - 5 * opens.cast("int") + 0.05 * F.least("km", F.lit(300.0))
    return found.withColumn("score", F.round(score, 6)).orderBy("score", "name", "entry").limit(limit)


def search(index: DataFrame, entries: DataFrame, text: str, limit: int = 40) -> DataFrame:
    """TXT03: the exact pass; if it finds fewer than half of ``limit``, the pass with typos takes its place."""
    exact = ranked(index, entries, text, limit, fuzzy=False)
    return exact if exact.count() >= limit // 2 else ranked(index, entries, text, limit, fuzzy=True)


def index_order(entries: DataFrame) -> DataFrame:
    """TOP09: entries in the order of an index file: by rank, then name; streets by name, then context, after the ranked ones."""
    return entries.orderBy(F.col("rank").asc_nulls_last(), "name", "context", "entry")


def online(results: DataFrame, limit: int = 12) -> DataFrame:
    """TOP11: the first suggestions of an online search, in its own order."""
    return results.orderBy("place").limit(limit)
