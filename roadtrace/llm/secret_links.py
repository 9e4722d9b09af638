"""Secret scans with multipart credential linking, with SQL functions only.

Base spans (``assign``, ``access``, ``hex``) are certain and always stay. Weak parts, that is random-looking tokens
(``part``) and endpoints (``endpoint``), are common in clean text; they are reported only if complementary parts
co-occur within ``reach`` code points: a ``part`` with an access identifier, an ``endpoint`` with an access identifier
and with a secret (an ``assign``, ``hex`` or reported ``part`` span).

Spans are a function of the text alone, so each distinct text with a hit is worked on once, under its SHA-256. The texts are scanned
once: what the patterns found is cut off from them by checkpoint() before the joins. Texts without a hit meet no shuffle; ``redact``
shuffles those with one, dealt by salts, so that copies of one text don't meet in a single task. Positions come from
splitting by the pattern: a match starts where the pieces and matches before it end. The co-occurrence test is an
interval join on cells of ``reach`` code points, as a left semi join, so no pairs are made.

Defined cases: null text counts as empty; ids may be null or repeat, each row gets its answer; an empty table gives no
rows; letters of the key words match in either ASCII case; matches are leftmost and don't overlap within a kind; a weak
part that overlaps a base span is dropped. An input column named ``spans`` is replaced by ``scan_secrets``; other names may clash with
anything.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadtrace.llm import textkit as tk

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: With the length floors inside, these two match exactly what the open patterns match and keep: a run is taken whole.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
PART = r"[A-Za-z0-9+/]{20,}={0,2}"
ENDPOINT = r"""https?://[^\s"'<>]+"""

#: Kinds in the order in which spans with the same start are listed; pattern, group whose length counts, its floor.
BASE = {"assign": (ASSIGN, 2, 8), "access": (ACCESS, 0, 16), "hex": (HEX, 0, 32)}
WEAK = {"part": (PART, 0, 20), "endpoint": (ENDPOINT, 0, 12)}
KINDS = [*BASE, *WEAK]
REACH = 256
#: Tasks to which the rows of one text are dealt.
SALTS = 16


def _lengths(text: Column, pattern: str, group: int) -> Column:
    """Per match: length of the text before it, of the match, of the counted group, and the counted group itself."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    rows = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"), F.transform(whole, F.length).alias("len"), part.alias("part"))
    none = F.expr("CAST(array() AS array<struct<gap:int,len:int,part:string>>)")
    return F.when(text.rlike(pattern), rows).otherwise(none)


def _located(parts: DataFrame, kinds: dict[str, tuple[str, int, int]]) -> DataFrame:
    """(key, kind, start, end, part) of each kept match of ``parts``, which has a column of ``_lengths`` per kind."""
    each = reduce(
        DataFrame.unionByName,
        (parts.select("key", F.lit(kind).alias("kind"), F.posexplode(kind).alias("i", "m")).select("key", "kind", "i", "m.*", F.lit(floor).alias("floor")) for kind, (_, _, floor) in kinds.items()),
    )
    before = Window.partitionBy("key", "kind").orderBy("i")
    ended = each.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(before))
    return ended.filter(F.length("part") >= F.col("floor")).select("key", "kind", (F.col("end") - F.col("len")).alias("start"), "end", "part")


def _cells(spans: DataFrame, reach: int, around: int) -> DataFrame:
    """A row for each cell of ``reach`` code points that a span, widened by ``around``, touches."""
    return spans.withColumn("cell", F.explode(F.sequence(F.floor((F.col("start") - around) / reach), F.floor((F.col("end") + around) / reach))))


def _near(spans: DataFrame, others: DataFrame, reach: int) -> DataFrame:
    """The spans that have one of ``others`` within ``reach`` in the same text."""
    o = _cells(others, reach, reach).select(F.col("key").alias("o_key"), F.col("cell").alias("o_cell"), F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    met = (F.col("key") == F.col("o_key")) & (F.col("cell") == F.col("o_cell")) & (F.col("start") <= F.col("o_end") + reach) & (F.col("o_start") <= F.col("end") + reach)
    return _cells(spans, reach, 0).join(o, met, "left_semi").drop("cell").distinct()


def _hit(body: Column) -> Column:
    return reduce(Column.__or__, (body.rlike(p) for p, _, _ in BASE.values()))


def _found(body: Column) -> list[Column]:
    """What the patterns find in a text, by kind; weak kinds only beside an access identifier."""
    base = [_lengths(body, p, g).alias(k) for k, (p, g, _) in BASE.items()]
    return base + [F.when(body.rlike(ACCESS), _lengths(body, p, g)).alias(k) for k, (p, g, _) in WEAK.items()]


def find_spans(texts: DataFrame, *, key: str = "key", text: str = "text", reach: int = REACH) -> DataFrame:
    """(key, kind, start, end) of base and linked spans; ``key`` names a text, and rows that repeat a key count once."""
    tk.checkpoint_dir(texts.sparkSession)
    return _linked(texts.select(F.col(key).alias("key"), *_found(F.col(text))).checkpoint(), reach)


def _linked(scanned: DataFrame, reach: int) -> DataFrame:
    """``find_spans`` of (key, what the patterns found) rows."""
    scanned = scanned.groupBy("key").agg(*(F.first(k).alias(k) for k in KINDS))
    base = _located(scanned, BASE).drop("part")
    weak = _located(scanned.filter(F.size("access") > 0), WEAK)
    access = base.filter("kind = 'access'")
    part = weak.filter("kind = 'part' AND part RLIKE '[0-9]' AND part RLIKE '[A-Za-z]'").drop("part")
    b = _cells(base, reach, 0).select(F.col("key").alias("b_key"), F.col("cell").alias("b_cell"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    clash = (F.col("key") == F.col("b_key")) & (F.col("cell") == F.col("b_cell")) & (F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end"))
    clashing = _cells(part, reach, 0).join(b, clash, "left_semi").select("key", "start").distinct()
    part = _near(part.join(clashing, ["key", "start"], "left_anti"), access, reach)
    secret = base.filter("kind <> 'access'").unionByName(part)
    endpoint = _near(_near(weak.filter("kind = 'endpoint'").drop("part"), access, reach), secret, reach)
    return base.unionByName(part).unionByName(endpoint)


def listed(spans: Column) -> Column:
    """``kind:start:end`` comma-joined, for an array of (start, rank, kind, end) in order."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def _joined(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (with __key and __salt) and what is found for their key."""
    spread = found.withColumnRenamed("key", "__key").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(spread, ["__key", "__salt"], "left")


def _salted(rows: DataFrame) -> DataFrame:
    """Rows with a salt of their own; what follows reads them from a checkpoint."""
    return rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).checkpoint()


_SPANS = "array<struct<start:bigint,rank:bigint,kind:string,end:bigint>>"


def scan_secrets(df: DataFrame, *, text: str = "text", reach: int = REACH) -> DataFrame:
    """``df`` without ``text``, with ``spans``: array of (start, rank, kind, end), ordered by start, then kind as listed."""
    tk.checkpoint_dir(df.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    rest = [c for c in df.columns if c not in (text, "spans")]
    # Rows without a hit spread over the join by a key of their own.
    key = F.when(_hit(body), F.sha2(body, 256)).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id()))
    scanned = _salted(df.select(*(F.col(c).alias(f"__rest_{i}") for i, c in enumerate(rest)), key.alias("__key"), *_found(body)))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    hits = scanned.filter("NOT startswith(__key, '-')").select(F.col("__key").alias("key"), *KINDS)
    found = _linked(hits, reach).groupBy("key").agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), rank.alias("rank"), "kind", F.col("end").cast("long").alias("end")))).alias("spans"))
    joined = _joined(scanned.drop(*KINDS), found)
    return joined.select(*(F.col(f"__rest_{i}").alias(c) for i, c in enumerate(rest)), F.coalesce("spans", F.expr(f"CAST(array() AS {_SPANS})")).alias("spans"))


def redact(df: DataFrame, *, text: str = "text", length: str | None = None, reach: int = REACH) -> DataFrame:
    """``df`` with every span of ``text`` replaced by ``[kind]``; overlapping spans become one, named by the first.

    ``length`` names a column that holds the text's length; it follows the changed texts. Rows without a span pass as they are, without a
    shuffle.
    """
    tk.checkpoint_dir(df.sparkSession)
    names = {c: f"__doc_{i}" for i, c in enumerate(df.columns)}
    rows, own = df.toDF(*names.values()), names[text]
    body = F.coalesce(F.col(own), F.lit(""))
    hits = _salted(rows.filter(_hit(body)).withColumn("__key", F.sha2(own, 256)))
    ordered = Window.partitionBy("key").orderBy("start", "rank")
    spans = find_spans(hits, key="__key", text=own, reach=reach).withColumn("rank", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")))
    spans = spans.withColumn("before", F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("run", F.sum(F.when(F.col("before").isNull() | (F.col("start") >= F.col("before")), 1).otherwise(0)).over(ordered))
    runs = spans.groupBy("key", "run").agg(F.min(F.struct("start", "rank", "kind"))["kind"].alias("kind"), F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = runs.withColumn("from", F.lag("end", 1, 0).over(Window.partitionBy("key").orderBy("start")))
    cuts = cuts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end", "from", "kind"))).alias("__cuts"))
    joined = _joined(hits, cuts)
    pieces = F.transform("__cuts", lambda c: F.concat(F.substring(F.col(own), (c["from"] + 1).cast("int"), (c["start"] - c["from"]).cast("int")), F.lit("["), c["kind"], F.lit("]")))
    tail = F.substring(F.col(own), (F.element_at("__cuts", -1)["end"] + 1).cast("int"), F.length(own))
    joined = joined.withColumn("__cleaned", F.when(F.col("__cuts").isNull(), F.col(own)).otherwise(F.concat(F.array_join(pieces, ""), tail)))
    changed = {own: F.col("__cleaned")}
    if length:
        changed[names[length]] = F.when(F.col("__cuts").isNull(), F.col(names[length])).otherwise(F.length("__cleaned").cast(df.schema[length].dataType))
    done = joined.select(*(changed.get(n, F.col(n)).alias(n) for n in names.values()))
    return rows.filter(~_hit(body)).union(done).toDF(*names)
