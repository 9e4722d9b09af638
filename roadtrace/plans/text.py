"""Text and search queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadtrace.functions import text as t
from roadtrace.functions.quality import first_reason
from roadtrace.operators import search as s
from roadtrace.operators.ordered import last_n
from roadtrace.plans.registry import query
from roadtrace.sources.tables import table

_FOLD = "strip_accents(lower(coalesce({0}, '')))"
_WORDS = "list_distinct(list_filter(regexp_split_to_array(regexp_replace(" + _FOLD + ", '[’ʼ''`]', '', 'g'), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''))"


@query(f"SELECT p_partkey, CAST(len({_WORDS.format('p_name')}) AS BIGINT) AS n, array_to_string(list_sort({_WORDS.format('p_name')}), ' ') AS words FROM part")
def words(spark: SparkSession, root: str) -> DataFrame:
    """TXT01, SET02."""
    w = t.words(F.col("p_name"))
    return table(spark, root, "part").select("p_partkey", F.size(w).cast("long").alias("n"), F.array_join(F.array_sort(w), " ").alias("words"))


@query(f"""
SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS.format('text')}) AS word FROM documents) WHERE starts_with(word, 'tha') GROUP BY 1""")
def prefix_search(spark: SparkSession, root: str) -> DataFrame:
    """TXT02: document frequency of words by prefix."""
    docs = table(spark, root, "documents").select(F.explode(t.words(F.col("text"))).alias("word"))
    return docs.filter(t.prefix_of(F.col("word"), F.lit("tha"))).groupBy("word").agg(F.count("*").alias("n"))


@query(f"""
SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS.format('text')}) AS word FROM documents)
WHERE (length(word) >= 4 AND levenshtein(left(word, 4), 'there') <= 1) OR (length(word) >= 5 AND levenshtein(left(word, 5), 'there') <= 1) OR (length(word) >= 6 AND levenshtein(left(word, 6), 'there') <= 1) GROUP BY 1""")
def one_edit_search(spark: SparkSession, root: str) -> DataFrame:
    """TXT03: words of which a prefix is one edit from the term."""
    docs = table(spark, root, "documents").select(F.explode(t.words(F.col("text"))).alias("word"))
    return docs.filter(t.one_edit_prefix(F.col("word"), F.lit("there"))).groupBy("word").agg(F.count("*").alias("n"))


def _places(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, root, "part").select(F.col("p_partkey").alias("entry"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_brand", "p_type").alias("context"), (F.col("p_size") % 7).alias("rank"), (F.col("p_retailprice") / 4).alias("km"))
    return s.postings(p, "entry", ["name", "context"]), p


def _search_sql(terms: list[tuple[int, str]], first: str, near: str = "starts_with(word, term)", typo: str = "0") -> str:
    listed = ", ".join(f"({i}, '{t}')" for i, t in terms)
    return f"""
WITH p AS (SELECT p_partkey AS entry, p_name AS name, p_brand || ' ' || p_type AS context, p_size % 7 AS rank, p_retailprice / 4 AS km FROM part),
i AS (SELECT entry, 0 AS field, unnest({_WORDS.format('name')}) AS word FROM p UNION ALL SELECT entry, 1, unnest({_WORDS.format('context')}) FROM p),
h AS (SELECT entry, number, min(10 * field + {typo}) AS best FROM i, (VALUES {listed}) t(number, term) WHERE {near} GROUP BY 1, 2),
m AS (SELECT entry, sum(best % 10) AS typos FROM h GROUP BY 1 HAVING count(*) = {len(terms)} AND min(best // 10) = 0)
SELECT entry, name, round(10 * rank + 15 * typos - 5 * CASE WHEN starts_with({_WORDS.format('name').removeprefix('list_distinct')}[1], '{first}') THEN 1 ELSE 0 END + 0.05 * least(km, 300.0), 6) AS score FROM m JOIN p USING (entry) ORDER BY score, name, entry LIMIT 40"""


@query(_search_sql([(0, "red"), (1, "sma")], "red"))
def ranked_search(spark: SparkSession, root: str) -> DataFrame:
    """JOI22, TOP03: two terms over names and contexts, best forty; accents of the query are folded."""
    index, entries = _places(spark, root)
    return s.ranked(index, entries, "Réd smä", 40, fuzzy=False).select("entry", "name", "score")


@query(_search_sql(
    [(0, "widgat"), (1, "red")], "widgat", typo="CASE WHEN starts_with(word, term) THEN 0 ELSE 1 END",
    near="starts_with(word, term) OR (length(term) >= 5 AND ((length(word) >= length(term) - 1 AND levenshtein(left(word, length(term) - 1), term) <= 1) OR (length(word) >= length(term) AND levenshtein(left(word, length(term)), term) <= 1) OR (length(word) > length(term) AND levenshtein(left(word, length(term) + 1), term) <= 1)))",
))
def typo_search(spark: SparkSession, root: str) -> DataFrame:
    """SRC06, TXT03, TOP03: an index built from two columns; the pass with typos takes over where the exact one finds little."""
    index, entries = _places(spark, root)
    return s.search(index, entries, "widgat red").select("entry", "name", "score")


@query("SELECT p_partkey AS entry, p_name AS name, p_size % 7 AS rank, row_number() OVER (ORDER BY p_size % 7, p_name, p_brand, p_partkey) AS place FROM part ORDER BY place LIMIT 100")
def index_order(spark: SparkSession, root: str) -> DataFrame:
    """TOP09, TOP10: the first hundred places by rank, name and context."""
    p = table(spark, root, "part").select(F.col("p_partkey").alias("entry"), F.col("p_name").alias("name"), (F.col("p_size") % 7).alias("rank"), F.col("p_brand").alias("context"))
    first = s.index_order(p).limit(100)
    return first.withColumn("place", F.row_number().over(Window.orderBy("rank", "name", "context", "entry")).cast("long")).drop("context")


_LINKS = """CASE k % 12 WHEN 0 THEN 'https://maps.example/@' || lat || ',' || lon || ',15z' WHEN 1 THEN 'geo:' || lat || ',' || lon || ' or https://m.example/@1.25,2.25'
  WHEN 2 THEN 'see ' || lat || ', ' || lon || ' there' WHEN 3 THEN 'https://m.example/?q=' || lat || '%2C' || lon || '&z=3'
  WHEN 4 THEN 'https://m.example/maps/place/Big+House/@1.5,2.5,17z/data=!3d' || lat || '!4d' || lon WHEN 5 THEN 'https://o.example/?mlat=' || lat || '&amp;mlon=' || lon || '#map=17/1.5/2.5'
  WHEN 6 THEN 'https://o.example/#map=17/' || lat || '/' || lon || '&x=@1.5,2.5' WHEN 7 THEN 'https://m.example/?q=House&ll=' || lat || ',' || lon
  WHEN 8 THEN 'https://www.example/maps/search/' || lat || ',+' || lon || '?entry=t' WHEN 9 THEN 'https://m.example/l?u=https%3A%2F%2Fm.example%2F%3Fcenter%3D' || lat || '%252C' || lon
  WHEN 10 THEN 'Call me at 12, 30 tomorrow ' || k WHEN 11 THEN 'two: ?sll=' || lat || ';' || lon || ' &daddr=0.0,0.0' END"""


@query(f"""
WITH c AS (SELECT c_custkey AS k, (c_custkey % 180) - 89 || '.' || (c_custkey % 900 + 100) AS lat, (c_custkey % 400) - 199 || '.250' AS lon FROM customer)
SELECT k AS c_custkey, CASE WHEN ok THEN CAST(lat AS DOUBLE) END AS lat, CASE WHEN ok THEN CAST(lon AS DOUBLE) END AS lon,
  CASE k % 12 WHEN 4 THEN 'Big House' WHEN 7 THEN 'House' END AS name
FROM (SELECT *, abs(CAST(lat AS DOUBLE)) <= 90 AND abs(CAST(lon AS DOUBLE)) <= 180 AND k % 12 <> 10 AS ok FROM c) WHERE ok OR k % 12 IN (0, 2, 3, 7, 8, 9, 10, 11)""")
def place_from_text(spark: SparkSession, root: str) -> DataFrame:
    """TXT05, TXT07, TXT09: coordinates and names back out of links and sentences written from keys; a lesser form stands beside."""
    keys = table(spark, root, "customer").selectExpr("c_custkey AS k", "concat(c_custkey % 180 - 89, '.', c_custkey % 900 + 100) AS lat", "concat(c_custkey % 400 - 199, '.250') AS lon")
    told = keys.withColumn("link", F.expr(_LINKS)).withColumn("p", t.place_from_text(F.col("link")))
    # Where a pair off the globe stands beside a lesser form, that one counts; such rows are left to the unit tests.
    fits = (F.abs(F.col("lat").cast("double")) <= 90) & (F.abs(F.col("lon").cast("double")) <= 180) & (F.col("k") % 12 != 10)
    return told.filter(fits | (F.col("k") % 12).isin(0, 2, 3, 7, 8, 9, 10, 11)).select(F.col("k").alias("c_custkey"), "p.lat", "p.lon", t.place_name(F.col("link")).alias("name"))


@query("""SELECT page_id, nullif(regexp_extract(html, 'https?://[^\\s"''<>]+'), '') AS link, split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages""")
def url_host(spark: SparkSession, root: str) -> DataFrame:
    """TXT08: the first link in each page, and its own host."""
    return table(spark, root, "pages").select("page_id", t.first_url(F.col("html")).alias("link"), F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host"))


_MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query(f"""
SELECT doc_id, CAST(len(m) AS BIGINT) AS mails, CAST(len(ip) AS BIGINT) AS addresses FROM (
  SELECT doc_id, list_filter(regexp_extract_all(text, '{_MAIL}'), lambda x: NOT regexp_matches(x, '@example\\.(com|org|net)$')) AS m, regexp_extract_all(text, '[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}') AS ip FROM documents)
WHERE len(m) > 0 OR len(ip) > 0""")
def privacy_scan(spark: SparkSession, root: str) -> DataFrame:
    """FLT20: e-mail addresses that no allow-list excuses, and network addresses."""
    m = F.filter(F.regexp_extract_all("text", F.lit(_MAIL), F.lit(0)), lambda x: ~x.rlike(r"@example\.(com|org|net)$"))
    ip = F.regexp_extract_all("text", F.lit(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"), F.lit(0))
    return table(spark, root, "documents").select("doc_id", F.size(m).cast("long").alias("mails"), F.size(ip).cast("long").alias("addresses")).filter("mails > 0 OR addresses > 0")


@query("""
SELECT c_custkey, c_name, split_part(c_name, '#', 2) AS stamp, row_number() OVER (PARTITION BY c_mktsegment ORDER BY split_part(c_name, '#', 2) DESC, c_custkey) AS place FROM customer
QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY split_part(c_name, '#', 2) DESC, c_custkey) <= 25""")
def catalog_sort(spark: SparkSession, root: str) -> DataFrame:
    """SRC13, SRC16: newest first by the part of the name after its first mark."""
    c = table(spark, root, "customer").withColumn("stamp", F.split_part("c_name", F.lit("#"), F.lit(2)))
    order = [F.desc("stamp"), F.asc("c_custkey")]
    newest = last_n(c, "c_mktsegment", order, 25)
    return newest.select("c_custkey", "c_name", "stamp", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(*order)).cast("long").alias("place"))


_POI = """CASE WHEN p_type = 'ECONOMY' AND p_size > 40 THEN 'fuel' WHEN p_name LIKE '%bolt%' THEN 'repair' WHEN p_size < 5 THEN 'camera' ELSE 'other' END"""


@query(f"""
SELECT category, min_zoom, count(*) AS n, min(label) AS first_label FROM (
  SELECT {_POI} AS category, CASE {_POI} WHEN 'fuel' THEN 12 WHEN 'repair' THEN 13 WHEN 'camera' THEN 14 ELSE 15 END AS min_zoom, p_name || ' · ' || CAST(round(p_retailprice) AS BIGINT) || ' m' AS label FROM part) GROUP BY 1, 2""")
def poi_classification(spark: SparkSession, root: str) -> DataFrame:
    """FLT11, FLT19, TXT10, AGG03: ordered rules give category and zoom; labels are composed; counts by category."""
    rules = [("fuel", (F.col("p_type") == "ECONOMY") & (F.col("p_size") > 40)), ("repair", F.col("p_name").contains("bolt")), ("camera", F.col("p_size") < 5), ("other", F.lit(True))]
    zoom = F.create_map(*(F.lit(x) for pair in (("fuel", 12), ("repair", 13), ("camera", 14), ("other", 15)) for x in pair))
    label = F.concat(F.col("p_name"), F.lit(" · "), F.round("p_retailprice").cast("long").cast("string"), F.lit(" m"))
    p = table(spark, root, "part").select(first_reason(rules).alias("category"), label.alias("label"))
    return p.withColumn("min_zoom", zoom[F.col("category")]).groupBy("category", "min_zoom").agg(F.count("*").alias("n"), F.min("label").alias("first_label"))


@query(r"""
SELECT doc_id, CAST(len(w) AS BIGINT) AS words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS letters
FROM (SELECT doc_id, list_distinct(list_filter(string_split_regex(regexp_replace(strip_accents(lower(coalesce(text, ''))), '[’ʼ''`]', '', 'g'), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS w FROM documents)""")
def folded_words(spark: SparkSession, root: str) -> DataFrame:
    """TXT01, SET02: distinct words of whole documents without case and accents."""
    w = table(spark, root, "documents").select("doc_id", t.words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("words"), F.aggregate("w", F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("letters"))


#: Letters that stand for those of the customers' names and segments, so that all forms occur at the start, inside and after another letter.
_SPELT = ("Custmer#0123456789ABDEFGHIJKLMNOPQRSTUVWXYZ", "ЗгєЇйю яьщыэёЪзжґх'АБДЕФГЗІЙКЛМНОПЯРСТУВШХЮЦ")


@query(rf"""
WITH c AS (SELECT c_custkey, replace(translate(c_mktsegment || '-' || c_name || 'зг', '{_SPELT[0]}', '{_SPELT[1].replace("'", "’")}'), '’', '') AS s FROM customer),
m AS (SELECT MAP {{{", ".join(f"'{a}': '{b}'" for a, b in t.LETTERS.items())}}} AS plain, MAP {{{", ".join(f"'{a}': '{b}'" for a, b in t.INITIAL.items())}}} AS initial),
l AS (SELECT c_custkey, list_transform(range(1, length(s) + 1), lambda i: struct_pack(c := substr(s, i, 1), low := lower(substr(s, i, 1)), before := CASE WHEN i > 1 THEN lower(substr(s, i - 1, 1)) ELSE ' ' END)) AS parts FROM c),
k AS (SELECT c_custkey, list_transform(parts, lambda p: struct_pack(big := p.c <> p.low, made := CASE WHEN p.low = 'г' AND p.before = 'з' THEN 'gh' WHEN NOT regexp_matches(p.before, '\p{{L}}') AND map_contains(initial, p.low) THEN initial[p.low] WHEN map_contains(plain, p.low) THEN plain[p.low] ELSE p.low END)) AS parts FROM l, m)
SELECT c_custkey, list_aggregate(list_transform(parts, lambda p: CASE WHEN p.big AND p.made <> '' THEN upper(substr(p.made, 1, 1)) || substr(p.made, 2) ELSE p.made END), 'string_agg', '') AS latin FROM k""")
def transliterated(spark: SparkSession, root: str) -> DataFrame:
    """TXT04: names spelt in Cyrillic letters, in Latin ones."""
    spelt = F.translate(F.concat("c_mktsegment", F.lit("-"), "c_name", F.lit("зг")), _SPELT[0], _SPELT[1])
    return table(spark, root, "customer").select("c_custkey", t.transliterate(spelt).alias("latin"))
