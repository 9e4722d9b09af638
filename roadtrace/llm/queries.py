"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadtrace.llm import bpe_codec as bc
from roadtrace.llm import decontaminate as dc
from roadtrace.llm import hilbert_shards as hs
from roadtrace.llm import langid_pieces as lp
from roadtrace.llm import license_scan as ls
from roadtrace.llm import line_dedup as ld
from roadtrace.llm import partenum_join as pj
from roadtrace.llm import quality_llr as ql
from roadtrace.llm import secret_links as sl
from roadtrace.llm import spelling as sp
from roadtrace.llm import suffix_dedup as sd
from roadtrace.llm import url_trie as ut
from roadtrace.llm import whitening as wh

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, root: str) -> DataFrame:
    cut = sd.remove_repeats(table(spark, root, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_hilbert_sharding(spark: SparkSession, root: str) -> DataFrame:
    """All documents in 8 shards along the curve over language, source and size; law ``rows``."""
    docs = table(spark, root, "documents")
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(body) + F.lit(1)).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.col("lang").alias("__lang"), F.col("source").alias("__source"))
    dims = [hs.hashed_level(F.col("__lang"), hs.BITS), hs.hashed_level(F.col("__source"), hs.BITS), hs.log_level(F.col("size"), hs.BITS)]
    placed = hs.hilbert_shards(rows, dims, order=["doc_id", "text_crc32", "size"], shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("cell").alias("curve_cell"))


def op3_credential_linking(spark: SparkSession, root: str) -> DataFrame:
    found = sl.scan_secrets(table(spark, root, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["rank"] <= F.lit(len(sl.BASE)))
    counts = (F.expr(f"CAST(size(filter(spans, s -> s.kind = '{kind}')) AS BIGINT) AS n_{kind}") for kind in sl.BASE)
    return found.select("doc_id", *counts, F.sha2(sl.listed(base), 256).alias("base_sha256"), sl.listed(F.col("spans")).alias("spans"))


def op4_license_inheritance(spark: SparkSession, root: str) -> DataFrame:
    """Documents as files of a tree source / language / id; the best line, paragraph or whole text against headers, SPDX ids and texts."""
    docs = table(spark, root, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text")
    return ls.scan_licenses(docs, id_col="doc_id", path="path", templates=ls.FULL, pieces=True)


def op4_license_notices(spark: SparkSession, root: str) -> DataFrame:
    """As ``op4_license_inheritance``, with all marker lines of a text as one notice and short templates."""
    docs = table(spark, root, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text")
    return ls.scan_licenses(docs, id_col="doc_id", path="path")


def op5_fm_index_decontamination(spark: SparkSession, root: str) -> DataFrame:
    marked = dc.mark(table(spark, root, "documents").select("doc_id", "text"), table(spark, root, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), dc.contaminated().alias("contaminated"))


def op6_partenum_jaccard_join(spark: SparkSession, root: str) -> DataFrame:
    return pj.classes(table(spark, root, "documents").select("doc_id", "text"))


URL_RULES = [ut.Rule("com", "/", "allow"), ut.Rule("example.com", "/en/", "block"), ut.Rule("www.example.com", "/en/", "allow"), ut.Rule("net", "/es/", "block"), ut.Rule("net", "/fr/", "block")]


def op7_url_trie_filter(spark: SparkSession, root: str) -> DataFrame:
    return ut.judge_urls(table(spark, root, "pages"), URL_RULES, keys=["page_id"], url="url", default="allow")


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file; the package is installed on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_pair_index_bpe(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", "text")
    coded = bc.encode_texts(docs, vocabulary("byte_bpe_50k.json"), ids="ids", decoded="decoded", keep=["doc_id"])
    return coded.select("doc_id", (F.octet_length("ids") / F.lit(4)).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_ngram_likelihood_ratio(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", "text")
    model = ql.fit(docs, table(spark, root, "labels"))
    return ql.apply(docs, model, keep=["doc_id"])


def op10_piece_language_id(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == F.lit(2), F.lit(False))
    docs = docs.withColumn("held_out", held)
    model = lp.fit(docs.filter("NOT held_out"), vocabulary("piece_bpe_32k.model"), order=F.col("doc_id"))
    return lp.predict(docs, model, keep=["doc_id", "held_out"])


def op11_spelling_variants(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", "text")
    return sp.variants(sp.word_counts(docs, rule=sp.misspell, least_points=6, least_count=5), ratio=5)


def op12_embedding_whitening(spark: SparkSession, root: str) -> DataFrame:
    vectors = table(spark, root, "embeddings").select("vec_id", "embedding")
    return wh.transform(vectors, wh.fit(vectors, components=4), keep=["vec_id"])


def op13_cuckoo_line_dedup(spark: SparkSession, root: str) -> DataFrame:
    """All documents inserted in one state of filters and reference counts, then freed of the lines that it drops."""
    cut = ld.dedup_lines(table(spark, root, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_suffix_array_dedup, op2_hilbert_sharding, op3_credential_linking, op4_license_inheritance, op4_license_notices, op5_fm_index_decontamination, op6_partenum_jaccard_join, op7_url_trie_filter, op8_pair_index_bpe, op9_ngram_likelihood_ratio, op10_piece_language_id, op11_spelling_variants, op12_embedding_whitening, op13_cuckoo_line_dedup)}


_OP7_SQL = """
WITH p AS (
  SELECT page_id, coalesce(regexp_extract(url, '://([^/?#]*)', 1), '') AS raw_host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
h AS (SELECT page_id, path, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM p),
r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/' END AS rule FROM h)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""


def _op3_sql() -> str:
    """The same scan with DuckDB's lists; the linking as EXISTS over spans of one text."""

    def located(kind: str, pattern: str, group: int, floor: int, where: str = "") -> str:
        quoted = pattern.replace("'", "''")
        return f"""
SELECT rid, '{kind}' AS kind, {sl.KINDS.index(kind) + 1} AS rank, pos - len(m) AS s, pos AS e, g AS part FROM (
  SELECT rid, m, g, sum(length(gap) + length(m)) OVER (PARTITION BY rid ORDER BY i) AS pos FROM (
    SELECT rid, unnest(range(len(ms))) AS i, unnest(ms) AS m, unnest(gs) AS g, unnest(gaps[1:len(ms)]) AS gap FROM (
      SELECT rid, regexp_extract_all(t, '{quoted}') AS ms, regexp_extract_all(t, '{quoted}', {group}) AS gs, regexp_split_to_array(t, '{quoted}') AS gaps
      FROM d WHERE regexp_matches(t, '{quoted}') {where})))
WHERE length(g) >= {floor}"""

    base = " UNION ALL ".join(located(k, *v) for k, v in sl.BASE.items())
    weak = " UNION ALL ".join(located(k, *v, where=f"AND regexp_matches(t, '{sl.ACCESS}')") for k, v in sl.WEAK.items())
    near = lambda a, b: f"{b}.rid = {a}.rid AND {a}.s <= {b}.e + {sl.REACH} AND {b}.s <= {a}.e + {sl.REACH}"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
base AS ({base}),
weak AS ({weak}),
part AS (SELECT w.* FROM weak w WHERE kind = 'part' AND regexp_matches(part, '[0-9]') AND regexp_matches(part, '[A-Za-z]')
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = w.rid AND w.s < b.e AND b.s < w.e)
  AND EXISTS (SELECT 1 FROM base b WHERE b.kind = 'access' AND {near('w', 'b')})),
secret AS (SELECT * FROM base WHERE kind <> 'access' UNION ALL SELECT * FROM part),
endpoint AS (SELECT w.* FROM weak w WHERE kind = 'endpoint'
  AND EXISTS (SELECT 1 FROM base b WHERE b.kind = 'access' AND {near('w', 'b')})
  AND EXISTS (SELECT 1 FROM secret b WHERE {near('w', 'b')})),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM part UNION ALL SELECT * FROM endpoint),
joined AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank <= 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans
  FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN joined USING (rid)
"""


_OP5_SQL = r"""
WITH lowered AS (SELECT row_number() OVER () AS rid, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT rid, doc_id, coalesce(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM lowered),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT item, w, least(13, len(w)) AS size, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
occ AS (SELECT rid, i, size, item FROM (
    SELECT rid, i, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
    FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)) JOIN win USING (size, phrase)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT rid, i, size FROM occ)) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM occ WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
"""


_OP6_SQL = r"""
WITH RECURSIVE lowered AS (SELECT row_number() OVER () AS rid, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT rid, doc_id, coalesce(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), []) AS w FROM lowered),
s AS (SELECT DISTINCT rid, array_to_string(w[i:i + 4], ' ') AS sh FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
common AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.rid <> b.rid GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT rid AS root, rid AS node FROM n UNION SELECT root, b FROM reach JOIN link ON link.a = reach.node),
least AS (SELECT root, min(doc_id) AS component_id FROM reach JOIN d ON d.rid = node GROUP BY root)
SELECT doc_id, coalesce(n, 0) AS n_shingles, CASE WHEN n IS NULL THEN doc_id ELSE component_id END AS component_id
FROM d LEFT JOIN n USING (rid) LEFT JOIN least ON root = rid
"""


def _op11_sql() -> str:
    """The checksum byte by byte over a table made from its polynomial; near words by equal strings with one place left out."""
    steps = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        steps.append(value)
    return f"""
WITH RECURSIVE t AS (SELECT {steps}::BIGINT[] AS step),
lowered AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents WHERE text IS NOT NULL),
run AS (SELECT doc, r, count(*) AS times FROM (SELECT doc, unnest(regexp_extract_all(s, '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS r FROM lowered) WHERE length(r) >= 6 GROUP BY doc, r),
coded AS (SELECT r, times, hex(doc || ':' || r) AS x FROM run),
sums AS (SELECT r, times, xor(list_reduce(list_transform(range(1, length(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT)),
  lambda a, b: xor(a >> 8, step[xor(a & 255, b) + 1]), 4294967295::BIGINT), 4294967295) AS h FROM coded, t),
w AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (SELECT times, CASE WHEN h % 199 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word FROM sums)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM w a JOIN cut b ON a.word = b.rest
  UNION SELECT b.word, b.n, a.word, a.n FROM w a JOIN cut b ON a.word = b.rest),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word),
formed AS (SELECT w.word, w.n, coalesce(best.n_near, 0) AS n_near, CASE WHEN best.m >= 5 * w.n THEN best.m END AS form_n,
  CASE WHEN best.m >= 5 * w.n THEN (SELECT min(other) FROM near WHERE near.word = w.word AND near.m = best.m) END AS form FROM w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS tip FROM formed UNION ALL SELECT chain.word, formed.form FROM chain JOIN formed ON formed.word = chain.tip WHERE formed.form IS NOT NULL)
SELECT word, form, tip AS root, n, n_near, form_n FROM formed JOIN chain USING (word)
WHERE NOT EXISTS (SELECT 1 FROM formed f WHERE f.word = chain.tip AND f.form IS NOT NULL)
"""


_OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) AS documents, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key),
j AS (SELECT k.rid, k.i, k.line, c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.top AS gone FROM k LEFT JOIN c ON c.key = k.key AND c.documents >= 3),
t AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS kept FROM j GROUP BY rid)
SELECT doc_id, n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM d JOIN t USING (rid)
"""


_TREE = "concat_ws('/', source, lang, CAST(doc_id AS VARCHAR))"


def oracle_sql() -> dict[str, str]:
    return {"op3_credential_linking": _op3_sql(), "op4_license_inheritance": ls.oracle(_TREE, ls.FULL, pieces=True), "op4_license_notices": ls.oracle(_TREE), "op5_fm_index_decontamination": _OP5_SQL, "op6_partenum_jaccard_join": _OP6_SQL, "op7_url_trie_filter": _OP7_SQL, "op11_spelling_variants": _op11_sql(), "op13_cuckoo_line_dedup": _OP13_SQL}
