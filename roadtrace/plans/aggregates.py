"""Aggregate queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadtrace.functions.quality import flags
from roadtrace.operators import aggregates as a
from roadtrace.operators.ordered import micros
from roadtrace.plans.registry import query
from roadtrace.sources.tables import table


@query("SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1")
def kind_counts(spark: SparkSession, root: str) -> DataFrame:
    """AGG01, AGG03: rows by kind."""
    return table(spark, root, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))


@query("""
SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds, count(*) AS n,
  arg_max(event_type, struct_pack(t := ts, i := event_id)) AS last_kind FROM events GROUP BY 1""")
def recording_summary(spark: SparkSession, root: str) -> DataFrame:
    """AGG02: span, rows and last kind of each drive."""
    e = table(spark, root, "events").withColumn("t", micros())
    return e.groupBy("user_id").agg(F.min("t").alias("first_us"), F.max("t").alias("last_us"), ((F.max("t") - F.min("t")) / 1e6).alias("seconds"), F.count("*").alias("n"), F.max_by("event_type", F.struct("t", "event_id")).alias("last_kind"))


@query("""
SELECT user_id, count(*) FILTER (event_type = 'click') AS rows_click, count(*) FILTER (event_type = 'error') AS rows_error, count(*) FILTER (event_type = 'purchase') AS rows_purchase, count(*) FILTER (event_type = 'view') AS rows_view, CAST(sum(strlen(props)) AS BIGINT) AS bytes
FROM events GROUP BY 1""")
def footer_counts(spark: SparkSession, root: str) -> DataFrame:
    """SNK02: counts per kind and bytes, as a footer's metrics."""
    e = table(spark, root, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum(F.octet_length("props")).alias("bytes"))
    metrics = e.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("rows"), F.sum("bytes").alias("bytes"))
    return metrics.select("user_id", *(F.coalesce(F.col("rows")[k], F.lit(0)).alias(f"rows_{k}") for k in ("click", "error", "purchase", "view")), "bytes")


@query("""
SELECT l_returnflag AS grp, round(quantile_cont(e, 0.95), 4) AS p95, round(max(e), 4) AS worst, round(avg(CASE WHEN e <= 0.05 * l_extendedprice THEN 1.0 ELSE 0.0 END), 6) AS covered, count(*) AS n
FROM (SELECT *, abs(l_extendedprice * l_discount - 2000) AS e FROM lineitem) GROUP BY 1""")
def error_summary(spark: SparkSession, root: str) -> DataFrame:
    """AGG13: errors against a stated uncertainty."""
    e = F.abs(F.col("l_extendedprice") * F.col("l_discount") - 2000)
    out = a.error_summary(table(spark, root, "lineitem").withColumnRenamed("l_returnflag", "grp"), ["grp"], e, e <= 0.05 * F.col("l_extendedprice"))
    return out.select("grp", F.round("p95", 4).alias("p95"), F.round("worst", 4).alias("worst"), F.round("covered", 6).alias("covered"), "n")


@query("""
WITH l AS (SELECT l_returnflag AS grp, 'l_quantity' AS channel, l_quantity AS x FROM lineitem UNION ALL SELECT l_returnflag, 'l_discount', l_discount FROM lineitem UNION ALL SELECT l_returnflag, 'l_tax', l_tax FROM lineitem)
SELECT grp, channel, round(sqrt(avg(x * x)), 5) AS rms, round(stddev_pop(x), 5) AS deviation, round(quantile_cont(abs(x), 0.95), 5) AS p95 FROM l GROUP BY 1, 2""")
def signal_statistics(spark: SparkSession, root: str) -> DataFrame:
    """AGG14: per channel."""
    out = a.signal_statistics(table(spark, root, "lineitem").withColumnRenamed("l_returnflag", "grp"), ["grp"], ["l_quantity", "l_discount", "l_tax"])
    return out.select("grp", "channel", *(F.round(c, 5).alias(c) for c in ("rms", "deviation", "p95")))


@query("""
SELECT l_suppkey, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS mean, round(sum(l_quantity) * sum(l_quantity) / greatest(1e-12, sum(l_quantity * l_quantity)), 4) AS effective FROM lineitem GROUP BY 1""")
def weighted_mean_ess(spark: SparkSession, root: str) -> DataFrame:
    """AGG04, AGG05."""
    w = F.col("l_quantity")
    return table(spark, root, "lineitem").groupBy("l_suppkey").agg(F.round(a.weighted_mean(F.col("l_extendedprice"), w), 4).alias("mean"), F.round(a.effective_size(w), 4).alias("effective"))


@query("""
SELECT l_suppkey, l_partkey, mass FROM (SELECT l_suppkey, l_partkey, round(sum(l_quantity), 6) AS mass FROM lineitem GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY mass DESC, l_partkey) = 1""")
def heaviest_group(spark: SparkSession, root: str) -> DataFrame:
    """AGG07."""
    return a.heaviest(table(spark, root, "lineitem"), ["l_suppkey"], "l_partkey", "l_quantity")


@query("""
SELECT l_suppkey, round(atan2(sum(l_quantity * sin(l_discount * 40)), sum(l_quantity * cos(l_discount * 40))), 5) AS direction FROM lineitem GROUP BY 1""")
def circular_mean(spark: SparkSession, root: str) -> DataFrame:
    """AGG06."""
    return table(spark, root, "lineitem").groupBy("l_suppkey").agg(F.round(a.circular_mean(F.col("l_discount") * 40, F.col("l_quantity")), 5).alias("direction"))


@query("""
SELECT l_suppkey, round(sum(l_quantity * (l_discount * l_discount + l_tax * l_tax)) / sum(l_quantity) - power(sum(l_quantity * l_discount) / sum(l_quantity), 2) - power(sum(l_quantity * l_tax) / sum(l_quantity), 2), 6) AS variance FROM lineitem GROUP BY 1""")
def spatial_variance(spark: SparkSession, root: str) -> DataFrame:
    """AGG08."""
    return a.spread(table(spark, root, "lineitem"), ["l_suppkey"], "l_discount", "l_tax", "l_quantity").select("l_suppkey", F.round("variance", 6).alias("variance"))


@query("""
WITH m AS (SELECT p_type, quantile_cont(p_retailprice, 0.5) AS med FROM part GROUP BY 1),
o AS (SELECT p_type, p_partkey, p_retailprice, abs(p_retailprice - med) AS off FROM part JOIN m USING (p_type)),
w AS (SELECT p_type, quantile_cont(off, 0.5) AS mad FROM o GROUP BY 1)
SELECT p_type, count(*) AS kept, round(quantile_cont(p_retailprice, 0.5), 4) AS median FROM o JOIN w USING (p_type) WHERE off <= greatest(0.06, 3.5 * 1.4826 * mad) GROUP BY 1""")
def mad_outliers(spark: SparkSession, root: str) -> DataFrame:
    """AGG10, AGG12: the median without outliers."""
    kept = a.mad_filter(table(spark, root, "part"), ["p_type"], "p_retailprice", 0.06)
    return kept.groupBy("p_type").agg(F.count("*").alias("kept"), F.round(F.percentile("p_retailprice", 0.5), 4).alias("median"))


@query("""
SELECT l_suppkey, round(sum(l_quantity / ((1 + l_tax * 10) * (1 + l_tax * 10))) / sum(1 / ((1 + l_tax * 10) * (1 + l_tax * 10))), 5) AS estimate, round(1 / sqrt(sum(1 / ((1 + l_tax * 10) * (1 + l_tax * 10)))), 6) AS error, count(*) AS n,
  count(*) >= 2 AND 1 / sqrt(sum(1 / ((1 + l_tax * 10) * (1 + l_tax * 10)))) <= 0.015 * abs(sum(l_quantity / ((1 + l_tax * 10) * (1 + l_tax * 10))) / sum(1 / ((1 + l_tax * 10) * (1 + l_tax * 10)))) AS confident
FROM lineitem GROUP BY 1""")
def inverse_variance_pool(spark: SparkSession, root: str) -> DataFrame:
    """AGG19."""
    out = a.inverse_variance(table(spark, root, "lineitem"), ["l_suppkey"], F.col("l_quantity"), 1 + F.col("l_tax") * 10)
    return out.select("l_suppkey", F.round("estimate", 5).alias("estimate"), F.round("error", 6).alias("error"), "n", "confident")


@query("""
SELECT o_custkey, arg_max(o_orderkey, struct_pack(p := o_totalprice, k := -o_orderkey)) AS o_orderkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1""")
def longest_per_group(spark: SparkSession, root: str) -> DataFrame:
    """AGG15."""
    return a.longest_member(table(spark, root, "orders"), ["o_custkey"], "o_totalprice", "o_orderkey")


@query("""
SELECT flag, count(*) AS n FROM (SELECT unnest(list_filter([
    CASE WHEN value IS NULL OR isnan(value) THEN 'invalid_value' END, CASE WHEN value > 25 THEN 'poor_accuracy' END, CASE WHEN value < 1 THEN 'slow' END,
    CASE WHEN event_type = 'error' THEN 'source_error' END, CASE WHEN props IS NULL OR NOT contains(props, '"k"') THEN 'no_payload' END,
    CASE WHEN event_type NOT IN ('click', 'view') AND value > 10 THEN 'suspicious' END], lambda x: x IS NOT NULL)) AS flag FROM events) GROUP BY 1""")
def quality_flags(spark: SparkSession, root: str) -> DataFrame:
    """FLT09: ordered flags of each row, exploded and counted."""
    value = F.col("value")
    listed = flags([
        ("invalid_value", value.isNull() | F.isnan(value)), ("poor_accuracy", value > 25), ("slow", value < 1),
        ("source_error", F.col("event_type") == "error"), ("no_payload", F.col("props").isNull() | ~F.contains("props", F.lit('"k"'))),
        ("suspicious", ~F.col("event_type").isin("click", "view") & (value > 10)),
    ])
    return table(spark, root, "events").select(F.explode(listed).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


@query("""
SELECT l_orderkey, round(list_sort(list(l_quantity))[len(list(l_quantity)) // 2 + 1], 2) AS middle FROM lineitem GROUP BY 1""")
def upper_median(spark: SparkSession, root: str) -> DataFrame:
    """AGG11: of an order's at most seven lines."""
    return table(spark, root, "lineitem").groupBy("l_orderkey").agg(a.median_of_few(F.collect_list("l_quantity")).alias("middle"))


@query("""
SELECT event_type, round(sum(CASE WHEN value < 3 THEN value ELSE 0 END) / sum(value), 6) AS near_zero, round(min(value), 4) AS low, round(max(value), 4) AS high,
  min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY 1""")
def near_zero_mass(spark: SparkSession, root: str) -> DataFrame:
    """AGG18, AGG29, AGG31: bounds, ends and the mass near zero."""
    v = F.col("value")
    return table(spark, root, "events").groupBy("event_type").agg(F.round(F.sum(F.when(v < 3, v).otherwise(0)) / F.sum(v), 6).alias("near_zero"), F.round(F.min(v), 4).alias("low"), F.round(F.max(v), 4).alias("high"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("""
SELECT sha256(string_agg(h, '' ORDER BY user_id)) AS digest, CAST(sum(bytes) AS BIGINT) AS bytes, sum(bytes) > 2000000000 AS over_limit FROM (
  SELECT user_id, sha256(string_agg(event_id || ':' || event_type, ',' ORDER BY event_id)) AS h, sum(strlen(event_type) + 1) AS bytes FROM events GROUP BY 1)""")
def content_hash(spark: SparkSession, root: str) -> DataFrame:
    """AGG27, AGG28: a digest of each drive, a digest over all of them, and the total size."""
    line = F.concat_ws(":", F.col("event_id"), F.col("event_type"))
    each = table(spark, root, "events").groupBy("user_id").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", line.alias("l")))), lambda s: s["l"]), ","), 256).alias("h"), F.sum(F.octet_length("event_type") + 1).alias("bytes"))
    # One row a drive: sizes are summed in parts, digests are chained in drive order.
    return each.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("user_id", "h"))), lambda s: s["h"]), ""), 256).alias("digest"), F.sum("bytes").alias("bytes"), (F.sum("bytes") > 2_000_000_000).alias("over_limit"))
