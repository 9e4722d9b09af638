"""Connected components of a link table, as rounds of groups and windows that end in stored tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Tasks that share the rows of one node.
SALTS = 16


def shared_folder(spark: SparkSession) -> None:
    """Makes sure that checkpoint() has a folder: the cluster's spark.checkpoint.dir, or in local mode one of our own."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)


def stored(df: DataFrame) -> DataFrame:
    """``df`` cut off from its lineage like checkpoint(), but as Parquet in the same folder: packed columns in place of plain rows.

    The files go when the driver ends, or by ``forget``. What Spark has shuffled for them is free once the driver's collector runs.
    """
    spark = df.sparkSession
    shared_folder(spark)
    place = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(place)
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(place)
    out._stored_at = place
    spark.sparkContext._jvm.System.gc()
    return out


def forget(df: DataFrame) -> None:
    """Deletes the files of a table that ``stored`` made and that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _least_of(rows: DataFrame, least: DataFrame) -> DataFrame:
    """``rows`` (u, v) with the m of their u; v is never null.

    A window over both tables: a join's estimate of size is the product of its sides, and over the rounds it would fill the driver with its digits.
    A hub's rows are dealt to ``SALTS`` tasks, and each learns the m.
    """
    spread = least.select("u", F.lit(None).alias("v"), "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    asked = rows.select("u", "v", F.lit(None).alias("m"), F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int").alias("salt"))
    return asked.union(spread).withColumn("m", F.min("m").over(Window.partitionBy("u", "salt"))).filter("v IS NOT NULL").drop("salt")


def components(links: DataFrame) -> DataFrame:
    """(node, label) for links (a, b): the label is the component's smallest node.

    Every round each node ties its larger neighbours to its smallest one, then its smaller neighbours to the smallest of them, until all hang on their
    component's smallest node.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        large = _least_of(both.filter("v > u"), both.groupBy("u").agg(F.min("v").alias("m"))).select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        small = _least_of(large, large.groupBy("u").agg(F.min("v").alias("m")))
        tied = stored(small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct())
        forget(edges)
        edges = tied
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        state = new
