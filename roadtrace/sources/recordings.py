"""Drive recordings: JSON lines tagged by kind, one file a drive.

A row is a wide struct of optional payloads; unknown keys are ignored and missing ones are null. A file may end in a torn
row: the last row, undecodable and without a newline, is dropped. Any other undecodable row, or one over
``MAX_ROW`` bytes, is damage: strict reads raise, salvage reads keep the good rows and report a warning.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_ROW = 2_000_000

_D = T.DoubleType()
_VECTOR = T.ArrayType(_D)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


HEADER = _struct(version=T.LongType(), snapshot=T.StringType(), mapHash=T.StringType(), previousRecording=T.StringType(), metadata=T.MapType(T.StringType(), T.StringType()))
SAMPLE = _struct(time=_D, forwardAcceleration=_D, lateralAcceleration=_D, verticalAcceleration=_D, yawRate=_D, pitch=_D, roll=_D, gravityError=_D, magneticMagnitude=_D, relativeAltitude=_D)
RAW = _struct(time=_D, acceleration=_VECTOR, rotation=_VECTOR, gravity=_VECTOR, quaternion=_VECTOR, magneticField=_VECTOR, magneticAccuracy=T.LongType())
GPS = _struct(timestamp=T.StringType(), time=_D, receivedUptime=_D, ageSeconds=_D, latitude=_D, longitude=_D, horizontalAccuracy=_D, speed=_D, speedAccuracy=_D, course=_D, batchSize=T.LongType(), qualityFlags=T.ArrayType(T.StringType()))
ESTIMATE = _struct(time=_D, latitude=_D, longitude=_D, speed=_D, heading=_D, uncertainty=_D, status=T.StringType())
DRIVE_ENTRY = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("sequence", T.LongType()), T.StructField("receivedUptime", _D), T.StructField("wallTime", T.StringType()),
    T.StructField("header", HEADER), T.StructField("sample", SAMPLE), T.StructField("raw", RAW), T.StructField("gps", GPS), T.StructField("estimate", ESTIMATE),
    T.StructField("event", T.StringType()), T.StructField("metrics", T.MapType(T.StringType(), _D)), T.StructField("details", T.MapType(T.StringType(), T.StringType())),
])

#: Payload that each replayed kind must have; kinds that are not here never drive a replay.
REPLAYED = {"sample": "sample", "raw": "raw", "estimate": None, "event": "event"}


class DamagedRecording(ValueError):
    """A recording with an undecodable row that is not a torn last row."""


def read_recordings(spark: SparkSession, path: str, *, salvage: bool = False, folders: bool = False) -> DataFrame:
    """SRC01, SRC02, SRC04: (drive, place, the entry's fields[, warning]) of all rows under ``path``.

    ``drive`` is the file's name without its extensions, or with ``folders`` the value of its drive= folder. Files ending in .gz are decompressed by Spark; with
    ``salvage`` a truncated one gives the rows that can be read.
    """
    reader = spark.read.option("ignoreCorruptFiles", str(salvage).lower())
    text = reader.option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place"), "value")
    parsed = F.from_json("value", T.StructType([*DRIVE_ENTRY.fields, T.StructField("_corrupt", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    long = F.octet_length("value")
    rows = lines.withColumn("e", parsed).withColumn("bad", F.col("e").isNull() | F.col("e._corrupt").isNotNull() | F.col("e.kind").isNull() | (long > MAX_ROW))
    # Every row but a last one without a newline takes one byte more than its text.
    checks = rows.groupBy("file").agg(F.count_if("bad").alias("n_bad"), F.max("place").alias("last"), F.max(F.when(F.col("bad"), F.col("place"))).alias("last_bad"), (F.sum(long + 1) > F.max("size")).alias("open")).filter("n_bad > 0")
    torn = (F.col("n_bad") == 1) & (F.col("last") == F.col("last_bad")) & (F.lower("file").endswith(".gz") | F.col("open"))
    suspects = checks.select("file", torn.alias("torn"), "n_bad")
    if not salvage and (worst := suspects.filter("NOT torn").select("file", "n_bad").first()):
        raise DamagedRecording(f"{worst['file']}: {worst['n_bad']} undecodable rows")
    drive = F.regexp_extract("file", "/drive=([^/]*)/", 1) if folders else F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.jsonl(\.gz)?$", "")
    good = rows.filter("NOT bad").select(drive.alias("drive"), "file", "place", *(F.col(f"e.{f.name}").alias(f.name) for f in DRIVE_ENTRY.fields))
    if not salvage:
        return good.drop("file")
    warned = suspects.select("file", F.concat(F.col("n_bad").cast("string"), F.when(F.col("torn"), F.lit(" torn row")).otherwise(F.lit(" damaged rows"))).alias("warning"))
    return good.join(warned, "file", "left").drop("file")


def write_recordings(entries: DataFrame, path: str, drive: str) -> None:
    """SNK01, SNK05: compact JSON lines with a sequence from 1 per drive, a folder a drive."""
    order = Window.partitionBy(drive).orderBy("receivedUptime")
    fields = [c for c in entries.columns if c not in (drive, "sequence")]
    rows = entries.withColumn("sequence", F.row_number().over(order).cast("long"))
    rows.select(drive, F.to_json(F.struct("sequence", *fields)).alias("value")).repartition(F.col(drive)).sortWithinPartitions(drive, F.get_json_object("value", "$.sequence").cast("long")).write.partitionBy(drive).text(path)


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share; in local mode one of our own where spark.checkpoint.dir is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def summary(entries: DataFrame) -> DataFrame:
    """AGG01, AGG02: rows, kinds, span and finish of each drive."""
    time = F.coalesce("sample.time", "raw.time", "estimate.time")
    return entries.groupBy("drive").agg(F.count("*").alias("n"), F.count_distinct("kind").alias("kinds"), F.min(time).alias("first"), F.max(time).alias("last"), F.max_by("event", "sequence").alias("finish"))


def headers(entries: DataFrame) -> DataFrame:
    """SRC03: each drive's first header."""
    return entries.filter("kind = 'header'").groupBy("drive").agg(F.min_by("header", "sequence").alias("header")).select("drive", "header.*")


def compatible(heads: DataFrame, snapshot: str, map_hash: str) -> DataFrame:
    """FLT14: (drive, reason), null where a recording fits the graph: version 2 to 4, the graph's snapshot and hash."""
    reason = F.when(~F.coalesce(F.col("version").between(2, 4), F.lit(False)), "version").when(~F.col("snapshot").eqNullSafe(F.lit(snapshot)), "snapshot").when(~F.col("mapHash").eqNullSafe(F.lit(map_hash)), "map")
    return heads.select("drive", reason.alias("reason"))


def replayed(entries: DataFrame) -> DataFrame:
    """FLT13: the rows that drive a replay; position fixes never do."""
    has = F.coalesce(*(F.when(F.col("kind") == k, F.lit(True) if p is None else F.col(p).isNotNull()) for k, p in REPLAYED.items()), F.lit(False))
    return entries.filter(has)


def previous_chain(heads: DataFrame, depth: int = 8) -> DataFrame:
    """SRC18: (drive, ancestor, step) along previousRecording, at most ``depth`` steps."""
    link = heads.select(F.col("drive").alias("child"), F.regexp_replace("previousRecording", r"\.jsonl(\.gz)?$", "").alias("parent")).filter("parent IS NOT NULL")
    out = step = heads.select("drive", F.col("drive").alias("ancestor"), F.lit(0).alias("step"))
    for i in range(1, depth + 1):
        step = step.join(link, F.col("ancestor") == F.col("child")).select("drive", F.col("parent").alias("ancestor"), F.lit(i).alias("step"))
        out = out.unionByName(step)
    return out


def recording_files(spark: SparkSession, path: str) -> DataFrame:
    """SET08: (path) of every recording under ``path``, plain or compressed, each once and in order; no content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{jsonl,jsonl.gz}").load(path)
    return found.select("path").distinct().orderBy("path")


def reference_files(spark: SparkSession, folder: str) -> DataFrame:
    """SRC14: (name, path) of the plain recordings of ``folder`` by name."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(folder)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path").orderBy("name")


def save_reference(reference: DataFrame, folder: str, *, metadata: dict[str, str], snapshot: str) -> str:
    """SNK04: one reference row as a folder of its own, which the job's commit makes visible as a whole; gives its path.

    Its name holds the observed time in UTC (column ``observedAt``) and four characters that keep equal times apart.
    """
    row = reference.select(F.date_format("observedAt", "yyyy-MM-dd_HH-mm-ss").alias("at")).first()
    details = F.create_map(*(F.lit(x) for pair in {**metadata, "mapSnapshot": snapshot, "formatVersion": "3"}.items() for x in pair))
    entry = F.struct(F.lit("field-reference").alias("kind"), F.struct(*reference.columns).alias("reference"), details.alias("details"))
    path = f"{folder}/Reference_{row['at']}_{uuid.uuid4().hex[:4]}.jsonl"
    reference.select(F.to_json(entry).alias("value")).coalesce(1).write.text(path)
    return path


#: Kinds that a replay of raw frames uses.
RAW_REPLAY = ["header", "raw", "event", "calibration", "visual-speed", "gps-reference"]


def raw_replay(entries: DataFrame, seconds: float) -> DataFrame:
    """SRC17: the rows that a replay of raw frames uses, up to the first frame over ``seconds`` after the first one.

    Rows before a drive's first header count nothing; of calibrations only those marked as reused stay.
    """
    begun = entries.groupBy("drive").agg(F.min(F.when(F.col("kind") == "header", F.col("sequence"))).alias("__head"))
    led = entries.join(begun, "drive").filter("sequence >= __head")
    frame = (F.col("kind") == "raw") & F.col("raw").isNotNull()
    origin = led.groupBy("drive").agg(F.min_by(F.when(frame, F.col("raw.time")), F.when(frame, F.col("sequence"))).alias("__origin"))
    over = frame & (F.col("raw.time") - F.col("__origin") > seconds)
    cut = led.join(origin, "drive").groupBy("drive").agg(F.min(F.when(over, F.col("sequence"))).alias("__cut"))
    used = F.col("kind").isin(RAW_REPLAY) & ((F.col("kind") != "calibration") | F.coalesce(F.col("details")["reason"] == "reused", F.lit(False)))
    return led.join(cut, "drive").filter(used & (F.col("__cut").isNull() | (F.col("sequence") < F.col("__cut")))).drop("__head", "__cut")


def annotated(entries: DataFrame, notes: dict[str, str]) -> DataFrame:
    """SNK07: ``entries`` whose headers' metadata says how they were made again; ``notes`` win over what stood there."""
    held = F.coalesce(F.col("header.metadata"), F.create_map().cast("map<string,string>"))
    rest = F.map_filter(held, lambda k, _: ~k.isin(list(notes)))
    both = F.map_concat(rest, F.create_map(*(F.lit(x) for pair in notes.items() for x in pair)))
    return entries.withColumn("header", F.when(F.col("header").isNotNull(), F.col("header").withField("metadata", both)))


def beside(original: DataFrame, current: DataFrame, snapshot: str, map_hash: str) -> DataFrame:
    """SRC19: (drive, origin, kind, time, latitude, longitude, speed, heading, event): recorded and replayed estimates and events.

    Only drives of the same map count: an equal snapshot, and an equal hash where the header has one. Times begin at a drive's first
    recorded sample.
    """
    fits = headers(original).filter((F.col("snapshot") == snapshot) & F.coalesce(F.col("mapHash") == map_hash, F.lit(True))).select("drive")
    zero = original.filter("kind = 'sample'").groupBy("drive").agg(F.min_by("sample.time", "sequence").alias("__zero")).join(fits, "drive")

    def rows(entries: DataFrame, origin: str) -> DataFrame:
        e = entries.filter(F.col("kind").isin("estimate", "event")).join(zero, "drive")
        time = F.coalesce("estimate.time", "receivedUptime") - F.col("__zero")
        return e.select("drive", F.lit(origin).alias("origin"), "kind", time.alias("time"), "estimate.latitude", "estimate.longitude", "estimate.speed", "estimate.heading", "event")

    return rows(original, "original").unionByName(rows(current, "current"))
