"""Map data: extracts of elements, graph bundles with their manifest, regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadtrace.sources.recordings import scratch

__all__ = ["InvalidGraph", "load_graph", "read_extract", "regions", "scratch", "write_bundle"]

_ELEMENT = "struct<type: string, id: long, lat: double, lon: double, nodes: array<long>, tags: map<string, string>, members: array<struct<type: string, ref: long, role: string>>>"
_ROAD = "id long, way long, kind string, `from` long, `to` long, length double, points array<array<double>>"
_MANIFEST = "name string, snapshot string, bounds array<double>, projection struct<kind: string, latitude: double, longitude: double>, directedEdges long, roadWays long"
_REGION = "id string, name string, summary string, center array<double>, zoom double, testingStart array<double>"


class InvalidGraph(ValueError):
    """A graph bundle that breaks a rule; nothing of it is used."""


def read_extract(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SRC07: (nodes, ways, relations) of extracts, each one JSON document with an array ``elements``."""
    read = spark.read.schema(f"elements array<{_ELEMENT}>").option("multiLine", "true").json(path)
    rows = read.select(F.explode("elements").alias("e")).select("e.*")
    nodes = rows.filter("type = 'node'").select("id", "lon", "lat")
    ways = rows.filter("type = 'way'").select(F.col("id").alias("way"), "nodes", "tags")
    return nodes, ways, rows.filter("type = 'relation'").select("id", "tags", "members")


def write_bundle(edges: DataFrame, folder: str, *, name: str, bounds: list[float], snapshot: str, projection: tuple[str, float, float] | None = None) -> None:
    """SNK06: a graph as JSON lines and its manifest; ``edges`` has (id, way, kind, from, to, length, points of [lon, lat])."""
    edges.select("id", "way", "kind", "from", "to", "length", "points").write.mode("overwrite").json(f"{folder}/{name}-graph")
    counts = edges.agg(F.count("*").alias("directedEdges"), F.count_distinct("way").alias("roadWays"))
    place = F.struct(*(F.lit(v).alias(n) for n, v in zip(("kind", "latitude", "longitude"), projection, strict=True))) if projection else F.lit(None).cast("struct<kind: string, latitude: double, longitude: double>")
    counts.select(F.lit(name).alias("name"), F.lit(snapshot).alias("snapshot"), F.array(*map(F.lit, bounds)).alias("bounds"), place.alias("projection"), "directedEdges", "roadWays").coalesce(1).write.mode("overwrite").json(f"{folder}/{name}-manifest")


def load_graph(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """SRC05: the roads of a bundle; any row or manifest that breaks a rule rejects the whole bundle.

    Four bounds; a known projection about a place of the globe; at least one road; ids dense from 0; two points a road at least, each a
    finite longitude and latitude on the globe; a length above 0.
    """
    manifest = spark.read.schema(_MANIFEST).json(f"{folder}/{name}-manifest").first()
    if manifest is None or len(manifest["bounds"] or ()) != 4:
        raise InvalidGraph("a graph needs four bounds")
    place = manifest["projection"]
    if place is not None and not (place["kind"] in ("equirectangular", "stereographic") and place["latitude"] is not None and abs(place["latitude"]) < 85 and place["longitude"] is not None and abs(place["longitude"]) <= 180):
        raise InvalidGraph("unsupported projection")
    roads = spark.read.schema(_ROAD).json(f"{folder}/{name}-graph")
    on_globe = F.forall("points", lambda p: (F.size(p) == 2) & F.coalesce((F.abs(p[0]) <= 180) & (F.abs(p[1]) <= 90), F.lit(False)))
    sound = F.coalesce((F.size("points") >= 2) & on_globe & (F.col("length") > 0) & (F.col("length") < float("inf")), F.lit(False))
    found = roads.agg(F.count("*").alias("n"), F.count_if(~sound).alias("bad"), F.min("id").alias("low"), F.max("id").alias("high"), F.count_distinct("id").alias("ids")).first()
    if not found["n"]:
        raise InvalidGraph("a graph without roads")
    if found["bad"] or (found["low"], found["high"], found["ids"]) != (0, found["n"] - 1, found["n"]):
        raise InvalidGraph(f"{found['bad']} unsound roads, ids {found['low']} to {found['high']} of {found['n']}")
    return roads


def regions(spark: SparkSession, path: str) -> DataFrame:
    """SRC12: the regions under ``path`` (files *-region.json) by name; malformed ones are left out."""
    read = spark.read.schema(_REGION).option("multiLine", "true").option("mode", "PERMISSIVE").option("pathGlobFilter", "*-region.json").json(path)
    whole = F.col("id").isNotNull() & F.col("name").isNotNull() & F.col("summary").isNotNull() & F.col("zoom").isNotNull() & (F.size("center") == 2) & (F.size("testingStart") == 2)
    return read.filter(whole).orderBy("name")
