"""Readers: model files, features, rasters and datasets as DataFrames. Files are listed by Spark, so any store it reads will do."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions.scalars import to_utm
from spanforge.operators.ways import classify_way, water_kind

POINTS = "array<struct<e:double,n:double>>"


def files(spark: SparkSession, path: str, pattern: str = "*", optional: bool = False) -> DataFrame:
    """(path, content) of binary files. Where they are optional, a path that is not there, or a file gone since it was listed, is as none."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("ignoreMissingFiles", str(optional).lower())
    try:
        return read.load(path).select("path", "content")
    except AnalysisException as wrong:
        if not optional or wrong.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, content binary")


def level_faces(texts: DataFrame, text: str = "gml") -> DataFrame:
    """Level faces (ring, z) of city models: every coordinate list of at least four points whose heights are one, within 1e-6."""
    lists = texts.select("*", F.explode(F.regexp_extract_all(F.col(text), F.lit(r"<gml:posList[^>]*>([^<]+)</gml:posList>"), F.lit(1))).alias("body")).drop(text)
    numbers = lists.withColumn("v", F.transform(F.split(F.trim(F.regexp_replace("body", r"\s+", " ")), " "), lambda x: x.try_cast("double"))).drop("body")
    n = F.size("v")
    sound = numbers.where((n >= 12) & (n % 3 == 0) & ~F.exists("v", lambda x: x.isNull()))
    heights = F.filter("v", lambda x, i: i % 3 == 2)
    flat = sound.withColumn("z", F.get("v", F.lit(2))).where(F.forall(heights, lambda h: F.abs(h - F.col("z")) <= 1e-6))
    ring = F.transform(F.sequence(F.lit(0), (F.size("v") / 3).cast("int") - 1), lambda i: F.struct(F.get("v", i * 3).alias("e"), F.get("v", i * 3 + 1).alias("n")))
    return flat.withColumn("ring", ring).drop("v")


def overpass(elements: DataFrame) -> DataFrame:
    """Features of query results (type, id, tags, geometry array of (lat, lon), members array of (role, geometry)): ways by
    class, else water; parts of water relations as water or island, with ids of their own below nought."""

    def projected(g: Column) -> Column:
        return F.transform(g, lambda p: to_utm(p["lat"], p["lon"]))

    tags = F.coalesce("tags", F.create_map().cast("map<string,string>"))
    at = elements.withColumn("tags", tags).withColumn("road", classify_way(F.col("tags"))).withColumn("water", water_kind(F.col("tags")))
    bridge = F.coalesce(F.try_element_at("tags", F.lit("bridge")), F.lit("no")) != "no"
    kept = at.where("type = 'way' AND geometry IS NOT NULL").where("road IS NOT NULL OR water IS NOT NULL")
    lines = kept.select(
        "id", F.coalesce("road.tier", "water").alias("kind"), F.coalesce("road.kind", "water").alias("name"), F.coalesce("road.half", F.lit(0.0)).alias("half"), (F.col("road").isNotNull() & bridge).alias("bridge"), projected(F.col("geometry")).alias("pts")
    )
    parts = at.where("type = 'relation' AND water IS NOT NULL").select("id", F.posexplode("members").alias("k", "m")).where(F.size("m.geometry") > 0)
    kind = F.when(F.col("m.role") == "inner", "island").otherwise("water")
    rings = parts.select((-(F.col("id") * 4096 + F.col("k") + 1)).alias("id"), kind.alias("kind"), kind.alias("name"), F.lit(0.0).alias("half"), F.lit(False).alias("bridge"), projected(F.col("m.geometry")).alias("pts"))
    return lines.unionByName(rings)


def read_overpass(spark: SparkSession, path: str) -> DataFrame:
    point = "struct<lat:double,lon:double>"
    schema = f"elements array<struct<type:string,id:long,tags:map<string,string>,geometry:array<{point}>,members:array<struct<role:string,geometry:array<{point}>>>>>"
    return overpass(spark.read.schema(schema).json(path, multiLine=True).select(F.explode("elements").alias("x")).select("x.*"))


def read_geojson(spark: SparkSession, path: str, properties: str = "map<string,string>") -> DataFrame:
    """(properties, type, geometry as JSON) of feature collections."""
    whole = spark.read.schema(f"features array<struct<properties:{properties},geometry:string>>").json(path, multiLine=True)
    return whole.select(F.explode("features").alias("f")).select("f.properties", F.get_json_object("f.geometry", "$.type").alias("type"), F.col("f.geometry").alias("geometry"))


def known_lines(spark: SparkSession, path: str, country: str = "DE", kind: str = "h", details: DataFrame | None = None) -> DataFrame:
    """Lines of an outside list (properties id, c, lt), those of a country and kind; with details (id, ...) what is known of
    each beside, null where there are none."""
    mine = read_geojson(spark, path).where((F.col("properties")["c"] == country) & (F.col("properties")["lt"] == kind)).withColumn("id", F.col("properties")["id"])
    return mine.join(details, "id", "left") if details is not None else mine


def outlines(spark: SparkSession, path: str, wanted: int | None = None, land: int = 4) -> DataFrame:
    """(name, lines): the land of named areas (properties gen, gf) as lists of points (e, n) in degrees. With `wanted`, any other
    number of areas is an error: shares of lakes and seas bear the same names under other marks."""
    held = read_geojson(spark, path).where(F.col("properties")["gf"] == str(land))
    shape = F.get_json_object("geometry", "$.coordinates")
    flat = F.when(F.col("type") == "Polygon", F.from_json(shape, "array<array<array<double>>>")).when(F.col("type") == "MultiPolygon", F.flatten(F.from_json(shape, "array<array<array<array<double>>>>"))).when(F.col("type") == "MultiLineString", F.from_json(shape, "array<array<array<double>>>"))
    lines = F.transform(flat, lambda line: F.transform(line, lambda q: F.struct(F.get(q, F.lit(0)).alias("e"), F.get(q, F.lit(1)).alias("n"))))
    found = held.select(F.col("properties")["gen"].alias("name"), lines.alias("lines"))
    count = held.count() if wanted is not None else wanted
    if count != wanted:
        raise ValueError(f"{count} areas of land where {wanted} are expected")
    return found


def overlay(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of an overlay's columns: a JSON object of equally long lists, one a column. Lists that differ in length are an error."""
    kinds = spark.createDataFrame([], schema).schema
    whole = spark.read.schema(", ".join(f"`{f.name}` array<{f.dataType.simpleString()}>" for f in kinds)).json(path, multiLine=True)
    same = F.array_min(F.array(*[F.size(f"`{f.name}`") for f in kinds])) == F.array_max(F.array(*[F.size(f"`{f.name}`") for f in kinds]))
    rows = F.when(same, F.arrays_zip(*[F.col(f"`{f.name}`") for f in kinds])).otherwise(F.raise_error(F.lit("an overlay's lists differ in length")))
    return whole.select(F.explode(rows).alias("x")).select(*[F.col(f"x.`{f.name}`") for f in kinds])


def tiles_in_json(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """replies with content, the first raster of each JSON reply decoded, and error, what the service says where it has none."""
    raster = "array<struct<Data:string>>"
    body = F.from_json(F.col(reply), f"Attributes struct<RawTIFs:{raster},Error:struct<Detail:string>>")
    data = F.get(body["Attributes"]["RawTIFs"], F.lit(0))["Data"]
    error = F.when(data.isNull(), F.coalesce(body["Attributes"]["Error"]["Detail"], F.lit("holds nothing here")))
    return replies.withColumn("content", F.unbase64(data)).withColumn("error", error).drop(reply)


#: Where a raster may begin in a reply of several parts, and how much of it is looked at for a refusal.
_BEGINS, _HEAD = 1 << 16, 2048


def raster_in(reply: bytes) -> tuple[bytes | None, str | None]:
    """(raster, None) of a reply in one or several parts, or (None, what the service says) where it declines."""
    head = reply[:_HEAD].decode("utf-8", "replace")
    if "ExceptionReport" in head or "ServiceException" in head:
        said = re.search(r"<[^>]*Exception[^>]*>\s*([^<\s][^<]{0,159})", head)
        return None, said[1].strip() if said else "refused, no reason given"
    starts = [k for k in (reply.find(mark, 0, _BEGINS) for mark in (b"II*\0", b"MM\0*")) if k >= 0]
    return (reply[min(starts) :], None) if starts else (None, "a reply without a raster")


def rasters_in(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """replies with content (the raster in each) and error (why there is none); null replies have neither."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            got = [raster_in(bytes(x)) if x is not None else (None, None) for x in pdf[reply]]
            yield pdf.drop(columns=[reply]).assign(content=pd.Series([g[0] for g in got], dtype=object, index=pdf.index), error=pd.Series([g[1] for g in got], dtype=object, index=pdf.index))

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in replies.schema if f.name != reply)
    return replies.mapInPandas(run, ", ".join(x for x in (kept, "content binary, error string") if x))


def read_poly(spark: SparkSession, path: str) -> DataFrame:
    """(path, ring): the first ring of outline files: lines of longitude and latitude up to END."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split_part("value", F.lit("END"), F.lit(1)).alias("body"))
    pairs = F.regexp_extract_all("body", F.lit(r"(?m)^\s+(-?[\d.eE+]+)\s+-?[\d.eE+]+\s*$"), F.lit(1))
    other = F.regexp_extract_all("body", F.lit(r"(?m)^\s+-?[\d.eE+]+\s+(-?[\d.eE+]+)\s*$"), F.lit(1))
    ring = F.zip_with(pairs, other, lambda x, y: F.struct(x.cast("double").alias("lon"), y.cast("double").alias("lat")))
    return text.select("path", ring.alias("ring"))


def prefer(windows: DataFrame, keys: list[str]) -> DataFrame:
    """The data of each window from the source of the highest priority (lowest number) that has any."""
    return windows.where("z IS NOT NULL").groupBy(*keys).agg(F.min_by("z", "priority").alias("z"), F.min("priority").alias("priority"))


def with_surface(ground: DataFrame, surface: DataFrame) -> DataFrame:
    """Cells with ground and surface; where there is no surface it is the ground, and known says so."""
    joined = ground.withColumnRenamed("z", "ground").join(surface.withColumnRenamed("z", "s"), ["cx", "cy"], "left")
    return joined.select("cx", "cy", "ground", F.coalesce("s", "ground").alias("surface"), F.col("s").isNotNull().alias("known"))


def windows_for(spans: DataFrame, margin: float, side: float = 256.0) -> DataFrame:
    """Windows (we, wn) that corridors of spans touch, once each; rows are named by their upper edge."""
    low = [F.floor((F.least("ae", "be") - margin) / side), F.ceil((F.least("an", "bn") - margin) / side)]
    high = [F.floor((F.greatest("ae", "be") + margin) / side), F.ceil((F.greatest("an", "bn") + margin) / side)]
    return spans.select(F.explode(F.sequence(low[0], high[0])).alias("we"), low[1].alias("lo"), high[1].alias("hi")).select("we", F.explode(F.sequence("lo", "hi")).alias("wn")).distinct()


_TIFF = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 12: "d", 16: "Q"}


def tiff_arrays(data: bytes) -> tuple[np.ndarray, float, float, float]:
    """(values, west, north, cell) of a single-band GeoTIFF in strips or tiles, plain or deflated, with or without a
    predictor of differences. Anything else raises ValueError."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF")
    at = struct.unpack(order + "I", data[4:8])[0]
    tags: dict[int, tuple] = {}
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        tag, kind, count = struct.unpack(order + "HHI", data[at + 2 + 12 * k : at + 10 + 12 * k])
        code = _TIFF.get(kind)
        if code and code != "II":
            size = struct.calcsize(code) * count
            where = at + 10 + 12 * k if size <= 4 else struct.unpack(order + "I", data[at + 10 + 12 * k : at + 14 + 12 * k])[0]
            tags[tag] = struct.unpack(f"{order}{count}{code}", data[where : where + size])
    width, height, bits = tags[256][0], tags[257][0], tags.get(258, (8,))[0]
    pressed, predictor, sample = tags.get(259, (1,))[0], tags.get(317, (1,))[0], tags.get(339, (1,))[0]
    if pressed not in (1, 8, 32946) or tags.get(277, (1,))[0] != 1 or predictor not in (1, 2):
        raise ValueError("a TIFF of another kind")
    kind = np.dtype(order + {1: "u", 2: "i", 3: "f"}[sample] + str(bits // 8))
    if 324 in tags:
        tw, th, offsets, sizes = tags[322][0], tags[323][0], tags[324], tags[325]
    else:
        tw, th, offsets, sizes = width, tags.get(278, (height,))[0], tags[273], tags[279]
    out = np.zeros((height, width), np.float64)
    across = -(-width // tw)
    for k, (o, n) in enumerate(zip(offsets, sizes, strict=True)):
        raw = data[o : o + n] if pressed == 1 else zlib.decompress(data[o : o + n])
        y, x = k // across * th, k % across * tw
        rows = th if 324 in tags else min(th, height - y)
        part = np.frombuffer(raw, kind, rows * tw).reshape(rows, tw)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=part.dtype)
        out[y : y + rows, x : x + tw] = part[: height - y, : width - x]
    cell, tie = tags[33550][0], tags[33922]
    return out, tie[3] - tie[0] * cell, tie[4] + tie[1] * cell, cell


def read_geotiffs(content: DataFrame, res: float = 1.0, least: float = -9998.0) -> DataFrame:
    """Cells (cx, cy, z) of binary files (path, content): the highest value in each cell of res; none at or below `least`."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for data in pdf["content"]:
                z, west, north, cell = tiff_arrays(bytes(data))
                r, c = np.nonzero(np.isfinite(z) & (z > least))
                yield pd.DataFrame({"cx": np.floor((west + (c + 0.5) * cell) / res).astype(np.int64), "cy": np.floor((north - (r + 0.5) * cell) / res).astype(np.int64), "z": z[r, c]})

    return content.select("content").mapInPandas(run, "cx long, cy long, z double").groupBy("cx", "cy").agg(F.max("z").alias("z"))
