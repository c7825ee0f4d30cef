"""Outputs: lines by kind, dumps, masks, overlays, and the query part of a link."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from urllib.parse import parse_qs, urlencode

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.operators import dataset
from spanforge.sources.blocks import simplify


def write_lines(lines: DataFrame, path: str) -> None:
    """Published rows, a folder for each kind."""
    rows = lines.select("id", "kind").join(dataset.shipped(lines), "id")
    rows.write.mode("overwrite").partitionBy("kind").json(path)


def read_lines(spark, path: str) -> DataFrame:
    """Published rows with their kind, from the folder's name."""
    return spark.read.json(path)


def write_columns(rows: DataFrame, path: str) -> None:
    """A table as Parquet, which holds columns apart and streams its pages."""
    rows.write.mode("overwrite").parquet(path)


def mask(cells: DataFrame) -> DataFrame:
    """Cells that several regions saw: the highest of their values."""
    return cells.groupBy("lat", "lon").agg(F.max("drop").alias("drop"))


def write_spots(spots: DataFrame, path: str) -> None:
    """Spots by kind, the most visited first within a file, ties by rank."""
    spots.repartition("kind").sortWithinPartitions(F.desc("count"), F.desc("score"), "e", "n").write.mode("overwrite").partitionBy("kind").json(path)


def missing_regions(wanted: DataFrame, held: DataFrame, empty: dict[str, str]) -> DataFrame:
    """A row with no results for each region that is not held yet."""
    rows = wanted.join(held.select("region_id").distinct(), "region_id", "left_anti")
    return rows.withColumns({k: F.lit(None).cast(t) for k, t in empty.items()})


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One small file in any store that Spark writes to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


#: Floors of the published ends of the filters.
FLOORS = {"score": 1.0, "length": 100.0, "exposure": 10.0}


def meta(lines: DataFrame, stats: dict[str, float], kinds: tuple[str, ...] = ("natural", "urban")) -> DataFrame:
    """One row about a dataset: lines of each kind, the upper ends of the filters, figures of the run, when it was made."""
    counts = [F.count_if(F.col("kind") == k).alias(f"count_{k}") for k in kinds]
    tops = [F.coalesce(F.ceil(F.greatest(F.max(c), F.lit(v))).cast("long"), F.lit(int(v))).alias(f"max_{c}") for c, v in FLOORS.items()]
    return lines.agg(*counts, *tops).withColumns({f"stat_{k}": F.lit(v) for k, v in stats.items()}).withColumn("generated_at", F.current_timestamp())


def write_meta(about: DataFrame, path: str) -> None:
    write_text(about.sparkSession, about.select(F.to_json(F.struct("*"))).first()[0], path)


def all_of(frames: list[DataFrame]) -> DataFrame:
    """Rows of all regions one after another, repeats kept; columns that some lack are null there."""
    if not frames:
        raise ValueError("nothing to put together")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_usage(frames: list[DataFrame], path: str) -> None:
    """How the tiles of all regions were used; a tile that two regions used is there twice."""
    all_of(frames).write.mode("overwrite").json(path)


def write_blocks(packed: DataFrame, path: str, source: str, side: int) -> None:
    """Block files' contents (block, content) as a table, and an index beside it: side, source, time, names in order."""
    packed.write.mode("overwrite").parquet(f"{path}/blocks")
    spark = packed.sparkSession
    names = spark.read.parquet(f"{path}/blocks").agg(F.array_sort(F.collect_list("block")).alias("blocks"))  # a name for 64 km2 of map
    index = names.select(F.to_json(F.struct(F.lit(side).alias("block"), F.lit(source).alias("source"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("generated"), "blocks")))
    write_text(spark, index.first()[0], f"{path}/index.json")


def thinned(outlines: DataFrame, tolerance: float) -> DataFrame:
    """Outlines (name, lines) without the points that lie within tolerance of what stays; each row by itself."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            lines = [[[{"e": e, "n": n} for e, n in simplify([(q["e"], q["n"]) for q in line], tolerance)] for line in row if len(line)] for row in pdf["lines"]]
            yield pd.DataFrame({"name": pdf["name"], "lines": pd.Series(lines, dtype=object, index=pdf.index)})

    return outlines.where("lines IS NOT NULL").select("name", "lines").mapInPandas(run, "name string, lines array<array<struct<e:double,n:double>>>")


def write_outlines(outlines: DataFrame, path: str, tolerance: float | None = None) -> None:
    """Named lines as one collection of features; areas are few and thinned first, so it is put together on the driver."""
    rows = outlines if tolerance is None else thinned(outlines, tolerance)
    shape = F.struct(F.lit("MultiLineString").alias("type"), F.transform("lines", lambda line: F.transform(line, lambda q: F.array(q["e"], q["n"]))).alias("coordinates"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("name").alias("properties"), shape.alias("geometry")))
    whole = [json.loads(r[0]) for r in rows.orderBy("name").select(feature).toLocalIterator()]
    write_text(rows.sparkSession, json.dumps({"type": "FeatureCollection", "features": whole}), path)


#: Parameters of a link for each filter, with the value that filters nothing and is left out.
FILTERS = {"score": 0.0, "len": 0.0, "maxlen": math.inf, "air": 0.0, "canopy": 100.0, "level": 100.0}


def _plain(v: float, digits: int) -> str:
    text = f"{v:.{digits}f}"
    return text.rstrip("0").rstrip(".") if "." in text else text


def box_text(box: tuple[float, float, float, float]) -> str:
    """South, west, north, east with as many digits as a hundredth of the shorter side needs, rounded outward."""
    s, w, n, e = box
    side = min(n - s, e - w)
    digits = min(5, max(2, math.ceil(-math.log10(side / 100)) if side > 0 else 5))
    unit = 10.0**digits

    def snap(v: float, up: bool) -> float:
        x = v * unit
        slack = max(abs(x), 1.0) * 1e-12
        return (math.ceil(x - slack) if up else math.floor(x + slack)) / unit

    return ",".join(_plain(snap(v, up), digits) for v, up in zip(box, (False, False, True, True), strict=True))


def to_query(state: dict) -> str:
    """The query part for a state: box, line, sag, kinds and filters; defaults are left out."""
    out: dict[str, str] = {}
    if state.get("box"):
        out["at"] = box_text(state["box"])
    if state.get("line"):
        out["line"] = state["line"]
    if state.get("sag") is not None:
        out["sag"] = f"{state['sag']:.1f}"
    if state.get("kinds") is not None:
        out["kinds"] = ",".join(state["kinds"])
    for name, default in FILTERS.items():
        v = state.get("filters", {}).get(name, default)
        if v != default:
            out[name] = _plain(v, 3)
    return urlencode(out, safe=",")


def from_query(text: str) -> dict:
    """The state of a query part. What does not parse is as if it were not there."""
    q = {k: v[-1] for k, v in parse_qs(text.lstrip("?"), keep_blank_values=True).items()}

    def numbers(name: str, count: int) -> list[float] | None:
        try:
            got = [float(x) for x in q.get(name, "").split(",")]
        except ValueError:
            return None
        return got if len(got) == count and all(map(math.isfinite, got)) else None

    out: dict = {"box": tuple(numbers("at", 4) or ()) or None, "line": q.get("line"), "sag": (numbers("sag", 1) or [None])[0], "kinds": None, "filters": {}}
    if "kinds" in q:
        known = [k for k in ("natural", "urban") if k in q["kinds"].split(",")]
        out["kinds"] = known if known or not q["kinds"] else None
    for name in FILTERS:
        got = numbers(name, 1)
        if got:
            out["filters"][name] = got[0]
    return out
