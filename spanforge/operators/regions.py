"""Areas of work, chunks, and the table of results by region."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Box = tuple[float, float, float, float]
#: Side of a chunk in metres, and the margin that it loads around itself.
CHUNK, HALO = 8000.0, 1000.0
FORMAT = 2


def merge_areas(boxes: list[Box], reach: float) -> list[tuple[Box, list[int]]]:
    """Boxes (min_e, min_n, max_e, max_n) within reach of each other as one area, and so on until none are; smallest
    first. A handful of rectangles that somebody typed, so this runs where the job is planned."""
    areas = [(b, [i]) for i, b in enumerate(boxes)]
    while True:
        near = ((i, j) for i in range(len(areas)) for j in range(i + 1, len(areas)) if all(areas[i][0][k] - reach <= areas[j][0][k + 2] and areas[j][0][k] - reach <= areas[i][0][k + 2] for k in (0, 1)))
        pair = next(near, None)
        if pair is None:
            return sorted(areas, key=lambda a: ((a[0][2] - a[0][0]) * (a[0][3] - a[0][1]), a[0][0], a[0][1]))
        (a, who), (b, more) = areas[pair[0]], areas.pop(pair[1])
        areas[pair[0]] = ((min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])), who + more)


def chunks_over(boxes: DataFrame) -> DataFrame:
    """Chunks (ce, cn) that boxes touch, once each."""
    span = [F.explode(F.sequence(F.floor(F.col(f"min_{c}") / CHUNK), F.floor(F.col(f"max_{c}") / CHUNK))).alias(f"c{c}") for c in "en"]
    return boxes.select(span[0], "min_n", "max_n").select("ce", span[1]).distinct()


def chunk_boxes(chunks: DataFrame) -> DataFrame:
    """What each chunk owns (half-open) and what it loads, a margin more."""
    own = {"own_min_e": F.col("ce") * CHUNK, "own_min_n": F.col("cn") * CHUNK, "own_max_e": (F.col("ce") + 1) * CHUNK, "own_max_n": (F.col("cn") + 1) * CHUNK}
    load = {k.replace("own", "load"): (c - HALO if "min" in k else c + HALO) for k, c in own.items()}
    return chunks.withColumns(own).withColumns(load)


def write_region(lines: DataFrame, path: str, region: str) -> None:
    """Replace one region's rows of the results table; others stay."""
    out = lines.withColumn("format", F.lit(FORMAT)).withColumn("generated_at", F.current_timestamp()).withColumn("region_id", F.lit(region))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("region_id").parquet(path)


def read_regions(spark: SparkSession, path: str, wanted: list[str] | None = None) -> DataFrame:
    """Results of this format, of all regions or those wanted: a partition filter."""
    held = spark.read.parquet(path).where(F.col("format") == FORMAT)
    return held.where(F.col("region_id").isin(wanted)) if wanted is not None else held


def stale(regions: DataFrame, before: str | None = None, named: list[str] | None = None, box: Box | None = None) -> DataFrame:
    """Regions (region_id, generated_at, min_e, ...) to be searched anew: all, those older than a time, named, or touching a box."""
    pick = F.lit(before is None and named is None and box is None)
    if before is not None:
        pick = pick | (F.col("generated_at") < F.to_timestamp(F.lit(before)))
    if named is not None:
        pick = pick | F.col("region_id").isin(named)
    if box is not None:
        pick = pick | ((F.col("min_e") <= box[2]) & (F.col("max_e") >= box[0]) & (F.col("min_n") <= box[3]) & (F.col("max_n") >= box[1]))
    return regions.where(pick)


def parse_chunk_name(name: str) -> tuple[int, int]:
    m = re.fullmatch(r"(-?\d+)_(-?\d+)", name.strip())
    if not m:
        raise ValueError(f"not a chunk name: {name!r}")
    return int(m[1]), int(m[2])
