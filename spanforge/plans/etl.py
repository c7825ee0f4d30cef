"""From map data to blocks of features: three scans, two joins, one stitching, one write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.functions.scalars import to_utm
from spanforge.operators import ways
from spanforge.runtime import stage
from spanforge.sources.blocks import SIDE


#: Plausible places: south, west, north, east.
BOUNDS = (45.0, 5.0, 60.0, 25.0)


def features(nodes: DataFrame, lines: DataFrame, relations: DataFrame, bounds: tuple[float, float, float, float] = BOUNDS) -> DataFrame:
    """Features (id, kind, name, half, bridge, pts) of nodes (id, lat, lon), ways (id, refs, tags), relations (id, members, tags).

    Roads by class, water as areas or lines, water relations stitched to rings: inner ones are islands. Only nodes that kept
    ways name are joined, and only members of kept relations are looked up among ways. A node that one of these uses and that
    lies out of bounds is an error: the file was read wrong.
    """
    water = relations.withColumn("water", ways.water_kind(F.col("tags"))).where("water is not null")
    members = stage(water.select(F.col("id").alias("relation"), F.explode("members").alias("m")).where("m.type = 1").select("relation", F.col("m.ref").alias("id"), F.col("m.role").alias("role")), "members")
    classed = lines.withColumn("road", ways.classify_way(F.col("tags"))).withColumn("kept", ways.keep_way(F.col("tags")))
    part = members.select("id").distinct().withColumn("member", F.lit(True))
    wanted = stage(classed.join(part, "id", "left").where("kept is not null or member"), "wanted-ways")
    s, w, n, e = bounds
    sound = F.col("lat").between(s, n) & F.col("lon").between(w, e)
    placed = nodes.select("id", sound.alias("sound"), to_utm(F.col("lat"), F.col("lon")).alias("u")).select("id", F.when(F.col("sound"), F.col("u.e")).otherwise(F.lit(float("nan"))).alias("e"), "u.n")
    found = ways.geometry(wanted.select("id", "refs"), placed)
    outside = F.exists("pts", lambda p: F.isnan(p["e"]))
    shapes = stage(found.withColumn("pts", F.when(outside, F.raise_error(F.concat(F.lit("a node out of bounds in way "), F.col("id").cast("string")))).otherwise(F.col("pts"))), "shapes")
    tag = F.coalesce(F.try_element_at("tags", F.lit("bridge")), F.lit("no"))
    own = wanted.where("kept is not null").join(shapes, "id").select(
        "id", F.coalesce("road.tier", "kept").alias("kind"), F.coalesce("road.kind", "kept").alias("name"), F.coalesce("road.half", F.lit(0.0)).alias("half"), ((tag != "no") & F.col("road").isNotNull()).alias("bridge"), "pts"
    )
    lines_of = members.join(shapes, "id").select(F.when(F.col("role") == "inner", F.col("relation") * 2 + 1).otherwise(F.col("relation") * 2).alias("relation"), F.col("id").alias("way"), "pts")
    rings = ways.stitch(lines_of)
    kind = F.when(F.col("relation") % 2 == 1, "island").otherwise("water")
    stitched = rings.select((-F.abs(F.xxhash64("relation", "ring") % (1 << 52)) - 1).alias("id"), kind.alias("kind"), kind.alias("name"), F.lit(0.0).alias("half"), F.lit(False).alias("bridge"), F.col("ring").alias("pts"))
    return own.unionByName(stitched)


def by_block(found: DataFrame, side: float = float(SIDE)) -> DataFrame:
    """Features whole in every block that they touch, with the block's name."""
    return ways.blocks_of(found, side).withColumn("block", F.concat_ws("-", F.col("be").cast("string"), F.col("bn").cast("string"))).drop("be", "bn")


def census(found: DataFrame) -> DataFrame:
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.size("pts")).alias("points"))
