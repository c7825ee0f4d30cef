"""Outlines near points, ground beyond a line's ends, chunks from runs, what was searched, which data a state has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.operators import raster
from spanforge.operators.cover import inside

# Metres a degree, the margin around a state's outline in metres, samples and share of a wing.
DEGREE = 111_320.0
MARGIN = 6000.0
WING_STEPS, WING_SHARE = 20, 0.02


def _off(ring: Column, lon: Column, lat: Column) -> Column:
    """Metres from a point to the nearest edge of a ring of degrees, on a plane laid through the point."""
    n = F.size(ring)
    kx = F.cos(F.radians(lat)) * DEGREE
    local = F.transform(ring, lambda p: F.struct(((p["e"] - lon) * kx).alias("x"), ((p["n"] - lat) * DEGREE).alias("y")))
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(local, F.pmod(i + n - 1, n)).alias("a"), F.get(local, i).alias("b")))

    def square(s: Column) -> Column:
        a, dx, dy = s["a"], s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        t = F.coalesce(-(a["x"] * dx + a["y"] * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
        x, y = a["x"] + dx * t, a["y"] + dy * t
        return x * x + y * y

    return F.sqrt(F.array_min(F.transform(edges, square)))


def near_outlines(points: DataFrame, outlines: DataFrame, keys: list[str], margin: float = MARGIN, side: float = 0.5) -> DataFrame:
    """(keys, name): the outlines (name, ring of (e, n) as degrees; several rows a name) that hold each point (keys, e, n)
    or have an edge within the margin.

    Rings are listed by the cells of their boxes, grown by the margin, so that a point meets only those near it. Null
    coordinates are near nothing.
    """
    rings = outlines.where(F.size("ring") > 0).select("name", "ring", F.transform("ring", lambda p: p["e"]).alias("x"), F.transform("ring", lambda p: p["n"]).alias("y"))
    up = margin / DEGREE
    furthest = F.least(F.lit(89.0), F.greatest(F.abs(F.array_min("y")), F.abs(F.array_max("y"))) + up)
    grown = {"x": up / F.cos(F.radians(furthest)), "y": F.lit(up)}
    cells = [F.sequence(F.floor((F.array_min(c) - g) / side), F.floor((F.array_max(c) + g) / side)) for c, g in grown.items()]
    listed = rings.select("name", "ring", F.explode(cells[0]).alias("ce"), cells[1].alias("rows")).select("name", "ring", "ce", F.explode("rows").alias("cn"))
    at = points.select(*keys, "e", "n", F.floor(F.col("e") / side).alias("ce"), F.floor(F.col("n") / side).alias("cn"))
    met = at.join(listed, ["ce", "cn"])
    near = inside(F.col("ring"), F.col("e"), F.col("n")) | (_off(F.col("ring"), F.col("e"), F.col("n")) <= margin)
    return met.where(near).select(*keys, "name").distinct()


def covered_by(points: DataFrame, sources: DataFrame, outlines: DataFrame, keys: list[str], margin: float = MARGIN) -> DataFrame:
    """Points with the source (source, priority, surface, outline) of the lowest priority that covers each; a source whose
    outline is null or unknown covers everywhere. Null where none does."""
    known = outlines.select(F.col("name").alias("outline")).distinct()
    held = sources.join(known.withColumn("drawn", F.lit(True)), "outline", "left")
    pick = F.min_by(F.struct("source", "surface"), "priority")
    near = near_outlines(points, outlines, keys, margin).withColumnRenamed("name", "outline").join(held, "outline").select(*keys, "source", "priority", "surface")
    drawn = near.groupBy(*keys).agg(pick.alias("best"), F.min("priority").alias("priority"))
    shared = held.where("drawn IS NULL").agg(pick.alias("best"), F.min("priority").alias("last")).first()
    fields = drawn.schema["best"].dataType
    anywhere, last = F.lit(None).cast(fields), F.lit(None).cast("long")
    if shared["last"] is not None:
        anywhere = F.struct(F.lit(shared["best"]["source"]).alias("source"), F.lit(shared["best"]["surface"]).alias("surface")).cast(fields)
        last = F.lit(shared["last"])
    out = points.join(drawn, keys, "left")
    best = F.when(F.col("priority") <= F.coalesce(last, F.col("priority")), F.col("best")).otherwise(anywhere)
    return out.withColumn("best", best).select(*points.columns, "best.source", "best.surface")


def integration(states: DataFrame, sources: DataFrame, outlines: DataFrame, searched: DataFrame, shared: str, margin: float = MARGIN) -> DataFrame:
    """What each state (code, name, e, n: a place inside it) has: whose ground data, a surface or not, lines or not."""
    at = covered_by(states, sources, outlines, ["code"], margin)
    ground = F.when(F.col("source") != shared, "survey").otherwise("shared")
    out = at.join(searched.select("name").distinct().withColumn("lines", F.lit(True)), "name", "left")
    return out.select("code", "name", F.coalesce(ground, F.lit("shared")).alias("ground"), F.coalesce("surface", F.lit(False)).alias("canopy"), F.coalesce("lines", F.lit(False)).alias("lines"))


def wings(lines: DataFrame, ground: DataFrame, surface: DataFrame | None = None, res: float = 1.0) -> DataFrame:
    """(id, side, k, d, e, n, ground, surface): the ground beyond both ends of lines (id, ae, an, be, bn), 21 samples over 2 %
    of the span a side. Without surface data it is the ground. Samples without ground are left out, and lines with fewer
    than two samples on either side; d is metres from the first end, below nought before it."""
    long = F.sqrt((F.col("be") - F.col("ae")) * (F.col("be") - F.col("ae")) + (F.col("bn") - F.col("an")) * (F.col("bn") - F.col("an")))
    spans = lines.withColumn("long", long).where("long > 0")
    arm = F.col("long") * WING_SHARE
    sides = F.array(F.struct(F.lit("before").alias("side"), (-arm).alias("start")), F.struct(F.lit("after").alias("side"), F.col("long").alias("start")))
    at = spans.withColumn("w", F.explode(sides)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(WING_STEPS)))).withColumn("d", F.col("w.start") + arm * F.col("k") / WING_STEPS)
    at = at.select("id", "w.side", "k", "d", (F.col("ae") + (F.col("be") - F.col("ae")) / F.col("long") * F.col("d")).alias("e"), (F.col("an") + (F.col("bn") - F.col("an")) / F.col("long") * F.col("d")).alias("n"))
    keys = ["id", "side", "k"]
    read = raster.bilinear(at, ground, keys, res=res, name="ground").where("ground IS NOT NULL")
    read = raster.bilinear(read, surface, keys, res=res, name="surface") if surface is not None else read.withColumn("surface", F.lit(None).cast("double"))
    n = [F.count_if(F.col("side") == s).over(Window.partitionBy("id")) for s in ("before", "after")]
    return read.withColumn("most", F.greatest(*n)).where("most >= 2").select(*keys, "d", "e", "n", "ground", F.coalesce("surface", "ground").alias("surface"))


def chunks_of_runs(runs: DataFrame) -> DataFrame:
    """(chunk) names of rows of chunks: runs (n, first, last), both ends included."""
    return runs.select(F.explode(F.sequence("first", "last")).alias("e"), "n").select(F.concat_ws("_", F.col("e").cast("string"), F.col("n").cast("string")).alias("chunk"))


def tile_census(covered: DataFrame, kept: DataFrame, side: int = 8) -> DataFrame:
    """One row of counts over tiles (te, tn) with any ground and those worth loading, repeats counted once: tiles, their
    chunks, and kept tiles a kept chunk."""

    tagged = [tiles.select("te", "tn").distinct().withColumn("which", F.lit(k)) for k, tiles in enumerate((covered, kept))]
    chunk = [F.floor(F.col(c) / side).alias(f"c{c[1]}") for c in ("te", "tn")]
    per = tagged[0].unionByName(tagged[1]).groupBy("which", *chunk).agg(F.count("*").alias("tiles"))
    each = [x for k, name in enumerate(("covered", "kept")) for x in (F.coalesce(F.sum(F.when(F.col("which") == k, F.col("tiles"))), F.lit(0)).alias(name), F.count_if(F.col("which") == k).alias(f"chunks_{name}"))]
    return per.agg(*each).withColumn("kept_a_chunk", F.col("kept") / F.greatest(F.lit(1), F.col("chunks_kept")))


def clashes(chunks: DataFrame, drawn: DataFrame, side: float = 8000.0) -> DataFrame:
    """Chunks (ce, cn) whose own ground a drawn box (min_e, min_n, max_e, max_n) overlaps by more than an edge."""
    span = [F.sequence(F.floor(F.col(f"min_{c}") / side), F.greatest(F.floor(F.col(f"min_{c}") / side), F.ceil(F.col(f"max_{c}") / side) - 1)) for c in "en"]
    real = drawn.where("min_e < max_e AND min_n < max_n")
    hit = real.select(F.explode(span[0]).alias("ce"), span[1].alias("rows")).select("ce", F.explode("rows").alias("cn")).distinct()
    return chunks.join(hit, ["ce", "cn"], "left_semi")


def with_extent(crossings: DataFrame) -> DataFrame:
    """Crossings of the older form (d, half, no stretch) with their stretch from and to; an unknown half is nought."""
    half = F.coalesce("half", F.lit(0.0))
    whole = F.col("from").isNotNull() & F.col("to").isNotNull()
    ends = {"from": F.col("d") - half, "to": F.col("d") + half, "offset": F.coalesce("offset", F.lit(0.0))}
    return crossings.withColumns({k: F.when(whole, F.col(k)).otherwise(v) for k, v in ends.items()}).drop("half")
