"""What lies under points and around places: buildings, water, searched ground."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.scalars import to_utm
from spanforge.operators import ways


def inside(ring: Column, x: Column, y: Column) -> Column:
    """Whether a ring (array of (e, n)) encloses a point, even-odd."""
    n = F.size(ring)

    def hit(p: Column, i: Column) -> Column:
        q = F.get(ring, F.pmod(i + n - 1, n))
        rises = (p["n"] > y) != (q["n"] > y)
        at = p["e"] + (y - p["n"]) / F.nullif(q["n"] - p["n"], F.lit(0.0)) * (q["e"] - p["e"])
        return F.when(rises & (x < at), 1).otherwise(0)

    return F.aggregate(F.transform(ring, hit), F.lit(0), lambda s, v: s + v) % 2 == 1


def cover(points: DataFrame, polygons: DataFrame, keys: list[str], side: float = 100.0) -> DataFrame:
    """points (keys, e, n) with cover: building before water, water only off islands, none otherwise.

    polygons (kind building, water or island; ring) are listed by the cells of their boxes, so a place meets only rings
    near it, each place once, however many points lie there. The exact test, which walks the ring, follows on those whose
    box holds the place; the box is widened by more than rounding could move an edge.
    """
    e, n = F.transform("ring", lambda p: p["e"]), F.transform("ring", lambda p: p["n"])
    boxes = polygons.select("kind", "ring", F.array_min(e).alias("w"), F.array_max(e).alias("o"), F.array_min(n).alias("s"), F.array_max(n).alias("h"))
    spans = [F.sequence(F.floor(F.col(a) / side), F.floor(F.col(b) / side)) for a, b in (("w", "o"), ("s", "h"))]
    listed = boxes.withColumn("ce", F.explode(spans[0])).withColumn("cn", F.explode(spans[1]))
    spots = points.select("e", "n").distinct().withColumn("ce", F.floor(F.col("e") / side)).withColumn("cn", F.floor(F.col("n") / side))
    pad = (F.col("o") - F.col("w")) * 1e-9
    held = (F.col("e") >= F.col("w") - pad) & (F.col("e") <= F.col("o") + pad) & (F.col("n") >= F.col("s")) & (F.col("n") <= F.col("h"))
    met = spots.join(listed.hint("merge"), ["ce", "cn"]).where(held).where(inside(F.col("ring"), F.col("e"), F.col("n")))
    met = met.groupBy("e", "n").agg(*[F.max(F.col("kind") == k).alias(k) for k in ("building", "water", "island")])
    kind = F.when(F.col("building"), "building").when(F.col("water") & ~F.col("island"), "water").otherwise("none")
    out = points.join(met.select("e", "n", kind.alias("cover")), ["e", "n"], "left").withColumn("cover", F.coalesce("cover", F.lit("none")))
    return out.select(*keys, *[c for c in points.columns if c not in keys], "cover")


def held_if_complete(wanted: DataFrame, held: DataFrame, key: str, group: str) -> DataFrame:
    """Rows of held for each group of wanted blocks, only where none of the group's blocks is missing: unknown is not none."""
    blocks = held.select(key).distinct()
    missing = wanted.join(blocks, key, "left_anti").select(group).distinct()
    return wanted.join(missing, group, "left_anti").join(held, key)


def around(points: DataFrame, cells: DataFrame, key: str, radius: float, res: float = 1.0, least: float = 0.75) -> DataFrame:
    """Relief, highest value, and shares of canopy and roofs in a circle; null where under `least` of its cells are known.

    cells (cx, cy, z, cover); the circle is counted in whole cells from the point's own.
    """
    reach = max(1.5, radius / res)
    k = int(-(-reach // 1))
    steps = [(i, j) for i in range(-k, k + 1) for j in range(-k, k + 1) if (i * i + j * j) ** 0.5 <= reach]
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])
    at = points.select(key, F.floor(F.col("e") / res).alias("x"), F.floor(F.col("n") / res).alias("y"), F.explode(offsets).alias("o"))
    at = at.select(key, (F.col("x") + F.col("o.i")).alias("cx"), (F.col("y") + F.col("o.j")).alias("cy"))
    got = at.join(cells, ["cx", "cy"], "left").groupBy(key).agg(
        F.count("z").alias("seen"), F.min("z").alias("low"), F.max("z").alias("high"), F.count_if(F.col("z").isNotNull() & (F.col("cover") == "canopy")).alias("wooded"), F.count_if(F.col("z").isNotNull() & (F.col("cover") == "building")).alias("roofed")
    )
    known = F.col("seen") >= least * len(steps)

    def figure(c: Column) -> Column:
        return F.when(known, c)

    return got.select(key, figure(F.col("high") - F.col("low")).alias("relief"), figure(F.col("high")).alias("top"), figure(F.col("wooded") / F.col("seen")).alias("canopy"), figure(F.col("roofed") / F.col("seen")).alias("building"))


def searched_areas(outlines: DataFrame, searched: DataFrame, step: float = 0.04, cell: float = 2000.0, share: float = 0.5) -> DataFrame:
    """Names of areas (name, ring of (e, n) as longitude and latitude) of which at least `share` lies in searched boxes
    (min_e, min_n, max_e, max_n): sampled on a grid of `step` degrees, looked up by cells of 2 km."""
    spots = ways.fill(outlines.select(F.col("name").alias("id"), "ring"), step).withColumnRenamed("id", "name")
    on = to_utm((F.col("cy") + 0.5) * step, (F.col("cx") + 0.5) * step)
    spots = spots.withColumn("u", on).select("name", F.floor(F.col("u.e") / cell).alias("ce"), F.floor(F.col("u.n") / cell).alias("cn"))
    span = [F.sequence(F.floor(F.col(f"min_{c}") / cell), F.floor(F.col(f"max_{c}") / cell)) for c in "en"]
    done = searched.select(F.explode(span[0]).alias("ce"), span[1].alias("rows")).select("ce", F.explode("rows").alias("cn")).distinct().withColumn("hit", F.lit(1))
    return spots.join(done, ["ce", "cn"], "left").groupBy("name").agg(F.count("hit").alias("hit"), F.count("*").alias("inside")).where(F.col("hit") >= share * F.col("inside")).select("name")


def relief_to_chord(spans: DataFrame, stations: DataFrame) -> DataFrame:
    """Deepest ground under the chord of each span: spans (id, z0, z1), stations (id, t, z)."""
    drop = F.col("z0") + (F.col("z1") - F.col("z0")) * F.col("t") - F.col("z")
    return stations.join(spans, "id").groupBy("id").agg(F.max(drop).alias("drop"))


def evicted(cache: DataFrame, limit: int, keep: float = 0.8, size: str = "bytes", used: str = "used_at") -> DataFrame:
    """Entries that go when a cache is over its limit: the least recently used, until it is down to `keep` of it."""
    w = Window.orderBy(F.desc(used), "key").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(size).over(Window.partitionBy())
    return cache.withColumn("upto", F.sum(size).over(w)).withColumn("total", total).where((F.col("total") > limit) & (F.col("upto") > limit * keep)).drop("upto", "total")
