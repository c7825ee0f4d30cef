"""Raster algebra on cell tables (cx, cy, z). A cell without data is a row that is not there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.params import DEFAULTS
from spanforge.runtime import BROADCAST_ROWS, stage


def blit_max(samples: DataFrame, cx: Column, cy: Column, z: Column) -> DataFrame:
    """Samples dropped onto a grid: the highest in each cell wins. Sums are pre-aggregated map-side."""
    return samples.select(cx.alias("cx"), cy.alias("cy"), z.cast("double").alias("z")).where("z is not null").groupBy("cx", "cy").agg(F.max("z").alias("z"))


def downsample(cells: DataFrame, factor: int) -> DataFrame:
    """Means over squares of factor * factor cells."""
    return cells.groupBy(F.floor(F.col("cx") / factor).alias("cx"), F.floor(F.col("cy") / factor).alias("cy")).agg(F.avg("z").alias("z"))


def extent(cells: DataFrame, threshold: float) -> DataFrame:
    return cells.agg(F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.count("z").alias("n_valid"), F.count_if(F.col("z") >= threshold).alias("n_high"))


def min_filter(cells: DataFrame, radius: int, tile: int = 256) -> DataFrame:
    """Lowest z (low) in the square of `radius` cells around each cell that has data.

    Short reaches spread each value to its neighbours along one axis, then the other, with minima taken in
    each task first: 2 * (2 r + 1) rows a cell and no order. Long ones use range windows along each axis.
    """
    if radius <= 8:
        out = cells.withColumnRenamed("z", "low")
        for axis, other in (("cx", "cy"), ("cy", "cx")):
            spread = out.select(F.explode(F.sequence(F.col(axis) - radius, F.col(axis) + radius)).alias(axis), other, "low")
            out = spread.groupBy("cx", "cy").agg(F.min("low").alias("low"))
        return cells.join(out, ["cx", "cy"])
    # lines that a centre needs from above and below may lack a row at its column: valueless rows stand there
    places = cells.select("cx", F.explode(F.sequence(F.col("cy") - radius, F.col("cy") + radius)).alias("cy")).distinct()
    lines = places.join(cells, ["cx", "cy"], "left").withColumn("low", F.col("z"))
    return _slide(_slide(lines, "cx", "cy", radius, tile), "cy", "cx", radius, tile).where("z is not null")


def _slide(lines: DataFrame, axis: str, across: str, radius: int, tile: int) -> DataFrame:
    """Minimum along one axis. A window is one strip of `tile` cells and the `radius` cells on either side, not a whole row."""
    strip = F.floor(F.col(axis) / tile)
    w = Window.partitionBy(across, "strip").orderBy(axis).rangeBetween(-radius, radius)
    strips = F.sequence(F.floor((F.col(axis) - radius) / tile), F.floor((F.col(axis) + radius) / tile))
    wide = lines.withColumn("strip", F.explode(strips)).withColumn("low", F.min("low").over(w))
    return wide.where(F.col("strip") == strip).drop("strip")


def drop_field(cells: DataFrame, radius: int) -> DataFrame:
    """How far the lowest cell around lies below each cell; a cell is in its own square, so never negative."""
    return min_filter(cells, radius).withColumn("drop", F.col("z") - F.col("low"))


def tile_passes(drops: DataFrame, tile: int, threshold: float, value: str = "drop") -> DataFrame:
    """Cells seen and cells that pass, by tile."""
    seen = drops.groupBy(F.floor(F.col("cx") / tile).alias("tx"), F.floor(F.col("cy") / tile).alias("ty"))
    return seen.agg(F.count("*").alias("seen"), F.count_if(F.col(value) >= threshold).alias("passed"))


def tile_verdicts(drops: DataFrame, tile: int, threshold: float, share: float = DEFAULTS.mask_coverage, value: str = "drop") -> DataFrame:
    """Whether each tile that is at least half seen passes."""
    passes = tile_passes(drops, tile, threshold, value).where(F.col("seen") * 2 >= tile * tile)
    return passes.withColumn("pass", F.col("passed") >= share * tile * tile)


def tiles_worth_loading(drops: DataFrame, tile: int, threshold: float, reach: int, share: float = DEFAULTS.mask_coverage, value: str = "drop") -> DataFrame:
    """Tiles within reach of a passing cell of a tile with enough of them. Passing cells are folded to the tiles that
    they reach before anything is exploded."""
    high = drops.where(F.col(value) >= threshold).withColumn("tx", F.floor(F.col("cx") / tile)).withColumn("ty", F.floor(F.col("cy") / tile))
    enough = high.groupBy("tx", "ty").count().where(F.col("count") >= share * tile * tile).select("tx", "ty")
    box = high.join(enough, ["tx", "ty"], "left_semi").select(
        F.floor((F.col("cx") - reach) / tile).alias("x0"), F.floor((F.col("cx") + reach) / tile).alias("x1"), F.floor((F.col("cy") - reach) / tile).alias("y0"), F.floor((F.col("cy") + reach) / tile).alias("y1")
    )
    return box.distinct().select(F.explode(F.sequence("x0", "x1")).alias("tx"), "y0", "y1").select("tx", F.explode(F.sequence("y0", "y1")).alias("ty")).distinct()


def roof_tiles(roofs: DataFrame, ground: DataFrame, tile: int, drop: float = DEFAULTS.roof_drop, least: int = DEFAULTS.mask_roofs, ring: int = 1) -> DataFrame:
    """Tiles around those with enough roofs (tx, ty, z) that stand `drop` above the tile's lowest ground."""
    low = ground.groupBy(F.floor(F.col("cx") / tile).alias("tx"), F.floor(F.col("cy") / tile).alias("ty")).agg(F.min("z").alias("low"))
    high = roofs.join(low, ["tx", "ty"]).where(F.col("z") >= F.col("low") + drop).groupBy("tx", "ty").count().where(F.col("count") >= least)
    around = [F.explode(F.sequence(F.col(c) - ring, F.col(c) + ring)).alias(c) for c in ("tx", "ty")]
    return high.select(around[0], "ty").select("tx", around[1]).distinct()


def raise_onto(ground: DataFrame, roofs: DataFrame, loaded: DataFrame | None = None, tile: int = 1000) -> DataFrame:
    """Ground or roof, whichever is higher, and whether the cell is a roof; a roof fills a cell without ground.

    Only tiles (tx, ty) that are loaded (by default those that have any ground) get roofs: over others they would stand on nothing.
    """
    at = {"tx": F.floor(F.col("cx") / tile), "ty": F.floor(F.col("cy") / tile)}
    loaded = ground.select(*[c.alias(k) for k, c in at.items()]).distinct() if loaded is None else loaded.select("tx", "ty").distinct()
    roofs = roofs.withColumns(at).join(loaded, ["tx", "ty"], "left_semi").drop("tx", "ty")
    both = ground.withColumnRenamed("z", "g").join(roofs.withColumnRenamed("z", "r"), ["cx", "cy"], "full")
    return both.select("cx", "cy", F.greatest("g", "r").alias("z"), F.col("r").isNotNull().alias("roof"))


def nearest(points: DataFrame, cells: DataFrame, e: str = "e", n: str = "n", res: float = 1.0) -> DataFrame:
    """points with z of the cell that each lies in; null where there is none."""
    keyed = points.withColumn("cx", F.floor(F.col(e) / res)).withColumn("cy", F.floor(F.col(n) / res))
    return keyed.join(cells, ["cx", "cy"], "left").drop("cx", "cy")


def bilinear(points: DataFrame, cells: DataFrame, key: str | list[str], e: str = "e", n: str = "n", res: float = 1.0, name: str = "z") -> DataFrame:
    """points with the value between the four cell centres around each; with any of the four missing, that of its own cell."""
    keys = [key] if isinstance(key, str) else key
    x, y = F.col(e) / res - 0.5, F.col(n) / res - 0.5
    corners = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (0, 1) for j in (0, 1)])
    at = points.select(*keys, e, n).withColumn("x0", F.floor(x)).withColumn("y0", F.floor(y)).withColumn("fx", x - F.floor(x)).withColumn("fy", y - F.floor(y))
    at = at.withColumn("corner", F.explode(corners)).withColumn("cx", F.col("x0") + F.col("corner.dx")).withColumn("cy", F.col("y0") + F.col("corner.dy"))
    weight = F.when(F.col("corner.dx") == 1, F.col("fx")).otherwise(1 - F.col("fx")) * F.when(F.col("corner.dy") == 1, F.col("fy")).otherwise(1 - F.col("fy"))
    mine = (F.col("cx") == F.floor(F.col(e) / res)) & (F.col("cy") == F.floor(F.col(n) / res))
    got = at.join(cells.select("cx", "cy", "z"), ["cx", "cy"], "left").groupBy(*keys).agg(F.count("z").alias("have"), F.sum(weight * F.col("z")).alias("mixed"), F.max(F.when(mine, F.col("z"))).alias("own"))
    return points.join(got.select(*keys, F.when(F.col("have") == 4, F.col("mixed")).otherwise(F.col("own")).alias(name)), keys, "left")


def disc_min(points: DataFrame, cells: DataFrame, key: str, radius: float, res: float = 1.0, e: str = "e", n: str = "n") -> DataFrame:
    """Lowest z in a disc: rows of the disc are sampled from its western rim on, a cell apart.

    Spark reckons the listed spots no larger than the points and would send them all to the driver for a broadcast, so
    the join is named here: cells in the box of the points are broadcast if they are few, else both sides are shuffled.
    A cell that a disc samples twice doesn't change its minimum.
    """
    rows = F.explode(F.transform(F.sequence(F.lit(0), F.lit(int(2 * radius / res))), lambda i: i * res - radius))
    at = points.select(key, e, n, rows.alias("dn")).withColumn("half", F.sqrt(F.lit(radius * radius) - F.col("dn") * F.col("dn")))
    at = at.withColumn("de", F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.col("half") * 2 / res).cast("int")), lambda i: i * res - F.col("half"))))
    at = at.select(key, F.floor((F.col(e) + F.col("de")) / res).alias("cx"), F.floor((F.col(n) + F.col("dn")) / res).alias("cy"))
    known = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in (e, n)]
    box = points.agg(*[f(c).alias(f"{f.__name__}{k}") for k, c in enumerate(known) for f in (F.min, F.max)]).first()
    for c, low, high in (("cx", box[0], box[1]), ("cy", box[2], box[3])):
        if low is not None:
            cells = cells.where((F.col(c) >= F.lit((low - radius) / res - 2)) & (F.col(c) <= F.lit((high + radius) / res + 2)))
    cells = stage(cells.select("cx", "cy", "z"), "disc-cells")
    few = cells.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return at.join(F.broadcast(cells) if few else cells.hint("merge"), ["cx", "cy"]).groupBy(key).agg(F.min("z").alias("lowest"))


def pack(cells: DataFrame) -> DataFrame:
    """z in tenths as a short, within its range; null (no data) stays null."""
    tenths = F.least(F.lit(32767.0), F.greatest(F.lit(-32767.0), F.floor(F.col("z") * 10 + 0.5)))
    return cells.select("cx", "cy", tenths.cast("short").alias("v"))


def unpack(packed: DataFrame) -> DataFrame:
    return packed.where("v is not null").select("cx", "cy", (F.col("v") / F.lit(10.0)).alias("z"))
