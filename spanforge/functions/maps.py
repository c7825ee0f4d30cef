"""Column functions for showing what was found: map tiles, sliders, ages, counts in words, shades. All JVM-side."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanforge.functions.scalars import TRUNK_SHARE, bearing, ground_distance, half_up, rig_max, to_utm
from spanforge.params import DEFAULTS, Params

# The sphere of web maps and half the side of its square, the tiles across a patch, the zooms there are.
RADIUS = 6378137.0
EDGE = 20037508.342789244
ACROSS = 5
ZOOMS = (10, 19)
# Steps of a track, the longest span that is drawn by hand, the least ceiling of a rig, the brightness of level ground.
STEPS = 240
LONGEST = 4000.0
RIG_FLOOR = 3.0
LEVEL_SHADE = 195


def mercator(lat: Column, lon: Column) -> Column:
    """(x, y) on a web map, in metres."""
    return F.struct((lon / 180 * EDGE).alias("x"), (F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * RADIUS).alias("y"))


def degrees_of(x: Column, y: Column) -> Column:
    """(lon, lat) of a place on a web map."""
    return F.struct(F.degrees(x / RADIUS).alias("lon"), F.degrees(F.atan(F.exp(y / RADIUS)) * 2 - math.pi / 2).alias("lat"))


def zoom_for(half_side: Column, lat: Column, across: int = ACROSS, zooms: tuple[int, int] = ZOOMS) -> Column:
    """The sharpest zoom at which a square takes no more than about `across` tiles a side."""
    fits = F.floor(F.log2(EDGE / half_side * F.cos(F.radians(lat)) * across))
    return F.least(F.lit(zooms[1]), F.greatest(F.lit(zooms[0]), fits)).cast("int")


def tile_range(min_x: Column, min_y: Column, max_x: Column, max_y: Column, zoom: Column) -> Column:
    """(x0, y0, x1, y1): the tiles that a box touches, both ends included, rows counted from the north."""
    n = F.pow(F.lit(2.0), zoom)

    def tile(share: Column) -> Column:
        return F.least(n - 1, F.greatest(F.lit(0.0), F.floor(share * n))).cast("long")

    corners = {"x0": min_x + EDGE, "y0": EDGE - max_y, "x1": max_x + EDGE, "y1": EDGE - min_y}
    return F.struct(*[tile(c / (2 * EDGE)).alias(k) for k, c in corners.items()])


def ancestor(zoom: Column, x: Column, y: Column, deepest: Column) -> Column:
    """(zoom, x, y, left, top, part): the tile of a layer's deepest zoom that holds a deeper one, and which part of it that is."""
    over = F.greatest(F.lit(0), zoom - F.coalesce(deepest, zoom))
    side = F.pow(F.lit(2.0), over)
    at = {"x": x, "y": y}
    up = [F.floor(c / side).cast("long").alias(k) for k, c in at.items()]
    crop = [((c - F.floor(c / side) * side) / side).alias(k) for k, c in zip(("left", "top"), at.values(), strict=True)]
    return F.struct((zoom - over).alias("zoom"), *up, *crop, (1 / side).alias("part"))


def touches(x0: Column, y0: Column, x1: Column, y1: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Whether a box on a web map meets a layer's box in degrees, edges included; a layer without a box is everywhere, and
    so is a box that isn't known whole."""
    a, b = degrees_of(x0, y0), degrees_of(x1, y1)
    meets = (a["lon"] <= east) & (b["lon"] >= west) & (a["lat"] <= north) & (b["lat"] >= south)
    return F.coalesce(meets, F.lit(True))


def utm_box(south: Column, west: Column, north: Column, east: Column) -> Column:
    """(min_e, min_n, max_e, max_n): the box on the grid of the four corners of a box in degrees."""
    corners = [to_utm(lat, lon) for lat in (south, north) for lon in (west, east)]
    sides = [(f"{m}_{c}", pick(*[k[c] for k in corners])) for m, pick in (("min", F.least), ("max", F.greatest)) for c in "en"]
    return F.struct(*[c.alias(k) for k, c in sides])


def span_between(a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column) -> Column:
    """(length, bearing): metres over ground and whole degrees from the grid's north."""
    a, b = to_utm(a_lat, a_lon), to_utm(b_lat, b_lon)
    turn = half_up(F.degrees(bearing(b["e"] - a["e"], b["n"] - a["n"]))) % 360
    return F.struct(ground_distance(a["e"], a["n"], b["e"], b["n"]).alias("length"), turn.cast("int").alias("bearing"))


def far_end_stays(a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column) -> Column:
    """Whether the other end of a hand-drawn line stays when one is moved: unless the span gets longer than the longest."""
    known = a_lat.isNotNull() & b_lat.isNotNull()
    return ~known | (span_between(a_lat, a_lon, b_lat, b_lon)["length"] <= LONGEST)


def track_position(value: Column, low: float, high: float) -> Column:
    """Where a value is on a track whose steps are ratios."""
    if low <= 0 or high <= low:
        raise ValueError("a track of ratios runs from above nought upward")
    at = F.least(F.lit(float(STEPS)), half_up(F.log(value / low) * STEPS / math.log(high / low)))
    return F.when(value <= low, F.lit(0.0)).otherwise(at).cast("int")


def track_value(position: Column, low: float, high: float) -> Column:
    """The whole value at a position of the track; its last position is the upper end itself."""
    if low <= 0 or high <= low:
        raise ValueError("a track of ratios runs from above nought upward")
    at = F.greatest(F.lit(float(low)), half_up(low * F.exp(math.log(high / low) * position / STEPS)))
    return F.when(position >= STEPS, F.lit(float(high))).otherwise(at)


def age_days(stamp: Column, now: Column) -> Column:
    """Days between two times, none below nought."""
    return F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(stamp)) / 86_400e6)


def age_text(stamp: Column, now: Column) -> Column:
    """How long ago in the largest unit that fills one: days, hours, minutes (one at least).

    Each unit is divided out of whole microseconds: hours taken from a fraction of a day would miss halves and wholes by a rounding error.
    """
    age = F.greatest(F.lit(0).cast("long"), F.unix_micros(now) - F.unix_micros(stamp))

    def whole(seconds: int) -> Column:
        return half_up(age / F.lit(seconds * 1_000_000)).cast("long")

    units = [F.when(age >= F.lit(s * 1_000_000), F.concat(whole(s).cast("string"), F.lit(f"{unit} ago"))) for s, unit in ((86_400, "d"), (3_600, "h"))]
    return F.coalesce(*units, F.concat(F.greatest(F.lit(1), whole(60)).cast("string"), F.lit("m ago")))


def _fixed(x: Column, digits: int) -> Column:
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f", x))


def compact(n: Column) -> Column:
    """A count in at most about five characters: whole below ten thousand, then in k, M and G."""
    size, x = F.abs(n), n.cast("double")
    steps = [(1e4, F.format_number(n, 0)), (1e5, F.concat(_fixed(x / 1e3, 1), F.lit("k"))), (1e6, F.concat(_fixed(x / 1e3, 0), F.lit("k"))), (1e8, F.concat(_fixed(x / 1e6, 1), F.lit("M"))), (1e9, F.concat(_fixed(x / 1e6, 0), F.lit("M")))]
    return F.coalesce(*[F.when(size < top, text) for top, text in steps], F.concat(_fixed(x / 1e9, 2), F.lit("G")))


def share(n: Column, of: Column) -> Column:
    """A percentage, with more digits the smaller it is; nothing where there is nothing to share."""
    v = n * 100.0 / of
    text = F.when(v >= 10, _fixed(v, 0)).when(v >= 1, _fixed(v, 1)).otherwise(_fixed(v, 2))
    return F.when(of > 0, F.concat(text, F.lit("%"))).otherwise("")


def flow(n: Column, of: Column) -> Column:
    """What became of a count: a percentage where it shrank, a factor where it grew, nothing beyond a factor of 10,000,
    where the two don't count the same."""
    factor = n / of
    times = F.when(factor > 10_000, F.lit("")).when(factor >= 10, F.concat(F.lit("x"), F.format_number(half_up(factor), 0))).otherwise(F.concat(F.lit("x"), _fixed(factor, 1)))
    return F.when(n.isNull() | of.isNull() | ~(of > 0), F.lit("")).when(n <= of, share(n, of)).otherwise(times)


def _byte(x: Column) -> Column:
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.rint(x))).cast("int")


def rebased(pixels: Column, found: float, wanted: float, contrast: float = 1.0) -> Column:
    """Bytes red, green, blue, alpha, ...: shades moved so that `found` becomes `wanted`, spread by a contrast; alpha stays."""

    def moved(v: Column) -> Column:
        at = F.when(v <= found, v * (wanted / found)).otherwise(wanted + (v - found) * ((255 - wanted) / (255 - found)))
        return _byte(wanted + (at - wanted) * contrast)

    return F.transform(pixels, lambda v, i: F.when(i % 4 == 3, v).otherwise(moved(v)))


def opaque(pixels: Column) -> Column:
    """Pixels that are seen or not: alpha from 128 on is whole, below none."""
    return F.transform(pixels, lambda v, i: F.when(i % 4 != 3, v).when(v >= 128, 255).otherwise(0))


def shaded(pixels: Column, shades: Column, level: int = LEVEL_SHADE) -> Column:
    """Pixels made darker or lighter by the first byte of each pixel of a shading; alpha stays."""
    return F.transform(pixels, lambda v, i: F.when(i % 4 == 3, v).otherwise(_byte(v * F.get(shades, (i - i % 4).cast("int")) / float(level))))


def cover_class(building: Column, water: Column, ground: Column, skin: Column, canopy_from: float = 2.0) -> Column:
    """What a place shows as: a building before water, then what stands 2 m or more above the ground, else ground."""
    return F.when(building, "building").when(water, "water").when(skin - ground >= canopy_from, "canopy").otherwise("ground")


def skin(ground: Column, surface: Column) -> Column:
    """The higher of ground and surface, whichever there is."""
    return F.greatest(ground, surface)


def rig_ceiling(canopy: Column, value: Column) -> Column:
    """The upper end of a rig's track: a quarter above the canopy, whole metres, no less than what is set."""
    return F.ceil(F.greatest(F.lit(RIG_FLOOR), canopy * 1.25, F.when(~F.isnan(value), value))).cast("double")


def rig_bands(on_roof: Column, canopy: Column, ceiling: Column, p: Params = DEFAULTS) -> Column:
    """Upper ends of a track's four bands: free, trunk, crown, brought."""
    free = rig_max(on_roof, p)
    trunk = F.greatest(free, canopy * TRUNK_SHARE)
    return F.array(free, trunk, F.greatest(trunk, canopy), ceiling)


def rig_presets(on_roof: Column, canopy: Column, level: Column, p: Params = DEFAULTS) -> Column:
    """(label, to) of the heights worth a button: only those that exist at this end."""
    free = rig_max(on_roof, p)
    tall = canopy > free + 2

    def button(label: Column, to: Column, when: Column) -> Column:
        return F.when(when, F.struct(label.alias("label"), to.cast("double").alias("to")))

    every = [
        button(F.when(on_roof, "roof").otherwise("ground"), F.lit(0.0), F.lit(True)), button(F.lit("frame"), free, free > 0), button(F.lit("trunk"), canopy * TRUNK_SHARE, tall),
        button(F.lit("top"), canopy, tall), button(F.lit("level"), level, level.isNotNull()),
    ]
    return F.array_compact(F.array(*every))
