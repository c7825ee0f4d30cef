"""Column functions: rounding, bearings, tiles, rigging, sag, and projections. All stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanforge.params import DEFAULTS, Params

TAU = 2 * math.pi


def half_up(x: Column | str, digits: int = 0) -> Column:
    """Rounded with halves toward plus infinity: floor(x * 10^digits + 0.5) / 10^digits (not SQL's round)."""
    scale = F.lit(float(10**digits))
    x = F.col(x) if isinstance(x, str) else x
    return F.floor(x * scale + F.lit(0.5)) / scale


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def bearing(de: Column, dn: Column) -> Column:
    """Compass bearing in [0, 2 pi): 0 is north, clockwise."""
    b = F.atan2(de, dn)
    return F.when(b < 0, b + F.lit(TAU)).otherwise(b)


def sector(b: Column, count: int = DEFAULTS.sectors) -> Column:
    return (F.floor(b / F.lit(TAU) * F.lit(float(count))) % count).cast("int")


def opposite(b: Column) -> Column:
    return (b + F.lit(math.pi)) % F.lit(TAU)


def is_open(mask: Column, which: Column) -> Column:
    """Bit `which` of a 64-bit mask, the sign bit included."""
    return F.getbit(mask, which) == 1


def sector_hex(mask: Column, sectors: int = DEFAULTS.sectors) -> Column:
    """Open sectors as hexadecimal digits, four a digit, the lowest bit first and the lowest digit first."""
    return F.concat(*[F.lower(F.hex(F.shiftrightunsigned(mask, k).bitwiseAND(F.lit(15)))) for k in range(0, sectors, 4)])


def tile_id(e: Column, n: Column) -> Column:
    """Name of the 1 km tile that holds a point."""
    return F.concat(F.lit("33"), F.floor(e / 1000).cast("string"), F.lit("-"), F.floor(n / 1000).cast("string"))


def tiles_over(min_e: Column, min_n: Column, max_e: Column, max_n: Column) -> Column:
    """Tile columns and rows that a box touches, as an array of (te, tn); its upper edges belong to no further tile."""

    def span(low: Column, high: Column) -> Column:
        first = F.floor(low / 1000)
        return F.sequence(first, F.greatest(first, F.ceil(high / 1000) - 1))

    return F.flatten(F.transform(span(min_e, max_e), lambda e: F.transform(span(min_n, max_n), lambda n: F.struct(e.alias("te"), n.alias("tn")))))


def chunk_name(e: Column, n: Column, side: float = 8000.0) -> Column:
    return F.concat_ws("_", F.floor(e / F.lit(side)).cast("string"), F.floor(n / F.lit(side)).cast("string"))


def parse_chunk(name: Column) -> Column:
    """(e, n) of a chunk's name; any other text is an error."""
    pattern = r"^(-?\d+)_(-?\d+)$"
    text = F.trim(name)
    part = F.struct(F.regexp_extract(text, pattern, 1).cast("long").alias("e"), F.regexp_extract(text, pattern, 2).cast("long").alias("n"))
    return F.when(text.rlike(pattern), part).otherwise(F.raise_error(F.concat(F.lit("not a chunk name: "), name)))


def region_id(json: Column) -> Column:
    return F.concat(F.lit("region_"), F.substring(F.sha1(json), 1, 16))


def line_kind(a_on_roof: Column, b_on_roof: Column) -> Column:
    return F.when(a_on_roof | b_on_roof, F.lit("urban")).otherwise(F.lit("natural"))


def rig_max(on_roof: Column, p: Params = DEFAULTS) -> Column:
    return F.when(on_roof, F.lit(0.0)).otherwise(F.lit(p.frame_max))


# The share of a tree's height that its trunk bears, and points a metre by what holds the line up.
TRUNK_SHARE = 0.5
RIG_RATES = {"trunk": 0.4, "crown": 2.0, "brought": 6.0}


def rig_means(height: Column, on_roof: Column, canopy: Column, p: Params = DEFAULTS) -> Column:
    return (
        F.when(height <= p.frame_min, "edge")
        .when(height <= rig_max(on_roof, p), "aFrame")
        .when(height <= canopy * TRUNK_SHARE, "trunk")
        .when(height <= canopy, "crown")
        .otherwise("brought")
    )


def rig_cost(height: Column, on_roof: Column, canopy: Column, p: Params = DEFAULTS) -> Column:
    """Metres above what is free, each band at its own rate."""
    free = rig_max(on_roof, p)
    trunk = F.greatest(free, canopy * TRUNK_SHARE)
    crown = F.greatest(trunk, canopy)
    zero = F.lit(0.0)
    in_trunk = F.greatest(zero, F.least(height, trunk) - free)
    in_crown = F.greatest(zero, F.least(height, crown) - trunk)
    above = F.greatest(zero, height - crown)
    return in_trunk * RIG_RATES["trunk"] + in_crown * RIG_RATES["crown"] + above * RIG_RATES["brought"]


def choose_heights(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column, budget: Column) -> Column:
    """(h_a, h_b, off_level): level at the top of what both ends allow, else the smallest step; null beyond the budget."""
    top = F.least(hi_a, hi_b)
    a_above = lo_a > hi_b
    gap = F.when(a_above, lo_a - hi_b).otherwise(lo_b - hi_a)
    h_a = F.when(a_above, lo_a).otherwise(hi_a)
    h_b = F.when(a_above, hi_b).otherwise(lo_b)
    level = F.struct(top.alias("h_a"), top.alias("h_b"), F.lit(0.0).alias("off_level"))
    step = F.struct(h_a.alias("h_a"), h_b.alias("h_b"), gap.alias("off_level"))
    return F.when(F.greatest(lo_a, lo_b) <= top, level).when(gap <= budget, step)


def line_height(h_a: Column, h_b: Column, sag: Column, t: Column) -> Column:
    """The sagging line at fraction t of the span."""
    return h_a + (h_b - h_a) * t - sag * 4.0 * t * (F.lit(1.0) - t)


def side_half_width(t: Column, length: Column, p: Params = DEFAULTS) -> Column:
    """Half the width of the band that the line may swing in."""
    return t * 4.0 * (F.lit(1.0) - t) * F.lit(p.side_ratio) * length


def clearance_needed(over_water: Column, p: Params = DEFAULTS) -> Column:
    return F.when(over_water, F.lit(p.water_clearance)).otherwise(F.lit(p.min_clearance))


def required_over(tier: Column, p: Params = DEFAULTS) -> Column:
    """Clearance owed to a way of this class, on top of any line's."""
    table = F.create_map(*[F.lit(x) for kv in p.way_clearance.items() for x in kv])
    return F.element_at(table, tier) + F.lit(p.min_clearance)


def series_at(series: Column, t: Column) -> Column:
    """An array read at fraction t of its length, linear between its values."""
    last = F.size(series) - 1
    x = F.least(last.cast("double"), F.greatest(F.lit(0.0), t * last))
    i = F.floor(x).cast("int")
    f = x - i
    here, there = F.get(series, i), F.get(series, F.least(last, i + 1))
    return F.when(last <= 0, F.get(series, F.lit(0))).when(f == 0, here).otherwise(here * (F.lit(1.0) - f) + there * f)


# Scale on the central meridian, a mean radius for it, and the ellipsoid.
CENTRAL_SCALE, MEAN_RADIUS = 0.9996, 6_381_000.0
ELLIPSOID_A, ELLIPSOID_F = 6378137.0, 1 / 298.257222101


def point_scale(e: Column) -> Column:
    x = (e - 500_000.0) / MEAN_RADIUS
    return (F.lit(1.0) + x * x / 2 + x * x * x * x * 5 / 24) * CENTRAL_SCALE


def ground_distance(ae: Column, an: Column, be: Column, bn: Column) -> Column:
    """Metres on the ground, from metres on the grid."""
    return F.hypot(be - ae, bn - an) / point_scale((ae + be) / 2)


def _third_flattening() -> tuple[float, float, list[float], list[float]]:
    n = ELLIPSOID_F / (2 - ELLIPSOID_F)
    radius = ELLIPSOID_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    back = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    return n, radius, forward, back


def to_utm(lat: Column, lon: Column, zone: int = 33) -> Column:
    """(e, n) by Krueger's series to the third order of n: below a millimetre in and near the zone."""
    n, radius, forward, _ = _third_flattening()
    k = 2 * math.sqrt(n) / (1 + n)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - F.atanh(s * k) * k)
    d = F.radians(lon - F.lit(zone * 6.0 - 183.0))
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(t * t + 1))
    e, north = eta, xi
    for j, a in enumerate(forward, 1):
        e = e + F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * a
        north = north + F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * a
    m = CENTRAL_SCALE * radius
    return F.struct((e * m + 500_000.0).alias("e"), (north * m).alias("n"))


def to_wgs84(e: Column, north: Column, zone: int = 33) -> Column:
    """(lat, lon) of a grid point, the series turned round."""
    n, radius, _, back = _third_flattening()
    m = CENTRAL_SCALE * radius
    xi, eta = north / m, (e - 500_000.0) / m
    x, y = xi, eta
    for j, b in enumerate(back, 1):
        x = x - F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * b
        y = y - F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * b
    chi = F.asin(F.sin(x) / F.cosh(y))
    series = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    phi = chi
    for j, c in enumerate(series, 1):
        phi = phi + F.sin(chi * (2 * j)) * c
    lon = F.degrees(F.atan2(F.sinh(y), F.cos(x))) + F.lit(zone * 6.0 - 183.0)
    return F.struct(F.degrees(phi).alias("lat"), lon.alias("lon"))
