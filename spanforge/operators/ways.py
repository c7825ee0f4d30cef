"""Ways and water: classes of tags, segments, spans near them, crossings, polygons on cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from spanforge.functions.scalars import half_up
from spanforge.operators import raster
from spanforge.operators.series import merge_intervals
from spanforge.params import DEFAULTS, Params
from spanforge.runtime import stage

# The class of each highway value, live railways, half widths by class, and metres a lane.
TIERS = {
    "path": ["path", "footway", "bridleway", "steps", "pedestrian", "via_ferrata", "track"],
    "cycle": ["cycleway"],
    "street": ["residential", "living_street", "unclassified", "road", "service"],
    "road": ["tertiary", "secondary", "primary"],
    "highway": ["trunk", "motorway", "busway", "bus_guideway", "raceway"],
}
RAILWAYS = ["rail", "light_rail", "subway", "tram", "narrow_gauge", "funicular", "monorail", "preserved"]
HALF_WIDTHS = {"path": 1.0, "cycle": 1.5, "street": 3.0, "road": 4.0, "highway": 12.5}
LANE = 3.25


def _literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def classify_way(tags: Column) -> Column:
    """(tier, kind, half) of a way's tags (map), null where nothing has to be cleared."""

    def tag(k: str) -> Column:
        return F.try_element_at(tags, F.lit(k))

    rail = F.coalesce(tag("railway"), F.lit("")) != ""
    kind = F.when(rail, tag("railway")).otherwise(tag("highway"))
    plain = F.try_element_at(_literal_map({v: t for t, values in TIERS.items() for v in values}), tag("highway"))
    paved = (tag("highway") == "track") & tag("tracktype").isin("grade1", "grade2")
    private = (tag("highway") == "service") & tag("service").isin("driveway", "parking_aisle")
    signed = (plain == "path") & (tag("bicycle") == "designated")
    promoted = F.coalesce(paved, F.lit(False)) | F.coalesce(private, F.lit(False)) | F.coalesce(signed, F.lit(False))
    tier = F.when(rail, F.when(tag("railway").isin(*RAILWAYS), F.lit("highway"))).otherwise(F.when(plain.isNotNull() & promoted, F.lit("cycle")).otherwise(plain))
    width, lanes = tag("width").try_cast("double"), tag("lanes").try_cast("double")
    half = F.when(width > 0, width / 2).when(lanes > 0, lanes * LANE / 2).otherwise(F.try_element_at(_literal_map(HALF_WIDTHS), tier))
    tunnel = F.coalesce(tag("tunnel"), F.lit("")).isin("", "no")
    return F.when(tunnel & tier.isNotNull(), F.struct(tier.alias("tier"), kind.alias("kind"), half.alias("half")))


def water_kind(tags: Column) -> Column:
    def tag(k: str) -> Column:
        return F.try_element_at(tags, F.lit(k))

    area = (tag("natural") == "water") | (tag("waterway") == "riverbank") | tag("landuse").isin("reservoir", "basin")
    return F.when(area, "water").when(tag("waterway").isin("river", "canal"), "waterway")


def keep_way(tags: Column) -> Column:
    """What a way is kept as: road or water kind; tunnels go either way."""
    dry = F.coalesce(F.try_element_at(tags, F.lit("tunnel")), F.lit("")).isin("", "no")
    return F.when(classify_way(tags).isNotNull(), "road").when(dry, water_kind(tags))


def segments(ways: DataFrame) -> DataFrame:
    """A row for each segment of ways (id, tier, kind, half, bridge, pts array of (e, n)): way, seg, x0, y0, x1, y1."""
    n = F.size("pts")
    at = ways.where(n >= 2).withColumn("seg", F.explode(F.sequence(F.lit(0), n - 2)))
    a, b = F.get("pts", F.col("seg")), F.get("pts", F.col("seg") + 1)
    return at.select(F.col("id").alias("way"), "seg", "tier", "kind", "half", "bridge", a["e"].alias("x0"), a["n"].alias("y0"), b["e"].alias("x1"), b["n"].alias("y1"))


def _point_segment2(px: np.ndarray, py: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """Squared distances of points from segments."""
    ex, ey = x1 - x0, y1 - y0
    size = ex * ex + ey * ey
    t = np.clip(np.divide((px - x0) * ex + (py - y0) * ey, size, out=np.zeros_like(size), where=size > 0), 0, 1)
    dx, dy = px - (x0 + ex * t), py - (y0 + ey * t)
    return dx * dx + dy * dy


def _crosses(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> np.ndarray:
    """Whether two segments (x0, y0, x1, y1) properly cross; a zero counts as the negative side."""

    def left(p: tuple[np.ndarray, ...], x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (p[2] - p[0]) * (y - p[1]) - (p[3] - p[1]) * (x - p[0]) > 0

    return (left(a, b[0], b[1]) != left(a, b[2], b[3])) & (left(b, a[0], a[1]) != left(b, a[2], a[3]))


def apart2(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> np.ndarray:
    """Squared distances of two segments: nothing if they cross, else the least of an end from the other segment."""
    ends = [_point_segment2(a[0], a[1], *b), _point_segment2(a[2], a[3], *b), _point_segment2(b[0], b[1], *a), _point_segment2(b[2], b[3], *a)]
    return np.where(_crosses(a, b), 0.0, np.minimum.reduce(ends))


#: Pairs of a span and a segment whose boxes one task may hold against each other at once, and those that one group of a cell may have.
BLOCK, GROUP = 1 << 18, 1 << 24


def _met(a: pa.Table, b: pa.Table, ratio: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of spans and segments of one cell that are no further apart than half and the widest band, block by block.

    A pair counts in the lowest cell that both touch: each axis begins here for one of them at least.
    """
    sw, ss, se, sn, rw, rs, re, rn = (t.column(f"{k}_{c}").to_numpy() for t, k in ((a, "s"), (b, "r")) for c in "wsen")
    s_first, r_first = ([t.column(c).to_numpy() == t.column(f"{k}_{c}").to_numpy() for c in ("ce", "cn")] for t, k in ((a, "s"), (b, "r")))
    span = [a.column(c).to_numpy() for c in ("ae", "an", "be", "bn")]
    seg = [b.column(c).to_numpy() for c in ("x0", "y0", "x1", "y1")]
    half = b.column("half").to_numpy()
    step = max(1, BLOCK // max(1, len(rw)))
    for k in range(0, len(sw), step):
        of = (slice(k, k + step), None)
        ok = (sw[of] <= re) & (rw <= se[of]) & (ss[of] <= rn) & (rs <= sn[of]) & (s_first[0][of] | r_first[0]) & (s_first[1][of] | r_first[1])
        i, j = np.nonzero(ok)
        i += k
        ae, an, be, bn = (c[i] for c in span)
        reach = half[j] + np.sqrt((be - ae) * (be - ae) + (bn - an) * (bn - an)) * ratio
        on = apart2((ae, an, be, bn), tuple(c[j] for c in seg)) <= reach * reach
        yield i[on], j[on]


def _by_cells(spans: DataFrame, segs: DataFrame, p: Params, cell: float | None, run: Callable[[pa.Table, pa.Table], pa.Table], schema: StructType | str) -> DataFrame:
    """run on the spans and the segments of each cell, with their boxes.

    Both are listed by the cells that their boxes touch (a span's box grown by the widest band). A cell is by default as
    wide and as high as the spans' boxes are on average; spans of a crowded one are dealt to several groups.
    """
    for c in ("ae", "an", "be", "bn"):
        spans = spans.withColumn(c, F.col(c).cast("double"))
    for c in ("x0", "y0", "x1", "y1", "half"):
        segs = segs.withColumn(c, F.col(c).cast("double"))
    half, widest = F.col("half"), F.hypot(F.col("be") - F.col("ae"), F.col("bn") - F.col("an")) * p.side_ratio
    sides = [cell] * 2
    if cell is None:
        wide = spans.agg(*[F.avg(F.abs(F.col(f"b{c}") - F.col(f"a{c}")) + 2 * widest) for c in "en"]).first()
        sides = [max(10.0, float(x or 100.0)) for x in wide]

    def listed(df: DataFrame, box: list[Column], name: str) -> DataFrame:
        out = df.withColumns({f"{name}{k}": c for k, c in zip(("w", "s", "e", "n"), box, strict=True)})
        for axis, low, high, side in (("ce", "w", "e", sides[0]), ("cn", "s", "n", sides[1])):
            out = out.withColumn(f"{name}{axis}", F.floor(F.col(f"{name}{low}") / side)).withColumn(axis, F.explode(F.sequence(f"{name}{axis}", F.floor(F.col(f"{name}{high}") / side))))
        return out

    a = listed(spans, [F.least("ae", "be") - widest, F.least("an", "bn") - widest, F.greatest("ae", "be") + widest, F.greatest("an", "bn") + widest], "s_")
    b = listed(segs, [F.least("x0", "x1") - half, F.least("y0", "y1") - half, F.greatest("x0", "x1") + half, F.greatest("y0", "y1") + half], "r_")
    busy = a.groupBy("ce", "cn").agg(F.count("*").alias("x")).join(b.groupBy("ce", "cn").agg(F.count("*").alias("y")), ["ce", "cn"])
    shares = -(-(busy.agg(F.max(F.col("x") * F.col("y"))).first()[0] or 1) // GROUP)
    a = a.withColumn("share", F.pmod(F.xxhash64("id"), F.lit(shares)))
    b = b.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    keys = ["ce", "cn", "share"]
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(run, schema)


def near(spans: DataFrame, segs: DataFrame, p: Params = DEFAULTS, cell: float | None = None, columns: list[str] | None = None) -> DataFrame:
    """Spans (id, ae, an, be, bn) with every segment that may come under their band: apart <= half + widest.

    A pair is found in the lowest cell that both touch, so no distinct is needed. Spans and segments of a cell are held
    against each other as arrays: pairs that don't meet, of which there are many more, are never rows. columns: those
    wanted, by default all of both.
    """
    kinds = {f.name: f.dataType for df in (spans, segs) for f in df.schema.fields} | {c: DoubleType() for c in ("ae", "an", "be", "bn", "x0", "y0", "x1", "y1", "half")}
    kept = columns or [*spans.columns, *segs.columns]
    schema = StructType([StructField(c, kinds[c]) for c in kept])
    own, ratio = set(spans.columns), p.side_ratio

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        met = list(_met(a, b, ratio))
        i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*met, strict=True) if met else ((), ())))
        return pa.table({c: (a.column(c).take(pa.array(i)) if c in own else b.column(c).take(pa.array(j))) for c in kept})

    return _by_cells(spans, segs, p, cell, run, schema)


_CROSSING = "id long, way long, seg int, kind string, tier string, onBridge boolean, d double, `from` double, `to` double, offset double, feet array<struct<e:double,n:double>>"


def _search(ends: tuple[np.ndarray, ...], ratio: float) -> tuple[np.ndarray, ...]:
    """Where bands of spans meet carriageways of segments, all pairs at once: which do, and of those d, from, to, offset and the places (e, n) of the three feet.

    ends: ae, an, be, bn of the spans, x0, y0, x1, y1, half of the segments.
    """
    ae, an, be, bn, x0, y0, x1, y1, half = ends
    se, sn = be - ae, bn - an
    length = np.hypot(se, sn)
    ex, ey = x1 - x0, y1 - y0
    size = ex * ex + ey * ey
    size[size == 0] = 1.0  # what is divided by it is nought there
    all_of = (ae, an, se, sn, x0, y0, ex, ey, size, half, length)

    def band(t: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = 4 * t
        out *= 1 - t
        out *= ratio
        out *= length
        return out

    def along(t: np.ndarray, of: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        """Place on the span from the segment's beginning, and how far along the segment the nearest place lies; in place, as it is called most."""
        ae, an, se, sn, x0, y0, ex, ey, size, _, _ = of
        px, py = se * t, sn * t
        px += ae
        px -= x0
        py += an
        py -= y0
        u = px * ex
        u += py * ey
        u /= size
        np.maximum(u, 0, out=u)
        np.minimum(u, 1, out=u)
        return px, py, u

    def gap(t: np.ndarray, of: tuple[np.ndarray, ...] = all_of) -> np.ndarray:
        px, py, u = along(t, of)
        px -= of[6] * u
        py -= of[7] * u
        px *= px
        py *= py
        px += py
        np.sqrt(px, out=px)
        px -= of[9]
        px -= band(t, of[10])
        return px

    lo, hi = np.zeros(len(ae)), np.ones(len(ae))
    for _ in range(ROUNDS):
        going = hi - lo > SMALL
        if not going.any():
            break
        third = (hi - lo) / 3
        fall = gap(lo + third) < gap(hi - third)
        hi, lo = np.where(going & fall, hi - third, hi), np.where(going & ~fall, lo + third, lo)
    at = (lo + hi) / 2
    least = gap(at)
    on = (least <= 0) & (length > 0)
    at, met = at[on], tuple(x[on] for x in all_of)

    def edge(end: float) -> np.ndarray:
        out = np.full(len(at), end)
        cut = gap(out, met) > 0
        outside, inside, of = out[cut], at[cut], tuple(x[cut] for x in met)
        for _ in range(HALVINGS):
            mid = (inside + outside) / 2
            under = gap(mid, of) <= 0
            inside, outside = np.where(under, mid, inside), np.where(under, outside, mid)
        out[cut] = inside
        return out

    def tenths(x: np.ndarray) -> np.ndarray:
        return np.floor(x * 10 + 0.5) / 10

    def foot(t: np.ndarray) -> np.ndarray:
        u = along(t, met)[2]
        return np.stack([met[4] + met[6] * u, met[5] + met[7] * u], 1)

    first, last = edge(0.0), edge(1.0)
    places = np.stack([foot(t) for t in (first, at, last)], 1)
    return on, tenths(at * met[10]), tenths(first * met[10]), tenths(last * met[10]), tenths(np.maximum(0, least[on] + band(at, met[10]))), places


_ENDS = ("ae", "an", "be", "bn", "x0", "y0", "x1", "y1", "half")


def _touch(batches: Iterator[pd.DataFrame], ratio: float) -> Iterator[pd.DataFrame]:
    """Where each span's band meets a segment's carriageway: all rows of a batch are searched at once."""
    for pdf in batches:
        on, d, start, end, offset, places = _search(tuple(pdf[c].to_numpy(float) for c in _ENDS), ratio)
        out = pdf.loc[on, ["id", "way", "seg", "kind", "tier"]].assign(onBridge=pdf["bridge"][on], d=d, **{"from": start, "to": end}, offset=offset)
        out["feet"] = pd.Series([[{"e": e, "n": n} for e, n in three] for three in places.tolist()], index=out.index, dtype=object)
        yield out


#: Pairs that are searched at once (their arrays stay in a core's cache), stretches held before they are joined, cells that a grid sent to
#: the workers may have, and places in its box.
AT_ONCE, HELD, GRID_CELLS, GRID_BOX = 1 << 12, 1 << 19, 1 << 21, 1 << 22

Grid = tuple[int, int, np.ndarray]


def _grid(cells: DataFrame) -> Grid | None:
    """Cells (cx, cy, z) as an array from its lowest column and row on, not a number where there is none; nothing if they are not few or not plain."""
    cells = stage(cells.select(F.col("cx").cast("long").alias("cx"), F.col("cy").cast("long").alias("cy"), F.col("z").cast("double").alias("z")).where("z is not null"), "grid")
    n, odd, x0, x1, y0, y1 = cells.agg(F.count("*"), F.count_if(F.isnan("z")), F.min("cx"), F.max("cx"), F.min("cy"), F.max("cy")).first()
    if not n or odd or n > GRID_CELLS or (x1 - x0 + 1) * (y1 - y0 + 1) > GRID_BOX:
        return None
    got = cells.toArrow()
    out = np.full((x1 - x0 + 1, y1 - y0 + 1), np.nan)
    out[got.column("cx").to_numpy() - x0, got.column("cy").to_numpy() - y0] = got.column("z").to_numpy()
    return None if np.count_nonzero(~np.isnan(out)) != n else (x0, y0, out)


def _bilinear(grid: Grid, e: np.ndarray, n: np.ndarray) -> np.ndarray:
    """As `raster.bilinear` at a metre: between four centres, or the own cell's if one lacks data."""
    x0, y0, z = grid

    def at(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        i, j = x.astype(np.int64) - x0, y.astype(np.int64) - y0
        there = (i >= 0) & (j >= 0) & (i < z.shape[0]) & (j < z.shape[1])
        return np.where(there, z[np.where(there, i, 0), np.where(there, j, 0)], np.nan)

    x, y = e - 0.5, n - 0.5
    cx, cy = np.floor(x), np.floor(y)
    fx, fy = x - cx, y - cy
    mixed = (1 - fx) * (1 - fy) * at(cx, cy) + (1 - fx) * fy * at(cx, cy + 1) + fx * (1 - fy) * at(cx + 1, cy) + fx * fy * at(cx + 1, cy + 1)
    return np.where(np.isnan(mixed), at(np.floor(e), np.floor(n)), mixed)


def _joined(got: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches (span, class, values) that overlap, joined as `merge_intervals` does. values, by column: from, to, carrier, offset, and
    the from, to and d that the offset is of."""
    rows, code, values = (np.concatenate(x) for x in zip(*got, strict=True))
    if not len(rows):
        return rows, code, values
    order = np.lexsort((values[:, 1], values[:, 0], code, rows))
    rows, code, values = rows[order], code[order], values[order]
    new = np.r_[True, (rows[1:] != rows[:-1]) | (code[1:] != code[:-1])]
    reach = pd.Series(values[:, 1]).groupby(np.cumsum(new)).cummax().to_numpy()
    new[1:] |= values[1:, 0] > reach[:-1]
    starts, part = np.flatnonzero(new), np.cumsum(new) - 1
    out = values[np.lexsort((*values.T[:3:-1], values[:, 3], part))[starts]]
    out[:, 0], out[:, 1], out[:, 2] = values[starts, 0], np.maximum.reduceat(values[:, 1], starts), np.fmax.reduceat(values[:, 2], starts)
    return rows[starts], code[starts], out


_STRETCH = "id long, kind string, tier string, onBridge boolean, `from` double, `to` double, d double, offset double, carrier double, of_from double, of_to double"


def _stretches(ratio: float, grids) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Stretches of the spans of a cell under which its segments run, joined within the cell. grids: nothing, or a broadcast pair of
    them, for ways on the ground and on bridges."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        ends = [a.column(c).to_numpy() for c in _ENDS[:4]], [b.column(c).to_numpy() for c in _ENDS[4:]]
        code = b.select(["kind", "tier", "bridge"]).to_pandas().groupby(["kind", "tier", "bridge"], dropna=False, sort=False).ngroup().to_numpy()
        high = b.column("bridge").to_pandas().eq(True).to_numpy()
        got, many = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 7)))], 0
        for i, j in _met(a, b, ratio):
            for k in range(0, len(i), AT_ONCE):
                p, q = i[k : k + AT_ONCE], j[k : k + AT_ONCE]
                on, d, start, end, offset, feet = _search((*(c[p] for c in ends[0]), *(c[q] for c in ends[1])), ratio)
                p, q = p[on], q[on]
                carrier = np.full(len(p), np.nan)
                if grids is not None:
                    for grid, those in zip(grids.value, (~high[q], high[q]), strict=True):
                        e, n = feet[those].reshape(-1, 2).T
                        z = np.fmax.reduce(_bilinear(grid, e, n).reshape(-1, 3), axis=1)
                        carrier[those] = np.floor(z * 100 + 0.5) / 100
                got.append((p, code[q], np.stack([start, end, carrier, offset, start, end, d], 1)))
                many += len(p)
            if many > HELD:
                got, many = [_joined(got)], 0
        rows, of, best = _joined(got)
        kind = b.take(pa.array(np.unique(code, return_index=True)[1][of]))
        return pa.table({
            "id": a.column("id").take(pa.array(rows)), "kind": kind.column("kind"), "tier": kind.column("tier"), "onBridge": kind.column("bridge"), "from": best[:, 0], "to": best[:, 1],
            "d": best[:, 6], "offset": best[:, 3], "carrier": pa.array(best[:, 2], from_pandas=True), "of_from": best[:, 4], "of_to": best[:, 5],
        })

    return run


# Fixed values of the search in `_touch`: rounds and width at which the bracket of the tightest point is small enough, and halvings of each edge.
ROUNDS, SMALL, HALVINGS = 40, 1e-6, 24


def carriers(found: DataFrame, ground: DataFrame, surface: DataFrame | None = None) -> DataFrame:
    """found with carrier: how high the way runs, the highest of its three feet to the centimetre, null where none has data.

    A bridge is read from the surface, everything else from the ground. All feet are looked up by one equi-join each.
    """
    feet = found.select("id", "way", "seg", "onBridge", F.posexplode("feet").alias("k", "foot")).select("id", "way", "seg", "onBridge", "k", "foot.e", "foot.n")
    keys = ["id", "way", "seg", "k"]
    if surface is None:
        read = raster.bilinear(feet, ground, keys)
    else:
        read = raster.bilinear(feet.where(~F.col("onBridge")), ground, keys).unionByName(raster.bilinear(feet.where("onBridge"), surface, keys))
    high = read.groupBy("id", "way", "seg").agg(half_up(F.max("z"), 2).alias("carrier"))
    return found.join(high, ["id", "way", "seg"], "left")


def crossings(spans: DataFrame, ways: DataFrame, p: Params = DEFAULTS, ground: DataFrame | None = None, surface: DataFrame | None = None) -> DataFrame:
    """Stretches of spans that have a way under their band, overlapping ones of one class joined.

    Candidates come from the cell join; the root search of each is numeric and has no form in SQL, so it runs on arrays,
    where the stretches of a cell are joined before they are rows. Heights come from a grid sent to the workers if the
    cells are few (counted), else by joins. With ground (and, for bridges, surface) carrier is the height of the way itself, where it runs; else null.
    """
    grids = None
    if ground is not None:
        low = _grid(ground)
        high = low if surface is None or low is None else _grid(surface)
        if low is None or high is None:
            found = near(spans, segments(ways), p).mapInPandas(lambda it: _touch(it, p.side_ratio), _CROSSING)
            return merge_intervals(carriers(stage(found, "touching"), ground, surface).drop("way", "seg", "feet"), ["id", "kind", "tier", "onBridge"])
        grids = spans.sparkSession.sparkContext.broadcast((low, high))
    found = _by_cells(spans, segments(ways), p, None, _stretches(p.side_ratio, grids), _STRETCH)
    return merge_intervals(found, ["id", "kind", "tier", "onBridge"], ["of_from", "of_to", "d"])


def fill(polygons: DataFrame, res: float = 1.0) -> DataFrame:
    """Cells (id, cx, cy) whose centre is inside a ring (array of (e, n)), even-odd.

    Each edge is laid on the rows of cells that it spans; a row's crossings are paired in order and the cells between a
    pair listed. A ring's edges in one row are few, so the arrays sorted here don't grow with the data.
    """
    n = F.size("ring")
    edges = polygons.where(n >= 3).withColumn("k", F.explode(F.sequence(F.lit(0), n - 1)))
    a, b = F.get("ring", F.col("k")), F.get("ring", F.pmod(F.col("k") + n - 1, n))
    edges = edges.select("id", a["e"].alias("x0"), a["n"].alias("y0"), b["e"].alias("x1"), b["n"].alias("y1")).where("y0 <> y1")
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    # centres (cy + 0.5) * res with low <= centre < high
    first, last = F.ceil(low / res - 0.5), F.ceil(high / res - 0.5) - 1
    rows = edges.where(first <= last).withColumn("cy", F.explode(F.sequence(first, last)))
    y = (F.col("cy") + 0.5) * res
    x = F.col("x0") + (y - F.col("y0")) / (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))
    lines = rows.select("id", "cy", x.alias("x")).groupBy("id", "cy").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    pairs = lines.withColumn("k", F.explode(F.sequence(F.lit(0), F.size("xs") - 2, F.lit(2)))).select("id", "cy", F.get("xs", F.col("k")).alias("a"), F.get("xs", F.col("k") + 1).alias("b"))
    west, east = F.ceil(F.col("a") / res - 0.5), F.floor(F.col("b") / res - 0.5)
    return pairs.where(west <= east).select("id", F.explode(F.sequence(west, east)).alias("cx"), "cy").distinct()


def water_mask(polygons: DataFrame, res: float = 1.0) -> DataFrame:
    """Cells over water: those of all rings (kind water) less those of any island."""
    cells = fill(polygons.select(F.struct("id", "kind").alias("id"), "ring"), res).select("id.kind", "cx", "cy")
    return cells.where("kind = 'water'").select("cx", "cy").distinct().join(cells.where("kind = 'island'"), ["cx", "cy"], "left_anti")


def blocks_of(features: DataFrame, side: float) -> DataFrame:
    """Features (pts) repeated for every block that their box touches."""
    e, n = F.transform("pts", lambda p: p["e"]), F.transform("pts", lambda p: p["n"])
    out = features.withColumn("be", F.explode(F.sequence(F.floor(F.array_min(e) / side), F.floor(F.array_max(e) / side))))
    return out.withColumn("bn", F.explode(F.sequence(F.floor(F.array_min(n) / side), F.floor(F.array_max(n) / side))))


def first_of_id(features: DataFrame, order: str = "block") -> DataFrame:
    """One row a way id, that of the first block."""
    columns = [c for c in features.columns if c != "id"]
    return features.groupBy("id").agg(F.min_by(F.struct(*columns), order).alias("x")).select("id", "x.*")


def geometry(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, pts) of ways (id, refs) whose nodes (id, e, n) are all there."""
    refs = ways.select("id", F.size("refs").alias("want"), F.posexplode("refs").alias("k", "ref"))
    at = refs.join(nodes.withColumnRenamed("id", "ref"), "ref").groupBy("id", "want").agg(F.array_sort(F.collect_list(F.struct("k", "e", "n"))).alias("at"))
    return at.where(F.size("at") == F.col("want")).select("id", F.transform("at", lambda x: F.struct(x["e"].alias("e"), x["n"].alias("n"))).alias("pts"))


def chains(members: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Chains (relation, ring, closed) of member lines (relation, way, pts), joined end to end, either way round, within tolerance.

    A chain is closed if it ends where it begins and has more than three points. A relation's members are joined one after
    another in the order of their ids, which no set operation expresses; they are a bounded piece of one map feature.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lines = [[(float(q["e"]), float(q["n"])) for q in pts] for pts in pdf.sort_values("way")["pts"] if len(pts) > 1]

        def meet(a: tuple[float, float], b: tuple[float, float]) -> bool:
            return abs(a[0] - b[0]) <= tolerance and abs(a[1] - b[1]) <= tolerance

        found, closed = [], []
        while lines:
            chain = lines.pop(0)
            while not meet(chain[0], chain[-1]) or len(chain) < 4:
                nxt = next((k for k, x in enumerate(lines) if meet(chain[-1], x[0]) or meet(chain[-1], x[-1])), None)
                if nxt is None:
                    break
                more = lines.pop(nxt)
                chain = chain + (more if meet(chain[-1], more[0]) else more[::-1])[1:]
            found.append([{"e": e, "n": n} for e, n in chain])
            closed.append(len(chain) > 3 and meet(chain[0], chain[-1]))
        return pd.DataFrame({"relation": [pdf["relation"].iloc[0]] * len(found), "ring": pd.Series(found, dtype=object), "closed": pd.Series(closed, dtype=bool)})

    return members.groupBy("relation").applyInPandas(run, "relation long, ring array<struct<e:double,n:double>>, closed boolean")


def stitch(members: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Rings (relation, ring): the closed chains of member lines."""
    return chains(members, tolerance).where("closed").drop("closed")


def unclosed(found: DataFrame) -> DataFrame:
    """One row: chains that closed to rings, and those that did not and are left out."""
    return found.agg(F.count_if("closed").alias("rings"), F.count_if(~F.col("closed")).alias("unclosed"))
