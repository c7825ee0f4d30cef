"""Operators against brute force on small inputs: order, ties, holes, invariants."""

import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from spanforge.functions import scalars as fn
from spanforge.operators import dataset, pairs, profile, raster, select, series, ways
from spanforge.params import DEFAULTS


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_rounding_and_bearings(spark):
    got = one(spark, fn.half_up(F.lit(-2.5)), fn.half_up(F.lit(1.005), 2), fn.bearing(F.lit(-1.0), F.lit(0.0)), fn.sector(fn.bearing(F.lit(1.0), F.lit(0.0))), fn.sector(F.lit(2 * math.pi)))
    assert got[0] == -2 and got[1] == math.floor(1.005 * 100 + 0.5) / 100
    assert got[2] == pytest.approx(1.5 * math.pi) and got[3] == 16 and got[4] == 0


def test_projection_round_trip(spark):
    df = spark.createDataFrame([(52.5, 13.4), (51.3, 11.3), (53.4, 14.7)], "lat double, lon double")
    there = df.select("lat", "lon", fn.to_utm(F.col("lat"), F.col("lon")).alias("u")).select("lat", "lon", "u.*")
    back = there.select("lat", "lon", "e", "n", fn.to_wgs84(F.col("e"), F.col("n")).alias("w")).collect()
    for r in back:
        assert r["w"]["lat"] == pytest.approx(r["lat"], abs=1e-8) and r["w"]["lon"] == pytest.approx(r["lon"], abs=1e-8)
    central = one(spark, fn.to_utm(F.lit(0.0), F.lit(15.0)))[0]
    assert central["e"] == pytest.approx(500000) and central["n"] == pytest.approx(0, abs=1e-6)


def test_heights(spark):
    h = lambda *v: one(spark, fn.choose_heights(*[F.lit(float(x)) for x in v]))[0]
    assert tuple(h(1, 5, 3, 8, 0)) == (5, 5, 0)
    assert tuple(h(7, 8, 1, 5, 3)) == (7, 5, 2)
    assert h(7, 8, 1, 5, 1) is None


@pytest.mark.parametrize("radius", [0, 1, 4, 12])
def test_min_filter_with_holes(spark, radius):
    rng = random.Random(3)
    cells = {(x, y): float(rng.randrange(100)) for x in range(23) for y in range(17) if rng.random() > 0.33}
    df = spark.createDataFrame([(x, y, z) for (x, y), z in cells.items()], "cx long, cy long, z double")
    got = {(r["cx"], r["cy"]): r["low"] for r in raster.min_filter(df, radius, 8).collect()}
    want = {(x, y): min(z for (a, b), z in cells.items() if abs(a - x) <= radius and abs(b - y) <= radius) for x, y in cells}
    assert got == want


def test_pairs_are_found_once_whatever_the_split(spark):
    rng = random.Random(5)
    pts = [(i, float(rng.randrange(300)), float(rng.randrange(300))) for i in range(120)]
    df = spark.createDataFrame(pts, "id long, e double, n double")
    found = pairs.band_join(df, 40, 90)
    want = {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and 40 <= math.dist(a[1:], b[1:]) <= 90}
    assert {(r["i"], r["j"]) for r in found.collect()} == want
    boxes = [(x, y, x + 150, y + 150) for x in (0, 150) for y in (0, 150)]
    parts = [(r["i"], r["j"]) for box in boxes for r in pairs.owned(found, box).collect()]
    assert sorted(parts) == sorted(want)


def greedy(rows, radius):
    near = lambda p, q: (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= radius**2
    kept = []
    for r in sorted(rows, key=lambda r: (-r[1], r[0])):
        a, b = r[2:4], r[4:6]
        if not any((near(a, k[2:4]) and near(b, k[4:6])) or (near(a, k[4:6]) and near(b, k[2:4])) for k in kept):
            kept.append(r)
    return {r[0] for r in kept}


@pytest.mark.parametrize("radius", [5.0, 25.0, 60.0])
def test_dedupe_is_greedy(spark, radius):
    rng = random.Random(1)
    rows = []
    for i in range(200):
        e, n = rng.random() * 200, rng.random() * 200
        a, b = (e, n), (e + 120 + rng.random() * 60, n + rng.random() * 60)
        a, b = (a, b) if rng.random() < 0.5 else (b, a)
        rows.append((i, float(rng.randrange(40)), *a, *b))
    df = spark.createDataFrame(rows, "id long, score double, ae double, an double, be double, bn double")
    assert {r["id"] for r in select.dedupe(df, radius).select("id").collect()} == greedy(rows, radius)


def test_spots_cluster_as_in_sequence(spark):
    rng = random.Random(2)
    rows = [(i, float(rng.randrange(400)), float(rng.randrange(400)), 1, float(rng.randrange(20)), 1.0 + i % 7, 2.0 + i % 5, 1.0, 1.0, 1.0) for i in range(250)]
    names = "id long, e double, n double, count long, score double, length_min double, length_max double, exposure_max double, canopy_min double, off_level_min double"
    founded = []
    for r in sorted(rows, key=lambda r: (-r[4], r[1], r[2], r[0])):
        cx, cy, hit = r[1] // 50, r[2] // 50, None
        for dx in (-1, 0, 1):
            near = [(math.dist(r[1:3], f["at"]), -k, f) for dy in (-1, 0, 1) for k, f in enumerate(founded) if (f["at"][0] // 50, f["at"][1] // 50) == (cx + dx, cy + dy)]
            near = [x for x in near if x[0] <= 50]
            if near:
                least = min(x[0] for x in near)
                hit = [x for x in near if x[0] == least][-1][2]
                break
        if hit:
            hit["n"] += 1
        else:
            founded.append({"at": r[1:3], "n": 1, "id": r[0]})
    got = {r["id"]: r["count"] for r in select.cluster(spark.createDataFrame(rows, names)).collect()}
    assert got == {f["id"]: f["n"] for f in founded}


def test_thinning_keeps_its_promise(spark):
    rng = random.Random(4)
    rows = [(i, 0, rng.random(), *[rng.random() * 400 for _ in range(4)]) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, region int, score double, ae double, an double, be double, bn double")
    p = replace(DEFAULTS, max_crossings=4, keep_best=10)
    kept = {r["id"] for r in select.thin(df, p=p).collect()}
    best = {r[0] for r in sorted(rows, key=lambda r: (-r[2], r[0]))[:10]}
    assert best <= kept and len(kept) < len(rows)
    again = {r["id"] for r in select.thin(df.orderBy(F.rand(7)), p=p).collect()}
    assert again == kept

    def cross(a, b):
        side = lambda p, x, y: (p[5] - p[3]) * (y - p[4]) - (p[6] - p[4]) * (x - p[3]) > 0
        return side(a, b[3], b[4]) != side(a, b[5], b[6]) and side(b, a[3], a[4]) != side(b, a[5], a[6])

    by = {r[0]: r for r in rows}
    for i in kept - best:
        assert sum(cross(by[i], by[j]) for j in kept - best if j != i) <= 4


def test_metrics_skip_stations_without_ground(spark):
    flat = [50.0] + [20.0] * 39 + [50.0]
    holed = [x if i % 4 else None for i, x in enumerate(flat)]
    df = spark.createDataFrame([(1, flat, 200.0, 50.0, 50.0), (2, holed, 200.0, 50.0, 50.0), (3, [None] * 41, 200.0, 50.0, 50.0)], "id long, ground array<double>, length double, h_a double, h_b double")
    got = {r["id"]: r for r in profile.metrics(df).collect()}
    assert got[1]["exposure"] > 28 and got[1]["blocked"] == 0 and got[1]["samples"] == 37
    assert got[2]["samples"] < got[1]["samples"] and got[2]["deficit"] == 0
    assert 3 not in got


def test_crossings_and_scores(spark):
    x = [{"d": 100.0, "from": 95.0, "to": 105.0, "offset": 0.0, "kind": "residential", "tier": "street", "carrier": 45.0, "onBridge": False}]
    df = spark.createDataFrame([(1, [40.0] * 41, 200.0, 50.0, 50.0, 0.0, x)], "id long, ground array<double>, length double, h_a double, h_b double, off_level double, crossings array<struct<d:double,`from`:double,`to`:double,offset:double,kind:string,tier:string,carrier:double,onBridge:boolean>>")
    m = profile.metrics(df).join(df.select("id", "length", "off_level"), "id")
    r = m.select("*", profile.rejection().alias("why"), profile.penalty().alias("fine"), F.size(profile.violations()).alias("n")).first()
    assert r["worst_crossing"] == 0 and r["crossing_deficit"] > 0 and r["why"] in ("clearance", "crossing", "exposure") and r["fine"] > 0 and r["n"] >= 1


def test_sag_is_the_loosest_that_passes(spark):
    df = spark.createDataFrame([(1, [50.0] + [20.0] * 39 + [50.0], 200.0, 50.0, 50.0)], "id long, ground array<double>, length double, h_a double, h_b double")
    sag = profile.max_sag(df, steps=10).first()["max_sag"]
    ok = lambda s: profile.metrics(df, F.lit(s)).select(profile.rejection().isNull()).first()[0]
    assert 0 < sag < 0.25 and ok(sag) and not ok(sag + 0.001)


def test_runs_gaps_and_intervals(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([1.0, None, None, 4.0, None])], "k int, i int, v double")
    assert [r["filled"] for r in series.fill_gaps(df, "k", ["i"], "v").orderBy("i").collect()] == [1, 2, 3, 4, 4]
    x = spark.createDataFrame([("a", 1.0, 0.0, 5.0, 3.0, 1.0), ("a", 2.0, 5.0, 7.0, 1.0, None), ("a", 9.0, 8.0, 9.0, 2.0, 4.0)], "kind string, d double, `from` double, `to` double, offset double, carrier double")
    got = series.merge_intervals(x, ["kind"]).orderBy("from").collect()
    assert [(r["from"], r["to"], r["d"], r["carrier"]) for r in got] == [(0, 7, 2, 1), (8, 9, 9, 4)]


def test_runs_around_the_circle(spark):
    mask = (1 << 63) | 0b1011
    signed = mask - (1 << 64)
    got = spark.createDataFrame([(signed,), (-1,), (0,)], "m long").select(series.circular_runs(F.col("m")).alias("r")).collect()
    assert sorted(tuple(x) for x in got[0]["r"]) == [(3, 1), (63, 3)]
    assert [tuple(x) for x in got[1]["r"]] == [(0, 64)] and got[2]["r"] == []


def test_way_crossings_match_a_fine_walk(spark):
    rng = random.Random(11)
    lines = [(i, *[rng.random() * 300 for _ in range(4)]) for i in range(12)]
    roads = [(i, "street", "residential", 3.0, False, [{"e": rng.random() * 300, "n": rng.random() * 300} for _ in range(3)]) for i in range(15)]
    s = spark.createDataFrame(lines, "id long, ae double, an double, be double, bn double")
    w = spark.createDataFrame(roads, "id long, tier string, kind string, half double, bridge boolean, pts array<struct<e:double,n:double>>")
    got = {}
    for r in ways.crossings(s, w).collect():
        got.setdefault(r["id"], []).append((r["from"], r["to"]))

    def dist(px, py, a, b):
        ex, ey = b["e"] - a["e"], b["n"] - a["n"]
        t = min(1, max(0, ((px - a["e"]) * ex + (py - a["n"]) * ey) / (ex * ex + ey * ey)))
        return math.hypot(px - a["e"] - t * ex, py - a["n"] - t * ey)

    for i, ae, an, be, bn in lines:
        length = math.hypot(be - ae, bn - an)
        for k in range(0, 401):
            t = k / 400
            px, py = ae + (be - ae) * t, an + (bn - an) * t
            gap = min(dist(px, py, a, b) for r in roads for a, b in zip(r[5], r[5][1:], strict=False)) - 3 - 4 * t * (1 - t) * 0.04 * length
            if abs(gap) > 0.5:
                inside = any(f - 0.2 <= t * length <= to + 0.2 for f, to in got.get(i, []))
                assert inside == (gap < 0) or gap < 0 and inside


def test_polygons_and_islands(spark):
    square = lambda i, k, x, y, s: (i, k, [{"e": x + dx * s, "n": y + dy * s} for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1))])
    df = spark.createDataFrame([square(1, "water", 0.0, 0.0, 6.0), square(2, "island", 2.0, 2.0, 2.0)], "id long, kind string, ring array<struct<e:double,n:double>>")
    cells = {(r["cx"], r["cy"]) for r in ways.water_mask(df).collect()}
    assert cells == {(x, y) for x in range(6) for y in range(6)} - {(2, 2), (2, 3), (3, 2), (3, 3)}


def test_rings_are_stitched_either_way_round(spark):
    p = lambda *v: [{"e": float(a), "n": float(b)} for a, b in v]
    df = spark.createDataFrame([(1, 1, p((0, 0), (4, 0), (4, 4))), (1, 2, p((0, 0.3), (0, 4), (4, 4.2))), (2, 3, p((0, 0), (1, 1)))], "relation long, way long, pts array<struct<e:double,n:double>>")
    got = ways.stitch(df).collect()
    assert len(got) == 1 and got[0]["relation"] == 1 and len(got[0]["ring"]) == 5


def test_filters_default_to_everything(spark):
    df = spark.createDataFrame([(1, "urban", 10.0, 60.0, 5.0, 1.0, 0.5)], "id long, kind string, score double, length double, exposure double, blocked double, off_level_ratio double")
    assert df.where(dataset.line_filter()).count() == 1
    assert df.where(dataset.line_filter(["natural"])).count() == 0
