"""What a review of larger tables and odd values found: a small case of each."""

import math
from dataclasses import replace

import duckdb
import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from spanforge.functions import maps
from spanforge.operators import cover, pairs, raster, select, series, ways
from spanforge.params import DEFAULTS


def plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_disc_minimum_broadcasts_no_listed_spots(spark):
    """A disc lists 25 spots a point, which Spark's estimate of their size leaves out."""
    points = spark.range(200_000).select("id", (F.col("id") % 100).cast("double").alias("e"), (F.col("id") % 90).cast("double").alias("n"))
    cells = spark.range(4_000_000).select(F.floor(F.col("id") / 64).alias("cx"), (F.col("id") % 64).alias("cy"), (F.col("id") * 7 % 50).cast("double").alias("z"))
    got = raster.disc_min(points, cells, "id", 40.0, 16.0)
    assert "BuildLeft" not in plan(got)
    low = got.where("id < 50").toPandas().set_index("id")["lowest"]
    z = {(i // 64, i % 64): i * 7 % 50 for i in range(64 * 64)}
    for k in (0, 7, 49):
        spots = [((k % 100 + j * 16 - h) // 16, (k % 90 + i * 16 - 40) // 16) for i in range(6) for h in [(1600 - (i * 16 - 40) ** 2) ** 0.5] for j in range(int(h * 2 // 16) + 1)]
        assert low[k] == min(z[c] for c in spots if c in z)


def test_ages_of_every_second_match_sql(spark):
    """Seconds from none to 200,000, among them all whole and half hours."""
    now = F.lit(1_700_000_000)
    got = spark.range(200_000).select("id", maps.age_text(F.timestamp_seconds(now - F.col("id")), F.timestamp_seconds(now)).alias("age"))
    sql = entry.oracle_sql()["ages_in_words"].replace("event_id * 7919 % 200000", "event_id")
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT range AS event_id FROM range(200000)")
    want = con.execute(sql).fetchdf()
    both = got.toPandas().merge(want, on="id", suffixes=("", "_sql"))
    assert len(both) == 200_000
    assert both[both["age"] != both["age_sql"]].empty


def joined(df) -> int:
    """Rows that all joins of a plan gave, once it ran."""
    node = df._jdf.queryExecution().executedPlan()
    df.collect()

    def walk(p) -> int:
        name = p.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(p.executedPlan())
        if "QueryStage" in name:
            return walk(p.plan())
        own = p.metrics().apply("numOutputRows").value() if "Join" in name else 0
        return own + sum(walk(p.children().apply(i)) for i in range(p.children().size()))

    return walk(node)


def test_each_place_meets_the_rings_near_it_once(spark):
    """40 rings around one place where 500 points lie: 40 + 500 rows, not 20,000; a ring beside it whose box misses it isn't walked."""
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    rings = [("water", [(x + k / 100, y) for x, y in ring]) for k in range(40)] + [("building", [(x + 12, y) for x, y in ring])] * 9
    polygons = spark.createDataFrame(rings, "kind string, ring array<struct<e:double,n:double>>")
    points = spark.range(500).select("id", F.lit(5.0).alias("e"), F.lit(5.0).alias("n"))
    got = cover.cover(points, polygons, ["id"], 25.0)
    assert {r["cover"] for r in got.collect()} == {"water"}
    assert joined(cover.cover(points, polygons, ["id"], 25.0)) <= 40 + 500


def test_boxes_that_overlap_by_brute_force(spark):
    """Flat boxes, some long, touching ones, points."""
    boxes = [(i, float(i * 37 % 401), float(i * 37 % 401 + i % 30 * (20 if i % 50 == 0 else 1)), float(i * 53 % 97), float(i * 53 % 97 + i % 4)) for i in range(300)]
    got = select.overlapping(spark.createDataFrame(boxes, "id long, w double, e double, s double, n double"))
    want = {(p[0], q[0]) for p in boxes for q in boxes if p[0] < q[0] and p[1] <= q[2] and q[1] <= p[2] and p[3] <= q[4] and q[3] <= p[4]}
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert "BroadcastHashJoin" not in plan(got)


def shuffled(df) -> int:
    """Rows that the exchanges of a plan wrote, once it ran."""
    node = df._jdf.queryExecution().executedPlan()
    df.collect()

    def walk(p) -> int:
        name = p.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(p.executedPlan())
        if "QueryStage" in name:
            return walk(p.plan())
        own = p.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
        return own + sum(walk(p.children().apply(i)) for i in range(p.children().size()))

    return walk(node)


def overlaps(boxes) -> list:
    return sorted((p[0], q[0]) for p in boxes for q in boxes if p[0] < q[0] and p[1] <= q[2] and q[1] <= p[2] and p[3] <= q[4] and q[3] <= p[4])


def test_boxes_are_shuffled_hardly_more_than_once(spark):
    """Boxes of all sizes up to 20 by 6 over 600 by 200, ids in no order: a row or two each, where cells of their average size took four."""
    boxes = [(i * 7919 % 10007 - 3000, float(i * 37 % 601), float(i * 37 % 601 + i % 21), i * 53 % 199 + 0.5, i * 53 % 199 + 0.5 + i % 7) for i in range(2000)]
    df = spark.createDataFrame([*boxes, (20_000, None, 1.0, 1.0, 1.0), (None, 0.0, 600.0, 0.0, 200.0)], "id long, w double, e double, s double, n double")
    assert sorted(tuple(r) for r in select.overlapping(df).collect()) == overlaps(boxes)
    assert shuffled(select.overlapping(df)) < 2 * len(boxes)


def test_a_crowded_block_is_dealt_to_groups(spark):
    """700 boxes that nearly all overlap, among them many that begin at one easting, and two far away."""
    boxes = [(i * 7919 % 1009, float(i % 5), float(i % 5 + 3 + i % 40), float(i * 53 % 97), float(i * 53 % 97 + i % 90)) for i in range(700)]
    boxes += [(2000, 500.0, 501.0, 0.0, 9.0), (2001, 501.0, 502.0, 9.0, 9.0)]
    df = spark.createDataFrame(boxes, "id long, w double, e double, s double, n double")
    got = select.overlapping(df, 20)
    assert "own" in plan(got)
    assert sorted(tuple(r) for r in got.collect()) == overlaps(boxes)


def test_dedupe_lists_pairs_of_the_best_only(spark, monkeypatch):
    """Copies and near copies, either way round, with ties and a null: as one pass from the best on, with few pairs listed."""
    rows = [(i, float(i % 7), 100.0 * (i % 9), 5.0 * (i % 3), 100.0 * (i % 9) + 90, float(i % 11)) for i in range(1500)]
    rows = [(i, s, *((be, bn, ae, an) if i % 4 == 0 and i % 9 else (ae, an, be, bn))) for i, s, ae, an, be, bn in rows] + [(2000, None, 0.0, 0.0, 90.0, 0.0)]
    kept: list[tuple] = []
    for r in sorted(rows[:-1], key=lambda r: (-r[1], r[0])):
        if not any(math.dist(r[2:4], k[2:4]) <= 12 and math.dist(r[4:6], k[4:6]) <= 12 or math.dist(r[2:4], k[4:6]) <= 12 and math.dist(r[4:6], k[2:4]) <= 12 for k in kept):
            kept.append(r)
    listed = []
    settle = select.independent
    monkeypatch.setattr(select, "independent", lambda nodes, met: listed.append(met.count()) or settle(nodes, met))
    got = select.dedupe(spark.createDataFrame(rows, "id long, score double, ae double, an double, be double, bn double"), 12.0, begin=50)
    assert sorted(r["id"] for r in got.collect()) == sorted([r[0] for r in kept] + [2000])
    assert sum(listed) < 5000  # of about 100,000


def test_thinning_lists_no_pairs_of_all(spark):
    """Spans of one region that nearly all cross, point-like ones, touching ones and one without a place: as plain code has it, step by step."""
    rows = [(1, i, float(i * 29 % 71), *((10.0 * (i % 13), 0.0, 120.0 - 10 * (i % 7), 90.0) if i % 10 else (5.0 * (i % 8), 5.0, 5.0 * (i % 8), 5.0 + i % 3))) for i in range(700)] + [(1, 900, 5.0, None, 0.0, 1.0, 1.0)]
    p = replace(DEFAULTS, max_crossings=3, keep_best=12)
    at = {r[1]: r for r in rows}

    def side(a, x, y):
        return (a[5] - a[3]) * (y - a[4]) - (a[6] - a[4]) * (x - a[3]) > 0

    def cross(a, b):
        return None not in (*a, *b) and side(a, *b[3:5]) != side(a, *b[5:7]) and side(b, *a[3:5]) != side(b, *a[5:7])

    best = [r[1] for r in sorted(rows, key=lambda r: (-r[2], r[1]))][:12]
    ids, tally = sorted(at), {}
    for i in best + [ids[k] for k in select._shuffled(len(ids)) if ids[k] not in best]:
        met = [m for m in tally if cross(at[i], at[m])]
        if i in best or len(met) <= 3 and all(tally[m] < 3 for m in met if m not in best):
            tally[i] = len(met)
            for m in met:
                tally[m] += 1
    got = select.thin(spark.createDataFrame(rows, "region long, id long, score double, ae double, an double, be double, bn double"), p=p)
    assert sorted(r["id"] for r in got.collect()) == sorted(tally)
    assert "collect_list" not in plan(got) and "Generate" not in plan(got)


def test_dense_pairs_meet_once(spark):
    """900 points, dense enough for cells of a quarter of the reach, some straight above another, one at a negative nought."""
    rows = [(i * 7919 % 9973, float(i * 37 % 61), float(i * 53 % 47), (i * 2654435761) % 2**62) for i in range(900)] + [(9999, -0.0, 30.0, 2**62 - 1)]
    df = spark.createDataFrame(rows, "id long, e double, n double, open long")
    assert len(pairs._offsets(4, 9.0, 20.0)) == 38 and (3, -3) in pairs._offsets(4, 9.0, 20.0) and (4, 4) not in pairs._offsets(4, 9.0, 20.0)

    def faces(mask, b):
        return mask >> int(b / math.tau * 64) % 64 & 1

    want, facing = set(), set()
    for a in rows:
        for b in rows:
            if a[0] < b[0] and 81 <= (b[1] - a[1]) ** 2 + (b[2] - a[2]) ** 2 <= 400:
                want.add((a[0], b[0], (b[1] - a[1]) ** 2 + (b[2] - a[2]) ** 2, a[1], b[2]))
                w = math.atan2(b[1] - a[1] + 0.0, b[2] - a[2])
                w = w + math.tau if w < 0 else w
                if faces(a[3], w) and faces(b[3], (w + math.pi) % math.tau):
                    facing.add((a[0], b[0]))
    got = pairs.band_join(df, 9.0, 20.0).select("i", "j", "d2", "a_e", "b_n").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert sorted(tuple(r) for r in pairs.band_join(df, 9.0, 20.0, gates=True).select("i", "j").collect()) == sorted(facing)
    box = (20, 10, 40, 30)
    reach = pairs.within_reach(df, box, 20.0)
    assert reach.count() < 800
    assert sorted(tuple(r) for r in pairs.owned(pairs.band_join(reach, 9.0, 20.0), box).collect()) == sorted(tuple(r) for r in pairs.owned(pairs.band_join(df, 9.0, 20.0), box).collect())
    # the angle is taken once for each end, not in every branch
    assert plan(pairs.band_join(df, 9.0, 20.0, gates=True).select("i")).count("ATAN2") <= 4


def test_ways_near_spans_in_shares_of_a_cell(spark, monkeypatch):
    """A crowded cell is dealt to groups; pairs are the same as all pairs held against each other, and are no rows before they are near."""
    monkeypatch.setattr(ways, "GROUP", 500)
    spans = [(i, float(i * 37 % 300), float(i * 53 % 80), float(i * 37 % 300 + 30 + i % 50), float(i * 53 % 80 + i % 31 - 15)) for i in range(60)]
    segs = [(i, i % 2, "street", "residential", 1.0 + i % 4, False, float(i * 29 % 310), float(i * 41 % 90), float(i * 29 % 310 + i % 23), float(i * 41 % 90 + i % 17)) for i in range(90)]
    a = spark.createDataFrame(spans, "id long, ae long, an double, be double, bn double".replace("ae long", "ae double"))
    b = spark.createDataFrame(segs, "way long, seg int, tier string, kind string, half double, bridge boolean, x0 double, y0 double, x1 double, y1 double")
    got = ways.near(a, b)
    want = set()
    for s in spans:
        for r in segs:
            apart = ways.apart2(tuple(np.array([v]) for v in s[1:]), tuple(np.array([v]) for v in r[6:]))[0]
            if apart <= (r[4] + math.dist(s[1:3], s[3:5]) * DEFAULTS.side_ratio) ** 2:
                want.add((*s, *r))
    rows = got.collect()
    assert got.columns == [*a.columns, *b.columns]
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want
    assert "Join" not in plan(got)


def test_stretches_joined_in_cells_are_those_joined_at_once(spark, monkeypatch):
    """Heights from the grid and from joins, bridges on a higher one, holes in the ground; stretches of a cell joined many times over."""
    monkeypatch.setattr(ways, "HELD", 20)
    monkeypatch.setattr(ways, "AT_ONCE", 16)
    spans = spark.createDataFrame([(i, float(i * 37 % 90), float(i * 53 % 60), float(i * 37 % 90 + 30 + i % 40), float(i * 53 % 60 + i % 21 - 10)) for i in range(25)], "id long, ae double, an double, be double, bn double")
    roads = [(i, "street" if i % 3 else "road", "residential", 1.0 + i % 4, i % 5 == 0, [{"e": float(i * 29 % 110), "n": float(i * 41 % 70)}, {"e": float(i * 29 % 110 + 9), "n": float(i * 41 % 70 + i % 17)}]) for i in range(60)]
    roads = spark.createDataFrame(roads, "id long, tier string, kind string, half double, bridge boolean, pts array<struct<e:double,n:double>>")
    ground = spark.range(200 * 120).select((F.col("id") % 200 - 20).alias("cx"), F.floor(F.col("id") / 200 - 20).alias("cy"), (F.col("id") * 7919 % 64 / 4.0).alias("z")).where("(cx + 3 * cy) % 11 <> 0")
    bridges = ground.withColumn("z", F.col("z") + 5)

    def rows(*grounds):
        return sorted(map(repr, ways.crossings(spans, roads, DEFAULTS, *grounds).collect()))

    flat, low, high = rows(), rows(ground), rows(ground, bridges)
    assert "Join" not in plan(ways.crossings(spans, roads, DEFAULTS, ground, bridges)) and len(flat) > 30
    monkeypatch.setattr(ways, "_grid", lambda cells: None)
    assert rows(ground) == low and rows(ground, bridges) == high != low
    found = ways.near(spans, ways.segments(roads)).mapInPandas(lambda it: ways._touch(it, DEFAULTS.side_ratio), ways._CROSSING)
    assert sorted(map(repr, series.merge_intervals(found.withColumn("carrier", F.lit(None).cast("double")).drop("way", "seg", "feet"), ["id", "kind", "tier", "onBridge"]).collect())) == flat
