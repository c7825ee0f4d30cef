"""Heights of ways, plans, refinement and optimising, on a canyon with a raised road."""

import pytest
from pyspark.sql import functions as F

from spanforge.operators import dataset, profile, raster, search, ways
from spanforge.sources import readers

WAY = "id long, tier string, kind string, half double, bridge boolean, pts " + readers.POINTS
SPAN = "id long, ae double, an double, be double, bn double"


def canyon(spark, dam=None, w=300, h=120):
    """Rims of 50 m, a floor of 20 m, and a dam across it from south to north at 148..152 m."""
    z = F.when((F.col("cx") < 60) | (F.col("cx") >= 240), 50.0)
    if dam is not None:
        z = z.when(F.col("cx").between(158, 162), dam)
    return spark.range(w * h).select((F.col("id") % w).alias("cx"), F.floor(F.col("id") / w).alias("cy")).withColumn("z", z.otherwise(20.0))


def road(spark, e=150.0, bridge=False):
    return spark.createDataFrame([(7, "street", "residential", 3.0, bridge, [{"e": e, "n": 0.0}, {"e": e, "n": 119.0}])], WAY)


def test_a_crossing_carries_the_ways_own_height(spark):
    span = spark.createDataFrame([(1, 57.5, 60.5, 242.5, 60.5)], SPAN)
    got = ways.crossings(span, road(spark), ground=canyon(spark)).first()
    assert got["carrier"] == 20.0 and got["from"] < got["d"] < got["to"]
    assert ways.crossings(span, road(spark)).first()["carrier"] is None
    # the road's edge is at 157 m, the dam begins at 158 m: only the road's own centre line counts, and it lies on the floor
    assert ways.crossings(span, road(spark, 155.0), ground=canyon(spark, 30.0)).first()["carrier"] == 20.0
    assert ways.crossings(span, road(spark, 160.0), ground=canyon(spark, 30.0)).first()["carrier"] == 30.0
    deck = canyon(spark).withColumn("z", F.lit(33.336))
    assert ways.crossings(span, road(spark, 150.0, True), ground=canyon(spark), surface=deck).first()["carrier"] == 33.34
    assert ways.crossings(span, road(spark, 150.0), ground=canyon(spark), surface=deck).first()["carrier"] == 20.0
    nothing = ways.crossings(span, road(spark), ground=canyon(spark).where("cx < 100")).first()
    assert nothing["carrier"] is None


def test_a_raised_road_rejects_what_a_low_one_lets_pass(spark):
    span = spark.createDataFrame([(1, 57.5, 60.5, 242.5, 60.5)], SPAN)
    low = search.evaluate(span, search.Scene(canyon(spark), ways=road(spark))).first()
    # the dam is low enough for the ground's own clearance (3 m) but not for a street's (11 m)
    raised = search.evaluate(span, search.Scene(canyon(spark, 34.0), ways=road(spark, 160.0))).first()
    free = search.evaluate(span, search.Scene(canyon(spark, 34.0))).first()
    assert low["reject"] is None and free["reject"] is None and raised["reject"] == "crossing"


def test_a_plan_names_the_way_it_is_short_over(spark):
    span = spark.createDataFrame([(1, 57.5, 60.5, 242.5, 60.5)], SPAN)
    plan = search.plan(span, search.Scene(canyon(spark, 34.0), ways=road(spark, 160.0))).first()
    (v,) = plan["violations"]
    assert v["rule"] == "crossing" and v["limit"] == 11.0 and v["value"] < 11 and v["what"] == "residential" and 95 < v["at"] < 110
    assert search.plan(span, search.Scene(canyon(spark), ways=road(spark))).first()["violations"] == []


def small(spark):
    """Two rims, one of them a metre higher further in: worth moving to."""
    z = F.when(F.col("cx") < 12, 50.0 + (F.col("cx") < 9).cast("int")).when(F.col("cx") >= 80, 50.0)
    return spark.range(92 * 12).select((F.col("id") % 92).alias("cx"), F.floor(F.col("id") / 92).alias("cy")).withColumn("z", z.otherwise(20.0))


def test_optimising_gains_and_stays_within_reach(spark):
    scene = search.Scene(small(spark))
    line = spark.createDataFrame([(1, 10.5, 6.0, 81.5, 6.0)], SPAN)
    before = search.plan(line, scene).first()
    got = search.optimise(line, scene, reach=2.0, spacing=1.0, finest=0.5)
    after = search.plan(got, scene).first()
    moved = got.first()
    assert (len(after["violations"]), -after["score"]) <= (len(before["violations"]), -before["score"])
    assert after["score"] > before["score"]
    for end in "ab":
        assert (moved[f"{end}e"] - line.first()[f"{end}e"]) ** 2 + (moved[f"{end}n"] - line.first()[f"{end}n"]) ** 2 <= 4.0 + 1e-6


def test_refining_never_loses(spark):
    scene = search.Scene(small(spark))
    found = search.evaluate(spark.createDataFrame([(1, 10.5, 6.5, 81.5, 6.5)], SPAN), scene).where("reject is null").drop("reject")
    before = found.first()
    after = search.refine(found, scene, search.replace(search.DEFAULTS, refine_radius=1.0, refine_passes=2)).first()
    assert after["score"] >= before["score"] and abs(after["ae"] - 10.5) <= 1 and abs(after["be"] - 81.5) <= 1


def test_roofs_stand_on_loaded_tiles_only(spark):
    ground = spark.createDataFrame([(0, 0, 5.0), (3, 0, 9.0)], "cx long, cy long, z double")
    roofs = spark.createDataFrame([(0, 0, 7.0), (1, 1, 8.0), (25, 0, 30.0)], "cx long, cy long, z double")
    got = {(r["cx"], r["cy"]): (r["z"], r["roof"]) for r in raster.raise_onto(ground, roofs, tile=10).collect()}
    assert got == {(0, 0): (7.0, True), (1, 1): (8.0, True), (3, 0): (9.0, False)}


def test_rows_are_numbered_in_order_over_all_ranges(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 1009).alias("k")).repartition(7)
    got = sorted((r["number"], r["k"]) for r in dataset.ranked(df, [F.desc("k"), F.col("id")], "number").collect())
    assert [n for n, _ in got] == list(range(1000)) and [k for _, k in got] == sorted((k for _, k in got), reverse=True)
    assert dataset.ranked(df.limit(0), [F.col("k")], "number").count() == 0


def test_no_kinds_pass_nothing(spark):
    df = spark.createDataFrame([("natural", 1.0, 1.0, 1.0, 0.0, 0.0)], "kind string, score double, length double, exposure double, blocked double, off_level_ratio double")
    assert df.where(dataset.line_filter([])).count() == 0 and df.where(dataset.line_filter()).count() == 1


@pytest.mark.parametrize("band", [[1.0, 2.0], [1.0, 5.0]])
def test_packing_drops_what_says_nothing(spark, band):
    df = spark.createDataFrame([(1, [1.0, 2.0], band, [3.0, 3.0], 100.0, 2.0, 2.0)], "id long, ground array<double>, ground_max array<double>, needed array<double>, length double, h_a double, h_b double")
    packed = profile.pack(df).first()
    assert (packed["ground_max"] is None) == (band == [1.0, 2.0]) and packed["needed"] is None
    assert profile.unpack(profile.pack(df), 0.05).orderBy("i").select("ground_max", "needed").collect() == [(band[0], 3.0), (band[1], 3.0)]


def test_the_loosest_sag_over_ways_is_that_of_the_gates(spark):
    kinds = "id long, ground array<double>, surface array<double>, length double, h_a double, h_b double, off_level double, crossings " + profile.NO_CROSSINGS
    rim = [50.0] + [20.0] * 39 + [50.0]

    def over(carrier, tier="street", bridge=False):
        return [{"d": 100.0, "from": 95.0, "to": 130.0, "offset": 0.0, "kind": "x", "tier": tier, "carrier": carrier, "onBridge": bridge}]

    rows = [(1, rim, None, over(33.0)), (2, rim, None, over(None)), (3, rim, [60.0] + [35.0] * 39 + [60.0], over(None, "highway", True)), (4, rim, None, []), (5, rim, None, over(48.0)), (6, [50.0, None, 20.0, None, 50.0], None, over(None))]
    df = spark.createDataFrame([(i, g, s, 200.0, 50.0, 49.0, 1.0, x) for i, g, s, x in rows], kinds)
    got = {r["id"]: r["max_sag"] for r in profile.max_sag(df).collect()}

    def passes(ratio):
        measured = profile.metrics(df, F.lit(ratio)).join(df.select("id", "length", "off_level"), "id")
        return {r["id"] for r in measured.where(profile.rejection().isNull()).select("id").collect()}

    below = {s: passes(s) for s in (0.0, 0.02, 0.04, 0.05, 0.06, 0.08, 0.1, 0.13, 0.2)}
    for i, most in got.items():
        for s, ok in below.items():
            if abs(s - most) > 2e-4:
                assert (i in ok) == (s < most), (i, most, s)
    assert got[5] == 0 and got[1] < got[2] <= got[4] and got[3] < got[4]
