"""Queries over map tiles, outlines, sliders, overlays and replies, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.functions import maps
from spanforge.functions.scalars import to_utm, to_wgs84
from spanforge.operators import dataset, places, ways
from spanforge.plans import bindings as b
from spanforge.plans import etl
from spanforge.plans.queries import query
from spanforge.runtime import stage_path
from spanforge.sources import blocks, readers, sinks

# Coordinates of customers and nations in degrees, exact in both engines.
SPOTS = "spots AS (SELECT c_custkey AS id, c_custkey * 7919 % 1009 / 64.0::DOUBLE + 3 AS lon, c_custkey * 104729 % 1013 / 128.0::DOUBLE + 46 AS lat FROM customer)"
LANDS = """lands AS (SELECT n_nationkey AS name, 4 + n_nationkey % 5 * 2.5::DOUBLE AS lon, 46.5::DOUBLE + n_nationkey // 5 * 1.5::DOUBLE AS lat FROM nation),
    corners AS (SELECT name, k, lon + [0, 1.75, 2, 0.25][k + 1] AS x, lat + [0, 0.125, 1, 0.875][k + 1] AS y FROM lands, (VALUES (0), (1), (2), (3)) AS v(k)),
    sides AS (SELECT a.name, a.x AS x0, a.y AS y0, c.x AS x1, c.y AS y1 FROM corners a JOIN corners c ON a.name = c.name AND c.k = (a.k + 1) % 4)"""


def _spots(spark, sf):
    k = F.col("c_custkey")
    return b.table(spark, sf, "customer").select(k.alias("id"), (k * 7919 % 1009 / F.lit(64.0) + 3).alias("lon"), (k * 104729 % 1013 / F.lit(128.0) + 46).alias("lat"))


def _lands(spark, sf):
    k = F.col("n_nationkey")
    lon, lat = 4 + k % 5 * F.lit(2.5), 46.5 + F.floor(k / 5) * F.lit(1.5)
    ring = F.array(*[F.struct((lon + x).cast("double").alias("e"), (lat + y).cast("double").alias("n")) for x, y in ((0, 0), (1.75, 0.125), (2, 1), (0.25, 0.875))])
    return b.table(spark, sf, "nation").select(k.alias("name"), ring.alias("ring"))


# tiles ---------------------------------------------------------------------------------------------


@query(
    f"""WITH {SPOTS}, spot AS (SELECT id, lon / 180 * 20037508.342789244::DOUBLE AS x, ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0::DOUBLE AS y, 30 + id % 400 AS half,
    CAST(least(19, greatest(10, floor(log2(20037508.342789244::DOUBLE / (30 + id % 400) * cos(radians(lat)) * 5)))) AS INT) AS zoom FROM spots),
    n AS (SELECT *, pow(2, zoom) AS n, 40075016.685578488::DOUBLE AS w FROM spot)
    SELECT id, zoom, CAST(floor((x - half + w / 2) / w * n) AS BIGINT) AS x0, CAST(floor((w / 2 - y - half) / w * n) AS BIGINT) AS y0, CAST(floor((x + half + w / 2) / w * n) AS BIGINT) AS x1, CAST(floor((w / 2 - y + half) / w * n) AS BIGINT) AS y1 FROM n"""
)
def map_tiles(spark, sf):
    half = (30 + F.col("id") % 400).cast("double")
    at = _spots(spark, sf).select("id", maps.mercator(F.col("lat"), F.col("lon")).alias("m"), half.alias("half"), maps.zoom_for(half, F.col("lat")).alias("zoom"))
    box = [F.col("m.x") - F.col("half"), F.col("m.y") - F.col("half"), F.col("m.x") + F.col("half"), F.col("m.y") + F.col("half")]
    return at.select("id", "zoom", maps.tile_range(*box, F.col("zoom")).alias("r")).select("id", "zoom", "r.*")


@query(
    """WITH t AS (SELECT p_partkey AS id, 10 + p_partkey % 10 AS z, p_partkey * 7919 % 1024 AS x, p_partkey * 104729 % 1021 AS y, CASE WHEN p_partkey % 3 > 0 THEN 14 END AS deepest FROM part),
    o AS (SELECT *, greatest(0, z - coalesce(deepest, z)) AS over FROM t), s AS (SELECT *, CAST(pow(2, over) AS BIGINT) AS side FROM o)
    SELECT id, CAST(z - over AS INT) AS zoom, x // side AS x, y // side AS y, (x % side) / side::DOUBLE AS "left", (y % side) / side::DOUBLE AS top, 1 / side::DOUBLE AS part FROM s"""
)
def tile_ancestors(spark, sf):
    k = F.col("p_partkey")
    up = maps.ancestor((10 + k % 10).cast("int"), k * 7919 % 1024, k * 104729 % 1021, F.when(k % 3 > 0, F.lit(14)))
    return b.table(spark, sf, "part").select(k.alias("id"), up.alias("t")).select("id", "t.*")


@query(
    f"""WITH {SPOTS} SELECT id, CASE WHEN id % 7 = 0 THEN true ELSE lon - 0.25 <= 12 AND lon + 0.25 >= 9 AND lat - 0.125 <= 51 AND lat + 0.125 >= 48.5 END AS touches FROM spots"""
)
def layers_touched(spark, sf):
    """Boxes around places against a layer's box; every seventh layer has none."""
    corner = [maps.mercator(F.col("lat") + s * 0.125001, F.col("lon") + s * 0.250001) for s in (-1, 1)]
    limits = [F.when(F.col("id") % 7 != 0, F.lit(v)) for v in (9.0, 48.5, 12.0, 51.0)]
    return _spots(spark, sf).select("id", maps.touches(corner[0]["x"], corner[0]["y"], corner[1]["x"], corner[1]["y"], *limits).alias("touches"))


# outlines ------------------------------------------------------------------------------------------

BESIDE = f"""{SPOTS}, {LANDS}, local AS (SELECT id, name, y0 > lat AS up0, y1 > lat AS up1, lon < x1 + (lat - y1) / nullif(y0 - y1, 0) * (x0 - x1) AS hit, (x0 - lon) * cos(radians(lat)) * 111320 AS ax, (y0 - lat) * 111320 AS ay, (x1 - x0) * cos(radians(lat)) * 111320 AS dx, (y1 - y0) * 111320 AS dy FROM spots, sides),
    feet AS (SELECT *, least(1, greatest(0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) AS t FROM local),
    beside AS (SELECT id, name FROM feet GROUP BY id, name HAVING count(*) FILTER (up0 <> up1 AND hit) % 2 = 1 OR min((ax + dx * t) ** 2 + (ay + dy * t) ** 2) <= 36000000)"""


@query(f"WITH {BESIDE} SELECT id, name FROM beside")
def outlines_near(spark, sf):
    at = _spots(spark, sf).select("id", F.col("lon").alias("e"), F.col("lat").alias("n"))
    return places.near_outlines(at, _lands(spark, sf), ["id"])


@query(
    f"""WITH {BESIDE}, best AS (SELECT id, min(name) AS name FROM beside WHERE name % 3 = 1 GROUP BY id)
    SELECT id, CASE WHEN name < 20 THEN 's' || name ELSE 'everywhere' END AS source, coalesce(name < 20 AND name % 2 = 0, false) AS surface FROM spots LEFT JOIN best USING (id)"""
)
def source_of_place(spark, sf):
    """Every third land has data of its own; what is shared comes after the twentieth and covers all."""
    k = F.col("name")
    own = _lands(spark, sf).where(k % 3 == 1).select(F.concat(F.lit("s"), k.cast("string")).alias("source"), k.cast("long").alias("priority"), (k % 2 == 0).alias("surface"), k.cast("string").alias("outline"))
    sources = own.unionByName(spark.createDataFrame([("everywhere", 20, False, "none of them")], own.schema))
    at = _spots(spark, sf).select("id", F.col("lon").alias("e"), F.col("lat").alias("n"))
    return places.covered_by(at, sources, _lands(spark, sf).withColumn("name", k.cast("string")), ["id"]).select("id", "source", "surface")


@query("""SELECT 'c' || n_nationkey AS code, 'n' || n_nationkey AS name, CASE WHEN n_nationkey % 3 = 1 THEN 'survey' ELSE 'shared' END AS ground, n_nationkey % 3 = 1 AND n_nationkey % 2 = 0 AS canopy, n_nationkey % 4 = 0 AS lines FROM nation""")
def state_facts(spark, sf):
    k = F.col("name")
    lands = _lands(spark, sf)
    at = lands.select(F.concat(F.lit("c"), k.cast("string")).alias("code"), F.concat(F.lit("n"), k.cast("string")).alias("name"), (F.get("ring", F.lit(0))["e"] + 1).alias("e"), (F.get("ring", F.lit(0))["n"] + 0.5).alias("n"))
    own = lands.where(k % 3 == 1).select(F.concat(F.lit("s"), k.cast("string")).alias("source"), k.cast("long").alias("priority"), (k % 2 == 0).alias("surface"), F.concat(F.lit("n"), k.cast("string")).alias("outline"))
    sources = own.unionByName(spark.createDataFrame([("everywhere", 99, False, None)], own.schema))
    searched = lands.where(k % 4 == 0).select(F.concat(F.lit("n"), k.cast("string")).alias("name"))
    return places.integration(at, sources, lands.withColumn("name", F.concat(F.lit("n"), k.cast("string"))), searched, "everywhere")


@query("SELECT 'land ' || n_nationkey AS name, CAST(4 AS INT) AS points, CAST(4 + n_nationkey % 5 * 2.5 AS DOUBLE) AS e, CAST(46.5 + n_nationkey // 5 * 1.5 AS DOUBLE) AS n FROM nation WHERE n_nationkey % 6 <> 5")
def outlines_published(spark, sf):
    """Outlines written as features with a mark, the land read, thinned (one corner doubled) and written, and read again."""
    k = F.col("name")
    path = stage_path(spark, "lands")
    doubled = F.flatten(F.array(F.slice("ring", 1, 2), F.slice("ring", 2, 3)))
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(doubled, lambda q: F.array(q["e"], q["n"]))).alias("coordinates"))
    marks = F.struct(F.concat(F.lit("land "), k.cast("string")).alias("gen"), F.when(k % 6 == 5, F.lit(2)).otherwise(F.lit(4)).cast("string").alias("gf"))
    feature = F.struct(F.lit("Feature").alias("type"), marks.alias("properties"), shape.alias("geometry"))
    _lands(spark, sf).agg(F.to_json(F.struct(F.collect_list(feature).alias("features"))).alias("value")).write.text(path)
    land = readers.outlines(spark, path, wanted=21)
    sinks.write_outlines(land, f"{path}.json", 0.001)
    back = readers.read_geojson(spark, f"{path}.json")
    line = F.get(F.from_json(F.get_json_object("geometry", "$.coordinates"), "array<array<array<double>>>"), F.lit(0))
    return back.select(F.col("properties")["name"].alias("name"), F.size(line).alias("points"), F.get(F.get(line, F.lit(0)), F.lit(0)).alias("e"), F.get(F.get(line, F.lit(0)), F.lit(1)).alias("n"))


# lines ---------------------------------------------------------------------------------------------


@query(
    f"""WITH {b.TERRACES}, {b.SPANS}, far AS (SELECT *, sqrt((be - ae) * (be - ae) + (bn - an) * (bn - an)) AS long FROM spans),
    samples AS (SELECT id, side, k, CASE side WHEN 'before' THEN -(long * 0.02::DOUBLE) + long * 0.02::DOUBLE * k / 20 ELSE long + long * 0.02::DOUBLE * k / 20 END AS d, ae + (be - ae) / long * CASE side WHEN 'before' THEN -(long * 0.02::DOUBLE) + long * 0.02::DOUBLE * k / 20 ELSE long + long * 0.02::DOUBLE * k / 20 END AS e,
        an + (bn - an) / long * CASE side WHEN 'before' THEN -(long * 0.02::DOUBLE) + long * 0.02::DOUBLE * k / 20 ELSE long + long * 0.02::DOUBLE * k / 20 END AS n FROM far, (VALUES ('before'), ('after')) AS s(side), (SELECT unnest(range(0, 21)) AS k) u),
    spot AS (SELECT *, floor(e / 16 - 0.5) AS x0, floor(n / 16 - 0.5) AS y0, e / 16 - 0.5 - floor(e / 16 - 0.5) AS fx, n / 16 - 0.5 - floor(n / 16 - 0.5) AS fy, floor(e / 16) AS ox, floor(n / 16) AS oy FROM samples),
    read AS (SELECT id, side, k, d, CASE WHEN a.z IS NULL OR b.z IS NULL OR c.z IS NULL OR t.z IS NULL THEN o.z ELSE a.z * (1 - fx) * (1 - fy) + b.z * fx * (1 - fy) + c.z * (1 - fx) * fy + t.z * fx * fy END AS z FROM spot
        LEFT JOIN terraces a ON a.cx = x0 AND a.cy = y0 LEFT JOIN terraces b ON b.cx = x0 + 1 AND b.cy = y0 LEFT JOIN terraces c ON c.cx = x0 AND c.cy = y0 + 1 LEFT JOIN terraces t ON t.cx = x0 + 1 AND t.cy = y0 + 1 LEFT JOIN terraces o ON o.cx = ox AND o.cy = oy),
    seen AS (SELECT *, greatest(count(*) FILTER (side = 'before') OVER (PARTITION BY id), count(*) FILTER (side = 'after') OVER (PARTITION BY id)) AS most FROM read WHERE z IS NOT NULL)
    SELECT id, side, CAST(k AS INT) AS k, floor(d * 1000 + 0.5) AS d, floor(z * 1000 + 0.5) AS ground, floor(z * 1000 + 0.5) AS surface FROM seen WHERE most >= 2"""
)
def wing_ground(spark, sf):
    got = places.wings(b.spans(spark, sf), b.terraces(spark, sf), res=16.0)
    return got.select("id", "side", "k", *[F.floor(F.col(c) * 1000 + 0.5).cast("double").alias(c) for c in ("d", "ground", "surface")])


@query(f"WITH {b.INTERVALS} SELECT d AS id, CASE WHEN d % 2 = 0 THEN f ELSE d - CASE WHEN d % 3 > 0 THEN o ELSE 0 END END AS \"from\", CASE WHEN d % 2 = 0 THEN t ELSE d + CASE WHEN d % 3 > 0 THEN o ELSE 0 END END AS \"to\", CASE WHEN d % 2 = 0 THEN o ELSE 0.0::DOUBLE END AS \"offset\" FROM intervals")
def crossings_mended(spark, sf):
    old = F.col("d") % 2 == 1
    rows = b.intervals(spark, sf).withColumn("half", F.when(old & (F.col("d") % 3 > 0), F.col("offset"))).withColumns({c: F.when(~old, F.col(c)) for c in ("from", "to", "offset")})
    return places.with_extent(rows).select(F.col("d").alias("id"), "from", "to", "offset")


@query(f"WITH {b.LINES} SELECT count(*) FILTER (exposure > score) AS improved, avg(exposure - score) FILTER (exposure > score) AS gain FROM lines")
def refinement_gain(spark, sf):
    return dataset.mean_gain(b.lines(spark, sf).withColumn("refined", F.col("exposure")))


@query(f"WITH {b.POINTS} SELECT count(*) AS anchors, avg(bit_count(open)) AS open_sectors FROM points")
def open_on_average(spark, sf):
    return dataset.mean_open(b.points(spark, sf))


@query("""SELECT s_suppkey AS id, s_suppkey % 4 = 0 AS on_roof, ceil(greatest(3, (s_suppkey % 31) * 1.25::DOUBLE, CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey % 47 END)) AS ceiling, CASE WHEN s_suppkey % 4 = 0 THEN 0.0::DOUBLE ELSE 1.5::DOUBLE END AS free,
    greatest(CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE 1.5::DOUBLE END, (s_suppkey % 31) / 2.0::DOUBLE) AS trunk, greatest(CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE 1.5::DOUBLE END, CAST(s_suppkey % 31 AS DOUBLE)) AS crown,
    CASE WHEN s_suppkey % 4 = 0 THEN 'roof:0.0' ELSE 'ground:0.0,frame:1.5' END || CASE WHEN s_suppkey % 31 > CASE WHEN s_suppkey % 4 = 0 THEN 2 ELSE 3.5 END THEN ',trunk:' || CAST((s_suppkey % 31) / 2.0::DOUBLE AS VARCHAR) || ',top:' || CAST(CAST(s_suppkey % 31 AS DOUBLE) AS VARCHAR) ELSE '' END
    || CASE WHEN s_suppkey % 6 > 0 THEN ',level:' || CAST(CAST(s_suppkey % 13 AS DOUBLE) AS VARCHAR) ELSE '' END AS presets FROM supplier""")
def rig_tracks(spark, sf):
    k = F.col("s_suppkey")
    roof, canopy = k % 4 == 0, (k % 31).cast("double")
    value = F.when(k % 5 > 0, (k % 47).cast("double")).otherwise(F.lit(float("nan")))
    top = maps.rig_ceiling(canopy, value)
    bands = maps.rig_bands(roof, canopy, top)
    presets = maps.rig_presets(roof, canopy, F.when(k % 6 > 0, (k % 13).cast("double")))
    text = F.array_join(F.transform(presets, lambda q: F.concat_ws(":", q["label"], q["to"].cast("string"))), ",")
    return b.table(spark, sf, "supplier").select(k.alias("id"), roof.alias("on_roof"), top.alias("ceiling"), *[F.get(bands, F.lit(i)).alias(name) for i, name in enumerate(("free", "trunk", "crown"))], text.alias("presets"))


# sliders, ages, counts, shades -----------------------------------------------------------------------


@query("""WITH v AS (SELECT p_partkey AS id, CAST(40 + p_partkey * 37 % 500 AS DOUBLE) AS v, p_partkey % 241 AS p FROM part)
    SELECT id, CAST(CASE WHEN v <= 50 THEN 0 ELSE least(240, floor(240 * ln(v / 50) / ln(10.0::DOUBLE) + 0.5)) END AS INT) AS position, CASE WHEN p >= 240 THEN 500.0::DOUBLE ELSE greatest(50.0::DOUBLE, floor(50 * exp(ln(10.0::DOUBLE) * p / 240) + 0.5)) END AS value FROM v""")
def ratio_track(spark, sf):
    k = F.col("p_partkey")
    return b.table(spark, sf, "part").select(k.alias("id"), maps.track_position((40 + k * 37 % 500).cast("double"), 50, 500).alias("position"), maps.track_value(k % 241, 50, 500).alias("value"))


@query("""WITH a AS (SELECT event_id AS id, event_id * 7919 % 200000 AS s FROM events) SELECT id, CASE WHEN s >= 86400 THEN CAST(floor(s / 86400.0::DOUBLE + 0.5) AS BIGINT) || 'd ago' WHEN s >= 3600 THEN CAST(floor(s / 3600.0::DOUBLE + 0.5) AS BIGINT) || 'h ago' ELSE greatest(1, CAST(floor(s / 60.0::DOUBLE + 0.5) AS BIGINT)) || 'm ago' END AS age FROM a""")
def ages_in_words(spark, sf):
    now = F.lit(1_700_000_000)
    stamp = F.timestamp_seconds(now - F.col("event_id") * 7919 % 200000)
    return b.table(spark, sf, "events").select(F.col("event_id").alias("id"), maps.age_text(stamp, F.timestamp_seconds(now)).alias("age"))


NUMBERS = "numbers AS (SELECT o_orderkey AS id, o_orderkey * 16 AS n, [1, 100, 10000, 1000000][o_orderkey % 4 + 1] * (o_custkey % 64 * 16) AS of_ FROM orders)"


@query(
    f"""WITH {NUMBERS} SELECT id, CASE WHEN of_ < 10000 THEN format('{{:,}}', of_) WHEN of_ < 100000 THEN printf('%.1fk', of_ / 1000.0::DOUBLE) WHEN of_ < 1000000 THEN printf('%.0fk', of_ / 1000.0::DOUBLE) WHEN of_ < 100000000 THEN printf('%.1fM', of_ / 1000000.0::DOUBLE) WHEN of_ < 1000000000 THEN printf('%.0fM', of_ / 1000000.0::DOUBLE) ELSE printf('%.2fG', of_ / 1000000000.0::DOUBLE) END AS words FROM numbers"""
)
def counts_in_words(spark, sf):
    o = F.col("o_orderkey")
    n = F.get(F.array(*[F.lit(10 ** (2 * i)).cast("long") for i in range(4)]), (o % 4).cast("int")) * (F.col("o_custkey") % 64 * 16)
    return b.table(spark, sf, "orders").select(o.alias("id"), maps.compact(n).alias("words"))


@query("""WITH v AS (SELECT p_partkey AS id, p_partkey % 128 * 8 AS n, p_partkey % 5 * 64 AS of_ FROM part)
    SELECT id, CASE WHEN of_ = 0 THEN '' WHEN n > of_ AND n / of_ >= 10 THEN 'x' || CAST(floor(n / of_::DOUBLE + 0.5) AS BIGINT) WHEN n > of_ THEN 'x' || printf('%.1f', floor(n * 10 / of_::DOUBLE + 0.5) / 10)
    WHEN n * 100 / of_ >= 10 THEN printf('%.0f%%', floor(n * 100.0::DOUBLE / of_ + 0.5)) WHEN n * 100 / of_ >= 1 THEN printf('%.1f%%', floor(n * 1000.0::DOUBLE / of_ + 0.5) / 10) ELSE printf('%.2f%%', floor(n * 10000.0::DOUBLE / of_ + 0.5) / 100) END AS kept FROM v""")
def flow_in_words(spark, sf):
    k = F.col("p_partkey")
    return b.table(spark, sf, "part").select(k.alias("id"), maps.flow(k % 128 * 8, k % 5 * 64).alias("kept"))


@query("""WITH p AS (SELECT p_partkey AS id, i, CASE i WHEN 0 THEN p_partkey % 256 WHEN 1 THEN p_partkey * 7 % 256 WHEN 2 THEN p_partkey * 13 % 256 ELSE p_partkey * 31 % 256 END AS v, p_partkey * 17 % 256 AS shade FROM part, (VALUES (0), (1), (2), (3)) AS t(i))
    SELECT id, CAST(i AS INT) AS i, CAST(CASE i WHEN 3 THEN v ELSE least(255, round_even(v * (shade / 195.0::DOUBLE), 0)) END AS INT) AS shaded, CAST(CASE i WHEN 3 THEN CASE WHEN v >= 128 THEN 255 ELSE 0 END ELSE v END AS INT) AS opaque,
    CAST(CASE i WHEN 3 THEN v ELSE least(255, greatest(0, round_even(192 + (CASE WHEN v <= 128 THEN v * 1.5::DOUBLE ELSE 192 + (v - 128) * (63 / 127.0::DOUBLE) END - 192) * 2, 0))) END AS INT) AS rebased FROM p""")
def shaded_pixels(spark, sf):
    k = F.col("p_partkey")
    pixel = F.array(*[(k * m % 256).cast("int") for m in (1, 7, 13, 31)])
    shade = F.array((k * 17 % 256).cast("int"), F.lit(0), F.lit(0), F.lit(0))
    each = F.posexplode(F.arrays_zip(maps.shaded(pixel, shade).alias("shaded"), maps.opaque(pixel).alias("opaque"), maps.rebased(pixel, 128, 192, 2.0).alias("rebased")))
    return b.table(spark, sf, "part").select(k.alias("id"), each.alias("i", "v")).select("id", "i", "v.shaded", "v.opaque", "v.rebased")


@query(f"""WITH {b.CELLS}, {b.ROOFS} SELECT c.cx, c.cy, CASE WHEN r.z > 40 THEN 'building' WHEN c.z % 11 = 0 THEN 'water' WHEN greatest(c.z, r.z) - c.z >= 2 THEN 'canopy' ELSE 'ground' END AS cover, greatest(c.z, coalesce(r.z, c.z)) AS skin FROM cells c LEFT JOIN roofs r ON c.cx = r.cx AND c.cy = r.cy""")
def cover_classes(spark, sf):
    both = b.cells(spark, sf).join(b.roofs(spark, sf).withColumnRenamed("z", "r"), ["cx", "cy"], "left").withColumn("skin", maps.skin(F.col("z"), F.col("r")))
    return both.select("cx", "cy", maps.cover_class(F.col("r") > 40, F.col("z") % 11 == 0, F.col("z"), F.col("skin")).alias("cover"), "skin")


# chunks --------------------------------------------------------------------------------------------


@query("SELECT g.e || '_' || s_suppkey AS chunk FROM supplier, LATERAL (SELECT unnest(range(s_suppkey % 40, s_suppkey % 40 + s_nationkey + 1)) AS e) g")
def chunks_of_runs(spark, sf):
    k = F.col("s_suppkey")
    return places.chunks_of_runs(b.table(spark, sf, "supplier").select(k.alias("n"), (k % 40).alias("first"), (k % 40 + F.col("s_nationkey")).alias("last")))


@query("""WITH t AS (SELECT DISTINCT o_orderkey * 7919 % 401 AS te, o_custkey % 97 AS tn, o_orderpriority = '1-URGENT' AS kept FROM orders), a AS (SELECT DISTINCT te, tn FROM t), k AS (SELECT DISTINCT te, tn FROM t WHERE kept)
    SELECT (SELECT count(*) FROM a) AS covered, (SELECT count(DISTINCT (te // 8, tn // 8)) FROM a) AS chunks_covered, (SELECT count(*) FROM k) AS kept, (SELECT count(DISTINCT (te // 8, tn // 8)) FROM k) AS chunks_kept, (SELECT count(*) / CAST(count(DISTINCT (te // 8, tn // 8)) AS DOUBLE) FROM k) AS kept_a_chunk""")
def tiles_counted(spark, sf):
    orders = b.table(spark, sf, "orders").select((F.col("o_orderkey") * 7919 % 401).alias("te"), (F.col("o_custkey") % 97).alias("tn"), "o_orderpriority")
    return places.tile_census(orders, orders.where("o_orderpriority = '1-URGENT'"))


@query("""WITH drawn AS (SELECT s_suppkey * 3000 % 400000 AS e, s_suppkey * 5000 % 300000 AS n, s_nationkey * 500 AS w FROM supplier), chunks AS (SELECT i AS ce, j AS cn FROM (SELECT unnest(range(0, 50)) AS i) a, (SELECT unnest(range(0, 40)) AS j) b)
    SELECT DISTINCT ce, cn FROM chunks JOIN drawn ON e < (ce + 1) * 8000 AND e + w > ce * 8000 AND n < (cn + 1) * 8000 AND n + w > cn * 8000 WHERE w > 0""")
def chunk_clashes(spark, sf):
    k, w = F.col("s_suppkey"), F.col("s_nationkey") * 500.0
    boxes = b.table(spark, sf, "supplier").select((k * 3000 % 400000).alias("min_e"), (k * 5000 % 300000).alias("min_n"), (k * 3000 % 400000 + w).alias("max_e"), (k * 5000 % 300000 + w).alias("max_n"))
    chunks = spark.range(2000).select(F.floor(F.col("id") / 40).alias("ce"), (F.col("id") % 40).alias("cn"))
    return places.clashes(chunks, boxes)


# files -----------------------------------------------------------------------------------------------


@query("""SELECT p_partkey AS id, p_partkey % 4 < 2 AS held, CASE p_partkey % 4 WHEN 0 THEN 'II*' || chr(1) || p_name WHEN 1 THEN 'MM' || p_name END AS said, CASE p_partkey % 4 WHEN 2 THEN 'holds nothing here' WHEN 3 THEN 'no data ' || p_partkey END AS error FROM part""")
def tiles_in_json(spark, sf):
    k, name = F.col("p_partkey"), F.col("p_name")
    data = F.when(k % 4 == 0, F.concat(F.lit("II*\x01"), name)).when(k % 4 == 1, F.concat(F.lit("MM"), name))
    rasters = F.when(data.isNotNull(), F.array(F.struct(F.regexp_replace(F.base64(data.cast("binary")), r"\s", "").alias("Data"), F.lit("x").alias("Attribution"))))
    detail = F.when(k % 4 == 3, F.struct(F.concat(F.lit("no data "), k.cast("string")).alias("Detail")))
    reply = F.to_json(F.struct(F.struct(rasters.alias("RawTIFs"), detail.alias("Error")).alias("Attributes")))
    got = readers.tiles_in_json(b.table(spark, sf, "part").select(k.alias("id"), reply.alias("reply")))
    return got.select("id", F.col("content").isNotNull().alias("held"), F.col("content").cast("string").alias("said"), "error")


@query("""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN length(p_name) + 4 WHEN 1 THEN length(p_name) + 4 ELSE 0 END AS size, CASE p_partkey % 4 WHEN 2 THEN 'outside ' || p_partkey WHEN 3 THEN 'a reply without a raster' END AS error FROM part""")
def rasters_in_replies(spark, sf):
    """Replies of two parts, of one, refusals, and something else."""
    k, name = F.col("p_partkey"), F.col("p_name")
    body = F.when(k % 4 == 0, F.concat(F.lit("--part\r\n<xml/>\r\n\r\nII*\x00"), name)).when(k % 4 == 1, F.concat(F.lit("MM\x00*"), name))
    refusal = F.concat(F.lit("<ows:ExceptionReport><ows:ExceptionText> outside "), k.cast("string"), F.lit("</ows:ExceptionText>"))
    reply = F.coalesce(body, F.when(k % 4 == 2, refusal), name)
    got = readers.rasters_in(b.table(spark, sf, "part").select(k.alias("id"), reply.cast("binary").alias("reply")))
    return got.select("id", F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("size"), "error")


@query("SELECT s_suppkey AS id, s_nationkey * 1.5::DOUBLE AS length, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS name FROM supplier WHERE s_suppkey % 3 = 1 AND s_suppkey % 5 > 0")
def known_lines_detailed(spark, sf):
    k = F.col("s_suppkey")
    path = stage_path(spark, "known")
    about = F.struct(k.cast("string").alias("id"), F.when(k % 3 == 1, "DE").otherwise("FR").alias("c"), F.when(k % 5 > 0, "h").otherwise("l").alias("lt"), (F.col("s_nationkey") * 1.5).cast("string").alias("len"))
    shape = F.struct(F.lit("LineString").alias("type"), F.array(F.array(F.lit(10.0), F.lit(50.0)), F.array(F.lit(10.1), F.lit(50.1))).alias("coordinates"))
    feature = F.struct(about.alias("properties"), shape.alias("geometry"))
    held = b.table(spark, sf, "supplier")
    held.agg(F.to_json(F.struct(F.collect_list(feature).alias("features"))).alias("value")).write.text(path)
    details = held.where(k % 2 == 0).select(k.cast("string").alias("id"), F.col("s_name").alias("name"))
    return readers.known_lines(spark, path, details=details).select(F.col("id").cast("long").alias("id"), F.col("properties")["len"].cast("double").alias("length"), "name")


@query("SELECT s_suppkey AS id, CAST(s_nationkey AS DOUBLE) AS drop, s_name AS name FROM supplier")
def overlay_read(spark, sf):
    path = stage_path(spark, "overlay")
    rows = b.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("double").alias("drop"), F.col("s_name").alias("name"))
    lists = rows.agg(F.array_sort(F.collect_list(F.struct("id", "drop", "name"))).alias("x")).select(F.to_json(F.struct(*[F.col(f"x.{c}").alias(c) for c in rows.columns])).alias("value"))
    lists.write.text(path)
    return readers.overlay(spark, path, "id long, drop double, name string")


@query(f"WITH {b.LINES} SELECT region, id, kind, CASE WHEN region < 4 THEN score END AS score FROM lines WHERE region IN (1, 2, 5) UNION ALL SELECT region, id, kind, score FROM lines WHERE region = 2")
def usage_of_all(spark, sf):
    """Three regions and one of them again; the last knows no score."""
    rows = b.lines(spark, sf).select("region", "id", "kind", "score")
    path = stage_path(spark, "usage")
    sinks.write_usage([rows.where("region = 1"), rows.where("region = 2"), rows.where("region = 5").drop("score"), rows.where("region = 2")], path)
    return spark.read.json(path).select("region", "id", "kind", "score")


@query(f"WITH {b.LINES} SELECT count(*) FILTER (kind = 'natural') AS count_natural, count(*) FILTER (kind = 'urban') AS count_urban, CAST(ceil(greatest(max(score), 1)) AS BIGINT) AS max_score, CAST(ceil(greatest(max(length), 100)) AS BIGINT) AS max_length, CAST(ceil(greatest(max(exposure), 10)) AS BIGINT) AS max_exposure, 0.25::DOUBLE AS stat_gain FROM lines")
def dataset_meta(spark, sf):
    path = stage_path(spark, "meta") + ".json"
    sinks.write_meta(sinks.meta(b.lines(spark, sf), {"gain": 0.25}), path)
    return spark.read.json(path).drop("generated_at")


@query("""WITH f AS (SELECT p_partkey AS id, CAST(p_partkey * 7919 % 1009 AS DOUBLE) AS x, CAST(p_partkey * 104729 % 1013 AS DOUBLE) AS y FROM part), c AS (SELECT id, x * 30 AS e0, (x + 60 + 2 * (id % 3)) * 30 AS e1, (y - 2 * (id % 2)) * 30 AS n0, (y + 10 - id % 2) * 30 AS m, (y + 50 - 2 * (id % 2)) * 30 AS n1, y * 30 AS y30 FROM f)
    SELECT DISTINCT g.e || '-' || h.n AS block FROM c, LATERAL (SELECT unnest(range(CAST(floor(e0 / 8000) AS BIGINT), CAST(floor(e1 / 8000) AS BIGINT) + 1)) AS e) g, LATERAL (SELECT unnest(range(CAST(floor(least(y30, n1, m) / 8000) AS BIGINT), CAST(floor(greatest(y30, n1, m) / 8000) AS BIGINT) + 1)) AS n) h""")
def block_index(spark, sf):
    wide = b.ways(spark, sf).withColumn("pts", F.transform("pts", lambda q: F.struct((q["e"] * 30).alias("e"), (q["n"] * 30).alias("n")))).withColumn("name", F.col("kind")).withColumn("kind", F.lit("street"))
    path = stage_path(spark, "blocks")
    sinks.write_blocks(blocks.write(etl.by_block(wide)), path, "tables", 8000)
    return spark.read.json(f"{path}/index.json").select(F.explode("blocks").alias("block"))


@query("""SELECT (SELECT count(*) FROM part WHERE p_partkey % 2 = 0) AS rings, (SELECT count(*) FROM part WHERE p_partkey % 2 = 1) AS unclosed""")
def chains_counted(spark, sf):
    """Two members a relation: of even ones they close, of odd ones they end 5 m apart."""
    k = F.col("p_partkey")

    def line(*at):
        return F.array(*[F.struct(F.lit(float(x)).alias("e"), (F.lit(float(y)) + off).alias("n")) for x, y, off in at])

    zero, gap = F.lit(0.0), F.when(k % 2 == 0, 0.25).otherwise(5.0)
    halves = F.array(line((0, 0, zero), (4, 0, zero), (4, 4, zero)), line((4, 4, zero), (0, 4, zero), (0, 0, gap)))
    members = b.table(spark, sf, "part").select(k.alias("relation"), F.posexplode(halves).alias("way", "pts")).withColumn("way", F.col("way").cast("long"))
    return ways.unclosed(ways.chains(members))


@query(f"WITH {SPOTS} SELECT id, (id % 360) AS bearing, id % 9 < 8 AS stays FROM spots")
def hand_drawn(spark, sf):
    """Lines on the grid in every whole direction, 8 in 9 short enough; the length is within what a degree's rounding leaves."""
    k = F.col("id")
    e, n = 350000 + k * 7919 % 1009 * 100.0, 5700000 + k * 104729 % 1013 * 100.0
    far = F.when(k % 9 < 8, F.lit(3900.0)).otherwise(F.lit(4100.0))
    a, z = to_wgs84(e, n), to_wgs84(e + F.sin(F.radians(k % 360)) * far, n + F.cos(F.radians(k % 360)) * far)
    drawn = _spots(spark, sf).select("id", a.alias("a"), z.alias("z"))
    at = [F.col("a.lat"), F.col("a.lon"), F.col("z.lat"), F.col("z.lon")]
    return drawn.select("id", maps.span_between(*at)["bearing"].cast("long").alias("bearing"), maps.far_end_stays(*at).alias("stays"))


@query(f"WITH {SPOTS} SELECT id, true AS holds, true AS tight FROM spots")
def grid_boxes(spark, sf):
    """Boxes in degrees on the grid hold all four corners, and each side goes through one of them."""
    lat, lon = F.col("lat"), F.col("lon")
    box = maps.utm_box(lat, lon, lat + 0.25, lon + 0.5)
    at = _spots(spark, sf).select("id", box.alias("b"), F.array(*[to_utm(y, x) for y in (lat, lat + 0.25) for x in (lon, lon + 0.5)]).alias("c"))
    inside = F.forall("c", lambda q: q["e"].between(F.col("b.min_e"), F.col("b.max_e")) & q["n"].between(F.col("b.min_n"), F.col("b.max_n")))
    tight = F.lit(True)
    for side, f in (("min", "e"), ("min", "n"), ("max", "e"), ("max", "n")):
        tight = tight & F.array_contains(F.col(f"c.{f}"), F.col(f"b.{side}_{f}"))
    return at.select("id", inside.alias("holds"), tight.alias("tight"))
