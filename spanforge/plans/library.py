"""Queries over the library's readers, sinks, regions and covers: what they write is read back and held against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.functions import scalars as fn
from spanforge.operators import cover, dataset, openness, profile, raster, regions, ways
from spanforge.plans import bindings as b
from spanforge.plans import etl
from spanforge.plans.queries import LOW, RINGS, _rings, _terrain, query
from spanforge.runtime import stage_path
from spanforge.sources import blocks, readers, sinks



def _path(spark, name: str) -> str:
    return stage_path(spark, name)


# files ---------------------------------------------------------------------------------------------


@query(f"WITH {b.LINES} SELECT id, kind, length, score FROM lines")
def lines_published(spark, sf):
    path = _path(spark, "published")
    sinks.write_lines(b.lines(spark, sf).select("id", "kind", "ae", "an", "be", "bn", "length", "score"), path)
    return sinks.read_lines(spark, path).select("id", "kind", "length", "score")


@query(f"WITH {b.LINES} SELECT id, kind, score, length, exposure FROM lines")
def columns_published(spark, sf):
    path = _path(spark, "columns")
    sinks.write_columns(b.lines(spark, sf).select("id", "kind", "score", "length", "exposure"), path)
    return spark.read.parquet(path)


@query(f"WITH {b.LINES} SELECT kind, id * 2 + k AS id, CASE k WHEN 0 THEN ae ELSE be END AS e, score FROM lines, (VALUES (0), (1)) AS v(k)")
def spots_published(spark, sf):
    path = _path(spark, "spots")
    sinks.write_spots(dataset.endpoints(b.lines(spark, sf)), path)
    return spark.read.json(path).select("kind", "id", "e", "score")


@query(f"WITH {b.LINES} SELECT region, id, score FROM lines WHERE region IN (1, 4)")
def region_table(spark, sf):
    """Every region written by itself, one of them twice; two of them read back."""
    path = _path(spark, "regions")
    rows = b.lines(spark, sf).select("region", "id", "score")
    for k in (1, 4, 6, 1):
        regions.write_region(rows.where(F.col("region") == k), path, f"r{k}")
    return regions.read_regions(spark, path, ["r1", "r4"]).select("region", "id", "score")


FEATURES = """SELECT p_partkey AS id, s AS k, floor((CAST(p_partkey * 7919 % 1009 AS DOUBLE) + [0, 40, 60][s + 1] + s * (p_partkey % 3)) * 10 + 0.5) / 10 AS e, floor((CAST(p_partkey * 104729 % 1013 AS DOUBLE) + [0, 10, 50][s + 1] - s * (p_partkey % 2)) * 10 + 0.5) / 10 AS n,
    1.0::DOUBLE + p_partkey % 5 AS half, p_partkey % 10 = 0 AS bridge FROM part, (VALUES (0), (1), (2)) AS v(s)"""


@query(f"SELECT id, CAST(k AS INT) AS k, e, n, half, bridge FROM ({FEATURES})")
def block_files(spark, sf):
    """Features written as block files and read back, each once."""
    kinds = F.get(F.array(*[F.lit(k) for k in ("path", "cycle", "street", "road")]), (F.col("id") % 4).cast("int"))
    found = b.ways(spark, sf).select("id", kinds.alias("kind"), F.col("kind").alias("name"), "half", "bridge", "pts")
    packed = blocks.write(etl.by_block(found))
    back = blocks.read(packed.select(F.concat(F.lit("/x/"), "block", F.lit(".bin")).alias("path"), "content"))
    once = ways.first_of_id(back)
    return once.select("id", "half", "bridge", F.posexplode("pts").alias("k", "p")).select("id", "k", "p.e", "p.n", "half", "bridge")


@query("""SELECT p_partkey AS id, CAST(p_partkey % 100 AS DOUBLE) AS x0, CAST(p_partkey % 100 + p_size AS DOUBLE) AS x2, CAST(p_size % 7 AS DOUBLE) AS z FROM part WHERE p_partkey % 3 <> 0""")
def level_faces(spark, sf):
    """Coordinate lists of city models: a third of them are tilted and no level face."""
    k, w = F.col("p_partkey"), F.col("p_size")
    z = (w % 7).cast("string")
    x0, x2 = (k % 100).cast("string"), (k % 100 + w).cast("string")
    tilted = F.when(k % 3 == 0, F.lit("99")).otherwise(z)
    body = F.concat_ws(" ", x0, F.lit("0"), z, x2, F.lit("0"), z, x2, F.lit("5\n"), z, x0, F.lit("5"), tilted)
    texts = b.table(spark, sf, "part").select(k.alias("id"), F.concat(F.lit("<gml:posList srsDimension='3'> "), body, F.lit(" </gml:posList><gml:posList>1 2 3</gml:posList>")).alias("gml"))
    return readers.level_faces(texts).select("id", F.get("ring", F.lit(0))["e"].alias("x0"), F.get("ring", F.lit(2))["e"].alias("x2"), "z")


@query("""SELECT event_id % 500 AS k, arg_min(CAST(floor(value) AS DOUBLE), user_id * 1000000 + event_id) AS z, min(user_id * 1000000 + event_id) AS priority FROM events WHERE event_id % 3 <> 0 GROUP BY 1""")
def preferred_source(spark, sf):
    windows = b.table(spark, sf, "events").select((F.col("event_id") % 500).alias("k"), (F.col("user_id") * 1000000 + F.col("event_id")).alias("priority"), F.when(F.col("event_id") % 3 != 0, F.floor("value").cast("double")).alias("z"))
    return readers.prefer(windows, ["k"])


@query(f"WITH {b.CELLS}, {b.ROOFS} SELECT c.cx, c.cy, c.z AS ground, coalesce(r.z, c.z) AS surface, r.z IS NOT NULL AS known FROM cells c LEFT JOIN roofs r ON c.cx = r.cx AND c.cy = r.cy")
def surface_or_ground(spark, sf):
    return readers.with_surface(b.cells(spark, sf), b.roofs(spark, sf))


@query(f"""WITH {b.SPANS} SELECT DISTINCT g.x AS we, h.y AS wn FROM spans,
    LATERAL (SELECT unnest(range(CAST(floor((least(ae, be) - 30) / 64) AS BIGINT), CAST(floor((greatest(ae, be) + 30) / 64) AS BIGINT) + 1)) AS x) g,
    LATERAL (SELECT unnest(range(CAST(ceil((least(an, bn) - 30) / 64) AS BIGINT), CAST(ceil((greatest(an, bn) + 30) / 64) AS BIGINT) + 1)) AS y) h""")
def corridor_windows(spark, sf):
    return readers.windows_for(b.spans(spark, sf), 30.0, 64.0)


# regions -------------------------------------------------------------------------------------------

BOXES = f"""{b.LINES}, boxes AS (SELECT least(ae, be) * 10 AS min_e, greatest(ae, be) * 10 AS max_e, least(an, bn) * 10 AS min_n, greatest(an, bn) * 10 AS max_n FROM lines)"""
CHUNKS = f"""{BOXES}, chunks AS (SELECT DISTINCT g.x AS ce, h.y AS cn FROM boxes, LATERAL (SELECT unnest(range(CAST(floor(min_e / 8000) AS BIGINT), CAST(floor(max_e / 8000) AS BIGINT) + 1)) AS x) g, LATERAL (SELECT unnest(range(CAST(floor(min_n / 8000) AS BIGINT), CAST(floor(max_n / 8000) AS BIGINT) + 1)) AS y) h)"""


@query(
    f"""WITH {CHUNKS} SELECT ce, cn, ce * 8000.0::DOUBLE AS own_min_e, cn * 8000.0::DOUBLE AS own_min_n, (ce + 1) * 8000.0::DOUBLE AS own_max_e, (cn + 1) * 8000.0::DOUBLE AS own_max_n,
    ce * 8000.0::DOUBLE - 1000 AS load_min_e, cn * 8000.0::DOUBLE - 1000 AS load_min_n, (ce + 1) * 8000.0::DOUBLE + 1000 AS load_max_e, (cn + 1) * 8000.0::DOUBLE + 1000 AS load_max_n FROM chunks"""
)
def chunk_loads(spark, sf):
    at = b.lines(spark, sf).select(*[(f(f"a{c}", f"b{c}") * 10).alias(f"{m}_{c}") for c in "en" for m, f in (("min", F.least), ("max", F.greatest))])
    return regions.chunk_boxes(regions.chunks_over(at))


@query("""SELECT o_orderkey AS region_id FROM orders WHERE o_orderdate < DATE '1998-04-25' OR o_orderkey IN (3, 5)""")
def stale_regions(spark, sf):
    held = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("region_id"), F.col("o_orderdate").cast("timestamp").alias("generated_at"))
    return regions.stale(held, "1998-04-25", [3, 5]).select("region_id")


@query("SELECT c_custkey AS region_id, CAST(NULL AS DOUBLE) AS score FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def missing_regions(spark, sf):
    held = b.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("region_id"))
    return sinks.missing_regions(b.table(spark, sf, "customer").select(F.col("c_custkey").alias("region_id")), held, {"score": "double"})


@query(f"WITH {b.LINES} SELECT count(*) = 0 AS off_map FROM lines WHERE least(an, bn) < 4500 AND greatest(an, bn) > 4400 AND least(ae, be) < 300 AND greatest(ae, be) > 200")
def off_map(spark, sf):
    areas = b.lines(spark, sf).select(F.least("an", "bn").alias("south"), F.greatest("an", "bn").alias("north"), F.least("ae", "be").alias("west"), F.greatest("ae", "be").alias("east"))
    return dataset.off_map((4400.0, 200.0, 4500.0, 300.0), areas)


@query(f"WITH {LOW} SELECT cx // 2 AS lat, cy // 2 AS lon, max(z - low) AS drop FROM low GROUP BY 1, 2")
def drop_mask(spark, sf):
    drops = raster.drop_field(b.cells(spark, sf), 2)
    return sinks.mask(drops.select(F.floor(F.col("cx") / 2).alias("lat"), F.floor(F.col("cy") / 2).alias("lon"), "drop"))


# cover ---------------------------------------------------------------------------------------------


@query(
    f"""WITH {RINGS}, pts AS (SELECT c_custkey AS id, CAST(c_custkey * 7919 % 230 AS DOUBLE) + 0.5::DOUBLE AS x, CAST(c_custkey * 104729 % 215 AS DOUBLE) + 0.5::DOUBLE AS y FROM customer),
    hits AS (SELECT p.id, e.id AS ring, e.kind, count(*) % 2 = 1 AS hit FROM pts p JOIN edges e ON (e.y1 > p.y) <> (e.y0 > p.y) AND p.x < e.x1 + (p.y - e.y1) / (e.y0 - e.y1) * (e.x0 - e.x1) GROUP BY 1, 2, 3),
    met AS (SELECT id, bool_or(kind = 'water' AND ring % 3 <> 0) AS water, bool_or(kind = 'island') AS island, bool_or(kind = 'water' AND ring % 3 = 0) AS building FROM hits WHERE hit GROUP BY id)
    SELECT pts.id, CASE WHEN building THEN 'building' WHEN water AND NOT island THEN 'water' ELSE 'none' END AS cover FROM pts LEFT JOIN met USING (id)"""
)
def points_covered(spark, sf):
    k = F.col("c_custkey")
    points = b.table(spark, sf, "customer").select(k.alias("id"), ((k * 7919 % 230).cast("double") + 0.5).alias("e"), ((k * 104729 % 215).cast("double") + 0.5).alias("n"))
    rings = _rings(spark, sf).withColumn("kind", F.when((F.col("kind") == "water") & (F.col("id") % 3 == 0), "building").otherwise(F.col("kind")))
    return cover.cover(points, rings, ["id"], 25.0).select("id", "cover")


@query(
    """WITH held AS (SELECT o_custkey AS id, o_orderkey AS block FROM orders WHERE o_orderpriority = '1-URGENT'), wanted AS (SELECT c_custkey AS id, c_custkey // 4 AS part FROM customer)
    SELECT id, block FROM wanted JOIN held USING (id) WHERE part NOT IN (SELECT part FROM wanted WHERE id NOT IN (SELECT id FROM held))"""
)
def held_if_complete(spark, sf):
    """Urgent orders of four customers at a time: one without any leaves the four unknown."""
    wanted = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.floor(F.col("c_custkey") / 4).alias("part"))
    held = b.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("block"))
    return cover.held_if_complete(wanted, held, "id", "part").select("id", "block")


@query(
    f"""WITH {b.CELLS}, {b.POINTS}, steps AS (SELECT i, j FROM (SELECT unnest(range(-3, 4)) AS i) a, (SELECT unnest(range(-3, 4)) AS j) c WHERE i * i + j * j <= 9),
    seen AS (SELECT p.id, count(z) AS seen, min(z) AS low, max(z) AS high, count(*) FILTER (z % 3 = 0) AS wooded, count(*) FILTER (z % 3 = 1) AS roofed FROM points p, steps s LEFT JOIN cells c ON c.cx = CAST(floor(p.e / 16) AS BIGINT) + s.i AND c.cy = CAST(floor(p.n / 16) AS BIGINT) + s.j GROUP BY p.id)
    SELECT id, CASE WHEN seen >= 0.75 * 29 THEN high - low END AS relief, CASE WHEN seen >= 0.75 * 29 THEN high END AS top, CASE WHEN seen >= 0.75 * 29 THEN wooded / CAST(seen AS DOUBLE) END AS canopy, CASE WHEN seen >= 0.75 * 29 THEN roofed / CAST(seen AS DOUBLE) END AS building FROM seen"""
)
def relief_around(spark, sf):
    cells = b.cells(spark, sf).withColumn("cover", F.when(F.col("z") % 3 == 0, "canopy").when(F.col("z") % 3 == 1, "building").otherwise("none"))
    return cover.around(b.points(spark, sf), cells, "id", 48.0, 16.0)


@query("SELECT o_orderkey AS id, max(floor(o_totalprice) + (o_custkey - floor(o_totalprice)) * (l_linenumber / 8.0::DOUBLE) - l_quantity) AS drop FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def relief_to_chord(spark, sf):
    spans = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.floor("o_totalprice").cast("double").alias("z0"), F.col("o_custkey").cast("double").alias("z1"))
    stations = b.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") / F.lit(8.0)).alias("t"), F.col("l_quantity").cast("double").alias("z"))
    return cover.relief_to_chord(spans, stations)


@query("""WITH c AS (SELECT c_custkey AS key, c_custkey % 97 AS bytes, c_custkey * 31 % 1000 AS used_at FROM customer), r AS (SELECT *, sum(bytes) OVER (ORDER BY used_at DESC, key ROWS UNBOUNDED PRECEDING) AS upto, sum(bytes) OVER () AS total FROM c)
    SELECT key FROM r WHERE total > 20000 AND upto > 16000""")
def cache_evicted(spark, sf):
    k = F.col("c_custkey")
    held = b.table(spark, sf, "customer").select(k.alias("key"), (k % 97).alias("bytes"), (k * 31 % 1000).alias("used_at"))
    return cover.evicted(held, 20_000).select("key")


# profiles and scalars ------------------------------------------------------------------------------


@query("""SELECT vec_id AS id, vec_id % 7 = 0 AS no_band, vec_id % 3 <> 0 AS no_needs FROM embeddings""")
def profile_packed(spark, sf):
    """Every seventh band is its own centre line, and two in three owe the ordinary clearance everywhere."""
    k = F.col("id")
    whole = b.profiles(spark, sf).withColumn("ground_max", F.transform("ground", lambda g: g + (k % 7).cast("double"))).withColumn("needed", F.transform("ground", lambda g, i: F.when((k % 3 == 0) & (i == 5), F.lit(1.0)).otherwise(F.lit(3.0))))
    return profile.pack(whole).select("id", F.col("ground_max").isNull().alias("no_band"), F.col("needed").isNull().alias("no_needs"))


@query(
    """WITH p AS (SELECT vec_id AS id, CAST(i - 1 AS INT) AS i, (i - 1) / 63.0::DOUBLE AS t, floor(CAST(embedding[i] AS DOUBLE) * 1000) / 100.0::DOUBLE - vec_id % 30 AS ground, CAST(vec_id % 400 + 60 AS DOUBLE) AS length, vec_id % 7 AS up, vec_id % 5 AS h_b FROM embeddings, LATERAL (SELECT unnest(range(1, 65)) AS i) u)
    SELECT id, i, ground, ground + up AS surface, ground AS ground_max, ground + up AS surface_max, floor(t * length * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS d, floor((2.0::DOUBLE + (h_b - 2.0::DOUBLE) * t - 0.05::DOUBLE * length * 4.0::DOUBLE * t * (1.0::DOUBLE - t)) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS line,
    floor(t * 4.0::DOUBLE * (1.0::DOUBLE - t) * 0.04::DOUBLE * length * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS half_width, 3.0::DOUBLE AS needed FROM p"""
)
def profile_unpacked(spark, sf):
    return profile.unpack(profile.pack(b.profiles(spark, sf)), 0.05)


@query(f"WITH {b.POINTS} SELECT id, CASE id % 5 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 6.0::DOUBLE WHEN 2 THEN 11.0::DOUBLE WHEN 3 THEN 15.0::DOUBLE ELSE 23.0::DOUBLE END AS owed, lo + (hi - lo) * (id % 9 / 8.0::DOUBLE) AS at FROM points")
def clearance_owed(spark, sf):
    tier = F.get(F.array(*[F.lit(t) for t in ("path", "cycle", "street", "road", "highway")]), (F.col("id") % 5).cast("int"))
    between = fn.series_at(F.array("lo", "hi"), F.col("id") % 9 / F.lit(8.0))
    return b.points(spark, sf).select("id", fn.required_over(tier).alias("owed"), between.alias("at"))


@query(f"WITH {b.POINTS} SELECT id, e * 100 + 350000 AS e, n * 100 + 5700000 AS n FROM points")
def there_and_back(spark, sf):
    """To longitude and latitude and back, to the centimetre."""
    grid = b.points(spark, sf).select("id", fn.to_wgs84(F.col("e") * 100 + 350000, F.col("n") * 100 + 5700000).alias("p"))
    back = grid.select("id", fn.to_utm(F.col("p.lat"), F.col("p.lon")).alias("u"))
    return back.select("id", fn.half_up("u.e", 2).alias("e"), fn.half_up("u.n", 2).alias("n"))


@query(f"WITH {b.LINES}, s AS (SELECT id, ae, an, be, bn FROM lines) SELECT id, (ae >= 1000 AND ae <= 2000 AND an >= 500 AND an <= 1500) OR id % 2 = 0 AS kept FROM s")
def anchors_off_roofs(spark, sf):
    """Anchors on roofs (odd ids) stay inside the urban box only."""
    anchors = b.lines(spark, sf).select("id", F.col("id").cast("double").alias("e"), F.lit(0.0).alias("n"), "ae", "an")
    on = anchors.select(F.col("id").alias("cx"), F.lit(0).cast("long").alias("cy")).where("cx % 2 = 1")
    # each anchor has a cell of its own; the box is asked of its real place
    inside = anchors.where("ae between 1000 and 2000 and an between 500 and 1500")
    kept = openness.in_urban_or_open(anchors.join(inside.select("id"), "id", "left_anti"), on, [])[0].unionByName(openness.in_urban_or_open(inside, on, [(-1.0, -1.0, 1e12, 1.0)])[0])
    return anchors.select("id").join(kept.select("id", F.lit(True).alias("kept")), "id", "left").select("id", F.coalesce("kept", F.lit(False)).alias("kept"))


# search: no form in SQL, held against plain code in the tests ---------------------------------------------


@query()
def crossing_heights(spark, sf):
    """Ways under spans with the height at which they run, from the ground, and from the roofs for bridges."""
    return ways.crossings(b.spans(spark, sf), b.ways(spark, sf), ground=_terrain(spark, sf), surface=_terrain(spark, sf).withColumn("z", F.col("z") + 5))
