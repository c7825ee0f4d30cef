"""A query for each operator over the driver's tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import scalars as fn
from spanforge.operators import dataset, openness, pairs, profile, raster, search, select, series, ways
from spanforge.params import DEFAULTS
from spanforge.plans import bindings as b

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# raster ------------------------------------------------------------------------------------------

LOW = f"""{b.CELLS}, low AS (SELECT c.cx, c.cy, any_value(c.z) AS z, min(o.z) AS low FROM cells c JOIN cells o ON o.cx BETWEEN c.cx - 2 AND c.cx + 2 AND o.cy BETWEEN c.cy - 2 AND c.cy + 2 GROUP BY c.cx, c.cy)"""


@query(f"WITH {b.CELLS} SELECT * FROM cells")
def raster_blit_max(spark, sf):
    return b.cells(spark, sf)


@query(f"WITH {b.CELLS} SELECT min(z) AS z_min, max(z) AS z_max, count(z) AS n_valid, count(*) FILTER (z >= 40) AS n_high FROM cells")
def raster_extent(spark, sf):
    return raster.extent(b.cells(spark, sf), 40)


@query(f"WITH {LOW} SELECT * FROM low")
def raster_min_filter(spark, sf):
    return raster.min_filter(b.cells(spark, sf), 2)


@query(f"WITH {b.CELLS} SELECT c.cx, c.cy, any_value(c.z) AS z, min(o.z) AS low FROM cells c JOIN cells o ON o.cx BETWEEN c.cx - 12 AND c.cx + 12 AND o.cy BETWEEN c.cy - 12 AND c.cy + 12 GROUP BY c.cx, c.cy")
def raster_min_filter_wide(spark, sf):
    return raster.min_filter(b.cells(spark, sf), 12, 16)


@query(f"WITH {LOW} SELECT *, z - low AS drop FROM low")
def raster_drop_field(spark, sf):
    return raster.drop_field(b.cells(spark, sf), 2)


@query(f"WITH {b.CELLS} SELECT cx // 4 AS cx, cy // 4 AS cy, avg(z) AS z FROM cells GROUP BY 1, 2")
def raster_downsample(spark, sf):
    return raster.downsample(b.cells(spark, sf), 4)


@query(f"WITH {b.CELLS} SELECT cx, cy, CAST(least(32767, greatest(-32767, floor(z * 10 + 0.5))) AS SMALLINT) AS v FROM cells")
def raster_pack(spark, sf):
    return raster.pack(b.cells(spark, sf))


@query(f"WITH {b.CELLS} SELECT cx, cy, z FROM cells")
def raster_unpack(spark, sf):
    return raster.unpack(raster.pack(b.cells(spark, sf)))


@query(f"WITH {LOW} SELECT cx // 16 AS tx, cy // 16 AS ty, count(*) AS seen, count(*) FILTER (z - low >= 30.5) AS passed FROM low GROUP BY 1, 2")
def tile_passes(spark, sf):
    return raster.tile_passes(raster.drop_field(b.cells(spark, sf), 2), 16, 30.5)


@query(f"WITH {LOW}, t AS (SELECT cx // 16 AS tx, cy // 16 AS ty, count(*) AS seen, count(*) FILTER (z - low >= 30.5) AS passed FROM low GROUP BY 1, 2) SELECT *, passed >= 2.56 AS pass FROM t WHERE seen * 2 >= 256")
def tile_verdicts(spark, sf):
    return raster.tile_verdicts(raster.drop_field(b.cells(spark, sf), 2), 16, 30.5)


@query(
    f"""WITH {LOW}, high AS (SELECT cx, cy, cx // 16 AS tx, cy // 16 AS ty FROM low WHERE z - low >= 30.5),
    enough AS (SELECT tx, ty FROM high GROUP BY 1, 2 HAVING count(*) >= 2.56)
    SELECT DISTINCT g.x AS tx, h.y AS ty FROM (SELECT high.* FROM high JOIN enough USING (tx, ty)) p,
    LATERAL (SELECT unnest(range(CAST(floor((p.cx - 3) / 16.0) AS BIGINT), CAST(floor((p.cx + 3) / 16.0) AS BIGINT) + 1)) AS x) g,
    LATERAL (SELECT unnest(range(CAST(floor((p.cy - 3) / 16.0) AS BIGINT), CAST(floor((p.cy + 3) / 16.0) AS BIGINT) + 1)) AS y) h"""
)
def tiles_worth_loading(spark, sf):
    return raster.tiles_worth_loading(raster.drop_field(b.cells(spark, sf), 2), 16, 30.5, 3)


@query(
    f"""WITH {b.CELLS}, {b.ROOFS}, ground AS (SELECT cx // 8 AS tx, cy // 8 AS ty, min(z) AS low FROM cells GROUP BY 1, 2),
    hit AS (SELECT DISTINCT g.tx, g.ty FROM (SELECT cx // 8 AS tx, cy // 8 AS ty, z FROM roofs) r JOIN ground g USING (tx, ty) WHERE r.z >= g.low + 25)
    SELECT DISTINCT tx + i AS tx, ty + j AS ty FROM hit, (VALUES (-1), (0), (1)) AS a(i), (VALUES (-1), (0), (1)) AS c(j)"""
)
def roof_tiles(spark, sf):
    roofs = b.roofs(spark, sf).select(F.floor(F.col("cx") / 8).alias("tx"), F.floor(F.col("cy") / 8).alias("ty"), "z")
    return raster.roof_tiles(roofs, b.cells(spark, sf), 8)


@query(
    f"""WITH {b.CELLS}, {b.ROOFS}, held AS (SELECT * FROM cells WHERE cx % 48 < 40), loaded AS (SELECT DISTINCT cx // 16 AS tx, cy // 16 AS ty FROM held), on_ AS (SELECT r.* FROM roofs r SEMI JOIN loaded l ON l.tx = r.cx // 16 AND l.ty = r.cy // 16)
    SELECT coalesce(c.cx, r.cx) AS cx, coalesce(c.cy, r.cy) AS cy, greatest(c.z, r.z) AS z, r.z IS NOT NULL AS roof FROM held c FULL JOIN on_ r ON c.cx = r.cx AND c.cy = r.cy"""
)
def raise_onto_buildings(spark, sf):
    """Ground with gaps between its loaded stretches: a roof over what was not loaded is left out."""
    return raster.raise_onto(b.cells(spark, sf).where("cx % 48 < 40"), b.roofs(spark, sf), tile=16)


@query(f"WITH {b.CELLS}, {b.POINTS} SELECT p.id, c.z FROM points p LEFT JOIN cells c ON c.cx = floor(p.e / 16) AND c.cy = floor(p.n / 16)")
def sample_nearest(spark, sf):
    return raster.nearest(b.points(spark, sf), b.cells(spark, sf), res=16.0).select("id", "z")


@query(
    f"""WITH {b.CELLS}, {b.POINTS}, spot AS (SELECT id, floor(e / 16 - 0.5) AS x0, floor(n / 16 - 0.5) AS y0, e / 16 - 0.5 - floor(e / 16 - 0.5) AS fx, n / 16 - 0.5 - floor(n / 16 - 0.5) AS fy, floor(e / 16) AS ox, floor(n / 16) AS oy FROM points)
    SELECT id, floor(CASE WHEN a.z IS NULL OR b.z IS NULL OR c.z IS NULL OR d.z IS NULL THEN o.z
        ELSE a.z * (1 - fx) * (1 - fy) + b.z * fx * (1 - fy) + c.z * (1 - fx) * fy + d.z * fx * fy END * 1024 + 0.5) AS z FROM spot
    LEFT JOIN cells a ON a.cx = x0 AND a.cy = y0 LEFT JOIN cells b ON b.cx = x0 + 1 AND b.cy = y0 LEFT JOIN cells c ON c.cx = x0 AND c.cy = y0 + 1
    LEFT JOIN cells d ON d.cx = x0 + 1 AND d.cy = y0 + 1 LEFT JOIN cells o ON o.cx = ox AND o.cy = oy"""
)
def sample_bilinear(spark, sf):
    got = raster.bilinear(b.points(spark, sf), b.cells(spark, sf), "id", res=16.0)
    return got.select("id", F.floor(F.col("z") * 1024 + 0.5).cast("double").alias("z"))


@query(
    f"""WITH {b.CELLS}, {b.POINTS}, discs AS (SELECT id, e, n, i * 16.0::DOUBLE - 40 AS dn FROM points, (VALUES (0), (1), (2), (3), (4), (5)) AS v(i) WHERE i <= 5),
    rims AS (SELECT id, e, n, dn, sqrt(1600 - dn * dn) AS half FROM discs),
    spots AS (SELECT DISTINCT id, floor((e + k * 16 - half) / 16) AS cx, floor((n + dn) / 16) AS cy FROM rims, LATERAL (SELECT unnest(range(0, CAST(floor(half * 2 / 16) AS BIGINT) + 1)) AS k) g)
    SELECT id, min(z) AS lowest FROM spots JOIN cells USING (cx, cy) GROUP BY id"""
)
def disc_minimum(spark, sf):
    return raster.disc_min(b.points(spark, sf), b.cells(spark, sf), "id", 40.0, 16.0)


# pairs -------------------------------------------------------------------------------------------

PAIRED = f"""{b.POINTS}, pairs AS (SELECT a.id AS i, b.id AS j, (b.e - a.e) * (b.e - a.e) + (b.n - a.n) * (b.n - a.n) AS d2, a.e AS a_e, a.n AS a_n, b.e AS b_e, b.n AS b_n, a.open AS a_open, b.open AS b_open,
    a.lo AS a_lo, a.hi AS a_hi, b.lo AS b_lo, b.hi AS b_hi FROM points a JOIN points b ON a.id < b.id AND (b.e - a.e) * (b.e - a.e) + (b.n - a.n) * (b.n - a.n) BETWEEN 2500 AND 10000)"""
TO_B = "CASE WHEN atan2(b_e - a_e, b_n - a_n) < 0 THEN atan2(b_e - a_e, b_n - a_n) + 2 * pi() ELSE atan2(b_e - a_e, b_n - a_n) END"
FACING = f"""{PAIRED}, turned AS (SELECT *, {TO_B} AS w FROM pairs), faced AS (SELECT *, (a_open >> CAST(floor(w / (2 * pi()) * 64) % 64 AS INT)) & 1 = 1 AND
    (b_open >> CAST(floor(((w + pi()) % (2 * pi())) / (2 * pi()) * 64) % 64 AS INT)) & 1 = 1 AS facing, CASE WHEN greatest(a_lo, b_lo) <= least(a_hi, b_hi) THEN 0.0::DOUBLE WHEN a_lo > b_hi THEN a_lo - b_hi ELSE b_lo - a_hi END AS gap FROM turned)"""


@query(f"WITH {PAIRED} SELECT i, j, d2 FROM pairs")
def pair_band_join(spark, sf):
    return pairs.band_join(b.points(spark, sf), 50, 100).select("i", "j", "d2")


@query(f"WITH {FACING} SELECT i, j, d2 FROM faced WHERE facing")
def pair_sector_gate(spark, sf):
    return pairs.band_join(b.points(spark, sf), 50, 100, gates=True).select("i", "j", "d2")


@query(f"""WITH {PAIRED} SELECT i, j FROM pairs WHERE CASE WHEN a_n < b_n OR a_n = b_n AND a_e <= b_e THEN a_e >= 200 AND a_e < 700 AND a_n >= 100 AND a_n < 600 ELSE b_e >= 200 AND b_e < 700 AND b_n >= 100 AND b_n < 600 END""")
def pair_ownership(spark, sf):
    box = (200, 100, 700, 600)
    return pairs.owned(pairs.band_join(pairs.within_reach(b.points(spark, sf), box, 100), 50, 100), box).select("i", "j")


@query(f"WITH {FACING} SELECT count(*) AS in_range, count(*) FILTER (facing) AS facing, count(*) FILTER (facing AND gap <= sqrt(d2) * 0.03::DOUBLE) AS level FROM faced")
def pair_funnel(spark, sf):
    return pairs.funnel(pairs.band_join(b.points(spark, sf), 50, 100, ["open", "lo", "hi"]))


@query(
    f"""WITH {FACING} SELECT i, j, CASE WHEN gap = 0 THEN least(a_hi, b_hi) WHEN a_lo > b_hi THEN a_lo ELSE a_hi END AS h_a, CASE WHEN gap = 0 THEN least(a_hi, b_hi) WHEN a_lo > b_hi THEN b_hi ELSE b_lo END AS h_b, gap AS off_level
    FROM faced WHERE gap <= sqrt(d2) * 0.03::DOUBLE"""
)
def choose_heights(spark, sf):
    return pairs.levelled(pairs.band_join(b.points(spark, sf), 50, 100, ["lo", "hi"])).select("i", "j", "h_a", "h_b", "off_level")


@query(f"""WITH {b.POINTS} SELECT id, CASE WHEN id % 4 = 0 THEN 'urban' ELSE 'natural' END AS kind, CASE WHEN lo <= 0 THEN 'edge' WHEN lo <= CASE WHEN id % 4 = 0 THEN 0 ELSE 1.5 END THEN 'aFrame' WHEN lo <= id % 23 * 0.5 THEN 'trunk' WHEN lo <= id % 23 THEN 'crown' ELSE 'brought' END AS means,
    greatest(0, least(lo, greatest(CASE WHEN id % 4 = 0 THEN 0 ELSE 1.5 END, id % 23 * 0.5)) - CASE WHEN id % 4 = 0 THEN 0 ELSE 1.5 END)::DOUBLE * 0.4::DOUBLE
    + greatest(0, least(lo, greatest(CASE WHEN id % 4 = 0 THEN 0 ELSE 1.5 END, id % 23)) - greatest(CASE WHEN id % 4 = 0 THEN 0 ELSE 1.5 END, id % 23 * 0.5))::DOUBLE * 2.0::DOUBLE
    + greatest(0, lo - greatest(CASE WHEN id % 4 = 0 THEN 0 ELSE 1.5 END, id % 23))::DOUBLE * 6.0::DOUBLE AS cost FROM points""")
def rigging(spark, sf):
    roof, canopy = F.col("id") % 4 == 0, (F.col("id") % 23).cast("double")
    return b.points(spark, sf).select("id", fn.line_kind(roof, F.lit(False)).alias("kind"), fn.rig_means(F.col("lo"), roof, canopy).alias("means"), fn.rig_cost(F.col("lo"), roof, canopy).alias("cost"))


# profiles ----------------------------------------------------------------------------------------

AT = """prof AS (SELECT vec_id AS id, i - 1 AS i, (i - 1) / 63.0::DOUBLE AS t, floor(CAST(embedding[i] AS DOUBLE) * 1000) / 100.0::DOUBLE - vec_id % 30 AS g, floor(CAST(embedding[i] AS DOUBLE) * 1000) / 100.0::DOUBLE - vec_id % 30 + vec_id % 7 AS top,
    CAST(vec_id % 400 + 60 AS DOUBLE) AS length, 2.0::DOUBLE AS h_a, CAST(vec_id % 5 AS DOUBLE) AS h_b, CAST(abs(2 - vec_id % 5) AS DOUBLE) AS off_level FROM embeddings, LATERAL (SELECT unnest(range(1, 65)) AS i) u),
sagged AS (SELECT *, floor((h_a + (h_b - h_a) * t - 0.05::DOUBLE * length * 4.0::DOUBLE * t * (1.0::DOUBLE - t)) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS line, floor(t * length * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS d FROM prof),
marked AS (SELECT *, d < 10 OR d > length - 10 AS zone FROM sagged),
met AS (SELECT id, any_value(length) AS length, any_value(off_level) AS off_level, max(line - g) AS exposure, min(line - g) FILTER (NOT zone) AS clearance_min, min(line - g - 3.0::DOUBLE) FILTER (NOT zone) AS margin,
    arg_min(d, (line - g - 3.0::DOUBLE, i)) FILTER (NOT zone) AS margin_at, min(line - top) FILTER (NOT zone) AS canopy_min, count(*) FILTER (NOT zone AND line - top < 0) / CAST(count(*) FILTER (NOT zone) AS DOUBLE) AS blocked, count(*) FILTER (NOT zone) AS samples FROM marked GROUP BY id)"""


@query(f"WITH {AT} SELECT id, exposure, clearance_min, margin, margin_at, canopy_min, blocked, samples FROM met")
def profile_metrics(spark, sf):
    return profile.metrics(b.profiles(spark, sf)).select("id", "exposure", "clearance_min", "margin", "margin_at", "canopy_min", "blocked", "samples")


@query(f"WITH {AT} SELECT CASE WHEN margin IS NULL THEN 'terrain' WHEN margin < 0 THEN 'clearance' WHEN exposure < 10 THEN 'exposure' WHEN blocked > 0.8::DOUBLE THEN 'canopy' ELSE 'none' END AS reject, count(*) AS n FROM met GROUP BY 1")
def reject_histogram(spark, sf):
    return profile.metrics(b.profiles(spark, sf)).groupBy(F.coalesce(profile.rejection(), F.lit("none")).alias("reject")).agg(F.count("*").alias("n"))


def _rated(sag: str, prof: str = AT) -> str:
    """Metrics, penalty and score of the stored profiles at a sag, from the definitions."""
    return prof.replace("0.05::DOUBLE * length * 4.0", f"{sag}::DOUBLE * length * 4.0") + """,
weighed AS (SELECT id, sum(CASE WHEN NOT zone THEN c END) AS w, sum(CASE WHEN NOT zone THEN c * greatest(0.0::DOUBLE, 3.0::DOUBLE - (line - g)) END) AS deficit, sum(CASE WHEN zone THEN c END) AS zw,
    sum(CASE WHEN zone THEN c * greatest(0.0::DOUBLE, -(line - g)) END) AS zdeficit FROM (SELECT *, least(d, length - d) / (length / 2) AS c FROM marked) GROUP BY id),
known AS (SELECT met.*, length * 0.03::DOUBLE AS budget, CASE WHEN w > 0 THEN deficit / w ELSE 0.0::DOUBLE END AS deficit, CASE WHEN zw > 0 THEN zdeficit / zw ELSE 0.0::DOUBLE END AS zone_deficit FROM met JOIN weighed USING (id)),
fined AS (SELECT *, CASE WHEN deficit > 0 THEN 40.0::DOUBLE * deficit / 3.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN 10 - exposure > 0 THEN 20.0::DOUBLE * (10 - exposure) / 10.0::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN blocked - 0.8::DOUBLE > 0 THEN 20.0::DOUBLE * (blocked - 0.8::DOUBLE) / 0.2::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN off_level - budget > 0 THEN 20.0::DOUBLE * (off_level - budget) / budget ELSE 0.0::DOUBLE END
    + CASE WHEN 50 - length > 0 THEN 20.0::DOUBLE * (50 - length) / 50.0::DOUBLE ELSE 0.0::DOUBLE END AS penalty FROM known),
rated AS (SELECT *, (least(1.0::DOUBLE, greatest(0.0::DOUBLE, log10(greatest(exposure, 1.0::DOUBLE) / 5) / log10(40.0::DOUBLE))) * 0.3::DOUBLE + least(1.0::DOUBLE, length / 500) * 0.15::DOUBLE + (1.0::DOUBLE - blocked) * 0.35::DOUBLE
    + least(1.0::DOUBLE, greatest(0.0::DOUBLE, margin / 10)) * least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1.0::DOUBLE - zone_deficit / 3.0::DOUBLE)) * 0.05::DOUBLE
    + least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1.0::DOUBLE - off_level / budget)) * 0.15::DOUBLE) * 100 - penalty AS score FROM fined)"""


def _round(x: str, digits: int) -> str:
    return f"floor({x} * {10.0**digits}::DOUBLE + 0.5::DOUBLE) / {10.0**digits}::DOUBLE"


@query(f"WITH {_rated('0.05')} SELECT id, {_round('score', 1)} AS score, {_round('penalty', 4)} AS penalty FROM rated")
def profile_scores(spark, sf):
    spans = b.profiles(spark, sf)
    measured = profile.metrics(spans).join(spans.select("id", "length", "off_level"), "id")
    return measured.select("id", fn.half_up(profile.score(), 1).alias("score"), fn.half_up(profile.penalty(), 4).alias("penalty"))


@query(f"WITH {_rated('0.08')} SELECT id, {_round('score', 1)} AS score, {_round('penalty', 4)} AS penalty, exposure, clearance_min, samples FROM rated")
def rescored_for_display(spark, sf):
    return profile.rescored(b.profiles(spark, sf), 0.08).select("id", fn.half_up("score", 1).alias("score"), fn.half_up("penalty", 4).alias("penalty"), "exposure", "clearance_min", "samples")


@query(
    f"""WITH {AT}, r AS (SELECT *, length * 0.03::DOUBLE AS budget FROM met)
    SELECT id, 'buried' AS rule, {_round('clearance_min', 2)} AS value, 3.0::DOUBLE AS "limit", margin_at AS at, 'ground' AS what FROM r WHERE margin < 0 AND clearance_min < 0
    UNION ALL SELECT id, 'clearance', {_round('(margin + 3.0::DOUBLE)', 2)}, 3.0::DOUBLE, margin_at, 'ground' FROM r WHERE margin < 0 AND clearance_min >= 0
    UNION ALL SELECT id, 'exposure', {_round('exposure', 2)}, 10.0::DOUBLE, NULL, NULL FROM r WHERE exposure < 10
    UNION ALL SELECT id, 'canopy', {_round('blocked', 2)}, 0.8::DOUBLE, NULL, NULL FROM r WHERE blocked > 0.8::DOUBLE
    UNION ALL SELECT id, 'offlevel', {_round('off_level', 2)}, {_round('budget', 2)}, NULL, NULL FROM r WHERE off_level > budget"""
)
def profile_violations(spark, sf):
    spans = b.profiles(spark, sf)
    measured = profile.metrics(spans).join(spans.select("id", "length", "off_level"), "id")
    return measured.select("id", F.explode(profile.violations()).alias("v")).select("id", "v.rule", fn.half_up(F.col("v.value"), 2).alias("value"), fn.half_up(F.col("v.limit"), 2).alias("limit"), "v.at", "v.what")


def _bisected(steps: int = 12) -> str:
    """The gates at both ends and at each middle, one after another."""
    prof, rest = AT.split("sagged AS", 1)
    gates = "margin IS NOT NULL AND margin >= 0 AND exposure >= 10 AND blocked <= 0.8::DOUBLE"

    def tried(k: str, state: str, sag: str) -> str:
        chain = "s_AS" + rest.replace("0.05::DOUBLE * length", "sag * length").replace("FROM prof)", f"FROM (SELECT prof.*, {sag} AS sag FROM prof JOIN {state} USING (id)))")
        chain = chain.removeprefix("s_AS").replace("FROM sagged", f"FROM sagged{k}").replace("marked AS", f"marked{k} AS").replace("FROM marked", f"FROM marked{k}").replace("met AS", f"met{k} AS MATERIALIZED")
        return f"sagged{k} AS{chain}"

    out = prof.replace("prof AS", "prof AS MATERIALIZED") + "t0 AS MATERIALIZED (SELECT DISTINCT id, 0.0::DOUBLE AS lo, 0.25::DOUBLE AS hi FROM prof), " + tried("a", "t0", "lo") + ", " + tried("b", "t0", "hi")
    for k in range(steps):
        out += f", {tried(str(k), f't{k}', '(lo + hi) / 2')}, t{k + 1} AS MATERIALIZED (SELECT t.id, CASE WHEN coalesce({gates}, false) THEN (lo + hi) / 2 ELSE lo END AS lo, CASE WHEN coalesce({gates}, false) THEN hi ELSE (lo + hi) / 2 END AS hi FROM t{k} t LEFT JOIN met{k} m USING (id))"
    ends = [f"coalesce((SELECT {gates} FROM met{x} m WHERE m.id = t.id), false)" for x in "ab"]
    return f"WITH {out} SELECT id, CASE WHEN NOT {ends[0]} THEN 0.0::DOUBLE WHEN {ends[1]} THEN 0.25::DOUBLE ELSE {_round('lo', 4)} END AS max_sag FROM t{steps} t"


@query(_bisected())
def max_feasible_sag(spark, sf):
    return profile.max_sag(b.profiles(spark, sf))


@query(
    f"""WITH {b.SPANS}, l AS (SELECT *, sqrt((be - ae) * (be - ae) + (bn - an) * (bn - an)) AS length FROM spans), c AS (SELECT *, least(120, greatest(8, CAST(floor(length / 2 + 0.5) AS BIGINT))) AS steps FROM l)
    SELECT id, CAST(i AS INT) AS i, floor((ae + (be - ae) * (CAST(i AS DOUBLE) / steps)) * 1024) AS e, floor((an + (bn - an) * (CAST(i AS DOUBLE) / steps)) * 1024) AS n FROM c, LATERAL (SELECT unnest(range(0, steps + 1)) AS i) u"""
)
def span_stations(spark, sf):
    return profile.stations(b.spans(spark, sf)).select("id", "i", F.floor(F.col("e") * 1024).cast("double").alias("e"), F.floor(F.col("n") * 1024).cast("double").alias("n"))


@query()
def span_profiles(spark, sf):
    return profile.gather(profile.band_max(profile.stations(b.spans(spark, sf)), _terrain(spark, sf))).select("id", F.size("ground").alias("n"), F.array_min("ground").alias("low"), F.array_max("ground_max").alias("high"))


def _terrain(spark, sf):
    """Cells of 1 m: each of the bound cells is a terrace of 16 m, as high as its value."""
    side = F.sequence(F.lit(0), F.lit(15))
    wide = b.terraces(spark, sf).withColumn("i", F.explode(side)).withColumn("j", F.explode(side))
    return wide.select((F.col("cx") * 16 + F.col("i")).alias("cx"), (F.col("cy") * 16 + F.col("j")).alias("cy"), "z")


@query()
def openness_scan(spark, sf):
    return openness.scan(_terrain(spark, sf))


@query()
def line_evaluation(spark, sf):
    measured = search.evaluate(b.spans(spark, sf), search.Scene(_terrain(spark, sf), ways=b.ways(spark, sf)))
    return measured.groupBy(F.coalesce("reject", F.lit("none")).alias("reject")).agg(F.count("*").alias("n"))


@query()
def planned_lines(spark, sf):
    return search.plan(b.spans(spark, sf), search.Scene(_terrain(spark, sf))).select("id", "length", fn.half_up(F.col("score"), 1).alias("score"), F.size("violations").alias("broken"))


# lines and spots ---------------------------------------------------------------------------------


@query(f"WITH {b.LINES} SELECT id, kind, score, length FROM lines WHERE max_sag + 1e-9::DOUBLE >= 0.05::DOUBLE AND score >= 50 AND length BETWEEN 80 AND 220 AND exposure >= 12 AND blocked * 100 <= 60 AND off_level_ratio * 100 <= 2.5 AND kind IN ('natural')")
def rescore_filter_sort(spark, sf):
    keep = dataset.line_filter(["natural"], 50, 80, 220, 12, 60, 2.5)
    return dataset.rescored(b.lines(spark, sf), 0.05).where(keep).select("id", "kind", "score", "length").orderBy(F.desc("score"), "id")


@query(f"WITH {b.LINES} SELECT id FROM lines")
def line_filter_defaults(spark, sf):
    return b.lines(spark, sf).where(dataset.line_filter()).select("id")


@query(f"WITH {b.LINES} SELECT id FROM lines WHERE greatest(ae, be) >= 1000 AND least(ae, be) <= 2000 AND greatest(an, bn) >= 1500 AND least(an, bn) <= 2500")
def viewport_filter(spark, sf):
    return b.lines(spark, sf).where(dataset.in_view((1000, 1500, 2000, 2500))).select("id")


@query(f"WITH {b.LINES} SELECT id, kind, score FROM lines ORDER BY score DESC, id LIMIT 100")
def region_topk(spark, sf):
    return dataset.top(b.lines(spark, sf), 100).select("id", "kind", "score")


@query(f"WITH {b.LINES} SELECT kind, count(*) AS n FROM lines GROUP BY kind")
def kind_counts(spark, sf):
    return b.lines(spark, sf).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH {b.LINES} SELECT CAST(ceil(greatest(max(length), 100)) AS BIGINT) AS max_length, CAST(ceil(greatest(max(exposure), 70)) AS BIGINT) AS max_exposure, CAST(ceil(greatest(max(score), 10)) AS BIGINT) AS max_score FROM lines")
def attribute_ranges(spark, sf):
    return dataset.ranges(b.lines(spark, sf), {"length": 100, "exposure": 70, "score": 10})


ENDS = f"""{b.LINES}, endpoints AS (SELECT id * 2 + k AS id, CASE k WHEN 0 THEN ae ELSE be END AS e, CASE k WHEN 0 THEN an ELSE bn END AS n, score, length, exposure, blocked, off_level_ratio FROM lines, (VALUES (0), (1)) AS v(k))"""


@query(f"WITH {ENDS} SELECT id, e, n, score FROM endpoints WHERE blocked <= 0.2::DOUBLE AND score >= 55")
def walkable_endpoints(spark, sf):
    return dataset.endpoints(b.lines(spark, sf)).where(dataset.walkable()).select("id", "e", "n", "score")


@query(f"WITH {ENDS} SELECT id FROM endpoints WHERE score >= 20 AND length >= 90 AND length <= 240 AND exposure >= 5 AND blocked <= 0.5::DOUBLE AND off_level_ratio <= 0.02::DOUBLE")
def spot_filter(spark, sf):
    return dataset.endpoints(b.lines(spark, sf)).where(dataset.spot_filter(20, 90, 240, 5, 0.5, 0.02)).select("id")


@query()
def dedup_greedy(spark, sf):
    return select.dedupe(b.lines(spark, sf), 60.0).select("id", "score")


@query()
def hotspots(spark, sf):
    spots = dataset.endpoints(b.lines(spark, sf)).where(dataset.walkable())
    return select.cluster(spots, 50.0)


@query()
def thin_crossings(spark, sf):
    return select.thin(b.lines(spark, sf), p=replace(DEFAULTS, max_crossings=3, keep_best=20)).select("id", "region", "score")


def _grid(spark, sf):
    """Lines moved to where the projection is meant, with parts of the score."""
    moved = b.lines(spark, sf).withColumns({c: F.col(c) + (350000.0 if c[1] == "e" else 5700000.0) for c in ("ae", "an", "be", "bn")})
    return moved.select("id", "kind", "score", "length", "ae", "an", "be", "bn", (F.col("score") / 7).alias("part_exposure"), (F.col("blocked") / 3).alias("part_canopy"))


@query()
def shipped_rows(spark, sf):
    return dataset.shipped(_grid(spark, sf)).drop("ae", "an", "be", "bn")


@query()
def geojson_features(spark, sf):
    """The features read back as numbers."""
    read = "struct<type:string,id:long,properties:struct<cid:long,score:double,length:double>,geometry:struct<type:string,coordinates:array<array<double>>>>"
    f = dataset.geojson(_grid(spark, sf)).select(F.from_json("feature", read).alias("f")).select("f.*")
    return f.select("type", "id", "properties.*", F.col("geometry.type").alias("shape"), *[F.round(F.get(F.get("geometry.coordinates", F.lit(i)), F.lit(j)), 7).alias(n) for i, j, n in ((0, 0, "a_lon"), (0, 1, "a_lat"), (1, 0, "b_lon"), (1, 1, "b_lat"))])


@query(f"WITH {b.LINES} SELECT kind, count(*) AS n, median(score / 50) AS median, count(*) FILTER (abs(score / 50 - 1) <= 0.1::DOUBLE) AS within_10, count(*) FILTER (abs(score / 50 - 1) <= 0.25::DOUBLE) AS within_25 FROM lines GROUP BY kind")
def ratio_spread(spark, sf):
    return dataset.spread(b.lines(spark, sf).withColumn("ratio", F.col("score") / 50), ["kind"], "ratio")


@query("SELECT regexp_replace(event_type || ' short by ' || CAST(event_id % 7 AS VARCHAR) || '.5 m', '[0-9]+(\\.[0-9]+)?', 'N', 'g') AS rule, count(*) AS n FROM events GROUP BY 1")
def failures_by_rule(spark, sf):
    text = F.concat(F.col("event_type"), F.lit(" short by "), (F.col("event_id") % 7).cast("string"), F.lit(".5 m"))
    return dataset.by_rule(b.table(spark, sf, "events").select(text.alias("why")), "why")


# series ------------------------------------------------------------------------------------------


@query(
    f"""WITH {b.INTERVALS}, r AS (SELECT *, row_number() OVER w AS rn, max(t) OVER (PARTITION BY kind ORDER BY f, t, d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM intervals WINDOW w AS (PARTITION BY kind ORDER BY f, t, d)),
    p AS (SELECT *, sum(CASE WHEN f <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY kind ORDER BY rn) AS part FROM r)
    SELECT kind, min(f) AS "from", max(t) AS "to", max(carrier) AS carrier, arg_min(d, (o, rn)) AS d, min(o) AS "offset" FROM p GROUP BY kind, part"""
)
def crossing_merge(spark, sf):
    return series.merge_intervals(b.intervals(spark, sf), ["kind"])


@query(
    """WITH n AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
    i AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id, event_type ORDER BY pos) AS g FROM n) SELECT user_id, event_type, min(pos) AS first, max(pos) AS last, count(*) AS n FROM i GROUP BY user_id, event_type, g"""
)
def cover_runs(spark, sf):
    return series.runs(b.table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type")


@query(
    """WITH v AS (SELECT event_id, user_id, CASE WHEN event_id % 7 <> 0 THEN floor(value) END AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
    g AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN pos END) OVER (PARTITION BY user_id ORDER BY pos) AS b, min(CASE WHEN x IS NOT NULL THEN pos END) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM v)
    SELECT g.event_id, CASE WHEN g.x IS NOT NULL THEN g.x WHEN g.a IS NULL THEN p.x WHEN g.b IS NULL THEN q.x ELSE p.x + (q.x - p.x) * CAST(g.pos - g.b AS DOUBLE) / CAST(g.a - g.b AS DOUBLE) END AS filled FROM g
    LEFT JOIN v p ON p.user_id = g.user_id AND p.pos = g.b LEFT JOIN v q ON q.user_id = g.user_id AND q.pos = g.a"""
)
def gap_fill(spark, sf):
    events = b.table(spark, sf, "events").withColumn("x", F.when(F.col("event_id") % 7 != 0, F.floor("value").cast("double")))
    return series.fill_gaps(events, "user_id", ["ts", "event_id"], "x").select("event_id", "filled")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax ROWS UNBOUNDED PRECEDING) AS value FROM lineitem")
def delta_decode(spark, sf):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax"]
    return series.decode_deltas(b.table(spark, sf, "lineitem"), "l_orderkey", order, "l_quantity").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "value")


@query("WITH s AS (SELECT user_id, event_id, floor(value / 50) AS v, lag(floor(value / 50)) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) SELECT user_id, event_id, before, v AS after FROM s WHERE before <> v")
def stepped_outline(spark, sf):
    events = b.table(spark, sf, "events").withColumn("v", F.floor(F.col("value") / 50).cast("double"))
    return series.stepped(events, "user_id", "event_id", "v")


@query(f"WITH {b.POINTS} SELECT id, bit_count(open) AS n FROM points")
def open_sectors(spark, sf):
    return b.points(spark, sf).select("id", F.bit_count("open").cast("long").alias("n"))


@query(
    f"""WITH {b.POINTS}, bits AS (SELECT id, open, i FROM points, (SELECT unnest(range(0, 64)) AS i) u WHERE (open >> CAST(i AS INT)) & 1 = 1 AND (open >> CAST((i + 63) % 64 AS INT)) & 1 = 0)
    SELECT id, CAST(i AS INT) AS start, CAST(min(k) AS INT) AS n FROM bits, (SELECT unnest(range(1, 64)) AS k) v WHERE (open >> CAST((i + k) % 64 AS INT)) & 1 = 0 GROUP BY id, i"""
)
def bearing_ranges(spark, sf):
    return b.points(spark, sf).select("id", F.explode(series.circular_runs(F.col("open"))).alias("run")).select("id", "run.start", "run.n")


# ways and water ----------------------------------------------------------------------------------

CLASSED = f"""{b.TAGS}, tiers AS (SELECT *, CASE highway WHEN 'footway' THEN 'path' WHEN 'track' THEN 'path' WHEN 'service' THEN 'street' WHEN 'residential' THEN 'street' WHEN 'primary' THEN 'road' WHEN 'motorway' THEN 'highway' WHEN 'cycleway' THEN 'cycle' END AS plain FROM tags),
classed AS (SELECT *, CASE WHEN railway IS NOT NULL THEN CASE WHEN railway = 'rail' THEN 'highway' END WHEN highway = 'track' AND tracktype = 'grade1' OR highway = 'service' AND service = 'driveway' OR plain = 'path' AND bicycle = 'designated' THEN 'cycle' ELSE plain END AS tier FROM tiers),
kept AS (SELECT id, tier, coalesce(railway, highway) AS kind, CASE WHEN try_cast(width AS DOUBLE) > 0 THEN try_cast(width AS DOUBLE) / 2 WHEN try_cast(lanes AS DOUBLE) > 0 THEN try_cast(lanes AS DOUBLE) * 3.25::DOUBLE / 2
    ELSE CASE tier WHEN 'path' THEN 1.0::DOUBLE WHEN 'cycle' THEN 1.5::DOUBLE WHEN 'street' THEN 3.0::DOUBLE WHEN 'road' THEN 4.0::DOUBLE ELSE 12.5::DOUBLE END END AS half FROM classed WHERE tier IS NOT NULL AND coalesce(tunnel, 'no') = 'no')"""
WATER = "CASE WHEN natural_ = 'water' THEN 'water' WHEN waterway = 'river' THEN 'waterway' END"


@query(f"WITH {CLASSED} SELECT * FROM kept")
def classify_way(spark, sf):
    return b.tags(spark, sf).select("id", ways.classify_way(F.col("tags")).alias("c")).where("c is not null").select("id", "c.*")


@query(f"WITH {b.TAGS} SELECT id, {WATER} AS kind FROM tags")
def water_kind(spark, sf):
    return b.tags(spark, sf).select("id", ways.water_kind(F.col("tags")).alias("kind"))


@query(f"WITH {CLASSED} SELECT t.id, CASE WHEN k.id IS NOT NULL THEN 'road' WHEN coalesce(t.tunnel, 'no') = 'no' THEN {WATER.replace('natural_', 't.natural_').replace('waterway =', 't.waterway =')} END AS kept FROM tags t LEFT JOIN kept k USING (id)")
def keep_way(spark, sf):
    return b.tags(spark, sf).select("id", ways.keep_way(F.col("tags")).alias("kept"))


@query(f"WITH {CLASSED} SELECT tier, kind, count(*) AS n FROM kept GROUP BY 1, 2")
def way_kinds(spark, sf):
    classed = b.tags(spark, sf).select(ways.classify_way(F.col("tags")).alias("c")).where("c is not null")
    return classed.groupBy("c.tier", "c.kind").agg(F.count("*").alias("n"))


def _point_segment(p: str, q: tuple[str, str, str, str]) -> str:
    x, y = p.split()
    x0, y0, x1, y1 = q
    t = f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, (({x} - {x0}) * ({x1} - {x0}) + ({y} - {y0}) * ({y1} - {y0})) / (({x1} - {x0}) * ({x1} - {x0}) + ({y1} - {y0}) * ({y1} - {y0}))))"
    dx, dy = f"({x} - ({x0} + ({x1} - {x0}) * {t}))", f"({y} - ({y0} + ({y1} - {y0}) * {t}))"
    return f"({dx} * {dx} + {dy} * {dy})"


def _left(p: tuple[str, str, str, str], q: str) -> str:
    x, y = q.split()
    return f"((({p[2]} - {p[0]}) * ({y} - {p[1]}) - ({p[3]} - {p[1]}) * ({x} - {p[0]})) > 0)"


_S, _R = ("ae", "an", "be", "bn"), ("x0", "y0", "x1", "y1")
_CROSS = f"({_left(_S, 'x0 y0')} <> {_left(_S, 'x1 y1')} AND {_left(_R, 'ae an')} <> {_left(_R, 'be bn')})"
_NEAR = f"least({_point_segment('ae an', _R)}, {_point_segment('be bn', _R)}, {_point_segment('x0 y0', _S)}, {_point_segment('x1 y1', _S)})"
_REACH = "(half + sqrt((be - ae) * (be - ae) + (bn - an) * (bn - an)) * 0.04::DOUBLE)"


@query(f"WITH {b.SPANS}, {b.SEGMENTS} SELECT id, way, CAST(seg AS INT) AS seg FROM spans, segments WHERE {_CROSS} OR {_NEAR} <= {_REACH} * {_REACH}")
def ways_near_spans(spark, sf):
    return ways.near(b.spans(spark, sf), ways.segments(b.ways(spark, sf)), columns=["id", "way", "seg"])


@query()
def way_crossings(spark, sf):
    return ways.crossings(b.spans(spark, sf), b.ways(spark, sf))


def _rings(spark, sf):
    k = F.col("s_suppkey")
    x, y, r = (k * 7907 % 211).cast("double"), (k * 104723 % 197).cast("double"), (k % 9 + 3).cast("double")
    ring = F.array(*[F.struct((x + r * dx).alias("e"), (y + r * dy).alias("n")) for dx, dy in ((0, 0), (2, 0.25), (1.25, 1), (2, 2), (0.25, 1.75))])
    return b.table(spark, sf, "supplier").select(k.alias("id"), F.when(k % 5 == 0, "island").otherwise("water").alias("kind"), ring.alias("ring"))


RINGS = """rings AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN 'island' ELSE 'water' END AS kind, k, CAST(s_suppkey * 7907 % 211 AS DOUBLE) + (s_suppkey % 9 + 3) * [0, 2, 1.25, 2, 0.25][k + 1]::DOUBLE AS x, CAST(s_suppkey * 104723 % 197 AS DOUBLE) + (s_suppkey % 9 + 3) * [0, 0.25, 1, 2, 1.75][k + 1]::DOUBLE AS y
    FROM supplier, (VALUES (0), (1), (2), (3), (4)) AS v(k)), edges AS (SELECT a.id, a.kind, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM rings a JOIN rings b ON a.id = b.id AND b.k = (a.k + 4) % 5),
cut AS (SELECT id, kind, cy, x0 + (cy + 0.5::DOUBLE - y0) / (y1 - y0) * (x1 - x0) AS x FROM edges, LATERAL (SELECT unnest(range(CAST(ceil(least(y0, y1) - 0.5) AS BIGINT), CAST(ceil(greatest(y0, y1) - 0.5) AS BIGINT))) AS cy) u WHERE y0 <> y1),
paired AS (SELECT id, kind, cy, x AS a, lead(x) OVER w AS b, row_number() OVER w AS rn FROM cut WINDOW w AS (PARTITION BY id, cy ORDER BY x)),
filled AS (SELECT DISTINCT id, kind, cx, cy FROM paired, LATERAL (SELECT unnest(range(CAST(ceil(a - 0.5) AS BIGINT), CAST(floor(b - 0.5) AS BIGINT) + 1)) AS cx) u WHERE rn % 2 = 1)"""


@query(f"WITH {RINGS} SELECT id, cx, cy FROM filled")
def polygon_cells(spark, sf):
    return ways.fill(_rings(spark, sf))


@query(f"WITH {RINGS} SELECT DISTINCT cx, cy FROM filled f WHERE kind = 'water' AND NOT EXISTS (SELECT 1 FROM filled i WHERE i.kind = 'island' AND i.cx = f.cx AND i.cy = f.cy)")
def water_cells(spark, sf):
    return ways.water_mask(_rings(spark, sf))


@query("""SELECT p_partkey AS id, g.x AS be, h.y AS bn FROM part, LATERAL (SELECT unnest(range(CAST(floor((p_partkey * 7919 % 1009) / 50.0) AS BIGINT), CAST(floor((p_partkey * 7919 % 1009 + 60 + 2 * (p_partkey % 3)) / 50.0) AS BIGINT) + 1)) AS x) g,
    LATERAL (SELECT unnest(range(CAST(floor((p_partkey * 104729 % 1013) / 50.0) AS BIGINT), CAST(floor((p_partkey * 104729 % 1013 + 50 - 2 * (p_partkey % 2)) / 50.0) AS BIGINT) + 1)) AS y) h""")
def features_by_block(spark, sf):
    return ways.blocks_of(b.ways(spark, sf), 50.0).select("id", "be", "bn")


@query("SELECT l_partkey AS id, min(l_suppkey * 10 + l_linenumber) AS block FROM lineitem GROUP BY 1")
def first_block_of_way(spark, sf):
    lines = b.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), (F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("block"))
    return ways.first_of_id(lines.select("id", "block")).select("id", "block")


@query("""WITH r AS (SELECT l_orderkey AS id, l_partkey AS ref, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k, count(*) OVER (PARTITION BY l_orderkey) AS want FROM lineitem)
    SELECT r.id, count(*) AS n, CAST(sum(p_size) AS DOUBLE) AS e FROM r JOIN part ON p_partkey = ref AND p_partkey % 10 <> 0 GROUP BY r.id, r.want HAVING count(*) = r.want""")
def way_geometry(spark, sf):
    lines = b.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("r"))
    nodes = b.table(spark, sf, "part").where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("e"), F.lit(0.0).alias("n"))
    found = ways.geometry(lines.select("id", F.transform("r", lambda x: x["l_partkey"]).alias("refs")), nodes)
    return found.select("id", F.size("pts").cast("long").alias("n"), F.aggregate("pts", F.lit(0.0), lambda s, p: s + p["e"]).alias("e"))


# tiles, regions and sets ---------------------------------------------------------------------------


@query("SELECT DISTINCT c_nationkey AS tile FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
def tile_semi(spark, sf):
    return b.table(spark, sf, "customer").join(b.table(spark, sf, "supplier"), F.col("c_nationkey") == F.col("s_nationkey"), "left_semi").select(F.col("c_nationkey").alias("tile")).distinct()


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def tile_anti(spark, sf):
    return b.table(spark, sf, "orders").join(b.table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select(F.col("o_orderkey").alias("id"))


@query("SELECT c_custkey AS id, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def left_default(spark, sf):
    counts = b.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    joined = b.table(spark, sf, "customer").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select(F.col("c_custkey").alias("id"), F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT c_nationkey AS t FROM customer UNION SELECT s_nationkey FROM supplier")
def tiles_union(spark, sf):
    return b.table(spark, sf, "customer").select(F.col("c_nationkey").alias("t")).union(b.table(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_custkey AS t FROM customer INTERSECT SELECT o_custkey FROM orders")
def tiles_intersect(spark, sf):
    return b.table(spark, sf, "customer").select(F.col("c_custkey").alias("t")).intersect(b.table(spark, sf, "orders").select("o_custkey"))


@query(f"WITH {b.LINES}, x AS (SELECT DISTINCT o.id, l.id AS other FROM lines o JOIN lines l ON o.id < l.id AND greatest(o.ae, o.be) >= least(l.ae, l.be) AND greatest(l.ae, l.be) >= least(o.ae, o.be) AND greatest(o.an, o.bn) >= least(l.an, l.bn) AND greatest(l.an, l.bn) >= least(o.an, o.bn)) SELECT * FROM x")
def interval_overlap(spark, sf):
    boxes = b.lines(spark, sf).select("id", F.least("ae", "be").alias("w"), F.greatest("ae", "be").alias("e"), F.least("an", "bn").alias("s"), F.greatest("an", "bn").alias("n"))
    return select.overlapping(boxes)


@query(f"WITH {b.LINES} SELECT '33' || CAST(CAST(floor(ae / 1000) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(floor(an / 1000) AS BIGINT) AS VARCHAR) AS tile, count(*) AS n FROM lines GROUP BY 1")
def count_per_tile(spark, sf):
    return b.lines(spark, sf).groupBy(fn.tile_id(F.col("ae"), F.col("an")).alias("tile")).agg(F.count("*").alias("n"))


@query(f"""WITH {b.LINES}, x AS (SELECT least(ae, be) AS w, greatest(ae, be) AS e, least(an, bn) AS s, greatest(an, bn) AS n FROM lines) SELECT DISTINCT g.x AS te, h.y AS tn FROM x,
    LATERAL (SELECT unnest(range(CAST(floor(w / 1000) AS BIGINT), greatest(CAST(floor(w / 1000) AS BIGINT), CAST(ceil(e / 1000) AS BIGINT) - 1) + 1)) AS x) g, LATERAL (SELECT unnest(range(CAST(floor(s / 1000) AS BIGINT), greatest(CAST(floor(s / 1000) AS BIGINT), CAST(ceil(n / 1000) AS BIGINT) - 1) + 1)) AS y) h""")
def corridor_tiles(spark, sf):
    box = [F.least("ae", "be"), F.least("an", "bn"), F.greatest("ae", "be"), F.greatest("an", "bn")]
    return b.lines(spark, sf).select(F.explode(fn.tiles_over(*box)).alias("t")).select("t.te", "t.tn").distinct()


@query(f"WITH {b.LINES} SELECT CAST(CAST(floor(ae / 800) AS BIGINT) AS VARCHAR) || '_' || CAST(CAST(floor(an / 800) AS BIGINT) AS VARCHAR) AS chunk, count(DISTINCT region) AS regions, max(score) AS best FROM lines GROUP BY 1")
def chunk_census(spark, sf):
    chunk = fn.chunk_name(F.col("ae"), F.col("an"), 800.0)
    return b.lines(spark, sf).groupBy(chunk.alias("chunk")).agg(F.countDistinct("region").alias("regions"), F.max("score").alias("best"))


@query(f"WITH {b.LINES} SELECT region, kind, max(score) AS score FROM lines GROUP BY 1, 2")
def mask_max_over_regions(spark, sf):
    return dataset.highest_per(b.lines(spark, sf), ["region", "kind"], "score")


@query(
    """WITH r AS (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN epoch_us(ts) / 1e6::DOUBLE END AS t FROM events), x AS (SELECT max(t) AS newest, min(t) AS oldest FROM r)
    SELECT event_id, floor(CASE WHEN t IS NULL THEN 1.0::DOUBLE ELSE (newest - t) / (newest - oldest) END * 1e6 + 0.5) AS ppm FROM r, x"""
)
def vintage_scale(spark, sf):
    regions = b.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("ts")).alias("generated_at"))
    return dataset.vintage_scale(regions).select("event_id", F.floor(F.col("age") * 1e6 + 0.5).cast("double").alias("ppm"))


@query("SELECT c_custkey AS id, o.o_custkey IS NOT NULL AS cached, o.vintage FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS vintage FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def areas_and_cache(spark, sf):
    cache = b.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderdate").alias("vintage"))
    return dataset.work_order(b.table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), cache, ["id"]).select("id", "cached", "vintage")


@query(f"WITH {b.POINTS} SELECT id, row_number() OVER (ORDER BY n, e, id) AS rank FROM points")
def anchors_in_order(spark, sf):
    return dataset.ranked(b.points(spark, sf), [F.col("n"), F.col("e"), F.col("id")], "rank", 1).select("id", "rank")


@query(f"WITH {b.LINES} SELECT region, 'region_' || substr(sha1(CAST(region AS VARCHAR)), 1, 16) AS name, count(*) AS n FROM lines GROUP BY 1, 2")
def region_names(spark, sf):
    return b.lines(spark, sf).groupBy("region", fn.region_id(F.col("region").cast("string")).alias("name")).agg(F.count("*").alias("n"))


@query(f"WITH {b.POINTS} SELECT id, floor(sqrt((id % 700) * (id % 700) + (id % 300) * (id % 300)) / (0.9996::DOUBLE * (1 + pow((e + id % 700 / 2.0::DOUBLE - 500000) / 6381000.0::DOUBLE, 2) / 2 + pow((e + id % 700 / 2.0::DOUBLE - 500000) / 6381000.0::DOUBLE, 4) * 5 / 24)) * 1000 + 0.5) AS mm FROM points")
def ground_metres(spark, sf):
    d = fn.ground_distance(F.col("e"), F.col("n"), F.col("e") + F.col("id") % 700, F.col("n") + F.col("id") % 300)
    return b.points(spark, sf).select("id", F.floor(d * 1000 + 0.5).cast("double").alias("mm"))


def _lat_lon(e: str, north: str) -> tuple[str, str]:
    """Latitude and longitude by the same series of the third order, in SQL."""
    n, radius, _, back = fn._third_flattening()
    m = fn.CENTRAL_SCALE * radius
    xi, eta = f"(({north}) / {m!r}::DOUBLE)", f"((({e}) - 500000.0::DOUBLE) / {m!r}::DOUBLE)"
    x = xi + "".join(f" - sin({xi} * {2 * j}) * cosh({eta} * {2 * j}) * {b!r}::DOUBLE" for j, b in enumerate(back, 1))
    y = eta + "".join(f" - cos({xi} * {2 * j}) * sinh({eta} * {2 * j}) * {b!r}::DOUBLE" for j, b in enumerate(back, 1))
    chi = f"asin(sin({x}) / cosh({y}))"
    series = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    lat = f"degrees({chi}" + "".join(f" + sin({chi} * {2 * j}) * {c!r}::DOUBLE" for j, c in enumerate(series, 1)) + ")"
    return lat, f"degrees(atan2(sinh({y}), cos({x}))) + 15.0::DOUBLE"


_AT = _lat_lon("e * 100 + 350000", "n * 100 + 5700000")


@query(f"WITH {b.POINTS} SELECT id, round({_AT[0]}, 7) AS lat, round({_AT[1]}, 7) AS lon FROM points")
def wgs84_points(spark, sf):
    grid = b.points(spark, sf).select("id", fn.to_wgs84(F.col("e") * 100 + 350000, F.col("n") * 100 + 5700000).alias("p"))
    return grid.select("id", F.round("p.lat", 7).alias("lat"), F.round("p.lon", 7).alias("lon"))


_A, _B = _lat_lon("ae + 350000.0::DOUBLE", "an + 5700000.0::DOUBLE"), _lat_lon("be + 350000.0::DOUBLE", "bn + 5700000.0::DOUBLE")
SQL["shipped_rows"] = f"""WITH {b.LINES} SELECT id, score, length, {_round('(score / 7)', 3)} AS part_exposure, {_round('(blocked / 3)', 3)} AS part_canopy, {_round(f'({_A[1]})', 7)} AS a_lon, {_round(f'({_A[0]})', 7)} AS a_lat, {_round(f'({_B[1]})', 7)} AS b_lon, {_round(f'({_B[0]})', 7)} AS b_lat FROM lines"""
SQL["geojson_features"] = f"""WITH {b.LINES} SELECT 'Feature' AS type, row_number() OVER (ORDER BY score DESC, id) - 1 AS id, id AS cid, score, length, 'LineString' AS shape, round({_A[1]}, 7) AS a_lon, round({_A[0]}, 7) AS a_lat, round({_B[1]}, 7) AS b_lon, round({_B[0]}, 7) AS b_lat FROM lines"""


@query(f"WITH {b.POINTS} SELECT id, list_reduce(list_transform(range(0, 16), lambda k: lower(to_hex((open >> CAST(4 * k AS INT)) & 15))), lambda x, y: x || y) AS sectors FROM points")
def sector_hex(spark, sf):
    return b.points(spark, sf).select("id", fn.sector_hex(F.col("open")).alias("sectors"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells, their drops, end points on steep ones, pairs of them within reach, levelled, the longest first."""
    steep = raster.drop_field(b.cells(spark, sf_dir), 2).where(F.col("drop") >= 40)
    ends = steep.select((F.col("cx") * 64 + F.col("cy")).alias("id"), (F.col("cx") * 16.0 + 8).alias("e"), (F.col("cy") * 16.0 + 8).alias("n"), F.col("z").alias("lo"), (F.col("z") + DEFAULTS.frame_max).alias("hi"))
    found = pairs.levelled(pairs.band_join(ends, DEFAULTS.min_length, 200, ["lo", "hi"]))
    return found.orderBy(F.desc("length"), "i", "j").limit(20).select("i", "j", fn.half_up(F.col("length"), 1).alias("length"), "h_a", "h_b", "off_level")
