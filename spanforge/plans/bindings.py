"""The driver's tables read as the library's inputs: cells, points, lines, intervals, tags. Each has the same words in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.operators import raster
from spanforge.runtime import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strip that grows with the parts: a few rows a cell at any scale, so that neighbours differ."""
    lines = table(spark, sf_dir, "lineitem")
    return raster.blit_max(lines, F.floor(F.col("l_partkey") / 8), (F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 64, F.col("l_quantity"))


CELLS = """cells AS (SELECT l_partkey // 8 AS cx, (l_suppkey * 7 + l_linenumber) % 64 AS cy, max(l_quantity) AS z FROM lineitem GROUP BY 1, 2)"""


def terraces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square of 64 x 64 terraces, most of them low: ground to span. Sums are spread evenly at any scale."""
    at = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 64).alias("cx"), ((F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 64).alias("cy"), "l_orderkey")
    total = F.sum("l_orderkey") % 60
    return at.groupBy("cx", "cy").agg(F.when(total >= 40, F.lit(50.0) + total % 2).otherwise((total % 20).cast("double")).alias("z"))


TERRACES = """terraces AS (SELECT l_partkey % 64 AS cx, (l_suppkey * 7 + l_linenumber) % 64 AS cy, CASE WHEN sum(l_orderkey) % 60 >= 40 THEN 50.0::DOUBLE + sum(l_orderkey) % 60 % 2 ELSE CAST(sum(l_orderkey) % 60 % 20 AS DOUBLE) END AS z
    FROM lineitem GROUP BY 1, 2)"""


def roofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return raster.blit_max(parts, F.col("p_partkey") % 71, F.col("p_size").cast("long") % 67, F.floor("p_retailprice") % 60)


ROOFS = """roofs AS (SELECT p_partkey % 71 AS cx, p_size % 67 AS cy, CAST(max(floor(p_retailprice) % 60) AS DOUBLE) AS z FROM part GROUP BY 1, 2)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("id"), (k * 7919 % 1009).cast("double").alias("e"), (k * 104729 % 1013).cast("double").alias("n"),
        (k * 2654435761 % 4611686018427387904).alias("open"), (k % 17).cast("double").alias("lo"), (k % 17 + k % 3).cast("double").alias("hi"),
    )


POINTS = """points AS (SELECT c_custkey AS id, CAST(c_custkey * 7919 % 1009 AS DOUBLE) AS e, CAST(c_custkey * 104729 % 1013 AS DOUBLE) AS n,
    CAST(c_custkey * 2654435761 % 4611686018427387904 AS BIGINT) AS open, CAST(c_custkey % 17 AS DOUBLE) AS lo, CAST(c_custkey % 17 + c_custkey % 3 AS DOUBLE) AS hi FROM customer)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    ae, an = (o * 7919 % 4001).cast("double"), (o * 104729 % 4003).cast("double")
    out = table(spark, sf_dir, "orders").select(
        o.alias("id"), F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "urban").otherwise("natural").alias("kind"), (o % 8).alias("region"),
        ae.alias("ae"), an.alias("an"), (ae + 60 + c % 200).alias("be"), (an + o % 151 - 75).alias("bn"),
        (F.floor("o_totalprice") % 1000 / F.lit(10.0)).alias("score"), (c % 60).cast("double").alias("exposure"), (o % 100 / F.lit(100.0)).alias("blocked"),
        (o % 40 / F.lit(1000.0)).alias("off_level_ratio"), (c % 250 / F.lit(1000.0)).alias("max_sag"),
    )
    return out.withColumn("length", F.floor(F.sqrt((F.col("be") - F.col("ae")) * (F.col("be") - F.col("ae")) + (F.col("bn") - F.col("an")) * (F.col("bn") - F.col("an"))) * 10 + 0.5) / F.lit(10.0))


LINES = """ends AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'urban' ELSE 'natural' END AS kind, o_orderkey % 8 AS region,
    CAST(o_orderkey * 7919 % 4001 AS DOUBLE) AS ae, CAST(o_orderkey * 104729 % 4003 AS DOUBLE) AS an,
    CAST(o_orderkey * 7919 % 4001 AS DOUBLE) + 60 + o_custkey % 200 AS be, CAST(o_orderkey * 104729 % 4003 AS DOUBLE) + o_orderkey % 151 - 75 AS bn,
    CAST(floor(o_totalprice) AS BIGINT) % 1000 / 10.0::DOUBLE AS score, CAST(o_custkey % 60 AS DOUBLE) AS exposure, o_orderkey % 100 / 100.0::DOUBLE AS blocked,
    o_orderkey % 40 / 1000.0::DOUBLE AS off_level_ratio, o_custkey % 250 / 1000.0::DOUBLE AS max_sag FROM orders),
lines AS (SELECT *, floor(sqrt((be - ae) * (be - ae) + (bn - an) * (bn - an)) * 10 + 0.5::DOUBLE) / 10.0::DOUBLE AS length FROM ends)"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as ground series in centimetres: exact in both engines."""
    k = F.col("vec_id")
    ground = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000) / F.lit(100.0) - (k % 30).cast("double"))
    surface = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000) / F.lit(100.0) - (k % 30).cast("double") + (k % 7).cast("double"))
    return table(spark, sf_dir, "embeddings").select(
        k.alias("id"), ground.alias("ground"), surface.alias("surface"), (k % 400 + 60).cast("double").alias("length"), F.lit(2.0).alias("h_a"), (k % 5).cast("double").alias("h_b"), F.abs(F.lit(2.0) - k % 5).cast("double").alias("off_level")
    )


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("event_id") % 1000).cast("double")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("kind"), F.col("event_id").alias("d"), start.alias("from"), (start + F.floor(F.col("value") / 100)).alias("to"), (F.col("event_id") * 31 % 97).cast("double").alias("offset"), (F.col("event_id") % 13).cast("double").alias("carrier")
    )


INTERVALS = """intervals AS (SELECT event_type AS kind, event_id AS d, CAST(event_id % 1000 AS DOUBLE) AS f, CAST(event_id % 1000 AS DOUBLE) + floor(value / 100) AS t,
    CAST(event_id * 31 % 97 AS DOUBLE) AS o, CAST(event_id % 13 AS DOUBLE) AS carrier FROM events)"""


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags by key: what a way is, how wide, whether a tunnel."""
    k = F.col("p_partkey")
    values = F.array(*[F.lit(x) for x in ("footway", "track", "service", "residential", "primary", "motorway", "cycleway", "proposed", None, "rail", "abandoned")])
    what = F.get(values, (k % 11).cast("int"))
    pairs = F.array(
        F.struct(F.when(k % 11 >= 9, F.lit("railway")).otherwise("highway").alias("k"), what.alias("v")),
        F.struct(F.lit("tracktype").alias("k"), F.when(k % 3 == 0, F.lit("grade1")).alias("v")),
        F.struct(F.lit("service").alias("k"), F.when(k % 5 == 0, F.lit("driveway")).alias("v")),
        F.struct(F.lit("bicycle").alias("k"), F.when(k % 7 == 0, F.lit("designated")).alias("v")),
        F.struct(F.lit("tunnel").alias("k"), F.when(k % 13 == 0, F.lit("yes")).when(k % 13 == 1, F.lit("no")).alias("v")),
        F.struct(F.lit("width").alias("k"), F.when(k % 4 == 0, (k % 9).cast("string")).when(k % 4 == 1, F.lit("wide")).alias("v")),
        F.struct(F.lit("lanes").alias("k"), F.when(k % 6 == 0, (k % 4).cast("string")).alias("v")),
        F.struct(F.lit("natural").alias("k"), F.when(k % 8 == 0, F.lit("water")).alias("v")),
        F.struct(F.lit("waterway").alias("k"), F.when(k % 9 == 0, F.lit("river")).alias("v")),
    )
    return table(spark, sf_dir, "part").select(k.alias("id"), F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull())).alias("tags"))


TAGS = """tags AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 11 < 9 THEN ['footway', 'track', 'service', 'residential', 'primary', 'motorway', 'cycleway', 'proposed', NULL][p_partkey % 11 + 1] END AS highway,
    CASE p_partkey % 11 WHEN 9 THEN 'rail' WHEN 10 THEN 'abandoned' END AS railway, CASE WHEN p_partkey % 3 = 0 THEN 'grade1' END AS tracktype, CASE WHEN p_partkey % 5 = 0 THEN 'driveway' END AS service,
    CASE WHEN p_partkey % 7 = 0 THEN 'designated' END AS bicycle, CASE p_partkey % 13 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS tunnel,
    CASE p_partkey % 4 WHEN 0 THEN CAST(p_partkey % 9 AS VARCHAR) WHEN 1 THEN 'wide' END AS width, CASE WHEN p_partkey % 6 = 0 THEN CAST(p_partkey % 4 AS VARCHAR) END AS lanes,
    CASE WHEN p_partkey % 8 = 0 THEN 'water' END AS natural_, CASE WHEN p_partkey % 9 = 0 THEN 'river' END AS waterway FROM part)"""


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    x, y = (k * 7919 % 1009).cast("double"), (k * 104729 % 1013).cast("double")
    pts = F.array(*[F.struct((x + dx + i * (k % 3)).alias("e"), (y + dy - i * (k % 2)).alias("n")) for i, (dx, dy) in enumerate([(0, 0), (40, 10), (60, 50)])])
    return table(spark, sf_dir, "part").select(k.alias("id"), F.lit("street").alias("tier"), F.lit("residential").alias("kind"), (F.lit(1.0) + k % 5).alias("half"), (k % 10 == 0).alias("bridge"), pts.alias("pts"))


SEGMENTS = """segments AS (SELECT p_partkey AS way, 1.0::DOUBLE + p_partkey % 5 AS half, s AS seg,
    CAST(p_partkey * 7919 % 1009 AS DOUBLE) + [0, 40, 60][s + 1] + s * (p_partkey % 3) AS x0, CAST(p_partkey * 104729 % 1013 AS DOUBLE) + [0, 10, 50][s + 1] - s * (p_partkey % 2) AS y0,
    CAST(p_partkey * 7919 % 1009 AS DOUBLE) + [0, 40, 60][s + 2] + (s + 1) * (p_partkey % 3) AS x1, CAST(p_partkey * 104729 % 1013 AS DOUBLE) + [0, 10, 50][s + 2] - (s + 1) * (p_partkey % 2) AS y1
    FROM part, (VALUES (0), (1)) AS v(s))"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    ae, an = (k * 7907 % 1009).cast("double"), (k * 104723 % 1013).cast("double")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), ae.alias("ae"), an.alias("an"), (ae + 50 + k % 100).alias("be"), (an + k % 91 - 45).alias("bn"))


SPANS = """spans AS (SELECT s_suppkey AS id, CAST(s_suppkey * 7907 % 1009 AS DOUBLE) AS ae, CAST(s_suppkey * 104723 % 1013 AS DOUBLE) AS an,
    CAST(s_suppkey * 7907 % 1009 AS DOUBLE) + 50 + s_suppkey % 100 AS be, CAST(s_suppkey * 104723 % 1013 AS DOUBLE) + s_suppkey % 91 - 45 AS bn FROM supplier)"""
