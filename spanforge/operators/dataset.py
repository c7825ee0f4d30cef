"""Queries over found lines, spots, regions and tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.scalars import half_up, to_wgs84
from spanforge.params import DEFAULTS, Params
from spanforge.runtime import stage


def rescored(lines: DataFrame, sag_ratio: float) -> DataFrame:
    """Lines without a profile that bear the sag."""
    return lines.where(F.col("max_sag") + 1e-9 >= sag_ratio)


def line_filter(kinds: list[str] | None = None, score: float = 0, min_length: float = 0, max_length: float | None = None, exposure: float = 0, blocked: float = 100, off_level: float = 100) -> Column:
    """Percentages for blocked and off_level; the defaults pass everything. No kinds at all (an empty list) pass nothing."""
    keep = (F.col("score") >= score) & (F.col("length") >= min_length) & (F.col("exposure") >= exposure) & (F.col("blocked") * 100 <= blocked) & (F.col("off_level_ratio") * 100 <= off_level)
    if max_length is not None:
        keep = keep & (F.col("length") <= max_length)
    return keep & F.col("kind").isin(*kinds) if kinds is not None else keep


def spot_filter(score: float = 0, min_length: float = 0, max_length: float | None = None, exposure: float = 0, blocked: float = 1, off_level: float = 1) -> Column:
    """On a spot's bounds, so a spot stays if any of its lines might."""
    keep = (F.col("score") >= score) & (F.col("length_max") >= min_length) & (F.col("exposure_max") >= exposure) & (F.col("canopy_min") <= blocked) & (F.col("off_level_min") <= off_level)
    return keep & (F.col("length_min") <= max_length) if max_length is not None else keep


def walkable(p: Params = DEFAULTS) -> Column:
    return (F.col("blocked") <= p.spot_blocked) & (F.col("score") >= p.spot_score)


def in_view(box: tuple[float, float, float, float]) -> Column:
    """A line's box overlaps (west, south, east, north), edges included."""
    w, s, e, n = box
    return (F.greatest("ae", "be") >= w) & (F.least("ae", "be") <= e) & (F.greatest("an", "bn") >= s) & (F.least("an", "bn") <= n)


def endpoints(lines: DataFrame) -> DataFrame:
    """Both ends of each line as spots of their own."""
    end = [F.struct(F.lit(k).alias("k"), F.col(f"{x}e").alias("e"), F.col(f"{x}n").alias("n")) for k, x in enumerate("ab")]
    out = lines.withColumn("end", F.explode(F.array(*end)))
    return out.select(
        (F.col("id") * 2 + F.col("end.k")).alias("id"), "end.e", "end.n", F.lit(1).cast("long").alias("count"), "score", F.col("length").alias("length_min"), F.col("length").alias("length_max"),
        F.col("exposure").alias("exposure_max"), F.col("blocked").alias("canopy_min"), F.col("off_level_ratio").alias("off_level_min"), "kind", "blocked",
    )


def ranges(lines: DataFrame, floors: dict[str, float]) -> DataFrame:
    """The upper end of each filter: the highest value, at least a floor, rounded up."""
    return lines.agg(*[F.ceil(F.greatest(F.max(c), F.lit(v))).cast("long").alias(f"max_{c}") for c, v in floors.items()])


def top(lines: DataFrame, k: int) -> DataFrame:
    return lines.orderBy(F.desc("score"), "id").limit(k)


def located(lines: DataFrame) -> DataFrame:
    """Lines with longitude and latitude of both ends: a_lon, a_lat, b_lon, b_lat."""
    at = lines.withColumns({f"__{x}": to_wgs84(F.col(f"{x}e"), F.col(f"{x}n")) for x in "ab"})
    return at.withColumns({f"{x}_{c}": F.col(f"__{x}.{c}") for x in "ab" for c in ("lon", "lat")}).drop("__a", "__b")


def shipped(lines: DataFrame) -> DataFrame:
    """Lines as they are published: places on the grid and lengths to a tenth, longitudes and latitudes to seven digits, the
    score and its parts (columns part_*) to three, without the kind, which names the file."""
    rounded = {f"{x}_{c}": half_up(F.col(f"{x}_{c}"), 7) for x in "ab" for c in ("lon", "lat")}
    parts = {c: half_up(F.col(c), 3) for c in lines.columns if c == "score" or c.startswith("part_")}
    tenths = {c: half_up(F.col(c), 1) for c in ("ae", "an", "be", "bn", "length")}
    return located(lines).withColumns(rounded | parts | tenths).drop("kind")


def geojson(lines: DataFrame) -> DataFrame:
    """A feature for each line: its number among all from the best on, its id, score and length, and its ends as longitude
    and latitude. The worst come first, so that the best are drawn on top."""
    numbered = ranked(located(lines), [F.desc("score"), F.col("id")], "number")
    shape = F.struct(F.lit("LineString").alias("type"), F.array(F.array("a_lon", "a_lat"), F.array("b_lon", "b_lat")).alias("coordinates"))
    properties = F.struct(F.col("id").alias("cid"), "score", "length")
    feature = F.struct(F.lit("Feature").alias("type"), F.col("number").alias("id"), properties.alias("properties"), shape.alias("geometry"))
    return numbered.orderBy(F.desc("number")).select(F.to_json(feature).alias("feature"))


def off_map(view: tuple[float, float, float, float], areas: DataFrame) -> DataFrame:
    """One row: whether a view (south, west, north, east) overlaps none of the searched areas (south, west, north, east)."""
    s, w, n, e = view
    meets = (F.col("south") < n) & (F.col("north") > s) & (F.col("west") < e) & (F.col("east") > w)
    return areas.agg((F.count_if(meets) == 0).alias("off_map"))


def vintage_scale(regions: DataFrame, stamp: str = "generated_at") -> DataFrame:
    """Age of each region between the newest (0) and oldest (1); 0 where all are of one hour, 1 where the stamp is none."""
    t = F.unix_micros(F.col(stamp).cast("timestamp")) / F.lit(1e6)
    newest, oldest = regions.agg(F.max(t), F.min(t)).first()
    if newest is None:
        return regions.withColumn("age", F.lit(1.0))
    span = F.lit(newest) - F.lit(oldest)
    return regions.withColumn("age", F.when(t.isNull(), F.lit(1.0)).when(span < 3600, F.lit(0.0)).otherwise((F.lit(newest) - t) / span))


def work_order(areas: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Areas with what the cache holds of them, in the order of work: held ones first, then by vintage."""
    out = areas.join(cache.withColumn("cached", F.lit(True)), keys, "left")
    needs = F.coalesce("cached", F.lit(False))
    return out.withColumn("cached", needs).orderBy(F.when(needs, 0).otherwise(1), F.col("vintage").asc_nulls_last(), *keys)


def spread(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median of a ratio, and how many are within a tenth and a quarter of one."""
    off = F.abs(F.col(value) - 1)
    return values.groupBy(*by).agg(F.count("*").alias("n"), F.median(value).alias("median"), F.count_if(off <= 0.1).alias("within_10"), F.count_if(off <= 0.25).alias("within_25"))


def by_rule(reasons: DataFrame, text: str) -> DataFrame:
    """How often each rule rejects, numbers in the text left out."""
    return reasons.groupBy(F.regexp_replace(text, r"\d+(\.\d+)?", "N").alias("rule")).agg(F.count("*").alias("n"))


def mean_gain(refined: DataFrame) -> DataFrame:
    """How many lines (score, refined) a refinement made better, and by how much on average; nought where none."""
    gain = F.when(F.col("refined") > F.col("score"), F.col("refined") - F.col("score"))
    return refined.agg(F.count(gain).alias("improved"), F.coalesce(F.avg(gain), F.lit(0.0)).alias("gain"))


def mean_open(anchors: DataFrame, mask: str = "open") -> DataFrame:
    """Anchors and the mean number of open sectors of their masks; nought where there are none."""
    return anchors.agg(F.count("*").alias("anchors"), F.coalesce(F.avg(F.bit_count(mask)), F.lit(0.0)).alias("open_sectors"))


def highest_per(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(value).alias(value))


def ranked(df: DataFrame, order: list[Column], name: str, first: int = 0) -> DataFrame:
    """df with each row's number in an order: rows are dealt by ranges of it, counted, and numbered within their range."""
    dealt = stage(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("size"))  # a row a range
    before = sizes.select("__range", F.coalesce(F.sum("size").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.join(F.broadcast(before), "__range").withColumn(name, F.col("__before") + own - 1 + first).drop("__range", "__before")


def numbered(points: DataFrame) -> DataFrame:
    """Points (e, n) with ids from 1 in the order of n, then e."""
    return ranked(points, [F.col("n"), F.col("e")], "id", 1)
