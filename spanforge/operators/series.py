"""Operators on ordered rows: runs, gaps, intervals, deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Stretches of equal neighbours: key, value, first and last position (from 0), n."""
    w = Window.partitionBy(key).orderBy(*order)
    numbered = df.withColumn("pos", F.row_number().over(w) - 1)
    island = F.col("pos") - (F.row_number().over(Window.partitionBy(key, value).orderBy("pos")) - 1)
    return numbered.withColumn("island", island).groupBy(key, value, "island").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("n")).drop("island")


def fill_gaps(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """df with `filled`: missing values on the line between the neighbours, by position; flat beyond the first and last."""
    w = Window.partitionBy(key).orderBy(*order)
    there = F.when(F.col(value).isNotNull(), F.struct(F.col("pos"), F.col(value).alias("v")))
    at = df.withColumn("pos", F.row_number().over(w))
    ahead = Window.partitionBy(key).orderBy("pos")
    at = at.withColumn("b", F.last(there, True).over(ahead.rowsBetween(Window.unboundedPreceding, 0))).withColumn("a", F.first(there, True).over(ahead.rowsBetween(0, Window.unboundedFollowing)))
    between = F.col("b.v") + (F.col("a.v") - F.col("b.v")) * (F.col("pos") - F.col("b.pos")) / (F.col("a.pos") - F.col("b.pos"))
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("a").isNull(), F.col("b.v")).when(F.col("b").isNull(), F.col("a.v")).otherwise(between)
    return at.withColumn("filled", filled).drop("a", "b")


def merge_intervals(df: DataFrame, keys: list[str], ties: list[str] | None = None) -> DataFrame:
    """Overlapping (from, to) of a key joined: from, to, the highest carrier, and d and offset of the interval with the
    least offset (the first in order of from, to, d among equals); touching ones join. Intervals that are joined ones
    have the from, to and d that their offset comes from as ties."""
    w = Window.partitionBy(*keys).orderBy("from", "to", "d")
    reach = F.max("to").over(w.rowsBetween(Window.unboundedPreceding, -1))
    at = df.withColumn("rn", F.row_number().over(w)).withColumn("new", F.when(F.col("from") <= reach, 0).otherwise(1))
    at = at.withColumn("part", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.min_by(F.struct("d", "offset"), F.struct("offset", *(ties or ["rn"])))
    out = at.groupBy(*keys, "part").agg(F.min("from").alias("from"), F.max("to").alias("to"), F.max("carrier").alias("carrier"), best.alias("best"))
    return out.select(*keys, "from", "to", "carrier", "best.d", "best.offset")


def decode_deltas(df: DataFrame, key: str, order: list[str], delta: str) -> DataFrame:
    """Running sums of deltas within each key."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("value", F.sum(delta).over(w))


def circular_runs(mask: Column, sectors: int = 64) -> Column:
    """(start, n) of each run of set bits around a circle, as an array; a run over the seam is one, a full circle too."""
    bit = [F.getbit(mask, F.lit(i)) == 1 for i in range(sectors)]
    starts = F.array(*[F.when(bit[i] & ~bit[i - 1], F.lit(i)) for i in range(sectors)])
    ends = F.array(*[F.when(bit[i] & ~bit[(i + 1) % sectors], F.lit(i)) for i in range(sectors)])
    s, e = (F.filter(x, lambda v: v.isNotNull()) for x in (starts, ends))
    # the k-th start belongs to the k-th end, or to the one after it where the first end is that of a run over the seam
    shift = F.when(F.get(e, F.lit(0)) < F.get(s, F.lit(0)), 1).otherwise(0)
    pairs = F.transform(s, lambda v, k: F.struct(v.alias("start"), (F.pmod(F.get(e, F.pmod(k + shift, F.size(e))) - v, F.lit(sectors)) + 1).alias("n")))
    full = F.bit_count(mask) == sectors
    return F.when(full, F.array(F.struct(F.lit(0).alias("start"), F.lit(sectors).alias("n")))).otherwise(pairs)


def stepped(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Where a series jumps: a row at each change, with the values on both sides."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.lag(value).over(w)
    return df.withColumn("before", before).where(F.col("before").isNotNull() & (F.col("before") != F.col(value))).select(key, order, "before", F.col(value).alias("after"))
