"""Mix sources to target weights: documents repeated floor(rate) times plus one hash-seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.words import WORD
from spanforge.runtime import attach, stage

#: Sources in code point order, null last, weigh these, over and over.
WEIGHTS = (3, 1, 2)
#: The mix's size over that of all documents, and over that of each source at most.
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A uniform number in [0, 1) from the first 52 bits of an MD5, the same in every run and engine."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_rates(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target, rate from rows of (source, size).

    Targets split share * total by weight; a target above most * source_size stops there and what is left
    over is shared again by weight among the rest, until none is above. That fixed point is
    min(most * source_size, level * weight) for one level, found with a running sum over the sources in
    order of the level at which they fill up. The sums are pre-aggregated in each task; only one row per
    source reaches the windows. A source of size 0 has target 0 and rate 0.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(by_name) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (k + 1).cast("int")).cast("long"))
    whole = Window.partitionBy()
    per = per.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("fills_at", F.col("cap") / F.col("weight"))
    fill = Window.orderBy("fills_at", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("budget", F.sum("source_size").over(whole) * F.lit(share))
        .withColumn("weight_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.col("weight_left"))
    )
    # the level rises while sources fill up and falls from the first that stays below its cap: the largest valid one is it
    level = F.coalesce(F.max(F.when(F.col("level") <= F.col("fills_at"), F.col("level"))).over(whole), F.lit(0.0))
    per = per.withColumn("at", level).withColumn("target", F.when(F.col("fills_at") <= F.col("at"), F.col("cap")).otherwise(F.col("at") * F.col("weight")))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(F.lit(0.0))
    return per.select("source", "source_size", "target", rate.alias("rate"))


def copies(rate: Column, doc_id: Column, seed: str = SEED) -> Column:
    """floor(rate), plus one where the document's draw is below the fraction."""
    whole = F.floor(rate)
    return (whole + F.when(draw(doc_id, seed) < rate - whole, 1).otherwise(0)).cast("long")


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, text: str = "text") -> DataFrame:
    """docs with __sf_size, __sf_source_size, __sf_target and __sf_copies beside their own columns.

    Null texts have size 0; a null doc_id draws as the word null; repeated rows draw alike. The source
    table is staged, then broadcast only if it is short (`attach`), so a hot source is never gathered.
    """
    sized = docs.select(F.col("source"), word_count(F.col(text)).alias("size"))
    rates = stage(source_rates(sized, weights, share, most), "mix-rates").select(
        "source", F.col("source_size").alias("__sf_source_size"), F.col("target").alias("__sf_target"), F.col("rate").alias("__sf_rate")
    )
    out = attach(docs.withColumn("__sf_size", word_count(F.col(text))), rates, ["source"])
    return out.withColumn("__sf_copies", copies(F.col("__sf_rate"), F.col("doc_id"), seed)).drop("__sf_rate")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as its source's rate asks for, columns as in docs."""
    planned = plan(docs, **options).where("__sf_copies > 0")
    out = planned.withColumn("__sf_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__sf_copies"))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
