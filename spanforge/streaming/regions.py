"""Results of regions as they arrive: a file stream whose batches replace their regions in the results table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanforge.operators import dataset


def follow(spark: SparkSession, incoming: str, schema: str, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Read new Parquet files of `incoming` (with region_id) and overwrite those regions' partitions of `table`.

    Overwriting whole partitions makes a repeated batch harmless, which is all that a file sink needs for
    exactly-once results."""

    def merge(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("region_id").parquet(table)

    stream = spark.readStream.schema(schema).parquet(incoming)
    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def counts_by_window(events: DataFrame, time: str = "ts", width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Rows of a stream by kind and window, late ones accepted for a while."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), "event_type").agg(F.count("*").alias("n"))


def best_of(table: DataFrame, k: int) -> DataFrame:
    return dataset.top(table, k)
