"""Staging and joins that survive skew."""

import pytest
from pyspark.sql import functions as F

from spanforge import runtime


@pytest.mark.parametrize("rows", [100_000, 0])
def test_attach_is_the_same_by_broadcast_and_by_salt(spark, monkeypatch, rows):
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", rows)
    big = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"))
    small = runtime.stage(big.groupBy("k").agg(F.count("*").alias("n")).where("k is null or k <> 'k1'"), "small")
    got = {r["id"]: r["n"] for r in runtime.attach(big, small, ["k"]).collect()}
    want = {r["k"]: r["n"] for r in small.collect()}
    assert len(got) == 900 and all(got[r["id"]] == want.get(r["k"]) for r in big.collect())
    assert runtime.attach(big, small, ["k"]).columns == ["id", "k", "n"]


def test_stage_writes_to_the_shared_folder(spark):
    df = runtime.stage(spark.range(10), "ten")
    assert df.count() == 10 and all(f.startswith(spark.conf.get("spark.checkpoint.dir")) for f in df.inputFiles())
    runtime.drop_staged(df)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(df.inputFiles()[0])


def test_nothing_else_needs_the_training_data_operators():
    from pathlib import Path

    root = Path(runtime.__file__).parent
    for f in root.rglob("*.py"):
        if root / "llm" not in f.parents:
            assert "spanforge.llm" not in f.read_text(), f
