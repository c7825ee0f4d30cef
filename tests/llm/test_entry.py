"""The registered queries themselves: names, types and what the contracts fix; SQL for those that have it, with a host that goes."""

import zlib
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from spanforge.llm import pivots, quality, toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="the driver's tables are not here")

KINDS = {
    "op1_pii": {"n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op2_packing": {"piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op3_rans": {"start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op4_quality": {"n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op6_gru_lm": {"held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op8_simhash": {"fingerprint": "string"},
    "op10_mixing": {"size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
}


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").df()


@pytest.mark.parametrize("name", KINDS)
def test_names_types_and_rows(spark, docs, name):
    got = entry.queries()[name](spark, SF)
    kinds = dict(got.dtypes)
    assert {k: kinds.get(k) for k in KINDS[name]} == KINDS[name]
    rows = got.toPandas()
    if name == "op2_packing":
        rows = rows[rows["piece"] == 0]
    assert sorted(rows["doc_id"]) == sorted(docs["doc_id"])


def test_mixing_takes_about_its_targets(spark):
    rows = entry.queries()["op10_mixing"](spark, SF).toPandas()
    assert (rows["taken"] <= 2 * rows["size"]).all()
    for _, group in rows.groupby("source_size"):
        assert abs(group["taken"].sum() - group["target"].iloc[0]) <= 0.35 * group["target"].iloc[0] + group["size"].max()


def test_language_model_beats_the_counts_on_held_out_documents(spark):
    rows = entry.queries()["op6_gru_lm"](spark, "/root/testdata/sf0.01" if Path("/root/testdata/sf0.01").is_dir() else SF).toPandas()
    held = rows[rows["held_out"]]
    assert all(zlib.crc32(str(i).encode()) % 5 == 1 for i in held["doc_id"]) and held["score"].sum() > held["base_score"].sum()


@pytest.mark.parametrize("name", ["op4_quality", "op10_mixing"])
@pytest.mark.parametrize("bad_host", [False, True])
def test_same_as_sql(spark, tmp_path, name, bad_host):
    frame = duckdb.sql(f"SELECT * FROM '{SF}/documents.parquet'").df()
    if bad_host:
        junk = [{"doc_id": 10_000 + i, "text": "too short" if i % 12 else " ".join(f"w{k}" for k in range(70)), "lang": "en", "source": "bad.example", "n_chars": 9} for i in range(90)]
        frame = pd.concat([frame, pd.DataFrame(junk)], ignore_index=True)
    duckdb.sql("SELECT * FROM frame").write_parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = con.execute(entry.oracle_sql()[name]).fetchdf()
    got = entry.queries()[name](spark, str(tmp_path)).toPandas()
    key = sorted(want.columns)
    a, b = (x[key].sort_values("doc_id").reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-12)
    if name == "op4_quality":
        assert a["host_rejected"].any() == bad_host


def test_hosts_may_be_numbers(spark):
    df = spark.createDataFrame([(i, "word " * 3 if i % 2 else " ".join(f"w{k}" for k in range(60)), i % 4) for i in range(40)], "doc_id long, text string, source int")
    assert quality.verdicts(df).count() == 40 and quality.keep(df).columns == df.columns


def test_clashing_columns(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 8))
    x = np.concatenate([x, x + rng.normal(size=x.shape) * 1e-3])
    df = spark.createDataFrame([(i, 1, v.tolist(), i, i, i) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>, row int, nid int, copies int")
    got = pivots.near_duplicates(df).collect()
    assert len(got) == 60 and all(r["n_links"] == 1 and r["component_id"] == r["vec_id"] % 30 for r in got)
    texts = spark.createDataFrame([(i, "bad awful " * 3 if i % 2 else "good kind " * 3, i, i, i) for i in range(40)], "doc_id long, text string, y0 int, key int, one int")
    labels = spark.createDataFrame([(i, i % 2, 7, 7) for i in range(40)], "doc_id long, toxic int, y0 int, text int")
    found = toxicity.classify(texts, labels, ["toxic"]).collect()
    assert len(found) == 40 and all(r["is_toxic"] == bool(r["doc_id"] % 2) for r in found)


def test_pivots_find_links_at_the_threshold(spark):
    """Recall against brute force where every planted pair is at a cosine just above the threshold: at least 0.98."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(1500, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=base.shape)
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = 0.9801
    x = np.concatenate([base, c * base + np.sqrt(1 - c * c) * side])
    x = np.concatenate([x, rng.normal(size=(1000, 32))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = int((np.triu(unit @ unit.T, 1) >= 0.98).sum())
    df = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>")
    got = pivots.near_duplicates(df).agg(F.sum("n_links")).first()[0]
    assert want >= 1500 and 0.98 * want <= got / 2 <= want
