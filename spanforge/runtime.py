"""What every operator needs from the session: the shared folder, staged tables, a path for Python workers."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a side may have at most to be broadcast by `attach`.
BROADCAST_ROWS = 100_000
#: Rows that go to a Python worker at once: documents may be long, and two workers share an executor's memory.
ARROW_ROWS = 4000
#: Numbers (longs) that `among` broadcasts at most: 16 MB.
BROADCAST_KEYS = 1 << 21
#: Rows of one key from which `attach_copies` counts it as hot.
COPIES = 10_000
#: Copies of each row of the smaller side in a salted join.
SALTS = 16


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package where the launcher did not put it on their path, and send them moderate batches."""
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([root, *paths])
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (only where that is unset and all runs in one process) a local one."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        there = "file://" + tempfile.mkdtemp(prefix="spanforge-")
        spark.conf.set("spark.checkpoint.dir", there)
    return f"{there.rstrip('/')}/spanforge-{spark.sparkContext.applicationId}"


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df_or_path: DataFrame | str, spark: SparkSession | None = None) -> None:
    """Delete a staged table that no later plan reads."""
    if isinstance(df_or_path, str):
        paths = [df_or_path]
    else:
        spark = df_or_path.sparkSession
        paths = sorted({f.rsplit("/", 1)[0] for f in df_or_path.inputFiles()})
    jvm = spark._jvm
    for p in paths:
        if "/spanforge-" in p:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def attach(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join a staged table with one row per key to a large one, whatever the skew of the large one.

    At most BROADCAST_ROWS rows are broadcast. A longer table is joined by key and salt: its rows are
    repeated SALTS times and a hot key of the large side is spread over as many tasks. Null keys match
    null keys. The key columns of the small side are dropped.
    """
    renamed = small
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__sf_{k}")

    def equal(extra=None):
        cond = extra
        for k in keys:
            c = big[k].eqNullSafe(renamed[f"__sf_{k}"])
            cond = c if cond is None else cond & c
        return cond

    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        out = big.join(F.broadcast(renamed), equal(), how)
    else:
        big = big.withColumn("__sf_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns if c not in keys] or F.lit(0)), F.lit(SALTS)).cast("int"))
        renamed = renamed.withColumn("__sf_salt2", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        out = big.join(renamed, equal(big["__sf_salt"] == renamed["__sf_salt2"]), how).drop("__sf_salt", "__sf_salt2")
    return out.drop(*[f"__sf_{k}" for k in keys])


def among(big: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of big whose key is (left_semi) or is not (left_anti) in a staged table of one column of longs.

    Up to BROADCAST_KEYS of them, counted first, are broadcast, and big stays where it is; more are joined by key.
    """
    (name,) = keys.columns
    few = keys.count() <= BROADCAST_KEYS
    return big.join(F.broadcast(keys) if few else keys, name, how)


def attach_copies(big: DataFrame, small: DataFrame, key: str | list[str], copies: str, hot: int = COPIES) -> DataFrame:
    """Inner join of a staged table with a staged one of a row per key (one column or several, none null), whose column
    `copies` says how many rows big has of it.

    Keys with more than `hot` rows, which are few, are attached apart: they are broadcast, or salted if they are not few after all.
    """
    keys = [key] if isinstance(key, str) else key
    busy = stage(small.where(F.col(copies) > hot), "hot-keys")
    cold = big.join(small.where(F.col(copies) <= hot), keys)
    return cold.unionByName(attach(big, busy, keys, "inner").select(*cold.columns))
