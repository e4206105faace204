"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_HOT_KEYS = 1000  # of the keys of a table no more than this many can hold more than its thousandth part each


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy scan of one Parquet table of a data folder."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the one the cluster names in spark.checkpoint.dir.

    Only a local master (one process) without that setting gets a temporary folder, removed at exit; on a
    cluster, one of separate local processes included, an error is raised without it, as a
    machine-local folder would be lost with its machine.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if not wanted:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        wanted = tempfile.mkdtemp(prefix="quillmesh-checkpoint-")
        atexit.register(shutil.rmtree, wanted, ignore_errors=True)
    sc.setCheckpointDir(wanted)
    return wanted


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def task_count(spark: SparkSession) -> int:
    """How many tasks a Python stage should have at least: shuffle partitions, or three a core if that is more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over enough tasks for work in Python.

    By keys: hash partitioned into ``task_count`` partitions, which adaptive execution doesn't coalesce (a later
    grouping by the keys needs no other shuffle). Without keys: only if the input is too small to be split
    into two tasks a core by itself; large inputs are left as they are scanned.
    """
    spark = df.sparkSession
    if keys:
        return df.repartition(task_count(spark), *keys)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return df if size >= 2 * spark.sparkContext.defaultParallelism * split else df.repartition(task_count(spark))


def salt_hot(rows: DataFrame, sized: DataFrame, keys: list[str], by: str, *, per_part: int = 20_000, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Two sides for a join on ``keys`` and ``part`` in which no key is hot.

    ``rows`` is the large side; ``part`` splits its rows of a hot key by the hash of ``by``. ``sized`` has one row a
    key with ``n``, its number of rows; each of a hot key is repeated for every part. A key is hot with at least
    ``per_part`` rows and the thousandth part of all, so at most ``MOST_HOT_KEYS`` keys are sent to every task. ``total``, the number of
    rows or more, is counted from ``sized`` if it isn't given.
    """
    if total is None:
        total = sized.agg(F.sum("n")).first()[0] or 0
    least = max(per_part, -(-total // MOST_HOT_KEYS))
    hot = sized.where(F.col("n") >= least).select(*keys, F.ceil(F.col("n") / per_part).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn("part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("parts")
    repeated = sized.withColumn("part", F.explode(F.sequence(F.lit(0), F.when(F.col("n") >= least, F.ceil(F.col("n") / per_part).cast("int")).otherwise(1) - 1)))
    return salted, repeated
