"""Session building and the two things every iterative plan needs: a place for written stages and a size check."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Largest estimated size of a table that a plan here may broadcast.
BROADCAST_LIMIT = 32 << 20


def build_session(app: str = "quire", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the plans expect; a cluster's own settings win where they exist."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session; only where unset, a temporary one of our own.

    That one is on this machine, so it is for a local master only; a cluster must name its folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            at = kept.get()
        elif spark.sparkContext.master.startswith("local"):
            at = "file://" + tempfile.mkdtemp(prefix="quire-")
            atexit.register(shutil.rmtree, at[7:], True)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, what: str, by: str | None = None) -> tuple[DataFrame, str]:
    """Cuts the lineage: df written as a table into the shared folder, by: a folder for each value of that column, and read again. Survives the loss of executors."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by).option("compression", "zstd") if by else df.write).parquet(at)
    _STAGES.append(at)
    return spark.read.schema(df.schema).parquet(at), at


_STAGES: list[str] = []  # written stages that are there still


def release(spark: SparkSession) -> int:
    """Removes every written stage of this session; results that read them must be stored before. Gives how many."""
    gone = list(_STAGES)
    for at in gone:
        dropped(spark, at)
    return len(gone)


def dropped(spark: SparkSession, at: str) -> None:
    """Removes a written stage that no later plan reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if at in _STAGES:
        _STAGES.remove(at)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of df."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small_side(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """df with a broadcast hint if its estimated size is within limit, else df as it is (a shuffled join then)."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
