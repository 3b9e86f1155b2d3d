"""Session helpers: tables, size-checked broadcasts, samples by hash and cutting of lineage in a shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows up to which a dimension is broadcast.
BROADCAST_ROWS = 20_000
_SCRATCH: dict[str, tuple] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The frame marked for broadcast if it has at most `limit` rows, else as it is.

    The count stops after `limit` + 1 rows, so that the check is cheap on a large frame. The check runs the frame's plan, so that one
    that costs much is `cut` first.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def hash_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About `rows` rows, those whose key's hash is below a threshold that follows from a count; all where there are no more.

    Rows with equal keys are in or out together; null keys are left out. What tasks send on is bounded by the threshold, not by their
    number, and the sample is the same at any partitioning.
    """
    total = df.count()
    if total <= rows:
        return df.where(F.col(key).isNotNull())
    return df.where(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(1 << 40)) < int((1 << 40) * rows / total)))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`. Where it is unset a local session (as in tests) gets one of its own; on a
    cluster that is an error, as its executors would write to disks of their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"{tempfile.gettempdir()}/newsgrid-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write a frame to the shared folder as Parquet and read it back: survives the loss of executors.

    The folders of an application lie in one, which `clear_cuts` removes, at the latest when the driver ends.
    """
    spark = df.sparkSession
    own = f"{shared_dir(spark)}/cuts-{spark.sparkContext.applicationId}"
    if own not in _SCRATCH:
        _SCRATCH[own] = (spark._jvm, spark._jsc)
    path = f"{own}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_cuts() -> None:
    """Remove what `cut` wrote. Frames that read it can't be used afterwards."""
    for own, (jvm, jsc) in list(_SCRATCH.items()):
        del _SCRATCH[own]
        try:
            path = jvm.org.apache.hadoop.fs.Path(own)
            path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration() if jsc is None else jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001
            continue  # the JVM is gone; the folder stays for whoever owns the shared one


atexit.register(clear_cuts)


def task_slices(spark: SparkSession) -> int:
    """Shuffle partitions of the session, for explicit repartitioning."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
