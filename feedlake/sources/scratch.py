"""Tables written to the shared folder and read back, which ends lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; only a local session without that setting gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_dirs.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-core-"))


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/core-{uuid.uuid4().hex}/{tag}"


def written(df: DataFrame, tag: str, codec: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: the plan starts anew with the size of real files, and a lost executor costs no rerun."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)
