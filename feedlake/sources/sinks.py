"""Idempotent snapshot sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_snapshot(old: DataFrame | None, new: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of both with the newest version of each key; writing the same batch again changes nothing."""
    rows = new if old is None else old.unionByName(new, allowMissingColumns=True)
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), version).alias("_r")).select(key, "_r.*")


def snapshot_writer(path: str, key: str, version: str):
    """A foreachBatch function: each batch is merged into the next numbered snapshot under ``path``; a batch that runs again
    starts from the one before it, so its result is the same."""

    def write(batch: DataFrame, number: int) -> None:
        old = batch.sparkSession.read.parquet(f"{path}/v{number - 1}") if number else None
        upsert_snapshot(old, batch, key, version).write.mode("overwrite").parquet(f"{path}/v{number}")

    return write
