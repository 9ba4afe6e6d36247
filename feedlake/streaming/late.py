"""Late rows: each micro-batch is split by its time against the mark of the batches before it, and nothing is dropped unseen."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.sources.snapshots import Snapshot, merge_articles

DELAY_MS = 120_000


def late_writer(path: str, snapshot: Snapshot, time: str, on_time: Callable[[DataFrame], DataFrame], keep_ms: int, delay_ms: int = DELAY_MS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function with a side path for late rows.

    The mark is the newest ``time`` (ms) of the batches before. Rows at most ``delay_ms`` behind it are on time: ``on_time`` of them is written to ``on_time/v<n>``. Older ones
    are late; all rows of the batch are merged into ``snapshot``, where a late row adds what it tells and keeps the publication that is known. Rows more than
    ``keep_ms`` behind, or without a time, are too late: they go to ``too_late/v<n>`` with the mark that they missed, and nowhere else. ``report/v<n>`` has the counts and the new mark. All is written anew
    if a batch runs again, from the report of the batch before it.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        mark = spark.read.parquet(f"{path}/report/v{number - 1}").first().mark if number else None
        floor = (mark - delay_ms, mark - keep_ms) if mark is not None else (None, None)
        at = F.col(time)
        fine = at.isNotNull() if mark is None else at >= floor[0]
        kind = F.when(F.coalesce(fine, F.lit(False)), "on_time").when(F.lit(False) if mark is None else F.coalesce(at >= floor[1], F.lit(False)), "late").otherwise("too_late")
        batch.withColumn("kind", kind).write.mode("overwrite").partitionBy("kind").parquet(f"{path}/batch/v{number}")
        rows = spark.read.schema(batch.schema.add("kind", "string")).parquet(f"{path}/batch/v{number}")
        on_time(rows.where("kind = 'on_time'").drop("kind")).write.mode("overwrite").parquet(f"{path}/on_time/v{number}")
        snapshot.merge(rows.where("kind <> 'too_late'").drop("kind"), number, merge_articles)
        rows.where("kind = 'too_late'").drop("kind").withColumn("mark", F.lit(mark).cast("long")).write.mode("overwrite").parquet(f"{path}/too_late/v{number}")
        count = lambda k: F.count_if(F.col("kind") == k).alias(k)
        newest = F.greatest(F.max(F.when(F.col("kind") == "on_time", at)), F.lit(mark).cast("long")).alias("mark")
        rows.agg(count("on_time"), count("late"), count("too_late"), newest).coalesce(1).write.mode("overwrite").parquet(f"{path}/report/v{number}")

    return write
