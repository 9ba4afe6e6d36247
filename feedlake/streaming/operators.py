"""Structured Streaming operators and their batch twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .processors import MINUTE, Cooldown, InOrder, Observation, Rule

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The time of closing rows; pandas takes no later century.
CLOSING = "2200-01-01 00:00:00"


def in_order(rows: DataFrame, processor: InOrder, key: str, time: str, delay: str, schema: str) -> DataFrame:
    """``rows`` through a processor that gets those of each key in order of time, once the watermark has passed them. Rows with a null key move the watermark only."""
    late = rows.withWatermark(time, delay)
    return late.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "EventTime").where(F.col(key).isNotNull())


def distinct_in_window(stream: DataFrame, key: str, time: str, delay: str = "2 minutes") -> DataFrame:
    """Rows once for each key while the watermark holds them: re-read overlaps are absorbed."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def usage_windows(stream: DataFrame, time: str, category: str, delay: str = "2 minutes") -> DataFrame:
    """Calls by UTC+8 day and category over tumbling windows that begin at 16:00 UTC; in append mode a window comes when the watermark has passed its end (that of a closing row never does)."""
    w = F.window(time, "1 day", startTime="16 hours")
    return stream.withWatermark(time, delay).groupBy(w, category).agg(F.count(F.lit(1)).alias("calls")).select(F.col("window.start").alias("start"), category, "calls")


def usage_windows_batch(rows: DataFrame, time: str, category: str) -> DataFrame:
    """The batch twin of usage_windows()."""
    return rows.groupBy(F.window(time, "1 day", startTime="16 hours").alias("window"), category).agg(F.count(F.lit(1)).alias("calls")).select(F.col("window.start").alias("start"), category, "calls")


def cooldown(stream: DataFrame, gap_ms: int, delay: str = "10 minutes") -> DataFrame:
    """Notices (key, at) that come ``gap_ms`` or more after the last one that was let through, as (key, at_ms).

    Rows wait in state until the watermark, ``delay`` behind the newest row, has passed them, and are taken in order of time, whatever batches they
    came in. A key's state goes when its gap is over.
    """
    return in_order(stream.select("key", "at"), Cooldown(gap_ms), "key", "at", delay, "key long, at_ms long")


def cooldown_batch(rows: DataFrame, gap_ms: int) -> DataFrame:
    """The batch twin of cooldown(): a native fold over each key's times."""
    times = rows.groupBy("key").agg(F.array_sort(F.collect_list("at_ms")).alias("ts"))
    start = F.array().cast("array<bigint>")
    kept = F.aggregate("ts", start, lambda out, t: F.when((F.size(out) == 0) | (t - F.element_at(out, -1) >= gap_ms), F.concat(out, F.array(t))).otherwise(out))
    return times.select("key", F.explode(kept).alias("at_ms"))


def observe(posts: DataFrame, checks: DataFrame, rule: Rule, delay: str = "10 minutes") -> DataFrame:
    """Observation timer over two streams, as (article, verdict, at_ms): posts (article, at, published_ms, likes, exempt), ``at`` being when they were collected, and metric checks (article, at, likes).

    A post passes (``pending``) when it is exempt or a metric reaches ``least``, is ``filtered`` by the first check at or after its deadline that does not, and waits otherwise, so a
    missing check never filters. It is decided at once if there are no minutes to wait, its publication is unknown (0), or it was collected at the deadline or later. An event-time timer
    fires at the deadline and then every ``retry_minutes``: each time a waiting post is ``due`` for a check; ``keep_minutes`` after the deadline it is ``expired``. Every verdict but ``due`` frees the state.
    """
    kinds = "article", "at", "kind", "likes", "published_ms", "exempt"
    p = posts.select("article", "at", F.lit(0).alias("kind"), "likes", "published_ms", "exempt")
    c = checks.select("article", "at", F.lit(1).alias("kind"), "likes", F.lit(0).cast("long").alias("published_ms"), F.lit(False).alias("exempt"))
    return in_order(p.unionByName(c).select(*kinds), Observation(rule), "article", "at", delay, "article long, verdict string, at_ms long")


def observe_batch(posts: DataFrame, checks: DataFrame, rule: Rule, until_ms: int) -> DataFrame:
    """The batch twin of observe() up to the time ``until_ms``, with ``observing`` for posts that still wait then. An article's first post counts."""
    ms = lambda c: F.unix_millis(c)
    first = posts.groupBy("article").agg(F.min(F.struct("at", "published_ms", "likes", "exempt")).alias("p")).select("article", "p.*")
    deadline = F.col("published_ms") + rule.minutes * MINUTE
    p = first.select("article", ms(F.col("at")).alias("at_ms"), "likes", "exempt", "published_ms", deadline.alias("deadline"))
    at_once = (F.lit(rule.minutes) == 0) | (F.col("published_ms") == 0) | (F.col("at_ms") >= F.col("deadline"))
    p = p.withColumn("verdict", F.when(F.col("exempt") | (F.coalesce("likes", F.lit(0)) >= rule.least), "pending").when(at_once, "filtered"))
    seen = checks.select("article", ms(F.col("at")).alias("t"), (F.coalesce("likes", F.lit(0)) >= rule.least).alias("ok"))
    end = F.col("deadline") + rule.keep_minutes * MINUTE
    hits = p.where("verdict IS NULL").join(seen.hint("merge"), "article").where((F.col("t") >= F.col("at_ms")) & (F.col("t") <= end) & (F.col("t") <= until_ms) & (F.col("ok") | (F.col("t") >= F.col("deadline"))))
    met = hits.groupBy("article").agg(F.min(F.struct("t", (~F.col("ok")).alias("failed"))).alias("m"))
    rows = p.join(met.hint("merge"), "article", "left")
    verdict = F.coalesce("verdict", F.when(F.col("m").isNotNull(), F.when(F.col("m.failed"), "filtered").otherwise("pending")).when(end <= until_ms, "expired").otherwise("observing"))
    decided = F.when(F.col("verdict").isNotNull(), F.col("at_ms")).when(F.col("m").isNotNull(), F.col("m.t")).when(end <= until_ms, end)
    last_due = F.least(F.coalesce(F.col("m.t"), end) - 1, F.lit(until_ms))
    due = F.when(F.col("verdict").isNull() & (F.col("deadline") <= last_due), F.sequence(F.col("deadline"), last_due, F.lit(rule.retry_minutes * MINUTE)))
    dues = rows.select("article", F.lit("due").alias("verdict"), F.explode(due).alias("at_ms"))
    return rows.select("article", verdict.alias("verdict"), decided.alias("at_ms")).unionByName(dues)


def run_available(df: DataFrame, checkpoint: str, path: str | None = None) -> DataFrame:
    """Runs a stream over what is there now, in append mode, and returns all rows it has appended so far: Parquet beside the checkpoint (or at ``path``). State is kept in RocksDB."""
    spark = df.sparkSession
    path = path or f"{checkpoint}-out"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def run_closed(make: Callable[[DataFrame], DataFrame], stream: DataFrame, time: str, checkpoint: str) -> DataFrame:
    """run_available() of ``make(stream)``, then once more with a closing row (nulls but for a ``time`` after all others), which moves the watermark past all rows, so that nothing waits any longer.

    The closing row lies in a folder beside the checkpoint that is part of the stream; ``make`` must take rows of nulls, which form no group of their own.
    """
    spark = stream.sparkSession
    folder = f"{checkpoint}-closing"
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(folder)
    both = make(stream.unionByName(spark.readStream.schema(stream.schema).parquet(folder)))
    run_available(both, checkpoint)
    end = [F.lit(CLOSING).cast("timestamp").alias(f.name) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema]
    spark.range(1).select(*end).write.mode("append").parquet(folder)
    return run_available(both, checkpoint)
