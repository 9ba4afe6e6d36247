"""Operational reports: funnels, activity, usage, quotas and high-water marks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake.functions.text import local_day


def source_funnel(judged: DataFrame) -> DataFrame:
    """Per source: collected, pending and filtered rows; a row with several discovery sources counts once for each."""
    each = judged.withColumn("source", F.explode(F.coalesce("discovery_sources", F.array("source")))) if "discovery_sources" in judged.columns else judged
    return each.groupBy("source").agg(
        F.countDistinct("article_id").alias("collected"), F.count_if(F.col("state") == "pending").alias("pending"), F.count_if(F.col("decision").isNotNull()).alias("filtered")
    )


def activity(jobs: DataFrame, now: int, allowed: list[str]) -> DataFrame:
    """Jobs by activity: running with a live lease by stage, else paused, failed, budget, retry or queued; with the channels of live rows."""
    live = (F.col("state") == "running") & (F.col("lease_until") > now)
    kind = (
        F.when(live, F.concat(F.lit("running_"), F.col("stage"))).when(~F.col("monitor_id").isin(*allowed), "paused").when(F.col("state") == "failed", "failed")
        .when(F.col("state") == "budget", "budget").when(F.coalesce(F.col("next_attempt_at") > now, F.lit(False)), "retry").otherwise("queued")
    )
    return jobs.where(F.col("state") != "done").withColumn("activity", kind).groupBy("activity").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.when(live, F.col("monitor_id")))).alias("channels"))


def daily_usage(log: DataFrame) -> DataFrame:
    """Per UTC+8 day: calls, known tokens, calls of unknown cost and what is reserved for them."""
    return log.groupBy(local_day(F.col("at_ms")).alias("day")).agg(
        F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("known"), F.count_if(F.col("tokens").isNull()).alias("unknown"),
        F.coalesce(F.sum(F.when(F.col("tokens").isNull(), F.col("reserved"))), F.lit(0)).alias("reserved"),
    )


def category_usage(log: DataFrame) -> DataFrame:
    """Calls by UTC+8 month and category."""
    return log.groupBy(F.substring(local_day(F.col("at_ms")), 1, 7).alias("month"), "category").agg(F.count(F.lit(1)).alias("calls"))


def quota_audit(log: DataFrame, check: str, per_day_check: int, per_day: int, per_month: int) -> DataFrame:
    """Adds ``admitted``: a request passes its day's cap for verifications, then its day's cap, then its month's cap.

    Three rankings of survivors. Windows partition by day, and the last by month keeps at most the days' caps, so no window
    holds more than the caps let through.
    """
    day = local_day(F.col("at_ms"))
    rows = log.withColumn("day", day).withColumn("is_check", F.col("category") == check)
    order = ["at_ms", "request_id"]
    checks = rows.where("is_check").withColumn("r", F.row_number().over(Window.partitionBy("day").orderBy(*order))).where(F.col("r") <= per_day_check).drop("r")
    first = rows.where(~F.col("is_check")).unionByName(checks)
    second = first.withColumn("r", F.row_number().over(Window.partitionBy("day").orderBy(*order))).where(F.col("r") <= per_day).drop("r")
    third = second.withColumn("r", F.row_number().over(Window.partitionBy(F.substring("day", 1, 7)).orderBy(*order))).where(F.col("r") <= per_month)
    return rows.select("request_id", "day", "category").join(third.select("request_id", F.lit(True).alias("admitted")), "request_id", "left").withColumn("admitted", F.coalesce("admitted", F.lit(False)))


def budget_fold(log: DataFrame, calls: int, tokens: int, share: float = 0.8, stage: Column | None = None) -> DataFrame:
    """Per day: how many requests a budget of calls and tokens admits in order, where screening may use ``share`` of both.

    A request that is too large is refused and a later smaller one may pass, so order matters: days are dealt out and sorted, Spark spilling as it must, and each day's rows stream past a
    state of three numbers. No day is held whole.
    """
    kind = F.lit(True) if stage is None else F.coalesce(stage, F.lit(False))
    rows = log.select(local_day(F.col("at_ms")).alias("day"), "at_ms", "request_id", kind.alias("screen"), F.coalesce("tokens", "reserved", F.lit(0)).cast("long").alias("need"))
    most = {True: (int(share * calls), int(share * tokens)), False: (calls, tokens)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        day, state = None, [0, 0, 0]
        for batch in batches:
            out = []
            for d, screen, need in zip(*(batch.column(c).to_pylist() for c in ("day", "screen", "need")), strict=True):
                if d != day:
                    if day is not None:
                        out.append((day, *state))
                    day, state = d, [0, 0, 0]
                if state[0] < most[screen][0] and state[1] + need <= most[screen][1]:
                    state[0] += 1
                    state[1] += need
                else:
                    state[2] += 1
            if out:
                yield packed(out)
        if day is not None:
            yield packed([(day, *state)])

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["day", "admitted", "tokens", "refused"])

    days = rows.where(F.col("day").isNotNull()).repartition("day").sortWithinPartitions("day", "at_ms", "request_id").select("day", "screen", "need")
    return days.mapInArrow(run, "day string, admitted long, tokens long, refused long")


def high_water(runs: DataFrame, fingerprints: DataFrame, overlap_ms: int = 120_000) -> DataFrame:
    """Per channel and source: the last completed ok run under the current rule, and where the next one starts; null after a rule change."""
    ok = runs.where(F.col("status") == "ok").join(F.broadcast(fingerprints), ["monitor_id", "fingerprint"], "left_semi")
    done = ok.groupBy("monitor_id", "source").agg(F.max("completed_at").alias("completed_at"))
    every = runs.select("monitor_id", "source").distinct()
    return every.join(done, ["monitor_id", "source"], "left").withColumn("next_from", F.col("completed_at") - overlap_ms)


def run_status(reports: DataFrame) -> DataFrame:
    """Per run: failed if all reports are errors or unconfigured, partial if any is neither ok nor skipped, else success."""
    bad, fine = F.col("status").isin("error", "unconfigured"), F.col("status").isin("ok", "skipped")
    return reports.groupBy("run").agg(F.when(F.bool_and(bad), "failed").when(F.bool_or(~fine), "partial").otherwise("success").alias("status"), F.sum("n").alias("n"))


def merge_lanes(reports: DataFrame) -> DataFrame:
    """Lane reports of a run and source summed up: counts and reasons; the refresh lane's status unless it is ok, then the ladder."""
    status = F.col("status")
    every = lambda *v: F.bool_and(status.isin(*v))
    refresh = F.max(F.when((F.col("lane") == "refresh") & (status != "ok"), status))
    ladder = F.when(refresh.isNotNull(), refresh).when(every("ok", "skipped"), "ok").when(every("unconfigured"), "unconfigured").when(every("error"), "error").when(F.bool_or(status == "budget"), "budget").otherwise("partial")
    sums = reports.groupBy("run", "source").agg(F.sum("n").alias("n"), ladder.alias("status"))
    reasons = reports.select("run", "source", F.explode("reasons").alias("reason", "k")).groupBy("run", "source", "reason").agg(F.sum("k").alias("k"))
    maps = reasons.groupBy("run", "source").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "k")))).alias("reasons"))
    return sums.join(maps.hint("merge"), ["run", "source"], "left")


def metric_growth(samples: DataFrame) -> DataFrame:
    """Per article: samples and the sum of the increases between neighbours."""
    step = F.col("likes") - F.lag("likes").over(Window.partitionBy("article_id").orderBy("sampled_at", "sample_id"))
    return samples.withColumn("step", step).groupBy("article_id").agg(F.count(F.lit(1)).alias("samples"), F.coalesce(F.sum(F.when(F.col("step") > 0, F.col("step"))), F.lit(0)).alias("growth"))
