"""Ranking, fair sampling, packing, passages and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake.functions.text import bound


def _metric(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def quality_rank(rows: DataFrame) -> DataFrame:
    """Adds ``rank``: publisher 60, curated post 35, reply -8, full body 20, release 10, and up to 15 for engagement."""
    points = (
        F.when(F.col("publisher_id").isNotNull(), 60).otherwise(0) + F.when((F.col("source") == "x") & F.col("curated"), 35).otherwise(0)
        - F.when(F.col("is_reply"), 8).otherwise(0) + F.when(F.col("content_status") == "full", 20).otherwise(0) + F.when(F.col("content_kind") == "release", 10).otherwise(0)
    )
    return rows.withColumn("rank", points + F.least(F.lit(15.0), F.log2(1.0 + _metric("likes") + 3 * _metric("reposts"))))


def fair_sample(rows: DataFrame, limit: int, offset: int, now: int, by: str = "monitor_id") -> DataFrame:
    """At most ``limit`` rows of each ``by``, taken from sources in turn; source x is capped at 40 per cent while others have rows.

    The loop's closed form: a row's turn is its place in its source by rank plus age in hours; turns interleave the sources
    in rotated order. Windows partition by channel and source, and only the rows that a limit can take reach the last one.
    """
    aged = rows.withColumn("priority", F.col("rank") + (F.lit(now) - F.col("collected_at")) / 3600000.0)
    turn = F.row_number().over(Window.partitionBy(by, "source").orderBy(F.desc("priority"), "article_id"))
    aged = aged.withColumn("turn", turn).where(F.col("turn") <= limit)
    sources = aged.groupBy(by).agg(F.array_sort(F.collect_set("source")).alias("_sources"))
    aged = aged.join(F.broadcast(sources), by)
    n = F.size("_sources")
    cap = F.when((n > 1) & F.lit(limit >= 3), F.lit(max(1, int(0.4 * limit)))).otherwise(F.lit(limit))
    place = F.pmod(F.array_position("_sources", F.col("source")) - 1 - offset, n)
    order = Window.partitionBy(by).orderBy((F.col("source") == "x") & (F.col("turn") > cap), "turn", place)
    return aged.withColumn("taken", F.row_number().over(order)).where(F.col("taken") <= limit).drop("_sources")


def batches(sampled: DataFrame, size: int, by: str = "monitor_id") -> DataFrame:
    """Adds ``batch``: consecutive chunks of 1 to 5 rows."""
    return sampled.withColumn("batch", F.floor((F.col("taken") - 1) / max(1, min(5, size))).cast("long"))


def packed(batched: DataFrame, budget: int = 7000, longest: int = 3000, by: str = "monitor_id") -> DataFrame:
    """The rows of each batch up to the first that would overflow the character budget; the first always stays."""
    order = Window.partitionBy(by, "batch").orderBy("taken")
    used = F.sum(F.least(F.length("text"), F.lit(longest))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return batched.withColumn("used", used).withColumn("_n", F.row_number().over(order)).where((F.col("used") <= budget) | (F.col("_n") == 1)).drop("_n")


def passages(rows: DataFrame, query: Column, most: int = 3000, block: int = 750) -> DataFrame:
    """Adds ``passages`` (start, text) and ``omitted``: the best blocks of each text by query terms held, in text order.

    Higher-order functions on one row: no explode and no shuffle, whatever the length of the text.
    """
    terms = F.array_distinct(F.slice(F.regexp_extract_all(F.lower(query), F.lit(r"[a-z0-9._-]{3,}|[\x{4e00}-\x{9fff}]{2,}"), F.lit(0)), 1, 35))
    k = max(1, most // block)
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(block))

    def scored(start: Column, terms: Column) -> Column:
        low = F.lower(F.substring(F.col("text"), start + 1, F.lit(block)))
        held = bound(low, lambda b: F.size(F.filter(terms, lambda t: F.contains(b, t))))
        return F.struct((-(held * 3 + F.when(start == 0, 1).otherwise(0))).alias("s"), start.alias("start"))

    # The terms are cut from the query once, not for each block, and each block is put in lower case once, not for each term.
    best = bound(terms, lambda found: F.slice(F.array_sort(F.transform(starts, lambda start: scored(start, found))), 1, k))
    chosen = F.array_sort(F.transform(best, lambda x: x["start"]))
    cut = F.transform(chosen, lambda s: F.struct(s.alias("start"), F.substring(F.col("text"), s + 1, F.lit(block)).alias("text")))
    total = F.aggregate(F.transform(F.col("passages"), lambda p: F.length(p["text"])), F.lit(0), lambda a, b: a + b)
    return rows.withColumn("passages", cut).withColumn("omitted", total < F.length("text"))


def page_of(rows: DataFrame, order: list[Column], page: int, size: int = 30) -> DataFrame:
    """One page in order, its number clamped to what exists, with ``total``.

    The total is an aggregate of its own and the page a top-k of its last row, so no window holds all rows in one task.
    """
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    top = rows.orderBy(*order).limit(max(1, page) * size)
    place = F.row_number().over(Window.orderBy(*order))
    ranked = top.withColumn("place", place).crossJoin(F.broadcast(total))
    last = F.greatest(F.least(F.lit(page), F.ceil(F.col("total") / size)), F.lit(1))
    return ranked.where(F.ceil(F.col("place") / size) == last).withColumn("page", last)


def evidence_rotation(rows: DataFrame, by: str, most: int = 10, offset: int = 0) -> DataFrame:
    """At most ``most`` rows of each group: five not reviewed, then three of history, then all from a rotated start; once each."""
    every = Window.partitionBy(by).orderBy("collected_at", "article_id")
    rows = rows.withColumn("_i", F.row_number().over(every) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(by)))
    kind = Window.partitionBy(by, "reviewed").orderBy(F.desc("collected_at"), "article_id")
    rows = rows.withColumn("_k", F.row_number().over(kind))
    tier = F.when(~F.col("reviewed") & (F.col("_k") <= 5), 0).when(F.col("reviewed") & (F.col("_k") <= 3), 1).otherwise(2)
    spot = F.when(tier < 2, F.col("_k")).otherwise(F.pmod(F.col("_i") - offset, F.col("_n")))
    rows = rows.withColumn("_t", tier).withColumn("_s", spot)
    return rows.withColumn("pick", F.row_number().over(Window.partitionBy(by).orderBy("_t", "_s", "article_id"))).where(F.col("pick") <= most).drop("_i", "_n", "_k", "_t", "_s")
