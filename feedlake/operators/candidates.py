"""Candidates: change digests, state transitions, verdicts and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions.text import slug


def change_digest(*parts: Column | str) -> Column:
    """One hash over everything that a verdict depends on; nulls differ from empty strings."""
    return F.sha2(F.array_join(F.array(*[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("\u0000")) for p in parts]), "\u0001"), 256)


def transition(old: DataFrame, new: DataFrame, keep: int = 5) -> DataFrame:
    """Old candidates and newly judged rows merged by id.

    An old row stays as it is if its digest is equal and neither a filtered row passes now nor observing or background begins or
    ends; else it takes the new state, drops its scores, and its verdict goes to the history (the last ``keep``, waiting states not
    recorded). ``recheck`` marks a changed row that had a group.
    """
    o = old.select("article_id", F.col("digest").alias("od"), F.col("state").alias("os"), F.col("relevance").alias("orel"), F.col("group_key").alias("og"), F.col("history").alias("oh"))
    n = new.select("article_id", F.col("digest").alias("nd"), F.col("state").alias("ns"))
    moved = (
        ((F.col("os") == "filtered") & (F.col("ns") != "filtered")) | ((F.col("os") == "observing") != (F.col("ns") == "observing")) | ((F.col("ns") == "background") & (F.col("os") != "background"))
    )
    stays = F.col("nd").isNull() | (F.col("od").isNotNull() & (F.col("od") == F.col("nd")) & ~moved)
    past = F.coalesce("oh", F.array().cast("array<string>"))
    grown = F.when(F.col("os").isNotNull() & ~F.col("os").isin("pending", "queued"), F.concat(past, F.array(F.concat_ws(":", "os", F.coalesce("orel", F.lit(0)))))).otherwise(past)
    cut = F.slice(grown, F.greatest(F.size(grown) - keep + 1, F.lit(1)), keep)
    return o.join(n, "article_id", "full").select(
        "article_id", F.when(stays, F.col("od")).otherwise(F.col("nd")).alias("digest"), F.when(stays, F.col("os")).otherwise(F.col("ns")).alias("state"), F.when(stays, F.col("orel")).alias("relevance"),
        F.when(stays, F.col("og")).alias("group_key"), F.when(stays, past).otherwise(cut).alias("history"), (~stays & F.col("og").isNotNull()).alias("recheck"),
    )


def apply_verdicts(candidates: DataFrame, verdicts: DataFrame, monitors: DataFrame) -> DataFrame:
    """States after screening: verdicts on an older digest are skipped; relevant rows are selected, or low_value under their channel's gates."""
    v = verdicts.select("article_id", F.col("digest").alias("vd"), "decision", F.col("relevance").alias("vr"), F.col("value").alias("vv"))
    m = F.broadcast(monitors.select("monitor_id", "min_relevance", "min_value"))
    rows = candidates.join(v, "article_id", "left").join(m, "monitor_id")
    fresh = F.col("vd").isNotNull() & (F.col("vd") == F.col("digest"))
    low = (F.col("vr") < F.col("min_relevance")) | (F.col("vv") < F.col("min_value"))
    state = F.when(~fresh, F.col("state")).when(F.col("decision") != "relevant", "irrelevant").when(low, "low_value").otherwise("selected")
    return rows.select("article_id", "monitor_id", state.alias("state"), F.when(fresh, F.col("vr")).alias("relevance"), F.when(fresh, F.col("vv")).alias("value"))


def event_group_key(monitor: Column, subject: Column, action: Column, version: Column, date: Column, key: Column) -> Column:
    """One key for each channel, subject, action, version, date and event name; another subject, version or date never merges.

    Subject, version and name go by slug() and a missing version is unknown; channel, action and date are taken as they are, null apart from empty.
    """
    plain = lambda c: slug(F.coalesce(c, F.lit("")))
    known = F.when(F.coalesce(version, F.lit("")) == "", "unknown").otherwise(version)
    exact = lambda c: F.coalesce(c, F.lit("\u0000"))
    return F.substring(F.sha2(F.concat_ws("\u0001", exact(monitor), plain(subject), exact(action), plain(known), exact(date), plain(key)), 256), 1, 32)


def clusters(rows: DataFrame) -> DataFrame:
    """One row for each group: members, sources and the time it began."""
    return rows.groupBy("group_key").agg(F.count(F.lit(1)).alias("n_articles"), F.countDistinct("source").alias("n_sources"), F.min("collected_at").alias("began_at"), F.min("article_id").alias("first_id"))
