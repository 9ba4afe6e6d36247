"""Events: hydration, scores, feed filter and sort, notifications and incremental maintenance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import MODES


@dataclass(frozen=True)
class FeedFilters:
    """Dimensions of a feed query; the defaults keep everything."""

    time_field: str = "discovery"
    hours: int | None = None
    monitor_ids: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    credibility: str = "all"
    importance: str = "all"
    min_relevance: int = 0
    query: str = ""
    account_scope: str = "all"
    engagement: str = "all"
    custom: tuple[int, int, int] = (0, 0, 0)
    sort: str = "recommended"


def hydrate(events: DataFrame, articles: DataFrame, *fields: str) -> DataFrame:
    """Adds ``articles``: the event's articles in evidence order; ids without an article drop out."""
    links = events.select("event_id", F.posexplode("evidence").alias("pos", "article_id"))
    rows = links.join(articles.select("article_id", *fields).hint("merge"), "article_id")
    lists = rows.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("pos", "article_id", *fields))).alias("articles"))
    return events.join(lists.hint("merge"), "event_id", "left").withColumn("articles", F.coalesce("articles", F.array().cast(lists.schema["articles"].dataType)))


def social_heat(articles: Column) -> Column:
    """Likes + 3 reposts + 2 replies over the posts of an event."""
    one = lambda x: F.coalesce(x["likes"], F.lit(0)) + 3 * F.coalesce(x["reposts"], F.lit(0)) + 2 * F.coalesce(x["replies"], F.lit(0))
    return F.aggregate(F.filter(articles, lambda x: x["source"] == "x"), F.lit(0).cast("long"), lambda t, x: t + one(x))


def hotspot_score(hydrated: DataFrame, now: int, growth: Column | None = None) -> DataFrame:
    """Adds the parts (0 to 1) and the rounded, clamped score of each event. Articles need group_key, published_at and metrics."""
    newest = F.array_max(F.transform("articles", lambda x: x["published_at"]))
    age = F.greatest(F.lit(0.0), (F.lit(now) - newest) / 86400000.0)
    fresh = F.when(F.coalesce(newest, F.lit(0)) > 0, F.greatest(F.lit(0.0), 1 - age / 7)).otherwise(0.0)
    weight = lambda x: F.coalesce(x["likes"], F.lit(0)) + 3 * F.coalesce(x["replies"], F.lit(0)) + 4 * F.coalesce(x["reposts"], F.lit(0))
    most = F.array_max(F.transform("articles", lambda x: F.least(F.lit(1.0), F.log10(1.0 + weight(x)) / 4)))
    groups = F.size(F.array_distinct(F.transform("articles", lambda x: x["group_key"])))
    grown = F.lit(0.0) if growth is None else F.when(growth > 0, F.least(F.lit(1.0), F.log10(1.0 + growth) / 3)).otherwise(0.0)
    parts = hydrated.withColumns({"freshness": fresh, "engagement": F.coalesce(most, F.lit(0.0)), "diversity": F.least(F.lit(1.0), groups / 3.0), "growth": grown})
    score = F.round(0.4 * F.col("relevance") + 20 * F.col("freshness") + 20 * F.col("engagement") + 10 * F.col("diversity") + 10 * F.col("growth"))
    return parts.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)).cast("long"))


def evidence_group(publisher: Column, original_url: Column, content_hash: Column, origin_key: Column) -> Column:
    """The independence group of an article: publisher, else original URL, else content hash, else origin."""
    tagged = lambda tag, c: F.when(c.isNotNull(), F.concat(F.lit(tag), c))
    return F.coalesce(tagged("publisher:", publisher), tagged("url:", original_url), tagged("hash:", content_hash), F.concat(F.lit("origin:"), origin_key))


def feed(hydrated: DataFrame, monitors: DataFrame, f: FeedFilters, now: int, handles: DataFrame | None = None, official: tuple[str, ...] = ()) -> DataFrame:
    """Events that pass the channel gates and every dimension of the filter; a conjunction that Catalyst orders."""
    gates = F.broadcast(monitors.select("monitor_id", F.col("min_relevance").alias("_relevance"), F.col("min_value").alias("_value")))
    rows = hydrated.join(gates, "monitor_id").where((F.col("relevance") >= F.col("_relevance")) & (F.coalesce("value", F.lit(100)) >= F.col("_value")))
    if f.hours is not None:
        time = F.col("published_at" if f.time_field == "publication" else "first_discovered_at")
        rows = rows.where((F.coalesce(time, F.lit(0)) > 0) & (time >= now - f.hours * 3600000))
    if f.monitor_ids:
        rows = rows.where(F.col("monitor_id").isin(*f.monitor_ids))
    if f.sources:
        rows = rows.where(F.exists("articles", lambda x: x["source"].isin(*f.sources)))
    if f.credibility != "all":
        rows = rows.where(F.col("credibility") == f.credibility)
    if f.importance != "all":
        rows = rows.where(F.coalesce("importance", F.lit("unassessed")) == f.importance)
    rows = rows.where(F.col("relevance") >= f.min_relevance).where(F.contains(F.lower(F.concat_ws(" ", "title", "summary")), F.lit(f.query.strip().lower())))
    post = lambda x: (x["source"] == "x") & (x["content_kind"] != "web")
    if f.account_scope == "official":
        rows = rows.where(F.exists("articles", lambda x: post(x) & F.lower(x["author"]).isin(*official)))
    if f.account_scope == "curated":
        own = handles.groupBy("monitor_id").agg(F.collect_set("handle").alias("_handles"))
        rows = rows.join(F.broadcast(own), "monitor_id", "left").where(F.exists("articles", lambda x: post(x) & F.coalesce(F.array_contains("_handles", F.lower(x["author"])), F.lit(False))))
    if f.engagement != "all":
        need = MODES.get(f.engagement, f.custom)
        reach = lambda x, n, v: F.coalesce(x[n], F.lit(0)) >= v
        rows = rows.where(F.exists("articles", lambda x: post(x) & (reach(x, "likes", need[0]) | reach(x, "reposts", need[1]) | reach(x, "replies", need[2]))))
    return rows.drop("_relevance", "_value", "_handles")


def importance_rank(c: Column) -> Column:
    """urgent 4 to low 1, else 0."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, ("low", "medium", "high", "urgent"))), c), F.lit(0))


def feed_order(sort: str) -> list[Column]:
    """Sort keys of a feed; ties go to the first discovered later, then the id."""
    rank, relevance = importance_rank(F.col("importance")).desc(), F.desc("relevance")
    head = {
        "recommended": [rank, relevance], "heat": [F.desc("heat")], "relevance": [relevance], "importance": [rank],
        "publication": [F.col("published_at").desc_nulls_last()], "discovery": [F.desc("first_discovered_at")],
    }[sort]
    return [*head, F.desc("first_discovered_at"), F.asc("event_id")]


def can_notify(hydrated: DataFrame, monitors: DataFrame, now: int) -> DataFrame:
    """Adds ``notify`` and the idempotent ``notice_id`` of each event."""
    m = F.broadcast(monitors.select("monitor_id", F.col("min_relevance").alias("_r"), F.col("notify_unverified").alias("_u"), F.col("created_at").alias("_c"), F.col("cooldown_minutes").alias("_w")))
    rows = hydrated.join(m, "monitor_id")
    news = F.exists("articles", lambda x: (x["published_at"] >= F.col("_c")) & (F.col("notified_at").isNull() | (x["published_at"] > F.col("notified_at"))))
    ok = (
        (F.col("relevance") >= F.col("_r")) & (F.col("credibility") != "disputed") & ((F.col("credibility") != "unverified") | F.col("_u")) & news
        & (F.col("notified_at").isNull() | (F.lit(now) - F.col("notified_at") >= F.col("_w") * 60000))
    )
    return rows.withColumn("notify", F.coalesce(ok, F.lit(False))).withColumn("notice_id", F.substring(F.sha2(F.concat_ws(":", "event_id", "revision"), 256), 1, 32)).drop("_r", "_u", "_c", "_w")


def publishable(hydrated: DataFrame, monitors: DataFrame, now: int) -> DataFrame:
    """Adds ``publish``: relevance and value reach the channel's gates, and not all dates are known and out of the window."""
    m = F.broadcast(monitors.select("monitor_id", F.col("min_relevance").alias("_r"), F.col("min_value").alias("_v"), F.col("window_hours").alias("_w")))
    rows = hydrated.join(m, "monitor_id")
    stale = F.forall("articles", lambda x: (x["published_at"] > 0) & (x["published_at"] < F.lit(now) - F.col("_w") * 3600000))
    return rows.withColumn("publish", (F.col("relevance") >= F.col("_r")) & (F.coalesce("value", F.lit(100)) >= F.col("_v")) & ~stale).drop("_r", "_v", "_w")


def upsert_events(old: DataFrame, new: DataFrame, payload: list[str], now: int) -> DataFrame:
    """Old and new events merged: creation is sticky, update time and revision move only if the payload changed; events that
    the new batch lacks get relevance 0 and stay."""
    digest = lambda: F.sha2(F.to_json(F.struct(*payload)), 256)
    o = old.select("event_id", F.col("created_at").alias("o_created"), F.col("updated_at").alias("o_updated"), F.col("revision").alias("o_revision"), F.col("relevance").alias("o_relevance"), digest().alias("o_digest"))
    n = new.select("event_id", F.col("relevance").alias("n_relevance"), digest().alias("n_digest"))
    changed = ~F.col("o_digest").eqNullSafe(F.col("n_digest")) & F.col("n_digest").isNotNull()
    return o.join(n, "event_id", "full").select(
        "event_id", F.coalesce("o_created", F.lit(now)).alias("created_at"), F.when(changed, F.lit(now)).otherwise(F.col("o_updated")).alias("updated_at"),
        (F.coalesce("o_revision", F.lit(0)) + changed.cast("long")).alias("revision"), F.coalesce("n_relevance", F.lit(0)).alias("relevance"),
        F.when(F.col("o_digest").isNull(), "new").when(F.col("n_digest").isNull(), "retracted").when(changed, "changed").otherwise("same").alias("change"),
    )
