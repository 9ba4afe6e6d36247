"""Input tables of the engine, derived from the given Parquet tables by arithmetic on keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.functions.text import sha_id, ws_norm

#: 2024-01-01 and 2024-01-31 in UTC milliseconds; every time-dependent query takes ``NOW`` as a parameter.
START, NOW = 1704067200000, 1706659200000

MONITORS = [
    # id, ord, mode, likes, reposts, replies, exclude replies, observe minutes, relevance, value, notify unverified, cooldown, created, window h, curated, blocked, followed, keywords, aliases, excludes
    ("m0", 0, "loose", 0, 0, 0, False, 0, 0, 0, True, 0, START, 72, True, ["author3"], [], "the", "an,le", "zzz"),
    ("m1", 1, "standard", 0, 0, 0, True, 1440, 40, 20, False, 60, START + 86400000, 240, True, ["author7"], ["author14"], "with", "of, that\nde", "edth"),
    ("m2", 2, "strict", 0, 0, 0, True, 2880, 65, 0, False, 1440, START, 24, False, [], ["author2"], "release", "ing", "erin,haing"),
    ("m3", 3, "custom", 20, 2, 3, False, 40320, 80, 50, True, 10080, START + 864000000, 720, True, ["author9"], ["author21"], "les", "der,die", ""),
]
MONITOR_DDL = """monitor_id string, ord int, mode string, min_likes long, min_reposts long, min_replies long, exclude_replies boolean, observation_minutes long,
min_relevance long, min_value long, notify_unverified boolean, cooldown_minutes long, created_at long, window_hours long, use_curated boolean,
blocked array<string>, followed array<string>, keywords string, aliases string, excludes string"""
PUBLISHERS = [
    ("p1", "domain", "site1.example.com", 1), ("p1", "x", "author1", 1), ("p2", "domain", "example.org", 2), ("p3", "domain", "site2.example.com", 3),
    ("p3", "github", "author14", 3), ("p3", "x", "author7", 3), ("p4", "domain", "site3.example.com", 4), ("p4", "domain", "site1.example.com", 4),
    ("p5", "domain", "site7.example.com", 5), ("p5", "github", "author20", 5), ("p6", "domain", "site12.example.com", 6), ("p6", "x", "author18", 6),
]
ACCOUNTS = [("author2", "official", True), ("author9", "expert", True), ("author16", "expert", False), ("author24", "official", True), ("author30", "expert", True)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; only the columns that a query uses are read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles from documents; published_at 0 means unknown."""
    return table(spark, sf_dir, "documents").select(
        sha_id(F.concat(F.lit("doc:"), F.col("doc_id"))).alias("article_id"), "doc_id",
        F.expr("element_at(array('x','hn','github','rss','google','bing'), CAST(doc_id % 6 + 1 AS INT)) AS source"),
        F.expr("concat('author', doc_id * 7 % 40) AS author"),
        F.expr(f"IF(doc_id % 17 = 0, 0L, {START} + (doc_id * 7919 % 2592000) * 1000) AS published_at"),
        F.expr(f"{START} + (doc_id * 7919 % 2592000 + doc_id % 5400) * 1000 AS collected_at"),
        F.expr(f"IF(doc_id % 3 = 0, {START} + (doc_id * 7919 % 2592000 + 200000) * 1000, NULL) AS checked_at"),
        F.expr("CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN doc_id * 31 % 120 ELSE doc_id % 10 END AS likes"),
        F.expr("doc_id * 13 % 4 AS reposts"), F.expr("doc_id * 17 % 6 AS replies"), F.expr("doc_id % 5 = 0 AS is_reply"),
        F.expr("doc_id % 6 = 1 OR doc_id % 13 = 0 AS is_repost"), F.expr("doc_id % 7 = 0 AS is_blue"),
        F.expr("CASE WHEN doc_id % 6 >= 3 THEN 'web' WHEN doc_id % 6 = 1 THEN 'discussion' WHEN doc_id % 6 = 2 THEN IF(doc_id % 4 = 0, 'release', 'repository') ELSE 'post' END AS content_kind"),
        F.expr("CASE WHEN doc_id % 6 < 3 THEN 'native' WHEN doc_id % 5 = 0 THEN 'snippet' WHEN doc_id % 7 = 0 THEN 'failed' ELSE 'full' END AS content_status"),
        F.expr("concat('https://site', doc_id % 25, '.example.com/post/', doc_id % 950) AS url"),
        F.expr("IF(doc_id % 2 = 0, concat('site', doc_id % 25, '.example.com'), 'other.example.com') AS origin_key"),
        F.expr("concat('m', doc_id % 4) AS monitor_id"),
        F.coalesce("text", F.lit("")).alias("text"), ws_norm(F.coalesce("text", F.lit(""))).alias("text_norm"),
        F.substring(ws_norm(F.coalesce("text", F.lit(""))), 1, 60).alias("title"),
    )


def monitors(spark: SparkSession) -> DataFrame:
    """Channel rules, one for each engagement mode: a literal dimension."""
    return spark.createDataFrame(MONITORS, MONITOR_DDL)


def publishers(spark: SparkSession) -> DataFrame:
    """The publisher directory, exploded to one row for each key."""
    return spark.createDataFrame(PUBLISHERS, "publisher_id string, kind string, key string, ord int")


def accounts(spark: SparkSession) -> DataFrame:
    """Curated accounts."""
    return spark.createDataFrame(ACCOUNTS, "handle string, kind string, active boolean")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence rows of events: five articles in a row make an event."""
    a = articles(spark, sf_dir)
    return a.select(
        F.expr("concat('e', doc_id div 5) AS event_id"), F.expr("CAST(doc_id % 5 AS INT) AS pos"), "article_id",
        F.expr("element_at(array('first_party','independent','repost','unknown','independent'), CAST(doc_id % 5 + 1 AS INT)) AS role"),
        F.expr("concat(IF(doc_id % 5 = 4, 'zz', ''), substring(text, 11, 60)) AS excerpt"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their scalar fields and ordered evidence ids."""
    a = articles(spark, sf_dir).withColumn("g", F.expr("doc_id div 5"))
    return (
        a.groupBy("g").agg(
            F.min("collected_at").alias("first_discovered_at"), F.max("collected_at").alias("updated_at"),
            F.min(F.when(F.col("published_at") > 0, F.col("published_at"))).alias("published_at"),
            F.min_by("title", "doc_id").alias("summary"),
            F.expr("transform(array_sort(collect_list(struct(doc_id, article_id))), x -> x.article_id) AS evidence"),
        ).select(
            F.expr("concat('e', g) AS event_id"), F.expr("concat('m', g % 5) AS monitor_id"), F.expr("g * 37 % 101 AS relevance"),
            F.expr("IF(g % 19 = 0, NULL, g * 53 % 101) AS value"),
            F.expr("element_at(array('supported','corroborated','unverified','disputed'), CAST(g div 4 % 4 + 1 AS INT)) AS credibility"),
            F.expr("element_at(array('urgent','high','medium','low',NULL), CAST(g % 5 + 1 AS INT)) AS importance"),
            F.expr("concat('Event ', g) AS title"), "summary", "first_discovered_at", "updated_at", "published_at",
            F.expr("IF(g % 3 = 0, first_discovered_at + (g % 50) * 3600000, NULL) AS notified_at"), F.expr("g % 4 + 1 AS revision"), "evidence",
        )
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request log from the events table: time in ms, category, reserved and used tokens."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), F.expr("unix_micros(CAST(ts AS timestamp)) div 1000 AS at_ms"), F.col("event_type").alias("category"), "user_id",
        F.expr("100 + CAST(floor(coalesce(value, 0)) AS BIGINT) AS reserved"), F.expr("IF(event_type = 'error', NULL, CAST(floor(coalesce(value, 0)) AS BIGINT)) AS tokens"),
    )
