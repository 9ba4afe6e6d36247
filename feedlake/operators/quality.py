"""Channel matching, publisher resolution and ordered quality rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions.text import PROMOTION, host_of, substantive, term_list, without_links
from feedlake.sources.scratch import written

#: Likes, reposts and replies of the fixed modes (fixed values).
MODES = {"strict": (50, 10, 15), "standard": (10, 3, 5)}


def thresholds(mode: Column, likes: Column, reposts: Column, replies: Column) -> Column:
    """Engagement thresholds as a struct; null for loose, which passes everything. A missing mode is loose."""
    fixed = lambda t: F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip(("likes", "reposts", "replies"), t, strict=True)])
    own = F.struct(likes.alias("likes"), reposts.alias("reposts"), replies.alias("replies"))
    return F.when(mode == "strict", fixed(MODES["strict"])).when(mode == "standard", fixed(MODES["standard"])).when(mode == "custom", own)


def passes(limit: Column) -> Column:
    """Any metric reaches its threshold; a null metric is 0, null thresholds pass."""
    reach = [F.coalesce(F.col(n), F.lit(0)) >= limit[n] for n in ("likes", "reposts", "replies")]
    return limit.isNull() | reach[0] | reach[1] | reach[2]


def channel_terms(monitors: DataFrame) -> DataFrame:
    """One row (monitor_id, pos, term) for each of a channel's first eight terms."""
    return monitors.select("monitor_id", F.posexplode(term_list(F.col("keywords"), F.col("aliases"))).alias("pos", "term"))


def match_channels(articles: DataFrame, monitors: DataFrame, start: int, end: int, inline_terms: int = 200, gram: int = 3) -> DataFrame:
    """Pairs (article_id, monitor_id): any term is in the text, no exclude is, it is no repost and its time is in range.

    Up to ``inline_terms`` terms in all, counted first, travel as literals of one expression: no join. Beyond that each term is indexed by its rarest piece of ``gram`` characters (by the number of terms
    that have it; a shorter term by itself): the pieces of a text fetch candidate terms in a hash join, and only those are looked for in the text, which comes back by its id. So the work grows with the
    texts and the hits, not with texts times terms.
    """
    channels = monitors.select("monitor_id", term_list(F.col("keywords"), F.col("aliases")).alias("terms"), term_list(F.lit(""), F.col("excludes")).alias("stops"))
    rows = articles.where(~F.col("is_repost") & F.col("published_at").between(start, end)).select("article_id", F.lower("text").alias("low"))
    holds = lambda t: F.contains(F.col("low"), F.lower(t))
    n = channels.agg(F.sum(F.size("terms") + F.size("stops") + 1).alias("n")).first().n or 0
    if n <= inline_terms:
        known = [F.struct(F.lit(c.monitor_id).alias("monitor_id"), _texts(c.terms).alias("terms"), _texts(c.stops).alias("stops")) for c in channels.collect()]
        if not known:
            return rows.select("article_id", F.lit(None).cast("string").alias("monitor_id")).where("false")
        hits = F.filter(F.array(*known), lambda c: F.exists(c["terms"], holds) & ~F.exists(c["stops"], holds))
        return rows.select("article_id", F.explode(F.transform(hits, lambda c: c["monitor_id"])).alias("monitor_id"))
    terms = written(channels.select("monitor_id", "stops", F.explode("terms").alias("term")).withColumn("term", F.lower("term")), "terms")
    pieces = terms.select("term").distinct().select("term", F.explode(_pieces(F.col("term"), gram)).alias("g"))
    shared = pieces.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    index = pieces.join(shared.hint("merge"), "g").groupBy("term").agg(F.min(F.struct("n", "g")).alias("m")).select("term", "m.g")
    widths = sorted(r.w for r in index.select(F.length("g").alias("w")).distinct().collect())
    grams = F.array_distinct(F.concat(*[_cuts(F.col("low"), w) for w in widths]))
    found = rows.select("article_id", F.explode(grams).alias("g")).join(index.hint("merge"), "g").select("article_id", "term").distinct()
    texts = found.join(rows.hint("merge"), "article_id").where(F.contains("low", F.col("term")))
    hits = texts.join(terms.hint("merge"), "term").where(~F.exists("stops", holds))
    return hits.select("article_id", "monitor_id").distinct()


def _texts(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _cuts(text: Column, width: int) -> Column:
    """The distinct pieces of ``width`` characters."""
    starts = F.when(F.length(text) >= width, F.sequence(F.lit(1), F.length(text) - width + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(width))))


def _pieces(term: Column, width: int) -> Column:
    return F.when(F.length(term) <= width, F.array(term)).otherwise(_cuts(term, width))


def monitored_handles(monitors: DataFrame, accounts: DataFrame) -> DataFrame:
    """(monitor_id, handle): active curated accounts where the channel uses them, plus followed, minus blocked; lower case."""
    curated = monitors.where("use_curated").crossJoin(F.broadcast(accounts.where("active"))).select("monitor_id", F.lower("handle").alias("handle"))
    followed = monitors.select("monitor_id", F.explode("followed").alias("handle")).select("monitor_id", F.lower("handle").alias("handle"))
    blocked = monitors.select("monitor_id", F.explode("blocked").alias("handle")).select("monitor_id", F.lower("handle").alias("handle"))
    return curated.unionByName(followed).distinct().join(blocked.hint("merge"), ["monitor_id", "handle"], "left_anti")


def with_curated(articles: DataFrame, handles: DataFrame) -> DataFrame:
    """Adds ``curated``: the author is a monitored handle of the row's channel."""
    h = F.broadcast(handles.select("monitor_id", F.col("handle").alias("_handle"), F.lit(True).alias("_hit")))
    return articles.withColumn("_handle", F.lower("author")).join(h, ["monitor_id", "_handle"], "left").withColumn("curated", F.coalesce("_hit", F.lit(False))).drop("_handle", "_hit")


def with_publisher(articles: DataFrame, publishers: DataFrame) -> DataFrame:
    """Adds ``publisher_id``: by handle for posts, by owner for repositories, else by the first directory row whose domain is the
    URL's host or a parent of it.

    A suffix match becomes one broadcast hash join for each number of labels that a directory domain has: articles are neither
    exploded nor shuffled. The directory is a dimension that people keep by hand.
    """
    directory = publishers.groupBy("kind", "key").agg(F.min(F.struct("ord", "publisher_id")).alias("p"))
    domains = directory.where("kind = 'domain'").select("key", "p")
    depth = domains.agg(F.max(F.size(F.split("key", "\\."))).alias("n")).first().n or 0
    host = host_of(F.col("url"))
    named = F.col("source").isin("x", "github") & (F.col("content_kind") != "web")
    allowed = ~named & ((F.col("source") != "rss") | (F.lower(F.regexp_replace("origin_key", r"^(?i)www\.", "")) == host))
    rows = articles.withColumn("_host", F.when(allowed, host)).withColumn("_name", F.when(named, F.lower("author")))
    for n in range(1, depth + 1):
        some = domains.where(F.size(F.split("key", "\\.")) == n).select(F.col("key").alias(f"_k{n}"), F.col("p").alias(f"_p{n}"))
        rows = rows.join(F.broadcast(some), F.substring_index("_host", ".", -n) == F.col(f"_k{n}"), "left").drop(f"_k{n}")
    names = directory.where("kind <> 'domain'").select(F.col("kind").alias("_kind"), F.col("key").alias("_key"), F.col("p").alias("_p0"))
    rows = rows.join(F.broadcast(names), (F.col("source") == F.col("_kind")) & (F.col("_name") == F.col("_key")), "left")
    found = F.array_min(F.array_compact(F.array(*[F.col(f"_p{n}") for n in range(depth + 1)])))
    return rows.withColumn("publisher_id", found["publisher_id"]).drop("_host", "_name", "_kind", "_key", *[f"_p{n}" for n in range(depth + 1)])


def judge(articles: DataFrame, monitors: DataFrame, publishers: DataFrame, accounts: DataFrame, now: int) -> DataFrame:
    """Adds passes_engagement, exempt, observe_until, decision (first failing rule, null if accepted) and state."""
    rows = with_publisher(with_curated(articles, monitored_handles(monitors, accounts)), publishers)
    rules = F.broadcast(monitors.select("monitor_id", "mode", "min_likes", "min_reposts", "min_replies", "exclude_replies", "observation_minutes", "blocked", "window_hours"))
    rows = rows.join(rules, "monitor_id")
    limit = thresholds(F.col("mode"), F.col("min_likes"), F.col("min_reposts"), F.col("min_replies"))
    rows = rows.withColumn("passes_engagement", passes(limit)).withColumn("exempt", F.col("publisher_id").isNotNull() | F.col("curated"))
    x = F.col("source") == "x"
    deadline = F.col("published_at") + F.col("observation_minutes") * 60000
    waits = x & ~F.col("passes_engagement") & ~F.col("exempt") & (F.col("observation_minutes") > 0) & (F.col("published_at") > 0)
    open_ = (deadline > now) | ((F.col("collected_at") < deadline) & (F.coalesce("checked_at", F.lit(0)) < deadline))
    rows = rows.withColumn("observe_until", F.when(waits & open_, deadline))
    blocked = F.exists("blocked", lambda b: F.lower(b) == F.lower("author"))
    has_link = F.col("content_status") == "full"
    decision = (
        F.when(F.trim("text") == "", "empty").when(x & blocked, "blocked").when(F.col("is_repost"), "repost")
        .when(x & F.col("exclude_replies") & F.col("is_reply") & ~substantive(F.col("text"), has_link), "reply")
        .when(x & ~F.col("passes_engagement") & ~F.col("exempt") & F.col("observe_until").isNull(), "low_engagement")
    )
    rows = rows.withColumn("decision", decision)
    old = (F.col("published_at") > 0) & (F.col("published_at") < now - F.col("window_hours") * 3600000)
    state = F.when(F.col("decision").isNotNull(), "filtered").when(F.col("observe_until").isNotNull(), "observing").when(old, "background").otherwise("pending")
    return rows.withColumn("state", state)


def quality_tags(judged: DataFrame) -> DataFrame:
    """Adds ``tags``: soft labels that never filter."""
    x = F.col("source") == "x"
    tags = (
        (F.col("is_reply"), "reply"), (x & F.col("is_reply").isNull(), "type_unknown"), (F.col("text").rlike(PROMOTION), "promotion"),
        (F.length(without_links(F.col("text"))) < 25, "short_text"), (x & ~F.col("passes_engagement"), "low_engagement"), (x & F.col("curated"), "curated"),
        (F.col("is_blue"), "blue_check"), (F.col("published_at") == 0, "date_unknown"),
    )
    return judged.withColumn("tags", F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in tags])))
