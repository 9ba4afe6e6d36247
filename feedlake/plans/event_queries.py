"""Queries over events: hydration, feed, scores, evidence checks, candidates and notifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.functions.text import ALARM, content_hash
from feedlake.operators import candidates, constraints as constraints_, evidence as ev, events as evs, metrics, quality, ranking
from feedlake.sources.scratch import written
from feedlake.sources.tables import NOW, PUBLISHERS, accounts, articles, events, evidence, monitors, table

from .article_queries import judged
from .oracle_views import oracle

QUERIES: dict = {}
FIELDS = ("source", "author", "content_kind", "likes", "reposts", "replies", "published_at", "collected_at", "group_key", "state", "decision")
OFFICIAL = tuple(sorted(k for _, kind, k, _ in PUBLISHERS if kind == "x"))


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = (run, oracle(sql) if sql else None)
        return run

    return add


def full_articles(spark, sf):
    """Judged articles with content hash and evidence group."""
    rows = judged(spark, sf).withColumn("content_hash", content_hash(F.col("text"), F.col("content_status")))
    return rows.withColumn("group_key", evs.evidence_group(F.col("publisher_id"), F.lit(None).cast("string"), F.col("content_hash"), F.col("origin_key")))


def hydrated(spark, sf):
    return evs.hydrate(events(spark, sf), full_articles(spark, sf), *FIELDS)


FULL = """, fa AS (SELECT *, CASE WHEN length(text_norm) >= 80 AND content_status NOT IN ('snippet', 'failed') THEN substr(sha256(text_norm), 1, 32) END AS content_hash FROM judged),
ga AS (SELECT *, coalesce('publisher:' || publisher_id, 'hash:' || content_hash, 'origin:' || origin_key) AS group_key FROM fa),
he AS (SELECT e.event_id, e.pos, e.role, e.excerpt, ga.* FROM evidence e JOIN ga USING (article_id)),
heat AS (SELECT event_id, coalesce(sum(coalesce(likes, 0) + 3 * reposts + 2 * replies) FILTER (WHERE source = 'x'), 0) AS heat FROM he GROUP BY 1)"""
GATED = FULL + """, fe AS (SELECT e.*, CAST(h.heat AS BIGINT) AS heat, coalesce(list_position(['low','medium','high','urgent'], importance), 0) AS irank FROM events_v e JOIN monitors m USING (monitor_id) JOIN heat h USING (event_id)
  WHERE e.relevance >= m.min_relevance AND coalesce(e.value, 100) >= m.min_value)"""


@query("j02_hydrate", FULL + " SELECT event_id, count(*) AS n, string_agg(author, ',' ORDER BY pos) AS authors FROM he GROUP BY 1")
def hydrate(spark, sf):
    return hydrated(spark, sf).select("event_id", F.size("articles").cast("long").alias("n"), F.array_join(F.transform("articles", lambda a: a["author"]), ",").alias("authors"))


@query("j01_link_join", "SELECT a.article_id, e.event_id, a.source FROM evidence e JOIN articles a USING (article_id)")
def link_join(spark, sf):
    return evidence(spark, sf).join(articles(spark, sf).select("article_id", "source"), "article_id").select("article_id", "event_id", "source")


@query("j03_monitor_join", "SELECT event_id, m.mode FROM events_v e JOIN monitors m USING (monitor_id)")
def monitor_join(spark, sf):
    return events(spark, sf).join(F.broadcast(monitors(spark).select("monitor_id", "mode")), "monitor_id").select("event_id", "mode")


@query("j04_unfiltered", FULL + " SELECT e.event_id FROM events_v e WHERE EXISTS (SELECT 1 FROM he WHERE he.event_id = e.event_id AND he.decision IS NULL)")
def unfiltered(spark, sf):
    good = judged(spark, sf).where(F.col("decision").isNull()).select("article_id")
    links = evidence(spark, sf).join(good, "article_id", "left_semi").select("event_id").distinct()
    return events(spark, sf).select("event_id").join(links, "event_id", "left_semi")


@query("j05_found_by", "SELECT article_id FROM (SELECT article_id, CASE WHEN doc_id % 3 = 0 THEN [source, 'google'] END AS d, source FROM articles) WHERE list_contains(coalesce(d, [source]), 'google')")
def found_by(spark, sf):
    rows = articles(spark, sf).withColumn("d", F.when(F.col("doc_id") % 3 == 0, F.array("source", F.lit("google"))))
    return rows.where(F.array_contains(F.coalesce("d", F.array("source")), "google")).select("article_id")


@query("j06_missing_articles", "SELECT e.event_id, e.article_id FROM evidence e WHERE NOT EXISTS (SELECT 1 FROM articles a WHERE a.article_id = e.article_id AND a.doc_id % 13 <> 0)")
def missing_articles(spark, sf):
    return evidence(spark, sf).join(articles(spark, sf).where("doc_id % 13 <> 0"), "article_id", "left_anti").select("event_id", "article_id")


def feed_rows(spark, sf, f, page=None):
    rows = evs.feed(hydrated(spark, sf), monitors(spark), f, NOW, quality.monitored_handles(monitors(spark), accounts(spark)), OFFICIAL)
    rows = rows.withColumn("heat", evs.social_heat(F.col("articles")))
    if page is None:
        return rows.select("event_id", "heat")
    return ranking.page_of(rows.select("event_id", "relevance", "importance", "heat", "published_at", "first_discovered_at"), evs.feed_order(f.sort), page)


def _paged(order, page, where="TRUE"):
    order = order.replace("first_discovered_at DESC", "first_discovered_at DESC, event_id")
    return GATED + f""", pg AS (SELECT *, row_number() OVER (ORDER BY {order}) AS place, count(*) OVER () AS total FROM fe WHERE {where})
SELECT event_id, place, total, greatest(least({page}, CAST(ceil(total / 30.0) AS BIGINT)), 1) AS page FROM pg WHERE CAST(ceil(place / 30.0) AS BIGINT) = greatest(least({page}, CAST(ceil(total / 30.0) AS BIGINT)), 1)"""


def _page(spark, sf, f, page):
    return feed_rows(spark, sf, f, page).select("event_id", F.col("place").cast("long").alias("place"), "total", F.col("page").cast("long").alias("page"))


@query("feed_recommended", _paged("irank DESC, relevance DESC, first_discovered_at DESC", 1))
def feed_recommended(spark, sf):
    return _page(spark, sf, evs.FeedFilters(), 1)


@query("r06_sort_heat", _paged("heat DESC, first_discovered_at DESC", 2))
def sort_heat(spark, sf):
    return _page(spark, sf, evs.FeedFilters(sort="heat"), 2)


@query("r06_sort_publication", _paged("published_at DESC NULLS LAST, first_discovered_at DESC", 1))
def sort_publication(spark, sf):
    return _page(spark, sf, evs.FeedFilters(sort="publication"), 1)


@query("r06_sort_importance", _paged("irank DESC, first_discovered_at DESC", 1))
def sort_importance(spark, sf):
    return _page(spark, sf, evs.FeedFilters(sort="importance"), 1)


@query("r06_sort_relevance", _paged("relevance DESC, first_discovered_at DESC", 1))
def sort_relevance(spark, sf):
    return _page(spark, sf, evs.FeedFilters(sort="relevance"), 1)


@query("r07_paging_clamped", _paged("first_discovered_at DESC", 99999, "relevance >= 30"))
def paging(spark, sf):
    rows = feed_rows(spark, sf, evs.FeedFilters(sort="discovery", min_relevance=30)).select("event_id").join(events(spark, sf), "event_id")
    order, size = evs.feed_order("discovery"), 30
    # The last page is the head of the reversed order: still a top-k.
    back = [F.asc("first_discovered_at"), F.desc("event_id")]
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    tail = rows.orderBy(*back).limit(size).crossJoin(F.broadcast(total))
    from pyspark.sql import Window

    pages = F.greatest(F.ceil(F.col("total") / size), F.lit(1))
    ranked = tail.withColumn("back", F.row_number().over(Window.orderBy(*back))).withColumn("place", F.col("total") - F.col("back") + 1)
    assert order
    return ranked.where(F.ceil(F.col("place") / size) == pages).select("event_id", "place", "total", pages.cast("long").alias("page"))


@query("e05_feed_filter", GATED + f""" SELECT event_id, heat FROM fe WHERE first_discovered_at >= {NOW} - 480 * CAST(3600000 AS BIGINT) AND monitor_id IN ('m0', 'm1') AND credibility = 'supported' AND contains(lower(title || ' ' || summary), 'e')
  AND EXISTS (SELECT 1 FROM he WHERE he.event_id = fe.event_id AND source IN ('x', 'rss'))
  AND EXISTS (SELECT 1 FROM he WHERE he.event_id = fe.event_id AND source = 'x' AND content_kind <> 'web' AND (coalesce(likes, 0) >= 10 OR reposts >= 3 OR replies >= 5))""")
def feed_filter(spark, sf):
    return feed_rows(spark, sf, evs.FeedFilters(hours=480, monitor_ids=("m0", "m1"), sources=("x", "rss"), credibility="supported", query=" E ", engagement="standard"))


@query("e05_feed_accounts", GATED + """ SELECT event_id, heat FROM fe WHERE EXISTS (SELECT 1 FROM he JOIN handles h ON h.handle = lower(he.author) WHERE he.event_id = fe.event_id AND h.monitor_id = fe.monitor_id AND he.source = 'x')""")
def feed_curated(spark, sf):
    return feed_rows(spark, sf, evs.FeedFilters(account_scope="curated"))


@query("e05_feed_official", GATED + f""" SELECT event_id, heat FROM fe WHERE published_at >= {NOW} - 600 * CAST(3600000 AS BIGINT) AND coalesce(importance, 'unassessed') = 'high' AND EXISTS (SELECT 1 FROM he WHERE he.event_id = fe.event_id AND he.source = 'x' AND lower(he.author) IN (SELECT key FROM publishers WHERE kind = 'x'))""")
def feed_official(spark, sf):
    return feed_rows(spark, sf, evs.FeedFilters(account_scope="official", hours=600, time_field="publication", importance="high"))


@query("e04_visible", FULL + " SELECT event_id FROM events_v e WHERE EXISTS (SELECT 1 FROM he WHERE he.event_id = e.event_id AND (source <> 'x' OR (decision IS NULL AND state <> 'observing')))")
def visible(spark, sf):
    ok = F.exists("articles", lambda a: (a["source"] != "x") | (a["decision"].isNull() & (a["state"] != "observing")))
    return hydrated(spark, sf).where(ok).select("event_id")


@query("e06_dashboard_list", "SELECT event_id, updated_at FROM (SELECT * FROM events_v ORDER BY updated_at DESC, event_id LIMIT 200) e JOIN monitors m USING (monitor_id) WHERE e.relevance >= m.min_relevance AND coalesce(e.value, 100) >= m.min_value")
def dashboard_list(spark, sf):
    top = events(spark, sf).orderBy(F.desc("updated_at"), "event_id").limit(200)
    rows = top.join(F.broadcast(monitors(spark).select("monitor_id", F.col("min_relevance").alias("r"), F.col("min_value").alias("v"))), "monitor_id")
    return rows.where((F.col("relevance") >= F.col("r")) & (F.coalesce("value", F.lit(100)) >= F.col("v"))).select("event_id", "updated_at")


@query("e07_raw_list", "SELECT article_id, collected_at FROM (SELECT * FROM judged WHERE NOT is_repost ORDER BY collected_at DESC, article_id LIMIT 200) WHERE decision IS NULL ORDER BY collected_at DESC, article_id LIMIT 20")
def raw_list(spark, sf):
    order = (F.desc("collected_at"), F.asc("article_id"))
    top = judged(spark, sf).where(~F.col("is_repost")).orderBy(*order).limit(200)
    return top.where(F.col("decision").isNull()).orderBy(*order).limit(20).select("article_id", "collected_at")


@query("r08_latest", "SELECT event_id, updated_at FROM events_v ORDER BY updated_at DESC, event_id LIMIT 50")
def latest(spark, sf):
    return events(spark, sf).select("event_id", "updated_at").orderBy(F.desc("updated_at"), "event_id").limit(50)


@query("a03_display_counts", "SELECT e.monitor_id, count(*) AS n, count(*) FILTER (WHERE e.relevance >= m.min_relevance AND coalesce(e.value, 100) >= m.min_value) AS displayed, count(*) FILTER (WHERE notified_at IS NULL) AS open FROM events_v e JOIN monitors m USING (monitor_id) GROUP BY 1")
def display_counts(spark, sf):
    rows = events(spark, sf).join(F.broadcast(monitors(spark).select("monitor_id", F.col("min_relevance").alias("r"), F.col("min_value").alias("v"))), "monitor_id")
    shown = (F.col("relevance") >= F.col("r")) & (F.coalesce("value", F.lit(100)) >= F.col("v"))
    return rows.groupBy("monitor_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(shown).alias("displayed"), F.count_if(F.col("notified_at").isNull()).alias("open"))


@query("a04_social_heat", FULL + " SELECT event_id, CAST(heat AS BIGINT) AS heat FROM heat")
def heat(spark, sf):
    return hydrated(spark, sf).select("event_id", evs.social_heat(F.col("articles")).alias("heat"))


@query("a05_event_sources", FULL + " SELECT event_id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM he GROUP BY 1")
def event_sources(spark, sf):
    return hydrated(spark, sf).select("event_id", F.array_join(F.array_sort(F.array_distinct(F.transform("articles", lambda a: a["source"]))), ",").alias("sources"))


@query("a06_hotspot_score", FULL + f""", s AS (SELECT event_id, max(published_at) AS newest, max(least(1.0, log10(1.0 + coalesce(likes, 0) + 3 * replies + 4 * reposts) / 4)) AS engagement, count(DISTINCT group_key) AS g FROM he GROUP BY 1),
q AS (SELECT event_id, relevance, CASE WHEN newest > 0 THEN greatest(0.0, 1 - greatest(0.0, ({NOW} - newest) / 86400000.0) / 7) ELSE 0.0 END AS freshness, engagement, least(1.0, g / 3.0) AS diversity FROM events_v JOIN s USING (event_id))
SELECT event_id, round(freshness, 6) AS freshness, round(engagement, 6) AS engagement, round(diversity, 6) AS diversity, CAST(greatest(0, least(100, round(0.4 * relevance + 20 * freshness + 20 * engagement + 10 * diversity))) AS BIGINT) AS score FROM q""")
def score(spark, sf):
    out = evs.hotspot_score(hydrated(spark, sf), NOW)
    return out.select("event_id", *[F.round(c, 6).alias(c) for c in ("freshness", "engagement", "diversity")], "score")


@query("a06_growth_score", FULL + f""", sm AS (SELECT user_id, event_id AS sample_id, epoch_us(ts) // 1000 AS sampled_at, CAST(floor(coalesce(value, 0)) AS BIGINT) AS likes FROM events WHERE event_type IN ('view', 'click')),
d AS (SELECT user_id, greatest(likes - lag(likes) OVER (PARTITION BY user_id ORDER BY sampled_at, sample_id), 0) AS step FROM sm), gr AS (SELECT user_id, CAST(coalesce(sum(step), 0) AS BIGINT) AS growth FROM d GROUP BY 1),
eg AS (SELECT event_id, CAST(coalesce(sum(growth), 0) AS BIGINT) AS g FROM he LEFT JOIN gr ON gr.user_id = he.doc_id GROUP BY 1),
s AS (SELECT event_id, max(published_at) AS newest, max(least(1.0, log10(1.0 + coalesce(likes, 0) + 3 * replies + 4 * reposts) / 4)) AS engagement, count(DISTINCT group_key) AS k FROM he GROUP BY 1),
q AS (SELECT event_id, relevance, CASE WHEN newest > 0 THEN greatest(0.0, 1 - greatest(0.0, ({NOW} - newest) / 86400000.0) / 7) ELSE 0.0 END AS freshness, engagement, least(1.0, k / 3.0) AS diversity, CASE WHEN g > 0 THEN least(1.0, log10(1.0 + g) / 3) ELSE 0.0 END AS growth FROM events_v JOIN s USING (event_id) JOIN eg USING (event_id))
SELECT event_id, round(growth, 6) AS growth, CAST(greatest(0, least(100, round(0.4 * relevance + 20 * freshness + 20 * engagement + 10 * diversity + 10 * growth))) AS BIGINT) AS score FROM q""")
def growth_score(spark, sf):
    """The score with the growth that the samples of an event's articles show."""
    samples = table(spark, sf, "events").where("event_type IN ('view', 'click')").selectExpr("user_id AS article_id", "event_id AS sample_id", "unix_micros(CAST(ts AS timestamp)) div 1000 AS sampled_at", "CAST(floor(coalesce(value, 0)) AS BIGINT) AS likes")
    grown = metrics.metric_growth(samples).select(F.col("article_id").alias("doc_id"), "growth")
    links = evidence(spark, sf).select("event_id", "article_id").join(articles(spark, sf).select("article_id", "doc_id"), "article_id").join(grown.hint("merge"), "doc_id", "left")
    per_event = links.groupBy("event_id").agg(F.coalesce(F.sum("growth"), F.lit(0)).alias("grown"))
    out = evs.hotspot_score(hydrated(spark, sf).join(per_event.hint("merge"), "event_id", "left"), NOW, F.coalesce("grown", F.lit(0)))
    return out.select("event_id", F.round("growth", 6).alias("growth"), "score")


@query("a07_evidence_group", FULL + " SELECT article_id, group_key FROM ga")
def groups(spark, sf):
    return full_articles(spark, sf).select("article_id", "group_key")


@query("a08_earliest_publication", FULL + """ SELECT e.event_id, min(he.published_at) AS earliest FROM events_v e LEFT JOIN he ON he.event_id = e.event_id AND NOT is_repost AND he.published_at > 0 AND ((source = 'x' AND content_kind <> 'web') OR content_kind = 'release') GROUP BY 1""")
def earliest(spark, sf):
    rows = evidence(spark, sf).select("event_id", "article_id").join(articles(spark, sf).select("article_id", "is_repost", "published_at", "source", "content_kind"), "article_id")
    good = ~F.col("is_repost") & (F.col("published_at") > 0) & (((F.col("source") == "x") & (F.col("content_kind") != "web")) | (F.col("content_kind") == "release"))
    return rows.groupBy("event_id").agg(F.min(F.when(good, F.col("published_at"))).alias("earliest"))


@query("a09_first_discovery", FULL + " SELECT event_id, least(e.first_discovered_at + 1000, min(he.collected_at)) AS first_seen FROM events_v e JOIN he USING (event_id) GROUP BY event_id, e.first_discovered_at")
def first_discovery(spark, sf):
    seen = F.array_min(F.transform("articles", lambda a: a["collected_at"]))
    return hydrated(spark, sf).select("event_id", F.least(F.col("first_discovered_at") + 1000, seen).alias("first_seen"))


@query("e01_publish", FULL + f""" SELECT e.event_id, e.relevance >= m.min_relevance AND coalesce(e.value, 100) >= m.min_value AND NOT bool_and(he.published_at > 0 AND he.published_at < {NOW} - m.window_hours * CAST(3600000 AS BIGINT)) AS publish
FROM events_v e JOIN monitors m USING (monitor_id) JOIN he USING (event_id) GROUP BY e.event_id, e.relevance, e.value, m.min_relevance, m.min_value""")
def publish(spark, sf):
    return evs.publishable(hydrated(spark, sf), monitors(spark), NOW).select("event_id", "publish")


@query("e02_upsert", f"""SELECT event_id, first_discovered_at AS created_at, CASE WHEN g % 7 = 0 AND NOT g % 11 = 0 THEN {NOW} ELSE updated_at END AS updated_at, g % 4 + 1 + CASE WHEN g % 7 = 0 AND NOT g % 11 = 0 THEN 1 ELSE 0 END AS revision,
  CASE WHEN g % 11 = 0 THEN 0 ELSE relevance END AS relevance, CASE WHEN g % 11 = 0 THEN 'retracted' WHEN g % 7 = 0 THEN 'changed' ELSE 'same' END AS change FROM (SELECT *, CAST(substr(event_id, 2) AS BIGINT) AS g FROM events_v)""")
def upsert(spark, sf):
    base = events(spark, sf).withColumn("g", F.substring("event_id", 2, 20).cast("long")).withColumn("created_at", F.col("first_discovered_at"))
    new = base.where("g % 11 <> 0").withColumn("title", F.when(F.col("g") % 7 == 0, F.concat("title", F.lit(" new"))).otherwise(F.col("title")))
    return evs.upsert_events(base, new, ["title", "summary", "credibility"], NOW)


@query("e03_retract", "SELECT e.event_id, CASE WHEN x.n IS NULL THEN 0 ELSE e.relevance END AS relevance FROM events_v e LEFT JOIN (SELECT event_id, count(*) AS n FROM evidence JOIN articles USING (article_id) WHERE source = 'x' GROUP BY 1) x USING (event_id)")
def retract(spark, sf):
    alive = evidence(spark, sf).join(articles(spark, sf).where("source = 'x'").select("article_id"), "article_id", "left_semi").select("event_id", F.lit(True).alias("alive")).distinct()
    return events(spark, sf).join(alive, "event_id", "left").select("event_id", F.when(F.col("alive"), F.col("relevance")).otherwise(F.lit(0)).alias("relevance"))


@query("e08_feedback", """SELECT event_id, count(*) FILTER (WHERE doc_id % 4 = 0) AS valuable, count(*) FILTER (WHERE doc_id % 4 = 1) AS irrelevant, count(*) FILTER (WHERE doc_id % 4 = 2) AS duplicate, count(*) FILTER (WHERE doc_id % 4 = 3) AS insufficient
FROM evidence JOIN articles USING (article_id) GROUP BY 1""")
def feedback(spark, sf):
    verdicts = ["valuable", "irrelevant", "duplicate", "insufficient"]
    log = evidence(spark, sf).join(articles(spark, sf).select("article_id", "doc_id"), "article_id").withColumn("verdict", F.element_at(F.array(*map(F.lit, verdicts)), (F.col("doc_id") % 4 + 1).cast("int")))
    return log.groupBy("event_id").pivot("verdict", verdicts).agg(F.count(F.lit(1))).na.fill(0)


@query("e09_notify", FULL + f""" SELECT e.event_id, substr(sha256(e.event_id || ':' || e.revision), 1, 32) AS notice_id, e.relevance >= m.min_relevance AND e.credibility <> 'disputed' AND (e.credibility <> 'unverified' OR m.notify_unverified)
  AND bool_or(he.published_at >= m.created_at AND (e.notified_at IS NULL OR he.published_at > e.notified_at)) AND (e.notified_at IS NULL OR {NOW} - e.notified_at >= m.cooldown_minutes * CAST(60000 AS BIGINT)) AS notify
FROM events_v e JOIN monitors m USING (monitor_id) JOIN he USING (event_id) GROUP BY e.event_id, e.revision, e.relevance, m.min_relevance, e.credibility, m.notify_unverified, e.notified_at, m.cooldown_minutes""")
def notify(spark, sf):
    return evs.can_notify(hydrated(spark, sf), monitors(spark), NOW).select("event_id", "notice_id", "notify")


QUOTED = FULL + """, held AS (SELECT e.*, CASE WHEN a.doc_id % 13 = 0 THEN 'no_article' WHEN NOT contains(a.text_norm, trim(regexp_replace(excerpt, '[ \\t\\r\\n]+', ' ', 'g'))) THEN 'not_quoted' END AS problem FROM evidence e JOIN articles a USING (article_id))"""


@query("v03_quotes", QUOTED + " SELECT event_id, pos, article_id, problem FROM held")
def quotes(spark, sf):
    return ev.quotes_held(evidence(spark, sf), articles(spark, sf).where("doc_id % 13 <> 0")).select("event_id", "pos", "article_id", "problem")


@query("v09_evidence_status", FULL + """, good AS (SELECT * FROM he WHERE contains(text_norm, trim(regexp_replace(excerpt, '[ \\t\\r\\n]+', ' ', 'g'))) AND role <> 'repost' AND NOT is_repost AND content_kind NOT IN ('repository', 'discussion') AND content_status IN ('native', 'full') AND publisher_id IS NOT NULL),
fresh AS (SELECT g.*, NOT EXISTS (SELECT 1 FROM good p WHERE p.event_id = g.event_id AND p.pos < g.pos AND (p.url = g.url OR p.content_hash = g.content_hash)) AS fresh FROM good g),
cand AS (SELECT event_id, pos, group_key, row_number() OVER (PARTITION BY event_id ORDER BY pos) AS k, CASE WHEN content_status = 'full' THEN regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') END AS plain FROM fresh WHERE role = 'independent' AND fresh),
sets AS (SELECT *, list_distinct(list_transform(range(1, length(plain) - 30), lambda i: substr(plain, i, 32))) AS s FROM cand WHERE length(plain) >= 500),
near AS (SELECT b.event_id, b.pos, list(a.pos) AS near FROM sets a JOIN sets b ON a.event_id = b.event_id AND a.pos < b.pos AND least(length(a.plain), length(b.plain)) >= 0.7 * greatest(length(a.plain), length(b.plain))
  AND len(list_intersect(a.s, b.s)) >= 0.9 * least(len(a.s), len(b.s)) GROUP BY 1, 2),
ok AS (SELECT * FROM (WITH RECURSIVE acc(event_id, k, kept) AS (SELECT DISTINCT event_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM cand UNION ALL
  SELECT c.event_id, c.k, CASE WHEN list_has_any(coalesce(n.near, CAST([] AS BIGINT[])), acc.kept) THEN acc.kept ELSE list_append(acc.kept, c.pos) END FROM acc JOIN cand c ON c.event_id = acc.event_id AND c.k = acc.k + 1 LEFT JOIN near n ON n.event_id = c.event_id AND n.pos = c.pos)
  SELECT event_id, arg_max(kept, k) AS kept FROM acc GROUP BY 1)),
sums AS (SELECT f.event_id, count(DISTINCT CASE WHEN role = 'independent' AND fresh AND list_contains(ok.kept, f.pos) THEN group_key END) AS n, bool_or(role = 'first_party') AS first FROM fresh f LEFT JOIN ok USING (event_id) GROUP BY 1)
SELECT event_id, CASE WHEN credibility IN ('unverified', 'disputed') THEN credibility WHEN credibility = 'corroborated' AND coalesce(n, 0) >= 2 THEN 'corroborated' WHEN coalesce(first, FALSE) THEN 'supported' ELSE 'unverified' END AS status FROM events_v LEFT JOIN sums USING (event_id)""")
def status(spark, sf):
    return ev.evidence_status(events(spark, sf), ev.qualified(evidence(spark, sf), full_articles(spark, sf))).select("event_id", "status")


@query("v10_gap_codes", FULL + """, f AS (SELECT event_id, bool_or(content_status IN ('snippet', 'failed')) AS a, bool_or(publisher_id IS NULL) AS b, bool_or(is_repost OR content_kind IN ('discussion', 'repository')) AS c FROM he GROUP BY 1)
SELECT event_id, CASE WHEN a OR b OR c THEN array_to_string(list_filter([CASE WHEN a THEN 'partial_text' END, CASE WHEN b THEN 'unknown_publisher' END, CASE WHEN c THEN 'indirect' END], lambda x: x IS NOT NULL), ',') ELSE 'no_support' END AS gaps
FROM events_v LEFT JOIN f USING (event_id) WHERE credibility = 'unverified'""")
def gaps(spark, sf):
    out = ev.gap_codes(events(spark, sf), evidence(spark, sf), full_articles(spark, sf))
    return out.select("event_id", F.array_join("gaps", ",").alias("gaps"))


@query("v11_urgency", FULL + f""" SELECT e.event_id, CASE WHEN importance = 'urgent' AND (credibility IN ('unverified', 'disputed') OR NOT bool_or(regexp_matches(he.excerpt, '{ALARM}'))) THEN 'high' ELSE importance END AS final_importance FROM events_v e JOIN evidence he USING (event_id) GROUP BY e.event_id, importance, credibility""")
def urgency(spark, sf):
    return ev.urgency(events(spark, sf), evidence(spark, sf)).select("event_id", "final_importance")


@query("v12_gap_flags", FULL + """ SELECT event_id, array_to_string(list_filter([CASE WHEN bool_or(published_at = 0) THEN 'dates_unknown' END, CASE WHEN bool_or(length(text) > 3000) THEN 'partly_read' END, CASE WHEN bool_or(content_status = 'failed') THEN 'body_missing' END], lambda x: x IS NOT NULL), ',') AS flags FROM he GROUP BY 1""")
def gap_flags(spark, sf):
    rows = evidence(spark, sf).join(articles(spark, sf).select("article_id", "published_at", F.length("text").alias("n"), "content_status"), "article_id")
    flags = rows.groupBy("event_id").agg(F.bool_or(F.col("published_at") == 0).alias("a"), F.bool_or(F.col("n") > 3000).alias("b"), F.bool_or(F.col("content_status") == "failed").alias("c"))
    named = F.array_compact(F.array(*[F.when(F.col(c), F.lit(n)) for c, n in (("a", "dates_unknown"), ("b", "partly_read"), ("c", "body_missing"))]))
    return flags.select("event_id", F.array_join(F.slice(named, 1, 6), ",").alias("flags"))


READ = """, t AS (SELECT e.event_id, e.pos, a.article_id, text, list_distinct(regexp_extract_all(lower(v.title || ' ' || v.summary), '[a-z0-9._-]{3,}|[\\x{4e00}-\\x{9fff}]{2,}')[1:35]) AS terms FROM evidence e JOIN articles a USING (article_id) JOIN events_v v ON v.event_id = e.event_id),
b AS (SELECT event_id, pos, article_id, CAST(s AS BIGINT) AS start, substr(text, CAST(s + 1 AS BIGINT), 750) AS block, terms FROM t, LATERAL (SELECT unnest(range(0, greatest(length(text), 1), 750)) AS s) x),
c AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY 3 * len(list_filter(terms, lambda x: contains(lower(block), x))) + CASE WHEN start = 0 THEN 1 ELSE 0 END DESC, start) AS r FROM b),
pass AS MATERIALIZED (SELECT event_id, pos, article_id, start, block FROM c WHERE r <= 5)"""
ANCHORS = READ + """, sp(event_id, pos, article_id, start, block, fro, till) AS (SELECT event_id, pos, article_id, start, block, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM pass UNION ALL
  SELECT event_id, pos, article_id, start, block, till, CASE WHEN length(block) - cut < 8 THEN length(block) ELSE cut END FROM (
    SELECT *, CASE WHEN till + 220 < length(block) THEN coalesce(till + list_max(list_transform(range(60, 220), lambda i: CASE
        WHEN substr(block, till + i + 1, 1) IN ('.', '!', '?', '。', '！', '？') AND i < 219 AND substr(block, till + i + 2, 1) IN (' ', chr(9), chr(10), chr(13)) THEN i + 2
        WHEN substr(block, till + i + 1, 1) = chr(10) AND NOT substr(block, till + i, 1) IN ('.', '!', '?', '。', '！', '？') THEN i + 1 END)), till + 220) ELSE length(block) END AS cut FROM sp WHERE till < length(block)) z),
anchors AS MATERIALIZED (SELECT event_id, pos, article_id, start + fro AS start, start + till AS "end", substr(block, fro + 1, till - fro) AS text,
  'a' || (pos + 1) || ':q' || row_number() OVER (PARTITION BY article_id ORDER BY start, fro) AS quote_id FROM sp WHERE till > 0 AND length(trim(substr(block, fro + 1, till - fro), ' ')) >= 8)"""


def read_passages(spark, sf):
    """What is selected of each event's articles: the best blocks by the words of the event's title and summary."""
    asked = events(spark, sf).select("event_id", F.concat_ws(" ", "title", "summary").alias("asked"))
    rows = evidence(spark, sf).select("event_id", F.col("pos").alias("idx"), "article_id").join(asked.hint("merge"), "event_id")
    # Texts come last, so that they are shuffled once.
    rows = rows.join(articles(spark, sf).select("article_id", "text").hint("merge"), "article_id")
    return ranking.passages(rows, F.col("asked"), 4000).drop("text", "asked")


@query("v04_quote_anchors", ANCHORS + ' SELECT event_id, article_id, quote_id, start, "end", sha256(text) AS text_sha FROM anchors')
def anchors(spark, sf):
    out = ev.passage_anchors(read_passages(spark, sf))
    return out.select("event_id", "article_id", "quote_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.sha2("text", 256).alias("text_sha"))


def cited_claims(spark, sf):
    """Claims over neighbouring evidence, with planted violations by the number of the event."""
    g = F.expr("CAST(substring(event_id, 2) AS BIGINT)")
    rows = evidence(spark, sf).where("pos < 4").select("event_id", (F.col("pos") % 2).cast("int").alias("claim"), "pos", "article_id").withColumn("g", g)
    quote = F.concat(F.lit("a"), F.col("pos") + 1, F.lit(":q"), (F.col("g") % 3) + 1)
    rows = rows.groupBy("event_id", "g", "claim").agg(F.array_sort(F.collect_list(F.struct("pos", "article_id", quote.alias("q")))).alias("l"))
    ids, quotes = F.transform("l", lambda x: x["article_id"]), F.transform("l", lambda x: x["q"])
    ids = F.when(F.col("g") % 7 == 1, F.slice(ids, 1, 1)).when(F.col("g") % 7 == 2, F.concat(ids, F.slice(ids, 1, 1))).when(F.col("g") % 7 == 3, F.concat(ids, F.array(F.lit("elsewhere")))).otherwise(ids)
    quotes = F.when(F.col("g") % 5 == 1, F.concat(quotes, F.slice(quotes, 1, 1))).when(F.col("g") % 5 == 2, F.concat(quotes, F.array(F.lit("a9:q1")))).otherwise(quotes)
    return rows.select("event_id", "claim", ids.alias("article_ids"), quotes.alias("quote_ids"))


@query("v05_anchor_resolution", ANCHORS + """, l AS (SELECT event_id, CAST(substr(event_id, 2) AS BIGINT) AS g, pos % 2 AS claim, list(article_id ORDER BY pos) AS ids, list('a' || (pos + 1) || ':q' || (CAST(substr(event_id, 2) AS BIGINT) % 3 + 1) ORDER BY pos) AS qs FROM evidence WHERE pos < 4 GROUP BY 1, 2, 3),
k AS (SELECT event_id, claim, CASE g % 7 WHEN 1 THEN ids[1:1] WHEN 2 THEN list_append(ids, ids[1]) WHEN 3 THEN list_append(ids, 'elsewhere') ELSE ids END AS ids, CASE g % 5 WHEN 1 THEN list_append(qs, qs[1]) WHEN 2 THEN list_append(qs, 'a9:q1') ELSE qs END AS qs FROM l),
m AS (SELECT k.event_id, k.claim, count(*) AS n, count(DISTINCT u.q) AS nq, count(*) FILTER (WHERE a.article_id IS NULL) AS unknown, list_sort(list_distinct(list(a.article_id) FILTER (WHERE a.article_id IS NOT NULL))) AS found, string_agg(a.article_id || '=' || a.text, ';' ORDER BY u.i) AS cited
  FROM k, LATERAL (SELECT unnest(qs) AS q, generate_subscripts(qs, 1) AS i) u LEFT JOIN anchors a ON a.event_id = k.event_id AND a.quote_id = u.q GROUP BY 1, 2)
SELECT event_id, CAST(claim AS INTEGER) AS claim, sha256(coalesce(cited, '')) AS cited_sha, array_to_string(list_filter([CASE WHEN nq < n THEN 'repeated_quote' END, CASE WHEN unknown > 0 THEN 'unknown_quote' END, CASE WHEN coalesce(found, CAST([] AS VARCHAR[])) <> list_sort(list_distinct(ids)) OR len(list_distinct(ids)) <> len(ids) THEN 'article_mismatch' END,
  CASE WHEN len(list_distinct(ids)) < len(ids) THEN 'repeated_article' END, CASE WHEN list_contains(ids, 'elsewhere') THEN 'not_in_evidence' END], lambda x: x IS NOT NULL), ',') AS violations FROM k JOIN m USING (event_id, claim)""")
def anchor_resolution(spark, sf):
    out = ev.resolve_claims(cited_claims(spark, sf), ev.passage_anchors(read_passages(spark, sf)), evidence(spark, sf))
    cited = F.array_join(F.transform("citations", lambda c: F.concat(c["article_id"], F.lit("="), c["excerpt"])), ";")
    return out.select("event_id", "claim", F.sha2(cited, 256).alias("cited_sha"), F.array_join("violations", ",").alias("violations"))


@query("v06_read_excerpts", ANCHORS + """, q AS (SELECT *, 'a' || (pos + CASE WHEN pos % 5 = 2 THEN 2 ELSE 1 END) || ':q' || (pos % 2 + 1) AS quote_id FROM evidence)
SELECT q.event_id, q.pos, CASE WHEN a.text IS NULL THEN 'foreign_quote' WHEN NOT EXISTS (SELECT 1 FROM pass p WHERE p.article_id = q.article_id AND contains(trim(regexp_replace(p.block, '[ \\t\\r\\n]+', ' ', 'g'), ' '), trim(regexp_replace(q.excerpt, '[ \\t\\r\\n]+', ' ', 'g'), ' '))) THEN 'not_read' END AS problem
FROM q LEFT JOIN anchors a ON a.event_id = q.event_id AND a.article_id = q.article_id AND a.quote_id = q.quote_id""")
def read_excerpts(spark, sf):
    quote = F.concat(F.lit("a"), F.col("pos") + F.when(F.col("pos") % 5 == 2, 2).otherwise(1), F.lit(":q"), F.col("pos") % 2 + 1)
    read = written(read_passages(spark, sf), "read")  # two branches read it, and all texts stand behind it
    return ev.resolve_evidence(evidence(spark, sf).withColumn("quote_id", quote), ev.passage_anchors(read), read).select("event_id", "pos", "problem")


def claims(spark, sf):
    rows = evidence(spark, sf).join(articles(spark, sf).select("article_id", "doc_id"), "article_id").join(events(spark, sf).select("event_id", "credibility"), "event_id")
    return rows.groupBy("event_id", (F.col("doc_id") % 2).alias("claim")).agg(
        F.first("credibility").alias("requested"), F.array_sort(F.collect_list("article_id")).alias("article_ids"), F.element_at(F.array(*map(F.lit, ("supported", "contradicted", "insufficient"))), (F.max("doc_id") % 3 + 1).cast("int")).alias("verdict")
    )


CLAIMS = FULL + """, claims AS (SELECT event_id, doc_id % 2 AS claim, any_value(e.credibility) AS requested, list(article_id) AS ids, ['supported', 'contradicted', 'insufficient'][max(doc_id) % 3 + 1] AS verdict FROM he JOIN events_v e USING (event_id) GROUP BY 1, 2)"""


@query("v07_claim_downgrade", CLAIMS + " SELECT event_id, CASE WHEN bool_or(verdict = 'contradicted') OR any_value(requested) = 'disputed' THEN CASE WHEN any_value(n) >= 2 THEN 'disputed' END WHEN bool_or(verdict = 'insufficient') THEN 'unverified' ELSE any_value(requested) END AS credibility FROM claims LEFT JOIN (SELECT event_id, count(DISTINCT article_id) AS n FROM evidence WHERE role NOT IN ('repost', 'unknown') AND CAST(substr(event_id, 2) AS BIGINT) % 3 <> pos GROUP BY 1) USING (event_id) GROUP BY 1")
def downgrade(spark, sf):
    cited = evidence(spark, sf).where("role NOT IN ('repost', 'unknown') AND CAST(substring(event_id, 2) AS BIGINT) % 3 <> pos")
    return ev.claim_downgrade(claims(spark, sf), cited)


@query("v06_unsupported_claims", CLAIMS + " SELECT c.event_id, c.claim, c.a AS article_id FROM (SELECT event_id, claim, unnest(ids) AS a FROM claims) c WHERE NOT EXISTS (SELECT 1 FROM evidence e WHERE e.event_id = c.event_id AND e.article_id = c.a AND e.role <> 'repost')")
def unsupported(spark, sf):
    return ev.unsupported_claims(claims(spark, sf), evidence(spark, sf).where("role <> 'repost'")).select("event_id", "claim", "article_id")


@query("v08_first_party", FULL + """, al(publisher_id, alias) AS (VALUES ('p1', 'Event 1'), ('p3', 'e-v-e'), ('p4', 'zz'), ('p6', 'vent 2')),
s AS (SELECT event_id, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS subject FROM events_v)
SELECT he.event_id, he.article_id, CASE WHEN role = 'first_party' AND NOT EXISTS (SELECT 1 FROM al WHERE al.publisher_id = he.publisher_id AND length(regexp_replace(lower(alias), '[^a-z0-9]', '', 'g')) >= 3 AND contains(s.subject, regexp_replace(lower(alias), '[^a-z0-9]', '', 'g'))) THEN 'unknown' ELSE role END AS final_role,
  CASE WHEN role = 'first_party' AND publisher_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM al WHERE al.publisher_id = he.publisher_id AND length(regexp_replace(lower(alias), '[^a-z0-9]', '', 'g')) >= 3 AND contains(s.subject, regexp_replace(lower(alias), '[^a-z0-9]', '', 'g'))) THEN 'first_party_unconfirmed' END AS gap
FROM he JOIN s USING (event_id)""")
def first_party(spark, sf):
    rows = evidence(spark, sf).join(full_articles(spark, sf).select("article_id", "publisher_id"), "article_id")
    aliases = spark.createDataFrame([("p1", "Event 1"), ("p3", "e-v-e"), ("p4", "zz"), ("p6", "vent 2")], "publisher_id string, alias string")
    return ev.first_party_relation(rows, events(spark, sf).select("event_id", F.col("title").alias("subject")), aliases).select("event_id", "article_id", "final_role", "gap")


def verdicts(spark, sf):
    return articles(spark, sf).select(
        "article_id", "monitor_id", "doc_id", F.expr("concat('b', doc_id div 4) AS batch"), F.expr("IF(doc_id % 3 = 0, 'irrelevant', IF(doc_id % 31 = 0, 'maybe', 'relevant')) AS decision"), F.expr("doc_id * 37 % 104 AS relevance"),
        F.expr("doc_id * 53 % 101 AS value"), F.expr("IF(doc_id % 8 = 0, '', element_at(array('Go', 'C++', 'C', ' c++ ', 'Tool  4.1', 'tool 4.1', 'Tool 41', 'GO', 'tool-41'), CAST(doc_id % 9 + 1 AS INT))) AS subject"), F.expr("IF(doc_id % 10 = 0, NULL, IF(doc_id % 4 = 1, 'Releases', 'releases')) AS action"),
        F.expr("CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN '2024-02-30' WHEN doc_id % 11 = 0 THEN '2099-01-01' ELSE '2024-01-15' END AS event_date"), F.expr("element_at(array('V2', 'v2', '4.1', '41', '', NULL), CAST(doc_id % 6 + 1 AS INT)) AS version"), F.expr("concat('Key-', doc_id % 5) AS event_key"),
    )


VERDICTS = """, verdicts AS (SELECT article_id, monitor_id, doc_id, 'b' || (doc_id // 4) AS batch, CASE WHEN doc_id % 3 = 0 THEN 'irrelevant' WHEN doc_id % 31 = 0 THEN 'maybe' ELSE 'relevant' END AS decision, doc_id * 37 % 104 AS relevance, doc_id * 53 % 101 AS value,
  CASE WHEN doc_id % 8 = 0 THEN '' ELSE ['Go', 'C++', 'C', ' c++ ', 'Tool  4.1', 'tool 4.1', 'Tool 41', 'GO', 'tool-41'][doc_id % 9 + 1] END AS subject, CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN 'Releases' ELSE 'releases' END AS action,
  CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN '2024-02-30' WHEN doc_id % 11 = 0 THEN '2099-01-01' ELSE '2024-01-15' END AS event_date, ['V2', 'v2', '4.1', '41', '', NULL][doc_id % 6 + 1] AS version, 'Key-' || (doc_id % 5) AS event_key, source, collected_at FROM articles)"""


@query("v01_constraints", VERDICTS + f""" SELECT article_id, array_to_string(list_filter([CASE WHEN decision NOT IN ('relevant', 'irrelevant') THEN 'decision' END, CASE WHEN relevance NOT BETWEEN 0 AND 100 THEN 'relevance' END, CASE WHEN decision = 'relevant' AND trim(subject) = '' THEN 'subject' END,
  CASE WHEN decision = 'relevant' AND trim(coalesce(action, '')) = '' THEN 'action' END, CASE WHEN event_date IS NOT NULL AND (try_cast(event_date AS DATE) IS NULL OR epoch_us(CAST(try_cast(event_date AS DATE) AS TIMESTAMP)) // 1000 > {NOW} + 86400000) THEN 'event_date' END], lambda x: x IS NOT NULL), ',') AS violations FROM verdicts""")
def constraints(spark, sf):
    return ev.violations(verdicts(spark, sf), ev.screening_rules(NOW)).select("article_id", F.array_join("violations", ",").alias("violations"))


@query("v01_nested_schema", FULL + """, c AS (SELECT event_id, CAST(substr(event_id, 2) AS BIGINT) AS g, list(struct_pack(claim := CASE WHEN doc_id % 37 = 0 THEN '' ELSE title END, verdict := CASE WHEN doc_id % 41 = 0 THEN 'maybe' ELSE 'supported' END, reason := 'r', n_ids := CASE WHEN doc_id % 43 = 0 THEN 0 ELSE 1 END, excerpt := CASE WHEN doc_id % 47 = 0 THEN substr(text, 1, 300) ELSE substr(text, 1, 60) END) ORDER BY doc_id) AS claims,
  list(struct_pack(role := CASE WHEN doc_id % 53 = 0 THEN 'witness' ELSE role END, excerpt := excerpt)) AS proof FROM he GROUP BY 1),
k AS (SELECT e.event_id, c.g, relevance + CASE WHEN g % 23 = 0 THEN 100 ELSE 0 END AS relevance, value, CASE WHEN g % 29 = 0 THEN '' WHEN g % 10 = 5 THEN 'Event 5' ELSE title END AS title, summary, coalesce(importance, 'unassessed') AS importance, c.claims, c.proof FROM events_v e JOIN c USING (event_id)),
u AS (SELECT title FROM k GROUP BY 1 HAVING count(*) > 1),
p AS (SELECT event_id, list_filter([CASE WHEN length(title) NOT BETWEEN 1 AND 120 THEN 'title' END, CASE WHEN length(summary) NOT BETWEEN 1 AND 600 THEN 'summary' END, CASE WHEN relevance NOT BETWEEN 0 AND 100 THEN 'relevance' END, CASE WHEN value IS NULL THEN 'value' END, CASE WHEN g % 31 = 0 THEN 'gaps' END, CASE WHEN g % 31 = 1 THEN 'gaps[]' END,
  CASE WHEN len(claims) > 5 THEN 'claims' END, CASE WHEN len(list_filter(claims, lambda x: length(x.claim) NOT BETWEEN 1 AND 250)) > 0 THEN 'claims[].claim' END, CASE WHEN len(list_filter(claims, lambda x: x.verdict = 'maybe')) > 0 THEN 'claims[].verdict' END,
  CASE WHEN len(list_filter(claims, lambda x: x.n_ids = 0)) > 0 THEN 'claims[].article_ids' END, CASE WHEN len(list_filter(claims, lambda x: length(x.excerpt) NOT BETWEEN 8 AND 250)) > 0 THEN 'claims[].citations[].excerpt' END,
  CASE WHEN len(list_filter(proof, lambda x: x.role = 'witness')) > 0 THEN 'evidence[].role' END, CASE WHEN len(list_filter(proof, lambda x: length(x.excerpt) NOT BETWEEN 8 AND 250)) > 0 THEN 'evidence[].excerpt' END, CASE WHEN u.title IS NOT NULL THEN 'unique title' END], lambda x: x IS NOT NULL) AS v FROM k LEFT JOIN u USING (title))
SELECT event_id, array_to_string(v, ',') AS violations FROM p WHERE len(v) > 0""")
def nested_schema(spark, sf):
    """Assessments as nested rows, with planted faults: what goes to quarantine."""
    rows = evidence(spark, sf).join(articles(spark, sf).select("article_id", "doc_id", F.col("title").alias("head"), "text").hint("merge"), "article_id")
    bad = lambda n, yes, no: F.when(F.col("doc_id") % n == 0, yes).otherwise(no)
    none = F.array().cast("array<string>")
    claim = F.struct(
        bad(37, F.lit(""), F.col("head")).alias("claim"), bad(41, F.lit("maybe"), F.lit("supported")).alias("verdict"), F.lit("r").alias("reason"), bad(43, none, F.array("article_id")).alias("article_ids"),
        F.array(F.struct("article_id", bad(47, F.substring("text", 1, 300), F.substring("text", 1, 60)).alias("excerpt"))).alias("citations"),
    )
    proof = F.struct("article_id", bad(53, F.lit("witness"), F.col("role")).alias("role"), "excerpt")
    lists = rows.groupBy("event_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", claim.alias("c")))), lambda x: x["c"]).alias("claims"), F.collect_list(proof).alias("proof"))
    g = F.expr("CAST(substring(event_id, 2) AS BIGINT)")
    e = events(spark, sf).drop("evidence").join(lists.hint("merge"), "event_id").withColumn("g", g).select(
        "event_id", F.lit("publish").alias("disposition"), F.when(F.col("g") % 29 == 0, "").when(F.col("g") % 10 == 5, "Event 5").otherwise(F.col("title")).alias("title"), "summary", (F.col("relevance") + F.when(F.col("g") % 23 == 0, 100).otherwise(0)).alias("relevance"), "value",
        F.lit("i").alias("impact"), F.coalesce("importance", F.lit("unassessed")).alias("importance"), F.lit("i").alias("importance_reason"), "credibility", F.lit("r").alias("reason"),
        F.when(F.col("g") % 31 == 0, F.array_repeat(F.lit("gap"), 7)).when(F.col("g") % 31 == 1, F.array(F.repeat(F.lit("g"), F.lit(201)))).otherwise(none).alias("gaps"), "claims", F.col("proof").alias("evidence"),
    )
    return constraints_.quarantined(e, constraints_.EVENT, {"unique title": [F.col("title")]})[1].select("event_id", F.array_join("violations", ",").alias("violations"))


@query("v02_coverage", VERDICTS + """, o AS (SELECT batch, article_id FROM verdicts WHERE doc_id % 9 <> 0 UNION ALL SELECT batch, article_id FROM verdicts WHERE doc_id % 14 = 1 UNION ALL SELECT batch, 'x' || article_id FROM verdicts WHERE doc_id % 15 = 2),
oc AS (SELECT batch, article_id, count(*) AS n FROM o GROUP BY 1, 2), b AS (SELECT coalesce(v.batch, oc.batch) AS batch, v.article_id AS i, oc.article_id AS u, oc.n FROM verdicts v FULL JOIN oc ON v.batch = oc.batch AND v.article_id = oc.article_id)
SELECT batch, count(*) FILTER (WHERE i IS NULL) AS unknown, count(*) FILTER (WHERE n > 1) AS repeated, count(*) FILTER (WHERE u IS NULL) AS missing, count(*) FILTER (WHERE i IS NULL OR n > 1 OR u IS NULL) > 0 AS rejected FROM b GROUP BY 1""")
def coverage(spark, sf):
    v = verdicts(spark, sf).select("batch", "article_id", "doc_id")
    outputs = v.where("doc_id % 9 <> 0").unionByName(v.where("doc_id % 14 = 1")).unionByName(v.where("doc_id % 15 = 2").withColumn("article_id", F.concat(F.lit("x"), "article_id")))
    return ev.batch_coverage(v, outputs)


@query("c01_digest", "SELECT article_id, sha256(text_norm || chr(1) || url || chr(1) || coalesce(CAST(likes AS VARCHAR), chr(0)) || chr(1) || 'v2') AS digest FROM articles")
def digest(spark, sf):
    return articles(spark, sf).select("article_id", candidates.change_digest("text_norm", "url", "likes", F.lit("v2")).alias("digest"))


@query("c02_transition", """, o AS (SELECT article_id, doc_id, state, 'd' || (doc_id % 50) AS od, ['pending','selected','filtered','observing','background'][doc_id % 5 + 1] AS os FROM judged),
t AS (SELECT *, od = CASE WHEN doc_id % 7 = 0 THEN 'new' ELSE od END AND doc_id % 23 <> 0 AND NOT ((os = 'filtered' AND state <> 'filtered') OR ((os = 'observing') <> (state = 'observing')) OR (state = 'background' AND os <> 'background')) AS stays FROM o)
SELECT article_id, CASE WHEN stays THEN os ELSE state END AS state, CASE WHEN doc_id % 23 <> 0 AND NOT stays AND os NOT IN ('pending', 'queued') THEN os || ':' || (doc_id % 100) ELSE '' END AS history, doc_id % 23 <> 0 AND NOT stays AS recheck FROM t""")
def transition(spark, sf):
    j = judged(spark, sf)
    old = j.where("doc_id % 23 <> 0").selectExpr("article_id", "concat('d', doc_id % 50) AS digest", "element_at(array('pending','selected','filtered','observing','background'), CAST(doc_id % 5 + 1 AS INT)) AS state", "doc_id % 100 AS relevance", "'g' AS group_key", "CAST(array() AS array<string>) AS history")
    new = j.selectExpr("article_id", "IF(doc_id % 7 = 0, 'new', concat('d', doc_id % 50)) AS digest", "state")
    out = candidates.transition(old, new)
    return out.select("article_id", "state", F.array_join("history", ",").alias("history"), "recheck")


@query("c03_apply_verdicts", VERDICTS + """ SELECT v.article_id, v.monitor_id, CASE WHEN doc_id % 4 = 0 THEN 'queued' WHEN decision <> 'relevant' THEN 'irrelevant' WHEN v.relevance < m.min_relevance OR v.value < m.min_value THEN 'low_value' ELSE 'selected' END AS state,
  CASE WHEN doc_id % 4 <> 0 THEN v.relevance END AS relevance, CASE WHEN doc_id % 4 <> 0 THEN v.value END AS value FROM verdicts v JOIN monitors m USING (monitor_id)""")
def verdicts_applied(spark, sf):
    v = verdicts(spark, sf)
    rows = v.select("article_id", "monitor_id", F.lit("queued").alias("state"), F.lit("d1").alias("digest"))
    return candidates.apply_verdicts(rows, v.withColumn("digest", F.when(F.col("doc_id") % 4 == 0, "d0").otherwise("d1")), monitors(spark))


SLUG = "replace(lower(trim(regexp_replace({}, '[ \\t\\r\\n]+', ' ', 'g'), ' ')), ' ', '-')"
KEYED = VERDICTS + f""", keyed AS (SELECT *, substr(sha256(concat_ws(chr(1), monitor_id, {SLUG.format("coalesce(subject, '')")}, coalesce(action, chr(0)), {SLUG.format("CASE WHEN coalesce(version, '') = '' THEN 'unknown' ELSE version END")}, coalesce(event_date, chr(0)), {SLUG.format("event_key")})), 1, 32) AS group_key FROM verdicts WHERE decision = 'relevant')"""


def keyed(spark, sf):
    key = candidates.event_group_key(F.col("monitor_id"), F.col("subject"), F.col("action"), F.col("version"), F.col("event_date"), F.col("event_key"))
    return verdicts(spark, sf).where("decision = 'relevant'").withColumn("group_key", key)


@query("c04_group_key", KEYED + " SELECT article_id, group_key FROM keyed")
def group_key(spark, sf):
    return keyed(spark, sf).select("article_id", "group_key")


@query("c05_clusters", KEYED + " SELECT group_key, count(*) AS n_articles, count(DISTINCT source) AS n_sources, min(collected_at) AS began_at, min(article_id) AS first_id FROM keyed GROUP BY 1")
def clustered(spark, sf):
    return candidates.clusters(keyed(spark, sf).join(articles(spark, sf).select("article_id", "source", "collected_at"), "article_id"))
