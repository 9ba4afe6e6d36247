"""Operational reports, set operations and the batch twins of the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.functions.text import local_day
from feedlake.operators import metrics
from feedlake.sources.scratch import shared_path
from feedlake.sources.snapshots import ARTICLE, Snapshot, article_rows, merge_articles
from feedlake.sources.tables import NOW, START, articles, events, monitors, table, usage
from feedlake.streaming import operators as st
from feedlake.streaming.late import late_writer

from .article_queries import judged
from .oracle_views import oracle

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = (run, oracle(sql) if sql else None)
        return run

    return add


@query("o05_daily_usage", "SELECT day, count(*) AS calls, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS known, count(*) FILTER (WHERE tokens IS NULL) AS unknown, CAST(coalesce(sum(reserved) FILTER (WHERE tokens IS NULL), 0) AS BIGINT) AS reserved FROM usage_v GROUP BY 1")
def daily_usage(spark, sf):
    return metrics.daily_usage(usage(spark, sf))


@query("o05_category_usage", "SELECT substr(day, 1, 7) AS month, category, count(*) AS calls FROM usage_v GROUP BY 1, 2")
def category_usage(spark, sf):
    return metrics.category_usage(usage(spark, sf))


@query("o06_quota_audit", """, a AS (SELECT *, row_number() OVER (PARTITION BY day, category = 'click' ORDER BY at_ms, request_id) AS r FROM usage_v), b AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY at_ms, request_id) AS r2 FROM a WHERE category <> 'click' OR r <= 6),
c AS (SELECT *, row_number() OVER (PARTITION BY substr(day, 1, 7) ORDER BY at_ms, request_id) AS r3 FROM b WHERE r2 <= 30)
SELECT u.request_id, u.day, u.category, c.request_id IS NOT NULL AS admitted FROM usage_v u LEFT JOIN (SELECT * FROM c WHERE r3 <= 700) c USING (request_id)""")
def quota(spark, sf):
    return metrics.quota_audit(usage(spark, sf), "click", 6, 30, 700)


@query("o07_budget_fold", """, q AS MATERIALIZED (SELECT day, category <> 'purchase' AS screen, coalesce(tokens, reserved) AS need, row_number() OVER (PARTITION BY day ORDER BY at_ms, request_id) AS k FROM usage_v),
r(day, k, admitted, tokens, refused) AS (SELECT DISTINCT day, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM q UNION ALL
  SELECT day, nk, admitted + CAST(ok AS BIGINT), tokens + CASE WHEN ok THEN need ELSE 0 END, refused + CAST(NOT ok AS BIGINT)
  FROM (SELECT r.*, q.need, q.k AS nk, r.admitted < CASE WHEN q.screen THEN 48 ELSE 60 END AND r.tokens + q.need <= CASE WHEN q.screen THEN 16000 ELSE 20000 END AS ok FROM r JOIN q ON q.day = r.day AND q.k = r.k + 1) z)
SELECT day, arg_max(admitted, k) AS admitted, arg_max(tokens, k) AS tokens, arg_max(refused, k) AS refused FROM r GROUP BY 1""")
def budget(spark, sf):
    return metrics.budget_fold(usage(spark, sf), 60, 20_000, stage=F.col("category") != "purchase")


JOBS = f""", jobs AS (SELECT event_id AS job_id, 'm' || (user_id % 4) AS monitor_id, ['queued','running','failed','done','budget','running'][event_id % 6 + 1] AS state, ['screen','deep'][event_id % 2 + 1] AS stage,
  {NOW} + (event_id % 7 - 3) * 60000 AS lease_until, CASE WHEN event_id % 5 = 0 THEN {NOW} + (event_id % 3 - 1) * 60000 END AS next_attempt_at, epoch_us(ts) // 1000 AS created_at, CASE WHEN event_id % 4 = 0 THEN epoch_us(ts) // 1000 + event_id % 1000 END AS finished_at FROM events)"""


def jobs(spark, sf):
    return table(spark, sf, "events").selectExpr(
        "event_id AS job_id", "concat('m', user_id % 4) AS monitor_id", "element_at(array('queued','running','failed','done','budget','running'), CAST(event_id % 6 + 1 AS INT)) AS state",
        "element_at(array('screen','deep'), CAST(event_id % 2 + 1 AS INT)) AS stage", f"{NOW} + (event_id % 7 - 3) * 60000 AS lease_until", f"IF(event_id % 5 = 0, {NOW} + (event_id % 3 - 1) * 60000, NULL) AS next_attempt_at",
        "unix_micros(CAST(ts AS timestamp)) div 1000 AS created_at", "IF(event_id % 4 = 0, unix_micros(CAST(ts AS timestamp)) div 1000 + event_id % 1000, NULL) AS finished_at",
    )


@query("o04_activity", JOBS + f""", k AS (SELECT *, CASE WHEN state = 'running' AND lease_until > {NOW} THEN 'running_' || stage WHEN monitor_id NOT IN ('m0', 'm1', 'm2') THEN 'paused' WHEN state = 'failed' THEN 'failed' WHEN state = 'budget' THEN 'budget'
  WHEN coalesce(next_attempt_at > {NOW}, FALSE) THEN 'retry' ELSE 'queued' END AS activity FROM jobs WHERE state <> 'done')
SELECT activity, count(*) AS n, coalesce(string_agg(DISTINCT CASE WHEN activity LIKE 'running%' THEN monitor_id END, ',' ORDER BY CASE WHEN activity LIKE 'running%' THEN monitor_id END), '') AS channels FROM k GROUP BY 1""")
def activity(spark, sf):
    out = metrics.activity(jobs(spark, sf), NOW, ["m0", "m1", "m2"])
    return out.withColumn("channels", F.array_join("channels", ","))


@query("a12_job_time", JOBS + " SELECT monitor_id, CAST(coalesce(sum(finished_at - created_at), 0) AS BIGINT) AS ms, count(*) AS n FROM jobs GROUP BY 1")
def job_time(spark, sf):
    return jobs(spark, sf).groupBy("monitor_id").agg(F.coalesce(F.sum(F.col("finished_at") - F.col("created_at")), F.lit(0)).alias("ms"), F.count(F.lit(1)).alias("n"))


REPORTS = """, reports AS (SELECT strftime(ts, '%Y-%m-%d') || '/' || (event_id % 37) AS run, 's' || (user_id % 6) AS source, ['ok','ok','partial','error','skipped','budget','unconfigured','ok'][(event_id // 7) % 8 + 1] AS status,
  ['account','topic','refresh'][event_id % 3 + 1] AS lane, CAST(event_id % 10 AS BIGINT) AS n, event_id FROM events)"""


def reports(spark, sf):
    return table(spark, sf, "events").selectExpr(
        "concat(date_format(ts, 'yyyy-MM-dd'), '/', event_id % 37) AS run", "concat('s', user_id % 6) AS source", "element_at(array('ok','ok','partial','error','skipped','budget','unconfigured','ok'), CAST(event_id div 7 % 8 + 1 AS INT)) AS status",
        "element_at(array('account','topic','refresh'), CAST(event_id % 3 + 1 AS INT)) AS lane", "event_id % 10 AS n", "map('low', event_id % 3, 'repost', 1L) AS reasons", "event_id",
    )


@query("a11_run_status", REPORTS + " SELECT run, CASE WHEN bool_and(status IN ('error', 'unconfigured')) THEN 'failed' WHEN bool_or(status NOT IN ('ok', 'skipped')) THEN 'partial' ELSE 'success' END AS status, CAST(sum(n) AS BIGINT) AS n FROM reports GROUP BY 1")
def run_status(spark, sf):
    return metrics.run_status(reports(spark, sf))


@query("a10_merge_lanes", REPORTS + """ SELECT run, source, CAST(sum(n) AS BIGINT) AS n, CASE WHEN max(status) FILTER (WHERE lane = 'refresh' AND status <> 'ok') IS NOT NULL THEN max(status) FILTER (WHERE lane = 'refresh' AND status <> 'ok') WHEN bool_and(status IN ('ok', 'skipped')) THEN 'ok'
  WHEN bool_and(status = 'unconfigured') THEN 'unconfigured' WHEN bool_and(status = 'error') THEN 'error' WHEN bool_or(status = 'budget') THEN 'budget' ELSE 'partial' END AS status,
  'low:' || CAST(sum(event_id % 3) AS BIGINT) || ',repost:' || count(*) AS reasons FROM reports GROUP BY 1, 2""")
def lanes(spark, sf):
    out = metrics.merge_lanes(reports(spark, sf))
    return out.withColumn("reasons", F.array_join(F.transform(F.map_entries("reasons"), lambda e: F.concat_ws(":", e["key"], e["value"])), ","))


@query("n13_run_report", REPORTS + """ SELECT run, source, count(*) AS raw, count(*) FILTER (WHERE status = 'ok') AS kept, count(*) FILTER (WHERE status <> 'ok') AS filtered,
  (SELECT string_agg(s || ':' || k, ',' ORDER BY s) FROM (SELECT status AS s, count(*) AS k FROM reports q WHERE q.run = r.run AND q.source = r.source AND status <> 'ok' GROUP BY 1)) AS reasons FROM reports r GROUP BY run, source""")
def run_report(spark, sf):
    from feedlake.sources.payloads import run_report as report

    rows = reports(spark, sf).select("run", "source", F.when(F.col("status") != "ok", F.col("status")).alias("reason"))
    return report(rows).withColumn("reasons", F.when(F.col("reasons").isNotNull(), F.array_join(F.transform(F.map_entries("reasons"), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")))


@query("o08_high_water", """, runs AS (SELECT 'm' || (user_id % 4) AS monitor_id, 's' || (user_id % 6) AS source, ['ok','partial','error'][event_id % 3 + 1] AS status, 'f' || (event_id % 2) AS fingerprint, epoch_us(ts) // 1000 AS completed_at FROM events WHERE user_id % 5 <> 0 OR event_id % 3 <> 0)
SELECT r.monitor_id, r.source, max(completed_at) FILTER (WHERE status = 'ok' AND fingerprint = CASE r.monitor_id WHEN 'm3' THEN 'f9' ELSE 'f1' END) AS completed_at, max(completed_at) FILTER (WHERE status = 'ok' AND fingerprint = CASE r.monitor_id WHEN 'm3' THEN 'f9' ELSE 'f1' END) - 120000 AS next_from FROM runs r GROUP BY 1, 2""")
def high_water(spark, sf):
    runs = table(spark, sf, "events").where("user_id % 5 <> 0 OR event_id % 3 <> 0").selectExpr("concat('m', user_id % 4) AS monitor_id", "concat('s', user_id % 6) AS source", "element_at(array('ok','partial','error'), CAST(event_id % 3 + 1 AS INT)) AS status", "concat('f', event_id % 2) AS fingerprint", "unix_micros(CAST(ts AS timestamp)) div 1000 AS completed_at")
    prints = spark.createDataFrame([("m0", "f1"), ("m1", "f1"), ("m2", "f1"), ("m3", "f9")], "monitor_id string, fingerprint string")
    return metrics.high_water(runs, prints)


@query("o01_funnel", "SELECT 'raw' AS step, count(*) AS n FROM articles UNION ALL SELECT 'state_' || state, count(*) FROM judged GROUP BY 1 UNION ALL SELECT 'displayed', count(*) FROM events_v JOIN monitors USING (monitor_id) WHERE relevance >= min_relevance AND coalesce(value, 100) >= min_value")
def funnel(spark, sf):
    one = F.count(F.lit(1)).alias("n")
    rows = articles(spark, sf).agg(one).select(F.lit("raw").alias("step"), "n")
    states = judged(spark, sf).groupBy(F.concat(F.lit("state_"), "state").alias("step")).agg(one)
    gates = F.broadcast(monitors(spark).select("monitor_id", "min_relevance", "min_value"))
    shown = events(spark, sf).join(gates, "monitor_id").where((F.col("relevance") >= F.col("min_relevance")) & (F.coalesce("value", F.lit(100)) >= F.col("min_value"))).agg(one).select(F.lit("displayed").alias("step"), "n")
    return rows.unionByName(states).unionByName(shown)


@query("o02_recent", "SELECT article_id, state, title FROM judged ORDER BY collected_at DESC, article_id LIMIT 30")
def recent(spark, sf):
    top = judged(spark, sf).select("article_id", "state", "collected_at", "title")
    return top.orderBy(F.desc("collected_at"), "article_id").limit(30).select("article_id", "state", "title")


@query("u01_union", "SELECT source, count(*) AS n, count(lane) AS with_lane FROM (SELECT source, NULL AS lane FROM articles WHERE source = 'x' UNION ALL SELECT source, content_kind FROM articles WHERE source IN ('google', 'bing')) GROUP BY 1")
def union(spark, sf):
    a = articles(spark, sf)
    every = a.where("source = 'x'").select("source").unionByName(a.where("source IN ('google', 'bing')").select("source", F.col("content_kind").alias("lane")), allowMissingColumns=True)
    return every.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("lane").alias("with_lane"))


@query("u02_ordered_union", "SELECT article_id, CASE WHEN source = 'google' THEN 'google,hn' WHEN source = 'hn' THEN 'hn,google' ELSE source || ',google,hn' END AS found FROM articles")
def ordered_union(spark, sf):
    return articles(spark, sf).select("article_id", F.array_join(F.array_union(F.array("source"), F.array(F.lit("google"), F.lit("hn"))), ",").alias("found"))


@query("u03_difference", "SELECT DISTINCT url FROM articles WHERE source = 'x' EXCEPT SELECT url FROM articles WHERE is_repost")
def difference(spark, sf):
    a = articles(spark, sf)
    return a.where("source = 'x'").select("url").distinct().join(a.where("is_repost").select("url").distinct(), "url", "left_anti")


@query("w02_growth", """, s AS (SELECT user_id AS article_id, event_id AS sample_id, epoch_us(ts) // 1000 AS sampled_at, CAST(floor(coalesce(value, 0)) AS BIGINT) AS likes FROM events WHERE event_type IN ('view', 'click')),
d AS (SELECT *, likes - lag(likes) OVER (PARTITION BY article_id ORDER BY sampled_at, sample_id) AS step FROM s) SELECT article_id, count(*) AS samples, CAST(coalesce(sum(step) FILTER (WHERE step > 0), 0) AS BIGINT) AS growth FROM d GROUP BY 1""")
def growth(spark, sf):
    s = table(spark, sf, "events").where("event_type IN ('view', 'click')").selectExpr("user_id AS article_id", "event_id AS sample_id", "unix_micros(CAST(ts AS timestamp)) div 1000 AS sampled_at", "CAST(floor(coalesce(value, 0)) AS BIGINT) AS likes")
    return metrics.metric_growth(s)


#: One day to wait, 20 likes, due every 6 hours after that, for 3 days.
RULE = st.Rule(1440, 20, 360, 4320)
UNTIL = NOW + 30 * 86_400_000
OBSERVED = f""", p AS (SELECT doc_id AS article, {START} + (doc_id * 7919 % 2592000 + doc_id % 172800) * 1000 AS at_ms, CASE WHEN doc_id % 17 = 0 THEN 0 ELSE {START} + (doc_id * 7919 % 2592000) * 1000 END AS published_ms,
  doc_id * 31 % 25 AS likes, doc_id % 11 = 0 AS exempt FROM documents),
c AS (SELECT article, at_ms + (article % 7 * 9 + k * 13) * 3600000 AS t, (article * 31 + k * 17) % 40 >= 20 AS ok FROM p, range(3) r(k) WHERE article % (k + 3) <> 0),
d AS (SELECT *, published_ms + 86400000 AS deadline, CASE WHEN exempt OR likes >= 20 THEN 'pending' WHEN published_ms = 0 OR at_ms >= published_ms + 86400000 THEN 'filtered' END AS at_once FROM p),
m AS (SELECT article, min(struct_pack(t := t, failed := NOT ok)) AS m FROM d JOIN c USING (article) WHERE at_once IS NULL AND t >= at_ms AND t <= deadline + 259200000 AND (ok OR t >= deadline) GROUP BY 1),
f AS (SELECT *, deadline + 259200000 AS fin FROM d LEFT JOIN m USING (article))
SELECT article, coalesce(at_once, CASE WHEN m IS NOT NULL THEN CASE WHEN m.failed THEN 'filtered' ELSE 'pending' END ELSE 'expired' END) AS verdict, CASE WHEN at_once IS NOT NULL THEN at_ms WHEN m IS NOT NULL THEN m.t ELSE fin END AS at_ms FROM f
UNION ALL SELECT article, 'due', unnest(range(deadline, coalesce(m.t, fin), 21600000)) FROM f WHERE at_once IS NULL"""


def _posts(docs):
    at = F.expr(f"timestamp_millis({START} + (doc_id * 7919 % 2592000 + doc_id % 172800) * 1000)")
    return docs.select(F.col("doc_id").alias("article"), at.alias("at"), F.expr(f"IF(doc_id % 17 = 0, 0L, {START} + (doc_id * 7919 % 2592000) * 1000)").alias("published_ms"), F.expr("doc_id * 31 % 25").alias("likes"), F.expr("doc_id % 11 = 0").alias("exempt"))


def _checks(posts):
    each = posts.select("article", "at", F.explode(F.array(*map(F.lit, range(3)))).alias("k")).where("article % (k + 3) <> 0")
    return each.select("article", F.timestamp_millis(F.unix_millis("at") + (F.col("article") % 7 * 9 + F.col("k") * 13) * 3_600_000).alias("at"), ((F.col("article") * 31 + F.col("k") * 17) % 40).alias("likes"))


@query("w03_observation_batch", OBSERVED)
def observation(spark, sf):
    posts = _posts(table(spark, sf, "documents"))
    return st.observe_batch(posts, _checks(posts), RULE, UNTIL)


COOLED = """, n AS MATERIALIZED (SELECT user_id AS key, epoch_us(ts) // 1000 AS at_ms FROM events WHERE event_type = 'purchase'),
r(key, at_ms) AS (SELECT key, min(at_ms) FROM n GROUP BY 1 UNION ALL SELECT r.key, (SELECT min(n.at_ms) FROM n WHERE n.key = r.key AND n.at_ms >= r.at_ms + 86400000) FROM r WHERE EXISTS (SELECT 1 FROM n WHERE n.key = r.key AND n.at_ms >= r.at_ms + 86400000))
SELECT key, at_ms FROM r"""


@query("w04_cooldown_batch", COOLED)
def cooldown(spark, sf):
    n = table(spark, sf, "events").where("event_type = 'purchase'").selectExpr("user_id AS key", "unix_micros(CAST(ts AS timestamp)) div 1000 AS at_ms")
    return st.cooldown_batch(n, 86_400_000)


@query("w05_usage_windows", "SELECT CAST(date_trunc('day', ts + INTERVAL 8 HOUR) AS TIMESTAMP) - INTERVAL 8 HOUR AS start, event_type AS category, count(*) AS calls FROM events GROUP BY 1, 2")
def usage_windows(spark, sf):
    e = table(spark, sf, "events").selectExpr("CAST(ts AS timestamp) AS at", "event_type AS category")
    return st.usage_windows_batch(e, "at", "category").withColumn("start", F.col("start").cast("timestamp_ntz"))


def _stream(spark, sf, name):
    """A given table as a stream, whether it is one file or a folder of files: only a pattern takes either, and a filter on file names would leave out those in a folder."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def _checkpoint(spark):
    return shared_path(spark, "stream")


@query("w05_usage_stream", "SELECT CAST(date_trunc('day', ts + INTERVAL 8 HOUR) AS TIMESTAMP) - INTERVAL 8 HOUR AS start, event_type AS category, count(*) AS calls FROM events GROUP BY 1, 2")
def usage_stream(spark, sf):
    """The streaming operator over the events file: every window, once it is closed."""
    s = _stream(spark, sf, "events").selectExpr("CAST(ts AS timestamp) AS at", "event_type AS category")
    return st.run_closed(lambda x: st.usage_windows(x, "at", "category"), s, "at", _checkpoint(spark)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("w04_cooldown_stream", COOLED)
def cooldown_stream(spark, sf):
    s = _stream(spark, sf, "events").where("event_type = 'purchase'").selectExpr("user_id AS key", "CAST(ts AS timestamp) AS at")
    return st.run_closed(lambda x: st.cooldown(x, 86_400_000), s, "at", _checkpoint(spark))


@query("w03_observation_stream", OBSERVED)
def observation_stream(spark, sf):
    def run(docs):
        posts = docs.select("article", "at", "published_ms", "likes", "exempt")
        return st.observe(posts, _checks(posts.where("article IS NOT NULL")), RULE)

    return st.run_closed(run, _posts(_stream(spark, sf, "documents")), "at", _checkpoint(spark))


@query("d07_stream_distinct", "SELECT user_id AS article_id FROM events GROUP BY 1")
def stream_distinct(spark, sf):
    s = _stream(spark, sf, "events").selectExpr("CAST(ts AS timestamp) AS at", "user_id AS article_id")
    rows = st.run_available(st.distinct_in_window(s, "article_id", "at", "60 days"), _checkpoint(spark))
    return rows.select("article_id")


@query("o05_local_day", "SELECT article_id, strftime(to_timestamp(published_at / 1000) AT TIME ZONE 'UTC' + INTERVAL 8 HOUR, '%Y-%m-%d') AS day FROM articles WHERE published_at > 0")
def local_days(spark, sf):
    return articles(spark, sf).where("published_at > 0").select("article_id", local_day(F.col("published_at")).alias("day"))


def _addressed(spark, sf):
    """Articles under the first one with their URL, with ``early`` for the first half of the time."""
    a = articles(spark, sf)
    first = a.groupBy("url").agg(F.min_by("article_id", F.struct("collected_at", "article_id")).alias("canonical_id"))
    groups = a.select("article_id", "url").join(first.hint("merge"), "url").select("article_id", "canonical_id")
    return article_rows(a, groups, "topic").withColumn("early", F.col("collected_at") < START + (NOW - START) // 2)


@query("j09_snapshot_merge", f""", f AS (SELECT url, arg_min(article_id, (collected_at, article_id)) AS id FROM articles GROUP BY 1),
r AS (SELECT f.id, a.*, a.article_id = f.id AS own, a.content_status = 'full' AS full_text FROM articles a JOIN f USING (url))
SELECT id AS article_id, arg_min(source, (collected_at, article_id)) AS source, min(collected_at) AS collected_at, coalesce(arg_min(published_at, (collected_at, article_id)) FILTER (WHERE published_at > 0), 0) AS published_at,
  arg_max(coalesce(likes, -1), (collected_at, article_id)) AS likes, sha256(arg_max(text, (full_text, collected_at, article_id))) AS text_sha, arg_max(author, (full_text, collected_at, article_id)) FILTER (WHERE own) AS author,
  array_to_string(list_distinct(list(author)).list_sort(), ',') AS authors, array_to_string(list_distinct(list(source)).list_sort(), ',') AS sources FROM r GROUP BY 1""")
def snapshot_merge(spark, sf):
    """Two versions of an article snapshot: the first half of the time, then the rest merged into the buckets that it touches."""
    rows = _addressed(spark, sf)
    snap = Snapshot(spark, shared_path(spark, "articles"), "article_id", ARTICLE)
    for version, some in enumerate((rows.where("early"), rows.where("NOT early"))):
        snap.merge(some, version, merge_articles)
    listed = lambda c: F.array_join(F.array_sort(c), ",")
    return snap.read(1).select("article_id", "source", "collected_at", "published_at", F.coalesce("likes", F.lit(-1)).alias("likes"), F.sha2("text", 256).alias("text_sha"), "author", listed("discovery_authors").alias("authors"), listed("discovery_sources").alias("sources"))


ARRIVAL = "CAST(least(2, (collected_at - {0}) {1} 864000000 + IF(doc_id % 10 = 3, 1, 0) + IF(doc_id % 50 = 7, 2, 0)) AS INT)"


@query("w06_late_rows", f""", a AS (SELECT article_id, collected_at AS seen, {ARRIVAL.format(START, "//").replace("IF(doc_id % 10 = 3, 1, 0)", "CAST(doc_id % 10 = 3 AS INT)").replace("IF(doc_id % 50 = 7, 2, 0)", "2 * CAST(doc_id % 50 = 7 AS INT)")} AS slot FROM articles),
m AS (SELECT s.slot, (SELECT max(seen) FROM a WHERE a.slot < s.slot) AS mark FROM (SELECT DISTINCT slot FROM a) s)
SELECT article_id, CASE WHEN mark IS NULL OR seen >= mark - 120000 THEN 'on_time' WHEN seen >= mark - 1296000000 THEN 'late' ELSE 'too_late' END AS kind, CASE WHEN mark IS NOT NULL AND seen < mark - 1296000000 THEN mark END AS missed FROM a JOIN m USING (slot)""")
def late_rows(spark, sf):
    """Three micro-batches of articles, some of which come in a later one: each row is on time, late or too late, and only the last kind is not in the snapshot."""
    rows = articles(spark, sf).withColumn("slot", F.expr(ARRIVAL.format(START, "div")))
    path = shared_path(spark, "late")
    snap = Snapshot(spark, f"{path}/articles", "article_id", ARTICLE)
    write = late_writer(path, snap, "collected_at", lambda x: x.select("article_id"), 15 * 86_400_000)
    for number in range(3):
        write(article_rows(rows.where(F.col("slot") == number)), number)
    on_time = spark.read.schema("article_id string").parquet(*[f"{path}/on_time/v{k}" for k in range(3)]).withColumn("kind", F.lit("on_time"))
    gone = spark.read.parquet(*[f"{path}/too_late/v{k}" for k in range(3)]).select("article_id", F.lit("too_late").alias("kind"), F.col("mark").alias("missed"))
    late = snap.read(2).select("article_id").join(on_time.hint("merge"), "article_id", "left_anti").withColumn("kind", F.lit("late"))
    return on_time.unionByName(late).unionByName(gone, allowMissingColumns=True)
