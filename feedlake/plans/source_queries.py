"""Queries over landed payloads: each is written from the given tables as JSON lines or XML and mapped back to articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.functions.text import clean_text, normalize_url
from feedlake.operators import quality
from feedlake.sources import payloads
from feedlake.sources.sinks import upsert_snapshot
from feedlake.sources.tables import NOW, START, accounts, articles, monitors, table

from .oracle_views import oracle

QUERIES: dict = {}
TO = START + 20 * 86400000
ISO = "date_format(timestamp_millis({}), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = (run, oracle(sql) if sql else None)
        return run

    return add


def post_lines(spark, sf):
    a = articles(spark, sf).where("source = 'x'")
    fields = f"""'id', CAST(doc_id AS STRING), 'url', IF(doc_id % 18 = 0, NULL, url), 'text', concat(text, ' see https://a.example/x), http://b.example/y!'), 'isReply', is_reply, 'createdAt', {ISO.format("collected_at")},
      'author', named_struct('userName', author, 'isBlueVerified', is_blue), 'replyCount', replies, 'retweetCount', reposts, 'retweeted', doc_id % 12 = 0, 'links', array('https://a.example/x')"""
    first = a.selectExpr("doc_id AS seq", f"to_json(named_struct({fields}, 'likeCount', IF(doc_id % 9 = 0, -1L, doc_id % 100))) AS line")
    again = a.where("doc_id % 24 = 0").selectExpr("doc_id + 1000000000 AS seq", f"to_json(named_struct({fields}, 'likeCount', 777L)) AS line")
    return first.unionByName(again).unionByName(spark.createDataFrame([(-1, "{broken")], "seq long, line string"))


@query("n01_posts", f"""SELECT substr(sha256('x:' || doc_id), 1, 32) AS article_id, author, CASE WHEN doc_id % 18 = 0 THEN 'https://x.com/' || author || '/status/' || doc_id ELSE url END AS url, collected_at AS published_at,
  CASE WHEN doc_id % 24 = 0 THEN 777 WHEN doc_id % 9 = 0 THEN NULL ELSE doc_id % 100 END AS likes, doc_id % 12 = 0 AS is_repost, length(substr(text || ' see https://a.example/x), http://b.example/y!', 1, 10000)) AS n FROM articles WHERE source = 'x' AND collected_at BETWEEN {START} AND {TO}""")
def posts(spark, sf):
    return payloads.posts(post_lines(spark, sf), START, TO).select("article_id", "author", "url", "published_at", "likes", "is_repost", F.length("text").cast("long").alias("n"))


@query("n01_post_links", "SELECT CAST(doc_id AS VARCHAR) AS external_id, 'https://a.example/x,http://b.example/y' AS links FROM articles WHERE source = 'x' AND NOT regexp_matches(text, 'https?://') UNION ALL SELECT CAST(doc_id AS VARCHAR), 'https://a.example/x,http://b.example/y' FROM articles WHERE source = 'x' AND doc_id % 24 = 0 AND NOT regexp_matches(text, 'https?://')")
def links(spark, sf):
    lines = post_lines(spark, sf).where("seq >= 0 AND NOT regexp_like(split(line, ' see https')[0], '\"text\":\"[^\"]*https?://')")
    return payloads.post_links(lines).select("external_id", F.array_join("links", ",").alias("links"))


@query("n01_post_links_all")
def all_links(spark, sf):
    """n01_post_links over all posts, those with links in their own text too, which its SQL leaves out."""
    return payloads.post_links(post_lines(spark, sf).where("seq >= 0")).select("external_id", F.array_join("links", ",").alias("links"))


@query("n02_lane_guard", f"SELECT substr(sha256('x:' || doc_id), 1, 32) AS article_id, author FROM articles a WHERE source = 'x' AND collected_at BETWEEN {START} AND {TO} AND EXISTS (SELECT 1 FROM handles h WHERE h.monitor_id = 'm3' AND h.handle = lower(a.author))")
def lane(spark, sf):
    handles = quality.monitored_handles(monitors(spark), accounts(spark)).where("monitor_id = 'm3'")
    return payloads.lane_guard(payloads.posts(post_lines(spark, sf), START, TO), handles).select("article_id", "author")


@query("n03_hits", """SELECT substr(sha256('hn:' || doc_id), 1, 32) AS article_id, 'https://news.ycombinator.com/item?id=' || doc_id AS url, collected_at // 1000 * 1000 AS published_at, likes, replies, CASE WHEN doc_id % 4 = 3 THEN 'hn:' || author ELSE 'site' || (doc_id % 25) || '.example.com' END AS origin_key, TRUE AS is_repost, 'discussion' AS content_kind FROM articles WHERE source = 'hn'""")
def hits(spark, sf):
    lines = articles(spark, sf).where("source = 'hn'").selectExpr("to_json(named_struct('objectID', CAST(doc_id AS STRING), 'title', title, 'url', IF(doc_id % 4 = 3, NULL, url), 'story_text', text, 'author', author, 'points', likes, 'num_comments', replies, 'created_at_i', collected_at div 1000)) AS line")
    return payloads.hits(lines).select("article_id", "url", "published_at", "likes", "replies", "origin_key", "is_repost", "content_kind")


@query("n04_repositories", f"SELECT substr(sha256('github:' || doc_id), 1, 32) AS article_id, author || '/repo' || doc_id AS title, collected_at AS published_at, doc_id * 3 AS stars FROM articles WHERE source = 'github' AND collected_at <= {TO}")
def repositories(spark, sf):
    lines = articles(spark, sf).where("source = 'github'").selectExpr(f"to_json(named_struct('id', doc_id, 'full_name', concat(author, '/repo', doc_id), 'description', title, 'html_url', url, 'owner', author, 'stars', doc_id * 3, 'updated_at', {ISO.format('collected_at')})) AS line")
    return payloads.repositories(lines, TO).select("article_id", "title", "published_at", F.col("likes").alias("stars"))


@query("n05_releases", f"SELECT substr(sha256('github:release:' || doc_id), 1, 32) AS article_id, CASE WHEN doc_id % 5 = 0 THEN 'v' || doc_id ELSE 'Release ' || doc_id END || CASE WHEN doc_id % 9 = 1 THEN ' (prerelease)' ELSE '' END AS title, collected_at AS published_at, 'release' AS content_kind FROM articles WHERE source = 'github' AND doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND collected_at BETWEEN {START} AND {TO}")
def releases(spark, sf):
    lines = articles(spark, sf).where("source = 'github'").selectExpr(f"to_json(named_struct('id', doc_id, 'name', IF(doc_id % 5 = 0, NULL, concat('Release ', doc_id)), 'tag_name', concat('v', doc_id), 'body', text, 'html_url', url, 'draft', doc_id % 7 = 0, 'prerelease', doc_id % 9 = 1, 'published_at', IF(doc_id % 11 = 0, NULL, {ISO.format('collected_at')}), 'author', author)) AS line")
    return payloads.releases(lines, START, TO).select("article_id", "title", "published_at", "content_kind")


@query("n06_feeds", f"SELECT substr(sha256('rss:' || url), 1, 32) AS article_id, url, min(collected_at // 1000 * 1000) AS published_at FROM articles WHERE source = 'rss' AND collected_at BETWEEN {START} AND {TO} AND doc_id < 950 GROUP BY 1, 2")
def feeds(spark, sf):
    return feed_rows(articles(spark, sf).where("source = 'rss' AND doc_id < 950"))


@query("n06_feeds_all")
def all_feeds(spark, sf):
    """n06_feeds over all feed articles, where many share a URL; its SQL holds for the first ids only."""
    return feed_rows(articles(spark, sf).where("source = 'rss'"))


def feed_rows(a):
    rss = a.where("doc_id % 2 = 0").selectExpr("doc_id AS seq", "concat('<rss><channel><item><title>T &amp; ', doc_id, '</title><link>', url, '?utm_source=feed#x</link><description>some &lt;b&gt;text&lt;/b&gt;</description><pubDate>', date_format(timestamp_millis(collected_at), 'EEE, dd MMM yyyy HH:mm:ss'), ' GMT</pubDate></item></channel></rss>') AS xml")
    atom = a.where("doc_id % 2 = 1").selectExpr("doc_id AS seq", f"concat('<feed><entry><title>A ', doc_id, '</title><link rel=\"self\" href=\"https://self.example/\"/><link rel=\"alternate\" href=\"', url, '\"/><summary>s</summary><updated>', {ISO.format('collected_at')}, '</updated></entry></feed>') AS xml")
    return payloads.feeds(rss.unionByName(atom), START, TO).select("article_id", "url", "published_at")


@query("n07_search_results", "SELECT substr(sha256('google:' || url), 1, 32) AS article_id, url, 'snippet' AS content_status, 0 AS published_at, 'site' || (doc_id % 25) || '.example.com' AS author FROM articles WHERE source = 'google' GROUP BY url, doc_id % 25")
def search_results(spark, sf):
    rows = articles(spark, sf).where("source = 'google'").groupBy(F.expr("doc_id div 200").alias("seq")).agg(F.expr("array_sort(collect_list(named_struct('title', title, 'link', concat(url, '?utm_medium=q&gclid=1#f'), 'snippet', title, 'date', 'x')))").alias("organic_results"))
    lines = rows.select("seq", F.to_json(F.struct("organic_results")).alias("line"))
    return payloads.search_results(lines, "google").select("article_id", "url", "content_status", F.col("published_at").cast("int").alias("published_at"), "author")


BODY = """, b AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script>|<style\\b.*?</style>|<nav\\b.*?</nav>|<head\\b.*?</head>|<footer\\b.*?</footer>', ' ', 'g') AS bare, regexp_extract(html, '(?is)<title>([^<]*)</title>', 1) AS t FROM pages),
c AS (SELECT page_id, t, coalesce(nullif(regexp_extract(bare, '(?is)<article\\b[^>]*>(.*?)</article>', 1), ''), bare) AS inside FROM b),
clean AS (SELECT page_id, trim(regexp_replace(replace(replace(regexp_replace(inside, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '[ \\t\\r\\n]+', ' ', 'g')) AS text, trim(regexp_replace(replace(replace(t, '&nbsp;', ' '), '&amp;', '&'), '[ \\t\\r\\n]+', ' ', 'g')) AS title FROM c)"""


@query("n08_body_text", BODY + " SELECT page_id, title, length(text) AS original_length, length(text) > 30000 AS truncated, CASE WHEN length(text) >= 150 THEN 'full' ELSE 'failed' END AS status, CASE WHEN length(text) >= 150 THEN substr(sha256(lower(text)), 1, 32) END AS content_hash FROM clean")
def body_text(spark, sf):
    return payloads.body_text(table(spark, sf, "pages")).select("page_id", "title", "original_length", "truncated", "status", "content_hash")


@query("n09_clean_text", "SELECT page_id, sha256(trim(regexp_replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '[ \\t\\r\\n]+', ' ', 'g'))) AS cleaned FROM pages")
def cleaned(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2(clean_text(F.col("html")), 256).alias("cleaned"))


@query("n10_normalize_url", """, u AS (SELECT page_id, url, regexp_extract(url, '^(?i:(https?))://([^/?#]+)([^?#]*)(?:\\?([^#]*))?(?:#.*)?$', ['s', 'h', 'p', 'q']) AS x FROM pages),
k AS (SELECT page_id, x, list_filter(string_split(x.q, '&'), lambda p: p <> '' AND NOT starts_with(lower(split_part(p, '=', 1)), 'utm_') AND split_part(p, '=', 1) NOT IN ('fbclid', 'gclid', 'msclkid')) AS ps FROM u),
o AS (SELECT page_id, x, list_transform(list_sort(list_transform(range(1, len(ps) + 1), lambda i: {'k': split_part(ps[i], '=', 1), 'i': i, 'p': ps[i]})), lambda r: r.p) AS ps FROM k)
SELECT page_id, lower(x.s) || '://' || lower(x.h) || CASE WHEN x.p = '' THEN '/' ELSE x.p END || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END AS url FROM o""")
def normalized(spark, sf):
    return table(spark, sf, "pages").select("page_id", normalize_url(F.col("url")).alias("url"))


@query("n11_record_cuts", "SELECT substr(sha256('x:' || doc_id), 1, 32) AS article_id, length(substr(text || ' see https://a.example/x), http://b.example/y!', 1, 120)) AS title_n FROM articles WHERE source = 'x' AND collected_at <= " + str(NOW))
def record_cuts(spark, sf):
    return payloads.posts(post_lines(spark, sf), START, NOW).select("article_id", F.length("title").cast("long").alias("title_n"))


@query("n12_bodies")
def bodies(spark, sf):
    """Articles whose page has a body; pages get article addresses by their id."""
    pages = table(spark, sf, "pages").withColumn("url", F.expr("concat('https://site', page_id % 25, '.example.com/post/', page_id % 950)"))
    return payloads.with_bodies(articles(spark, sf), payloads.body_text(pages)).select("article_id", "content_status", F.sha2("text", 256).alias("text_hash"))


@query("n12_linked_originals", f""", a AS (SELECT *, doc_id * 31 % 97 AS rank, CASE WHEN doc_id % 9 = 4 THEN NULL WHEN doc_id % 10 = 3 THEN 'https://www.x.com/post/' || doc_id ELSE 'https://site' || (doc_id * 3 % 25) || '.example.com/post/' || (doc_id * 3 % 950) || '?utm_source=x' END AS linked_url FROM articles),
w AS (SELECT *, source IN ('google', 'bing', 'rss') AND content_status <> 'full' AS direct, CASE WHEN source IN ('google', 'bing', 'rss') AND content_status <> 'full' THEN url WHEN source IN ('x', 'hn') AND NOT contains(linked_url, 'x.com/post/' || doc_id) THEN replace(linked_url, '?utm_source=x', '') END AS address FROM a),
g AS (SELECT address, min((-rank, article_id)) AS lead, arg_max(article_id, (-rank, article_id)) AS id FROM w WHERE address IS NOT NULL GROUP BY 1 ORDER BY lead, address LIMIT 150),
b AS (SELECT 'https://site' || (page_id % 25) || '.example.com/post/' || (page_id % 950) AS address, min(struct_pack(text := html, published_at := CASE WHEN page_id % 3 = 0 THEN {START} + page_id * 1000 END, error := CASE WHEN page_id % 4 = 1 THEN 'status 500' END)) AS body FROM pages GROUP BY 1),
r AS (SELECT w.*, g.address AS taken, b.body, CASE WHEN g.address IS NULL THEN NULL WHEN b.body IS NULL THEN 'no body' ELSE b.body.error END AS error FROM w LEFT JOIN g ON g.id = w.article_id AND g.address = w.address LEFT JOIN b ON b.address = g.address),
f AS (SELECT *, taken IS NOT NULL AND error IS NULL AS fine FROM r)
SELECT article_id, CASE WHEN fine AND direct THEN taken ELSE url END AS url, sha256(CASE WHEN fine AND direct THEN body.text ELSE text END) AS text_sha, CASE WHEN fine AND direct THEN 'full' WHEN direct AND error IS NOT NULL THEN 'failed' ELSE content_status END AS content_status,
  CASE WHEN fine AND direct THEN coalesce(body.published_at, published_at) ELSE published_at END AS published_at, CASE WHEN fine AND NOT direct THEN taken END AS original_url, error AS fetch_error, NULL AS found_in, CASE WHEN error IS NOT NULL THEN 'failed' WHEN fine AND direct THEN 'updated' WHEN fine THEN 'linked' END AS change FROM f
UNION ALL SELECT substr(sha256('web:' || taken), 1, 32), taken, sha256(body.text), 'full', coalesce(body.published_at, published_at), NULL, NULL, source, 'original' FROM f WHERE fine AND NOT direct""")
def linked_originals(spark, sf):
    """Bodies and linked originals for the 150 addresses that come first by rank."""
    link = "CASE WHEN doc_id % 9 = 4 THEN NULL WHEN doc_id % 10 = 3 THEN concat('https://www.x.com/post/', doc_id) ELSE concat('https://site', doc_id * 3 % 25, '.example.com/post/', doc_id * 3 % 950, '?utm_source=x') END"
    rows = articles(spark, sf).withColumns({"rank": F.expr("doc_id * 31 % 97"), "linked_url": F.expr(link)})
    pages = table(spark, sf, "pages").select(
        F.expr("concat('https://site', page_id % 25, '.example.com/post/', page_id % 950)").alias("url"), F.col("html").alias("text"), F.expr(f"IF(page_id % 3 = 0, {START} + page_id * 1000, NULL)").alias("published_at"), F.expr("IF(page_id % 4 = 1, 'status 500', NULL)").alias("error")
    )
    out = payloads.enrich_articles(rows, pages, 150)
    return out.select("article_id", "url", F.sha2("text", 256).alias("text_sha"), "content_status", "published_at", "original_url", "fetch_error", "found_in", "change")


@query("n14_upsert_sink", "SELECT url, max(collected_at + CASE WHEN doc_id % 3 = 0 THEN 5 ELSE 0 END) AS collected_at, arg_max(author, (collected_at + CASE WHEN doc_id % 3 = 0 THEN 5 ELSE 0 END)) AS author FROM articles GROUP BY 1")
def upsert(spark, sf):
    a = articles(spark, sf).select("url", "collected_at", "author", "doc_id")
    old, new = a.where("doc_id % 3 <> 0").drop("doc_id"), a.where("doc_id % 3 = 0").withColumn("collected_at", F.col("collected_at") + 5).drop("doc_id")
    return upsert_snapshot(old, new, "url", "collected_at")
