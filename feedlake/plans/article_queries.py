"""Queries over articles: matching, quality, ranking, passages and de-duplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.functions.text import SUBSTANCE, content_hash, normalize_url
from feedlake.operators import dedupe, quality, ranking
from feedlake.sources.scratch import written
from feedlake.sources.tables import NOW, START, accounts, articles, monitors, publishers, table

from .oracle_views import oracle

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = (run, oracle(sql) if sql else None)
        return run

    return add


def judged(spark, sf):
    return quality.judge(articles(spark, sf), monitors(spark), publishers(spark), accounts(spark), NOW)


@query("p01_terms", """SELECT monitor_id, CAST(i - 1 AS INTEGER) AS pos, l[i] AS term FROM (
  SELECT article_id AS monitor_id, list_filter(list_transform(list_concat([source], regexp_split_to_array(title, '[,，\\n]')), lambda x: trim(x)), lambda x: x <> '')[1:8] AS l FROM articles) t, range(1, 9) r(i) WHERE i <= len(l)""")
def terms(spark, sf):
    """Each article as a channel of its source and the parts of its title."""
    return quality.channel_terms(articles(spark, sf).select(F.col("article_id").alias("monitor_id"), F.col("source").alias("keywords"), F.col("title").alias("aliases")))


@query("p02_channel_match", f""", t AS (
  SELECT monitor_id, list_filter(list_transform(list_concat([keywords], regexp_split_to_array(aliases, '[,，\\n]')), lambda x: trim(x)), lambda x: x <> '')[1:8] AS terms,
    list_filter(list_transform(regexp_split_to_array(excludes, '[,，\\n]'), lambda x: trim(x)), lambda x: x <> '')[1:8] AS stops FROM monitors)
SELECT a.article_id, t.monitor_id FROM articles a, t WHERE NOT a.is_repost AND a.published_at BETWEEN {START} AND {NOW - 864000000}
  AND len(list_filter(t.terms, lambda x: contains(lower(a.text), lower(x)))) > 0 AND len(list_filter(t.stops, lambda x: contains(lower(a.text), lower(x)))) = 0""")
def channel_match(spark, sf):
    return quality.match_channels(articles(spark, sf), monitors(spark), START, NOW - 864000000)


@query("p03_curated", "SELECT article_id, monitor_id, curated FROM hosted")
def curated(spark, sf):
    return quality.with_curated(articles(spark, sf), quality.monitored_handles(monitors(spark), accounts(spark))).select("article_id", "monitor_id", "curated")


@query("p04_publisher", "SELECT article_id, source, publisher_id FROM published")
def publisher(spark, sf):
    return quality.with_publisher(articles(spark, sf), publishers(spark)).select("article_id", "source", "publisher_id")


@query("p05_engagement", "SELECT article_id, mode, passes_engagement FROM gated")
def engagement(spark, sf):
    return judged(spark, sf).select("article_id", "mode", "passes_engagement")


@query("p06_exempt", "SELECT article_id, exempt FROM gated")
def exempt(spark, sf):
    return judged(spark, sf).select("article_id", "exempt")


@query("p07_substantive", """SELECT article_id, (length(bare) >= 80 OR regexp_matches(bare, '{}') OR (length(bare) >= 25 AND content_status = 'full')) AS substantive FROM gated""".replace("{}", SUBSTANCE))
def substantive(spark, sf):
    from feedlake.functions.text import substantive as rule

    return articles(spark, sf).select("article_id", rule(F.col("text"), F.col("content_status") == "full").alias("substantive"))


@query("p08_decision", "SELECT article_id, monitor_id, decision FROM decided")
def decision(spark, sf):
    return judged(spark, sf).select("article_id", "monitor_id", "decision")


@query("p09_observation", "SELECT article_id, observe_until FROM observed WHERE observe_until IS NOT NULL")
def observation(spark, sf):
    return judged(spark, sf).where(F.col("observe_until").isNotNull()).select("article_id", "observe_until")


@query("p10_tags", """SELECT article_id, array_to_string(list_filter([CASE WHEN is_reply THEN 'reply' END, CASE WHEN promotion THEN 'promotion' END, CASE WHEN length(bare) < 25 THEN 'short_text' END,
  CASE WHEN source = 'x' AND NOT passes_engagement THEN 'low_engagement' END, CASE WHEN source = 'x' AND curated THEN 'curated' END, CASE WHEN is_blue THEN 'blue_check' END,
  CASE WHEN published_at = 0 THEN 'date_unknown' END], lambda x: x IS NOT NULL), ',') AS tags FROM judged""")
def tags(spark, sf):
    return quality.quality_tags(judged(spark, sf)).select("article_id", F.array_join("tags", ",").alias("tags"))


@query("p11_policy", """SELECT a.article_id, coalesce(CASE WHEN doc_id % 9 > 0 THEN m.mode END, 'loose') AS mode,
  CASE coalesce(CASE WHEN doc_id % 9 > 0 THEN m.mode END, 'loose') WHEN 'strict' THEN 50 WHEN 'standard' THEN 10 WHEN 'custom' THEN m.min_likes END AS likes FROM articles a JOIN monitors m USING (monitor_id)""")
def policy(spark, sf):
    rows = articles(spark, sf).join(F.broadcast(monitors(spark)), "monitor_id").withColumn("mode", F.coalesce(F.when(F.col("doc_id") % 9 > 0, F.col("mode")), F.lit("loose")))
    limit = quality.thresholds(F.col("mode"), F.col("min_likes"), F.col("min_reposts"), F.col("min_replies"))
    return rows.select("article_id", "mode", limit["likes"].alias("likes"))


@query("p12_state", "SELECT article_id, state FROM judged")
def state(spark, sf):
    return judged(spark, sf).select("article_id", "state")


@query("j07_thread_parents", """, r AS (SELECT conv_id * 100 + turn AS id, conv_id * 100 + turn - 1 AS parent FROM conversations WHERE turn > (SELECT min(turn) FROM conversations))
SELECT a.id, b.id AS parent1, c.id AS parent2, c.parent IS NOT NULL AND d.id IS NOT NULL AS deeper FROM r a
  LEFT JOIN r b ON a.parent = b.id LEFT JOIN r c ON b.parent = c.id LEFT JOIN r d ON c.parent = d.id""")
def thread_parents(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn")
    first = turns.agg(F.min("turn").alias("least"))
    edges = turns.crossJoin(F.broadcast(first)).where("turn > least").selectExpr("conv_id * 100 + turn AS id", "conv_id * 100 + turn - 1 AS parent")
    out = edges.alias("a")
    for below, above in (("a", "b"), ("b", "c"), ("c", "d")):
        out = out.join(edges.alias(above), F.col(f"{below}.parent") == F.col(f"{above}.id"), "left")
    return out.select(F.col("a.id").alias("id"), F.col("b.id").alias("parent1"), F.col("c.id").alias("parent2"), (F.col("c.parent").isNotNull() & F.col("d.id").isNotNull()).alias("deeper"))


@query("j08_match_existing", """, k AS (SELECT *, CASE WHEN length(text_norm) >= 80 AND content_status NOT IN ('snippet', 'failed') THEN substr(sha256(text_norm), 1, 32) END AS h FROM articles)
SELECT DISTINCT n.article_id, min(o.article_id) AS stored_id FROM k n JOIN k o ON o.doc_id % 2 = 0 AND n.doc_id % 2 = 1 AND (n.url = o.url OR n.h = o.h) GROUP BY 1""")
def match_existing(spark, sf):
    keyed = dedupe.match_keys(articles(spark, sf))
    new, old = keyed.where("doc_id % 2 = 1"), keyed.where("doc_id % 2 = 0")
    sides = [new.where(F.col(k).isNotNull()).select("article_id", k).join(old.groupBy(k).agg(F.min("article_id").alias("stored_id")), k).select("article_id", "stored_id") for k in ("url_key", "content_hash")]
    return sides[0].unionByName(sides[1]).groupBy("article_id").agg(F.min("stored_id").alias("stored_id"))


@query("d01_content_hash", "SELECT article_id, CASE WHEN length(text_norm) >= 80 AND content_status NOT IN ('snippet', 'failed') THEN substr(sha256(text_norm), 1, 32) END AS content_hash FROM articles")
def hashes(spark, sf):
    return articles(spark, sf).select("article_id", content_hash(F.col("text"), F.col("content_status")).alias("content_hash"))


@query("d02_url_key", "SELECT article_id, url AS url_key FROM articles")
def url_keys(spark, sf):
    return articles(spark, sf).select("article_id", normalize_url(F.concat("url", F.lit("?utm_source=a#top"))).alias("url_key"))


GROUPS = """, k AS MATERIALIZED (SELECT *, CASE WHEN length(text_norm) >= 80 AND content_status NOT IN ('snippet', 'failed') THEN substr(sha256(text_norm), 1, 32) END AS h FROM articles),
f AS MATERIALIZED (SELECT k.article_id AS a, x.b FROM k JOIN (SELECT url, arg_min(article_id, (collected_at, article_id)) AS b FROM k GROUP BY 1) x USING (url) WHERE NOT is_repost
  UNION SELECT k.article_id, x.b FROM k JOIN (SELECT h, arg_min(article_id, (collected_at, article_id)) AS b FROM k WHERE h IS NOT NULL GROUP BY 1) x USING (h) WHERE NOT is_repost),
e AS MATERIALIZED (SELECT a, b FROM f WHERE a <> b UNION SELECT b, a FROM f WHERE a <> b),
reach(a, b) AS (SELECT article_id, article_id FROM k UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
groups AS (SELECT r.a AS article_id, arg_min(r.b, (k.collected_at, k.article_id)) AS canonical_id FROM reach r JOIN k ON r.b = k.article_id GROUP BY 1)
"""


@query("d03_canonical_groups", GROUPS + "SELECT article_id, canonical_id FROM groups")
def canonical(spark, sf):
    return dedupe.canonical_groups(articles(spark, sf))


@query("d03_grow_groups", GROUPS + "SELECT article_id, canonical_id FROM groups")
def grown(spark, sf):
    """The groups of the first two thirds of the time, and the rest merged into them."""
    a = dedupe.written_keys(articles(spark, sf))
    late = F.col("collected_at") >= START + 2 * (NOW - START) // 3
    stored = a.where(~late)
    return dedupe.grow_groups(stored, written(dedupe.canonical_groups(stored), "groups"), a.where(late))


@query("d04_merge", GROUPS + """SELECT canonical_id, arg_min(source, (collected_at, article_id)) AS source, arg_min(url, (collected_at, article_id)) AS url, min(collected_at) AS collected_at,
  coalesce(arg_min(published_at, (collected_at, article_id)) FILTER (WHERE published_at > 0), 0) AS published_at, count(*) AS n_rows, count(DISTINCT author) AS n_authors, count(DISTINCT source) AS n_sources
FROM groups JOIN articles USING (article_id) GROUP BY 1""")
def merge(spark, sf):
    a = articles(spark, sf)
    out = dedupe.merge_discoveries(a, dedupe.canonical_groups(a))
    return out.select("canonical_id", "source", "url", "collected_at", "published_at", "n_rows", F.size("discovery_authors").cast("long").alias("n_authors"), F.size("discovery_sources").cast("long").alias("n_sources"))


@query("d05_near_duplicates", """, p AS (SELECT article_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS plain FROM articles WHERE content_status = 'full'),
o AS MATERIALIZED (SELECT plain, min(article_id) AS id, length(plain) AS n FROM p WHERE length(plain) >= 500 GROUP BY plain),
s AS MATERIALIZED (SELECT DISTINCT id, n, substr(plain, i, 32) AS t FROM o, LATERAL (SELECT unnest(range(1, n - 30)) AS i) x),
k AS (SELECT id, n, count(*) AS k FROM s GROUP BY 1, 2),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS m FROM s a JOIN s b ON a.t = b.t AND a.id < b.id AND least(a.n, b.n) >= 0.7 * greatest(a.n, b.n) GROUP BY 1, 2)
SELECT c.a, c.b FROM c JOIN k x ON x.id = c.a JOIN k y ON y.id = c.b WHERE m >= 0.9 * least(x.k, y.k)
UNION SELECT o.id, p.article_id FROM o JOIN p USING (plain) WHERE p.article_id <> o.id""")
def near_duplicates(spark, sf):
    return dedupe.near_duplicates(articles(spark, sf))


@query("d06_last_per_key", "SELECT url, arg_max(article_id, (collected_at, article_id)) AS article_id, count(*) AS n FROM articles GROUP BY 1")
def last_per_key(spark, sf):
    return articles(spark, sf).groupBy("url").agg(F.max_by("article_id", F.struct("collected_at", "article_id")).alias("article_id"), F.count(F.lit(1)).alias("n"))


RANKED = """, ranked AS (SELECT *, CASE WHEN publisher_id IS NOT NULL THEN 60 ELSE 0 END + CASE WHEN source = 'x' AND curated THEN 35 ELSE 0 END - CASE WHEN is_reply THEN 8 ELSE 0 END
  + CASE WHEN content_status = 'full' THEN 20 ELSE 0 END + CASE WHEN content_kind = 'release' THEN 10 ELSE 0 END + least(15.0, log2(1.0 + coalesce(likes, 0) + 3 * reposts)) AS rank FROM judged WHERE decision IS NULL)"""
SAMPLED = RANKED + f""", turns AS (SELECT *, row_number() OVER (PARTITION BY monitor_id, source ORDER BY rank + ({NOW} - collected_at) / 3600000.0 DESC, article_id) AS turn,
  dense_rank() OVER (PARTITION BY monitor_id ORDER BY source) - 1 AS si FROM ranked), sized AS (SELECT *, max(si) OVER (PARTITION BY monitor_id) + 1 AS n FROM turns),
sampled AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY monitor_id ORDER BY CASE WHEN source = 'x' AND turn > CASE WHEN n > 1 THEN 20 ELSE 50 END THEN 1 ELSE 0 END, turn, (si - 1 + n) % n) AS taken FROM sized WHERE turn <= 50) WHERE taken <= 50)"""


def ranked(spark, sf):
    return ranking.quality_rank(judged(spark, sf).where(F.col("decision").isNull()))


def sampled(spark, sf):
    return ranking.fair_sample(ranked(spark, sf), 50, 1, NOW)


@query("r01_rank", RANKED + " SELECT article_id, round(rank, 6) AS rank FROM ranked")
def rank(spark, sf):
    return ranked(spark, sf).select("article_id", F.round("rank", 6).alias("rank"))


@query("r02_fair_sample", SAMPLED + " SELECT monitor_id, article_id, source, taken FROM sampled")
def fair(spark, sf):
    return sampled(spark, sf).select("monitor_id", "article_id", "source", F.col("taken").cast("long").alias("taken"))


@query("r03_batches", SAMPLED + " SELECT monitor_id, (taken - 1) // 3 AS batch, count(*) AS n, min(article_id) AS first_id FROM sampled GROUP BY 1, 2")
def batches(spark, sf):
    return ranking.batches(sampled(spark, sf), 3).groupBy("monitor_id", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("article_id").alias("first_id"))


@query("r04_packing", SAMPLED + """, b AS (SELECT *, (taken - 1) // 5 AS batch FROM sampled), p AS (SELECT *, sum(least(length(text), 3000)) OVER (PARTITION BY monitor_id, batch ORDER BY taken ROWS UNBOUNDED PRECEDING) AS used,
  row_number() OVER (PARTITION BY monitor_id, batch ORDER BY taken) AS i FROM b) SELECT monitor_id, batch, article_id, CAST(used AS BIGINT) AS used FROM p WHERE used <= 7000 OR i = 1""")
def packing(spark, sf):
    return ranking.packed(ranking.batches(sampled(spark, sf), 5)).select("monitor_id", "batch", "article_id", F.col("used").cast("long").alias("used"))


@query("r05_rotation", """, r AS (SELECT 'g' || (doc_id // 40) AS group_id, article_id, collected_at, doc_id % 3 = 0 AS reviewed FROM articles),
i AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY collected_at, article_id) - 1 AS i, count(*) OVER (PARTITION BY group_id) AS n, row_number() OVER (PARTITION BY group_id, reviewed ORDER BY collected_at DESC, article_id) AS k FROM r),
t AS (SELECT *, CASE WHEN NOT reviewed AND k <= 5 THEN 0 WHEN reviewed AND k <= 3 THEN 1 ELSE 2 END AS tier FROM i),
p AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY tier, CASE WHEN tier < 2 THEN k ELSE (i - 7 % n + n) % n END, article_id) AS pick FROM t) SELECT group_id, article_id, reviewed, pick FROM p WHERE pick <= 10""")
def rotation(spark, sf):
    rows = articles(spark, sf).selectExpr("concat('g', doc_id div 40) AS group_id", "article_id", "collected_at", "doc_id % 3 = 0 AS reviewed")
    return ranking.evidence_rotation(rows, "group_id", offset=7).select("group_id", "article_id", "reviewed", "pick")


@query("r09_passages", """, t AS (SELECT article_id, text, list_distinct(regexp_extract_all(lower(title), '[a-z0-9._-]{3,}|[\\x{4e00}-\\x{9fff}]{2,}')[1:35]) AS terms FROM articles),
b AS (SELECT article_id, CAST(s AS INTEGER) AS start, substr(text, CAST(s + 1 AS BIGINT), 750) AS block, length(text) AS n, terms FROM t, LATERAL (SELECT unnest(range(0, greatest(length(text), 1), 750)) AS s) x),
c AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY 3 * len(list_filter(terms, lambda x: contains(lower(block), x))) + CASE WHEN start = 0 THEN 1 ELSE 0 END DESC, start) AS r FROM b)
SELECT article_id, string_agg(CAST(start AS VARCHAR), ',' ORDER BY start) AS starts, sum(length(block)) < max(n) AS omitted FROM c WHERE r <= 4 GROUP BY 1""")
def passages(spark, sf):
    out = ranking.passages(articles(spark, sf), F.col("title"))
    return out.select("article_id", F.array_join(F.transform("passages", lambda p: p["start"].cast("string")), ",").alias("starts"), "omitted")


LATER = NOW + 30 * 86_400_000  # by then the observations under way have run out


@query("r10_observation_batch", f"""SELECT article_id, observe_until FROM observed WHERE observe_until <= {LATER} AND coalesce(checked_at, 0) <= {LATER} - 1800000 ORDER BY observe_until, article_id LIMIT 20""")
def observation_batch(spark, sf):
    due = judged(spark, sf).where((F.col("observe_until") <= LATER) & (F.coalesce("checked_at", F.lit(0)) <= LATER - 1800000))
    return due.select("article_id", "observe_until").orderBy("observe_until", "article_id").limit(20)


@query("a02_source_funnel", "SELECT source, count(*) AS collected, count(*) FILTER (WHERE state = 'pending') AS pending, count(*) FILTER (WHERE decision IS NOT NULL) AS filtered FROM judged GROUP BY 1")
def funnel(spark, sf):
    from feedlake.operators.metrics import source_funnel

    return source_funnel(judged(spark, sf))


@query("a01_state_counts", "SELECT monitor_id, state, count(*) AS n FROM judged GROUP BY 1, 2")
def state_counts(spark, sf):
    return judged(spark, sf).groupBy("monitor_id", "state").agg(F.count(F.lit(1)).alias("n"))


@query("o03_policy_stamp", """SELECT a.article_id, substr(sha256(m.mode || '|' || m.min_likes || '|' || m.observation_minutes || '|' || 'v2'), 1, 16) AS stamp FROM articles a JOIN monitors m USING (monitor_id)""")
def policy_stamp(spark, sf):
    m = monitors(spark).select("monitor_id", F.substring(F.sha2(F.concat_ws("|", "mode", "min_likes", "observation_minutes", F.lit("v2")), 256), 1, 16).alias("stamp"))
    return articles(spark, sf).join(F.broadcast(m), "monitor_id").select("article_id", "stamp")


