"""DuckDB views over the given tables that mirror ``feedlake.sources.tables`` and the judged articles; every oracle starts from them."""

from __future__ import annotations

from feedlake.functions.text import PROMOTION, SUBSTANCE
from feedlake.sources.tables import ACCOUNTS, MONITORS, NOW, PUBLISHERS, START


def _value(v: object) -> str:
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, list):
        return "CAST([" + ", ".join(map(_value, v)) + "] AS VARCHAR[])"
    return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


def _rows(rows: list) -> str:
    return ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in rows)


VIEWS = f"""
articles AS (
  SELECT substr(sha256('doc:' || doc_id), 1, 32) AS article_id, doc_id,
    ['x','hn','github','rss','google','bing'][doc_id % 6 + 1] AS source, 'author' || (doc_id * 7 % 40) AS author,
    CASE WHEN doc_id % 17 = 0 THEN 0 ELSE {START} + (doc_id * 7919 % 2592000) * 1000 END AS published_at,
    {START} + (doc_id * 7919 % 2592000 + doc_id % 5400) * 1000 AS collected_at,
    CASE WHEN doc_id % 3 = 0 THEN {START} + (doc_id * 7919 % 2592000 + 200000) * 1000 END AS checked_at,
    CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN doc_id * 31 % 120 ELSE doc_id % 10 END AS likes,
    doc_id * 13 % 4 AS reposts, doc_id * 17 % 6 AS replies, doc_id % 5 = 0 AS is_reply, (doc_id % 6 = 1 OR doc_id % 13 = 0) AS is_repost, doc_id % 7 = 0 AS is_blue,
    CASE WHEN doc_id % 6 >= 3 THEN 'web' WHEN doc_id % 6 = 1 THEN 'discussion' WHEN doc_id % 6 = 2 THEN CASE WHEN doc_id % 4 = 0 THEN 'release' ELSE 'repository' END ELSE 'post' END AS content_kind,
    CASE WHEN doc_id % 6 < 3 THEN 'native' WHEN doc_id % 5 = 0 THEN 'snippet' WHEN doc_id % 7 = 0 THEN 'failed' ELSE 'full' END AS content_status,
    'https://site' || (doc_id % 25) || '.example.com/post/' || (doc_id % 950) AS url,
    CASE WHEN doc_id % 2 = 0 THEN 'site' || (doc_id % 25) || '.example.com' ELSE 'other.example.com' END AS origin_key, 'm' || (doc_id % 4) AS monitor_id,
    coalesce(text, '') AS text, trim(regexp_replace(coalesce(text, ''), '[ \\t\\r\\n]+', ' ', 'g')) AS text_norm,
    substr(trim(regexp_replace(coalesce(text, ''), '[ \\t\\r\\n]+', ' ', 'g')), 1, 60) AS title
  FROM documents
),
monitors(monitor_id, ord, mode, min_likes, min_reposts, min_replies, exclude_replies, observation_minutes, min_relevance, min_value, notify_unverified, cooldown_minutes,
  created_at, window_hours, use_curated, blocked, followed, keywords, aliases, excludes) AS (VALUES {_rows(MONITORS)}),
publishers(publisher_id, kind, key, ord) AS (VALUES {_rows(PUBLISHERS)}),
accounts(handle, kind, active) AS (VALUES {_rows(ACCOUNTS)}),
evidence AS (
  SELECT 'e' || (doc_id // 5) AS event_id, CAST(doc_id % 5 AS INTEGER) AS pos, article_id, ['first_party','independent','repost','unknown','independent'][doc_id % 5 + 1] AS role,
    CASE WHEN doc_id % 5 = 4 THEN 'zz' ELSE '' END || substr(text, 11, 60) AS excerpt
  FROM articles
),
events_base AS (
  SELECT doc_id // 5 AS g, min(collected_at) AS first_discovered_at, max(collected_at) AS updated_at, min(CASE WHEN published_at > 0 THEN published_at END) AS published_at, arg_min(title, doc_id) AS summary
  FROM articles GROUP BY 1
),
events_v AS (
  SELECT 'e' || g AS event_id, 'm' || (g % 5) AS monitor_id, g * 37 % 101 AS relevance, CASE WHEN g % 19 = 0 THEN NULL ELSE g * 53 % 101 END AS value,
    ['supported','corroborated','unverified','disputed'][g // 4 % 4 + 1] AS credibility, ['urgent','high','medium','low',NULL][g % 5 + 1] AS importance, 'Event ' || g AS title, summary,
    first_discovered_at, updated_at, published_at, CASE WHEN g % 3 = 0 THEN first_discovered_at + (g % 50) * CAST(3600000 AS BIGINT) END AS notified_at, g % 4 + 1 AS revision
  FROM events_base
),
usage_v AS (
  SELECT event_id AS request_id, epoch_us(ts) // 1000 AS at_ms, event_type AS category, user_id, 100 + CAST(floor(coalesce(value, 0)) AS BIGINT) AS reserved,
    CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(coalesce(value, 0)) AS BIGINT) END AS tokens,
    strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS day
  FROM events
),
handles AS (
  SELECT DISTINCT monitor_id, handle FROM (
    SELECT monitor_id, lower(a.handle) AS handle FROM monitors, accounts a WHERE use_curated AND a.active
    UNION ALL SELECT monitor_id, lower(unnest(followed)) FROM monitors) t
  WHERE NOT EXISTS (SELECT 1 FROM monitors b WHERE b.monitor_id = t.monitor_id AND list_contains(b.blocked, t.handle))
),
hosted AS (
  SELECT *, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\\.', '') AS host,
    EXISTS (SELECT 1 FROM handles h WHERE h.monitor_id = articles.monitor_id AND h.handle = lower(articles.author)) AS curated
  FROM articles
),
published AS (
  SELECT h.*, CASE
    WHEN source IN ('x', 'github') AND content_kind <> 'web' THEN (SELECT arg_min(publisher_id, ord) FROM publishers p WHERE p.kind = h.source AND p.key = lower(h.author))
    WHEN source <> 'rss' OR lower(origin_key) = host THEN (SELECT arg_min(publisher_id, ord) FROM publishers p WHERE p.kind = 'domain' AND (h.host = p.key OR ends_with(h.host, '.' || p.key)))
    END AS publisher_id
  FROM hosted h
),
gated AS (
  SELECT p.*, m.mode, m.exclude_replies, m.observation_minutes, m.blocked, m.window_hours,
    CASE m.mode WHEN 'loose' THEN TRUE
      WHEN 'strict' THEN coalesce(likes, 0) >= 50 OR reposts >= 10 OR replies >= 15
      WHEN 'standard' THEN coalesce(likes, 0) >= 10 OR reposts >= 3 OR replies >= 5
      ELSE coalesce(likes, 0) >= m.min_likes OR reposts >= m.min_reposts OR replies >= m.min_replies END AS passes_engagement,
    (publisher_id IS NOT NULL OR curated) AS exempt,
    trim(regexp_replace(regexp_replace(text, 'https?://[^ \\t\\r\\n]+|@[A-Za-z0-9_]+', '', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS bare
  FROM published p JOIN monitors m USING (monitor_id)
),
observed AS (
  SELECT *, CASE WHEN source = 'x' AND NOT passes_engagement AND NOT exempt AND observation_minutes > 0 AND published_at > 0
      AND (published_at + observation_minutes * CAST(60000 AS BIGINT) > {NOW} OR (collected_at < published_at + observation_minutes * CAST(60000 AS BIGINT) AND coalesce(checked_at, 0) < published_at + observation_minutes * CAST(60000 AS BIGINT)))
    THEN published_at + observation_minutes * CAST(60000 AS BIGINT) END AS observe_until
  FROM gated
),
decided AS (
  SELECT *, CASE WHEN trim(text) = '' THEN 'empty' WHEN source = 'x' AND list_contains(blocked, lower(author)) THEN 'blocked' WHEN is_repost THEN 'repost'
    WHEN source = 'x' AND exclude_replies AND is_reply AND NOT (length(bare) >= 80 OR regexp_matches(bare, '{SUBSTANCE}') OR (length(bare) >= 25 AND content_status = 'full')) THEN 'reply'
    WHEN source = 'x' AND NOT passes_engagement AND NOT exempt AND observe_until IS NULL THEN 'low_engagement' END AS decision
  FROM observed
),
judged AS (
  SELECT *, CASE WHEN decision IS NOT NULL THEN 'filtered' WHEN observe_until IS NOT NULL THEN 'observing'
    WHEN published_at > 0 AND published_at < {NOW} - window_hours * CAST(3600000 AS BIGINT) THEN 'background' ELSE 'pending' END AS state,
    regexp_matches(text, '{PROMOTION}') AS promotion
  FROM decided
)
"""


def oracle(body: str) -> str:
    """``body`` with the views before it; ``body`` may begin with more of them after a comma."""
    body = body.strip()
    return f"WITH RECURSIVE {VIEWS}{body}" if body.startswith(",") else f"WITH RECURSIVE {VIEWS}\n{body}"
