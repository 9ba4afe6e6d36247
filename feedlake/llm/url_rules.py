"""URL filter: pattern rules found through their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``site``: host and path prefix, fits the host and its subdomains, the longest wins over all else.

    ``pattern``: matched anywhere in the lower-cased URL; ``*`` is any text and ``^`` a separator or the end.
    Of matching patterns an allow wins over a block, then the longest.
    """

    text: str
    action: str
    kind: str = "pattern"

    @property
    def regex(self) -> str:
        if self.kind == "site":
            host, _, path = self.text.partition("/")
            return rf"(?s)^(?:(?!://).)*+://(?:[^/?#]*\.)?(?i:{re.escape(host)})(?={re.escape('/' + path)})"
        parts = [".*" if c == "*" else r"(?:[^a-z0-9_.%-]|$)" if c == "^" else re.escape(c) for c in self.text]
        return "(?s)" + "".join(parts)

    @property
    def tokens(self) -> list[str]:
        """Runs of letters and digits that a matching URL must hold as whole tokens."""
        text = self.text if self.kind == "pattern" else re.sub("^[^/]*", lambda m: m[0].lower(), self.text)
        whole = [m for m in re.finditer("[A-Za-z0-9]+", text) if m.end() < len(text) and text[m.end()] != "*" and (m.start() > 0 and text[m.start() - 1] != "*" or self.kind == "site" and m.start() == 0)]
        return [m[0].lower() for m in whole]


#: Example patterns: pages without text of their own (log-in, baskets, listings, downloads, session copies).
PATTERNS = tuple(
    Rule(text, action)
    for text, action in (
        ("/login^", "block"), ("/signin^", "block"), ("/signup^", "block"), ("/register^", "block"), ("/logout^", "block"),
        ("/cart^", "block"), ("/checkout^", "block"), ("/basket^", "block"), ("/wp-login.php", "block"), ("/wp-admin/", "block"),
        ("/tag/*/page/", "block"), ("/category/*/page/", "block"), ("/author/*/page/", "block"), ("^replytocom=", "block"),
        ("^phpsessid=", "block"), ("^sessionid=", "block"), ("^jsessionid=", "block"), ("^action=edit^", "block"), ("^printable=yes^", "block"),
        ("/search?", "block"), ("/search/", "block"), (".exe^", "block"), (".zip^", "block"), (".apk^", "block"), (".iso^", "block"), (".dmg^", "block"),
        ("/ads/", "block"), ("/banner/", "block"), ("^utm_source=*^affiliate^", "block"), ("/docs/search/", "allow"), ("/help/login^", "allow"),
    )
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    host, path = (F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:(?!://).)*+://([^/?#]*)([^?#]*)", k) for k in (1, 2))
    return F.translate(host, UPPER, LOWER), path


def url_tokens(url: Column) -> Column:
    """Distinct runs of ASCII letters and digits of the lower-cased URL."""
    return F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER), F.lit("[a-z0-9]+"), F.lit(0)))


def rule_index(pages: DataFrame, rules: Sequence[Rule], url_col: str) -> list[tuple]:
    """(token, text, action, kind, regex) for each rule under the one of its tokens that fewest URLs hold.

    Token frequencies are counted over all URLs, for the tokens of rules only, so what comes back is bounded by the rules.
    A rule without a whole token is kept under the empty token, which every URL fetches.
    """
    wanted = sorted({t for r in rules for t in r.tokens})
    seen = pages.select(F.explode(F.filter(url_tokens(F.col(url_col)), lambda t: t.isin(wanted))).alias("t")) if wanted else None
    count = {r.t: r.n for r in seen.groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()} if wanted else {}
    return [(min(r.tokens, key=lambda t: (count.get(t, 0), t), default=""), r.text, r.action, r.kind, r.regex) for r in dict.fromkeys(rules)]


def judge_urls(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, url, host, path, ``rule`` (the site rule, else null), ``pattern`` (the deciding pattern, else null) and ``verdict``.

    URL tokens fetch candidate rules from the index, and only candidates run their regular expression. Site rules decide
    first, then patterns; a URL that nothing matches, a null one included, is allowed. Repeated rows give equal rows; extra
    columns are not used. ``rules`` is a list that the caller holds, so the broadcast index is bounded by it.
    """
    spark = pages.sparkSession
    index = F.broadcast(spark.createDataFrame(rule_index(pages, rules, url_col), "token string, text string, action string, kind string, regex string"))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    tokens = rows.where(F.col("_url").isNotNull()).distinct().withColumn("token", F.explode(F.array_append(url_tokens(F.col("_url")), F.lit(""))))
    subject = F.when(F.col("kind") == "site", F.col("_url")).otherwise(F.translate("_url", UPPER, LOWER))
    fits = tokens.join(index, "token").where(F.regexp_like(subject, F.col("regex")))
    best = lambda kind, *order: F.max(F.when(F.col("kind") == kind, F.struct(*order, F.length("text").alias("n"), F.col("text"), F.col("action"))))
    found = fits.groupBy(F.col("_id").alias("_id2"), F.col("_url").alias("_url2")).agg(best("site").alias("s"), best("pattern", (F.col("action") == "allow").alias("a")).alias("p"))
    host, path = url_parts(F.col("_url"))
    return rows.join(found.hint("merge"), F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_url") == F.col("_url2")), "left").select(
        F.col("_id").alias(id_col), F.col("_url").alias(url_col), host.alias("host"), path.alias("path"), F.col("s.text").alias("rule"),
        F.when(F.col("s").isNull(), F.col("p.text")).alias("pattern"), F.coalesce("s.action", "p.action", F.lit("allow")).alias("verdict"),
    )


#: The fixed site rules of the registered query.
SITES = (Rule("net/", "block", "site"), Rule("example.net/en/", "allow", "site"), Rule("example.com/de/", "block", "site"), Rule("org/fr/", "allow", "site"))


def op7(spark, sf_dir: str) -> DataFrame:
    """op7_url_filter over the whole pages table."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), SITES + PATTERNS).drop("url")


OP7_SQL_HEAD = """
WITH u AS (
  SELECT page_id, url,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path,
    translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM pages
), r(h, p, txt, act) AS (VALUES ('net', '/', 'net/', 'block'), ('example.net', '/en/', 'example.net/en/', 'allow'),
                                ('example.com', '/de/', 'example.com/de/', 'block'), ('org', '/fr/', 'org/fr/', 'allow')
), s AS (
  SELECT u.*, (SELECT arg_max(txt || ' ' || act, length(txt)) FROM r
               WHERE (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p)) AS site
  FROM u
), q(txt, act, rx) AS (VALUES
"""
OP7_SQL_TAIL = """
), m AS (
  SELECT s.*, (SELECT max(CASE WHEN act = 'allow' THEN '1' ELSE '0' END || lpad(CAST(length(txt) AS VARCHAR), 4, '0') || txt || ' ' || act)
               FROM q WHERE regexp_matches(s.low, q.rx)) AS pat
  FROM s
)
SELECT page_id, host, path, split_part(site, ' ', 1) AS rule,
       CASE WHEN site IS NULL THEN split_part(substr(pat, 6), ' ', 1) END AS pattern,
       coalesce(split_part(site, ' ', 2), split_part(pat, ' ', 2), 'allow') AS verdict
FROM m
"""
OP7_SQL = OP7_SQL_HEAD + ",\n".join(f"('{r.text}', '{r.action}', '{r.regex}')" for r in PATTERNS) + OP7_SQL_TAIL
