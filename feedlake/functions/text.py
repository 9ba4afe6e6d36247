"""Text, URL, id and time functions: native column expressions that stay inside code generation."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Tracking parameters that normalisation drops besides utm_* (fixed values).
TRACKING = ("fbclid", "gclid", "msclkid")
#: Words and signs of a reply with substance, of a promotion and of an alarm (fixed values).
SUBSTANCE = r"(?i)```|\b(error|exception|stack trace|repro|bug|fix|commit|benchmark|version|workflow update)\b|复现|报错|错误日志|代码|修复|版本|测试结果"
PROMOTION = r"(?i)\b(airdrop|giveaway|whitelist|presale)\b|空投|加群领|抽奖送"
ALARM = r"(?i)漏洞|泄露|停服|中断|不兼容|破坏性|\b(vulnerability|CVE-[0-9]|outage|data leak|breaking change)\b"
DAY_OFFSET_MS = 8 * 3600 * 1000


def bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of ``value``, which is evaluated once: inside a lambda each use of an expression is evaluated by itself, and anew for each element."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def ws_norm(s: Column) -> Column:
    """White space collapsed to single blanks and trimmed."""
    return F.trim(F.regexp_replace(s, "[ \\t\\r\\n]+", " "))


def sha_id(s: Column) -> Column:
    """The 32-digit id of a string."""
    return F.substring(F.sha2(s, 256), 1, 32)


def clean_text(s: Column) -> Column:
    """Tags and the two common entities replaced, white space collapsed."""
    s = F.regexp_replace(s, "<[^>]*>", " ")
    return ws_norm(F.replace(F.replace(s, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&")))


def without_links(s: Column) -> Column:
    """Text without links and mentions, trimmed."""
    return ws_norm(F.regexp_replace(s, r"https?://[^ \t\r\n]+|@[A-Za-z0-9_]+", ""))


def host_of(url: Column) -> Column:
    """Lower-case host without www., null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def normalize_url(url: Column) -> Column:
    """http(s) URL with lower-case scheme and host, no fragment, no tracking parameters, the others sorted by key (stable); null
    for other schemes and for URLs with credentials."""
    rx = r"^(?i:(https?))://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    part = lambda k: F.regexp_extract(url, rx, k)
    key = lambda p: F.substring_index(p, "=", 1)
    keep = F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~F.lower(key(p)).startswith("utm_") & ~key(p).isin(*TRACKING))
    ranked = F.array_sort(F.transform(keep, lambda p, i: F.struct(key(p).alias("k"), i.alias("i"), p.alias("p"))))
    query = F.array_join(F.transform(ranked, lambda x: x["p"]), "&")
    path = F.when(part(3) == "", "/").otherwise(part(3))
    out = F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(url.rlike(rx) & ~F.contains(part(2), F.lit("@")), out)


def host_suffixes(host: Column) -> Column:
    """a.b.c -> [a.b.c, b.c, c]: a suffix match becomes an equi-join."""
    parts = F.split(host, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def substantive(text: Column, has_link: Column) -> Column:
    """A reply that says something: long, or about code, or middling with a link."""
    s = without_links(text)
    return (F.length(s) >= 80) | s.rlike(SUBSTANCE) | ((F.length(s) >= 25) & has_link)


def term_list(keywords: Column, aliases: Column, most: int = 8) -> Column:
    """Keywords, then aliases cut at comma, full-width comma or newline; trimmed, none empty, the first ``most``."""
    every = F.concat(F.array(keywords), F.split(F.coalesce(aliases, F.lit("")), "[,，\n]"))
    return F.slice(F.filter(F.transform(every, lambda x: F.trim(x)), lambda x: x != ""), 1, most)


def local_day(ms: Column) -> Column:
    """Calendar day at UTC+8."""
    return F.date_format(F.timestamp_millis(ms + DAY_OFFSET_MS), "yyyy-MM-dd")


def content_hash(text: Column, status: Column) -> Column:
    """Hash of the collapsed text if it is 80 characters or more and not a snippet or failed."""
    n = ws_norm(text)
    return F.when((F.length(n) >= 80) & ~status.isin("snippet", "failed"), sha_id(n))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode normal form KC, which Spark has no function for."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def slug(s: Column) -> Column:
    """NFKC, trimmed, lower case, white space as a hyphen; other signs stay, so C++ is not C and 4.1 is not 41."""
    return F.regexp_replace(F.lower(ws_norm(nfkc(s))), " ", "-")
