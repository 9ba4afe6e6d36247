"""Landed payloads to articles: one mapping for each kind of source, over JSON lines or XML strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions.text import clean_text, host_of, normalize_url, sha_id

POST = """struct<id:string,url:string,text:string,isReply:boolean,inReplyToId:string,createdAt:string,author:struct<userName:string,isBlueVerified:boolean>,
likeCount:long,replyCount:long,retweetCount:long,retweeted:boolean,links:array<string>>"""
HIT = "struct<objectID:string,title:string,url:string,story_text:string,author:string,points:long,num_comments:long,created_at_i:long>"
REPO = "struct<id:long,full_name:string,description:string,html_url:string,owner:string,stars:long,updated_at:string>"
RELEASE = "struct<id:long,name:string,tag_name:string,body:string,html_url:string,draft:boolean,prerelease:boolean,published_at:string,author:string>"
RESULT = "struct<organic_results:array<struct<title:string,link:string,snippet:string,date:string>>>"
FIELDS = ("article_id", "source", "external_id", "title", "text", "url", "author", "published_at", "likes", "replies", "reposts", "origin_key", "is_repost", "content_kind", "content_status")


def _ms(text: Column) -> Column:
    """ISO time to milliseconds; null if it is none."""
    return F.unix_millis(F.try_to_timestamp(text))


def _article(rows: DataFrame, source: str, **columns: Column) -> DataFrame:
    """Record cut-offs and ids: text 10,000 and title 300 characters, id from source and external id."""
    kind = {"hn": "discussion", "github": "repository", "rss": "web"}.get(source, "post")
    base = {"likes": F.lit(None).cast("long"), "replies": F.lit(None).cast("long"), "reposts": F.lit(None).cast("long"), "is_repost": F.lit(False),
            "content_kind": F.lit(kind), "content_status": F.lit("snippet" if source == "rss" else "native")} | columns
    base |= {"source": F.lit(source), "article_id": sha_id(F.concat(F.lit(f"{source}:"), base["external_id"])),
             "text": F.substring(base["text"], 1, 10_000), "title": F.substring(base["title"], 1, 300)}
    return rows.select(*[base[n].alias(n) for n in FIELDS])


def posts(lines: DataFrame, start: int, end: int) -> DataFrame:
    """Posts in the window; negative metrics are dropped, links lose trailing punctuation, the last record of an id wins."""
    rows = lines.select("seq", F.from_json("line", POST).alias("p")).where(F.col("p.id").isNotNull()).select("seq", "p.*")
    at = _ms(F.col("createdAt"))
    rows = rows.withColumn("at", at).where(F.col("at").between(start, end))
    last = rows.groupBy("id").agg(F.max_by(F.struct("*"), "seq").alias("r")).select("r.*")
    count = lambda c: F.when(F.col(c) >= 0, F.col(c))
    url = F.coalesce("url", F.concat(F.lit("https://x.com/"), F.col("author.userName"), F.lit("/status/"), F.col("id")))
    return _article(
        last, "x", external_id=F.col("id"), title=F.substring("text", 1, 120), text=F.col("text"), url=url, author=F.col("author.userName"), published_at=F.col("at"),
        likes=count("likeCount"), replies=count("replyCount"), reposts=count("retweetCount"), origin_key=F.concat(F.lit("x:"), F.lower("author.userName")), is_repost=F.coalesce("retweeted", F.lit(False)),
    )


def post_links(lines: DataFrame) -> DataFrame:
    """(external_id, links): given and written links, trailing ``),.!`` cut, distinct, the first eight."""
    p = lines.select(F.from_json("line", POST).alias("p")).select("p.*")
    every = F.concat(F.coalesce("links", F.array().cast("array<string>")), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"https?://[^ \t\r\n]+"), F.lit(0)))
    return p.select(F.col("id").alias("external_id"), F.slice(F.array_distinct(F.transform(every, lambda u: F.regexp_replace(u, r"[),.!]+$", ""))), 1, 8).alias("links"))


def lane_guard(rows: DataFrame, handles: DataFrame) -> DataFrame:
    """Only authors among the given handles, compared in lower case."""
    return rows.join(F.broadcast(handles.select(F.lower("handle").alias("_h")).distinct()), F.lower("author") == F.col("_h"), "left_semi")


def hits(lines: DataFrame) -> DataFrame:
    """Discussion rows: they only repeat what they link to, so all count as reposts."""
    h = lines.select(F.from_json("line", HIT).alias("h")).select("h.*").where(F.col("objectID").isNotNull())
    text = F.concat_ws("\n", clean_text(F.coalesce("title", F.lit(""))), F.when(F.coalesce("story_text", F.lit("")) != "", clean_text(F.col("story_text"))), "url")
    origin = F.coalesce(host_of(F.col("url")), F.concat(F.lit("hn:"), F.col("author")))
    return _article(
        h, "hn", external_id=F.col("objectID"), title=clean_text(F.coalesce("title", F.lit(""))), text=text, url=F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("objectID")), author=F.col("author"),
        published_at=F.col("created_at_i") * 1000, likes=F.col("points"), replies=F.col("num_comments"), origin_key=origin, is_repost=F.lit(True),
    )


def repositories(lines: DataFrame, end: int) -> DataFrame:
    """Repository updates up to the window's end."""
    r = lines.select(F.from_json("line", REPO).alias("r")).select("r.*").withColumn("at", _ms(F.col("updated_at"))).where(F.col("at") <= end)
    return _article(r, "github", external_id=F.col("id").cast("string"), title=F.col("full_name"), text=F.concat_ws("\n", "full_name", "description"), url=F.col("html_url"), author=F.col("owner"),
                    published_at=F.col("at"), likes=F.col("stars"), origin_key=F.concat(F.lit("github:"), F.lower("full_name")))


def releases(lines: DataFrame, start: int, end: int) -> DataFrame:
    """Published releases in the window; drafts and undated ones drop out, a prerelease says so."""
    r = lines.select(F.from_json("line", RELEASE).alias("r")).select("r.*").withColumn("at", _ms(F.col("published_at"))).where(~F.col("draft") & F.col("at").between(start, end))
    title = F.concat(F.coalesce("name", "tag_name"), F.when(F.col("prerelease"), F.lit(" (prerelease)")).otherwise(F.lit("")))
    return _article(r, "github", external_id=F.concat(F.lit("release:"), F.col("id")), title=title, text=F.concat_ws("\n", title, "body"), url=F.col("html_url"), author=F.col("author"),
                    published_at=F.col("at"), origin_key=F.coalesce(host_of(F.col("html_url")), F.lit("")), content_kind=F.lit("release"))


def search_results(lines: DataFrame, source: str, most: int = 50) -> DataFrame:
    """The first results of a page as snippets without a date: snippet dates are not trusted. One row for each normalised URL."""
    r = lines.select("seq", F.posexplode(F.from_json("line", RESULT)["organic_results"]).alias("pos", "r")).where(F.col("pos") < most).select("seq", "pos", "r.*").withColumn("url", normalize_url(F.col("link")))
    r = r.where(F.col("url").isNotNull()).groupBy("url").agg(F.min_by(F.struct("title", "snippet"), F.struct("seq", "pos")).alias("r")).select("url", "r.*")
    host = host_of(F.col("url"))
    return _article(r, source, external_id=F.col("url"), title=F.coalesce("title", F.lit("")), text=F.concat_ws("\n", "title", "snippet"), url=F.col("url"), author=host, published_at=F.lit(0).cast("long"),
                    origin_key=host, content_kind=F.lit("web"), content_status=F.lit("snippet"))


def feeds(xml: DataFrame, start: int, end: int) -> DataFrame:
    """RSS items and Atom entries of XML strings; undated and out-of-window rows drop out, one row for each URL."""
    rss = xml.where(F.contains("xml", F.lit("<rss"))).select("seq", F.posexplode(F.from_xml("xml", "channel struct<item: array<struct<title: string, link: string, description: string, pubDate: string>>>")["channel"]["item"]).alias("pos", "i"))
    rss = rss.select("seq", "pos", F.col("i.title").alias("title"), F.col("i.link").alias("url"), F.col("i.description").alias("body"), _ms(_rfc_date(F.col("i.pubDate"))).alias("at"))
    atom = xml.where(F.contains("xml", F.lit("<feed"))).select("seq", F.posexplode(F.from_xml("xml", "entry array<struct<title: string, link: array<struct<_href: string, _rel: string>>, summary: string, updated: string, published: string>>")["entry"]).alias("pos", "i"))
    link = F.get(F.filter("i.link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"]
    atom = atom.select("seq", "pos", F.col("i.title").alias("title"), link.alias("url"), F.col("i.summary").alias("body"), _ms(F.coalesce("i.published", "i.updated")).alias("at"))
    rows = rss.unionByName(atom).where(F.col("at").between(start, end)).withColumn("url", normalize_url(F.col("url"))).where(F.col("url").isNotNull())
    rows = rows.groupBy("url").agg(F.min_by(F.struct("title", "body", "at"), F.struct("seq", "pos")).alias("r")).select("url", "r.*")
    text = F.concat_ws("\n", "title", clean_text(F.coalesce("body", F.lit(""))))
    return _article(rows, "rss", external_id=F.col("url"), title=F.col("title"), text=text, url=F.col("url"), author=host_of(F.col("url")), published_at=F.col("at"), origin_key=host_of(F.col("url")))


def _rfc_date(s: Column) -> Column:
    """``Mon, 01 Jan 2024 10:00:00 GMT`` as ISO text, by a month table: the time parser takes no English names in strict mode."""
    months = F.array(*map(F.lit, "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()))
    part = lambda k: F.regexp_extract(s, r"([0-9]{1,2}) ([A-Z][a-z]{2}) ([0-9]{4}) ([0-9:]{8})", k)
    month = F.lpad(F.array_position(months, part(2)).cast("string"), 2, "0")
    return F.when(part(3) != "", F.concat(part(3), F.lit("-"), month, F.lit("-"), F.lpad(part(1), 2, "0"), F.lit("T"), part(4), F.lit("Z")))


def body_text(pages: DataFrame, least: int = 150, longest: int = 30_000) -> DataFrame:
    """Main text of HTML pages: title, text of the article element without scripts, styles, navigation and comments, cut
    at ``longest`` with the original length; a text under ``least`` characters is failed. Native expressions only."""
    html = F.coalesce("html", F.lit(""))
    title = clean_text(F.regexp_extract(html, r"(?is)<title>([^<]*)</title>", 1))
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|nav|head|footer)\b.*?</\1>", " ")
    inner = F.regexp_extract(bare, r"(?is)<article\b[^>]*>(.*?)</article>", 1)
    text = clean_text(F.when(inner != "", inner).otherwise(bare))
    rows = pages.withColumn("_t", text)
    n = F.length("_t")
    return rows.select(
        "page_id", normalize_url(F.col("url")).alias("url"), title.alias("title"), F.when(n >= least, F.substring("_t", 1, longest)).alias("text"), n.cast("long").alias("original_length"),
        (n > longest).alias("truncated"), F.when(n >= least, "full").otherwise("failed").alias("status"), F.when(n >= least, F.substring(F.sha2(F.lower("_t"), 256), 1, 32)).alias("content_hash"),
    )


def with_bodies(articles: DataFrame, bodies: DataFrame) -> DataFrame:
    """Web rows take their page's body when there is one, and are marked failed when its extraction failed."""
    b = bodies.where(F.col("url").isNotNull()).groupBy("url").agg(F.min_by(F.struct("text", "status"), "page_id").alias("b"))
    rows = articles.withColumn("_key", normalize_url(F.col("url"))).join(b.withColumnRenamed("url", "_key"), "_key", "left")
    web = F.col("content_kind") == "web"
    return rows.withColumn("text", F.when(web & (F.col("b.status") == "full"), F.col("b.text")).otherwise(F.col("text"))).withColumn(
        "content_status", F.when(web & F.col("b.status").isNotNull() & (F.col("content_status") != "full"), F.col("b.status")).otherwise(F.col("content_status"))
    ).drop("_key", "b")


#: Hosts of discussions, whose pages are no originals (fixed values).
SOCIAL = r"(^|\.)(x\.com|twitter\.com|news\.ycombinator\.com)$"


def enrich_articles(articles: DataFrame, bodies: DataFrame, budget: int) -> DataFrame:
    """Articles with the bodies that a budget of ``budget`` addresses pays for, and the linked originals as rows of their own.

    articles: article_id, source, url, linked_url, content_status, text, published_at, likes, is_repost, origin_key and ``rank``; bodies: url, text, published_at, error. Candidates are web and feed rows
    without a full body, for their own address, and posts and discussions for their first link, if that is no discussion's. They are taken by falling rank, then id; an address counts once, at its first
    place but for its last candidate, and the first ``budget`` addresses are looked up: minima, maxima and a top-k, no sort of all rows.

    A web row takes body and publication (another host's without one has none) or is marked failed with the error; a post keeps its text and tells its original, which becomes a row (id from the
    address, no metrics, ``found_in`` its source), or the error. An address without a body has the error ``no body``. ``change`` is updated, original, linked, failed, or null for rows that stay as they are.
    """
    web = F.col("source").isin("google", "bing", "rss") & (F.col("content_status") != "full")
    post = F.col("source").isin("x", "hn") & F.col("linked_url").isNotNull() & ~F.coalesce(host_of(F.col("linked_url")).rlike(SOCIAL), F.lit(True))
    target = F.when(web, F.col("url")).when(post, F.col("linked_url"))
    place = F.struct((-F.col("rank")).alias("down"), F.col("article_id").alias("id"))
    wanted = articles.select("article_id", "rank", web.alias("direct"), normalize_url(target).alias("address")).where(F.col("address").isNotNull())
    chosen = wanted.groupBy("address").agg(F.min(place).alias("first"), F.max(F.struct(place.alias("p"), F.col("direct"))).alias("last"))
    chosen = chosen.orderBy("first", "address").limit(budget).select("address", F.col("last.p.id").alias("article_id"), "last.direct")
    found = bodies.select(normalize_url(F.col("url")).alias("address"), F.struct("text", "published_at", "error").alias("body")).where(F.col("address").isNotNull()).groupBy("address").agg(F.min("body").alias("body"))
    chosen = chosen.join(found.hint("merge"), "address", "left").withColumn("error", F.when(F.col("body").isNull(), "no body").otherwise(F.col("body.error")))
    rows = articles.join(chosen.hint("merge"), "article_id", "left")
    fine, direct = F.col("address").isNotNull() & F.col("error").isNull(), F.coalesce("direct", F.lit(False))
    took = fine & direct
    same_host = host_of(F.col("address")).eqNullSafe(host_of(F.col("url")))
    published = F.coalesce(F.when(F.col("body.published_at") > 0, F.col("body.published_at")), F.when(same_host, F.col("published_at")), F.lit(0))
    own = rows.select(
        "article_id", "source", F.when(took, F.col("address")).otherwise(F.col("url")).alias("url"), F.when(took, F.col("body.text")).otherwise(F.col("text")).alias("text"),
        F.when(took, "full").when(direct & F.col("error").isNotNull(), "failed").otherwise(F.col("content_status")).alias("content_status"), F.when(took, published).otherwise(F.col("published_at")).alias("published_at"), "likes", "is_repost",
        "origin_key", F.when(fine & ~direct, F.col("address")).alias("original_url"), F.col("error").alias("fetch_error"), F.lit(None).cast("string").alias("found_in"),
        F.when(F.col("error").isNotNull(), "failed").when(took, "updated").when(fine, "linked").alias("change"),
    )
    made = rows.where(fine & ~direct).select(
        sha_id(F.concat(F.lit("web:"), "address")).alias("article_id"), "source", F.col("address").alias("url"), F.col("body.text").alias("text"), F.lit("full").alias("content_status"),
        F.coalesce(F.when(F.col("body.published_at") > 0, F.col("body.published_at")), F.col("published_at")).alias("published_at"), F.lit(None).cast("long").alias("likes"), F.lit(False).alias("is_repost"),
        F.regexp_extract("address", "^[a-z]+://([^/?#]+)", 1).alias("origin_key"), F.lit(None).cast("string").alias("original_url"), F.lit(None).cast("string").alias("fetch_error"), F.col("source").alias("found_in"), F.lit("original").alias("change"),
    )
    return own.unionByName(made)


def run_report(rows: DataFrame) -> DataFrame:
    """Per run and source: raw, kept and filtered counts and counts by reason. ``reason`` is null for kept rows."""
    reasons = rows.where(F.col("reason").isNotNull()).groupBy("run", "source", "reason").agg(F.count(F.lit(1)).alias("n"))
    maps = reasons.groupBy("run", "source").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("reasons"))
    counts = rows.groupBy("run", "source").agg(F.count(F.lit(1)).alias("raw"), F.count_if(F.col("reason").isNull()).alias("kept"), F.count_if(F.col("reason").isNotNull()).alias("filtered"))
    return counts.join(maps, ["run", "source"], "left")
