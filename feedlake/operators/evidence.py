"""Evidence, claims and validation of assessment rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake.functions.text import ALARM, bound, ws_norm
from feedlake.operators.dedupe import char_shingles, letters_only


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds ``violations``: names of the rules that a row breaks; a rule that is null on a row is broken."""
    return rows.withColumn("violations", F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])))


def screening_rules(now: int) -> dict[str, Column]:
    """Rules of a screening verdict."""
    relevant = F.col("decision") == "relevant"
    day = F.try_to_date("event_date", "yyyy-MM-dd")
    return {
        "decision": F.col("decision").isin("relevant", "irrelevant"), "relevance": F.col("relevance").between(0, 100), "value": F.col("value").between(0, 100),
        "subject": ~relevant | (F.length(F.trim(F.coalesce("subject", F.lit("")))) > 0), "action": ~relevant | (F.length(F.trim(F.coalesce("action", F.lit("")))) > 0),
        "event_date": F.col("event_date").isNull() | (day.isNotNull() & (F.unix_millis(day.cast("timestamp")) <= now + 86400000)),
    }


def batch_coverage(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Per batch: ids of outputs that are unknown or repeated and of inputs without output; any makes the batch rejected."""
    o = outputs.groupBy("batch", "article_id").agg(F.count(F.lit(1)).alias("n_out"))
    i = inputs.select("batch", "article_id", F.lit(1).alias("n_in")).distinct()
    both = i.join(o, ["batch", "article_id"], "full")
    return both.groupBy("batch").agg(
        F.count_if(F.col("n_in").isNull()).alias("unknown"), F.count_if(F.col("n_out") > 1).alias("repeated"), F.count_if(F.col("n_out").isNull()).alias("missing"),
    ).withColumn("rejected", F.col("unknown") + F.col("repeated") + F.col("missing") > 0)


def quotes_held(evidence: DataFrame, articles: DataFrame) -> DataFrame:
    """Adds ``problem`` to evidence: no_article, repeated, or not_quoted if the excerpt is not in the article's text; else null."""
    again = F.row_number().over(Window.partitionBy("event_id", "article_id").orderBy("pos")) > 1
    rows = evidence.withColumn("_again", again).join(articles.select("article_id", F.col("text_norm").alias("_text")), "article_id", "left")
    problem = F.when(F.col("_text").isNull(), "no_article").when(F.col("_again"), "repeated").when(~F.contains("_text", ws_norm(F.col("excerpt"))), "not_quoted")
    return rows.withColumn("problem", problem).drop("_again", "_text")


def _ends(text: Column, longest: int, least: int, tail: int) -> Column:
    """The ends of the spans of a text, a fold over positions in one native expression."""

    def following(ends: Column, at: Column, n: Column) -> Column:
        hard = F.least(n, at + longest)
        # The greedy prefix runs to the last sentence end that lies ``least`` characters in or further; a line end behind a full stop belongs to it.
        prefix = F.regexp_extract(F.substring(text, at + 1, hard - at), rf"(?s)^(.{{{least},}}(?:[.!?。！？][ \t\r\n]|(?<![.!?。！？])\n))", 1)
        kept = F.when(hard < n, F.length(prefix)).otherwise(0)
        end = bound(kept, lambda k: F.when(k > 0, at + k).otherwise(hard))
        return bound(end, lambda e: F.concat(ends, F.array(F.when(n - e < tail, n).otherwise(e))))

    def folded(n: Column) -> Column:
        def step(ends: Column, _: Column) -> Column:
            return bound(F.coalesce(F.try_element_at(ends, F.lit(-1)), F.lit(0)), lambda at: F.when(at >= n, ends).otherwise(following(ends, at, n)))

        return F.aggregate(F.sequence(F.lit(0), F.ceil(n / (least + 1)).cast("int")), F.array().cast("array<int>"), step)

    return bound(F.length(text), folded)


def _spans(text: Column, ends: Column, begin: Column, visible: int) -> Column:
    """Spans (start, end, text) between ``ends``, ``begin`` added to their places, those with fewer than ``visible`` visible characters left out."""

    def span(end: Column, i: Column) -> Column:
        start = F.when(i == 0, 0).otherwise(F.get(ends, i - 1))
        return F.struct((begin + start).alias("start"), (begin + end).alias("end"), F.substring(text, start + 1, end - start).alias("text"))

    return F.filter(F.transform(ends, span), lambda s: F.length(F.trim(s["text"])) >= visible)


def quote_anchors(rows: DataFrame, longest: int = 220, least: int = 60, tail: int = 8, visible: int = 8) -> DataFrame:
    """Spans (article_id, quote, start, end, text) that cover each text: at most ``longest`` characters, ending after the last sentence end
    that begins at ``least`` or beyond, a tail shorter than ``tail`` joined to the span before it, spans with fewer than ``visible`` visible characters left out. Nothing is shuffled.
    """
    ends = rows.withColumn("_ends", _ends(F.col("text"), longest, least, tail))
    seen = _spans(F.col("text"), F.col("_ends"), F.lit(0), visible)
    return ends.select("article_id", F.posexplode(seen).alias("quote", "s")).select("article_id", (F.col("quote") + 1).alias("quote"), "s.*")


def passage_anchors(rows: DataFrame, longest: int = 220, least: int = 60, tail: int = 8, visible: int = 8) -> DataFrame:
    """Spans (event_id, article_id, quote_id, start, end, text) of the passages that were selected: rows have event_id, article_id, ``idx`` (the article's place in the event from 0) and ``passages`` (start, text).

    Each passage is cut as by quote_anchors(), places are those in the whole text, and ids ``a<i>:q<j>`` count an article's spans over its passages, in order. Each row is
    worked on where it lies; nothing is shuffled.
    """
    each = F.transform("passages", lambda p: F.struct(p["start"].cast("int").alias("begin"), p["text"].alias("text"), _ends(p["text"], longest, least, tail).alias("ends")))
    spans = F.flatten(F.transform("_cut", lambda p: _spans(p["text"], p["ends"], p["begin"], visible)))
    out = rows.withColumn("_cut", each).select("event_id", "article_id", "idx", F.posexplode(spans).alias("j", "s"))
    return out.select("event_id", "article_id", F.concat(F.lit("a"), F.col("idx") + 1, F.lit(":q"), F.col("j") + 1).alias("quote_id"), "s.*")


def resolve_claims(claims: DataFrame, anchors: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims (event_id, claim, article_ids, quote_ids) with ``citations`` (article_id, excerpt, in the order of quote_ids) and ``violations``.

    The cited spans' articles and the claim's articles must be the same set (relational division both ways), and no quote or article may be cited twice: repeated_quote, unknown_quote (no such span was offered),
    article_mismatch, repeated_article, not_in_evidence (an article that the event's evidence lacks).
    """
    key = ["event_id", "claim"]
    quotes = claims.select(*key, F.posexplode("quote_ids").alias("i", "quote_id"))
    met = quotes.join(anchors.select("event_id", "quote_id", F.col("article_id").alias("of"), "text").hint("merge"), ["event_id", "quote_id"], "left")
    told = met.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("quote_id").alias("n_quotes"), F.count_if(F.col("of").isNull()).alias("unknown"), F.array_sort(F.collect_set("of")).alias("found"),
        F.array_sort(F.collect_list(F.when(F.col("of").isNotNull(), F.struct("i", F.col("of").alias("article_id"), F.col("text").alias("excerpt"))))).alias("cited"),
    )
    own = claims.select(*key, F.explode("article_ids").alias("article_id"))
    known = evidence.select("event_id", "article_id", F.lit(True).alias("known")).distinct()
    ids = own.join(known.hint("merge"), ["event_id", "article_id"], "left").groupBy(*key).agg(F.count(F.lit(1)).alias("n_ids"), F.array_sort(F.collect_set("article_id")).alias("ids"), F.count_if(F.col("known").isNull()).alias("outside"))
    rows = claims.join(told.hint("merge"), key, "left").join(ids.hint("merge"), key, "left")
    none = F.array().cast("array<string>")
    found, wanted = F.coalesce("found", none), F.coalesce("ids", none)
    rules = {
        "repeated_quote": F.col("n_quotes") < F.col("n"), "unknown_quote": F.col("unknown") > 0, "article_mismatch": (found != wanted) | (F.size(wanted) != F.size("article_ids")),
        "repeated_article": F.size(wanted) < F.size("article_ids"), "not_in_evidence": F.col("outside") > 0,
    }
    named = F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules.items()]))
    citations = F.transform("cited", lambda c: F.struct(c["article_id"].alias("article_id"), c["excerpt"].alias("excerpt")))
    return rows.select(*key, citations.alias("citations"), named.alias("violations"))


def resolve_evidence(evidence: DataFrame, anchors: DataFrame, passages: DataFrame) -> DataFrame:
    """Evidence (event_id, pos, article_id, quote_id, excerpt) with ``problem``: foreign_quote if the quoted span is none of the article's, not_read if the excerpt (that of the span, where there is no other)
    lies in none of the passages that were selected of the article, else null."""
    spans = anchors.select("event_id", "quote_id", "article_id", F.col("text").alias("_span"))
    read = passages.select("event_id", "article_id", F.transform("passages", lambda p: ws_norm(p["text"])).alias("_read"))
    rows = evidence.join(spans.hint("merge"), ["event_id", "quote_id", "article_id"], "left").join(read.hint("merge"), ["event_id", "article_id"], "left")
    words = ws_norm(F.coalesce("excerpt", "_span"))
    seen = F.coalesce(F.exists("_read", lambda t: F.contains(t, words)), F.lit(False))
    return rows.withColumn("problem", F.when(F.col("_span").isNull(), "foreign_quote").when(~seen, "not_read")).drop("_span", "_read")


def qualified(evidence: DataFrame, articles: DataFrame) -> DataFrame:
    """Evidence rows that can support a claim, with their article's keys: quoted, no repost, native or full, no discussion or repository, known publisher."""
    rows = quotes_held(evidence, articles).where(F.col("problem").isNull()).join(articles.select("article_id", "publisher_id", "is_repost", "content_kind", "content_status", "content_hash", "group_key", "url", "text").hint("merge"), "article_id")
    return rows.where((F.col("role") != "repost") & ~F.col("is_repost") & ~F.col("content_kind").isin("repository", "discussion") & F.col("content_status").isin("native", "full") & F.col("publisher_id").isNotNull())


def near_copies(rows: DataFrame, least_chars: int = 500, length_ratio: float = 0.7, share: float = 0.9) -> DataFrame:
    """(event_id, pos, near): earlier places of the event's evidence whose full text is a near copy: letters and digits of at least ``least_chars``,
    lengths within ``length_ratio``, and ``share`` of the smaller set of 32-unit pieces in both."""
    full = rows.where(F.col("content_status") == "full").select("event_id", F.col("pos").cast("int").alias("pos"), letters_only(F.col("text")).alias("plain"))
    sets = full.where(F.length("plain") >= least_chars).select("event_id", "pos", F.length("plain").alias("n"), char_shingles(F.col("plain")).alias("s"))
    a, b = (sets.select("event_id", *[F.col(c).alias(f"{c}_{x}") for c in ("pos", "n", "s")]) for x in "ab")
    close = (F.col("pos_a") < F.col("pos_b")) & (F.least("n_a", "n_b") >= length_ratio * F.greatest("n_a", "n_b"))
    alike = F.size(F.array_intersect("s_a", "s_b")) >= share * F.least(F.size("s_a"), F.size("s_b"))
    return a.join(b.hint("merge"), "event_id").where(close & alike).groupBy("event_id", F.col("pos_b").alias("pos")).agg(F.collect_set("pos_a").alias("near"))


def evidence_status(events: DataFrame, good: DataFrame) -> DataFrame:
    """Adds ``status``: unverified and disputed stay; corroborated needs two independence groups among independent rows whose URL and
    content were not seen earlier in the list and whose text is no near copy of one accepted before; else supported if a first party is quoted; else unverified.

    First-seen flags are windows over the few evidence rows of one event, and near copies are sought within an event, so groups are bounded by an event's evidence. Without the
    columns text and content_status in ``good`` there is nothing to find near copies in.
    """
    order = Window.partitionBy("event_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda c: F.coalesce(F.array_contains(F.collect_list(c).over(order), F.col(c)), F.lit(False))
    rows = good.withColumn("fresh", ~seen("url") & ~(F.col("content_hash").isNotNull() & seen("content_hash")))
    offered = rows.where((F.col("role") == "independent") & F.col("fresh"))
    listed = offered.select("event_id", "pos", "group_key")
    if {"text", "content_status"} <= set(good.columns):
        listed = listed.join(near_copies(offered).hint("merge"), ["event_id", "pos"], "left")
    else:
        listed = listed.withColumn("near", F.lit(None).cast("array<int>"))
    listed = listed.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("pos", "group_key", F.coalesce("near", F.array().cast("array<int>")).alias("near")))).alias("_rows"))
    none = F.struct(F.array().cast("array<int>").alias("at"), F.array().cast("array<string>").alias("keys"))
    more = lambda t, x: F.struct(F.array_append(t["at"], x["pos"].cast("int")).alias("at"), F.array_append(t["keys"], x["group_key"]).alias("keys"))
    accepted = F.aggregate("_rows", none, lambda t, x: F.when(F.arrays_overlap(x["near"], t["at"]), t).otherwise(more(t, x)))
    groups = listed.select("event_id", F.size(F.array_distinct(F.array_compact(accepted["keys"]))).alias("groups"))
    sums = rows.groupBy("event_id").agg(F.bool_or(F.col("role") == "first_party").alias("first"))
    out = events.join(sums.hint("merge"), "event_id", "left").join(groups.hint("merge"), "event_id", "left")
    status = (
        F.when(F.col("credibility").isin("unverified", "disputed"), F.col("credibility")).when((F.col("credibility") == "corroborated") & (F.coalesce("groups", F.lit(0)) >= 2), "corroborated")
        .when(F.coalesce("first", F.lit(False)), "supported").otherwise("unverified")
    )
    return out.withColumn("status", status).drop("groups", "first")


def gap_codes(events: DataFrame, evidence: DataFrame, articles: DataFrame) -> DataFrame:
    """(event_id, gaps): why an unverified event's articles cannot carry it."""
    used = evidence.join(articles.select("article_id", "content_status", "publisher_id", "is_repost", "content_kind"), "article_id")
    flags = used.groupBy("event_id").agg(
        F.bool_or(F.col("content_status").isin("snippet", "failed")).alias("a"), F.bool_or(F.col("publisher_id").isNull()).alias("b"),
        F.bool_or(F.col("is_repost") | F.col("content_kind").isin("discussion", "repository")).alias("c"),
    )
    codes = F.array_compact(F.array(*[F.when(F.col(c), n) for c, n in (("a", "partial_text"), ("b", "unknown_publisher"), ("c", "indirect"))]))
    rows = events.where(F.col("credibility") == "unverified").join(flags, "event_id", "left")
    return rows.select("event_id", F.when(F.size(F.coalesce(codes, F.array())) > 0, codes).otherwise(F.array(F.lit("no_support"))).alias("gaps"))


def urgency(events: DataFrame, evidence: DataFrame) -> DataFrame:
    """Adds ``final_importance``: urgent falls to high unless the event is verified and an excerpt tells of an alarm."""
    alarm = evidence.groupBy("event_id").agg(F.bool_or(F.coalesce(F.col("excerpt").rlike(ALARM), F.lit(False))).alias("_alarm"))
    rows = events.join(alarm, "event_id", "left")
    weak = F.col("credibility").isin("unverified", "disputed") | ~F.coalesce("_alarm", F.lit(False))
    return rows.withColumn("final_importance", F.when((F.col("importance") == "urgent") & weak, "high").otherwise(F.col("importance"))).drop("_alarm")


def claim_downgrade(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(event_id, credibility): disputed if any claim is contradicted or disputed was asked, else unverified if any claim is insufficient, else as asked.

    Disputed needs two articles in the event's evidence, whether or not the claims cite them; with fewer the assessment is rejected and its credibility null.
    """
    sums = claims.groupBy("event_id").agg(
        F.first("requested").alias("requested"), F.bool_or(F.col("verdict") == "contradicted").alias("against"), F.bool_or(F.col("verdict") == "insufficient").alias("thin")
    )
    cited = evidence.groupBy("event_id").agg(F.countDistinct("article_id").alias("cited"))
    rows = sums.join(cited.hint("merge"), "event_id", "left")
    against = F.col("against") | (F.col("requested") == "disputed")
    few = F.coalesce("cited", F.lit(0)) < 2
    return rows.select("event_id", F.when(against & few, F.lit(None)).when(against, "disputed").when(F.col("thin"), "unverified").otherwise(F.col("requested")).alias("credibility"))


def unsupported_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(event_id, claim, article_id) that a claim cites and the event's evidence lacks."""
    cited = claims.select("event_id", "claim", F.explode("article_ids").alias("article_id"))
    return cited.join(evidence.select("event_id", "article_id").hint("merge"), ["event_id", "article_id"], "left_anti")


def first_party_relation(evidence: DataFrame, subjects: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds ``final_role``: a first party keeps its role only if an alias (letters and digits, three or more) of its publisher is in the subject; and ``gap``, first_party_unconfirmed where the publisher is
    known but not so related, else null."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    names = aliases.select("publisher_id", plain(F.col("alias")).alias("alias")).where(F.length("alias") >= 3).groupBy("publisher_id").agg(F.collect_set("alias").alias("_names"))
    rows = evidence.join(subjects, "event_id", "left").join(F.broadcast(names), "publisher_id", "left")
    related = F.coalesce(F.exists("_names", lambda n: F.contains(plain(F.col("subject")), n)), F.lit(False))
    lost = (F.col("role") == "first_party") & ~related
    return rows.withColumns({"final_role": F.when(lost, "unknown").otherwise(F.col("role")), "gap": F.when(lost & F.col("publisher_id").isNotNull(), "first_party_unconfirmed")}).drop("_names")
