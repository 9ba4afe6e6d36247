import random

from pyspark.sql import functions as F

from feedlake.operators import candidates, dedupe, evidence, events, metrics, quality, ranking
from feedlake.sources import payloads
from feedlake.sources.sinks import upsert_snapshot
from feedlake.sources.tables import NOW, START, accounts, articles, monitors, publishers

SF = "/root/testdata/sf0.001"


def test_engagement_thresholds(spark):
    rows = spark.createDataFrame([(10, 0, 0), (0, 3, 0), (0, 0, 5), (9, 2, 4), (None, None, None)], "likes long, reposts long, replies long")
    limit = quality.thresholds(F.lit("standard"), F.lit(0), F.lit(0), F.lit(0))
    assert [r.p for r in rows.select(quality.passes(limit).alias("p")).collect()] == [True, True, True, False, False]


def post(**change):
    base = {"article_id": "a", "source": "x", "author": "author2", "url": "https://none.example/1", "origin_key": "k", "content_kind": "post", "content_status": "native", "published_at": START, "collected_at": START + 1,
            "checked_at": None, "likes": 0, "reposts": 0, "replies": 0, "is_reply": False, "is_repost": False, "monitor_id": "m1", "text": "hello"}
    return base | change


DDL = "article_id string, source string, author string, url string, origin_key string, content_kind string, content_status string, published_at long, collected_at long, checked_at long, likes long, reposts long, replies long, is_reply boolean, is_repost boolean, monitor_id string, text string"


def judged(spark, *rows, now=NOW):
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in DDL.split(", ")) for r in rows], DDL)
    return {r.article_id: r for r in quality.judge(df, monitors(spark), publishers(spark), accounts(spark), now).collect()}


def test_decision_order(spark):
    got = judged(
        spark, post(article_id="blocked", author="Author9", monitor_id="m3"), post(article_id="repost", is_repost=True, author="author5"), post(article_id="chat", is_reply=True, likes=99, author="author5", text="nice"),
        post(article_id="tech", is_reply=True, likes=99, author="author5", text="this bug needs a fix"), post(article_id="empty", text="  "), post(article_id="low", author="author5", checked_at=NOW), post(article_id="pub", author="author1"),
    )
    assert {k: r.decision for k, r in got.items()} == {"blocked": "blocked", "repost": "repost", "chat": "reply", "tech": None, "empty": "empty", "low": "low_engagement", "pub": None}


def test_observation(spark):
    got = judged(spark, post(article_id="waits", author="author5"), post(article_id="passed", author="author5", likes=12), post(article_id="unchecked", author="author5"), now=START + 1000)
    assert got["waits"].state == "observing" and got["waits"].observe_until == START + 86400000 and got["passed"].state == "pending"
    late = judged(spark, post(article_id="never", author="author5"), post(article_id="checked", author="author5", checked_at=START + 86400001))
    assert late["never"].state == "observing" and late["checked"].decision == "low_engagement"


def loop_sample(rows, limit, offset):
    """The literal loop: sources in turn, x capped while others have rows."""
    by = {}
    for source, priority, i in rows:
        by.setdefault(source, []).append((-priority, i))
    names = sorted(by)
    for v in by.values():
        v.sort()
    names = names[offset % len(names):] + names[: offset % len(names)]
    cap = max(1, int(0.4 * limit)) if len(names) > 1 and limit >= 3 else limit
    out, taken = [], {n: 0 for n in names}
    while len(out) < limit and any(taken[n] < len(by[n]) for n in names):
        moved = False
        for n in names:
            others = any(taken[o] < len(by[o]) for o in names if o != "x")
            if len(out) < limit and taken[n] < len(by[n]) and (n != "x" or taken[n] < cap or not others):
                out.append(by[n][taken[n]][1])
                taken[n] += 1
                moved = True
        if not moved:
            break
    return out


def test_fair_sample_equals_the_loop(spark):
    rng = random.Random(1)
    for limit, offset in ((12, 0), (1, 2), (5, 3), (40, 1)):
        rows = [(rng.choice(["x", "x", "x", "hn", "rss"]), float(i % 17), f"i{i:03d}") for i in range(60)]
        df = spark.createDataFrame([("m", s, p, i, NOW) for s, p, i in rows], "monitor_id string, source string, rank double, article_id string, collected_at long")
        got = [r.article_id for r in ranking.fair_sample(df, limit, offset, NOW).orderBy("taken").collect()]
        want = loop_sample(rows, limit, offset)
        assert got == want


def test_passages_reach_the_tail(spark):
    df = spark.createDataFrame([("a", "filler " * 300 + "needle-token " + "more " * 100)], "article_id string, text string")
    r = ranking.passages(df, F.lit("about the needle-token"), 1500).first()
    assert any("needle-token" in p.text for p in r.passages) and r.omitted and r.passages[0].start == 0


def test_pages(spark):
    df = spark.range(231).withColumn("k", F.col("id"))
    order = [F.desc("k")]
    assert [r.k for r in ranking.page_of(df, order, 2).orderBy("place").collect()] == list(range(200, 170, -1))
    last = ranking.page_of(df, order, 99).collect()
    assert len(last) == 21 and last[0].total == 231 and ranking.page_of(df.where("false"), order, 3).count() == 0


def test_near_duplicates(spark):
    text = "\n".join(f"line {i} of a body that is long enough to count {i * i}" for i in range(30))
    rows = [("a", text, "full"), ("b", "short prefix. " + text, "full"), ("c", text.upper(), "full"), ("d", "other " * 200, "full"), ("e", text, "snippet"), ("f", text[: len(text) // 2], "full")]
    got = {(r.a, r.b) for r in dedupe.near_duplicates(spark.createDataFrame(rows, "article_id string, text string, content_status string")).collect()}
    assert got == {("a", "b"), ("a", "c")}  # c is a copy of a, which stands for both


def test_canonical_groups_find_planted_copies(spark):
    a = articles(spark, SF)
    groups = dedupe.canonical_groups(a)
    merged = dedupe.merge_discoveries(a, groups)
    assert groups.count() == a.count() and merged.agg(F.sum("n_rows")).first()[0] == a.count() and merged.count() < a.count()


def test_quote_anchors_cover_the_text(spark):
    text = ("A sentence that goes on for a while and ends here. " * 30 + "\n tail").strip()
    rows = evidence.quote_anchors(spark.createDataFrame([("a", text), ("b", ""), ("c", "x" * 500), ("d", "short")], "article_id string, text string")).orderBy("article_id", "quote").collect()
    a = [r for r in rows if r.article_id == "a"]
    assert "".join(r.text for r in a) == text and all(r.end - r.start <= 227 for r in rows) and all(text[r.start : r.end] == r.text for r in a)
    assert [r.end - r.start for r in rows if r.article_id == "c"] == [220, 220, 60] and not [r for r in rows if r.article_id in "bd"]


def test_evidence_status(spark):
    e = spark.createDataFrame([("e1", "corroborated"), ("e2", "corroborated"), ("e3", "supported"), ("e4", "disputed")], "event_id string, credibility string")
    good = spark.createDataFrame([("e1", 0, "independent", "u1", "h1", "g1"), ("e1", 1, "independent", "u2", "h2", "g2"), ("e2", 0, "independent", "u1", "h", "g1"), ("e2", 1, "independent", "u2", "h", "g2"), ("e3", 0, "first_party", "u", None, "g")],
                                 "event_id string, pos int, role string, url string, content_hash string, group_key string")
    assert {r.event_id: r.status for r in evidence.evidence_status(e, good).collect()} == {"e1": "corroborated", "e2": "unverified", "e3": "supported", "e4": "disputed"}


def test_transition_keeps_equal_rows(spark):
    new = spark.createDataFrame([("a", "d", "pending"), ("b", "d2", "pending"), ("c", "d", "background")], "article_id string, digest string, state string")
    old = spark.createDataFrame([("a", "d", "selected", 5, "g", ["x"]), ("b", "d1", "selected", 7, "g", [str(i) for i in range(5)]), ("c", "d", "selected", 1, "g", [])], "article_id string, digest string, state string, relevance long, group_key string, history array<string>")
    got = {r.article_id: r for r in candidates.transition(old, new).collect()}
    assert got["a"].state == "selected" and not got["a"].recheck and got["b"].history == ["1", "2", "3", "4", "selected:7"] and got["b"].recheck and got["c"].state == "background"
    again = candidates.transition(candidates.transition(old, new), new)
    assert sorted(map(str, again.drop("recheck").collect())) == sorted(map(str, candidates.transition(old, new).drop("recheck").collect()))


def test_quota_and_budget(spark):
    log = spark.createDataFrame([(i, START + i, "c" if i % 2 else "v", 0, 10 * i, 10 * i) for i in range(8)] + [(9, START + 86400000, "c", 0, 1, 1)], "request_id long, at_ms long, category string, user_id long, reserved long, tokens long")
    got = {r.request_id for r in metrics.quota_audit(log, "v", 1, 3, 3).where("admitted").collect()}
    assert got == {0, 1, 3}
    fold = {r.day: r for r in metrics.budget_fold(log, 100, 100, stage=F.lit(False)).collect()}
    assert fold["2024-01-01"].admitted == 5 and fold["2024-01-01"].tokens == 100


def test_feeds_and_results(spark):
    rss = "<rss><channel><item><title>T</title><link>https://a.b/c?utm_x=1</link><description>d</description><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item><item><title>undated</title><link>https://a.b/d</link></item></channel></rss>"
    atom = '<feed><entry><title>A</title><link rel="self" href="https://x.y/self"/><link href="https://x.y/z"/><summary>s</summary><updated>2024-01-02T00:00:00Z</updated></entry></feed>'
    rows = payloads.feeds(spark.createDataFrame([(1, rss), (2, atom), (3, "<rss><channel></channel></rss>")], "seq long, xml string"), START, NOW).collect()
    assert {(r.url, r.published_at) for r in rows} == {("https://a.b/c", 1704103200000), ("https://x.y/z", 1704153600000)}


def test_body_text(spark):
    page = "<title>T</title><nav>menu</nav><article>" + "<p>word</p>" * 60 + "<!-- no --><script>x</script></article>"
    r = {x.page_id: x for x in payloads.body_text(spark.createDataFrame([(1, "https://a.b/c", page), (2, None, None)], "page_id long, url string, html string")).collect()}
    assert r[1].status == "full" and "menu" not in r[1].text and "x" not in r[1].text and r[2].status == "failed" and r[2].text is None


def test_upserts_are_idempotent(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, v long, t string")
    new = spark.createDataFrame([("a", 2, "z"), ("c", 1, "w")], "k string, v long, t string")
    once = upsert_snapshot(old, new, "k", "v")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, upsert_snapshot(once, new, "k", "v").collect())) == [("a", 2, "z"), ("b", 1, "y"), ("c", 1, "w")]


def test_notification_rules(spark):
    rows = spark.createDataFrame([("e1", "m1", 80, "supported", None, 1, [(START + 90000000,)]), ("e2", "m1", 80, "disputed", None, 1, [(START + 90000000,)]), ("e3", "m1", 80, "supported", None, 1, [(START,)]), ("e4", "m1", 80, "supported", NOW - 10000, 1, [(NOW,)])],
                                 "event_id string, monitor_id string, relevance long, credibility string, notified_at long, revision long, articles array<struct<published_at:long>>")
    assert {r.event_id: r.notify for r in events.can_notify(rows, monitors(spark), NOW).collect()} == {"e1": True, "e2": False, "e3": False, "e4": False}


def test_near_copies_are_not_independent(spark):
    from feedlake.operators.evidence import claim_downgrade, evidence_status

    body = " ".join(f"sentence {i} of the report" for i in range(60))
    other = " ".join(f"another account {i} by a second author" for i in range(60))
    rows = [("e1", 0, "independent", "g1", "u1", body), ("e1", 1, "independent", "g2", "u2", body + " edited"), ("e2", 0, "independent", "g1", "u1", body), ("e2", 1, "independent", "g2", "u2", other),
            ("e3", 0, "independent", "g1", "u1", body), ("e3", 1, "independent", "g1", "u2", other), ("e3", 2, "independent", "g2", "u3", body + " once"), ("e4", 0, "first_party", "g1", "u1", body), ("e4", 1, "independent", "g2", "u2", body + " more")]
    good = spark.createDataFrame([(e, p, r, g, u, None, "full", t) for e, p, r, g, u, t in rows], "event_id string, pos int, role string, group_key string, url string, content_hash string, content_status string, text string")
    events = spark.createDataFrame([(f"e{i}", "corroborated") for i in range(1, 6)], "event_id string, credibility string")
    assert {r.event_id: r.status for r in evidence_status(events, good).collect()} == {"e1": "unverified", "e2": "corroborated", "e3": "unverified", "e4": "supported", "e5": "unverified"}

    claims = [("a", 0, "disputed", ["x", "y"], "insufficient"), ("b", 0, "corroborated", ["x"], "contradicted"), ("b", 1, "corroborated", ["y"], "supported"), ("c", 0, "disputed", ["x"], "supported"), ("d", 0, "supported", ["x"], "insufficient"), ("e", 0, "supported", ["x"], "supported")]
    # The event's evidence counts, not what the claims cite: f cites one article and has two, c cites one and has one, g has none.
    claims += [("f", 0, "corroborated", ["x"], "contradicted"), ("g", 0, "disputed", ["x", "y"], "supported")]
    proof = [(e, a) for e, ids in (("a", "xy"), ("b", "xyy"), ("c", "xx"), ("d", "x"), ("e", "x"), ("f", "xy")) for a in ids]
    got = claim_downgrade(spark.createDataFrame(claims, "event_id string, claim int, requested string, article_ids array<string>, verdict string"), spark.createDataFrame(proof, "event_id string, article_id string"))
    assert {r.event_id: r.credibility for r in got.collect()} == {"a": "disputed", "b": "disputed", "c": None, "d": "unverified", "e": "supported", "f": "disputed", "g": None}
