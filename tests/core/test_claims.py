import random

from pyspark.sql import functions as F

from feedlake.functions.text import slug
from feedlake.operators import candidates, constraints, dedupe, evidence, metrics, quality
from feedlake.sources import payloads
from feedlake.sources.tables import MONITOR_DDL, START


def test_group_keys_keep_what_tells_subjects_apart(spark):
    rows = [("C++", "4.1"), ("C", "4.1"), ("c++", "4.1"), ("C++", "41"), ("\uff23++", "4.1"), (" C++\n", "V4.1"), ("C++", "v4.1"), ("C++", None), ("C++", ""), ("C++", "unknown"), (None, "4.1"), ("Big  Tool", "1"), ("big-tool", "1"), ("a", "b\u0001c"), ("a\u0001b", "c")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, v string")
    key = lambda action: candidates.event_group_key(F.lit("m"), F.col("s"), F.lit(action), F.col("v"), F.lit(None).cast("string"), F.lit("K y"))
    k = [r.k for r in df.select("i", key("release").alias("k")).orderBy("i").collect()]
    assert k[0] == k[2] == k[4] and k[5] == k[6] and k[7] == k[8] == k[9] and k[11] == k[12]
    assert len({k[0], k[1], k[3], k[5], k[7], k[10], k[11]}) == 7
    assert k[0] != df.where("i = 0").select(key("Release").alias("k")).first().k
    assert [r.x for r in df.where("i IN (0, 5, 11)").orderBy("i").select(slug(F.col("s")).alias("x")).collect()] == ["c++", "c++", "big-tool"]


def loop_anchors(passages, index):
    """The literal loop over passages."""
    out = []
    for start, text in passages:
        at = 0
        while at < len(text):
            end = min(len(text), at + 220)
            if end < len(text):
                found, i = [], at
                while i < end:
                    if text[i] in ".!?。！？" and i + 1 < end and text[i + 1] in " \t\r\n":
                        found.append((i - at, i + 2))
                        i += 2
                    elif text[i] == "\n":
                        found.append((i - at, i + 1))
                        i += 1
                    else:
                        i += 1
                if found and found[-1][0] >= 60:
                    end = found[-1][1]
            if len(text) - end < 8:
                end = len(text)
            if len(text[at:end].strip(" ")) >= 8:
                out.append((f"a{index + 1}:q{len(out) + 1}", start + at, start + end, text[at:end]))
            at = end
    return out


def test_anchors_over_passages_equal_the_loop(spark):
    rng = random.Random(2)
    rows = []
    for i in range(40):
        text = "".join(rng.choice(["word", "x", " ", " ", ". ", ".\n", "\n", "? ", "a" * 30, "。", "end.\n\n"]) for _ in range(rng.randrange(0, 500)))
        starts = sorted(rng.sample(range(0, max(len(text), 1), 300), min(3, len(range(0, max(len(text), 1), 300)))))
        rows.append((f"e{i}", f"d{i}", i % 5, [(s, text[s : s + 750]) for s in starts]))
    got = evidence.passage_anchors(spark.createDataFrame(rows, "event_id string, article_id string, idx int, passages array<struct<start:int,text:string>>"))
    want = {(e, *a) for e, _, i, p in rows for a in loop_anchors(p, i)}
    assert {(r.event_id, r.quote_id, r.start, r.end, r.text) for r in got.collect()} == want and len(want) > 100


def test_claims_resolve_to_the_spans_that_were_offered(spark):
    anchors = spark.createDataFrame([("e", "d1", "a1:q1", 0, 9, "first one"), ("e", "d1", "a1:q2", 9, 18, "other one"), ("e", "d2", "a2:q1", 0, 9, "their own"), ("f", "d3", "a1:q1", 0, 9, "elsewhere")], "event_id string, article_id string, quote_id string, start int, end int, text string")
    proof = spark.createDataFrame([("e", "d1"), ("e", "d2"), ("f", "d3")], "event_id string, article_id string")
    claims = [
        ("e", 0, ["d1", "d2"], ["a2:q1", "a1:q2"], []), ("e", 1, ["d1"], ["a1:q1", "a1:q1"], ["repeated_quote"]), ("e", 2, ["d1"], ["a9:q1", "a1:q1"], ["unknown_quote"]), ("e", 3, ["d1", "d2"], ["a1:q1"], ["article_mismatch"]),
        ("e", 4, ["d1"], ["a1:q1", "a2:q1"], ["article_mismatch"]), ("e", 5, ["d1", "d1"], ["a1:q1"], ["article_mismatch", "repeated_article"]), ("e", 6, ["d3"], ["a1:q1"], ["article_mismatch", "not_in_evidence"]), ("e", 7, [], [], []), ("f", 0, ["d3"], ["a1:q1"], []),
    ]
    df = spark.createDataFrame([c[:4] for c in claims], "event_id string, claim int, article_ids array<string>, quote_ids array<string>")
    got = {(r.event_id, r.claim): r for r in evidence.resolve_claims(df, anchors, proof).collect()}
    assert {k: r.violations for k, r in got.items()} == {(c[0], c[1]): c[4] for c in claims}
    assert [tuple(c) for c in got["e", 0].citations] == [("d2", "their own"), ("d1", "other one")]
    read = spark.createDataFrame([("e", "d1", [(0, "first  one other one")]), ("e", "d2", [(0, "not it")])], "event_id string, article_id string, passages array<struct<start:int,text:string>>")
    cited = spark.createDataFrame([("e", 0, "d1", "a1:q1", None), ("e", 1, "d2", "a1:q1", None), ("e", 2, "d2", "a2:q1", None), ("e", 3, "d1", "a1:q2", "never read")], "event_id string, pos int, article_id string, quote_id string, excerpt string")
    assert {r.pos: r.problem for r in evidence.resolve_evidence(cited, anchors, read).collect()} == {0: None, 1: "foreign_quote", 2: "not_read", 3: "not_read"}


def test_a_day_of_a_million_requests_streams_past(spark):
    log = spark.range(1_000_000).select(F.col("id").alias("request_id"), (F.lit(START) + F.col("id") * 50).alias("at_ms"), (F.col("id") % 7).alias("reserved"), F.lit(None).cast("long").alias("tokens"))
    r = metrics.budget_fold(log, 500_000, 1_200_000, stage=F.col("request_id") % 2 == 0).collect()
    calls = spent = refused = 0
    for i in range(1_000_000):
        most = (400_000, 960_000) if i % 2 == 0 else (500_000, 1_200_000)
        if calls < most[0] and spent + i % 7 <= most[1]:
            calls, spent = calls + 1, spent + i % 7
        else:
            refused += 1
    assert [tuple(x) for x in r] == [("2024-01-01", calls, spent, refused)]


def loop_copies(texts, width=32):
    sets = {i: (len(t), {t[k : k + width] for k in range(len(t) - width + 1)}) for i, t in texts.items()}
    out = set()
    for a in sets:
        for b in sets:
            (na, sa), (nb, sb) = sets[a], sets[b]
            if a < b and texts[a] != texts[b] and min(na, nb) >= 500 and min(na, nb) >= 0.7 * max(na, nb) and len(sa & sb) >= 0.9 * min(len(sa), len(sb)):
                out.add((a, b))
    return out


def test_near_duplicates_equal_all_pairs(spark):
    rng = random.Random(6)
    letters = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    texts = {}
    for f in range(8):
        base = letters(600 + 90 * f)
        for m in range(6):
            t = base
            for _ in range(rng.randrange(4)):
                k = rng.randrange(len(t))
                t = t[:k] + letters(rng.randrange(1, 30)) + t[k + rng.randrange(20) :]
            texts[f"f{f}m{m}"] = t + letters(rng.choice([0, 0, 40, 200]))
    texts |= {"loop1": "abcdefgh" * 80, "loop2": "abcdefgh" * 100, "part": "abcdefgh" * 40 + letters(300), "hot1": letters(40) * 20, "short": letters(400)}
    rows = [(i, t, "full") for i, t in texts.items()] + [("zcopy", texts["f0m0"], "full"), ("zz", texts["f0m0"], "snippet")]
    df = spark.createDataFrame(rows, "article_id string, text string, content_status string")
    first = {t: min(i for i in texts if texts[i] == t) for t in texts.values()}  # a copy is linked with the row that stands for it
    want = loop_copies({i: t for t, i in first.items()}) | {("f0m0", "zcopy")} | {(first[t], i) for i, t in texts.items() if first[t] != i and len(t) >= 500}
    for hot in (1000, 3):
        assert {(r.a, r.b) for r in dedupe.near_duplicates(df, hot=hot).collect()} == want
    assert len(want) > 20 and ("loop1", "loop2") in want and dedupe.near_duplicates(df.limit(0)).count() == 0


def channel(spark, *rows):
    """Channels (id, keywords, aliases, excludes), all else of no account."""
    full = [(i, 0, "loose", 0, 0, 0, False, 0, 0, 0, True, 0, START, 72, False, [], [], k, a, x) for i, k, a, x in rows]
    return spark.createDataFrame(full, MONITOR_DDL)


def test_ten_thousand_channels_match_without_a_nested_loop(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    channels = [(f"c{i}", rng.choice(words), ",".join(rng.choice(words) + rng.choice(["", " ", rng.choice(words)]) for _ in range(2)), rng.choice(["", "", rng.choice(words)])) for i in range(10_000)]
    channels += [("none", "", "", ""), ("wide", "\u00c9TE", "", "")]
    texts = {f"a{i}": " ".join(rng.choice(words) for _ in range(4)) for i in range(20)} | {"e": "", "u": "cet \u00e9te chaud"}
    rows = spark.createDataFrame([(i, t.upper() if k % 2 else t, False, START) for k, (i, t) in enumerate(texts.items())], "article_id string, text string, is_repost boolean, published_at long")
    got = quality.match_channels(rows, channel(spark, *channels), START, START)
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    split = lambda *parts: [x.strip().lower() for p in parts for x in p.replace("\n", ",").split(",") if x.strip()][:8]
    want = {(i, c) for i, t in texts.items() for c, k, a, x in channels if any(w in t.lower() for w in split(k, a)) and not any(w in t.lower() for w in split(x))}
    assert {(r.article_id, r.monitor_id) for r in got.collect()} == want
    few = quality.match_channels(rows, channel(spark, *channels[:40]), START, START)
    assert {(r.article_id, r.monitor_id) for r in few.collect()} == {(i, c) for i, c in want if c in {x[0] for x in channels[:40]}}
    assert quality.match_channels(rows, channel(spark, *channels[:1]).limit(0), START, START).count() == 0


def test_constraints_reach_into_nested_rows(spark):
    c = constraints
    kind = "sources array<string>, name string, kind string, keywords string, aliases string, excludes string, rss_urls array<string>, interval_minutes int, min_relevance int, cooldown_minutes int, quality struct<mode:string,min_likes:int,min_reposts:int,min_replies:int,observation_minutes:int,followed:array<string>,blocked:array<string>,web_interval_minutes:int,repositories:array<string>>"
    fine = (["x"], " News ", "topic", "k", "", "", ["https://a.b/c"], 30, 65, 60, ("standard", 10, 3, 5, 120, ["abc_1"], [], 240, ["o/r"]))
    bad = (["x", "fax"], "  ", "topic", None, "a" * 501, "", ["no url"] + ["https://a.b/c"] * 8, 4, 101, 60, ("wild", -1, 3, 5, 120, ["a b"], None, 20, ["o"]))
    rows = spark.createDataFrame([fine, bad, (None, *fine[1:])], kind)
    got = [r.violations for r in c.checked(rows, c.CHANNEL).collect()]
    assert got[0] == [] and got[2] == ["sources"]
    assert got[1] == ["name", "keywords", "aliases", "sources[]", "rss_urls", "rss_urls[]", "interval_minutes", "min_relevance", "quality.mode", "quality.min_likes", "quality.followed[]", "quality.blocked", "quality.web_interval_minutes", "quality.repositories[]"]
    accounts = spark.createDataFrame([([("Ann", "A", "expert", "f"), ("ann", "B", "official", "f")],), ([("Ann", "A", "expert", "f"), ("bob", "B", "official", "f")],), (None,)], "accounts array<struct<handle:string,name:string,kind:string,focus:string>>")
    assert [r.violations for r in c.checked(accounts, c.ACCOUNTS).collect()] == [["accounts#unique"], [], ["accounts"]]
    handles = spark.createDataFrame([("Ann", "A", "expert", "f"), ("ann", "B", "official", "f"), ("x y", "C", "expert", "f"), (None, "D", "expert", "f"), (None, "E", "expert", "f")], "handle string, name string, kind string, focus string")
    good, gone = c.quarantined(handles, c.ACCOUNT, {"unique handle": [F.lower("handle")]})
    assert good.count() == 0 and good.columns == handles.columns
    assert {r.name: r.violations for r in gone.collect()} == {"A": ["unique handle"], "B": ["unique handle"], "C": ["handle"], "D": ["handle"], "E": ["handle"]}
    screen = "article_id string, decision string, relevance int, value int, reason string, novelty string, subject string, action string, version string, event_date string, event_key string, claims array<string>"
    rows = spark.createDataFrame([("a", "relevant", 1, 1, "r", "", None, None, None, "2024-01-02", None, []), ("a", "relevant", 1, 1, "r", None, None, "sing", None, "2024-1-2\n", None, ["", "c"])], screen)
    assert [r.violations for r in c.checked(rows, c.SCREENING).collect()] == [[], ["novelty", "action", "event_date", "claims[]"]]


def test_linked_originals_within_a_budget(spark):
    kind = "article_id string, source string, url string, linked_url string, content_status string, text string, published_at long, likes long, is_repost boolean, origin_key string, rank int"
    rows = [
        ("p1", "x", "https://x.com/1", "https://News.example/story?utm_source=x", "native", "post", 5, 3, False, "x", 90), ("p2", "hn", "https://hn.example/2", "https://news.example/story", "native", "talk", 6, 1, True, "hn", 10),
        ("w1", "rss", "https://feed.example/a", None, "snippet", "short", 7, None, False, "feed.example", 50), ("w2", "google", "https://gone.example/b", None, "snippet", "short", 8, None, False, "gone.example", 40),
        ("w3", "bing", "https://late.example/c", None, "snippet", "short", 9, None, False, "late.example", 1), ("s", "x", "https://x.com/9", "https://www.twitter.com/z", "native", "post", 5, 3, False, "x", 99), ("f", "rss", "https://full.example", None, "full", "whole", 5, 3, False, "x", 98),
    ]
    bodies = spark.createDataFrame([("https://news.example/story", "the story", 4, None), ("https://feed.example/a", "the page", None, None), ("https://gone.example/b", None, None, "status 404"), ("https://late.example/c", "late page", None, None)], "url string, text string, published_at long, error string")
    got = {r.article_id: r for r in payloads.enrich_articles(spark.createDataFrame(rows, kind), bodies, 3).collect()}
    assert {i: r.change for i, r in got.items() if len(i) < 3} == {"p1": None, "p2": "linked", "w1": "updated", "w2": "failed", "w3": None, "s": None, "f": None}
    # Two posts link the story: it takes the place of the first and goes with the last.
    made = [r for r in got.values() if r.change == "original"]
    assert [(r.source, r.found_in, r.url, r.text, r.published_at, r.likes, r.is_repost, r.origin_key) for r in made] == [("hn", "hn", "https://news.example/story", "the story", 4, None, False, "news.example")]
    assert got["p2"].original_url == "https://news.example/story" and got["p2"].text == "talk" and got["w2"].fetch_error == "status 404" and got["w2"].content_status == "failed" and got["w2"].text == "short"
    assert (got["w1"].text, got["w1"].content_status, got["w1"].published_at) == ("the page", "full", 7)
