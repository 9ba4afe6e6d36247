import random

import pytest
from pyspark.sql import functions as F

from feedlake.plans import report_queries as q
from feedlake.sources.sinks import snapshot_writer
from feedlake.sources.snapshots import ARTICLE, Snapshot, article_rows, merge_articles
from feedlake.streaming import operators as st
from feedlake.streaming.late import late_writer
from feedlake.streaming.processors import Observation, Rule

SF, DAY = "/root/testdata/sf0.001", 86_400_000


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()))


def stamped(df, *cols):
    """``df`` with the times of ``cols`` (ms) as timestamps named ``at``."""
    return df.select(*cols, F.timestamp_millis("ms").alias("at"))


def in_batches(spark, tmp_path, name, batches, schema):
    """A stream that gives each list of rows as a micro-batch of its own."""
    folder = tmp_path / name
    for k, some in enumerate(batches):
        stamped(spark.createDataFrame(some, schema), *[c.split()[0] for c in schema.split(", ") if not c.startswith("ms ")]).coalesce(1).write.mode("append").parquet(str(folder / f"b{k}"))
    kind = spark.read.parquet(str(folder / "b0")).schema
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def kept(spark, checkpoint, name):
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint).count()


def test_cooldown_takes_shuffled_micro_batches_in_order(spark, tmp_path):
    rng = random.Random(4)
    every = [(k, 36_000_000 + t) for k in (1, 2, 3) for t in range(0, 40_000_000, 700_000 * k)] + [(9, 36_000_005)] * 3
    # Shuffled within each batch, and rows of neighbouring batches overlap by less than the delay.
    every.sort(key=lambda r: r[1] + rng.randrange(500_000))
    batches = [every[: len(every) // 2], every[len(every) // 2 :]]
    for b in batches:
        rng.shuffle(b)
    stream = in_batches(spark, tmp_path, "n", batches, "key long, ms long")
    got = st.run_closed(lambda x: st.cooldown(x, 3_600_000), stream, "at", f"file://{tmp_path}/cp")
    assert rows(got, "key", "at_ms") == rows(st.cooldown_batch(spark.createDataFrame(every, "key long, at_ms long"), 3_600_000), "key", "at_ms")
    assert kept(spark, f"file://{tmp_path}/cp", "state") == 0 and kept(spark, f"file://{tmp_path}/cp", "rows") == 0


def test_usage_windows_equal_their_batch_twin(spark):
    assert rows(q.usage_stream(spark, SF), "start", "category", "calls") == rows(q.usage_windows(spark, SF), "start", "category", "calls")


def test_distinct_stream(spark):
    got = rows(q.stream_distinct(spark, SF), "article_id")
    assert got == sorted(set(got)) and got


def test_observation_over_micro_batches_equals_the_batch_twin(spark, tmp_path):
    rng, hour = random.Random(8), 3_600_000
    rule = Rule(minutes=60, least=10, retry_minutes=30, keep_minutes=180)
    posts = [(i, 10 * hour + i * 60_000, (10 * hour + i * 60_000 - rng.choice([0, 0, 0, 2 * hour])) * (i % 7 > 0), rng.choice([0, 3, 30]), i % 9 == 0) for i in range(60)]
    checks = [(i, 10 * hour + rng.randrange(6 * hour), rng.choice([0, 2, 9, 10, 40])) for i in range(70) for _ in range(i % 4)]
    every = [("p", t, (i, t, pub, likes, ex)) for i, t, pub, likes, ex in posts] + [("c", t, (i, t, None, likes, None)) for i, t, likes in checks]
    every.sort(key=lambda r: r[1] + rng.randrange(300_000))
    step = len(every) // 4 + 1
    schema = "article long, ms long, published_ms long, likes long, exempt boolean, post boolean"
    batches = [[(*r, kind == "p") for kind, _, r in every[k : k + step]] for k in range(0, len(every), step)]
    for b in batches:
        rng.shuffle(b)
    stream = in_batches(spark, tmp_path, "o", batches, schema)

    def run(x):
        # A closing row is neither post nor check; as a post without article it moves the watermark only.
        p = x.where(F.coalesce("post", F.lit(True))).select("article", "at", "published_ms", "likes", "exempt")
        return st.observe(p, x.where(~F.col("post")).select("article", "at", "likes"), rule)

    got = st.run_closed(run, stream, "at", f"file://{tmp_path}/cp")
    p = stamped(spark.createDataFrame(posts, "article long, ms long, published_ms long, likes long, exempt boolean"), "article", "published_ms", "likes", "exempt")
    c = stamped(spark.createDataFrame(checks, "article long, ms long, likes long"), "article", "likes")
    want = st.observe_batch(p, c, rule, 100 * hour)
    assert rows(got, "article", "verdict", "at_ms") == rows(want, "article", "verdict", "at_ms")
    assert {r[1] for r in rows(got, "article", "verdict")} == {"pending", "filtered", "expired", "due"}
    assert kept(spark, f"file://{tmp_path}/cp", "state") == 0 and kept(spark, f"file://{tmp_path}/cp", "rows") == 0


def test_observation_fold():
    fold, m = Observation(Rule(60, 10, 30, 120)).fold, 60_000
    post = (100 * m, 0, 0, 100 * m, False)
    out, state, wake = fold(1, None, [post], 110 * m)
    assert (out, state, wake) == ([], (160 * m, 160 * m), 160 * m)
    # Nothing checks it: it is due at the deadline and again after half an hour, never filtered.
    out, state, wake = fold(1, state, [], 195 * m)
    assert [x[1:] for x in out] == [("due", 160 * m), ("due", 190 * m)] and wake == 220 * m
    assert fold(1, state, [(200 * m, 1, 3, 0, False)], 200 * m) == ([(1, "filtered", 200 * m)], None, None)
    assert fold(1, state, [(200 * m, 1, 10, 0, False)], 200 * m) == ([(1, "pending", 200 * m)], None, None)
    assert fold(1, state, [], 280 * m)[0][-1] == (1, "expired", 280 * m)
    assert fold(1, None, [(5, 1, 99, 0, False)], 9) == ([], None, None)
    for row, verdict in (((5, 0, 0, 0, False), "filtered"), ((5, 0, 0, 0, True), "pending"), ((200 * m, 0, 2, 100 * m, False), "filtered"), ((5, 0, 12, 1, False), "pending")):
        assert fold(1, None, [row], 300 * m)[0] == [(1, verdict, row[0])]


def test_snapshots_by_batch(spark, tmp_path):
    write = snapshot_writer(f"file://{tmp_path}/snap", "k", "v")
    a = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v long")
    b = spark.createDataFrame([("a", 2)], "k string, v long")
    for number, batch in enumerate((a, b)):
        write(batch, number)
    write(b, 1)
    assert rows(spark.read.parquet(f"{tmp_path}/snap/v1"), "k", "v") == [("a", 2), ("b", 1)]


A = "article_id string, own string, source string, url string, author string, origin_key string, text string, content_status string, is_repost boolean, published_at long, collected_at long, likes long, replies long, reposts long"


def article(i, at, own=None, source="rss", url="u", author="w", text="t", status="snippet", published=0, likes=None):
    return (i, own or i, source, url, author, "k", text, status, False, published, at, likes, 0, 0)


def batch_of(spark, *some, lane=None):
    return article_rows(spark.createDataFrame(list(some), A), lane=lane).withColumn("own_id", F.col("own")).drop("own")


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    snap = Snapshot(spark, f"file://{tmp_path}/s", "article_id", ARTICLE, buckets=8)
    first = [article(f"a{i}", i, published=7) for i in range(100)]
    snap.merge(batch_of(spark, *first), 0, merge_articles)
    before = snap.manifest(0)
    touched = snap.merge(batch_of(spark, article("a5", 200, published=99, likes=4)), 1, merge_articles)
    assert len(touched) == 1 and {b: v for b, v in snap.manifest(1).items() if b not in touched} == {b: v for b, v in before.items() if b not in touched}
    assert {f for f in snap.read(1).inputFiles() if "/v0/" in f} < set(snap.read(0).inputFiles()) and any("/v1/" in f for f in snap.read(1).inputFiles())
    now = snap.read(1)
    assert now.count() == 100 and rows(now.where("article_id = 'a5'"), "published_at", "collected_at", "likes") == [(7, 5, 4)]
    # The same batch again gives the same version; the one before is still there; an empty batch keeps all files.
    assert snap.merge(batch_of(spark, article("a5", 200, published=99, likes=4)), 1, merge_articles) == touched and snap.read(1).count() == 100
    assert rows(snap.read(0).where("article_id = 'a5'"), "likes") == [(None,)]
    assert snap.merge(batch_of(spark, *first).limit(0), 2, merge_articles) == set() and snap.manifest(2) == snap.manifest(1)


def test_merge_keeps_discoveries_lanes_and_the_first_address(spark):
    old = batch_of(spark, article("a", 10, source="x", url="first", author="one", text="full text", status="full", published=50, likes=9), lane="accounts")
    new = batch_of(
        spark, article("a", 20, own="b", source="rss", url="copy", author="two", text="newer, short", status="snippet", published=60, likes=3), article("n", 30, text="alone"), lane="topic"
    )
    got = {r.article_id: r for r in merge_articles(merge_articles(old.limit(0), old).drop("own_id"), new).collect()}
    a = got["a"]
    assert (a.source, a.url, a.author, a.text, a.content_status, a.published_at, a.collected_at, a.likes) == ("x", "first", "one", "full text", "full", 50, 10, 3)
    assert (a.lanes, a.discovery_sources, a.discovery_urls, a.discovery_authors) == (["accounts", "topic"], ["x", "rss"], ["first", "copy"], ["one", "two"])
    assert got["n"].text == "alone" and got["n"].lanes == ["topic"]
    # Under its own id a later full text brings its address along.
    later = {r.article_id: r for r in merge_articles(batch_of(spark, article("a", 10, url="first")).drop("own_id"), batch_of(spark, article("a", 20, url="moved", status="full", text="whole"))).collect()}["a"]
    assert (later.url, later.text, later.discovery_urls) == ("moved", "whole", ["first", "moved"])


def test_late_rows_are_accounted_for(spark, tmp_path):
    path = f"file://{tmp_path}/late"
    snap = Snapshot(spark, f"{path}/snap", "article_id", ARTICLE, buckets=4)
    write = late_writer(path, snap, "collected_at", lambda x: x.select("article_id"), keep_ms=10_000_000)
    batches = [
        [article("a", 20_000_000, published=5), article("b", 19_000_000)],
        [article("c", 21_000_000), article("d", 19_900_000), article("a", 15_000_000, text="late", published=9), article("e", 9_000_000)],
        [article("f", 20_880_000), article("g", 20_879_999), article("h", None)],
    ]
    for number, some in enumerate(batches):
        write(batch_of(spark, *some), number)
    write(batch_of(spark, *batches[2]), 2)  # a batch that runs again
    at = lambda kind: [sorted(r.article_id for r in spark.read.parquet(f"{path}/{kind}/v{k}").collect()) for k in range(3)]
    assert at("on_time") == [["a", "b"], ["c", "d"], ["f"]] and at("too_late") == [[], ["e"], ["h"]]
    assert [tuple(spark.read.parquet(f"{path}/report/v{k}").first()) for k in range(3)] == [(2, 0, 0, 20_000_000), (2, 1, 1, 21_000_000), (1, 1, 1, 21_000_000)]
    stored = {r.article_id: r for r in snap.read(2).collect()}
    assert set(stored) == set("abcdfg") and stored["a"].published_at == 5  # the late row did not change the known publication


def test_streams_need_a_shared_folder_on_a_cluster(monkeypatch):
    from feedlake.plans import report_queries

    def refused(spark, tag):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")

    monkeypatch.setattr(report_queries, "shared_path", refused)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        report_queries._checkpoint(None)
