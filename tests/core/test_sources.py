import re

from feedlake.plans import source_queries as q
from feedlake.sources.tables import START, articles


def documents(spark, folder, texts):
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_all_feeds_read_every_feed_article(spark, tmp_path):
    sf = documents(spark, tmp_path, [(i, f"text {i}") for i in range(9000)])
    first = {}
    for r in articles(spark, sf).where("source = 'rss'").orderBy("doc_id").collect():
        at = r.collected_at // 1000 * 1000
        if START <= at <= q.TO:
            first.setdefault(r.url, at)
    got = [(r.url, r.published_at) for r in q.all_feeds(spark, sf).collect()]
    assert sorted(got) == sorted(first.items()) and len(first) > q.feeds(spark, sf).count()


def test_all_posts_give_their_own_links(spark, tmp_path):
    many = " ".join(f"http://h{i}.example/p{i}." for i in range(12))
    texts = {0: "none", 6: "a https://own.example/q), b https://own.example/q!", 12: many, 24: 'say "https://q.example/" https://a.example/x'}
    sf = documents(spark, tmp_path, list(texts.items()))
    want = []
    for i, t in texts.items():
        every = ["https://a.example/x", *re.findall(r"https?://[^ \t\r\n]+", t + " see https://a.example/x), http://b.example/y!")]
        want += [(str(i), ",".join(list(dict.fromkeys(re.sub(r"[),.!]+$", "", u) for u in every))[:8]))] * (2 if i % 24 == 0 else 1)
    assert sorted((r.external_id, r.links) for r in q.all_links(spark, sf).collect()) == sorted(want)
