import pytest
from pyspark.sql import functions as F

from feedlake.functions import text as t


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("v")).first().v


@pytest.mark.parametrize(("url", "want"), [
    ("http://News.Harbour.test:8080/reports/daily?utm_campaign=spring&page=7#top", "http://news.harbour.test:8080/reports/daily?page=7"), ("HTTP://Example.com", "http://example.com/"), ("https://a.b/c?b=2&a=1&b=1&UTM_x=3&gclid=4", "https://a.b/c?a=1&b=2&b=1"),
    ("ftp://a.b/c", None), ("https://u:p@a.b/c", None), ("nonsense", None), ("https://a.b/c?", "https://a.b/c"),
])
def test_normalize_url(spark, url, want):
    assert one(spark, t.normalize_url(F.col("u")), u=url) == want


def test_clean_text(spark):
    assert one(spark, t.clean_text(F.col("s")), s=" <p>a&nbsp;b</p>\n&amp; c ") == "a b & c"


@pytest.mark.parametrize(("s", "want"), [("thanks @you https://x.y/z", False), ("I have a repro here", True), ("复现了", True), ("x" * 80, True), ("x" * 79, False)])
def test_substantive(spark, s, want):
    assert one(spark, t.substantive(F.col("s"), F.lit(False)), s=s) is want


def test_terms_and_suffixes(spark):
    assert one(spark, t.term_list(F.col("k"), F.col("a")), k=" x ", a="b, c，d\n\ne") == ["x", "b", "c", "d", "e"]
    assert one(spark, t.host_suffixes(t.host_of(F.col("u"))), u="https://www.a.b.c/x") == ["a.b.c", "b.c", "c"]


def test_local_day(spark):
    assert spark.range(1).select(t.local_day(F.lit(1704124800000)).alias("d")).first().d == "2024-01-02"
