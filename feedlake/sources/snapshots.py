"""Bucketed, versioned snapshots: a batch rewrites the buckets that it touches, a manifest names the files of each version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Snapshot:
    """A table under ``path``, dealt to ``buckets`` by the hash of ``key``.

    ``manifest/v<n>`` holds a row for each bucket that has rows: the version whose files it has, in ``data/v<that>/bucket=<b>``. A version begins to exist when its
    manifest is written, after its data; a batch that runs again starts from the version before it and overwrites what it left, so its result is the same.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = 64, splits: int = 4):
        self.spark, self.path, self.key, self.schema, self.buckets, self.splits = spark, path.rstrip("/"), key, schema, buckets, splits

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def manifest(self, version: int) -> dict[int, int]:
        """Bucket to version of its files; as many rows as there are buckets at most. Version -1 is the empty table."""
        if version < 0:
            return {}
        rows = self.spark.read.schema("bucket int, version int").parquet(f"{self.path}/manifest/v{version}")
        return {r.bucket: r.version for r in rows.collect()}

    def read(self, version: int, buckets: set[int] | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets."""
        paths = [f"{self.path}/data/v{v}/bucket={b}" for b, v in sorted(self.manifest(version).items()) if buckets is None or b in buckets]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def merge(self, batch: DataFrame, version: int, rule: Callable[[DataFrame, DataFrame], DataFrame]) -> set[int]:
        """Writes ``version`` = the one before with ``batch`` merged by ``rule`` (old rows of the touched buckets, batch); returns the touched buckets.

        ``rule`` keeps keys in their bucket. Rows are dealt to ``splits`` files a bucket, so no task holds a whole one.
        """
        touched = {r.b for r in batch.select(self.bucket().alias("b")).distinct().collect()}
        before = self.manifest(version - 1)
        if touched:
            names = self.spark.createDataFrame([], self.schema).columns
            merged = rule(self.read(version - 1, touched), batch).select(*names).withColumn("bucket", self.bucket())
            dealt = merged.repartition("bucket", F.pmod(F.xxhash64(F.lit(1), self.key), F.lit(self.splits)))
            dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v{version}")
        rows = sorted((before | dict.fromkeys(touched, version)).items())
        self.spark.createDataFrame(rows, "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v{version}")
        return touched


#: Columns of article snapshots.
ARTICLE = """article_id string, source string, url string, author string, origin_key string, text string, content_status string, is_repost boolean, published_at long, collected_at long,
likes long, replies long, reposts long, original_url string, lanes array<string>, discovery_sources array<string>, discovery_urls array<string>, discovery_authors array<string>"""
SETS = {"lanes": None, "discovery_sources": "source", "discovery_urls": "url", "discovery_authors": "author"}


def article_rows(articles: DataFrame, groups: DataFrame | None = None, lane: str | None = None) -> DataFrame:
    """Articles as rows to merge: under their canonical id where ``groups`` (article_id, canonical_id) has one, with ``own_id``, and with sets of what each tells alone."""
    rows = articles.withColumn("own_id", F.col("article_id"))
    if groups is not None:
        rows = rows.join(groups.hint("merge"), "article_id", "left").withColumn("article_id", F.coalesce("canonical_id", "article_id")).drop("canonical_id")
    rows = rows.withColumn("lanes", F.array(F.lit(lane)) if lane else F.array().cast("array<string>"))
    if "original_url" not in rows.columns:
        rows = rows.withColumn("original_url", F.lit(None).cast("string"))
    return rows.withColumns({name: F.array(own) for name, own in SETS.items() if own})


def merge_articles(old: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored articles and a batch of article_rows(), one row for each id.

    The first row keeps source, repost flag and time of collection, and the first known publication stays: neither syndication nor a refresh makes an old event newly published. Metrics are the latest.
    The text is the latest, but a full one gives way to a full one only. Address (url, author, origin, original URL) follows the text rule among rows that came under the id itself; rows that were matched
    by URL key or content hash never change it. Lanes, discovery sources, URLs and authors are unions in order of discovery: each value's first order is found before values are gathered.
    """
    o = old.withColumn("_n", F.lit(0)).withColumn("own_id", F.col("article_id"))
    rows = o.unionByName(batch.withColumn("_n", F.lit(1)), allowMissingColumns=True)
    order = F.struct("_n", "collected_at", "own_id")
    best = F.struct((F.col("content_status") == "full").alias("full"), "_n", "collected_at", "own_id")
    own = F.when(F.col("own_id") == F.col("article_id"), best)
    known = F.coalesce("published_at", F.lit(0)) > 0
    address = ("url", "author", "origin_key", "original_url")
    merged = rows.groupBy("article_id").agg(
        *[F.min_by(c, order).alias(c) for c in ("source", "is_repost", "collected_at")], F.coalesce(F.min_by(F.when(known, F.col("published_at")), F.when(known, order)), F.lit(0)).alias("published_at"),
        *[F.max_by(c, order).alias(c) for c in ("likes", "replies", "reposts")], *[F.max_by(c, best).alias(c) for c in ("text", "content_status")],
        F.coalesce(F.max_by(F.struct(*address), own), F.min_by(F.struct(*address), order)).alias("_address"),
    ).select("*", "_address.*").drop("_address")

    def told(c: str) -> Column:
        return F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda v, i: F.struct(F.lit(c).alias("kind"), i.alias("i"), v.alias("v")))

    kinds = F.flatten(F.array(*map(told, SETS)))
    each = rows.select("article_id", order.alias("at"), F.explode(kinds).alias("k")).where("k.v IS NOT NULL").groupBy("article_id", "k.kind", "k.v").agg(F.min(F.struct("at", "k.i")).alias("at"))
    pick = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == c, F.struct("at", "v")))), lambda x: x["v"])
    found = each.groupBy("article_id").agg(*[pick(c).alias(c) for c in SETS])
    return merged.join(found.hint("merge"), "article_id", "left").withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in SETS})
