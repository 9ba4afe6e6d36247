"""Canonical groups, discovery-preserving merge and near-duplicate articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake.functions.text import bound, content_hash, nfkc, normalize_url
from feedlake.sources.scratch import written

from .components import merge_labels, star_components
from .pieces import Pieces, common_pieces, held


def match_keys(articles: DataFrame) -> DataFrame:
    """Adds ``url_key`` and ``content_hash``."""
    return articles.withColumn("url_key", normalize_url(F.col("url"))).withColumn("content_hash", content_hash(F.col("text"), F.col("content_status")))


KEYS = ("article_id", "collected_at", "is_repost", "url_key", "content_hash")


def written_keys(articles: DataFrame) -> DataFrame:
    """The columns that groups are made from as a written table, so that texts are read and hashed once; a table that has the keys already is taken as it is."""
    return articles.select(*KEYS) if set(KEYS) <= set(articles.columns) else written(match_keys(articles).select(*KEYS), "keys")


def canonical_edges(keyed: DataFrame, later: DataFrame | None = None) -> DataFrame:
    """Links from later rows that are no reposts (those of ``later``, if given) to the first row with the same URL key or the same content hash.

    Two equi-joins in union, never a join on a disjunction. Each row links to its key's first row, so a key with many rows gives as many links, not
    pairs; the merge joins stand right on their exchanges, so Spark splits a key that holds a large share of all rows.
    """
    edges = []
    for key in ("url_key", "content_hash"):
        rows = keyed.where(F.col(key).isNotNull()).select(key, "article_id", "collected_at", "is_repost")
        first = rows.groupBy(key).agg(F.min_by("article_id", F.struct("collected_at", "article_id")).alias("first_id"))
        links = rows if later is None else later.where(F.col(key).isNotNull())
        links = links.where(~F.col("is_repost")).select(key, "article_id")
        edges.append(links.join(first.hint("merge"), key).where(F.col("article_id") != F.col("first_id")).select("article_id", F.col("first_id").alias("other_id")))
    return edges[0].unionByName(edges[1]).distinct()


def canonical_groups(articles: DataFrame) -> DataFrame:
    """(article_id, canonical_id): the first row by (collected_at, id) of each connected component of the links.

    Links are contracted to stars in logarithmic rounds of written tables; rows without links are their own group.
    """
    keyed = written_keys(articles)
    return _named(star_components(_ranked_links(canonical_edges(keyed), keyed)), keyed)


def grow_groups(stored: DataFrame, groups: DataFrame, batch: DataFrame) -> DataFrame:
    """canonical_groups() of ``stored`` and ``batch`` together, from the stored ``groups`` and the links of the batch alone.

    Equal to the whole run where no row of the batch is earlier than a stored row with one of its keys, as arrival order is time order; ids of the batch are new.
    """
    old, new = written_keys(stored), written_keys(batch)
    both = old.unionByName(new)
    fresh = canonical_edges(both, new)
    rank = both.select("article_id", F.struct("collected_at", "article_id").alias("node"))
    labels = groups.join(rank.hint("merge"), "article_id").join(rank.select(F.col("article_id").alias("canonical_id"), F.col("node").alias("root")).hint("merge"), "canonical_id")
    return _named(merge_labels(labels.select("node", "root"), _ranked_links(fresh, both)), both)


def _ranked_links(edges: DataFrame, keyed: DataFrame) -> DataFrame:
    """Links between (collected_at, id), so that the least node of a component is its first row."""
    rank = lambda c, to: keyed.select(F.col("article_id").alias(c), F.struct("collected_at", "article_id").alias(to)).hint("merge")
    return edges.join(rank("article_id", "u"), "article_id").join(rank("other_id", "v"), "other_id").select("u", "v")


def _named(roots: DataFrame, keyed: DataFrame) -> DataFrame:
    found = roots.select(F.col("node.article_id").alias("article_id"), F.col("root.article_id").alias("root_id"))
    return keyed.select("article_id").distinct().join(found.hint("merge"), "article_id", "left").select("article_id", F.coalesce("root_id", "article_id").alias("canonical_id"))


def merge_discoveries(articles: DataFrame, groups: DataFrame) -> DataFrame:
    """One row for each canonical article: first identity and times, latest metrics, the best text, and all ways it was found.

    Arrays are ordered by discovery and hold distinct values: the first order of each value is found before values are gathered.
    """
    rows = articles.join(groups.hint("merge"), "article_id")
    order = F.struct("collected_at", "article_id")
    text_order = F.struct((F.col("content_status") == "full").alias("full"), "collected_at", "article_id")
    merged = rows.groupBy("canonical_id").agg(
        F.min_by("source", order).alias("source"), F.min_by("url", order).alias("url"), F.min("collected_at").alias("collected_at"),
        F.coalesce(F.min_by(F.when(F.col("published_at") > 0, F.col("published_at")), F.when(F.col("published_at") > 0, order)), F.lit(0)).alias("published_at"),
        F.max_by("likes", order).alias("likes"), F.max_by("replies", order).alias("replies"), F.max_by("text_norm", text_order).alias("text_norm"), F.count(F.lit(1)).alias("n_rows"),
    )
    kinds = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("v")) for c in ("source", "url", "author")])
    each = rows.select("canonical_id", order.alias("at"), F.explode(kinds).alias("k")).where("k.v IS NOT NULL").groupBy("canonical_id", "k.kind", "k.v").agg(F.min("at").alias("at"))
    pick = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("at", "v")))), lambda x: x["v"])
    found = each.groupBy("canonical_id").agg(*[pick(kind).alias(name) for kind, name in (("source", "discovery_sources"), ("url", "discovery_urls"), ("author", "discovery_authors"))])
    none = F.array().cast("array<string>")
    return merged.join(found.hint("merge"), "canonical_id", "left").withColumns({c: F.coalesce(c, none) for c in ("discovery_sources", "discovery_urls", "discovery_authors")})


def letters_only(text: Column) -> Column:
    """NFKC, lower case, letters and digits only."""
    return F.regexp_replace(F.lower(nfkc(text)), r"[^\p{L}\p{N}]", "")


def char_shingles(plain: Column, width: int = 32) -> Column:
    """Hashes of the distinct ``width``-unit pieces of a text, in UTF-16 units; cut from the encoded bytes, as a cut of a string would count
    characters from its start each time. The text is encoded once, not for each piece."""

    def pieces(units: Column) -> Column:
        n = (F.length(units) / 2).cast("int")
        starts = F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.substring(units, 2 * i + 1, F.lit(2 * width))))

    return F.array_distinct(bound(F.encode(plain, "UTF-16BE"), pieces))


def near_duplicates(rows: DataFrame, least_chars: int = 500, width: int = 32, length_ratio: float = 0.7, share: float = 0.9, hot: int = 1000, salts: int = 16) -> DataFrame:
    """Pairs (a, b), a < b, of full texts whose distinct ``width``-unit pieces overlap by ``share`` of the smaller set, lengths within ``length_ratio``.

    Equal normalised texts are one row (the smallest id) for the join; each other one is paired with that. The overlap is measured against the smaller set, so this is a containment join.
    Pieces that no other text has are found by counts of short values (see pieces.py) and travel no further; only a text whose other pieces make up ``share`` of its set can be the smaller one.
    Such a set gives the prefix of its pieces, rare ones first, of which one must be common with any set that holds ``share`` of it. A set is looked up with the prefix that the least of the smaller
    sets among texts of fitting length asks for (by classes of size, steps of a quarter), and with those pieces of it that a bitmap holds to be in a prefix of a smaller set. A pair whose
    common piece stands so late in either set that the rest cannot suffice is left out; pieces in more than ``hot`` sets are spread over salts. Candidates are verified on whole texts.
    """
    full = rows.where(F.col("content_status") == "full").select(F.col("article_id").alias("id"), letters_only(F.col("text")).alias("plain")).where(F.length("plain") >= least_chars)
    units = (F.length(F.encode("plain", "UTF-16BE")) / 2).cast("int")
    plain = written(full.select("id", "plain", F.sha2("plain", 256).alias("h"), units.alias("n")), "plain", "zstd")
    first = written(plain.groupBy("h").agg(F.min("id").alias("id")), "first")
    copies = plain.select("h", F.col("id").alias("b")).join(first.withColumnRenamed("id", "a").hint("merge"), "h").where(F.col("a") != F.col("b")).select("a", "b")
    total = plain.agg(F.sum("n")).first()[0] or 0
    placed = written(Pieces.of(total, width).placed(plain, first, hot), "pieces", "zstd")
    kind = lambda size: F.floor(F.log(size) / F.log(F.lit(1.25))).cast("int")
    # Pieces that no other text has come first in the order, so they use up the prefix: ``i`` is a piece's place in it, from 1.
    m, need = F.size("pieces"), F.ceil(share * F.col("k"))
    prefix = lambda sets, most: sets.select("id", "n", "k", "cold", (F.col("k") - m).alias("before"), F.slice("pieces", F.lit(1), most.cast("int")).alias("pieces"))
    ended = lambda each, end: each.select("t", *[F.col(c).alias(c + end) for c in ("id", "n", "k")], (F.col("before") + F.col("at") + 1).alias(f"i{end}"), (F.col("at") >= F.col("cold")).alias("hot"))
    sure = placed.where(m >= need)
    small = ended(prefix(sure, m - need + 1).select("id", "n", "k", "cold", "before", F.posexplode("pieces").alias("at", "t")), "a")
    # The classes that exist, with the lengths of their texts: logarithmically many rows. The least set that may be in one tells how much of it is looked up.
    classes = sure.groupBy(kind(F.col("k")).alias("c")).agg(F.min("k").alias("least_k"), F.min("n").alias("least_n"), F.max("n").alias("most_n")).collect()
    fits = lambda c: F.when((F.col("k") >= c.least_k) & (c.most_n >= length_ratio * F.col("n")) & (length_ratio * c.least_n <= F.col("n")), c.least_k)
    least = F.ceil(share * F.array_min(F.array(F.lit(None).cast("int"), *map(fits, classes))))
    large = ended(held(prefix(placed.where(m >= least), m - least + 1), small), "b")
    small = small.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("ida"), F.lit(salts)).cast("int")).otherwise(0)).drop("hot")
    large = large.withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("hot")
    smaller = (F.col("ka") < F.col("kb")) | ((F.col("ka") == F.col("kb")) & (F.col("ida") < F.col("idb")))
    close = F.least("na", "nb") >= length_ratio * F.greatest("na", "nb")
    # At most min(places before) pieces are common so far, and no more than what is left of either can follow; the first common piece leaves enough of the larger set.
    most = F.least("ia", "ib") + F.least(F.col("ka") - F.col("ia"), F.col("kb") - F.col("ib"))
    wanted = F.ceil(share * F.col("ka"))
    left = (most >= wanted) & (F.col("ib") <= F.col("kb") - wanted + 1)
    pairs = written(small.join(large.hint("merge"), ["t", "salt"]).where(smaller & close & left).select("ida", "idb").distinct(), "pairs")
    found = common_pieces(pairs, plain, width).where(F.col("m") >= share * F.col("k"))
    return found.select(F.least("ida", "idb").alias("a"), F.greatest("ida", "idb").alias("b")).unionByName(copies).distinct()
