import pytest
from pyspark.sql import functions as F

from feedlake.operators import dedupe
from feedlake.operators.components import merge_labels, star_components, star_rounds
from feedlake.sources.scratch import shared_dir


def loop_components(links):
    """The least node reached, by union and find."""
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for u, v in links:
        a, b = sorted((root(u), root(v)))
        up[b] = a
    return {x: root(x) for x in up}


def test_a_long_chain_is_one_group(spark):
    rows = [(f"a{i:03d}", f"https://e.example/p{(i + 1) // 2}", f"text number {i // 2} " * 20, "full", 1000 + i, False) for i in range(70)]
    a = spark.createDataFrame(rows, "article_id string, url string, text string, content_status string, collected_at long, is_repost boolean")
    assert {tuple(r) for r in dedupe.canonical_groups(a.coalesce(1)).collect()} == {(r[0], "a000") for r in rows}
    # The same chain in two batches gives the same groups.
    old, new = a.where("collected_at < 1050"), a.where("collected_at >= 1050")
    assert {tuple(r) for r in dedupe.grow_groups(old, dedupe.canonical_groups(old), new).collect()} == {(r[0], "a000") for r in rows}


def test_a_chain_of_ten_thousand_settles_in_few_rounds(spark):
    # Names that do not follow the chain's order, so that minima lie all over it.
    name = lambda i: F.concat(F.lpad((i * 7919 % 10007).cast("string"), 5, "0"), F.lit("n"))
    links = spark.range(9_999).select(name(F.col("id")).alias("u"), name(F.col("id") + 1).alias("v"))
    rounds = list(star_rounds(links))
    assert len(rounds) < 20 and rounds[-1].count() == 9_999 and rounds[-1].select("v").distinct().count() == 1
    assert rounds[-1].inputFiles()[0].startswith(spark.conf.get("spark.checkpoint.dir"))


def test_the_shared_folder_is_asked_for_on_a_cluster():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:  # noqa: N801
            master, applicationId = "spark://host:7077", "cluster"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session)
    Session.sparkContext.master, Session.sparkContext.applicationId = "local[2]", "local"
    assert shared_dir(Session) == shared_dir(Session) and shared_dir(Session).startswith("file://")


def test_components_equal_union_find(spark):
    links = [(i * 37 % 101, i * 53 % 89) for i in range(60)] + [(500, i) for i in range(501, 560)] + [(7, 7), (700, 700)]
    df = spark.createDataFrame(links + [(None, 3), (4, None)], "u long, v long")
    want = loop_components([x for x in links if x[0] != x[1]])
    assert {r.node: r.root for r in star_components(df).collect()} == want
    assert star_components(df.limit(0)).count() == 0
    # Stored labels of the first half, then the rest.
    half = [x for x in links[:70] if x[0] != x[1]]
    stored = spark.createDataFrame(list(loop_components(half).items()), "node long, root long")
    assert {r.node: r.root for r in merge_labels(stored, spark.createDataFrame([x for x in links[70:] if x[0] != x[1]], "u long, v long")).collect()} == want
