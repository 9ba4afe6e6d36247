"""Work must grow with the input: these cases took time with the square of a text's length, or of its terms, before."""

import random
import time

from pyspark.sql import functions as F

from feedlake.operators import dedupe, ranking
from feedlake.plans import article_queries, event_queries

SF = "/root/testdata/sf0.001"


def seconds(run):
    began = time.time()
    return run(), time.time() - began


def test_pieces_of_a_long_text_are_cut_in_linear_time(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh\U0001d4d0é") for _ in range(300_000))
    units = text.encode("utf-16-be")
    want = len({units[i : i + 64] for i in range(0, len(units) - 62, 2)})
    df = spark.createDataFrame([(text,)], "t string")
    got, took = seconds(lambda: df.select(F.size(dedupe.char_shingles(F.col("t"))).alias("n")).first().n)
    assert got == want and took < 60


def test_passages_do_not_cut_a_block_for_each_term(spark):
    rng = random.Random(2)
    text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(250_000))
    df = spark.createDataFrame([(text, " ".join(f"term{i}" for i in range(35)), "term1")], "text string, many string, one string")
    run = lambda c: seconds(lambda: ranking.passages(df, F.col(c)).select("passages").first().passages)
    run("one")
    (got, many), (want, one) = run("many"), run("one")
    assert got == want and many < 6 * one + 2


def test_texts_are_shuffled_once_for_passages(spark):
    plan = event_queries.read_passages(spark, SF)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    nodes = [n for n in plan.split("\n\n") if ") Exchange" in n and ("text#" in n.split("Input")[-1].split("\n")[0])]
    assert len(nodes) == 1


def test_grouping_reads_and_hashes_texts_once(spark, monkeypatch):
    made = []
    keys = dedupe.match_keys
    monkeypatch.setattr(dedupe, "match_keys", lambda rows: made.append(rows) or keys(rows))
    for run in (article_queries.grown, article_queries.canonical):
        made.clear()
        plan = run(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert len(made) == 1 and "text#" not in plan and "sha2(" not in plan
