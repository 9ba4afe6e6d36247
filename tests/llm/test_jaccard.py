import random
import re

from pyspark.sql import functions as F

from feedlake.llm import jaccard
from feedlake.llm.jaccard import Setting, jaccard_classes, jaccard_join, jaccard_links, one_of_each
from feedlake.llm.shingles import shingle_sets

from .cases import no_docs, odd_docs


def sets_of(text, k):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute(rows, k, num, den):
    sets, up = [sets_of(t, k) for _, t in rows], list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    named = [i for i, (d, _) in enumerate(rows) if d is not None]
    for i in named:
        for j in named:
            if i < j and sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    best = {}
    for i in named:
        best[top(i)] = min(best.get(top(i), rows[i][0]), rows[i][0])
    return sorted(((d, len(sets[i]), best[top(i)] if d is not None else None) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(seed, n_base, copies, edits, length=60):
    rng = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(25)]
    texts = []
    for b in range(n_base):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(length // 2, length))] + passage * (b % 2)
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, edits)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    return texts


def check(spark, texts, setting):
    docs = odd_docs(spark, texts)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in jaccard_classes(docs, setting=setting).collect()), key=repr)
    assert got == brute(rows, setting.k, setting.num, setting.den)
    return got


def test_shingle_sets_are_exact():
    texts = ["A b\x0bc d e", "a B c\x1cd", None, "", "one", "a b c d e a b c d", "é É x y z"]
    assert [len(h) for h in shingle_sets(texts, 4)] == [len(sets_of(t, 4)) for t in texts]
    a, b = shingle_sets(["x y a b c d", "a b c d\n"], 4)
    assert set(b.tolist()) < set(a.tolist())


def test_rare_regions(spark):
    got = check(spark, corpus(1, 20, 4, 3), Setting())
    assert any(c is not None and c != d for d, _, c in got)


def test_frequent_regions_use_document_pivots(spark):
    # One family of near copies fills the regions of frequent shingles: pivots, windows and recursion decide.
    check(spark, corpus(2, 2, 60, 4) + corpus(3, 3, 3, 2), Setting(cells=1 << 16, small=5, pivots=3))


def test_other_threshold(spark):
    check(spark, corpus(4, 6, 12, 5), Setting(k=5, num=80, den=100, cells=1 << 16, small=4, pivots=2))


def test_one_of_each_and_empty(spark):
    docs = odd_docs(spark, corpus(5, 4, 5, 1))
    kept = one_of_each(docs)
    classes = jaccard_classes(docs)
    want = classes.where((F.col("doc_id") == F.col("component_id")) | F.col("doc_id").isNull()).count()
    assert kept.count() == want and kept.columns == docs.columns
    assert jaccard_classes(no_docs(spark)).count() == 0 and one_of_each(no_docs(spark)).count() == 0


def check_links(spark, texts, setting):
    docs = odd_docs(spark, texts)
    rows = sorted({(r.doc_id, r.text) for r in docs.collect()}, key=repr)
    sets = [sets_of(t, setting.k) for _, t in rows]
    near = lambda a, b: bool(a and b) and setting.den * len(a & b) >= setting.num * len(a | b)
    named = [i for i, (d, _) in enumerate(rows) if d is not None]
    n = {i: sum(j != i and near(sets[i], sets[j]) for j in named) for i in named}
    got = jaccard_join(docs, setting=setting)
    assert sorted({(r.doc_id, r.n_links) for r in got.collect()}, key=repr) == sorted({(d, n.get(i)) for i, (d, _) in enumerate(rows)}, key=repr)
    assert sorted(map(tuple, got.drop("n_links").collect()), key=repr) == sorted(map(tuple, jaccard_classes(docs, setting=setting).collect()), key=repr)
    first = {}
    for i in named:
        if sets[i]:
            first[frozenset(sets[i])] = min(first.get(frozenset(sets[i]), rows[i][0]), rows[i][0])
    want = sorted((a, b, len(x & y), len(x), len(y)) for x, a in first.items() for y, b in first.items() if a < b and near(x, y))
    links, members = jaccard_links(docs, setting=setting)
    assert sorted(map(tuple, links.collect())) == want
    assert {tuple(r) for r in members.collect()} == {(d, first.get(frozenset(s)) if d is not None else None) for (d, _), s in zip(rows, sets, strict=True)}
    return want


def test_links_inside_a_family_are_all_found(spark):
    words = [f"w{i}" for i in range(100)]
    family = [" ".join(words[:60] + ["a"] * (i == 1) + ["b"] * (i == 2) + words[60:]) for i in range(3)]
    assert {(a, b) for a, b, *_ in check_links(spark, [*family, family[0]], Setting())} == {(100, 101), (100, 102), (101, 102)}


def test_links_over_blocks_and_bands(spark):
    steps = [" ".join(f"s{i}" for i in range(n)) for n in range(40, 140, 3)]
    check_links(spark, corpus(6, 1, 30, 4) + steps, Setting(cells=1 << 16, block=4))


def test_prefixes_are_read_once_for_what_pivots_leave(spark, monkeypatch):
    """No written table has the signatures of all sets behind it more than twice (a join with their own keys), also where regions stay unsplit."""
    found, plain = [], jaccard.written

    def written(df, tag):
        found.append((tag, df._jdf.queryExecution().executedPlan().toString().count("/signatures]")))
        return plain(df, tag)

    monkeypatch.setattr(jaccard, "written", written)
    before = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        check(spark, corpus(5, 12, 3, 4), Setting(cells=1 << 16, small=2, joined=1, levels=1))
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", before)
    tags = {t for t, _ in found}
    assert "signatures" in tags and max(n for _, n in found) > 0
    assert [x for x in found if x[1] > 2] == []
