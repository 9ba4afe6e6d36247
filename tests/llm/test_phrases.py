import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from feedlake.llm import phrases
from feedlake.llm.phrases import Trie, Words, mine_phrases

from .cases import no_docs, odd_docs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    """The words of each piece of a text."""
    return [re.findall("[^ \t]+", p) for p in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER))]


def grams(texts, sizes):
    return Counter(tuple(w[i : i + k]) for t in texts for w in pieces(t) for k in sizes for i in range(len(w) - k + 1))


def brute(rows, least, top):
    """The ranking from counts of all phrases, with Python's integers."""
    by = defaultdict(list)
    for lang, text in rows:
        by["und" if lang is None else lang].append(text)
    out = []
    for lang, texts in by.items():
        f = grams(texts, (1, 2, 3, 4))
        n = sum(a for p, a in f.items() if len(p) == 1)
        cand = {p: a for p, a in f.items() if len(p) >= 2 and a >= least}
        found = []
        for p, a in cand.items():
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            inside = [b for q, b in cand.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * b >= 80 * a for b in inside):
                found.append((-score, -a, " ".join(p).encode(), " ".join(p), a, f[p[:k]], f[p[k:]], n, score))
        out += [(lang, r, *x[3:]) for r, x in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", "and", "New", "York", "York's", "a", "é", "\U0001f600", "x\x00y", "İ", "stock", "price", "rose"]
    phrase = ["new york stock", "a stock price rose", "of the", "York New York New York"]
    text = lambda: "".join(rng.choice([rng.choice(words), rng.choice(words), rng.choice(phrase)]) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "!\x0b", "\x1c"]) for _ in range(rng.randrange(1, 60)))
    return [(rng.choice(["en", "en", "fr", None, "und"]), text()) for _ in range(n)]


def test_ranks_equal_brute_force(spark):
    docs = odd_docs(spark, [t for _, t in corpus(1, 40)])
    docs = docs.unionByName(spark.createDataFrame([(None, t, lang, "s", 0, "c", "c") for lang, t in corpus(2, 60)], docs.schema)).repartition(5)
    rows = [(r.lang, r.text) for r in docs.collect()]
    for least, top in ((3, 2000), (8, 5)):
        got = sorted(map(tuple, mine_phrases(docs, least=least, top=top).collect()))
        want = brute(rows, least, top)
        assert got == want and len(want) > 20 * (top > 5)
    assert mine_phrases(no_docs(spark)).count() == 0 and mine_phrases(docs, least=10**9).count() == 0
    assert mine_phrases(docs, least=8, top=5).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_containers_burst_and_subtrees_spill(monkeypatch):
    monkeypatch.setattr(phrases, "BURST", 8)
    rng = random.Random(3)
    trie, want = Trie(2), Counter()
    for _ in range(30):
        some = [tuple(min(int(rng.expovariate(0.4)) + 1, 30) for _ in range(rng.choice((3, 4)))) for _ in range(200)]
        want.update(some)
        packed = [(w[1] << 42) | (w[2] << 21) | (w[3] if len(w) == 4 else 0) for w in some]
        trie.add(np.array([w[0] for w in some]), np.array(packed))
    assert any(type(x) is phrases._Burst and any(type(y) is phrases._Burst for y in x.values()) for x in trie.nodes.values())
    assert trie.size == len(want)
    got = Counter()
    for share in (0.5, 0.5, 1.0):
        before = trie.size
        first, rest, n = trie.spill(share)
        assert before - trie.size == len(n) >= share * before
        for w, r, k in zip(first.tolist(), rest.tolist(), n.tolist(), strict=True):
            got[(w, r >> 42, (r >> 21) & ((1 << 21) - 1), *([r & ((1 << 21) - 1)] if r & ((1 << 21) - 1) else []))] += k
    assert got == want and trie.size == 0 and not trie.nodes


def test_long_texts_are_cut_without_losing_or_doubling_phrases(monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 40)
    rows = corpus(4, 12) + [("en", "one long piece of many words " * 30)]
    words, got = Words(), Counter()
    batch = pa.record_batch([pa.array([r[0] or "und" for r in rows]), pa.array([r[1] for r in rows])], ["lang", "text"])
    for ids, skip in phrases._slices(batch, words):
        ids = ids.tolist()
        for k in (1, 2, 3, 4):
            for i in range(len(ids) - k + 1):
                if i + k - 1 >= skip and all(ids[i : i + k]):
                    got[tuple(words.names[x][1].decode() for x in ids[i : i + k])] += 1
    assert got == grams([r[1] for r in rows], (1, 2, 3, 4))


def test_filters_hold_what_they_were_given(spark):
    hashes = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 500, dtype=np.int64)
    df = spark.createDataFrame([(int(h),) for h in hashes[:250]], "h long")
    found = phrases.holds(phrases.filter_of(df, df.h), hashes.view(np.uint64))
    assert found[:250].all() and found[250:].sum() < 5
