import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from feedlake.llm.bpe import encode_decode
from feedlake.llm.compression import fit_quality, score_quality
from feedlake.llm.fertility import apply_rules
from feedlake.llm.language import fit_profiles, identify

from .cases import no_docs, odd_docs

VOCAB = public_tokenizers.path("byte_bpe_50k.json")


def random_texts(n, seed):
    rng = random.Random(seed)
    bits = ["the", " The", "ing", "'s", "'ll", " don't", "\n\n", "   ", "\t", "123", "4567", "éà", "ß", "中文", "\U0001f600", "\u3000", "\x85", "\x1c", "<|endoftext|>", "<|endof", "###",
            "$$$ ", "xyzzy", "aaaaaaaaaaaaaaaa", "\u0301", "\u200b", "\xa0\xa0", "ſ", "İ", "www.a-b.c/?q=1", " ", "\r\n", "̀ुन", "١٢"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(n)]


def test_bpe_is_exact(spark):
    own = Tokenizer.from_file(VOCAB)
    docs = odd_docs(spark, random_texts(400, 1) + ["a" * 3000, " " * 500 + "z", "ab" * 2000])
    got = {(r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in encode_decode(docs, VOCAB).collect()}
    want = set()
    for r in docs.collect():
        ids = own.encode(r.text or "", add_special_tokens=False).ids
        want.add((r.doc_id, len(ids), np.array(ids, "<u4").tobytes(), own.decode(ids, skip_special_tokens=False)))
    assert got == want
    assert encode_decode(no_docs(spark), VOCAB).count() == 0


def fertility_base(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    marked = {i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(marked) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked), failed


def test_fertility(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["ein", "Haus", "steht", "am", "Fluss", "und", "river"]) for _ in range(rng.randint(1, 60))) + "\nx y\nx y\n" for _ in range(80)]
    texts += [" ".join(chr(0x13000 + rng.randrange(900)) for _ in range(12))] + random_texts(40, 3)
    docs = odd_docs(spark, texts)
    rows = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in apply_rules(docs, path, min_docs=10).collect()}
    assert rows == {(r.doc_id, *fertility_base(r.text or "")) for r in docs.collect()}
    assert apply_rules(docs, path).count() == docs.count() and apply_rules(no_docs(spark), path).count() == 0
    got = {r.doc_id: r for r in apply_rules(docs, path).collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for w in texts[0].split() for i in model.encode(w)]
    share = [c / len(ids) for c in Counter(ids).values()]
    assert got[100].token_entropy == pytest.approx(-sum(p * math.log2(p) for p in share))
    assert got[100].chars_per_token == pytest.approx(sum(map(len, texts[0].split())) / len(ids))
    assert got[180].fallback_share > 0.4 and not any(r.kept for r in got.values() if r.base_failed)


def test_fertility_bands_reject_outliers(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rng = random.Random(4)
    words = "the house stands near a river and people walk along it every day with their dogs".split()
    texts = [" ".join(rng.sample(words, 14)) for _ in range(100)] + [" ".join(f"q{i}zxj" + "xq" * 3 + "κ" * 0 for i in range(14))]
    got = {r.doc_id: r.kept for r in apply_rules(odd_docs(spark, texts), path).collect()}
    assert all(got[100 + i] for i in range(100)) and not got[200]


def test_language(spark):
    rng = random.Random(5)
    words = {"en": "the of and with from have that this house water".split(), "de": "der und nicht mit von das haus wasser straße über".split(), "fr": "le la et avec dans être maison eau où très".split()}
    make = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    train = spark.createDataFrame([(make(x, 40), x) for x in words for _ in range(20)] + [(None, "en"), ("text", None)], "text string, lang string")
    profiles = fit_profiles(train)
    langs = [x for x in words for _ in range(20)]
    docs = odd_docs(spark, [make(x, 15) for x in langs] + ["中文 é \U0001f600 \U00020000", "12 34"])
    got = {r.doc_id: r for r in identify(docs, profiles).collect()}
    assert [got[100 + i].lang_pred for i in range(len(langs))] == langs
    assert {got[i].lang_pred for i in (1, 2, 3, 161)} == {"und"} and all(0 <= r.score <= 1 for r in got.values())
    assert identify(docs, profiles).count() == docs.count() and identify(no_docs(spark), profiles).count() == 0
    assert identify(docs, {}).where(F.col("lang_pred") != "und").count() == 0


def test_quality(spark):
    rng = random.Random(6)
    words = ["river", "house", "people", "walk", "every", "morning", "quiet", "street"]
    good = lambda: " ".join(rng.choice(words) for _ in range(60)) + "."
    bad = lambda: " | ".join(rng.choice(words).upper() + rng.choice(["###", "$$$", "%%%"]) for _ in range(60))
    texts = [good() if i % 3 else bad() for i in range(240)]
    docs = odd_docs(spark, texts)
    labels = spark.createDataFrame([(100 + i, int(i % 3 > 0)) for i in range(150)] + [(1, None), (None, 1)], "doc_id long, quality int")
    model = fit_quality(docs, labels)
    got = {r.doc_id: r.score for r in score_quality(docs, model).collect()}
    right = [(got[100 + i] >= 0.3) == (i % 3 > 0) for i in range(150, 240)]
    assert np.mean(right) > 0.95 and all(0 <= x <= 1 for x in got.values())
    assert score_quality(docs, model, "doc_id", "text", *docs.columns).columns == docs.columns + ["score"]
    assert score_quality(no_docs(spark), model).count() == 0
    assert fit_quality(docs, labels.where("false")) is None and score_quality(docs, None).where("score <> 0.5").count() == 0
    assert hashlib.md5(repr(model).encode()).hexdigest() == hashlib.md5(repr(fit_quality(docs, labels)).encode()).hexdigest()
