"""Language profiles and the quality classifier against plain versions of the same definitions."""

import random
import zlib
from itertools import groupby

import numpy as np
import zstandard
from pyspark.sql import functions as F

from feedlake.llm.compression import CHUNK, LEVEL, fit_quality, score_quality
from feedlake.llm.language import DIM, SEED, SHARPNESS, Space, fit_profiles, identify

from .cases import odd_docs


def plain_bundle(text, space):
    """Every trigram's vector bound and added by itself."""
    letters = [(c.lower()[0] if ord(c.lower()[0]) < 1 << 16 else c) if c.isalpha() else " " for c in text or ""]
    letters = [" ", *letters, " "]
    runs = [c for key, run in groupby(letters, lambda c: c == " ") for c in ([" "] if key else list(run))]
    if not any(c != " " for c in runs):
        return None
    number = lambda c: 0 if c == " " else ord(c) if ord(c) < 1 << 16 else 0xE000 + ord(c) % 6400
    s = [number(c) for c in runs]
    s += [0] * (3 - len(s))
    out = np.zeros(DIM)
    for a, b, c in zip(s, s[1:], s[2:], strict=False):
        out += np.roll(space.letter(a), 2) * np.roll(space.letter(b), 1) * space.letter(c)
    return out


def test_language_equals_the_plain_version(spark):
    rng, space = random.Random(3), Space(DIM, SEED)
    words = {"en": "the of and with from Have that".split(), "de": "der und nicht mit von das Straße".split(), "fr": "le la et avec dans être où".split()}
    make = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(1, 12))) + rng.choice(["", ".", " 12", " \U00020000\U00020001"])
    train = [(make(x), x) for x in words for _ in range(15)]
    profiles = fit_profiles(spark.createDataFrame(train, "text string, lang string").repartition(4))
    plain = {}
    for text, lang in train:
        v = plain_bundle(text, space)
        plain[lang] = plain.get(lang, 0) + v / np.linalg.norm(v)
    plain = {k: v / np.linalg.norm(v) for k, v in sorted(plain.items())}
    assert list(profiles) == list(plain) and all(np.abs(profiles[k] - plain[k]).max() < 1e-5 for k in plain)
    docs = odd_docs(spark, [make(x) for x in words for _ in range(25)] + ["X", "x y", "..a..", "ÀÉ ßẞ", "the der le"])
    matrix = np.stack(list(plain.values()))
    rows = docs.withColumn("k", F.monotonically_increasing_id()).cache()
    got = identify(rows, profiles, "k").join(rows.select("k", "text"), "k").collect()
    assert len(got) == docs.count()
    for r in got:
        v = plain_bundle(r.text, space)
        if v is None:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cos = matrix @ (v / (np.linalg.norm(v) or 1))
        e = np.exp(SHARPNESS * (cos - cos.max()))
        assert abs(r.score - e.max() / e.sum()) < 1e-3
        assert r.lang_pred == list(plain)[int(cos.argmax())] or np.sort(cos)[-1] - np.sort(cos)[-2] < 1e-5


def plain_score(text, m):
    """The score from sizes that are measured one by one."""
    data = (text or "").encode()
    x = [0.0, 0.0, 0.0]
    if data:
        size = lambda book, piece: len(zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(book, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False).compress(piece))
        cut = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
        a, b = (sum(size(book, p) for p in cut) for book in (m.good, m.bad))
        x = [(b - a) / max(a, b), min(a, b) / len(data), len(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False).compress(data)) / len(data)]
    z = [*x, x[0] * x[1], x[2] ** 2, x[1] ** 2]
    z = sum(w * (v - mean) / scale for w, v, mean, scale in zip(m.weights, z, m.means, m.scales, strict=False)) + m.weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def test_quality_equals_the_plain_version(spark):
    rng = random.Random(8)
    words = ["river", "house", "people", "walk", "every", "morning", "quiet", "street"]
    good = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    bad = lambda n: " | ".join(rng.choice(words).upper() + rng.choice(["###", "$$$"]) for _ in range(n))
    texts = [(good if i % 3 else bad)(rng.randrange(5, 80)) for i in range(120)] + [good(30_000)]
    docs = odd_docs(spark, texts).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    # Document 100 has both labels: it counts in either class.
    labels = spark.createDataFrame([(100 + i, int(i % 3 > 0)) for i in range(90)] + [(100, 1)], "doc_id long, quality int")
    train = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    model = fit_quality(docs, labels, train=train)
    held = {i for i in range(100, 190) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert held and model == fit_quality(docs, labels.where(~F.col("doc_id").isin(*held)))  # held-out labels have no part
    got = {r.doc_id: (r.score, r.text) for r in score_quality(docs, model, "doc_id", "text", "text").collect()}
    assert len(got) == docs.count() and all(abs(s - plain_score(t, model)) < 1e-9 for s, t in got.values())
