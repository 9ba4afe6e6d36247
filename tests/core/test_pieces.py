"""Near duplicates through counts of short values: what moves is bounded, and no pair is lost in small batches, parts, bitmaps and cells."""

import random
import subprocess

import numpy as np

from feedlake.operators import dedupe, pieces
from feedlake.sources import scratch

from .test_claims import loop_copies

LETTERS = "abcdefghij"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "full") for i, t in texts.items()], "article_id string, text string, content_status string")


def test_packed_values_come_back():
    rng = np.random.default_rng(3)
    for bits in (1, 2, 5, 20, 37, 63, 64):
        for n in (1, 2, 3, 100, 5000):
            values = np.unique(rng.integers(0, (1 << bits) - 1, n, dtype=np.uint64, endpoint=True))
            data = pieces.packed(values, bits)
            assert (pieces.unpacked(data, len(values), bits) == values).all()
            assert 8 * len(data) <= len(values) * (max(0, bits - len(values).bit_length()) + 3) + 16


def test_hashes_are_of_the_distinct_pieces():
    rng = random.Random(5)
    text = "".join(rng.choice("abé\U0001d4d0") for _ in range(3000))
    units = text.encode("utf-16-le")
    for width in (1, 2, 3, 31, 32, 33):
        want = {units[i : i + 2 * width] for i in range(0, len(units) - 2 * width + 2, 2)}
        assert len(pieces.piece_hashes(np.frombuffer(units, "<u2").astype(np.uint64), width)) == len(want)


def test_near_duplicates_move_a_few_bytes_a_letter(spark):
    """Shuffled and written: each piece went with its text's id through several shuffles before, some 60 bytes a letter."""
    rng = random.Random(7)
    texts = {f"t{i}": "".join(rng.choices(LETTERS, k=3000)) for i in range(300)}
    texts |= {"copy": "x" + texts["t5"], "loop": "abcdefgh" * 300}
    tables = scratch.shared_dir(spark).removeprefix("file://")

    def stages():
        found = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return [found.apply(i) for i in range(found.size())]

    disk = lambda: int(subprocess.run(["du", "-sB1", tables], capture_output=True, check=True).stdout.split()[0])
    df = frame(spark, texts)
    began, written = {s.stageId() for s in stages()}, disk()
    assert [tuple(r) for r in dedupe.near_duplicates(df).collect()] == [("copy", "t5")]
    moved = sum(s.shuffleWriteBytes() for s in stages() if s.stageId() not in began) + disk() - written
    assert moved < 10 * sum(map(len, texts.values())), moved


def test_near_duplicates_in_small_batches_and_maps(spark, monkeypatch):
    """Families of near copies, one of 60 texts, one line that all texts have, and loops, in many batches and parts with a full bitmap."""
    monkeypatch.setattr(pieces, "BATCH", 4000)
    monkeypatch.setattr(pieces, "MARKS", 1 << 15)
    rng = random.Random(11)
    letters = lambda n: "".join(rng.choices(LETTERS, k=n))
    line = letters(70)
    texts = {f"one{i}": letters(rng.randrange(450, 900)) + line for i in range(30)}
    for f in range(6):
        base = letters(500 + 60 * f if f else 1500)
        for j in range(60 if f == 0 else 4):
            k = rng.randrange(len(base))
            texts[f"f{f}m{j}"] = base[:k] + letters(rng.randrange(1, 9)) + base[k + rng.randrange(25) :] + line + letters(rng.choice([0, 0, 20, 150]))
    texts |= {f"loop{i}": "abcdefgh" * (70 + 5 * i) for i in range(3)} | {"long": "abcdefgh" * 40 + letters(400)}
    first = {t: min(i for i in texts if texts[i] == t) for t in texts.values()}
    want = loop_copies({i: t for t, i in first.items()}) | {(first[t], i) for i, t in texts.items() if first[t] != i and len(t) >= 500}
    got = [(r.a, r.b) for r in dedupe.near_duplicates(frame(spark, texts), hot=20).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300 and pieces.Pieces.of(sum(map(len, texts.values())), 32).part_bits > 3


def test_pairs_meet_in_cells(spark):
    rng = random.Random(13)
    base = "".join(rng.choices(LETTERS, k=400))
    texts = {f"t{i}": base[i * 3 :] + "".join(rng.choices(LETTERS, k=50)) for i in range(30)}
    sets = {i: {t[k : k + 32] for k in range(len(t) - 31)} for i, t in texts.items()}
    pairs = [(a, b) for a in texts for b in texts if a != b and rng.random() < 0.6]
    rows = spark.createDataFrame(pairs, "ida string, idb string")
    plain = spark.createDataFrame(list(texts.items()), "id string, plain string")
    got = sorted(tuple(r) for r in pieces.common_pieces(rows, plain, 32, block=4).collect())
    assert got == sorted((a, b, len(sets[a] & sets[b]), min(len(sets[a]), len(sets[b]))) for a, b in pairs)
