import random

import public_tokenizers

from feedlake.llm.fertility import apply_rules

from .cases import odd_docs


def test_small_classes_are_judged_by_pooled_bands(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rng = random.Random(4)
    words = "the house stands near a river and people walk along it every day with their dogs".split()
    plain = lambda n: " ".join(f"{rng.choice(words)} {rng.choice(words)}" for _ in range(n // 2))
    junk = lambda n: " ".join("xq" + "".join(rng.choice("qzxjkvw") for _ in range(12)) for _ in range(n))
    texts = [" ".join(rng.sample(words, 14)) for _ in range(100)] + [junk(300), " ".join(rng.sample(words, 16)), "".join(chr(0x13000 + i) + " " for i in range(40))]
    texts += [plain(40)]
    got = {r.doc_id: r for r in apply_rules(odd_docs(spark, texts), path).collect()}
    assert not any(got[i].base_failed for i in (200, 201, 202))
    assert not got[200].kept and not got[202].kept and got[201].kept
    assert got[200].fertility_failed and all(got[100 + i].kept for i in range(100))
