"""Every stage of corpus_pipeline on odd rows, against brute-force versions of what it decides."""

import hashlib
import random

import pytest
import tokenizers

import corpus_pipeline as p
from feedlake.llm.compression import fit_quality, score_quality

from .cases import no_docs, odd_docs
from .test_jaccard import brute, corpus
from .test_native import line_oracle
from .test_pages import brute_contaminated

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(21)
    texts = corpus(8, 6, 4, 3, 80)
    texts += ["\n".join(rng.choice(texts) for _ in range(2)) for _ in range(3)]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    return odd_docs(spark, [*texts, f"so here {item} ends", "plain words of a text that no other holds"])


def rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_columns_and_empty_tables(spark, docs):
    for name, stage in p.STAGES:
        out = stage(spark, docs, SF)
        if name != "tokens":
            assert out.columns == list(p.COLUMNS)
        assert stage(spark, no_docs(spark), SF).count() == 0


def test_quality(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"), train=~p.held_out("doc_id", 5, 0))
    scores = {r.doc_id: r.score for r in score_quality(docs, model, "doc_id", "text").collect()}
    assert {d for d, _ in rows(p.quality(spark, docs, SF))} == {d for d, x in scores.items() if x >= 0.3}


def test_lines(spark, docs):
    want = [(d, t) for d, _, n, t in line_oracle(rows(docs)) if not n or t.strip(" \t\n\x0b\x0c\r")]
    got = p.lines(spark, docs, SF)
    assert rows(got) == sorted(want, key=repr) and len(want) < docs.count()
    assert all(r.n_chars == len(r.text) for r in got.collect())


def test_near_duplicates(spark, docs):
    classes = brute(rows(docs), 5, 80, 100)
    keep = {d for d, _, c in classes if d == c}
    assert rows(p.near_duplicates(spark, docs, SF)) == [r for r in rows(docs) if r[0] is None or r[0] in keep]


def test_decontamination(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, _ in brute_contaminated(rows(docs), items)}
    assert bad and rows(p.decontamination(spark, docs, SF)) == [r for r in rows(docs) if r[0] not in bad]


def test_tokens(spark, docs):
    import public_tokenizers

    tok = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    tok.no_truncation()
    tok.no_padding()
    want = []
    for d, t in rows(docs):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), tok.decode(ids, skip_special_tokens=False)))
    got = [(r.doc_id, r.n_tokens, hashlib.sha256(bytes(r.ids)).hexdigest(), r.text) for r in p.tokens(spark, docs, SF).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
