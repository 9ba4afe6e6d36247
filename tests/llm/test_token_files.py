import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from feedlake.llm.common import scratch_path
from feedlake.llm.token_files import Encoder, from_planes, op13, read_span, read_token_files, to_planes, token_round_trip, write_token_files

from .cases import no_docs, odd_docs

VOCAB = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Two  blanks, <|endoftext|>and a Special\ttab", "e\u0301 \u0301x \u0130I \u03a3\u03a3 \x85 \xa0 \x1c\u2028 end", "it's 12 3% \U0001f600\r\n\n x", "a b " * 400_000 + "long", "Word. word?, x_. (y). 9.. \u00e9! \u03a3. <|ENDOFTEXT|>. <|endoftext|>. it'S. \u00bd, e\u0301. \u4e09.", "a\x01b \x01 c. \x01\x01", "no.end", "UPPER Case. <|x"]


@pytest.mark.parametrize("planes", [4, 32])
def test_planes_give_the_ids_back(planes):
    rng = np.random.default_rng(3)
    for ids in (np.zeros(0), np.zeros(9), rng.integers(0, 50_000, 1001), rng.integers(0, 1 << 32, 64)):
        parts = to_planes(ids.astype("<u4"), planes)
        assert len(parts) == planes and from_planes(parts, len(ids)).tolist() == ids.tolist()


def library(texts):
    own = tokenizers.Tokenizer.from_file(VOCAB)
    own.no_truncation()
    own.no_padding()
    return [own.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_runs_encode_as_whole_texts():
    encoder, texts = Encoder(VOCAB), [*TEXTS, "", " ", "\n \n", "word"]
    for _ in range(2):  # the second time from what is kept
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == library(texts)


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_round_trip(spark, planes):
    docs = odd_docs(spark, TEXTS).repartition(3)
    got = token_round_trip(docs, VOCAB, planes=planes).orderBy("start").collect()
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want = [(k, [*ids, 1]) for (k, _), ids in zip(rows, library([t for _, t in rows]), strict=True)]
    assert [(r.doc_id, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in got] == want
    assert [r.start for r in got] == [0, *np.cumsum([len(x) for _, x in want]).tolist()][:-1] and all(r.n_tokens == len(x) for r, (_, x) in zip(got, want, strict=True))
    assert token_round_trip(no_docs(spark), VOCAB).count() == 0


def test_small_files_and_spans(spark):
    docs = odd_docs(spark, TEXTS[:3])
    files = write_token_files(docs, VOCAB, scratch_path(spark, "few"), block_ids=64, file_ids=300, file_docs=4)
    whole = {(r.start, bytes(r.ids)) for r in token_round_trip(docs, VOCAB).collect()}
    assert files.count() > 3 and {(r.start, bytes(r.ids)) for r in read_token_files(files).collect()} == whole
    path = files.orderBy("n_ids", ascending=False).first()
    every = read_span(path.path, 0, path.n_ids)
    assert len(every) == path.n_ids and read_span(path.path, 61, 10).tolist() == every[61:71].tolist()


def test_query(spark):
    got = {r.doc_id: r for r in op13(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    start = 0
    for r, ids in zip(rows, library([r.text for r in rows]), strict=True):
        data = np.array([*ids, 1], "<u4").tobytes()
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(data) // 4, zlib.crc32(data))
        start += len(data) // 4
