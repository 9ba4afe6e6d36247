"""Byte-pair encoding by per-prefix dynamic programming, and decoding."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept

#: The byte-level pre-tokeniser's pattern, with the Unicode white space written out (fixed values).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: A blank with white space or the end behind it: only then does a pre-token reach over a cut before a blank.
OPEN_BLANK = re.compile(rf" (?:[{SPACE}]|\Z)")
CACHED_WORDS, CACHED_PAIRS, LONGEST_CACHED = 150_000, 300_000, 60


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """A byte-level vocabulary with what the prefix programme needs: the suffix matcher, merges and pair tests."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        letters = _byte_letters()
        raw = {word: bytes(letters[c] for c in word) for word in model["model"]["vocab"]}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        ids = {raw[word]: i for word, i in model["model"]["vocab"].items()}
        self.bytes_of = {i: b for b, i in ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.byte_id = [ids[bytes([b])] for b in range(256)]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            a, b = (raw[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merge[ids[a], ids[b]] = (rank, ids[a + b])
        # Matches of all tokens that are a suffix of the text read so far.
        self.suffixes = ahocorasick.Automaton()
        for b, i in ids.items():
            self.suffixes.add_word(b.decode("latin-1"), (len(b), i))
        self.suffixes.make_automaton()
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pairs: dict[int, bool] = {}
        self.old_pairs: dict[int, bool] = {}
        self.words = _Cache(lambda word: np.array(self.encode_word(word.encode()), "<u4").tobytes())
        self.runs = _Cache(lambda run: b"".join(map(self.words.__getitem__, SPLIT.findall(" " + run))))

    def merged(self, data: bytes) -> list[int]:
        """Merges by rank, for the few bytes of one or two tokens."""
        ids = [self.byte_id[b] for b in data]
        while len(ids) > 1:
            rank, at = min((self.merge.get(p, (1 << 60,))[0], k) for k, p in enumerate(zip(ids, ids[1:], strict=False)))
            if rank == 1 << 60:
                break
            ids[at : at + 2] = [self.merge[ids[at], ids[at + 1]][1]]
        return ids

    def compatible(self, a: int, b: int) -> bool:
        """Whether ``b`` can follow ``a``: their bytes together encode to just these two (a < 0: ``b`` stands alone). Kept by a packed key, for encode_word()."""
        key = (a << 17) + b
        got = self.old_pairs.get(key)
        if got is None:
            want = [b] if a < 0 else [a, b]
            got = self.merged(b"".join(self.bytes_of[x] for x in want)) == want
        if len(self.pairs) >= CACHED_PAIRS:
            self.old_pairs = dict(self.pairs)
            self.pairs.clear()
        self.pairs[key] = got
        return got

    def encode_word(self, data: bytes) -> list[int]:
        """Exact ids of one pre-token: the last token of each prefix is unique, and back-pointers from the end give all."""
        n = len(data)
        tokens: list[int | None] = [-1] + [None] * n
        widths = [0] * (n + 1)
        known = self.pairs.get
        for end, (width, token) in self.suffixes.iter(data.decode("latin-1")):
            if tokens[end + 1] is None:
                before = tokens[end + 1 - width]
                if before is not None:
                    fits = known((before << 17) + token)
                    if fits or fits is None and self.compatible(before, token):
                        tokens[end + 1], widths[end + 1] = token, width
        out, i = [], n
        while i:
            out.append(tokens[i])
            i -= widths[i]
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; a special token's string is its id."""
        parts = self.cut.split(text) if self.cut else [text]
        packed = []
        for k, part in enumerate(parts):
            packed += [self.special[part].to_bytes(4, "little")] if k % 2 else self.encoded(part)
        return b"".join(packed)

    def encoded(self, text: str) -> Iterable[bytes]:
        """Packed ids of a text without special tokens. Where each blank has a word behind it, a blank always begins a pre-token, so that the text is
        cut at blanks first and what lies between them is looked up whole."""
        if OPEN_BLANK.search(text):
            return map(self.words.__getitem__, SPLIT.findall(text))
        first, *rest = text.split(" ")
        return chain(map(self.words.__getitem__, SPLIT.findall(first)), map(self.runs.__getitem__, rest))

    def decode(self, packed: bytes) -> str:
        """The text of packed ids."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


class _Cache(dict):
    """Packed ids by string, bounded in number and in length of what it keeps. When it is full, its strings become the older ones, and those
    that come again move back, so frequent ones stay."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> bytes:
        got = self.older.get(key)
        if got is None:
            got = self.make(key)
        if len(key) <= LONGEST_CACHED:
            if len(self) >= CACHED_WORDS:
                self.older = dict(self)
                self.clear()
            self[key] = got
        return got


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary, loaded once by each worker process while it encodes."""
    return kept(("vocabulary", path), lambda: Vocabulary(path))


def encode_decode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each whole text exactly and decodes the ids again.

    Returns id, ``n_tokens`` (long), ``ids`` (binary, little-endian unsigned 32-bit integers) and ``decoded`` (string), one
    row for each input row in any order. A null text is the empty text and has no ids. Repeated rows give equal
    rows; other columns of the input are not used. ``vocab_path`` must exist on every executor. No shuffle: each row
    is encoded where it is read, and a worker keeps bounded caches only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocab_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):  # small pieces bound what one worker holds
                keys, texts = batch.slice(at, 500).columns
                ids = [v.encode(t) for t in texts.to_pylist()]
                made = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([v.decode(x) for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays([keys, *made], names)

    names = [id_col, "n_tokens", "ids", "decoded"]
    kinds = T.StructType([T.StructField(n, k) for n, k in zip(names, (docs.schema[id_col].dataType, T.LongType(), T.BinaryType(), T.StringType()), strict=True)])
    return docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_t")).mapInArrow(run, kinds)


def op5(spark, sf_dir: str) -> DataFrame:
    """op5_bpe over the whole documents table with the public 50k byte-level vocabulary."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.selectExpr("doc_id", "n_tokens", "sha2(ids, 256) AS ids_sha256", "sha2(CAST(decoded AS BINARY), 256) AS decoded_sha256")
