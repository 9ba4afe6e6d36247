"""Quality rules: base text rules and bands of tokeniser fertility."""

from __future__ import annotations

import functools
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed_text, restored, written

SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
CACHED_WORDS = 300_000
#: Scripts by first code point of their main blocks (fixed values); what lies before a start belongs to the block before it.
BLOCKS = ((0x0, ""), (0x41, "latin"), (0x5B, ""), (0x61, "latin"), (0x7B, ""), (0xC0, "latin"), (0x250, ""), (0x370, "greek"), (0x400, "cyrillic"),
          (0x530, "other"), (0x590, "hebrew"), (0x600, "arabic"), (0x780, "other"), (0x900, "devanagari"), (0x980, "other"), (0xE00, "thai"),
          (0xE80, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x3040, "kana"), (0x3100, "han"), (0xA000, "other"), (0xAC00, "hangul"),
          (0xD7B0, ""), (0xF900, "han"), (0xFB00, "other"), (0x1F000, ""), (0x20000, "han"), (0x30000, ""))
SCRIPTS = sorted({name for _, name in BLOCKS})
STARTS = np.array([a for a, _ in BLOCKS], np.uint32)
OF_BLOCK = np.array([SCRIPTS.index(name) for _, name in BLOCKS])
METRICS = ("chars_per_token", "fallback_share", "token_entropy")


class Pieces(dict):
    """Token ids by word (bytes), as packed 32-bit integers; emptied between texts when it holds more than a bound."""

    def __init__(self, path: str):
        super().__init__()
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())])

    def learn(self, words: set[bytes]) -> None:
        """Encodes the words that it doesn't hold, in one call."""
        if len(self) > CACHED_WORDS:
            self.clear()
        new = list(words - self.keys())
        self.update(zip(new, (array("i", ids).tobytes() for ids in self.model.encode([w.decode() for w in new], num_threads=1)), strict=True))


@functools.cache
def pieces(path: str) -> Pieces:
    """One vocabulary for each worker process."""
    return Pieces(path)


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words that lie in a window of ``window`` words found twice or more in the text, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    each = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + each[k : k + n]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    marks = np.zeros(n + window, np.int32)
    marks[:n] += twice
    marks[window:] -= twice
    return int((np.cumsum(marks)[: len(words)] > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def main_script(text: str) -> str:
    """The script of most letters; none without letters."""
    if text.isascii():
        return "latin" if any(map(str.isalpha, text)) else ""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    counts = np.bincount(OF_BLOCK[np.searchsorted(STARTS, points, "right") - 1], minlength=len(SCRIPTS))
    counts[SCRIPTS.index("")] = 0
    return SCRIPTS[int(counts.argmax())] if counts.any() else ""


def measure(text: str, words: list[bytes], vocabulary: Pieces) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, script and the three fertility figures of a whole text."""
    chars = len(text) - sum(map(text.count, SPACES))
    tokens = np.frombuffer(b"".join(map(vocabulary.__getitem__, words)), "<i4")
    base = (len(words), chars, sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeated_words(words), main_script(text))
    if not len(tokens):
        return *base, None, None, None
    share = np.unique(tokens, return_counts=True)[1] / len(tokens)
    return *base, chars / len(tokens), float(vocabulary.is_byte[tokens].mean()), float(-(share * np.log2(share)).sum())


def text_measures(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's measures; words are cut at ASCII white space. No shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = pieces(vocab_path)
        for batch in batches:
            for at in range(0, len(batch), 200):
                some = batch.iloc[at : at + 200]
                words = [t.encode("utf-8", "replace").split() for t in some["t"]]
                vocabulary.learn(set().union(*words))
                rows = [(i, *measure(t, w, vocabulary)) for i, t, w in zip(some["i"], some["t"], words, strict=True)]
                yield pd.DataFrame(rows, columns=names)

    names = ["i", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "script", *METRICS]
    kinds = f"i string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, {', '.join(f'{m} double' for m in METRICS)}"
    return restored(docs.select(*keyed_text(docs, id_col, text_col)).mapInPandas(run, kinds), docs, id_col)


def apply_rules(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10, repeat_percent: int = 20, spread: float = 4.0, min_docs: int = 50) -> DataFrame:
    """Measures of each row, ``base_failed``, ``fertility_failed`` and ``kept``.

    Base rules: fewer than ``min_words`` words, or more than ``repeat_percent`` per cent of words in repeated five-word windows.
    Fertility: the bands of a script and length class (words, by powers of two: entropy grows with length) reach ``spread``
    times the distance from the median to the outer twentieths of all their documents that passed the base rules, with
    a floor on that distance; a document with a figure outside is rejected. A class of fewer than ``min_docs`` documents takes the band of
    its whole script, and if that has fewer too, of all documents; there entropy is divided by that of as many different words, so that lengths compare.
    So every document that passed the base rules is judged. The bands have at most one row for each of the fixed list of scripts and 63 lengths, so they are broadcast.
    A null text is the empty text: no words, base_failed. Repeated rows give equal rows; other columns are not used.
    The measures are written to the shared folder once, and bands and verdicts read them from there.
    """
    rows = written(text_measures(docs, vocab_path, id_col, text_col), "measures")
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * repeat_percent)
    rows = rows.withColumn("base_failed", failed).withColumn("_length", F.floor(F.log2(F.col("n_words") + 1)))
    floors = {"chars_per_token": 0.15, "fallback_share": 0.02, "token_entropy": 0.5}
    most = F.greatest(F.log2(F.col("n_words") + 1), F.lit(1.0))
    unit = lambda m, pooled: most if pooled and m == "token_entropy" else F.lit(1.0)

    def bands(level: str, *keys: str) -> DataFrame:
        cuts = [F.percentile_approx(F.col(m) / unit(m, level != "class"), F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)), 10_000).alias(m) for m in METRICS]
        found = rows.where(~F.col("base_failed")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *cuts)
        return F.broadcast(found.select(*keys, F.when(F.col("n") >= (1 if level == "all" else min_docs), F.struct(*METRICS)).alias(f"_{level}")))

    def outside(level: str) -> Column:
        found = F.lit(False)
        for m in METRICS:
            low, mid, high = (F.get(F.col(f"_{level}")[m], F.lit(k)) for k in range(3))
            value, floor = F.col(m) / unit(m, level != "class"), F.lit(floors[m]) / unit(m, level != "class")
            found |= (value < mid - spread * F.greatest(mid - low, floor)) | (value > mid + spread * F.greatest(high - mid, floor))
        return found

    out = rows.join(bands("class", "script", "_length"), ["script", "_length"], "left").join(bands("script", "script"), "script", "left").crossJoin(bands("all"))
    judged = F.when(F.col("_class").isNotNull(), outside("class")).when(F.col("_script").isNotNull(), outside("script")).otherwise(outside("all"))
    out = out.withColumn("fertility_failed", F.coalesce(judged, F.lit(False))).select(*rows.drop("_length").columns, "fertility_failed")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("fertility_failed"))


def op6(spark, sf_dir: str) -> DataFrame:
    """op6_quality_rules over the whole documents table with the public 32k piece vocabulary."""
    import public_tokenizers

    out = apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
    base = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return out.select(*base, "script", *METRICS)
