"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_share, held_out, keyed_text, restored

DIM, SEED, KNOWN_GRAMS, SHARPNESS = 512, 20_240, 40_000, 30.0


@functools.cache
def _letters() -> np.ndarray:
    """Lower-case letter of each 16-bit code point, 0 where it is no letter."""
    table = np.zeros(1 << 16, np.uint16)
    for c in range(1 << 16):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            low = ord(chr(c).lower()[0])
            table[c] = low if low < 1 << 16 else c
    return table


def _symbols(text: str) -> np.ndarray:
    """The text as letters with single gaps (0), gaps at both ends; letters beyond 16 bits fold into a private range."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    if len(points) and points.max() >= 1 << 16:
        far = points >= 1 << 16
        kinds, back = np.unique(points[far], return_inverse=True)
        points = points.copy()
        points[far] = np.array([0xE000 + int(c) % 6400 if chr(c).isalpha() else 0 for c in kinds], "<u4")[back]
        letters = np.where(far, points, _letters()[np.where(far, 0, points)]).astype(np.int64)
    else:
        letters = _letters()[points].astype(np.int64)
    letters = np.concatenate(([0], letters, [0]))
    return letters[np.concatenate(([True], (letters[1:] != 0) | (letters[:-1] != 0)))]


class Space:
    """Random bipolar letter vectors; an n-gram's vector binds (multiplies) the letters' vectors, permuted by position."""

    def __init__(self, dim: int, seed: int):
        self.dim, self.seed = dim, seed
        self.letters: dict[int, np.ndarray] = {}
        self.grams, self.vectors = np.empty(0, np.int64), np.empty((0, dim), np.float32)

    def letter(self, symbol: int) -> np.ndarray:
        if symbol not in self.letters:
            self.letters[symbol] = np.random.default_rng((self.seed, symbol)).choice(np.array([-1, 1], np.float32), self.dim)
        return self.letters[symbol]

    def bind(self, gram: int) -> np.ndarray:
        a, b, c = gram >> 32, gram >> 16 & 0xFFFF, gram & 0xFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def rows(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of sorted distinct grams; what was met before is kept, up to a bound."""
        at = np.searchsorted(self.grams, grams)
        known = np.zeros(len(grams), bool)
        inside = at < len(self.grams)
        known[inside] = self.grams[at[inside]] == grams[inside]
        if known.all():
            return self.vectors[at]
        fresh = grams[~known]
        made = np.stack([self.bind(int(g)) for g in fresh])
        if len(self.grams) + len(fresh) > KNOWN_GRAMS:
            out = np.empty((len(grams), self.dim), np.float32)
            out[known], out[~known] = self.vectors[at[known]], made
            return out
        every = np.concatenate((self.grams, fresh))
        order = np.argsort(every, kind="stable")
        self.grams, self.vectors = every[order], np.concatenate((self.vectors, made))[order]
        return self.vectors[np.searchsorted(self.grams, grams)]

    def bundle(self, text: str | None) -> np.ndarray | None:
        """The sum of the vectors of all trigrams of the whole text, or None without a letter."""
        s = _symbols(text or "")
        if not s.any():
            return None
        s = s if len(s) > 2 else np.concatenate((s, [0]))
        grams, counts = np.unique(s[:-2] << 32 | s[1:-1] << 16 | s[2:], return_counts=True)
        out = np.zeros(self.dim, np.float32)
        for at in range(0, len(grams), 4096):
            out += counts[at : at + 4096].astype(np.float32) @ self.rows(grams[at : at + 4096])
        return out


@functools.cache
def space(dim: int, seed: int) -> Space:
    """One vector space for each worker process; all draw the same vectors."""
    return Space(dim, seed)


def fit_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dim: int = DIM, seed: int = SEED) -> dict[str, np.ndarray]:
    """A unit prototype for each language: the bundle of the unit vectors of all documents given.

    Each task sums what it reads, the sums meet by language: a few vectors of ``dim`` numbers come to the driver.
    """

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hd, total = space(dim, seed), {}
        for batch in batches:
            for lang, text in zip(batch["l"], batch["t"], strict=True):
                v = hd.bundle(text)
                if v is not None:
                    total[lang] = total.get(lang, 0) + v / (np.linalg.norm(v) or 1)
        if total:
            yield pd.DataFrame({"l": list(total), "v": [x.astype(float).tolist() for x in total.values()]})

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("l"), F.col(text_col).alias("t"))
    parts = rows.mapInPandas(sums, "l string, v array<double>")
    dims = [F.sum(F.get("v", F.lit(i))) for i in range(dim)]
    found = {r.l: np.array(r.v, float) for r in parts.groupBy("l").agg(F.array(*dims).alias("v")).collect()}
    return {k: (v / (np.linalg.norm(v) or 1)).astype(np.float32) for k, v in sorted(found.items())}


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", dim: int = DIM, seed: int = SEED) -> DataFrame:
    """Returns id, ``lang_pred`` and ``score`` for each row, by cosine of the text's bundle with each prototype.

    ``score`` is the prediction's share of the softmax of the cosines (0 to 1). A null text, or one without a letter, is
    ``und`` with score 0, as is every text if there are no profiles; of equal cosines the first name in order wins.
    Repeated rows give equal rows; other columns are not used. No shuffle.
    """
    names = list(profiles)
    matrix = np.stack([profiles[n] for n in names]) if names else np.empty((0, dim), np.float32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hd = space(dim, seed)
        for batch in batches:
            if batch.empty:
                continue
            pred, score = [], []
            for text in batch["t"]:
                v = hd.bundle(text) if names else None
                if v is None:
                    pred.append("und"), score.append(0.0)
                    continue
                cos = matrix @ (v / (np.linalg.norm(v) or 1))
                e = np.exp(SHARPNESS * (cos - cos.max()))
                k = int(cos.argmax())
                pred.append(names[k]), score.append(float(e[k] / e.sum()))
            yield pd.DataFrame({"i": batch["i"], "lang_pred": pred, "score": score})

    out = docs.select(*keyed_text(docs, id_col, text_col)).mapInPandas(run, "i string, lang_pred string, score double")
    return restored(out, docs, id_col)


def op1(spark, sf_dir: str, sample: int = 8000) -> DataFrame:
    """op1_language_id over the whole documents table.

    Profiles are fitted on about ``sample`` training rows (of those whose crc32 of the id mod 4 is not 2), chosen by id hash.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    train = docs.where(~held_out("doc_id", 4, 2) & F.col("lang").isNotNull())
    profiles = fit_profiles(train.where(hash_share(sample / max(1, train.count()), 5, "doc_id")).select("text", "lang"))
    found = identify(docs, profiles)
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
