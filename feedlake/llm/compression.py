"""Quality classifier by compression with dictionaries of good and bad text."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_share, held_out, kept

LEVEL, CHUNK, BLOCK = 3, 4096, 1024


@dataclass(frozen=True)
class Classifier:
    """Two raw-content dictionaries and the calibration from features to a score."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]


def _compressors(good: bytes, bad: bytes) -> tuple:
    return kept(("compressors", good, bad), lambda: _made(good, bad))


def _made(good: bytes, bad: bytes) -> tuple:
    made = []
    for data in (good, bad):
        book = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        book.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(dict_data=book, write_content_size=False, write_dict_id=False))
    return (*made, zstandard.ZstdCompressor(level=LEVEL, write_content_size=False))


def features(text: str | None, good: bytes, bad: bytes) -> list[float]:
    """Of the whole text, in blocks of ``CHUNK`` bytes: the normalised difference of the sizes with either dictionary,
    the better of the two ratios, and the ratio that the text reaches alone."""
    data = (text or "").encode("utf-8", "replace")
    if not data:
        return [0.0, 0.0, 0.0]
    with_good, with_bad, alone = _compressors(good, bad)
    a = b = 0
    for at in range(0, len(data), CHUNK):
        piece = data[at : at + CHUNK]
        a += len(with_good.compress(piece))
        b += len(with_bad.compress(piece))
    return [(b - a) / max(a, b), min(a, b) / len(data), len(alone.compress(data)) / len(data)]


def _expand(x: np.ndarray) -> np.ndarray:
    return np.column_stack((x, x[:, 0] * x[:, 1], x[:, 2] ** 2, x[:, 1] ** 2, np.ones(len(x))))


def score_of(model: Classifier, x: np.ndarray) -> np.ndarray:
    """Calibrated probability of a good text."""
    z = np.column_stack(((_expand(x)[:, :-1] - model.means) / model.scales, np.ones(len(x)))) @ np.array(model.weights)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _sampled(docs: DataFrame, labelled: DataFrame, share: dict[int, int], id_col: str, text_col: str, per_class: int) -> list:
    """About ``per_class`` labelled texts of each class, by id hash, whole.

    The share to take of each class follows from its count, so about 2 * per_class ids are broadcast and as many texts collected at any size.
    """
    take = F.lit(False)
    for y in (0, 1):
        take |= (F.col("_y") == y) & hash_share(per_class / max(1, share.get(y, 0)), 11, "_i")
    chosen = labelled.where(take).distinct()
    got = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("_i")).select("_i", "_y", F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return sorted(got.distinct().collect(), key=lambda r: (zlib.crc32(str(r._i).encode()), r.t))


def drawn(texts: list[str], book_bytes: int) -> bytes:
    """Up to ``book_bytes`` of the texts, in blocks of ``BLOCK`` bytes from all positions, chosen by hash."""
    blocks = []
    for k, t in enumerate(texts):
        data = t.encode("utf-8", "replace")
        blocks += [(zlib.crc32(f"{k} {at}".encode()), k, at, data[at : at + BLOCK]) for at in range(0, len(data), BLOCK)]
    out, size = [], 0
    for *_, block in sorted(blocks):
        if size + len(block) > book_bytes:
            break
        out.append(block)
        size += len(block)
    return b"".join(out)


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train: Column | None = None, per_class: int = 2000, book_bytes: int = 524_288) -> Classifier | None:
    """Fits dictionaries and calibration on a bounded sample: about ``per_class`` labelled rows of each class, with whole texts.

    Two thirds of the sample fill the dictionaries, by blocks that drawn() takes from all positions; the rest calibrates a logistic
    score on whole texts as they are scored, weighted back to the classes' shares among all labelled rows. None if a class has no row.
    """
    train = F.lit(True) if train is None else train
    labelled = labels.where(train & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_i"), F.col(label_col).cast("int").alias("_y"))
    share = {r._y: r.n for r in labelled.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = _sampled(docs, labelled, share, id_col, text_col, per_class)
    if {r._y for r in rows} != {0, 1}:
        return None
    books, rest = [], []
    for y in (0, 1):
        own = [r.t for r in rows if r._y == y]
        n = max(1, 2 * len(own) // 3)
        books.append(drawn(own[:n], book_bytes) or b"." * 8)
        rest += [(t, y) for t in own[n:] or own]
    bad, good = books
    raw = np.array([features(t, good, bad) for t, _ in rest])
    x, y = _expand(raw), np.array([y for _, y in rest], float)
    means, scales = x[:, :-1].mean(0), x[:, :-1].std(0) + 1e-9
    x = np.column_stack(((x[:, :-1] - means) / scales, np.ones(len(x))))
    w = _logistic(x, y)
    # The sample has the classes in other shares than the corpus: the intercept carries the difference of log odds.
    w[-1] += np.log(share[1] / share[0]) - np.log(max(1, y.sum()) / max(1, (1 - y).sum()))
    return Classifier(good, bad, tuple(w), tuple(means), tuple(scales))


def score_quality(docs: DataFrame, model: Classifier | None, id_col: str = "doc_id", text_col: str = "text", *keep: str) -> DataFrame:
    """id, the kept columns and ``score`` for each row; whole texts are compressed, in blocks. No shuffle.

    Null and empty texts have all features zero and the score that follows. Without a model every score is 0.5.
    Repeated rows give equal rows; columns not named are not used; kept ones of any type pass as they are, but one named ``score`` gives way to the score.
    The model (dictionaries of bounded size) travels as a broadcast variable.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):  # small pieces bound what one worker holds
                part = batch.slice(at, 500)
                texts = part.column(place).to_pylist()
                score = np.full(len(texts), 0.5) if m is None else score_of(m, np.array([features(t, m.good, m.bad) for t in texts]))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(score, pa.float64())], [*names, "score"])

    names = [id_col, *(c for c in keep if c not in (id_col, "score"))]
    place = names.index(text_col) if text_col in names else len(names)
    rows = docs.select(*names, *[F.col(text_col).alias("_t")] * (text_col not in names))
    kinds = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in names] + [T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, kinds)


def op2(spark, sf_dir: str) -> DataFrame:
    """op2_quality over the whole documents table; labels train only where crc32 of the id mod 5 is not 0."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_quality(docs, labels, train=~held_out("doc_id", 5, 0))
    out = score_quality(docs, model)
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
