"""Whitening of embeddings by an incremental eigendecomposition: rank-one updates in partitions, spectra combined, a last refinement over all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept, written

EPS = np.finfo(float).eps
SCALE, SHIFT = 64, 1_000_000
#: Entries of this size or more count as not finite; sums are kept in two halves, the low one of so many bits.
LARGEST, HALF = 2.0**40, 23


def rank_one(values: np.ndarray, vectors: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum of vectors * diag(values) * vectors' + z z'; ``values`` are ascending.

    Deflation: where z hardly touches an eigenvector, or two values are as good as equal (a rotation then takes z off one of them), the pair stays.
    The others' new values are the roots of the secular equation 1 + sum(w^2 / (values - root)), one between each two poles, found by bisection from the
    nearer pole. The vectors use the z for which these roots are exact, which keeps them orthogonal.
    """
    values, vectors = values.copy(), vectors.copy()
    w = vectors.T @ z
    tiny = 8 * EPS * max(float(np.abs(values).max(initial=0)), float(w @ w))
    w[np.abs(w) * np.sqrt(w @ w) <= tiny] = 0
    last = None
    for i in np.flatnonzero(w).tolist():
        if last is not None:
            r = np.hypot(w[i], w[last])
            c, s = w[i] / r, w[last] / r
            if (values[i] - values[last]) * abs(c * s) <= tiny:
                a, b = vectors[:, last].copy(), vectors[:, i].copy()
                vectors[:, last], vectors[:, i] = c * a - s * b, s * a + c * b
                w[last], w[i] = 0, r
        last = i
    live = np.flatnonzero(w)
    k = len(live)
    if k:
        d, y = values[live], w[live]
        pole = np.arange(k)
        ends = np.append(d[1:], d[-1] + y @ y)
        middle = (d + ends) / 2
        right = 1 + (y**2 / (d[None, :] - middle[:, None])).sum(axis=1) < 0
        right[-1] = False
        origin = pole + right
        away = d[None, :] - d[origin][:, None]
        reach = np.where(np.arange(k) == k - 1, ends - d, (ends - d) / 2)
        lo, hi = np.where(right, -reach, 0.0), np.where(right, 0.0, reach)
        for _ in range(64):
            mid = (lo + hi) / 2
            with np.errstate(divide="ignore"):
                below = 1 + (y**2 / (away - mid[:, None])).sum(axis=1) < 0
            lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
        step = np.where(right, lo, hi)
        apart = away - step[:, None]  # pole j - root i
        apart[apart == 0] = EPS * tiny + np.finfo(float).tiny
        under = np.where(pole[:, None] < pole[None, :], d[:, None], np.append(d[1:], 0)[:, None]) - d[None, :]
        under[-1] = 1
        exact = np.sqrt(np.abs(np.prod(apart / np.where(under == 0, EPS, under), axis=0))) * np.sign(y)
        turned = exact[:, None] / apart.T
        vectors[:, live] = vectors[:, live] @ (turned / np.linalg.norm(turned, axis=0))
        values[live] = d[origin] + step
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


def updated(values: np.ndarray, vectors: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum after a rank-one update with each row. More rows than there are dimensions are first turned into as many with the same products (the R of a QR decomposition)."""
    if len(rows) > rows.shape[1]:
        rows = np.linalg.qr(rows, mode="r")
    for z in rows:
        values, vectors = rank_one(values, vectors, z)
    return values, vectors


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part: all entries are there and finite."""
    v = F.col(vector_col).cast("array<double>")
    ok = F.size(v) > 0
    ok = ok & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    return vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(F.coalesce(ok, F.lit(False)))


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    """The entries of a batch of vectors as the integers x."""
    return np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)).astype(np.int64) + SHIFT


def summed(parts: DataFrame) -> list:
    """Rows (i, v) of partial matrices added up by row: they come sorted by row and partition, so that sums are the same each time and no group is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                v = v.values.to_numpy()
                if i != at:
                    if at is not None:
                        yield one(at, total)
                    at, total = i, np.zeros(len(v), v.dtype)
                total = total + v
        if at is not None:
            yield one(at, total)

    def one(i: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total.tolist()], kind)], ["i", "v"])

    element = parts.schema["v"].dataType.elementType
    kind = pa.list_(pa.int64() if isinstance(element, T.LongType) else pa.float64())
    return parts.repartition("i").sortWithinPartitions("i", "part").mapInArrow(run, T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", parts.schema["v"].dataType)])).orderBy("i").collect()


def _matrix(found: list) -> np.ndarray:
    return np.array([r.v for r in found])


def partial(rows: DataFrame, width: int, size: int, add: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> DataFrame:
    """(i, part, v): for each partition the sum of ``add`` (a matrix of ``size`` rows) over its batches of integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        kept("whitening", object)  # nothing, but what this worker kept for other operators goes
        total = None
        for batch in batches:
            if batch.num_rows:
                got = add(_numbers(batch.column(0), width))
                total = got if total is None else total + got
        if total is not None:
            part = [TaskContext.get().partitionId()] * size
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(part, pa.int32()), pa.array(total.tolist())], ["i", "part", "v"])

    return rows.select("v").mapInArrow(run, f"i int, part int, v array<{kind}>")


def spectra(rows: DataFrame, centred: Callable[[np.ndarray], np.ndarray], width: int, block: int) -> DataFrame:
    """(part, value, vector): the spectrum of each partition's centred rows, by rank-one updates. Rows are taken ``block`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        kept("whitening", object)
        spectrum, wait, n = (np.zeros(width), np.eye(width)), [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                wait.append(centred(_numbers(batch.column(0).slice(at, block), width)))
                n += len(wait[-1])
                if n >= block:
                    spectrum, wait, n = updated(*spectrum, np.concatenate(wait)), [], 0
        if wait:
            spectrum = updated(*spectrum, np.concatenate(wait))
        yield _sent(TaskContext.get().partitionId(), *spectrum)

    return rows.select("v").mapInArrow(run, "part int, value double, vector array<double>")


def _sent(part: int, values: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
    live = np.flatnonzero(values > 0)
    cols = [pa.array([part] * len(live), pa.int32()), pa.array(values[live]), pa.array(vectors.T[live].tolist(), pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(cols, ["part", "value", "vector"])


def combined(found: DataFrame, width: int, fan_in: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """One spectrum from those of all partitions: up to ``fan_in`` of them meet in a task, which updates with each scaled eigenvector of the next; again until one is left. A spectrum has
    at most as many rows as there are dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, spectrum, wait = None, None, []
        for batch in batches:
            for g, value, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if g != group:
                    if group is not None:
                        yield _sent(group, *updated(*spectrum, np.array(wait).reshape(-1, width)))
                    group, spectrum, wait = g, (np.zeros(width), np.eye(width)), []
                wait.append(np.sqrt(value) * vector.values.to_numpy())
                if len(wait) == width:
                    spectrum, wait = updated(*spectrum, np.array(wait)), []
        if group is not None:
            yield _sent(group, *updated(*spectrum, np.array(wait).reshape(-1, width)))

    found = written(found, "spectra")
    while (found.agg(F.max("part")).first()[0] or 0) > 0:
        met = found.withColumn("part", F.floor(F.col("part") / fan_in).cast("int"))
        found = written(met.repartition("part").sortWithinPartitions("part", "value").mapInArrow(run, found.schema), "spectra")
    rows = found.orderBy("value").collect()
    return np.array([r.value for r in rows]), np.array([r.vector for r in rows]).reshape(-1, width).T


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 32, block: int = 1024) -> DataFrame:
    """Whitened embeddings: id, n, deviation (decimal), whitened (array by component), explained (array) and identity_error.

    Entries c become x = floor(64 c) + 1000000. Components are the unit eigenvectors of x's covariance by falling eigenvalue, up to ``most``. Sums of x are exact. Each
    partition updates its spectrum with centred rows; spectra are combined; Rayleigh-Ritz refinement takes the covariance in the basis found, over all rows,
    and solves it, so that components have double precision. Only sums and matrices of the vectors' width come to the driver.

    Rows with a null vector, an empty one, or null or non-finite entries (2**40 in size or more counts as such) are dropped; so are those whose length is not the
    commonest (of equally common ones the longest). Repeated rows count each time, null ids stay; eigenvalues that are zero but for rounding have no component, so that
    one row, or rows that are all equal, give empty arrays. An empty table gives an empty table. Other columns are not used.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    lengths = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    width = lengths[0]["width"] if lengths else 1
    n = lengths[0]["count"] if lengths else 0
    rows = rows.where(F.size("v") == width)
    schema = T.StructType([T.StructField(id_col, vectors.schema[id_col].dataType)]).add("n", T.LongType()).add("deviation", T.DecimalType(38, 0))
    schema = schema.add("whitened", T.ArrayType(T.DoubleType())).add("explained", T.ArrayType(T.DoubleType())).add("identity_error", T.DoubleType())
    if not n:
        return spark.createDataFrame([], schema)
    halves = _matrix(summed(partial(rows, width, 3, lambda x: np.stack([(x >> HALF).sum(axis=0), (x & ((1 << HALF) - 1)).sum(axis=0), np.abs(x).max(axis=0)]), "bigint")))
    sums = [(int(a) << HALF) + int(b) for a, b in zip(halves[0], halves[1], strict=True)]
    wide = n * int(halves[2].max()) > 1 << 53  # the third row is a sum of largest entries, a bound of them all
    totals = np.array(sums, object if wide else np.int64)

    def scaled(x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        return n * x.astype(totals.dtype) - totals

    def centred(x: np.ndarray) -> np.ndarray:
        return scaled(x).astype(float) / n

    values, basis = combined(spectra(rows, centred, width, block), width)
    basis = np.linalg.qr(np.concatenate((basis[:, ::-1], np.eye(width)), axis=1))[0]  # all directions, those found first

    def products(turn: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        def add(x: np.ndarray) -> np.ndarray:
            y = centred(x) @ turn
            return y.T @ y

        return add

    gram = _matrix(summed(partial(rows, width, width, products(basis)))) / n
    values, turn = np.linalg.eigh((gram + gram.T) / 2)
    values, found = values[::-1], (basis @ turn)[:, ::-1]
    k = int(min(most, (values > width * 16 * EPS * max(values[0], EPS)).sum()))
    trace = float(values.sum())
    map_ = found[:, :k] / np.sqrt(values[:k])

    def with_ones(x: np.ndarray) -> np.ndarray:
        y = np.concatenate((centred(x) @ map_, np.ones((len(x), 1))), axis=1)
        return y.T @ y

    check = _matrix(summed(partial(rows, width, k + 1, with_ones))) / n
    error = float(np.abs(check[:k, :k] - np.outer(check[k, :k], check[k, :k]) - np.eye(k)).max(initial=0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                ids, v = batch.slice(at, block).columns
                x = _numbers(v, width)
                d = scaled(x)
                hi, lo = d >> 26, d & ((1 << 26) - 1)
                parts = ((hi * hi).sum(axis=1).tolist(), (hi * lo).sum(axis=1).tolist(), (lo * lo).sum(axis=1).tolist())
                square = [Decimal((a << 52) + (b << 27) + c) for a, b, c in zip(*parts, strict=True)]
                white = (d.astype(float) / n) @ map_
                yield pa.RecordBatch.from_arrays([ids, pa.array(square, pa.decimal128(38, 0)), pa.array(white.tolist(), pa.list_(pa.float64()))], [id_col, "deviation", "whitened"])

    out = T.StructType([schema[id_col], schema["deviation"], schema["whitened"]])
    explained: Column = F.array(*[F.lit(float(e / trace)) for e in values[:k]]).cast("array<double>")
    return rows.select("id", "v").mapInArrow(run, out).select(id_col, F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def op12(spark, sf_dir: str) -> DataFrame:
    """op12_whitening over the whole embeddings table: a row for each vector and component."""
    out = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    each = out.select("vec_id", "n", F.col("deviation").cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"), "explained", "identity_error")
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("at")).alias("explained"), "identity_error")
