"""Pieces of texts as 64-bit hashes, and how many texts hold each piece.

Texts are dealt to batches. A batch sends the leading ``bits`` of its hashes as sorted lists of distinct values, one for each range of values (a part); a part adds the
lists of all batches up and answers each batch with the counts in the order of its list. So a piece travels as some 2 bytes without the text it comes from, and
the batch finds it again from its own texts. Different pieces with the same leading bits are counted together: a count is never too low.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.sources.scratch import written

U = np.uint64
#: UTF-16 units of text in a batch, and pieces in a part, about; bits of a value beyond those that number all pieces (one in 32 is held to be in a second text by chance).
BATCH, SPARE_BITS = 1 << 21, 5
#: Counts end here.
MOST = (1 << 16) - 1
#: Bits of a bitmap of pieces, 8 MB.
MARKS = 1 << 26


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0x7FB5D329728EA185)
    h = (h ^ (h >> U(27))) * U(0x81DADEF4BC2DD44D)
    return h ^ (h >> U(33))


def _units(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2").astype(U)


def piece_hashes(units: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct hashes of the pieces of ``width`` units; a piece is hashed from its two halves, so all take about log2(width) steps."""
    if len(units) < width:
        return np.empty(0, U)
    one = h = _mix(units + U(1))
    size = 1
    for bit in bin(width)[3:]:
        h, size = _mix(h[:-size] * U(0x9E3779B97F4A7C15) + h[size:]), 2 * size
        if bit == "1":
            h, size = _mix(h[:-1] * U(0x9E3779B97F4A7C15) + one[size:]), size + 1
    h.sort()
    return h[np.append(True, h[1:] != h[:-1])]


def packed(values: np.ndarray, bits: int) -> bytes:
    """Sorted distinct values below 2**bits: the low bits as they are, the others as the gaps of a bitmap (Elias-Fano)."""
    n = len(values)
    low = min(bits, max(0, bits - n.bit_length() + 1))
    lows = np.empty((n, low), np.uint8)
    for j in range(low):
        lows[:, j] = (values >> U(j)) & U(1)
    highs = np.zeros(n + (1 << (bits - low)), np.uint8)
    highs[(values >> U(low)).astype(np.int64) + np.arange(n)] = 1
    return np.packbits(lows).tobytes() + np.packbits(highs).tobytes()


def unpacked(data: bytes, n: int, bits: int) -> np.ndarray:
    low = min(bits, max(0, bits - n.bit_length() + 1))
    raw, cut = np.frombuffer(data, np.uint8), (n * low + 7) // 8
    lows = np.unpackbits(raw[:cut], count=n * low).reshape(n, low)
    values = (np.flatnonzero(np.unpackbits(raw[cut:])) - np.arange(n)).astype(U) << U(low)
    for j in range(low):
        values |= lows[:, j].astype(U) << U(j)
    return values


def _counts(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint16)


@dataclass(frozen=True)
class Pieces:
    """How the pieces of texts with ``units`` UTF-16 units in all are counted: ``bits`` of a hash are its value, the first ``part_bits`` of them its part."""

    width: int
    batches: int
    part_bits: int
    bits: int

    @staticmethod
    def of(units: int, width: int) -> Pieces:
        batches = max(1, -(-units // BATCH))
        parts = (batches - 1).bit_length()
        return Pieces(width, batches, parts, max(parts + 1, min(64, units.bit_length() + SPARE_BITS)))

    def _batch(self, texts: pd.DataFrame, ids: pd.Series) -> tuple[list[tuple[str, int, np.ndarray]], np.ndarray, np.ndarray]:
        """The texts of ``ids`` with their lengths and pieces; the distinct values of all, in order, with the number of texts."""
        kept = texts[texts["id"].isin(set(ids))].sort_values(["id", "plain"]).drop_duplicates("id")
        found = [(i, len(u), piece_hashes(u, self.width)) for i, u in zip(kept["id"], map(_units, kept["plain"]), strict=True)]
        values, counts = np.unique(np.concatenate([np.empty(0, U), *(h for _, _, h in found)]) >> U(64 - self.bits), return_counts=True)
        return found, values, counts

    def _send(self, key: tuple, texts: pd.DataFrame, firsts: pd.DataFrame) -> pd.DataFrame:
        _, values, counts = self._batch(texts, firsts["id"])
        bits = self.bits - self.part_bits
        parts = (values >> U(bits)).astype(np.int64)
        edges = np.flatnonzero(np.diff(parts, prepend=-1, append=-1)) if len(parts) else np.zeros(1, np.int64)
        counts = np.minimum(counts, MOST).astype(np.uint16)
        values &= U((1 << bits) - 1)
        rows = [(int(parts[a]), int(key[0]), int(b - a), packed(values[a:b], bits), zlib.compress(counts[a:b].tobytes(), 1)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pd.DataFrame(rows, columns=["part", "batch", "n", "data", "counts"])

    def _answer(self, lists: pd.DataFrame) -> pd.DataFrame:
        each = [unpacked(d, n, self.bits - self.part_bits) for d, n in zip(lists["data"], lists["n"], strict=True)]
        _, at = np.unique(np.concatenate(each), return_inverse=True)
        totals = np.minimum(np.bincount(at, weights=np.concatenate([_counts(c) for c in lists["counts"]])), MOST).astype(np.uint16)
        ends = np.cumsum(lists["n"].to_numpy())
        answers = [zlib.compress(totals[at[e - n : e]].tobytes(), 1) for e, n in zip(ends, lists["n"], strict=True)]
        return pd.DataFrame({"batch": lists["batch"], "part": lists["part"], "counts": answers})

    def _place(self, hot: int, texts: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        ids, answers = told[told["part"] < 0]["id"], told[told["part"] >= 0].sort_values("part")
        found, values, _ = self._batch(texts, ids)
        counts = np.concatenate([np.empty(0, np.uint16), *map(_counts, answers["counts"])])
        if len(counts) != len(values):
            raise ValueError(f"{len(values)} values, {len(counts)} counts")
        rows = []
        for i, n, h in found:
            df = counts[np.searchsorted(values, h >> U(64 - self.bits))]
            shared = np.flatnonzero(df > 1)
            if len(shared):
                shared = shared[np.argsort(df[shared], kind="stable")]
                rows.append((i, n, len(h), int((df[shared] <= hot).sum()), h[shared].view(np.int64)))
        return pd.DataFrame(rows, columns=["id", "n", "k", "cold", "pieces"])

    def placed(self, texts: DataFrame, firsts: DataFrame, hot: int) -> DataFrame:
        """(id, n, k, cold, pieces) of the texts (id, plain) whose id is in ``firsts``: the units, the number of distinct pieces, and those pieces that another text
        may hold as well, rare ones first, then by hash; the first ``cold`` of them are in ``hot`` texts at most. Texts without such pieces are left out."""
        batch = F.pmod(F.xxhash64("id"), F.lit(self.batches)).cast("int").alias("batch")
        texts, firsts = texts.select("id", "plain", batch).groupBy("batch"), firsts.select("id", batch)
        sent = texts.cogroup(firsts.groupBy("batch")).applyInPandas(lambda key, a, b: self._send(key, a, b), "part int, batch int, n int, data binary, counts binary")
        answers = sent.groupBy("part").applyInPandas(lambda lists: self._answer(lists), "batch int, part int, counts binary")
        told = firsts.select("batch", F.lit(-1).alias("part"), "id", F.lit(None).cast("binary").alias("counts")).unionByName(answers.select("batch", "part", F.lit(None).cast("string").alias("id"), "counts"))
        return texts.cogroup(told.groupBy("batch")).applyInPandas(lambda a, b: self._place(hot, a, b), "id string, n int, k int, cold int, pieces array<bigint>")


def held(sets: DataFrame, places: DataFrame) -> DataFrame:
    """A row (id, t, at) with all other columns for each of the ``pieces`` of ``sets``, t at place ``at`` from 0, that is a t of ``places``: by a bitmap of ``MARKS``
    bits that tasks combine, a fixed size, however many rows. A piece that it takes for another one only costs work. Arrays go through tasks as they are; they are not copied to rows."""
    at = F.col("t").bitwiseAND(MARKS - 1) + 1
    maps = places.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("m"))
    marks = np.zeros(MARKS // 8, np.uint8)
    for r in maps.collect():
        marks[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(r.m, np.uint8)
    sent, last, others = sets.sparkSession.sparkContext.broadcast(marks), MARKS - 1, [c for c in sets.columns if c != "pieces"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            pieces = batch.column("pieces")
            starts, t = pieces.offsets.to_numpy(), pieces.values.to_numpy()
            at = t & last
            hits = np.flatnonzero((sent.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            hits = hits[(hits >= starts[0]) & (hits < starts[-1])]
            row = np.searchsorted(starts, hits, "right") - 1
            kept = [batch.column(c).take(pa.array(row)) for c in others]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(t[hits]), pa.array((hits - starts[row]).astype(np.int32))], names=[*others, "t", "at"])

    return sets.mapInArrow(rows, ", ".join(f"{c} {dict(sets.dtypes)[c]}" for c in others) + ", t bigint, at int")


def common_pieces(pairs: DataFrame, texts: DataFrame, width: int, block: int = 64) -> DataFrame:
    """(ida, idb, m, k) of ``pairs`` (ida, idb), a written table: the pieces that both texts (id, plain) hold, and those of the one that has fewer.

    Pairs meet in cells: ids with the same least partner are dealt to blocks of about ``block``, and a cell has the pairs of two blocks. So a text goes to as many
    cells as its group has blocks, not to as many as it has partners.
    """
    ends = pairs.select(F.col("ida").alias("id"), F.col("idb").alias("other")).unionAll(pairs.select(F.col("idb").alias("id"), F.col("ida").alias("other")))
    homes = ends.groupBy("id").agg(F.min(F.least("id", "other")).alias("home"))
    blocks = homes.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    spots = written(homes.join(blocks.hint("merge"), "home").select("id", F.struct("home", F.pmod(F.xxhash64("id"), "blocks").alias("block")).alias("spot")), "spots")
    spot = lambda end: spots.select(F.col("id").alias(f"id{end}"), F.col("spot").alias(end)).hint("merge")
    cells = pairs.join(spot("a"), "ida").join(spot("b"), "idb").select("ida", "idb", F.xxhash64(F.least("a", "b"), F.greatest("a", "b")).alias("cell"))
    cells = written(cells, "cells")
    members = written(cells.select("cell", F.col("ida").alias("id")).unionAll(cells.select("cell", F.col("idb").alias("id"))).distinct(), "members")
    sent = members.join(texts.select("id", "plain"), "id").groupBy("cell")

    def counted(met: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        texts = texts.sort_values(["id", "plain"]).drop_duplicates("id")
        sets = {i: piece_hashes(_units(t), width) for i, t in zip(texts["id"], texts["plain"], strict=True)}
        both = [(a, b, len(np.intersect1d(sets[a], sets[b], assume_unique=True)), min(len(sets[a]), len(sets[b]))) for a, b in zip(met["ida"], met["idb"], strict=True)]
        return pd.DataFrame(both, columns=["ida", "idb", "m", "k"])

    return cells.groupBy("cell").cogroup(sent).applyInPandas(counted, "ida string, idb string, m int, k int")
