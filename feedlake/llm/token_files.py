"""Token ids as binary files: blocks of ids in bit or byte planes, each compressed, with an index of blocks and documents behind them."""

from __future__ import annotations

import os
import struct
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, kept, scratch_path, written

#: The trailer: bytes of the block index and of the document index, planes of an id (4: bytes, 32: bits), magic.
TRAILER, MAGIC, LEVEL = struct.Struct("<QQI8s"), b"IDPLANES", 3
#: Characters that are split at once; runs and characters that the encoder keeps, in each of two generations.
SLICE, KEPT_RUNS, KEPT_CHARS = 1 << 20, 400_000, 8_000_000


#: A sign behind a letter or a number at the end of a run: there a pre-token ends as well.
ENDING = frozenset(".,;:!?")


class Encoder:
    """A tokenizer of the tokenizers library whose pre-tokens are letters, numbers or other signs, never white space: runs between blanks and line ends are encoded once and looked up.

    Runs that are new are encoded many at a time, parted by a control sign with an id of its own.
    """

    PART = "\x01"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.runs, self.older = {"": b""}, {}
        self.part = self.tokenizer.encode(self.PART, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out, some, size = [], [], 0
        for text in texts:
            if len(text) > 2 * SLICE:
                out += self._looked_up(some) + [b"".join(chain.from_iterable(self._looked_up([x]) for x in _sliced(text)))]
                some, size = [], 0
                continue
            some.append(text)
            size += len(text)
            if size > SLICE:
                out += self._looked_up(some)
                some, size = [], 0
        return out + self._looked_up(some)

    def _looked_up(self, texts: list[str]) -> list[bytes]:
        # A-Z can be lower-cased here where no other letter is, but not in what may be a special token.
        split = [(t.lower() if t.isascii() and "<|" not in t else t).replace("\n", " ").split(" ") for t in texts]
        new, ended = set(chain.from_iterable(split)) - self.runs.keys(), []
        for run in [r for r in new if r[-1] in ENDING and r[-2:-1].isalnum()]:
            if run not in self.older:
                ended.append(run)
                new.discard(run)
                new.update(x for x in (run[:-1], run[-1]) if x not in self.runs)
        unseen = []
        for run in new:
            got = self.older.get(run)
            if got is None:
                unseen.append(run)
            else:
                self.runs[run] = got
        alone = [r for r in unseen if self.PART in r] if len(self.part) == 1 else unseen
        self.runs.update((r, array("I", e.ids).tobytes()) for r, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True))
        joined = [r for r in unseen if self.PART not in r] if len(self.part) == 1 else []
        for a in range(0, len(joined), 250):
            some = joined[a : a + 250]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {self.PART} ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            data, start = ids.tobytes(), 0
            ends = (4 * np.flatnonzero(ids == self.part[0])).tolist()
            for run, end in zip(some, [*ends, len(data)], strict=True):
                self.runs[run] = data[start:end]
                start = end + 4
        for run in ended:
            self.runs[run] = self.runs[run[:-1]] + self.runs[run[-1]]
        out = [b"".join(map(self.runs.__getitem__, runs)) for runs in split]
        if len(self.runs) > KEPT_RUNS or sum(map(len, unseen)) > KEPT_CHARS:
            self.older = {r: x for r, x in self.runs.items() if len(r) < 60}
            self.runs = {"": b""}
        return out


def _sliced(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        end = text.find(" ", at + SLICE)
        end = len(text) if end < 0 else end + 1
        yield text[at:end]
        at = end


def to_planes(ids: np.ndarray, planes: int) -> list[bytes]:
    """A block's ids as 4 byte planes or 32 bit planes, low ones first, each compressed; a plane of zeros is empty."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if planes == 32:
        raw = np.packbits(np.unpackbits(raw, axis=1, bitorder="little"), axis=0, bitorder="little")
    zip_ = zstandard.ZstdCompressor(level=LEVEL)
    return [zip_.compress(np.ascontiguousarray(p).tobytes()) if p.any() else b"" for p in raw.T]


def from_planes(parts: list[bytes], n: int) -> np.ndarray:
    """The ``n`` ids of a block again."""
    bits = len(parts) == 32
    size = -(-n // 8) if bits else n
    unzip = zstandard.ZstdDecompressor()
    rows = [np.frombuffer(unzip.decompress(p, max_output_size=size), np.uint8) if p else np.zeros(size, np.uint8) for p in parts]
    raw = np.stack(rows, axis=1)
    if bits:
        raw = np.packbits(np.unpackbits(raw, axis=0, count=n, bitorder="little"), axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").ravel()


def _ipc(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


class TokenFile:
    """A file under way: blocks are written as they fill, the indexes at the end; one block and the lengths of the file's documents are held."""

    def __init__(self, out, planes: int, block_ids: int, id_type: pa.DataType):
        self.out, self.planes, self.block_ids, self.id_type = out, planes, block_ids, id_type
        self.keys, self.sizes, self.blocks = [], [], []
        self.held, self.open, self.n_ids, self.at = [], 0, 0, 0

    def add(self, key: object, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.sizes.append(len(ids))
        self.held.append(ids)
        self.open += len(ids)
        self.n_ids += len(ids)
        if self.open >= self.block_ids:
            rest = np.concatenate(self.held)
            full = len(rest) - len(rest) % self.block_ids
            for a in range(0, full, self.block_ids):
                self._block(rest[a : a + self.block_ids])
            self.held, self.open = [rest[full:]], len(rest) - full

    def _block(self, ids: np.ndarray) -> None:
        parts = to_planes(ids, self.planes)
        self.blocks.append({"offset": self.at, "n_ids": len(ids), "plane_bytes": [len(p) for p in parts]})
        data = b"".join(parts)
        self.out.write(data)
        self.at += len(data)

    def finish(self) -> None:
        if self.open:
            self._block(np.concatenate(self.held))
        kind = pa.schema([("offset", pa.int64()), ("n_ids", pa.int64()), ("plane_bytes", pa.list_(pa.int32()))])
        blocks = _ipc(pa.Table.from_pylist(self.blocks, kind))
        docs = _ipc(pa.table({"id": pa.array(self.keys, self.id_type), "n_tokens": pa.array(self.sizes, pa.int64())}))
        self.out.write(blocks + docs + TRAILER.pack(len(blocks), len(docs), self.planes, MAGIC))


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def file_index(f) -> tuple[pa.Table, pa.Table]:
    """The block index and the document index of an open file."""
    size = f.size()
    n_blocks, n_docs, _, magic = TRAILER.unpack(f.read_at(TRAILER.size, size - TRAILER.size))
    if magic != MAGIC:
        raise ValueError("no token file")
    data = f.read_at(n_blocks + n_docs, size - TRAILER.size - n_blocks - n_docs)
    return tuple(pa.ipc.open_stream(x).read_all() for x in (data[:n_blocks], data[n_blocks:]))


def _read_block(f, block: dict) -> np.ndarray:
    data, parts, at = f.read_at(sum(block["plane_bytes"]), block["offset"]), [], 0
    for n in block["plane_bytes"]:
        parts.append(data[at : at + n])
        at += n
    return from_planes(parts, block["n_ids"])


def read_span(uri: str, start: int, n: int) -> np.ndarray:
    """``n`` ids from place ``start`` of one file: only the blocks that hold them are read."""
    store, path = _store(uri)
    with store.open_input_file(path) as f:
        out, first = [np.zeros(0, "<u4")], 0
        for block in file_index(f)[0].to_pylist():
            last = first + block["n_ids"]
            if first < start + n and last > start:
                out.append(_read_block(f, block)[max(0, start - first) : start + n - first])
            first = last
        return np.concatenate(out)


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1, planes: str = "byte",
                      block_ids: int = 65_536, file_ids: int = 1 << 25, file_docs: int = 1 << 20) -> DataFrame:
    """Encodes whole texts in ascending order of id and writes them to files in ``folder`` (a URI that all executors reach); returns the written file table.

    Texts are dealt to ranges of ids in one shuffle and sorted there by id (nulls first), then text; each range is encoded where it lies and streamed to files of up to ``file_ids`` ids
    or ``file_docs`` documents. File table: path, first (smallest id), number (of the file in its range), n_docs, n_ids. Files are named by task attempt and
    count only if the table lists them, so a lost executor leaves at most unlisted files. Rows that share an id lie in one range.
    """
    kind = docs.schema[id_col].dataType
    n_planes = {"byte": 4, "bit": 32}[planes]
    end = b"" if end_id is None else end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(("tokenizer", tokenizer_path), lambda: Encoder(tokenizer_path))
        context, (store, base) = TaskContext.get(), _store(folder)
        store.create_dir(base, recursive=True)
        file, number, found = None, 0, []

        def closed() -> dict:
            file.finish()
            file.out.close()
            store.move(f"{base}/{name}.tmp", f"{base}/{name}")
            return {"path": f"{folder}/{name}", "first": file.keys[0], "number": number, "n_docs": len(file.keys), "n_ids": file.n_ids}

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                keys, texts = batch.slice(at, 500).columns
                for key, ids in zip(keys.to_pylist(), encoder.encode(texts.to_pylist()), strict=True):
                    if file is None:
                        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{number:04d}.ids"
                        file = TokenFile(store.open_output_stream(f"{base}/{name}.tmp"), n_planes, block_ids, keys.type)
                    file.add(key, np.frombuffer(ids + end, "<u4"))
                    if file.n_ids >= file_ids or len(file.keys) >= file_docs:
                        found.append(closed())
                        file, number = None, number + 1
        if file is not None:
            found.append(closed())
        cols = [pa.array([x["path"] for x in found], pa.string()), pa.array([x["first"] for x in found], keys.type if found else pa.null())]
        if found:
            yield pa.RecordBatch.from_arrays(cols + [pa.array([x[c] for x in found], pa.int64()) for c in names[2:]], names)

    names = ["path", "first", "number", "n_docs", "n_ids"]
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("first", kind), *[T.StructField(n, T.LongType()) for n in names[2:]]])
    rows = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return written(rows.repartitionByRange(F.asc_nulls_first("i")).sortWithinPartitions(F.asc_nulls_first("i"), "t").mapInArrow(run, schema), "token-files")


def read_token_files(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """All documents of the listed files: id, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids`` (binary, little-endian unsigned 32-bit integers).

    The places of files come from a running sum over the file table, one row for each file; files are read side by side, block by block.
    """
    before = Window.orderBy(F.asc_nulls_first("first"), "number").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("begin"))
    kind = files.schema["first"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, begin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, path = _store(uri)
                with store.open_input_file(path) as f:
                    yield from documents(f, begin)

    def documents(f, begin: int) -> Iterator[pa.RecordBatch]:
        blocks, docs = file_index(f)
        blocks, held, at = iter(blocks.to_pylist()), np.zeros(0, "<u4"), 0
        for part in docs.combine_chunks().to_batches(max_chunksize=500):
            sizes, out, begins = part.column(1).to_pylist(), [], []
            for n in sizes:
                if len(held) - at < n:
                    more, size = [held[at:]], len(held) - at
                    while size < n:
                        more.append(_read_block(f, next(blocks)))
                        size += len(more[-1])
                    held, at = np.concatenate(more), 0
                out.append(held[at : at + n].tobytes())
                begins.append(begin)
                at, begin = at + n, begin + n
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(begins, pa.int64()), part.column(1), pa.array(out, pa.binary())], names)

    names = [id_col, "start", "n_tokens", "ids"]
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    # The rows are tiny, so their number would not spread the files: a fixed number of partitions does.
    return placed.repartition(max(1, min(files.count(), 8192))).mapInArrow(run, schema)


def token_round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", planes: str = "byte") -> DataFrame:
    """Writes the ids of every text, each with the end id 1, to files in the shared folder and reads them back: id, start, n_tokens, ids.

    A null text is empty and has the end id alone; rows with a null id come first; rows that share an id follow each other in the order of their texts, each with
    a place of its own; an empty table writes no file. Ids are integers or of any type with an order; extra columns are not used. The tokenizer file must exist on every executor.
    """
    id_name = fresh(docs.select(text_col), id_col)
    folder = scratch_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, tokenizer_path, folder, id_col, text_col, planes=planes), id_name)


def op13(spark, sf_dir: str) -> DataFrame:
    """op13_token_files over the whole documents table with the public 49k word vocabulary."""
    import public_tokenizers

    out = token_round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
