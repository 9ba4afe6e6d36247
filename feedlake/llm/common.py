"""Helpers that the operators of this subpackage share: scratch tables and row identity."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local_dirs: dict[str, str] = {}
_model: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]) -> object:
    """The one model that a worker process keeps from task to task; that of another operator gives way, as Spark reuses workers for all."""
    if key not in _model:
        _model.clear()
        _model[key] = make()
    return _model[key]


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Only a local session without that setting (tests) gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = "file://" + tempfile.mkdtemp(prefix="spark-feedlake-")
    return _local_dirs[app]


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder."""
    return f"{scratch_dir(spark)}/feedlake-{uuid.uuid4().hex}/{tag}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends here, and a lost executor costs no rerun."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: The most bytes of a written table that is broadcast; in memory it is some times as large.
BROADCAST_BYTES = 16 << 20


def join_hint(table: DataFrame, broadcast_rows: int) -> str:
    """How to join with a written ``table``: a broadcast if it has at most ``broadcast_rows`` rows and ``BROADCAST_BYTES`` bytes of files, both looked up, else a merge join."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return "broadcast" if size <= BROADCAST_BYTES and table.count() <= broadcast_rows else "merge"


def release(spark: SparkSession) -> None:
    """Lets Spark clean the broadcasts and shuffle files of finished rounds: its cleaner follows the driver's garbage collection, which comes late on a small heap of long-lived plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """While it holds, batches for Python have at most ``rows`` rows: for actions on rows that carry whole sets or records."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def without_ids(docs: DataFrame, id_col: str, gone: DataFrame, broadcast_rows: int = 500_000) -> DataFrame:
    """``docs`` without the rows whose id is in the one column of ``gone``; rows with a null id stay.

    The ids are written and counted: a small table (see join_hint()) is broadcast, and ``docs`` are not shuffled; beyond that the join is a merge join.
    """
    name = fresh(docs, "_gone")
    gone = written(gone.toDF(name), "gone")
    return docs.join(gone.hint(join_hint(gone, broadcast_rows)), docs[id_col] == gone[name], "left_anti")


def fingerprint(text: Column | str) -> Column:
    """Tells rows with the same id but other text apart; with the id it identifies a row."""
    return F.xxhash64(text if isinstance(text, Column) else F.col(text))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    while name.lower() in [c.lower() for c in df.columns]:
        name += "_"
    return name


def wide_hash(value: Column) -> list[Column]:
    """Two chained 64-bit hashes as ``h1`` and ``h2``: one key of 128 bits, so that keys of a large corpus don't collide."""
    return [F.xxhash64(value).alias("h1"), F.xxhash64(F.lit(7), value).alias("h2")]


def salted(df: DataFrame, salts: int) -> DataFrame:
    """Each row once per salt, for the side of a join that has one row for each key."""
    return df.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))


def salt_of(salts: int, *cols: Column | str) -> Column:
    """The salt of a row on the skewed side."""
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into ``fold``; a null id counts as held out, so it never trains."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(True))


def hash_share(share: float, seed: int, *cols: Column | str) -> Column:
    """True for about ``share`` of all keys, the same ones on each run; neither sorts nor gathers rows."""
    return F.pmod(F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in cols], F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))


def keyed_text(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """The id as string ``i`` and the text as ``t`` for pandas, which would read longs with nulls as floats."""
    return [F.col(id_col).cast("string").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")]


def restored(out: DataFrame, docs: DataFrame, id_col: str) -> DataFrame:
    """``out`` with its string ``i`` as the id of ``docs`` again."""
    return out.withColumn("i", F.col("i").cast(docs.schema[id_col].dataType)).withColumnRenamed("i", id_col)
