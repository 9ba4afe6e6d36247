"""Training-data pipeline: quality, line de-duplication, near duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the last return the columns
of documents. The language-model operators come from ``feedlake.llm``.

Defined cases, for every stage: an empty table gives an empty table; extra columns are dropped, whatever their names; repeated rows are
treated alike, and rows with a null id are never dropped for being like others. What a null or empty text gives is stated at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.llm.bpe import encode_decode
from feedlake.llm.common import held_out, written
from feedlake.llm.compression import fit_quality, score_quality
from feedlake.llm.jaccard import Setting, one_of_each
from feedlake.llm.line_dedup import dedup_lines
from feedlake.llm.templates import without_contaminated

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the compression classifier scores 0.3 or more; null and empty texts have a score as well. Rows with a null id are scored, but never train."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), train=~held_out("doc_id", 5, 0))
    return score_quality(docs, model, "doc_id", "text", *COLUMNS).where(F.col("score") >= 0.3).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines but for their first document; n_chars follows the text.

    A document all of whose words were in lines of earlier documents is a copy and goes. Null texts become empty ones; those and other texts without words that lose no line stay.
    """
    emptied = (F.col("n_dropped") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return dedup_lines(docs.select(*COLUMNS)).where(~emptied).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that with the smallest id: five-word shingles, similarity 0.8 or more. Texts without words are like no other and stay."""
    return one_of_each(docs.select(*COLUMNS), setting=Setting(k=5, num=80, den=100)).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item. Null and empty texts hold none and stay."""
    return without_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids (little-endian unsigned 32-bit integers) and the text that they decode to; a null text is empty."""
    import public_tokenizers

    out = encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", "ids", F.col("decoded").alias("text"))


STAGES = [("quality", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("tokens", tokens)]

#: SQL can express neither the classifier nor the tokeniser; tests/llm/test_pipeline.py tests the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
