"""Line de-duplication: explode normalised lines, hash, count documents per hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fingerprint, fresh, salt_of, salted, wide_hash

SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, min_chars: int = 10, salts: int = 16) -> DataFrame:
    """The positions of the lines to drop: one row (id, fp, drops) for each document that loses lines, ``drops`` ascending.

    A line's key is the line without ASCII white space at both ends, A-Z lower-cased. A key of at least ``min_chars``
    code points in at least ``min_docs`` documents stays in the smallest id that has it only. Only hashes, ids and
    positions are shuffled. Documents per hash are counted from distinct (hash, id) rows, which partial aggregation
    reduces before the second shuffle; the join that marks lines is salted, so a line in a third of all
    documents is spread over tasks.
    """
    keys = F.transform(_lines(F.translate(F.col(text_col), UPPER, LOWER)), lambda x: F.btrim(x, F.lit(SPACES)))
    marked = F.filter(
        F.transform(keys, lambda k, i: F.when(F.length(k) >= min_chars, F.struct(*wide_hash(k), i.cast("int").alias("pos")))),
        lambda x: x.isNotNull(),
    )
    occ = docs.select(F.col(id_col).alias("_id"), fingerprint(text_col).alias("_fp"), F.explode(marked).alias("_l")).select("_id", "_fp", "_l.*")
    found = (
        occ.select("h1", "h2", "_id").distinct()
        .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
        .where(F.col("_n") >= min_docs).select("h1", "h2", "_first")
    )
    hits = (
        occ.withColumn("_salt", salt_of(salts, "_id", "pos"))
        .join(salted(found, salts).hint("merge"), ["h1", "h2", "_salt"])
        .where(~F.col("_id").eqNullSafe(F.col("_first")))
    )
    return hits.groupBy("_id", "_fp").agg(F.sort_array(F.collect_set("pos")).alias("_drops"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, min_chars: int = 10, salts: int = 16) -> DataFrame:
    """``docs`` with repeated lines removed from ``text_col``, plus ``n_lines`` (before) and ``n_dropped``.

    Null and empty texts are one empty line and come back as the empty string. Rows that share an id count as one
    document. A row with a null id keeps a line only if no row with an id has it. Input columns named
    ``n_lines`` or ``n_dropped`` are replaced, other extra columns pass through; an empty table gives an empty table.
    The kept text is cut from whole runs of lines between dropped positions, so its cost is linear in the lines.
    """
    fp, pos, body = (fresh(docs, name) for name in ("_fp", "_drops", "_lines"))
    drops = repeated_lines(docs, id_col, text_col, min_docs, min_chars, salts)
    drops = drops.select(F.col("_id").alias(fresh(docs, "_doc")), F.col("_fp").alias(fp), F.col("_drops").alias(pos))
    same = docs[id_col].eqNullSafe(drops[drops.columns[0]]) & (fingerprint(docs[text_col]) == drops[fp])
    joined = docs.join(drops.hint("shuffle_hash"), same, "left").select(*[docs[c] for c in docs.columns], drops[pos])
    cut, lines = F.col(pos), F.col(body)
    n = F.size(lines)
    kept = F.flatten(F.transform(
        F.sequence(F.lit(0), F.size(cut)),
        lambda i: F.slice(
            lines,
            F.when(i == 0, F.lit(1)).otherwise(F.get(cut, i - 1) + 2),
            F.coalesce(F.get(cut, i), n) - F.when(i == 0, F.lit(0)).otherwise(F.get(cut, i - 1) + 1),
        ),
    ))
    return (
        joined.withColumn(body, _lines(F.col(text_col)))
        .withColumn("n_lines", n.cast("long"))
        .withColumn("n_dropped", F.coalesce(F.size(cut), F.lit(0)).cast("long"))
        .withColumn(text_col, F.when(cut.isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(kept, "\n")))
        .drop(body, pos)
    )


def op10(spark, sf_dir: str) -> DataFrame:
    """op10_line_dedup over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP10_SQL = """
WITH l AS (
  SELECT doc_id, t.pos, t.line,
         lower_key AS k
  FROM documents,
       LATERAL (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                       generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos) t,
       LATERAL (SELECT translate(trim(t.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key) x
), k AS (
  SELECT k, min(doc_id) AS first_doc FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
)
SELECT l.doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE k.k IS NOT NULL AND l.doc_id <> k.first_doc) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE k.k IS NULL OR l.doc_id = k.first_doc), '')) AS kept_sha256
FROM l LEFT JOIN k ON l.k = k.k
GROUP BY l.doc_id
"""
