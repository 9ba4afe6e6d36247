"""Secret scan with corpus-wide ownership frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fingerprint, salt_of, salted, wide_hash, written

# Kinds in their order, patterns, the group that holds the value and its least length.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: Maximal runs of key characters with a letter and a digit: only a candidate until the corpus says who owns it.
OPAQUE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"


def _found(text: Column, number: int, pattern: str, group: int) -> Column:
    """Matches of one kind as (kind, i, gap, width, value): what lies before a match gives its place after a running sum."""
    probe = {"hex": "[0-9a-f]{24,}", "access": "AKIA[A-Z0-9]{16,}"}.get(KINDS[number][0] if number < len(KINDS) else "", pattern)
    # Whole runs only are kept, so the bounded probe finds the same ones and skips the short runs in words.
    parts = F.arrays_zip(
        F.split(text, probe, -1).alias("a"),
        F.regexp_extract_all(text, F.lit(probe), F.lit(0)).alias("b"),
        F.regexp_extract_all(text, F.lit(probe), F.lit(group)).alias("c"),
    )
    rows = F.transform(
        F.filter(parts, lambda x: x["b"].isNotNull()),
        lambda x, i: F.struct(
            F.lit(number).alias("kind"), i.cast("int").alias("i"), F.length(x["a"]).alias("gap"), F.length(x["b"]).alias("width"), x["c"].alias("value")
        ),
    )
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,width:int,value:string>>")
    return F.when(text.rlike(probe), rows).otherwise(none)


def candidates(docs: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """Every candidate of every text: (_id, _fp, _repo, _owner, kind, start, end, value), base kinds first, then opaque runs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    every = [_found(text, k, pattern, group) for k, (_, pattern, group, _) in enumerate(KINDS)] + [_found(text, len(KINDS), OPAQUE, 0)]
    rows = docs.select(
        F.col(id_col).alias("_id"), fingerprint(text_col).alias("_fp"), F.col(repo_col).cast("string").alias("_repo"),
        F.col(owner_col).cast("string").alias("_owner"), F.explode(F.concat(*every)).alias("_m"),
    ).select("_id", "_fp", "_repo", "_owner", "_m.*").distinct()
    upto = Window.partitionBy("_id", "_fp", "_repo", "_owner", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("width")).over(upto)
    least = F.element_at(F.array(*[F.lit(n) for *_, n in KINDS], F.lit(20)), F.col("kind") + 1)
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("width")).where(F.length("value") >= least)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str = "doc_id", max_repos: int = 2, max_owners: int = 3, salts: int = 16) -> DataFrame:
    """One row for each row of ``docs``: counts of base kinds, all spans, and how many look live or copied.

    Candidate values are hashed and counted over the corpus by distinct repositories and owners. A value in at most
    ``max_repos`` repositories and ``max_owners`` owners is owner-specific and looks live; one in more is a copied
    example. Base spans always stay; an opaque run outside base spans becomes a span only if it is owner-specific.
    ``n_live`` and ``n_copied`` split all spans and the base spans by that verdict. Returns id, n_assign, n_access,
    n_hex, n_live, n_copied, base (array of kind:start:end) and spans (array). A null text is empty; a null repository
    or owner counts as none; repeated rows give equal rows; other columns of the input are not used.
    """
    found = candidates(docs, id_col, text_col, repo_col, owner_col).select("*", *wide_hash(F.col("value"))).drop("value", "gap", "width", "i")
    found = written(found, "candidates")  # two branches read it, and all expressions over all texts stand behind it
    # Distinct (hash, repository, owner) rows first: a value in a third of all documents is one row for each task and owner.
    freq = (
        found.groupBy("h1", "h2", "_repo", "_owner").agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("h1", "h2").agg(F.countDistinct("_repo").alias("_repos"), F.countDistinct("_owner").alias("_owners"))
        .select("h1", "h2", ((F.col("_repos") <= max_repos) & (F.col("_owners") <= max_owners)).alias("_live"))
    )
    judged = found.withColumn("_salt", salt_of(salts, "_id", "start")).join(salted(freq, salts).hint("merge"), ["h1", "h2", "_salt"])
    per_doc = judged.groupBy("_id", "_fp").agg(F.sort_array(F.collect_set(F.struct("start", "kind", "end", "_live"))).alias("_s"))

    names = F.array(*[F.lit(k) for k, *_ in KINDS], F.lit("opaque"))
    opaque = len(KINDS)
    base = F.filter("_s", lambda x: x["kind"] < opaque)
    # A base span overlaps an opaque run only if it starts before its end and ends after its start.
    clear = lambda x: ~F.exists("_b", lambda y: (y["start"] < x["end"]) & (y["end"] > x["start"]))
    every = F.filter("_s", lambda x: (x["kind"] < opaque) | (x["_live"] & clear(x)))
    shown = lambda col: F.transform(col, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"]))
    per_doc = per_doc.withColumn("_b", base).withColumn("_e", every).withColumnRenamed("_fp", "_fp2").withColumnRenamed("_id", "_id2")
    rows = docs.select(F.col(id_col).alias("_id"), fingerprint(text_col).alias("_fp"))
    # Only documents with candidates have a row; they may be too many to broadcast.
    out = rows.join(per_doc.hint("merge"), F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_fp") == F.col("_fp2")), "left")
    count = lambda col, test: F.coalesce(F.size(F.filter(col, test)), F.lit(0)).cast("long")
    # One parameter only: Spark gives the index of an element to a second one, even if that has a default.
    of_kind = lambda k: lambda x: x["kind"] == k
    empty = F.array().cast("array<string>")
    return out.select(
        F.col("_id").alias(id_col),
        *[count("_b", of_kind(k)).alias(f"n_{KINDS[k][0]}") for k in range(opaque)],
        count("_e", lambda x: x["_live"]).alias("n_live"),
        count("_b", lambda x: ~x["_live"]).alias("n_copied"),
        F.coalesce(shown("_b"), empty).alias("base"),
        F.coalesce(shown("_e"), empty).alias("spans"),
    )


def op4(spark, sf_dir: str) -> DataFrame:
    """op4_secret_scan over the whole documents table; the source is the repository and each document its own owner."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = scan_secrets(docs)
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.array_join("base", ","), 256).alias("base_sha256"),
        F.array_join("spans", ",").alias("spans"), "n_live", "n_copied",
    )
