"""Benchmark decontamination by template canonicalisation, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fingerprint, join_hint, written

#: Unit words (fixed values); a word of these after a number becomes a unit placeholder.
UNITS = tuple(("mm cm m km kg g mg lb oz inch inches foot feet yard yards mile miles meter meters metre metres liter liters litre litres gallon gallons "
               "second seconds minute minutes hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents "
               "degree degrees watt watts volt volts pound pounds ton tons kilometer kilometers kilogram kilograms gram grams").split())  # fmt: skip
#: Marks that stand before a name or a unit, for a decimal point and between the words of a name; no separator below holds them.
NAME, UNIT, POINT, INNER = "\u0002", "\u0003", "\u0004", "\u0006"
#: Capitalised words after a lower-case word or a comma are taken for one name: elsewhere a capital may only begin a sentence.
NAME_AT = r"([\p{Ll},;] )(?=\p{Lu}\p{Ll})"
NAME_RUN = r"([\p{Ll},;] )(\p{Lu}\p{Ll}[\p{L}'\u2019]*+(?: \p{Lu}\p{Ll}[\p{L}'\u2019]*+)*+)"
#: ASCII signs and the Unicode blocks of punctuation and spaces part tokens.
SEPARATORS = r"[\x00\x01\x05\x07-/:-@\[-`{-\x7f\u00a0-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u2000-\u206f\u3000-\u303f]+"
SLOT = f"^[0-9{NAME}{UNIT}]"
GAP = "\u0001"


def template_windows(table: DataFrame, id_col: str, text_col: str, width: int, least_words: int, units: tuple[str, ...] = UNITS, short: tuple[int, ...] = (), whole: bool = False) -> DataFrame:
    """One row (_id, _fp, h, pos, slots) for each window of ``width`` tokens of each text: the hash of its template, its place, and the values in its
    slots, null if it has none. A shorter text is one window. For each width of ``short`` there are verbatim windows as well, of texts of just that many tokens only if they are to be ``whole``.

    A window with fewer than ``least_words`` plain words would say nothing as a template; it is hashed as it is, so only verbatim copies match it.
    Most texts have neither numbers nor names: two searches find that out, and their windows are hashed as they are.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = table.select(F.col(id_col).alias("_id"), fingerprint(text_col).alias("_fp"), text.alias("_t"), text.rlike("[0-9]").alias("_d"))
    unit_at = r"(?i)([0-9] ?)(?=(?:" + "|".join(units) + r")\b)"
    numbered = F.regexp_replace(F.regexp_replace(F.col("_t"), unit_at, f"$1{UNIT}") if units else F.col("_t"), "(?<=[0-9])[.,](?=[0-9])", POINT)
    rows = rows.withColumn("_t", F.when(F.col("_d"), numbered).otherwise(F.col("_t")))
    rows = rows.withColumn("_n", F.col("_t").rlike(NAME_AT))
    # After the runs are marked, a capital behind a lower-case letter and a space is inside a run.
    named = F.regexp_replace(F.regexp_replace("_t", NAME_RUN, f"$1{NAME}$2"), r"(?<=\p{Ll}) (?=\p{Lu}\p{Ll})", INNER)
    named = F.when(F.col("_n"), named).otherwise(F.col("_t"))
    rows = rows.select("_id", "_fp", (F.col("_d") | F.col("_n")).alias("_slotted"), F.array_remove(F.split(F.lower(named), SEPARATORS, -1), "").alias("_tokens"))
    shape = lambda t: F.when(t.rlike("^[0-9]"), "<number>").when(t.startswith(NAME), "<name>").when(t.startswith(UNIT), "<unit>").otherwise(t)
    rows = rows.withColumn("_shapes", F.when(F.col("_slotted"), F.transform("_tokens", shape)).otherwise(F.col("_tokens")))
    starts = F.when(F.size("_tokens") > 0, F.sequence(F.lit(1), F.greatest(F.size("_tokens") - width + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    none = F.lit(None).cast("string")

    def cut(i: Column) -> Column:
        tokens = F.slice("_tokens", i, width)
        values = F.filter(tokens, lambda t: t.rlike(SLOT))
        return F.struct(tokens.alias("t"), values.alias("v"), i.alias("pos"))

    def hashed(w: Column) -> Column:
        plain = (F.size(w["v"]) == 0) | (F.size(w["v"]) > width - least_words)
        return F.struct(
            F.when(plain, F.xxhash64(w["t"])).otherwise(F.xxhash64(F.slice("_shapes", w["pos"], width))).alias("h"),
            w["pos"].alias("pos"), F.when(~plain, F.array_join(w["v"], GAP)).alias("slots"),
        )

    slotted = F.transform(F.transform(starts, cut), hashed)
    as_is = F.transform(starts, lambda i: F.struct(F.xxhash64(F.slice("_tokens", i, width)).alias("h"), i.alias("pos"), none.alias("slots")))
    windows = F.when(F.col("_slotted"), slotted).otherwise(as_is)
    if short:
        bare = F.transform("_tokens", lambda t: F.translate(t, NAME + UNIT, ""))

        def verbatim(k: int) -> Column:
            n = F.size("_tokens")
            places = F.when(n == k if whole else n >= k, F.sequence(F.lit(1), n - k + 1)).otherwise(F.array().cast("array<int>"))
            return F.transform(places, lambda i: F.struct(F.xxhash64(F.slice("_bare", i, k)).alias("h"), i.alias("pos"), none.alias("slots")))

        rows, windows = rows.withColumn("_bare", bare), F.concat(windows, *[verbatim(k) for k in short])
    return rows.select("_id", "_fp", F.explode(windows).alias("_w")).select("_id", "_fp", "_w.*")


def short_widths(benchmark: DataFrame, text_col: str, width: int, least_words: int) -> tuple[int, ...]:
    """The widths of verbatim windows that ``benchmark`` asks for: from ``least_words`` to less than ``width``, if any item may have so few tokens (a name of several words, or a number, is one), else none."""
    n = F.size(F.array_remove(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), SEPARATORS, -1), ""))
    return () if benchmark.where(n.between(least_words, 2 * width)).isEmpty() else tuple(range(least_words, width))


def item_windows(benchmark: DataFrame, item_col: str, text_col: str, width: int, least_words: int, units: tuple[str, ...], short: tuple[int, ...] = ()) -> DataFrame:
    """(item, form, h, own): the windows of each item as it stands (form 0) and in lower case (1), where names are plain words, with all
    places and slot values of each as a sorted array ``own``."""
    text = F.col(text_col).alias("_text")
    forms = benchmark.select(F.struct(F.col(item_col).alias("item"), F.lit(0).alias("form")).alias("_key"), text)
    forms = forms.unionByName(benchmark.select(F.struct(F.col(item_col).alias("item"), F.lit(1).alias("form")).alias("_key"), F.lower(text_col).alias("_text")).where(F.col(text_col).rlike(NAME_AT)))
    windows = template_windows(forms, "_key", "_text", width, least_words, units, short, True)
    return windows.groupBy("_id.item", "_id.form", "h").agg(F.sort_array(F.collect_set(F.struct("pos", "slots"))).alias("own"))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    width: int = 5, least_words: int = 3, coverage: float = 0.5, broadcast_rows: int = 500_000, units: tuple[str, ...] = UNITS,
) -> DataFrame:
    """Pairs of a document and a benchmark item of which it holds at least ``coverage`` of the template windows.

    Numbers, units and names become typed placeholders, so a question with other numbers or names still matches; neighbouring capitalised words are
    one name. Windows of ``width`` template tokens are hash-joined. A matched window counts if it has the item's own values, or if the occurrence it
    belongs to (the windows with the same distance between their places in document and item) is consistent: each of the item's values maps to one
    value of the document there. So several variants of an item in one document are told apart. Returns id, fp
    (fingerprint of the text), item, n_windows (distinct windows of the item), n_matched, coverage and reparameterised
    (it is found only with other values).

    Null and empty texts have no windows; a text of fewer than ``width`` tokens is one window. An item of fewer has a verbatim window of its own width as well, so it is found inside texts, from ``least_words``
    tokens on; one of fewer tokens still, which any text may hold by chance, where a document consists of it.
    A name that begins a sentence counts as a plain word. Rows with a null id or null item id are matched and returned with the null; repeated rows count once;
    extra columns are not used; an empty table gives no pairs. The item windows are written out and counted: up to
    ``broadcast_rows`` they are broadcast, beyond that the join is a merge join, which Spark splits where it is skewed.
    """
    short = short_widths(benchmark, item_text_col, width, least_words)
    items = written(item_windows(benchmark, item_col, item_text_col, width, least_words, units, short), "item-windows")
    sizes = items.groupBy("item", "form").agg(F.count(F.lit(1)).alias("n_windows"))
    how = join_hint(items, broadcast_rows)
    hits = template_windows(docs, id_col, text_col, width, least_words, units, short).join(items.hint(how), "h")
    hits = hits.select("_id", "_fp", "item", "form", "h", "pos", "slots", F.explode("own").alias("o")).where(F.col("slots").isNull() == F.col("o.slots").isNull())
    # The place matters only where there are slots. Written out, because three branches read it and the windows of all documents stand behind it.
    at = F.when(F.col("slots").isNotNull(), F.col("pos") - F.col("o.pos")).alias("at")
    hits = written(hits.select("_id", "_fp", "item", "form", "h", at, F.col("o.slots").alias("own"), "slots", F.col("slots").eqNullSafe(F.col("o.slots")).alias("same")).distinct(), "hits")
    pair, occurrence = ["_id", "_fp", "item", "form"], ["_id", "_fp", "item", "form", "at"]
    values = F.explode(F.arrays_zip(F.split("own", GAP).alias("a"), F.split("slots", GAP).alias("b"))).alias("v")
    steady = (
        hits.where(F.col("at").isNotNull()).select(*occurrence, values)
        .groupBy(*occurrence, "v.a").agg(F.countDistinct("v.b").alias("n"))
        .groupBy(*occurrence).agg((F.max("n") == 1).alias("steady"))
    )
    on = lambda a, b, columns: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns]
    judged = hits.alias("h").join(steady.alias("s").hint("merge"), on("h", "s", occurrence), "left")
    counted = F.countDistinct(F.when(F.col("h.same") | F.coalesce("s.steady", F.lit(False)), F.col("h.h")))
    judged = judged.groupBy(*[F.col(f"h.{c}").alias(c) for c in pair]).agg(F.countDistinct(F.when(F.col("h.same"), F.col("h.h"))).alias("exact"), counted.alias("matched"))
    judged = judged.alias("j").join(sizes.alias("z").hint(how), on("j", "z", ["item", "form"])).where(F.col("matched") >= coverage * F.col("n_windows"))
    best = F.max(F.struct((F.col("matched") / F.col("n_windows")).alias("coverage"), F.col("exact") / F.col("n_windows"), "n_windows", F.col("matched").alias("n_matched"))).alias("b")
    judged = judged.groupBy("_id", "_fp", F.col("j.item").alias("_item")).agg(best, F.max(F.col("exact") / F.col("n_windows")).alias("exact"))
    return judged.select(
        F.col("_id").alias(id_col), F.col("_fp").alias("fp"), F.col("_item").alias(item_col), "b.n_windows", "b.n_matched", "b.coverage", (F.col("exact") < coverage).alias("reparameterised")
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 500_000, **options) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, columns unchanged; options as for contaminated().

    The rows to drop are written and counted: up to ``broadcast_rows`` they are broadcast, and the texts are not shuffled; beyond that the join is a merge join.
    """
    bad = contaminated(docs, benchmark, id_col, text_col, broadcast_rows=broadcast_rows, **options).select(F.col(id_col).alias("_bad_id"), F.col("fp").alias("_bad_fp"))
    bad = written(bad.distinct(), "contaminated")
    same = docs[id_col].eqNullSafe(bad["_bad_id"]) & (fingerprint(docs[text_col]) == bad["_bad_fp"])
    return docs.join(bad.hint(join_hint(bad, broadcast_rows)), same, "left_anti")


def op9(spark, sf_dir: str) -> DataFrame:
    """op9_decontamination: all documents that hold a benchmark item, with the item and how much of it."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs.select("doc_id", "text"), items).drop("fp")
