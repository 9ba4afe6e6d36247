"""Declarative constraints on nested rows, compiled to columns; rows that break one go to a quarantine table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.sources.scratch import written

Check = tuple[str, Callable[[Column], Column]]


@dataclass(frozen=True)
class Text:
    """A string: its length after trimming, if ``trimmed``, a pattern for the whole of it, or the values it may have. Null only if ``null``."""

    least: int = 0
    most: int | None = None
    pattern: str | None = None
    one_of: tuple[str, ...] = ()
    null: bool = False
    trimmed: bool = False

    def checks(self) -> list[Check]:
        def ok(c: Column) -> Column:
            n = F.length(F.trim(c) if self.trimmed else c)
            fine = n >= self.least
            if self.most is not None:
                fine = fine & (n <= self.most)
            if self.pattern:
                fine = fine & c.rlike(f"^(?:{self.pattern})\\z")
            if self.one_of:
                fine = fine & c.isin(*self.one_of)
            return c.isNull() | fine if self.null else c.isNotNull() & fine

        return [("", ok)]


@dataclass(frozen=True)
class Number:
    """A whole number from ``least`` to ``most``."""

    least: int
    most: int
    null: bool = False

    def checks(self) -> list[Check]:
        return [("", lambda c: c.isNull() | c.between(self.least, self.most) if self.null else c.isNotNull() & c.between(self.least, self.most))]


@dataclass(frozen=True)
class Many:
    """An array of ``of``, of ``least`` to ``most`` elements; ``unique``: a function of an element that tells them apart."""

    of: object
    least: int = 0
    most: int | None = None
    unique: Callable[[Column], Column] | None = None

    def checks(self) -> list[Check]:
        def size(c: Column) -> Column:
            return c.isNotNull() & F.size(c).between(self.least, 1 << 30 if self.most is None else self.most)

        def every(ok: Callable[[Column], Column]) -> Callable[[Column], Column]:
            return lambda c: c.isNull() | F.forall(c, lambda x: F.coalesce(ok(x), F.lit(False)))

        out = [("", size), *((f"[]{path}", every(ok)) for path, ok in self.of.checks())]
        if self.unique:
            out.append(("#unique", lambda c: c.isNull() | (F.size(F.array_distinct(F.transform(c, self.unique))) == F.size(c))))
        return out


@dataclass(frozen=True)
class Record:
    """A struct, or a row: field name to constraint."""

    fields: dict[str, object]

    def checks(self) -> list[Check]:
        def inner(name: str, ok: Callable[[Column], Column]) -> Callable[[Column], Column]:
            return lambda c: ok(c[name])

        return [(f".{name}{path}", inner(name, ok)) for name, of in self.fields.items() for path, ok in of.checks()]


def rules(record: Record) -> dict[str, Column]:
    """The checks of a row's schema by path, as columns that are true where the row keeps them."""
    return {f"{name}{path}": ok(F.col(name)) for name, of in record.fields.items() for path, ok in of.checks()}


def checked(rows: DataFrame, record: Record, unique: dict[str, list[Column]] | None = None) -> DataFrame:
    """Adds ``violations``: the paths of the checks that a row breaks, in the order of the schema, then the names of ``unique`` whose key several rows share.

    Row checks are one native expression. A uniqueness check counts keys, partially before the shuffle, and joins only the repeated ones back; keys with a null are never repeated.
    """
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(path)) for path, ok in rules(record).items()]))
    rows = rows.withColumn("violations", broken)
    for name, key in (unique or {}).items():
        names = [f"_k{i}" for i in range(len(key))]
        keyed = rows.withColumns(dict(zip(names, key, strict=True)))
        again = keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
        keyed = keyed.join(again.hint("merge"), names, "left")
        rows = keyed.withColumn("violations", F.when(F.col("_n").isNotNull(), F.concat("violations", F.array(F.lit(name)))).otherwise(F.col("violations"))).drop("_n", *names)
    return rows


def quarantined(rows: DataFrame, record: Record, unique: dict[str, list[Column]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that keep all constraints, rows that do not with their violations), from one written table that is dealt by whether they do."""
    path = written(checked(rows, record, unique).withColumn("broken", F.size("violations") > 0), "checked")
    return path.where(~F.col("broken")).drop("violations", "broken"), path.where("broken").drop("broken")


SCORE = Number(0, 100)
HANDLE = Text(pattern="[a-zA-Z0-9_]{1,30}")
CITATION = Record({"article_id": Text(), "excerpt": Text(8, 250)})
CLAIM = Record({
    "claim": Text(1, 250), "verdict": Text(one_of=("supported", "insufficient", "contradicted")), "reason": Text(1, 250),
    "article_ids": Many(Text(), 1, 8), "citations": Many(CITATION, 1, 8),
})
EVIDENCE = Record({"article_id": Text(), "role": Text(one_of=("first_party", "independent", "repost", "unknown")), "excerpt": Text(8, 250)})
EVENT = Record({
    "disposition": Text(one_of=("publish", "background", "insufficient", "reject")), "title": Text(1, 120), "summary": Text(1, 600), "relevance": SCORE, "value": SCORE, "impact": Text(1, 400),
    "importance": Text(one_of=("urgent", "high", "medium", "low", "unassessed")), "importance_reason": Text(1, 250), "credibility": Text(one_of=("supported", "corroborated", "unverified", "disputed")),
    "reason": Text(1, 500), "gaps": Many(Text(most=200), 0, 6), "claims": Many(CLAIM, 1, 5), "evidence": Many(EVIDENCE, 1, 12),
})
SCREENING = Record({
    "article_id": Text(), "decision": Text(one_of=("relevant", "irrelevant", "low_value", "insufficient")), "relevance": SCORE, "value": SCORE, "reason": Text(1, 350), "novelty": Text(most=350),
    "subject": Text(most=100, null=True), "action": Text(one_of=("release", "update", "research", "incident", "benchmark", "pricing", "other"), null=True), "version": Text(most=80, null=True),
    "event_date": Text(pattern=r"[0-9]{4}-[0-9]{2}-[0-9]{2}", null=True), "event_key": Text(most=160, null=True), "claims": Many(Text(1, 200), 0, 5),
})
CHANNEL = Record({
    "name": Text(1, 80, trimmed=True), "kind": Text(one_of=("keyword", "topic")), "keywords": Text(1, 200, trimmed=True), "aliases": Text(most=500, trimmed=True), "excludes": Text(most=500, trimmed=True),
    "sources": Many(Text(one_of=("x", "hn", "github", "rss", "google", "bing")), 1), "rss_urls": Many(Text(most=1000, pattern="[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#].*"), 0, 8), "interval_minutes": Number(5, 1440),
    "min_relevance": SCORE, "cooldown_minutes": Number(0, 1440),
    "quality": Record({
        "mode": Text(one_of=("loose", "standard", "strict", "custom")), "min_likes": Number(0, 100_000), "min_reposts": Number(0, 100_000), "min_replies": Number(0, 100_000), "observation_minutes": Number(0, 1440),
        "followed": Many(HANDLE, 0, 50), "blocked": Many(HANDLE, 0, 50), "web_interval_minutes": Number(30, 1440), "repositories": Many(Text(pattern=r"[\w.-]+/[\w.-]+"), 0, 10),
    }),
})
ACCOUNT = Record({"handle": Text(pattern="[a-zA-Z0-9_]{1,15}"), "name": Text(1, 80, trimmed=True), "kind": Text(one_of=("official", "expert")), "focus": Text(1, 200, trimmed=True)})
ACCOUNTS = Record({"accounts": Many(ACCOUNT, 0, 50, lambda a: F.lower(a["handle"]))})
