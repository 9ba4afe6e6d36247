"""Phrase collocation mining: HAT-trie counting in tasks, sorted runs merged by prefix, scores and ranks as joins."""

from __future__ import annotations

import re
from collections import _count_elements
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, written

#: Pieces end at these signs; words end at blanks and tabs as well (fixed values). 0xFF is in no UTF-8 text and stands for the end of a piece.
ENDS, BLANKS, END = b".,;:!?\n\x0b\x0c\r", b" \t", b"\xff"
_CUT = bytes.maketrans(ENDS + BLANKS, END * len(ENDS) + b" " * len(BLANKS))
_GAP = re.compile(rb"[ \xff]")
#: Bits of a word's place in a packed key of up to three words; the most words that a task numbers at once.
BITS, MOST_WORDS = 21, 1 << 20
#: Bytes that are split at once; entries of a hash container before it bursts; entries of a trie before subtrees are spilled.
SLICE, BURST, ROOM = 1 << 20, 4096, 1_500_000
#: Bits of the filters of frequent words and pairs: 8 MB each at any size of the corpus.
FILTER_BITS = 1 << 26
KEYS = ["g1", "g2", "g3", "g4"]


class Words:
    """Numbers the words of each language for one task: 0 is the end of a piece. ``hashes`` has their 64-bit identity, ``allowed`` whether the filter holds them."""

    def __init__(self, bits: np.ndarray | None = None):
        self.bits = bits
        self.reset()

    def reset(self) -> None:
        self.tables: dict[bytes, dict] = {}
        self.names: list[tuple[bytes, bytes]] = [(b"", END)]
        self.fresh: list[int] = []
        self.hashes, self.allowed = np.zeros(1, np.uint64), np.zeros(1, bool)

    def ids(self, lang: bytes, data: bytes) -> np.ndarray:
        """The numbers of the words of lower-cased, translated ``data``."""
        table = self.tables.get(lang)
        if table is None:
            table = self.tables[lang] = _Numbers(self, lang)
        words = data.replace(END, b" \xff ").split()
        out = np.fromiter(map(table.__getitem__, words), np.int64, len(words))
        if self.fresh:
            new = np.array(self.fresh, np.uint64)
            self.fresh = []
            self.hashes = np.concatenate((self.hashes, new))
            self.allowed = np.concatenate((self.allowed, holds(self.bits, new) if self.bits is not None else np.ones(len(new), bool)))
        return out


class _Numbers(dict):
    def __init__(self, words: Words, lang: bytes):
        super().__init__({END: 0})
        self.words, self.lang = words, lang

    def __missing__(self, word: bytes) -> int:
        w = self.words
        at = self[word] = len(w.names)
        w.names.append((self.lang, word))
        w.fresh.append(xxhash.xxh3_64_intdigest(self.lang + END + word) or 1)
        return at


class Trie:
    """A shallow trie of word numbers over hash containers: a phrase's first word leads to a node, its packed rest is a key there. A container
    with over ``BURST`` keys bursts into one for each next word, as long as words are left for keys (``levels``)."""

    def __init__(self, levels: int):
        self.levels, self.nodes, self.size = levels, {}, 0

    def add(self, first: np.ndarray, rest: np.ndarray) -> None:
        order = np.argsort(first, kind="stable")
        self._deal(self.nodes, first[order], rest[order], 0)

    def _deal(self, nodes: dict, lead: np.ndarray, keys: np.ndarray, depth: int) -> None:
        """Gives each run of equal ``lead`` its keys."""
        if not len(lead):
            return
        starts = np.concatenate(([0], np.flatnonzero(lead[1:] != lead[:-1]) + 1))
        for word, (a, b) in zip(lead[starts].tolist(), pairwise([*starts.tolist(), len(lead)]), strict=True):
            node = nodes.get(word)
            if node is None:
                node = nodes[word] = {}
            if type(node) is _Burst:
                self._split(node, np.sort(keys[a:b]), depth)
                continue
            before = len(node)
            _count_elements(node, keys[a:b].tolist())
            self.size += len(node) - before
            if len(node) > BURST and depth < self.levels:
                nodes[word] = _Burst()
                self._split(nodes[word], np.fromiter(node, np.int64, len(node)), depth, np.fromiter(node.values(), np.int64, len(node)))

    def _split(self, burst: _Burst, keys: np.ndarray, depth: int, counts: np.ndarray | None = None) -> None:
        """Keys to the containers of their next word; with ``counts`` those of a container that bursts."""
        down = BITS * (2 - depth)
        if counts is None:
            self._deal(burst, keys >> down, keys & ((1 << down) - 1), depth + 1)
            return
        for key, n in zip(keys.tolist(), counts.tolist(), strict=True):
            burst.setdefault(key >> down, {})[key & ((1 << down) - 1)] = n

    def spill(self, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Takes out whole subtrees, large ones first, until ``share`` of the entries is gone: first words, packed rests and counts."""
        sizes = sorted(((_size(node), word) for word, node in self.nodes.items()), reverse=True)
        first, rest, counts, gone = [], [], [], 0
        for size, word in sizes:
            if gone >= share * self.size:
                break
            for key, n in _entries(self.nodes.pop(word), 0):
                first.append(np.full(len(key), word, np.int64))
                rest.append(key)
                counts.append(n)
            gone += size
        self.size -= gone
        none = [np.zeros(0, np.int64)]
        return np.concatenate(first or none), np.concatenate(rest or none), np.concatenate(counts or none)


class _Burst(dict):
    """A burst container: a node of the trie, by next word."""


def _size(node: dict) -> int:
    return sum(map(_size, node.values())) if type(node) is _Burst else len(node)


def _entries(node: dict, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    if type(node) is not _Burst:
        yield np.fromiter(node, np.int64, len(node)), np.fromiter(node.values(), np.int64, len(node))
        return
    for word, kid in node.items():
        for keys, n in _entries(kid, depth + 1):
            yield keys | (word << (BITS * (2 - depth))), n


def holds(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether the filter has the bit of each hash."""
    at = places & np.uint64(FILTER_BITS - 1)
    return (bits[(at >> np.uint64(3)).view(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a ^ (b >> np.uint64(7))


def filter_of(rows: DataFrame, place: Column) -> np.ndarray:
    """The bits of ``place`` over all rows, set in bitmaps of 4 KB that tasks combine: a fixed size, however many rows; hits of others only cost work."""
    at = place.bitwiseAND(FILTER_BITS - 1) + 1
    maps = rows.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("m"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in maps.collect():
        bits[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(r.m, np.uint8)
    return bits


def _slices(batch: pa.RecordBatch, words: Words) -> Iterator[tuple[np.ndarray, int]]:
    """The word numbers of (lang, text) rows, about ``SLICE`` bytes at a time. Where a text is cut, the last three words come again at the start of
    the next array; phrases that end before its second value have been counted."""
    langs, texts = (c.cast(pa.binary()) for c in batch.columns)
    at, n = 0, batch.num_rows
    while at < n:
        parts: dict[bytes, list[bytes]] = {}
        size = 0
        while at < n and size < SLICE:
            text = texts[at].as_py() or b""
            parts.setdefault(langs[at].as_py(), []).append(text)
            size += len(text) + 1
            at += 1
        for lang, some in parts.items():
            data = END.join([*some, b""]).lower().translate(_CUT)
            start, tail = 0, np.zeros(0, np.int64)
            while start < len(data):
                gap = _GAP.search(data, start + SLICE)
                end = gap.end() if gap else len(data)
                ids = words.ids(lang, data[start:end])
                yield np.concatenate((tail, ids)), len(tail)
                tail, start = np.concatenate((tail, ids))[-3:], end


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, lang, word, n) for each word of each language of ``docs`` (lang, text): counted in tasks, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("phrases", object)  # nothing, but what this worker kept for other operators goes
        words, total = Words(), np.zeros(0, np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for a in range(1, len(words.names), 50_000):
                some = words.names[a : a + 50_000]
                cols = [pa.array(words.hashes[a : a + 50_000].view(np.int64)), *(pa.array([x[k] for x in some], pa.binary()).cast(pa.string()) for k in (0, 1)), pa.array(total[a : a + 50_000])]
                yield pa.RecordBatch.from_arrays(cols, ["h", "lang", "word", "n"])
            words.reset()

        for batch in batches:
            for ids, skip in _slices(batch, words):
                n = np.bincount(ids[skip:], minlength=len(words.names))
                n[: len(total)] += total
                total = n
            if len(words.names) >= MOST_WORDS:
                yield from out()
                total = total[:0]
        yield from out()

    return docs.mapInArrow(run, "h long, lang string, word string, n long").groupBy("h", "lang", "word").agg(F.sum("n").alias("n"))


def phrase_runs(docs: DataFrame, sizes: tuple[int, ...], word_bits: np.ndarray, pair_bits: np.ndarray | None) -> DataFrame:
    """(g1..g4, n): sorted runs of phrases of these sizes with their counts in a task, made of words (and neighbouring pairs) that the filters hold.

    A task counts in a trie and spills whole subtrees, as rows in key order, when it is full; at the end all that is left.
    """
    sent = [docs.sparkSession.sparkContext.broadcast(b) if b is not None else None for b in (word_bits, pair_bits)]
    levels = max(sizes) - 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("phrases", object)
        words, pairs = Words(sent[0].value), sent[1].value if sent[1] else None
        trie = Trie(levels)

        def count(ids: np.ndarray, skip: int) -> None:
            ok = words.allowed[ids]
            at = np.flatnonzero(ok[:-1] & ok[1:])
            if pairs is not None:
                h = words.hashes[ids]
                at = at[holds(pairs, pair_hash(h[at], h[at + 1]))]
            if 2 in sizes:
                two = at[at + 1 >= skip]
                trie.add(ids[two], ids[two + 1] << 2 * BITS)
            joined = np.zeros(len(ids), bool)
            joined[at] = True
            for k in (3, 4):
                if k in sizes:
                    at = at[joined[np.minimum(at + k - 2, len(ids) - 1)]] if len(at) else at
                    last = at[at + k - 1 >= skip]
                    rest = (ids[last + 1] << 2 * BITS) | (ids[last + 2] << BITS)
                    trie.add(ids[last], rest | ids[last + 3] if k == 4 else rest)

        def out(share: float) -> Iterator[pa.RecordBatch]:
            first, rest, n = trie.spill(share)
            low = (1 << BITS) - 1
            g = [words.hashes[x].view(np.int64) for x in (first, rest >> 2 * BITS, (rest >> BITS) & low, rest & low)]
            order = np.lexsort(g[::-1])
            for a in range(0, len(order), 100_000):
                some = order[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([*(pa.array(x[some]) for x in g), pa.array(n[some])], [*KEYS, "n"])

        for batch in batches:
            for ids, skip in _slices(batch, words):
                count(ids, skip)
                if trie.size > ROOM:
                    yield from out(0.5)
            if len(words.names) >= MOST_WORDS:
                yield from out(1)
                words.reset()
        yield from out(1)

    return docs.mapInArrow(run, "g1 long, g2 long, g3 long, g4 long, n long")


def merged_runs(runs: DataFrame, least: int) -> DataFrame:
    """Runs merged by prefix partition, that of a phrase's first two words: Spark sorts a partition's runs and spills, then counts of equal neighbours are added in one stream. Sums
    of ``least`` or more stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((5, 0), np.int64)
        for batch in batches:
            rows = np.concatenate((held, np.stack([c.to_numpy() for c in batch.columns])), axis=1)
            if not rows.shape[1]:
                continue
            starts = np.concatenate(([0], np.flatnonzero((rows[:4, 1:] != rows[:4, :-1]).any(axis=0)) + 1))
            sums = np.concatenate((rows[:4, starts], np.add.reduceat(rows[4], starts)[None, :]))
            held = sums[:, -1:]
            yield out(sums[:, :-1])
        yield out(held)

    def out(sums: np.ndarray) -> pa.RecordBatch:
        sums = sums[:, sums[4] >= least]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in sums], [*KEYS, "a"])

    return runs.repartition("g1", "g2").sortWithinPartitions(*KEYS).mapInArrow(run, "g1 long, g2 long, g3 long, g4 long, a long")


def frequent_phrases(docs: DataFrame, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """Written tables of ``docs`` (lang, text): all words (h, lang, word, n), and the phrases of two to four words (g1..g4, a) with a >= ``least``.

    A phrase is as frequent as its parts at most, so pairs are counted where both words may be frequent, longer phrases where all their pairs may be.
    """
    words = written(word_counts(docs), "words")
    bits = filter_of(words.where(F.col("n") >= least), F.col("h"))
    pairs = written(merged_runs(phrase_runs(docs, (2,), bits, None), least), "pairs")
    pair_bits = filter_of(pairs, F.col("g1").bitwiseXOR(F.shiftrightunsigned("g2", 7)))
    longer = written(merged_runs(phrase_runs(docs, (3, 4), bits, pair_bits), least), "longer")
    return words, pairs.unionByName(longer)


def _part(first: int, last: int) -> list[Column]:
    """The key of words ``first`` to ``last`` of a phrase, counted from 1."""
    return [F.col(KEYS[first - 1 + k]).alias(KEYS[k]) if first + k <= last else F.lit(0).cast("long").alias(KEYS[k]) for k in range(4)]


def _of_length(k: int) -> Column:
    last = F.col(KEYS[k - 1]) != 0
    return last & (F.col(KEYS[k]) == 0) if k < 4 else last


def _big(x: Column) -> Column:
    return x.cast("decimal(20,0)")


def scored(words: DataFrame, phrases: DataFrame, least: int, drop: tuple[int, int] = (80, 100)) -> DataFrame:
    """(g1..g4, a, k, l, r, score) of the candidates that no longer one covers: the cut with the lowest score, ties to the earliest.

    Lookups of parts are merge joins right on their exchanges, which Spark splits where many phrases share a part. Arithmetic is in decimals of 38 digits.
    """
    known = words.where(F.col("n") >= least).select(F.col("h").alias("g1"), *[F.lit(0).cast("long").alias(g) for g in KEYS[1:]], F.col("n").alias("f")).unionByName(phrases.withColumnRenamed("a", "f"))
    cuts = [(n, k) for n in (2, 3, 4) for k in range(1, n)]
    each = F.array_compact(F.array(*[F.when(_of_length(n), F.struct(F.lit(k).alias("k"), F.struct(*_part(1, k)).alias("left"), F.struct(*_part(k + 1, n)).alias("right"))) for n, k in cuts]))
    rows = phrases.select(*KEYS, "a", F.explode(each).alias("c")).select(*KEYS, "a", "c.k", *[F.col(f"c.{side}.{g}").alias(f"{side}_{g}") for side in ("left", "right") for g in KEYS])
    for side, name in (("left", "l"), ("right", "r")):
        own = known.select(*[F.col(g).alias(f"{side}_{g}") for g in KEYS], F.col("f").alias(name))
        rows = rows.join(own.hint("merge"), [f"{side}_{g}" for g in KEYS])
    score = F.expr("(CAST(a AS DECIMAL(20,0)) * 2000000BD) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    best = rows.withColumn("score", score).groupBy(*KEYS, "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select(*KEYS, "a", "c.*")
    inside = [(n, i, j) for n in (3, 4) for i in range(1, n) for j in range(i + 1, n + 1) if j - i + 1 < n]
    subs = F.array_compact(F.array(*[F.when(_of_length(n), F.struct(*_part(i, j))) for n, i, j in inside]))
    covers = phrases.where(F.col("g3") != 0).select(F.explode(subs).alias("s"), "a").groupBy(*[F.col(f"s.{g}").alias(g) for g in KEYS]).agg(F.max("a").alias("around"))
    open_ = F.col("around").isNull() | (drop[1] * _big(F.col("around")) < drop[0] * _big(F.col("a")))
    return best.join(covers.hint("merge"), KEYS, "left").where(open_).drop("around")


def mine_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 30, top: int = 2000) -> DataFrame:
    """The ``top`` collocations of each language: lang, rank, phrase, a, l, r, n, score (see scored()).

    A-Z is lower-cased; words lie between blanks, tabs and the signs that end pieces; phrases stay inside pieces. Null texts are empty, null
    languages are ``und``; repeated rows count each time; other columns are not used; an empty table, or one without a frequent phrase, gives an empty table.
    Words are told apart by 64-bit hashes of language and word; the texts of words come back for the phrases that are ranked.
    Ranks are taken in two steps, by score and count first, where tasks keep their best rows only, then with the phrases' texts.
    """
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words, phrases = frequent_phrases(docs, least)
    rows = written(scored(words, phrases, least), "scored")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    known = words.where(F.col("n") >= least).select("h", "lang", "word").hint("merge")
    rows = rows.join(known.drop("word"), F.col("g1") == F.col("h")).drop("h")
    best = written(rows.selectExpr("*", "rank() OVER (PARTITION BY lang ORDER BY score DESC, a DESC) AS place").where(F.col("place") <= top).drop("place"), "best")
    spelt = best.select(*KEYS, F.posexplode(F.filter(F.array(*KEYS), lambda g: g != 0)).alias("at", "h")).join(known.drop("lang"), "h")
    spelt = spelt.groupBy(*KEYS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    best = best.join(spelt.hint("merge"), KEYS).join(totals.hint("merge"), "lang")
    ranked = best.selectExpr("lang", "CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS LONG) AS rank", "phrase", "a", "l", "r", "n", "score")
    return ranked.where(F.col("rank") <= top)


def op11(spark, sf_dir: str) -> DataFrame:
    """op11_phrases over the whole documents table: phrases of two to four words that occur 30 times or more, the best 2,000 of each language."""
    return mine_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d,
    regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents
), q AS (SELECT lang, d, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM p
), w AS (SELECT lang, d, i, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM q
), g AS (SELECT lang, ws[s:s + k - 1] AS ph FROM w, range(1, 5) x(k), LATERAL (SELECT unnest(range(1, len(ws) - k + 2)) AS s) y
), f AS MATERIALIZED (SELECT lang, ph, count(*) AS a FROM g GROUP BY 1, 2
), t AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE len(ph) = 1 GROUP BY 1
), c AS MATERIALIZED (SELECT * FROM f WHERE a >= 30 AND len(ph) >= 2
), cuts AS (
  SELECT c.lang, c.ph, c.a, k, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a) // (l.a + r.a) AS score
  FROM c, range(1, 4) x(k), f l, f r WHERE k < len(c.ph) AND l.lang = c.lang AND r.lang = c.lang AND l.ph = c.ph[1:k] AND r.ph = c.ph[k + 1:]
), best AS (SELECT lang, ph, a, arg_min(l, score * 10 + k) AS l, arg_min(r, score * 10 + k) AS r, min(score)::BIGINT AS score FROM cuts GROUP BY 1, 2, 3
), subs AS (SELECT lang, ph[i:j] AS ph, max(a) AS around FROM c, range(1, 4) x(i), range(2, 5) y(j) WHERE i < j AND j <= len(ph) AND j - i + 1 < len(ph) GROUP BY 1, 2
), kept AS (SELECT b.* FROM best b LEFT JOIN subs USING (lang, ph) WHERE around IS NULL OR 100 * around::HUGEINT < 80 * b.a::HUGEINT
), ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ph, ' ')) AS rank, array_to_string(ph, ' ') AS phrase, a, l, r, score FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN t USING (lang) WHERE rank <= 2000
"""
