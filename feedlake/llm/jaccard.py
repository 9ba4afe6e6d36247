"""Exact Jaccard self-join of word shingle sets, by pivots, Voronoi regions and triangle-inequality windows.

Jaccard distance is a metric, but distances between texts that are not near copies crowd just below 1, where windows of
document pivots prune nothing. So the points that split the whole space first are single shingles, which are sets too: a set's nearest
ones are those it holds, ordered rare first; it owns the region of the first and is replicated to those within the window that
the threshold leaves (a prefix of its shingles in that order). Two sets that link share a region. A small region yields the pairs that sizes
and places allow. In a larger one documents are the pivots: members go to the Voronoi region of the nearest pivot and, within twice the
distance bound, to others, and regions are split again until they are small or hold one component only.

Sets travel only to their pivots (distances()): one row for a set and a pivot. For all links of a class, each set is kept as its
difference from the class's pivot, which is short among near copies; the triangle inequality decides most pairs by the lengths
of the differences, the differences themselves the rest (class_links()).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hint, kept, release, salt_of, salted, small_batches, without_ids, written
from .components import components
from .shingles import shingle_sets

BLOCK = 1 << 16
#: Steps of a cell's count for each power of two; a count of 32 bits fits into a byte.
STEPS = 7


@dataclass(frozen=True)
class Setting:
    """Sets of ``k``-word shingles link at Jaccard similarity ``num``/``den`` or more. The rest steers the work, not the result."""

    k: int = 4
    num: int = 85
    den: int = 100
    cells: int = 1 << 22
    bins: int = 128
    small: int = 64
    pivots: int = 3
    levels: int = 4
    salts: int = 8
    block: int = 512
    joined: int = 4096
    broadcast_rows: int = 500_000

    @property
    def reach(self) -> float:
        """The largest distance of a link."""
        return 1 - self.num / self.den

    def linked(self, common: Column, n_a: Column, n_b: Column) -> Column:
        return F.lit(self.den) * common >= F.lit(self.num) * (n_a + n_b - common)

    def least_common(self, n_a: Column, n_b: Column) -> Column:
        """The fewest common shingles with which sets of these sizes link: ceil(num * (a + b) / (num + den))."""
        return F.floor((F.lit(self.num) * (n_a + n_b) + (self.num + self.den - 1)) / F.lit(self.num + self.den)).cast("long")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))


def shingle_ranks(docs: DataFrame, text_col: str, s: Setting) -> np.ndarray:
    """A rank for each hash cell, 0 for rare: how many documents hold a shingle of the cell, in octaves of what exceeds the count of a cell of rare shingles.

    That is the mean of the lower half of the cells and four standard deviations of a count of that size. All documents count. Tasks send one block of counts for each 65,536 cells,
    a thinly filled one as places and counts, which meet in two steps; the result has a fixed size. Any ranks give exact results; good ones keep frequent shingles out of the regions.
    """
    blocks = s.cells // BLOCK
    kinds = "block int, part int, at binary, n binary"

    def sent(block: int, part: int, n: np.ndarray) -> pd.DataFrame:
        """A row with the counts of a block; ``at`` holds their places, or nothing if all places follow each other."""
        at = np.flatnonzero(n)
        n = n.astype(np.uint16 if n.max() < 1 << 16 else np.uint32)
        thin = len(at) * (2 + n.itemsize) < n.nbytes
        return pd.DataFrame({"block": [block], "part": [part], "at": [at.astype(np.uint16).tobytes() if thin else b""], "n": [(n[at] if thin else n).tobytes()]})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept("jaccard", object)  # nothing, but what this worker kept for other operators goes
        total = np.zeros(s.cells, np.uint32)
        for batch in batches:
            for h in shingle_sets(batch["t"].tolist(), s.k):
                np.add.at(total, (h % np.uint64(s.cells)).view(np.int64), np.uint32(1))  # in place: no second table of counts
        part = TaskContext.get().partitionId() % 8
        for b in range(blocks):
            some = total[b * BLOCK : (b + 1) * BLOCK]
            if some.any():
                yield sent(b, part, some)

    def added(last: bool):
        """Adds up the rows of each block and part, which come together; the last step gives levels in place of counts."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at, total = None, None
            for batch in batches:
                for block, part, places, n in zip(batch["block"], batch["part"], batch["at"], batch["n"], strict=True):
                    if (block, part) != at:
                        if at:
                            yield out(at, total)
                        at, total = (block, part), np.zeros(BLOCK, np.uint64)
                    size = len(places) // 2 or BLOCK
                    total[np.frombuffer(places, np.uint16) if places else slice(None)] += np.frombuffer(n, np.uint16 if len(n) == 2 * size else np.uint32)
            if at:
                yield out(at, total)

        def out(at: tuple, total: np.ndarray) -> pd.DataFrame:
            n = np.minimum(total, (1 << 32) - 1)
            if not last:
                return sent(*at, n)
            return pd.DataFrame({"block": [at[0]], "part": [at[1]], "at": [b""], "n": [np.floor(STEPS * np.log2(n + 1.0)).astype(np.uint8).tobytes()]})

        return run

    key = ["block", "part"]
    merged = docs.select(F.col(text_col).alias("t")).mapInPandas(count, kinds).repartition(*key).sortWithinPartitions(*key).mapInPandas(added(False), kinds)
    merged = merged.withColumn("part", F.lit(0)).repartition(*key).sortWithinPartitions(*key).mapInPandas(added(True), kinds)
    level_of = np.zeros(s.cells, np.uint8)
    with small_batches(docs.sparkSession, 200):
        for r in merged.collect():
            level_of[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.n, np.uint8)
    return ranks_of(level_of)


def ranks_of(level_of: np.ndarray) -> np.ndarray:
    """The ranks of cells with these levels. All is worked out for the 256 levels, so that the driver holds no wider table of the cells."""
    counts = 2 ** ((np.arange(256) + 0.5) / STEPS) - 1
    cells = np.bincount(level_of, minlength=256)
    lower = np.searchsorted(cells.cumsum(), (len(level_of) + 1) // 2) + 1
    usual = np.average(counts[:lower], weights=cells[:lower])
    above = counts - usual - 4 * np.sqrt(usual) - 4
    return np.where(above > 0, np.clip(np.log2(np.maximum(above, 1)) + 1, 1, 60), 0).astype(np.uint8)[level_of]


def signatures(docs: DataFrame, id_col: str, text_col: str, s: Setting) -> DataFrame:
    """(doc, n, key, bins, own, rare, often) for each row: set size, digest of the set, counts by hash bin, share of rare shingles in thousandths, and
    the prefix in rank order, apart for rare and frequent shingles; null where the task has met the set before."""
    ranks = docs.sparkSession.sparkContext.broadcast(shingle_ranks(docs, text_col, s))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank, met = ranks.value, set()
        for batch in batches:
            for at in range(0, len(batch), 500):
                some, rows = batch.iloc[at : at + 500], []
                for h, doc in zip(shingle_sets(some["t"].tolist(), s.k), some["doc"], strict=True):
                    n = len(h)
                    if not n:
                        rows.append((0, None, None, None, None, None))
                        continue
                    key = hashlib.blake2b(h.tobytes(), digest_size=16).digest()
                    if doc is None or key in met:
                        rows.append((n, key, None, None, None, None))
                        continue
                    met.add(key)
                    width = n - -(-s.num * n // s.den) + 1
                    r = rank[h % np.uint64(s.cells)]
                    # A stable sort by rank keeps hash order within a rank; most prefixes are of rank 0 alone.
                    first = np.flatnonzero(r == 0)
                    if len(first) < width:
                        first = np.argsort(r, kind="stable")
                    first = first[:width]
                    rare = int((r[first] == 0).sum())
                    bins = np.minimum(np.bincount((h >> np.uint64(40)).astype(np.int64) % s.bins, minlength=s.bins), 32_767).astype(np.int16)
                    first = h[first].view(np.int64)
                    rows.append((n, key, bins, 1000 * rare // n, first[:rare], first[rare:]))
                yield pd.DataFrame(rows, columns=["n", "key", "bins", "own", "rare", "often"]).assign(doc=some["doc"].to_numpy())[names]

    names = ["doc", "n", "key", "bins", "own", "rare", "often"]
    # Ids travel as strings: pandas would read longs with nulls as floats.
    rows = _rows(docs, id_col, text_col).withColumn("doc", F.col("doc").cast("string"))
    return rows.mapInPandas(run, "doc string, n long, key binary, bins array<smallint>, own int, rare array<long>, often array<long>").withColumn("doc", F.col("doc").cast("long"))


def split_regions(postings: DataFrame, s: Setting) -> DataFrame:
    """The regions of rare shingles, from (s, doc, n, at): rows (pair, x, y, z) with a candidate pair (True, a, b, 0) of a region of up to
    ``small`` documents, or with a member (False, s, doc, at) of a larger one. Rows come sorted by shingle; no larger region is held."""

    def pairs_of(part: np.ndarray, starts: np.ndarray, size: int) -> Iterator[pd.DataFrame]:
        _, doc, n, at = part
        i, j = np.triu_indices(size, 1)
        step = max(1, 1_000_000 // len(i))
        for k in range(0, len(starts), step):
            p, q = (starts[k : k + step, None] + i).ravel(), (starts[k : k + step, None] + j).ravel()
            lo, hi = np.minimum(n[p], n[q]), np.maximum(n[p], n[q])
            least = -(-s.num * (lo + hi) // (s.num + s.den))
            ok = (s.den * lo >= s.num * hi) & (np.minimum(n[p] - at[p], n[q] - at[q]) >= least) & (doc[p] != doc[q])
            p, q = doc[p[ok]], doc[q[ok]]
            yield pd.DataFrame({"x": np.minimum(p, q), "y": np.maximum(p, q)})

    def cut(part: np.ndarray, wide: int | None, last: bool) -> tuple[pd.DataFrame, np.ndarray, int | None]:
        """What the regions of ``part`` give, the members of the region still open, and its shingle if it is known to be large."""
        key = part[0]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(starts, key.size))
        large = (sizes > s.small) | ((key[starts] == wide) if wide is not None else False)
        held, end, wide = part[:, :0], key.size, None
        if not last and large[-1]:
            wide = int(key[-1])
        elif not last:
            held, end = part[:, starts[-1] :], starts[-1]
            starts, sizes, large = starts[:-1], sizes[:-1], large[:-1]
        members = part[:, :end][:, np.repeat(large, sizes)]
        found = [pd.DataFrame({"x": members[0], "y": members[1], "z": members[3]}).assign(pair=False)]
        for size in np.unique(sizes[~large & (sizes > 1)]):
            found += [p.assign(pair=True, z=0) for p in pairs_of(part, starts[~large & (sizes == size)], int(size))]
        return pd.concat(found).drop_duplicates()[["pair", "x", "y", "z"]], held, wide

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wait, rows, wide = [], 0, None
        for batch in batches:
            wait.append(np.stack([batch[c].to_numpy(np.int64) for c in ("s", "doc", "n", "at")]))
            rows += len(batch)
            if rows >= 500_000:
                out, held, wide = cut(np.concatenate(wait, axis=1), wide, False)
                wait, rows = [held], held.shape[1]
                yield out
        if rows:
            yield cut(np.concatenate(wait, axis=1), wide, True)[0]

    return postings.repartition("s").sortWithinPartitions("s").mapInPandas(run, "pair boolean, x long, y long, z long")


def _bins_allow(s: Setting) -> Column:
    """Whether the bins' differences, which bound the symmetric difference from below, leave room for a link."""
    apart = F.aggregate(F.zip_with("bins_a", "bins_b", lambda x, y: F.abs(x.cast("int") - y)), F.lit(0), lambda t, x: t + x)
    return apart <= F.col("n_a") + F.col("n_b") - 2 * s.least_common(F.col("n_a"), F.col("n_b"))


def possible(pairs: DataFrame, heads: DataFrame, s: Setting) -> DataFrame:
    """Pairs (a, b), a < b, of nodes from pairs of documents, as far as sizes and bin counts allow."""
    side = lambda x: heads.select(F.col("doc").alias(x), F.col("node").alias(f"node_{x}"), F.col("n").alias(f"n_{x}"), F.col("bins").alias(f"bins_{x}"))
    near = (F.lit(s.den) * F.least("n_a", "n_b") >= F.lit(s.num) * F.greatest("n_a", "n_b")) & (F.col("node_a") != F.col("node_b"))
    both = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").where(near & _bins_allow(s))
    return both.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def _near_enough(s: Setting, a: Column, b: Column) -> Column:
    """Whether members (n, node, at) of a region can link with the region's shingle as their first common one."""
    left = F.least(a["n"] - a["at"], b["n"] - b["at"])
    return (F.lit(s.den) * F.least(a["n"], b["n"]) >= F.lit(s.num) * F.greatest(a["n"], b["n"])) & (left >= s.least_common(a["n"], b["n"]))


def region_pairs(regions: DataFrame, s: Setting) -> DataFrame:
    """Candidate pairs (a, b), a < b, of small regions (members: array of n, node, at): those that size and place allow."""
    members = F.col("members")
    pairs = F.flatten(F.transform(members, lambda x, i: F.transform(
        F.filter(F.slice(members, i + 2, F.size(members)), lambda y: (x["node"] != y["node"]) & _near_enough(s, x, y)),
        lambda y: F.struct(F.least(x["node"], y["node"]).alias("a"), F.greatest(x["node"], y["node"]).alias("b")),
    )))
    return regions.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()


def alive(often: DataFrame, s: Setting) -> DataFrame:
    """Members (region, node, n, at) that can link with another in the region: one that has too few shingles left from the region's on
    for the smallest size there links with no other first here."""
    least = often.groupBy("region").agg(F.min("n").alias("least_n"), F.count(F.lit(1)).alias("all")).where(F.col("all") > 1).drop("all")
    rows = often.withColumn("_salt", salt_of(s.salts, "node")).join(salted(least, s.salts).hint("merge"), ["region", "_salt"]).drop("_salt")
    smallest = F.greatest("least_n", F.ceil(s.num * F.col("n") / s.den))
    return rows.where(F.col("n") - F.col("at") >= s.least_common(F.col("n"), smallest)).drop("least_n")


def distances(docs: DataFrame, assign: DataFrame, id_col: str, text_col: str, s: Setting, differences: bool = False) -> DataFrame:
    """(pivot, node, common, n_pivot, n) for each pair (pivot, node) of ``assign``, from whole sets; with ``differences`` also ``diff``, the shingles
    that one of both has alone.

    Texts of the documents that take part are read again; each set goes to its pivots in one shuffle. A pivot's nodes are
    dealt to cells of about ``block`` sets, each with a copy of the pivot's, and stream past it: no group is held. The ids that take part
    are written and counted: up to ``broadcast_rows`` they are broadcast, beyond that the join is a merge join. The pairs are written
    first, as three branches read them and whole joins may stand behind them.
    """
    assign = written(assign.where(F.col("pivot") != F.col("node")).select("pivot", "node").distinct(), "assign")
    shares = assign.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / s.block).cast("int").alias("share"))
    deal = F.pmod(F.xxhash64("node"), F.col("share")).cast("int")
    dealt = assign.withColumn("_salt", salt_of(s.salts, "node")).join(salted(shares, s.salts).hint("merge"), ["pivot", "_salt"]).select("node", "pivot", deal.alias("cell"))
    # The pivot's own place in a cell is told by a negative number, so that ids and cells travel as plain arrays.
    leads = shares.select(F.col("pivot").alias("node"), "pivot", F.explode(F.sequence(F.lit(0), F.col("share") - 1)).alias("cell")).withColumn("cell", -1 - F.col("cell"))
    places = dealt.unionByName(leads).groupBy("node").agg(F.collect_list(F.struct("pivot", "cell")).alias("places"))
    places = written(places.select("node", F.col("places.pivot").alias("pivots"), F.col("places.cell").alias("cells")), "places")
    how = join_hint(places, s.broadcast_rows)
    texts = _rows(docs, id_col, text_col).join(places.hint(how), F.col("doc") == F.col("node")).select("t", "node", "pivots", "cells")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 250):
                part = batch.iloc[k : k + 250]
                yield part[["node", "pivots", "cells"]].assign(h=[h.view(np.int64) for h in shingle_sets(part["t"].tolist(), s.k)])

    made = texts.mapInPandas(sets, "node long, pivots array<long>, cells array<int>, h array<long>").where(F.size("h") > 0)
    made = made.select("node", "h", F.explode(F.arrays_zip(F.col("pivots").alias("pivot"), F.col("cells").alias("cell"))).alias("x")).select(
        "x.pivot", F.greatest("x.cell", -1 - F.col("x.cell")).alias("cell"), (F.col("x.cell") >= 0).alias("member"), "node", "h"
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, leads = None, []
        for batch in batches:
            rows = []
            for pivot, cell, member, node, h in zip(*(batch[c].to_numpy() for c in ("pivot", "cell", "member", "node", "h")), strict=True):
                if (pivot, cell) != at:
                    at, leads = (pivot, cell), []
                h = h.view(np.uint64)
                if not member:
                    if not any(np.array_equal(h, p) for p in leads):
                        leads.append(h)
                    continue
                for p in leads:
                    place = np.minimum(np.searchsorted(p, h), len(p) - 1)
                    hit = p[place] == h
                    row = (pivot, node, int(hit.sum()), len(p), len(h))
                    if differences:
                        rest = np.ones(len(p), bool)
                        rest[place[hit]] = False
                        row += (np.concatenate((p[rest], h[~hit])).view(np.int64),)
                    rows.append(row)
            if rows:
                yield pd.DataFrame(rows, columns=["pivot", "node", "common", "n_pivot", "n"] + ["diff"] * differences)

    key = ["pivot", "cell"]
    return made.repartition(*key).sortWithinPartitions(*key, "member").mapInPandas(compare, "pivot long, node long, common long, n_pivot long, n long" + ", diff array<long>" * differences)


def measured(docs: DataFrame, assign: DataFrame, id_col: str, text_col: str, s: Setting) -> DataFrame:
    with small_batches(docs.sparkSession):
        return written(distances(docs, assign, id_col, text_col, s), "distances")


def links_of(apart: DataFrame, s: Setting) -> DataFrame:
    return apart.where(s.linked(F.col("common"), F.col("n_pivot"), F.col("n"))).select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct()


def unlinked(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs whose ends are not in one component yet."""
    side = lambda x: comps.select(F.col("node").alias(x), F.col("comp").alias(f"comp_{x}"))
    both = pairs.join(side("a").hint("merge"), "a", "left").join(side("b").hint("merge"), "b", "left")
    return both.where(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).select("a", "b")


def pivots_of(often: DataFrame, depth: int, s: Setting) -> DataFrame:
    """(region, m, pivots) for regions of two or more. The first pivot is the member with the fewest rare shingles, which lies at the centre of a family
    of near copies; from the second level on others are drawn by hash, one component's members together. A minimum finds each, so tasks combine them."""
    picks = [F.min(F.struct("own", F.xxhash64("node", F.lit(depth)), F.col("node"))).alias("p0")]
    for j in range(1, s.pivots if depth else 1):
        picks.append(F.min(F.struct(F.xxhash64("comp", F.lit(100 * depth + j)), F.col("own"), F.col("node"))).alias(f"p{j}"))
    stats = often.groupBy("region").agg(F.count(F.lit(1)).alias("m"), *picks).where(F.col("m") > 1)
    return stats.select("region", "m", F.array_distinct(F.array(*[F.col(f"p{j}.node") for j in range(len(picks))])).alias("pivots"))


def on_regions(often: DataFrame, per_region: DataFrame, s: Setting, how: str = "inner") -> DataFrame:
    """Joins a row for each region to its members; salted, as a region may hold a large share of all."""
    return often.withColumn("_salt", salt_of(s.salts, "node")).join(salted(per_region, s.salts).hint("merge"), ["region", "_salt"], how).drop("_salt")


def voronoi(often: DataFrame, apart: DataFrame, comps: DataFrame, s: Setting) -> DataFrame:
    """Members (region, pivot, node, n, at, own, m) placed in the Voronoi regions that their distances ask for, with ``d`` and ``comp``; settled regions are left out."""
    away = apart.select("pivot", "node", (1 - F.col("common") / (F.col("n_pivot") + F.col("n") - F.col("common"))).alias("d")).groupBy("pivot", "node").agg(F.min("d").alias("d"))
    placed = often.drop("d").join(away.hint("merge"), ["pivot", "node"], "left").withColumn("d", F.coalesce("d", F.lit(0.0)))
    # A node has a row for each pivot of the region, a few; those that stay are written, as are the placed ones below: two branches read either.
    placed = placed.withColumn("least", F.min("d").over(Window.partitionBy("region", "node"))).where(F.col("d") <= F.col("least") + 2 * s.reach + 1e-9)
    placed = written(placed.drop("least"), "near")
    # A Voronoi region whose window holds every member covers all pairs of its parent; the others are then left out.
    whole = placed.groupBy("region", "pivot").agg(F.count(F.lit(1)).alias("k"), F.max("m").alias("m")).groupBy("region").agg(F.min(F.when(F.col("k") >= F.col("m"), F.col("pivot"))).alias("only"))
    placed = on_regions(placed, whole, s).where(F.col("only").isNull() | (F.col("only") == F.col("pivot")))
    placed = placed.drop("comp").join(comps.hint("merge"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    placed = written(placed.select(F.xxhash64("region", "pivot").alias("region"), "node", "n", "at", "own", "comp", "d"), "placed")
    # A region of one component is settled.
    mixed = placed.groupBy("region").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(F.col("lo") != F.col("hi")).select("region")
    return alive(written(on_regions(placed, mixed, s), "split"), s)


def left_sets(often: DataFrame, sig: DataFrame, heads: DataFrame, s: Setting) -> DataFrame:
    """(node, bins, prefix) for the nodes of ``often``, written. Their ids are written and counted first: few are broadcast, so the prefixes of all other sets are not shuffled."""
    nodes = written(often.select("node").distinct(), "left-nodes")
    ids = written(heads.select("doc", "node").join(nodes.hint(join_hint(nodes, s.broadcast_rows)), "node").distinct(), "left-ids")
    sets = sig.where(F.col("own").isNotNull()).select("doc", "bins", F.concat("rare", "often").alias("prefix"))
    return written(sets.join(ids.hint(join_hint(ids, s.broadcast_rows)), "doc").select("node", "bins", "prefix").dropDuplicates(["node"]), "left-sets")


def leftover_pairs(often: DataFrame, sets: DataFrame, s: Setting) -> DataFrame:
    """Pairs of different components that sizes, places, bin counts and the triangle inequality allow, in regions that pivots did not split. One side is dealt
    to as many cells as the region has ``block`` members, the other goes to all of them. A pair comes from the region of its first common shingle only: each member brings
    what stands before the region's shingle in its prefix, and members that share something there meet elsewhere."""
    share = F.ceil(F.col("m") / s.block).cast("int")
    rows = on_regions(often, often.groupBy("region").agg(F.count(F.lit(1)).alias("m")), s).withColumn("share", share).join(sets.hint("merge"), "node")
    rows = written(rows.withColumn("before", F.slice("prefix", 1, F.col("at"))).drop("prefix"), "left")  # both sides read them
    cell = {"a": F.pmod(F.xxhash64("node"), F.col("share")).cast("int"), "b": F.explode(F.sequence(F.lit(0), F.col("share") - 1))}
    sides = [rows.select("region", cell[x].alias("cell"), *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "at", "comp", "d", "bins", "before")]) for x in "ab"]
    place = lambda x: {c: F.col(f"{c}_{x}") for c in ("n", "at")}
    on = (F.col("node_a") < F.col("node_b")) & (F.col("comp_a") != F.col("comp_b")) & (F.abs(F.col("d_a") - F.col("d_b")) <= s.reach + 1e-9) & _near_enough(s, place("a"), place("b"))
    return sides[0].join(sides[1].hint("merge"), ["region", "cell"]).where(on & ~F.arrays_overlap("before_a", "before_b") & _bins_allow(s)).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def node_links(docs: DataFrame, sig: DataFrame, nodes: DataFrame, id_col: str, text_col: str, s: Setting) -> DataFrame:
    """Links (a, b) between nodes that join all nodes of each class of the whole join; inside a class there may be more."""
    heads = sig.where(F.col("own").isNotNull()).select("key", "doc", "n", "bins", "own").join(nodes.hint("merge"), "key")
    heads = written(heads.select("doc", "node", "n", "bins", "own"), "heads")
    posted = lambda part, at: sig.where(F.size(part) > 0).select(F.posexplode(part).alias("at", "s"), "doc", "n", at.alias("before")).select("s", "doc", "n", (F.col("at") + F.col("before")).alias("at"))
    rare = written(split_regions(posted("rare", F.lit(0)), s), "regions")
    pairs = possible(rare.where("pair").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), heads, s)
    often = rare.where(~F.col("pair")).select(F.col("x").alias("region"), F.col("y").alias("doc"), F.col("z").cast("int").alias("at"))
    often = often.unionByName(posted("often", F.size("rare")).select(F.col("s").alias("region"), "doc", F.col("at").cast("int").alias("at")))
    often = often.join(heads.drop("bins").hint("merge"), "doc").select("region", "node", "n", "at", "own").distinct()
    release(docs.sparkSession)
    often = written(alive(written(often, "often"), s).withColumn("comp", F.col("node")).withColumn("d", F.lit(0.0)), "alive")

    by_node = heads.select(F.col("node").alias("doc"), "node", "n", "bins").dropDuplicates(["doc"])
    large_rows = None
    links, comps, waiting, member = None, None, written(pairs, "pairs"), F.struct("n", "node", "at").alias("m")
    for depth in range(s.levels):
        joined = written(on_regions(often, written(pivots_of(often, depth, s), "pivots"), s), "members")
        little = joined.where(F.col("m") <= s.small).groupBy("region").agg(F.collect_list(member).alias("members"))
        waiting = written(waiting.unionByName(possible(region_pairs(little, s), by_node, s)).distinct(), "pairs")
        large = joined.where(F.col("m") > s.small).withColumn("pivot", F.explode("pivots")).drop("pivots")
        assign = large.select("pivot", "node")
        if not depth:
            # One pair for each node joins most nodes of a class; of the rest only those between what is still apart are compared, at the end.
            assign = assign.unionByName(waiting.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("pivot")))
        apart = measured(docs, assign, id_col, text_col, s)
        links = written(links_of(apart, s) if links is None else links.unionByName(links_of(apart, s)).distinct(), "links")
        comps = components(links)
        often = written(voronoi(large, apart, comps, s), "split")
        # Regions that are small enough for pairs end the recursion, and regions that pivots do not split, where all are far from one another.
        before, large_rows = large_rows, often.groupBy("region").count().where(F.col("count") > s.joined).agg(F.sum("count")).first()[0] or 0
        if large_rows == 0 or (before is not None and large_rows > 0.8 * before):
            break
    if not often.isEmpty():
        waiting = waiting.unionByName(leftover_pairs(often, left_sets(often, sig, heads, s), s)).distinct()
    waiting = unlinked(waiting, comps)
    apart = measured(docs, waiting.select(F.col("a").alias("pivot"), F.col("b").alias("node")), id_col, text_col, s)
    return written(links.unionByName(links_of(apart, s)).distinct(), "links")


def _tables(docs: DataFrame, id_col: str, text_col: str, s: Setting) -> tuple[DataFrame, DataFrame]:
    """Signatures of the rows, and (key, node, comp, pivot) for each distinct set: its smallest id, its class, and the node of the class with the most known links."""
    sig = written(signatures(docs, id_col, text_col, s), "signatures")
    nodes = sig.where(F.col("doc").isNotNull() & (F.col("n") > 0)).groupBy("key").agg(F.min("doc").alias("node"))
    links = node_links(docs, sig, nodes, id_col, text_col, s)
    ends = links.select(F.col("a").alias("node")).unionAll(links.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("k"))
    comps = components(links).join(ends.hint("merge"), "node")
    centres = comps.groupBy("comp").agg(F.min(F.struct((-F.col("k")).alias("k"), "node")).alias("c")).select("comp", F.col("c.node").alias("pivot"))
    comps = comps.withColumn("_salt", salt_of(s.salts, "node")).join(salted(centres, s.salts).hint("merge"), ["comp", "_salt"]).select("node", "comp", "pivot")
    return sig, written(nodes.join(comps.hint("merge"), "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"), "pivot"), "classes")


def _members(sig: DataFrame, classes: DataFrame, s: Setting) -> DataFrame:
    """``classes`` on each row's set; salted, as a set may have many copies."""
    keyed = sig.select("doc", "n", "key").withColumn("_salt", salt_of(s.salts, "doc"))
    return keyed.join(salted(classes, s.salts).hint("merge"), ["key", "_salt"], "left")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", setting: Setting | None = None) -> DataFrame:
    """id, ``n_shingles`` and ``component_id`` for each row of ``docs``: exact single-link classes of the Jaccard join.

    Words are runs without ASCII white space, A-Z lower-cased; a text of fewer than k words is one shingle; null texts and texts without
    words have an empty set, link with nothing and are their own class. component_id is the smallest id reachable, itself included.
    A row with a null id takes no part and has a null component_id; rows that share an id are one document (with other texts, it has all their links);
    ids must be integers or cast to them; extra columns are not used; an empty table gives an empty table. Equal sets are one node (the smallest id), so copies are never expanded to pairs.
    """
    s = setting or Setting()
    sig, classes = _tables(docs, id_col, text_col, s)
    return _members(sig, classes, s).select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("comp", "doc")).alias("component_id"))


def common_counts(x: list[np.ndarray], y: list[np.ndarray] | None = None, columns: int = 4096) -> np.ndarray:
    """The sizes of the intersections of each set of ``x`` with each of ``y`` (of ``x`` itself if not given); sets hold distinct values."""
    sets, m = x + (y or []), len(x)
    which = np.repeat(np.arange(len(sets)), [len(h) for h in sets])
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Only shingles that two sets hold count; they are taken some columns at a time.
    place = (np.cumsum(n > 1) - 1)[at]
    held = n[at] > 1
    which, place = which[held], place[held]
    order = np.argsort(place, kind="stable")
    which, place = which[order], place[order]
    total = np.zeros((m, len(y) if y is not None else m), np.int64)
    for start in range(0, int(place[-1]) + 1 if len(place) else 0, columns):
        lo, hi = np.searchsorted(place, (start, start + columns))
        some = np.zeros((len(sets), min(columns, int(place[-1]) + 1 - start)), np.float32)
        some[which[lo:hi], place[lo:hi] - start] = 1
        total += (some[:m] @ (some[m:] if y is not None else some).T).astype(np.int64)
    return total


def class_differences(docs: DataFrame, sig: DataFrame, classes: DataFrame, id_col: str, text_col: str, s: Setting) -> DataFrame:
    """(comp, node, n, w, diff) for each node of a class of two or more: set size, rows with the set, and the difference of the set from its class's pivot."""
    copies = sig.where(F.col("doc").isNotNull() & (F.col("n") > 0)).select("key", "doc", "n").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("w"), F.first("n").alias("n"))
    nodes = written(classes.where(F.col("pivot").isNotNull()).join(copies.hint("merge"), "key"), "class-nodes")
    with small_batches(docs.sparkSession):
        apart = written(distances(docs, nodes.select("pivot", "node"), id_col, text_col, s, differences=True), "differences")
    own = nodes.where(F.col("node") == F.col("pivot")).select("comp", "node", "n", "w", F.array().cast("array<long>").alias("diff"))
    return nodes.where(F.col("node") != F.col("pivot")).select("comp", "node", "w").join(apart.hint("merge"), "node").select("comp", "node", "n", "w", "diff").unionByName(own)


def class_links(rows: DataFrame, s: Setting, pairs: bool) -> DataFrame:
    """All links inside classes, from class_differences(): (a, b, common, n_a, n_b) with a < b, or, without ``pairs``, (node, links), how many rows link to
    the node, summed in parts.

    Two sets link if their symmetric difference is at most g * (n_a + n_b), g = (den - num) / (den + num). By the triangle inequality it is at most the sum
    of their differences from the pivot; so nodes with a difference of at most g * n (the core) all link with each other and are
    only counted. The others meet the core and one another in cells of ``block`` by ``block`` nodes. For ``pairs`` all nodes go to cells.
    """
    core = F.lit(False) if pairs else F.lit(s.den + s.num) * F.size("diff") <= F.lit(s.den - s.num) * F.col("n")
    rows = rows.withColumn("core", core)
    sums = rows.groupBy("comp").agg(F.coalesce(F.sum(F.when(F.col("core"), F.col("w"))), F.lit(0)).alias("core_w"), F.ceil(F.count_if("core") / s.block).cast("int").alias("cores"), F.ceil(F.count_if(~F.col("core")) / s.block).cast("int").alias("rests"))
    rows = written(rows.withColumn("_salt", salt_of(s.salts, "node")).join(salted(sums, s.salts).hint("merge"), ["comp", "_salt"]).drop("_salt"), "class-rows")
    k = F.pmod(F.xxhash64("node"), F.when(F.col("core"), F.col("cores")).otherwise(F.col("rests"))).cast("int")
    cell = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    within = F.transform(upto(F.col("rests")), lambda o: cell(0, F.least(F.col("k"), o), F.greatest(F.col("k"), o), F.col("k") > o))
    to_core = F.transform(upto(F.col("cores")), lambda o: cell(1, F.col("k"), o, F.lit(0)))
    from_core = F.transform(upto(F.col("rests")), lambda o: cell(1, o, F.col("k"), F.lit(1)))
    dealt = rows.withColumn("k", k).select("comp", "node", "n", "w", "diff", F.explode(F.when(F.col("core"), from_core).otherwise(F.concat(within, to_core))).alias("c")).select("comp", "c.*", "node", "n", "w", "diff")

    def compare(held: list) -> pd.DataFrame | None:
        kind, i, j = held[0][1:4]
        across = kind == 1 or i != j
        sides = [[r for r in held if r[4] == side] for side in (0, 1)]
        left, right = sides[0], sides[1] if across else sides[0]
        if not left or not right or len(left) + len(right) < 2:
            return None
        diffs = [[np.asarray(r[8], np.int64) for r in side] for side in (left, right)]
        shared = common_counts(diffs[0], diffs[1] if across else None)
        n = [np.array([r[6] for r in side], np.int64) for side in (left, right)]
        d = [np.array([len(x) for x in side], np.int64) for side in diffs]
        both, apart = n[0][:, None] + n[1][None, :], d[0][:, None] + d[1][None, :] - 2 * shared
        linked = (s.den + s.num) * apart <= (s.den - s.num) * both
        ids = [np.array([r[5] for r in side], np.int64) for side in (left, right)]
        linked &= ids[0][:, None] != ids[1][None, :]
        if pairs:
            p, q = np.nonzero(linked if across else np.triu(linked))
            a, b, swap = ids[0][p], ids[1][q], ids[0][p] > ids[1][q]
            return pd.DataFrame({"a": np.where(swap, b, a), "b": np.where(swap, a, b), "common": (both - apart)[p, q] // 2, "n_a": np.where(swap, n[1][q], n[0][p]), "n_b": np.where(swap, n[0][p], n[1][q])})
        w = [np.array([r[7] for r in side], np.int64) for side in (left, right)]
        out = pd.DataFrame({"node": ids[0], "links": linked.astype(np.int64) @ w[1]})
        return pd.concat((out, pd.DataFrame({"node": ids[1], "links": linked.T.astype(np.int64) @ w[0]}))) if across else out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come sorted by cell; only the cell at hand is held, and small results are sent together.
        at, held, made, size = None, [], [], 0
        for batch in batches:
            for r in zip(*(batch[c].to_numpy() for c in columns), strict=True):
                if r[:4] != at:
                    if held and (out := compare(held)) is not None:
                        made.append(out)
                        size += len(out)
                        if size > 10_000:
                            yield pd.concat(made)
                            made, size = [], 0
                    at, held = r[:4], []
                held.append(r)
        if held and (out := compare(held)) is not None:
            made.append(out)
        if made:
            yield pd.concat(made)

    columns = ["comp", "kind", "i", "j", "side", "node", "n", "w", "diff"]
    names = ["a", "b", "common", "n_a", "n_b"] if pairs else ["node", "links"]
    met = dealt.select(*columns).repartition(*columns[:4]).sortWithinPartitions(*columns[:4]).mapInPandas(run, ", ".join(f"{c} long" for c in names))
    if pairs:
        return met
    return met.unionByName(rows.where("core").select("node", (F.col("core_w") - F.col("w")).alias("links")))


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", setting: Setting | None = None) -> tuple[DataFrame, DataFrame]:
    """The whole join: (a, b, common, n_a, n_b) for every pair a < b of different sets that link, each under the smallest id that has it,
    and (id, node) for each row: the id that stands for its set, null for empty sets and null ids. Copies are links through their common node."""
    s = setting or Setting()
    sig, classes = _tables(docs, id_col, text_col, s)
    members = _members(sig, classes, s).select(F.col("doc").alias(id_col), F.when(F.col("doc").isNotNull(), F.col("node")).alias("node"))
    return class_links(class_differences(docs, sig, classes, id_col, text_col, s), s, True).distinct(), members


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", setting: Setting | None = None) -> DataFrame:
    """jaccard_classes() with ``n_links`` for each row: how many other rows its set links with, copies of it included.

    All pairs of different sets in a class are decided, on whole sets; links cannot leave a class. Rows that share id and set count once.
    Empty sets have no links; a null id takes no part and has null.
    """
    s = setting or Setting()
    sig, classes = _tables(docs, id_col, text_col, s)
    with small_batches(docs.sparkSession):
        links = written(class_links(class_differences(docs, sig, classes, id_col, text_col, s), s, False).groupBy("node").agg(F.sum("links").alias("links")), "class-links")
    counted = classes.join(links.hint("merge"), "node", "left")
    copies = sig.where(F.col("doc").isNotNull() & (F.col("n") > 0)).select("key", "doc").distinct().groupBy("key").agg((F.count(F.lit(1)) - 1).alias("copies"))
    counted = counted.join(copies.hint("merge"), "key").select("key", "comp", (F.coalesce("links", F.lit(0)) + F.col("copies")).alias("links"))
    out = _members(sig, written(counted, "counted"), s)
    known = lambda c: F.when(F.col("doc").isNotNull(), c)
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), known(F.coalesce("comp", "doc")).alias("component_id"), known(F.coalesce("links", F.lit(0))).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", setting: Setting | None = None) -> DataFrame:
    """``docs`` with one row of each class, that with the smallest id; rows with a null id stay; rows that share that smallest id all stay.

    The ids that go are written and counted; texts are shuffled only if they are too many to broadcast.
    """
    s = setting or Setting()
    classes = jaccard_classes(docs.select(id_col, text_col), id_col, text_col, s)
    gone = classes.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone_id")).distinct()
    return without_ids(docs, id_col, gone, s.broadcast_rows)


def op3(spark, sf_dir: str) -> DataFrame:
    """op3_jaccard_join over the whole documents table, with the links of each document: 4-word shingles, similarity 0.85."""
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
