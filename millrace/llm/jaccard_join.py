"""N-gram Jaccard join in metric space.

Jaccard distance is a metric on shingle sets, so a set near a pivot cannot be
near a set far from it. Texts of a corpus, however, are nearly all at distance
one from each other: between them no pivot tells anything apart, and a window of
twice the distance sought takes in everything. The coarse regions are therefore
formed by counting, the fine ones by pivots.

1. Shingles are put in one order for all sets, those known to be common last. If
   two sets are linked, then of their first shingles, as many as can differ and
   ``least_shared`` more, that many are common to both. A set of which fewer are
   held by any other set links with nothing and goes. What is left are the sets
   with a near neighbour and a few more; those of a ring that share first
   shingles form a region.
2. Under the metric |x - y| (size of the symmetric difference) around the empty
   set, a set's distance is its size. Regions are rings of sizes; the window of
   sets below a ring that may be linked with sets in it is replicated into it.
3. Within a region pivots are chosen, each the set farthest from those before,
   and every set is compared with them exactly. A set nearer than FAR to a pivot
   goes to the Voronoi cell of the nearest, and is replicated to each cell whose
   pivot is at most twice the distance sought farther. The others form a cell
   of their own, into which those are replicated that are nearer by the distance
   sought at most: the triangle inequality lets no link escape. Cells are
   joined recursively. Sets that a chain of links already connects are not
   compared, nor are those that sizes, the triangle inequality over the pivots
   or the count of first shingles in common keep apart.

A region too large for one task is divided in the same way, by tasks that each
compare a block of it with its pivots, again and again while cells become
smaller. What cannot be divided is tight: pivots connect the bulk of it, and it is
joined in blocks, all its sets against those not connected with the bulk. Equal
sets are one node from the start. All this is exact, up to the equality of
64-bit hashes of shingles and 128-bit hashes of sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bloom
from .common import again, cut, giving_back, join_hot, release, table
from .components import components
from .words import Words, chunks, mix

#: Words of a shingle; linked sets have SIMILAR hundredths of their union in common.
WORDS = 3
SIMILAR = 90
#: Shingles are put last if at least COMMON of the sampled texts hold them; one
#: text in SAMPLED is sampled. That changes how much work is done, not its result.
SAMPLED, COMMON = 16, 3
#: The table of common shingles has 2 ** COMMON_BITS bits (2 MB), on which others may fall. One bit of SPARSE is
#: set at most: where more shingles are common, those with the highest counts, so the table fills up at no size.
COMMON_BITS, SPARSE = 24, 32
#: Ratio of the sizes at a ring's borders, at least; more where linked sizes differ more.
RING = 1.3
#: Bytes of sets that one task holds for each side of a comparison.
BLOCK_BYTES = 24_000_000
#: Pivots of a region, and sets that are compared without pivots.
PIVOTS = 8
LEAF = 4
#: Pivots by which a region that is too large for a task is divided.
DIVIDERS = 32
#: Cells are smaller work only if the largest has at most this share of the region.
SMALLER = 0.7

_U = np.uint64
_FIRST, _SECOND = _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a chunk; A-Z count as a-z."""
    w = Words(data, offsets)
    h, doc = w.hash, w.doc
    n = w.counts()
    first = np.concatenate(([0], np.cumsum(n)))
    run = h.copy()
    for k in range(1, words):  # run[i] covers words i to i + k, of one text while i + k is in it
        run[:-k] = mix(run[:-k] * _U(3) + h[k:])
    out = []
    for i in range(w.n_docs):
        a, b = first[i], first[i + 1]
        if b - a >= words:
            out.append(np.unique(run[a : b - words + 1]))
        elif b > a:
            short = h[a : a + 1]
            for k in range(a + 1, b):
                short = mix(short * _U(3) + h[k : k + 1])
            out.append(mix(short + _U(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def least_shared(n, similar: int):
    """Shingles that two linked sets have in common at their beginnings, for sizes n or larger."""
    return np.maximum(1, n - -(-similar * n // 100))


def beginning(s: np.ndarray, common: np.ndarray, similar: int = SIMILAR) -> np.ndarray:
    """The set's first shingles: as many as a linked set may lack, and ``least_shared`` more; common ones come last."""
    n = len(s)
    k = n - -(-similar * n // 100) + int(least_shared(n, similar))
    at = s & _U(8 * len(common) - 1)
    late = (common[at >> _U(3)] >> (at & _U(7)).astype(np.uint8) & 1).astype(bool)
    first = s[~late][:k]
    return first if len(first) == k else np.concatenate((first, s[late][: k - len(first)]))


def _set_hash(s: np.ndarray) -> tuple[int, int]:
    sums = np.array([mix(s ^ salt).sum(dtype=np.uint64) for salt in (_FIRST, _SECOND)])
    a, b = mix(sums + _U(len(s))).view(np.int64)
    return int(a), int(b)


def linked(common: np.ndarray, n: np.ndarray, m, similar: int) -> np.ndarray:
    return 100 * common >= similar * (n + m - common)


class Region:
    """Sets that are joined in memory; ``root`` tells which are connected."""

    def __init__(self, sets: list[np.ndarray], common: np.ndarray, similar: int = SIMILAR):
        self.sets, self.similar, self.late = sets, similar, common
        self.n = np.array([len(s) for s in sets])
        self.parent = np.arange(len(sets))
        self.reach = 1 - similar / 100 + 1e-12

    def index(self) -> None:
        """Which sets hold each shingle that is among the first of two sets or more."""
        first = [beginning(x, self.late, self.similar) for x in self.sets]
        flat, owner = np.concatenate(first), np.repeat(np.arange(len(first)), [len(x) for x in first])
        order = np.lexsort((owner, flat))
        flat, owner = flat[order], owner[order]
        start = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
        size = np.diff(np.concatenate((start, [len(flat)])))
        of = np.repeat(np.arange(len(start)), size)
        shared = (size > 1)[of]
        self.owners, self.start, self.size = owner, start, size
        by_set = np.argsort(owner[shared], kind="stable")
        self.groups = of[shared][by_set]
        self.group_at = np.searchsorted(owner[shared][by_set], np.arange(len(first) + 1))
        self.need = least_shared(-(-self.similar * self.n // 100), self.similar)

    def sharing(self, x: int) -> np.ndarray:
        """The sets that have as many first shingles in common with x as linked sets must."""
        mine = self.groups[self.group_at[x] : self.group_at[x + 1]]
        if not len(mine):
            return mine
        sizes = self.size[mine]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.start[mine] - (ends - sizes), sizes)
        other, k = np.unique(self.owners[at], return_counts=True)
        return other[(k >= np.minimum(self.need[other], self.need[x])) & (other != x)]

    def root(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def roots(self, members: np.ndarray) -> np.ndarray:
        return np.array([self.root(x) for x in members])

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def common(self, x: np.ndarray, members: np.ndarray) -> np.ndarray:
        """Shingles that each member shares with the set x."""
        if not len(members):
            return np.zeros(0, np.int64)
        flat = np.concatenate([self.sets[i] for i in members])
        at = np.minimum(np.searchsorted(x, flat), len(x) - 1)
        ends = np.cumsum(self.n[members])
        below = np.concatenate(([0], np.cumsum(x[at] == flat)))
        return below[ends] - below[ends - self.n[members]]

    def against(self, x: int, members: np.ndarray) -> np.ndarray:
        """Distances of x to the members; those within reach are joined with it."""
        common = self.common(self.sets[x], members)
        for y in members[linked(common, self.n[members], self.n[x], self.similar)]:
            self.join(x, y)
        return 1 - common / (self.n[members] + self.n[x] - common)

    def solve(self, members: np.ndarray | None = None) -> None:
        """Connects all linked members, by pivots, cells, windows and recursion."""
        self.index()
        todo = [np.arange(len(self.sets)) if members is None else members]
        while todo:
            members = todo.pop()
            if len(members) < 2:
                continue
            if len(members) <= LEAF:
                self.compare(members, np.zeros((len(members), 0)))
                continue
            d = self.pivots(members)
            if len(np.unique(self.roots(members))) == 1:
                continue
            cells = [members[inside] for inside in self.cells(d).T]
            if sum(map(len, cells)) > 2 * len(members) or max(map(len, cells)) > SMALLER * len(members):
                self.compare(members, d)
            else:
                todo += cells

    def pivots(self, members: np.ndarray) -> np.ndarray:
        """Distances of the members to pivots among them, each the one farthest from those before; all within reach are joined."""
        x = members[np.argmax(self.n[members])]
        columns: list[np.ndarray] = []
        near = np.full(len(members), 2.0)
        while len(columns) < PIVOTS and near.max() > self.reach:
            columns.append(self.against(x, members))
            near = np.minimum(near, columns[-1])
            x = members[np.argmax(near)]
        return np.column_stack(columns)

    def cells(self, d: np.ndarray) -> np.ndarray:
        """Which members, at distances d from the pivots, are in the cell of each pivot, and last in that of those far from all."""
        near = d.min(axis=1, keepdims=True)
        far = 1 - 2 * self.reach
        inside = (d <= near + 2 * self.reach) & (near < far)
        beyond = near >= far - self.reach if (near >= far).any() else np.zeros_like(near, dtype=bool)
        return np.concatenate((inside, beyond), axis=1)

    def compare(self, members: np.ndarray, d: np.ndarray) -> None:
        """Every two members that are not connected, unless something keeps them apart; d has distances to pivots."""
        roots = self.roots(members)
        names, counts = np.unique(roots, return_counts=True)
        loose = np.flatnonzero(roots != names[np.argmax(counts)])
        place = np.full(len(self.sets), -1)
        place[members] = np.arange(len(members))
        for i in loose:
            x = members[i]
            at = place[self.sharing(x)]
            self.verify(x, members, at[at >= 0], d[i], d)

    def verify(self, x: int, members: np.ndarray, at: np.ndarray, own: np.ndarray, d: np.ndarray) -> None:
        """Compares x, at distances ``own`` from pivots, with members[at] as far as need be."""
        at = at[self.candidates(self.n[x], own, self.n[members[at]], d[at])]
        if len(at):
            at = at[self.roots(members[at]) != self.root(x)]
            if len(at):
                self.against(x, members[at])

    def candidates(self, n: int, d: np.ndarray, sizes: np.ndarray, distances: np.ndarray) -> np.ndarray:
        """Which sets the sizes and the triangle inequality do not keep apart from one of size n at distances d."""
        near = 100 * np.minimum(sizes, n) >= self.similar * np.maximum(sizes, n)
        if distances.shape[1]:
            near &= np.abs(distances - d).max(axis=1) <= self.reach
        return near


def _sets(column) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), dtype=np.uint64) for x in column]


def _links(node: np.ndarray, region: Region) -> pa.Table:
    roots = region.roots(np.arange(len(node)))
    own = np.flatnonzero(roots != np.arange(len(node)))
    return pa.table({"a": pa.array(node[roots[own]], pa.int64()), "b": pa.array(node[own], pa.int64())})


def _solve(part: pa.Table, common: np.ndarray, similar: int) -> pa.Table:
    region = Region(_sets(part["shingles"]), common, similar)
    region.solve()
    return _links(part["node"].to_numpy(), region)


def _least_nodes(rows: DataFrame, pivots: int) -> DataFrame:
    """The pivots of each region of ``rows(region, block, blocks, node, shingles)``, by the least hashes of nodes, for each of its blocks."""
    # each block gives as many as are wanted in all, if it has them
    own = Window.partitionBy("region", "block").orderBy("h", "node")
    first = rows.select("region", "block", "node", F.xxhash64("node", F.lit(5)).alias("h")).withColumn("k", F.row_number().over(own)).where(F.col("k") <= pivots)
    last = Window.partitionBy("region").orderBy("h", "node")
    least = first.withColumn("k", F.row_number().over(last)).where(F.col("k") <= pivots).select("region", "node")
    chosen = rows.join(least, ["region", "node"])
    return chosen.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("region", "block", "node", "shingles")


def _in_blocks(sets: DataFrame, block_bytes: int, *more: str) -> DataFrame:
    """The rows of ``sets(region, node, shingles, bytes)`` with the number of their region's blocks and their own."""
    blocks = F.ceil(F.col("bytes") / block_bytes)
    return sets.select("region", "node", "shingles", blocks.alias("blocks"), *more).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))


def _divide(sets: DataFrame, common: np.ndarray, similar: int, block_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links with the pivots of the regions of ``sets(region, node, n, shingles, bytes)``, the cells as new regions, and the regions whose cells would be no smaller work."""
    rows = cut(_in_blocks(sets, block_bytes, "n", "bytes"), "regions")

    def near_pivots(part: pa.Table, pivot: pa.Table) -> pa.Table:
        names, own = pivot["node"].to_numpy(), part["node"].to_numpy()
        region = Region([*_sets(pivot["shingles"]), *_sets(part["shingles"])], common, similar)
        at = np.arange(len(names), len(names) + len(own))
        inside = region.cells(np.column_stack([region.against(p, at) for p in range(len(names))]))
        found = _links(np.concatenate((names, own)), region)
        who, cell = np.nonzero(inside)
        return pa.concat_tables([found, pa.table({"region": part["region"].take(pa.array(who)), "node": pa.array(own[who], pa.int64()), "cell": pa.array(cell, pa.int32())})], promote_options="default").select(["a", "b", "region", "node", "cell"])

    out = cut(rows.groupBy("region", "block").cogroup(_least_nodes(again(rows), DIVIDERS).groupBy("region", "block")).applyInArrow(near_pivots, "a long, b long, region long, node long, cell int"), "cells")
    placed = out.where("cell is not null").select("region", "node", "cell").join(again(rows).select("region", "node", "n", "bytes"), ["region", "node"])
    sizes = cut(placed.groupBy("region", "cell").agg(F.sum(F.col("n") * 8).alias("cell_bytes"), F.first("bytes").alias("bytes"), F.count("*").alias("k")), "cell-sizes")
    whole = F.col("bytes")
    facts = sizes.groupBy("region").agg(F.sum("cell_bytes").alias("all"), F.max("cell_bytes").alias("most"), F.first("bytes").alias("bytes"), F.sum("k").alias("k"))
    good = facts.select("region", "k", ((F.col("all") <= 2 * whole) & (F.col("most") <= SMALLER * whole)).alias("good"))
    judged = cut(join_hot(again(rows).select("region", "node", "n", "shingles", "bytes"), good, "region", "k", facts.agg(F.sum("k")).first()[0]), "regions")
    cells = out.where("cell is not null").select("region", "node", "cell").join(judged.where("good").select("region", "node", "n", "shingles"), ["region", "node"])
    cells = cells.select(F.xxhash64("region", "cell").alias("region"), "node", "n", "shingles")
    named = again(sizes).select(F.xxhash64("region", "cell").alias("region"), F.col("cell_bytes").alias("bytes"), "k")
    total = again(sizes).agg(F.sum("k")).first()[0]
    return out.where("a is not null").select("a", "b"), cut(join_hot(cells, named, "region", "k", total), "region-sets"), again(judged).where("not good").drop("good")


def _large_regions(sets: DataFrame, common: np.ndarray, similar: int, block_bytes: int) -> DataFrame:
    """Links ``(a, b)`` that connect what is linked in regions of ``sets(region, node, shingles, bytes)`` too large for a task."""
    rows = cut(_in_blocks(sets, block_bytes, F.octet_length("shingles").alias("size")), "large-regions")
    pivots = _least_nodes(again(rows), PIVOTS)

    def near_pivots(part: pa.Table, pivot: pa.Table) -> pa.Table:
        names, own = pivot["node"].to_numpy(), part["node"].to_numpy()
        region = Region([*_sets(pivot["shingles"]), *_sets(part["shingles"])], common, similar)
        at = np.arange(len(names), len(names) + len(own))
        for p in range(len(names)):
            region.against(p, at)
        return _links(np.concatenate((names, own)), region)

    first = cut(rows.groupBy("region", "block").cogroup(pivots.groupBy("region", "block")).applyInArrow(near_pivots, "a long, b long"), "pivot-links")
    named = components(first)
    labelled = rows.join(named, "node", "left").withColumn("label", F.coalesce("component", "node"))
    sizes = labelled.groupBy("region", "label").agg(F.count("*").alias("k"), F.sum("size").alias("b"))
    bulk = sizes.groupBy("region").agg(F.max_by("label", F.struct("k", "label")).alias("bulk"), F.sum("b").alias("all"), F.max(F.struct("k", "label", "b")).alias("top"), F.sum("k").alias("k"))
    facts = bulk.select("region", "bulk", "k", F.ceil((F.col("all") - F.col("top.b")) / block_bytes).alias("chunks")).where("chunks > 0")
    whole = cut(join_hot(labelled, facts, "region", "k", again(rows).count()).select("region", "node", "shingles", "label", "blocks", "block", "chunks", (F.col("label") != F.col("bulk")).alias("loose")), "labelled")
    left = whole.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).select("region", "block", "chunk", "node", "label", "shingles")
    right = again(whole).where("loose").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(6)), F.col("chunks"))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("region", "block", "chunk", "node", "label", "shingles")

    def across(part: pa.Table, loose: pa.Table) -> pa.Table:
        """Links between the sets of a block and the loose sets of a chunk that have other labels."""
        own, other = part["node"].to_numpy(), loose["node"].to_numpy()
        if not len(own) or not len(other):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        region = Region([*_sets(part["shingles"]), *_sets(loose["shingles"])], common, similar)
        region.index()
        labels = np.concatenate((part["label"].to_numpy(), loose["label"].to_numpy()))
        for name in np.unique(labels):
            same = np.flatnonzero(labels == name)
            region.parent[same] = same[0]
        at = np.arange(len(own))
        by_size = at[np.argsort(region.n[at], kind="stable")]
        pivots = by_size[np.linspace(0, len(own) - 1, min(PIVOTS, len(own))).astype(int)]
        everyone = np.arange(len(region.sets))
        d = np.column_stack([region.against(p, everyone) for p in pivots])
        for x in range(len(own), len(region.sets)):
            other_side = region.sharing(x)
            region.verify(x, at, other_side[other_side < len(own)], d[x], d[: len(own)])
        return _links(np.concatenate((own, other)), region)

    second = left.groupBy("region", "block", "chunk").cogroup(right.groupBy("region", "block", "chunk")).applyInArrow(across, "a long, b long")
    return first.unionByName(second)


def _common(texts: DataFrame, words: int, bits: int = COMMON_BITS) -> np.ndarray:
    """Bits, eight to a byte, by the last bits of a shingle's hash: whether it is common in a sample of distinct texts."""

    @giving_back
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, data, offsets in chunks(b.column(0)):
                at, k = np.unique(np.concatenate(shingles(data, offsets, words)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(k.astype(np.int64))], ["shingle", "k"])

    sample = texts.where(F.pmod("text_hash", F.lit(SAMPLED)) == 0).groupBy("text_hash").agg(F.first("text").alias("text")).select("text")
    counts = sample.mapInArrow(found, "shingle long, k long").groupBy("shingle").agg(F.sum("k").alias("k")).where(F.col("k") >= COMMON)
    counts = cut(counts.select("shingle", F.floor(8 * F.log2("k")).cast("int").alias("level")), "common")
    least, room = None, (1 << bits) // SPARSE
    for level, n in sorted(map(tuple, counts.groupBy("level").count().collect()), reverse=True):
        if n > room:
            break
        least, room = level, room - n
    chosen = counts.where(F.col("level") >= least) if least is not None else counts.limit(0)
    slot = F.col("shingle").bitwiseAND(F.lit((1 << bits) - 1))
    filled = chosen.groupBy(F.shiftright(slot, 5).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.expr("1L"), slot.bitwiseAND(F.lit(31)).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 5), dtype=np.uint32)
    out[filled["at"].to_numpy()] = filled["bits"].to_numpy().astype(np.uint32)
    release(counts)
    return out.view(np.uint8)


def clusters(docs: DataFrame, similar: int = SIMILAR, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, common_bits: int = COMMON_BITS) -> DataFrame:
    """``(doc_id, text_hash, n_shingles, cluster, component_id)`` for each row of ``docs``.

    ``cluster`` is a number for the rows that links connect, null for a text
    without shingles; the rest is as :func:`join` has it.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    keyed = own.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    common = _common(keyed, words, common_bits)

    @giving_back
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = TaskContext.get().partitionId() << 33
        for b in batches:
            for first, data, offsets in chunks(b.column(1)):
                sets = shingles(data, offsets, words)
                hashes = np.array([_set_hash(s) for s in sets], dtype=np.int64)
                sigs = [beginning(s, common, similar).view(np.int64) for s in sets]
                ends = np.cumsum([0, *map(len, sigs)]).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sigs)))
                n = len(sets)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(u, u + n, dtype=np.int64)), b.column(0).slice(first, n), b.column(2).slice(first, n), pa.array([len(s) for s in sets], pa.int64()), pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), flat], ["u", "doc_id", "text_hash", "n", "h1", "h2", "sigs"])
                u += n

    rows = cut(keyed.mapInArrow(sketch, f"u long, doc_id {kind}, text_hash long, n long, h1 long, h2 long, sigs array<long>"), "sketches")
    # equal sets are one node, named by the least number of its rows
    nodes = cut(rows.where("n > 0").groupBy("h1", "h2").agg(F.min("u").alias("node"), F.min("doc_id").alias("first_id"), F.min("n").alias("n"), F.count("*").alias("copies")), "sets")
    # rings of sizes: a set is in its own and, if sets of the next may be linked with it, in that
    ratio = max(RING, 102 / similar)
    ring = F.floor(F.log("n") / np.log(ratio))
    beyond = F.col("n") * 100 >= similar * F.pow(F.lit(ratio), ring + 1) * (1 - 1e-9)
    rings = F.when(beyond, F.array(ring, ring + 1)).otherwise(F.array(ring))
    # the least partner of a set of n has similar hundredths of n
    smallest = F.ceil(F.col("n") * similar / F.lit(100))
    enough = F.greatest(F.lit(1), smallest - F.ceil(smallest * similar / F.lit(100))).cast("int")
    placed = nodes.select("node", F.explode(rings).alias("ring")).select("node", F.xxhash64("node", "ring").alias("id"))

    # shingles that some other set has among its first; false ones that the filter lets through count for nothing below
    held = rows.select(F.col("u").alias("node"), "n", "sigs").join(nodes.select("node"), "node", "left_semi").select("node", "n", F.explode("sigs").alias("sig"))
    hubs = cut(held.groupBy("sig").agg(F.count("*").alias("k")).where("k > 1").select("sig"), "shared")
    log2 = bloom.log2_blocks(hubs.count())
    likely = held.where(bloom.may_hold(bloom.build(hubs, "sig", log2), F.col("sig"), log2))
    hits = cut(likely.select("node", "sig", enough.alias("enough"), F.explode(rings).alias("ring")).select(F.xxhash64("sig", "ring").alias("sig"), F.xxhash64("node", "ring").alias("id"), "enough"), "hits")
    release(hubs)
    # sets that share too little with the others of their ring go
    shared = again(hits).groupBy("sig").agg(F.count("*").alias("k")).where("k > 1").select("sig")
    alive = again(hits).join(shared, "sig", "left_semi").groupBy("id", "enough").agg(F.count("*").alias("k")).where("k >= enough").select("id")
    left = cut(hits.join(alive, "id", "left_semi").select("sig", "id"), "hits")
    release(hits)
    still = again(left).groupBy("sig").agg(F.count("*").alias("k"), F.min("id").alias("low")).where("k > 1").select("sig", "low")
    regions = components(left.join(still, "sig").where("id > low").select(F.col("low").alias("a"), F.col("id").alias("b")))
    inside = cut(regions.select(F.col("node").alias("id"), F.col("component").alias("region")).join(placed.select("id", F.col("node").alias("set_node")), "id").select("region", F.col("set_node").alias("node")), "inside")
    release(left)
    members = cut(nodes.drop("copies").join(again(inside).select("node").distinct(), "node", "left_semi"), "members")

    # the sets themselves, of members only: likely rows by id, then exactly by hash
    ids = members.select(F.col("first_id").cast("string").alias("id"))
    log2 = bloom.log2_blocks(members.count())
    wanted = own.where(F.coalesce(bloom.may_hold(bloom.build(ids, "id", log2), F.col("doc_id").cast("string"), log2), F.lit(True)))

    @giving_back
    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data, offsets in chunks(b.column(1)):
                sets = shingles(data, offsets, words)
                hashes = np.array([_set_hash(s) for s in sets], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(sets)), pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "h1", "h2", "shingles"])

    found = wanted.mapInArrow(full, f"doc_id {kind}, h1 long, h2 long, shingles binary").alias("f")
    m = members.alias("m")
    sets = found.join(m, (F.col("f.h1") == F.col("m.h1")) & (F.col("f.h2") == F.col("m.h2")) & F.col("f.doc_id").eqNullSafe(F.col("m.first_id")))
    sets = sets.select("m.node", "m.n", "f.shingles").groupBy("node", "n").agg(F.first("shingles").alias("shingles"))
    sizes = inside.join(members.select("node", "n"), "node").groupBy("region").agg(F.sum(F.col("n") * 8).alias("bytes"), F.count("*").alias("k"))
    sized = cut(sets.join(join_hot(again(inside), sizes, "region", "k", again(inside).count()), "node"), "region-sets")
    schema = "a long, b long"

    def solve(part: pa.Table) -> pa.Table:
        return _solve(part, common, similar)

    links, held = None, [sized]
    while True:
        small = sized.where(F.col("bytes") <= block_bytes).select("region", "node", "shingles").groupBy("region").applyInArrow(solve, schema)
        links = small if links is None else links.unionByName(small)
        large = sized.where(F.col("bytes") > block_bytes)
        if large.isEmpty():
            break
        found, sized, tight = _divide(large, common, similar, block_bytes)
        links = links.unionByName(found)
        held.append(sized)
        if not tight.isEmpty():
            links = links.unionByName(_large_regions(tight, common, similar, block_bytes))
    joined = components(links)
    release(*held)
    size = nodes.agg(F.count("*").alias("nodes"), F.sum("copies").alias("rows")).first()
    first = joined.join(nodes.select("node", "first_id"), "node").groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("k"))
    named = nodes.join(join_hot(joined, first, "component", "k", size["nodes"]).select("node", "component", "component_id"), "node", "left")
    named = named.select(F.struct("h1", "h2").alias("set"), F.coalesce("component", "node").alias("cluster"), F.coalesce("component_id", "first_id").alias("component_id"), "copies")
    # texts without shingles have no set
    out = rows.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.struct("h1", "h2")).alias("set"))
    out = join_hot(out, named, "set", "copies", size["rows"] or 0, "left")
    return out.select("doc_id", "text_hash", "n_shingles", "cluster", F.coalesce("component_id", "doc_id").alias("component_id"))


def join(docs: DataFrame, similar: int = SIMILAR, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for each row of ``docs``.

    A text's set holds its distinct shingles; of a text with fewer words the
    whole sequence is one. Sets are linked when ``similar`` hundredths of their
    union are common to both. component_id is the smallest id that links reach,
    the own one included; rows without an id have none to give. Null and
    empty texts have no shingles, link with nothing and are their own
    component. Repeated rows are equal and so linked. An empty table gives an
    empty one; other columns are ignored.
    """
    return clusters(docs, similar, words, id_col, text_col, block_bytes).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)`` without all but one of each cluster, in all their columns.

    The row of the least id stays (rows without an id last; of texts with one
    id the least hash). Of repeated rows one stays. Texts without shingles all
    stay. Other columns may have any names and are returned as they are. Rows
    whose id and text no removed row may have are never shuffled.
    """
    rows = cut(clusters(docs, **options).where("cluster is not null"), "clusters")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("h"))
    best = again(rows).groupBy("cluster").agg(F.min(key).alias("best"), F.count("*").alias("k"))
    judged = join_hot(rows, best, "cluster", "k", rows.count()).select("doc_id", "text_hash", (~key.eqNullSafe(F.col("best"))).alias("gone"))
    fates = judged.groupBy("doc_id", "text_hash").agg(F.max("gone").alias("gone"), F.count("*").alias("k")).where("gone or k > 1")
    fates = cut(fates.select(F.col("doc_id").alias("f_id"), F.col("text_hash").alias("f_hash"), "gone", F.xxhash64("doc_id", "text_hash").alias("key")), "fates")
    log2 = bloom.log2_blocks(fates.count())
    # whole rows in a struct, so that none of their names can be taken
    hashed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    maybe = bloom.may_hold(bloom.build(fates, "key", log2), F.xxhash64("id", "hash"), log2)
    sure = hashed.where(~maybe).select("row.*")
    met = hashed.where(maybe).join(fates, (F.col("hash") == F.col("f_hash")) & F.col("id").eqNullSafe(F.col("f_id")), "left")
    alone = met.where("gone is null").select("row.*")
    once = met.where("not gone").dropDuplicates(["f_id", "f_hash"]).select("row.*")
    return sure.union(alone).union(once)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


ORACLE = r"""
with recursive d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select r, doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) end as set_ from d),
e as (select r, len(set_) as n, unnest(set_) as g from s),
links as (select a.r as a, b.r as b from e a join e b on a.g = b.g group by a.r, b.r, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach as (select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a)
select s.doc_id, len(s.set_)::bigint as n_shingles, coalesce(min(o.doc_id), s.doc_id) as component_id
from s left join reach on s.r = reach.a left join s o on o.r = reach.b group by s.r, s.doc_id, s.set_
"""
