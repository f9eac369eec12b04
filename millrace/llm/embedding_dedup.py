"""Embedding near-duplicates by Euclidean p-stable hashing and exact cosines.

Unit vectors are projected on Gaussian directions; projections are shifted,
divided by a width and rounded down, and so many of them together name a bucket
in each of several tables. Vectors that share a bucket are compared exactly.

Equal vectors are one node with a count from the start, known by a 128-bit hash.
A bucket is compared in square blocks by matrix products: no pair of rows is
ever emitted, only a sum of links for each vector and a spanning forest for each
block. A bucket of any size is therefore worked on whole, by as many tasks as it
has pairs of blocks. Vectors travel as they are stored (mostly in single
precision) and are compared in double precision; pairs that an earlier table has
compared are left out before the product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_hot, table
from .components import components

COSINE = 0.98
#: Width of a projection's cells, for unit vectors.
WIDTH = 2.0
#: Share of the pairs just at the cosine that all tables together may miss.
MISSED = 0.001
#: Vectors of a block, at least; blocks a bucket is cut into before blocks become larger, up to GROWTH times that.
BLOCK, BLOCKS, GROWTH = 256, 16, 32


def _same_cell(distance: float, width: float) -> float:
    """Probability that two points at a distance fall in one cell of a random projection."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def plan(n: int, cosine: float = COSINE, width: float = WIDTH, missed: float = MISSED) -> tuple[int, int]:
    """(projections in a table, tables) for n vectors that are compared with each other.

    So many projections that an unrelated vector shares a bucket with 1 / 4 of
    another on average, and so many tables that a pair just at the cosine is
    missed by all with probability ``missed``.
    """
    near, far = _same_cell(math.sqrt(2 - 2 * cosine), width), _same_cell(math.sqrt(2), width)
    k = max(4, math.ceil(math.log(4 * max(n, 1)) / -math.log(far)))
    return k, math.ceil(math.log(missed) / math.log1p(-(near**k)))


@lru_cache(maxsize=8)
def _directions(dim: int, k: int, tables: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([dim, k, tables, 20])
    return rng.standard_normal((dim, k * tables)), rng.uniform(0, width, k * tables)


def _codes(x: np.ndarray, k: int, tables: int, width: float) -> np.ndarray:
    """A 64-bit number for the bucket of each unit vector in each table."""
    a, shift = _directions(x.shape[1], k, tables, width)
    cells = np.floor((x @ a + shift) / width).astype(np.int64).astype(np.uint64).reshape(len(x), tables, k)
    odd = np.random.default_rng(21).integers(1 << 62, size=k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mixed = (cells * odd).sum(axis=2, dtype=np.uint64)
    return (mixed ^ (mixed >> np.uint64(29))).view(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length as unit vectors in double precision."""
    n = len(column)
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _roots(parent: np.ndarray) -> np.ndarray:
    """The end of the way up from each place."""
    while True:
        above = parent[parent]
        if (above == parent).all():
            return above
        parent = above


def find_links(nodes: DataFrame, cosine: float = COSINE, width: float = WIDTH, missed: float = MISSED, block: int = BLOCK) -> DataFrame:
    """Links between ``nodes(node, label, embedding, copies)``: ``(node, other, links)``.

    ``links`` sums the copies of the nodes linked with ``node`` that a block
    found; ``other`` is the node's parent in the block's forest of links, or
    null. Each linked pair is counted in the first table that has both in one
    bucket.
    """
    most = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    k, tables = plan(most, cosine, width, missed)

    def hash_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = np.diff(b.column(2).offsets.to_numpy())
            for dim in np.unique(lengths):
                (at,) = np.nonzero(lengths == dim)
                part = b.take(pa.array(at))
                codes = _codes(_matrix(part.column(2)), k, tables, width)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, tables, dtype=np.int32)), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), part.column(3), pa.array(np.full(len(at), dim, np.int32)), flat], ["node", "label", "embedding", "copies", "dim", "codes"])

    stored = nodes.schema["embedding"].dataType.simpleString()
    hashed = cut(nodes.select("node", "label", "embedding", "copies").mapInArrow(hash_, f"node long, label string, embedding {stored}, copies long, dim int, codes array<long>"), "codes")
    placed = hashed.select("node", F.posexplode("codes").alias("t", "code"), "label", "dim").select("node", "t", F.xxhash64("t", "code", "label", "dim").alias("bucket"))
    crowded = placed.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    width = F.greatest(F.lit(block), F.least(F.col("m") / BLOCKS, F.lit(GROWTH * block)))
    rows = placed.join(crowded, "bucket").withColumn("blocks", F.ceil(F.col("m") / width))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("bucket", "t", "node", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    # of the codes those of earlier tables are needed
    full = rows.join(hashed, "node").withColumn("codes", F.slice("codes", F.lit(1), F.col("t")))

    def compare(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        t, i, j = part["t"][0].as_py(), part["i"][0].as_py(), part["j"][0].as_py()
        node, side, copies = part["node"].to_numpy(), part["own"].to_numpy(), part["copies"].to_numpy()
        label = part["label"].combine_chunks().dictionary_encode().indices.to_numpy() * 100_000 + part["dim"].to_numpy()
        codes = part["codes"].combine_chunks().flatten().to_numpy().reshape(len(node), t)
        links, parent = np.zeros(len(node), np.int64), np.arange(len(node))

        for kind in np.unique(label):  # one, unless two buckets have one hash
            (at,) = np.nonzero(label == kind)
            x = _matrix(part["embedding"].take(pa.array(at)).combine_chunks())
            left = at if i == j else at[side[at] == i]
            right = at if i == j else at[side[at] == j]
            back = np.zeros(len(node), np.int64)
            back[at] = np.arange(len(at))
            for p in range(0, len(left), BLOCK):
                for q in range(p if i == j else 0, len(right), BLOCK):
                    a, b = left[p : p + BLOCK], right[q : q + BLOCK]
                    new = a[:, None] < b if i == j else np.ones((len(a), len(b)), dtype=bool)
                    for s in range(t):
                        new &= codes[a, s][:, None] != codes[b, s]
                    some = new.any(axis=1)
                    if not some.any():
                        continue
                    a, new = a[some], new[some]
                    r, c = np.nonzero(new & (x[back[a]] @ x[back[b]].T >= cosine))
                    r, c = a[r], b[c]
                    np.add.at(links, r, copies[c])
                    np.add.at(links, c, copies[r])
                    # a forest needs no pair whose ends are joined already
                    while len(r):
                        parent = _roots(parent)
                        apart = parent[r] != parent[c]
                        r, c = r[apart], c[apart]
                        np.minimum.at(parent, np.maximum(parent[r], parent[c]), np.minimum(parent[r], parent[c]))
        (found,) = np.nonzero(links)
        other = node[_roots(parent)[found]]
        return pa.table({"node": pa.array(node[found]), "other": pa.array(other), "links": pa.array(links[found])})

    return full.groupBy("bucket", "t", "i", "j").applyInArrow(compare, "node long, other long, links long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, **options) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row of ``vectors(vec_id, embedding, label)``.

    Rows are compared if their labels are equal and not null and their vectors
    equally long. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing; such a row is its own component. Rows with
    equal vectors are linked; n_links counts rows, so a repeated row is
    another. component_id is the smallest id that links reach (rows without
    an id have none to give); kept is whether that is the row's own. An empty
    table gives an empty one; other columns are ignored.
    """
    kind = vectors.schema["embedding"].dataType.simpleString()
    stored = F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), stored.alias("embedding"))
    limit = F.lit(float("inf"))
    sound = F.forall("embedding", lambda x: F.coalesce((x < limit) & (x > -limit), F.lit(False))) & F.exists("embedding", lambda x: x != 0)
    sound = F.col("label").isNotNull() & F.coalesce(sound, F.lit(False))
    rows = rows.withColumn("key", F.when(sound, F.struct(F.xxhash64("label", "embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding", "label").alias("h2"))))
    keyed = cut(rows.select("vec_id", "key"), "vector-keys")
    distinct = rows.where("key is not null").groupBy("key").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    nodes = cut(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")
    found = cut(find_links(nodes, cosine, **options), "vector-links")
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    members = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    names = nodes.select("node", "key", "copies", "first_id")
    size = names.agg(F.count("*").alias("nodes"), F.sum("copies").alias("rows")).first()
    first = members.join(names.select("node", "first_id"), "node").groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("k"))
    named = join_hot(members, first, "component", "k", size["nodes"]).select("node", "component_id")
    known = names.join(sums, "node", "left").join(named, "node", "left").select(
        "key", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "first_id").alias("component_id")
    )
    out = join_hot(keyed, known, "key", "copies", size["rows"] or 0, "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: All links by brute force; the hashing finds a stated share of them, near enough all.
ORACLE = """
with recursive v as (
  select row_number() over () as r, vec_id, label, embedding::double[] as x,
    label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda y: y is null or not isfinite(y))) = 0 and len(list_filter(embedding, lambda y: y <> 0)) > 0 as sound from embeddings),
u as (select * from v where sound),
links as (
  select a.r as a, b.r as b from u a join u b on a.label = b.label and len(a.x) = len(b.x) and a.r <> b.r
  where list_dot_product(a.x, b.x) >= 0.98 * sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))),
reach as (select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a),
n as (select a, count(*) as n from links group by 1),
c as (select reach.a, min(v.vec_id) as least from reach join v on v.r = reach.b group by 1)
select vec_id, coalesce(n, 0)::bigint as n_links, least(vec_id, c.least) as component_id, vec_id is not distinct from least(vec_id, c.least) as kept
from v left join n on v.r = n.a left join c on v.r = c.a
"""
