"""A Merkle tree over a dataset, with a proof for each row.

Leaves are numbered within their tree (a language) by a range partitioning.
Tasks reduce large blocks of consecutive leaves to one node each, all levels of
a block at once, until few nodes are left. The driver builds the top of the
trees from those, the siblings above each node go to all tasks, and a second
pass over the blocks finishes each row's proof and folds it back to the root.
The driver gets TOP nodes at most: with more, blocks of nodes are reduced by
tasks again, and so is the tree over a large number of languages.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_hot, table
from .order import numbered

#: Children of a node.
FAN = 8
#: Levels that a task reduces at once: a block is 512 leaves or nodes.
LEVELS = 3
#: Nodes that the driver may get. With their siblings (2 kB each) they are what is sent to all tasks.
TOP = 4096

_PATH = "subroot string, root string, lefts array<string>, rights array<string>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """A value as UTF-8 byte count, colon and text; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    h = 0
    while FAN**h < n:
        h += 1
    return h


def climb(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and all levels above them; each node of a level is the digest of a run below."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([digest("".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])
    return out


def siblings(levels: list[list[str]], i: int) -> Iterator[tuple[str, str]]:
    """For the i-th node of the lowest level, what stands left and right of it in its run, level by level."""
    for nodes in levels[:-1]:
        k = i % FAN
        run = nodes[i - k : i - k + FAN]
        yield "".join(run[:k]), "".join(run[k + 1 :])
        i //= FAN


def fold(node: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        node = digest(left + node + right)
    return node


def _in_trees(leaves: DataFrame) -> DataFrame:
    """``tree, pos, n`` beside the columns of leaves that have tree, doc_id and leaf."""
    rows = cut(numbered(leaves, "tree", "doc_id", "leaf", "copy", name="leaves"), "placed")
    trees = rows.groupBy("tree").agg(F.min("rn").alias("start"), F.count("*").alias("n"), F.count("*").alias("k"))
    return join_hot(rows, trees, "tree", "k", rows.count()).withColumn("pos", F.col("rn") - F.col("start"))


def _reduced(nodes: DataFrame, levels: int) -> DataFrame:
    """``(tree, pos, n, hash)`` of the nodes ``levels`` levels above ``(tree, pos, n, hash)``; a root stays."""

    def reduce(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        n = int(block["n"].iloc[0])
        top = climb(block["hash"].tolist(), min(levels, height(n)))[-1]
        return pd.DataFrame({"tree": [key[0]], "pos": [key[1]], "n": [-(-n // FAN**levels)], "hash": top})

    block = F.floor(F.col("pos") / F.lit(FAN**levels)).alias("block")
    return nodes.select("tree", "pos", "n", "hash", block).groupBy("tree", "block").applyInPandas(reduce, "tree string, pos long, n long, hash string")


def _top(nodes: DataFrame) -> dict:
    """For each of few nodes, known by tree and place: subroot, root and siblings up to the root."""
    trees: dict[str, list] = {}
    for r in nodes.collect():
        trees.setdefault(r["tree"], []).append((r["pos"], r["hash"]))
    names = sorted(trees, key=str.encode)
    levels = {t: climb([h for _, h in sorted(trees[t])], height(len(trees[t]))) for t in names}
    above = climb([levels[t][-1][0] for t in names], height(len(names)))
    out = {}
    for i, t in enumerate(names):
        rest = list(siblings(above, i))
        for pos, _ in trees[t]:
            path = [*siblings(levels[t], pos), *rest]
            out[t, pos] = (levels[t][-1][0], above[-1][0], [x for x, _ in path], [x for _, x in path])
    return out


def _with_paths(rows: DataFrame, levels: int, paths: dict | DataFrame, give, schema: str) -> DataFrame:
    """``give(block, [path of each row])`` for each block of rows ``(tree, pos, n, hash, ...)`` below the nodes of ``paths``."""
    spark = rows.sparkSession

    def finish(block: pd.DataFrame, above: tuple) -> pd.DataFrame:
        block = block.sort_values("pos")
        below = climb(block["hash"].tolist(), min(levels, height(int(block["n"].iloc[0]))))
        subroot, root, lefts, rights = above
        rest = list(zip(lefts, rights, strict=True))
        return give(block, subroot, root, [[*siblings(below, i), *rest] for i in range(len(block))])

    keyed = rows.withColumn("block", F.floor(F.col("pos") / F.lit(FAN**levels))).groupBy("tree", "block")
    if isinstance(paths, dict):
        sent = spark.sparkContext.broadcast(paths)
        return keyed.applyInPandas(lambda key, block: finish(block, sent.value[key[0], key[1]]), schema)

    def met(_: tuple, block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        return finish(block, above[["subroot", "root", "lefts", "rights"]].iloc[0])

    return keyed.cogroup(paths.groupBy("tree", "pos")).applyInPandas(met, schema)


def _node_paths(nodes: DataFrame, levels: int, top: int) -> dict | DataFrame:
    """Subroot, root and siblings above each node ``(tree, pos, n, hash)``: a dict of ``top`` entries at most, or a table."""
    size = nodes.agg(F.count("*").alias("all"), F.max("n").alias("most")).first()
    if size["all"] <= top:
        return _top(nodes)
    if size["most"] == 1:  # more trees than the driver may get: their roots are the leaves of one more tree
        roots = numbered(nodes.select("tree", "hash"), "tree", name="subroots").select(F.lit("").alias("tree"), F.col("rn").alias("pos"), F.lit(size["all"]).alias("n"), "hash", F.col("tree").alias("name"))
        roots = cut(roots, "subroots")

        def name(block: pd.DataFrame, _: str, root: str, paths: list) -> pd.DataFrame:
            return pd.DataFrame({"tree": block["name"], "pos": 0, "subroot": block["hash"], "root": root, "lefts": [[x for x, _ in p] for p in paths], "rights": [[x for _, x in p] for p in paths]})

        upper = _node_paths(cut(_reduced(roots, levels), "nodes"), levels, top)
        return cut(_with_paths(roots, levels, upper, name, f"tree string, pos long, {_PATH}"), "paths")

    def go_on(block: pd.DataFrame, subroot: str, root: str, paths: list) -> pd.DataFrame:
        return pd.DataFrame({"tree": block["tree"], "pos": block["pos"], "subroot": subroot, "root": root, "lefts": [[x for x, _ in p] for p in paths], "rights": [[x for _, x in p] for p in paths]})

    upper = _node_paths(cut(_reduced(nodes, levels), "nodes"), levels, top)
    return cut(_with_paths(nodes, levels, upper, go_on, f"tree string, pos long, {_PATH}"), "paths")


def manifest(leaves: DataFrame, id_type: str = "long", levels: int = LEVELS, top: int = TOP) -> DataFrame:
    """Roots, proofs and folds for a table of leaves ``(tree, doc_id, leaf, tampered)``.

    Leaves of a tree ascend by doc_id (null first), those of one id by their
    digest; equal rows are leaves of their own. Trees ascend by name, bytewise.
    ``tampered`` is the digest to fold in place of the leaf, or null. Returns
    doc_id, leaf, subroot, root, proof_sha256 (of all siblings up to the root),
    folded_root and verified. No leaves give no rows.
    """
    written = cut(leaves.select("tree", "doc_id", "leaf", "tampered").withColumn("copy", F.monotonically_increasing_id()), "digests")
    rows = cut(_in_trees(written).select("tree", "pos", "n", F.col("leaf").alias("hash"), "doc_id", "tampered"), "placed")
    paths = _node_paths(cut(_reduced(rows, levels), "nodes"), levels, top)

    def prove(block: pd.DataFrame, subroot: str, root: str, found: list) -> pd.DataFrame:
        proofs = [digest("".join([left + right for left, right in p])) for p in found]
        folded = [fold(t if isinstance(t, str) else h, p) for h, t, p in zip(block["hash"], block["tampered"], found, strict=True)]
        return pd.DataFrame({"doc_id": block["doc_id"], "leaf": block["hash"], "subroot": subroot, "root": root, "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded]})

    return _with_paths(rows, levels, paths, prove, f"doc_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of ``documents`` by lang; where 3 divides the crc32 of the id, ``tampered`` has the text in lower case.

    A null value is a ``-``; a null lang is a tree of its own, the first; a row
    without an id is never tampered with, nor is a null text. Texts are hashed
    whole. Columns other than doc_id, source, lang, n_chars, text are ignored.
    """
    d = docs.select("doc_id", "source", "lang", "n_chars", "text")
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = leaf(*head, F.translate("text", _UPPER, _LOWER))
    tree = F.coalesce(F.concat(F.lit("1"), F.col("lang")), F.lit("0"))
    return d.select(tree.alias("tree"), "doc_id", leaf(*head, F.col("text")).alias("leaf"), F.when(hit, lowered).alias("tampered"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return manifest(document_leaves(docs), docs.schema["doc_id"].dataType.simpleString())


#: Levels of each tree that the SQL has: 8 ** 7 leaves.
_SQL_LEVELS = 7


def _sql() -> str:
    """The same for DuckDB: level by level, a node's run as a list, for the trees and for the tree of their roots."""
    enc = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
    row = lambda text: f"sha256({' || '.join(map(enc, ('doc_id', 'source', 'lang', 'n_chars')))} || {enc(text)})"
    crc = "xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split_regex(regexp_replace(hex(doc_id::varchar::blob), '(..)', '\\1 ', 'g').trim(), ' '), lambda h: [('0x' || h)::bigint, 0, 0, 0, 0, 0, 0, 0]))), lambda c, v: xor(xor(c, v) >> 1, 3988292384 * (xor(c, v) & 1))), 4294967295)"
    parts = [f"""d as (select doc_id, coalesce('1' || lang, '0') as tree, {row('text')} as leaf,
        case when {crc} % 3 = 0 then {row(f"translate(text, '{_UPPER}', '{_LOWER}')")} end as tampered from documents)""",
        "l as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by tree) as n from d)",
        "a0 as (select tree, pos, n, leaf as h from l)"]

    def up(a: str, levels: int) -> None:
        for k in range(levels):
            parts.append(f"{a}r{k} as (select tree, pos // 8 as run, any_value(n) as n, list(h order by pos) as hs from {a}{k} group by all)")
            parts.append(f"{a}{k + 1} as (select tree, run as pos, (n + 7) // 8 as n, case when n = 1 then hs[1] else sha256(array_to_string(hs, '')) end as h from {a}r{k})")

    up("a", _SQL_LEVELS)
    parts.append(f"b0 as (select 0 as tree, row_number() over (order by tree) - 1 as pos, count(*) over () as n, h, tree as name from a{_SQL_LEVELS})")
    up("b", 3)
    parts.append("f0 as (select doc_id, leaf, l.tree, l.pos, b0.pos as tpos, b0.h as subroot, b3.h as root, coalesce(tampered, leaf) as f, '' as proof from l join b0 on b0.name = l.tree cross join b3)")
    k = 0
    for a, at, levels in (("a", "pos", _SQL_LEVELS), ("b", "tpos", 3)):
        for i in range(levels):
            i0, mine = f"(({at} // {8**i}) % 8)", f"{a}r{i}"
            key = "f.tree" if a == "a" else "0"
            before, after = f"array_to_string(hs[1:{i0}], '')", f"array_to_string(hs[{i0} + 2:], '')"
            parts.append(
                f"f{k + 1} as (select f.doc_id, leaf, f.tree, f.pos, tpos, subroot, root, case when n = 1 then f else sha256({before} || f || {after}) end as f, "
                f"case when n = 1 then proof else proof || {before} || {after} end as proof from f{k} f join {mine} r on r.tree = {key} and r.run = f.{at} // {8 ** (i + 1)})"
            )
            k += 1
    return f"with {', '.join(parts)} select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, f as folded_root, f = root as verified from f{k}"


ORACLE = _sql()
