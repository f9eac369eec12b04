"""The Merkle manifest against a recursive build, with the recursion by tasks forced as well."""

import hashlib
import zlib

import pytest

from millrace.llm import merkle


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def up(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def brute(rows):
    trees = {}
    for doc_id, text, lang, source, n_chars in rows:
        fields = lambda t: H("".join(map(enc, (doc_id, source, lang, n_chars, t))))  # noqa: E731, B023
        low = None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        trees.setdefault(lang, []).append((doc_id is not None, doc_id or 0, fields(text), fields(low) if hit else fields(text), doc_id))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    levels = {n: up([leaf for _, _, leaf, _, _ in sorted(trees[n])]) for n in names}
    top = up([levels[n][-1][0] for n in names])
    out = []
    for i, n in enumerate(names):
        for j, (_, _, leaf, folded, doc_id) in enumerate(sorted(trees[n])):
            proof = ""
            for path, at in ((levels[n], j), (top, i)):
                for level in path[:-1]:
                    run, k = level[at - at % 8 : at - at % 8 + 8], at % 8
                    proof += "".join(run[:k] + run[k + 1 :])
                    folded = H("".join(run[:k]) + folded + "".join(run[k + 1 :]))
                    at //= 8
            out.append((doc_id, leaf, levels[n][-1][0], top[-1][0], H(proof), folded, folded == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{}, {"levels": 1, "top": 3}, {"levels": 2, "top": 5}])
def test_edges_equal_a_recursive_build(edges, sizes):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in edges.collect()]
    got = sorted(map(tuple, merkle.manifest(merkle.document_leaves(edges), **sizes).collect()), key=str)
    assert got == brute(rows)


def test_more_languages_than_the_driver_may_get(spark):
    rows = [(i, f"Text {i % 7}", f"l{i % 40}" if i % 11 else None, "S", i) for i in range(150)] + [(3, "Text 3", "l3", "S", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for sizes in ({"levels": 1, "top": 4}, {}):
        got = sorted(map(tuple, merkle.manifest(merkle.document_leaves(docs), **sizes).collect()), key=str)
        assert got == brute(rows)


def test_documents_and_sql(same):
    same(merkle.query, merkle.ORACLE)


def test_no_rows_and_one_row(spark, empty):
    assert merkle.manifest(merkle.document_leaves(empty)).count() == 0
    one = spark.createDataFrame([(1, "A", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    r = merkle.manifest(merkle.document_leaves(one)).first()
    assert r["leaf"] == r["subroot"] == r["root"] and r["proof_sha256"] == H("")


def test_tampering_shows_and_nothing_else_does(documents):
    rows = merkle.manifest(merkle.document_leaves(documents)).collect()
    hit = lambda i: zlib.crc32(str(i).encode()) % 3 == 0
    assert all(r["verified"] for r in rows if not hit(r["doc_id"])) and any(not r["verified"] for r in rows)
