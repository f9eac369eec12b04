"""Repeated passages against a dictionary of all windows."""

import hashlib
import random

import pytest

from millrace.llm import suffix_dedup as dedup


def brute(rows, length=50):
    owners = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for s in range(len(b) - length + 1):
            if i is not None:
                w = b[s : s + length]
                owners[w] = min(owners.get(w, i), i)
    out = []
    for i, b in texts:
        covered = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if i is not None and owners[b[s : s + length]] < i:
                covered[s : s + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if covered[k] and (k == 0 or not covered[k - 1]))
        kept = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        out.append((i, len(b), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df, *args, **sizes):
    return sorted(map(tuple, dedup.digest(df, *args, **sizes).collect()), key=str)


def made(seed, n=60):
    """Texts with shared passages at any places, copies, near copies, loops and other scripts."""
    rng = random.Random(seed)
    letters = lambda k: "".join(rng.choice("abé 中") for _ in range(k))
    shared = [letters(rng.randint(40, 90)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [rng.choice([letters(rng.randint(0, 80)), rng.choice(shared), "ab" * rng.randint(0, 60)]) for _ in range(rng.randint(0, 5))]
        rows.append((i, "".join(parts)))
    rows += [(n + 1, rows[5][1]), (n + 2, rows[5][1] + "!"), (7, rows[9][1]), (3, shared[0] + shared[1]), (3, shared[0] + shared[1]), (None, shared[2] * 2), (None, None), (n + 3, None), (n + 4, "x" * 49), (n + 5, "x" * 50), (n + 6, "x" * 51)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("sizes", [{}, {"slot": 900, "piece": 64, "bucket": 500}])
def test_made_texts(spark, seed, sizes):
    rows = made(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as uid", "'b' as bytes", "0 as sha")
    assert result(df, **sizes) == brute(rows)


def test_other_lengths(spark):
    rows = made(3, 30)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df, 30, slot=2000, piece=100) == brute(rows, 30)
    with pytest.raises(ValueError, match="length"):
        dedup.digest(df, 20)


def test_a_passage_that_most_texts_hold(spark):
    rng = random.Random(4)
    passage = "This passage of more than fifty bytes stands in nearly all texts of the table."
    rows = [(i, f"{rng.random()} {passage * (i % 3)} {rng.random()}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df, slot=3000, bucket=200) == brute(rows)


def test_spans_and_kept_bytes_make_up_the_text(spark):
    rows = made(5)
    got = dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string"), piece=100).collect()
    texts = {i: (t or "").encode() for i, t in rows if i is not None}
    for r in got:
        if r["doc_id"] not in (None, 3, 7):
            text, kept, at = texts[r["doc_id"]], b"", 0
            for s in r["spans"]:
                kept += text[at : s["start"]]
                at = s["start"] + s["length"]
            kept += text[at:]
            assert r["n_removed"] == len(text) - len(kept)
            assert (bytes(r["kept"]) if r["kept"] is not None else kept) == kept and (r["kept"] is not None or r["n_removed"] in (0, len(text)))


def test_edges(edges, empty):
    assert result(edges) == brute([(r["doc_id"], r["text"]) for r in edges.collect()])
    assert dedup.digest(empty).count() == 0


def test_documents_and_sql(same):
    same(dedup.query, dedup.ORACLE)


def test_names_that_64_bits_do_not_tell_apart():
    import numpy as np

    a, b = np.array([5, 5, 5, 1, 5], np.uint64), np.array([1, 2, 1, 9, 2], np.uint32)
    order, fresh = dedup._grouped(a, b)
    groups = {}
    for place, new in zip(order, fresh, strict=True):
        key = (int(a[place]), int(b[place]))
        assert new == (key not in groups)
        groups.setdefault(key, []).append(int(place))
    assert groups == {(1, 9): [3], (5, 1): [0, 2], (5, 2): [1, 4]}
