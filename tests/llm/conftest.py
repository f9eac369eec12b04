import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

#: Texts at the edges: null, empty, white space alone, ties, repeats, very long, and of several scripts.
EDGES = [None, "", " ", "\n\t \x0b", "one", "one two", "One  two\nthree", "a b c d e f g h i j k l", "a b c d e f g h i j k l", "word " * 30, "x" * 5000, "line\n" * 8 + "last line", "naïve Ünï cödé 中文 😀 \x1c\x85\xa0end", "it's 12 o'clock, they've gone!!  " * 3, "q w e r t y u i o p " * 2000]


def components(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.fixture(scope="session")
def edges(spark):
    """Edge texts with a null id, a repeated row and columns whose names operators use themselves."""
    rows = [(i, t, "en", "s0" if i % 3 else None, 0, "h", 7) for i, t in enumerate(EDGES)]
    rows += [(None, "a text without an id, long enough to be kept by all of the rules here", "en", "s1", 0, "h", 7), rows[7], (100, EDGES[7], None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, host string, score long")


@pytest.fixture(scope="session")
def empty(edges):
    return edges.limit(0)


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, small):
    return spark.read.parquet(f"{small}/labels.parquet")
