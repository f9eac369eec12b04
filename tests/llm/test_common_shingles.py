"""The table of common shingles: bounded at any size, and without influence on results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import jaccard_join


@pytest.fixture(scope="module")
def boilerplate(spark):
    """Texts that share a long passage, near copies among them; more shingles are common than a small table may take."""
    passage = " ".join(f"shared{i}" for i in range(150))
    rows = [(i, f"{' '.join(f'w{(i // 2) * 997 + j * j}' for j in range(400 + i % 3))} {passage} {'end' if i % 2 else 'ending'}") for i in range(120)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def table(docs, bits):
    keyed = docs.withColumn("text_hash", F.xxhash64("text"))
    return jaccard_join._common(keyed, 3, bits)


@pytest.mark.parametrize("bits", [6, 8, 12])
def test_no_more_than_a_share_of_the_bits_is_set(boilerplate, monkeypatch, bits):
    monkeypatch.setattr(jaccard_join, "SAMPLED", 1)
    found = table(boilerplate, bits)
    assert len(found) == 2**bits // 8 and np.unpackbits(found).sum() <= 2**bits // jaccard_join.SPARSE


def test_results_are_the_same(boilerplate, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SAMPLED", 1)
    want = sorted(tuple(r[:3]) for r in jaccard_join.clusters(boilerplate).select("doc_id", "n_shingles", "component_id").collect())
    assert len({c for _, _, c in want}) < len(want)
    for bits in (6, 8):
        assert sorted(tuple(r[:3]) for r in jaccard_join.clusters(boilerplate, common_bits=bits).select("doc_id", "n_shingles", "component_id").collect()) == want
