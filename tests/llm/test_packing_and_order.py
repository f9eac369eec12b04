"""Byte-level BPE, packing, sharding and the registered queries' shape."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import bpe, packing, sharding

RANKS, FILE = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bpe.tokenizer(RANKS, public_tokenizers.PATTERN)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet=" \n\t'sth eing\x85　é1!", max_size=60))
def test_bpe_equals_merges_and_round_trips(reference, coder, text):
    ids = coder.encode(text)
    assert ids == reference.encode_ordinary(text)
    assert coder.decode(ids) == text.encode()


def test_bpe_pieces_without_a_pattern(reference, coder):
    rng = random.Random(3)
    for _ in range(300):
        piece = bytes(rng.choice(b"athein gros\xc3\xa9\x00") for _ in range(rng.randint(1, 40)))
        assert coder.merges.encode(piece) == reference._core_bpe.encode_single_piece(piece)


def test_bpe_general_interface(edges, reference, spark):
    ids = bpe.encode(edges, "doc_id", "text", RANKS)
    texts = sorted(((r["doc_id"] or -1), r["text"] or "") for r in edges.collect())
    assert sorted(((r["id"] or -1), r["ids"]) for r in ids.collect()) == sorted((i, reference.encode_ordinary(t)) for i, t in texts)
    assert sorted(((r["id"] or -1), bytes(r["bytes"])) for r in bpe.decode(ids, "id", "ids", RANKS).collect()) == sorted((i, t.encode()) for i, t in texts)


def test_bpe_digests(edges, empty, reference):
    got = {r["doc_id"]: r for r in bpe.round_trip(edges, RANKS).collect()}
    for r in edges.collect():
        ids, own = reference.encode_ordinary(r["text"] or ""), got[r["doc_id"]]
        assert own["n_tokens"] == len(ids) and own["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert own["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert bpe.round_trip(empty, RANKS).count() == 0


def check_packing(rows, docs):
    t = Tokenizer.from_file(FILE)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.CAPACITY
    for r in docs:
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        lengths = [len(ids) % 2048 or 2048, *[2048] * ((len(ids) - 1) // 2048)]
        want = []
        for k, n in enumerate(lengths):
            start = sum(lengths[:k])
            want.append((k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())))
        assert set(want) <= {(x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in by_doc[r["doc_id"]]}
    return len(by_sequence), -(-sum(r["length"] for r in rows) // packing.CAPACITY)


def test_packs_documents_tightly(documents):
    used, least = check_packing(packing.pack_documents(documents, FILE).collect(), documents.collect())
    assert used <= least + 1


def test_packs_edges(edges, empty):
    check_packing(packing.pack_documents(edges, FILE).collect(), edges.collect())
    assert packing.pack_documents(empty, FILE).count() == 0


def test_rounds_over_many_shards(spark):
    rng = random.Random(5)
    rows = [(i, 0, 0, rng.randint(1, 2048), 0, i) for i in range(600)]
    own = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, u long")
    got = packing.pack(own, shard=50, sequences=16).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(600))
    used = {r["sequence_id"] for r in got}
    totals = {}
    for r in got:
        totals[r["sequence_id"]] = totals.get(r["sequence_id"], 0) + r["length"]
    assert max(totals.values()) <= 2048 and len(used) <= 1.06 * sum(r[3] for r in rows) / 2048 + 2


def triples(seed):
    """Three pieces to a bin of 1,000 exactly, which plain best fit decreasing misses."""
    rng = random.Random(seed)
    sizes = []
    for _ in range(40):
        a, b = rng.randint(300, 500), rng.randint(250, 290)
        sizes += [a, b, 1000 - a - b]
    return sizes, rng


def test_genetic_steps_keep_every_piece_and_improve():
    sizes, rng = triples(4)
    order = sorted(range(120), key=lambda i: -sizes[i])
    plain = packing.Packing(sizes, 1000).insert(order)
    best, generations = packing.evolve(sizes, 1000, [], rng)
    assert sorted(i for b in best.bins for i in b) == list(range(120)) and all(sum(sizes[i] for i in b) <= 1000 for b in best.bins)
    assert len(best.bins) < len(plain.bins) and generations == packing.GENERATIONS
    child = packing.mutate(packing.crossover(plain, best, rng), rng)
    assert sorted(i for b in child.bins for i in b) == list(range(120))
    assert packing.evolve([500, 500], 1000, [], rng)[1] == 0  # nothing can be gained


def test_space_is_gathered_in_bins_that_are_opened_again():
    rng = random.Random(2)
    sizes = [rng.randint(30, 900) for _ in range(150)] + [rng.randint(1, 40) for _ in range(10)]
    plain = packing.Packing(sizes, 1000).insert(sorted(range(160), key=lambda i: -sizes[i]))
    best, _ = packing.evolve(sizes, 1000, [], rng, 3, 30, 12)
    assert best.fitness(3) >= plain.fitness(3)


@pytest.mark.parametrize(("lengths", "sequences"), [([2] * 6_000, packing.SEQUENCES), ([1] * 30_000 + [3] * 30_000, 7), ([1] * 5_000 + [2_000] * 900, 7), ([2_047] * 3_000 + [1] * 3_000, packing.SEQUENCES)])
def test_rounds_end_for_any_lengths(spark, lengths, sequences):
    own = spark.createDataFrame([(n, u) for u, n in enumerate(lengths)], "length long, u long")
    got = packing.pack(own, shard=100, sequences=sequences).collect()
    totals = {}
    for r in got:
        totals[r["sequence_id"]] = totals.get(r["sequence_id"], 0) + r["length"]
    assert len(got) == len(lengths) and max(totals.values()) <= 2048
    assert len(totals) <= max(-(-sum(lengths) // 2048), sum(n > 1024 for n in lengths)) + 1


@pytest.mark.parametrize("null", [0.0, 0.6, 1.0])
def test_packs_tables_of_short_and_null_texts(spark, null):
    docs = spark.range(20_000).selectExpr("id as doc_id", f"case when id % 10 >= {10 * null} then 'ok' end as text", "'x' as u")
    got = packing.pack_documents(docs, FILE)
    assert got.count() == 20_000
    totals = got.groupBy("sequence_id").sum("length").collect()
    tokens = 20_000 + round(20_000 * (1 - null))
    assert sum(r[1] for r in totals) == tokens and max(r[1] for r in totals) <= 2048 and len(totals) == -(-tokens // 2048)


def check_shards(docs, shards, **options):
    got = sharding.shard(docs, shards, **options).collect()
    text = {}
    for r in docs.collect():
        text.setdefault(r["doc_id"], set()).add((len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())))
    bytes_, slots = [0] * shards, [[] for _ in range(shards)]
    for r in got:
        assert (r["size"], r["text_crc32"]) in text[r["doc_id"]] and r["law"] == "bytes" and r["grown_shard"] is None
        bytes_[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(got) == docs.count() and all(sorted(s) == list(range(len(s))) for s in slots)
    return got, bytes_


def test_shards_are_even(documents):
    got, sizes = check_shards(documents, 6)
    largest = max(r["size"] for r in got)
    assert max(sizes) - min(sizes) <= 2 * largest + 0.02 * sum(sizes) / 6
    groups = {}
    for r in got:
        groups.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert sum(len(s) > 1 for s in groups.values()) <= 5


def test_one_text_in_most_rows_is_cut_evenly(spark):
    docs = spark.createDataFrame([(i if i % 2 else 7, "the same text") for i in range(3000)], "doc_id long, text string")
    got, sizes = check_shards(docs, 5, rows_per_part=100)
    assert max(sizes) - min(sizes) <= 0.05 * sum(sizes) / 5


def test_splitters_do_not_grow_with_rows(documents, monkeypatch):
    asked = []
    histogram = sharding.histogram
    monkeypatch.setattr(sharding, "histogram", lambda keys, bounds: asked.append(len(bounds)) or histogram(keys, bounds))
    check_shards(documents, 6, rows_per_part=5)
    assert max(asked) <= 5 * (sharding.PROBES + 2)


def test_shards_of_edges(edges, empty):
    check_shards(edges, 4)
    assert sharding.shard(empty, 4).count() == 0


def test_added_tokens_have_the_ids_of_the_library():
    t, own = Tokenizer.from_file(FILE), packing.Encoder(FILE, packing.public_tokenizers.PATTERN)
    for text in ("a<|endoftext|>b c", "<|endoftext|>", "no such token", "<|endoftext |>"):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
    assert 50256 in np.frombuffer(own.encode("a<|endoftext|>b"), "<u4")
