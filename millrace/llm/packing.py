"""Best-fit packing by a grouping genetic algorithm.

Texts become pieces of at most a sequence's tokens. Pieces are dealt to shards
of a bounded size by a hash, and each shard is packed by islands: populations
of whole packings that evolve in tasks of their own. A crossover puts
well-filled sequences of one packing into another, drops the sequences there
that hold the same pieces, and best-fits the displaced pieces. Between epochs
the best packing of each island moves to the next. The emptiest sequences of
all shards are opened again and packed together in a further round, until one
shard holds them all, so that shards cost no sequences. Evolution therefore
looks for few sequences first, and then for little space outside those that will
be opened again, as only that is lost.
"""

from __future__ import annotations

import heapq
import json
import os
import random
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, give_back, giving_back, table

CAPACITY = 2048
#: Pieces and sequences of a shard, expected: as many as needed for both.
SHARD, SEQUENCES = 2_000, 64
ISLANDS, EPOCHS = 2, 2
POPULATION = 6
GENERATIONS = 4
#: Share of a packing's fullest bins that a crossover puts into another.
INJECTED = 0.1
#: Least factor by which a piece may seem shorter when the order of best fit is made.
NOISE = 0.98
#: Sequences of a shard, the emptiest, that are packed again with those of other shards.
REOPENED = 3
#: Texts at the start of each task whose ids are compared with those of the tokenizers library.
COMPARED = 3

END = np.array([0], dtype="<u4").tobytes()


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, from a byte-level BPE file of the tokenizers library.

    Where the file's ids are in the order of its merges, as byte-level
    vocabularies are, ids are ranks, and the tiktoken library finds the same
    ids from the file's vocabulary in a fraction of the time. Every task
    compares the two on its first texts and stops if they differ. A file of
    another kind, a text that holds an added token of the file, and one that
    tiktoken gives up on, is left to tokenizers with its own settings.
    """

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        self.path, self.tokenizer = path, None
        ranks, self.added = _ranks(path)
        give_back()  # the parsed file is larger than what follows
        self.ranks = None
        if ranks is not None:
            import tiktoken

            self.ranks = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def reference(self, text: str) -> bytes:
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def compared(self) -> None:
        """Let go of the tokenizers library's copy; where a text needs it, it is read again."""
        if self.ranks is not None:
            self.tokenizer = None
            give_back()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.ranks is None or any(t in text for t in self.added):
            return self.reference(text)
        try:
            ids = self.ranks.encode_ordinary(text)
        except (KeyboardInterrupt, SystemExit):
            raise
        except BaseException:  # its pattern engine gives up on some texts, by a panic
            return self.reference(text)
        return np.array(ids, dtype="<u4").tobytes()


def _ranks(path: str) -> tuple[dict[bytes, int] | None, list[str]]:
    """Ranks of the byte strings of a file, if its ids are in the order of its merges, and its added tokens."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, added = file["model"], [t["content"] for t in file.get("added_tokens") or []]
    vocab = model["vocab"]
    made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["merges"]]
    if made != sorted(made) or len(made) + 256 > len(vocab):
        return None, added
    alphabet = _byte_alphabet()
    return {bytes([alphabet[c] for c in t]): i for t, i in vocab.items() if i < len(made) + 256}, added


def _byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level file: itself if it can be seen, else one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str = public_tokenizers.PATTERN) -> Encoder:
    """The worker's encoder for a file, built once until the cache is cleared."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
        give_back()
    return _encoders[path, pattern]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, u)``; u is a number of its own for each piece."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        u = TaskContext.get().partitionId() << 33
        compared = 0
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column(1)):
                text = text.as_py() or ""
                ids = enc.encode(text)
                if compared < COMPARED:
                    compared += 1
                    if ids != enc.reference(text):
                        raise ValueError(f"{path} has other ids than its ranks give")
                    if compared == COMPARED:
                        enc.compared()
                ids += END
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    size = (n % capacity or capacity) if at == 0 else capacity
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    at, k = at + size, k + 1
            numbers = np.arange(u, u + len(row), dtype=np.int64)
            u += len(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(numbers)], names)
        _encoders.clear()  # workers live on idle, several to an executor; half a second makes it anew

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "u"]
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, u long")


class Packing:
    """Bins of item numbers with their remaining space."""

    def __init__(self, sizes: list[int], capacity: int, bins: list[list[int]] | None = None):
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.space: list[int] = []
        self.by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.free = 0  # bit r is set if some bin has just r left
        for b in bins or ():
            self._open(b, capacity - sum([sizes[i] for i in b]))

    def _open(self, items: list[int], space: int) -> None:
        self.bins.append(items)
        self.space.append(space)
        self._file(len(self.bins) - 1)

    def _file(self, at: int) -> None:
        r = self.space[at]
        self.by_space[r].append(at)
        self.free |= 1 << r

    def insert(self, items: list[int]) -> Packing:
        """Best fit, in the order given."""
        for i in items:
            size = self.sizes[i]
            fits = self.free >> size
            if fits:
                r = size + (fits & -fits).bit_length() - 1
                at = self.by_space[r].pop()
                if not self.by_space[r]:
                    self.free &= ~(1 << r)
                self.bins[at].append(i)
                self.space[at] = r - size
                self._file(at)
            else:
                self._open([i], self.capacity - size)
        return self

    def fitness(self, spare: int = 0) -> tuple[int, int]:
        """Fewer bins first, then less space outside the ``spare`` emptiest bins."""
        return -len(self.bins), sum(heapq.nlargest(spare, self.space)) - sum(self.space)


def _noisy(items: list[int], sizes: list[int], rng: random.Random) -> list[int]:
    """Largest first, but each may seem a little smaller than it is."""
    return [i for _, i in sorted([(-sizes[i] * rng.uniform(NOISE, 1.0), i) for i in items])]


def crossover(a: Packing, b: Packing, rng: random.Random) -> Packing:
    """Whole well-filled bins of ``b`` in ``a``; what they displace, and what lies in bins of ``a`` that are not full, is best-fitted."""
    order = sorted(range(len(b.bins)), key=b.space.__getitem__)
    best = order[: max(1, len(order) * 3 // 4)]
    injected = [b.bins[k] for k in rng.sample(best, max(1, int(len(best) * INJECTED)))]
    inside = {i for items in injected for i in items}
    kept, displaced = [list(items) for items in injected], []
    for items, space in zip(a.bins, a.space, strict=True):
        if not space and inside.isdisjoint(items):
            kept.append(list(items))
        else:
            displaced += [i for i in items if i not in inside]
    return Packing(a.sizes, a.capacity, kept).insert(_noisy(displaced, a.sizes, rng))


def mutate(p: Packing, rng: random.Random) -> Packing:
    """Empties a few bins, the emptiest and some at random, and best-fits their items."""
    order = sorted(range(len(p.bins)), key=lambda k: -p.space[k])
    gone = {*order[:2], *rng.sample(range(len(p.bins)), min(3, len(p.bins)))}
    items = [i for k in gone for i in p.bins[k]]
    rng.shuffle(items)
    return Packing(p.sizes, p.capacity, [list(b) for k, b in enumerate(p.bins) if k not in gone]).insert(items)


def evolve(sizes: list[int], capacity: int, seeds: list[list[list[int]]], rng: random.Random, spare: int = 0, generations: int = GENERATIONS, population: int = POPULATION) -> tuple[Packing, int]:
    """The best packing and the generations it took: until nothing can be gained, or all ``generations``.

    Nothing can be gained once the bins are as few as the sum of sizes allows
    and only the ``spare`` emptiest have space left (all may have without ``spare``).
    """
    least = -(-sum(sizes) // capacity)

    def perfect(p: Packing) -> bool:
        bins, space = p.fitness(spare)
        return -bins <= least and not (spare and space)

    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    all_ = [Packing(sizes, capacity, [list(b) for b in s]) for s in seeds] or [Packing(sizes, capacity).insert(order)]
    best = max(all_, key=lambda p: p.fitness(spare))
    done = 0
    while not perfect(best) and done < generations:
        while len(all_) < population:
            all_.append(Packing(sizes, capacity).insert(_noisy(order, sizes, rng)))
        for _ in range(population):
            child = crossover(*rng.sample(all_, 2), rng)
            all_.append(mutate(child, rng) if rng.random() < 0.3 else child)
        all_ = sorted(all_, key=lambda p: p.fitness(spare), reverse=True)[:population]
        best, done = all_[0], done + 1
    return best, done


def _order(part: pa.Table) -> pa.Table:
    """The items of a shard in an order that every task finds alike."""
    return part.sort_by([("length", "descending"), ("u", "ascending")])


def _bin_of(p: Packing) -> list[int]:
    out = [0] * len(p.sizes)
    for k, items in enumerate(p.bins):
        for i in items:
            out[i] = k
    return out


def _bins(of: list[int]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(max(of, default=-1) + 1)]
    for i, k in enumerate(of):
        out[k].append(i)
    return out


def _round(items: DataFrame, shards: int, capacity: int, number: int) -> DataFrame:
    """Packs each shard; adds shard, bin, offset, reopened and the generations of the shard's islands to the items."""
    spare = REOPENED if shards > 1 else 0
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("u", F.lit(number)), F.lit(shards)))
    narrow = dealt.select("shard", "u", "length").withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))
    elite = "shard long, island int, n int, loss long, generations int, of array<int>"

    def result(part: pa.Table, seeds: list[list[list[int]]], before: int, epoch: int) -> pa.Table:
        shard, island = part["shard"][0].as_py(), part["island"][0].as_py()
        p, took = evolve(_order(part)["length"].to_pylist(), capacity, seeds, random.Random(f"{number} {shard} {island} {epoch}"), spare)
        n, loss = p.fitness(spare)
        return pa.table({"shard": pa.array([shard], pa.int64()), "island": pa.array([island], pa.int32()), "n": pa.array([-n], pa.int32()), "loss": pa.array([-loss], pa.int64()), "generations": pa.array([before + took], pa.int32()), "of": pa.array([_bin_of(p)], pa.list_(pa.int32()))})

    def later(epoch: int):
        def run(part: pa.Table, elites: pa.Table) -> pa.Table:
            elites = elites.sort_by([("n", "ascending"), ("loss", "ascending")])
            return result(part, [_bins(of) for of in elites["of"].to_pylist()], max(elites["generations"].to_pylist()), epoch)

        return run

    def assign(part: pa.Table, elites: pa.Table) -> pa.Table:
        part = _order(part)
        sizes = part["length"].to_pylist()
        best = elites.sort_by([("n", "ascending"), ("loss", "ascending"), ("island", "ascending")])
        bins = _bins(best["of"][0].as_py())
        space = [capacity - sum([sizes[i] for i in b]) for b in bins]
        again = set(heapq.nlargest(spare, [k for k in range(len(bins)) if space[k]], key=space.__getitem__))
        of, offset = [0] * len(sizes), [0] * len(sizes)
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                of[i], offset[i] = k, at
                at += sizes[i]
        generations = pa.array([max(elites["generations"].to_pylist())] * len(of), pa.int32())
        return part.append_column("bin", pa.array(of, pa.int64())).append_column("offset", pa.array(offset, pa.int64())).append_column("reopened", pa.array([k in again for k in of])).append_column("generations", generations)

    islands = narrow.groupBy("shard", "island")
    best = islands.applyInArrow(lambda part: result(part, [], 0, 1), elite)
    for epoch in range(2, EPOCHS + 1):
        # each island's best packing stays and goes to the next one too
        moved = best.withColumn("island", F.explode(F.array("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)))))
        best = islands.cogroup(moved.groupBy("shard", "island")).applyInArrow(later(epoch), elite)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema)
    return dealt.groupBy("shard").cogroup(best.groupBy("shard")).applyInArrow(assign, f"{fields}, bin long, offset long, reopened boolean, generations int")


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, sequences: int = SEQUENCES) -> DataFrame:
    """Adds sequence_id and offset to pieces (a table with length and u).

    Full pieces are sequences by themselves. Every round works on what the one
    before opened again: a few of the ``sequences``, or more, of each shard. The
    tokens of a round are therefore a small share of those of the round before
    whatever the pieces' lengths, and so are its shards, until there is one,
    which opens nothing. A shard has ``shard`` pieces, or as many as fill
    ``sequences``: a number that does not grow with the table.
    """
    out = cut_pieces.where(F.col("length") >= capacity).select("*", F.col("u").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = cut_pieces.where(F.col("length") < capacity)
    number = 0
    while True:
        facts = left.agg(F.count("*").alias("n"), F.sum("length").alias("tokens")).first()
        if not facts["n"]:
            return out
        number += 1
        shards = max(1, min(facts["n"] // shard, facts["tokens"] // (sequences * capacity)))
        done = cut(_round(left, shards, capacity, number), "packing-round")
        sequence = F.lit(number << 58) + F.col("shard") * F.lit(1 << 24) + F.col("bin")
        out = out.unionByName(done.where("not reopened").select(*cut_pieces.columns, sequence.alias("sequence_id"), "offset"))
        left = done.where("reopened").select(*cut_pieces.columns)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` for each piece of each row.

    A document is its ids and then id 0. One longer than a sequence is cut
    into full pieces, its first piece being the shorter. A null text counts as
    empty and is id 0 alone; null and repeated ids are packed row by row; an
    empty table gives an empty one; other columns are ignored.
    """
    own = cut(pieces(docs, path, capacity), "pieces")
    return pack(own, capacity).drop("u")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
