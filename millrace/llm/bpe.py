"""Byte-level BPE encoding and decoding.

The vocabulary's byte strings are mapped to Latin-1 and put in a pyahocorasick
automaton. A piece of text is walked once to find the longest token that starts
at each byte; the encoder then takes longest tokens from the left and goes back
to a shorter one wherever two neighbours could not stand side by side in the
result of the merges. That test depends on the two tokens alone, so it is
memoised, each position is given up at most once, and searches for longest
tokens begin in windows of a fixed size, so a piece of any length takes linear
time while the ids equal those of the merges by rank.

Words recur, so results are kept by chunk of text (from one plain space to the
next) in caches of a stated size. A full cache becomes the old one and drops
what was old; that costs time but never changes a result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Entries held by the new and by the old half of each of a worker's caches.
CACHE = 300_000
#: Longest tokens that fit in the text that one search for longest tokens gets.
WINDOW = 4


def load_ranks(path: str) -> list[bytes]:
    """Byte strings by rank, from a file of base64 string and rank on each line."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [ranks[i] for i in range(len(ranks))]


#: Below this character all libraries agree on what a letter is.
LETTERS = "\u0250"
#: Stands for a chunk that cannot be encoded by itself.
CROSSED = None


class Cache(dict):
    """Results by text; computes what is missing and holds at most 2 * CACHE entries."""

    def __init__(self, compute):
        super().__init__()
        self.compute, self.old = compute, {}

    def __missing__(self, key):
        value = self.old.get(key, self)
        if value is self:
            value = self.compute(key)
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Merges:
    """Encoder and decoder of single pieces, without a splitting pattern."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.lengths = [len(t) for t in tokens]
        self.most = max(self.lengths, default=1)
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter = [self._longest_proper_prefix(t) for t in tokens]
        #: By the left token, known results of ``_compatible`` by the right one; ``known`` of them in all.
        self.fits: list[dict[int, bool]] = [{} for _ in tokens]
        self.known = 0
        self._derive_merges()

    def _longest_proper_prefix(self, token: bytes) -> int:
        for n in range(len(token) - 1, 0, -1):
            if (i := self.ids.get(token[:n])) is not None:
                return i
        return -1

    def _derive_merges(self) -> None:
        """The pair that each token was merged from; a token that no merge makes is its own halves."""
        self.merged: dict[tuple[int, int], int] = {}
        self.left, self.right = list(range(len(self.tokens))), list(range(len(self.tokens)))
        for i, token in enumerate(self.tokens):
            a = self.shorter[i]
            while a >= 0:
                b = self.ids.get(token[self.lengths[a] :], i)
                if a < i and b < i and self._compatible(a, b):
                    self.merged[a, b] = i
                    self.left[i], self.right[i] = a, b
                    break
                a = self.shorter[a]

    def _compatible(self, a: int, b: int) -> bool:
        """Whether the merges, run on the bytes of ``a`` and ``b`` together, give just ``a, b``.

        The last merges on either side are undone, the later one first. If the
        two tokens that then touch have a merge that would have come before
        the one undone, the merges would have crossed the border.
        """
        before = len(self.tokens) + 1
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < before:
                return False
            can_a, can_b = self.right[a] != a, self.left[b] != b
            if not can_a and not can_b:
                return True
            if can_a and (a > b or not can_b):
                before, a = a, self.right[a]
            else:
                before, b = b + 1, self.left[b]

    def compatible(self, a: int, b: int) -> bool:
        """Memoised ``_compatible``."""
        fit = self.fits[a].get(b)
        if fit is None:
            if self.known >= 4 * CACHE:
                for row in self.fits:
                    row.clear()
                self.known = 0
            self.known += 1
            fit = self.fits[a][b] = self._compatible(a, b)
        return fit

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        lengths, shorter, fits, compatible = self.lengths, self.shorter, self.fits, self.compatible
        n, mapped, longest, most = len(piece), piece.decode("latin-1"), self.automaton.iter_long, self.most
        # longest tokens from a position on, each beginning where the last ends; starting a search costs
        # time in proportion to its text, so it gets a window, and those near the window's end are not used
        reach = WINDOW * most
        ahead, full = longest(mapped[:reach]), reach - most if reach < n else n
        out: list[int] = []
        last, pos, token, aligned = -1, 0, -1, True
        if full == n:
            # most pieces are their longest tokens, or are up to the first two neighbours that do not fit
            out = [t for _, t in ahead]
            for k, token in enumerate(out):
                if last >= 0:
                    fit = fits[last].get(token)
                    if not (compatible(last, token) if fit is None else fit):
                        del out[k:]
                        break
                last = token
                pos += lengths[token]
            else:
                return out
        else:
            token = next(ahead)[1]
        dead = set()  # positions from which no compatible rest exists
        while True:
            while token >= 0:
                end = pos + lengths[token]
                if end not in dead:
                    if last < 0:
                        break
                    fit = fits[last].get(token)
                    if compatible(last, token) if fit is None else fit:
                        break
                token, aligned = shorter[token], False
            if token >= 0:
                out.append(token)
                if end == n:
                    return out
                last, pos = token, end
                if not aligned or pos > full:
                    ahead, aligned = longest(mapped[pos : pos + reach]), True
                    full = pos + reach - most if pos + reach < n else n
                token = next(ahead)[1]
            else:
                dead.add(pos)
                given_up = out.pop()
                pos, token, aligned = pos - lengths[given_up], shorter[given_up], False
                last = out[-1] if out else -1

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


class Tokenizer:
    """Whole texts: splits by a pattern, encodes each match by itself."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.merges = Merges(tokens)
        self.pattern = regex.compile(pattern)
        self.space = regex.compile(r"\s")
        self.pieces = Cache(lambda piece: self.merges.encode(piece.encode("utf-8")))
        self.chunks = Cache(self._chunk)
        self.names = [str(i) for i in range(len(tokens))]

    def _ids(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.pattern.findall(text):
            out += self.pieces[piece]
        return out

    def _result(self, text: str) -> tuple[str, bytes]:
        ids = self._ids(text)
        names = self.names
        return " ".join([names[i] for i in ids]), self.merges.decode(ids)

    def _chunk(self, chunk: str) -> tuple:
        """Result of a chunk with the space before it; CROSSED where white space meets that space.

        A plain space between two characters that are not white space always
        begins a match, so text may be cut before it; beside other white space
        it may not.
        """
        # a word is one match, and one character of ASCII that is no letter, digit or white space after it another
        word, end = (chunk, "") if chunk.isalpha() else (chunk[:-1], chunk[-1:])
        if word.isalpha() and max(word) < LETTERS and (not end or "!" <= end <= "~" and not end.isalnum()):
            ids = self.merges.encode((" " + word).encode())
            if end:
                ids = [*ids, *self.pieces[end]]
            return " ".join([self.names[i] for i in ids]), self.merges.decode(ids)
        if not chunk or self._white(chunk[0]) or self._white(chunk[-1]):
            return CROSSED
        return self._result(" " + chunk)

    def _white(self, character: str) -> bool:
        return not "!" <= character <= "~" and self.space.match(character) is not None

    def result(self, text: str) -> tuple[int, str, bytes]:
        """Number of ids, ids joined by spaces, and the bytes decoded from them."""
        ids, decoded = self._joined(text)
        return ids.count(" ") + 1 if ids else 0, ids, decoded

    def _joined(self, text: str) -> tuple[str, bytes]:
        first, *rest = text.split(" ")
        if not rest or not first or self._white(first[-1]):
            return self._result(text)
        found = [self._result(first), *map(self.chunks.__getitem__, rest)]
        if CROSSED in found:
            return self._result(text)
        return " ".join([ids for ids, _ in found]), b"".join([decoded for _, decoded in found])

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.result(text)[1].split()]

    def decode(self, ids: list[int]) -> bytes:
        return self.merges.decode(ids)


_loaded: dict[tuple[str, str], Tokenizer] = {}


def tokenizer(path: str, pattern: str) -> Tokenizer:
    """The worker's tokenizer for a rank file, built once for each worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Tokenizer(load_ranks(path), pattern)
    return _loaded[path, pattern]


def encode(df: DataFrame, id_col: str, text_col: str, ranks_path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``(id, ids array<int>)`` for each row; a null text has no ids. Other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(ranks_path, pattern)
        for b in batches:
            ids = [t.encode(x or "") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, id_col: str, ids_col: str, ranks_path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``(id, bytes binary)`` for each row of ids; null ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(ranks_path, pattern)
        for b in batches:
            raw = [t.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["id", "bytes"])

    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, bytes binary")


def round_trip(df: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Encode and decode each text of ``documents`` and return digests of both.

    Rows: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by a space),
    decoded_sha256 (of the bytes). A null text counts as empty; an empty text
    has no ids; a null or repeated doc_id is kept as it is, row by row; other
    columns are ignored. No row depends on another and nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(ranks_path, pattern)
        for b in batches:
            n_tokens, ids_sha, decoded_sha = [], [], []
            for text in b.column(1):
                n, ids, decoded = t.result(text.as_py() or "")
                n_tokens.append(n)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(decoded).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_tokens, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
