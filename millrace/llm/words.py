"""Words of whole batches of texts as numpy arrays, without a Python object for each word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of the class [\\x20\\x09-\\x0D].
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII letters and digits and all bytes of other characters belong to words, the rest separates.
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Longer words are hashed one by one.
LONG = 64
#: Bytes of text taken at once, except for a single longer text.
CHUNK = 250_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = np.uint64(0x9E3779B97F4A7C15 | 3)


def chunks(texts: pa.Array):
    """Yields (first row, bytes, offsets) of consecutive rows; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
        yield first, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


class Words:
    """doc (row within the chunk), start, length and hash of each word; ``prefix[k]`` hashes the first k bytes.

    A word shorter than k has the prefix hash 0. Equal bytes, after lower-casing
    A-Z if ``lower``, have equal hashes in every process.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE, lower: bool = True, prefixes: tuple[int, ...] = ()):
        inside = ~separator[data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        # a text's border also ends a word
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        cuts = cuts[inside[cuts] & inside[cuts - 1]] if len(cuts) else cuts
        starts = edge[inside[edge]]
        ends = edge[~inside[edge]]
        if len(data) and inside[0]:
            starts = np.concatenate(([0], starts))
        if len(data) and inside[-1]:
            ends = np.concatenate((ends, [len(data)]))
        if len(cuts):
            cuts = np.unique(cuts)  # once for empty texts; none is an edge, so they are put in without a sort of all
            starts, ends = (np.insert(x, np.searchsorted(x, cuts), cuts) for x in (starts, ends))
        self.n_docs = len(offsets) - 1
        self.start, self.length = starts, ends - starts
        self.doc = np.searchsorted(offsets, starts, "right") - 1
        self.data = LOWER[data] if lower else data
        self.prefix: dict[int, np.ndarray] = {}
        self._hash(prefixes)

    def _hash(self, prefixes: tuple[int, ...]) -> None:
        h = np.zeros(len(self.start), dtype=np.uint64)
        order = np.argsort(-self.length, kind="stable")
        start, length = self.start[order], self.length[order]
        counts = np.bincount(np.minimum(length, LONG + 1), minlength=LONG + 2)
        longer = len(length) - np.cumsum(counts)  # longer[k]: number of words of more than k bytes
        values = _BYTE[self.data]
        for k in range(LONG):
            n = longer[k]
            if not n:
                break
            h[:n] = h[:n] * _STEP + values[start[:n] + k]
            if k + 1 in prefixes:
                p = np.zeros(len(h), dtype=np.uint64)
                p[:n] = mix(h[:n] + np.uint64(k + 1))
                self.prefix[k + 1] = p
        for i in range(longer[LONG]):
            h[i] = xxhash.xxh64_intdigest(self.data[start[i] : start[i] + length[i]].tobytes())
        self.hash = np.empty_like(h)
        self.hash[order] = mix(h)
        for k in prefixes:
            p = self.prefix.get(k, np.zeros(len(h), dtype=np.uint64))
            q = np.empty_like(p)
            q[order] = p
            self.prefix[k] = q

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)
