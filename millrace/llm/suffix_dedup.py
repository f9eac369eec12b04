"""Passages that documents repeat, by a difference cover of all suffixes.

Of the suffixes of the texts those at places in a difference cover modulo V are
sampled. For any two suffixes some step of less than V leads to sampled ones on
both sides, so two equal windows of LENGTH bytes hold equal samples of
LENGTH - V + 1 bytes at the same step. That gives these rounds, each of which
sorts names in buckets and reads the texts once where they lie:

1. the samples' first bytes are sorted; those that occur once are left out;
2. samples that are left are named by all bytes that any window around them
   may hold, and sorted again: where an earlier document has the same name, all
   windows around the sample are decided at once;
3. the other suffixes that a step before a sample may reach are merged in:
   their windows are named and sorted, and of equal neighbours the earliest
   document keeps its window.

Names are 32 bits beside the bucket in the first round, where a collision only
costs work, and 96 bits beside the bucket after it. Nothing depends on the
alphabetical order of suffixes, so buckets of names take the place of one order.
Each task sends a name once however often it holds it, so that no passage,
however common, makes a bucket large.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, cut_by, join_hot, release, table

#: A perfect difference cover: any difference modulo V is one of two of its members.
V, COVER = 21, (3, 6, 7, 12, 14)
#: Bytes of a window.
LENGTH = 50
#: Bytes of text that a group of texts has about, and that a piece of a long text has; names that a bucket has about.
SLOT, PIECE, BUCKET = 4 << 20, 1 << 20, 1 << 20

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_R29, _R32 = np.uint64(29), np.uint64(32)
_MESSAGE = "slot long, bucket long, payload binary"
#: What a group of texts keeps for its next round, sent to itself through buckets below zero.
_PICKED, _LEFT, _GONE = -1, -2, -3


def _mixed(buffer: bytes, at: np.ndarray, length: int, wide: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Names of ``length`` bytes from each place on: 64 bits and, if wide, 32 more."""
    words = np.ndarray((len(buffer) - 7,), "<u8", buffer, 0, (1,)) if len(buffer) > 7 else np.empty(0, "<u8")
    a, b = np.full(len(at), length, np.uint64), np.full(len(at), _ODD[3])
    for step in [*range(0, length - 8, 8), length - 8]:
        w = words[at + step]
        a ^= w
        a *= _ODD[0]
        a ^= a >> _R29
        if wide:
            b += w
            b *= _ODD[1]
            b ^= b >> _R32
    a *= _ODD[2]
    a ^= a >> _R32
    return a, ((b * _ODD[0]) >> _R32).astype(np.uint32) if wide else None


def _bucket(a: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets by the upper half of names, so that names in order have their buckets in order."""
    return ((a >> _R32) * np.uint64(buckets)) >> _R32


class Texts:
    """The picked texts of a group, one after the other by document."""

    def __init__(self, pieces: pa.Table, picked: np.ndarray, length: int):
        self.length = length
        uid, no, doc = (pieces.column(c).to_numpy() for c in ("uid", "no", "doc"))
        take = np.flatnonzero(np.isin(uid, picked))
        take = take[np.lexsort((no[take], uid[take], doc[take]))]
        self.uid, self.no, self.n_bytes = uid[take], no[take], pieces.column("n_bytes").to_numpy()[take]
        bodies = pieces.column("body").take(pa.array(take)).to_pylist()
        self.buffer = b"".join(bodies)
        sizes = np.array([len(x) for x in bodies], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.docs = doc[take]
        self.piece = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)  # of each byte
        self.rest = (np.repeat(self.ends, sizes) - np.arange(len(self.buffer))).astype(np.int32)  # bytes of the piece from each byte on

    def doc(self, at: np.ndarray) -> np.ndarray:
        return self.docs[self.piece[at]]

    def keys(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Sampled places that have enough bytes after them, and their short names, bucket first."""
        gram = self.length - V + 1
        at = np.concatenate([np.arange(r, len(self.buffer), V) for r in COVER])
        at = at[self.rest[at] >= gram]
        h, _ = _mixed(self.buffer, at, gram, False)
        return at, _bucket(h, buckets) << _R32 | (h & np.uint64(0xFFFFFFFF))

    def around(self, at: np.ndarray) -> np.ndarray:
        """Which places have all bytes about them that a window over them may hold."""
        return (at - self.starts[self.piece[at]] >= V - 1) & (self.rest[at] >= self.length)


class Names:
    """Long names of places with their documents, each name once, with its least document."""

    def __init__(self, texts: Texts, at: np.ndarray, back: int, buckets: int):
        a, b = _mixed(texts.buffer, at - back, texts.length + back, True)
        order, fresh = _grouped(a, b)
        self.group = np.empty(len(at), np.int64)
        self.group[order] = np.cumsum(fresh) - 1
        first = order[fresh]
        self.doc = texts.doc(at)
        self.a, self.b, self.bucket = a[first], b[first], _bucket(a[first], buckets).astype(np.int64)
        self.least = np.minimum.reduceat(self.doc[order], np.flatnonzero(fresh)) if len(at) else self.doc

    def messages(self, slot: int) -> list[tuple[int, int, bytes]]:
        return [(slot, k, _packed(self.a[i:j], self.b[i:j], self.least[i:j])) for k, i, j in _runs(self.bucket)]

    def earlier(self, replies: dict[int, bytes]) -> np.ndarray:
        """For each place whether an earlier document has its name."""
        return _bits(self.bucket, replies)[self.group] | (self.doc > self.least[self.group])


def _grouped(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of names in which equal ones are neighbours, and where a new name begins."""
    order = np.argsort(a)
    same = a[order][1:] == a[order][:-1]
    if (b[order][1:] != b[order][:-1])[same].any():  # 64 bits did not tell names apart
        order = np.lexsort((b, a))
        same = a[order][1:] == a[order][:-1]
    same &= b[order][1:] == b[order][:-1]
    return order, np.concatenate([np.ones(min(1, len(order)), bool), ~same])


def _runs(sorted_keys: np.ndarray) -> list[tuple[int, int, int]]:
    if not len(sorted_keys):
        return []
    cuts = np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1
    return [(int(sorted_keys[i]), i, j) for i, j in zip([0, *cuts], [*cuts, len(sorted_keys)], strict=True)]


def _packed(a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> bytes:
    """Names and documents; the bytes of documents are put together by their place, as most are zero."""
    return a.tobytes() + b.tobytes() + doc.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(payload) // 20
    doc = np.frombuffer(payload, np.uint8, 8 * n, 12 * n).reshape(8, -1).T
    return np.frombuffer(payload, "<u8", n), np.frombuffer(payload, "<u4", n, 8 * n), np.ascontiguousarray(doc).view("<i8").ravel()


def _bits(buckets: np.ndarray, replies: dict[int, bytes]) -> np.ndarray:
    """One bit for each name, from the replies of the buckets; none where there is no reply."""
    out = np.zeros(len(buckets), bool)
    for k, i, j in _runs(buckets):
        if k in replies:
            out[i:j] = np.unpackbits(np.frombuffer(replies[k], np.uint8), count=j - i)
    return out


def _squeezed(bits: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def _kept(slot: int, kind: int, payload: bytes) -> tuple[int, int, bytes]:
    return slot, kind - 3 * slot, payload


def _table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    slot, bucket, payload = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table([pa.array(slot, pa.int64()), pa.array(bucket, pa.int64()), pa.array(payload, pa.binary())], ["slot", "bucket", "payload"])


def _received(messages: pa.Table) -> dict[int, bytes]:
    return {k if k >= 0 else -1 - (-1 - k) % 3: p for k, p in zip(messages.column("bucket").to_pylist(), messages.column("payload").to_pylist(), strict=True)}


def _opened(pieces: pa.Table, messages: pa.Table, length: int) -> tuple[int, Texts, dict[int, bytes]]:
    got = _received(messages)
    slot = pieces.column("slot")[0].as_py() if len(pieces) else -1
    return slot, Texts(pieces, np.frombuffer(got.get(_PICKED, b""), "<i8"), length), got


def _sample(buckets: int, length: int):
    """Round 1 in a group of texts: the short names it has, each once."""

    def run(pieces: pa.Table, picks: pa.Table) -> pa.Table:
        picked = picks.column("uid").to_numpy()
        if not len(picked) or not len(pieces):
            return _table([])
        slot, texts = pieces.column("slot")[0].as_py(), Texts(pieces, picked, length)
        found = np.sort(texts.keys(buckets)[1])
        found = found[np.append(True, found[1:] != found[:-1])[: len(found)]]
        rows = [(slot, k, found[i:j].astype("<u4").tobytes()) for k, i, j in _runs((found >> _R32).astype(np.int64))]
        return _table([*rows, _kept(slot, _PICKED, picked.astype("<i8").tobytes())])

    return run


def _twice(names: pa.Table) -> pa.Table:
    """In a bucket: which short names come from two groups of texts."""
    if names.column("bucket")[0].as_py() < 0:
        return names
    parts = [np.frombuffer(p, "<u4") for p in names.column("payload").to_pylist()]
    every = np.sort(np.concatenate(parts))
    again = every[1:][every[1:] == every[:-1]]
    rows = []
    for slot, bucket, mine in zip(names.column("slot").to_pylist(), names.column("bucket").to_pylist(), parts, strict=True):
        hit = np.zeros(len(mine), bool) if not len(again) else again[np.minimum(np.searchsorted(again, mine), len(again) - 1)] == mine
        if hit.any():
            rows.append((slot, bucket, np.packbits(hit).tobytes()))
    return _table(rows)


def _earliest(names: pa.Table) -> pa.Table:
    """In a bucket: which long names an earlier document of another group of texts has too."""
    if names.column("bucket")[0].as_py() < 0:
        return names
    parts = [_unpacked(p) for p in names.column("payload").to_pylist()]
    a, b, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
    order, fresh = _grouped(a, b)
    least = np.minimum.reduceat(doc[order], np.flatnonzero(fresh))[np.cumsum(fresh) - 1]
    hit = np.empty(len(a), bool)
    hit[order] = least < doc[order]
    rows, i = [], 0
    for slot, bucket, mine in zip(names.column("slot").to_pylist(), names.column("bucket").to_pylist(), parts, strict=True):
        bits = hit[i : i + len(mine[0])]
        i += len(mine[0])
        if bits.any():
            rows.append((slot, bucket, np.packbits(bits).tobytes()))
    return _table(rows)


def _left(texts: Texts, got: dict[int, bytes], buckets: int) -> np.ndarray:
    """Places of samples whose short name occurs twice."""
    at, key = texts.keys(buckets)
    order = np.argsort(key)
    fresh = np.concatenate([np.ones(min(1, len(key)), bool), key[order][1:] != key[order][:-1]])
    first = np.flatnonzero(fresh)
    found = _bits((key[order[first]] >> _R32).astype(np.int64), got) | (np.diff(np.append(first, len(key))) > 1)
    return np.sort(at[order[found[np.cumsum(fresh) - 1]]])


def _around(buckets: int, length: int):
    """Round 2: names of all bytes around the samples that are left."""

    def run(pieces: pa.Table, messages: pa.Table) -> pa.Table:
        slot, texts, got = _opened(pieces, messages, length)
        if not len(texts.uid):
            return _table([])
        left = _left(texts, got, buckets)
        names = Names(texts, left[texts.around(left)], V - 1, buckets)
        return _table([*names.messages(slot), _kept(slot, _PICKED, got[_PICKED]), _kept(slot, _LEFT, zlib.compress(left.astype("<i4").tobytes(), 1))])

    return run


def _spread(n: int, first: np.ndarray, count: int) -> np.ndarray:
    """True at ``count`` places from each of ``first`` on."""
    change = np.bincount(np.maximum(first, 0), minlength=n + 1)[: n + 1] - np.bincount(np.minimum(first + count, n), minlength=n + 1)[: n + 1]
    return np.cumsum(change)[:n] > 0


def _merge(buckets: int, length: int):
    """Round 3: names of the windows that a step before a sample may begin and that are not decided."""

    def run(pieces: pa.Table, messages: pa.Table) -> pa.Table:
        slot, texts, got = _opened(pieces, messages, length)
        if not len(texts.uid):
            return _table([])
        n = len(texts.buffer)
        left = np.frombuffer(zlib.decompress(got[_LEFT]), "<i4").astype(np.int64)
        whole = left[texts.around(left)]
        known = whole[Names(texts, whole, V - 1, buckets).earlier(got)]
        gone = _spread(n, known - V + 1, V)
        open_ = np.flatnonzero(_spread(n, left - V + 1, V) & ~gone)
        open_ = open_[texts.rest[open_] >= length]
        is_open = np.zeros(n, bool)
        is_open[open_] = True
        return _table([*Names(texts, open_, 0, buckets).messages(slot), _kept(slot, _PICKED, got[_PICKED]), _kept(slot, _LEFT, _squeezed(is_open)), _kept(slot, _GONE, _squeezed(gone))])

    return run


def _remove(buckets: int, length: int, piece_bytes: int):
    """After round 3: the spans that go from each piece, and what stays."""

    def run(pieces: pa.Table, messages: pa.Table) -> pa.Table:
        slot, texts, got = _opened(pieces, messages, length)
        out: dict[str, list] = {k: [] for k in ("uid", "no", "n_bytes", "starts", "lengths", "kept")}
        n = len(texts.buffer)
        if n:
            is_open, gone = (np.unpackbits(np.frombuffer(zlib.decompress(got[k]), np.uint8), count=n).astype(bool) for k in (_LEFT, _GONE))
            at = np.flatnonzero(is_open)
            gone[at[Names(texts, at, 0, buckets).earlier(got)]] = True
            covered = _spread(n, np.flatnonzero(gone), length)
            touched = np.add.reduceat(covered, texts.starts) if n else []
            for i in range(len(texts.uid)):
                if not touched[i] and texts.n_bytes[i] <= piece_bytes:
                    continue
                lead = length - 1 if texts.no[i] else 0
                a = texts.starts[i] + lead
                b = min(a + piece_bytes, texts.starts[i] + lead + texts.n_bytes[i] - texts.no[i] * piece_bytes)
                mine = covered[a:b]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
                starts, ends = edges[::2], edges[1::2]
                kept = np.frombuffer(texts.buffer, np.uint8)[a:b][~mine].tobytes()
                for name, x in zip(out, (texts.uid[i], texts.no[i], texts.n_bytes[i], starts + texts.no[i] * piece_bytes, ends - starts, kept), strict=True):
                    out[name].append(x)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
        return pa.table([pa.array(x, k) for x, k in zip(out.values(), kinds, strict=True)], list(out))

    return run


def _joined(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
    """Spans and kept bytes of a text of several pieces."""
    starts, lengths = [], []
    parts = parts.sort_values("no")
    for s, k in zip(np.concatenate(parts["starts"].tolist()).tolist(), np.concatenate(parts["lengths"].tolist()).tolist(), strict=True):
        if starts and starts[-1] + lengths[-1] == s:
            lengths[-1] += k
        else:
            starts.append(s)
            lengths.append(k)
    return pd.DataFrame({"uid": [key[0]], "starts": [starts], "lengths": [lengths], "kept": [b"".join(parts["kept"])]})


def repeats(docs: DataFrame, length: int = LENGTH, slot: int = SLOT, piece: int = PIECE, bucket: int = BUCKET) -> DataFrame:
    """What goes from each row of ``documents`` because a smaller doc_id has the same ``length`` bytes.

    Returns doc_id, n_bytes, spans (array of start and length in bytes, maximal
    and in order), n_removed, text_sha256 (of all bytes) and kept (the bytes
    that stay; null where nothing or all goes). Texts are UTF-8 bytes, whole;
    a null text is an empty one. Strings are those of the input, and overlaps
    count. Rows of one doc_id never take from each other; a row without an id
    is smaller and larger than none, so it keeps all and takes nothing. Texts
    shorter than ``length`` stay as they are. Other columns are left out; a
    table without rows gives one. ``length`` is 28 at least. Copies of a text
    are told by SHA-256 and looked at once.
    """
    if length < V + 7:
        raise ValueError(f"length must be {V + 7} at least")
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slots, buckets = max(1, -(-total // slot)), max(1, -(-total * len(COVER) // (V * bucket)))
    parts = min(slots, 4096)
    slot_of = F.pmod(F.xxhash64("uid", "no"), F.lit(slots)).alias("slot")
    bytes_ = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), bytes_.alias("bytes")).select("doc", "bytes", F.octet_length("bytes").cast("long").alias("n_bytes"), F.sha2("bytes", 256).alias("sha"), F.monotonically_increasing_id().alias("uid"))
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"greatest(n_bytes - 1, 0) div {piece}")))
    cut_out = F.expr(f"substring(bytes, cast(no * {piece} - if(no = 0, 0, {length - 1}) + 1 as int), cast({piece + length - 1} + if(no = 0, 0, {length - 1}) as int))")
    texts = cut_by(rows.select("*", numbers.alias("no")).select("doc", "uid", "no", "n_bytes", "sha", slot_of, cut_out.alias("body")), "slot", parts, "texts")
    known = cut(texts.where("no = 0").select("doc", "uid", "n_bytes", "sha"), "rows")
    groups = cut(known.where((F.col("n_bytes") >= length) & F.col("doc").isNotNull()).groupBy("sha").agg(F.min(F.struct("doc", "uid")).alias("first"), F.first("n_bytes").alias("n_bytes"), F.count("*").alias("k")).select("sha", F.col("first.doc").alias("owner"), F.col("first.uid").alias("uid"), "n_bytes", "k"), "copies")
    picks = groups.select("uid", numbers.alias("no")).select(slot_of, "uid")
    bodies = texts.select("slot", "uid", "no", "doc", "n_bytes", "body").groupBy("slot")

    def exchanged(f, messages: DataFrame, answer, name: str) -> DataFrame:
        """What a round in the texts sends, answered in the buckets; only the answers are written."""
        sent = bodies.cogroup(messages.groupBy("slot")).applyInArrow(f, _MESSAGE)
        return cut(sent.groupBy("bucket").applyInArrow(answer, _MESSAGE), name)

    samples = exchanged(_sample(buckets, length), picks, _twice, "samples")
    around = exchanged(_around(buckets, length), samples, _earliest, "around")
    windows = exchanged(_merge(buckets, length), around, _earliest, "windows")
    gone = cut(bodies.cogroup(windows.groupBy("slot")).applyInArrow(_remove(buckets, length, piece), "uid long, no long, n_bytes long, starts array<long>, lengths array<long>, kept binary"), "gone")
    release(samples, around, windows, texts)
    long_ones = gone.where(F.col("n_bytes") > piece).groupBy("uid").applyInPandas(_joined, "uid long, starts array<long>, lengths array<long>, kept binary")
    found = gone.where(F.col("n_bytes") <= piece).select("uid", "starts", "lengths", "kept").unionByName(long_ones)
    spans = F.arrays_zip(F.col("starts").alias("start"), F.col("lengths").alias("length"))
    told = groups.join(found.where(F.size("starts") > 0).select("uid", spans.alias("spans"), "kept"), "uid", "left").where("k > 1 or spans is not null").select("sha", "owner", "k", "spans", "kept")
    out = join_hot(known.select("doc", "n_bytes", "sha"), told, "sha", "k", known.count(), "left")
    copy, own = F.col("doc") > F.col("owner"), F.col("doc") == F.col("owner")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("length")))
    goes = F.when(copy, whole).when(own, F.col("spans"))
    out = out.select("doc", "n_bytes", "sha", F.coalesce(goes, F.array().cast("array<struct<start:long,length:long>>")).alias("spans"), F.when(own, F.col("kept")).alias("kept"))
    return out.select(F.col("doc").alias("doc_id"), "n_bytes", "spans", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"]).alias("n_removed"), F.col("sha").alias("text_sha256"), "kept")


def digest(docs: DataFrame, length: int = LENGTH, **sizes: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each row; see :func:`repeats`."""
    kept = F.when(F.col("n_removed") == 0, F.col("text_sha256")).when(F.col("n_removed") == F.col("n_bytes"), F.sha2(F.lit(b""), 256)).otherwise(F.sha2("kept", 256))
    return repeats(docs, length, **sizes).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), kept.alias("kept_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


ORACLE = f"""
    with d as (select row_number() over () as r, doc_id, octet_length(encode(coalesce(text, ''))) as n, hex(encode(coalesce(text, ''))) as h from documents),
    w as (select r, doc_id, s, substring(h, 2 * s + 1, {2 * LENGTH}) as w from d, lateral (select unnest(range(0, n - {LENGTH} + 1)) as s)),
    m as (select w, min(doc_id) as least from w group by w having count(*) > 1),
    gone as (select r, s from w join m using (w) where least < doc_id),
    marked as (select *, case when s <= lag(s) over (partition by r order by s) + {LENGTH} then 0 else 1 end as fresh from gone),
    counted as (select *, sum(fresh) over (partition by r order by s) as k from marked),
    spans as (select r, k, min(s) as a, max(s) + {LENGTH} as e from counted group by all),
    gaps as (select *, coalesce(lag(e) over (partition by r order by a), 0) as b from spans),
    cuts as (select r, count(*) as n_spans, sum(e - a)::bigint as n_removed, max(e) as last from spans group by r),
    kept as (select r, string_agg(substring(h, 2 * b + 1, 2 * (a - b)), '' order by a) as head from gaps join d using (r) group by r)
    select doc_id, n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
      sha256(unhex(coalesce(head, '') || substring(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
    from d left join cuts using (r) left join kept using (r)
"""
