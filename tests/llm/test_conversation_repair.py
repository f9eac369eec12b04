"""Repair of conversations against a search over whole audits by cost and text."""

import collections
import hashlib
import heapq
import random
import re
import zlib

import pytest

from millrace.llm import conversation_repair as repair

WHITE = " \t\n\x0b\x0c\r"


def brute(rows):
    """The result for a conversation's rows (turn, role, text) after damage, in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        end = text.rstrip(WHITE)
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    due = {"": "user", "s": "user", "a": "user", "u": "assistant"}
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        heapq.heappush(heap, (cost + 2, audit + "I", i, due[state][0], (*out, due[state] + ":")))
        if i < len(rows):
            (_, role, text), off = rows[i], faults[i] == "truncated"
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
            if faults[i] in ("", "truncated"):
                heapq.heappush(heap, (cost + 2 + off, audit + "R", i + 1, due[state][0], (*out, f"{due[state]}:{text}")))
                if role[:1] == due[state][0] or (role[:1] == "s" and state == ""):
                    heapq.heappush(heap, (cost + off, audit + "K", i + 1, role[:1], (*out, f"{role}:{text}")))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def damaged(rows):
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out[conv] += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, v in out.items()}


def expected(rows):
    return sorted(((c, *brute(v)) for c, v in damaged(rows).items()), key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def result(df, **sizes):
    return sorted(map(tuple, repair.repair(repair.damaged(df), **sizes).collect()), key=str)


def test_given_conversations(spark, small):
    df = spark.read.parquet(f"{small}/conversations.parquet")
    want = expected(map(tuple, df.collect()))
    assert sorted(map(tuple, repair.query(spark, small).collect()), key=str) == want
    assert result(df, block=3, fan=2) == want


@pytest.mark.parametrize("sizes", [{}, {"block": 7, "fan": 2}, {"block": 2, "fan": 3}])
def test_one_conversation_with_most_rows(spark, sizes):
    """It spans many blocks and groups of blocks; nulls anywhere, repeated turns and rows, roles of other names."""
    rng = random.Random(5)
    text = lambda i: rng.choice(["a.", "b", "c!", None, "", f"t{i}?", f"x{i}", " \t", "ß."])
    rows = [(i % 5 and 1 or 2 + i % 3, i if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "system", "tool", "", None]), text(i)) for i in range(260)]
    rows += [(None, 1, "user", "hello."), (None, None, "assistant", "x"), rows[3], rows[3]]
    assert result(table(spark, rows), **sizes) == expected(rows)


@pytest.mark.parametrize("seed", range(3))
def test_short_conversations(spark, seed):
    """All sorts of beginnings and ends, of which many repairs cost the same."""
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b.", "c"]) + str(t) * (rng.random() < 0.5) + rng.choice(["", "."])) for c in range(120) for t in range(rng.randint(1, 6))]
    assert result(table(spark, rows)) == expected(rows)


def test_long_texts_and_other_columns(spark):
    rows = [(1, 0, "user", "word " * 200_000 + "."), (1, 1, "assistant", "x" * 500_000), (2, 7, "user", "." * 10)]
    df = table(spark, rows).selectExpr("*", "1 as key", "'b' as block", "0 as rn")
    assert result(df) == expected(rows)


def test_no_rows(spark):
    assert repair.repair(repair.damaged(table(spark, []))).count() == 0


def test_all_rows_dropped(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert result(table(spark, [(conv, 0, "user", "a.")])) == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_conversations_and_sql(same):
    same(repair.query, repair.ORACLE)
