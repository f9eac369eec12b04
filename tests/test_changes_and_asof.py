"""Changes applied to tables, as-of joins in all directions, event-time windows at their edges; against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import changes
from millrace.operators.joins import DIRECTIONS, asof
from millrace.streaming import event_time


def brute(left, right, direction, within):
    """Index of the right row for each left row, by comparing all."""
    out = {}
    for i, k, t in left:
        fit = [(u, s, v) for rk, u, s, v in right if k is not None and rk == k and t is not None and u is not None]
        before = max(((u, -1 if s is None else s, v) for u, s, v in fit if u <= t and (within is None or t - u <= within)), default=None)
        after = max(((-u, -1 if s is None else s, v) for u, s, v in fit if u >= t and (within is None or u - t <= within)), default=None)
        best = before if direction == "backward" else after
        if direction == "nearest":
            best = before if after is None or (before is not None and t - before[0] <= -after[0] - t) else after
        out[i] = best and best[2]
    return out


@pytest.mark.parametrize("direction", DIRECTIONS)
@pytest.mark.parametrize("within", [None, 3])
@pytest.mark.parametrize("sliced", [False, True])
def test_asof_equals_brute_force(spark, direction, within, sliced):
    rng = random.Random(7)
    pick = lambda n, most: [None if rng.random() < 0.05 else rng.randrange(most) for _ in range(n)]
    left = list(zip(range(200), pick(200, 4), pick(200, 90), strict=True))
    # the value follows from time and tie, so that rows that tie in both are alike
    right = [(k, u, s, None if u is None else 1000 * u + (-1 if s is None else s)) for k, u, s in zip(pick(90, 4), pick(90, 90), pick(90, 3), strict=True)]
    a = spark.createDataFrame(left, "id long, k long, t long").repartition(3)
    b = spark.createDataFrame(right, "k long, u long, s long, t long").repartition(3)
    out = asof(a, b, "k", "t", "u", ["t"], "s", direction, (lambda x: F.floor(x / 10)) if sliced else None, None if within is None else F.lit(within))
    assert out.columns == ["id", "k", "t", "t_right"]
    assert {r["id"]: r["t_right"] for r in out.collect()} == brute(left, right, direction, within)


def test_asof_of_times_and_unknown_directions(spark):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    a = spark.createDataFrame([(1, at(60)), (1, at(300)), (2, at(0))], "k long, t timestamp_ntz")
    b = spark.createDataFrame([(1, at(50), 5), (1, at(65), 6), (1, at(2000), 7)], "k long, u timestamp_ntz, v long")
    out = asof(a, b, "k", "t", "u", ["v"], "v", "nearest", lambda t: F.date_trunc("hour", t), F.expr("interval 1 hour"))
    assert sorted(((r["k"], r["v"]) for r in out.collect()), key=str) == [(1, 6), (1, None), (2, None)]
    assert asof(a, b.limit(0), "k", "t", "u", ["v"], "v", "forward").where("v is null").count() == 3
    assert asof(a.limit(0), b, "k", "t", "u", ["v"], "v", "nearest").count() == 0
    with pytest.raises(ValueError, match="direction"):
        asof(a, b, "k", "t", "u", ["v"], "v", "sideways")


def test_asof_without_slices_hands_nothing_on(spark):
    a = spark.range(10).select(F.col("id").alias("k"), F.col("id").alias("t"))
    assert "Join" not in asof(a, a, "k", "t", "t", ["t"], "t", "nearest")._jdf.queryExecution().optimizedPlan().toString()


TABLE = [(1, "a", 10, 0.5), (2, "b", 20, 0.5), (2, "b2", 21, 0.5), (3, None, None, None), (None, "n", 0, 0.5), (6, "f", 60, 0.5)]
CHANGES = [
    (1, 1, "a1", False), (1, 3, "a3", False), (1, 2, "late", True), (1, 3, "a3", False),  # late and repeated
    (2, 5, None, None), (3, 1, "x", False), (3, 2, "x", True), (4, 1, "new", False), (5, 1, "new", True), (None, 9, "null key", False), (None, None, "no time", True),
]


def test_changes_at_their_edges(spark):
    table = spark.createDataFrame(TABLE, "id long, name string, n long, b double")
    moves = spark.createDataFrame(CHANGES, "id long, at long, name string, gone boolean").repartition(3)
    go = lambda t, c: sorted(map(tuple, changes.apply_changes(t, c, ["id"], ["at"], "gone").collect()), key=str)
    want = sorted([(1, "a3", 10, 0.5), (2, None, 20, 0.5), (2, None, 21, 0.5), (4, "new", None, None), (None, "null key", 0, 0.5), (6, "f", 60, 0.5)], key=str)
    assert go(table, moves) == want
    assert go(table, moves.union(moves)) == want
    assert go(table, moves.limit(0)) == sorted(TABLE, key=str)
    assert go(table.limit(0), moves) == sorted([(1, "a3", None, None), (2, None, None, None), (4, "new", None, None), (None, "null key", None, None)], key=str)


def test_changes_in_parts_end_as_all_at_once(spark):
    rng = random.Random(3)
    moves = [(rng.randrange(30), i, rng.randrange(100), rng.random() < 0.3) for i in range(300)]
    schema = "id long, at long, x long, gone boolean"
    table, empty = spark.createDataFrame([(i, 0) for i in range(20)], "id long, x long"), spark.createDataFrame([], schema)
    state = {i: 0 for i in range(20)}
    for k, _, x, gone in moves:
        state.pop(k, None) if gone else state.update({k: x})
    step = lambda t, rows: changes.apply_changes(t, spark.createDataFrame(rows, schema) if rows else empty, ["id"], ["at"], "gone")
    assert dict(map(tuple, step(table, moves).collect())) == state
    assert dict(map(tuple, step(step(table, moves[:170]), moves[170:]).collect())) == state


def test_newest_is_reduced_before_the_exchange(spark):
    df = spark.createDataFrame([(1, 2, "a", 1.0), (1, 2, "b", None), (1, None, "z", 9.0), (None, None, None, None)], "`a.k` long, at long, v string, best double")
    assert sorted(map(tuple, changes.newest(df, ["a.k"], ["at"]).collect()), key=str) == sorted([(1, 2, "b", None), (None, None, None, None)], key=str)
    text = changes.newest(df.repartition(2), ["a.k"], ["at"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in text


def test_windows_of_rows_without_time_type_or_value(spark):
    at = dt.datetime(2024, 1, 1, 5, 10)
    rows = [(1, 1, "a", 2.0, at), (2, 1, "a", None, at), (3, None, None, 1.0, at), (4, 1, "a", 5.0, None)]
    events = event_time.instants(spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts timestamp_ntz"))
    hour = dt.datetime(2024, 1, 1, 5)
    assert sorted(map(tuple, event_time.tumbling(events).collect()), key=str) == sorted([(hour, "a", 2, 2.0), (hour, None, 1, 1.0)], key=str)
    assert sorted((r["start"].hour, r["n"]) for r in event_time.sliding(events).collect()) == [(0, 3), (2, 3), (4, 3)]
    assert sorted(map(tuple, event_time.sessions(events).collect()), key=str) == sorted([(1, at, 2), (None, at, 1)], key=str)
    for f in (event_time.tumbling, event_time.sliding, event_time.sessions):
        assert f(events.limit(0)).count() == 0
