"""Operators that split groups of any size, against plain loops, and their plans."""

import functools
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import aggregates, intervals, ordered
from millrace.operators.intervals import overlap_join, range_join
from millrace.operators.ordered import dominated, running
from millrace.operators.percentiles import percentiles


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(spark, n, seed=1):
    """One group has most rows, keys tie, and there are nulls."""
    rng = random.Random(seed)
    return [(i, rng.choice(["hot"] * 8 + ["a", None]), rng.choice([None, *range(12)]), rng.choice([None, 1, 2, 5])) for i in range(n)]


@pytest.mark.parametrize("by", [[], ["g"]])
def test_running_totals_and_ranks(spark, by):
    rows = rows_of(spark, 400)
    df = spark.createDataFrame(rows, "id long, g string, k long, v long").repartition(5)
    got = {r["id"]: (r["rn"], r["total"], r["rank"]) for r in running(df, by, ["-k", "id"], {"total": F.col("v")}).join(running(df, by, ["-k"], ranks=True).select("id", "rank"), "id").collect()}
    want, groups = {}, {}
    for r in sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[0])):
        groups.setdefault(r[1] if by else 0, []).append(r)
    for members in groups.values():
        total = 0
        for place, r in enumerate(members, 1):
            total += r[3] or 0
            want[r[0]] = (place, total, 1 + next(i for i, x in enumerate(members) if x[2] == r[2]))
    assert got == want


def test_running_where_groups_go_on_in_other_ranges(spark):
    """As many ranges as rows nearly, so that groups begin, go on and end in different ones."""
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(i, i // 17, 1) for i in range(200)], "id long, g long, v long")
        got = {r["id"]: (r["rn"], r["s"]) for r in running(df, ["g"], ["id"], {"s": F.col("v") * 2}).collect()}
        assert got == {i: (i % 17 + 1, 2 * (i % 17 + 1)) for i in range(200)}
        whole = {r["id"]: r["rn"] for r in running(df, [], ["id"]).collect()}
        assert whole == {i: i + 1 for i in range(200)}
        tied = {r["id"]: r["rank"] for r in running(df, [], ["g"], ranks=True).collect()}
        assert tied == {i: i // 17 * 17 + 1 for i in range(200)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_running_of_nothing_and_its_plan(spark, small):
    empty = spark.createDataFrame([], "id long, g string")
    assert running(empty, [], ["id"]).count() == 0 and running(empty, ["g"], ["id"], ranks=True).count() == 0
    assert "SinglePartition" not in plan(ordered.order_ranks(spark, small))


@pytest.mark.parametrize("seed", [1, 2])
def test_dominated_equals_pairs(spark, seed):
    rng = random.Random(seed)
    point = lambda: (rng.choice([None, *range(20)]), rng.choice([None, *range(15)]))
    left, right = [(i, *point()) for i in range(150)], [(i, *point()) for i in range(120)]
    a, b = spark.createDataFrame(left, "id long, x long, y long"), spark.createDataFrame(right + right[:5], "id long, x long, y long")
    got = {r["id"]: r["n"] for r in dominated(a, b, "x", "y").collect()}
    ok = lambda p, q: None not in (*p[1:], *q[1:]) and q[1] > p[1] and q[2] < p[2]
    assert got == {p[0]: sum(ok(p, q) for q in right + right[:5]) for p in left}
    assert all(r["n"] == 0 for r in dominated(a, b.limit(0), "x", "y").collect())
    assert "NestedLoop" not in plan(dominated(a, b, "x", "y")) and "Cartesian" not in plan(dominated(a, b, "x", "y"))


@pytest.mark.parametrize("limit", [3, 50_000])
def test_percentiles_equal_sorting(spark, limit):
    rng = random.Random(3)
    groups = {"hot": [rng.gauss(0, 10) for _ in range(2000)], "ties": [float(rng.choice([1, 1, 1, 2])) for _ in range(300)], "wide": [10.0 ** rng.randint(-300, 300) * rng.choice([1, -1]) for _ in range(200)], "one": [4.5], None: [1.0, 2.0], "none": []}
    rows = [(g, v) for g, values in groups.items() for v in values] + [("none", None), ("hot", None)]
    marks = {"least": 0.0, "tenth": 0.1, "mid": 0.5, "high": 0.97, "most": 1.0}
    got = {r["g"]: r for r in percentiles(spark.createDataFrame(rows, "g string, v double").repartition(3), ["g"], "v", marks, limit).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        for name, f in marks.items():
            if not values:
                assert got[g][name] is None
            else:
                assert got[g][name] == pytest.approx(float(np.percentile(values, 100 * f)), rel=1e-9, abs=1e-12)


def test_percentiles_of_whole_tables_whole_numbers_and_nothing(spark):
    df = spark.createDataFrame([(x,) for x in [3, 1, 2, 10**15, None]], "v long")
    assert percentiles(df, [], "v", {"m": 0.5}, 1).first()["m"] == statistics.median([3, 1, 2, 10**15])
    assert percentiles(df.limit(0).selectExpr("v", "1 as g"), ["g"], "v", {"m": 0.5}).count() == 0
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (-float("inf"),), (1.0,), (2.0,)], "v double")
    r = percentiles(odd, [], "v", {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.75, "e": 1.0}, 1).first()
    assert r["a"] == -float("inf") and r["b"] == 1.0 and r["c"] == 2.0 and r["d"] == float("inf") and r["e"] != r["e"]


@pytest.mark.parametrize("width", [0.5, 10.0, 1000.0])
def test_overlaps_equal_pairs(spark, width):
    """Short and very long intervals, such as touch, without length, turned round, and with null bounds."""
    rng = random.Random(7)

    def span():
        s = rng.choice([rng.uniform(-50, 50), float(rng.randint(-5, 5))])
        return rng.choice([(s, s + rng.choice([0.0, 1.0, 3.0, 200.0, 1e7])), (s, s + 1), (s, None), (None, s), (s, s - 1)])

    left, right = [(i, rng.choice(["k"] * 5 + ["l", None]), *span()) for i in range(120)], [(i, rng.choice(["k"] * 5 + ["l", None]), *span()) for i in range(100)]
    schema = "id long, k string, s double, e double"
    got = sorted((r["id"], r["id_right"]) for r in overlap_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ("s", "e"), ("s", "e"), ["k"], width).collect())
    ok = lambda a, b: None not in (*a[1:], *b[1:]) and a[1] == b[1] and a[2] < a[3] and b[2] < b[3] and a[2] < b[3] and b[2] < a[3]
    assert got == sorted((a[0], b[0]) for a in left for b in right if ok(a, b))


def test_long_intervals_make_few_rows(spark):
    df = spark.createDataFrame([(0.0, 1e9)], "s double, e double")
    filed = intervals._filed(intervals._levelled(df, "a", "s", "e", [], 1.0), "a", list(range(13)), 1.0)
    assert filed.count() < 60


def test_ranges_of_any_width(spark):
    points = spark.createDataFrame([(i, i * 1.7) for i in range(60)] + [(99, None)], "p long, x double")
    ranges = spark.createDataFrame([(0, 5.0, 5.0), (1, 9.0, 3.0), (2, None, 4.0), (3, 0.0, 1e9), (4, 10.0, 12.0), (5, -1e8, 20.0)], "r long, lo double, hi double")
    got = {(r["p"], r["r"]) for r in range_join(points, ranges, "x", "lo", "hi", 1.0).collect()}
    assert got == {(i, r) for i in range(60) for r, lo, hi in ((3, 0.0, 1e9), (4, 10.0, 12.0), (5, -1e8, 20.0)) if lo <= i * 1.7 < hi}


def test_interval_joins_meet_in_cells(spark, small):
    """The join's keys hold a cell of time besides the user."""
    from millrace.operators.joins import errors_after_purchases

    keys = [x for x in plan(errors_after_purchases(spark, small)).split("\n") if "Join" in x]
    assert any("a_cell" in x and "a_key" in x for x in keys)


def test_sketches_are_as_near_as_they_promise(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    exact = {r["event_type"]: r for r in events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.sort_array(F.collect_list("value")).alias("v")).collect()}
    for r in aggregates.merged_estimates(aggregates.daily_sketches(events)).collect():
        e = exact[r["event_type"]]
        assert abs(r["users"] / e["users"] - 1) < 0.1 and r["users_by_theta"] == e["users"]
        place = np.searchsorted(e["v"], r["median"]) / len(e["v"])
        assert 0.4 < place < 0.6
    lines = spark.read.parquet(f"{small}/lineitem.parquet")
    for r in aggregates.estimates(lines).collect():
        same = lines.where(F.col("l_linestatus") == r["l_linestatus"])
        assert abs(r["parts"] / same.select("l_partkey").distinct().count() - 1) < 0.1
        assert abs(same.where(F.col("l_extendedprice") <= r["median"]).count() / r["n"] - 0.5) < 0.001


def test_distinct_users_of_any_number(spark):
    """More users than a sketch holds, just as many, few, none but null, and a null type."""
    sizes = {"many": 20_000, "full": aggregates.HELD, "few": 30, "none": 0, None: 9_000}
    parts = [spark.range(2 * n).select(F.lit(t).cast("string").alias("event_type"), (F.col("id") % max(n, 1)).alias("user_id"), F.expr("timestamp'2024-01-01' + make_dt_interval(cast(id % 5 as int))").alias("ts"), F.lit(1.0).alias("value")) for t, n in sizes.items()]
    parts.append(spark.createDataFrame([(t, None) for t in sizes], "event_type string, user_id long").selectExpr("*", "timestamp'2024-01-01' as ts", "1.0d as value"))
    got = {r["event_type"]: (r["n"], r["users"]) for r in aggregates.distinct_users(functools.reduce(lambda a, b: a.unionByName(b), parts)).collect()}
    assert got == {t: (2 * n + 1, n) for t, n in sizes.items()}


def test_estimates_beside_exact_values(spark):
    """Distinct parts and medians are both judged, of a null status too; null prices and parts count as rows only."""
    rows = [(t, None if i % 10 == 0 else i % 700, None if i % 5 == 0 else float(i)) for t in ("F", None) for i in range(5_000)]
    got = aggregates.nearness(spark.createDataFrame(rows, "l_linestatus string, l_partkey long, l_extendedprice double")).collect()
    n_parts = len({k for _, k, _ in rows if k is not None})
    assert sorted((r["l_linestatus"] or "", r["n"], r["distinct_near"], r["median_near"], r["n_parts"], r["hundredths"]) for r in got) == [(t, 5_000, True, True, n_parts, 50) for t in ("", "F")]
    odd = spark.createDataFrame([("F", None, None), ("O", 1, 0.0)], "l_linestatus string, l_partkey long, l_extendedprice double")
    assert {r["l_linestatus"]: (r["n_parts"], r["median_near"]) for r in aggregates.nearness(odd).collect()} == {"F": (0, None), "O": (1, True)}
