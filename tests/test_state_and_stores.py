"""Processors with timers, outer joins of streams, stored tables, the connector, malformed files, table functions."""

import datetime as dt
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions import udfs
from millrace.operators.gaps import fill_gaps
from millrace.operators.joins import join_by
from millrace.sources import chunks, formats, stored
from millrace.streaming import event_time, processors, stateful
from tests.test_operators import in_order, run_all

START = dt.datetime(2024, 1, 1)
EVENTS = "event_id long, user_id long, event_type string, value double, ts timestamp_ntz"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def rocks(spark):
    for k, v in processors.SETTINGS.items():
        spark.conf.set(k, v)
    yield spark
    for k in processors.SETTINGS:
        spark.conf.unset(k)


def batches(spark, path, parts):
    for i, minutes in enumerate(parts):
        rows = [(1000 * i + k, user, kind, 1.0, START + dt.timedelta(minutes=m)) for k, (user, kind, m) in enumerate(minutes)]
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)  # files are taken by their times
    return event_time.instants(formats.load_stream(spark, path, "parquet", EVENTS, files_per_trigger=1))


def last_state(query):
    return query.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_sessions_by_timers_equal_the_batch(rocks, small, tmp_path):
    events = rocks.read.parquet(f"{small}/events.parquet").where("user_id < 40")
    got = {(r["user_id"], r["start"], r["n"]) for r in run_all(processors.closed_sessions(in_order(rocks, events, tmp_path, 3)), tmp_path, "timed").collect()}
    want = {tuple(r) for r in event_time.sessions(event_time.instants(events)).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)  # the last ones are not closed yet


def test_events_out_of_order_join_their_session_and_idle_users_have_no_state(rocks, tmp_path):
    stream = batches(rocks, str(tmp_path / "in"), [[(1, "a", 60), (1, "b", 0)], [(1, "a", 35), (1, "a", 20), (2, "a", 30)], [(3, "a", 1000)], [(3, "a", 2000)], [(3, "a", 2001)]])
    out = processors.closed_sessions(stream, 30)
    run = out.writeStream.format("memory").queryName("shuffled").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = sorted((r["user_id"], int((r["start"] - START).total_seconds() // 60), int((r["end"] - START).total_seconds() // 60), r["n"], r["types"]) for r in rocks.table("shuffled").collect())
    assert got == [(1, 0, 90, 4, 2), (2, 30, 60, 1, 1), (3, 1000, 1030, 1, 1)]
    # what is left belongs to user 3: two times and their types in list and map, and a timer
    assert last_state(run) <= 8


def test_state_with_a_time_to_live(rocks, tmp_path):
    path = str(tmp_path / "in")

    def go(rows):
        """Processing time goes on without data, so the query never ends by itself."""
        batches(rocks, path, [rows])
        stream = event_time.instants(formats.load_stream(rocks, path, "parquet", EVENTS))
        found = []
        sink = processors.first_of_type(stream, 4000).writeStream.foreachBatch(lambda df, n: found.extend(df.collect()))
        run = sink.option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
        end = time.time() + 30
        while not any(p["numInputRows"] for p in run.recentProgress) and time.time() < end and run.isActive:
            time.sleep(0.2)
        run.stop()
        return len(found)

    assert go([(1, "a", 0), (1, "b", 0), (2, "a", 0)]) == 3
    time.sleep(4.5)
    assert go([(1, "a", 1), (1, "a", 2)]) == 1  # known no more, and known again


def test_left_outer_join_of_streams(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    sides = [events.where(f"event_type = '{k}'") for k in ("error", "purchase")]
    streams = [in_order(spark, p, tmp_path, 3, f"outer{i}") for i, p in enumerate(sides)]
    got = {tuple(r) for r in run_all(stateful.answered(*streams, within="5 hours"), tmp_path, "outer").collect()}
    want = {tuple(r) for r in stateful.answered(*map(event_time.instants, sides), within="5 hours").collect()}
    ends = events.agg(F.max("ts")).first()[0] - dt.timedelta(hours=60)
    closed = {r["event_id"] for r in sides[0].where(F.col("ts") < F.lit(ends)).collect()}
    assert got <= want and {r for r in want if r[0] in closed} <= got and any(r[1] is None for r in got)


def test_update_mode_ends_as_the_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    seen = {}

    def keep(df, number):
        for r in df.collect():
            seen[r["start"], r["event_type"]] = (r["n"], r["total"])

    stream = event_time.tumbling(in_order(spark, events, tmp_path, 3, "updates"))
    stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert seen == {(r["start"], r["event_type"]): (r["n"], r["total"]) for r in event_time.tumbling(event_time.instants(events)).collect()}


def test_bucketed_tables_join_where_they_lie(spark, small):
    text = plan(stored.bucketed_join(spark, small))
    assert "SortMergeJoin" in text and "hashpartitioning(l_orderkey" not in text and "hashpartitioning(o_orderkey" not in text


def test_folders_are_pruned_by_the_other_side(spark, small):
    assert "dynamicpruning" in plan(stored.pruned_customers(spark, small)).lower()


def test_dynamic_overwrite_replaces_the_folders_that_come(spark, tmp_path):
    save = lambda rows: stored.save_partitioned(spark.createDataFrame(rows, "x long, k string"), str(tmp_path / "t"), "k")
    save([(1, "a"), (2, "a"), (3, "b"), (4, None)])
    save([(5, "a")])
    assert sorted((r["x"], r["k"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(3, "b"), (4, None), (5, "a")]


def test_statistics_change_the_order_of_joins(spark, small):
    text = stored.star_tables(spark, small)
    orders = [stored.by_cost(spark, text, on)._jdf.queryExecution().optimizedPlan().toString() for on in (True, False)]
    scans = [[name for line in x.split("\n") for name in ("lineitem", "orders", "customer", "nation") if f"default.{name}" in line] for x in orders]
    assert scans[1] == ["lineitem", "orders", "customer", "nation"] and scans[0] != scans[1]
    assert stored.by_cost(spark, text, True).exceptAll(stored.by_cost(spark, text, False)).isEmpty()


def test_a_failed_write_leaves_nothing_and_a_repeat_adds_nothing(spark, tmp_path):
    path, schema = str(tmp_path / "chunks"), "id long, x double"
    rows = spark.range(100).repartition(4).select("id", (F.col("id") / 2).alias("x"))
    chunks.save(rows, path, 0)
    chunks.save(rows, path, 0)
    assert chunks.load(spark, path, schema).count() == 100
    files = len(list((tmp_path / "chunks/data").iterdir()))
    broken = rows.select("id", F.when(F.col("id") == 77, F.raise_error(F.lit("no")).cast("double")).otherwise(F.col("x")).alias("x"))
    with pytest.raises(Exception, match="no"):
        chunks.save(broken, path, 1)
    time.sleep(0.5)
    assert chunks.load(spark, path, schema).count() == 100 and len(list((tmp_path / "chunks/data").iterdir())) == files
    chunks.save(rows.limit(0), path, 1)
    chunks.save(rows.limit(5), path)
    assert chunks.load(spark, path, schema).count() == 105


def test_a_task_that_fails_midway_deletes_its_file(tmp_path):
    def rows():
        yield pa.record_batch([pa.array([1])], ["x"])
        raise RuntimeError("midway")

    folder = chunks.Folder(str(tmp_path))
    with pytest.raises(RuntimeError):
        folder.write(rows())
    assert not list((tmp_path / "data").iterdir())


def test_streams_from_and_to_chunks(spark, tmp_path):
    a, b, schema = str(tmp_path / "a"), str(tmp_path / "b"), "id long"

    def copy():
        s = chunks.load_stream(spark, a, schema).where("id % 2 = 0")
        s.writeStream.format("chunks").option("path", b).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(60)

    chunks.save(spark.range(10), a)
    copy()
    chunks.save(spark.range(10, 20), a)
    copy()
    copy()
    assert sorted(r["id"] for r in chunks.load(spark, b, schema).collect()) == list(range(0, 20, 2))


def test_malformed_rows_are_kept_apart(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,x,2.5\n2,y,much\n3,z\n\n4,w,1.0,more\n,v,\n")
    good, bad = formats.load_checked(spark, str(tmp_path / "a.csv"), "csv", "id long, k string, v double")
    assert sorted(map(tuple, good.collect()), key=str) == [(1, "x", 2.5), (None, "v", None)]
    assert sorted(r["bad"] for r in bad.collect()) == ["2,y,much", "3,z", "4,w,1.0,more"]
    (tmp_path / "a.json").write_text('{"id": 1}\n{"id": \n{"id": "x"}\n')
    good, bad = formats.load_checked(spark, str(tmp_path / "a.json"), "json", "id long")
    assert [tuple(r) for r in good.collect()] == [(1,)] and bad.count() == 2
    with pytest.raises(ValueError):
        formats.load_checked(spark, "x", "orc", "id long")


def test_schemas_that_changed_are_merged(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "id long, x string").write.parquet(str(tmp_path / "t/at=1"))
    spark.createDataFrame([(2, 5)], "id long, y long").write.parquet(str(tmp_path / "t/at=2"))
    assert sorted((r["id"], r["x"], r["y"], r["at"]) for r in formats.load_merged(spark, str(tmp_path / "t")).collect()) == [(1, "a", None, 1), (2, None, 5, 2)]


def test_gaps_of_several_keys(spark):
    rows = [("a", 0, 1.0), ("a", 3, 4.0), ("a", 4, 0.0), ("b", 5, 7.0), (None, 0, 2.0), (None, 2, None), (None, 4, 6.0)]
    df = spark.createDataFrame([(k, START + dt.timedelta(hours=h), v) for k, h, v in rows], "k string, t timestamp, v double")
    got = sorted(((r["k"], int((r["t"] - START).total_seconds() // 3600), r["before"], r["after"], r["interpolated"], r["filled"]) for r in fill_gaps(df, ["k"], "t", "v", 3600).collect()), key=str)
    want = [("a", 0, 1.0, 1.0, 1.0, False), ("a", 1, 1.0, 4.0, 2.0, True), ("a", 2, 1.0, 4.0, 3.0, True), ("a", 3, 4.0, 4.0, 4.0, False), ("a", 4, 0.0, 0.0, 0.0, False), ("b", 5, 7.0, 7.0, 7.0, False)]
    want += [(None, h, 2.0 if h < 4 else 6.0, 2.0 if h == 0 else 6.0, 2.0 + h, h not in (0, 4)) for h in range(5)]
    assert got == sorted(want, key=str)
    assert fill_gaps(df.limit(0), ["k"], "t", "v", 3600).count() == 0


def test_streaks_take_the_types_of_their_table(spark):
    rows = [("u", 1, 5), ("u", 2, 5), ("u", 3, None), ("u", 4, 7), ("v", 1, 7), (None, 2, 7)]
    df = spark.createDataFrame(rows, "k string, t int, x int").repartition(3)
    out = udfs.Streaks(df.asTable(), F.lit("k"), F.lit("t"), F.lit("x"))
    assert [f.dataType.simpleString() for f in out.schema] == ["string", "int", "int", "int", "bigint"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("u", 5, 1, 2, 2), ("u", None, 3, 3, 1), ("u", 7, 4, 4, 1), ("v", 7, 1, 1, 1), (None, 7, 2, 2, 1)], key=str)
    with pytest.raises(Exception, match="no column"):
        udfs.Streaks(df.asTable(), F.lit("k"), F.lit("t"), F.lit("y")).collect()


def test_initials_of_any_script(spark):
    names = spark.createDataFrame([("Über alles",), ("élan vital",), ("a1 b_2",), (None,)], "n string")
    assert [r[0] for r in names.select(udfs.initials("n")).collect()] == ["Üa", "év", "ab", None]


def test_join_strategies(spark, small):
    a, b = spark.range(100).withColumn("x", F.lit(1)), spark.range(50)
    assert "SortMergeJoin" in plan(join_by(a, b, ["id"], "merge")) and "ShuffledHashJoin" in plan(join_by(a, b, ["id"], "shuffle_hash")) and "BroadcastHashJoin" in plan(join_by(a, b, ["id"], "broadcast"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in plan(join_by(a, b, ["id"], "broadcast", most=10))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(ValueError):
        join_by(a, b, ["id"], "shuffle_replicate_nl")


def test_streaks_make_no_frame_of_each_row(spark, small):
    """With Arrow, every call of a row-wise table function gives a pandas frame of its own, at several times the cost."""
    text = plan(udfs.event_streaks(spark, small))
    assert "BatchEvalPythonUDTF" in text and "ArrowEvalPythonUDTF" not in text
