"""Joins with hot keys, and the shared folder."""

import collections
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from millrace.llm import common


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot", [1, 2, 1000])
def test_join_hot_is_a_join(spark, monkeypatch, how, hot):
    """A hot key, cold ones, keys without a partner, null keys and repeated rows."""
    monkeypatch.setattr(common, "HOT", hot)
    keys = ["hot"] * 500 + [f"k{i % 40}" for i in range(200)] + [None] * 30 + ["alone"] * 3
    rows = spark.createDataFrame([(i % 300, k) for i, k in enumerate(keys)], "n long, key string")
    counts = collections.Counter(k for k in keys if k not in (None, "alone"))
    keyed = spark.createDataFrame([(k, k.upper(), c) for k, c in counts.items()], "key string, name string, c long")
    got = common.join_hot(rows, keyed, "key", "c", len(keys), how)
    want = rows.join(keyed.drop("c"), "key", how)
    assert got.columns == ["key", "n", "name"] or got.columns == ["n", "key", "name"]
    assert sorted(map(repr, got.select("n", "key", "name").collect())) == sorted(map(repr, want.select("n", "key", "name").collect()))
    assert common.join_hot(rows.limit(0), keyed, "key", "c", 0, how).count() == 0


def test_a_cluster_must_name_its_shared_folder():
    def session(master, folder=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=context)

    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(session(master))
        assert common.shared_dir(session(master, "hdfs://x/y")) == "hdfs://x/y"
    assert common.shared_dir(session("local[4]")) == common.shared_dir(session("local"))


def test_cut_tables_are_read_again_and_released(spark):
    df = common.cut(spark.range(10).withColumn("x", F.col("id") * 2), "test")
    assert common.again(df).join(df, "id").count() == 10
    common.release(df)
    with pytest.raises(Exception, match="(?i)exist|not found"):
        spark.read.parquet(df._millrace_path).count()


def test_a_step_holds_nothing_when_it_gives_memory_back(monkeypatch):
    import gc
    import weakref

    alive, seen = weakref.WeakSet(), []

    class Held:
        pass

    def step(batches):
        for b in batches:
            held = Held()
            alive.add(held)
            yield b

    monkeypatch.setattr(common, "give_back", lambda: (gc.collect(), seen.append(len(alive))))
    assert list(common.giving_back(step)(iter([1, 2, 3]))) == [1, 2, 3] and seen == [0]
