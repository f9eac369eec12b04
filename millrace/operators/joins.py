"""Joins: equi, outer, semi, anti, lateral, range, interval and as-of."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import read
from .intervals import followed_within, range_join


DIRECTIONS = ("backward", "forward", "nearest")


def asof(
    left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str], tie: str,
    direction: str = "backward", slice_of: Callable[[Column], Column] | None = None, within: Column | None = None,
) -> DataFrame:
    """Each left row with the values of one right row of its key.

    ``backward`` takes the latest right row at or before the left row's time,
    ``forward`` the earliest at or after it, ``nearest`` the nearer of the two
    and the earlier of two as near. ``within`` (an interval, or a number for
    times that are numbers) is the greatest distance that counts.

    Both sides are put in one stream and the last right row is carried on: no
    pair of rows is made. ``slice_of`` cuts time into slices (a function of a
    time that never falls, such as its day): a key's slices are then worked on
    by different tasks, and what stands at their ends is handed on as one row
    for each key and slice, so that a key with most of the rows is no single
    task. Without it a key is one slice, and nothing is handed on.

    Of right rows at one time the one with the greatest ``tie`` (an integer,
    null the least) counts. Left rows without such a row, or with a null key or
    time, have nulls; right rows with a null key or time are never taken. A
    value whose name ``left`` has too gets ``_right`` behind its name.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"no direction {direction}")
    ways = [d for d in DIRECTIONS[:2] if direction in (d, "nearest")]
    cut_time = slice_of or (lambda _: F.lit(0))
    rows = left.select(F.col(key).alias("k"), F.col(left_time).alias("t"), cut_time(F.col(left_time)).alias("slice"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("tie"), F.struct("*").alias("row"))
    packed = F.struct(F.col(right_time).alias("t"), *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])
    others = right.select(F.col(key).alias("k"), F.col(right_time).alias("t"), cut_time(F.col(right_time)).alias("slice"), F.lit(0).alias("side"), F.col(tie).cast("long").alias("tie"), packed.alias("p")).where("k is not null and t is not null")
    by_slice, up_to = Window.partitionBy("k", "slice"), (Window.unboundedPreceding, Window.currentRow)
    time = {"backward": F.col("t").asc(), "forward": F.col("t").desc()}
    both = rows.unionByName(others, allowMissingColumns=True)
    seen = both.select("*", *[F.last("p", ignorenulls=True).over(by_slice.orderBy(time[d], "side", F.col("tie").asc_nulls_first()).rowsBetween(*up_to)).alias(d) for d in ways]).where("side = 1")
    if slice_of:
        ends = {"backward": F.max_by("p", F.struct("t", "tie")), "forward": F.min_by("p", F.struct("t", F.coalesce(F.bitwise_not("tie"), F.lit(2**63 - 1))))}
        edges = rows.where("k is not null").select("k", "slice").distinct().join(others.groupBy("k", "slice").agg(*[ends[d].alias(d) for d in ways]), ["k", "slice"], "full")
        along = Window.partitionBy("k").orderBy("slice")
        beyond = {"backward": F.last("backward", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)), "forward": F.first("forward", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing))}
        handed = edges.select("k", "slice", *[beyond[d].alias(f"{d}_handed") for d in ways]).where(" or ".join(f"{d}_handed is not null" for d in ways))
        seen = seen.join(handed, ["k", "slice"], "left")
    far = {"backward": lambda p: F.col("t") - p["t"], "forward": lambda p: p["t"] - F.col("t")}
    found = {}
    for d in ways:
        p = F.coalesce(d, f"{d}_handed") if slice_of else F.col(d)
        counts = F.col("t").isNotNull() if within is None else far[d](p) <= within
        found[d] = F.when(counts, p)
    seen = seen.select("row", "t", *[p.alias(d) for d, p in found.items()])
    if direction == "nearest":
        b, f = F.col("backward"), F.col("forward")
        best = F.when(f.isNull() | (far["backward"](b) <= far["forward"](f)), b).otherwise(f)
    else:
        best = F.col(direction)
    out = seen.select("row.*", best.alias("found"))
    return out.select(*left.columns, *[F.col(f"found.v{i}").alias(f"{v}_right" if v in left.columns else v) for i, v in enumerate(values)])


def asof_backward(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str], tie: str, slice_of: Callable[[Column], Column] | None = None) -> DataFrame:
    """:func:`asof` with the latest right row at or before each left row's time."""
    return asof(left, right, key, left_time, right_time, values, tie, "backward", slice_of)


def region_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of 1996 by region: filter on orders first, then the fact table, then dimensions."""
    orders = read(spark, sf_dir, "orders").where((F.col("o_orderdate") >= "1996-01-01") & (F.col("o_orderdate") < "1997-01-01"))
    return (
        read(spark, sf_dir, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("r_name")
        .agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))
    )


def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = read(spark, sf_dir, "orders").where(F.col("o_orderdate") >= "2001-06-01")
    return read(spark, sf_dir, "customer").join(late, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def customers_with_large_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = read(spark, sf_dir, "orders").where("o_totalprice > 300000")
    return read(spark, sf_dir, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


def orders_left_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))
    return read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderpriority").agg(F.count("*").alias("n_orders"), F.count("l_orderkey").alias("n_matched"), F.coalesce(F.sum("n_lines"), F.lit(0)).alias("n_lines"))


def nations_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = read(spark, sf_dir, "customer").where("c_acctbal > 9900").groupBy("c_nationkey").agg(F.count("*").alias("n_customers"))
    poor = read(spark, sf_dir, "supplier").where("s_acctbal < 0").groupBy("s_nationkey").agg(F.count("*").alias("n_suppliers"))
    return rich.join(poor, F.col("c_nationkey") == F.col("s_nationkey"), "full").select(F.coalesce("c_nationkey", "s_nationkey").alias("nationkey"), "n_customers", "n_suppliers")


def parts_right_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with what was sold of them in bulk, if anything."""
    bulk = read(spark, sf_dir, "lineitem").where("l_quantity >= 49").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return bulk.join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "right").select("p_partkey", F.coalesce("n", F.lit(0)).alias("n"))


def words_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each part's name with their places, by a lateral join with a table function."""
    words = spark.tvf.posexplode(F.split(F.col("p_name").outer(), " "))
    return read(spark, sf_dir, "part").lateralJoin(words).select("p_partkey", F.col("pos").cast("long").alias("place"), F.col("col").alias("word"))


def price_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by price band, as a range join."""
    bands = spark.range(20).select(F.col("id").alias("band"), (F.col("id") * 100.0).alias("low"), ((F.col("id") + 1) * 100.0).alias("high"))
    return range_join(read(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), bands, "p_retailprice", "low", "high", 100.0).groupBy("band").agg(F.count("*").alias("n"))


def errors_after_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a user in the hour after a purchase: an equi join of key and cell of time."""
    events = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    pairs = followed_within(events.where("event_type = 'purchase'"), events.where("event_type = 'error'"), "user_id", "1 hour")
    return pairs.select(F.col("second_id").alias("event_id"), F.col("first_id").alias("purchase_id"))


def asof_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's last click at or before it."""
    events = read(spark, sf_dir, "events")
    clicks = events.where("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"))
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return asof_backward(bought, clicks, "user_id", "ts", "click_ts", ["click_id"], "click_id", lambda t: F.date_trunc("day", t)).select("event_id", "click_id")


def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's click that is nearest in time, before or after, within two hours."""
    events = read(spark, sf_dir, "events")
    clicks = events.where("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"))
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return asof(bought, clicks, "user_id", "ts", "click_ts", ["click_id"], "click_id", "nearest", lambda t: F.date_trunc("day", t), F.expr("interval 2 hours")).select("event_id", "click_id")


STRATEGIES = ("broadcast", "merge", "shuffle_hash", "shuffle_replicate_nl")


def join_by(left: DataFrame, right: DataFrame, on: list[str], strategy: str, how: str = "inner", most: int = 10 << 20) -> DataFrame:
    """An equi join whose strategy the caller knows better than the planner's estimates.

    ``right`` is sent to all tasks only if its optimised plan says that it has
    ``most`` bytes or fewer; else the join is left to the planner. A nested loop
    over all pairs is refused.
    """
    if strategy not in STRATEGIES[:3]:
        raise ValueError(f"no join by {strategy}")
    small = right._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= most
    return left.join(right.hint(strategy) if strategy != "broadcast" or small else right, on, how)


def join_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines joined with parts in three ways, which agree."""
    lines, parts = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_quantity"), read(spark, sf_dir, "part").select("p_partkey", "p_type")
    one = lambda s: join_by(lines, parts, ["p_partkey"], s).groupBy("p_type").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")).withColumn("strategy", F.lit(s))
    return one("broadcast").unionByName(one("merge")).unionByName(one("shuffle_hash"))


QUERIES = {f.__name__: f for f in (join_strategies, region_revenue, customers_without_orders, customers_with_large_orders, orders_left_outer, nations_full_outer, parts_right_outer, words_lateral, price_bands, errors_after_purchases, asof_events, asof_nearest)}

ORACLES = {
    "join_strategies": "select p_type, strategy, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem join part on l_partkey = p_partkey cross join (values ('broadcast'), ('merge'), ('shuffle_hash')) s(strategy) group by 1, 2",
    "region_revenue": """
        select r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n
        from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
          join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
        where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1997-01-01'
        group by r_name
    """,
    "customers_without_orders": "select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderdate >= timestamp '2001-06-01')",
    "customers_with_large_orders": "select c_custkey, c_mktsegment from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)",
    "orders_left_outer": """
        select o_orderpriority, count(*) as n_orders, count(l_orderkey) as n_matched, coalesce(sum(n_lines), 0)::bigint as n_lines
        from orders left join (select l_orderkey, count(*) as n_lines from lineitem where l_quantity > 45 group by 1) on o_orderkey = l_orderkey
        group by 1
    """,
    "nations_full_outer": """
        select coalesce(c_nationkey, s_nationkey) as nationkey, n_customers, n_suppliers
        from (select c_nationkey, count(*) as n_customers from customer where c_acctbal > 9900 group by 1)
        full join (select s_nationkey, count(*) as n_suppliers from supplier where s_acctbal < 0 group by 1) on c_nationkey = s_nationkey
    """,
    "parts_right_outer": """
        select p_partkey, coalesce(n, 0)::bigint as n
        from (select l_partkey, count(*) as n from lineitem where l_quantity >= 49 group by 1) right join part on l_partkey = p_partkey
    """,
    "words_lateral": "select p_partkey, i - 1 as place, w[i] as word from (select p_partkey, string_split(p_name, ' ') as w from part) x, lateral (select unnest(range(1, len(w) + 1)) as i)",
    "price_bands": "select band::bigint as band, count(*) as n from part join (select range as band from range(20)) on p_retailprice >= band * 100 and p_retailprice < (band + 1) * 100 group by 1",
    "errors_after_purchases": """
        select e.event_id, p.event_id as purchase_id from events e join events p
          on e.user_id = p.user_id and e.ts >= p.ts and e.ts < p.ts + interval 1 hour
        where e.event_type = 'error' and p.event_type = 'purchase'
    """,
    "asof_events": """
        select p.event_id, c.event_id as click_id
        from (select * from events where event_type = 'purchase') p asof left join (select * from events where event_type = 'click') c
          on p.user_id = c.user_id and p.ts >= c.ts
    """,
    "asof_nearest": """
        select p.event_id, c.event_id as click_id
        from (select * from events where event_type = 'purchase') p left join (select * from events where event_type = 'click') c
          on p.user_id = c.user_id and abs(epoch_us(p.ts) - epoch_us(c.ts)) <= 7200000000
        qualify row_number() over (partition by p.event_id order by abs(epoch_us(p.ts) - epoch_us(c.ts)), c.ts, c.event_id desc) = 1
    """,
}
