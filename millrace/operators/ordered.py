"""Ranks and running totals in an order over a whole table or over groups of any size.

Rows are dealt to ranges of the order, so a group lies in consecutive ranges.
Each range is totalled by itself; what a group had in the ranges before is
handed on. A range goes on with one group at most, so what is handed on is one
row for each range, made by the driver from one row for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import cut
from ..tables import read


def _sorting(key: str) -> Column:
    return F.desc_nulls_last(key[1:]) if key.startswith("-") else F.asc_nulls_first(key)


def _group(by: list[str]) -> Column:
    return F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(by)], F.lit(0).alias("all"))


def _handed_on(ends: list) -> list[tuple]:
    """Range, group and totals of what stands before each range of the group that it begins with."""
    out, last, totals = [], None, None
    for r in sorted(ends, key=lambda r: r["part"]):
        goes_on = last is not None and tuple(r["first"]) == last
        if goes_on:
            out.append((r["part"], *last[:-1], *totals))
        tail = tuple(x or 0 for x in r["tail"])
        if goes_on and tuple(r["last"]) == last:
            totals = tuple(a + b for a, b in zip(totals, tail, strict=True))
        else:
            last, totals = tuple(r["last"]), tail
    return out


def _totalled(rows: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """Running totals of ``sums`` within groups of rows that have ``_part`` and ``_id``, in the order of ``_id``."""
    spark, names = rows.sparkSession, list(sums)
    spans = rows.groupBy("_part", *by).agg(*[F.sum(c).alias(n) for n, c in sums.items()], F.min("_id").alias("_a"), F.max("_id").alias("_z"))
    group = _group(by)
    ends = spans.groupBy(F.col("_part").alias("part")).agg(F.min_by(group, "_a").alias("first"), F.max_by(group, "_z").alias("last"), F.max_by(F.struct(*names), "_z").alias("tail"))
    kinds = {f.name: f.dataType.simpleString() for f in spans.schema}
    schema = ", ".join(["part long", *[f"g{i} {kinds[c]}" for i, c in enumerate(by)], *[f"before{i} {kinds[n]}" for i, n in enumerate(names)]])
    before = F.broadcast(spark.createDataFrame(_handed_on(ends.collect()), schema))
    in_part = Window.partitionBy("_part", *by).orderBy("_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = rows.select("*", *[F.coalesce(F.sum(c).over(in_part), F.lit(0)).alias(n) for n, c in sums.items()])
    same = here["_part"] == before["part"]
    for i, c in enumerate(by):
        same &= here[c].eqNullSafe(before[f"g{i}"])
    joined = here.join(before, same, "left")
    return joined.select(*rows.columns, *[(F.col(n) + F.coalesce(F.col(f"before{i}"), F.lit(0))).alias(n) for i, n in enumerate(names)])


def running(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column] | None = None, ranks: bool = False) -> DataFrame:
    """``df`` with ``rn`` (1, 2, ... within the group), running ``sums`` up to each row and, if wanted, ``rank``.

    ``by`` may be empty: the whole table is one group. A ``-`` before a column
    of ``order`` means descending; nulls come first, descending last. Rows that
    tie in all of the order are in any order among themselves, fixed once;
    ``rank`` is that of the first of them. Null values add nothing, a null key
    is a group. No task holds a group, a table without rows gives none.
    Columns ``_part`` and ``_id`` are used meanwhile.
    """
    keys = [*[F.asc_nulls_first(c) for c in by], *map(_sorting, order)]
    written = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()), "ordered")
    rows = written.withColumn("_part", F.shiftright("_id", 33))
    out = _totalled(rows, by, {"rn": F.lit(1).cast("long")} | (sums or {}))
    if ranks:
        out = _totalled(out, [*by, *[c.lstrip("-") for c in order]], {"_peer": F.lit(1).cast("long")}).withColumn("rank", F.col("rn") - F.col("_peer") + 1).drop("_peer")
    return out.drop("_part", "_id")


def dominated(left: DataFrame, right: DataFrame, x: str, y: str, name: str = "n") -> DataFrame:
    """Each left row with the number of right rows whose ``x`` is greater and whose ``y`` is less.

    No pair of rows is compared. Ranks of ``x`` are read as bits: of two ranks
    the greater one has a 1 where they first differ. A right row is filed, for
    each 1 of its rank, under the bits before it, a left row for each 0; under
    each such node the right rows of less ``y`` are a running count. A table of
    n rows makes n log n / 2 rows. A row with a null in ``x`` or ``y`` counts
    nothing and is not counted. Repeated rows all count.
    """
    lefts = cut(left.withColumn("_row", F.monotonically_increasing_id()), "lefts")
    part = lambda df, row, side: df.select(F.col(x).alias("_x"), F.col(y).alias("_y"), row.alias("_row"), F.lit(side).cast("long").alias("_side")).where("_x is not null and _y is not null")
    both = part(lefts, F.col("_row"), 0).unionByName(part(right, F.lit(None).cast("long"), 1))
    coded = cut(running(both, [], ["_x"], ranks=True).select("_y", "_row", "_side", "rank"), "coded")
    bits = max(1, int(coded.agg(F.coalesce(F.max("rank"), F.lit(0))).first()[0]).bit_length())
    own = F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), lambda b: F.getbit("rank", b) == F.col("_side"))
    filed = coded.select("_y", "_row", "_side", "rank", F.explode(own).alias("_bit")).withColumn("_node", F.expr("shiftright(rank, _bit + 1)"))
    counted = running(filed.drop("rank"), ["_bit", "_node"], ["_y", "_side"], {"_n": F.col("_side")}).where("_side = 0")
    found = counted.groupBy("_row").agg(F.sum("_n").alias(name))
    return lefts.join(found, "_row", "left").select(*left.columns, F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name))


def order_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders from the dearest on: place, rank by full thousands, and cents of all orders so far."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") / 1000).alias("thousands"), F.to_date("o_orderdate").alias("day"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    placed = running(orders, [], ["-thousands", "day", "o_orderkey"], {"so_far": F.col("cents")})
    ranked = running(orders.select("o_orderkey", "thousands"), [], ["-thousands"], ranks=True).select("o_orderkey", "rank")
    return placed.join(ranked, "o_orderkey").select("o_orderkey", "rn", "rank", "so_far")


def type_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type by time: place, rank by hour, and thousandths of the values so far. Few types, each of any size."""
    events = read(spark, sf_dir, "events").select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), F.round(F.col("value") * 1000).cast("long").alias("amount"))
    placed = running(events, ["event_type"], ["hour", "event_id"], {"so_far": F.col("amount")})
    ranked = running(events.select("event_id", "event_type", "hour"), ["event_type"], ["hour"], ranks=True).select("event_id", "rank")
    return placed.join(ranked, "event_id").select("event_id", "rn", "rank", "so_far")


def larger_cheaper_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part the number of parts that are larger and cheaper."""
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return dominated(parts, parts, "p_size", "p_retailprice").select("p_partkey", "n")


QUERIES = {f.__name__: f for f in (order_ranks, type_totals, larger_cheaper_parts)}

ORACLES = {
    "order_ranks": """
        select o_orderkey, row_number() over (order by thousands desc, day, o_orderkey) as rn, rank() over (order by thousands desc) as rank,
          (sum(cents) over (order by thousands desc, day, o_orderkey rows unbounded preceding))::bigint as so_far
        from (select o_orderkey, floor(o_totalprice / 1000) as thousands, o_orderdate::date as day, round(o_totalprice * 100)::bigint as cents from orders)
    """,
    "type_totals": """
        select event_id, row_number() over (partition by event_type order by hour, event_id) as rn, rank() over (partition by event_type order by hour) as rank,
          (sum(amount) over (partition by event_type order by hour, event_id rows unbounded preceding))::bigint as so_far
        from (select event_id, event_type, date_trunc('hour', ts) as hour, round(value * 1000)::bigint as amount from events)
    """,
    "larger_cheaper_parts": "select a.p_partkey, count(b.p_partkey) as n from part a left join part b on b.p_size > a.p_size and b.p_retailprice < a.p_retailprice group by 1",
}
