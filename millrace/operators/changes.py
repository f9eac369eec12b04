"""Changes applied to tables: of the changes of a key the newest one decides.

Changes are reduced by an aggregate that is begun before rows are exchanged, so
a key that changes all the time is no single task's work. Result and table meet
in one join by key, in which a key has one change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import read


def newest(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest by ``order``, and of several by the other columns from left to right.

    Nulls are the least; a null key is a key. Columns other than keys must be
    of types that can be compared (no maps). Columns stay as they are.
    """
    rest = [c for c in changes.columns if c not in keys]
    ranked = [*order, *[c for c in rest if c not in order]]
    best = F.max(F.struct(*[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(ranked)]))
    found = changes.groupBy(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keys)]).agg(best.alias("best"))
    place = {c: f"k{i}" for i, c in enumerate(keys)} | {c: f"best.v{i}" for i, c in enumerate(ranked)}
    return found.select(*[F.col(place[c]).alias(c) for c in changes.columns])


def apply_changes(table: DataFrame, changes: DataFrame, keys: list[str], order: list[str], deleted: str) -> DataFrame:
    """``table`` as it is after all changes.

    A row of ``changes`` names a key, gives new values for those columns of the
    table that it has (a null is a value), and its place in time by ``order``.
    ``deleted``, a column of ``changes``, removes the key where it is true. A
    key that the table does not have is added, with nulls in columns that
    changes do not give. Repeated changes, and changes that come late, make no
    difference: the newest decides, as in :func:`newest`. Rows of the table
    that share a key are all changed; a null key is a key.
    """
    last = newest(changes, keys, order)
    a = table.select(F.struct("*").alias("a"), *[F.col(f"`{c}`").alias(f"a{i}") for i, c in enumerate(keys)])
    b = last.select(F.struct("*").alias("b"), *[F.col(f"`{c}`").alias(f"b{i}") for i, c in enumerate(keys)])
    same = F.lit(True)
    for i in range(len(keys)):
        same &= F.col(f"a{i}").eqNullSafe(F.col(f"b{i}"))
    both = a.join(b, same, "full").where(~F.coalesce(F.col(f"b.`{deleted}`"), F.lit(False)))
    changed = F.col("b").isNotNull()
    given = [c for c in table.columns if c in changes.columns]
    return both.select(*[(F.when(changed, F.col(f"b.`{c}`")).otherwise(F.col(f"a.`{c}`")) if c in given else F.col(f"a.`{c}`")).alias(c) for c in table.columns])


def orders_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders before 2001 after what their lines say, the last shipped one: returned removes the order, else its status is the line's.

    Lines of later orders add orders without a price.
    """
    lines = read(spark, sf_dir, "lineitem")
    changes = lines.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linestatus").alias("o_orderstatus"), (F.col("l_returnflag") == "R").alias("gone"), "l_shipdate", "l_linenumber")
    orders = read(spark, sf_dir, "orders").where("o_orderdate < timestamp_ntz '2001-01-01'").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return apply_changes(orders, changes, ["o_orderkey"], ["l_shipdate", "l_linenumber"], "gone")


QUERIES = {"orders_after_changes": orders_after_changes}

ORACLES = {
    "orders_after_changes": """
        with last as (
          select l_orderkey, l_linestatus, l_returnflag = 'R' as gone from lineitem
          qualify row_number() over (partition by l_orderkey order by l_shipdate desc, l_linenumber desc, l_linestatus desc, gone desc) = 1)
        select coalesce(l_orderkey, o_orderkey) as o_orderkey, case when l_orderkey is null then o_orderstatus else l_linestatus end as o_orderstatus, o_totalprice
        from (select * from orders where o_orderdate < timestamp '2001-01-01') full join last on o_orderkey = l_orderkey
        where not coalesce(gone, false)
    """
}
