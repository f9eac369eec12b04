"""Exact percentiles of groups of any size, by counting.

Each wanted place in a group's order has a range of values that holds it. A
pass over the rows counts those in CELLS cells of each range, with the least
and greatest value of a cell; the cell that holds the place is the next range,
exactly. When a range has few rows, or one value, its place is read off. Counts
are summed before they are exchanged, and no group is held by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import cut
from ..tables import read

#: Cells of a range in a pass; distinct values of a range that one task sorts.
CELLS, LIMIT = 1024, 50_000


def _cell(value: Column, low: Column, high: Column, bend: bool) -> Column:
    """The cell of a value, from 0 to CELLS + 2; never falls as the value rises.

    Cells are of equal width or, bent, go by the order of magnitude. Infinite
    values and NaN have cells of their own.
    """
    most, infinite = F.lit(1.7976931348623157e308), F.lit(float("inf"))

    def plain(c: Column) -> Column:
        c = F.greatest(F.least(F.nanvl(c.cast("double"), most), most), -most)
        return F.coalesce(F.signum(c) * (F.log2(F.abs(c)) + 1075), F.lit(0.0)) if bend else c / (8 * CELLS)

    cell = F.least(F.coalesce(F.width_bucket(plain(value), plain(low), plain(high), F.lit(CELLS)), F.lit(1)), F.lit(CELLS))
    v = value.cast("double")
    return F.when(F.isnan(v), CELLS + 2).when(v == infinite, CELLS + 1).when(v == -infinite, 0).otherwise(cell)


def percentiles(df: DataFrame, by: list[str], value: str, fractions: dict[str, float], limit: int = LIMIT) -> DataFrame:
    """``by`` and a column for each of ``fractions`` (names to numbers from 0 to 1), interpolated between neighbours.

    Exactly what sorting each group would give. Null values are left out, and a
    group with none else has nulls; a null key is a group; NaN is greater than
    all. Ties and repeated rows count as often as they come. Without rows there
    are no groups. ``limit`` bounds what one task sorts, not the result.
    """
    keys = [F.col(c).alias(f"k{i}") for i, c in enumerate(by)]
    names = [f"k{i}" for i in range(len(by))]
    base = df.select(*keys, F.col(value).alias("v"))
    sizes = cut(base.groupBy(*names).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")), "sizes")
    wanted = F.explode(F.array(*[F.struct(F.lit(2 * i + up).alias("t"), F.lit(float(f)).alias("f"), F.lit(up).alias("up")) for i, f in enumerate(fractions.values()) for up in (0, 1)]))
    place = F.when(F.col("up") == 0, F.floor("at")).otherwise(F.ceil("at")).cast("long")
    ranges = sizes.where("n > 0").select("*", wanted.alias("w")).select(*names, "n", "low", "high", "w.*").withColumn("at", (F.col("n") - 1) * F.col("f")).select(*names, "t", place.alias("place"), "low", "high", "n")
    found: list[DataFrame] = []

    def inside(of: DataFrame) -> DataFrame:
        here = of.select(*[F.col(k).alias(f"r{k}") for k in names], "t", "place", "low", "high")
        same = F.lit(True)
        for k in names:
            same &= F.col(k).eqNullSafe(F.col(f"r{k}"))
        return base.join(here, same & F.col("v").between(F.col("low"), F.col("high")))

    bend, before_last, last, most = False, None, None, limit
    while True:
        ranges = cut(ranges, "ranges")
        # values that neither kind of cell tells apart are few beyond any likelihood; they are sorted then
        now = ranges.where((F.col("low") < F.col("high")) & (F.col("n") > limit)).agg(F.count("*"), F.sum("n")).first()
        most = limit if now != before_last or now != last else (1 << 62)
        before_last, last = last, now
        found.append(ranges.where("low = high").select(*names, "t", F.col("low").alias("v")))
        few = inside(ranges.where((F.col("low") < F.col("high")) & (F.col("n") <= most))).groupBy(*names, "t", "place", "v").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*names, "t").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        read_off = few.withColumn("upto", upto).where("upto > place").groupBy(*names, "t").agg(F.min("v").alias("v"))
        found.append(cut(read_off, "read-off"))
        many = ranges.where((F.col("low") < F.col("high")) & (F.col("n") > most))
        if many.isEmpty():
            break
        cells = inside(many).groupBy(*names, "t", "place", _cell(F.col("v"), F.col("low"), F.col("high"), bend).alias("cell")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.sum("n").over(Window.partitionBy(*names, "t").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
        ranges = cells.withColumn("before", before).where("before <= place and place < before + n").select(*names, "t", (F.col("place") - F.col("before")).alias("place"), "low", "high", "n")
        bend = not bend
    values = found[0]
    for f in found[1:]:
        values = values.unionByName(f)
    at = values.groupBy(*names).agg(*[F.max(F.when(F.col("t") == t, F.col("v"))).alias(f"v{t}") for t in range(2 * len(fractions))]) if fractions else sizes.select(*names)
    here = at.select(*[F.col(k).alias(f"r{k}") for k in names], *[f"v{t}" for t in range(2 * len(fractions))])
    same = F.lit(True)
    for k in names:
        same &= F.col(k).eqNullSafe(F.col(f"r{k}"))
    out = sizes.join(here, same, "left")
    shares = []
    for i, (name, f) in enumerate(fractions.items()):
        a, b, at_ = F.col(f"v{2 * i}"), F.col(f"v{2 * i + 1}"), (F.col("n") - 1) * F.lit(float(f))
        share = at_ - F.floor(at_)
        shares.append(F.when(share == 0, a.cast("double")).otherwise(a * (1 - share) + b * share).alias(name))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(by)], *shares)


def price_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles and tails of prices by status, and of the whole table."""
    lines = read(spark, sf_dir, "lineitem")
    marks = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}
    by_status = percentiles(lines, ["l_returnflag", "l_linestatus"], "l_extendedprice", marks)
    whole = percentiles(lines, [], "l_extendedprice", marks)
    rows = by_status.unionByName(whole.select(F.lit(None).cast("string").alias("l_returnflag"), F.lit(None).cast("string").alias("l_linestatus"), *marks))
    return rows.select("l_returnflag", "l_linestatus", *[F.round(m, 4).alias(m) for m in marks])


QUERIES = {"price_percentiles": price_percentiles}

_MARKS = ", ".join(f"round(quantile_cont(l_extendedprice, {int(m) / 100}), 4) as p{m}" for m in ("01", "25", "50", "75", "99"))
ORACLES = {"price_percentiles": f"select l_returnflag, l_linestatus, {_MARKS} from lineitem group by 1, 2 union all select null, null, {_MARKS} from lineitem"}
