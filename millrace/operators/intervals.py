"""Joins of points and intervals, by cells of time or of another quantity.

An interval is filed in the cells that it covers. Cells come in levels, each
FAN times as wide as the one below; an interval is filed at the first level
where it covers few of them, and at the wider ones up to the widest that is in
use, so that a very long interval makes few rows and meets short ones too. A
pair is kept at the wider one of its two levels, in the first cell that the
two share, so it comes once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import read

FAN, LEVELS = 16, 12


def _levelled(df: DataFrame, side: str, start: str, end: str, on: list[str], width: float) -> DataFrame:
    """Rows as ``side`` with bounds, keys and level; none for null bounds or an end before the start."""
    s, e = F.col(start).cast("double"), F.col(end).cast("double")
    rows = df.select(F.struct("*").alias(side), s.alias(f"{side}_s"), e.alias(f"{side}_e"), *[F.col(c).alias(f"{side}_{i}") for i, c in enumerate(on)]).where(F.col(f"{side}_s") <= F.col(f"{side}_e"))
    wide = (F.col(f"{side}_e") - F.col(f"{side}_s")) / F.lit(width * FAN)
    return rows.withColumn(f"{side}_l", F.when(wide <= 1, F.lit(0)).otherwise(F.least(F.ceil(F.log(float(FAN), wide)), F.lit(LEVELS))).cast("int"))


def _at(value: Column, level: Column, width: float) -> Column:
    return F.floor(value / (F.lit(width) * F.pow(F.lit(float(FAN)), level)))


def _filed(rows: DataFrame, side: str, levels: list[int], width: float) -> DataFrame:
    own = F.filter(F.array(*map(F.lit, levels)), lambda v: v >= F.col(f"{side}_l"))
    rows = rows.select("*", F.explode(own).alias("level"))
    return rows.select("*", F.explode(F.sequence(_at(F.col(f"{side}_s"), F.col("level"), width), _at(F.col(f"{side}_e"), F.col("level"), width))).alias("cell"))


def _meeting(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], on: list[str], width: float, meets: Column) -> DataFrame:
    a, b = _levelled(left, "a", *left_span, on, width), _levelled(right, "b", *right_span, on, width)
    used = {r[0] for r in a.select("a_l").distinct().unionByName(b.select(F.col("b_l").alias("a_l")).distinct()).distinct().collect()}
    levels = sorted(used) or [0]
    a, b = (_filed(x, side, levels, width) for x, side in ((a, "a"), (b, "b")))
    b = b.withColumnsRenamed({"level": "b_level", "cell": "b_cell"})
    same = (F.col("level") == F.col("b_level")) & (F.col("cell") == F.col("b_cell"))
    for i in range(len(on)):
        same &= F.col(f"a_{i}") == F.col(f"b_{i}")
    first = F.greatest(_at(F.col("a_s"), F.col("level"), width), _at(F.col("b_s"), F.col("level"), width))
    joined = a.join(b, same & meets & (F.col("level") == F.greatest("a_l", "b_l")) & (F.col("cell") == first))
    return joined.select("a.*", *[F.col(f"b.`{c}`").alias(f"{c}_right" if c in left.columns else c) for c in right.columns if c not in on])


def overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], on: list[str], width: float) -> DataFrame:
    """Pairs of rows of a key whose intervals ``[start, end)`` share some time.

    Bounds are numbers (such as microseconds); ``width`` should be near the
    length of common intervals, and is a matter of speed alone. A null bound or
    key, or an interval without length, meets nothing. A column of ``right``
    that ``left`` has too gets ``_right`` behind its name; those of ``on`` come once.
    """
    meets = (F.col("a_s") < F.col("b_e")) & (F.col("b_s") < F.col("a_e")) & (F.col("a_s") < F.col("a_e")) & (F.col("b_s") < F.col("b_e"))
    return _meeting(left, right, left_span, right_span, on, width, meets)


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float, on: list[str] | None = None) -> DataFrame:
    """Pairs with ``low <= at < high``: an equi join by cells instead of a nested loop.

    ``width`` should be near the typical length of a range; a range of any
    length makes at most some twenty rows for each level in use. Nulls meet nothing,
    nor does a range whose high is not above its low. Names as in :func:`overlap_join`.
    """
    meets = (F.col("b_s") <= F.col("a_s")) & (F.col("a_s") < F.col("b_e"))
    return _meeting(points, ranges, (at, at), (low, high), on or [], width, meets)


def followed_within(first: DataFrame, second: DataFrame, key: str, within: str, how: str = "inner") -> DataFrame:
    """``(first_id, second_id)`` of rows of a key where the second's ``ts`` comes at or after the first's, within a time.

    Works on tables and, with watermarks on ``ts``, on streams. Time is cut into
    cells as long as ``within``: a second row is filed in its own cell and the
    one before, so rows of a key meet only when they are near each other. A null
    key or ``ts`` meets nothing; with ``how`` left, first rows that meet nothing
    come once with a null. Columns: the key, ts (an instant), event_id.
    """
    length = F.expr(f"cast(unix_micros(timestamp '1970-01-01 00:00:00 UTC' + interval {within}) as bigint)")
    cell = F.floor(F.unix_micros("ts") / length)
    a = first.select(F.col(key).alias("a_key"), F.col("ts").alias("a_ts"), F.col("event_id").alias("first_id"), cell.alias("a_cell"))
    b = second.select(F.col(key).alias("b_key"), F.col("ts").alias("b_ts"), F.col("event_id").alias("second_id"), F.explode(F.array(cell - 1, cell)).alias("b_cell"))
    near = (F.col("b_ts") >= F.col("a_ts")) & (F.col("b_ts") < F.col("a_ts") + F.expr(f"interval {within}"))
    return a.join(b, (F.col("a_key") == F.col("b_key")) & (F.col("a_cell") == F.col("b_cell")) & near, how).select("first_id", "second_id", "a_ts")


def error_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of clicks that overlap sessions of errors of the same user, with the seconds they share."""
    events = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))

    def sessions(kind: str, name: str) -> DataFrame:
        found = events.where(F.col("event_type") == kind).groupBy("user_id", F.session_window("ts", "3 hours").alias("w")).agg(F.count("*").alias(f"n_{name}"))
        return found.select("user_id", F.unix_micros("w.start").alias(f"{name}_start"), F.unix_micros("w.end").alias(f"{name}_end"), f"n_{name}")

    pairs = overlap_join(sessions("click", "clicks"), sessions("error", "errors"), ("clicks_start", "clicks_end"), ("errors_start", "errors_end"), ["user_id"], 4 * 3600 * 1e6)
    shared = F.least("clicks_end", "errors_end") - F.greatest("clicks_start", "errors_start")
    return pairs.select("user_id", "clicks_start", "errors_start", "n_clicks", "n_errors", F.round(shared / 1e6, 3).alias("seconds"))


QUERIES = {"error_sessions": error_sessions}

ORACLES = {
    "error_sessions": """
        with marked as (
          select *, case when ts >= lag(ts) over (partition by user_id, event_type order by ts, event_id) + interval 3 hours then 1 else 0 end as fresh
          from events where event_type in ('click', 'error')),
        counted as (select *, sum(fresh) over (partition by user_id, event_type order by ts, event_id) as k from marked),
        s as (select user_id, event_type, epoch_us(min(ts)) as a, epoch_us(max(ts) + interval 3 hours) as e, count(*) as n from counted group by user_id, event_type, k)
        select c.user_id, c.a as clicks_start, r.a as errors_start, c.n as n_clicks, r.n as n_errors, round((least(c.e, r.e) - greatest(c.a, r.a)) / 1e6, 3) as seconds
        from s c join s r on c.user_id = r.user_id and c.a < r.e and r.a < c.e where c.event_type = 'click' and r.event_type = 'error'
    """
}
