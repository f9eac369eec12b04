"""Scalar functions: text, dates, numbers, JSON, arrays and maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import read


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_name")
    return read(spark, sf_dir, "part").select(
        "p_partkey", F.upper(n).alias("up"), F.length(n).cast("long").alias("len"), F.substring(n, 2, 3).alias("sub"), F.replace(n, F.lit("a"), F.lit("@")).alias("rep"), F.lpad(n, 30, "*").alias("pad"),
        F.split_part(n, F.lit(" "), F.lit(1)).alias("first"), F.reverse(n).alias("rev"), F.levenshtein(n, F.col("p_type")).cast("long").alias("lev"), F.md5(n).alias("md5"),
        F.regexp_replace(n, "[aeiou]", "").alias("consonants"), F.instr(n, "e").cast("long").alias("at"), F.concat_ws("-", "p_brand", "p_type").alias("joined"),
    )


def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", F.year(d).cast("long").alias("y"), F.quarter(d).cast("long").alias("q"), F.month(d).cast("long").alias("m"), F.dayofmonth(d).cast("long").alias("dom"), (F.dayofweek(d) - 1).cast("long").alias("dow"),
        F.date_trunc("month", d).cast("timestamp_ntz").alias("month_start"), F.datediff(d.cast("date"), F.lit("1995-01-01").cast("date")).cast("long").alias("days"), F.add_months(d.cast("date"), 2).alias("later"), F.last_day(d.cast("date")).alias("month_end"), F.date_format(d, "yyyy-MM-dd").alias("iso"),
    )


def number_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_retailprice")
    return read(spark, sf_dir, "part").select(
        "p_partkey", F.round(p / 7, 4).alias("share"), F.floor(p).cast("long").alias("fl"), F.ceil(p).cast("long").alias("ce"), F.round(F.sqrt(p), 6).alias("root"), F.round(F.ln(p), 8).alias("ln"), F.pmod(F.col("p_partkey"), F.lit(7)).cast("long").alias("m"), F.signum(p - 1200).cast("long").alias("sign"),
        F.greatest(p, F.lit(1000.0)).alias("g"), F.when(F.col("p_size") > 25, "large").when(F.col("p_size") > 10, "middle").otherwise("small").alias("size"), F.try_divide(p, F.col("p_size") - F.col("p_size")).alias("none"),
    )


def json_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.from_json("props", "k int")
    return read(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"), F.sum(parsed["k"]).alias("total"))


def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    sums = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return read(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("n"), F.round(sums, 6).alias("total"), F.size(F.filter(v, lambda x: x > 0)).cast("long").alias("positive"), F.exists(v, lambda x: x > 0.3).alias("peak"), F.round(F.array_max(v), 6).alias("top"), F.round(F.get(v, 3), 6).alias("fourth"))


def map_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by type as a map for each user, filtered and taken apart again."""
    counts = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return maps.select("user_id", F.explode(F.map_filter("m", lambda k, v: (k != "view") & (v > 1))).alias("event_type", "n"))


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors with the largest dot product with vector 0, exactly, in double precision."""
    vectors = read(spark, sf_dir, "embeddings")
    one = vectors.where("vec_id = 0").agg(F.first("embedding")).scalar()
    dot = F.aggregate(F.zip_with("embedding", "q", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return vectors.where("vec_id <> 0").select("vec_id", "embedding", one.alias("q")).select("vec_id", F.round(dot, 6).alias("dot")).orderBy(F.desc("dot"), "vec_id").limit(10)


def filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists, ranges and patterns, which reach the scan as far as its format allows."""
    part = read(spark, sf_dir, "part")
    return part.where(F.col("p_type").isin("ECONOMY", "STANDARD", "SMALL") | F.col("p_size").between(10, 20)).where(F.col("p_name").like("%a%") & ~F.col("p_brand").startswith("Brand#1")).select("p_partkey", "p_size")


def regex_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_name")
    return read(spark, sf_dir, "part").select("p_partkey", F.regexp_extract(n, "^([a-z]+)", 1).alias("first"), F.regexp_count(n, F.lit("[aeiou]")).cast("long").alias("vowels"), F.rlike(n, F.lit("(e|o)[a-z] ")).alias("hit"), F.array_join(F.regexp_extract_all(n, F.lit("[a-z]{3}"), 0), "-").alias("threes"))


def interval_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times moved by intervals made from columns."""
    later = F.col("ts") + F.make_interval(months=F.lit(1), days=F.col("user_id") % 5, hours=F.lit(3))
    return read(spark, sf_dir, "events").select("event_id", later.alias("later"), F.timestamp_diff("HOUR", F.col("ts"), later).alias("hours"))


def variant_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON as a variant: parsed once, read by path and type."""
    v = F.parse_json("props")
    return read(spark, sf_dir, "events").select("event_id", v.alias("v")).select("event_id", F.variant_get("v", "$.k", "long").alias("k"), F.try_variant_get("v", "$.none", "string").alias("none"))


def key_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps with keys and values changed, and two maps put together."""
    m = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"))
    upper = F.transform_keys(m, lambda k, v: F.upper(k))
    sizes = F.map_zip_with(m, F.create_map(F.lit("brand"), F.col("p_size")), lambda k, a, b: F.concat(a, F.lit(":"), F.coalesce(b.cast("string"), F.lit("-"))))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(F.sort_array(F.map_keys(upper)), ",").alias("keys"), F.transform_values(upper, lambda k, v: F.lower(v))["BRAND"].alias("brand"), sizes["brand"].alias("a"), sizes["type"].alias("b"))


def sample_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sixteenth of the orders, the same on every run and cluster: by the first digit of a hash of the key."""
    return read(spark, sf_dir, "orders").where(F.md5(F.col("o_orderkey").cast("string").cast("binary")).startswith("0")).select("o_orderkey")


def text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.explode(F.split("p_name", " "))
    return read(spark, sf_dir, "part").select(words.alias("word")).groupBy("word").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (text_functions, date_functions, number_functions, json_functions, array_functions, map_functions, nearest_vectors, filters, regex_functions, interval_functions, variant_functions, key_functions, sample_by_hash, text_statistics)}

ORACLES = {
    "text_functions": """
        select p_partkey, upper(p_name) as up, length(p_name) as len, substr(p_name, 2, 3) as sub, replace(p_name, 'a', '@') as rep, lpad(p_name, 30, '*') as pad, split_part(p_name, ' ', 1) as first,
          reverse(p_name) as rev, levenshtein(p_name, p_type) as lev, md5(p_name) as md5, regexp_replace(p_name, '[aeiou]', '', 'g') as consonants, instr(p_name, 'e') as at, concat_ws('-', p_brand, p_type) as joined from part
    """,
    "date_functions": """
        select o_orderkey, year(o_orderdate) as y, quarter(o_orderdate) as q, month(o_orderdate) as m, day(o_orderdate) as dom, dayofweek(o_orderdate) as dow, date_trunc('month', o_orderdate) as month_start,
          date_diff('day', date '1995-01-01', o_orderdate::date) as days, (o_orderdate::date + interval 2 month)::date as later, last_day(o_orderdate::date) as month_end, strftime(o_orderdate, '%Y-%m-%d') as iso from orders
    """,
    "number_functions": """
        select p_partkey, round(p_retailprice / 7, 4) as share, floor(p_retailprice)::bigint as fl, ceil(p_retailprice)::bigint as ce, round(sqrt(p_retailprice), 6) as root, round(ln(p_retailprice), 8) as ln, p_partkey % 7 as m,
          sign(p_retailprice - 1200)::bigint as sign, greatest(p_retailprice, 1000.0) as g, case when p_size > 25 then 'large' when p_size > 10 then 'middle' else 'small' end as size, null::double as none from part
    """,
    "json_functions": "select json_extract(props, '$.k')::bigint as k, count(*) as n, sum(json_extract(props, '$.k')::bigint)::bigint as total from events group by 1",
    "array_functions": """
        select vec_id, len(embedding) as n, round(list_sum(embedding::double[]), 6) as total, len(list_filter(embedding::double[], lambda x: x > 0)) as positive,
          len(list_filter(embedding::double[], lambda x: x > 0.3)) > 0 as peak, round(list_max(embedding::double[]), 6) as top, round((embedding::double[])[4], 6) as fourth from embeddings
    """,
    "map_functions": "select user_id, event_type, count(*) as n from events where event_type <> 'view' group by 1, 2 having count(*) > 1",
    "nearest_vectors": """
        select b.vec_id, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) as dot from embeddings a, embeddings b
        where a.vec_id = 0 and b.vec_id <> 0 order by dot desc, vec_id limit 10
    """,
    "filters": "select p_partkey, p_size from part where (p_type in ('ECONOMY', 'STANDARD', 'SMALL') or p_size between 10 and 20) and p_name like '%a%' and not starts_with(p_brand, 'Brand#1')",
    "regex_functions": """
        select p_partkey, regexp_extract(p_name, '^([a-z]+)', 1) as first, len(regexp_extract_all(p_name, '[aeiou]')) as vowels, regexp_matches(p_name, '(e|o)[a-z] ') as hit, array_to_string(regexp_extract_all(p_name, '[a-z]{3}'), '-') as threes from part
    """,
    "interval_functions": """
        select event_id, later, date_sub('hour', ts, later) as hours from (select event_id, ts, ts + interval 1 month + to_days((user_id % 5)::int) + interval 3 hours as later from events)
    """,
    "variant_functions": "select event_id, json_extract(props, '$.k')::bigint as k, null::varchar as none from events",
    "key_functions": "select p_partkey, 'BRAND,TYPE' as keys, lower(p_brand) as brand, p_brand || ':' || p_size as a, p_type || ':-' as b from part",
    "sample_by_hash": "select o_orderkey from orders where starts_with(md5(o_orderkey::varchar), '0')",
    "text_statistics": "select word, count(*) as n from (select unnest(string_split(p_name, ' ')) as word from part) group by 1",
}
