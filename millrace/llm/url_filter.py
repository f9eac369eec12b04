"""URL filter: a blocked Bloom filter of listed URLs before an exact hash join.

A listed entry is a host with a path prefix; it fits the host and its
subdomains. A URL therefore asks for few keys: one for each pair of number of
labels and path length that occurs in the list. The Bloom filter is probed with
these keys as they are generated, so that only possible hits reach the exact
join. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .common import cut, join_hot, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Lists of up to so many bytes, counted before, are sent to all executors.
BROADCAST_BYTES = 10_000_000
#: Copies of a longer list, over which the URLs that ask for one entry are spread.
SALTS = 16

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def _host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.translate(F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit("")), UPPER, LOWER), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def canonical_rules(rules: DataFrame) -> DataFrame:
    """``(rule, verdict, key, labels, path_length)`` once for each host and path; block wins over allow.

    A rule without a slash has an empty path; null rules and rules without a host fit nothing and go.
    """
    host = F.translate(F.regexp_extract("rule", r"^([^/]*)", 1), UPPER, LOWER)
    path = F.regexp_extract("rule", r"^[^/]*(.*)$", 1)
    return (
        rules.select(F.concat(host, path).alias("key"), _labels(host).alias("labels"), F.length(path).alias("path_length"), "rule", "verdict")
        .where((F.length("key") > F.col("path_length")) & F.col("verdict").isin("allow", "block"))
        .groupBy("key", "labels", "path_length")
        .agg(F.max_by(F.struct("verdict", "rule"), F.struct("verdict", "rule")).alias("r"))
        .select("key", "labels", "path_length", "r.verdict", "r.rule")
    )


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge each URL by the longest rule that fits; one row for each row of ``pages``.

    ``rules`` has columns rule (host, then path prefix) and verdict (allow or
    block). The longest rule has the most characters of host and path
    together, of these the longest host. Null URLs and those without ``://``
    have empty host and path, and like all that no rule fits take ``default``
    with a null rule. Repeated rows are each judged; an empty table gives an
    empty one; other columns of ``pages`` are ignored, whatever their names.
    """
    host, path = _host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    listed = canonical_rules(rules)
    width = F.octet_length("key") + F.octet_length("rule") + 64
    facts = listed.agg(F.count("*").alias("n"), F.sum(width).alias("bytes"), F.collect_set(F.struct("labels", "path_length")).alias("shapes")).first()
    if not facts["n"]:
        return urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    shapes = F.array(*[F.struct(F.lit(s["labels"]).alias("labels"), F.lit(s["path_length"]).alias("path_length")) for s in sorted(facts["shapes"])])
    log2 = bloom.log2_blocks(facts["n"])
    words = bloom.build(listed, "key", log2)
    asked = (
        urls.select("host", "path", _labels(F.col("host")).alias("n"))
        .select("host", "path", F.explode(F.filter(shapes, lambda s: (F.col("n") >= s["labels"]) & (F.length("path") >= s["path_length"]))).alias("s"))
        .select("host", "path", F.concat(F.expr("substring_index(host, '.', -s.labels)"), F.expr("left(path, s.path_length)")).alias("key"))
        .where(bloom.may_hold(words, F.col("key"), log2))
    )
    if facts["bytes"] <= BROADCAST_BYTES:
        hits = asked.join(F.broadcast(listed), "key")
    else:
        salted = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = asked.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"])
    rank = F.struct(F.length("key").alias("n"), -F.col("path_length"), "rule", "verdict")
    whole = F.concat(F.length("host").cast("string"), F.lit(" "), "host", "path").alias("whole")
    best = cut(hits.groupBy("host", "path").agg(F.max(rank).alias("best"), F.count("*").alias("k")).select(whole, "best.rule", "best.verdict", "k"), "best")
    rows = best.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    return join_hot(urls.select("*", whole), best, "whole", "k", rows, "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ", ".join(f"('{rule}', '{verdict}')" for rule, verdict in RULES)
    return judge(table(spark, sf_dir, "pages"), spark.sql(f"select * from values {rows} as rules(rule, verdict)"))


ORACLE = """
with rest as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as r from pages),
parts as (
  select page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from rest),
rules(rule, verdict, rule_host, rule_path) as (values
  ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
  ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
fits as (
  select host, path, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict
  from (select distinct host, path from parts) join rules
    on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by host, path)
select page_id, parts.host, parts.path, rule, coalesce(verdict, 'allow') as verdict
from parts left join fits on parts.host = fits.host and parts.path = fits.path
"""
