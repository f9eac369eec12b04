"""Quality rules: statistics of each text, then the frequency of lines across documents.

A line that many documents of a host share is furniture of the site. Lines are
normalised and hashed, the documents that hold each are counted for each host,
lines above both limits are removed, and a document of which too little remains
is rejected. All of it is DataFrame functions; texts are never shuffled unless
the cleaned text itself is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: A line is removed if more than this share of the host's documents hold it,
MAX_SHARE = 0.05
#: and at least so many documents, below which a share says nothing.
MIN_DOCS = 20
#: or, whatever the host's size, at least so many documents hold it and it has at least so many characters, normalised.
ENOUGH_DOCS, MIN_LENGTH = 5, 20
#: A document is depleted if less than this share of its words' characters remains.
MIN_LEFT = 0.3


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _windows(words: Column) -> Column:
    """A hash for each window of five words; none if there are fewer."""
    n = F.size(words)
    starts = F.when(n >= 5, F.sequence(F.lit(1), n - 4)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, 5)))


def base_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to ``df``.

    A null text counts as empty. Columns of ``df`` with these names are
    replaced, all others are returned as they are, whatever their names.
    """
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    step = df.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    body = F.col("body")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = step.withColumn("_words", _words(body)).withColumn("_lines", lines)
    step = step.withColumn("_h", _windows(F.col("_words")))
    pairs = F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    # only texts with a repeated window are sorted
    step = step.withColumn("_pairs", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(pairs)))
    again = F.filter("_pairs", lambda w, i: F.coalesce(w["h"] == F.get("_pairs", i - 1)["h"], F.lit(False)) | F.coalesce(w["h"] == F.get("_pairs", i + 1)["h"], F.lit(False)))
    step = step.withColumn("_at", F.sort_array(F.transform(again, lambda w: w["p"])))
    spans = F.transform("_at", lambda p, k: F.least(F.lit(5), F.coalesce(F.get("_at", k + 1) - p, F.lit(5))))
    repeat = F.coalesce(F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    stats = F.struct(
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeat.alias("n_repeat_words"),
    )
    step = step.select("row", stats.alias("stats"))
    failed = (F.col("stats.n_words") < 10) | (100 * F.col("stats.n_repeat_words") > 20 * F.col("stats.n_words"))
    return step.select(*[F.col("row").getField(c).alias(c) for c in df.columns if c not in made], "stats.*", failed.alias("base_failed"))


def _normalised(line: Column) -> Column:
    return F.lower(F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))


def _line_hashes(text: Column) -> Column:
    """A hash for each line with a word, null for the others; in the text's order."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.when(x.rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(_normalised(x))))


def frequent_lines(docs: DataFrame, host: str = "source", text: str = "text", max_share: float = MAX_SHARE, min_docs: int = MIN_DOCS, enough_docs: int | None = None, min_length: int = 0) -> DataFrame:
    """``(host, line, n_docs)`` of the lines above both limits.

    With ``enough_docs`` so many documents of a host suffice whatever its size,
    for lines of ``min_length`` normalised characters at least.

    Each row of ``docs`` is a document and counts once for each distinct line
    of it. Counts are added up before the shuffle, so a line or host that a
    third of all documents share costs each task one row.
    """
    if enough_docs is None:
        per_doc = docs.select(F.col(host).alias("host"), F.explode(F.array_distinct(_line_hashes(F.col(text)))).alias("line"))
        counts = per_doc.where("line is not null").groupBy("host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs)
        suffices = F.lit(False)
    else:
        lengths = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.length(_normalised(x)))
        zipped = F.arrays_zip(_line_hashes(F.col(text)).alias("line"), lengths.alias("length"))
        per_doc = docs.select(F.col(host).alias("host"), F.inline(F.array_distinct(zipped)))
        counts = per_doc.where("line is not null").groupBy("host", "line").agg(F.count("*").alias("n_docs"), F.max("length").alias("length"))
        suffices = (F.col("n_docs") >= enough_docs) & (F.col("length") >= min_length)
        counts = counts.where((F.col("n_docs") >= min_docs) | suffices)
    hosts = docs.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("host_docs"))
    return counts.join(hosts, counts["host"].eqNullSafe(hosts["host"])).where(suffices | (F.col("n_docs") >= min_docs) & (F.col("n_docs") > max_share * F.col("host_docs"))).select(counts["host"], "line", "n_docs")


def apply_rules(docs: DataFrame, id_col: str = "doc_id", host: str = "source", text: str = "text", max_share: float = MAX_SHARE, min_docs: int = MIN_DOCS, min_left: float = MIN_LEFT, enough_docs: int | None = None, min_length: int = 0) -> DataFrame:
    """Statistics, cleaned text and verdict; one row for each row of ``docs``.

    Columns: doc_id, the statistics of :func:`base_statistics`, n_removed_lines,
    left_share (of the characters in lines with a word; 1.0 for a text without
    any), cleaned (the text without frequent lines) and kept. A null text
    counts as empty, fails the base rules and is cleaned to an empty text;
    documents of a null host form one host; repeated rows count as documents
    of their own and get equal results; a null or repeated id does no harm, as
    a document is known by id, host and a hash of its text together. Other
    columns are ignored.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(host).alias("host"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.withColumn("sig", F.xxhash64("text", "host"))
    frequent = frequent_lines(docs, host, text, max_share, min_docs, enough_docs, min_length)
    lines = own.select("doc_id", "sig", "host", F.posexplode(F.transform(F.arrays_zip(F.split("text", "\n").alias("t"), _line_hashes(F.col("text")).alias("h")), lambda x: F.struct(x["h"].alias("h"), F.length(x["t"]).alias("n")))).alias("pos", "x"))
    lines = lines.select("doc_id", "sig", "host", "pos", F.col("x.h").alias("line"), F.col("x.n").alias("n")).where("line is not null")
    hit = lines.join(frequent, (lines["line"] == frequent["line"]) & lines["host"].eqNullSafe(frequent["host"]))
    # a set, so that repeated rows do not add up; it is no larger than the document
    removed = hit.groupBy(lines["doc_id"].alias("r_id"), lines["sig"].alias("r_sig")).agg(F.collect_set(F.struct("pos", "n")).alias("gone"))
    removed = removed.select("r_id", "r_sig", F.transform("gone", lambda x: x["pos"]).alias("gone"), F.aggregate("gone", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("gone_chars"))
    total = F.aggregate(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    stats = base_statistics(own).withColumn("total_chars", total)
    both = stats.join(removed, stats["doc_id"].eqNullSafe(removed["r_id"]) & (stats["sig"] == removed["r_sig"]), "left")
    split = F.split("text", "\n")
    left_over = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("gone"))
    cleaned = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left_over, lambda i: F.get(split, i)), "\n"))
    share = F.when(F.col("total_chars") > 0, 1 - F.coalesce("gone_chars", F.lit(0)) / F.col("total_chars")).otherwise(F.lit(1.0))
    return both.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.coalesce(F.array_size("gone"), F.lit(0)).cast("long").alias("n_removed_lines"), share.alias("left_share"), cleaned.alias("cleaned"),
        (~F.col("base_failed") & (share >= min_left)).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"), enough_docs=ENOUGH_DOCS, min_length=MIN_LENGTH).drop("cleaned", "left_share")


ORACLE = r"""
with d as (select row_number() over () as rn, doc_id, source, coalesce(text, '') as t from documents),
s as (
  select rn, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
g as (select rn, i, array_to_string(w[i:i + 4], ' ') as five from (select rn, w, unnest(range(1, len(w) - 3)) as i from s)),
again as (select rn, i from g qualify count(*) over (partition by rn, five) > 1),
rep as (select rn, count(distinct i + k) as n from again cross join (select unnest(range(5)) as k) group by rn),
b as (
  select s.rn, doc_id, source, lines, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(n, 0)::bigint as n_repeat_words, list_sum(list_transform(lines, lambda x: length(x))) as total from s left join rep on s.rn = rep.rn),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from b),
l as (
  select rn, source, length(x) as n, lower(regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')) as line
  from (select rn, source, unnest(lines) as x from b)),
c as (select source, line, count(distinct rn) as n_docs from l group by 1, 2),
h as (select source, count(*) as host_docs from d group by 1),
freq as (
  select c.source, line from c join h on c.source is not distinct from h.source where n_docs >= 20 and n_docs > 0.05 * host_docs or n_docs >= 5 and length(line) >= 20),
gone as (
  select rn, count(*) as n, sum(l.n) as chars from l join freq on l.line = freq.line and l.source is not distinct from freq.source group by rn)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(gone.n, 0)::bigint as n_removed_lines,
  not base_failed and coalesce(1 - coalesce(chars, 0) / total, 1) >= 0.3 as kept
from f left join gone on f.rn = gone.rn
"""
