"""URL filter and quality rules."""

import pytest
from pyspark.sql import functions as F

from millrace.llm import bloom, quality_rules, url_filter

from .conftest import WORD


@pytest.mark.parametrize("module", [url_filter, quality_rules])
def test_equals_sql(module, same):
    same(module.query, module.ORACLE)


def brute_judge(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    best = None
    for rule, verdict in rules:
        h, p = (rule.split("/", 1) + [None])[:2]
        p = "" if p is None else "/" + p
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, *(best or (None, default))


URLS = ["http://A.Example.NET/en/1", "http://example.net/de/1", "https://x.net", "http://x.net/", "http://net/a", "ftp://a.b.org/fr/x?y#z", "http://org/fr/", "http://a.org/fr", "http://notexample.com/de/", "http://example.com/de/#f", "no scheme.net/", "", None, "http://", "a://b://c.net/x", "http://x.net:80/en", "http://x.net\n/en/", "http://x.net?/en/", "http://.net/", "http://" + "a." * 3000 + "net/x"]


def test_judges_like_brute_force(spark):
    pages = spark.createDataFrame([(i % 7, u, "own", "own") for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame(url_filter.RULES, "rule string, verdict string")
    got = url_filter.judge(pages, rules).collect()
    assert sorted(map(repr, got)) == sorted(repr(type(got[0])(page_id=i % 7, host=x[0], path=x[1], rule=x[2], verdict=x[3])) for i, u in enumerate(URLS + URLS[:3]) for x in [brute_judge(u, url_filter.RULES)])
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_long_lists_are_salted_and_block_wins(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", 3)
    rules = [("net/", "block"), ("a.net/x", "allow"), ("a.net/x", "block"), ("b.net", "allow"), ("c.net/de", "allow"), ("/nohost", "block"), (None, "block")]
    pages = spark.createDataFrame([(1, "http://q.a.net/xyz"), (2, "http://b.net"), (3, "http://c.net/d"), (4, "http://c.net/deep")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages, spark.createDataFrame(rules, "rule string, verdict string")).collect()}
    assert got == {1: ("a.net/x", "block"), 2: ("b.net", "allow"), 3: ("net/", "block"), 4: ("c.net/de", "allow")}


def test_bloom_has_no_false_negative_and_few_false_positives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("k"))
    log2 = bloom.log2_blocks(5000)
    words = bloom.build(keys, "k", log2)
    held = lambda df: df.where(bloom.may_hold(words, F.col("k"), log2)).count()
    assert held(keys) == 5000
    assert held(spark.range(20000).select(F.concat(F.lit("other"), "id").alias("k"))) < 400


def brute_base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)} if len(windows) < 300 else ({i for i in range(len(words))} if len(set(windows)) < len(windows) else set())
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_base_statistics(edges):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for r in quality_rules.base_statistics(edges).collect():
        assert tuple(r[n] for n in names) == brute_base(r["text"]), r["text"]


def test_base_statistics_leave_other_columns_alone(spark):
    names = ["row", "body", "_words", "_lines", "_h", "_pairs", "_at", "n_words", "kept"]
    docs = spark.createDataFrame([("one two\none two", *names)], "text string, " + ", ".join(f"{n} string" for n in names))
    (got,) = quality_rules.base_statistics(docs).collect()
    assert got["n_words"] == 4 and all(got[n] == n for n in names if n != "n_words")


def test_frequent_lines_go_and_depleted_documents_fail(spark):
    own = lambda i, k: f"document {i} has words of its own that no other one has at all" if not k else f"line {k} of number {i} speaks about quite different matters"
    rows = [(i, "Menu | Home\n" + own(i, 0) + "\n" + own(i, 1), "a") for i in range(30)]
    rows += [(100, "menu | home\nMENU | HOME\n  menu | home  \nten words are needed here so that base rules hold", "a"), (101, "Menu | Home\n" + own(101, 0), "b"), (None, "Menu | Home\n" + own(102, 0), None)]
    docs = spark.createDataFrame(rows + [rows[0]], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(docs, max_share=0.5, min_docs=20, min_left=0.7).collect()}
    assert got[0]["cleaned"] == own(0, 0) + "\n" + own(0, 1) and got[0]["kept"] and got[0]["n_removed_lines"] == 1
    assert got[100]["n_removed_lines"] == 3 and not got[100]["kept"] and got[100]["cleaned"].startswith("ten words")
    assert got[101]["kept"] and got[101]["n_removed_lines"] == 0 and got[None]["kept"]


def test_rules_on_edges(edges, empty):
    got = quality_rules.apply_rules(edges).collect()
    assert len(got) == edges.count() and quality_rules.apply_rules(empty).count() == 0
    assert not any(r["kept"] for r in got if r["n_words"] < 10)


def test_passages_go_whatever_the_size_of_the_host(spark):
    """1,000 documents of a host, 6 of which share a passage; a line of two words in as many stays."""
    own = lambda i: f"number {i} has a text of its own, with words enough for the base rules {i * 7}"
    rows = [(i, ("All rights reserved by the owner of this page.\nOh no.\n" if i < 6 else "") + own(i), "a") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(docs, enough_docs=4, min_length=20, min_left=0.7).collect()}
    assert [i for i, r in got.items() if r["n_removed_lines"]] == [i for i in got if i < 6]
    assert all(got[i]["cleaned"] == "Oh no.\n" + own(i) and not got[i]["kept"] for i in range(6))
    assert sum(r["kept"] for r in got.values()) == 994


def test_limits_of_the_query(spark):
    """A line goes from 20 documents on if they are more than 5 % of the host's, and a document of which less than 30 % is left is rejected."""
    own = lambda i: f"words of number {i} stand here and nowhere else, ten or more of them {i * 7}"
    rows = [(1000 * h + i, ("x" * (300 if i == 0 else 10) + "\n" if i < shared else "") + own(1000 * h + i), f"h{h}") for h, (n, shared) in enumerate([(30, 20), (30, 19), (400, 20), (400, 21)]) for i in range(n)]
    rows = [(i, t.replace("x" * 10 + "\n", "a shared line\n") if "x" * 300 not in t else "\n".join(["a shared line"] * 30) + "\n" + own(i), h) for i, t, h in rows]
    got = quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {h: sum(r["n_removed_lines"] > 0 for r in got if r["doc_id"] // 1000 == h) for h in range(4)} == {0: 20, 1: 0, 2: 0, 3: 21}
    assert not any(r["kept"] for r in got if r["doc_id"] in (0, 3000)) and all(r["kept"] for r in got if r["doc_id"] in (1, 3001, 2001))
