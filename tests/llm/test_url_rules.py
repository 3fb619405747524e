"""Host rules by hand, mined rules against DuckDB over all token combinations, edge cases."""

import re

import duckdb
import pytest

from kohort.checks.compare import compare, duckdb_views
from kohort.llm import url_rules as U
from kohort.llm.common import table
from tests.conftest import SF001, SF01


def slow(url):
    """(host, path, rule, verdict)."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for h, p, v in U.RULES if ("." + host).endswith("." + h) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


@pytest.mark.parametrize("sf", [SF001, SF01])
def test_given_pages(spark, sf):
    df = U.judged(table(spark, sf, "pages"))
    assert compare(df, duckdb_views(sf), U.oracle()) == []
    rows = {r.page_id: r for r in df.collect()}
    for r in table(spark, sf, "pages").collect():
        host, path, rule, verdict = slow(r.url)
        got = rows[r.page_id]
        assert (got.host, got.path, got.rule) == (host, path, rule) and got.verdict == (verdict or got.verdict)


def test_edges(spark):
    urls = [None, "", "no scheme", "http://", "HTTPS://WWW.Example.COM/en/x?y#z", "http://example.com/en/", "http://example.com/en", "http://a.example.com/en/q",
            "http://com/", "http://xcom/", "http://a.net/es/1", "http://net/fr/", "http://netx/fr/", "http://É.Net/es/?a=b://c", "x://y://z.com/", "http://a.com",
            "http://a.net?q/es/", "http://b.org/" + "long/" * 20_000, "http://b.org/1.html", "http://b.org/1.html", "ftp://b.org:80/es/#f", "http://a..net/es/"]
    rows = [(i % 20, u, "h", "x", 1) for i, u in enumerate(urls)] + [(None, "http://q.net/es/", "h", "x", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string, tokens int")
    got = U.judged(df).collect()
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in got), key=key) == sorted(((i, *slow(u)[:3]) for i, u, *_ in rows), key=key)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [r[:2] for r in rows])
    assert compare(U.judged(df), con, U.oracle()) == []
    assert {r.verdict for r in U.judged(df.where("url LIKE '%b.org%'")).collect()} == {"allow"}
    assert U.judged(df.limit(0)).collect() == []


def test_a_rule_of_four_tokens_decides(spark):
    kinds = ["http://a.net/es/1.html?q=1", "http://a.com/es/1.html", "http://a.com/es/1?q=1", "http://a.com/x/1.html?q=1", "https://a.com/es/1.html?q=1"]
    rows = [(i, kinds[i % 5]) for i in range(200)] + [(900, "http://b.org/es/7.html?q=2"), (901, "http://b.org/es/7.html")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r for r in U.judged(df).collect()}
    assert got[900].verdict == "block" and len(got[900].mined_rule.split(" ")) == 4
    assert got[901].verdict == "allow"
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    assert compare(U.judged(df), con, U.oracle()) == []
