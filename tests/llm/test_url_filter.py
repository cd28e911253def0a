"""The URL filter against its SQL, on pages with links."""

import duckdb
import pytest

from dossier.llm.oracles import URL_FILTER
from dossier.llm.url_filter import judge

PAGES = [
    (1, "http://a.example.com/x?q=1", '<link rel="canonical" href="http://b.net/y">', "extra"),
    (2, "http://c.info/z/", '<META http-equiv=refresh content="0; url=/x2">', None),
    (3, "http://c.info/x2", "<link href='//b.net/y' rel=canonical>", None),
    (4, None, None, None),
    (5, "http://q.example.net/en/1", "<link rel=canonical href=http://b.net/y>", None),
    (6, "nope", "<link rel=canonical href=http://b.net/y>", None),
    (7, "HTTP://A.ORG/fr/?", "", None),
    (8, "http://b.net", "", None),
    (9, "http://s.example.com/de/x", '<link rel=canonical href="up">', None),
    (10, "http://s.example.com/de/up", None, None),
    (11, "http://t.info/p/q", '<link rel=canonical href="../..//s.example.com/de/up"><link rel=canonical href="http://s.example.com/de/up">', None),
    (12, "http://lonely.info/", "a canonical word", None),
    (12, "http://lonely.info/", "a canonical word", None),
    (13, "http://chain.info/1", '<link rel=canonical href="http://chain.info/2">', None),
    (14, "http://chain.info/2", '<link rel=canonical href="http://chain.info/3">', None),
    (15, "http://chain.info/3", '<link rel=canonical href="http://x.net/">', None),
    (16, "http://up.info/a/b/c", '<link rel=canonical href="../f">', None),
    (17, "http://up.info/a/f", '<meta http-equiv="refresh" content="0; url=http://y.net/">', None),
    (18, "http://two.info/s", '<link rel=canonical href="http://two.info/s"><link rel="canonical" href="http://z.net/">', None),
    (19, "http://amp.info/?a=1&b=2", '<meta http-equiv=refresh content="1;url=http://w.net/">', None),
    (20, "http://amp.info/p", '<link rel=canonical href="http://amp.info/?a=1&amp;b=2">', None),
    (21, "http://quiet.info/", '<!-- <link rel=canonical href="http://v.net/"> --><p>canonical', None),
    (22, "http://open.info/", '<!-- unfinished <link rel=canonical href="http://v.net/">', None),
    (23, "http://dots.info/a/./x/", '<link rel=canonical href="./../../../..//g/../h?x=../y">', None),
    (24, "http://dots.info//h?x=../y", '<link rel=canonical href="http://u.net/a/../b">', None),
    (25, "http://query.info/p?q=1", '<link rel=canonical href="?q=2"><link rel=canonical href="#top"><link rel=canonical href="mailto:a@b.net">', None),
    (26, "http://query.info/p?q=2", "<link rel=canonical href=https://t.net/>", None),
    (27, "http://long.info/", "x" * 300_000 + "<link rel=canonical href=//s.net/>", None),
]


def got(frame):
    return sorted(map(str, ((r.page_id, r.host, r.path, r.rule, r.verdict, r.aliased) for r in frame.collect())))


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string, verdict string")


def test_against_sql(spark, pages):
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar, verdict varchar)")
    con.executemany("insert into pages values (?, ?, ?, ?)", PAGES)
    want = sorted(str((r[0], r[1], r[2], r[3], r[4], r[5])) for r in con.sql(URL_FILTER).fetchall())
    assert got(judge(pages)) == want


def test_verdicts(pages):
    by = {r.page_id: r for r in judge(pages).collect()}
    assert by[1].verdict == by[2].verdict == by[3].verdict == "block" and by[1].aliased and by[13].verdict == "block"
    assert by[5].verdict == "allow" and by[5].rule == "example.net/en/" and by[7].rule == "org/fr/"
    assert (by[4].host, by[4].path, by[4].rule, by[4].verdict) == ("", "", None, "allow") and by[6].verdict == "allow"
    assert by[8].rule is None and by[9].rule == "example.com/de/"


def test_links_as_written(pages):
    """Relative targets, several links, decoded references, comments, dot segments, queries, and long pages."""
    by = {r.page_id: r for r in judge(pages).collect()}
    assert [k for k in range(16, 28) if by[k].verdict == "block" and by[k].aliased] == [16, 17, 18, 19, 20, 23, 24, 25, 26, 27]


def test_empty(spark, pages):
    assert judge(pages.limit(0)).count() == 0
