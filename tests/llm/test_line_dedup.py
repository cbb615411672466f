import re

import duckdb

from quarry.llm import line_dedup as m

SCHEMA = "page_id bigint, url string, html string, host string, bad string, lines int, kept int, line string"


def make(spark, rows):
    return spark.createDataFrame([(*r, "h", "b", 1, 2, "l") for r in rows], SCHEMA)


def site(host, n, start=0):
    return [(start + i, f"https://User@{host}:8080/p/{i}?q=1", f"<!DOCTYPE html><nav><li>Home</li><li>About <b>us</b></li></nav><script>var x='<p>no</p>';</script><p>unique {host} {i}</p><p>{'rare' if i == 0 else 'text'} {i}</p><p>half {i % 2}</p><p></p>") for i in range(n)]


def brute(rows, ratio, least):
    pages = []
    for i, url, html in rows:
        host = re.search(r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
        host = None if url is None else host.group(1).lower() if host else ""
        lines = None
        if html is not None:
            cut = re.split(m.SPLIT, re.sub(m.DROP, "", html))
            lines = [x for x in (re.sub(m.EDGES, "", re.sub(m.TAGS, "", c)) for c in cut) if x]
        pages.append((i, host, lines))
    out = []
    for i, host, lines in pages:
        own = [p for p in pages if p[1] == host and p[2] is not None]
        kept = lines
        if host and lines is not None and len(own) >= least:
            kept = [x for x in lines if sum(x in p[2] for p in own) <= ratio * len(own)]
        out.append((i, host, None if lines is None else "\n".join(kept), len(lines or []), len(lines or []) - len(kept or [])))
    return sorted(out, key=str)


ROWS = site("A.example.com", 9) + site("b.example.org", 4, 100) + [(200, None, "<p>a</p>"), (201, "no address", "<p>a</p>"), (202, "http://c.net", None), (203, "http://c.net", ""), (204, "http://c.net", "plain\nplain\n x ")] + [(300, "http://d.net/", "<p>same</p>")] * 6 + [(None, "http://a.example.com/", "<p>Home</p>")]


def test_against_brute_force(spark):
    got = sorted(map(tuple, m.drop_site_boilerplate(make(spark, ROWS), ratio=0.3).collect()), key=str)
    assert got == brute(ROWS, 0.3, m.MIN_PAGES)
    kept = {r[0]: r[2] for r in got}
    assert "Home" not in kept[0] and "unique" in kept[0] and "Home" in kept[100]


def test_against_sql(spark):
    import pandas as pd

    con = duckdb.connect()
    con.register("pages", pd.DataFrame([r for r in ROWS if r[0] is not None], columns=["page_id", "url", "html"]))
    got = m.drop_site_boilerplate(make(spark, [r for r in ROWS if r[0] is not None]))
    want = con.execute(m.SQL).fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_empty(spark):
    assert m.drop_site_boilerplate(make(spark, [])).count() == 0
