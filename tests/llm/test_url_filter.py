from irforge.llm import url_filter as uf

PAGES = [
    (1, "http://a.net/x", None), (2, "HTTP://A.Example.NET/en/x#f", ""), (3, "https://b.example.com/de/1", "<p>"), (4, "https://b.example.com/fr/1", "<p>"),
    (5, "https://x.org/fr/2", None), (6, "https://x.org/de/2", None), (7, None, "<a>"), (8, "", None), (9, "no scheme.net/", None), (10, "http://", None), (11, "http://a.net", None),
    (12, "http://www.b.example.com/de/1.html?utm_source=x", None),
    # a canonical link to a blocked page, a meta refresh to the linking page, and a chain to an allowed page
    (20, "http://plain.org/a", '<head><LINK href="https://b.example.com/de/1" rel="canonical"></head>'),
    (21, "http://other.org/b", "<meta http-equiv='refresh' content='0; url=http://plain.org/a'>"),
    (22, "http://m.mixed.org/c", '<link rel=canonical href="http://a.net/blocked">'), (23, "http://mixed.org/c/", '<link rel=canonical href=https://z.org/fr/9>'),
    (24, "http://rel.org/d", '<link rel="canonical" href="/e">'), (25, "http://rel.org/e/", '<link rel="canonical" href="http://a.net/y">'),
    (26, "http://unrelated.net.org/net/", '<link rel="stylesheet" href="http://a.net/z">'),
    (None, "http://a.net/x", None), (1, "http://a.net/x", None), (30, "ftp://a.b?c#d://e", None), (31, "http://éÉ.NET/É/x?y", None),
]


def judged(spark, rows, **extra):
    from pyspark.sql import functions as F
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({k: F.lit(v) for k, v in extra.items()})
    return uf.judge(pages, uf.rule_table(spark)).collect()


def test_rules_aliases_and_edge_rows(spark):
    out = judged(spark, PAGES, host="clash", rule="x", component=1, verdict="y")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out}
    assert len(out) == len(PAGES)
    assert got == {
        1: ("a.net", "/x", "net/", "block"), 2: ("a.example.net", "/en/x", "example.net/en/", "allow"), 3: ("b.example.com", "/de/1", "example.com/de/", "block"),
        4: ("b.example.com", "/fr/1", None, "allow"), 5: ("x.org", "/fr/2", "org/fr/", "allow"), 6: ("x.org", "/de/2", None, "allow"),
        7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("", "", None, "allow"), 11: ("a.net", "", None, "allow"),
        12: ("www.b.example.com", "/de/1.html", "example.com/de/", "block"),
        20: ("plain.org", "/a", None, "block"), 21: ("other.org", "/b", None, "block"),
        22: ("m.mixed.org", "/c", None, "allow"), 23: ("mixed.org", "/c/", None, "allow"),
        24: ("rel.org", "/d", None, "block"), 25: ("rel.org", "/e/", None, "block"), 26: ("unrelated.net.org", "/net/", None, "allow"),
        None: ("a.net", "/x", "net/", "block"), 30: ("a.b", "", None, "allow"), 31: ("éÉ.net", "/É/x", "net/", "block"),
    }


def test_own_rules_hold_within_a_component(spark):
    out = judged(spark, PAGES + [(41, "http://a.net/blocked", None), (42, "https://z.org/fr/9", None)])
    got = {r.page_id: r.verdict for r in out}
    assert got[22] == got[23] == "allow"  # blocked and explicitly allowed aliases: the allow takes precedence
    assert got[41] == "block" and got[42] == "allow"


def test_sql_twin_on_edge_rows(spark):
    import duckdb
    import pandas as pd

    pages = pd.DataFrame(PAGES, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"})  # noqa: F841  read by DuckDB
    want = duckdb.sql(uf.SQL).fetchall()
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in judged(spark, PAGES)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_table(spark):
    assert judged(spark, []) == []
