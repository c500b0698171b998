from pyspark.sql import functions as F

from perkflow.llm import urls
from perkflow.llm.queries import URL_RULES


def test_query_matches_sql(matches_sql):
    matches_sql("op10_url_reputation")


def judge(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, bad int, host string")
    return {r["page_id"]: tuple(r["judged"]) for r in urls.judged(pages, "page_id", "url", "bad", URL_RULES).collect()}


def test_rules_and_parsing(spark):
    cases = {
        1: ("http://A.Example.NET/en/x?y", ("a.example.net", "/en/x", "example.net/en/", "allow")),
        2: ("http://example.net/de/", ("example.net", "/de/", "net/", "block")),
        3: ("http://notexample.com/de/", ("notexample.com", "/de/", None, "allow")),
        4: ("http://example.com/de/#a", ("example.com", "/de/", "example.com/de/", "block")),
        5: ("http://x.org/fr/1", ("x.org", "/fr/1", "org/fr/", "allow")),
        6: ("http://x.net?q=/a", ("x.net", "", None, "allow")),
        7: (None, ("", "", None, "allow")), 8: ("no scheme", ("", "", None, "allow")),
        9: ("a://b://c/d", ("b:", "//c/d", None, "allow")),
        10: ("http://É.ORG/FR/", ("É.org", "/FR/", None, "allow")), 11: ("", ("", "", None, "allow")),
    }
    got = judge(spark, [(i, u, None, "clash") for i, (u, _) in cases.items()])
    assert got == {i: want for i, (_, want) in cases.items()}


def test_bad_host_is_blocked_and_its_siblings_lean_on_the_domain(spark):
    rows = [(i, f"http://spam.bad.com/{i}", 1, None) for i in range(60)]
    rows += [(100 + i, f"http://h{i % 30}.fine.org/{i}", 0, None) for i in range(300)]
    rows += [(900, "http://new.bad.com/", None, None), (901, "http://one.fine.org/", 1, None)]
    got = judge(spark, rows)
    assert got[0][3] == "block" and got[100][3] == "allow" and got[901][3] == "allow"


def test_domains(spark):
    hosts = {"a.b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", "co.uk"), "x.y.com": ("com", "y.com"),
             "u@x.com:80": ("com", "x.com"), "10.0.0.1": ("ip", "10.0.0.1"), "": ("", ""), "com": ("com", "com"),
             "x.com.": ("com", "x.com")}
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    s, d = urls.suffix_and_domain(F.col("h"))
    assert {r[0]: (r[1], r[2]) for r in df.select("h", s, d).collect()} == hosts


def test_empty_table(spark):
    assert judge(spark, []) == {}
