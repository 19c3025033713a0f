from pyspark.sql import functions as F

from nitscope.llm import urls

CASES = [
    ("https://a.org/x", "a.org", "/x", "org/"),
    ("https://A.Example.ORG/es/1?q", "a.example.org", "/es/1", "example.org/es/"),
    ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1"),
    ("http://notexample.org/en/12", "notexample.org", "/en/12", "org/"),
    ("ftp://x.com/fr/?", "x.com", "/fr/", "com/fr/"),
    ("http://x.com/de/#t", "x.com", "/de/", "com/de/"),
    ("http://x.com?u=/de/", "x.com", "", None),
    ("http://a://b/c", "a:", "//b/c", None),
    ("http://org", "org", "", None),
    ("://", "", "", None),
    ("no scheme", "", "", None),
    ("", "", "", None),
    (None, "", "", None),
]


def test_parts_and_rules(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES], "url string")
    host, path = urls.split_url(F.col("url"))
    got = df.select("url", host.alias("host"), path.alias("path")).withColumn("rule", urls.match_rule(F.col("host"), F.col("path"))["rule"]).collect()
    assert [tuple(r) for r in got] == CASES


def test_model_tells_unwanted_sites(spark):
    model = urls.train(urls.labelled_urls(spark))
    names = {"https://best-casino.example.net/en/1": "block", "http://cheap-pills.example.com/en/5": "block", "https://library-news.example.net/en/3": "allow", "http://blog.tionsh.example.net/en/78": "allow"}
    df = spark.createDataFrame([(u,) for u in names], "url string")
    got = {r.url: r.verdict for r in urls.judge(df, model).where("by_model").collect()}
    assert got == {k: names[k] for k in got} and len(got) >= 3


def test_empty_tables(spark):
    none = spark.createDataFrame([], "url string, bad int")
    model = urls.train(none)
    assert urls.judge(none, model).count() == 0
    odd = spark.createDataFrame([(None, 1, "x"), (None, 1, "x")], "url string, page_id int, host string")
    assert [r.host for r in urls.judge(odd, model).collect()] == ["", ""]
