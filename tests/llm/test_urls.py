"""URL verdicts on odd addresses, and the filter's false positives."""

import pytest
from pyspark.sql import functions as F

from floodframe.llm import urls
from floodframe.llm.common import prepare

CASES = [
    (1, "http://a.net/x", "a.net", "/x", "net/", "block"),
    (2, "http://b.Example.NET/en/1?q#f", "b.example.net", "/en/1", "example.net/en/", "allow"),
    (3, "http://example.net", "example.net", "", None, "allow"),
    (4, "https://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
    (5, "https://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
    (6, "x://m.org/fr/a", "m.org", "/fr/a", "org/fr/", "allow"),
    (7, None, "", "", None, "allow"),
    (8, "no scheme/net/", "", "", None, "allow"),
    (9, "http://www.bad.com/page/?x=1", "www.bad.com", "/page/", None, "block"),
    (9, "ftp://BAD.com/page#y", "bad.com", "/page", None, "block"),
    (10, "http://bad.com/other", "bad.com", "/other", None, "allow"),
    (11, "http://a?u=http://b.net/", "a", "", None, "allow"),
    (None, "http://É.net/", "É.net", "/", "net/", "block"),
    (12, "", "", "", None, "allow"),
    (13, "http://h.com/" + "p" * 50_000, "h.com", "/" + "p" * 50_000, None, "allow"),
    (14, "http://a.net\n/x\ny", "a.net\n", "/x\ny", None, "allow"),
]


@pytest.mark.parametrize("broadcast", [True, False])
def test_verdicts(spark, monkeypatch, broadcast):
    prepare(spark)
    if not broadcast:
        monkeypatch.setattr(urls, "bounded", lambda df, *_: df)
    pages = spark.createDataFrame([(p, u, "h", 1) for p, u, *_ in CASES], "page_id long, url string, host string, verdict int")
    listed = spark.createDataFrame([("bad.com/page",), ("bad.com/page",), (None,), ("other.com",)], "url string")
    got = [tuple(r) for r in urls.filter_urls(pages, listed).collect()]
    assert sorted(got, key=str) == sorted([(p, *rest) for p, _, *rest in CASES], key=str)
    assert {r["verdict"] for r in urls.filter_urls(pages, listed.limit(0)).where("rule is null").collect()} == {"allow"}
    assert urls.filter_urls(pages.limit(0), listed).count() == 0


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    prepare(spark)
    blocks = 1000
    inside = spark.range(6000).select(F.concat(F.lit("in/"), "id").alias("url"))
    bits = urls.bloom_filter(inside, blocks)
    rate = lambda df: df.join(bits.withColumnRenamed("block", "b"), urls._block(F.col("url"), blocks) == F.col("b"), "left").agg(
        F.avg(F.coalesce(F.col("bits").bitwiseAND(urls._mask(F.col("url"))) == urls._mask(F.col("url")), F.lit(False)).cast("int"))).first()[0]
    assert rate(inside) == 1
    assert rate(spark.range(20000).select(F.concat(F.lit("out/"), "id").alias("url"))) < 0.05
