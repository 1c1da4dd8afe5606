import random

import pytest
from pyspark.sql import functions as F

from binlore.llm import warc

SCHEMA = "id long, url string, time long, status int, headers map<string,string>, body string"


def test_revisits(spark):
    rows = [
        (1, "http://A.example:80/x", 1, 200, {"etag": "e1", "content-type": "t"}, "one"), (2, "http://a.example/x#f", 9000, 304, {"etag": "W/e1", "date": "d", "content-type": "no"}, ""),
        (3, "http://a.example/x", 9001, 200, {"etag": "e2"}, ""), (4, "http://a.example/x", 9002, 304, {"etag": "e1"}, None), (5, None, 1, 304, None, None), (6, "http://b.example", None, 304, {}, None),
        (7, "http://c.example", 1, 200, {"last-modified": "m"}, None), (8, "http://c.example/", 1, 304, {"last-modified": "m"}, None), (8, "http://c.example/", 1, 304, {"last-modified": "m"}, None),
        (9, "http://b.example", None, 200, {"etag": "q"}, "never"), (10, "http://b.example", 5, 304, {"etag": "q"}, None), (11, "http://c.example", 1, 200, {"last-modified": "m"}, "later"), (12, "http://c.example", 0, 304, {"last-modified": "m"}, None),
        (13, "http://a.example/x", 9003, 500, {}, "no"), (14, "http://a.example/x", 9004, 304, {"etag": "e2", "set-cookie": "no"}, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"source": F.lit("clash"), "part": F.lit("clash"), "source_id": F.lit("clash")})
    got = [(r.id, r.source_id, r.headers.get("content-type"), r.headers.get("date"), r.body) for r in warc.resolve_revisits(df).orderBy("id").collect()]
    assert got == [(2, 1, "t", "d", "one"), (4, None, None, None, None), (5, None, None, None, None), (6, None, None, None, None), (8, 7, None, None, None), (8, 7, None, None, None), (10, None, None, None, None), (12, None, None, None, None), (14, 3, None, None, "")]
    assert warc.resolve_revisits(df.where("id = 14 or id = 3")).first().headers == {"etag": "e2"}
    assert warc.resolve_revisits(df.where(F.lit(False))).count() == 0


def test_hot_urls_cross_partitions(spark):
    r = random.Random(2)
    urls = ["http://hot.example/"] * 6 + ["http://b.example/", "http://c.example/" + "x" * 5000, None]
    rows = [(i, r.choice(urls), r.choice([r.randrange(400), None, 7]) if r.random() < 0.3 else r.randrange(400), r.choice([200, 304, 304, 304, 304, 304]), {"etag": str(r.randrange(2))}, f"body {i}") for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {x.id: (x.source_id, x.body) for x in warc.resolve_revisits(df).collect()}
    whole = [x for x in rows if x[3] == 200 and x[1] and x[2] is not None]
    for i, url, time, status, headers, _ in rows:
        if status == 304:
            before = max(((x[2], x[0]) for x in whole if x[1] == url and time is not None and (x[2], x[0]) < (time, i)), default=None)
            want = before[1] if before and rows[before[1]][4] == headers else None
            assert got.pop(i) == (want, f"body {want}" if want is not None else None)
    assert not got


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTP://Me@EXAMPLE.org:80", "http://Me@example.org/"), ("https://a.b:443/%7ex%2f%zz?q=%41%2b#f", "https://a.b/~x%2F%zz?q=A%2B"), ("https://a.b:8443/a/./b/../c/..", "https://a.b:8443/a/"),
        ("http://a.b/../../x", "http://a.b/x"), ("http://a.b?x=/./", "http://a.b/?x=/./"), ("/only/path", "/only/path"), ("http://a.b/.", "http://a.b/"), ("", "/"), (None, None), ("http://a.b:/x...y/..z", "http://a.b/x...y/..z"),
    ],
)
def test_canonical_urls(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(warc.canonical_url(F.col("u"))).first()[0] == want


def test_records(spark):
    text = "HTTP/1.1 200 OK\r\nETag:  \"a:b\" \r\nvary: x\r\nVary: y\r\nbroken\r\n\r\nbody\r\n\r\nmore"
    rows = [(1, 5, "u", "response", text), (2, 5, "u", "revisit", "HTTP/1.0 304 Not Modified\r\n\r\n"), (3, 5, "u", "revisit", text), (4, 5, "u", "response", None), (5, 5, "u", None, ""), (6, 5, "u", "response", "HTTP/2 200")]
    got = [tuple(r) for r in warc.parse_records(spark.createDataFrame(rows, "id long, time long, url string, type string, message string")).orderBy("id").collect()]
    assert got[0] == (1, 5, "u", 200, {"etag": '"a:b"', "vary": "x, y"}, "body\r\n\r\nmore") and got[1][3:] == (304, {}, "")
    assert [r[3] for r in got] == [200, 304, None, None, None, 200] and got[5][5] == ""
