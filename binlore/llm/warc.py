"""Not-modified revisits: each takes the body and headers of the latest earlier full response of its canonical URL.

``parse_records`` reads HTTP messages of response and revisit records; ``resolve_revisits`` is the as-of join. Captures are
range-partitioned by (URL, time, id), so that a URL of any weight spreads over many tasks. Inside a partition a window gives the
last full response before each row; across partitions a table of one row for each partition carries the last response of the URL
that goes on. Bodies do not take part: they are joined to the resolved revisits at the end, those of hot sources in several tasks.

A revisit is resolved if its validators hold against that response: the ETags (weak marks ignored) where both have
one, else the Last-Modified dates, else not. Headers that a not-modified response may update come from the revisit, the rest
from the response.

Ties in time: the smaller id is earlier. Nulls: a null URL or time resolves nothing; null headers are empty; a null message has no status and
is no capture. Empty bodies are empty strings; long URLs and bodies are read whole. Repeated rows each give a row. Columns other
than those named are left out, so that clashing names do no harm. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_SHARE, SALTS, read_table, staged

# Headers that a not-modified response may update.
UPDATABLE = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
BREAK = "\r\n"


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _plain_escapes(text: Column) -> Column:
    """Percent escapes of unreserved characters decoded, the others in upper case."""
    def part(p: Column, i: Column) -> Column:
        char = F.char(F.conv(F.substring(p, 1, 2), 16, 10).cast("int"))
        rest = p.substr(F.lit(3), F.length(p))
        escape = F.when(char.rlike("^[A-Za-z0-9._~-]$"), F.concat(char, rest)).otherwise(F.concat(F.lit("%"), F.upper(F.substring(p, 1, 2)), rest))
        return F.when(i == 0, p).when(p.rlike("^[0-9A-Fa-f]{2}"), escape).otherwise(F.concat(F.lit("%"), p))
    return F.array_join(F.transform(F.split(text, "%"), part), "")


def _without_dots(path: Column) -> Column:
    """A path from ``/`` without its ``.`` and ``..`` segments."""
    def clean(parts: Column) -> Column:
        step = lambda kept, s: F.when(s == ".", kept).when(s == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(s)))
        kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"), step)
        tail = F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise("")
        return _let(F.concat(F.lit("/"), F.array_join(kept, "/")), lambda p: F.when(p.endswith("/"), p).otherwise(F.concat(p, tail)))
    return F.when(path.rlike(r"/\.\.?(/|$)"), _let(F.split(path, "/"), clean)).otherwise(path)


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case (not the user's name), no default port, no fragment, plain escapes, a path without dot segments."""
    def build(bare: Column) -> Column:
        part = lambda k: F.regexp_extract(bare, r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*@)?([^/?]*))?([^?]*)(.*)$", k)
        scheme, host = F.lower(part(1)), F.lower(part(3))
        port = F.when(scheme == "http", F.regexp_replace(host, ":(80)?$", "")).when(scheme == "https", F.regexp_replace(host, ":(443)?$", "")).otherwise(host)
        site = F.when(scheme == "", "").otherwise(F.concat(scheme, F.lit("://"), part(2), port))
        path = _let(_plain_escapes(part(4)), lambda p: _without_dots(F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))))
        return F.concat(site, path, _plain_escapes(part(5)))
    return _let(F.regexp_replace(url, "(?s)#.*$", ""), build)


def parse_records(records: DataFrame) -> DataFrame:
    """``records`` (id, time, url, type, message) as captures: id, time, url, status, headers, body.

    ``message`` is an HTTP response: status line, header lines, empty line, body. Status is null unless a ``response`` has 200 or a
    ``revisit`` 304. Header names become lower case; values of a repeated name are joined by commas.
    """
    head = F.substring_index("message", BREAK * 2, 1)
    code = F.regexp_extract(head, r"^HTTP/\d(?:\.\d+)?\s+(\d{3})(?:\s|$)", 1)
    lines = F.filter(F.slice(F.split(head, BREAK), 2, 1 << 30), lambda x: F.instr(x, ":") > 1)
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.regexp_replace(x, "(?s)^[^:]*:", "")).alias("v")))
    values = lambda p, k: F.array_join(F.transform(F.filter(p, lambda x: x["k"] == k), lambda x: x["v"]), ", ")
    headers = _let(pairs, lambda p: _let(F.array_distinct(F.transform(p, lambda x: x["k"])), lambda names: F.map_from_arrays(names, F.transform(names, lambda k: values(p, k)))))
    status = F.when((F.col("type") == "response") & (code == "200"), 200).when((F.col("type") == "revisit") & (code == "304"), 304)
    body = F.col("message").substr(F.length(head) + 1 + 2 * len(BREAK), F.length("message"))
    return records.select("id", "time", "url", status.alias("status"), F.coalesce(headers, F.create_map().cast("map<string,string>")).alias("headers"), body.alias("body"))


def _latest_before(rows: DataFrame) -> DataFrame:
    """Revisits of ``rows`` (canon, time, id, status, headers, full) with ``source``, the last ``full`` before each in its URL."""
    order = ["canon", "time", "id"]
    dealt = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    dealt = staged(dealt, "captures")  # written once, so that all that follows sees the same partitions
    place = F.struct("canon", "time", "id")
    ends = dealt.where("canon is not null").groupBy("part").agg(F.min("canon").alias("first"), F.max("canon").alias("last"), F.max_by(F.when(F.col("full").isNotNull(), F.struct("canon", "full")), F.when(F.col("full").isNotNull(), place)).alias("end"))
    # the last response of a partition counts for those behind it if it is of the URL that they begin with
    closing = ends.where("end.canon = last").select(F.col("last").alias("canon"), "part", F.col("end.full").alias("end"), F.lit(1).alias("kind"))
    opening = ends.select(F.col("first").alias("canon"), "part", F.lit(None).cast(rows.schema["full"].dataType).alias("end"), F.lit(0).alias("kind"))
    before = Window.partitionBy("canon").orderBy("part", "kind").rowsBetween(Window.unboundedPreceding, -1)  # two rows for each partition at most
    carried = closing.unionByName(opening).withColumn("carry", F.last("end", ignorenulls=True).over(before)).where("kind = 0").select("part", "canon", "carry")
    inside = Window.partitionBy("part", "canon").orderBy("time", "id").rowsBetween(Window.unboundedPreceding, -1)
    seen = dealt.withColumn("near", F.last("full", ignorenulls=True).over(inside)).where("status = 304")
    seen = seen.join(F.broadcast(carried), ["part", "canon"], "left")  # one row for each partition
    return seen.withColumn("source", F.when(F.col("time").isNotNull(), F.coalesce("near", "carry")))


def resolve_revisits(captures: DataFrame, body: bool = True) -> DataFrame:
    """Revisits of ``captures`` (id, url, time: long, status: int, headers: map of lower-case names, body) with ``source_id``, merged ``headers`` and the source's ``body``.

    Full responses have status 200, revisits 304, other rows are passed over; ids of full responses are unique. ``source_id`` and ``body``
    are null where nothing matches; headers are then the revisit's own.
    """
    rows = captures.select("id", canonical_url(F.col("url")).alias("canon"), "time", "status", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers")).where("status in (200, 304)")
    rows = rows.withColumn("full", F.when((F.col("status") == 200) & F.col("canon").isNotNull() & F.col("time").isNotNull(), F.struct("id", "headers")))
    seen = _latest_before(rows)
    value = lambda m, k: F.regexp_replace(F.try_element_at(m, F.lit(k)), "^W/", "")
    own, theirs = F.col("headers"), F.col("source.headers")
    etags = value(own, "etag"), value(theirs, "etag")
    dates = value(own, "last-modified"), value(theirs, "last-modified")
    holds = F.when(etags[0].isNotNull() & etags[1].isNotNull(), etags[0] == etags[1]).otherwise(F.coalesce(dates[0] == dates[1], F.lit(False)))
    updates = F.map_filter(own, lambda k, v: k.isin(*UPDATABLE))
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~F.map_contains_key(updates, k)), updates)
    out = seen.select("id", F.col("canon").alias("url"), "time", F.when(holds, F.col("source.id")).alias("source_id"), F.when(holds, merged).otherwise(own).alias("headers"))
    if not body:
        return out
    out = staged(out, "revisits")
    bodies = captures.where("status = 200 and id is not null").select(F.col("id").alias("source_id"), "body")
    # the body of a hot source goes to several tasks, and its revisits are dealt among them
    hot = out.where("source_id is not null").groupBy("source_id").count().where(F.col("count") * HOT_SHARE > out.count()).select("source_id", F.lit(True).alias("__bl_hot"))
    hot = F.broadcast(hot)  # HOT_SHARE ids at most
    # revisits without a source match nothing, and are dealt by their ids
    salt = F.when(F.col("source_id").isNull(), F.hash("id")).when(F.col("__bl_hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    dealt = out.join(hot, "source_id", "left").withColumn("__bl_salt", salt)
    copies = F.when(F.col("__bl_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread = bodies.join(hot, "source_id", "left").withColumn("__bl_salt", F.explode(copies)).drop("__bl_hot")
    key = ["source_id", "__bl_salt"]
    return dealt.join(spread.dropDuplicates(key), key, "left").select(*out.columns, "body")


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """Records made from ``pages`` (page_id, url, html): each page's response, a revisit of it by another spelling of its URL, and a capture of its site's root.

    The root of a site has a capture for each of its pages, many at the same time; every fourth is a response, the others revisits.
    """
    p, url = F.col("page_id"), F.col("url")
    html, site = F.coalesce("html", F.lit("")), F.regexp_extract(url, "^[a-z]+://[^/]+", 0)
    rest = url.substr(F.length(site) + 1, F.length(url))
    tag = F.concat(F.lit('"'), F.md5(html), F.lit('"'))
    day = lambda n: F.concat(F.lit("Last-Modified: day "), n.cast("string"), F.lit(BREAK))
    etag = lambda value: F.concat(F.lit("ETag: "), value, F.lit(BREAK))
    message = lambda status, *parts: F.concat(F.lit(f"HTTP/1.1 {status}{BREAK}Content-Type: text/{'html' if status[0] == '2' else 'none'}{BREAK}"), *parts)
    age = lambda n: F.concat(F.lit("Cache-Control: max-age="), n.cast("string"), F.lit(BREAK))
    full = message("200 OK", etag(tag), day(p % 7), age(p % 3), F.lit(BREAK), html)
    marks = F.when(p % 5 == 0, day(p % 7)).when(p % 5 == 1, etag(F.concat(F.lit("W/"), tag))).when(p % 5 == 2, etag(F.lit('"changed"'))).when(p % 5 == 3, "").otherwise(F.concat(etag(tag), day(p % 7 + 1)))
    spelt = F.when(p % 4 == 0, F.concat(url, F.lit("#top"))).when(p % 4 == 1, F.concat(F.upper(site), rest)).when(p % 4 == 2, F.concat(site, F.when(site.startswith("https"), ":443").otherwise(":80"), rest)).otherwise(F.concat(site, F.lit("/x/.."), rest))
    version = F.floor(p / 40).cast("string")
    home = F.concat(F.lit('"v'), version, F.lit('"'))
    root = F.when(p % 4 == 0, message("200 OK", etag(home), F.lit(BREAK), F.lit("home "), version)).otherwise(message("304 Not Modified", etag(home), F.lit(BREAK)))
    kinds = F.array(
        F.struct((4 * p).alias("id"), (10 * p).alias("time"), url.alias("url"), F.lit("response").alias("type"), full.alias("message")),
        F.struct((4 * p + 1).alias("id"), (10 * p + 5 + 1000 * (p % 4)).alias("time"), spelt.alias("url"), F.lit("revisit").alias("type"), message("304 Not Modified", marks, age(F.lit(9)), F.lit(f"Content-Length: 0{BREAK * 2}")).alias("message")),
        F.struct((4 * p + 2).alias("id"), (30 * F.floor(p / 3)).alias("time"), F.concat(site, F.lit("/")).alias("url"), F.when(p % 4 == 0, "response").otherwise("revisit").alias("type"), root.alias("message")),
    )
    return pages.select(F.explode(kinds).alias("r")).select("r.*")


def op2_revisit_resolution(spark, sf_dir):
    """Revisits of the records made from ``pages``, resolved."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = resolve_revisits(parse_records(captures_of_pages(pages)))
    head = lambda k: F.try_element_at("headers", F.lit(k))
    return found.select("id", "url", "time", "source_id", head("content-type").alias("content_type"), head("etag").alias("etag"), head("cache-control").alias("cache_control"), F.md5("body").alias("body_md5"))


#: The same from the pages themselves: all spellings of a page's URL are that URL, which is canonical but for its fragment.
ORACLE = """
WITH p AS (SELECT page_id AS p, regexp_replace(url, '#.*$', '') AS url, regexp_extract(url, '^[a-z]+://[^/]+') AS site, md5(coalesce(html, '')) AS tag FROM pages),
c AS (SELECT 4 * p AS id, 10 * p AS time, url, true AS whole, '"' || tag || '"' AS etag, 'day ' || (p % 7) AS day, 'max-age=' || (p % 3) AS age, tag AS body FROM p
  UNION ALL SELECT 4 * p + 1, 10 * p + 5 + 1000 * (p % 4), url, false, CASE p % 5 WHEN 1 THEN 'W/"' || tag || '"' WHEN 2 THEN '"changed"' WHEN 4 THEN '"' || tag || '"' END, CASE p % 5 WHEN 0 THEN 'day ' || (p % 7) WHEN 4 THEN 'day ' || (p % 7 + 1) END, 'max-age=9', NULL FROM p
  UNION ALL SELECT 4 * p + 2, 30 * (p // 3), site || '/', p % 4 = 0, '"v' || (p // 40) || '"', NULL, NULL, CASE WHEN p % 4 = 0 THEN md5('home ' || (p // 40)) END FROM p),
s AS (SELECT *, last_value(CASE WHEN whole THEN id END IGNORE NULLS) OVER (PARTITION BY url ORDER BY time, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS src FROM c),
j AS (SELECT s.*, f.etag AS f_etag, f.day AS f_day, f.age AS f_age, f.body AS f_body,
    coalesce(CASE WHEN s.etag IS NOT NULL AND f.etag IS NOT NULL THEN replace(s.etag, 'W/', '') = replace(f.etag, 'W/', '') ELSE s.day = f.day END, false) AS ok FROM s LEFT JOIN c f ON s.src = f.id WHERE NOT s.whole)
SELECT id, url, time, CASE WHEN ok THEN src END AS source_id, CASE WHEN ok THEN 'text/html' ELSE 'text/none' END AS content_type, CASE WHEN ok THEN coalesce(etag, f_etag) ELSE etag END AS etag,
  CASE WHEN ok THEN coalesce(age, f_age) ELSE age END AS cache_control, CASE WHEN ok THEN f_body END AS body_md5 FROM j
"""
