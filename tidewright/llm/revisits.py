"""Not-modified revisits of WARC records: an as-of join by canonical URL to the latest earlier full response.

A revisit only says that the server answered "not modified". The stored response it stands for is the latest one before it
with the same canonical URL, if their validators agree; the headers that such an answer may update are merged.

The as-of join deals all records out by ranges of (URL, time), so a URL with very many records spreads over several
ranges. Inside a range the last response is a running value; the last response of earlier ranges of the same URL is carried in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

RANGE_ROWS = 20_000
# Header fields that a not-modified answer must not replace in the stored response.
NOT_MERGED = [
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authentication-info", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
]
TRACKING = r"^(utm_\w+|ref|fbclid|gclid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Without scheme, ``www.`` or ``m.``, default port, fragment, tracking parameters and final slash; host in small letters,
    parameters sorted. Null stays null."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(host, "^(www|m)[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", ""), "/{2,}", "/")
    query = F.filter(F.split(F.regexp_extract(rest, r"[?](.*)$", 1), "&"), lambda p: (p != "") & ~F.rlike(p, F.lit(TRACKING)))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(query), "&"))).otherwise(F.lit("")))


def _lowered(headers: Column) -> Column:
    """Header names in small letters; the last of equal names counts. Null is empty."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    same = lambda x, y: F.lower(x["key"]) == F.lower(y["key"])
    last = F.filter(entries, lambda x, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda y: same(x, y)))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(F.lower(x["key"]).alias("key"), x["value"].alias("value"))))


def latest_before(records: DataFrame) -> DataFrame:
    """Each revisit with the struct ``found`` of the latest response of its ``url`` at an earlier time, or null.

    ``records``: record_id, kind, url (canonical), ts, info (a struct). Of responses at the same time the one of largest
    record_id counts. A null url or ts matches nothing.
    """
    rank = F.when(F.col("kind") == "revisit", 0).otherwise(1)
    rows = records.withColumn("_rank", rank)
    parts = max(1, -(-rows.count() // RANGE_ROWS))
    rows = rows.repartitionByRange(parts, "url", "ts", "_rank", "record_id").withColumn("_range", F.spark_partition_id())
    rows = materialize(rows, "ranges")
    valid = F.col("url").isNotNull() & F.col("ts").isNotNull()
    response = F.when((F.col("kind") == "response") & valid, F.struct("ts", "record_id", "info"))
    order = W.partitionBy("_range", "url").orderBy("ts", "_rank", "record_id").rowsBetween(W.unboundedPreceding, 0)
    here = rows.withColumn("_here", F.last(response, ignorenulls=True).over(order))
    # One row for each URL and range, so at most as many rows of a URL as there are ranges.
    newest = F.max_by(F.struct("ts", "record_id", "info"), F.struct("ts", "record_id"))
    last = rows.where(valid & (F.col("kind") == "response")).groupBy("url", "_range").agg(newest.alias("_last"))
    ranges = rows.where(valid).select("url", "_range").distinct().join(last, ["url", "_range"], "left")
    before = W.partitionBy("url").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carry = ranges.select("url", "_range", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    here = here.where(F.col("kind") == "revisit").join(carry, ["url", "_range"], "left")
    return here.withColumn("found", F.when(valid, F.coalesce("_here", "_carry"))).drop("_rank", "_range", "_here", "_carry")


def resolve(records: DataFrame) -> DataFrame:
    """record_id, canonical_url, ts, status, resolved_id and headers (merged) of every revisit.

    ``records``: record_id, kind (response or revisit), url, ts, headers (map) and digest. ``status`` is ``resolved``,
    ``no_response`` (none earlier), ``no_validator`` (nothing to compare) or ``mismatch``. Entity tags are compared weakly,
    then the modification date; a payload digest of both sides must also agree. Only resolved revisits have
    resolved_id and headers.
    """
    base = records.select("record_id", "kind", canonical_url(F.col("url")).alias("url"), "ts", F.struct(_lowered(F.col("headers")).alias("headers"), "digest").alias("info"))
    df = latest_before(base)
    new, old = F.col("info.headers"), F.col("found.info.headers")
    tag = lambda h: F.regexp_replace(F.try_element_at(h, F.lit("etag")), "^W/", "")
    date = lambda h: F.try_element_at(h, F.lit("last-modified"))
    agree = F.coalesce(tag(new) == tag(old), date(new) == date(old))
    digest = F.coalesce(F.col("info.digest") == F.col("found.info.digest"), F.lit(True))
    status = F.when(F.col("found").isNull(), "no_response").when(agree.isNull(), "no_validator").when(agree & digest, "resolved").otherwise("mismatch")
    update = F.map_filter(new, lambda k, v: ~k.isin(NOT_MERGED))
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(update), k))
    df = df.withColumn("status", status)
    done = F.col("status") == "resolved"
    return df.select(
        "record_id", F.col("url").alias("canonical_url"), "ts", "status",
        F.when(done, F.col("found.record_id")).alias("resolved_id"),
        F.when(done, F.map_concat(kept, update)).alias("headers"),
    )


def with_bodies(resolved: DataFrame, bodies: DataFrame) -> DataFrame:
    """Join the stored bodies (record_id, body) to resolved revisits."""
    return resolved.join(bodies.select(F.col("record_id").alias("resolved_id"), "body"), "resolved_id", "left")


#: Time after which the pages' crawl log asks for each page again.
RECRAWL = 1000


def crawl_log(pages: DataFrame) -> DataFrame:
    """A crawl's records from ``pages``: a full response of each page at its number, a revisit RECRAWL later."""
    headers = lambda *kv: F.create_map(*[x if not isinstance(x, str) else F.lit(x) for x in kv])
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    full = headers("ETag", tag, "Content-Type", "text/html", "Content-Length", F.octet_length("html").cast("string"), "Cache-Control", "max-age=600", "Date", F.col("page_id").cast("string"))
    short = headers("ETag", F.concat(F.lit("W/"), tag), "Content-Length", "0", "Cache-Control", "max-age=60", "Date", (F.col("page_id") + RECRAWL).cast("string"))
    row = lambda kind, add, ts, h: F.struct((F.col("page_id") * 2 + add).alias("record_id"), F.lit(kind).alias("kind"), "url", ts.alias("ts"), h.alias("headers"), F.sha1("html").alias("digest"))
    both = F.array(row("response", 0, F.col("page_id"), full), row("revisit", 1, F.col("page_id") + RECRAWL, short))
    return pages.select(F.explode(both).alias("r")).select("r.*")


def header_lines(headers: Column) -> Column:
    """The headers as sorted ``name: value`` lines."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))), "\n")


SQL = f"""
WITH a AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages),
b AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*', 0)), '^(www|m)[.]', ''), ':(80|443)$', '') AS host,
  regexp_replace(regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', ''), '/{{2,}}', '/', 'g') AS path,
  list_sort(list_filter(string_split(regexp_extract(rest, '[?](.*)$', 1), '&'), lambda p: p != '' AND NOT regexp_matches(p, '{TRACKING}'))) AS q FROM a),
c AS (SELECT *, host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS curl FROM b),
r AS (SELECT curl, page_id AS ts, max(page_id) AS page_id FROM c GROUP BY ALL),
v AS (SELECT c.page_id * 2 + 1 AS record_id, c.curl, c.page_id + {RECRAWL} AS ts, c.html, r.page_id AS hit FROM c ASOF LEFT JOIN r ON c.curl = r.curl AND c.page_id + {RECRAWL} > r.ts),
s AS (SELECT v.*, o.html AS stored, CASE WHEN hit IS NULL THEN 'no_response' WHEN v.html = o.html THEN 'resolved' ELSE 'mismatch' END AS status FROM v LEFT JOIN c o ON o.page_id = v.hit)
SELECT record_id, curl AS canonical_url, ts, status, CASE WHEN status = 'resolved' THEN hit * 2 END AS resolved_id,
  CASE WHEN status = 'resolved' THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || strlen(stored) || chr(10) || 'content-type: text/html' || chr(10)
    || 'date: ' || ts || chr(10) || 'etag: W/"' || md5(stored) || '"' END AS headers
FROM s
"""
