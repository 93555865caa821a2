"""Not-modified revisits: an as-of join by canonical URL to the latest earlier full response, with validators and headers.

Only narrow columns travel: bodies stay where they are and can be joined by `response_id` afterwards.  A URL with very many
captures is cut into time buckets; the last response of the earlier buckets is carried into each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Header fields a 304 response sends to update a stored one, and query keys that only track visitors.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
TRACKING = "^(utm_[a-z]+|fbclid|gclid|sessionid|jsessionid|phpsessid)(=|$)"


def canonical(url: Column) -> Column:
    """Scheme, user, www/m prefix, default port, fragment, index page, trailing slash and tracking keys go; keys are sorted."""
    plain = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "#.*$", "")
    place = F.regexp_extract(plain, "^([A-Za-z][A-Za-z0-9+.-]*://)?([^?]*)", 2)
    host = F.lower(F.regexp_extract(place, "^([^/]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^[^@]*@", ""), ":(80|443)$", ""), "^(www[0-9]*|m)\\.", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(place, "^[^/]*(.*)$", 1), "/index\\.html?$", "/"), "/+$", "")
    asked = F.regexp_extract(plain, "\\?(.*)$", 1)
    keys = F.array_join(F.array_sort(F.filter(F.split(asked, "&"), lambda k: (k != "") & ~F.lower(k).rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(keys != "", F.concat(F.lit("?"), keys)).otherwise(""))


def tag(etag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(F.trim(etag), '^(W/)?"?|"$', "")


def resolve(records: DataFrame, bucket_seconds: int = 86_400) -> DataFrame:
    """One row per revisit of `records` (record_id, url, ts seconds, kind, headers map of lower-case names, digest).

    kind `response` is a full response, `revisit` a not-modified answer; other kinds are ignored.  Returns revisit_id, url_key,
    ts, response_id, digest (of the response), verdict and headers.  The response is the latest one of the same canonical
    URL that is earlier (ties in time: the smaller record_id is earlier).  verdict: `no_response`, `mismatch` (entity tags, or
    else modification times, or else payload digests differ), `unverified` (no validator on both sides) or `resolved`.
    Headers are those of the response, with the permitted ones of the revisit on top, when resolved or unverified; a revisit
    that does not fit keeps its own.

    A null URL counts as the empty one, a null header map as an empty one, rows without ts or record_id take no part in the
    order and revisits among them get `no_response`.  Repeated revisits are answered each; other columns are ignored.
    """
    empty = F.create_map().cast("map<string,string>")
    rows = records.where(F.col("kind").isin("response", "revisit")).select(
        "record_id", canonical(F.col("url")).alias("url_key"), F.col("ts").cast("bigint").alias("ts"), "kind", F.coalesce("headers", empty).alias("headers"), "digest"
    )
    payload = F.when((F.col("kind") == "response") & F.col("ts").isNotNull() & F.col("record_id").isNotNull(), F.struct("ts", "record_id", "headers", "digest"))
    rows = rows.withColumn("__own", payload).withColumn("__bucket", F.floor(F.col("ts") / bucket_seconds))
    rank = F.struct("ts", "record_id")
    inside = Window.partitionBy("url_key", "__bucket").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("url_key").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        rows.where(F.col("__own").isNotNull())
        .groupBy("url_key", "__bucket")
        .agg(F.max_by("__own", rank).alias("__edge"))
    )
    asked = rows.where("kind = 'revisit'").select("url_key", "__bucket").distinct()
    carried = (
        asked.join(edges, ["url_key", "__bucket"], "full")
        .withColumn("__carried", F.last("__edge", ignorenulls=True).over(earlier))
        .select("url_key", "__bucket", "__carried")
    )
    near = rows.withColumn("__near", F.last("__own", ignorenulls=True).over(inside)).where("kind = 'revisit'")
    found = near.join(carried, ["url_key", "__bucket"], "left").withColumn(
        "__r", F.when(F.col("ts").isNotNull() & F.col("record_id").isNotNull(), F.coalesce("__near", "__carried"))
    )
    mine = lambda name: F.col("headers")[name]
    stored = lambda name: F.col("__r.headers")[name]
    fits = F.coalesce(
        tag(mine("etag")) == tag(stored("etag")),
        mine("last-modified") == stored("last-modified"),
        F.col("digest") == F.col("__r.digest"),
    )
    verdict = (
        F.when(F.col("__r").isNull(), "no_response").when(fits.isNull(), "unverified").when(fits, "resolved").otherwise("mismatch")
    )
    permitted = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter(F.col("__r.headers"), lambda k, v: ~F.map_contains_key(permitted, k))
    return found.withColumn("verdict", verdict).select(
        F.col("record_id").alias("revisit_id"),
        "url_key",
        "ts",
        F.when(F.col("verdict") != "mismatch", F.col("__r.record_id")).alias("response_id"),
        F.when(F.col("verdict") != "mismatch", F.col("__r.digest")).alias("digest"),
        "verdict",
        F.when(F.col("verdict").isin("resolved", "unverified"), F.map_concat(kept, permitted)).otherwise(F.col("headers")).alias("headers"),
    )


def header_lines(headers: Column) -> Column:
    """Headers as sorted `name: value` lines."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")


def crawl_of(pages: DataFrame) -> DataFrame:
    """Capture records from plain pages (page_id, url, html): a full response each, and a later not-modified revisit.

    The response of page p is taken at minute p, its revisit 5,000 minutes later; a page captured again in between makes
    the older page's revisit meet a newer response.
    """
    digest = F.md5(F.coalesce("html", F.lit("")))
    etag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    entry = lambda **h: F.map_from_arrays(F.array(*[F.lit(k.replace("_", "-")) for k in h]), F.array(*h.values()))
    day = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd HH:mm:ss")
    at, again = F.col("page_id") * 60, (F.col("page_id") + 5_000) * 60
    full = entry(content_type=F.lit("text/html"), content_length=F.octet_length(F.coalesce("html", F.lit(""))).cast("string"), etag=etag, date=day(at), cache_control=F.lit("max-age=60"))
    later = entry(content_type=F.lit("application/http"), etag=F.concat(F.lit("W/"), etag), date=day(again), expires=day(again + 3_600))
    record = lambda i, ts, kind, headers, d: F.struct(
        (F.col("page_id") * 2 + i).alias("record_id"), "url", ts.alias("ts"), F.lit(kind).alias("kind"), headers.alias("headers"), d.alias("digest")
    )
    return pages.select(F.inline(F.array(record(0, at, "response", full, digest), record(1, again, "revisit", later, F.lit(None).cast("string")))))
