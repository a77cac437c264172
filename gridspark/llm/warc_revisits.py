"""Not-modified revisit resolution for crawl records, with DataFrame functions only.

A revisit record (a server's 304 answer) is joined to the latest earlier full response of its canonical URL. The
validators of the two are checked, and the headers that a 304 may update are merged into the response's. The as-of join
works in time buckets: a running maximum inside each (URL, bucket), and the last response of the buckets before carried
over, so a URL with a third of all records is many groups. Payloads never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Query parameters that do not name a page, and hosts' prefixes that name the same site.
TRACKING = r"utm_[^=&]*|ref|fbclid|gclid|sessionid"
SAME_HOST = r"^(www|m)\."
#: Response headers that a 304 never updates: they describe the stored payload or the connection.
PROTECTED = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "transfer-encoding")
BUCKET_SECONDS = 3_600

_URL = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^?#]*)(?:\?([^#]*))?"


def canonical_url(url: Column) -> Column:
    """Host in small letters without a mobile or www prefix, port and user; path without a slash at its end; the other
    than tracking parameters in order; no scheme and no fragment. Null stays null."""
    part = lambda i: F.regexp_extract(url, _URL, i)
    host = F.regexp_replace(F.lower(part(1)), SAME_HOST, "")
    kept = F.array_sort(F.filter(F.split(part(3), "&"), lambda p: (p != "") & ~p.rlike(f"^({TRACKING})(=|$)")))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(url.isNotNull(), F.concat(host, F.regexp_replace(part(2), "/+$", ""), query))


def crawl_records(pages: DataFrame) -> DataFrame:
    """Crawl records derived from a table of pages (page_id, url, html): a full response for every page, an hour of
    pages a day apart, and for every even page a later revisit, some of them by another spelling of the URL, some with
    a changed validator and some before their response. Servers know ETags (some weak), or only Last-Modified, or
    neither, and then a record may have a digest."""
    page, length = F.col("page_id").cast("long"), F.coalesce(F.length("html"), F.lit(0))
    etag, digest = F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.sha2(F.coalesce("html", F.lit("")), 256)
    header = lambda *kv: F.array(*[F.struct(F.lit(k).alias("name"), v.cast("string").alias("value")) for k, v in kv])
    at = F.lit(1_700_000_000) + page * 3600
    kind = F.when(page % 8 == 2, "modified").when(page % 8 == 6, "digest").otherwise("etag")
    only = lambda k, v: F.when(kind == k, v)
    response = pages.select(
        F.concat(F.lit("r"), page).alias("record_id"),
        F.lit("response").alias("kind"),
        "url",
        at.alias("captured_at"),
        only("etag", etag).alias("etag"),
        only("modified", at.cast("string")).alias("last_modified"),
        digest.alias("digest"),
        header(("cache-control", F.lit("max-age=60")), ("content-length", length), ("content-type", F.lit("text/html")), ("date", at), ("etag", etag)).alias("headers"),
    )
    later = at + F.when(page % 14 == 0, F.lit(-1800)).otherwise(1800 + (page % 7) * 40_000)
    changed = page % 10 == 4
    seen = F.when(changed, F.lit("changed")).when(page % 8 == 4, F.concat(F.lit("W/"), etag)).otherwise(etag)
    revisit = pages.where(page % 2 == 0).select(
        F.concat(F.lit("v"), page).alias("record_id"),
        F.lit("revisit").alias("kind"),
        F.when(page % 3 == 0, F.concat("url", F.lit("#again"))).otherwise(F.col("url")).alias("url"),
        later.alias("captured_at"),
        only("etag", seen).alias("etag"),
        only("modified", (at - F.when(changed, 1).otherwise(0)).cast("string")).alias("last_modified"),
        F.when(kind != "digest", None).when(changed, F.lit("changed")).when(page % 3 != 0, digest).alias("digest"),
        header(("cache-control", F.concat(F.lit("max-age="), (page % 5) * 60)), ("content-length", F.lit(0)), ("date", later), ("x-cache", F.lit("HIT"))).alias("headers"),
    )
    return response.unionByName(revisit)


def _merged(stored: Column, fresh: Column) -> Column:
    """Headers of a response updated by those of a 304, by name."""
    names = lambda x: F.transform(x, lambda h: F.lower(h["name"]))
    allowed = F.filter(fresh, lambda h: ~F.lower(h["name"]).isin(*PROTECTED))
    kept = F.filter(stored, lambda h: ~F.array_contains(names(allowed), F.lower(h["name"])))
    return F.array_sort(F.transform(F.concat(kept, allowed), lambda h: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value"))))


def resolve_revisits(records: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """One row per revisit of ``records`` (record_id, kind, url, captured_at in seconds, etag, last_modified, digest,
    headers as array<struct<name, value>>; other columns are ignored): record_id, target_url, captured_at, status,
    response_id, age_s, headers.

    The latest response strictly earlier is the revisit's. status is resolved (the first validator that both have - ETag
    by weak comparison, else Last-Modified, else digest - agrees), validator_mismatch (it differs: headers stay the
    revisit's and no response is named), unvalidated (they have no validator in common: the response is named, headers
    stay) or no_earlier_response (also where URL or time is null). Of responses at one time the one with the largest
    record_id counts. Repeated revisits each keep a row; null headers are none; an empty table gives none.
    """
    none = F.array().cast("array<struct<name:string,value:string>>")
    rows = records.select("record_id", "kind", canonical_url(F.col("url")).alias("target_url"), F.col("captured_at").cast("long").alias("captured_at"), F.regexp_replace("etag", "^W/", "").alias("etag"), "last_modified", "digest", F.coalesce("headers", none).alias("headers"))
    rows = rows.withColumn("bucket", F.floor(F.col("captured_at") / bucket_seconds))
    known = (F.col("kind") == "response") & F.col("target_url").isNotNull() & F.col("captured_at").isNotNull()
    rows = rows.withColumn("full", F.when(known, F.struct("captured_at", "record_id", "etag", "last_modified", "digest", "headers")))
    located = F.col("target_url").isNotNull() & F.col("captured_at").isNotNull()
    placed = rows.where(located)
    inside = W.partitionBy("target_url", "bucket").orderBy("captured_at").rangeBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("near", F.max("full").over(inside)).where("kind = 'revisit'")
    before = W.partitionBy("target_url").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = rows.where(located).groupBy("target_url", "bucket").agg(F.max("full").alias("held"))
    carried = carried.select("target_url", "bucket", F.max("held").over(before).alias("carried")).where("carried is not null")
    found = placed.join(carried, ["target_url", "bucket"], "left").withColumn("of", F.coalesce("near", "carried")).drop("near", "carried", "full", "bucket")
    lost = rows.where(~located & (F.col("kind") == "revisit")).withColumn("of", F.col("full")).drop("full", "bucket")
    out = found.unionByName(lost)
    same = F.coalesce(*[F.col(v) == F.col(f"of.{v}") for v in ("etag", "last_modified", "digest")])
    status = F.when(F.col("of").isNull(), "no_earlier_response").when(same.isNull(), "unvalidated").when(same, "resolved").otherwise("validator_mismatch")
    resolved, named = status == "resolved", status.isin("resolved", "unvalidated")
    return out.select(
        "record_id",
        "target_url",
        "captured_at",
        status.alias("status"),
        F.when(named, F.col("of.record_id")).alias("response_id"),
        F.when(named, F.col("captured_at") - F.col("of.captured_at")).alias("age_s"),
        F.when(resolved, _merged(F.col("of.headers"), F.col("headers"))).otherwise(F.array_sort("headers")).alias("headers"),
    )


def sql() -> str:
    """resolve_revisits(crawl_records(pages)) in DuckDB SQL, headers as text."""
    # The URL expression without inline options reads alike in both engines.
    u = _URL.replace("'", "''")
    return f"""
    WITH c AS (SELECT *, regexp_extract(url, '{u}', 1) AS h, regexp_extract(url, '{u}', 2) AS p, regexp_extract(url, '{u}', 3) AS q FROM pages),
    k AS (SELECT *, list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^({TRACKING})(=|$)'))) AS kept FROM c),
    n AS (SELECT page_id, regexp_replace(lower(h), '{SAME_HOST}', '') || regexp_replace(p, '/+$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS target_url,
      substr(md5(coalesce(html, '')), 1, 16) AS tag, coalesce(length(html), 0) AS size, 1700000000 + page_id * 3600 AS t0, sha256(coalesce(html, '')) AS digest,
      CASE page_id % 8 WHEN 2 THEN 'modified' WHEN 6 THEN 'digest' ELSE 'etag' END AS kind FROM k),
    r AS (SELECT *, CASE WHEN kind = 'etag' THEN tag END AS etag, CASE WHEN kind = 'modified' THEN t0 END AS modified FROM n),
    v AS (SELECT page_id, target_url, t0 + CASE WHEN page_id % 14 = 0 THEN -1800 ELSE 1800 + (page_id % 7) * 40000 END AS later,
      CASE WHEN kind = 'etag' THEN CASE WHEN page_id % 10 = 4 THEN 'changed' ELSE tag END END AS etag,
      CASE WHEN kind = 'modified' THEN CASE WHEN page_id % 10 = 4 THEN t0 - 1 ELSE t0 END END AS modified,
      CASE WHEN kind = 'digest' THEN CASE WHEN page_id % 10 = 4 THEN 'changed' WHEN page_id % 3 <> 0 THEN digest END END AS digest FROM n WHERE page_id % 2 = 0),
    j AS (SELECT v.page_id, v.target_url, v.later, r.page_id AS rp, r.t0 AS rat, r.tag AS rtag, r.size AS rsize, coalesce(v.etag = r.etag, v.modified = r.modified, v.digest = r.digest) AS same,
      row_number() OVER (PARTITION BY v.page_id ORDER BY r.t0 DESC, 'r' || r.page_id DESC) AS i FROM v LEFT JOIN r ON r.target_url = v.target_url AND r.t0 < v.later),
    s AS (SELECT *, CASE WHEN rp IS NULL THEN 'no_earlier_response' WHEN same IS NULL THEN 'unvalidated' WHEN same THEN 'resolved' ELSE 'validator_mismatch' END AS status FROM j WHERE i = 1)
    SELECT 'v' || page_id AS record_id, target_url, later AS captured_at, status, CASE WHEN status IN ('resolved', 'unvalidated') THEN 'r' || rp END AS response_id,
      CASE WHEN status IN ('resolved', 'unvalidated') THEN later - rat END AS age_s,
      'cache-control: max-age=' || ((page_id % 5) * 60) || CASE WHEN status = 'resolved' THEN chr(10) || 'content-length: ' || rsize || chr(10) || 'content-type: text/html' ELSE chr(10) || 'content-length: 0' END
        || chr(10) || 'date: ' || later || CASE WHEN status = 'resolved' THEN chr(10) || 'etag: ' || rtag ELSE '' END || chr(10) || 'x-cache: HIT' AS headers FROM s"""
