"""Not-modified revisits of a web archive: each 304 record takes the latest earlier full response of its canonical URL.

Records: record_id, url, ts (any ordered type), status, etag, last_modified, headers (map of lower-case names), payload. Full
responses are those of status 200; revisits those of status 304. The as-of join is a last-value scan in (URL, ts, record_id)
order over *range* partitions, so one URL with a third of all records is cut over many tasks; what such a URL carries from one
part into the next is one row a part.

Validators: if a revisit has an ETag, it must equal the response's (weak comparison, RFC 9110 8.8.3.2); else, if it
has Last-Modified, that must; else nothing is checked. On a match the response's headers are kept and only
those a 304 may send (RFC 9110 15.4.5, and Last-Modified) replace them. ``outcome``: matched, unchecked,
mismatch, or missing (no earlier full response; also for a null URL or ts). The latest response decides: an older one that would match is not tried.

Null or empty URLs resolve to nothing; null validators are absent ones; null headers are none; a null payload has a null
digest. Equal times are ordered by record_id; repeated rows are resolved each for itself. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qapulse.llm.shared import stash

#: Headers of a 304 response that update the stored ones. Fixed values of RFC 9110.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: Query parameters that do not name a resource.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|sid|sessionid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without user, default port and ``www``; path without end slashes; sorted query without
    tracking parameters. Scheme and fragment are dropped."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "(?s)#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^[^/?]*", 0))
    for pattern in ("^.*@", ":(80|443)$", r"^www[0-9]*\."):
        host = F.regexp_replace(host, pattern, "")
    path = F.regexp_replace(F.regexp_extract(rest, "(?s)^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.split(F.regexp_extract(rest, r"(?s)\?(.*)$", 1), "&")
    query = F.array_join(F.array_sort(F.filter(query, lambda x: (x != "") & ~x.rlike(TRACKING))), "&")
    return F.nullif(F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")), F.lit(""))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """record_id, canonical_url, outcome, full_id, payload_sha256 and headers (merged) of every revisit."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    slim = records.select(
        "record_id", canonical_url(F.col("url")).alias("canonical_url"), "ts", (F.col("status") == 200).alias("is_full"), "etag", "last_modified",
        F.coalesce("headers", empty).alias("headers"), F.when(F.col("status") == 200, F.sha2("payload", 256)).alias("payload_sha256"),
    ).where("status in (200, 304)")
    # Only the digest of a payload is shuffled; the rows are written once, in their order, with the number of their part.
    order = ["canonical_url", "ts", "record_id"]
    placed = stash(
        slim.where("canonical_url is not null and ts is not null").repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "records"
    )
    full = F.when(F.col("is_full"), F.struct("record_id", "etag", "last_modified", "headers", "payload_sha256"))
    before = Window.partitionBy("canonical_url", "part").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = placed.withColumn("found", F.last(full, ignorenulls=True).over(before)).where("not is_full")

    # A part shares at most its first and last URL with others, so this has at most two rows a part.
    ends = placed.groupBy("canonical_url", "part").agg(F.max_by(full, F.when(F.col("is_full"), F.struct("ts", "record_id"))).alias("last"))
    cut = Window.partitionBy("canonical_url")
    carried = ends.withColumn("low", F.min("part").over(cut)).withColumn("high", F.max("part").over(cut)).where("low != high")
    carried = carried.select(
        "canonical_url", "part", F.last("last", ignorenulls=True).over(cut.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried")
    ).where("carried is not null")
    seen = seen.join(F.broadcast(carried), ["canonical_url", "part"], "left").withColumn("found", F.coalesce("found", "carried"))

    def weak(tag: Column) -> Column:
        return F.regexp_replace(tag, "^W/", "")

    outcome = (
        F.when(F.col("found").isNull(), "missing")
        .when(F.col("etag").isNotNull(), F.when(weak(F.col("etag")).eqNullSafe(weak(F.col("found.etag"))), "matched").otherwise("mismatch"))
        .when(F.col("last_modified").isNotNull(), F.when(F.col("last_modified").eqNullSafe(F.col("found.last_modified")), "matched").otherwise("mismatch"))
        .otherwise("unchecked")
    )
    held = F.col("outcome").isin("matched", "unchecked")
    sent = F.map_filter("headers", lambda k, _: k.isin(PERMITTED))
    merged = F.map_concat(F.map_filter("found.headers", lambda k, _: ~F.map_contains_key(sent, k)), sent)
    resolved = seen.withColumn("outcome", outcome).select(
        "record_id", "canonical_url", "outcome", F.when(held, F.col("found.record_id")).alias("full_id"),
        F.when(held, F.col("found.payload_sha256")).alias("payload_sha256"), F.when(held, merged).otherwise(F.col("headers")).alias("headers"),
    )
    unplaced = slim.where("not is_full and (canonical_url is null or ts is null)").select(
        "record_id", "canonical_url", F.lit("missing").alias("outcome"), F.lit(None).cast(slim.schema["record_id"].dataType).alias("full_id"),
        F.lit(None).cast("string").alias("payload_sha256"), "headers",
    )
    return resolved.unionByName(unplaced)


def archive_records(pages: DataFrame) -> DataFrame:
    """An archive derived from the pages: each is fetched in full once and revisited twice, once under another spelling
    of its URL; ids, validators and headers follow from its id and content."""
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    day = F.concat(F.lit("day "), (F.col("page_id") % 1000).cast("string"))

    def record(offset: int, ts: Column, status: int, url: Column, etag: Column, modified: Column, headers: dict[str, Column], payload: Column) -> DataFrame:
        pairs = [part for name, value in headers.items() for part in (F.lit(name), value)]
        return pages.select(
            (F.col("page_id") * 3 + offset).alias("record_id"), url.alias("url"), ts.alias("ts"), F.lit(status).alias("status"),
            etag.alias("etag"), modified.alias("last_modified"), F.create_map(*pairs).alias("headers"), payload.alias("payload"),
        )

    none, page = F.lit(None).cast("string"), F.col("page_id")
    response = record(
        0, page * 10, 200, F.col("url"), F.when(page % 5 != 0, tag), F.when(page % 3 != 0, day),
        {"content-type": F.lit("text/html"), "date": (page * 10).cast("string"), "server": F.lit("one"), "content-length": F.length("html").cast("string")},
        F.col("html"),
    )
    later = record(
        1, page * 10 + 5000, 304, F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again")),
        F.when(page % 7 == 0, F.lit('"other"')).when(page % 5 != 0, F.concat(F.lit("W/"), tag)), F.when(page % 3 != 0, day),
        {"date": (page * 10 + 5000).cast("string"), "expires": F.lit("never"), "content-length": F.lit("0"), "server": F.lit("two")}, none,
    )
    early = record(2, page * 10 - 1, 304, F.col("url"), none, F.when(page % 2 == 0, day), {"date": F.lit("early")}, none)
    return response.unionByName(later).unionByName(early)


def op3_revisits(spark, sf_dir: str) -> DataFrame:
    found = resolve_revisits(archive_records(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    listed = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), ";")
    return found.select("record_id", "canonical_url", "outcome", "full_id", "payload_sha256", listed.alias("headers"))


_CANONICAL = r"""
    nullif(concat(
        regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*', 0)), '^.*@', ''), ':(80|443)$', ''), '^www[0-9]*\.', ''),
        regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', ''),
        CASE WHEN query = '' THEN '' ELSE '?' || query END), '')
"""

ORACLE = rf"""
WITH responses AS (
    SELECT page_id * 3 AS record_id, url, page_id * 10 AS ts, 200 AS status,
        CASE WHEN page_id % 5 <> 0 THEN '"' || substr(md5(html), 1, 16) || '"' END AS etag,
        CASE WHEN page_id % 3 <> 0 THEN 'day ' || (page_id % 1000) END AS last_modified,
        sha256(html) AS digest, page_id, length(html) AS size
    FROM pages
), records AS (
    SELECT *, NULL AS sent FROM responses
    UNION ALL
    SELECT page_id * 3 + 1, regexp_replace(url, '#.*$', '') || '#again', page_id * 10 + 5000, 304,
        CASE WHEN page_id % 7 = 0 THEN '"other"' ELSE 'W/' || etag END, last_modified, NULL, page_id, NULL, 'later'
    FROM responses
    UNION ALL
    SELECT page_id * 3 + 2, url, page_id * 10 - 1, 304, NULL, CASE WHEN page_id % 2 = 0 THEN 'day ' || (page_id % 1000) END, NULL, page_id, NULL, 'early'
    FROM responses
), parts AS (
    SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM records
), queried AS (
    SELECT *, array_to_string(list_sort([x FOR x IN string_split(regexp_extract(rest, '\?(.*)$', 1), '&')
        IF x <> '' AND NOT regexp_matches(x, '{TRACKING}')]), '&') AS query
    FROM parts
), named AS (
    SELECT *, {_CANONICAL} AS canonical_url FROM queried
), joined AS (
    SELECT v.*, f.record_id AS f_id, f.page_id AS f_page, f.etag AS f_etag, f.last_modified AS f_modified, f.digest AS f_digest, f.size AS f_size, f.ts AS f_ts
    FROM (SELECT * FROM named WHERE status = 304) v
    LEFT JOIN (SELECT * FROM named WHERE status = 200) f ON f.canonical_url = v.canonical_url AND (f.ts, f.record_id) < (v.ts, v.record_id)
    QUALIFY row_number() OVER (PARTITION BY v.record_id ORDER BY f.ts DESC NULLS LAST, f.record_id DESC NULLS LAST) = 1
), judged AS (
    SELECT *, CASE WHEN f_id IS NULL THEN 'missing'
        WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') IS NOT DISTINCT FROM f_etag THEN 'matched' ELSE 'mismatch' END
        WHEN last_modified IS NOT NULL THEN CASE WHEN last_modified IS NOT DISTINCT FROM f_modified THEN 'matched' ELSE 'mismatch' END
        ELSE 'unchecked' END AS outcome
    FROM joined
)
SELECT record_id, canonical_url, outcome,
    CASE WHEN outcome IN ('matched', 'unchecked') THEN f_id END AS full_id,
    CASE WHEN outcome IN ('matched', 'unchecked') THEN f_digest END AS payload_sha256,
    CASE WHEN outcome IN ('matched', 'unchecked') AND sent = 'later'
            THEN 'content-length=' || f_size || ';content-type=text/html;date=' || ts || ';expires=never;server=one'
        WHEN outcome IN ('matched', 'unchecked') THEN 'content-length=' || f_size || ';content-type=text/html;date=early;server=one'
        WHEN sent = 'later' THEN 'content-length=0;date=' || ts || ';expires=never;server=two'
        ELSE 'date=early' END AS headers
FROM judged
"""
