"""Resolution of WARC not-modified revisits.

A revisit record says that a page had not changed, and carries headers but no content. It resolves to the
latest full response of the same canonical URL before it, if their validators agree; the result has the
response's headers with those updated that a not-modified answer may update.

The as-of join runs in blocks of time: inside (URL, block) a running last value finds the response, and where
a block has none yet, the last one of the blocks before it does. So a URL with a third of all records is dealt
over many tasks. Blocks are cut at quantiles of the records' times, as many as the square root of the number of
records: neither a block nor the blocks of a URL grow faster than that.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers of a not-modified answer that replace those of the stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")


def canonical_url(url: Column) -> Column:
    """One form for URLs that lead to the same page: no scheme, user, default port, fragment, tracking
    parameters or closing slash; a host in lower case without www; parameters in order. Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^(?:[^/?@]*@)?([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), r"^www\d*\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]*|ref|sessionid|phpsessionid)(=|$)"))
    joined = F.array_join(F.array_sort(kept), "&")
    return F.concat(host, path, F.when(joined == "", F.lit("")).otherwise(F.concat(F.lit("?"), joined)))


def _strong(etag: Column) -> Column:
    """A validator without the mark of weakness."""
    return F.regexp_replace(F.trim(etag), "^W/", "")


def _blocks(rows: DataFrame, blocks: int | None) -> DataFrame:
    """rows with block: larger for later times, with about as many rows in each."""
    n = blocks or math.isqrt(rows.count())
    at = F.col("captured_at").cast("double").alias("at")
    cuts = []
    if n > 1:
        shares = F.array(*(F.lit(k / n) for k in range(1, n)))
        cuts = sorted(set(rows.select(F.percentile_approx(at, shares, F.lit(max(10_000, 4 * n)))).first()[0] or []))
    if not cuts:
        return rows.withColumn("block", F.lit(0))
    placed = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="at", outputCol="block").transform(rows.withColumn("at", at))
    return placed.drop("at").withColumn("block", F.col("block").cast("int"))


def resolve(records: DataFrame, blocks: int | None = None) -> DataFrame:
    """The revisits of records with what they resolve to.

    records: record_id long, kind ('response' or 'revisit'), url, captured_at long, headers map<string, string>
    with names in lower case. Columns: record_id, url_key, captured_at, response_id, status, headers.

    Earlier means a smaller captured_at; of responses at the same time the largest record_id counts as the
    latest. status: no-response (response_id and headers null), mismatch (the etags differ or, without two
    etags, the last-modified dates do; headers null), unvalidated (nothing to compare) or resolved. Records
    without kind, url or time take no part; other kinds don't either. Extra columns aren't read. A revisit doesn't see
    responses of its own time. Repeated records each take part; of equal responses it doesn't matter which is taken.
    Headers may be null or very long: they go through as they are. An empty table gives an empty result. All records
    of one URL at one and the same time are sorted in one task.
    """
    rows = records.where("kind IN ('response', 'revisit') AND url IS NOT NULL AND captured_at IS NOT NULL").select(
        "record_id", F.col("kind").alias("kind"), canonical_url(F.col("url")).alias("url_key"), "captured_at", "headers"
    )
    rows = _blocks(rows, blocks)
    answer = F.struct("captured_at", "record_id", "headers")
    full = F.when(F.col("kind") == "response", answer)
    # revisits stand before responses of the same time
    inside = Window.partitionBy("url_key", "block").orderBy("captured_at", F.col("kind") == "response", "record_id").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumn("near", F.last(full, ignorenulls=True).over(inside)).where("kind = 'revisit'")
    rank = F.struct("captured_at", "record_id")
    lasts = rows.where("kind = 'response'").groupBy("url_key", "block").agg(F.max_by(answer, rank).alias("last"))
    # a row for each URL and block that has responses or asks for earlier ones: at most `blocks` a URL
    asked = seen.where("near IS NULL").select("url_key", "block").distinct()
    steps = lasts.join(asked.withColumn("asked", F.lit(True)), ["url_key", "block"], "full")
    earlier = Window.partitionBy("url_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    far = steps.withColumn("far", F.last("last", ignorenulls=True).over(earlier)).where("asked").select("url_key", "block", "far")
    found = seen.join(far, ["url_key", "block"], "left").withColumn("answer", F.coalesce("near", "far"))

    def header(of: str, name: str) -> Column:
        return F.col(of)[name]

    tags = (header("answer.headers", "etag"), header("headers", "etag"))
    dates = (header("answer.headers", "last-modified"), header("headers", "last-modified"))
    both = lambda pair: pair[0].isNotNull() & pair[1].isNotNull()
    status = (
        F.when(F.col("answer").isNull(), "no-response")
        .when(both(tags), F.when(_strong(tags[0]) == _strong(tags[1]), "resolved").otherwise("mismatch"))
        .when(both(dates), F.when(dates[0] == dates[1], "resolved").otherwise("mismatch"))
        .otherwise("unvalidated")
    )
    permitted = F.array(*map(F.lit, PERMITTED))
    fresh = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, v: F.array_contains(permitted, k) & v.isNotNull())
    kept = F.map_filter(F.coalesce("answer.headers", F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.map_keys("fresh"), k))
    found = found.withColumns({"status": status, "fresh": fresh}).withColumn("kept", kept)
    merged = F.when(F.col("status").isin("resolved", "unvalidated"), F.map_concat("kept", "fresh"))
    return found.select("record_id", "url_key", "captured_at", F.col("answer.record_id").alias("response_id"), "status", merged.alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """WARC records from the table pages, two for each page.

    A full response with the page's URL, a minute after the page before it; and, some hours later, a
    revisit under another spelling of the URL. By the page's number, the revisit repeats the etag, has a weak
    one, an outdated one, only a date, or no validator.
    """
    page = F.col("page_id")
    etag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit("")).cast("binary")), 1, 16), F.lit('"'))
    day = F.concat(F.lit("day "), (page % 365).cast("string"))
    length = F.length(F.coalesce("html", F.lit(""))).cast("string")
    no = F.lit(None).cast("string")
    response = F.create_map(
        F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), length, F.lit("etag"), etag,
        F.lit("last-modified"), day, F.lit("date"), F.concat(F.lit("minute "), page.cast("string")), F.lit("cache-control"), F.lit("max-age=60"),
    )
    turn = page % 7
    stale = F.when(turn == 0, F.concat(F.lit("W/"), etag)).when(turn == 1, F.lit('"outdated"')).when(turn.isin(2, 3), no).otherwise(etag)
    revisit = F.map_filter(
        F.create_map(
            F.lit("date"), F.concat(F.lit("visit "), page.cast("string")), F.lit("etag"), stale, F.lit("last-modified"), F.when(turn == 2, day).otherwise(no),
            F.lit("expires"), F.lit("0"), F.lit("content-length"), F.lit("0"), F.lit("set-cookie"), F.lit("a=b"),
        ),
        lambda k, v: v.isNotNull(),
    )
    spelt = F.concat(F.regexp_replace("url", "#.*$", ""), F.when(page % 2 == 0, "#again").otherwise(""))
    both = F.array(
        F.struct((page * 2).alias("record_id"), F.lit("response").alias("kind"), F.col("url"), (page * 60).alias("captured_at"), response.alias("headers")),
        F.struct((page * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), spelt.alias("url"), (page * 60 + 60 * (page % 5000) - 30).alias("captured_at"), revisit.alias("headers")),
    )
    return pages.select(F.explode(both).alias("r")).select("r.*")


def header_lines(headers: Column) -> Column:
    """Sorted 'name: value' lines."""
    lines = F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.array_join(F.array_sort(lines), "\n")


#: The same rows for DuckDB, as the query op5 has them.
ORACLE = r"""
WITH p AS (
  SELECT page_id, url, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS etag, 'day ' || (page_id % 365) AS day,
    length(coalesce(html, '')) AS n FROM pages
), r AS (
  SELECT page_id * 2 AS record_id, 'response' AS kind, url, page_id * 60 AS captured_at, etag, day AS modified,
    'minute ' || page_id AS date, n::VARCHAR AS content_length FROM p
  UNION ALL
  SELECT page_id * 2 + 1, 'revisit', regexp_replace(url, '#.*$', '') || CASE WHEN page_id % 2 = 0 THEN '#again' ELSE '' END,
    page_id * 60 + 60 * (page_id % 5000) - 30,
    CASE WHEN page_id % 7 = 0 THEN 'W/' || etag WHEN page_id % 7 = 1 THEN '"outdated"' WHEN page_id % 7 IN (2, 3) THEN NULL ELSE etag END,
    CASE WHEN page_id % 7 = 2 THEN day END, 'visit ' || page_id, '0' FROM p
), b AS (
  SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM r
), k AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^(?:[^/?@]*@)?([^/?]*)', 1)), ':(80|443)$', ''), '^www\d*\.', '')
    || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS stem,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]*|ref|sessionid|phpsessionid)(=|$)'))), '&') AS params FROM b
), c AS (
  SELECT *, stem || CASE WHEN params = '' THEN '' ELSE '?' || params END AS url_key FROM k
), j AS (
  SELECT v.record_id, v.url_key, v.captured_at, v.etag, v.modified, v.date, f.record_id AS response_id, f.etag AS old_etag, f.modified AS old_modified,
    f.content_length AS old_length,
    row_number() OVER (PARTITION BY v.record_id ORDER BY f.captured_at DESC NULLS LAST, f.record_id DESC) AS n
  FROM c v LEFT JOIN c f ON f.kind = 'response' AND f.url_key = v.url_key AND f.captured_at < v.captured_at
  WHERE v.kind = 'revisit'
), s AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'no-response'
    WHEN etag IS NOT NULL AND old_etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = old_etag THEN 'resolved' ELSE 'mismatch' END
    WHEN modified IS NOT NULL AND old_modified IS NOT NULL THEN CASE WHEN modified = old_modified THEN 'resolved' ELSE 'mismatch' END
    ELSE 'unvalidated' END AS status
  FROM j WHERE n = 1
)
SELECT record_id, url_key, captured_at, response_id, status,
  CASE WHEN status IN ('resolved', 'unvalidated') THEN
    array_to_string(list_sort(['cache-control: max-age=60', 'content-length: ' || old_length, 'content-type: text/html', 'date: ' || date,
      'etag: ' || coalesce(etag, old_etag), 'expires: 0', 'last-modified: ' || old_modified]), chr(10)) END AS headers
FROM s
"""
