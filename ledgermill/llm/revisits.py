"""WARC not-modified revisits: an as-of join by canonical URL to the latest earlier full response.

Captures are first reduced to one point for each URL and time, so copies of a URL meet only as partial aggregates. Points are
ordered within (URL, stretch of time); what a stretch ends with is carried on over at most ``stretches`` rows a URL. A hot URL is
therefore spread over as many tasks as there are stretches, and its rows come back by a join that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Header fields that a not-modified response may update (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """Without scheme, fragment, default port and utm_ parameters; host in lower case; an empty path is ``/``. Null stays null."""
    bare = F.regexp_replace(F.substring_index(url, "#", 1), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_extract(bare, "^[^/?]*", 0)
    rest = F.substr(bare, F.length(host) + 1)
    path = F.substring_index(rest, "?", 1)
    query = F.ltrim(F.regexp_replace(F.concat(F.lit("&"), F.substr(rest, F.length(path) + 2)), "&utm_[^&]*", ""), F.lit("&"))
    return F.concat(
        F.regexp_replace(F.lower(host), ":(80|443)$", ""),
        F.when(path == "", "/").otherwise(path),
        F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
    )


def _lowered(headers: Column) -> Column:
    """Header names in lower case; of names that then clash the first stays. Null becomes empty."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    named = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    return F.map_from_entries(F.filter(named, lambda e, i: F.array_position(F.transform(named, lambda x: x["key"]), e["key"]) == i + 1))


def _outcome(own: Column, kept: Column) -> Column:
    """Entity tags decide where both have one (weak comparison), else dates of modification."""
    tag = lambda h: F.regexp_replace(h["etag"], "^W/", "")
    by_tag, by_date = tag(own) == tag(kept), own["last-modified"] == kept["last-modified"]
    same = F.coalesce(by_tag, by_date)
    return F.when(kept.isNull(), "no_original").when(same.isNull(), "unvalidated").when(same, "resolved").otherwise("mismatch")


def resolve_revisits(captures: DataFrame, permitted: tuple[str, ...] = PERMITTED, stretches: int = 256) -> DataFrame:
    """For each row of ``captures`` (record_id long, url string, ts long, full boolean, headers map of strings) one row: record_id,
    url_key, full, outcome, original_id and headers.

    A row that isn't a full response is a revisit. Its original is the full response of the same canonical URL with the greatest
    earlier time (of equal times: the greatest record_id). The outcome is ``resolved`` where validators agree (headers: the original's,
    updated by the permitted ones of the revisit), ``mismatch`` where they differ, ``unvalidated`` where the two share none and
    ``no_original`` where there is no earlier response; a full response is ``response``. Otherwise headers are the row's own.
    Null url or time: never an original, and has none. Null ``full`` counts as a revisit, null headers as none. Rows with equal ids are
    answered one by one. Other columns are ignored; an empty table gives no rows.
    """
    rows = captures.select(
        F.col("record_id").cast("long").alias("record_id"), canonical_url(F.col("url")).alias("url_key"), F.col("ts").cast("long").alias("ts"),
        F.coalesce(F.col("full"), F.lit(False)).alias("full"), _lowered(F.col("headers")).alias("own"),
    )
    cuts = captures.agg(F.percentile_approx(F.col("ts").cast("long"), [i / stretches for i in range(1, stretches)], 10_000)).first()[0] or []
    edges = F.lit(sorted(set(cuts))).cast("array<long>")
    points = (
        rows.filter("url_key is not null and ts is not null")
        .groupBy("url_key", "ts")
        .agg(F.max_by(F.when(F.col("full"), F.struct("record_id", "own")), F.when(F.col("full"), F.coalesce("record_id", F.lit(-(1 << 63))))).alias("here"))
        .withColumn("stretch", F.size(F.filter(edges, lambda x: x < F.col("ts"))))
    )
    within = Window.partitionBy("url_key", "stretch").orderBy("ts")
    before = Window.partitionBy("url_key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = points.groupBy("url_key", "stretch").agg(F.max_by("here", F.when(F.col("here").isNotNull(), F.col("ts"))).alias("here")).select("url_key", "stretch", F.last("here", ignorenulls=True).over(before).alias("carried"))
    latest = (
        points.withColumn("latest", F.last("here", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, -1)))
        .join(carried, ["url_key", "stretch"], "left")
        .select("url_key", "ts", F.coalesce("latest", "carried").alias("original"))
    )
    found = rows.join(latest, ["url_key", "ts"], "left")
    outcome = F.when(F.col("full"), "response").otherwise(_outcome(F.col("own"), F.col("original.own")))
    updates = F.map_filter("own", lambda k, _: k.isin(*permitted))
    merged = F.map_zip_with("original.own", updates, lambda _, a, b: F.coalesce(b, a))
    return found.withColumn("outcome", outcome).select(
        "record_id", "url_key", "full", "outcome",
        F.when(~F.col("full"), F.col("original.record_id")).alias("original_id"),
        F.when(F.col("outcome") == "resolved", merged).otherwise(F.col("own")).alias("headers"),
    )


def recrawled(pages: DataFrame) -> DataFrame:
    """Captures of crawls of all pages. Of every page: a not-modified answer before any response, a full response, for half of the pages (by a digest of the id) a second one with another tag, and
    later two not-modified answers, one with a tag (that of either response or another), or only a date, and one without validators."""
    page, tag = F.col("page_id"), F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    digest = F.md5(page.cast("string"))
    later = page + 10_000
    day = lambda n: F.concat(F.lit("day "), n.cast("string"))

    def headers(date: Column, etag: Column, modified: Column | None, full: bool) -> Column:
        first = F.struct(F.lit("Content-Type" if full else "Content-Length").alias("k"), F.lit("text/html" if full else "0").alias("v"))
        more = [("Date", day(date)), ("ETag", etag), ("Last-Modified", F.lit(None).cast("string") if modified is None else day(modified))]
        return F.map_from_entries(F.filter(F.array(first, *[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in more]), lambda x: x["v"].isNotNull()))

    tags = F.when(digest < "3", F.lit('"changed"')).when(digest < "6", F.lit(None).cast("string")).when(digest >= "c", F.lit('"second"')).otherwise(F.concat(F.lit("W/"), tag))
    none, second = F.lit(None).cast("string"), F.lit('"second"')
    captures = [
        (2 * page, False, headers(page, none, page - 1, False)), (2 * page + 1, True, headers(page, tag, page - 1, True)), (F.when(digest >= "8", 2 * page + 3), True, headers(page + 1, second, page, True)),
        (2 * later + 1, False, headers(later, tags, page - 1, False)), (2 * later + 2, False, headers(later + 1, none, None, False)),
    ]
    rows = F.array(*[F.struct((5 * page + i).alias("record_id"), ts.alias("ts"), F.lit(full).alias("full"), h.alias("headers")) for i, (ts, full, h) in enumerate(captures)])
    return pages.select("url", F.explode(F.filter(rows, lambda c: c["ts"].isNotNull())).alias("c")).select("c.record_id", "url", "c.ts", "c.full", "c.headers")
