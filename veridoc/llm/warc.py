"""Not-modified revisit resolution: an as-of join of revisit records to the latest earlier full response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridoc.llm.common import materialize, tidied

#: Headers a 304 may carry that replace those of the stored response (fixed values, in lower case).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """Scheme, leading www., default port, fragment, query parameters for tracking and a trailing slash don't tell pages apart.

    The host is lower-cased, the path isn't. A null URL stays null and an URL without a host is kept as it is.
    """
    bare = F.regexp_replace(F.btrim(url), r"#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    rest = F.regexp_replace(bare, r"^[^/?]*", "")
    path = F.regexp_extract(rest, r"^([^?]*)", 1)
    query = F.regexp_replace(F.regexp_extract(rest, r"\?(.*)$", 1), r"(^|&)utm_[^&]*", "")
    query = F.regexp_replace(query, r"^&+", "")
    path = F.regexp_replace(path, r"/+$", "")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def folded(headers: Column) -> Column:
    """Headers under lower-cased names; of names that differ in case only, the one that sorts first wins."""
    entries = F.array_sort(F.map_entries(headers))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.filter(entries, lambda e: F.lower(e["key"]) == n)[0]["value"]))


@tidied
def resolve_revisits(records: DataFrame) -> DataFrame:
    """Resolve revisit records against full responses of the same canonical URL.

    records: record_id long, url string, at long (capture time), kind string ('response', 'revisit', others are left
    out), status int, headers map<string,string> and any other columns, which are ignored. A full response has kind
    'response' and a status from 200 to 299. Per revisit: record_id, canonical_url, at, response_id and response_at of
    the latest full response strictly earlier by (at, record_id), outcome and headers, the response's headers with
    the permitted ones of the revisit put over them; header names are lower-cased, and of names that differ in case
    only the one that sorts first by code point wins.

    outcome: 'resolved' if a validator (etag first, weak marks ignored; else last-modified) is there and agrees,
    'unvalidated' if the revisit and the response share no validator, 'changed' if it differs, 'orphan' if there is no
    earlier response. Headers are null unless resolved or unvalidated. Records with a null URL or time match nothing:
    such revisits are orphans. Ties in time go by record_id; records repeated in full each give a row. An empty table
    gives an empty result.

    The timeline of all records is cut into slices of equal numbers of records, by rank of time, so a URL that holds a
    third of all captures is spread over many tasks: the last response of each slice is carried over the slices, one
    row each, and within a slice from record to record. The records, ranged by time, are written once.
    """
    spark = records.sparkSession
    rows = records.where(F.col("kind").isin("response", "revisit")).select("record_id", canonical_url(F.col("url")).alias("canonical_url"), F.col("at").cast("long").alias("at"), "kind", "status", folded(F.col("headers")).alias("headers"))
    full = (F.col("kind") == "response") & F.col("status").between(200, 299) & F.col("at").isNotNull() & F.col("canonical_url").isNotNull()
    rows = rows.where((F.col("kind") == "revisit") | full).withColumn("full", F.coalesce(full, F.lit(False)))
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(rows.repartitionByRange(slices, "at", "record_id").withColumn("slice", F.spark_partition_id()))
    known = F.struct("at", "record_id")
    mine = F.when(F.col("full"), F.struct(F.col("at").alias("at"), F.col("record_id").alias("id"), F.col("headers").alias("headers")))
    last = rows.where("full").groupBy("canonical_url", "slice").agg(F.max_by(F.struct(F.col("at").alias("at"), F.col("record_id").alias("id"), F.col("headers").alias("headers")), known).alias("last"))
    slices = rows.where("canonical_url is not null and slice is not null").select("canonical_url", "slice").distinct().join(last, ["canonical_url", "slice"], "left")
    over = Window.partitionBy("canonical_url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("canonical_url", "slice", F.last("last", ignorenulls=True).over(over).alias("carried"))
    inside = Window.partitionBy("canonical_url", "slice").orderBy("at", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    asof = rows.withColumn("near", F.last(mine, ignorenulls=True).over(inside)).where("kind = 'revisit'")
    asof = asof.join(slices, ["canonical_url", "slice"], "left")
    usable = F.col("canonical_url").isNotNull() & F.col("at").isNotNull()
    asof = asof.withColumn("base", F.when(usable, F.coalesce("near", "carried")))

    def validator(h: Column | str, name: str) -> Column:
        value = F.element_at(F.col(h) if isinstance(h, str) else h, name)
        return F.btrim(F.regexp_replace(value, r"^\s*W/", "")) if name == "etag" else F.btrim(value)

    checks = [(validator("headers", v), validator(F.col("base.headers"), v)) for v in ("etag", "last-modified")]
    outcome = F.when(F.col("base").isNull(), "orphan")
    for own, theirs in checks:
        outcome = outcome.when(own.isNotNull() & theirs.isNotNull(), F.when(own == theirs, "resolved").otherwise("changed"))
    asof = asof.withColumn("outcome", outcome.otherwise("unvalidated"))
    allowed = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*PERMITTED))
    theirs = F.map_filter(F.coalesce(F.col("base.headers"), F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(allowed, k))
    merged = F.when(F.col("outcome").isin("resolved", "unvalidated"), F.map_concat(theirs, allowed))
    return asof.select("record_id", "canonical_url", "at", F.col("base.id").alias("response_id"), F.col("base.at").alias("response_at"), "outcome", merged.alias("headers"))


def page_captures(pages: DataFrame, lag: int = 1000) -> DataFrame:
    """The capture records of a table of pages (page_id, url, html): every page is answered in full at the time
    page_id and asked for again `lag` later, when a server that still has that page says so by its validator."""
    etag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    length = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    response = pages.select((F.col("page_id") * 2).alias("record_id"), "url", F.col("page_id").cast("long").alias("at"), F.lit("response").alias("kind"), F.lit(200).alias("status"), F.create_map(F.lit("ETag"), etag, F.lit("Content-Length"), length, F.lit("Content-Type"), F.lit("text/html")).alias("headers"))
    revisit = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), "url", (F.col("page_id") + lag).cast("long").alias("at"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), F.create_map(F.lit("ETag"), F.concat(F.lit("W/"), etag), F.lit("Date"), F.col("page_id").cast("string"), F.lit("Content-Length"), F.lit("0")).alias("headers"))
    return response.union(revisit)
