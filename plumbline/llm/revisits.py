"""Resolving not-modified revisit records of web archives: an as-of join by canonical URL to the latest earlier full response.

Captures are dealt by ranges of URL and time, so a URL with very many captures is spread over several parts. A window carries the latest
response along a URL's captures of one part. What reaches over the end of a part is one row for each URL and part, and a window over these
few rows says what the next part begins with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import keep

# Header fields of a 304 response that replace those of the stored response.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
RESPONSE, REVISIT = "response", "revisit"

HEADERS = "array<struct<name:string,value:string>>"


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, without user, fragment, default port and trailing slashes, "/" for an empty path, query fields sorted.
    What does not look like a URL with a host stays as it is; null stays null."""
    pattern = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]+)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?"
    part = lambda i: F.regexp_extract(url, pattern, i)
    scheme, host, port, path, query = F.lower(part(1)), F.lower(part(2)), part(3), part(4), part(5)
    usual = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    place = F.regexp_replace(path, "/+$", "")
    fields = F.array_join(F.array_sort(F.split(query, "&")), "&")
    built = F.concat(
        scheme, F.lit("://"), host, F.when(usual, "").otherwise(F.concat(F.lit(":"), port)), F.when(place == "", "/").otherwise(place), F.when(query == "", "").otherwise(F.concat(F.lit("?"), fields))
    )
    return F.when(url.isNull(), None).when(host == "", url).otherwise(built)


def _same_validators() -> Column:
    """True or false where the revisit and the response have a validator in common, else null. Entity tags come first and compare weakly."""
    strong = lambda tag: F.regexp_replace(F.trim(tag), "^W/", "")
    tags = strong(F.col("etag")) == strong(F.col("before.etag"))
    return F.coalesce(tags, F.trim(F.col("last_modified")) == F.trim(F.col("before.last_modified")))


def _merged_headers() -> Column:
    """The stored fields, and instead of those of PERMITTED that the revisit has too, the revisit's."""
    lower = lambda fields: F.transform(F.filter(fields, lambda h: h["name"].isNotNull()), lambda h: F.struct(F.lower(F.trim(h["name"])).alias("name"), h["value"].alias("value")))
    nothing = F.array().cast(HEADERS)
    fresh = F.filter(lower(F.coalesce("headers", nothing)), lambda h: h["name"].isin(*PERMITTED))
    stored = F.filter(lower(F.coalesce("before.headers", nothing)), lambda h: ~F.array_contains(F.transform(fresh, lambda f: f["name"]), h["name"]))
    return F.array_sort(F.concat(stored, fresh))


def resolve(captures: DataFrame) -> DataFrame:
    """A row for each revisit of captures, repeated rows included: record_id, canonical, at, status, response_id, headers.

    captures has record_id long, url string, at long (time), kind (RESPONSE or REVISIT), etag, last_modified, headers (array of name and
    value). A revisit belongs to the response of the same canonical URL that is the latest before it by (at, record_id). Only that one is
    checked: by entity tags where both have one, weakly compared; else by last_modified where both have one. status is resolved,
    validator_mismatch, no_validator or no_earlier_response; only resolved ones have a response_id and headers: the stored fields, those of
    PERMITTED replaced by the revisit's, names in lower case, sorted. A null url or time has no earlier response, and a response without time
    is nobody's. Other kinds and other columns are not used. An empty table gives no rows.
    """
    rows = captures.select(
        F.col("record_id").cast("long").alias("record_id"), canonical_url(F.col("url")).alias("canonical"), F.col("at").cast("long").alias("at"), F.lower("kind").alias("kind"),
        F.col("etag").cast("string").alias("etag"), F.col("last_modified").cast("string").alias("last_modified"), F.col("headers").cast(HEADERS).alias("headers"),
    ).where(F.col("kind").isin(RESPONSE, REVISIT))
    order = ["at", "record_id", "kind"]  # at one place a response comes before a revisit
    carried = F.struct(F.col("record_id").alias("id"), "etag", "last_modified", "headers")
    usable = (F.col("kind") == RESPONSE) & F.col("at").isNotNull() & F.col("canonical").isNotNull()
    # Written once, since the parts hold only for one dealing.
    dealt = rows.repartitionByRange("canonical", *order).select("*", F.spark_partition_id().alias("part"), F.when(usable, carried).alias("response"))
    dealt = keep(dealt, "captures")

    ends = dealt.groupBy("canonical", "part").agg(F.max_by("response", F.when(F.col("response").isNotNull(), F.struct("at", "record_id"))).alias("end"))
    earlier = Window.partitionBy("canonical").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = ends.select(F.col("canonical").alias("c"), F.col("part").alias("p"), F.last("end", ignorenulls=True).over(earlier).alias("begin"))
    above = Window.partitionBy("canonical", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("local", F.last("response", ignorenulls=True).over(above)).where(F.col("kind") == REVISIT)
    both = local.join(begins, F.col("canonical").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left")

    known = F.when(F.col("at").isNotNull() & F.col("canonical").isNotNull(), F.coalesce("local", "begin"))
    status = F.when(F.col("before").isNull(), "no_earlier_response").when(_same_validators(), "resolved").when(_same_validators().isNull(), "no_validator").otherwise("validator_mismatch")
    found = both.withColumn("before", known).withColumn("status", status)
    good = F.col("status") == "resolved"
    return found.select("record_id", "canonical", "at", "status", F.when(good, F.col("before.id")).alias("response_id"), F.when(good, _merged_headers()).alias("headers"))
