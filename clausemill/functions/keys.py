"""Identity: hashes, addresses, clocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(body: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(body.cast("binary"), 256))


def document_id(iso: Column, body: Column) -> Column:
    return F.concat(F.lower(iso), F.lit(":"), F.substring(F.sha2(body.cast("binary"), 256), 1, 16))


def composite_key(*parts: Column) -> Column:
    """One hash of several parts, which can't run into each other."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(p, F.lit("")) for p in parts]).cast("binary"), 256)


def normal_url(url: Column) -> Column:
    return F.regexp_replace(F.trim(url), r"(?<!:)/{2,}", "/")


def canonical_url(url: Column) -> Column:
    """Scheme, host and path in lower case, without query, fragment and the last slash."""
    return F.lower(F.regexp_replace(F.regexp_replace(normal_url(url), r"[?#].*$", ""), "/$", ""))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]+)", 1))


def url_rank(url: Column) -> Column:
    """The less, the better a representative: provision marks, parameters, length, then the address."""
    return F.struct(
        F.when(url.rlike(r"(?i)(provids|pr[0-9]+-|#pr)"), 1).otherwise(0).alias("provision"),
        (F.length(url) - F.length(F.translate(url, "?#&", ""))).alias("parameters"),
        F.length(url).alias("length"),
        url.alias("url"),
    )


def julian_timestamp(day: Column) -> Column:
    return F.timestamp_seconds((day - 2440587.5) * 86400.0)


def still_valid(now_s: Column, made_s: Column, ttl_hours: Column, replaying: Column) -> Column:
    return F.when(replaying, True).otherwise(now_s - made_s < ttl_hours * 3600)


def odata_literal(value: Column) -> Column:
    return F.replace(value, F.lit("'"), F.lit("''"))
