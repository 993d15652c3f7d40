"""Completeness and freshness of evidence, and the source rows of an envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sundown.functions.checks import differs

# Limitations of a paged inventory, and which of them make it partial.
PAGE_LIMITATIONS = {
    "CACHE_NOT_EXPOSED": False,
    "CACHE_USED": True,
    "CONSUMER_REPEATED": True,
    "EMPTY_PAGE_BEFORE_TOTAL": True,
    "MARKED_PARTIAL": True,
    "PAGE_FAILED": True,
    "PARTIAL_NOT_EXPOSED": False,
    "TOTAL_CHANGED": True,
    "TOTAL_NOT_REACHED": True,
}
NO_UPDATE_TIME = "UPDATE_TIME_NOT_EXPOSED"
TOO_OLD = "UPDATE_TIME_TOO_OLD"


def _any(condition: Column) -> Column:
    return F.coalesce(F.max(condition), F.lit(False))


def page_audit(campaigns: DataFrame, pages: DataFrame, results: DataFrame) -> DataFrame:
    """Whether the pages of each campaign add up to a complete inventory.

    ``pages`` hold ``(campaign_id, bucket, offset, total, returned, is_partial, cached,
    failed)``; ``results`` hold the listed URNs, where a result without one still moved
    the offset. Pages and URNs are reduced by partial aggregation; no page order is
    rebuilt, because every rule compares with the first page of the bucket.
    """
    good = ~F.col("failed")
    total = F.when(good, F.greatest(F.coalesce("total", F.lit(0)), F.lit(0)))
    per_bucket = pages.groupBy("campaign_id", "bucket").agg(
        F.coalesce(F.min_by(total, F.when(good, F.col("offset"))), F.lit(0)).alias("first_total"),
        (F.coalesce(F.min(total), F.lit(0)) != F.coalesce(F.max(total), F.lit(0))).alias("changed"),
        F.min(F.when(good & (F.col("returned") == 0), F.col("offset"))).alias("empty_at"),
        _any(good & F.col("cached").eqNullSafe(F.lit(True))).alias("cache_used"),
        _any(good & F.col("cached").isNull()).alias("cache_hidden"),
        _any(good & F.col("is_partial").eqNullSafe(F.lit(True))).alias("partial"),
        _any(good & F.col("is_partial").isNull()).alias("partial_hidden"),
        _any(F.col("failed")).alias("failed"),
        F.count_if(good).alias("pages"),
    )
    per_campaign = per_bucket.groupBy("campaign_id").agg(
        F.sum("first_total").cast("bigint").alias("reported_total"),
        F.sum("pages").cast("bigint").alias("pages"),
        *[F.max(c).alias(c) for c in ("changed", "cache_used", "cache_hidden", "partial", "partial_hidden", "failed")],
        _any(F.col("empty_at") < F.col("first_total")).alias("empty_page"),
    )
    per_urn = (
        results.filter("urn IS NOT NULL").groupBy("campaign_id", "urn").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("campaign_id").agg(F.count(F.lit(1)).alias("returned_total"), F.max(F.col("n") > 1).alias("repeated"))
    )
    joined = campaigns.select("campaign_id").join(per_campaign, "campaign_id", "left").join(per_urn, "campaign_id", "left")
    no = F.lit(False)
    found = {
        "CACHE_NOT_EXPOSED": F.coalesce("cache_hidden", no),
        "CACHE_USED": F.coalesce("cache_used", no),
        "CONSUMER_REPEATED": F.coalesce("repeated", no),
        "EMPTY_PAGE_BEFORE_TOTAL": F.coalesce("empty_page", no),
        "MARKED_PARTIAL": F.coalesce("partial", no),
        # A campaign without any page has proven nothing.
        "PAGE_FAILED": F.coalesce("failed", F.lit(True)),
        "PARTIAL_NOT_EXPOSED": F.coalesce("partial_hidden", no),
        "TOTAL_CHANGED": F.coalesce("changed", no),
        "TOTAL_NOT_REACHED": F.coalesce("returned_total", F.lit(0)) != F.coalesce("reported_total", F.lit(0)),
    }
    incomplete = no
    for name, partial in PAGE_LIMITATIONS.items():
        if partial:
            incomplete = incomplete | found[name]
    zero = F.lit(0).cast("bigint")
    return joined.select(
        "campaign_id",
        F.when(incomplete, "PARTIAL").otherwise("COMPLETE").alias("status"),
        F.coalesce("pages", zero).alias("pages"),
        F.coalesce("reported_total", zero).alias("reported_total"),
        F.coalesce("returned_total", zero).alias("returned_total"),
        F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in found.items()]))).alias("limitations"),
    )


def source_freshness(sources: DataFrame, observed_at: Column) -> DataFrame:
    """STALE when the update time is older than allowed; an unknown time is only a limitation."""
    updated = F.col("source_updated_at")
    age = F.unix_seconds(observed_at) - F.unix_seconds(updated)
    old = F.coalesce(age > F.col("maximum_age_seconds"), F.lit(False))
    added = F.array_compact(F.array(F.when(updated.isNull(), F.lit(NO_UPDATE_TIME)), F.when(old, F.lit(TOO_OLD))))
    return sources.withColumn("status", F.when(old, F.lit("STALE")).otherwise(F.col("status"))).withColumn(
        "limitations", F.array_sort(F.array_distinct(F.concat("limitations", added)))
    )


def build_envelope(audit: DataFrame, meta: DataFrame, observed_at: Column) -> DataFrame:
    """One source row per campaign: status, scope, totals, freshness, permissions, limitations."""
    rows = audit.join(meta, "campaign_id").select(
        "campaign_id",
        "source_id",
        "required",
        "status",
        "identity",
        F.struct(F.lit("downstream").alias("direction"), "max_hops", "filters", "pages", "reported_total", "returned_total").alias("scope"),
        F.col("source_updated_at"),
        "maximum_age_seconds",
        "principal",
        "limitations",
    )
    return source_freshness(rows, observed_at).withColumn("observed_at", observed_at)


def merge_sources(base: DataFrame, update: DataFrame) -> DataFrame:
    """Sources of the base envelope with those of the update put in their place."""
    columns = [c for c in base.columns if c not in ("campaign_id", "source_id")]
    both = base.withColumn("_r", F.lit(0)).unionByName(update.select(*base.columns).withColumn("_r", F.lit(1)))
    return (
        both.groupBy("campaign_id", "source_id")
        .agg(F.max_by(F.struct(*columns), "_r").alias("_s"))
        .select("campaign_id", "source_id", "_s.*")
    )


def envelope_header(merged: DataFrame) -> DataFrame:
    """Capture time and size of each merged envelope."""
    return merged.groupBy("campaign_id").agg(
        F.max("captured_at").alias("captured_at"),
        F.count(F.lit(1)).alias("sources"),
        F.count_if(F.col("required") & differs("status", F.lit("COMPLETE"))).alias("incomplete_sources"),
    )
