"""Coverage of ingestion runs: per agency, per platform and overall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TARGET_PERCENT = 60.0


def coverage_rows(agencies: DataFrame, feeds: DataFrame, docs: DataFrame, inserted: DataFrame) -> DataFrame:
    """Per agency: documents fetched and inserted, the span of their dates, and the error that
    kept it from being fetched (first active feed only)."""
    first = feeds.filter("is_active").groupBy("agency_id").agg(F.min_by("url", "feed_id").alias("url"))
    per = docs.groupBy("agency_id").agg(F.count("*").alias("docs_fetched"), F.min("published_at").alias("date_min"), F.max("published_at").alias("date_max"))
    rows = agencies.join(first, "agency_id", "left").join(per, "agency_id", "left").join(inserted, "agency_id", "left")
    error = F.when(F.col("url").isNull() | ~F.col("url").rlike("^https?://"), "no_url").when(F.coalesce("platform_type", F.lit("unknown")) == "crimemapping", "no_parser: crimemapping")
    zero = F.lit(0).cast("long")
    return rows.select("agency_id", "platform_type", F.coalesce("docs_fetched", zero).alias("docs_fetched"), F.coalesce("inserted", zero).alias("docs_inserted"), "date_min", "date_max", error.alias("error"))


def by_platform(rows: DataFrame) -> DataFrame:
    e = F.col("error")
    return rows.groupBy(F.coalesce("platform_type", F.lit("unknown")).alias("platform")).agg(
        F.count("*").alias("total"), F.count_if(e.isNull()).alias("ok"), F.count_if(e == "no_url").alias("no_url"), F.count_if(e.contains("no_parser")).alias("no_parser"),
        F.count_if(e.isNotNull() & (e != "no_url") & ~e.contains("no_parser")).alias("failed"),
    )


def metric(rows: DataFrame, registry_size: int, target: float = TARGET_PERCENT) -> DataFrame:
    """Share of agencies without error, against the target, and of the whole registry."""
    got = rows.agg(F.count("*").alias("agencies"), F.count_if(F.col("error").isNull()).alias("covered"), F.count_if(F.col("docs_fetched") > 0).alias("with_data"))
    percent = F.round(F.col("covered") * 100.0 / F.col("agencies"), 4)
    return got.select("*", (F.col("agencies") - F.col("covered")).alias("blocked"), percent.alias("percent"), F.round(F.col("covered") * 100.0 / registry_size, 4).alias("registry_percent"), F.when(percent >= target, "PASS").otherwise("FAIL").alias("verdict"))


def summary_top(docs: DataFrame, n: int = 20) -> DataFrame:
    return docs.groupBy("agency_id").agg(F.count("*").alias("n"), F.min("published_at").alias("first_date"), F.max("published_at").alias("last_date")).orderBy(F.desc("n"), "agency_id").limit(n)
