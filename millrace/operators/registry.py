"""Registry operators: filtered listings, statistics, parents with children, batch changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KNOWN_PLATFORMS = ("arcgis", "citizenrims", "civicplus", "crimemapping", "nixle", "rave", "socrata")
#: Seconds between two fetches of a feed; other frequencies count as daily.
FREQUENCY_SECONDS = {"realtime": 900, "hourly": 3600, "daily": 86400, "weekly": 604800}


def list_page(agencies: DataFrame, feeds: DataFrame, limit: int = 50, offset: int = 0, **equal) -> DataFrame:
    """A page by name with feed counts; filters of value None don't filter. The page is cut
    before feeds are counted, so the join has at most ``limit`` rows on one side."""
    rows = agencies
    for name, value in equal.items():
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    page = rows.orderBy("canonical_name", "agency_id").offset(offset).limit(limit)
    counts = feeds.join(page.select("agency_id"), "agency_id", "left_semi").groupBy("agency_id").agg(F.count("*").alias("feed_count"))
    columns = ("agency_id", "canonical_name", "county", "region", "agency_type", "platform_type", "homepage_url", "has_activity_data")
    return page.join(counts, "agency_id", "left").select(*columns, F.coalesce("feed_count", F.lit(0)).alias("feed_count"))


def totals(agencies: DataFrame, feeds: DataFrame) -> DataFrame:
    """One row of registry totals, in one pass over each table."""
    a = agencies.agg(F.count("*").alias("total"), F.count_if(F.col("last_verified").isNotNull()).alias("verified"), F.count_if(F.col("platform_type").isNull() | (F.col("platform_type") == "unknown")).alias("no_platform"), F.count_if(F.col("region").isNull()).alias("no_region"))
    b = feeds.agg(F.count("*").alias("feeds"), F.count_distinct("agency_id").alias("agencies_with_feeds"))
    return a.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k").drop("k")


def count_by(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(key), F.lit("unknown")).alias(key)).agg(F.count("*").alias("n"))


def with_feeds(agencies: DataFrame, feeds: DataFrame) -> DataFrame:
    """Each agency with the sorted array of its feeds; empty without any."""
    own = feeds.groupBy("agency_id").agg(F.array_sort(F.collect_list(F.struct("feed_id", "feed_type", "url", "is_active"))).alias("feeds"))
    none = F.array().cast("array<struct<feed_id:bigint,feed_type:string,url:string,is_active:boolean>>")
    return agencies.join(own, "agency_id", "left").withColumn("feeds", F.coalesce("feeds", none))


def feeds_of(agencies: DataFrame, feeds: DataFrame, wanted: DataFrame) -> DataFrame:
    """The feeds of the agencies in ``wanted`` (agency_id). ``found`` tells an agency that isn't registered
    (false) from one without feeds (true, and no feed)."""
    known = agencies.join(wanted, "agency_id", "left_semi").select("agency_id", F.lit(True).alias("found"))
    own = feeds.join(wanted, "agency_id", "left_semi").select("agency_id", "feed_id", "feed_type", "url", "is_active")
    rows = wanted.select("agency_id").distinct().join(known, "agency_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    return rows.join(own, "agency_id", "left")


def due_agencies(agencies: DataFrame, feeds: DataFrame, as_of: Column) -> DataFrame:
    """Agencies with a platform and an active feed that was never scraped or is due again."""
    seconds = F.coalesce(*(F.when(F.col("frequency") == k, F.lit(v)) for k, v in FREQUENCY_SECONDS.items()), F.lit(86400))
    due = feeds.filter("is_active").filter(F.col("last_scraped").isNull() | (F.col("last_scraped") < as_of - F.make_dt_interval(secs=seconds)))
    return agencies.filter(F.col("platform_type").isNotNull()).join(due, "agency_id", "left_semi").select("agency_id")


def unnamed_feed_agencies(agencies: DataFrame, feeds: DataFrame) -> DataFrame:
    """Agencies of a crawlable platform with an active feed whose address isn't known."""
    open_feeds = feeds.filter((F.col("url") == "N/A") & F.col("is_active"))
    return agencies.filter(F.col("platform_type").isNotNull() & (F.col("platform_type") != "crimemapping")).join(open_feeds, "agency_id", "left_semi")


def upsert(base: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``base`` with ``new`` rows inserted, and ``columns`` of known keys replaced (nulls too). Of
    several new rows of a key the greatest counts, nulls being least."""
    one = new.groupBy(key).agg(F.max(F.struct(*columns)).alias("v")).select(key, "v.*", F.lit(True).alias("__new"))
    b, n = base.alias("b"), one.alias("n")
    fields = [F.coalesce(f"n.{key}", f"b.{key}").alias(key)]
    for c in base.columns:
        if c != key:
            fields.append(F.when(F.col("n.__new"), F.col(f"n.{c}")).otherwise(F.col(f"b.{c}")).alias(c) if c in columns else F.col(f"b.{c}"))
    return b.join(n, F.col(f"b.{key}") == F.col(f"n.{key}"), "full").select(*fields)


def replace_children(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``base`` with all rows of the keys in ``new`` replaced by those."""
    return base.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def patch(base: DataFrame, changes: DataFrame, key: str, columns: list[str], where: Column | None = None) -> DataFrame:
    """``base`` with each non-null field of ``changes`` taken over, in rows that fit ``where``. Of
    several changes of a field of a key the greatest counts."""
    hit = F.lit(True) if where is None else where
    c = changes.groupBy(key).agg(*(F.max(x).alias(f"__{x}") for x in columns))
    joined = base.join(c, key, "left")
    return joined.select(*(F.when(hit, F.coalesce(f"__{x}", x)).otherwise(F.col(x)).alias(x) if x in columns else F.col(x) for x in base.columns))


def assign_slugs(rows: DataFrame, base: Column, position: str) -> DataFrame:
    """``agency_id`` from a base slug: the first row as is, the n-th as ``base-n``; ``collides``
    tells that a numbered slug equals another row's."""
    w = Window.partitionBy("base").orderBy(position)
    named = rows.withColumn("base", base).withColumn("n", F.row_number().over(w))
    named = named.withColumn("slug", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("n").cast("string"))))
    return named.withColumn("collides", F.count("*").over(Window.partitionBy("slug")) > 1).drop("n", "base")
