"""Registry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import registry as R
from millrace.sources.standins import load

from .base import query

_FREQ = "case frequency when 'realtime' then 900 when 'hourly' then 3600 when 'weekly' then 604800 else 86400 end"


@query(
    "agency_list_page",
    """select a.agency_id, canonical_name, county, region, agency_type, platform_type, homepage_url, has_activity_data,
       (select count(*) from feeds f where f.agency_id = a.agency_id) as feed_count
       from agencies a where region = 'EUROPE' and has_activity_data order by canonical_name, agency_id limit 50 offset 10""",
)
def agency_list_page(spark, sf_dir):
    return R.list_page(*load(spark, sf_dir, "agencies", "feeds"), 50, 10, region="EUROPE", has_activity_data=True, county=None)


@query(
    "registry_totals",
    """with a as (select count(*) as total, count(last_verified) as verified, count(*) filter (where platform_type is null or platform_type = 'unknown') as no_platform, count(*) filter (where region is null) as no_region from agencies),
       f as (select count(*) as feeds, count(distinct agency_id) as agencies_with_feeds from feeds) select * from a, f""",
)
def registry_totals(spark, sf_dir):
    return R.totals(*load(spark, sf_dir, "agencies", "feeds"))


@query("registry_quality", "select count(*) filter (where platform_type is null or platform_type = 'unknown') as no_platform, count(*) filter (where region is null) as no_region from agencies")
def registry_quality(spark, sf_dir):
    return R.totals(*load(spark, sf_dir, "agencies", "feeds")).select("no_platform", "no_region")


def _count_by(name, column):
    @query(name, f"select coalesce({column}, 'unknown') as {column}, count(*) as n from agencies group by 1")
    def run(spark, sf_dir):
        return R.count_by(*load(spark, sf_dir, "agencies"), column)


for _name, _column in (("count_by_type", "agency_type"), ("count_by_platform", "platform_type"), ("count_by_region", "region")):
    _count_by(_name, _column)


@query(
    "import_summary",
    """select agency_type, coalesce(platform_type, 'unknown') as platform_type, count(*) as n, count(*) filter (where agency_id in (select agency_id from feeds)) as with_feeds
       from agencies group by 1, 2 order by n desc, 1, 2""",
)
def import_summary(spark, sf_dir):
    agencies, feeds = load(spark, sf_dir, "agencies", "feeds")
    rows = agencies.join(feeds.select("agency_id", F.lit(True).alias("fed")).distinct(), "agency_id", "left")
    return rows.groupBy("agency_type", F.coalesce("platform_type", F.lit("unknown")).alias("platform_type")).agg(F.count("*").alias("n"), F.count_if("fed").alias("with_feeds")).orderBy(F.desc("n"), "agency_type", "platform_type")


@query(
    "agency_with_feeds",
    """select a.agency_id, count(f.feed_id) as n_feeds, coalesce(string_agg(cast(f.feed_id as string) || ':' || f.feed_type || ':' || f.url, ',' order by f.feed_id), '') as feed_list
       from agencies a left join feeds f on f.agency_id = a.agency_id group by a.agency_id""",
)
def agency_with_feeds(spark, sf_dir):
    nested = R.with_feeds(*load(spark, sf_dir, "agencies", "feeds"))
    text = F.array_join(F.transform("feeds", lambda f: F.concat_ws(":", f["feed_id"].cast("string"), f["feed_type"], f["url"])), ",")
    return nested.select("agency_id", F.size("feeds").cast("long").alias("n_feeds"), text.alias("feed_list"))


@query("feeds_for_agency", "select feed_id, agency_id, feed_type, url, is_active from feeds where agency_id = 7")
def feeds_for_agency(spark, sf_dir):
    return load(spark, sf_dir, "feeds")[0].filter("agency_id = 7").select("feed_id", "agency_id", "feed_type", "url", "is_active")


@query("known_platform_agencies", "select agency_id, platform_type from agencies where platform_type in ('arcgis','citizenrims','civicplus','crimemapping','nixle','rave','socrata')")
def known_platform_agencies(spark, sf_dir):
    return load(spark, sf_dir, "agencies")[0].filter(F.col("platform_type").isin(*R.KNOWN_PLATFORMS)).select("agency_id", "platform_type")


@query("limited_agencies", "select agency_id, canonical_name from agencies order by agency_id limit 25")
def limited_agencies(spark, sf_dir):
    """The optional limit of a batch over the registry."""
    return load(spark, sf_dir, "agencies")[0].select("agency_id", "canonical_name").orderBy("agency_id").limit(25)


@query("unknown_platform_agencies", "select agency_id, canonical_name from agencies where platform_type = 'unknown' or platform_type is null")
def unknown_platform_agencies(spark, sf_dir):
    return load(spark, sf_dir, "agencies")[0].filter((F.col("platform_type") == "unknown") | F.col("platform_type").isNull()).select("agency_id", "canonical_name")


@query("na_feed_agencies", "select agency_id, canonical_name from agencies where platform_type is not null and platform_type <> 'crimemapping' and agency_id in (select agency_id from feeds where url = 'N/A' and is_active)")
def na_feed_agencies(spark, sf_dir):
    return R.unnamed_feed_agencies(*load(spark, sf_dir, "agencies", "feeds")).select("agency_id", "canonical_name")


@query(
    "due_agencies",
    f"""select agency_id from agencies a where platform_type is not null and exists (select 1 from feeds f where f.agency_id = a.agency_id and f.is_active
        and (f.last_scraped is null or f.last_scraped < timestamp '1995-06-01 00:00:00' - {_FREQ} * interval 1 second))""",
)
def due_agencies(spark, sf_dir):
    return R.due_agencies(*load(spark, sf_dir, "agencies", "feeds"), F.lit("1995-06-01 00:00:00").cast("timestamp_ntz"))


_NEW = "select agency_id * 3 as agency_id, 'Renamed ' || canonical_name as canonical_name, case when agency_id % 2 = 0 then null else 'https://new.example.org/' || cast(agency_id as string) end as homepage_url, agency_type from agencies where agency_id % 5 = 1"


@query(
    "upsert_agencies",
    f"""with n as ({_NEW}) select coalesce(n.agency_id, a.agency_id) as agency_id, case when n.agency_id is not null then n.canonical_name else a.canonical_name end as canonical_name,
        case when n.agency_id is not null then n.homepage_url else a.homepage_url end as homepage_url, case when n.agency_id is not null then n.agency_type else a.agency_type end as agency_type,
        a.county from agencies a full join n on n.agency_id = a.agency_id""",
)
def upsert_agencies(spark, sf_dir):
    (agencies,) = load(spark, sf_dir, "agencies")
    base = agencies.select("agency_id", "canonical_name", "homepage_url", "agency_type", "county")
    return R.upsert(base, spark.sql(_NEW.replace("from agencies", "from {agencies}"), agencies=agencies), "agency_id", ["canonical_name", "homepage_url", "agency_type"])


@query(
    "replace_feeds",
    """with n as (select agency_id + 1000000 as feed_id, agency_id, homepage_url as url from agencies where agency_id % 10 = 3 and homepage_url <> 'N/A')
       select feed_id, agency_id, url from feeds where agency_id not in (select agency_id from n) union all select * from n""",
)
def replace_feeds(spark, sf_dir):
    agencies, feeds = load(spark, sf_dir, "agencies", "feeds")
    new = agencies.filter("agency_id % 10 = 3 and homepage_url <> 'N/A'").selectExpr("agency_id + 1000000 as feed_id", "agency_id", "homepage_url as url")
    return R.replace_children(feeds.select("feed_id", "agency_id", "url"), new, "agency_id")


@query(
    "patch_na_urls",
    "select f.feed_id, f.agency_id, case when f.url = 'N/A' and f.is_active then coalesce(p.url, f.url) else f.url end as url from feeds f left join (select agency_id, homepage_url || 'news' as url from agencies where homepage_url <> 'N/A') p on p.agency_id = f.agency_id",
)
def patch_na_urls(spark, sf_dir):
    agencies, feeds = load(spark, sf_dir, "agencies", "feeds")
    found = agencies.filter("homepage_url <> 'N/A'").select("agency_id", F.concat("homepage_url", F.lit("news")).alias("url"))
    return R.patch(feeds, found, "agency_id", ["url"], (F.col("url") == "N/A") & F.col("is_active")).select("feed_id", "agency_id", "url")


@query("patch_external_ids", "select a.agency_id, coalesce(p.external_id, a.external_id) as external_id from agencies a left join (select s_suppkey * 2 as agency_id, s_suppkey * 100 as external_id from supplier) p on p.agency_id = a.agency_id")
def patch_external_ids(spark, sf_dir):
    agencies, supplier = load(spark, sf_dir, "agencies", "supplier")
    found = supplier.selectExpr("s_suppkey * 2 as agency_id", "s_suppkey * 100 as external_id")
    return R.patch(agencies, found, "agency_id", ["external_id"]).select("agency_id", "external_id")


@query(
    "apply_agency_patch",
    """select a.agency_id, coalesce(p.county, a.county) as county, coalesce(p.homepage_url, a.homepage_url) as homepage_url from agencies a
       left join (select agency_id, case when agency_id % 2 = 0 then 'Patched' end as county, case when agency_id % 3 = 0 then 'https://patched.example.org' end as homepage_url from agencies where agency_id % 4 < 2) p on p.agency_id = a.agency_id""",
)
def apply_agency_patch(spark, sf_dir):
    (agencies,) = load(spark, sf_dir, "agencies")
    changes = agencies.filter("agency_id % 4 < 2").selectExpr("agency_id", "case when agency_id % 2 = 0 then 'Patched' end as county", "case when agency_id % 3 = 0 then 'https://patched.example.org' end as homepage_url")
    return R.patch(agencies, changes, "agency_id", ["county", "homepage_url"]).select("agency_id", "county", "homepage_url")


@query(
    "slug_assign",
    """with b as (select p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') as base from part),
       n as (select *, row_number() over (partition by base order by p_partkey) as n from b), s as (select p_partkey, case when n = 1 then base else base || '-' || cast(n as string) end as slug from n)
       select p_partkey, slug, count(*) over (partition by slug) > 1 as collides from s""",
)
def slug_assign(spark, sf_dir):
    (part,) = load(spark, sf_dir, "part")
    rows = R.assign_slugs(part.select("p_partkey", "p_name"), F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "-"), "p_partkey")
    return rows.select("p_partkey", "slug", "collides")
