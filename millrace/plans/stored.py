"""Queries on tables that change in place, on streams, and on sources that are read page by page."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from millrace.operators import ingest as I
from millrace.operators import registry as R
from millrace.sources import listings as L
from millrace.sources import open_data as S
from millrace.sources import parsers as P
from millrace.sources import plugins
from millrace.sources.standins import load
from millrace.streaming import monitor as M
from millrace.tables import KeyedTable, SeenStore, new_path, number_rows

from .base import ORACLES, QUERIES, query
from . import health  # noqa: F401  its oracle is used below
from .ingest import _NEW as _FRESH
from .ingest import _seen
from .parse import _DAY, _ORACLE_DAY, _P, _parts
from .registry import _NEW

# Tables that change in place.


@query("seen_store_dedup", f"with {_FRESH} select doc_id, doc_hash from fresh")
def seen_store_dedup(spark, sf_dir):
    """Documents whose hash a store of seen ones doesn't hold."""
    (docs,) = load(spark, sf_dir, "docs")
    store = SeenStore.create(_seen(docs), new_path(spark, "seen"), 16)
    return I.unseen_documents(docs, store).select("doc_id", "doc_hash")


def _agencies(spark, sf_dir, name):
    base = load(spark, sf_dir, "agencies")[0].select("agency_id", "canonical_name", "homepage_url", "agency_type", "county")
    return base, KeyedTable.create(base, new_path(spark, name), "agency_id", 16)


@query(
    "table_upsert",
    f"""with n as ({_NEW}) select coalesce(n.agency_id, a.agency_id) as agency_id, case when n.agency_id is not null then n.canonical_name else a.canonical_name end as canonical_name,
        case when n.agency_id is not null then n.homepage_url else a.homepage_url end as homepage_url, case when n.agency_id is not null then n.agency_type else a.agency_type end as agency_type,
        a.county from agencies a full join n on n.agency_id = a.agency_id""",
)
def table_upsert(spark, sf_dir):
    """An upsert into a stored table."""
    base, table = _agencies(spark, sf_dir, "agencies")
    table.upsert(spark.sql(_NEW.replace("from agencies", "from {agencies}"), agencies=load(spark, sf_dir, "agencies")[0]), ["canonical_name", "homepage_url", "agency_type"])
    return table.read()


@query(
    "table_create_refused",
    """with n as (select agency_id * 3 as agency_id, 'New ' || canonical_name as canonical_name from agencies where agency_id % 7 = 2)
       select agency_id, canonical_name, false as refused from agencies union all select agency_id, canonical_name, agency_id in (select agency_id from agencies) from n""",
)
def table_create_refused(spark, sf_dir):
    """Rows created in a stored table, and those that it refuses since their key is known."""
    base, table = _agencies(spark, sf_dir, "agencies")
    new = base.filter("agency_id % 7 = 2").withColumns({"agency_id": F.col("agency_id") * 3, "canonical_name": F.concat(F.lit("New "), "canonical_name")})
    refused = table.insert(new, "canonical_name")
    told = lambda rows, flag: rows.select("agency_id", "canonical_name", F.lit(flag).alias("refused"))
    return told(table.read(), False).unionByName(told(refused, True))


@query(
    "table_changes",
    """select a.agency_id, coalesce(p.county, a.county) as county from agencies a left join (select agency_id, case when agency_id % 2 = 0 then 'Patched' end as county from agencies where agency_id % 4 < 2) p on p.agency_id = a.agency_id
       where a.agency_id % 9 <> 4""",
)
def table_changes(spark, sf_dir):
    """A partial update of a stored table, then a deletion."""
    base, table = _agencies(spark, sf_dir, "agencies")
    table.patch(base.filter("agency_id % 4 < 2").selectExpr("agency_id", "case when agency_id % 2 = 0 then 'Patched' end as county"), ["county"])
    table.delete(base.filter("agency_id % 9 = 4"))
    return table.read().select("agency_id", "county")


@query(
    "table_replace_feeds",
    """with n as (select agency_id + 1000000 as feed_id, agency_id, homepage_url as url from agencies where agency_id % 10 = 3 and homepage_url <> 'N/A')
       select feed_id, agency_id, url from feeds where agency_id not in (select agency_id from n) union all select * from n""",
)
def table_replace_feeds(spark, sf_dir):
    """All feeds of some agencies replaced in a stored table of many rows a key."""
    agencies, feeds = load(spark, sf_dir, "agencies", "feeds")
    table = KeyedTable.create(feeds.select("feed_id", "agency_id", "url"), new_path(spark, "feeds"), "agency_id", 16)
    table.replace(agencies.filter("agency_id % 10 = 3 and homepage_url <> 'N/A'").selectExpr("agency_id + 1000000 as feed_id", "agency_id", "homepage_url as url"))
    return table.read()


@query(
    "feeds_or_missing",
    """with w as (select c_custkey * 2 as agency_id from customer where c_custkey % 3 = 0), k as (select w.agency_id, a.agency_id is not null as found from w left join agencies a on a.agency_id = w.agency_id)
       select k.agency_id, k.found, f.feed_id, f.feed_type, f.url, f.is_active from k left join feeds f on f.agency_id = k.agency_id""",
)
def feeds_or_missing(spark, sf_dir):
    """Feeds of agencies, of which some have none and some aren't registered."""
    agencies, feeds, customer = load(spark, sf_dir, "agencies", "feeds", "customer")
    return R.feeds_of(agencies, feeds, customer.filter("c_custkey % 3 = 0").select((F.col("c_custkey") * 2).alias("agency_id")))


# Streams.


def stream_problem_agencies(spark, sf_dir):
    """Health told by a stream of runs in three batches, with timers for agencies that fall silent."""
    agencies, runs = load(spark, sf_dir, "agencies", "runs")
    changes = M.drained_in_batches(runs.select("agency_id", "run_id", "run_at", "docs_fetched"), "run_at", 3, M.health_changes, "health")
    return M.current(agencies, changes)


QUERIES["stream_problem_agencies"], ORACLES["stream_problem_agencies"] = stream_problem_agencies, ORACLES["problem_agencies"]

_SECONDS = "case agency_id % 4 when 0 then 900 when 1 then 3600 when 2 then 86400 else 604800 end"


@query(
    "stream_due_agencies",
    f"""with l as (select agency_id, max(run_at) as last, {_SECONDS} as seconds from runs group by agency_id) select agency_id, strftime(time_bucket(interval 1 second, last + to_seconds(seconds)), '%Y-%m-%d %H:%M:%S') as due_at from l
        where last + to_seconds(seconds) < (select max(run_at) from runs) - interval 1 millisecond""",
)
def stream_due_agencies(spark, sf_dir):
    """Agencies that a timer makes due again, as of the newest run of all."""
    (runs,) = load(spark, sf_dir, "runs")
    changes = M.drained_in_batches(runs.select("agency_id", "run_at"), "run_at", 3, lambda s: M.due_changes(s, F.expr(_SECONDS)), "due")
    return M.due_now(changes).select("agency_id", F.date_format(F.col("due_at") - F.expr("interval '0.001' second"), "yyyy-MM-dd HH:mm:ss").alias("due_at"))


# Sources that are read page by page.

_AFTER = datetime(2024, 6, 30)


def _recorded(spark, sf_dir, platform, field, item, bodies):
    """The folder of responses that a service gives to requests for all parts, and for those after a day."""
    folder = new_path(spark, f"recorded-{platform}")
    rows = _parts(spark, sf_dir, f"cast({_DAY} as timestamp_ntz) as day", f"{item} as item")
    for bounds in ((), ((">", _AFTER),)):
        own = rows.filter(F.col("day") > F.lit(_AFTER)) if bounds else rows
        placed = number_rows(own, "p_partkey", name="at", first=0).withColumn("offset", F.floor(F.col("at") / S.PAGE_SIZE) * S.PAGE_SIZE)
        pages = placed.groupBy("offset").agg(F.array_sort(F.collect_list(F.struct("at", "item"))).alias("items"))
        asked = S.request(platform, 987654321, date_field=field, bounds=bounds)
        body = bodies(F.array_join(F.transform("items", lambda i: i["item"]), ","), F.size("items"))
        S.record(pages.select(F.replace(F.lit(asked), F.lit("987654321"), F.col("offset").cast("string")).alias("query"), body.alias("body")), folder)
    return folder


def _pages(spark, platform, field, folder, url):
    S.register(spark)
    rows = spark.read.format("open_data").option("platform", platform).option("date_field", field).option("recorded", folder).load(url)
    return rows.filter(F.col("at") > F.lit(_AFTER))


_OFFSET = "(row_number() over (order by p_partkey) - 1)"


@query(
    "open_data_pages",
    f"""with p as (select *, {_OFFSET} as "at" from part where {_ORACLE_DAY} > timestamp '2024-06-30 00:00:00')
        select "at" // 1000 * 1000 as "offset", cast("at" % 1000 as int) as pos, 'arrest_log' as document_type, 'Booking' as title, 'crm_cd_desc: Booking; date_occ: ' || strftime({_ORACLE_DAY}, '%Y-%m-%d') || 'T00:00:00.000; dr_no: ' || {_P} as raw_text, {_ORACLE_DAY} as published_date from p""",
)
def open_data_pages(spark, sf_dir):
    """An open-data set read by pages, whose requests hold the filter: offsets count what fits it only."""
    item = f"""'{{"dr_no":' || {_P} || ',"crm_cd_desc":"Booking","date_occ":"' || cast({_DAY} as string) || 'T00:00:00.000",":sid":"1","none":null}}'"""
    folder = _recorded(spark, sf_dir, "socrata", "date_occ", item, lambda items, n: F.concat(F.lit("["), items, F.lit("]")))
    rows = _pages(spark, "socrata", "date_occ", folder, "https://data.town.gov/resource/ab12-cd34.json")
    return P.open_data_documents(rows, ["offset"]).select("offset", "pos", "document_type", "title", "raw_text", "published_date")


@query(
    "layer_pages",
    f"""with p as (select *, {_OFFSET} as "at" from part where {_ORACLE_DAY} > timestamp '2024-06-30 00:00:00')
        select "at" // 1000 * 1000 as "offset", cast("at" % 1000 as int) as pos, {_ORACLE_DAY} as "at", {_P} as objectid, p_type as crime_type from p""",
)
def layer_pages(spark, sf_dir):
    """A map layer read by pages, which tells whether there are more."""
    item = f"""'{{"attributes":{{"OBJECTID":' || {_P} || ',"CRIME_TYPE":"' || p_type || '","DATE_OCC":' || cast(unix_date({_DAY}) * 86400000L as string) || '}}}}'"""
    body = lambda items, n: F.concat(F.lit('{"features":['), items, F.when(n == S.PAGE_SIZE, F.lit('],"exceededTransferLimit":true}')).otherwise(F.lit("]}")))
    rows = _pages(spark, "arcgis", "DATE_OCC", _recorded(spark, sf_dir, "arcgis", "DATE_OCC", item, body), "https://gis.town.gov/query")
    return rows.select("offset", "pos", "at", F.col("row")["OBJECTID"].alias("objectid"), F.col("row")["CRIME_TYPE"].alias("crime_type"))


@query(
    "listing_pages",
    f"""with p as (select *, row_number() over (partition by p_partkey % 97 order by p_partkey) as n from part), q as (select *, cast((n - 1) // 10 + 1 as int) as page, p_partkey % 97 as town from p)
        select town, page, cast((n - 1) % 10 as int) as pos, 'https://t' || cast(town as string) || '.org/press/' || {_P} as url, p_name as title, p_name || '. ' || p_type as raw_text from q where page <= case when town % 10 = 3 then 2 else 5 end""",
)
def listing_pages(spark, sf_dir):
    """News listings read page by page, of which some have more than are wanted and some break off."""
    n_items = 10
    item = f"""'<article><h2>' || p_name || '</h2><a href="/press/' || {_P} || '">more</a><p>' || p_type || '</p></article>'"""
    rows = number_rows(_parts(spark, sf_dir, "p_partkey % 97 as town", f"{item} as item"), "p_partkey", by=("town",), name="at", first=0)
    pages = rows.groupBy("town", (F.floor(F.col("at") / n_items) + 1).cast("int").alias("page")).agg(F.array_sort(F.collect_list(F.struct("at", "item"))).alias("items"))
    last = pages.groupBy("town").agg(F.max("page").alias("last"))
    base = F.concat(F.lit("https://t"), F.col("town").cast("string"), F.lit(".org/press/"))
    address = F.when(F.col("page") == 1, base).otherwise(F.concat(base, F.lit("?Page="), F.col("page").cast("string")))
    following = F.when(F.col("page") < F.col("last"), F.lit('<a rel="next" href="?Page=n">Next</a>')).otherwise(F.lit(""))
    body = F.concat(F.array_join(F.transform("items", lambda i: i["item"]), ""), following)
    folder = new_path(spark, "recorded-listings")
    S.record(pages.join(last, "town").filter("not (town % 10 = 3 and page = 3)").select(address.alias("query"), body.alias("body")), folder)
    towns = rows.select("town").distinct().withColumn("listing", base)
    read = L.read_listings(towns, "listing", recorded=folder)
    return P.parse_listing(read, ["town", "page"], url="page_url").select("town", "page", "pos", "url", "title", "raw_text")


# Responses of all platforms in one pass.

_NAMES = ("rss", "civicplus", "citizenrims", "nixle", "rave", "crimemapping", "socrata", "arcgis", "pdf", "lines", "unheard")
_KIND = "p_partkey % 11"
_BROKEN = "p_partkey % 13 = 5"


def _lines(url, payload):
    """A user's parser: a document for each line; a payload that is broken makes it fail."""
    if payload == "broken":
        raise ValueError("broken")
    return [{"url": url, "raw_text": line} for line in payload.split("\n")]


def _responses(spark, sf_dir):
    text = {
        0: "'<rss><channel><title>x</title><item><title>T</title><description>' || p_name || '</description></item></channel></rss>'",
        1: "'<article><h2>T</h2><p>' || p_name || '</p></article>'",
        2: "'<table class=\"table\"><tbody><tr><td>01/02/2024</td><td>Theft</td><td>1 Oak St</td><td>' || p_name || ' noted</td></tr></tbody></table>'",
        3: "'<div class=\"alert-item\"><h2>T</h2><div class=\"alert-body\">' || p_name || '</div></div>'",
        5: """'{"Incidents":[{"TypeDescription":"Theft","Address":"1 Oak St","DateOccurred":"today","Description":"' || p_name || '"}]}'""",
        6: """'[{"id":' || cast(p_partkey as string) || ',"name":"' || p_name || '"}]'""",
        7: """'{"features":[{"attributes":{"ID":' || cast(p_partkey as string) || ',"NAME":"' || p_name || '"}}]}'""",
        8: """'["' || p_name || '",""]'""",
        9: "'one ' || p_name || chr(10) || 'two ' || p_name",
    }
    text[4], text[10] = text[3], "p_name"
    payload = f"case when {_BROKEN} then case when {_KIND} in (1, 2, 3, 4, 8) then null else 'broken' end else case {_KIND} " + " ".join(f"when {k} then {v}" for k, v in text.items()) + " end end as payload"
    platform = f"case {_KIND} " + " ".join(f"when {k} then '{n.upper() if k % 2 else n}'" for k, n in enumerate(_NAMES)) + " end as platform"
    map_id = "case when p_partkey % 2 = 0 then p_partkey end as map_id"
    return _parts(spark, sf_dir, f"'https://x.org/{_KIND.replace(' ', '')}' as url", "0 as offset", "p_partkey % 5 as attempt", map_id, platform, payload)


def _parsed(spark, sf_dir, keys):
    rows = _responses(spark, sf_dir)
    plugins.register("lines", lambda **settings: plugins.RowParser(_lines, **settings))
    try:
        return plugins.parse_results(rows, F.col("platform"), keys)
    finally:
        plugins.unregister("lines")


_NONE = "cast(null as varchar)"
_PARSED = f"""parsed as (select p_partkey, p_partkey % 5 as attempt, cast(case when fault is null then i end as int) as pos, case when fault is not null then {_NONE} else case {_KIND} when 0 then p_name when 2 then 'Theft at 1 Oak St at ' || p_name || ' noted' when 5 then 'Theft at 1 Oak St on today. ' || p_name
        when 6 then 'id: ' || {_P} || '; name: ' || p_name when 7 then 'ID: ' || {_P} || '; NAME: ' || p_name when 8 then p_name when 9 then case when i = 0 then 'one ' else 'two ' end || p_name else 'T. ' || p_name end end as raw_text, fault as error
    from (select *, case when {_KIND} = 10 then 'no parser for unheard' when {_KIND} = 5 and p_partkey % 2 = 1 then 'no external id' when not {_BROKEN} then null when {_KIND} in (1, 2, 3, 4, 8) then 'no response'
        when {_KIND} = 9 then 'ValueError: broken' else 'response can''t be read' end as fault from part) p, (values (0), (1)) v(i) where i = 0 or {_KIND} = 9 and fault is null)"""


@query("parse_every_platform", f"with {_PARSED} select p_partkey, pos, raw_text, error from parsed")
def parse_every_platform(spark, sf_dir):
    """The nine built-in parsers and a user's, in one pass; what can't be read is a row with its error."""
    return _parsed(spark, sf_dir, ["p_partkey"]).select("p_partkey", "pos", "raw_text", "error")


@query("parse_failures", f"with {_PARSED} select p_partkey as agency_id, error from parsed where error is not null and attempt >= 3")
def parse_failures(spark, sf_dir):
    """Responses that a third attempt could not read either, for the dead-letter queue."""
    return I.dead_letters(_parsed(spark, sf_dir, ["p_partkey", "attempt"]).withColumnRenamed("p_partkey", "agency_id"))
