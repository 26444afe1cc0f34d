"""Queries around fetching: feeds, parsers by name, external lists, ad-hoc runs, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import urls as U
from millrace.operators import ingest as I
from millrace.sources import discovery as S
from millrace.sources import parsers as P
from millrace.sources import plugins
from millrace.sources.standins import load

from .base import query
from .ingest import _ROWS, _coverage
from .parse import _DAY, _ORACLE_DAY, _P, _parts


@query(
    "parse_atom",
    f"""select p_partkey, i as pos, case when i = 0 then 'https://town.org/e/' || {_P} else 'https://town.org/atom/' || {_P} end as url, case when p_partkey % 2 = 0 then 'press_release' else 'activity_feed' end as document_type,
        case when i = 0 then p_name end as title, case when i = 0 then 'Full ' || p_type else p_brand end as raw_text, case when i = 0 then {_ORACLE_DAY} + interval 8 hour else {_ORACLE_DAY} end as published_date from part, (values (0), (1)) v(i)""",
)
def parse_atom(spark, sf_dir):
    xml = f"""'<feed xmlns="http://www.w3.org/2005/Atom"><title type="text">' || case when p_partkey % 2 = 0 then 'Press room' else 'Daily' end || '</title><id>urn:x</id><link href="https://town.org/self" rel="self"/><entry><title>' || p_name || '</title><link rel="self" href="https://town.org/no"/><link rel="alternate" href="https://town.org/e/' || {_P} || '"/><summary>short</summary>
        <content type="text">Full  ' || p_type || '</content><published>' || cast({_DAY} as string) || 'T00:00:00-08:00</published><updated>2030-01-01T00:00:00Z</updated></entry><entry><title></title><summary type="text">' || p_brand || '</summary><updated>' || cast({_DAY} as string) || 'T00:00:00Z</updated></entry></feed>'"""
    rows = _parts(spark, sf_dir, f"'https://town.org/atom/' || {_P} as url", f"{xml} as xml")
    return P.parse_feed(rows, ["p_partkey"]).drop("metadata")


def _line_documents(url, payload, word="note"):
    """A user's parser: each line of a response that has the word is a document."""
    return [{"url": url, "document_type": word, "title": line[:4], "raw_text": line, "metadata": {"word": word}} for line in payload.split("\n") if word in line]


@query(
    "parse_by_platform",
    f"""select p_partkey, 0 as pos, 'https://www.crimemapping.com/map/agency/' || cast(p_partkey % 50 as string) as url, p_type || ' at 1 Oak St on . ' || p_name as raw_text from part where p_partkey % 3 = 0
        union all select p_partkey, i, 'https://lines.org/' || {_P}, case when i = 0 then 'note ' || p_name else 'last note' end from part, (values (0), (1)) v(i) where p_partkey % 3 = 1""",
)
def parse_by_platform(spark, sf_dir):
    """Built-in parsers, and one that is registered for this run, chosen by platform."""
    payload = f"""case p_partkey % 3 when 0 then '{{"Incidents":[{{"TypeDescription":"' || p_type || '","Address":"1 Oak St","Description":"' || p_name || '"}}]}}' else 'note ' || p_name || chr(10) || 'nothing' || chr(10) || 'last note' end"""
    platform = "case p_partkey % 3 when 0 then 'CrimeMapping' when 1 then 'lines' else 'unheard' end as platform"
    rows = _parts(spark, sf_dir, f"'https://lines.org/' || {_P} as url", "p_partkey % 50 as map_id", "0 as offset", platform, f"{payload} as payload")
    plugins.register("lines", lambda **settings: plugins.RowParser(_line_documents, **settings))
    try:
        return plugins.parse_all(rows, F.col("platform"), ["p_partkey"], {"lines": {"word": "note"}}).select("p_partkey", "pos", "url", "raw_text")
    finally:
        plugins.unregister("lines")


@query(
    "page_queries",
    f"""select p_partkey, '$limit=1000&$offset=' || cast(p_partkey * 1000 as string) || '&$where=date_occ > ' || chr(39) || strftime({_ORACLE_DAY} - interval 30 day, '%Y-%m-%dT%H:%M:%S') || chr(39) as rows_query,
        'where=DATE_OCC > DATE ' || chr(39) || strftime({_ORACLE_DAY} - interval 7 day, '%Y-%m-%d') || chr(39) || '&outFields=*&f=json&resultOffset=' || cast(p_partkey as string) || '&resultRecordCount=1000' as layer_query,
        'where=1=1&outFields=*&f=json&resultOffset=0&resultRecordCount=1000' as first_query from part""",
)
def page_queries(spark, sf_dir):
    rows = _parts(spark, sf_dir, f"cast({_DAY} as timestamp_ntz) as d")
    d = F.col("d")
    return rows.select(
        "p_partkey",
        P.page_query("socrata", F.col("p_partkey") * 1000, "date_occ", 30, d).alias("rows_query"),
        P.page_query("arcgis", F.col("p_partkey"), "DATE_OCC", 7, d).alias("layer_query"),
        P.page_query("arcgis", F.lit(0)).alias("first_query"),
    )


@query("external_id_match", "select p_partkey as agency_id, cast(p_partkey * 7 as string) as external_id from part where p_partkey % 2 = 0")
def external_id_match(spark, sf_dir):
    """Agencies against the service's list of them, of which only even ones have an entry."""
    rows = _parts(spark, sf_dir, "p_partkey as agency_id", f"'Town' || {_P} || ' Police Department' as canonical_name")
    entry = F.struct((F.col("p_partkey") * 7).alias("agencyId"), F.concat(F.lit("TOWN"), F.col("p_partkey").cast("string"), F.lit(" Police")).alias("agencyName"))
    listing = rows.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("page"), F.to_json(F.array(entry)).alias("payload"))
    return S.external_ids(rows, listing, rows.select("agency_id", F.lit("[]").alias("payload")))


@query("external_id_search", "select p_partkey as agency_id, cast(p_partkey * 7 as string) as external_id from part where p_partkey % 3 = 0")
def external_id_search(spark, sf_dir):
    """The same where the list is empty: each agency's own search answers."""
    rows = _parts(spark, sf_dir, "p_partkey as agency_id", f"'Town' || {_P} || ' Police' as canonical_name")
    answer = F.expr(f"""case when p_partkey % 3 = 0 then '[{{"id":1,"name":"Elsewhere"}},{{"id":' || cast(p_partkey * 7 as string) || ',"name":"town' || {_P} || ' Sheriff"}}]' else '[]' end""")
    none = spark.createDataFrame([('{"agencies":[]}',)], "payload string")
    return S.external_ids(rows, none, rows.select("agency_id", answer.alias("payload")))


_FETCHED = "select d.doc_id, f.feed_id, d.url, d.title, d.raw_text from docs d join feeds f on d.doc_id % 40 = f.feed_id % 40 and f.agency_id = 7"


@query(
    "single_agency_run",
    """with f as (select d.url, d.title, sha256(coalesce(d.url, '') || ':' || coalesce(d.raw_text, '')) as h, d.doc_id, min(d.doc_id) over (partition by sha256(coalesce(d.url, '') || ':' || coalesce(d.raw_text, ''))) as least
        from docs d join feeds f on d.doc_id % 40 = f.feed_id % 40 and f.agency_id = 7 where f.is_active and exists (select 1 from agencies where agency_id = 7 and platform_type <> ''))
       select distinct '{"doc_id":' || cast(doc_id as string) || ',"url":"' || url || '"}' as payload from f where doc_id = least and h not in (select sha256(coalesce(url, '') || ':' || coalesce(raw_text, '')) from docs where doc_id % 10 = 1)""",
)
def single_agency_run(spark, sf_dir):
    agencies, feeds, docs = load(spark, sf_dir, "agencies", "feeds", "docs")
    fetched = spark.sql(_FETCHED.replace("from docs", "from {docs}").replace("join feeds", "join {feeds}"), docs=docs, feeds=feeds)
    seen = docs.filter("doc_id % 10 = 1").select(I.doc_hash().alias("doc_hash")).distinct()
    return I.single_run(agencies, feeds, fetched, seen, 7, ["doc_id", "url"])


@query(
    "single_agency_dry_run",
    """select '{"doc_id":' || cast(d.doc_id as string) || ',"url":"' || d.url || '"}' as payload from docs d join feeds f on d.doc_id % 40 = f.feed_id % 40 and f.agency_id = 7
       where f.is_active and exists (select 1 from agencies where agency_id = 7 and platform_type <> '')""",
)
def single_agency_dry_run(spark, sf_dir):
    agencies, feeds, docs = load(spark, sf_dir, "agencies", "feeds", "docs")
    fetched = spark.sql(_FETCHED.replace("from docs", "from {docs}").replace("join feeds", "join {feeds}"), docs=docs, feeds=feeds)
    return I.single_run(agencies, feeds, fetched, docs.select(I.doc_hash().alias("doc_hash")), 7, ["doc_id", "url"], dry_run=True)


@query(
    "coverage_report",
    f"""with {_ROWS} select cast(agency_id as string) || '|' || coalesce(platform_type, '') || '|' || cast(docs_fetched as string) || '|' || cast(docs_inserted as string) || '|' || coalesce(strftime(date_min, '%Y-%m-%dT%H:%M:%S'), '') || '|'
        || coalesce(strftime(date_max, '%Y-%m-%dT%H:%M:%S'), '') || '|' || coalesce(error, '') as value from cov""",
)
def coverage_report(spark, sf_dir):
    """The delimited report of an ingestion run."""
    columns = ("agency_id", "platform_type", "docs_fetched", "docs_inserted", "date_min", "date_max", "error")
    return S.report_lines(_coverage(spark, sf_dir).select(*columns))


@query("robots_allowed", "select page_id, page_id % 4 = 3 or page_id % 4 = 0 and page_id % 3 <> 0 as allowed from pages")
def robots_allowed(spark, sf_dir):
    (pages,) = load(spark, sf_dir, "pages")
    rules = F.expr("case page_id % 4 when 0 then 'User-agent: *' || chr(10) || 'Disallow: /private' when 1 then 'User-agent: *' || chr(10) || 'Disallow: /' when 2 then 'User-agent: Millrace' || chr(10) || 'Disallow: /' end")
    url = F.expr("'https://town.org/' || case when page_id % 3 = 0 then 'private/' else 'news/' end || cast(page_id as string)")
    return pages.select("page_id", U.robots_allowed(url, rules, "Millrace/1.0").alias("allowed"))


@query("byte_sources", "select feed_id, case when url like 'http://%' or url like 'https://%' then 'http' else 'file' end as source from feeds")
def byte_sources(spark, sf_dir):
    return load(spark, sf_dir, "feeds")[0].select("feed_id", U.byte_source(F.col("url")).alias("source"))


@query("bounded_slots", "select agency_id, cast(agency_id % 10 as int) as slot, row_number() over (partition by agency_id % 10 order by agency_id) as turn from agencies")
def bounded_slots(spark, sf_dir):
    return I.bounded_slots(load(spark, sf_dir, "agencies")[0].select("agency_id"), "agency_id", "agency_id", 10).withColumn("turn", F.col("turn").cast("long"))
