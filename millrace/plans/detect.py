"""Detection and classification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import classify as C
from millrace.functions import constants as K
from millrace.functions import detect as D
from millrace.operators.matching import longest_prefixes
from millrace.sources.standins import load

from .base import query

# Names that reach every rule, by customer number.
_NAMES = """select c_custkey as id, case c_custkey % 14 when 0 then 'Alameda County Sheriff''s Office' when 1 then 'Fresno Police Department' when 2 then 'San Francisco District Attorney' when 3 then 'Orange DA Office'
    when 4 then 'Kern County Coroner' when 5 then 'State University of Marin' when 6 then 'BART Police' when 7 then 'CHP Redding' when 8 then 'State Parks' when 9 then 'San Luis Obispo Police'
    when 10 then 'Nowhere County Police' when 11 then 'Lake  County  Transit' when 12 then 'O’Brien''s Town -- Marshal!' else 'Los Angeles' end as name,
    case c_custkey % 9 when 0 then 'https://x.CitizenRIMS.com' when 1 then 'https://crimegraphics.com/a' when 2 then 'https://www.crimemapping.com/m' when 3 then 'https://services.arcgis.com/feed.PDF' when 4 then 'https://nixle.com/x'
    when 5 then 'https://data.town.gov/resource/ab12-cd34.json' when 6 then 'https://town.org/feed' when 7 then 'https://town.org/a.pdf' else 'https://town.org/press' end as url,
    case c_custkey % 10 when 0 then 'see NIXLE' when 1 then null else 'notes' end as notes,
    case c_custkey % 8 when 0 then 'Arrest logs' when 1 then 'Incident list' when 2 then 'Crime Map' when 3 then 'Activity' when 4 then 'Press' when 5 then 'Alerts' when 6 then 'Crime type: offense' else 'Other' end as kinds
    from customer"""


def _names(spark, sf_dir):
    (customer,) = load(spark, sf_dir, "customer")
    return spark.sql(_NAMES.replace("''s", "\\'s").replace("from customer", "from {customer}"), customer=customer)


def _case(rules, default):
    return "case " + " ".join(f"when {c} then '{v}'" for c, v in rules) + (f" else '{default}'" if default is not None else "") + " end"


def _has(column, *parts):
    return "(" + " or ".join(f"contains({column}, '{p}')" for p in parts) + ")"


def _named(sql):
    return f"with names as ({_NAMES}) select {sql} from names"


@query("slugify", _named(r"id, regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower(name), '[’'']', '', 'g'), '[^a-z0-9\s-]', '', 'g')), '\s+', '-', 'g'), '-+', '-', 'g') as slug"))
def slugify(spark, sf_dir):
    return _names(spark, sf_dir).select("id", D.slugify(F.col("name")).alias("slug"))


_TYPE_RULES = [
    (_has("name", "Sheriff"), "sheriff"), (r"(contains(name, 'District Attorney') or regexp_matches(name, '\bDA\b'))", "district_attorney"), (_has("name", "Coroner"), "coroner"),
    (_has("name", "University", "College", "Campus", "School District"), "campus"), (_has("name", "Transit", "BART", "Amtrak"), "transit"), ("(contains(name, 'Highway Patrol') or contains(name, 'CHP') or starts_with(name, 'State '))", "state"),
]


@query("detect_agency_type", _named(f"id, {_case(_TYPE_RULES, 'municipal_pd')} as agency_type"))
def detect_agency_type(spark, sf_dir):
    return _names(spark, sf_dir).select("id", D.agency_type(F.col("name")).alias("agency_type"))


_TOLD = r"nullif(trim(regexp_extract(name, '^([A-Za-z\s]+?)\s+County', 1)), '')"
_KNOWN = sorted(((len(c), c) for names in K.COUNTY_REGIONS.values() for c in names), reverse=True)
_COUNTY = f"case when {_TOLD} in ({', '.join(repr(c) for _, c in _KNOWN)}) then {_TOLD} " + " ".join(f"when name = '{c}' or starts_with(name, '{c} ') then '{c}'" for _, c in _KNOWN) + " end"
_REGION = "case " + " ".join(f"when county in ({', '.join(repr(c) for c in names)}) then '{r}'" for r, names in K.COUNTY_REGIONS.items()) + " end"


@query("detect_county", _named(f"id, {_TOLD} as county"))
def detect_county(spark, sf_dir):
    return _names(spark, sf_dir).select("id", D.county_in_name(F.col("name")).alias("county"))


@query("infer_county", _named(f"id, {_COUNTY} as county"))
def infer_county(spark, sf_dir):
    return _names(spark, sf_dir).select("id", D.infer_county(F.col("name")).alias("county"))


@query("assign_regions", f"with names as ({_NAMES}), c as (select id, {_COUNTY} as county from names) select id, county, {_REGION} as region from c")
def assign_regions(spark, sf_dir):
    rows = _names(spark, sf_dir).select("id", D.infer_county(F.col("name")).alias("county"))
    return rows.withColumn("region", D.region_of(F.col("county")))


@query("region_summary", f"with names as ({_NAMES}), c as (select id, {_COUNTY} as county from names), r as (select *, {_REGION} as region from c) select coalesce(region, '(no region)') as region, count(*) as n, count(county) as with_county from r group by 1 order by n desc, 1")
def region_summary(spark, sf_dir):
    return assign_regions_rows(spark, sf_dir).groupBy(F.coalesce("region", F.lit("(no region)")).alias("region")).agg(F.count("*").alias("n"), F.count("county").alias("with_county")).orderBy(F.desc("n"), "region")


def assign_regions_rows(spark, sf_dir):
    return assign_regions(spark, sf_dir)


_ROW = "lower(url || ' ' || coalesce(notes, ''))"
_ROW_RULES = [(f"contains({_ROW}, '{t}')", p) for t, p in (("citizenrims", "citizenrims"), ("crimegraphics", "crimegraphics"), ("crimemapping.com", "crimemapping"), ("arcgis", "arcgis"), ("nixle", "nixle"))] + [(rf"regexp_matches({_ROW}, 'data\.[^/]*\.(gov|org)')", "socrata")]


@query("detect_platform_csv", _named(f"id, {_case(_ROW_RULES, 'unknown')} as platform_type"))
def detect_platform_csv(spark, sf_dir):
    return _names(spark, sf_dir).select("id", D.platform_of_row(F.col("url"), F.col("notes")).alias("platform_type"))


@query("detect_feed_type", _named(f"id, {_case([(f'contains(lower(kinds), {t!r})', v) for t, v in (('arrest', 'arrest_log'), ('incident', 'incident_reports'), ('crime map', 'crimemapping_embed'), ('activity', 'daily_activity_log'), ('press', 'press_releases'), ('alert', 'community_alerts'))], 'rss_feed')} as feed_type"))
def detect_feed_type(spark, sf_dir):
    return _names(spark, sf_dir).select("id", D.feed_type(F.col("kinds")).alias("feed_type"))


@query("detect_format", _named(f"id, {_case([(_has('lower(url)', '.pdf'), 'pdf'), (_has('lower(url)', 'rss', 'feed'), 'rss'), (_has('lower(url)', 'arcgis', 'data.'), 'json_api')], 'html')} as format"))
def detect_format(spark, sf_dir):
    return _names(spark, sf_dir).select("id", D.feed_format(F.col("url")).alias("format"))


_PAGE_URL = """case page_id % 11 when 0 then 'https://DATA.town.gov/x' when 1 then 'https://a.citizenrims.com' when 2 then 'https://b.crimegraphics.com' when 3 then 'https://local.nixle.com' when 4 then 'https://gis.arcgis.net' else url end"""
_PAGE_HTML = """case page_id % 13 when 5 then '<!-- CivicPlus -->' || html when 6 then html || ' evidence.com' when 7 then html || ' Mark43' when 8 then html || 'socrata' when 9 then html || 'gravel' when 10 then 'smart911' || html else html end"""
_PAGE_RULES = [(r"regexp_matches(url, '(?i)data\.[^/]+\.(gov|org)')", ("socrata", "url=data.*.gov/org"))]
for _p, _u, _h in K.PAGE_RULES:
    _PAGE_RULES += [(f"contains(url, '{t}')", (_p, f"url={t}")) for t in _u] + [(f"contains(html, '{t}')", (_p, f"html={t}")) for t in _h]


def _pages(spark, sf_dir):
    return load(spark, sf_dir, "pages")[0].selectExpr("page_id", f"{_PAGE_URL} as url", f"{_PAGE_HTML} as html")


_DETECTED = f"p as (select page_id, {_PAGE_URL} as url, {_PAGE_HTML} as html from pages), d as (select page_id, {_case([(c, v[0]) for c, v in _PAGE_RULES], None)} as platform, {_case([(c, 'homepage:' + v[1]) for c, v in _PAGE_RULES], None)} as evidence from p)"


@query("detect_platform_html", f"with {_DETECTED} select * from d")
def detect_platform_html(spark, sf_dir):
    found = D.platform_of_page(F.col("url"), F.col("html"), F.lit("homepage"))
    return _pages(spark, sf_dir).select("page_id", found.alias("d")).select("page_id", "d.platform", "d.evidence")


@query("enrich_platforms", f"with {_DETECTED} select page_id % 60 as agency_id, arg_min(platform, page_id) as platform, arg_min(evidence, page_id) as evidence from d where platform is not null group by 1")
def enrich_platforms(spark, sf_dir):
    """The first page of each agency, in order, that shows a platform."""
    found = detect_platform_html(spark, sf_dir).filter("platform is not null")
    return found.groupBy(F.expr("page_id % 60").alias("agency_id")).agg(F.min_by("platform", "page_id").alias("platform"), F.min_by("evidence", "page_id").alias("evidence"))


_T, _U = "lower(kinds)", "lower(url)"


@query(
    "infer_type_url",
    _named(
        f"""id, {_case([(_has(_T, 'press'), 'press_release'), (_has(_T, 'arrest'), 'arrest_log')], 'activity_feed')} as by_title,
        {_case([(_has(_U, 'blotter', 'arrest'), 'arrest_log'), (_has(_U, 'press', 'release'), 'press_release')], 'activity_feed')} as by_listing,
        {_case([(_has(_U, 'arrest', 'blotter'), 'arrest_log'), (_has(_U, 'press', 'release'), 'press_release'), (_has(_U, 'activity', 'log'), 'daily_activity_log')], 'pdf_library')} as by_pdf,
        {_case([(_has(_T, 'arrest', 'booking'), 'arrest_log'), (_has(_T, 'incident', 'crime', 'offense'), 'incident_reports'), (_has(_U, 'arrest', 'booking'), 'arrest_log'), (_has(_U, 'incident', 'crime'), 'incident_reports')], 'open_data_api')} as by_row"""
    ),
)
def infer_type_url(spark, sf_dir):
    kinds, url = F.col("kinds"), F.col("url")
    return _names(spark, sf_dir).select("id", D.feed_title_type(kinds).alias("by_title"), D.listing_type(url).alias("by_listing"), D.pdf_type(url).alias("by_pdf"), D.open_data_type(kinds, url).alias("by_row"))


# Classification.
_LEGACY = "coalesce(" + "case document_type " + " ".join(f"when '{a}' then '{b}'" for a, b in K.LEGACY_TYPES.items()) + " end, document_type)"
_UTYPE = _case([(f"regexp_matches(lower(url), '{p}')", k) for p, k, _ in K.URL_SIGNALS], None)
_UBOOST = "case " + " ".join(f"when regexp_matches(lower(url), '{p}') then {b}" for p, _, b in K.URL_SIGNALS) + " end"
_TEXT = "lower(coalesce(title, '') || ' ' || substring(coalesce(raw_text, ''), 1, 300))"
_COUNTS = {k: "least(3, " + " + ".join(f"cast(contains(w, '{x}') as int)" for x in words) + ")" for k, words in K.KEYWORDS.items()}
_SIGNALS = f"""s as (select *, {_LEGACY} as legacy, {_UTYPE} as ut, cast({_UBOOST} as double) as ub, {_TEXT} as w, lower(platform_type) as p from docs),
    k as (select *, {', '.join(f'{c} as n_{k}' for k, c in _COUNTS.items())}, cast(case p {' '.join(f"when '{k}' then {v[1]}" for k, v in K.PLATFORM_PRIORS.items())} end as double) as prior, case p {' '.join(f"when '{k}' then '{v[0]}'" for k, v in K.PLATFORM_PRIORS.items())} end as pt from s),
    m as (select *, greatest({', '.join(f'n_{k}' for k in _COUNTS)}) as most from k),
    g as (select *, case when most = 0 then null {' '.join(f"when n_{k} = most then '{k}'" for k in _COUNTS)} end as kt, case when most > 0 then most * 0.1::double end as kb, coalesce(prior, 0.5::double) as base from m)"""
_VALID = ", ".join(f"'{v}'" for v in K.VALID_TYPES)
_PICK = [("prior >= 0.9", "pt", "prior"), ("ut is not null and kt is not null and ut = kt", "ut", "base + ub + kb"), ("ut is not null and kt is not null and kb < ub", "ut", "base + ub"), ("kt is not null", "kt", "base + kb"), ("ut is not null", "ut", "base + ub"), ("pt is not null", "pt", "prior"), (f"legacy in ({_VALID})", "legacy", "0.55")]


@query("legacy_type_normalize", f"select doc_id, {_LEGACY} as document_type from docs")
def legacy_type_normalize(spark, sf_dir):
    return load(spark, sf_dir, "docs")[0].select("doc_id", C.legacy_type(F.col("document_type")).alias("document_type"))


@query("url_signal", f"with {_SIGNALS} select doc_id, ut as type, ub as boost from g")
def url_signal(spark, sf_dir):
    return load(spark, sf_dir, "docs")[0].select("doc_id", C.url_signal(F.col("url")).alias("s")).select("doc_id", "s.type", "s.boost")


@query("keyword_signal", f"with {_SIGNALS} select doc_id, kt as type, round(kb, 6) as boost from g")
def keyword_signal(spark, sf_dir):
    return load(spark, sf_dir, "docs")[0].select("doc_id", C.keyword_signal(F.col("title"), F.col("raw_text")).alias("s")).select("doc_id", "s.type", F.round("s.boost", 6).alias("boost"))


@query("classify_docs", f"with {_SIGNALS} select doc_id, case {' '.join(f'when {c} then {t}' for c, t, _ in _PICK)} else 'press_release' end as type, round(least(1.0::double, case {' '.join(f'when {c} then {v}' for c, _, v in _PICK)} else 0.4 end), 6) as confidence from g")
def classify_docs(spark, sf_dir):
    c = F.col
    return load(spark, sf_dir, "docs")[0].select("doc_id", C.classify(c("document_type"), c("url"), c("title"), c("raw_text"), c("platform_type")).alias("r")).select("doc_id", "r.type", "r.confidence")


_PLATFORM_KEYS = ("arcgis", "citizenrims", "civicplus", "crimemapping", "nixle", "pdf", "rss", "socrata")
_ROUTES = "case when lower(platform_type) = 'rave' then 'nixle' when lower(platform_type) in (" + ", ".join(f"'{k}'" for k in _PLATFORM_KEYS) + ") then lower(platform_type) end"


@query("platform_routing", f"select doc_id, case when {_ROUTES} = 'crimemapping' and doc_id % 2 = 0 then null else {_ROUTES} end as parser from docs")
def platform_routing(spark, sf_dir):
    """The parser of each document's platform; the map source needs an external id."""
    from millrace.sources.parsers import route

    return load(spark, sf_dir, "docs")[0].select("doc_id", route(F.col("platform_type"), F.when(F.expr("doc_id % 2 <> 0"), F.col("doc_id"))).alias("parser"))


@query("route_by_url", "select doc_id, case when regexp_matches(url, '(?i)/(rss|feed)') then 'rss' else 'nixle' end as parser from (select doc_id, case when doc_id % 3 = 0 then url || '/RSS/1' when doc_id % 3 = 1 then url || '/feeds' else url end as url from docs)")
def route_by_url(spark, sf_dir):
    from millrace.sources.parsers import alert_route

    rows = load(spark, sf_dir, "docs")[0].selectExpr("doc_id", "case when doc_id % 3 = 0 then url || '/RSS/1' when doc_id % 3 = 1 then url || '/feeds' else url end as url")
    return rows.select("doc_id", alert_route(F.col("url")).alias("parser"))


_TOWNS = "select 'Town' || cast(c_custkey as string) as word from customer union all select 'Town' || cast(c_custkey as string) || ' North' from customer where c_custkey % 2 = 0"
_OF_ORDERS = "select o_orderkey, 'Town' || cast(o_custkey as string) || case o_orderkey % 4 when 0 then ' North Police' when 1 then ' Police' when 2 then '' else 'x North' end as name from orders"


@query("longest_prefix_table", f"with w as ({_TOWNS}), n as ({_OF_ORDERS}) select o_orderkey, (select arg_max(word, length(word)) from w where n.name = w.word or starts_with(n.name, w.word || ' ')) as prefix from n")
def longest_prefix_table(spark, sf_dir):
    """The longest word of a table that a name starts with: more words than a plan could hold."""
    customer, orders = load(spark, sf_dir, "customer", "orders")
    words = spark.sql(_TOWNS.replace("from customer", "from {customer}"), customer=customer)
    return longest_prefixes(spark.sql(_OF_ORDERS.replace("from orders", "from {orders}"), orders=orders), "o_orderkey", "name", words)
