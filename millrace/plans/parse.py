"""Parser queries. Responses are built from table rows, so oracles know what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.sources import parsers as P
from millrace.sources.standins import load

from .base import query

_P = "cast(p_partkey as string)"
_COMMON = "document_type, title, raw_text, published_date"


def _parts(spark, sf_dir, *columns):
    return load(spark, sf_dir, "part")[0].selectExpr("p_partkey", *columns)


_DAY = "date_add(date '2024-01-01', cast(p_partkey % 300 as int))"
_ORACLE_DAY = "cast(date '2024-01-01' + cast(p_partkey % 300 as int) as timestamp)"


@query(
    "parse_civicplus",
    f"""select p_partkey, 0 as pos, case when p_partkey % 3 = 0 then 'https://town.org/CivicAlerts.aspx?AID=' || {_P} else 'https://town.org/' || case when p_partkey % 2 = 0 then 'press' else 'blotter' end || '/item/' || {_P} end as url,
        case when p_partkey % 2 = 0 then 'press_release' else 'arrest_log' end as document_type, p_name as title, p_name || '. ' || p_type || ' & ' || p_brand as raw_text, {_ORACLE_DAY} as published_date from part""",
)
def parse_civicplus(spark, sf_dir):
    modern = f"""'<ul><li class="list-group-item x"><h3><a class="article-title-link" href="/CivicAlerts.aspx?AID=' || {_P} || '">' || p_name || '</a></h3><div class="article-preview">' || p_type || ' &amp;<br> ' || p_brand || '</div><div class="article-list-footer"><span class="fst-italic">Posted on ' || date_format({_DAY}, 'MMMM d, yyyy') || ' | Last Updated</span></div></li></ul>'"""
    plain = f"""'<article><h2> ' || p_name || '</h2><a href="item/' || {_P} || '">more</a><p>' || p_type || ' <b>&amp; ' || p_brand || '</b></p><time datetime="' || cast({_DAY} as string) || 'T00:00:00">x</time></article>'"""
    rows = _parts(spark, sf_dir, "case when p_partkey % 2 = 0 then 'https://town.org/press/' else 'https://town.org/blotter/' end as url", f"case when p_partkey % 3 = 0 then {modern} else {plain} end as html")
    return P.parse_listing(rows, ["p_partkey"]).drop("metadata")


@query(
    "parse_nixle",
    f"""select p_partkey, 0 as pos, 'https://' || case when p_partkey % 2 = 0 then 'local.nixle.com' else 'rave.town.org' end || '/alert/' || {_P} || '/' as url, p_name as title, p_name || '. ' || p_type as raw_text, {_ORACLE_DAY} as published_date,
        {_P} as alert_id, case when p_partkey % 2 = 0 then 'nixle' else 'rave' end as platform from part""",
)
def parse_nixle(spark, sf_dir):
    html = f"""case when p_partkey % 2 = 0 then '<div class="alert-item"><h2><a href="/alert/' || {_P} || '/">' || p_name || '</a></h2><div class="alert-body">' || p_type || '</div><time datetime="' || cast({_DAY} as string) || '">x</time></div>'
        else '<div class="alertItem"><a href="/help">?</a><h4>' || p_name || '</h4><a href="/alert/' || {_P} || '/">read</a><div class="alertContent">' || p_type || '</div><span class="alertDate">' || date_format({_DAY}, 'MMM d, yyyy') || '</span></div>' end"""
    rows = _parts(spark, sf_dir, "case when p_partkey % 2 = 0 then 'https://local.nixle.com/city' else 'https://rave.town.org/all' end as url", f"{html} as html")
    return P.parse_alerts(rows, ["p_partkey"]).select("p_partkey", "pos", "url", "title", "raw_text", "published_date", F.col("metadata.nixle_alert_id").alias("alert_id"), F.col("metadata.platform").alias("platform"))


_AT = "cast(d as timestamp) + to_minutes(h * 60 + m)"


@query(
    "parse_citizenrims",
    f"select p_partkey, 0 as pos, p_type as title, p_type || ' at ' || {_P} || ' Oak St at ' || p_name || ' noted' as raw_text, {_ORACLE_DAY} + to_minutes(cast(p_partkey % 60 as int)) as published_date, {_P} || ' Oak St' as address from part",
)
def parse_citizenrims(spark, sf_dir):
    stamp = f"date_format({_DAY}, 'MM/dd/yyyy') || ' 00:' || lpad(cast(p_partkey % 60 as string), 2, '0')"
    html = f"""'<table class="' || case when p_partkey % 2 = 0 then 'table' else 'incidents' end || '"><thead><tr><th>When</th></tr></thead><tbody><tr><th>none</th></tr><tr><td>' || {stamp} || '</td><td>' || p_type || '</td><td>' || {_P} || ' Oak St</td><td>' || p_name || ' noted</td></tr></tbody></table>'"""
    rows = _parts(spark, sf_dir, "'https://pd.citizenrims.com/x' as url", f"{html} as html")
    return P.parse_incident_table(rows, ["p_partkey"]).select("p_partkey", "pos", "title", "raw_text", "published_date", F.col("metadata.address").alias("address"))


@query("assign_cell_roles", f"select p_partkey, case when p_partkey % 2 = 0 then '2024-02-03' else p_type end as date, p_type as type, {_P} || ' Elm Ave' as address, case when p_partkey % 2 = 0 then p_name || ' noted' end as description from part")
def assign_cell_roles(spark, sf_dir):
    rows = _parts(spark, sf_dir, f"case when p_partkey % 2 = 0 then array({_P} || ' Elm Ave', p_type, '2024-02-03', p_name || ' noted') else array(p_type, {_P} || ' Elm Ave') end as cells")
    return rows.select("p_partkey", P.cell_roles(F.col("cells")).alias("r")).select("p_partkey", "r.date", "r.type", "r.address", "r.description")


@query(
    "parse_rss",
    f"""select p_partkey, i as pos, case when i = 0 then 'https://town.org/n/' || {_P} else 'https://town.org/rss/' || {_P} end as url, case p_partkey % 3 when 0 then 'press_release' when 1 then 'arrest_log' else 'activity_feed' end as document_type,
        case when i = 0 then p_name end as title, case when i = 0 then 'Full ' || p_type else p_brand end as raw_text, case when i = 0 then {_ORACLE_DAY} + interval 8 hour else {_ORACLE_DAY} end as published_date from part, (values (0), (1)) v(i)""",
)
def parse_rss(spark, sf_dir):
    xml = f"""'<rss><channel><title>' || case p_partkey % 3 when 0 then 'Press room' when 1 then 'Arrests' else 'Daily' end || '</title><item><title>' || p_name || '</title><link>https://town.org/n/' || {_P} || '</link><description>short</description><content:encoded>Full  ' || p_type || '</content:encoded><pubDate>'
        || date_format({_DAY}, 'EEE, dd MMM yyyy') || ' 00:00:00 -0800</pubDate></item><item><description>' || p_brand || '</description><updated>' || cast({_DAY} as string) || 'T00:00:00</updated></item></channel></rss>'"""
    rows = _parts(spark, sf_dir, f"'https://town.org/rss/' || {_P} as url", f"{xml} as xml")
    return P.parse_feed(rows, ["p_partkey"]).drop("metadata")


@query(
    "parse_crimemapping",
    f"""select p_partkey, 0 as pos, 'https://www.crimemapping.com/map/agency/' || cast(p_partkey % 50 as string) as url, p_type as title, trim(p_type || ' at ' || case when p_partkey % 2 = 0 then '1 Oak St ' else '' end || 'on ' || case when p_partkey % 3 = 0 then '' else strftime({_ORACLE_DAY}, '%m/%d/%Y') || ' 01:05:00 PM' end || '. ' || p_name) as raw_text,
        case when p_partkey % 3 = 0 then null else {_ORACLE_DAY} + interval 785 minute end as published_date, 'C' || {_P} as case_number from part""",
)
def parse_crimemapping(spark, sf_dir):
    payload = f"""'{{"TotalRecords":1,"Incidents":[{{"TypeDescription":"' || p_type || '","Address":' || case when p_partkey % 2 = 0 then '"1 Oak  St"' else 'null' end || ',"CaseNumber":"C' || {_P} || '","Description":"' || p_name || '"' || case when p_partkey % 3 = 0 then '' else ',"DateOccurred":"' || date_format({_DAY}, 'MM/dd/yyyy') || ' 01:05:00 PM"' end || '}}]}}'"""
    rows = _parts(spark, sf_dir, "p_partkey % 50 as map_id", f"{payload} as payload")
    return P.parse_incident_map(rows, ["p_partkey"]).select("p_partkey", "pos", "url", "title", "raw_text", "published_date", F.col("metadata.case_number").alias("case_number"))


@query(
    "parse_socrata",
    f"""select p_partkey, i as pos, case when i = 0 then 'arrest_log' else 'incident_reports' end as document_type, case when i = 0 then 'Booking' end as title, case when i = 0 then 'crm_cd_desc: Booking; date_occ: ' || strftime({_ORACLE_DAY}, '%Y-%m-%d') || 'T00:00:00.000; dr_no: ' || {_P} else 'address: ' || p_name || '; id: 9' end as raw_text,
        case when i = 0 then {_ORACLE_DAY} end as published_date, case when i = 0 then {_P} else '9' end as report_number, case when i = 1 then p_name end as location, 'ab12-cd34' as dataset_id, 'data.town.gov' as domain from part, (values (0), (1)) v(i)""",
)
def parse_socrata(spark, sf_dir):
    payload = f"""'[{{"dr_no":"' || {_P} || '","crm_cd_desc":"Booking","date_occ":"' || cast({_DAY} as string) || 'T00:00:00.000",":sid":"1","none":null}},{{"id":9,"address":"' || p_name || '"}}]'"""
    rows = _parts(spark, sf_dir, "'https://data.town.gov/resource/ab12-cd34.json?crime=1' as url", "0 as offset", f"{payload} as payload")
    m = F.col("metadata")
    return P.parse_open_data(rows, ["p_partkey"]).select("p_partkey", "pos", "document_type", "title", "raw_text", "published_date", m["report_number"].alias("report_number"), m["location"].alias("location"), m["dataset_id"].alias("dataset_id"), m["domain"].alias("domain"))


@query(
    "parse_arcgis",
    f"""select p_partkey, 0 as pos, 'incident_reports' as document_type, 'Offense' as title, 'CRIME_TYPE: Offense; DATE_OCC: ' || cast(epoch_ms({_ORACLE_DAY}) as string) || '; OBJECTID: ' || {_P} as raw_text, {_ORACLE_DAY} as published_date, {_P} as report_number from part where p_partkey % 4 <> 3""",
)
def parse_arcgis(spark, sf_dir):
    payload = f"""case when p_partkey % 4 = 3 then '{{"error":{{"code":400}}}}' else '{{"features":[{{"attributes":{{"OBJECTID":' || {_P} || ',"CRIME_TYPE":"Offense","ADDRESS":-1,"DATE_OCC":' || cast(unix_date({_DAY}) * 86400000L as string) || '}},"geometry":{{"x":1.5,"y":2}}}}]}}' end"""
    rows = _parts(spark, sf_dir, "'https://gis.town.gov/query' as url", "0 as offset", f"{payload} as payload")
    return P.parse_features(rows, ["p_partkey"]).select("p_partkey", "pos", "document_type", "title", "raw_text", "published_date", F.col("metadata.report_number").alias("report_number"))


@query("pdf_page_clean", "select p_partkey, p_name || ' example ' || p_type as text from part")
def pdf_page_clean(spark, sf_dir):
    return _parts(spark, sf_dir, f"p_name || chr(10) || '  12  ' || chr(10) || 'exam-' || chr(10) || 'ple' || chr(10) || ' Page 1 of 9' || chr(10) || p_type as t").select("p_partkey", P.clean_page(F.col("t")).alias("text"))


@query(
    "assemble_pdf",
    f"""select p_partkey, i as pos, 'https://town.org/log/' || {_P} || '.pdf' as url, 'daily_activity_log' as document_type, strftime({_ORACLE_DAY}, '%B') || ' ' || cast(day({_ORACLE_DAY}) as string) || ', 2024' as title,
        strftime({_ORACLE_DAY}, '%B') || ' ' || cast(day({_ORACLE_DAY}) as string) || ', 2024 ' || case when i = 0 then p_name else p_type end as raw_text, {_ORACLE_DAY} as published_date from part, (values (0), (1)) v(i) where p_partkey % 2 = 0
        union all select p_partkey, 0, 'https://town.org/log/' || {_P} || '.pdf', 'daily_activity_log', null, strftime({_ORACLE_DAY}, '%B') || ' ' || cast(day({_ORACLE_DAY}) as string) || ', 2024 ' || p_name || ' ' || p_type, null from part where p_partkey % 2 = 1""",
)
def assemble_pdf(spark, sf_dir):
    day = f"date_format({_DAY}, 'MMMM d, yyyy')"
    pages = f"case when p_partkey % 2 = 0 then array({day} || chr(10) || p_name, '  ', {day} || chr(10) || p_type) else array({day} || chr(10) || p_name, p_type) end as pages"
    return P.assemble_pdf(_parts(spark, sf_dir, f"'https://town.org/log/' || {_P} || '.pdf' as url", pages), ["p_partkey"]).drop("metadata")


@query("ocr_confidence", "select p_partkey, case when p_partkey % 5 = 0 then null else round_even((p_size + 50.25) / 2, 1) end as avg_ocr_confidence, case when p_partkey % 5 = 0 then null when (p_size + 50.25) / 2 < 40 then 'low' else 'low' end as ocr_confidence from part")
def ocr_confidence(spark, sf_dir):
    rows = _parts(spark, sf_dir, "case when p_partkey % 5 = 0 then array(cast(null as double), -1D) else array(cast(p_size as double), -1D, 50.25D, null) end as cs")
    return rows.select("p_partkey", P.ocr_summary(F.col("cs")).alias("o")).select("p_partkey", "o.avg_ocr_confidence", "o.ocr_confidence")


# Candidate links of a home page.
_NEWS = "news|press|release|alert|blotter|arrest|log|crime|activity|incident"
_LINKS = f"""links as (select p_partkey, i, case i when 0 then 'https://t' || {_P} || '.org/news' when 1 then 'https://t' || {_P} || '.org/Police-Blotter' else 'https://t' || {_P} || '.org/dir/crime/' || {_P} end as url from part, (values (0), (1), (2)) v(i))"""


def _home_links(spark, sf_dir):
    from millrace.sources.discovery import candidate_links

    html = f"""'<a href=" /news ">a</a><a href="#news">b</a><a href="https://other.org/news">c</a><a href="mailto:news@x.org">d</a><a href="/about">e</a><a href=''Police-Blotter''>f</a><a href="/news">g</a><a href="dir/crime/' || {_P} || '">h</a>'"""
    rows = load(spark, sf_dir, "part")[0].selectExpr("p_partkey", f"'https://t' || {_P} || '.org/' as homepage", f"{html} as html".replace("''", "\\'"))
    return candidate_links(rows, "p_partkey", "homepage", "html")


@query("candidate_links", f"with {_LINKS} select p_partkey, cast(i as int) as pos, url from links")
def candidate_links(spark, sf_dir):
    return _home_links(spark, sf_dir)


@query("first_working_url", f"with {_LINKS} select p_partkey, arg_min(url, i) as url from links where (p_partkey + i) % 3 = 1 group by 1")
def first_working_url(spark, sf_dir):
    from millrace.sources.discovery import first_working

    links = _home_links(spark, sf_dir).withColumn("docs", F.expr("case when (p_partkey + pos) % 3 = 1 then 5 else 0 end"))
    return first_working(links, "p_partkey", "pos", "docs")


@query("scan_csv_pipe", "select c_custkey as id, c_name || ' PD' as name, case when c_custkey % 2 = 0 then 'yes' else 'no' end as active from customer")
def scan_csv_pipe(spark, sf_dir):
    """A pipe-delimited registry file, written by the report sink and read back."""
    from millrace.sources.discovery import read_pipe_csv, report_lines

    rows = load(spark, sf_dir, "customer")[0].selectExpr("c_custkey as id", "c_name || ' PD' as name", "case when c_custkey % 2 = 0 then 'yes' else 'no' end as active")
    return read_pipe_csv(report_lines(rows), "id bigint, name string, active string")
