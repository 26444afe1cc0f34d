"""Cleaning, date, address and open-data row queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import clean as C
from millrace.functions import constants as K
from millrace.functions import dates as T
from millrace.functions import maps as M
from millrace.functions import urls as U
from millrace.sources.standins import load

from .base import query

# Lines that reach every rule set, between parts of the documents' own texts.
_NOISE = """case doc_id % 10 when 0 then 'Share this page | Print | Email' when 1 then 'Home > Residents' when 2 then 'Sign up for alerts now' when 3 then 'This site uses cookies to work. Fine' when 4 then 'Powered by CivicPlus'
    when 5 then 'View map Download report' when 6 then 'Status:' when 7 then 'Sent via Nixle. Reply STOP to cancel' when 8 then 'CONFIDENTIAL' else 'Back to top' end"""
_KEPT = """case doc_id % 7 when 0 then 'Case No. 24-0007 Home > Residents' when 1 then '12 N Main Street St. view map' when 2 then 'On 1/2/2024 share this page' when 3 then '2024-05-06 back to top' when 4 then 'January 5, 2024 powered by civicplus' when 5 then 'Call 555-123-4567 view map' else '(555) 123-4567 view map' end"""
_TEXT = f"raw_text || chr(10) || {_NOISE} || chr(10) || {_KEPT} || chr(10) || '  Page ' || cast(doc_id % 9 as string) || ' of 9  ' || chr(10) || chr(10) || chr(10) || 'exam-' || chr(10) || 'ple' || chr(9) || ' end  '"
_CLEAN_DOCS = f"select doc_id, lower(platform_type) as platform, {_TEXT} as t from docs"


def _rows(spark, sf_dir):
    (docs,) = load(spark, sf_dir, "docs")
    return spark.sql(_CLEAN_DOCS.replace("from docs", "from {docs}"), docs=docs)


def _with(select):
    return f"with c as ({_CLEAN_DOCS}) {select}"


@query("clean_pdf_hyphen", _with(r"select doc_id, regexp_replace(t, '([A-Za-z0-9_])-\n([A-Za-z0-9_])', '\1\2', 'g') as t from c"))
def clean_pdf_hyphen(spark, sf_dir):
    return _rows(spark, sf_dir).select("doc_id", C.join_hyphens(F.col("t")).alias("t"))


@query("clean_page_markers", _with(r"select doc_id, regexp_replace(t, '(?m)^\s*[Pp]age\s+\d+\s+of\s+\d+\s*$', '', 'g') as t from c"))
def clean_page_markers(spark, sf_dir):
    return _rows(spark, sf_dir).select("doc_id", C.remove_page_markers(F.col("t")).alias("t"))


@query("clean_nonprintable", _with(r"select doc_id, replace(replace(t, chr(7), ''), chr(173), '') as t from (select doc_id, t || chr(7) || 'a' || chr(173) || 'b' as t from c)"))
def clean_nonprintable(spark, sf_dir):
    return _rows(spark, sf_dir).select("doc_id", C.remove_nonprintable(F.expr("t || chr(7) || 'a' || decode(unhex('C2AD'), 'UTF-8') || 'b'")).alias("t"))


@query(
    "clean_whitespace_lines",
    _with(r"select doc_id, trim(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(t, '[ \t]+', ' ', 'g'), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(10))), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(13) || chr(10)) as t from c"),
)
def clean_whitespace_lines(spark, sf_dir):
    return _rows(spark, sf_dir).select("doc_id", C.tidy_whitespace(F.col("t")).alias("t"))


@query("squash_whitespace", _with(r"select doc_id, trim(regexp_replace(t, '\s+', ' ', 'g')) as t from c"))
def squash_whitespace(spark, sf_dir):
    return _rows(spark, sf_dir).select("doc_id", M.squash(F.col("t")).alias("t"))


@query("clean_protected_lines", _with("select doc_id, true as kept, false as noise from c"))
def clean_protected_lines(spark, sf_dir):
    (docs,) = load(spark, sf_dir, "docs")
    rows = docs.selectExpr("doc_id", f"{_KEPT} as kept", f"{_NOISE} as noise")
    return rows.select("doc_id", C.protected(F.col("kept")).alias("kept"), C.protected(F.col("noise")).alias("noise"))


# Letters, digits, blanks and edges of words as the rules mean them, in all scripts, for an engine whose own are of ASCII.
_WORD, _BLANK = r"\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}\x{200c}\x{200d}", r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _in_all_scripts(pattern):
    """A pattern that begins and ends with a word edge at most, for a test whether it matches anywhere."""
    head, tail = pattern.startswith(r"\b"), pattern.endswith(r"\b")
    pattern = pattern[2 if head else 0 : -2 if tail else None].removesuffix(r"\.?" if tail else "\0")
    pattern = pattern.replace(r"[\w\s]", f"[{_WORD}{_BLANK}]").replace(r"[\w-]", f"[{_WORD}-]").replace(r"[#:\s]", f"[#:{_BLANK}]").replace(r"[-.\s]", f"[-.{_BLANK}]")
    pattern = pattern.replace(r"\d", r"\p{Nd}").replace(r"\s", f"[{_BLANK}]")
    return (f"(?:^|[^{_WORD}])" if head else "") + pattern + (f"(?:$|[^{_WORD}])" if tail else "")


_SAFE = " or ".join(f"regexp_matches(x, '{'(?i)' if i else ''}{_in_all_scripts(p)}')" for p, i in K.PROTECTED)


@query("clean_protected_text", _with(f"select doc_id, cast(len(list_filter(string_split(t, chr(10)), lambda x: {_SAFE})) as int) as lines from c"))
def clean_protected_text(spark, sf_dir):
    """How many lines of each whole text are protected."""
    return _rows(spark, sf_dir).select("doc_id", F.when(F.col("t").isNotNull(), F.size(F.filter(F.split("t", "\n", -1), C.protected))).alias("lines"))


# The whole text, then lines that reach every rule.
_LINES = f"raw_text || chr(10) || {_NOISE} || chr(10) || {_KEPT} || chr(10) || 'Nothing to see | © 2024 Town of Oak. Follow us on X' || chr(10) || 'Show all' || chr(10) || 'FRESNO VALLEY POLICE'"
_PLATFORM = "case doc_id % 6 when 0 then 'civicplus' when 1 then 'nixle' when 2 then 'crimemapping' when 3 then 'pdf' when 4 then 'RAVE' else 'unlisted' end"


def _cleaned_line(rules):
    line = "x"
    for pattern, ignore_case in rules:
        flags = "(?is)" if ignore_case else "(?s)"
        line = f"regexp_replace({line}, '{flags}{pattern}{'.*$' if pattern[0] == '^' else ''}', '{'' if pattern[0] == '^' else ' '}', 'g')"
    return line


def _cleaned(platform):
    safe = " or ".join(f"regexp_matches(x, '{'(?i)' if i else ''}{p}')" for p, i in K.PROTECTED)
    return f"array_to_string(list_transform(string_split(t, chr(10)), lambda x: case when {safe} then x else {_cleaned_line(K.BOILERPLATE[platform])} end), chr(10))"


@query(
    "clean_boilerplate",
    f"""with l as (select doc_id, {_PLATFORM} as platform, {_LINES} as t from docs) select doc_id, platform, case platform when 'civicplus' then {_cleaned('civicplus')} when 'nixle' then {_cleaned('nixle')} when 'RAVE' then {_cleaned('nixle')}
        when 'crimemapping' then {_cleaned('crimemapping')} when 'pdf' then {_cleaned('pdf')} else {_cleaned('default')} end as cleaned from l""",
)
def clean_boilerplate(spark, sf_dir):
    rows = load(spark, sf_dir, "docs")[0].selectExpr("doc_id", f"{_PLATFORM} as platform", f"{_LINES} as t")
    return rows.select("doc_id", "platform", C.remove_boilerplate(F.col("t"), F.col("platform")).alias("cleaned"))


@query("quality_score", _with(r"""select doc_id, cast(case when length(trim(b, ' ' || chr(9) || chr(10))) < 50 then least(30, s) else s end as int) as score from (select doc_id, b, least(100, greatest(0, 100 - cast(trunc((length(t) - length(b)) / length(t) * 80) as int))
    + case when regexp_matches(b, '(?i)\b(?:\d{1,2}/\d{1,2}/\d{4}|\d{4}-\d{2}-\d{2}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},\s+\d{4})\b') then 10 else 0 end
    + case when regexp_matches(b, '(?i)\b(CAD|DR|case|report\s+no\.?|incident)[#:\s]+[\w-]+') then 10 else 0 end
    + case when regexp_matches(b, '(?i)\b\d+\s+(?:[NSEW]\.?\s+)?[A-Za-z][\w\s]+\s+(?:St|Ave|Blvd|Dr|Rd|Ln|Way|Ct|Pl|Hwy|Fwy|Pkwy|Cir|Ter|Loop)\.?\b') then 5 else 0 end) as s
    from (select doc_id, k as t, substring(k, 1, cast(doc_id % 60 as int)) || ' ' || substring(k, 30, 40) as b from (select doc_id, 'Report of ' || """ + _KEPT + r""" || ' and so on, nothing more to say about it at this time of the day' as k from docs)))"""))  # fmt: skip
def quality_score(spark, sf_dir):
    (docs,) = load(spark, sf_dir, "docs")
    rows = docs.selectExpr("doc_id", f"'Report of ' || {_KEPT} || ' and so on, nothing more to say about it at this time of the day' as t")
    rows = rows.selectExpr("doc_id", "t", "substring(t, 1, cast(doc_id % 60 as int)) || ' ' || substring(t, 30, 40) as b")
    return rows.select("doc_id", C.quality_score(F.col("t"), F.col("b")).alias("score"))


_BONUS = " + ".join(f"case when regexp_matches(b, '(?i){_in_all_scripts(p)}') then {n} else 0 end" for p, n in ((K.SCORE_DATE, 10), (K.SCORE_ID, 10), (K.SCORE_ADDRESS, 5)))


@query(
    "quality_score_text",
    _with(rf"""select doc_id, cast(case when t is null or length(t) = 0 then 0 when length(trim(b)) < 50 then least(30, s) else s end as int) as score from (select doc_id, t, b, least(100, greatest(0, 100 - cast(trunc((length(t) - length(b)) / length(t) * 80) as int)) + {_BONUS}) as s
    from (select doc_id, t, trim(regexp_replace(t, '\s+', ' ', 'g')) as b from c))"""),
)
def quality_score_text(spark, sf_dir):
    """Whole texts and what single blanks leave of them."""
    return _rows(spark, sf_dir).select("doc_id", C.quality_score(F.col("t"), M.squash(F.col("t"))).alias("score"))


@query("clean_strip_html", "select p_partkey, chr(10) || chr(10) || p_name || chr(10) || p_type || ' & more' || chr(10) || chr(10) || ' tail' || chr(10) || chr(10) || p_brand || chr(10) || chr(10) as text from part")
def clean_strip_html(spark, sf_dir):
    page = F.expr("'<style>p{}</style><p class=\"a\">' || p_name || '<br/>' || p_type || ' &amp; <b>more</b></p><!-- ad --> tail<script>var t=\"</p>\";</script><div>' || p_brand || '</div>'")
    return load(spark, sf_dir, "part")[0].select("p_partkey", C.strip_html(page).alias("text"))


@query("clean_dedup_sentences", "select p_partkey, 'The ' || p_name || ' was found near the river bank today.' || chr(10) || chr(10) || 'Quite another ' || p_type || ' thing happened.' || chr(10) || chr(10) || 'No.' as text from part")
def clean_dedup_sentences(spark, sf_dir):
    t = F.expr("'The ' || p_name || ' was found near the river bank today. The ' || p_name || ' was found near the river bank todaY! Quite another ' || p_type || ' thing happened.' || chr(10) || chr(10) || chr(10) || ' No. No. ' ")
    return load(spark, sf_dir, "part")[0].select("p_partkey", C.dedup_sentences(t).alias("text"))


@query("clean_dedup_text")
def clean_dedup_text(spark, sf_dir):
    """Whole texts without nearly equal sentences; no oracle, a unit test has the plain loop."""
    return load(spark, sf_dir, "docs")[0].select("doc_id", C.dedup_sentences(F.col("raw_text")).alias("text"))


@query("clean_unescape_pages")
def clean_unescape_pages(spark, sf_dir):
    """Whole pages with their character references decoded; no oracle, a unit test has the standard library's."""
    return load(spark, sf_dir, "pages")[0].select("page_id", C.unescape(F.col("html")).alias("text"))


@query("clean_unescape", "select doc_id, 'a & b < c > d \" ' || chr(233) || ' ' || cast(doc_id as string) as text from docs")
def clean_unescape(spark, sf_dir):
    return load(spark, sf_dir, "docs")[0].select("doc_id", C.unescape(F.expr("'a &amp; b &lt; c &gt; d &quot; &eacute; ' || cast(doc_id as string)")).alias("text"))


_PAGE = "'<html><head><style>x{}</style></head><p>Home</p><p>Officers met at ' || cast(p_partkey as string) || ' Oak St. on 1/2/2024 about case 24-' || cast(p_partkey as string) || '.</p><p>Tom &amp;amp; ' || p_name || '</p><p>Page 1 of 2</p><p>Back to top</p></html>'"
_CLEAN = "'Officers met at ' || cast(p_partkey as string) || ' Oak St. on 1/2/2024 about case 24-' || cast(p_partkey as string) || '.' || chr(10) || chr(10) || 'Tom & ' || p_name"


@query("clean_document", f"with d as (select p_partkey, {_PAGE} as page, {_CLEAN} as cleaned_text from part) select p_partkey, cleaned_text, cast(least(100, 100 - cast(trunc((length(page) - length(cleaned_text)) / length(page) * 80) as int) + 25) as int) as quality_score from d")
def clean_document(spark, sf_dir):
    rows = load(spark, sf_dir, "part")[0].selectExpr("p_partkey", f"{_PAGE} as page")
    return rows.select("p_partkey", C.clean(F.col("page"), F.lit(None).cast("string")).alias("c")).select("p_partkey", "c.cleaned_text", "c.quality_score")


@query("clean_pages")
def clean_pages(spark, sf_dir):
    """Whole raw web pages, by platform; unit tests hold the cleaner against stated results."""
    platform = F.expr("case page_id % 4 when 0 then 'civicplus' when 1 then 'nixle' when 2 then 'pdf' else null end")
    return load(spark, sf_dir, "pages")[0].select("page_id", C.clean(F.col("html"), platform).alias("c")).select("page_id", "c.cleaned_text", "c.quality_score")


@query("review_candidates", "select doc_id, 'low_parse_quality' as reason, cast(least(100, length(raw_text) // 40) as int) as score from docs where least(100, length(raw_text) // 40) < 30")
def review_candidates(spark, sf_dir):
    (docs,) = load(spark, sf_dir, "docs")
    return docs.withColumn("score", F.expr("cast(least(100, length(raw_text) div 40) as int)")).filter("score < 30").select("doc_id", F.lit("low_parse_quality").alias("reason"), "score")


# Dates: each form of a known instant, so the oracle needs no parser.
_D = "date '2024-01-01' + cast(event_id % 360 as int)"
_EVENT_DAYS = f"select event_id, {_D} as d, cast(event_id % 24 as int) as h, cast(event_id % 60 as int) as m from events"
_AS_TS = "cast(d as timestamp)"


def _days(spark, sf_dir):
    (events,) = load(spark, sf_dir, "events")
    return spark.sql(_EVENT_DAYS.replace("from events", "from {events}").replace("date '2024-01-01' + cast(event_id % 360 as int)", "date_add(date '2024-01-01', cast(event_id % 360 as int))"), events=events)


@query("parse_dates_prefixed", f"with e as ({_EVENT_DAYS}) select event_id, case when event_id % 6 = 5 then null else {_AS_TS} end as at from e")
def parse_dates_prefixed(spark, sf_dir):
    t = F.expr("""case event_id % 6 when 0 then 'Posted on ' || date_format(d, 'MMMM d, yyyy') when 1 then 'Last updated on ' || date_format(d, 'MMM d, yyyy') || ' | by staff' when 2 then 'Updated: ' || date_format(d, 'M/d/yyyy')
        when 3 then date_format(d, 'yyyy-MM-dd') when 4 then date_format(d, 'yyyy-MM-dd') || 'T00:00:00' else 'yesterday' end""")
    return _days(spark, sf_dir).select("event_id", T.listing_date(t).alias("at"))


@query("parse_dates_multi", f"with e as ({_EVENT_DAYS}) select event_id, case when event_id % 5 = 4 then null when event_id % 5 in (1, 2) then {_AS_TS} + to_minutes(h * 60 + m) else {_AS_TS} end as at from e")
def parse_dates_multi(spark, sf_dir):
    rows = _days(spark, sf_dir).withColumn("ts", F.expr("cast(d as timestamp_ntz) + make_dt_interval(0, h, m)"))
    texts = F.expr("case event_id % 5 when 0 then date_format(d, 'M/d/yyyy') when 1 then date_format(ts, 'M/d/yyyy  HH:mm') when 2 then date_format(ts, 'M/d/yyyy hh:mm:ss a') when 3 then date_format(d, 'yyyy-MM-dd') end")
    return rows.select("event_id", F.coalesce(T.table_date(texts), T.map_date(texts), T.alert_date(texts)).alias("at"))


@query("parse_dates_iso19", f"with e as ({_EVENT_DAYS}) select event_id, {_AS_TS} + to_minutes(h * 60 + m) as at from e")
def parse_dates_iso19(spark, sf_dir):
    rows = _days(spark, sf_dir).withColumn("ts", F.expr("cast(d as timestamp_ntz) + make_dt_interval(0, h, m)"))
    t = F.expr("date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") || case event_id % 3 when 0 then '.123' when 1 then '-08:00' else '' end")
    return rows.select("event_id", T.open_data_date(t).alias("at"))


@query("parse_epoch_ms", "select event_id, case when event_id % 5 in (0, 1) then timestamp '1970-01-01 00:00:00' + to_seconds(event_id * 86400) when event_id % 5 = 2 then timestamp '2024-01-15 08:30:00' end as at from events")
def parse_epoch_ms(spark, sf_dir):
    (events,) = load(spark, sf_dir, "events")
    t = F.expr("case event_id % 5 when 0 then cast(event_id * 86400000 as string) when 1 then ' ' || cast(event_id * 86400000 as string) || '.0 ' when 2 then '2024-01-15T08:30:00.000Z' when 3 then '-' || cast(event_id + 1 as string) else 'soon' end")
    return events.select("event_id", T.epoch_ms(t).alias("at"))


@query("parse_pdf_header_date", f"with e as ({_EVENT_DAYS}) select event_id, case when event_id % 4 = 3 then null else {_AS_TS} end as at from e")
def parse_pdf_header_date(spark, sf_dir):
    t = F.expr("case event_id % 4 when 0 then upper(date_format(d, 'EEEE, MMMM d, yyyy')) when 1 then date_format(d, 'MMMM d, yyyy') when 2 then date_format(d, 'M/d/yyyy') else 'Report ' || date_format(d, 'M/d/yyyy') end || ' log of calls'")
    return _days(spark, sf_dir).select("event_id", T.pdf_date(T.pdf_header(t)).alias("at"))


@query("recent_records", "select run_id, agency_id, run_at from runs where run_at > (select max(run_at) - interval 7 day from runs)")
def recent_records(spark, sf_dir):
    (runs,) = load(spark, sf_dir, "runs")
    as_of = runs.agg(F.max("run_at").cast("timestamp_ntz")).scalar()
    return runs.filter(F.col("run_at") > as_of - F.expr("interval 7 days")).select("run_id", "agency_id", "run_at")


# Addresses.
@query("url_parts", "select page_id, 'http' as scheme, 'h' || cast(page_id as string) || '.example.org:8080' as netloc, '/en/' || cast(page_id as string) as path from pages")
def url_parts(spark, sf_dir):
    (pages,) = load(spark, sf_dir, "pages")
    url = F.expr("'http://h' || cast(page_id as string) || '.example.org:8080/en/' || cast(page_id as string) || '?x=1'")
    return pages.select("page_id", U.parts(url).alias("p")).select("page_id", "p.scheme", "p.netloc", "p.path")


@query(
    "resolve_links",
    """select page_id, case page_id % 6 when 0 then 'https://other.org/x' when 1 then 'http://cdn.org/y' when 2 then h || '/root/z' when 3 then h || '/en/sub/page' when 4 then h || '/up' else h || '/en/list?page=2' end as link
       from (select page_id, 'http://h' || cast(page_id as string) || '.example.org' as h from pages)""",
)
def resolve_links(spark, sf_dir):
    (pages,) = load(spark, sf_dir, "pages")
    base = F.expr("'http://h' || cast(page_id as string) || '.example.org/en/list?x=1'")
    link = F.expr("case page_id % 6 when 0 then 'https://other.org/x' when 1 then '//cdn.org/y' when 2 then '/root/z' when 3 then 'sub/page' when 4 then '../up' else '?page=2' end")
    return pages.select("page_id", U.resolve(base, link).alias("link"))


@query("socrata_dataset_id", "select doc_id, case when doc_id % 2 = 0 then 'ab' || cast(doc_id as string) || '-cd34' else 'api_views_' || cast(doc_id as string) end as dataset_id from docs")
def socrata_dataset_id(spark, sf_dir):
    url = F.expr("case when doc_id % 2 = 0 then 'https://data.town.gov/resource/ab' || cast(doc_id as string) || '-cd34.json?x=1' else 'https://data.town.gov/api/views/' || cast(doc_id as string) end")
    return load(spark, sf_dir, "docs")[0].select("doc_id", U.dataset_id(url).alias("dataset_id"))


@query("build_page_url", "select page_id, case when page_id % 3 + 1 = 1 then url when contains(url, '?') then url || '&Page=' || cast(page_id % 3 + 1 as string) else url || '?Page=' || cast(page_id % 3 + 1 as string) end as url from pages")
def build_page_url(spark, sf_dir):
    return load(spark, sf_dir, "pages")[0].select("page_id", U.page_url(F.col("url"), F.expr("page_id % 3 + 1")).alias("url"))


@query("alert_id", "select doc_id, case when doc_id % 3 = 0 then null else 'A' || cast(doc_id as string) end as alert_id from docs")
def alert_id(spark, sf_dir):
    url = F.expr("case doc_id % 3 when 0 then 'https://local.nixle.com/city/' when 1 then 'https://local.nixle.com/alert/A' || cast(doc_id as string) || '/' else '/alert/A' || cast(doc_id as string) end")
    return load(spark, sf_dir, "docs")[0].select("doc_id", U.alert_id(url).alias("alert_id"))


# Open-data rows.
_ROW = """'{"dr_no":"' || cast(doc_id as string) || '",":id":"x","date_occ":' || case when doc_id % 3 = 0 then 'null' else '"2024-01-0' || cast(doc_id % 9 + 1 as string) || '"' end || ',"date":"2023-12-01","crm_cd_desc":"' || case when doc_id % 2 = 0 then 'Arrest' else 'Theft' end || '","location":"' || source || '","LEVEL":"' || case when doc_id % 4 = 0 then '-1' else cast(doc_id % 4 as string) end || '"}'"""


def _open_rows(spark, sf_dir):
    return load(spark, sf_dir, "documents")[0].selectExpr("doc_id", f"{_ROW} as j").withColumn("row", M.row_map(F.col("j")))


@query("resolve_fields", "select doc_id, case when doc_id % 3 = 0 then '2023-12-01' else '2024-01-0' || cast(doc_id % 9 + 1 as string) end as date_value, case when doc_id % 2 = 0 then 'Arrest' else 'Theft' end as type_value, cast(doc_id as string) as report, cast(null as string) as overridden from documents")
def resolve_fields(spark, sf_dir):
    from millrace.functions import constants as K

    r = F.col("row")
    return _open_rows(spark, sf_dir).select("doc_id", M.resolve(r, K.DATE_FIELDS).alias("date_value"), M.resolve(r, K.TYPE_FIELDS).alias("type_value"), M.resolve(r, K.REPORT_FIELDS).alias("report"), M.resolve(r, K.TYPE_FIELDS, "no_such_field").alias("overridden"))


@query("resolve_fields_ci", "select doc_id, case when doc_id % 4 = 0 then null else cast(doc_id % 4 as string) end as level, source as location from documents")
def resolve_fields_ci(spark, sf_dir):
    r = F.col("row")
    return _open_rows(spark, sf_dir).select("doc_id", M.resolve_any_case(r, ("level",)).alias("level"), M.resolve_any_case(r, ("location",)).alias("location"))


_DUMP = "'LEVEL: ' || case when doc_id % 4 = 0 then '-1' else cast(doc_id % 4 as string) end || '; crm_cd_desc: ' || case when doc_id % 2 = 0 then 'Arrest' else 'Theft' end || '; date: 2023-12-01' || case when doc_id % 3 = 0 then '' else '; date_occ: 2024-01-0' || cast(doc_id % 9 + 1 as string) end || '; dr_no: ' || cast(doc_id as string) || '; location: ' || source"


@query("row_to_text", f"select doc_id, {_DUMP} as raw_text from documents")
def row_to_text(spark, sf_dir):
    return _open_rows(spark, sf_dir).select("doc_id", M.dump(F.col("row")).alias("raw_text"))


@query("row_to_text_ci", f"select doc_id, ':id: x; ' || replace({_DUMP}, 'LEVEL: -1; ', '') as raw_text from documents")
def row_to_text_ci(spark, sf_dir):
    return _open_rows(spark, sf_dir).select("doc_id", M.dump_features(F.col("row")).alias("raw_text"))
