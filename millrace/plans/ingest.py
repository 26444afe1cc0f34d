"""Ingestion, queue, coverage and matching queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import coverage as C
from millrace.operators import ingest as I
from millrace.operators import matching as M
from millrace.sources.standins import load

from .base import query

_HASH = "sha256(coalesce(url, '') || ':' || coalesce(raw_text, ''))"
_SEEN = f"seen as (select {_HASH} as doc_hash from docs where doc_id % 10 = 1)"
_NEW = f"{_SEEN}, fresh as (select * from (select *, {_HASH} as doc_hash, row_number() over (partition by {_HASH} order by doc_id) as rn from docs) where rn = 1 and doc_hash not in (select doc_hash from seen))"


def _seen(docs):
    return docs.filter("doc_id % 10 = 1").select(I.doc_hash().alias("doc_hash")).distinct()


@query("doc_hash", f"select doc_id, {_HASH} as doc_hash from docs")
def doc_hash(spark, sf_dir):
    return load(spark, sf_dir, "docs")[0].select("doc_id", I.doc_hash().alias("doc_hash"))


@query("url_key", "select doc_id, 'url:' || sha256(url) as url_key from docs")
def url_key(spark, sf_dir):
    return load(spark, sf_dir, "docs")[0].select("doc_id", I.url_key().alias("url_key"))


@query("dedup_new_docs", f"with {_NEW} select doc_id, doc_hash from fresh")
def dedup_new_docs(spark, sf_dir):
    (docs,) = load(spark, sf_dir, "docs")
    return I.new_documents(docs, _seen(docs)).select("doc_id", "doc_hash")


@query("insert_ignore_counts", f"with {_NEW} select agency_id, count(*) as inserted from fresh group by agency_id")
def insert_ignore_counts(spark, sf_dir):
    (docs,) = load(spark, sf_dir, "docs")
    return I.insert_counts(docs, _seen(docs))


@query(
    "ttl_suppress",
    """with recursive f as (select agency_id, cast(floor(epoch(run_at)) as bigint) as arrived, case agency_id % 4 when 0 then 900 when 1 then 3600 when 2 then 86400 else 604800 end as ttl, row_number() over (partition by agency_id order by run_at, run_id) as i from runs),
       g as (select agency_id, i, arrived + ttl as until, 1 as fetched, 0 as skipped from f where i = 1
             union all select f.agency_id, f.i, case when f.arrived < g.until then g.until else f.arrived + f.ttl end, g.fetched + case when f.arrived < g.until then 0 else 1 end, g.skipped + case when f.arrived < g.until then 1 else 0 end
             from g join f on f.agency_id = g.agency_id and f.i = g.i + 1)
       select agency_id, cast(max(fetched) as bigint) as fetched, cast(max(skipped) as bigint) as skipped from g group by agency_id""",
)
def ttl_suppress(spark, sf_dir):
    (runs,) = load(spark, sf_dir, "runs")
    ttl = F.expr("case agency_id % 4 when 0 then 900 when 1 then 3600 when 2 then 86400 else 604800 end")
    return I.suppress_by_ttl(runs.withColumn("ttl", ttl).withColumn("at", F.col("run_at").cast("timestamp").cast("long")), "agency_id", "at", "ttl")


@query(
    "rate_limited_schedule",
    """with r as (select run_id, agency_id % 10 as domain, epoch(run_at) as arrived, row_number() over (partition by agency_id % 10 order by run_at, run_id) - 1 as i from runs)
       select run_id, domain, round(i * 7200.0 + max(arrived - i * 7200.0) over (partition by domain order by i rows between unbounded preceding and current row), 3) as start_at from r""",
)
def rate_limited_schedule(spark, sf_dir):
    (runs,) = load(spark, sf_dir, "runs")
    rows = runs.select("run_id", F.expr("agency_id % 10").alias("domain"), (F.unix_micros(F.col("run_at").cast("timestamp")) / 1e6).alias("at"))
    return I.rate_limited_schedule(rows, "domain", "at", "run_id", 7200.0).select("run_id", "domain", F.round("start_at", 3).alias("start_at"))


@query(
    "paginate_take_while",
    """with p as (select agency_id, row_number() over (partition by agency_id order by run_at, run_id) as page, run_id, feeds_scraped > 0 as more, docs_fetched > 0 as found from runs),
       s as (select *, coalesce(min(cast(more as int)) over (partition by agency_id order by page rows between unbounded preceding and 1 preceding), 1) as a, min(cast(found as int)) over (partition by agency_id order by page rows between unbounded preceding and current row) as b from p where page <= 5)
       select agency_id, page, run_id from s where a = 1 and b = 1""",
)
def paginate_take_while(spark, sf_dir):
    (runs,) = load(spark, sf_dir, "runs")
    pages = runs.selectExpr("agency_id", "cast(row_number() over (partition by agency_id order by run_at, run_id) as bigint) as page", "run_id", "feeds_scraped", "docs_fetched")
    return I.take_while(pages, "agency_id", "page", F.col("feeds_scraped") > 0, F.col("docs_fetched") > 0, 5).select("agency_id", "page", "run_id")


_QUEUE = "select case when doc_id % 17 = 0 then '{broken' else null end as broken, doc_id, url, title, published_at from docs"


def _queue(spark, sf_dir):
    (docs,) = load(spark, sf_dir, "docs")
    row = F.struct("doc_id", "url", "title", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss").alias("published_date"))
    return docs.select("doc_id", F.when(F.expr("doc_id % 17 = 0"), F.lit("{broken")).otherwise(F.to_json(row, {"ignoreNullFields": "false"})).alias("payload"))


_DECODED = "doc_id bigint, url string, title string, published_date string"


@query("queue_encode", """select doc_id, '{"doc_id":' || cast(doc_id as string) || ',"url":"' || url || '","title":' || case when title is null then 'null' else '"' || title || '"' end || ',"published_date":' || case when published_at is null then 'null' else '"' || strftime(published_at, '%Y-%m-%dT%H:%M:%S') || '"' end || '}' as payload from docs""")
def queue_encode(spark, sf_dir):
    (docs,) = load(spark, sf_dir, "docs")
    row = F.struct("doc_id", "url", "title", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss").alias("published_date"))
    return docs.select("doc_id", F.to_json(row, {"ignoreNullFields": "false"}).alias("payload"))


@query("queue_decode", "select doc_id, url, title, published_at from docs where doc_id % 17 <> 0")
def queue_decode(spark, sf_dir):
    rows = I.decode_queue(_queue(spark, sf_dir).select("payload"), _DECODED).filter("corrupt is null")
    return rows.select("doc_id", "url", "title", F.try_to_timestamp("published_date", F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz").alias("published_at"))


@query("queue_roundtrip", "select count(*) as n, count(*) filter (where doc_id % 17 <> 0) as same from docs")
def queue_roundtrip(spark, sf_dir):
    queue = _queue(spark, sf_dir).select("payload")
    again = I.decode_queue(queue, _DECODED).select("payload", F.to_json(F.struct("doc_id", "url", "title", "published_date"), {"ignoreNullFields": "false"}).alias("again"))
    return again.agg(F.count("*").alias("n"), F.count_if(F.col("payload") == F.col("again")).alias("same"))


@query("queue_drain", "select count(*) filter (where doc_id % 17 <> 0) as decoded, count(*) filter (where doc_id % 17 = 0) as skipped from docs")
def queue_drain(spark, sf_dir):
    rows = I.decode_queue(_queue(spark, sf_dir).select("payload"), _DECODED)
    return rows.agg(F.count_if(F.col("corrupt").isNull()).alias("decoded"), F.count_if(F.col("corrupt").isNotNull()).alias("skipped"))


@query("queue_depth", "select (select count(*) from docs) as depth, (select count(*) from runs where error_count > 0) as dlq_depth")
def queue_depth(spark, sf_dir):
    docs, runs = load(spark, sf_dir, "docs", "runs")
    one = F.lit(1).alias("k")
    return docs.agg(F.count("*").alias("depth")).select("depth", one).join(runs.filter("error_count > 0").agg(F.count("*").alias("dlq_depth")).select("dlq_depth", one), "k").drop("k")


@query("dlq_split", "select agency_id, 'run ' || cast(run_id as string) as error from runs where error_count > 0 and run_id % 4 >= 3")
def dlq_split(spark, sf_dir):
    (runs,) = load(spark, sf_dir, "runs")
    rows = runs.selectExpr("agency_id", "case when error_count > 0 then 'run ' || cast(run_id as string) end as error", "run_id % 4 as attempt")
    return I.dead_letters(rows)


@query(
    "chunk_docs",
    "select doc_id, agency_id, cast(i as int) as chunk_index, substring(raw_text, i * 700 + 1, 700) as chunk_text from docs, lateral (select unnest(range(0, greatest(0, (length(raw_text) - 1) // 700) + 1)) as i)",
)
def chunk_docs(spark, sf_dir):
    return I.chunk(load(spark, sf_dir, "docs")[0], 700)


# Coverage: each document belongs to the agency of its number.
_AGENCY_DOCS = "ad as (select doc_id % 300 as agency_id, published_at, url, raw_text from docs), ins as (select agency_id, count(*) as inserted from ad where published_at is not null group by 1)"
_ROWS = f"""{_AGENCY_DOCS}, ff as (select agency_id, arg_min(url, feed_id) as url from feeds where is_active group by 1),
    per as (select agency_id, count(*) as docs_fetched, min(published_at) as date_min, max(published_at) as date_max from ad group by 1),
    cov as (select a.agency_id, a.platform_type, coalesce(per.docs_fetched, 0) as docs_fetched, coalesce(ins.inserted, 0) as docs_inserted, date_min, date_max,
        case when ff.url is null or not regexp_matches(ff.url, '^https?://') then 'no_url' when coalesce(a.platform_type, 'unknown') = 'crimemapping' then 'no_parser: crimemapping' end as error
        from agencies a left join ff on ff.agency_id = a.agency_id left join per on per.agency_id = a.agency_id left join ins on ins.agency_id = a.agency_id)"""


def _coverage(spark, sf_dir):
    agencies, feeds, docs = load(spark, sf_dir, "agencies", "feeds", "docs")
    own = docs.withColumn("agency_id", F.expr("doc_id % 300"))
    inserted = own.filter("published_at is not null").groupBy("agency_id").agg(F.count("*").alias("inserted"))
    return C.coverage_rows(agencies, feeds, own, inserted)


@query("coverage_rows", f"with {_ROWS} select * from cov")
def coverage_rows(spark, sf_dir):
    return _coverage(spark, sf_dir)


@query(
    "coverage_by_platform",
    f"""with {_ROWS} select coalesce(platform_type, 'unknown') as platform, count(*) as total, count(*) filter (where error is null) as ok, count(*) filter (where error = 'no_url') as no_url,
        count(*) filter (where error like '%no_parser%') as no_parser, count(*) filter (where error is not null and error <> 'no_url' and error not like '%no_parser%') as failed from cov group by 1 order by total desc, 1""",
)
def coverage_by_platform(spark, sf_dir):
    return C.by_platform(_coverage(spark, sf_dir)).orderBy(F.desc("total"), "platform")


@query(
    "coverage_metric",
    f"""with {_ROWS}, m as (select count(*) as agencies, count(*) filter (where error is null) as covered, count(*) filter (where docs_fetched > 0) as with_data from cov)
        select *, agencies - covered as blocked, round(covered * 100.0 / agencies, 4) as percent, round(covered * 100.0 / 697, 4) as registry_percent, case when round(covered * 100.0 / agencies, 4) >= 60 then 'PASS' else 'FAIL' end as verdict from m""",
)
def coverage_metric(spark, sf_dir):
    m = C.metric(_coverage(spark, sf_dir), 697)
    return m.withColumns({"percent": F.col("percent").cast("double"), "registry_percent": F.col("registry_percent").cast("double")})


@query("doc_summary_top20", "select agency_id, count(*) as n, min(published_at) as first_date, max(published_at) as last_date from docs group by agency_id order by n desc, agency_id limit 20")
def doc_summary_top20(spark, sf_dir):
    return C.summary_top(load(spark, sf_dir, "docs")[0])


@query("enrichment_totals", "select count(*) filter (where platform_type is not null and platform_type <> 'unknown') as classified, count(*) filter (where platform_type is null or platform_type = 'unknown') as unknown, count(*) filter (where homepage_url = 'N/A') as errors from agencies")
def enrichment_totals(spark, sf_dir):
    p = F.coalesce("platform_type", F.lit("unknown"))
    return load(spark, sf_dir, "agencies")[0].agg(F.count_if(p != "unknown").alias("classified"), F.count_if(p == "unknown").alias("unknown"), F.count_if(F.col("homepage_url") == "N/A").alias("errors"))


# Names of two to four words over a small vocabulary, so that several candidates share words.
_NAMES = """t as (select p_partkey as target_id, p_name || ' ' || p_type || case when p_partkey % 2 = 0 then ' Police Department' else ' Sheriff''s Office' end as name from part where p_partkey % 5 = 0),
    c as (select p_partkey as candidate_id, p_name || ' ' || p_type || case p_partkey % 3 when 0 then ' Police' when 1 then ' ' || p_brand else '' end as name from part where p_partkey % 5 <> 0)"""
_NORM = r"trim(regexp_replace(regexp_replace(lower(name), '\b(police department|sheriff.s office|sheriff department|police|sheriff|department|office)\b', '', 'g'), '\s+', ' ', 'g'))"


@query(
    "fuzzy_name_match",
    f"""with {_NAMES}, tt as (select target_id, list_distinct(list_filter(string_split({_NORM}, ' '), lambda w: w <> '')) as ts from t), cc as (select candidate_id, list_distinct(list_filter(string_split({_NORM}, ' '), lambda w: w <> '')) as cs from c),
        s as (select target_id, candidate_id, len(list_intersect(ts, cs)) / len(ts) as overlap from tt, cc), r as (select *, row_number() over (partition by target_id order by overlap desc, candidate_id) as rn from s where overlap >= 0.6)
        select target_id, candidate_id, round(overlap, 6) as overlap from r where rn = 1""",
)
def fuzzy_name_match(spark, sf_dir):
    (part,) = load(spark, sf_dir, "part")
    t = part.filter("p_partkey % 5 = 0").selectExpr("p_partkey as target_id", "p_name || ' ' || p_type || case when p_partkey % 2 = 0 then ' Police Department' else \" Sheriff's Office\" end as name")
    c = part.filter("p_partkey % 5 <> 0").selectExpr("p_partkey as candidate_id", "p_name || ' ' || p_type || case p_partkey % 3 when 0 then ' Police' when 1 then ' ' || p_brand else '' end as name")
    return M.fuzzy_match(t, c).select("target_id", "candidate_id", F.round("overlap", 6).alias("overlap"))
