"""Domain relations derived from the star-schema tables by portable SQL.

Each relation is one SELECT that Spark and other engines read alike, so a query and its
oracle start from the same rows. Values are chosen to reach every branch of the operators.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    "agencies": """
        select c_custkey as agency_id, c_name as canonical_name, n_name as county,
               case when c_custkey % 11 = 0 then null else r_name end as region,
               case c_custkey % 4 when 0 then 'sheriff' when 1 then 'municipal_pd' when 2 then 'campus' else 'transit' end as agency_type,
               case c_mktsegment when 'AUTOMOBILE' then 'civicplus' when 'BUILDING' then 'nixle' when 'FURNITURE' then 'socrata'
                    when 'HOUSEHOLD' then 'crimemapping' else case when c_custkey % 2 = 0 then 'unknown' end end as platform_type,
               case when c_custkey % 5 = 0 then 'N/A' else 'https://agency' || cast(c_custkey as string) || '.example.org/' end as homepage_url,
               c_acctbal > 0 as has_activity_data,
               case when c_custkey % 3 = 0 then null else c_custkey * 7 end as external_id,
               case when c_custkey % 4 = 1 then timestamp '2024-01-05 00:00:00' end as last_verified
        from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "feeds": """
        select o_orderkey as feed_id, o_custkey as agency_id, o_orderstatus <> 'F' as is_active, case when o_orderkey % 37 = 0 then null else o_orderdate end as last_scraped,
               case when o_orderkey % 6 = 0 then 'N/A' when o_orderkey % 6 = 1 then 'ftp://old.example.org/' || cast(o_orderkey as string)
                    else 'https://feeds.example.org/' || case o_orderkey % 3 when 0 then 'news/' when 1 then 'arrest/' else 'data/' end || cast(o_orderkey as string) end as url,
               case o_orderpriority when '1-URGENT' then 'realtime' when '2-HIGH' then 'hourly' when '3-MEDIUM' then 'daily' when '5-LOW' then 'weekly' else 'monthly' end as frequency,
               case o_orderkey % 4 when 0 then 'press_releases' when 1 then 'arrest_log' when 2 then 'rss_feed' else 'incident_reports' end as feed_type
        from orders""",
    "runs": """
        select event_id as run_id, user_id as agency_id, ts as run_at,
               case when event_type = 'error' then 0 else cast(floor(value) as int) end as docs_fetched,
               cast(event_id % 4 as int) as feeds_scraped, case when event_type = 'error' then 1 else 0 end as error_count
        from events""",
    "docs": """
        select doc_id, source as agency_id,
               'https://' || source || '.example.org/' || case doc_id % 6 when 0 then 'news/' when 1 then 'arrest/' when 2 then 'daily-log/' when 3 then 'alert/' when 4 then 'incident/' else 'about/' end || cast(doc_id % 400 as string) as url,
               case doc_id % 8 when 0 then 'For Immediate Release: press release' when 1 then 'Booking and bail after arraignment' when 2 then 'Patrol log, calls for service'
                    when 3 then 'BOLO: be on the lookout' when 4 then 'Case number and report number' when 5 then 'advisory, suspect fled' when 6 then 'Community meeting' else null end as title,
               case doc_id % 12 when 0 then 'civicplus' when 1 then 'nixle' when 2 then 'socrata' when 3 then 'arcgis' when 4 then 'pdf' when 5 then 'rss' when 6 then 'crimemapping'
                    when 7 then 'citizenrims' when 8 then 'rave' when 9 then 'Unlisted' when 10 then null else 'RSS' end as platform_type,
               case doc_id % 7 when 0 then 'activity_feed' when 1 then 'alert' when 2 then 'incident_log' when 3 then 'incident_reports' when 4 then 'open_data_api' when 5 then 'pdf_library' else 'press_release' end as document_type,
               case when doc_id % 9 = 0 then null else timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(doc_id % 500 as int), 0, 0) end as published_at,
               case doc_id % 5 when 0 then '["24-0001","24-0002"]' when 1 then '[]' when 2 then null else '["24-' || cast(doc_id as string) || '"]' end as cad_json,
               text as raw_text
        from documents""",
}
#: Interval arithmetic has no spelling that all engines share; the oracle's differs here only.
_ORACLE_SPELLING = ((re.compile(r"make_interval\(0, 0, 0, 0, (cast\(.*? as int\)), 0, 0\)"), r"to_hours(\1)"),)


def load(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """Base tables and derived relations by name."""
    out = []
    for name in names:
        if name in VIEWS:
            used = [t for t in TABLES if re.search(rf"\b(from|join) {t}\b", VIEWS[name])]
            frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
            sql = VIEWS[name]
            for t in used:
                sql = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", sql)
            out.append(spark.sql(sql, **frames))
        else:
            out.append(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return out


def oracle(sql: str) -> str:
    """``sql`` with the derived relations that it names in front."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    heads = []
    for v in used:
        body = VIEWS[v]
        for pattern, spelling in _ORACLE_SPELLING:
            body = pattern.sub(spelling, body)
        heads.append(f"{v} as ({body})")
    sql = sql.strip()
    if not heads:
        return sql
    word = next((w for w in ("with recursive ", "with ") if sql.lower().startswith(w)), None)
    rest = sql[len(word) :].strip() if word else None
    return (word or "with ") + ",\n".join(heads) + (",\n" + rest if rest is not None else "\n" + sql)
