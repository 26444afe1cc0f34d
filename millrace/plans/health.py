"""Feed health queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import health as H
from millrace.sources.standins import load

from .base import query

_LATEST = "latest as (select agency_id, run_id, run_at, docs_fetched from (select *, row_number() over (partition by agency_id order by run_at desc, run_id desc) as rn from runs) where rn = 1)"
_ZERO = """zero as (select agency_id, count(*) as run_count, sum(case when docs_fetched = 0 then 1 else 0 end) as zero_count
    from (select *, row_number() over (partition by agency_id order by run_at desc, run_id desc) as rn from runs) where rn <= 2
    group by agency_id having count(*) >= 2 and sum(case when docs_fetched = 0 then 1 else 0 end) >= 2)"""
_STATUS = f"""{_LATEST}, {_ZERO}, status as (select a.agency_id, a.canonical_name, a.platform_type, l.run_at as last_run_at, l.docs_fetched as docs_fetched_last,
    case when l.agency_id is null then 'MISSING' when z.agency_id is not null then 'UNHEALTHY' else 'HEALTHY' end as status
    from agencies a left join latest l on l.agency_id = a.agency_id left join zero z on z.agency_id = a.agency_id where a.platform_type is not null)"""
_WINDOW = """recent as (select a.agency_id, a.canonical_name, a.platform_type, max(r.run_at) as last_run_at, max(r.docs_fetched) as docs_fetched_last,
    arg_max(r.docs_fetched, r.run_at) as docs_last_true
    from agencies a left join (select * from runs where run_at >= (select max(run_at) - interval 48 hour from runs)) r on r.agency_id = a.agency_id
    where a.platform_type is not null group by a.agency_id, a.canonical_name, a.platform_type)"""


def _as_of(runs):
    return runs.agg(F.max("run_at").cast("timestamp_ntz")).scalar()


@query("health_status", f"with {_STATUS} select * from status order by case status when 'MISSING' then 0 when 'UNHEALTHY' then 1 else 2 end, agency_id")
def health_status(spark, sf_dir):
    return H.health_status(*load(spark, sf_dir, "agencies", "runs"))


@query("health_counts", f"with {_STATUS} select status, count(*) as n from status group by status")
def health_counts(spark, sf_dir):
    return H.health_counts(*load(spark, sf_dir, "agencies", "runs"))


@query("latest_run", f"with {_LATEST} select * from latest")
def latest_run(spark, sf_dir):
    return H.latest_run(*load(spark, sf_dir, "runs"))


@query("recent_n_runs", "select run_id, agency_id, run_at, docs_fetched, rn from (select *, row_number() over (partition by agency_id order by run_at desc, run_id desc) as rn from runs) where rn <= 3")
def recent_n_runs(spark, sf_dir):
    return H.recent_n_runs(*load(spark, sf_dir, "runs"), 3).select("run_id", "agency_id", "run_at", "docs_fetched", "rn")


@query("zero_run_agencies", f"with {_ZERO} select agency_id, run_count, cast(zero_count as bigint) as zero_count from zero")
def zero_run_agencies(spark, sf_dir):
    return H.zero_run_agencies(*load(spark, sf_dir, "runs"))


@query("runs_window_summary", f"with {_WINDOW} select * from recent")
def runs_window_summary(spark, sf_dir):
    agencies, runs = load(spark, sf_dir, "agencies", "runs")
    return H.runs_window_summary(agencies, runs, _as_of(runs))


@query(
    "problem_agencies",
    f"with {_WINDOW}, {_ZERO} select * from (select r.agency_id, canonical_name, platform_type, last_run_at, coalesce(docs_fetched_last, 0) as docs_fetched_last, case when last_run_at is null then 'MISSING' when z.agency_id is not null then 'UNHEALTHY' end as status from recent r left join zero z on z.agency_id = r.agency_id) where status is not null",
)
def problem_agencies(spark, sf_dir):
    agencies, runs = load(spark, sf_dir, "agencies", "runs")
    return H.problem_agencies(agencies, runs, _as_of(runs))


@query(
    "append_run",
    """with n as (select agency_id, cast(agency_id % 9 as int) as docs_fetched, cast(agency_id % 4 as int) as feeds_scraped, 0 as error_count, timestamp '2024-06-01 00:00:00' as run_at from agencies where platform_type is not null)
       select run_id, agency_id, run_at, docs_fetched, feeds_scraped, error_count from runs union all
       select (select max(run_id) from runs) + row_number() over (order by agency_id), agency_id, run_at, docs_fetched, feeds_scraped, error_count from n""",
)
def append_run(spark, sf_dir):
    agencies, runs = load(spark, sf_dir, "agencies", "runs")
    results = agencies.filter("platform_type is not null").selectExpr("agency_id", "cast(agency_id % 9 as int) as docs_fetched", "cast(agency_id % 4 as int) as feeds_scraped", "0 as error_count", "timestamp_ntz '2024-06-01 00:00:00' as run_at")
    return H.append_runs(runs, results).select("run_id", "agency_id", "run_at", "docs_fetched", "feeds_scraped", "error_count")


@query("ingestion_totals", "select count(*) as agencies, cast(sum(feeds_scraped) as bigint) as feeds, cast(sum(docs_fetched) as bigint) as docs, cast(sum(error_count) as bigint) as errors from runs")
def ingestion_totals(spark, sf_dir):
    return H.ingestion_totals(*load(spark, sf_dir, "runs"))
