"""Feed health: latest runs, runs without documents, staleness and their roll-ups.

``runs`` is an append-only series (run_id, agency_id, run_at, docs_fetched, ...); run_id breaks
ties of run_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.tables import number_rows


def _newest():
    return Window.partitionBy("agency_id").orderBy(F.desc("run_at"), F.desc("run_id"))


def recent_n_runs(runs: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` runs of each agency with their rank. Each task keeps ``n`` runs of an agency before
    any are sent on, so an agency with most of the runs is no task of its own."""
    return runs.withColumn("rn", F.row_number().over(_newest())).filter(F.col("rn") <= n).withColumn("rn", F.col("rn").cast("long"))


def append_runs(runs: DataFrame, results: DataFrame) -> DataFrame:
    """``runs`` with a row for each result: agency_id, docs_fetched, feeds_scraped, error_count and
    run_at, under ids that follow the greatest one, in the order of agencies."""
    last = runs.agg(F.coalesce(F.max("run_id"), F.lit(-1))).scalar()
    new = results.select("agency_id", "docs_fetched", "feeds_scraped", "error_count", "run_at")
    ranked = number_rows(new, "agency_id", "run_at", name="run_id").withColumn("run_id", (last + F.col("run_id")).cast(runs.schema["run_id"].dataType))
    return runs.unionByName(ranked, allowMissingColumns=True)


def write_runs(results: DataFrame, path: str) -> None:
    """Appends results to a table of runs; concurrent writers add files of their own."""
    results.write.mode("append").parquet(path)


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest run of each agency, by a grouped maximum: no sort."""
    best = F.max_by(F.struct("run_id", "run_at", "docs_fetched"), F.struct("run_at", "run_id")).alias("r")
    return runs.groupBy("agency_id").agg(best).select("agency_id", "r.run_id", "r.run_at", "r.docs_fetched")


def zero_run_agencies(runs: DataFrame, n: int = 2) -> DataFrame:
    """Agencies whose newest ``n`` runs (at least as many) all fetched nothing."""
    counts = recent_n_runs(runs, n).groupBy("agency_id").agg(F.count("*").alias("run_count"), F.count_if(F.col("docs_fetched") == 0).alias("zero_count"))
    return counts.filter((F.col("run_count") >= n) & (F.col("zero_count") >= n))


def health_status(agencies: DataFrame, runs: DataFrame, n: int = 2) -> DataFrame:
    """MISSING (never ran), UNHEALTHY (newest runs empty) or HEALTHY for agencies with a platform."""
    last = latest_run(runs).select("agency_id", F.col("run_at").alias("last_run_at"), F.col("docs_fetched").alias("docs_fetched_last"), F.lit(True).alias("ran"))
    zero = zero_run_agencies(runs, n).select("agency_id", F.lit(True).alias("zero"))
    status = F.when(F.col("ran").isNull(), "MISSING").when(F.col("zero"), "UNHEALTHY").otherwise("HEALTHY")
    order = F.when(F.col("ran").isNull(), 0).when(F.col("zero"), 1).otherwise(2)
    rows = agencies.filter(F.col("platform_type").isNotNull()).join(last, "agency_id", "left").join(zero, "agency_id", "left")
    return rows.orderBy(order, "agency_id").select("agency_id", "canonical_name", "platform_type", "last_run_at", "docs_fetched_last", status.alias("status"))


def health_counts(agencies: DataFrame, runs: DataFrame, n: int = 2) -> DataFrame:
    return health_status(agencies, runs, n).groupBy("status").agg(F.count("*").alias("n"))


def runs_window_summary(agencies: DataFrame, runs: DataFrame, as_of: Column, hours: int = 48) -> DataFrame:
    """Newest run and greatest docs_fetched within the window; agencies without runs stay."""
    recent = runs.filter(F.col("run_at") >= as_of - F.make_dt_interval(hours=F.lit(hours)))
    found = recent.groupBy("agency_id").agg(F.max("run_at").alias("last_run_at"), F.max("docs_fetched").alias("docs_fetched_last"), F.max_by("docs_fetched", F.struct("run_at", "run_id")).alias("docs_last_true"))
    return agencies.filter(F.col("platform_type").isNotNull()).join(found, "agency_id", "left").select("agency_id", "canonical_name", "platform_type", "last_run_at", "docs_fetched_last", "docs_last_true")


def problem_agencies(agencies: DataFrame, runs: DataFrame, as_of: Column, hours: int = 48, n: int = 2) -> DataFrame:
    """Agencies that are MISSING in the window, else UNHEALTHY; healthy ones are left out."""
    zero = zero_run_agencies(runs, n).select("agency_id", F.lit(True).alias("zero"))
    rows = runs_window_summary(agencies, runs, as_of, hours).join(zero, "agency_id", "left")
    status = F.when(F.col("last_run_at").isNull(), "MISSING").when(F.col("zero"), "UNHEALTHY")
    return rows.select("agency_id", "canonical_name", "platform_type", "last_run_at", F.coalesce("docs_fetched_last", F.lit(0)).alias("docs_fetched_last"), status.alias("status")).filter("status is not null")


def ingestion_totals(runs: DataFrame) -> DataFrame:
    """Sums of one workflow's runs; a run without result adds one error."""
    return runs.agg(F.count("*").alias("agencies"), F.sum(F.coalesce("feeds_scraped", F.lit(0))).cast("long").alias("feeds"), F.sum(F.coalesce("docs_fetched", F.lit(0))).cast("long").alias("docs"), F.sum(F.coalesce("error_count", F.lit(1))).cast("long").alias("errors"))
