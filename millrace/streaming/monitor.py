"""Feed health as a stream of runs, with timers of event time.

An agency's state is its two newest runs, and the runs of the last hours that no later one surpasses in
documents, in a list whose first is the greatest. A timer is set to when that first one leaves the window:
then the next one counts, or, with none left, nothing came in all that time and the agency is reported.
So a feed that falls silent is told without any row of it, and no run is kept longer than the window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.session import ship_package
from millrace.tables import new_path

from .streams import drain

STATUS = "agency_id long, at timestamp, last_run_at timestamp, docs_fetched_last long, zero boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _micros(times: pd.Series) -> pd.Series:
    return pd.to_datetime(times, utc=True).astype("datetime64[us, UTC]").astype("int64")


class _Monitor(StatefulProcessor):
    def __init__(self, hours: int, newest: int):
        self.window, self.newest = hours * 3_600_000_000, newest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        run = "at long, run_id long, docs long"
        self.last, self.recent = handle.getListState("last", run), handle.getListState("recent", run)

    def _told(self, key, at: int, last: list[tuple], recent: list[tuple]) -> pd.DataFrame:
        zero = len(last) >= self.newest and all(r[2] == 0 for r in last)
        time = lambda us: pd.Timestamp(us, unit="us", tz="UTC")
        return pd.DataFrame([(int(key[0]), time(at), time(recent[-1][0]) if recent else pd.NaT, recent[0][2] if recent else None, zero)], columns=["agency_id", "at", "last_run_at", "docs_fetched_last", "zero"])

    def _keep(self, recent: list[tuple], timers: list[int]) -> None:
        """Stores the window's runs; the first one's end is the only timer."""
        for t in timers:
            self.handle.deleteTimer(t)
        if recent:
            self.recent.put(recent)
            self.handle.registerTimer((recent[0][0] + self.window) // 1000 + 1)
        else:
            self.recent.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        runs = sorted(zip(_micros(new["run_at"]).tolist(), new["run_id"].tolist(), new["docs_fetched"].fillna(0).astype("int64").tolist(), strict=True))
        last = sorted([*map(tuple, self.last.get()), *runs])[-self.newest :]
        recent = sorted([*map(tuple, self.recent.get()), *runs])
        kept: list[tuple] = []
        for r in recent:
            if r[0] < recent[-1][0] - self.window:
                continue
            while kept and kept[-1][2] <= r[2]:
                kept.pop()
            kept.append(r)
        self.last.put(last)
        self._keep(kept, list(self.handle.listTimers()))
        yield self._told(key, last[-1][0], last, kept)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Runs that leave by the same advance of the watermark leave together: a timer set now waits for the next one.
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        recent = [tuple(r) for r in self.recent.get() if (r[0] + self.window) // 1000 + 1 > now]
        self._keep(recent, [])
        yield self._told(key, now * 1000, [tuple(r) for r in self.last.get()], recent)

    def close(self) -> None:
        pass


def health_changes(runs: DataFrame, hours: int = 48, newest: int = 2, delay: str = "0 seconds") -> DataFrame:
    """For a stream of runs (agency_id, run_id, run_at, docs_fetched): what is known of an agency each time
    that it changes. ``last_run_at`` is null when nothing came for ``hours``; ``zero`` tells that the
    ``newest`` runs fetched nothing. Needs the RocksDB state store."""
    ship_package(runs.sparkSession)
    rows = runs.select("agency_id", "run_id", F.col("run_at").cast("timestamp").alias("run_at"), "docs_fetched").withWatermark("run_at", delay)
    return rows.groupBy("agency_id").transformWithStateInPandas(_Monitor(hours, newest), STATUS, "Append", "EventTime")


def current(agencies: DataFrame, changes: DataFrame) -> DataFrame:
    """Agencies with a platform that are MISSING, or else UNHEALTHY, by the last change of each; those
    that never ran are missing."""
    latest = changes.groupBy("agency_id").agg(F.max_by(F.struct("last_run_at", "docs_fetched_last", "zero"), F.struct("at", F.col("last_run_at").isNull())).alias("s")).select("agency_id", "s.*")
    rows = agencies.filter(F.col("platform_type").isNotNull()).join(latest, "agency_id", "left")
    status: Column = F.when(F.col("last_run_at").isNull(), "MISSING").when(F.col("zero"), "UNHEALTHY")
    return rows.select("agency_id", "canonical_name", "platform_type", F.col("last_run_at").cast("timestamp_ntz").alias("last_run_at"), F.coalesce("docs_fetched_last", F.lit(0)).cast("int").alias("docs_fetched_last"), status.alias("status")).filter("status is not null")


class _Schedule(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        at, seconds = max(zip(_micros(new["run_at"]).tolist(), new["seconds"].tolist(), strict=True))
        if self.last.exists() and self.last.get()[0] >= at:
            return
        self.last.update((at,))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer((at + int(seconds) * 1_000_000) // 1000 + 1)
        yield self._told(key, at, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._told(key, expiredTimerInfo.getExpiryTimeInMs() * 1000, True)

    def _told(self, key, at: int, due: bool) -> pd.DataFrame:
        return pd.DataFrame([(int(key[0]), pd.Timestamp(at, unit="us", tz="UTC"), due)], columns=["agency_id", "at", "due"])

    def close(self) -> None:
        pass


def due_changes(runs: DataFrame, seconds: Column, delay: str = "0 seconds") -> DataFrame:
    """For a stream of runs (agency_id, run_at): an agency is not due at a run, and due again by a timer once
    ``seconds`` (of its newest run) have gone by without one."""
    ship_package(runs.sparkSession)
    rows = runs.select("agency_id", F.col("run_at").cast("timestamp").alias("run_at"), seconds.cast("long").alias("seconds")).withWatermark("run_at", delay)
    return rows.groupBy("agency_id").transformWithStateInPandas(_Schedule(), "agency_id long, at timestamp, due boolean", "Append", "EventTime")


def due_now(changes: DataFrame) -> DataFrame:
    """Agencies whose last change says that they are due, and since when."""
    return changes.groupBy("agency_id").agg(F.max(F.struct("at", "due")).alias("s")).filter("s.due").select("agency_id", F.col("s.at").cast("timestamp_ntz").alias("due_at"))


def drained_in_batches(rows: DataFrame, at: str, n: int, run: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """What the stream ``run`` gives for ``rows`` that arrive in about ``n`` batches in the order of time.
    Each batch is drained when it is there, by a query that goes on from the last one's checkpoint."""
    spark, path = rows.sparkSession, new_path(rows.sparkSession, name)
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, ROCKSDB)
    try:
        cuts = sorted(set(rows.agg(F.percentile_approx(at, [k / n for k in range(1, n)])).first()[0] or []))
        for after, upto in zip([None, *cuts], [*cuts, None], strict=True):
            part = rows if after is None else rows.filter(F.col(at) > F.lit(after))
            part = part if upto is None else part.filter(F.col(at) <= F.lit(upto))
            part.write.mode("append").parquet(f"{path}/in")
            stream = run(spark.readStream.schema(rows.schema).parquet(f"{path}/in"))
            drain(stream, f"{path}/checkpoint", f"{path}/out")
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
