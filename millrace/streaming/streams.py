"""Incremental forms on Structured Streaming. Each takes a streaming DataFrame; sinks and
checkpoint locations are the caller's."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.operators.ingest import decode_queue, doc_hash
from millrace.session import ship_package

DOCUMENT = "doc_id long, agency_id string, url string, raw_text string, at timestamp"


def queue_source(spark: SparkSession, path: str, schema: str = DOCUMENT) -> DataFrame:
    """Elements of a queue folder, one JSON object a line; ``corrupt`` holds what is none."""
    lines = spark.readStream.format("text").load(path)
    return decode_queue(lines.withColumnRenamed("value", "payload"), schema)


def first_of_each_content(docs: DataFrame, watermark: str | None = None) -> DataFrame:
    """Each content hash once. The state grows without a watermark; with one, a hash may pass
    again once it is that much older than the newest time seen."""
    hashed = docs.withColumn("doc_hash", doc_hash())
    if watermark is None:
        return hashed.dropDuplicates(["doc_hash"])
    return hashed.withWatermark("at", watermark).dropDuplicatesWithinWatermark(["doc_hash"])


class _UrlMarks(StatefulProcessor):
    """Per address: until when fetches are skipped. A skipped one leaves the mark as it is."""

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.until = handle.getValueState("until", "until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        all_rows = pd.concat(list(rows)).sort_values("at", kind="stable")
        until = self.until.get()[0] if self.until.exists() else None
        out = []
        for r in all_rows.itertuples(index=False):
            second = int(pd.Timestamp(r.at).timestamp())
            fetch = until is None or second >= until
            if fetch:
                until = second + self.ttl
            out.append((key[0], r.at, fetch))
        self.until.update((until,))
        yield pd.DataFrame(out, columns=["url", "at", "fetch"])

    def close(self) -> None:
        pass


def suppress_recent(fetches: DataFrame, ttl_seconds: int) -> DataFrame:
    """url, at and whether to fetch, for attempts (url, at). Needs the RocksDB state store."""
    ship_package(fetches.sparkSession)
    return fetches.select("url", "at").groupBy("url").transformWithStateInPandas(_UrlMarks(ttl_seconds), "url string, at timestamp, fetch boolean", "Append", "none")


def to_tables(good: Callable[[DataFrame], None], dead: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that parts a batch by its ``corrupt`` column."""

    def run(batch: DataFrame, _: int) -> None:
        batch.persist()
        good(batch.filter("corrupt is null").drop("corrupt", "payload"))
        dead(batch.filter("corrupt is not null").select(F.col("payload").alias("element"), F.lit("undecodable").alias("error")))
        batch.unpersist()

    return run


def health_by_window(runs: DataFrame, window: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """Runs and empty runs of each agency by window of event time; late rows count up to the watermark."""
    return runs.withWatermark("run_at", watermark).groupBy(F.window("run_at", window), "agency_id").agg(F.count("*").alias("runs"), F.count_if(F.col("docs_fetched") == 0).alias("empty_runs"))


def drain(stream: DataFrame, checkpoint: str, sink: str, mode: str = "append") -> None:
    """Runs a stream over all that is there and stops."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", sink).trigger(availableNow=True).start().awaitTermination()
