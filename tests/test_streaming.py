from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from millrace.streaming import streams


def _queue(folder, rows):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "a.txt").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))


def test_queue_dedup_and_dead_letters(spark, tmp_path):
    row = {"doc_id": 1, "agency_id": "a", "url": "u", "raw_text": "t", "at": "2024-01-01T00:00:00"}
    _queue(tmp_path / "q", [row, row | {"doc_id": 2}, row | {"doc_id": 3, "raw_text": "other"}, "{broken"])
    source = streams.queue_source(spark, str(tmp_path / "q"))
    good, dead = str(tmp_path / "good"), str(tmp_path / "dead")
    sink = streams.to_tables(lambda d: d.write.mode("append").parquet(good), lambda d: d.write.mode("append").parquet(dead))
    source.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(good).count() == 3 and spark.read.parquet(dead).first()["element"] == "{broken"
    streams.drain(streams.first_of_each_content(source.filter("corrupt is null").drop("corrupt", "payload")), str(tmp_path / "c2"), str(tmp_path / "once"))
    assert spark.read.parquet(str(tmp_path / "once")).count() == 2


def test_ttl_state(spark, tmp_path):
    rows = [("u", datetime(2024, 1, 1, 0, 0, s)) for s in (0, 5, 9, 10, 12, 20)] + [("v", datetime(2024, 1, 1))]
    spark.createDataFrame(rows, "url string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("url string, at timestamp").parquet(str(tmp_path / "in"))
    streams.drain(streams.suppress_recent(stream, 10), str(tmp_path / "c"), str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("url").agg(F.count_if("fetch").alias("n")).collect()
    assert {r["url"]: r["n"] for r in got} == {"u": 3, "v": 1}


def test_windows(spark, tmp_path):
    rows = [(1, datetime(2024, 1, 1, 0, m), 0 if m % 20 == 0 else 3) for m in range(0, 60, 10)] + [(1, datetime(2024, 1, 2), 1)]
    spark.createDataFrame(rows, "agency_id long, run_at timestamp, docs_fetched int").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("agency_id long, run_at timestamp, docs_fetched int").parquet(str(tmp_path / "in"))
    streams.drain(streams.health_by_window(stream), str(tmp_path / "c"), str(tmp_path / "out"))
    first = spark.read.parquet(str(tmp_path / "out")).orderBy("window").first()
    assert (first["runs"], first["empty_runs"]) == (6, 3)


def _runs(spark, rows):
    return spark.createDataFrame([(a, i, t, d) for i, (a, t, d) in enumerate(rows)], "agency_id long, run_id long, run_at timestamp_ntz, docs_fetched int")


def test_a_silent_feed_is_told_by_a_timer(spark):
    """Batches equal the batch operator; an agency without any row in the last batch is reported by time alone."""
    import numpy as np

    from millrace.operators import health
    from millrace.streaming import monitor

    day = datetime(2024, 1, 1)
    rng = np.random.default_rng(5)
    rows = [(int(a), day + timedelta(seconds=int(s), microseconds=int(rng.integers(0, 10**6))), int(d)) for a, s, d in zip(rng.integers(0, 12, 150), rng.integers(0, 20 * 86400, 150), rng.integers(0, 3, 150) * 4)]
    rows += [(20, day, 5), (21, day + timedelta(days=19, hours=20), 0), (21, day + timedelta(days=19, hours=21), 0), (22, day + timedelta(days=19), None), (22, day + timedelta(days=19, hours=1), 0)]
    runs = _runs(spark, rows)
    agencies = spark.createDataFrame([(a, f"n{a}", None if a == 3 else "rss") for a in (*range(12), 20, 21, 22, 30)], "agency_id long, canonical_name string, platform_type string")
    want = health.problem_agencies(agencies, runs.fillna(0), runs.agg(F.max("run_at")).scalar()).collect()
    for n in (1, 3):
        changes = monitor.drained_in_batches(runs, "run_at", n, monitor.health_changes, "health")
        assert sorted(map(tuple, monitor.current(agencies, changes).collect()), key=str) == sorted(map(tuple, want), key=str)
    silent = [r for r in changes.filter("agency_id = 20").orderBy("at").collect()]
    assert [r.last_run_at is None for r in silent] == [False, True] and silent[1].at >= day + timedelta(hours=48)
    assert {r.agency_id: r.status for r in want}[21] == "UNHEALTHY" and 30 in {r.agency_id for r in want}


def test_the_greatest_run_leaves_the_window_before_the_last(spark):
    from millrace.streaming import monitor

    day = datetime(2024, 1, 1)
    runs = _runs(spark, [(1, day, 9), (1, day + timedelta(hours=30), 4), (1, day + timedelta(hours=40), 2), (2, day + timedelta(hours=60), 1)])
    changes = monitor.drained_in_batches(runs, "run_at", 1, monitor.health_changes, "health")
    told = changes.filter("agency_id = 1").orderBy("at").collect()
    assert [(r.docs_fetched_last, r.last_run_at) for r in told] == [(9, day + timedelta(hours=40)), (4, day + timedelta(hours=40))]


def test_due_again_by_a_timer(spark):
    from millrace.streaming import monitor

    day = datetime(2024, 1, 1)
    runs = _runs(spark, [(1, day, 1), (2, day, 1), (2, day + timedelta(hours=5), 1), (3, day + timedelta(hours=6), 1), (4, day + timedelta(hours=3), 1)])
    for n in (1, 2):
        changes = monitor.drained_in_batches(runs, "run_at", n, lambda s: monitor.due_changes(s, F.expr("if(agency_id = 4, 36000, 7200)")), "due")
        assert {r.agency_id for r in monitor.due_now(changes).collect()} == {1}
        at = monitor.due_now(changes).first().due_at
        assert timedelta(0) < at - day - timedelta(hours=2) <= timedelta(milliseconds=1)
