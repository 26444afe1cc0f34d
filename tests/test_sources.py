"""Parsers by name, feeds, files, robots rules, and operators on odd rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import urls
from millrace.operators import documents, health, ingest, matching, registry
from millrace.sources import discovery, files, parsers, plugins

ATOM = """<?xml version="1.0" encoding="utf-8"?><feed xmlns="http://www.w3.org/2005/Atom"><title>Press room</title><entry><title type="html">A</title><link href="https://x.org/a"/><summary>s</summary><content>c  c</content><published>2024-01-02T03:04:05Z</published></entry>
<entry><link rel="enclosure" href="https://x.org/no"/><summary>only</summary><updated>2024-01-03T00:00:00Z</updated></entry></feed>"""
RSS = "<rss><channel><title>Arrests</title><item><title>t</title><link>https://x.org/r</link><description>d</description></item></channel></rss>"


def test_feeds_of_both_kinds(spark):
    rows = spark.createDataFrame([(1, "https://f.org/atom", ATOM), (2, "https://f.org/rss", RSS), (3, "https://f.org/none", "<feed></feed>"), (4, "u", "no xml"), (5, "u", None)], "k int, url string, xml string")
    got = {(r.k, r.pos): (r.url, r.document_type, r.title, r.raw_text, r.published_date and str(r.published_date)) for r in parsers.parse_feed(rows, ["k"]).collect()}
    assert got == {
        (1, 0): ("https://x.org/a", "press_release", "A", "c c", "2024-01-02 03:04:05"),
        (1, 1): ("https://f.org/atom", "press_release", None, "only", "2024-01-03 00:00:00"),
        (2, 0): ("https://x.org/r", "arrest_log", "t", "d", None),
    }


def test_registered_parsers(spark):
    def words(url, payload, most=9):
        return [{"url": url, "raw_text": w} for w in payload.split()[:most]]

    with pytest.raises(plugins.ParserNotRegistered):
        plugins.get_parser("words")
    plugins.register("words", lambda **s: plugins.RowParser(words, **s))
    try:
        with pytest.raises(ValueError, match="words"):
            plugins.register("words", plugins.ColumnParser)
        rows = spark.createDataFrame([(1, "u", "a b c", "Words"), (2, "v", None, "words"), (3, "w", "x", "other"), (4, "f", RSS, "rss")], "k int, url string, payload string, platform string").withColumns({"map_id": F.lit(1), "offset": F.lit(0)})
        got = {(r.k, r.pos, r.raw_text) for r in plugins.parse_all(rows, F.col("platform"), ["k"], {"words": {"most": 2}}).collect()}
        assert got == {(1, 0, "a"), (1, 1, "b"), (4, 0, "d")}
    finally:
        plugins.unregister("words")
    assert "words" not in plugins.names() and "rss" in plugins.names()


def test_a_known_date_field_is_used(spark):
    rows = spark.createDataFrame([(1, "https://d.org/resource/a.json", '[{"date":"2024-01-01","when":"2024-02-02"}]', 0)], "k int, url string, payload string, offset int")
    own = plugins.get_parser("socrata", date_field="when").documents(rows, ["k"]).first()
    assert str(own.published_date) == "2024-02-02 00:00:00"


def test_bytes_of_local_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.pdf").write_bytes(b"\x00pdf")
    wanted = spark.createDataFrame([("a/x.pdf",), ("missing.pdf",)], "path string")
    got = {r.path: r.content for r in files.read_bytes(spark, wanted, f"file://{tmp_path}").collect()}
    assert got == {"a/x.pdf": bytearray(b"\x00pdf"), "missing.pdf": None}
    assert [r[0] for r in spark.createDataFrame([("http://x/a.pdf",), ("/tmp/a.pdf",)], "u string").select(urls.byte_source(F.col("u"))).collect()] == ["http", "file"]


def test_robots(spark):
    rows = spark.createDataFrame([("https://x/private/a", "User-agent: *\nDisallow: /private"), ("https://x/b", "User-agent: *\nDisallow: /private"), ("https://x/c", None), ("https://x/d", "")], "u string, r string")
    assert [r[0] for r in rows.select(urls.robots_allowed(F.col("u"), F.col("r"), "Bot/1.0")).collect()] == [False, True, True, True]


def test_changes_with_repeated_keys_change_one_row(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    new = spark.createDataFrame([(1, "c"), (1, "d"), (3, "e"), (3, None)], "k int, v string")
    assert sorted(map(tuple, registry.upsert(base, new, "k", ["v"]).collect()), key=str) == sorted([(1, "d", "x"), (2, "b", "y"), (3, "e", None)], key=str)
    assert sorted(map(tuple, registry.patch(base, new, "k", ["v"]).collect())) == [(1, "d", "x"), (2, "b", "y")]


def test_schedule_by_spans_is_the_schedule(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 3)), float(rng.integers(0, 500))) for i in range(400)] + [(1000, None, 5.0), (1001, None, 6.0)]
    want, last = {}, {}
    for i, d, t in sorted(rows, key=lambda r: (str(r[1]), r[2], r[0])):
        last[d] = want[i] = max(t, last[d] + 10) if d in last else t
    df = spark.createDataFrame(rows, "i int, d int, t double")
    for span in (7.0, 100.0, 1e6):
        assert {r.i: r.start_at for r in ingest.rate_limited_schedule(df, "d", "t", "i", 10.0, span).collect()} == want


def test_time_to_live_by_a_plain_fold(spark):
    rng = np.random.default_rng(4)
    rows = [(None if k == 3 else f"k{k}", int(t), 20) for k in range(40) for t in rng.integers(0, 300, rng.integers(1, 60))]
    want = {}
    for k in {r[0] for r in rows}:
        until, counts = None, [0, 0]
        for t in sorted(t for x, t, _ in rows if x == k):
            skip = until is not None and t < until
            counts[skip] += 1
            until = until if skip else t + 20
        want[k] = tuple(counts)
    got = ingest.suppress_by_ttl(spark.createDataFrame(rows, "k string, at long, ttl long"), "k", "at", "ttl").collect()
    assert {r.k: (r.fetched, r.skipped) for r in got} == want and len(got) == len(want)
    assert ingest.suppress_by_ttl(spark.createDataFrame([], "k string, at long, ttl long"), "k", "at", "ttl").count() == 0


def test_fuzzy_match_is_exhaustive(spark):
    rng, words = np.random.default_rng(5), [f"w{i}" for i in range(14)] + ["police", "office"]
    name = lambda: " ".join(rng.choice(words, rng.integers(1, 7)))
    t, c = [(i, name()) for i in range(120)], [(i, name()) for i in range(150)]
    td, cd = spark.createDataFrame(t, "target_id long, name string"), spark.createDataFrame(c, "candidate_id long, name string")
    sets = lambda df, k: {r[0]: set(r[1]) for r in df.select(k, matching.tokens(F.col("name"))).collect()}
    ts, cs = sets(td, "target_id"), sets(cd, "candidate_id")
    for least in (0.3, 0.6, 1.0):
        want = {}
        for i, a in ts.items():
            best = max(((len(a & b) / len(a), -j) for j, b in cs.items()), default=(0, 0)) if a else (0, 0)
            if best[0] >= least:
                want[i] = (-best[1], round(best[0], 9))
        assert {r.target_id: (r.candidate_id, round(r.overlap, 9)) for r in matching.fuzzy_match(td, cd, least).collect()} == want


def test_new_documents_keep_the_first_row(spark):
    docs = spark.createDataFrame([(3, "u", "t"), (1, "u", "t"), (2, "v", None), (5, None, None), (4, None, None)], "doc_id long, url string, raw_text string")
    none = spark.createDataFrame([], "doc_hash string")
    got = ingest.new_documents(docs, none)
    assert got.columns == ["doc_id", "url", "raw_text", "doc_hash"] and sorted(r.doc_id for r in got.collect()) == [1, 2, 4]
    assert ingest.new_documents(docs, got.filter("doc_id = 2").select("doc_hash")).count() == 2


def test_places_in_the_queue(spark):
    rng = np.random.default_rng(6)
    rows = [(i, str(rng.choice(["a", "b"])), None if i == 7 else int(rng.integers(0, 4))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id int, status string, priority_score int")
    want = [r.doc_id for r in documents.queue_order(df).collect()]
    assert [r.doc_id for r in documents.queue_places(df).orderBy("place").collect()] == want


def test_runs_are_appended(spark, tmp_path):
    runs = spark.createDataFrame([(0, 1, 2, 0, 0, None), (4, 1, 2, 0, 0, None)], "run_id long, agency_id long, docs_fetched int, feeds_scraped int, error_count int, run_at timestamp_ntz")
    new = runs.selectExpr("run_id + 10 as agency_id", "docs_fetched", "feeds_scraped", "error_count", "run_at")
    assert sorted((r.run_id, r.agency_id) for r in health.append_runs(runs, new).collect()) == [(0, 1), (4, 1), (5, 10), (6, 14)]
    assert sorted(r.run_id for r in health.append_runs(runs.filter("false"), new).collect()) == [0, 1]
    for _ in range(2):
        health.write_runs(new, str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 4


def test_external_ids_prefer_the_list(spark):
    agencies = spark.createDataFrame([(1, "Alpha Police"), (2, "Beta Police")], "agency_id long, canonical_name string")
    listing = spark.createDataFrame([('[{"id":9,"name":"Alpha"}]',)], "payload string")
    search = spark.createDataFrame([(1, '[{"id":7,"name":"Alpha"}]'), (2, '[{"id":8,"name":"Beta"}]')], "agency_id long, payload string")
    assert sorted(map(tuple, discovery.external_ids(agencies, listing, search).collect())) == [(1, "9")]
    empty = spark.createDataFrame([("[]",)], "payload string")
    assert sorted(map(tuple, discovery.external_ids(agencies, empty, search).collect())) == [(1, "7"), (2, "8")]


def test_time_to_live_over_many_spans(spark):
    """A key with most rows goes over spans and tasks; times, times to live and keys may be missing."""
    rng = np.random.default_rng(8)
    none = lambda v, share: None if rng.random() < share else v
    rows = [("hot" if rng.random() < 0.7 else none(f"k{rng.integers(0, 40)}", 0.1), none(int(rng.integers(0, 4000)), 0.02), none(int(rng.choice([-5, 0, 1, 30, 400, 5000])), 0.1)) for _ in range(3000)]
    want = {}
    for k in {r[0] for r in rows}:
        until, counts = None, [0, 0]
        # Without a time first; of equal times those whose mark ends first, or that leave none.
        for t, ttl in sorted(((t, ttl) for x, t, ttl in rows if x == k), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
            skip = t is not None and until is not None and t < until
            counts[skip] += 1
            if not skip:
                until = None if t is None or ttl is None else t + ttl
        want[k] = tuple(counts)
    df = spark.createDataFrame(rows, "k string, at long, ttl long").repartition(7)
    for span in (1, 2, 17, 500, 100_000):
        got = ingest.suppress_by_ttl(df, "k", "at", "ttl", span).collect()
        assert {r.k: (r.fetched, r.skipped) for r in got} == want and len(got) == len(want), span


def test_a_hot_key_is_dealt_to_several_tasks(spark):
    rows = spark.range(20_000).select(F.lit("hot").alias("k"), (F.col("id") * 7 % 20_000).alias("at"), F.lit(50).alias("ttl"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = rows.repartitionByRange("k", "at").groupBy(F.spark_partition_id()).count().collect()
        assert len(dealt) == 4 and max(r["count"] for r in dealt) < 8000
        assert [tuple(r) for r in ingest.suppress_by_ttl(rows, "k", "at", "ttl", 1000).collect()] == [("hot", 400, 19_600)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_longest_prefixes_meet_a_table_of_words(spark):
    rng, letters = np.random.default_rng(9), ["ab", "c", "de", "Los", "San"]
    name = lambda n: " ".join(rng.choice(letters, n))
    words = sorted({name(int(rng.integers(1, 4))) for _ in range(40)} | {"San  Two", "c ", "lone"})
    names = [(i, name(int(rng.integers(1, 6)))) for i in range(200)] + [(300, "lone"), (301, "lonely"), (302, "San  Two x"), (303, ""), (304, None), (305, "c  x"), (None, "lone x"), (1, "lone z")]
    df = spark.createDataFrame(names, "id int, name string")
    want = sorted(((i, max((w for w in words if n is not None and (n == w or n.startswith(w + " "))), key=len, default=None)) for i, n in names), key=str)
    got = matching.longest_prefixes(df, "id", "name", spark.createDataFrame([(w,) for w in [*words, *words]], "word string"))
    assert sorted(map(tuple, got.collect()), key=str) == want
    told = df.select("id", matching.longest_prefix(F.col("name"), words).alias("prefix"))
    assert sorted(map(tuple, told.collect()), key=str) == want
    many = spark.range(10_000).select(F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" x")).alias("word"))
    assert matching.longest_prefixes(spark.createDataFrame([(1, "w77 x y"), (2, "w77")], "id int, name string"), "id", "name", many).filter("prefix is not null").count() == 1


def test_feeds_tell_missing_agencies_apart(spark):
    agencies = spark.createDataFrame([(1,), (2,)], "agency_id long")
    feeds = spark.createDataFrame([(10, 1, "rss", "u", True), (11, 1, "rss", "v", False), (12, 9, "rss", "w", True)], "feed_id long, agency_id long, feed_type string, url string, is_active boolean")
    wanted = spark.createDataFrame([(1,), (2,), (3,), (3,)], "agency_id long")
    got = {(r.agency_id, r.found, r.feed_id) for r in registry.feeds_of(agencies, feeds, wanted).collect()}
    assert got == {(1, True, 10), (1, True, 11), (2, True, None), (3, False, None)}


def test_newest_runs_are_cut_before_the_shuffle(spark):
    runs = spark.range(100).selectExpr("id as run_id", "id % 3 as agency_id", "timestamp_ntz '2024-01-01' as run_at", "1 as docs_fetched")
    plan = health.recent_n_runs(runs, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan
