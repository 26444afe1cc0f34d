"""Row numbers, tables that change in place, the store of seen keys, and the vector index."""

from __future__ import annotations

import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import tables
from millrace.operators import documents, ingest
from millrace.operators.vector_index import VectorIndex
from millrace.tables import KeyedTable, SeenStore, number_rows


def test_rows_are_numbered_over_many_tasks(spark):
    """One group with most rows is spread; numbers are those of a sort, nulls, ties and empty tables included."""
    rng = np.random.default_rng(1)
    rows = [(i, None if i % 17 == 0 else "hot" if i % 5 else f"g{i % 3}", None if i % 29 == 0 else int(rng.integers(0, 50))) for i in range(6000)]
    df = spark.createDataFrame(rows, "id int, g string, v int").repartition(5)
    got = number_rows(df, F.desc("v"), "id", by=("g",), name="place")
    assert got.columns == ["id", "g", "v", "place"]
    places = {r.id: r.place for r in got.collect()}
    for g in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
        assert [places[r[0]] for r in own] == list(range(1, len(own) + 1))
    whole = number_rows(df, "id", name="id_place", first=0)
    assert all(r.id == r.id_place for r in whole.collect())
    assert number_rows(df.filter("false"), "id").count() == 0
    # The rows of the one group were placed by several tasks.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hot = df.filter("g = 'hot'")
        parts = hot.repartitionByRange("g", "v", "id").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert len(parts) > 2 and max(r["count"] for r in parts) < hot.count() / 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _files(table):
    top = f"{table.path}/data".removeprefix("file:")
    return {os.path.join(d, f) for d, _, names in os.walk(top) for f in names if f.endswith(".parquet")}


@pytest.fixture
def people(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"n{i}", "a") for i in range(200)], "k long, name string, town string")
    return KeyedTable.create(rows, f"file://{tmp_path}/people", "k", 8)


def _held(table):
    return {r.k: (r.name, r.town) for r in table.read().collect()}


def test_only_touched_buckets_are_written(spark, people):
    before = _files(people)
    new = spark.createDataFrame([(3, "x"), (1000, "y"), (1000, "z")], "k long, name string")
    touched = people.touched(new)
    people.upsert(new, ["name"])
    written = {f.split("bucket=")[1].split("/")[0] for f in _files(people) - before}
    assert len(touched) == 2 and written == {str(b) for b in touched} and before < _files(people)
    want = {i: (f"n{i}", "a") for i in range(200)} | {3: ("x", "a"), 1000: ("z", None)}
    assert _held(people) == want
    people.patch(spark.createDataFrame([(4, "b"), (5, None), (77777, "c")], "k long, town string"), ["town"])
    people.delete(spark.createDataFrame([(7,), (8,), (99999,)], "k long"))
    want[4] = ("n4", "b")
    del want[7], want[8]
    assert _held(people) == want


def test_a_crash_leaves_the_old_version(spark, people, monkeypatch):
    before = _held(people)

    def crash(*_):
        raise OSError("lost")

    with monkeypatch.context() as m, pytest.raises(OSError, match="lost"):
        m.setattr(KeyedTable, "_commit", crash)
        people.upsert(spark.createDataFrame([(3, "x")], "k long, name string"), ["name"])
    assert _held(people) == before
    people.upsert(spark.createDataFrame([(3, "x")], "k long, name string"), ["name"])
    assert _held(people) == before | {3: ("x", "a")}


def test_the_second_writer_of_a_version_fails(spark, people, monkeypatch):
    version, held, schema = people.manifest()
    people.delete(spark.createDataFrame([(3,)], "k long"))
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        people._commit(version + 1, held, schema)
    assert 3 not in _held(people)


def test_known_keys_are_refused(spark, people):
    before = _files(people)
    new = spark.createDataFrame([(5, "again", "t"), (300, "new", "t"), (300, "next", "t"), (301, "other", None)], "k long, name string, town string")
    refused = {(r.k, r.name) for r in people.insert(new, "name").collect()}
    assert refused == {(5, "again"), (300, "next")}
    held = _held(people)
    assert held[300] == ("new", "t") and held[301] == ("other", None) and held[5] == ("n5", "a") and len(held) == 202
    assert before < _files(people)  # nothing was written again
    assert people.insert(new, "name").count() == 4


def test_a_key_may_have_many_rows(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, i) for i in range(30)], "k int, v int")
    table = KeyedTable.create(rows, f"file://{tmp_path}/t", "k", 4)
    table.replace(spark.createDataFrame([(1, 100), (1, 101), (9, 102)], "k int, v int"))
    got = Counter((r.k, r.v) for r in table.read().collect())
    assert got == Counter([(i % 3, i) for i in range(30) if i % 3 != 1] + [(1, 100), (1, 101), (9, 102)])
    empty = KeyedTable.create(rows.filter("false"), f"file://{tmp_path}/e", "k", 4)
    assert empty.read().count() == 0 and empty.read().columns == ["k", "v"]
    empty.append(rows)
    assert empty.read().count() == 30


def _hashes(spark, a, b):
    return spark.range(a, b).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))


def test_seen_keys_are_found_and_other_buckets_left_out(spark, tmp_path, monkeypatch):
    store = SeenStore.create(_hashes(spark, 0, 4000), f"file://{tmp_path}/seen", 16, 5000)
    store.add(_hashes(spark, 3900, 5000))
    read = []
    whole = KeyedTable.read
    monkeypatch.setattr(KeyedTable, "read", lambda self, buckets=None: read.append(buckets) or whole(self, buckets))
    assert store.known(_hashes(spark, 4990, 5400)).count() == 10
    few = _hashes(spark, 4998, 5000).unionByName(_hashes(spark, 9000, 9006))
    known = store.known(few)
    assert {r.key for r in known.collect()} == {r.h for r in _hashes(spark, 4998, 5000).collect()}
    assert len(read[-1]) <= 4  # two keys' buckets of 16, and hardly a false one
    opened = {f.split("bucket=")[1].split("/")[0] for f in known.inputFiles() if "/keys/data/" in f}
    assert opened == {str(b) for b in read[-1]}
    # False hits are rare and harmless.
    assert store.candidates(_hashes(spark, 10_000, 20_000).withColumnRenamed("h", "key")).count() < 500
    assert store.known(_hashes(spark, 10_000, 20_000)).count() == 0
    assert store.known(spark.createDataFrame([(None,)], "h string")).count() == 0


def test_unseen_documents_are_new_ones(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"u{i % 40}", None if i == 3 else f"t{i % 60}") for i in range(300)], "doc_id long, url string, raw_text string")
    seen = docs.filter("doc_id % 7 = 2").select(ingest.doc_hash().alias("doc_hash")).distinct()
    store = SeenStore.create(seen, f"file://{tmp_path}/seen", 8, 1000)
    key = lambda df: sorted((r.doc_id, r.doc_hash) for r in df.collect())
    assert key(ingest.unseen_documents(docs, store)) == key(ingest.new_documents(docs, seen))
    empty = SeenStore.create(seen.filter("false"), f"file://{tmp_path}/none", 8, 1000)
    assert key(ingest.unseen_documents(docs, empty)) == key(ingest.new_documents(docs, seen.filter("false")))


def _clustered(spark, n, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, 24)) * 2
    rows = [(i, [float(x) for x in centres[i % 20] + rng.normal(size=24) * 0.6], int(i % 10)) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [0.0] * 24, 1), (n + 2, [1.0], 1), (n + 3, [float("nan")] * 24, 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), rows[:n]


def test_vector_index_recall_and_share_read(spark, tmp_path):
    vectors, rows = _clustered(spark, 2000)
    good = vectors.filter("vec_id < 2000")
    index = VectorIndex.build(vectors, f"file://{tmp_path}/ix", 20)
    assert index.sizes.sum() == 2000
    probes = index.calibrate(good, 10, 0.95, 20)
    hits = total = 0
    for i in range(0, 200, 20):
        want = [r.vec_id for r in documents.nearest(good, rows[i][1], 10).collect()]
        got = index.search(rows[i][1], 10, probes=probes)
        hits, total = hits + len({r.vec_id for r in got.collect()} & set(want)), total + 10
        assert len(got.inputFiles()) and index.read_lists == probes
        exact = index.search(rows[i][1], 10, F.expr("label % 2 = 0"), probes=1, exact=True)
        assert exact.collect() == documents.nearest(good, rows[i][1], 10, F.expr("label % 2 = 0")).collect()
    assert hits >= 0.95 * total and probes <= 10
    lists = {f.split("list=")[1].split("/")[0] for f in index.search(rows[0][1], 10, probes=2).inputFiles()}
    assert len(lists) == 2  # of 20: others' files aren't opened


def test_vector_index_of_nothing(spark, tmp_path):
    vectors, _ = _clustered(spark, 3)
    index = VectorIndex.build(vectors.filter("vec_id in (3, 4, 6)"), f"file://{tmp_path}/none", 4)
    assert index.lists == [] and index.search([1.0] * 24, 5).count() == 0 and index.search([1.0] * 24, 5, exact=True).count() == 0
    few = VectorIndex.build(vectors, f"file://{tmp_path}/few", 64)
    assert few.search([1.0] * 24, 5, exact=True).count() == 3
    with pytest.raises(ValueError, match="24 numbers"):
        few.search([1.0], 5)
    assert tables.fresh(vectors, "label", "x") == ["label_", "x"]
