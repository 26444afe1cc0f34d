"""The registered queries: contracts, the oracle, and the pipeline against plain Python."""

from __future__ import annotations

import os
from collections import defaultdict

import pytest

import corpus_pipeline
from millrace.llm import decontaminate, queries, telephony

from ..conftest import SF
from ..test_oracles import rows_of
from .test_operators import brute_ids, brute_links, crc, prose

CONTRACTS = {
    "op3_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op5_chat_format": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
    "op6_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op7_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op8_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op10_telephony": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_contract(spark, name):
    df = queries.queries()[name](spark, SF)
    assert CONTRACTS[name].items() <= dict(df.dtypes).items()
    rows = df.collect()
    n = spark.read.parquet(f"{SF}/{'conversations' if name.startswith('op5') else 'documents'}.parquet")
    assert len(rows) == (n.select("conv_id").distinct().count() + 1 if name.startswith("op5") else n.count())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_chat_oracle(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    got = queries.queries()["op5_chat_format"](spark, SF).toPandas()
    assert rows_of(got) == rows_of(con.execute(queries.oracle_sql()["op5_chat_format"]).df())


def test_pipeline_matches_plain_python(spark, tmp_path):
    items = [(i, prose(900 + i, 25)) for i in range(4)]
    rows, labels = [], []
    for i in range(120):
        text = prose(i if i % 6 else i // 12, 60)
        if i % 5 == 1:
            text += " vile nasty"
        if i % 11 == 3:
            text += " " + items[i % 4][1]
        if i % 13 == 2:
            text += " password=abcdef123 end"
        rows.append((i, text, "en", "s", len(text)))
        if i % 2:
            labels.append((i, 1, int(i % 5 == 1)))
    rows.append((500, None, None, None, None))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = [(d, t) for d, t, *_ in rows if "vile" not in (t or "")]
    classes = defaultdict(list)
    for d, c, _ in brute_links(kept):
        classes[c].append(d)
    first = {min(own) for own in classes.values()}
    matcher = decontaminate.Matcher(items, decontaminate.ERROR_RATE)
    kept = [(d, (t or "").replace("password=abcdef123", "[SECRET]")) for d, t in kept if d in first and not matcher.matches(t or "")]
    got = defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id].append((r.start, list(r.ids)))
    assert set(got) == {d for d, _ in kept} and 500 in got and len(kept) < 90
    for d, t in kept:
        ids = [x for _, own in sorted(got[d]) for x in own]
        assert crc(ids) == crc(brute_ids(t, 1))


def test_stage_names_follow_the_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "decontamination", "secret_scans", "packing"]
    assert telephony.UNIT == 64


def test_stages_on_edge_rows(spark, tmp_path):
    from .test_operators import edge_rows, table

    spark.createDataFrame([(7, 0, 1), (None, None, None), (3, None, None), *((i, 1, 0) for i in (2, 4, 5, 6, 8, 9))], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (None, "zzzz"), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (edge_rows(), []):
        docs = table(spark, rows)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            assert out.count() == (8 if name == "ngram_jaccard_join" and rows else len(rows)), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).filter("doc_id = 1").count() == (1 if rows else 0)
