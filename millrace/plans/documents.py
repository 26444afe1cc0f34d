"""Document table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import constants as K
from millrace.functions.dates import business_deadline
from millrace.operators import documents as O
from millrace.sources.standins import load

from .base import query

_LEGACY = "coalesce(case document_type " + " ".join(f"when '{a}' then '{b}'" for a, b in K.LEGACY_TYPES.items()) + " end, document_type)"
_CADS = "case doc_id % 5 when 0 then '24-0001,24-0002' when 1 then '' when 2 then '' else '24-' || cast(doc_id as string) end"


def _migrated(spark, sf_dir):
    rows = load(spark, sf_dir, "docs")[0].selectExpr("doc_id as id", "url", "document_type", "published_at as published_date", "timestamp_ntz '2024-06-01 00:00:00' as ingested_at", "cad_json")
    return O.migrate(rows)


@query("migrate_documents", f"select doc_id, url as source_url, {_LEGACY} as document_type, coalesce(published_at, timestamp '2024-06-01 00:00:00') as published_date, {_CADS} as cads, doc_id % 5 not in (1, 2) as foia_eligible from docs")
def migrate_documents(spark, sf_dir):
    return _migrated(spark, sf_dir).select("doc_id", "source_url", "document_type", "published_date", F.array_join("cad_numbers", ",").alias("cads"), "foia_eligible")


@query("foia_eligible_docs", "select doc_id from docs where doc_id % 5 not in (1, 2)")
def foia_eligible_docs(spark, sf_dir):
    return _migrated(spark, sf_dir).filter("foia_eligible").select("doc_id")


@query("docs_by_cad_number", "select doc_id from docs where doc_id % 5 = 0 or doc_id = 13")
def docs_by_cad_number(spark, sf_dir):
    wanted = F.array(F.lit("24-0002"), F.lit("24-13"))
    return _migrated(spark, sf_dir).filter(F.arrays_overlap("cad_numbers", wanted)).select("doc_id")


_QUEUE = "select doc_id, case doc_id % 3 when 0 then 'pending' when 1 then 'filed' else 'closed' end as status, cast(doc_id * 37 % 101 as int) as priority_score from docs where doc_id % 4 = 0"


def _queue(spark, sf_dir):
    (docs,) = load(spark, sf_dir, "docs")
    return spark.sql(_QUEUE.replace("from docs", "from {docs}"), docs=docs)


@query("foia_pending", "select doc_id from docs where doc_id % 5 not in (1, 2) and doc_id % 4 <> 0")
def foia_pending(spark, sf_dir):
    return O.pending_requests(_migrated(spark, sf_dir), _queue(spark, sf_dir)).select("doc_id")


@query("foia_queue_order", f"with q as ({_QUEUE}) select row_number() over (order by status, priority_score desc, doc_id) as place, doc_id, status, priority_score from q")
def foia_queue_order(spark, sf_dir):
    return O.queue_places(_queue(spark, sf_dir)).select("place", "doc_id", "status", "priority_score")


@query("foia_queue_top", f"with q as ({_QUEUE}) select doc_id, status, priority_score from q order by status, priority_score desc, doc_id limit 100")
def foia_queue_top(spark, sf_dir):
    return O.queue_order(_queue(spark, sf_dir)).limit(100)


@query(
    "business_deadline",
    "with s as (select distinct cast(o_orderdate as date) as day from orders), d as (select day, unnest(range(1, 25)) as i from s), w as (select day, day + cast(i as int) as later, row_number() over (partition by day order by i) as n from d where isodow(day + cast(i as int)) < 6) select cast(day as string) as day, cast(later as string) as deadline from w where n = 10",
)
def business_deadline_query(spark, sf_dir):
    days = load(spark, sf_dir, "orders")[0].select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return days.select(F.col("day").cast("string").alias("day"), business_deadline(F.col("day")).cast("string").alias("deadline"))


@query("extract_case_numbers", "select doc_id, case doc_id % 3 when 0 then '24-' || cast(doc_id as string) when 1 then 'A' || cast(doc_id as string) || ',77' else '' end as numbers from docs")
def extract_case_numbers(spark, sf_dir):
    text = F.expr("case doc_id % 3 when 0 then 'See Case No. 24-' || cast(doc_id as string) || ' and case: 24-' || cast(doc_id as string) when 1 then 'CAD#A' || cast(doc_id as string) || '; incident 77' else 'in this case nothing' end")
    return load(spark, sf_dir, "docs")[0].select("doc_id", F.array_join(O.case_numbers(text), ",").alias("numbers"))


@query(
    "vector_topk",
    """with q as (select embedding as e from embeddings where vec_id = (select min(vec_id) from embeddings)), s as (select vec_id, list_sum(list_transform(range(1, len(embedding) + 1), lambda i: embedding[i]::double * e[i]::double)) / sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) / sqrt(list_sum(list_transform(e, lambda x: x::double * x::double))) as similarity from embeddings, q where label % 2 = 0)
       select vec_id, round(similarity, 6) as similarity from s order by s.similarity desc, vec_id limit 20""",
)
def vector_topk(spark, sf_dir):
    (vectors,) = load(spark, sf_dir, "embeddings")
    q = vectors.agg(F.min_by("embedding", "vec_id")).scalar()
    return O.nearest(vectors, q, 20, F.expr("label % 2 = 0")).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("list_item_projection", "select agency_id, canonical_name, county, region, agency_type, platform_type, homepage_url, has_activity_data from agencies")
def list_item_projection(spark, sf_dir):
    return load(spark, sf_dir, "agencies")[0].drop("external_id", "last_verified")
