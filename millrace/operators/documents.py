"""Document table operators: schema migration, eligibility, request queue, similarity search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.classify import legacy_type
from millrace.functions.dates import business_deadline
from millrace.tables import number_rows

CASE_NUMBER = r"(?i)\b(?:CAD|DR|case|report\s+no\.?|incident)[#:\s]+(?:no\.?\s*|number\s*)?([\w-]*\d[\w-]*)"


def migrate(docs: DataFrame) -> DataFrame:
    """The later layout: renamed columns, mapped types, JSON lists as arrays, dates filled from the
    time of fetching, and columns with defaults."""
    out = docs.withColumnsRenamed({"id": "doc_id", "url": "source_url", "ingested_at": "scraped_at"})
    numbers = F.coalesce(F.from_json("cad_json", "array<string>"), F.array().cast("array<string>"))
    out = out.withColumns({"document_type": legacy_type(F.col("document_type")), "cad_numbers": numbers, "published_date": F.coalesce("published_date", "scraped_at")})
    empty = F.array().cast("array<string>")
    return out.withColumns({"case_numbers": empty, "chunk_ids": empty, "cleaned_text": F.lit(None).cast("string"), "parse_quality": F.lit(None).cast("short"), "foia_eligible": eligible(F.col("cad_numbers"), empty)}).drop("cad_json")


def eligible(cad_numbers: Column, case_numbers: Column) -> Column:
    """Whether any number is known; nulls and empty lists are none."""
    return (F.coalesce(F.size(cad_numbers), F.lit(0)) > 0) | (F.coalesce(F.size(case_numbers), F.lit(0)) > 0)


def pending_requests(docs: DataFrame, queue: DataFrame) -> DataFrame:
    """Eligible documents without a request."""
    return docs.filter("foia_eligible").join(queue.select("doc_id"), "doc_id", "left_anti")


def queue_places(queue: DataFrame) -> DataFrame:
    """The queue with each request's place. Requests of one status and score may be in several tasks."""
    return number_rows(queue, "status", F.desc("priority_score"), "doc_id", name="place")


def queue_order(queue: DataFrame) -> DataFrame:
    return queue.orderBy("status", F.desc("priority_score"), "doc_id")


def deadline(day: Column, days: int = 10) -> Column:
    return business_deadline(day, days)


def case_numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(CASE_NUMBER), F.lit(1)))


def nearest(vectors: DataFrame, query: list[float] | Column, k: int, where: Column | None = None) -> DataFrame:
    """vec_id and cosine similarity of the ``k`` nearest vectors that fit ``where``: one pass, and
    a top-k that keeps k rows a task."""
    given = query if isinstance(query, Column) else F.array(*(F.lit(float(x)) for x in query))
    q = F.col("__query")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    rows = (vectors if where is None else vectors.filter(where)).withColumn("__query", given)
    norm = F.sqrt(dot(F.col("embedding"), F.col("embedding"))) * F.sqrt(dot(q, q))
    return rows.select("vec_id", (dot(F.col("embedding"), q) / norm).alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(k)
