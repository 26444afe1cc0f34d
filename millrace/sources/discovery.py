"""Feed discovery and delimited files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import constants as K
from millrace.functions import urls as U
from millrace.operators.matching import fuzzy_match, tokens

MOST_CANDIDATES = 15


def candidate_links(pages: DataFrame, key: str, homepage: str, html: str, probes: bool = False) -> DataFrame:
    """key, pos, url: a page's internal links whose path has a news word, in order and once each;
    with ``probes`` the usual paths come first."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))
    links = F.transform(found, lambda h: F.regexp_replace(h, r"(?U)^\s+|\s+$", ""))
    rows = pages.select(key, F.col(homepage).alias("h"), F.posexplode(links).alias("pos", "href")).filter(~F.col("href").contains("#"))
    rows = rows.select(key, "h", "pos", U.resolve(F.col("h"), F.col("href")).alias("url"))
    p, base = U.parts(F.col("url")), U.parts(F.col("h"))
    rows = rows.filter((p["netloc"] == base["netloc"]) & p["scheme"].isin("http", "https") & F.lower(p["path"]).rlike("|".join(K.NEWS_WORDS)))
    if probes:
        roots = pages.select(key, F.concat(U.parts(F.col(homepage))["scheme"], F.lit("://"), U.parts(F.col(homepage))["netloc"]).alias("r"), F.posexplode(F.array(*map(F.lit, K.PROBE_PATHS))).alias("pos", "path"))
        rows = rows.select(key, (F.col("pos") + len(K.PROBE_PATHS)).alias("pos"), "url").unionByName(roots.select(key, "pos", F.concat("r", "path").alias("url")))
    first = rows.groupBy(key, "url").agg(F.min("pos").alias("pos"))
    order = F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1
    return first.withColumn("pos", order.cast("int")).filter(F.col("pos") < MOST_CANDIDATES).select(key, "pos", "url")


def first_working(links: DataFrame, key: str, pos: str, docs: str) -> DataFrame:
    """The first candidate of each key that gave documents."""
    return links.filter(F.col(docs) > 0).groupBy(key).agg(F.min_by("url", pos).alias("url"))


def report_lines(rows: DataFrame, sep: str = "|") -> DataFrame:
    """Rows as delimited lines (column ``value``): nulls are empty, timestamps ISO."""
    fields = [F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") if t.startswith("timestamp") else F.col(c).cast("string"), F.lit("")).alias(c) for c, t in rows.dtypes]
    return rows.select(F.to_csv(F.struct(*fields), {"sep": sep, "emptyValue": ""}).alias("value"))


def write_report(rows: DataFrame, path: str) -> None:
    """A CSV report with a header; nulls are empty."""
    rows.write.mode("overwrite").option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss").option("nullValue", "").csv(path)


def read_pipe_csv(lines: DataFrame, schema: str, sep: str = "|") -> DataFrame:
    """Delimited lines as columns; a file goes through ``spark.read.csv`` with the same options."""
    return lines.select(F.from_csv("value", schema, {"sep": sep}).alias("r")).select("r.*")


def read_pipe_file(spark, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("sep", "|").option("header", True).option("encoding", "UTF-8")
    return (reader.schema(schema) if schema else reader).csv(path)


def external_agencies(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """external_id and name of agencies in a JSON list, bare or under ``agencies``/``Agencies``."""
    return external_list(payloads, [], payload).select("external_id", "name")


def external_list(payloads: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """keys, pos, external_id and name of the agencies in each JSON list."""
    item = "array<map<string,string>>"
    under = lambda n: F.from_json(F.get_json_object(payload, f"$.{n}"), item, {"mode": "PERMISSIVE"})
    bare = F.from_json(payload, item, {"mode": "PERMISSIVE"})
    rows = payloads.select(*keys, F.posexplode(F.when(F.ltrim(payload).startswith("["), bare).otherwise(F.coalesce(under("agencies"), under("Agencies")))).alias("pos", "m"))
    get = lambda *names: F.coalesce(*(F.try_element_at("m", F.lit(n)) for n in names))
    return rows.select(*keys, "pos", get("agencyId", "AgencyId", "id").alias("external_id"), get("agencyName", "name").alias("name"))


def external_ids(agencies: DataFrame, listing: DataFrame, searches: DataFrame, least: float = 0.6) -> DataFrame:
    """agency_id and external_id of the agencies (agency_id, canonical_name) that match an entry of the
    service's list (``listing``: payload, and page if there are several); if the list is empty, one of the answers to a search
    for their own name (``searches``: agency_id, payload)."""
    targets = agencies.select(F.col("agency_id").alias("target_id"), F.col("canonical_name").alias("name"))
    paged = listing if "page" in listing.columns else listing.withColumn("page", F.lit(0))
    place = F.shiftleft(F.col("page").cast("long"), 24) + F.col("pos")
    listed = external_list(paged, ["page"]).select(place.alias("pos"), "external_id", "name")
    best = fuzzy_match(targets, listed.select(F.col("pos").alias("candidate_id"), "name"), least)
    by_list = best.join(listed.select(F.col("pos").alias("candidate_id"), "external_id"), "candidate_id").select(F.col("target_id").alias("agency_id"), "external_id")
    empty = listed.agg(F.count("*") == 0).scalar()
    found = external_list(searches.filter(empty), ["agency_id"])
    rows = found.join(targets.withColumnsRenamed({"target_id": "agency_id", "name": "wanted"}), "agency_id")
    overlap = F.size(F.array_intersect(tokens(F.col("wanted")), tokens(F.col("name")))) / F.size(tokens(F.col("wanted")))
    rows = rows.withColumn("overlap", overlap).filter(F.col("overlap") >= least)
    by_search = rows.groupBy("agency_id").agg(F.max_by("external_id", F.struct("overlap", -F.col("pos"))).alias("external_id"))
    return by_list.unionByName(by_search).filter(F.col("external_id").isNotNull())
