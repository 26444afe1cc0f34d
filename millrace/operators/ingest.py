"""Ingestion operators: content and address deduplication, inserts, queues, rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ttl import suppress_by_ttl  # noqa: F401
from millrace.tables import SeenStore, number_rows


def doc_hash(url: str = "url", text: str = "raw_text") -> Column:
    return F.sha2(F.concat(F.coalesce(F.col(url), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))).cast("binary"), 256)


def url_key(url: str = "url", prefix: str = "url:") -> Column:
    return F.concat(F.lit(prefix), F.sha2(F.col(url).cast("binary"), 256))


def new_documents(docs: DataFrame, seen: DataFrame, order: str = "doc_id") -> DataFrame:
    """The first row of each content hash that isn't in ``seen`` (column doc_hash)."""
    first = F.min_by(F.struct(*docs.columns), order).alias("first")
    return docs.groupBy(doc_hash().alias("doc_hash")).agg(first).join(seen, "doc_hash", "left_anti").select("first.*", "doc_hash")


def unseen_documents(docs: DataFrame, store: SeenStore, order: str = "doc_id") -> DataFrame:
    """As ``new_documents`` against a store of seen hashes, of which only buckets are read that may hold one."""
    return new_documents(docs, store.known(docs.select(doc_hash())).select(F.col("key").alias("doc_hash")), order)


def insert_counts(docs: DataFrame, target: DataFrame) -> DataFrame:
    """Rows of each agency that an insert which ignores known hashes adds."""
    return new_documents(docs, target).groupBy("agency_id").agg(F.count("*").alias("inserted"))


def rate_limited_schedule(requests: DataFrame, domain: str, at: str, order: str, delay: float, span: float = 86400.0) -> DataFrame:
    """When each request may start if a domain's requests are ``delay`` seconds apart: with i
    the request's rank, i * delay + max over j <= i of (arrival_j - j * delay).

    Ranks and maxima are taken within a domain's spans of time, which are windows of their own, and
    carried on from span to span by a window over one row each. So a domain's requests aren't
    sorted as one."""
    rows = requests.withColumn("__span", F.floor(F.col(at) / span))
    w = Window.partitionBy(domain, "__span").orderBy(at, order)
    ranked = rows.withColumn("__i", F.row_number().over(w) - 1)
    ranked = ranked.withColumn("__slack", F.max(F.col(at) - F.col("__i") * delay).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    per = ranked.groupBy(domain, "__span").agg(F.count("*").alias("__n"), F.max("__slack").alias("__most"))
    before = Window.partitionBy(domain).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    per = per.withColumn("__before", F.max(F.col("__most") - F.col("__first") * delay).over(before)).drop("__n", "__most")
    joined = ranked.join(per, ranked[domain].eqNullSafe(per[domain]) & ranked["__span"].eqNullSafe(per["__span"])).drop(per[domain]).drop(per["__span"])
    start = (F.col("__first") + F.col("__i")) * delay + F.greatest("__before", F.col("__slack") - F.col("__first") * delay)
    return joined.withColumn("start_at", start).drop("__span", "__i", "__slack", "__first", "__before")


def bounded_slots(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """``rows`` dealt out to ``most`` slots by ``key``, with their turn in the slot: what runs one
    after another in a slot never has more than ``most`` going on at once."""
    return number_rows(rows.withColumn("slot", F.pmod(F.col(key), F.lit(most)).cast("int")), order, by=("slot",), name="turn")


def single_run(agencies: DataFrame, feeds: DataFrame, fetched: DataFrame, seen: DataFrame, agency_id, columns: list[str], dry_run: bool = False) -> DataFrame:
    """The payloads that an ad-hoc run for one agency prints (``dry_run``) or pushes: documents of its
    active feeds, whatever their time to live, if it has a platform; those that were seen
    before aren't pushed. No run is recorded."""
    one = agencies.filter((F.col("agency_id") == agency_id) & (F.coalesce("platform_type", F.lit("")) != "")).select("agency_id")
    own = feeds.filter("is_active").join(one, "agency_id", "left_semi").select("feed_id")
    docs = fetched.join(own, "feed_id", "left_semi")
    return encode_queue(docs if dry_run else new_documents(docs, seen), columns)


def take_while(pages: DataFrame, key: str, page: str, more: Column, found: Column, most: int) -> DataFrame:
    """Pages up to the first one without documents (left out) or without a next link (kept)."""
    before = Window.partitionBy(key).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(key).orderBy(page).rowsBetween(Window.unboundedPreceding, 0)
    ok = pages.withColumn("__more", more.cast("int")).withColumn("__found", found.cast("int")).filter(F.col(page) <= most)
    kept = ok.withColumn("__a", F.coalesce(F.min("__more").over(before), F.lit(1))).withColumn("__b", F.min("__found").over(upto))
    gapless = kept.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(page)))
    return gapless.filter((F.col("__a") == 1) & (F.col("__b") == 1) & (F.col("__n") == F.col(page))).drop("__a", "__b", "__n", "__more", "__found")


def encode_queue(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("payload"))


def decode_queue(queue: DataFrame, schema: str, payload: str = "payload") -> DataFrame:
    """Decoded elements; ``corrupt`` holds payloads that are no JSON objects."""
    parsed = F.from_json(payload, f"{schema}, corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"})
    return queue.select(F.col(payload), parsed.alias("d")).select(payload, "d.*")


def dead_letters(results: DataFrame, attempts: int = 3) -> DataFrame:
    """agency_id and error of runs that failed ``attempts`` times."""
    return results.filter(F.col("error").isNotNull() & (F.col("attempt") >= attempts)).select("agency_id", "error")


def chunk(docs: DataFrame, size: int, keep: tuple[str, ...] = ("doc_id", "agency_id")) -> DataFrame:
    """Fixed-width slices of a document's text, with its metadata on each."""
    cuts = F.expr(f"transform(sequence(0, greatest(0, cast((length(raw_text) - 1) div {size} as int))), i -> substring(raw_text, i * {size} + 1, {size}))")
    return docs.select(*keep, F.posexplode(cuts).alias("chunk_index", "chunk_text"))
