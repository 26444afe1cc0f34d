"""Parsers from fetched responses to normalised documents.

A source says how a response's columns give an array of items, and how an item gives a document. So
responses of many platforms can be read in one pass: the platform picks the array, and the fields.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import constants as K
from millrace.functions import dates as T
from millrace.functions import detect as D
from millrace.functions import maps as M
from millrace.functions import urls as U
from millrace.functions.classify import let
from millrace.session import ship_package

PAGE_SIZE = 1000


def page_query(platform: str, offset: Column, date_field: str | None = None, days: int = 30, as_of: Column | None = None) -> Column:
    """The query of a page of an open-data set (socrata) or map layer (arcgis): rows after ``offset``,
    and where a date field is known, those of the last ``days`` before ``as_of`` only."""
    since = None if date_field is None else as_of - F.make_dt_interval(days=F.lit(days))
    at = offset.cast("string")
    if platform == "socrata":
        where = F.lit("") if since is None else F.concat(F.lit(f"&$where={date_field} > '"), F.date_format(since, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("'"))
        return F.concat(F.lit(f"$limit={PAGE_SIZE}&$offset="), at, where)
    where = F.lit("1=1") if since is None else F.concat(F.lit(f"{date_field} > DATE '"), F.date_format(since, "yyyy-MM-dd"), F.lit("'"))
    return F.concat(F.lit("where="), where, F.lit("&outFields=*&f=json&resultOffset="), at, F.lit(f"&resultRecordCount={PAGE_SIZE}"))


PLATFORMS = ("arcgis", "citizenrims", "civicplus", "crimemapping", "nixle", "pdf", "rss", "socrata")


def route(platform: Column, external_id: Column, strict: bool = False) -> Column:
    """The parser of a platform: ``rave`` is read as ``nixle``; ``crimemapping`` needs an external
    id. An unknown platform is null, or an error if ``strict``."""
    p = F.lower(platform)
    known = F.when(p == "rave", F.lit("nixle")).when((p == "crimemapping") & external_id.isNull(), F.lit(None)).when(p.isin(*PLATFORMS), p)
    return F.when(p.isNotNull() & ~p.isin("rave", *PLATFORMS), F.raise_error(F.concat(F.lit("no parser for "), p))).otherwise(known) if strict else known


def alert_route(url: Column) -> Column:
    return F.when(url.rlike("(?i)/(rss|feed)"), F.lit("rss")).otherwise(F.lit("nixle"))


RAW_DOCUMENT = "url string, document_type string, title string, raw_text string, published_date timestamp_ntz, metadata map<string,string>"


def squash(text: Column) -> Column:
    from millrace.functions.maps import squash as run

    return run(text)


Cols = dict[str, Column]


@dataclass(frozen=True)
class Source:
    """``items``: a response's columns (named by ``inputs``) as an array. ``fields``: an item and the
    response's columns as the fields of a document but for its place. ``fault``: what is wrong with the
    response, null if it can be read."""

    inputs: tuple[str, ...]
    items: Callable[[Cols], Column]
    fields: Callable[[Column, Cols], Cols]
    fault: Callable[[Cols], Column]

    def documents(self, responses: DataFrame, keys: list[str], **columns: str) -> DataFrame:
        """keys, pos and the fields of each document; ``columns``: what the inputs are called."""
        cols = {n: F.col(columns.get(n, n)) for n in self.inputs}
        rows = responses.select(*keys, *(c.alias(f"__{n}") for n, c in cols.items()), F.posexplode(self.items(cols)).alias("pos", "__i"))
        made = self.fields(F.col("__i"), {n: F.col(f"__{n}") for n in self.inputs})
        return rows.select(*keys, "pos", *(c.alias(n) for n, c in made.items()))


def _no_response(name: str) -> Callable[[Cols], Column]:
    return lambda r: F.when(r[name].isNull(), F.lit("no response"))


def _unreadable(name: str, parsed: Callable[[Cols], Column]) -> Callable[[Cols], Column]:
    return lambda r: F.when(r[name].isNull(), F.lit("no response")).when(parsed(r).isNull(), F.lit("response can't be read"))


def _meta(**values: Column) -> Column:
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v.cast("string"))))


def _join_title(title: Column, body: Column) -> Column:
    return squash(F.when(F.coalesce(title, F.lit("")) != "", F.concat(title, F.lit(". "), F.coalesce(body, F.lit("")))).otherwise(F.coalesce(body, F.lit(""))))


_ITEM = "array<struct<href:string,title:string,body:string,date:string>>"


def _items(html: Column, extract) -> Column:
    """Items of an HTML page; ``extract`` gives tuples and runs in an Arrow-batched UDF."""
    ship_package(SparkSession.getActiveSession())

    @F.pandas_udf(_ITEM)
    def run(s: pd.Series) -> pd.Series:
        names = ("href", "title", "body", "date")
        return s.map(lambda h: [dict(zip(names, x, strict=True)) for x in extract(h or "")])

    return run(html)


def listing_items(html: str) -> list[tuple]:
    from .html import first_selected, parse

    out = []
    for a in first_selected(parse(html), K.LISTING_SELECTORS):
        link = a.find("a", cls="article-title-link") or a.find("a", has="href")
        title = a.find("h2") or a.find("h3") or a.find("h4") or link
        body = a.find(cls="article-preview") or a.find(cls="alertContent") or a.find("p")
        foot, date = a.find(cls="article-list-footer"), None
        if foot and (note := foot.find(cls="fst-italic")):
            date = note.text()
        if not date and (t := a.find("time")):
            date = t.attrs.get("datetime") or t.text()
        for cls in ("date", "alertDate"):
            if not date and (el := a.find(cls=cls)):
                date = el.text()
        out.append((link.attrs.get("href") or None if link else None, title.text() if title else None, body.text(" ") if body else "", date or None))
    return out


def _alert_items(html: str) -> list[tuple]:
    from .html import first_selected, parse

    out = []
    for a in first_selected(parse(html), K.ALERT_SELECTORS):
        link = a.find("a", href=re.compile(r"/alert/(\w+)/?")) or a.find("a", has="href")
        title = a.find("h2") or a.find("h3") or a.find("h4") or link
        body = next((b for b in (a.find(cls=c) for c in ("alert-body", "alertBody", "alert-content", "alertContent")) if b), None) or a.find("p")
        t, date = a.find("time"), None
        if t:
            date = t.attrs.get("datetime") or t.text()
        for cls in ("alert-date", "alertDate", "date", "published"):
            if not date and (el := a.find(cls=cls)):
                date = el.text()
        out.append((link.attrs.get("href") or None if link else None, title.text() if title else None, body.text(" ") if body else "", date or None))
    return out


def _linked(i: Column, url: Column) -> Column:
    return F.when(i["href"].isNull(), url).otherwise(U.resolve(url, i["href"]))


def _listing_fields(i: Column, r: Cols) -> Cols:
    url = r["url"]
    return {"url": _linked(i, url), "document_type": D.listing_type(url), "title": F.nullif(i["title"], F.lit("")), "raw_text": _join_title(i["title"], i["body"]), "published_date": T.listing_date(i["date"]), "metadata": _meta(page_url=url)}


def _alert_fields(i: Column, r: Cols) -> Cols:
    link, platform = _linked(i, r["url"]), F.when(r["url"].contains("nixle.com"), "nixle").otherwise("rave")
    return {"url": link, "document_type": F.lit("alert"), "title": F.nullif(i["title"], F.lit("")), "raw_text": _join_title(i["title"], i["body"]), "published_date": T.alert_date(i["date"]), "metadata": _meta(nixle_alert_id=U.alert_id(link), alert_url=link, platform=platform)}


LISTING = Source(("url", "html"), lambda r: _items(r["html"], listing_items), _listing_fields, _no_response("html"))
ALERTS = Source(("url", "html"), lambda r: _items(r["html"], _alert_items), _alert_fields, _no_response("html"))


def parse_listing(responses: DataFrame, keys: list[str], **columns: str) -> DataFrame:
    """News listings: a document for each article that the first fitting selector picks."""
    return LISTING.documents(responses, keys, **columns)


def parse_alerts(responses: DataFrame, keys: list[str], **columns: str) -> DataFrame:
    """Alert listings; the platform follows from the page's address."""
    return ALERTS.documents(responses, keys, **columns)


def cell_roles(cells: Column) -> Column:
    """Struct of date, type, address and description: each cell takes the first role that is free
    and fits it; free roles then take the first, second and third cell."""
    none = F.lit(None).cast("string")
    start = F.struct(*(none.alias(n) for n in ("date", "type", "address", "description")))

    def step(acc: Column, text: Column) -> Column:
        dated, placed = text.rlike(r"\d{1,2}/\d{1,2}/\d{4}|\d{4}-\d{2}-\d{2}"), text.rlike(r"(?iU)\d+\s+\w+\s+(st|ave|blvd|dr|rd|ln|way|ct|pl)\b")
        role = F.when(acc["date"].isNull() & dated, 0).when(acc["type"].isNull() & ~placed, 1).when(acc["address"].isNull() & placed, 2).when(acc["description"].isNull() & (F.length(text) > 5), 3)
        return F.struct(*(F.when(role == i, text).otherwise(acc[n]).alias(n) for i, n in enumerate(("date", "type", "address", "description"))))

    def fill(acc: Column) -> Column:
        return F.struct(F.coalesce(acc["date"], F.get(cells, 0)).alias("date"), F.coalesce(acc["type"], F.get(cells, 1)).alias("type"), F.coalesce(acc["address"], F.get(cells, 2)).alias("address"), acc["description"].alias("description"))

    return F.aggregate(cells, start, step, fill)


def _table_rows(html: Column) -> Column:
    ship_package(SparkSession.getActiveSession())

    @F.pandas_udf("array<array<string>>")
    def rows_of(s: pd.Series) -> pd.Series:
        from .html import first_selected, parse

        return s.map(lambda h: [[c.text(" ") for c in r.walk() if c.tag == "td"] for r in first_selected(parse(h or ""), K.TABLE_SELECTORS, "td")])

    return F.transform(rows_of(html), lambda cells: F.struct(cells.alias("cells"), cell_roles(cells).alias("r")))


def _table_fields(i: Column, r: Cols) -> Cols:
    cells, own = i["cells"], i["r"]
    parts = F.filter(F.array(own["type"], own["address"], own["description"]), lambda x: F.coalesce(x, F.lit("")) != "")
    text = squash(F.when(F.size(parts) > 0, F.array_join(parts, " at ")).otherwise(F.array_join(cells, " ")))
    raw = F.when(text != "", text).otherwise(F.array_join(F.slice(cells, 1, 3), " "))
    return {"url": r["url"], "document_type": F.lit("incident_log"), "title": own["type"], "raw_text": raw, "published_date": T.table_date(own["date"]), "metadata": _meta(address=own["address"], incident_type=own["type"], page_url=r["url"])}


TABLE = Source(("url", "html"), lambda r: _table_rows(r["html"]), _table_fields, _no_response("html"))


def parse_incident_table(responses: DataFrame, keys: list[str], **columns: str) -> DataFrame:
    """Incident tables: a document for each row with data cells."""
    return TABLE.documents(responses, keys, **columns)


_TEXT = "struct<_VALUE:string,_type:string>"
_FEED_ITEM = "struct<title:string,link:string,description:string,summary:string,encoded:string,content:string,pubDate:string,published:string,updated:string>"
_ENTRY = f"struct<title:{_TEXT},link:array<struct<_href:string,_rel:string>>,summary:{_TEXT},content:array<{_TEXT}>,published:string,updated:string>"


def _feed_root(r: Cols) -> Column:
    plain = F.regexp_replace(F.regexp_replace(r["xml"], r"<(/?)content:encoded", "<$1encoded"), r"<(/?)atom:(\w+)", "<$1atom_$2")
    return F.from_xml(plain, f"channel struct<title:string,item:array<{_FEED_ITEM}>>, title {_TEXT}, entry array<{_ENTRY}>")


def _feed_items(r: Cols) -> Column:
    none = F.lit(None).cast("string")

    def as_item(e: Column) -> Column:
        link = F.get(F.filter(e["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"]
        fields = {"title": e["title"]["_VALUE"], "link": link, "description": none, "summary": e["summary"]["_VALUE"], "encoded": none, "content": F.get(e["content"], F.lit(0))["_VALUE"], "pubDate": none, "published": e["published"], "updated": e["updated"]}
        return F.struct(*(c.alias(n) for n, c in fields.items()))

    def told(x: Column) -> Column:
        title = F.coalesce(x["channel"]["title"], x["title"]["_VALUE"], F.lit(""))
        return F.transform(F.coalesce(x["channel"]["item"], F.transform(x["entry"], as_item)), lambda i: F.struct(title.alias("feed_title"), i.alias("i")))

    return let(_feed_root(r), told)


def _feed_fields(item: Column, r: Cols) -> Cols:
    i, title = item["i"], item["feed_title"]
    body = F.coalesce(i["encoded"], i["content"], i["summary"], i["description"], F.lit(""))
    return {"url": F.coalesce(i["link"], r["url"]), "document_type": D.feed_title_type(title), "title": F.nullif(i["title"], F.lit("")), "raw_text": squash(body), "published_date": T.feed_date(F.coalesce(i["pubDate"], i["published"]), i["updated"]), "metadata": _meta(feed_url=r["url"], feed_title=title)}


FEED = Source(("url", "xml"), _feed_items, _feed_fields, _unreadable("xml", lambda r: let(_feed_root(r), lambda x: F.coalesce(x["channel"].cast("string"), x["title"].cast("string"), x["entry"].cast("string"), F.when(r["xml"].rlike(r"<\s*(?:\w+:)?(?:rss|feed|RDF)\b"), "empty")))))


def parse_feed(responses: DataFrame, keys: list[str], **columns: str) -> DataFrame:
    """RSS and Atom feeds: a document for each item of the channel or entry of the feed. An entry's
    address is its first link that isn't for something else (rel other than alternate)."""
    return FEED.documents(responses, keys, **columns)


_INCIDENTS = "struct<Incidents:array<struct<TypeDescription:string,Address:string,DateOccurred:string,CaseNumber:string,Description:string>>>"


def _incident_fields(i: Column, r: Cols) -> Cols:
    e = lambda n: F.coalesce(i[n], F.lit(""))
    text = squash(F.concat(e("TypeDescription"), F.lit(" at "), e("Address"), F.lit(" on "), e("DateOccurred"), F.lit(". "), e("Description")))
    url = F.concat(F.lit("https://www.crimemapping.com/map/agency/"), r["map_id"].cast("string"))
    return {"url": url, "document_type": F.lit("incident_log"), "title": F.nullif(i["TypeDescription"], F.lit("")), "raw_text": text, "published_date": T.map_date(i["DateOccurred"]), "metadata": _meta(crimemapping_id=r["map_id"], case_number=i["CaseNumber"])}


INCIDENT_MAP = Source(
    ("payload", "map_id"),
    lambda r: F.when(r["map_id"].isNotNull(), F.from_json(r["payload"], _INCIDENTS)["Incidents"]),
    _incident_fields,
    lambda r: F.when(r["map_id"].isNull(), F.lit("no external id")).otherwise(_unreadable("payload", lambda r: F.from_json(r["payload"], _INCIDENTS)["Incidents"])(r)),
)


def parse_incident_map(responses: DataFrame, keys: list[str], **columns: str) -> DataFrame:
    """Incidents of a map service's JSON; a response without the agency's id there has none."""
    return INCIDENT_MAP.documents(responses, keys, **columns)


def _row_fields(date_field: str | None) -> Callable[[Column, Cols], Cols]:
    def fields(row: Column, r: Cols) -> Cols:
        u, kind = r["url"], M.resolve(row, K.TYPE_FIELDS)
        meta = _meta(domain=F.try_parse_url(u, F.lit("HOST")), dataset_id=U.dataset_id(u), offset=r["offset"], report_number=M.resolve(row, K.REPORT_FIELDS), location=M.resolve(row, K.LOCATION_FIELDS))
        return {"url": u, "document_type": D.open_data_type(kind, u), "title": kind, "raw_text": M.dump(row), "published_date": T.open_data_date(M.resolve(row, K.DATE_FIELDS, date_field)), "metadata": meta}

    return fields


def open_data(date_field: str | None = None) -> Source:
    """Pages of an open-data set; ``date_field``: the column that has the date, if it is known."""
    rows = lambda r: F.from_json(r["payload"], f"array<{M.MAP}>")
    return Source(("url", "payload", "offset"), rows, _row_fields(date_field), _unreadable("payload", lambda r: F.when(F.ltrim(r["payload"]).startswith("["), rows(r))))


def parse_open_data(responses: DataFrame, keys: list[str], date_field: str | None = None, **columns: str) -> DataFrame:
    """Rows of an open-data page: a JSON array of objects with unknown columns."""
    return open_data(date_field).documents(responses, keys, **columns)


def open_data_documents(rows: DataFrame, keys: list[str], date_field: str | None = None) -> DataFrame:
    """Documents of rows (url, offset, pos, row) that the open-data source has read."""
    made = _row_fields(date_field)(F.col("row"), {"url": F.col("url"), "offset": F.col("offset")})
    return rows.select(*keys, "pos", *(c.alias(n) for n, c in made.items()))


_LAYER = f"struct<features:array<struct<attributes:{M.MAP},geometry:string>>,error:string>"


def _feature_fields(f: Column, r: Cols) -> Cols:
    row, u = F.coalesce(f["attributes"], F.create_map().cast(M.MAP)), r["url"]
    kind = M.resolve_any_case(row, K.FEATURE_TYPE_FIELDS)
    dates = F.coalesce(*(T.epoch_ms(M.resolve_any_case(row, (c,))) for c in K.DATE_FIELDS))
    meta = _meta(query_url=u, offset=r["offset"], report_number=M.resolve_any_case(row, K.FEATURE_REPORT_FIELDS), location=M.resolve_any_case(row, K.LOCATION_FIELDS), geometry=f["geometry"])
    return {"url": u, "document_type": D.open_data_type(kind, u), "title": kind, "raw_text": M.dump_features(row), "published_date": dates, "metadata": meta}


FEATURES = Source(
    ("url", "payload", "offset"),
    lambda r: let(F.from_json(r["payload"], _LAYER), lambda p: F.when(p["error"].isNull(), p["features"])),
    _feature_fields,
    lambda r: F.coalesce(F.concat(F.lit("the layer says "), F.from_json(r["payload"], _LAYER)["error"]), _unreadable("payload", lambda r: F.from_json(r["payload"], _LAYER)["features"])(r)),
)


def parse_features(responses: DataFrame, keys: list[str], **columns: str) -> DataFrame:
    """Features of a map layer's JSON; a payload with an error has none."""
    return FEATURES.documents(responses, keys, **columns)


def clean_page(text: Column) -> Column:
    """A PDF page without hyphenation, bare page numbers and page footers."""
    t = F.regexp_replace(F.regexp_replace(text, r"(?U)(\w)-\n(\w)", "$1$2"), r"(?dmU)^\s*\d+\s*$", "")
    return squash(F.regexp_replace(t, r"(?dmU)^\s*[Pp]age\s+\d+\s+of\s+\d+\s*$", ""))


def ocr_summary(confidences: Column) -> Column:
    """Mean confidence (one place) of recognised pages and whether it is low; null without any."""
    known = F.filter(confidences, lambda c: c.isNotNull() & (c != -1))
    mean = F.aggregate(known, F.lit(0.0), lambda a, c: a + c) / F.size(known)
    return F.when(F.size(known) > 0, F.struct(F.bround(mean, 1).alias("avg_ocr_confidence"), F.when(mean < 60, "low").otherwise("ok").alias("ocr_confidence")))


def _pdf_items(pages: Column, conf: Column) -> Column:
    """The documents' texts, whether they are single pages, and their pages' number and confidences."""
    cleaned = F.zip_with(F.transform(pages, clean_page), conf, lambda t, c: F.struct(t.alias("t"), c.alias("c")))

    def split(ps: Column) -> Column:
        dated = F.forall(ps, lambda p: T.pdf_header(p["t"]).isNotNull())
        item = lambda t, cs: F.struct(t.alias("t"), cs.alias("cs"), dated.alias("split"), F.size(ps).alias("n"))
        whole = F.array(item(squash(F.array_join(F.transform(ps, lambda p: p["t"]), "\n\n")), F.transform(ps, lambda p: p["c"])))
        return F.when(F.size(ps) > 0, F.when(dated, F.transform(ps, lambda p: item(p["t"], F.array(p["c"])))).otherwise(whole))

    return let(F.filter(cleaned, lambda p: p["t"] != ""), lambda ps: F.transform(split(ps), lambda d, at: F.struct(d.alias("d"), at.alias("at"))))


def _pdf_fields(i: Column, r: Cols) -> Cols:
    d = i["d"]
    header = F.when(d["split"], T.pdf_header(d["t"]))
    o = ocr_summary(d["cs"])
    meta = _meta(pdf_url=r["url"], page_count=F.when(d["split"], 1).otherwise(d["n"]), section_index=F.when(d["split"], i["at"]), avg_ocr_confidence=o["avg_ocr_confidence"], ocr_confidence=o["ocr_confidence"])
    return {"url": r["url"], "document_type": D.pdf_type(r["url"]), "title": header, "raw_text": d["t"], "published_date": T.pdf_date(header), "metadata": F.map_filter(meta, lambda _, v: v.isNotNull())}


def _no_confidences(pages: Column) -> Column:
    return F.transform(pages, lambda _: F.lit(None).cast("double"))


_PAGES = "array<string>"
#: A file's page texts as a JSON array.
PDF = Source(("url", "payload"), lambda r: let(F.from_json(r["payload"], _PAGES), lambda pages: _pdf_items(pages, _no_confidences(pages))), _pdf_fields, _unreadable("payload", lambda r: F.from_json(r["payload"], _PAGES)))


def assemble_pdf(files: DataFrame, keys: list[str], url: str = "url", pages: str = "pages", ocr: str | None = None) -> DataFrame:
    """Documents of page-wise texts: one a page if every page that isn't blank starts with a date
    header, else one in all. Confidences keep their pages' numbers."""
    given = Source(("url", "pages", "ocr"), lambda r: _pdf_items(r["pages"], r["ocr"]), _pdf_fields, _no_response("pages"))
    rows = files.withColumn("__conf", F.col(ocr) if ocr else _no_confidences(F.col(pages)))
    return given.documents(rows, keys, url=url, pages=pages, ocr="__conf")
