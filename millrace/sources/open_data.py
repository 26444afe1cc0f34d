"""Open-data sets and map layers as a Spark data source: a partition for each page.

``spark.read.format("open_data").option("platform", "socrata").option("date_field", "date_occ").load(url)``
gives the set's rows: url, offset, pos, at (the date field's time) and row (a map of text). A filter on
``at`` becomes part of the pages' requests, so the service leaves out what isn't wanted, and so many pages
fewer are asked for; it doesn't come back above the scan. Pages end with the first one that isn't full; the
driver finds it by requests at doubling distances, then executors read a page each. A page that is no page
(an error, no JSON) has no rows and counts as the last one.

Pages come from the service at ``url``, or, with the option ``recorded``, from responses that were kept in
a folder that all executors share (``record`` writes such a folder, a folder for each request).
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Iterator
from datetime import datetime, timedelta
from hashlib import sha256

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from millrace.session import ship_package

PAGE_SIZE = 1000
SCHEMA = "url string, offset long, pos int, at timestamp_ntz, row map<string,string>"
COMPARISONS = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
KEEP = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}


def request(platform: str, offset: int, size: int = PAGE_SIZE, date_field: str | None = None, bounds: tuple[tuple[str, datetime], ...] = ()) -> str:
    """The query of a page: its rows' offset and the bounds (a comparison and a time) of the date field."""
    if platform == "socrata":
        where = " and ".join(f"{date_field} {sign} '{at.isoformat(timespec='microseconds' if at.microsecond else 'seconds')}'" for sign, at in bounds)
        parts = {"$limit": size, "$offset": offset, "$order": ":id"} | ({"$where": where} if where else {})
    else:
        literal = lambda at: f"DATE '{at:%Y-%m-%d}'" if at == datetime(at.year, at.month, at.day) else f"TIMESTAMP '{at:%Y-%m-%d %H:%M:%S.%f}'"
        where = " AND ".join(f"{date_field} {sign} {literal(at)}" for sign, at in bounds) or "1=1"
        parts = {"where": where, "outFields": "*", "f": "json", "resultOffset": offset, "resultRecordCount": size}
    return urllib.parse.urlencode(parts, safe="$*'=<>: ")


def folder_of(query: str) -> str:
    """Where the response to a request is kept among recorded ones."""
    return f"request={sha256(query.encode()).hexdigest()}"


class _Number(str):
    """A number as it is written."""


def _text(value) -> str | None:
    """A value of a row as text: plain ones as they are written, lists and objects as JSON."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    return _json(value)


def _json(value) -> str:
    if isinstance(value, _Number):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_json(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_json, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def _time(platform: str, value: str | None) -> datetime | None:
    """A row's time: ISO text without its zone, or milliseconds since 1970; null if it is neither."""
    if not value:
        return None
    try:
        if platform == "socrata":
            return datetime.fromisoformat(value.strip()[:19]).replace(tzinfo=None)
        return datetime(1970, 1, 1) + timedelta(milliseconds=int(value))
    except (ValueError, OverflowError):
        return None


def rows_of(platform: str, body: str, size: int) -> tuple[list[dict[str, str | None]], bool]:
    """A page's rows, and whether more pages may follow."""
    try:
        page = json.loads(body, parse_int=_Number, parse_float=_Number)
    except ValueError:
        return [], False
    if platform == "socrata":
        rows = [r for r in page if isinstance(r, dict)] if isinstance(page, list) else []
        more = isinstance(page, list) and len(page) >= size
    else:
        usable = isinstance(page, dict) and "error" not in page
        found = page.get("features") or [] if usable else []
        rows = [f.get("attributes") or {} for f in found if isinstance(f, dict)]
        more = bool(usable and found and page.get("exceededTransferLimit"))
    return [{k: _text(v) for k, v in r.items()} for r in rows], more


def fetch(url: str, name: str, recorded: str | None, seconds: float) -> str:
    """The body of the response to ``url``, or what was recorded under ``name``, empty if nothing was."""
    if not recorded:
        with urllib.request.urlopen(url, timeout=seconds) as got:
            return got.read().decode("utf-8", "replace")
    system, top = fs.FileSystem.from_uri(recorded)
    files = system.get_file_info(fs.FileSelector(f"{top}/{folder_of(name)}", allow_not_found=True))
    parts = sorted(f.path for f in files if f.base_name.startswith("part-"))
    return b"".join(system.open_input_stream(p).read() for p in parts).decode()


class _Page(InputPartition):
    def __init__(self, offset: int):
        super().__init__(offset)
        self.offset = offset


class OpenDataReader(DataSourceReader):
    def __init__(self, options):
        self.url, self.platform, self.date_field = options["path"], options.get("platform", "socrata"), options.get("date_field")
        self.size, self.recorded = int(options.get("page_size", PAGE_SIZE)), options.get("recorded")
        self.seconds = float(options.get("timeout", 30))
        self.bounds: tuple[tuple[str, datetime], ...] = ()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes the comparisons of ``at``, and that it isn't null, which follows from them."""
        mine = [f for f in filters if type(f) in COMPARISONS and f.attribute == ("at",) and self.date_field]
        self.bounds = tuple(sorted({(COMPARISONS[type(f)], f.value) for f in mine}))
        for f in filters:
            if f not in mine and not (mine and isinstance(f, IsNotNull) and f.attribute == ("at",)):
                yield f

    def _page(self, offset: int) -> tuple[list[dict[str, str | None]], bool]:
        query = request(self.platform, offset, self.size, self.date_field, self.bounds)
        return rows_of(self.platform, self._response(query), self.size)

    def _response(self, query: str) -> str:
        """The body of a response; empty where there is none."""
        try:
            return fetch(f"{self.url}?{urllib.parse.quote(query, safe='=&%+$*')}", query, self.recorded, self.seconds)
        except OSError:
            return ""

    def partitions(self) -> list[InputPartition]:
        """The pages up to the first one that isn't full, found by requests at doubling distances and
        by halving what is between."""
        full, short = -1, 0
        while self._page(short * self.size)[1]:
            full, short = short, 2 * short + 1
        while short - full > 1:
            middle = (full + short) // 2
            full, short = (middle, short) if self._page(middle * self.size)[1] else (full, middle)
        return [_Page(k * self.size) for k in range(short + 1)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        for pos, row in enumerate(self._page(partition.offset)[0]):
            by_name = {k.lower(): v for k, v in row.items()}
            at = _time(self.platform, by_name.get((self.date_field or "").lower()))
            # A service that takes no notice of bounds must not change the result.
            if all(at is not None and KEEP[sign](at, than) for sign, than in self.bounds):
                yield self.url, partition.offset, pos, at, row


class OpenData(DataSource):
    @classmethod
    def name(cls) -> str:
        return "open_data"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> OpenDataReader:
        if "path" not in self.options:
            raise ValueError("load() needs the set's address")
        if self.options.get("platform", "socrata") not in ("socrata", "arcgis"):
            raise ValueError("platform must be socrata or arcgis")
        return OpenDataReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets filters reach it."""
    ship_package(spark)
    spark.dataSource.register(OpenData)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def record(pages: DataFrame, folder: str) -> None:
    """Keeps responses (columns query and body, a line each) below ``folder``, for the option ``recorded``."""
    named = pages.select(F.sha2(F.col("query").cast("binary"), 256).alias("request"), "body")
    named.repartition("request").sortWithinPartitions("request").write.partitionBy("request").mode("append").text(folder)
