"""Parsers by name: the built-in ones, and those that a user registers.

A parser turns fetched responses into normalised documents. Built-in ones are sources of DataFrame
expressions. A user's may be a plain Python function of one response, which runs as a table function
that is joined laterally, or any object with ``documents``. Settings of a parser (a date field, days to
look back, a number of pages) are arguments of its factory.

Responses of all platforms are read in one pass, and those that can't be read come out as rows with
an error.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable, Iterator
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from millrace.session import ship_package
from millrace.tables import fresh

from . import parsers

FIELDS = ("url", "document_type", "title", "raw_text", "published_date", "metadata")
#: What a response's columns are called where responses of several platforms are read together.
INPUTS = {"html": "payload", "xml": "payload"}


class ParserNotRegistered(KeyError):
    """No parser has this name."""


class Parser(ABC):
    """A source's parser."""

    @abstractmethod
    def documents(self, responses: DataFrame, keys: list[str]) -> DataFrame:
        """keys, pos and the fields of a document, for each document of the responses."""


class ColumnParser(Parser):
    """A function of (responses, keys) on DataFrames, with settings of its own."""

    def __init__(self, run: Callable[..., DataFrame], **settings):
        self.run = partial(run, **settings)

    def documents(self, responses: DataFrame, keys: list[str]) -> DataFrame:
        return self.run(responses, keys)


class SourceParser(Parser):
    """A source of DataFrame expressions, whose response is in ``payload``."""

    def __init__(self, source: parsers.Source):
        self.source = source

    def documents(self, responses: DataFrame, keys: list[str]) -> DataFrame:
        return self.source.documents(responses, keys, **INPUTS)


class RowParser(Parser):
    """A Python function of (url, payload) that gives documents as dictionaries; what it leaves out
    is null. A response that makes it fail has no documents; ``parse_results`` tells why."""

    def __init__(self, run: Callable[..., Iterable[dict]], url: str = "url", payload: str = "payload", **settings):
        self.run, self.url, self.payload = partial(run, **settings), url, payload

    def documents(self, responses: DataFrame, keys: list[str]) -> DataFrame:
        ship_package(responses.sparkSession)
        called = table_function({"": self.run})(F.lit(""), F.col(self.url).outer(), F.col(self.payload).outer())
        return responses.lateralJoin(called).filter("error is null").select(*keys, F.col("doc.pos").alias("pos"), *(F.col(f"doc.{f}").alias(f) for f in FIELDS))


Factory = Callable[..., Parser]
_REGISTERED: dict[str, Factory] = {}


def register(name: str, factory: Factory, replace: bool = False) -> None:
    """Makes ``factory`` the parser of platform ``name``, in whatever case that is given."""
    if name.lower() in _REGISTERED and not replace:
        raise ValueError(f"there is a parser named {name!r}")
    _REGISTERED[name.lower()] = factory


def unregister(name: str) -> None:
    _REGISTERED.pop(name.lower(), None)


def names() -> list[str]:
    return sorted(_REGISTERED)


def get_parser(name: str, **settings) -> Parser:
    try:
        factory = _REGISTERED[name.lower()]
    except KeyError:
        raise ParserNotRegistered(f"no parser for {name!r}") from None
    return factory(**settings)


_KINDS = dict.fromkeys(FIELDS, T.StringType()) | {"published_date": T.TimestampNTZType(), "metadata": T.MapType(T.StringType(), T.StringType())}
_DOC = T.StructType([T.StructField("pos", T.IntegerType()), *(T.StructField(f, kind) for f, kind in _KINDS.items())])


def table_function(own: dict[str, Callable[[str, str], Iterable[dict]]]):
    """A table function of (platform, url, payload), with a row for each document that the platform's
    function finds (``doc``), or one with its ``error``. A null payload of a platform that isn't among
    ``own`` gives one row without either, so other columns' rows stay in a lateral join."""

    class Parse:
        @staticmethod
        def analyze(platform: AnalyzeArgument, url: AnalyzeArgument, payload: AnalyzeArgument) -> AnalyzeResult:
            for name, given in (("platform", platform), ("url", url), ("payload", payload)):
                if not isinstance(given.dataType, T.StringType | T.NullType):
                    raise ValueError(f"{name} must be text, not {given.dataType.simpleString()}")
            if platform.isConstantExpression and platform.value is not None and platform.value not in own:
                raise ValueError(f"no parser for {platform.value!r}")
            return AnalyzeResult(T.StructType([T.StructField("doc", _DOC), T.StructField("error", T.StringType())]))

        def eval(self, platform: str, url: str, payload: str) -> Iterator[tuple]:
            if platform not in own:
                yield None, None
                return
            try:
                found = [(i, *(d.get(f) for f in FIELDS)) for i, d in enumerate(own[platform](url, payload))]
            except Exception as e:  # noqa: BLE001  a response's failure is a row of the result
                yield None, f"{type(e).__name__}: {e}"
                return
            for doc in found:
                yield doc, None

    return F.udtf(Parse)


def register_function(spark: SparkSession, name: str = "parse_response") -> None:
    """Makes the registered Python parsers a table function of SQL: ``select ... from responses,
    lateral parse_response(platform, url, payload)``."""
    ship_package(spark)
    spark.udtf.register(name, table_function({n: p.run for n in names() if isinstance(p := get_parser(n), RowParser)}))


def _tagged(items: Column, at: int, n: int) -> Column:
    """Items as the field ``at`` of ``n`` fields, so that items of all kinds are of one type."""
    return F.transform(items, lambda x: F.struct(*((x if k == at else F.lit(None)).alias(f"k{k}") for k in range(n))))


def parse_results(responses: DataFrame, platform: Column, keys: list[str], settings: dict[str, dict] | None = None) -> DataFrame:
    """keys, pos, the fields of a document and ``error`` of responses (url, payload, map_id, offset) of
    several platforms, each read by its own parser, in one pass. A response that can't be read, or whose
    platform has no parser, has one row, with its error. Settings go by platform. Parsers that are
    neither sources nor Python functions of a response read the responses in a pass of their own."""
    if unknown := {n.lower() for n in settings or {}} - set(names()):
        raise ParserNotRegistered(f"no parser for {', '.join(sorted(unknown))}")
    found = {n: get_parser(n, **(settings or {}).get(n, {})) for n in names()}
    sources: dict[parsers.Source, list[str]] = {}
    for n, parser in found.items():
        if isinstance(parser, SourceParser):
            sources.setdefault(parser.source, []).append(n)
    rows = {n: parser.run for n, parser in found.items() if isinstance(parser, RowParser)}
    others = {n: parser for n, parser in found.items() if not isinstance(parser, SourceParser | RowParser)}

    p, doc, error, at, item = fresh(responses, "__platform", "__doc", "__error", "__at", "__item")
    name = F.col(p)
    own = responses.withColumn(p, F.lower(platform))
    if others:
        own = own.filter(~F.coalesce(name.isin(*others), F.lit(False)))
    if rows:
        ship_package(responses.sparkSession)
        mine = name.isin(*rows)
        called = table_function(rows)(*(F.when(mine, c).outer() for c in (name, F.col("url"), F.col("payload"))))
        own = own.lateralJoin(called.withColumnsRenamed({"doc": doc, "error": error}))
    else:
        own = own.withColumns({doc: F.lit(None).cast(_DOC), error: F.lit(None).cast("string")})

    whose = {s: name.isin(*own_names) for s, own_names in sources.items()}
    items, fault = F.when(F.col(doc).isNotNull(), _tagged(F.array(doc), 0, len(sources) + 1)), F.col(error)
    for k, s in enumerate(sources, 1):
        # A source sees its own platform's responses only, so a Python step of it has nothing to do on others.
        given = {c: F.when(whose[s], F.col(INPUTS.get(c, c))) for c in s.inputs}
        items = items.when(whose[s], _tagged(s.items(given), k, len(sources) + 1))
        fault = F.when(whose[s], s.fault(given)).otherwise(fault)
    known = F.coalesce(name.isin(*found), F.lit(False))
    fault = F.when(known, fault).otherwise(F.concat(F.lit("no parser for "), F.coalesce(name, F.lit("null"))))
    used = {c: f"__in_{c}" for c in sorted({INPUTS.get(c, c) for s in sources for c in s.inputs})}
    told = own.select(*keys, p, *(F.col(c).alias(n) for c, n in used.items()), fault.alias(error), F.posexplode_outer(items).alias(at, item))
    told = told.filter(F.col(item).isNotNull() | F.col(error).isNotNull())

    made = {f: F.when(F.col(f"{item}.k0").isNotNull(), F.col(f"{item}.k0.{f}")) for f in FIELDS}
    for k, s in enumerate(sources, 1):
        fields = s.fields(F.col(f"{item}.k{k}"), {c: F.col(used[INPUTS.get(c, c)]) for c in s.inputs})
        made = {f: made[f].when(whose[s] & F.col(item).isNotNull(), fields[f].cast(_KINDS[f])) for f in FIELDS}
    pos = F.coalesce(F.col(f"{item}.k0.pos"), F.col(at)).cast("int")
    out = told.select(*keys, pos.alias("pos"), *(c.alias(f) for f, c in made.items()), F.col(error).alias("error"))
    for n, parser in others.items():
        more = parser.documents(responses.filter(F.lower(platform) == n), keys)
        out = out.unionByName(more.select(*keys, F.col("pos").cast("int").alias("pos"), *FIELDS, F.lit(None).cast("string").alias("error")))
    return out


def parse_all(responses: DataFrame, platform: Column, keys: list[str], settings: dict[str, dict] | None = None) -> DataFrame:
    """The documents of ``parse_results``."""
    return parse_results(responses, platform, keys, settings).filter("error is null").drop("error")


def _built_in(source: parsers.Source) -> Factory:
    return lambda: SourceParser(source)


for _name, _factory in {
    "rss": _built_in(parsers.FEED),
    "civicplus": _built_in(parsers.LISTING),
    "citizenrims": _built_in(parsers.TABLE),
    "nixle": _built_in(parsers.ALERTS),
    "rave": _built_in(parsers.ALERTS),
    "crimemapping": _built_in(parsers.INCIDENT_MAP),
    "socrata": lambda date_field=None: SourceParser(parsers.open_data(date_field)),
    "arcgis": _built_in(parsers.FEATURES),
    "pdf": _built_in(parsers.PDF),
}.items():
    register(_name, _factory)
