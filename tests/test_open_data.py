"""The open-data source over HTTP and recorded pages, and parsers of all platforms in one pass."""

from __future__ import annotations

import json
import threading
import urllib.parse
from datetime import datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from millrace.sources import open_data, parsers, plugins

ROWS = [{"id": i, "when": None if i % 50 == 7 else f"2024-{1 + i % 12:02d}-{1 + i % 28:02d}T0{i % 3}:00:00.000", "x": {"a": [1.5, None, True]}, "note": f"ü{i}"} for i in range(950)]


class Service(BaseHTTPRequestHandler):
    """Answers requests of both kinds as the services do; ``asked`` keeps the requests."""

    asked: list[dict] = []
    broken: set[int] = set()
    heedless = False

    def do_GET(self):
        query = dict(urllib.parse.parse_qsl(urllib.parse.urlparse(self.path).query))
        type(self).asked.append(query)
        layer = "resultOffset" in query
        offset, size = (int(query[k]) for k in (("resultOffset", "resultRecordCount") if layer else ("$offset", "$limit")))
        own = ROWS
        for part in (query.get("$where") or query.get("where") or "1=1").replace(" AND ", " and ").split(" and "):
            if part != "1=1" and not self.heedless:
                _, sign, at = part.split(" ", 2)
                at = at.removeprefix("DATE ").removeprefix("TIMESTAMP ").strip("'").replace(" ", "T").removesuffix(".000000")
                at += "T00:00:00" if "T" not in at else ""
                own = [r for r in own if r["when"] and open_data.KEEP[sign](r["when"][:19], at)]
        page = own[offset : offset + size]
        if offset in self.broken:
            body = "no json" if offset % 2 else json.dumps({"message": "no", "error": {"code": 400}})
        elif layer:
            stamp = lambda w: None if w is None else int((datetime.fromisoformat(w) - datetime(1970, 1, 1)).total_seconds() * 1000)
            body = json.dumps({"features": [{"attributes": {"ID": r["id"], "WHEN": stamp(r["when"])}} for r in page], "exceededTransferLimit": offset + size < len(own)})
        else:
            body = json.dumps(page)
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body.encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def service(monkeypatch):
    monkeypatch.setattr(Service, "asked", [])
    monkeypatch.setattr(Service, "broken", set())
    monkeypatch.setattr(Service, "heedless", False)
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/resource/ab12-cd34.json"
    server.shutdown()


def _read(spark, url, platform="socrata", **options):
    open_data.register(spark)
    field = "when" if platform == "socrata" else "WHEN"
    return spark.read.format("open_data").options(platform=platform, date_field=field, page_size=100, **options).load(url)


def _ids(rows, name="id"):
    return sorted(int(r["row"][name]) for r in rows.collect())


def test_all_pages_are_read_once_each(spark, service):
    rows = _read(spark, service)
    assert rows.rdd.getNumPartitions() == 10
    got = rows.collect()
    assert sorted(int(r.row["id"]) for r in got) == list(range(950))
    assert {(r.offset, r.pos) for r in got} == {(i // 100 * 100, i % 100) for i in range(950)}
    one = next(r for r in got if r.row["id"] == "5")
    assert one.row == {"id": "5", "when": "2024-06-06T02:00:00.000", "x": '{"a":[1.5,null,true]}', "note": "ü5"} and str(one.at) == "2024-06-06 02:00:00"
    assert next(r for r in got if r.row["id"] == "7").at is None


@pytest.mark.parametrize("platform, name", [("socrata", "id"), ("arcgis", "ID")])
def test_filters_become_requests(spark, service, platform, name):
    rows = _read(spark, service, platform)
    kept = rows.filter("at > timestamp_ntz '2024-10-05 00:00:00' and at <= timestamp_ntz '2024-12-20 01:00:00' and pos >= 0")
    want = [r["id"] for r in ROWS if r["when"] and "2024-10-05T00:00:00" < r["when"][:19] <= "2024-12-20T01:00:00"]
    Service.asked.clear()
    assert _ids(kept, name) == want
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "at#" not in plan.split("Filter", 1)[1].split("\n")[0] if "Filter" in plan else True
    told = {q.get("$where") or q.get("where") for q in Service.asked}
    assert told == ({"when <= '2024-12-20T01:00:00' and when > '2024-10-05T00:00:00'"} if platform == "socrata" else {"WHEN <= TIMESTAMP '2024-12-20 01:00:00.000000' AND WHEN > DATE '2024-10-05'"})
    # Pages of what fits, not of everything.
    assert max(int(q.get("$offset") or q.get("resultOffset") or 0) for q in Service.asked) <= len(want) // 100 * 100 + 200


def test_a_heedless_service_changes_nothing(spark, service, monkeypatch):
    monkeypatch.setattr(Service, "heedless", True)
    kept = _read(spark, service).filter("at >= timestamp_ntz '2024-11-01 00:00:00'")
    assert _ids(kept) == [r["id"] for r in ROWS if r["when"] and r["when"] >= "2024-11"]


@pytest.mark.parametrize("platform, name", [("socrata", "id"), ("arcgis", "ID")])
def test_a_broken_page_ends_the_set(spark, service, platform, name):
    Service.broken = {300, 400, 500, 600, 700, 800, 900}
    assert _ids(_read(spark, service, platform), name) == list(range(300))
    Service.broken = set(range(0, 2000, 100))
    assert _ids(_read(spark, service, platform), name) == []


def test_no_service_no_rows(spark):
    assert _read(spark, "http://127.0.0.1:9/none.json", timeout=2).count() == 0
    for bad in ({"platform": "other"}, {}):
        open_data.register(spark)
        with pytest.raises(Exception, match="platform must be|address"):
            spark.read.format("open_data").options(**bad).load(*(["u"] if bad else [])).count()


def test_recorded_pages(spark, tmp_path):
    asked = [(open_data.request("socrata", o, 100), json.dumps(ROWS[o : o + 100])) for o in (0, 100, 200)]
    asked[2] = (asked[2][0], json.dumps(ROWS[200:230], indent=1))
    open_data.record(spark.createDataFrame(asked, "query string, body string"), f"file://{tmp_path}/kept")
    assert _ids(_read(spark, "https://d.org/resource/x.json", recorded=f"file://{tmp_path}/kept")) == list(range(230))


def test_documents_of_pages(spark, service):
    docs = parsers.open_data_documents(_read(spark, service), ["offset"], "when")
    one = docs.filter("raw_text like 'id: 5;%'").first()
    assert (one.url, str(one.published_date), one.metadata["dataset_id"], one.metadata["report_number"]) == (service, "2024-06-06 02:00:00", "ab12-cd34", "5")


# Parsers by name.

RSS = "<rss><channel><title>Arrests</title><item><title>t</title><link>https://x.org/r</link><description>d</description></item></channel></rss>"
GOOD = [
    ("rss", RSS, ["d"]),
    ("civicplus", "<article><h2>H</h2><p>x</p></article><article><h2>I</h2></article>", ["H. x", "I."]),
    ("citizenrims", '<table class="table"><tbody><tr><td>01/02/2024</td><td>Theft</td><td>1 Oak St</td></tr></tbody></table>', ["Theft at 1 Oak St"]),
    ("nixle", '<div class="alert-item"><h2>T</h2><div class="alert-body">B</div></div>', ["T. B"]),
    ("rave", '<div class="alertItem"><h4>T</h4><div class="alertContent">B</div></div>', ["T. B"]),
    ("crimemapping", '{"Incidents":[{"TypeDescription":"a","Address":"b","Description":"c"}]}', ["a at b on . c"]),
    ("socrata", '[{"id":1,"x":"y"},{"id":2}]', ["id: 1; x: y", "id: 2"]),
    ("arcgis", '{"features":[{"attributes":{"A":1}}]}', ["A: 1"]),
    ("pdf", '["hello","  ","there"]', ["hello there"]),
]
BAD = [
    ("rss", "no xml", "response can't be read"), ("rss", None, "no response"), ("civicplus", None, "no response"), ("citizenrims", None, "no response"), ("nixle", None, "no response"), ("rave", None, "no response"),
    ("crimemapping", "x", "response can't be read"), ("socrata", '{"error":true}', "response can't be read"), ("socrata", "[", "response can't be read"), ("arcgis", '{"error":{"code":400}}', 'the layer says {"code":400}'),
    ("arcgis", '{"x":1}', "response can't be read"), ("pdf", "nope", "response can't be read"), ("other", "x", "no parser for other"), (None, "x", "no parser for null"),
]
NOTHING = [("rss", "<rss><channel></channel></rss>"), ("civicplus", "<p>none</p>"), ("citizenrims", ""), ("socrata", "[]"), ("arcgis", '{"features":[]}'), ("pdf", '[""]'), ("crimemapping", '{"Incidents":[]}')]


def _responses(spark, rows):
    return spark.createDataFrame([(i, f"https://x.org/{i}", p, t, 7, 0) for i, (p, t) in enumerate(rows)], "k int, url string, platform string, payload string, map_id int, offset int")


def test_the_nine_platforms_in_one_pass(spark):
    rows = [(p.upper() if i % 2 else p, t) for i, (p, t, _) in enumerate(GOOD)] + [b[:2] for b in BAD] + NOTHING
    assert plugins.names() == sorted(p for p, _, _ in GOOD)
    got = plugins.parse_results(_responses(spark, rows), F.col("platform"), ["k"])
    found = {(r.k, r.pos): (r.raw_text, r.error) for r in got.collect()}
    want = {(i, j): (t, None) for i, (_, _, texts) in enumerate(GOOD) for j, t in enumerate(texts)}
    want |= {(len(GOOD) + i, None): (None, e) for i, (_, _, e) in enumerate(BAD)}
    assert found == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1  # one pass over the responses
    assert {r.k for r in plugins.parse_all(_responses(spark, rows), F.col("platform"), ["k"]).collect()} == set(range(len(GOOD)))


def test_an_incident_map_needs_its_id(spark):
    rows = _responses(spark, [("crimemapping", GOOD[5][1])]).withColumn("map_id", F.lit(None).cast("int"))
    assert [r.error for r in plugins.parse_results(rows, F.col("platform"), ["k"]).collect()] == ["no external id"]
    assert plugins.get_parser("crimemapping").documents(rows, ["k"]).count() == 0


@pytest.fixture
def words():
    def parse(url, payload, most=9):
        if payload == "stop":
            return iter(["not a document"])
        return ({"url": url, "raw_text": w, "metadata": {"n": str(i)}} for i, w in enumerate(payload.split()[:most]))

    plugins.register("Words", lambda **s: plugins.RowParser(parse, **s))
    yield parse
    plugins.unregister("words")


def test_failures_of_a_users_parser_are_rows(spark, words):
    rows = _responses(spark, [("WORDS", "a b c"), ("words", None), ("words", ""), ("words", "stop"), ("rss", RSS)])
    got = [(r.k, r.pos, r.raw_text, r.error and r.error.split(":")[0]) for r in plugins.parse_results(rows, F.col("platform"), ["k"], {"words": {"most": 2}}).orderBy("k", "pos").collect()]
    assert got == [(0, 0, "a", None), (0, 1, "b", None), (1, None, None, "AttributeError"), (3, None, None, "AttributeError"), (4, 0, "d", None)]
    alone = plugins.get_parser("words").documents(rows.filter("k in (0, 1)"), ["k", "platform"])
    assert [(r.k, r.pos, r.raw_text) for r in alone.orderBy("pos").collect()] == [(0, 0, "a"), (0, 1, "b"), (0, 2, "c")] and alone.columns[:3] == ["k", "platform", "pos"]


def test_names_are_the_same_in_any_case(words):
    for name in ("words", "WORDS", "RSS", "Rss"):
        with pytest.raises(ValueError, match="there is a parser"):
            plugins.register(name, plugins.ColumnParser)
    with pytest.raises(plugins.ParserNotRegistered):
        plugins.get_parser("none")
    assert plugins.get_parser("WORDS")


def test_settings_of_unknown_platforms_are_refused(spark):
    with pytest.raises(plugins.ParserNotRegistered, match="wrods"):
        plugins.parse_results(_responses(spark, NOTHING), F.col("platform"), ["k"], {"wrods": {}})


def test_a_parser_with_a_pass_of_its_own(spark):
    class Lines(plugins.Parser):
        def documents(self, responses, keys):
            made = responses.select(*keys, F.posexplode(F.split("payload", ",")).alias("pos", "raw_text"))
            return made.withColumns({f: F.lit(None).cast("string") for f in ("url", "document_type", "title")} | {"published_date": F.lit(None).cast("timestamp_ntz"), "metadata": F.lit(None).cast("map<string,string>")})

    plugins.register("lines", Lines)
    try:
        got = plugins.parse_results(_responses(spark, [("lines", "a,b"), ("rss", RSS), ("x", "y")]), F.col("platform"), ["k"]).collect()
        assert {(r.k, r.pos, r.raw_text, r.error) for r in got} == {(0, 0, "a", None), (0, 1, "b", None), (1, 0, "d", None), (2, None, None, "no parser for x")}
    finally:
        plugins.unregister("lines")


def test_python_parsers_as_a_table_function_of_sql(spark, words):
    plugins.register_function(spark, "parse_response")
    _responses(spark, [("words", "a b"), ("words", None), ("rss", RSS)]).createOrReplaceTempView("responses")
    got = spark.sql("select k, doc.raw_text as t, error from responses, lateral parse_response(platform, url, payload) order by k, t").collect()
    assert [(r.k, r.t, r.error and r.error.split(":")[0]) for r in got] == [(0, "a", None), (0, "b", None), (1, None, "AttributeError"), (2, None, None)]
    with pytest.raises(Exception, match="payload must be text"):
        spark.sql("select * from parse_response('words', 'u', 5)")
    with pytest.raises(Exception, match="no parser for"):
        spark.sql("select * from parse_response('wrods', 'u', 'x')")


def test_listings_are_read_page_by_page(spark, tmp_path):
    from millrace.sources import listings

    item, following = "<article><h2>{}</h2></article>", '<a rel="next" href="x">Next</a>'
    kept = {
        "https://a.org/n": item.format(1) + following, "https://a.org/n?Page=2": item.format(2) + following, "https://a.org/n?Page=3": item.format(3),
        "https://b.org/n?x=1": item.format(4) + following, "https://b.org/n?x=1&Page=2": "<p>nothing</p>" + following,
        **{listings.page_address("https://c.org", i): item.format(i) + following for i in range(1, 9)},
    }
    open_data.record(spark.createDataFrame(list(kept.items()), "query string, body string"), f"file://{tmp_path}/kept")
    rows = spark.createDataFrame([(1, "https://a.org/n"), (2, "https://b.org/n?x=1"), (3, "https://c.org"), (4, "https://none.org"), (5, None)], "k int, url string")
    got = listings.read_listings(rows, recorded=f"file://{tmp_path}/kept")
    assert sorted((r.k, r.page) for r in got.collect()) == [(1, 1), (1, 2), (1, 3), (2, 1), (3, 1), (3, 2), (3, 3), (3, 4), (3, 5)]
    assert all(r.html.rstrip("\n") == kept[r.page_url] for r in got.collect())
    titles = parsers.parse_listing(got.filter("k = 1"), ["k", "page"], url="page_url").orderBy("page").collect()
    assert [r.title for r in titles] == ["1", "2", "3"]
    bad = listings.read_listings(spark.createDataFrame([(1, "http://127.0.0.1:9/x")], "k int, url string"), seconds=2).collect()
    assert [(r.page, r.html) for r in bad] == [(1, None)] and "Error" in bad[0].error
    listings.register_function(spark, recorded=f"file://{tmp_path}/kept", most=2)
    assert spark.sql("select page from listing_pages('https://c.org')").count() == 2
