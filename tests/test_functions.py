from __future__ import annotations

from datetime import datetime
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from millrace.functions import clean, dates, detect, maps, urls
from millrace.functions import constants as K
from millrace.operators import documents, ingest, matching, registry
from millrace.sources import discovery, html, parsers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_boilerplate_by_platform(spark):
    for platform, line, want in (
        ("civicplus", "Home > Residents here", ""), ("civicplus", "Sign up for alerts now", "  now"), ("civicplus", "Case No. 24-1 sign up for news", "Case No. 24-1 sign up for news"), ("nixle", "Sent via Nixle", " "), ("RAVE", "Sent via Rave", " "),
        ("pdf", "CONFIDENTIAL", ""), ("pdf", "Confidential", "Confidential"), ("crimemapping", "Status:", ""), ("unheard", "Back to top", ""), (None, "© 2024 Town", " "), ("civicplus", "Back to top", "Back to top"),
    ):
        assert one(spark, clean.remove_boilerplate(F.lit(line), F.lit(platform))) == want, (platform, line)


def test_cleaner_on_page(spark):
    page = "<html><style>x{}</style><p>Home</p><p>Officers met at 12 Oak St. on 1/2/2024 about case 24-001.</p><p>Officers met at 12 Oak St. on 1/2/2024 about case 24-001!</p><p>Tom &amp;amp; Ann&shy;</p><p>Page 1 of 2</p></html>"
    c = one(spark, clean.clean(F.lit(page), F.lit(None).cast("string")))
    assert c["cleaned_text"].count("Officers met") == 1 and "Home" not in c["cleaned_text"] and "Tom & Ann" in c["cleaned_text"] and "Page 1" not in c["cleaned_text"]
    assert 0 <= c["quality_score"] <= 100
    assert tuple(one(spark, clean.clean(F.lit("  \n"), F.lit("pdf")))) == ("", 0)


def test_sentence_dedup_matches_plain_loop():
    text = "The quick fox ran off. The quick fox ran off! The slow fox ran off. A. A.\n\nB b b\n\nB b c. The quick fox Ran off."

    def plain(t):
        kept = []
        import re

        for s in re.split(r"(?<=[.!?])\s+(?=[A-Z])|\n{2,}", t):
            s = s.strip()
            if s and all(SequenceMatcher(None, s.lower(), k.lower()).ratio() < 0.85 for k in kept):
                kept.append(s)
        return "\n\n".join(kept)

    assert clean.distinct_sentences(text) == plain(text)


def test_dates(spark):
    at = datetime(2024, 1, 5)
    assert one(spark, dates.listing_date(F.lit("Posted on January 5, 2024 | Updated"))) == at
    assert one(spark, dates.listing_date(F.lit("no date"))) is None
    assert one(spark, dates.table_date(F.lit(" 1/5/2024   08:30 "))) == datetime(2024, 1, 5, 8, 30)
    assert one(spark, dates.open_data_date(F.lit("2024-01-05T08:30:00-08:00"))) == datetime(2024, 1, 5, 8, 30)
    assert one(spark, dates.epoch_ms(F.lit("1704412800000"))) == at
    assert one(spark, dates.epoch_ms(F.lit("-5"))) is None
    assert one(spark, dates.epoch_ms(F.lit(""))) is None
    assert one(spark, dates.pdf_date(dates.pdf_header(F.lit("FRIDAY, JANUARY 5, 2024 log")))) == at
    assert one(spark, dates.feed_date(F.lit(None).cast("string"), F.lit("Fri, 05 Jan 2024 00:00:00 +0000"))) == at


def test_urls(spark):
    r = lambda b, x: one(spark, urls.resolve(F.lit(b), F.lit(x)))
    assert r("https://a.org/x/y?z", "../b") == "https://a.org/b"
    assert r("https://a.org", "b") == "https://a.org/b"
    assert r("https://a.org/x", "#f") == "https://a.org/x#f"
    assert one(spark, urls.page_url(F.lit("https://a.org?x=1"), F.lit(2))) == "https://a.org?x=1&Page=2"


def test_detectors(spark):
    assert one(spark, detect.infer_county(F.lit("San Francisco Police"))) == "San Francisco"
    assert one(spark, detect.infer_county(F.lit("Nowhere County"))) is None
    assert one(spark, detect.slugify(F.lit("O’Brien's  -- Town!"))) == "obriens-town"
    assert sum(len(v) for v in K.COUNTY_REGIONS.values()) == 51
    found = one(spark, detect.platform_of_page(F.lit("https://x.org"), F.lit("gravel"), F.lit("feed")))
    assert tuple(found) == ("rave", "feed:html=rave")


def test_row_maps(spark):
    row = maps.row_map(F.lit('{"b":"-1","A":{"human_address":"1 Oak"},":x":"y","c":null,"D":2}'))
    assert one(spark, maps.dump(row)) == "A: 1 Oak; D: 2; b: -1"
    assert one(spark, maps.resolve_any_case(row, ("b", "d"))) == "2"
    assert one(spark, maps.resolve(row, ("d", "D"))) == "2"


def test_html_selectors_and_next():
    root = html.parse('<div id="fa_newslist"><p class="fa_rowcmp">a</p></div><article>b</article><li class="next disabled"><a>Older</a></li>')
    assert [n.text() for n in html.first_selected(root, K.LISTING_SELECTORS)] == ["a"]
    assert not html.has_next(root)
    assert html.has_next(html.parse('<a rel="next" href="?p=2">x</a>'))
    assert html.parse("<p>a<p>b</li></div>").text("|") == "a|b"


def test_routes(spark):
    assert one(spark, parsers.route(F.lit("rave"), F.lit(None).cast("long"))) == "nixle"
    assert one(spark, parsers.route(F.lit("crimemapping"), F.lit(None).cast("long"))) is None
    with pytest.raises(Exception, match="no parser"):
        one(spark, parsers.route(F.lit("axon"), F.lit(1), strict=True))


def test_pdf_without_text_gives_nothing(spark):
    rows = spark.createDataFrame([(1, "u", ["  ", "12"])], "k int, url string, pages array<string>")
    assert parsers.assemble_pdf(rows, ["k"]).count() == 0


def test_ttl_skip_keeps_the_mark(spark):
    rows = spark.createDataFrame([("u", t, 10) for t in (0, 5, 9, 10, 12, 20)], "k string, at long, ttl long")
    assert [tuple(r) for r in ingest.suppress_by_ttl(rows, "k", "at", "ttl").collect()] == [("u", 3, 3)]


def test_slug_collision_is_told(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x-2")], "i int, n string")
    got = {r.i: (r.slug, r.collides) for r in registry.assign_slugs(rows, F.col("n"), "i").collect()}
    assert got == {1: ("x", False), 2: ("x-2", True), 3: ("x-2", True)}


def test_upsert_takes_nulls(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert sorted(map(tuple, registry.upsert(base, new, "k", ["v"]).collect()), key=str) == sorted([(1, "a", "x"), (2, None, "y"), (3, "c", None)], key=str)


def test_fuzzy_match_needs_enough_words(spark):
    t = spark.createDataFrame([(1, "Alpha Beta Gamma Police"), (2, "Alpha Sheriff"), (3, "Police")], "target_id long, name string")
    c = spark.createDataFrame([(10, "Alpha"), (11, "Beta Gamma Delta"), (12, "Gamma Beta")], "candidate_id long, name string")
    got = {r.target_id: r.candidate_id for r in matching.fuzzy_match(t, c).collect()}
    assert got == {1: 11, 2: 10}


def test_external_agencies(spark):
    rows = spark.createDataFrame([('[{"agencyId":1,"agencyName":"A"}]',), ('{"Agencies":[{"id":2,"name":"B"}]}',), ("nothing",)], "payload string")
    assert sorted(map(tuple, discovery.external_agencies(rows).collect())) == [("1", "A"), ("2", "B")]


def test_report_file_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, "a|b"), (2, datetime(2024, 1, 5), "c")], "i int, at timestamp, s string")
    discovery.write_report(rows, str(tmp_path / "r"))
    assert sorted(r["i"] for r in spark.read.csv(str(tmp_path / "r"), header=True).collect()) == ["1", "2"]
    lines = [r[0] for r in discovery.report_lines(rows).orderBy("value").collect()]
    assert lines[0].startswith("1||") and lines[1] == "2|2024-01-05T00:00:00|c"


def test_eligibility_is_null_safe(spark):
    empty = F.array().cast("array<string>")
    assert one(spark, documents.eligible(empty, F.lit(None).cast("array<string>"))) is False
    assert one(spark, documents.eligible(F.array(F.lit("x")), empty)) is True
