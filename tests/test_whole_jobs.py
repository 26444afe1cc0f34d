"""Queries do the whole of their job: no part of a text and no row is left out."""

from __future__ import annotations

import datetime as dt
import re

import pytest

from millrace.functions import constants as K
from millrace.plans import registered
from millrace.plans.text import _rows

from .conftest import SF

#: What the cleaning rules meet, behind a longer beginning than any prefix that was once taken.
LONG = "plain words " * 40 + "\nbro-\nken\n Page 3 of 12 \n\n\n\n two  \t words \x07\xad\n" + "more words " * 40


def _documents(spark, path, n=4):
    rows = [(i, LONG + str(i) if i else None, "en", "s", len(LONG)) for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    return rows


def test_cleaning_reads_whole_texts(spark, tmp_path):
    rows = _documents(spark, tmp_path)
    brute = {
        "clean_pdf_hyphen": lambda t: re.sub(r"(\w)-\n(\w)", r"\1\2", t),
        "clean_page_markers": lambda t: re.sub(r"(?m)^\s*[Pp]age\s+\d+\s+of\s+\d+\s*$", "", t),
        "clean_nonprintable": lambda t: t.replace("\x07", "").replace("\xad", ""),
        "clean_whitespace_lines": lambda t: re.sub(r"\n{3,}", "\n\n", "\n".join(x.strip() for x in re.sub(r"[ \t]+", " ", t).split("\n"))).strip(),
        "squash_whitespace": lambda t: re.sub(r"\s+", " ", t).strip(),
    }
    for name, rule in brute.items():
        got = {r.doc_id: r.t for r in registered.queries()[name](spark, str(tmp_path)).collect()}
        assert got[0] is None
        for i, text, *_ in rows[1:]:
            assert got[i].startswith(rule(text)), name


def test_dates_of_every_event(spark, tmp_path):
    spark.range(2990, 3050).withColumnRenamed("id", "event_id").write.parquet(str(tmp_path / "events.parquet"))
    day = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(days=i % 360)
    at = lambda i: day(i) + dt.timedelta(hours=i % 24, minutes=i % 60)
    epoch = lambda i: dt.datetime(1970, 1, 1) + dt.timedelta(days=i)
    brute = {
        "parse_dates_prefixed": lambda i: None if i % 6 == 5 else day(i),
        "parse_dates_multi": lambda i: None if i % 5 == 4 else at(i) if i % 5 in (1, 2) else day(i),
        "parse_dates_iso19": at,
        "parse_pdf_header_date": lambda i: None if i % 4 == 3 else day(i),
        "parse_epoch_ms": lambda i: epoch(i) if i % 5 in (0, 1) else dt.datetime(2024, 1, 15, 8, 30) if i % 5 == 2 else None,
    }
    for name, rule in brute.items():
        got = {r.event_id: str(r.at) for r in registered.queries()[name](spark, str(tmp_path)).selectExpr("event_id", "cast(at as string) as at").collect()}
        assert got == {i: str(rule(i)) for i in range(2990, 3050)}, name


def test_links_of_every_part_and_lines_of_every_customer(spark, tmp_path):
    spark.range(298, 303).withColumnRenamed("id", "p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    spark.range(198, 203).selectExpr("id as c_custkey", "'C' || id as c_name").write.parquet(str(tmp_path / "customer.parquet"))
    run = lambda name: {tuple(r) for r in registered.queries()[name](spark, str(tmp_path)).collect()}
    links = {(p, i, f"https://t{p}.org/{path}") for p in range(298, 303) for i, path in enumerate(("news", "Police-Blotter", f"dir/crime/{p}"))}
    assert run("candidate_links") == links
    assert run("first_working_url") == {(p, url) for p, i, url in links if (p + i) % 3 == 1}
    assert run("scan_csv_pipe") == {(c, f"C{c} PD", "no" if c % 2 else "yes") for c in range(198, 203)}


def test_scores_and_protected_lines_of_whole_texts(spark, tmp_path):
    tail = "\n12 Café Nuñez St. is near\nShare this page | Print | Email\ncase 24-7, 1/2/2024\nnothing"
    rows = [(i, LONG + tail + str(i), "en", "s", 0) for i in range(14)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: {r.doc_id: r for r in registered.queries()[name](spark, str(tmp_path)).collect()}
    assert set(run("quality_score")) == set(run("clean_protected_lines")) == set(range(14))
    cleaned = run("clean_boilerplate")
    assert all(LONG.split("\n")[0] in r.cleaned and "case 24-7, 1/2/2024" in r.cleaned for r in cleaned.values())
    assert "Share this page" not in cleaned[0].cleaned and "Share this page" in cleaned[2].cleaned
    texts = {r.doc_id: r.t for r in _rows(spark, str(tmp_path)).collect()}
    lines, scores = run("clean_protected_text"), run("quality_score_text")
    for i, t in texts.items():
        assert lines[i].lines == sum(any(re.search(p, x, re.I if ci else 0) for p, ci in K.PROTECTED) for x in t.split("\n"))
        b = " ".join(t.split())
        bonus = sum(n for p, n in ((K.SCORE_DATE, 10), (K.SCORE_ID, 10), (K.SCORE_ADDRESS, 5)) if re.search(p, b, re.I))
        assert scores[i].score == min(100, max(0, 100 - int((len(t) - len(b)) / len(t) * 80)) + bonus)


def naive_clean(text, platform):
    """Cleaned text and score in plain Python, all sentences compared with each other."""
    from difflib import SequenceMatcher
    from html import unescape
    from unicodedata import category

    from millrace.sources.html import parse

    if not text or not text.strip():
        return "", 0
    out = []

    def visit(node):
        for c in node.children:
            if isinstance(c, str):
                out.append(c)
            elif c.tag == "br":
                out.append("\n")
            elif c.tag not in ("script", "style", "template"):
                gap = "\n\n" if c.tag in ("p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6") else ""
                out.append(gap)
                visit(c)
                out.append(gap)

    visit(parse(text))
    t = "".join(out)
    rules = K.BOILERPLATE.get({"rave": "nixle"}.get(platform, platform or "default"), K.BOILERPLATE["default"])
    if platform == "pdf":
        t = re.sub(r"(\w)-\n(\w)", r"\1\2", t)
    lines = []
    for line in t.split("\n"):
        if not any(re.search(p, line, re.I if i else 0) for p, i in K.PROTECTED):
            for p, i in rules:
                flags = re.S | (re.I if i else 0)
                line = re.sub(p + ".*$", "", line, flags=flags) if p.startswith("^") else re.sub(p, " ", line, flags=flags)
        lines.append(line)
    kept = []
    for part in re.split(r"(?<=[.!?])\s+(?=[A-Z])|\n{2,}", "\n".join(lines)):
        part = part.strip()
        if part and all(SequenceMatcher(None, part.lower(), k.lower()).ratio() < 0.85 for k in kept):
            kept.append(part)
    t = re.sub(r"(?m)^\s*[Pp]age\s+\d+\s+of\s+\d+\s*$", "", unescape("\n\n".join(kept)))
    t = "".join(c for c in t if c in "\n\t" or not category(c).startswith("C"))
    t = re.sub(r"\n{3,}", "\n\n", "\n".join(re.sub(r"[ \t]+", " ", x).strip() for x in t.split("\n"))).strip()
    score = max(0, 100 - int((len(text) - len(t)) / len(text) * 80)) + sum(n for p, n in ((K.SCORE_DATE, 10), (K.SCORE_ID, 10), (K.SCORE_ADDRESS, 5)) if re.search(p, t, re.I))
    score = min(100, score)
    return t, min(score, 30) if len(t.strip()) < 50 else score


def test_whole_pages_are_cleaned(spark):
    """clean_pages on every page of the smallest tables against the naive cleaner."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: (r.cleaned_text, r.quality_score) for r in registered.queries()["clean_pages"](spark, SF).collect()}
    platforms = ("civicplus", "nixle", "pdf", None)
    assert got == {p.page_id: naive_clean(p.html, platforms[p.page_id % 4]) for p in pages} and len(got) == 50


def test_sentences_are_compared_as_by_all_pairs():
    import random
    from difflib import SequenceMatcher

    from millrace.functions.clean import distinct_sentences

    rng = random.Random(1)
    for _ in range(30):
        words = ["Alpha", "beta", "gamma", "ünï", "delta", "x" * 40]
        parts = [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(6)]
        parts += ["".join(c if rng.random() < 0.9 else "q" for c in rng.choice(parts)) for _ in range(12)] + ["ab" * 150, "ab" * 150, parts[0]]
        kept = []
        for p in parts:
            if all(SequenceMatcher(None, p.lower(), k.lower()).ratio() < 0.85 for k in kept):
                kept.append(p)
        assert distinct_sentences("\n\n".join(parts)) == "\n\n".join(kept)


def test_text_of_deep_pages():
    from millrace.sources.html import plain_text

    assert plain_text("<div>" * 50_000 + "deep" + "</div>" * 50_000).strip() == "deep"
    assert plain_text("a<br>b<p>c<script>x</script></p><p>d<div/>e") == "a\nb\n\nc\n\n\n\nd\n\n\n\ne\n\n"


def test_whole_pages_are_unescaped(spark):
    from html import unescape

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    df = registered.queries()["clean_unescape_pages"](spark, SF)
    assert {r.page_id: r.text for r in df.collect()} == {i: h and unescape(h) for i, h in pages.items()}
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_character_references_of_all_kinds(spark):
    import random
    from html import unescape
    from html.entities import html5

    from pyspark.sql import functions as F

    from millrace.functions import clean

    r, names = random.Random(1), list(html5)
    number = lambda: r.choice([0, 1, 9, 13, 38, 127, 128, 129, 150, 159, 160, 233, 0x1F600, 0xD800, 0xFDD0, 0xFFFE, 0x1FFFF, 0x110000, 10**14, 65279, r.randint(0, 70000)])
    made = (
        lambda: "&" + r.choice(names) + r.choice(["", "x", "; ", "="]),
        lambda: f"&#{'0' * r.randint(0, 9)}{number()}" + r.choice([";", "", " "]),
        lambda: f"&#{r.choice('xX')}{number():x}" + r.choice([";", "", "g"]),
        lambda: r.choice(["&", "&&", "&#", "&#x;", "&;", "&amp", "&ampx", "&notit;", "&notin;", "&lt&gt", "&" + "a" * 40, "& amp;", "&😀;", "&a😀"]),
        lambda: r.choice(["abc", " ", "<b>", "é", "😀", "\n", ";"]),
    )
    texts = ["".join(r.choice(made)() for _ in range(r.randint(0, 8))) for _ in range(1500)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {x.i: x.u for x in df.select("i", clean.unescape(F.col("t")).alias("u")).collect()}
    assert {i: t and unescape(t) for i, t in enumerate(texts)} == got


@pytest.mark.parametrize("few", [0, 10, 64])
def test_near_sentences_are_those_of_the_plain_loop(spark, monkeypatch, few):
    import random
    from difflib import SequenceMatcher

    from millrace.functions import clean
    from millrace.functions.clean import distinct_sentences

    monkeypatch.setattr(clean, "FEW", few)

    r = random.Random(3)
    words = sorted({w for (t,) in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect() if t for w in t.split() if w.isalpha()})

    def vary(t):
        t = list(t)
        for _ in range(r.randint(0, len(t) // 4 + 1)):
            at = r.randrange(len(t) + 1)
            t[at : at + r.randint(0, 1)] = r.choice(["", "x", "a", " "])
        return "".join(t)

    for _ in range(40):
        base = [" ".join(r.choice(words) for _ in range(r.randint(1, 12))) for _ in range(6)]
        parts = [vary(r.choice(base)).strip() for _ in range(40)]
        kept = []
        for p in parts:
            if p and all(SequenceMatcher(None, p.lower(), k.lower()).ratio() < 0.85 for k in kept):
                kept.append(p)
        assert distinct_sentences("\n\n".join(parts)) == "\n\n".join(kept)


def test_few_ratios_are_computed_for_many_sentences(spark, monkeypatch):
    """Of thousands of sentences that differ, hardly any pair comes to the ratio."""
    import random

    from millrace.functions import clean

    r, ratios = random.Random(4), []
    words = sorted({w for (t,) in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect() if t for w in t.split() if w.isalpha()})
    text = "\n\n".join(" ".join(r.choice(words) for _ in range(r.randint(6, 18))) + "." for _ in range(1500))
    matcher = clean.SequenceMatcher
    monkeypatch.setattr(clean, "SequenceMatcher", lambda *a: ratios.append(a) or matcher(*a))
    assert len(clean.distinct_sentences(text).split("\n\n")) > 1400 and len(ratios) < 1500
