"""Detectors: ordered cascades over names, addresses and markup; the first rule that fits wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.operators.matching import longest_prefix

from . import constants as K


def first_match(rules: list[tuple[Column, str]], default: str | None) -> Column:
    out = F.lit(default)
    for condition, value in reversed(rules):
        out = F.when(condition, F.lit(value)).otherwise(out)
    return out


def contains_any(text: Column, *parts: str) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def slugify(name: Column) -> Column:
    kept = F.regexp_replace(F.regexp_replace(F.lower(name), "[’']", ""), r"[^a-z0-9\s-]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(kept, r"^\s+|\s+$", ""), r"\s+", "-"), "-+", "-")


def agency_type(name: Column) -> Column:
    return first_match(
        [
            (name.contains("Sheriff"), "sheriff"),
            (name.contains("District Attorney") | name.rlike(r"\bDA\b"), "district_attorney"),
            (name.contains("Coroner"), "coroner"),
            (contains_any(name, "University", "College", "Campus", "School District"), "campus"),
            (contains_any(name, "Transit", "BART", "Amtrak"), "transit"),
            (contains_any(name, "Highway Patrol", "CHP") | name.startswith("State "), "state"),
        ],
        "municipal_pd",
    )


def county_in_name(name: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_extract(name, r"^([A-Za-z\s]+?)\s+County", 1), r"^\s+|\s+$", ""), F.lit(""))


def region_of(county: Column) -> Column:
    return first_match([(county.isin(*names), region) for region, names in K.COUNTY_REGIONS.items()], None)


def infer_county(name: Column) -> Column:
    """The county before the word County if it is known, else the longest known prefix."""
    known = [c for names in K.COUNTY_REGIONS.values() for c in names]
    told = county_in_name(name)
    return F.when(told.isin(*known), told).otherwise(longest_prefix(name, known))


def platform_of_row(url: Column, notes: Column) -> Column:
    text = F.lower(F.concat(F.coalesce(url, F.lit("")), F.lit(" "), F.coalesce(notes, F.lit(""))))
    tokens = (("citizenrims", "citizenrims"), ("crimegraphics", "crimegraphics"), ("crimemapping.com", "crimemapping"), ("arcgis", "arcgis"), ("nixle", "nixle"))
    return first_match([*((text.contains(t), p) for t, p in tokens), (text.rlike(r"data\.[^/]*\.(gov|org)"), "socrata")], "unknown")


def feed_type(data_types: Column) -> Column:
    text = F.lower(data_types)
    tokens = (("arrest", "arrest_log"), ("incident", "incident_reports"), ("crime map", "crimemapping_embed"), ("activity", "daily_activity_log"), ("press", "press_releases"), ("alert", "community_alerts"))
    return first_match([(text.contains(t), v) for t, v in tokens], "rss_feed")


def feed_format(url: Column) -> Column:
    text = F.lower(url)
    return first_match([(text.contains(".pdf"), "pdf"), (contains_any(text, "rss", "feed"), "rss"), (contains_any(text, "arcgis", "data."), "json_api")], "html")


def platform_of_page(url: Column, html: Column, label: Column) -> Column:
    """Struct of platform and evidence (``label:url=token`` or ``label:html=token``), or null."""

    def hit(platform: str, evidence: str) -> Column:
        return F.struct(F.lit(platform).alias("platform"), F.concat(label, F.lit(":" + evidence)).alias("evidence"))

    rules = [(url.rlike(r"(?i)data\.[^/]+\.(gov|org)"), hit("socrata", "url=data.*.gov/org"))]
    for platform, in_url, in_html in K.PAGE_RULES:
        rules += [(url.contains(t), hit(platform, f"url={t}")) for t in in_url]
        rules += [(html.contains(t), hit(platform, f"html={t}")) for t in in_html]
    out = F.lit(None)
    for condition, value in reversed(rules):
        out = F.when(condition, value).otherwise(out)
    return out


def listing_type(url: Column) -> Column:
    u = F.lower(url)
    return first_match([(contains_any(u, "blotter", "arrest"), "arrest_log"), (contains_any(u, "press", "release"), "press_release")], "activity_feed")


def feed_title_type(title: Column) -> Column:
    t = F.lower(title)
    return first_match([(t.contains("press"), "press_release"), (t.contains("arrest"), "arrest_log")], "activity_feed")


def pdf_type(url: Column) -> Column:
    u = F.lower(url)
    return first_match([(contains_any(u, "arrest", "blotter"), "arrest_log"), (contains_any(u, "press", "release"), "press_release"), (contains_any(u, "activity", "log"), "daily_activity_log")], "pdf_library")


def open_data_type(value: Column, url: Column) -> Column:
    t, u = F.lower(F.coalesce(value, F.lit(""))), F.lower(url)
    return first_match(
        [
            (contains_any(t, "arrest", "booking"), "arrest_log"),
            (contains_any(t, "incident", "crime", "offense"), "incident_reports"),
            (contains_any(u, "arrest", "booking"), "arrest_log"),
            (contains_any(u, "incident", "crime"), "incident_reports"),
        ],
        "open_data_api",
    )
