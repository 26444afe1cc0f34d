"""Address functions."""

from __future__ import annotations

from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(url: Column) -> Column:
    """Struct of scheme, netloc (with the port) and path; nulls for what is no address."""
    get = lambda name: F.try_parse_url(url, F.lit(name))
    return F.struct(get("PROTOCOL").alias("scheme"), get("AUTHORITY").alias("netloc"), get("PATH").alias("path"))


def resolve(base: Column, link: Column) -> Column:
    """``link`` as seen from the page ``base``: absolute, scheme-relative, rooted, query, fragment
    or relative. Steps up (..) are taken out."""
    scheme, root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1), F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.when(page == root, F.concat(root, F.lit("/"))).otherwise(F.regexp_replace(page, "[^/]*$", ""))
    out = (
        F.when(link == "", base)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(page, link))
        .when(link.startswith("#"), F.concat(F.regexp_extract(base, "^([^#]*)", 1), link))
        .otherwise(F.concat(folder, link))
    )
    for _ in range(3):
        out = F.regexp_replace(out, r"(?<=[^/:])/(?!\.\.(?:/|$))[^/?#]+/\.\.(?:/|$)", "/")
    return F.regexp_replace(out, r"(?<=[^/:])/\./", "/")


def page_url(base: Column, page: Column, name: str = "Page") -> Column:
    mark = F.when(base.contains("?"), F.lit("&")).otherwise(F.lit("?"))
    return F.when(page == 1, base).otherwise(F.concat(base, mark, F.lit(f"{name}="), page.cast("string")))


def dataset_id(url: Column) -> Column:
    """The id in ``/resource/<id>.json``, else the path with underscores."""
    told = F.nullif(F.regexp_extract(url, r"/resource/([^/.]+)", 1), F.lit(""))
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "^/+|/+$", "")
    return F.coalesce(told, F.replace(path, F.lit("/"), F.lit("_")))


def alert_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/alert/(\w+)/?", 1), F.lit(""))


def byte_source(url: Column) -> Column:
    """Where a file's bytes are read from: ``http`` for such an address, else ``file``."""
    return F.when(url.rlike("^https?://"), F.lit("http")).otherwise(F.lit("file"))


def robots_allowed(url: Column, robots: Column, agent: str) -> Column:
    """Whether a site's robots file lets ``agent`` fetch an address; without a file it may."""

    @F.pandas_udf("boolean")
    def run(urls: pd.Series, files: pd.Series) -> pd.Series:
        rules: dict[str, RobotFileParser] = {}
        out = []
        for u, text in zip(urls, files, strict=True):
            if text is None:
                out.append(True)
                continue
            if text not in rules:
                rules[text] = RobotFileParser()
                rules[text].parse(text.splitlines())
            out.append(rules[text].can_fetch(agent, u or ""))
        return pd.Series(out, dtype=bool)

    return run(url, robots)
