"""Listing pages, one after another, as a table function.

``lateral listing_pages(url)`` gives the pages of a listing: the first one as it is, then with a page number,
up to the first page without items (left out), without a link to a next one (kept), that can't be fetched
(a row with its error), or to a greatest number. Listings are rows, so they are read by as many tasks as
there are; a listing's pages can only be read in turn, as each tells whether there is another.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import ship_package

from .html import has_next, parse
from .open_data import fetch
from .parsers import listing_items

MOST = 5


def page_address(url: str, page: int, parameter: str = "Page") -> str:
    return url if page == 1 else f"{url}{'&' if '?' in url else '?'}{parameter}={page}"


def pages_function(recorded: str | None = None, parameter: str = "Page", most: int = MOST, seconds: float = 30):
    """The table function; ``recorded``: a folder of kept responses instead of the service."""

    class Pages:
        def eval(self, url: str) -> Iterator[tuple]:
            for page in range(1, most + 1) if url else ():
                address = page_address(url, page, parameter)
                try:
                    html = fetch(address, address, recorded, seconds)
                except OSError as e:
                    yield page, address, None, f"{type(e).__name__}: {e}"
                    return
                if not listing_items(html):
                    return
                yield page, address, html, None
                if not has_next(parse(html)):
                    return

    return F.udtf(Pages, returnType="page int, page_url string, html string, error string")


def read_listings(listings: DataFrame, url: str = "url", **options) -> DataFrame:
    """``listings`` with page, page_url, html and error of each page of the listing at ``url``."""
    ship_package(listings.sparkSession)
    return listings.lateralJoin(pages_function(**options)(F.col(url).outer()))


def register_function(spark: SparkSession, name: str = "listing_pages", **options) -> None:
    ship_package(spark)
    spark.udtf.register(name, pages_function(**options))
