"""URLs, HTML and database addresses."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .batches import bounded
from .text import basename


def netloc(c: Column) -> Column:
    """Host with port and user, or null."""
    return F.try_parse_url(c, F.lit("AUTHORITY"))


def url_valid(c: Column) -> Column:
    """Whether there are a scheme and a host."""
    return F.coalesce(F.try_parse_url(c, F.lit("PROTOCOL")).isNotNull() & (netloc(c) != ""), F.lit(False))


def download_name(c: Column, stamp: Column) -> Column:
    """The last part of the URL's path if it has a dot, else a name with the stamp (seconds)."""
    name = basename(F.try_parse_url(c, F.lit("PATH")))
    return F.when(name.contains("."), name).otherwise(F.concat(F.lit("download_"), stamp.cast("string"), F.lit(".dat")))


def db_name(c: Column) -> Column:
    """The name of the database that an address leads to; generic names give primary_db."""
    last = F.element_at(F.split(c, "/"), -1)
    of_file = F.split(last, r"\.")[0]
    of_url = F.regexp_replace(last, r"[?#].*$", "")
    generic = ["", "db", "database", "main"]
    sqlite = F.when(of_file.isin(*generic) | of_file.rlike("^[0-9]+$"), F.lit("primary_db")).otherwise(of_file)
    other = F.when(of_url.isin(*generic), F.lit("primary_db")).otherwise(of_url)
    return F.when(c.startswith("sqlite:///"), sqlite).otherwise(other)


class _Text(HTMLParser):
    BLOCKS = frozenset("p br div li ul ol tr td th table h1 h2 h3 h4 h5 h6 section article header footer nav pre".split())
    HIDDEN = frozenset(("script", "style", "head", "template", "noscript"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden: list[str] = []

    def handle_starttag(self, tag, attrs) -> None:
        if tag in self.HIDDEN:
            self.hidden.append(tag)
        elif tag in self.BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag) -> None:
        if tag in self.hidden:
            while self.hidden.pop() != tag:
                pass
        elif tag in self.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data) -> None:
        if not self.hidden:
            self.out.append(data)


def html_text(html: str | None) -> str | None:
    """Visible text, a line for each block; null stays null."""
    if html is None:
        return None
    parser = _Text()
    parser.feed(html)
    parser.close()
    lines = (re.sub(r"\s+", " ", line).strip() for line in "".join(parser.out).split("\n"))
    return "\n".join(line for line in lines if line)


def _html_series(html: pd.Series) -> pd.Series:
    return html.map(html_text)


def html_to_text(c: Column, spark: SparkSession | None = None) -> Column:
    """Visible text by the standard library's parser, in Arrow batches of Python with bounded rows and bytes. spark: the session of the column's table, where it may not be
    the active one."""
    bounded(spark)
    return F.pandas_udf(_html_series, "string")(c)
