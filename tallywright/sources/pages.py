"""Rows, links and histograms from landed HTML: SQL functions, and a parser where elements nest."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

FIRST_YEAR = 1990
ROWS = [{"gs_r", "gs_or"}, {"gsc_mpat_ttl"}]  # fixed values: classes of a result block


def histogram(html: Column, current_year: int) -> Column:
    """map year -> count of elements with data-year and data-count; years out of range and bad counts go, a
    missing count is 0, and of a repeated year the last one stays."""
    tags = F.regexp_extract_all(html, F.lit(r"<[^>]*data-year=[^>]*>"), F.lit(0))
    count = lambda t: F.when(t.rlike("data-count="), F.regexp_extract(t, r"data-count=\"?([^\"\s>]+)", 1)).otherwise("0").try_cast("bigint")
    one = lambda t: F.struct(F.regexp_extract(t, r"data-year=\"?([^\"\s>]+)", 1).try_cast("int").alias("key"), count(t).alias("value"))
    pairs = F.filter(F.transform(tags, one), lambda p: p["key"].between(FIRST_YEAR, current_year) & p["value"].isNotNull())
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(F.array_sort(last))


def usable_histogram(html: Column, current_year: int) -> Column:
    """The histogram, or null if it has no positive count."""
    h = histogram(html, current_year)
    return F.when(F.exists(F.map_values(h), lambda v: v > 0), h)


def link_years(html: Column, exact: bool) -> Column:
    """Years of links that restrict a list to one year (exact), or that have a lower year."""
    links = F.regexp_extract_all(html, F.lit(r"href=\"([^\"]*as_ylo=\d+[^\"]*)\""), F.lit(1))
    low = lambda u: F.regexp_extract(u, r"as_ylo=(\d+)", 1).try_cast("int")
    if exact:
        links = F.filter(links, lambda u: F.regexp_extract(u, r"as_yhi=(\d+)", 1).try_cast("int") == low(u))
    return F.array_sort(F.array_distinct(F.transform(links, low)))


def snippet_years(text: Column, current_year: int) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1)), lambda y: y.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda y: y.between(FIRST_YEAR, current_year))))


class _Blocks(HTMLParser):
    """The source of each outermost div that has one of the wanted sets of classes."""

    def __init__(self, wanted: list[set[str]]):
        super().__init__(convert_charrefs=True)
        self.wanted, self.depth, self.found, self.at = wanted, 0, [], None

    def handle_starttag(self, tag, attrs):
        if tag != "div":
            return
        classes = set((dict(attrs).get("class") or "").split())
        if self.at is None and any(w <= classes for w in self.wanted):
            self.at, self.depth = self.place() + len(self.get_starttag_text()), 0
        if self.at is not None:
            self.depth += 1

    def handle_endtag(self, tag):
        if tag == "div" and self.at is not None:
            self.depth -= 1
            if not self.depth:
                self.close_at(self.place())

    def place(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def close_at(self, end: int) -> None:
        self.found.append(self.text[self.at : end])
        self.at = None

    def blocks(self, text: str) -> list[str]:
        self.text = text
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.feed(text)
        self.close()
        if self.at is not None:
            self.close_at(len(text))
        return self.found


def result_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row for each result block of a page, with its place; blocks may hold divs of their own, and one that is not closed
    ends with the page. Blocks of both kinds come in the page's order."""
    others = [f for f in pages.schema.fields if f.name != html]

    def run(batches):
        for batch in batches:
            texts = [_Blocks(ROWS).blocks(t or "") for t in batch.column(len(others)).to_pylist()]
            at = pa.array([k for k, t in enumerate(texts) for _ in t], pa.int64())
            own = [batch.column(k).take(at) for k in range(len(others))]
            yield pa.RecordBatch.from_arrays([*own, pa.array([k for t in texts for k in range(len(t))], pa.int32()), pa.array([b for t in texts for b in t], pa.string())], names=[*(f.name for f in others), "pos", "block"])

    schema = StructType([*others, StructField("pos", IntegerType()), StructField("block", StringType())])
    return pages.select(*(f.name for f in others), html).mapInArrow(run, schema)


def title_link(block: Column, base: str) -> Column:
    href = F.regexp_extract(block, r"<a[^>]*href=\"([^\"]*)\"", 1)
    return F.when(F.startswith(href, F.lit("/")), F.concat(F.lit(base), href)).otherwise(F.nullif(href, F.lit("")))


def block_authors(block: Column) -> Column:
    """Text of the first gray div of an author page's row, or null."""
    gray = F.regexp_extract(block, r"(?s)<div[^>]*class=\"[^\"]*gs_gray[^\"]*\"[^>]*>(.*?)</div>", 1)
    return F.nullif(F.trim(F.regexp_replace(gray, "<[^>]*>", "")), F.lit(""))


def page_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"href=\"([^\"]*)\""), F.lit(1))
