"""Pure Column -> Column functions. Nulls come back as null unless a docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE = 10  # rows of a result page
THRESHOLD = 50  # reported total from which the year strategy is used

#: White space as Unicode has it; Java's \s knows ASCII only.
SPACES = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u001c-\u001f]+"


def int_or_null(v: Column) -> Column:
    return v.try_cast("bigint")


def int_or_zero(v: Column) -> Column:
    return F.coalesce(v.try_cast("bigint"), F.lit(0).cast("bigint"))


def blank_to_null(v: Column) -> Column:
    return F.nullif(F.trim(v), F.lit(""))


def or_na(v: Column) -> Column:
    """Null and empty become N/A."""
    return F.coalesce(F.nullif(v, F.lit("")), F.lit("N/A"))


def citation_year(v: Column) -> Column:
    """A row's usable year, or null for sentinels and anything that is no integer."""
    return v.try_cast("int")


def publication_year(v: Column, current_year: int) -> Column:
    """As citation_year, and null for years to come."""
    y = v.try_cast("int")
    return F.when(y <= current_year, y)


def year_with_fallback(v: Column, fallback: Column) -> Column:
    """The year, or the query's year where it is missing or a sentinel."""
    missing = v.isNull() | F.lower(F.trim(v)).isin("", "n/a", "na", "?")
    return F.when(missing & fallback.isNotNull(), fallback.cast("string")).otherwise(v)


def normal_text(v: Column) -> Column:
    """Lower case, single spaces, trimmed; null becomes empty."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(v), SPACES, " ")), F.lit(""))


def joined_ids(ids: Column) -> Column:
    """An array of ids as trimmed non-empty parts with commas, or null."""
    return F.nullif(F.array_join(F.filter(F.transform(ids, lambda x: F.trim(x)), lambda x: x != ""), ","), F.lit(""))


def ids_in_url(url: Column) -> Column:
    """The id list of a cites= parameter."""
    return joined_ids(F.split(F.regexp_extract(url, r"cites=([\d,]*)", 1), ","))


def cluster_in_url(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"info:([^:]+):scholar\.google\.com", 1), F.lit(""))


def author_in_url(url: Column) -> Column:
    """The user= parameter of a url, or the text itself if it looks like an id."""
    return F.when(url.rlike(r"[?&]user=[^&]+"), F.regexp_extract(url, r"[?&]user=([^&]+)", 1)).when(url.rlike(r"^[\w-]+$"), url)


def native_id(cites_id: Column, citedby_url: Column, bib_url: Column) -> Column:
    """First of the row's own id, the id list of its cited-by url and the cluster of its bibliography url."""
    return F.coalesce(blank_to_null(cites_id), ids_in_url(citedby_url), cluster_in_url(bib_url))


def identity_keys(cites_id: Column, title: Column, venue: Column, authors: Column) -> Column:
    """Ordered distinct keys under which a row is known: its id, then title with venue, or with authors without venue."""
    by_id = F.when(blank_to_null(cites_id).isNotNull(), F.concat(F.lit("id:"), F.trim(cites_id)))
    t, v, a = normal_text(title), normal_text(venue), normal_text(authors)
    other = F.when(v != "", v).when(a != "", a).otherwise(F.lit(""))
    by_meta = F.when(t != "", F.concat(F.lit("meta:"), t, F.lit("|"), other))
    return F.array_distinct(F.array_compact(F.array(by_id, by_meta)))


def page_start(index: Column) -> Column:
    """Start of the page that holds a row; 0 for null and negative ones."""
    i = F.coalesce(index.try_cast("bigint"), F.lit(0))
    return F.greatest(F.lit(0).cast("bigint"), i - F.pmod(i, F.lit(PAGE)))


def with_start(url: Column, start: Column, name: str = "start") -> Column:
    """url with its paging parameter set or replaced."""
    replaced = F.regexp_replace(url, F.lit(rf"([?&]){name}=\d+"), F.concat(F.lit(f"$1{name}="), start.cast("string")))
    appended = F.concat(url, F.when(F.contains(url, F.lit("?")), "&").otherwise("?"), F.lit(f"{name}="), start.cast("string"))
    return F.when(url.rlike(rf"[?&]{name}=\d+"), replaced).otherwise(appended)


def page_number(url: Column, name: str = "start") -> Column:
    return F.floor(F.coalesce(F.regexp_extract(url, rf"[?&]{name}=(\d+)", 1).try_cast("bigint"), F.lit(0)) / PAGE) + 1


def absolute(url: Column, base: str) -> Column:
    return F.when(F.startswith(url, F.lit("/")), F.concat(F.lit(base), url)).otherwise(url)


def without_host(url: Column) -> Column:
    return F.regexp_replace(url, r"^[a-z]+://[^/]+", "")


def fetch_policy(total: Column, year: Column, threshold: int = THRESHOLD) -> Column:
    """struct(strategy, pub_year, reason): small totals are read whole, others year by year."""
    small = F.coalesce(total, F.lit(0)) < threshold
    return F.struct(
        F.when(small, "direct").otherwise("year").alias("strategy"),
        year.alias("pub_year"),
        F.when(small, "below_year_threshold").otherwise("at_or_above_year_threshold").alias("reason"),
    )


def resume_state(next_index: Column, total: Column, url: Column) -> Column:
    """struct(next_index, source_total, url) if it can be resumed from, else null."""
    i, t = next_index.try_cast("bigint"), total.try_cast("bigint")
    ok = (i >= 0) & (i <= t) & (F.coalesce(url, F.lit("")) != "")
    return F.when(ok, F.struct(i.alias("next_index"), t.alias("source_total"), url.alias("url")))


def year_diagnostic(year: Column, histogram: Column, cached: Column, dedup: Column) -> Column:
    """struct of a year's counts with seen = cached + dedup, each at least 0; null without year or histogram."""
    c, d = F.greatest(F.lit(0), F.coalesce(cached, F.lit(0))), F.greatest(F.lit(0), F.coalesce(dedup, F.lit(0)))
    made = F.struct(year.alias("year"), histogram.alias("histogram_count"), c.alias("cached_total"), (c + d).alias("seen_total"), d.alias("dedup_count"))
    return F.when(year.isNotNull() & histogram.isNotNull(), made)


def seen_or_sum(seen: Column, cached: Column, dedup: Column) -> Column:
    """Recorded seen total, where 0 counts as missing, else cached + dedup."""
    return F.coalesce(F.nullif(int_or_null(seen), F.lit(0).cast("bigint")), int_or_zero(cached) + int_or_zero(dedup))


def rederived_dedup(seen: Column, cached: Column, dedup: Column) -> Column:
    """seen - cached where seen is at least cached, else the recorded count."""
    return F.when(seen >= cached, seen - cached).otherwise(F.greatest(F.lit(0), F.coalesce(dedup, F.lit(0))))


def display_time(iso: Column) -> Column:
    return F.substring(F.replace(iso, F.lit("T"), F.lit(" ")), 1, 19)


def first_titles(titles: Column, k: int = 3) -> Column:
    """First k of the sorted titles and how many more there are."""
    top = F.array_join(F.slice(F.array_sort(titles), 1, k), "; ")
    return F.when(F.size(titles) > k, F.concat(top, F.lit(" ... (+"), (F.size(titles) - k).cast("string"), F.lit(")"))).otherwise(top)


def counts_text(counts: Column) -> Column:
    """A map year -> count as `y:n,...`, by year."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(counts)), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",")


def normal_counts(counts: Column) -> Column:
    """A map of texts as int -> long, without bad and negative entries."""
    pairs = F.transform(F.map_entries(counts), lambda e: F.struct(e["key"].try_cast("int").alias("key"), e["value"].try_cast("bigint").alias("value")))
    return F.map_from_entries(F.array_sort(F.filter(pairs, lambda e: e["key"].isNotNull() & (e["value"] >= 0))))


def years_text(years: Column) -> Column:
    """Sorted years; of more than eight the first four and the last three."""
    s = F.transform(F.array_sort(years), lambda y: y.cast("string"))
    short = F.concat(F.array_join(F.slice(s, 1, 4), ", "), F.lit(" ... "), F.array_join(F.slice(s, -3, 3), ", "))
    return F.when(F.size(s) <= 8, F.array_join(s, ", ")).otherwise(short)


def termination(rows_on_last_page: Column) -> Column:
    """short_page_stop if the last page is neither empty nor full."""
    return F.when((rows_on_last_page > 0) & (rows_on_last_page < PAGE), "short_page_stop").otherwise("iterator_exhausted")


def label(title: Column, n: int = 50) -> Column:
    """The beginning of a title, for display."""
    return F.substring(title, 1, n)


def page_skip(index: Column) -> Column:
    """Rows of the first page that a scan from a row leaves out."""
    return F.greatest(F.lit(0).cast("bigint"), F.coalesce(index.try_cast("bigint"), F.lit(0))) - page_start(index)


def diagnostic_line(d: Column) -> Column:
    """A year diagnostic as text."""
    return F.concat(*(x for k, name in (("year", ""), ("histogram_count", ": histogram="), ("seen_total", ",seen="), ("cached_total", ",cached="), ("dedup_count", ",dedup=")) for x in (F.lit(name), d[k].cast("string"))))


def citation_row(raw: Column, fallback_year: Column) -> Column:
    """A citing row's six fields from a raw record (bib, pub_url, eprint_url, cites_id, citedby_url, url_scholarbib)."""
    bib = raw["bib"]
    return F.struct(
        F.coalesce(bib["title"], F.lit("N/A")).alias("title"),
        F.coalesce(F.array_join(bib["author"], ", "), F.lit("")).alias("authors"),
        F.coalesce(bib["venue"], F.lit("N/A")).alias("venue"),
        year_with_fallback(F.coalesce(bib["pub_year"], F.lit("N/A")), fallback_year).alias("year"),
        F.coalesce(raw["pub_url"], raw["eprint_url"], F.lit("N/A")).alias("url"),
        native_id(raw["cites_id"], raw["citedby_url"], raw["url_scholarbib"]).alias("cites_id"),
    )
