"""Readers and writers of profile and output documents."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.functions.columns import int_or_null, int_or_zero, seen_or_sum

PUB = "no int, title string, year string, venue string, authors string, num_citations string, url string, citedby_url string"
CITATION = "title string, authors string, venue string, year string, url string, cites_id string"
SUMMARY = ("scholar_total", "histogram_total", "cached_total", "cached_year_total", "seen_total", "cached_unyeared_count", "dedup_count", "scholar_unyeared_count")
RECORD = ("histogram_count", "cached_total", "seen_total", "dedup_count")
PROFILE = (f"author_info struct<name string, scholar_id string, affiliation string, interests array<string>, citedby bigint, citedby_this_year bigint, citedby5y bigint, hindex bigint, hindex5y bigint, i10index bigint, i10index5y bigint, cites_per_year map<string,bigint>>, publications array<struct<{PUB.replace(' int', ': int').replace(' string', ': string')}>>, fetch_time string, change_history array<struct<fetch_time: string, citedby: bigint, hindex: bigint, total_publications: bigint, new_papers: array<string>, changed_citations: array<struct<title: string, old: bigint, new: bigint>>>>")
STATE = "struct<title: string, pub_url: string, citedby_url: string, fetch_strategy: string, num_citations_on_scholar: string, complete_fetch_attempt: boolean, complete: boolean, scholar_changed: boolean, year_fetch_diagnostics: map<string,string>, direct_fetch_diagnostics: map<string,string>, year_records: string, fetched_at: string>"
OUTPUT = (f"author_id string, fetch_time string, papers array<struct<pub: struct<{PUB.replace(' int', ': int').replace(' string', ': string')}>, citations: array<struct<{CITATION.replace(' string', ': string')}>>, _fetch_state: {STATE}>>")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents under a path; a missing path or a malformed document gives no row."""
    try:
        return spark.read.schema(schema + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path).where("_corrupt_record is null").drop("_corrupt_record")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def publications(profiles: DataFrame) -> DataFrame:
    out = profiles.select(F.col("author_info.scholar_id").alias("author_id"), F.inline("publications"))
    return out.withColumn("num_citations", int_or_zero(F.col("num_citations"))).na.fill("", ["title", "year", "venue", "authors", "url", "citedby_url"])


def with_legacy_history(profiles: DataFrame, legacy: DataFrame) -> DataFrame:
    """profiles (scholar_id, change_history, ...) with the side file's history where they have none."""
    side = legacy.select("scholar_id", F.col("change_history").alias("__legacy"))
    return profiles.join(side, "scholar_id", "left").withColumn("change_history", F.coalesce("change_history", "__legacy")).drop("__legacy")


def paper_states(outputs: DataFrame) -> DataFrame:
    """(author_id, title, state, citations) by title; untitled rows go and the last of a title stays."""
    rows = outputs.select("author_id", F.posexplode("papers").alias("at", "paper"))
    rows = rows.withColumn("title", F.coalesce(F.nullif(F.col("paper.pub.title"), F.lit("")), F.nullif(F.col("paper._fetch_state.title"), F.lit("")))).where("title is not null")
    kept = rows.groupBy("author_id", "title").agg(F.max_by("paper", "at").alias("paper"))
    return kept.select("author_id", "title", F.col("paper._fetch_state").alias("state"), F.col("paper.citations").alias("citations"))


def fetch_states(outputs: DataFrame) -> DataFrame:
    return paper_states(outputs).where("state.title is not null").select("author_id", "title", normal_state(F.col("state")).alias("state"))


def year_summary(diagnostics):
    """The eight totals from a map that is flat, has them nested under `summary`, or mixes them with objects by year."""
    nested = F.from_json(diagnostics["summary"], "map<string,string>")
    return F.struct(*(F.coalesce(int_or_null(diagnostics[k]), int_or_null(nested[k]), F.lit(None if k in ("scholar_total", "scholar_unyeared_count") else 0).cast("bigint")).alias(k) for k in SUMMARY))


def direct_summary(diagnostics):
    nested = F.from_json(diagnostics["summary"], "map<string,string>")
    get = lambda k: F.coalesce(diagnostics[k], nested[k])
    return F.struct(
        int_or_zero(get("scholar_total")).alias("scholar_total"),
        int_or_zero(get("cached_total")).alias("cached_total"),
        seen_or_sum(get("seen_total"), get("cached_total"), get("dedup_count")).alias("seen_total"),
        int_or_zero(get("dedup_count")).alias("dedup_count"),
        F.coalesce(get("termination_reason"), F.lit("")).alias("termination_reason"),
    )


def year_records(text):
    """Records of a JSON list, or of an object by year, sorted by year; records with a bad year go."""
    as_list = F.from_json(text, "array<map<string,string>>")
    by_year = F.transform(F.map_entries(F.from_json(text, "map<string,string>")), lambda e: F.map_concat(F.create_map(F.lit("year"), e["key"]), F.map_filter(F.from_json(e["value"], "map<string,string>"), lambda k, v: k != "year")))
    rows = F.when(F.ltrim(text).startswith("["), as_list).otherwise(by_year)
    one = lambda r: F.struct(r["year"].try_cast("int").alias("year"), *(int_or_zero(r[k]).alias(k) for k in RECORD), F.coalesce(r["termination_reason"], F.lit("")).alias("termination_reason"))
    return F.array_sort(F.filter(F.transform(rows, one), lambda r: r["year"].isNotNull()))


def normal_state(s):
    """The eleven fields of a fetch state from any of its layouts."""
    return F.struct(
        s["title"].alias("title"),
        s["pub_url"].alias("pub_url"),
        s["citedby_url"].alias("citedby_url"),
        s["fetch_strategy"].alias("fetch_strategy"),
        int_or_null(s["num_citations_on_scholar"]).alias("num_citations_on_scholar"),
        F.coalesce(s["complete_fetch_attempt"], s["complete"], F.lit(False)).alias("complete_fetch_attempt"),
        F.coalesce(s["scholar_changed"], F.lit(False)).alias("scholar_changed"),
        F.when(s["year_fetch_diagnostics"].isNotNull(), year_summary(s["year_fetch_diagnostics"])).alias("year_fetch_diagnostics"),
        F.when(s["direct_fetch_diagnostics"].isNotNull(), direct_summary(s["direct_fetch_diagnostics"])).alias("direct_fetch_diagnostics"),
        year_records(s["year_records"]).alias("year_records"),
        s["fetched_at"].alias("fetched_at"),
    )


def raw_publication(raw: DataFrame) -> DataFrame:
    """Publications of raw records (bib struct, pub_url, eprint_url, num_citations, citedby_url, pos)."""
    return raw.select(
        (F.col("pos") + 1).alias("no"),
        F.coalesce("bib.title", F.lit("")).alias("title"),
        F.coalesce("bib.pub_year", F.lit("")).alias("year"),
        F.coalesce("bib.citation", "bib.venue", "bib.journal", F.lit("")).alias("venue"),
        F.coalesce(F.array_join("bib.author", "; "), F.lit("")).alias("authors"),
        int_or_zero(F.col("num_citations")).alias("num_citations"),
        F.coalesce("pub_url", "eprint_url", F.lit("")).alias("url"),
        F.coalesce("citedby_url", F.lit("")).alias("citedby_url"),
    )


def write_documents(df: DataFrame, path: str) -> None:
    """JSON lines to a new path; rewriting what is being read goes through another path and a swap by the caller."""
    df.write.mode("overwrite").json(path)


def overwrite_years(df: DataFrame, path: str) -> None:
    """Replaces only the years that df has, a null year included."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)


def author_basics(basics: DataFrame, year: int) -> DataFrame:
    """Landed basics with defaults, and the count of the given year, 0 if the histogram lacks it."""
    count = F.coalesce(F.try_element_at("cites_per_year", F.lit(str(year))), F.lit(0).cast("bigint"))
    return basics.na.fill("N/A", ["name", "affiliation"]).na.fill(0, ["citedby"]).withColumn("citedby_this_year", count)


def state_of(states: DataFrame, titles: DataFrame) -> DataFrame:
    """The states of given titles; a title without one gives no row."""
    return states.join(titles.select("title").distinct(), "title", "left_semi")


def swap(df: DataFrame, path: str) -> None:
    """Rewrites documents under a path that df may read from: to a new folder first, then the old one steps aside, and comes
    back if the new one cannot take its place."""
    spark = df.sparkSession
    new, old = f"{path.rstrip('/')}.new", f"{path.rstrip('/')}.bak"
    df.write.mode("overwrite").json(new)
    at = lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(at(old), True)
    aside = fs.rename(at(path), at(old)) if fs.exists(at(path)) else False
    if not fs.rename(at(new), at(path)):
        if aside:
            fs.rename(at(old), at(path))
        raise OSError(f"cannot move {new} to {path}")
    fs.delete(at(old), True)
