"""Reports: nested documents, flat detail, pivots, and sheets as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions.columns import first_titles, or_na
from tallywright.operators.rollups import histogram_gap


def pivot_by_year(rows: DataFrame, entity: list[str], years: list[int]) -> DataFrame:
    """One column y<year> for each year, newest first; no rows give null."""
    out = rows.groupBy(*entity).pivot("year", sorted(years, reverse=True)).count()
    return out.select(*entity, *(F.nullif(F.col(f"`{y}`"), F.lit(0).cast("bigint")).alias(f"y{y}") for y in sorted(years, reverse=True)))


def flat_detail(rows: DataFrame, optional: list[str]) -> DataFrame:
    return rows.withColumns({c: or_na(F.col(c).cast("string")) for c in optional})


def key_values(row: DataFrame, names: list[str]) -> DataFrame:
    """A one-row frame as rows (key, value)."""
    return row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("key"), F.col(n).cast("string").alias("value")) for n in names))).alias("kv")).select("kv.*")


def history_sheet(history: DataFrame) -> DataFrame:
    return history.withColumn("new_titles", first_titles(F.col("new_papers"))).withColumn("n_new", F.size("new_papers")).withColumn("n_changed", F.size("changed_citations"))


def overview_years(basics: DataFrame) -> DataFrame:
    """The year table of each author, newest first; other columns than the map are kept."""
    return basics.select(*[c for c in basics.columns if c != "cites_per_year"], F.explode("cites_per_year").alias("year", "citations")).orderBy(F.col("year").desc())


def publications_sheet(pubs: DataFrame) -> DataFrame:
    return flat_detail(pubs, ["year", "venue", "authors", "url"]).orderBy("no")


def output_document(pubs: DataFrame, state: DataFrame, citations: DataFrame, entity: list[str]) -> DataFrame:
    """All publications with their citations by pos and state as a JSON document each, visited or not."""
    held = citations.groupBy(*entity, "title").agg(F.array_sort(F.collect_list(F.struct("pos", *[c for c in citations.columns if c not in (*entity, "title", "pos")]))).alias("citations"))
    out = pubs.join(state, [*entity, "title"], "left").join(held, [*entity, "title"], "left")
    empty: Column = F.col("citations").isNull()
    return out.select(*entity, "title", F.to_json(F.struct(*[c for c in out.columns if c not in entity])).alias("document"), F.when(empty, 0).otherwise(F.size("citations")).alias("n_citations"))


def profile_document(basics: DataFrame, pubs: DataFrame, entity: list[str]) -> DataFrame:
    """(entity..., document): a profile as JSON with its derived keys; basics: (entity..., citedby, cites_per_year),
    pubs: (entity..., no, title, num_citations). A document holds one entity's list by nature."""
    listed = pubs.groupBy(*entity).agg(F.array_sort(F.collect_list(F.struct("no", "title", "num_citations"))).alias("publications"))
    out = histogram_gap(basics).join(listed, entity, "left").withColumn("publications", F.coalesce("publications", F.array().cast("array<struct<no:bigint,title:string,num_citations:bigint>>")))
    summary = F.struct("year_table_total_citations", "year_table_gap", "year_table_matches_total").alias("citation_count_summary")
    info = F.struct("citedby", "cites_per_year").alias("author_info")
    return out.select(*entity, F.to_json(F.struct(info, "publications", F.size("publications").alias("total_publications"), F.col("citedby").alias("total_citations"), summary)).alias("document"))


def entry_state(state: Column, total: Column, rows: Column) -> Column:
    """A stored diagnostics struct with the totals of now: reported and cached, while what was seen stays as it was."""
    return state.withField("scholar_total", F.coalesce(total, state["scholar_total"])).withField("cached_total", F.when(total.isNotNull(), rows).otherwise(state["cached_total"]))
