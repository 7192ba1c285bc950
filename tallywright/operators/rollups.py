"""Histograms, totals and the summaries that are rebuilt from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.functions.columns import year_diagnostic


def year_counts(rows: DataFrame, entity: list[str], year: str = "year") -> DataFrame:
    """(entity..., year, n) of the rows with a usable year."""
    return rows.where(F.col(year).isNotNull()).groupBy(*entity, year).agg(F.count("*").alias("n"))


def year_count_map(rows: DataFrame, entity: list[str], year: str = "year") -> DataFrame:
    counted = year_counts(rows, entity, year)
    return counted.groupBy(*entity).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(year, "n")))).alias("counts"))


def count_summary(rows: DataFrame, entity: list[str], reported: DataFrame, histogram: DataFrame) -> DataFrame:
    """Totals of each reported entity: reported, of the histogram, cached with and without year, and what is unaccounted.

    rows: (entity..., year, is_dupe); reported: (entity..., scholar_total); histogram: (entity..., year, n).
    """
    kept, yeared = ~F.col("is_dupe"), F.col("year").isNotNull()
    own = rows.groupBy(*entity).agg(
        F.count_if(kept).alias("cached_total"),
        F.count_if(kept & yeared).alias("cached_year_total"),
        F.count_if(yeared).alias("seen_total"),
        F.count_if(kept & ~yeared).alias("cached_unyeared_count"),
        F.count_if(~kept).alias("dedup_count"),
    )
    hist = histogram.groupBy(*entity).agg(F.sum("n").alias("histogram_total"))
    zero = F.lit(0).cast("bigint")
    names = ["cached_total", "cached_year_total", "seen_total", "cached_unyeared_count", "dedup_count", "histogram_total"]
    out = reported.join(own, entity, "left").join(hist, entity, "left").withColumns({c: F.coalesce(c, zero) for c in names})
    return out.withColumn("scholar_unyeared_count", F.greatest(zero, F.col("scholar_total") - F.col("histogram_total")))


def reconcile_years(cached: DataFrame, histogram: DataFrame, entity: list[str]) -> DataFrame:
    """Full outer comparison of (entity..., year, cached, dedup) with (entity..., year, n) as one diagnostic per year."""
    both = cached.join(histogram, [*entity, "year"], "full")
    d = year_diagnostic(F.col("year"), F.coalesce("n", F.lit(0).cast("bigint")), F.col("cached"), F.col("dedup"))
    return both.withColumn("d", d).select(*entity, "d.*")


def summary_from_records(records: DataFrame, entity: list[str], totals: DataFrame) -> DataFrame:
    """Repair: an entity's summary from its year records; the reported total is kept, or taken from totals where 0."""
    sums = records.groupBy(*entity).agg(*(F.sum(a).alias(b) for a, b in (("histogram_count", "histogram_total"), ("cached_total", "cached_total"), ("seen_total", "seen_total"), ("dedup_count", "dedup_count"))))
    out = totals.join(sums, entity, "inner")
    return out.withColumn("scholar_unyeared_count", F.greatest(F.lit(0).cast("bigint"), F.col("scholar_total") - F.col("histogram_total")))


def histogram_gap(basics: DataFrame) -> DataFrame:
    """Signed gap between the reported total and the year table's, of rows (citedby, cites_per_year map)."""
    total = F.aggregate(F.map_values("cites_per_year"), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    out = basics.withColumn("year_table_total_citations", total).withColumn("year_table_gap", F.col("citedby") - F.col("year_table_total_citations"))
    return out.withColumn("year_table_matches_total", F.col("year_table_gap") == 0)
