"""Paged lists that have landed as rows (entity..., [year,] start, pos, ...): start is a page's first index, pos the place on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions.columns import PAGE, page_start


def scan(pages: DataFrame, entity: list[str], resume: DataFrame | None = None, per_year: bool = False) -> DataFrame:
    """The rows of whole lists with their index, and page_end on the last row of each page. resume: (entity..., next_index) of
    lists that go on from a row: pages before its page are not read, and the rows before it on its page are skipped."""
    group = [*entity, "year"] if per_year else entity
    rows = pages.withColumn("index", F.col("start") + F.col("pos"))
    if resume is not None:
        first = F.coalesce(F.col("__next").try_cast("bigint"), F.lit(0))
        rows = rows.join(resume.select(*entity, F.col("next_index").alias("__next")), entity, "left").where((F.col("start") >= page_start(F.col("__next"))) & (F.col("index") >= first)).drop("__next")
    last = F.max("pos").over(Window.partitionBy(*group, "start"))
    return rows.withColumn("page_end", F.col("pos") == last)


def scan_years(pages: DataFrame, entity: list[str], plan: DataFrame) -> DataFrame:
    """The lists of the years that plan (entity..., year, action) wants to fetch, each from its beginning."""
    wanted = plan.where("action = 'fetch'").select(*entity, "year")
    return scan(pages.join(wanted, [*entity, "year"], "left_semi"), entity, per_year=True)


def pages_of(rows: DataFrame, group: list[str], pos: Column) -> DataFrame:
    """rows dealt to pages by their order: adds start and pos."""
    at = F.row_number().over(Window.partitionBy(*group).orderBy(pos)) - 1
    return rows.withColumn("__at", at.cast("bigint")).withColumn("start", page_start(F.col("__at"))).withColumn("pos", F.col("__at") % PAGE).drop("__at")
