"""Comparing consecutive snapshots, and the history of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank(df: DataFrame, group: list[str], by: str, pos: str) -> DataFrame:
    """Adds no = 1..n by falling value, ties by former position."""
    return df.withColumn("no", F.row_number().over(Window.partitionBy(*group).orderBy(F.col(by).desc(), F.col(pos).asc())))


def new_rows(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    return current.join(previous, key, "left_anti")


def changed_rows(current: DataFrame, previous: DataFrame, key: str, value: str) -> DataFrame:
    """(key, old, new) where both snapshots have the key and the values differ."""
    now = current.select(key, F.col(value).alias("new"))
    return now.join(previous.select(key, F.col(value).alias("old")), key).where("new <> old")


def change_record(current: DataFrame, previous: DataFrame, key: str, value: str, group: list[str] | None = None) -> DataFrame:
    """(group..., new_items, changed_items): sorted arrays of new keys and of key, old and new value."""
    group = group or []
    added = new_rows(current, previous, key).select(*group, F.col(key).alias("item"), F.lit(None).cast("string").alias("change"))
    labelled = current.select(key, *group)
    moved = changed_rows(current, previous, key, value).join(labelled, key)
    moved = moved.select(*group, F.lit(None).cast(current.schema[key].dataType).alias("item"), F.format_string("%s:%s>%s", key, "old", "new").alias("change"))
    return added.unionByName(moved).groupBy(*group).agg(F.array_sort(F.collect_set("item")).alias("new_items"), F.array_sort(F.collect_set("change")).alias("changed_items"))


def append_history(history: DataFrame, record: DataFrame, group: list[str]) -> DataFrame:
    """history (group..., seq, ...) with record as the next entry of each group."""
    last = history.groupBy(*group).agg(F.max("seq").alias("__last"))
    new = record.join(last, group, "left").withColumn("seq", F.coalesce("__last", F.lit(0)) + 1).drop("__last")
    return history.unionByName(new.select(history.columns))


def reused_publications(previous: DataFrame, landed: DataFrame, totals: DataFrame, group: list[str]) -> DataFrame:
    """The previous list of each group whose total (group..., old, new) did not change, else the landed one. A group that has no
    previous list takes the landed one."""
    keep = totals.where("old = new").select(*group).join(previous.select(*group).distinct(), group, "left_semi")
    return previous.join(keep, group, "left_semi").unionByName(landed.join(keep, group, "left_anti"))
