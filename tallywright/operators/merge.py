"""Merging refreshed rows into kept ones. Rows carry an explicit pos; the result's order is (side, pos)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def replace_buckets(base: DataFrame, fresh: DataFrame, entity: list[str], touched: DataFrame) -> DataFrame:
    """base without the years of touched (entity..., year; a null year is a bucket too), then fresh. Adds side."""
    cond = [base[c].eqNullSafe(touched[c]) for c in [*entity, "year"]]
    kept = base.join(touched, cond, "left_anti")
    return kept.withColumn("side", F.lit(0)).unionByName(fresh.withColumn("side", F.lit(1)))


def overlay(base: DataFrame, fresh: DataFrame, entity: list[str]) -> DataFrame:
    """Upsert by any identity key: rows (entity..., pos, keys, ...). A base row is replaced by the fresh row of its first key
    that matches (the last one, if several fresh rows have it); fresh rows that replaced nothing are appended, one for each
    primary key. Adds side."""
    others = [c for c in base.columns if c not in (*entity, "pos")]
    row = F.struct("pos", *others)
    build = fresh.select(*entity, "pos", F.explode("keys").alias("key"), row.alias("row"), F.element_at("keys", 1).alias("primary")).groupBy(*entity, "key").agg(F.max_by(F.struct("row", "primary"), "pos").alias("hit"))
    probe = base.select(*entity, F.col("pos").alias("base_pos"), F.posexplode("keys").alias("turn", "key")).join(build, [*entity, "key"])
    best = probe.groupBy(*entity, "base_pos").agg(F.min_by("hit", "turn").alias("hit"))
    merged = base.withColumnRenamed("pos", "base_pos").join(best, [*entity, "base_pos"], "left")
    merged = merged.select(*entity, F.col("base_pos").alias("pos"), *(F.when(F.col("hit").isNotNull(), F.col("hit.row")[c]).otherwise(F.col(c)).alias(c) for c in others), F.lit(0).alias("side"))
    used = best.select(*entity, F.col("hit.primary").alias("primary")).distinct()
    rest = fresh.withColumn("primary", F.element_at("keys", 1)).join(used, [*entity, "primary"], "left_anti")
    rest = rest.groupBy(*entity, "primary").agg(F.min_by(row, "pos").alias("row")).select(*entity, "row.*").withColumn("side", F.lit(1))
    return merged.unionByName(rest)


def materialize(base: DataFrame, fresh: DataFrame, entity: list[str], complete: DataFrame) -> DataFrame:
    """Entities of complete take the fresh rows alone, the others an overlay."""
    whole = fresh.join(complete, entity, "left_semi").withColumn("side", F.lit(1))
    return whole.unionByName(overlay(base.join(complete, entity, "left_anti"), fresh.join(complete, entity, "left_anti"), entity))


def clear_range(state: DataFrame, ranked: DataFrame, key: str, skip: int, limit: int | None) -> DataFrame:
    """Force mode: state without the entities whose no is in the positional range."""
    inside = ranked.where(F.col("no") > skip if not limit else F.col("no").between(skip + 1, skip + limit))
    return state.join(inside, key, "left_anti")


def carry_over(entities: DataFrame, new: DataFrame, old: DataFrame, key: str, value: str) -> DataFrame:
    """Entities with their new value, or else the one that they had."""
    return entities.join(new.select(key, F.col(value).alias("__new")), key, "left").join(old.select(key, F.col(value).alias("__old")), key, "left").withColumn(value, F.coalesce("__new", "__old")).drop("__new", "__old")


def year_buckets(rows: DataFrame, entity: list[str], value: str) -> DataFrame:
    """(entity..., year, members): rows by year in the order of pos; a null year is a bucket too."""
    return rows.groupBy(*entity, "year").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", value))), lambda r: r[value]).alias("members"))


def current_view(base: DataFrame, fresh: DataFrame, entity: list[str], replaced: DataFrame) -> DataFrame:
    """Year mode: entities of replaced (whole, or rebuilt by force) change the years that fresh has, the others overlay."""
    touched = fresh.join(replaced, entity, "left_semi").select(*entity, "year").distinct()
    whole = replace_buckets(base.join(replaced, entity, "left_semi"), fresh.join(replaced, entity, "left_semi"), entity, touched)
    return whole.unionByName(overlay(base.join(replaced, entity, "left_anti"), fresh.join(replaced, entity, "left_anti"), entity))


def never_empty(fresh: DataFrame, old: DataFrame, entity: list[str]) -> DataFrame:
    """fresh, and the old rows of entities that fresh has none of, so that an empty result loses nothing."""
    return fresh.unionByName(old.join(fresh.select(*entity).distinct(), entity, "left_anti"))


def all_rows(resumed: DataFrame, batches: DataFrame, entity: list[str]) -> DataFrame:
    """What a session holds: the rows it went on from with every completed year's bucket replaced by that year's batch."""
    return replace_buckets(resumed, batches, entity, batches.select(*entity, "year").distinct())


def last_by_title(rows: DataFrame, title: str, pos: str, value: str) -> DataFrame:
    """(title, value) with the last one of a title."""
    return rows.groupBy(title).agg(F.max_by(value, pos).alias(value))


def with_order(rows: DataFrame, entity: list[str]) -> DataFrame:
    """Adds no = 1..n: kept rows first, then refreshed years from the oldest on (no year last), each by pos."""
    order = [F.col("side"), F.when(F.col("side") == 1, F.col("year")).asc_nulls_last(), F.col("pos")]
    return rows.withColumn("no", F.row_number().over(Window.partitionBy(*entity).orderBy(*order)).cast("bigint"))
