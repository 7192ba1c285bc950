"""Greedy deduplication on alternative keys, and membership by any key."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOF_GROUP = 2_000  # rows of a group up to which the fold over an array is cheap


def greedy_dedup(df: DataFrame, group: list[str], pos: str, keys: str, seeds: DataFrame | None = None) -> DataFrame:
    """Adds is_dupe and existing_pos to df, first row wins: walking a group by pos, a row with any key seen before is a
    duplicate and adds none of its keys; a kept row adds all of its own. That is neither transitive nor a distinct.

    seeds: (group..., key) of keys that count as seen from the start. A group is state of one task, as the rule needs its
    rows in order; rows stream through it sorted and spilled by Spark, and only the keys seen so far are held.
    """
    rows = df.select(*df.columns, F.lit(1).alias("__side"))
    if seeds is not None:
        held = seeds.select(*group, F.array("key").alias(keys))
        rows = rows.unionByName(held.withColumn("__side", F.lit(0)), allowMissingColumns=True)
    rows = rows.repartition(*group).sortWithinPartitions(*group, "__side", pos)
    out = df.schema.fieldNames()

    def walk(batches):
        at, seen = None, {}
        for pdf in batches:
            flags, which = [], []
            for key, side, p, own in zip(pdf[group].itertuples(index=False, name=None), pdf["__side"], pdf[pos], pdf[keys], strict=True):
                if key != at:
                    at, seen = key, {}
                hit = next((k for k in own if k in seen), None) if own is not None else None
                flags.append(hit is not None)
                which.append(seen[hit] if hit is not None else None)
                if hit is None and own is not None:
                    for k in own:
                        seen.setdefault(k, p if side else None)
            pdf = pdf.assign(is_dupe=flags, existing_pos=pd.array(which, dtype="Int64"))
            yield pdf[pdf["__side"] == 1][[*out, "is_dupe", "existing_pos"]]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return rows.mapInPandas(walk, f"{fields}, is_dupe boolean, existing_pos long")


def greedy_dedup_native(df: DataFrame, group: list[str], pos: str, keys: str) -> DataFrame:
    """(group..., pos) of the kept rows by a fold over an array: all in the JVM, for groups of up to HOF_GROUP rows."""
    rows = df.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), F.col(keys).alias("keys")))).alias("rows"))
    folded = F.expr(
        "aggregate(rows, named_struct('seen', cast(array() as array<string>), 'kept', cast(array() as array<bigint>)), (acc, x) -> "
        "if(arrays_overlap(acc.seen, x.keys), acc, named_struct('seen', array_union(acc.seen, x.keys), 'kept', array_append(acc.kept, cast(x.pos as bigint)))))"
    )
    return rows.select(*group, F.explode(folded["kept"]).alias(pos))


def flag_new(rows: DataFrame, old: DataFrame, scope: list[str], keys: str, row_id: list[str]) -> DataFrame:
    """rows with is_new: none of a row's keys is a key of old in the same scope. Keys are exploded on both sides, so the
    test is an equi-join however many alternatives there are."""
    known = old.select(*scope, F.explode(keys).alias("__key")).distinct()
    hits = rows.select(*row_id, *[c for c in scope if c not in row_id], F.explode(keys).alias("__key")).join(known, [*scope, "__key"], "left_semi").select(*row_id).distinct()
    return rows.join(hits.withColumn("__hit", F.lit(True)), row_id, "left").withColumn("is_new", F.col("__hit").isNull()).drop("__hit")


def once_new(rows: DataFrame, old: DataFrame, group: list[str], pos: str, keys: str) -> DataFrame:
    """rows whose keys are neither in old nor in a row that was counted before, in the order of pos: each is new once, however
    many years have it. Old keys are the seeds of the greedy walk."""
    seeds = old.select(*group, F.explode(keys).alias("key")).distinct()
    return greedy_dedup(rows, group, pos, keys, seeds).where("not is_dupe").drop("is_dupe", "existing_pos")
