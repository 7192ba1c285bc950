"""Structured Streaming over landed files: stateful greedy dedup, idempotent merge, windowed counts."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallywright.operators.merge import replace_buckets


def landed(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream over a table of a folder: one parquet file, or a folder of them."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    one_file = spark.read.parquet(path).inputFiles()[0].rstrip("/").endswith(f"/{name}.parquet")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if one_file else reader.parquet(path)


def stream_dedup(rows: DataFrame, group: str, pos: str, keys: str) -> DataFrame:
    """(group, pos) of the rows that greedy dedup keeps; the keys seen so far are the state of each group, as a JSON text."""

    def step(key, batches, state: GroupState):
        seen = set(json.loads(state.get[0])) if state.exists else set()
        rows = pd.concat(list(batches)).sort_values(pos)
        kept = []
        for p, own in zip(rows[pos], rows[keys], strict=True):
            if not seen.intersection(own):
                seen.update(own)
                kept.append(p)
        state.update((json.dumps(sorted(seen)),))
        yield pd.DataFrame({group: [key[0]] * len(kept), pos: kept})

    return rows.select(group, pos, keys).groupBy(group).applyInPandasWithState(step, f"{group} long, {pos} long", "seen string", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Runs a stream over all that has landed, to a parquet sink; a restart goes on from the checkpoint."""
    stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def fold_batches(stream: DataFrame, folder: str, checkpoint: str, step) -> DataFrame | None:
    """Folds a stream into a table of versions: batch n writes step(version before n, batch) as version n. A batch that is
    replayed after a failure reads the same version and overwrites its own, so that it counts once; a restart goes on from the
    checkpoint. Returns the last version, or None before the first batch. The one before the last is kept, older ones go."""
    spark = stream.sparkSession
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    versions = lambda: sorted(int(s.getPath().getName()[2:]) for s in fs.listStatus(root) if s.getPath().getName().startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))) if fs.exists(root) else []
    read = lambda n: spark.read.parquet(f"{folder}/v={n}")

    def put(batch: DataFrame, number: int) -> None:
        before = [n for n in versions() if n < number]
        step(read(before[-1]) if before else None, batch).write.mode("overwrite").parquet(f"{folder}/v={number}")
        for n in before[:-1]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{folder}/v={n}"), True)

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    found = versions()
    return read(found[-1]) if found else None


def merge_batches(stream: DataFrame, folder: str, checkpoint: str, key: list[str], order: str) -> DataFrame | None:
    """Upsert by batch: of the rows of a key, of all batches, the one with the greatest order stays."""

    def step(before: DataFrame | None, batch: DataFrame) -> DataFrame:
        rows = batch if before is None else before.unionByName(batch)
        others = [c for c in rows.columns if c not in key]
        return rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(order, *[c for c in others if c != order])).alias("__row")).select(*key, "__row.*")

    return fold_batches(stream, folder, checkpoint, step)


def replace_years(stream: DataFrame, folder: str, checkpoint: str, entity: list[str]) -> DataFrame | None:
    """Late rows: a batch brings whole years anew, and each year that it has replaces what was held of it; no watermark."""

    def step(before: DataFrame | None, batch: DataFrame) -> DataFrame:
        if before is None:
            return batch
        return replace_buckets(before, batch, entity, batch.select(*entity, "year").distinct()).drop("side")

    return fold_batches(stream, folder, checkpoint, step)


def daily_counts(events: DataFrame, time: str, kind: str, late: str = "1 day") -> DataFrame:
    """Extension: counts by day and kind behind a watermark."""
    rows = events.withColumn("__time", F.col(time).cast("timestamp")).withWatermark("__time", late)
    return rows.groupBy(F.window("__time", "1 day").alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), kind, "n")


def work_folder(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
