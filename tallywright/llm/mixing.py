"""Mixing sources to target weights: token totals per source, repetition rates, floor(rate) copies plus a Bernoulli one.

Nulls: a null text has size 0, a null source is a source of its own (ranked last), a null id hashes as empty text.
A row's random draw is a hash of its id and text, so that rows without id, or with one id, are drawn apart; only rows equal
in both share a draw. An empty table gives an empty result. Other columns of the input are kept; columns
named like the operator's own are replaced by them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright.llm.shared import stored, table, word_count

WEIGHTS = (5, 2, 1)  # of the sources in order of code points, repeating
MOST = 3  # times a source's size that its target may reach
BROADCAST_SOURCES = 100_000  # rows of source statistics that may be broadcast
SEED = "mix-1"


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target, rate) from (source, size).

    Targets share the whole size by weight; those above MOST times their source's size stop there and the excess is
    shared again. Sorted by the ratio of limit to weight, the stopped sources are a prefix, so running sums give the
    fixed point at once. The window holds one row for each source, not each document.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1)
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (
        total.withColumn("weight", weight.cast("long"))
        .withColumn("all_size", F.sum("source_size").over(everything))
        .withColumn("rest", F.col("all_size") - F.coalesce(F.sum(MOST * F.col("source_size")).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("open", F.col("rest") * F.col("weight") <= MOST * F.col("source_size") * F.col("weights"))
    )
    first = F.first(F.when(F.col("open"), F.struct("rest", "weights")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(F.col("open"), F.col("level.rest") * F.col("weight") / F.col("level.weights").cast("double")).otherwise((MOST * F.col("source_size")).cast("double"))
    return ranked.withColumn("level", first).select("source", "source_size", target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    )


def mix(docs: DataFrame) -> DataFrame:
    """docs with size, source_size, target, copies (how often the mix holds the document) and taken = copies * size."""
    own = ["size", "source_size", "target", "rate", "copies", "taken"]
    sized = docs.drop(*own).withColumn("size", word_count(F.col("text")))
    targets = stored(source_targets(sized.select("source", "size")), "sources")
    targets = targets.select(F.col("source").alias("__source"), "source_size", "target", "rate")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit(""))))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    floor = F.floor("rate")
    copies = floor + F.when(draw < F.col("rate") - floor, 1).otherwise(0)
    return sized.join(targets, F.col("source").eqNullSafe(F.col("__source"))).drop("__source").withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))


def emitted(docs: DataFrame) -> DataFrame:
    """Each document as often as the mix holds it, with the number of the copy."""
    mixed = mix(docs).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies", "taken", "rate")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


SQL = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS hash, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source COLLATE C NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS weight FROM s),
r AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT)
        - CAST(coalesce(sum(3 * source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
      CAST(sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS weights FROM w),
o AS (SELECT *, rest * weight <= 3 * source_size * weights AS is_open FROM r),
l AS (SELECT rest AS level_rest, weights AS level_weights FROM o WHERE is_open ORDER BY source_size / weight, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN is_open THEN (level_rest * weight) / CAST(level_weights AS DOUBLE) ELSE CAST(3 * source_size AS DOUBLE) END AS target FROM o, l),
u AS (SELECT d.doc_id, d.size, t.source_size, t.target, d.source, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
      CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || hash), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS draw
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CAST(floor(rate) AS BIGINT) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM u)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, source, CAST(copies AS BIGINT) AS copies FROM c
"""
