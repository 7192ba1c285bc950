"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, rerank by cosine.

Rotations learned by iterative quantisation on a bounded sample (FIT vectors with the smallest hash) turn each vector into
balanced binary codes. A label's codes are cut into tables, substrings of bits bits; its vectors that agree in a substring meet in
that bucket, in blocks, and are compared by cosine in double precision. A pair is counted in the first substring in which it
agrees, so that no list of pairs is ever formed: a block gives each vector's number of links and a spanning forest.

A label of n vectors has SPARE bits more than the logarithm of n, so that a bucket holds less than one unlike vector at any n and
vectors that stand alone don't travel; it has so many tables that pairs at cosine 0.98 meet with a chance of RECALL. They grow as a
small power of n (some 10 at 5,000 vectors, 20 at 1,000,000). Tests measure recall against brute force. Equal vectors of a label
meet before, as one with a multiplicity.

Null, empty and zero vectors, vectors with null or non-finite components and rows with null labels link with nothing and are
kept. Vectors of different lengths are never compared. Repeated vec_ids count as vectors of their own; a null vec_id is no
component's id. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.shared import components, discard, lean, small, sorted_groups, stored, table

LEAST = 0.98
FIT = 20_000  # vectors that rotations are learned on
SPARE = 2  # bits of a substring above the logarithm of the label's vectors
RECALL = 0.995  # of pairs at cosine LEAST
CENTRED = 0.5  # least length that vectors keep when their mean is taken away; else it stays
STEPS = 30
BLOCK = 1024  # vectors on either side of a block
CODED = ["vec", "label", "embedding", "copies", "least", "width"]


def learn_rotations(sample: np.ndarray, bits: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): principal axes turned by rotations under which signs quantise best; as many as bits need."""
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    mean = x.mean(0)
    if np.quantile(np.linalg.norm(x - mean, axis=1), 0.05) < CENTRED:
        mean = np.zeros_like(mean)
    x = x - mean
    width = x.shape[1]
    _, axes = np.linalg.eigh(x.T @ x)
    random = np.random.default_rng(seed)
    found = []
    for _ in range(-(-bits // width)):
        rotation, _ = np.linalg.qr(random.standard_normal((width, width)))
        for _ in range(STEPS):
            signs = np.where(x @ axes @ rotation >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(signs.T @ (x @ axes))
            rotation = (u @ v).T
        found.append(axes @ rotation)
    return mean, np.concatenate(found, axis=1)[:, :bits]


def agreement(sample: np.ndarray, mean: np.ndarray) -> float:
    """Chance that a bit of two vectors at cosine LEAST is equal: their angle, seen from mean."""
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    length = np.quantile(np.linalg.norm(x - mean, axis=1), 0.05)
    return 1 - 2 * math.asin(min(1.0, math.sqrt((1 - LEAST) / 2) / length)) / math.pi


def _unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _compare(batches):
    """Of each block: (vec, links, vec2): a vector's links that are counted here, or a link of the block's forest."""
    for group in sorted_groups(batches, ["label", "width", "place", "value", "i", "j"]):
        i, j, place = (group.column(k)[0].as_py() for k in ("i", "j", "place"))
        block, ids, copies = (group.column(k).to_numpy() for k in ("block", "vec", "copies"))
        codes = np.stack(group.column("code").combine_chunks().flatten().to_numpy().reshape(len(ids), -1))
        x = _unit(group.column("embedding").to_pylist())
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(left) or not len(right):
            continue
        linked = x[left] @ x[right].T >= LEAST
        if i == j:
            np.fill_diagonal(linked, False)
        first = linked.copy()
        for k in range(place):
            first &= codes[left, k][:, None] != codes[right, k][None, :]
        counts = np.zeros(len(ids), np.int64)
        counts[left] += first @ copies[right]
        if i != j:
            counts[right] += first.T @ copies[left]
        some = np.flatnonzero(counts)
        a, b = np.nonzero(linked)
        a, b = left[a], right[b]
        label = np.arange(len(ids))
        while len(a):
            low = np.minimum(label[a], label[b])
            new = label.copy()
            for side in (a, b):
                np.minimum.at(new, label[side], low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        tree = np.flatnonzero(label != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([ids[some], ids[tree]])), pa.array(np.concatenate([counts[some], np.zeros(len(tree), np.int64)])), pa.array(np.concatenate([ids[some], ids[label[tree]]]))],
            names=["vec", "links", "other"],
        )


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of rows (vec_id, embedding, label)."""
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = kind if kind == "float" else "double"  # floats travel as such and are compared as doubles
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    # a component that is null or not finite fails the comparison; all of them zero fail the second
    sound = F.expr("label is not null and embedding is not null and size(embedding) > 0 and coalesce(forall(embedding, v -> abs(v) <= 1.7976931348623157E308), false) and exists(embedding, v -> v <> 0)")
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    good = rows.where("sound").withColumn("embedding", F.transform("embedding", lambda v: v + F.lit(0.0).cast(kind)))
    unique = stored(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")).withColumn("vec", F.xxhash64("label", "embedding")).withColumn("width", F.size("embedding")), "unique")
    sample = unique.select("embedding", "width").orderBy(F.xxhash64("embedding")).limit(FIT).toArrow()
    fits = {}
    for width in sorted(set(sample.column("width").to_pylist()) - {1}):
        fits[width] = _unit([v for v, w in zip(sample.column("embedding").to_pylist(), sample.column("width").to_pylist(), strict=True) if w == width])
    means = {width: learn_rotations(fit, 1)[0] for width, fit in fits.items()}
    equal = min((agreement(fit, means[width]) for width, fit in fits.items()), default=0.5)
    labels = unique.groupBy("label").agg(F.count("*").alias("n")).withColumn("bits", (F.ceil(F.log2("n")) + SPARE).cast("int"))
    labels = stored(labels.withColumn("tables", F.greatest(F.lit(1), F.ceil(F.lit(math.log(1 - RECALL)) / F.log1p(-F.pow(F.lit(equal), "bits")))).cast("int")).select("label", "bits", "tables"), "labels")
    models = {width: learn_rotations(fit, labels.agg(F.max(F.col("bits") * F.col("tables"))).first()[0]) for width, fit in fits.items()}

    def encode(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 2000):
                batch = whole.slice(a, 2000)
                widths, bits, tables = (batch.column(k).to_numpy() for k in ("width", "bits", "tables"))
                codes: list = [None] * batch.num_rows
                for width, b, t in set(zip(widths.tolist(), bits.tolist(), tables.tolist(), strict=True)):
                    at = np.flatnonzero((widths == width) & (bits == b) & (tables == t))
                    found = np.zeros((len(at), t), np.int64)
                    if width in models:
                        mean, projection = models[width]
                        signs = (_unit(batch.column("embedding").take(pa.array(at)).to_pylist()) - mean) @ projection[:, : b * t] >= 0
                        found = signs.reshape(len(at), t, b) @ (1 << np.arange(b, dtype=np.int64))
                    for k, code in zip(at.tolist(), found.tolist(), strict=True):
                        codes[k] = code
                yield pa.RecordBatch.from_arrays([batch.column(k) for k in CODED] + [pa.array(codes, pa.list_(pa.int64()))], names=[*CODED, "code"])

    sized = unique.join(small(labels), "label").select(*CODED, "bits", "tables")
    coded = stored(sized.mapInArrow(lean(encode), f"vec long, label string, embedding array<{kind}>, copies long, least long, width int, code array<long>"), "codes")
    discard(unique)
    key = ["label", "width", "place", "value"]
    keyed = coded.select("vec", "label", "embedding", "copies", "width", "code", F.posexplode("code").alias("place", "value"))
    sizes = small(stored(keyed.groupBy(*key).agg(F.count("*").alias("size")).where("size > 1"), "sizes"))
    keyed = keyed.join(sizes, key).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("vec"), F.col("blocks")).cast("int"))
    keyed = keyed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    keyed = keyed.select(*key, "i", "j", "block", "vec", "copies", "code", "embedding").repartition(*key, "i", "j").sortWithinPartitions(*key, "i", "j")
    found = stored(keyed.mapInArrow(lean(_compare), "vec long, links long, other long"), "found")
    links = found.groupBy("vec").agg(F.sum("links").alias("links"))
    roots = components(found.where("vec <> other").select("vec", "other")).withColumnRenamed("node", "vec")
    sets = coded.join(links, "vec", "left").join(roots, "vec", "left").withColumn("root", F.coalesce("component", "vec"))
    sets = stored(sets.select("vec", "label", "embedding", "least", "root", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "result")
    smallest = sets.groupBy("root").agg(F.min("least").alias("component_id"))
    sets = sets.join(smallest, "root").select("vec", "n_links", "component_id")
    out = good.select("vec_id", F.xxhash64("label", "embedding").alias("vec")).join(sets, "vec").select("vec_id", "n_links", "component_id")
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
