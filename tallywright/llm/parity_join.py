"""Jaccard join of word n-gram sets by parity sketches.

XOR-ing hashes of a set's members into the parts of a sketch makes two sketches differ in a part only where a member of the
symmetric difference falls. Two sets of sizes a and b with Jaccard similarity t or more differ in at most
(1 - t) / (1 + t) * (a + b) members, D for a band of sizes. A sketch is cut into P > D parts; by the pigeonhole principle
linked sets agree in at least A = P - D of them. They then share at least m of the P - A + m parts that come first in an
order that is the same for equal parts: that of part size, so that parts with few members, which say little, come last. A
part's key is the XOR of its members' 64-bit hashes, so that only sets with the same members there share it. One-hot bits
instead of hashes give the sketches whose Hamming distance bounds a pair's symmetric difference from below.

Equal sets meet first (by fingerprint). Sets with fewer than m parts in common with others drop out, and of its parts each
set may leave out the m - 1 that most sets share. Links are then found in rounds: sets that share a part but are not yet in
one component are compared by sketch, in blocks; while there are many such pairs, each set is verified against the nearest
one of a smaller label only, and in the last round against all that are left. Before a text is read, longer sketches must allow the link.

Defined cases: null and empty texts and texts without words have no set, link with nothing and are a component each. A
null id is never a component's id unless all its ids are null. Repeated rows are equal sets. Very long texts are hashed
whole. Extra columns are ignored by the join and kept by keep_first, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright.llm.shared import components, discard, lean, mix, sorted_groups, stored, table, word_hashes

WIDTH = 4  # words in a shingle
PERCENT = 85  # least Jaccard similarity, in hundredths
RATIO = 1.4  # of the sizes at a band's ends
SPARE = 0.12  # parts above D, as a share of D
BANDS = 128  # low bits of a key that name its band
SHORT_BITS = 1024  # of the sketches that blocks compare
ROUNDS = 3  # at most in which each set is verified against the nearest one of another component, before all the rest are
FEW = 100  # comparisons for each row, up to which all the rest are
BLOCK = 1024  # sets on either side of a block of comparisons
STAR = 512  # sets verified against one other in a task


@lru_cache(4)
def bands(percent: int) -> tuple[list[int], list[int]]:
    """First size of each band, and the most members by which linked sets differ whose smaller one is in the band."""
    edges, most = [1], []
    while edges[-1] < 1 << 40:
        low = edges[-1]
        edges.append(max(int(low * RATIO), low * 100 // percent) + 1)
        small = edges[-1] - 1
        large = small * 100 // percent
        most.append((100 - percent) * (small + large) // (100 + percent))
    return edges, most


def _sets(words: np.ndarray, at: np.ndarray, width: int):
    """Sorted distinct shingle hashes of each text."""
    for a, b in zip(at, at[1:], strict=False):
        if a == b:
            yield np.zeros(0, np.uint64)
            continue
        own = words[a:b]
        n = min(width, b - a)
        size = b - a - n + 1
        hashed = np.full(size, n, np.uint64)
        for k in range(n):
            hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + own[k : k + size]
        yield np.unique(mix(hashed))


def fingerprint(members: np.ndarray) -> int:
    """Of a set: positive, and 0 only for the empty one."""
    if not len(members):
        return 0
    total = np.add.reduce(mix(members + np.uint64(len(members))))
    return int(mix(np.array([total ^ np.uint64(len(members))], np.uint64))[0] >> np.uint64(1)) or 1


@lru_cache(512)
def _plan(allowed: int) -> tuple[int, int, int]:
    """Parts of a sketch, how many of its first ones linked sets share, and the number of these first ones."""
    equal = max(3, int(allowed * SPARE))
    need = 1 + (equal - 1) // 2
    return allowed + equal, need, allowed + need


def _keys(members: np.ndarray, band: int, plan: tuple[int, int, int]) -> np.ndarray:
    """Join keys of a set in the comparisons of a band: the first of its parts."""
    parts, _, used = plan
    hashed = mix(members)
    where = ((hashed >> np.uint64(16)) % np.uint64(parts)).astype(np.int64)
    value = np.zeros(parts, np.uint64)
    np.bitwise_xor.at(value, where, mix(hashed + np.uint64(band)))
    value = mix(value ^ mix(np.arange(parts, dtype=np.uint64) * np.uint64(1009) + np.uint64(band)))
    order = np.lexsort((value, -np.bincount(where, minlength=parts)))
    return value[order[:used]] & np.uint64(~(BANDS - 1) & ((1 << 64) - 1)) | np.uint64(band)


def _sketch(members: np.ndarray, size: int) -> bytes:
    where = ((mix(members ^ np.uint64(0x5BD1E995)) >> np.uint64(8)) % np.uint64(size)).astype(np.int64)
    return np.packbits((np.bincount(where, minlength=size) & 1).astype(np.uint8)).tobytes()


def sketches(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, fp, n, keys, sketch, short) of all documents."""
    edges, most = bands(percent)
    plans = [_plan(x) for x in most]

    def run(batches):
        starts = np.array(edges)
        for batch in batches:
            for a in range(0, batch.num_rows, 250):
                piece = batch.slice(a, 250)
                fps, sizes, keys, ends, marks, shorts = [], [], [], [0], [], []
                for members in _sets(*word_hashes(piece.column(1)), width):
                    n = len(members)
                    fps.append(fingerprint(members))
                    sizes.append(n)
                    used = []
                    if n:
                        band = int(np.searchsorted(starts, n, "right")) - 1
                        lower = band and -(-n * percent // 100) < edges[band]  # a linked set may be in the band below
                        used = [k for k in ([band, band - 1] if lower else [band]) if most[k]]
                    own = [_keys(members, k, plans[k]) for k in used]
                    keys += own
                    ends.append(ends[-1] + sum(map(len, own)))
                    marks.append(_sketch(members, 1 << max(6, (4 * n - 1).bit_length())) if n else None)
                    shorts.append(_sketch(members, SHORT_BITS) if n else None)
                flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), lists, pa.array(marks, pa.binary()), pa.array(shorts, pa.binary())],
                    names=["doc_id", "fp", "n", "keys", "sketch", "short"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, fp long, n long, keys array<long>, sketch binary, short binary")


def _allowed(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose sizes and sketches allow a link. A longer sketch is folded to the shorter one's size."""

    def run(batches):
        for batch in batches:
            a, b, n, m, x, y = (batch.column(k).to_pylist() for k in range(6))
            keep = []
            for k in range(batch.num_rows):
                one, two = np.frombuffer(x[k], np.uint8), np.frombuffer(y[k], np.uint8)
                # the sketch of twice the size has the bit of hash modulo 2s; both halves fall on the bit modulo s
                while len(one) > len(two):
                    one = one[: len(one) // 2] ^ one[len(one) // 2 :]
                while len(two) > len(one):
                    two = two[: len(two) // 2] ^ two[len(two) // 2 :]
                far = int(np.bitwise_count(one ^ two).sum(dtype=np.int64))
                keep.append(100 * min(n[k], m[k]) >= percent * max(n[k], m[k]) and far * (100 + percent) <= (100 - percent) * (n[k] + m[k]))
            kept = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)[kept]), pa.array(np.array(b, np.int64)[kept])], names=["a", "b"])

    pairs = stored(pairs, "candidates")
    sides = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp")))
    info = info.join(sides, "fp", "left_semi")
    one = info.select(F.col("fp").alias("a"), F.col("n").alias("n1"), F.col("sketch").alias("s1"))
    two = info.select(F.col("fp").alias("b"), F.col("n").alias("n2"), F.col("sketch").alias("s2"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "n1", "n2", "s1", "s2").mapInArrow(lean(run), "a long, b long")


def _verified(pairs: DataFrame, owner: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) of fingerprints whose sets are linked. The texts of one a come together with those of its bs,
    in groups of STAR; each is hashed as it passes and only a's set is held. Repeated rows repeat a pair."""
    own = Window.partitionBy("a")
    dealt = pairs.withColumn("slots", F.ceil(F.count("*").over(own) / STAR).cast("int")).withColumn("no", F.row_number().over(own.orderBy("b")))
    members = dealt.select("a", F.pmod(F.xxhash64("b"), F.col("slots")).cast("int").alias("slot"), F.col("b").alias("fp"), F.lit(1).alias("side"))
    firsts = dealt.where("no = 1").select("a", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.col("a").alias("fp"), F.lit(0).alias("side"))
    wanted = stored(members.unionByName(firsts), "wanted")
    ids = stored(owner.join(wanted.select("fp"), "fp", "left_semi").select("fp", F.col("doc_id").alias("__id")), "ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(ids, F.col("doc_id").eqNullSafe(F.col("__id"))).select("fp", "text")
    rows = wanted.join(texts, "fp").select("a", "slot", "side", "fp", "text")
    rows = rows.repartition("a", "slot").sortWithinPartitions("a", "slot", "side")

    def run(batches):
        at, base = None, None
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                piece = batch.slice(start, 500)
                a, slot, side, fp = (piece.column(k).to_numpy() for k in range(4))
                left, right = [], []
                for k, members in enumerate(_sets(*word_hashes(piece.column(4)), width)):
                    if fingerprint(members) != fp[k]:  # another row with the same id
                        continue
                    if not side[k]:
                        at, base = (a[k], slot[k]), members
                    elif at == (a[k], slot[k]):
                        both = len(np.intersect1d(base, members, assume_unique=True))
                        if 100 * both >= percent * (len(base) + len(members) - both):
                            left.append(a[k])
                            right.append(fp[k])
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(lean(run), "a long, b long")


def _blocks(percent: int, nearest: bool):
    """(key, a, b, far, more): pairs of sets in a block that differ in component and whose sketches and sizes allow a link;
    far is the sketches' distance. nearest: only each set's nearest one of smaller label, so that a round can join a whole
    group; more where a set has others of smaller label."""

    def run(batches):
        for group in sorted_groups(batches, ["key", "i", "j"]):
            block, own = group.column("i")[0].as_py(), group.column("block").to_numpy()
            other = group.column("j")[0].as_py()
            fp, n, label = (group.column(k).to_numpy() for k in ("fp", "n", "label"))
            marks = np.frombuffer(b"".join(group.column("short").to_pylist()), np.uint64).reshape(len(fp), -1)
            left, right = np.flatnonzero(own == block), np.flatnonzero(own == other)
            out, more = [], False
            sides = [(left, right)] if block == other else [(left, right), (right, left)]
            for some, rest in sides if nearest else sides[:1]:
                for x in some:
                    y = rest[label[rest] < label[x]] if nearest else rest[label[rest] != label[x]]
                    y = y[100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x])]
                    if not nearest and block == other:
                        y = y[fp[y] > fp[x]]
                    if len(y):
                        far = np.bitwise_count(marks[y] ^ marks[x]).sum(1, dtype=np.int64)
                        ok = np.flatnonzero(far * (100 + percent) <= (100 - percent) * (n[y] + n[x]))
                        if nearest and len(ok):
                            more |= len(ok) > 1
                            ok = ok[[np.argmin(far[ok])]]
                        out.append(np.stack([np.full(len(ok), fp[x]), fp[y[ok]], far[ok]]))
            if out:
                a, b, far = np.concatenate(out, axis=1)
                if len(a):
                    key = np.full(len(a), group.column("key")[0].as_py())
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(a), pa.array(b), pa.array(far), pa.array([more] * len(a), pa.bool_())], names=["key", "a", "b", "far", "more"])

    return run


def _shared(rows: DataFrame) -> DataFrame:
    """Rows (key, fp) of the keys that several sets have."""
    by_key = Window.partitionBy("key").orderBy("fp")
    return rows.withColumn("first", F.first("fp").over(by_key)).withColumn("next", F.lead("fp").over(by_key)).where("first <> fp or next <> fp").drop("first", "next")


def _buckets(exploded: DataFrame, percent: int) -> DataFrame:
    """(key, fp): keys that linked sets are sure to share, without those that too few or too many sets have."""
    most = bands(percent)[1]
    band = F.col("key").bitwiseAND(F.lit(BANDS - 1)).cast("int")
    need = F.element_at(F.array(*(F.lit(_plan(x)[1]) for x in most)), F.col("band") + 1)
    by_key = Window.partitionBy("key")
    rows = exploded.withColumn("size", F.count("*").over(by_key)).where("size > 1")
    own = Window.partitionBy("fp", "band")
    rows = rows.withColumn("band", band).withColumn("found", F.count("*").over(own)).withColumn("place", F.row_number().over(own.orderBy("size", "key")))
    rows = rows.where((F.col("found") >= need) & (F.col("place") <= F.col("found") - need + 1)).select("key", "fp")
    return stored(_shared(rows), "buckets")


def _unsettled(near: DataFrame) -> DataFrame:
    """(key) of the keys with a candidate other than those that are verified, each set's nearest over all keys: keys in
    which a set has more than one, or its only one there is not its nearest."""
    nearest = F.min(F.struct("far", "b")).over(Window.partitionBy("a"))
    return near.withColumn("nearest", nearest).where(F.col("more") | (F.col("b") != F.col("nearest.b"))).select("key").distinct()


def linked_sets(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(members: doc_id, fp, n) and (component: fp, root): the sets of documents and the components of linked sets.
    Joins with stored tables are broadcast by Spark's own threshold of bytes, and shuffled above it."""
    all_sets = stored(sketches(docs, width, percent), "sets")
    filled = all_sets.where("n > 0")
    owner = stored(filled.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")), "owners")
    # copies need not be joined: what is left of a set are the rows with its smallest id
    again = filled.select("fp", "doc_id").join(owner.where("copies > 1").select("fp", F.col("doc_id").alias("__id")), "fp").where("not doc_id <=> __id")
    again = stored(again.select(F.col("fp").alias("__fp"), F.col("doc_id").alias("__id")).distinct(), "copies")
    keyed = filled.select("doc_id", "fp", "keys").join(again, (F.col("fp") == F.col("__fp")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti")
    buckets = _buckets(keyed.select(F.explode("keys").alias("key"), "fp"), percent)
    # only sets of several documents need a shuffle to leave one row each
    wanted = stored(buckets.select("fp").distinct().join(owner.select("fp", "copies"), "fp"), "wanted")
    held = filled.select("fp", "n", "sketch", "short").join(wanted, "fp")
    info = stored(held.where("copies = 1").unionByName(held.where("copies > 1").dropDuplicates(["fp"])).drop("copies"), "info")
    members = stored(all_sets.select("doc_id", "fp", "n"), "members")
    discard(all_sets, wanted)
    links = None
    label = docs.sparkSession.range(0).select(F.col("id").alias("node"), F.col("id").alias("component"))
    tested, verified, slowing = None, 0, 0
    for turn in range(ROUNDS + 1):
        rows = buckets.join(label, F.col("fp") == F.col("node"), "left").select("key", "fp", F.coalesce("component", "fp").alias("label"))
        keys = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("low <> high")
        keys = stored(keys.select("key", "size", "a", "b"), "open")
        n, comparisons = keys.where("size > 2").agg(F.sum("size"), F.sum(F.col("size") * (F.col("size") - 1) / 2)).first()
        nearest = turn < ROUNDS and (n or 0) > 0 and (not turn or comparisons > FEW * n and slowing < 10)
        rest = rows.join(keys.where("size > 2").select("key", "size"), "key")
        marks = info.select("fp", "n", "short")
        rest = rest.join(marks, "fp").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
        rest = rest.withColumn("block", F.pmod(F.xxhash64("fp", "key"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rest = rest.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp", "n", "label", "short")
        rest = rest.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        near = stored(rest.mapInArrow(lean(_blocks(percent, nearest)), "key long, a long, b long, far long, more boolean"), "near")
        pairs = near.groupBy("a").agg(F.min_by("b", F.struct("far", "b")).alias("b")) if nearest else near
        pairs = pairs.select("a", "b")
        if not turn:
            pairs = pairs.unionByName(keys.where("size = 2").select("a", "b"))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stored(_allowed(pairs, info, percent), "pairs")
        verified, before = pairs.count(), verified
        slowing = before / max(1, verified)  # a round that had little to verify says that little is left
        if verified:
            tested = pairs if tested is None else tested.unionByName(pairs)
            found = stored(_verified(pairs, owner, docs, width, percent), "links")
            links = found if links is None else links.unionByName(found)
            label = stored(components(links).select("node", "component"), "labels")
        if not nearest:
            break
        kept = stored(buckets.join(_unsettled(near), "key", "left_semi"), "buckets")
        discard(buckets, keys, near)
        buckets = kept
    discard(buckets, info)
    return members, label.select(F.col("node").alias("fp"), F.col("component").alias("root"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs; component_id is the component's smallest id."""
    members, roots = linked_sets(docs, width, percent)
    labelled = members.where("fp <> 0").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = labelled.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    # the smallest ids come back by a set's fingerprint, one row for each; sets of many copies split between tasks
    found = labelled.join(smallest, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return found.unionByName(members.where("fp = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _one_row_each(docs: DataFrame) -> DataFrame:
    """docs with one row for each id, the one that sorts first, and for each text without id. The rows of an id are folded
    before they are shuffled, so that no id is hot."""
    key = [F.col("doc_id").alias("__id"), F.when(F.col("doc_id").isNull(), F.md5("text")).alias("__text")]
    again = stored(docs.groupBy(*key).agg(F.count("*").alias("__n")).where("__n > 1").select("__id", "__text"), "repeated")
    if again.isEmpty():
        return docs
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.when(F.col("doc_id").isNull(), F.md5("text")).eqNullSafe(F.col("__text"))
    one = docs.join(again, same, "left_semi").groupBy(*key).agg(F.min(F.struct("text", *[c for c in docs.columns if c != "text"])).alias("__row"))
    return docs.join(again, same, "left_anti").unionByName(one.select("__row.*").select(docs.columns))


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs without the documents of a component other than that with the smallest id. Of rows that share an id, and of equal
    texts without id, one stays; a document without id stays if its component has no id."""
    docs = _one_row_each(docs)
    found = near_duplicates(docs, width, percent)
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("__id"))
    out = docs.where("doc_id is not null").join(kept, F.col("doc_id") == F.col("__id"), "left_semi")
    lonely = docs.where("doc_id is null")
    if lonely.isEmpty():
        return out
    return out.unionByName(_without_id(docs, lonely, width, percent))


def _without_id(docs: DataFrame, lonely: DataFrame, width: int, percent: int) -> DataFrame:
    """Of documents without id, one of each component that has no id, the one whose text sorts first."""
    numbered = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit("no id"), "text")).alias("doc_id"), "text", F.col("doc_id").isNull().alias("__lonely"))
    known = near_duplicates(numbered, width, percent).withColumnRenamed("doc_id", "__number")
    texts = lonely.withColumn("__number", F.xxhash64(F.lit("no id"), "text"))
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("__number")).join(known, "__number").select("component_id").distinct()
    alone = known.join(texts.select("__number"), "__number", "left_semi").join(ids, "component_id", "left_anti")
    first = texts.join(alone, "__number").groupBy("component_id").agg(F.min(F.struct("text", "__number")).alias("__first"))
    return texts.join(first.select(F.col("__first.__number").alias("__number")), "__number", "left_semi").select(docs.columns)


def op7_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
