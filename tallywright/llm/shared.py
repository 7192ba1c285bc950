"""What several operators need: shared storage, word hashing over Arrow buffers, sorted-group streams, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_MMAP_THRESHOLD = -3  # fixed value: of the C library
CHUNK = 1 << 20  # bytes hashed at once
_POWERS: list[np.ndarray] = []
_BASE = 0x9E3779B97F4A7C15


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, which every executor sees; a local folder only if that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="tallywright-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, whole_files: bool = False) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage and survives lost executors. Once the table is
    written, nothing can need the shuffle files that led to it, and Spark deletes them at once.
    whole_files: each partition becomes one row group, which no later read splits."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**{"parquet.block.size": (1 << 31) - 1} if whole_files else {}).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    tidy(spark)
    return out


def tidy(spark: SparkSession) -> None:
    """Gives the driver's unused memory back: a job of many small steps leaves plans and results behind in both processes,
    and the JVM shrinks its heap at a full collection only."""
    gc.collect()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)
    spark.sparkContext._jvm.System.gc()
    _trim_jvm(spark)


def _trim_jvm(spark: SparkSession) -> None:
    """The same for what the JVM holds beside its heap: its many threads' allocators keep what compilers, collections and
    buffers have freed, however small the heap is. JVMs without that command, or on another C library, stay as they are."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    known = jvm.java.lang.Class.forName

    def array(kind, items):
        out = gateway.new_array(kind, len(items))
        for i, x in enumerate(items):
            out[i] = x
        return out

    try:
        kinds = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
        # by the interface: the server's own class is closed to reflection
        call = known("javax.management.MBeanServer").getMethod("invoke", array(jvm.java.lang.Class, [known(x) for x in kinds]))
        commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        nothing = array(jvm.java.lang.Object, []), array(jvm.java.lang.String, [])
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), array(jvm.java.lang.Object, [commands, "systemTrimNativeHeap", *nothing]))
    except Py4JError:
        pass


def discard(*tables: DataFrame) -> None:
    """Deletes those of tables that are stored ones; nothing may read them again."""
    for df in tables:
        if "folder" not in df.__dict__:
            continue
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.folder)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """df, a stored table of a few narrow columns, marked for broadcast if it has at most so many rows; else as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def lean(run):
    """run, a function on Arrow batches, in a Python worker that gives memory back: workers live on from task to task, and
    what their allocators keep would add up beside the executor's heap."""

    def wrapped(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):
            libc.mallopt(_MMAP_THRESHOLD, 1 << 20)
        try:
            yield from run(batches)
        finally:
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(column: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo modulus; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009-U+000D; null: 0. Needs no array of the words."""
    marks = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.regexp_replace(marks, r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK + 1)
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps))
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


def _tables(letters: bool) -> tuple[np.ndarray, np.ndarray]:
    space = np.zeros(256, bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    if letters:
        space[:128] = [not chr(i).isalnum() for i in range(128)]
    lower = np.arange(1, 257, dtype=np.uint64)
    lower[65:91] += np.uint64(32)
    return space, lower


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and the offset of each; nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(column: pa.Array, letters: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+, A-Z lower-cased, of all texts, and each text's offset among them.
    letters: words are runs of letters and digits, all letters lower-cased.

    Works on 1 MB of bytes at a time, cut between words, so that a very long text costs 8 bytes a word.
    """
    raw, offsets = text_buffers(pc.utf8_lower(column) if letters else column)
    space, lower = _tables(letters)
    found, counts = [], np.zeros(len(offsets) - 1, np.int64)
    at, end = 0, len(raw)
    while at < end:
        stop = min(end, at + CHUNK)
        if stop < end:
            gaps = np.flatnonzero(space[raw[at:stop]])
            edge = offsets[np.searchsorted(offsets, stop, "right") - 1]
            cut = max(at + gaps[-1] + 1 if len(gaps) else at, edge)
            if cut <= at:  # one word longer than a chunk
                width = CHUNK
                while cut <= at:
                    gaps = np.flatnonzero(space[raw[stop : stop + width]])
                    after = offsets[np.searchsorted(offsets, at, "right")]
                    cut = min(stop + gaps[0] + 1 if len(gaps) else end, after)
                    width *= 4
            stop = cut
        part = raw[at:stop]
        inside = ~space[part]
        first = np.searchsorted(offsets, at, "left")
        last = np.searchsorted(offsets, stop, "left")
        edges = offsets[first:last] - at
        before = np.empty(len(part), bool)
        before[0] = False
        before[1:] = inside[:-1]
        before[edges[edges < len(part)]] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty(len(part), bool)
        after[-1] = False
        after[:-1] = inside[1:]
        after[edges[edges > 0] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        up, down = _powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(lower[part] * up[: len(part)], out=sums[1:])
        found.append(mix((sums[ends] - sums[starts]) * down[starts]))
        counts += np.bincount(np.searchsorted(offsets, starts + at, "right") - 1, minlength=len(counts))[: len(counts)]
        at = stop
    words = np.concatenate(found) if found else np.zeros(0, np.uint64)
    return words, np.concatenate([[0], np.cumsum(counts)])


def sorted_groups(batches, keys: list[str]):
    """Tables of equal keys from record batches sorted by them; one group is held at a time."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            column = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            change[1:] |= column[1:] != column[:-1]
        cuts = [0, *np.flatnonzero(change), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            piece = batch.slice(a, b - a)
            if held and a == 0 and any(held[-1].column(k)[-1].as_py() != piece.column(k)[0].as_py() for k in keys):
                yield pa.Table.from_batches(held)
                held = []
            elif held and a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(piece)
    if held:
        yield pa.Table.from_batches(held)


def _roots(pairs: np.ndarray) -> pa.RecordBatch:
    """Each node of the pairs with the smallest node that they reach from it, where that is another."""
    nodes, index = np.unique(pairs, return_inverse=True)
    index = index.reshape(pairs.shape)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[index[0]], label[index[1]])
        new = label.copy()
        for side in index:
            np.minimum.at(new, side, low)
            np.minimum.at(new, label[side], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], names=["node", "root"])


def _contract(most: int):
    """Links of a partition, at most so many at a time, as (node, smallest node that these reach)."""

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            if rows + batch.num_rows > most and rows:
                yield _roots(np.concatenate(held, axis=1))
                held, rows = [], 0
            held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
            rows += batch.num_rows
        if rows:
            yield _roots(np.concatenate(held, axis=1))

    return run


def components(links: DataFrame, most: int = 500_000) -> DataFrame:
    """(node, component) of every node that reaches a smaller one; component is its smallest reachable node.

    links: two columns of longs, of a stored table. Each level contracts them, at most `most` (some 50 MB) in a task, keeps
    each node's smallest root and goes on with the links that this leaves between roots; a few levels suffice, and no task
    holds more, however large a component is. A level that fits one task is the last.
    """
    a, b = links.columns
    edges = links.where(F.col(a) != F.col(b)).select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    levels: list[DataFrame] = []
    while True:
        tasks = max(1, -(-edges.count() // most))
        star = stored(edges.coalesce(tasks).mapInArrow(lean(_contract(most)), "node long, root long"), "stars")
        if tasks == 1:
            levels.append(star.withColumnRenamed("root", "p"))
            break
        parent = stored(star.groupBy("node").agg(F.min("root").alias("p")), "parents")
        levels.append(parent)
        left = star.join(parent, "node").where("root <> p").select(F.col("root").alias("u"), F.col("p").alias("v"))
        chain = parent.select(F.col("p").alias("node")).distinct().join(parent, "node").select(F.col("node").alias("u"), F.col("p").alias("v"))
        edges = stored(left.unionByName(chain).distinct(), "edges")
        if edges.isEmpty():
            break
    out = levels.pop()
    while levels:
        parent = levels.pop()
        up = out.select(F.col("node").alias("p"), F.col("p").alias("q"))
        out = parent.join(up, "p", "left").select("node", F.coalesce("q", "p").alias("p")).unionByName(out.join(parent.select("node"), "node", "left_anti").select("node", "p"))
    return out.select("node", F.col("p").alias("component"))
