"""Deterministic sharded WARC writer and reader.

Records are sorted by page id (null first), then by a hash of digest and url, into shards of about SHARD bytes, MOST shards
at most. A shard begins where the running sum of bytes over that order passes a multiple of the shard's size: the sum is
taken in range partitions and shifted by what lies before each, so that the cut points depend on the rows alone, whatever
the ranges. They are a sorted table of fixed-width keys, searched by binary search; many rows without id, or with one id,
are cut between like all others. Only rows equal in id, url and payload stay together: one task streams them to its files.

A shard's task rolls its files by compressed size, writes each under a temporary name and renames it when it is whole; a
manifest of the finished files, written last, makes the archive valid, and what lost attempts left is then deleted. Each
file begins with a warcinfo record. Running again on the same rows gives the same bytes, and a task that is repeated after a
loss replaces its files by equal ones.

Of equal payloads of at least MIN_REVISIT bytes the row with the smallest id is a response, the others revisit it. Rows
that share the smallest id and payload are all responses; a null id sorts first and is never referred to. A null payload is
empty. Repeated rows give repeated records. An empty table gives an archive with an empty manifest. Columns other than
page_id, url and html are not written, whatever their names.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.shared import lean, shared_folder, stored, table

MIN_REVISIT = 100  # bytes
SHARD = 32 << 20  # payload bytes aimed at for each shard
MOST = 20_000  # shards; beyond SHARD * MOST bytes shards are larger
ROLL = 8 << 20  # compressed bytes after which a file is closed; a 16th of a larger shard
EXTRA = 200  # bytes that count for a record's headers
TEMPORARY = "_temporary"
DATE = "2024-01-01T00:00:00Z"  # of every record, so that bytes repeat
MANIFEST = "shard int, file string, records long, bytes long, sha256 string, first_id long, last_id long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, valid boolean"


def _running(batches):
    """Rows (part, page_id, spot, n, before) of a sorted range partition: before is the sum of n above the row."""
    part, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column(2).to_numpy()
        sums = np.cumsum(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), batch.column(0), batch.column(1), batch.column(2), pa.array(total + sums - n)], names=["part", "page_id", "spot", "n", "before"])
        total += int(sums[-1]) if len(sums) else 0


def cut_points(sizes: DataFrame) -> tuple[list[tuple], int]:
    """First (page_id, spot) of each shard but the first, sorted, and the bytes of a shard; sizes: (page_id, spot, n)."""
    order = [F.col("page_id").asc_nulls_first(), F.col("spot")]
    ranged = sizes.select("page_id", "spot", "n").repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stored(ranged.mapInArrow(lean(_running), "part int, page_id long, spot long, n long, before long"), "sizes")
    parts = sorted(tuple(r) for r in ranged.groupBy("part").agg(F.sum("n")).collect())  # one row for each range partition
    if not parts:
        return [], SHARD
    bases = np.cumsum([0, *(n for _, n in parts)]).tolist()
    size = max(SHARD, -(-bases[-1] // MOST))
    offsets = sizes.sparkSession.createDataFrame(pa.table({"part": pa.array([p for p, _ in parts], pa.int32()), "base": pa.array(bases[:-1], pa.int64())}))
    shard = F.floor((F.col("base") + F.col("before")) / size)
    first = ranged.join(F.broadcast(offsets), "part").groupBy(shard.alias("shard")).agg(F.min(F.struct("page_id", "spot")).alias("key"))
    keys = sorted({(r["page_id"] is not None, r["page_id"] or 0, r["spot"]) for r in first.select("key.*").collect()})  # MOST + 1 at most
    return keys[1:], size


def _sortable(known: np.ndarray, ids: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """Keys as 17 bytes that compare like them."""
    sign = np.uint64(1 << 63)
    out = np.empty((len(ids), 17), np.uint8)
    out[:, 0] = known
    for at, x in ((1, ids), (9, spots)):
        out[:, at : at + 8] = (x.astype(np.int64).view(np.uint64) ^ sign).astype(">u8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(out).view("S17").ravel()


def _shard_of(spark: SparkSession, cuts: list[tuple]):
    """The number of cut points at or below a row's (page_id, spot)."""
    if not cuts:
        return F.lit(0)
    sent = spark.sparkContext.broadcast(_sortable(*(np.array(c) for c in zip(*cuts, strict=True))))  # 17 bytes for each of MOST

    @F.pandas_udf("int")
    def search(known: pd.Series, page_id: pd.Series, spot: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(sent.value, _sortable(known.to_numpy(), page_id.to_numpy(), spot.to_numpy()), "right").astype(np.int32))

    return search(F.col("page_id").isNotNull(), F.coalesce("page_id", F.lit(0).cast("long")), F.col("spot"))


def _record_id(page_id, url, digest) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{digest}')}>"


def _one_line(text: str) -> str:
    return "".join(c for c in text if c not in "\r\n")


def _member(head: list[str], body: bytes) -> bytes:
    """One record as a gzip member of its own."""
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=6, mtime=0, filename="") as z:
        z.write("\r\n".join([*head, f"Content-Length: {len(body)}"]).encode("utf-8", "surrogateescape") + b"\r\n\r\n")
        z.write(body)
        z.write(b"\r\n\r\n")
    return out.getvalue()


def _info(name: str) -> bytes:
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {_record_id('', name, '')}", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"]
    return _member(head, b"software: tallywright\r\nformat: WARC File Format 1.1\r\n")


def _record(page_id, url, payload: bytes, digest: str, refers: tuple | None) -> bytes:
    """A response, or a revisit of refers (page_id, url), which has no payload but its digest and length."""
    kind = "response" if refers is None else "revisit"
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + b"Content-Length: %d\r\n\r\n" % len(payload) + (payload if refers is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_record_id(page_id, url, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(body).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_one_line(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(*refers, digest)}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page-ID: {refers[0]}"]
        if refers[1] is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_one_line(refers[1])}")
    return _member(head, body)


class _Files:
    """The files of one shard: temporary name, roll, rename, and a manifest row for each."""

    def __init__(self, folder: str, shard: int, roll: int):
        self.fs, self.path = pafs.FileSystem.from_uri(folder)
        self.shard, self.roll, self.part, self.out, self.rows = shard, roll, 0, None, []

    def add(self, record: bytes, page_id) -> None:
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.part:05d}.warc.gz"
            self.temporary = f"{self.path}/{TEMPORARY}/{self.name}.{uuid.uuid4().hex}"
            self.out = self.fs.open_output_stream(self.temporary, compression=None)
            self.sha, self.n, self.bytes, self.first = hashlib.sha256(), 0, 0, page_id
            self.put(_info(self.name))
        self.put(record)
        self.n += 1
        self.last = page_id
        if self.bytes >= self.roll:
            self.close()

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.bytes += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temporary, f"{self.path}/{self.name}")
            self.rows.append((self.shard, self.name, self.n, self.bytes, self.sha.hexdigest(), self.first, self.last))
            self.out, self.part = None, self.part + 1


def write_archive(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages (page_id, url, html) below folder and returns the manifest."""
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("spot", F.xxhash64("digest", "url"))
    narrow = stored(rows.select("page_id", "url", "digest", "spot", F.octet_length("payload").cast("long").alias("n")), "digests")
    cuts, size = cut_points(narrow.withColumn("n", F.col("n") + EXTRA))
    big = narrow.where(f"n >= {MIN_REVISIT}")
    known = big.where("page_id is not null").groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"))
    several = big.groupBy("digest").agg(F.count("*").alias("copies")).where("copies > 1").select("digest")
    first = known.join(several, "digest", "left_semi").select("digest", F.col("first.page_id").alias("refers"), F.col("first.url").alias("refers_url"))
    nothing = F.lit(None)
    revisits = big.join(first, "digest").where("page_id is null or page_id <> refers").select("page_id", nothing.cast("string").alias("url"), nothing.cast("binary").alias("payload"), "digest", "spot", "refers", "refers_url").distinct()
    wide = rows.select("page_id", "url", "payload", "digest", "spot", nothing.cast("long").alias("refers"), nothing.cast("string").alias("refers_url"))
    # one shuffle of the payloads: what a page refers to sorts just before the page
    mixed = revisits.unionByName(wide).withColumn("shard", _shard_of(spark, cuts).cast("int")).repartitionById(len(cuts) + 1, F.col("shard"))
    mixed = mixed.sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "spot", F.col("payload").isNotNull(), "digest", F.col("url").asc_nulls_first())
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(f"{path}/{TEMPORARY}", recursive=True)
    roll = max(ROLL, size // 16)

    def run(batches):
        files, refers, current = None, {}, None
        for batch in batches:
            for page_id, url, data, digest, spot, to, to_url, at in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if files is None or files.shard != at:
                    if files:
                        files.close()
                        yield from _rows(files)
                    files, refers, current = _Files(folder, at, roll), {}, None
                if current != (page_id, spot):
                    refers, current = {}, (page_id, spot)
                if data is None:
                    refers[digest] = (to, to_url)
                    continue
                files.add(_record(page_id, url, data, digest, refers.get(digest)), page_id)
            if files and files.rows:
                yield from _rows(files)
        if files:
            files.close()
            yield from _rows(files)

    manifest = mixed.select("page_id", "url", "payload", "digest", "spot", "refers", "refers_url", "shard").mapInArrow(lean(run), MANIFEST)
    manifest.write.parquet(f"{folder}/_manifest.tmp")
    jvm = spark.sparkContext._jvm
    tmp, final = (jvm.org.apache.hadoop.fs.Path(f"{folder}/{x}") for x in ("_manifest.tmp", "_manifest"))
    tmp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(tmp, final)
    fs.delete_dir(f"{path}/{TEMPORARY}")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def _rows(files: _Files):
    if files.rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in files.rows], t) for k, t in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["shard", "file", "records", "bytes", "sha256", "first_id", "last_id"])
        files.rows = []


def _parse(stream, file: str):
    """Rows of one archive file, record after record."""
    with gzip.GzipFile(fileobj=stream) as z:
        while line := z.readline():
            if line.strip() != b"WARC/1.1":
                raise ValueError(f"{file}: not a record: {line[:40]!r}")
            head = {}
            while (line := z.readline()).strip():
                key, _, value = line.rstrip(b"\r\n").partition(b": ")
                head[key.decode()] = value.decode("utf-8", "surrogateescape")
            body = z.read(int(head["Content-Length"]))
            z.read(4)
            if head["WARC-Type"] == "warcinfo":
                continue
            data = body.partition(b"\r\n\r\n")[2]
            digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
            revisit = head["WARC-Type"] == "revisit"
            valid = head["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(body).hexdigest() and (revisit or hashlib.sha256(data).hexdigest() == digest)
            number = lambda k: int(head[k]) if k in head else None
            yield number("X-Page-ID"), head.get("WARC-Target-URI"), number("X-Payload-Length"), digest, head["WARC-Type"], number("X-Refers-To-Page-ID"), file, valid


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the files that the manifest names, streamed; digests are checked (column valid)."""
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_())
    names = [x.split()[0] for x in RECORD.split(", ")]
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    def run(batches):
        fs, path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{path}/{file}", compression=None) as stream:
                    for row in _parse(stream, file):
                        rows.append(row)
                        if len(rows) == 1000:
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)

    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")
    return manifest.select("file").repartition(max(1, min(10_000, manifest.count())), "file").mapInArrow(lean(run), RECORD)


def op10_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "archive")
    write_archive(table(spark, sf_dir, "pages"), folder)
    return read_archive(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, url, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
m AS (SELECT payload_digest, min(page_id) AS first_id FROM h WHERE payload_bytes >= 100 GROUP BY 1)
SELECT h.page_id, payload_bytes, h.payload_digest,
  CASE WHEN first_id IS NOT NULL AND h.page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id IS NOT NULL AND h.page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM h LEFT JOIN m ON m.payload_digest = h.payload_digest
"""
