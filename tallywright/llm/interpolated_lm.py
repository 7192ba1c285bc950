"""Language-model scores by deleted interpolation of word bigrams, unigrams and a uniform floor.

P(w | h) = a(h) c(h, w) / c(h) + b(h) c(w) / N + (1 - a(h) - b(h)) / (V + 1); the weights depend on the bucket of c(h), the
power of two of the context's frequency, and are learned by expectation-maximisation on the counts of part of the training
documents (HELD of FOLDS) under those of the others. Every word is a context and every pair is counted; nothing is cut off.

Tokens never travel one by one. A batch of documents counts its own words and pairs and sends each bucket of n-grams one
packed, sorted list of hashes and counts, so that a frequent word or pair is one entry a batch and no key is hot. A bucket adds
the lists up and returns what other batches add to each count, in the order in which they came; the batch, which kept its tokens
as indices into its list, then has c(w), c(h, w) and c(h) of each token. A batch is bounded by BATCH tokens (or one text), a bucket by BUCKET
bytes of text, the driver by the cells of a histogram of logarithms in steps of STEP, each with its exact means.

Null texts are empty: one token, the end. A null id hashes as empty text. Repeated rows count and are scored each. Without
training documents N = V = 0 and every score is 0. An empty table gives an empty result. Other columns are not returned,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.shared import discard, id_bucket, lean, mix, stored, table, word_hashes

FOLDS, TEST, HELD = 7, 2, 3
BATCH = 1_500_000  # tokens of a batch
BUCKET = 16 << 20  # bytes of text whose n-grams a bucket holds
LEVELS = 48  # of context frequency, by powers of two; 0: never seen
STEP = 0.125  # of the logarithms that cells of the histogram have in common
STEPS = 80  # of expectation-maximisation
END = np.uint64(0)  # also the context of a text's first word; words never have it
_PAIR = np.uint64(1)  # low bit of a pair's hash, clear in a word's
ROWS = "batch long, bucket int, n int, data binary, first long, held long, distinct long"
CELLS = "cell long, n long, two double, one double"


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts with END after each, and the texts' offsets."""
    words, at = word_hashes(column)
    words = words & ~_PAIR
    words[words == END] = np.uint64(2)
    return np.insert(words, at[1:], END), at + np.arange(len(at))


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of one length, by byte planes, compressed."""
    return pa.compress(b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns), codec="zstd", asbytes=True)


def _unpacked(blob: bytes, n: int, *types) -> list[np.ndarray]:
    sizes = [np.dtype(t).itemsize * n for t in types]
    raw = np.frombuffer(pa.decompress(blob, sum(sizes), codec="zstd"), np.uint8)
    out, at = [], 0
    for t, size in zip(types, sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + size].reshape(-1, n).T).view(t).reshape(n))
        at += size
    return out


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[x.split()[0] for x in ROWS.split(", ")])


def _ngrams(words: np.ndarray, at: np.ndarray, lengths: np.ndarray):
    """Of a batch with distinct words and tokens as indices into them: each token's context and pair, the hashes of all
    words and pairs, and their order by hash."""
    context = np.empty(len(at), np.int64)
    context[1:] = at[:-1]
    ends = np.cumsum(lengths)
    context[ends - lengths] = at[ends - 1]  # the end stands before the first word
    pairs, pair = np.unique(context << 32 | at, return_inverse=True)
    one, two = words[pairs >> 32], words[pairs & 0xFFFFFFFF]
    keys = np.concatenate([words, mix(mix(one ^ np.uint64(0x9E3779B97F4A7C15)) + two) | _PAIR])
    return context, pair, keys, np.argsort(keys, kind="stable")


def _own(at: np.ndarray, pair: np.ndarray, of_words: int, of_pairs: int, chosen: np.ndarray) -> np.ndarray:
    """A batch's own counts of its words and pairs over the chosen tokens."""
    return np.concatenate([np.bincount(x[chosen], minlength=n) for x, n in ((at, of_words), (pair, of_pairs))])


def _pack(buckets: int):
    """Rows (batch, bucket, n, data, ...): bucket `buckets` has a batch's documents and tokens, the others its n-grams."""

    def run(batches):
        base, turn, held, size = TaskContext.get().partitionId() << 24, 0, [], 0

        def out():
            nonlocal turn
            tokens = np.concatenate([h[0] for h in held])
            lengths = np.concatenate([np.diff(h[1]) for h in held])
            fold = np.concatenate([h[2] for h in held])
            ids = pa.concat_arrays([h[3] for h in held])
            held.clear()
            words, at, n = np.unique(tokens, return_inverse=True, return_counts=True)
            often = np.argsort(-n, kind="stable")  # frequent words get small indices, which compress
            place = np.empty(len(words), np.int64)
            place[often] = np.arange(len(words))
            words, at = words[often], place[at]
            context, pair, keys, order = _ngrams(words, at, lengths)
            mark = np.repeat(fold, lengths)
            counts = [_own(at, pair, len(words), len(keys) - len(words), mark == k).astype(np.uint32)[order] for k in (0, 1)]
            keys = keys[order]
            batch_id = base + turn
            turn += 1
            which = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(which, prepend=-1))
            rows = []
            for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                rows.append((batch_id, int(which[a]), int(b - a), _packed(np.diff(keys[a:b], prepend=np.uint64(0)), counts[0][a:b], counts[1][a:b]), 0, 0, 0))
                if len(rows) == 64:
                    yield _rows(rows)
                    rows = []
            head = pa.BufferOutputStream()
            fields = {"ids": ids, "fold": pa.array(fold.astype(np.int8)), "lengths": pa.array(lengths)}
            with pa.ipc.new_stream(head, pa.schema([(k, v.type) for k, v in fields.items()])) as w:
                w.write_batch(pa.RecordBatch.from_arrays(list(fields.values()), names=list(fields)))
            data = [head.getvalue().to_pybytes(), _packed(words), _packed(at.astype(np.uint32))]
            sizes = np.array([len(data[0]), len(data[1]), len(words)], np.int64).tobytes()
            yield _rows([*rows, (batch_id, buckets, len(at), sizes + b"".join(data), 0, 0, 0)])

        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                piece = batch.slice(a, 500)
                words, at = _tokens(piece.column(1))
                rest = piece.column(2).to_numpy(zero_copy_only=False)
                held.append((words, at, np.where(rest == TEST, 2, np.where(rest == HELD, 1, 0)), piece.column(0)))
                size += len(words)
                if size >= BATCH:
                    yield from out()
                    size = 0
        if held:
            yield from out()

    return run


def _add(buckets: int):
    """Of each bucket, held whole: what the others add to the counts of each batch that sent some, and a row of sums over
    words. Documents and tokens pass, as bucket -1."""

    def out(rows):
        parts = [_unpacked(r[3], r[2], np.uint64, np.uint32, np.uint32) for r in rows]
        keys, where = np.unique(np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]), return_inverse=True)
        totals = [np.bincount(where, np.concatenate([p[k] for p in parts]), len(keys)).astype(np.uint64) for k in (1, 2)]
        word = keys & _PAIR == 0
        yield _rows([(-1, rows[0][1], 0, b"", *(int(t[word].sum()) for t in totals), int(np.count_nonzero((totals[0] + totals[1])[word])))])
        at = 0
        for r, p in zip(rows, parts, strict=True):
            own = where[at : at + r[2]]
            at += r[2]
            yield _rows([(r[0], r[1], r[2], _packed(totals[0][own] - p[1], totals[1][own] - p[2]), 0, 0, 0)])

    def run(batches):
        rows: list[tuple] = []
        for batch in batches:
            for a in range(batch.num_rows):
                r = tuple(batch.column(k)[a].as_py() for k in range(4))
                if r[1] == buckets:
                    yield _rows([(r[0], -1, r[2], r[3], 0, 0, 0)])
                    continue
                if rows and rows[0][1] != r[1]:
                    yield from out(rows)
                    rows.clear()
                rows.append(r)
        if rows:
            yield from out(rows)

    return run


def _counted(batches, folds: tuple[int, ...], of: tuple[int, ...]):
    """Of each batch: ids, folds and lengths of its documents, which tokens are of the folds `of`, and of these c(w), c(h, w)
    and c(h) in the documents of folds."""
    head, parts = None, []

    def out():
        a, b, words = np.frombuffer(head[1][:24], np.int64)
        fields = pa.ipc.open_stream(head[1][24 : 24 + a]).read_all()
        (words,) = _unpacked(head[1][24 + a : 24 + a + b], int(words), np.uint64)
        (at,) = _unpacked(head[1][24 + a + b :], head[0], np.uint32)
        at, lengths = at.astype(np.int64), fields.column("lengths").to_numpy()
        context, pair, keys, order = _ngrams(words, at, lengths)
        n, size = len(words), len(keys)
        del words, keys
        mark = np.repeat(fields.column("fold").to_numpy(), lengths)
        counts = np.empty(size)
        counts[order] = np.concatenate([sum(p[k] for k in folds) for p in parts])
        counts += _own(at, pair, n, size - n, np.isin(mark, folds))
        del order
        parts.clear()
        chosen = np.isin(mark, of)
        return fields, lengths, chosen, counts[at[chosen]], counts[n + pair[chosen]], counts[context[chosen]]

    for batch in batches:
        for a in range(batch.num_rows):
            bucket, n, data = (batch.column(k)[a].as_py() for k in (1, 2, 3))
            if bucket == -1:
                if head is not None:
                    yield out()
                head, parts = (n, data), []
            else:
                parts.append(_unpacked(data, n, np.uint64, np.uint64))
    if head is not None:
        yield out()


def level(counts: np.ndarray) -> np.ndarray:
    """Bucket of context frequencies: 0 for 0, then by powers of two."""
    return np.where(counts > 0, 1 + np.floor(np.log2(np.maximum(counts, 1))), 0).astype(np.int64).clip(0, LEVELS - 1)


def _terms(c_w, c_hw, c_h, total):
    return np.where(c_h > 0, c_hw / np.maximum(c_h, 1), 0.0), c_w / max(total, 1)


def _histogram(first: int):
    """Held-out tokens by level and by the logarithms of both estimates; with each cell the sums of these."""

    def run(batches):
        cells: dict[int, np.ndarray] = {}
        for _, _, _, c_w, c_hw, c_h in _counted(batches, (0,), (1,)):
            two, one = _terms(c_w, c_hw, c_h, first)
            bins = [np.where(x > 0, 1 + 1000 + np.round(np.log(np.maximum(x, 1e-50)) / STEP), 0).astype(np.int64) for x in (two, one)]
            found, where = np.unique(level(c_h) << 20 | bins[0] << 10 | bins[1], return_inverse=True)
            sums = np.stack([np.bincount(where, x, len(found)) for x in (None, two, one)], axis=1)
            for key, x in zip(found.tolist(), sums, strict=True):
                cells[key] = cells[key] + x if key in cells else x
        x = np.array(list(cells.values())).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([pa.array(list(cells), pa.int64()), pa.array(x[:, 0].astype(np.int64)), pa.array(x[:, 1]), pa.array(x[:, 2])], names=["cell", "n", "two", "one"])

    return run


def learn_weights(levels: np.ndarray, n: np.ndarray, two: np.ndarray, one: np.ndarray, floor: float) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each level by expectation-maximisation; n tokens have estimates two and one.
    A level without held-out tokens takes those of the nearest lower one that has some."""
    weights = np.tile([0.4, 0.4, 0.2], (LEVELS, 1))
    weights[0] = [0.0, 0.8, 0.2]
    terms = np.stack([two, one, np.full(len(n), floor)], axis=1)
    for _ in range(STEPS):
        part = weights[levels] * terms
        part *= (n / np.maximum(part.sum(1), 1e-300))[:, None]
        for k in np.unique(levels):
            total = part[levels == k].sum(0) + [0.0 if k == 0 else 0.01, 0.01, 0.01]
            weights[k] = total / total.sum()
    have = set(np.unique(levels).tolist())
    for k in range(2, LEVELS):
        if k not in have and (have - {0}):
            weights[k] = weights[max((j for j in have if 0 < j < k), default=min(have - {0}))]
    return weights


def _score(weights: np.ndarray, total: int, distinct: int):
    def run(batches):
        floor = 1.0 / (distinct + 1)
        for fields, lengths, _, c_w, c_hw, c_h in _counted(batches, (0, 1), (0, 1, 2)):
            two, one = _terms(c_w, c_hw, c_h, total)
            w = weights[level(c_h)]
            doc = np.repeat(np.arange(len(lengths)), lengths)
            if total:
                score = np.log10(w[:, 0] * two + w[:, 1] * one + w[:, 2] * floor)
                base = np.log10((c_w + 1) / (total + distinct + 1))
            else:
                score = base = np.zeros(len(doc))
            known, base, score = (np.bincount(doc, x, len(lengths)) for x in (c_w > 0, base, score))
            yield pa.RecordBatch.from_arrays(
                [fields.column("ids").combine_chunks(), pa.array(fields.column("fold").to_numpy() == 2), pa.array(lengths), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
            )

    return run


def counted_batches(docs: DataFrame) -> tuple[DataFrame, tuple[int, int, int]]:
    """The batches with their tokens and the totals of their n-grams, a stored table, and (tokens of the first part of the
    training documents, of the held-out part, distinct words of both)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), id_bucket("doc_id", FOLDS).cast("int").alias("fold"))
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    buckets = max(1, -(-size // BUCKET))
    # documents and tokens take the buckets' shuffle too, one after another by batch
    packed = rows.mapInArrow(lean(_pack(buckets)), ROWS).withColumn("part", F.when(F.col("bucket") < buckets, F.col("bucket")).otherwise(F.pmod("batch", F.lit(buckets)).cast("int")))
    packed = packed.repartitionById(buckets, F.col("part")).sortWithinPartitions("bucket").drop("part")
    added = stored(packed.mapInArrow(lean(_add(buckets)), ROWS), "totals")
    sums = added.where("batch = -1").agg(F.sum("first"), F.sum("held"), F.sum("distinct")).first()
    both = added.where("batch >= 0").repartition("batch").sortWithinPartitions("batch", "bucket")
    whole = stored(both, "batches", whole_files=True)  # so that a task reads all of a batch
    discard(added)
    return whole, tuple(x or 0 for x in sums)


def score_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of rows (doc_id, text)."""
    batches, (first, held, distinct) = counted_batches(docs)
    cells = batches.mapInArrow(lean(_histogram(first)), CELLS).groupBy("cell").agg(F.sum("n").alias("n"), F.sum("two").alias("two"), F.sum("one").alias("one")).toArrow()
    cell, n, two, one = (cells.column(k).to_numpy() for k in range(4))
    weights = learn_weights(cell >> 20, n, two / n, one / n, 1.0 / (distinct + 1))
    out = batches.mapInArrow(lean(_score(weights, first + held, distinct)), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(first + held).cast("long").alias("train_tokens"), "base_score", "score")


def op3_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
