"""Benchmark decontamination by latent semantic retrieval.

Passages of the benchmark (CELL words) are weighted by TF-IDF, with document frequencies counted over all documents, and a
distributed randomised SVD gives their latent space: its right singular vectors are found by sketching A'A with random
vectors, summed over partitions. Its rank is the least at which every passage keeps KEPT of its squared norm, so that passages
that say the same share dimensions and none is lost; blocks are cut so that they have some PASSAGES. Windows of 2 * CELL words at every CELL words of each whole document are folded in; a
window whose cosine to a benchmark passage is at least COSINE is a candidate; its norm is that of its words that the benchmark
has, so that rare words around an item don't hide it. Fold-in and cosine are linear in a window's
words, so each word's cosines to all passages are kept as one sparse row. The longest common subsequence of
the item's and the window's surroundings' words, as a share of the item's, then decides: VERBATIM or more is a leak, and
PARAPHRASE or more is one if the item's answer is there too. The answer is the column `answer`, else the item's rarest words.

Null or empty texts and items without words match nothing. Repeated items or documents give a finding each. A document
found by several windows gives an item's best one; ties go to the first. An empty benchmark or table gives no finding.
An item of more than LONG words is taken in pieces of so many, each with a finding of its own; documents of any length are read
whole. Other columns of both tables are ignored by contaminated and kept by without_leaks, whatever their names and types.
The benchmark is a stated query set: PASS blocks are handled in a pass over the documents. An item's passages are in one block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.shared import lean, stored, table, tidy, word_hashes

CELL = 16
FEATURE_BITS = 18
PASSAGES = 1024  # of a block, about
PASS = 16  # blocks in a pass over the documents
LONG = 4096  # words of an item's piece
KEPT = 0.9
SPARE = 16  # random vectors above the rank
COSINE = 0.15
TINY = 0.02  # a word's least cosine that is kept; the threshold of a window is lower by what its words may have lost
POWER = 2  # of the logarithm of the inverse document frequency in a weight
VERBATIM = 0.75
PARAPHRASE = 0.5
ANSWER = 0.6  # share of the answer's words
RAREST = 6  # words of an item that stand for a missing answer
_D = 1 << FEATURE_BITS


def _features(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def _frequencies(batches):
    """Documents of a task for each feature, as rows (part, counts)."""
    total, n = np.zeros(_D, np.int32), 0
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            words, at = word_hashes(batch.column(0).slice(a, 500), letters=True)
            n += len(at) - 1
            doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
            total += np.bincount(np.unique(doc << FEATURE_BITS | _features(words)) & (_D - 1), minlength=_D).astype(np.int32)
    if n:
        parts = np.split(total, 16)
        yield pa.RecordBatch.from_arrays([pa.array(range(17), pa.int32()), pa.array([x.tobytes() for x in parts] + [np.array([n], np.int32).tobytes()], pa.binary())], names=["part", "counts"])


def _sum_blobs(kind):
    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(blob, kind).astype(np.int64 if kind == np.int32 else np.float64)
                held[part] = held[part] + x if part in held else x
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["part", "counts"])

    return run


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """log((documents + 1) / (documents with the feature + 1)) ** POWER of every feature: a table of fixed size."""
    sums = docs.select("text").mapInArrow(lean(_frequencies), "part int, counts binary").repartition(17, "part").mapInArrow(lean(_sum_blobs(np.int32)), "part int, counts binary").collect()
    found = {r["part"]: np.frombuffer(r["counts"], np.int64) for r in sums}
    if not found:
        return np.zeros(_D, np.float32)
    return (np.log((found[16][0] + 1.0) / (np.concatenate([found[k] for k in range(16)]) + 1.0)) ** POWER).astype(np.float32)


def _passages(words: np.ndarray) -> list[np.ndarray]:
    if len(words) <= CELL:
        return [words] if len(words) else []
    starts = [*range(0, len(words) - CELL, CELL), len(words) - CELL]
    return [words[s : s + CELL] for s in starts]


def _passage_counts(batches):
    for batch in batches:
        _, at = word_hashes(batch.column(0), letters=True)
        n = int(np.maximum(-(-np.diff(at) // CELL), 0).sum())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])


def learn_space(items: DataFrame, idf: np.ndarray) -> dict | None:
    """The latent space of the benchmark's passages by a distributed randomised SVD, and the items in it."""
    has_answer = "answer" in items.columns
    rows = items.select("item_id", "text", F.col("answer").cast("string").alias("answer") if has_answer else F.lit(None).cast("string").alias("answer"))
    rows = stored(rows, "items").repartition(4)
    local = rows.toArrow()  # items of some PASSAGES passages
    words, at = word_hashes(local.column("text").combine_chunks(), letters=True)
    texts = [words[a:b] for a, b in zip(at, at[1:], strict=False)]
    answers, at = word_hashes(local.column("answer").combine_chunks(), letters=True)
    answers = [answers[a:b] for a, b in zip(at, at[1:], strict=False)]
    if not len(words):
        return None
    vocabulary = np.unique(_features(words))
    weight = idf[vocabulary].astype(np.float64)
    count = len({p.tobytes() for t in texts for p in _passages(t)})
    width = min(len(vocabulary), count + SPARE)

    def matrices(column):
        """The passages of some items as rows, a few hundred at a time."""
        hashed, at = word_hashes(column, letters=True)
        passages = [p for a, b in zip(at, at[1:], strict=False) for p in _passages(hashed[a:b])]
        for a in range(0, len(passages), 256):
            out = np.zeros((min(256, len(passages) - a), len(vocabulary)), np.float32)
            for row, p in zip(out, passages[a:], strict=False):
                place = np.searchsorted(vocabulary, _features(p))
                np.add.at(row, place, weight[place])
            yield out

    def squared(basis):
        """A'A times basis, summed over the partitions of A."""
        basis = basis.astype(np.float32)

        def run(batches):
            total = 0
            for batch in batches:
                for a in range(0, batch.num_rows, 200):
                    for x in matrices(batch.column(0).slice(a, 200)):
                        total = total + x.T @ (x @ basis)
            if not isinstance(total, int):
                cut = max(1, (1 << 20) // (8 * basis.shape[1]))
                blocks = range(0, len(total), cut)
                yield pa.RecordBatch.from_arrays([pa.array([a // cut for a in blocks], pa.int32()), pa.array([total[a : a + cut].astype(np.float32).tobytes() for a in blocks], pa.binary())], names=["part", "counts"])

        parts = rows.select("text").mapInArrow(lean(run), "part int, counts binary").repartition(4, "part").mapInArrow(lean(_sum_blobs(np.float32)), "part int, counts binary").collect()
        return np.concatenate([np.frombuffer(r["counts"], np.float64) for r in sorted(parts, key=lambda r: r["part"])]).reshape(-1, basis.shape[1])

    basis = np.random.default_rng(11).standard_normal((len(vocabulary), width))
    basis, _ = np.linalg.qr(squared(basis))
    tidy(items.sparkSession)  # what was sent and summed up is as large as the matrices, on both sides
    core = basis.T @ squared(basis)
    _, turn = np.linalg.eigh((core + core.T) / 2)
    space = basis @ turn[:, ::-1]
    where, latent, norms = [], [], []
    for k, t in enumerate(texts):
        for p in _passages(t):
            place = np.searchsorted(vocabulary, _features(p))
            v = weight[place] @ space[place]
            if np.linalg.norm(v) > 0:
                _, times = np.unique(place, return_inverse=True)
                where.append(k)
                latent.append(v)
                norms.append(np.square(np.bincount(times, weight[place])).sum())
    if not where:
        return None
    latent = np.array(latent)
    energy = np.cumsum(latent**2, axis=1)
    enough = (energy >= KEPT * np.minimum(np.array(norms), energy[:, -1])[:, None]).all(0)
    rank = 1 + int(np.argmax(enough))
    space, latent = space[:, :rank], latent[:, :rank]
    latent /= np.linalg.norm(latent, axis=1, keepdims=True)
    if not has_answer:
        answers = [np.unique(t)[np.argsort(-idf[_features(np.unique(t))], kind="stable")[:RAREST]] for t in texts]
    near = space @ latent.T
    row, passage = np.nonzero(np.abs(near) >= TINY)
    lost = np.where(np.abs(near) < TINY, near, 0).max(1)
    return {"ids": local.column("item_id").to_pylist(), "texts": texts, "answers": answers, "where": np.array(where), "feature": vocabulary[row], "passage": passage, "value": near[row, passage].astype(np.float32), "vocabulary": vocabulary, "lost": lost}


def _merged(models: list[dict], idf: np.ndarray) -> dict:
    """Blocks as one model, with the rows (passage, value) of each feature from first[feature] on."""
    items = np.cumsum([0] + [len(m["ids"]) for m in models])
    passages = np.cumsum([0] + [len(m["where"]) for m in models])
    feature = np.concatenate([m["feature"] for m in models])
    order = np.argsort(feature, kind="stable")
    passage = np.concatenate([m["passage"] + k for m, k in zip(models, passages, strict=False)])[order]
    value = np.concatenate([m["value"] for m in models])[order]
    where = np.concatenate([m["where"] + k for m, k in zip(models, items, strict=False)])
    rows = np.bincount(feature, minlength=_D)
    lost, known = np.zeros(_D), np.zeros(_D, bool)
    for m in models:
        known[m["vocabulary"]] = True
        np.maximum.at(lost, m["vocabulary"], m["lost"])
    return {key: [x for m in models for x in m[key]] for key in ("ids", "texts", "answers")} | {"where": where, "passage": passage, "value": value, "rows": rows, "first": np.cumsum(rows) - rows, "idf": idf, "known": known, "lost": lost}


def common_subsequence(item: np.ndarray, region: np.ndarray) -> int:
    """Length of the longest common subsequence, with the item's positions as bits."""
    places: dict[int, int] = {}
    for k, w in enumerate(item.tolist()):
        places[w] = places.get(w, 0) | 1 << k
    state = full = (1 << len(item)) - 1
    for w in region.tolist():
        match = places.get(w)
        if match:
            kept = state & match
            state = ((state + kept) | (state - kept)) & full
    return len(item) - state.bit_count()


def _candidates(model: dict, words: np.ndarray, at: np.ndarray):
    """Arrays (document, first word, item, cosine) of the windows near a benchmark passage, an item's first in each window."""
    feature = _features(words)
    weight = model["idf"][feature]
    rows = model["rows"][feature]
    counts = -(-np.diff(at) // CELL)
    if not counts.sum():
        return
    doc = np.repeat(np.arange(len(counts)), counts)
    starts = np.repeat(at[:-1] - CELL * (np.cumsum(counts) - counts), counts) + CELL * np.arange(len(doc))
    after = doc[1:] == doc[:-1]

    def window_sums(x):
        sums = np.add.reduceat(x, starts)
        sums[:-1] += np.where(after, sums[1:], 0)
        return sums

    known = window_sums(np.where(model["known"][feature], weight * weight, 0))
    lost = window_sums(weight * model["lost"][feature])
    ends = np.minimum(starts + 2 * CELL, at[doc + 1])
    near = np.flatnonzero(known > 0)
    passages = len(model["where"])
    step = max(1, min(256, (1 << 20) // passages))
    for a in range(0, len(near), step):
        some = near[a : a + step]
        sizes = ends[some] - starts[some]
        tokens = np.repeat(starts[some] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        n = rows[tokens]
        place = np.repeat(model["first"][feature[tokens]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        cell = np.repeat(np.repeat(np.arange(len(some)) * passages, sizes), n) + model["passage"][place]
        cosine = np.bincount(cell, np.repeat(weight[tokens], n) * model["value"][place], len(some) * passages).reshape(-1, passages)
        norm = np.sqrt(known[some])
        hit = np.flatnonzero(cosine >= (COSINE * norm - lost[some])[:, None])
        w, q = np.divmod(hit, passages)
        item = model["where"][q]
        _, first = np.unique(w * len(model["texts"]) + item, return_index=True)
        first.sort()
        w, q = w[first], q[first]
        yield doc[some[w]], starts[some[w]], item[first], cosine[w, q] / norm[w]


def find(model: dict, column: pa.Array):
    """(row, item, cosine, lcs, answer) of the leaks in a column of texts."""
    words, at = word_hashes(column, letters=True)
    best: dict[tuple[int, int], tuple] = {}
    least = min(VERBATIM, PARAPHRASE)
    if "sizes" not in model:  # once in a worker
        model["distinct"] = [frozenset(t.tolist()) for t in model["texts"]]
        model["sizes"] = np.array([len(t) for t in model["texts"]])
        # a subsequence of enough words holds at least so many distinct ones
        model["some"] = least * model["sizes"] - (model["sizes"] - np.array([len(d) for d in model["distinct"]]))
    # only words that the benchmark has can match
    known = model["known"][_features(words)]
    before = np.concatenate([[0], np.cumsum(known)])
    words_known = words[known]

    def near():
        for doc, start, item, cosine in _candidates(model, words, at):
            sizes = model["sizes"][item]
            low = np.maximum(at[doc], start - sizes)
            high = np.minimum(at[doc + 1], start + 2 * CELL + sizes)
            enough = before[high] - before[low] >= model["some"][item]
            yield from zip(*(x[enough].tolist() for x in (doc, item, cosine, low, high, before[low], before[high])), strict=True)

    for doc, item, cosine, low, high, a, b in near():
        text = model["texts"][item]
        region = words_known[a:b]
        if len(model["distinct"][item].intersection(region.tolist())) < model["some"][item]:
            continue
        lcs = common_subsequence(text, region) / len(text)
        if lcs < least:
            continue
        answer = float(np.isin(model["answers"][item], words[low:high]).mean()) if len(model["answers"][item]) else 0.0
        if (lcs >= VERBATIM or lcs >= PARAPHRASE and answer >= ANSWER) and (doc, item) not in best or best.get((doc, item), (9,))[0] < lcs:
            best[doc, item] = lcs, cosine, answer
    for (doc, item), (lcs, cosine, answer) in sorted(best.items()):
        yield doc, model["ids"][item], cosine, lcs, answer


def _pieces(items: DataFrame) -> DataFrame:
    """(item_id, text[, answer]) with items of more than LONG words cut into pieces."""
    words = F.split(F.col("text").cast("string"), r"\s+")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / LONG).cast("int")), lambda k: F.array_join(F.slice(words, k * LONG + 1, LONG), " "))
    answer = [F.col("answer").cast("string").alias("answer")] if "answer" in items.columns else []
    return items.select(F.col("item_id").cast("long").alias("item_id"), F.explode_outer(cut).alias("text"), *answer)


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer) of the benchmark items that documents hold."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, cosine double, lcs double, answer double"
    items = _pieces(items)
    idf = inverse_frequencies(docs)
    total = items.select("text").mapInArrow(lean(_passage_counts), "n long").agg(F.sum("n")).first()[0] or 0
    blocks = -(-total // PASSAGES)
    out = None
    for k in range(0, blocks, PASS):
        parts = [items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == j) for j in range(k, min(k + PASS, blocks))]
        models = [m for m in (learn_space(p, idf) for p in parts) if m is not None]
        if not models:
            continue
        sent = spark.sparkContext.broadcast(_merged(models, idf))  # words of PASS blocks and a few numbers for each
        del models
        tidy(spark)  # the scan is long

        def run(batches, sent=sent):
            for batch in batches:
                for a in range(0, batch.num_rows, 500):
                    ids = batch.column(0).slice(a, 500).to_pylist()
                    rows = [(ids[r], *rest) for r, *rest in find(sent.value, batch.column(1).slice(a, 500))]
                    types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names=["doc_id", "item_id", "cosine", "lcs", "answer"])

        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the documents that hold a benchmark item; a row without an id goes only if one without id holds one."""
    found = stored(contaminated(docs, items).select(F.col("doc_id").alias("__id")).distinct(), "leaks")
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti")


def op1_latent_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
