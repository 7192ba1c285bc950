"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter has one row of bits for each hash position and one bit for each language in a row; the AND of
the rows that an n-gram hashes to is the set of all languages that contain it. A text's count for a language is the
number of its n-grams with that bit set, corrected for the filter's rate of false positives; the largest count decides.

The filter holds the n-grams whose share of their language's is SHARE or more, which are at most 1 / SHARE for each size and
language; where these cover less than COVER of a language's text, as in scripts of many letters, it holds rarer ones too,
until they do or are MOST. Rarer ones than needed make results worse, as texts of a language quote others: on the 0.1 GB
table 99.3% of the held-out quarter are right with this share, 98.7% with 1e-6 and 95.0% with all n-grams. The filter has
eight rows or more for each n-gram, up to MOST_ROWS. A text is read in pieces of PIECE characters, whose n-grams run on across
their borders, so that long texts without spaces lose none.

Nulls, empty texts and texts without a letter: `und`, score 0. Ties: the language that sorts first. Texts with null
language teach nothing. Nothing learned: `und` for all. Repeated rows are predicted alike; other columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tallywright.llm.shared import id_bucket, lean, mix, stored, table

SIZES = (3, 4)  # letters in an n-gram; a space stands for either end of a word
SHARE = 2e-5
COVER = 0.9  # of a language's n-grams, by occurrences
MOST = 1_000_000  # n-grams of a language below SHARE
FINE = 4  # steps of n-gram counts to a power of two
LEAST_ROWS, MOST_ROWS = 1 << 16, 1 << 24
HASHES = 3
PIECE = 1 << 18  # characters at once
ROWS_AT_ONCE = 200  # texts whose n-grams are held together
UNDETERMINED = "und"
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def ngrams(text: str):
    """Hashes of the n-grams of a text's words, piece by piece; the whole text is read."""
    letter = _letters()
    tail = np.array([32], np.uint64)  # the last characters so far; a space before the first word
    for at in range(0, len(text), PIECE):
        code = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        known = letter[code]
        keep = known.copy()
        keep[1:] |= known[:-1]  # a run of other characters becomes one space
        keep[0] |= tail[-1] != 32
        code = np.where(known, code, 32)[keep].astype(np.uint64)
        if at + PIECE >= len(text) and (len(code) and code[-1] != 32 or not len(code) and tail[-1] != 32):
            code = np.append(code, np.uint64(32))
        for n in SIZES:
            run = np.concatenate([tail[-(n - 1) :], code])
            size = len(run) - n + 1
            if size <= 0:
                continue
            gap = run == 32
            hashed = np.zeros(size, np.uint64)
            ok = np.ones(size, bool)
            for k in range(n):
                hashed = hashed * np.uint64(0x100000001B3) + run[k : k + size]
                if 0 < k < n - 1:
                    ok &= ~gap[k : k + size]
            yield mix(hashed[ok] ^ np.uint64(n))
        tail = np.concatenate([tail, code])[-(max(SIZES) - 1) :]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, where = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(where, weights=np.concatenate([n for _, n in parts]), minlength=len(grams)).astype(np.int64)


def _count(batches):
    """(lang, gram, n) of the rows of a task; written out whenever a million n-grams have gathered."""
    held: dict[str, list] = {}
    size: dict[str, int] = {}

    def out(lang):
        grams, n = _merged(held.pop(lang))
        size.pop(lang)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    for batch in batches:
        for a in range(0, batch.num_rows, ROWS_AT_ONCE):
            piece = batch.slice(a, ROWS_AT_ONCE)
            fresh: dict[str, list] = {}
            for lang, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                for grams in ngrams(text):
                    fresh.setdefault(lang, []).append(grams)
            for lang, grams in fresh.items():
                found, n = np.unique(np.concatenate(grams), return_counts=True)
                held.setdefault(lang, []).append((found, n))
                size[lang] = size.get(lang, 0) + len(found)
                if size[lang] > 1_000_000:
                    held[lang] = [_merged(held[lang])]
                    size[lang] = len(held[lang][0][0])
                    if size[lang] > 500_000:
                        yield out(lang)
    for lang in list(held):
        yield out(lang)


def _least(steps: list[tuple[int, int, int]]) -> float:
    """The count from which a language's n-grams are kept, from (step, occurrences, n-grams) of all its counts."""
    total = sum(n for _, n, _ in steps)
    least, held, grams = SHARE * total, 0, 0
    for step, n, some in sorted(steps, reverse=True):
        if held >= COVER * total or grams + some > max(MOST, 1 / SHARE):
            break
        held, grams = held + n, grams + some
        least = min(least, 2 ** (step / FINE))
    return least


def learn(rows: DataFrame) -> dict:
    """The filter from rows (lang, text). All rows count; the driver gets at most MOST n-grams a language."""
    counts = rows.where("lang is not null and text is not null").select("lang", "text").mapInArrow(lean(_count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = stored(counts, "grams")
    step = F.floor(F.log2(F.col("n")) * FINE).cast("int")
    steps = counts.groupBy("lang", step.alias("step")).agg(F.sum("n").alias("n"), F.count("*").alias("grams")).collect()  # some 150 rows for each language
    found = sorted({r["lang"] for r in steps})
    least = [_least([(r["step"], r["n"], r["grams"]) for r in steps if r["lang"] == lang]) for lang in found]
    limits = rows.sparkSession.createDataFrame(pa.table({"lang": pa.array(found, pa.string()), "least": pa.array(least, pa.float64())}))  # one row for each language
    kept = counts.join(F.broadcast(limits), "lang").where("n >= least").select("lang", "gram").toArrow()
    names = kept.column("lang").combine_chunks().dictionary_encode()
    names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
    grams = kept.column("gram").to_numpy().view(np.uint64)
    found = names.dictionary.to_pylist()
    langs = sorted(found)
    size = LEAST_ROWS
    while size < min(MOST_ROWS, 8 * len(np.unique(grams))):
        size *= 2
    filters = np.zeros((size, max(1, -(-len(langs) // 64))), np.uint64)
    which = np.array([langs.index(x) for x in found], np.int64)[names.indices.to_numpy()] if found else np.zeros(0, np.int64)
    rate = np.zeros(len(langs))
    for k in range(len(langs)):
        bit = np.uint64(1) << np.uint64(k % 64)
        for at in _positions(grams[which == k], size):
            filters[at, k // 64] |= bit
        rate[k] = ((filters[:, k // 64] & bit) > 0).mean() ** HASHES
    return {"langs": langs, "filters": filters, "rate": rate}


def _positions(grams: np.ndarray, size: int):
    step = (grams >> np.uint64(32)) | np.uint64(1)
    for k in range(HASHES):
        yield ((grams + np.uint64(k) * step) % np.uint64(size)).astype(np.int64)


def decide(model: dict, text: str | None) -> tuple[str, float]:
    """The language of one text and the share of its n-grams which that language's filter holds, 0 to 1."""
    count = np.zeros(len(model["langs"]))
    n = 0
    for grams in ngrams(text or ""):
        rows = None
        for at in _positions(grams, len(model["filters"])):
            rows = model["filters"][at] if rows is None else rows & model["filters"][at]
        n += len(grams)
        for k in range(len(count)):
            count[k] += np.count_nonzero(rows[:, k // 64] & (np.uint64(1) << np.uint64(k % 64)))
    if not n or not len(count):
        return UNDETERMINED, 0.0
    share = (count / n - model["rate"]) / (1 - model["rate"])
    best = int(np.argmax(share))
    return model["langs"][best], float(min(1.0, max(0.0, share[best])))


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """docs with lang_pred and score; columns of these names are replaced."""
    docs = docs.drop("lang_pred", "score")
    place = docs.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_ROWS * 8 bytes for each 64 languages

    def run(batches):
        pieces = (batch.slice(a, ROWS_AT_ONCE) for batch in batches for a in range(0, batch.num_rows, ROWS_AT_ONCE))
        for batch in pieces:
            found = [decide(sent.value, t) for t in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(lean(run), StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text").withColumn("held_out", id_bucket("doc_id", 4) == 2)
    model = learn(docs.where("not held_out"))
    return predict(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")
