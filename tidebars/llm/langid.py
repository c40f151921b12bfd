"""Language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLOCKS, array_blocks, free_name, summed, text_slices

ORDERS, BUCKETS = (1, 2, 3, 4), 1 << 16
TOGETHER = 64  # languages of one matrix: BUCKETS * TOGETHER * 4 bytes, 17 MB, are broadcast at once
CHUNK = 1 << 16  # n-grams scored at once
SMOOTH = 0.1
UNKNOWN = "und"
_NUMBERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@cache
def _signs() -> tuple[np.ndarray, np.ndarray]:
    """Which code points are letters, and which stand in words (letters and marks)."""
    kind = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    letter = np.array([k == "L" for k in kind])
    return letter, letter | np.array([k == "M" for k in kind])


def letters(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts in lower case, each text's number beside them, and which texts have a letter. Whatever isn't of a word
    is 0, runs of it one 0; each text begins with a 0."""
    texts = [b.decode("utf-8", "replace").lower() for b in blobs]
    code = np.frombuffer("".join("\0" + t for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    letter, word = _signs()
    some = np.bincount(owner[letter[code]], minlength=len(texts)) > 0
    code = np.where(word[code], code, np.uint32(0))
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0) | (owner[1:] != owner[:-1])
    return code[keep], owner[keep], some


def gram_buckets(code: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the buckets of the n-grams that lie within a text, and their texts' numbers, in order."""
    key = np.zeros(len(code), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        m = len(code) - n + 1
        if m <= 0:
            return
        key = key[:m] * np.uint64(_NUMBERS[0]) + code[n - 1 :] + np.uint64(n)
        if n in ORDERS:
            inside = owner[:m] == owner[n - 1 :] if n > 1 else code != 0
            mixed = (key[inside] ^ (key[inside] >> np.uint64(29))) * np.uint64(_NUMBERS[1])
            yield (mixed >> np.uint64(48)).astype(np.int64) % BUCKETS, owner[:m][inside]


def _counts(docs: DataFrame, text_col: str, lang_col: str, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How often each bucket's n-grams stand in the texts of each language, and how many texts with a letter it has."""
    at = {name: i for i, name in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), BUCKETS + 1), np.int64)
        for batch, blobs in text_slices(batches, "text"):
            code, owner, some = letters(blobs)
            lang = np.array([at[x] for x in batch.column("lang").to_pylist()])
            total[:, BUCKETS] += np.bincount(lang[some], minlength=len(names))
            for buckets, texts in gram_buckets(code, owner):
                for i in np.unique(lang):
                    total[i, :BUCKETS] += np.bincount(buckets[lang[texts] == i], minlength=BUCKETS)
        yield from array_blocks(total)

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isin(names))
    total = summed(rows.mapInArrow(run, BLOCKS), len(names) * (BUCKETS + 1)).reshape(len(names), BUCKETS + 1).astype(np.float64)
    return total[:, :BUCKETS], total[:, BUCKETS]


def languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = 4096) -> list[str]:
    """The values of lang_col among rows with a text, in order. More than `most` is an error: the column isn't one of languages."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang")).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{lang_col} has more than {most} values")
    return sorted(r["lang"] for r in rows)


class NaiveBayes:
    """Log-probabilities of some languages' n-gram buckets, and of the languages, unnormalised over all."""

    def __init__(self, names: list[str], grams: np.ndarray, texts: np.ndarray):
        self.names = names
        self.weights = np.log((grams + SMOOTH) / (grams.sum(1, keepdims=True) + SMOOTH * BUCKETS)).T.astype(np.float32)
        self.prior = np.log(texts + SMOOTH)

    def __call__(self, code: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Each text's log-probability with each language. A sign stands in as many n-grams as there are orders, so their evidence
        counts by that part."""
        out = np.tile(self.prior, (n, 1))
        for buckets, texts in gram_buckets(code, owner):
            for low in range(0, len(buckets), CHUNK):
                some = texts[low : low + CHUNK]
                first = np.flatnonzero(np.diff(some, prepend=-1))
                out[some[first]] += np.add.reduceat(self.weights[buckets[low : low + CHUNK]], first, axis=0, dtype=np.float64) / len(ORDERS)
        return out


def identify(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", out: str = "lang_pred", score: str = "score", together: int = TOGETHER) -> DataFrame:
    """docs with the columns out, the likeliest language among those that rows where `learn` holds have in lang_col, and score, its
    probability given the text (of the languages with the same one the least in order). lang_col is read in rows to learn from alone.

    Counts of n-grams of whole words and of the gaps between them, 1 to 4 signs long, in BUCKETS buckets, are summed over all texts to learn from. The
    log-probabilities are broadcast, `together` languages in a matrix; tables with more languages are scored by one matrix after another,
    in one pass, each row carrying its best language so far, so no language is left out and no matrix grows.

    Null and empty texts, and those without a letter, are `und` with score 0, and nothing is learned from them; if nothing at all is, every row is. Null
    languages aren't learned. Very long texts count whole. Repeated rows, null ids and any other columns pass through; columns called out or
    score are replaced. An empty table gives an empty one."""
    spark, rows = docs.sparkSession, docs.drop(out, score)
    known = docs.where(learn & F.col(text_col).isNotNull())
    names = languages(known, text_col, lang_col)
    text, best, whole = free_name(rows, "_text"), free_name(rows, "_best"), free_name(rows, "_whole")
    own = rows.columns
    state = T.StructType([*rows.schema, T.StructField(out, T.StringType()), T.StructField(best, T.DoubleType()), T.StructField(whole, T.DoubleType())])
    rows = rows.withColumns({out: F.lit(None).cast("string"), best: F.lit(None).cast("double"), whole: F.lit(None).cast("double")})
    for low in range(0, len(names), together):
        some = names[low : low + together]
        model = NaiveBayes(some, *_counts(known.withColumn(lang_col, F.col(lang_col).cast("string")), text_col, lang_col, some))
        rows = rows.withColumn(text, F.col(text_col).cast("string")).mapInArrow(_better(spark.sparkContext.broadcast(model), text, own, out, best, whole), state)
    found = F.col(best).isNotNull()
    return rows.select(*(F.col(f"`{c}`") for c in own), F.when(found, F.col(out)).otherwise(UNKNOWN).alias(out), F.when(found, F.least(F.exp(F.col(best) - F.col(whole)), F.lit(1.0))).otherwise(0.0).alias(score))


def _better(model: Broadcast, text: str, own: list[str], out: str, best: str, whole: str):
    """Adds a matrix's languages to what the rows carry: the likeliest one, its log-probability, and the log of the sum over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.value.names, None], object)
        for batch, blobs in text_slices(batches, text):
            code, owner, some = letters(blobs)
            now = model.value(code, owner, len(blobs))
            had, total = (np.array(batch.column(c).to_pylist(), np.float64) for c in (best, whole))
            top = now.argmax(1)
            value = now[np.arange(len(now)), top]
            sums = value + np.log(np.exp(now - value[:, None]).sum(1))
            better = some & ~(had >= value)
            name = np.where(better, names[top], np.array(batch.column(out).to_pylist(), object))
            first = np.isnan(had)
            with np.errstate(invalid="ignore"):
                value, sums = np.where(better, value, had), np.where(first, sums, np.logaddexp(total, sums))
            arrays = [pa.array(name, pa.string()), *(pa.array(np.where(some, x, np.nan), pa.float64(), from_pandas=True) for x in (value, sums))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *arrays], [*own, out, best, whole])

    return run
