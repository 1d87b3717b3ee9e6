"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters count in lower case, everything else as one space. Counts of n-grams of
one to four characters, hashed to ``2**BITS`` buckets, are summed by Spark; the
matrix of log probabilities (MOST_LANGUAGES x buckets at most) is broadcast and
batches of texts are scored sparsely in numpy.

Defined results: a null text, or one without letters, is ``und`` with score 0;
labels that are null are not learned from; more than MOST_LANGUAGES different labels
are refused with a ValueError before any is counted; without any labelled row every text
is ``und``; ties go to the language first in alphabetical order; equal texts have
equal results, so repeated rows do; very long texts are scored whole; a null id is held
out; an empty table gives an empty result; columns that are not named are never read,
so extra ones cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm._common import give_back

BITS = 16
ORDERS = 4
#: Labelled rows to learn from; from more than that, a sample by hash of the id.
SAMPLE_ROWS = 20_000
#: Most languages that are learned: the matrix of log probabilities has 512 KB for each.
MOST_LANGUAGES = 500
#: Rows and characters scored at once.
CHUNK_ROWS, CHUNK_CHARS = 500, 200_000
_ALPHA: list[np.ndarray] = []


def alphabetic() -> np.ndarray:
    """Which code points are letters; made once in each worker."""
    if not _ALPHA:
        _ALPHA.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _ALPHA[0]


def chunked(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Slices of few enough rows and characters; a longer text is alone. Only a slice is ever held as Python strings."""
    start, chars = 0, 0
    held: list[str | None] = []
    for i, value in enumerate(texts):
        t = value.as_py()
        n = len(t or "")
        if held and (len(held) >= CHUNK_ROWS or chars + n > CHUNK_CHARS):
            yield start, held
            start, chars, held = i, 0, []
        held.append(t)
        chars += n
    if held:
        yield start, held


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, and the row of each; rows ascend within each order. A text without letters has none."""
    low = [(t or "").lower() for t in texts]
    code = np.frombuffer("\0".join(["", *low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    row = np.repeat(np.arange(len(low) + 1, dtype=np.int64), [1, *(len(t) + 1 for t in low)]) - 1
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in low])])
    letter = alphabetic()[code]
    code[~letter] = 32
    lettered = np.zeros(len(low) + 1, bool)
    lettered[row[letter]] = True
    code[bounds] = 0  # after each text
    keep = (code != 32) | np.concatenate([[True], code[:-1] != 32])
    keep &= lettered[row] | (code == 0)
    code, row = code[keep].astype(np.uint64), row[keep]
    inside = code != 0
    buckets, rows = [], []
    gram, whole = np.zeros(len(code), np.uint64), np.ones(len(code), bool)
    for n in range(1, ORDERS + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        gram = gram[:m] * np.uint64(0x100000001B3) + code[n - 1 :]
        whole = whole[:m] & inside[n - 1 :]
        mixed = (gram[whole] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        buckets.append(((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int64))
        rows.append(row[:m][whole])
    return (np.concatenate(buckets), np.concatenate(rows)) if buckets else (np.zeros(0, np.int64),) * 2


def count_ngrams(labelled: DataFrame) -> DataFrame:
    """``lang, bucket, n`` over rows of ``lang, text``; every task adds up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for at, part in chunked(batch.column(1)):
                bucket, row = ngrams(part)
                names = sorted(set(langs[at : at + len(part)]))
                index = {x: i for i, x in enumerate(names)}
                of = np.array([index[x] for x in langs[at : at + len(part)]], np.int64)
                counts = np.bincount((of[row] << BITS) + bucket, minlength=len(names) << BITS).reshape(len(names), -1)
                for x, c in zip(names, counts, strict=True):
                    total[x] = total.get(x, 0) + c
        for x, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at), pa.array(c[at])], ["lang", "bucket", "n"])
        give_back()

    return labelled.select("lang", "text").mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, most_languages: int = MOST_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """Languages in alphabetical order and their log probabilities, a row for each."""
    labelled = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    n = labelled.count()
    if n > sample_rows:
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(sample_rows / n * (1 << 30)))
    if len(labelled.select("lang").distinct().take(most_languages + 1)) > most_languages:
        raise ValueError(f"more than {most_languages} languages: merge or clean the labels first")
    found = count_ngrams(labelled).toPandas()  # at most most_languages x 2**BITS rows
    langs = sorted(found["lang"].unique())
    counts = np.full((len(langs), 1 << BITS), 0.1)
    np.add.at(counts, (found["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64), found["bucket"].to_numpy(np.int64)), found["n"].to_numpy(float))
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text, and the columns of ``keep``, which may be the text itself, after them. Rows leave Python as many at a time as are scored at once."""
    langs, matrix = model
    others = [c for c in keep if c != text_col]  # the text goes to Python once
    shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(matrix.T))  # languages x 2**BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value
        for batch in batches:
            for at, part in chunked(batch.column(1)):
                bucket, row = ngrams(part)
                total = np.stack([np.bincount(row, logs[bucket, k], minlength=len(part)) for k in range(len(langs))], axis=1) if langs else np.zeros((len(part), 0))
                known = np.bincount(row, minlength=len(part)) > 0
                best = total.argmax(axis=1) if langs else np.zeros(len(part), int)
                odds = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1) if langs else np.zeros(len(part))
                names = [langs[b] if k and langs else "und" for b, k in zip(best, known, strict=True)]
                scores = [float(p) if k and math.isfinite(p) else 0.0 for p, k in zip(odds, known, strict=True)]
                own = batch.slice(at, len(part))
                more = {c: own.column(c if c in others else "text") for c in keep}
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), *more.values()], ["doc_id", "lang_pred", "score", *more])
        give_back()

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *others)
    kinds = {f.name: f.dataType.simpleString() for f in source.schema} | {text_col: "string"}
    more = "".join(f", `{c}` {kinds[c]}" for c in keep)
    return source.mapInArrow(run, f"doc_id {kinds['doc_id']}, lang_pred string, score double{more}")


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; fold 1 is held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``; learned from the labelled rows that are not held out. A null id is held out."""
    model = fit(docs.where(fold(id_col) != 1), id_col, text_col, lang_col, sample_rows)
    return identify(docs, model, id_col, text_col).select("doc_id", F.coalesce(fold() == 1, F.lit(True)).alias("held_out"), "lang_pred", "score")
