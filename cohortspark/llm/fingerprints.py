"""Document fingerprints by Order MinHash.

The k-mers of a text (k code points) get occurrence numbers, so a repeated k-mer
is several elements. Each of ``N_HASHES`` hash functions selects the ``TUPLE``
elements with the smallest values; these, in text order, are hashed to one number
of the signature. So the likeness of two signatures, the share of equal numbers,
falls with edits and with moved passages, as edit distance does.

Defined results: a null text is empty; texts shorter than k are one k-mer, the
empty text one empty k-mer; a text with fewer elements than ``TUPLE`` selects
them all; equal texts have equal fingerprints; the next document of the last is
the first; rows with equal ids follow one another in order of their texts, null
ids come first, and repeated rows have equal fingerprints; very long texts are read
whole; an empty table gives an empty result; columns that are not named are never
read, so extra ones cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm._common import keyed

K, N_HASHES, TUPLE = 5, 64, 2
#: k-mers that are hashed at once.
STRIP = 4096
#: Documents dealt to one range, on average, and most ranges.
RANGE_ROWS, MOST_RANGES = 1000, 10_000
#: Range limits are searched in two steps, first among every FAN-th.
FAN = 100
NO_ID = -(1 << 63)

U = np.uint64


def seeds() -> tuple[np.ndarray, np.ndarray]:
    """An odd multiplier and a mask for each hash function, by a rule."""
    raw = np.frombuffer(hashlib.shake_128(b"order minhash").digest(8 * N_HASHES), "<u4").reshape(2, N_HASHES, 1)
    return raw[0] | np.uint32(1), raw[1].copy()


_MULTIPLY, _MASK = seeds()


def elements(text: str) -> np.ndarray:
    """A hash of each k-mer with its occurrence number, in text order."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
    k = min(K, len(code))
    n = len(code) - k + 1
    h = np.full(n, k, U)
    for j in range(k):
        h = (h ^ code[j : j + n]) * U(0x9E3779B97F4A7C15)
        h ^= h >> U(29)
    bits = max(1, int(n).bit_length())
    keyed_ = np.sort((h >> U(bits) << U(bits)) | np.arange(n, dtype=U))  # by hash, then place
    kmer, place = keyed_ >> U(bits), (keyed_ & U((1 << bits) - 1)).astype(np.int64)
    at = np.arange(n)
    start = np.maximum.accumulate(np.where(np.concatenate([np.ones(1, bool), kmer[1:] != kmer[:-1]]), at, 0))
    out = h * U(0xC2B2AE3D27D4EB4F)
    out[place] += (at - start).astype(U) * U(0x165667B19E3779F9)
    out ^= out >> U(32)
    out *= U(0xD6E8FEB86659FD93)
    return out ^ (out >> U(29))


def signature(text: str) -> np.ndarray:
    """N_HASHES numbers of 32 bits."""
    e = elements(text)
    n = len(e)
    low = (e >> U(32)).astype(np.uint32)
    take = min(TUPLE, n)
    values, places = [], []
    for a in range(0, n, STRIP):
        v = low[a : a + STRIP] ^ _MASK
        v *= _MULTIPLY
        rows = np.arange(N_HASHES)
        for t in range(min(TUPLE, v.shape[1])):
            p = v.argmin(axis=1)
            values.append(v[rows, p].astype(np.int64))
            places.append(p + a)
            if t + 1 < TUPLE:
                v[rows, p] = 0xFFFFFFFF
    values, places = np.stack(values, 1), np.stack(places, 1)
    if values.shape[1] > take:
        best = np.lexsort((places, values), axis=1)[:, :take]
        places = np.take_along_axis(places, best, 1)
    places.sort(axis=1)
    h = np.full(N_HASHES, n if n < TUPLE else 0, U)
    for t in range(take):
        h = (h ^ e[places[:, t]]) * U(0x9E3779B97F4A7C15)
        h ^= h >> U(31)
    return (h >> U(16)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def order_minhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, signature`` (binary, N_HASHES numbers of 32 bits) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([signature(t.as_py() or "").tobytes() for t in b.column(1)], pa.binary())], ["doc_id", "signature"])

    source = keyed(docs, id_col, text_col)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, signature binary")


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a task in order of ``range, ord, text``, the first of the next range after those of its own (``guest``): each row with the one after it."""
    before = None
    for batch in batches:
        out: list[tuple] = []
        for of, doc_id, text, guest in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3)), strict=True):
            sig = signature(text)
            if before is not None and before[0] == of:
                _, last_id, last, last_sig = before
                changed = edited(last, text)
                changed_sig = signature(changed)
                out.append((last_id, len(last), hashlib.sha256(changed.encode()).hexdigest(), last_sig.tobytes().hex(), changed_sig.tobytes().hex(), likeness(last_sig, changed_sig), likeness(last_sig, sig)))
            before = None if guest else (of, doc_id, text, sig)
        if out:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], [f.split()[0] for f in RESULT.split(", ")])


def fingerprint_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """RESULT: fingerprints of every whole text and of its edited text, and how alike they and those of the next document are.

    Texts are dealt out once, by ranges of ids; only the first row of each range
    goes to the range before it as well. Range limits (at most MOST_RANGES ids)
    and the first rows' keys are all that the driver sees.
    """
    spark = docs.sparkSession
    base = keyed(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("ord", F.coalesce("doc_id", F.lit(NO_ID)))
    n = base.count()
    parts = min(MOST_RANGES, max(1, -(-n // range_rows)))
    cuts = sorted({int(c) for c in base.select(F.percentile_approx("ord", [i / parts for i in range(1, parts)], 10 * parts).alias("c")).first()["c"] or ()}) if parts > 1 and n else []
    coarse = cuts[FAN - 1 :: FAN]
    fine = [cuts[i * FAN : (i + 1) * FAN] for i in range(len(coarse) + 1)]
    limits = spark.createDataFrame(list(enumerate(fine)), "coarse int, fine array<long>")
    up_to = lambda limits: F.size(F.filter(limits, lambda c: c <= F.col("ord")))
    searched = base.withColumn("coarse", up_to(F.lit(coarse)) if coarse else F.lit(0)).join(F.broadcast(limits), "coarse")
    ranged = searched.select((F.col("coarse") * FAN + up_to(F.col("fine"))).alias("range"), "doc_id", "text", "ord")
    keys = ranged.select("range", F.struct("ord", F.xxhash64("text").alias("h")).alias("key"))
    firsts = sorted((r["range"], r["key"]["ord"], r["key"]["h"]) for r in keys.groupBy("range").agg(F.min("key").alias("key")).collect())
    if not firsts:
        return spark.createDataFrame([], RESULT)
    before = {r: firsts[i - 1][0] for i, (r, _, _) in enumerate(firsts)}
    heads = spark.createDataFrame([(r, o, h, before[r]) for r, o, h in firsts], "range int, ord long, h long, to int")
    tagged = ranged.withColumn("h", F.xxhash64("text")).join(F.broadcast(heads), ["range", "ord", "h"], "left")
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("to").alias("range"), F.lit(True).alias("guest"))
    dealt = tagged.select("doc_id", "text", "ord", "h", F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, guest))).alias("at")).select(F.col("at.range").alias("range"), "doc_id", "text", F.col("at.guest").alias("guest"), "ord", "h")
    placed = dealt.repartition("range").sortWithinPartitions("range", "guest", "ord", "h")
    return placed.select("range", "doc_id", "text", "guest").mapInArrow(with_next, RESULT)
