"""Packing by power-of-two decomposition.

Every document (its ids, then one closing id) is cut into pieces whose lengths
are powers of two, the longest first and none longer than ``max_length``. Each
piece is a sequence of its own, and sequences of equal length form a bucket:
none crosses a document, and none needs padding. Sequences are numbered without
gaps, bucket after bucket, by document and start.

Defined results: a null or empty text has just the closing id, so one piece of
length 1; a null doc_id is kept and numbered first; rows that repeat a doc_id are
packed each for itself and their order among one another is that of their ids'
checksums, so only pieces equal in all columns can change places; very long texts are
packed whole; an empty table gives an empty result; columns that are not named are
never read, so extra ones cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm._common import give_back, keyed, materialize
from cohortspark.llm._merge import many_words
from cohortspark.llm.bpe import tokenizer_spec

#: Pieces that are numbered in one go, on average, and most ranges of them.
RANGE_ROWS, MOST_RANGES = 200_000, 10_000


def binary_lengths(n: int, max_length: int) -> list[int]:
    """As many of ``max_length`` as fit, then the binary digits of the rest from the highest on."""
    full, rest = divmod(n, max_length)
    return [max_length] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str, max_length: int = 1024, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, if ``with_ids``, ``ids`` array<int>."""
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(tokenizer_spec(tokenizer_path))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = many_words(spec.value)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, len(batch), 512):
                part = words.encode([t or "" for t in texts.slice(at, 512).to_pylist()])
                rows, sums, starts, lengths, totals, pieces = [], [], [], [], [], []
                for i, own in enumerate(part):
                    ids = own.astype("<u4").tobytes() + end
                    n, start = len(ids) // 4, 0
                    for length in binary_lengths(n, max_length):
                        piece = ids[4 * start : 4 * (start + length)]
                        rows.append(at + i)
                        sums.append(zlib.crc32(piece))
                        starts.append(start)
                        lengths.append(length)
                        totals.append(n)
                        if with_ids:
                            pieces.append(np.frombuffer(piece, np.int32))
                        start += length
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.array(pieces, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
        give_back()

    source = keyed(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    pieces = materialize(source.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids))
    return number_sequences(pieces)


def number_sequences(pieces: DataFrame) -> DataFrame:
    """Adds ``sequence_id`` and ``offset``. Pieces are dealt out by ranges of their order, whatever their ids are, and counted by range, so no window spans more than a range."""
    order = [F.col("length"), F.col("doc_id").asc_nulls_first(), F.col("start"), F.col("ids_crc32"), F.col("doc_tokens")]
    n_ranges = min(MOST_RANGES, pieces.count() // RANGE_ROWS + 1)
    placed = materialize(pieces.repartitionByRange(n_ranges, *order).withColumn("range", F.spark_partition_id()))
    counts = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))  # MOST_RANGES rows at most
    rank = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    numbered = placed.withColumn("rank", rank).join(F.broadcast(before), "range")
    return numbered.select(*pieces.columns, (F.col("before") + F.col("rank") - 1).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
