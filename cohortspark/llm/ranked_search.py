"""Ranked lexical search of many items at once, with shared sums.

Items that have terms in common would add up the same contributions of a document
again and again. So pairs of summands that most items have in common are mined
(greedily, a found pair being a summand of further pairs), which gives a graph of sums
of two that the items share. A document's contributions are put into its leaves, every
inner node is added up once, and the items' scores are its roots.

Items are dealt into blocks, by hash, of some ``TERMS_AT_ONCE`` term occurrences. What a block
needs (terms, graph, weights) is bounded by that and goes to all tasks; each block reads
all documents, so no table of items and documents is ever made. Tasks keep the best of each item only.

Defined results: null and empty texts have no terms; rows that share an item id, a null
one too, are one item with the terms of all; an item without terms has no rows; rows
that share a doc_id are documents of their own; equal scores go by ascending doc_id, a
null one last; very long texts are read whole; an empty table gives an empty result;
columns that are not named are never read, so extra ones cannot clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from heapq import heapify, heappop, heappush
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm._common import give_back, keyed, materialize

#: Term occurrences of the items of a block, on average.
TERMS_AT_ONCE = 20_000
#: Summands of an item that pairs are mined among: those that most items share. What is beyond is added up without sharing.
MINED = 32
#: Numbers held for the documents of one step.
CELLS = 4_000_000
#: Parts that an item's best are ranked in before all are.
PARTS = 64

#: Bytes between terms become spaces, A-Z a-z; bytes of other characters stay.
FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


class Sums:
    """Sums of two: node ``leaves + k`` is ``left[k] + right[k]``. Equal sums are one node."""

    def __init__(self, leaves: int) -> None:
        self.leaves, self.left, self.right = leaves, [], []
        self.level = [0] * leaves
        self.made: dict[tuple[int, int], int] = {}

    def add(self, a: int, b: int) -> int:
        pair = (min(a, b), max(a, b))
        if pair not in self.made:
            self.made[pair] = len(self.level)
            self.left.append(pair[0])
            self.right.append(pair[1])
            self.level.append(1 + max(self.level[a], self.level[b]))
        return self.made[pair]


def share(items: list[list[int]], leaves: int) -> tuple[Sums, list[int]]:
    """The graph of sums for items (lists of different leaves), and each item's root."""
    sums = Sums(leaves)
    spread = Counter(x for item in items for x in item)
    scope = [set(sorted((x for x in item if spread[x] > 1), key=lambda x: (-spread[x], x))[:MINED]) for item in items]
    rest = [[x for x in item if x not in own] for item, own in zip(items, scope, strict=True)]
    holders: dict[tuple[int, int], set[int]] = {}
    for i, own in enumerate(scope):
        for pair in combinations(sorted(own), 2):
            holders.setdefault(pair, set()).add(i)
    queue = [(-len(h), pair) for pair, h in holders.items() if len(h) > 1]
    heapify(queue)
    while queue:
        n, pair = heappop(queue)
        now = len(holders.get(pair, ()))
        if now != -n:  # some of its items have spent a summand on another pair
            if now > 1:
                heappush(queue, (-now, pair))
            continue
        made, grown = sums.add(*pair), set()
        for i in sorted(holders.pop(pair)):
            own = scope[i]
            own.difference_update(pair)
            for x in own:
                for y in pair:
                    holders[min(x, y), max(x, y)].discard(i)
                holders.setdefault((x, made), set()).add(i)
                grown.add((x, made))
            own.add(made)
        for new in sorted(grown):
            if len(holders[new]) > 1:
                heappush(queue, (-len(holders[new]), new))
    roots = []
    for own, more in zip(scope, rest, strict=True):
        parts = [*sorted(own), *sorted(more)]
        while len(parts) > 1:
            parts = [sums.add(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        roots.append(parts[0])
    return sums, roots


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, term, times``: a row for each different term of an item."""
    source = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    kind = source.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, terms, times = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for term, n in Counter(terms_of(text)).items():
                    rows.append(i)
                    terms.append(term.decode())
                    times.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(terms, pa.string()), pa.array(times, pa.int64())], ["item_id", "term", "times"])

    return source.mapInArrow(run, f"item_id {kind}, term string, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def sharing_plans(terms: DataFrame, blocks: int) -> DataFrame:
    """A row for each block of items: its ``terms``; ``again`` (term) and ``more`` (how often beyond once) of the leaves for repeats, which follow the terms; ``left, right, level`` of sums; ``items`` and their ``roots``."""
    kind = terms.schema["item_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        ids, words, times = (table.column(c).combine_chunks() for c in ("item_id", "term", "times"))
        vocabulary = sorted(set(words.to_pylist()))
        place = {w: k for k, w in enumerate(vocabulary)}
        own = ids.dictionary_encode("encode")
        leaf: dict[tuple[int, int], int] = {}
        items: list[list[int]] = [[] for _ in own.dictionary]
        for i, w, n in sorted(zip(own.indices.to_pylist(), words.to_pylist(), times.to_pylist(), strict=True)):
            items[i].append(place[w])
            if n > 1:
                items[i].append(leaf.setdefault((place[w], n - 1), len(vocabulary) + len(leaf)))
        sums, roots = share(items, len(vocabulary) + len(leaf))
        level = sums.level[sums.leaves :]
        row = {"terms": vocabulary, "again": [t for t, _ in leaf], "more": [n for _, n in leaf], "left": sums.left, "right": sums.right, "level": level, "roots": roots}
        columns = {"block": table.column("block").slice(0, 1).combine_chunks(), "items": pa.ListArray.from_arrays(pa.array([0, len(own.dictionary)], pa.int32()), own.dictionary)}
        for name, value in row.items():
            columns[name] = pa.array([value], pa.list_(pa.string() if name == "terms" else pa.int64()))
        return pa.table(columns)

    dealt = terms.withColumn("block", F.pmod(F.xxhash64(F.col("item_id").cast("string")), F.lit(blocks)))
    numbers = ", ".join(f"{n} array<bigint>" for n in ("again", "more", "left", "right", "level", "roots"))
    return dealt.groupBy("block").applyInArrow(run, f"block bigint, items array<{kind}>, terms array<string>, {numbers}")


def postings(docs: DataFrame, vocabulary: Broadcast, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, terms, tfs``: of every document with a term, how many it has with repeats, and which of the vocabulary (a list) it has how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {w.encode(): k for k, w in enumerate(vocabulary.value)}.get
        for batch in batches:
            for at in range(0, len(batch), 512):
                rows, sizes, terms, tfs = [], [], [], []
                for i, text in enumerate(batch.column(1).slice(at, 512).to_pylist(), at):
                    words = terms_of(text)
                    if words:
                        found = Counter(map(known, words))
                        found.pop(None, None)
                        rows.append(i)
                        sizes.append(len(words))
                        terms.append(list(found))
                        tfs.append(list(found.values()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "tfs"])
        give_back()

    source = keyed(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return source.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Best:
    """The ``k`` best documents of each item so far."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.least = k, np.ones(items, np.int64)
        self.item, self.score, self.doc, self.unnamed = (np.zeros(0, kind) for kind in (np.int64, np.int64, np.int64, bool))

    def take(self, scores: np.ndarray, doc: np.ndarray, unnamed: np.ndarray) -> None:
        item, at = np.nonzero(scores >= self.least[:, None])
        if not len(item):
            return
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, scores[item, at]])
        doc, unnamed = np.concatenate([self.doc, doc[at]]), np.concatenate([self.unnamed, unnamed[at]])
        order = np.lexsort((doc, unnamed, -score, item))
        item = item[order]
        first = np.searchsorted(item, item)
        order = order[(rank := np.arange(len(item)) - first) < self.k]
        last = item[rank == self.k - 1]
        self.item, self.score, self.doc, self.unnamed = item[rank < self.k], score[order], doc[order], unnamed[order]
        self.least[last] = self.score[np.searchsorted(self.item, last, side="right") - 1]


def best_documents(found: DataFrame, plan: Broadcast, k: int) -> DataFrame:
    """``item`` (its place in the block), ``doc_id``, ``score``: at most ``k`` of each item from each task, among them all that are among the ``k`` best of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        leaves, inner = len(p["terms"]) + len(p["again"]), len(p["left"])
        steps = [np.flatnonzero(p["level"] == v) for v in range(1, int(p["level"].max(initial=0)) + 1)]
        size = max(16, CELLS // (leaves + inner))
        best = Best(len(p["roots"]), k)
        for batch in batches:
            for at in range(0, len(batch), size):
                part = batch.slice(at, size)
                ids, n, terms, tfs = part.columns
                m = 75 + 25 * n.to_numpy() * p["n_docs"] // p["n_terms"]
                row = np.repeat(np.arange(len(part)), np.diff(terms.offsets.to_numpy()))
                term, tf = terms.flatten().to_numpy(), tfs.flatten().to_numpy().astype(np.int64)
                cells = np.zeros((leaves + inner, len(part)), np.int64)
                cells[term, row] = p["weights"][term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[row]))
                cells[len(p["terms"]) : leaves] = p["more"][:, None] * cells[p["again"]]
                for nodes in steps:
                    cells[leaves + nodes] = cells[p["left"][nodes]] + cells[p["right"][nodes]]
                best.take(cells[p["roots"]], ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(best.item), pa.array(best.doc, mask=best.unnamed), pa.array(best.score)], ["item", "doc_id", "score"])
        give_back()

    return found.mapInArrow(run, "item long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents with the highest score of each item, those above 0 only."""
    spark = docs.sparkSession
    terms = materialize(item_terms(items, item_col, item_text_col))
    kind = terms.schema["item_id"].dataType.simpleString()
    blocks = (terms.agg(F.sum("times")).first()[0] or 0) // TERMS_AT_ONCE + 1
    plans = materialize(sharing_plans(terms, blocks))
    parts = []
    for (block,) in plans.select("block").collect():
        plan = plans.where(F.col("block") == block).first()
        held = materialize(postings(docs, spark.sparkContext.broadcast(plan["terms"]), id_col, text_col))
        n_docs, n_terms = held.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            continue
        df = dict(held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1))).collect())
        weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(plan["terms"]))]
        own = {name: np.array(plan[name], np.int64) for name in ("again", "more", "left", "right", "level", "roots")}
        own |= {"terms": plan["terms"], "weights": np.array(weights, np.int64), "n_docs": n_docs, "n_terms": n_terms}
        names = plans.where(F.col("block") == block).select(F.posexplode("items").alias("item", "item_id"))
        found = best_documents(held, spark.sparkContext.broadcast(own), k)
        parts.append(found.join(F.broadcast(names), "item").select("item_id", "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    rows = reduce(DataFrame.unionByName, parts)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    rows = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).where(F.col("rank") <= k)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return rows.select("item_id", "rank", "doc_id", "score")
