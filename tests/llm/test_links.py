from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from cohortspark.llm import line_dedup, ngram_join, suffix_dedup
from cohortspark.llm._links import components
from cohortspark.llm._trie import link


def plain(n, edges):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_of_chains_stars_and_single_nodes(spark):
    rnd = random.Random(1)
    names = list(range(120))
    rnd.shuffle(names)
    edges = [(names[i], names[i + 1]) for i in range(39)] + [(names[40], names[i]) for i in range(41, 70)] + [(rnd.randrange(70, 120), rnd.randrange(70, 120)) for _ in range(40)] + [(5, 5)]
    edges = [(a, b) if a < 70 or b < 70 else (names[a], names[b]) for a, b in edges]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges + edges[:9], "a long, b long")).collect()}
    want = plain(120, edges)
    assert got == {i: want[i] for i in {x for e in edges for x in e}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_prefix_tree_finds_all_links():
    rnd = random.Random(2)
    for trial in range(60):
        base = [rnd.sample(range(400), rnd.randint(1, 60)) for _ in range(4)]
        sets = []
        for _ in range(rnd.randint(1, 60)):
            s = set(rnd.choice(base))
            for _ in range(rnd.randint(0, 8)):
                s ^= {rnd.randrange(400)}
            sets.append(np.array(sorted(s or {1}), np.uint64))
        pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * (n := len(np.intersect1d(sets[i], sets[j]))) >= 75 * (len(sets[i]) + len(sets[j]) - n)]
        known = [rnd.randrange(i + 1) if rnd.random() < 0.2 else i for i in range(len(sets))] if trial % 2 else None
        more = [(i, k) for i, k in enumerate(known)] if known else []
        assert link(sets, 75, known) == plain(len(sets), pairs + more)


@pytest.mark.parametrize("kind", ["lines", "shingles", "strings"])
def test_a_task_that_runs_again_gives_the_same_rows(kind):
    """Shuffle keys come from content: a lost map output that is made again goes to the same buckets, hot entries and ready-made ones too."""
    rnd = random.Random(4)
    words = [f"w{k}" for k in range(40)]
    same = " ".join(words) * 3
    texts = [f"{same}\n{' '.join(rnd.choices(words, k=30))}\n{same}!" for _ in range(50)]
    table = pa.table({"rid": pa.array(range(50), pa.int64()), "text": pa.array(texts)})
    run = {"lines": line_dedup.band_entries(6), "shingles": ngram_join.count_entries(6), "strings": suffix_dedup.entries_of(50, 6, 3)}[kind]
    source = table.select(["text"]) if kind == "lines" else table
    first, again = (pa.Table.from_batches(run(iter(source.to_batches(max_chunksize=7)))) for _ in range(2))
    assert first.equals(again) and first.num_rows > 6
    assert min(first.column("bucket").to_pylist()) < 0
