"""Ranked search against a plain version."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from cohortspark.llm import ranked_search
from tests.llm.brute import lower_ascii

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain(docs: list[tuple], items: list[tuple], k: int = 20) -> list[tuple]:
    read = [(i, TERM.findall(lower_ascii(t or ""))) for i, t in docs]
    read = [(i, Counter(words), len(words)) for i, words in read if words]
    n_docs, n_terms = len(read), sum(n for _, _, n in read)
    df = Counter(w for _, words, _ in read for w in words)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(TERM.findall(lower_ascii(t or "")))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, words, n in read:
            m = 100 - 25 + 25 * n * n_docs // n_terms
            score = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * words[w] // (1000 * words[w] + 12 * m)) for w, r in terms.items() if words[w])
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, rank, None if unnamed else i, -score) for rank, (score, unnamed, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def tables(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n long, terms string")
    return d, spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, block int")


def found(df) -> list[tuple]:
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(11)
    words = ["the", "The", "of", "Été", "été", "K", "k", "x1", "日本", "ſ", *(f"w{i}" for i in range(30))]
    text = lambda n: rng.choice([" ", "-", "\n", "; "]).join(rng.choices(words, k=n))
    docs = [(i, text(rng.randint(1, 40))) for i in range(120)] + [(500 + i, "the of of x1") for i in range(40)] + [(700, None), (701, ""), (702, "-- \n"), (703, text(20000)), (None, "the of of x1"), (None, text(9)), (704, text(9)), (704, text(12))]
    items = [(i, text(rng.randint(1, 12)) + " of the") for i in range(25)] + [(100, None), (101, ""), (102, "unheard"), (103, "of of of the"), (None, "w1 w2"), (103, "w7")]
    return docs, items


def test_equals_a_plain_search(spark, odd):
    want = plain(*odd)
    assert found(ranked_search.ranked_search(*tables(spark, *odd))) == want
    assert found(ranked_search.ranked_search(*tables(spark, *odd), k=3)) == plain(*odd, k=3)


def test_blocks_and_steps_change_nothing(spark, odd, monkeypatch):
    want = plain(*odd)
    monkeypatch.setattr(ranked_search, "TERMS_AT_ONCE", 60)
    monkeypatch.setattr(ranked_search, "CELLS", 3000)
    monkeypatch.setattr(ranked_search, "MINED", 4)
    docs, items = tables(spark, *odd)
    assert found(ranked_search.ranked_search(docs.repartition(3), items)) == want


def test_empty_tables(spark, odd):
    docs, items = tables(spark, *odd)
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("doc_id between 700 and 702"), items)):
        assert ranked_search.ranked_search(d, i).count() == 0


def test_shared_sums_are_right_and_fewer():
    rng = random.Random(2)
    items = [sorted(rng.sample(range(12), 6)) + sorted(rng.sample(range(12, 200), 5)) for _ in range(40)]
    sums, roots = ranked_search.share(items, 200)
    value = [rng.randint(0, 10**9) for _ in range(200)]
    for a, b in zip(sums.left, sums.right, strict=True):
        value.append(value[a] + value[b])
    assert [value[r] for r in roots] == [sum(value[x] for x in item) for item in items]
    assert len(sums.left) < 0.85 * sum(len(item) - 1 for item in items)
    assert ranked_search.share([[3]], 4)[1] == [3]
