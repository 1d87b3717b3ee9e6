from __future__ import annotations

import hashlib

from cohortspark.llm import queries
from cohortspark.llm.fingerprints import edited, fingerprint_report, likeness, order_minhash, signature

SF = "/root/testdata/sf0.001"


def plain(rows):
    rows = sorted(rows, key=lambda r: r[0])
    texts = [t or "" for _, t in rows]
    out = {}
    for (i, _), t, u in zip(rows, texts, texts[1:] + texts[:1], strict=True):
        e = edited(t, u)
        s, se, su = signature(t), signature(e), signature(u)
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), s.tobytes().hex(), se.tobytes().hex(), likeness(s, se), likeness(s, su))
    return out


def plain_signature(text):
    """The same choice with sorted lists and Python's own numbers; only the hash of a k-mer with its number is shared."""
    from cohortspark.llm import fingerprints as f

    e = [int(x) for x in f.elements(text)]
    out = []
    for multiply, mask in zip(f._MULTIPLY.ravel().tolist(), f._MASK.ravel().tolist(), strict=True):
        order = sorted(range(len(e)), key=lambda i: (((e[i] >> 32) ^ mask) * multiply % 2**32, i))
        h = len(e) if len(e) < f.TUPLE else 0
        for i in sorted(order[: f.TUPLE]):
            h = (h ^ e[i]) * 0x9E3779B97F4A7C15 % 2**64
            h ^= h >> 31
        out.append(h >> 16 & 0xFFFFFFFF)
    return out


def test_signature_is_that_of_a_plain_version():
    from cohortspark.llm import fingerprints as f

    for text in ("", "a", "abcd", "abcde", "abcabcabcabcabc", "a" * 300, "é日本🙂 some text, some more " * 30, "x" * 4095 + "y" * 8 + "x" * 4100):
        assert signature(text).tolist() == plain_signature(text), text[:20]
        code = [ord(c) for c in text]
        k = min(f.K, len(code))
        grams = [tuple(code[i : i + k]) for i in range(len(code) - k + 1)]
        numbered = [(g, grams[:i].count(g)) for i, g in enumerate(grams)] if len(grams) < 1000 else []
        e = f.elements(text).tolist()
        assert all((numbered[i] == numbered[j]) == (e[i] == e[j]) for i in range(len(numbered)) for j in range(0, i, 7))


def test_query_matches_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r[0]: tuple(r[1:]) for r in queries.op10_fingerprints(spark, SF).collect()}
    assert got == plain(rows)
    assert sum(v[4] > v[5] for v in got.values()) > 0.95 * len(got)


def test_many_ranges_ties_nulls_and_short_texts(spark):
    rows = [(i * 3, t) for i, t in enumerate([None, "", "a", "ab", "abc" * 2000, "é" * 30, *(f"text number {i} of some" for i in range(400))])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, h int").repartition(5)
    for range_rows in (1, 37, 10_000):
        assert {r[0]: tuple(r[1:]) for r in fingerprint_report(docs, range_rows=range_rows).collect()} == plain(rows)
    assert fingerprint_report(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "same"), (1, "same"), (None, "first")], "doc_id long, text string")
    assert fingerprint_report(twice).count() == 3


def test_order_matters_and_equal_texts_agree(spark):
    words = [f"w{i}x{i * 7}" for i in range(300)]
    a, moved = " ".join(words), " ".join(words[150:] + words[:150])
    assert likeness(signature(a), signature(a)) == 1
    assert likeness(signature(a), signature(moved)) < 0.75
    docs = spark.createDataFrame([(1, a), (2, a), (3, moved)], "doc_id long, text string")
    found = {r[0]: r[1] for r in order_minhash(docs).collect()}
    assert found[1] == found[2] != found[3]
