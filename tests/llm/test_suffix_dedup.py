from __future__ import annotations

import random


import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.llm import queries
from cohortspark.llm.suffix_dedup import deep_shallow, suffix_dedup
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def digest(found):
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return {r[0]: tuple(r[1:]) for r in found.select("doc_id", "n_bytes", removed, F.size("spans"), F.sha2("kept", 256)).collect()}


def test_query_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert {r[0]: tuple(r[1:]) for r in queries.op1_suffix_dedup(spark, SF).collect()} == brute.suffix_dedup(rows)


@pytest.mark.parametrize("hot", [(256, 4096), (1, 2)])
def test_overlaps_copies_runs_and_hot_strings(spark, hot):
    rnd = random.Random(3)
    line = "".join(rnd.choice("abcdé") for _ in range(70))
    texts = [line + "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 90))) + line[: rnd.randint(40, 70)] for _ in range(40)]
    texts += [texts[3], texts[3], "x" * 49, "x" * 50, "x" * 200, "x" * 300, "ab" * 60, "ab" * 61, None, "", "short"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert digest(suffix_dedup(docs, hot_in_task=hot[0], hot=hot[1])) == brute.suffix_dedup(rows)


def test_empty_table_null_id_repeated_rows_and_other_columns(spark):
    schema = "doc_id long, text string, place int, rid string"
    assert suffix_dedup(spark.createDataFrame([], schema)).count() == 0
    text = "0123456789" * 6
    docs = spark.createDataFrame([(None, text, 1, "a"), (5, text, 1, "a"), (5, text, 1, "a"), (6, None, 1, "a")], schema)
    got = sorted(((r["doc_id"], len(r["kept"])) for r in suffix_dedup(docs).collect()), key=str)
    assert got == [(5, 0), (5, 0), (6, 0), (None, 60)]


def test_suffixes_are_sorted():
    rnd = random.Random(5)
    raw = bytes(rnd.choice(b"ab") for _ in range(3000)) + b"a" * 300
    at = np.arange(len(raw) - 50)
    order, new = deep_shallow(np.frombuffer(raw + bytes(66), np.uint8), at, 50)
    strings = [raw[i : i + 50] for i in order]
    assert strings == sorted(strings)
    assert new.tolist() == [True] + [a != b for a, b in zip(strings, strings[1:])]


def test_only_wanted_forms_of_what_is_left_leave_python(spark):
    docs = spark.createDataFrame([(1, "a" * 60), (2, "b" * 10 + "a" * 60)], "doc_id long, text string")
    both = {r["doc_id"]: r for r in suffix_dedup(docs).collect()}
    for form in ("kept", "text"):
        found = suffix_dedup(docs, forms=(form,))
        assert found.columns == ["doc_id", "n_bytes", "spans", form]
        assert {r["doc_id"]: r[form] for r in found.collect()} == {k: r[form] for k, r in both.items()}
