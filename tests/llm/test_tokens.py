"""Pieces against the sentencepiece library, alignment against a plain version."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortspark.llm import alignment, pieces, queries

SF = "/root/testdata/sf0.001"
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "a", "a  b", "\n \n", "x \n", "don't\tstop", "<s> x</s><0x41><unk>", "<|endoftext|> x", "é日本🙂  b", "a" * 5000, "word " * 3000, "\x00\x1c\x85", "1²½ Ⅷ", "▁▁a ▁",
    " " * 40 + "x" + " " * 17, "日本語テキスト漢字" * 50, "abcdefghij" * 300, "-" * 333, "===/===\n\n####", "🙂🙃" * 70, "ab" * 400 + "ba" * 400,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def model():
    return pieces.many_pieces(pieces.model_spec(PIECES))


def docs(spark, texts=ODD):
    return spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids int, strip string")


def test_pieces_match_the_library(spark, library):
    want = {i: library.encode(t or "", add_bos=True, add_eos=True) for i, t in enumerate(ODD)}
    encoded = pieces.piece_encode(docs(spark), PIECES)
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()} == want
    assert {r["doc_id"]: r["text"] for r in pieces.piece_decode(encoded, PIECES).collect()} == {i: library.decode(x) for i, x in want.items()}
    bare = pieces.piece_encode(docs(spark), PIECES, with_ends=False)
    assert {r["doc_id"]: r["ids"] for r in bare.collect()} == {i: library.encode(t or "") for i, t in enumerate(ODD)}


def test_pieces_of_random_texts(library, model):
    rng = random.Random(5)
    alphabet = ["a", "b", "the", "in", "er", " ", "  ", "é", "漢", "字", "\n", "-", "=", "▁", "1", "0", "🙂", "ing", "▁▁", "Th", "ск", "ов"]
    known = list(model.coder.id_of)
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(2000)]
    texts += ["".join(rng.choices(known, k=rng.randint(1, 8))).replace("▁", " ") for _ in range(2000)]
    texts += ["".join(rng.choices(known, k=100)).replace("▁", "") for _ in range(30)]
    for t, own, want in zip(texts, model.encode(texts), library.encode(texts), strict=True):
        assert own.tolist() == want, t
        assert model.decode(own) == model.coder.decode(want) == library.decode(want)


def test_one_word_at_a_time(library, model):
    """The plain walk gives what merging gives, and what the walk over many words gives."""
    rng = random.Random(6)
    known = [p for p in model.coder.id_of if "▁" not in p]
    for _ in range(500):
        word = "▁" + "".join(rng.choices(known, k=rng.randint(1, 6)))
        assert model.coder.backtrack(word, model.coder.compatible) == model.coder.merge(word) == model.encode([word[1:]])[0].tolist()


def test_decode_of_other_ids(library, model):
    for ids in ([], [1, 2], [259, 259], [229, 136, 170], [28705, 28705, 264], [200, 300, 201], [0, 264], [1, 264, 2, 264]):
        assert model.coder.decode(ids) == model.decode(np.array(ids, np.int64)) == library.decode(ids), ids


def test_forgetting_changes_nothing(model, monkeypatch):
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(50)) for _ in range(40)]
    want = [x.tolist() for x in model.encode(texts)]
    monkeypatch.setattr("cohortspark.llm._merge.REMEMBERED", 100)
    monkeypatch.setattr(pieces, "PAIRS", 50)
    own = pieces.ManyPieces(model.coder)
    assert [x.tolist() for t in texts for x in own.encode([t])] == want


def test_other_models_are_refused():
    with pytest.raises(ValueError, match="merge-type"):
        pieces.PieceCoder(b"\n\x05\n\x03abc")


def test_piece_query(spark, library):
    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = queries.op13_sentencepiece(spark, SF).collect()
    assert len(found) == len(rows)
    for r in found:
        ids = library.encode(rows[r["doc_id"]], add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_pieces_of_empty_and_repeated_rows(spark):
    assert pieces.piece_round_trip(docs(spark).limit(0), PIECES).count() == 0
    odd = spark.createDataFrame([(None, "x"), (None, "x"), (1, None), (1, "x")], "doc_id long, text string")
    found = pieces.piece_round_trip(odd, PIECES).collect()
    assert len(found) == 4 and len({r["ids_sha256"] for r in found}) == 2


def plain_alignment(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    t, s = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    t.encode_special_tokens = True
    letters = alignment.many_words(alignment.tokenizer_spec(BYTES)).coder.bytes_of
    bytes_of_piece = lambda i: bytes([int(s.id_to_piece(i)[1:-1], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode()
    out, linked = [], []
    for i, text in rows:
        raw = b" " + (text or "").encode()
        a, b = (t.encode(" " + text, add_special_tokens=False).ids, s.encode(text)) if text else ([], [])
        if not text or b"".join(letters[x] for x in a) != raw or b"".join(map(bytes_of_piece, b)) != raw:
            out.append([i, 0, 0, 0, 0, ""])
            linked.append([])
            continue
        groups, links = [], []
        x = y = at_a = at_b = low_a = low_b = 0
        while x < len(a):
            if at_a <= at_b:
                at_a += len(letters[a[x]])
                x += 1
            while at_b < at_a:
                at_b += len(bytes_of_piece(b[y]))
                y += 1
            if at_a == at_b:
                groups.append((a[low_a:x], b[low_b:y]))
                low_a, low_b = x, y
        for p, q in groups:
            links += [(m, n) for m in p for n in q]
        digest = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append([i, len(a), len(b), len(groups), len(links), hashlib.sha256(digest.encode()).hexdigest()])
        linked.append(links)
    counts = Counter(pair for links in linked for pair in set(links))
    highest: dict[int, int] = {}
    for (m, _), n in counts.items():
        highest[m] = max(n, highest.get(m, 0))
    return [(*row[:5], sum(counts[x] == highest[x[0]] for x in links), sum(counts[x] for x in links), row[5]) for row, links in zip(out, linked, strict=True)]


def as_rows(found) -> list[tuple]:
    return sorted((tuple(r) for r in found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


def test_alignment_equals_a_plain_one(spark):
    rows = [*enumerate(ODD), (None, "the end of the"), (None, "the end of the"), (3, "a"), (3, "other text.")]
    table = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, strip string")
    want = sorted(plain_alignment(rows), key=str)
    assert as_rows(alignment.align_tokens(table, BYTES, PIECES)) == want


def test_alignment_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert as_rows(queries.op12_alignment(spark, SF)) == sorted(plain_alignment(rows), key=str)


def test_strips_change_nothing(spark, monkeypatch):
    table = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").withColumn("doc_id", F.col("doc_id").cast("string"))
    want = as_rows(alignment.align_tokens(table, BYTES, PIECES))
    monkeypatch.setattr(alignment, "STRIP", 3000)
    monkeypatch.setattr(alignment, "AT_ONCE", 2000)
    assert as_rows(alignment.align_tokens(table, BYTES, PIECES)) == want
    assert alignment.align_tokens(table.limit(0), BYTES, PIECES).count() == 0


def test_a_strip_is_as_narrow_as_its_numbers(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    for row in alignment.aligned_strips(table, BYTES, PIECES).select("n_pairs", "index", "links", F.size("pairs").alias("n")).collect():
        n = sum(row["n_pairs"])
        assert n > 1000 and row["n"] < 1 << 16 and len(row["index"]) == 2 * n and len(row["links"]) <= 2 * n


def test_large_groups_are_summed_up(monkeypatch):
    own = alignment.aligner(alignment.tokenizer_spec(BYTES), pieces.model_spec(PIECES))
    texts = ["abcabcabd" * 40, "日本語🙂" * 30, "x"]
    want = own.align(texts)
    monkeypatch.setattr(alignment, "LARGE", 0)
    found = own.align(texts)
    assert all(np.array_equal(found[k], want[k]) for k in want)


def test_shared_ends_are_all_found():
    rng = np.random.default_rng(3)
    for share in (0.02, 0.3, 0.95):
        bounds = np.sort(rng.choice(20000, 7, replace=False))
        a, b = (np.union1d(np.flatnonzero(rng.random(bounds[-1]) < share), bounds) for _ in range(2))
        cut, upto = alignment.shared_ends(a, b, np.searchsorted(a, bounds))
        assert np.array_equal(a[cut], np.intersect1d(a, b)) and np.array_equal(b[upto[cut] - 1], a[cut])
