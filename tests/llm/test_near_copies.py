"""Line deduplication, the n-gram join and the pipeline."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortspark.llm import chat, line_dedup, ngram_join, queries
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def left_lines(rows, least=1, k=8):
    """By id the number of lines, of removed ones, and the text that is left."""
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x).lower().strip(" ")
    places = [(i, p, norm(x)) for i, t in rows for p, x in enumerate((t or "").split("\n")) if len(norm(x)) >= least]
    names = sorted({n for *_, n in places})
    sets = [frozenset(n[j : j + k] for j in range(max(1, len(n) - k + 1))) for n in names]
    root = list(range(len(names)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders: dict[str, list[int]] = {}
    for i, s in enumerate(sets):
        shared: dict[int, int] = {}
        for x in s:
            for j in holders.setdefault(x, []):
                shared[j] = shared.get(j, 0) + 1
            holders[x].append(i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    group = {n: find(i) for i, n in enumerate(names)}
    seen, gone = set(), {}
    for i, p, n in places:
        if group[n] in seen:
            gone.setdefault(i, set()).add(p)
        seen.add(group[n])
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        out[i] = (len(lines), len(gone.get(i, ())), "\n".join(x for p, x in enumerate(lines) if p not in gone.get(i, ())))
    return out


def plain_lines(rows):
    return {i: (n, gone, hashlib.sha256(text.encode()).hexdigest()) for i, (n, gone, text) in left_lines(rows).items()}


def test_line_query_matches_plain_version(spark):
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    assert {r[0]: tuple(r[1:]) for r in queries.op3_line_dedup(spark, SF).collect()} == plain_lines(rows)


def test_lines_of_odd_texts(spark):
    line = "The quick brown fox jumps over the lazy dog, and then it sleeps."
    texts = [None, "", line, line + "!", f"short\n{line.upper()}\nshort\n{line}", "short\nshort", "another line that nobody else has, at all\n\n"]
    table = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id long, text string, norm string")
    found = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.line_dedup(table).collect()}
    assert found[0] == ("", 1, 0) and found[2] == (line, 1, 0) and found[3] == ("", 1, 1)
    assert found[4] == ("short", 4, 3) and found[5] == ("", 2, 2)
    assert line_dedup.line_dedup(table.limit(0)).count() == 0


def test_join_query_matches_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op4_ngram_jaccard_join(spark, SF).collect()}
    assert got == brute.ngram_join(rows)


def test_join_of_near_copies_in_parts(spark):
    rnd = random.Random(8)
    word = lambda: f"w{rnd.randrange(5000)}"
    base = [[word() for _ in range(90)] for _ in range(3)]
    texts = []
    for _ in range(45):
        w = list(rnd.choice(base))
        for _ in range(rnd.randrange(5)):
            w[rnd.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [None, "", " \n", "one two", "One TWO", "one", texts[0], texts[0].upper()]
    rows = list(enumerate(texts, 100))
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, sid string, root int").repartition(3)
    want = brute.ngram_join(rows)
    for size in (10_000, 400):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(table, part_size=size).collect()}
        assert got == want
    assert ngram_join.ngram_jaccard_join(table.limit(0)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    line = "A line of more than fifty bytes that two documents have in common, word for word."
    own = [" ".join(f"v{i}u{k}" for k in range(60)) for i in range(6)]
    texts = [own[0], own[0] + " tail", f"{own[1]} {line} x", f"{own[2]} {line} y", None, "123 ...", f"{own[3]}\n{line}", f"{own[4]}\n{line}"]
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else None, None, 5) for i, t in enumerate(texts)], ", ".join(f"{c} {k}" for c, k in zip(p.COLUMNS, ("long", "string", "string", "string", "long"), strict=True)))
    kept = {}
    for name, stage in p.STAGES:
        docs = p.packing.materialize(stage(spark, docs, SF))
        kept[name] = docs.collect()
        if name != "packing":
            assert tuple(docs.columns) == p.COLUMNS
    assert [r["doc_id"] for r in sorted(kept["language_id"])] == [0, 1, 2, 3, 6, 7]
    after = {r["doc_id"]: r["text"] for r in kept["line_dedup"]}
    assert after[6].endswith(line) and line not in after[7]
    assert sorted(r["doc_id"] for r in kept["ngram_jaccard_join"]) == [0, 2, 3, 6, 7]
    cut = {r["doc_id"]: r for r in kept["suffix_dedup"]}
    assert line in cut[2]["text"] and line[5:-5] not in cut[3]["text"] and line[5:-5] not in cut[6]["text"]
    assert all(r["n_chars"] == len(r["text"]) for r in cut.values())
    assert {r["doc_id"] for r in kept["packing"]} == set(cut)


def plain_pipeline(rows) -> dict[int, list[int]]:
    """Ids of each document that is left after all stages, the closing one included."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {i: x for i, x in rows if re.search(r"[^\W\d_]", x or "")}
    texts = {i: x for i, (_, _, x) in left_lines(sorted(texts.items())).items() if brute.WORD.search(x)}
    roots = {i: c for i, (_, c) in brute.ngram_join(list(texts.items())).items()}
    texts = {i: x for i, x in texts.items() if roots[i] == i}
    texts = {i: raw.decode("utf-8", "ignore") for i, raw in brute.left_bytes(list(texts.items())).items()}
    return {i: [*t.encode(x, add_special_tokens=False).ids, 0] for i, x in texts.items() if brute.WORD.search(x)}


def test_pipeline_equals_a_plain_one(spark):
    import corpus_pipeline as p

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = plain_pipeline(rows)
    assert 0 < len(want) < len(rows)
    pieces: dict[int, list] = {}
    for r in p.run(spark, SF).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"]))
    assert pieces.keys() == want.keys()
    for i, ids in want.items():
        raw, at = np.array(ids, "<u4"), 0
        for start, length, crc in sorted(pieces[i]):
            assert start == at and crc == zlib.crc32(raw[at : at + length].tobytes())
            at += length
        assert at == len(ids)


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Null and shared ids, null texts, a repeated row, a very long text, columns named as those inside, and no rows at all."""
    import corpus_pipeline as p

    own = [" ".join(f"v{i}u{k}" for k in range(60)) for i in range(7)]
    long = "\n".join(" ".join(f"l{n}x{k}" for k in range(40)) for n in range(1500))
    rows = [(None, own[0], "en"), (None, None, None), (3, own[1], "en"), (3, own[1], "en"), (3, own[2], None), (4, own[3] + "\n" + own[1], "en"), (5, long, "en"), (6, "", "en"), (7, "12 34", "en"), (8, own[6] + " €", "en")]
    table = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("rid", "root", "rank", "first", "size", "body", "score", "lang_pred", "ids", "bytes", "gone", "n"):
        table = table.withColumn(c, F.lit("x"))
    table.write.parquet(f"{tmp_path}/some/documents.parquet")
    table.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert p.run(spark, f"{tmp_path}/none").count() == 0
    found = p.run(spark, f"{tmp_path}/some").collect()
    tokens = {}
    for r in found:
        tokens.setdefault(r["doc_id"], set()).add(r["doc_tokens"])
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = lambda x: len(t.encode(x, add_special_tokens=False).ids) + 1
    assert tokens == {None: {n(own[0])}, 3: {n(own[1]), n(own[2])}, 4: {n(own[3])}, 5: {n(long)}, 8: {n(own[6] + " €")}}
    assert sum(r["length"] for r in found if r["doc_id"] == 3) == n(own[1]) + n(own[2])  # the repeated row is there once


def odd_rows():
    """Null and shared ids, repeated rows, a very long text and a very long line; texts that are like others have ids of their own."""
    rnd = random.Random(4)
    word = lambda: f"w{rnd.randrange(10_000)}"
    line = lambda n: " ".join(word() for _ in range(n))
    shared = [line(30) for _ in range(4)]
    long = "\n".join(line(25) for _ in range(3000))
    rows = [(9, "\n".join([line(20), shared[0], line(20)])), (2, shared[0] + "!"), (5, shared[1]), (7, shared[1].upper()), (None, line(40)), (None, None), (None, ""), (4, line(30)), (4, line(30)), (6, shared[2]), (6, shared[2]), (11, shared[2] + "\n" + shared[3]), (12, long), (13, long + "\n" + shared[3]), (14, "y" * 300_000 + " " + line(50_000))]
    return rows


def test_lines_of_odd_rows(spark):
    rows = odd_rows()
    table = spark.createDataFrame([(i, t, "a", 0) for i, t in rows], "doc_id long, text string, norm string, lid int")
    ordered = sorted(dict.fromkeys(rows), key=lambda r: (r[0] is None, r[0] or 0))  # equal rows are one
    plain = left_lines([(k, t) for k, (_, t) in enumerate(ordered)])
    want = sorted((str(ordered[k][0]), *plain[k]) for k in (ordered.index(r) for r in rows))
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_removed"], r["text"]) for r in line_dedup.line_dedup(table).collect()) == want


def test_lines_that_share_a_name_stay_apart(spark, monkeypatch):
    """Names whose first half is the same for all lines of a length: blocks hold more lines, results are the same."""
    rows = [(i, t) for i, t in odd_rows() if i is not None and i < 12]
    rows = list(dict.fromkeys(rows))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    whole = line_dedup.digest
    plain = left_lines(sorted(rows))
    monkeypatch.setattr(line_dedup, "digest", lambda line: (len(line) // 8).to_bytes(8, "little") + whole(line)[8:])
    assert {r["text"]: (r["n_lines"], r["n_removed"]) for r in line_dedup.line_dedup(table).collect()}.keys() >= {t for *_, t in plain.values()}


def test_join_of_odd_rows(spark):
    rows = odd_rows()
    table = spark.createDataFrame([(i, t, "a", 0) for i, t in rows], "doc_id long, text string, sid string, root int")
    plain = brute.ngram_join(list(enumerate(t for _, t in rows)))
    groups: dict[int, list] = {}
    for k, (_, c) in plain.items():
        groups.setdefault(c, []).append(rows[k][0])
    first = {c: min((i for i in ids if i is not None), default=None) for c, ids in groups.items()}
    want = sorted((str(rows[k][0]), n, str(first[c])) for k, (n, c) in plain.items() if first[c] is not None)
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in ngram_join.ngram_jaccard_join(table).collect())
    assert len(got) == len(rows) and [g for g in got if g[0] != "None"] == [w for w in want if w[0] != "None"]


def test_chats_of_very_long_turns(spark):
    long = "word " * 100_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", "yes"), (2, 0, "user", long), (3, 0, "user", long + "!"), (3, 0, "user", long + "!")]
    found = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert sorted(found) == [1, 3] and found[1]["n_turns"] == 2 and len(found[1]["rendered"]) > len(long)


def test_pipeline_runs_over_the_table(spark):
    import corpus_pipeline as p

    found = p.run(spark, SF)
    assert found.count() == found.select("sequence_id").distinct().count() > 0


def test_pipeline_decides_by_row(spark):
    import corpus_pipeline as p

    own = [" ".join(f"v{i}u{k}" for k in range(60)) for i in range(4)]
    rows = [(None, own[0]), (None, own[0] + " tail"), (5, own[1]), (5, own[1] + " tail"), (6, own[2]), (7, own[2] + " tail"), (7, own[3])]
    docs = spark.createDataFrame([(i, t, None, None, 5) for i, t in rows], ", ".join(f"{c} {k}" for c, k in zip(p.COLUMNS, ("long", "string", "string", "string", "long"), strict=True)))
    assert p.identify_languages(spark, docs, SF).count() == len(rows)
    left = sorted(r["text"].split(" ")[0] for r in p.join_near_copies(spark, docs, SF).collect())
    assert left == ["v0u0", "v1u0", "v2u0", "v3u0"]
