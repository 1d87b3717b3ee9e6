"""Tokens, packing, languages, chats, licenses and quality on small inputs with nulls, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import json
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortspark.llm import bpe, chat, langid, licenses, packing, quality_rules, queries
from tests.llm import brute

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "a", "a  b", "\n \n", "x \n", "don't\tstop", "<|endoftext|> x<|endoftext|>", "é日本🙂  b", "a" * 5000, "word " * 3000, "\x00\x1c\x85", "1²½ Ⅷ"]


def docs(spark, texts=ODD, more=""):
    rows = [(i, t, 7, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids int, rid string")


def test_tokens_match_the_library(spark):
    t = Tokenizer.from_file(PATH)
    want = {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(ODD)}
    encoded = bpe.bpe_encode(docs(spark), PATH)
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()} == want
    assert {r["doc_id"]: r["text"] for r in bpe.bpe_decode(encoded, PATH).collect()} == {i: t.decode(x, skip_special_tokens=False) for i, x in want.items()}
    assert bpe.bpe_encode(docs(spark).limit(0), PATH).count() == 0


def test_other_tokenizers_are_refused():
    model = json.loads(bpe.tokenizer_spec(PATH))
    for change in ({"pre_tokenizer": {"type": "Whitespace"}}, {"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True}}):
        with pytest.raises(ValueError, match="byte-level"):
            bpe.BytePairCoder(json.dumps(model | change))


def test_round_trip_query(spark):
    t = Tokenizer.from_file(PATH)
    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op2_bpe(spark, SF).collect():
        ids = t.encode(rows[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(rows[r["doc_id"]].encode()).hexdigest()


@pytest.mark.parametrize("source", ["odd", "table"])
def test_packing_covers_every_token_once(spark, source):
    t = Tokenizer.from_file(PATH)
    table = docs(spark) if source == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in table.collect()}
    found = packing.pack(table, PATH).collect()
    by_doc: dict[int, list] = {}
    for r in found:
        by_doc.setdefault(r["doc_id"], []).append(r)
        assert r["offset"] == 0 and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 1024
    assert sorted(r["sequence_id"] for r in found) == list(range(len(found)))
    lengths = [r["length"] for r in sorted(found, key=lambda r: r["sequence_id"])]
    assert lengths == sorted(lengths)
    for i, text in texts.items():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted(by_doc[i], key=lambda r: r["start"])
        assert pieces[0]["doc_tokens"] == len(ids) == sum(p["length"] for p in pieces)
        at = 0
        for p in pieces:
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]


def test_languages_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    found = queries.op5_language_id(spark, d).collect()
    held = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) > 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_languages_are_those_of_a_plain_naive_bayes(spark):
    """Dictionaries of n-grams instead of arrays of buckets; scores differ by the few n-grams that share a bucket."""
    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/documents.parquet").collect()

    def grams(text):
        t = "".join(c if c.isalpha() else " " for c in (text or "").lower())
        t = re.sub(" +", " ", f" {t} ") if any(c != " " for c in t) else ""
        return [t[i : i + n] for n in range(1, langid.ORDERS + 1) for i in range(len(t) - n + 1)]

    counts: dict[str, dict[str, int]] = {}
    for r in rows:
        if r["lang"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1:
            for g in grams(r["text"]):
                own = counts.setdefault(r["lang"], {})
                own[g] = own.get(g, 0) + 1
    total = {x: sum(c.values()) + 0.1 * (1 << langid.BITS) for x, c in counts.items()}
    found = {r["doc_id"]: r["lang_pred"] for r in queries.op5_language_id(spark, d).collect()}
    agree = known = 0
    for r in rows:
        g = grams(r["text"])
        if not g:
            assert found[r["doc_id"]] == "und"
            continue
        known += 1
        best = max(sorted(counts), key=lambda x: sum(np.log((counts[x].get(k, 0) + 0.1) / total[x]) for k in g))
        agree += best == found[r["doc_id"]]
    assert known > 150 and agree >= 0.99 * known


def test_languages_of_odd_texts(spark):
    rows = [(1, "the cat sat on the mat", "en", 1), (2, "le chat est sur la table", "fr", 1), (3, "dans la maison", "fr", 1), (4, None, "en", 1), (5, "12 !?", "en", 1), (6, "", None, 1), (None, "the mat", None, 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(table, langid.fit(table)).collect()}
    assert found[1][0] == "en" and found[2][0] == "fr" and found[None][0] == "en"
    assert found[4] == found[5] == found[6] == ("und", 0.0)
    assert langid.language_id(table.limit(0)).count() == 0
    unlabelled = table.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.language_id(unlabelled).collect()} == {"und"}
    with pytest.raises(ValueError, match="more than 1 languages"):
        langid.fit(table, most_languages=1)


def test_chats_collapse_to_maximal_conversations(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (3, 0, "user", "hi"), (3, 1, "assistant", "yes"), (4, 0, "user", "hi"), (4, 1, "assistant", "no"), (5, 0, None, None), (None, 0, "user", "hi"), (6, None, "user", "hi"), (7, 1, "assistant", "yes"), (7, 0, "user", "hi"), (8, 0, "assistant", "yes"), (8, 1, "user", "hi")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, pos string")
    found = {r["conv_id"]: (r["n_turns"], r["n_copies"], r["rendered"]) for r in chat.format_chats(table).collect()}
    assert {i: f[:2] for i, f in found.items()} == {2: (2, 3), 4: (2, 1), 5: (1, 1), 8: (2, 1)}
    assert found[4][2] == "<|user|>\nhi\n<|end|>\n<|assistant|>\nno\n<|end|>\n"
    assert found[5][2] == "<|unknown|>\n\n<|end|>\n"
    assert chat.format_chats(table.limit(0)).count() == 0


def nine(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower_ascii(t or ""))
    at, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        k = phrase.split()
        for i in range(len(w) - len(k) + 1):
            if w[i : i + len(k)] == k:
                at.append(i)
                labels.add(label)
    extra = set()
    for line in (t or "").split("\n"):
        words = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower_ascii(line)))
        for label, template in licenses.TEMPLATES:
            wanted = set(template.split())
            if len(words & wanted) >= licenses.CONTAINED * len(wanted) - 1e-9:
                extra.add(label)
    return (len(w), len(at), min(at) if at else None, max(at) if at else None, ",".join(sorted(labels)), ",".join(sorted(labels | extra)))


def test_licenses_match_a_plain_scan(spark):
    texts = [None, "", "cc by cc by", "CC-BY 4.0", "a cc by\nx General  Public License, all rights reserved.", "Released under the MIT License.", "under license MIT the released", "Licensed under CC BY-NC 4.0.", "ÀCC BY", "cc bye", "all rights all rights reserved", *ODD]
    table = docs(spark, texts)
    got = {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) for r in licenses.license_scan(table).collect()}
    assert got == {i: nine(t) for i, t in enumerate(texts)}
    assert licenses.license_scan(table.limit(0)).count() == 0
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) for r in queries.op9_license_scans(spark, SF).collect()}
    assert got == {i: nine(t) for i, t in rows.items()}


def seven(t):
    w = brute.WORD.findall(t or "")
    places: dict[tuple, list[int]] = {}
    for i in range(len(w) - 2):
        places.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(3)}
    lines = [x for x in (t or "").split("\n") if brute.WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))


def test_quality_counts_and_verdicts(spark):
    texts = [*ODD, "a b c", "a a a a", "a b a b a", "a b c a b c", "x\n\nx\n x\nx", "a b c d " * 40, "#$ | <b>"]
    normal = [" ".join(f"w{(i * 7 + k * k) % 997}x{k}" for k in range(80)) for i in range(60)]
    loud = " ".join(f"##${k}%%&&**||<<>>#{k}##" for k in range(90))
    every = [*texts, *normal, loud]
    rows = [(i, t, "en", "s" if i % 2 else None, 3) for i, t in enumerate(every)]
    rows = [(i, t, "en", None, 3) if i >= len(texts) else r for i, t, *_ in rows for r in [rows[i]]]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, d int")
    found = {r["doc_id"]: r for r in quality_rules.quality_rules(table).collect()}
    for i, t in enumerate(every):
        r = found[i]
        n = seven(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r["base_failed"] and r["kept"])
    assert all(found[len(texts) + k]["kept"] for k in range(60))
    assert not found[len(every) - 1]["kept"]
    assert quality_rules.quality_rules(table.limit(0)).count() == 0


def test_estimates_are_a_smallest_determinant(spark):
    """With a quarter of outliers to one side: no step of the plain method changes the estimates, and no start of a plain search finds a smaller determinant."""
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(400, 4)) @ np.array([[0.5, 0.1, 0, 0], [0, 0.4, 0.1, 0], [0, 0, 0.6, 0.2], [0, 0, 0, 0.3]])
    x[:90] = x[:90] * 0.3 + [4, 4, 0, 0]
    table = spark.createDataFrame([("en", "s", *map(float, r)) for r in x], "lang string, source string, x0 double, x1 double, x2 double, x3 double")
    _, best = quality_rules.pool_estimates(table)
    own = best.where("pool.level = 0").drop("pool").withColumns({"of_lang": F.lit("en"), "of_source": F.lit("s")})
    judged = quality_rules.with_distance(quality_rules.with_estimates(table, own), "d").select("d", "x0", "x1", "x2", "x3", "det").collect()
    got = {tuple(r[1:5]): r["d"] for r in judged}

    def step(m, c):
        d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c + np.eye(4) * quality_rules.FLOOR), x - m)
        near = x[d <= np.quantile(d, quality_rules.SUPPORT, method="inverted_cdf")]
        return near.mean(axis=0), np.cov(near.T, bias=True) * quality_rules.CONSISTENT

    def settled(m, c):
        for _ in range(60):
            m, c = step(m, c)
        return np.linalg.det(c + np.eye(4) * quality_rules.FLOOR), m, c

    lower = np.quantile(x, 0.5, axis=0, method="inverted_cdf")
    tries = [settled(lower, np.diag((np.quantile(np.abs(x - lower), 0.5, axis=0, method="inverted_cdf") * 1.4826) ** 2)), settled(x.mean(axis=0), np.cov(x.T, bias=True))]
    for _ in range(20):
        some = x[rnd.choice(400, 12, replace=False)]
        tries.append(settled(some.mean(axis=0), np.cov(some.T, bias=True)))
    det, m, c = min(tries, key=lambda t: t[0])
    assert judged[0]["det"] <= det * (1 + 1e-6)
    far = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c + np.eye(4) * quality_rules.FLOOR), x - m)
    assert np.allclose([got[tuple(map(float, r))] for r in x], far, rtol=1e-5)
    assert far[:90].min() > quality_rules.LIMIT > np.quantile(far[90:], 0.99)


def test_quality_query_follows_counts_and_distances(spark):
    """Counts of the query over its table are those of a plain version, and verdicts those of base rules and distance."""
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = queries.op7_quality_rules(spark, SF).collect()
    assert {r["doc_id"] for r in found} == set(rows)
    for r in found:
        n = seven(rows[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert r["kept"] == (not r["base_failed"] and r["distance"] <= quality_rules.LIMIT)


def test_repeated_words_of_long_texts(spark):
    rnd = np.random.default_rng(2)
    texts = [" ".join(f"w{k}" for k in rnd.integers(0, top, n)) for n, top in ((4095, 30), (4096, 30), (9000, 60), (20000, 3000), (50000, 2))]
    table = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.base_counts(table).collect()}
    assert got == {i: seven(t)[4] for i, t in enumerate(texts)}


def test_estimates_are_drawn_together_by_their_weights(spark):
    rnd = np.random.default_rng(5)
    groups = {("en", "a"): 80, ("en", None): 9, (None, "a"): 2}
    rows = [(*g, *map(float, rnd.normal(k, 1 + k, 4))) for k, (g, n) in enumerate(groups.items()) for _ in range(n)]
    table = spark.createDataFrame(rows, "lang string, source string, x0 double, x1 double, x2 double, x3 double")
    pools, best = quality_rules.pool_estimates(table)
    own = {(r["pool"]["level"], r["pool"]["lang"], r["pool"]["source"]): r for r in best.collect()}
    assert len(own) == 3 + 2 + 1
    weight = lambda r: r["n_group"] / (r["n_group"] + quality_rules.DRAWN)
    for r in quality_rules.drawn_together(pools, best).collect():
        lang, source = r["of_lang"], r["of_source"]
        chain = [own[0, lang, source], own[1, lang, None], own[2, None, None]]
        assert r["n_group"] == groups[lang, source] == chain[0]["n_group"]

        def drawn(name, chain=chain, damp=1.0):
            value = chain[2][name] * damp
            for e in (chain[1], chain[0]):
                value = weight(e) * e[name] + (1 - weight(e)) * value
            return value

        c = np.array([[drawn(quality_rules.covariance_name(i, j), damp=1.0 if i == j else weight(chain[2])) for j in range(4)] for i in range(4)])
        factor = np.linalg.cholesky(c + np.eye(4) * quality_rules.FLOOR)
        assert np.allclose([r[f"m{i}"] for i in range(4)], [drawn(f"m{i}") for i in range(4)])
        assert np.allclose([r[f"l{i}{j}"] for i in range(4) for j in range(i + 1)], [factor[i, j] for i in range(4) for j in range(i + 1)])


def test_small_groups_are_judged_by_larger_ones(spark):
    normal = [" ".join(f"w{(i * 7 + k * k) % 997}x{k}" for k in range(80)) for i in range(43)]
    loud = " ".join(f"##${k}%%&&**||<<>>#{k}##" for k in range(90))
    place = [("en", "large")] * 40 + [("en", "rare"), (None, "large"), (None, None)]
    rows = [(i, t, *p) for i, (t, p) in enumerate(zip(normal, place, strict=True))]
    rows += [(100 + i, loud, *p) for i, p in enumerate([("en", "rare"), (None, "large"), (None, None), ("xx", "rare")])]
    found = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(r["distance"] is not None for r in found.values())
    assert {i for i, r in found.items() if not r["kept"]} == {100, 101, 102, 103}


def test_small_shares_of_junk_are_outliers(spark):
    """A share of symbols of a seventh, or of repeated lines of a third, stands out where other texts have none; a few repeated words among texts that have some do not."""
    words = lambda i: [f"w{(i * 7 + k * k) % 997}x{k}" for k in range(80)]
    few = lambda i: [*words(i), "so", "we", "go", *words(i)[:9], "so", "we", "go"] if i % 3 == 0 else words(i)
    rows = [(i, " ".join(few(i)), "en", "s") for i in range(120)]
    rows.append((200, " ".join(w + ("|" if k % 5 else "") for k, w in enumerate(words(200))), "en", "s"))
    rows.append((201, "\n".join([*(" ".join(words(201)[k * 13 : k * 13 + 13]) for k in range(6)), "x", "y", "x", "y", "x"]), "en", "s"))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r["doc_id"]: r for r in quality_rules.quality_rules(table).collect()}
    assert not any(r["base_failed"] for r in found.values())
    assert 0.1 < found[200]["n_symbols"] / found[200]["word_chars"] < 0.2
    assert {i for i, r in found.items() if not r["kept"]} == {200, 201}


def test_licenses_are_found_across_lines_but_not_from_scattered_words(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy"
    other = " ".join(f"word{i}" for i in range(40))
    scattered = f" {other} ".join(["released", "under", "the", "mit", "license"])
    twice = f"{mit} {other} {mit}"
    texts = [mit, bsd, mpl, scattered, twice, f"{other} {bsd}", f"{mpl}\n{other}\n{bsd}", "Released under\nthe terms of the MIT\nlicense"]
    got = {r["doc_id"]: (r["labels"], r["n_blocks"]) for r in licenses.license_scan(docs(spark, [*texts, *texts])).collect()}
    want = [("mit", 1), ("bsd", 1), ("mpl-2.0", 1), ("", 0), ("mit", 2), ("bsd", 1), ("bsd,mpl-2.0", 2), ("mit", 1)]
    assert got == dict(enumerate([*want, *want]))
    rows = [(1, mit, 7, "x")] * 3
    assert [r["n_blocks"] for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string, ids int, rid string")).collect()] == [1, 1, 1]


def test_positional_filter_cuts_what_cannot_meet_the_threshold(spark):
    """Of words in the corpus' order, a text whose first common word with a template comes late, or is late in the template, has too few left."""
    df = {w: i for i, w in enumerate(licenses.KNOWN)}
    t = licenses.Templates(df, licenses.CONTAINED)
    place = t.ordered.index
    before = lambda i: [w for w in t.ordered[: place(t.prefix[i][-1])] if w not in t.words[i]]
    longest = next(i for i in range(len(t.words)) if len(before(i)) >= t.least[i] > 2)
    words, least = t.words[longest], t.least[longest]
    late = [*before(longest)[:least], t.prefix[longest][-1]]  # the last word of the prefix, with nothing after it
    rows = spark.createDataFrame([(1, words), (2, late), (3, words[: least - 1])], "rid long, held array<string>")
    pairs = lambda positional: {r["rid"] for r in licenses.candidates(rows, t, positional).where(f"template = {longest}").collect()}
    assert pairs(True) == {1} and pairs(False) == {1, 2}


def test_scores_and_blocks_are_those_of_plain_windows(spark):
    """Windows of all templates over every document, one by one."""
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    odd = ["Permission is hereby granted, to any person, free of charge, obtaining a copy of this software", "gnu lesser public license version", None, "unless " + "required by applicable law or agreed to in writing software distributed under the license is distributed on an as is " * 2]
    table = docs(spark, [*rows.values(), *odd])
    got = {r["doc_id"]: (r["score"], r["n_blocks"]) for r in licenses.license_scan(table).collect()}
    for i, text in enumerate([*rows.values(), *odd]):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower_ascii(text or ""))
        score, blocks = 1.0 if nine(text)[1] else 0.0, 0
        for _, template in licenses.TEMPLATES:
            own = set(template.split())
            width, last = licenses.WINDOW * len(template.split()), None
            if len(own & set(w)) < licenses.CONTAINED * len(own) - 1e-9:
                continue
            for a in range(len(w)):
                n = len(own & set(w[a : a + width]))
                if n >= licenses.CONTAINED * len(own) - 1e-9:
                    score = max(score, n / len(own))
                    blocks += last is None or a - last >= width
                    last = a
        assert got[i][0] == pytest.approx(score), i
        assert (got[i][1] > 0) == (blocks > 0), i


@pytest.mark.parametrize("name", ["op2_bpe", "op5_language_id", "op6_packing", "op7_quality_rules", "op9_license_scans"])
def test_nulls_repeated_rows_empty_tables_and_other_columns(spark, tmp_path, name):
    """Null ids and texts, rows that repeat, two texts under one id, a very long text and word, and columns named as those of results."""
    long = "word and other words " * 20_000 + "x" * 300_000
    rows = [(None, "the null one has words", "en", "s"), (None, None, None, None), (5, "the same text of the same id", "en", "s"), (5, "the same text of the same id", "en", "s"), (5, "another one", "fr", None), (6, long, "en", "s"), (7, "", "en", "s")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for c in ("rid", "sid", "n_words", "score", "labels", "kept", "d", "start", "length", "words", "pool", "held"):
        table = table.withColumn(c, F.lit("x"))
    table.write.parquet(f"{tmp_path}/some/documents.parquet")
    table.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    run = queries.QUERIES[name]
    assert run(spark, f"{tmp_path}/none").count() == 0
    found = run(spark, f"{tmp_path}/some").collect()
    by_id: dict = {}
    for r in found:
        by_id.setdefault(r["doc_id"], []).append(tuple(v for k, v in r.asDict().items() if k not in ("doc_id", "sequence_id")))
    if name == "op6_packing":
        assert sum(r["length"] for r in found if r["doc_id"] == 6) == max(r["doc_tokens"] for r in found if r["doc_id"] == 6) > 50_000
        assert sorted(r["sequence_id"] for r in found) == list(range(len(found)))
        assert [r["length"] for r in found if r["doc_id"] == 7] == [1]
    else:
        assert {k: len(v) for k, v in by_id.items()} == {None: 2, 5: 3, 6: 1, 7: 1}
        assert len(set(by_id[5])) <= 2


def test_repeated_windows_of_texts_are_compared_with_the_next_alone(spark):
    texts = ["", "a b", "a b c", "a b c a b c", "a a a a", "x a b c y a b c z a b c", " ".join(f"w{i % 1000}" for i in range(4095)), " ".join(f"w{i}" for i in range(4095)), " ".join(f"w{i % 1000}" for i in range(4096))]

    def plain(words):
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        return len({j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)})

    found = spark.createDataFrame(enumerate(texts), "i int, t string").select("i", quality_rules.repeated_words(F.filter(F.split("t", " "), lambda w: w != "")).alias("n"))
    assert "bin(" not in found._jdf.queryExecution().analyzed().toString()
    assert {r["i"]: r["n"] for r in found.collect()} == {i: plain(t.split()) for i, t in enumerate(texts)}
