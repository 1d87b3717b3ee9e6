"""License scans: exact set-similarity join of text blocks with templates.

Native: DataFrame operations only.

Words are runs of digits, letters and all characters beyond ASCII; A-Z count as
a-z. A template is a fixed sentence, a block a window of ``WINDOW`` times as many
successive words of a text, across its line ends; windows start at every word.
Every block whose set of words contains at least ``CONTAINED`` of a template's
words is found. The filters first find the texts that hold so many of a template's
words anywhere, then the windows around its rarest words in those:

* words of templates are put in one order for all, by the number of documents
  that hold them over the whole corpus, rarest first;
* prefix filter: a text or block that holds ``a`` of a template's ``n`` words in this order
  holds one of its first ``n - a + 1``, so only those are joined on;
* length filter: a text or block with fewer than ``a`` words of all templates goes first;
* positional filter: from the first common word on, in this order, both the template
  and what the text holds of all templates' words must have ``a`` words left.

Every text is read once for its counts and the templates' words that it holds; only
those that pass the filters are read again for their windows. Beside it stand the
base phrases, whose words must follow one another.

Defined results: a null or empty text has no words, no places and score 0; very long
texts are read whole; ties in score change nothing; a null id is an id like others;
rows that repeat have equal results; an empty table gives an empty result; columns
that are not named are never read, so extra ones cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm._common import folded, keyed, materialize, row_key

#: What separates words: ASCII but for digits and lower-case letters. Fixed value.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels. Fixed values.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Templates of statements and their labels, as words: sentences of well-known licenses and the names by which texts refer to them. Fixed values.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license version"),
    ("agpl", "gnu affero general public license version"),
    ("gfdl", "under the terms of the gnu free documentation license version 1 3"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("cc0", "cc0 1 0 universal public domain dedication"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("epl-2.0", "made available under the terms of the eclipse public license v 2 0"),
    ("bsl-1.0", "distributed under the boost software license version 1 0"),
    ("zlib", "this software is provided as is without any express or implied warranty"),
    ("artistic-2.0", "under the terms of the artistic license 2 0"),
    ("ofl-1.1", "licensed under the sil open font license version 1 1"),
    ("odbl", "made available under the open database license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: Least share of a template's words.
CONTAINED = 0.9
#: Words of a window for each word of the template: room for as many others in between.
WINDOW = 2


def spaced(text: Column) -> Column:
    """The words, each between single spaces; a space alone if there are none."""
    words = F.trim(F.regexp_replace(folded(F.coalesce(text, F.lit(""))), GAP, " "))
    return F.when(words == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def n_spaces(text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def phrase_columns(words: Column, n_words: Column, phrase: str) -> tuple[Column, Column, Column]:
    """Number of places of a phrase, and the first and last word at which it starts (null without one)."""
    wanted, size = f" {phrase} ", len(phrase.split(" "))
    held = words.contains(wanted)
    count = F.when(held, F.regexp_count(words, F.lit(f" {phrase}(?= )")).cast("long")).otherwise(F.lit(0).cast("long"))
    before = lambda text, part: n_spaces(F.substring_index(text, part, 1))
    first = F.when(held, before(words, wanted))
    last = F.when(held, n_words - size - before(F.reverse(words), wanted[::-1]))
    return count, first, last


class Templates:
    """Templates with their words in the corpus' order: ``ordered`` of all, and by template the words, the least number of them, and the prefix."""

    def __init__(self, df: dict[str, int], contained: float) -> None:
        rank = lambda w: (df.get(w, 0), w)
        self.ordered = sorted(KNOWN, key=rank)
        self.words = [sorted(set(text.split(" ")), key=rank) for _, text in TEMPLATES]
        self.least = [math.ceil(len(w) * contained - 1e-9) for w in self.words]
        self.prefix = [w[: len(w) - n + 1] for w, n in zip(self.words, self.least, strict=True)]

    def of(self, values: list) -> Column:
        """The value of the row's ``template``."""
        return F.element_at(F.array(*(F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v) for v in values)), F.col("template") + 1)

    def prefixes(self, spark: SparkSession) -> DataFrame:
        """``template, word, place``: a few hundred rows."""
        return spark.createDataFrame([(t, w, i) for t, words in enumerate(self.prefix) for i, w in enumerate(words)], "template int, word string, place int")


#: All words of templates.
KNOWN = sorted({w for _, t in TEMPLATES for w in t.split(" ")})


def candidates(held: DataFrame, templates: Templates, positional: bool = True) -> DataFrame:
    """``rid, template, held`` (in the corpus' order) of texts ``rid, held`` that pass the filters, each pair once."""
    ordered = held.where(F.size("held") >= min(templates.least)).select("rid", F.array_intersect(F.array(*map(F.lit, templates.ordered)), "held").alias("held"))
    met = ordered.select("rid", "held", F.posexplode("held").alias("pos", "word")).join(F.broadcast(templates.prefixes(held.sparkSession)), "word")
    first = met.where(F.size("held") >= templates.of(templates.least)).groupBy("rid", "held", "template").agg(F.min("place").alias("place"), F.min("pos").alias("pos"))
    left = F.least(templates.of([len(w) for w in templates.words]) - F.col("place"), F.size("held") - F.col("pos"))
    return (first.where(left >= templates.of(templates.least)) if positional else first).select("rid", "template", "held")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", contained: float = CONTAINED) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks``; ``n_blocks``: places where a template is found; windows that overlap are one."""
    base = keyed(docs, id_col, text_col)
    base = base.withColumn("rid", row_key(base))
    lined = base.select("rid", "doc_id", spaced(F.col("text")).alias("words"))
    n_words = F.when(F.col("words") == " ", F.lit(0).cast("long")).otherwise(n_spaces(F.col("words")) - 1)
    counted = lined.select("rid", "doc_id", "words", n_words.alias("n_words"))
    parts = {p: phrase_columns(F.col("words"), F.col("n_words"), p) for p in PHRASES}
    n_base = sum((c for c, _, _ in parts.values()), F.lit(0).cast("long"))
    labels = F.array_sort(F.array_compact(F.array(*(F.when(c > 0, F.lit(PHRASES[p])) for p, (c, _, _) in parts.items()))))
    held = F.array_intersect(F.split("words", " "), F.array(*map(F.lit, KNOWN)))
    scanned = materialize(counted.select("rid", "doc_id", "n_words", n_base.alias("n_base"), F.least(*(f for _, f, _ in parts.values())).alias("first_word"), F.greatest(*(x for _, _, x in parts.values())).alias("last_word"), labels.alias("base"), held.alias("held")))
    found = blocks_found(base.select("rid", "text"), scanned.select("rid", "held"), contained)
    joined = scanned.join(found, "rid", "left")
    both = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("score", F.lit(0.0)))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), score.alias("score"), F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"))


def blocks_found(texts: DataFrame, held: DataFrame, contained: float) -> DataFrame:
    """``rid, found, score, n_blocks`` of the texts (``rid, text``) with a window that meets a template's threshold; ``held`` has the templates' words of each."""
    df = {r["word"]: r["df"] for r in held.select(F.explode("held").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")).collect()}  # one row for each word of a template at most
    templates = Templates(df, contained)
    ordered, least = templates.of(templates.words), templates.of(templates.least)
    wanted = materialize(candidates(held, templates).where(F.size(F.array_intersect("held", ordered)) >= least).select("rid", "template"))
    # Their windows: each that meets the threshold has a word of the prefix, so only those around such words are looked at
    again = texts.join(wanted, "rid").dropDuplicates(["rid", "template"])
    split = again.select("rid", "template", F.split(F.trim(spaced(F.col("text"))), " ").alias("words"), templates.of([WINDOW * len(t.split(" ")) for _, t in TEMPLATES]).alias("width"))
    places = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(templates.of(templates.prefix), w), i)), lambda i: i.isNotNull())
    placed = split.withColumn("at", F.explode(places))
    begin = F.greatest(F.col("at") - F.col("width") + 1, F.lit(0))
    near = placed.select("rid", "template", "width", "at", begin.alias("begin"), F.slice("words", begin + 1, F.col("at") - begin + F.col("width")).alias("around"))
    near = near.where(F.size(F.array_intersect("around", ordered)) >= least)
    common = lambda start: F.size(F.array_intersect(F.slice("around", start - F.col("begin") + 1, F.col("width")), ordered))
    windows = near.withColumn("start", F.explode(F.sequence("begin", "at"))).withColumn("share", common(F.col("start"))).where(F.col("share") >= least)
    best = windows.groupBy("rid", "template", "width").agg(F.array_sort(F.collect_set("start")).alias("starts"), F.max("share").alias("share"))
    apart = F.filter("starts", lambda x, i: (i == 0) | (x - F.get("starts", i - 1) >= F.col("width")))
    label, size = templates.of([label for label, _ in TEMPLATES]), templates.of([len(w) for w in templates.words])
    return best.select("rid", label.alias("label"), (F.col("share") / size).alias("share"), F.size(apart).alias("n")).groupBy("rid").agg(F.collect_set("label").alias("found"), F.max("share").alias("score"), F.sum("n").alias("n_blocks"))
