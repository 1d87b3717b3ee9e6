"""Quality rules with robust multivariate outliers.

Native: DataFrame operations only.

Base rules count words, symbols, repeated lines and repeated three-word windows.
Texts that pass them are then judged within their language and source: their
statistics, transformed to near-normal scales, are vectors whose centre and
covariance come from minimum-covariance-determinant estimates. From several starts
(the coordinates' medians and median absolute deviations, all vectors, and subsets by
hash) concentration steps take the ``SUPPORT`` nearest vectors by Mahalanobis distance
and estimate anew. After ``TRIED`` steps the start with the smallest determinant stays,
and goes on until its determinant no longer shrinks. A text is rejected whose squared
distance exceeds ``LIMIT``.

The steps are grouped aggregates of sums and of approximate percentiles, which
Spark combines before the shuffle, so a source with a third of all rows is no
heavier than others; distances come from a Cholesky factor written out as column
expressions. Only estimates (a row for each language and source) are joined back.
What judges a group is drawn towards the estimates of its language, and these towards
those of all texts, each by ``DRAWN`` vectors' worth: an estimate that rests on n vectors
weighs n / (n + DRAWN), so no number of texts switches from one estimate to another.

Defined results: null texts have no words and fail the base rules; null language
and null source are groups of their own; every text that passes the base rules has a
distance; covariances of all texts weigh n / (n + DRAWN) as well, so those of a few
vectors count for little; a coordinate that is tied for half of a
group's vectors or more has at least the variance of its corpus-wide median
absolute deviation, or where that is 0 too, of its corpus-wide mean absolute
deviation, so a rare value is far where it is far for the corpus; a coordinate
constant in the corpus rejects nothing; very long texts are counted whole; a null id is an id
like others; repeated rows have equal results; an empty table gives an empty result; columns that are
not named are never read, so extra ones cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm._common import WORD_GAP, keyed, materialize

SYMBOLS = "#*$%&|<>"
#: Share of the vectors that an estimate rests on, concentration steps of all starts, most steps, and the share by which a determinant must still shrink.
SUPPORT, TRIED, STEPS, SHRINKS = 0.75, 2, 20, 1e-6
#: Of so many parts by hash two are starts of their own.
SUBSETS = 8
#: Words from which repeated windows are found by 128 bits of hash and a number beside them, rather than by a hash and a place in one number of 64 bits and the words themselves.
MANY_WORDS = 4096
#: Added to each variance, so that a change of word length by 1 % or a share of 1 in 10,000 counts for little even where vectors hardly differ; and the number of vectors that weigh as much as the wider estimate.
FLOOR, DRAWN = 1e-4, 300
#: Squared distance of rejection: the 0.9999 quantile of chi-squared with four degrees.
LIMIT = 23.5127
#: Make the median and the mean absolute deviation the standard deviation, for normal data.
NORMAL_MEDIAN, NORMAL_MEAN = 1.4826, 1.2533
#: Makes the variance of the nearest three quarters that of all, for normal data in four dimensions.
CONSISTENT = 1.6


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that stand twice or more in the text.

    Windows are sorted by hash, then place, so equal ones are neighbours; the places
    of those that have an equal neighbour are sorted again, and each covers as many
    words as are left before the next. Short texts have hash (52 bits) and place in one
    number, which sorts faster; each is compared with the next alone, and by its words where hashes are equal.
    """
    hashed = lambda w, i, seed: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2), *seed)

    def covered(places: Column) -> Column:
        width = lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3).cast("long")))
        return F.aggregate(F.transform(places, width), F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(keys: Column, hash_of, place_of) -> Column:
        same = lambda k, other: F.coalesce(hash_of(F.get(keys, other)) == hash_of(k), F.lit(False))
        return F.sort_array(F.transform(F.filter(keys, lambda k, i: same(k, i - 1) | same(k, i + 1)), place_of))

    def short(w: Column) -> Column:
        bits = (MANY_WORDS - 1).bit_length()
        place = lambda k: k.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        window = lambda k: F.slice(w, place(k).cast("int") + 1, F.lit(3))
        keys = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: hashed(w, i, ()).bitwiseAND(F.lit(-(1 << bits)).cast("long")).bitwiseOR(i.cast("long"))))
        equal = lambda a, b: (F.shiftrightunsigned(a.bitwiseXOR(b), bits) == 0) & (window(a) == window(b))
        both = lambda k: F.zip_with(k, F.slice(k, F.lit(2), F.size(k)), lambda a, b: F.when(equal(a, b), F.array(place(a), place(b))))
        return let(keys, lambda k: let(F.sort_array(F.array_distinct(F.flatten(F.array_compact(both(k))))), covered))

    def long(w: Column) -> Column:
        keys = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.struct(hashed(w, i, ()).alias("a"), hashed(w, i, (F.lit(7),)).alias("b")).alias("hash"), i.cast("long").alias("place"))))
        return let(keys, lambda k: let(repeated(k, lambda x: x["hash"], lambda x: x["place"]), covered))

    return let(words, lambda w: F.when(F.size(w) < 3, F.lit(0).cast("long")).when(F.size(w) < MANY_WORDS, short(w)).otherwise(long(w)))


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed``."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    words = F.filter(F.split("text", WORD_GAP), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = named.select("*", words.alias("words"))
    counted = split.select(
        "doc_id", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", WORD_GAP, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.size(x).cast("long").alias("n_lines"))).alias("line"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "line.n_dup_lines", "n_repeat_words", "line.n_lines", failed.alias("base_failed"))


#: Coordinates: mean length of a word, and the shares of symbols, repeated lines and repeated words on square-root scales.
COORDINATES = ("x0", "x1", "x2", "x3")


def coordinates(counts: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return counts.withColumns({
        "x0": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        "x1": F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        "x2": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        "x3": F.sqrt(F.col("n_repeat_words") / n),
    })


def covariance_name(i: int, j: int) -> str:
    return f"c{min(i, j)}{max(i, j)}"


def with_factor(estimates: DataFrame, floor: float = FLOOR) -> DataFrame:
    """Adds ``l00`` to ``l33``, the Cholesky factor of the covariance ``c**`` with ``floor`` added to each variance. A column at a time, so each is computed once."""
    p = len(COORDINATES)
    for i in range(p):
        for j in range(i + 1):
            s = F.col(covariance_name(i, j)) + (F.lit(floor) if i == j else F.lit(0.0))
            for k in range(j):
                s = s - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            estimates = estimates.withColumn(f"l{i}{j}", F.sqrt(F.greatest(s, F.lit(floor / 10))) if i == j else s / F.col(f"l{j}{j}"))
    return estimates


def with_distance(vectors: DataFrame, name: str) -> DataFrame:
    """Adds the squared Mahalanobis distance from ``m*`` under the factor ``l**``, by forward substitution."""
    p = len(COORDINATES)
    for i in range(p):
        d = F.col(COORDINATES[i]) - F.col(f"m{i}")
        for k in range(i):
            d = d - F.col(f"l{i}{k}") * F.col(f"z{k}")
        vectors = vectors.withColumn(f"z{i}", d / F.col(f"l{i}{i}"))
    return vectors.withColumn(name, sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(p)), F.lit(0.0))).drop(*(f"z{i}" for i in range(p)))


def with_estimates(vectors: DataFrame, estimates: DataFrame) -> DataFrame:
    """Estimates are one row for each language and source; Spark sees their size and broadcasts them or not."""
    return vectors.join(estimates, vectors["lang"].eqNullSafe(estimates["of_lang"]) & vectors["source"].eqNullSafe(estimates["of_source"]), "left").drop("of_lang", "of_source")


def pools_of(vectors: DataFrame) -> DataFrame:
    """``of_lang, of_source, pools``: the pools of vectors that a group counts in: its own, its language's and that of all."""
    groups = vectors.select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source")).distinct()
    none = {c: F.lit(None).cast(vectors.schema[c].dataType).alias(c) for c in ("lang", "source")}
    pool = lambda level, lang, source: F.struct(F.lit(level).alias("level"), lang, source)
    own = pool(0, F.col("of_lang").alias("lang"), F.col("of_source").alias("source"))
    return groups.select("of_lang", "of_source", F.array(own, pool(1, F.col("of_lang").alias("lang"), none["source"]), pool(2, none["lang"], none["source"])).alias("pools"))


def drawn_together(pools: DataFrame, best: DataFrame) -> DataFrame:
    """``of_lang, of_source, n_group``, centre and factor of each group, from its own estimates, its language's and those of all by their weights."""
    p = len(COORDINATES)
    names = [f"m{i}" for i in range(p)] + [covariance_name(i, j) for i in range(p) for j in range(i + 1)]
    joined = pools
    for level in range(3):
        own = best.select(F.col("pool").alias(f"pool{level}"), F.col("n_group").alias(f"n{level}"), *(F.col(c).alias(f"{c}_{level}") for c in names))
        joined = joined.withColumn(f"pool{level}", F.col("pools")[level]).join(own, f"pool{level}")
    weight = lambda n: F.col(n) / (F.col(n) + DRAWN)
    off = {covariance_name(i, j) for i in range(p) for j in range(i)}
    columns = {}
    for c in names:
        value = F.col(f"{c}_2") * (weight("n2") if c in off else F.lit(1.0))
        for level in (1, 0):
            value = weight(f"n{level}") * F.col(f"{c}_{level}") + (1 - weight(f"n{level}")) * value
        columns[c] = value
    return with_factor(joined.select("of_lang", "of_source", F.col("n0").alias("n_group"), *(v.alias(c) for c, v in columns.items()))).drop(*(c for c in names if c.startswith("c")))


def with_spread(estimates: DataFrame, tied: DataFrame) -> DataFrame:
    """Variances of at least ``v*``, the corpus-wide ones of coordinates whose median deviation is 0 in the pool."""
    p = len(COORDINATES)
    return estimates.join(tied, "pool").withColumns({covariance_name(i, i): F.greatest(F.col(covariance_name(i, i)), F.col(f"v{i}")) for i in range(p)}).drop(*(f"v{i}" for i in range(p)))


def with_determinant(estimates: DataFrame) -> DataFrame:
    """``det``: the determinant of the covariance, from its factor."""
    root = F.lit(1.0)
    for i in range(len(COORDINATES)):
        root = root * F.col(f"l{i}{i}")
    return estimates.withColumn("det", root * root)


def from_members(members: DataFrame, tied: DataFrame, scale: float) -> DataFrame:
    """Estimates by ``pool`` and ``start`` from the vectors of each."""
    p = len(COORDINATES)
    sums = [F.avg(x).alias(f"m{i}") for i, x in enumerate(COORDINATES)]
    sums += [(F.covar_pop(COORDINATES[i], COORDINATES[j]) * scale).alias(covariance_name(i, j)) for i in range(p) for j in range(i + 1)]
    now = members.groupBy("pool", "start", "n_group").agg(*sums)
    return with_determinant(with_factor(with_spread(now, tied)))


def concentrated(pooled: DataFrame, estimates: DataFrame, tied: DataFrame, support: float) -> DataFrame:
    """One concentration step: estimates from the nearest vectors of each pool under each of its estimates; written to the shared folder."""
    far = with_distance(pooled.join(estimates, "pool"), "d").select("pool", "start", "n_group", *COORDINATES, "d")
    limits = materialize(far.groupBy("pool", "start").agg(F.percentile_approx("d", support, 10_000).alias("limit")))
    return materialize(from_members(far.join(limits, ["pool", "start"]).where("d <= limit"), tied, CONSISTENT))


def pool_estimates(vectors: DataFrame, support: float = SUPPORT, steps: int = STEPS) -> tuple[DataFrame, DataFrame]:
    """The pools of each group (see ``pools_of``), and of each pool ``n_group``, centre ``m*``, covariances ``c**``, their factor ``l**`` and ``det``, from rows of ``lang, source`` and coordinates. After the first steps only pools go on whose determinant still shrinks; whether there are any is all that comes to the driver."""
    p = len(COORDINATES)
    pools = materialize(pools_of(vectors))
    pooled = with_estimates(vectors, pools).select(F.explode("pools").alias("pool"), *COORDINATES)
    centre = materialize(pooled.groupBy("pool").agg(*(F.percentile_approx(x, 0.5, 10_000).alias(f"m{i}") for i, x in enumerate(COORDINATES)), F.count(F.lit(1)).alias("n_group")))
    off = [F.abs(F.col(x) - F.col(f"m{i}")) for i, x in enumerate(COORDINATES)]
    spread = pooled.join(centre, "pool").groupBy("pool", *(f"m{i}" for i in range(p)), "n_group").agg(*(F.percentile_approx(x, 0.5, 10_000).alias(f"s{i}") for i, x in enumerate(off)), *(F.avg(x).alias(f"a{i}") for i, x in enumerate(off)))
    spread = materialize(spread)
    every = spread.where("pool.level = 2").select(*(F.when(F.col(f"s{i}") > 0, (F.col(f"s{i}") * NORMAL_MEDIAN) ** 2).otherwise((F.col(f"a{i}") * NORMAL_MEAN) ** 2).alias(f"w{i}") for i in range(p)))
    tied = materialize(spread.crossJoin(F.broadcast(every)).select("pool", *(F.when(F.col(f"s{i}") == 0, F.col(f"w{i}")).otherwise(0.0).alias(f"v{i}") for i in range(p))))  # a single row of statistics
    zero = {covariance_name(i, j): F.lit(0.0) for i in range(p) for j in range(i)}
    start = {covariance_name(i, i): (F.col(f"s{i}") * NORMAL_MEDIAN) ** 2 for i in range(p)}
    medians = with_determinant(with_factor(with_spread(spread.withColumns(zero | start).drop(*(f"{c}{i}" for c in "sa" for i in range(p))), tied))).withColumn("start", F.lit(0))
    part = F.pmod(F.xxhash64(*COORDINATES), F.lit(SUBSETS))
    starts = F.array_compact(F.array(F.lit(1), F.when(part < 2, part.cast("int") + 2)))
    others = from_members(pooled.join(centre.select("pool", "n_group"), "pool").withColumn("start", F.explode(starts)), tied, 1.0)
    estimates = materialize(medians.unionByName(others))
    for _ in range(TRIED):
        estimates = concentrated(pooled, estimates, tied, support)
    least = lambda df: df.groupBy("pool").agg(F.min_by(F.struct(*(c for c in df.columns if c != "pool")), F.struct("det", "start")).alias("e")).select("pool", "e.*")
    best = unsettled = materialize(least(estimates))
    for _ in range(steps - TRIED):
        now = concentrated(pooled, unsettled, tied, support)
        unsettled = materialize(now.join(best.select("pool", F.col("det").alias("before")), "pool").where(F.col("det") < F.col("before") * (1 - SHRINKS)).drop("before"))
        if unsettled.isEmpty():
            break
        best = materialize(least(best.unionByName(unsettled)))
    return pools, best


def mcd_estimates(vectors: DataFrame, support: float = SUPPORT, steps: int = STEPS) -> DataFrame:
    """``of_lang, of_source, n_group``, centre ``m*`` and factor ``l**`` that judge each group."""
    return drawn_together(*pool_estimates(vectors, support, steps))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", limit: float = LIMIT, support: float = SUPPORT, steps: int = STEPS) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance``."""
    counts = materialize(coordinates(base_counts(docs, id_col, text_col, lang_col, source_col)))
    passed = counts.where("not base_failed")
    estimates = mcd_estimates(passed.select("lang", "source", *COORDINATES), support, steps)
    judged = with_distance(with_estimates(counts, estimates), "distance")
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= limit)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")
