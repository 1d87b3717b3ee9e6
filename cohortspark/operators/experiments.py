"""Two-arm experiment statistics (X)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Coefficients of Hart's rational approximation of the upper normal tail, and of Acklam's of the normal quantile. Fixed values.
TAIL_ABOVE = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
TAIL_BELOW = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
MIDDLE_ABOVE = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
MIDDLE_BELOW = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
END_ABOVE = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
END_BELOW = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
ROOT_TWO_PI = 2.5066282746310002


def polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that stands in the plan, and is computed, once."""
    return F.transform(F.array(value), body)[0]


def upper_tail(above: Column) -> Column:
    """Share of a standard normal above a value that is not negative."""

    def share(a: Column) -> Column:
        density = F.exp(-a * a / 2)
        far = a + 0.65
        for k in (4, 3, 2, 1):
            far = a + k / far
        return F.when(a > 37, 0.0).when(a < 7.07106781186547, density * polynomial(TAIL_ABOVE, a) / polynomial(TAIL_BELOW, a)).otherwise(density / far / ROOT_TWO_PI)

    return once(above, share)


def norm_cdf(z: Column) -> Column:
    """Standard normal distribution, as a plain expression."""
    return once(z, lambda x: once(upper_tail(F.abs(x)), lambda tail: F.when(x > 0, 1 - tail).otherwise(tail)))


def norm_quantile(p: Column) -> Column:
    """Standard normal quantile; null outside of (0, 1). One step of Halley's method refines the approximation."""

    def rough(p: Column) -> Column:
        end = F.least(p, 1 - p)
        low = once(F.sqrt(-2 * F.log(end)), lambda q: polynomial(END_ABOVE, q) / polynomial(END_BELOW, q))
        middle = once(p - 0.5, lambda m: m * polynomial(MIDDLE_ABOVE, m * m) / polynomial(MIDDLE_BELOW, m * m))
        return F.when(end >= 0.02425, middle).when(p < 0.5, low).otherwise(-low)

    def refined(p: Column, x: Column) -> Column:
        return once((norm_cdf(x) - p) * ROOT_TWO_PI * F.exp(x * x / 2), lambda u: x - u / (1 + x * u / 2))

    return once(p, lambda p: F.when((p > 0) & (p < 1), once(rough(p), lambda x: refined(p, x))))


def p_two_sided(z: Column) -> Column:
    return 2 * upper_tail(F.abs(z))


def arm(condition: Column, n: int) -> Column:
    return F.count_if((F.col("arm") == n) & condition).cast("double")


def two_proportion_test(outcomes: DataFrame) -> DataFrame:
    """By experiment: effect p1 - p0 and pooled z of ``arm, success``; no test with fewer than two in an arm."""
    yes = F.lit(True)
    c = outcomes.groupBy("experiment").agg(arm(yes, 0).alias("n0"), arm(yes, 1).alias("n1"), arm(F.col("success"), 0).alias("s0"), arm(F.col("success"), 1).alias("s1"))
    c = c.where("n0 >= 2 and n1 >= 2").withColumns({"p0": F.col("s0") / F.col("n0"), "p1": F.col("s1") / F.col("n1"), "pooled": (F.col("s0") + F.col("s1")) / (F.col("n0") + F.col("n1"))})
    variance = F.greatest(F.col("pooled") * (1 - F.col("pooled")) * (1 / F.col("n0") + 1 / F.col("n1")), F.lit(1e-12))
    return c.select("experiment", "n0", "n1", "p0", "p1", (F.col("p1") - F.col("p0")).alias("effect"), ((F.col("p1") - F.col("p0")) / F.sqrt(variance)).alias("z"))


def mean_difference_test(outcomes: DataFrame, sd: float) -> DataFrame:
    c = outcomes.groupBy("experiment").agg(*(F.avg(F.when(F.col("arm") == a, F.col("value"))).alias(f"m{a}") for a in (0, 1)), *(F.count_if(F.col("arm") == a).cast("double").alias(f"n{a}") for a in (0, 1)))
    return c.where("n0 >= 2 and n1 >= 2").select("experiment", (F.col("m1") - F.col("m0")).alias("effect"), ((F.col("m1") - F.col("m0")) / (sd * F.sqrt(1 / F.col("n0") + 1 / F.col("n1")))).alias("z"))


def event_odds_test(outcomes: DataFrame) -> DataFrame:
    """Log odds ratio with 0.5 added to each cell."""
    yes, no = F.col("success"), ~F.col("success")
    c = outcomes.groupBy("experiment").agg(*(arm(x, a).alias(f"{k}{a}") for k, x in (("e", yes), ("c", no)) for a in (0, 1)))
    cell = {k: F.col(k) + 0.5 for k in ("e0", "e1", "c0", "c1")}
    effect = F.log(cell["e1"] / cell["c1"] / (cell["e0"] / cell["c0"]))
    error = F.sqrt(sum((1 / x for x in cell.values()), F.lit(0.0)))
    return c.select("experiment", effect.alias("log_odds"), error.alias("std_error"), (effect / error).alias("z"), F.exp(effect).alias("odds_ratio"))


def wilson_interval(s: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Clipped to 0 and 1; (0, 0) for n = 0."""
    p, zz = s / n, z * z
    middle, half = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.when(n > 0, F.greatest(middle - half, F.lit(0.0))).otherwise(0.0), F.when(n > 0, F.least(middle + half, F.lit(1.0))).otherwise(0.0)


def interim_look(outcomes: DataFrame, fraction: float) -> DataFrame:
    """The proportion test on the first participants of each arm, by time and id. They are counted by hour first, so no task orders more than an hour of an arm."""
    hourly = outcomes.withColumn("hour", F.date_trunc("hour", "ts"))
    counts = hourly.groupBy("experiment", "arm", "hour").agg(F.count(F.lit(1)).alias("own"))
    arm_ = Window.partitionBy("experiment", "arm")
    placed = counts.withColumns({"before": F.sum("own").over(arm_.orderBy("hour")) - F.col("own"), "n": F.sum("own").over(arm_)})
    wanted = F.greatest(F.lit(2), F.floor(F.col("n") * fraction))
    within = hourly.join(placed.where(F.col("before") < wanted), ["experiment", "arm", "hour"])
    ranked = within.withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("experiment", "arm", "hour").orderBy("ts", "event_id")))
    return two_proportion_test(ranked.where(F.col("rank") <= wanted))


def attrition_summary(outcomes: DataFrame, seen: Column) -> DataFrame:
    return outcomes.groupBy("experiment", "arm").agg(F.count_if(seen).alias("observed"), F.count_if(~seen).alias("dropout"), F.count_if(seen & F.col("success")).alias("response"), F.count_if(seen & ~F.col("success")).alias("no_response"))


def sample_size(designs: DataFrame) -> DataFrame:
    """Participants of each arm, at least 2, for ``binary`` (``p0, p1``), ``continuous`` (``delta, sd``) and ``time-to-event`` (``hazard_ratio, event_rate``) designs with ``alpha, target_power, ratio`` and ``dropout``."""
    za, zb, ratio = norm_quantile(1 - F.col("alpha") / 2), norm_quantile(F.col("target_power")), F.col("ratio")
    known = designs.withColumns({"za": za, "zb": zb})
    p = (F.col("p0") + ratio * F.col("p1")) / (1 + ratio)
    root = F.col("za") * F.sqrt((1 + 1 / ratio) * p * (1 - p)) + F.col("zb") * F.sqrt(F.col("p0") * (1 - F.col("p0")) + F.col("p1") * (1 - F.col("p1")) / ratio)
    binary = F.ceil(root * root / F.nullif((F.col("p1") - F.col("p0")) * (F.col("p1") - F.col("p0")), F.lit(0.0)))
    total = F.col("za") + F.col("zb")
    continuous = F.ceil((1 + 1 / ratio) * total * total * F.col("sd") * F.col("sd") / F.nullif(F.col("delta") * F.col("delta"), F.lit(0.0)))
    log_hazard = F.log("hazard_ratio")
    events = F.ceil(4 * total * total / F.nullif(log_hazard * log_hazard, F.lit(0.0)))
    survival = F.ceil(F.ceil(events / F.col("event_rate")) / (1 + ratio))
    n = F.when(F.col("kind") == "binary", binary).when(F.col("kind") == "continuous", continuous).otherwise(survival)
    enrolled = lambda target: F.greatest(F.ceil(F.greatest(target, F.lit(2)) / (1 - F.col("dropout"))), F.lit(2))
    return known.withColumn("n", n).withColumns({"control": enrolled(F.col("n")), "treatment": enrolled(F.ceil(F.col("n") * ratio))}).drop("n", "za", "zb")


def validate_designs(designs: DataFrame) -> DataFrame:
    """Designs with ``reasons`` against them, comma-joined; empty for a valid one."""
    ranges = {"alpha": (0.0001, 0.2), "target_power": (0.5, 0.99), "dropout": (0.0, 0.8), "ratio": (0.2, 5.0)}
    rules = [F.when((F.col(c) < a) | (F.col(c) > b) | F.col(c).isNull(), F.lit(c)) for c, (a, b) in ranges.items()]
    rules.append(F.when(F.col("p0") == F.col("p1"), F.lit("effect")))
    return designs.withColumn("reasons", F.array_join(F.array_compact(F.array(*rules)), ","))


def randomize(participants: DataFrame, ratio: float, seed: int) -> DataFrame:
    """Arms by md5 order within blocks of the hash, in a cycle of one control and ``round(ratio)`` others."""
    cycle = 1 + max(1, round(ratio))
    key = F.md5(F.concat_ws(":", F.lit(seed), "participant_id"))
    order = Window.partitionBy("block").orderBy("key", "participant_id")
    keyed = participants.select("participant_id", key.alias("key")).withColumn("block", F.substring("key", 1, 2))
    return keyed.select("participant_id", "block", F.when((F.row_number().over(order) - 1) % cycle == 0, "control").otherwise("treatment").alias("arm"))


def resampled_power(outcomes: DataFrame, replicates: int, seed: int, critical: float = 1.959963984540054, target: float = 0.8) -> DataFrame:
    """Share of Poisson resamples in which the proportion test rejects, with its interval, the median p, the mean effect, and whether power is below ``target``.

    Outcomes are counted by cell (experiment, arm, success) first; the resampled size
    of a cell of n is one draw of Poisson(n), seeded by the cell, so the work after
    the count does not grow with the rows.
    """
    cells = outcomes.groupBy("experiment", "arm", F.col("success").cast("int").alias("success")).agg(F.count(F.lit(1)).alias("n"))
    named = cells.withColumn("key", F.pmod(F.xxhash64("experiment", "arm", "success"), F.lit(1 << 62)))

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [part.loc[part.index.repeat(replicates), ["experiment", "arm", "success"]]]
            drawn = [np.random.default_rng([seed, int(k)]).poisson(n, replicates) for k, n in zip(part["key"], part["n"], strict=True)]
            yield rows[0].assign(rep=np.tile(np.arange(replicates), len(part)), w=np.concatenate(drawn) if drawn else np.zeros(0, int))

    drawn = named.mapInPandas(draw, "experiment string, arm int, success int, rep int, w long")
    some = lambda a, s: F.coalesce(F.sum(F.when((F.col("arm") == a) & (F.col("success") >= s), F.col("w"))), F.lit(0)).cast("double")
    sizes = drawn.groupBy("experiment", "rep").agg(*(some(a, 0).alias(f"n{a}") for a in (0, 1)), *(some(a, 1).alias(f"s{a}") for a in (0, 1))).where("n0 >= 2 and n1 >= 2")
    pooled = (F.col("s0") + F.col("s1")) / (F.col("n0") + F.col("n1"))
    effect = F.col("s1") / F.col("n1") - F.col("s0") / F.col("n0")
    z = effect / F.sqrt(F.greatest(pooled * (1 - pooled) * (1 / F.col("n0") + 1 / F.col("n1")), F.lit(1e-12)))
    tested = sizes.withColumns({"effect": effect, "z": z}).withColumn("p", p_two_sided(F.col("z")))
    power = tested.groupBy("experiment").agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_if(F.abs("z") > critical).cast("double").alias("s"), F.percentile("p", 0.5).alias("median_p"), F.avg("effect").alias("mean_effect"))
    low, high = wilson_interval(F.col("s"), F.col("n"))
    return power.select("experiment", "n", (F.col("s") / F.col("n")).alias("power"), low.alias("low"), high.alias("high"), "median_p", "mean_effect", (F.col("s") / F.col("n") < target).alias("below_target"))
