"""Statistical column builders: tails of common laws, bias-corrected moments, seeded draws."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from risklake.session import materialise

# Standard-normal quantiles and densities at the supported confidences.
NORMAL_QUANTILE = {
    0.01: -2.3263478740408408,
    0.025: -1.9599639845400545,
    0.05: -1.6448536269514729,
    0.10: -1.2815515655446004,
    0.90: 1.2815515655446004,
    0.95: 1.6448536269514722,
    0.975: 1.959963984540054,
    0.99: 2.3263478740408408,
}
# Chi-square critical values at the 5% level.
CHI2_CRITICAL_5PCT = {1: 3.841458820694124, 2: 5.991464547107979}
# Published Chebyshev coefficients of the complementary error function.
ERFC_COEFFICIENTS = [
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
]


def normal_quantile(p: float) -> float:
    key = round(p, 6)
    if key not in NORMAL_QUANTILE:
        raise ValueError(f"no tabulated normal quantile for {p}; known: {sorted(NORMAL_QUANTILE)}")
    return NORMAL_QUANTILE[key]


def erfc(x: Column) -> Column:
    """Complementary error function, relative error about 1e-7."""
    t = 1.0 / (1.0 + 0.5 * F.abs(x))
    poly = F.lit(ERFC_COEFFICIENTS[-1])
    for c in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = F.lit(c) + t * poly
    tail = t * F.exp(-x * x + poly)
    return F.when(x >= 0, tail).otherwise(2.0 - tail)


def normal_cdf(x: Column) -> Column:
    return 0.5 * erfc(-x / math.sqrt(2.0))


def normal_density(x: float) -> float:
    return math.exp(-0.5 * x * x) / math.sqrt(2.0 * math.pi)


def chi2_tail(x: Column, df: int) -> Column:
    if df == 1:
        return erfc(F.sqrt(x / 2.0))
    if df == 2:
        return F.exp(-x / 2.0)
    raise ValueError("only 1 and 2 degrees of freedom are used")


def xlogy(x: Column, y: Column) -> Column:
    """``x·ln y`` with ``0·ln 0 = 0``."""
    return F.when(x == 0, F.lit(0.0)).otherwise(x * F.log(y))


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X ≤ k): the pmf ratio recursion folded over 1..k, kept in logs for large n."""
    step = math.log(p / (1.0 - p))
    start = F.struct(
        (n * math.log1p(-p)).alias("logpmf"), F.exp(n * math.log1p(-p)).alias("cdf")
    )

    def advance(acc: Column, i: Column) -> Column:
        logpmf = acc["logpmf"] + F.log((n - i + 1) / i) + F.lit(step)
        return F.struct(logpmf.alias("logpmf"), (acc["cdf"] + F.exp(logpmf)).alias("cdf"))

    steps = F.when(k >= 1, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.least(F.aggregate(steps, start, advance, lambda a: a["cdf"]), F.lit(1.0))


def wilson_interval(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column, Column]:
    """(proportion, low, high) of the 95% score interval."""
    p = F.try_divide(k, n)
    denom = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / denom
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / denom
    return p, F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def sample_skew(x: Column, w: WindowSpec | None = None) -> Column:
    """Bias-corrected skewness (Spark's own is the population form)."""
    over = (lambda c: c.over(w)) if w is not None else (lambda c: c)
    n = over(F.count(x))
    g1 = over(F.skewness(x))
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def sample_excess_kurtosis(x: Column, w: WindowSpec | None = None) -> Column:
    """Bias-corrected excess kurtosis."""
    over = (lambda c: c.over(w)) if w is not None else (lambda c: c)
    n = over(F.count(x))
    g2 = over(F.kurtosis(x))
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def uniform(seed: int, *keys: str | Column) -> Column:
    """Uniform draw in (0, 1) decided by the key values alone.

    Independent of partitioning and of task retries, unlike ``rand(seed)``.
    """
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols])
    head = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (head + 0.5) / float(1 << 52)


def gaussian(seed: int, *keys: str | Column) -> Column:
    """Standard normal draw from two keyed uniforms (Box–Muller)."""
    u1 = uniform(seed, *keys, F.lit("a"))
    u2 = uniform(seed, *keys, F.lit("b"))
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)


DIGIT = 16  # bits of an ordered key that one pass of a selection fixes


def ordered_key(x: Column) -> Column:
    """A long per double, in the same order; both zeros are one."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), x.cast("double") + F.lit(0.0)).cast("long")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(_ALL_BUT_SIGN)))


def from_ordered_key(key: Column) -> Column:
    bits = F.when(key >= 0, key).otherwise(key.bitwiseXOR(F.lit(_ALL_BUT_SIGN)))
    return F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


_ALL_BUT_SIGN = (1 << 63) - 1


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles of groups of any size, one row per group with one column per entry of ``probs``.

    Radix selection: doubles become longs in the same order; each of ``64 / DIGIT`` passes counts the next digit of the rows whose
    earlier digits are those of a wanted rank, and the counts say which digit the rank has. What is shuffled and sorted is counts, at most
    ``2 ** DIGIT`` for a group and rank, so no task holds a group; ties are one count. Nulls and NaN are left out; a
    group without values has no row.
    """
    by = list(by)
    if not by:
        raise ValueError("exact_quantiles needs at least one grouping column")
    x = F.col(value)
    # read in every pass: written once, so the upstream work is not repeated
    data = materialise(df.where(x.isNotNull() & ~F.isnan(x)).select(*by, ordered_key(x).alias("_key")), "quantile-input")
    place = {name: F.lit(float(p)) * (F.col("_n") - 1) for name, p in probs.items()}
    sizes = data.groupBy(*by).agg(F.count("*").alias("_n"))
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(pos), F.ceil(pos)) for pos in place.values()])))
    wanted = sizes.select(*by, "_n", F.explode(ranks).alias("_rank")).withColumn("_left", F.col("_rank")).withColumn("_prefix", F.lit(0).cast("long"))
    for shift in range(64 - DIGIT, -1, -DIGIT):
        prefix = F.lit(0).cast("long") if shift + DIGIT == 64 else F.shiftright("_key", shift + DIGIT)
        rows = data.select(*by, prefix.alias("_prefix"), F.shiftright("_key", shift).alias("_digit"))
        if shift + DIGIT < 64:
            rows = rows.join(wanted.select(*by, "_prefix").distinct(), [*by, "_prefix"], "left_semi")
        counts = rows.groupBy(*by, "_prefix", "_digit").agg(F.count("*").alias("_c"))
        upto = F.sum("_c").over(W.partitionBy(*by, "_prefix").orderBy("_digit"))
        counts = counts.withColumn("_upto", upto)
        inside = (F.col("_left") < F.col("_upto")) & (F.col("_left") >= F.col("_upto") - F.col("_c"))
        found = wanted.join(counts, [*by, "_prefix"]).where(inside)
        wanted = materialise(found.select(*by, "_n", "_rank", (F.col("_left") - F.col("_upto") + F.col("_c")).alias("_left"), F.col("_digit").alias("_prefix")), "quantile-ranks")
    at = lambda rank: F.max(F.when(F.col("_rank") == rank, F.col("_x")))
    values = wanted.withColumn("_x", from_ordered_key(F.col("_prefix"))).groupBy(*by, "_n").agg(*[f(at(g(pos))) for name, pos in place.items() for f, g in ((lambda c, n=name: c.alias(f"_lo_{n}"), F.floor), (lambda c, n=name: c.alias(f"_hi_{n}"), F.ceil))])
    return values.select(*by, *[
        F.when(F.col(f"_lo_{n}") == F.col(f"_hi_{n}"), F.col(f"_lo_{n}")).otherwise(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * (pos - F.floor(pos))).alias(n) for n, pos in place.items()
    ])
