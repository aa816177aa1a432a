"""Technical indicators over every series at once.

Sliding frames use built-in window aggregates. Exponential recursions are expressed as running
sums rather than per-row folds: inside a block of rows the recursion unrolls to a weighted prefix
sum, and only the previous block's end still carries weight above double precision. Cost is linear
in the rows, with no arrays and no Python.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from risklake.functions.stats import normal_quantile, sample_excess_kurtosis, sample_skew
from risklake.operators.align import series

ANNUAL = math.sqrt(252.0)


def last_rows(by: str, n: int):
    return series(by).rowsBetween(-(n - 1), 0)


def full_frame(value: Column, x: str | Column, by: str, n: int) -> Column:
    """``value`` only once the frame holds ``n`` non-null inputs."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.count(x).over(last_rows(by, n)) == n, value)


def sma(x: str, n: int, by: str = "symbol") -> Column:
    return full_frame(F.avg(x).over(last_rows(by, n)), x, by, n)


def with_ema(df: DataFrame, x: str, out: str, k: float, by: str = "symbol", order: str = "date") -> DataFrame:
    """``e = k·x + (1−k)·e`` seeded with the first value, as column ``out``."""
    q = 1.0 - k
    block = max(1, int(300.0 / -math.log(q)))  # q^block underflows any carry, q^-block still fits a double
    i = F.row_number().over(series(by, order)) - 1
    rows = df.withColumn("_i", i).withColumn("_b", F.floor(F.col("_i") / block)).withColumn("_j", F.col("_i") % block)
    gain = F.when(F.col("_i") == 0, F.lit(1.0)).otherwise(F.lit(k))
    term = gain * F.col(x) * F.pow(F.lit(q), -F.col("_j"))
    in_block = W.partitionBy(by, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_local", F.sum(term).over(in_block) * F.pow(F.lit(q), F.col("_j")))
    ended = F.last(F.when(F.col("_j") == block - 1, F.col("_local")), ignorenulls=True).over(
        series(by, order).rowsBetween(W.unboundedPreceding, -1)
    )
    carry = F.when(F.col("_b") > 0, ended * F.pow(F.lit(q), F.col("_j") + 1)).otherwise(0.0)
    return rows.withColumn(out, F.col("_local") + carry).drop("_i", "_b", "_j", "_local")


def with_ema_span(df: DataFrame, x: str, out: str, span: int, by: str = "symbol") -> DataFrame:
    return with_ema(df, x, out, 2.0 / (span + 1), by)


def macd(prices: DataFrame, by: str = "symbol") -> DataFrame:
    """12/26 line, its 9-row signal, and the histogram."""
    out = with_ema_span(with_ema_span(prices, "price", "ema12", 12, by), "price", "ema26", 26, by)
    out = with_ema_span(out.withColumn("macd", F.col("ema12") - F.col("ema26")), "macd", "signal", 9, by)
    return out.withColumn("histogram", F.col("macd") - F.col("signal"))


def rsi_simple(prices: DataFrame, n: int = 14, by: str = "symbol") -> DataFrame:
    """Ratio of mean gain to mean loss over ``n`` rows; undefined rows read 50."""
    delta = F.coalesce(F.col("price") - F.lag("price").over(series(by)), F.lit(0.0))
    rows = prices.withColumn("_d", delta)
    frame = last_rows(by, n)
    up = F.avg(F.greatest("_d", F.lit(0.0))).over(frame)
    down = F.avg(F.greatest(-F.col("_d"), F.lit(0.0))).over(frame)
    full = F.count("*").over(frame) == n
    value = F.when(~full | ((up == 0) & (down == 0)), 50.0).when(down == 0, 100.0).otherwise(100 - 100 / (1 + up / down))
    return rows.withColumn("rsi", value).drop("_d")


def rsi_wilder(prices: DataFrame, n: int = 14, by: str = "symbol") -> DataFrame:
    """Wilder smoothing seeded with the mean of the first ``n`` moves; first value after the seed."""
    w = series(by)
    delta = F.col("price") - F.lag("price").over(w)
    rows = prices.withColumn("_idx", F.row_number().over(w) - 1).withColumn("_d", delta)
    seed_frame = w.rowsBetween(-(n - 1), 0)
    for side, sign in (("_up", 1.0), ("_down", -1.0)):
        move = F.greatest(F.col("_d") * sign, F.lit(0.0))
        rows = rows.withColumn(side, F.when(F.col("_idx") == n, F.avg(move).over(seed_frame)).otherwise(move))
    smoothed = rows.where(F.col("_idx") >= n)
    for side in ("_up", "_down"):
        smoothed = with_ema(smoothed, side, f"{side}_s", 1.0 / n, by)
    value = F.when(F.col("_down_s") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("_up_s") / F.col("_down_s")))
    head = rows.where(F.col("_idx") < n).select(*prices.columns, F.lit(None).cast("double").alias("rsi"))
    tail = smoothed.select(*prices.columns, F.when(F.col("_idx") > n, value).alias("rsi"))
    return head.unionByName(tail)


def bollinger(prices: DataFrame, n: int = 20, width: float = 2.0, population: bool = False, by: str = "symbol") -> DataFrame:
    std = F.stddev_pop("price") if population else F.stddev_samp("price")
    mid = sma("price", n, by)
    band = full_frame(std.over(last_rows(by, n)), "price", by, n) * width
    return prices.select("*", mid.alias("mid"), (mid + band).alias("upper"), (mid - band).alias("lower"))


def realised_vol(prices: DataFrame, n: int = 21, by: str = "symbol") -> DataFrame:
    """Annualised rolling volatility of simple returns, leading gaps filled backwards."""
    r = F.col("price") / F.lag("price").over(series(by)) - 1
    rows = prices.withColumn("_r", r)
    rows = rows.withColumn("_v", full_frame(F.stddev_samp("_r").over(last_rows(by, n)), "_r", by, n) * ANNUAL)
    filled = F.first("_v", ignorenulls=True).over(series(by).rowsBetween(0, W.unboundedFollowing))
    return rows.withColumn("volatility", filled).drop("_r", "_v")


def atr(prices: DataFrame, n: int = 14, by: str = "symbol") -> DataFrame:
    """Average true range on highs and lows spread by the daily volatility."""
    daily = F.col("volatility") / 15.87 * 0.625
    rows = realised_vol(prices, 21, by).withColumn("high", F.col("price") * (1 + daily)).withColumn(
        "low", F.col("price") * (1 - daily)
    )
    prev = F.lag("price").over(series(by))
    rows = rows.withColumn(
        "true_range",
        F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)),
    )
    return rows.withColumn("atr", sma("true_range", n, by))


def rolling_log_vol(prices: DataFrame, n: int = 21, by: str = "symbol") -> DataFrame:
    r = F.log(F.col("price") / F.lag("price").over(series(by)))
    rows = prices.withColumn("_r", r)
    vol = full_frame(F.stddev_samp("_r").over(last_rows(by, n)), "_r", by, n) * ANNUAL * 100
    return rows.withColumn("vol_pct", F.coalesce(vol, F.lit(0.0))).drop("_r")


def vwap(prices: DataFrame, by: str = "symbol") -> DataFrame:
    w = series(by).rowsBetween(W.unboundedPreceding, 0)
    return prices.withColumn(
        "vwap", F.try_divide(F.sum(F.col("price") * F.col("volume")).over(w), F.sum("volume").over(w))
    )


def regime_features(prices: DataFrame, by: str = "symbol") -> DataFrame:
    """Return sums, volatilities and bias-corrected 63-row skew and kurtosis of log returns."""
    r = F.log(F.col("price") / F.lag("price").over(series(by)))
    rows = prices.withColumn("r", r)

    def framed(agg: Column, n: int) -> Column:
        return full_frame(agg.over(last_rows(by, n)), "r", by, n)

    out = rows.select(
        by,
        "date",
        framed(F.sum("r"), 5).alias("ret_5"),
        framed(F.sum("r"), 21).alias("ret_21"),
        framed(F.stddev_samp("r"), 21).alias("vol_21"),
        framed(F.stddev_samp("r"), 63).alias("vol_63"),
        full_frame(sample_skew(F.col("r"), last_rows(by, 63)), "r", by, 63).alias("skew_63"),
        full_frame(sample_excess_kurtosis(F.col("r"), last_rows(by, 63)), "r", by, 63).alias("kurt_63"),
        framed(F.sum("r"), 126).alias("mom_126"),
    )
    return out.where("mom_126 is not null")


def ewma_risk(prices: DataFrame, by: str = "symbol", decay: float = 0.94, min_returns: int = 100) -> DataFrame:
    """EWMA volatility, fragility against its 126-row median, one-day 5% VaR and regime."""
    r = F.log(F.col("price") / F.lag("price").over(series(by)))
    rows = prices.withColumn("r", r).where("r is not null").withColumn("_n", F.count("*").over(W.partitionBy(by)))
    rows = rows.where(F.col("_n") >= min_returns).withColumn("_r2", F.col("r") * F.col("r"))
    rows = with_ema(rows, "_r2", "_var", 1.0 - decay, by).withColumn("sigma", F.sqrt("_var"))
    median = full_frame(F.percentile("sigma", F.lit(0.5)).over(last_rows(by, 126)), "sigma", by, 126)
    fragility = F.col("sigma") / median
    mean = F.avg("r").over(series(by).rowsBetween(W.unboundedPreceding, 0))
    return rows.select(
        by,
        "date",
        "sigma",
        fragility.alias("fragility"),
        (mean + F.col("sigma") * normal_quantile(0.05)).alias("var_95"),
        F.when(fragility > 1.5, "High_Fragility").when(fragility < 0.8, "Low_Vol_Stable")
        .when(fragility.isNotNull(), "Normal").alias("regime"),
    )


def _phase(values: Column) -> tuple[Column, Column]:
    """(direction, calmness) words of one stretch of prices."""
    n = F.size(values)
    first, last = F.try_element_at(values, F.lit(1)), F.try_element_at(values, F.lit(-1))
    change = F.try_divide(last - first, first + 1e-9)
    direction = (
        F.when(n < 2, "flat").when(change > 0.01, "rallying").when(change < -0.01, "crashing").otherwise("holding steady")
    )
    mean = F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), n)
    var = F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)), n)
    calm = F.when(F.try_divide(F.sqrt(var), mean) > 0.02, "unstable").otherwise("calm")
    return direction, calm


def describe_series(prices: DataFrame, n: int = 12, by: str = "symbol") -> DataFrame:
    """One sentence per row about the last ``n`` prices, split in thirds."""
    rows = prices.withColumn("_a", F.collect_list("price").over(last_rows(by, n)))
    size = F.size("_a")
    a, b = F.floor(size / 3).cast("int"), F.floor(2 * size / 3).cast("int")
    parts = [F.slice("_a", F.lit(1), a), F.slice("_a", a + 1, b - a), F.slice("_a", b + 1, size - b)]
    (d1, c1), (d2, c2), (d3, c3) = [_phase(p) for p in parts]
    text = F.concat(
        F.lit("The series started by "), d1, F.lit(" in a "), c1, F.lit(" manner. It then shifted to "), d2,
        F.lit(", becoming "), c2, F.lit(". Crucially, it is currently "), d3, F.lit(" with "), c3, F.lit(" conditions."),
    )
    return rows.withColumn("description", text).drop("_a")


def min_max_scaled(prices: DataFrame, by: str = "symbol") -> DataFrame:
    w = W.partitionBy(by)
    lo, hi = F.min("price").over(w), F.max("price").over(w)
    return prices.withColumn("scaled", F.when(hi == lo, 0.0).otherwise((F.col("price") - lo) / (hi - lo)))


def ar1_projection(prices: DataFrame, horizon: int = 20, lookback: int = 120, by: str = "symbol") -> DataFrame:
    """Mean-reverting path from a clipped first-order fit on the last ``lookback`` rows."""
    rn = F.row_number().over(W.partitionBy(by).orderBy(F.desc("date")))
    recent = prices.withColumn("_rn", rn).where(F.col("_rn") <= lookback)
    recent = recent.withColumn("_x", F.lag("price").over(series(by)))
    y_pair = F.when(F.col("_x").isNotNull(), F.col("price"))
    fit = recent.groupBy(by).agg(
        F.count("*").alias("n"),
        F.max_by("price", "date").alias("last"),
        F.stddev_pop("price").alias("sd"),
        F.min("price").alias("lo"),
        F.max("price").alias("hi"),
        F.avg("_x").alias("mx"),
        F.avg(y_pair).alias("my"),
        F.regr_slope("price", "_x").alias("slope"),
        F.var_pop("_x").alias("vx"),
    )
    phi = F.when(F.col("vx") <= 1e-12, 0.0).otherwise(F.greatest(F.lit(-0.98), F.least(F.lit(0.98), F.col("slope"))))
    pad = F.greatest(F.lit(1e-6), 0.10 * (F.col("hi") - F.col("lo")))
    ready = fit.select(
        by, "last", phi.alias("phi"), (F.col("my") - phi * F.col("mx")).alias("c"), (F.col("lo") - pad).alias("lo"),
        (F.col("hi") + pad).alias("hi"), ((F.col("n") < 3) | (F.col("sd") < 1e-10)).alias("flat"),
    )

    def step(path: Column, _: Column) -> Column:
        nxt = F.col("c") + F.col("phi") * F.element_at(path, -1)
        nxt = F.when(F.col("flat"), F.col("last")).otherwise(F.greatest(F.col("lo"), F.least(F.col("hi"), nxt)))
        return F.concat(path, F.array(nxt))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.array("last"), step)
    return ready.select(by, F.posexplode(path).alias("step", "price")).where("step > 0")


def quarterly_vol(prices: DataFrame, by: str = "symbol") -> DataFrame:
    """Population volatility of up to 21 returns, no minimum; the first return counts as 0."""
    r = F.coalesce(F.col("price") / F.lag("price").over(series(by)) - 1, F.lit(0.0))
    rows = prices.withColumn("_r", r)
    return rows.withColumn("vol_pct", F.stddev_pop("_r").over(last_rows(by, 21)) * ANNUAL * 100).drop("_r")
