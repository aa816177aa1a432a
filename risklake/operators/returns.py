"""Returns, compounding, drawdown and calendar bars for every series in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from risklake.functions.scalar import clamp_return
from risklake.operators.align import align_intersection, align_forward_fill, series

RUNNING = (W.unboundedPreceding, 0)


def _keys(by: Sequence[str] | str) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def simple_returns(prices: DataFrame, by: Sequence[str] | str = "symbol", drop_first: bool = True) -> DataFrame:
    """``price / previous − 1``; rows after a zero price are skipped."""
    prev = F.lag("price").over(series(by))
    out = prices.withColumn("ret", F.try_divide(F.col("price"), prev) - 1)
    return out.where("ret is not null") if drop_first else out


def log_returns(prices: DataFrame, by: Sequence[str] | str = "symbol", min_rows: int = 60) -> DataFrame:
    """``ln(price / previous)`` for series with at least ``min_rows`` returns."""
    prev = F.lag("price").over(series(by))
    out = prices.withColumn("ret", F.log(F.col("price") / prev)).where("ret is not null")
    n = F.count("*").over(W.partitionBy(*_keys(by)))
    return out.withColumn("_n", n).where(F.col("_n") >= min_rows).drop("_n")


def growth(ret: str | Column, by: Sequence[str] | str) -> Column:
    """Running ``Π(1 + r)`` in date order."""
    r = F.col(ret) if isinstance(ret, str) else ret
    return F.product(1 + r).over(series(by).rowsBetween(*RUNNING))


def benchmark_returns(prices: DataFrame, by: str = "symbol") -> DataFrame:
    daily = simple_returns(prices, by)
    return daily.withColumn("cum_ret", growth("ret", by) - 1)


def portfolio_returns(positions: DataFrame, prices: DataFrame, by: str = "portfolio_id") -> DataFrame:
    """Constant-weight return on common dates; the first day is 0; weights renormalised."""
    held = align_intersection(positions, prices, by)
    r = F.coalesce(F.try_divide(F.col("price"), F.lag("price").over(series([by, "symbol"]))) - 1, F.lit(0.0))
    return (
        held.withColumn("r", r)
        .groupBy(by, "date")
        .agg(F.try_divide(F.sum(F.col("weight") * F.col("r")), F.sum("weight")).alias("ret"))
    )


def portfolio_returns_filled(positions: DataFrame, prices: DataFrame, by: str = "portfolio_id") -> DataFrame:
    """Weighted return on the union of dates with forward-filled holdings."""
    held = align_forward_fill(positions, prices, by)
    r = F.coalesce(F.try_divide(F.col("price"), F.lag("price").over(series([by, "symbol"]))) - 1, F.lit(0.0))
    return held.withColumn("r", r).groupBy(by, "date").agg(F.sum(F.col("weight") * F.col("r")).alias("ret"))


def portfolio_returns_drift(positions: DataFrame, prices: DataFrame, by: str = "portfolio_id") -> DataFrame:
    """Buy-and-hold return over the shares held at the start of each day."""
    held = align_intersection(positions, prices, by)
    w = series([by, "symbol"])
    value = F.col("quantity") * F.col("price")
    prev_date = F.lag("date").over(w)
    owned = F.col("purchase_date").isNull() | (prev_date >= F.col("purchase_date"))
    stepped = held.select(
        by,
        "date",
        F.when(owned, value).alias("now"),
        F.when(owned, F.lag(value).over(w)).alias("before"),
        prev_date.isNull().alias("first"),
    )
    agg = stepped.groupBy(by, "date").agg(F.sum("now").alias("now"), F.sum("before").alias("before"))
    return agg.select(
        by, "date", F.when(F.col("before") > 0, F.col("now") / F.col("before") - 1).otherwise(0.0).alias("ret")
    )


def weight_mode(positions: DataFrame, requested: str = "drift", by: str = "portfolio_id") -> DataFrame:
    every = F.bool_and(F.coalesce(F.col("quantity") > 0, F.lit(False)))
    return positions.groupBy(by).agg(
        F.when(F.lit(requested == "drift") & every, "drift").otherwise("constant").alias("mode")
    )


def price_index(returns: DataFrame, by: str = "portfolio_id", base: float = 100.0) -> DataFrame:
    return returns.withColumn("price", base * growth("ret", by))


def sleeve_index(holdings: DataFrame, prices: DataFrame, by: Sequence[str] = ("portfolio_id", "sleeve")) -> DataFrame:
    """Within-sleeve renormalised returns compounded to an index; the first common day is dropped."""
    keys = list(by)
    n = F.count("*").over(W.partitionBy(*keys))
    share = F.col("weight") / F.sum("weight").over(W.partitionBy(*keys))
    held = (
        holdings.select(*keys, "symbol", share.alias("share"), n.alias("n_holdings"))
        .join(prices.select("symbol", "date", "price"), "symbol")
        .repartition(keys[0])  # one layout for all windows and sums below
        .withColumn("_n", F.count("price").over(W.partitionBy(*keys, "date")))
        .where("_n = n_holdings")
    )
    r = F.col("price") / F.lag("price").over(series([*keys, "symbol"])) - 1
    daily = (
        held.withColumn("r", r).where("r is not null").groupBy(*keys, "date")
        .agg(F.sum(F.col("share") * F.col("r")).alias("ret"))
    )
    return daily.withColumn("price", 100.0 * growth("ret", keys))


def running_drawdown(prices: DataFrame, by: Sequence[str] | str = "symbol") -> DataFrame:
    peak = F.max("price").over(series(by).rowsBetween(*RUNNING))
    return prices.withColumn("drawdown", F.col("price") / peak - 1)


def drawdown_with_forecast(history: DataFrame, forecast: DataFrame, by: str = "symbol") -> DataFrame:
    """One drawdown curve whose forecast part keeps the historical peak; ordered CI bands."""
    h = history.select(by, "date", "price", F.lit(False).alias("is_forecast"))
    f = forecast.select(by, "date", "price", "lower", "upper", F.lit(True).alias("is_forecast"))
    both = h.unionByName(f, allowMissingColumns=True)
    w = W.partitionBy(by).orderBy("is_forecast", "date").rowsBetween(*RUNNING)
    hist_peak = F.max(F.when(~F.col("is_forecast"), F.col("price"))).over(w)
    out = both.withColumn("drawdown", F.col("price") / F.max("price").over(w) - 1)
    for band in ("lower", "upper"):
        peak = F.greatest(hist_peak, F.max(band).over(w))
        out = out.withColumn(f"_{band}", F.when(F.col("is_forecast"), F.col(band) / peak - 1))
    return out.select(
        by,
        "date",
        "is_forecast",
        "drawdown",
        F.least("_lower", "_upper").alias("dd_lower"),
        F.greatest("_lower", "_upper").alias("dd_upper"),
    )


def monthly_returns(prices: DataFrame, by: str = "symbol") -> DataFrame:
    """Last over first per calendar month, clamped; one-row months are partial with return 0."""
    month = F.trunc("date", "month")
    agg = prices.groupBy(by, month.alias("month")).agg(
        F.min_by("price", "date").alias("first"), F.max_by("price", "date").alias("last"), F.count("*").alias("n_days")
    )
    ret = clamp_return(F.col("last") / F.col("first") - 1)
    return agg.select(
        by,
        "month",
        F.when(F.col("n_days") >= 2, ret).otherwise(0.0).alias("ret"),
        (F.col("n_days") < 2).alias("partial"),
        "n_days",
    )


def monthly_returns_spliced(history: DataFrame, forecast: DataFrame, by: str = "symbol", trailing: int = 12) -> DataFrame:
    """Trailing historical months plus forecast months; a shared month starts at the last close."""
    recent = F.row_number().over(W.partitionBy(by).orderBy(F.desc("month")))
    hist = (
        monthly_returns(history, by).withColumn("_rn", recent).where(F.col("_rn") <= trailing)
        .select(by, "month", "ret", "partial", F.lit(False).alias("is_forecast"), F.lit(False).alias("spliced"))
    )
    anchor = history.groupBy(by).agg(
        F.max_by("price", "date").alias("anchor"), F.trunc(F.max("date"), "month").alias("shared")
    )
    fc = monthly_returns(forecast, by)
    ends = forecast.groupBy(by, F.trunc("date", "month").alias("month")).agg(F.max_by("price", "date").alias("end"))
    lo = monthly_returns(forecast.withColumn("price", F.col("lower")), by).select(by, "month", F.col("ret").alias("lo"))
    up = monthly_returns(forecast.withColumn("price", F.col("upper")), by).select(by, "month", F.col("ret").alias("up"))
    is_shared = F.col("month") == F.col("shared")
    out = (
        fc.join(ends, [by, "month"]).join(anchor, by).join(lo, [by, "month"]).join(up, [by, "month"])
        .select(
            by,
            "month",
            F.when(is_shared, clamp_return(F.col("end") / F.col("anchor") - 1)).otherwise(F.col("ret")).alias("ret"),
            "partial",
            F.lit(True).alias("is_forecast"),
            is_shared.alias("spliced"),
            F.least("lo", "up").alias("lower"),
            F.greatest("lo", "up").alias("upper"),
        )
    )
    return hist.unionByName(out, allowMissingColumns=True)


def monthly_spine(prices: DataFrame, by: str = "symbol", min_rows: int = 2) -> DataFrame:
    """Twelve rows per (key, year); months with fewer than ``min_rows`` closes are NULL."""
    first, last = F.min_by("price", "date"), F.max_by("price", "date")
    agg = prices.groupBy(by, F.year("date").alias("year"), F.month("date").alias("month")).agg(
        F.when((F.count("*") >= min_rows) & (first > 0), last / first - 1).alias("ret")
    )
    spine = agg.select(by, "year").distinct().withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return spine.join(agg, [by, "year", "month"], "left")


def coverage_run(spine: DataFrame, by: str = "symbol") -> DataFrame:
    """First contiguous run of covered months per year, with its compounded percentage."""
    w = W.partitionBy(by, "year").orderBy("month")
    covered = spine.where("ret is not null")
    island = F.col("month") - F.row_number().over(w)
    runs = covered.withColumn("_island", island)
    first = F.min("_island").over(W.partitionBy(by, "year"))
    kept = runs.withColumn("_first", first).where("_island = _first").select(by, "year", "month")
    marked = spine.join(kept.withColumn("in_run", F.lit(True)), [by, "year", "month"], "left")
    r = F.when(F.col("in_run"), 1 + F.col("ret"))
    cum = (F.product(r).over(w.rowsBetween(*RUNNING)) - 1) * 100
    return marked.select(
        by, "year", "month", "ret", F.coalesce("in_run", F.lit(False)).alias("in_run"),
        F.when(F.col("in_run"), cum).alias("cum_pct"),
    )


def period_returns(prices: DataFrame, by: str = "symbol", months: Sequence[int] = (3, 6, 12, 24)) -> DataFrame:
    """Trailing-month returns; NULL where the history does not cover the window."""
    ends = prices.groupBy(by).agg(
        F.max("date").alias("end"), F.max_by("price", "date").alias("last"), F.count("*").alias("n")
    )
    windows = ends.withColumn("months", F.explode(F.array(*[F.lit(m) for m in months]))).withColumn(
        "cutoff", F.add_months("end", -F.col("months"))
    )
    start = (
        prices.join(windows, by).where(F.col("date") >= F.col("cutoff")).groupBy(by, "months")
        .agg(
            F.min_by("price", "date").alias("start"), F.count("*").alias("rows_in"),
            F.first("last").alias("last"),
        )
    )
    ok = (F.col("rows_in") >= 2) & (F.col("start") > 0)
    return start.select(by, "months", F.when(ok, F.col("last") / F.col("start") - 1).alias("ret"))


def momentum_facts(prices: DataFrame, by: str = "symbol") -> DataFrame:
    """21/63/126-row changes (%), range position (%) and volatility (%) over the last year of rows."""
    w = series(by)
    last_year = prices.withColumn("_end", F.max("date").over(W.partitionBy(by))).where(
        F.col("date") >= F.date_sub("_end", 366)
    )
    calc = last_year.select(
        by, "date", "price",
        *[((F.col("price") / F.lag("price", n).over(w) - 1) * 100).alias(f"chg_{n}") for n in (21, 63, 126)],
        (F.col("price") / F.lag("price").over(w) - 1).alias("r"),
    )
    lo, hi = F.min("price"), F.max("price")
    last = F.max_by("price", "date")
    return calc.groupBy(by).agg(
        last.alias("last"),
        *[F.max_by(f"chg_{n}", "date").alias(f"chg_{n}") for n in (21, 63, 126)],
        F.when(hi > lo, (last - lo) / (hi - lo) * 100).alias("range_pos"),
        (F.stddev_samp("r") * F.sqrt(F.lit(252.0)) * 100).alias("ann_vol"),
    )


def ohlc_bars(prices: DataFrame, by: str = "symbol", unit: str = "week") -> DataFrame:
    """Open/high/low/close per ISO week or month, labelled by the last day present."""
    keys = [by] + (["is_forecast"] if "is_forecast" in prices.columns else [])
    bucket = F.to_date(F.date_trunc(unit, "date"))
    return (
        prices.groupBy(*keys, bucket.alias("bucket"))
        .agg(
            F.max("date").alias("time"), F.min_by("price", "date").alias("open"), F.max("price").alias("high"),
            F.min("price").alias("low"), F.max_by("price", "date").alias("close"),
        )
        .drop("bucket")
    )


def watchlist_snapshot(prices: DataFrame, by: str = "symbol", rows: int = 30) -> DataFrame:
    """Latest price, one-row change, trailing annualised volatility and sparkline."""
    rn = F.row_number().over(W.partitionBy(by).orderBy(F.desc("date")))
    r = simple_returns(prices, by, drop_first=False).withColumn("_rn", rn).where(F.col("_rn") <= rows)
    line = F.transform(F.array_sort(F.collect_list(F.struct("date", "price"))), lambda s: s["price"])
    return r.groupBy(by).agg(
        F.max(F.when(F.col("_rn") == 1, F.col("price"))).alias("latest"),
        F.max(F.when(F.col("_rn") == 1, F.col("ret"))).alias("change_1d"),
        (F.stddev_samp("ret") * F.sqrt(F.lit(252.0))).alias("vol_30d"),
        line.alias("sparkline"),
    )


def rebased(prices: DataFrame, by: str = "symbol", base: float = 100.0) -> DataFrame:
    first = F.first("price").over(series(by).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return prices.withColumn("idx", F.col("price") / first * base)


def synthetic_candles(prices: DataFrame, by: str = "symbol") -> DataFrame:
    """Candles from closes: open is the previous close, wicks 0.6 of the larger of body and 0.35%."""
    opened = F.coalesce(F.lag("price").over(series(by)), F.col("price"))
    out = prices.withColumn("open", opened)
    span = F.greatest(F.abs(F.col("price") - F.col("open")), F.col("price") * 0.0035)
    return out.select(
        by,
        "date",
        "open",
        (F.greatest("open", "price") + span * 0.6).alias("high"),
        (F.least("open", "price") - span * 0.6).alias("low"),
        F.col("price").alias("close"),
    )
