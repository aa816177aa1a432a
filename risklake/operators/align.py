"""Date alignment: intersection, forward fill, as-of and event windows.

A price series is unique on (symbol, date), so a window over one symbol or one portfolio is
bounded by the trading calendar times its holdings, whatever the volume of trades behind it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def series(by: Sequence[str] | str, order: str = "date"):
    keys = [by] if isinstance(by, str) else list(by)
    return W.partitionBy(*keys).orderBy(order)


def clean_prices(raw: DataFrame, by: str = "symbol", version: str = "updated_at") -> DataFrame:
    """Numeric, positive, one row per (symbol, date); the newest version wins."""
    price = F.col("price").cast("string").try_cast("double")
    return (
        raw.withColumn("price", price)
        .where("price is not null and not isnan(price) and price > 0")
        .groupBy(by, "date")
        .agg(F.max_by("price", version).alias("price"))
    )


def align_pair(left: DataFrame, right: DataFrame, on: Sequence[str] = ("date",)) -> DataFrame:
    """Both legs on their common days: ``(on…, a, b)``."""
    keys = list(on)
    return left.select(*keys, F.col("price").alias("a")).join(
        right.select(*keys, F.col("price").alias("b")), keys
    )


def with_holding_count(positions: DataFrame, by: str = "portfolio_id") -> DataFrame:
    return positions.withColumn("n_holdings", F.count("*").over(W.partitionBy(by)))


def align_intersection(positions: DataFrame, prices: DataFrame, by: str = "portfolio_id") -> DataFrame:
    """Holding prices on the dates where *all* holdings of the portfolio have one.

    The panel (holdings × dates) is the largest table of a portfolio job, so it is shuffled once, by
    portfolio: that one layout serves the count per date, every per-holding window and every per-date
    sum that follows. A portfolio's panel is bounded by the calendar times its distinct holdings.
    """
    joined = with_holding_count(positions, by).join(prices.select("symbol", "date", "price"), "symbol").repartition(by)
    priced = F.count("price").over(W.partitionBy(by, "date"))
    return joined.withColumn("_n", priced).where("_n = n_holdings").drop("_n")


def align_forward_fill(positions: DataFrame, prices: DataFrame, by: str = "portfolio_id") -> DataFrame:
    """Union of the holdings' dates, each holding carried forward from its last price."""
    held = positions.join(prices.select("symbol", "date", "price"), "symbol")
    spine = held.select(by, "date").distinct().join(positions, by)
    keyed = spine.join(held.select(by, "symbol", "date", "price"), [by, "symbol", "date"], "left")
    carried = F.last("price", ignorenulls=True).over(
        series([by, "symbol"]).rowsBetween(W.unboundedPreceding, 0)
    )
    return keyed.withColumn("price", carried)


def as_of(left: DataFrame, right: DataFrame, by: str, value: str, strict: bool = False) -> DataFrame:
    """For every left row, the last right ``value`` at (or, if strict, before) its date.

    One union and one sort per key; on equal dates a strict match sorts the left row first.
    """
    probe = left.withColumn("_probe", F.lit(True)).withColumn("_tie", F.lit(0 if strict else 1))
    facts = right.select(by, "date", F.col(value).alias("_value")).withColumn("_tie", F.lit(1 if strict else 0))
    merged = probe.unionByName(facts, allowMissingColumns=True)
    w = W.partitionBy(by).orderBy("date", "_tie").rowsBetween(W.unboundedPreceding, 0)
    return (
        merged.withColumn(value, F.last("_value", ignorenulls=True).over(w))
        .where("_probe")
        .drop("_probe", "_tie", "_value")
    )


def align_benchmark(dates: DataFrame, bench: DataFrame, by: str, min_coverage: float = 0.9) -> DataFrame:
    """Benchmark on each key's dates, re-based to 100; NULL unless both ends and 90% are covered."""
    joined = dates.join(bench.select("date", F.col("price").alias("_b")), "date", "left")
    w, whole = series(by), W.partitionBy(by)
    first = F.first("_b").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    last = F.last("_b").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    share = F.avg(F.col("_b").isNotNull().cast("double")).over(whole)
    filled = F.last("_b", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    usable = first.isNotNull() & last.isNotNull() & (share >= min_coverage) & (first > 0)
    return joined.select(
        *dates.columns, F.when(usable, filled / first * 100.0).alias("benchmark")
    )


def first_available(prices: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """Rows of the first candidate symbol that has any, with that symbol as ``label``."""
    rank = F.array_position(F.array(*[F.lit(c) for c in candidates]), F.col("symbol"))
    ranked = prices.where(F.col("symbol").isin(*candidates)).withColumn("_rank", rank)
    best = ranked.agg(F.min_by("symbol", "_rank").alias("label"))
    return ranked.join(best, F.col("symbol") == F.col("label")).drop("_rank")


def event_window(
    portfolio: DataFrame, events: DataFrame, by: str = "portfolio_id", before: int = 15, after: int = 15
) -> DataFrame:
    """Trading-day window around each event, re-based to 100 with drawdown and impact.

    ``status`` is ``rejected`` (one row, no series) when the event lies outside the history.
    """
    numbered = portfolio.select(
        by, "date", "price", (F.row_number().over(series(by)) - 1).alias("rn")
    )
    # one sweep over dates and events together: an event stands before the close of its day and sees the next place
    swept = numbered.select(by, "date", "rn").unionByName(events.select(by, F.col("event_date").alias("date")).distinct(), allowMissingColumns=True)
    line = W.partitionBy(by).orderBy("date", F.col("rn").isNotNull())
    whole_line = W.partitionBy(by)
    swept = swept.select(
        by, F.col("date").alias("event_date"), "rn", F.first("rn", ignorenulls=True).over(line.rowsBetween(0, W.unboundedFollowing)).alias("pos"),
        F.min(F.when(F.col("rn").isNotNull(), F.col("date"))).over(whole_line).alias("_lo"), F.max(F.when(F.col("rn").isNotNull(), F.col("date"))).over(whole_line).alias("_hi"),
    )
    anchors = swept.where("rn is null and _lo is not null").drop("rn")
    inside = F.col("event_date").between(F.col("_lo"), F.col("_hi"))
    ok = anchors.where(inside).select(by, "event_date", "pos", F.greatest(F.lit(0), F.col("pos") - before).alias("start"))
    places = ok.select("*", F.explode(F.sequence("start", F.col("pos") + after)).alias("rn"))
    window_rows = places.join(numbered, [by, "rn"])
    w = W.partitionBy(by, "event_date").orderBy("date")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    indexed = window_rows.withColumn("idx", F.col("price") / F.first("price").over(whole) * 100.0)
    indexed = indexed.withColumn(
        "drawdown", (F.col("idx") / F.max("idx").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1) * 100
    )
    at_anchor = F.when(F.col("rn") == F.greatest(F.col("start"), F.col("pos") - 1), F.col("idx"))
    out = indexed.select(
        by,
        "event_date",
        "date",
        (F.col("rn") - F.col("start")).alias("day_no"),
        "idx",
        "drawdown",
        (F.last("idx").over(whole) / F.max(at_anchor).over(whole) - 1).alias("event_return"),
        (F.min("drawdown").over(whole) / 100).alias("drawdown_peak"),
        F.lit("ok").alias("status"),
    )
    rejected = anchors.where(~inside).select(by, "event_date", F.lit("rejected").alias("status"))
    return out.unionByName(rejected, allowMissingColumns=True)
