"""Performance, tail-risk, exposure and attribution aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from risklake.functions.scalar import fragility_label
from risklake.operators.align import align_intersection, series
from risklake.operators.returns import period_returns, running_drawdown, simple_returns

TRADING_DAYS = 252.0
ANNUAL = math.sqrt(TRADING_DAYS)
RISK_FREE_DAILY = 0.03 / TRADING_DAYS


def performance_table(prices: DataFrame, by: str = "symbol") -> DataFrame:
    """Every performance and tail metric of each series: two aggregations over one return table.

    The first pass finds the moments and the tail quantiles, the second averages beyond them.
    Both group by the same key, so the plan shuffles the series once.
    """
    r = simple_returns(prices, by)
    w = series(by).rowsBetween(W.unboundedPreceding, 0)
    # growth from the first price equals the compounded return; its peak starts at the first return
    dd = r.withColumn("drawdown", F.col("price") / F.max("price").over(w) - 1)
    whole = W.partitionBy(by)
    cuts = dd.select(
        by,
        "ret",
        "drawdown",
        F.percentile("ret", F.lit(0.05)).over(whole).alias("var_95"),
        F.percentile("ret", F.lit(0.01)).over(whole).alias("var_99"),
        F.percentile("drawdown", F.lit(0.05)).over(whole).alias("_dd05"),
    )
    ret = F.col("ret")
    agg = cuts.groupBy(by).agg(
        F.count("*").alias("n"),
        F.avg("ret").alias("mean"),
        F.stddev_samp("ret").alias("vol"),
        F.stddev_samp(F.when(ret < 0, ret)).alias("downside"),
        F.sum(F.when(ret > 0, ret).otherwise(0.0)).alias("gain"),
        F.abs(F.sum(F.when(ret < 0, ret).otherwise(0.0))).alias("loss"),
        F.avg((ret > 0).cast("double")).alias("hit_rate"),
        F.min("drawdown").alias("max_drawdown"),
        F.max("var_95").alias("var_95"),
        F.max("var_99").alias("var_99"),
        F.avg(F.when(ret <= F.col("var_95"), ret)).alias("cvar_95"),
        F.avg(F.when(ret <= F.col("var_99"), ret)).alias("cvar_99"),
        F.avg(F.when(F.col("drawdown") <= F.col("_dd05"), F.col("drawdown"))).alias("cdar_95"),
    )
    mean, vol = F.col("mean"), F.col("vol")
    annual = F.when(mean > -1, F.pow(1 + mean, F.lit(TRADING_DAYS)) - 1).otherwise(-1.0)
    excess = (mean - RISK_FREE_DAILY) * ANNUAL
    return agg.select(
        by,
        "n",
        annual.alias("annualized_return"),
        (vol * ANNUAL).alias("annualized_volatility"),
        F.when(vol > 0, excess / vol).otherwise(0.0).alias("sharpe"),
        F.when(F.col("downside") > 0, excess / F.col("downside")).otherwise(0.0).alias("sortino"),
        "max_drawdown",
        F.when(F.col("max_drawdown") < 0, annual / F.abs("max_drawdown")).otherwise(0.0).alias("calmar"),
        F.when(F.col("loss") > 0, F.col("gain") / F.col("loss"))
        .when(F.col("gain") > 0, 10.0).otherwise(0.0).alias("profit_factor"),
        "hit_rate",
        "var_95",
        "var_99",
        "cvar_95",
        "cvar_99",
        "cdar_95",
    )


def empirical_cdar(prices: DataFrame, by: str = "symbol", alpha: float = 0.95) -> DataFrame:
    """Positive-sign conditional drawdown: mean of the drawdowns at or beyond their quantile."""
    dd = running_drawdown(prices, by).withColumn("_d", -F.col("drawdown"))
    q = F.percentile("_d", F.lit(alpha)).over(W.partitionBy(by))
    tail = dd.withColumn("_q", q).where("_d >= _q")
    return tail.groupBy(by).agg(F.greatest(F.avg("_d"), F.lit(1e-4)).alias("cdar"))


def portfolio_beta(port: DataFrame, bench: DataFrame, by: str = "portfolio_id") -> DataFrame:
    """cov/var on common days; 1.0 with fewer than 30 or a flat benchmark."""
    both = port.select(by, "date", F.col("ret").alias("p")).join(
        bench.select("date", F.col("ret").alias("b")), "date"
    )
    var = F.var_samp("b")
    ok = (F.count("*") >= 30) & (var != 0)
    return both.groupBy(by).agg(
        F.when(ok, F.try_divide(F.covar_samp("p", "b"), var)).otherwise(1.0).alias("beta")
    )


def window_contributions(
    positions: DataFrame, prices: DataFrame, start: str, end: str, by: str = "portfolio_id"
) -> DataFrame:
    """Return of each holding inside [start, end] and its weighted contribution; NULL below 2 rows."""
    inside = prices.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    first, last = F.min_by("price", "date"), F.max_by("price", "date")
    moves = inside.groupBy("symbol").agg(F.when((F.count("*") >= 2) & (first > 0), last / first - 1).alias("ret"))
    joined = positions.select(by, "symbol", "weight").join(moves, "symbol", "left")
    return joined.withColumn("contribution", F.col("ret") * F.col("weight"))


def ranked_contributions(contrib: DataFrame, by: str = "portfolio_id") -> DataFrame:
    """Contribution rank per portfolio, missing holdings last."""
    order = W.partitionBy(by).orderBy(F.desc_nulls_last("contribution"), "symbol")
    return contrib.withColumn("rank", F.row_number().over(order))


def top_and_bottom(contrib: DataFrame, by: str = "portfolio_id", top: int = 3, bottom: int = 2) -> DataFrame:
    """Top contributors, and the worst among those not already shown as top."""
    real = contrib.where("contribution is not null")
    w = W.partitionBy(by)
    up = F.row_number().over(w.orderBy(F.desc("contribution"), "symbol"))
    down = F.row_number().over(w.orderBy("contribution", F.desc("symbol")))
    ranked = real.withColumn("_up", up).withColumn("_down", down)
    side = F.when(F.col("_up") <= top, "top").when(F.col("_down") <= bottom, "bottom")
    return ranked.withColumn("side", side).where("side is not null").drop("_up", "_down")


def performance_block(
    index: DataFrame, bench: DataFrame, positions: DataFrame, prices: DataFrame, by: str = "portfolio_id"
) -> DataFrame:
    """3/6/12/24-month portfolio and benchmark returns; the longest covered window is attributed.

    ``residual`` is the headline return minus the summed holding contributions.
    """
    port = period_returns(index, by).withColumnRenamed("ret", "portfolio_ret").where("portfolio_ret is not null")
    b = period_returns(bench, "symbol").select("months", F.col("ret").alias("benchmark_ret"))
    out = port.join(b, "months", "left").withColumn("relative", F.col("portfolio_ret") - F.col("benchmark_ret"))
    headline = port.groupBy(by).agg(F.max("months").alias("headline"))
    span = index.groupBy(by).agg(F.max("date").alias("end")).join(headline, by)
    held = positions.select(by, "symbol", "weight").join(span, by).join(prices.select("symbol", "date", "price"), "symbol")
    inside = held.where((F.col("date") >= F.add_months("end", -F.col("headline"))) & (F.col("date") <= F.col("end")))
    first, last = F.min_by("price", "date"), F.max_by("price", "date")
    moves = inside.groupBy(by, "symbol", "headline").agg(
        F.when((F.count("*") >= 2) & (first > 0), (last / first - 1) * F.first("weight")).alias("contribution")
    )
    covered = moves.groupBy(by, F.col("headline").alias("months")).agg(F.sum("contribution").alias("covered"))
    return out.join(covered, [by, "months"], "left").select(
        by, "months", "portfolio_ret", "benchmark_ret", "relative", (F.col("portfolio_ret") - F.col("covered")).alias("residual")
    )


# ---- covariance ----------------------------------------------------------------------
def common_returns(
    positions: DataFrame, prices: DataFrame, by: str = "portfolio_id", log: bool = False, min_rows: int = 60
) -> DataFrame:
    """Holding returns on the dates where every holding has one; portfolios with enough dates."""
    prev = F.lag("price").over(series("symbol"))
    ratio = F.col("price") / prev
    moves = prices.select("symbol", "date", (F.log(ratio) if log else ratio - 1).alias("price"))
    held = align_intersection(positions, moves.where("price is not null"), by)
    n = F.count("*").over(W.partitionBy(by, "symbol"))
    return held.withColumnRenamed("price", "ret").withColumn("_n", n).where(F.col("_n") >= min_rows).drop("_n")


_GRAM = "{by} {type}, symbol_i string, symbol_j string, n long, sx double, sy double, sxy double"


def covariance_matrix(
    returns: DataFrame, by: str = "portfolio_id", annualise: float = TRADING_DAYS, chunk: str = "year"
) -> DataFrame:
    """Long (i, j) sample covariance of the aligned returns of each key.

    Each task multiplies one key's chunk of dates as a small matrix and emits only the N×N moment
    sums, which then add up across chunks: no date × pair rows, and no task holds a whole history.
    """
    kind = returns.schema[by].dataType.simpleString()
    # moments about a per-symbol centre keep the sums free of cancellation
    centred = returns.withColumn("_x", F.col("ret") - F.avg("ret").over(W.partitionBy(by, "symbol")))

    def gram(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf[by].iloc[0]
        wide = pdf.pivot(index="date", columns="symbol", values="_x").to_numpy()
        names = sorted(pdf["symbol"].unique())
        i, j = np.triu_indices(len(names))
        sums = wide.sum(axis=0)
        return pd.DataFrame(
            {
                by: key,
                "symbol_i": [names[a] for a in i],
                "symbol_j": [names[b] for b in j],
                "n": len(wide),
                "sx": sums[i],
                "sy": sums[j],
                "sxy": (wide.T @ wide)[i, j],
            }
        )

    parts = (
        centred.select(by, "date", "symbol", "_x", F.date_trunc(chunk, "date").alias("_chunk"))
        .groupBy(by, "_chunk")
        .applyInPandas(gram, _GRAM.format(by=by, type=kind))
    )
    agg = parts.groupBy(by, "symbol_i", "symbol_j").agg(
        F.sum("n").alias("n"), F.sum("sx").alias("sx"), F.sum("sy").alias("sy"), F.sum("sxy").alias("sxy")
    )
    cov = (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / (F.col("n") - 1) * annualise
    return agg.select(by, "symbol_i", "symbol_j", "n", cov.alias("cov"))


def risk_contributions(returns: DataFrame, by: str = "portfolio_id") -> DataFrame:
    """Share of portfolio volatility per holding.

    ``w·(Σw)`` is the covariance of the holding with the portfolio itself, so no covariance matrix
    is needed: the cost is linear in the holdings.
    """
    total = F.sum("weight").over(W.partitionBy(by, "date"))
    weighted = returns.withColumn("w", F.col("weight") / total)
    port = F.sum(F.col("w") * F.col("ret")).over(W.partitionBy(by, "date"))
    agg = weighted.withColumn("rp", port).groupBy(by, "symbol").agg(
        F.max("w").alias("weight"),
        (F.covar_samp("ret", "rp") * TRADING_DAYS).alias("cov_p"),
        (F.var_samp("rp") * TRADING_DAYS).alias("var_p"),
        F.count("*").alias("n_obs"),
    )
    vol = F.sqrt("var_p")
    part = F.col("weight") * F.col("cov_p") / vol
    return agg.where("var_p > 0").select(
        by, "symbol", "weight", "n_obs", part.alias("risk_contribution"), (part / vol).alias("risk_pct"), vol.alias("portfolio_vol")
    )


def spectral_diversification(cov: DataFrame, by: str = "portfolio_id") -> DataFrame:
    """Entropy of the correlation spectrum, its ratio to ln N, and the dominant share.

    One group is a portfolio's N×N matrix, bounded by its holdings.
    """
    kind = cov.schema[by].dataType.simpleString()

    def spectrum(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["symbol_i"]) | set(pdf["symbol_j"]))
        at = {name: k for k, name in enumerate(names)}
        m = np.zeros((len(names), len(names)))
        for a, b, c in zip(pdf["symbol_i"], pdf["symbol_j"], pdf["cov"]):
            m[at[a], at[b]] = m[at[b], at[a]] = c
        sd = np.sqrt(np.diag(m))
        share = np.clip(np.linalg.eigvalsh(m / np.outer(sd, sd)) / len(names), 1e-12, 1.0)
        p = share / share.sum()
        entropy = float(-(p * np.log(p)).sum())
        return pd.DataFrame(
            {
                by: [pdf[by].iloc[0]],
                "n_assets": [len(names)],
                "entropy": [entropy],
                "diversification_ratio": [entropy / math.log(len(names)) if len(names) > 1 else 0.0],
                "dominant": [float(share.max())],
            }
        )

    schema = f"{by} {kind}, n_assets long, entropy double, diversification_ratio double, dominant double"
    return cov.groupBy(by).applyInPandas(spectrum, schema)


# ---- exposure ------------------------------------------------------------------------
def sector_exposure(positions: DataFrame, by: str = "portfolio_id") -> DataFrame:
    sector = F.coalesce("sector", F.lit("Unknown"))
    return positions.groupBy(by, sector.alias("sector")).agg(F.sum("weight").alias("exposure"))


def rate_sensitive_weight(positions: DataFrame, by: str = "portfolio_id") -> DataFrame:
    share = F.sum(F.when(F.upper("asset_type").isin("BOND", "FUTURE"), F.col("weight")).otherwise(0.0))
    return positions.groupBy(by).agg(share.alias("rate_sensitive_weight"))


def allocation_by(positions: DataFrame, column: str, by: str = "portfolio_id") -> DataFrame:
    return positions.groupBy(by, column).agg(F.sum("weight").alias("weight"))


def monthly_vol(prices: DataFrame, by: str = "symbol", min_returns: int = 5) -> DataFrame:
    r = simple_returns(prices, by)
    vol = F.when(F.count("ret") >= min_returns, F.stddev_samp("ret") * ANNUAL * 100)
    return r.groupBy(by, F.trunc("date", "month").alias("month")).agg(vol.alias("vol_pct"))


def monthly_fragility(positions: DataFrame, snapshots: DataFrame, by: str = "portfolio_id") -> DataFrame:
    """Latest snapshot of each holding in the month, weight-averaged over the covered holdings."""
    month = F.trunc("date", "month")
    latest = snapshots.groupBy("symbol", month.alias("month")).agg(F.max_by("fragility", F.struct("date", "fragility")).alias("fragility"))
    j = positions.where("weight > 0").join(latest.where("fragility is not null"), "symbol")
    return j.groupBy(by, "month").agg(
        (F.sum(F.col("fragility") * F.col("weight")) / F.sum("weight")).alias("fragility")
    )


def quarter_facts(returns: DataFrame, by: str = "portfolio_id", rows: int = 63, min_rows: int = 30) -> DataFrame:
    """Trailing-quarter and whole-period return, volatility and drawdown in percent."""
    w = W.partitionBy(by)
    data = returns.withColumn("_rn", F.row_number().over(w.orderBy(F.desc("date"))))
    up_to = w.orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    data = data.withColumn("_eq", F.product(1 + F.col("ret")).over(up_to))
    data = data.withColumn("_dd", F.col("_eq") / F.max("_eq").over(up_to) - 1)
    return (
        data.groupBy(by)
        .agg(
            ((F.product(F.when(F.col("_rn") <= rows, 1 + F.col("ret"))) - 1) * 100).alias("quarter_pct"),
            ((F.product(1 + F.col("ret")) - 1) * 100).alias("year_pct"),
            (F.stddev_samp("ret") * ANNUAL * 100).alias("ann_vol_pct"),
            (F.min("_dd") * 100).alias("max_drawdown_pct"),
            F.count("*").alias("n_obs"),
        )
        .where(F.col("n_obs") >= min_rows)
    )


def risk_reconciliation(metrics: DataFrame, values: DataFrame, scenarios: DataFrame, by: str = "portfolio_id") -> DataFrame:
    """VaR, drawdown and worst scenario on one money basis, flagged when the stress set is too mild."""
    worst = scenarios.groupBy(by).agg(
        F.min_by("name", F.struct("return_pct", "name")).alias("worst_scenario"), F.min("return_pct").alias("worst_pct")
    )
    j = metrics.join(values, by).join(worst, by, "left")
    return j.select(
        by,
        "value",
        (F.col("value") * F.col("var_95")).alias("var_money"),
        (F.col("value") * F.col("max_drawdown")).alias("drawdown_money"),
        "worst_scenario",
        (F.col("value") * F.col("worst_pct") / 100).alias("worst_money"),
        F.coalesce(F.col("worst_pct") / 100 > F.col("max_drawdown"), F.lit(False)).alias("stress_too_mild"),
    )


def risk_findings(metrics: DataFrame, target_vol: float, by: str = "portfolio_id") -> DataFrame:
    """One row per finding; ``aligned`` when nothing stands out."""
    gap = F.col("annualized_volatility") - target_vol
    found = F.filter(
        F.array(
            F.when(F.abs(gap) > 0.02, F.when(gap > 0, "volatility_above_target").otherwise("volatility_below_target")),
            F.when(F.col("max_drawdown") < -0.15, F.lit("deep_drawdown")),
            F.when(F.col("sharpe") < 0.5, F.lit("thin_compensation")),
        ),
        lambda x: x.isNotNull(),
    )
    chosen = F.when(F.size(found) == 0, F.array(F.lit("aligned"))).otherwise(found)
    return metrics.select(by, F.explode(chosen).alias("finding"))


def histogram(samples: DataFrame, value: str, bins: int = 18, by: Sequence[str] = ()) -> DataFrame:
    """Fixed-width counts between min and max, last bin closed; empty bins included."""
    whole = not by
    keys = list(by) or ["_all"]
    if whole:
        samples = samples.withColumn("_all", F.lit(0))
    x = F.col(value)
    lo, hi = F.min(x), F.max(x)
    edges = samples.groupBy(*keys).agg(lo.alias("lo"), F.when(hi > lo, (hi - lo) / bins).otherwise(1.0).alias("width"))
    # equal values are counted before they meet their edges
    tallied = samples.groupBy(*keys, x.alias("_x")).agg(F.count("*").alias("_n")).join(edges, keys)
    slot = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("_x") - F.col("lo")) / F.col("width")))).cast("int")
    counts = tallied.groupBy(*keys, slot.alias("bin")).agg(F.sum("_n").alias("n"))
    spine = edges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    filled = spine.join(counts, [*keys, "bin"], "left")
    start = F.col("lo") + F.col("bin") * F.col("width")
    out = filled.select(*keys, "bin", start.alias("start"), (start + F.col("width")).alias("stop"), F.coalesce("n", F.lit(0)).alias("n"))
    return out.drop("_all") if whole else out


def usage_rollup(log: DataFrame, by: Sequence[str] = ("agent", "model")) -> DataFrame:
    """Calls, tokens, latency, errors and cache hits of a run log (the rows after an equal input)."""
    keys = list(by)
    per_input = log.groupBy(*keys, "input_hash").agg(
        F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.sum("latency_ms").alias("latency"),
        F.count(F.when(F.col("status") != "ok", 1)).alias("errors"),
    )
    return per_input.groupBy(*keys).agg(
        F.sum("calls").alias("calls"),
        F.sum("tokens").alias("tokens"),
        (F.sum("latency") / F.sum("calls")).alias("avg_latency"),
        F.sum("errors").alias("errors"),
        (F.sum("calls") - F.count("*")).alias("cache_hits"),
    )


def latest_dates(wanted: DataFrame, prices: DataFrame) -> DataFrame:
    last = prices.groupBy("symbol").agg(F.max("date").alias("latest_date"))
    return wanted.join(last, "symbol", "left")


def first_seen_order(rows: DataFrame, value: str, position: str) -> DataFrame:
    return rows.groupBy(value).agg(F.min(position).alias("first_pos"))


def latest_two_closes(prices: DataFrame, by: str = "symbol") -> DataFrame:
    rn = F.row_number().over(W.partitionBy(by).orderBy(F.desc("date")))
    top = prices.withColumn("_rn", rn).where(F.col("_rn") <= 2)
    return top.groupBy(by).agg(
        F.max(F.when(F.col("_rn") == 1, F.col("price"))).alias("latest"),
        F.max(F.when(F.col("_rn") == 2, F.col("price"))).alias("previous"),
    )


def value_positions(positions: DataFrame, closes: DataFrame) -> DataFrame:
    """Current value and P&L of the positions that carry a cost basis and shares."""
    priced = F.when((F.col("cost_basis") > 0) & (F.col("quantity") > 0), F.col("quantity"))
    value = priced * F.col("latest")
    pnl = value - F.col("cost_basis")
    return positions.join(closes, "symbol", "left").select(
        *positions.columns,
        value.alias("current_value"),
        pnl.alias("unrealized_pnl"),
        F.try_divide(pnl, F.col("cost_basis")).alias("unrealized_pnl_pct"),
        (priced * (F.col("latest") - F.col("previous"))).alias("daily_pnl"),
    )


def portfolio_totals(valued: DataFrame, by: Sequence[str] = ("portfolio_id",)) -> DataFrame:
    """Totals over the positions that could be valued."""
    known = valued.where("current_value is not null")
    cost = F.sum("cost_basis")
    pnl = F.sum("unrealized_pnl")
    return known.groupBy(*by).agg(
        cost.alias("cost_basis"), F.sum("current_value").alias("current_value"), pnl.alias("unrealized_pnl"),
        F.try_divide(pnl, cost).alias("unrealized_pnl_pct"), F.sum("daily_pnl").alias("daily_pnl"),
    )


def with_fragility_label(df: DataFrame, column: str = "fragility") -> DataFrame:
    return df.withColumn("label", fragility_label(column))
