"""Look-ahead-free VaR replay and its coverage tests, for every portfolio and method at once."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from risklake.functions.stats import CHI2_CRITICAL_5PCT, binomial_cdf, chi2_tail, normal_quantile, uniform, xlogy
from risklake.operators.align import as_of, series

MIN_TRAILING = 30
MIN_TEST_ROWS = 30


def replay_window(returns: DataFrame, est_window: int = 252, n_backtest: int = 250, horizon: int = 1, by: str = "portfolio_id") -> DataFrame:
    """The rows a replay reads: the scored tail plus the estimation rows before it.

    Adds ``rn`` (0-based), ``scored`` and the realised ``horizon``-row forward return. Portfolios
    without enough history drop out.
    """
    w = series(by)
    numbered = returns.select(by, "date", "ret", (F.row_number().over(w) - 1).alias("rn"), F.count("*").over(W.partitionBy(by)).alias("n"))
    enough = numbered.where(F.col("n") >= est_window + horizon + MIN_TEST_ROWS)
    start = F.greatest(F.lit(est_window), F.col("n") - n_backtest)
    needed = enough.where(F.col("rn") >= start - est_window)
    ahead = w.rowsBetween(0, horizon - 1)
    realised = F.when(F.count("*").over(ahead) == horizon, F.product(1 + F.col("ret")).over(ahead) - 1)
    return needed.withColumn("realized", realised).withColumn(
        "scored", (F.col("rn") >= start) & (F.col("rn") <= F.col("n") - horizon)
    )


def historical_var(replay: DataFrame, confidence: float = 0.95, est_window: int = 252, horizon: int = 1, by: str = "portfolio_id") -> DataFrame:
    """Percentile of the previous rows only; square-root scaling beyond one row."""
    frame = series(by).rowsBetween(-est_window, -1)
    return _scored(replay, _historical(confidence, horizon, frame), frame, "historical", by)


def parametric_var(replay: DataFrame, confidence: float = 0.95, est_window: int = 252, horizon: int = 1, by: str = "portfolio_id") -> DataFrame:
    """Normal quantile of the previous rows' mean and population deviation."""
    frame = series(by).rowsBetween(-est_window, -1)
    return _scored(replay, _parametric(confidence, horizon, frame), frame, "parametric", by)


def _historical(confidence: float, horizon: int, frame) -> Column:
    return F.percentile("ret", F.lit(1.0 - confidence)).over(frame) * math.sqrt(horizon)


def _parametric(confidence: float, horizon: int, frame) -> Column:
    z = normal_quantile(1.0 - confidence)
    return F.avg("ret").over(frame) * horizon + F.stddev_pop("ret").over(frame) * (math.sqrt(horizon) * z)


def _scored(replay: DataFrame, q: Column, frame, method: str, by: str) -> DataFrame:
    seen = F.count("ret").over(frame)
    out = replay.select(by, "date", "rn", "scored", "realized", F.when(seen >= MIN_TRAILING, q).alias("var"))
    return out.where("scored").select(by, "date", "realized", "var", F.lit(method).alias("method"))


def bootstrap_var(
    replay: DataFrame, confidence: float = 0.95, est_window: int = 252, n_sims: int = 400, horizon: int = 1, seed: int = 42, by: str = "portfolio_id"
) -> DataFrame:
    """Percentile of simulated portfolio returns drawn from earlier rows of the joint history.

    Drawing a past date keeps that day's whole cross-section, so the dependence between holdings
    is the empirical one. Each scored row carries its trailing returns as one array and draws from
    it in place: no draw becomes a row. Rows are dealt out by date, so one book's replay is shared.
    """
    past = F.collect_list("ret").over(series(by).rowsBetween(-est_window, -1))
    rows = replay.withColumn("past", past).where("scored").select(by, "date", "realized", F.col("rn").alias("as_of_rn"), "past")
    # an explicit number: the rows are few but dear, and adaptive coalescing would leave them to one task
    rows = rows.repartition(4 * replay.sparkSession.sparkContext.defaultParallelism, by, "date")

    def drawn(sim: Column, step: Column) -> Column:
        u = uniform(seed, by, "as_of_rn", sim, step)
        return 1 + F.get("past", F.lit(est_window - 1) - F.floor(u * est_window).cast("int"))

    def simulated(sim: Column) -> Column:
        if horizon == 1:
            return drawn(sim, F.lit(0)) - 1
        steps = F.sequence(F.lit(0), F.lit(horizon - 1))
        return F.aggregate(steps, F.lit(1.0), lambda level, step: level * drawn(sim, step)) - 1

    sims = rows.withColumn("sims", F.sort_array(F.transform(F.sequence(F.lit(0), F.lit(n_sims - 1)), simulated)))
    at = (1.0 - confidence) * (n_sims - 1)
    low, high = F.get("sims", F.lit(math.floor(at))), F.get("sims", F.lit(math.ceil(at)))
    return sims.select(by, "date", "realized", (low + (high - low) * (at - math.floor(at))).alias("var"), F.lit("bootstrap").alias("method"))


def coverage_tests(scored: DataFrame, confidence: float = 0.95, alpha: float = 0.05, keys: Sequence[str] = ("portfolio_id", "method")) -> DataFrame:
    """Exceptions, Kupiec, Christoffersen, Basel zone and observed shortfall per key."""
    keys = list(keys)
    p = 1.0 - confidence
    rows = scored.where("realized is not null and var is not null").withColumn("breach", F.col("realized") < F.col("var"))
    prev = F.lag("breach").over(W.partitionBy(*keys).orderBy("date"))
    rows = rows.withColumn("_prev", prev)

    def pairs(before: bool, now: bool) -> Column:
        return F.count(F.when((F.col("_prev") == before) & (F.col("breach") == now), 1)).cast("double")

    c = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col("breach"), 1)).alias("exceptions"),
        F.avg(F.when(F.col("breach"), F.col("realized"))).alias("expected_shortfall"),
        pairs(False, False).alias("n00"), pairs(False, True).alias("n01"),
        pairs(True, False).alias("n10"), pairs(True, True).alias("n11"),
    )
    n, x = F.col("n").cast("double"), F.col("exceptions").cast("double")
    rate = x / n
    # a fixed rate p against the observed one
    kupiec = -2 * (x * math.log(p) + (n - x) * math.log(1 - p) - xlogy(x, rate) - xlogy(n - x, 1 - rate))
    c = c.withColumn("breach_rate", rate).withColumn("kupiec_stat", F.greatest(kupiec, F.lit(0.0)))
    n00, n01, n10, n11 = (F.col(k) for k in ("n00", "n01", "n10", "n11"))
    p01 = F.coalesce(F.try_divide(n01, n00 + n01), F.lit(0.0))
    p11 = F.coalesce(F.try_divide(n11, n10 + n11), F.lit(0.0))
    pool = F.coalesce(F.try_divide(n01 + n11, n00 + n01 + n10 + n11), F.lit(0.0))
    c = c.withColumns({"_p01": p01, "_p11": p11, "_p": pool})
    same = xlogy(n01 + n11, F.col("_p")) + xlogy(n00 + n10, 1 - F.col("_p"))
    split = (
        xlogy(n01, F.col("_p01")) + xlogy(n00, 1 - F.col("_p01")) + xlogy(n11, F.col("_p11")) + xlogy(n10, 1 - F.col("_p11"))
    )
    c = c.withColumn("independence_stat", F.greatest(-2 * (same - split), F.lit(0.0)))
    c = c.withColumn("coverage_stat", F.col("kupiec_stat") + F.col("independence_stat"))
    c = c.withColumns({
        "kupiec_p": chi2_tail(F.col("kupiec_stat"), 1),
        "independence_p": chi2_tail(F.col("independence_stat"), 1),
        "coverage_p": chi2_tail(F.col("coverage_stat"), 2),
        "basel_cdf": binomial_cdf(F.col("exceptions"), F.col("n"), p),
    })
    if alpha == 0.05:  # exact critical values rather than the approximated tail
        rejects = {d: v for d, v in CHI2_CRITICAL_5PCT.items()}
        k_rej = F.col("kupiec_stat") > rejects[1]
        c_rej = F.col("coverage_stat") > rejects[2]
    else:
        k_rej, c_rej = F.col("kupiec_p") < alpha, F.col("coverage_p") < alpha
    zone = F.when(F.col("basel_cdf") < 0.95, "green").when(F.col("basel_cdf") < 0.9999, "yellow").otherwise("red")
    return c.withColumns({
        "expected_exceptions": F.col("n") * p,
        "kupiec_reject": k_rej,
        "coverage_reject": c_rej,
        "model_passes": ~k_rej & ~c_rej,
        "basel_zone": zone,
    }).drop("_p01", "_p11", "_p")


def common_sample(scored: DataFrame, n_methods: int, by: str = "portfolio_id") -> DataFrame:
    """Only dates where all ``n_methods`` methods have a finite prediction."""
    ok = scored.where("var is not null and not isnan(var) and realized is not null")
    have = F.count("*").over(W.partitionBy(by, "date"))
    return ok.withColumn("_have", have).where(F.col("_have") == n_methods).drop("_have")


def compare_methods(scored: DataFrame, order: Sequence[str], confidence: float = 0.95, by: str = "portfolio_id") -> DataFrame:
    """Coverage of the listed methods on their common sample, with the recommended one flagged."""
    tests = coverage_tests(common_sample(scored, len(order), by), confidence, keys=(by, "method"))
    tests = tests.where(F.col("n") >= MIN_TEST_ROWS)
    rank = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("method"))
    gap = F.abs(F.col("breach_rate") - (1.0 - confidence))
    key = F.when(F.col("model_passes"), F.struct(F.round(gap, 12), rank))
    best = F.min_by("method", key).over(W.partitionBy(by))
    return tests.withColumn("recommended", F.coalesce(F.col("model_passes") & (best == F.col("method")), F.lit(False)))


def closed_form_var(replay: DataFrame, confidence: float = 0.95, est_window: int = 252, horizon: int = 1, by: str = "portfolio_id") -> DataFrame:
    """Historical and parametric predictions from one pass over the trailing frame."""
    frame = series(by).rowsBetween(-est_window, -1)
    enough = F.count("ret").over(frame) >= MIN_TRAILING
    wide = replay.select(
        by, "date", "scored", "realized",
        F.when(enough, _historical(confidence, horizon, frame)).alias("historical"), F.when(enough, _parametric(confidence, horizon, frame)).alias("parametric"),
    )
    return wide.where("scored").unpivot([by, "date", "realized"], ["historical", "parametric"], "method", "var")


def asof_value_weights(positions: DataFrame, prices: DataFrame, dates: DataFrame, by: str = "portfolio_id") -> DataFrame:
    """Shares times the last price strictly before each of the portfolio's dates; 0 before purchase.

    The as-of lookup runs once per distinct (symbol, date), however many portfolios hold it.
    """
    held = positions.join(dates.select(by, "date").distinct(), by)
    priced = as_of(held.select("symbol", "date").distinct(), prices, "symbol", "price", strict=True)
    bought = F.col("purchase_date").isNull() | (F.col("purchase_date") <= F.col("date"))
    value = F.when(bought, F.coalesce(F.col("quantity") * F.col("price"), F.lit(0.0))).otherwise(0.0)
    return held.join(priced, ["symbol", "date"]).select(by, "symbol", "date", value.alias("value"))


def path_var(paths: DataFrame, base: float = 1.0, confidence: float = 0.95, keys: Sequence[str] = ("portfolio_id", "step")) -> DataFrame:
    """Percentile of the simulated level at each step, as a return on the base."""
    q = F.percentile("level", F.lit(1.0 - confidence))
    return paths.groupBy(*keys).agg((q / base - 1).alias("var"))
