"""Allocation methods and their walk-forward profile, for every portfolio and rebalance at once.

All trailing windows of all rebalances form one panel: a price row joins the ``window/rebalance``
windows that contain it. Weights are then plain aggregates per (portfolio, rebalance, symbol).
Between rebalances the drifting weights have a closed form, so no day-by-day loop is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from risklake.operators.align import align_intersection, series
from risklake.session import materialise

TRADING_DAYS = 252.0
METHODS = ["equal", "inverse_vol", "risk_parity", "drawdown_mgd"]
AS_OF = -1  # rebalance number of the current suggestion


def numbered_prices(positions: DataFrame, prices: DataFrame, window: int = 252, by: str = "portfolio_id") -> DataFrame:
    """Aligned prices with row number ``i``; needs two holdings and ``window + 5`` common dates."""
    held = align_intersection(positions, prices, by)
    w = series([by, "symbol"])
    rows = held.select(
        by, "symbol", "date", "price", "n_holdings", (F.row_number().over(w) - 1).alias("i"),
        F.count("*").over(W.partitionBy(by, "symbol")).alias("n"),
    )
    return rows.where((F.col("n_holdings") >= 2) & (F.col("n") >= window + 5))


def trailing_panel(rows: DataFrame, window: int = 252, rebalance: int = 21, by: str = "portfolio_id") -> DataFrame:
    """Each price row once per trailing window holding it: rebalances 0.. and the as-of window."""
    i, n = F.col("i"), F.col("n")
    last_k = F.floor((n - 2 - window) / rebalance)
    first_in = F.greatest(F.lit(0), F.ceil((i - window) / rebalance))
    last_in = F.least(last_k, F.floor(i / rebalance))
    ks = F.when(first_in <= last_in, F.sequence(first_in, last_in)).otherwise(F.array().cast("array<bigint>"))
    ks = F.when(i >= n - 1 - window, F.concat(ks, F.array(F.lit(AS_OF).cast("bigint")))).otherwise(ks)
    panel = rows.withColumn("k", F.explode(ks))
    start = F.when(F.col("k") == AS_OF, n - 1 - window).otherwise(F.col("k") * rebalance)
    panel = panel.select(by, "k", "symbol", "price", (i - start).alias("pos"))
    prev = F.lag("price").over(W.partitionBy(by, "k", "symbol").orderBy("pos"))
    return panel.withColumn("ret", F.col("price") / prev - 1)


def panel_statistics(panel: DataFrame, window: int = 252, alpha: float = 0.95, by: str = "portfolio_id") -> DataFrame:
    """Volatility, vol-of-vol, regime multiplier, CDaR and recovery of every window."""
    keys = [by, "k", "symbol"]
    part = W.partitionBy(*keys)
    run = part.orderBy("pos")
    short = run.rowsBetween(-20, 0)
    peak = F.max("price").over(run.rowsBetween(W.unboundedPreceding, 0))
    x = panel.withColumn("_dd", 1 - F.col("price") / peak)
    x = x.withColumn("_s21", F.when(F.count("ret").over(short) == 21, F.stddev_pop("ret").over(short)))
    x = x.withColumn("_q", F.percentile("_dd", F.lit(alpha)).over(part))
    x = x.withColumn("_cur", F.max(F.when(F.col("pos") == window, F.col("_s21"))).over(part))
    hist = F.when(F.col("pos") > window - 252, F.col("_s21"))
    agg = x.groupBy(*keys).agg(
        F.count("ret").alias("n_ret"),
        F.stddev_pop("ret").alias("vol"),
        F.stddev_pop(F.when(F.col("pos") > window - 63, F.col("_s21"))).alias("_vv"),
        F.stddev_pop(hist).alias("_hist_sd"),
        F.count(hist).alias("_hist_n"),
        F.avg((hist < F.col("_cur")).cast("double")).alias("_below"),
        F.greatest(F.avg(F.when(F.col("_dd") >= F.col("_q"), F.col("_dd"))), F.lit(1e-4)).alias("cdar"),
        F.avg((F.col("_dd") < 0.02).cast("double")).alias("recovery"),
    )
    steady = (F.col("n_ret") < 42) | (F.col("_hist_n") < 5) | (F.col("_hist_sd") == 0)
    tilt = F.greatest(F.lit(0.6), F.least(F.lit(1.15), 1.15 - 0.5 * F.col("_below")))
    return agg.select(
        *keys, "vol", F.when(F.col("n_ret") >= 26, F.coalesce("_vv", F.lit(0.0))).otherwise(0.0).alias("vol_of_vol"),
        F.when(steady, 1.0).otherwise(tilt).alias("regime_mult"), "cdar", "recovery",
    )


def normalised(raw: Column, part) -> Column:
    """Long-only share of the group total; equal when nothing is positive."""
    clipped = F.greatest(raw, F.lit(0.0))
    total = F.sum(clipped).over(part)
    return F.when(total > 0, F.try_divide(clipped, total)).otherwise(1.0 / F.count("*").over(part))


def statistic_weights(stats: DataFrame, by: str = "portfolio_id") -> DataFrame:
    """Equal, inverse-volatility and drawdown-managed weights, long by method."""
    part = W.partitionBy(by, "k")
    mid = F.percentile("vol_of_vol", F.lit(0.5)).over(part)
    vv = F.when(mid > 0, F.col("vol_of_vol") / (mid + 1e-12)).otherwise(0.0)
    raw = (1.0 / F.col("cdar")) * F.col("regime_mult") / (1.0 + 0.5 * vv) * (1.0 + 0.2 * (F.col("recovery") - 0.5))
    inverse = F.when(F.col("vol") > 0, F.try_divide(F.lit(1.0), F.col("vol"))).otherwise(0.0)
    wide = stats.withColumn("_raw", raw).select(
        by, "k", "symbol",
        (1.0 / F.count("*").over(part)).alias("equal"),
        normalised(inverse, part).alias("inverse_vol"),
        normalised(F.col("_raw"), part).alias("drawdown_mgd"),
    )
    return wide.unpivot([by, "k", "symbol"], ["equal", "inverse_vol", "drawdown_mgd"], "method", "weight")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _let(value: Column, use) -> Column:
    """Bind ``value`` once inside a larger expression."""
    return F.transform(F.array(value), use)[0]


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def risk_parity_weights(panel: DataFrame, iterations: int = 80, by: str = "portfolio_id") -> DataFrame:
    """Damped equal-contribution iteration as a fold over each window's covariance rows.

    One row per (portfolio, rebalance) carries holdings × window returns, a size set by the
    parameters and not by the data volume.
    """
    keys = [by, "k"]
    r = F.col("ret") - F.avg("ret").over(W.partitionBy(*keys, "symbol"))
    rows = panel.withColumn("_x", r).where("_x is not null").groupBy(*keys, "symbol").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "_x"))), lambda s: s["_x"]).alias("x")
    )
    book = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("symbol", "x"))).alias("b"))
    book = book.select(*keys, F.col("b.symbol").alias("symbols"), F.col("b.x").alias("m"))
    cov = F.transform("m", lambda a: F.transform("m", lambda b: _dot(a, b) / (F.size(a) - 1)))
    book = book.withColumn("cov", cov).drop("m")

    def scaled(a: Column) -> Column:
        return _let(_total(a), lambda t: F.transform(a, lambda v: v / t))

    start = F.transform("cov", lambda row, i: 1.0 / (F.sqrt(F.get(row, i)) + 1e-12))
    book = book.withColumn("_inv", start).withColumn("w0", scaled(F.col("_inv")))

    def damped(pairs: Column) -> Column:
        target = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["w"] * p["g"]) / F.size(pairs)

        def moved(p: Column, t: Column) -> Column:
            goal = F.when(p["g"] > 0, t / (p["g"] + 1e-12)).otherwise(p["w"])
            return 0.5 * p["w"] + 0.5 * F.greatest(goal, F.lit(1e-6))

        return _let(target, lambda t: _let(F.transform(pairs, lambda p: moved(p, t)), scaled))

    def advance(w: Column, _: Column) -> Column:
        marginal = F.transform("cov", lambda row: _dot(row, w))
        return _let(F.zip_with(w, marginal, lambda x, g: F.struct(x.alias("w"), g.alias("g"))), damped)

    final = book.withColumn("w", F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), F.col("w0"), advance))
    out = final.select(*keys, F.explode(F.arrays_zip("symbols", "w")).alias("z"))
    return out.select(*keys, F.col("z.symbols").alias("symbol"), F.lit("risk_parity").alias("method"), F.col("z.w").alias("weight"))


def method_weights(panel: DataFrame, window: int = 252, by: str = "portfolio_id") -> DataFrame:
    """Weights of all four methods at every rebalance and as of the last date."""
    simple = statistic_weights(panel_statistics(panel, window, by=by), by)
    return simple.unionByName(risk_parity_weights(panel, by=by))


def rounded_weights(weights: DataFrame, keys: Sequence[str], digits: int = 4) -> DataFrame:
    """Half-even rounding with the residual pushed onto the largest weight, so shares sum to 1."""
    part = W.partitionBy(*keys)
    r = F.bround("weight", digits)
    rows = weights.withColumn("_r", r).withColumn("_rn", F.row_number().over(part.orderBy(F.desc("weight"), "symbol")))
    residual = 1.0 - F.sum("_r").over(part)
    return rows.withColumn("rounded", F.bround(F.when(F.col("_rn") == 1, F.col("_r") + residual).otherwise(F.col("_r")), digits)).drop("_r", "_rn")


def capped_weights(raw: DataFrame, cap: float, keys: Sequence[str], passes: int = 8) -> DataFrame:
    """Long-only weights under a cap: the excess is redistributed pro rata, at most ``passes`` times.

    One row per key holds that key's weights as an array, bounded by its holdings.
    """
    keys = list(keys)
    start = raw.withColumn("_w", normalised(F.col("weight"), W.partitionBy(*keys)))
    book = start.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("symbol", F.col("_w").alias("w")))).alias("b"))
    book = book.select(*keys, F.col("b.symbol").alias("symbols"), F.col("b.w").alias("w"), F.greatest(F.lit(cap), 1.0 / F.size("b")).alias("cap"))
    c = F.col("cap")

    def one_pass(w: Column, _: Column) -> Column:
        excess = F.aggregate(w, F.lit(0.0), lambda s, v: s + F.greatest(v - c, F.lit(0.0)))
        room = F.aggregate(w, F.lit(0.0), lambda s, v: s + F.when(v > c, 0.0).otherwise(v))
        moved = F.transform(w, lambda v: F.when(v > c, c).when(room > 0, v + excess * v / F.when(room > 0, room)).otherwise(v))
        return F.when(excess > 0, moved).otherwise(w)

    done = book.withColumn("w", F.aggregate(F.sequence(F.lit(1), F.lit(passes)), F.col("w"), one_pass))
    done = done.withColumn("_t", _total(F.col("w")))
    out = done.select(*keys, "_t", F.explode(F.arrays_zip("symbols", "w")).alias("z"))
    return out.select(*keys, F.col("z.symbols").alias("symbol"), (F.col("z.w") / F.col("_t")).alias("weight"))


def walk_forward(
    rows: DataFrame, weights: DataFrame, window: int = 252, rebalance: int = 21, cost_bps: float = 10.0, by: str = "portfolio_id"
) -> DataFrame:
    """Daily net return per method, with the turnover traded on rebalance days.

    The weights hold through the rebalance day and drift afterwards, so on day ``m`` of a period
    they are proportional to target × growth over days 1..m−1.
    """
    w = series([by, "symbol"], "i")
    days = rows.withColumn("ret", F.lead("price").over(w) / F.col("price") - 1).where((F.col("i") >= window) & F.col("ret").isNotNull())
    days = days.withColumn("k", F.floor((F.col("i") - window) / rebalance)).withColumn("m", (F.col("i") - window) % rebalance)
    enough = F.floor((F.col("n") - 2 - window) / rebalance) + 1 >= 4
    days = days.where(enough)
    period = W.partitionBy(by, "symbol", "k").orderBy("m")
    step = F.when(F.col("m") >= 1, 1 + F.col("ret")).otherwise(1.0)
    grown = F.coalesce(F.product(step).over(period.rowsBetween(W.unboundedPreceding, -1)), F.lit(1.0))
    days = days.withColumn("g", grown).withColumn("g_end", F.col("g") * step)
    days = days.withColumn("last_m", F.max("m").over(W.partitionBy(by, "k")))
    held = days.select(by, "symbol", "date", "i", "n", "k", "m", "last_m", "ret", "g", "g_end").join(weights, [by, "k", "symbol"])
    mass = F.col("weight") * F.col("g")
    daily = held.groupBy(by, "method", "k", "m", "i", "n", "date").agg((F.sum(mass * F.col("ret")) / F.sum(mass)).alias("gross"))
    end_mass = F.col("weight") * F.col("g_end")
    ends = held.where("m = last_m").select(
        by, "method", "symbol", (F.col("k") + 1).alias("k"), (end_mass / F.sum(end_mass).over(W.partitionBy(by, "method", "k"))).alias("before")
    )
    targets = weights.where(F.col("k") >= 0)
    moved = targets.join(ends, [by, "method", "symbol", "k"], "left")
    traded = moved.groupBy(by, "method", "k").agg((0.5 * F.sum(F.abs(F.col("weight") - F.coalesce("before", F.lit(0.0))))).alias("traded"))
    cost = F.when(F.col("m") == 0, F.col("traded")).otherwise(0.0)
    return daily.join(traded, [by, "method", "k"]).select(
        by, "method", "date", "i", "n", cost.alias("traded"), (F.col("gross") - cost * (cost_bps / 10_000.0)).alias("ret")
    )


def strategy_profile(daily: DataFrame, window: int = 252, by: str = "portfolio_id") -> DataFrame:
    """CAGR, volatility, Sharpe, drawdown, CDaR95 and turnover of each method's equity curve."""
    keys = [by, "method"]
    part = W.partitionBy(*keys)
    up_to = part.orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    x = daily.withColumn("_eq", F.product(1 + F.col("ret")).over(up_to))
    x = x.withColumn("_dd", 1 - F.col("_eq") / F.greatest(F.lit(1.0), F.max("_eq").over(up_to)))
    # the curve starts at 1 with no drawdown: that point belongs to the drawdown sample
    x = x.withColumn("_rn", F.row_number().over(part.orderBy("i")))
    points = F.when(F.col("_rn") == 1, F.array(F.lit(0.0), F.col("_dd"))).otherwise(F.array("_dd"))
    x = x.select("*", F.posexplode(points).alias("_p", "_point"))
    x = x.withColumn("_is_start", (F.col("_rn") == 1) & (F.col("_p") == 0))
    x = x.withColumn("_q", F.percentile("_point", F.lit(0.95)).over(part))
    real = lambda c: F.when(~F.col("_is_start"), c)
    agg = x.groupBy(*keys).agg(
        F.max_by("_eq", "i").alias("total"), F.stddev_pop(real(F.col("ret"))).alias("sd"), F.avg(real(F.col("ret"))).alias("mean"),
        F.max("_point").alias("mdd"), F.avg(F.when(F.col("_point") >= F.col("_q"), F.col("_point"))).alias("cdar"),
        F.sum(real(F.col("traded"))).alias("turnover"), F.max("n").alias("n"),
    )
    years = (F.col("n") - 1 - window) / TRADING_DAYS
    vol = F.col("sd") * (TRADING_DAYS ** 0.5)
    return agg.select(
        *keys,
        F.when(F.col("total") > 0, F.pow("total", 1.0 / years) - 1).otherwise(0.0).alias("cagr"),
        vol.alias("ann_vol"),
        F.when(vol > 0, F.col("mean") * TRADING_DAYS / vol).otherwise(0.0).alias("sharpe"),
        (-F.col("mdd")).alias("max_drawdown"), (-F.col("cdar")).alias("cdar95"), (F.col("turnover") / years).alias("turnover_per_yr"),
    )


def allocation_report(
    positions: DataFrame, prices: DataFrame, window: int = 252, rebalance: int = 21, cost_bps: float = 10.0, by: str = "portfolio_id"
) -> DataFrame:
    """Point-in-time weights of every method next to its walk-forward profile."""
    # the aligned prices and the weights each feed several branches: written once
    rows = materialise(numbered_prices(positions, prices, window, by), "aligned")
    panel = trailing_panel(rows, window, rebalance, by)
    weights = materialise(method_weights(panel, window, by), "weights")
    profile = strategy_profile(walk_forward(rows, weights, window, rebalance, cost_bps, by), window, by)
    now = rounded_weights(weights.where(F.col("k") == AS_OF), [by, "method"])
    return now.select(by, "method", "symbol", "weight", "rounded").join(profile, [by, "method"], "left")


def rebalance_suggestions(positions: DataFrame, by: str = "portfolio_id", targets: DataFrame | None = None) -> DataFrame:
    """Delta to the target (equal weight by default), action, and half the absolute turnover."""
    part = W.partitionBy(by)
    w = positions.withColumn("current_weight", F.col("weight") / F.sum("weight").over(part))
    if targets is None:
        w = w.withColumn("target_weight", 1.0 / F.count("*").over(part))
    else:
        w = w.join(targets.select(by, "symbol", "target_weight"), [by, "symbol"], "left").withColumn(
            "target_weight", F.coalesce("target_weight", F.lit(0.0))
        )
    delta = F.col("target_weight") - F.col("current_weight")
    w = w.withColumn("delta", delta)
    return w.select(
        by, "symbol", "current_weight", "target_weight", "delta",
        F.when(F.col("delta") > 0, "buy").when(F.col("delta") < 0, "sell").otherwise("hold").alias("action"),
        (0.5 * F.sum(F.abs("delta")).over(part)).alias("turnover"),
    )


TOO_FEW = "fewer assets than the selection"


def best_subset(moments: DataFrame, cov: DataFrame, size: int, risk_factor: float = 0.5, by: str = "portfolio_id") -> DataFrame:
    """Exact best ``size``-asset selection, minimising -mu'x + q x'Sigma x, by branch and bound over all books at once.

    ``moments`` is (by, symbol, mu); ``cov`` the upper triangle (symbol_i <= symbol_j). Selections grow asset by asset, in the order
    of what an asset costs alone. A partial selection is kept only while its lower bound does not exceed the greedy selection:
    what it costs, plus the cheapest assets still open, each at its cost beside the chosen ones and with its smallest covariances
    to the others. One join per level brings the covariances of the asset just chosen; the last asset is picked inside the row.
    Ties go to the first selection by name. A book of fewer than ``size`` assets has a row with a status and no selection.
    """
    q = float(risk_factor)
    wide = cov.select(by, F.explode(F.array(
        F.struct(F.col("symbol_i").alias("symbol"), F.col("symbol_j").alias("other"), "cov"),
        F.struct(F.col("symbol_j").alias("symbol"), F.col("symbol_i").alias("other"), "cov"),
    )).alias("e")).select(by, "e.*").distinct()
    alone = moments.join(wide.where("symbol = other").drop("other"), [by, "symbol"]).select(by, "symbol", (q * F.col("cov") - F.col("mu")).alias("cost"))
    place = F.row_number().over(W.partitionBy(by).orderBy("cost", "symbol")) - 1
    placed = materialise(alone.withColumn("i", place), "subset-assets")
    seconds = placed.select(by, F.col("symbol").alias("other"), F.col("i").alias("j"))
    lines = wide.join(placed, [by, "symbol"]).join(seconds, [by, "other"]).groupBy(by, "i", "symbol", "cost").agg(F.array_sort(F.collect_list(F.struct("j", "cov"))).alias("line"))
    others = F.sort_array(F.transform(F.filter("line", lambda x: x["j"] != F.col("i")), lambda x: x["cov"]))
    # least[r]: the smallest sum of covariances with r others
    least = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda r: F.aggregate(F.slice("others", F.lit(1), r), F.lit(0.0), lambda s, x: s + x))
    lines = lines.withColumn("others", others).select(by, "i", "symbol", "cost", F.transform("line", lambda x: x["cov"]).alias("line"), least.alias("least"))
    lines = materialise(lines, "subset-lines")

    books = lines.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("i", "symbol", "cost", "line", "least"))).alias("b"))
    books = books.select(by, F.size("b").alias("n"), F.col("b.symbol").alias("symbols"), F.col("b.cost").alias("cost"), F.col("b.line").alias("lines"), F.col("b.least").alias("least"))
    short = moments.select(by).distinct().join(books.where(F.col("n") >= size).select(by), by, "left_anti")
    books = materialise(books.where(F.col("n") >= size).withColumn("greedy", _greedy_cost(size, q)), "subset-books")
    slack = F.lit(1e-9) * (1 + F.abs("greedy"))  # sums of other order must not lose a tie
    nodes = books.select(by, "n", F.array().cast("array<int>").alias("pick"), F.lit(0.0).alias("spent"), "cost")
    for left in range(size - 1, 0, -1):  # assets still to choose after this one
        first = F.coalesce(F.try_element_at("pick", F.lit(-1)) + 1, F.lit(0))
        nodes = nodes.withColumn("i", F.explode(F.sequence(first, F.col("n") - 1 - left)))
        # the cost of the chosen asset is spent; the others now carry their covariance with it as well
        chosen = nodes.join(lines.select(by, "i", "line"), [by, "i"]).select(
            by, "n", F.array_append("pick", F.col("i")).alias("pick"), (F.col("spent") + F.get("cost", F.col("i"))).alias("spent"),
            F.zip_with("cost", "line", lambda c, s: c + 2 * q * s).alias("cost"), "i",
        )
        limit = books.select(by, (F.col("greedy") + slack).alias("limit"), F.transform("least", lambda x: q * F.get(x, F.lit(left - 1))).alias("extra"))  # noqa: B023
        open_costs = F.slice(F.zip_with("cost", "extra", lambda c, x: c + x), F.col("i") + 2, F.col("n"))
        bound = F.col("spent") + F.aggregate(F.slice(F.sort_array(open_costs), 1, left), F.lit(0.0), lambda s, x: s + x)
        nodes = chosen.join(limit, by).where(bound <= F.col("limit")).select(by, "n", "pick", "spent", "cost")
    after = F.coalesce(F.try_element_at("pick", F.lit(-1)), F.lit(-1))
    last = F.array_min(F.filter(F.transform("cost", lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda x: x["i"] > after))
    done = nodes.select(by, "pick", "spent", last.alias("last")).join(books.select(by, "symbols"), by)
    names = F.array_sort(F.transform(F.array_append("pick", F.col("last.i")), lambda i: F.get("symbols", i)))
    done = done.select(by, (F.col("spent") + F.col("last.c")).alias("objective"), F.concat_ws(",", names).alias("selection"))
    best = done.groupBy(by).agg(F.min(F.struct("objective", "selection")).alias("m")).select(by, "m.*", F.lit("ok").alias("status"))
    return best.unionByName(short.withColumn("status", F.lit(TOO_FEW)), allowMissingColumns=True)


def _greedy_cost(size: int, q: float) -> Column:
    """Cost of the selection that takes the cheapest next asset each time; an upper bound of the best one."""
    def step(acc: Column, _: Column) -> Column:
        free = F.filter(F.transform(acc["cost"], lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda x: ~F.array_contains(acc["pick"], x["i"]))
        best = F.array_min(free)
        return F.struct(
            F.array_append(acc["pick"], best["i"]).alias("pick"), (acc["spent"] + best["c"]).alias("spent"),
            F.zip_with(acc["cost"], F.get("lines", best["i"]), lambda c, s: c + 2 * q * s).alias("cost"),
        )

    start = F.struct(F.array().cast("array<int>").alias("pick"), F.lit(0.0).alias("spent"), F.col("cost"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(size)), start, step, lambda acc: acc["spent"])


def import_weights(holdings: DataFrame, by: str = "portfolio_id") -> DataFrame:
    """Weights of an imported book: by market value, else by supplied weight, else equal.

    ``holdings`` carries quantity, last price, market_value and supplied weight, any of them NULL.
    """
    part = W.partitionBy(by)
    mv = F.coalesce(F.when(F.col("quantity") != 0, F.col("quantity") * F.col("price")), F.col("market_value"))
    h = holdings.withColumn("_mv", mv)
    total = F.sum("_mv").over(part)
    given = F.sum("supplied_weight").over(part)
    scale = F.when(given > 2.0, 0.01).otherwise(1.0)
    any_given = F.count("supplied_weight").over(part) > 0
    basis = F.when(total > 0, "market_value").when(any_given, "supplied_weight").otherwise("equal_weight")
    denominator = F.when(given * scale != 0, given * scale).otherwise(1.0)
    weight = (
        F.when(basis == "market_value", F.coalesce(F.try_divide(F.col("_mv"), total), F.lit(0.0)))
        .when(basis == "supplied_weight", F.coalesce(F.col("supplied_weight") * scale / denominator, F.lit(0.0)))
        .otherwise(1.0 / F.count("*").over(part))
    )
    return h.select(by, "symbol", weight.alias("weight"), basis.alias("basis"))
