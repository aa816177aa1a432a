"""Scenario paths, simulated fans, stress tables and worst-case search.

Draws are keyed hashes, so a re-run task redraws the same numbers. A draw picks a historical row
and equi-joins it; symbols are summed before paths are fanned out, and only quantiles leave a step.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from risklake.functions.stats import gaussian, normal_cdf, normal_density, normal_quantile, uniform
from risklake.operators.align import series

# Built-in scenarios (shock, return scale, drift shift) and fan quantiles.
BUILTIN_SCENARIOS = {
    "bull_10": (0.10, 1.0, 0.0),
    "bear_10": (-0.10, 1.0, 0.0),
    "high_vol_regime": (0.0, 1.25, 0.0),
    "low_vol_regime": (0.0, 0.75, 0.0),
}
FAN_QUANTILES = {
    "lower_2s": 0.025, "p5": 0.05, "lower_1s": 0.16, "central": 0.50, "upper_1s": 0.84, "p95": 0.95, "upper_2s": 0.975,
}
DRIFT_ROWS = 63
RATE_UP_LOSS, RATE_DOWN_GAIN, SECTOR_DROP = -0.05, 0.04, -0.12


def builtin_scenarios(spark: SparkSession) -> DataFrame:
    rows = [(n, *v) for n, v in BUILTIN_SCENARIOS.items()]
    return spark.createDataFrame(rows, "name string, initial_shock_pct double, return_scale double, drift_shift double")


def merge_scenarios(custom: DataFrame, include_builtins: bool = True, excluded: Sequence[str] = ()) -> DataFrame:
    """Built-ins plus customs; a custom wins by name, its last version counts, blanks drop.

    ``custom`` carries ``name``, the three knobs and an ordering column ``position``.
    """
    named = custom.withColumn("name", F.trim("name")).where("name is not null and name <> ''")
    knobs = F.struct(
        F.coalesce("initial_shock_pct", F.lit(0.0)).alias("initial_shock_pct"),
        F.coalesce("return_scale", F.lit(1.0)).alias("return_scale"),
        F.coalesce("drift_shift", F.lit(0.0)).alias("drift_shift"),
    )
    mine = named.groupBy("name").agg(F.max_by(knobs, "position").alias("k")).select("name", "k.*")
    if include_builtins:
        base = builtin_scenarios(custom.sparkSession)
        mine = base.join(mine, "name", "left_anti").unionByName(mine)
    return mine.where(~F.col("name").isin(*excluded)) if excluded else mine


def scenario_struct(defs: dict[str, tuple[float, float, float]]) -> Column:
    """A fixed scenario list as an array column, so fanning out needs no join."""
    return F.array(
        *[
            F.struct(F.lit(n).alias("name"), F.lit(s).alias("shock"), F.lit(c).alias("scale"), F.lit(d).alias("drift"))
            for n, (s, c, d) in defs.items()
        ]
    )


def deterministic_paths(forecast: DataFrame, base: DataFrame, defs: dict[str, tuple[float, float, float]], by: str = "symbol") -> DataFrame:
    """``base·(1+shock)·Π(1 + scale·r + drift)`` per scenario along the forecast returns."""
    rows = forecast.withColumn("sc", F.explode(scenario_struct(defs)))
    w = W.partitionBy(by, "sc.name").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    growth = F.product(1 + F.col("ret") * F.col("sc.scale") + F.col("sc.drift")).over(w)
    out = rows.select(by, "step", F.col("sc.name").alias("scenario"), (growth * (1 + F.col("sc.shock"))).alias("_g"))
    return out.join(base, by).select(by, "scenario", "step", (F.col("base") * F.col("_g")).alias("level"))


def forecast_steps(history: DataFrame, forecast: DataFrame, by: str = "symbol") -> tuple[DataFrame, DataFrame]:
    """(forecast rows with step and return from the last close, last closes)."""
    base = history.groupBy(by).agg(F.max_by("price", "date").alias("base"))
    w = series(by)
    steps = forecast.join(base, by).withColumn("step", F.row_number().over(w))
    prev = F.coalesce(F.lag("price").over(w), F.col("base"))
    return steps.withColumn("ret", F.col("price") / prev - 1).drop("base"), base


# ---- bootstrap fan around a forecast ----------------------------------------------------
def bootstrap_paths(
    history: DataFrame, forecast: DataFrame, n_paths: int = 250, seed: int = 42, by: str = "symbol", sigma: DataFrame | None = None
) -> DataFrame:
    """Paths around the forecast line from resampled historical log-return residuals.

    ``sigma`` (by, sigma_daily) scales the residuals towards a target volatility, within 0.5–2.5×.
    """
    steps, base = forecast_steps(history, forecast, by)
    logs = history.withColumn("r", F.log(F.col("price") / F.lag("price").over(series(by)))).where("r is not null")
    part = W.partitionBy(by)
    rn = F.row_number().over(part.orderBy("date")) - 1
    pool = logs.select(
        by, rn.alias("idx"), (F.col("r") - F.avg("r").over(part)).alias("residual"), F.count("*").over(part).alias("n"), "r"
    )
    recent = F.when(F.col("idx") >= F.col("n") - 252, F.col("r"))
    stats = pool.groupBy(by).agg(F.max("n").alias("n"), F.greatest(F.stddev_pop(recent), F.lit(1e-6)).alias("ref"))
    stats = stats.where("n >= 5")
    if sigma is None:
        stats = stats.withColumn("scale", F.lit(1.0))
    else:
        ratio = F.greatest(F.lit(0.5), F.least(F.lit(2.5), F.col("sigma_daily") / F.col("ref")))
        stats = stats.join(sigma, by, "left").withColumn("scale", F.coalesce(ratio, F.lit(1.0))).drop("sigma_daily")
    draws = (
        steps.select(by, "step", F.log(1 + F.col("ret")).alias("drift")).join(stats, by)
        .withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(n_paths - 1))))
        .withColumn("idx", F.floor(uniform(seed, by, "path", "step") * F.col("n")).cast("int"))
    )
    shocked = draws.join(pool.select(by, "idx", "residual"), [by, "idx"])
    move = F.col("drift") + F.col("residual") * F.col("scale") * 0.70
    w = W.partitionBy(by, "path").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    sims = shocked.withColumn("_cum", F.sum(move).over(w)).join(base, by)
    return sims.select(by, "path", "step", (F.col("base") * F.exp("_cum")).alias("level"))


def fan(paths: DataFrame, keys: Sequence[str], quantiles: dict[str, float] = FAN_QUANTILES) -> DataFrame:
    """Quantiles of the level per step; the group size is the number of paths, a parameter."""
    q = F.percentile("level", F.array(*[F.lit(p) for p in quantiles.values()]))
    out = paths.groupBy(*keys).agg(q.alias("_q"))
    return out.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(quantiles)])


def representative_path(paths: DataFrame, by: str = "symbol") -> DataFrame:
    """The path whose realised volatility lies closest to the median volatility."""
    w = W.partitionBy(by, "path").orderBy("step")
    moves = paths.withColumn("_r", F.log(F.col("level") / F.lag("level").over(w)))
    vols = moves.groupBy(by, "path").agg(F.stddev_pop("_r").alias("vol"))
    mid = F.percentile("vol", F.lit(0.5)).over(W.partitionBy(by))
    gap = vols.withColumn("_gap", F.round(F.abs(F.col("vol") - mid), 12))
    best = gap.groupBy(by).agg(F.min_by("path", F.struct("_gap", "path")).alias("path"))
    return paths.join(best, [by, "path"])


# ---- joint dependence --------------------------------------------------------------------
def standardised_rows(log_returns: DataFrame, levels: int = 4, by: str = "portfolio_id") -> DataFrame:
    """Each aligned row as its quantile cell: bin midpoints in standard-deviation units.

    Drawing a cell of the empirical joint histogram with its probability is the same as drawing a
    past row uniformly and taking its cell, so the dense joint table never exists and the number
    of assets is unlimited. ``rn`` numbers the rows of a portfolio from 0.
    """
    part = W.partitionBy(by, "symbol")
    x = log_returns.withColumns({
        "mu": F.avg("ret").over(part), "sd0": F.stddev_pop("ret").over(part), "sigma": F.stddev_samp("ret").over(part),
    }).withColumn("_z", (F.col("ret") - F.col("mu")) / (F.col("sd0") + 1e-12))
    inner = [F.percentile("_z", F.lit(m / levels)).over(part).alias(f"_e{m}") for m in range(1, levels)]
    x = x.select("*", *inner)
    e = [F.col(f"_e{m}") for m in range(1, levels)]
    outer_lo = e[0] - (e[1] - e[0]) if levels > 2 else e[0] - 1.0
    outer_hi = e[-1] + (e[-1] - e[-2]) if levels > 2 else e[-1] + 1.0
    edges = [outer_lo, *e, outer_hi]
    cell = F.lit(0)
    for edge in e:
        cell = cell + (F.col("_z") >= edge).cast("int")
    mids = F.array(*[(a + b) * 0.5 for a, b in zip(edges, edges[1:])])
    rn = F.row_number().over(W.partitionBy(by, "symbol").orderBy("date")) - 1
    return x.select(
        by, "symbol", "date", "weight", rn.alias("rn"), F.count("*").over(part).alias("n"), "mu", "sigma",
        cell.alias("cell"), mids[cell].alias("z"),
    )


def joint_draws(rows: DataFrame, n_paths: int, n_steps: int, seed: int = 42, by: str = "portfolio_id") -> DataFrame:
    """The source row of every (portfolio, path, step)."""
    sizes = rows.groupBy(by).agg(F.max("n").alias("n"))
    d = sizes.withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(n_paths - 1)))).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(n_steps)))
    )
    return d.select(by, "path", "step", F.floor(uniform(seed, by, "path", "step") * F.col("n")).cast("int").alias("rn"))


def portfolio_shock_paths(rows: DataFrame, n_paths: int, n_steps: int, seed: int = 42, by: str = "portfolio_id") -> DataFrame:
    """Cumulative weighted shock ``Σ w σ z`` along each path, with the portfolio drift ``Σ w μ``.

    Holdings collapse to one number per historical row before the paths fan out.
    """
    total = F.sum("weight").over(W.partitionBy(by, "rn"))
    share = F.col("weight") / total
    per_row = rows.withColumn("_s", share).groupBy(by, "rn").agg(
        F.sum(F.col("_s") * F.col("sigma") * F.col("z")).alias("shock"), F.sum(F.col("_s") * F.col("mu")).alias("drift")
    )
    d = joint_draws(rows, n_paths, n_steps, seed, by).join(per_row, [by, "rn"])
    w = W.partitionBy(by, "path").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    return d.select(by, "path", "step", F.sum("shock").over(w).alias("cum_shock"), "drift")


def scenario_levels(paths: DataFrame, defs: dict[str, tuple[float, float, float]], base: float = 100.0, by: str = "portfolio_id") -> DataFrame:
    """Levels under each scenario's knobs: ``base·(1+shock)·exp(step·(μ+drift) + scale·Σ shocks)``."""
    every = {"base": (0.0, 1.0, 0.0), **defs}
    x = paths.withColumn("sc", F.explode(scenario_struct(every)))
    log_level = F.col("step") * (F.col("drift") + F.col("sc.drift")) + F.col("sc.scale") * F.col("cum_shock")
    return x.select(by, F.col("sc.name").alias("scenario"), "path", "step", (base * (1 + F.col("sc.shock")) * F.exp(log_level)).alias("level"))


def gaussian_levels(stats: DataFrame, defs: dict[str, tuple[float, float, float]], n_paths: int, n_steps: int, seed: int = 42, by: str = "symbol") -> DataFrame:
    """Single-asset fan: ``μ + drift − ½(σ·scale)² + σ·scale·z`` per step.

    ``stats`` carries (by, base, mu, sigma).
    """
    d = stats.withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(n_paths - 1)))).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(n_steps)))
    )
    w = W.partitionBy(by, "path").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("_z", gaussian(seed, by, "path", "step")).withColumn("_cz", F.sum("_z").over(w))
    x = d.withColumn("sc", F.explode(scenario_struct({"base": (0.0, 1.0, 0.0), **defs})))
    s = F.col("sigma") * F.col("sc.scale")
    log_level = F.col("step") * (F.col("mu") + F.col("sc.drift") - 0.5 * s * s) + s * F.col("_cz")
    return x.select(by, F.col("sc.name").alias("scenario"), "path", "step", (F.col("base") * (1 + F.col("sc.shock")) * F.exp(log_level)).alias("level"))


def return_moments(prices: DataFrame, by: str = "symbol") -> DataFrame:
    logs = prices.withColumn("r", F.log(F.col("price") / F.lag("price").over(series(by))))
    return logs.groupBy(by).agg(
        F.max_by("price", "date").alias("base"), F.avg("r").alias("mu"), F.stddev_samp("r").alias("sigma"), F.stddev_pop("r").alias("sigma_pop")
    )


def terminal_risk(paths: DataFrame, base: float = 1.0, by: str = "portfolio_id") -> DataFrame:
    """VaR 99/95, CVaR 99, best and worst of the terminal return."""
    last = F.max("step").over(W.partitionBy(by))
    t = paths.withColumn("_last", last).where("step = _last").withColumn("r", F.col("level") / base - 1)
    part = W.partitionBy(by)
    t = t.withColumn("v99", F.percentile("r", F.lit(0.01)).over(part)).withColumn("v95", F.percentile("r", F.lit(0.05)).over(part))
    return t.groupBy(by).agg(
        F.max("v99").alias("var_99"), F.max("v95").alias("var_95"), F.avg(F.when(F.col("r") <= F.col("v99"), F.col("r"))).alias("cvar_99"),
        F.max("r").alias("best_case"), F.min("r").alias("worst_case"),
    )


def lognormal_var(prices: DataFrame, horizon: int = 20, confidence: float = 0.95, by: str = "symbol") -> DataFrame:
    """Closed-form VaR and CVaR of the horizon return under lognormal prices."""
    mo = return_moments(prices, by)
    z = normal_quantile(1.0 - confidence)
    m, s = F.col("mu") * horizon, F.col("sigma_pop") * math.sqrt(horizon)
    var = F.exp(m + s * z) - 1
    tail = F.exp(m + 0.5 * s * s) * normal_cdf(F.lit(z) - s) / (1.0 - confidence) - 1
    return mo.select(by, var.alias("var"), tail.alias("cvar"), F.lit(normal_density(z)).alias("density"))


def risk_cone(prices: DataFrame, horizon: int = 30, n_paths: int = 1000, decay: float = 0.94, seed: int = 42, by: str = "symbol") -> DataFrame:
    """Price and volatility cone: EWMA variance updated along each simulated path.

    The variance recursion runs inside one row per path, over that path's draws only.
    """
    from risklake.operators.indicators import ewma_risk

    sig = ewma_risk(prices, by, decay).groupBy(by).agg(F.max_by("sigma", "date").alias("sigma0"))
    mo = return_moments(prices, by).select(by, "base", "mu").join(sig, by)
    d = mo.withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(n_paths - 1))))
    zs = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda k: gaussian(seed, by, "path", k))
    start = F.struct(F.lit(0.0).alias("cum"), (F.col("sigma0") * F.col("sigma0")).alias("var"), F.array().cast("array<struct<cum:double,sigma:double>>").alias("out"))

    def step(acc: Column, z: Column) -> Column:
        s = F.sqrt(acc["var"])
        shock = s * z
        cum = acc["cum"] + F.col("mu") + shock
        return F.struct(
            cum.alias("cum"), (decay * acc["var"] + (1 - decay) * shock * shock).alias("var"),
            F.concat(acc["out"], F.array(F.struct(cum.alias("cum"), s.alias("sigma")))).alias("out"),
        )

    lines = d.select(by, "base", F.posexplode(F.aggregate(zs, start, step, lambda a: a["out"])).alias("pos", "o"))
    lines = lines.select(by, (F.col("pos") + 1).alias("step"), (F.col("base") * F.exp("o.cum")).alias("level"), F.col("o.sigma").alias("sigma"))
    three = F.array(F.lit(0.05), F.lit(0.50), F.lit(0.95))
    out = lines.groupBy(by, "step").agg(F.percentile("level", three).alias("p"), F.percentile("sigma", three).alias("s"))
    return out.select(
        by, "step", *[F.col("p")[i].alias(f"price_{n}") for i, n in enumerate(("p5", "p50", "p95"))],
        *[F.col("s")[i].alias(f"sigma_{n}") for i, n in enumerate(("p5", "p50", "p95"))],
    )


def worst_case_shock(
    rows: DataFrame, paths: DataFrame, levels: Sequence[float] = (-3.0, 0.0, 3.0), alpha: float = 0.05, by: str = "portfolio_id"
) -> DataFrame:
    """Per-asset σ-shock grid point with the lowest CVaR of the terminal return.

    A shock multiplies every path by the same 1 + Σ w(e^{σs}−1), so the order of the paths never
    changes and the grid minimum separates: each asset takes its own lowest level. The whole grid
    is searched exactly at a cost linear in the assets instead of levels^assets.
    """
    total = F.sum("weight").over(W.partitionBy(by))
    assets = rows.groupBy(by, "symbol").agg(F.max("weight").alias("weight"), F.max("sigma").alias("sigma"))
    assets = assets.withColumn("w", F.col("weight") / total)
    tried = assets.withColumn("level", F.explode(F.array(*[F.lit(float(s)) for s in levels])))
    tried = tried.withColumn("shock_pct", F.exp(F.col("level") * F.col("sigma")) - 1)
    part = F.struct((F.col("w") * F.col("shock_pct")).alias("part"), "level", "shock_pct")
    best = tried.groupBy(by, "symbol").agg(F.min(part).alias("b")).select(by, "symbol", "b.*")
    last = F.max("step").over(W.partitionBy(by))
    ends = paths.withColumn("_last", last).where("step = _last").select(by, (F.exp(F.col("step") * F.col("drift") + F.col("cum_shock"))).alias("g"))
    rank = F.row_number().over(W.partitionBy(by).orderBy("g"))
    n = F.count("*").over(W.partitionBy(by))
    tail = ends.select(by, "g", rank.alias("rk"), n.alias("n")).where(F.col("rk") <= F.greatest(F.lit(1), F.floor(F.col("n") * alpha)))
    mean_tail = tail.groupBy(by).agg(F.avg("g").alias("tail_growth"))
    out = best.withColumn("agg_shock_pct", F.sum("part").over(W.partitionBy(by))).join(mean_tail, by)
    return out.select(
        by, "symbol", "level", "shock_pct", "agg_shock_pct", ((1 + F.col("agg_shock_pct")) * F.col("tail_growth") - 1).alias("cvar")
    )


# ---- tables ------------------------------------------------------------------------------
def stress_table(index: DataFrame, sectors: DataFrame, rate_weight: DataFrame, by: str = "portfolio_id") -> DataFrame:
    """σ-moves, fixed market drops, top-3 sector drops and ±100 bp on one level per portfolio.

    ``index`` carries price and ret; ``sectors`` (by, sector, exposure); ``rate_weight``
    (by, rate_sensitive_weight).
    """
    base = index.groupBy(by).agg(F.max_by("price", "date").alias("last"), F.stddev_samp("ret").alias("vol"), F.count("*").alias("n"))
    top = F.row_number().over(W.partitionBy(by).orderBy(F.desc("exposure"), "sector"))
    s3 = sectors.withColumn("_rn", top).where("_rn <= 3").select(
        by, F.concat(F.lit("sector_shock_"), F.replace(F.lower("sector"), F.lit(" "), F.lit("_"))).alias("name"),
        F.lit(1).alias("horizon_days"), (SECTOR_DROP * F.col("exposure")).alias("shock_return"),
    )
    v = F.when(F.col("n") >= 2, F.col("vol"))
    fixed = [
        ("one_day_2sigma", 1, -2 * v), ("one_day_3sigma", 1, -3 * v), ("five_day_2sigma", 5, -2 * v * math.sqrt(5.0)),
        ("market_10pct", 1, F.lit(-0.10)), ("market_20pct", 1, F.lit(-0.20)),
        ("rate_up_100bp", 1, RATE_UP_LOSS * F.col("rate_sensitive_weight")), ("rate_down_100bp", 1, RATE_DOWN_GAIN * F.col("rate_sensitive_weight")),
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(h).alias("horizon_days"), s.alias("shock_return")) for n, h, s in fixed])
    plain = base.join(rate_weight, by).select(by, F.inline(rows)).where("shock_return is not null")
    out = plain.unionByName(s3)
    return out.join(base.select(by, "last"), by).select(
        by, "name", "horizon_days", "shock_return", (F.col("last") * (1 + F.col("shock_return"))).alias("shocked_price")
    )


def scenario_facts(fans: DataFrame, value: float, base_name: str = "base", by: str = "portfolio_id") -> DataFrame:
    """Start, end, return against base, money impact, tail, band and worst point of each fan."""
    f = fans.groupBy(by, "scenario").agg(
        F.count("*").alias("horizon"), F.min_by("central", "step").alias("start"), F.max_by("central", "step").alias("end"),
        F.max_by(F.coalesce("lower_2s", "p5"), "step").alias("down_end"), F.max_by(F.coalesce("upper_2s", "p95"), "step").alias("up_end"),
        F.min("central").alias("low"),
    )
    base = f.where(F.col("scenario") == base_name).select(by, F.col("end").alias("base_end"))
    x = f.join(base, by, "left")
    is_base = F.col("scenario") == base_name
    pct = lambda a, b: (F.try_divide(a, b) - 1) * 100
    vs = F.when(~is_base, pct(F.col("end"), F.col("base_end")))
    own = pct(F.col("end"), F.col("start"))
    return x.select(
        by, "scenario", is_base.alias("is_base"), "horizon", "start", "end", own.alias("path_return_pct"), vs.alias("vs_base_pct"),
        (F.coalesce(vs, own) * value / 100).alias("money_impact"), pct(F.col("down_end"), F.col("end")).alias("downside_pct"),
        (F.try_divide(F.col("up_end") - F.col("down_end"), F.col("end")) * 100).alias("band_pct"),
        pct(F.col("low"), F.col("start")).alias("worst_point_pct"),
    )


def base_scenario_name(scenarios: DataFrame) -> DataFrame:
    """The reference scenario: ``base``, else ``Base Case``, else the first neutral one."""
    neutral = (F.coalesce("initial_shock_pct", F.lit(0.0)) == 0) & (F.coalesce("return_scale", F.lit(1.0)) == 1.0) & (
        F.coalesce("drift_shift", F.lit(0.0)) == 0
    )
    rank = F.when(F.col("name") == "base", 0).when(F.col("name") == "Base Case", 1).when(neutral, 2)
    return scenarios.agg(F.min_by("name", F.when(rank.isNotNull(), F.struct(rank, "position"))).alias("base_name"))


def scenario_comparison(fans: DataFrame, value: float, by: str = "portfolio_id") -> DataFrame:
    """Median end against the base start, in percent and money; internal names are left out."""
    f = fans.where(~F.col("scenario").startswith("_")).groupBy(by, "scenario").agg(
        F.min_by("central", "step").alias("start"), F.max_by("central", "step").alias("end")
    )
    base = f.where("scenario = 'base'").select(by, F.col("start").alias("base_start"))
    x = f.join(base, by, "left").withColumn("from", F.coalesce("base_start", "start"))
    ret = F.coalesce((F.try_divide(F.col("end"), F.col("from")) - 1) * 100, F.lit(0.0))
    return x.select(by, "scenario", ret.alias("return_pct"), (ret * value / 100).alias("money_impact"))


def valuation_projection(forecast: DataFrame, facts: DataFrame, by: str = "symbol") -> DataFrame:
    """P/E and yield along a price path with earnings and payouts held at today's level.

    ``facts`` carries (by, base, pe_ratio, fund_yield).
    """
    x = forecast.join(facts, by)
    return x.select(
        by, "step",
        F.when(F.col("pe_ratio") > 0, F.col("price") / (F.col("base") / F.col("pe_ratio"))).alias("pe_ratio"),
        F.when(F.col("fund_yield") > 0, F.col("base") * F.col("fund_yield") / F.col("price")).alias("dividend_yield"),
    )


def bottom_up_forecast(positions: DataFrame, steps: DataFrame, last_index: DataFrame, cone: DataFrame, by: str = "portfolio_id") -> DataFrame:
    """Weighted holding returns compounded from the last index level, with a re-centred cone.

    ``last_index`` (by, last); ``cone`` (by, step, lo, mid, hi) on its own level.
    """
    r = positions.join(steps.select("symbol", "step", "ret"), "symbol").groupBy(by, "step").agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"))
    w = W.partitionBy(by).orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    line = r.withColumn("_g", F.product(1 + F.col("ret")).over(w)).join(last_index, by).withColumn("price", F.col("last") * F.col("_g"))
    x = line.join(cone, [by, "step"], "left")
    down = F.greatest(F.col("mid") - F.col("lo"), F.lit(0.0))
    up = F.greatest(F.col("hi") - F.col("mid"), F.lit(0.0))
    return x.select(
        by, "step", "ret", "price", F.coalesce(F.col("price") - down, F.col("price") * 0.95).alias("lower"),
        F.coalesce(F.col("price") + up, F.col("price") * 1.05).alias("upper"),
    )


def drift_projection(prices: DataFrame, horizon: int = 20, by: str = "symbol") -> DataFrame:
    """``last·exp(step·mean)`` with the mean of the last 63 returns (the first return counts as 0)."""
    w = series(by)
    r = F.coalesce(F.col("price") / F.lag("price").over(w) - 1, F.lit(0.0))
    rn = F.row_number().over(W.partitionBy(by).orderBy(F.desc("date")))
    x = prices.withColumn("r", r).withColumn("_rn", rn).where(F.col("_rn") <= DRIFT_ROWS)
    s = x.groupBy(by).agg(F.avg("r").alias("mean"), F.max_by("price", "date").alias("last"))
    s = s.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return s.select(by, "step", (F.col("last") * F.exp(F.col("step") * F.col("mean"))).alias("price"))


def explosion_gate(history: DataFrame, forecast: DataFrame, sigmas: float = 10.0, by: str = "symbol") -> DataFrame:
    """Forecasts that leave last ± 10σ (or are not finite) become a geometric drift path ±10%."""
    h = history.groupBy(by).agg(
        F.max_by("price", "date").alias("last"), F.min_by("price", "date").alias("first"), F.stddev_samp("price").alias("sd"), F.count("*").alias("n")
    )
    sd = F.when(F.coalesce(F.col("sd"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("sd"))
    x = forecast.join(h, by).withColumn("_hi", F.col("last") + sigmas * sd).withColumn("_lo", F.greatest(F.lit(0.01), F.col("last") - sigmas * sd))
    p = F.col("price")
    bad = p.isNull() | F.isnan(p) | (p > F.col("_hi")) | (p < F.col("_lo"))
    x = x.withColumn("exploded", F.coalesce(F.max(bad).over(W.partitionBy(by)) & (F.col("n") > 1), F.lit(False)))
    drift = F.when(F.col("first") > 0, F.pow(F.col("last") / F.col("first"), 1.0 / F.greatest(F.lit(1), F.col("n") - 1)) - 1).otherwise(0.0)
    safe = F.col("last") * F.pow(1 + drift, F.col("step"))
    return x.select(
        by, "step", "exploded", F.when(F.col("exploded"), safe).otherwise(p).alias("price"),
        F.when(F.col("exploded"), safe * 0.9).otherwise(F.col("lower")).alias("lower"),
        F.when(F.col("exploded"), safe * 1.1).otherwise(F.col("upper")).alias("upper"),
    )
