"""Registered queries: scenarios, simulated fans, stress, forecast evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from risklake.functions.scalar import scenario_origin
from risklake.functions.stats import gaussian
from risklake.operators import evaluate as ev
from risklake.operators import metrics as m
from risklake.operators import returns
from risklake.operators import simulate as sim
from risklake.plans.catalog_risk import _erfc, _u
from risklake.plans.registry import register
from risklake.session import materialise
from risklake.sources.testdata import Tables

UP = "ROWS UNBOUNDED PRECEDING"
WS = "PARTITION BY symbol ORDER BY date"
DEFS = sim.BUILTIN_SCENARIOS
_DEF_ROWS = ", ".join(f"('{n}', {a}e0, {b}e0, {c}e0)" for n, (a, b, c) in DEFS.items())
_SC = f"(VALUES {_DEF_ROWS}) sc(name, shock, scale, drift)"
_SCB = f"(VALUES ('base', 0e0, 1e0, 0e0), {_DEF_ROWS}) sc(name, shock, scale, drift)"

STEPS_SQL = """st AS (SELECT f.symbol, date, price, lower, upper, row_number() OVER (PARTITION BY f.symbol ORDER BY date) AS step,
    price/coalesce(lag(price) OVER (PARTITION BY f.symbol ORDER BY date), base)-1 AS ret FROM fcw f JOIN bs ON bs.symbol=f.symbol)"""
BASE_SQL = "bs AS (SELECT symbol, arg_max(price,date) AS base FROM hiw GROUP BY 1)"


@register(
    "sim_01_deterministic_paths", "symbol:s scenario:s step:i level:d4",
    f"""WITH {BASE_SQL}, {STEPS_SQL} SELECT st.symbol, sc.name AS scenario, step, base*(1+shock)*product(1+ret*scale+drift) OVER (PARTITION BY st.symbol, sc.name ORDER BY step {UP}) AS level
        FROM st JOIN bs ON bs.symbol=st.symbol, {_SC}""",
    store="prices_weekly",
)
def _(t: Tables):
    steps, base = sim.forecast_steps(t.history_weekly, t.forecast_weekly)
    return sim.deterministic_paths(steps, base, DEFS)


@register(
    "sim_02_scenario_merge", "name:s initial_shock_pct:d6 return_scale:d6 drift_shift:d6",
    f"""WITH c AS (SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'bear_10' WHEN 'FURNITURE' THEN '  ' ELSE lower(c_mktsegment) END AS name, c_acctbal/1e5 AS shock, c_custkey AS pos FROM customer),
        l AS (SELECT trim(name) AS name, arg_max(shock,pos) AS shock FROM c WHERE trim(name)<>'' GROUP BY 1)
        SELECT name, shock AS initial_shock_pct, 1 AS return_scale, 0 AS drift_shift FROM l UNION ALL SELECT name, shock, scale, drift FROM {_SC} WHERE name NOT IN (SELECT name FROM l)""",
)
def _(t: Tables):
    seg = F.col("c_mktsegment")
    name = F.when(seg == "BUILDING", "bear_10").when(seg == "FURNITURE", "  ").otherwise(F.lower(seg))
    custom = t.raw("customer").select(
        name.alias("name"), (F.col("c_acctbal") / 1e5).alias("initial_shock_pct"), F.lit(None).cast("double").alias("return_scale"),
        F.lit(None).cast("double").alias("drift_shift"), F.col("c_custkey").alias("position"),
    )
    return sim.merge_scenarios(custom)


_N = 500
BOOT = f"""{BASE_SQL}, {STEPS_SQL}, lg AS (SELECT symbol, row_number() OVER ({WS})-1 AS idx, r, r-avg(r) OVER (PARTITION BY symbol) AS residual, count(*) OVER (PARTITION BY symbol) AS n
      FROM (SELECT symbol, date, ln(price/lag(price) OVER ({WS})) AS r FROM hiw) WHERE r IS NOT NULL),
    nn AS (SELECT symbol, max(n) AS n FROM lg GROUP BY 1),
    dr AS (SELECT st.symbol, path, step, ln(1+ret) AS drift, CAST(floor({_u('st.symbol', 'path', 'step')}*n) AS BIGINT) AS idx FROM st JOIN nn ON nn.symbol=st.symbol, (SELECT unnest(generate_series(0,{_N - 1})) AS path)),
    sm AS (SELECT dr.symbol, path, step, base*exp(sum(drift+residual*0.7e0) OVER (PARTITION BY dr.symbol, path ORDER BY step {UP})) AS level FROM dr
      JOIN lg ON lg.symbol=dr.symbol AND lg.idx=dr.idx JOIN bs ON bs.symbol=dr.symbol)"""


@register(
    "sim_03_bootstrap_fan", "symbol:s step:i lower_2s:d4 central:d4 upper_2s:d4",
    f"WITH {BOOT} SELECT symbol, step, quantile_cont(level,0.025) AS lower_2s, quantile_cont(level,0.5) AS central, quantile_cont(level,0.975) AS upper_2s FROM sm GROUP BY 1,2",
    store="prices_weekly",
)
def _(t: Tables):
    return sim.fan(sim.bootstrap_paths(t.history_weekly, t.forecast_weekly, _N), ["symbol", "step"])


@register(
    "sim_13_representative_path", "symbol:s path:i step:i level:d4",
    f"""WITH {BOOT}, v AS (SELECT symbol, path, stddev_pop(r) AS vol FROM (SELECT *, ln(level/lag(level) OVER (PARTITION BY symbol,path ORDER BY step)) AS r FROM sm) GROUP BY 1,2),
        b AS (SELECT symbol, path FROM (SELECT *, median(vol) OVER (PARTITION BY symbol) AS md FROM v) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY round(abs(vol-md),12), path)=1)
        SELECT sm.* FROM sm JOIN b ON b.symbol=sm.symbol AND b.path=sm.path""",
    store="prices_weekly",
)
def _(t: Tables):
    return sim.representative_path(sim.bootstrap_paths(t.history_weekly, t.forecast_weekly, _N))


LOGW_SQL = f"""lw AS (SELECT h.portfolio_id, h.symbol, h.weight, r.date, r.ret FROM pos h JOIN (SELECT symbol, date, ln(price/lag(price) OVER ({WS})) AS ret FROM pw) r
    ON r.symbol=h.symbol WHERE r.ret IS NOT NULL QUALIFY count(*) OVER (PARTITION BY h.portfolio_id, r.date) = (SELECT count(*) FROM pos x WHERE x.portfolio_id=h.portfolio_id))"""
CELL_SQL = f"""{LOGW_SQL}, zz AS (SELECT *, avg(ret) OVER w AS mu, stddev_samp(ret) OVER w AS sigma, (ret-avg(ret) OVER w)/(stddev_pop(ret) OVER w+1e-12) AS z0,
      row_number() OVER (PARTITION BY portfolio_id,symbol ORDER BY date)-1 AS rn, count(*) OVER w AS n FROM lw WINDOW w AS (PARTITION BY portfolio_id, symbol)),
    ed AS (SELECT portfolio_id, symbol, quantile_cont(z0,0.25) AS e1, quantile_cont(z0,0.5) AS e2, quantile_cont(z0,0.75) AS e3 FROM zz GROUP BY 1,2),
    cl AS (SELECT zz.*, c.cell, CASE c.cell WHEN 0 THEN (2*e1-e2+e1)/2 WHEN 1 THEN (e1+e2)/2 WHEN 2 THEN (e2+e3)/2 ELSE (e3+2*e3-e2)/2 END AS z FROM zz JOIN ed ON ed.portfolio_id=zz.portfolio_id AND ed.symbol=zz.symbol,
      LATERAL (SELECT CASE WHEN z0>=e3 THEN 3 WHEN z0>=e2 THEN 2 WHEN z0>=e1 THEN 1 ELSE 0 END AS cell) c),
    dw AS (SELECT s.portfolio_id, path, step, CAST(floor({_u('s.portfolio_id', 'path', 'step')}*n) AS BIGINT) AS rn FROM (SELECT portfolio_id, max(n) AS n FROM cl GROUP BY 1) s,
      (SELECT unnest(generate_series(0,{_N - 1})) AS path), (SELECT unnest(generate_series(1,20)) AS step))"""


def _cells(t: Tables):
    return materialise(sim.standardised_rows(m.common_returns(t.positions, t.prices_weekly, log=True)), "cells")


@register(
    "sim_04_joint_sampling", "portfolio_id:i symbol:s cell:i draws:i mean_z:d6",
    f"""WITH {CELL_SQL} SELECT dw.portfolio_id, symbol, cell, count(*) AS draws, avg(z) AS mean_z FROM dw JOIN cl ON cl.portfolio_id=dw.portfolio_id AND cl.rn=dw.rn GROUP BY 1,2,3""",
)
def _(t: Tables):
    rows = _cells(t)
    drawn = sim.joint_draws(rows, _N, 20).join(rows, ["portfolio_id", "rn"])
    return drawn.groupBy("portfolio_id", "symbol", "cell").agg(F.count("*").alias("draws"), F.avg("z").alias("mean_z"))


PATH_SQL = f"""{CELL_SQL}, pr AS (SELECT portfolio_id, rn, sum(weight*sigma*z)/sum(weight) AS shock, sum(weight*mu)/sum(weight) AS drift FROM cl GROUP BY 1,2),
    pp AS (SELECT dw.portfolio_id, path, step, sum(shock) OVER (PARTITION BY dw.portfolio_id, path ORDER BY step {UP}) AS cs, drift FROM dw JOIN pr ON pr.portfolio_id=dw.portfolio_id AND pr.rn=dw.rn)"""
LEVEL_SQL = f"""{PATH_SQL}, lv AS (SELECT portfolio_id, sc.name AS scenario, path, step, 100*(1+shock)*exp(step*(pp.drift+sc.drift)+scale*cs) AS level FROM pp, {_SCB})"""
_FAN = "quantile_cont(level,0.025) AS lower_2s, quantile_cont(level,0.05) AS p5, quantile_cont(level,0.16) AS lower_1s, quantile_cont(level,0.5) AS central, quantile_cont(level,0.84) AS upper_1s, quantile_cont(level,0.95) AS p95, quantile_cont(level,0.975) AS upper_2s"
FAN_SQL = f"{LEVEL_SQL}, fn AS (SELECT portfolio_id, scenario, step, {_FAN} FROM lv GROUP BY 1,2,3)"


def _paths(t: Tables):
    return sim.portfolio_shock_paths(_cells(t), _N, 20)


def _fans(t: Tables):
    return materialise(sim.fan(sim.scenario_levels(_paths(t), DEFS), ["portfolio_id", "scenario", "step"]), "fans")


@register(
    "sim_05_portfolio_fan", "portfolio_id:i scenario:s step:i lower_2s:d4 p5:d4 lower_1s:d4 central:d4 upper_1s:d4 p95:d4 upper_2s:d3",
    f"WITH {FAN_SQL} SELECT * FROM fn",
)
def _(t: Tables):
    return _fans(t)


_GAUSS = f"sqrt(-2*ln({_u('symbol', 'path', 'step', chr(39) + 'a' + chr(39))}))*cos(2*pi()*{_u('symbol', 'path', 'step', chr(39) + 'b' + chr(39))})"


@register(
    "sim_06_gaussian_fan", "symbol:s scenario:s step:i lower_2s:d3 central:d3 upper_2s:d3",
    f"""WITH mo AS (SELECT symbol, arg_max(price,date) AS base, avg(r) AS mu, stddev_samp(r) AS sigma FROM (SELECT *, ln(price/lag(price) OVER ({WS})) AS r FROM pw) GROUP BY 1),
        d AS (SELECT symbol, base, mu, sigma, path, step, {_GAUSS} AS z FROM mo, (SELECT unnest(generate_series(0,{_N - 1})) AS path), (SELECT unnest(generate_series(1,10)) AS step)),
        c AS (SELECT *, sum(z) OVER (PARTITION BY symbol,path ORDER BY step {UP}) AS cz FROM d),
        l AS (SELECT symbol, sc.name AS scenario, step, base*(1+shock)*exp(step*(mu+drift-0.5e0*pow(sigma*scale,2))+sigma*scale*cz) AS level FROM c, {_SCB})
        SELECT symbol, scenario, step, quantile_cont(level,0.025) AS lower_2s, quantile_cont(level,0.5) AS central, quantile_cont(level,0.975) AS upper_2s FROM l GROUP BY 1,2,3""",
)
def _(t: Tables):
    levels = sim.gaussian_levels(sim.return_moments(t.prices_weekly), DEFS, _N, 10)
    return sim.fan(levels, ["symbol", "scenario", "step"])


@register(
    "sim_07_terminal_risk", "portfolio_id:i var_99:d6 var_95:d6 cvar_99:d6 best_case:d4 worst_case:d6",
    f"""WITH {LEVEL_SQL}, e AS (SELECT portfolio_id, level/100-1 AS r FROM lv WHERE scenario='base' AND step=20), q AS (SELECT portfolio_id, quantile_cont(r,0.01) AS v99, quantile_cont(r,0.05) AS v95 FROM e GROUP BY 1)
        SELECT e.portfolio_id, any_value(v99) AS var_99, any_value(v95) AS var_95, avg(r) FILTER (r<=v99) AS cvar_99, max(r) AS best_case, min(r) AS worst_case
        FROM e JOIN q ON q.portfolio_id=e.portfolio_id GROUP BY 1""",
)
def _(t: Tables):
    return sim.terminal_risk(sim.scenario_levels(_paths(t), {}), base=100.0)


@register(
    "sim_07_terminal_histogram", "portfolio_id:i bin:i start:d4 n:i",
    f"""WITH {LEVEL_SQL}, e AS (SELECT portfolio_id, level FROM lv WHERE scenario='base' AND step=20), b AS (SELECT portfolio_id, min(level) AS lo, (max(level)-min(level))/30 AS w FROM e GROUP BY 1),
        c AS (SELECT e.portfolio_id, least(29, CAST(floor((level-lo)/w) AS BIGINT)) AS bin, count(*) AS n FROM e JOIN b ON b.portfolio_id=e.portfolio_id GROUP BY 1,2)
        SELECT b.portfolio_id, g.bin, lo+g.bin*w AS start, coalesce(n,0) AS n FROM b, (SELECT unnest(generate_series(0,29)) AS bin) g LEFT JOIN c ON c.portfolio_id=b.portfolio_id AND c.bin=g.bin""",
)
def _(t: Tables):
    ends = sim.scenario_levels(_paths(t), {}).where("step = 20")
    return m.histogram(ends, "level", 30, by=["portfolio_id"])


@register(
    "sim_08_lognormal_var", "symbol:s var:d6 cvar:d5",
    f"""SELECT symbol, exp(mu+s*z)-1 AS var, exp(mu+0.5e0*s*s)*0.5e0*{_erfc('(s-z)/sqrt(2)')}/0.05e0-1 AS cvar FROM (SELECT symbol, avg(r)*20 AS mu, stddev_pop(r)*sqrt(20) AS s, -1.6448536269514729e0 AS z
        FROM (SELECT *, ln(price/lag(price) OVER ({WS})) AS r FROM pw) GROUP BY 1)""",
)
def _(t: Tables):
    return sim.lognormal_var(t.prices_weekly)


@register("sim_09_risk_cone", "symbol:s step:i price_p5:d3 price_p50:d3 price_p95:d2 sigma_p5:d6 sigma_p50:d6 sigma_p95:d6")
def _(t: Tables):
    return sim.risk_cone(t.prices_weekly)


@register(
    "sim_10_worst_case_shock", "portfolio_id:i symbol:s level:d1 shock_pct:d6 agg_shock_pct:d6 cvar:d6",
    f"""WITH {PATH_SQL}, a AS (SELECT portfolio_id, symbol, max(weight) AS w, max(sigma) AS s FROM cl GROUP BY 1,2), b AS (SELECT portfolio_id, symbol, w/sum(w) OVER (PARTITION BY portfolio_id) AS w, exp(-3*s)-1 AS shock_pct FROM a),
        g AS (SELECT portfolio_id, avg(x) AS tail FROM (SELECT portfolio_id, exp(20*drift+cs) AS x, row_number() OVER (PARTITION BY portfolio_id ORDER BY exp(20*drift+cs)) AS rk, count(*) OVER (PARTITION BY portfolio_id) AS n FROM pp WHERE step=20)
          WHERE rk<=greatest(1, floor(n*0.05)) GROUP BY 1)
        SELECT b.portfolio_id, symbol, -3 AS level, shock_pct, sum(w*shock_pct) OVER (PARTITION BY b.portfolio_id) AS agg_shock_pct, (1+sum(w*shock_pct) OVER (PARTITION BY b.portfolio_id))*tail-1 AS cvar
        FROM b JOIN g ON g.portfolio_id=b.portfolio_id""",
)
def _(t: Tables):
    rows = _cells(t)
    return sim.worst_case_shock(rows, sim.portfolio_shock_paths(rows, _N, 20))


@register(
    "sim_11_stress_table", "portfolio_id:i name:s horizon_days:i shock_return:d6 shocked_price:d2",
    """WITH b AS (SELECT portfolio_id, arg_max(price,date) AS last, stddev_samp(ret) AS v FROM ixw GROUP BY 1),
       r AS (SELECT portfolio_id, sum(CASE WHEN asset_type IN ('BOND','FUTURE') THEN weight ELSE 0 END) AS rw FROM pos GROUP BY 1),
       s AS (SELECT portfolio_id, asset_class, sum(weight) AS e FROM pos h JOIN assets a ON a.symbol=h.symbol GROUP BY 1,2 QUALIFY row_number() OVER (PARTITION BY portfolio_id ORDER BY sum(weight) DESC, asset_class)<=3),
       u AS (SELECT b.portfolio_id, unnest(['one_day_2sigma','one_day_3sigma','five_day_2sigma','market_10pct','market_20pct','rate_up_100bp','rate_down_100bp']) AS name,
         unnest([1,1,5,1,1,1,1]) AS horizon_days, unnest([-2*v,-3*v,-2*v*sqrt(5),-0.1e0,-0.2e0,-0.05e0*rw,0.04e0*rw]) AS shock_return FROM b JOIN r ON r.portfolio_id=b.portfolio_id
         UNION ALL SELECT portfolio_id, 'sector_shock_'||lower(asset_class), 1, -0.12e0*e FROM s)
       SELECT u.*, last*(1+shock_return) AS shocked_price FROM u JOIN b ON b.portfolio_id=u.portfolio_id""",
    store="prices_weekly positions",
)
def _(t: Tables):
    index = returns.price_index(returns.portfolio_returns(t.positions, t.prices_weekly))
    held = t.positions.join(t.assets.select("symbol", F.col("asset_class").alias("sector")), "symbol")
    return sim.stress_table(index, m.sector_exposure(held), m.rate_sensitive_weight(held))


FACTS_SQL = f"""{FAN_SQL}, fa AS (SELECT portfolio_id, scenario, count(*) AS horizon, arg_min(central,step) AS s, arg_max(central,step) AS e, arg_max(lower_2s,step) AS dn, arg_max(upper_2s,step) AS u, min(central) AS lo FROM fn GROUP BY 1,2),
    fc AS (SELECT fa.portfolio_id, fa.scenario, fa.scenario='base' AS is_base, fa.horizon, fa.s AS start, fa.e AS "end", (fa.e/fa.s-1)*100 AS path_return_pct, CASE WHEN fa.scenario<>'base' THEN (fa.e/b.e-1)*100 END AS vs_base_pct,
      (fa.dn/fa.e-1)*100 AS downside_pct, (fa.u-fa.dn)/fa.e*100 AS band_pct, (fa.lo/fa.s-1)*100 AS worst_point_pct FROM fa LEFT JOIN fa b ON b.portfolio_id=fa.portfolio_id AND b.scenario='base')"""


@register(
    "sim_12_scenario_facts", "portfolio_id:i scenario:s is_base:b horizon:i start:d4 end:d4 path_return_pct:d4 vs_base_pct:d4 money_impact:d1 downside_pct:d4 band_pct:d3 worst_point_pct:d4",
    f"WITH {FACTS_SQL} SELECT *, coalesce(vs_base_pct, path_return_pct)*1e6/100 AS money_impact FROM fc",
)
def _(t: Tables):
    return sim.scenario_facts(_fans(t), 1e6)


@register(
    "sim_12_base_scenario", "base_name:s",
    "SELECT arg_min(c_name, c_custkey) AS base_name FROM customer WHERE floor(c_acctbal/10)=0",
)
def _(t: Tables):
    s = t.raw("customer").select(
        F.col("c_name").alias("name"), F.floor(F.col("c_acctbal") / 10).cast("double").alias("initial_shock_pct"), F.lit(1.0).alias("return_scale"),
        F.lit(None).cast("double").alias("drift_shift"), F.col("c_custkey").alias("position"),
    )
    return sim.base_scenario_name(s)


@register(
    "join_15_scenario_compare", "portfolio_id:i scenario:s current_return_pct:d4 proposed_return_pct:d4",
    f"""WITH {FACTS_SQL} SELECT a.portfolio_id, a.scenario, coalesce(a.vs_base_pct,a.path_return_pct) AS current_return_pct, coalesce(b.vs_base_pct,b.path_return_pct) AS proposed_return_pct
        FROM fc a JOIN fc b ON a.scenario=b.scenario AND b.portfolio_id=a.portfolio_id+1""",
)
def _(t: Tables):
    facts = sim.scenario_facts(_fans(t), 1e6).withColumn("r", F.coalesce("vs_base_pct", "path_return_pct"))
    # every book against the next one as its proposed form
    now = facts.select("portfolio_id", "scenario", F.col("r").alias("current_return_pct"))
    new = facts.select((F.col("portfolio_id") - 1).alias("portfolio_id"), "scenario", F.col("r").alias("proposed_return_pct"))
    return now.join(new, ["portfolio_id", "scenario"]).where("current_return_pct is not null and proposed_return_pct is not null")


@register(
    "sim_14_valuation_projection", "symbol:s step:i pe_ratio:d4 dividend_yield:d6",
    f"""WITH {BASE_SQL}, {STEPS_SQL} SELECT st.symbol, step, price/(base/pe) AS pe_ratio, base*y/price AS dividend_yield FROM st JOIN bs ON bs.symbol=st.symbol JOIN
        (SELECT p_type AS symbol, avg(p_size) AS pe, 0.02e0 AS y FROM part GROUP BY 1) f ON f.symbol=st.symbol""",
    store="prices_weekly",
)
def _(t: Tables):
    steps, base = sim.forecast_steps(t.history_weekly, t.forecast_weekly)
    facts = t.raw("part").groupBy(F.col("p_type").alias("symbol")).agg(F.avg("p_size").alias("pe_ratio")).withColumn("fund_yield", F.lit(0.02))
    return sim.valuation_projection(steps, base.join(facts, "symbol"))


@register(
    "sim_15_bottom_up_forecast", "portfolio_id:i step:i ret:d6 price:d4 lower:d4 upper:d4",
    f"""WITH {FAN_SQL}, {BASE_SQL}, {STEPS_SQL}, r AS (SELECT portfolio_id, step, sum(weight*ret) AS ret FROM pos h JOIN st ON st.symbol=h.symbol GROUP BY 1,2),
        l AS (SELECT portfolio_id, step, ret, 100*product(1+ret) OVER (PARTITION BY portfolio_id ORDER BY step {UP}) AS price FROM r)
        SELECT l.*, coalesce(price-greatest(central-p5,0), price*0.95e0) AS lower, coalesce(price+greatest(p95-central,0), price*1.05e0) AS upper FROM l
        LEFT JOIN (SELECT * FROM fn WHERE scenario='base') c ON c.portfolio_id=l.portfolio_id AND c.step=l.step""",
    store="prices_weekly positions",
)
def _(t: Tables):
    steps, _ = sim.forecast_steps(t.history_weekly, t.forecast_weekly)
    cone = _fans(t).where("scenario = 'base'").select("portfolio_id", "step", F.col("p5").alias("lo"), F.col("central").alias("mid"), F.col("p95").alias("hi"))
    last = t.positions.select("portfolio_id").distinct().withColumn("last", F.lit(100.0))
    return sim.bottom_up_forecast(t.positions, steps, last, cone)


@register(
    "sim_16_scenario_comparison", "portfolio_id:i scenario:s return_pct:d4 money_impact:d1",
    f"""WITH {FAN_SQL}, fa AS (SELECT portfolio_id, scenario, arg_min(central,step) AS s, arg_max(central,step) AS e FROM fn GROUP BY 1,2)
        SELECT fa.portfolio_id, fa.scenario, (fa.e/b.s-1)*100 AS return_pct, (fa.e/b.s-1)*1e6 AS money_impact FROM fa JOIN fa b ON b.portfolio_id=fa.portfolio_id AND b.scenario='base'""",
)
def _(t: Tables):
    return sim.scenario_comparison(_fans(t), 1e6)


@register(
    "sim_17_drift_projection", "symbol:s step:i price:d3",
    f"""SELECT symbol, step, last*exp(step*mean) AS price FROM (SELECT symbol, avg(r) AS mean, arg_max(price,date) AS last FROM (SELECT *, coalesce(price/lag(price) OVER ({WS})-1,0) AS r FROM pw)
        WHERE true QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 63 GROUP BY ALL), (SELECT unnest(generate_series(1,20)) AS step)""".replace(
        "WHERE true QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 63 GROUP BY ALL",
        "WHERE rk <= 63 GROUP BY 1",
    ).replace("AS r FROM pw)", "AS r, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rk FROM pw)"),
)
def _(t: Tables):
    return sim.drift_projection(t.prices_weekly)


@register(
    "sim_18_gaussian_draws", "event_id:i z:d6",
    f"SELECT event_id, sqrt(-2*ln({_u('event_id', chr(39) + 'a' + chr(39))}))*cos(2*pi()*{_u('event_id', chr(39) + 'b' + chr(39))}) AS z FROM events",
)
def _(t: Tables):
    return t.raw("events").select("event_id", gaussian(42, "event_id").alias("z"))


@register(
    "sim_19_scenario_origin", "portfolio_id:i scenario:s origin:s",
    """SELECT CAST(c_custkey AS BIGINT) AS portfolio_id, s AS scenario, CASE WHEN s IN ('bull_10','low_vol_regime') THEN 'Built-in' WHEN s='base' THEN 'Reference' WHEN s='worst_case_cvar' THEN 'Auto-discovered' END AS origin
       FROM (SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'bull_10' WHEN 'BUILDING' THEN 'base' WHEN 'FURNITURE' THEN 'worst_case_cvar' WHEN 'HOUSEHOLD' THEN 'low_vol_regime' ELSE c_name END AS s FROM customer)""",
)
def _(t: Tables):
    seg = F.col("c_mktsegment")
    name = (
        F.when(seg == "AUTOMOBILE", "bull_10").when(seg == "BUILDING", "base").when(seg == "FURNITURE", "worst_case_cvar")
        .when(seg == "HOUSEHOLD", "low_vol_regime").otherwise(F.col("c_name"))
    )
    s = t.raw("customer").select(F.col("c_custkey").alias("portfolio_id"), name.alias("scenario"))
    return s.withColumn("origin", scenario_origin("scenario", list(DEFS)))


@register(
    "var_10_path_var", "portfolio_id:i step:i var:d6",
    f"WITH {LEVEL_SQL} SELECT portfolio_id, step, quantile_cont(level,0.05)/100-1 AS var FROM lv WHERE scenario='base' GROUP BY 1,2",
)
def _(t: Tables):
    from risklake.operators.var_backtest import path_var

    return path_var(sim.scenario_levels(_paths(t), {}), base=100.0)


@register(
    "flt_11_explosion_gate", "symbol:s step:i exploded:b price:d4 lower:d4 upper:d4",
    f"""WITH {BASE_SQL}, {STEPS_SQL}, h AS (SELECT symbol, arg_max(price,date) AS last, arg_min(price,date) AS first, stddev_samp(price) AS sd, count(*) AS n FROM hiw GROUP BY 1),
        x AS (SELECT st.symbol, step, CASE WHEN st.symbol IN ('LARGE','SMALL') AND step=7 THEN price*1e6 ELSE price END AS price, lower, upper FROM st),
        f AS (SELECT x.*, last, pow(last/first, 1e0/(n-1)) AS g, max(CASE WHEN price>last+10*sd OR price<greatest(0.01,last-10*sd) THEN 1 ELSE 0 END) OVER (PARTITION BY x.symbol)=1 AS bad FROM x JOIN h ON h.symbol=x.symbol)
        SELECT symbol, step, bad AS exploded, CASE WHEN bad THEN last*pow(g,step) ELSE price END AS price, CASE WHEN bad THEN last*pow(g,step)*0.9e0 ELSE lower END AS lower, CASE WHEN bad THEN last*pow(g,step)*1.1e0 ELSE upper END AS upper FROM f""",
    store="prices_weekly",
)
def _(t: Tables):
    steps, _ = sim.forecast_steps(t.history_weekly, t.forecast_weekly)
    broken = F.col("symbol").isin("LARGE", "SMALL") & (F.col("step") == 7)
    return sim.explosion_gate(t.history_weekly, steps.withColumn("price", F.when(broken, F.col("price") * 1e6).otherwise(F.col("price"))))


# ---- forecast evaluation --------------------------------------------------------------
SPLIT_SQL = """sp AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY e)-1 AS fold, e-15 AS train_end, e AS test_end FROM (SELECT symbol, count(*)-15*b AS e FROM pw, (SELECT unnest([0,1,2]) AS b) GROUP BY symbol, b) WHERE e-15>=120),
    nm AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date)-1 AS rn FROM pw),
    te AS (SELECT nm.symbol, fold, rn-train_end+1 AS step, date, price AS actual FROM nm JOIN sp ON sp.symbol=nm.symbol AND rn>=train_end AND rn<test_end),
    tn AS (SELECT nm.symbol, fold, date, price, rn, train_end, row_number() OVER (PARTITION BY nm.symbol, fold ORDER BY rn DESC) AS bk, coalesce(price/lag(price) OVER (PARTITION BY nm.symbol, fold ORDER BY rn)-1,0) AS r,
      lag(price) OVER (PARTITION BY nm.symbol, fold ORDER BY rn) AS lp FROM nm JOIN sp ON sp.symbol=nm.symbol AND rn<train_end),
    fs AS (SELECT symbol, fold, arg_max(price,rn) AS last, arg_min(price,rn) AS first, count(*) AS n, avg(r) FILTER (bk<=63) AS mr, avg(abs(price-lp)) AS nv FROM tn GROUP BY 1,2),
    af AS (SELECT symbol, fold, greatest(-0.98,least(0.98,regr_slope(price,x))) AS phi, avg(x) AS mx, avg(price) FILTER (x IS NOT NULL) AS my, min(price)-greatest(1e-6,0.1*(max(price)-min(price))) AS lo,
      max(price)+greatest(1e-6,0.1*(max(price)-min(price))) AS hi, arg_max(price,rn) AS last FROM (SELECT *, CASE WHEN bk<120 THEN lp END AS x FROM tn WHERE bk<=120) GROUP BY 1,2),
    ar AS (SELECT symbol, fold, 0 AS step, last AS price FROM af UNION ALL SELECT ar.symbol, ar.fold, step+1, greatest(lo,least(hi,(my-phi*mx)+phi*price)) FROM ar JOIN af ON af.symbol=ar.symbol AND af.fold=ar.fold WHERE step<15),
    fk AS (SELECT symbol, fold, 'naive' AS model, step, last AS predicted FROM fs, (SELECT unnest(generate_series(1,15)) AS step)
      UNION ALL SELECT symbol, fold, 'geometric', step, last*pow(pow(last/first,1e0/(n-1)),step) FROM fs, (SELECT unnest(generate_series(1,15)) AS step)
      UNION ALL SELECT symbol, fold, 'drift', step, last*exp(step*mr) FROM fs, (SELECT unnest(generate_series(1,15)) AS step)
      UNION ALL SELECT symbol, fold, 'ar1', step, price FROM ar WHERE step>0),
    ej AS (SELECT te.symbol, te.fold, model, te.step, te.date, actual, predicted FROM te JOIN fk ON fk.symbol=te.symbol AND fk.fold=te.fold AND fk.step=te.step)"""
_SPR = f"WITH RECURSIVE {SPLIT_SQL}"


def _eval(t: Tables):
    return materialise(ev.evaluated(t.prices_weekly, ev.walk_forward_splits(t.prices_weekly)), "evaluated")


@register("evl_01_walk_forward_splits", "symbol:s fold:i train_end:i test_end:i", f"{_SPR} SELECT * FROM sp")
def _(t: Tables):
    return ev.walk_forward_splits(t.prices_weekly)


BASELINE_SQL = f"""{SPLIT_SQL}, td AS (SELECT sp.symbol, fold, CASE WHEN sign(a.price-b.price)=0 THEN 1 ELSE sign(a.price-b.price) END AS trend FROM sp JOIN nm a ON a.symbol=sp.symbol AND a.rn=train_end-1 JOIN nm b ON b.symbol=sp.symbol AND b.rn=train_end-22),
    dd AS (SELECT *, lag(d) OVER (PARTITION BY symbol, fold ORDER BY step) AS bf FROM (SELECT symbol, fold, step, sign(actual-lag(actual) OVER (PARTITION BY symbol, fold ORDER BY step)) AS d FROM te) WHERE d IS NOT NULL),
    nb AS (SELECT dd.symbol, count(*) FILTER (d>0) AS up_hits, count(*) AS up_n, count(*) FILTER (d=bf) AS persist_hits, count(bf) AS persist_n, count(*) FILTER (d=trend) AS drift_hits, count(trend) AS drift_n FROM dd JOIN td ON td.symbol=dd.symbol AND td.fold=dd.fold GROUP BY 1)"""


@register("evl_02_naive_baselines", "symbol:s up_hits:i up_n:i persist_hits:i persist_n:i drift_hits:i drift_n:i", f"WITH RECURSIVE {BASELINE_SQL} SELECT * FROM nb", store="prices_weekly")
def _(t: Tables):
    return ev.naive_baselines(t.prices_weekly, ev.walk_forward_splits(t.prices_weekly))


QUALITY_SQL = f"""{SPLIT_SQL}, sq AS (SELECT symbol, model, fold, step, abs((actual-predicted)/actual) AS ape, CASE WHEN da IS NULL THEN NULL WHEN sign(da)=sd THEN 1.0 ELSE 0.0 END AS dir_match, sd*da/pa-da/pa AS excess FROM (SELECT *, CASE WHEN abs(dp)<=1e-9*abs(predicted) THEN 0 ELSE sign(dp) END AS sd FROM (SELECT *,
      actual-lag(actual) OVER w AS da, predicted-lag(predicted) OVER w AS dp, lag(actual) OVER w AS pa FROM ej WINDOW w AS (PARTITION BY symbol, model, fold ORDER BY step)))),
    pq AS (SELECT symbol, model, avg(ape) AS mape, avg(dir_match) AS directional_accuracy, CASE WHEN count(excess)>5 AND stddev_pop(excess)>1e-12 THEN avg(excess)/stddev_pop(excess) ELSE 0 END AS long_short, count(*) AS n_steps, count(dir_match) AS n_diffs FROM sq GROUP BY 1,2)"""


@register("evl_03_fold_quality", "symbol:s model:s fold:i step:i ape:d6 dir_match:d1 excess:d6", f"WITH RECURSIVE {QUALITY_SQL} SELECT * FROM sq", store="prices_weekly")
def _(t: Tables):
    return ev.step_quality(_eval(t))


@register("evl_04_pooled_quality", "symbol:s model:s mape:d6 directional_accuracy:d6 long_short:d6 n_steps:i", f"WITH RECURSIVE {QUALITY_SQL} SELECT * FROM pq", store="prices_weekly")
def _(t: Tables):
    return ev.pooled_quality(ev.step_quality(_eval(t)))


ERR_SQL = f"""{SPLIT_SQL}, er AS (SELECT ej.symbol, model, ej.fold, sqrt(avg(pow(actual-predicted,2))) AS rmse, avg(abs((actual-predicted)/actual)) AS mape, avg(abs(actual-predicted))/any_value(nv) AS mase
    FROM ej JOIN fs ON fs.symbol=ej.symbol AND fs.fold=ej.fold GROUP BY 1,2,3)"""


@register("evl_05_point_errors", "symbol:s model:s fold:i rmse:d4 mape:d6 mase:d6", f"WITH RECURSIVE {ERR_SQL} SELECT * FROM er", store="prices_weekly")
def _(t: Tables):
    return ev.point_errors(_eval(t), t.prices_weekly)


_WIL = "greatest(0,({k}/{n}+1.96*1.96/(2*{n}))/(1+1.96*1.96/{n})-1.96*sqrt({k}/{n}*(1-{k}/{n})/{n}+1.96*1.96/(4*{n}*{n}))/(1+1.96*1.96/{n}))"
_WIH = "least(1,({k}/{n}+1.96*1.96/(2*{n}))/(1+1.96*1.96/{n})+1.96*sqrt({k}/{n}*(1-{k}/{n})/{n}+1.96*1.96/(4*{n}*{n}))/(1+1.96*1.96/{n}))"


@register(
    "evl_06_wilson_interval", "symbol:s up_rate:d6 up_low:d6 up_high:d6",
    f"WITH RECURSIVE {BASELINE_SQL} SELECT symbol, up_hits/up_n AS up_rate, {_WIL.format(k='up_hits', n='up_n')} AS up_low, {_WIH.format(k='up_hits', n='up_n')} AS up_high FROM nb",
    store="prices_weekly",
)
def _(t: Tables):
    return ev.with_wilson(ev.naive_baselines(t.prices_weekly, ev.walk_forward_splits(t.prices_weekly)), "up_hits", "up_n", "up")


@register(
    "evl_07_track_record", "symbol:s model:s ci_low:d6 ci_high:d6 beats_coinflip:b",
    f"""WITH RECURSIVE {QUALITY_SQL} SELECT symbol, model, greatest(0,p-h) AS ci_low, least(1,p+h) AS ci_high, p-h>0.5 AS beats_coinflip FROM (SELECT *, directional_accuracy AS p,
        1.96e0*sqrt(directional_accuracy*(1-directional_accuracy)/n_steps) AS h FROM pq)""",
    store="prices_weekly",
)
def _(t: Tables):
    return ev.track_record(ev.pooled_quality(ev.step_quality(_eval(t))))


@register(
    "evl_08_league_table", "symbol:s score:d4 global_winner:s winner:s selection_mode:s",
    f"""WITH RECURSIVE {ERR_SQL}, sc AS (SELECT symbol, model, 0.5e0*max(rmse) FILTER (fold=0)+0.5e0*avg(rmse) AS score, avg(rmse) AS wf FROM er GROUP BY 1,2),
        w AS (SELECT symbol, arg_min(model, score) AS gw, min(score) AS score, arg_min(model, wf) AS rb FROM sc GROUP BY 1)
        SELECT symbol, score, gw AS global_winner, CASE WHEN rb<>gw THEN rb ELSE gw END AS winner, CASE WHEN rb<>gw THEN 'regime_conditional' ELSE 'global' END AS selection_mode FROM w""",
    store="prices_weekly",
)
def _(t: Tables):
    e = materialise(ev.point_errors(_eval(t), t.prices_weekly).select("symbol", "model", "fold", "rmse"), "errors")
    regimes = e.select("symbol", "fold").distinct().withColumn("regime", F.lit("Normal"))
    current = e.select("symbol").distinct().withColumn("regime", F.lit("Normal"))
    return ev.league_table(e.where("fold = 0").select("symbol", "model", "rmse"), e, regimes, current)


@register(
    "evl_09_evaluation_summary", "model:s n:i n_symbols:i acc_rate:d6 acc_low:d6 acc_high:d6 mape_median:d6 long_short_median:d6 wins:i edge_pp:d4",
    f"""WITH RECURSIVE {QUALITY_SQL}, {BASELINE_SQL[len(SPLIT_SQL) + 2:]}, b AS (SELECT greatest(sum(up_hits)/sum(up_n), sum(persist_hits)/sum(persist_n), sum(drift_hits)/sum(drift_n)) AS best FROM nb),
        k AS (SELECT model, CAST(sum(round(directional_accuracy*n_diffs)) AS DOUBLE) AS hits, sum(n_diffs) AS n, count(*) AS n_symbols, median(mape) AS mape_median, median(long_short) AS long_short_median FROM pq GROUP BY 1),
        wi AS (SELECT model, count(*) AS wins FROM (SELECT symbol, arg_min(model, mape) AS model FROM pq GROUP BY 1) GROUP BY 1)
        SELECT k.model, n, n_symbols, hits/n AS acc_rate, {_WIL.format(k='hits', n='n')} AS acc_low, {_WIH.format(k='hits', n='n')} AS acc_high, mape_median, long_short_median, coalesce(wins,0) AS wins, (hits/n-best)*100 AS edge_pp
        FROM k LEFT JOIN wi ON wi.model=k.model, b""",
    store="prices_weekly",
)
def _(t: Tables):
    q = materialise(ev.pooled_quality(ev.step_quality(_eval(t))), "quality")
    return ev.evaluation_summary(q, ev.naive_baselines(t.prices_weekly, ev.walk_forward_splits(t.prices_weekly)))


@register(
    "evl_10_config_staleness", "symbol:s triggers:s",
    """SELECT 'P'||p_partkey AS symbol, concat_ws(',', CASE WHEN (p_partkey%96)*1800 < 100000 THEN 'age' END, CASE WHEN p_size>0 AND p_partkey%61>p_size*1.2 THEN 'series_grew' END, CASE WHEN p_size>0 AND p_partkey%101>1.5*p_size THEN 'trailing_rmse' END) AS triggers FROM part""",
)
def _(t: Tables):
    cfg = t.raw("part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("symbol"), F.timestamp_seconds(F.lit(1704067200) + (F.col("p_partkey") % 96) * 1800).alias("trained_at"),
        F.col("p_size").alias("trained_n"), (F.col("p_partkey") % 61).alias("current_n"), F.col("p_size").cast("double").alias("cached_rmse"), (F.col("p_partkey") % 101).cast("double").alias("trailing_rmse"),
    )
    now = F.timestamp_seconds(F.lit(1704067200 + 7 * 86400 + 100000))
    return ev.staleness(cfg, now).withColumn("triggers", F.concat_ws(",", "triggers"))


@register("evl_11_forecast_table", "symbol:s fold:i model:s step:i predicted:d3", f"{_SPR} SELECT symbol, fold, model, step, predicted FROM fk", store="prices_weekly")
def _(t: Tables):
    return ev.fold_forecasts(t.prices_weekly, ev.walk_forward_splits(t.prices_weekly))


