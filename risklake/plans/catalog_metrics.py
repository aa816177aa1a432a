"""Registered queries: performance, tail risk, attribution and exposure."""

from __future__ import annotations

from pyspark.sql import functions as F

from risklake.functions.scalar import fragility_label
from risklake.operators import indicators as ind
from risklake.operators import metrics as m
from risklake.operators import returns
from risklake.plans.catalog_indicators import _EWMA
from risklake.plans.registry import register
from risklake.sources.testdata import Tables

WS = "PARTITION BY symbol ORDER BY date"
UP = "ROWS UNBOUNDED PRECEDING"

PERF_SQL = f"""WITH d AS (SELECT symbol, date, ret, price/max(price) OVER ({WS} {UP})-1 AS dd FROM rw1),
    q AS (SELECT symbol, quantile_cont(ret,0.05) AS v95, quantile_cont(ret,0.01) AS v99, quantile_cont(dd,0.05) AS d05 FROM d GROUP BY 1),
    g AS (SELECT d.symbol, count(*) AS n, avg(ret) AS mu, stddev_samp(ret) AS sd, stddev_samp(ret) FILTER (ret<0) AS ds,
      coalesce(sum(ret) FILTER (ret>0),0) AS gain, abs(coalesce(sum(ret) FILTER (ret<0),0)) AS loss,
      avg(CASE WHEN ret>0 THEN 1.0 ELSE 0.0 END) AS hit, min(dd) AS mdd, any_value(v95) AS v95, any_value(v99) AS v99,
      avg(ret) FILTER (ret<=v95) AS c95, avg(ret) FILTER (ret<=v99) AS c99, avg(dd) FILTER (dd<=d05) AS cd
      FROM d JOIN q ON q.symbol=d.symbol GROUP BY 1)
    SELECT symbol, n, pow(1+mu,252)-1 AS annualized_return, sd*sqrt(252) AS annualized_volatility,
      CASE WHEN sd>0 THEN (mu-0.03e0/252)/sd*sqrt(252) ELSE 0 END AS sharpe, CASE WHEN ds>0 THEN (mu-0.03e0/252)/ds*sqrt(252) ELSE 0 END AS sortino,
      mdd AS max_drawdown, CASE WHEN mdd<0 THEN (pow(1+mu,252)-1)/abs(mdd) ELSE 0 END AS calmar,
      CASE WHEN loss>0 THEN gain/loss WHEN gain>0 THEN 10 ELSE 0 END AS profit_factor, hit AS hit_rate, v95 AS var_95, v99 AS var_99,
      c95 AS cvar_95, c99 AS cvar_99, cd AS cdar_95 FROM g"""

for _name, _cols in {
    "agg_01_performance_table": "symbol:s n:i annualized_return:d4 annualized_volatility:d6",
    "agg_02_sharpe": "symbol:s sharpe:d6",
    "agg_03_sortino": "symbol:s sortino:d6",
    "agg_04_max_drawdown_calmar": "symbol:s max_drawdown:d6 calmar:d4",
    "agg_05_profit_factor": "symbol:s profit_factor:d6",
    "agg_06_hit_rate": "symbol:s hit_rate:d6",
    "agg_07_historical_var": "symbol:s var_95:d6 var_99:d6",
    "agg_08_cvar": "symbol:s cvar_95:d6 cvar_99:d6",
    "agg_09_cdar": "symbol:s cdar_95:d6",
}.items():
    register(_name, _cols, PERF_SQL)(lambda t: m.performance_table(t.prices_weekly))


@register(
    "agg_09_cdar_positive", "symbol:s cdar:d6",
    f"""WITH d AS (SELECT symbol, 1-price/max(price) OVER ({WS} {UP}) AS d FROM pdaily),
        q AS (SELECT symbol, quantile_cont(d,0.95) AS q FROM d GROUP BY 1)
        SELECT d.symbol, greatest(avg(d), 1e-4) AS cdar FROM d JOIN q ON q.symbol=d.symbol WHERE d >= q GROUP BY 1""",
)
def _(t: Tables):
    return m.empirical_cdar(t.prices_daily)


@register(
    "agg_10_portfolio_beta", "portfolio_id:i beta:d6",
    f"""SELECT portfolio_id, CASE WHEN count(*)>=30 AND var_samp(b)<>0 THEN covar_samp(p,b)/var_samp(b) ELSE 1 END AS beta FROM (
        SELECT portfolio_id, x.ret AS p, y.ret AS b FROM prw x JOIN (SELECT date, price/lag(price) OVER (ORDER BY date)-1 AS ret FROM bench) y
        ON x.date=y.date WHERE y.ret IS NOT NULL) GROUP BY 1""",
)
def _(t: Tables):
    return m.portfolio_beta(
        returns.portfolio_returns(t.positions, t.prices_weekly), returns.simple_returns(t.benchmark_weekly)
    )


CONTRIB = """SELECT h.portfolio_id, h.symbol, weight, ret, ret*weight AS contribution FROM {pos} h LEFT JOIN
    (SELECT symbol, CASE WHEN count(*)>=2 AND arg_min(price,date)>0 THEN arg_max(price,date)/arg_min(price,date)-1 END AS ret FROM pw
     WHERE date BETWEEN DATE '{a}' AND DATE '{b}' GROUP BY 1) r ON r.symbol=h.symbol"""


@register(
    "agg_11_asset_contributions", "portfolio_id:i symbol:s ret:d6 contribution:d6 rank:i",
    f"""SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY contribution DESC NULLS LAST, symbol) AS rank
        FROM ({CONTRIB.format(pos='posc', a='1999-01-01', b='1999-12-31')})""",
)
def _(t: Tables):
    c = m.window_contributions(t.positions_by_customer, t.prices_weekly, "1999-01-01", "1999-12-31")
    return m.ranked_contributions(c)


@register(
    "agg_12_top_bottom_contributors", "portfolio_id:i symbol:s contribution:d6 side:s",
    f"""SELECT portfolio_id, symbol, contribution, CASE WHEN u<=3 THEN 'top' ELSE 'bottom' END AS side FROM (SELECT *,
        row_number() OVER (PARTITION BY portfolio_id ORDER BY contribution DESC, symbol) AS u,
        row_number() OVER (PARTITION BY portfolio_id ORDER BY contribution, symbol DESC) AS d
        FROM ({CONTRIB.format(pos='posc', a='1998-01-01', b='1998-12-31')}) WHERE contribution IS NOT NULL) WHERE u<=3 OR d<=2""",
)
def _(t: Tables):
    c = m.window_contributions(t.positions_by_customer, t.prices_weekly, "1998-01-01", "1998-12-31")
    return m.top_and_bottom(c)


@register(
    "agg_13_event_impact_nulls_last", "portfolio_id:i symbol:s ret:d6 contribution:d6 rank:i",
    f"""SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY contribution DESC NULLS LAST, symbol) AS rank FROM (
        SELECT h.portfolio_id, h.symbol, weight, ret, ret*weight AS contribution FROM posc h LEFT JOIN (SELECT symbol,
        CASE WHEN count(*)>=2 THEN arg_max(price,date)/arg_min(price,date)-1 END AS ret FROM pdaily
        WHERE date BETWEEN DATE '1995-01-02' AND DATE '1995-01-03' GROUP BY 1) r ON r.symbol=h.symbol)""",
)
def _(t: Tables):
    c = m.window_contributions(t.positions_by_customer, t.prices_daily, "1995-01-02", "1995-01-03")
    return m.ranked_contributions(c)


_PERIODS = """SELECT {k}, months, CASE WHEN count(*)>=2 AND arg_min(price,date)>0 THEN arg_max(price,date)/arg_min(price,date)-1 END AS ret
    FROM (SELECT *, max(date) OVER (PARTITION BY {k}) AS e FROM {src}), (SELECT unnest([3,6,12,24]) AS months)
    WHERE date >= e - to_months(CAST(months AS INTEGER)) GROUP BY 1,2"""


@register(
    "agg_14_performance_block", "portfolio_id:i months:i portfolio_ret:d6 benchmark_ret:d6 relative:d6 residual:d6",
    f"""WITH pp AS (SELECT * FROM ({_PERIODS.format(k='portfolio_id', src='ixw')}) WHERE ret IS NOT NULL),
        bb AS ({_PERIODS.format(k='symbol', src='bench')}),
        hd AS (SELECT portfolio_id, max(months) AS months FROM pp GROUP BY 1), en AS (SELECT portfolio_id, max(date) AS e FROM ixw GROUP BY 1),
        mv AS (SELECT h.portfolio_id, h.symbol, hd.months, (arg_max(price,date)/arg_min(price,date)-1)*any_value(weight) AS c FROM pos h
          JOIN hd ON hd.portfolio_id=h.portfolio_id JOIN en ON en.portfolio_id=h.portfolio_id JOIN pw ON pw.symbol=h.symbol
          WHERE date >= e - to_months(CAST(hd.months AS INTEGER)) AND date <= e GROUP BY 1,2,3),
        cv AS (SELECT portfolio_id, months, sum(c) AS c FROM mv GROUP BY 1,2)
        SELECT pp.portfolio_id, pp.months, pp.ret AS portfolio_ret, bb.ret AS benchmark_ret, pp.ret-bb.ret AS relative, pp.ret-c AS residual
        FROM pp LEFT JOIN bb ON bb.months=pp.months LEFT JOIN cv ON cv.portfolio_id=pp.portfolio_id AND cv.months=pp.months""",
    store="prices_weekly positions benchmark_weekly",
)
def _(t: Tables):
    index = returns.price_index(returns.portfolio_returns(t.positions, t.prices_weekly))
    return m.performance_block(index, t.benchmark_weekly, t.positions, t.prices_weekly)


_COMMON = """SELECT h.portfolio_id, h.symbol, h.weight, r.date, r.ret FROM pos h JOIN (SELECT symbol, date, {f} AS ret FROM {src}) r
    ON r.symbol=h.symbol WHERE r.ret IS NOT NULL QUALIFY count(*) OVER (PARTITION BY h.portfolio_id, r.date) =
    (SELECT count(*) FROM pos x WHERE x.portfolio_id=h.portfolio_id)"""
COMMON_D = _COMMON.format(f=f"price/lag(price) OVER ({WS})-1", src="pdaily")
COMMON_LOG = _COMMON.format(f=f"ln(price/lag(price) OVER ({WS}))", src="pdaily")


@register(
    "agg_15_covariance_matrix", "portfolio_id:i symbol_i:s symbol_j:s n:i cov:d4",
    f"""WITH c AS ({COMMON_D}) SELECT a.portfolio_id, a.symbol AS symbol_i, b.symbol AS symbol_j, count(*) AS n, covar_samp(a.ret,b.ret)*252 AS cov
        FROM c a JOIN c b ON a.portfolio_id=b.portfolio_id AND a.date=b.date AND a.symbol<=b.symbol GROUP BY 1,2,3 HAVING count(*)>=60""",
)
def _(t: Tables):
    return m.covariance_matrix(m.common_returns(t.positions, t.prices_daily))


@register(
    "agg_16_risk_contributions", "portfolio_id:i symbol:s weight:d6 n_obs:i risk_contribution:d6 risk_pct:d6 portfolio_vol:d6",
    f"""WITH c AS ({COMMON_D}), k AS (SELECT a.portfolio_id, a.symbol AS i, b.symbol AS j, any_value(b.weight) AS wj, any_value(a.weight) AS wi,
          count(*) AS n, covar_samp(a.ret,b.ret)*252 AS cov FROM c a JOIN c b ON a.portfolio_id=b.portfolio_id AND a.date=b.date GROUP BY 1,2,3 HAVING count(*)>=60),
        g AS (SELECT portfolio_id, i AS symbol, any_value(wi) AS weight, any_value(n) AS n_obs, sum(wj*cov)*any_value(wi) AS wc FROM k GROUP BY 1,2),
        v AS (SELECT *, sqrt(sum(wc) OVER (PARTITION BY portfolio_id)) AS vol FROM g)
        SELECT portfolio_id, symbol, weight, n_obs, wc/vol AS risk_contribution, wc/vol/vol AS risk_pct, vol AS portfolio_vol FROM v""",
)
def _(t: Tables):
    return m.risk_contributions(m.common_returns(t.positions, t.prices_daily))


@register("agg_17_spectral_diversification", "portfolio_id:i n_assets:i entropy:d6 diversification_ratio:d6 dominant:d6")
def _(t: Tables):
    returns_ = m.common_returns(t.positions, t.prices_daily, log=True)
    return m.spectral_diversification(m.covariance_matrix(returns_, annualise=1.0))


@register(
    "agg_18_sector_exposure", "portfolio_id:i sector:s exposure:d6 rate_sensitive_weight:d6",
    """SELECT portfolio_id, sector, sum(weight) AS exposure, any_value(rs) AS rate_sensitive_weight FROM (SELECT *,
       CASE WHEN asset_type='FUTURE' THEN 'Unknown' ELSE asset_type END AS sector, sum(CASE WHEN asset_type IN ('BOND','FUTURE') THEN weight ELSE 0 END)
       OVER (PARTITION BY portfolio_id) AS rs FROM posc) GROUP BY 1,2""",
)
def _(t: Tables):
    p = t.positions_by_customer.withColumn("sector", F.when(F.col("asset_type") != "FUTURE", F.col("asset_type")))
    return m.sector_exposure(p).join(m.rate_sensitive_weight(p), "portfolio_id")


@register(
    "agg_19_allocation_by_type", "portfolio_id:i asset_type:s weight:d6",
    "SELECT portfolio_id, asset_type, sum(weight) AS weight FROM posc GROUP BY 1,2",
)
def _(t: Tables):
    return m.allocation_by(t.positions_by_customer, "asset_type")


@register(
    "agg_20_monthly_realised_vol", "symbol:s month:t vol_pct:d4",
    """SELECT symbol, date_trunc('month', date) AS month, CASE WHEN count(ret)>=5 THEN stddev_samp(ret)*sqrt(252)*100 END AS vol_pct
       FROM rd1 GROUP BY 1,2""",
)
def _(t: Tables):
    return m.monthly_vol(t.prices_daily)


@register(
    "agg_21_monthly_fragility", "portfolio_id:i month:t fragility:d6",
    f"""SELECT portfolio_id, month, sum(f*weight)/sum(weight) AS fragility FROM posc h JOIN (SELECT symbol, date_trunc('month', date) AS month,
        arg_max(fragility, date) AS f FROM ({_EWMA}) WHERE fragility IS NOT NULL GROUP BY 1,2) s ON s.symbol=h.symbol WHERE weight>0 GROUP BY 1,2""",
)
def _(t: Tables):
    snapshots = ind.ewma_risk(t.prices_weekly).where("fragility is not null")
    return m.monthly_fragility(t.positions_by_customer, snapshots)


QF_SQL = f"""SELECT portfolio_id, (product(1+ret) FILTER (rn<=63)-1)*100 AS quarter_pct, (product(1+ret)-1)*100 AS year_pct,
    stddev_samp(ret)*sqrt(252)*100 AS ann_vol_pct, min(dd)*100 AS max_drawdown_pct, count(*) AS n_obs FROM (SELECT *,
    eq/max(eq) OVER (PARTITION BY portfolio_id ORDER BY date {UP})-1 AS dd FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_id
    ORDER BY date DESC) AS rn, product(1+ret) OVER (PARTITION BY portfolio_id ORDER BY date {UP}) AS eq FROM prw)) GROUP BY 1 HAVING count(*)>=30"""


@register("agg_22_quarter_facts", "portfolio_id:i quarter_pct:d4 year_pct:d2 ann_vol_pct:d4 max_drawdown_pct:d4 n_obs:i", QF_SQL)
def _(t: Tables):
    return m.quarter_facts(returns.portfolio_returns(t.positions, t.prices_weekly))


@register(
    "agg_23_risk_reconciliation",
    "symbol:s value:d2 var_money:d2 drawdown_money:d2 worst_scenario:s worst_money:d2 stress_too_mild:b",
    f"""SELECT p.symbol, value, value*var_95 AS var_money, value*max_drawdown AS drawdown_money, 'crash' AS worst_scenario,
        value*w/100 AS worst_money, w/100 > max_drawdown AS stress_too_mild FROM ({PERF_SQL}) p JOIN
        (SELECT symbol, sum(quantity) AS value FROM pos GROUP BY 1) v ON v.symbol=p.symbol JOIN
        (SELECT symbol, -10 - 2*length(symbol) AS w FROM assets) s ON s.symbol=p.symbol""",
)
def _(t: Tables):
    values = t.positions.groupBy("symbol").agg(F.sum("quantity").alias("value"))
    deep = -10.0 - 2 * F.length("symbol")
    scenarios = t.assets.select(
        "symbol",
        F.explode(
            F.array(
                F.struct(F.lit("mild").alias("name"), F.lit(-5.0).alias("return_pct")),
                F.struct(F.lit("crash").alias("name"), deep.cast("double").alias("return_pct")),
            )
        ).alias("s"),
    ).select("symbol", "s.*")
    return m.risk_reconciliation(m.performance_table(t.prices_weekly), values, scenarios, by="symbol")


@register(
    "agg_24_fragility_label", "symbol:s date:t label:s",
    f"""SELECT symbol, date, CASE WHEN fragility IS NULL THEN 'unavailable' WHEN fragility>=1.5 THEN 'elevated (above the 1.5 fragile threshold)'
        WHEN fragility>=1.15 THEN 'moderately above its long-run median but below the 1.5 fragile threshold' WHEN fragility>=0.85
        THEN 'near its long-run median' ELSE 'below its long-run median' END AS label FROM ({_EWMA})""",
)
def _(t: Tables):
    return ind.ewma_risk(t.prices_weekly).withColumn("label", fragility_label("fragility"))


@register(
    "agg_25_risk_findings", "symbol:s finding:s",
    f"""WITH p AS ({PERF_SQL}), f AS (SELECT symbol, CASE WHEN annualized_volatility-3.6 > 0 THEN 'volatility_above_target' ELSE 'volatility_below_target'
        END AS finding FROM p WHERE abs(annualized_volatility-3.6)>0.02 UNION ALL SELECT symbol, 'deep_drawdown' FROM p WHERE max_drawdown<-0.15
        UNION ALL SELECT symbol, 'thin_compensation' FROM p WHERE sharpe<0.5)
        SELECT * FROM f UNION ALL SELECT symbol, 'aligned' FROM p WHERE symbol NOT IN (SELECT symbol FROM f)""",
)
def _(t: Tables):
    return m.risk_findings(m.performance_table(t.prices_weekly), target_vol=3.6, by="symbol")


LT = """(SELECT symbol, max(price) FILTER (rn=1) AS latest, max(price) FILTER (rn=2) AS previous FROM (SELECT *,
    row_number() OVER (PARTITION BY symbol ORDER BY date DESC) rn FROM pdaily) GROUP BY 1)"""
VALUED = f"""SELECT h.*, CASE WHEN cost_basis>0 AND quantity>0 THEN quantity*latest END AS current_value,
    quantity*latest-cost_basis AS unrealized_pnl, (quantity*latest-cost_basis)/cost_basis AS unrealized_pnl_pct,
    quantity*(latest-previous) AS daily_pnl FROM posc h LEFT JOIN {LT} c ON c.symbol=h.symbol"""


@register(
    "join_07_position_valuation", "portfolio_id:i symbol:s current_value:d2 unrealized_pnl:d2 unrealized_pnl_pct:d6 daily_pnl:d2", VALUED
)
def _(t: Tables):
    return m.value_positions(t.positions_by_customer, m.latest_two_closes(t.prices_daily))


@register(
    "join_07_portfolio_totals", "portfolio_id:i cost_basis:d2 current_value:d2 unrealized_pnl:d2 unrealized_pnl_pct:d6 daily_pnl:d2",
    f"""SELECT portfolio_id, sum(cost_basis) AS cost_basis, sum(current_value) AS current_value, sum(unrealized_pnl) AS unrealized_pnl,
        sum(unrealized_pnl)/sum(cost_basis) AS unrealized_pnl_pct, sum(daily_pnl) AS daily_pnl FROM ({VALUED}) GROUP BY 1""",
)
def _(t: Tables):
    return m.portfolio_totals(m.value_positions(t.positions_by_customer, m.latest_two_closes(t.prices_daily)))


@register(
    "agg_26_total_tracked_value", "user_id:i total_value:d1",
    f"SELECT user_id, sum(current_value) AS total_value FROM ({VALUED}) GROUP BY 1",
)
def _(t: Tables):
    valued = m.value_positions(t.positions_by_customer, m.latest_two_closes(t.prices_daily))
    return m.portfolio_totals(valued, by=["user_id"]).withColumnRenamed("current_value", "total_value")


@register(
    "agg_27_latest_market_date", "symbol:s latest_date:t",
    """SELECT s.symbol, max(l_shipdate) AS latest_date FROM (SELECT DISTINCT 'B'||p_brand AS symbol, p_brand FROM part UNION ALL SELECT 'UNLISTED', NULL) s
       LEFT JOIN (SELECT p_brand, l_shipdate FROM lineitem JOIN part ON p_partkey=l_partkey) l ON l.p_brand=s.p_brand GROUP BY 1""",
)
def _(t: Tables):
    part = t.raw("part").select("p_partkey", F.concat(F.lit("B"), F.col("p_brand")).alias("symbol"))
    line = t.raw("lineitem").select("l_partkey", F.col("l_shipdate").alias("date"))
    prices = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    unlisted = t.spark.createDataFrame([("UNLISTED",)], "symbol string")
    return m.latest_dates(part.select("symbol").distinct().unionByName(unlisted), prices)


@register(
    "agg_28_return_histogram", "symbol:s bin:i start:d6 stop:d6 n:i",
    """WITH e AS (SELECT symbol, min(ret) AS lo, max(ret) AS hi, (max(ret)-min(ret))/18 AS w FROM rd1 GROUP BY 1),
       b AS (SELECT r.symbol, least(17, greatest(0, CAST(floor((ret-lo)/w) AS BIGINT))) AS bin, count(*) AS n FROM rd1 r JOIN e ON e.symbol=r.symbol GROUP BY 1,2)
       SELECT e.symbol, g.bin, lo+g.bin*w AS start, lo+g.bin*w+w AS stop, coalesce(n,0) AS n FROM e, (SELECT unnest(generate_series(0,17)) AS bin) g
       LEFT JOIN b ON b.symbol=e.symbol AND b.bin=g.bin""",
)
def _(t: Tables):
    return m.histogram(returns.simple_returns(t.prices_daily), "ret", 18, by=["symbol"])


@register(
    "agg_30_usage_rollup", "agent:s model:s calls:i tokens:i avg_latency:d4 errors:i cache_hits:i",
    """WITH l AS (SELECT role AS agent, 'm'||(conv_id%3) AS model, sha256(text) AS h, length(text) AS tokens, turn*10+5 AS lat,
         CASE WHEN turn%7=6 THEN 'error' ELSE 'ok' END AS status FROM conversations)
       SELECT agent, model, count(*) AS calls, sum(tokens) AS tokens, avg(lat) AS avg_latency, count(*) FILTER (status<>'ok') AS errors,
       count(*)-count(DISTINCT h) AS cache_hits FROM l GROUP BY 1,2""",
)
def _(t: Tables):
    log = t.raw("conversations").select(
        F.col("role").alias("agent"),
        F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string")).alias("model"),
        F.sha2("text", 256).alias("input_hash"),
        F.length("text").alias("tokens"),
        (F.col("turn") * 10 + 5).alias("latency_ms"),
        F.when(F.col("turn") % 7 == 6, "error").otherwise("ok").alias("status"),
    )
    return m.usage_rollup(log)


@register(
    "agg_31_first_seen_symbols", "symbol:s first_pos:i",
    "SELECT p_brand AS symbol, min(p_partkey) AS first_pos FROM part GROUP BY 1",
)
def _(t: Tables):
    return m.first_seen_order(t.raw("part").withColumnRenamed("p_brand", "symbol"), "symbol", "p_partkey")
