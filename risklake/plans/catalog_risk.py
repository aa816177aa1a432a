"""Registered queries: correlation monitor, regimes, VaR replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from risklake.operators import align, correlation as cor, regimes as reg, returns, var_backtest as vb
from risklake.plans.registry import register
from risklake.session import materialise
from risklake.sources.testdata import Tables

UP = "ROWS UNBOUNDED PRECEDING"
PAIRS = [
    ("ECONOMY", "LARGE", "Economy vs Large"), ("ECONOMY", "MEDIUM", "Economy vs Medium"), ("ECONOMY", "PROMO", "Economy vs Promo"),
    ("ECONOMY", "SMALL", "Economy vs Small"), ("ECONOMY", "STANDARD", "Economy vs Standard"), ("SMALL", "MEDIUM", "Small vs Medium"),
]
EPISODES = [("first slump", "1996-01-01", "1996-12-31"), ("middle slump", "1998-03-01", "1999-02-28"), ("short", "2000-01-01", "2000-02-15")]
_PAIR_ROWS = ", ".join(f"('{a}_{b}','{a}','{b}','{c}')" for a, b, c in PAIRS)


def legs_sql(src: str) -> str:
    return f"""SELECT * FROM (SELECT pair_key, label, date, a/lag(a) OVER (PARTITION BY pair_key ORDER BY date)-1 AS a, b/lag(b) OVER (PARTITION BY pair_key ORDER BY date)-1 AS b
        FROM (SELECT pair_key, label, x.date, x.price AS a, y.price AS b FROM (VALUES {_PAIR_ROWS}) p(pair_key, sa, sb, label)
        JOIN {src} x ON x.symbol=sa JOIN {src} y ON y.symbol=sb AND y.date=x.date)) WHERE a IS NOT NULL"""


def roll_sql(n: int, by: str = "pair_key") -> str:
    f = f"OVER (PARTITION BY {by} ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(*) {f} = {n} THEN corr(a,b) {f} END"


def head_sql(src: str, n: int, by: str = "pair_key") -> str:
    """Headline of one window: last n rows, Pearson and average-rank Spearman."""
    return f"""SELECT {by}, {n} AS "window", corr(a,b) AS pearson, corr(ra,rb) AS spearman, count(*) AS n_obs, max(date) AS as_of FROM (
        SELECT {by}, date, a, b, rank() OVER (PARTITION BY {by} ORDER BY a)+(count(*) OVER (PARTITION BY {by}, a)-1)/2 AS ra,
        rank() OVER (PARTITION BY {by} ORDER BY b)+(count(*) OVER (PARTITION BY {by}, b)-1)/2 AS rb FROM (SELECT * FROM {src}
        QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY date DESC) <= {n} AND count(*) OVER (PARTITION BY {by}) >= {max(n, 20)})) GROUP BY 1"""


@register(
    "cor_01_rolling_pearson", "pair_key:s window:i date:t corr:d4",
    f"""WITH l AS ({legs_sql('pdaily')}) """
    + " UNION ALL ".join(
        f"""SELECT * FROM (SELECT pair_key, {n} AS "window", date, {roll_sql(n)} AS corr FROM l) WHERE corr IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY pair_key ORDER BY date DESC) <= 252""" for n in (30, 60, 90)
    ),
    store="prices_daily",
)
def _(t: Tables):
    return cor.rolling_correlation(cor.pair_returns(t.prices_daily, cor.pairs_frame(t.spark, PAIRS)))


_HEADS = f"WITH l AS ({legs_sql('pdaily')}) " + " UNION ALL ".join(head_sql("l", n) for n in (30, 60, 90))
for _name, _cols in {
    "cor_02_headline_pearson": "pair_key:s window:i pearson:d6 n_obs:i as_of:t",
    "cor_03_headline_spearman": "pair_key:s window:i spearman:d6",
}.items():
    register(_name, _cols, _HEADS)(
        lambda t: cor.headline_correlation(cor.pair_returns(t.prices_daily, cor.pairs_frame(t.spark, PAIRS)))
    )


@register(
    "cor_04_snapshot_batch", "pair_key:s label:s window:i pearson:d6 spearman:d6 n_obs:i as_of:t n_points:i last_corr:d6 data_source:s",
    f"""WITH l AS ({legs_sql('pdaily')}), h AS ({" UNION ALL ".join(head_sql("l", n) for n in (30, 60, 90))}),
        s AS ({" UNION ALL ".join(f'''SELECT pair_key, {n} AS w, date, {roll_sql(n)} AS c FROM l''' for n in (30, 60, 90))}),
        k AS (SELECT pair_key, w, least(252, count(*)) AS n_points, arg_max(c, date) AS last_corr FROM s WHERE c IS NOT NULL GROUP BY 1,2)
        SELECT h.*, lb.label, k.n_points, k.last_corr, 'line items' AS data_source FROM h JOIN k ON k.pair_key=h.pair_key AND k.w=h."window"
        JOIN (SELECT DISTINCT pair_key, label FROM l) lb ON lb.pair_key=h.pair_key""",
    store="prices_daily",
)
def _(t: Tables):
    snap = cor.snapshot_batch(t.prices_daily, cor.pairs_frame(t.spark, PAIRS), "line items")
    return snap.withColumn("n_points", F.size("series")).withColumn("last_corr", F.element_at("series", -1)["corr"])


@register(
    "cor_05_snapshot_regroup", "pair_key:s n_windows:i pearson_30:d6 spearman_90:d6 as_of:t data_source:s",
    f"""WITH l AS ({legs_sql('pdaily')}), h AS ({" UNION ALL ".join(head_sql("l", n) for n in (30, 60, 90))})
        SELECT pair_key, count(*) AS n_windows, max(pearson) FILTER ("window"=30) AS pearson_30, max(spearman) FILTER ("window"=90) AS spearman_90,
        max(as_of) AS as_of, 'line items' AS data_source FROM h GROUP BY 1""",
    store="prices_daily",
)
def _(t: Tables):
    g = cor.regroup_snapshots(cor.snapshot_batch(t.prices_daily, cor.pairs_frame(t.spark, PAIRS), "line items"))
    return g.select(
        "*", F.size("windows").alias("n_windows"), F.col("windows")[30]["pearson"].alias("pearson_30"),
        F.col("windows")[90]["spearman"].alias("spearman_90"),
    )


_BLEND = f"""SELECT *, eq/max(eq) OVER (PARTITION BY {{k}} ORDER BY date {UP})-1 AS dd FROM (SELECT *, product(1+0.6e0*a+0.4e0*b) OVER
    (PARTITION BY {{k}} ORDER BY date {UP}) AS eq FROM {{src}})"""


@register(
    "cor_06_historical_replay", "pair_key:s date:t corr:d4 dd_pct:d4",
    f"""WITH l AS ({legs_sql('pw')}), d AS ({_BLEND.format(k='pair_key', src='l')})
        SELECT pair_key, date, c AS corr, dd*100 AS dd_pct FROM (SELECT *, {roll_sql(60)} AS c, row_number() OVER (PARTITION BY pair_key ORDER BY date)-1 AS i,
        count(*) OVER (PARTITION BY pair_key) AS n FROM d) WHERE n>=250 AND i%5=0 AND c IS NOT NULL""",
)
def _(t: Tables):
    return cor.historical_replay(cor.pair_returns(t.prices_weekly, cor.pairs_frame(t.spark, PAIRS)))


_EP_ROWS = ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in EPISODES)
EPISODE_SQL = f"""WITH l AS ({legs_sql('pw')}), t AS (SELECT l.*, ep FROM l JOIN (VALUES {_EP_ROWS}) e(ep, st, en) ON date BETWEEN st AND en),
    d AS ({_BLEND.format(k='pair_key, ep', src='t')})
    SELECT pair_key, ep AS episode, corr(a,b) AS corr, min(dd)*100 AS drawdown_pct, (product(1+0.6e0*a+0.4e0*b)-1)*100 AS return_pct, count(*) AS n_obs
    FROM d GROUP BY 1,2 HAVING count(*)>=20"""


@register("cor_07_episode_statistics", "pair_key:s episode:s corr:d6 drawdown_pct:d4 return_pct:d4 n_obs:i", EPISODE_SQL)
def _(t: Tables):
    return cor.episode_statistics(cor.pair_returns(t.prices_weekly, cor.pairs_frame(t.spark, PAIRS)), EPISODES)


@register(
    "join_13_episode_range_join", "pair_key:s episode:s n_obs:i",
    f"SELECT pair_key, ep AS episode, count(*) AS n_obs FROM ({legs_sql('pdaily')}) JOIN (VALUES {_EP_ROWS}) e(ep, st, en) ON date BETWEEN st AND en GROUP BY 1,2",
)
def _(t: Tables):
    legs = cor.pair_returns(t.prices_daily, cor.pairs_frame(t.spark, PAIRS))
    return cor.episode_statistics(legs, EPISODES)


_TICKERS = ["SPY", "AGG", "GLD", "BTC-USD", "ACME", "XLB", "TLT", "VOD.L", "LQD", "EFA"]
_TICKER_LIST = "[" + ", ".join(f"'{x}'" for x in _TICKERS) + "]"


def _tagged_parts(t: Tables):
    return t.raw("part").join(t.assets.select(F.col("symbol").alias("p_type"), "asset_class", "asset_type"), "p_type").select(
        "p_partkey", F.element_at(F.array(*[F.lit(x) for x in _TICKERS]), (F.col("p_partkey") % 10 + 1).cast("int")).alias("ticker"),
        "asset_class", "asset_type", "p_brand",
    )


@register(
    "cor_08_sleeve_classification", "p_partkey:i ticker:s sleeve:s",
    f"""SELECT p_partkey, ticker, CASE WHEN ticker IN ('AGG','TLT','LQD') THEN 'bond' WHEN ticker IN ('SPY','EFA') THEN 'equity' WHEN ticker='GLD' THEN 'commodity'
        WHEN ticker LIKE '%-USD' THEN 'crypto' WHEN asset_class='BOND_ETF' THEN 'bond' WHEN asset_class='COMMODITY' THEN 'commodity' ELSE 'equity' END AS sleeve
        FROM (SELECT p_partkey, {_TICKER_LIST}[p_partkey%10+1] AS ticker, asset_class FROM part JOIN assets ON symbol=p_type)""",
)
def _(t: Tables):
    return _tagged_parts(t).withColumn("sleeve", cor.sleeve_of(F.col("ticker"), F.col("asset_class")))


WATCH_SQL = f"""WITH h AS (SELECT portfolio_id, symbol, weight, CASE WHEN asset_type='BOND' THEN 'bond' WHEN asset_type='FUTURE' THEN 'commodity' ELSE 'equity' END AS sleeve FROM pos),
    m AS (SELECT portfolio_id, sum(CASE WHEN sleeve='equity' THEN weight ELSE 0 END)/sum(weight) AS ew, sum(CASE WHEN sleeve='bond' THEN weight ELSE 0 END)/sum(weight) AS bw FROM h GROUP BY 1),
    j AS (SELECT h.portfolio_id, sleeve, h.symbol, date, weight/sum(weight) OVER (PARTITION BY h.portfolio_id, sleeve, date) AS share,
      price/lag(price) OVER (PARTITION BY h.portfolio_id, sleeve, h.symbol ORDER BY date)-1 AS r FROM (SELECT n.*, date, price FROM (SELECT *, count(*) OVER (PARTITION BY portfolio_id, sleeve) AS nh FROM h) n JOIN pw ON pw.symbol=n.symbol
        QUALIFY count(*) OVER (PARTITION BY n.portfolio_id, sleeve, date) = nh) h JOIN m ON m.portfolio_id=h.portfolio_id WHERE ew>=0.05 AND bw>=0.05),
    s AS (SELECT portfolio_id, sleeve, date, 100*product(1+r) OVER (PARTITION BY portfolio_id, sleeve ORDER BY date {UP}) AS price FROM
      (SELECT portfolio_id, sleeve, date, sum(share*r) AS r FROM j WHERE r IS NOT NULL GROUP BY 1,2,3)),
    l AS (SELECT portfolio_id, date, pa/lag(pa) OVER (PARTITION BY portfolio_id ORDER BY date)-1 AS a, pb/lag(pb) OVER (PARTITION BY portfolio_id ORDER BY date)-1 AS b
      FROM (SELECT portfolio_id, date, max(price) FILTER (sleeve='equity') AS pa, max(price) FILTER (sleeve='bond') AS pb FROM s GROUP BY 1,2) WHERE pa IS NOT NULL AND pb IS NOT NULL QUALIFY a IS NOT NULL),
    sh AS ({head_sql('l', 60, 'portfolio_id')}), ba AS ({head_sql('l', 252, 'portfolio_id')})
    SELECT m.portfolio_id, ew AS equity_weight, bw AS bond_weight, CASE WHEN sh.pearson IS NOT NULL THEN 'ok' ELSE 'na' END AS status,
      CASE WHEN NOT (ew>=0.05 AND bw>=0.05) THEN 'needs both sleeves' WHEN sh.pearson IS NULL THEN 'insufficient history' END AS reason,
      sh.pearson AS short_corr, ba.pearson AS baseline_corr, sh.pearson-ba.pearson AS delta, sh.n_obs, sh.as_of
    FROM m LEFT JOIN sh ON sh.portfolio_id=m.portfolio_id LEFT JOIN ba ON ba.portfolio_id=m.portfolio_id"""


def regime_watch(t: Tables):
    sleeve = F.when(F.col("asset_type") == "BOND", "bond").when(F.col("asset_type") == "FUTURE", "commodity").otherwise("equity")
    return cor.portfolio_regime_watch(t.positions.withColumn("sleeve", sleeve), t.prices_weekly)


register(
    "cor_09_portfolio_regime_watch",
    "portfolio_id:i equity_weight:d6 bond_weight:d6 status:s reason:s short_corr:d6 baseline_corr:d6 delta:d6 n_obs:i as_of:t", WATCH_SQL,
    store="prices_weekly positions",
)(regime_watch)


# ---- regimes ------------------------------------------------------------------------
_CLASS_SQL = """CASE WHEN asset_type='CRYPTO' OR ticker LIKE '%-USD' THEN 'crypto' WHEN asset_type='BOND' OR ticker='TLT' THEN 'bond_treasury'
    WHEN ticker IN ('LQD','AGG') THEN 'bond_credit' WHEN ticker='GLD' THEN 'commodity' WHEN asset_type='ETF' THEN
    CASE WHEN ticker IN ('SPY','EFA') THEN 'etf_broad' ELSE 'etf_sector' END WHEN asset_type='FUTURE' THEN 'commodity'
    WHEN ticker LIKE '%.L' THEN 'equity_intl' ELSE 'equity_us' END"""


@register(
    "reg_01_ticker_class", "p_partkey:i ticker:s regime_class:s",
    f"""SELECT p_partkey, ticker, {_CLASS_SQL} AS regime_class FROM (SELECT p_partkey, {_TICKER_LIST}[p_partkey%10+1] AS ticker, asset_type
        FROM part JOIN assets ON symbol=p_type)""",
)
def _(t: Tables):
    return _tagged_parts(t).withColumn("regime_class", reg.regime_class(F.col("ticker"), F.col("asset_type"), F.col("p_brand")))


_RATIO = """SELECT symbol, date, stddev_samp(r) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) /
    stddev_samp(r) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 125 PRECEDING AND CURRENT ROW) AS ratio FROM (SELECT symbol, date,
    ln(price/lag(price) OVER (PARTITION BY symbol ORDER BY date)) AS r FROM pdaily) WHERE r IS NOT NULL
    QUALIFY count(*) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 125 PRECEDING AND CURRENT ROW) = 126"""


@register("reg_02_volatility_ratio", "symbol:s date:t ratio:d6", _RATIO)
def _(t: Tables):
    return reg.volatility_ratios(t.prices_daily)


_CALIB = f"""SELECT asset_class, round_even(quantile_cont(ratio,0.9),3) AS high, round_even(quantile_cont(ratio,0.1),3) AS low FROM ({_RATIO}) r
    JOIN assets a ON a.symbol=r.symbol GROUP BY 1"""


@register("reg_03_threshold_calibration", "asset_class:s high:d3 low:d3", _CALIB, store="prices_daily")
def _(t: Tables):
    return reg.calibrate_thresholds(t.prices_daily, t.assets.select("symbol", "asset_class"))


@register(
    "reg_03_threshold_history", "asset_class:s high:d3 low:d3 is_active:b calibrated_at:ts",
    f"""WITH f AS ({_CALIB}), s(asset_class, high, low) AS (VALUES ('US_EQUITY',1.55,0.7),('BOND_ETF',1.7,0.6),('crypto',1.4,0.65),('default',1.5,0.8))
        SELECT asset_class, high, low, asset_class NOT IN (SELECT asset_class FROM f) AS is_active, TIMESTAMP '2024-01-01 00:00:00' AS calibrated_at FROM s
        UNION ALL SELECT asset_class, high, low, true, TIMESTAMP '2024-06-01 00:00:00' FROM f""",
    store="prices_daily",
)
def _(t: Tables):
    return _threshold_history(t)


def _threshold_history(t: Tables):
    old = t.spark.createDataFrame(
        [("US_EQUITY", 1.55, 0.7), ("BOND_ETF", 1.7, 0.6), ("crypto", 1.4, 0.65), ("default", 1.5, 0.8)],
        "asset_class string, high double, low double",
    ).select("*", F.lit(True).alias("is_active"), F.lit("2024-01-01").cast("timestamp").alias("calibrated_at"))
    fresh = reg.calibrate_thresholds(t.prices_daily, t.assets.select("symbol", "asset_class"))
    return materialise(reg.supersede_thresholds(old, fresh, "2024-06-01"), "thresholds")


_THR = f"""SELECT asset_class, high, low FROM ({_CALIB}) UNION ALL SELECT * FROM (VALUES ('crypto',1.4,0.65),('default',1.5,0.8)) d(a,h,l)"""


@register(
    "join_18_threshold_lookup", "portfolio_id:i symbol:s high:d3 low:d3",
    f"""WITH t AS ({_THR}) SELECT portfolio_id, h.symbol, coalesce(high,1.5) AS high, coalesce(low,0.8) AS low FROM posc h
        JOIN (SELECT symbol, CASE WHEN asset_class='COMMODITY' THEN 'unlisted' ELSE asset_class END AS c FROM assets) a ON a.symbol=h.symbol LEFT JOIN t ON t.asset_class=a.c""",
    store="prices_daily",
)
def _(t: Tables):
    c = F.when(F.col("asset_class") == "COMMODITY", "unlisted").otherwise(F.col("asset_class"))
    held = t.positions_by_customer.join(t.assets.select("symbol", c.alias("asset_class")), "symbol")
    return reg.with_thresholds(held, _threshold_history(t))


_PTHR = f"""SELECT portfolio_id, sum(weight*high)/sum(weight) AS high, sum(weight*low)/sum(weight) AS low FROM {{pos}} h JOIN assets a ON a.symbol=h.symbol
    JOIN ({_CALIB}) t ON t.asset_class=a.asset_class WHERE weight>0 GROUP BY 1"""


@register(
    "reg_04_portfolio_thresholds", "portfolio_id:i asset_class:s share:d6 high:d6 low:d6",
    f"""SELECT m.portfolio_id, m.asset_class, m.share, high, low FROM (SELECT portfolio_id, asset_class, sum(weight) AS share FROM posc h
        JOIN assets a ON a.symbol=h.symbol GROUP BY 1,2) m JOIN ({_PTHR.format(pos='posc')}) p ON p.portfolio_id=m.portfolio_id""",
    store="prices_daily",
)
def _(t: Tables):
    held = t.positions_by_customer.join(t.assets.select("symbol", "asset_class"), "symbol")
    return reg.class_mix(held).join(reg.portfolio_thresholds(held, _threshold_history(t)), "portfolio_id")


@register(
    "reg_05_portfolio_regime", "portfolio_id:i vol_ratio:d6 drawdown:d6 high:d6 low:d6 regime:s",
    f"""WITH x AS (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY date DESC) AS rn,
          stddev_samp(ret) OVER (PARTITION BY portfolio_id ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) /
          stddev_samp(ret) OVER (PARTITION BY portfolio_id ORDER BY date ROWS BETWEEN 125 PRECEDING AND CURRENT ROW) AS q FROM ixw),
        a AS (SELECT portfolio_id, quantile_cont(q,0.5) FILTER (rn<=5) AS r, max(price) FILTER (rn=1)/max(price) FILTER (rn<=60)-1 AS dd FROM x GROUP BY 1)
        SELECT a.portfolio_id, r AS vol_ratio, dd AS drawdown, high, low, CASE WHEN dd < -0.1 THEN 'Drawdown' WHEN r>high THEN 'High_Vol' WHEN r<low THEN 'Low_Vol'
        ELSE 'Normal' END AS regime FROM a JOIN ({_PTHR.format(pos='pos')}) t ON t.portfolio_id=a.portfolio_id""",
    store="prices_daily positions",
)
def _(t: Tables):
    index = returns.price_index(returns.portfolio_returns(t.positions, t.prices_weekly))
    held = t.positions.join(t.assets.select("symbol", "asset_class"), "symbol")
    return reg.portfolio_regime(index, reg.portfolio_thresholds(held, _threshold_history(t)))


@register(
    "reg_06_walk_forward_tags", "symbol:s date:t fold_tag:s training_tag:s",
    """SELECT symbol, date, CASE WHEN n<63 THEN 'Normal' WHEN p>1.5 THEN 'High_Vol' WHEN p<0.8 THEN 'Low_Vol' ELSE 'Normal' END AS fold_tag,
       CASE WHEN c<63 THEN NULL WHEN s>1.5 THEN 'High_Vol' WHEN s<0.8 THEN 'Low_Vol' ELSE 'Normal' END AS training_tag FROM (SELECT symbol, date,
       row_number() OVER w AS n, count(r) OVER f63 AS c, stddev_pop(r) OVER f21/stddev_pop(r) OVER f63 AS p, stddev_samp(r) OVER f21/stddev_samp(r) OVER f63 AS s
       FROM (SELECT *, ln(price/lag(price) OVER (PARTITION BY symbol ORDER BY date)) AS r FROM pdaily)
       WINDOW w AS (PARTITION BY symbol ORDER BY date), f21 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW),
       f63 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW))""",
)
def _(t: Tables):
    return reg.walk_forward_tags(t.prices_daily)


# ---- VaR replay -----------------------------------------------------------------------
_F252 = "(PARTITION BY portfolio_id ORDER BY date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)"


def var_sql(h: int = 1) -> str:
    """Every scored row with its realised return and both closed-form predictions."""
    fwd = f"(PARTITION BY portfolio_id ORDER BY date ROWS BETWEEN CURRENT ROW AND {h - 1} FOLLOWING)"
    return f"""SELECT portfolio_id, date, rn, realized, hist*sqrt({h}) AS hist, mu*{h}+sd*sqrt({h})*(-1.6448536269514729e0) AS par FROM (SELECT portfolio_id, date,
        row_number() OVER (PARTITION BY portfolio_id ORDER BY date)-1 AS rn, count(*) OVER (PARTITION BY portfolio_id) AS n,
        product(1+ret) OVER {fwd}-1 AS realized, quantile_cont(ret, 0.05) OVER {_F252} AS hist, avg(ret) OVER {_F252} AS mu, stddev_pop(ret) OVER {_F252} AS sd
        FROM prd) WHERE n >= {252 + h + 30} AND rn >= greatest(252, n-250) AND rn <= n-{h}"""


def _replay(t: Tables, horizon: int = 1):
    return vb.replay_window(returns.portfolio_returns(t.positions, t.prices_daily), horizon=horizon)


@register("var_01_historical", "portfolio_id:i date:t realized:d6 var:d6", f"SELECT portfolio_id, date, realized, hist AS var FROM ({var_sql()})")
def _(t: Tables):
    return vb.historical_var(_replay(t))


@register("var_02_parametric", "portfolio_id:i date:t realized:d6 var:d6", f"SELECT portfolio_id, date, realized, par AS var FROM ({var_sql()})")
def _(t: Tables):
    return vb.parametric_var(_replay(t))


def _u(*keys: str) -> str:
    text = "||'|'||".join(["'42'", *keys])
    return f"(CAST('0x'||substr(md5({text}),1,13) AS BIGINT)+0.5e0)/4503599627370496e0"


BOOT_SQL = f"""WITH p AS (SELECT portfolio_id, date, ret, row_number() OVER (PARTITION BY portfolio_id ORDER BY date)-1 AS rn, count(*) OVER (PARTITION BY portfolio_id) AS n FROM prd),
    b AS (SELECT portfolio_id, date, ret, n, rn - (greatest(252, n-250)-252) AS seq, rn FROM p WHERE n>=283),
    d AS (SELECT portfolio_id, date, ret AS realized, rn, rn-1-CAST(floor({_u('portfolio_id', 'rn', 'sim', '0')}*252) AS BIGINT) AS src FROM b,
      (SELECT unnest(generate_series(0,399)) AS sim) WHERE rn >= greatest(252, n-250) AND rn <= n-1)
    SELECT d.portfolio_id, d.date, any_value(realized) AS realized, quantile_cont(s.ret, 0.05) AS var FROM d JOIN p s ON s.portfolio_id=d.portfolio_id AND s.rn=d.src GROUP BY 1,2"""


@register("var_03_joint_bootstrap", "portfolio_id:i date:t realized:d6 var:d6", BOOT_SQL)
def _(t: Tables):
    return vb.bootstrap_var(materialise(_replay(t), "var-replay"), n_sims=400)


@register(
    "var_04_forward_return_10d", "portfolio_id:i date:t realized:d4 var:d6",
    f"SELECT portfolio_id, date, realized, hist AS var FROM ({var_sql(10)})",
)
def _(t: Tables):
    return vb.historical_var(_replay(t, 10), horizon=10)


def _erfc(x: str) -> str:
    coef = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    tt = f"(1e0/(1e0+0.5e0*({x})))"
    poly = f"{coef[-1]}e0"
    for c in reversed(coef[:-1]):
        poly = f"({c}e0+{tt}*{poly})"
    return f"({tt}*exp(-({x})*({x})+{poly}))"


def tests_sql(scored: str, keys: str = "portfolio_id, method") -> str:
    xl = "CASE WHEN {a}=0 THEN 0 ELSE {a}*ln({b}) END"
    return f"""SELECT *, {_erfc('sqrt(kupiec_stat/2)')} AS kupiec_p, {_erfc('sqrt(independence_stat/2)')} AS independence_p, exp(-coverage_stat/2) AS coverage_p,
        kupiec_stat>3.841458820694124 AS kupiec_reject, coverage_stat>5.991464547107979 AS coverage_reject,
        kupiec_stat<=3.841458820694124 AND coverage_stat<=5.991464547107979 AS model_passes,
        CASE WHEN basel_cdf<0.95 THEN 'green' WHEN basel_cdf<0.9999 THEN 'yellow' ELSE 'red' END AS basel_zone FROM (SELECT *, kupiec_stat+independence_stat AS coverage_stat FROM (SELECT *, x/n AS breach_rate, n*0.05 AS expected_exceptions,
        greatest(0, -2*(x*ln(0.05e0)+(n-x)*ln(0.95e0)-({xl.format(a='x', b='x/n')})-({xl.format(a='(n-x)', b='(1-x/n)')}))) AS kupiec_stat,
        greatest(0, -2*(({xl.format(a='(n01+n11)', b='((n01+n11)/(n00+n01+n10+n11))')})+({xl.format(a='(n00+n10)', b='(1-(n01+n11)/(n00+n01+n10+n11))')})
          -({xl.format(a='n01', b='(n01/(n00+n01))')})-({xl.format(a='n00', b='(1-n01/(n00+n01))')})
          -({xl.format(a='n11', b='(n11/(n10+n11))')})-({xl.format(a='n10', b='(1-n11/(n10+n11))')}))) AS independence_stat,
        (SELECT sum(exp(lgamma(n+1e0)-lgamma(k+1e0)-lgamma(n-k+1e0)+k*ln(0.05e0)+(n-k)*ln(0.95e0))) FROM (SELECT unnest(generate_series(0, CAST(x AS BIGINT))) AS k)) AS basel_cdf
        FROM (SELECT {keys}, count(*) AS n, count(*) FILTER (br) AS x, avg(realized) FILTER (br) AS expected_shortfall, count(*) FILTER (NOT pv AND NOT br) AS n00,
        count(*) FILTER (NOT pv AND br) AS n01, count(*) FILTER (pv AND NOT br) AS n10, count(*) FILTER (pv AND br) AS n11 FROM (SELECT *, lag(br) OVER
        (PARTITION BY {keys} ORDER BY date) AS pv FROM (SELECT *, realized<var AS br FROM ({scored}) WHERE var IS NOT NULL)) GROUP BY {keys})))"""


_BOTH = f"""SELECT portfolio_id, 'historical' AS method, date, realized, hist AS var FROM ({var_sql()})
    UNION ALL SELECT portfolio_id, 'parametric', date, realized, par FROM ({var_sql()})"""


def _both(t: Tables):
    return vb.closed_form_var(_replay(t))


for _name, _cols in {
    "var_05_breach_counts": "portfolio_id:i method:s n:i x:i breach_rate:d6 expected_exceptions:d4",
    "var_06_kupiec": "portfolio_id:i method:s kupiec_stat:d5 kupiec_p:d5 kupiec_reject:b",
    "var_07_christoffersen": "portfolio_id:i method:s n00:i n01:i n10:i n11:i independence_stat:d5 independence_p:d5 coverage_stat:d5 coverage_p:d5 coverage_reject:b model_passes:b",
    "var_08_basel_zone": "portfolio_id:i method:s basel_cdf:d5 basel_zone:s",
    "var_09_expected_shortfall": "portfolio_id:i method:s expected_shortfall:d6",
}.items():
    register(_name, _cols, tests_sql(_BOTH))(lambda t: vb.coverage_tests(_both(t)).withColumnRenamed("exceptions", "x"))


@register(
    "var_11_method_comparison", "portfolio_id:i method:s n:i exceptions:i breach_rate:d6 kupiec_p:d5 coverage_p:d5 basel_zone:s model_passes:b recommended:b",
    f"""WITH bt AS ({BOOT_SQL}), s AS ({_BOTH} UNION ALL SELECT portfolio_id, 'bootstrap', date, realized, var FROM bt),
        k AS (SELECT *, x AS exceptions, row_number() OVER (PARTITION BY portfolio_id ORDER BY CASE WHEN model_passes THEN 0 ELSE 1 END, round(abs(breach_rate-0.05),12),
        CASE method WHEN 'historical' THEN 1 WHEN 'parametric' THEN 2 ELSE 3 END) AS o FROM ({tests_sql('SELECT * FROM s')}) WHERE n>=30)
        SELECT *, model_passes AND o=1 AS recommended FROM k""",
)
def _(t: Tables):
    # three readers of one replay table: write it once instead of deriving it three times
    r = materialise(_replay(t), "var-replay")
    scored = vb.closed_form_var(r).unionByName(vb.bootstrap_var(r, n_sims=400), allowMissingColumns=True)
    return vb.compare_methods(scored, ["historical", "parametric", "bootstrap"])


@register(
    "var_12_asof_value_weights", "portfolio_id:i symbol:s date:t value:d1",
    """SELECT portfolio_id, symbol, date, CASE WHEN purchase_date<=date THEN quantity*coalesce(pp,0) ELSE 0 END AS value FROM (
       SELECT h.portfolio_id, h.symbol, h.quantity, h.purchase_date, d.date, (SELECT arg_max(price, x.date) FROM pw x WHERE x.symbol=h.symbol AND x.date<d.date) AS pp
       FROM pos h JOIN (SELECT CAST(n_nationkey AS BIGINT) AS portfolio_id, DATE '1995-01-02'+CAST(35*unnest(generate_series(0,60)) AS INTEGER) AS date FROM nation) d ON d.portfolio_id=h.portfolio_id)""",
)
def _(t: Tables):
    offsets = F.sequence(F.lit(0), F.lit(60))
    dates = t.raw("nation").select(
        F.col("n_nationkey").cast("long").alias("portfolio_id"), F.explode(offsets).alias("k")
    ).select("portfolio_id", F.date_add(F.lit("1995-01-02").cast("date"), 35 * F.col("k")).alias("date"))
    return vb.asof_value_weights(t.positions, t.prices_weekly, dates)
