"""Registered queries: technical indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from risklake.operators import indicators as ind
from risklake.plans.registry import register
from risklake.sources.testdata import Tables

WS = "PARTITION BY symbol ORDER BY date"


def frame(n: int) -> str:
    return f"({WS} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def gated(expr: str, n: int, x: str = "price") -> str:
    return f"CASE WHEN count({x}) OVER {frame(n)} = {n} THEN {expr} OVER {frame(n)} END"


def ema_sql(x: str, k: str) -> str:
    """The recursion itself, as a fold over all rows so far: independent of the Spark form."""
    return f"list_reduce(list({x}) OVER ({WS} ROWS UNBOUNDED PRECEDING), lambda e, v: {k}*v + (1e0-{k})*e)"


LR = f"(SELECT *, ln(price/lag(price) OVER ({WS})) AS r FROM {{src}})"
SR = f"(SELECT *, price/lag(price) OVER ({WS})-1 AS r FROM {{src}})"


@register("ind_01_sma", "symbol:s date:t sma:d4", f"SELECT symbol, date, {gated('avg(price)', 20)} AS sma FROM pdaily")
def _(t: Tables):
    return t.prices_daily.withColumn("sma", ind.sma("price", 20))


@register("ind_02_ema", "symbol:s date:t ema:d4", f"SELECT symbol, date, {ema_sql('price', '(2e0/27e0)')} AS ema FROM pw")
def _(t: Tables):
    return ind.with_ema_span(t.prices_weekly, "price", "ema", 26)


@register(
    "ind_03_macd", "symbol:s date:t macd:d4 signal:d4 histogram:d4",
    f"""SELECT symbol, date, m AS macd, {ema_sql('m', '0.2e0')} AS signal, m - {ema_sql('m', '0.2e0')} AS histogram FROM
        (SELECT symbol, date, {ema_sql('price', '(2e0/13e0)')} - {ema_sql('price', '(2e0/27e0)')} AS m FROM pw)""",
)
def _(t: Tables):
    return ind.macd(t.prices_weekly)


@register(
    "ind_04_rsi_simple", "symbol:s date:t rsi:d6",
    f"""SELECT symbol, date, CASE WHEN n < 14 OR (g=0 AND l=0) THEN 50 WHEN l=0 THEN 100 ELSE 100-100/(1+g/l) END AS rsi FROM (
        SELECT symbol, date, count(*) OVER {frame(14)} AS n, avg(greatest(d,0)) OVER {frame(14)} AS g,
        avg(greatest(-d,0)) OVER {frame(14)} AS l FROM (SELECT *, coalesce(price-lag(price) OVER ({WS}),0) AS d FROM pdaily))""",
)
def _(t: Tables):
    return ind.rsi_simple(t.prices_daily)


@register(
    "ind_05_rsi_wilder", "symbol:s date:t rsi:d6",
    f"""WITH d AS (SELECT *, row_number() OVER ({WS})-1 AS i, price-lag(price) OVER ({WS}) AS d FROM pw),
        s AS (SELECT symbol, date, i, CASE WHEN i=14 THEN avg(greatest(d,0)) OVER {frame(14)} ELSE greatest(d,0) END AS g,
              CASE WHEN i=14 THEN avg(greatest(-d,0)) OVER {frame(14)} ELSE greatest(-d,0) END AS l FROM d),
        e AS (SELECT symbol, date, i, {ema_sql('g', '(1e0/14e0)')} AS g, {ema_sql('l', '(1e0/14e0)')} AS l FROM s WHERE i >= 14)
        SELECT d.symbol, d.date, CASE WHEN d.i > 14 THEN CASE WHEN l=0 THEN 100 ELSE 100-100/(1+g/l) END END AS rsi
        FROM d LEFT JOIN e ON e.symbol=d.symbol AND e.date=d.date""",
)
def _(t: Tables):
    return ind.rsi_wilder(t.prices_weekly)


for _name, _pop, _fn in (("ind_06_bollinger_sample", False, "stddev_samp"), ("ind_07_bollinger_population", True, "stddev_pop")):
    register(
        _name, "symbol:s date:t mid:d4 upper:d4 lower:d4",
        f"""SELECT symbol, date, {gated('avg(price)', 20)} AS mid,
            CASE WHEN count(price) OVER {frame(20)}=20 THEN avg(price) OVER {frame(20)} + 2*{_fn}(price) OVER {frame(20)} END AS upper,
            CASE WHEN count(price) OVER {frame(20)}=20 THEN avg(price) OVER {frame(20)} - 2*{_fn}(price) OVER {frame(20)} END AS lower
            FROM pdaily""",
    )(lambda t, pop=_pop: ind.bollinger(t.prices_daily, population=pop))

_VOL21 = f"""(SELECT symbol, date, price, first_value(v IGNORE NULLS) OVER ({WS} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS vol
    FROM (SELECT symbol, date, price, {gated('stddev_samp(r)', 21, 'r')}*sqrt(252) AS v FROM {SR.format(src='pdaily')}))"""


@register(
    "ind_08_atr", "symbol:s date:t high:d4 low:d4 true_range:d4 atr:d4",
    f"""SELECT symbol, date, high, low, tr AS true_range, {gated('avg(tr)', 14, 'tr')} AS atr FROM (
        SELECT *, greatest(high-low, abs(high-lag(price) OVER ({WS})), abs(low-lag(price) OVER ({WS}))) AS tr FROM (
        SELECT *, price*(1+vol/15.87*0.625) AS high, price*(1-vol/15.87*0.625) AS low FROM {_VOL21}))""",
)
def _(t: Tables):
    return ind.atr(t.prices_daily)


@register("ind_09_realised_vol", "symbol:s date:t volatility:d6", f"SELECT symbol, date, vol AS volatility FROM {_VOL21}")
def _(t: Tables):
    return ind.realised_vol(t.prices_daily)


@register(
    "ind_10_rolling_log_vol", "symbol:s date:t vol_pct:d4",
    f"SELECT symbol, date, coalesce({gated('stddev_samp(r)', 21, 'r')}*sqrt(252)*100, 0) AS vol_pct FROM {LR.format(src='pdaily')}",
)
def _(t: Tables):
    return ind.rolling_log_vol(t.prices_daily)


@register(
    "ind_11_vwap", "symbol:s date:t vwap:d4",
    f"""SELECT symbol, date, sum(price*volume) OVER ({WS} ROWS UNBOUNDED PRECEDING)/sum(volume) OVER ({WS} ROWS UNBOUNDED PRECEDING)
        AS vwap FROM pdaily""",
)
def _(t: Tables):
    return ind.vwap(t.prices_daily)


@register(
    "ind_12_regime_features", "symbol:s date:t ret_5:d6 ret_21:d6 vol_21:d6 vol_63:d6 skew_63:d5 kurt_63:d5 mom_126:d6",
    f"""SELECT symbol, date, {gated('sum(r)', 5, 'r')} AS ret_5, {gated('sum(r)', 21, 'r')} AS ret_21,
        {gated('stddev_samp(r)', 21, 'r')} AS vol_21, {gated('stddev_samp(r)', 63, 'r')} AS vol_63,
        {gated('skewness(r)', 63, 'r')} AS skew_63, {gated('kurtosis(r)', 63, 'r')} AS kurt_63,
        {gated('sum(r)', 126, 'r')} AS mom_126 FROM {LR.format(src='pw')} QUALIFY mom_126 IS NOT NULL""",
)
def _(t: Tables):
    return ind.regime_features(t.prices_weekly)


_EWMA = f"""WITH l AS (SELECT symbol, date, r, r*r AS r2 FROM {LR.format(src='pw')} WHERE r IS NOT NULL
        QUALIFY count(*) OVER (PARTITION BY symbol) >= 100),
    s AS (SELECT symbol, date, sqrt({ema_sql('r2', '(1e0-0.94e0)')}) AS sigma, avg(r) OVER ({WS} ROWS UNBOUNDED PRECEDING) AS mu FROM l),
    f AS (SELECT *, sigma/({gated('quantile_cont(sigma,0.5)', 126, 'sigma')}) AS fragility FROM s)
    SELECT symbol, date, sigma, fragility, mu+sigma*(-1.6448536269514729e0) AS var_95, CASE WHEN fragility>1.5 THEN 'High_Fragility'
      WHEN fragility<0.8 THEN 'Low_Vol_Stable' WHEN fragility IS NOT NULL THEN 'Normal' END AS regime FROM f"""


@register("ind_13_ewma_risk", "symbol:s date:t sigma:d6 fragility:d6 var_95:d6 regime:s", _EWMA)
def _(t: Tables):
    return ind.ewma_risk(t.prices_weekly)


def _phase_sql(a: str) -> tuple[str, str]:
    change = f"(({a})[len({a})]-({a})[1])/(({a})[1]+1e-9)"
    direction = (
        f"CASE WHEN len({a})<2 THEN 'flat' WHEN {change}>0.01 THEN 'rallying' WHEN {change}<-0.01 THEN 'crashing' ELSE 'holding steady' END"
    )
    calm = f"CASE WHEN len({a})>0 AND list_avg({a})<>0 AND list_stddev_pop({a})/list_avg({a})>0.02 THEN 'unstable' ELSE 'calm' END"
    return direction, calm


_P = [_phase_sql(x) for x in ("p1", "p2", "p3")]


@register(
    "ind_14_series_description", "symbol:s date:t description:s",
    f"""SELECT symbol, date, 'The series started by '||{_P[0][0]}||' in a '||{_P[0][1]}||' manner. It then shifted to '||{_P[1][0]}||
        ', becoming '||{_P[1][1]}||'. Crucially, it is currently '||{_P[2][0]}||' with '||{_P[2][1]}||' conditions.' AS description
        FROM (SELECT symbol, date, a[1:len(a)//3] AS p1, a[len(a)//3+1:2*len(a)//3] AS p2, a[2*len(a)//3+1:len(a)] AS p3 FROM
        (SELECT symbol, date, list(price) OVER {frame(12)} AS a FROM pdaily))""",
)
def _(t: Tables):
    return ind.describe_series(t.prices_daily)


@register(
    "ind_15_min_max_scaling", "symbol:s date:t scaled:d6",
    """SELECT symbol, date, CASE WHEN max(price) OVER w = min(price) OVER w THEN 0 ELSE (price-min(price) OVER w)/
       (max(price) OVER w-min(price) OVER w) END AS scaled FROM pdaily WINDOW w AS (PARTITION BY symbol)""",
)
def _(t: Tables):
    return ind.min_max_scaled(t.prices_daily)


AR1_SQL = f"""WITH RECURSIVE rc AS (SELECT *, lag(price) OVER ({WS}) AS x FROM (SELECT * FROM pdaily
        QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 120)),
    ft AS (SELECT symbol, arg_max(price,date) AS last, greatest(-0.98,least(0.98,regr_slope(price,x))) AS phi, avg(x) AS mx,
        avg(CASE WHEN x IS NOT NULL THEN price END) AS my, min(price)-greatest(1e-6,0.1*(max(price)-min(price))) AS lo,
        max(price)+greatest(1e-6,0.1*(max(price)-min(price))) AS hi FROM rc GROUP BY 1),
    pth AS (SELECT symbol, 0 AS step, last AS price FROM ft UNION ALL
        SELECT pth.symbol, step+1, greatest(lo, least(hi, (my-phi*mx)+phi*price)) FROM pth JOIN ft ON ft.symbol=pth.symbol WHERE step < 20)
    SELECT symbol, step, price FROM pth WHERE step > 0"""


@register("ind_16_ar1_projection", "symbol:s step:i price:d4", AR1_SQL)
def _(t: Tables):
    return ind.ar1_projection(t.prices_daily)


@register(
    "ind_17_rolling_population_vol", "symbol:s date:t vol_pct:d4",
    f"SELECT symbol, date, stddev_pop(coalesce(r,0)) OVER {frame(21)}*sqrt(252)*100 AS vol_pct FROM {SR.format(src='pdaily')}",
)
def _(t: Tables):
    return ind.quarterly_vol(t.prices_daily)
