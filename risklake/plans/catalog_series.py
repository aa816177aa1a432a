"""Registered queries: alignment joins, returns, growth, drawdown and calendar bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from risklake.operators import align, returns
from risklake.plans.registry import register
from risklake.sources.testdata import SYMBOLS, Tables

WS = "PARTITION BY symbol ORDER BY date"
WP = "PARTITION BY portfolio_id ORDER BY date"
WPS = "PARTITION BY portfolio_id, symbol ORDER BY date"
UP = "ROWS UNBOUNDED PRECEDING"
CLAMP = "CASE WHEN isfinite({x}) AND abs({x}) <= 2.0 THEN {x} ELSE 0.0 END"


# ---- alignment ----------------------------------------------------------------------
@register(
    "join_01_pair_alignment", "pair:s date:t a:d4 b:d4 ret_a:d6 ret_b:d6",
    """SELECT pair, date, a, b, a/lag(a) OVER (PARTITION BY pair ORDER BY date)-1 AS ret_a, b/lag(b) OVER (PARTITION BY pair ORDER BY date)-1 AS ret_b FROM
       (SELECT x.symbol||'_'||y.symbol AS pair, x.date, x.price AS a, y.price AS b FROM pdaily x JOIN pdaily y ON x.date=y.date
        WHERE x.symbol<y.symbol) QUALIFY ret_a IS NOT NULL""",
)
def _(t: Tables):
    names = [F.lit(s) for s in SYMBOLS]
    later = F.explode(F.filter(F.array(*names), lambda s: s > F.col("symbol")))
    earlier = F.explode(F.filter(F.array(*names), lambda s: s < F.col("symbol")))
    left = t.prices_daily.select("*", later.alias("other")).withColumn("pair", F.concat_ws("_", "symbol", "other")).drop("other")
    right = t.prices_daily.select("*", earlier.alias("other")).withColumn("pair", F.concat_ws("_", "other", "symbol")).drop("other")
    both = align.align_pair(left, right, on=["pair", "date"])
    w = align.series("pair")
    return both.select(
        "pair", "date", "a", "b", (F.col("a") / F.lag("a").over(w) - 1).alias("ret_a"),
        (F.col("b") / F.lag("b").over(w) - 1).alias("ret_b"),
    ).where("ret_a is not null")


@register(
    "join_02_intersection_alignment", "portfolio_id:i symbol:s date:t price:d4",
    "SELECT portfolio_id, symbol, date, price FROM ald",
)
def _(t: Tables):
    return align.align_intersection(t.positions, t.prices_daily)


@register(
    "join_03_forward_fill_alignment", "portfolio_id:i symbol:s date:t price:d4",
    """SELECT s.portfolio_id, s.symbol, s.date, last_value(p.price IGNORE NULLS) OVER (PARTITION BY s.portfolio_id, s.symbol
       ORDER BY s.date ROWS UNBOUNDED PRECEDING) AS price FROM (SELECT DISTINCT h.portfolio_id, h.symbol, d.date FROM pos h
       JOIN (SELECT DISTINCT portfolio_id, p.date FROM pos JOIN pdaily p ON p.symbol=pos.symbol) d
       ON d.portfolio_id = h.portfolio_id) s LEFT JOIN pdaily p ON p.symbol=s.symbol AND p.date=s.date""",
    store="prices_daily positions",
)
def _(t: Tables):
    return align.align_forward_fill(t.positions, t.prices_daily)


@register(
    "join_04_benchmark_alignment", "symbol:s date:t benchmark:d4",
    """SELECT symbol, date, CASE WHEN first_value(b) OVER w IS NOT NULL AND last_value(b) OVER w IS NOT NULL AND
       avg(CASE WHEN b IS NULL THEN 0.0 ELSE 1.0 END) OVER w >= 0.9 AND first_value(b) OVER w > 0
       THEN last_value(b IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)
            / first_value(b) OVER w * 100 END AS benchmark
       FROM (SELECT x.symbol, x.date, y.price AS b FROM pdaily x LEFT JOIN
             (SELECT date, price FROM pdaily WHERE symbol='STANDARD') y ON x.date=y.date WHERE x.symbol <> 'STANDARD')
       WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
)
def _(t: Tables):
    dates = t.prices_daily.where("symbol <> 'STANDARD'").select("symbol", "date")
    return align.align_benchmark(dates, t.prices_daily.where("symbol = 'STANDARD'"), "symbol")


@register(
    "join_05_benchmark_fallback", "label:s date:t price:d4",
    """SELECT symbol AS label, date, price FROM pw WHERE symbol = (SELECT arg_min(symbol, CASE symbol WHEN 'MEDIUM' THEN 2
       WHEN 'SMALL' THEN 3 END) FROM pw WHERE symbol IN ('INDEX','MEDIUM','SMALL') AND date >= DATE '1999-01-01')
       AND date >= DATE '1999-01-01'""",
)
def _(t: Tables):
    in_range = t.prices_weekly.where("date >= date'1999-01-01'")
    return align.first_available(in_range, ["INDEX", "MEDIUM", "SMALL"])


@register(
    "join_06_latest_two_closes", "symbol:s latest:d4 previous:d4",
    """SELECT symbol, max(price) FILTER (rn=1) AS latest, max(price) FILTER (rn=2) AS previous FROM (SELECT *,
       row_number() OVER (PARTITION BY symbol ORDER BY date DESC) rn FROM pdaily) GROUP BY 1""",
)
def _(t: Tables):
    from risklake.operators.metrics import latest_two_closes

    return latest_two_closes(t.prices_daily)


@register(
    "join_12_event_window",
    "portfolio_id:i event_date:t date:t day_no:i idx:d4 drawdown:d4 event_return:d6 drawdown_peak:d6 status:s",
    """WITH n AS (SELECT portfolio_id, date, price, row_number() OVER (PARTITION BY portfolio_id ORDER BY date)-1 AS rn FROM ixw),
       ev AS (SELECT CAST(n_nationkey AS BIGINT) AS portfolio_id, DATE '1995-07-01' + CAST(120*n_nationkey AS INTEGER) AS event_date FROM nation),
       a AS (SELECT n.portfolio_id, event_date, min(rn) FILTER (date >= event_date) AS pos, min(date) AS lo, max(date) AS hi
             FROM n JOIN ev ON ev.portfolio_id=n.portfolio_id GROUP BY 1,2),
       k AS (SELECT n.*, a.event_date, pos, greatest(0,pos-15) AS st FROM n JOIN a ON a.portfolio_id=n.portfolio_id
             WHERE event_date BETWEEN lo AND hi AND rn BETWEEN greatest(0,pos-15) AND pos+15),
       i AS (SELECT *, price/first_value(price) OVER (PARTITION BY portfolio_id,event_date ORDER BY date)*100 AS idx FROM k),
       d AS (SELECT *, (idx/max(idx) OVER (PARTITION BY portfolio_id,event_date ORDER BY date ROWS UNBOUNDED PRECEDING)-1)*100 AS dd FROM i)
       SELECT portfolio_id, event_date, date, rn-st AS day_no, idx, dd AS drawdown,
         last_value(idx) OVER w / max(CASE WHEN rn=greatest(st,pos-1) THEN idx END) OVER w - 1 AS event_return,
         min(dd) OVER w / 100 AS drawdown_peak, 'ok' AS status FROM d
         WINDOW w AS (PARTITION BY portfolio_id,event_date ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
       UNION ALL SELECT portfolio_id, event_date, NULL, NULL, NULL, NULL, NULL, NULL, 'rejected' FROM a
         WHERE NOT event_date BETWEEN lo AND hi""",
    store="prices_weekly positions",
)
def _(t: Tables):
    index = returns.price_index(returns.portfolio_returns(t.positions, t.prices_weekly))
    events = t.raw("nation").select(
        F.col("n_nationkey").cast("long").alias("portfolio_id"),
        F.date_add(F.lit("1995-07-01").cast("date"), 120 * F.col("n_nationkey")).alias("event_date"),
    )
    return align.event_window(index, events)


# ---- returns ------------------------------------------------------------------------
@register("ret_01_daily_return", "symbol:s date:t price:d4 ret:d6", "SELECT symbol, date, price, ret FROM rd1")
def _(t: Tables):
    return returns.simple_returns(t.prices_daily)


@register(
    "ret_02_benchmark_cumulative", "symbol:s date:t ret:d6 cum_ret:d6",
    f"""SELECT symbol, date, ret, product(1+ret) OVER ({WS} {UP})-1 AS cum_ret FROM (SELECT *, price/lag(price) OVER ({WS})-1
        AS ret FROM bench) WHERE ret IS NOT NULL""",
)
def _(t: Tables):
    return returns.benchmark_returns(t.benchmark_weekly)


@register(
    "ret_03_log_return", "symbol:s date:t ret:d6",
    f"""SELECT symbol, date, ret FROM (SELECT symbol, date, ln(price/lag(price) OVER ({WS})) AS ret FROM pdaily)
        WHERE ret IS NOT NULL QUALIFY count(*) OVER (PARTITION BY symbol) >= 60""",
)
def _(t: Tables):
    return returns.log_returns(t.prices_daily)


@register("ret_04_portfolio_constant_weight", "portfolio_id:i date:t ret:d6", "SELECT portfolio_id, date, ret FROM prd")
def _(t: Tables):
    return returns.portfolio_returns(t.positions, t.prices_daily)


@register(
    "ret_05_portfolio_drift", "portfolio_id:i date:t ret:d6",
    f"""SELECT portfolio_id, date, CASE WHEN sum(before) > 0 THEN sum(now)/sum(before)-1 ELSE 0.0 END AS ret FROM (
        SELECT portfolio_id, date, CASE WHEN lag(date) OVER w >= purchase_date THEN quantity*price END AS now,
        CASE WHEN lag(date) OVER w >= purchase_date THEN quantity*lag(price) OVER w END AS before FROM ald
        WINDOW w AS ({WPS})) GROUP BY 1,2""",
)
def _(t: Tables):
    return returns.portfolio_returns_drift(t.positions, t.prices_daily)


@register(
    "ret_06_weight_mode", "portfolio_id:i mode:s",
    """SELECT portfolio_id, CASE WHEN bool_and(quantity > 100) THEN 'drift' ELSE 'constant' END AS mode FROM posc GROUP BY 1""",
)
def _(t: Tables):
    shares = F.when(F.col("quantity") > 100, F.col("quantity"))  # small lots carry no share count
    return returns.weight_mode(t.positions_by_customer.withColumn("quantity", shares))


@register("ret_07_index_base_100", "portfolio_id:i date:t price:d2", "SELECT portfolio_id, date, price FROM ixw")
def _(t: Tables):
    return returns.price_index(returns.portfolio_returns(t.positions, t.prices_weekly))


@register(
    "ret_08_sleeve_index", "portfolio_id:i sleeve:s date:t price:d2",
    f"""WITH h AS (SELECT portfolio_id, symbol, weight, CASE WHEN asset_type='BOND' THEN 'bond' WHEN asset_type='FUTURE' THEN 'commodity'
        ELSE 'equity' END AS sleeve FROM pos),
        j AS (SELECT h.portfolio_id, sleeve, h.symbol, date, weight/sum(weight) OVER (PARTITION BY h.portfolio_id, sleeve, date) AS share,
        price/lag(price) OVER (PARTITION BY h.portfolio_id, sleeve, h.symbol ORDER BY date)-1 AS r
        FROM (SELECT n.*, date, price FROM (SELECT *, count(*) OVER (PARTITION BY portfolio_id, sleeve) AS nh FROM h) n JOIN pw ON pw.symbol=n.symbol
          QUALIFY count(*) OVER (PARTITION BY n.portfolio_id, sleeve, date) = nh) h)
        SELECT portfolio_id, sleeve, date, 100*product(1+r) OVER (PARTITION BY portfolio_id, sleeve ORDER BY date {UP}) AS price
        FROM (SELECT portfolio_id, sleeve, date, sum(share*r) AS r FROM j WHERE r IS NOT NULL GROUP BY 1,2,3)""",
)
def _(t: Tables):
    sleeve = F.when(F.col("asset_type") == "BOND", "bond").when(F.col("asset_type") == "FUTURE", "commodity").otherwise("equity")
    return returns.sleeve_index(t.positions.withColumn("sleeve", sleeve), t.prices_weekly)


@register(
    "ret_09_running_drawdown", "symbol:s date:t drawdown:d6",
    f"SELECT symbol, date, price/max(price) OVER ({WS} {UP})-1 AS drawdown FROM pdaily",
)
def _(t: Tables):
    return returns.running_drawdown(t.prices_daily)


@register(
    "ret_10_drawdown_carried_peak", "symbol:s date:t is_forecast:b drawdown:d6 dd_lower:d6 dd_upper:d6",
    f"""WITH h AS (SELECT symbol, max(price) AS peak FROM hiw GROUP BY 1),
        f AS (SELECT f.symbol, date, price/greatest(peak, max(price) OVER ({WS.replace('symbol','f.symbol')} {UP}))-1 AS dd,
          lower/greatest(peak, max(lower) OVER ({WS.replace('symbol','f.symbol')} {UP}))-1 AS lo,
          upper/greatest(peak, max(upper) OVER ({WS.replace('symbol','f.symbol')} {UP}))-1 AS up
          FROM fcw f JOIN h ON h.symbol=f.symbol)
        SELECT symbol, date, true AS is_forecast, dd AS drawdown, least(lo,up) AS dd_lower, greatest(lo,up) AS dd_upper FROM f
        UNION ALL SELECT symbol, date, false, price/max(price) OVER ({WS} {UP})-1, NULL, NULL FROM hiw""",
)
def _(t: Tables):
    return returns.drawdown_with_forecast(t.history_weekly, t.forecast_weekly)


@register(
    "ret_11_monthly_return", "symbol:s month:t ret:d6 partial:b n_days:i",
    f"""SELECT symbol, date_trunc('month', date) AS month, CASE WHEN count(*)>=2 THEN
        {CLAMP.format(x='(arg_max(price,date)/arg_min(price,date)-1)')} ELSE 0.0 END AS ret, count(*)<2 AS partial,
        count(*) AS n_days FROM pdaily GROUP BY 1,2""",
)
def _(t: Tables):
    return returns.monthly_returns(t.prices_daily)


@register(
    "ret_12_monthly_spliced", "symbol:s month:t ret:d6 partial:b is_forecast:b spliced:b lower:d6 upper:d6",
    f"""WITH mh AS (SELECT symbol, date_trunc('month', date) AS month, CASE WHEN count(*)>=2 THEN
          {CLAMP.format(x='(arg_max(price,date)/arg_min(price,date)-1)')} ELSE 0.0 END AS ret, count(*)<2 AS partial FROM hiw GROUP BY 1,2
          QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date_trunc('month', date) DESC) <= 12),
        an AS (SELECT symbol, arg_max(price,date) AS anchor, date_trunc('month', max(date)) AS shared FROM hiw GROUP BY 1),
        mf AS (SELECT symbol, date_trunc('month', date) AS month, arg_max(price,date) AS e, count(*)<2 AS partial,
          CASE WHEN count(*)>=2 THEN {CLAMP.format(x='(arg_max(price,date)/arg_min(price,date)-1)')} ELSE 0.0 END AS ret,
          CASE WHEN count(*)>=2 THEN {CLAMP.format(x='(arg_max(lower,date)/arg_min(lower,date)-1)')} ELSE 0.0 END AS lo,
          CASE WHEN count(*)>=2 THEN {CLAMP.format(x='(arg_max(upper,date)/arg_min(upper,date)-1)')} ELSE 0.0 END AS up FROM fcw GROUP BY 1,2)
        SELECT symbol, month, ret, partial, false AS is_forecast, false AS spliced, NULL AS lower, NULL AS upper FROM mh
        UNION ALL SELECT mf.symbol, month, CASE WHEN month=shared THEN {CLAMP.format(x='(e/anchor-1)')} ELSE ret END, partial, true,
          month=shared, least(lo,up), greatest(lo,up) FROM mf JOIN an ON an.symbol=mf.symbol""",
    store="prices_weekly",
)
def _(t: Tables):
    return returns.monthly_returns_spliced(t.history_weekly, t.forecast_weekly)


_SPINE = """SELECT s.symbol, s.year, s.month, m.ret FROM (SELECT DISTINCT symbol, year(date) AS year, u.month FROM pdaily,
    (SELECT unnest(generate_series(1,12)) AS month) u) s LEFT JOIN (SELECT symbol, year(date) AS y, month(date) AS mo,
    CASE WHEN count(*)>=2 AND arg_min(price,date)>0 THEN arg_max(price,date)/arg_min(price,date)-1 END AS ret FROM pdaily GROUP BY 1,2,3) m
    ON m.symbol=s.symbol AND m.y=s.year AND m.mo=s.month"""


@register("ret_13_monthly_spine", "symbol:s year:i month:i ret:d6", _SPINE)
def _(t: Tables):
    return returns.monthly_spine(t.prices_daily)


_RUN = f"""WITH sp AS ({_SPINE}), k AS (SELECT *, month - row_number() OVER (PARTITION BY symbol, year ORDER BY month) AS isl
    FROM sp WHERE ret IS NOT NULL), r AS (SELECT *, product(1+ret) OVER (PARTITION BY symbol, year ORDER BY month {UP}) AS g FROM k
    QUALIFY isl = min(isl) OVER (PARTITION BY symbol, year))
    SELECT sp.symbol, sp.year, sp.month, r.g IS NOT NULL AS in_run, (r.g-1)*100 AS cum_pct FROM sp LEFT JOIN r
    ON r.symbol=sp.symbol AND r.year=sp.year AND r.month=sp.month"""


@register("ret_14_coverage_run", "symbol:s year:i month:i in_run:b", _RUN)
def _(t: Tables):
    return returns.coverage_run(returns.monthly_spine(t.prices_daily))


@register("ret_15_cumulative_over_run", "symbol:s year:i month:i cum_pct:d4", _RUN)
def _(t: Tables):
    return returns.coverage_run(returns.monthly_spine(t.prices_daily))


@register(
    "ret_16_period_return", "symbol:s months:i ret:d6",
    """SELECT p.symbol, months, CASE WHEN count(*)>=2 AND arg_min(price,date)>0 THEN arg_max(price,date)/arg_min(price,date)-1 END AS ret
       FROM pdaily p JOIN (SELECT symbol, max(date) AS e FROM pdaily GROUP BY 1) x ON x.symbol=p.symbol,
       (SELECT unnest([3,6,12,24]) AS months) WHERE date >= e - to_months(CAST(months AS INTEGER)) GROUP BY 1,2""",
)
def _(t: Tables):
    return returns.period_returns(t.prices_daily)


@register(
    "ret_17_momentum_facts", "symbol:s last:d4 chg_21:d4 chg_63:d4 chg_126:d4 range_pos:d4 ann_vol:d4",
    f"""SELECT symbol, arg_max(price,date) AS last, arg_max(c21,date) AS chg_21, arg_max(c63,date) AS chg_63, arg_max(c126,date) AS chg_126,
        CASE WHEN max(price)>min(price) THEN (arg_max(price,date)-min(price))/(max(price)-min(price))*100 END AS range_pos,
        stddev_samp(r)*sqrt(252)*100 AS ann_vol FROM (SELECT symbol, date, price, (price/lag(price,21) OVER w -1)*100 AS c21,
        (price/lag(price,63) OVER w -1)*100 AS c63, (price/lag(price,126) OVER w -1)*100 AS c126, price/lag(price) OVER w -1 AS r
        FROM (SELECT * FROM pdaily QUALIFY date >= max(date) OVER (PARTITION BY symbol) - 366) WINDOW w AS ({WS})) GROUP BY 1""",
)
def _(t: Tables):
    return returns.momentum_facts(t.prices_daily)


@register(
    "ret_18_ohlc_bars", "symbol:s is_forecast:b time:t open:d4 high:d4 low:d4 close:d4",
    """SELECT symbol, date >= DATE '2001-06-14' AS is_forecast, max(date) AS time, arg_min(price,date) AS open, max(price) AS high,
       min(price) AS low, arg_max(price,date) AS close FROM pdaily GROUP BY symbol, is_forecast, date_trunc('week', date)""",
)
def _(t: Tables):
    split = t.prices_daily.withColumn("is_forecast", F.col("date") >= F.lit("2001-06-14").cast("date"))
    return returns.ohlc_bars(split)


@register(
    "ret_19_watchlist_snapshot", "symbol:s latest:d4 change_1d:d6 vol_30d:d6 n_points:i first_point:d4",
    f"""SELECT symbol, max(price) FILTER (rn=1) AS latest, max(ret) FILTER (rn=1) AS change_1d, stddev_samp(ret)*sqrt(252) AS vol_30d,
        count(*) AS n_points, arg_min(price,date) AS first_point FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC)
        AS rn FROM rd) WHERE rn <= 30 GROUP BY 1""",
)
def _(t: Tables):
    snap = returns.watchlist_snapshot(t.prices_daily)
    return snap.withColumn("n_points", F.size("sparkline")).withColumn("first_point", F.element_at("sparkline", 1))


@register(
    "ret_20_rebased_benchmark", "symbol:s date:t idx:d4",
    f"SELECT symbol, date, price/first_value(price) OVER ({WS})*100 AS idx FROM bench",
)
def _(t: Tables):
    return returns.rebased(t.benchmark_weekly)


@register(
    "ret_21_synthetic_candles", "symbol:s date:t open:d4 high:d4 low:d4 close:d4",
    f"""SELECT symbol, date, o AS open, greatest(o,price)+0.6*greatest(abs(price-o),price*0.0035) AS high,
        least(o,price)-0.6*greatest(abs(price-o),price*0.0035) AS low, price AS close
        FROM (SELECT *, coalesce(lag(price) OVER ({WS}), price) AS o FROM pdaily)""",
)
def _(t: Tables):
    return returns.synthetic_candles(t.prices_daily)


@register(
    "join_03_filled_portfolio_return", "portfolio_id:i date:t ret:d6",
    """WITH f AS (SELECT s.portfolio_id, s.symbol, s.date, s.weight, last_value(p.price IGNORE NULLS) OVER (PARTITION BY s.portfolio_id, s.symbol
       ORDER BY s.date ROWS UNBOUNDED PRECEDING) AS price FROM (SELECT DISTINCT h.portfolio_id, h.symbol, h.weight, d.date FROM pos h
       JOIN (SELECT DISTINCT portfolio_id, p.date FROM pos JOIN pdaily p ON p.symbol=pos.symbol) d
       ON d.portfolio_id = h.portfolio_id) s LEFT JOIN pdaily p ON p.symbol=s.symbol AND p.date=s.date)
       SELECT portfolio_id, date, sum(weight*r) AS ret FROM (SELECT *, coalesce(price/lag(price) OVER
       (PARTITION BY portfolio_id, symbol ORDER BY date)-1, 0.0) AS r FROM f) GROUP BY 1,2""",
    store="prices_daily positions",
)
def _(t: Tables):
    return returns.portfolio_returns_filled(t.positions, t.prices_daily)
