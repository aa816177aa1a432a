"""Registered queries: allocation methods, walk-forward profiles, suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from risklake.operators import allocation as al
from risklake.operators import metrics as m
from risklake.plans.catalog_metrics import COMMON_LOG
from risklake.plans.registry import register
from risklake.session import materialise
from risklake.sources.testdata import Tables

UP = "ROWS UNBOUNDED PRECEDING"

ROWS_SQL = """SELECT portfolio_id, symbol, date, price, row_number() OVER (PARTITION BY portfolio_id, symbol ORDER BY date)-1 AS i,
    count(*) OVER (PARTITION BY portfolio_id, symbol) AS n FROM (SELECT h.portfolio_id, h.symbol, p.date, p.price, nh,
    count(*) OVER (PARTITION BY h.portfolio_id, p.date) AS c FROM (SELECT *, count(*) OVER (PARTITION BY portfolio_id) AS nh FROM pos) h
    JOIN pw p ON p.symbol=h.symbol) WHERE c=nh AND nh>=2 QUALIFY n>=257"""
PANEL_SQL = f"""al AS ({ROWS_SQL}), pn AS (SELECT portfolio_id, k, symbol, price, i-st AS pos, price/lag(price) OVER (PARTITION BY portfolio_id, k, symbol ORDER BY i)-1 AS ret
    FROM (SELECT al.*, k, CASE WHEN k=-1 THEN n-253 ELSE k*21 END AS st FROM al, (SELECT unnest(generate_series(-1,40)) AS k) WHERE k=-1 OR k*21<=n-254) WHERE i BETWEEN st AND st+252)"""
STATS_SQL = f"""{PANEL_SQL}, x AS (SELECT *, 1-price/max(price) OVER (PARTITION BY portfolio_id,k,symbol ORDER BY pos {UP}) AS dd,
      CASE WHEN count(ret) OVER f=21 THEN stddev_pop(ret) OVER f END AS s21 FROM pn WINDOW f AS (PARTITION BY portfolio_id,k,symbol ORDER BY pos ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
    q AS (SELECT portfolio_id,k,symbol, quantile_cont(dd,0.95) AS q, max(s21) FILTER (pos=252) AS cur FROM x GROUP BY 1,2,3),
    st AS (SELECT x.portfolio_id, x.k, x.symbol, stddev_pop(ret) AS vol, stddev_pop(s21) FILTER (pos>189) AS vv,
      CASE WHEN stddev_pop(s21)=0 THEN 1 ELSE greatest(0.6, least(1.15, 1.15-0.5*avg(CASE WHEN s21<cur THEN 1.0 WHEN s21>=cur THEN 0.0 END))) END AS rm,
      greatest(avg(dd) FILTER (dd>=q), 1e-4) AS cdar, avg(CASE WHEN dd<0.02 THEN 1.0 ELSE 0.0 END) AS rec
      FROM x JOIN q ON q.portfolio_id=x.portfolio_id AND q.k=x.k AND q.symbol=x.symbol GROUP BY 1,2,3)"""
_P = "PARTITION BY portfolio_id, k"
WEIGHTS_SQL = f"""{STATS_SQL}, rw AS (SELECT *, 1/cdar*rm/(1+0.5*CASE WHEN md>0 THEN vv/(md+1e-12) ELSE 0 END)*(1+0.2*(rec-0.5)) AS raw, CASE WHEN vol>0 THEN 1/vol ELSE 0 END AS iv
      FROM (SELECT *, median(vv) OVER ({_P}) AS md FROM st)),
    lists AS (SELECT portfolio_id, k, list(symbol ORDER BY symbol) AS syms, list(x ORDER BY symbol) AS mat FROM (SELECT portfolio_id, k, symbol, list(ret-mu ORDER BY pos) AS x FROM
      (SELECT *, avg(ret) OVER (PARTITION BY portfolio_id,k,symbol) AS mu FROM pn) WHERE ret IS NOT NULL GROUP BY 1,2,3) GROUP BY 1,2),
    cv AS (SELECT portfolio_id, k, syms, list_transform(mat, lambda a: list_transform(mat, lambda b: list_inner_product(a,b)/(len(a)-1))) AS cov FROM lists),
    rp(portfolio_id, k, it, w) AS (SELECT portfolio_id, k, 0, list_transform(u, lambda v: v/list_sum(u)) FROM (SELECT portfolio_id, k,
        list_transform(range(1,len(cov)+1), lambda i: 1/(sqrt(cov[i][i])+1e-12)) AS u FROM cv)
      UNION ALL SELECT portfolio_id, k, it+1, list_transform(u, lambda v: v/list_sum(u)) FROM (SELECT portfolio_id, k, it,
        list_transform(range(1,len(w)+1), lambda i: 0.5e0*w[i]+0.5e0*greatest(CASE WHEN g[i]>0 THEN tg/(g[i]+1e-12) ELSE w[i] END, 1e-6)) AS u FROM (
        SELECT *, list_inner_product(w,g)/len(w) AS tg FROM (SELECT rp.portfolio_id, rp.k, it, w, list_transform(cov, lambda row: list_inner_product(row,w)) AS g
        FROM rp JOIN cv ON cv.portfolio_id=rp.portfolio_id AND cv.k=rp.k WHERE it<80)))),
    wt AS (SELECT portfolio_id, k, symbol, 'equal' AS method, 1.0/count(*) OVER ({_P}) AS weight FROM rw
      UNION ALL SELECT portfolio_id, k, symbol, 'inverse_vol', iv/sum(iv) OVER ({_P}) FROM rw
      UNION ALL SELECT portfolio_id, k, symbol, 'drawdown_mgd', raw/sum(raw) OVER ({_P}) FROM rw
      UNION ALL SELECT rp.portfolio_id, rp.k, unnest(syms), 'risk_parity', unnest(w) FROM rp JOIN cv ON cv.portfolio_id=rp.portfolio_id AND cv.k=rp.k WHERE it=80)"""
RECURSIVE = "WITH RECURSIVE " + WEIGHTS_SQL


def _panel(t: Tables):
    return al.trailing_panel(al.numbered_prices(t.positions, t.prices_weekly))


for _name, _method in (
    ("alc_01_equal_weight", "equal"), ("alc_02_inverse_volatility", "inverse_vol"), ("alc_03_risk_parity", "risk_parity"), ("alc_04_drawdown_managed", "drawdown_mgd"),
):
    _build = (
        (lambda t: al.risk_parity_weights(_panel(t)))
        if _method == "risk_parity"
        else (lambda t, meth=_method: al.statistic_weights(al.panel_statistics(_panel(t))).where(F.col("method") == meth))
    )
    register(_name, "portfolio_id:i k:i symbol:s weight:d6", f"{RECURSIVE} SELECT * FROM wt WHERE method='{_method}'")(_build)

for _name, _cols in {
    "alc_05_vol_of_vol": "portfolio_id:i k:i symbol:s vol_of_vol:d6",
    "alc_06_recovery_strength": "portfolio_id:i k:i symbol:s recovery:d6 cdar:d6",
    "alc_07_regime_multiplier": "portfolio_id:i k:i symbol:s regime_mult:d6",
}.items():
    register(_name, _cols, f"WITH {STATS_SQL} SELECT *, vv AS vol_of_vol, rec AS recovery, rm AS regime_mult FROM st")(
        lambda t: al.panel_statistics(_panel(t))
    )


@register(
    "alc_08_capped_weights", "portfolio_id:i symbol:s weight:d6",
    """WITH RECURSIVE b AS (SELECT portfolio_id, list(symbol ORDER BY symbol) AS syms, list(weight ORDER BY symbol) AS w, greatest(0.25e0, 1e0/count(*)) AS cap FROM posc GROUP BY 1),
       r(portfolio_id, it, w, cap) AS (SELECT portfolio_id, 0, w, cap FROM b UNION ALL SELECT portfolio_id, it+1, CASE WHEN ex>0 THEN
         list_transform(w, lambda v: CASE WHEN v>cap THEN cap WHEN room>0 THEN v+ex*v/room ELSE v END) ELSE w END, cap FROM (SELECT *,
         list_sum(list_transform(w, lambda v: greatest(v-cap,0))) AS ex, list_sum(list_transform(w, lambda v: CASE WHEN v>cap THEN 0 ELSE v END)) AS room FROM r WHERE it<8))
       SELECT r.portfolio_id, unnest(syms) AS symbol, unnest(list_transform(r.w, lambda v: v/list_sum(r.w))) AS weight FROM r JOIN b ON b.portfolio_id=r.portfolio_id WHERE it=8""",
)
def _(t: Tables):
    return al.capped_weights(t.positions_by_customer, 0.25, ["portfolio_id"])


@register(
    "alc_09_rounded_weights", "portfolio_id:i symbol:s rounded:d4",
    """SELECT portfolio_id, symbol, CASE WHEN rn=1 THEN r+(1-sum(r) OVER (PARTITION BY portfolio_id)) ELSE r END AS rounded FROM (SELECT *, round_even(weight,4) AS r,
       row_number() OVER (PARTITION BY portfolio_id ORDER BY weight DESC, symbol) AS rn FROM posc)""",
)
def _(t: Tables):
    return al.rounded_weights(t.positions_by_customer, ["portfolio_id"])


DAILY_SQL = f"""{WEIGHTS_SQL},
    dy AS (SELECT *, lead(price) OVER (PARTITION BY portfolio_id,symbol ORDER BY i)/price-1 AS ret, (i-252)//21 AS k, (i-252)%21 AS m FROM al WHERE i>=252),
    gr AS (SELECT *, coalesce(product(CASE WHEN m>=1 THEN 1+ret ELSE 1 END) OVER (PARTITION BY portfolio_id,symbol,k ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),1) AS g,
      product(CASE WHEN m>=1 THEN 1+ret ELSE 1 END) OVER (PARTITION BY portfolio_id,symbol,k ORDER BY m {UP}) AS ge, max(m) OVER (PARTITION BY portfolio_id,k) AS lm FROM dy
      WHERE ret IS NOT NULL AND (n-254)//21+1 >= 4),
    hd AS (SELECT gr.*, method, weight FROM gr JOIN wt ON wt.portfolio_id=gr.portfolio_id AND wt.k=gr.k AND wt.symbol=gr.symbol),
    dl AS (SELECT portfolio_id, method, k, m, i, n, date, sum(weight*g*ret)/sum(weight*g) AS gross FROM hd GROUP BY ALL),
    en AS (SELECT portfolio_id, method, symbol, k+1 AS k, weight*ge/sum(weight*ge) OVER (PARTITION BY portfolio_id,method,k) AS bf FROM hd WHERE m=lm),
    tr AS (SELECT w.portfolio_id, w.method, w.k, 0.5*sum(abs(weight-coalesce(bf,0))) AS traded FROM wt w LEFT JOIN en e ON e.portfolio_id=w.portfolio_id AND e.method=w.method
      AND e.symbol=w.symbol AND e.k=w.k WHERE w.k>=0 GROUP BY 1,2,3),
    nt AS (SELECT dl.portfolio_id, dl.method, date, i, n, CASE WHEN m=0 THEN traded ELSE 0 END AS traded, gross-CASE WHEN m=0 THEN traded ELSE 0 END*0.001e0 AS ret FROM dl
      JOIN tr ON tr.portfolio_id=dl.portfolio_id AND tr.method=dl.method AND tr.k=dl.k)"""


def _daily(t: Tables):
    rows = materialise(al.numbered_prices(t.positions, t.prices_weekly), "aligned")
    return al.walk_forward(rows, materialise(al.method_weights(al.trailing_panel(rows)), "weights"))


@register(
    "alc_10_walk_forward", "portfolio_id:i method:s date:t traded:d6 ret:d6",
    f"WITH RECURSIVE {DAILY_SQL} SELECT portfolio_id, method, date, traded, ret FROM nt",
)
def _(t: Tables):
    return _daily(t)


PROFILE_SQL = f"""{DAILY_SQL}, ev AS (SELECT *, product(1+ret) OVER (PARTITION BY portfolio_id,method ORDER BY i {UP}) AS eq FROM nt),
    dv AS (SELECT *, 1-eq/greatest(1, max(eq) OVER (PARTITION BY portfolio_id,method ORDER BY i {UP})) AS dd FROM ev),
    pt AS (SELECT portfolio_id, method, dd FROM dv UNION ALL SELECT DISTINCT portfolio_id, method, 0e0 FROM dv),
    pq AS (SELECT portfolio_id, method, quantile_cont(dd,0.95) AS q FROM pt GROUP BY 1,2),
    pc AS (SELECT pt.portfolio_id, pt.method, avg(dd) FILTER (dd>=q) AS cd, max(dd) AS mdd FROM pt JOIN pq ON pq.portfolio_id=pt.portfolio_id AND pq.method=pt.method GROUP BY 1,2),
    pf AS (SELECT dv.portfolio_id, dv.method, pow(arg_max(eq,i), 1/((max(n)-253)/252e0))-1 AS cagr, stddev_pop(ret)*sqrt(252) AS ann_vol,
      avg(ret)*252/(stddev_pop(ret)*sqrt(252)) AS sharpe, -any_value(mdd) AS max_drawdown, -any_value(cd) AS cdar95, sum(traded)/((max(n)-253)/252e0) AS turnover_per_yr
      FROM dv JOIN pc ON pc.portfolio_id=dv.portfolio_id AND pc.method=dv.method GROUP BY 1,2)"""


@register(
    "alc_11_strategy_profile", "portfolio_id:i method:s cagr:d4 ann_vol:d6 sharpe:d6 max_drawdown:d6 cdar95:d6 turnover_per_yr:d6",
    f"WITH RECURSIVE {PROFILE_SQL} SELECT * FROM pf",
)
def _(t: Tables):
    return al.strategy_profile(_daily(t))


@register(
    "alc_12_allocation_report", "portfolio_id:i method:s symbol:s weight:d6 cagr:d4 sharpe:d6",
    f"""WITH RECURSIVE {PROFILE_SQL} SELECT wt.portfolio_id, wt.method, wt.symbol, weight, cagr, sharpe FROM wt LEFT JOIN pf ON pf.portfolio_id=wt.portfolio_id
        AND pf.method=wt.method WHERE k=-1""",
)
def _(t: Tables):
    return al.allocation_report(t.positions, t.prices_weekly)


@register(
    "alc_13_rebalance_suggestions", "portfolio_id:i symbol:s current_weight:d6 target_weight:d6 delta:d6 action:s turnover:d6",
    """SELECT *, CASE WHEN delta>0 THEN 'buy' WHEN delta<0 THEN 'sell' ELSE 'hold' END AS action, 0.5*sum(abs(delta)) OVER (PARTITION BY portfolio_id) AS turnover FROM
       (SELECT portfolio_id, symbol, weight AS current_weight, 1e0/count(*) OVER (PARTITION BY portfolio_id) AS target_weight,
        1e0/count(*) OVER (PARTITION BY portfolio_id) - weight/sum(weight) OVER (PARTITION BY portfolio_id) AS delta FROM posc)""",
)
def _(t: Tables):
    return al.rebalance_suggestions(t.positions_by_customer)


@register(
    "alc_14_best_subset", "portfolio_id:i objective:d5 selection:s status:s",
    f"""WITH c AS ({COMMON_LOG}), s AS (SELECT portfolio_id, symbol, avg(ret)*252 AS mu, row_number() OVER (PARTITION BY portfolio_id ORDER BY symbol)-1 AS i FROM c GROUP BY 1,2),
        v AS (SELECT a.portfolio_id, x.i, y.i AS j, covar_samp(a.ret,b.ret)*252 AS cov FROM c a JOIN c b ON a.portfolio_id=b.portfolio_id AND a.date=b.date
          JOIN s x ON x.portfolio_id=a.portfolio_id AND x.symbol=a.symbol JOIN s y ON y.portfolio_id=b.portfolio_id AND y.symbol=b.symbol GROUP BY 1,2,3),
        k AS (SELECT portfolio_id, mask FROM (SELECT portfolio_id, count(*) AS n FROM s GROUP BY 1), (SELECT unnest(generate_series(1,63)) AS mask) WHERE bit_count(mask)=3 AND mask<(1<<n)),
        g AS (SELECT k.portfolio_id, mask, sum(mu) AS gain, string_agg(symbol, ',' ORDER BY symbol) AS selection FROM k JOIN s ON s.portfolio_id=k.portfolio_id AND (mask>>i)&1=1 GROUP BY 1,2),
        r AS (SELECT k.portfolio_id, mask, sum(cov) AS risk FROM k JOIN v ON v.portfolio_id=k.portfolio_id AND (mask>>i)&1=1 AND (mask>>j)&1=1 GROUP BY 1,2)
        SELECT g.portfolio_id, min(0.5*risk-gain) AS objective, arg_min(selection, 0.5*risk-gain) AS selection, 'ok' AS status FROM g JOIN r ON r.portfolio_id=g.portfolio_id AND r.mask=g.mask GROUP BY 1
        UNION ALL SELECT portfolio_id, NULL, NULL, '{al.TOO_FEW}' FROM s GROUP BY 1 HAVING count(*)<3""",
    store="prices_daily positions",
)
def _(t: Tables):
    r = m.common_returns(t.positions, t.prices_daily, log=True)
    mu = r.groupBy("portfolio_id", "symbol").agg((F.avg("ret") * 252.0).alias("mu"))
    return al.best_subset(mu, m.covariance_matrix(r), size=3)


@register(
    "alc_15_import_weights", "portfolio_id:i symbol:s weight:d6 basis:s",
    """WITH l AS (SELECT symbol, arg_max(price,date) AS price FROM pw GROUP BY 1), h AS (SELECT o.portfolio_id, o.symbol, CASE WHEN portfolio_id%3=0 THEN quantity*price
         WHEN portfolio_id%3=1 AND purchase_date<DATE '1999-01-01' THEN cost_basis END AS mv, CASE WHEN portfolio_id%3<>0 AND purchase_date>=DATE '1997-01-01' THEN weight*100 END AS sw FROM posc o JOIN l ON l.symbol=o.symbol)
       SELECT portfolio_id, symbol, CASE WHEN t>0 THEN coalesce(mv/t,0) WHEN c>0 THEN coalesce(sw/g,0) ELSE 1e0/n END AS weight,
       CASE WHEN t>0 THEN 'market_value' WHEN c>0 THEN 'supplied_weight' ELSE 'equal_weight' END AS basis FROM (SELECT *, sum(mv) OVER w AS t, count(sw) OVER w AS c, sum(sw) OVER w AS g, count(*) OVER w AS n
       FROM h WINDOW w AS (PARTITION BY portfolio_id))""",
)
def _(t: Tables):
    last = t.prices_weekly.groupBy("symbol").agg(F.max_by("price", "date").alias("price"))
    kind = F.col("portfolio_id") % 3
    h = t.positions_by_customer.join(last, "symbol").select(
        "portfolio_id", "symbol", F.when(kind == 0, F.col("quantity")).alias("quantity"), "price",
        F.when((kind == 1) & (F.col("purchase_date") < "1999-01-01"), F.col("cost_basis")).alias("market_value"),
        F.when((kind != 0) & (F.col("purchase_date") >= "1997-01-01"), F.col("weight") * 100).alias("supplied_weight"),
    )
    return al.import_weights(h)
