"""The derived input shapes once more, as plain SQL, for the DuckDB side of a comparison.

Each entry is a common table expression; ``with_ctes`` prepends the ones a query names.
"""

from __future__ import annotations

import re

_TRADED = """SELECT p_type AS symbol, CAST({day} AS DATE) AS date,
    sum(l_extendedprice)/sum(l_quantity) AS price, sum(l_quantity) AS volume
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""

CTES: dict[str, str] = {
    "pw": _TRADED.format(day="date_trunc('week', l_shipdate)"),
    "pdaily": _TRADED.format(day="l_shipdate"),
    "bench": """SELECT 'ALL' AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
        sum(l_extendedprice)/sum(l_quantity) AS price FROM lineitem GROUP BY 2""",
    "hiw": "SELECT symbol, date, price FROM pw WHERE date < DATE '2001-06-14'",
    "fcw": """SELECT symbol, date, price, price*0.9e0 AS lower, price*1.1e0 AS upper FROM pw
        WHERE date >= DATE '2001-06-14'""",
    "assets": """SELECT p_type AS symbol, upper(substr(p_type,1,1))||lower(substr(p_type,2)) AS name,
        CASE p_type WHEN 'LARGE' THEN 'BOND' WHEN 'MEDIUM' THEN 'BOND' WHEN 'PROMO' THEN 'FUTURE'
            WHEN 'STANDARD' THEN 'ETF' ELSE 'EQUITY' END AS asset_type,
        CASE p_type WHEN 'LARGE' THEN 'BOND_ETF' WHEN 'MEDIUM' THEN 'BOND_ETF' WHEN 'PROMO' THEN 'COMMODITY'
            WHEN 'STANDARD' THEN 'ETF' ELSE 'US_EQUITY' END AS asset_class, count(*) AS n_parts
        FROM part GROUP BY 1""",
    "posc_raw": """SELECT o_custkey AS portfolio_id, p_type AS symbol, sum(l_quantity) AS quantity,
        sum(l_extendedprice) AS cost_basis, CAST(min(o_orderdate) AS DATE) AS purchase_date
        FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN part ON l_partkey=p_partkey GROUP BY 1,2""",
    "posc": """SELECT r.portfolio_id, CAST(c_nationkey AS BIGINT) AS user_id, r.symbol, quantity, cost_basis,
        cost_basis/sum(cost_basis) OVER (PARTITION BY r.portfolio_id) AS weight, purchase_date, a.asset_type
        FROM posc_raw r JOIN customer ON c_custkey = r.portfolio_id JOIN assets a ON a.symbol = r.symbol""",
    "pos_raw": """SELECT CAST(c_nationkey AS BIGINT) AS portfolio_id, p_type AS symbol, sum(l_quantity) AS quantity,
        sum(l_extendedprice) AS cost_basis
        FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN part ON l_partkey=p_partkey
        JOIN customer ON c_custkey=o_custkey GROUP BY 1,2""",
    "pos": """SELECT r.portfolio_id, CAST(n_regionkey AS BIGINT) AS user_id, r.symbol, quantity, cost_basis,
        cost_basis/sum(cost_basis) OVER (PARTITION BY r.portfolio_id) AS weight,
        DATE '1995-01-02' + CAST(31*r.portfolio_id + 97*(row_number() OVER
            (PARTITION BY r.portfolio_id ORDER BY r.symbol)-1) AS INTEGER) AS purchase_date, a.asset_type
        FROM pos_raw r JOIN nation ON n_nationkey = r.portfolio_id JOIN assets a ON a.symbol = r.symbol""",
    # simple returns
    "rw": """SELECT symbol, date, price, price/nullif(lag(price) OVER (PARTITION BY symbol ORDER BY date),0)-1 AS ret
        FROM pw""",
    "rd": """SELECT symbol, date, price, price/nullif(lag(price) OVER (PARTITION BY symbol ORDER BY date),0)-1 AS ret
        FROM pdaily""",
    "rw1": "SELECT * FROM rw WHERE ret IS NOT NULL",
    "rd1": "SELECT * FROM rd WHERE ret IS NOT NULL",
    # portfolio series, constant weights, weekly closes on the dates every holding has
    "alw": """SELECT h.portfolio_id, h.symbol, p.date, p.price, h.weight, h.quantity, h.purchase_date
        FROM pos h JOIN pw p ON p.symbol = h.symbol
        QUALIFY count(*) OVER (PARTITION BY h.portfolio_id, p.date) = (SELECT count(*) FROM pos x
            WHERE x.portfolio_id = h.portfolio_id)""",
    "ald": """SELECT h.portfolio_id, h.symbol, p.date, p.price, h.weight, h.quantity, h.purchase_date
        FROM pos h JOIN pdaily p ON p.symbol = h.symbol
        QUALIFY count(*) OVER (PARTITION BY h.portfolio_id, p.date) = (SELECT count(*) FROM pos x
            WHERE x.portfolio_id = h.portfolio_id)""",
    "prw": """SELECT portfolio_id, date, sum(weight*r)/sum(weight) AS ret FROM (SELECT *, coalesce(price/lag(price) OVER
        (PARTITION BY portfolio_id, symbol ORDER BY date)-1, 0.0) AS r FROM alw) GROUP BY 1,2""",
    "prd": """SELECT portfolio_id, date, sum(weight*r)/sum(weight) AS ret FROM (SELECT *, coalesce(price/lag(price) OVER
        (PARTITION BY portfolio_id, symbol ORDER BY date)-1, 0.0) AS r FROM ald) GROUP BY 1,2""",
    "ixw": """SELECT portfolio_id, date, ret, 100*product(1+ret) OVER (PARTITION BY portfolio_id ORDER BY date
        ROWS UNBOUNDED PRECEDING) AS price FROM prw""",
    "fund": """SELECT 'P'||p_partkey AS symbol, p_name AS name,
        CASE p_type WHEN 'LARGE' THEN 'BOND' WHEN 'MEDIUM' THEN 'BOND' WHEN 'PROMO' THEN 'FUTURE'
            WHEN 'STANDARD' THEN 'ETF' ELSE 'EQUITY' END AS type,
        CASE WHEN p_partkey % 13 <> 0 THEN p_brand END AS sector,
        CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice * 1e6 END AS market_cap,
        CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS DOUBLE) END AS pe_ratio,
        p_retailprice/100 AS ev_to_ebitda, (p_partkey % 41 - 5)/100e0 AS profit_margin,
        CASE WHEN p_partkey % 11 <> 0 THEN (p_partkey % 29)/10e0 END AS beta,
        (p_partkey % 17)/200e0 AS fund_yield,
        TIMESTAMP '2024-01-01 00:00:00' + to_seconds((p_partkey % 96) * 1800) AS as_of FROM part""",
    "rules": """SELECT c_custkey AS alert_id, CAST(c_nationkey AS BIGINT) AS user_id, c_name AS name,
        CASE WHEN c_mktsegment='BUILDING' AND c_custkey%2=0 THEN 'U'||(c_custkey//10)||'-USD'
            ELSE ['ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD'][c_custkey%6+1] END AS ticker,
        CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'price_threshold' WHEN 'BUILDING' THEN 'anomaly'
            WHEN 'FURNITURE' THEN 'forecast_divergence' WHEN 'HOUSEHOLD' THEN 'regime_watch'
            WHEN 'MACHINERY' THEN 'volume_burst' END AS alert_type,
        CASE WHEN c_custkey%2=1 THEN 'below' ELSE 'above' END AS direction, c_acctbal/4 AS threshold_value,
        10 + c_custkey%50 AS lookback_days, c_acctbal > 0 AS is_active,
        CASE WHEN c_mktsegment='BUILDING' AND c_custkey%2=0 THEN 'external' END AS detector,
        CASE WHEN c_mktsegment='BUILDING' AND c_custkey%2=0 THEN (c_custkey%5)*43200 END AS cooldown_seconds,
        CASE WHEN c_mktsegment='HOUSEHOLD' THEN c_custkey%27 END AS watch_portfolio
        FROM customer""",
    "det": """SELECT event_id, ' u'||user_id||'/usd' AS symbol_raw, ts,
        CASE event_type WHEN 'view' THEN 'robust_z' WHEN 'click' THEN 'cusum' WHEN 'purchase' THEN 'volume_spike'
            WHEN 'signup' THEN 'spread_widen' WHEN 'error' THEN 'burst' END AS kind,
        CASE WHEN event_id%97=0 THEN CAST('nan' AS DOUBLE) ELSE value/10 END AS score,
        CASE WHEN event_id%101=0 THEN CAST('inf' AS DOUBLE) ELSE value END AS price,
        CASE WHEN value<10 THEN 'info' WHEN value<50 THEN 'alert' WHEN value<100 THEN 'warning'
            WHEN value<150 THEN 'anomaly' ELSE 'custom' END AS severity,
        upper(trim('u'||user_id||'-usd')) AS ticker,
        event_id%97<>0 AND event_id%101<>0 AS is_finite FROM events""",
    "fb": """SELECT event_id//3 AS event_id, user_id, CASE WHEN value>25 THEN 'useful' ELSE 'not_useful' END AS rating,
        ['ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD'][user_id%6+1] AS ticker,
        CASE event_type WHEN 'view' THEN 'robust_z' WHEN 'click' THEN 'cusum' WHEN 'purchase' THEN 'volume_spike'
            WHEN 'signup' THEN 'spread_widen' END AS kind, ts AS created_at FROM events""",
    "prefs": """SELECT c_custkey AS user_id, c_custkey%11<>0 AS email_enabled,
        ['INFO','ALERT','WARNING','ANOMALY'][c_custkey%4+1] AS min_severity, c_custkey%24 AS quiet_start,
        (c_custkey*7+3)%24 AS quiet_end, (c_custkey%5-2)*60+30 AS tz_offset_min, c_custkey%3=0 AS mutes_kinds,
        c_custkey%4=0 AS mutes_own, c_custkey%4 AS auto_mute_after FROM customer""",
    "tele": """SELECT event_id, user_id, event_type, ts AS arrived_at, value,
        CAST(json_extract_string(props,'$.k') AS INTEGER) AS k, event_id%19=0 AS broken, event_id%23<>0 AS known,
        CASE event_type WHEN 'view' THEN 'osd' WHEN 'click' THEN 'state' WHEN 'purchase' THEN 'events'
            WHEN 'signup' THEN 'requests' ELSE 'services_reply' END AS topic_type,
        'SN'||user_id AS device_sn FROM events""",
    "devices": """SELECT 'SN'||c_custkey AS serial_number, CASE WHEN c_mktsegment IN ('AUTOMOBILE','MACHINERY') THEN 'drone'
        ELSE 'dock' END AS device_kind, (CASE WHEN c_mktsegment IN ('AUTOMOBILE','MACHINERY') THEN 'D' ELSE 'K' END)||c_custkey
        AS device_id FROM customer WHERE c_mktsegment <> 'FURNITURE'""",
}


def with_ctes(sql: str) -> str:
    """Prefix ``sql`` with every table expression it (transitively) reads."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in order and re.search(rf"\b(?:FROM|JOIN|IN)\s+\(?{name}\b", text):
                visit(CTES[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    if not order:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + "\n" + sql
