"""Declared schemas of the base tables; production reads never infer."""

from __future__ import annotations

PRICES = (
    "symbol string, date date, open double, high double, low double, close double, volume double, source string, updated_at timestamp"
)
POSITIONS = (
    "portfolio_id bigint, symbol string, weight double, quantity double, cost_basis double, purchase_date date, asset_type string"
)
ASSETS = "symbol string, name string, asset_type string, asset_class string, sector string, exchange string, currency string"
ALERT_RULES = (
    "alert_id bigint, user_id bigint, name string, ticker string, alert_type string, direction string, threshold_value double, "
    "lookback_days int, is_active boolean, extra_config string"
)
ALERT_EVENTS = "event_id bigint, alert_id bigint, ticker string, alert_type string, triggered boolean, payload string, evaluated_at timestamp"
TELEMETRY_RAW = "topic string, payload string, arrived_at timestamp"
EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"

# one document per symbol; absent parts are NULL
FUNDAMENTALS_DOC = (
    "type string, profile struct<name:string,sector:string,industry:string,currency:string,exchange:string>, "
    "valuation struct<market_cap:double,pe_ratio:double,forward_pe:double,ev_to_ebitda:double>, "
    "profitability struct<profit_margin:double,roe:double,roa:double>, "
    "technicals struct<beta:double,high_52w:double,low_52w:double>, "
    "fund_metrics struct<expense_ratio:double,yield:double,net_assets:double>, "
    "bond_metrics struct<yield:double,coupon:double>"
)
QUOTE_INFO = (
    "quoteType string, longName string, sector string, industry string, currency string, exchange string, fullExchangeName string, "
    "marketCap double, trailingPE double, forwardPE double, enterpriseToEbitda double, profitMargins double, returnOnEquity double, "
    "returnOnAssets double, beta double, beta3Year double, fiftyTwoWeekHigh double, fiftyTwoWeekLow double, "
    "annualReportExpenseRatio double, `yield` double, totalAssets double, regularMarketPrice double"
)
NEWS_ITEM = (
    "title string, publisher string, link string, providerPublishTime bigint, type string, "
    "content struct<title:string,pubDate:string,contentType:string,provider:struct<displayName:string>,"
    "canonicalUrl:struct<url:string>,clickThroughUrl:struct<url:string>>"
)
