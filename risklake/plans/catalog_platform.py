"""Registered queries: sources and sinks, filters, platform joins, sorts, sets, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from risklake.functions import scalar as fn
from risklake.operators import align, metrics as m, returns, screener as scr, simulate as sim
from risklake.plans.catalog_metrics import LT
from risklake.plans.registry import register
from risklake.session import materialise
from risklake.sources import holdings_csv, market, sinks
from risklake.sources.testdata import Tables
from risklake.streaming import telemetry as tel



# ---- sources ------------------------------------------------------------------------
@register(
    "src_01_scan_period", "symbol:s date:t price:d4",
    "SELECT symbol, date, price FROM pdaily WHERE date >= DATE '2001-11-04' - 366 AND symbol IN ('ECONOMY','SMALL','STANDARD')",
)
def _(t: Tables):
    return market.scan_period(t.prices_daily, "1y", "2001-11-04", ["economy ", "SMALL", "Standard"])


@register(
    "src_02_custodian_csv", "_order:i _line:i ticker:s quantity:d2 cost_basis:d2 purchase_date:t asset_type:s",
    """SELECT l_orderkey AS _order, l_linenumber AS _line, p_type AS ticker, CASE WHEN l_linenumber=1 THEN -l_quantity WHEN l_linenumber=2 THEN 0 ELSE l_quantity END AS quantity,
       CASE WHEN l_linenumber<>3 THEN l_extendedprice ELSE 12.5e0*l_quantity END AS cost_basis, CASE WHEN l_linenumber%4<>3 THEN CAST(l_shipdate AS DATE) END AS purchase_date,
       CASE WHEN l_linenumber%2=0 THEN 'STOCK' ELSE 'EQUITY' END AS asset_type FROM lineitem JOIN part ON p_partkey=l_partkey WHERE l_returnflag<>'R'""",
)
def _(t: Tables):
    return holdings_csv.parse_holdings(_custodian_rows(t))[0]


@register("src_02_custodian_csv_skipped", "_order:i _line:i reason:s", "SELECT l_orderkey AS _order, l_linenumber AS _line, 'summary line: Total' AS reason FROM lineitem JOIN part ON p_partkey=l_partkey WHERE l_returnflag='R'")
def _(t: Tables):
    return holdings_csv.parse_holdings(_custodian_rows(t))[1]


def _custodian_rows(t: Tables):
    """Line items dressed up as a custodian file: money signs, accounting negatives, mixed dates."""
    line, cents = F.col("l_linenumber"), F.round(F.col("l_extendedprice") * 100).cast("bigint")
    qty, day = F.col("l_quantity").cast("int"), F.to_date("l_shipdate")
    layouts = F.when(line % 4 == 0, F.date_format(day, "yyyy-MM-dd")).when(line % 4 == 1, F.date_format(day, "M/d/yyyy")).when(line % 4 == 2, F.date_format(day, "d-MMM-yyyy")).otherwise("various")
    part = t.raw("part").select("p_partkey", "p_type")
    return t.raw("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("_order"), line.alias("_line"),
        F.when(F.col("l_returnflag") == "R", "Total").otherwise(F.concat(F.lit(" "), F.lower("p_type"))).alias("Symbol"),
        F.when(line == 1, F.format_string("(%d)", qty)).when(line == 2, "n/a").otherwise(qty.cast("string")).alias("Shares"),
        F.when(line != 3, F.format_string("$%,d.%02d", F.floor(cents / 100), cents % 100)).otherwise("").alias("Cost Basis"),
        F.lit("$12.50").alias("Average Cost"), layouts.alias("Date Acquired"), F.when(line % 2 == 0, "stock").alias("Security Type"),
    )


_FORMS = ["BTC-USD", " btc/usd", "ETHUSDT", "SOLUSDC", "aapl ", "VOD.L", "^GSPC"]


@register(
    "src_03_symbol_forms", "p_partkey:i canonical:s dashed:s slashed:s prefixed:s is_crypto:b",
    f"""SELECT p_partkey, upper(trim(f)) AS canonical, upper(trim(replace(f,'/','-'))) AS dashed, CASE WHEN upper(f) LIKE '%-USD' THEN replace(upper(f),'-USD','/USD') WHEN upper(f) LIKE '%USDT' THEN replace(upper(f),'USDT','/USDT')
        WHEN upper(f) LIKE '%USDC' THEN replace(upper(f),'USDC','/USDC') ELSE upper(f) END AS slashed, CASE WHEN f='^GSPC' THEN 'I:SPX' WHEN f LIKE '%-USD' THEN 'X:'||replace(f,'-USD','')||'USD' ELSE f END AS prefixed,
        upper(f) LIKE '%-USD' AS is_crypto FROM (SELECT p_partkey, {_FORMS}[p_partkey%7+1] AS f FROM part)""",
)
def _(t: Tables):
    f = F.element_at(F.array(*[F.lit(x) for x in _FORMS]), (F.col("p_partkey") % 7 + 1).cast("int"))
    return t.raw("part").select(
        "p_partkey", fn.canonical_symbol(f).alias("canonical"), fn.dashed_pair(f).alias("dashed"), fn.slashed_pair(f).alias("slashed"), fn.prefixed_pair(f).alias("prefixed"),
        fn.is_crypto_symbol(f, F.lit(None).cast("string")).alias("is_crypto"),
    )


_LISTED = "p_brand || CASE WHEN p_brand LIKE '%1' THEN '.L' WHEN p_brand LIKE '%2' THEN '.hk' ELSE '' END"


@register(
    "src_04_route_by_suffix", "symbol:s date:t price:d4 source:s",
    f"""WITH b AS (SELECT {_LISTED} AS symbol, p_brand, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, sum(l_extendedprice)/sum(l_quantity) AS price FROM lineitem JOIN part ON p_partkey=l_partkey GROUP BY 1,2,3)
        SELECT symbol, date, price, CASE WHEN upper(symbol) LIKE '%.L' OR upper(symbol) LIKE '%.HK' OR p_brand IN ('Brand#13','Brand#14') THEN 'secondary' ELSE 'primary' END AS source FROM b""",
)
def _(t: Tables):
    brand = F.col("p_brand")
    listed = F.concat(brand, F.when(brand.endswith("1"), ".L").when(brand.endswith("2"), ".hk").otherwise(""))
    part = t.raw("part").select("p_partkey", "p_brand", listed.alias("symbol"))
    bars = t.raw("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("symbol", "p_brand", F.trunc("l_shipdate", "month").alias("date")).agg(
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price")
    )
    primary = bars.where(~F.col("p_brand").isin("Brand#13", "Brand#14")).drop("p_brand")
    return market.route_with_fallback(primary, bars.drop("p_brand"))


@register(
    "src_05_latest_wins_upsert", "symbol:s date:t open:d4 high:d4 close:d4 source:s",
    """SELECT symbol, date, CASE WHEN date>=DATE '2001-01-01' THEN price*1.01e0 ELSE price END AS open, CASE WHEN date>=DATE '2001-01-01' THEN price*1.02e0 ELSE price END AS high,
       CASE WHEN date>=DATE '2001-01-01' THEN price*1.01e0 ELSE price END AS close, CASE WHEN date>=DATE '2001-01-01' THEN 'feed' ELSE 'base' END AS source FROM pw""",
)
def _(t: Tables):
    p = t.prices_weekly
    bar = lambda k, src, at: p.select(
        "symbol", "date", F.lit(None).cast("double").alias("open"), (F.col("price") * (k + 0.01 if k > 1 else k)).alias("high"), F.lit(None).cast("double").alias("low"),
        (F.col("price") * k).alias("close"), "volume", F.lit(src).alias("source"), F.lit(at).cast("timestamp").alias("updated_at"),
    )
    base = bar(1.0, "base", "2024-01-01").withColumns({"open": F.col("close"), "low": F.col("close")})
    newest = bar(1.01, "feed", "2024-01-03").where("date >= date'2001-01-01'")
    older = bar(3.0, "late", "2024-01-02").where("date >= date'2001-01-01'")
    return market.upsert_bars(base, older.unionByName(newest))


@register(
    "src_06_latest_quote", "symbol:s last_price:d4 change_pct:d4 as_of:ts",
    """SELECT 'U'||user_id AS symbol, arg_max(value, arrived_at) AS last_price, arg_max(CASE WHEN k=0 THEN 0 ELSE (value-k)/k*100 END, arrived_at) AS change_pct, max(arrived_at) AS as_of FROM tele
       WHERE event_id%31<>0 AND value<>0 GROUP BY 1""",
)
def _(t: Tables):
    return market.latest_quotes(market.with_change_pct(_quotes(t)))


def _quotes(t: Tables):
    return t.raw("events").select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"), F.when(F.col("event_id") % 31 == 0, 0.0).otherwise(F.col("value")).alias("last_price"),
        F.get_json_object("props", "$.k").cast("double").alias("prev_close"), F.col("ts").alias("as_of"), "event_id",
    )


@register(
    "src_07_quote_change_pct", "event_id:i change_pct:d4",
    "SELECT event_id, CASE WHEN event_id%31=0 OR value=0 OR k=0 THEN 0 ELSE (value-k)/k*100 END AS change_pct FROM tele",
)
def _(t: Tables):
    return market.with_change_pct(_quotes(t))


def _vendor_documents(t: Tables):
    """Fundamentals as the vendor would send them: one JSON document per company."""
    f = t.fundamentals
    kind = F.when(F.col("type") == "BOND", "EQUITY").otherwise(F.col("type"))
    info = F.struct(
        kind.alias("quoteType"), F.when(F.col("type") == "BOND", F.concat(F.lit("Treasury "), "name")).otherwise(F.col("name")).alias("longName"), F.col("sector"),
        F.col("market_cap").alias("marketCap"), F.col("pe_ratio").alias("trailingPE"), F.col("ev_to_ebitda").alias("enterpriseToEbitda"), F.col("profit_margin").alias("profitMargins"),
        F.col("beta"), F.col("beta").alias("beta3Year"), F.col("fund_yield").alias("yield"),
    )
    return f.select("symbol", "as_of", F.to_json(info).alias("info"))


@register(
    "src_08_fundamentals_normalise", "symbol:s type:s sector:s market_cap:d0 pe_ratio:d2 beta:d2 fund_yield:d4 bond_yield:d4",
    """SELECT symbol, CASE WHEN type='BOND' THEN 'EQUITY' ELSE type END AS type, coalesce(sector,'Unknown') AS sector, CASE WHEN type='EQUITY' THEN coalesce(market_cap,0) END AS market_cap,
       CASE WHEN type='EQUITY' THEN coalesce(pe_ratio,0) END AS pe_ratio, CASE WHEN type IN ('EQUITY','ETF') THEN coalesce(beta,1) END AS beta, CASE WHEN type='ETF' THEN fund_yield END AS fund_yield,
       CASE WHEN type IN ('BOND','FUTURE') THEN fund_yield END AS bond_yield FROM fund""",
)
def _(t: Tables):
    d = market.normalise_fundamentals(_vendor_documents(t))
    return d.select(
        "symbol", "doc.type", "doc.profile.sector", "doc.valuation.market_cap", "doc.valuation.pe_ratio", "doc.technicals.beta", F.col("doc.fund_metrics.yield").alias("fund_yield"),
        F.col("doc.bond_metrics.yield").alias("bond_yield"),
    )


@register(
    "src_09_latest_snapshot", "symbol:s as_of:ts market_cap:d0 freshness:s",
    """SELECT symbol, as_of, market_cap, CASE WHEN date_diff('second', as_of, TIMESTAMP '2024-01-03 06:00:00') <= 86400 THEN 'fresh' ELSE 'stale' END AS freshness FROM fund""",
)
def _(t: Tables):
    f = t.fundamentals.select("symbol", "as_of", "market_cap")
    older = f.select("symbol", (F.col("as_of") - F.expr("interval 3 days")).alias("as_of"), F.lit(1.0).alias("market_cap"))
    return market.latest_within(f.unionByName(older), F.lit("2024-01-03 06:00:00").cast("timestamp"))


@register(
    "src_10_news_items", "symbol:s pos:i title:s publisher:s link:s timestamp:s type:s",
    """SELECT 'D'||doc_id AS symbol, 0 AS pos, text AS title, source AS publisher, 'http://n/'||doc_id AS link, '2024-01-05 10:30' AS timestamp, 'VIDEO' AS type FROM documents
       UNION ALL SELECT 'D'||doc_id, 1, lang, 'Wire', '#', '2024-01-01 00:00', 'STORY' FROM documents""",
)
def _(t: Tables):
    d = t.raw("documents")
    nested = F.struct(
        F.struct(
            F.col("text").alias("title"), F.lit("2024-01-05T10:30:00Z").alias("pubDate"), F.lit("VIDEO").alias("contentType"), F.struct(F.col("source").alias("displayName")).alias("provider"),
            F.struct(F.concat(F.lit("http://n/"), F.col("doc_id").cast("string")).alias("url")).alias("canonicalUrl"),
        ).alias("content")
    )
    legacy = F.struct(F.col("lang").alias("title"), F.lit("Wire").alias("publisher"), F.lit(1704067200).cast("bigint").alias("providerPublishTime"))
    items = F.concat(F.lit("["), F.to_json(nested), F.lit(","), F.to_json(legacy), F.lit("]"))
    raw = d.select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("symbol"), items.alias("items"))
    return market.normalise_news(raw, limit=5)


@register(
    "src_11_cache_state", "event_id:i state:s",
    """SELECT event_id, CASE WHEN event_id%29=0 THEN 'miss' WHEN (event_id%2=0 AND ts + INTERVAL 10 DAY >= TIMESTAMP '2024-01-20 00:00:00') OR date_diff('second', CAST('1970-01-01' AS TIMESTAMP), TIMESTAMP '2024-01-20 00:00:00')
       - date_diff('second', CAST('1970-01-01' AS TIMESTAMP), ts) <= 86400 THEN 'fresh' ELSE 'stale' END AS state FROM events""",
)
def _(t: Tables):
    eid = F.col("event_id")
    rows = t.raw("events").select(
        "event_id", F.when(eid % 29 != 0, F.col("ts")).alias("created_at"), F.when((eid % 2 == 0) & (eid % 29 != 0), F.col("ts") + F.expr("interval 10 days")).alias("expires_at")
    )
    return market.cache_state(rows, F.lit("2024-01-20").cast("timestamp"), 86400.0)


@register(
    "src_12_csv_export", "c_custkey:i line:s",
    "SELECT c_custkey, c_custkey||',\"'||c_name||', \"\"'||c_mktsegment||'\"\"\",'||CASE WHEN c_nationkey<5 THEN '' ELSE CAST(c_nationkey AS VARCHAR) END AS line FROM customer",
)
def _(t: Tables):
    c = t.raw("customer").select(
        "c_custkey", F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')).alias("label"), F.when(F.col("c_nationkey") >= 5, F.col("c_nationkey")).alias("nation")
    )
    return sinks.csv_lines(c)


@register(
    "src_13_json_safe_export", "event_id:i score:d4 price:d2 json:s",
    """SELECT event_id, CASE WHEN isfinite(score) THEN score ELSE 0 END AS score, CASE WHEN isfinite(price) THEN price ELSE 0 END AS price, CAST(json_object('event_id', event_id, 'kind', kind) AS VARCHAR) AS json FROM det""",
)
def _(t: Tables):
    safe = market.json_safe(t.detections, ["score", "price"])
    return safe.withColumn("json", F.to_json(F.struct("event_id", "kind")))


@register(
    "src_14_telemetry_source", "topic_type:s n:i",
    "SELECT CASE WHEN known THEN topic_type END AS topic_type, count(*) AS n FROM tele GROUP BY 1",
)
def _(t: Tables):
    return tel.parse_topics(t.telemetry).groupBy("topic_type").agg(F.count("*").alias("n"))


@register(
    "src_15_bounded_streams", "stream:s event_id:i",
    "SELECT topic_type AS stream, event_id FROM tele WHERE known QUALIFY row_number() OVER (PARTITION BY topic_type ORDER BY arrived_at DESC, event_id DESC) <= 10000",
)
def _(t: Tables):
    log = tel.parse_topics(t.telemetry).where("topic_type is not null").withColumnRenamed("topic_type", "stream")
    return sinks.trim_streams(log)


# ---- filters -------------------------------------------------------------------------
def _screen_rows(t: Tables):
    return scr.screener_rows(market.normalise_fundamentals(_vendor_documents(t)))


_SCREEN_SQL = """(SELECT symbol AS ticker, CASE WHEN type='BOND' THEN 'EQUITY' ELSE type END AS type, CASE WHEN type='BOND' THEN 'Treasury '||name ELSE name END AS name, coalesce(sector,'Unknown') AS sector, CASE WHEN type='EQUITY' THEN coalesce(market_cap,0) END AS market_cap,
    CASE WHEN type='EQUITY' THEN coalesce(pe_ratio,0) END AS pe_ratio, CASE WHEN type='EQUITY' THEN ev_to_ebitda END AS ev_to_ebitda, CASE WHEN type='EQUITY' THEN profit_margin END AS profit_margin,
    CASE WHEN type IN ('EQUITY','ETF') THEN coalesce(beta,1) END AS beta FROM fund)"""


@register(
    "flt_01_screener", "ticker:s sector:s market_cap:d0 pe_ratio:d2 beta:d2 hits:i",
    f"""SELECT *, count(*) OVER () AS hits FROM {_SCREEN_SQL} WHERE market_cap>=9.2e8 AND market_cap<=9.95e8 AND pe_ratio>=5 AND pe_ratio<=45 AND profit_margin>=0 AND beta<=2.5 AND lower(sector) IN ('brand#3','brand#4','brand#5','unknown') AND upper(type)='EQUITY'""",
)
def _(t: Tables):
    return scr.run_screen(_screen_rows(t), {
        "min_market_cap": 9.2e8, "max_market_cap": 9.95e8, "min_pe_ratio": 5, "max_pe_ratio": 45, "min_profit_margin": 0, "max_beta": 2.5,
        "sector_in": ["Brand#3", "BRAND#4", "brand#5", "unknown"], "type_in": ["equity"],
    }, limit=None)


@register("flt_02_screener_projection", "ticker:s type:s name:s sector:s market_cap:d0 pe_ratio:d2 ev_to_ebitda:d4 profit_margin:d4 beta:d2", f"SELECT * FROM {_SCREEN_SQL}")
def _(t: Tables):
    return _screen_rows(t)


@register(
    "flt_03_saved_screens", "screen_id:i ticker:s",
    f"""SELECT n_nationkey AS screen_id, ticker FROM nation JOIN {_SCREEN_SQL} s ON pe_ratio>=n_nationkey AND (n_nationkey%2=0 OR upper(type)='EQUITY') AND (n_nationkey%3<>0 OR lower(sector)='brand#'||n_nationkey) AND beta<=2""",
)
def _(t: Tables):
    key = F.col("n_nationkey")
    filters = F.concat(
        F.format_string('{"min_pe_ratio":%d,"max_beta":2', key), F.when(key % 2 == 1, F.lit(',"type_in":["equity"]')).otherwise(""),
        F.when(key % 3 == 0, F.format_string(',"sector_in":["BRAND#%d"]', key)).otherwise(""), F.lit("}"),
    )
    screens = t.raw("nation").select(key.cast("long").alias("screen_id"), filters.alias("filters"))
    return scr.apply_saved_screens(screens, _screen_rows(t))


@register(
    "flt_04_registry_search", "symbol:s name:s",
    "SELECT symbol, name FROM fund WHERE contains(symbol,'RING') OR contains(name,'ring') ORDER BY symbol LIMIT 50",
)
def _(t: Tables):
    return scr.search_registry(t.fundamentals, " ring", 50)


@register(
    "flt_05_price_hygiene", "symbol:s date:t price:d4",
    """SELECT p_type AS symbol, CAST(l_shipdate AS DATE) AS date, arg_max(l_extendedprice, l_orderkey*100+l_linenumber) AS price FROM lineitem JOIN part ON p_partkey=l_partkey
       WHERE l_returnflag<>'R' AND l_extendedprice > 0 AND l_linenumber<>2 GROUP BY 1,2""",
)
def _(t: Tables):
    part = t.raw("part").select("p_partkey", F.col("p_type").alias("symbol"))
    text = F.when(F.col("l_returnflag") == "R", "n/a").when(F.col("l_linenumber") == 2, F.lit("-5")).otherwise(F.col("l_extendedprice").cast("string"))
    raw = t.raw("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "symbol", F.to_date("l_shipdate").alias("date"), text.alias("price"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("updated_at")
    )
    return align.clean_prices(raw)


@register(
    "flt_06_position_violations", "portfolio_id:i rule:s symbol:s",
    """WITH p AS (SELECT portfolio_id, symbol, weight FROM posc UNION ALL SELECT portfolio_id, '' , 0.0 FROM posc WHERE weight>0.95 UNION ALL SELECT portfolio_id, symbol, -weight FROM posc WHERE weight<0.005
         UNION ALL SELECT portfolio_id, symbol, weight FROM posc WHERE weight BETWEEN 0.3 AND 0.31),
       g AS (SELECT portfolio_id, symbol, count(*) AS n, min(weight) AS lo, sum(weight) AS w FROM p GROUP BY 1,2)
       SELECT portfolio_id, 'blank_ticker' AS rule, symbol FROM g WHERE symbol='' UNION ALL SELECT portfolio_id, 'duplicate_ticker', symbol FROM g WHERE symbol<>'' AND n>1
       UNION ALL SELECT portfolio_id, 'negative_weight', symbol FROM g WHERE lo<0 UNION ALL SELECT portfolio_id, 'weights_do_not_sum_to_one', NULL FROM g GROUP BY 1 HAVING sum(w)>0 AND abs(sum(w)-1)>0.01""",
    store="positions_by_customer",
)
def _(t: Tables):
    p = t.positions_by_customer.select("portfolio_id", "symbol", "weight")
    odd = p.where("weight > 0.95").select("portfolio_id", F.lit("  ").alias("symbol"), F.lit(0.0).alias("weight"))
    short = p.where("weight < 0.005").select("portfolio_id", F.lower("symbol").alias("symbol"), (-F.col("weight")).alias("weight"))
    twice = p.where("weight between 0.3 and 0.31")
    return scr.position_violations(p.unionByName(odd).unionByName(short).unionByName(twice))


@register(
    "flt_08_market_hours", "event_id:i is_open:b",
    """SELECT event_id, isodow(l) BETWEEN 1 AND 5 AND hour(l)*60+minute(l) BETWEEN 570 AND 960 AS is_open FROM (SELECT event_id, ts - INTERVAL 5 HOUR AS l FROM events)""",
)
def _(t: Tables):
    return t.raw("events").select("event_id", fn.market_is_open("ts").alias("is_open"))


@register(
    "flt_09_return_clamp", "symbol:s date:t clamped:d6",
    "SELECT symbol, date, CASE WHEN abs(ret)<=2 THEN ret ELSE 0 END AS clamped FROM rd1",
)
def _(t: Tables):
    return returns.simple_returns(t.prices_daily).withColumn("clamped", fn.clamp_return(F.col("ret")))


@register("flt_10_finite_guard", "event_id:i accepted:b", "SELECT event_id, is_finite AS accepted FROM det")
def _(t: Tables):
    from risklake.operators.alerts import canonical_detections

    good, bad = canonical_detections(t.detections)
    return good.select("event_id", F.lit(True).alias("accepted")).unionByName(bad.select("event_id", F.lit(False).alias("accepted")))


# ---- joins -----------------------------------------------------------------------------
@register(
    "join_14_snapshot_in_month", "symbol:s month:t fragility:d6",
    """SELECT 'U'||user_id AS symbol, date_trunc('month', ts) AS month, arg_max(value, ts) AS fragility FROM events GROUP BY 1,2""",
)
def _(t: Tables):
    snaps = t.raw("events").select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"), F.col("ts").alias("date"), F.col("value").alias("fragility"))
    one = snaps.select("symbol").distinct().select(F.col("symbol").alias("portfolio_id"), "symbol", F.lit(1.0).alias("weight"))
    return m.monthly_fragility(one, snaps).withColumnRenamed("portfolio_id", "symbol")


@register(
    "join_16_trade_list", "portfolio_id:i symbol:s action:s value:d2 shares:i",
    f"""WITH a AS (SELECT portfolio_id, symbol, weight FROM posc WHERE symbol<>'LARGE'), b AS (SELECT portfolio_id, symbol, weight*1.002 AS weight FROM posc WHERE symbol<>'SMALL'),
        j AS (SELECT coalesce(a.portfolio_id,b.portfolio_id) AS portfolio_id, coalesce(a.symbol,b.symbol) AS symbol, coalesce(b.weight,0)-coalesce(a.weight,0) AS d FROM a FULL JOIN b ON a.portfolio_id=b.portfolio_id AND a.symbol=b.symbol)
        SELECT portfolio_id, j.symbol, CASE WHEN abs(d)<0.001 THEN 'Hold' WHEN d>0 THEN 'Buy' ELSE 'Sell' END AS action, CASE WHEN abs(d)<0.001 THEN 0 ELSE abs(d)*1e6 END AS value,
        CASE WHEN abs(d)>=0.001 THEN floor(abs(d)*1e6/latest) END AS shares FROM j LEFT JOIN {LT} c ON c.symbol=j.symbol""",
)
def _(t: Tables):
    p = t.positions_by_customer.select("portfolio_id", "symbol", "weight")
    after = p.where("symbol <> 'SMALL'").withColumn("weight", F.col("weight") * 1.002)
    return scr.trade_list(p.where("symbol <> 'LARGE'"), after, m.latest_two_closes(t.prices_daily), 1e6)


@register(
    "join_19_cached_match", "portfolio_id:i cache_id:i",
    """WITH p AS (SELECT portfolio_id, symbol, weight AS w, count(*) OVER (PARTITION BY portfolio_id) AS n, CAST(floor(min(weight) OVER (PARTITION BY portfolio_id)/0.02) AS BIGINT) AS g FROM posc),
       c AS (SELECT portfolio_id AS cache_id, symbol, round_even(weight,2) AS w, count(*) OVER (PARTITION BY portfolio_id) AS n, CAST(floor(min(round_even(weight,2)) OVER (PARTITION BY portfolio_id)/0.02) AS BIGINT) AS g FROM posc)
       SELECT p.portfolio_id, c.cache_id FROM p JOIN c ON p.symbol=c.symbol AND p.n=c.n AND c.g BETWEEN p.g-2 AND p.g+2 GROUP BY 1,2,p.n HAVING count(*)=p.n AND bool_and(abs(p.w-c.w)<=0.02)""",
)
def _(t: Tables):
    p = materialise(t.positions_by_customer.select("portfolio_id", "symbol", "weight"), "positions")
    cached = p.select(F.col("portfolio_id").alias("cache_id"), "symbol", F.bround("weight", 2).alias("weight"))
    return scr.matching_cached_results(p, cached)


@register(
    "join_19_newest_cached", "portfolio_id:i cache_id:i created_at:t",
    """WITH c AS (SELECT portfolio_id, portfolio_id*3+k AS cache_id, DATE '2024-01-01'+CAST((portfolio_id+k*k)%5 AS INTEGER) AS created_at, symbol, round_even(weight,2)*CASE WHEN k=2 THEN 1.1e0 ELSE 1e0 END AS w FROM posc, (VALUES (0),(1),(2)) v(k)
         WHERE NOT (k=1 AND portfolio_id%2=0 AND symbol='LARGE')),
       p AS (SELECT portfolio_id, symbol, weight AS w, count(*) OVER (PARTITION BY portfolio_id) AS n FROM posc),
       f AS (SELECT c.portfolio_id, cache_id, created_at FROM c LEFT JOIN p ON p.portfolio_id=c.portfolio_id AND p.symbol=c.symbol GROUP BY 1,2,3 HAVING count(*)=max(p.n) AND bool_and(abs(p.w-c.w)<=0.02))
       SELECT portfolio_id, cache_id, created_at FROM f QUALIFY row_number() OVER (PARTITION BY portfolio_id ORDER BY created_at DESC, cache_id DESC)=1""",
    store="positions_by_customer",
)
def _(t: Tables):
    # three stored results a portfolio, of different days: as it is, without a holding in every second book, and with weights moved by a tenth
    p = t.positions_by_customer
    runs = p.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where("not (k = 1 and portfolio_id % 2 = 0 and symbol = 'LARGE')")
    day = F.date_add(F.lit("2024-01-01").cast("date"), ((F.col("portfolio_id") + F.col("k") * F.col("k")) % 5).cast("int"))
    weight = F.bround("weight", 2) * F.when(F.col("k") == 2, 1.1).otherwise(1.0)
    cached = runs.select("portfolio_id", (F.col("portfolio_id") * 3 + F.col("k")).alias("cache_id"), day.alias("created_at"), "symbol", weight.alias("weight"))
    return scr.newest_cached_result(p.select("portfolio_id", "symbol", "weight"), cached)


_DEFROWS = ", ".join(f"('{n}')" for n in ["base", *sim.BUILTIN_SCENARIOS])


@register(
    "join_17_batch_grid", "symbol:s window:i scenario:s",
    f"""SELECT symbol, w AS "window", s AS scenario FROM assets, (VALUES (30),(60),(90)) a(w), (VALUES {_DEFROWS}) b(s)""",
)
def _(t: Tables):
    grid = t.assets.withColumn("window", F.explode(F.array(*[F.lit(w) for w in (30, 60, 90)])))
    return grid.withColumn("scenario", F.explode(F.array(*[F.lit(n) for n in ["base", *sim.BUILTIN_SCENARIOS]])))


# ---- sorts and sets ----------------------------------------------------------------------
@register("srt_01_newest_first_capped", "event_id:i ts:ts value:d2", "SELECT event_id, ts, value FROM events ORDER BY events.ts DESC, event_id DESC LIMIT 100")
def _(t: Tables):
    return t.raw("events").orderBy(F.desc("ts"), F.desc("event_id")).limit(100)


@register("srt_02_latest_per_key", "user_id:i event_id:i value:d2", "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY events.ts DESC, event_id DESC)=1")
def _(t: Tables):
    newest = F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("e")
    return t.raw("events").groupBy("user_id").agg(newest).select("user_id", "e.*")


@register(
    "srt_03_top_k_per_group", "portfolio_id:i symbol:s weight:d6",
    "SELECT portfolio_id, symbol, weight FROM posc QUALIFY row_number() OVER (PARTITION BY portfolio_id ORDER BY weight DESC, symbol) <= 3",
)
def _(t: Tables):
    from pyspark.sql.window import Window as W

    rn = F.row_number().over(W.partitionBy("portfolio_id").orderBy(F.desc("weight"), "symbol"))
    return t.positions_by_customer.withColumn("rn", rn).where("rn <= 3")


@register("srt_04_table_sort", "c_custkey:i c_acctbal:d2", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")
def _(t: Tables):
    return t.raw("customer").orderBy(F.desc("c_acctbal"), "c_custkey")


@register("srt_05_offset_paging", "event_id:i", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100")
def _(t: Tables):
    return t.raw("events").orderBy(F.desc("ts"), F.desc("event_id")).offset(100).limit(50)


@register("set_01_date_union", "portfolio_id:i date:t", "SELECT DISTINCT portfolio_id, date FROM pos JOIN pdaily ON pdaily.symbol=pos.symbol")
def _(t: Tables):
    """Dates on which any holding of a portfolio has a price."""
    return t.positions.select("portfolio_id", "symbol").join(t.prices_daily, "symbol").select("portfolio_id", "date").distinct()


@register(
    "set_02_date_intersection", "portfolio_id:i date:t",
    """SELECT portfolio_id, date FROM (SELECT *, count(*) OVER (PARTITION BY portfolio_id) AS held FROM pos) o JOIN pdaily ON pdaily.symbol=o.symbol
       GROUP BY portfolio_id, date, held HAVING count(*)=held""",
)
def _(t: Tables):
    """Dates on which all holdings of a portfolio have one."""
    held = t.positions.select("portfolio_id", "symbol")
    n = held.groupBy("portfolio_id").agg(F.count("*").alias("held"))
    dates = held.join(t.prices_daily, "symbol").groupBy("portfolio_id", "date").agg(F.count("*").alias("priced"))
    return dates.join(n, "portfolio_id").where("priced = held").select("portfolio_id", "date")


@register(
    "set_03_ticker_difference", "symbol:s side:s",
    """SELECT symbol, 'only_held' AS side FROM (SELECT symbol FROM posc WHERE weight>0.5 EXCEPT SELECT ticker FROM rules WHERE alert_type='anomaly') UNION ALL
       SELECT symbol, 'overlap' FROM (SELECT symbol FROM posc WHERE weight>0.5 INTERSECT SELECT ticker FROM rules WHERE alert_type='anomaly')""",
)
def _(t: Tables):
    held = t.positions_by_customer.where("weight > 0.5").select("symbol").distinct()
    watched = t.alert_rules.where("alert_type = 'anomaly'").select(F.col("ticker").alias("symbol")).distinct()
    only = held.join(watched, "symbol", "left_anti").withColumn("side", F.lit("only_held"))
    return only.unionByName(held.intersect(watched).withColumn("side", F.lit("overlap")))


@register(
    "set_04_ticker_set_equality", "portfolio_id:i same:b",
    """SELECT a.portfolio_id, a.s=b.s AS same FROM (SELECT portfolio_id, list(symbol ORDER BY symbol) AS s FROM posc WHERE quantity>50 GROUP BY 1) a JOIN
       (SELECT portfolio_id, list(symbol ORDER BY symbol) AS s FROM posc WHERE cost_basis>80000 GROUP BY 1) b ON a.portfolio_id=b.portfolio_id""",
)
def _(t: Tables):
    p = t.positions_by_customer
    return scr.same_ticker_set(p.where("quantity > 50"), p.where("cost_basis > 80000"), "portfolio_id")


# ---- scalar functions ----------------------------------------------------------------------
@register(
    "fn_01_clean_number", "l_orderkey:i l_linenumber:i number:d2",
    """SELECT l_orderkey, l_linenumber, CASE l_linenumber%5 WHEN 0 THEN l_extendedprice WHEN 1 THEN -l_extendedprice WHEN 2 THEN l_discount*100 END AS number FROM lineitem""",
)
def _(t: Tables):
    line, cents = F.col("l_linenumber"), F.round(F.col("l_extendedprice") * 100).cast("bigint")
    money = F.format_string("$%,d.%02d", F.floor(cents / 100), cents % 100)
    text = (
        F.when(line % 5 == 0, money).when(line % 5 == 1, F.concat(F.lit(" ("), money, F.lit(") "))).when(line % 5 == 2, F.format_string("%d%%", F.round(F.col("l_discount") * 100).cast("int")))
        .when(line % 5 == 3, "N/A").otherwise("abc")
    )
    return t.raw("lineitem").select("l_orderkey", "l_linenumber", fn.clean_number(text).alias("number"))


_STRF = ["%Y-%m-%d", "%m/%d/%Y", "%m/%d/%y", "%d/%m/%Y", "%d-%b-%Y", "%b %d, %Y", "%m-%d-%Y", "%Y/%m/%d"]
_FMT = ["yyyy-MM-dd", "MM/dd/yyyy", "MM/dd/yy", "dd/MM/yyyy", "dd-MMM-yyyy", "MMM dd, yyyy", "MM-dd-yyyy", "yyyy/MM/dd"]


@register(
    "fn_02_parse_date", "l_orderkey:i l_linenumber:i day:t",
    "SELECT l_orderkey, l_linenumber, coalesce("
    + ", ".join(f"CASE WHEN {'NOT ' if 'Y' not in f else ''}regexp_matches(s,'[0-9]{{4}}') THEN try_strptime(s,'{f}') END" for f in _STRF) + ") AS day FROM (SELECT *, CASE l_orderkey%8 "
    + " ".join(f"WHEN {i} THEN strftime(l_shipdate,'{f}')" for i, f in enumerate(_STRF)) + " END AS s FROM lineitem)",
)
def _(t: Tables):
    text = F.lit(None).cast("string")
    for i, f in enumerate(_FMT):
        text = F.when(F.col("l_orderkey") % 8 == i, F.date_format("l_shipdate", f)).otherwise(text)
    return t.raw("lineitem").select("l_orderkey", "l_linenumber", fn.parse_date(text).alias("day"))


@register(
    "fn_03_total_cost", "l_orderkey:i l_linenumber:i cost:d2",
    "SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber>2 THEN l_extendedprice END, CASE WHEN l_quantity<>25 THEN 2*l_quantity END) AS cost FROM lineitem",
)
def _(t: Tables):
    qty = F.when(F.col("l_quantity") == 25, 0.0).otherwise(F.col("l_quantity"))
    return t.raw("lineitem").select("l_orderkey", "l_linenumber", fn.total_cost(F.when(F.col("l_linenumber") > 2, F.col("l_extendedprice")), F.lit(2.0), qty).alias("cost"))


@register(
    "fn_04_standard_moments", "symbol:s mean:d6 variance:d6 skew:d5 kurtosis:d5 skew_corrected:d5 kurtosis_corrected:d5",
    """SELECT symbol, any_value(mu) AS mean, avg(pow(ret-mu,2)) AS variance, avg(pow(ret-mu,3))/pow(avg(pow(ret-mu,2)),1.5) AS skew, avg(pow(ret-mu,4))/pow(avg(pow(ret-mu,2)),2)-3 AS kurtosis,
       skewness(ret) AS skew_corrected, kurtosis(ret) AS kurtosis_corrected FROM (SELECT *, avg(ret) OVER (PARTITION BY symbol) AS mu FROM rd1) GROUP BY 1""",
)
def _(t: Tables):
    from risklake.functions.stats import sample_excess_kurtosis, sample_skew

    r = F.col("ret")
    return returns.simple_returns(t.prices_daily).groupBy("symbol").agg(
        F.avg(r).alias("mean"), F.var_pop(r).alias("variance"), F.skewness(r).alias("skew"), F.kurtosis(r).alias("kurtosis"), sample_skew(r).alias("skew_corrected"),
        sample_excess_kurtosis(r).alias("kurtosis_corrected"),
    )


@register(
    "fn_05_stable_hash", "c_custkey:i digest:s short:s",
    """SELECT c_custkey, sha256(j) AS digest, substr(sha256(j),1,16) AS short FROM (SELECT c_custkey, '{"c_custkey":'||c_custkey||',"c_mktsegment":"'||c_mktsegment||'","c_name":"'||c_name||'"}' AS j FROM customer)""",
)
def _(t: Tables):
    keys = ["c_name", "c_custkey", "c_mktsegment"]
    return t.raw("customer").select("c_custkey", fn.stable_hash(*keys).alias("digest"), fn.stable_hash(*keys, length=16).alias("short"))


_HITS = lambda ws: "+".join(f"CAST(contains(lower(text),'{w}') AS INTEGER)" for w in ws)


@register(
    "fn_06_sentiment", "doc_id:i sentiment:s",
    f"SELECT doc_id, CASE WHEN u>d THEN 'Bullish' WHEN d>u THEN 'Bearish' ELSE 'Neutral' END AS sentiment FROM (SELECT doc_id, {_HITS(fn.BULLISH_WORDS)} AS u, {_HITS(fn.BEARISH_WORDS)} AS d FROM documents)",
)
def _(t: Tables):
    return t.raw("documents").select("doc_id", fn.headline_sentiment("text").alias("sentiment"))


@register(
    "fn_07_formatting", "c_custkey:i money:s pct:s",
    """SELECT c_custkey, CASE WHEN v<0 THEN '-' ELSE '' END||'$'||CASE WHEN abs(v)>=1e6 THEN printf('%.2f',abs(v)/1e6)||'M' WHEN abs(v)>=1e3 THEN printf('%.0f',abs(v)/1e3)||'K' ELSE printf('%.0f',abs(v)) END AS money,
       CASE WHEN v>=0 THEN '+' ELSE '' END||printf('%.2f',v/1e4*100)||'%' AS pct FROM (SELECT c_custkey, c_acctbal*137.0371e0 AS v FROM customer)""",
)
def _(t: Tables):
    v = F.col("c_acctbal") * 137.0371
    return t.raw("customer").select("c_custkey", fn.compact_money(v).alias("money"), fn.signed_percent(v / 1e4).alias("pct"))


@register(
    "fn_08_email_validity", "email:s valid:b n:i",
    """SELECT email, regexp_full_match(email, '[^@\\s]+@[^@\\s]+\\.[^@\\s]+') AS valid, count(*) AS n FROM (SELECT lower(trim(CASE c_custkey%3 WHEN 0 THEN ' User'||c_nationkey||'@Mail.example.com' WHEN 1 THEN 'user'||c_nationkey||'@mail'
       ELSE 'no at '||c_nationkey END)) AS email FROM customer) GROUP BY 1,2""",
)
def _(t: Tables):
    key, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    text = F.when(key % 3 == 0, F.concat(F.lit(" User"), n, F.lit("@Mail.example.com"))).when(key % 3 == 1, F.concat(F.lit("user"), n, F.lit("@mail"))).otherwise(F.concat(F.lit("no at "), n))
    rows = t.raw("customer").select(F.lower(F.trim(text)).alias("email"))
    return rows.groupBy("email", fn.is_email("email").alias("valid")).agg(F.count("*").alias("n"))


@register(
    "fn_09_age_label", "event_id:i label:s",
    """SELECT event_id, CASE WHEN s<60 THEN 'just now' WHEN s<3600 THEN (s//60)||'m ago' WHEN s<86400 THEN (s//3600)||'h ago' ELSE (s//86400)||'d ago' END AS label FROM
       (SELECT event_id, greatest(0, CAST(epoch(TIMESTAMP '2024-01-15 00:00:00') AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT)) AS s FROM events)""",
)
def _(t: Tables):
    return t.raw("events").select("event_id", fn.age_label("ts", F.lit("2024-01-15").cast("timestamp")).alias("label"))


@register(
    "fn_10_last_finite", "event_id:i last:d4",
    "SELECT event_id, CASE WHEN event_id%3=0 THEN value ELSE value*2 END AS last FROM events",
)
def _(t: Tables):
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    second = F.when(F.col("event_id") % 3 == 0, nan).otherwise(F.col("value") * 2)
    return t.raw("events").select("event_id", fn.last_finite(F.array("value", second, inf, F.lit(None).cast("double"))).alias("last"))


