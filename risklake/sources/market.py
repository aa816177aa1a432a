"""Market-data scans and upserts: bars, quotes, fundamentals, news, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from risklake import schemas
from risklake.functions.scalar import finite_or_zero, has_foreign_suffix, headline_sentiment

# Look-back of each period label, in days.
PERIOD_DAYS = {
    "1d": 1, "5d": 5, "1mo": 31, "3mo": 93, "6mo": 186, "1y": 366, "2y": 732, "5y": 1830, "10y": 3660, "ytd": 366, "max": 36500,
}
DEFAULT_PERIOD = "2y"


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PRICES).parquet(path)


def scan_period(prices: DataFrame, period: str, as_of: str | Column, symbols: list[str] | None = None) -> DataFrame:
    """Bars of the period before ``as_of``; both predicates reach the scan."""
    days = PERIOD_DAYS.get(period.lower(), PERIOD_DAYS[DEFAULT_PERIOD])
    end = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    rows = prices.where(F.col("date") >= F.date_sub(end, days))
    return rows.where(F.col("symbol").isin(*[s.strip().upper() for s in symbols])) if symbols else rows


def upsert_bars(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Newest version of every (symbol, date); open, high and low default to the close.

    An aggregate, not a window: it combines map-side, so a symbol re-sent many times costs one row
    per task in the shuffle.
    """
    filled = incoming.select(
        F.upper("symbol").alias("symbol"), "date", *[F.coalesce(c, "close").alias(c) for c in ("open", "high", "low")], "close",
        F.coalesce("volume", F.lit(0.0)).alias("volume"), "source", "updated_at",
    )
    both = existing.withColumn("_new", F.lit(0)).unionByName(filled.withColumn("_new", F.lit(1)))
    bar = F.struct("open", "high", "low", "close", "volume", "source", "updated_at")
    return both.groupBy("symbol", "date").agg(F.max_by(bar, F.struct("updated_at", "_new", "close")).alias("b")).select("symbol", "date", "b.*")


def write_bars(bars: DataFrame, path: str) -> None:
    """Overwrite only the years present, sorted by symbol for row-group skipping."""
    out = bars.withColumn("year", F.year("date")).repartition("year", "symbol").sortWithinPartitions("symbol", "date")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)


def with_change_pct(quotes: DataFrame) -> DataFrame:
    """Percent change on the previous close, 0 when either side is missing or zero."""
    ok = (F.coalesce("last_price", F.lit(0.0)) != 0) & (F.coalesce("prev_close", F.lit(0.0)) != 0)
    pct = F.try_divide(F.col("last_price") - F.col("prev_close"), F.col("prev_close")) * 100
    return quotes.withColumn("change_pct", F.when(ok, pct).otherwise(0.0))


def latest_quotes(quotes: DataFrame) -> DataFrame:
    """One row per symbol, newest wins; zero prices never count."""
    rows = quotes.where("last_price is not null and last_price <> 0")
    q = F.max_by(F.struct("last_price", "change_pct", "as_of"), F.struct("as_of", "last_price")).alias("q")
    return rows.groupBy("symbol").agg(q).select("symbol", "q.*")


def route_with_fallback(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Domestic symbols from the first source, foreign listings and empty ones from the second."""
    mine = primary.where(~has_foreign_suffix("symbol"))
    rest = secondary.join(mine.select("symbol").distinct(), "symbol", "left_anti")
    return mine.withColumn("source", F.lit("primary")).unionByName(rest.withColumn("source", F.lit("secondary")))


def normalise_fundamentals(raw: DataFrame) -> DataFrame:
    """Vendor quote JSON (symbol, as_of, info) into the nested document, by asset type."""
    i = F.from_json("info", schemas.QUOTE_INFO)
    x = raw.withColumn("i", i)
    kind = F.upper(F.coalesce("i.quoteType", F.lit("EQUITY")))
    name = F.coalesce("i.longName", "symbol")
    is_fund = kind.isin("ETF", "MUTUALFUND")
    is_bond = ~is_fund & ((kind == "FUTURE") | name.contains("Treasury"))
    is_stock = ~is_fund & ~is_bond
    zero = F.lit(0.0)
    doc = F.struct(
        kind.alias("type"),
        F.struct(
            name.alias("name"), F.coalesce("i.sector", F.lit("Unknown")).alias("sector"), F.coalesce("i.industry", F.lit("Unknown")).alias("industry"),
            F.coalesce("i.currency", F.lit("USD")).alias("currency"), F.coalesce("i.exchange", "i.fullExchangeName").alias("exchange"),
        ).alias("profile"),
        F.when(is_stock, F.struct(
            F.coalesce("i.marketCap", zero).alias("market_cap"), F.coalesce("i.trailingPE", zero).alias("pe_ratio"),
            F.coalesce("i.forwardPE", zero).alias("forward_pe"), F.coalesce("i.enterpriseToEbitda", zero).alias("ev_to_ebitda"),
        )).alias("valuation"),
        F.when(is_stock, F.struct(
            F.coalesce("i.profitMargins", zero).alias("profit_margin"), F.coalesce("i.returnOnEquity", zero).alias("roe"), F.coalesce("i.returnOnAssets", zero).alias("roa"),
        )).alias("profitability"),
        F.when(is_stock | is_fund, F.struct(
            F.coalesce(F.when(is_fund, F.col("i.beta3Year")).otherwise(F.col("i.beta")), F.lit(1.0)).alias("beta"),
            F.coalesce("i.fiftyTwoWeekHigh", zero).alias("high_52w"), F.coalesce("i.fiftyTwoWeekLow", zero).alias("low_52w"),
        )).alias("technicals"),
        F.when(is_fund, F.struct(
            F.coalesce("i.annualReportExpenseRatio", zero).alias("expense_ratio"), F.coalesce("i.yield", zero).alias("yield"), F.coalesce("i.totalAssets", zero).alias("net_assets"),
        )).alias("fund_metrics"),
        F.when(is_bond, F.struct(F.coalesce("i.yield", zero).alias("yield"), F.coalesce("i.regularMarketPrice", zero).alias("coupon"))).alias("bond_metrics"),
    )
    return x.select("symbol", "as_of", doc.alias("doc"))


def latest_within(snapshots: DataFrame, now: Column, max_age_hours: float = 24.0) -> DataFrame:
    """Newest snapshot per symbol, labelled fresh or stale by its age."""
    cols = [c for c in snapshots.columns if c not in ("symbol", "as_of")]
    row = F.struct("as_of", *cols)
    # one row as a whole; of equal times the one that is largest as text
    newest = snapshots.groupBy("symbol").agg(F.max_by(row, F.struct("as_of", F.to_json(row))).alias("e")).select("symbol", "e.as_of", *[f"e.{c}" for c in cols])
    age = (F.unix_timestamp(now) - F.unix_timestamp("as_of")) / 3600.0
    return newest.select("*", age.alias("age_hours"), F.when(age <= max_age_hours, "fresh").otherwise("stale").alias("freshness"))


def normalise_news(raw: DataFrame, limit: int = 5) -> DataFrame:
    """First ``limit`` items per symbol of a JSON array (symbol, items), nested or legacy layout."""
    items = F.from_json("items", f"array<struct<{_struct_ddl(schemas.NEWS_ITEM)}>>")
    x = raw.select("symbol", F.posexplode(items).alias("pos", "n")).where(F.col("pos") < limit)
    iso = F.replace(F.substring("n.content.pubDate", 1, 16), F.lit("T"), F.lit(" "))
    epoch = F.when(F.col("n.providerPublishTime") > 0, F.date_format(F.timestamp_seconds("n.providerPublishTime"), "yyyy-MM-dd HH:mm"))
    nested = F.col("n.content").isNotNull()
    title = F.coalesce("n.content.title", "n.title", F.lit("No Title"))
    return x.select(
        "symbol", "pos", title.alias("title"),
        F.coalesce(F.when(nested, F.col("n.content.provider.displayName")).otherwise(F.col("n.publisher")), F.lit("Unknown")).alias("publisher"),
        F.coalesce("n.content.canonicalUrl.url", "n.content.clickThroughUrl.url", F.when(~nested, F.col("n.link")), F.lit("#")).alias("link"),
        F.coalesce(F.when(F.length("n.content.pubDate") > 0, iso), epoch, F.lit("")).alias("timestamp"),
        F.coalesce("n.content.contentType", "n.type", F.lit("STORY")).alias("type"), headline_sentiment(title).alias("sentiment"),
    )


def _struct_ddl(ddl: str) -> str:
    """``a int, b string`` → ``a:int,b:string`` at the top level of a DDL list."""
    depth, out, field = 0, [], ""
    for ch in ddl + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(field.strip().replace(" ", ":", 1))
            field = ""
        else:
            field += ch
    return ",".join(out)


def cache_state(rows: DataFrame, now: Column, max_age_seconds: float) -> DataFrame:
    """``fresh`` while unexpired or young enough, ``stale`` otherwise, ``miss`` without a result."""
    age = F.unix_timestamp(now) - F.unix_timestamp("created_at")
    fresh = F.coalesce(F.col("expires_at") >= now, age <= max_age_seconds, F.lit(False))
    return rows.withColumn("state", F.when(F.col("created_at").isNull(), "miss").when(fresh, "fresh").otherwise("stale"))


def latest_per_symbol_news(items: DataFrame, limit: int = 5) -> DataFrame:
    rn = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("timestamp"), "pos"))
    return items.withColumn("_rn", rn).where(F.col("_rn") <= limit).drop("_rn")


def json_safe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Non-finite numbers become 0 before export."""
    return df.withColumns({c: finite_or_zero(c) for c in columns})
