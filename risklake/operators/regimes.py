"""Volatility regimes: asset classes, ratio thresholds, portfolio labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from risklake.functions.stats import exact_quantiles
from risklake.operators.align import series

# Default thresholds per asset class.
DEFAULT_THRESHOLDS = {
    "equity_us": (1.55, 0.70),
    "equity_intl": (1.55, 0.70),
    "etf_broad": (1.45, 0.75),
    "etf_sector": (1.65, 0.70),
    "bond_treasury": (1.70, 0.60),
    "bond_credit": (1.60, 0.65),
    "crypto": (1.40, 0.65),
    "commodity": (1.55, 0.70),
    "default": (1.50, 0.80),
}
# Tickers with a class of their own.
BROAD_ETFS = [
    "SPY", "VOO", "VTI", "IVV", "QQQ", "DIA", "IWM", "RSP", "EFA", "EEM", "ACWI", "VEA", "VWO", "IEFA", "IEMG", "VT",
]
TREASURY_ETFS = ["TLT", "IEF", "SHY", "GOVT", "BIL", "TIP", "VGIT", "VGSH"]
CREDIT_ETFS = ["LQD", "HYG", "JNK", "AGG", "BND", "BNDX", "VCIT", "VCSH"]
COMMODITY_ETFS = ["GLD", "SLV", "USO", "UNG", "DBC", "GSG", "PALL", "PPLT", "DBA"]
INTERNATIONAL_PREFIXES = ["EFA", "EEM", "ACWI", "VEA", "VWO", "VXUS", "EWJ", "EWG", "EWU", "FXI"]


def regime_class(ticker: Column, asset_type: Column, sector: Column) -> Column:
    """Regime asset class of a ticker; the first matching rule wins."""
    t = F.upper(F.coalesce(ticker, F.lit("")))
    kind = F.upper(F.coalesce(asset_type, F.lit("")))
    has_sector = F.length(F.trim(F.coalesce(sector, F.lit("")))) > 0
    broad = t.isin(*BROAD_ETFS)
    intl = F.lit(False)
    for prefix in INTERNATIONAL_PREFIXES:
        intl = intl | t.startswith(prefix)
    is_etf = (kind == "ETF") | ((kind == "") & broad)
    etf = (
        F.when(broad | intl, "etf_broad")
        .when(t.startswith("XL") | has_sector | (kind == "ETF"), "etf_sector")
        .otherwise("etf_broad")
    )
    return (
        F.when((kind == "CRYPTO") | t.endswith("-USD") | t.endswith("USDT"), "crypto")
        .when((kind == "BOND") | t.isin(*TREASURY_ETFS), "bond_treasury")
        .when(t.isin(*CREDIT_ETFS), "bond_credit")
        .when(t.isin(*COMMODITY_ETFS), "commodity")
        .when(is_etf, etf)
        .when(kind == "FUTURE", "commodity")
        .when(t.rlike(r"\.(L|T|HK|PA)$"), "equity_intl")
        .otherwise("equity_us")
    )


def seed_thresholds(spark: SparkSession, calibrated_at: str) -> DataFrame:
    rows = [(c, hi, lo) for c, (hi, lo) in DEFAULT_THRESHOLDS.items()]
    return spark.createDataFrame(rows, "asset_class string, high double, low double").select(
        "*", F.lit(True).alias("is_active"), F.lit(calibrated_at).cast("timestamp").alias("calibrated_at")
    )


def volatility_ratios(prices: DataFrame, recent: int = 21, long: int = 126, by: str = "symbol") -> DataFrame:
    """Recent over long sample volatility of log returns; flat windows are dropped."""
    r = F.log(F.col("price") / F.lag("price").over(series(by)))
    rows = prices.withColumn("r", r).where("r is not null")
    w = series(by)
    short_f, long_f = w.rowsBetween(-(recent - 1), 0), w.rowsBetween(-(long - 1), 0)
    ratio = F.try_divide(F.stddev_samp("r").over(short_f), F.stddev_samp("r").over(long_f))
    full = F.count("r").over(long_f) == long
    return rows.select(by, "date", F.when(full, ratio).alias("ratio")).where("ratio is not null")


def calibrate_thresholds(prices: DataFrame, classes: DataFrame, min_rows: int = 200) -> DataFrame:
    """Pooled 10th/90th percentile of the ratios per class, over symbols with enough bars.

    A class may pool a third of all ratios, so the percentiles come from the exact
    selection instead of one buffer per class.
    """
    enough = prices.groupBy("symbol").agg(F.count("*").alias("n")).where(F.col("n") >= min_rows)
    ratios = volatility_ratios(prices).join(enough, "symbol", "left_semi").join(classes, "symbol")
    q = exact_quantiles(ratios, ["asset_class"], "ratio", {"low": 0.10, "high": 0.90})
    return q.select("asset_class", F.bround("high", 3).alias("high"), F.bround("low", 3).alias("low"))


def supersede_thresholds(history: DataFrame, fresh: DataFrame, calibrated_at: str) -> DataFrame:
    """Append the fresh rows as active; earlier rows of the same classes become inactive."""
    new = fresh.select(
        "asset_class", "high", "low", F.lit(True).alias("is_active"), F.lit(calibrated_at).cast("timestamp").alias("calibrated_at")
    )
    replaced = fresh.select("asset_class", F.lit(True).alias("_replaced"))
    old = history.join(replaced, "asset_class", "left").select(
        "asset_class", "high", "low", (F.col("is_active") & F.col("_replaced").isNull()).alias("is_active"), "calibrated_at"
    )
    return old.unionByName(new)


def latest_thresholds(history: DataFrame) -> DataFrame:
    """Newest active (high, low) per class."""
    row = F.max_by(F.struct("high", "low"), F.struct("calibrated_at", "high", "low")).alias("t")
    return history.where("is_active").groupBy("asset_class").agg(row).select("asset_class", "t.high", "t.low")


def with_thresholds(rows: DataFrame, history: DataFrame) -> DataFrame:
    """Point-in-time thresholds joined by class, the default row filling the gaps."""
    table = latest_thresholds(history)
    hi, lo = DEFAULT_THRESHOLDS["default"]
    stored = table.where("asset_class = 'default'")
    out = rows.join(table, "asset_class", "left")
    return out.withColumn("high", F.coalesce("high", stored.agg(F.max("high")).scalar(), F.lit(hi))).withColumn(
        "low", F.coalesce("low", stored.agg(F.max("low")).scalar(), F.lit(lo))
    )


def portfolio_thresholds(holdings: DataFrame, history: DataFrame, by: str = "portfolio_id") -> DataFrame:
    """Weight-averaged thresholds of the positive holdings (carrying ``asset_class``)."""
    h = with_thresholds(holdings.where("weight > 0"), history)
    w = F.sum("weight")
    return h.groupBy(by).agg(
        (F.sum(F.col("weight") * F.col("high")) / w).alias("high"), (F.sum(F.col("weight") * F.col("low")) / w).alias("low")
    )


def class_mix(holdings: DataFrame, by: str = "portfolio_id") -> DataFrame:
    total = F.sum("weight").over(W.partitionBy(by))
    share = holdings.where("weight > 0").withColumn("share", F.col("weight") / total)
    return share.groupBy(by, "asset_class").agg(F.sum("share").alias("share"))


def portfolio_regime(index: DataFrame, thresholds: DataFrame, by: str = "portfolio_id") -> DataFrame:
    """Drawdown beyond 10% of the 60-row peak, else the median of the last 5 ratios vs thresholds.

    ``index`` carries ``price`` and ``ret`` per date.
    """
    desc = W.partitionBy(by).orderBy(F.desc("date"))
    # rows needed: the long window plus four earlier days
    rows = index.withColumn("_rn", F.row_number().over(desc)).withColumn("_n", F.count("*").over(W.partitionBy(by)))
    rows = rows.where(F.col("_rn") <= 130)
    w = series(by)
    s, l = F.stddev_samp("ret").over(w.rowsBetween(-20, 0)), F.stddev_samp("ret").over(w.rowsBetween(-125, 0))
    rows = rows.withColumn("_s", s).withColumn("_l", l)
    # short histories fall back to the snapshot ratio of whatever the tails hold
    smooth = (F.col("_n") >= 131) & (F.col("_rn") <= 5) & (F.col("_l") > 0)
    agg = rows.groupBy(by).agg(
        F.percentile(F.when(smooth, F.try_divide(F.col("_s"), F.col("_l"))), F.lit(0.5)).alias("median_ratio"),
        F.max(F.when(F.col("_rn") == 1, F.try_divide(F.col("_s"), F.col("_l")))).alias("last_ratio"),
        F.max(F.when(F.col("_rn") == 1, F.col("price"))).alias("last"),
        F.max(F.when(F.col("_rn") <= 60, F.col("price"))).alias("peak"),
        F.max("_n").alias("n"),
    )
    ratio = F.coalesce("median_ratio", "last_ratio", F.lit(1.0))
    dd = F.when((F.col("n") >= 5) & (F.col("peak") > 0), F.col("last") / F.col("peak") - 1).otherwise(0.0)
    label = (
        F.when(dd < -0.10, "Drawdown").when(ratio > F.col("high"), "High_Vol").when(ratio < F.col("low"), "Low_Vol").otherwise("Normal")
    )
    return agg.join(thresholds, by).select(by, ratio.alias("vol_ratio"), dd.alias("drawdown"), "high", "low", label.alias("regime"))


def walk_forward_tags(prices: DataFrame, by: str = "symbol") -> DataFrame:
    """Two tags per row: the population-volatility fold rule and the sample-volatility training rule."""
    r = F.log(F.col("price") / F.lag("price").over(series(by)))
    w = series(by)
    f21, f63 = w.rowsBetween(-20, 0), w.rowsBetween(-62, 0)
    rows = prices.withColumn("r", r).withColumn("n_prices", F.row_number().over(w))
    pop = F.try_divide(F.stddev_pop("r").over(f21), F.stddev_pop("r").over(f63))
    long_pop = F.stddev_pop("r").over(f63)
    samp = F.try_divide(F.stddev_samp("r").over(f21), F.stddev_samp("r").over(f63))
    samp = F.when(F.count("r").over(f63) == 63, samp)

    def tag(x: Column) -> Column:
        return F.when(x > 1.5, "High_Vol").when(x < 0.8, "Low_Vol").otherwise("Normal")

    return rows.select(
        by, "date",
        F.when((F.col("n_prices") < 63) | (long_pop < 1e-12), "Normal").otherwise(tag(pop)).alias("fold_tag"),
        F.when(samp.isNotNull(), tag(samp)).alias("training_tag"),
    )
