"""Realised cross-asset correlation: rolling lines, headlines, episodes, portfolio watch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from risklake.operators.align import series
from risklake.operators.returns import sleeve_index

# Window lengths, retained points and gates.
WINDOWS = [30, 60, 90]
ROLLING_HISTORY = 252
MIN_OBS = 20
SHORT_WINDOW = 60
BASELINE_WINDOW = 252
MIN_SLEEVE_WEIGHT = 0.05

# Curated sleeve membership.
EQUITY_TICKERS = [
    "SPY", "VOO", "IVV", "VTI", "QQQ", "IWM", "DIA", "VEA", "VWO", "EFA", "EEM", "SCHD", "VUG", "VTV",
    "VNQ", "ARKK", "XLK", "XLF", "XLV", "XLE", "XLI", "XLP", "XLY", "XLU",
]
BOND_TICKERS = [
    "AGG", "BND", "BNDX", "TLT", "IEF", "SHY", "LQD", "HYG", "BIL", "TIP", "MUB", "VCIT", "VCSH", "SHV", "GOVT",
]
COMMODITY_TICKERS = ["GLD", "IAU", "SLV", "DBC", "USO", "PDBC", "GC=F", "SI=F", "CL=F"]
SLEEVE_OF_CLASS = {
    "BOND_ETF": "bond", "COMMODITY": "commodity", "CRYPTO": "crypto",
    "US_EQUITY": "equity", "INTL_INDEX": "equity", "INDEX": "equity", "ETF": "equity",
}


def pairs_frame(spark: SparkSession, pairs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """The configured pairs (a short fixed list) as rows."""
    rows = [(f"{a.upper()}_{b.upper()}", a, b, label) for a, b, label in pairs]
    return spark.createDataFrame(rows, "pair_key string, symbol_a string, symbol_b string, label string")


def pair_returns(prices: DataFrame, pairs: DataFrame) -> DataFrame:
    """Both legs' returns between consecutive common days, one series per pair."""
    p = prices.select("symbol", "date", "price")
    a = pairs.join(p.withColumnsRenamed({"symbol": "symbol_a", "price": "pa"}), "symbol_a")
    both = a.join(p.withColumnsRenamed({"symbol": "symbol_b", "price": "pb"}), ["symbol_b", "date"])
    w = series("pair_key")
    legs = both.select(
        "pair_key", "symbol_a", "symbol_b", "label", "date",
        (F.col("pa") / F.lag("pa").over(w) - 1).alias("a"),
        (F.col("pb") / F.lag("pb").over(w) - 1).alias("b"),
    )
    return legs.where("a is not null and b is not null")


def rolling_correlation(legs: DataFrame, windows: Sequence[int] = WINDOWS, by: str = "pair_key", keep: int | None = ROLLING_HISTORY) -> DataFrame:
    """Rolling Pearson for all windows in one pass; the trailing ``keep`` points of each."""
    w = series(by)
    counted = legs.withColumn("n_total", F.count("*").over(W.partitionBy(by)))

    def line(n: int) -> Column:
        frame = w.rowsBetween(-(n - 1), 0)
        return F.when(F.count("a").over(frame) == n, F.corr("a", "b").over(frame))

    wide = counted.select(by, "date", "n_total", *[line(n).alias(f"w{n}") for n in windows])
    points = F.array(*[F.struct(F.lit(n).alias("window"), F.col(f"w{n}").alias("corr")) for n in windows])
    long = wide.select(by, "date", "n_total", F.explode(points).alias("p")).select(by, "date", "n_total", "p.*")
    long = long.where(
        F.col("corr").isNotNull() & ~F.isnan("corr") & (F.col("n_total") >= F.greatest(F.col("window"), F.lit(MIN_OBS)))
    ).drop("n_total")
    if keep is None:
        return long
    rn = F.row_number().over(W.partitionBy(by, "window").orderBy(F.desc("date")))
    return long.withColumn("_rn", rn).where(F.col("_rn") <= keep).drop("_rn")


def headline_correlation(legs: DataFrame, windows: Sequence[int] = WINDOWS, by: str = "pair_key") -> DataFrame:
    """Pearson, Spearman, count and date over the last ``window`` rows of every pair."""
    rn = F.row_number().over(W.partitionBy(by).orderBy(F.desc("date")))
    tail = legs.withColumn("n_total", F.count("*").over(W.partitionBy(by))).withColumn("_rn", rn)
    tail = tail.where(F.col("_rn") <= max(windows))
    wanted = F.array(*[F.lit(n) for n in windows])
    fits = F.filter(wanted, lambda n: (F.col("_rn") <= n) & (F.col("n_total") >= F.greatest(n, F.lit(MIN_OBS))))
    rows = tail.withColumn("window", F.explode(fits))
    part = W.partitionBy(by, "window")

    def average_rank(c: str) -> Column:
        ties = F.count("*").over(W.partitionBy(by, "window", c))
        return F.rank().over(part.orderBy(c)) + (ties - 1) / 2

    ranked = rows.withColumn("_ra", average_rank("a")).withColumn("_rb", average_rank("b"))
    return ranked.groupBy(by, "window").agg(
        F.corr("a", "b").alias("pearson"), F.corr("_ra", "_rb").alias("spearman"), F.count("*").alias("n_obs"),
        F.max("date").alias("as_of"),
    ).where("pearson is not null and not isnan(pearson)")


def snapshot_batch(prices: DataFrame, pairs: DataFrame, source: str, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """One row per (pair, window): headline numbers plus the trailing line as an array."""
    legs = pair_returns(prices, pairs)
    heads = headline_correlation(legs, windows)
    lines = rolling_correlation(legs, windows).groupBy("pair_key", "window").agg(
        F.array_sort(F.collect_list(F.struct("date", "corr"))).alias("series")  # at most 252 points
    )
    return heads.join(lines, ["pair_key", "window"]).join(pairs, "pair_key").withColumn("data_source", F.lit(source))


def regroup_snapshots(snapshots: DataFrame) -> DataFrame:
    """One row per pair with a window-keyed map, the newest date and the sorted sources."""
    entry = F.struct(F.col("window"), F.struct("pearson", "spearman", "n_obs"))
    return snapshots.groupBy("pair_key", "symbol_a", "symbol_b", "label").agg(
        F.map_from_entries(F.collect_list(entry)).alias("windows"),
        F.max("as_of").alias("as_of"),
        F.concat_ws(" + ", F.array_sort(F.collect_set("data_source"))).alias("data_source"),
    )


def blend_drawdown(legs: DataFrame, keys: Sequence[str], wa: float = 0.6, wb: float = 0.4) -> DataFrame:
    """Rebalanced two-leg blend: its return and the running drawdown of its equity."""
    up_to = W.partitionBy(*keys).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    out = legs.withColumn("blend", wa * F.col("a") + wb * F.col("b"))
    out = out.withColumn("_eq", F.product(1 + F.col("blend")).over(up_to))
    return out.withColumn("dd", F.col("_eq") / F.max("_eq").over(up_to) - 1).drop("_eq")


def historical_replay(legs: DataFrame, window: int = 60, every: int = 5, by: str = "pair_key") -> DataFrame:
    """Full-history correlation with the blend drawdown, every ``every``-th row."""
    w = series(by)
    frame = w.rowsBetween(-(window - 1), 0)
    corr = F.when(F.count("a").over(frame) == window, F.corr("a", "b").over(frame))
    rows = blend_drawdown(legs, [by]).withColumn("corr", corr).withColumn("_i", F.row_number().over(w) - 1)
    rows = rows.withColumn("_n", F.count("*").over(W.partitionBy(by)))
    keep = (F.col("_n") >= max(window, 250)) & (F.col("_i") % every == 0) & F.col("corr").isNotNull()
    return rows.where(keep).select(by, "date", "corr", (F.col("dd") * 100).alias("dd_pct"))


def episode_statistics(legs: DataFrame, episodes: Sequence[tuple[str, str, str]], by: str = "pair_key") -> DataFrame:
    """Correlation, worst blend drawdown and blend return inside each named date range.

    The ranges are a short fixed list, so each row is tagged by a filter over that list: no join.
    """
    listed = F.array(
        *[
            F.struct(F.lit(n).alias("episode"), F.lit(a).cast("date").alias("start"), F.lit(b).cast("date").alias("stop"))
            for n, a, b in episodes
        ]
    )
    inside = F.filter(listed, lambda e: F.col("date").between(e["start"], e["stop"]))
    tagged = legs.withColumn("_e", F.explode(inside)).select("*", F.col("_e.episode").alias("episode")).drop("_e")
    rows = blend_drawdown(tagged, [by, "episode"])
    return rows.groupBy(by, "episode").agg(
        F.corr("a", "b").alias("corr"), (F.min("dd") * 100).alias("drawdown_pct"),
        ((F.product(1 + F.col("blend")) - 1) * 100).alias("return_pct"), F.count("*").alias("n_obs"),
    ).where(F.col("n_obs") >= MIN_OBS)


def sleeve_of(ticker: Column, asset_class: Column) -> Column:
    """Curated lists first, then the crypto suffix, then the asset class, else other."""
    t, c = F.upper(F.trim(ticker)), F.upper(F.trim(asset_class))
    by_class = F.element_at(F.create_map(*[F.lit(x) for kv in SLEEVE_OF_CLASS.items() for x in kv]), c)
    return (
        F.when(t.isin(*BOND_TICKERS), "bond")
        .when(t.isin(*EQUITY_TICKERS), "equity")
        .when(t.isin(*COMMODITY_TICKERS), "commodity")
        .when(t.endswith("-USD"), "crypto")
        .otherwise(F.coalesce(by_class, F.lit("other")))
    )


def portfolio_regime_watch(
    holdings: DataFrame, prices: DataFrame, by: str = "portfolio_id",
    short: int = SHORT_WINDOW, baseline: int = BASELINE_WINDOW, floor: float = MIN_SLEEVE_WEIGHT,
) -> DataFrame:
    """Equity-versus-bond correlation now against the book's own baseline, or ``na`` with a reason.

    ``holdings`` carries ``sleeve``; weights are renormalised per portfolio.
    """
    share = F.col("weight") / F.sum("weight").over(W.partitionBy(by))
    h = holdings.withColumn("weight", share)
    mix = h.groupBy(by).agg(
        F.sum(F.when(F.col("sleeve") == "equity", F.col("weight")).otherwise(0.0)).alias("equity_weight"),
        F.sum(F.when(F.col("sleeve") == "bond", F.col("weight")).otherwise(0.0)).alias("bond_weight"),
    )
    able = (F.col("equity_weight") >= floor) & (F.col("bond_weight") >= floor)
    usable = h.where(F.col("sleeve").isin("equity", "bond")).join(mix.where(able).select(by), by, "left_semi")
    index = sleeve_index(usable, prices, [by, "sleeve"])
    wide = index.groupBy(by, "date").agg(
        F.max(F.when(F.col("sleeve") == "equity", F.col("price"))).alias("pa"),
        F.max(F.when(F.col("sleeve") == "bond", F.col("price"))).alias("pb"),
    ).where("pa is not null and pb is not null")
    w = series(by)
    legs = wide.select(
        by, "date", (F.col("pa") / F.lag("pa").over(w) - 1).alias("a"), (F.col("pb") / F.lag("pb").over(w) - 1).alias("b")
    ).where("a is not null and b is not null")
    heads = headline_correlation(legs, [short, baseline], by)
    snap = heads.groupBy(by).agg(
        F.max(F.when(F.col("window") == short, F.col("pearson"))).alias("short_corr"),
        F.max(F.when(F.col("window") == baseline, F.col("pearson"))).alias("baseline_corr"),
        F.max(F.when(F.col("window") == short, F.col("n_obs"))).alias("n_obs"),
        F.max("as_of").alias("as_of"),
    )
    measured = F.col("short_corr").isNotNull()
    return mix.join(snap, by, "left").select(
        by, "equity_weight", "bond_weight",
        F.when(able & measured, "ok").otherwise("na").alias("status"),
        F.when(~able, "needs both sleeves").when(~measured, "insufficient history").alias("reason"),
        "short_corr", "baseline_corr", (F.col("short_corr") - F.col("baseline_corr")).alias("delta"), "n_obs", "as_of",
    )
