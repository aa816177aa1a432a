"""Forecast evaluation: walk-forward folds, closed-form forecasts, quality and league tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from risklake.functions.stats import exact_quantiles, wilson_interval
from risklake.operators.align import series
from risklake.operators.indicators import ar1_projection
from risklake.operators.simulate import drift_projection

MIN_REGIME_FOLDS = 3


def walk_forward_splits(prices: DataFrame, max_splits: int = 3, test_rows: int = 15, min_train: int = 120, by: str = "symbol") -> DataFrame:
    """Up to ``max_splits`` test windows counted back from the end, oldest fold first."""
    test_rows = max(3, test_rows)
    n = prices.groupBy(by).agg(F.count("*").alias("n"))
    back = n.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(max_splits - 1))))
    back = back.withColumn("test_end", F.col("n") - F.col("_b") * test_rows)
    ok = back.withColumn("train_end", F.col("test_end") - test_rows).where(F.col("train_end") >= min_train)
    fold = F.row_number().over(W.partitionBy(by).orderBy("train_end")) - 1
    return ok.select(by, fold.alias("fold"), "train_end", "test_end")


def _numbered(prices: DataFrame, by: str) -> DataFrame:
    return prices.withColumn("rn", F.row_number().over(series(by)) - 1)


def fold_rows(prices: DataFrame, splits: DataFrame, by: str = "symbol") -> DataFrame:
    """Test rows of every fold with their step (1-based)."""
    j = _numbered(prices, by).join(splits, by)
    return j.where((F.col("rn") >= F.col("train_end")) & (F.col("rn") < F.col("test_end"))).select(
        by, "fold", (F.col("rn") - F.col("train_end") + 1).alias("step"), "date", F.col("price").alias("actual")
    )


def fold_forecasts(prices: DataFrame, splits: DataFrame, by: str = "symbol", horizon: int = 15) -> DataFrame:
    """Naive, geometric, drift and AR(1) forecasts of each fold from its own training prefix."""
    train = _numbered(prices, by).join(splits, by).where(F.col("rn") < F.col("train_end"))
    train = train.withColumn("key", F.concat_ws("|", F.col(by), F.col("fold").cast("string"))).select("key", by, "fold", "date", "price")
    ids = train.select("key", by, "fold").distinct()
    s = train.groupBy("key").agg(F.max_by("price", "date").alias("last"), F.min_by("price", "date").alias("first"), F.count("*").alias("n"))
    s = s.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    growth = F.pow(F.col("last") / F.col("first"), 1.0 / (F.col("n") - 1))
    naive = s.select("key", "step", F.lit("naive").alias("model"), F.col("last").alias("predicted"))
    geo = s.select("key", "step", F.lit("geometric").alias("model"), (F.col("last") * F.pow(growth, F.col("step"))).alias("predicted"))
    slim = train.select("key", "date", "price")
    drift = drift_projection(slim, horizon, "key").select("key", "step", F.lit("drift").alias("model"), F.col("price").alias("predicted"))
    ar1 = ar1_projection(slim, horizon, by="key").select("key", "step", F.lit("ar1").alias("model"), F.col("price").alias("predicted"))
    return naive.unionByName(geo).unionByName(drift).unionByName(ar1).join(ids, "key").select(by, "fold", "model", "step", "predicted")


def evaluated(prices: DataFrame, splits: DataFrame, by: str = "symbol") -> DataFrame:
    return fold_rows(prices, splits, by).join(fold_forecasts(prices, splits, by), [by, "fold", "step"])


def direction(change: Column, level: Column) -> Column:
    """Sign of a change; float residue of a settled path (below 1e-9 of its level) is no direction."""
    return F.when(F.abs(change) <= 1e-9 * F.abs(level), 0.0).otherwise(F.signum(change))


def step_quality(rows: DataFrame, by: str = "symbol") -> DataFrame:
    """APE, direction hit and long/short excess per step; differences never cross a fold."""
    w = W.partitionBy(by, "model", "fold").orderBy("step")
    da = F.col("actual") - F.lag("actual").over(w)
    dp = F.col("predicted") - F.lag("predicted").over(w)
    ret = da / F.greatest(F.lag("actual").over(w), F.lit(1e-12))
    return rows.select(
        by, "model", "fold", "step",
        F.when(F.abs("actual") > 1e-9, F.abs((F.col("actual") - F.col("predicted")) / F.col("actual"))).alias("ape"),
        (F.signum(da) == direction(dp, F.col("predicted"))).cast("double").alias("dir_match"),
        (direction(dp, F.col("predicted")) * ret - ret).alias("excess"),
    )


def pooled_quality(steps: DataFrame, keys: Sequence[str] = ("symbol", "model")) -> DataFrame:
    """MAPE, directional accuracy and the raw per-step information ratio over all folds."""
    sd = F.stddev_pop("excess")
    return steps.groupBy(*keys).agg(
        F.avg("ape").alias("mape"), F.avg("dir_match").alias("directional_accuracy"),
        F.when((F.count("excess") > 5) & (sd > 1e-12), F.try_divide(F.avg("excess"), sd)).otherwise(0.0).alias("long_short"),
        F.count("*").alias("n_steps"), F.count("dir_match").alias("n_diffs"),
    ).where(F.col("n_diffs") >= 2)


def point_errors(rows: DataFrame, prices: DataFrame, by: str = "symbol") -> DataFrame:
    """RMSE, MAPE and MASE (scaled by the naive error of the training history) per model and fold."""
    err = F.col("actual") - F.col("predicted")
    e = rows.groupBy(by, "model", "fold").agg(
        F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.when(F.abs("actual") > 1e-9, F.abs(err / F.col("actual")))).alias("mape"), F.avg(F.abs(err)).alias("mae"),
        F.min("date").alias("_start"),
    )
    moves = prices.withColumn("_m", F.abs(F.col("price") - F.lag("price").over(series(by))))
    starts = e.select(by, "fold", "_start").distinct()
    scale = moves.join(starts, by).where(F.col("date") < F.col("_start")).groupBy(by, "fold").agg(F.avg("_m").alias("naive"))
    out = e.join(scale, [by, "fold"], "left")
    return out.select(by, "model", "fold", "rmse", "mape", F.when(F.col("naive") >= 1e-12, F.col("mae") / F.col("naive")).alias("mase"))


def naive_baselines(prices: DataFrame, splits: DataFrame, lookback: int = 21, by: str = "symbol") -> DataFrame:
    """Hits and tries of always-up, persistence and trailing-trend direction calls."""
    rows = _numbered(prices, by).withColumn("_trend", F.signum(F.col("price") - F.lag("price", lookback).over(series(by))))
    j = rows.join(splits, by)
    trend = j.where((F.col("rn") == F.col("train_end") - 1) & (F.col("train_end") - lookback >= 0)).select(
        by, "fold", F.when(F.col("_trend") == 0, 1.0).otherwise(F.coalesce("_trend", F.lit(1.0))).alias("trend")
    )
    test = fold_rows(prices, splits, by)
    w = W.partitionBy(by, "fold").orderBy("step")
    d = test.withColumn("d", F.signum(F.col("actual") - F.lag("actual").over(w))).where("d is not null")
    d = d.withColumn("before", F.lag("d").over(w)).join(trend, [by, "fold"], "left")
    hits = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return d.groupBy(by).agg(
        hits(F.col("d") > 0).alias("up_hits"), F.count("d").alias("up_n"),
        hits(F.col("d") == F.col("before")).alias("persist_hits"), F.count("before").alias("persist_n"),
        hits(F.col("d") == F.col("trend")).alias("drift_hits"), F.count("trend").alias("drift_n"),
    )


def with_wilson(df: DataFrame, k: str, n: str, prefix: str) -> DataFrame:
    p, lo, hi = wilson_interval(F.col(k).cast("double"), F.col(n).cast("double"))
    return df.select("*", p.alias(f"{prefix}_rate"), lo.alias(f"{prefix}_low"), hi.alias(f"{prefix}_high"))


def track_record(quality: DataFrame) -> DataFrame:
    """Normal-approximation interval of the hit rate and whether it clears a coin flip."""
    p, n = F.col("directional_accuracy"), F.col("n_steps")
    half = 1.96 * F.sqrt(p * (1 - p) / n)
    return quality.where(n > 0).select(
        "*", F.greatest(F.lit(0.0), p - half).alias("ci_low"), F.least(F.lit(1.0), p + half).alias("ci_high"), (p - half > 0.5).alias("beats_coinflip")
    )


def league_table(split_rmse: DataFrame, fold_rmse: DataFrame, regimes: DataFrame, current: DataFrame, by: str = "symbol") -> DataFrame:
    """Winner per key: half split and half walk-forward RMSE, unless the current regime knows better.

    ``fold_rmse`` (by, model, fold, rmse), ``regimes`` (by, fold, regime), ``current`` (by, regime).
    """
    wf = fold_rmse.groupBy(by, "model").agg(F.avg("rmse").alias("wf"))
    combined = split_rmse.join(wf, [by, "model"], "left").withColumn("score", F.coalesce(0.5 * F.col("rmse") + 0.5 * F.col("wf"), F.col("rmse")))
    winner = combined.groupBy(by).agg(F.min_by("model", F.struct("score", "model")).alias("global_winner"), F.min("score").alias("score"))
    per = fold_rmse.join(regimes, [by, "fold"]).groupBy(by, "regime", "model").agg(F.avg("rmse").alias("mean_rmse"), F.count("*").alias("n_folds"))
    best = per.groupBy(by, "regime").agg(F.min_by(F.struct("model", "n_folds"), F.struct("mean_rmse", "model")).alias("b"))
    mine = best.join(current, [by, "regime"]).select(by, "regime", F.col("b.model").alias("regime_best"), F.col("b.n_folds").alias("n_folds"))
    j = winner.join(mine, by, "left")
    override = F.coalesce((F.col("n_folds") >= MIN_REGIME_FOLDS) & (F.col("regime_best") != F.col("global_winner")), F.lit(False))
    return j.select(
        by, "score", "global_winner", F.when(override, F.col("regime_best")).otherwise(F.col("global_winner")).alias("winner"),
        F.when(override, "regime_conditional").otherwise("global").alias("selection_mode"),
    )


def evaluation_summary(quality: DataFrame, baselines: DataFrame, by: str = "symbol") -> DataFrame:
    """Pooled accuracy of each model against the best naive baseline, with median errors.

    The medians run over all symbols and use the exact selection.
    """
    pooled = quality.groupBy("model").agg(
        F.sum(F.round(F.col("directional_accuracy") * F.col("n_diffs"))).alias("hits"), F.sum("n_diffs").alias("n"), F.count("*").alias("n_symbols")
    )
    med = exact_quantiles(quality, ["model"], "mape", {"mape_median": 0.5}).join(
        exact_quantiles(quality, ["model"], "long_short", {"long_short_median": 0.5}), "model"
    )
    share = lambda b: F.try_divide(F.sum(f"{b}_hits"), F.sum(f"{b}_n"))
    best = baselines.agg(F.greatest(share("up"), share("persist"), share("drift"))).scalar()
    wins = quality.groupBy(by).agg(F.min_by("model", F.struct("mape", "model")).alias("model")).groupBy("model").agg(F.count("*").alias("wins"))
    out = with_wilson(pooled, "hits", "n", "acc").join(med, "model").join(wins, "model", "left")
    return out.withColumn("wins", F.coalesce("wins", F.lit(0))).withColumn("edge_pp", (F.col("acc_rate") - best) * 100)


def staleness(configs: DataFrame, now: Column, max_age_days: float = 7.0, growth: float = 0.20, rmse_factor: float = 1.5) -> DataFrame:
    """Triggers that make a stored model configuration stale; an empty list means fresh."""
    age = (F.unix_timestamp(now) - F.unix_timestamp("trained_at")) / 86400.0
    found = F.filter(
        F.array(
            F.when(age > max_age_days, F.lit("age")),
            F.when((F.col("trained_n") > 0) & (F.col("current_n") > F.col("trained_n") * (1.0 + growth)), F.lit("series_grew")),
            F.when((F.col("cached_rmse") > 0) & (F.col("trailing_rmse") > rmse_factor * F.col("cached_rmse")), F.lit("trailing_rmse")),
        ),
        lambda x: x.isNotNull(),
    )
    return configs.withColumn("triggers", found)
