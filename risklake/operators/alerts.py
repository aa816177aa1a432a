"""Alert rules: evaluation, fan-out, edge and cooldown logic, preferences and feedback (batch)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from risklake.functions.scalar import dashed_pair, is_crypto_symbol, is_finite, slashed_pair
from risklake.operators.align import series
from risklake.session import free_shuffles, materialise

# Fixed values.
DEFAULT_COOLDOWN_SECONDS = 900
WATCHLIST_MAX = 200
SEVERITY_ORDER = {"INFO": 0, "ALERT": 1, "WARNING": 2, "ANOMALY": 3}
REFERENCE_GATES = {
    ("robust_z", "BTC-USD"): "BTC daily-bar crisis catalog (v1)",
    ("cusum", "BTC-USD"): "BTC daily-bar crisis catalog (v1)",
    ("dependence_shift", "XLK,XLF,XLE,XLV,SPY,TLT,GLD,HYG"): "8-asset macro daily basket (v1)",
}
KIND_MEANING = {
    "robust_z": "return deviated sharply from its recent baseline",
    "cusum": "a sustained cumulative drift accumulated in one direction",
    "regime_shift": "the recent return distribution stopped matching the reference window",
    "spread_widen": "the quoted bid-ask spread widened well beyond its baseline",
    "obi_extreme": "order-book depth became extremely one-sided",
    "quote_rate_spike": "quote traffic spiked far above its normal rate",
    "burst": "several different detectors fired together in a short window",
    "dependence_shift": "cross-asset correlation structure broke from its reference period",
    "volume_spike": "traded volume spiked far above its baseline",
    "microprice_drift": "the size-weighted microprice diverged from the last trade price",
}
NON_LIVE_FEEDS = {"synthetic": "a synthetic (simulated) feed", "csv": "a replayed historical file"}
CONFIG = "detector string, cooldown_seconds int, portfolio_id bigint, margin double, zscore_threshold double, divergence_threshold double, horizon_days int"


def with_config(rules: DataFrame) -> DataFrame:
    return rules.withColumn("cfg", F.from_json("extra_config", CONFIG))


def is_external() -> Column:
    return F.coalesce(F.lower("cfg.detector") == "external", F.lit(False))


def triggered_by(value: Column, direction: Column, threshold: Column) -> Column:
    return F.when(F.lower(direction) == "below", value <= threshold).otherwise(value >= threshold)


# ---- rule evaluation ----------------------------------------------------------------------
def price_threshold_rules(rules: DataFrame, latest: DataFrame) -> DataFrame:
    """``latest`` is (symbol, latest); rules without a price are untriggered with a reason."""
    j = rules.where("alert_type = 'price_threshold'").join(latest.withColumnRenamed("symbol", "ticker"), "ticker", "left")
    hit = triggered_by(F.col("latest"), F.col("direction"), F.col("threshold_value"))
    return j.select(
        "alert_id", "ticker", "alert_type", F.coalesce(hit, F.lit(False)).alias("triggered"), F.col("latest").alias("value"),
        F.col("threshold_value").alias("threshold"), F.when(F.col("latest").isNull(), "no price data").alias("reason"),
    )


def zscore_rules(rules: DataFrame, prices: DataFrame) -> DataFrame:
    """Latest return against the last ``lookback_days`` returns; external rules are left alone.

    The statistics are computed once per distinct (ticker, look-back), not per rule.
    """
    r = with_config(rules).where((F.col("alert_type") == "anomaly") & ~is_external())
    wanted = r.select("ticker", "lookback_days").distinct()
    w = series("symbol")
    ret = F.try_divide(F.col("price"), F.lag("price").over(w)) - 1
    moves = prices.withColumn("ret", ret).where("ret is not null").withColumn("_rn", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("date"))))
    stats = moves.join(wanted, moves["symbol"] == wanted["ticker"]).groupBy("ticker", "lookback_days").agg(
        F.count("*").alias("n"), F.max(F.when(F.col("_rn") == 1, F.col("ret"))).alias("latest_return"),
        F.avg(F.when(F.col("_rn") <= F.col("lookback_days"), F.col("ret"))).alias("mean"),
        F.stddev_samp(F.when(F.col("_rn") <= F.col("lookback_days"), F.col("ret"))).alias("sd"),
    )
    j = r.join(stats, ["ticker", "lookback_days"], "left")
    z = F.when(F.col("sd") == 0, 0.0).otherwise(F.abs(F.try_divide(F.col("latest_return") - F.col("mean"), F.col("sd"))))
    limit = F.coalesce("cfg.zscore_threshold", F.when(F.col("threshold_value") > 0, F.col("threshold_value")), F.lit(2.5))
    enough = F.coalesce(F.col("n") >= F.greatest("lookback_days", F.lit(5)), F.lit(False))
    return j.select(
        "alert_id", "ticker", "alert_type", (enough & F.coalesce(z >= limit, F.lit(False))).alias("triggered"), F.when(enough, z).alias("value"),
        F.when(enough, limit).alias("threshold"), F.when(~enough, "insufficient history").alias("reason"),
    )


def divergence_rules(rules: DataFrame, prices: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Forecast return minus realised return over the look-back. ``forecasts``: (symbol, end_price)."""
    r = with_config(rules).where("alert_type = 'forecast_divergence'")
    wanted = r.select("ticker", "lookback_days").distinct()
    desc = prices.withColumn("_rn", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("date")))).withColumn(
        "_n", F.count("*").over(W.partitionBy("symbol"))
    )
    back = desc.join(wanted, desc["symbol"] == wanted["ticker"]).groupBy("ticker", "lookback_days").agg(
        F.max(F.when(F.col("_rn") == 1, F.col("price"))).alias("last"),
        F.max(F.when(F.col("_rn") == F.least(F.col("lookback_days"), F.col("_n") - 1) + 1, F.col("price"))).alias("base"),
    )
    j = r.join(back, ["ticker", "lookback_days"], "left").join(forecasts.withColumnRenamed("symbol", "ticker"), "ticker", "left")
    gap = (F.col("end_price") / F.col("last") - 1) - (F.col("last") / F.col("base") - 1)
    limit = F.coalesce("cfg.divergence_threshold", F.when(F.col("threshold_value") != 0, F.abs("threshold_value")), F.lit(0.05))
    return j.select(
        "alert_id", "ticker", "alert_type", F.coalesce(F.abs(gap) >= limit, F.lit(False)).alias("triggered"), gap.alias("value"), limit.alias("threshold"),
        F.when(F.col("last").isNull(), "no price data").when(F.col("end_price").isNull(), "forecast unavailable").alias("reason"),
    )


def regime_watch_rules(rules: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Short correlation at or above the book's baseline plus the rule's margin."""
    r = with_config(rules).where("alert_type = 'regime_watch'").withColumn("portfolio_id", F.col("cfg.portfolio_id"))
    j = r.join(snapshots.select("portfolio_id", "status", "short_corr", "baseline_corr"), "portfolio_id", "left")
    ok = F.coalesce(F.col("status") == "ok", F.lit(False))
    limit = F.coalesce("baseline_corr", F.lit(0.0)) + F.coalesce("cfg.margin", F.lit(0.15))
    return j.select(
        "alert_id", "ticker", "alert_type", (ok & F.coalesce(F.col("short_corr") >= limit, F.lit(False))).alias("triggered"),
        F.when(ok, F.col("short_corr")).alias("value"), F.when(ok, limit).alias("threshold"),
        F.when(F.col("status").isNull(), "no measurement yet").when(~ok, "not enough data").alias("reason"),
    )


def skipped_rules(rules: DataFrame) -> DataFrame:
    """External and unsupported rules, untouched but explained."""
    r = with_config(rules)
    external = (F.col("alert_type") == "anomaly") & is_external()
    known = F.col("alert_type").isin("price_threshold", "anomaly", "forecast_divergence", "regime_watch")
    none = F.lit(None).cast("double")
    return r.where(external | ~known).select(
        "alert_id", "ticker", "alert_type", F.lit(False).alias("triggered"), none.alias("value"), none.alias("threshold"),
        F.when(external, "externally evaluated").otherwise("unsupported type").alias("reason"),
    )


def evaluate_rules(rules: DataFrame, prices: DataFrame, latest: DataFrame, forecasts: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Every rule once: one plan per type and a union; bad rules carry a reason and hurt nobody."""
    return (
        price_threshold_rules(rules, latest).unionByName(zscore_rules(rules, prices)).unionByName(divergence_rules(rules, prices, forecasts))
        .unionByName(regime_watch_rules(rules, snapshots)).unionByName(skipped_rules(rules))
    )


EDGE_ROWS = 1 << 20  # evaluations of one partition


def edge_events(evaluations: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Only the rows where a rule starts or stops being triggered.

    ``prior(alert_id, last_triggered)`` is the flag of each rule's newest stored event, one row per rule: a re-run does not fire again
    what has been fired. A rule without one starts untriggered. A rule is evaluated once per scheduler cycle, so its series is bounded
    by the clock. Evaluations are written once and dealt over partitions of about ``EDGE_ROWS``, so a task's memory does not grow with
    the table; the stored flag is joined only to what may be an edge: changes, and the first row of each rule.
    """
    rows = materialise(evaluations, "edge-evaluations")
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(max(least, -(-rows.count() // EDGE_ROWS)), "alert_id")
    rows = rows.withColumn("_prev", F.lag("triggered").over(W.partitionBy("alert_id").orderBy("evaluated_at"))).where("_prev is null or triggered <> _prev")
    if prior is not None:
        rows = rows.join(prior.select("alert_id", F.col("last_triggered").alias("_prior")), "alert_id", "left")
    known = F.col("_prior") if prior is not None else F.lit(None).cast("boolean")
    return rows.where(F.col("triggered") != F.coalesce("_prev", known, F.lit(False))).select(
        *evaluations.columns, F.when(F.col("triggered"), "rising").otherwise("falling").alias("edge")
    )


# ---- external detections -----------------------------------------------------------------
def canonical_detections(detections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(finite rows with their canonical ticker, rejected rows with a reason)."""
    rows = detections.withColumn("ticker", dashed_pair("symbol_raw"))
    good = is_finite("score") & is_finite("price")
    return rows.where(good), rows.where(~good).withColumn("reason", F.lit("score/price must be finite"))


def external_rules(rules: DataFrame) -> DataFrame:
    """Active anomaly rules that opted in to the external detector, with their cooldown."""
    r = with_config(rules).where((F.col("alert_type") == "anomaly") & F.col("is_active") & is_external())
    return r.select("alert_id", "user_id", "ticker", F.coalesce("cfg.cooldown_seconds", F.lit(DEFAULT_COOLDOWN_SECONDS)).alias("cooldown_seconds"))


def fan_out(detections: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(detection × matching rule, unmatched detections). The ticker key may be skewed: AQE splits it."""
    matched = detections.join(rules, "ticker")
    return matched, detections.join(rules.select("ticker").distinct(), "ticker", "left_anti")


def monitored_symbols(rules: DataFrame, classes: DataFrame, feed: str = "crypto", limit: int = WATCHLIST_MAX) -> DataFrame:
    """Symbols a feed should subscribe to, in order, with the total and whether it was cut."""
    tickers = external_rules(rules).select("ticker").distinct()
    j = tickers.join(classes.select(F.col("symbol").alias("ticker"), "asset_class"), "ticker", "left")
    crypto = feed.strip().lower() == "crypto"
    mine = j.where(is_crypto_symbol(F.col("ticker"), F.col("asset_class")) == F.lit(crypto))
    shown = mine.orderBy("ticker").limit(limit).select((slashed_pair("ticker") if crypto else F.col("ticker")).alias("symbol"))
    return shown.withColumn("total", mine.agg(F.count("*")).scalar()).withColumn("truncated", F.col("total") > limit)


def holdings_without_rule(positions: DataFrame, rules: DataFrame) -> DataFrame:
    """Per user: tickers to create, tickers already monitored, and the union count."""
    held = positions.select("user_id", F.col("symbol").alias("ticker")).distinct().withColumn("held", F.lit(1))
    watched = with_config(rules).where((F.col("alert_type") == "anomaly") & is_external()).select("user_id", "ticker").distinct().withColumn("watched", F.lit(1))
    both = held.join(watched, ["user_id", "ticker"], "full_outer")
    return both.groupBy("user_id").agg(
        F.count(F.when(F.col("watched").isNull(), 1)).alias("to_create"), F.count(F.when(F.col("held").isNotNull() & F.col("watched").isNotNull(), 1)).alias("already_monitored"),
        F.count("*").alias("total_monitored"),
    )


TILE_ROWS = 1 << 13  # rules, and books, of an owner and symbol in one tile
TASK_PAIRS = 1 << 26  # pairs of rule and book made by one task
LIST_ROWS = 256  # rules that travel together; a multiple of eight, so that files pack each round of a list into the same bytes


def alert_exposure(rules: DataFrame, positions: DataFrame, events: DataFrame, shared: bool = True, time_format: str | None = None) -> DataFrame:
    """Portfolios of the rule's owner holding its ticker, with the rule's newest event.

    An owner with many rules and many books has a row for each pair of them, so the event is joined to the rules, and its time written
    by ``time_format`` if one is given, before the pairs are made. ``shared``: owners have many rules and books; the pairs are then
    made in tiles of bounded size. Without it a plain join makes them, for owners of a few books.
    """
    mine = rules.select("alert_id", "user_id", F.upper("ticker").alias("symbol"))
    last = latest_events(events)
    if time_format:
        last = last.withColumn("last_evaluated_at", F.date_format("last_evaluated_at", time_format))
    held = positions.select("user_id", "portfolio_id", "symbol", "weight")
    return _pairs_by_tiles(mine, last, held) if shared else mine.join(last, "alert_id", "left").join(held, ["user_id", "symbol"])


def _pairs_by_tiles(mine: DataFrame, last: DataFrame, held: DataFrame) -> DataFrame:
    """Rules with their newest event, joined to the books of their owner and symbol; work is dealt by the number of pairs, not of input rows.

    Rules and books of an owner and symbol are dealt over tiles, and each pair of tiles is one key. Rules travel in lists: a list meets
    its books one after the other and is opened only then, so the same few rules repeat in the output, which files hold in little space.
    """
    by = ["user_id", "symbol"]
    held = materialise(held, "exposure-books")
    free_shuffles(held.sparkSession)
    groups = mine.groupBy(*by).agg(F.count("*").alias("_rules")).join(held.groupBy(*by).agg(F.count("*").alias("_books")), by)
    groups = materialise(groups, "exposure-groups")
    pairs = groups.agg(F.sum(F.col("_rules").cast("double") * F.col("_books"))).first()[0] or 0
    tasks = max(1, math.ceil(pairs / TASK_PAIRS))
    tiles = groups.select(*by, F.ceil(F.col("_rules") / TILE_ROWS).alias("_rt"), F.ceil(F.col("_books") / TILE_ROWS).alias("_bt"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    rule = F.struct("alert_id", "last_triggered", "last_evaluated_at")
    lists = mine.join(last, "alert_id", "left").join(tiles, by).groupBy(*by, "_bt", dealt("alert_id", "_rt").alias("_r")).agg(F.sort_array(F.collect_list(rule)).alias("_all"))
    lists = lists.withColumn("_lists", F.ceil(F.size("_all") / LIST_ROWS)).withColumn("_k", each("_lists"))
    lists = lists.select(*by, "_r", each("_bt").alias("_b"), F.slice("_all", (F.col("_k") * LIST_ROWS + 1).cast("int"), LIST_ROWS).alias("_list"))
    books = held.join(tiles, by).select(*held.columns, dealt("portfolio_id", "_bt").alias("_b"), each("_rt").alias("_r"))
    keys = [*by, "_b", "_r"]
    met = lists.repartition(tasks, *keys).join(books.repartition(tasks, *keys), keys)
    return met.select("user_id", "symbol", "portfolio_id", "weight", F.inline("_list"))


def latest_events(events: DataFrame) -> DataFrame:
    newest = F.max_by(F.struct("triggered", "evaluated_at"), F.struct("evaluated_at", "event_id"))
    return events.groupBy("alert_id").agg(newest.alias("e")).select(
        "alert_id", F.col("e.triggered").alias("last_triggered"), F.col("e.evaluated_at").alias("last_evaluated_at")
    )


def rules_on_holdings(rules: DataFrame, positions: DataFrame, events: DataFrame) -> DataFrame:
    """Active rules whose ticker their owner holds, each with its newest event."""
    held = positions.select("user_id", F.col("symbol").alias("ticker")).distinct()
    mine = rules.where("is_active").join(held, ["user_id", "ticker"], "left_semi")
    return mine.join(latest_events(events), "alert_id", "left")


def reference_gate(kind: Column, ticker: Column) -> Column:
    """Name of the labelled catalog this exact (kind, symbol) was scored against, else NULL."""
    out = F.lit(None).cast("string")
    for (k, t), label in REFERENCE_GATES.items():
        out = F.when((kind == k) & (ticker == t), label).otherwise(out)
    return out


# ---- ingest ------------------------------------------------------------------------------
def ingest_report(received: DataFrame, matched: DataFrame, unmatched: DataFrame, decided: DataFrame) -> DataFrame:
    """Received, matched, persisted, suppressed and unmatched counts, one row."""
    parts = [
        received.agg(F.count("*").alias("n")).withColumn("what", F.lit("received")),
        matched.agg(F.count("*").alias("n")).withColumn("what", F.lit("matched_rules")),
        decided.where("kept").agg(F.count("*").alias("n")).withColumn("what", F.lit("events_persisted")),
        decided.where("not kept").agg(F.count("*").alias("n")).withColumn("what", F.lit("suppressed")),
        unmatched.agg(F.count_distinct("ticker").alias("n")).withColumn("what", F.lit("unmatched_symbols")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---- preferences and feedback ---------------------------------------------------------------
def in_quiet_hours(ts: Column, start: Column, end: Column, tz_offset_min: Column) -> Column:
    """Local hour inside [start, end), wrapping midnight; equal bounds switch it off."""
    local = F.timestamp_seconds(F.unix_timestamp(ts) + F.coalesce(tz_offset_min, F.lit(0)) * 60)
    h = F.hour(local)
    return F.when(start == end, F.lit(False)).when(start < end, (h >= start) & (h < end)).otherwise((h >= start) | (h < end))


def severity_rank(severity: Column, unknown: int) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SEVERITY_ORDER.items() for x in kv])
    return F.coalesce(F.element_at(table, F.upper(severity)), F.lit(unknown))


def notification_decisions(alerts: DataFrame, prefs: DataFrame) -> DataFrame:
    """``notify`` and the first reason against it. Alerts carry user_id, ticker, kind, severity, ts."""
    j = alerts.join(prefs, "user_id", "left")
    muted = lambda c, v: F.coalesce(F.exists(c, lambda m: F.upper(m) == F.upper(F.col(v))), F.lit(False))
    low = severity_rank(F.col("severity"), 99) < severity_rank(F.coalesce("min_severity", F.lit("ALERT")), 1)
    quiet = F.coalesce(in_quiet_hours(F.col("ts"), F.col("quiet_start"), F.col("quiet_end"), F.col("tz_offset_min")), F.lit(False))
    reason = (
        F.when(~F.coalesce("email_enabled", F.lit(True)), "disabled").when(muted("muted_tickers", "ticker"), "muted_ticker")
        .when(muted("muted_kinds", "kind"), "muted_kind").when(low, "below_severity").when(quiet, "quiet_hours")
    )
    return j.select(*alerts.columns, reason.alias("reason"), reason.isNull().alias("notify"))


def feedback_latest(feedback: DataFrame) -> DataFrame:
    """One row per (event, user): the rating is overwritten, the first row's identity stays."""
    return feedback.groupBy("event_id", "user_id").agg(
        F.max_by("rating", F.struct("created_at", "rating")).alias("rating"), F.min_by("ticker", F.struct("created_at", "ticker", "kind")).alias("ticker"),
        F.min_by("kind", F.struct("created_at", "ticker", "kind")).alias("kind"),
        F.min("created_at").alias("created_at"),
    )


def feedback_summary(feedback: DataFrame) -> DataFrame:
    kind = F.coalesce("kind", F.lit("unknown"))
    return feedback.groupBy("user_id", kind.alias("kind")).agg(
        F.count("*").alias("total"), F.count(F.when(F.col("rating") == "useful", 1)).alias("useful"), F.count(F.when(F.col("rating") == "not_useful", 1)).alias("not_useful")
    )


def auto_muted_kinds(feedback: DataFrame, prefs: DataFrame) -> DataFrame:
    """(user, kind) whose last K ratings on some ticker are all not useful; K = 0 disables.

    The last K are all bad exactly when at least K ratings follow the last good one, which two
    combining aggregates answer without sorting any user's ratings.
    """
    keys = ["user_id", "ticker", "kind"]
    at = F.struct("created_at", "event_id")
    named = feedback.where("kind is not null and kind <> ''").withColumn("_at", at)
    good = named.where("rating <> 'not_useful'").groupBy(*keys).agg(F.max("_at").alias("_good"))
    streak = named.join(good, keys, "left").where("_good is null or _at > _good").groupBy(*keys).agg(F.count("*").alias("n"))
    limits = prefs.select("user_id", "auto_mute_after").where("auto_mute_after > 0")
    return streak.join(limits, "user_id").where("n >= auto_mute_after").select("user_id", F.lower("kind").alias("kind")).distinct()


def updated_mutes(prefs: DataFrame, muted: DataFrame) -> DataFrame:
    """Preferences with newly muted kinds added, compared without case."""
    new = muted.groupBy("user_id").agg(F.array_sort(F.collect_set("kind")).alias("_new"))  # at most one per known kind
    have = F.transform("muted_kinds", F.lower)
    fresh = F.filter(F.coalesce("_new", F.array().cast("array<string>")), lambda x: ~F.array_contains(have, x))
    return prefs.join(new, "user_id", "left").withColumn("muted_kinds", F.concat("muted_kinds", fresh)).drop("_new")


def kind_meaning(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in KIND_MEANING.items() for x in kv]), kind)


def feed_label(feed: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in NON_LIVE_FEEDS.items() for x in kv]), feed)


def unread_counts(events: DataFrame, last_seen: DataFrame) -> DataFrame:
    """Triggered events newer than each user's last visit."""
    j = events.where("triggered").join(last_seen, "user_id", "left")
    new = F.col("last_seen").isNull() | (F.col("evaluated_at") > F.col("last_seen"))
    return j.groupBy("user_id").agg(F.count(F.when(new, 1)).alias("unread"))
