"""Registered queries: alert evaluation, ingest, preferences, feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from risklake.operators import alerts as al
from risklake.operators import metrics as m
from risklake.operators import screener as scr
from risklake.operators.cooldown import cooldown, last_kept
from risklake.plans.catalog_metrics import LT
from risklake.plans.catalog_risk import WATCH_SQL, regime_watch
from risklake.plans.registry import TIME_FORMAT, register
from risklake.session import materialise
from risklake.sources.testdata import Tables
from risklake.streaming import jobs

TABLE = ", ".join(f"('{k}','{v}')" for k, v in al.KIND_MEANING.items())


def _forecasts(t: Tables):
    return t.prices_daily.groupBy("symbol").agg((F.max_by("price", "date") * 1.2).alias("end_price"))


PRICE_SQL = f"""SELECT alert_id, ticker, alert_type, coalesce(CASE WHEN direction='below' THEN latest<=threshold_value ELSE latest>=threshold_value END, false) AS triggered,
    latest AS value, threshold_value AS threshold, CASE WHEN latest IS NULL THEN 'no price data' END AS reason FROM rules LEFT JOIN {LT} c ON c.symbol=ticker WHERE alert_type='price_threshold'"""
ZSCORE_SQL = """SELECT alert_id, ticker, alert_type, n>=greatest(lookback_days,5) AND z>=lim AS triggered, z AS value, lim AS threshold, CAST(NULL AS VARCHAR) AS reason FROM (SELECT r.*, n, CASE WHEN sd=0 THEN 0 ELSE abs((lr-mu)/sd) END AS z,
    CASE WHEN threshold_value>0 THEN threshold_value ELSE 2.5 END AS lim FROM rules r JOIN LATERAL (SELECT count(*) AS n, max(ret) FILTER (rn=1) AS lr, avg(ret) FILTER (rn<=lookback_days) AS mu, stddev_samp(ret) FILTER (rn<=lookback_days) AS sd
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM rd1) x WHERE x.symbol=r.ticker) s ON true WHERE alert_type='anomaly' AND detector IS NULL)"""
DIVERGE_SQL = f"""SELECT alert_id, ticker, alert_type, abs(gap)>=lim AS triggered, gap AS value, lim AS threshold, CAST(NULL AS VARCHAR) AS reason FROM (SELECT r.*, (1.2e0-1)-(a.price/b.price-1) AS gap,
    CASE WHEN threshold_value<>0 THEN abs(threshold_value) ELSE 0.05 END AS lim FROM rules r JOIN (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM pdaily) a ON a.symbol=ticker AND a.rn=1
    JOIN (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM pdaily) b ON b.symbol=ticker AND b.rn=lookback_days+1 WHERE alert_type='forecast_divergence')"""
REGIME_SQL = f"""SELECT alert_id, ticker, alert_type, coalesce(status='ok',false) AND short_corr>=coalesce(baseline_corr,0)+0.1 AS triggered, CASE WHEN status='ok' THEN short_corr END AS value, CASE WHEN status='ok' THEN coalesce(baseline_corr,0)+0.1 END AS threshold,
    CASE WHEN status IS NULL THEN 'no measurement yet' WHEN status<>'ok' THEN 'not enough data' END AS reason FROM rules LEFT JOIN ({WATCH_SQL}) w ON w.portfolio_id=watch_portfolio WHERE alert_type='regime_watch'"""
SKIP_SQL = """SELECT alert_id, ticker, alert_type, false AS triggered, NULL AS value, NULL AS threshold, CASE WHEN detector IS NOT NULL THEN 'externally evaluated' ELSE 'unsupported type' END AS reason FROM rules
    WHERE detector IS NOT NULL OR alert_type='volume_burst'"""
_EVAL_COLS = "alert_id:i ticker:s alert_type:s triggered:b value:d4 threshold:d4 reason:s"


@register("alt_01_price_threshold", _EVAL_COLS, PRICE_SQL)
def _(t: Tables):
    return al.price_threshold_rules(t.alert_rules, m.latest_two_closes(t.prices_daily))


@register("alt_02_zscore_anomaly", _EVAL_COLS, ZSCORE_SQL)
def _(t: Tables):
    return al.zscore_rules(t.alert_rules, t.prices_daily)


@register("alt_03_forecast_divergence", _EVAL_COLS, DIVERGE_SQL)
def _(t: Tables):
    return al.divergence_rules(t.alert_rules, t.prices_daily, _forecasts(t))


@register("alt_04_regime_watch", _EVAL_COLS, REGIME_SQL, store="prices_weekly positions")
def _(t: Tables):
    return al.regime_watch_rules(t.alert_rules, regime_watch(t))


@register(
    "alt_05_evaluate_all", _EVAL_COLS,
    f"{PRICE_SQL} UNION ALL SELECT * FROM ({ZSCORE_SQL}) UNION ALL SELECT * FROM ({DIVERGE_SQL}) UNION ALL SELECT * FROM ({REGIME_SQL}) UNION ALL {SKIP_SQL}",
    store="prices_daily prices_weekly positions",
)
def _(t: Tables):
    return al.evaluate_rules(t.alert_rules, t.prices_daily, m.latest_two_closes(t.prices_daily), _forecasts(t), regime_watch(t))


EVALS_SQL = """SELECT alert_id, date AS evaluated_at, CASE WHEN direction='below' THEN price<=threshold_value ELSE price>=threshold_value END AS triggered FROM rules JOIN pw ON symbol=ticker WHERE alert_type='price_threshold'"""
EVENTS_SQL = """SELECT event_id, user_id*10+event_id%10 AS alert_id, user_id, value>30 AS triggered, ts AS evaluated_at, 'U'||user_id AS ticker,
    CASE WHEN event_type='error' THEN 'regime_watch' ELSE 'external' END AS detector_source FROM events"""
_LAST = f"(SELECT alert_id, arg_max(triggered, evaluated_at) AS last_triggered, max(evaluated_at) AS last_evaluated_at FROM ({EVENTS_SQL}) GROUP BY 1)"
# the newest stored event of a rule is what its first evaluation is compared with
EDGE_SQL = f"""SELECT alert_id, evaluated_at, triggered, CASE WHEN triggered THEN 'rising' ELSE 'falling' END AS edge FROM (SELECT e.*, coalesce(lag(triggered) OVER (PARTITION BY e.alert_id ORDER BY e.evaluated_at), l.last_triggered, false) AS pv
    FROM ({EVALS_SQL}) e LEFT JOIN {_LAST} l ON l.alert_id=e.alert_id) WHERE triggered<>pv"""


def _evaluations(rules, prices):
    j = rules.where("alert_type = 'price_threshold'").join(prices.withColumnRenamed("symbol", "ticker"), "ticker")
    hit = al.triggered_by(F.col("price"), F.col("direction"), F.col("threshold_value"))
    return j.select("alert_id", F.col("date").cast("timestamp").alias("evaluated_at"), hit.alias("triggered"))


@register("alt_06_edge_trigger", "alert_id:i evaluated_at:t triggered:b edge:s", EDGE_SQL)
def _(t: Tables):
    return al.edge_events(_evaluations(t.alert_rules, t.prices_weekly), al.latest_events(_events(t)))


@register("alt_06_edge_trigger_stream", "alert_id:i evaluated_at:t triggered:b edge:s", EDGE_SQL)
def _(t: Tables):
    """The same decision as a stream: the stored events land first, then the evaluations in three parts, with a restart after each."""
    rows = materialise(_evaluations(t.alert_rules, t.prices_weekly).withColumn("stored", F.lit(False)), "edge-evaluations")
    stored = al.latest_events(_events(t)).join(rows.select("alert_id").distinct(), "alert_id", "left_semi")
    stored = stored.select("alert_id", F.col("last_evaluated_at").alias("evaluated_at"), F.col("last_triggered").alias("triggered"), F.lit(True).alias("stored"))
    year = F.year("evaluated_at")
    # by rule, so that one file, and with it one micro-batch, has all rows of a rule of a landing
    landings = [stored, *(part.repartition("alert_id") for part in (rows.where(year < 1997), rows.where((year >= 1997) & (year < 2000)), rows.where(year >= 2000)))]
    return jobs.drain_landings(landings, jobs.edge_stream, "alert_id long, evaluated_at timestamp, triggered boolean, stored boolean")


def _matched(t: Tables):
    good, _ = al.canonical_detections(t.detections)
    return al.fan_out(good, al.external_rules(t.alert_rules))


MATCH_SQL = """SELECT d.*, r.alert_id, r.user_id AS owner, r.cooldown_seconds FROM det d JOIN rules r ON r.ticker=d.ticker WHERE d.is_finite AND r.detector IS NOT NULL AND r.is_active"""
# the kept chain itself, one rule at a time: next event beyond the last kept one
COOL_SQL = f"""WITH RECURSIVE mt AS MATERIALIZED ({MATCH_SQL}), ch(alert_id, cooldown_seconds, ts) AS (SELECT alert_id, any_value(cooldown_seconds), min(ts) FROM mt WHERE cooldown_seconds>0 GROUP BY 1
    UNION ALL SELECT ch.alert_id, ch.cooldown_seconds, (SELECT min(ts) FROM mt x WHERE x.alert_id=ch.alert_id AND x.ts > ch.ts + to_seconds(ch.cooldown_seconds)) FROM ch WHERE ch.ts IS NOT NULL),
    cd AS (SELECT mt.alert_id, mt.event_id, mt.cooldown_seconds=0 OR ch.ts IS NOT NULL AS kept FROM mt LEFT JOIN (SELECT * FROM ch WHERE ts IS NOT NULL) ch ON ch.alert_id=mt.alert_id AND ch.ts=mt.ts)"""


@register("alt_07_cooldown", "alert_id:i event_id:i kept:b", f"{COOL_SQL} SELECT * FROM cd")
def _(t: Tables):
    return cooldown(_matched(t)[0])


@register("alt_07_cooldown_continued", "alert_id:i event_id:i kept:b", f"{COOL_SQL} SELECT * FROM cd WHERE event_id IN (SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00')")
def _(t: Tables):
    """Two runs: the first leaves the last kept time of each rule, the second goes on from there."""
    matched, cut = _matched(t)[0], F.lit("2024-01-15").cast("timestamp")
    earlier = cooldown(matched.where(F.col("ts") < cut))
    return cooldown(matched.where(F.col("ts") >= cut), last_kept(earlier))


@register("alt_07_cooldown_stream", "alert_id:i event_id:i kept:b", f"{COOL_SQL} SELECT * FROM cd")
def _(t: Tables):
    """The same decision as a stream-static join with per-rule state."""
    from risklake import schemas
    from risklake.streaming.telemetry import read_messages

    stream = read_messages(t.spark, t.dir, schemas.EVENTS, name_filter="events.parquet")
    streamed = Tables(t.spark, t.dir)
    streamed.raw = lambda name: stream if name == "events" else t.raw(name)  # same derivation, streaming source
    good, _ = al.canonical_detections(streamed.detections)
    matched, _ = al.fan_out(good, al.external_rules(t.alert_rules))
    return jobs.drain(jobs.cooldown_stream(matched))


@register(
    "alt_08_ingest_report", "what:s n:i",
    f"""{COOL_SQL} SELECT 'received' AS what, count(*) AS n FROM det UNION ALL SELECT 'matched_rules', count(*) FROM mt UNION ALL SELECT 'events_persisted', count(*) FROM cd WHERE kept
        UNION ALL SELECT 'suppressed', count(*) FROM cd WHERE NOT kept UNION ALL SELECT 'unmatched_symbols', count(DISTINCT ticker) FROM det WHERE is_finite AND ticker NOT IN (SELECT ticker FROM rules WHERE detector IS NOT NULL AND is_active)""",
)
def _(t: Tables):
    matched, unmatched = _matched(t)
    return al.ingest_report(t.detections, matched, unmatched, cooldown(matched))


@register("alt_09_reference_gate", "event_id:i gate:s", "SELECT event_id, CASE WHEN kind IN ('robust_z','cusum') AND user_id=1 THEN 'BTC daily-bar crisis catalog (v1)' END AS gate FROM det JOIN events USING (event_id)")
def _(t: Tables):
    ticker = F.when(F.col("symbol_raw") == " u1/usd", "BTC-USD").otherwise(F.col("symbol_raw"))
    return t.detections.select("event_id", al.reference_gate(F.col("kind"), ticker).alias("gate"))


_SEV = "CASE upper({s}) WHEN 'INFO' THEN 0 WHEN 'ALERT' THEN 1 WHEN 'WARNING' THEN 2 WHEN 'ANOMALY' THEN 3 ELSE 99 END"
_HOUR = "hour(ts + to_minutes(tz_offset_min))"
QUIET_SQL = f"CASE WHEN quiet_start=quiet_end THEN false WHEN quiet_start<quiet_end THEN {_HOUR}>=quiet_start AND {_HOUR}<quiet_end ELSE {_HOUR}>=quiet_start OR {_HOUR}<quiet_end END"


def _alerts(t: Tables):
    user = t.raw("events").select("event_id", "user_id")
    return t.detections.join(user, "event_id").withColumn("ticker", F.concat(F.lit("U"), F.col("user_id").cast("string"), F.lit("-USD")))


@register(
    "alt_10_notification_decision", "event_id:i notify:b reason:s",
    f"""SELECT event_id, reason IS NULL AS notify, reason FROM (SELECT event_id, CASE WHEN NOT email_enabled THEN 'disabled' WHEN mutes_own THEN 'muted_ticker' WHEN mutes_kinds AND kind IN ('cusum','burst') THEN 'muted_kind'
        WHEN {_SEV.format(s='severity')} < {_SEV.format(s='min_severity')} THEN 'below_severity' WHEN {QUIET_SQL} THEN 'quiet_hours' END AS reason
        FROM (SELECT d.*, e.user_id FROM det d JOIN events e ON e.event_id=d.event_id) d JOIN prefs p ON p.user_id=d.user_id)""",
)
def _(t: Tables):
    return al.notification_decisions(_alerts(t), t.alert_prefs)


@register(
    "alt_11_quiet_hours", "event_id:i quiet:b",
    f"SELECT event_id, {QUIET_SQL} AS quiet FROM events e JOIN prefs p ON p.user_id=e.user_id",
)
def _(t: Tables):
    j = t.raw("events").join(t.alert_prefs, "user_id")
    return j.select("event_id", al.in_quiet_hours(F.col("ts"), F.col("quiet_start"), F.col("quiet_end"), F.col("tz_offset_min")).alias("quiet"))


FB1 = """SELECT event_id, user_id, arg_max(rating, created_at) AS rating, arg_min(ticker, created_at) AS ticker, arg_min(coalesce(kind,''), created_at) AS kind, min(created_at) AS created_at FROM fb GROUP BY 1,2"""


@register("alt_12_feedback_upsert", "event_id:i user_id:i rating:s ticker:s created_at:ts", FB1)
def _(t: Tables):
    return al.feedback_latest(t.feedback)


@register(
    "agg_29_feedback_summary", "user_id:i kind:s total:i useful:i not_useful:i",
    """SELECT user_id, coalesce(kind,'unknown') AS kind, count(*) AS total, count(*) FILTER (rating='useful') AS useful, count(*) FILTER (rating='not_useful') AS not_useful FROM fb GROUP BY 1,2""",
)
def _(t: Tables):
    return al.feedback_summary(t.feedback)


MUTE_SQL = """SELECT DISTINCT user_id, kind FROM (SELECT f.user_id, ticker, kind, bool_and(rating='not_useful') AS bad, count(*) AS n, any_value(k) AS k FROM (SELECT fb.*, auto_mute_after AS k, row_number() OVER
    (PARTITION BY fb.user_id, ticker, kind ORDER BY created_at DESC, event_id DESC) AS rn FROM fb JOIN prefs p ON p.user_id=fb.user_id WHERE kind IS NOT NULL AND auto_mute_after>0) f WHERE rn<=k GROUP BY 1,2,3) WHERE bad AND n=k"""


@register("alt_13_auto_mute", "user_id:i kind:s", MUTE_SQL)
def _(t: Tables):
    return al.auto_muted_kinds(t.feedback, t.alert_prefs)


@register(
    "alt_13_updated_mutes", "user_id:i n_kinds:i",
    f"""SELECT p.user_id, CASE WHEN mutes_kinds THEN 2 ELSE 0 END + count(kind) FILTER (NOT (mutes_kinds AND kind IN ('cusum','burst'))) AS n_kinds FROM prefs p LEFT JOIN ({MUTE_SQL}) u ON u.user_id=p.user_id GROUP BY p.user_id, mutes_kinds""",
)
def _(t: Tables):
    return al.updated_mutes(t.alert_prefs, al.auto_muted_kinds(t.feedback, t.alert_prefs)).withColumn("n_kinds", F.size("muted_kinds"))


@register("alt_14_detector_meaning", "event_id:i meaning:s", f"SELECT event_id, meaning FROM det LEFT JOIN (VALUES {TABLE}) k(kind, meaning) ON k.kind=det.kind")
def _(t: Tables):
    return t.detections.withColumn("meaning", al.kind_meaning(F.col("kind")))



def _events(t: Tables):
    """Alert events out of the event rows: ten rules per user."""
    e = t.raw("events")
    source = F.when(F.col("event_type") == "error", "Regime_Watch").otherwise("external")
    return e.select(
        "event_id", (F.col("user_id") * 10 + F.col("event_id") % 10).alias("alert_id"), "user_id", (F.col("value") > 30).alias("triggered"), F.col("ts").alias("evaluated_at"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"), F.to_json(F.struct(source.alias("detector_source"))).alias("payload"),
    )


@register(
    "alt_15_unread_counts", "user_id:i unread:i",
    f"""SELECT e.user_id, count(*) FILTER (evaluated_at > TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(e.user_id%40 AS INTEGER)) OR e.user_id%7=0) AS unread FROM ({EVENTS_SQL}) e WHERE triggered GROUP BY 1""",
)
def _(t: Tables):
    key = F.col("c_custkey")
    seen = t.raw("customer").select(
        key.alias("user_id"), F.when(key % 7 != 0, F.timestamp_seconds(F.lit(1704067200) + (key % 40) * 86400)).alias("last_seen")
    )
    return al.unread_counts(_events(t), seen)


@register(
    "flt_07_event_listing", "event_id:i alert_id:i ticker:s evaluated_at:ts",
    f"""SELECT event_id, alert_id, ticker, evaluated_at FROM ({EVENTS_SQL}) WHERE alert_id IN (SELECT alert_id FROM rules WHERE user_id=3) AND triggered AND detector_source='regime_watch' ORDER BY evaluated_at DESC, event_id DESC LIMIT 1000""",
)
def _(t: Tables):
    return scr.list_events(_events(t), t.alert_rules, user_id=3, triggered_only=True, detector_source=" regime_watch", limit=1000)

@register(
    "join_08_alert_exposure", "alert_id:i portfolio_id:i symbol:s weight:d6 last_triggered:b last_evaluated_at:ts",
    f"""SELECT r.alert_id, h.portfolio_id, h.symbol, h.weight, last_triggered, last_evaluated_at FROM rules r JOIN posc h ON h.user_id=r.user_id AND h.symbol=upper(r.ticker) LEFT JOIN {_LAST} l ON l.alert_id=r.alert_id""",
    ready="last_evaluated_at",
)
def _(t: Tables):
    return al.alert_exposure(t.alert_rules, t.positions_by_customer, _events(t), time_format=TIME_FORMAT)


@register(
    "join_08_customer_exposure", "alert_id:i portfolio_id:i symbol:s weight:d6 last_triggered:b last_evaluated_at:ts",
    f"""SELECT r.alert_id, h.portfolio_id, h.symbol, h.weight, last_triggered, last_evaluated_at FROM rules r JOIN posc h ON h.portfolio_id=r.alert_id AND h.symbol=upper(r.ticker) LEFT JOIN {_LAST} l ON l.alert_id=r.alert_id""",
)
def _(t: Tables):
    # rule and portfolio belong to the customer: an owner has a few rules and books, not those of a whole nation
    rules = t.alert_rules.withColumn("user_id", F.col("alert_id"))
    return al.alert_exposure(rules, t.positions_by_customer.withColumn("user_id", F.col("portfolio_id")), _events(t), shared=False)


@register(
    "join_09_monitored_symbols", "symbol:s total:i truncated:b",
    """WITH x AS (SELECT DISTINCT ticker FROM rules WHERE detector IS NOT NULL AND is_active AND alert_type='anomaly') SELECT replace(ticker,'-','/') AS symbol, (SELECT count(*) FROM x) AS total, (SELECT count(*) FROM x)>200 AS truncated
       FROM x ORDER BY ticker LIMIT 200""",
)
def _(t: Tables):
    return al.monitored_symbols(t.alert_rules, t.assets.select("symbol", "asset_class"))


@register(
    "join_10_holdings_without_rule", "user_id:i to_create:i already_monitored:i total_monitored:i",
    """WITH h AS (SELECT DISTINCT user_id, CASE WHEN portfolio_id%2=0 THEN 'U'||(portfolio_id//10)||'-USD' ELSE symbol END AS ticker FROM posc), w AS (SELECT DISTINCT user_id, ticker FROM rules WHERE detector IS NOT NULL AND alert_type='anomaly'),
       b AS (SELECT coalesce(h.user_id,w.user_id) AS user_id, h.ticker AS ht, w.ticker AS wt FROM h FULL JOIN w ON h.user_id=w.user_id AND h.ticker=w.ticker)
       SELECT user_id, count(*) FILTER (wt IS NULL) AS to_create, count(*) FILTER (ht IS NOT NULL AND wt IS NOT NULL) AS already_monitored, count(*) AS total_monitored FROM b GROUP BY 1""",
)
def _(t: Tables):
    coin = F.concat(F.lit("U"), F.floor(F.col("portfolio_id") / 10).cast("string"), F.lit("-USD"))
    held = t.positions_by_customer.withColumn("symbol", F.when(F.col("portfolio_id") % 2 == 0, coin).otherwise(F.col("symbol")))
    return al.holdings_without_rule(held, t.alert_rules)


@register("join_11_alert_fan_out", "event_id:i alert_id:i ticker:s kind:s", MATCH_SQL)
def _(t: Tables):
    return _matched(t)[0]


@register(
    "join_11_unmatched", "event_id:i ticker:s",
    "SELECT event_id, ticker FROM det WHERE is_finite AND ticker NOT IN (SELECT ticker FROM rules WHERE detector IS NOT NULL AND is_active)",
)
def _(t: Tables):
    return _matched(t)[1]


@register(
    "join_20_rules_on_holdings", "alert_id:i ticker:s alert_type:s last_triggered:b last_evaluated_at:ts",
    f"""SELECT r.alert_id, r.ticker, r.alert_type, last_triggered, last_evaluated_at FROM rules r LEFT JOIN {_LAST} l ON l.alert_id=r.alert_id WHERE is_active AND EXISTS (SELECT 1 FROM posc h WHERE h.user_id=r.user_id AND h.symbol=r.ticker)""",
)
def _(t: Tables):
    return al.rules_on_holdings(t.alert_rules, t.positions_by_customer, _events(t))


