from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from risklake.functions import scalar
from risklake.operators import alerts, screener
from risklake.operators.cooldown import cooldown, last_kept
from risklake.sources import holdings_csv, market, sinks
from risklake.streaming import jobs, telemetry as tel


def _column(spark, values, fn, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(fn("x")).collect()]


def test_messy_numbers_and_dates(spark):
    assert _column(spark, ["$1,234.56", "(500)", "10%", "", "n/a", "-", "abc", None], scalar.clean_number) == [1234.56, -500.0, 10.0, None, None, None, None, None]
    got = _column(spark, ["2024-03-05", "3/5/2024", "03/05/24", "25/12/2023", "5-Mar-2024", "Mar 5, 2024", "03-05-2024", "2024/03/05", "various", "1/2/70"], scalar.parse_date)
    day = dt.date(2024, 3, 5)
    assert got == [day, day, day, dt.date(2023, 12, 25), day, day, day, day, None, dt.date(1970, 1, 2)]


def test_formatting_and_labels(spark):
    assert _column(spark, [1_250_000.0, -40_200.0, 512.0], scalar.compact_money, "double") == ["$1.25M", "-$40K", "$512"]
    assert _column(spark, [0.0123, -0.5, float("nan")], scalar.signed_percent, "double") == ["+1.23%", "-50.00%", "—"]
    assert _column(spark, ["a@b.co", "A@B.CO ", "a b@c.d", "a@b", None], scalar.is_email) == [True, True, False, False, False]
    assert _column(spark, ["BTC-USD", "ETHUSDT", "SOLUSDC", "AAPL"], scalar.slashed_pair) == ["BTC/USD", "ETH/USDT", "SOL/USDC", "AAPL"]


@pytest.mark.parametrize("text, is_open", [("2024-01-08 14:29:59", False), ("2024-01-08 14:30:00", True), ("2024-01-08 21:00:30", True), ("2024-01-08 21:01:00", False), ("2024-01-06 16:00:00", False), ("2024-07-08 13:30:00", True)])
def test_market_hours_follow_new_york(spark, text, is_open):
    assert spark.range(1).select(scalar.market_is_open(F.lit(text).cast("timestamp"))).first()[0] is is_open


@pytest.mark.parametrize("sep", [",", ";", "\t"])
def test_custodian_files(spark, tmp_path, sep):
    rows = [["Ticker", "Shares", "Average Cost", "Date Acquired", "Notes"], [" aapl", "10", "$12.50", "1/5/2024", "x"], ["TOTAL", "", "", "", ""], ["Cash & Equivalents", "5", "", "", ""], ["BRK.B", "(3)", "n/a", "various", ""], ["bad ticker!", "1", "", "", ""], ["", "1", "", "", ""]]
    path = tmp_path / "book.csv"
    path.write_text("\n".join(sep.join(r) for r in rows))
    holdings, skipped = holdings_csv.read_holdings(spark, str(path))
    got = {r["ticker"]: r for r in holdings.collect()}
    assert set(got) == {"AAPL", "BRK.B"} and got["AAPL"]["cost_basis"] == 125.0 and got["AAPL"]["purchase_date"] == dt.date(2024, 1, 5)
    assert got["BRK.B"]["quantity"] == -3.0 and got["BRK.B"]["cost_basis"] == 0.0 and got["BRK.B"]["purchase_date"] is None
    assert skipped.count() == 3
    with pytest.raises(ValueError, match="names the security"):
        holdings_csv.parse_holdings(spark.createDataFrame([("1",)], "Shares string"))


def test_custodian_folder_of_different_layouts(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Symbol,Qty,"Value, total"\nAAA,1,7\n')
    (tmp_path / "b.csv").write_text("Weight;Security;Units\n0.5;bbb;2\n")
    holdings, _ = holdings_csv.read_holdings(spark, str(tmp_path))
    assert {(r["ticker"], r["quantity"], r["supplied_weight"]) for r in holdings.collect()} == {("AAA", 1.0, None), ("BBB", 2.0, 0.5)}
    assert holdings_csv.layout_warnings(["Symbol", "Notes"]) == ["no column for quantity, value or weight: every holding counts as zero units", "column 'Notes' is not used"]
    assert holdings_csv.columns_of(["Qty", "Shares", "Ticker"]) == {"quantity": "Qty", "ticker": "Ticker"}


def test_csv_sink_quotes(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c', None), (2, "plain", 1.5)], "id int, label string, v double").coalesce(1)
    sinks.write_csv(df, str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*.csv")).read_bytes().decode()
    assert text == 'id,label,v\r\n1,"a ""b"", c",\r\n2,plain,1.5\r\n'
    assert sorted(r["line"] for r in sinks.csv_lines(df).collect()) == ['1,"a ""b"", c",', "2,plain,1.5"]


def test_bars_round_trip_and_upsert(spark, tmp_path):
    old = spark.createDataFrame([("A", dt.date(2024, 1, 2), 1.0, 1.0, 1.0, 1.0, 5.0, "x", dt.datetime(2024, 1, 3))], "symbol string, date date, open double, high double, low double, close double, volume double, source string, updated_at timestamp")
    new = spark.createDataFrame([("a", dt.date(2024, 1, 2), None, 3.0, None, 2.0, None, "y", dt.datetime(2024, 1, 4)), ("a", dt.date(2025, 1, 2), None, None, None, 9.0, 1.0, "y", dt.datetime(2025, 1, 3))], old.schema)
    merged = market.upsert_bars(old, new)
    market.write_bars(merged, str(tmp_path / "bars"))
    back = {r["date"]: r for r in market.read_prices(spark, str(tmp_path / "bars")).collect()}
    assert back[dt.date(2024, 1, 2)]["open"] == 2.0 and back[dt.date(2024, 1, 2)]["high"] == 3.0 and back[dt.date(2025, 1, 2)]["low"] == 9.0
    market.write_bars(merged.where("year(date) = 2025"), str(tmp_path / "bars"))
    assert market.read_prices(spark, str(tmp_path / "bars")).count() == 2


def test_null_fails_an_active_bound(spark):
    rows = spark.createDataFrame([("A", "EQUITY", "Tech", None), ("B", "EQUITY", "Tech", 5.0), ("C", "ETF", "Tech", 50.0)], "ticker string, type string, sector string, pe_ratio double")
    assert [r["ticker"] for r in screener.screen(rows, {"max_pe_ratio": 10, "sector_in": ["TECH"]}).collect()] == ["B"]
    assert screener.screen(rows, {}).count() == 3


def test_newest_cached_result_of_a_book(spark):
    want = [(1, "A", 6.0), (1, "B", 4.0), (2, "A", 1.0), (3, "A", 1.0)]
    day = lambda n: dt.date(2024, 1, n)
    have = [
        (1, 10, day(1), "A", 0.6), (1, 10, day(1), "B", 0.4), (1, 11, day(2), "A", 0.61), (1, 11, day(2), "B", 0.39), (1, 12, day(2), "A", 0.6), (1, 12, day(2), "B", 0.4),
        (1, 13, day(3), "A", 0.7), (1, 13, day(3), "B", 0.3), (1, 14, day(4), "A", 0.6), (1, 15, day(5), "A", 0.6), (1, 15, day(5), "B", 0.4), (1, 15, day(5), "C", 0.0),
        (3, 30, day(1), "B", 1.0), (9, 90, day(1), "A", 1.0),
    ]
    got = screener.newest_cached_result(
        spark.createDataFrame(want, "portfolio_id int, symbol string, weight double"),
        spark.createDataFrame(have, "portfolio_id int, cache_id int, created_at date, symbol string, weight double"),
    )
    assert [tuple(r) for r in got.collect()] == [(1, 12, day(2))]  # newest that fits; of two on one day the larger id


def test_cached_match_misses_nothing(spark):
    rng = np.random.default_rng(3)
    def books(n, key):
        out = []
        for i in range(n):
            w = rng.dirichlet([8, 8, 8, 8])
            out += [(i, s, float(x)) for s, x in zip("ABCD"[: 4 if i % 5 else 2], w if i % 5 else w[:2] / w[:2].sum())]
        return out
    req, have = books(60, "portfolio_id"), books(60, "cache_id")
    got = screener.matching_cached_results(spark.createDataFrame(req, "portfolio_id int, symbol string, weight double"), spark.createDataFrame(have, "cache_id int, symbol string, weight double"), 0.05)
    def as_map(rows):
        m: dict[int, dict[str, float]] = {}
        for k, s, w in rows:
            m.setdefault(k, {})[s] = w
        return m
    a, b = as_map(req), as_map(have)
    want = {(i, j) for i, x in a.items() for j, y in b.items() if set(x) == set(y) and all(abs(x[s] - y[s]) <= 0.05 for s in x)}
    assert {(r[0], r[1]) for r in got.collect()} == want and want


# ---- alerts ---------------------------------------------------------------------------
def _cooldown_loop(rows):
    kept, last = {}, {}
    for alert, event, ts, gap in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        prior = last.get(alert)
        ok = gap <= 0 or prior is None or (ts - prior).total_seconds() > gap
        kept[(alert, event)] = ok
        if ok:
            last[alert] = ts
    return kept


@pytest.mark.parametrize("block, fan", [(1, 2), (7, 3), (256, 64)])
def test_cooldown_matches_a_loop_with_a_hot_rule(spark, block, fan):
    rng = np.random.default_rng(block)
    base, rows, event = dt.datetime(2024, 1, 1), [], 0
    for alert, n, gap in [(1, 3000, 900), (2, 40, 900), (3, 200, 0), (4, 300, 7), (5, 1, 900), (6, 500, 3600)]:
        for s in np.sort(rng.integers(0, 40_000, n)):
            rows.append((alert, event, base + dt.timedelta(seconds=int(s)), gap))
            event += 1
    df = spark.createDataFrame(rows, "alert_id long, event_id long, ts timestamp, cooldown_seconds int")
    got = {(r["alert_id"], r["event_id"]): r["kept"] for r in cooldown(df, block=block, fan=fan).collect()}
    assert got == _cooldown_loop(rows)


def test_cooldown_goes_on_after_an_earlier_run(spark):
    """Two runs, the second with what the first one kept last, decide as one run does."""
    rng = np.random.default_rng(5)
    base = dt.datetime(2024, 1, 1)
    rows = [(a, 1000 * a + i, base + dt.timedelta(seconds=int(s)), 900) for a in range(1, 5) for i, s in enumerate(np.sort(rng.integers(0, 30_000, 150)))]
    rows.append((9, 9000, base + dt.timedelta(seconds=29_000), 900))  # a rule the first run does not know
    df = spark.createDataFrame(rows, "alert_id long, event_id long, ts timestamp, cooldown_seconds int")
    cut = F.lit(base + dt.timedelta(seconds=15_000)).cast("timestamp")
    first = cooldown(df.where(F.col("ts") < cut), block=16)
    second = cooldown(df.where(F.col("ts") >= cut), last_kept(first), block=16)
    got = {(r["alert_id"], r["event_id"]): r["kept"] for r in first.unionByName(second).collect()}
    assert got == _cooldown_loop(rows)
    assert cooldown(df.limit(0)).count() == 0


def test_cooldown_boundary_is_suppressed(spark):
    t0 = dt.datetime(2024, 1, 1, 23, 50)
    rows = [(1, i, t0 + dt.timedelta(seconds=s), 900) for i, s in enumerate([0, 900, 901, 1801, 1802])]
    df = spark.createDataFrame(rows, "alert_id long, event_id long, ts timestamp, cooldown_seconds int")
    assert [r["kept"] for r in cooldown(df).orderBy("event_id").collect()] == [True, False, True, False, True]


def test_edges_fire_once_and_rearm(spark):
    flags = [False, True, True, False, True]
    rows = [(1, dt.datetime(2024, 1, 1, i), f) for i, f in enumerate(flags)]
    df = spark.createDataFrame(rows, "alert_id long, evaluated_at timestamp, triggered boolean")
    assert [(r["evaluated_at"].hour, r["edge"]) for r in alerts.edge_events(df).orderBy("evaluated_at").collect()] == [(1, "rising"), (3, "falling"), (4, "rising")]


def test_stored_events_are_not_fired_again(spark):
    flags = [(1, True), (1, False), (2, True), (3, False), (3, True)]
    rows = [(a, dt.datetime(2024, 1, 1, i), f) for i, (a, f) in enumerate(flags)]
    df = spark.createDataFrame(rows, "alert_id long, evaluated_at timestamp, triggered boolean")
    prior = spark.createDataFrame([(1, True), (3, True), (7, True)], "alert_id long, last_triggered boolean")
    got = sorted((r["alert_id"], r["evaluated_at"].hour, r["edge"]) for r in alerts.edge_events(df, prior).collect())
    assert got == [(1, 1, "falling"), (2, 2, "rising"), (3, 3, "falling"), (3, 4, "rising")]


def test_edge_stream_with_stored_events_and_restarts(spark):
    rng = np.random.default_rng(3)
    schema = "alert_id long, evaluated_at timestamp, triggered boolean, stored boolean"
    stored = spark.createDataFrame([(a, dt.datetime(2025, 1, 1), a % 2 == 0, True) for a in range(5)], schema)
    parts = [[(a, dt.datetime(2024, 1, 1) + dt.timedelta(hours=part * 20 + i), bool(rng.random() > 0.5), False) for a in range(6) for i in range(20)] for part in range(3)]
    landed = jobs.drain_landings([stored, *(spark.createDataFrame(p, schema) for p in parts)], jobs.edge_stream, schema)
    prior = stored.select("alert_id", F.col("triggered").alias("last_triggered"))
    batch = alerts.edge_events(spark.createDataFrame([r for p in parts for r in p], schema).drop("stored"), prior)
    key = lambda df: sorted((r["alert_id"], r["evaluated_at"], r["edge"]) for r in df.collect())
    assert key(landed) == key(batch)
    assert key(batch) != key(alerts.edge_events(spark.createDataFrame([r for p in parts for r in p], schema).drop("stored")))


def test_edge_stream_equals_batch_over_several_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    for part in range(3):
        rows = [(a, dt.datetime(2024, 1, 1) + dt.timedelta(hours=part * 20 + i), bool(rng.random() > 0.5)) for a in range(4) for i in range(20)]
        spark.createDataFrame(rows, "alert_id long, evaluated_at timestamp, triggered boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = alerts.edge_events(spark.read.parquet(str(tmp_path / "in")))
    stream = spark.readStream.schema("alert_id long, evaluated_at timestamp, triggered boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    key = lambda df: sorted((r["alert_id"], r["evaluated_at"], r["edge"]) for r in df.collect())
    assert key(jobs.drain(jobs.edge_stream(stream))) == key(batch)


@pytest.mark.parametrize("hour, start, end, offset, quiet", [(23, 22, 7, 0, True), (6, 22, 7, 0, True), (7, 22, 7, 0, False), (12, 9, 17, 0, True), (17, 9, 17, 0, False), (5, 5, 5, 0, False), (3, 22, 7, 300, False)])
def test_quiet_hours(spark, hour, start, end, offset, quiet):
    ts = F.lit(f"2024-01-01 {hour:02d}:30:00").cast("timestamp")
    assert spark.range(1).select(alerts.in_quiet_hours(ts, F.lit(start), F.lit(end), F.lit(offset))).first()[0] is quiet


def test_auto_mute_needs_an_unbroken_streak(spark):
    t = lambda i: dt.datetime(2024, 1, 1, i)
    fb = [(1, 1, "not_useful", "A", "cusum", t(1)), (2, 1, "not_useful", "A", "cusum", t(2)), (3, 2, "not_useful", "A", "cusum", t(1)), (4, 2, "useful", "A", "cusum", t(2)), (5, 3, "not_useful", "A", "cusum", t(1)), (6, 4, "not_useful", "A", "burst", t(1))]
    df = spark.createDataFrame(fb, "event_id long, user_id long, rating string, ticker string, kind string, created_at timestamp")
    prefs = spark.createDataFrame([(1, 2, ["BURST"]), (2, 2, []), (3, 2, []), (4, 0, [])], "user_id long, auto_mute_after int, muted_kinds array<string>")
    muted = alerts.auto_muted_kinds(df, prefs)
    assert [tuple(r) for r in muted.collect()] == [(1, "cusum")]
    assert {r["user_id"]: r["muted_kinds"] for r in alerts.updated_mutes(prefs, muted).collect()}[1] == ["BURST", "cusum"]


def test_unknown_severity_passes_the_floor(spark):
    a = spark.createDataFrame([(1, "A", "cusum", s, dt.datetime(2024, 1, 1, 12)) for s in ("INFO", "warning", "weird", None)], "user_id long, ticker string, kind string, severity string, ts timestamp")
    prefs = spark.createDataFrame([(1, True, "WARNING", 0, 0, 0, ["b"], [])], "user_id long, email_enabled boolean, min_severity string, quiet_start int, quiet_end int, tz_offset_min int, muted_tickers array<string>, muted_kinds array<string>")
    assert [r["notify"] for r in alerts.notification_decisions(a, prefs).collect()] == [False, True, True, True]


# ---- telemetry --------------------------------------------------------------------------
def _messages(spark, rows):
    return spark.createDataFrame([(i, t, p, dt.datetime(2024, 1, 1, 0, i)) for i, (t, p) in enumerate(rows)], "event_id long, topic string, payload string, arrived_at timestamp")


def test_topics_and_dead_letters(spark):
    rows = [("thing/product/SN1/osd", "{}"), ("thing/product/SN1/property/set_reply", "{}"), ("thing/product/SN1/unknown", "{}"), ("other/product/SN1/osd", "{}"), ("thing/product/SN1", "{}"), ("thing/product/SN1/state", "{oops")]
    parsed = tel.with_document(tel.parse_topics(_messages(spark, rows)))
    assert [r["topic_type"] for r in parsed.orderBy("event_id").collect()] == ["osd", "property/set_reply", None, None, None, "state"]
    assert [(r["event_id"], r["error"]) for r in tel.dead_letters(parsed).orderBy("event_id").collect()] == [(2, "unknown topic"), (3, "unknown topic"), (4, "unknown topic"), (5, "invalid JSON")]


def test_osd_fallbacks_and_defaults(spark):
    osd = "thing/product/D/osd"
    rows = [(osd, '{"data":{"sub_devices":[{"data":{"latitude":1.5,"height":9,"battery":{"capacity_percent":80}}}]}}'), (osd, '{"data":{"altitude":3,"speed":2,"flight_mode":"hover"}}'), (osd, '{"latitude":4}'), (osd, "{}"), (osd, '{"data":{"sub_devices":[],"heading":7}}')]
    got = tel.decode_osd(tel.decodable(tel.with_document(tel.parse_topics(_messages(spark, rows))))).orderBy("event_id").collect()
    assert (got[0]["latitude"], got[0]["altitude"], got[0]["battery_percent"]) == (1.5, 9.0, 80.0)
    assert (got[1]["altitude"], got[1]["speed"], got[1]["flight_mode"]) == (3.0, 2.0, "hover")
    assert got[2]["latitude"] == 4.0 and got[3]["battery_percent"] == 0.0 and got[3]["flight_mode"] == "unknown" and got[4]["heading"] == 7.0


def test_blank_firmware_keeps_the_old_one(spark):
    rows = [("thing/product/K/state", '{"data":{"online":true,"firmware_version":"v1"}}'), ("thing/product/K/state", '{"data":{"online":false,"firmware_version":""}}')]
    latest = tel.latest_device_state(tel.decode_state(tel.decodable(tel.with_document(tel.parse_topics(_messages(spark, rows)))))).first()
    assert latest["firmware_version"] == "v1" and latest["online"] is False


def test_stream_retention_keeps_the_newest(spark):
    log = spark.range(100).select(F.lit("s").alias("stream"), F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("arrived_at"))
    assert sorted(r["event_id"] for r in sinks.trim_streams(log, cap=3).collect()) == [97, 98, 99]


def test_news_limit_and_freshness(spark):
    items = "[" + ",".join(f'{{"title":"t{i}"}}' for i in range(8)) + "]"
    news = market.normalise_news(spark.createDataFrame([("A", items)], "symbol string, items string"))
    assert news.count() == 5 and news.first()["publisher"] == "Unknown"
    snaps = spark.createDataFrame([("A", dt.datetime(2024, 1, 1), 1.0), ("A", dt.datetime(2024, 1, 2), None), ("B", dt.datetime(2023, 1, 1), 2.0)], "symbol string, as_of timestamp, v double")
    got = {r["symbol"]: (r["freshness"], r["v"]) for r in market.latest_within(snaps, F.lit("2024-01-02 12:00:00").cast("timestamp")).collect()}
    assert got["A"][0] == "fresh" and got["B"] == ("stale", 2.0)




# ---- saved screens ----------------------------------------------------------------------
def _screen_universe(spark, n=400):
    rng = np.random.default_rng(11)
    some = lambda x: None if rng.random() < 0.1 else float(x)
    rows = [(f"T{i}", str(rng.choice(["EQUITY", "etf", "BOND"])), str(rng.choice(["Tech", "energy", "Unknown"])), some(rng.lognormal(20, 2)), some(rng.integers(0, 40)), some(rng.normal(10, 3)), some(rng.normal(0, 0.1)), some(rng.normal(1, 0.5))) for i in range(n)]
    rows += [("TN", None, None, None, None, None, None, None), ("TE", "EQUITY", "Tech", 1e9, 5.0, 10.0, 0.0, 1.0), ("TE", "EQUITY", "Tech", 1e9, 5.0, 10.0, 0.0, 1.0)]
    return spark.createDataFrame(rows, "ticker string, type string, sector string, market_cap double, pe_ratio double, ev_to_ebitda double, profit_margin double, beta double")


def test_saved_screens_equal_one_screen_at_a_time(spark):
    import json

    rows = _screen_universe(spark)
    filters = [
        {}, {"min_pe_ratio": 10, "max_pe_ratio": 12}, {"max_beta": 0.5, "sector_in": ["TECH"]}, {"type_in": ["Etf", "ETF"]}, {"min_market_cap": 1e9, "max_market_cap": 1e8}, {"min_beta": -50, "max_beta": 50},
        {"min_profit_margin": 0.0}, {"sector_in": ["energy", "ENERGY", "none"], "max_pe_ratio": 3}, {"min_ev_to_ebitda": 10.0, "max_ev_to_ebitda": 10.0}, {"sector_in": [], "type_in": []}, {"max_pe_ratio": 0},
    ]
    screens = spark.createDataFrame([(i, json.dumps(f)) for i, f in enumerate(filters)], "screen_id long, filters string")
    got = sorted(map(tuple, screener.apply_saved_screens(screens, rows).collect()))
    assert got == sorted((i, r["ticker"]) for i, f in enumerate(filters) for r in screener.screen(rows, f).collect())
    selective = screens.where("screen_id in (1, 2, 7, 8)")
    pairs, hits = screener.saved_screen_candidates(selective, rows).count(), screener.apply_saved_screens(selective, rows).count()
    assert hits <= pairs < 0.5 * 4 * rows.count()


def test_screen_counts_all_hits_and_returns_the_first(spark):
    rows = _screen_universe(spark)
    want = sorted(r["ticker"] for r in screener.screen(rows, {"min_pe_ratio": 10}).collect())
    got = screener.run_screen(rows, {"min_pe_ratio": 10}, limit=7).collect()
    assert sorted(r["ticker"] for r in got) == want[:7] and {r["hits"] for r in got} == {len(want)}
    assert len(screener.run_screen(rows, {}, limit=0).collect()) == 1
    assert screener.run_screen(rows, {"min_pe_ratio": 1e9}).count() == 0
