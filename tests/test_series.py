from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from risklake.operators import align, indicators, metrics, returns
from tests.helpers import business_days, random_prices, series_frame


def test_gap_year_months_are_null_and_the_run_stops(spark):
    jan = [dt.date(2025, 1, d) for d in range(1, 32)]
    mar = [dt.date(2025, 3, d) for d in range(1, 32)]
    days = jan + [dt.date(2025, 2, 10)] + mar
    prices = series_frame(spark, {"A": (days, list(np.linspace(100, 110, len(days))))})
    rows = {r["month"]: r for r in returns.coverage_run(returns.monthly_spine(prices)).collect()}
    assert len(rows) == 12 and rows[2]["ret"] is None and rows[3]["ret"] is not None
    assert [m for m, r in rows.items() if r["in_run"]] == [1] and rows[3]["cum_pct"] is None
    vol = {r["month"].month: r["vol_pct"] for r in metrics.monthly_vol(prices).collect()}
    assert vol[2] is None and vol[1] is not None


def test_event_window_edges(spark):
    days = business_days("2026-01-05", 60)
    port = series_frame(spark, {k: (days, [100.0 + i for i in range(60)]) for k in ("mid", "weekend", "late", "first")}, key="portfolio_id")
    saturday = days[19] + dt.timedelta(days=1)
    assert saturday.weekday() == 5
    ev = spark.createDataFrame([("mid", days[30]), ("weekend", saturday), ("late", dt.date(2030, 1, 1)), ("first", days[0])], "portfolio_id string, event_date date")
    out = align.event_window(port, ev).toPandas()
    mid = out[out.portfolio_id == "mid"].sort_values("day_no")
    assert len(mid) == 31 and mid.event_return.iloc[0] == pytest.approx(145 / 129 - 1)
    weekend = out[out.portfolio_id == "weekend"].sort_values("day_no")
    assert weekend.event_return.iloc[0] == pytest.approx((100 + 20 + 15) / (100 + 19) - 1)  # anchor Friday, position Monday
    assert out[out.portfolio_id == "late"].status.tolist() == ["rejected"]
    first = out[out.portfolio_id == "first"]
    assert len(first) == 16 and first.event_return.iloc[0] == pytest.approx(0.15)


def test_benchmark_is_filled_only_when_well_covered(spark):
    days = [dt.date(2026, 1, d) for d in range(1, 32)]
    dates = spark.createDataFrame([(k, d) for k in ("p",) for d in days], "portfolio_id string, date date")
    gaps = series_frame(spark, {"B": ([d for d in days if d.day not in (10, 20)], [100.0 + d.day for d in days if d.day not in (10, 20)])})
    rows = {r["date"].day: r["benchmark"] for r in align.align_benchmark(dates, gaps, "portfolio_id").collect()}
    assert rows[1] == 100.0 and rows[10] == rows[9]
    sparse = gaps.where("day(date) not in (3, 4, 5, 6)")
    assert all(r["benchmark"] is None for r in align.align_benchmark(dates, sparse, "portfolio_id").collect())
    no_end = gaps.where("day(date) <> 31")
    assert all(r["benchmark"] is None for r in align.align_benchmark(dates, no_end, "portfolio_id").collect())


def test_as_of_is_strict_on_request(spark):
    facts = series_frame(spark, {"A": ([dt.date(2026, 1, 1), dt.date(2026, 1, 5)], [10.0, 20.0])})
    probes = spark.createDataFrame([("A", dt.date(2025, 12, 31)), ("A", dt.date(2026, 1, 3)), ("A", dt.date(2026, 1, 5))], "symbol string, date date")
    loose = [r["price"] for r in align.as_of(probes, facts, "symbol", "price").orderBy("date").collect()]
    strict = [r["price"] for r in align.as_of(probes, facts, "symbol", "price", strict=True).orderBy("date").collect()]
    assert loose == [None, 10.0, 20.0] and strict == [None, 10.0, 10.0]


def test_drift_waits_for_the_purchase(spark):
    days = business_days("2026-01-05", 4)
    prices = series_frame(spark, {"A": (days, [10, 11, 12, 13]), "B": (days, [100, 50, 25, 25])})
    pos = spark.createDataFrame([(1, "A", 0.5, 2.0, None), (1, "B", 0.5, 1.0, days[2])], "portfolio_id int, symbol string, weight double, quantity double, purchase_date date")
    got = [r["ret"] for r in returns.portfolio_returns_drift(pos, prices).orderBy("date").collect()]
    assert got == pytest.approx([0.0, 0.1, 12 / 11 - 1, (26 + 25) / (24 + 25) - 1])


def test_clean_prices_keeps_the_newest_valid_version(spark):
    raw = spark.createDataFrame([("A", "2026-01-01", "10", 1), ("A", "2026-01-01", "11", 2), ("A", "2026-01-02", "-3", 1), ("A", "2026-01-03", "bad", 1)], "symbol string, date string, price string, updated_at int")
    assert [(r["date"], r["price"]) for r in align.clean_prices(raw).collect()] == [("2026-01-01", 11.0)]


def test_indicators_against_pandas(spark):
    p = random_prices(400, 3)
    prices = series_frame(spark, {"A": (business_days("2024-01-01", 400), p)})
    s = pd.Series(p)
    delta = s.diff()
    gain, loss = delta.where(delta > 0, 0).rolling(14).mean(), (-delta.where(delta < 0, 0)).rolling(14).mean()
    want = (100 - 100 / (1 + gain / loss)).fillna(50)
    got = [r["rsi"] for r in indicators.rsi_simple(prices).orderBy("date").collect()]
    assert np.allclose(got, want)
    macd = indicators.macd(prices).orderBy("date").toPandas()
    line = s.ewm(span=12, adjust=False).mean() - s.ewm(span=26, adjust=False).mean()
    assert np.allclose(macd["macd"], line) and np.allclose(macd["signal"], line.ewm(span=9, adjust=False).mean())
    wilder = [r["rsi"] for r in indicators.rsi_wilder(prices).orderBy("date").collect()]
    assert wilder[14] is None and wilder[15] is not None and all(0 <= v <= 100 for v in wilder[15:])


def test_risk_contributions_equal_the_matrix_form(spark):
    days = business_days("2023-01-02", 300)
    w = {"A": 0.5, "B": 0.3, "C": 0.2}
    data = {k: (days, random_prices(300, i, sd=0.01 + 0.005 * i)) for i, k in enumerate(w)}
    pos = spark.createDataFrame([(1, k, v) for k, v in w.items()], "portfolio_id int, symbol string, weight double")
    common = metrics.common_returns(pos, series_frame(spark, data))
    got = {r["symbol"]: r for r in metrics.risk_contributions(common).collect()}
    R = pd.DataFrame({k: v[1] for k, v in data.items()}).pct_change().dropna()
    cov, wv = R.cov().to_numpy() * 252, np.array(list(w.values()))
    vol = np.sqrt(wv @ cov @ wv)
    assert [got[k]["risk_contribution"] for k in w] == pytest.approx(list(wv * (cov @ wv) / vol))
    assert sum(r["risk_pct"] for r in got.values()) == pytest.approx(1.0)
    long = {(r["symbol_i"], r["symbol_j"]): r["cov"] for r in metrics.covariance_matrix(common).collect()}
    assert long[("A", "C")] == pytest.approx(cov[0, 2]) and long[("B", "B")] == pytest.approx(cov[1, 1])
    spec = metrics.spectral_diversification(metrics.covariance_matrix(common, annualise=1.0)).first()
    eig = np.linalg.eigvalsh(R.corr().to_numpy()) / 3
    assert spec["dominant"] == pytest.approx(eig.max()) and spec["entropy"] == pytest.approx(-(eig * np.log(eig)).sum())
    assert spec["diversification_ratio"] <= 1.0


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)], "x double")
    rows = metrics.histogram(df, "x", 5).orderBy("bin").collect()
    assert [r["n"] for r in rows] == [2, 2, 2, 2, 3]


def test_forward_fill_uses_the_union_of_dates(spark):
    days = business_days("2026-01-05", 3)
    prices = series_frame(spark, {"A": (days, [1.0, 2.0, 3.0]), "B": ([days[0], days[2]], [10.0, 30.0])})
    pos = spark.createDataFrame([(1, "A", 0.5), (1, "B", 0.5)], "portfolio_id int, symbol string, weight double")
    filled = {(r["symbol"], r["date"]): r["price"] for r in align.align_forward_fill(pos, prices).collect()}
    assert filled[("B", days[1])] == 10.0 and len(filled) == 6
    kept = align.align_intersection(pos, prices).agg(F.count_distinct("date")).first()[0]
    assert kept == 2
