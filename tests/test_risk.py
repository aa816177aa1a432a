from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from risklake.operators import allocation, correlation, evaluate, regimes, simulate, var_backtest
from tests.helpers import business_days, pattern_prices, random_prices, series_frame


def _scored(spark, breaches: list[bool]):
    days = business_days("2020-01-01", len(breaches))
    return spark.createDataFrame([(1, "m", d, -0.05 if b else 0.01, -0.02) for d, b in zip(days, breaches)], "portfolio_id int, method string, date date, realized double, var double")


@pytest.mark.parametrize("n, x, stat", [(1000, 100, 41.31), (250, 0, 25.65), (1000, 50, 0.0), (100, 100, 599.15)])
def test_kupiec_known_answers(spark, n, x, stat):
    row = var_backtest.coverage_tests(_scored(spark, [i < x for i in range(n)])).first()
    assert row["kupiec_stat"] == pytest.approx(stat, abs=0.01)
    assert row["kupiec_reject"] == (stat > 3.84)


def test_christoffersen_counts_and_clustering(spark):
    rows = var_backtest.coverage_tests(_scored(spark, [False, True, True, False, False, True])).first()
    assert (rows["n00"], rows["n01"], rows["n10"], rows["n11"]) == (1, 2, 1, 1)
    clustered = var_backtest.coverage_tests(_scored(spark, [i < 25 for i in range(500)])).first()
    spread = var_backtest.coverage_tests(_scored(spark, [i % 20 == 0 for i in range(500)])).first()
    assert clustered["independence_stat"] > 50 and clustered["coverage_reject"] and not spread["kupiec_reject"]
    none = var_backtest.coverage_tests(_scored(spark, [False] * 100)).first()
    assert none["expected_shortfall"] is None


def test_replay_never_looks_ahead(spark):
    rng = np.random.default_rng(0)
    r = rng.normal(0, 0.01, 600)
    days = business_days("2021-01-01", 600)
    def frame(values):
        return spark.createDataFrame([(1, d, float(v)) for d, v in zip(days, values)], "portfolio_id int, date date, ret double")
    base = var_backtest.closed_form_var(var_backtest.replay_window(frame(r))).toPandas()
    bent = r.copy()
    bent[-1] = -0.9
    other = var_backtest.closed_form_var(var_backtest.replay_window(frame(bent))).toPandas()
    m = base.merge(other, on=["date", "method"])
    assert np.allclose(m["var_x"], m["var_y"]) and len(base) == 500
    hist = base[base.method == "historical"]
    assert 0.02 <= (hist["realized"] < hist["var"]).mean() <= 0.09
    i = 400
    want = np.percentile(r[i - 252 : i], 5)
    assert hist[hist.date == days[i]]["var"].iloc[0] == pytest.approx(want)
    boot = var_backtest.bootstrap_var(var_backtest.replay_window(frame(r)), n_sims=200).toPandas()
    again = var_backtest.bootstrap_var(var_backtest.replay_window(frame(r)).repartition(7), n_sims=200).toPandas()
    assert boot.sort_values("date")["var"].tolist() == again.sort_values("date")["var"].tolist()


def _pair(spark, a, b, n):
    days = business_days("2020-01-01", n)
    prices = series_frame(spark, {"A": (days, a), "B": (days, b)})
    return correlation.pair_returns(prices, correlation.pairs_frame(spark, [("A", "B", "a vs b")]))


def test_correlation_extremes(spark):
    n = 120
    same = correlation.headline_correlation(_pair(spark, pattern_prices(n), pattern_prices(n, start=50), n)).collect()
    assert {r["window"] for r in same} == {30, 60, 90} and all(r["pearson"] == pytest.approx(1.0) for r in same)
    flip = correlation.headline_correlation(_pair(spark, pattern_prices(n), pattern_prices(n, sign=-1), n)).collect()
    assert all(r["pearson"] == pytest.approx(-1.0) for r in flip)
    assert correlation.headline_correlation(_pair(spark, pattern_prices(15), pattern_prices(15), 15)).count() == 0
    line = correlation.rolling_correlation(_pair(spark, pattern_prices(400), pattern_prices(400), 400)).toPandas()
    assert line.groupby("window").size().max() <= 252 and line["corr"].between(-1 - 1e-9, 1 + 1e-9).all()


def test_replay_episodes(spark):
    n = 20 * 252
    legs = _pair(spark, pattern_prices(n, scale=0.008), pattern_prices(n, scale=0.004), n)
    ep = correlation.episode_statistics(legs, [("one", "2021-01-01", "2021-12-31"), ("two", "2025-03-01", "2025-06-30"), ("tiny", "2026-01-01", "2026-01-05")]).toPandas()
    assert set(ep.episode) == {"one", "two"} and (ep.drawdown_pct <= 0).all()
    assert correlation.historical_replay(legs).where("dd_pct > 0").count() == 0


def test_portfolio_regime_statuses(spark):
    days = business_days("2020-01-01", 300)
    prices = series_frame(spark, {"SPY": (days, pattern_prices(300)), "AGG": (days, pattern_prices(300, sign=-1)), "NEW": (days[:20], pattern_prices(20))})
    h = spark.createDataFrame([(1, "SPY", 0.6, "equity"), (1, "AGG", 0.4, "bond"), (2, "SPY", 1.0, "equity"), (3, "SPY", 0.5, "equity"), (3, "NEW", 0.5, "bond")], "portfolio_id int, symbol string, weight double, sleeve string")
    got = {r["portfolio_id"]: r for r in correlation.portfolio_regime_watch(h, prices).collect()}
    assert got[1]["status"] == "ok" and got[1]["n_obs"] == 60 and got[1]["short_corr"] == pytest.approx(-1.0)
    assert got[2]["reason"] == "needs both sleeves" and got[3]["reason"] == "insufficient history"


def test_sleeve_and_class_precedence(spark):
    rows = spark.createDataFrame([("tlt", "US_EQUITY"), ("BTC-USD", "ETF"), ("X", "BOND_ETF"), ("X", None)], "t string, c string")
    assert [r[0] for r in rows.select(correlation.sleeve_of(F.col("t"), F.col("c"))).collect()] == ["bond", "crypto", "bond", "other"]
    cls = spark.createDataFrame([("SPY", "", ""), ("XLK", "ETF", ""), ("EWJX", "ETF", ""), ("VOD.L", "EQUITY", ""), ("AAPL", None, "Tech"), ("ETHUSDT", None, None)], "t string, k string, s string")
    assert [r[0] for r in cls.select(regimes.regime_class(F.col("t"), F.col("k"), F.col("s"))).collect()] == ["etf_broad", "etf_sector", "etf_broad", "equity_intl", "equity_us", "crypto"]


def test_allocation_invariants_and_walk_forward_against_a_loop(spark):
    n, names = 600, ["A", "B", "C"]
    days = business_days("2020-01-01", n)
    data = {k: (days, random_prices(n, i, sd=0.01 + 0.004 * i)) for i, k in enumerate(names)}
    pos = spark.createDataFrame([(1, k, 1 / 3) for k in names], "portfolio_id int, symbol string, weight double")
    prices = series_frame(spark, data)
    rows = allocation.numbered_prices(pos, prices)
    weights = allocation.method_weights(allocation.trailing_panel(rows)).cache()
    w = weights.toPandas()
    assert np.allclose(w.groupby(["method", "k"])["weight"].sum(), 1.0) and (w["weight"] >= 0).all()
    profile = allocation.strategy_profile(allocation.walk_forward(rows, weights)).toPandas().set_index("method")
    assert (profile["max_drawdown"] <= 0).all() and (profile["cdar95"] <= 0).all() and (profile["cdar95"] >= profile["max_drawdown"]).all()
    # day-by-day simulation of the inverse-volatility book
    P = np.array([data[k][1] for k in names]).T
    R = P[1:] / P[:-1] - 1
    held, out = np.zeros(3), []
    for t in range(252, len(R)):
        if (t - 252) % 21 == 0:
            inv = 1 / R[t - 252 : t].std(axis=0)
            target = inv / inv.sum()
            out.append(float(target @ R[t]) - 0.5 * np.abs(target - held).sum() * 0.001)
            held = target
        else:
            out.append(float(held @ R[t]))
            held = held * (1 + R[t]) / (held * (1 + R[t])).sum()
    got = allocation.walk_forward(rows, weights).where("method = 'inverse_vol'").orderBy("i").toPandas()
    assert np.allclose(got["ret"], out)
    rp = w[(w.method == "risk_parity") & (w.k == -1)].sort_values("symbol")["weight"].to_numpy()
    cov = np.cov(R[-252:], rowvar=False)
    contrib = rp * (cov @ rp)
    assert np.allclose(contrib, contrib.mean(), rtol=1e-6)
    short = series_frame(spark, {k: (v[0][:200], v[1][:200]) for k, v in data.items()})
    assert allocation.numbered_prices(pos, short).count() == 0


def test_rounded_weights_sum_to_one(spark):
    df = spark.createDataFrame([(1, k, 1 / 3) for k in "abc"], "portfolio_id int, symbol string, weight double")
    assert [r["rounded"] for r in allocation.rounded_weights(df, ["portfolio_id"]).orderBy("symbol").collect()] == [0.3334, 0.3333, 0.3333]


def test_worst_case_equals_the_full_grid(spark):
    rng = np.random.default_rng(5)
    names, n = ["A", "B", "C", "D"], 300
    R = rng.normal(0.0005, 0.02, (n, 4))
    days = business_days("2021-01-01", n)
    wts = [0.4, 0.3, 0.2, 0.1]
    rows = simulate.standardised_rows(spark.createDataFrame([(1, k, d, w, float(R[i, j])) for j, (k, w) in enumerate(zip(names, wts)) for i, d in enumerate(days)], "portfolio_id int, symbol string, date date, weight double, ret double"))
    paths = simulate.portfolio_shock_paths(rows, 300, 20)
    got = simulate.worst_case_shock(rows, paths).toPandas()
    ends = paths.where("step = 20").toPandas()
    growth = np.exp(20 * ends["drift"] + ends["cum_shock"]).to_numpy()
    sd, w = R.std(axis=0, ddof=1), np.array(wts)
    cut = max(1, math.floor(0.05 * len(growth)))
    def cvar(levels):
        base = 1 + float(w @ (np.exp(np.array(levels) * sd) - 1))
        return float(np.sort(base * growth - 1)[:cut].mean())
    best = min(cvar(c) for c in itertools.product([-3.0, 0.0, 3.0], repeat=4))
    assert got["cvar"].iloc[0] == pytest.approx(best) and (got["level"] == -3.0).all()


def test_best_subset_against_enumeration(spark):
    rng = np.random.default_rng(2)
    names = list("abcdefg")
    mu = rng.normal(0.1, 0.1, 7)
    A = rng.normal(0, 0.2, (7, 7))
    S = A @ A.T
    moments = spark.createDataFrame([(1, k, float(m)) for k, m in zip(names, mu)], "portfolio_id int, symbol string, mu double")
    cov = spark.createDataFrame([(1, names[i], names[j], float(S[i, j])) for i in range(7) for j in range(i, 7)], "portfolio_id int, symbol_i string, symbol_j string, cov double")
    got = allocation.best_subset(moments, cov, 3).first()
    def value(c):
        x = np.zeros(7)
        x[list(c)] = 1
        return -mu @ x + 0.5 * x @ S @ x
    best = min(itertools.combinations(range(7), 3), key=value)
    assert got["selection"] == ",".join(names[i] for i in best) and got["objective"] == pytest.approx(value(best))


def _subset_tables(spark, book, mu, S):
    n = len(mu)
    moments = spark.createDataFrame([(book, f"s{i:02d}", float(mu[i])) for i in range(n)], "portfolio_id int, symbol string, mu double")
    cov = spark.createDataFrame([(book, f"s{i:02d}", f"s{j:02d}", float(S[i, j])) for i in range(n) for j in range(i, n)], "portfolio_id int, symbol_i string, symbol_j string, cov double")
    return moments, cov


@pytest.mark.parametrize("size", [1, 2, 5])
def test_best_subset_of_negative_covariances_ties_and_short_books(spark, size):
    rng = np.random.default_rng(size)
    A = rng.normal(0, 0.4, (9, 5))  # of rank 5, with many negative covariances
    S, mu = A @ A.T, np.round(rng.normal(0.1, 0.1, 9), 1)
    S[3], S[:, 3] = S[4].copy(), S[:, 4].copy()
    mu[3] = mu[4]  # an asset listed twice: equal selections, the first by name wins
    (m1, c1), (m2, c2) = _subset_tables(spark, 1, mu, S), _subset_tables(spark, 2, mu[: size - 1], S[: size - 1, : size - 1])
    got = {r["portfolio_id"]: r for r in allocation.best_subset(m1.union(m2), c1.union(c2), size).collect()}
    cost = lambda c: -mu[list(c)].sum() + 0.5 * S[np.ix_(c, c)].sum()
    best = min(itertools.combinations(range(9), size), key=lambda c: (round(cost(c), 9), c))
    assert got[1]["selection"] == ",".join(f"s{i:02d}" for i in best) and got[1]["objective"] == pytest.approx(cost(best))
    assert size == 1 or (got[2]["status"] == allocation.TOO_FEW and got[2]["selection"] is None)


def test_best_subset_of_many_assets_is_pruned(spark):
    rng = np.random.default_rng(5)
    A = rng.normal(0.02, 0.05, (250, 60)) + rng.normal(0, 0.08, (250, 1))
    S, mu = np.cov(A.T) * 25, rng.normal(0.1, 0.1, 60)
    got = allocation.best_subset(*_subset_tables(spark, 1, mu, S), 6).first()  # 50 million selections
    pick = [int(x[1:]) for x in got["selection"].split(",")]
    cost = lambda c: -mu[list(c)].sum() + 0.5 * S[np.ix_(c, c)].sum()
    assert got["objective"] == pytest.approx(cost(pick))
    swaps = [[*pick[:k], j, *pick[k + 1 :]] for k in range(6) for j in range(60) if j not in pick]
    assert min(map(cost, swaps)) >= cost(pick)


def test_walk_forward_splits(spark):
    days = business_days("2024-01-01", 160)
    prices = series_frame(spark, {"A": (days, random_prices(160, 1)), "B": (days[:130], random_prices(130, 2))})
    got = [(r["symbol"], r["train_end"], r["test_end"]) for r in evaluate.walk_forward_splits(prices).orderBy("symbol", "fold").collect()]
    assert got == [("A", 130, 145), ("A", 145, 160)]


def test_risk_cone_is_ordered_and_repeatable(spark):
    prices = series_frame(spark, {"A": (business_days("2022-01-03", 300), random_prices(300, 9))})
    a = simulate.risk_cone(prices, horizon=5, n_paths=100).orderBy("step").toPandas()
    b = simulate.risk_cone(prices.repartition(5), horizon=5, n_paths=100).orderBy("step").toPandas()
    pd.testing.assert_frame_equal(a, b)
    assert (a.price_p5 <= a.price_p50).all() and (a.price_p50 <= a.price_p95).all() and (a.sigma_p5 > 0).all()
