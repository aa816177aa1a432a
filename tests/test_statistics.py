from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from risklake.functions.stats import binomial_cdf, chi2_tail, erfc, exact_quantiles, gaussian, sample_excess_kurtosis, sample_skew, uniform, wilson_interval
from risklake.operators.indicators import with_ema
from risklake.session import check_shared


def test_erfc_and_chi_square_tails(spark):
    xs = [0.0, 0.1, 0.5, 1.0, 2.0, 3.0]
    row = spark.range(1).select(*[erfc(F.lit(x)).alias(f"e{i}") for i, x in enumerate(xs)], chi2_tail(F.lit(3.841458820694124), 1).alias("c1"), chi2_tail(F.lit(5.991464547107979), 2).alias("c2")).first()
    for i, x in enumerate(xs):
        assert row[f"e{i}"] == pytest.approx(math.erfc(x), rel=2e-7)
    assert row["c1"] == pytest.approx(0.05, rel=1e-6)
    assert row["c2"] == pytest.approx(0.05, rel=1e-9)


@pytest.mark.parametrize("x, zone", [(0, "green"), (4, "green"), (5, "yellow"), (9, "yellow"), (10, "red")])
def test_basel_table_for_250_days_at_99(spark, x, zone):
    cdf = spark.range(1).select(binomial_cdf(F.lit(x), F.lit(250), 0.01).alias("c")).first()["c"]
    assert cdf == pytest.approx(sum(math.comb(250, k) * 0.01**k * 0.99 ** (250 - k) for k in range(x + 1)), rel=1e-9)
    assert ("green" if cdf < 0.95 else "yellow" if cdf < 0.9999 else "red") == zone


def test_binomial_cdf_survives_large_counts(spark):
    cdf = spark.range(1).select(binomial_cdf(F.lit(5000), F.lit(100_000), 0.05).alias("c")).first()["c"]
    assert 0.49 < cdf < 0.52


def test_exact_quantiles_match_numpy_under_skew_and_ties(spark):
    rng = np.random.default_rng(7)
    hot = np.round(rng.normal(0, 1, 30_000), 2)  # one group with most rows and heavy ties
    cold = rng.exponential(1, 37)
    flat = np.full(500, 3.0)
    pdf = pd.DataFrame({"g": ["hot"] * len(hot) + ["cold"] * len(cold) + ["flat"] * len(flat), "x": np.r_[hot, cold, flat]})
    got = {r["g"]: r for r in exact_quantiles(spark.createDataFrame(pdf), ["g"], "x", {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.9, "e": 1.0}).collect()}
    for g, sub in pdf.groupby("g"):
        for name, p in {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.9, "e": 1.0}.items():
            assert got[g][name] == pytest.approx(np.percentile(sub["x"], p * 100), abs=1e-12), (g, name)


@pytest.mark.parametrize("n", [1, 2, 10, 11, 57, 1699, 1703])
def test_exact_quantiles_of_any_small_group(spark, n):
    x = np.random.default_rng(n).normal(0, 1, n)
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "x": x}))
    row = exact_quantiles(df, ["g"], "x", {"low": 0.1, "high": 0.9}).first()
    assert row["low"] == pytest.approx(np.percentile(x, 10), abs=1e-12) and row["high"] == pytest.approx(np.percentile(x, 90), abs=1e-12)


@pytest.mark.parametrize("n", [1001, 1013, 2999])
def test_exact_quantiles_of_bracketed_groups(spark, n):
    x = np.random.default_rng(n).normal(0, 1, n)
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "x": x}))
    row = exact_quantiles(df, ["g"], "x", {"low": 0.1, "high": 0.9}).first()
    assert row["low"] == pytest.approx(np.percentile(x, 10), abs=1e-12) and row["high"] == pytest.approx(np.percentile(x, 90), abs=1e-12)


def test_bias_corrected_moments(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 4, 8, 9)], "x double")
    row = df.select(sample_skew(F.col("x")).alias("s"), sample_excess_kurtosis(F.col("x")).alias("k")).first()
    s = pd.Series([1.0, 2, 4, 8, 9])
    assert row["s"] == pytest.approx(s.skew()) and row["k"] == pytest.approx(s.kurt())


@pytest.mark.parametrize("span", [3, 26, 200])
def test_ema_matches_recursion_across_blocks(spark, span):
    n = 6000  # several blocks for short spans
    x = np.random.default_rng(1).normal(100, 5, n)
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "date": np.arange(n), "x": x}))
    got = [r["e"] for r in with_ema(df, "x", "e", 2.0 / (span + 1)).orderBy("date").collect()]
    want = pd.Series(x).ewm(span=span, adjust=False).mean()
    assert np.allclose(got, want, rtol=1e-11)


def test_draws_do_not_depend_on_partitioning(spark):
    one = spark.range(0, 5000, 1, 1).select(uniform(1, "id").alias("u"), gaussian(1, "id").alias("z"))
    many = spark.range(0, 5000, 1, 13).select(uniform(1, "id").alias("u"), gaussian(1, "id").alias("z"))
    a, b = one.agg(F.sum("u"), F.avg("z"), F.stddev("z")).first(), many.agg(F.sum("u"), F.avg("z"), F.stddev("z")).first()
    assert a[0] == pytest.approx(b[0]) and abs(a[1]) < 0.05 and abs(a[2] - 1) < 0.05


def test_wilson_interval(spark):
    p, lo, hi = (c for c in wilson_interval(F.lit(55.0), F.lit(100.0)))
    row = spark.range(1).select(p.alias("p"), lo.alias("lo"), hi.alias("hi")).first()
    assert row["p"] == 0.55 and row["lo"] == pytest.approx(0.4524, abs=1e-4) and row["hi"] == pytest.approx(0.6438, abs=1e-4)


def test_quantile_brackets_hold_and_local_folders_are_refused(spark):
    rng = np.random.default_rng(8)
    values = {"a": rng.normal(size=3000), "b": np.repeat([1.0, 2.0], 1500), "c": rng.normal(size=7)}
    rows = [(k, float(x)) for k, v in values.items() for x in v]
    probs = {"p05": 0.05, "p50": 0.5, "p99": 0.99}
    got = exact_quantiles(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", probs)
    for r in got.collect():
        assert [r[n] for n in probs] == pytest.approx([np.quantile(values[r["k"]], p) for p in probs.values()])
    with pytest.raises(ValueError, match="share"):
        check_shared("spark://host:7077", "file:/data/steps")
    check_shared("spark://host:7077", "hdfs://store/steps")
    check_shared("local[4]", "/tmp/steps")


def test_exact_quantiles_of_extreme_values(spark):
    """Infinities, both zeros, the smallest and largest doubles, ties; nulls and NaN are left out."""
    inf, tiny = float("inf"), 5e-324
    groups = {"a": [-inf, -1.0, -0.0, 0.0, tiny, inf], "b": [1.7e308, -1.7e308, 3.0], "c": [2.5] * 1000, "d": [-tiny, tiny], "e": [float(i) for i in range(-500, 501)]}
    rows = [(k, v) for k, xs in groups.items() for v in xs] + [("a", None), ("a", float("nan")), ("f", None)]
    got = {r["k"]: r for r in exact_quantiles(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", {"low": 0.2, "mid": 0.5, "top": 1.0}).collect()}
    assert sorted(got) == sorted(groups)
    for k, xs in groups.items():
        ranked = sorted(xs)
        for name, p in {"low": 0.2, "mid": 0.5, "top": 1.0}.items():
            pos = p * (len(ranked) - 1)
            lo, hi = ranked[int(np.floor(pos))], ranked[int(np.ceil(pos))]
            assert got[k][name] == (lo if lo == hi else lo + (hi - lo) * (pos - np.floor(pos)))
