"""Small fixtures: series as (key, date, price) rows."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd


def business_days(start: str, n: int) -> list[dt.date]:
    return [d.date() for d in pd.bdate_range(start, periods=n)]


def series_frame(spark, data: dict[str, tuple[list[dt.date], list[float]]], key: str = "symbol"):
    rows = [(k, d, float(p)) for k, (dates, prices) in data.items() for d, p in zip(dates, prices)]
    return spark.createDataFrame(rows, f"{key} string, date date, price double")


def pattern_prices(n: int, start: float = 100.0, sign: float = 1.0, scale: float = 0.01) -> list[float]:
    r = [sign * scale * (-1) ** i * (1 + (i % 5) * 0.1) for i in range(n)]
    return list(start * np.cumprod(1 + np.array(r)))


def random_prices(n: int, seed: int, mean: float = 0.0004, sd: float = 0.01) -> list[float]:
    rng = np.random.default_rng(seed)
    return list(100 * np.cumprod(1 + rng.normal(mean, sd, n)))
