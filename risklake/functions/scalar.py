"""Scalar column builders: parsing, cleaning, symbols, clocks, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date layouts tried in this order.
DATE_LAYOUTS = [
    "yyyy-M-d", "M/d/yyyy", "M/d/yy", "d/M/yyyy", "d-MMM-yyyy", "MMM d, yyyy", "M-d-yyyy", "yyyy/M/d",
]
# Headline keywords.
BULLISH_WORDS = ["beats", "surge", "upgrade", "growth", "record", "buy", "bull"]
BEARISH_WORDS = ["misses", "downgrade", "drop", "sell", "slump", "lawsuit", "bear"]
# Listing suffixes of exchanges outside the first price source.
FOREIGN_SUFFIXES = [
    ".L", ".T", ".HK", ".PA", ".DE", ".AS", ".MI", ".SW", ".CO", ".OL", ".ST", ".VI", ".LS", ".BR",
    ".HE", ".AT", ".IS", ".TA", ".SA", ".JK", ".KS", ".KQ", ".SS", ".SZ", ".AX", ".NZ", ".TO", ".V", ".MX",
]
# Index symbols in the prefixed vendor form.
INDEX_CODES = {
    "^GSPC": "I:SPX", "^DJI": "I:DJI", "^IXIC": "I:COMP", "^VIX": "I:VIX", "^RUT": "I:RUT",
}
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: str | Column) -> Column:
    x = as_col(c)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def finite_or_null(c: str | Column) -> Column:
    return F.when(is_finite(c), as_col(c))


def finite_or_zero(c: str | Column) -> Column:
    return F.when(is_finite(c), as_col(c)).otherwise(F.lit(0.0))


def clean_number(c: str | Column) -> Column:
    """``$1,234.5`` → 1234.5, ``(500)`` → -500, ``10%`` → 10, blank or n/a → NULL."""
    s = F.trim(as_col(c).cast("string"))
    digits = F.trim(F.regexp_replace(s, r"[()$,%]", ""))
    number = F.when(~F.lower(digits).isin("", "-", "n/a", "na"), digits).try_cast("double")
    return F.when(s.startswith("(") & s.endswith(")"), -number).otherwise(number)


def parse_date(c: str | Column) -> Column:
    """First layout of ``DATE_LAYOUTS`` that fits; NULL otherwise."""
    s = F.trim(as_col(c))
    s = F.when(~F.lower(s).isin("", "n/a", "na", "-", "various"), s)
    tries = []
    for layout in DATE_LAYOUTS:
        text = F.initcap(s) if "MMM" in layout else s
        # month names are matched case-insensitively, the day part after '-' needs its own capital
        if layout == "d-MMM-yyyy":
            text = F.concat_ws("-", *[F.initcap(F.try_element_at(F.split(s, "-"), F.lit(i))) for i in (1, 2, 3)])
        day = F.to_date(F.try_to_timestamp(text, F.lit(layout)))
        if layout == "M/d/yy":  # two-digit years pivot at 69
            day = F.when(F.year(day) > 2068, F.add_months(day, -1200)).otherwise(day)
        tries.append(day)
    return F.coalesce(*tries)


def total_cost(total: Column, unit: Column, quantity: Column) -> Column:
    """Supplied total, else unit cost times a non-zero quantity."""
    return F.coalesce(total, F.when(quantity != 0, unit * quantity))


def canonical_symbol(c: str | Column) -> Column:
    return F.upper(F.trim(as_col(c)))


def dashed_pair(c: str | Column) -> Column:
    """``btc/usd`` → ``BTC-USD``."""
    return canonical_symbol(F.regexp_replace(as_col(c), "/", "-"))


def slashed_pair(c: str | Column) -> Column:
    """``BTC-USD`` → ``BTC/USD``; ``ETHUSDT`` → ``ETH/USDT``; others unchanged."""
    t = F.upper(as_col(c))
    head = F.regexp_replace(t, r"(-USD|USDT|USDC)$", "")
    return (
        F.when(t.endswith("-USD"), F.concat(head, F.lit("/USD")))
        .when(t.endswith("USDT"), F.concat(head, F.lit("/USDT")))
        .when(t.endswith("USDC"), F.concat(head, F.lit("/USDC")))
        .otherwise(t)
    )


def prefixed_pair(c: str | Column) -> Column:
    """``BTC-USD`` → ``X:BTCUSD``, index symbols by table, others unchanged."""
    t = as_col(c)
    out = F.when(
        t.endswith("-USD"), F.concat(F.lit("X:"), F.regexp_replace(t, "-USD", ""), F.lit("USD"))
    ).otherwise(t)
    for symbol, code in INDEX_CODES.items():
        out = F.when(t == symbol, F.lit(code)).otherwise(out)
    return out


def is_crypto_symbol(symbol: Column, asset_class: Column) -> Column:
    shape = F.upper(symbol).rlike(r"-(USD|USDT|EUR|GBP)$")
    return F.coalesce(F.upper(asset_class) == "CRYPTO", F.lit(False)) | shape


def has_foreign_suffix(c: str | Column) -> Column:
    t = F.upper(as_col(c))
    test = F.lit(False)
    for suffix in FOREIGN_SUFFIXES:
        test = test | t.endswith(suffix)
    return test


def market_is_open(ts: str | Column) -> Column:
    """Regular US session: Monday–Friday 09:30–16:00 New York, both ends included."""
    local = F.from_utc_timestamp(as_col(ts), "America/New_York")
    minutes = F.hour(local) * 60 + F.minute(local)
    return F.weekday(local).between(0, 4) & minutes.between(570, 960)


def stable_hash(*cols: str | Column, length: int | None = None) -> Column:
    """SHA-256 of the key-sorted JSON of the named columns."""
    named = sorted(c if isinstance(c, str) else str(c) for c in cols)
    digest = F.sha2(F.to_json(F.struct(*named)), 256)
    return F.substring(digest, 1, length) if length else digest


def keyword_hits(text: str | Column, words: Sequence[str]) -> Column:
    lowered = F.lower(as_col(text))
    hits = F.lit(0)
    for word in words:
        hits = hits + F.contains(lowered, F.lit(word)).cast("int")
    return hits


def headline_sentiment(text: str | Column) -> Column:
    up, down = keyword_hits(text, BULLISH_WORDS), keyword_hits(text, BEARISH_WORDS)
    return F.when(up > down, "Bullish").when(down > up, "Bearish").otherwise("Neutral")


def is_email(c: str | Column) -> Column:
    s = F.lower(F.trim(as_col(c)))
    return F.coalesce((F.length(s) <= 254) & s.rlike(EMAIL_PATTERN), F.lit(False))


def compact_money(c: str | Column) -> Column:
    """``-$1.25M``, ``$40K``, ``$512``."""
    v = as_col(c)
    sign = F.when(v < 0, "-").otherwise("")
    mag = F.abs(v)
    body = (
        F.when(mag >= 1e6, F.concat(F.format_string("%.2f", mag / 1e6), F.lit("M")))
        .when(mag >= 1e3, F.concat(F.format_string("%.0f", mag / 1e3), F.lit("K")))
        .otherwise(F.format_string("%.0f", mag))
    )
    return F.concat(sign, F.lit("$"), body)


def signed_percent(c: str | Column, digits: int = 2) -> Column:
    v = as_col(c)
    text = F.concat(F.when(v >= 0, "+").otherwise(""), F.format_string(f"%.{digits}f%%", v * 100))
    return F.when(is_finite(v), text).otherwise(F.lit("—"))


def age_label(ts: str | Column, now: Column) -> Column:
    secs = F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp(as_col(ts)))
    minutes, hours, days = F.floor(secs / 60), F.floor(secs / 3600), F.floor(secs / 86400)
    text = (
        F.when(secs < 60, F.lit("just now"))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .otherwise(F.concat(days.cast("string"), F.lit("d ago")))
    )
    return F.when(as_col(ts).isNull(), F.lit("")).otherwise(text)


def last_finite(values: str | Column) -> Column:
    """Last finite element of an array, NULL if there is none."""
    kept = F.filter(as_col(values), is_finite)
    return F.try_element_at(kept, F.lit(-1))


def clamp_return(c: Column, limit: float = 2.0) -> Column:
    """Non-finite or implausible monthly returns become 0."""
    return F.when(is_finite(c) & (F.abs(c) <= limit), c).otherwise(F.lit(0.0))


def scenario_origin(name: str | Column, builtins: Sequence[str]) -> Column:
    n = as_col(name)
    return (
        F.when(n.isin(*builtins), "Built-in")
        .when(n == "base", "Reference")
        .when(n == "worst_case_cvar", "Auto-discovered")
    )


def fragility_label(c: str | Column) -> Column:
    s = as_col(c)
    return (
        F.when(~is_finite(s), "unavailable")
        .when(s >= 1.5, "elevated (above the 1.5 fragile threshold)")
        .when(s >= 1.15, "moderately above its long-run median but below the 1.5 fragile threshold")
        .when(s >= 0.85, "near its long-run median")
        .otherwise("below its long-run median")
    )
