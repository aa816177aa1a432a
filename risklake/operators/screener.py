"""Screening, registry search, position checks and listing filters."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from risklake.functions.scalar import canonical_symbol
from risklake.session import free_shuffles, materialise

# The numeric bounds a screen may set, and the column each one reads.
BOUNDS = {"market_cap": "market_cap", "pe_ratio": "pe_ratio", "ev_to_ebitda": "ev_to_ebitda", "profit_margin": "profit_margin", "beta": "beta"}
MOST_ITEMS = 1000
LEVELS = 8
CELLS = 1 << LEVELS  # cells of a metric
GRID_WEIGHTS = 5  # weights of a book that choose its grid cell
GRID_TOLERANCES = 3  # width of a cell
FLAT_WEIGHTS = 16  # weights of a book that are columns; what wider books have beyond is compared as a list
SCREEN_SCHEMA = "struct<" + ",".join(f"min_{b}:double,max_{b}:double" for b in BOUNDS) + ",sector_in:array<string>,type_in:array<string>>"


def screener_rows(fundamentals: DataFrame) -> DataFrame:
    """Nested fundamentals documents as nine flat columns with defaults."""
    doc = F.col("doc")
    return fundamentals.select(
        F.col("symbol").alias("ticker"), F.coalesce(doc["type"], F.lit("UNKNOWN")).alias("type"), F.coalesce(doc["profile"]["name"], "symbol").alias("name"),
        F.coalesce(doc["profile"]["sector"], F.lit("Unknown")).alias("sector"), doc["valuation"]["market_cap"].alias("market_cap"),
        doc["valuation"]["pe_ratio"].alias("pe_ratio"), doc["valuation"]["ev_to_ebitda"].alias("ev_to_ebitda"),
        doc["profitability"]["profit_margin"].alias("profit_margin"), doc["technicals"]["beta"].alias("beta"),
    )


def screen(rows: DataFrame, filters: Mapping[str, Any]) -> DataFrame:
    """Rows inside every active bound; a NULL fails an active bound, as in SQL."""
    keep = F.lit(True)
    for bound, column in BOUNDS.items():
        if filters.get(f"min_{bound}") is not None:
            keep = keep & (F.col(column) >= float(filters[f"min_{bound}"]))
        if filters.get(f"max_{bound}") is not None:
            keep = keep & (F.col(column) <= float(filters[f"max_{bound}"]))
    if filters.get("sector_in"):
        keep = keep & F.lower("sector").isin(*[str(x).lower() for x in filters["sector_in"]])
    if filters.get("type_in"):
        keep = keep & F.upper("type").isin(*[str(x).upper() for x in filters["type_in"]])
    return rows.where(keep)


def run_screen(rows: DataFrame, filters: Mapping[str, Any], limit: int | None = 100, order: str = "ticker") -> DataFrame:
    """The first ``limit`` (1 to 1,000; None: all) rows that pass, in ``order``, each with ``hits``, the number of all that pass."""
    passed = screen(rows, filters)
    first = passed.orderBy(order)
    if limit is not None:
        first = first.limit(max(1, min(int(limit), MOST_ITEMS)))
    return first.withColumn("hits", passed.agg(F.count("*")).scalar())


def _cell_edges(rows: DataFrame) -> dict[str, list[float]]:
    """Per metric, values that cut the universe into about equal cells; ``CELLS - 1`` numbers each, any values would be correct."""
    cuts = [i / CELLS for i in range(1, CELLS)]
    got = rows.agg(*[F.percentile_approx(F.col(m).cast("double"), cuts).alias(m) for m in BOUNDS.values()]).first()
    return {m: list(got[m] or [0.0] * (CELLS - 1)) for m in BOUNDS.values()}


def _leaf(value: Column, edges: list[float]) -> Column:
    """Number of edges below a value, by bisection; null for null."""
    cuts, steps = F.lit(np.array(edges, float)), F.lit(np.array([CELLS >> (i + 1) for i in range(LEVELS)], np.int32))
    return F.when(value.isNotNull(), F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) < value, at + step).otherwise(at)))


#: SQL: the largest whole dyadic cells of leaves ``lo`` to ``hi``, at most two a level, as (level, number); a cell whose parent is whole is left out
_FIRST, _LAST = "shiftright(lo + shiftleft(1, l) - 1, l)", "(shiftright(hi + 1, l) - 1)"
_DYADIC = f"""flatten(transform(sequence(0, {LEVELS}), l -> filter(
    transform(array_distinct(array({_FIRST}, {_LAST})), i -> struct(l as level, i as number)),
    c -> c.number between {_FIRST} and {_LAST} and (l = {LEVELS} or not (c.number div 2 * 2 >= {_FIRST} and c.number div 2 * 2 + 1 <= {_LAST})))))"""


def saved_screen_candidates(screens: DataFrame, rows: DataFrame) -> DataFrame:
    """(screen, row) pairs that agree on the screen's most selective predicate, each pair once.

    Every metric is cut into ``CELLS`` cells of about equal counts. A screen posts one predicate: the bounds of one metric as whole
    dyadic cells (a cell, a pair of cells, ...), or its sectors, or its types, whichever is expected to pass the fewest rows. A row
    probes the ``LEVELS + 1`` cells above each of its values, its sector and its type. So the join has a key of many values, and a screen meets
    the rows of its own predicate instead of the whole universe.
    """
    parsed = screens.withColumn("f", F.from_json("filters", SCREEN_SCHEMA)).select("screen_id", "f.*")
    edges = _cell_edges(rows)
    lists = {"sector": (F.lower, "sector_in"), "type": (F.upper, "type_in")}
    kinds = rows.agg(*[F.greatest(F.approx_count_distinct(c), F.lit(1)).alias(c) for c in lists]).first()
    options = []
    span = lambda bound, metric: F.struct(
        F.coalesce(_leaf(F.col(f"min_{bound}"), edges[metric]), F.lit(0)).alias("lo"), F.coalesce(_leaf(F.col(f"max_{bound}"), edges[metric]), F.lit(CELLS - 1)).alias("hi"))
    # written: everything below refers to the cells many times
    parsed = materialise(parsed.select("*", *[span(b, m).alias(f"_{b}") for b, m in BOUNDS.items()]), "screen-cells")
    for bound in BOUNDS:
        lo, hi = F.col(f"min_{bound}"), F.col(f"max_{bound}")
        share = F.greatest(F.col(f"_{bound}.hi") - F.col(f"_{bound}.lo") + 1, F.lit(0)) / CELLS
        options.append(F.when(lo.isNotNull() | hi.isNotNull(), F.struct(share.alias("share"), F.lit(bound).alias("kind"), F.col(f"_{bound}.lo").alias("lo"), F.col(f"_{bound}.hi").alias("hi"))))
    for kind, (_, listed) in lists.items():
        share = F.size(F.array_distinct(listed)) / F.lit(float(kinds[kind]))
        options.append(F.when(F.size(listed) > 0, F.struct(share.alias("share"), F.lit(kind).alias("kind"), F.lit(0).alias("lo"), F.lit(0).alias("hi"))))
    options.append(F.struct(F.lit(2.0).alias("share"), F.lit("all").alias("kind"), F.lit(0).alias("lo"), F.lit(0).alias("hi")))
    best = parsed.withColumn("_best", F.array_min(F.array_compact(F.array(*options)))).withColumn("kind", F.col("_best.kind")).withColumn("lo", F.col("_best.lo")).withColumn("hi", F.col("_best.hi"))
    cells = F.transform(F.expr(_DYADIC), lambda c: F.concat_ws("/", c["level"].cast("string"), c["number"].cast("string")))
    posted = F.when(F.col("kind") == "all", F.array(F.lit("")))
    for kind, (fold, listed) in lists.items():
        posted = posted.when(F.col("kind") == kind, F.array_distinct(F.transform(listed, fold)))
    screens_by_key = best.withColumn("key", F.explode(posted.otherwise(F.when(F.col("lo") <= F.col("hi"), cells)))).drop("_best", "lo", "hi", *[f"_{b}" for b in BOUNDS])
    wide = rows.select("ticker", *BOUNDS.values(), "sector", "type", *[F.array(_leaf(F.col(m), edges[m])).alias(f"_{b}") for b, m in BOUNDS.items()])
    wide, probes = materialise(wide, "screen-universe"), []
    for bound, metric in BOUNDS.items():
        above = f"flatten(transform(_{bound}, leaf -> transform(sequence(0, {LEVELS}), l -> struct('{bound}' as kind, concat_ws('/', string(l), string(shiftright(leaf, l))) as key))))"
        probes.append(F.when(F.col(metric).isNotNull(), F.expr(above)))
    for kind, (fold, _) in lists.items():
        probes.append(F.when(F.col(kind).isNotNull(), F.array(F.struct(F.lit(kind).alias("kind"), fold(F.col(kind)).alias("key")))))
    probes.append(F.array(F.struct(F.lit("all").alias("kind"), F.lit("").alias("key"))))
    keyed = wide.select("ticker", *BOUNDS.values(), "sector", "type", F.explode(F.flatten(F.array_compact(F.array(*probes)))).alias("p"))
    return screens_by_key.join(keyed.select("ticker", *BOUNDS.values(), "sector", "type", "p.kind", "p.key"), ["kind", "key"])


def apply_saved_screens(screens: DataFrame, rows: DataFrame) -> DataFrame:
    """Every saved screen against the whole universe: candidates by an index of predicates, then all of each screen's filters."""
    j = saved_screen_candidates(screens, rows)
    keep = F.lit(True)
    for bound, column in BOUNDS.items():
        lo, hi = F.col(f"min_{bound}"), F.col(f"max_{bound}")
        keep = keep & F.coalesce(lo.isNull() | (F.col(column) >= lo), F.lit(False)) & F.coalesce(hi.isNull() | (F.col(column) <= hi), F.lit(False))
    for listed, fold, column in (("sector_in", F.lower, "sector"), ("type_in", F.upper, "type")):
        anything = F.coalesce(F.size(listed) <= 0, F.lit(True))
        keep = keep & (anything | F.coalesce(F.array_contains(F.transform(listed, fold), fold(F.col(column))), F.lit(False)))
    return j.where(keep).select("screen_id", "ticker")


def search_registry(assets: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Symbol contains the canonical term or name contains the term; top ``limit`` (1–50) by symbol."""
    term = query.strip()
    if not term:
        return assets.where(F.lit(False))
    hit = F.col("symbol").contains(term.upper()) | F.col("name").contains(term)
    return assets.where(hit).orderBy("symbol").limit(max(1, min(int(limit), 50)))


def position_violations(positions: DataFrame, by: str = "portfolio_id") -> DataFrame:
    """Rule breaches per portfolio: blank or repeated ticker, negative weight, weights off 1 ± 0.01."""
    p = positions.withColumn("symbol", canonical_symbol(F.coalesce("symbol", F.lit("")))).withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    per_symbol = p.groupBy(by, "symbol").agg(F.count("*").alias("n"), F.min("weight").alias("lowest"), F.sum("weight").alias("weight"))
    rules = F.filter(
        F.array(
            F.when(F.col("symbol") == "", F.lit("blank_ticker")),
            F.when((F.col("symbol") != "") & (F.col("n") > 1), F.lit("duplicate_ticker")),
            F.when(F.col("lowest") < 0, F.lit("negative_weight")),
        ),
        lambda x: x.isNotNull(),
    )
    row_rules = per_symbol.select(by, F.explode(rules).alias("rule"), "symbol")
    total = per_symbol.groupBy(by).agg(F.sum("weight").alias("total"))
    off = total.where((F.col("total") > 0) & (F.abs(F.col("total") - 1.0) > 0.01)).select(
        by, F.lit("weights_do_not_sum_to_one").alias("rule"), F.lit(None).cast("string").alias("symbol")
    )
    return row_rules.unionByName(off)


def list_events(
    events: DataFrame, rules: DataFrame, user_id: int, ticker: str | None = None, triggered_only: bool = False, detector_source: str | None = None,
    alert_id: int | None = None, limit: int = 100,
) -> DataFrame:
    """One user's alert events, newest first, optionally by rule, ticker and payload source."""
    mine = events.join(rules.where(F.col("user_id") == user_id).select("alert_id"), "alert_id", "left_semi")
    if alert_id is not None:
        mine = mine.where(F.col("alert_id") == alert_id)
    if ticker:
        mine = mine.where(F.col("ticker") == ticker.strip().upper())
    if triggered_only:
        mine = mine.where("triggered")
    if detector_source:
        mine = mine.where(F.lower(F.get_json_object("payload", "$.detector_source")) == detector_source.strip().lower())
    return mine.orderBy(F.desc("evaluated_at"), F.desc("event_id")).limit(max(1, min(limit, 1000)))


def trade_list(before: DataFrame, after: DataFrame, prices: DataFrame, value: float, band: float = 0.001, by: str = "portfolio_id") -> DataFrame:
    """Buy/Sell/Hold from weights before and after, with money and whole shares."""
    b = before.select(by, "symbol", F.col("weight").alias("from_weight"))
    a = after.select(by, "symbol", F.col("weight").alias("to_weight"))
    j = b.join(a, [by, "symbol"], "full_outer").withColumns({"from_weight": F.coalesce("from_weight", F.lit(0.0)), "to_weight": F.coalesce("to_weight", F.lit(0.0))})
    j = j.join(prices.select("symbol", F.col("latest").alias("last_price")), "symbol", "left").withColumn("diff", F.col("to_weight") - F.col("from_weight"))
    hold = F.abs("diff") < band
    money = F.when(hold, 0.0).otherwise(F.abs("diff") * value)
    return j.select(
        by, "symbol", "from_weight", "to_weight", F.when(hold, "Hold").when(F.col("diff") > 0, "Buy").otherwise("Sell").alias("action"), money.alias("value"),
        F.when(~hold & (F.col("last_price") > 0), F.floor(F.try_divide(money, F.col("last_price")))).alias("shares"),
    )


def matching_cached_results(requested: DataFrame, cached: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """(portfolio_id, cache_id) whose ticker sets agree and whose weights differ by at most 2%.

    ``requested`` (portfolio_id, symbol, weight) and ``cached`` (cache_id, symbol, weight) meet on the
    ordered ticker set and on a grid cell of their first weights. A cell is some tolerances wide and a
    requested book is put into each one that its tolerance touches, so a pair meets once and nothing is
    missed; popular ticker sets never compare all their books with each other. Weights are plain columns:
    pairs that meet are compared in compiled code.
    """
    share = F.col("weight") / F.sum("weight").over(W.partitionBy("portfolio_id"))
    named = lambda books, side: books.withColumn("book", F.to_json(F.map_keys(side)))  # noqa: E731  tells any two sets apart
    req = materialise(named(_books(requested.withColumn("w", share), "portfolio_id", "a"), "a"), "requested-books")
    have = materialise(named(_books(cached.withColumn("w", F.col("weight")), "cache_id", "b"), "b"), "cached-books")
    free_shuffles(req.sparkSession)
    widest = have.agg(F.max(F.size("b"))).first()[0] or 0
    near, width = tolerance * 1.000001, GRID_TOLERANCES * tolerance  # a hair more than the tolerance: an exact tie is still met
    at = lambda side, k: F.get(F.map_values(side), F.lit(k))
    known = lambda side: ~F.exists(F.map_values(side), lambda w: w.isNull())  # noqa: E731  an unknown weight is not near any other
    flat = min(widest, FLAT_WEIGHTS)
    rest = lambda side: [F.map_values(side).alias(f"_{side}")] if widest > flat else []
    req = req.where(known("a")).select("portfolio_id", "book", *[at("a", k).alias(f"a{k}") for k in range(flat)], *rest("a"))
    have = have.where(known("b")).select("cache_id", "book", *[at("b", k).alias(f"b{k}") for k in range(flat)], *rest("b"))
    cells = [f"_c{k}" for k in range(min(flat, GRID_WEIGHTS))]
    for k, c in enumerate(cells):
        low, high = (F.coalesce(F.floor((F.col(f"a{k}") + d) / width), F.lit(0)) for d in (-near, near))
        req = req.withColumn(c, F.explode(F.sequence(low, high)))
        have = have.withColumn(c, F.coalesce(F.floor(F.col(f"b{k}") / width), F.lit(0)))
    keys = ["_key", *cells, "book"]  # the hash first, because rows are sorted by it
    key = F.xxhash64(*cells, "book")
    j = req.withColumn("_key", key).join(have.withColumn("_key", key), keys)
    for k in range(flat):
        j = j.where(F.col(f"b{k}").isNull() | (F.abs(F.col(f"a{k}") - F.col(f"b{k}")) <= tolerance))  # null: books of fewer tickers
    if widest > flat:
        j = j.where(F.forall(F.zip_with("_a", "_b", lambda x, y: F.abs(x - y) <= tolerance), lambda ok: ok))
    return j.select("portfolio_id", "cache_id")


def newest_cached_result(requested: DataFrame, cached: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """(portfolio_id, cache_id, created_at): the newest stored result of each portfolio that still fits its book.

    ``requested`` (portfolio_id, symbol, weight), ``cached`` (portfolio_id, cache_id, created_at, symbol, weight). A result fits when
    it has the same tickers and every weight differs by at most the tolerance; of several at one time the largest id counts. One
    equi-join on the portfolio, so each stored result meets one book only. A portfolio without a fitting result has no row.
    """
    share = F.col("weight") / F.sum("weight").over(W.partitionBy("portfolio_id"))
    book = _books(requested.withColumn("w", share), "portfolio_id", "a").withColumnRenamed("book", "wanted")
    stored = cached.groupBy("portfolio_id", "cache_id").agg(
        F.max("created_at").alias("created_at"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("symbol", F.col("weight").alias("w"))))).alias("b"))
    fits = F.forall(F.map_entries("a"), lambda e: F.abs(e["value"] - F.try_element_at(F.col("b"), e["key"])) <= tolerance)
    fitting = stored.join(book, "portfolio_id").where((F.array_join(F.map_keys("b"), "|") == F.col("wanted")) & fits)
    newest = fitting.groupBy("portfolio_id").agg(F.max(F.struct("created_at", "cache_id")).alias("m"))
    return newest.select("portfolio_id", F.col("m.cache_id").alias("cache_id"), F.col("m.created_at").alias("created_at"))


def _books(rows: DataFrame, by: str, name: str) -> DataFrame:
    """One symbol-ordered weight map per key, with its ticker set as text."""
    out = rows.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("symbol", "w")))).alias(name))
    return out.withColumn("book", F.array_join(F.map_keys(name), "|"))


def same_ticker_set(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
    """Keys whose ordered ticker sets are equal on both sides."""
    l = left.groupBy(by).agg(F.array_sort(F.collect_set("symbol")).alias("a"))
    r = right.groupBy(by).agg(F.array_sort(F.collect_set("symbol")).alias("b"))
    return l.join(r, by).select(by, (F.col("a") == F.col("b")).alias("same"))
