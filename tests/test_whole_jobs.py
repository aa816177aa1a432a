"""Queries that must give every row of their job, on tables made here."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

import __spark_entry__ as entry_module
from risklake.operators import alerts, screener
from risklake.streaming import jobs

NATIONS, CUSTOMERS, PARTS = 2, 60, 600
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Books of one to three symbols with few different weights; events of the same users."""
    root, rng = str(tmp_path_factory.mktemp("tables")), np.random.default_rng(5)
    day = lambda i: dt.datetime(1996, 1, 1) + dt.timedelta(days=int(i))
    tables = {
        "nation": ([(i, f"N{i}", 0) for i in range(NATIONS)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(i, f"C{i}", i % NATIONS, SEGMENTS[i % 5], float(i % 9 - 2) * 40) for i in range(1, CUSTOMERS + 1)], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string, c_acctbal double"),
        "part": ([(i, f"p{i}", TYPES[i % 6], f"Brand#{3 + i % 3}", 921.0 + i % 70, 5 + i % 40) for i in range(1, PARTS + 1)], "p_partkey long, p_name string, p_type string, p_brand string, p_retailprice double, p_size int"),
        "orders": ([(i, i, day(i)) for i in range(1, CUSTOMERS + 1)], "o_orderkey long, o_custkey long, o_orderdate timestamp"),
        "lineitem": ([(i, 1 + j, int(6 * rng.integers(1, 90) + j), float(1 + i % 2), 100.0 * (1 + i % 2), day(rng.integers(0, 900))) for i in range(1, CUSTOMERS + 1) for j in range(1 + i % 3)], "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp"),
        "events": ([(i, 1 + i % 7, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), "view", float(i % 60)) for i in range(200)], "event_id long, user_id long, ts timestamp, event_type string, value double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/{name}.parquet")
    return root


def both(spark, made, name):
    """Sorted rows of a query and of its SQL twin."""
    con = duck_of(made)
    got = [tuple(r) for r in entry_module.queries()[name](spark, made).collect()]
    want = con.execute(entry_module.oracle_sql()[name]).fetchall()
    return sorted(got, key=repr), sorted(want, key=repr)


def duck_of(made):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in ("nation", "customer", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{made}/{name}.parquet/*.parquet')")
    return con


# ---- F1 --------------------------------------------------------------------------------
def test_screener_without_limit_gives_all_that_pass(spark):
    rows = spark.range(1200).selectExpr("concat('T', id) as ticker", "'s' as sector", "'EQUITY' as type", "double(id) as market_cap", "10D as pe_ratio", "1D as ev_to_ebitda", "1D as profit_margin", "1D as beta")
    got = screener.run_screen(rows, {"min_market_cap": 100}, limit=None).collect()
    assert len(got) == 1100 and {r["hits"] for r in got} == {1100}
    assert [r["ticker"] for r in got] == sorted(f"T{i}" for i in range(100, 1200))


def test_screener_query_is_not_cut(spark, made):
    got, want = both(spark, made, "flt_01_screener")
    assert got == want and len(got) > 25 and {r[-1] for r in got} == {len(got)}


# ---- F2 --------------------------------------------------------------------------------
def test_cached_match_meets_the_results_of_all_portfolios(spark, made):
    got, want = both(spark, made, "join_19_cached_match")
    assert got == want and len(got) == len(set(got))
    assert sum(a != b for a, b in got) > CUSTOMERS  # books of other portfolios, not the own one alone


# ---- F3 --------------------------------------------------------------------------------
def test_alert_exposure_has_all_books_of_the_owner(spark, made):
    got, want = both(spark, made, "join_08_alert_exposure")
    assert got == want and sum(alert != book for alert, book, *_ in got) > CUSTOMERS
    own, want = both(spark, made, "join_08_customer_exposure")
    assert own == want and set(own) < set(got)


# ---- F5 --------------------------------------------------------------------------------
def test_edge_stream_keeps_state_by_blocks_of_rules(spark):
    rng = np.random.default_rng(2)
    schema = "alert_id long, evaluated_at timestamp, triggered boolean, stored boolean"
    ids = [None, -1, -1024, -5000, 0, 1023, 1024, 2**62 + 3, 2**62 + 1027, *range(2000, 4500, 7)]
    parts = [[(a, dt.datetime(2024, 1, 1) + dt.timedelta(hours=6 * part + i), bool(rng.random() > 0.5), False) for i in rng.permutation(6).tolist() for a in ids] for part in range(2)]
    stored = [(a, dt.datetime(2025, 1, 1), True, True) for a in ids[::3]]
    landed = jobs.drain_landings([spark.createDataFrame(p, schema) for p in (stored, *parts)], jobs.edge_stream, schema)
    flag, want = {a: a in ids[::3] for a in ids}, []
    for a, at, on, _ in sorted((r for p in parts for r in p), key=lambda r: r[1]):
        if on != flag[a]:
            want.append((a, at, on, "rising" if on else "falling"))
        flag[a] = on
    assert sorted(map(tuple, landed.drop("epoch").collect()), key=repr) == sorted(want, key=repr)
    unknown = jobs.drain_landings([spark.createDataFrame(p, schema) for p in ([(1, dt.datetime(2024, 1, 1), True, False), (2, dt.datetime(2024, 1, 1), True, False)], [(1, dt.datetime(2024, 1, 2), None, False)])], jobs.edge_stream, schema)
    assert sorted((r.alert_id, r.triggered, r.edge) for r in unknown.where("evaluated_at < '2024-01-02'").collect()) == [(1, True, "rising"), (2, True, "rising")]
    assert [(r.alert_id, r.triggered, r.edge) for r in unknown.where("evaluated_at >= '2024-01-02'").collect()] == [(1, None, None)]
    stream = spark.readStream.format("rate").load().selectExpr("value as alert_id", "timestamp as evaluated_at", "value % 2 = 0 as triggered")
    plan = jobs.edge_stream(stream)._jdf.queryExecution().analyzed().toString()
    assert "[_block" in next(line for line in plan.splitlines() if "FlatMapGroupsInPandasWithState" in line)  # not a call for each rule


def test_cooldown_stream_of_many_rules_equals_a_loop(spark):
    rng = np.random.default_rng(4)
    rows = [(a, i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=int(m)), a % 5 * 600) for a in [-3, *range(900, 1200)] for i, m in enumerate(rng.integers(0, 300, 12))]
    schema = "alert_id long, event_id long, ts timestamp, cooldown_seconds int"
    early = [r for r in rows if r[2] < dt.datetime(2024, 1, 1, 2)]
    landed = jobs.drain_landings([spark.createDataFrame(p, schema) for p in (early, [r for r in rows if r not in set(early)])], jobs.cooldown_stream, schema)
    last, want = {}, []
    for a, i, ts, gap in sorted(rows, key=lambda r: (r[2], r[1])):
        kept = gap == 0 or a not in last or (ts - last[a]).total_seconds() > gap
        if kept:
            last[a] = ts
        want.append((a, i, ts, kept))
    assert sorted(map(tuple, landed.drop("epoch").collect())) == sorted(want)


# ---- F6 --------------------------------------------------------------------------------
def test_edges_are_dealt_over_partitions_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(alerts, "EDGE_ROWS", 100)
    rng = np.random.default_rng(8)
    rows = [(a, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), None if rng.random() < 0.1 else bool(rng.random() > 0.5)) for a in [None, *range(39)] for i in range(25)]
    df = spark.createDataFrame(rows, "alert_id long, evaluated_at timestamp, triggered boolean")
    assert alerts.edge_events(df).rdd.getNumPartitions() == 10
    prior = {a: a % 2 == 0 for a in range(0, 39, 3)}
    got = alerts.edge_events(df, spark.createDataFrame(list(prior.items()), "alert_id long, last_triggered boolean")).collect()
    before, want = {}, []
    for a, at, on in sorted(rows, key=lambda r: r[1]):
        was = before.get(a)
        was = prior.get(a, False) if was is None else was
        before[a] = on
        if on is not None and on != was:
            want.append((a, at, on, "rising" if on else "falling"))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_edge_queries_equal_sql(spark, made):
    for name in ("alt_06_edge_trigger", "alt_06_edge_trigger_stream"):
        got, want = both(spark, made, name)
        assert got == want and got


# ---- F4 --------------------------------------------------------------------------------
def test_near_stage_links_by_simhash_too(spark):
    import random

    import corpus_pipeline
    from risklake.llm.near_dup import hashed
    from risklake.llm.simhash import fingerprint

    docs = []
    for seed in (2, 3, 10):  # a passage twelve times, three words changed: two bits at most, but too few equal runs of five words
        rng = random.Random(seed)
        base = [f"w{rng.randrange(900)}" for _ in range(40)] * 12
        words = list(base)
        for _ in range(3):
            words[rng.randrange(len(words))] = "other" + str(rng.randrange(5))
        a, b = " ".join(base), " ".join(words)
        x, y = set(hashed(a).tolist()), set(hashed(b).tolist())
        assert (fingerprint(a) ^ fingerprint(b)).bit_count() <= 2 and 5 * len(x & y) < 4 * len(x | y)
        docs += [(10 * seed, a, "en", "a", 1), (10 * seed + 1, b, "en", "a", 1), (10 * seed + 2, f"a text of its own, number {seed}", "en", "a", 1)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert sorted(r.doc_id for r in got.collect()) == [20, 22, 30, 32, 100, 102]


# ---- F1, round 4: join_08_alert_exposure -----------------------------------------------
def _exposure_frames(spark, rules, books, events):
    return (
        spark.createDataFrame(rules, "alert_id long, user_id long, ticker string"), spark.createDataFrame(books, "portfolio_id long, user_id long, symbol string, weight double"),
        spark.createDataFrame(events, "event_id long, alert_id long, triggered boolean, evaluated_at timestamp"),
    )


def test_exposure_is_dealt_by_pairs_and_gives_each_once(spark, monkeypatch):
    for name, value in (("TILE_ROWS", 8), ("TASK_PAIRS", 100), ("LIST_ROWS", 3)):
        monkeypatch.setattr(alerts, name, value)
    rules = [(i, i % 3, "aa" if i % 2 else "BB") for i in range(60)] + [(7, 1, "AA"), (None, 1, "AA"), (None, 1, "AA"), (90, None, "AA"), (91, 1, None), (92, 8, "AA")]
    books = [(i, i % 3, s, None if i % 9 == 0 else i / 100) for i in range(70) for s in ("AA", "BB")] + [(4, 1, "AA", 0.5), (None, 1, "AA", 0.2), (200, None, "AA", 0.1), (201, 1, None, 0.1)]
    events = [(i, i % 40, i % 3 == 0, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)) for i in range(100)]
    last = {a: (on, at) for _, a, on, at in events}
    want = sorted(((a, s, p, w, *last.get(a, (None, None))) for a, u, t in rules for p, v, s, w in books if u is not None and u == v and t and t.upper() == s), key=repr)
    got = alerts.alert_exposure(*_exposure_frames(spark, rules, books, events))
    columns = ["alert_id", "symbol", "portfolio_id", "weight", "last_triggered", "last_evaluated_at"]
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == want
    assert got.rdd.getNumPartitions() == -(-len(want) // 100)  # not by the bytes of rules and books
    text = alerts.alert_exposure(*_exposure_frames(spark, rules, books, events), time_format="yyyy-MM-dd HH:mm:ss")
    assert {r[0] for r in text.select("last_evaluated_at").collect()} == {x[-1] and str(x[-1]) for x in want}
    plain = alerts.alert_exposure(*_exposure_frames(spark, rules, books, events), shared=False)
    assert sorted(map(tuple, plain.select(columns).collect()), key=repr) == want


def test_exposure_of_many_books_takes_little_disk(spark, tmp_path):
    rng = np.random.default_rng(6)
    rules, books = [(i, 1, "AA") for i in range(520)], [(i, 1, "AA", float(w)) for i, w in enumerate(rng.random(4003))]
    events = [(i, i, bool(rng.random() > 0.5), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=977 * i)) for i in range(520)]
    got = alerts.alert_exposure(*_exposure_frames(spark, rules, books, events))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with larger tables
    try:
        got.write.parquet(f"{tmp_path}/out")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == back.distinct().count() == 520 * 4003
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.6 * 520 * 4003


# ---- F2, round 4: join_19_cached_match -------------------------------------------------
def _near_books(rng, n, key):
    out = []
    for i in range(n):
        names = ["A", "B", "C", "D", "E", "F"][: 1 + int(rng.integers(6))] if i % 3 else [f"S{k:02d}" for k in range(int(rng.integers(17, 19)))]
        w = rng.dirichlet([40] * len(names))
        out += [(key + i, s, float(x)) for s, x in zip(names, w)]
    return out


def _match_frames(spark, req, have):
    return spark.createDataFrame(req, "portfolio_id long, symbol string, weight double"), spark.createDataFrame(have, "cache_id long, symbol string, weight double")


def test_cached_match_equals_all_pairs_for_small_and_wide_books(spark):
    rng = np.random.default_rng(12)
    req, have = _near_books(rng, 150, 0), _near_books(rng, 150, 1000)
    req += [(500, "A|B", 1.0), (501, "A", 0.5), (501, "B|C", 0.5), (502, "A", 0.49), (502, "B", 0.51), (None, "A", 3.0)]
    have += [(1500, "A", 0.5), (1500, "B", 0.5), (1501, "A|B", 0.5), (1501, "C", 0.5), (1502, "A", None), (1502, "B", 0.5), (1503, "A", 0.52), (1503, "B", 0.48), (1504, "A", -0.5), (1504, "B", 1.5)]
    books = lambda rows: {k: {s: w for i, s, w in rows if i == k} for k in {r[0] for r in rows}}
    share = {k: {s: w / sum(b.values()) for s, w in sorted(b.items())} for k, b in books(req).items()}
    want = {(i, j) for i, a in share.items() for j, b in books(have).items() if set(a) == set(b) and all(b[s] is not None and abs(a[s] - b[s]) <= 0.02 for s in a)}
    got = [tuple(r) for r in screener.matching_cached_results(*_match_frames(spark, req, have)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {len(share[i]) for i, _ in want} >= {1, 2, 5, 6, 17} and (502, 1500) in want and (502, 1503) not in want


def test_cached_match_compares_in_compiled_code(spark):
    rng = np.random.default_rng(13)
    rows = [(i, s, float(x)) for i in range(40) for s, x in zip("ABCDEF", rng.dirichlet([8] * 6))]
    plan = screener.matching_cached_results(*_match_frames(spark, rows, rows))._jdf.queryExecution().executedPlan().toString()
    assert "forall" not in plan.lower() and "HashAggregate" not in plan  # weights are columns, and no pair is met twice
