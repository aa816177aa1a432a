"""The analytics input shapes derived from the given star-schema and event tables.

Everything is a lazy DataFrame over the parquet files, so filters and column pruning reach the
scan. Joins carry no hints: Spark broadcasts a side only below its size threshold and otherwise
sort-merges with skew splitting.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from risklake.session import materialise

# The six price symbols and how each is classed in this data set.
SYMBOLS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
FORECAST_START = "2001-06-14"
ASSET_CLASS = {
    "ECONOMY": "US_EQUITY",
    "LARGE": "BOND_ETF",
    "MEDIUM": "BOND_ETF",
    "PROMO": "COMMODITY",
    "SMALL": "US_EQUITY",
    "STANDARD": "ETF",
}
ASSET_TYPE = {
    "ECONOMY": "EQUITY",
    "LARGE": "BOND",
    "MEDIUM": "BOND",
    "PROMO": "FUTURE",
    "SMALL": "EQUITY",
    "STANDARD": "ETF",
}


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """Constant-map lookup that stays inside code generation."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.element_at(F.create_map(*pairs), key)


class Tables:
    """Lazy access to the driver tables and to the derived reference shapes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def store(self, name: str) -> None:
        """Write a derived table that a query reads more than once, and serve it from there."""
        self.__dict__[name] = materialise(getattr(self, name), name)

    # ---- prices -----------------------------------------------------------------
    @cached_property
    def _traded(self) -> DataFrame:
        line = self.raw("lineitem").select(
            "l_partkey", "l_shipdate", "l_quantity", "l_extendedprice"
        )
        part = self.raw("part").select("p_partkey", F.col("p_type").alias("symbol"))
        return line.join(part, F.col("l_partkey") == F.col("p_partkey"))

    def _bars(self, day: Column) -> DataFrame:
        # one partial aggregate per map task: a symbol with a third of all rows still
        # reaches the shuffle as at most one row per date and task
        return (
            self._traded.groupBy("symbol", day.alias("date"))
            .agg(
                F.sum("l_extendedprice").alias("_value"),
                F.sum("l_quantity").alias("volume"),
            )
            .select("symbol", "date", (F.col("_value") / F.col("volume")).alias("price"), "volume")
        )

    @cached_property
    def prices_daily(self) -> DataFrame:
        return self._bars(F.to_date("l_shipdate"))

    @cached_property
    def prices_weekly(self) -> DataFrame:
        return self._bars(F.to_date(F.date_trunc("week", "l_shipdate")))

    @cached_property
    def benchmark_weekly(self) -> DataFrame:
        """All-symbol weekly price under the symbol ``ALL``."""
        return (
            self.raw("lineitem")
            .groupBy(F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"))
            .agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"))
            .select(F.lit("ALL").alias("symbol"), "date", "price")
        )

    @cached_property
    def history_weekly(self) -> DataFrame:
        return self.prices_weekly.where(F.col("date") < F.lit(FORECAST_START).cast("date"))

    @cached_property
    def forecast_weekly(self) -> DataFrame:
        """The weeks after the cut-off stand for a forecast with a ±10% band."""
        later = self.prices_weekly.where(F.col("date") >= F.lit(FORECAST_START).cast("date"))
        return later.select(
            "symbol", "date", "price", (F.col("price") * 0.9).alias("lower"), (F.col("price") * 1.1).alias("upper")
        )

    # ---- portfolios -------------------------------------------------------------
    @cached_property
    def _bought(self) -> DataFrame:
        orders = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        line = self.raw("lineitem").select(
            "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice"
        )
        part = self.raw("part").select("p_partkey", F.col("p_type").alias("symbol"))
        return line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
            part, F.col("l_partkey") == F.col("p_partkey")
        )

    @cached_property
    def positions_by_customer(self) -> DataFrame:
        """One portfolio per customer, owned by the customer's nation."""
        agg = self._bought.groupBy(F.col("o_custkey").alias("portfolio_id"), "symbol").agg(
            F.sum("l_quantity").alias("quantity"),
            F.sum("l_extendedprice").alias("cost_basis"),
            F.to_date(F.min("o_orderdate")).alias("purchase_date"),
        )
        cust = self.raw("customer").select(
            F.col("c_custkey").alias("portfolio_id"), F.col("c_nationkey").cast("long").alias("user_id")
        )
        total = F.sum("cost_basis").over(W.partitionBy("portfolio_id"))
        return agg.join(cust, "portfolio_id").select(
            "portfolio_id",
            "user_id",
            "symbol",
            "quantity",
            "cost_basis",
            (F.col("cost_basis") / total).alias("weight"),
            "purchase_date",
            lookup(ASSET_TYPE, F.col("symbol")).alias("asset_type"),
        )

    @cached_property
    def positions(self) -> DataFrame:
        """One portfolio per nation with staggered purchase dates; owner = region."""
        cust = self.raw("customer").select("c_custkey", "c_nationkey")
        nation = self.raw("nation").select("n_nationkey", F.col("n_regionkey").cast("long").alias("user_id"))
        # owners first (orders are the smaller side), so line items are aggregated straight to nations
        owned = self.raw("orders").select("o_orderkey", "o_custkey").join(cust, F.col("o_custkey") == F.col("c_custkey"))
        line = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
        part = self.raw("part").select("p_partkey", F.col("p_type").alias("symbol"))
        agg = (
            line.join(owned, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(part, F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(F.col("c_nationkey").alias("n_nationkey"), "symbol")
            .agg(F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("cost_basis"))
            .join(nation, "n_nationkey")
        )
        w = W.partitionBy("n_nationkey")
        number = F.row_number().over(w.orderBy("symbol")) - 1
        return agg.select(
            F.col("n_nationkey").cast("long").alias("portfolio_id"),
            "user_id",
            "symbol",
            "quantity",
            "cost_basis",
            (F.col("cost_basis") / F.sum("cost_basis").over(w)).alias("weight"),
            F.date_add(F.lit("1995-01-02").cast("date"), 31 * F.col("n_nationkey") + 97 * number).alias(
                "purchase_date"
            ),
            lookup(ASSET_TYPE, F.col("symbol")).alias("asset_type"),
        )

    @cached_property
    def assets(self) -> DataFrame:
        return self.raw("part").groupBy(F.col("p_type").alias("symbol")).agg(
            F.count("*").alias("n_parts")
        ).select(
            "symbol",
            F.initcap("symbol").alias("name"),
            lookup(ASSET_TYPE, F.col("symbol")).alias("asset_type"),
            lookup(ASSET_CLASS, F.col("symbol")).alias("asset_class"),
            "n_parts",
        )

    # ---- fundamentals -----------------------------------------------------------
    @cached_property
    def fundamentals(self) -> DataFrame:
        """One company per part: flat facts with realistic gaps."""
        key = F.col("p_partkey")
        return self.raw("part").select(
            F.concat(F.lit("P"), key.cast("string")).alias("symbol"),
            F.col("p_name").alias("name"),
            lookup(ASSET_TYPE, F.col("p_type")).alias("type"),
            F.when(key % 13 != 0, F.col("p_brand")).alias("sector"),
            F.when(key % 7 != 0, F.col("p_retailprice") * 1e6).alias("market_cap"),
            F.when(key % 5 != 0, F.col("p_size").cast("double")).alias("pe_ratio"),
            (F.col("p_retailprice") / 100).alias("ev_to_ebitda"),
            ((key % 41 - 5) / 100).alias("profit_margin"),
            F.when(key % 11 != 0, (key % 29) / 10).alias("beta"),
            ((key % 17) / 200).alias("fund_yield"),
            F.timestamp_seconds(F.lit(1704067200) + (key % 96) * 1800).alias("as_of"),
        )

    # ---- alerts -----------------------------------------------------------------
    @cached_property
    def alert_rules(self) -> DataFrame:
        """One rule per customer; the market segment decides its type."""
        key = F.col("c_custkey")
        kind = F.element_at(
            F.create_map(
                *[
                    F.lit(x)
                    for kv in {
                        "AUTOMOBILE": "price_threshold",
                        "BUILDING": "anomaly",
                        "FURNITURE": "forecast_divergence",
                        "HOUSEHOLD": "regime_watch",
                        "MACHINERY": "volume_burst",
                    }.items()
                    for x in kv
                ]
            ),
            F.col("c_mktsegment"),
        )
        external = (F.col("c_mktsegment") == "BUILDING") & (key % 2 == 0)
        symbols = F.array(*[F.lit(s) for s in SYMBOLS])
        return self.raw("customer").select(
            key.alias("alert_id"),
            F.col("c_nationkey").cast("long").alias("user_id"),
            F.col("c_name").alias("name"),
            F.when(
                external, F.concat(F.lit("U"), F.floor(key / 10).cast("string"), F.lit("-USD"))
            )
            .otherwise(F.element_at(symbols, (key % 6 + 1).cast("int")))
            .alias("ticker"),
            kind.alias("alert_type"),
            F.when(key % 2 == 1, "below").otherwise("above").alias("direction"),
            (F.col("c_acctbal") / 4).alias("threshold_value"),
            (10 + key % 50).cast("int").alias("lookback_days"),
            (F.col("c_acctbal") > 0).alias("is_active"),
            F.when(
                external,
                F.format_string('{"detector":"external","cooldown_seconds":%d}', (key % 5) * 43200),
            )
            .when(
                F.col("c_mktsegment") == "HOUSEHOLD",
                F.format_string('{"portfolio_id":%d,"margin":0.1}', key % 27),
            )
            .otherwise(F.lit("{}"))
            .alias("extra_config"),
        )

    @cached_property
    def detections(self) -> DataFrame:
        """External detector output: one row per event."""
        kinds = {
            "view": "robust_z",
            "click": "cusum",
            "purchase": "volume_spike",
            "signup": "spread_widen",
            "error": "burst",
        }
        value = F.col("value")
        return self.raw("events").select(
            "event_id",
            F.concat(F.lit(" u"), F.col("user_id").cast("string"), F.lit("/usd")).alias("symbol_raw"),
            "ts",
            lookup(kinds, F.col("event_type")).alias("kind"),
            F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).otherwise(value / 10).alias("score"),
            F.when(F.col("event_id") % 101 == 0, F.lit(float("inf"))).otherwise(value).alias("price"),
            F.when(value < 10, "info")
            .when(value < 50, "alert")
            .when(value < 100, "warning")
            .when(value < 150, "anomaly")
            .otherwise("custom")
            .alias("severity"),
        )

    @cached_property
    def feedback(self) -> DataFrame:
        """Ratings: each user rates events, sometimes twice."""
        kinds = {"view": "robust_z", "click": "cusum", "purchase": "volume_spike", "signup": "spread_widen"}
        return self.raw("events").select(
            (F.floor(F.col("event_id") / 3)).cast("long").alias("event_id"),
            "user_id",
            F.when(F.col("value") > 25, "useful").otherwise("not_useful").alias("rating"),
            F.element_at(F.array(*[F.lit(s) for s in SYMBOLS]), (F.col("user_id") % 6 + 1).cast("int")).alias(
                "ticker"
            ),
            lookup(kinds, F.col("event_type")).alias("kind"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def alert_prefs(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.raw("customer").select(
            key.alias("user_id"),
            (key % 11 != 0).alias("email_enabled"),
            F.element_at(
                F.array(*[F.lit(x) for x in ["INFO", "ALERT", "WARNING", "ANOMALY"]]),
                (key % 4 + 1).cast("int"),
            ).alias("min_severity"),
            (key % 24).cast("int").alias("quiet_start"),
            ((key * 7 + 3) % 24).cast("int").alias("quiet_end"),
            ((key % 5 - 2) * 60 + 30).cast("int").alias("tz_offset_min"),
            F.when(key % 3 == 0, F.array(F.lit("CUSUM"), F.lit("burst")))
            .otherwise(F.array().cast("array<string>"))
            .alias("muted_kinds"),
            F.when(key % 4 == 0, F.array(F.concat(F.lit("u"), key.cast("string"), F.lit("-usd"))))
            .otherwise(F.array().cast("array<string>"))
            .alias("muted_tickers"),
            (key % 4).cast("int").alias("auto_mute_after"),
        )

    # ---- telemetry --------------------------------------------------------------
    @staticmethod
    def telemetry_from_events(events: DataFrame) -> DataFrame:
        """Device messages (topic, payload, arrival) out of the event rows; works on streams."""
        suffix = {
            "view": "osd",
            "click": "state",
            "purchase": "events",
            "signup": "requests",
            "error": "services_reply",
        }
        eid, val = F.col("event_id"), F.col("value")
        k = F.get_json_object("props", "$.k").cast("int")
        inner = F.format_string(
            '"latitude":%d,"height":%d,"horizontal_speed":%d,"battery":{"capacity_percent":%d}',
            k % 90, k + 100, k % 3, k,
        )
        osd = (
            F.when(eid % 3 == 0, F.format_string('{"data":{"sub_devices":[{"data":{%s}}]}}', inner))
            .when(eid % 3 == 1, F.format_string('{"data":{%s}}', inner))
            .otherwise(F.format_string('{"latitude":%d,"altitude":%d,"battery_percent":%d}', k, k + 50, k))
        )
        state = F.format_string(
            '{"data":{"online":%s,"firmware_version":"%s"}}',
            F.when(k % 2 == 0, "true").otherwise("false"),
            F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("v"), k.cast("string"))),
        )
        event = F.when(eid % 2 == 0, F.format_string('{"method":"mission_%d","data":{}}', k % 5)).otherwise(
            F.format_string('{"data":{"event_type":"media_%d"}}', k % 4)
        )
        method = F.element_at(
            F.array(*[F.lit(m) for m in ["config", "airport_bind_status", "airport_organization_get",
                                         "flighttask_resource_get", "other_request"]]),
            (k % 5 + 1).cast("int"),
        )
        request = F.format_string('{"tid":"t%d","bid":"b%d","method":"%s","data":{}}', eid, k, method)
        reply = (
            F.when(k % 3 == 0, F.format_string('{"method":"takeoff","data":{"result":%d}}', k))
            .when(k % 3 == 1, F.format_string('{"code":%d}', k))
            .otherwise(F.lit('{"data":{}}'))
        )
        kind = F.col("event_type")
        payload = (
            F.when(eid % 19 == 0, F.concat(F.lit("{broken "), val.cast("string")))
            .when(kind == "view", osd)
            .when(kind == "click", state)
            .when(kind == "purchase", event)
            .when(kind == "signup", request)
            .otherwise(reply)
        )
        prefix = F.when(eid % 23 == 0, "thing/other/").otherwise("thing/product/")
        return events.select(
            "event_id",
            F.concat(
                prefix, F.lit("SN"), F.col("user_id").cast("string"), F.lit("/"), lookup(suffix, kind)
            ).alias("topic"),
            payload.alias("payload"),
            F.col("ts").alias("arrived_at"),
        )

    @cached_property
    def telemetry(self) -> DataFrame:
        return self.telemetry_from_events(self.raw("events"))

    @cached_property
    def drones(self) -> DataFrame:
        return (
            self.raw("customer")
            .where(F.col("c_mktsegment").isin("AUTOMOBILE", "MACHINERY"))
            .select(
                F.concat(F.lit("D"), F.col("c_custkey").cast("string")).alias("id"),
                F.concat(F.lit("SN"), F.col("c_custkey").cast("string")).alias("serial_number"),
            )
        )

    @cached_property
    def docks(self) -> DataFrame:
        return (
            self.raw("customer")
            .where(F.col("c_mktsegment").isin("BUILDING", "HOUSEHOLD"))
            .select(
                F.concat(F.lit("K"), F.col("c_custkey").cast("string")).alias("id"),
                F.concat(F.lit("SN"), F.col("c_custkey").cast("string")).alias("serial_number"),
            )
        )
