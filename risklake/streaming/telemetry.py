"""Device telemetry: one set of transforms for batch frames and for streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Topic prefix, topic types, and the method replies.
TOPIC_TYPES = ["osd", "state", "services_reply", "events", "requests", "property/set_reply"]
TOPIC_PATTERN = r"^thing/product/([^/]*)/(.+)$"
MOVING_SPEED = 0.5


def read_messages(spark: SparkSession, path: str, schema: str, files_per_batch: int = 64, name_filter: str | None = None) -> DataFrame:
    """Landed message files as a stream; the batch size is bounded by files per trigger."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.parquet(path)


def parse_topics(messages: DataFrame) -> DataFrame:
    """Adds device_sn and topic_type; both NULL when the topic is not one of the known patterns."""
    sn = F.regexp_extract("topic", TOPIC_PATTERN, 1)
    kind = F.regexp_extract("topic", TOPIC_PATTERN, 2)
    known = kind.isin(*TOPIC_TYPES)
    return messages.withColumn("device_sn", F.when(known, sn)).withColumn("topic_type", F.when(known, kind))


def with_document(messages: DataFrame) -> DataFrame:
    """Adds the parsed payload as VARIANT; NULL when it is not valid JSON."""
    return messages.withColumn("doc", F.try_parse_json("payload"))


def dead_letters(parsed: DataFrame) -> DataFrame:
    """Unknown topics and undecodable payloads, with what was wrong."""
    error = F.when(F.col("topic_type").isNull(), "unknown topic").when(F.col("doc").isNull(), "invalid JSON")
    return parsed.withColumn("error", error).where("error is not null")


def decodable(parsed: DataFrame) -> DataFrame:
    return parsed.where("topic_type is not null and doc is not null")


def _get(path: str, kind: str = "double") -> Column:
    return F.try_variant_get("doc", path, kind)


def _in_data(name: str, kind: str) -> Column:
    """A field of ``data`` when the message has one, else of the root."""
    has_data = F.try_variant_get("doc", "$.data", "variant").isNotNull()
    return F.when(has_data, _get(f"$.data.{name}", kind)).otherwise(_get(f"$.{name}", kind))


def decode_osd(rows: DataFrame) -> DataFrame:
    """Position, speed, battery, link and mode; first sub-device wins, then data, then the root."""
    sub = F.try_variant_get("doc", "$.data.sub_devices[0]", "variant").isNotNull()
    data = F.try_variant_get("doc", "$.data", "variant").isNotNull()

    def field(kind: str, *names: str) -> Column:
        def at(prefix: str) -> Column:
            return F.coalesce(*[_get(f"{prefix}.{n}", kind) for n in names])

        return F.when(sub, at("$.data.sub_devices[0].data")).when(data, at("$.data")).otherwise(at("$"))

    zero = F.lit(0.0)
    return rows.where("topic_type = 'osd'").select(
        *[c for c in rows.columns if c not in ("doc", "payload")],
        F.coalesce(field("double", "latitude"), zero).alias("latitude"), F.coalesce(field("double", "longitude"), zero).alias("longitude"),
        F.coalesce(field("double", "height", "altitude"), zero).alias("altitude"),
        F.coalesce(field("double", "horizontal_speed", "speed"), zero).alias("speed"),
        F.coalesce(field("double", "battery.capacity_percent", "battery_percent"), zero).alias("battery_percent"),
        F.coalesce(field("double", "wireless_link.quality", "signal_quality"), zero).alias("signal_quality"),
        F.coalesce(field("double", "attitude_head", "heading"), zero).alias("heading"), F.coalesce(field("double", "vertical_speed"), zero).alias("vertical_speed"),
        F.coalesce(field("string", "mode_code", "flight_mode"), F.lit("unknown")).alias("flight_mode"),
    )


def decode_state(rows: DataFrame) -> DataFrame:
    return rows.where("topic_type = 'state'").select(
        *[c for c in rows.columns if c not in ("doc", "payload")], F.coalesce(_in_data("online", "boolean"), F.lit(False)).alias("online"),
        F.coalesce(_in_data("firmware_version", "string"), F.lit("")).alias("firmware_version"), F.coalesce(_in_data("device_model", "string"), F.lit("")).alias("device_model"),
    )


def decode_events(rows: DataFrame) -> DataFrame:
    kind = F.coalesce(_get("$.method", "string"), _in_data("event_type", "string"), F.lit("unknown"))
    return rows.where("topic_type = 'events'").select(*[c for c in rows.columns if c not in ("doc", "payload")], kind.alias("event_kind"))


def decode_requests(rows: DataFrame) -> DataFrame:
    return rows.where("topic_type = 'requests'").select(
        *[c for c in rows.columns if c not in ("doc", "payload")], F.coalesce(_get("$.tid", "string"), F.lit("")).alias("tid"),
        F.coalesce(_get("$.bid", "string"), F.lit("")).alias("bid"), F.coalesce(_get("$.method", "string"), F.lit("unknown")).alias("method"),
    )


def decode_replies(rows: DataFrame) -> DataFrame:
    """Command results: ``result``, else ``code``, else −1."""
    code = F.coalesce(_in_data("result", "int"), _in_data("code", "int"), F.lit(-1))
    return rows.where("topic_type = 'services_reply'").select(
        *[c for c in rows.columns if c not in ("doc", "payload")], F.coalesce(_get("$.method", "string"), F.lit("unknown")).alias("method"), code.alias("result_code"),
    )


def request_replies(requests: DataFrame, organisation_id: str, organisation_name: str, app_id: str, time_server: str = "pool.ntp.org") -> DataFrame:
    """One reply row per request: the ids echoed and a body that depends on the method."""
    method = F.col("method")
    to_json = lambda **kv: F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in kv.items()]))
    body = (
        F.when(method == "config", to_json(ntp_server_host=time_server, app_id=app_id, app_key="", app_license=""))
        .when(method == "airport_bind_status", to_json(is_device_bind_organization=True, organization_id=organisation_id, organization_name=organisation_name))
        .when(method == "airport_organization_get", to_json(organization_name=organisation_name))
        .when(method == "flighttask_resource_get", F.lit('{"file":{"url":"","fingerprint":""}}'))
    )
    topic = F.concat(F.lit("thing/product/"), F.col("device_sn"), F.lit("/requests_reply"))
    return requests.select("*", topic.alias("reply_topic"), F.lit(0).alias("result"), body.alias("output"))


def enrich(osd: DataFrame, drones: DataFrame, docks: DataFrame) -> DataFrame:
    """Device kind and id by serial number: drone first, then dock, else unknown (stream-static)."""
    d = drones.select(F.col("serial_number").alias("device_sn"), F.col("id").alias("_drone"))
    k = docks.select(F.col("serial_number").alias("device_sn"), F.col("id").alias("_dock"))
    j = osd.join(d, "device_sn", "left").join(k, "device_sn", "left")
    kind = F.when(F.col("_drone").isNotNull(), "drone").when(F.col("_dock").isNotNull(), "dock").otherwise("unknown")
    return j.withColumn("device_kind", kind).withColumn("device_id", F.coalesce("_drone", "_dock")).drop("_drone", "_dock")


def with_status(rows: DataFrame) -> DataFrame:
    """Flying above 0.5 speed, otherwise idle; a dock that reports is online."""
    status = (
        F.when((F.col("device_kind") == "drone") & (F.col("speed") > MOVING_SPEED), "flying").when(F.col("device_kind") == "drone", "idle")
        .when(F.col("device_kind") == "dock", "online")
    )
    return rows.withColumn("status", status)


def latest_device_state(states: DataFrame) -> DataFrame:
    """Newest state per serial; a blank firmware keeps the last non-blank one.

    A plain aggregate: it combines before the shuffle and runs unchanged as a streaming aggregate in
    complete or update mode, so no per-device process ever sees all of a device's rows.
    """
    order = F.struct("arrived_at", "event_id")
    firmware = F.when(F.col("firmware_version") != "", F.struct("arrived_at", "event_id"))
    return states.groupBy("device_sn").agg(
        F.max("arrived_at").alias("last_heartbeat"), F.max_by("online", order).alias("online"), F.max_by("firmware_version", firmware).alias("firmware_version")
    )


def state_status(latest: DataFrame) -> DataFrame:
    """Docks read online/offline; drones idle/offline; unknown devices are skipped."""
    up = F.when(F.col("device_kind") == "dock", "online").otherwise("idle")
    return latest.where("device_kind <> 'unknown'").withColumn("status", F.when(F.col("online"), up).otherwise("offline"))


def counters(parsed: DataFrame) -> DataFrame:
    bad = F.col("topic_type").isNull() | F.col("doc").isNull()
    return parsed.agg(F.count("*").alias("received"), F.count(F.when(~bad, 1)).alias("processed"), F.count(F.when(bad, 1)).alias("errors"))


def telemetry_windows(osd: DataFrame, length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Per-device tumbling or sliding summaries on event time."""
    w = F.window("arrived_at", length, slide) if slide else F.window("arrived_at", length)
    return osd.groupBy("device_sn", w.alias("w")).agg(
        F.count("*").alias("n"), F.avg("battery_percent").alias("avg_battery"), F.max("altitude").alias("max_altitude"), F.max("speed").alias("max_speed")
    ).select("device_sn", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "avg_battery", "max_altitude", "max_speed")


def telemetry_sessions(osd: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Per-device sessions that close after ``gap`` without a message."""
    return osd.groupBy("device_sn", F.session_window("arrived_at", gap).alias("w")).agg(
        F.count("*").alias("n"), F.min("battery_percent").alias("min_battery")
    ).select("device_sn", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "min_battery")
