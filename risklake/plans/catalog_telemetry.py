"""Registered queries: device telemetry, batch and streamed."""

from __future__ import annotations

from pyspark.sql import functions as F

from risklake import schemas
from risklake.plans.registry import register
from risklake.session import materialise
from risklake.sources.testdata import Tables
from risklake.streaming import jobs
from risklake.streaming import telemetry as tel

GOOD = "known AND NOT broken"
OSD_SQL = f"""SELECT event_id, device_sn, arrived_at, CASE WHEN event_id%3=2 THEN k ELSE k%90 END AS latitude, CASE WHEN event_id%3=2 THEN k+50 ELSE k+100 END AS altitude, CASE WHEN event_id%3=2 THEN 0 ELSE k%3 END AS speed,
    k AS battery_percent, 'unknown' AS flight_mode FROM tele WHERE topic_type='osd' AND {GOOD}"""
STATE_SQL = f"SELECT event_id, device_sn, arrived_at, k%2=0 AS online, CASE WHEN k%3=0 THEN '' ELSE 'v'||k END AS firmware_version FROM tele WHERE topic_type='state' AND {GOOD}"


def _parsed(t: Tables):
    return tel.with_document(tel.parse_topics(t.telemetry))


def _good(t: Tables):
    return tel.decodable(_parsed(t))


def _stream(t: Tables):
    """The event file as a message stream, decoded exactly like the batch table."""
    return Tables.telemetry_from_events(tel.read_messages(t.spark, t.dir, schemas.EVENTS, name_filter="events.parquet"))


@register(
    "str_01_topic_parse", "event_id:i device_sn:s topic_type:s",
    "SELECT event_id, CASE WHEN known THEN device_sn END AS device_sn, CASE WHEN known THEN topic_type END AS topic_type FROM tele",
)
def _(t: Tables):
    return tel.parse_topics(t.telemetry)


@register("str_02_osd_decode", "event_id:i device_sn:s latitude:d2 altitude:d2 speed:d2 battery_percent:d2 flight_mode:s", OSD_SQL)
def _(t: Tables):
    return tel.decode_osd(_good(t))


@register("str_03_state_decode", "event_id:i device_sn:s online:b firmware_version:s", STATE_SQL)
def _(t: Tables):
    return tel.decode_state(_good(t))


@register(
    "str_03_event_decode", "event_id:i event_kind:s",
    f"SELECT event_id, CASE WHEN event_id%2=0 THEN 'mission_'||(k%5) ELSE 'media_'||(k%4) END AS event_kind FROM tele WHERE topic_type='events' AND {GOOD}",
)
def _(t: Tables):
    return tel.decode_events(_good(t))


METHOD = "['config','airport_bind_status','airport_organization_get','flighttask_resource_get','other_request'][k%5+1]"


@register(
    "str_03_request_decode", "event_id:i tid:s bid:s method:s",
    f"SELECT event_id, 't'||event_id AS tid, 'b'||k AS bid, {METHOD} AS method FROM tele WHERE topic_type='requests' AND {GOOD}",
)
def _(t: Tables):
    return tel.decode_requests(_good(t))


@register("str_04_route_by_type", "topic_type:s n:i", f"SELECT topic_type, count(*) AS n FROM tele WHERE {GOOD} GROUP BY 1")
def _(t: Tables):
    """The routed sinks of the streaming router, counted per folder."""
    root = jobs.run_router(_stream(t))
    out = None
    for kind in tel.TOPIC_TYPES:
        rows = t.spark.read.schema("topic_type string").parquet(f"{root}/{kind.replace('/', '_')}")
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("topic_type").agg(F.count("*").alias("n"))


@register(
    "str_05_dead_letters", "event_id:i error:s",
    "SELECT event_id, CASE WHEN NOT known THEN 'unknown topic' ELSE 'invalid JSON' END AS error FROM tele WHERE NOT known OR broken",
)
def _(t: Tables):
    return tel.dead_letters(_parsed(t))


ENRICH_SQL = f"SELECT o.*, coalesce(device_kind,'unknown') AS device_kind, device_id FROM ({OSD_SQL}) o LEFT JOIN devices d ON d.serial_number=o.device_sn"


@register("str_06_registry_enrichment", "event_id:i device_sn:s device_kind:s device_id:s", ENRICH_SQL)
def _(t: Tables):
    return tel.enrich(tel.decode_osd(_good(t)), t.drones, t.docks)


@register(
    "str_07_status_derivation", "event_id:i status:s",
    f"SELECT event_id, CASE WHEN device_kind='drone' AND speed>0.5 THEN 'flying' WHEN device_kind='drone' THEN 'idle' WHEN device_kind='dock' THEN 'online' END AS status FROM ({ENRICH_SQL})",
)
def _(t: Tables):
    return tel.with_status(tel.enrich(tel.decode_osd(_good(t)), t.drones, t.docks))


LATEST_SQL = f"""SELECT device_sn, max(arrived_at) AS last_heartbeat, arg_max(online, arrived_at) AS online, arg_max(firmware_version, arrived_at) FILTER (firmware_version<>'') AS firmware_version FROM ({STATE_SQL}) GROUP BY 1"""


@register("str_08_latest_device_state", "device_sn:s last_heartbeat:ts online:b firmware_version:s", LATEST_SQL)
def _(t: Tables):
    return tel.latest_device_state(tel.decode_state(_good(t)))


@register("str_08_latest_device_state_stream", "device_sn:s last_heartbeat:ts online:b firmware_version:s", LATEST_SQL)
def _(t: Tables):
    rows = tel.decodable(tel.with_document(tel.parse_topics(_stream(t))))
    return jobs.drain(tel.latest_device_state(tel.decode_state(rows)), mode="complete")


@register(
    "str_08_device_status", "device_sn:s device_kind:s status:s",
    f"""SELECT device_sn, device_kind, CASE WHEN NOT online THEN 'offline' WHEN device_kind='dock' THEN 'online' ELSE 'idle' END AS status FROM ({LATEST_SQL}) l JOIN devices d ON d.serial_number=l.device_sn""",
)
def _(t: Tables):
    return tel.state_status(tel.enrich(tel.latest_device_state(tel.decode_state(_good(t))), t.drones, t.docks))


@register(
    "str_09_request_replies", "event_id:i reply_topic:s tid:s method:s output:s",
    f"""SELECT event_id, 'thing/product/'||device_sn||'/requests_reply' AS reply_topic, 't'||event_id AS tid, {METHOD} AS method, CASE k%5
        WHEN 0 THEN '{{"ntp_server_host":"pool.ntp.org","app_id":"app","app_key":"","app_license":""}}' WHEN 1 THEN '{{"is_device_bind_organization":true,"organization_id":"org","organization_name":"Fleet"}}'
        WHEN 2 THEN '{{"organization_name":"Fleet"}}' WHEN 3 THEN '{{"file":{{"url":"","fingerprint":""}}}}' END AS output FROM tele WHERE topic_type='requests' AND {GOOD}""",
)
def _(t: Tables):
    return tel.request_replies(tel.decode_requests(_good(t)), "org", "Fleet", "app")


@register(
    "str_10_command_results", "event_id:i method:s result_code:i",
    f"SELECT event_id, CASE WHEN k%3=0 THEN 'takeoff' ELSE 'unknown' END AS method, CASE WHEN k%3=2 THEN -1 ELSE k END AS result_code FROM tele WHERE topic_type='services_reply' AND {GOOD}",
)
def _(t: Tables):
    return tel.decode_replies(_good(t))


_LAND = "CASE WHEN {x} < TIMESTAMP '2024-01-11 00:00:00' THEN 1 WHEN {x} < TIMESTAMP '2024-01-21 00:00:00' THEN 2 ELSE 3 END"


@register(
    "str_10_matched_replies_stream", "device_sn:s tid:s asked_at:ts replied_at:ts status:s",
    f"""WITH q AS (SELECT event_id, device_sn, 't'||event_id AS tid, arrived_at AS asked_at, {_LAND.format(x='arrived_at')} AS l FROM tele WHERE topic_type='requests' AND {GOOD}),
        a AS (SELECT *, {_LAND.format(x='replied_at')} + CASE WHEN event_id%11=0 THEN 1 ELSE 0 END AS landed FROM (SELECT event_id, asked_at, asked_at + to_minutes(CAST(event_id%45 AS INTEGER)) AS replied_at FROM q WHERE event_id%5<>0)),
        w AS (SELECT n, least((SELECT max(asked_at) FROM q WHERE q.l<=n), (SELECT max(replied_at) FROM a WHERE landed<=n)) - INTERVAL 10 MINUTE AS mark FROM (VALUES (1),(2),(3),(4)) v(n)),
        r AS (SELECT a.event_id, a.replied_at FROM a LEFT JOIN w ON w.n=a.landed-1 WHERE (w.mark IS NULL OR a.replied_at > w.mark) AND a.replied_at <= a.asked_at + INTERVAL 30 MINUTE)
        SELECT device_sn, tid, asked_at, replied_at, CASE WHEN replied_at IS NULL THEN 'timed out' ELSE 'replied' END AS status FROM q LEFT JOIN r USING (event_id)
        WHERE replied_at IS NOT NULL OR asked_at + INTERVAL 30 MINUTE < (SELECT mark FROM w WHERE n=4)""",
)
def _(t: Tables):
    """Requests and replies in four landings, with a restart after each: every eleventh reply one landing late, every seventh twice, every fifth missing, some after the time allowed."""
    asked = materialise(tel.decode_requests(_good(t)).select("event_id", "device_sn", "tid", F.col("arrived_at").alias("at")), "requests")
    land = lambda at: F.when(at < F.lit("2024-01-11").cast("timestamp"), 1).when(at < F.lit("2024-01-21").cast("timestamp"), 2).otherwise(3)
    k = F.col("event_id")
    late = F.when(k % 11 == 0, 1).otherwise(0)
    replies = asked.where(k % 5 != 0).withColumn("at", F.col("at") + F.make_dt_interval(mins=(k % 45).cast("int")))
    replies = replies.withColumn("landing", F.explode(F.when(k % 7 == 0, F.array(land(F.col("at")) + late, F.lit(4))).otherwise(F.array(land(F.col("at")) + late))))
    requests = asked.withColumn("landing", F.explode(F.when(k % 13 == 0, F.array(land(F.col("at")), land(F.col("at")))).otherwise(F.array(land(F.col("at"))))))
    rows = materialise(requests.withColumn("side", F.lit("request")).unionByName(replies.withColumn("side", F.lit("reply"))), "messages")
    landings = [rows.where(F.col("landing") == n).select("side", "device_sn", "tid", "at") for n in (1, 2, 3, 4)]
    return jobs.drain_landings(landings, jobs.matched_replies, "side string, device_sn string, tid string, at timestamp")


@register("str_11_consumer_counters", "received:i processed:i errors:i", f"SELECT count(*) AS received, count(*) FILTER ({GOOD}) AS processed, count(*) FILTER (NOT ({GOOD})) AS errors FROM tele")
def _(t: Tables):
    return tel.counters(_parsed(t))


WINDOW_SQL = f"""SELECT device_sn, date_trunc('hour', arrived_at) AS start, count(*) AS n, avg(battery_percent) AS avg_battery, max(altitude) AS max_altitude, max(speed) AS max_speed FROM ({OSD_SQL}) GROUP BY 1,2"""


@register("str_12_telemetry_windows", "device_sn:s start:ts n:i avg_battery:d4 max_altitude:d2 max_speed:d2", WINDOW_SQL)
def _(t: Tables):
    return tel.telemetry_windows(tel.decode_osd(_good(t)))


@register(
    "str_12_sliding_windows", "device_sn:s start:ts n:i avg_battery:d4",
    f"""SELECT device_sn, date_trunc('hour', arrived_at) - to_hours(o) AS start, count(*) AS n, avg(battery_percent) AS avg_battery FROM ({OSD_SQL}), (SELECT unnest([0,1]) AS o) GROUP BY 1,2""",
)
def _(t: Tables):
    return tel.telemetry_windows(tel.decode_osd(_good(t)), "2 hours", "1 hour")


@register(
    "str_12_telemetry_sessions", "device_sn:s start:ts stop:ts n:i min_battery:d2",
    f"""SELECT device_sn, min(arrived_at) AS start, max(arrived_at) + INTERVAL 30 MINUTE AS stop, count(*) AS n, min(battery_percent) AS min_battery FROM (SELECT *, sum(b) OVER (PARTITION BY device_sn ORDER BY arrived_at) AS s FROM
        (SELECT *, CASE WHEN arrived_at >= lag(arrived_at) OVER (PARTITION BY device_sn ORDER BY arrived_at) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS b FROM ({OSD_SQL}))) GROUP BY device_sn, s""",
)
def _(t: Tables):
    return tel.telemetry_sessions(tel.decode_osd(_good(t)))


@register(
    "str_12_telemetry_windows_stream", "device_sn:s start:ts n:i avg_battery:d4 max_altitude:d2 max_speed:d2",
    f"""SELECT * FROM ({WINDOW_SQL}) WHERE start + INTERVAL 1 HOUR <= (SELECT max(arrived_at) FROM ({OSD_SQL})) - INTERVAL 10 MINUTE""",
)
def _(t: Tables):
    """Append mode emits a window once the watermark has passed its end."""
    return jobs.drain(jobs.windowed_telemetry(_stream(t)))


@register(
    "str_12_deduplicated_requests_stream", "event_id:i device_sn:s tid:s",
    f"SELECT event_id, device_sn, 't'||event_id AS tid FROM tele WHERE topic_type='requests' AND {GOOD}",
)
def _(t: Tables):
    return jobs.drain(jobs.deduplicated_requests(_stream(t)))
