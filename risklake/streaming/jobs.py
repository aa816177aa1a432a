"""Structured Streaming jobs: fan-out sinks, windows, edge and cooldown state."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from risklake.session import shared_dir
from risklake.streaming import telemetry as tel

WATERMARK = "10 minutes"


def drain(stream: DataFrame, mode: str = "append", root: str | None = None) -> DataFrame:
    """Run a stream over everything available and return what it wrote.

    Output and checkpoint live in the shared folder, so a restarted driver or executor resumes. In
    complete mode the last batch is the result; otherwise all batches together are. With the ``root`` of an earlier call the
    stream goes on where that one ended.
    """
    spark = stream.sparkSession
    root = root or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        # a replayed batch overwrites its own folder: the sink stays exactly-once
        batch.write.mode("overwrite").parquet(f"{root}/out/epoch={epoch if mode == 'append' else 0}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    writer.foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def route_to_sinks(batch: DataFrame, epoch: int, root: str) -> None:
    """One branch per topic type plus the dead letters, each in its own folder.

    The decoded batch is written once and read back by every branch, so a retry never decodes
    twice or publishes half a batch.
    """
    parsed = tel.parse_topics(batch)
    staged = f"{root}/staged/epoch={epoch}"
    parsed.withColumn("valid", F.try_parse_json("payload").isNotNull()).write.mode("overwrite").parquet(staged)
    rows = batch.sparkSession.read.parquet(staged)
    good = rows.where("topic_type is not null and valid")
    for kind in tel.TOPIC_TYPES:
        name = kind.replace("/", "_")
        good.where(F.col("topic_type") == kind).write.mode("overwrite").parquet(f"{root}/{name}/epoch={epoch}")
    bad = rows.where("topic_type is null or not valid")
    error = F.when(F.col("topic_type").isNull(), "unknown topic").otherwise("invalid JSON")
    bad.withColumn("error", error).write.mode("overwrite").parquet(f"{root}/dead_letters/epoch={epoch}")


def run_router(messages: DataFrame) -> str:
    """Route a message stream into per-type folders; returns the root folder."""
    spark = messages.sparkSession
    root = f"{shared_dir(spark)}/router-{uuid.uuid4().hex}"
    writer = messages.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    writer.foreachBatch(lambda b, e: route_to_sinks(b, e, root)).start().awaitTermination()
    return root


def windowed_telemetry(messages: DataFrame, length: str = "1 hour") -> DataFrame:
    """Late-tolerant hourly summaries: watermark, then a windowed aggregate."""
    osd = tel.decode_osd(tel.decodable(tel.with_document(tel.parse_topics(messages))))
    return tel.telemetry_windows(osd.withWatermark("arrived_at", WATERMARK), length)


def deduplicated_requests(messages: DataFrame) -> DataFrame:
    """Requests once per (device, tid) within the watermark."""
    req = tel.decode_requests(tel.decodable(tel.with_document(tel.parse_topics(messages))))
    return req.withWatermark("arrived_at", WATERMARK).dropDuplicatesWithinWatermark(["device_sn", "tid"])


REPLY_WITHIN = "30 minutes"


def matched_replies(rows: DataFrame) -> DataFrame:
    """Requests with their replies; ``rows`` is (side, device_sn, tid, at) with side 'request' or 'reply'.

    A stream-stream outer join on (device, tid) with a watermark on either side and a bound between the two times, so both sides' state
    is dropped in time. Repeats of a message count once. A request whose time has run out comes without a reply, once the watermark says
    that none can follow; a reply outside the bound, or later than the watermark, matches nothing.
    """
    def side(kind: str, at: str, keys: list[str]) -> DataFrame:
        one = rows.where(F.col("side") == kind).select(F.col("device_sn").alias(keys[0]), F.col("tid").alias(keys[1]), F.col("at").alias(at))
        return one.withWatermark(at, WATERMARK).dropDuplicatesWithinWatermark(keys)

    asked, replied = side("request", "asked_at", ["device_sn", "tid"]), side("reply", "replied_at", ["_device", "_tid"])
    same = (F.col("device_sn") == F.col("_device")) & (F.col("tid") == F.col("_tid"))
    in_time = (F.col("replied_at") >= F.col("asked_at")) & (F.col("replied_at") <= F.col("asked_at") + F.expr(f"INTERVAL {REPLY_WITHIN}"))
    status = F.when(F.col("replied_at").isNull(), "timed out").otherwise("replied")
    return asked.join(replied, same & in_time, "left_outer").select("device_sn", "tid", "asked_at", "replied_at", status.alias("status"))


BLOCK = 1 << 10  # neighbouring rule ids of one group


def _stateful(rows: DataFrame, output: str, fn: Callable[[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, pd.DataFrame]]) -> DataFrame:
    """Per-rule state, kept for blocks of ``BLOCK`` neighbouring rule ids, so that a group costs its rows and not its overhead.

    ``fn(rows of the block in the micro-batch, slot of each row's rule, known, values)`` gives the slots and rows that come out, and changes in
    place which slots have a value and which. The state row of a block lists the slots that have one. Rules without an id are one rule.
    """

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, values = np.zeros(BLOCK, bool), np.zeros(BLOCK, np.int64)
        if state.exists:
            at, held = state.get
            at = np.frombuffer(at, "<u2")
            known[at], values[at] = True, np.frombuffer(held, "<i8")
        pdf = pd.concat(list(frames), ignore_index=True)
        slots, out = fn(pdf, pdf["_slot"].to_numpy(), known, values)
        state.update((np.flatnonzero(known).astype("<u2").tobytes(), values[known].astype("<i8").tobytes()))
        if len(out):
            ids = np.full(len(out), int(key[0]) * BLOCK) + slots
            out.insert(0, "alert_id", pd.arrays.IntegerArray(ids.astype(np.int64), np.full(len(out), bool(key[1]))))
            yield out

    rule = F.col("alert_id").cast("long")
    slot = F.coalesce(rule.bitwiseAND(BLOCK - 1), F.lit(0)).cast("int")
    placed = rows.withColumns({"_block": F.coalesce(F.shiftright(rule, BLOCK.bit_length() - 1), F.lit(0)), "_nameless": rule.isNull(), "_slot": slot}).drop("alert_id")
    return placed.groupBy("_block", "_nameless").applyInPandasWithState(step, output, "slots binary, values binary", "append", GroupStateTimeout.NoTimeout)


def _us(times: pd.Series) -> np.ndarray:
    return times.astype("datetime64[us]").to_numpy().view(np.int64)


def _nulls_last(us: np.ndarray) -> np.ndarray:
    return np.where(us == np.iinfo(np.int64).min, np.iinfo(np.int64).max, us)


def edge_stream(evaluations: DataFrame) -> DataFrame:
    """Rising and falling edges of each rule; the state is its last flag.

    Rows: alert_id, evaluated_at, triggered, and ``stored``, true for the rule's newest stored event: such a row sets the state and
    does not come out. Within a micro-batch each rule's rows are put in time order; a rule has one row per evaluation cycle, so a batch
    holds few of them.
    """

    def step(pdf: pd.DataFrame, slots: np.ndarray, known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, pd.DataFrame]:
        stored = pdf["stored"].astype(bool).to_numpy()
        order = np.lexsort((_nulls_last(_us(pdf["evaluated_at"])), ~stored, slots))
        slots, flags = slots[order], pdf["triggered"].astype(bool).to_numpy()[order]
        new = slots[1:] != slots[:-1]
        first, last = np.append(True, new), np.append(new, True)
        before = np.append(False, flags[:-1])
        before[first] = values[slots[first]] != 0
        change = (flags != before) & ~stored[order]
        known[slots[last]], values[slots[last]] = True, flags[last]
        out = pdf.iloc[order[change]]
        edge = out["triggered"].map({True: "rising", False: "falling"})
        return slots[change], pd.DataFrame({"evaluated_at": out["evaluated_at"], "triggered": out["triggered"], "edge": edge})

    stored = F.col("stored") if "stored" in evaluations.columns else F.lit(False)
    rows = evaluations.select("alert_id", "evaluated_at", "triggered", stored.alias("stored"))
    return _stateful(rows, "alert_id long, evaluated_at timestamp, triggered boolean, edge string", step)


def cooldown_stream(matched: DataFrame) -> DataFrame:
    """Kept detections per rule; the state is the last kept time in microseconds.

    The source's files-per-trigger limit bounds what one rule can bring into a batch. Steps go from one kept event to the next.
    """

    def step(pdf: pd.DataFrame, slots: np.ndarray, known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, pd.DataFrame]:
        times = _us(pdf["ts"])
        order = np.lexsort((pdf["event_id"].to_numpy(), _nulls_last(times), slots))
        slots, times, kept = slots[order], times[order], np.zeros(len(order), bool)
        cuts = np.append(np.flatnonzero(np.append(True, slots[1:] != slots[:-1])), len(slots))
        gaps = np.fmax.reduceat(pdf["cooldown_seconds"].to_numpy()[order], cuts[:-1])
        for lo, hi, seconds in zip(cuts[:-1], cuts[1:], gaps):
            slot, us, gap = slots[lo], times[lo:hi], int(seconds) * 1_000_000
            value = int(values[slot]) if known[slot] else None
            if gap <= 0:
                kept[lo:hi] = True
            at = 0 if value is None else int(np.searchsorted(us, value + gap, side="right"))
            while gap > 0 and at < len(us):
                kept[lo + at], value = True, int(us[at])
                at = int(np.searchsorted(us, value + gap, side="right"))
            known[slot], values[slot] = True, int(us[-1]) if gap <= 0 or value is None else value
        out = pdf.iloc[order]
        return slots, pd.DataFrame({"event_id": out["event_id"].to_numpy(), "ts": out["ts"].to_numpy(), "kept": kept})

    rows = matched.select("alert_id", "event_id", "ts", "cooldown_seconds")
    return _stateful(rows, "alert_id long, event_id long, ts timestamp, kept boolean", step)


def drain_landings(landings: list[DataFrame], transform: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """Land tables one after the other, each as files of one folder, and run the stream to its end after each.

    Every run is a new query on the same checkpoint, as after a restart: what it knows of earlier landings is in its state.
    """
    spark = landings[0].sparkSession
    root = f"{shared_dir(spark)}/landings-{uuid.uuid4().hex}"
    for landing in landings:
        landing.write.mode("append").parquet(f"{root}/in")
        out = drain(transform(tel.read_messages(spark, f"{root}/in", schema)), root=root)
    return out
